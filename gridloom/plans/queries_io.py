"""Queries that read and write tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import derive as D
from gridloom.operators.joins import r6
from gridloom.plans import queries_model as M
from gridloom.plans import queries_space  # noqa: F401  its adapters are used here
from gridloom.plans.adapters import Tables
from gridloom.plans.catalog import query
from gridloom.session import new_folder
from gridloom.sources import tables as S


@query("src1_tables", "SELECT 'nation' AS \"table\", count(*) AS n FROM {nation} UNION ALL SELECT 'orders', count(*) FROM {orders} UNION ALL SELECT 'part', count(*) FROM {part}")
def _(t: Tables) -> DataFrame:
    found = S.read_tables(t.spark, t.sf_dir, ["nation", "orders", "part"])
    return S.union(*(df.select(F.lit(n).alias("table")) for n, df in found.items())).groupBy("table").agg(F.count("*").alias("n"))


@query("src2_projected", "SELECT CAST(c_nationkey AS STRING) AS c_nationkey, CAST(c_custkey AS STRING) AS c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal FROM {customer} WHERE c_custkey IN (SELECT min(c_custkey) FROM {customer} GROUP BY c_nationkey)")
def _(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "csv")
    rows = t("customer").withColumn("c_acctbal", F.when(F.col("c_custkey") % 7 == 0, "bad").otherwise(F.col("c_acctbal").cast("string")))
    rows.repartitionByRange(4, "c_custkey").sortWithinPartitions("c_custkey").write.option("header", True).csv(path)
    return S.read_projected(t.spark, path, ["c_nationkey", "c_custkey", "c_acctbal"], "c_nationkey", "c_acctbal")


@query("src3_layer", "SELECT o_orderpriority, count(*) AS n FROM {orders} WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY o_orderpriority")
def _(t: Tables) -> DataFrame:
    return S.read_layer(t.spark, f"{t.sf_dir}/orders.parquet", "o_orderpriority", ["1-URGENT", "2-HIGH"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("src4_bbox", "SELECT feature_id FROM {features} WHERE xmin <= -100 AND xmax >= -120 AND ymin <= 60 AND ymax >= 50 AND (xmax - xmin) * (ymax - ymin) >= CASE WHEN layer = 'PROMO' THEN 3 ELSE 0 END")
def _(t: Tables) -> DataFrame:
    return S.read_bbox(t("features"), (-120.0, 50.0, -100.0, 60.0), "layer", {"PROMO": 3.0}).select("feature_id")


@query("src5_facilities")
def _(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "facilities")
    f = t("facilities").where("lon is not null and lat is not null")
    f.write.option("header", True).csv(f"{path}/csv")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct("facility_id", "name", "emissions").alias("properties"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geometry"))
    parts = f.withColumn("_part", F.pmod(F.xxhash64("name", "lon"), F.lit(8)))  # a file of features a part
    parts.groupBy("_part").agg(F.collect_list(feature).alias("features")).select(F.lit("FeatureCollection").alias("type"), "features").write.json(f"{path}/geojson")
    return S.read_facilities(t.spark, f"{path}/csv", f"{path}/geojson")[2]


@query("src6_cost_tables", "SELECT 'fixed' AS cost_type, count(*) AS n, round(sum(cost), 4) AS cost FROM {cost_fixed} UNION ALL SELECT 'variable', count(*), round(sum(cost), 4) FROM {cost_variable}")
def _(t: Tables) -> DataFrame:
    paths = {}
    for name in ("fixed", "variable"):
        paths[name] = new_folder(t.spark, name)
        t(f"cost_{name}").write.parquet(paths[name])
    return S.read_cost_tables(t.spark, paths).groupBy("cost_type").agg(F.count("*").alias("n"), F.round(F.sum("cost"), 4).alias("cost"))


@query("src7_outputs", "SELECT count(*) AS n_there, 0::BIGINT AS n_absent FROM {demand}")
def _(t: Tables) -> DataFrame:
    root = new_folder(t.spark, "outputs")
    t("demand").write.parquet(f"{root}/Demand")
    there, absent = S.read_output(t.spark, root, "Demand", ""), S.read_output(t.spark, root, "Other", "x int", required=False)
    return there.agg(F.count("*").alias("n_there")).join(absent.agg(F.count("*").alias("n_absent")), F.lit(True))


@query("snk1_append", "SELECT 'run' AS scenario, sector, count(*) AS n FROM {net_capacity} JOIN (SELECT tech, sector FROM {technology}) USING (tech) WHERE scenario = 'A' GROUP BY sector UNION ALL SELECT 'run-1', sector, count(*) FROM {net_capacity} JOIN (SELECT tech, sector FROM {technology}) USING (tech) WHERE scenario = 'R' GROUP BY sector")
def _(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "results")
    for s, k in (("A", None), ("R", 1)):
        S.write_results(S.tagged(t("net_capacity").where(F.col("scenario") == s), "run", k, t("technology")), path)
    return t.spark.read.parquet(path).groupBy("scenario", "sector").agg(F.count("*").alias("n"))


@query("snk2_replace", "SELECT scenario, count(*) AS n, round(sum(CASE WHEN scenario = 'A' THEN capacity * 2 ELSE capacity END), 4) AS capacity FROM {net_capacity} WHERE scenario = 'R' OR scenario = 'A' AND period < 2000 GROUP BY scenario")
def _(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "results")
    S.write_results(t("net_capacity"), path)
    S.replace_scenario(S.clear_after(t("net_capacity").where("scenario = 'A'"), 2000).withColumn("capacity", F.col("capacity") * 2), path)
    S.clear_scenario(t.spark, path, "N")
    return t.spark.read.parquet(path).groupBy("scenario").agg(F.count("*").alias("n"), F.round(F.sum("capacity"), 4).alias("capacity"))


@query("snk3_upsert", "SELECT region, tech, vintage, round(coalesce(u, cost), 6) AS cost FROM {cost_invest} LEFT JOIN (SELECT region, tech, vintage, arg_max(cost, period) AS u FROM {cost_fixed} GROUP BY ALL) USING (region, tech, vintage) UNION ALL SELECT region, tech, vintage, round(u, 6) FROM (SELECT region, tech, vintage, arg_max(cost, period) AS u FROM {cost_fixed} GROUP BY ALL) ANTI JOIN {cost_invest} USING (region, tech, vintage)")
def _(t: Tables) -> DataFrame:
    return S.upsert(t("cost_invest"), t("cost_fixed"), ["region", "tech", "vintage"], F.desc("period")).select("region", "tech", "vintage", *r6("cost"))


@query("snk4_export", "SELECT 'Demand' AS \"table\", count(*) AS n_rows FROM {demand} UNION ALL SELECT 'Commodity', count(*) FROM {commodity} UNION ALL SELECT 'CostInvest', count(*) FROM {cost_invest}")
def _(t: Tables) -> DataFrame:
    return S.export_model({"Demand": t("demand"), "Commodity": t("commodity"), "CostInvest": t("cost_invest")}, new_folder(t.spark, "model"))


@query("snk5_evidence", f"SELECT stage AS check_id, count(*) AS n FROM ({M._VERDICTS}) GROUP BY stage")
def _(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "evidence")
    S.write_evidence(t.sql(M._VERDICTS).withColumnRenamed("stage", "check_id"), path)
    return t.spark.read.option("header", True).csv(path).groupBy("check_id").agg(F.count("*").alias("n"))


@query("snk6_upgrade", f"SELECT region, period, tech, vintage, round(cost, 6) AS cost, CAST(NULL AS STRING) AS notes FROM {{cost_invest}} JOIN (SELECT region, tech, vintage, period FROM ({M._ACTIVE})) USING (region, tech, vintage)")
def _(t: Tables) -> DataFrame:
    lives = D.active(M._lives(t), t("period"))
    return S.upgrade(t("cost_invest"), {"region": "string", "period": "int", "tech": "string", "vintage": "int", "cost": "double", "notes": "string"}, lives).withColumn("cost", F.round("cost", 6))
