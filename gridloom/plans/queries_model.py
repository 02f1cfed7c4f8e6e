"""Queries that prepare, derive and check model tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import checks as C
from gridloom.operators import derive as D
from gridloom.operators import prepare as P
from gridloom.operators import regions as G
from gridloom.operators.joins import r6
from gridloom.plans.adapters import Tables
from gridloom.plans.catalog import query

_OK = "(coalesce(lat BETWEEN 40 AND 85 AND lon BETWEEN -145 AND -45 AND lat <> 0 AND lon <> 0, false))"


@query("prj1_standardize", "SELECT facility_id AS id, name AS facility, try_cast(emissions AS DOUBLE) AS tonnes, try_cast(name AS DOUBLE) AS bad FROM (SELECT *, name AS name2 FROM {facilities})")
def _(t: Tables) -> DataFrame:
    df, _ = P.standardize(t("facilities").withColumn("name2", F.col("name")), {"facility_id": "id", "name": "facility", "emissions": "tonnes", "name2": "bad"}, ["tonnes", "bad"])
    return df.select("id", "facility", "tonnes", "bad")


@query("prj2_assignable", f"SELECT facility_id, lon, lat, {_OK} AS ok FROM {{facilities}}")
def _(t: Tables) -> DataFrame:
    return t("facilities").select("facility_id", F.col("lon").cast("double").alias("lon"), "lat", P.assignable().alias("ok"))


@query(
    "prj3_quality_profile",
    """SELECT count(*) AS n_rows, count(*) FILTER (facility_id IS NULL) AS missing_id, count(*) FILTER (name IS NULL) AS missing_name, count(*) FILTER (lat IS NULL OR lon IS NULL) AS missing_coordinate,
      count(*) FILTER (emissions < 0) AS negative, count(*) FILTER (emissions = 0) AS zero, count(*) - count(DISTINCT facility_id) - max(CASE WHEN facility_id IS NULL THEN 1 ELSE 0 END) AS duplicate_id FROM {facilities}""",
)
def _(t: Tables) -> DataFrame:
    return P.quality_profile(t("facilities"), "facility_id", "name", "lat", "lon", "emissions")


@query(
    "prj4_totals",
    f"""WITH f AS (SELECT emissions AS e, {_OK} AS ok FROM {{facilities}}) SELECT 'facilities' AS field, CAST(count(*) AS DOUBLE) AS value FROM f UNION ALL SELECT 'facilities_spatial', count(*) FILTER (ok) FROM f UNION ALL SELECT 'facilities_other', count(*) FILTER (NOT ok) FROM f
    UNION ALL SELECT 'total', round(sum(e), 4) FROM f UNION ALL SELECT 'total_spatial', round(sum(e) FILTER (ok), 4) FROM f UNION ALL SELECT 'total_other', round(sum(e) FILTER (NOT ok), 4) FROM f""",
)
def _(t: Tables) -> DataFrame:
    return P.totals(t("facilities"), P.assignable(), "emissions").withColumn("value", F.round("value", 4))


@query("prj5_jurisdiction_code", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(substr(n_name, 1, 2)) WHEN c_custkey % 3 = 1 THEN substr(n_name, 1, 2) END AS code FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
def _(t: Tables) -> DataFrame:
    names = t("nation").select(F.col("n_name").alias("name"), F.substring("n_name", 1, 2).alias("code"))
    k = F.col("c_custkey") % 3
    said = F.when(k == 0, F.lower(F.substring("n_name", 1, 2))).when(k == 1, F.concat(F.lit(" "), F.initcap("n_name"))).otherwise("?")
    df = t("customer").join(F.broadcast(t("nation")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", said.alias("said"))
    return P.jurisdiction_code(df, names, "said").select("c_custkey", "code")


@query("prj6_split_jurisdictions", "SELECT p_brand AS brand, count(*) FILTER (p_brand IN ('Brand#1', 'Brand#2') OR p_type = 'PROMO') AS kept, count(*) FILTER (NOT (p_brand IN ('Brand#1', 'Brand#2') OR p_type = 'PROMO')) AS dropped FROM {part} GROUP BY p_brand")
def _(t: Tables) -> DataFrame:
    yes, no = P.split_jurisdictions(t("part"), ["p_brand", "p_type"], ["Brand#1", "Brand#2", "PROMO"], ["Brand#1", "Brand#2", "PROMO"])
    both = yes.select("p_brand", F.lit(True).alias("k")).unionByName(no.select("p_brand", F.lit(False).alias("k")))
    return both.groupBy(F.col("p_brand").alias("brand")).agg(F.count_if("k").alias("kept"), F.count_if(~F.col("k")).alias("dropped"))


@query("prj7_padded", "SELECT c_custkey, CASE WHEN length(CAST(c_custkey AS STRING)) < 3 THEN lpad(CAST(c_custkey AS STRING), 3, '0') ELSE CAST(c_custkey AS STRING) END AS id FROM {customer}")
def _(t: Tables) -> DataFrame:
    return t("customer").select("c_custkey", P.padded(F.col("c_custkey").cast("string"), 3).alias("id"))


@query("prj8_decode", "SELECT p_partkey, n_name AS label FROM {part} LEFT JOIN {nation} ON p_size = n_nationkey")
def _(t: Tables) -> DataFrame:
    domain = t("nation").select(F.lit("size").alias("domain"), F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"))
    return P.decode(t("part"), domain, "size", "p_size", "label").select("p_partkey", "label")


_BANDS = "SELECT concat('B', CAST(r_regionkey AS STRING)) AS band, CASE WHEN r_regionkey > 0 THEN 2e3 * r_regionkey - 1e3 END AS lower, CASE WHEN r_regionkey < 4 THEN 2e3 * r_regionkey + 1e3 END AS upper, true AS lower_inclusive, false AS upper_inclusive FROM {region}"


@query("prj9_bands", "SELECT c_custkey, concat('B', CAST(greatest(0, least(4, floor((coalesce(c_acctbal, 0) + 1000) / 2000))) AS INT)) AS band FROM {customer}")
def _(t: Tables) -> DataFrame:
    return P.classify_bands(t("customer"), t.sql(_BANDS), "c_acctbal", ["c_custkey"], check=False).select("c_custkey", "band")


@query("prj10_class_minimum", "SELECT p_partkey, p_type FROM {part} JOIN (SELECT p_type AS k, avg(p_size) AS m FROM {part} WHERE p_type <> 'PROMO' GROUP BY p_type) ON p_type = k WHERE p_size >= m UNION ALL SELECT p_partkey, p_type FROM {part} WHERE p_type = 'PROMO'")
def _(t: Tables) -> DataFrame:
    minima = t("part").where("p_type <> 'PROMO'").groupBy(F.col("p_type").alias("class")).agg(F.avg("p_size").alias("minimum"))
    return P.over_class_minimum(t("part"), minima, "p_type", "p_size").select("p_partkey", "p_type")


@query("prj11_drop_technologies", "SELECT tech, count(*) AS n FROM {net_capacity} WHERE tech NOT IN (SELECT tech FROM {technology} WHERE sector = 'power') GROUP BY tech")
def _(t: Tables) -> DataFrame:
    return P.drop_technologies({"c": t("net_capacity")}, t("technology").where("sector = 'power'"))["c"].groupBy("tech").agg(F.count("*").alias("n"))


@query("prj13_parse_edges", "SELECT region, region LIKE '%-%' AS is_edge, CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 1) END AS region_from, CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 2) END AS region_to, count(*) AS n FROM {flow_out} GROUP BY region")
def _(t: Tables) -> DataFrame:
    return G.parse_edges(t("flow_out").groupBy("region").agg(F.count("*").alias("n")))


@query("prj14_numeric_order", "SELECT s_name, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS INT) AS k FROM {supplier}")
def _(t: Tables) -> DataFrame:
    return t("supplier").select("s_name", G.numeric_order("s_name").alias("k")).orderBy("k")


@query("prj15_bin_sites", "SELECT round(round_even(lon / 2.5, 0) * 2.5, 6) AS lon, round(round_even(lat / 2.5, 0) * 2.5, 6) AS lat, round(avg(value), 6) AS mean_value, round(CAST(sum(jurisdiction) AS DOUBLE), 6) AS total FROM {points} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    p = t("points").select("lon", "lat", F.col("value").alias("mean_value"), F.col("jurisdiction").cast("double").alias("total"))
    return P.bin_sites(p, 2.5, ["mean_value"], ["total"]).select(*r6("lon", "lat", "mean_value", "total"))


@query("prj16_units", "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'missing' WHEN p_size % 4 = 1 THEN 'mass' WHEN p_size % 4 = 2 THEN 'energy' ELSE 'unknown' END AS category FROM {part}")
def _(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    units = t.sql("SELECT 'Tonne' AS unit, 'mass' AS category UNION ALL SELECT 'pj', 'energy'")
    return P.unit_category(t("part").withColumn("unit", F.when(k == 0, " ").when(k == 1, "tonne ").when(k == 2, "PJ").otherwise("furlong")), units).select("p_partkey", "category")


_PROCESS = "SELECT DISTINCT region, tech, vintage FROM {efficiency}"
_LIFE = f"SELECT p.region, p.tech, p.vintage, coalesce(a.lifetime, b.lifetime, 25) AS lifetime FROM ({_PROCESS}) p LEFT JOIN (SELECT * FROM {{lifetime_process}}) a ON a.region = p.region AND a.tech = p.tech AND a.vintage = p.vintage LEFT JOIN (SELECT * FROM {{lifetime_tech}}) b ON b.region = p.region AND b.tech = p.tech"
_ACTIVE = f"SELECT region, tech, vintage, lifetime, period FROM ({_LIFE}) l, {{period}} WHERE vintage <= period AND period < vintage + lifetime"


def _lives(t: Tables) -> DataFrame:
    return D.lifetimes(t("efficiency").select(*D.PROCESS).distinct(), t("lifetime_process"), t("lifetime_tech"), 25)


@query("der1_lifetimes", _LIFE)
def _(t: Tables) -> DataFrame:
    return _lives(t)


@query("der2_period_lengths", "SELECT period, lead(period) OVER (ORDER BY period) - period AS length FROM {period}")
def _(t: Tables) -> DataFrame:
    return D.period_lengths(t("period"))


@query("der3_active", _ACTIVE)
def _(t: Tables) -> DataFrame:
    return D.active(_lives(t), t("period"))


_SPAN = "SELECT period, length FROM (SELECT period, lead(period) OVER (ORDER BY period) - period AS length FROM {period}) WHERE length IS NOT NULL"


@query(
    "der4_retirements",
    f"""SELECT region, tech, vintage, lifetime, period, 'end' AS kind FROM ({_LIFE}) l, ({_SPAN}) s WHERE period <= vintage + lifetime AND vintage + lifetime < period + length
    UNION ALL SELECT region, tech, vintage, lifetime, period, 'early' FROM ({_LIFE}) l, ({_SPAN}) s WHERE vintage < period AND period + length <= vintage + lifetime AND tech LIKE 'Brand#2%'""",
)
def _(t: Tables) -> DataFrame:
    return D.retirements(_lives(t).withColumn("may_retire", F.col("tech").like("Brand#2%").cast("int")), t("period")).select("region", "tech", "vintage", "lifetime", "period", "kind")


@query("der5_life_fraction", f"SELECT region, tech, vintage, a.period, round(least(1.0, (vintage + lifetime - a.period) / length), 6) AS fraction FROM ({_ACTIVE}) a JOIN ({_SPAN}) s ON a.period = s.period")
def _(t: Tables) -> DataFrame:
    rows = D.active(_lives(t), t("period")).join(F.broadcast(D.period_lengths(t("period")).where("length is not null")), "period")
    return rows.select("region", "tech", "vintage", "period", F.round(D.life_fraction(F.col("vintage"), F.col("lifetime"), F.col("period"), F.col("length")), 6).alias("fraction"))


@query(
    "der6_slice_index",
    f"""WITH a AS (SELECT DISTINCT a.region, a.tech, a.vintage, period, input_comm, output_comm, annual, curtail, flex FROM ({_ACTIVE}) a JOIN (SELECT * FROM {{efficiency}}) e ON a.region = e.region AND a.tech = e.tech AND a.vintage = e.vintage JOIN (SELECT * FROM {{technology}}) k ON a.tech = k.tech),
    b AS (SELECT a.*, season, tod FROM a JOIN (SELECT period, season, tod FROM {{slices}}) s USING (period) WHERE annual = 0 UNION ALL SELECT a.*, NULL, NULL FROM a WHERE annual = 1)
    SELECT tech, period, kind, count(*) AS n, count(season) AS with_slice FROM (SELECT *, unnest(list_filter(['flow', CASE WHEN curtail = 1 THEN 'curtail' END, CASE WHEN flex = 1 THEN 'flex' END], lambda x: x IS NOT NULL)) AS kind FROM b) GROUP BY tech, period, kind""",
)
def _(t: Tables) -> DataFrame:
    rows = D.slice_index(D.active(_lives(t), t("period")), t("efficiency"), t("slices"), t("technology"))
    return rows.groupBy("tech", "period", "kind").agg(F.count("*").alias("n"), F.count("season").alias("with_slice"))


@query(
    "der7_resolve_factor",
    "SELECT p.region, p.period, p.tech, p.vintage, round(coalesce(f.cost, v.cost, 1.0), 6) AS factor FROM (SELECT DISTINCT region, period, tech, vintage FROM {net_capacity}) p LEFT JOIN (SELECT * FROM {cost_fixed}) f USING (region, period, tech, vintage) LEFT JOIN (SELECT tech, max(cost) AS cost FROM {cost_variable} WHERE tech LIKE 'Brand#1%' GROUP BY tech) v USING (tech)",
)
def _(t: Tables) -> DataFrame:
    keys = ["region", "period", "tech", "vintage"]
    own = t("cost_fixed").withColumnRenamed("cost", "factor")
    tech = t("cost_variable").where("tech like 'Brand#1%'").groupBy("tech").agg(F.max("cost").alias("factor"))
    return D.resolve_factor(t("net_capacity").select(*keys).distinct(), own, tech, keys, ["tech"]).select(*keys, *r6("factor"))


@query("der8_expand_groups", "SELECT r.region AS \"group\", m AS member, count(*) AS n FROM (SELECT region, unnest(CASE WHEN region LIKE '%-%' THEN string_split(replace(region, '-', '+'), '+') ELSE ['R0', 'R1', 'R2', 'R3', 'R4'] END) AS m FROM {net_capacity}) r GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    c = t("net_capacity")
    groups = c.withColumn("g", F.when(G.is_edge(), F.replace("region", F.lit("-"), F.lit("+"))).otherwise("global"))
    nodes = c.where(~G.is_edge()).select("region").distinct()
    return G.expand_groups(groups, nodes, region="g").groupBy(F.col("region").alias("group"), "member").agg(F.count("*").alias("n"))


@query("der9_season_fraction", "SELECT period, season, round(sum(segfrac), 9) AS fraction FROM {segfrac} GROUP BY period, season")
def _(t: Tables) -> DataFrame:
    return D.season_fraction(t("segfrac")).withColumn("fraction", F.round("fraction", 9))


@query(
    "der10_windows",
    """WITH p AS (SELECT y, row_number() OVER (ORDER BY y) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM {orders})),
    w AS (SELECT b.y AS base_year, s.y AS step_year, d.y AS last_demand_year, l.y AS last_year, b.k, l.k = l.n - 1 AS ends FROM p b JOIN p s ON s.k = least(b.k + 2, b.n - 1) JOIN p l ON l.k = least(b.k + 3, b.n - 1) JOIN p d ON d.k = l.k - 1 WHERE b.k % 2 = 0 AND b.k <= b.n - 2)
    SELECT base_year, step_year, last_demand_year, last_year FROM w WHERE k <= (SELECT min(k) FROM w WHERE ends)""",
)
def _(t: Tables) -> DataFrame:
    return D.windows(t("orders").select(F.year("o_orderdate").alias("period")), 3, 2)


@query(
    "der11_carry_forward",
    f"""SELECT region, tech, vintage, round(cost, 6) AS cost FROM {{cost_invest}} WHERE vintage >= 1995 OR (region, tech, vintage) IN (SELECT (region, tech, vintage) FROM {{net_capacity}} WHERE period = 1995 AND capacity > 100) OR tech IN (SELECT tech FROM {{technology}} WHERE unlim_cap = 1)""",
)
def _(t: Tables) -> DataFrame:
    alive = t("net_capacity").where("period = 1995 and capacity > 100")
    return D.carry_forward(t("cost_invest"), alive, t("technology"), 1995, 9999).select("region", "tech", "vintage", *r6("cost"))


@query(
    "der12_domains",
    f"""SELECT region, period, tech, count(*) AS n FROM ({_ACTIVE}) WHERE tech IN (SELECT tech FROM {{technology}} WHERE curtail = 1) GROUP BY region, period, tech""",
)
def _(t: Tables) -> DataFrame:
    rows = D.active(_lives(t), t("period")).join(F.broadcast(t("technology").where("curtail = 1").select("tech")), "tech", "left_semi")
    return rows.groupBy("region", "period", "tech").agg(F.count("*").alias("n"))


@query(
    "der12_constraint_domains",
    f"""WITH o AS (SELECT DISTINCT a.region, a.tech, a.vintage, a.period, annual, baseload, reserve, flex FROM ({_ACTIVE}) a JOIN (SELECT * FROM {{technology}}) k ON k.tech = a.tech), q AS (SELECT DISTINCT period, season, tod FROM {{slices}}),
    u AS (SELECT o.*, input_comm, output_comm FROM o JOIN (SELECT * FROM {{efficiency}}) e ON e.region = o.region AND e.tech = o.tech AND e.vintage = o.vintage),
    c AS (SELECT region, period, commodity, flag FROM (SELECT CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 1) ELSE region END AS region, period, input_comm AS commodity FROM u UNION SELECT CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 2) ELSE region END, period, output_comm FROM u) JOIN (SELECT name AS commodity, flag FROM {{commodity}}) USING (commodity)),
    r AS (SELECT 'capacity' AS rule, o.region, o.period, season FROM o JOIN q ON q.period = o.period WHERE annual = 0 UNION ALL SELECT 'annual capacity', region, period, NULL FROM o WHERE annual = 1 UNION ALL SELECT 'baseload', o.region, o.period, season FROM o JOIN q ON q.period = o.period WHERE baseload = 1
      UNION ALL SELECT 'storage', o.region, o.period, season FROM o JOIN q ON q.period = o.period WHERE reserve = 1 UNION ALL SELECT 'ramp', o.region, o.period, season FROM o JOIN q ON q.period = o.period WHERE flex = 1
      UNION ALL SELECT 'exchange', region, period, NULL FROM o WHERE region LIKE '%-%' AND (concat(split_part(region, '-', 2), '-', split_part(region, '-', 1)), tech, vintage, period) IN (SELECT (region, tech, vintage, period) FROM o)
      UNION ALL SELECT 'demand', region, period, NULL FROM (SELECT DISTINCT region, period, commodity FROM {{demand}}) UNION ALL SELECT 'balance', c.region, c.period, season FROM c JOIN q ON q.period = c.period WHERE flag <> 'a' UNION ALL SELECT 'annual balance', region, period, NULL FROM c WHERE flag = 'a'
      UNION ALL SELECT 'growth', region, period, NULL FROM (SELECT DISTINCT region, period, tech FROM o))
    SELECT rule, region, period, count(*) AS n, count(season) AS with_slice FROM r GROUP BY rule, region, period""",
)
def _(t: Tables) -> DataFrame:
    flags = t("technology").select("tech", "annual", "baseload", F.col("reserve").alias("storage"), F.col("flex").alias("ramp"))
    out = D.constraint_domains(D.active(_lives(t), t("period")), t("efficiency"), t("slices"), flags, t("demand"), t("commodity"))
    return out.groupBy("rule", "region", "period").agg(F.count("*").alias("n"), F.count("season").alias("with_slice"))


_KEYS = {"net_capacity": ["region", "period", "tech", "vintage"], "cost_invest": ["region", "tech", "vintage"], "demand": ["region", "period"]}


@query(
    "dia1_inventory",
    " UNION ALL ".join(
        f"SELECT '{n}' AS \"table\", CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS n_duplicates, count(DISTINCT CASE WHEN region NOT LIKE '%-%' THEN region END) AS n_nodes, count(DISTINCT CASE WHEN region LIKE '%-%' THEN region END) AS n_edges FROM (SELECT {', '.join(k)}, count(*) AS n FROM {{{n}}} GROUP BY ALL)"
        for n, k in _KEYS.items()
    ),
)
def _(t: Tables) -> DataFrame:
    return C.inventory({n: t(n) for n in _KEYS}, _KEYS)


@query("dia2_required", "SELECT region AS \"table\", CASE WHEN n IS NULL THEN 'missing' ELSE 'empty' END AS reason FROM (SELECT r.region, n FROM (SELECT DISTINCT region FROM {flow_out}) r LEFT JOIN (SELECT region, count(*) FILTER (capacity > 199) AS n FROM {net_capacity} WHERE region <> 'R0-R1' GROUP BY region) USING (region)) WHERE coalesce(n, 0) = 0")
def _(t: Tables) -> DataFrame:
    counts = t("net_capacity").where("region <> 'R0-R1'").groupBy(F.col("region").alias("table")).agg(F.count_if(F.col("capacity") > 199).alias("n_rows"))
    return C.required_tables(counts, t("flow_out").select(F.col("region").alias("table")).distinct())


@query("dia3_reference_sets", "SELECT DISTINCT 'region' AS kind, region AS member FROM {flow_out} UNION ALL SELECT DISTINCT 'tech', tech FROM {technology} UNION ALL SELECT DISTINCT 'period', CAST(period AS STRING) FROM {period}")
def _(t: Tables) -> DataFrame:
    return C.reference_sets(region=t("flow_out").select("region"), tech=t("technology").select("tech"), period=t("period").select("period"))


@query("dia4_orphans", "SELECT region AS value, count(*) AS n FROM {net_capacity} WHERE region LIKE '%R3%' OR region LIKE '%R4%' GROUP BY region")
def _(t: Tables) -> DataFrame:
    known = t.sql("SELECT DISTINCT region FROM {flow_out} WHERE region IN ('R0', 'R1', 'R2')")
    return C.orphans(t("net_capacity"), "region", known)


@query("dia5_shared_keys", "SELECT o_orderkey, o_custkey, o_orderpriority FROM {orders} WHERE (o_custkey, o_orderpriority) IN (SELECT (o_custkey, o_orderpriority) FROM {orders} GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1)")
def _(t: Tables) -> DataFrame:
    return C.shared_keys(t("orders"), ["o_custkey", "o_orderpriority"]).select("o_orderkey", "o_custkey", "o_orderpriority")


@query("dia6_only_in_one", "(SELECT region, tech, vintage, 'left' AS side FROM {cost_invest} EXCEPT SELECT region, tech, vintage, 'left' FROM {cost_fixed} WHERE period = 1995) UNION ALL (SELECT region, tech, vintage, 'right' FROM {cost_fixed} WHERE period = 1995 EXCEPT SELECT region, tech, vintage, 'right' FROM {cost_invest})")
def _(t: Tables) -> DataFrame:
    return C.only_in_one(t("cost_invest").select(*D.PROCESS), t("cost_fixed").where("period = 1995").select(*D.PROCESS))


_TEXTS = "SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 13 = 0 THEN 'x' WHEN c_custkey % 17 = 0 THEN 'Infinity' ELSE CAST(CAST(floor(c_acctbal) AS BIGINT) AS STRING) END AS v FROM {customer}"


@query(
    "dia7_numeric",
    f"""SELECT c_custkey, 'v' AS "column", v AS value, reason FROM (SELECT *, CASE WHEN v IS NULL THEN 'null' WHEN v = 'x' THEN 'not a number' WHEN v = 'Infinity' THEN 'not finite' WHEN CAST(v AS DOUBLE) <= 0 THEN 'not positive' END AS reason FROM ({_TEXTS})) WHERE reason IS NOT NULL""",
)
def _(t: Tables) -> DataFrame:
    return C.numeric_problems(t.sql(_TEXTS), {"v": "positive"}, ["c_custkey"])


@query(
    "dia8_readiness",
    """WITH f AS (SELECT tech, bool_or(region LIKE '%-%') AS x FROM {net_capacity} GROUP BY tech), s AS (SELECT tech, bool_and(coalesce(o.flag = 'd', false)) AND NOT bool_or(coalesce(i.flag = 's', false)) AS sink FROM {efficiency} LEFT JOIN (SELECT * FROM {commodity}) i ON i.name = input_comm LEFT JOIN (SELECT * FROM {commodity}) o ON o.name = output_comm GROUP BY tech),
    r AS (SELECT k.tech, k.tech IN (SELECT tech FROM {net_capacity} WHERE capacity > 199) AS in_capacity, k.tech IN (SELECT tech FROM {cost_fixed} WHERE vintage = 1990 AND cost > 0.07) AS in_fixed, k.tech IN (SELECT tech FROM {cost_invest} WHERE cost > 54) AS in_invest, coalesce(sink, false) AS sink FROM (SELECT tech FROM {technology}) k LEFT JOIN s USING (tech))
    SELECT *, concat_ws(',', CASE WHEN NOT in_fixed THEN 'fixed' END, CASE WHEN NOT in_invest THEN 'invest' END) AS missing_costs, in_capacity AND ((in_fixed AND in_invest) OR sink) AS ready FROM r""",
)
def _(t: Tables) -> DataFrame:
    tables = {"capacity": t("net_capacity").where("capacity > 199"), "fixed": t("cost_fixed").where("vintage = 1990 and cost > 0.07"), "invest": t("cost_invest").where("cost > 54")}
    return C.readiness(t("technology"), tables, t("efficiency"), t("commodity"), ["fixed", "invest"], ["capacity"])


@query("dia9_unit_inventory", "SELECT p_type, p_size % 3 AS unit, count(*) AS n, array_to_string(list_sort(list_distinct(list(p_name)))[1:5], ',') AS examples FROM {part} GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    return C.unit_inventory(t("part").withColumn("unit", F.col("p_size") % 3), ["p_type"], "unit", "p_name")


@query(
    "dia10_distance_summary",
    """SELECT jurisdiction, count(*) AS n, count(*) FILTER (value > 5000) AS n_fallback, round(count(*) FILTER (value > 5000) / count(*), 6) AS share, round(avg(value) FILTER (value > 5000), 6) AS mean, round(quantile_cont(value, 0.5) FILTER (value > 5000), 6) AS median, round(quantile_cont(value, 0.95) FILTER (value > 5000), 6) AS p95, round(max(value) FILTER (value > 5000), 6) AS max FROM {points} GROUP BY jurisdiction""",
)
def _(t: Tables) -> DataFrame:
    return C.distance_summary(t("points"), "jurisdiction", "value", F.col("value") > 5000).select("jurisdiction", "n", "n_fallback", *r6("share", "mean", "median", "p95", "max"))


@query("dia11_distance_verdicts", "SELECT point_id, CASE WHEN value > 250 AND jurisdiction <> 3 THEN 'error' WHEN value > 100 THEN 'warning' WHEN value > 25 THEN 'notice' END AS severity FROM {points} WHERE value > 25")
def _(t: Tables) -> DataFrame:
    return C.distance_verdicts(t("points"), "value", F.col("jurisdiction") == 3).select("point_id", "severity")


@query("dia12_metrics", "WITH p AS (SELECT count(*) AS n, max(value) AS hi, round(avg(value), 6) AS mean FROM {points}) SELECT 'n' AS metric, CAST(n AS DOUBLE) AS value FROM p UNION ALL SELECT 'hi', hi FROM p UNION ALL SELECT 'mean', mean FROM p")
def _(t: Tables) -> DataFrame:
    return C.metric_rows(t("points").agg(F.count("*").alias("n"), F.max("value").alias("hi"), F.round(F.avg("value"), 6).alias("mean")))


@query(
    "dia13_conservation",
    """SELECT count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, round(sum(a), 4) AS total_left, round(sum(b), 4) AS total_right, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND abs(sum(a) - sum(b)) <= 1e-6 AS passed FROM (SELECT region, sum(flow) AS a FROM {flow_in} GROUP BY region) FULL JOIN (SELECT region, sum(flow) AS b FROM {flow_out} WHERE region <> 'R0' GROUP BY region) USING (region)""",
)
def _(t: Tables) -> DataFrame:
    c = C.conservation(t("flow_in").withColumnRenamed("flow", "x"), t("flow_out").where("region <> 'R0'").withColumnRenamed("flow", "x"), "region", "x")
    return c.select("left_only", "right_only", F.round("total_left", 4).alias("total_left"), F.round("total_right", 4).alias("total_right"), "passed")


_VERDICTS = "SELECT concat('stage', CAST(c_nationkey % 4 AS STRING)) AS stage, CASE WHEN c_custkey % 5 = 0 THEN 'error' ELSE 'warning' END AS severity, c_custkey % 7 <> 0 AS ran, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal > 0 END AS passed FROM {customer}"


@query(
    "dia14_roll_up",
    f"""SELECT stage, n_checks, n_errors, n_warnings, CASE WHEN n_errors > 0 THEN 'error' WHEN n_warnings > 0 THEN 'warning' ELSE 'ok' END AS status FROM (SELECT stage, count(*) AS n_checks, count(*) FILTER (severity = 'error' AND (NOT ran OR NOT coalesce(passed, false))) AS n_errors, count(*) FILTER (severity <> 'error' AND ran AND NOT coalesce(passed, false)) AS n_warnings FROM ({_VERDICTS}) GROUP BY stage)""",
)
def _(t: Tables) -> DataFrame:
    return C.roll_up(t.sql(_VERDICTS))


@query("dia15_point_union", "SELECT concat('s', CAST(s_suppkey AS STRING)) AS id, s_name AS name, 'supply' AS layer FROM {supplier} UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END, 'demand' FROM {customer}")
def _(t: Tables) -> DataFrame:
    one = t("supplier").withColumn("key", F.concat(F.lit("s"), "s_suppkey"))
    two = t("customer").withColumns({"key": F.concat(F.lit("c"), "c_custkey"), "first": F.when(F.col("c_custkey") % 2 == 0, F.col("c_name"))})
    return C.point_union((one, "key", ["s_name"], "supply"), (two, "key", ["first", "c_mktsegment"], "demand"))


_UNITS = "SELECT p_brand AS tbl, p_type AS tech, concat('R', CAST(p_partkey % 7 AS STRING)) AS region, CASE p_size % 6 WHEN 0 THEN 'PJ' WHEN 1 THEN ' pj ' WHEN 2 THEN 'kt' WHEN 3 THEN '  ' WHEN 4 THEN NULL ELSE 'furlong' END AS units FROM {part}"
_KNOWN = "SELECT DISTINCT CASE WHEN r_regionkey % 2 = 0 THEN 'PJ' ELSE 'kt' END AS unit, CASE WHEN r_regionkey % 2 = 0 THEN 'energy' ELSE 'mass' END AS category FROM {region}"
_ALLOWED = "SELECT DISTINCT p_brand AS tbl, CASE WHEN length(p_brand) = 7 THEN 'energy' ELSE 'mass' END AS category FROM {part} WHERE p_brand <> 'Brand#3'"


@query(
    "dia9_unit_findings",
    f"""SELECT tbl AS "table", unit, n, category, compatible, regions, techs, finding, CASE WHEN finding IS NOT NULL THEN 'warning' END AS severity FROM (SELECT *, CASE WHEN category IN ('missing', 'unknown') THEN category WHEN NOT compatible THEN 'incompatible' END AS finding FROM (
      SELECT i.tbl, i.unit, n, CASE WHEN i.unit = '' THEN 'missing' ELSE coalesce(k.category, 'unknown') END AS category, CASE WHEN k.category IS NOT NULL AND i.tbl <> 'Brand#3' THEN k.category = CASE WHEN length(i.tbl) = 7 THEN 'energy' ELSE 'mass' END END AS compatible, regions, techs FROM (
        SELECT tbl, coalesce(trim(units), '') AS unit, count(*) AS n, array_to_string(list_sort(list_distinct(list(region)))[1:5], ';') AS regions, array_to_string(list_sort(list_distinct(list(tech)))[1:5], ';') AS techs FROM ({_UNITS}) GROUP BY 1, 2) i LEFT JOIN ({_KNOWN}) k ON lower(i.unit) = lower(k.unit)))""",
)
def _(t: Tables) -> DataFrame:
    return C.unit_findings(t.sql(_UNITS), t.sql(_KNOWN), t.sql(_ALLOWED).withColumnRenamed("tbl", "table"), "tbl", "units", "region", "tech")


@query(
    "dia16_price_checks",
    f"""WITH e AS ({_PROCESS}), f AS (SELECT region, tech, vintage, list_sort(list(DISTINCT period)) AS f FROM {{cost_fixed}} GROUP BY ALL), v AS (SELECT region, tech, vintage, list_sort(list(DISTINCT period)) AS v FROM {{cost_variable}} GROUP BY ALL), i AS (SELECT DISTINCT region, tech, vintage, true AS i FROM {{cost_invest}}), l AS (SELECT region, tech, vintage, list(DISTINCT period) AS life FROM ({_ACTIVE}) GROUP BY ALL),
    j AS (SELECT * FROM e LEFT JOIN f USING (region, tech, vintage) LEFT JOIN v USING (region, tech, vintage) LEFT JOIN i USING (region, tech, vintage) LEFT JOIN l USING (region, tech, vintage))
    SELECT region, tech, vintage, 'no cost' AS finding FROM j WHERE f IS NULL AND v IS NULL AND i IS NULL UNION ALL SELECT region, tech, vintage, 'no fixed or invest cost' FROM j WHERE f IS NULL AND i IS NULL AND vintage >= 1995 AND tech NOT IN (SELECT tech FROM {{technology}} WHERE unlim_cap = 1)
    UNION ALL SELECT region, tech, vintage, 'fixed cost of the build year only elsewhere' FROM j WHERE vintage >= 1995 AND (region, tech, vintage) NOT IN (SELECT (region, tech, vintage) FROM {{cost_fixed}} WHERE period = vintage) AND tech IN (SELECT tech FROM {{cost_fixed}} WHERE period = vintage)
    UNION ALL SELECT region, tech, vintage, 'invest cost only elsewhere' FROM j WHERE vintage >= 1995 AND i IS NULL AND tech IN (SELECT tech FROM {{cost_invest}})
    UNION ALL SELECT region, tech, vintage, 'fixed and variable periods differ' FROM j WHERE f <> v UNION ALL SELECT region, tech, vintage, 'fixed cost missing in the lifetime' FROM j WHERE len(list_filter(life, lambda x: NOT list_contains(f, x))) > 0
    UNION ALL SELECT region, tech, vintage, 'variable cost missing in the lifetime' FROM j WHERE len(list_filter(life, lambda x: NOT list_contains(v, x))) > 0""",
)
def _(t: Tables) -> DataFrame:
    return C.price_checks(t("efficiency"), t("cost_fixed"), t("cost_variable"), t("cost_invest"), D.active(_lives(t), t("period")), t("technology"), t("period").where("period >= 1995"))


@query("dia18_fractions", "SELECT period, count(n) AS n, 16 - count(n) AS missing, round(sum(f), 6) AS total, count(n) = 16 AND abs(sum(f) - 1) <= 0.001 AS passed FROM (SELECT period, n, n / sum(n) OVER (PARTITION BY period) AS f FROM {slices}) GROUP BY period")
def _(t: Tables) -> DataFrame:
    return C.fraction_check(t("segfrac")).withColumn("total", F.round("total", 6))


_DSD = "SELECT region, period, output_comm AS commodity, season, tod, 0.0625 AS dsd FROM {flow_out} WHERE output_comm LIKE '1%' AND season <> 'S4' GROUP BY region, period, output_comm, season, tod"


@query(
    "dia19_distributions",
    f"""WITH d AS ({_DSD}), s AS (SELECT * FROM {{demand}} JOIN (SELECT period, season, tod, segfrac FROM {{segfrac}}) USING (period)), n AS (SELECT DISTINCT region, period, commodity, true AS named FROM d)
    SELECT region, period, commodity, count(*) AS n, count(*) FILTER (p IS NULL) AS missing, round(sum(p), 6) AS total, bool_or(coalesce(named, false)) AS named, count(*) FILTER (p IS NULL) = 0 AND abs(coalesce(sum(p), 0) - 1) <= 0.001 AS passed
    FROM (SELECT s.*, named, CASE WHEN named THEN CAST(dsd AS DOUBLE) ELSE segfrac END AS p FROM s LEFT JOIN n USING (region, period, commodity) LEFT JOIN d USING (region, period, commodity, season, tod)) GROUP BY region, period, commodity""",
)
def _(t: Tables) -> DataFrame:
    d = t.sql(_DSD).withColumn("dsd", F.col("dsd").cast("double"))
    return C.fill_distribution(t("demand"), d, t("segfrac")).withColumn("total", F.round("total", 6))


@query(
    "dia20_index",
    """WITH e AS (SELECT * FROM {efficiency} WHERE tech <> 'Brand#3'), c AS (SELECT name FROM {commodity} WHERE name NOT LIKE 'S%'), u AS (SELECT DISTINCT input_comm AS name FROM e UNION SELECT output_comm FROM e)
    SELECT 'commodity' AS kind, name, 'left' AS side FROM (SELECT name FROM u EXCEPT SELECT name FROM c) UNION ALL SELECT 'commodity', name, 'right' FROM (SELECT name FROM c EXCEPT SELECT name FROM u)
    UNION ALL SELECT 'technology', tech, 'left' FROM (SELECT tech FROM e EXCEPT SELECT tech FROM {technology}) UNION ALL SELECT 'technology', tech, 'right' FROM (SELECT tech FROM {technology} EXCEPT SELECT tech FROM e)
    UNION ALL SELECT 'demand', commodity, 'left' FROM (SELECT DISTINCT commodity FROM {demand} EXCEPT SELECT output_comm FROM e WHERE output_comm <> '2-HIGH')""",
)
def _(t: Tables) -> DataFrame:
    e = t("efficiency").where("tech <> 'Brand#3'")
    made = e.where("output_comm <> '2-HIGH'")
    full = C.index_check(e, t("commodity").where("name not like 'S%'"), t("technology"), t("demand")).where("kind <> 'demand'")
    return full.unionByName(C.index_check(made, t("commodity"), t("technology"), t("demand")).where("kind = 'demand'"))


@query("dia21_partial", "SELECT region, tech, period, n, n_of AS \"of\" FROM (SELECT region, tech, period, count(DISTINCT (season, tod)) AS n FROM {flow_out} WHERE vintage = 1990 GROUP BY ALL) JOIN (SELECT period, count(*) AS n_of FROM {slices} GROUP BY period) USING (period) WHERE n < n_of")
def _(t: Tables) -> DataFrame:
    return C.partial_overrides(t("flow_out").where("vintage = 1990"), ["region", "tech"], t("slices")).select("region", "tech", "period", "n", "of")


@query("dia22_sequence", "SELECT period, season, tod, coalesce(lead(season) OVER w, first(season) OVER (PARTITION BY period ORDER BY season, tod)) AS next_season, coalesce(lead(tod) OVER w, first(tod) OVER (PARTITION BY period ORDER BY season, tod)) AS next_tod FROM {slices} WINDOW w AS (PARTITION BY period ORDER BY season, tod)")
def _(t: Tables) -> DataFrame:
    return C.slice_sequence(t("slices"))


_CURVE = "SELECT region, tech, vintage, CAST(vintage + 5 * (period - vintage) / 5 AS INT) AS period, greatest(0, 1 - (period - vintage) / 15e0 - CASE WHEN tech = 'Brand#1' THEN 0.1 ELSE 0.0 END) AS fraction FROM (SELECT DISTINCT region, tech, vintage, period FROM {net_capacity} WHERE period >= vintage)"


@query(
    "dia24_survival_findings",
    f"""WITH c AS ({_CURVE}), r AS (SELECT *, lag(fraction) OVER (PARTITION BY region, tech, vintage ORDER BY period) AS was FROM c), e AS (SELECT region, tech, vintage, min(period) AS a, arg_min(fraction, period) AS s, max(period) AS b, arg_max(fraction, period) AS z, count(*) FILTER (fraction > was + 0.0001) AS up FROM r GROUP BY ALL)
    SELECT region, tech, vintage, 'does not start at 1' AS finding FROM e WHERE a <> vintage OR abs(s - 1) > 0.0001 UNION ALL SELECT region, tech, vintage, 'rises' FROM e WHERE up > 0 UNION ALL SELECT region, tech, vintage, 'does not reach 0' FROM e WHERE abs(z) > 0.0001
    UNION ALL SELECT e.region, e.tech, e.vintage, 'lifetime differs' FROM e JOIN (SELECT * FROM {{lifetime_process}}) l ON e.region = l.region AND e.tech = l.tech AND e.vintage = l.vintage WHERE b <> e.vintage + lifetime""",
)
def _(t: Tables) -> DataFrame:
    return C.survival(t.sql(_CURVE), t("lifetime_process"))[1]


@query(
    "dia24_survival_filled",
    f"""WITH c AS ({_CURVE}), r AS (SELECT *, lag(fraction) OVER w AS was, lag(period) OVER w AS before FROM c WINDOW w AS (PARTITION BY region, tech, vintage ORDER BY period))
    SELECT region, tech, vintage, y AS period, round(CASE WHEN y = period THEN fraction ELSE was + (fraction - was) * (y - before) / (period - before) END, 6) AS fraction FROM (SELECT *, CAST(unnest(range(coalesce(before + 1, period), period + 1)) AS INT) AS y FROM r)""",
)
def _(t: Tables) -> DataFrame:
    return C.survival(t.sql(_CURVE), t("lifetime_process"))[0].withColumn("fraction", F.round("fraction", 6))


@query("dia25_names", "SELECT name, CASE WHEN name LIKE '%+%' THEN 'group' WHEN name LIKE '%-%' THEN CASE WHEN split_part(name, '-', 1) <> split_part(name, '-', 2) THEN 'edge' END WHEN name LIKE '% %' THEN NULL ELSE 'node' END AS kind FROM (SELECT region AS name FROM {flow_out} UNION SELECT concat(region, '+R9') FROM {flow_out} UNION SELECT concat('Q ', region) FROM {demand} UNION SELECT concat(region, '-', region) FROM {demand})")
def _(t: Tables) -> DataFrame:
    names = t.sql("SELECT region AS name FROM {flow_out} UNION SELECT concat(region, '+R9') FROM {flow_out} UNION SELECT concat('Q ', region) FROM {demand} UNION SELECT concat(region, '-', region) FROM {demand}")
    return names.select("name", C.region_kind("name").alias("kind"))


@query("dia26_flags", "SELECT tech, 'annual with baseload' AS finding FROM {technology} WHERE annual = 1 AND baseload = 1 UNION ALL SELECT tech, 'annual with curtail' FROM {technology} WHERE annual = 1 AND curtail = 1 UNION ALL SELECT tech, 'curtail with flex' FROM {technology} WHERE curtail = 1 AND flex = 1 UNION ALL SELECT tech, 'unlim_cap with reserve' FROM {technology} WHERE unlim_cap = 1 AND reserve = 1")
def _(t: Tables) -> DataFrame:
    return C.flag_conflicts(t("technology"), [("annual", "baseload"), ("annual", "curtail"), ("curtail", "flex"), ("unlim_cap", "reserve")])


@query("dia27_unknown_index", "SELECT 'tech' AS part, tech AS value, count(*) AS n FROM {net_capacity} WHERE tech LIKE 'Brand#1%' GROUP BY tech UNION ALL SELECT 'period', CAST(period AS STRING), count(*) FROM {net_capacity} WHERE period <> 1995 GROUP BY period")
def _(t: Tables) -> DataFrame:
    return C.unknown_index(t("net_capacity"), {"tech": t("technology").where("tech not like 'Brand#1%'").select("tech"), "period": t("period").where("period = 1995").select("period")})


#: Layers with what should be one value each: their system, which is, and their class, which is not.
_LAYER = "SELECT concat('EPSG:', CAST(3347 + 0 * p_size AS STRING)) AS crs, p_brand, CASE WHEN p_size > 0 THEN 'part' ELSE 'other' END AS kind FROM {part}"
_EXPECTED = {"crs": "EPSG:3347", "p_brand": "Brand#1", "kind": "other"}


@query("dia28_identity", " UNION ALL ".join(f"SELECT '{c}' AS field, array_to_string(list_sort(list(DISTINCT {c})), ',') AS found, list_sort(list(DISTINCT {c})) = ['{v}'] AS passed FROM ({_LAYER})" for c, v in _EXPECTED.items()))
def _(t: Tables) -> DataFrame:
    return C.identity(t.sql(_LAYER), _EXPECTED)


@query(
    "dia13_conserved",
    """SELECT count(*) FILTER (b IS NULL) AS left_only, count(*) FILTER (a IS NULL) AS right_only, round(sum(a), 4) AS total_left, round(sum(b), 4) AS total_right, count(*) FILTER (a IS NULL OR b IS NULL) = 0 AND abs(sum(a) - sum(b)) <= 1e-6 AS passed FROM (SELECT region, sum(flow) AS a FROM {flow_out} GROUP BY region) FULL JOIN (SELECT region, sum(quantity) AS b FROM {placed} GROUP BY region) USING (region)""",
)
def _(t: Tables) -> DataFrame:
    c = C.conservation(t("flow_out").withColumnRenamed("flow", "x"), t("placed").withColumnRenamed("quantity", "x"), "region", "x")
    return c.select("left_only", "right_only", F.round("total_left", 4).alias("total_left"), F.round("total_right", 4).alias("total_right"), "passed")


_TOPOLOGY = """WITH RECURSIVE c AS (SELECT * FROM {cells}), e AS (SELECT * FROM {edges} WHERE NOT (region_from = 'R1' AND region_to = 'R0')), r AS (SELECT edge_region, distance_km, direction IN ('up', 'down') AS connected FROM e), g AS (SELECT region_from AS a, region_to AS b FROM e UNION SELECT region_to, region_from FROM e),
    k AS (SELECT DISTINCT a AS id, a AS top FROM g UNION SELECT g.a, k.top FROM k JOIN g ON g.b = k.id),
    m AS (SELECT 'basemap_regions' AS metric, count(*)::DOUBLE AS value FROM c UNION ALL SELECT 'basemap_unique_regions', count(DISTINCT region) FROM c UNION ALL SELECT 'graph_nodes', count(*) FROM c UNION ALL SELECT 'graph_node_unique_regions', count(DISTINCT region) FROM c
      UNION ALL SELECT 'graph_edges', count(*) FROM e UNION ALL SELECT 'graph_edge_unique_regions', count(DISTINCT edge_region) FROM e UNION ALL SELECT 'graph_edge_distance_min', min(distance_km) FROM e UNION ALL SELECT 'graph_edge_distance_mean', avg(distance_km) FROM e UNION ALL SELECT 'graph_edge_distance_max', max(distance_km) FROM e
      UNION ALL SELECT 'road_connection_rows', count(*) FROM r UNION ALL SELECT 'road_connected_rows', count(*) FROM r WHERE connected UNION ALL SELECT 'road_edge_distance_min', min(distance_km) FROM r WHERE connected UNION ALL SELECT 'road_edge_distance_mean', avg(distance_km) FROM r WHERE connected UNION ALL SELECT 'road_edge_distance_max', max(distance_km) FROM r WHERE connected
      UNION ALL SELECT 'road_edge_geometries', 0 UNION ALL SELECT 'isolated_nodes', count(*) FROM c WHERE region NOT IN (SELECT a FROM g) UNION ALL SELECT 'one_way_edges', count(*) FROM e WHERE (region_to, region_from) NOT IN (SELECT (region_from, region_to) FROM e)
      UNION ALL SELECT 'linked_components', count(DISTINCT t) FROM (SELECT min(top) AS t FROM k GROUP BY id)),
    w AS (SELECT max(value) FILTER (metric = 'basemap_regions') AS a, max(value) FILTER (metric = 'graph_nodes') AS b, max(value) FILTER (metric = 'graph_node_unique_regions') AS u, max(value) FILTER (metric = 'graph_edges') AS d, max(value) FILTER (metric = 'road_connection_rows') AS e, max(value) FILTER (metric = 'road_connected_rows') AS f, max(value) FILTER (metric = 'road_edge_geometries') AS g FROM m)"""


def _topology(t: Tables) -> DataFrame:
    edges = t("edges").where("not (region_from = 'R1' and region_to = 'R0')")
    roads = edges.select("edge_region", "distance_km", F.col("direction").isin("up", "down").alias("connected"))
    return C.topology(t("cells"), t("cells"), edges, roads, t("segments").where("x0 is null"))


@query("dia12_topology", f"{_TOPOLOGY} SELECT metric, round(value, 6) AS value FROM m")
def _(t: Tables) -> DataFrame:
    return _topology(t).withColumn("value", F.round("value", 6))


@query(
    "dia12_verdicts",
    f"{_TOPOLOGY} SELECT 'basemap has regions' AS name, 'error' AS severity, a > 0 AS passed FROM w UNION ALL SELECT 'nodes are unique by region', 'error', b > 0 AND b = u FROM w UNION ALL SELECT 'graph has edges', 'error', d > 0 FROM w UNION ALL SELECT 'road connections have rows', 'error', e > 0 FROM w UNION ALL SELECT 'connected rows exist', 'warning', f > 0 FROM w UNION ALL SELECT 'road geometries exist', 'warning', g > 0 FROM w",
)
def _(t: Tables) -> DataFrame:
    return C.topology_verdicts(_topology(t))


@query("prj12_modes", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'truck' WHEN 2 THEN 'power_line' END AS mode FROM {part}")
def _(t: Tables) -> DataFrame:
    k = F.col("p_size") % 4
    named = F.when(k == 0, F.concat("p_brand", F.lit("_PIPE"))).when(k == 1, F.concat("p_brand", F.lit("_TRUCK"))).when(k == 2, "ELC_TRANS").otherwise(F.col("p_brand"))
    return t("part").select("p_partkey", P.transport_mode(named).alias("mode"))
