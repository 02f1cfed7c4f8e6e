"""Queries over solved results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import finance
from gridloom.operators import results as R
from gridloom.operators.joins import r6
from gridloom.plans.adapters import Tables
from gridloom.plans.catalog import query
from gridloom.session import materialize

_BALANCE = """
  SELECT scenario, period, region, commodity,
    sum(CASE WHEN part = 'production' THEN amount ELSE 0 END) AS production, sum(CASE WHEN part = 'imports' THEN amount ELSE 0 END) AS imports,
    sum(CASE WHEN part = 'consumption' THEN amount ELSE 0 END) AS consumption, sum(CASE WHEN part = 'exports' THEN amount ELSE 0 END) AS exports,
    sum(CASE WHEN part = 'demand' THEN amount ELSE 0 END) AS demand
  FROM (
    SELECT scenario, period, region, output_comm AS commodity, 'production' AS part, flow AS amount FROM {flow_out} WHERE region NOT LIKE '%-%'
    UNION ALL SELECT scenario, period, region, input_comm, 'consumption', flow FROM {flow_in} WHERE region NOT LIKE '%-%'
    UNION ALL SELECT scenario, period, split_part(region, '-', 2), output_comm, 'imports', flow FROM {flow_out} WHERE region LIKE '%-%'
    UNION ALL SELECT scenario, period, split_part(region, '-', 1), input_comm, 'exports', flow FROM {flow_in} WHERE region LIKE '%-%'
    UNION ALL SELECT s.scenario, d.period, d.region, d.commodity, 'demand', d.demand FROM {demand} d, (SELECT DISTINCT scenario FROM {flow_out}) s)
  GROUP BY scenario, period, region, commodity"""
_BALANCE = _BALANCE.replace("{demand} d", "(SELECT * FROM {demand}) d")


@query(
    "res16_node_balance",
    f"SELECT scenario, period, region, commodity, round(production, 6) AS production, round(imports, 6) AS imports, round(consumption, 6) AS consumption, round(exports, 6) AS exports, round(demand, 6) AS demand, round(production + imports - consumption - exports - demand, 6) AS residual FROM ({_BALANCE})",
)
def _(t: Tables) -> DataFrame:
    b = R.node_balance_of(t("flows"), t("demand"), t("scenarios"))
    return b.select("scenario", "period", "region", "commodity", *r6("production", "imports", "consumption", "exports", "demand", "residual"))


@query(
    "res17_balance_verdict",
    f"""SELECT scenario, period, region, commodity, flag, round(res, 6) AS residual, abs(res) > 1 AND abs(res) > 0.2 * greatest(abs(up), abs(down)) AS failed
    FROM (SELECT *, production + imports AS up, consumption + exports + demand AS down, production + imports - consumption - exports - demand AS res FROM ({_BALANCE})) b
      LEFT JOIN (SELECT name, flag FROM {{commodity}}) c ON b.commodity = c.name WHERE flag IS NULL OR flag NOT IN ('s', 'a')""",
)
def _(t: Tables) -> DataFrame:
    b = R.balance_verdict(R.node_balance_of(t("flows"), t("demand"), t("scenarios")), t("commodity"), ["s", "a"], 1.0, 0.2)
    return b.select("scenario", "period", "region", "commodity", "flag", *r6("residual"), "failed")


@query("res14_flow_summary", "SELECT scenario, region, period, input_comm, tech, vintage, output_comm, round(sum(flow), 6) AS flow FROM {flow_out} GROUP BY ALL HAVING abs(sum(flow)) >= 0.00001")
def _(t: Tables) -> DataFrame:
    return R.flow_summary(t("flow_out")).select(*R.LINK, *r6("flow"))


@query(
    "res15_process_balance",
    """SELECT scenario, region, period, input_comm, tech, vintage, round(i, 6) AS flow_in, round(o, 6) AS flow_out, round(i - o, 6) AS residual,
      abs(i - o) > CASE WHEN i > 0 THEN 0.025 * i ELSE 0.025 END AS failed
    FROM (SELECT scenario, region, period, input_comm, tech, vintage, sum(flow) AS i FROM {flow_in} GROUP BY ALL) JOIN
      (SELECT scenario, region, period, input_comm, tech, vintage, sum(flow) AS o FROM {flow_out} GROUP BY ALL) USING (scenario, region, period, input_comm, tech, vintage)""",
)
def _(t: Tables) -> DataFrame:
    return R.process_balance(t("flow_in"), t("flow_out"), tolerance=0.025).select(*R.LINK[:-1], *r6("flow_in", "flow_out", "residual"), "failed")


@query(
    "res18_edge_technologies",
    """SELECT tech, bool_or(s = 1) AS flow, bool_or(s = 2) AS capacity, bool_or(s = 3) AS invest FROM (
      SELECT tech, 1 AS s FROM {flow_out} WHERE region LIKE '%-%' AND flow > 0 UNION ALL SELECT tech, 2 FROM {net_capacity} WHERE region LIKE '%-%'
      UNION ALL SELECT tech, 3 FROM {cost_invest} WHERE region LIKE '%-%') GROUP BY tech""",
)
def _(t: Tables) -> DataFrame:
    return R.edge_technologies({"flow": t("flow_out").where("flow > 0"), "capacity": t("net_capacity"), "invest": t("cost_invest")})


@query("res19_edge_flows", "SELECT tech, count(*) AS n_rows, round(sum(flow), 6) AS flow FROM {flow_out} WHERE region LIKE '%-%' AND flow > 0 GROUP BY tech")
def _(t: Tables) -> DataFrame:
    return R.edge_flow_summary(t("flow_out")).select("tech", "n_rows", *r6("flow"))


@query(
    "res20_edge_flow_capacity",
    """SELECT scenario, region, period, tech, vintage, round(flow, 6) AS flow, round(capacity, 6) AS capacity, CASE WHEN coalesce(capacity, 0) <= 0 THEN 'no capacity' ELSE 'exceeds' END AS reason
    FROM (SELECT scenario, region, period, tech, vintage, sum(flow) AS flow FROM {flow_out} WHERE region LIKE '%-%' GROUP BY ALL HAVING sum(flow) > 0)
      LEFT JOIN (SELECT * FROM {net_capacity} WHERE capacity > 40) USING (scenario, region, period, tech, vintage) WHERE coalesce(capacity, 0) <= 0 OR flow > capacity""",
)
def _(t: Tables) -> DataFrame:
    return R.edge_flow_capacity(t("flow_out"), t("net_capacity").where("capacity > 40"), strict=True).select("scenario", "region", "period", "tech", "vintage", *r6("flow", "capacity"), "reason")


_COSTS = """SELECT scenario, region, period, tech, vintage, t AS cost_type, CASE WHEN t LIKE 'd_%' THEN 0.9 ELSE 1.0 END * sum(CASE WHEN t LIKE '%invest' THEN price / 1000 WHEN t LIKE '%fixed' THEN quantity * tax WHEN t LIKE '%var' THEN quantity * discount ELSE tax END) AS cost
  FROM {placed}, (SELECT 'd_invest' AS t UNION ALL SELECT 'd_fixed' UNION ALL SELECT 'd_var' UNION ALL SELECT 'invest' UNION ALL SELECT 'fixed' UNION ALL SELECT 'var') AS kinds
  GROUP BY scenario, region, period, tech, vintage, t"""


@query(
    "res13_cost_table",
    "SELECT scenario, region, period, tech, vintage, " + ", ".join(f"round(sum(CASE WHEN cost_type = '{c}' THEN cost ELSE 0 END), 6) AS {c}" for c in R.COSTS) + f" FROM ({_COSTS}) GROUP BY scenario, region, period, tech, vintage",
)
def _(t: Tables) -> DataFrame:
    return R.cost_table(t.sql(_COSTS)).select("scenario", "region", "period", "tech", "vintage", *r6(*R.COSTS))


@query(
    "res21_objective",
    f"""SELECT scenario, round(obj, 4) AS total_system_cost, round(d, 4) AS discounted, round(u, 4) AS raw, CASE WHEN abs(obj - d) <= greatest(1, 0.0001 * greatest(abs(obj), abs(d))) THEN 'discounted' WHEN abs(obj - u) <= greatest(1, 0.0001 * greatest(abs(obj), abs(u))) THEN 'raw' ELSE 'neither' END AS convention
    FROM (SELECT scenario, sum(CASE WHEN cost_type LIKE 'd_%' THEN cost ELSE 0 END) AS d, sum(CASE WHEN cost_type NOT LIKE 'd_%' THEN cost ELSE 0 END) AS u,
      sum(CASE WHEN scenario = 'A' AND cost_type LIKE 'd_%' THEN cost WHEN scenario = 'N' AND cost_type NOT LIKE 'd_%' THEN cost ELSE 0 END) AS obj FROM ({_COSTS}) GROUP BY scenario)""",
)
def _(t: Tables) -> DataFrame:
    costs = materialize(t.sql(_COSTS), "costs")
    met = (F.col("scenario") == "A") & F.col("cost_type").startswith("d_") | (F.col("scenario") == "N") & ~F.col("cost_type").startswith("d_")
    objective = costs.groupBy("scenario").agg(F.sum(F.when(met, F.col("cost")).otherwise(0.0)).alias("total_system_cost"))
    return R.reconcile_objective(objective, R.cost_table(costs)).select("scenario", *(F.round(c, 4).alias(c) for c in ("total_system_cost", "discounted", "raw")), "convention")


@query(
    "res22_largest_residuals",
    f"""SELECT scenario, period, region, commodity, round(residual, 6) AS residual FROM (SELECT *, production + imports - consumption - exports - demand AS residual FROM ({_BALANCE}))
    ORDER BY round(abs(residual), 6) DESC, scenario, period, region, commodity LIMIT 25""",
)
def _(t: Tables) -> DataFrame:
    b = R.node_balance_of(t("flows"), t("demand"), t("scenarios")).select("scenario", "period", "region", "commodity", *r6("residual"))
    return R.largest(b, "residual", 25, "scenario", "period", "region", "commodity")


@query("res23_injection", "SELECT scenario, period, region, output_comm AS commodity, round(sum(flow), 6) AS injected FROM {flow_out} WHERE tech LIKE 'Brand#1%' GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return R.injection(t("flow_out"), "^Brand#1").select("scenario", "period", "region", "commodity", *r6("injected"))


@query(
    "res24_period_pivot",
    "SELECT tech, " + ", ".join(f"round(coalesce(sum(CASE WHEN period = {p} THEN capacity END), 0), 6) AS p{p}" for p in (1990, 1995, 2000)) + " FROM (SELECT tech FROM {technology} WHERE sector = 'power') LEFT JOIN {net_capacity} USING (tech) GROUP BY tech",
)
def _(t: Tables) -> DataFrame:
    p = R.period_pivot(t("net_capacity"), t("technology"), "power", "capacity", [1990, 1995, 2000])
    return p.select("tech", *(F.round(str(y), 6).alias(f"p{y}") for y in (1990, 1995, 2000)))


@query(
    "res25_long_format",
    """SELECT scenario, region, period, CASE WHEN tech IS NULL THEN concat('Capacity|', sector) ELSE concat('Capacity|', sector, '|', tech) END AS variable, round(sum(capacity), 6) AS value
    FROM {net_capacity} JOIN (SELECT tech, sector FROM {technology}) USING (tech) GROUP BY GROUPING SETS ((scenario, region, period, sector, tech), (scenario, region, period, sector))""",
)
def _(t: Tables) -> DataFrame:
    return R.long_format(t("net_capacity"), t("technology"), "Capacity", "capacity").withColumn("value", F.round("value", 6))


@query("res26_capacity_by_period", "SELECT scenario, tech, period, round(sum(CASE WHEN region LIKE '%-%' THEN capacity / 2 ELSE capacity END), 6) AS capacity FROM {net_capacity} GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return R.capacity_by_period(t("net_capacity")).withColumn("capacity", F.round("capacity", 6))


@query(
    "res27_process_flows",
    """SELECT scenario, period, tech, round(coalesce(i, 0), 6) AS flow_in, round(coalesce(o, 0), 6) AS flow_out, round(coalesce(c, 0), 6) AS capacity FROM (SELECT scenario, period, tech, sum(flow) AS i FROM {flow_in} GROUP BY ALL)
    FULL JOIN (SELECT scenario, period, tech, sum(flow) AS o FROM {flow_out} GROUP BY ALL) USING (scenario, period, tech) FULL JOIN (SELECT scenario, period, tech, sum(capacity) AS c FROM {net_capacity} GROUP BY ALL) USING (scenario, period, tech)""",
)
def _(t: Tables) -> DataFrame:
    return R.process_flows(t("flow_in"), t("flow_out"), t("net_capacity")).select("scenario", "period", "tech", *r6("flow_in", "flow_out", "capacity"))


@query(
    "res11_emissions",
    """SELECT scenario, region, period, emis_comm, tech, vintage, round(sum(flow * activity), 6) AS emission FROM {flow_out} JOIN {emission_activity} USING (region, input_comm, tech, vintage, output_comm) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return R.flow_emissions(t("flow_out"), t("emission_activity")).withColumn("emission", F.round("emission", 6))


@query("res28_commodities", "SELECT DISTINCT tech, input_comm, output_comm FROM {flow_out} WHERE region = 'R1' AND period = 1995")
def _(t: Tables) -> DataFrame:
    return R.commodities_where(t("efficiency"), t("flow_out"), region="R1", period=1995)


_PLACES = "SELECT concat('R', CAST(jurisdiction % 5 AS STRING)) AS region, avg(lon) AS x, avg(lat) AS y FROM {points} GROUP BY 1"


@query(
    "res29_map_flows",
    f"""SELECT scenario, f.region, period, tech, round(flow, 6) AS flow, round(a.x, 6) AS x_from, round(a.y, 6) AS y_from, round(b.x, 6) AS x_to, round(b.y, 6) AS y_to
    FROM (SELECT scenario, region, period, tech, sum(flow) AS flow FROM {{flow_out}} WHERE region LIKE '%-%' GROUP BY ALL) f JOIN ({_PLACES}) a ON a.region = split_part(f.region, '-', 1) JOIN ({_PLACES}) b ON b.region = split_part(f.region, '-', 2)""",
)
def _(t: Tables) -> DataFrame:
    m = R.map_flows(t("flow_out"), t.sql(_PLACES))
    return m.select("scenario", "region", "period", "tech", *r6("flow", "x_from", "y_from", "x_to", "y_to"))


@query(
    "res30_sqrt_scaling",
    """SELECT region, round(CASE WHEN hi > lo THEN 1 + 7 * (sqrt(flow) - lo) / (hi - lo) ELSE 4 END, 6) AS width FROM (SELECT *, sqrt(min(flow) OVER ()) AS lo, sqrt(max(flow) OVER ()) AS hi FROM (SELECT region, sum(flow) AS flow FROM {flow_out} GROUP BY region))""",
)
def _(t: Tables) -> DataFrame:
    return R.sqrt_scaled(t("flow_out").groupBy("region").agg(F.sum("flow").alias("flow")), "flow", 1.0, 8.0).select("region", *r6("width"))


@query(
    "res31_grid_spacing",
    """SELECT round(least((SELECT median(g) FROM (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT floor(lon / 2) * 2 AS x FROM {points})) WHERE g > 0),
      (SELECT median(g) FROM (SELECT x - lag(x) OVER (ORDER BY x) AS g FROM (SELECT DISTINCT floor(lat / 3) * 3 AS x FROM {points})) WHERE g > 0)), 6) AS spacing""",
)
def _(t: Tables) -> DataFrame:
    p = t("points").select((F.floor(F.col("lon") / 2) * 2).cast("double").alias("lon"), (F.floor(F.col("lat") / 3) * 3).cast("double").alias("lat"))
    return R.grid_spacing(p).select(*r6("spacing"))


@query(
    "res32_compare",
    """SELECT region, tech, round(a, 6) AS base, round(b, 6) AS other, round(coalesce(b, 0) - coalesce(a, 0), 6) AS difference, round(CASE WHEN a <> 0 AND b <> 0 THEN 100 * (b - a) / a END, 6) AS change_pct
    FROM (SELECT region, tech, sum(flow) FILTER (scenario = 'A') AS a, sum(flow) FILTER (scenario = 'R') AS b FROM {flow_out} WHERE scenario IN ('A', 'R') GROUP BY ALL)""",
)
def _(t: Tables) -> DataFrame:
    return R.compare_scenarios(t("flow_out"), ["region", "tech"], "flow", "A", "R").select("region", "tech", *r6("base", "other", "difference", "change_pct"))


@query(
    "res33_concentration",
    """SELECT tech, count(*) AS n, round(sum(capacity), 6) AS total, count(*) FILTER (s <= 0.05) AS n_smallest FROM (SELECT tech, capacity, sum(capacity) OVER (PARTITION BY tech ORDER BY capacity, scenario, region, period, vintage ROWS UNBOUNDED PRECEDING) / sum(capacity) OVER (PARTITION BY tech) AS s FROM {net_capacity}) GROUP BY tech""",
)
def _(t: Tables) -> DataFrame:
    return R.concentration(t("net_capacity"), ["tech"], "capacity", ties=("scenario", "region", "period", "vintage")).select("tech", "n", *r6("total"), "n_smallest")


@query(
    "res34_histogram",
    """SELECT CAST(least(floor((v - lo) / (hi - lo) * n), n - 1) AS INT) AS bin, count(*) AS n FROM (SELECT v, min(v) OVER () AS lo, max(v) OVER () AS hi, ceil(sqrt(count(*) OVER ())) AS n FROM (SELECT round(sum(price), 2) AS v FROM {placed} GROUP BY region, tech)) GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return R.objective_histogram(t("placed").groupBy("region", "tech").agg(F.round(F.sum("price"), 2).alias("v")), "v")


@query(
    "res12_exchange_costs",
    """WITH c AS (SELECT region AS link, period, tech, vintage, cost FROM {cost_fixed} WHERE region LIKE '%-%'),
    f AS (SELECT region AS link, period, tech, vintage, sum(flow) AS flow FROM {flow_out} WHERE region LIKE '%-%' GROUP BY ALL),
    m AS (SELECT c.*, concat(split_part(c.link, '-', 2), '-', split_part(c.link, '-', 1)) AS back FROM c),
    s AS (SELECT m.*, CASE WHEN o.link IS NOT NULL THEN 1.0 WHEN coalesce(f.flow, 0) + coalesce(g.flow, 0) > 0 THEN coalesce(f.flow, 0) / (coalesce(f.flow, 0) + coalesce(g.flow, 0)) ELSE 0.5 END AS share
      FROM m LEFT JOIN c o ON o.link = m.back AND o.period = m.period AND o.tech = m.tech AND o.vintage = m.vintage LEFT JOIN f ON f.link = m.link AND f.period = m.period AND f.tech = m.tech AND f.vintage = m.vintage
      LEFT JOIN f g ON g.link = m.back AND g.period = m.period AND g.tech = m.tech AND g.vintage = m.vintage)
    SELECT region, period, tech, vintage, round(sum(cost), 6) AS cost FROM (SELECT split_part(link, '-', 2) AS region, period, tech, vintage, cost * share AS cost FROM s UNION ALL SELECT split_part(link, '-', 1), period, tech, vintage, cost * (1 - share) FROM s) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    costs = t("cost_fixed").where("region like '%-%'").withColumnRenamed("region", "link")
    return R.exchange_costs(costs, t("flow_out")).withColumn("cost", F.round("cost", 6))


@query(
    "res10_one_direction",
    """SELECT c.region, c.tech, c.vintage, round(c.cost, 6) AS cost, c.region NOT LIKE '%-%' OR b.region IS NULL OR c.region < b.region AS counted FROM (SELECT * FROM {cost_invest}) c
    LEFT JOIN (SELECT * FROM {cost_invest}) b ON c.region LIKE '%-%' AND b.region = concat(split_part(c.region, '-', 2), '-', split_part(c.region, '-', 1)) AND b.tech = c.tech AND b.vintage = c.vintage""",
)
def _(t: Tables) -> DataFrame:
    return R.one_direction(t("cost_invest")).select("region", "tech", "vintage", *r6("cost"), "counted")


@query(
    "res3_spread_annual",
    """WITH d AS (SELECT period, region, output_comm AS commodity, season, tod, sum(flow) / sum(sum(flow)) OVER (PARTITION BY period, region, output_comm) AS dsd FROM {flow_out} WHERE output_comm LIKE '1%' GROUP BY period, region, output_comm, season, tod)
    SELECT region, period, commodity, season, tod, round(demand * p, 6) AS flow FROM (SELECT a.*, d.season, d.tod, dsd AS p FROM (SELECT * FROM {demand}) a JOIN d USING (region, period, commodity)
      UNION ALL SELECT a.*, s.season, s.tod, segfrac FROM (SELECT * FROM {demand}) a JOIN (SELECT * FROM {segfrac}) s USING (period) WHERE (region, period, commodity) NOT IN (SELECT (region, period, commodity) FROM d))""",
)
def _(t: Tables) -> DataFrame:
    d = t.sql("SELECT period, region, output_comm AS commodity, season, tod, sum(flow) / sum(sum(flow)) OVER (PARTITION BY period, region, output_comm) AS dsd FROM {flow_out} WHERE output_comm LIKE '1%' GROUP BY period, region, output_comm, season, tod")
    d, demand = materialize(d, "shares"), materialize(t("demand"), "demand")
    return R.spread_annual(demand.withColumnRenamed("demand", "flow"), d, t("segfrac")).withColumn("flow", F.round("flow", 6))


@query(
    "res36_series",
    """SELECT category, period, round(coalesce(v, 0), 6) AS value FROM (SELECT category, period FROM (SELECT DISTINCT category FROM (SELECT coalesce(c, tech) AS category FROM (SELECT tech, CASE WHEN sector = 'industry' THEN '' WHEN sector = 'power' THEN 'P' END AS c FROM {technology}) JOIN (SELECT DISTINCT tech FROM {net_capacity}) USING (tech)) WHERE category <> ''), {period})
    LEFT JOIN (SELECT coalesce(c, tech) AS category, period, sum(capacity) AS v FROM {net_capacity} JOIN (SELECT tech, CASE WHEN sector = 'industry' THEN '' WHEN sector = 'power' THEN 'P' END AS c FROM {technology}) USING (tech) GROUP BY 1, 2) USING (category, period)""",
)
def _(t: Tables) -> DataFrame:
    c = t("technology").select("tech", F.when(F.col("sector") == "industry", "").when(F.col("sector") == "power", "P").alias("category"))
    return R.series(t("net_capacity"), c, t("period"), "capacity").withColumn("value", F.round("value", 6))


@query(
    "res38_diagram",
    """SELECT scenario, period, source, target, kind, round(sum(v), 6) AS value FROM (SELECT scenario, period, input_comm AS source, tech AS target, 'input' AS kind, flow AS v FROM {flow_in}
    UNION ALL SELECT scenario, period, tech, output_comm, 'output', flow FROM {flow_out} UNION ALL SELECT scenario, period, tech, NULL, 'process', capacity FROM {net_capacity}) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    return R.diagram(t("flow_in"), t("flow_out"), t("net_capacity")).withColumn("value", F.round("value", 6))


@query("res37_period_totals", f"SELECT scenario, period, round(sum(cost), 4) AS cost FROM ({_COSTS}) WHERE cost_type LIKE 'd_%' GROUP BY GROUPING SETS ((scenario, period), (scenario))")
def _(t: Tables) -> DataFrame:
    return R.period_totals(t.sql(_COSTS).where("cost_type like 'd_%'")).withColumn("cost", F.round("cost", 4))


@query(
    "res6_annuities",
    """SELECT r, n, round(CASE WHEN r = 0 THEN n ELSE (1 - pow(1 + r, -n)) / r END, 9) AS p_a, round(CASE WHEN r = 0 THEN 1.0 / n ELSE r / (1 - pow(1 + r, -n)) END, 9) AS a_p, round(pow(1 + r, -n), 9) AS p_f FROM (SELECT DISTINCT discount AS r, CAST(quantity AS INT) AS n FROM {placed} WHERE quantity >= 1)""",
)
def _(t: Tables) -> DataFrame:
    x = t("placed").where("quantity >= 1").select(F.col("discount").alias("r"), F.col("quantity").cast("int").alias("n")).distinct()
    r, n = F.col("r"), F.col("n")
    return x.select("r", "n", *(F.round(f(r, n), 9).alias(c) for f, c in ((finance.pv_of_annuity, "p_a"), (finance.annuity_of_pv, "a_p"), (finance.pv_of_future, "p_f"))))


_LOAN = """SELECT scenario, region, tech, vintage, capacity, max(cost) AS cost, 10 + vintage % 3 AS loan_life, 0.01 * (vintage % 4) AS loan_rate, 15 + vintage % 7 AS life
  FROM {built_capacity} JOIN {cost_invest} USING (region, tech, vintage) GROUP BY scenario, region, tech, vintage, capacity"""


@query(
    "res7_loan_cost",
    f"""SELECT scenario, region, tech, vintage, round(a * (1 - pow(1.05, -loan_life)) / 0.05 * 0.05 / (1 - pow(1.05, -life)) * (1 - pow(1.05, -least(life, 2005 - vintage))) / 0.05 * pow(1.05, -(vintage - 1990)), 6) AS discounted, round(a * loan_life / life * least(life, 2005 - vintage), 6) AS undiscounted
    FROM (SELECT *, capacity * cost * CASE WHEN loan_rate = 0 THEN 1.0 / loan_life ELSE loan_rate / (1 - pow(1 + loan_rate, -loan_life)) END AS a FROM ({_LOAN}))""",
)
def _(t: Tables) -> DataFrame:
    c = F.col
    d, u = finance.loan_cost(c("capacity"), c("cost"), c("loan_rate").cast("double"), c("loan_life"), F.lit(0.05), c("life"), F.lit(1990), F.lit(2005), c("vintage"))
    return t.sql(_LOAN).select("scenario", "region", "tech", "vintage", F.round(d, 6).alias("discounted"), F.round(u, 6).alias("undiscounted"))


@query(
    "res9_fixed_cost",
    """SELECT scenario, region, period, tech, vintage, round(capacity * cost * (1 - pow(1.04, -5)) / 0.04 * pow(1.04, -(period - 1990)), 6) AS discounted, round(capacity * cost * 5, 6) AS undiscounted FROM {net_capacity} JOIN {cost_fixed} USING (region, period, tech, vintage)""",
)
def _(t: Tables) -> DataFrame:
    d, u = finance.yearly_cost(F.col("capacity"), F.col("cost"), F.lit(0.04), F.lit(5), F.lit(1990), F.col("period"))
    return t("net_capacity").join(t("cost_fixed"), ["region", "period", "tech", "vintage"]).select("scenario", "region", "period", "tech", "vintage", F.round(d, 6).alias("discounted"), F.round(u, 6).alias("undiscounted"))
