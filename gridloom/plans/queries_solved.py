"""Queries that extract results from solved variables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import checks as C
from gridloom.operators import derive as D
from gridloom.operators import results as R
from gridloom.operators.joins import r6
from gridloom.plans import queries_model as M
from gridloom.plans.adapters import Tables
from gridloom.plans.catalog import query

_EARLY = "SELECT scenario, region, tech, vintage, period, capacity / 16 AS capacity FROM {net_capacity} WHERE period > vintage AND tech LIKE 'Brand#2%'"
_ENDS = f"SELECT region, tech, vintage, period FROM ({M._LIFE}) l, ({M._SPAN}) s WHERE period <= vintage + lifetime AND vintage + lifetime < period + length"


@query(
    "res1_capacity_results",
    f"""SELECT scenario, region, tech, vintage, vintage AS period, 'built' AS kind, round(capacity, 6) AS capacity FROM {{built_capacity}} UNION ALL SELECT scenario, region, tech, vintage, period, 'early', round(capacity, 6) FROM ({_EARLY})
    UNION ALL SELECT b.scenario, b.region, b.tech, b.vintage, e.period, 'end', round(b.capacity - coalesce(g, 0), 6) FROM (SELECT * FROM {{built_capacity}}) b JOIN ({_ENDS}) e ON e.region = b.region AND e.tech = b.tech AND e.vintage = b.vintage
    LEFT JOIN (SELECT scenario, region, tech, vintage, sum(capacity) AS g FROM ({_EARLY}) GROUP BY ALL) x ON x.scenario = b.scenario AND x.region = b.region AND x.tech = b.tech AND x.vintage = b.vintage""",
)
def _(t: Tables) -> DataFrame:
    ends = D.retirements(M._lives(t).withColumn("may_retire", F.lit(0)), t("period"))
    return R.capacity_results(t("built_capacity"), t.sql(_EARLY), ends).withColumn("capacity", F.round("capacity", 6))


@query(
    "res2_flow_results",
    """WITH f AS (SELECT * FROM {flow_out}), e AS (SELECT region, input_comm, tech, vintage, output_comm, efficiency FROM {efficiency}), x AS (SELECT *, flow / 10 AS q FROM f WHERE tech IN (SELECT tech FROM {technology} WHERE flex = 1)), c AS (SELECT *, flow / 20 AS q FROM f WHERE tech IN (SELECT tech FROM {technology} WHERE curtail = 1)),
    n AS (SELECT f.*, flow / efficiency AS i FROM f JOIN e USING (region, input_comm, tech, vintage, output_comm) WHERE tech <> 'Brand#7'),
    r AS (SELECT scenario, region, period, tech, 'out' AS kind, flow AS v FROM f UNION ALL SELECT scenario, region, period, tech, 'out', -q FROM x UNION ALL SELECT scenario, region, period, tech, 'flex', q FROM x UNION ALL SELECT scenario, region, period, tech, 'curtail', q FROM c UNION ALL SELECT scenario, region, period, tech, 'in', i FROM n UNION ALL SELECT scenario, region, period, tech, 'lost', i - flow FROM n)
    SELECT scenario, region, period, tech, kind, round(sum(v), 4) AS flow FROM r GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    f, tech = t("flow_out"), t("technology")
    part = lambda flag, k: f.join(F.broadcast(tech.where(f"{flag} = 1").select("tech")), "tech", "left_semi").withColumn("flow", F.col("flow") / k)
    out = R.flow_results(f, part("curtail", 20), part("flex", 10), t("efficiency"), tech.where("tech = 'Brand#7'"), epsilon=0.0)
    return out.groupBy("scenario", "region", "period", "tech", "kind").agg(F.round(F.sum("flow"), 4).alias("flow"))


_PER = "SELECT region, tech, vintage, input_comm AS commodity, efficiency AS amount FROM {efficiency} WHERE output_comm LIKE '1%' AND region NOT LIKE '%-%'"


@query(
    "res4_material_flows",
    f"""SELECT scenario, region, period, season, tod, commodity, kind, round(sum(capacity * amount / length * segfrac), 6) AS flow FROM (SELECT scenario, region, tech, vintage, vintage AS period, capacity, 'construction' AS kind FROM {{built_capacity}} UNION ALL SELECT scenario, region, tech, vintage, period, capacity, 'end of life' FROM ({_EARLY})) c
    JOIN ({_PER}) p USING (region, tech, vintage) JOIN ({M._SPAN}) s USING (period) JOIN (SELECT period, season, tod, segfrac FROM {{segfrac}}) g USING (period) GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    built, per = t("built_capacity").withColumn("period", F.col("vintage")), t.sql(_PER)
    return R.material_flows(built, t.sql(_EARLY).select(*built.columns), per, per, D.period_lengths(t("period")), t("segfrac")).withColumn("flow", F.round("flow", 6))


_LEVEL = "SELECT scenario, region, period, season, tod, tech, vintage, sum(flow) AS level FROM {flow_out} WHERE tech = 'Brand#7' GROUP BY scenario, region, period, season, tod, tech, vintage"


@query("res5_storage_levels", f"SELECT scenario, region, period, season, tod, tech, vintage, round(level / (fraction * 365) + capacity, 6) AS level FROM ({_LEVEL}) JOIN (SELECT period, season, sum(segfrac) AS fraction FROM {{segfrac}} GROUP BY ALL) USING (period, season) JOIN {{net_capacity}} USING (scenario, region, period, tech, vintage)")
def _(t: Tables) -> DataFrame:
    seasons = t.sql("SELECT DISTINCT season FROM {flow_out}")
    base = t("net_capacity").where("tech = 'Brand#7'").withColumnRenamed("capacity", "base").crossJoin(F.broadcast(seasons))
    return R.scaled_levels(t.sql(_LEVEL), D.season_fraction(t("segfrac")), 365.0, base).select("scenario", "region", "period", "season", "tod", "tech", "vintage", *r6("level"))


_LOANS = "SELECT scenario, region, tech, vintage, capacity * cost * 0.1e0 AS annuity, capacity * cost * 0.8e0 AS at_build, 12 AS loan_life FROM {built_capacity} JOIN {cost_invest} USING (region, tech, vintage)"
_YEARS = "SELECT region, tech, vintage, CAST(vintage + 2 * k AS INT) AS year, 1 - k / 8e0 AS fraction FROM (SELECT DISTINCT region, tech, vintage FROM {cost_invest}), (SELECT DISTINCT CAST(n_nationkey % 8 AS INT) AS k FROM {nation}) AS ks"


@query(
    "res8_survival_loans",
    f"""SELECT scenario, region, tech, vintage, round(at_build * sum(CASE WHEN year < 2000 THEN fraction * pow(1.05, -(year - vintage + 1)) ELSE 0 END) / sum(fraction * pow(1.05, -(year - vintage + 1))) * pow(1.05, -(vintage - 1990)), 6) AS discounted, round(annuity * loan_life * sum(CASE WHEN year < 2000 THEN fraction ELSE 0 END) / sum(fraction), 6) AS undiscounted
    FROM ({_LOANS}) JOIN ({_YEARS}) USING (region, tech, vintage) GROUP BY scenario, region, tech, vintage, annuity, at_build, loan_life""",
)
def _(t: Tables) -> DataFrame:
    return R.survival_loan_cost(t.sql(_LOANS), t.sql(_YEARS), 0.05, 1990, 2000).select("scenario", "region", "tech", "vintage", *r6("discounted", "undiscounted"))


@query("res35_storage_fraction", f"SELECT scenario, region, period, season, tod, tech, vintage, round(level, 6) AS level, round(0.5 * capacity * 4 / 8, 6) AS wanted, abs(level - 0.5 * capacity * 4 / 8) > 1e-6 * greatest(1, 0.5 * capacity * 4 / 8) AS broken FROM ({_LEVEL}) JOIN {{net_capacity}} USING (scenario, region, period, tech, vintage)")
def _(t: Tables) -> DataFrame:
    levels = t.sql(_LEVEL)
    return R.storage_fraction(levels, levels.drop("level").withColumn("fraction", F.lit(0.5)), t("net_capacity"), 4.0, 1 / 8).select("scenario", "region", "period", "season", "tod", "tech", "vintage", *r6("level", "wanted"), "broken")


@query(
    "dia17_uncapped",
    f"""WITH k AS (SELECT tech FROM {{technology}} WHERE unlim_cap = 1) SELECT DISTINCT region, tech, vintage, 'fixed cost' AS finding FROM {{cost_fixed}} WHERE tech IN (SELECT tech FROM k) UNION ALL SELECT DISTINCT region, tech, vintage, 'invest cost' FROM {{cost_invest}} WHERE tech IN (SELECT tech FROM k) UNION ALL SELECT DISTINCT region, tech, vintage, 'existing capacity' FROM {{built_capacity}} WHERE vintage = 1990 AND tech IN (SELECT tech FROM k)
    UNION ALL SELECT DISTINCT a.region, a.tech, a.vintage, 'variable cost missing in the lifetime' FROM ({M._ACTIVE}) a LEFT JOIN (SELECT region, tech, vintage, period FROM {{cost_variable}}) v ON v.region = a.region AND v.tech = a.tech AND v.vintage = a.vintage AND v.period = a.period
      WHERE v.period IS NULL AND a.tech IN (SELECT tech FROM k) AND (a.region, a.tech, a.vintage) IN (SELECT (region, tech, vintage) FROM {{cost_variable}})""",
)
def _(t: Tables) -> DataFrame:
    return C.uncapped_findings(t("technology"), t("cost_fixed"), t("cost_invest"), t("built_capacity").where("vintage = 1990"), t("cost_variable"), D.active(M._lives(t), t("period")))


_DAYS = "SELECT period, season, CAST(n AS INT) AS seq, CASE WHEN season = 'S1' THEN 40e0 + n ELSE 45.625e0 END AS num_days FROM (SELECT period, season, row_number() OVER (PARTITION BY period ORDER BY season, tod) AS n FROM {slices} WHERE season <> 'S4' AND tod < 'T2')"


@query(
    "dia23_seasons",
    f"""SELECT period, season, CASE WHEN n IS NULL THEN 'missing' ELSE 'days differ from the fraction' END AS finding FROM (SELECT period, season, sum(segfrac) AS f FROM {{segfrac}} GROUP BY ALL) LEFT JOIN (SELECT period, season, sum(num_days) AS n FROM ({_DAYS}) GROUP BY ALL) USING (period, season) WHERE n IS NULL OR abs(n / 365 - f) > 0.01
    UNION ALL SELECT DISTINCT period, season, 'consecutive days differ' FROM (SELECT *, lag(season) OVER w AS s, lag(num_days) OVER w AS m FROM ({_DAYS}) WINDOW w AS (PARTITION BY period ORDER BY seq)) WHERE s = season AND m <> num_days""",
)
def _(t: Tables) -> DataFrame:
    return C.sequential_seasons(t.sql(_DAYS), D.season_fraction(t("segfrac")), 365.0, 0.01)
