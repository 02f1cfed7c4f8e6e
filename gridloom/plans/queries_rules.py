"""Queries over emissions of all sources and the limit audits in full."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import checks as C
from gridloom.operators import limits as L
from gridloom.operators import results as R
from gridloom.operators.joins import r6
from gridloom.plans.adapters import ADAPTERS, Tables
from gridloom.plans.catalog import query

ADAPTERS["embodied"] = "SELECT region, 'co2' AS emis_comm, tech, vintage, avg(price) / 1e3 AS rate FROM {placed} WHERE tax > 0.03 GROUP BY region, tech, vintage"
ADAPTERS["ended"] = "SELECT region, 'co2' AS emis_comm, tech, vintage, avg(discount) * 1e1 AS rate FROM {placed} WHERE discount > 0.05 GROUP BY region, tech, vintage"
ADAPTERS["retired"] = "SELECT scenario, region, period, tech, vintage, capacity / 8 AS capacity FROM {net_capacity} WHERE period > vintage"
ADAPTERS["lengths"] = "SELECT period, CAST(coalesce(lead(period) OVER (ORDER BY period) - period, 5) AS INT) AS length FROM {period}"
ADAPTERS["cost_emission"] = "SELECT region, period, 'co2' AS emis_comm, avg(discount) * 1e2 AS cost FROM {placed} WHERE discount > 0.02 GROUP BY region, period"
_EMISSIONS = """SELECT scenario, region, period, emis_comm, tech, vintage, 'activity' AS source, sum(flow * activity) AS emission FROM {flow_out} JOIN {emission_activity} USING (region, input_comm, tech, vintage, output_comm) GROUP BY ALL
    UNION ALL SELECT scenario, region, vintage, emis_comm, tech, vintage, 'embodied', sum(capacity * rate / length) FROM {built_capacity} JOIN {embodied} USING (region, tech, vintage) JOIN (SELECT period, length FROM {lengths}) l ON l.period = vintage GROUP BY ALL
    UNION ALL SELECT scenario, region, period, emis_comm, tech, vintage, 'end of life', sum(capacity * rate) FROM {retired} JOIN {ended} USING (region, tech, vintage) GROUP BY ALL"""


def _emissions(t: Tables) -> DataFrame:
    return R.emissions(t("flow_out"), t("emission_activity"), t("built_capacity"), t("embodied"), t("retired"), t("ended"), t("lengths"))


@query("res11_emission_sources", f"SELECT scenario, region, period, emis_comm, tech, vintage, source, round(emission, 6) AS emission FROM ({_EMISSIONS})")
def _(t: Tables) -> DataFrame:
    return _emissions(t).withColumn("emission", F.round("emission", 6))


@query(
    "res11_emission_costs",
    f"""SELECT scenario, region, period, tech, vintage, round(sum(e * cost * (1 - pow(1.05, -length)) / 0.05 * pow(1.05, 1990 - period)), 4) AS d_emiss, round(sum(e * cost * length), 4) AS emiss
    FROM (SELECT scenario, region, period, emis_comm, tech, vintage, sum(emission) AS e FROM ({_EMISSIONS}) GROUP BY ALL) JOIN {{cost_emission}} USING (region, period, emis_comm) JOIN {{lengths}} USING (period) WHERE abs(e) >= 1e-5 GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    out = R.emission_costs(_emissions(t), t("cost_emission"), t("lengths"), 0.05, 1990, 1e-5)
    return out.select("scenario", "region", "period", "tech", "vintage", F.round("d_emiss", 4).alias("d_emiss"), F.round("emiss", 4).alias("emiss"))


_BOUNDS = "SELECT CASE WHEN period % 10 = 0 THEN 'global' WHEN period = 1995 THEN 'R1+R2' ELSE 'R3' END AS region, period, 'co2' AS emis_comm, CASE WHEN period = 2000 THEN 'ge' ELSE 'le' END AS operator, 5e3 AS bound FROM {period}"


@query(
    "lim5_emission_limits",
    f"""SELECT scenario, region, period, operator, round(v, 6) AS emission, CASE WHEN operator = 'le' THEN v > 5e3 + 5e-3 ELSE v < 5e3 - 5e-3 END AS broken FROM (
      SELECT s.scenario, l.region, l.period, l.operator, coalesce(sum(e.emission), 0) AS v FROM ({_BOUNDS}) l CROSS JOIN (SELECT DISTINCT scenario FROM {{flow_out}}) s
      LEFT JOIN ({_EMISSIONS}) e ON e.scenario = s.scenario AND e.period = l.period AND (CASE WHEN l.region = 'global' THEN e.region IN (SELECT DISTINCT region FROM {{demand}}) ELSE list_contains(string_split(l.region, '+'), e.region) END) GROUP BY ALL)""",
)
def _(t: Tables) -> DataFrame:
    out = L.emission_limits(t.sql(_BOUNDS), _emissions(t), t("demand").select("region").distinct())
    return out.select("scenario", "region", "period", "operator", *r6("emission"), "broken")


_STORE = "scenario, region, period, tech, vintage"
_FLOWS = f"SELECT {_STORE}, season, tod, sum(CASE WHEN tod IN ('T0', 'T1') THEN flow * 0.9e0 ELSE 0e0 END) AS charge, sum(CASE WHEN tod IN ('T0', 'T1') THEN 0e0 ELSE flow END) AS discharge FROM {{flow_out}} GROUP BY {_STORE}, season, tod"
_LEVELS = f"SELECT {_STORE}, season, tod, sum(flow) / 2 - 5 AS level FROM {{flow_out}} WHERE tod <> 'T3' GROUP BY {_STORE}, season, tod"
_STORES = "SELECT tech, 4e0 + length(tech) AS duration, 8e0 AS to_activity FROM {technology} WHERE flex = 1"


@query(
    "lim13_storage_audit",
    f"""WITH q AS (SELECT period, season, tod, coalesce(lead(season) OVER w, first_value(season) OVER w) AS ns, coalesce(lead(tod) OVER w, first_value(tod) OVER w) AS nt FROM {{slices}} WINDOW w AS (PARTITION BY period, season ORDER BY tod ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    g AS (SELECT period, season, tod, segfrac, sum(segfrac) OVER (PARTITION BY period, season) AS sf FROM {{segfrac}}), f AS ({_FLOWS}), l AS ({_LEVELS}),
    r AS (SELECT c.scenario, c.region, c.period, c.tech, c.vintage, q.season, q.tod, coalesce(charge, 0) AS ch, coalesce(discharge, 0) AS di, coalesce(a.level, 0) AS lv, coalesce(b.level, 0) AS nl, capacity * to_activity * segfrac AS pw, capacity * to_activity * duration / (24 * 365) * sf * 365 AS en
      FROM (SELECT * FROM {{net_capacity}}) c JOIN ({_STORES}) s USING (tech) JOIN q ON q.period = c.period JOIN g ON g.period = q.period AND g.season = q.season AND g.tod = q.tod
      LEFT JOIN f ON f.scenario = c.scenario AND f.region = c.region AND f.period = c.period AND f.tech = c.tech AND f.vintage = c.vintage AND f.season = q.season AND f.tod = q.tod
      LEFT JOIN l a ON a.scenario = c.scenario AND a.region = c.region AND a.period = c.period AND a.tech = c.tech AND a.vintage = c.vintage AND a.season = q.season AND a.tod = q.tod
      LEFT JOIN l b ON b.scenario = c.scenario AND b.region = c.region AND b.period = c.period AND b.tech = c.tech AND b.vintage = c.vintage AND b.season = q.ns AND b.tod = q.nt),
    x AS (SELECT *, 'state' AS finding, lv + ch - di AS value, nl AS bound FROM r WHERE abs(lv + ch - di - nl) > 1e-6 * greatest(1, abs(lv + ch - di)) UNION ALL SELECT *, 'negative', lv, 0 FROM r WHERE lv < -1e-6
      UNION ALL SELECT *, 'energy', lv, en FROM r WHERE lv > en + 1e-6 * greatest(1, abs(en)) UNION ALL SELECT *, 'charge', ch, pw FROM r WHERE ch > pw + 1e-6 * greatest(1, abs(pw))
      UNION ALL SELECT *, 'discharge', di, pw FROM r WHERE di > pw + 1e-6 * greatest(1, abs(pw)) UNION ALL SELECT *, 'throughput', ch + di, pw FROM r WHERE ch + di > pw + 1e-6 * greatest(1, abs(pw)))
    SELECT {_STORE}, season, tod, finding, round(value, 6) AS value, round(bound, 6) AS bound FROM x""",
)
def _(t: Tables) -> DataFrame:
    out = L.storage_audit(t.sql(_FLOWS), t.sql(_LEVELS), t("net_capacity"), t.sql(_STORES), C.slice_sequence(t("slices"), "season"), t("segfrac"), 365.0)
    return out.select(*L.STORE, "season", "tod", "finding", *r6("value", "bound"))


_MADE = "SELECT scenario, CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 2) ELSE region END AS region, period, season, tod, output_comm AS commodity, flow FROM {flow_out} UNION ALL SELECT scenario, region, period, 'S1', 'T0', 'PROMO', capacity FROM {retired}"
_USED = "SELECT scenario, CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 1) ELSE region END AS region, period, season, tod, input_comm AS commodity, flow FROM {flow_in}"
_FLAGS = "SELECT name, CASE WHEN flag = 'a' THEN 'w' ELSE flag END AS flag FROM {commodity}"
_BALANCE = f"""SELECT *, CASE WHEN flag = 'w' THEN used > made + 1e-6 * greatest(1, abs(made), abs(used)) ELSE abs(made - used) > 1e-6 * greatest(1, abs(made), abs(used)) END AS broken FROM (
      SELECT KEYS_, commodity, sum(m) AS made, sum(u) AS used FROM (SELECT *, flow AS m, 0 AS u FROM ({_MADE}) UNION ALL SELECT *, 0, flow FROM ({_USED})) GROUP BY ALL) LEFT JOIN (SELECT name AS commodity, flag FROM ({_FLAGS})) USING (commodity) WHERE flag IS NULL OR flag NOT IN ('s', 'd')"""


def _balanced(t: Tables, keys: list[str]) -> DataFrame:
    made, used = L.exchange_rows(t("flow_out"), t("flow_in"))
    columns = ["scenario", "region", "period", "season", "tod", "commodity", "flow"]
    material = t("retired").select("scenario", "region", "period", F.lit("S1").alias("season"), F.lit("T0").alias("tod"), F.lit("PROMO").alias("commodity"), F.col("capacity").alias("flow"))
    out = L.slice_balance(made.select(*columns).unionByName(material), used.select(*columns), t.sql(_FLAGS), keys)
    return out.select(*keys, "commodity", "flag", *r6("made", "used"), "broken")


@query("lim12_balance", "SELECT scenario, region, period, season, tod, commodity, flag, round(made, 6) AS made, round(used, 6) AS used, broken FROM (" + _BALANCE.replace("KEYS_", "scenario, region, period, season, tod") + ")")
def _(t: Tables) -> DataFrame:
    return _balanced(t, ["scenario", "region", "period", "season", "tod"])


@query("lim12_annual_balance", "SELECT scenario, region, period, commodity, flag, round(made, 6) AS made, round(used, 6) AS used, broken FROM (" + _BALANCE.replace("KEYS_", "scenario, region, period") + ")")
def _(t: Tables) -> DataFrame:
    return _balanced(t, ["scenario", "region", "period"])


_CURTAILED = f"SELECT {_STORE}, season, tod, flow / 8 AS flow FROM {{flow_out}} WHERE tech IN (SELECT tech FROM {{technology}} WHERE curtail = 1)"
_FACTORS = "SELECT DISTINCT region, period, tech, vintage, season, tod, 0.5e0 AS factor FROM {flow_out} WHERE season = 'S1'"


@query(
    "lim10_capacity_use",
    f"""SELECT {_STORE}, season, tod, round(f, 6) AS flow, round(c, 6) AS curtailed, round(a, 6) AS allowed, f + c > a + 1e-6 AS broken FROM (SELECT {_STORE}, season, tod, f, c, coalesce(factor, 1) * capacity * 8 * segfrac AS a
    FROM (SELECT {_STORE}, season, tod, sum(flow) AS f, sum(CASE WHEN curtail = 1 THEN flow / 8 ELSE 0 END) AS c FROM {{flow_out}} JOIN (SELECT tech, curtail FROM {{technology}}) USING (tech) GROUP BY ALL) JOIN {{net_capacity}} USING ({_STORE}) JOIN (SELECT period, season, tod, segfrac FROM {{segfrac}}) USING (period, season, tod)
    LEFT JOIN ({_FACTORS}) USING (region, period, tech, vintage, season, tod))""",
)
def _(t: Tables) -> DataFrame:
    out = L.slice_capacity_use(t("flow_out"), t.sql(_CURTAILED), t("net_capacity"), t.sql(_FACTORS), t("segfrac"), 8.0)
    return out.select(*L.STORE, "season", "tod", *r6("flow", "curtailed", "allowed"), "broken")


_SEASONAL = "SELECT CASE WHEN flex = 1 THEN 'global' WHEN annual = 1 THEN 'R1+R2' ELSE 'R3' END AS region, 'S1' AS season, tech, CASE WHEN curtail = 1 THEN 'ge' ELSE 'le' END AS operator, 0.25e0 AS factor FROM {technology}"


@query(
    "lim4_seasonal_factor",
    f"""WITH m AS (SELECT l.region AS lr, l.season, l.tech, l.operator, l.factor, r.region FROM ({_SEASONAL}) l JOIN (SELECT DISTINCT region FROM {{demand}}) r ON l.region = 'global' OR list_contains(string_split(l.region, '+'), r.region)),
    p AS (SELECT scenario, period, lr, tech, any_value(operator) AS operator, any_value(factor) AS factor, sum(capacity * 8 * fr) AS possible FROM m JOIN (SELECT scenario, region, period, tech, sum(capacity) AS capacity FROM {{net_capacity}} GROUP BY ALL) c USING (region, tech) JOIN (SELECT period, season, sum(segfrac) AS fr FROM {{segfrac}} GROUP BY ALL) g USING (period, season) GROUP BY scenario, period, lr, tech),
    f AS (SELECT scenario, period, lr, tech, sum(flow) AS flow FROM m JOIN {{flow_out}} USING (region, tech, season) GROUP BY scenario, period, lr, tech)
    SELECT scenario, period, lr AS region, tech, operator, round(coalesce(flow, 0), 6) AS flow, round(factor * possible, 6) AS allowed, CASE WHEN operator = 'le' THEN coalesce(flow, 0) > factor * possible + 1e-6 * greatest(1, factor * possible) ELSE coalesce(flow, 0) < factor * possible - 1e-6 * greatest(1, factor * possible) END AS broken FROM p LEFT JOIN f USING (scenario, period, lr, tech)""",
)
def _(t: Tables) -> DataFrame:
    out = L.seasonal_capacity_factors(t("flow_out"), t("net_capacity"), t.sql(_SEASONAL), t("segfrac"), t("demand").select("region").distinct(), 8.0)
    return out.select("scenario", "period", "region", "tech", "operator", *r6("flow", "allowed"), "broken")


_LINKS = "SELECT DISTINCT region, tech, 'co2' AS emis_comm, concat('Brand#2', substr(tech, 8, 4)) AS linked_tech FROM {net_capacity} WHERE tech LIKE 'Brand#1%'"


@query(
    "lim15_linked_output",
    f"""WITH k AS ({_LINKS}), p AS (SELECT scenario, region, period, season, tod, vintage, k.tech, linked_tech, sum(flow * activity) AS e FROM {{flow_out}} JOIN {{emission_activity}} USING (region, input_comm, tech, vintage, output_comm) JOIN k USING (region, tech) GROUP BY ALL),
    f AS (SELECT scenario, o.region, period, season, tod, vintage, k.tech, linked_tech, sum(flow) AS f FROM (SELECT * FROM {{flow_out}}) o JOIN k ON k.region = o.region AND k.linked_tech = o.tech GROUP BY ALL)
    SELECT scenario, region, period, season, tod, vintage, tech, linked_tech, round(coalesce(e, 0), 6) AS emission, round(coalesce(f, 0), 6) AS flow FROM p FULL JOIN f USING (scenario, region, period, season, tod, vintage, tech, linked_tech) WHERE abs(coalesce(e, 0) + coalesce(f, 0)) > 1e-6 * greatest(1, abs(coalesce(e, 0)), abs(coalesce(f, 0)))""",
)
def _(t: Tables) -> DataFrame:
    return L.linked_output(t("flow_out"), t("emission_activity"), t.sql(_LINKS)).select("scenario", "region", "period", "season", "tod", "vintage", "tech", "linked_tech", *r6("emission", "flow"))


_LIVED = "SELECT DISTINCT region, period, tech, vintage, least(1e0, greatest(0e0, (vintage + 12 - period) / 5e0)) AS fraction, greatest(0.2e0, 1 - abs(period - vintage) / 4e1) AS survival FROM {net_capacity}"


@query(
    "lim16_adjusted_capacity",
    f"""SELECT scenario, region, tech, vintage, period, round(gone, 6) AS gone, round((b - gone) * fraction, 6) AS expected, abs(capacity - (b - gone) * fraction) > 1e-6 * greatest(1, abs((b - gone) * fraction)) AS broken FROM (
      SELECT n.*, fraction, sum(CASE WHEN period > vintage THEN coalesce(r.c, 0) / survival ELSE 0 END) OVER (PARTITION BY scenario, region, tech, vintage ORDER BY period ROWS UNBOUNDED PRECEDING) AS gone FROM (SELECT * FROM {{net_capacity}}) n JOIN ({_LIVED}) USING (region, period, tech, vintage)
      LEFT JOIN (SELECT {_STORE}, capacity AS c FROM {{retired}}) r USING ({_STORE})) JOIN (SELECT scenario, region, tech, vintage, capacity AS b FROM {{built_capacity}}) USING (scenario, region, tech, vintage)""",
)
def _(t: Tables) -> DataFrame:
    out = L.adjusted_capacity(t("built_capacity"), t("retired"), t("net_capacity"), t.sql(_LIVED))
    return out.select("scenario", "region", "tech", "vintage", "period", *r6("gone", "expected"), "broken")


_RESERVE = "SELECT tech, 0.75e0 AS derate FROM {technology} WHERE reserve = 1 OR flex = 1"


@query(
    "lim8_dynamic_reserve",
    f"""WITH r AS ({_RESERVE}), a AS (SELECT scenario, CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 2) ELSE region END AS node, period, season, tod, sum(capacity * derate * coalesce(factor, 1) * 8 * segfrac) AS available FROM {{net_capacity}} JOIN r USING (tech) JOIN (SELECT period, season, tod, segfrac FROM {{segfrac}}) USING (period) LEFT JOIN ({_FACTORS}) USING (region, period, tech, vintage, season, tod) GROUP BY 1, 2, 3, 4, 5),
    l AS (SELECT scenario, node, period, season, tod, sum(v) AS load FROM (SELECT scenario, CASE WHEN region LIKE '%-%' THEN split_part(region, '-', 2) ELSE region END AS node, period, season, tod, tech, flow AS v FROM {{flow_out}} UNION ALL SELECT scenario, split_part(region, '-', 1), period, season, tod, tech, -flow FROM {{flow_out}} WHERE region LIKE '%-%'
      UNION ALL SELECT scenario, region, period, season, tod, tech, -flow FROM {{flow_in}} WHERE region NOT LIKE '%-%' AND tech IN (SELECT tech FROM {{technology}} WHERE flex = 1)) WHERE tech IN (SELECT tech FROM r) GROUP BY ALL)
    SELECT scenario, node AS region, period, season, tod, round(coalesce(available, 0), 6) AS available, round(coalesce(load, 0), 6) AS load, coalesce(available, 0) < coalesce(load, 0) * 1.1 - 1e-6 AS broken FROM a FULL JOIN l USING (scenario, node, period, season, tod)""",
)
def _(t: Tables) -> DataFrame:
    charge = t("flow_in").where("region not like '%-%'").join(t("technology").where("flex = 1").select("tech"), "tech", "left_semi")
    out = L.dynamic_reserve(t("net_capacity"), t("flow_out"), charge, t.sql(_RESERVE), t.sql(_FACTORS), t("segfrac"), 0.1, 8.0)
    return out.select("scenario", "region", "period", "season", "tod", *r6("available", "load"), "broken")


_PLACES = "SELECT region, min(cx) AS x, min(cy) AS y FROM {cells} GROUP BY region"


@query(
    "res29_nodes",
    f"""SELECT scenario, region, period, name, kind, round(value, 6) AS value, x, y FROM (SELECT scenario, region, period, tech AS name, 'flow' AS kind, sum(flow) AS value FROM {{flow_out}} WHERE region NOT LIKE '%-%' GROUP BY ALL
    UNION ALL SELECT scenario, region, period, commodity, 'demand', sum(demand) FROM {{demand}} CROSS JOIN (SELECT DISTINCT scenario FROM {{flow_out}}) GROUP BY ALL) JOIN ({_PLACES}) USING (region) WHERE value > 0""",
)
def _(t: Tables) -> DataFrame:
    return R.map_nodes(t("flow_out"), t("demand"), t.sql(_PLACES)).select("scenario", "region", "period", "name", "kind", *r6("value"), "x", "y")


@query(
    "res33_split",
    "SELECT scenario, tech, count(*) FILTER (capacity < 150) AS n_small, round(coalesce(sum(capacity) FILTER (capacity < 150), 0), 6) AS total_small, count(*) FILTER (capacity >= 150) AS n_large, round(coalesce(sum(capacity) FILTER (capacity >= 150), 0), 6) AS total_large FROM {net_capacity} GROUP BY scenario, tech",
)
def _(t: Tables) -> DataFrame:
    return R.concentration_split(t("net_capacity"), ["scenario", "tech"], "capacity", 150.0).select("scenario", "tech", "n_small", *r6("total_small"), "n_large", *r6("total_large"))


@query("res38_emission_links", f"SELECT scenario, period, tech AS source, emis_comm AS target, round(sum(emission), 6) AS value, 'emission' AS kind FROM ({_EMISSIONS}) GROUP BY scenario, period, tech, emis_comm")
def _(t: Tables) -> DataFrame:
    return R.diagram_emissions(_emissions(t)).withColumn("value", F.round("value", 6))
