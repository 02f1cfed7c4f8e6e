"""Queries of demand by slice, ramps by the hour, retirement by the year, the whole flow index, supporting tables, naming faults and diagram details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import checks as C
from gridloom.operators import costs as K
from gridloom.operators import derive as D
from gridloom.operators import limits as L
from gridloom.operators import results as R
from gridloom.operators.joins import r6
from gridloom.plans.adapters import Tables
from gridloom.plans.catalog import query
from gridloom.plans.queries_model import _ACTIVE, _lives
from gridloom.plans.queries_rules import _STORE  # the adapters `lengths` and `retired` are there too

_SHARES = "SELECT d.region, d.period, season, tod, commodity, segfrac AS share FROM (SELECT * FROM {demand}) d JOIN (SELECT period, season, tod, segfrac FROM {segfrac}) s ON s.period = d.period"


@query(
    "lim11_slice_share",
    f"""WITH y AS (SELECT {_STORE}, output_comm AS commodity, sum(flow) AS year FROM {{flow_out}} GROUP BY ALL), f AS (SELECT {_STORE}, output_comm AS commodity, season, tod, sum(flow) AS flow FROM {{flow_out}} GROUP BY ALL),
    r AS (SELECT y.scenario, y.region, y.period, y.tech, y.vintage, y.commodity, s.season, s.tod, coalesce(flow, 0) AS flow, year * share AS expected FROM y
      JOIN ({_SHARES}) s ON s.region = CASE WHEN y.region LIKE '%-%' THEN split_part(y.region, '-', 2) ELSE y.region END AND s.period = y.period AND s.commodity = y.commodity
      LEFT JOIN f ON f.scenario = y.scenario AND f.region = y.region AND f.period = y.period AND f.tech = y.tech AND f.vintage = y.vintage AND f.commodity = y.commodity AND f.season = s.season AND f.tod = s.tod)
    SELECT {_STORE}, commodity, season, tod, round(flow, 6) AS flow, round(expected, 6) AS expected, abs(flow - expected) > 2 * greatest(1, expected) AS broken FROM r""",
)
def _(t: Tables) -> DataFrame:
    return L.demand_shares(t("flow_out"), t.sql(_SHARES), relative=2.0).select(*L.STORE, "commodity", "season", "tod", *r6("flow", "expected"), "broken")


_RATES = "SELECT DISTINCT region, tech, direction, CAST(CAST(replace(tech, 'Brand#', '') AS INT) % 20 AS DOUBLE) / CASE WHEN direction = 'up' THEN 1e2 ELSE 2e2 END AS rate FROM {net_capacity} CROSS JOIN (SELECT 'up' AS direction UNION ALL SELECT 'down') w"
_BY_HOUR = f"""WITH g AS (SELECT period, season, tod, segfrac, segfrac / sum(segfrac) OVER (PARTITION BY period, season) AS part FROM {{segfrac}}), q AS (SEQUENCE_),
    s AS (SELECT q.period, q.season, q.tod, q.ns, q.nt, 8760 * a.segfrac AS hours, 12 * (a.part + b.part) AS between_ FROM q JOIN g a ON a.period = q.period AND a.season = q.season AND a.tod = q.tod JOIN g b ON b.period = q.period AND b.season = q.ns AND b.tod = q.nt),
    f AS (SELECT {_STORE}, season, tod, sum(flow) AS flow FROM {{flow_out}} GROUP BY ALL),
    r AS (SELECT c.scenario, c.region, c.period, c.tech, c.vintage, s.season, s.tod, ns, nt, direction, CASE WHEN direction = 'up' THEN coalesce(b.flow, 0) - coalesce(a.flow, 0) ELSE coalesce(a.flow, 0) - coalesce(b.flow, 0) END / hours AS change, rate * between_ * capacity * 1e-3 AS allowed
      FROM (SELECT * FROM {{net_capacity}}) c JOIN ({_RATES}) w ON w.region = c.region AND w.tech = c.tech JOIN s ON s.period = c.period
      LEFT JOIN f a ON a.scenario = c.scenario AND a.region = c.region AND a.period = c.period AND a.tech = c.tech AND a.vintage = c.vintage AND a.season = s.season AND a.tod = s.tod
      LEFT JOIN f b ON b.scenario = c.scenario AND b.region = c.region AND b.period = c.period AND b.tech = c.tech AND b.vintage = c.vintage AND b.season = s.ns AND b.tod = s.nt WHERE rate * between_ < 1)
    SELECT {_STORE}, season, tod, ns AS next_season, nt AS next_tod, direction, round(change, 9) AS change, round(allowed, 9) AS allowed, change > allowed + 1e-6 * greatest(1, allowed) AS broken FROM r"""
_WITHIN = "SELECT period, season, tod, season AS ns, coalesce(lead(tod) OVER w, first_value(tod) OVER w) AS nt FROM {slices} WINDOW w AS (PARTITION BY period, season ORDER BY tod ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_BETWEEN = """SELECT * FROM (SELECT period, season, tod, coalesce(lead(season) OVER w, first_value(season) OVER w) AS ns, coalesce(lead(head) OVER w, first_value(head) OVER w) AS nt
      FROM (SELECT period, season, min(tod) AS head, max(tod) AS tod FROM {slices} GROUP BY period, season) WINDOW w AS (PARTITION BY period ORDER BY season ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WHERE season <> ns"""


def _ramps(t: Tables, sequence: DataFrame) -> DataFrame:
    out = L.hourly_ramps(t("flow_out"), t("net_capacity"), sequence, t("segfrac"), t.sql(_RATES), 365.0, 1e-3)
    return out.withColumn("change", F.round("change", 9)).withColumn("allowed", F.round("allowed", 9))


@query("lim14_hourly_ramp", _BY_HOUR.replace("SEQUENCE_", _WITHIN))
def _(t: Tables) -> DataFrame:
    return _ramps(t, C.slice_sequence(t("slices"), "season"))


@query("lim14_season_ramp", _BY_HOUR.replace("SEQUENCE_", _BETWEEN))
def _(t: Tables) -> DataFrame:
    return _ramps(t, C.season_sequence(t("slices")))


_HORIZON = "SELECT period, length FROM {lengths} UNION ALL SELECT max(period) + 5, NULL FROM {lengths}"
_EXISTING = "SELECT scenario, region, tech, vintage, capacity FROM {built_capacity} WHERE vintage < 1995 OR capacity > 240"
_LIFETIME = "SELECT DISTINCT region, tech, vintage, CASE WHEN vintage = 1990 OR length(tech) = 7 THEN 5 ELSE coalesce(lifetime, 8) END AS lifetime FROM {built_capacity} LEFT JOIN (SELECT * FROM {lifetime_process}) l USING (region, tech, vintage)"
_CURVE = f"SELECT region, tech, vintage, period, least(1e0, greatest(0.1e0, (vintage + 12 - period) / 5e0)) AS fraction, greatest(0.2e0, 1 - abs(period - vintage) / 4e1) AS survival FROM ({_LIFETIME}) f CROSS JOIN ({_HORIZON}) h"


@query(
    "lim16_annual_retirement",
    f"""WITH h AS ({_HORIZON}), e AS ({_EXISTING}), b AS (SELECT k.*, lifetime FROM (SELECT scenario, region, tech, vintage FROM {{net_capacity}} UNION SELECT scenario, region, tech, vintage FROM e) k JOIN ({_LIFETIME}) USING (region, tech, vintage)),
    r AS (SELECT b.*, h.period, h.length, vintage + lifetime AS ends, coalesce(n.capacity, 0) / fraction AS whole, survival, coalesce(e.capacity, 0) AS old FROM b JOIN h ON vintage <= h.period JOIN ({_CURVE}) USING (region, tech, vintage, period)
      LEFT JOIN (SELECT * FROM {{net_capacity}}) n USING ({_STORE}) LEFT JOIN e USING (scenario, region, tech, vintage)),
    w AS (SELECT *, lag(whole) OVER o AS was, lead(whole) OVER o AS nw, lead(survival) OVER o AS ns, lead(period) OVER o AS np FROM r WINDOW o AS (PARTITION BY scenario, region, tech, vintage ORDER BY period)),
    s AS (SELECT *, CASE WHEN period < ends THEN whole WHEN period = (SELECT min(period) FROM h) THEN old ELSE coalesce(was, 0) END * survival AS begin_ FROM w WHERE length IS NOT NULL AND period <= ends),
    x AS (SELECT *, CASE WHEN ends < period + length THEN 0 WHEN np = ends OR period = (SELECT max(period) FROM h WHERE length IS NOT NULL) THEN begin_ * ns / survival ELSE nw * ns END AS end_ FROM s)
    SELECT {_STORE}, round(begin_, 6) AS start, round(end_, 6) AS "end", round((begin_ - end_) / length, 6) AS retirement, abs(coalesce(v, 0) - (begin_ - end_) / length) > 0.37 * greatest(1, abs((begin_ - end_) / length)) AS broken
    FROM x LEFT JOIN (SELECT {_STORE}, capacity AS v FROM {{retired}}) USING ({_STORE})""",
)
def _(t: Tables) -> DataFrame:
    solved = t("retired").withColumnRenamed("capacity", "retirement")
    out = L.annual_retirement(t("net_capacity"), t.sql(_EXISTING), t.sql(_LIFETIME), t.sql(_CURVE), t.sql(_HORIZON), solved, 0.37)
    return out.select(*L.STORE, *r6("start", "end", "retirement"), "broken")


_FLAGGED = "SELECT tech, annual, flex, curtail, reserve AS storage, unlim_cap AS seasonal, baseload AS demand, CASE WHEN unlim_cap = 1 AND curtail = 1 THEN 1 ELSE 0 END AS unlim_cap FROM {technology}"


@query(
    "der6_flow_index",
    f"""WITH p AS (SELECT DISTINCT region, tech, vintage, period FROM ({_ACTIVE})), o AS (SELECT p.*, annual, flex, curtail, storage, seasonal, demand, unlim_cap FROM p JOIN ({_FLAGGED}) USING (tech)),
    u AS (SELECT o.*, input_comm, output_comm, output_comm IN (SELECT DISTINCT o_orderpriority FROM orders) AS d FROM o JOIN (SELECT DISTINCT region, tech, vintage, input_comm, output_comm FROM {{efficiency}}) USING (region, tech, vintage)),
    k AS (SELECT region, tech, vintage, period, input_comm, output_comm, unnest(list_filter([CASE WHEN annual = 0 THEN 'flow' END, CASE WHEN annual = 1 OR (demand = 1 AND d) THEN 'flow_annual' END, CASE WHEN annual = 0 AND flex = 1 THEN 'flex' END, CASE WHEN annual = 1 AND flex = 1 THEN 'flex_annual' END, CASE WHEN curtail = 1 THEN 'curtail' END, CASE WHEN storage = 1 THEN 'storage_in' END], lambda x: x IS NOT NULL)) AS kind FROM u
      UNION ALL SELECT region, tech, vintage, period, NULL, NULL, unnest(list_filter(['activity', CASE WHEN unlim_cap = 0 THEN 'capacity' END, CASE WHEN storage = 1 THEN 'storage_level' END], lambda x: x IS NOT NULL)) FROM o),
    r AS (SELECT k.*, season, tod FROM k JOIN (SELECT period, season, tod FROM {{slices}}) USING (period) WHERE kind IN ('flow', 'flex', 'curtail', 'storage_in', 'storage_level') UNION ALL SELECT *, NULL, NULL FROM k WHERE kind IN ('flow_annual', 'flex_annual', 'activity', 'capacity')
      UNION ALL SELECT region, tech, vintage, period, NULL, NULL, 'seasonal_level', season, NULL FROM o JOIN (SELECT DISTINCT period, season FROM {{slices}}) USING (period) WHERE storage = 1 AND seasonal = 1)
    SELECT region, tech, period, kind, count(*) AS n, count(season) AS with_season, count(tod) AS with_slice, count(output_comm) AS with_output FROM r GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    rows = D.flow_index(D.active(_lives(t), t("period")), t("efficiency"), t("slices"), t.sql(_FLAGGED), t("commodity"), t("slices"))
    return rows.groupBy("region", "tech", "period", "kind").agg(F.count("*").alias("n"), F.count("season").alias("with_season"), F.count("tod").alias("with_slice"), F.count("output_comm").alias("with_output"))


_RAW = "SELECT tech, CASE WHEN annual = 1 THEN 't' WHEN flex = 1 THEN 'p' ELSE 'x' END AS flag, sector, unlim_cap, annual, reserve, curtail FROM {technology}"
_PROFILE = "SELECT p_brand AS element, round(avg(p_retailprice), 6) AS value FROM {part} GROUP BY p_brand"


def _static(t: Tables) -> dict[str, DataFrame]:
    values = {"sector": "industrial", "reserve": 0, "curtail": 0, "retire": 0, "flex": 0, "data_id": "GRID1"}
    used = t("net_capacity").select("tech").distinct()
    return K.encode_static(t.sql(_RAW), t("commodity"), used, t("period"), t.sql(_PROFILE), {"global_discount_rate": 0.05, "Brand#11": 0.5}, values, {"p": "production", "t": "transport"})


@query("enc9_technology", "SELECT tech, flag, 'industrial' AS sector, unlim_cap, annual, 0 AS reserve, 0 AS curtail, 0 AS retire, 0 AS flex, 'GRID1' AS data_id FROM (" + _RAW + ")")
def _(t: Tables) -> DataFrame:
    return _static(t)["Technology"]


@query(
    "enc9_supporting",
    f"""SELECT 'Commodity' AS "table", name AS label, flag AS value FROM {{commodity}} UNION ALL SELECT 'TimePeriod', CAST(period AS STRING), concat(CAST(row_number() OVER (ORDER BY period) AS STRING), 'f') FROM {{period}}
    UNION ALL SELECT DISTINCT 'TechnologyType', flag, CASE WHEN flag = 'p' THEN 'production' WHEN flag = 't' THEN 'transport' END FROM ({_RAW}) UNION ALL SELECT 'SectorLabel', 'industrial', 'industrial sector'
    UNION ALL SELECT 'MetaDataReal', element, CAST(CAST(round(value * 1000) AS BIGINT) AS STRING) FROM (SELECT * FROM ({_PROFILE}) WHERE element <> 'Brand#11' UNION ALL SELECT 'Brand#11', 0.5e0 UNION ALL SELECT 'global_discount_rate', 0.05e0)""",
)
def _(t: Tables) -> DataFrame:
    found = _static(t)
    row = lambda name, label, value: found[name].select(F.lit(name).alias("table"), F.col(label).cast("string").alias("label"), value.cast("string").alias("value"))
    parts = [
        row("Commodity", "name", F.col("flag")), row("TimePeriod", "period", F.concat(F.col("sequence").cast("string"), "flag")), row("TechnologyType", "label", F.col("description")), row("SectorLabel", "sector", F.col("notes")),
        row("MetaDataReal", "element", F.round(F.col("value") * 1000).cast("long")),
    ]
    return R.union(*parts)


_NAMES = """SELECT region AS name FROM {flow_out} UNION SELECT concat(region, '+R9') FROM {demand} UNION SELECT concat(region, '+', region) FROM {demand} UNION SELECT concat(region, '+R0+R1') FROM {demand} UNION SELECT concat('Q ', region) FROM {demand}
    UNION SELECT concat(region, '-', region) FROM {demand} UNION SELECT concat(region, '-', region, '-R1') FROM {demand} UNION SELECT concat(region, '-X') FROM {demand} UNION SELECT concat('X', region) FROM {demand} UNION SELECT CASE WHEN period = 1995 THEN 'global' END FROM {demand}"""
_FAULTS = r"""SELECT name, kind, CASE WHEN name IS NULL THEN 'missing' WHEN name = 'global' THEN NULL WHEN NOT regexp_full_match(name, CASE kind WHEN 'edge' THEN '[A-Za-z0-9_]+-[A-Za-z0-9_]+' WHEN 'group' THEN '[A-Za-z0-9_+]+' ELSE '[A-Za-z0-9_]+' END) THEN 'characters'
      WHEN len(list_distinct(p)) < len(p) THEN CASE WHEN kind = 'edge' THEN 'same ends' ELSE 'repeated' END WHEN len(list_filter(p, lambda x: NOT list_contains(known, x))) > 0 THEN 'unknown' END AS finding
    FROM (SELECT name, CASE WHEN name LIKE '%-%' THEN 'edge' WHEN name LIKE '%+%' OR name = 'global' THEN 'group' WHEN name IS NOT NULL THEN 'node' END AS kind, string_split_regex(name, '[-+]') AS p FROM (NAMES_)) CROSS JOIN (SELECT list(DISTINCT region) AS known FROM {demand})"""


@query("dia25_name_faults", _FAULTS.replace("NAMES_", _NAMES))
def _(t: Tables) -> DataFrame:
    return C.name_findings(t.sql(_NAMES), t("demand").select("region").distinct())


@query(
    "dia25_elements",
    """SELECT 'p_type' AS "column", e AS element, count(*) AS n FROM (SELECT replace(p_type, 'ED ', '/') AS e FROM {part}) WHERE contains(e, '/') OR contains(e, '|') GROUP BY e
    UNION ALL SELECT 'p_brand', e, count(*) FROM (SELECT replace(p_brand, '#1', '|') AS e FROM {part}) WHERE contains(e, '/') OR contains(e, '|') GROUP BY e""",
)
def _(t: Tables) -> DataFrame:
    return C.element_findings(t.sql("SELECT p_partkey, replace(p_type, 'ED ', '/') AS p_type, replace(p_brand, '#1', '|') AS p_brand FROM {part}"), ["p_partkey", "p_type", "p_brand"])


_ENTRIES = "SELECT DISTINCT CASE WHEN CAST(replace(tech, 'Brand#', '') AS INT) % 3 = 0 THEN concat(region, '-X') ELSE region END AS region, concat('G', right(tech, 1)) AS grp, tech FROM {net_capacity}"


@query(
    "dia25_group_entries",
    f"""WITH e AS ({_ENTRIES}), f AS ({_FAULTS.replace("NAMES_", "SELECT DISTINCT region AS name FROM (" + _ENTRIES + ")")})
    SELECT region, grp AS "group", tech, unnest(list_filter([CASE WHEN region IN (SELECT name FROM f WHERE finding IS NOT NULL) THEN 'region' END, CASE WHEN grp IN ('G4', 'G5') THEN 'group' END, CASE WHEN tech LIKE 'Brand#2%' THEN 'tech' END], lambda x: x IS NOT NULL)) AS finding FROM e""",
)
def _(t: Tables) -> DataFrame:
    entries = t.sql(_ENTRIES).withColumnRenamed("grp", "group")
    return C.group_entry_findings(entries, t("demand").select("region").distinct(), entries.select("group").distinct().where("group not in ('G4', 'G5')"), t("technology").where("tech not like 'Brand#2%'"))


@query(
    "res38_process_detail",
    """SELECT scenario, region, period, tech, vintage, input_comm AS commodity, 'input' AS kind, round(sum(flow), 6) AS value FROM {flow_in} WHERE input_comm NOT IN (SELECT name FROM {commodity} WHERE flag = 's') GROUP BY ALL
    UNION ALL SELECT scenario, region, period, tech, vintage, output_comm, 'output', round(sum(flow), 6) FROM {flow_out} GROUP BY ALL
    UNION ALL SELECT scenario, region, period, tech, vintage, NULL, 'vintage', round(sum(capacity), 6) FROM {net_capacity} GROUP BY ALL UNION ALL SELECT scenario, region, period, tech, NULL, NULL, 'total', round(sum(capacity), 6) FROM {net_capacity} GROUP BY ALL""",
)
def _(t: Tables) -> DataFrame:
    out = R.process_detail(t("flow_in"), t("flow_out"), t("net_capacity"), t("commodity").where("flag = 's'"))
    return out.select("scenario", "region", "period", "tech", "vintage", "commodity", "kind", *r6("value"))


@query(
    "res38_commodity_detail",
    """WITH f AS (SELECT scenario, period, region, input_comm AS commodity, tech, 'use' AS kind, sum(flow) AS value FROM {flow_in} WHERE tod <> 'T3' GROUP BY ALL UNION ALL SELECT scenario, period, region, output_comm, tech, 'make', sum(flow) FROM {flow_out} WHERE tod <> 'T3' GROUP BY ALL),
    c AS (SELECT region, input_comm AS commodity, tech, 'use' AS kind FROM {efficiency} UNION SELECT region, output_comm, tech, 'make' FROM {efficiency})
    SELECT scenario, region, period, commodity, tech, kind, value IS NOT NULL AS used, round(value, 6) AS value FROM (SELECT DISTINCT scenario, period, region, commodity FROM f) d JOIN c USING (region, commodity) LEFT JOIN f USING (scenario, period, region, commodity, tech, kind)""",
)
def _(t: Tables) -> DataFrame:
    out = R.commodity_detail(t("flow_in").where("tod <> 'T3'"), t("flow_out").where("tod <> 'T3'"), t("efficiency"))
    return out.withColumn("value", F.round("value", 6))
