"""Limit-compliance audits over solved tables (LIM-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.regions import edge_from, edge_to, expand_groups, is_edge, mirrored


def breaks(operator: Column, value: Column, limit: Column, tolerance: float = 1e-6) -> Column:
    """Whether a value breaks its limit: le, ge or e."""
    slack = tolerance * F.greatest(F.lit(1.0), F.abs(limit))
    return F.when(operator == "le", value > limit + slack).when(operator == "ge", value < limit - slack).otherwise(F.abs(value - limit) > slack)


def group_limits(limits: DataFrame, values: DataFrame, regions: DataFrame, groups: DataFrame, by: Sequence[str], value: str, limit: str) -> DataFrame:
    """LIM-1, LIM-2: summed value of a limit's regions and technologies against it. limits: region, tech_or_group, operator, limit, and those of by that they fix; an absent value counts 0."""
    keys = [c for c in by if c in limits.columns]
    named = limits.withColumn("_limit", F.xxhash64(*limits.columns))
    members = expand_groups(named, regions, groups).select("_limit", F.col("member").alias("region"), F.col("member_tech").alias("tech"), *keys).distinct()
    sums = members.join(values.select("scenario", "region", "tech", *keys, value), ["region", "tech", *keys]).groupBy("_limit", "scenario").agg(F.sum(value).alias("value"))
    every = named.crossJoin(values.select("scenario").distinct())  # scenarios: few
    out = every.join(sums, ["_limit", "scenario"], "left").na.fill(0.0, ["value"]).drop("_limit")
    return out.withColumn("broken", breaks(F.col("operator"), F.col("value"), F.col(limit)))


def share_limits(limits: DataFrame, values: DataFrame, groups: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """LIM-3: value of a sub-group against share times that of a super-group, per scenario and by. limits: sub, super, operator, share."""
    own = lambda name, out: groups.where(F.col("group").isNotNull()).select(F.col("group").alias(name), "tech").join(values, "tech").groupBy(name, "scenario", *by).agg(F.sum(value).alias(out))
    both = limits.join(own("super", "whole"), "super").join(own("sub", "part"), ["sub", "scenario", *by], "left").na.fill(0.0, ["part"])
    return both.withColumn("broken", breaks(F.col("operator"), F.col("part"), F.col("share") * F.col("whole")))


def capacity_factors(flow_out: DataFrame, capacity: DataFrame, limits: DataFrame, to_activity: float) -> DataFrame:
    """LIM-4: yearly output against factor times capacity times conversion. limits: tech, operator, factor."""
    keys = ["scenario", "region", "period", "tech", "vintage"]
    out = capacity.join(limits, "tech").join(flow_out.groupBy(*keys).agg(F.sum("flow").alias("flow")), keys, "left").na.fill(0.0, ["flow"])
    return out.withColumn("allowed", F.col("factor") * F.col("capacity") * to_activity).withColumn("broken", breaks(F.col("operator"), F.col("flow"), F.col("allowed")))


def growth_limits(capacity: DataFrame, periods: DataFrame, group: Sequence[str], value: str, rate: float, seed: float, direction: str = "growth") -> DataFrame:
    """LIM-6: value at most seed + previous * (1 + rate), or for degrowth at least previous * (1 - rate) - seed; a period without rows counts 0."""
    sums = capacity.groupBy(*group, "period").agg(F.sum(value).alias("value"))
    spine = sums.select(*group).distinct().crossJoin(F.broadcast(periods.select("period").distinct()))
    rows = spine.join(sums, [*group, "period"], "left").na.fill(0.0, ["value"]).withColumn("previous", F.lag("value").over(W.partitionBy(*group).orderBy("period"))).where("previous is not null")
    bound = seed + F.col("previous") * (1 + rate) if direction == "growth" else F.col("previous") * (1 - rate) - seed
    return rows.withColumn("bound", bound).withColumn("broken", F.col("value") > F.col("bound") + 1e-6 if direction == "growth" else F.col("value") < F.col("bound") - 1e-6)


def split_limits(flow: DataFrame, limits: DataFrame, process: Sequence[str], comm: str) -> DataFrame:
    """LIM-7: each commodity's share of a process's flow against its limit. limits: tech, comm, operator, share."""
    sums = flow.groupBy(*process, comm).agg(F.sum("flow").alias("flow"))
    shares = sums.withColumn("own", F.col("flow") / F.sum("flow").over(W.partitionBy(*process)))
    return shares.join(limits, ["tech", comm]).withColumn("broken", breaks(F.col("operator"), F.col("own"), F.col("share")))


def reserve_margin(capacity: DataFrame, flow_out: DataFrame, reserve: DataFrame, margin: float) -> DataFrame:
    """LIM-8: per scenario, region and period, credited capacity of reserve technologies against their largest slice output, less exports, times 1 + margin. reserve: tech, credit."""
    own = capacity.where(~is_edge()).join(reserve, "tech").groupBy("scenario", "region", "period").agg(F.sum(F.col("capacity") * F.col("credit")).alias("available"))
    here = flow_out.join(reserve.select("tech"), "tech", "left_semi")
    made = here.withColumn("node", F.coalesce(edge_from(), F.col("region"))).groupBy("scenario", F.col("node").alias("region"), "period", "season", "tod").agg(F.sum(F.when(is_edge(), -F.col("flow")).otherwise(F.col("flow"))).alias("load"))
    peak = made.groupBy("scenario", "region", "period").agg(F.max("load").alias("load"))
    return own.join(peak, ["scenario", "region", "period"], "left").na.fill(0.0, ["load"]).withColumn("broken", F.col("available") < F.col("load") * (1 + margin) - 1e-6)


def portfolio_standard(flow_out: DataFrame, members: DataFrame, base: DataFrame, share: float) -> DataFrame:
    """LIM-9: output of the member technologies against a share of that of the base, per scenario, region and period."""
    flagged = flow_out.join(members.select("tech", F.lit(1).alias("m")), "tech", "left").join(base.select("tech", F.lit(1).alias("b")), "tech", "left")
    out = flagged.groupBy("scenario", "region", "period").agg(F.coalesce(F.sum(F.when(F.col("m") == 1, F.col("flow"))), F.lit(0.0)).alias("part"), F.coalesce(F.sum(F.when(F.col("b") == 1, F.col("flow"))), F.lit(0.0)).alias("whole"))
    return out.withColumn("broken", F.col("part") < share * F.col("whole") - 1e-6)


def slice_capacity(flow_out: DataFrame, capacity: DataFrame, segfrac: DataFrame, to_activity: float) -> DataFrame:
    """LIM-10: output of each slice against capacity times conversion times the slice's fraction."""
    keys = ["scenario", "region", "period", "tech", "vintage"]
    use = flow_out.groupBy(*keys, "season", "tod").agg(F.sum("flow").alias("flow")).join(capacity.select(*keys, "capacity"), keys).join(F.broadcast(segfrac.select("period", "season", "tod", "segfrac")), ["period", "season", "tod"])
    return use.withColumn("allowed", F.col("capacity") * to_activity * F.col("segfrac")).withColumn("broken", F.col("flow") > F.col("allowed") + 1e-6)


def demand_met(demand: DataFrame, flow_out: DataFrame, relative: float) -> DataFrame:
    """LIM-11: supply of each demand (by nodes and edges into its region) against it, per scenario."""
    made = flow_out.withColumn("region", F.coalesce(edge_to(), F.col("region"))).groupBy("scenario", "region", "period", F.col("output_comm").alias("commodity")).agg(F.sum("flow").alias("supplied"))
    every = demand.crossJoin(flow_out.select("scenario").distinct())
    out = every.join(made, ["scenario", "region", "period", "commodity"], "left").na.fill(0.0, ["supplied"])
    return out.withColumn("broken", F.abs(F.col("supplied") - F.col("demand")) > relative * F.col("demand"))


def storage_levels(charge: DataFrame, keys: Sequence[str], order: Sequence[str], efficiency: float, capacity: float) -> DataFrame:
    """LIM-13: level after each slice: running sum of efficiency * in - out; broken if it is negative or over the capacity."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    out = charge.withColumn("level", F.sum(efficiency * F.col("flow_in") - F.col("flow_out")).over(w))
    return out.withColumn("broken", (F.col("level") < -1e-6) | (F.col("level") > capacity + 1e-6))


def ramp_limits(flow_out: DataFrame, capacity: DataFrame, sequence: DataFrame, rate: float) -> DataFrame:
    """LIM-14: change of output from each slice to the next against a rate times capacity; absent output counts 0. sequence: period, season, tod, next_season, next_tod."""
    keys = ["scenario", "region", "period", "tech", "vintage"]
    sums = flow_out.groupBy(*keys, "season", "tod").agg(F.sum("flow").alias("flow"))
    steps = capacity.select(*keys, "capacity").join(F.broadcast(sequence), "period")
    nxt = sums.select(*keys, F.col("season").alias("next_season"), F.col("tod").alias("next_tod"), F.col("flow").alias("next_flow"))
    out = steps.join(sums, [*keys, "season", "tod"], "left").join(nxt, [*keys, "next_season", "next_tod"], "left").na.fill(0.0, ["flow", "next_flow"])
    return out.withColumn("change", F.col("next_flow") - F.col("flow")).withColumn("broken", F.abs("change") > rate * F.col("capacity") + 1e-6)


def asymmetric_exchange(capacity: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """LIM-15: edges whose capacity differs from that of the other direction."""
    keys = ["scenario", "period", "tech", "vintage"]
    own = capacity.where(is_edge())
    back = own.select(*keys, mirrored().alias("region"), F.col("capacity").alias("other"))
    return own.join(back, [*keys, "region"], "left").na.fill(0.0, ["other"]).where(F.abs(F.col("capacity") - F.col("other")) > tolerance)


def uneven_baseload(flow_out: DataFrame, baseload: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """LIM-15: baseload processes whose output differs between times of a season."""
    keys = ["scenario", "region", "period", "tech", "vintage", "season"]
    sums = flow_out.join(baseload.select("tech"), "tech", "left_semi").groupBy(*keys, "tod").agg(F.sum("flow").alias("flow"))
    return sums.groupBy(*keys).agg(F.min("flow").alias("least"), F.max("flow").alias("most")).where(F.col("most") - F.col("least") > tolerance)


def retirement_account(built: DataFrame, retired: DataFrame, net: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """LIM-16: net capacity against what was built less all retired up to the period. built: keys, capacity; retired: keys, period, capacity."""
    keys = ["scenario", "region", "tech", "vintage"]
    gone = net.select(*keys, "period", "capacity").join(retired.select(*keys, "period", F.col("capacity").alias("gone")), [*keys, "period"], "left").na.fill(0.0, ["gone"])
    run = gone.withColumn("gone", F.sum("gone").over(W.partitionBy(*keys).orderBy("period").rowsBetween(W.unboundedPreceding, 0)))
    out = run.join(built.select(*keys, F.col("capacity").alias("built")), keys)
    return out.withColumn("broken", F.abs(F.col("capacity") - (F.col("built") - F.col("gone"))) > tolerance)


def emission_limits(limits: DataFrame, found: DataFrame, regions: DataFrame, by: Sequence[str] = ("period", "emis_comm"), limit: str = "bound") -> DataFrame:
    """LIM-5: activity, embodied and end-of-life emissions of a limit's regions together against it. limits: region (a node, A+B or global), those of by, operator, limit; absent emissions count 0."""
    named = limits.withColumn("_limit", F.xxhash64(*limits.columns))
    members = expand_groups(named, regions).select("_limit", F.col("member").alias("region"), *by).distinct()
    sums = members.join(found.select("scenario", "region", *by, "emission"), ["region", *by]).groupBy("_limit", "scenario").agg(F.sum("emission").alias("emission"))
    every = named.crossJoin(found.select("scenario").distinct())  # scenarios: few
    out = every.join(sums, ["_limit", "scenario"], "left").na.fill(0.0, ["emission"]).drop("_limit")
    return out.withColumn("broken", breaks(F.col("operator"), F.col("emission"), F.col(limit)))


STORE = ("scenario", "region", "period", "tech", "vintage")


def storage_audit(flows: DataFrame, levels: DataFrame, capacity: DataFrame, storage: DataFrame, sequence: DataFrame, segfrac: DataFrame, days: float, tolerance: float = 1e-6) -> DataFrame:
    """LIM-13: findings per storage process and slice, each with its value and bound.

    state: level + charge - discharge is not the next slice's level; energy: the level exceeds capacity * to_activity * duration / 24 hours * the season's fraction (the same
    for a season of `days` days); charge, discharge, throughput (both): more than capacity * to_activity * the slice's fraction; negative: a level below 0.

    flows: STORE, season, tod, charge (times efficiency), discharge; levels: STORE, season, tod, level (before the slice); storage: tech, duration (hours), to_activity; sequence
    gives the next slice, which loops in its season or period; absent flows and levels count 0.
    """
    keys = [*STORE, "season", "tod"]
    rows = capacity.select(*STORE, "capacity").join(storage.select("tech", "duration", "to_activity"), "tech").join(sequence, "period").join(segfrac.select("period", "season", "tod", "segfrac"), ["period", "season", "tod"])
    season = segfrac.groupBy("period", "season").agg(F.sum("segfrac").alias("in_season"))
    rows = rows.join(season, ["period", "season"]).join(flows, keys, "left").join(levels.select(*keys, "level"), keys, "left")
    nxt = levels.select(*STORE, F.col("season").alias("next_season"), F.col("tod").alias("next_tod"), F.col("level").alias("next_level"))
    rows = rows.join(nxt, [*STORE, "next_season", "next_tod"], "left").na.fill(0.0, ["charge", "discharge", "level", "next_level"])
    power = F.col("capacity") * F.col("to_activity") * F.col("segfrac")
    energy = F.col("capacity") * F.col("to_activity") * F.col("duration") / (24 * days) * F.col("in_season") * days
    rule = lambda name, value, bound, bad: F.struct(F.lit(name).alias("finding"), value.cast("double").alias("value"), bound.cast("double").alias("bound"), bad.alias("bad"))
    over = lambda value, bound: value > bound + tolerance * F.greatest(F.lit(1.0), F.abs(bound))
    after = F.col("level") + F.col("charge") - F.col("discharge")
    rules = F.array(
        rule("state", after, F.col("next_level"), F.abs(after - F.col("next_level")) > tolerance * F.greatest(F.lit(1.0), F.abs(after))),
        rule("negative", F.col("level"), F.lit(0.0), F.col("level") < -tolerance),
        rule("energy", F.col("level"), energy, over(F.col("level"), energy)),
        rule("charge", F.col("charge"), power, over(F.col("charge"), power)),
        rule("discharge", F.col("discharge"), power, over(F.col("discharge"), power)),
        rule("throughput", F.col("charge") + F.col("discharge"), power, over(F.col("charge") + F.col("discharge"), power)),
    )
    return rows.select(*keys, F.explode(F.filter(rules, lambda r: r["bad"])).alias("r")).select(*keys, "r.finding", "r.value", "r.bound")


def slice_balance(made: DataFrame, used: DataFrame, commodity: DataFrame, keys: Sequence[str] = ("scenario", "region", "period", "season", "tod"), tolerance: float = 1e-6) -> DataFrame:
    """LIM-12: what is made and used of each commodity in each slice, and whether it is broken: unequal, or for waste commodities (flag w) more used than made. Sources (flag s) and demands (flag d) are not balanced.

    made and used: keys, commodity, flow; exchanges and material flows are further rows of either. For the annual form leave season and tod out of keys.
    """
    row = lambda df, sign: df.select(*keys, "commodity", F.when(F.lit(sign > 0), F.col("flow")).otherwise(0.0).alias("m"), F.when(F.lit(sign < 0), F.col("flow")).otherwise(0.0).alias("u"))
    sums = row(made, 1).unionByName(row(used, -1)).groupBy(*keys, "commodity").agg(F.sum("m").alias("made"), F.sum("u").alias("used"))
    out = sums.join(commodity.select(F.col("name").alias("commodity"), "flag"), "commodity", "left").where("flag is null or flag not in ('s', 'd')")
    slack = tolerance * F.greatest(F.lit(1.0), F.abs("made"), F.abs("used"))
    return out.withColumn("broken", F.when(F.col("flag") == "w", F.col("used") > F.col("made") + slack).otherwise(F.abs(F.col("made") - F.col("used")) > slack))


def exchange_rows(flow_out: DataFrame, flow_in: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flows as rows of slice_balance(): an edge's output is made where it ends, its input used where it begins."""
    made = flow_out.select("*", F.coalesce(edge_to(), F.col("region")).alias("_r")).drop("region").withColumnsRenamed({"_r": "region", "output_comm": "commodity"})
    used = flow_in.select("*", F.coalesce(edge_from(), F.col("region")).alias("_r")).drop("region").withColumnsRenamed({"_r": "region", "input_comm": "commodity"})
    return made, used


def slice_capacity_use(flow_out: DataFrame, curtailed: DataFrame, capacity: DataFrame, factors: DataFrame, segfrac: DataFrame, to_activity: float, tolerance: float = 1e-6) -> DataFrame:
    """LIM-10: output plus curtailment of each slice against factor * conversion * fraction * capacity. factors: STORE without scenario, season, tod, factor; 1 where absent."""
    keys = [*STORE, "season", "tod"]
    both = flow_out.select(*keys, "flow", F.lit(0.0).alias("lost")).unionByName(curtailed.select(*keys, F.lit(0.0).alias("flow"), F.col("flow").alias("lost")))
    use = both.groupBy(*keys).agg(F.sum("flow").alias("flow"), F.sum("lost").alias("curtailed"))
    use = use.join(capacity.select(*STORE, "capacity"), list(STORE)).join(segfrac.select("period", "season", "tod", "segfrac"), ["period", "season", "tod"]).join(factors, [*STORE[1:], "season", "tod"], "left").na.fill(1.0, ["factor"])
    allowed = F.col("factor") * F.col("capacity") * to_activity * F.col("segfrac")
    return use.withColumn("allowed", allowed).withColumn("broken", F.col("flow") + F.col("curtailed") > F.col("allowed") + tolerance)


def seasonal_capacity_factors(flow_out: DataFrame, capacity: DataFrame, limits: DataFrame, segfrac: DataFrame, regions: DataFrame, to_activity: float, limit: str = "factor") -> DataFrame:
    """LIM-4: a technology's output in a season over a limit's regions against factor * capacity * conversion * the season's fraction. limits: region (a node, A+B or global), season, tech, operator, factor."""
    named = limits.withColumn("_limit", F.xxhash64(*limits.columns))
    members = expand_groups(named, regions).select("_limit", F.col("member").alias("region"), "tech", "season").distinct()
    season = segfrac.groupBy("period", "season").agg(F.sum("segfrac").alias("fraction"))
    able = members.join(capacity.groupBy("scenario", "region", "period", "tech").agg(F.sum("capacity").alias("capacity")), ["region", "tech"]).join(season, ["period", "season"])
    able = able.groupBy("_limit", "scenario", "period").agg(F.sum(F.col("capacity") * to_activity * F.col("fraction")).alias("possible"))
    made = members.join(flow_out.groupBy("scenario", "region", "period", "tech", "season").agg(F.sum("flow").alias("flow")), ["region", "tech", "season"]).groupBy("_limit", "scenario", "period").agg(F.sum("flow").alias("flow"))
    out = named.join(able, "_limit").join(made, ["_limit", "scenario", "period"], "left").na.fill(0.0, ["flow"]).drop("_limit")
    return out.withColumn("allowed", F.col(limit) * F.col("possible")).withColumn("broken", breaks(F.col("operator"), F.col("flow"), F.col("allowed")))


def linked_output(flow_out: DataFrame, activity: DataFrame, links: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """LIM-15: slices where the output of a linked technology is not minus the emission activity of its primary one. links: region, tech, emis_comm, linked_tech."""
    keys = ["scenario", "region", "period", "season", "tod", "vintage"]
    rate = activity.join(links, ["region", "emis_comm", "tech"])
    primary = flow_out.join(rate, ["region", "input_comm", "tech", "vintage", "output_comm"]).groupBy(*keys, "tech", "emis_comm", "linked_tech").agg(F.sum(F.col("flow") * F.col("activity")).alias("emission"))
    linked = flow_out.join(links.select("region", "linked_tech", F.col("tech").alias("_primary"), "emis_comm"), (flow_out["region"] == links["region"]) & (flow_out["tech"] == links["linked_tech"])).drop(links["region"])
    linked = linked.groupBy(*keys, F.col("_primary").alias("tech"), "emis_comm", "linked_tech").agg(F.sum("flow").alias("flow"))
    both = primary.join(linked, [*keys, "tech", "emis_comm", "linked_tech"], "full").na.fill(0.0, ["emission", "flow"])
    return both.where(F.abs(F.col("emission") + F.col("flow")) > tolerance * F.greatest(F.lit(1.0), F.abs("emission"), F.abs("flow")))


def adjusted_capacity(built: DataFrame, retired: DataFrame, net: DataFrame, life: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """LIM-16: net capacity against (built less early retirements, each over what survives then) times the part of the period that is lived.

    built: scenario, region, tech, vintage, capacity; retired: those and period; net: both; life: region, period, tech, vintage, fraction (lived part, survival included), survival (at the period's start; 1 without a curve).
    """
    keys = ["scenario", "region", "tech", "vintage"]
    rows = net.select(*keys, "period", "capacity").join(life, ["region", "period", "tech", "vintage"]).join(retired.select(*keys, "period", F.col("capacity").alias("gone")), [*keys, "period"], "left").na.fill(0.0, ["gone"])
    run = rows.withColumn("gone", F.sum(F.when(F.col("period") > F.col("vintage"), F.col("gone") / F.col("survival")).otherwise(0.0)).over(W.partitionBy(*keys).orderBy("period").rowsBetween(W.unboundedPreceding, 0)))
    out = run.join(built.select(*keys, F.col("capacity").alias("built")), keys).withColumn("expected", (F.col("built") - F.col("gone")) * F.col("fraction"))
    return out.withColumn("broken", F.abs(F.col("capacity") - F.col("expected")) > tolerance * F.greatest(F.lit(1.0), F.abs("expected")))


def dynamic_reserve(capacity: DataFrame, flow_out: DataFrame, charge: DataFrame, reserve: DataFrame, factors: DataFrame, segfrac: DataFrame, margin: float, to_activity: float, tolerance: float = 1e-6) -> DataFrame:
    """LIM-8, dynamic: per slice, what reserve technologies could make (capacity * derate * factor * conversion * fraction; an edge helps where it ends) against what they make there, with imports, less exports and storage charging, times 1 + margin.

    reserve: tech, derate; factors: STORE without scenario, season, tod, factor (1 where absent); charge: scenario, region, period, season, tod, tech, flow.
    """
    place = ["scenario", "region", "period", "season", "tod"]
    able = capacity.join(reserve, "tech").join(segfrac.select("period", "season", "tod", "segfrac"), "period").join(factors, [*STORE[1:], "season", "tod"], "left").na.fill(1.0, ["factor"])
    able = able.withColumn("region", F.coalesce(edge_to(), F.col("region"))).groupBy(*place).agg(F.sum(F.col("capacity") * F.col("derate") * F.col("factor") * to_activity * F.col("segfrac")).alias("available"))
    here = flow_out.join(reserve.select("tech"), "tech", "left_semi").select(*place, "flow")
    sent = here.where(is_edge()).select("scenario", edge_from().alias("region"), "period", "season", "tod", (-F.col("flow")).alias("flow"))
    got = here.select("scenario", F.coalesce(edge_to(), F.col("region")).alias("region"), "period", "season", "tod", "flow")
    stored = charge.join(reserve.select("tech"), "tech", "left_semi").select(*place, (-F.col("flow")).alias("flow"))
    load = got.unionByName(sent).unionByName(stored).groupBy(*place).agg(F.sum("flow").alias("load"))
    out = able.join(load, place, "full").na.fill(0.0, ["available", "load"])
    return out.withColumn("broken", F.col("available") < F.col("load") * (1 + margin) - tolerance)


def demand_shares(flow_out: DataFrame, shares: DataFrame, annual: DataFrame | None = None, relative: float = 1e-6) -> DataFrame:
    """LIM-11, by slice: what each process makes of a demand in a slice against its output of the year times the demand's share of that slice; absent output counts 0.

    shares: region, period, season, tod, commodity, share; slices without a share, or with none above 0, are not held. An edge supplies the demand where it ends.
    annual: STORE, commodity, flow of processes that are solved by the year; without it the sum over slices.
    """
    keys = [*STORE, "commodity"]
    made = flow_out.withColumnRenamed("output_comm", "commodity")
    by_slice = made.groupBy(*keys, "season", "tod").agg(F.sum("flow").alias("flow"))
    year = (made if annual is None else annual).groupBy(*keys).agg(F.sum("flow").alias("year")).withColumn("_at", F.coalesce(edge_to(), F.col("region")))
    held = shares.where("share > 0").select(F.col("region").alias("_at"), "period", "season", "tod", "commodity", "share")
    out = year.join(held, ["_at", "period", "commodity"]).drop("_at").join(by_slice, [*keys, "season", "tod"], "left").na.fill(0.0, ["flow"])
    out = out.withColumn("expected", F.col("year") * F.col("share"))
    return out.withColumn("broken", F.abs(F.col("flow") - F.col("expected")) > relative * F.greatest(F.lit(1.0), F.abs("expected")))


def hourly_ramps(flow_out: DataFrame, capacity: DataFrame, sequence: DataFrame, segfrac: DataFrame, rates: DataFrame, days: float, to_activity: float, own_hours: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """LIM-14, by the hour: rise (up) or fall (down) of hourly output from each slice to the next against rate * hours between their middles * capacity * conversion.

    sequence: slice_sequence(slices, 'season') within seasons, season_sequence(slices) between them. rates: region, tech, direction (up or down), rate (part of capacity an hour). A rate that
    reaches the whole capacity in the hours between cannot bind and gives no row. Output a slice is divided by the hours of the step's first slice on both sides, or with own_hours by those of
    its own slice; absent output counts 0.
    """
    season = W.partitionBy("period", "season")
    part = segfrac.select("period", "season", "tod", "segfrac", (F.col("segfrac") / F.sum("segfrac").over(season)).alias("of_season"))
    ahead = part.withColumnsRenamed({c: f"next_{c}" for c in ("season", "tod", "segfrac", "of_season")})
    steps = sequence.select("period", "season", "tod", "next_season", "next_tod").join(part, ["period", "season", "tod"]).join(ahead, ["period", "next_season", "next_tod"])
    hours = 24 * days * F.col("segfrac")
    steps = steps.withColumns({"hours": hours, "next_hours": 24 * days * F.col("next_segfrac") if own_hours else hours, "between": 12 * (F.col("of_season") + F.col("next_of_season"))})
    sums = flow_out.groupBy(*STORE, "season", "tod").agg(F.sum("flow").alias("flow"))
    later = sums.select(*STORE, F.col("season").alias("next_season"), F.col("tod").alias("next_tod"), F.col("flow").alias("next_flow"))
    rows = capacity.select(*STORE, "capacity").join(rates.select("region", "tech", "direction", "rate"), ["region", "tech"]).join(steps, "period").where("rate * between < 1")
    rows = rows.join(sums, [*STORE, "season", "tod"], "left").join(later, [*STORE, "next_season", "next_tod"], "left").na.fill(0.0, ["flow", "next_flow"])
    now, then = F.col("flow") / F.col("hours"), F.col("next_flow") / F.col("next_hours")
    out = rows.withColumn("change", F.when(F.col("direction") == "up", then - now).otherwise(now - then)).withColumn("allowed", F.col("rate") * F.col("between") * F.col("capacity") * to_activity)
    out = out.withColumn("broken", F.col("change") > F.col("allowed") + tolerance * F.greatest(F.lit(1.0), F.col("allowed")))
    return out.select(*STORE, "season", "tod", "next_season", "next_tod", "direction", "change", "allowed", "broken")


def annual_retirement(net: DataFrame, existing: DataFrame, lifetime: DataFrame, life: DataFrame, horizon: DataFrame, solved: DataFrame | None = None, tolerance: float = 1e-6) -> DataFrame:
    """LIM-16, annual: capacity that a process loses a year in each period, its end of life included: (start - end) / length.

    Start: net capacity over the lived part of the period, times what survives at its start; in the period that starts just as the life ends, the same from the period before, and in the first
    period the existing capacity. End: 0 where the life ends within the period; else the next period's start, or, where that has no capacity of its own (the horizon ends or the life does), the start
    carried on down the survival curve.

    net: STORE, capacity; existing: scenario, region, tech, vintage, capacity; lifetime: region, tech, vintage, lifetime; life: region, period, tech, vintage, fraction, survival (1 where absent, up
    to the horizon's end); horizon: period, length, where the last period only ends it and has no length. With solved (STORE, retirement; 0 where absent) `broken` says where it differs.
    """
    keys = ["scenario", "region", "tech", "vintage"]
    own = W.partitionBy(*keys).orderBy("period")
    spans = horizon.select("period", "length")
    last = spans.where("length is not null").agg(F.min("period").alias("_first"), F.max("period").alias("_last"))
    built = net.select(*keys).union(existing.select(*keys)).distinct().join(lifetime.select("region", "tech", "vintage", "lifetime"), keys[1:])
    rows = built.join(spans, F.col("vintage") <= F.col("period")).join(last, F.lit(True))  # a row a period; one row
    rows = rows.join(net.select(*STORE, "capacity"), list(STORE), "left").join(life.select("region", "period", "tech", "vintage", "fraction", "survival"), list(STORE[1:]), "left")
    rows = rows.join(existing.select(*keys, F.col("capacity").alias("_old")), keys, "left").na.fill(0.0, ["capacity", "_old"]).na.fill(1.0, ["fraction", "survival"])
    whole, ends = F.col("capacity") / F.col("fraction"), F.col("vintage") + F.col("lifetime")
    rows = rows.withColumns({"_whole": whole, "_ends": ends, "_was": F.lag(whole).over(own), "_next": F.lead("period").over(own), "_next_whole": F.lead(whole).over(own), "_next_survival": F.lead("survival").over(own)})
    rows = rows.where("length is not null and period <= _ends")
    at_end = F.col("period") == F.col("_ends")
    start = F.when(~at_end, F.col("_whole")).when(F.col("period") == F.col("_first"), F.col("_old")).otherwise(F.coalesce("_was", F.lit(0.0))) * F.col("survival")
    carried = (F.col("period") == F.col("_last")) | (F.col("_next") == F.col("_ends"))
    rows = rows.withColumn("start", start)
    down = F.when(F.col("survival") == 0, 0.0).otherwise(F.col("start") * F.col("_next_survival") / F.col("survival"))
    rows = rows.withColumn("end", F.when(F.col("_ends") < F.col("period") + F.col("length"), 0.0).when(carried, down).otherwise(F.col("_next_whole") * F.col("_next_survival")))
    out = rows.select(*STORE, "start", "end", ((F.col("start") - F.col("end")) / F.col("length")).alias("retirement"))
    if solved is None:
        return out
    out = out.join(solved.select(*STORE, F.col("retirement").alias("solved")), list(STORE), "left").na.fill(0.0, ["solved"])
    return out.withColumn("broken", F.abs(F.col("solved") - F.col("retirement")) > tolerance * F.greatest(F.lit(1.0), F.abs("retirement")))
