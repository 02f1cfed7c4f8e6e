"""Derived model datasets (DER-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PROCESS = ("region", "tech", "vintage")


def lifetimes(processes: DataFrame, by_process: DataFrame, by_tech: DataFrame, default: float) -> DataFrame:
    """DER-1: lifetime of each process: its own, else its technology's in the region, else the default."""
    own = by_process.select(*PROCESS, F.col("lifetime").alias("_own"))
    tech = by_tech.select("region", "tech", F.col("lifetime").alias("_tech"))
    return processes.join(own, list(PROCESS), "left").join(tech, ["region", "tech"], "left").withColumn("lifetime", F.coalesce("_own", "_tech", F.lit(default))).drop("_own", "_tech")


def period_lengths(periods: DataFrame) -> DataFrame:
    """DER-2: years to the next period; the last, which only ends the horizon, has none."""
    return periods.select("period").distinct().withColumn("length", F.lead("period").over(W.orderBy("period")) - F.col("period"))  # a row a period


def active(processes: DataFrame, periods: DataFrame, existing: DataFrame | None = None, efficiency: str | None = None) -> DataFrame:
    """DER-3: processes(region, tech, vintage, lifetime) in each period in which they live: vintage <= period < vintage + lifetime.

    existing: processes with capacity from before the first period; others of such a vintage do not live. Zero efficiencies are left out.
    """
    rows = processes if efficiency is None else processes.where(F.col(efficiency) != 0)
    if existing is not None:
        first = periods.agg(F.min("period").alias("_first"))
        rows = rows.crossJoin(F.broadcast(first))  # one row
        old = rows.where("vintage < _first").join(existing.select(*PROCESS).distinct(), list(PROCESS), "left_semi")
        rows = rows.where("vintage >= _first").unionByName(old).drop("_first")
    alive = (F.col("vintage") <= F.col("period")) & (F.col("period") < F.col("vintage") + F.col("lifetime"))
    return rows.join(F.broadcast(periods.select("period").distinct()), alive)  # a row a period


def retirements(processes: DataFrame, periods: DataFrame) -> DataFrame:
    """DER-4: the period in which each process ends of itself: period <= vintage + lifetime < period + length; early: later periods of its life, if it may retire early."""
    spans = period_lengths(periods).where("length is not null")
    end = F.col("vintage") + F.col("lifetime")
    natural = processes.join(F.broadcast(spans), (F.col("period") <= end) & (end < F.col("period") + F.col("length"))).withColumn("kind", F.lit("end"))
    early = processes.join(F.broadcast(spans), (F.col("vintage") < F.col("period")) & (F.col("period") + F.col("length") <= end) & (F.col("may_retire") == 1)).withColumn("kind", F.lit("early"))
    return natural.unionByName(early)


def life_fraction(vintage: Column, lifetime: Column, period: Column, length: Column) -> Column:
    """DER-5: the part of a period in which a process lives."""
    return F.least(F.lit(1.0), (vintage + lifetime - period) / length)


def slice_index(active_rows: DataFrame, efficiency: DataFrame, slices: DataFrame, technology: DataFrame) -> DataFrame:
    """DER-6: active processes by input, output and slice; annual technologies have no slice. kind: flow, curtail, flex (one row each that applies)."""
    keys = list(PROCESS)
    rows = active_rows.select(*keys, "period").join(efficiency.select(*keys, "input_comm", "output_comm"), keys).join(technology.select("tech", "annual", "curtail", "flex"), "tech")
    by_slice = rows.where("annual = 0").join(F.broadcast(slices.select("period", "season", "tod").distinct()), "period")
    annual = rows.where("annual = 1").withColumns({"season": F.lit(None).cast("string"), "tod": F.lit(None).cast("string")})
    kinds = F.explode(F.array_compact(F.array(F.lit("flow"), F.when(F.col("curtail") == 1, "curtail"), F.when(F.col("flex") == 1, "flex"))))
    return by_slice.unionByName(annual).select(*keys, "period", "season", "tod", "input_comm", "output_comm", kinds.alias("kind"))


def flow_index(active_rows: DataFrame, efficiency: DataFrame, slices: DataFrame, technology: DataFrame, commodity: DataFrame, stored_seasons: DataFrame | None = None) -> DataFrame:
    """DER-6: every variant of the flow index as rows of a kind, with null where the variant has no input, output, season or time.

    By slice: flow and flex (not annual), curtail, storage_in and, without input and output, storage_level. By year: flow_annual (annual technologies, and demand technologies for demand
    commodities), flex_annual, and, without input and output, activity (every process) and capacity (those with a limit). By season of stored_seasons (period, season): seasonal_level.
    technology: tech and the flags annual, flex, curtail, storage, seasonal, demand, unlim_cap (0 or 1); commodity: name, flag (d for demand).
    """
    keys = [*PROCESS, "period"]
    flags = technology.select("tech", "annual", "flex", "curtail", "storage", "seasonal", "demand", "unlim_cap")
    own = active_rows.select(*keys).distinct().join(flags, "tech")
    wanted = commodity.where("flag = 'd'").select(F.col("name").alias("output_comm"), F.lit(1).alias("_d")).distinct()
    uses = own.join(efficiency.select(*PROCESS, "input_comm", "output_comm").distinct(), list(PROCESS)).join(wanted, "output_comm", "left")
    kind = lambda name, by_slice, test: F.when(test, F.struct(F.lit(name).alias("kind"), F.lit(by_slice).alias("by_slice")))
    on = lambda c: F.col(c) == 1
    kinds = F.explode(F.array_compact(F.array(
        kind("flow", True, ~on("annual")), kind("flow_annual", False, on("annual") | (on("demand") & on("_d"))), kind("flex", True, ~on("annual") & on("flex")), kind("flex_annual", False, on("annual") & on("flex")),
        kind("curtail", True, on("curtail")), kind("storage_in", True, on("storage")),
    ))).alias("k")
    states = F.explode(F.array_compact(F.array(kind("activity", False, F.lit(True)), kind("capacity", False, ~on("unlim_cap")), kind("storage_level", True, on("storage"))))).alias("k")
    none = lambda c: F.lit(None).cast("string").alias(c)
    rows = uses.select(*keys, "input_comm", "output_comm", kinds).unionByName(own.select(*keys, none("input_comm"), none("output_comm"), states)).select(*keys, "input_comm", "output_comm", "k.*")
    out = rows.where("by_slice").join(slices.select("period", "season", "tod").distinct(), "period").unionByName(rows.where("not by_slice").select("*", none("season"), none("tod"))).drop("by_slice")
    if stored_seasons is None:
        return out
    level = own.where("storage = 1 and seasonal = 1").join(stored_seasons.select("period", "season").distinct(), "period")
    return out.unionByName(level.select(*keys, none("input_comm"), none("output_comm"), F.lit("seasonal_level").alias("kind"), "season", none("tod")))


def resolve_factor(rows: DataFrame, by_process: DataFrame, by_tech: DataFrame, process_keys: Sequence[str], tech_keys: Sequence[str], value: str = "factor", default: float = 1.0) -> DataFrame:
    """DER-7: a process value, else the technology's, else the default."""
    own, tech = by_process.select(*process_keys, F.col(value).alias("_own")), by_tech.select(*tech_keys, F.col(value).alias("_tech"))
    return rows.join(own, list(process_keys), "left").join(tech, list(tech_keys), "left").withColumn(value, F.coalesce("_own", "_tech", F.lit(default))).drop("_own", "_tech")


def season_fraction(segfrac: DataFrame) -> DataFrame:
    """DER-9: summed slice fractions by period and season."""
    return segfrac.groupBy("period", "season").agg(F.sum("segfrac").alias("fraction"))


def windows(periods: DataFrame, depth: int, step: int) -> DataFrame:
    """DER-10: rolling windows: base, step to the next base, last demand period and last year, each `depth` periods long (less at the end), a window every `step` periods.

    The last period only ends the horizon.
    """
    ordered = periods.agg(F.sort_array(F.collect_set("period")).alias("p"))  # a row a period
    n = F.size("p")
    base = ordered.withColumn("k", F.explode(F.sequence(F.lit(0), n - 2, F.lit(step))))
    last = F.least(F.col("k") + depth, n - 1)
    at = lambda i: F.get("p", i)
    out = base.select("k", at(F.col("k")).alias("base_year"), at(F.least(F.col("k") + step, n - 1)).alias("step_year"), at(last - 1).alias("last_demand_year"), at(last).alias("last_year"), (last == n - 1).alias("ends"))
    return out.withColumn("_seen", F.sum(F.col("ends").cast("int")).over(W.orderBy("k").rowsBetween(W.unboundedPreceding, -1))).where("coalesce(_seen, 0) = 0").drop("_seen", "k", "ends")


def carry_forward(table: DataFrame, alive: DataFrame, technology: DataFrame, base: int, last: int) -> DataFrame:
    """DER-11: rows of earlier vintages that still have capacity or are uncapped, and the vintages of the window."""
    old = table.where(F.col("vintage") < base)
    keep = old.join(alive.select(*PROCESS).distinct(), list(PROCESS), "left_semi")
    free = old.join(technology.where("unlim_cap = 1").select("tech"), "tech", "left_semi").join(alive.select(*PROCESS).distinct(), list(PROCESS), "left_anti")
    return keep.unionByName(free).unionByName(table.where(F.col("vintage").between(base, last)))


def constraint_domains(active_rows: DataFrame, efficiency: DataFrame, slices: DataFrame, technology: DataFrame, demand: DataFrame, commodity: DataFrame) -> DataFrame:
    """DER-12: the keys at which each rule applies: rule, region, period, tech, vintage, commodity, season, tod (null where the rule has none).

    Per slice: capacity (processes that are not annual), baseload, storage, ramp, balance (commodities of a node that some active process there takes or makes; annual ones, flag a, once a
    period as `annual balance`). Per period: annual capacity, exchange (edges whose other direction is active too), demand, growth (a row a technology).
    active_rows: region, tech, vintage, period; technology: tech, annual, baseload, storage, ramp (0 or 1); demand: region, period, commodity; commodity: name, flag.
    """
    from gridloom.operators.regions import edge_from, edge_to, is_edge, mirrored

    columns = ("region", "period", "tech", "vintage", "commodity", "season", "tod")
    times = slices.select("period", "season", "tod").distinct()

    def rows(rule: str, df: DataFrame, by_slice: bool = False) -> DataFrame:
        df = df.join(times, "period") if by_slice else df
        kinds = {"vintage": "int"} | dict.fromkeys(("tech", "commodity", "season", "tod"), "string")
        return df.select(F.lit(rule).alias("rule"), *(F.col(c) if c in df.columns else F.lit(None).cast(kinds[c]).alias(c) for c in columns))

    own = active_rows.select(*PROCESS, "period").distinct().join(technology.select("tech", "annual", "baseload", "storage", "ramp"), "tech")
    back = own.select(mirrored().alias("region"), "tech", "vintage", "period")
    uses = own.join(efficiency.select(*PROCESS, "input_comm", "output_comm"), list(PROCESS))
    ends = uses.select("period", F.explode(F.array(F.struct(F.coalesce(edge_from(), F.col("region")).alias("region"), F.col("input_comm").alias("commodity")), F.struct(F.coalesce(edge_to(), F.col("region")).alias("region"), F.col("output_comm").alias("commodity")))).alias("e")).select("e.region", "period", "e.commodity").distinct()
    ends = ends.join(commodity.select(F.col("name").alias("commodity"), "flag"), "commodity")
    parts = [
        rows("capacity", own.where("annual = 0"), True), rows("annual capacity", own.where("annual = 1")), *(rows(k, own.where(F.col(k) == 1), True) for k in ("baseload", "storage", "ramp")),
        rows("exchange", own.where(is_edge()).join(back, [*PROCESS, "period"], "left_semi")), rows("demand", demand.select("region", "period", "commodity").distinct()),
        rows("balance", ends.where("flag <> 'a'"), True), rows("annual balance", ends.where("flag = 'a'")), rows("growth", own.select("region", "period", "tech").distinct()),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
