"""Analytics of solved results: flows, balances, capacities, costs, emissions, comparisons (RES-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.joins import EPSILON, distributed_median, gaps, union
from gridloom.operators.regions import edge_from, edge_to, is_edge, mirrored

LINK = ("scenario", "region", "period", "input_comm", "tech", "vintage", "output_comm")
NODE = ("scenario", "period", "region", "commodity")


def flow_summary(flow_out: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """RES-14: flow per link and period, over all slices; sums below epsilon go."""
    return flow_out.groupBy(*LINK).agg(F.sum("flow").alias("flow")).where(F.abs("flow") >= epsilon)


def process_balance(flow_in: DataFrame, flow_out: DataFrame, other: DataFrame | None = None, tolerance: float = 0.02, keys: Sequence[str] = LINK[:-1]) -> DataFrame:
    """RES-15: in, out, lost and the residual in - out - lost per process; failed if it exceeds tolerance times the input, or tolerance itself with no input.

    other: further losses (flex, curtailment) with columns keys and flow.
    """
    parts = [flow_in.select(*keys, F.lit("i").alias("k"), "flow"), flow_out.select(*keys, F.lit("o").alias("k"), "flow")]
    if other is not None:
        parts.append(other.select(*keys, F.lit("l").alias("k"), "flow"))
    total = lambda k: F.coalesce(F.sum(F.when(F.col("k") == k, F.col("flow"))), F.lit(0.0))
    out = union(*parts).groupBy(*keys).agg(total("i").alias("flow_in"), total("o").alias("flow_out"), total("l").alias("lost"))
    residual = F.col("flow_in") - F.col("flow_out") - F.col("lost")
    return out.withColumn("residual", residual).withColumn("failed", F.abs("residual") > F.when(F.col("flow_in") > 0, tolerance * F.col("flow_in")).otherwise(tolerance))


PARTS = ("production", "imports", "consumption", "exports", "demand")


def balanced(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sums of signed parts (keys, part, amount), their residual and scale."""
    out = parts.groupBy(*keys).agg(*(F.coalesce(F.sum(F.when(F.col("part") == n, F.col("amount"))), F.lit(0.0)).alias(n) for n in PARTS))
    supply, use = F.col("production") + F.col("imports"), F.col("consumption") + F.col("exports") + F.col("demand")
    return out.withColumn("residual", supply - use).withColumn("scale", F.greatest(F.abs(supply), F.abs(use)))


def needed(demand: DataFrame, scenarios: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Demand as a part of every scenario."""
    every = demand.crossJoin(scenarios.select("scenario").distinct())  # scenarios: few
    return every.select("scenario", "period", "region", "commodity", *(F.col(k) if k in demand.columns else F.lit(None).cast("string").alias(k) for k in extra), F.lit("demand").alias("part"), F.col("demand").alias("amount"))


def side(commodity: str, amount: str, end: Column, at_node: str, at_edge: str) -> list[Column]:
    """Where a flow counts and as what: at its node, or at the end of its edge."""
    return [F.coalesce(end, F.col("region")).alias("region"), F.col(commodity).alias("commodity"), F.when(is_edge(), at_edge).otherwise(at_node).alias("part"), F.col(amount).alias("amount")]


def node_balance(flow_out: DataFrame, flow_in: DataFrame, demand: DataFrame, keys: Sequence[str] = NODE, scenarios: DataFrame | None = None) -> DataFrame:
    """RES-16: what each node makes, gets, uses, sends and needs of each commodity, in one pass over signed parts.

    An edge's output is an export of its origin (of the input commodity) and an import of its target. Demand counts in every scenario (those of flow_out, unless given).
    """
    extra = [k for k in keys if k not in NODE]
    made = flow_out.select("scenario", "period", *extra, *side("output_comm", "flow", edge_to(), "production", "imports"))
    used = flow_in.select("scenario", "period", *extra, *side("input_comm", "flow", edge_from(), "consumption", "exports"))
    return balanced(union(made, used, needed(demand, flow_out if scenarios is None else scenarios, extra)), keys)


def node_balance_of(flows: DataFrame, demand: DataFrame, scenarios: DataFrame, keys: Sequence[str] = NODE) -> DataFrame:
    """RES-16 where one table holds both sides of each process (columns made and drawn): it is read once, and each row gives both of its parts."""
    extra = [k for k in keys if k not in NODE]
    both = F.array(F.struct(*side("output_comm", "made", edge_to(), "production", "imports")), F.struct(*side("input_comm", "drawn", edge_from(), "consumption", "exports")))
    parts = flows.select("scenario", "period", *extra, F.explode(both).alias("p")).select("scenario", "period", *extra, "p.*")
    return balanced(union(parts, needed(demand, scenarios, extra)), keys)


def balance_verdict(balance: DataFrame, commodity: DataFrame, excluded: Sequence[str], absolute: float, relative: float) -> DataFrame:
    """RES-17: fails where the residual exceeds both tolerances; commodities of an excluded flag are left out, those without a flag stay."""
    flags = commodity.select(F.col("name").alias("commodity"), "flag")
    joined = balance.join(flags, "commodity", "left").where(F.col("flag").isNull() | ~F.col("flag").isin(*excluded))  # flags: a row a commodity name
    return joined.withColumn("failed", (F.abs("residual") > absolute) & (F.abs("residual") > relative * F.col("scale")))


def edge_technologies(tables: dict[str, DataFrame]) -> DataFrame:
    """RES-18: which tables mention each technology on edges, one boolean column a table."""
    rows = union(*(df.where(is_edge()).select("tech", F.lit(name).alias("source")).distinct() for name, df in tables.items()))
    return rows.groupBy("tech").agg(*(F.max(F.col("source") == n).alias(n) for n in tables))


def edge_flow_summary(flow_out: DataFrame) -> DataFrame:
    """RES-19: rows and total of positive flow per technology on edges."""
    return flow_out.where(is_edge() & (F.col("flow") > 0)).groupBy("tech").agg(F.count("*").alias("n_rows"), F.sum("flow").alias("flow"))


def edge_flow_capacity(flow_out: DataFrame, net_capacity: DataFrame, strict: bool = False) -> DataFrame:
    """RES-20: annual edge flows without capacity; strict: also those above it."""
    keys = ["scenario", "region", "period", "tech", "vintage"]
    flow = flow_out.where(is_edge()).groupBy(*keys).agg(F.sum("flow").alias("flow")).where("flow > 0")
    both = flow.join(net_capacity.select(*keys, "capacity"), keys, "left")
    none = both.where(F.coalesce("capacity", F.lit(0.0)) <= 0).withColumn("reason", F.lit("no capacity"))
    return none.unionByName(both.where((F.col("capacity") > 0) & (F.col("flow") > F.col("capacity"))).withColumn("reason", F.lit("exceeds"))) if strict else none


def reconcile_objective(objective: DataFrame, costs: DataFrame, absolute: float = 1.0, relative: float = 1e-4) -> DataFrame:
    """RES-21: objective against discounted and raw cost sums; convention says which it meets."""
    total = lambda cols: sum((F.coalesce(F.sum(c), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.sum(cols[0]), F.lit(0.0)))
    sums = costs.groupBy("scenario").agg(total(["d_invest", "d_fixed", "d_var", "d_emiss"]).alias("discounted"), total(["invest", "fixed", "var", "emiss"]).alias("raw"))
    out = objective.join(sums, "scenario", "left")
    meets = lambda c: F.abs(F.col("total_system_cost") - F.col(c)) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs("total_system_cost"), F.abs(c)))
    return out.withColumn("convention", F.when(meets("discounted"), "discounted").when(meets("raw"), "raw").otherwise("neither"))


def largest(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    """RES-22: the n rows of largest size, ties by further columns."""
    return df.orderBy(F.abs(column).desc(), *ties).limit(n)


def injection(flow_out: DataFrame, tech_pattern: str) -> DataFrame:
    """RES-23: flow of injecting technologies summed by scenario, period, region and commodity; null keys stay."""
    return flow_out.where(F.col("tech").rlike(tech_pattern)).groupBy("scenario", "period", "region", F.col("output_comm").alias("commodity")).agg(F.sum("flow").alias("injected"))


def period_pivot(df: DataFrame, technology: DataFrame, sector: str, value: str, periods: Sequence[int]) -> DataFrame:
    """RES-24: a column a period for every known technology of a sector, 0 where it has nothing."""
    known = technology.where(F.col("sector") == sector).select("tech")
    sums = df.groupBy("tech").pivot("period", list(periods)).agg(F.sum(value))
    return known.join(sums, "tech", "left").na.fill(0.0, [str(p) for p in periods])


def long_format(df: DataFrame, technology: DataFrame, kind: str, value: str) -> DataFrame:
    """RES-25: variable `kind|sector|tech` with its sums, and `kind|sector` parents, by grouping sets."""
    rows = df.join(technology.select("tech", "sector"), "tech")  # a row a technology
    out = rows.groupingSets([["scenario", "region", "period", "sector", "tech"], ["scenario", "region", "period", "sector"]], "scenario", "region", "period", "sector", "tech")
    return out.agg(F.sum(value).alias("value")).select("scenario", "region", "period", F.concat_ws("|", F.lit(kind), "sector", "tech").alias("variable"), "value")


def capacity_by_period(net_capacity: DataFrame, region: str | None = None) -> DataFrame:
    """RES-26: capacity by technology and period; an edge counts half unless a region is chosen, which then takes its own rows and its edges'."""
    if region is None:
        amount = F.when(is_edge(), F.col("capacity") / 2).otherwise(F.col("capacity"))
        return net_capacity.groupBy("scenario", "tech", "period").agg(F.sum(amount).alias("capacity"))
    own = (F.col("region") == region) | (edge_from() == region) | (edge_to() == region)
    return net_capacity.where(own).groupBy("scenario", "tech", "period").agg(F.sum("capacity").alias("capacity"))


def process_flows(flow_in: DataFrame, flow_out: DataFrame, net_capacity: DataFrame) -> DataFrame:
    """RES-27: in, out and capacity per scenario, period and technology, each side summed before the join."""
    keys = ["scenario", "period", "tech"]
    one = lambda df, value, name: df.groupBy(*keys).agg(F.sum(value).alias(name))
    return one(flow_in, "flow", "flow_in").join(one(flow_out, "flow", "flow_out"), keys, "full").join(one(net_capacity, "capacity", "capacity"), keys, "full").na.fill(0.0, ["flow_in", "flow_out", "capacity"])


def flow_emissions(flow_out: DataFrame, emission_activity: DataFrame) -> DataFrame:
    """RES-27, RES-11: emission of each process: flow times its activity rate."""
    keys = ["region", "input_comm", "tech", "vintage", "output_comm"]
    return flow_out.join(emission_activity, keys).groupBy("scenario", "region", "period", "emis_comm", "tech", "vintage").agg(F.sum(F.col("flow") * F.col("activity")).alias("emission"))


def commodities_where(efficiency: DataFrame, flow_out: DataFrame, region: str | None = None, period: int | None = None, tech: str | None = None) -> DataFrame:
    """RES-28: distinct (tech, input, output) with flow under the given conditions."""
    out = flow_out.join(efficiency.select("region", "input_comm", "tech", "vintage", "output_comm"), ["region", "input_comm", "tech", "vintage", "output_comm"], "left_semi")
    for name, value in (("region", region), ("period", period), ("tech", tech)):
        if value is not None:
            out = out.where(F.col(name) == value)
    return out.select("tech", "input_comm", "output_comm").distinct()


def map_flows(flow_out: DataFrame, places: DataFrame) -> DataFrame:
    """RES-29: edge flows per scenario, period and technology with both ends' coordinates; places(region, x, y) is a row a node."""
    flows = flow_out.where(is_edge()).groupBy("scenario", "region", "period", "tech").agg(F.sum("flow").alias("flow"))
    a, b = (places.select(F.col("region").alias(f"region_{s}"), F.col("x").alias(f"x_{s}"), F.col("y").alias(f"y_{s}")) for s in ("from", "to"))
    flows = flows.withColumns({"region_from": edge_from(), "region_to": edge_to()})
    return flows.join(a, "region_from").join(b, "region_to")


def sqrt_scaled(df: DataFrame, value: str, low: float, high: float, out: str = "width") -> DataFrame:
    """RES-30: between low and high by the square root of value; the midpoint if all values are alike."""
    bounds = df.agg(F.sqrt(F.min(value)).alias("_lo"), F.sqrt(F.max(value)).alias("_hi"))
    part = (F.sqrt(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, F.when(F.col("_hi") > F.col("_lo"), low + (high - low) * part).otherwise((low + high) / 2)).drop("_lo", "_hi")  # one row


def grid_spacing(points: DataFrame, x: str = "lon", y: str = "lat") -> DataFrame:
    """RES-31: the smaller of the median positive gaps between distinct coordinates of either axis, one row."""
    return union(*(distributed_median(gaps(points, axis).where("gap > 0"), "gap") for axis in (x, y))).agg(F.min("median").alias("spacing"))


def compare_scenarios(df: DataFrame, keys: Sequence[str], value: str, base: str, other: str) -> DataFrame:
    """RES-32: totals in two scenarios, their difference and change in percent; the change is null if either total is 0 or absent."""
    total = lambda s: F.sum(F.when(F.col("scenario") == s, F.col(value)))
    out = df.where(F.col("scenario").isin(base, other)).groupBy(*keys).agg(total(base).alias("base"), total(other).alias("other"))
    change = F.when((F.col("base") != 0) & (F.col("other") != 0), 100 * (F.col("other") - F.col("base")) / F.col("base"))
    return out.withColumn("difference", F.coalesce("other", F.lit(0.0)) - F.coalesce("base", F.lit(0.0))).withColumn("change_pct", change)


def concentration(df: DataFrame, keys: Sequence[str], value: str, share: float = 0.05, ties: Sequence[str] = ()) -> DataFrame:
    """RES-33: per key, rows, total, and how many of the smallest rows together make at most `share` of it."""
    own = W.partitionBy(*keys)
    run = F.sum(value).over(own.orderBy(value, *ties).rowsBetween(W.unboundedPreceding, 0))
    part = df.withColumn("_share", run / F.sum(value).over(own))
    return part.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.count_if(F.col("_share") <= share).alias("n_smallest"))


def objective_histogram(df: DataFrame, value: str) -> DataFrame:
    """RES-34: counts in ceil(sqrt(n)) bins of equal width; the largest value falls into the last bin."""
    bounds = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.ceil(F.sqrt(F.count(value))).cast("int").alias("_n"))
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.col("_n")).cast("int"), F.col("_n") - 1)
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).select(F.when(F.col("_hi") > F.col("_lo"), at).otherwise(0).alias("bin"))  # one row
    return placed.groupBy("bin").agg(F.count("*").alias("n"))


def exchange_costs(costs: DataFrame, flow_out: DataFrame) -> DataFrame:
    """RES-12: cost of each exchange link given to regions.

    Both directions costed: each importer takes its link's cost. One only: the cost is split by each side's share of the two flows, half and half without flow.
    costs: link, period, tech, vintage, cost; flows are summed over the same keys. Several cost rows of one link add up.
    """
    keys = ["period", "tech", "vintage"]
    amount = lambda df, link, cost, flow: df.select(F.col(link).alias("link"), *keys, cost.cast("double").alias("cost"), flow.cast("double").alias("flow"))
    rows = union(amount(costs, "link", F.col("cost"), F.lit(None)), amount(flow_out.where(is_edge()), "region", F.lit(None), F.col("flow")))
    # both directions of a link in one group: no self join
    one = rows.select("*", F.least("link", mirrored("link")).alias("pair"), (F.col("link") <= mirrored("link")).alias("ahead"))
    total = lambda c, ahead: F.sum(F.when(F.col("ahead") == ahead, F.col(c)))
    pairs = one.groupBy("pair", *keys).agg(*(total(c, a).alias(f"{c}_{n}") for c in ("cost", "flow") for a, n in ((True, "ahead"), (False, "back"))))
    way = lambda link, n, m: F.struct(link.alias("link"), F.col(f"cost_{n}").alias("cost"), F.col(f"cost_{m}").isNotNull().alias("both"), F.coalesce(f"flow_{n}", F.lit(0.0)).alias("flow"), F.coalesce(f"flow_{m}", F.lit(0.0)).alias("back_flow"))
    all_ = pairs.select(*keys, F.explode(F.array(way(F.col("pair"), "ahead", "back"), way(mirrored("pair"), "back", "ahead"))).alias("w")).select(*keys, "w.*").where("cost is not null")
    share = F.when(F.col("both"), 1.0).when(F.col("flow") + F.col("back_flow") > 0, F.col("flow") / (F.col("flow") + F.col("back_flow"))).otherwise(0.5)
    sides = all_.withColumn("side", F.explode(F.array(F.struct(edge_to("link").alias("region"), share.alias("share")), F.struct(edge_from("link").alias("region"), (1 - share).alias("share")))))
    return sides.groupBy("side.region", *keys).agg(F.sum(F.col("cost") * F.col("side.share")).alias("cost"))


def one_direction(curves: DataFrame) -> DataFrame:
    """RES-10: of two opposite links that both carry a curve cost, only the lexically smaller counts."""
    back = curves.select(mirrored("region").alias("region"), "tech", "vintage", F.lit(True).alias("_both")).distinct()
    return curves.join(back, ["region", "tech", "vintage"], "left").withColumn("counted", F.col("_both").isNull() | ~is_edge() | (F.col("region") < mirrored("region"))).drop("_both")


COSTS = ("d_invest", "d_fixed", "d_var", "d_emiss", "invest", "fixed", "var", "emiss")


def cost_table(rows: DataFrame) -> DataFrame:
    """RES-13: a column for each of the eight cost types per (scenario, region, period, tech, vintage), 0 where absent. rows: keys, cost_type, cost."""
    return rows.groupBy("scenario", "region", "period", "tech", "vintage").pivot("cost_type", list(COSTS)).agg(F.sum("cost")).na.fill(0.0, list(COSTS))


def spread_annual(annual: DataFrame, distribution: DataFrame, segfrac: DataFrame) -> DataFrame:
    """RES-3: annual flows over slices by the demand's own distribution where it has one, else by slice fractions.

    annual: region, period, commodity, flow. distribution: region, period, commodity, season, tod, dsd. segfrac: period, season, tod, segfrac.
    """
    own = distribution.select("region", "period", "commodity", "season", "tod", F.col("dsd").alias("part"))
    named = annual.join(own.select("region", "period", "commodity").distinct(), ["region", "period", "commodity"], "left_semi").join(own, ["region", "period", "commodity"])
    rest = annual.join(own, ["region", "period", "commodity"], "left_anti").join(segfrac.select("period", "season", "tod", F.col("segfrac").alias("part")), "period")
    return named.unionByName(rest).select("region", "period", "commodity", "season", "tod", (F.col("flow") * F.col("part")).alias("flow"))


def series(df: DataFrame, categories: DataFrame, periods: DataFrame, value: str) -> DataFrame:
    """RES-36: value per period and category (the technology itself without one), 0 where absent; an empty category is left out. categories: tech, category."""
    named = df.join(categories, "tech", "left").withColumn("category", F.coalesce("category", "tech")).where("category <> ''")
    spine = named.select("category").distinct().crossJoin(periods.select("period").distinct())
    return spine.join(named.groupBy("category", "period").agg(F.sum(value).alias("value")), ["category", "period"], "left").na.fill(0.0, ["value"])


def diagram(flow_in: DataFrame, flow_out: DataFrame, net_capacity: DataFrame) -> DataFrame:
    """RES-38: links of the process network by scenario and period: commodity to process, process to commodity, and each process with its capacity."""
    into = flow_in.groupBy("scenario", "period", F.col("input_comm").alias("source"), F.col("tech").alias("target")).agg(F.sum("flow").alias("value")).withColumn("kind", F.lit("input"))
    out = flow_out.groupBy("scenario", "period", F.col("tech").alias("source"), F.col("output_comm").alias("target")).agg(F.sum("flow").alias("value")).withColumn("kind", F.lit("output"))
    node = net_capacity.groupBy("scenario", "period", F.col("tech").alias("source")).agg(F.sum("capacity").alias("value")).withColumns({"kind": F.lit("process"), "target": F.lit(None).cast("string")})
    return union(into, out, node.select(*into.columns))


def period_totals(parts: DataFrame) -> DataFrame:
    """RES-37: cost by period, and the total (period null), by rollup."""
    return parts.rollup("scenario", "period").agg(F.sum("cost").alias("cost")).where("scenario is not null")


def null_small(column: str, epsilon: float = EPSILON) -> Column:
    """Values of a size below epsilon as 0."""
    return F.when(F.abs(column) < epsilon, 0.0).otherwise(F.col(column))


def capacity_results(built: DataFrame, early: DataFrame, ends: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """RES-1: rows of kind built (at the vintage), early (retired before its end) and end (what is left at its natural end); sizes below epsilon go.

    built: scenario, region, tech, vintage, capacity; early has a period too; ends: region, tech, vintage, period.
    """
    keys = ["scenario", "region", "tech", "vintage"]
    gone = early.groupBy(*keys).agg(F.sum("capacity").alias("gone"))
    left = built.join(gone, keys, "left").join(ends.select("region", "tech", "vintage", "period"), ["region", "tech", "vintage"])
    rows = union(
        built.select(*keys, F.col("vintage").alias("period"), F.lit("built").alias("kind"), "capacity"),
        early.select(*keys, "period", F.lit("early").alias("kind"), "capacity"),
        left.select(*keys, "period", F.lit("end").alias("kind"), (F.col("capacity") - F.coalesce("gone", F.lit(0.0))).alias("capacity")),
    )
    return rows.where(F.abs("capacity") >= epsilon)


def flow_results(out: DataFrame, curtailed: DataFrame, flex: DataFrame, efficiency: DataFrame, storage: DataFrame, epsilon: float = EPSILON) -> DataFrame:
    """RES-2: rows of kind out (less flex), in (out / efficiency), lost, curtail and flex per link and slice; storage has no `in` here. All inputs: LINK, season, tod, flow."""
    keys = [*LINK, "season", "tod"]
    eff = efficiency.select("region", "input_comm", "tech", "vintage", "output_comm", "efficiency")
    own = out.join(eff, ["region", "input_comm", "tech", "vintage", "output_comm"]).join(storage.select("tech").distinct(), "tech", "left_anti")
    row = lambda df, kind, value: df.select(*keys, F.lit(kind).alias("kind"), value.alias("flow"))
    parts = union(
        row(out, "out", F.col("flow")), row(flex, "out", -F.col("flow")), row(flex, "flex", F.col("flow")), row(curtailed, "curtail", F.col("flow")),
        row(own, "in", F.col("flow") / F.col("efficiency")), row(own, "lost", F.col("flow") / F.col("efficiency") - F.col("flow")),
    )
    return parts.groupBy(*keys, "kind").agg(F.sum("flow").alias("flow")).where(F.abs("flow") >= epsilon)


def material_flows(built: DataFrame, retired: DataFrame, inputs: DataFrame, outputs: DataFrame, lengths: DataFrame, segfrac: DataFrame) -> DataFrame:
    """RES-4: construction (new capacity times input a unit, over the period's years) and end-of-life flows (retired capacity times output), by slice fraction.

    built and retired: scenario, region, tech, vintage, period, capacity; inputs and outputs: region, tech, vintage, commodity, amount.
    """
    one = lambda df, per, kind: df.join(per, ["region", "tech", "vintage"]).withColumn("kind", F.lit(kind))
    both = one(built, inputs, "construction").unionByName(one(retired, outputs, "end of life"))
    rows = both.join(F.broadcast(lengths.where("length is not null")), "period").join(F.broadcast(segfrac.select("period", "season", "tod", "segfrac")), "period")
    return rows.groupBy("scenario", "region", "period", "season", "tod", "commodity", "kind").agg(F.sum(F.col("capacity") * F.col("amount") / F.col("length") * F.col("segfrac")).alias("flow"))


def scaled_levels(levels: DataFrame, fractions: DataFrame, days: float, base: DataFrame | None = None) -> DataFrame:
    """RES-5: a level over (season fraction * days); with base(scenario, region, period, season, tech, vintage, base) the seasonal one is base plus the daily part."""
    out = levels.join(F.broadcast(fractions.select("period", "season", "fraction")), ["period", "season"]).withColumn("level", F.col("level") / (F.col("fraction") * days))
    if base is None:
        return out.drop("fraction")
    keys = ["scenario", "region", "period", "season", "tech", "vintage"]
    return out.join(base, keys, "left").withColumn("level", F.col("level") + F.coalesce("base", F.lit(0.0))).drop("fraction", "base")


def survival_loan_cost(loans: DataFrame, curve: DataFrame, rate: float, start: int, end: int) -> DataFrame:
    """RES-8: discounted and undiscounted loan cost spread over the years by what survives, each year's cost falling due at its end, counted up to the horizon.

    loans: scenario, region, tech, vintage, annuity, at_build (value of all payments in the vintage year), loan_life; curve: region, tech, vintage, year, fraction.
    """
    keys = ["scenario", "region", "tech", "vintage", "annuity", "at_build", "loan_life"]
    due = F.pow(F.lit(1.0 + rate), -(F.col("year") - F.col("vintage") + 1))
    inside = F.col("year") < end
    sums = loans.join(curve, ["region", "tech", "vintage"]).groupBy(*keys).agg(
        F.sum(F.col("fraction") * due).alias("pv"), F.sum("fraction").alias("all"), F.coalesce(F.sum(F.when(inside, F.col("fraction") * due)), F.lit(0.0)).alias("pv_in"), F.coalesce(F.sum(F.when(inside, F.col("fraction"))), F.lit(0.0)).alias("all_in")
    )
    to_start = F.pow(F.lit(1.0 + rate), -(F.col("vintage") - start))
    return sums.select(*keys[:4], (F.col("at_build") * F.col("pv_in") / F.col("pv") * to_start).alias("discounted"), (F.col("annuity") * F.col("loan_life") * F.col("all_in") / F.col("all")).alias("undiscounted"))


def storage_fraction(levels: DataFrame, fractions: DataFrame, capacity: DataFrame, duration: float, scale: float, tolerance: float = 1e-6) -> DataFrame:
    """RES-35: forced storage fractions (scenario, region, period, season, tod, tech, vintage, fraction) against levels: fraction * capacity * duration * scale."""
    keys = ["scenario", "region", "period", "tech", "vintage"]
    want = fractions.join(capacity.select(*keys, "capacity"), keys).withColumn("wanted", F.col("fraction") * F.col("capacity") * duration * scale)
    both = want.join(levels.select(*keys, "season", "tod", "level"), [*keys, "season", "tod"], "left").na.fill(0.0, ["level"])
    return both.withColumn("broken", F.abs(F.col("level") - F.col("wanted")) > tolerance * F.greatest(F.lit(1.0), F.abs("wanted")))


def emissions(flow_out: DataFrame, activity: DataFrame, built: DataFrame, embodied: DataFrame, retired: DataFrame, end_of_life: DataFrame, lengths: DataFrame) -> DataFrame:
    """RES-11: yearly emission of each process by source: activity (flow times rate), embodied (new capacity times rate, spread over the years of the build period) and end of life (capacity retired a year times rate).

    built: scenario, region, tech, vintage, capacity; retired: those and period; embodied and end_of_life: region, emis_comm, tech, vintage, rate; lengths: period, length.
    """
    keys = ["scenario", "region", "period", "emis_comm", "tech", "vintage"]
    row = lambda df, source: df.select(*keys, F.lit(source).alias("source"), "emission")
    spread = built.withColumn("period", F.col("vintage")).join(embodied, ["region", "tech", "vintage"]).join(lengths.select("period", "length"), "period")
    spread = spread.withColumn("emission", F.col("capacity") * F.col("rate") / F.col("length"))
    ended = retired.join(end_of_life, ["region", "tech", "vintage"]).withColumn("emission", F.col("capacity") * F.col("rate"))
    rows = union(row(flow_emissions(flow_out, activity), "activity"), row(spread, "embodied"), row(ended, "end of life"))
    return rows.groupBy(*keys, "source").agg(F.sum("emission").alias("emission"))


def emission_costs(found: DataFrame, cost_emission: DataFrame, lengths: DataFrame, rate: float, start: int, epsilon: float = EPSILON) -> DataFrame:
    """RES-11: discounted and undiscounted cost of emissions by process and period; a process whose emissions of a commodity sum to less than epsilon costs nothing, nor does a commodity without a price.

    found: what emissions() gives; cost_emission: region, period, emis_comm, cost.
    """
    from gridloom.operators.finance import yearly_cost

    keys = ["scenario", "region", "period", "tech", "vintage"]
    sums = found.groupBy(*keys, "emis_comm").agg(F.sum("emission").alias("emission")).where(F.abs("emission") >= epsilon)
    priced = sums.join(cost_emission, ["region", "period", "emis_comm"]).join(lengths.select("period", "length"), "period")
    discounted, plain = yearly_cost(F.col("emission"), F.col("cost"), F.lit(rate), F.col("length"), F.lit(start), F.col("period"))
    return priced.groupBy(*keys).agg(F.sum(discounted).alias("d_emiss"), F.sum(plain).alias("emiss"))


def map_nodes(flow_out: DataFrame, demand: DataFrame, places: DataFrame) -> DataFrame:
    """RES-29: what each node makes and needs by scenario, period and technology (demand: by commodity, in every scenario), with its coordinates: kind, name, value, x, y."""
    made = flow_out.where(~is_edge()).groupBy("scenario", "region", "period", F.col("tech").alias("name")).agg(F.sum("flow").alias("value")).withColumn("kind", F.lit("flow"))
    every = demand.crossJoin(flow_out.select("scenario").distinct())  # scenarios: few
    need = every.groupBy("scenario", "region", "period", F.col("commodity").alias("name")).agg(F.sum("demand").alias("value")).withColumn("kind", F.lit("demand"))
    return made.unionByName(need).where("value > 0").join(places.select("region", "x", "y"), "region")


def concentration_split(df: DataFrame, keys: Sequence[str], value: str, cutoff: float) -> DataFrame:
    """RES-33: per key, rows and total below the cutoff and at or above it."""
    small = F.col(value) < cutoff
    part = lambda test, name: (F.count_if(test).alias(f"n_{name}"), F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0.0)).alias(f"total_{name}"))
    return df.groupBy(*keys).agg(*part(small, "small"), *part(~small, "large"))


def diagram_emissions(found: DataFrame) -> DataFrame:
    """RES-38: links from each process to its emission commodities, by scenario and period, in the form of diagram()."""
    sums = found.groupBy("scenario", "period", F.col("tech").alias("source"), F.col("emis_comm").alias("target")).agg(F.sum("emission").alias("value"))
    return sums.withColumn("kind", F.lit("emission"))


def process_detail(flow_in: DataFrame, flow_out: DataFrame, net_capacity: DataFrame, sources: DataFrame) -> DataFrame:
    """RES-38, by process: per scenario, region, period and technology its capacity (total), that of each vintage, and what each vintage takes (input) and makes (output) by commodity. Inputs that sources (name) holds, which stand for nothing taken, are left out."""
    keys = ("scenario", "region", "period", "tech")
    flow = lambda df, c, kind: df.groupBy(*keys, "vintage", F.col(c).alias("commodity")).agg(F.sum("flow").alias("value")).withColumn("kind", F.lit(kind))
    into, out = flow(flow_in.join(sources.select(F.col("name").alias("input_comm")), "input_comm", "left_anti"), "input_comm", "input"), flow(flow_out, "output_comm", "output")
    boxes = net_capacity.groupingSets([[*keys, "vintage"], [*keys]], *keys, "vintage").agg(F.sum("capacity").alias("value"), F.grouping_id().alias("_level"))
    boxes = boxes.withColumns({"kind": F.when(F.col("_level") == 0, "vintage").otherwise("total"), "commodity": F.lit(None).cast("string")})
    return union(into, out, boxes.select(*into.columns))


def commodity_detail(flow_in: DataFrame, flow_out: DataFrame, efficiency: DataFrame) -> DataFrame:
    """RES-38, by commodity: per scenario, region, period and commodity each technology that could take (use) or make it, with its flow; used is false, and the flow null, for those without one there."""
    keys = ("region", "commodity", "tech", "kind")
    side = lambda df, c, kind: df.withColumnsRenamed({c: "commodity"}).withColumn("kind", F.lit(kind))
    flows = union(*(side(df, c, kind).groupBy("scenario", "period", *keys).agg(F.sum("flow").alias("value")) for df, c, kind in ((flow_in, "input_comm", "use"), (flow_out, "output_comm", "make"))))
    could = union(*(side(efficiency, c, kind).select(*keys) for c, kind in (("input_comm", "use"), ("output_comm", "make")))).distinct()
    # a commodity is drawn where it flows
    drawn = flows.select("scenario", "period", "region", "commodity").distinct().join(could, ["region", "commodity"])
    return drawn.join(flows, ["scenario", "period", *keys], "full").withColumn("used", F.col("value").isNotNull()).select("scenario", "region", "period", "commodity", "tech", "kind", "used", "value")
