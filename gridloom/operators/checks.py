"""Input diagnostics (DIA-*): each check gives offending rows, and roll-ups give verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.joins import union
from gridloom.operators.regions import edge_from, edge_to, is_edge


def inventory(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """DIA-1: rows, rows beyond the first of their key, and node and edge regions per table."""
    parts = []
    for name, df in tables.items():
        region = F.col("region") if "region" in df.columns else F.lit(None).cast("string")
        grouped = df.groupBy(*keys[name], *(["region"] if "region" in df.columns and "region" not in keys[name] else [])).agg(F.count("*").alias("n"))
        parts.append(grouped.select(F.lit(name).alias("table"), "n", region.alias("region")))
    return union(*parts).groupBy("table").agg(
        F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_duplicates"),
        F.count_distinct(F.when(~is_edge(), F.col("region"))).alias("n_nodes"), F.count_distinct(F.when(is_edge(), F.col("region"))).alias("n_edges"),
    )


def required_tables(counts: DataFrame, required: DataFrame) -> DataFrame:
    """DIA-2: required tables that are missing or empty."""
    out = required.join(counts, "table", "left")
    return out.where("n_rows is null or n_rows = 0").select("table", F.when(F.col("n_rows").isNull(), "missing").otherwise("empty").alias("reason"))


def reference_sets(**frames: DataFrame) -> DataFrame:
    """DIA-3: distinct members of one-column frames, with the set's name."""
    return union(*(df.select(F.lit(name).alias("kind"), F.col(df.columns[0]).cast("string").alias("member")).distinct() for name, df in frames.items()))


def orphans(df: DataFrame, column: str, members: DataFrame) -> DataFrame:
    """DIA-4: values absent from the defining set (first column of members) with their rows; an edge is known if both ends are."""
    known = members.select(F.col(members.columns[0]).alias("_known")).distinct()
    used = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("value is not null")
    ends = used.withColumn("part", F.explode(F.when(is_edge("value"), F.array(edge_from("value"), edge_to("value"))).otherwise(F.array("value"))))
    return ends.join(known, F.col("part") == F.col("_known"), "left_anti").select("value", "n").distinct()


def shared_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """DIA-5: all rows that share their key."""
    return df.withColumn("_n", F.count("*").over(W.partitionBy(*keys))).where("_n > 1").drop("_n")


def only_in_one(left: DataFrame, right: DataFrame) -> DataFrame:
    """DIA-6: members of one side only."""
    return left.subtract(right).withColumn("side", F.lit("left")).unionByName(right.subtract(left).withColumn("side", F.lit("right")))


def numeric_problems(df: DataFrame, columns: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    """DIA-7: values that are null, no number, not finite, or break their rule (positive, nonnegative, finite), with the reason."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit(rule).alias("rule")) for c, rule in columns.items()))).alias("cell")
    rows = df.select(*keys, cells).select(*keys, "cell.*").withColumn("x", F.col("value").try_cast("double"))
    reason = (
        F.when(F.col("value").isNull(), "null").when(F.col("x").isNull(), "not a number").when(F.isnan("x") | (F.abs("x") == float("inf")), "not finite")
        .when((F.col("rule") == "positive") & (F.col("x") <= 0), "not positive").when((F.col("rule") == "nonnegative") & (F.col("x") < 0), "negative")
    )
    return rows.withColumn("reason", reason).where("reason is not null").select(*keys, "column", "value", "reason")


def readiness(technology: DataFrame, tables: Mapping[str, DataFrame], efficiency: DataFrame, commodity: DataFrame, costs: Sequence[str], needed: Sequence[str]) -> DataFrame:
    """DIA-8: which tables mention each technology, whether it is a demand sink (all outputs demands, no source input), its missing cost classes, and whether it is ready."""
    out = technology.select("tech")
    for name, df in tables.items():
        out = out.join(df.select("tech").distinct().withColumn(f"in_{name}", F.lit(True)), "tech", "left")
    out = out.na.fill(False, [f"in_{n}" for n in tables])
    flag = lambda c, n: commodity.select(F.col("name").alias(c), F.col("flag").alias(n))  # noqa: E731  a row a commodity name
    ends = efficiency.select("tech", "input_comm", "output_comm").distinct().join(flag("input_comm", "fi"), "input_comm", "left").join(flag("output_comm", "fo"), "output_comm", "left")
    sinks = ends.groupBy("tech").agg((F.every(F.coalesce(F.col("fo") == "d", F.lit(False))) & ~F.bool_or(F.coalesce(F.col("fi") == "s", F.lit(False)))).alias("sink"))
    missing = F.array_compact(F.array(*(F.when(~F.col(f"in_{c}"), c) for c in costs)))
    out = out.join(sinks, "tech", "left").na.fill(False, ["sink"]).withColumn("missing_costs", F.array_join(missing, ","))
    ready = F.lit(True)
    for n in needed:
        ready = ready & F.col(f"in_{n}")
    return out.withColumn("ready", ready & ((F.col("missing_costs") == "") | F.col("sink")))


def unit_inventory(df: DataFrame, group: Sequence[str], unit: str, example: str, most: int = 5) -> DataFrame:
    """DIA-9: rows and up to five example names per group and unit."""
    return df.groupBy(*group, unit).agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set(example)), 1, most), ",").alias("examples"))


def unit_findings(df: DataFrame, units: DataFrame, allowed: DataFrame, table: str, unit: str, region: str, tech: str, strict: bool = False, most: int = 5) -> DataFrame:
    """DIA-9: per table and unit: rows, category, whether the table may have that category, up to five example regions and technologies, and the finding: missing, unknown, incompatible or none, with its severity (warning; error if strict).

    units: unit, category. allowed: table, category; a table without rows there may have any, so its `compatible` is null.
    """
    from gridloom.operators.prepare import unit_category

    examples = lambda c: F.array_join(F.slice(F.sort_array(F.collect_set(F.col(c).cast("string"))), 1, most), ";")
    text = F.trim(F.col(unit).cast("string"))
    named = df.withColumn("unit", F.when(text == "", None).otherwise(text)).groupBy(F.col(table).alias("table"), "unit").agg(F.count("*").alias("n"), examples(region).alias("regions"), examples(tech).alias("techs"))
    judged = unit_category(named, units)
    fits = judged.join(allowed.select("table", "category", F.lit(True).alias("_fits")).distinct(), ["table", "category"], "left").join(allowed.select("table", F.lit(True).alias("_bound")).distinct(), "table", "left")
    known = ~F.col("category").isin("missing", "unknown")
    compatible = F.when(F.col("_bound") & known, F.coalesce("_fits", F.lit(False)))
    finding = F.when(~known, F.col("category")).when(~compatible, "incompatible")
    out = fits.withColumns({"compatible": compatible, "finding": finding})
    return out.select("table", F.coalesce("unit", F.lit("")).alias("unit"), "n", "category", "compatible", "regions", "techs", "finding", F.when(F.col("finding").isNotNull(), "error" if strict else "warning").alias("severity"))


def point_union(*layers: tuple[DataFrame, str, Sequence[str], str]) -> DataFrame:
    """DIA-15: points of several layers as one: id, name (the first of several columns that is not null), layer. layers: table, id column, name columns, layer name."""
    return union(*(df.select(F.col(key).cast("string").alias("id"), F.coalesce(*(F.col(n).cast("string") for n in names)).alias("name"), F.lit(layer).alias("layer")) for df, key, names, layer in layers))


def distance_summary(df: DataFrame, group: str, distance: str, fallback: Column) -> DataFrame:
    """DIA-10: per group rows, fallbacks and their share, mean, median, 95th percentile and maximum distance."""
    far = F.when(fallback, F.col(distance))
    return df.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(fallback).alias("n_fallback"), (F.count_if(fallback) / F.count("*")).alias("share"), F.avg(far).alias("mean"),
        F.percentile(far, 0.5).alias("median"), F.percentile(far, 0.95).alias("p95"), F.max(far).alias("max"),
    )


def distance_verdicts(df: DataFrame, distance: str, exempt: Column, limits: Sequence[tuple[str, float]] = (("error", 250.0), ("warning", 100.0), ("notice", 25.0))) -> DataFrame:
    """DIA-11: rows over each limit with the severity of the largest one passed; exempt rows are never errors."""
    severity = F.lit(None).cast("string")
    for name, km in sorted(limits, key=lambda x: x[1]):
        over = F.col(distance) > km
        severity = F.when(over & ~exempt if name == "error" else over, name).otherwise(severity)
    return df.withColumn("severity", severity).where("severity is not null")


def conservation(left: DataFrame, right: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """DIA-13: keys on one side only, and whether the two totals agree, as one row."""
    both = left.groupBy(key).agg(F.sum(value).alias("a")).join(right.groupBy(key).agg(F.sum(value).alias("b")), key, "full")
    return both.agg(F.count_if(F.col("b").isNull()).alias("left_only"), F.count_if(F.col("a").isNull()).alias("right_only"), F.sum("a").alias("total_left"), F.sum("b").alias("total_right")).withColumn(
        "passed", (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.abs(F.col("total_left") - F.col("total_right")) <= tolerance)
    )


def roll_up(results: DataFrame) -> DataFrame:
    """DIA-14: by stage, checks, failures and status: error if an error check failed or did not run."""
    bad = (F.col("severity") == "error") & (~F.col("ran") | ~F.coalesce(F.col("passed"), F.lit(False)))
    warn = (F.col("severity") != "error") & F.col("ran") & ~F.coalesce(F.col("passed"), F.lit(False))
    out = results.groupBy("stage").agg(F.count("*").alias("n_checks"), F.count_if(bad).alias("n_errors"), F.count_if(warn).alias("n_warnings"))
    return out.withColumn("status", F.when(F.col("n_errors") > 0, "error").when(F.col("n_warnings") > 0, "warning").otherwise("ok"))


def price_checks(efficiency: DataFrame, fixed: DataFrame, variable: DataFrame, invest: DataFrame, active: DataFrame, technology: DataFrame | None = None, horizon: DataFrame | None = None) -> DataFrame:
    """DIA-16: findings per process, each check by itself: no cost at all; neither fixed nor invest; a fixed cost of the build year, or an invest cost, that the technology has only elsewhere; fixed and variable periods differ; periods of its life without them.

    technology (tech, unlim_cap): uncapped ones may lack fixed and invest costs. horizon (period): vintages outside it are not asked for fixed and invest costs.
    """
    key = ["region", "tech", "vintage"]
    own = efficiency.select(*key).distinct()
    periods = lambda df, name: df.groupBy(*key).agg(F.sort_array(F.collect_set("period")).alias(name))
    flag = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    base = fixed.where("period = vintage")
    rows = own.join(periods(fixed, "f"), key, "left").join(periods(variable, "v"), key, "left").join(flag(invest, key, "i"), key, "left").join(periods(active, "life"), key, "left")
    rows = rows.join(flag(base, key, "b"), key, "left").join(flag(base, ["tech"], "b_else"), "tech", "left").join(flag(invest, ["tech"], "i_else"), "tech", "left")
    free, inside = F.lit(False), F.lit(True)
    if technology is not None:
        rows, free = rows.join(flag(technology.where("unlim_cap = 1"), ["tech"], "free"), "tech", "left"), F.col("free").isNotNull()
    if horizon is not None:
        rows, inside = rows.join(flag(horizon.withColumnRenamed("period", "vintage"), ["vintage"], "inside"), "vintage", "left"), F.col("inside").isNotNull()
    found = F.array_compact(
        F.array(
            F.when(F.col("f").isNull() & F.col("v").isNull() & F.col("i").isNull(), "no cost"),
            F.when(F.col("f").isNull() & F.col("i").isNull() & ~free & inside, "no fixed or invest cost"),
            F.when(F.col("b").isNull() & F.col("b_else").isNotNull() & inside, "fixed cost of the build year only elsewhere"),
            F.when(F.col("i").isNull() & F.col("i_else").isNotNull() & inside, "invest cost only elsewhere"),
            F.when(F.col("f").isNotNull() & F.col("v").isNotNull() & (F.col("f") != F.col("v")), "fixed and variable periods differ"),
            F.when(F.col("f").isNotNull() & (F.size(F.array_except("life", "f")) > 0), "fixed cost missing in the lifetime"),
            F.when(F.col("v").isNotNull() & (F.size(F.array_except("life", "v")) > 0), "variable cost missing in the lifetime"),
        )
    )
    return rows.select(*key, F.explode(found).alias("finding"))


def fraction_check(segfrac: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """DIA-18: per period: slices, slices missing from the product of its seasons and times, and whether the fractions sum to 1."""
    seasons, times = segfrac.select("season").distinct(), segfrac.select("tod").distinct()
    whole = segfrac.select("period").distinct().crossJoin(F.broadcast(seasons)).crossJoin(F.broadcast(times))  # a year's slices
    out = whole.join(segfrac, ["period", "season", "tod"], "left").groupBy("period").agg(F.count("segfrac").alias("n"), F.count_if(F.col("segfrac").isNull()).alias("missing"), F.sum("segfrac").alias("total"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.abs(F.col("total") - 1) <= tolerance))


def fill_distribution(demand: DataFrame, distribution: DataFrame, segfrac: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """DIA-19: per demand its number of slices, how many are missing, the sum and whether it is 1; a demand without any takes the slice fractions."""
    key = ["region", "period", "commodity"]
    slices = demand.select(*key).join(F.broadcast(segfrac.select("period", "season", "tod", "segfrac")), "period")
    own = distribution.select(*key, "season", "tod", "dsd")
    rows = slices.join(own, [*key, "season", "tod"], "left").join(own.select(*key).distinct().withColumn("named", F.lit(True)), key, "left")
    part = F.when(F.col("named"), F.col("dsd")).otherwise(F.col("segfrac"))
    out = rows.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(part.isNull()).alias("missing"), F.sum(part).alias("total"), F.coalesce(F.bool_or("named"), F.lit(False)).alias("named"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.abs(F.coalesce("total", F.lit(0.0)) - 1) <= tolerance))


def index_check(efficiency: DataFrame, commodity: DataFrame, technology: DataFrame, demand: DataFrame) -> DataFrame:
    """DIA-20: carriers and technologies used but not declared or declared but not used, and demands that nothing makes."""
    used = efficiency.select(F.col("input_comm").alias("name")).union(efficiency.select("output_comm")).distinct()
    a = only_in_one(used, commodity.select("name").distinct()).select(F.lit("commodity").alias("kind"), "name", "side")
    b = only_in_one(efficiency.select("tech").distinct(), technology.select("tech").distinct()).select(F.lit("technology").alias("kind"), F.col("tech").alias("name"), "side")
    c = demand.select(F.col("commodity").alias("name")).distinct().subtract(efficiency.select(F.col("output_comm"))).select(F.lit("demand").alias("kind"), "name", F.lit("left").alias("side"))
    return union(a, b, c)


def partial_overrides(overrides: DataFrame, keys: Sequence[str], slices: DataFrame) -> DataFrame:
    """DIA-21: keys with some but not all slices of a period."""
    whole = slices.groupBy("period").agg(F.count("*").alias("of"))
    return overrides.groupBy(*keys, "period").agg(F.count_distinct("season", "tod").alias("n")).join(F.broadcast(whole), "period").where("n < of")


def slice_sequence(slices: DataFrame, loop: str = "period") -> DataFrame:
    """DIA-22: each slice and the next; the last is followed by the first of the period, or with loop='season' of its season."""
    w = W.partitionBy("period", *(["season"] if loop == "season" else [])).orderBy("season", "tod")
    all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(all_)).alias(f"next_{c}")
    return slices.select("period", "season", "tod", nxt("season"), nxt("tod"))


def season_sequence(slices: DataFrame) -> DataFrame:
    """DIA-22, between seasons: the last slice of each season and the first of the next, in the form of slice_sequence(); the last season is followed by the first, a season alone by none."""
    ends = slices.groupBy("period", "season").agg(F.min("tod").alias("first"), F.max("tod").alias("tod"))
    w = W.partitionBy("period").orderBy("season")
    all_ = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nxt = lambda c, name: F.coalesce(F.lead(c).over(w), F.first(c).over(all_)).alias(name)
    return ends.select("period", "season", "tod", nxt("season", "next_season"), nxt("first", "next_tod")).where("season <> next_season")


def survival(curve: DataFrame, lifetime: DataFrame, tolerance: float = 1e-4) -> tuple[DataFrame, DataFrame]:
    """DIA-24: the curve (region, tech, vintage, period, fraction) with yearly gaps filled linearly, and findings per process."""
    key = ["region", "tech", "vintage"]
    w = W.partitionBy(*key).orderBy("period")
    rows = curve.withColumns({"before": F.lag("period").over(w), "was": F.lag("fraction").over(w)})
    years = F.explode(F.sequence(F.coalesce(F.col("before") + 1, F.col("period")), F.col("period"))).alias("year")
    filled = rows.select(*key, "period", "fraction", "before", "was", years)
    line = F.col("was") + (F.col("fraction") - F.col("was")) * (F.col("year") - F.col("before")) / (F.col("period") - F.col("before"))
    filled = filled.select(*key, F.col("year").alias("period"), F.when(F.col("year") == F.col("period"), F.col("fraction")).otherwise(line).alias("fraction"))
    ends = rows.groupBy(*key).agg(F.min("period").alias("first"), F.min_by("fraction", "period").alias("start"), F.max("period").alias("last"), F.max_by("fraction", "period").alias("end"), F.count_if(F.col("fraction") > F.col("was") + tolerance).alias("rises"))
    ends = ends.join(lifetime.select(*key, "lifetime"), key, "left")
    found = F.array_compact(
        F.array(
            F.when((F.col("first") != F.col("vintage")) | (F.abs(F.col("start") - 1) > tolerance), "does not start at 1"),
            F.when(F.col("rises") > 0, "rises"),
            F.when(F.abs("end") > tolerance, "does not reach 0"),
            F.when(F.col("lifetime").isNotNull() & (F.col("last") != F.col("vintage") + F.col("lifetime")), "lifetime differs"),
        )
    )
    return filled, ends.select(*key, F.explode(found).alias("finding"))


#: Naming rules: a node, an edge of two nodes, a group.
NODE_RULE, EDGE_RULE, GROUP_RULE = r"^[A-Za-z0-9_]+$", r"^[A-Za-z0-9_]+-[A-Za-z0-9_]+$", r"^(global|[A-Za-z0-9_-]+(\+[A-Za-z0-9_-]+)+)$"


def region_kind(region: Column | str = "region") -> Column:
    """DIA-25: node, edge, group, or null for a name that follows no rule; an edge needs two different ends."""
    c = F.col(region) if isinstance(region, str) else region
    return F.when(c.rlike(GROUP_RULE), "group").when(c.rlike(EDGE_RULE) & (edge_from(c) != edge_to(c)), "edge").when(c.rlike(NODE_RULE), "node")


def name_findings(names: DataFrame, regions: DataFrame) -> DataFrame:
    """DIA-25: kind (node, edge, group) of each region index and its fault, null if it is valid. names: name; regions: region, the known nodes.

    node: `characters` (other than letters, digits, underscore), `reserved` (global, unless it stands for the group of all, which the kind then says), `unknown`. edge (with a hyphen):
    `characters` (more than two names), `same ends`, `unknown`. group (with a plus): `characters`, `repeated` member, `unknown`. A null name has the fault `missing`.
    """
    own = names.select("name").distinct()
    c = F.col("name")
    kind = F.when(c.contains("-"), "edge").when(c.contains("+") | (c == "global"), "group").when(c.isNotNull(), "node")
    parts = own.select("name", kind.alias("kind"), F.split("name", r"[-+]").alias("_parts"))
    known = regions.select(F.col("region").alias("_part"), F.lit(1).alias("_known")).distinct()
    members = parts.select("name", F.explode(F.array_distinct("_parts")).alias("_part")).join(known, "_part", "left").groupBy("name").agg(F.count_if(F.col("_known").isNull()).alias("_unknown"))
    shape = F.when(F.col("kind") == "edge", c.rlike(r"^[A-Za-z0-9_]+-[A-Za-z0-9_]+\z")).when(F.col("kind") == "group", c.rlike(r"^[A-Za-z0-9_+]+\z")).otherwise(c.rlike(r"^[A-Za-z0-9_]+\z"))
    twice = F.size(F.array_distinct("_parts")) < F.size("_parts")
    finding = (
        F.when(c.isNull(), "missing").when(c == "global", None).when(~shape, "characters").when(twice, F.when(F.col("kind") == "edge", "same ends").otherwise("repeated")).when(F.col("_unknown") > 0, "unknown")
    )
    return parts.join(members, "name", "left").select("name", "kind", finding.alias("finding"))


def reserved_nodes(regions: DataFrame) -> DataFrame:
    """DIA-25: declared nodes with a name that no node may have: the reserved `global`, or other than letters, digits and underscore."""
    return regions.select("region").distinct().where((F.col("region") == "global") | ~F.col("region").rlike(r"^[A-Za-z0-9_]+\z") | F.col("region").isNull())


def element_findings(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """DIA-25: element names with a slash or a pipe, which stand for lists in run indices: column, element, rows. Numbers and nulls pass."""
    text = [f.name for f in df.schema.fields if f.name in columns and f.dataType.typeName() in ("string", "varchar", "char")]
    if not text:
        return df.sparkSession.createDataFrame([], "column string, element string, n long")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("element")) for c in text))).alias("x")
    return df.select(cells).select("x.*").where(F.col("element").rlike("[/|]")).groupBy("column", "element").agg(F.count("*").alias("n"))


def group_entry_findings(entries: DataFrame, regions: DataFrame, groups: DataFrame, technology: DataFrame) -> DataFrame:
    """DIA-25: entries (region, group, tech) of technology groups with each fault: `region` (name_findings() faults it), `group` or `tech` (not known)."""
    bad = name_findings(entries.select(F.col("region").alias("name")), regions).where("finding is not null").select(F.col("name").alias("region"), F.lit(1).alias("_bad"))
    known = lambda df, c: df.select(c, F.lit(1).alias(f"_{c}")).distinct()
    out = entries.select("region", "group", "tech").join(bad, "region", "left").join(known(groups, "group"), "group", "left").join(known(technology, "tech"), "tech", "left")
    found = F.array_compact(F.array(F.when((F.col("_bad") == 1) | F.col("region").isNull(), "region"), F.when(F.col("_group").isNull(), "group"), F.when(F.col("_tech").isNull(), "tech")))
    return out.select("region", "group", "tech", F.explode(found).alias("finding"))


def flag_conflicts(technology: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """DIA-26: technologies with two flags that exclude each other."""
    found = F.array_compact(F.array(*(F.when((F.col(a) == 1) & (F.col(b) == 1), f"{a} with {b}") for a, b in pairs)))
    return technology.select("tech", F.explode(found).alias("finding"))


def unknown_index(df: DataFrame, parts: Mapping[str, DataFrame]) -> DataFrame:
    """DIA-27: index values outside their sets, with rows. parts: column to a one-column frame."""
    return union(*(orphans(df, c, known).select(F.lit(c).alias("part"), F.col("value").cast("string"), "n") for c, known in parts.items()))


def identity(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """DIA-28: per field its distinct values, and whether they are just the expected one."""
    row = df.agg(*(F.sort_array(F.collect_set(c)).alias(c) for c in expected))
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.array_join(c, ",").alias("found"), (F.col(c) == F.array(F.lit(v))).alias("passed")) for c, v in expected.items()))).alias("x")
    return row.select(cells).select("x.*")


def topology(regions: DataFrame, nodes: DataFrame, edges: DataFrame, roads: DataFrame, road_edges: DataFrame) -> DataFrame:
    """DIA-12: metric and value of a grid and its graph: rows and distinct regions of regions and nodes (region) and edges (edge_region, region_from, region_to, distance_km), rows and connected rows of roads (connected, distance_km), road geometries, distances, and of the graph isolated nodes, one-way edges and components."""
    from gridloom.operators.components import connected_components

    stats = lambda name: (F.min("distance_km").alias(f"{name}_distance_min"), F.avg("distance_km").alias(f"{name}_distance_mean"), F.max("distance_km").alias(f"{name}_distance_max"))
    ways = edges.select(F.col("region_from").alias("a"), F.col("region_to").alias("b")).distinct()
    member = connected_components(ways)
    ends = ways.select("a").union(ways.select("b")).distinct()
    known = nodes.select("region").distinct()
    alone = known.join(ends, F.col("region") == F.col("a"), "left_anti")
    one_way = ways.join(ways.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"], "left_anti")
    rows = (
        regions.agg(F.count("*").alias("basemap_regions"), F.countDistinct("region").alias("basemap_unique_regions")),
        nodes.agg(F.count("*").alias("graph_nodes"), F.countDistinct("region").alias("graph_node_unique_regions")),
        edges.agg(F.count("*").alias("graph_edges"), F.countDistinct("edge_region").alias("graph_edge_unique_regions"), *stats("graph_edge")),
        roads.agg(F.count("*").alias("road_connection_rows"), F.count_if("connected").alias("road_connected_rows")),
        roads.where("connected").agg(*stats("road_edge")),
        road_edges.agg(F.count("*").alias("road_edge_geometries")),
        alone.agg(F.count("*").alias("isolated_nodes")),
        one_way.agg(F.count("*").alias("one_way_edges")),
        member.agg(F.countDistinct("component").alias("linked_components")),
    )
    return union(*(metric_rows(r) for r in rows))


def topology_verdicts(metrics: DataFrame) -> DataFrame:
    """DIA-12: the six verdicts on the metrics: name, severity, passed. A metric that is missing counts as 0."""
    has = lambda m: F.coalesce(F.max(F.when(F.col("metric") == m, F.col("value"))), F.lit(0.0))
    rules = (
        ("basemap has regions", "error", has("basemap_regions") > 0),
        ("nodes are unique by region", "error", (has("graph_nodes") > 0) & (has("graph_nodes") == has("graph_node_unique_regions"))),
        ("graph has edges", "error", has("graph_edges") > 0),
        ("road connections have rows", "error", has("road_connection_rows") > 0),
        ("connected rows exist", "warning", has("road_connected_rows") > 0),
        ("road geometries exist", "warning", has("road_edge_geometries") > 0),
    )
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(level).alias("severity"), F.col(f"_{k}").alias("passed")) for k, (n, level, _) in enumerate(rules)))).alias("x")
    return metrics.agg(*(rule.alias(f"_{k}") for k, (_, _, rule) in enumerate(rules))).select(cells).select("x.*")


def metric_rows(row: DataFrame) -> DataFrame:
    """DIA-12: a one-row frame as metric and value."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in row.columns))).alias("x")
    return row.select(cells).select("x.*")


def uncapped_findings(technology: DataFrame, fixed: DataFrame, invest: DataFrame, existing: DataFrame, variable: DataFrame, active: DataFrame) -> DataFrame:
    """DIA-17: processes of uncapped technologies with fixed, invest or existing-capacity rows, and those whose variable cost misses periods of their life."""
    key = ["region", "tech", "vintage"]
    free = technology.where("unlim_cap = 1").select("tech")
    of = lambda df, text: df.join(free, "tech", "left_semi").select(*key).distinct().withColumn("finding", F.lit(text))
    some = variable.groupBy(*key).agg(F.collect_set("period").alias("v"))
    life = active.join(free, "tech", "left_semi").groupBy(*key).agg(F.collect_set("period").alias("life"))
    gaps = life.join(some, key).where(F.size(F.array_except("life", "v")) > 0).select(*key, F.lit("variable cost missing in the lifetime").alias("finding"))
    return union(of(fixed, "fixed cost"), of(invest, "invest cost"), of(existing, "existing capacity"), gaps)


def sequential_seasons(sequence: DataFrame, fractions: DataFrame, days: float, tolerance: float = 1e-3) -> DataFrame:
    """DIA-23: findings per period and season: day counts (period, seq, season, num_days) against fractions * days, a season that is missing, and consecutive entries of one season of unequal length."""
    totals = sequence.groupBy("period", "season").agg(F.sum("num_days").alias("n"))
    both = fractions.join(totals, ["period", "season"], "full")
    off = both.select("period", "season", F.when(F.col("n").isNull(), "missing").when(F.abs(F.col("n") / days - F.coalesce("fraction", F.lit(0.0))) > tolerance, "days differ from the fraction").alias("finding")).where("finding is not null")
    w = W.partitionBy("period").orderBy("seq")
    uneven = sequence.withColumns({"_s": F.lag("season").over(w), "_n": F.lag("num_days").over(w)}).where("_s = season and _n <> num_days")
    return off.unionByName(uneven.select("period", "season", F.lit("consecutive days differ").alias("finding")).distinct())


def default_sequence(fractions: DataFrame, days: float) -> DataFrame:
    """DIA-23: without a table of one's own, each season once, in order, with its fraction of the days."""
    return fractions.select("period", F.row_number().over(W.partitionBy("period").orderBy("season")).alias("seq"), "season", (F.col("fraction") * days).alias("num_days"))
