"""Demand allocation (DEM-*) and storage evidence (STO-*)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.joins import ContractError, checked_join, first_per_key
from gridloom.session import materialize


def with_population(areas: DataFrame, population: DataFrame, key: str) -> DataFrame:
    """DEM-1: areas with their population (one row each; a missing row is an error); a null counts as 0 and as not available."""
    out = checked_join(areas, population.select(key, "population"), [key], "left", "1:1", required=True)
    return out.withColumn("available", F.col("population").isNotNull()).na.fill(0.0, ["population"])


def select_hubs(centres: DataFrame, least_class: int) -> DataFrame:
    """DEM-2: centres at or above a class, and for a jurisdiction without one its largest centre (population, class, land area, then id)."""
    big = centres.where(F.col("class") >= least_class)
    rest = centres.join(big.select("jurisdiction").distinct(), "jurisdiction", "left_anti")
    most = first_per_key(rest, ["jurisdiction"], F.desc("population"), F.desc("class"), F.desc("area"), "hub_id")
    return big.withColumn("reason", F.lit("threshold")).unionByName(most.withColumn("reason", F.lit("fallback")))


def unresolved_anchors(registry: DataFrame, centres: DataFrame) -> DataFrame:
    """DEM-3: registry rows (jurisdiction, hub_id) without a centre of that jurisdiction, or given twice."""
    known = centres.select("jurisdiction", "hub_id").distinct()
    none = registry.select("jurisdiction", "hub_id").join(known, ["jurisdiction", "hub_id"], "left_anti").withColumn("reason", F.lit("no such centre"))
    twice = registry.groupBy("jurisdiction", "hub_id").count().where("count > 1").select("jurisdiction", "hub_id", F.lit("given twice").alias("reason"))
    return none.distinct().unionByName(twice)


def greedy_fill(areas: DataFrame, candidates: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """DEM-4: n more hubs per jurisdiction, each time the candidate with the largest drop of population-weighted distance (ties: population, then id).

    areas: jurisdiction, area_id, population, x, y. candidates and chosen: jurisdiction, hub_id, population, x, y. Jurisdictions advance together, one round a hub.
    """
    c = candidates.select("jurisdiction", "hub_id", F.col("population").alias("size"), F.col("x").alias("hx"), F.col("y").alias("hy"))
    d = F.sqrt(F.pow(F.col("x") - F.col("hx"), 2) + F.pow(F.col("y") - F.col("hy"), 2))
    to = lambda hubs: areas.join(hubs.select("jurisdiction", F.col("x").alias("hx"), F.col("y").alias("hy")), "jurisdiction", "left").groupBy("jurisdiction", "area_id").agg(F.min(d).alias("cur"))
    hubs = chosen.select("jurisdiction", "hub_id", "x", "y")
    for k in range(n):
        near = areas.join(to(hubs), ["jurisdiction", "area_id"])
        free = c.join(hubs.select("jurisdiction", "hub_id"), ["jurisdiction", "hub_id"], "left_anti")
        drop = F.sum(F.col("population") * F.greatest(F.coalesce("cur", F.lit(1e12)) - d, F.lit(0.0)))
        score = near.join(free, "jurisdiction").groupBy("jurisdiction", "hub_id", "size", "hx", "hy").agg(drop.alias("drop"))
        best = first_per_key(score, ["jurisdiction"], F.desc("drop"), F.desc("size"), "hub_id")
        hubs = materialize(hubs.unionByName(best.select("jurisdiction", "hub_id", F.col("hx").alias("x"), F.col("hy").alias("y"))), f"hubs{k}")
    return hubs.select("jurisdiction", "hub_id").join(chosen.select("jurisdiction", "hub_id"), ["jurisdiction", "hub_id"], "left_anti")


def catchments(hubs: DataFrame, areas: DataFrame) -> DataFrame:
    """DEM-5: per hub its areas' population, count, unavailable ones, largest and population-weighted mean distance; 0 without areas."""
    own = areas.groupBy("hub_id").agg(
        F.sum("population").alias("catchment"), F.count("*").alias("n_areas"), F.count_if(~F.col("available")).alias("n_unavailable"), F.max("distance").alias("max_distance"),
        F.try_divide(F.sum(F.col("population") * F.col("distance")), F.sum("population")).alias("mean_distance"),
    )
    return hubs.select("jurisdiction", "hub_id").join(own, "hub_id", "left").na.fill(0, ["catchment", "n_areas", "n_unavailable", "max_distance", "mean_distance"])


def selection_audit(catchment: DataFrame) -> DataFrame:
    """DEM-6: hubs, population and areas per jurisdiction."""
    return catchment.groupBy("jurisdiction").agg(F.count("*").alias("n_hubs"), F.sum("catchment").alias("population"), F.sum("n_areas").alias("n_areas"))


def select_sales(sales: DataFrame, product: str, year: int, known: Sequence[str]) -> DataFrame:
    """DEM-7: litres of one product and year; an unknown or absent jurisdiction is an error. Sales are in thousands."""
    own = sales.where((F.col("product") == product) & (F.col("year") == year))
    found = {r[0] for r in own.select("jurisdiction").distinct().limit(len(known) + 1).collect()}  # a row a jurisdiction
    if found != set(known):
        raise ContractError(f"jurisdictions differ: {sorted(map(str, found ^ set(known)))}")
    return own.select("jurisdiction", (F.col("value") * 1000).alias("litres"))


def allocate(parts: DataFrame, totals: DataFrame, group: str, weight: str, amount: str) -> DataFrame:
    """DEM-8: each part's share of its group's weight, and that share of the group's amount."""
    share = parts.withColumn("share", F.try_divide(F.col(weight), F.sum(weight).over(W.partitionBy(group))))
    return share.join(totals.select(group, F.col(amount).alias("_total")), group).withColumn(amount, F.col("share") * F.col("_total")).drop("_total")  # a row a jurisdiction


def conservation_audit(allocated: DataFrame, totals: DataFrame, group: str, amount: str, weight_tolerance: float = 1e-12, relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """DEM-9: per group the sum of shares, allocated and source amounts, residual, and whether both agree."""
    own = allocated.groupBy(group).agg(F.sum("share").alias("weights"), F.sum(amount).alias("allocated"))
    out = own.join(totals.select(group, F.col(amount).alias("source")), group, "full").withColumn("residual", F.col("allocated") - F.col("source"))
    good = (F.abs(F.col("weights") - 1) <= weight_tolerance) & (F.abs("residual") <= absolute + relative * F.abs("source"))
    return out.withColumn("passed", F.coalesce(good, F.lit(False)))


def regional(regions: DataFrame, rows: DataFrame, amount: str) -> DataFrame:
    """DEM-10: sum per region, 0 for the others, and whether it has demand."""
    own = rows.groupBy("region").agg(F.sum(amount).alias(amount))
    return regions.select("region").join(own, "region", "left").na.fill(0.0, [amount]).withColumn("has_demand", F.col(amount) > 0)


def evidence_contract(features: DataFrame, assessments: DataFrame) -> DataFrame:
    """STO-1: repeated feature ids, assessments of unknown features or units, and wrong scopes, with a reason."""
    twice = features.groupBy("feature_id").count().where("count > 1").select(F.col("feature_id").alias("id"), F.lit("feature given twice").alias("reason"))
    own = lambda s, c: assessments.where(F.col("scope") == s).select(F.col(c).alias("id")).distinct()
    no_feature = own("feature", "feature_id").subtract(features.select(F.col("feature_id"))).withColumn("reason", F.lit("unknown feature"))
    no_unit = own("unit", "unit_id").subtract(features.select(F.col("unit_id"))).withColumn("reason", F.lit("unknown unit"))
    wrong = assessments.where(~F.col("scope").isin("feature", "unit") | F.col("scope").isNull()).select(F.coalesce("feature_id", "unit_id").alias("id")).distinct().withColumn("reason", F.lit("wrong scope"))
    return twice.unionByName(no_feature).unionByName(no_unit).unionByName(wrong)


def capacity_flags(features: DataFrame, assessments: DataFrame, measures: Sequence[str]) -> DataFrame:
    """STO-2: whether a feature has a positive measure, of its own or of its unit."""
    any_ = F.coalesce(F.bool_or(F.greatest(*(F.coalesce(F.col(m), F.lit(0.0)) for m in measures)) > 0), F.lit(False))
    own = assessments.where("scope = 'feature'").groupBy("feature_id").agg(any_.alias("own"))
    unit = assessments.where("scope = 'unit'").groupBy("unit_id").agg(any_.alias("shared"))
    out = features.select("feature_id", "unit_id").join(own, "feature_id", "left").join(unit, "unit_id", "left")
    return out.select("feature_id", (F.coalesce("own", F.lit(False)) | F.coalesce("shared", F.lit(False))).alias("quantitative"))


def coverage_pivot(overlaps: DataFrame, regions: DataFrame, sources: Sequence[str]) -> DataFrame:
    """STO-3: covered share of each region by source, a column each. overlaps: region, source, area (disjoint parts)."""
    shares = overlaps.join(regions.select("region", F.col("area").alias("_whole")), "region").withColumn("share", F.col("area") / F.col("_whole"))
    out = shares.groupBy("region").pivot("source", list(sources)).agg(F.sum("share"))
    return regions.select("region").join(out, "region", "left").na.fill(0.0, list(sources))


def regional_evidence(regions: DataFrame, crosswalk: DataFrame, flags: DataFrame) -> DataFrame:
    """STO-4: per region: any evidence, any quantitative evidence, features, covered area and percent."""
    own = crosswalk.join(flags, "feature_id", "left").groupBy("region").agg(F.count("*").alias("n_features"), F.coalesce(F.bool_or("quantitative"), F.lit(False)).alias("quantitative"), F.sum("area").alias("covered"))
    out = regions.select("region", "area").join(own, "region", "left").na.fill(0, ["n_features", "covered"]).na.fill(False, ["quantitative"])
    return out.withColumns({"mapped": F.col("n_features") > 0, "percent": 100 * F.col("covered") / F.col("area")})


def eligible(evidence: DataFrame, rule: str) -> DataFrame:
    """STO-5: regions by all_mapped, quantitative, or qualitative (mapped, but not quantitative)."""
    keep = {"all_mapped": F.col("mapped"), "quantitative": F.col("quantitative"), "qualitative": F.col("mapped") & ~F.col("quantitative")}[rule]
    return evidence.where(keep).select("region")


def exact_coverage(layer: DataFrame, graph: DataFrame, measure: str) -> DataFrame:
    """STO-6: regions on one side only, repeated or null rows of the layer, with a reason; and a total that isn't positive."""
    both = layer.select("region", F.lit(True).alias("a")).distinct().join(graph.select("region", F.lit(True).alias("b")).distinct(), "region", "full")
    sides = both.where("a is null or b is null").select("region", F.when(F.col("a").isNull(), "missing").otherwise("extra").alias("reason"))
    twice = layer.groupBy("region").count().where("count > 1").select("region", F.lit("repeated").alias("reason"))
    null = layer.where(F.col(measure).isNull()).select("region", F.lit("null").alias("reason"))
    total = layer.agg(F.sum(measure).alias("t")).where("coalesce(t, 0) <= 0").select(F.lit(None).cast("string").alias("region"), F.lit("total not positive").alias("reason"))
    return sides.unionByName(twice).unionByName(null).unionByName(total)
