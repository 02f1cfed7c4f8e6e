"""Scenario sets and sensitivity (SCN-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expand_tweaks(tweaks: DataFrame, arity: int) -> DataFrame:
    """SCN-1: tweaks(run, param, index, mod, value): the index's parts (split at |) as columns i0 …, each alternative (split at /) a row of its own; seq keeps the file's order."""
    out = tweaks.withColumn("_parts", F.split("index", r"\|"))
    for k in range(arity):
        out = out.withColumn(f"i{k}", F.explode(F.split(F.get("_parts", F.lit(k)), "/")))
    return out.drop("_parts")


def bad_rows(rows: DataFrame, known: DataFrame) -> DataFrame:
    """SCN-2: run-file rows (seq, run, param, index, mod, value, all text) that break a rule, with the first reason."""
    parts = F.transform(F.split("index", r"\|"), lambda x: F.trim(x))
    run = F.col("run").try_cast("int")
    before = F.lag(run).over(W.orderBy("seq"))  # a run file: small
    flagged = rows.withColumn("_before", before).join(known.select("param", F.lit(True).alias("_known")), "param", "left")
    reason = (
        F.when(run.isNull(), "run is no whole number").when(F.col("value").try_cast("double").isNull(), "value is no number").when(F.col("_known").isNull(), "unknown parameter")
        .when(~F.col("mod").isin("r", "a", "s"), "unknown change").when(F.exists(parts, lambda x: x == ""), "empty index").when(F.col("_before") > run, "run falls")
    )
    return flagged.withColumn("reason", reason).where("reason is not null").drop("_before", "_known")


def _mask(index: Sequence[str]) -> Column:
    return F.concat(*(F.when(F.col(f"i{k}") == "*", "1").otherwise("0") for k in range(len(index))))


def _keyed(tweaks: DataFrame, index: Sequence[str]) -> list[Column]:
    """A tweak's wildcards as _mask, its other parts as _key: what base rows must equal."""
    return [_mask(index).alias("_mask"), F.array(*(F.col(f"i{k}") for k in range(len(index)))).alias("_key")]


def _masked(base: DataFrame, tweaks: DataFrame, index: Sequence[str]) -> DataFrame:
    """base with _mask and _key, a row for each mask that the tweaks have, so that tweaks join by equality. Masks are at most two to the number of index parts."""
    masks = sorted(r[0] for r in tweaks.select(_mask(index).alias("m")).distinct().collect())
    part = lambda k, c: F.coalesce(F.col(c).cast("string"), F.lit("\0"))
    keys = [F.struct(F.lit(m).alias("mask"), F.array(*(F.lit("*") if m[k] == "1" else part(k, c) for k, c in enumerate(index))).alias("key")) for m in masks]
    if not keys:
        return base.select("*", F.lit("").alias("_mask"), F.array().cast("array<string>").alias("_key")).where(F.lit(False))
    return base.withColumn("_m", F.explode(F.array(*keys))).select(*base.columns, F.col("_m.mask").alias("_mask"), F.col("_m.key").alias("_key"))


def apply_tweaks(base: DataFrame, tweaks: DataFrame, index: Sequence[str], value: str) -> DataFrame:
    """SCN-3, SCN-4: base rows of every run that touches them: old and new value. r: old (1 + f), a: old + f, s: f; `*` matches all.

    tweaks: run, seq, mod, value, i0 …; later tweaks of a run see what earlier ones made of a cell.
    """
    t = tweaks.select("run", "seq", "mod", F.col("value").alias("_f"), *_keyed(tweaks, index))
    hit = _masked(base, tweaks, index).join(t, ["_mask", "_key"]).drop("_mask", "_key")
    steps = F.array_sort(F.collect_list(F.struct("seq", "mod", "_f")))
    step = lambda acc, s: F.when(s["mod"] == "r", acc * (1 + s["_f"])).when(s["mod"] == "a", acc + s["_f"]).otherwise(s["_f"])
    return hit.groupBy("run", *index, value).agg(steps.alias("_steps")).select("run", *index, F.col(value).alias("old"), F.aggregate("_steps", F.col(value), step).alias("new"))


def unmatched_tweaks(base: DataFrame, tweaks: DataFrame, index: Sequence[str]) -> DataFrame:
    """SCN-3: tweaks that match no row."""
    known = _masked(base.select(*index).distinct(), tweaks, index).select("_mask", "_key").distinct()
    hit = tweaks.select("run", "seq", *_keyed(tweaks, index)).join(known, ["_mask", "_key"], "left_semi").select("run", "seq").distinct()
    return tweaks.select("run", "seq").distinct().join(hit, ["run", "seq"], "left_anti")


def fan_out(base: DataFrame, runs: DataFrame, changes: DataFrame, index: Sequence[str], value: str) -> DataFrame:
    """SCN-4: the whole table in every run, changed values put in. runs: a row a run."""
    every = base.crossJoin(runs.select("run").distinct())
    new = changes.select("run", *index, F.col("new").alias("_new"))
    return every.join(new, ["run", *index], "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def sensitivity_ranges(tables: Mapping[str, DataFrame], value: str, spread: float) -> DataFrame:
    """SCN-5: marked rows (group is not null) of several tables with bounds of value (1 +- spread)."""
    out = None
    for name, df in tables.items():
        own = df.where(F.col("group").isNotNull()).select(F.lit(name).alias("param"), "group", F.col(value).alias("value"), (F.col(value) * (1 - spread)).alias("low"), (F.col(value) * (1 + spread)).alias("high"))
        out = own if out is None else out.unionByName(own)
    return out


def elementary_effects(runs: DataFrame, resamples: int = 0, seed: int = 1) -> DataFrame:
    """SCN-6: per parameter mean, mean size and deviation of the effects along trajectories, and with resamples a 95 % half width of the mean size.

    runs: trajectory, step, param (changed at this step; null at the first), delta, y.
    """
    w = W.partitionBy("trajectory").orderBy("step")
    effects = runs.withColumn("effect", (F.col("y") - F.lag("y").over(w)) / F.col("delta")).where("param is not null")
    out = effects.groupBy("param").agg(F.avg("effect").alias("mu"), F.avg(F.abs("effect")).alias("mu_star"), F.stddev_samp("effect").alias("sigma"))
    if not resamples:
        return out
    # a Poisson bootstrap: each effect counts k times in a resample, k drawn by a hash of effect and resample
    u = F.pmod(F.xxhash64("trajectory", "step", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    k = F.when(u < 0.36788, 0).when(u < 0.73576, 1).when(u < 0.9197, 2).when(u < 0.98101, 3).otherwise(4)
    draws = effects.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("k", k)
    means = draws.groupBy("param", "b").agg(F.try_divide(F.sum(F.abs("effect") * F.col("k")), F.sum("k")).alias("m"))
    return out.join(means.groupBy("param").agg((1.96 * F.stddev_samp("m")).alias("conf")), "param", "left")


def activity_vectors(flow_out: DataFrame, categories: DataFrame, names: Sequence[str]) -> DataFrame:
    """SCN-7: total activity of each category, a row a run and a column a category."""
    return flow_out.join(categories, "tech").groupBy("scenario").pivot("category", list(names)).agg(F.sum("flow")).na.fill(0.0, list(names))
