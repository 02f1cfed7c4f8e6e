"""Mixing sources to target weights by iterative proportional fitting.

Tokens (words) are summed by source, language and topic; the cell masses are raked until each margin meets its target, in turn, and a cell's mass over its tokens is the
probability with which each of its documents is kept. A mass never exceeds the cell's tokens: documents can't be kept more than once, so other cells of a margin take
up what a small one can't give. Which documents stay is decided by a hash of the row, so the sample is the same at any partitioning, and equal rows share their fate.

Targets default to each margin's own shares to a power below one (a temperature), which lifts small sources and languages. There may be any number of sources: up to
`FEW_CELLS` cells (counted first) are raked in memory, more as DataFrames, by the same steps. Raking that doesn't settle raises; `margins` reports what was reached.

Null labels are a value like any other. Null or empty texts weigh nothing and are kept as their cell is. Equal rows are kept or not together. A very long text is one
row's work. An empty table gives none. Extra columns are dropped.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.session import drop_folder, materialize

#: Words are split at these; topics are the first of these that a text matches, else "prose".
GAP = r"[\x20\x09-\x0D]+"
TOPICS = (("table", r" \| "), ("contact", r"@|\+[0-9]"), ("licence", r"(?i)license|copyright"))
POWERS = {"source": 0.5, "lang": 0.8, "topic": 0.9}
#: Rounds after which raking is given up, the share of the budget that a round still moves when it has settled, and cells raked in memory at most.
ROUNDS, TOLERANCE, FEW_CELLS = 500, 1e-4, 1 << 16


def n_tokens(text: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), rf"^{GAP}|{GAP}$", "")
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, GAP))).cast("long")


def topic_of(text: Column) -> Column:
    out = F.lit("prose")
    for name, expression in reversed(TOPICS):
        out = F.when(F.coalesce(text, F.lit("")).rlike(expression), name).otherwise(out)
    return out


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, row, source, lang, topic, n_tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "source", "lang", topic_of(F.col("text")).alias("topic"), n_tokens(F.col("text")).alias("n_tokens"))


def default_targets(cells: DataFrame, powers: dict[str, float] = POWERS) -> dict[str, DataFrame]:
    """For each margin its values with their target shares: own shares to a power, normed."""
    found = {}
    for margin, power in powers.items():
        own = cells.groupBy(margin).agg(F.pow(F.sum("tokens"), power).alias("t"))
        total = own.agg(F.sum("t").alias("all"))
        found[margin] = own.join(F.broadcast(total)).select(margin, (F.col("t") / F.col("all")).alias("target"))  # total is one row
    return found


def same(margin: str) -> Column:
    return F.col(f"l.{margin}").eqNullSafe(F.col(f"r.{margin}"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], budget: float, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells with mass: at most their tokens, and in total budget, as near the targets' shares in every margin as that allows.

    cells has the margins and tokens. Values without a target get none. Ends when a round moves no mass by over tolerance times the budget.
    """
    state = cells
    for margin, wanted in targets.items():
        state = state.alias("l").join(wanted.alias("r"), same(margin), "left").select("l.*", (F.coalesce("r.target", F.lit(0.0)) * budget).alias(f"want_{margin}"))
    few = state.limit(FEW_CELLS + 1).toArrow()
    if few.num_rows <= FEW_CELLS:
        return state.sparkSession.createDataFrame(raked(few, list(targets), budget, rounds, tolerance), state.schema.add("mass", "double"))
    state, fixed = materialize(state.withColumn("mass", F.col("tokens") * F.lit(1.0)), "cells"), state.columns
    for _ in range(rounds):
        step = state.select(*fixed, "mass", F.col("mass").alias("was"))
        for margin in targets:
            sums = step.groupBy(margin).agg(F.sum("mass").alias("sum"))
            scaled = F.least(F.col("l.mass") * F.col(f"l.want_{margin}") / F.col("r.sum"), F.col("l.tokens") * F.lit(1.0))
            step = step.alias("l").join(sums.alias("r"), same(margin)).select(*(F.col(f"l.{c}") for c in (*fixed, "was")), F.when(F.col("r.sum") > 0, scaled).otherwise(0.0).alias("mass"))
        new = materialize(step, "cells")
        drop_folder(state)
        state = new
        moved = state.agg(F.sum(F.abs(F.col("mass") - F.col("was")))).first()[0]
        if not moved or moved <= tolerance * budget:
            return state.drop("was")
    raise RuntimeError("the mixture did not settle")


def raked(cells: pa.Table, margins: list[str], budget: float, rounds: int, tolerance: float) -> pa.Table:
    """The rounds of rake() on few cells in memory."""
    tokens = cells["tokens"].to_numpy().astype(np.float64)
    codes = {m: cells[m].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for m in margins} if len(tokens) else {}
    want = {m: cells[f"want_{m}"].to_numpy() for m in codes}
    mass = tokens.copy()
    for _ in range(rounds):
        was = mass
        for m, own in codes.items():
            sums = np.bincount(own, mass)[own]
            mass = np.where(sums > 0, np.minimum(mass * want[m] / np.where(sums > 0, sums, 1), tokens), 0)
        if np.abs(mass - was).sum() <= tolerance * budget:
            return cells.append_column("mass", pa.array(mass))
    raise RuntimeError("the mixture did not settle")


def margins(fitted: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """margin, value, target, reached (shares) of what rake() gave: where no document can be kept twice, small values stay below their target."""
    total = fitted.agg(F.sum("mass").alias("all"))
    parts = []
    for margin, wanted in targets.items():
        own = fitted.groupBy(margin).agg(F.sum("mass").alias("mass")).join(F.broadcast(total))  # total is one row
        own = own.alias("l").join(wanted.alias("r"), same(margin), "left").select(F.lit(margin).alias("margin"), F.col(f"l.{margin}").cast("string").alias("value"), F.coalesce("r.target", F.lit(0.0)).alias("target"), (F.col("mass") / F.col("all")).alias("reached"))
        parts.append(own)
    return reduce(DataFrame.unionByName, parts)


def mix(docs: DataFrame, share: float = 0.7, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] = POWERS, seed: int = 5) -> DataFrame:
    """doc_id, row, source, lang, topic, n_tokens, probability, kept of each row. share: of all tokens that the kept documents hold, in expectation, if the targets allow it.

    targets: for each margin (source, lang, topic, or some of them) a DataFrame of its values and target shares.
    """
    rows = materialize(labelled(docs), "labelled")
    margins = list(powers if targets is None else targets)
    cells = rows.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    fitted = rake(cells, default_targets(cells, powers) if targets is None else {m: targets[m] for m in margins}, share * total)
    fitted = fitted.select("source", "lang", "topic", F.when(F.col("tokens") > 0, F.col("mass") / F.col("tokens")).otherwise(1.0).alias("probability"))
    on = reduce(lambda a, b: a & b, (same(m) for m in ("source", "lang", "topic")))
    u = F.pmod(F.xxhash64("l.doc_id", "l.row", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    return rows.alias("l").join(fitted.alias("r"), on).select("l.*", F.round("r.probability", 9).alias("probability"), (u < F.round("r.probability", 9)).alias("kept"))
