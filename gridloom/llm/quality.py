"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on every whole text, and overlap on purpose: each kind of junk is met by two. Expectation-maximisation over the counts of
vote patterns (all documents; at most 3**labellers patterns, so the counts are small at any size) estimates how each labeller votes on good and on bad texts, and the
posterior of each pattern. A logistic scorer on hashed features (word shapes by share, and binned statistics) learns the posteriors of a sample of at most `sample_rows`
documents, taken by a hash of the row; it then scores every document. No true label is used; they only measure held-out accuracy in the tests.

Null or empty texts, and texts too short for a statistic, get no vote from it and are kept unless others speak against them. Repeated rows get equal scores. With no rows
at all there is nothing to fit and nothing to score. A very long text is a slice of its own. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes
from gridloom.llm.words import LOWER, NOT_SPACE, text_slices, words

SAMPLE_ROWS, FEATURES, LEAST_QUALITY = 10_000, 1 << 14, 0.5
FEW_WORDS, FEW_LETTERS = 20, 40

_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "#$%&*@^~=<>{}[]\\/+_|"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_LETTER = _UPPER.copy()
_LETTER[0x61:0x7B] = True
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")
_PLAIN_END = np.zeros(256, bool)
_PLAIN_END[[*range(0x61, 0x7B), *range(0x41, 0x5B), *range(0x80, 0x100), ord("."), ord(",")]] = True

STATS = ("n_words", "marks", "upper", "lone", "bangs", "odd_ends", "top", "echo", "variety", "plain")


@dataclass
class Features:
    """Statistics (a row a text), and hashed word shapes with their share of the text's words."""

    stats: np.ndarray
    text: np.ndarray
    bucket: np.ndarray
    share: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    own = words(data, offsets, NOT_SPACE)
    n_texts, n = len(offsets) - 1, np.diff(own.first)
    of, one = own.text_of(), np.maximum(n, 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    def per_word(flags: np.ndarray) -> np.ndarray:
        return np.bincount(of[flags], minlength=n_texts) / one

    letters, solid = per_text(_LETTER[data]), np.maximum(per_text(NOT_SPACE[data]), 1)
    last, first = data[own.ends - 1] if len(own) else data[:0], data[own.starts] if len(own) else data[:0]
    lone = (own.ends - own.starts == 1) & ~_PLAIN_END[last] & ~((last >= 0x30) & (last < 0x3A))
    before = data[np.maximum(own.ends - 2, 0)] if len(own) else data[:0]
    doubled = (own.ends - own.starts > 2) & (last == before) & ~_PLAIN_END[last] & ~((last >= 0x30) & (last < 0x3A))
    hashes = own.hashes(LOWER)
    echo = np.zeros(len(own), bool)
    echo[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    key = np.sort(of.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(new)
    owner, runs = (key[at] >> np.uint64(40)).astype(np.int64), np.diff(np.append(at, len(key)))
    distinct, top = np.bincount(owner, minlength=n_texts), np.zeros(n_texts, np.int64)
    np.maximum.at(top, owner, runs)
    long_enough = n >= FEW_WORDS
    known = lambda x, ok: np.where(ok, x, np.nan)
    stats = np.stack(
        [
            n.astype(float),
            known(per_text(_MARK[data]) / solid, long_enough),
            known(per_text(_UPPER[data]) / np.maximum(letters, 1), letters >= FEW_LETTERS),
            known(per_word(lone), long_enough),
            known(per_word(last == ord("!")), long_enough),
            known(per_word(doubled), long_enough),
            known(top / one, long_enough),
            known(per_word(echo), long_enough),
            known(distinct / np.sqrt(one), long_enough),
            known(per_word(_PLAIN_END[last] & _PLAIN_END[first]), long_enough),
        ],
        axis=1,
    )
    shape = _SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = shape[1:] != shape[:-1]
    kept[offsets[:-1][offsets[:-1] < len(data)]] = True
    shapes = words(shape[kept], np.concatenate([[0], np.cumsum(kept)])[offsets], NOT_SPACE)
    # the first half of the features holds shapes, the second half binned statistics
    bucket = (shapes.hashes() % np.uint64(FEATURES // 2)).astype(np.int64)
    return Features(stats, of, bucket, 1 / one[of])


def votes(stats: np.ndarray) -> np.ndarray:
    """A column a labeller: 1 good, -1 bad, 0 nothing."""
    _, marks, upper, lone, bangs, odd_ends, top, echo, variety, plain = stats.T
    with np.errstate(invalid="ignore"):
        bad = [marks > 0.03, odd_ends > 0.2, upper > 0.5, bangs > 0.2, lone > 0.15, (lone > 0.05) & (plain < 0.75), echo > 0.2, (top > 0.3) | (variety < 1.5)]
        good = (plain > 0.9) & (upper < 0.2) & (variety > 2) & (echo < 0.05)
    return np.stack([*(-x.astype(np.int8) for x in bad), good.astype(np.int8)], axis=1)


LABELLERS = 9


def pattern(v: np.ndarray) -> np.ndarray:
    """Votes as one number, base 3."""
    return (v.astype(np.int64) + 1) @ 3 ** np.arange(v.shape[1])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """The probability that a text of each pattern is good, by expectation-maximisation over two classes with independent votes (-1, 0, 1)."""
    v = patterns[:, None] // 3 ** np.arange(LABELLERS)[None, :] % 3
    hot = v[:, :, None] == np.arange(3)[None, None, :]
    rate = np.zeros((2, LABELLERS, 3))  # class bad, good
    rate[0], rate[1] = (0.3, 0.6, 0.1), (0.01, 0.19, 0.8)
    rate[0, :-1], rate[1, :-1] = (0.3, 0.69, 0.01), (0.01, 0.98, 0.01)
    prior = np.array([0.2, 0.8])
    post = np.full(len(v), 0.8)
    for _ in range(rounds):
        log = np.log(prior)[None, :] + np.einsum("plk,clk->pc", hot, np.log(rate))
        new = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
        for c, share in enumerate((1 - post, post)):
            w = counts * share
            rate[c] = (np.einsum("p,plk->lk", w, hot) + 0.5) / (w.sum() + 1.5)
            prior[c] = (w.sum() + 1) / (counts.sum() + 2)
    return post


def binned(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, weight) of the statistics, each one-hot over its bins."""
    edges = [np.array([0, 1, 5, 20, 100, 1000]), *([np.array([0.005, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.8])] * 7), np.array([0.5, 1, 1.5, 2, 3, 5, 8]), np.array([0.25, 0.5, 0.7, 0.8, 0.9, 0.97])]
    bins = np.stack([np.where(np.isnan(stats[:, k]), 15, np.searchsorted(e, np.nan_to_num(stats[:, k]), "right")) for k, e in enumerate(edges)], axis=1)
    place = FEATURES // 2 + np.arange(len(edges))[None, :] * 16 + bins
    return np.repeat(np.arange(len(stats)), len(edges)), place.ravel(), np.full(place.size, 0.5)


def joined(f: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    text, bucket, weight = binned(f.stats)
    return np.concatenate([f.text, text]), np.concatenate([f.bucket, bucket]), np.concatenate([f.share, weight])


def fit(rows: np.ndarray, buckets: np.ndarray, weights: np.ndarray, target: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels by gradient steps with momentum scaling (Adam); the last weight is the bias."""
    w, m, s = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    rate = rate / 5
    for k in range(1, rounds + 1):
        z = np.bincount(rows, weights * w[buckets], minlength=len(target)) + w[-1]
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / max(len(target), 1)
        g = np.append(np.bincount(buckets, weights * err[rows], minlength=FEATURES), err.sum()) + decay * w
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
    return w


def _mapped(rows: DataFrame, made, schema: str) -> DataFrame:
    """made(first row, end row, features, batch) gives a RecordBatch for each slice of texts (the last column)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in text_slices(b.column(b.num_columns - 1), 2 << 20):
                yield made(row, end, features(data, offsets), b)

    return rows.mapInArrow(run, schema)


def score_quality(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, least: float = LEAST_QUALITY) -> DataFrame:
    """doc_id, row (hash of the text), quality (0 to 1), kept (quality >= least) of each row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), as_bytes("text").alias("text"))
    schema = "doc_id long, row long, quality double, kept boolean"

    def counted(row: int, end: int, f: Features, b: pa.RecordBatch) -> pa.RecordBatch:
        values, n = np.unique(pattern(votes(f.stats)), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], names=["pattern", "n"])

    met = _mapped(rows.select("text"), counted, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    if not met:
        return spark.createDataFrame([], schema)
    patterns, counts = (np.array(x, np.int64) for x in zip(*met, strict=True))
    good = estimate(patterns, counts)

    def sampled(row: int, end: int, f: Features, b: pa.RecordBatch) -> pa.RecordBatch:
        own, bucket, weight = joined(f)
        order = np.argsort(own, kind="stable")
        bounds = np.searchsorted(own[order], np.arange(end - row + 1))
        pick = [order[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        sums = [np.unique(bucket[p], return_inverse=True) for p in pick]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(pattern(votes(f.stats)), pa.int64()),
                pa.array([v.astype(np.int32) for v, _ in sums], pa.list_(pa.int32())),
                pa.array([np.bincount(i, weight[p]) for (_, i), p in zip(sums, pick, strict=True)], pa.list_(pa.float64())),
            ],
            names=["pattern", "buckets", "weights"],
        )

    share = min(1.0, sample_rows / counts.sum())
    chosen = rows.where(F.pmod(F.xxhash64("doc_id", "row", F.lit(11)), F.lit(1 << 30)) < int(share * (1 << 30))).select("text")
    sample = _mapped(chosen, sampled, "pattern long, buckets array<int>, weights array<double>").limit(2 * sample_rows).toArrow()
    sizes = np.array([len(x) for x in sample["buckets"]], np.int64)
    flat = lambda c: np.concatenate([x.values.to_numpy() for x in sample[c]]) if len(sizes) else np.zeros(0)
    known = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    weights = fit(np.repeat(np.arange(len(sizes)), sizes), flat("buckets").astype(np.int64), flat("weights"), np.array([known[p] for p in sample["pattern"].to_pylist()]))
    shared = spark.sparkContext.broadcast(weights)

    def scored(row: int, end: int, f: Features, b: pa.RecordBatch) -> pa.RecordBatch:
        own, bucket, weight = joined(f)
        z = np.bincount(own, weight * shared.value[bucket], minlength=end - row) + shared.value[-1]
        quality = np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)
        return pa.RecordBatch.from_arrays([*(b.column(c).slice(row, end - row) for c in (0, 1)), pa.array(quality), pa.array(quality >= least)], names=["doc_id", "row", "quality", "kept"])

    return _mapped(rows, scored, schema)
