"""The pipeline against the operators applied by hand, on whole tables and on odd rows."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridloom.llm.sstable import encoder
from gridloom.llm.common import tokenizer_path
from tests.llm.test_near_copies import brute, recall
from tests.llm.test_operators import corpus

SF = "/root/testdata/sf0.001"


def kept_ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=repr)


def test_stages_on_the_small_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    quality = P.quality(spark, docs, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert set(kept_ids(clean)) <= set(kept_ids(quality)) and quality.count() < docs.count()

    near = P.near_copies(spark, quality, SF)
    rows = [(r.doc_id, r.text) for r in quality.select("doc_id", "text").collect()]
    assert recall(kept_ids(near), brute(rows), rows) >= 0.9

    bench = P.benchmark(spark, near, SF)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        own = split(r.text)
        n = min(10, len(own))
        grams.setdefault(n, set()).update(tuple(own[p : p + n]) for p in range(len(own) - n + 1 if n else 0))
    clean = [r.doc_id for r in near.collect() if not any(tuple(w[p : p + n]) in g for w in [split(r.text)] for n, g in grams.items() for p in range(len(w) - n + 1))]
    assert kept_ids(bench) == sorted(clean, key=repr) and len(clean) < near.count()
    mixed = P.mixture(spark, bench, SF)
    assert set(kept_ids(mixed)) < set(kept_ids(bench))
    for stage in (quality, near, bench, mixed):
        assert stage.columns == columns
    own = encoder(tokenizer_path("word_bpe_49k.json"), 1)
    want, start = [], 0
    for r in sorted(mixed.collect(), key=lambda r: r.doc_id):
        ids = np.frombuffer(own.encode([r.text.encode()])[0], "<u2")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in P.run(spark, SF).collect()) == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    docs = spark.createDataFrame([(i, t, None, "s", 1, "x") for i, t in corpus()], schema)
    for name, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() > 0, name
        if name != "shards":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row"]
        if name == "near_copies":
            assert docs.where("text is null or text = ''").count() <= 1
            assert docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").count() == 0


@pytest.mark.parametrize("stage", [s for _, s in P.STAGES])
def test_empty(spark, stage):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, docs, SF).count() == 0
