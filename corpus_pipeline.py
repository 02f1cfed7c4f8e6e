"""The corpus pipeline: quality, near-copies, benchmark passages, mixture, token shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it to the shared folder as Parquet and reads it back as the next one's docs. All but the
last return the columns of documents, extra ones included. A stage decides on all that the one before kept. Each stage of an empty table is empty; a very long text is
one row's work in each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table
from gridloom.llm.decontaminate import find_benchmark
from gridloom.llm.mixing import mix
from gridloom.llm.quality import score_quality
from gridloom.llm.simhash import near_copy_groups
from gridloom.llm.sstable import token_shards
from gridloom.session import materialize


def only(docs: DataFrame, good: DataFrame) -> DataFrame:
    """docs whose row (doc_id, hash of the text) is in good."""
    keys = good.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_row"))
    return docs.join(keys, same, "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject. Null and empty texts stay; equal rows stay or go together."""
    return only(docs, score_quality(docs).where("kept"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose SimHash fingerprints meet in a Golay-code key and whose five-word shingles have a Jaccard similarity of 0.8 or more the document with the smallest doc_id (null last, then by text); of rows that repeat it, one. Texts without words are one group."""
    first = near_copy_groups(docs)
    # grouped by the join's own keys, texts are dealt out once
    key = lambda row: (F.col("doc_id").isNull().alias("_none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_id"), row.alias("_row"))
    rows = docs.groupBy(*key(F.xxhash64("text"))).agg(F.min(F.struct(*docs.columns)).alias("own"))
    return rows.join(first.select(*key(F.col("row"))), ["_none", "_id", "_row"], "left_semi").select("own.*")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. Null and empty texts stay; equal rows stay or go together."""
    return only(docs, find_benchmark(docs, table(spark, sf_dir, "benchmark")).where(F.size("spans") == 0))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the target mixture. Null labels are values; texts without words weigh nothing and are kept as their cell is; equal rows stay or go together."""
    return only(docs, mix(docs).where("kept"))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, read back: doc_id, start, n_tokens, ids_crc32. A null id comes first; null and empty texts are the end id alone; equal ids are ordered by text."""
    return token_shards(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("benchmark", benchmark), ("mixture", mixture), ("shards", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs


#: Classifier, shingle hashes and tokenizer can't be said in SQL; the tests hold the result against a brute-force version.
ORACLE_SQL = None
