"""What several operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(text: str | Column) -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on this machine; called inside tasks too."""
    import public_tokenizers

    return public_tokenizers.path(name)


def one_thread() -> None:
    """A task has one core: libraries in it start no threads of their own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"
