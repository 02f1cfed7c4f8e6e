"""Joins with a stated cardinality, and a few shapes that many operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPSILON = 1e-5


class ContractError(ValueError):
    """Data break a stated contract."""


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count n."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", cardinality: str = "m:m", required: bool = False) -> DataFrame:
    """Equi-join that first asserts the side marked 1 has unique keys; required: every left row must find a match."""
    for side, mark, name in ((left, cardinality[0], "left"), (right, cardinality[-1], "right")):
        if mark == "1" and (row := duplicates(side, on).first()):
            raise ContractError(f"the {name} side has {row.n} rows for {[row[k] for k in on]}")
    if required and (row := left.join(right, list(on), "left_anti").first()):
        raise ContractError(f"no match for {[row[k] for k in on]}")
    return left.join(right, list(on), how)


def first_per_key(df: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def full_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only, with the side they are on."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def ranged(df: DataFrame, col: str) -> DataFrame:
    """df in range partitions of a column, written: _p, the number of a row's range; equal values share one."""
    from gridloom.session import materialize

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(df.repartitionByRange(parts, col).withColumn("_p", F.spark_partition_id()), "ranges")


def distributed_median(df: DataFrame, col: str) -> DataFrame:
    """One row, `median`: the middle value, or the mean of the two in the middle; ranks are counted a range at a time, no task holds all. Null without values."""
    rows = ranged(df.select(F.col(col).cast("double").alias("v")).where("v is not null"), "v")
    counts = rows.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select("_p", (F.sum("n").over(W.orderBy("_p")) - F.col("n")).alias("_before"), F.sum("n").over(W.partitionBy()).alias("_n"))  # a row a range
    rank = F.col("_before") + F.row_number().over(W.partitionBy("_p").orderBy("v")) - 1
    middle = rows.join(F.broadcast(before), "_p").withColumn("_r", rank).where((F.col("_r") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2)))
    return middle.agg(F.avg("v").alias("median"))


def gaps(df: DataFrame, col: str) -> DataFrame:
    """`gap`: differences of neighbouring distinct values; a range's first value is compared with the last of the range before."""
    rows = ranged(df.select(F.col(col).alias("v")).where("v is not null").distinct(), "v")
    inner = rows.select((F.col("v") - F.lag("v").over(W.partitionBy("_p").orderBy("v"))).alias("gap"))
    ends = rows.groupBy("_p").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))  # a row a range
    between = ends.select((F.col("lo") - F.lag("hi").over(W.orderBy("_p"))).alias("gap"))
    return inner.unionByName(between).where("gap is not null")


def r6(*names: str) -> list[Column]:
    """Columns rounded for comparison."""
    return [F.round(n, 6).alias(n) for n in names]


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
