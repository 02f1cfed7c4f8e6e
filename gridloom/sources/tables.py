"""Scans (SRC-*) and sinks (SNK-*) of model tables, one Parquet directory a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.operators.joins import ContractError, first_per_key, union


def _files(spark: SparkSession, root: str) -> list[str]:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    return [s.getPath().getName() for s in path.getFileSystem(conf).listStatus(path)]


def read_tables(spark: SparkSession, root: str, names: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """SRC-1: every table below root, found by listing it; names picks some of them, and one that isn't there is an error."""
    found = {n.removesuffix(".parquet"): n for n in _files(spark, root) if not n.startswith(("_", "."))}
    if missing := sorted(set(names or ()) - set(found)):
        raise ContractError(f"no such tables: {missing}")
    return {n: spark.read.parquet(f"{root}/{found[n]}") for n in (names or sorted(found))}


def read_projected(spark: SparkSession, path: str, columns: Sequence[str], key: str, measure: str) -> DataFrame:
    """SRC-2: the named columns of a CSV with a header, the measure as a number (bad becomes null), and the first row of each key in the file's order."""
    rows = spark.read.option("header", True).csv(path).select(*columns, F.col("_metadata.file_name").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return first_per_key(rows, [key], "_file", "_at").withColumn(measure, F.col(measure).try_cast("double")).drop("_file", "_at")


def read_layer(spark: SparkSession, path: str, column: str, values: Sequence) -> DataFrame:
    """SRC-3: rows whose column is one of the values; the filter reaches the Parquet scan."""
    return spark.read.parquet(path).where(F.col(column).isin(*values))


def read_bbox(df: DataFrame, tile: tuple[float, float, float, float], class_col: str | None = None, minima: Mapping[str, float] | None = None) -> DataFrame:
    """SRC-4: features whose bounds meet a tile (xmin, ymin, xmax, ymax), and whose bounds' area reaches their class's minimum; comparisons with literals prune row groups."""
    x0, y0, x1, y1 = tile
    out = df.where((F.col("xmin") <= x1) & (F.col("xmax") >= x0) & (F.col("ymin") <= y1) & (F.col("ymax") >= y0))
    if not minima:
        return out
    least = F.coalesce(*(F.when(F.col(class_col) == k, F.lit(float(v))) for k, v in minima.items()), F.lit(0.0))
    return out.where((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) >= least)


def read_facilities(spark: SparkSession, csv: str, geojson: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """SRC-5: the CSV and the GeoJSON copy of one dataset, and a row that compares their counts."""
    a = spark.read.option("header", True).csv(csv)
    b = spark.read.option("multiLine", True).json(geojson).select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))
    counts = a.agg(F.count("*").alias("n_csv")).join(b.agg(F.count("*").alias("n_geojson")), F.lit(True))
    return a, b, counts.withColumn("equal", F.col("n_csv") == F.col("n_geojson"))


def read_cost_tables(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """SRC-6: parts that share a key as one table with their cost type."""
    return union(*(spark.read.parquet(p).withColumn("cost_type", F.lit(n)) for n, p in paths.items()))


def read_output(spark: SparkSession, root: str, table: str, schema: StructType | str, required: bool = True) -> DataFrame:
    """SRC-7: a result table; one that isn't there is an error if required, else empty."""
    try:
        return spark.read.parquet(f"{root}/{table}")
    except AnalysisException as e:
        if required:
            raise ContractError(f"no table {table} in {root}") from e
        return spark.createDataFrame([], schema)


def tagged(df: DataFrame, scenario: str, iteration: int | None = None, sectors: DataFrame | None = None) -> DataFrame:
    """Result rows with their scenario (`name` or `name-iteration`) and the sector of their technology."""
    out = df.withColumn("scenario", F.lit(scenario if iteration is None else f"{scenario}-{iteration}"))
    return out if sectors is None else out.join(F.broadcast(sectors.select("tech", "sector")), "tech", "left")  # a row a technology


def write_results(df: DataFrame, path: str) -> None:
    """SNK-1: append, a directory a scenario."""
    df.write.partitionBy("scenario").mode("append").parquet(path)


def replace_scenario(df: DataFrame, path: str) -> None:
    """SNK-2: put the scenarios of df in place of what they had; others, and any without rows in df, stay (clear_scenario removes one)."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy("scenario").mode("overwrite").parquet(path)


def clear_scenario(spark: SparkSession, path: str, scenario: str, iterations: bool = False) -> None:
    """SNK-2: remove a scenario's rows, with iterations those of `scenario-<n>` too."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in _files(spark, path):
        own = name.removeprefix("scenario=")
        if own == scenario or iterations and own.startswith(f"{scenario}-") and own[len(scenario) + 1 :].isdigit():
            at = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
            at.getFileSystem(conf).delete(at, True)


def clear_after(df: DataFrame, period: int) -> DataFrame:
    """SNK-2: rows before a period, to be written over the old ones."""
    return df.where(F.col("period") < period)


def upsert(base: DataFrame, updates: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """SNK-3: base with the last update of each key (by order, descending) in place of its row."""
    last = first_per_key(updates, keys, *order).select(*base.columns)
    return base.join(last.select(*keys), list(keys), "left_anti").select(*base.columns).unionByName(last)


def export_model(tables: Mapping[str, DataFrame], root: str) -> DataFrame:
    """SNK-4: write every table, read each back, and give its rows as read."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    back = [spark.read.parquet(f"{root}/{n}").select(F.lit(n).alias("table")) for n in tables]
    return union(*back).groupBy("table").agg(F.count("*").alias("n_rows"))


def write_evidence(results: DataFrame, path: str) -> None:
    """SNK-5: verdicts or offending rows as CSV, a directory a check."""
    results.write.partitionBy("check_id").option("header", True).mode("overwrite").csv(path)


def upgrade(old: DataFrame, columns: Mapping[str, str], lives: DataFrame | None = None, keys: Sequence[str] = ("region", "tech", "vintage")) -> DataFrame:
    """SNK-6: old rows in a new table's columns (name to type): shared ones are copied, others are null. A table that gains a period takes each of lives(keys, period)."""
    rows = old
    if "period" in columns and "period" not in old.columns:
        rows = old.join(lives.select(*keys, "period"), list(keys))
    return rows.select(*(F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()))


def drop_orphan_distributions(distribution: DataFrame, demand: DataFrame) -> DataFrame:
    """SNK-6: demand distributions whose demand exists."""
    keys = ["region", "period", "commodity"]
    return distribution.join(demand.select(*keys).distinct(), keys, "left_semi")
