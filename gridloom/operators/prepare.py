"""Projections, filters and conforming of source columns (PRJ-*)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.joins import ContractError


def standardize(df: DataFrame, mapping: Mapping[str, str], numeric: Sequence[str]) -> tuple[DataFrame, dict[str, list[str]]]:
    """PRJ-1: rename by mapping (source to standard), turn numeric columns to double (bad becomes null), and list missing and extra source columns."""
    missing, extra = [c for c in mapping if c not in df.columns], [c for c in df.columns if c not in mapping]
    out = df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})
    return out.withColumns({c: F.col(c).try_cast("double") for c in numeric if c in out.columns}), {"missing": missing, "extra": extra}


#: The window of coordinates that can be assigned.
LAT, LON = (40, 85), (-145, -45)


def assignable(lat: Column | str = "lat", lon: Column | str = "lon") -> Column:
    """PRJ-2: whether a coordinate lies in the window and is no zero; null gives false."""
    y, x = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    return F.coalesce(y.between(*LAT) & x.between(*LON) & (y != 0) & (x != 0), F.lit(False))


def quality_profile(df: DataFrame, id_col: str, name: str, lat: str, lon: str, value: str) -> DataFrame:
    """PRJ-3: one row of counts; the null id counts as one distinct value among duplicates."""
    distinct = F.count_distinct(id_col) + F.max(F.col(id_col).isNull().cast("int"))
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(id_col).isNull()).alias("missing_id"),
        F.count_if(F.col(name).isNull()).alias("missing_name"),
        F.count_if(F.col(lat).isNull() | F.col(lon).isNull()).alias("missing_coordinate"),
        F.count_if(F.col(value) < 0).alias("negative"),
        F.count_if(F.col(value) == 0).alias("zero"),
        F.coalesce(F.count("*") - distinct, F.lit(0)).alias("duplicate_id"),
    )


def totals(df: DataFrame, flag: Column, value: str) -> DataFrame:
    """PRJ-4: rows and sums of all, flagged and other rows, as field and value."""
    one = lambda c: F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0.0))
    row = df.agg(F.count("*").cast("double").alias("all_n"), F.count_if(flag).cast("double").alias("in_n"), F.count_if(~flag).cast("double").alias("out_n"), F.coalesce(F.sum(value), F.lit(0.0)).alias("all_v"), one(flag).alias("in_v"), one(~flag).alias("out_v"))
    return row.selectExpr("stack(6, 'facilities', all_n, 'facilities_spatial', in_n, 'facilities_other', out_n, 'total', all_v, 'total_spatial', in_v, 'total_other', out_v) AS (field, value)")


def jurisdiction_code(df: DataFrame, names: DataFrame, column: str, out: str = "code") -> DataFrame:
    """PRJ-5: two letters stay, upper-case; else the trimmed, case-folded name is looked up in names(name, code); else null."""
    known = names.select(F.lower(F.trim("name")).alias("_name"), F.col("code").alias("_code"))
    short = F.upper(F.trim(column))
    return df.join(F.broadcast(known), F.lower(F.trim(column)) == F.col("_name"), "left").withColumn(out, F.when(short.rlike("^[A-Z]{2}$"), short).otherwise(F.col("_code"))).drop("_name", "_code")


def split_jurisdictions(df: DataFrame, columns: Sequence[str], wanted: Sequence[str], known: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """PRJ-6: rows with any of the wanted codes in the columns, and the rest; an unknown wanted code is an error."""
    if bad := sorted(set(wanted) - set(known)):
        raise ContractError(f"unknown jurisdictions: {bad}")
    hit = F.coalesce(F.arrays_overlap(F.array_compact(F.array(*columns)), F.array(*map(F.lit, wanted))), F.lit(False))
    return df.where(hit), df.where(~hit)


def padded(column: Column | str, width: int) -> Column:
    """PRJ-7: zeros on the left up to a width; longer ids stay whole."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


def decode(df: DataFrame, domain: DataFrame, domain_name: str, code: str, out: str) -> DataFrame:
    """PRJ-8: the label of a code in a registered domain(domain, code, label); null if it has none."""
    own = domain.where(F.col("domain") == domain_name).select(F.col("code").alias("_code"), F.col("label").alias(out))
    return df.join(F.broadcast(own), F.col(code) == F.col("_code"), "left").drop("_code")


def classify_bands(df: DataFrame, bands: DataFrame, value: str, keys: Sequence[str], check: bool = True) -> DataFrame:
    """PRJ-9: the one band(band, lower, upper, lower_inclusive, upper_inclusive; a null bound is open) that holds the value; null counts as 0.

    Rows without exactly one band are an error when checked; else they come out once for each band, or with none.
    """
    x = F.coalesce(F.col(value), F.lit(0.0))
    above = F.col("lower").isNull() | (x > F.col("lower")) | (F.col("lower_inclusive") & (x == F.col("lower")))
    below = F.col("upper").isNull() | (x < F.col("upper")) | (F.col("upper_inclusive") & (x == F.col("upper")))
    out = df.join(F.broadcast(bands), above & below, "left")  # bands: a few
    if check and (bad := out.groupBy(*keys).agg(F.count("band").alias("n")).where("n <> 1").first()):
        raise ContractError(f"{[bad[k] for k in keys]} has {bad.n} bands")
    return out


def over_class_minimum(df: DataFrame, minima: DataFrame, class_col: str, value: str) -> DataFrame:
    """PRJ-10: rows whose value reaches the minimum of their class; a class without one has no minimum."""
    own = minima.select(F.col("class").alias("_class"), F.col("minimum").alias("_minimum"))
    return df.join(F.broadcast(own), F.col(class_col) == F.col("_class"), "left").where(F.col("_minimum").isNull() | (F.col(value) >= F.col("_minimum"))).drop("_class", "_minimum")


def drop_technologies(tables: Mapping[str, DataFrame], disabled: DataFrame) -> dict[str, DataFrame]:
    """PRJ-11: every table without the rows of disabled(tech), whatever its technology column is called."""
    out = {}
    for name, df in tables.items():
        column = next((c for c in ("tech", "tech_or_group", "technology") if c in df.columns), None)
        out[name] = df if column is None else df.join(F.broadcast(disabled.select(F.col("tech").alias(column))), column, "left_anti")
    return out


def transport_mode(tech: Column | str = "tech") -> Column:
    """PRJ-12: pipeline, truck or power line by the technology's name, else null."""
    c = F.col(tech) if isinstance(tech, str) else tech
    return F.when(c.endswith("_PIPE"), "pipeline").when(c.endswith("_TRUCK"), "truck").when(c == "ELC_TRANS", "power_line")


def bin_sites(df: DataFrame, resolution: float, mean: Sequence[str], total: Sequence[str], lon: str = "lon", lat: str = "lat") -> DataFrame:
    """PRJ-15: means and sums over cells of a grid; coordinates snap half-even."""
    snap = lambda c: (F.bround(F.col(c) / resolution) * resolution).alias(c)
    return df.groupBy(snap(lon), snap(lat)).agg(*(F.avg(c).alias(c) for c in mean), *(F.sum(c).alias(c) for c in total))


def unit_category(df: DataFrame, units: DataFrame, unit: str = "unit") -> DataFrame:
    """PRJ-16: category of a unit by units(unit, category); `missing` without one, `unknown` where the table has none."""
    own = units.select(F.lower("unit").alias("_unit"), F.col("category").alias("_category"))
    blank = F.col(unit).isNull() | (F.trim(unit) == "")
    return df.join(F.broadcast(own), F.lower(F.trim(unit)) == F.col("_unit"), "left").withColumn("category", F.when(blank, "missing").otherwise(F.coalesce("_category", F.lit("unknown")))).drop("_unit", "_category")
