"""Region strings: nodes, edges `A-B`, groups `A+B` and `global`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_edge(region: Column | str = "region") -> Column:
    return F.instr(F.col(region) if isinstance(region, str) else region, "-") > 0


def edge_from(region: Column | str = "region") -> Column:
    c = F.col(region) if isinstance(region, str) else region
    return F.when(is_edge(c), F.split(c, "-", 2)[0])


def edge_to(region: Column | str = "region") -> Column:
    c = F.col(region) if isinstance(region, str) else region
    return F.when(is_edge(c), F.split(c, "-", 2)[1])


def parse_edges(df: DataFrame, region: str = "region") -> DataFrame:
    """PRJ-13: adds is_edge, region_from and region_to; the first hyphen splits."""
    return df.withColumns({"is_edge": is_edge(region), "region_from": edge_from(region), "region_to": edge_to(region)})


def numeric_order(region: Column | str = "region") -> Column:
    """PRJ-14: the first number in a region, so that R2 sorts before R10; without one, last."""
    c = F.col(region) if isinstance(region, str) else region
    return F.coalesce(F.regexp_extract(c, r"(\d+)", 1).try_cast("int"), F.lit(2**31 - 1))


def mirrored(region: Column | str = "region") -> Column:
    """B-A for A-B; a node stays."""
    c = F.col(region) if isinstance(region, str) else region
    return F.when(is_edge(c), F.concat_ws("-", edge_to(c), edge_from(c))).otherwise(c)


def undirected_key(region: Column | str = "region") -> Column:
    c = F.col(region) if isinstance(region, str) else region
    return F.concat_ws("--", F.least(edge_from(c), edge_to(c)), F.greatest(edge_from(c), edge_to(c)))


def expand_groups(df: DataFrame, regions: DataFrame, tech_groups: DataFrame | None = None, region: str = "region", tech: str = "tech_or_group") -> DataFrame:
    """DER-8: one row for each member region (and, with tech_groups(group, tech), each member technology) of a row.

    `global` stands for every known region, `A+B` for its parts; a technology group for its members, `t1+t2` for its parts.
    """
    named = df.where(F.col(region) != "global").withColumn("member", F.explode(F.split(region, r"\+")))
    every = df.where(F.col(region) == "global").crossJoin(regions.select(F.col("region").alias("member")).distinct())
    out = named.unionByName(every)
    if tech_groups is None:
        return out
    parts = out.withColumn("_part", F.explode(F.split(tech, r"\+")))
    members = tech_groups.select(F.col("group").alias("_part"), F.col("tech").alias("_member"))
    return parts.join(members, "_part", "left").withColumn("member_tech", F.coalesce("_member", "_part")).drop("_part", "_member")
