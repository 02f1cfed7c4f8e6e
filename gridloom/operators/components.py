"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import drop_folder, materialize


#: Edges from which a round's minima are written before they are joined.
MANY = 1 << 20


def _star(edges: DataFrame) -> DataFrame:
    """Each node's least neighbour, itself included; edges go both ways in. Partial sums keep a hot node's rows apart."""
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, component (the least node of its component) for every node of a link between different nodes.

    A large star ties each larger neighbour to the least neighbour, a small star each smaller one; the rounds needed grow with the logarithm of the longest path.
    Groups are never gathered: minima are aggregated and joined back. Where edges are many the minima are a table of their own, so that both sides of the join are plain
    shuffles and adaptive execution can split a hot node. Every round ends in the shared folder. a and b may be structs; the least node is by their order.
    Null ends and self links are ignored.
    """
    edges = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct()
    )
    edges, seen = materialize(edges, "edges"), None
    for _ in range(most_rounds):
        count = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if (count.n, count.h) == seen or not count.n:
            break
        seen = (count.n, count.h)
        own = (lambda df: materialize(_star(df), "stars")) if count.n > MANY else _star
        both = _both(edges)
        large = both.join(own(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        if count.n > MANY:
            large = materialize(large, "large")
        small = large.join(own(large), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = materialize(small, "edges")
        drop_folder(edges)
        edges = new
    else:
        raise RuntimeError("components did not settle")
    kind = edges.schema["u"].dataType
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").cast(kind).alias("component")))
