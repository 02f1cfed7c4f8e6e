"""Near-duplicate embeddings by product quantisation.

Equal vectors are one class from the start. Coarse centroids and residual codebooks are fitted on a bounded sample of unit vectors; every class is then indexed: its
inverted list, the code of its residual in each subspace, and its exact quantisation error. Lists hold about `LIST_ROWS` classes at every size: their number grows with
the table, and past `LEVEL_LISTS` of them a further level of centroids quantises the residual, so lists are not capped by the sample.

A query probes each list whose border lies so near that a vector within the linking distance could lie across it: the distance to the border is compared with the
displacement of `sigmas` standard deviations of a random direction, level by level, with no cap on the number of lists. In a list, asymmetric table-lookup distances
keep a resident unless the triangle inequality (distance to its code less its error) proves it too far, so codes lose nothing; what is left is ranked by the exact
cosine in double precision.

All rows are queries. A link found from one side only counts for both of its ends: a block credits a resident whose own query does not come to the asker's list. Neighbouring lists make a group, to which a query is sent once; groups are cut into blocks of about `BLOCK_ROWS` on both sides. A block returns
counts per query and a spanning forest of its links, not the links, so a dense group costs rows in proportion to its size.

Vectors of different length link with nothing of each other: blocks hold one length. Lists and codes see the first `dim` parts (the most common length; shorter vectors
are filled with zeros), which only shortens distances. Vectors that are null, empty, zero, or hold null or non-finite parts link with nothing. Repeated rows link as
equal vectors; repeated ids with different vectors count as different rows. Extra columns are dropped. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.session import drop_folder, materialize

LEAST_COSINE = 0.9
#: Vectors that centroids and codebooks are fitted on, at most; standard deviations that a probe covers.
SAMPLE_ROWS, SIGMAS = 16_384, 2.0
#: Classes of a list, lists of a level of centroids, lists of a group, rows of a block on either side, about.
LIST_ROWS, LEVEL_LISTS, GROUP_LISTS, BLOCK_ROWS = 128, 1024, 16, 4096
SUBSPACES, CODES = 8, 256
#: Table sums are in single precision: a resident is too far only beyond this much more.
SLACK = 1e-3


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centers)[0]
        order = np.argsort(near, kind="stable")
        some, first, counts = np.unique(near[order], return_index=True, return_counts=True)
        centers[some] = np.add.reduceat(x[order], first, axis=0) / counts[:, None]
    return centers


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of the nearest center."""
    at, least = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 4096):
        d = (centers**2).sum(1)[None, :] - 2 * x[i : i + 4096] @ centers.T
        at[i : i + 4096] = d.argmin(1)
        least[i : i + 4096] = d.min(1) + (x[i : i + 4096] ** 2).sum(1)
    return at, least


def apart(centers: np.ndarray) -> np.ndarray:
    """Distances between centers."""
    own = (centers**2).sum(1)
    return np.sqrt(np.maximum(own[:, None] + own[None, :] - 2 * centers @ centers.T, 1e-30))


@dataclass
class Quantiser:
    levels: list[np.ndarray]  # for each level of centroids lists x dim; a list is a path, numbered with the last level fastest
    apart: list[np.ndarray]
    near: np.ndarray  # the group of each centroid of the last level
    books: list[np.ndarray]  # for each subspace codes x width
    cuts: np.ndarray  # subspace bounds
    reach: float  # linking distance of unit vectors

    @staticmethod
    def fit(sample: np.ndarray, lists: int, cosine: float) -> Quantiser:
        depth = 1
        while lists > LEVEL_LISTS**depth:
            depth += 1
        levels, rest = [], sample
        for _ in range(depth):
            levels.append(k_means(rest, min(round(lists ** (1 / depth)), len(rest))))
            rest = rest - levels[-1][nearest(rest, levels[-1])[0]]
        last = levels[-1]
        near = nearest(last, k_means(last, max(1, len(last) // GROUP_LISTS)))[0]
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        books = [k_means(rest[:, a:b], min(CODES, len(sample))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return Quantiser(levels, [apart(c) for c in levels], near, books, cuts, float(np.sqrt(2 - 2 * cosine)))

    def group(self, at: np.ndarray) -> np.ndarray:
        """The group of each list."""
        last = len(self.levels[-1])
        return at // last * (int(self.near.max()) + 1) + self.near[at % last]

    def centers(self, at: np.ndarray | int, depth: int | None = None) -> np.ndarray:
        """The sum of the centroids of a list, or of the first levels of a path."""
        own = 0
        for c in reversed(self.levels[:depth]):
            own, at = own + c[at % len(c)], at // len(c)
        return own

    def lists(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for c in self.levels:
            own = nearest(x, c)[0]
            at, x = at * len(c) + own, x - c[own]
        return at

    def codes(self, x: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of residents of list `at`: codes, quantisation errors, and what the tables of a query leave out of the squared distance."""
        center = self.centers(at)
        rest = x - center
        codes, error, extra = np.zeros((len(self.books), len(x)), np.uint8), np.zeros(len(x)), np.zeros(len(x))
        for m, (a, b) in enumerate(zip(self.cuts[:-1], self.cuts[1:], strict=True)):
            codes[m], own = nearest(rest[:, a:b], self.books[m])
            error += np.maximum(own, 0)
            extra += ((self.books[m] ** 2).sum(1) + 2 * self.books[m] @ center[a:b])[codes[m]]
        return codes, np.sqrt(error), extra

    def probes(self, x: np.ndarray, width: int, sigmas: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) of the lists each vector of that length probes."""
        most = self.reach * min(1.0, sigmas / np.sqrt(width))
        row, at = np.arange(len(x)), np.zeros(len(x), np.int64)
        for k, (c, between) in enumerate(zip(self.levels, self.apart, strict=True)):
            rest, rows, found = x if k == 0 else x[row], [], []
            if k:
                rest = rest - self.centers(at, k)
            for i in range(0, len(rest), 1024):
                d = (c**2).sum(1)[None, :] - 2 * rest[i : i + 1024] @ c.T
                own = d.argmin(1)
                p, j = np.nonzero(d - d[np.arange(len(d)), own][:, None] <= 2 * most * between[own])
                rows.append(p + i)
                found.append(j)
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            row, at = row[rows], at[rows] * len(c) + (np.concatenate(found) if found else rows)
        return row, at

    def tables(self, x: np.ndarray) -> list[np.ndarray]:
        """For each subspace, query and code: minus twice their product."""
        return [(-2 * x[:, a:b] @ book.T).astype(np.float32) for a, b, book in zip(self.cuts[:-1], self.cuts[1:], self.books, strict=True)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between a and b: each round every tree takes one link, and links inside trees go."""
    names, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, above, kept = flat[: len(a)], flat[len(a) :], np.arange(len(names)), []
    left = np.arange(len(a))

    def top(i: int) -> int:
        while above[i] != i:
            i = above[i]
        return i

    while len(left):
        tried = np.unique(np.concatenate([np.unique(above[side[left]], return_index=True)[1] for side in (x, y)]))
        for k in left[tried].tolist():
            p, q = top(x[k]), top(y[k])
            if p != q:
                above[max(p, q)] = min(p, q)
                kept.append(k)
        while (above != above[above]).any():
            above = above[above]
        left = left[above[x[left]] != above[y[left]]]
    return a[kept], b[kept]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def units(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) of a list column, for each length in it."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, unit(flat[starts[rows][:, None] + np.arange(n)[None, :]])


def fitted(x: np.ndarray, dim: int) -> np.ndarray:
    """The first dim parts; zeros fill shorter vectors."""
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


DEALT = "width int, `group` long, class_id long, weight long, query boolean, lists array<int>, vector array<{}>"
LINKS = "a long, b long, n long"


def found_links(classes: DataFrame, dim: int, cosine: float, sample_rows: int, sigmas: float) -> DataFrame:
    """a, b (null: n is the number of rows that link with a; else a link of a spanning forest) of the classes (class_id, weight, vector)."""
    spark, n = classes.sparkSession, classes.count()
    sample = classes.orderBy(F.xxhash64("vector"), "class_id").limit(sample_rows).select("vector").toArrow()["vector"]
    sample = np.concatenate([np.zeros((0, dim)), *(fitted(x, dim) for _, x in units(sample))])
    if not n:
        return spark.createDataFrame([], LINKS)
    shared = spark.sparkContext.broadcast(Quantiser.fit(sample, max(1, round(n / LIST_ROWS)), cosine))

    def placed(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, own lists, probing rows, probed lists) of some vectors at a time."""
        q = shared.value
        for rows, x in units(column):
            for i in range(0, len(x), 1024):
                part = fitted(x[i : i + 1024], dim)
                row, at = q.probes(part, x.shape[1], sigmas)
                yield rows[i : i + 1024], q.lists(part), rows[i : i + 1024][row], at

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            for _, own, row, at in placed(b.column(0)):
                asks = np.unique(np.stack([row, q.group(at)]), axis=1)[1]
                names, where = np.unique(np.concatenate([q.group(own), asks]), return_inverse=True)
                counts = [np.bincount(w, minlength=len(names)) for w in (where[: len(own)], where[len(own) :])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, *counts)], names=["group", "residents", "queries"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            sizes = np.diff(b.column(2).offsets.to_numpy())
            for rows, own, row, at in placed(b.column(2)):
                groups = q.group(at)
                order = np.lexsort((groups, row))
                row, at, groups = row[order], at[order], groups[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (groups[1:] != groups[:-1])))
                where = np.concatenate([rows, row[first]])
                bounds = np.concatenate([np.arange(len(rows)), len(rows) + np.append(first, len(row))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(sizes[where].astype(np.int32)),
                        pa.array(np.concatenate([q.group(own), groups[first]])),
                        *(b.column(c).take(pa.array(where)) for c in (0, 1)),
                        pa.array(np.arange(len(where)) >= len(rows)),
                        pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate([own, at]).astype(np.int32))),
                        b.column(2).take(pa.array(where)),
                    ],
                    names=["width", "group", "class_id", "weight", "query", "lists", "vector"],
                )

    def linked(key: tuple, group: pa.Table) -> pa.Table:
        """Counts and forest links of a block."""
        q = shared.value
        ids, weights, asks = (group[c].to_numpy() for c in ("class_id", "weight", "query"))
        lists = group["lists"].combine_chunks()
        of = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        at = lists.flatten().to_numpy()
        (_, x), = units(group["vector"])
        near = fitted(x, dim)
        counts, a, b = np.zeros(len(ids), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for name in np.unique(at[~asks[of]]):
            there, here = of[(at == name) & ~asks[of]], of[(at == name) & asks[of]]
            codes, errors, extra = q.codes(near[there], int(name))
            far, center = ((q.reach + errors + SLACK) ** 2 - extra).astype(np.float32)[None, :], q.centers(int(name))
            comes = None
            for i in range(0, len(here), 256):
                own = here[i : i + 256]
                d = np.repeat((((near[own] - center) ** 2).sum(1))[:, None].astype(np.float32), len(there), axis=1)
                for m, table in enumerate(q.tables(near[own])):
                    d += table[:, codes[m]]
                k, j = np.nonzero(d <= far)
                if 8 * len(k) > d.size:  # most are near: all products at once cost less than picked ones
                    k, j = np.nonzero(x[own] @ x[there].T >= cosine)
                else:
                    k, j = (v[np.einsum("ij,ij->i", x[own][k], x[there][j]) >= cosine] for v in (k, j)) if len(k) else (k, j)
                asker, resident = k + i, j
                k, j = own[k], there[j]
                other = ids[k] != ids[j]
                k, j, asker, resident = k[other], j[other], asker[other], resident[other]
                counts += np.bincount(k, weights[j], minlength=len(ids)).astype(np.int64)
                # a link has two ends: where the resident's own query does not come to the asker's list, it is credited here
                if len(k):
                    if comes is None:
                        homes, home = np.unique(q.lists(near[here]), return_inverse=True)
                        row, probed = q.probes(near[there], x.shape[1], sigmas)
                        met = np.isin(probed, homes)
                        comes = np.zeros((len(homes), len(there)), bool)
                        comes[np.searchsorted(homes, probed[met]), row[met]] = True
                    lone = ~comes[home[asker], resident]
                    counts += np.bincount(j[lone], weights[k[lone]], minlength=len(ids)).astype(np.int64)
                p, r = forest(ids[k], ids[j])
                a.append(p)
                b.append(r)
        some, (p, r) = counts > 0, forest(np.concatenate(a), np.concatenate(b))
        return pa.table(
            {
                "a": pa.array(np.concatenate([ids[some], p])),
                "b": pa.array(np.concatenate([ids[some], r]), mask=np.arange(int(some.sum()) + len(p)) < some.sum()),
                "n": pa.array(np.concatenate([counts[some], np.zeros(len(p), np.int64)])),
            }
        )

    sizes = classes.select("vector").mapInArrow(sized, "`group` long, residents long, queries long").groupBy("group").agg(F.sum("residents").alias("r"), F.sum("queries").alias("q"))
    cut = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    large = sizes.where((F.col("r") > BLOCK_ROWS) | (F.col("q") > BLOCK_ROWS)).select("group", F.greatest(cut("r"), F.lit(1)).alias("r"), F.greatest(cut("q"), F.lit(1)).alias("q"))
    kind = classes.schema["vector"].dataType.elementType.simpleString()
    rows = classes.select("class_id", "weight", "vector").mapInArrow(dealt, DEALT.format(kind)).join(large, "group", "left")
    # a resident meets each block of queries, a query each block of residents
    one = lambda c, salt: F.pmod(F.xxhash64("class_id", F.lit(salt)), F.coalesce(F.col(c), F.lit(1))).cast("int")
    every = lambda c: F.sequence(F.lit(0), F.coalesce(F.col(c), F.lit(1)) - 1)
    rows = rows.withColumn("rb", F.explode(F.when(F.col("query"), every("r")).otherwise(F.array(one("r", 1))))).withColumn("qb", F.explode(F.when(F.col("query"), F.array(one("q", 2))).otherwise(every("q"))))
    return rows.groupBy("width", "group", "rb", "qb").applyInArrow(linked, LINKS)


def near_embeddings(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = LEAST_COSINE, dim: int | None = None, sample_rows: int = SAMPLE_ROWS, sigmas: float = SIGMAS) -> DataFrame:
    """vec_id, n_links (other rows within the cosine), component_id (smallest vec_id reachable), kept (vec_id = component_id) of each row."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    if rows.schema["vector"].dataType.elementType.simpleString() not in ("float", "double"):
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.exists("vector", lambda v: v != 0), F.lit(False))
    classes = rows.where(good).groupBy("vector").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    classes = materialize(classes.withColumn("class_id", F.monotonically_increasing_id()), "vectors")
    if dim is None:
        common = classes.groupBy(F.size("vector").alias("n")).agg(F.sum("weight").alias("rows")).orderBy(F.desc("rows"), "n").first()
        dim = common.n if common else 1
    made = materialize(found_links(classes, dim, cosine, sample_rows, sigmas), "links")
    counts = made.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    # nodes that sort by the least vec_id (null last): a component's least node names it
    node = F.struct(F.col("least_id").isNull().alias("none"), "least_id", "class_id")
    links = made.where("b is not null").select(F.col("a").alias("class_id"), "b")
    links = links.join(classes.select("class_id", node.alias("x")), "class_id").select("x", F.col("b").alias("class_id"))
    links = links.join(classes.select("class_id", node.alias("y")), "class_id").select("x", "y")
    member = connected_components(links, "x", "y").select(F.col("node.class_id").alias("class_id"), F.col("component.least_id").alias("component_id"))
    placed = classes.join(member, "class_id", "left").join(counts, "class_id", "left")
    placed = placed.select("vector", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component_id", "least_id").alias("component_id"))
    placed = materialize(placed, "placed")
    drop_folder(made)
    drop_folder(classes)
    # vectors that link with nothing take no part in the join
    out = rows.where(good).join(placed, "vector").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept"))


#: DuckDB SQL of op9: all pairs, then the closure of the links.
SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS k, vec_id AS c FROM embeddings UNION SELECT p.a, r.c FROM p JOIN r ON p.b = r.k),
c AS (SELECT k, min(c) AS component_id FROM r GROUP BY k), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON k = vec_id LEFT JOIN n ON a = vec_id
"""
