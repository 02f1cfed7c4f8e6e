"""Benchmark decontamination by winnowing.

An item's windows are its runs of `window` words; an item of fewer is one window. The k-gram hashes of a text are winnowed: of every `window - k + 1` consecutive ones
the least is kept, so any shared run of `window` words holds a k-gram kept on both sides. Kept document k-grams are joined with the benchmark's; every hit is extended
to the document windows around it, and those that equal a benchmark window mark their words. Items shorter than a window are below the guarantee, so for each such
length all of a document's windows of that length are looked up. Hashes only propose: a window counts where its words equal the item's, byte for byte.

A benchmark of at most `block_bytes` of text (its size is measured first) is indexed and broadcast, and documents are mapped without a shuffle. A larger one never
passes the driver: its k-grams meet the documents' in a shuffled semi-join, and the windows around the hits join the items' windows by their words.

Null or empty texts: no words, no items. Items without words match nothing. An item without an id marks words but is not listed; ids keep their type's text, repeated
ids count once. Repeated rows repeat, an empty table gives none, a very long text is a slice of its own. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes
from gridloom.llm.words import ALNUM, LOWER, Words, same_windows, text_slices, words
from gridloom.session import materialize

WINDOW, GRAM = 10, 6
BLOCK_BYTES = 32 << 20


def winnow(own: Words, hashes: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Word indices and hashes of the kept k-grams: those that are least in some `span` consecutive ones of their text."""
    at, h = own.windows(hashes, gram)
    n = len(at) - span + 1
    if n <= 0:
        return at[:0], h[:0]
    least = h[:n].copy()
    for j in range(1, span):
        np.minimum(least, h[j : j + n], out=least)
    inside = at[span - 1 :] - at[:n] == span - 1  # the span lies in one text
    kept = np.zeros(len(at), bool)
    for j in range(span):
        kept[j : j + n] |= inside & (h[j : j + n] == least)
    return at[kept], h[kept]


@dataclass
class Table:
    """Distinct windows of one length with distinct hashes: hashes in order, where each one is in the items' words, where its items start, items."""

    hashes: np.ndarray
    at: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Index:
    """A block of benchmark items: their words, kept k-grams, and for each window length its tables (a further one for windows whose hash another one has)."""

    words: Words
    grams: np.ndarray
    windows: dict[int, list[Table]]
    ids: list[object]


def tables(own: Words, at: np.ndarray, hashes: np.ndarray, items: np.ndarray, size: int) -> list[Table]:
    """Tables of the windows at `at`; a window that differs from the first one of its hash goes to the next table."""
    made = []
    while len(at):
        order = np.lexsort((at, hashes))
        at, hashes, items = at[order], hashes[order], items[order]
        values, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        same = same_windows(own, at, own, at[first][place], size)
        pairs = np.unique(np.stack([place[same], items[same]], axis=1), axis=0)
        made.append(Table(values, at[first], np.searchsorted(pairs[:, 0], np.arange(len(values) + 1)), pairs[:, 1]))
        at, hashes, items = at[~same], hashes[~same], items[~same]
    return made


def folded(data: np.ndarray, offsets: np.ndarray) -> Words:
    return words(LOWER[data], offsets, ALNUM)


def index_items(items: list[tuple[object, bytes]], window: int, gram: int) -> Index:
    own = folded(np.frombuffer(b"".join(t for _, t in items), np.uint8), np.cumsum([0, *(len(t) for _, t in items)]))
    hashes, sizes = own.hashes(), np.diff(own.first)
    _, grams = winnow(own, hashes, gram, window - gram + 1)
    of, found = own.text_of(), {}
    for size in sorted({min(int(n), window) for n in sizes if n}):
        at, h = own.windows(hashes, size)
        fit = np.minimum(sizes[of[at]], window) == size
        found[size] = tables(own, at[fit], h[fit], of[at[fit]], size)
    return Index(own, np.unique(grams), found, [i for i, _ in items])


def among(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are in the sorted table, and where."""
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return (table[at] == values if len(table) else np.zeros(len(values), bool)), at


def marked(own: Words, hashes: np.ndarray, index: Index, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """A flag for each word, and (text, item) pairs."""
    cover, pairs = np.zeros(len(own) + 1, np.int64), []
    of = own.text_of()
    for size, layers in index.windows.items():
        at, h = own.windows(hashes, size)
        if size == window:
            kept, grams = winnow(own, hashes, gram, window - gram + 1)
            hit = kept[among(grams, index.grams)[0]]
            if not len(hit):
                continue
            near = np.zeros(len(own) + 1, np.int64)  # windows that hold a hit start at most window - gram words before it
            np.add.at(near, np.maximum(hit - (window - gram), 0), 1)
            np.add.at(near, hit + 1, -1)
            use = np.cumsum(near)[at] > 0
            at, h = at[use], h[use]
        for table in layers:
            ok, place = among(h, table.hashes)
            own_at, place = at[ok], place[ok]
            same = same_windows(own, own_at, index.words, table.at[place], size)
            own_at, place = own_at[same], place[same]
            np.add.at(cover, own_at, 1)
            np.add.at(cover, own_at + size, -1)
            both = np.unique(np.stack([of[own_at], place], axis=1), axis=0)
            n = table.first[both[:, 1] + 1] - table.first[both[:, 1]]
            where = np.repeat(table.first[both[:, 1]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(np.stack([np.repeat(both[:, 0], n), table.items[where]], axis=1))
    return np.cumsum(cover[:-1]) > 0, np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.int64)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
HITS = "doc_id long, row long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"


def spans_of(flags: list[np.ndarray]) -> pa.Array:
    return pa.array([[{"start": s, "end": e} for s, e in runs(f)] if f.any() else [] for f in flags], SPANS)


def scan(rows: DataFrame, index: Index, window: int, gram: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for b in batches:
            for row, end, data, offsets in text_slices(b.column(2)):
                own = folded(data, offsets)
                flags, pairs = marked(own, own.hashes(), block, window, gram)
                bounds = np.searchsorted(pairs[:, 0], np.arange(end - row + 1))
                items = [sorted({block.ids[k] for k in pairs[bounds[i] : bounds[i + 1], 1]} - {None}) for i in range(end - row)]
                spans = spans_of([flags[own.first[i] : own.first[i + 1]] for i in range(end - row)])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(row, end - row) for c in (0, 1)), pa.array(np.diff(own.first), pa.int64()), spans, pa.array(items, pa.list_(pa.string()))],
                    names=["doc_id", "row", "n_words", "spans", "items"],
                )

    return rows.mapInArrow(scanned, HITS)


def window_texts(own: Words, at: np.ndarray, size: int) -> pa.Array:
    """The words of each window, one space apart."""
    data = own.data.tobytes()
    spell = lambda i: b" ".join(data[s:e] for s, e in zip(own.starts[i : i + size].tolist(), own.ends[i : i + size].tolist(), strict=True))
    return pa.array([spell(i) for i in at.tolist()], pa.binary())


def join_windows(rows: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """What scan() gives, for a benchmark of any size: shuffled joins of k-grams, then of windows."""

    def probes(own: Words, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(size of the window to look up, places, hashes): kept k-grams, and for short items all windows of their length."""
        hashes = own.hashes()
        for size in sizes:
            yield size, *(winnow(own, hashes, gram, window - gram + 1) if size == window else own.windows(hashes, size))

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of items: each window with its probes (null where it has none of its own) and its words."""
        for b in batches:
            for row, end, data, offsets in text_slices(b.column(1)):
                own = folded(data, offsets)
                least = np.minimum(np.diff(own.first), window)
                for size in np.unique(least[least > 0]).tolist():
                    at = own.windows(own.hashes(), size)[0]
                    at = at[least[own.text_of()[at]] == size]
                    for i in range(0, len(at), 1 << 14):
                        part = at[i : i + (1 << 14)]
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + own.text_of()[part])), pa.array(np.full(len(part), size, np.int32)), window_texts(own, part, size)], names=["item", "size", "words"])

    windows = materialize(items.mapInArrow(spelled, "item string, size int, words binary").distinct(), "windows")
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most `window` rows

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, _, data, offsets in text_slices(b.column(1)):
                own = folded(data, offsets)
                for size, at, h in probes(own, sizes):
                    text = own.text_of()[at]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row + text)), pa.array(np.full(len(at), size, np.int32)), pa.array((at - own.first[text]).astype(np.int32)), pa.array(h.view(np.int64))], names=["key", "size", "at", "gram"]
                    )

    kinds = "size int, at int, gram long"
    wanted = windows.select(F.col("words").alias("key"), "words").mapInArrow(grams, f"key binary, {kinds}").where(F.col("size") == F.least(F.size(F.split(F.col("key").cast("string"), " ")), F.lit(window)))
    rows = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")
    hits = rows.select("uid", "text").mapInArrow(grams, f"key long, {kinds}").join(wanted.select("size", "gram").distinct(), ["size", "gram"], "left_semi")

    def around(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        """Places and words of a document's windows around its hits."""
        own = folded(np.frombuffer(group["text"][0].as_py(), np.uint8), np.array([0, len(group["text"][0].as_py())]))
        size_of, at_of, out = found["size"].to_numpy(), found["at"].to_numpy().astype(np.int64), []
        for size in np.unique(size_of).tolist():
            at = at_of[size_of == size]
            if size == window:
                at = np.unique((at[:, None] - np.arange(window - gram + 1)[None, :]).ravel())
                at = at[(at >= 0) & (at <= len(own) - window)]
            out.append(pa.table({"uid": pa.array(np.full(len(at), key[0].as_py())), "size": pa.array(np.full(len(at), size, np.int32)), "at": pa.array(at.astype(np.int32)), "words": window_texts(own, at, size)}))
        return pa.concat_tables(out) if out else pa.table({"uid": pa.array([], pa.int64()), "size": pa.array([], pa.int32()), "at": pa.array([], pa.int32()), "words": pa.array([], pa.binary())})

    near = rows.select("uid", "text").groupBy("uid").cogroup(hits.groupBy("key")).applyInArrow(around, "uid long, size int, at int, words binary")
    met = materialize(near.join(windows, ["size", "words"]).select("uid", "size", "at", "item"), "met")
    # a document's places and items, each once: bounded by its words and by the items it is to list
    places = met.groupBy("uid").agg(F.collect_set(F.struct("at", "size")).alias("places"), F.array_sort(F.collect_set("item")).alias("items"))

    def marked_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, end, data, offsets in text_slices(b.column(2)):
                own, flags = folded(data, offsets), []
                for i, places in enumerate(b.column(3).slice(row, end - row).to_pylist()):
                    cover = np.zeros(own.first[i + 1] - own.first[i] + 1, np.int64)
                    for place in places or []:
                        cover[place["at"]] += 1
                        cover[place["at"] + place["size"]] -= 1
                    flags.append(np.cumsum(cover[:-1]) > 0)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(row, end - row) for c in (0, 1)), pa.array(np.diff(own.first), pa.int64()), spans_of(flags), b.column(4).slice(row, end - row)], names=["doc_id", "row", "n_words", "spans", "items"]
                )

    none = F.coalesce("items", F.expr("cast(array() as array<string>)"))
    return rows.join(places, "uid", "left").select("doc_id", "row", "text", "places", none.alias("items")).mapInArrow(marked_rows, HITS)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, row (hash of the text), n_words, spans (runs of hit words: start, end exclusive), items (ids of the items with a window in the text, as strings, ascending) of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), as_bytes("text").alias("text"))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), as_bytes("text").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16)).first()[0] or 0
    if size > block_bytes:
        return join_windows(rows, items, window, gram)
    return scan(rows, index_items([(r.item, bytes(r.text)) for r in items.toLocalIterator()], window, gram), window, gram)


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: DuckDB SQL of op4.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT DISTINCT r, n, i, item_id FROM dw JOIN bw USING (n, g)),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
