"""Repeated passages of `window` words or more, by fixed-block anchors.

Each text is cut into non-overlapping reference blocks of (window + 1) // 2 words; any window holds a whole one. All blocks are indexed by hash and every rolling window
of a block's length probes the index; a block is an anchor if its hash occurs at two places or more. Only windows over an anchor can repeat, so only those are
extended: windows whose hash (the bucket and four bytes) meets again are compared word for word, and runs of the ones that repeat are the maximal exact repeats.

Texts are dealt into chunks by a hash of the row. A chunk's hashes go to buckets as packed sorted arrays, each value once with a flag for "twice here", so a passage
that a third of all texts hold costs a bucket one value a chunk. Buckets and chunks are bounded by the data's size and not by how often anything occurs.

Inside a chunk, equal hashes are compared at once. Across chunks a bucket puts the places of a hash in a row and each is compared with the one before it: runs of
windows that face runs of windows travel as one text to the chunk before, so every chunk compares no more than it holds itself. Hashes that meet by chance fail there;
a place that failed on all its sides counts as a repeat only if its words, which failed places spell out, occur at another failed place.

A chunk's texts are shuffled once and read five times from that shuffle. Null or empty texts have no words and nothing removed. Repeated rows count as separate
documents: their windows meet. A very long text makes its chunk longer. An empty table gives none. Extra columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes
from gridloom.llm.decontaminate import among, runs
from gridloom.llm.words import NOT_SPACE, Words, same_windows, text_slices, words

WINDOW = 35
#: Text bytes a chunk holds, text bytes whose hashes a bucket holds, and chunks of a partition, about.
CHUNK_BYTES, BUCKET_BYTES, TASK_CHUNKS = 8 << 20, 32 << 20, 2

PACKED = "bucket long, chunk long, hashes binary, aligned binary, twice binary"
FOUND = "bucket long, chunk long, hashes binary"
PLACED = "bucket long, chunk long, hashes array<int>, at array<int>"
LINKS = "chunk long, at array<int>, to_chunk array<long>, to_at array<int>, place array<int>, places array<int>"
ASKED = "chunk long, at int, words binary, from_chunk long, from_at int, place array<int>, places array<int>"
FAILED = "place int, places int, chunk long, at int, words binary"
CLEAN = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, text string"


def ordered(group: pa.Table) -> pa.Table:
    """A chunk's rows in an order that doesn't depend on how they arrive, so that word places mean the same each time."""
    return group.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def split(texts: pa.ChunkedArray) -> Words:
    """All words of a chunk."""
    data, starts, ends, first, at, base = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], 0, 0
    for part in texts.chunks:
        for _, _, raw, offsets in text_slices(part):
            own = words(raw, offsets, NOT_SPACE)
            data.append(raw)
            starts.append(own.starts + base)
            ends.append(own.ends + base)
            first.append(own.first[1:] + at)
            at, base = at + len(own), base + len(raw)
    return Words(*map(np.concatenate, (data, starts, ends, first)))


def hashed(own: Words, step: int = 1 << 20) -> np.ndarray:
    """Word hashes, some words at a time."""
    parts = [Words(own.data, own.starts[i : i + step], own.ends[i : i + step], own.first) for i in range(0, len(own), step)]
    return np.concatenate([np.zeros(0, np.uint64), *(p.hashes() for p in parts)])


def lists(values: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))


def cuts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end."""
    return np.append(np.flatnonzero(np.append(True, keys[1:] != keys[:-1])), len(keys)) if len(keys) else np.zeros(1, np.int64)


def first_same(own: Words, at: np.ndarray, hashes: np.ndarray, window: int) -> np.ndarray:
    """For each window (at ascending) the place of the first one with the same words among those of its hash."""
    rep, left = at.copy(), np.arange(len(at))
    while len(left):
        left = left[np.lexsort((at[left], hashes[left]))]
        new = np.append(True, hashes[left[1:]] != hashes[left[:-1]])
        first = at[left[new]][np.cumsum(new) - 1]
        same = new.copy()
        same[~new] = same_windows(own, at[left[~new]], own, first[~new], window)
        rep[left[same]] = first[same]
        left = left[~same]
    return rep


def packed(chunk: int, hashes: np.ndarray, aligned: np.ndarray, buckets: int) -> pa.Table:
    """A row for each bucket: its distinct hashes (four bytes of each) in order, whether some reference block has each, whether it occurs twice here."""
    bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
    order = np.lexsort((hashes.astype(np.uint32), bucket))
    bucket, hashes, aligned = bucket[order], hashes[order].astype("<u4"), aligned[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    twice = np.diff(np.append(at, len(hashes))) > 1
    any_aligned = np.logical_or.reduceat(aligned, at) if len(at) else aligned
    bucket, hashes = bucket[at].astype(np.int64), hashes[at]
    bounds = cuts(bucket)
    cut = [slice(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table(
        {
            "bucket": bucket[bounds[:-1]],
            "chunk": np.full(len(cut), chunk, np.int64),
            "hashes": pa.array([hashes[c].tobytes() for c in cut], pa.binary()),
            "aligned": pa.array([np.packbits(any_aligned[c]).tobytes() for c in cut], pa.binary()),
            "twice": pa.array([np.packbits(twice[c]).tobytes() for c in cut], pa.binary()),
        }
    )


def met(group: pa.Table) -> pa.Table:
    """Of a bucket's block hashes, for each chunk those that some reference block has and that occur at two places or more."""
    own = [np.frombuffer(x.as_buffer(), "<u4") for x in group["hashes"]]
    flag = lambda name: np.concatenate([np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=len(h)) for x, h in zip(group[name], own, strict=True)])
    values, where, counts = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    indexed = np.zeros(len(values), bool)
    indexed[where[flag("aligned") > 0]] = True
    counts[where[flag("twice") > 0]] += 1
    good = (indexed & (counts > 1))[where]
    bounds = np.cumsum([0, *map(len, own)])
    found = [h[good[a:b]].tobytes() for h, a, b in zip(own, bounds[:-1], bounds[1:], strict=True)]
    out = pa.table({"bucket": group["bucket"], "chunk": group["chunk"], "hashes": pa.array(found, pa.binary())})
    return out.filter(pa.array([len(x) > 0 for x in found], pa.bool_()))


def gathered(found: pa.Table) -> np.ndarray:
    """The found block hashes of a chunk with their bucket above, sorted."""
    parts = [np.frombuffer(own.as_buffer(), "<u4").astype(np.uint64) | np.uint64(bucket) << np.uint64(32) for bucket, own in zip(found["bucket"].to_pylist(), found["hashes"], strict=True)]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def flat(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)


def lengths(table: pa.Table, name: str) -> np.ndarray:
    return np.diff(table[name].combine_chunks().offsets.to_numpy())


def linked(group: pa.Table) -> pa.Table:
    """A bucket's windows that meet again: for each chunk their places, and the chunk and place that each is compared with (chunk -1: the first of its hash)."""
    hashes, at = (flat(group, c) for c in ("hashes", "at"))
    at, twice = np.where(at < 0, ~at, at), at < 0
    chunk = np.repeat(group["chunk"].to_numpy(), lengths(group, "at"))
    order = np.lexsort((at, chunk, hashes))
    hashes, at, twice, chunk = hashes[order], at[order], twice[order], chunk[order]
    bounds = cuts(hashes)
    n = np.diff(bounds)
    places = np.repeat(n, n).astype(np.int32)
    place = (np.arange(len(hashes)) - np.repeat(bounds[:-1], n)).astype(np.int32)
    to_chunk, to_at = np.where(place > 0, np.roll(chunk, 1), -1), np.roll(at, 1)
    use = np.flatnonzero((places > 1) | twice)
    use = use[np.lexsort((at[use], chunk[use]))]
    bounds = cuts(chunk[use])
    columns = {"at": at, "to_chunk": to_chunk, "to_at": to_at, "place": place, "places": places}
    return pa.table({"chunk": chunk[use][bounds[:-1]], **{c: lists(v[use], bounds) for c, v in columns.items()}})


def anchors(own: Words, hashes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and hashes of all rolling windows of a block's length; which of them are reference blocks."""
    at, h = own.windows(hashes, block)
    return at, h, (at - own.first[own.text_of()[at]]) % block == 0


def find_repeats(docs: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES, hash_bits: int = 64) -> DataFrame:
    """doc_id, n_words, spans (runs of words under a window that also starts elsewhere: start, end exclusive), text (the words left, one space apart) of each row.

    hash_bits: bits of a window's hash that are used; fewer ones make more comparisons and the same result.
    """
    if window < 2:
        raise ValueError("a window has two words at least")
    spark, block = docs.sparkSession, (window + 1) // 2
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks, buckets = max(2 * least, -(-size // chunk_bytes)), max(least, -(-size // bucket_bytes))
    rows = docs.select(
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), as_bytes("text").alias("text")
    ).repartition(max(least, chunks // TASK_CHUNKS), "chunk")

    def windows_of(own: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, h = own.windows(hashes, window)
        return at, h & np.uint64((1 << hash_bits) - 1)

    def blocks_of(key: tuple, group: pa.Table) -> pa.Table:
        own = split(ordered(group)["text"])
        _, h, aligned = anchors(own, hashed(own), block)
        return packed(key[0].as_py(), h, aligned, buckets)

    def candidates(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        own = split(ordered(group)["text"])
        hashes = hashed(own)
        at, h, aligned = anchors(own, hashes, block)
        at, h = at[aligned], h[aligned]
        short = (h >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        live = np.zeros(len(hashes) + block, bool)
        live[at[among(short, gathered(found))[0]]] = True
        at, h = windows_of(own, hashes)
        start = own.first[own.text_of()[at]]
        use = live[start + -(-(at - start) // block) * block]  # the first reference block in the window is an anchor
        at, h = at[use], h[use]
        rep, index, counts = np.unique(first_same(own, at, h, window), return_index=True, return_counts=True)
        bucket = ((h[index] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((h[index].astype(np.uint32), bucket))
        bounds = cuts(bucket[order])
        return pa.table(
            {
                "bucket": bucket[order][bounds[:-1]],
                "chunk": np.full(len(bounds) - 1, key[0].as_py(), np.int64),
                "hashes": lists(h[index][order].astype(np.uint32).view(np.int32), bounds),
                "at": lists(np.where(counts > 1, ~rep, rep)[order].astype(np.int32), bounds),
            }
        )

    def asked(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        """Runs of a chunk's windows that face a run of windows of another chunk, with their words."""
        at, to_chunk, to_at, place, places = (flat(found, c) for c in ("at", "to_chunk", "to_at", "place", "places"))
        order = np.lexsort((at, to_at.astype(np.int64) - at, to_chunk))
        order = order[to_chunk[order] >= 0]
        at, to_chunk, to_at, place, places = (v[order] for v in (at, to_chunk, to_at, place, places))
        go_on = (np.diff(at) == 1) & (np.diff(to_at) == 1) & (to_chunk[1:] == to_chunk[:-1])
        bounds = np.append(np.flatnonzero(np.append(True, ~go_on)), len(at)) if len(at) else np.zeros(1, np.int64)
        own = split(ordered(group)["text"]) if len(at) else None
        first, last = at[bounds[:-1]].astype(np.int64), at[bounds[1:] - 1].astype(np.int64) + window if len(at) else at
        data = own.data.tobytes() if own else b""
        spelled = [b" ".join(data[own.starts[a] : own.ends[b - 1]].split()) for a, b in zip(first, last, strict=True)]
        return pa.table(
            {
                "chunk": to_chunk[bounds[:-1]], "at": to_at[bounds[:-1]], "words": pa.array(spelled, pa.binary()), "from_chunk": np.full(len(first), key[0].as_py(), np.int64), "from_at": first.astype(np.int32),
                "place": lists(place, bounds), "places": lists(places, bounds),
            }
        )

    def compared(key: tuple, group: pa.Table, runs_in: pa.Table) -> pa.Table:
        """Both places, spelled out, of each comparison that fails."""
        n = lengths(runs_in, "place") if len(runs_in) else np.zeros(0, np.int64)
        i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        here, there = (split(ordered(group)["text"]), split(runs_in["words"])) if len(runs_in) else (None, None)
        if len(runs_in):
            p, q = np.repeat(there.first[:-1], n) + i, np.repeat(runs_in["at"].to_numpy().astype(np.int64), n) + i
            bad = np.flatnonzero(~same_windows(there, p, here, q, window))
        else:
            bad = p = q = np.zeros(0, np.int64)
        spell = lambda own, k: [b" ".join(own.data[a:b].tobytes() for a, b in zip(own.starts[x : x + window], own.ends[x : x + window], strict=True)) for x in k.tolist()]
        place, places = (flat(runs_in, c)[bad] if len(runs_in) else bad for c in ("place", "places"))
        far = (np.repeat(runs_in["from_chunk"].to_numpy(), n)[bad], (np.repeat(runs_in["from_at"].to_numpy(), n) + i)[bad])
        return pa.table(
            {
                "place": pa.array(np.append(place, place - 1).astype(np.int32)), "places": pa.array(np.append(places, places).astype(np.int32)),
                "chunk": pa.array(np.append(far[0], np.full(len(bad), key[0].as_py())).astype(np.int64)), "at": pa.array(np.append(far[1], q[bad]).astype(np.int32)), "words": pa.array((spell(there, p[bad]) + spell(here, q[bad])) if len(bad) else [], pa.binary()),
            }
        )

    def cleaned(key: tuple, group: pa.Table, found: pa.Table) -> pa.Table:
        group = ordered(group)
        own = split(group["text"])
        covered = np.zeros(len(own), bool)
        if len(found):
            hashes = hashed(own)
            at, h = windows_of(own, hashes)
            wrong = np.repeat(found["wrong"].to_numpy(zero_copy_only=False), lengths(found, "at"))
            again, alone = (flat(found, "at")[w].astype(np.int64) for w in (~wrong, wrong))
            use = among(h, np.unique(h[np.searchsorted(at, again)]))[0]
            at, rep = at[use], first_same(own, at[use], h[use], window)
            names, where, counts = np.unique(rep, return_inverse=True, return_counts=True)
            good = np.isin(names, again) & ~(np.isin(names, alone) & (counts == 1))
            at = at[good[where]]
            cover = np.zeros(len(own) + 1, np.int64)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + window, -1)
            covered = np.cumsum(cover[:-1]) > 0
        texts, spans = [], []
        for i, text in enumerate(group["text"]):
            parts, flags = text.as_py().split(), covered[own.first[i] : own.first[i + 1]]
            cut = runs(flags) if flags.any() else []
            for s, e in reversed(cut):
                del parts[s:e]
            spans.append([{"start": s, "end": e} for s, e in cut])
            texts.append(b" ".join(parts))
        return pa.table(
            {
                "doc_id": group["doc_id"],
                "n_words": pa.array(np.diff(own.first), pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "text": pa.array(texts, pa.binary()).cast(pa.string()),
            }
        )

    by_chunk = rows.groupBy("chunk")
    in_buckets = lambda df: df.repartition(max(least, buckets), "bucket").groupBy("bucket")
    live = in_buckets(by_chunk.applyInArrow(blocks_of, PACKED)).applyInArrow(met, FOUND)
    wide = by_chunk.cogroup(live.groupBy("chunk")).applyInArrow(candidates, PLACED)
    links = in_buckets(wide).applyInArrow(linked, LINKS)
    failed = by_chunk.cogroup(by_chunk.cogroup(links.groupBy("chunk")).applyInArrow(asked, ASKED).groupBy("chunk")).applyInArrow(compared, FAILED)
    # a place between two others is compared twice, the first and the last one of a hash once
    alone = failed.groupBy("chunk", "at", "words").agg(F.count("*").alias("n"), F.first("place").alias("place"), F.first("places").alias("places"))
    alone = alone.where(F.col("n") == F.when((F.col("place") == 0) | (F.col("place") == F.col("places") - 1), 1).otherwise(2))
    spelled = failed.select("words", "chunk", "at").distinct().groupBy("words").count().where("count = 1")
    wrong = alone.join(spelled, "words", "left_semi").select("chunk", F.array("at").alias("at"), F.lit(True).alias("wrong"))
    found = links.select("chunk", "at", F.lit(False).alias("wrong")).unionByName(wrong)
    return by_chunk.cogroup(found.groupBy("chunk")).applyInArrow(cleaned, CLEAN)


def digest(found: DataFrame) -> DataFrame:
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


#: DuckDB SQL of op3.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT r, i, md5(array_to_string(w[i:i + 34], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN again USING (h)),
n AS (SELECT r, list(p) AS ps FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(w, ' ') ELSE coalesce(array_to_string(list_filter(w, lambda x, i: NOT list_contains(ps, i)), ' '), '') END) AS kept_sha256
FROM d LEFT JOIN n USING (r)
"""
