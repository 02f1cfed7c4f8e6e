"""SimHash near-duplicates through Golay-code keys.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits. Two fingerprints that differ in at most 4 bits differ in at most 2 bits over some two of the
three segments together: four errors over three segments leave the two least hit at most floor(2/3 * 4) = 2. Half way between the two lies a word at most one bit
from either. Each fingerprint therefore takes, for each pair of segments, the codeword indices (perfect binary Golay code, 23 bits to 12) of all words at most one
bit away: about ten keys, and any two fingerprints that link share one. An equi-join on the keys with the exact bit count as its condition gives all links and no other.

Exact copies are one fingerprint before any key is made, so a group of copies of any size costs one row.

`simhash_components` links fingerprints of few differing bits. `near_copy_groups` asks for a similarity instead: the shingle sets of two texts must have a Jaccard
similarity of 0.8 or more, where a fingerprint differs in some ten bits. Each set has several independent fingerprints, whose keys together meet for nearly all such
pairs; of texts that share a key, one after another becomes a hub and takes those whose fingerprints are near, first inside each partition and then, among the
hubs, across them. So a group of copies of any size costs rows in proportion, and a key that holds a third of all texts reaches the shuffle as a few hubs a
partition. Each pair of a text and its hub is verified on the whole shingle sets before it links.

Texts are lower-cased in A-Z and split at \\x20 and \\x09-\\x0D; null and empty ones have no words and are one class. Repeated rows are one class; ids decide ties. A very long
text is one row's work. An empty table gives none. Extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes
from gridloom.operators.components import connected_components
from gridloom.session import drop_folder, materialize

SHINGLE, MOST_BITS = 4, 4
SEED = 42
#: Of near_copy_groups: words of a shingle, the least similarity in hundredths, fingerprints of a text, differing bits of a fingerprint beyond which a text isn't near a hub.
WORDS, LEAST, PRINTS, NEAR_BITS = 5, 80, 5, 20
#: Keys worked on together, about; bits of the filter for texts to be verified.
PART_KEYS, FILTER_BITS = 1 << 20, 1 << 22
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


def _remainders(bits: int, shift: int) -> np.ndarray:
    """value << shift modulo the generator, for all values of so many bits."""
    basis = []
    for i in range(bits):
        r = 1 << (i + shift)
        for k in range(i + shift, 10, -1):
            if r >> k & 1:
                r ^= GENERATOR << (k - 11)
        basis.append(r)
    out = np.zeros(1 << bits, np.uint32)
    for i, r in enumerate(basis):
        out[1 << i : 2 << i] = out[: 1 << i] ^ r
    return out


_LOW, _HIGH = _remainders(12, 0), _remainders(11, 12)


def syndrome(word: np.ndarray) -> np.ndarray:
    return _LOW[word & 0xFFF] ^ _HIGH[word >> 12]


def _leaders() -> np.ndarray:
    """The error of at most three bits that belongs to each syndrome."""
    errors = [sum(1 << i for i in own) for n in range(4) for own in combinations(range(23), n)]
    out = np.zeros(1 << 11, np.uint32)
    out[syndrome(np.array(errors, np.uint32))] = errors
    return out


_LEADERS = _leaders()


def codeword_index(word: np.ndarray) -> np.ndarray:
    """The 12 message bits of the codeword nearest to each 23-bit word."""
    return (word ^ _LEADERS[syndrome(word)]) >> 11


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of each fingerprint (uint64), none twice in a row."""
    near = []
    for at, bits in SEGMENTS:
        own = (prints >> np.uint64(at)).astype(np.uint32) & np.uint32((1 << bits) - 1)
        near.append(codeword_index(own[:, None] ^ np.array([0, *(1 << i for i in range(bits))], np.uint32)[None, :]).astype(np.int64))
    rows, keys = [], []
    for k, (a, b) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        own = np.concatenate([near[a] << 12 | near[b][:, :1], near[a][:, :1] << 12 | near[b][:, 1:]], axis=1)
        own.sort(axis=1)
        new = np.ones(own.shape, bool)
        new[:, 1:] = own[:, 1:] != own[:, :-1]
        rows.append(np.nonzero(new)[0])
        keys.append(own[new] | k << 24)
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set where over half of the shingles' hashes have it; 0 for no words."""
    parts = text.lower().split()
    if not parts:
        return 0
    ends = np.cumsum([len(w) + 1 for w in parts])
    joined = b" ".join(parts)
    starts = [0, *ends[: max(0, len(parts) - shingle)].tolist()]
    ends = (ends[shingle - 1 :] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, np.int64), len(ends)
    for at in range(0, n, 1 << 16):  # a long text's hashes are counted in pieces
        own = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, row (hash of the text), print (the 64 bits as a long) of each row."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) for t in b.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own)], names=["doc_id", "row", "print"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), as_bytes(text_col).alias("text")).mapInArrow(made, "doc_id long, row long, print long")


def similar_prints(prints: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs a < b of distinct fingerprints (column print) that differ in 1 to most_bits bits; most_bits is 4 at most."""
    if most_bits > MOST_BITS:
        raise ValueError("the keys cover at most 4 differing bits")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(own), 1 << 14):
                part = own[at : at + (1 << 14)]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "print"])

    keys = prints.select("print").mapInArrow(keyed, "key long, print long")
    a, b = keys.select("key", F.col("print").alias("a")), keys.select("key", F.col("print").alias("b"))
    return a.join(b.hint("shuffle_merge"), (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most_bits)).select("a", "b").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links), n_same (rows with this fingerprint), row (hash of
    the text), group (the component's least fingerprint, as a long) of each row.

    Null and empty texts have fingerprint zero, linked like any other. Repeated rows give repeated rows. A null id gets the component's smallest other id.
    """
    own = materialize(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = own.groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_same"))
    links = similar_prints(classes, most_bits)
    member = connected_components(links).select(F.col("node").alias("print"), "component")
    # tables of their own: both sides of the joins are plain shuffles, and one that a component or a fingerprint makes hot can be split
    placed = materialize(classes.join(member, "print", "left").withColumn("component", F.coalesce("component", "print")), "placed")
    least = materialize(placed.groupBy("component").agg(F.min("first_id").alias("component_id")), "least")
    classes = materialize(placed.join(least, "component").select("print", "component_id", "n_same", "component"), "classes")
    drop_folder(placed)
    drop_folder(least)
    return own.join(classes, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id", "n_same", "row", F.col("component").alias("group"))


class _Words(dict):
    """Hashes of words met before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:  # workers live on and hold other caches too
            self.clear()
        own = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return own


_WORDS = _Words()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of a shorter text one for the whole, of none for no words."""
    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(_WORDS.__getitem__, parts), np.uint64, len(parts))
    size = min(size, len(parts))
    n = len(parts) - size + 1
    own = np.zeros(n, np.uint64)
    for i in range(size):
        own = mixed(own ^ words[i : i + n])
    return np.unique(own)


def set_prints(own: np.ndarray, n: int = PRINTS) -> np.ndarray:
    """Fingerprints of a set of hashes: each from the hashes mixed anew."""
    counts = np.zeros((n, 64), np.int64)
    for i in range(0, len(own), 1 << 14):
        part = own[i : i + (1 << 14)]
        for k in range(n):
            h = mixed(part + np.uint64(0xD1B54A32D192ED03 * (k + 1) & (1 << 64) - 1))
            counts[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(own), axis=1, bitorder="little").view("<u8")[:, 0]


def taken(key: np.ndarray, node: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows that are hubs of their key, and (rows, their hubs). Of each key's rows the one with the least mixed node is a hub and takes all near it; what is left chooses again. One order of all nodes keeps the pairs of a large group few."""
    left = np.lexsort((mixed(node.view(np.uint64)), key))
    hubs, members, above = [], [], []
    while len(left):
        first = np.append(True, key[left[1:]] != key[left[:-1]])
        hub = left[first][np.cumsum(first) - 1]
        near = ~first & (np.bitwise_count(check[left] ^ check[hub]) <= NEAR_BITS)
        hubs.append(left[first])
        members.append(left[near])
        above.append(hub[near])
        left = left[~first & ~near]
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(none + x) for x in (hubs, members, above))


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(s) for s in sets)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def _pairs(node: np.ndarray, members: np.ndarray, hubs: np.ndarray) -> np.ndarray:
    """Distinct pairs of nodes, the smaller first."""
    both = np.stack([np.minimum(node[members], node[hubs]), np.maximum(node[members], node[hubs])], axis=1)
    return np.unique(both[both[:, 0] != both[:, 1]], axis=0)


def proposed_pairs(classes: DataFrame) -> DataFrame:
    """Pairs a < b of nodes (columns node, prints) of which one is a hub of a key they share and near it."""
    spark = classes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), classes.count() * 29 * PRINTS // PART_KEYS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, prints = [np.zeros(0, np.int64)], [np.zeros((0, PRINTS), np.int64)]
        for b in batches:
            nodes.append(b.column(0).to_numpy())
            prints.append(b.column(1).flatten().to_numpy().reshape(-1, PRINTS))
        node, prints = np.concatenate(nodes), np.concatenate(prints).view(np.uint64)
        for k in range(PRINTS):
            # a key's texts are told apart by the next fingerprint
            row, key = golay_keys(prints[:, k])
            key |= k << 26
            check = prints[:, (k + 1) % PRINTS]
            hubs, members, above = taken(key, node[row], check[row])
            own = _pairs(node[row], members, above)
            key, row = key[hubs], row[hubs]
            part = (mixed(key.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((key, part))
            key, row, part = key[order], row[order], part[order]
            cut = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(part)) if len(part) else np.zeros(1, np.int64)
            packs = [slice(a, b) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            columns = [[v[p].tobytes() for p in packs] for v in (key.astype("<u4"), node[row].astype("<i8"), check[row].astype("<u8"))]
            # pairs found here go along as they are: no keys, only ends
            for column, v in zip(columns, (np.zeros(0), own[:, 0].astype("<i8"), own[:, 1].astype("<i8")), strict=True):
                column.extend([v.tobytes()] * bool(len(own)))
            where = np.append(part[cut[:-1]], [own[0, 0] % parts] if len(own) else []).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(where), *(pa.array(c, pa.binary()) for c in columns)], names=["part", "x", "y", "z"])

    def met(group: pa.Table) -> pa.Table:
        long = pc.greater(pc.binary_length(group["x"]), 0)
        keyed, ready = group.filter(long), group.filter(pc.invert(long))
        read = lambda t, c, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in t[c])])
        key, node, check = (read(keyed, c, kind) for c, kind in (("x", "<u4"), ("y", "<i8"), ("z", "<u8")))
        own = np.concatenate([_pairs(node, *taken(key, node, check)[1:]), np.stack([read(ready, c, "<i8") for c in "yz"], axis=1)])
        return pa.table({"a": own[:, 0], "b": own[:, 1]})

    made = classes.select("node", "prints").mapInArrow(local, "part int, x binary, y binary, z binary")
    return materialize(made.groupBy("part").applyInArrow(met, "a long, b long").distinct(), "proposed")


def sets_of(pairs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """row, shingles of the texts that the pairs (a, b, hashes of texts) name, as a table of its own: what is joined with it can be split where a hub has many members."""
    at = F.col("row").bitwiseAND(F.lit(FILTER_BITS - 1))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("row"))
    bits = ends.groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(row & 63 AS INT))")).alias("bits")).toArrow()  # at most FILTER_BITS / 64 rows
    wanted = np.zeros(FILTER_BITS >> 6, np.int64)
    wanted[bits["word"].to_numpy()] = bits["bits"].to_numpy()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column(0).to_numpy() & (FILTER_BITS - 1)
            b = b.filter(pa.array((wanted[at >> 6] >> (at & 63)) & 1 == 1))
            for i in range(0, b.num_rows, 1 << 9):
                part = b.slice(i, 1 << 9)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_set(t.as_buffer().to_pybytes(), size) for t in part.column(1)])], names=["row", "shingles"])

    return materialize(rows.select("row", "text").mapInArrow(sets, "row long, shingles array<long>").groupBy("row").agg(F.first("shingles").alias("shingles")), "sets")


def similar_sets(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have a Jaccard similarity of `least` hundredths or more."""
    a, b = sets.select(F.col("row").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("row").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return materialize(pairs.join(a, "a").join(b, "b").where((100 + least) * both >= least * (F.size("sa") + F.size("sb"))).select("a", "b"), "links")


def near_copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, least: int = LEAST) -> DataFrame:
    """group (hash of one of its texts), doc_id, row (hash of the text): of each component of links the row with the smallest doc_id (null last, then by hash).

    Texts of equal shingle sets are one class. A text without links is a group of its own.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("row"), as_bytes(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1 << 9):
                part = b.slice(i, 1 << 9)
                sets = [shingle_set(t.as_buffer().to_pybytes(), shingle) for t in part.column(2)]
                same = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), same, _lists([set_prints(s) for s in sets])], names=["doc_id", "row", "same", "prints"])

    own = rows.mapInArrow(made, "doc_id long, row long, same binary, prints array<long>")
    classes = own.groupBy("same").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"), F.min("row").alias("node"), F.first("prints").alias("prints"))
    classes = materialize(classes.drop("same"), "classes")
    pairs = proposed_pairs(classes)
    sets = sets_of(pairs, rows, shingle)
    links = similar_sets(pairs, sets, least)
    member = connected_components(links)
    firsts = classes.select("node", "first").join(member, "node", "left").withColumn("group", F.coalesce("component", "node"))
    out = materialize(firsts.groupBy("group").agg(F.min("first").alias("first")).select("group", "first.doc_id", "first.row"), "groups")
    for done in (classes, pairs, sets, links):
        drop_folder(done)
    return out
