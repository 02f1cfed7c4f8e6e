"""Alignment of two tokenizers by diagonal run skipping, and the links between their vocabularies over a corpus.

A text is cut where neither tokenizer can reach across: before a space between two characters that are no white space. Each new segment is encoded once by both
libraries; the ends of all new segments of a slice lie in one array a side, which `common_ends` walks: at the current index shift it compares stretches of 1, 2, 4, …
tokens, jumps over all that agree one to one, and where they differ steps through the one irregular group and goes on at the new shift. A worker keeps what it learnt of
recurring segments, so a document is a sum over its segments.

The links of a document are distinct pairs of ids with a count, never a row a link. Documents are counted by pair; the pairs of at least total/2^19 documents are at most
2^19 and are broadcast, the others meet their documents in a shuffle.

Null and empty texts, and those whose tokens don't give back their bytes, have no tokens: zeros and an empty digest. One row out for each row in: repeated rows and equal
or null ids count as documents of their own. An empty table gives an empty one. Extra columns are ignored. A text is held as long as it is; a segment without any cut is
encoded in one piece.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import one_thread, tokenizer_path
from gridloom.session import drop_folder, materialize

#: Pairs that are broadcast at most.
MOST_PAIRS = 1 << 19
#: Text characters worked on at once, segments a worker keeps, characters given to a library at once.
SLICE_CHARS, KEPT_SEGMENTS, KEPT_CHARS, CALL_CHARS = 2 << 20, 600_000, 16 << 20, 1 << 18
#: A group of more links than this is counted by distinct ids.
WIDE = 4096

CUT = re.compile(r"(?<=[^\s\u180e])(?= [^\s\u180e])").split
EDGE = re.compile(r"\A[\s\u180e]|[\s\u180e]\Z|\A\Z").search
#: Bits of an id in a pair.
ID_BITS = 20


def common_ends(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have; a and b ascend.

    From (i, j) the shift j - i is kept for as long as stretches of 1, 2, 4, … ends agree; the first stretch that doesn't is halved to where they part. There the side
    that lies behind steps on until the ends meet again, at another shift.
    """
    n, m, i, j = len(a), len(b), 0, 0
    at_i, at_j, lengths = [], [], []
    while i < n and j < m:
        if a[i] != b[j]:
            x, y = a[i], b[j]
            while x != y:
                if x < y:
                    i += 1
                    if i == n:
                        break
                    x = a[i]
                else:
                    j += 1
                    if j == m:
                        break
                    y = b[j]
            else:
                continue
            break
        run, step, most = 1, 1, min(n - i, m - j)
        while run < most:
            k = min(step, most - run)
            if a[i + run : i + run + k] == b[j + run : j + run + k]:
                run, step = run + k, 2 * step
                continue
            while k > 1:  # they part within the next k
                half = k // 2
                if a[i + run : i + run + half] == b[j + run : j + run + half]:
                    run, k = run + half, k - half
                else:
                    k = half
            break
        at_i.append(i)
        at_j.append(j)
        lengths.append(run)
        i, j = i + run, j + run
    n_of = np.array(lengths, np.int64)
    inner = np.arange(n_of.sum()) - np.repeat(np.cumsum(n_of) - n_of, n_of)
    return np.repeat(np.array(at_i, np.int64), n_of) + inner, np.repeat(np.array(at_j, np.int64), n_of) + inner


def _binary(items: list[bytes]) -> pa.Array:
    return pa.array(items, pa.large_binary())


def _taken(table: pa.Array, at: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """Entries of a binary table end to end, and where each begins and ends."""
    got = table.take(pa.array(at))
    _, where, data = got.buffers()
    offsets = np.frombuffer(where, np.int64)[: len(got) + 1]
    return memoryview(data).cast("B")[: offsets[-1]] if data is not None else memoryview(b""), offsets


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, … sizes[0] of them, then those of the next."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) - np.repeat(before - starts, sizes)


class ByteSide:
    """A byte-level BPE file; strings of special tokens inside texts are plain text."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        one_thread()
        self.own = Tokenizer.from_file(path)
        self.own.encode_special_tokens = True
        kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        moved = [b for b in range(256) if b not in set(kept)]
        back = {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(moved)}
        vocab = self.own.get_vocab()
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for entry, k in vocab.items():
            self.bytes[k] = bytes(back[c] for c in entry) if all(c in back for c in entry) else entry.encode()

    def ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text with a space before it."""
        return [e.ids for e in self.own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class PieceSide:
    """A sentencepiece model that puts a space before a text."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        from gridloom.llm.token_counts import PieceCounter

        PieceCounter(path)  # raises where texts can't be cut at spaces
        self.own = own = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = [bytes([int(own.id_to_piece(k)[3:5], 16)]) if own.is_byte(k) else own.id_to_piece(k).replace("▁", " ").encode() for k in range(own.get_piece_size())]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class Grown:
    """A numpy array that grows."""

    def __init__(self, kind: type) -> None:
        self.n, self.room = 0, np.zeros(1024, kind)

    def extend(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.room):
            room = np.zeros(max(2 * len(self.room), self.n + len(more)), self.room.dtype)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(more)] = more
        self.n += len(more)

    @property
    def all(self) -> np.ndarray:
        return self.room[: self.n]


class Aligner:
    """What a worker knows of segments: counts, the groups as text, and the links as pair numbers."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.a, self.b = ByteSide(path_a), PieceSide(path_b)
        self.bytes_a, self.bytes_b = _binary(self.a.bytes), _binary(self.b.bytes)
        size_a, size_b = len(self.a.bytes), len(self.b.bytes)
        if max(size_a, size_b) >> ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        self.base = size_a
        #: decimal ids of both sides with each mark that can follow: entry 3 * id + mark, those of b after those of a
        self.marked = _binary([b"%d%s" % (k, mark) for n in (size_a, size_b) for k in range(n) for mark in (b",", b"|", b";")])
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        #: words that aren't segments: what stands before or after joins them
        self.edgy: set[str] = set()
        self.chars = 0
        #: n_a, n_b, n_groups, n_links, whether the bytes differ
        self.counts = [Grown(np.int64) for _ in range(5)]
        self.text, self.text_ends = Grown(np.uint8), Grown(np.int64)
        self.links, self.times, self.link_ends = Grown(np.int64), Grown(np.int32), Grown(np.int64)
        self.text_ends.extend(np.zeros(1, np.int64))
        self.link_ends.extend(np.zeros(1, np.int64))

    def learn(self, words: list[str]) -> None:
        """Words hold no space and no white space at their edges: they are encoded as one text."""
        whole = (" " + " ".join(words)).encode()
        ids = [np.array(side.ids([" ".join(words)])[0], np.int64) for side in (self.a, self.b)]
        first = np.append(np.flatnonzero(np.frombuffer(whole, np.uint8) == 0x20), len(whole))
        cuts = []
        for flat, table in zip(ids, (self.bytes_a, self.bytes_b), strict=True):
            data, offsets = _taken(table, flat)
            cut = np.searchsorted(offsets, first)
            if len(first) != len(words) + 1 or data != whole or not np.array_equal(offsets[cut], first):
                return self.learn_apart(words)
            cuts.append(np.diff(cut))
        self.enter(words, *ids, *cuts, np.ones(len(words), bool))

    def learn_apart(self, segments: list[str]) -> None:
        """Each segment as a text of its own."""
        ids = [side.ids(segments) for side in (self.a, self.b)]
        sizes = [np.fromiter(map(len, own), np.int64, len(own)) for own in ids]
        flats = [np.fromiter((k for x in own for k in x), np.int64, int(n.sum())) for own, n in zip(ids, sizes, strict=True)]
        good = np.ones(len(segments), bool)
        for flat, n, table in zip(flats, sizes, (self.bytes_a, self.bytes_b), strict=True):
            data, offsets = _taken(table, flat)
            bounds = offsets[np.append(0, np.cumsum(n))]
            good &= np.fromiter((data[lo:hi] == (" " + s).encode() for s, lo, hi in zip(segments, bounds[:-1], bounds[1:], strict=True)), bool, len(segments))
        self.enter(segments, *flats, *sizes, good)

    def enter(self, words: list[str], flat_a: np.ndarray, flat_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, good: np.ndarray) -> None:
        """Align new segments and put them into the tables. good: whether both sides' tokens give back the bytes."""
        # only segments whose bytes agree take part: their ends lie end to end in one array a side
        in_a, in_b = np.repeat(good, n_a), np.repeat(good, n_b)
        flat_a, flat_b = flat_a[in_a], flat_b[in_b]
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        at_a, at_b = common_ends(ends_a.tolist(), ends_b.tolist())
        from_a, from_b = np.append(0, at_a[:-1] + 1)[: len(at_a)], np.append(0, at_b[:-1] + 1)[: len(at_b)]
        size_a, size_b = at_a + 1 - from_a, at_b + 1 - from_b
        own_a = np.where(good, n_a, 0)
        word_of = np.searchsorted(np.cumsum(own_a), at_a, "right")  # the segment of each group
        n_groups = np.bincount(word_of, minlength=len(words))
        n_links = np.bincount(word_of, weights=size_a * size_b, minlength=len(words)).astype(np.int64)
        # the groups as text: all of a group's a, then its b, each id with the mark that follows
        sizes = size_a + size_b
        start = np.cumsum(sizes) - sizes
        entry = np.zeros(int(sizes.sum()), np.int64)
        mark = np.zeros(len(entry), np.int64)
        place_a, place_b = _places(start, size_a), _places(start + size_a, size_b)
        entry[place_a], entry[place_b] = flat_a, flat_b + self.base
        mark[start + size_a - 1], mark[start + sizes - 1] = 1, 2
        data, offsets = _taken(self.marked, 3 * entry + mark)
        last = np.append(0, np.cumsum(np.bincount(word_of, weights=sizes, minlength=len(words)).astype(np.int64)))
        text_ends = offsets[last[1:]]
        # the links: a row for each pair of a group, or for each pair of distinct ids with its count where a group is wide
        wide = size_a * size_b > WIDE
        pair, of = [], []
        fine = np.flatnonzero(~wide)
        sa, sb = size_a[fine], size_b[fine]
        n = sa * sb
        group, inner = np.repeat(np.arange(len(fine)), n), _places(np.zeros(len(fine), np.int64), n)
        pair.append((flat_a[from_a[fine][group] + inner // sb[group]] << ID_BITS) | flat_b[from_b[fine][group] + inner % sb[group]])
        of.append(word_of[fine][group])
        times = [np.ones(len(group), np.int64)]
        for g in np.flatnonzero(wide):
            (xa, ca), (xb, cb) = (np.unique(flat[f[g] : f[g] + s[g]], return_counts=True) for flat, f, s in ((flat_a, from_a, size_a), (flat_b, from_b, size_b)))
            pair.append(((xa[:, None] << ID_BITS) | xb[None, :]).ravel())
            times.append((ca[:, None] * cb[None, :]).ravel())
            of.append(np.full(len(xa) * len(xb), word_of[g]))
        pairs, word, times_ = np.concatenate(pair), np.concatenate(of), np.concatenate(times)
        order = np.argsort(word, kind="stable")
        for table, values in zip(self.counts, (own_a, np.where(good, n_b, 0), n_groups, n_links, ~good), strict=True):
            table.extend(values)
        self.text_ends.extend(self.text.n + text_ends)
        self.text.extend(np.frombuffer(data, np.uint8))
        self.link_ends.extend(self.link_ends.all[-1] + np.cumsum(np.bincount(word, minlength=len(words))))
        self.links.extend(pairs[order])
        self.times.extend(times_[order])
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.chars += sum(map(len, words))

    def taught(self, new: set[str], learn: Callable[[list[str]], None]) -> None:
        """Learn new segments, so many at once that a call's ids stay small."""
        own, size = [], 0
        for w in new:
            own.append(w)
            size += len(w)
            if size > CALL_CHARS:
                learn(own)
                own, size = [], 0
        if own:
            learn(own)

    def rows(self, texts: list[str | None]) -> pa.RecordBatch:
        """n_a, n_b, n_groups, n_links, groups_sha256, links (pair, n) of each text."""
        if len(self.known) > KEPT_SEGMENTS or self.chars > KEPT_CHARS:
            self.forget()
        segments = [t.split(" ") if t else [] for t in texts]
        seen = {w for own in segments for w in own}
        new = seen - self.known.keys() - self.edgy
        edgy = {w for w in new if EDGE(w)}
        self.edgy |= edgy
        self.taught(new - edgy, self.learn)
        if met := seen & self.edgy:
            for k, own in enumerate(segments):
                if not met.isdisjoint(own):
                    segments[k] = [s[1:] for s in CUT(" " + texts[k])]
            self.taught({s for own in segments for s in own} - self.known.keys(), self.learn_apart)
        flat = [s for own in segments for s in own]
        at = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        first = np.append(0, np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments))))
        total = lambda values: np.diff(np.append(0, np.cumsum(values))[first])
        sums = [total(table.all[at]) for table in self.counts]
        bad = sums.pop() > 0
        groups = pa.Array.from_buffers(pa.large_binary(), self.text_ends.n - 1, [None, pa.py_buffer(self.text_ends.all), pa.py_buffer(self.text.all)])
        data, offsets = _taken(groups, at)
        bounds = offsets[first]
        none = bad | (sums[0] == 0)
        digests = ["" if no else hashlib.sha256(data[lo : hi - 1]).hexdigest() for no, lo, hi in zip(none, bounds[:-1], bounds[1:], strict=True)]
        # links of all segments of a document, by pair
        ends, sizes = self.link_ends.all, np.diff(self.link_ends.all)[at]
        place = _places(ends[at], sizes)
        doc = np.repeat(np.repeat(np.arange(len(texts)), np.diff(first)), sizes)
        key, times = self.links.all[place] | (doc << 2 * ID_BITS), self.times.all[place]
        if bad.any():
            keep = ~bad[doc]
            key, times = key[keep], times[keep]
        if (times == 1).all():
            key.sort()
        else:
            order = np.argsort(key)
            key, times = key[order], times[order]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        counts = np.add.reduceat(times, begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64)
        key = key[begin]
        pairs = pa.StructArray.from_arrays([pa.array(key & ((1 << 2 * ID_BITS) - 1)), pa.array(counts)], names=["pair", "n"])
        offsets = np.searchsorted(key, np.arange(len(texts) + 1) << 2 * ID_BITS)
        columns = [pa.array(np.where(none, 0, s), pa.int64()) for s in sums]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)], names=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])


@lru_cache(maxsize=1)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_a: str = "byte_bpe_50k.json", model_b: str = "piece_bpe_32k.model") -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256 and links: array of (pair, n), pair = a's id << 20 | b's id, for each row."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(tokenizer_path(model_a), tokenizer_path(model_b))
        for b in batches:
            texts = b.column(1).to_pylist()
            begin, size = 0, 0
            for k, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE_CHARS or k == len(texts) - 1:
                    got = own.rows(texts[begin : k + 1])
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, k + 1 - begin), *got.columns], names=[id_col, *got.schema.names])
                    begin, size = k + 1, 0

    kind = docs.schema[id_col].dataType.simpleString()
    counts = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, n: long>>"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(aligned, f"`{id_col}` {kind}, {counts}")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, n_docs, best (no pair of the same a is in more documents)."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs"))
    counts = materialize(counts, "pairs")
    a = F.shiftright("pair", ID_BITS).alias("_a")
    most = counts.groupBy(a).agg(F.max("n_docs").alias("_most"))  # at most a row an entry of a's vocabulary
    out = materialize(counts.select("*", a).join(most, "_a").select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best")), "pair_counts")
    drop_folder(counts)
    return out


def alignment_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = MOST_PAIRS, **models: str) -> DataFrame:
    """align() with n_best (links whose pair is in the most documents of all of its a) and count_sum (documents of the pair, over links)."""
    # the written rows' numbers stay as they are: files don't change
    own = materialize(align(docs, id_col, text_col, **models).withColumn("_row", F.monotonically_increasing_id()), "aligned")
    stats = pair_counts(own)
    size = stats.agg(F.count("*").alias("n"), F.sum("n_docs").alias("total")).first()
    # of all pairs at most total / least are in least documents or more
    least = 1 if size.n <= most_pairs else -(-size.total // most_pairs)
    links = own.select("_row", F.explode("links").alias("l")).select("_row", "l.pair", "l.n")
    often = F.broadcast(stats.where(F.col("n_docs") >= least))
    met = links.join(often, "pair")
    if least > 1:
        rest = links.join(often.select("pair"), "pair", "left_anti").join(stats.where(F.col("n_docs") < least).hint("merge"), "pair")
        met = met.unionByName(rest)
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return own.drop("links").join(sums, "_row", "left").select(id_col, "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
