"""Token ids in sorted-string-table shards.

Documents are range-partitioned by identifier; each partition encodes its texts and writes one shard:

    block*   entries in key order: shared prefix length (u8), rest of the key (u8 length + bytes), value length (u32), value
    index    per block: last key (u8 length + bytes), offset (u64), length (u32)
    bloom    bits of a Bloom filter of the keys
    footer   index offset, index length, bloom offset, bloom length, entries, ids (u64 each), hashes, id bytes (u32 each), magic

Keys are order-preserving bytes (null: 00; a long: 01 and eight big-endian bytes with the sign bit turned), so a reader finds a document by the Bloom filter, a
binary search of the index and a scan of one block. Values are little-endian ids of two bytes where the vocabulary fits, else four.
A shard is written by the task that sorted it and is known only by the row that task returns: a task that runs again leaves an unused file, never a wrong one.

Null or empty text: only the end id. Null ids come first. Repeated ids give an entry each, in order of their texts' bytes. A very long text is encoded by
itself. An empty table gives no shard. Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, one_thread, tokenizer_path
from gridloom.llm.words import text_slices
from gridloom.session import new_folder

MAGIC = b"GLSST001"
FOOTER = struct.Struct("<6Q2I8s")
BLOCK_BYTES = 64 << 10
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
#: Words whose ids a worker keeps at once, and the longest kept.
KEPT_WORDS, KEPT_BYTES = 800_000, 64


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    low, high = h & (2**64 - 1), h >> 64 | 1
    return [(low + i * high) % bits for i in range(hashes)]


class Encoder:
    """Ids of texts, each followed by the end id. White space ends every pre-token of the tokenizer, so the ids of a text are those of its words, end to end.

    A worker keeps the ids of words it has met. A new word that ends in full stops or commas after an ASCII letter or digit is its two parts, and new words of letters
    only are encoded in one call: each is one pre-token, whose last id alone bears the tokenizer's end-of-word mark.
    """

    def __init__(self, path: str, end_id: int) -> None:
        one_thread()
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if max(self.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.end = np.array([end_id], self.kind).tobytes()
        self.kept: dict[bytes, bytes] = {}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        with open(path) as f:
            mark = json.load(f)["model"].get("end_of_word_suffix")
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        if mark:
            self.ends_word[[i for piece, i in vocab.items() if piece.endswith(mark)]] = True

    def one_by_one(self, new: list[bytes]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in made]

    def together(self, new: list[bytes]) -> list[bytes]:
        """Words of letters only."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(new).decode()], add_special_tokens=False)[0].ids, self.kind)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(new) or ends[-1] != len(ids):  # a letter whose lower case is more than letters
            return self.one_by_one(new)
        raw, ends = ids.tobytes(), (ends * self.width).tolist()
        return [raw[s:e] for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, found: set[bytes]) -> dict[bytes, bytes]:
        """Ids of these words; short ones are kept."""
        kept = self.kept
        cut, plain, other = [], {}, []
        for w in found:
            base = w.rstrip(b".,")
            if len(base) < len(w) and base and base[-1:].isalnum():
                cut.append((w, base, w[len(base) :]))
                for part in (base, w[len(base) :]):
                    if part not in kept and part not in found:
                        plain[part] = None
            else:
                plain[w] = None
        own, letters = {}, []
        for w in plain:
            (letters if w.isalpha() or (not w.isascii() and w.decode("utf-8", "replace").isalpha() and b"\xef\xbf\xbd" not in w) else other).append(w)
        if letters:
            own.update(zip(letters, self.together(letters), strict=True))
        if other:
            own.update(zip(other, self.one_by_one(other), strict=True))
        for w, base, tail in sorted(cut, key=lambda x: len(x[0])):
            own[w] = (own[base] if base in own else kept[base]) + (own[tail] if tail in own else kept[tail])
        if len(kept) > KEPT_WORDS:
            kept.clear()
        kept.update((w, x) for w, x in own.items() if len(w) <= KEPT_BYTES)
        return own

    def encode(self, texts: list[bytes]) -> list[bytes]:
        parts = [t.split() for t in texts]
        met = set().union(*parts)
        kept = self.kept
        have = {w: x for w in met if (x := kept.get(w)) is not None}
        have.update(self.learn(met - have.keys()))
        return [b"".join([have[w] for w in p]) + self.end for p in parts]


@lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> Encoder:
    return Encoder(path, end_id)


def output_stream(path: str):
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    store.create_dir(inner.rpartition("/")[0], recursive=True)
    return store.open_output_stream(inner)


class ShardWriter:
    """Writes entries that come in key order; holds one block, the index and the Bloom filter's keys."""

    def __init__(self, sink, id_bytes: int) -> None:
        self.sink, self.id_bytes = sink, id_bytes
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index, self.keys, self.ids = [], [], 0

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        rest = key[shared:]
        self.block += struct.pack("<BB", shared, len(rest)) + rest + struct.pack("<I", len(value)) + value
        self.last = key
        self.keys.append(key)
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self.sink.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self.flush()
        index = b"".join(struct.pack("<B", len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index)
        bits = max(64, -(-len(self.keys) * BLOOM_BITS_PER_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for k in self.keys:
            bloom[bloom_places(k, bits, BLOOM_HASHES)] = True
        packed = np.packbits(bloom).tobytes()
        self.sink.write(index + packed + FOOTER.pack(self.at, len(index), self.at + len(index), len(packed), len(self.keys), self.ids, BLOOM_HASHES, self.id_bytes, MAGIC))
        self.sink.close()


class ShardReader:
    """Point lookups and ordered scans of one shard; reads the footer, index and filter, then single blocks."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        self.file = store.open_input_file(inner)
        size = self.file.size()
        tail = self.file.read_at(FOOTER.size, size - FOOTER.size)
        at, n, bloom_at, bloom_n, self.entries, self.ids, self.hashes, self.id_bytes, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no shard")
        raw, self.index, i = self.file.read_at(n, at), [], 0
        while i < n:
            k = raw[i + 1 : i + 1 + raw[i]]
            offset, length = struct.unpack_from("<QI", raw, i + 1 + raw[i])
            self.index.append((k, offset, length))
            i += 1 + raw[i] + 12
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(bloom_n, bloom_at), np.uint8))
        self.kind = np.dtype(f"<u{self.id_bytes}")

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        _, offset, length = self.index[k]
        raw, i, key = self.file.read_at(length, offset), 0, b""
        while i < length:
            shared, rest = raw[i], raw[i + 1]
            key = key[:shared] + raw[i + 2 : i + 2 + rest]
            (size,) = struct.unpack_from("<I", raw, i + 2 + rest)
            i += 6 + rest
            yield key, raw[i : i + size]
            i += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, value in self.block(k):
                yield id_of(key), np.frombuffer(value, self.kind)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier."""
        key, found = key_of(doc_id), []
        if not self.entries or not all(self.bloom[bloom_places(key, len(self.bloom), self.hashes)]):
            return found
        k = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while k < len(self.index):
            for own, value in self.block(k):
                if own == key:
                    found.append(np.frombuffer(value, self.kind))
                elif own > key:
                    return found
            k += 1
        return found


#: Text bytes of a shard, about.
SHARD_BYTES = 64 << 20

MANIFEST = "shard int, path string, first_id long, last_id long, n_docs long, n_ids long"


def write_shards(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end_id: int = 1, shards: int | None = None) -> DataFrame:
    """Encode and write all documents below folder; returns the manifest (also kept there): shard, path, first_id, last_id, n_docs, n_ids.

    The ids of shard k come before those of shard k + 1. shards: how many ranges; by default the session's shuffle partitions, or more, so that a shard has about `SHARD_BYTES` of text.
    """
    spark = docs.sparkSession

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, writer, first, last, n = encoder(tokenizer_path(tokenizer), end_id), None, None, None, 0
        k = TaskContext.get().partitionId()
        path = f"{folder}/shards/{k:06d}-{uuid.uuid4().hex}.sst"
        for b in batches:
            ids = b.column(0).to_pylist()
            for row, end, data, offsets in text_slices(b.column(1), 2 << 20):
                at = offsets.tolist()
                raw = data.tobytes()
                for doc_id, value in zip(ids[row:end], own.encode([raw[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]), strict=True):
                    if writer is None:
                        writer, first = ShardWriter(output_stream(path), own.width), doc_id
                    writer.add(key_of(doc_id), value)
                    last, n = doc_id, n + 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([path]), *(pa.array([x], pa.int64()) for x in (first, last, n, writer.ids))], names=["shard", "path", "first_id", "last_id", "n_docs", "n_ids"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    if shards is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    (rows.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(written, MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest"))
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every entry, read back from the files. start: ids of all documents before it, over all shards."""
    spark = manifest.sparkSession

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                entries = ShardReader(path).scan()
                while some := list(islice(entries, 1 << 12)):  # a batch at a time
                    sizes = np.array([len(own) for _, own in some], np.int64)
                    sums = [zlib.crc32(own.astype("<u4").tobytes()) for _, own in some]
                    yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(sizes.sum())

    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row a shard: small beside the data
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("start"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(tasks, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_shards(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write docs as shards below folder (default: a new one in the shared folder) and read them back."""
    return read_shards(write_shards(docs, folder or new_folder(docs.sparkSession, "sstable"), **options))
