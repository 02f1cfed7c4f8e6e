"""Vectorised words and rolling hashes over the bytes of an Arrow batch of texts.

The texts of a batch lie end to end in one buffer, so word bounds and hashes of all of them come from a few numpy passes, with no object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer single text makes a slice of its own.
SLICE_BYTES = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words are runs of anything but space and \x09-\x0D.
NOT_SPACE = ~SPACE
#: Words are runs of ASCII letters, digits and all non-ASCII bytes.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
KEEP_CASE = np.arange(256, dtype=np.uint8)

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; kept by the worker."""
    if len(_powers["up"]) < n:
        for way, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(n, base & _MASK, np.uint64)
            steps[0] = 1
            _powers[way] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a slice of texts: byte bounds, and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # len(texts) + 1

    def __len__(self) -> int:
        return len(self.starts)

    def text_of(self) -> np.ndarray:
        """For each word the index of its text."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, fold: np.ndarray = KEEP_CASE) -> np.ndarray:
        """A 64-bit hash of each word's bytes; fold maps each byte first (LOWER: A-Z to a-z). Eight bytes at a time are mixed with their place, so no sum of byte values can cancel."""
        if not len(self):
            return np.zeros(0, np.uint64)
        sizes = self.ends - self.starts
        pieces = (sizes + 7) >> 3
        first = np.cumsum(pieces) - pieces
        word = np.repeat(np.arange(len(self)), pieces)
        i = np.arange(len(word)) - first[word]
        data = np.concatenate([fold[self.data], np.zeros(8, np.uint8)])
        eights = np.ndarray(len(self.data) + 1, "<u8", data, strides=(1,))  # the eight bytes from each place on
        own = eights[self.starts[word] + 8 * i] & _KEEP[np.minimum(sizes[word] - 8 * i, 8)]
        return mixed(np.add.reduceat(mixed(own + (i + 1).astype(np.uint64) * np.uint64(_BASE)), first) + sizes.astype(np.uint64))

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts (word indices) and hashes of all windows of `size` words that lie in one text."""
        n = len(hashes)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        whole = np.ones(n - size + 1, bool)
        for back in range(1, size):  # a window that starts in the last size-1 words of a text would leave it
            at = self.first[1:] - back
            at = at[(at >= self.first[:-1]) & (at < len(whole))]
            whole[at] = False
        at = np.flatnonzero(whole)
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(hashes * down[1:], out=sums[1:])
        return at, mixed((sums[at + size] - sums[at]) * up[at] + np.uint64(size))


def same_windows(a: Words, at: np.ndarray, b: Words, to: np.ndarray, size: int) -> np.ndarray:
    """Whether the `size` words of a from each `at` on equal those of b from `to` on, byte for byte. Windows that overlap on both sides are compared once."""
    if not len(at):
        return np.zeros(0, bool)
    order = np.lexsort((at, to - at))
    p, q = at[order], to[order]
    new = np.append(True, (np.diff(q - p) != 0) | (np.diff(p) > size))
    run = np.cumsum(new) - 1
    first, last = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(p)) - 1
    n = p[last] - p[first] + size
    base = np.cumsum(n) - n
    i = np.arange(n.sum()) - np.repeat(base, n)
    x, y = np.repeat(p[first], n) + i, np.repeat(q[first], n) + i
    sizes = a.ends[x] - a.starts[x]
    bad = sizes != b.ends[y] - b.starts[y]
    like = np.flatnonzero(~bad)
    for part in np.array_split(like, max(1, int(sizes[like].sum()) >> 24)):  # bytes of some words at a time
        own = sizes[part]
        begins = np.cumsum(own) - own
        j = np.arange(own.sum()) - np.repeat(begins, own)
        other = a.data[np.repeat(a.starts[x[part]], own) + j] != b.data[np.repeat(b.starts[y[part]], own) + j]
        if len(part):
            bad[part] = np.logical_or.reduceat(other, begins)
    wrong = np.append(0, np.cumsum(bad))
    place = base[run] + p - p[first][run]
    ok = np.zeros(len(p), bool)
    ok[order] = wrong[place + size] == wrong[place]
    return ok


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> Words:
    """Runs of bytes in is_word, none across texts. offsets: where each text starts in data, and the end of the last."""
    inside = is_word[data]
    first_byte = offsets[:-1][offsets[:-1] < offsets[1:]]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    before[first_byte] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def text_slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive slices of a binary column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, where, values = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
