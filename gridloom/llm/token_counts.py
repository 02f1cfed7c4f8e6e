"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut where no vocabulary piece can reach across; each cut-off piece of text is a linked list of symbols from which the adjacent pair of lowest rank
(leftmost first) is popped off a heap until no known pair is left. The count is the initial symbols minus the merges: no identifiers are made.
The map has no shuffle. Each Python worker keeps the counts of short segments that recur.

Null or empty text: 0 bytes, 0 tokens. Repeated rows give repeated rows, an empty table none. Extra columns are ignored. Very long texts and segments take O(n log n).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import as_bytes, tokenizer_path

SPACE = "▁"
#: Segments whose counts a worker keeps at once, and the longest kept.
KEPT_SEGMENTS, KEPT_CHARS = 400_000, 64


class PieceCounter:
    """Counts for a sentencepiece BPE model with byte fallback and no normalisation rules."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only BPE models with byte fallback and the identity normaliser are counted")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not handled")
        self.prefix = SPACE if spec.add_dummy_prefix else ""
        self.fallback = model.trainer_spec.byte_fallback
        #: the higher its score the earlier a piece is made
        self.rank = {p.piece: -p.score for p in model.pieces if p.type == kinds.NORMAL}
        inner = {c for piece in self.rank for c in re.findall(f"(?<=[^{SPACE}]){SPACE}", piece)}
        if inner:
            raise ValueError("a piece holds a space after another character: texts can't be cut at spaces")
        # a line feed that no piece holds cuts too
        lone = "\n" if not any("\n" in p for p in self.rank) else ""
        self.segments = re.compile(f"{SPACE}+[^{SPACE}{lone}]*|[^{SPACE}{lone}]+" + ("|\n" if lone else "")).findall
        self.kept: dict[str, int] = {}

    def symbols(self, segment: str) -> int:
        """Symbols before any merge: a character outside the vocabulary gives its bytes."""
        rank = self.rank
        return sum(1 if c in rank or not self.fallback else len(c.encode("utf-8", "surrogatepass")) for c in segment)

    def merges(self, segment: str) -> int:
        """How often an adjacent pair is merged."""
        rank = self.rank
        part: list[str | None] = list(segment)
        n = len(part)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(segment[i : i + 2])) is not None]
        heapq.heapify(heap)
        made = 0
        while heap:
            _, i, size = heapq.heappop(heap)
            if part[i] is None or (j := right[i]) >= n or len(part[i]) + len(part[j]) != size:
                continue  # one of the pair has been merged since
            part[i] += part[j]
            part[j] = None
            made += 1
            k = right[i] = right[j]
            if k < n:
                left[k] = i
                if (r := rank.get(part[i] + part[k])) is not None:
                    heapq.heappush(heap, (r, i, size + len(part[k])))
            if (h := left[i]) >= 0 and (r := rank.get(part[h] + part[i])) is not None:
                heapq.heappush(heap, (r, h, len(part[h]) + size))
        return made

    def segment(self, segment: str) -> int:
        if segment in self.rank and len(segment) == 1:
            return 1
        return self.symbols(segment) - self.merges(segment)

    def count(self, text: str) -> int:
        if not text:
            return 0
        kept, total = self.kept, 0
        for s in self.segments(self.prefix + text.replace(" ", SPACE)):
            n = kept.get(s)
            if n is None:
                n = self.segment(s)
                if len(s) <= KEPT_CHARS:
                    if len(kept) >= KEPT_SEGMENTS:
                        kept.clear()
                    kept[s] = n
            total += n
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = "piece_bpe_32k.model", max_tokens: int = 4096) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > max_tokens) of each row, whole texts; one row out for each row in."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(tokenizer_path(model))
        for b in batches:
            texts = b.column(1)
            tokens = [own.count(t.as_py().decode("utf-8", "replace")) for t in texts]
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > max_tokens for n in tokens], pa.bool_())],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), as_bytes(text_col).alias("_bytes")).mapInArrow(counted, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
