"""Conversation structure repair: the cheapest edits that give each conversation a sound shape.

A sound conversation is empty, or an optional system turn and then pairs of user and assistant. Edits: Keep a row (0), Rerole it to user or assistant (3), Delete it (4; blank
and repeated rows must go), Insert an empty user or assistant turn anywhere (3); a truncated row that stays adds 3. Of equally cheap lists of edits the one whose
initials come first in ASCII order is taken.

Rows are dealt out by conversation and sorted from the last turn to the first, and a Python worker streams over them: for each of the four shapes a conversation can have come
to (nothing yet, after system, after user, after assistant) it carries the cost of what is still to come, the rank of its initials and, as two bytes a row, which edit each
shape takes. There are few such states, so a row is one look-up. At the first turn the edits are read off forwards. Back pointers and texts of a long conversation
spill to a temporary file of the task, so memory stays bounded however long it is; if the task is lost, Spark runs it again. A digest of the text of a conversation runs
through it in order, so one conversation is one task's work by its nature.

Whether a row repeats an earlier one is found before, by a window over (conversation, role, text), so no worker remembers texts.

Nulls: role and text are one space each, as is a null id or turn in the key of `damaged`; rows of a null id are one conversation, null turns come first. Equal turns are ordered by role,
then text. Empty texts are blank. Repeated rows are duplicates. A conversation without rows has zeros, an empty audit and the digest of an empty text. An empty table gives an empty one.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Shapes a conversation can have come to.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The shape that a turn with this initial leads to, and those that go before it.
MOVES = {"s": (SYSTEM, (START,)), "u": (USER, (START, SYSTEM, ASSISTANT)), "a": (ASSISTANT, (USER,))}
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The turn that an insertion or a new role makes after each shape.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: Bytes of one conversation's back pointers and of its texts that stay in memory.
IN_MEMORY, BLOCK = 4 << 20, 1 << 20
#: Faults of a row.
SOUND, TRUNCATED_ROW, BLANK, DUPLICATE = range(4)


def damaged(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, turn, role, text, copies: rows damaged by crc32(id:turn) % 20: 0 drops one (copies 0), 1 empties its text, 2 takes its [.!?] out, 3 repeats it (copies 2), 4 makes it the user's."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space(id_col), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select(F.col(id_col).alias("_id"), F.col("turn").cast("long").alias("_turn"), space("role").alias("_role"), space("text").alias("_text"), kind.alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role"))
    copies = F.when(F.col("_kind") == 0, 0).when(F.col("_kind") == 3, 2).otherwise(1)
    return rows.select(F.col("_id").alias(id_col), F.col("_turn").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


class Costs:
    """The backward recursion: from what the shapes cost after a row, to what they cost before it.

    A state is (cost, rank) of each of the four shapes, costs less their least. A step gives for each shape its edits at this row: insertions, the row's edit, the shape after.
    """

    def __init__(self) -> None:
        ends = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        #: what each shape still needs after the last row
        self.ends = ends
        self.last = self._ranked([(INSERT * len(ends[s]), ends[s], 0) for s in range(4)])[1]
        self.steps: dict[tuple, tuple] = {}
        self.numbers: dict[tuple, int] = {}
        #: edits of each shape, by number
        self.edits: list[tuple] = []

    @staticmethod
    def _ranked(found: list[tuple[int, str, int]]) -> tuple[int, tuple]:
        """(least cost, state) of (cost, initials, rank of what follows) for each shape."""
        least = min(cost for cost, _, _ in found)
        order = sorted({(initials, rank) for _, initials, rank in found})
        return least, tuple((cost - least, order.index((initials, rank))) for cost, initials, rank in found)

    def step(self, state: tuple, initial: str, fault: int) -> tuple[int, tuple, int]:
        """(cost taken off, state before the row, number of its edits)."""
        own = {}
        for s in range(4):
            edits = [(DELETE, "D", s)]
            if fault in (SOUND, TRUNCATED_ROW):
                more = TRUNCATED if fault == TRUNCATED_ROW else 0
                to, after = MOVES.get(initial, (None, ()))
                if s in after:
                    edits.append((KEEP + more, "K", to))
                edits.append((REROLE + more, "R", NEXT[s]))
            own[s] = [(cost + state[to][0], letter, state[to][1], to) for cost, letter, to in edits]
        best = []
        for s in range(4):
            options, shape = [], s
            for inserts in range(3):  # a third would lead back to a shape passed before
                options += [(INSERT * inserts + cost, "I" * inserts + letter, rank, to) for cost, letter, rank, to in own[shape]]
                shape = NEXT[shape]
            best.append(min(options))
        taken, before = self._ranked([x[:3] for x in best])
        edits = tuple((letters, to) for _, letters, _, to in best)
        number = self.numbers.setdefault(edits, len(self.numbers))
        if number == len(self.edits):
            self.edits.append(edits)
        return taken, before, number

    def before(self, state: tuple, initial: str, fault: int) -> tuple[int, tuple, int]:
        key = (state, initial, fault)
        found = self.steps.get(key)
        if found is None:
            found = self.steps[key] = self.step(state, initial if initial in MOVES else "", fault)
        return found


class Stack:
    """Byte strings that are read back last first; beyond IN_MEMORY they lie in a temporary file."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(max_size=IN_MEMORY)  # noqa: SIM115
        self.blocks: list[tuple[int, int]] = []
        self.top: list[bytes] = []
        self.size = 0

    def push(self, item: bytes) -> None:
        self.top.append(item)
        self.size += len(item)
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        begin = self.file.tell()
        for item in self.top:
            self.file.write(item)
        for item in self.top:
            self.file.write(len(item).to_bytes(8, "little"))
        self.blocks.append((begin, len(self.top)))
        self.top, self.size = [], 0

    def popped(self) -> Iterator[bytes]:
        yield from reversed(self.top)
        end = self.file.tell()
        for begin, n in reversed(self.blocks):
            self.file.seek(end - 8 * n)
            sizes = self.file.read(8 * n)
            at = end - 8 * n - begin
            self.file.seek(begin)
            data = self.file.read(at)
            for k in range(n - 1, -1, -1):
                size = int.from_bytes(sizes[8 * k : 8 * k + 8], "little")
                yield data[at - size : at]
                at -= size
            end = begin

    def close(self) -> None:
        self.file.close()


class Conversation:
    """One conversation, from its last row to its first."""

    def __init__(self, costs: Costs) -> None:
        self.costs, self.state, self.cost = costs, costs.last, 0
        self.pointers, self.texts = Stack(), Stack()
        self.codes = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.later: str | None = None
        self.turns, self.low, self.high, self.at = 0, 0, 0, None

    def row(self, turn: int | None, role: str, text: bytes, fault: int) -> None:
        initial = role[:1]
        taken, self.state, number = self.costs.before(self.state, initial, fault)
        self.cost += taken
        self.codes += number.to_bytes(2, "little")
        if len(self.codes) >= BLOCK:
            self.pointers.push(bytes(self.codes))
            self.codes.clear()
        name = role.encode()
        self.texts.push(len(name).to_bytes(4, "little") + name + text)
        self.blank += fault == BLANK
        self.duplicate += fault == DUPLICATE
        self.truncated += fault == TRUNCATED_ROW
        self.illegal += self.later is not None and initial + self.later not in ("su", "ua", "au")
        self.later = initial
        if turn is not None and turn != self.at:
            if self.at is None:
                self.high = turn
            self.low, self.at = turn, turn
            self.turns += 1

    def _codes(self) -> Iterator[int]:
        for part in [bytes(self.codes)] if self.codes else []:
            yield from (int.from_bytes(part[k : k + 2], "little") for k in range(len(part) - 2, -1, -2))
        for part in self.pointers.popped():
            yield from (int.from_bytes(part[k : k + 2], "little") for k in range(len(part) - 2, -1, -2))

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        sha, audit, first = hashlib.sha256(), [], True
        shape = START

        def line(role: bytes, text: bytes) -> None:
            nonlocal first
            sha.update((b"" if first else b"\n") + role + b":")
            sha.update(text)
            first = False

        def inserts(letters: str) -> None:
            nonlocal shape
            for _ in letters:
                shape = NEXT[shape]
                line(NAMES[shape].encode(), b"")

        for number, item in zip(self._codes(), self.texts.popped(), strict=True):
            letters, to = self.costs.edits[number][shape]
            audit.append(letters)
            inserts(letters[:-1])
            size = int.from_bytes(item[:4], "little")
            if letters[-1] == "K":
                line(item[4 : 4 + size], item[4 + size :])
            elif letters[-1] == "R":
                line(NAMES[to].encode(), item[4 + size :])
            shape = to
        audit.append(self.costs.ends[shape])
        inserts(self.costs.ends[shape])
        self.pointers.close()
        self.texts.close()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost + self.state[START][0], "".join(audit), sha.hexdigest()


def repaired(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by conversation, last turn first, to a row a conversation; a conversation may span many frames."""
    costs, own, key = Costs(), None, None
    names = ["_key", "_none", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    for frame in frames:
        out = []
        for k, none, has_turn, turn, role, text, fault, copies, again in zip(*(frame[c].tolist() for c in ("_key", "_none", "_has_turn", "_at", "role", "_bytes", "_fault", "copies", "_again")), strict=True):
            if own is None or (k, none) != key:
                if own is not None:
                    out.append((*key, *own.result()))
                own, key = Conversation(costs), (k, none)
            for n in range(copies - 1, -1, -1):  # of copies that stand together the first is no repeat
                own.row(turn if has_turn else None, role, bytes(text), DUPLICATE if fault != BLANK and (again or n) else fault)
        if out:
            yield pd.DataFrame(out, columns=names)
    if own is not None:
        yield pd.DataFrame([(*key, *own.result())], columns=names)


def repair(rows: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    rows: id, turn (whole numbers), role, text, and copies: how often the row stands there, 0: the conversation is known but the row is gone.
    """
    text, role = F.coalesce(F.col("text").cast("string"), F.lit(" ")), F.coalesce(F.col("role").cast("string"), F.lit(" "))
    own = rows.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_key"), F.col(id_col).isNull().alias("_none"), F.col("turn").isNotNull().alias("_has_turn"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("_at"), role.alias("role"), text.alias("text"), F.col("copies").cast("int").alias("copies"))
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED_ROW)
    earlier = W.partitionBy("_key", "_none", "role", "text", F.col("copies") > 0).orderBy("_has_turn", "_at")
    own = own.withColumns({"_fault": fault, "_again": F.row_number().over(earlier) > 1})
    dealt = own.repartition("_key", "_none").sortWithinPartitions("_key", "_none", F.desc("_has_turn"), F.desc("_at"), F.desc("role"), F.desc("text"), F.desc("_again"))
    kind = rows.schema[id_col].dataType
    schema = "_key string, _none boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = dealt.withColumn("_bytes", F.col("text").cast("binary")).drop("text").mapInPandas(repaired, schema)
    return out.withColumn(id_col, F.when(~F.col("_none"), F.col("_key").cast(kind))).select(id_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _step_sql() -> str:
    """The recursion over one row: s0 … s3 are what the shapes cost after it, b0 … b3 with its own edit, in SQL."""
    edit = lambda cost, letter, to, line=None: f"{{'c': {cost} + s{to}.c, 'a': '{letter}' || s{to}.a, 'r': " + (f"list_prepend({line}, s{to}.r)" if line else f"s{to}.r") + "}"
    least = lambda options: f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"
    own = []
    for s in range(4):
        options = [edit(DELETE, "D", s)]
        options += [f"CASE WHEN i = '{i}' AND NOT must THEN {edit('more', 'K', to, 'line')} END" for i, (to, after) in MOVES.items() if s in after]
        options.append(f"CASE WHEN NOT must THEN {edit(f'{REROLE} + more', 'R', NEXT[s], f"'{NAMES[NEXT[s]]}:' || text")} END")
        own.append(f"{least(options)} AS b{s}")
    out = []
    for s in range(4):
        options, letters, lines, shape = [], "", [], s
        for _ in range(3):
            before = f"list_concat([{', '.join(lines)}]::VARCHAR[], b{shape}.r)"
            options.append(f"{{'c': {INSERT * len(letters)} + b{shape}.c, 'a': '{letters}' || b{shape}.a, 'r': {before}}}")
            shape = NEXT[shape]
            letters += "I"
            lines.append(f"'{NAMES[shape]}:'")
        out.append(f"{least(options)} AS s{s}")
    return f"SELECT id, p, {', '.join(out)} FROM (SELECT id, g.p, {', '.join(own)} FROM d JOIN g ON g.id IS NOT DISTINCT FROM d.id0 AND g.p = d.p - 1)"


_ENDS = "{'c': 0, 'a': '', 'r': []::VARCHAR[]} AS s0, {'c': 6, 'a': 'II', 'r': ['user:', 'assistant:']} AS s1, {'c': 3, 'a': 'I', 'r': ['assistant:']} AS s2, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS s3"
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
SQL = rf"""
    WITH RECURSIVE k AS (SELECT conv_id AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    h AS (SELECT id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, n FROM (SELECT *, {_CRC} % 20 AS n FROM k)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id, role, text ORDER BY p) > 1 AS again FROM (SELECT *, row_number() OVER w AS p, substr(role, 1, 1) AS i, lead(substr(role, 1, 1)) OVER w AS later FROM (
      SELECT id, turn, role, text, unnest(range(CASE n WHEN 3 THEN 2 ELSE 1 END)) FROM h WHERE n <> 0) WINDOW w AS (PARTITION BY id ORDER BY turn NULLS FIRST, role, text))),
    f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS whole FROM r),
    g AS (SELECT *, role || ':' || text AS line, blank OR again AS must, CASE WHEN whole THEN 0 ELSE {TRUNCATED} END AS more FROM f),
    d AS (SELECT id AS id0, max(p) + 1 AS p, {_ENDS} FROM g GROUP BY id UNION ALL {_step_sql()}),
    s AS (SELECT id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (NOT must AND NOT whole) AS truncated,
      count(*) FILTER (later IS NOT NULL AND i || later NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY id)
    SELECT o.id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(d.s0.c, 0) AS BIGINT) AS cost, coalesce(d.s0.a, '') AS audit,
      sha256(coalesce(array_to_string(d.s0.r, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT id FROM k) o LEFT JOIN s ON s.id IS NOT DISTINCT FROM o.id LEFT JOIN d ON d.id0 IS NOT DISTINCT FROM o.id AND d.p = 1"""
