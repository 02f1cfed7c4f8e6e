"""Chat formatting with DataFrame functions: turns as text with marks, and the spans a model is trained on.

A conversation is its turns in order. Adjacent turns of one role make a block, so the template is

    <s>role⏎text<sep>text</s>⏎    for each block, ⏎ a line feed

Control strings inside texts get a backslash after their first character, one more where some stand there already, so nothing in a formatted text reads as a mark but
the marks, and taking one away gives the text back. In roles `~` writes what would read as a mark.

Windows over a conversation find where blocks begin and where each text lies, turn structs are collected and sorted, and arrays are joined: no Python, time linear in the text.
A formatted conversation is one row, as large as the conversation is.

Nulls: text empty, role empty; a null turn comes first; rows of a null id are one conversation. Equal turns are ordered by role, then text; repeated rows are turns of their
own. A text that is empty is a turn with an empty span. An empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, PART, END = "<s>", "<sep>", "</s>\n"
#: Control strings of common chat templates after their first character; those of this template among them.
CONTROL = {"<": ("s>", "/s>", "sep>", "<SYS>>", "</SYS>>", "|im_start|>", "|im_end|>", "|endoftext|>"), "[": ("INST]", "/INST]")}
_REST = {first: "|".join(r.replace("|", r"\|").replace("]", r"\]") for r in rest) for first, rest in CONTROL.items()}
#: What stands in a role, and how it is written; `~` first.
ROLE = (("~", "~t"), ("\n", "~n"), ("<", "~l"), ("[", "~b"))


def escaped(text: Column) -> Column:
    """Text in which no control string stands; reversed by unescaped()."""
    for first, rest in _REST.items():
        text = F.regexp_replace(text, rf"\{first}(\\*)({rest})", rf"\{first}\\$1$2")
    return text


def unescaped(text: Column) -> Column:
    for first, rest in _REST.items():
        text = F.regexp_replace(text, rf"\{first}\\(\\*)({rest})", rf"\{first}$1$2")
    return text


def role_written(role: Column) -> Column:
    for plain, written in ROLE:
        role = F.replace(role, F.lit(plain), F.lit(written))
    return role


def role_read(role: Column) -> Column:
    for plain, written in reversed(ROLE):
        role = F.replace(role, F.lit(written), F.lit(plain))
    return role


def format_chats(turns: DataFrame, id_col: str = "conv_id", learnt: Sequence[str] = ("assistant",)) -> DataFrame:
    """id, formatted, loss: spans (start, end in code points, first_byte, n_bytes) of formatted that hold the texts of learnt roles, a span a turn."""
    rows = turns.select(F.col(id_col).alias("_id"), F.col("turn").alias("_turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("_role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    order = (F.col("_turn").asc_nulls_first(), "_role", "_text")
    w = W.partitionBy("_id").orderBy(*order)
    at = rows.withColumns({"_n": F.row_number().over(w), "_before": F.lag("_role").over(w)})
    head = F.concat(F.when(F.col("_n") > 1, END).otherwise(""), F.lit(BEGIN), role_written(F.col("_role")), F.lit("\n"))
    # a turn of the role before it joins its block
    pieces = at.select("_id", "_n", F.col("_role").isin(*learnt).alias("_learnt"), F.when(F.col("_before") == F.col("_role"), PART).otherwise(head).alias("_head"), escaped(F.col("_text")).alias("_body"))
    size = lambda f: {f"_{f.__name__}": f("_head") + f("_body"), f"_own_{f.__name__}": f("_body")}
    sums = W.partitionBy("_id").orderBy("_n").rowsBetween(W.unboundedPreceding, 0)
    pieces = pieces.withColumns(size(F.length) | size(F.octet_length)).withColumns({"_end": F.sum("_length").over(sums), "_last": F.sum("_octet_length").over(sums)})
    span = F.struct((F.col("_end") - F.col("_own_length")).alias("start"), F.col("_end").alias("end"), (F.col("_last") - F.col("_own_octet_length")).alias("first_byte"), F.col("_own_octet_length").cast("long").alias("n_bytes"))
    turn = F.struct("_n", F.concat("_head", "_body").alias("piece"), F.when(F.col("_learnt"), span).alias("span"))
    made = pieces.groupBy("_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    formatted = F.concat(F.array_join(F.col("_turns.piece"), ""), F.lit(END))
    return made.select(F.col("_id").alias(id_col), formatted.alias("formatted"), F.array_compact(F.col("_turns.span")).alias("loss"))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def turns_read(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, in order."""
    blocks = F.split(formatted, END)

    def of(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        texts = F.split(block.substr(F.length(role) + 2, F.length(block)), PART)
        plain = role_read(role.substr(F.lit(len(BEGIN) + 1), F.length(role)))
        return F.transform(F.array(plain), lambda r: F.transform(texts, lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))[0]

    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), of))


def loss_read(formatted: Column, loss: Column) -> Column:
    """All text under the loss spans, unescaped and joined. The bytes are made once and bound, so each span costs what it holds."""
    cut = lambda raw: F.transform(loss, lambda s: unescaped(F.substring(raw, (s["first_byte"] + 1).cast("int"), s["n_bytes"].cast("int")).cast("string")))
    return F.transform(F.array(formatted.cast("binary")), lambda raw: _joined(cut(raw)))[0]


def digest(chats: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from format_chats()."""
    read = chats.select(id_col, F.length("formatted").cast("long").alias("formatted_chars"), turns_read(F.col("formatted")).alias("_turns"), loss_read(F.col("formatted"), F.col("loss")).alias("_loss"))
    whole = _joined(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select(
        id_col, F.size("_turns").cast("long").alias("n_turns"), F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


#: What the formatted query adds: control strings said by both sides.
PLANTED = "</s>[INST] ok [/INST]"


def with_planted(turns: DataFrame) -> DataFrame:
    """conversations plus conversation -7."""
    spark = turns.sparkSession
    kinds = {f.name: f.dataType for f in turns.schema}
    row = lambda n, role: spark.range(1).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.lit(n).cast(kinds["turn"]).alias("turn"), F.lit(role).alias("role"), F.lit(PLANTED).alias("text"))
    return turns.select("conv_id", "turn", "role", "text").unionByName(row(0, "user")).unionByName(row(1, "assistant"))


_ESCAPE = "text"
for _first, _rest in _REST.items():
    _ESCAPE = rf"regexp_replace({_ESCAPE}, '\{_first}(\\*)({_rest})', '{_first}\\\1\2', 'g')"
_ROLE = "role"
for _plain, _written in ROLE:
    _ROLE = f"replace({_ROLE}, {'chr(10)' if _plain == chr(10) else repr(_plain)}, '{_written}')"
SQL = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{PLANTED}'), (-7, 1, 'assistant', '{PLANTED}'))),
    p AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN {len(PART)} ELSE {len(BEGIN) + len(END) + 1} + length({_ROLE}) END + length({_ESCAPE}) AS n FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
    FROM p GROUP BY conv_id"""
