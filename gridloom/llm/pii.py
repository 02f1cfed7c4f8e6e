r"""Personal data in whole texts, with DataFrame functions only.

One regular expression per kind proposes leftmost non-overlapping spans, validators confirm them (octets at most 255, Luhn, digit counts, mod 97, letters and digits
mixed), and words near a span move its score up or down; kinds that a validator can't settle start below `LEAST_SCORE`, so context decides about them. Positions come
from the gaps: `split` by an expression gives the text between its matches, `regexp_extract_all` the matches, and running sums of both lengths give code-point
offsets, so nothing leaves the JVM. The sums double their reach at each step, and only confirmed matches become spans: time grows with the matches (n log n), not their square.

Expressions whose match must start at the head of a run say so (`\G` or no such character before), and runs are possessive: the matches stay the same, and a long run
without a match costs one pass, not one for each of its characters.

Null and empty texts have no spans. Rows are mapped one by one: repeated rows repeat, equal spans of two kinds both count, an empty table gives none, a very long text
is one row's work. Extra columns are dropped. No shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MAIL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Code points before a span in which context words are looked for, what words for it add to the score and words against it take away, and the score of a likely span.
CONTEXT_CHARS, CONTEXT_SCORE, LEAST_SCORE = 40, 0.3, 0.5


@dataclass(frozen=True)
class Kind:
    """pattern: a Java expression with possessive runs. hint: what every text with a match holds, tested first. base: score of a confirmed span. context, against: words before it. least: code points of a match at least. alone: no letter or digit may touch it."""

    name: str
    pattern: str
    hint: str
    base: float
    context: str
    against: str
    least: int
    alone: bool = False


KINDS = (
    Kind("email", rf"(?:\G|(?<!{_MAIL})){_MAIL}++@{_HOST}++(?:\.{_HOST}++)++", "@", 0.7, "mail|contact|write", "example", 5),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.5, "ip|host|server|address", "version|release|section", 7),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "", 0.6, "card|visa|pay|credit", "isbn|serial|tracking", 2),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.5, "phone|call|tel|mobile", "total|sum|score", 4),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+", "", 0.6, "iban|account|bank|konto", "article|part", 12, alone=True),
    Kind("secret", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{24,}+", "", 0.3, "token|secret|key|passw|bearer|auth", "commit|digest|checksum|uuid", 24, alone=True),
)
#: These kinds make up the base digest.
BASE_KINDS = ("email", "ip", "card", "phone")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once: inside a lambda a plain column would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def scan(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running joins of an array of at least one element; each step doubles what they reach."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int"))
    back = lambda own, i, k: F.get(own, i - F.call_function("shiftleft", F.lit(1), k))
    return F.aggregate(steps, values, lambda own, k: F.transform(own, lambda v, i: join(v, F.coalesce(back(own, i, k), v * 0))))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn: every second digit from the right doubled, nines cast out, sum divisible by ten."""
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.translate(c, "123456789", "246813579").cast("int")))
    return F.aggregate(F.filter(value, lambda v: v.isNotNull()), F.lit(0), lambda s, v: s + v) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an IBAN leaves remainder 1: four first characters to the end, letters as 10 to 35, digit by digit."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4)), "")
    step = lambda s, c: F.when(c == "", s).when(c.rlike("[0-9]"), (s * 10 + F.coalesce(c.try_cast("int"), F.lit(0))) % 97).otherwise((s * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(match)).between(13, 19) & luhn(_digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "secret":
        return match.rlike("(?:[0-9][A-Za-z_-]*+){4}") & match.rlike("(?:[A-Za-z][0-9_-]*+){4}")
    return F.lit(True)


def spans_of(kind: Kind, text: Column) -> Column:
    """Confirmed spans of one kind, in order: array<struct<kind, start, end, text, score>>."""
    back = -(-CONTEXT_CHARS // kind.least)  # so many cells and a gap before a span hold the code points of its context
    matched = F.struct(F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0)).alias("m"), F.split(text, kind.pattern, -1).alias("g"))

    def found(own: Column) -> Column:
        lengths = F.zip_with(own["m"], F.slice(own["g"], F.lit(1), F.size(own["m"])), lambda m, g: F.length(m) + F.length(g))
        return let(scan(lengths, lambda v, before: v + before), lambda ends: placed(own, ends))

    def before(own: Column, i: Column) -> Column:
        cells = F.zip_with(*(F.slice(own[c], F.greatest(i - back, F.lit(0)) + 1, F.least(F.lit(back), i)) for c in "gm"), lambda g, m: F.concat(g, m))
        return F.right(F.concat(F.array_join(cells, ""), F.get(own["g"], i)), F.lit(CONTEXT_CHARS))

    def placed(own: Column, ends: Column) -> Column:
        at = F.filter(F.transform(own["m"], lambda m, i: F.struct(i.alias("i"), m.alias("m"))), lambda x: confirmed(kind.name, x["m"]))
        if kind.alone:
            after = lambda i: F.left(F.concat(F.get(own["g"], i + 1), F.coalesce(F.get(own["m"], i + 1), F.lit(""))), F.lit(1))
            at = F.filter(at, lambda x: ~F.concat(F.right(before(own, x["i"]), F.lit(1)), after(x["i"])).rlike("[A-Za-z0-9]"))
        return F.transform(at, lambda x: scored(F.lower(before(own, x["i"])), F.get(ends, x["i"]), x["m"]))

    def scored(near: Column, end: Column, match: Column) -> Column:
        moved = F.when(near.rlike(kind.context), CONTEXT_SCORE).otherwise(0.0) - F.when(near.rlike(kind.against), CONTEXT_SCORE).otherwise(0.0)
        score = F.round(F.lit(kind.base) + moved, 2)
        return F.struct(F.lit(kind.name).alias("kind"), (end - F.length(match)).alias("start"), end.alias("end"), match.alias("text"), score.alias("score"))

    none = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,text:string,score:double>>)")
    maybe = text.contains(kind.hint) if kind.hint else F.lit(True)
    return F.when(maybe & text.rlike(kind.pattern), let(matched, found)).otherwise(none)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """doc_id, spans (by kind as listed, then start) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.concat(*(spans_of(k, text) for k in kinds)).alias("spans"))


def digest(found: DataFrame, base: tuple[str, ...] = BASE_KINDS) -> DataFrame:
    """Counts by kind, base_sha256, the spans joined as kind:start:end, and n_likely: spans with a score of LEAST_SCORE or more."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    only_base = F.filter("spans", lambda x: x["kind"].isin(*base))
    likely = F.size(F.filter("spans", lambda x: x["score"] >= LEAST_SCORE)).cast("long")
    return found.select("doc_id", *(n(k) for k in (*base, "iban", "secret")), F.sha2(joined(only_base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), likely.alias("n_likely"))


def redact(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """docs with each span of that score or more replaced by <KIND>; spans that overlap are replaced together, by the kind of the first. Ids must be unique and not null."""
    spans = F.array_sort(F.filter("_spans", lambda x: x["score"] >= least_score), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(b["end"] - a["end"]))

    def put(own: Column) -> Column:
        return let(scan(F.transform(own, lambda x: x["end"]), lambda v, before: F.greatest(v, before)), lambda ends: let(heads(own, ends), lambda first: written(own, ends, first)))

    def heads(own: Column, ends: Column) -> Column:
        """Places of the spans that overlap none before, and the number of spans."""
        first = F.filter(F.transform(own, lambda x, i: F.when((i == 0) | (x["start"] >= F.get(ends, i - 1)), i)), lambda i: i.isNotNull())
        return F.concat(first, F.array(F.size(own)))

    def written(own: Column, ends: Column, first: Column) -> Column:
        def part(letters: Column) -> Column:
            text = lambda a, b: F.array_join(F.slice(letters, a + 1, b - a), "")
            end = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, F.get(first, k) - 1))
            each = F.transform(F.slice(first, F.lit(1), F.size(first) - 1), lambda i, k: F.concat(text(end(k), F.get(own, i)["start"]), F.lit("<"), F.upper(F.get(own, i)["kind"]), F.lit(">")))
            return F.concat(F.array_join(each, ""), text(end(F.size(first) - 1), F.size(letters)))

        return let(F.split(F.col(text_col), ""), part)

    own = found.select(F.col("doc_id").alias("_id"), F.col("spans").alias("_spans"))
    return docs.join(own, F.col(id_col) == F.col("_id"), "left").withColumn(text_col, F.when(F.size(spans) > 0, let(spans, put)).otherwise(F.col(text_col))).drop("_id", "_spans")


#: DuckDB SQL of op1.
SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
kinds(k, kind, pattern, base, context, against) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.7, 'mail|contact|write', 'example'),
  (1, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 0.5, 'ip|host|server|address', 'version|release|section'),
  (2, 'card', '[0-9](?:[\x20-]?[0-9])+', 0.6, 'card|visa|pay|credit', 'isbn|serial|tracking'),
  (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]', 0.5, 'phone|call|tel|mobile', 'total|sum|score'),
  (4, 'iban', '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?', 0.6, 'iban|account|bank|konto', 'article|part'),
  (5, 'secret', '[A-Za-z0-9_-]{24,}', 0.3, 'token|secret|key|passw|bearer|auth', 'commit|digest|checksum|uuid')),
m AS (SELECT doc_id, k, kind, base, context, against, text, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS gs FROM t, kinds),
p AS (SELECT doc_id, k, kind, base, context, against, text, i, ms[i] AS mt,
        coalesce(list_sum(list_transform(gs[1:i], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0)::BIGINT AS s
      FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m)),
d AS (SELECT *, s + length(mt) AS e, regexp_replace(mt, '[^0-9]', '', 'g') AS ds FROM p),
near AS (SELECT *, lower(substring(text, (greatest(s - 40, 0) + 1)::INT, (s - greatest(s - 40, 0))::INT)) AS w,
        CASE WHEN s > 0 THEN substring(text, s::INT, 1) ELSE '' END || substring(text, e::INT + 1, 1) AS beside FROM d),
ok AS (SELECT *, base + CASE WHEN regexp_matches(w, context) THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(w, against) THEN 0.3 ELSE 0 END >= 0.5 AS likely FROM near WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(mt, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND coalesce(try_cast(ltrim(x, '0') AS INT), 0) <= 255))
    WHEN 'phone' THEN length(ds) BETWEEN 9 AND 15
    WHEN 'secret' THEN NOT regexp_matches(beside, '[A-Za-z0-9]') AND length(ds) >= 4 AND length(regexp_replace(mt, '[^A-Za-z]', '', 'g')) >= 4
    WHEN 'iban' THEN NOT regexp_matches(beside, '[A-Za-z0-9]')
      AND list_reduce(list_transform(string_split(substring(replace(mt, ' ', ''), 5) || substring(replace(mt, ' ', ''), 1, 4), ''),
        lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END), lambda a, v: (a * (CASE WHEN v >= 10 THEN 100 ELSE 10 END) + v) % 97, 0) = 1
    ELSE length(ds) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(ds) + 1), lambda i:
        CASE WHEN i % 2 = 1 THEN reverse(ds)[i]::INT ELSE (reverse(ds)[i]::INT * 2) // 10 + (reverse(ds)[i]::INT * 2) % 10 END)) % 10 = 0 END),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c, count(*) FILTER (k = 3) AS f, count(*) FILTER (k = 4) AS h, count(*) FILTER (k = 5) AS x, count(*) FILTER (likely) AS n,
        string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM ok GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0)::BIGINT AS n_email, coalesce(b, 0)::BIGINT AS n_ip, coalesce(c, 0)::BIGINT AS n_card, coalesce(f, 0)::BIGINT AS n_phone, coalesce(h, 0)::BIGINT AS n_iban, coalesce(x, 0)::BIGINT AS n_secret,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0)::BIGINT AS n_likely
FROM t LEFT JOIN g USING (doc_id)
"""
