r"""Near-duplicate lines by an exact set-similarity join, with DataFrame functions only.

A line is the set of its words (lower case, split at \x20 and \x09-\x0D). Lines equal but for case and outer space are one class, named by two hashes of the line (96 bits);
classes are joined where the Jaccard similarity of their words is at least the threshold:

- texts are split once, into a table of lines with the 64-bit hashes of their distinct words; all later passes read the columns of it that they need;
- words are ordered by rarity. Occurrences are counted in 2**20 buckets of the word's hash, so what is sent to all tasks has a fixed size; a bucket's magnitude ranks
  its words and the hash breaks ties. Any total order keeps the join exact, a good one keeps it short;
- a set of n words posts its first n - ceil(t n) + 1 ones: two similar sets share one of these;
- near copies of one line are many, so hubs go first: of the classes that post one word and have one size the earliest is compared with the others, and those similar to it
  are decided. Only classes that are still open ask for all earlier partners, so a group of copies makes few pairs, not all;
- the postings are dealt once and joined with themselves. The join tests lengths, positions (the first word that both hold leaves enough words after it on both sides), and the
  parity signatures of the two sets (each word in one set only changes one bit, so signatures of similar sets differ in few bits; 64 bits tell little of sets of over a hundred
  words, so these have 256), so what comes out is nearly only true pairs for lines of up to some 400 words;
- each later line is compared, word for word, with the likeliest of its partners; those that fail there with all others they have.

A line goes if an earlier one (by doc_id, text, line number) is similar, whether or not that one stays. Lines without words stay. Null texts have no lines; an empty one
has one. Rows with equal id and text count once and share their result; an empty table gives none; a very long line is one set like any other. Extra columns are dropped.
Classes, not lines, are joined: repeats cost nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import drop_folder, materialize, new_folder

THRESHOLD = 0.8
#: Buckets of words; bits of the filter for lines that are compared.
RARITY_BUCKETS, WANTED_BITS = 1 << 20, 1 << 22
#: From this many classes on that post one word and have one size, the earliest is compared with the others first.
HUB_MEMBERS, HUB_WORDS = 4, 2
#: Sets of more words have a signature of WIDE times 64 bits too.
SHORT, WIDE = 96, 4
PLACE = ("doc_id", "row", "line_no")
CLASS = ("id", "id2")
GAP, SPACES = r"[\x20\x09-\x0D]+", "\x20\x09\x0a\x0b\x0c\x0d"


def norm(line: Column) -> Column:
    return F.btrim(F.lower(line), F.lit(SPACES))


def word_list(normed: Column) -> Column:
    """Words of a trimmed line. Splitting at one plain space is the quick way; an empty word shows that a gap is longer, and rare spaces are looked for before."""
    rare = normed.contains("\t") | normed.contains("\x0b") | normed.contains("\x0c") | normed.contains("\r") | normed.contains("  ")
    return F.when(rare, F.split(normed, GAP)).otherwise(F.split(normed, " "))


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), line_no, id and id2 (hashes of the line) and words (hashes, each once) for each line with words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    rows = rows.where(F.btrim("raw", F.lit(SPACES)) != "").select("doc_id", "row", "line_no", norm(F.col("raw")).alias("line"))
    return rows.select(*PLACE, F.xxhash64("line").alias("id"), F.hash("line").alias("id2"), F.array_distinct(F.transform(word_list(F.col("line")), lambda w: F.xxhash64(w))).alias("words"))


def packed_row(spark: SparkSession, sparse: DataFrame, n: int, kind: str, step: int = 4096) -> DataFrame:
    """One row: an array of n values of that type from sparse rows (at, value), 0 elsewhere. Packed by blocks first, so the last step joins a few arrays of fixed length."""
    blocks = spark.range(n).select(F.col("id").alias("at")).join(sparse.select(F.col("at").cast("long").alias("at"), "value"), "at", "left")
    own = blocks.groupBy(F.floor(F.col("at") / step).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("value", F.lit(0)).cast(kind).alias("value")))).alias("own"))
    flat = own.select("block", F.transform("own", lambda x: x["value"]).alias("own"))
    return flat.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("block", "own"))), lambda x: x["own"])).alias("packed"))


def rarity(lines: DataFrame) -> DataFrame:
    """One row: an array with, for each bucket of words, twice the binary logarithm of the number of lines that hold one."""
    words = lines.select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int").alias("at")).agg(F.count("*").alias("n"))
    return packed_row(lines.sparkSession, counts.select("at", F.floor(2 * F.log2(F.col("n") + 1)).cast("byte").alias("value")), RARITY_BUCKETS, "byte")


def with_row(df: DataFrame, row: DataFrame, name: str) -> DataFrame:
    """df with the array of a table of one row (packed_row: of fixed size), as a scalar subquery."""
    view = f"gridloom_{uuid.uuid4().hex}"
    row.createOrReplaceTempView(view)
    out = df.select("*", F.expr(f"(SELECT packed FROM {view})").alias(name))
    df.sparkSession.catalog.dropTempView(view)
    return out


def ordered_words(hashes: Column, ranks: Column) -> Column:
    """Words as longs that sort by rarity: the rank in the top byte, 56 bits of the hash below."""
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(RARITY_BUCKETS - 1)).cast("int")), F.lit(0).cast("byte"))  # noqa: E731  without nulls longs are sorted as such
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(rank(h).cast("long"), 56).bitwiseOR(h.bitwiseAND(F.lit((1 << 56) - 1)))))


def signature(words: Column) -> Column:
    """64 parities: bit k tells whether the set holds an odd number of words of kind k."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(F.lit(63)).cast("int"))))


def wide_signature(words: Column, n: Column) -> Column:
    """Of a set of more than SHORT words WIDE times 64 parities, else null."""
    part = lambda k: F.filter(words, lambda w: F.shiftright(w, 6).bitwiseAND(F.lit(WIDE - 1)) == k)
    return F.when(n > SHORT, F.array(*(signature(part(k)) for k in range(WIDE))))


def overlap_needed(n: Column, m: Column, t: float) -> Column:
    return F.ceil(F.lit(t / (1 + t)) * (n + m) - 1e-9)


def posted_sets(lines: DataFrame, ranks: DataFrame, t: float) -> DataFrame:
    """id, id2, first (place), times, n (words), s and wide (signatures), p (31 bits of each posted word) of each class."""
    # named first, as lambdas take a column but no subquery
    sets = with_row(lines, ranks, "ranks").select(*CLASS, *PLACE, F.size("words").alias("n"), ordered_words(F.col("words"), F.col("ranks")).alias("ordered"), "words")
    n = F.col("n")
    prefix = F.slice("ordered", F.lit(1), n - F.ceil(F.lit(t) * n - 1e-9).cast("int") + 1)
    # 31 bits of a word are enough to meet: what meets by chance fails the tests
    short = F.transform(prefix, lambda w: w.bitwiseAND(F.lit(2**31 - 1)).cast("int"))
    own = sets.select(*CLASS, F.struct(*PLACE).alias("place"), "n", "words", wide_signature(F.col("words"), n).alias("wide"), short.alias("p"))
    folded = reduce(lambda x, y: x.bitwiseXOR(y), (F.get("wide", F.lit(k)) for k in range(WIDE)))  # the parts share no word
    own = own.select(*CLASS, "place", "n", F.coalesce(folded, signature(F.col("words"))).alias("s"), "wide", "p")
    return own.groupBy(*CLASS).agg(F.min("place").alias("first"), F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("n", "s", "wide", "p")))


def postings(sets: DataFrame) -> DataFrame:
    """w (posted word), doc (of the first place), id, meta (n, i: the word's position, open: one number), s and wide for each posted word."""
    is_open = F.col("open") if "open" in sets.columns else F.lit(True)
    doc = F.coalesce("first.doc_id", F.lit(-(1 << 63)).cast("long"))
    posts = sets.select(doc.alias("doc"), "id", "n", is_open.cast("long").alias("open"), "s", "wide", F.posexplode("p").alias("i", "w"))
    return posts.select("w", "doc", "id", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("i").cast("long"), 1)).bitwiseOR(F.col("open")).alias("meta"), "s", "wide")


def of_meta(meta: str) -> tuple[Column, Column, Column]:
    """n, i and open of a posting."""
    m = F.col(meta)
    return F.shiftright(m, 32), F.shiftright(m, 1).bitwiseAND(F.lit((1 << 31) - 1)), m.bitwiseAND(F.lit(1)) == 1


def unlike_words(a: str, b: str) -> Column:
    """The words in which two sets differ at least, by their signatures."""
    bits = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    a_wide, b_wide = F.col(f"{a}wide"), F.col(f"{b}wide")
    wide = reduce(lambda x, y: x + y, (bits(F.get(a_wide, F.lit(k)), F.get(b_wide, F.lit(k))) for k in range(WIDE)))
    return F.coalesce(wide, bits(F.col(f"{a}s"), F.col(f"{b}s")))


def earlier(a: str, b: str) -> Column:
    """Whether class a may come before class b: documents tell, except within one."""
    return (F.col(f"{a}doc") <= F.col(f"{b}doc")) & (F.col(f"{a}id") != F.col(f"{b}id"))


def hub_pairs(sets: DataFrame, t: float) -> DataFrame:
    """y, x (id): for each class the earliest of the hubs that it may be similar to. A hub is the earliest class of those that hold one word among their HUB_WORDS rarest and have one size, where these are at least HUB_MEMBERS."""
    posts = postings(sets).drop("wide")
    n, i, _ = of_meta("meta")
    hubs = posts.where(i < HUB_WORDS).groupBy("w", n.alias("x_n")).agg(F.min("doc").alias("x_doc"), *(F.min_by(c, "doc").alias(f"x_{c}") for c in ("id", "s")), F.count("*").alias("members"))
    # a table of its own: Spark sees its size before it decides how to join
    hubs = materialize(hubs.where(F.col("members") >= HUB_MEMBERS).drop("members").withColumnRenamed("w", "x_w"), "hubs")
    asked = wanted(posts, hubs.select("x_w"), "w", "x_w")
    near = F.bit_count(F.col("s").bitwiseXOR(F.col("x_s"))) <= 2 * n - 2 * overlap_needed(n, n, t)
    met = asked.join(hubs, (F.col("w") == F.col("x_w")) & (n == F.col("x_n")) & earlier("x_", "") & near)
    return met.groupBy(F.col("id").alias("y")).agg(F.min_by("x_id", "x_doc").alias("x"))


def open_pairs(sets: DataFrame, late: DataFrame, t: float) -> DataFrame:
    """y, x (id), unlike (words that differ at least): each class whose fate is not known with all earlier ones that may be similar to it."""
    told = sets.join(late.withColumn("known", F.lit(True)), list(CLASS), "left").withColumn("open", F.col("known").isNull())
    posts = postings(told)
    # both sides have all columns and no test of their own, so that the postings are dealt once
    a, b = posts.alias("a"), posts.alias("b")
    (a_n, a_i, _), (b_n, b_i, b_open) = of_meta("a.meta"), of_meta("b.meta")
    need = overlap_needed(a_n, b_n, t)
    # a pair's first common word has all others after it
    left = F.least(a_n - a_i, b_n - b_i) >= need
    sizes = (a_n >= F.lit(t) * b_n - 1e-9) & (b_n >= F.lit(t) * a_n - 1e-9)
    asks = F.col("a.doc") <= F.when(b_open, F.col("b.doc"))
    fit = asks & (F.col("a.id") != F.col("b.id")) & sizes & left & (unlike_words("a.", "b.") <= a_n + b_n - 2 * need)
    met = a.join(b.hint("shuffle_merge"), (F.col("a.w") == F.col("b.w")) & fit)
    return met.select(F.col("b.id").alias("y"), F.col("a.id").alias("x"), (unlike_words("a.", "b.") / (a_n + b_n)).alias("unlike")).distinct()


def wanted(df: DataFrame, ids: DataFrame, key: str = "id", of: str = "id") -> DataFrame:
    """Rows of df whose key has its bit in a filter of fixed size made of ids; a few others pass."""
    at = lambda c: F.col(c).cast("long").bitwiseAND(F.lit(WANTED_BITS - 1))
    one = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.col(c).bitwiseAND(F.lit(63)).cast("int"))
    bits = ids.groupBy(F.shiftright(at(of), 6).alias("at")).agg(F.bit_or(one(of)).alias("value"))
    bit = F.get("wanted", F.shiftright(at(key), 6).cast("int")).bitwiseAND(one(key))
    return with_row(df, packed_row(df.sparkSession, bits, WANTED_BITS >> 6, "long", 1024), "wanted").where(bit != 0).drop("wanted")


def similar(pairs: DataFrame, sets: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """Of the pairs (y, x: id) the distinct y (id, id2) of those where x is earlier and whose words have a Jaccard similarity of at least t."""
    ends = pairs.select(F.col("x").alias("id")).distinct().unionByName(pairs.select(F.col("y").alias("id")).distinct())
    named = materialize(sets.select(*CLASS, "first").join(ends, "id", "left_semi"), "named")  # its size is seen before the joins are chosen
    own = wanted(lines, named.select("id")).join(named, list(CLASS)).where(F.col("first").eqNullSafe(F.struct(*PLACE))).select(*CLASS, "first", "words").dropDuplicates(list(CLASS))
    x = own.select(F.col("id").alias("x"), F.col("first").alias("x_first"), F.col("words").alias("x_words"))
    y = own.select(F.col("id").alias("y"), "id2", F.col("first").alias("y_first"), F.col("words").alias("y_words"))
    good = F.size(F.array_intersect("x_words", "y_words")) >= overlap_needed(F.size("x_words"), F.size("y_words"), t)
    return pairs.join(x, "x").join(y, "y").where((F.col("x_first") < F.col("y_first")) & good).select(F.col("y").alias("id"), "id2").distinct()


def late_classes(sets: DataFrame, lines: DataFrame, t: float) -> DataFrame:
    """id, id2 of the classes that have an earlier similar one."""
    hubs = materialize(hub_pairs(sets, t), "asked")
    late = materialize(similar(hubs, sets, lines, t), "late")
    ways = materialize(open_pairs(sets, late, t), "ways")
    best = ways.groupBy("y").agg(F.min_by("x", F.struct("unlike", "x")).alias("x"))
    more = materialize(similar(best, sets, lines, t), "late")
    others = ways.select("y", "x").join(more.select(F.col("id").alias("y")), "y", "left_anti").join(best, ["y", "x"], "left_anti")
    last = materialize(similar(others, sets, lines, t), "late")
    out = materialize(late.unionByName(more).unionByName(last).distinct(), "late")
    for done in (hubs, late, ways, more, last):
        drop_folder(done)
    return out


def repeated_lines(docs: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, removed (numbers of the lines to remove, from 0, ascending) of each row."""
    path = new_folder(docs.sparkSession, "lines")
    lines_of(docs).write.option("compression", "zstd").option("parquet.dictionary.page.size", 16 << 20).parquet(path)
    lines = docs.sparkSession.read.parquet(path)
    sets = materialize(posted_sets(lines, rarity(lines), t), "sets")
    late = late_classes(sets, lines, t)
    flagged = sets.select(*CLASS, "first", "times").join(late.withColumn("late", F.lit(True)), list(CLASS), "left").where("late OR times > 1")
    flagged = materialize(flagged.select(*CLASS, F.coalesce("late", F.lit(False)).alias("late"), "first"), "flagged")
    for done in (sets, late):
        drop_folder(done)
    placed = wanted(lines.select(*CLASS, *PLACE), flagged.select("id"))
    gone = placed.join(flagged, list(CLASS)).where(F.col("late") | ~F.struct(*PLACE).eqNullSafe(F.col("first")))
    gone = materialize(gone.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line_no")).alias("removed")), "gone")
    for done in (lines, flagged):
        drop_folder(done)
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), n_lines.alias("n_lines"))
    found = gone.withColumnsRenamed({"doc_id": "d", "row": "r"})
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left").select("doc_id", "n_lines", F.coalesce("removed", F.expr("cast(array() as array<int>)")).alias("removed"))


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed_sha256 (of the removed line numbers, comma-joined)."""
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.sha2(F.array_join(F.transform("removed", lambda i: i.cast("string")), ","), 256).alias("removed_sha256"))


def without_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs without the removed lines. Ids must be unique and not null."""
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_removed", i))
    own = found.select(F.col("doc_id").alias("_id"), F.col("removed").alias("_removed"))
    return docs.join(own, F.col("doc_id") == F.col("_id"), "left").withColumn("text", F.when(F.size("_removed") > 0, F.array_join(kept, "\n")).otherwise(F.col("text"))).drop("_id", "_removed")


#: DuckDB SQL of op7.
SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, i - 1 AS no, list_distinct(list_filter(regexp_split_to_array(lower(ls[i]), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS ws
      FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
s AS (SELECT ws, row_number() OVER (ORDER BY doc_id, no) AS k, doc_id, no FROM l WHERE len(ws) > 0),
c AS (SELECT list_sort(ws) AS ws, min(k) AS k, len(any_value(ws)) AS n FROM s GROUP BY list_sort(ws)),
w AS (SELECT k, n, unnest(ws) AS w FROM c),
p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) AS an, any_value(b.n) AS bn, count(*) AS o FROM w a JOIN w b ON a.w = b.w AND a.k < b.k AND a.n >= 0.8 * b.n - 1e-9 AND b.n >= 0.8 * a.n - 1e-9 GROUP BY a.k, b.k),
late AS (SELECT DISTINCT b AS k FROM p WHERE o >= 0.8 * (an + bn - o) - 1e-9),
firsts AS (SELECT k FROM c WHERE k NOT IN (SELECT k FROM late)),
gone AS (SELECT doc_id, count(*) AS n, string_agg(no::VARCHAR, ',' ORDER BY no) AS nos FROM s WHERE k NOT IN (SELECT k FROM firsts) GROUP BY doc_id)
SELECT doc_id, len(ls)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(nos, '')) AS removed_sha256 FROM d LEFT JOIN gone USING (doc_id)
"""
