"""Structure repair against an exhaustive search, chat formatting by round trip, alignment against the plain definition."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import duckdb
import pytest
from pyspark.sql import functions as F

import gridloom.llm.repair as R
from gridloom.llm import alignment as A
from gridloom.llm import chat as C
from gridloom.llm.common import tokenizer_path

TURNS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- repair ---------------------------------------------------------------------------------------------------------------------------------------------------


def damage(rows):
    """The damage of the contract, row by row."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) over all lists of edits, by plain recursion on the pattern (s?(ua)+)?."""

    def follows(shape, initial):
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((shape, initial))

    @lru_cache(maxsize=None)
    def best(k, shape, inserted):
        found = []
        if inserted < 3:
            for name in ("user", "assistant"):
                if (to := follows(shape, name[0])) is not None:
                    cost, audit, lines = best(k, to, inserted + 1)
                    found.append((cost + 3, "I" + audit, (f"{name}:", *lines)))
        if k == len(rows):
            return min([*found, (0, "", ())] if shape in ("", "a") else found, default=(10**9, "", ()))
        role, text, fault = rows[k]
        cost, audit, lines = best(k + 1, shape, 0)
        found.append((cost + 4, "D" + audit, lines))
        if fault not in ("blank", "duplicate"):
            more = 3 if fault == "truncated" else 0
            for name, own, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                if (to := follows(shape, name[:1])) is not None:
                    cost, audit, lines = best(k + 1, to, 0)
                    found.append((cost + own + more, letter + audit, (f"{name}:{text}", *lines)))
        return min(found)

    return best(0, "", 0)


def expected(conv, rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
    seen, judged = set(), []
    for _, _, role, text in rows:
        stripped = text.rstrip(SPACE)
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
        seen.add((role, text))
        judged.append((role, text, fault))
    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit, lines = cheapest(tuple(judged))
    n = Counter(f for _, _, f in judged)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:], strict=False))
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, sha("\n".join(lines)))


def conversations(n, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in rng.sample(range(12), rng.randint(1, 7)):
            rows.append((conv, turn if rng.random() > 0.1 else None, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "unit"]), rng.choice(["Yes.", "No", "a b!", " \t", "", None, "Été ?\n", "x:y\nz."])))
    return rows


def found(df):
    return {r.conv_id: (r.conv_id, r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


def wanted(rows):
    by = defaultdict(list)
    for r in damage(rows):
        by[r[0]].append(r)
    return {conv: expected(conv, by[conv]) for conv in {r[0] for r in rows}}


def test_repair_against_all_edits(spark):
    rows = conversations(400, 1)
    rows += [(None, 3, "user", "Lost id."), (None, None, None, None), (10**17 + 1, 0, "user", "Hi."), (10**17 + 1, 1, "assistant", "Ho.")]
    rows += [rows[0], rows[0], rows[5]]  # repeated rows
    df = spark.createDataFrame(rows, TURNS).withColumns({"_key": F.lit("x"), "copies": F.lit(9), "cost": F.lit("clash")}).repartition(7)
    assert found(R.repair(R.damaged(df))) == wanted(rows)


def test_repair_of_undamaged_rows(spark):
    """The operator on its own, without the query's damage."""
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Ho."), (2, 0, "assistant", "Ho."), (3, 0, "user", "Hi"), (3, 4, "user", "Hi"), (4, 0, "user", "")]
    got = found(R.repair(spark.createDataFrame(rows, TURNS).withColumn("copies", F.lit(1))))
    assert got[1] == (1, 0, 0, 0, 0, 0, 0, "KKK", sha("system:Be brief.\nuser:Hi.\nassistant:Ho."))
    assert got[2][6:8] == (3, "IK") and got[2][8] == sha("user:\nassistant:Ho.")
    assert got[3][1] == 3 and got[3][2:6] == (0, 1, 1, 1) and got[3][6:8] == (8, "DD")
    assert got[4][6:8] == (4, "D")


def test_repair_of_a_conversation_beyond_memory(spark, monkeypatch):
    """Back pointers and texts that spill, frames that cut a conversation: the same result."""
    rng = random.Random(5)
    rows = [(7, k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{k}.", "", "é" * 50 + "."])) for k in range(300)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    try:
        own = found(R.repair(spark.createDataFrame(rows, TURNS).withColumn("copies", F.lit(1))))[7]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    import sys

    sys.setrecursionlimit(50_000)
    assert own == expected(7, rows)
    monkeypatch.setattr(R, "BLOCK", 64)
    monkeypatch.setattr(R, "IN_MEMORY", 256)
    stack, items = R.Stack(), [bytes([k % 251]) * (k % 90) for k in range(500)]
    for item in items:
        stack.push(item)
    assert list(stack.popped()) == items[::-1]
    conv = R.Conversation(R.Costs())
    seen = Counter((r[2], r[3]) for r in rows)
    for _, turn, role, text in reversed(rows):
        seen[role, text] -= 1
        fault = R.BLANK if not text else R.DUPLICATE if seen[role, text] else R.SOUND if text[-1] in ".!?" else R.TRUNCATED_ROW
        conv.row(turn, role, text.encode(), fault)
    assert (7, *conv.result()) == own


def test_repair_of_no_rows(spark):
    empty = spark.createDataFrame([], TURNS)
    assert R.repair(R.damaged(empty)).collect() == []
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert found(R.repair(R.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], TURNS)))) == {gone: (gone, 0, 0, 0, 0, 0, 0, "", sha(""))}


# --- chat -----------------------------------------------------------------------------------------------------------------------------------------------------

PIECES = ["<s>", "</s>", "</s>\n", "<sep>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_end|>", "\\", "<\\s>", "<\\\\/s>", "<", "[", "/s>", "s>", ">", "\n", " ", "é", "日", "~n", "$1", "ok"]


def test_escapes_are_reversed_and_leave_no_mark(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", C.escaped(F.col("text")).alias("e"), C.role_written(F.col("text")).alias("r"))
    rows = rows.select("*", C.unescaped(F.col("e")).alias("back"), C.role_read(F.col("r")).alias("role_back")).collect()
    marks = [first + rest for first, more in C.CONTROL.items() for rest in more]
    for r in rows:
        assert r.back == r.text and r.role_back == r.text
        assert not any(m in r.e for m in marks) and not any(c in r.r for c in "<[\n")
        assert any(m in r.text for m in marks) or "\\" in r.text or r.e == r.text


def test_chats_round_trip(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "system", "tool\n<s>", None]
    rows = [(conv, turn, rng.choice(roles), rng.choice([None, "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 6)))])) for conv in range(120) for turn in range(rng.randint(1, 9))]
    rows += [(None, None, "assistant", "no id"), rows[3], (500, 1, "assistant", ""), (500, 2, "assistant", "b"), (500, 2, "assistant", "a")]
    df = spark.createDataFrame(rows, TURNS).withColumns({"formatted": F.lit("clash"), "loss": F.lit(1), "_n": F.lit(2)})
    chats = C.format_chats(df)
    by = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by[r[0]].append((r[2] or "", r[3] or ""))
    digests = {r.conv_id: r for r in C.digest(chats).collect()}
    read = {r.conv_id: r for r in chats.select("*", C.turns_read(F.col("formatted")).alias("turns")).collect()}
    assert set(read) == set(digests) == set(by)
    for conv, turns in by.items():
        r, d = read[conv], digests[conv]
        assert [(t.role, t.text) for t in r.turns] == turns
        learnt = [t for role, t in turns if role == "assistant"]
        spans = [r.formatted[s.start : s.end] for s in r.loss]
        raw = r.formatted.encode()
        assert spans == [raw[s.first_byte : s.first_byte + s.n_bytes].decode() for s in r.loss]
        assert (d.n_turns, d.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (d.loss_chars, d.loss_sha256, d.formatted_chars) == (sum(map(len, learnt)), sha("".join(learnt)), len(r.formatted))
    assert C.format_chats(df.limit(0)).collect() == []
    assert read[500].formatted == "<s>assistant\n<sep>a<sep>b</s>\n"


def test_long_chat_and_plan(spark):
    rows = spark.range(20000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.lit("é</s>").alias("text"))
    chats = C.format_chats(rows)
    assert C.digest(chats).select("n_turns", "loss_chars").first() == (20000, 50000)
    plan = chats._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- alignment ------------------------------------------------------------------------------------------------------------------------------------------------

ODD_TEXTS = [None, "", " ", "  ", " a", "a ", "a  b", "foo\n  bar", "foo\n bar", " x\t y ", "<|endoftext|> <s> </s> a", "▁ x", "né᠎ a ᠎b", "日本語テキスト です", "\x00 a", "\x1c a", "a\xa0 b", "foo <0x0A> bar", "x" * 3000, "　 　x", "🤷" * 300, "ab" * 2000 + " c"]


@pytest.fixture(scope="module")
def aligner():
    return A.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def plain_alignment(own, text):
    """Counts, the groups' digest and links of whole-text encodings, from the definition."""
    nothing = (0, 0, 0, 0, "", {})
    if not text:
        return nothing
    whole = (" " + text).encode()
    ids = [own.a.own.encode(" " + text, add_special_tokens=False).ids, own.b.own.encode(text)]
    ends = []
    for side, table in zip(ids, (own.a.bytes, own.b.bytes), strict=True):
        if b"".join(table[k] for k in side) != whole:
            return nothing
        at = [0]
        for k in side:
            at.append(at[-1] + len(table[k]))
        ends.append(at[1:])
    groups, links, n_links, last = [], Counter(), 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ([k for k, e in zip(side, at, strict=True) if last < e <= end] for side, at in zip(ids, ends, strict=True)) if len(whole) < 400 else _between(ids, ends, last, end)
        groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
        n_links += len(x) * len(y)
        for p in x:
            for q in y:
                links[p << A.ID_BITS | q] += 1
        last = end
    return len(ids[0]), len(ids[1]), len(groups), n_links, sha(";".join(groups)), dict(links)


def _between(ids, ends, last, end):
    import bisect

    return [side[bisect.bisect_right(at, last) : bisect.bisect_right(at, end)] for side, at in zip(ids, ends, strict=True)]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", ".", "é", "日", "᠎", "\xa0", "1", "23", "'s", "<s>", "Q", "the", "ing"]) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_common_ends_by_diagonal_runs():
    rng = random.Random(4)
    for _ in range(400):
        total = rng.randint(1, 400)
        shared = sorted(rng.sample(range(1, total), rng.randint(0, total - 1)))
        a, b = (sorted({*shared, *rng.sample(range(1, total), rng.randint(0, min(6, total - 1))), total}) for _ in range(2))
        at_a, at_b = A.common_ends(a, b)
        both = sorted(set(a) & set(b))
        assert [a[k] for k in at_a] == both == [b[k] for k in at_b]
    assert [len(x) for x in A.common_ends([], [])] == [0, 0]


def test_alignment_of_texts(aligner):
    texts = ODD_TEXTS + random_texts(1500, 6)
    aligner.forget()
    for _ in range(2):  # learnt, then known
        for text, got in zip(texts, aligner.rows(texts).to_pylist(), strict=True):
            assert (got["n_a"], got["n_b"], got["n_groups"], got["n_links"], got["groups_sha256"], {x["pair"]: x["n"] for x in got["links"]}) == plain_alignment(aligner, text), text


@pytest.mark.parametrize("most_pairs", [1 << 19, 300])
def test_alignment_links(spark, aligner, sf_dir, most_pairs):
    texts = ODD_TEXTS + random_texts(100, 7) + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(80).collect()]
    texts += texts[-5:]  # repeated rows are documents of their own
    rows = [(None if k == 4 else 0 if k in (8, 9) else k, t) for k, t in enumerate(texts)]
    own = [plain_alignment(aligner, t) for t in texts]
    count = Counter(p for x in own for p in x[5])
    most = defaultdict(int)
    for p, n in count.items():
        most[p >> A.ID_BITS] = max(most[p >> A.ID_BITS], n)
    want = Counter((k, *x[:4], sum(n for p, n in x[5].items() if count[p] == most[p >> A.ID_BITS]), sum(n * count[p] for p, n in x[5].items()), x[4]) for (k, _), x in zip(rows, own, strict=True))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"links": F.lit(1), "_row": F.lit(2), "n_a": F.lit("clash")}).repartition(4)
    got = A.alignment_links(df, most_pairs=most_pairs).collect()
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got) == want


def test_alignment_of_no_rows(spark):
    assert A.alignment_links(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_repair", "op12_chat"])
def test_conversation_queries_equal_their_sql(spark, sf_dir, name):
    from gridloom.llm import catalog

    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in duck.sql(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()), key=repr)
