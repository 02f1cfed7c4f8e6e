"""The ten operators against brute force, and on nulls, empty, long and repeated texts, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, lines, mixing, pii, quality, substrings
from gridloom.llm.embeddings import near_embeddings
from gridloom.llm.simhash import fingerprint, golay_keys, simhash_components
from gridloom.llm.sstable import Encoder, ShardReader, ShardWriter, key_of, token_shards, write_shards
from gridloom.llm.token_counts import PieceCounter, count_tokens
from gridloom.session import new_folder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, chunk string, spans string, id string, print string, kept string"


def vocabulary(seed=1, n=60):
    rng = random.Random(seed)
    return ["".join(rng.choices("aeioklmnrst", k=rng.randint(2, 8))) for _ in range(n)]


def corpus(seed=0, n=40):
    """Random texts with exact and near copies, shared passages, repeated rows, nulls, empties and a long text."""
    rng, words = random.Random(seed), vocabulary()
    sentence = lambda k: " ".join(rng.choices(words, k=k))
    passage, out = sentence(60), []
    for i in range(n):
        text = "\n".join(sentence(rng.randint(1, 30)) + "." for _ in range(rng.randint(1, 6)))
        if i % 7 == 0:
            text += " " + passage
        if i % 9 == 4 and out:
            text = rng.choice([t for _, t in out if t] or [text])
        out.append((i, text))
    out += [(100, None), (101, ""), (102, " \t\n\x0b "), (103, sentence(20_000)), (None, sentence(50)), (None, None), (5, sentence(10)), out[3], out[3]]
    out += [(104, "mail a@b.co, 10.0.0.300 and 8.8.8.8; card 4111 1111 1111 1111 or +1 (555) 010-2000; iban DE89 3704 0044 0532 0130 00."), (105, "ß é 　 wide space 😀 4111-1111-1111-1112")]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, "x", "x", "x", "x", "x", "x") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pairs(found, *columns):
    return sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr)


def test_pii_against_regular_expressions(docs, rows, none):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
            return 13 <= len(d) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(d) <= 15

    want = []
    for i, t in rows:
        spans = [f"{k}:{m.start()}:{m.end()}" for k, p in kinds.items() for m in re.finditer(p, t or "", re.ASCII) if good(k, m[0])]
        want.append((i, sha(",".join(spans))))
    found = pii.digest(pii.find_pii(docs))
    assert pairs(found, "doc_id", "base_sha256") == sorted(want, key=repr)
    hit = found.where("doc_id = 104").first()
    assert (hit.n_email, hit.n_ip, hit.n_card, hit.n_phone, hit.n_iban) == (1, 1, 1, 1, 1) and hit.n_likely > 0
    assert pii.digest(pii.find_pii(none)).count() == 0


def test_pii_long_runs_and_neighbours(spark):
    texts = ["a" * 200_000, "1" * 100_000, "1." * 50_000, "x@y.zz_q@w.com 1.2.3.4.5.6.7.8", "4" + " 1" * 20_000, "+" * 50_000]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find_pii(frame(spark, list(enumerate(texts))))).collect()}
    assert found[3].startswith("email:0:6,email:6:14,ip:15:22,ip:23:30")


def test_pii_redaction(spark):
    docs = frame(spark, [(1, "to a@b.co or 8.8.8.8 now"), (2, None), (3, "none")])
    out = {r.doc_id: r.text for r in pii.redact(pii.find_pii(docs), docs).collect()}
    assert out == {1: "to <EMAIL> or <IP> now", 2: None, 3: "none"}


def test_pii_many_matches_in_one_text(spark):
    """Time grows with the matches, not with their square: 400,000 short numbers, and thousands of confirmed spans, in one text."""
    mails = "".join(f"é a{i}@b.co" for i in range(20_000))
    found = {r.doc_id: r for r in pii.digest(pii.find_pii(frame(spark, [(1, ", ".join(["12"] * 400_000)), (2, mails)]))).collect()}
    assert found[1].spans == ""
    at, want = 0, []
    for i in range(20_000):
        n = len(f"a{i}@b.co")
        want.append(f"email:{at + 2}:{at + 2 + n}")
        at += 2 + n
    assert found[2].spans == ",".join(want)


def test_pii_context_decides(spark):
    key = "0123456789abcdef0123456789abcdef"
    texts = [f"the token = {key} end", f"see commit {key} end", f"plain {key} end", "host 8.8.8.8 up", "version 8.8.8.8 out", f"x{key}é token {key[:23]}"]
    docs = frame(spark, list(enumerate(texts)))
    found = pii.find_pii(docs)
    out = {r.doc_id: r.text for r in pii.redact(found, docs).collect()}
    assert out == {0: "the token = <SECRET> end", 1: texts[1], 2: texts[2], 3: "host <IP> up", 4: texts[4], 5: texts[5]}
    assert {r.doc_id: (r.n_secret, r.n_ip, r.n_likely) for r in pii.digest(found).collect()} == {0: (1, 0, 1), 1: (1, 0, 0), 2: (1, 0, 0), 3: (0, 1, 1), 4: (0, 1, 0), 5: (1, 0, 0)}


def test_pii_redaction_of_overlaps(spark):
    text = "a1@b.co call +4222222222222, card 4111 1111 1111 1111 é"  # the first number is a phone's and, without its sign, a card's
    docs = frame(spark, [(1, text), (2, text * 500)])
    out = {r.doc_id: r.text for r in pii.redact(pii.find_pii(docs), docs).collect()}
    assert out[1] == "<EMAIL> call <PHONE>, card <CARD> é" and out[2] == out[1] * 500


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, none):
    rng, words = random.Random(3), vocabulary()
    base = rng.choices(words, k=400)
    rows = corpus(2, 30)
    for k in range(60):  # near copies that drift away
        base = [rng.choice(words) if rng.random() < 0.004 else w for w in base]
        rows.append((200 + k, " ".join(base)))
    prints = [brute_print(t) for _, t in rows]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    linked = 0
    for a in range(len(rows)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                linked += prints[a] != prints[b]
                above[top(a)] = top(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(top(k), []).append(i)
    least = {g: min((i for i in m if i is not None), default=None) for g, m in groups.items()}
    want = sorted(((i, f"{prints[k]:016x}", least[top(k)]) for k, (i, _) in enumerate(rows)), key=repr)
    assert linked > 20
    assert pairs(simhash_components(frame(spark, rows)), "doc_id", "fingerprint", "component_id") == want
    assert simhash_components(none).count() == 0


def test_golay_keys_meet_within_four_bits():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 5), replace=False).astype(np.uint64)) for _ in a], np.uint64)
    (ra, ka), (rb, kb) = golay_keys(a), golay_keys(a ^ flips)
    ours = set(zip(ra.tolist(), ka.tolist(), strict=True))
    assert {r for r, k in zip(rb.tolist(), kb.tolist(), strict=True) if (r, k) in ours} == set(range(3000))


def test_fingerprint_of_long_text():
    t = " ".join(random.Random(1).choices(vocabulary(), k=70_000))
    assert fingerprint(t.encode()) == brute_print(t)


def test_substrings_against_all_windows(docs, rows, none):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for k, w in enumerate(words):
        for p in range(len(w) - 34):
            seen.setdefault(tuple(w[p : p + 35]), []).append((k, p))
    gone = {(k, q) for places in seen.values() if len(places) > 1 for k, p in places for q in range(p, p + 35)}
    want = []
    for k, ((i, _), w) in enumerate(zip(rows, words, strict=True)):
        kept = [x for q, x in enumerate(w) if (k, q) not in gone]
        want.append((i, len(w), len(w) - len(kept), sha(" ".join(kept))))
    assert gone
    assert pairs(substrings.digest(substrings.find_repeats(docs)), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)
    assert substrings.find_repeats(none).count() == 0


def colliding_words(n=10):
    """Two words of 2**n letters of which sums of letter values times powers of any base modulo 2**64 are the same."""
    bits = [bin(i).count("1") & 1 for i in range(1 << n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_windows_that_differ_in_a_colliding_word_are_apart(spark):
    x, y = colliding_words()
    words = vocabulary(4, 34)
    rows = [(1, " ".join([*words[:20], x, *words[20:]])), (2, " ".join([*words[:20], y, *words[20:]]))]
    assert pairs(substrings.digest(substrings.find_repeats(frame(spark, rows))), "doc_id", "n_removed") == [(1, 0), (2, 0)]
    bench = spark.createDataFrame([(7, " ".join([*words[:9], x]))], "item_id long, text string")
    docs = frame(spark, [(1, " ".join([*words[:9], y])), (2, " ".join([*words[:9], x]))])
    assert pairs(decontaminate.digest(decontaminate.find_benchmark(docs, bench)), "doc_id", "n_hit", "contaminated") == [(1, 0, False), (2, 10, True)]


@pytest.mark.parametrize("bits", [0, 3, 7])
def test_equal_hashes_are_compared(spark, bits):
    """With hashes of few bits, where most windows collide, results stay exact."""
    rng, vocab = random.Random(12), vocabulary(3, 40)
    passages = [" ".join(rng.choices(vocab, k=12)) for _ in range(4)]
    docs = [(i, " ".join(rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choices(vocab, k=6)) for _ in range(6))) for i in range(60)]
    split, seen = [t.split() for _, t in docs], {}
    for k, own in enumerate(split):
        for p in range(len(own) - 7):
            seen.setdefault(tuple(own[p : p + 8]), []).append((k, p))
    gone = {(k, q) for places in seen.values() if len(places) > 1 for k, p in places for q in range(p, p + 8)}
    want = sorted(((i, sum((k, q) in gone for q in range(len(split[k])))) for k, (i, _) in enumerate(docs)), key=repr)
    assert 0 < len(gone) < sum(map(len, split))
    assert pairs(substrings.digest(substrings.find_repeats(frame(spark, docs), window=8, hash_bits=bits)), "doc_id", "n_removed") == want


@pytest.mark.parametrize("block", [32 << 20, 300])
def test_decontamination_against_all_windows(spark, docs, rows, none, block):
    rng = random.Random(5)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    long_text = rows[0][1]
    items = [(1, long_text[40:260].upper()), (2, " ".join(split(rows[7][1])[-12:])), (3, "tiny item"), (4, None), (5, "..."), (6, " ".join(split(rows[8][1])[:3])), (10, long_text[40:260]), (None, " ".join(split(rows[14][1])[-10:]))]
    items += [(20 + k, " ".join(rng.choices(vocabulary(9), k=30))) for k in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in rows:
        w, hit, found = split(t), set(), set()
        for item, x in items:
            own = split(x)
            n = min(10, len(own))
            grams = {tuple(own[p : p + n]) for p in range(len(own) - n + 1)} if own else set()
            at = [p for p in range(len(w) - n + 1) if n and tuple(w[p : p + n]) in grams]
            hit |= {q for p in at for q in range(p, p + n)}
            if at and item is not None:
                found.add(str(item))
        want.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    found = decontaminate.digest(decontaminate.find_benchmark(docs, bench, block_bytes=block))
    assert sum(x[2] for x in want) > 100
    assert pairs(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=repr)
    assert decontaminate.find_benchmark(none, bench).count() == 0
    assert not decontaminate.digest(decontaminate.find_benchmark(docs, bench.where("false"))).where("contaminated").count()


def test_quality_held_out(spark, none):
    found = quality.score_quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = found.join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.label == 1) for r in rows]) > 0.97
    assert np.mean([r.kept for r in rows if r.label == 1]) > 0.99
    assert quality.score_quality(none).count() == 0


def test_quality_edges(docs, rows):
    found = quality.score_quality(docs).collect()
    assert len(found) == len(rows) and all(r.kept for r in found if r.doc_id in (100, 101, 102, None))
    again = {}
    for r in found:
        again.setdefault((r.doc_id, r.row), set()).add(r.quality)
    assert all(len(x) == 1 for x in again.values())


def test_quality_em_finds_labeller_rates():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    v = np.stack([np.where(rng.random(20_000) < np.where(good, 0.02, 0.5), -1, 0) for _ in range(8)] + [np.where(rng.random(20_000) < np.where(good, 0.9, 0.1), 1, 0)], axis=1)
    patterns, inverse, counts = np.unique(quality.pattern(v), return_inverse=True, return_counts=True)
    assert np.mean((quality.estimate(patterns, counts)[inverse] > 0.5) == good) > 0.97


def plain_features(text):
    """The statistics of a text, and its hashed shapes with their shares, word by word."""
    from gridloom.llm.words import NOT_SPACE
    from gridloom.llm.words import words as split

    data = (text or "").encode()
    own = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n = len(own)
    letters, upper = re.findall(rb"[A-Za-z]", data), re.findall(rb"[A-Z]", data)
    digit, plain = set(b"0123456789"), set(range(0x61, 0x7B)) | set(range(0x41, 0x5B)) | set(range(0x80, 0x100)) | set(b".,")
    odd = lambda w: w[-1] not in plain and w[-1] not in digit
    low = [bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in w) for w in own]
    share = lambda k: k / n if n >= quality.FEW_WORDS else np.nan
    top = max((low.count(w) for w in set(low)), default=0)
    stats = [
        float(n),
        len([c for c in data if c in b"#$%&*@^~=<>{}[]\\/+_|"]) / max(sum(map(len, own)), 1) if n >= quality.FEW_WORDS else np.nan,
        len(upper) / len(letters) if len(letters) >= quality.FEW_LETTERS else np.nan,
        share(sum(len(w) == 1 and odd(w) for w in own)),
        share(sum(w.endswith(b"!") for w in own)),
        share(sum(len(w) > 2 and w[-1] == w[-2] and odd(w) for w in own)),
        share(top),
        share(sum(x == y for x, y in zip(low, low[1:], strict=False))),
        len(set(low)) / np.sqrt(n) if n >= quality.FEW_WORDS else np.nan,
        share(sum(w[-1] in plain and w[0] in plain for w in own)),
    ]
    kind = lambda c: 97 if 0x61 <= c <= 0x7A or c >= 0x80 else 65 if 0x41 <= c <= 0x5A else 48 if c in digit else c
    shapes = [re.sub(rb"(?s)(.)\1+", rb"\1", bytes(map(kind, w))) for w in own]
    joined = np.frombuffer(b" ".join(shapes), np.uint8)
    hashes = split(joined, np.array([0, len(joined)]), NOT_SPACE).hashes()
    return np.array(stats), (hashes % np.uint64(quality.FEATURES // 2)).astype(np.int64), n


def test_quality_scores_against_brute_force(spark, docs, rows):
    """Statistics, votes, pattern counts and the score of each document, worked out text by text."""
    more = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts = [t for _, t in rows] + more
    found = quality.score_quality(frame(spark, list(enumerate(texts)))).collect()
    each = [plain_features(t) for t in texts]
    stats = np.stack([s for s, _, _ in each])
    marks = quality.pattern(quality.votes(stats))
    patterns, counts = np.unique(marks, return_counts=True)
    good = dict(zip(patterns.tolist(), quality.estimate(patterns, counts).tolist(), strict=True))
    own, bucket, weight = [], [], []
    for k, (s, b, n) in enumerate(each):
        _, where, half = quality.binned(s[None, :])
        own += [k] * (len(b) + len(where))
        bucket += [*b, *where]
        weight += [1 / max(n, 1)] * len(b) + half.tolist()
    own, bucket, weight = np.array(own), np.array(bucket), np.array(weight)
    w = quality.fit(own, bucket, weight, np.array([good[p] for p in marks.tolist()]))
    z = np.bincount(own, weight * w[bucket], minlength=len(texts)) + w[-1]
    want = 1 / (1 + np.exp(-z))
    assert len(found) == len(texts) and 0 < sum(r.kept for r in found) < len(texts)
    for r in found:
        assert r.quality == pytest.approx(want[r.doc_id], abs=1e-4)


def brute_rake(cells, wanted, budget, rounds=200):
    mass = {c: float(t) for c, t in cells.items()}
    for _ in range(rounds):
        for k, target in enumerate(wanted):
            sums = {}
            for c, m in mass.items():
                sums[c[k]] = sums.get(c[k], 0) + m
            mass = {c: min(m * target.get(c[k], 0) * budget / sums[c[k]], cells[c]) if sums[c[k]] > 0 else 0 for c, m in mass.items()}
    return mass


def test_mixing_against_plain_raking(spark, none):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + rng.choice(["", " a | b", " x@y"]), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None])) for i in range(600)]
    rows += [(700, None, "en", "a"), (701, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("probability", F.lit("x"))
    found = mixing.mix(docs, share=0.6).collect()
    cells = {}
    for r in found:
        cells[r.source, r.lang, r.topic] = cells.get((r.source, r.lang, r.topic), 0) + r.n_tokens
    wanted = []
    for k, p in enumerate((0.5, 0.8, 0.9)):
        own = {}
        for c, t in cells.items():
            own[c[k]] = own.get(c[k], 0) + t
        total = sum(x**p for x in own.values())
        wanted.append({v: x**p / total for v, x in own.items()})
    mass = brute_rake(cells, wanted, 0.6 * sum(cells.values()))
    assert len(found) == len(rows)
    for r in found:
        if cells[r.source, r.lang, r.topic]:
            assert r.probability == pytest.approx(mass[r.source, r.lang, r.topic] / cells[r.source, r.lang, r.topic], abs=0.01)
    assert sum(r.n_tokens for r in found if r.kept) == pytest.approx(sum(mass.values()), rel=0.1)
    assert mixing.mix(none).count() == 0


def test_mixing_reports_and_rakes_alike_at_any_size(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", None]), 1, "x") for i in range(300)] + [(1, "w " * 200_000, "en", "b", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, topic string")
    found = sorted((tuple(r) for r in mixing.mix(docs, share=0.5).collect()), key=repr)
    cells = mixing.labelled(docs.where("length(text) < 1000")).groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    targets = mixing.default_targets(cells)
    total = cells.agg(F.sum("tokens")).first()[0]
    reached = {(r.margin, r.value): (r.target, r.reached) for r in mixing.margins(mixing.rake(cells, targets, 0.2 * total), targets).collect()}
    assert all(abs(t - r) < 1e-3 for t, r in reached.values())
    monkeypatch.setattr(mixing, "FEW_CELLS", 0)
    assert sorted((tuple(r) for r in mixing.mix(docs, share=0.5).collect()), key=repr) == [(*r[:6], pytest.approx(r[6], abs=1e-8), r[7]) for r in found]
    with pytest.raises(RuntimeError):
        mixing.rake(cells, targets, 0.2 * total, rounds=1)


def test_lines_against_all_pairs(spark, docs, rows, none):
    rng = random.Random(6)
    extra = []
    for k, (_, t) in enumerate(rows[:20]):
        changed = [" ".join(w if rng.random() > 0.05 else "changed" for w in x.split(" ")) for x in t.split("\n")]
        extra.append((300 + k, "\n".join([*changed, "  Short LINE ", "short line", "", "b a c", "a b c"])))
    both = rows + extra
    distinct = {(i, t) for i, t in both}
    order = lambda i, t: (i is not None, i or 0, xxhash.xxh64_intdigest((t or "").encode(), 42) - (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 63 << 64))
    every = sorted(((order(i, t), no, frozenset(w for w in re.split(r"[\x20\x09-\x0D]+", x.lower()) if w), (i, t)) for i, t in distinct if t is not None for no, x in enumerate(t.split("\n"))), key=lambda x: x[:2])
    gone = {}
    for k, (_, no, s, doc) in enumerate(every):
        if s and any(len(s & o) * 10 >= 8 * len(s | o) for _, _, o, _ in every[:k] if o):
            gone.setdefault(doc, []).append(no)
    want = sorted(((i, 0 if t is None else len(t.split("\n")), len(gone.get((i, t), [])), sha(",".join(map(str, gone.get((i, t), []))))) for i, t in both), key=repr)
    found = lines.digest(lines.repeated_lines(frame(spark, both)))
    assert sum(map(len, gone.values())) > 40
    assert pairs(found, "doc_id", "n_lines", "n_removed", "removed_sha256") == want
    assert lines.repeated_lines(none).count() == 0


def test_very_long_line(spark):
    """A line of many thousand words, its near copy, and an equal one with other spaces."""
    rng, words = random.Random(3), vocabulary(9, 30_000)
    own = rng.choices(words, k=60_000)
    near = [w if rng.random() > 0.01 else "changed" for w in own]
    rows = [(1, " ".join(own)), (2, "short line here\n" + " ".join(near)), (3, "\t" + " \t".join(own)), (4, "another line")]
    found = {r.doc_id: list(r.removed) for r in lines.repeated_lines(frame(spark, rows)).collect()}
    assert found == {1: [], 2: [1], 3: [0], 4: []}


def test_long_unlike_lines_make_few_pairs(spark, monkeypatch):
    """Lines of 150 words that share many words, but are not similar: signatures of 64 bits let about half of their pairs through."""
    rng, words = random.Random(11), vocabulary(12, 600)
    rows = [(k, " ".join(rng.sample(words, 150))) for k in range(60)]
    rows += [(100, " ".join(reversed(rows[7][1].split(" "))) + " more")]
    made, write = {}, lines.materialize

    def counted(df, name):
        out = write(df, name)
        made.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(lines, "materialize", counted)
    found = {r.doc_id: list(r.removed) for r in lines.repeated_lines(frame(spark, rows)).collect()}
    assert found == {k: [0] if k == 100 else [] for k, _ in rows}
    assert sum(made["ways"]) <= 60


def test_lines_stay_native(docs):
    plan = lines.digest(lines.repeated_lines(docs))._jdf.queryExecution().toString() + pii.digest(pii.find_pii(docs))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan)


def test_shards_against_library(spark, docs, rows, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    start, want = 0, []
    for i, text in order:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert pairs(token_shards(docs), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=repr)
    assert token_shards(none).count() == 0
    manifest = write_shards(docs, new_folder(spark, "t")).collect()
    readers = [ShardReader(m.path) for m in manifest]
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert any(x.tolist() == ids for r in readers for x in r.get(i))
    assert not any(r.get(999_999) for r in readers)


def test_shard_file_round_trip(tmp_path):
    path = str(tmp_path / "x.sst")
    w = ShardWriter(open(path, "wb"), 2)
    ids = sorted(random.Random(0).sample(range(-(2**60), 2**60), 5000))
    for i in ids:
        w.add(key_of(i), np.arange(i % 50, dtype="<u2").tobytes())
    w.close()
    r = ShardReader("file://" + path)
    assert [k for k, _ in r.scan()] == ids and r.entries == 5000 and len(r.index) > 3
    assert all(len(r.get(i)[0]) == i % 50 for i in ids[::37])
    wrong = [i for i in random.Random(1).sample(range(-(2**60), 2**60), 2000) if i not in set(ids)]
    assert not any(r.get(i) for i in wrong)


def test_encoder_equals_library_on_odd_text():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, e, rng = Tokenizer.from_file(path), Encoder(path, 1), random.Random(2)
    letters = [*"ab tehinro  \n\t ΣσÉéß<>|'s't😀\r0123'.,.,中文́\x00\x1c\x85İ", " ", "<|endoftext|>", "foo."]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(4000)]
    for x, y in zip(e.encode([x.encode() for x in texts]), t.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(x, "<u2").tolist() == [*y.ids, 1]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    near = [x[i % 20] + rng.normal(size=16).astype(np.float32) * rng.uniform(0, 0.5) for i in range(200)]
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *near, *x[:10], *(x[:5] * 1e-30), *(x[5:9] * 1e30)])]
    rows += [(600, None), (601, [0.0] * 16), (602, [None] + [1.0] * 15), (603, [float("nan")] * 16), (604, [float("inf")] * 16), (605, [1.0]), (606, [])]
    ok = [(i, np.array(v, np.float64)) for i, v in rows if i < 600]
    u = np.stack([v / np.abs(v).max() for _, v in ok])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    close = u @ u.T >= 0.9
    found = {r.vec_id: r for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert len(found) == len(rows)
    got, want = sum(found[i].n_links for i, _ in ok), int(close.sum()) - len(ok)
    assert 0.98 * want <= got <= want and want > 100
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i, _ in rows if i >= 600)
    assert all((found[i].component_id == i) == found[i].kept for i, _ in ok)
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert near_embeddings(none).count() == 0


def brute_links(rows, cosine=0.9):
    """{key: (n_links, component)} of (vec_id, vector) rows by all pairs; key is the row's place."""
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    units = []
    for _, v in rows:
        ok = bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        v = np.array(v, np.float64) if ok else None
        v = v / np.abs(v).max() if ok else None
        units.append(v / np.linalg.norm(v) if ok else None)
    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= cosine:
                n[a], n[b] = n[a] + 1, n[b] + 1
                above[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), i), i)
    return sorted((i, n[k], least[top(k)], i == least[top(k)]) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("levels", [1024, 3])
def test_embeddings_by_row(spark, monkeypatch, levels):
    """Every row's links and component, with lists of one or several levels, blocks of a few rows, mixed lengths and repeated ids."""
    from gridloom.llm import embeddings

    for name, value in {"LIST_ROWS": 12, "LEVEL_LISTS": levels, "BLOCK_ROWS": 40}.items():
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(2)
    rows = []
    for width, n in ((16, 260), (3, 40), (40, 40)):
        base = rng.normal(size=(n // 4, width))
        rows += [(len(rows) + k, (base[k % len(base)] + rng.normal(size=width) * rng.uniform(0, 0.3) * (k >= len(base))).tolist()) for k in range(n)]
    rows += [(1, rows[5][1]), (1, rows[300][1]), (7, rows[7][1]), (900, None), (901, []), (902, [0.0] * 16), (903, [1.0, None, 2.0]), (904, [float("inf")] * 3), (905, [1.0]), (906, [2.0]), (907, [-0.0, 0.0, 1.0]), (908, [0.0, 0.0, 1.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vector string, class_id int")
    found = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in near_embeddings(frame, sigmas=100.0).collect())
    assert found == brute_links(rows)
    assert len({c for *_, c, _ in found}) < len(rows) - 60


def test_embeddings_recall(spark):
    """With production settings nearly all links at and beyond the threshold are found, and none below it."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (y * x).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    cos = rng.uniform(0.88, 0.95, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *(cos * x + np.sqrt(1 - cos**2) * y)])]
    found = {r.vec_id: r.n_links for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {i: int(cos[i % 2000, 0] >= 0.9) for i in range(4000)}
    assert all(n <= want[i] for i, n in found.items())
    linked = [i for i in range(2000) if want[i]]
    # a link found counts at both ends, and recall is by pair
    assert all(found[i] == found[i + 2000] for i in range(2000))
    assert sum(found[i] for i in linked) >= 0.98 * len(linked)


def test_token_counts_against_library(docs, rows, none):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    s, c, rng = sentencepiece.SentencePieceProcessor(model_file=path), PieceCounter(path), random.Random(3)
    letters = [*"ab tehinro  \n\t▁éß<s>€😀\r0123'.,中文́\x00"]
    for t in ["", " ", "  a  b", "<s>x</s>", "\n\n", "▁▁ a", "<0x0A>", "a" * 3000, *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(2000))]:
        assert c.count(t) == len(s.encode(t))
    want = sorted(((i, len((t or "").encode()), len(s.encode(t or "")), len(s.encode(t or "")) > 4096) for i, t in rows), key=repr)
    assert pairs(count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert count_tokens(none).count() == 0
