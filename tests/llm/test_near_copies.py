"""The near-copy groups against brute-force Jaccard over five-word shingles."""

import random

import numpy as np
import pytest

import corpus_pipeline as P
from gridloom.llm import simhash
from gridloom.llm.simhash import near_copy_groups
from tests.llm.test_operators import corpus, frame, vocabulary


def brute(rows):
    """The smallest key (null last) of each component of links."""
    words = [(t or "").encode().lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    above = list(range(len(rows)))

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both, every = len(sets[x] & sets[y]), len(sets[x] | sets[y])
            if 5 * both >= 4 * every:
                above[top(x)] = top(y)
    groups = {}
    for x, (i, _) in enumerate(rows):
        groups.setdefault(top(x), []).append((i is None, i or 0))
    return sorted(((None if min(g)[0] else min(g)[1]) for g in groups.values()), key=repr)


def edited(seed=3, n=12):
    """Texts with copies of which some words are changed, in chains and around one text, and a passage that most texts hold."""
    rng, words = random.Random(seed), vocabulary(5, 300)
    passage, rows = " ".join(rng.choices(words, k=40)), []
    for _ in range(n):
        own = rng.choices(words, k=rng.randint(30, 200))
        for k in range(8):
            text = list(own)
            for _ in range(rng.randint(0, max(1, len(own) // 40))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows), " ".join(text) + (f" {passage}" if rng.random() < 0.8 else "")))
            if k % 3 == 2:
                own = text
    rng.shuffle(rows)
    return rows


def recall(found, want, rows):
    """Of the documents that brute force drops, the share that is dropped too; no other may be."""
    assert set(want) <= set(found)
    return (len(rows) - len(found)) / (len(rows) - len(want))


@pytest.mark.parametrize("rows", [edited(), edited(4, 25), corpus()])
def test_groups_against_brute_force(spark, rows):
    found = [r.doc_id for r in near_copy_groups(frame(spark, rows)).collect()]
    assert recall(found, brute(rows), rows) >= 0.95


def test_recall_at_the_least_similarity(spark):
    """Pairs of texts with a similarity from 0.8 to 0.9: at least nine in ten meet."""
    rng, words, rows = random.Random(11), vocabulary(6, 4000), []
    while len(rows) < 600:
        own = rng.choices(words, k=300)
        shift = rng.randint(32, 66)  # shingles that the other text hasn't, and as many that it alone has
        text = own[shift // 2 :] + rng.choices(words, k=shift // 2)
        rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(text))]
    want, found = brute(rows), [r.doc_id for r in near_copy_groups(frame(spark, rows)).collect()]
    assert len(want) < 400 and recall(found, want, rows) >= 0.9


def test_a_large_group_costs_rows_in_proportion(spark, monkeypatch):
    """A group of a thousand near copies proposes some pairs a text, not all pairs, and is one group."""
    rng, words = random.Random(2), vocabulary(8, 2000)
    own, rows = rng.choices(words, k=200), []
    for i in range(1000):
        text = list(own)
        text[rng.randrange(200)] = rng.choice(words)
        rows.append((i, " ".join(text)))
    real, counts = simhash.proposed_pairs, []

    def counted(classes):
        found = real(classes)
        counts.append(found.count())
        return found

    monkeypatch.setattr(simhash, "proposed_pairs", counted)
    assert near_copy_groups(frame(spark, rows)).count() <= 3
    assert counts[0] < 60 * 1000


def test_taken_rounds():
    key, node = np.zeros(6, np.int64), np.arange(6)
    check = np.array([0, 1, 3, 2**64 - 1, 2**64 - 2, 0], np.uint64)
    hubs, members, above = simhash.taken(key, node, check)
    assert len(hubs) == 2 and len(members) == 4
    assert all(np.bitwise_count(check[m] ^ check[h]) <= simhash.NEAR_BITS for m, h in zip(members, above, strict=True))


def test_stage_drops_edited_copies_and_keeps_others(spark):
    rng, words = random.Random(9), vocabulary(7, 500)
    own = rng.choices(words, k=200)
    one, far = list(own), list(own)
    for at in (20, 90, 150):
        one[at] = "edited"
    for at in range(0, 200, 15):
        far[at] = "other"
    rows = [(1, " ".join(own)), (2, " ".join(one)), (3, " ".join(far))]
    assert sorted(r.doc_id for r in P.near_copies(spark, frame(spark, rows), "").collect()) == [1, 3]
