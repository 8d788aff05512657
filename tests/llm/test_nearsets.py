"""Near-duplicate groups by five-word shingles against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest

from vqspark.llm import nearsets

DATA = "/root/testdata/sf0.001"


def sets_of(text):
    words = (text or "").translate({c: chr(c + 32) for c in range(65, 91)}).encode().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def jaccard(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b) if a | b else 1.0


def groups_by_force(rows, least=0.8):
    sets = [sets_of(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if jaccard(sets[i], sets[j]) >= least:
                up[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def corpus():
    """Copies at similarities from below to above the threshold."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, n = [], 0
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.choice([80, 200, 500]))
        rows.append((n, " ".join(words)))
        for k in (0, 1, 2, 3):
            n += 1
            rows.append((n, edited(rng, words, k * len(words) // 100)))
        n += 1
        rows.append((n, edited(rng, words, len(words) // 10)))
        n += 1
    return rows


def test_recall_and_precision_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, node int, key1 int")
    group = {r.doc_id: r.group_key for r in nearsets.near_groups(docs).collect()}
    sets = [sets_of(t) for _, t in rows]
    force = groups_by_force(rows)
    close = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    found = sum(group[i] == group[j] for i, j in close) / len(close)
    sure = [(i, j) for i, j in close if jaccard(sets[i], sets[j]) >= 0.9]
    assert found >= 0.85 and sum(group[i] == group[j] for i, j in sure) / len(sure) >= 0.95, found
    for i in range(len(rows)):
        for j in range(i):
            if group[i] == group[j]:
                assert force[i] == force[j]


def test_odd_rows(spark):
    rows = [(4, None), (2, ""), (9, " \n"), (None, "a b"), (7, "A  B"), (7, "A  B"), (5, "c"), (None, "lonely text"), (8, "x " * 300_000), (3, "x " * 200_000)]
    docs = spark.createDataFrame([(d, t, 0, "k") for d, t in rows], "doc_id long, text string, _key1 int, Again string")
    kept = nearsets.keep_one_each(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, (r.text or "")[:11]) for r in kept.collect()), key=str) == sorted([(2, ""), (7, "A  B"), (5, "c"), (None, "lonely text"), (3, "x x x x x x")], key=str)
    assert nearsets.keep_one_each(docs.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c d e f")] * 9, "doc_id long, text string")
    assert [tuple(r) for r in nearsets.keep_one_each(same).collect()] == [(1, "a b c d e f")]


@pytest.mark.parametrize("block", [nearsets.BLOCK, 8])
def test_a_crowd_of_near_copies(spark, monkeypatch, block):
    monkeypatch.setattr(nearsets, "BLOCK", block)
    monkeypatch.setattr(nearsets, "BROADCAST_ROWS", 0 if block == 8 else nearsets.BROADCAST_ROWS)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    docs = spark.createDataFrame([(i, edited(rng, words, 2)) for i in range(300)], "doc_id long, text string")
    groups = nearsets.near_groups(docs).groupBy("group_key").count().collect()
    assert max(r["count"] for r in groups) >= 297
    pairs = nearsets.keep_one_each(docs).count()
    assert pairs == len(groups)


@pytest.mark.parametrize("block", [nearsets.BLOCK, 32])
def test_links_that_a_tree_leaves_out(spark, monkeypatch, block):
    """Crowds whose similarities lie on both sides of the threshold: the groups are those of all pairs that meet under a key."""
    monkeypatch.setattr(nearsets, "BLOCK", block)
    rng = random.Random(4)
    texts = []
    for n in (60, 150, 400):
        words = [f"w{n}x{i}" for i in range(n)]
        texts += [edited(rng, words, rng.choice([1, 2, 3]) * n // 80) for _ in range(120)]
    found = [nearsets.shingles(t.encode()) for t in texts]
    keys = [set(x.tolist()) for x in nearsets.keys_of(nearsets.best_codewords(np.stack([nearsets.margins(s) for s in found])).astype(np.int64))]
    sets = [sets_of(t) for t in texts]
    up = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if up[i] != up[j] and keys[i] & keys[j] and jaccard(sets[i], sets[j]) >= 0.8:
                up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    group = {}
    for r in nearsets.near_groups(docs).collect():
        group.setdefault(r.group_key, []).append(r.doc_id)
    want = {}
    for i, x in enumerate(up):
        want.setdefault(x, []).append(i)
    assert sorted(map(sorted, group.values())) == sorted(want.values()) and 3 < len(want) < len(texts)


def test_bounds_and_counts_of_sets():
    """Sets differ in at least as many shingles as parities, and shared ones are counted over several rounds of columns."""
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 9000, n)) for n in (0, 1, 5, 3000, 8000, 20000)]
    found = nearsets.shared_counts(sets)
    for i, j in combinations(range(len(sets)), 2):
        assert found[i, j] == found[j, i] == len(np.intersect1d(sets[i], sets[j]))
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words[:n]).encode() for n in (0, 3, 5, 200, 300)] + [edited(random.Random(i), words, 5).encode() for i in range(9)]
    found = [nearsets.shingles(t) for t in texts]
    for x in found:
        for y in found:
            assert np.bitwise_count((nearsets.parities(x) ^ nearsets.parities(y)).view(np.uint64)).sum() <= len(set(x) ^ set(y))
