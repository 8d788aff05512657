"""SimHash groups against a brute force over all pairs."""

import numpy as np
import pytest
import xxhash

from vqspark.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups_by_force(rows):
    fps = [plain(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                label[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fps[i] - (fps[i] >> 63 << 64), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus():
    rng = np.random.default_rng(3)
    vocabulary = [f"Wort{i}é" for i in range(300)]
    rows = []
    for d in range(60):
        words = list(rng.choice(vocabulary, int(rng.integers(1, 400))))
        for _ in range(int(rng.integers(1, 6))):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words[int(rng.integers(len(words)))] = str(rng.choice(vocabulary))
    rows += [(5000, None), (5001, ""), (5002, "  \n\t"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (None, "one two"), (5006, "x " * 50_000)]
    return rows + [rows[0], rows[0]]


def test_against_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, fp string, component_id int")
    found = [(r.doc_id, r.fp, r.component_id) for r in simhash.simhash_groups(docs).collect()]
    assert sorted(found, key=str) == groups_by_force(rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(docs).count() == 0


@pytest.mark.parametrize("errors", [0, 1, 2])
def test_keys_meet(errors):
    rng = np.random.default_rng(errors)
    x = rng.integers(-(2**63), 2**63 - 1, 3000)
    y = x.view(np.uint64).copy()
    for i in range(len(y)):
        for b in rng.choice(64, errors, replace=False):
            y[i] ^= np.uint64(1) << np.uint64(b)
    rx, kx, hx = simhash.keys_of(x)
    ry, ky, hy = simhash.keys_of(y.view(np.int64))
    assert len({r for r, _ in set(zip(rx[hx], kx[hx])) & set(zip(ry[~hy], ky[~hy]))}) == len(x)


def test_blocks_give_the_same_shingles(monkeypatch):
    text = ("Ein  Satz\nmit é und\tmehr " * 40).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 11)
    assert simhash.fingerprint(text) == whole
