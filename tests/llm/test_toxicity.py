"""Toxicity: held-out accuracy, what may be learned from, and odd inputs."""

import zlib

import numpy as np
import pytest

from vqspark.llm import toxicity

BAD = ["vilgrum", "snordak", "prêtchou"]


def corpus(n=900):
    rng = np.random.default_rng(6)
    parts = [a + b for a in "ka lo mi ner tas wo".split() for b in "ba de fin gul ho".split()]
    rows, labels = [], []
    for i in range(n):
        words = [str(x) for x in rng.choice(parts, int(rng.integers(20, 200)))]
        toxic = i % 4 == 0
        for _ in range(4 if toxic else 0):
            words[int(rng.integers(len(words)))] = str(rng.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def tables(spark, rows, labels):
    return spark.createDataFrame([(d, t, 0.5, 1) for d, t in rows], "doc_id long, text string, score double, predicted int"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = corpus()
    odd = [(None, "vilgrum " * 5), (5000, None), (5001, ""), (5002, "kaba " * 60_000), rows[3], rows[3]]
    docs, marks = tables(spark, rows + odd, [*labels, (None, 1), (7, None), (8, 0), (8, 1)])
    found = toxicity.toxicity_scores(docs, marks).collect()
    assert len(found) == len(rows) + len(odd)
    truth = dict(labels)
    own = [r for r in found if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in own]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= toxicity.THRESHOLD) and r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in found)
    assert len({r.score for r in found if r.doc_id == 3}) == 1


def test_held_out_labels_are_not_learned(spark):
    rows, labels = corpus(300)
    docs, marks = tables(spark, rows, labels)
    _, turned = tables(spark, rows, [(i, 1 - y if held_out(i) else y) for i, y in labels])
    a, b = toxicity.learn(docs, marks), toxicity.learn(docs, turned)
    assert (a.features == b.features).all() and a.weights == pytest.approx(b.weights) and a.bias == pytest.approx(b.bias)


def test_without_labels_or_rows(spark):
    rows, _ = corpus(20)
    docs, none = tables(spark, rows, [])
    assert all(r.score == pytest.approx(0.5) for r in toxicity.toxicity_scores(docs, none).collect())
    assert toxicity.toxicity_scores(docs.limit(0), none).count() == 0


def test_chunks_and_plain_counts_agree(monkeypatch):
    texts = [b"hello wide world", b"", b"ab", b"hello hello" * 30]
    want = set()
    for i, t in enumerate(texts):
        for n in toxicity.SIZES:
            whole = bytes(5) + t + bytes(5)
            for at in range(len(whole) - n + 1):
                if any(whole[at : at + n]):
                    key = np.uint64(int.from_bytes(whole[at : at + n], "little"))
                    with np.errstate(over="ignore"):
                        want.add((i, int(((key + np.uint64(n - 1)) * toxicity.MIX) >> np.uint64(64 - toxicity.BITS))))
    chosen = np.arange(1 << toxicity.BITS)
    zero = {int(((np.uint64(n - 1)) * toxicity.MIX) >> np.uint64(64 - toxicity.BITS)) for n in toxicity.SIZES}
    for chunk in (1 << 20, 13):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        who, column = toxicity._present(texts, chosen)
        got = {(int(a), int(b)) for a, b in zip(who, column) if a < len(texts) and int(b) not in zero}
        assert got == {x for x in want if x[1] not in zero}


def test_regression_finds_the_minimum():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 2, (80, 6))
    y = (x[:, 0] + rng.integers(0, 2, 80) > 1).astype(float)
    rows, columns = np.nonzero(x)
    starts = np.searchsorted(rows, np.arange(81))
    scale = np.array([1.0, -2.0, 0.5, 3.0, 1.0, 1.0])
    weights, bias = toxicity.fit_logistic(starts, columns, scale, y, ridge=1.0, positive=2.0)
    z = x @ weights + bias
    gap = np.where(y == 1, 2.0, 1.0) * (1 / (1 + np.exp(-z)) - y)
    assert abs(gap.sum()) < 1e-2 and np.abs((x * scale).T @ gap + weights / scale).max() < 1e-2
