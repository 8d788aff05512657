"""Raking and calibrated sampling."""

from collections import defaultdict

import pytest

from vqspark.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, g double, tokens int"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, l, s, 0.0, 0) for d, t, l, s in rows], SCHEMA)


def corpus():
    out = []
    for i in range(400):
        text = "a " * (i % 50 + 1) + ("| b" if i % 7 == 0 else "1234" if i % 11 == 0 else "")
        out.append((i, text, "en" if i % 4 else "de", f"s{(i * i) % 5}" if i > 150 else "hot"))
    return out


def test_marginals_and_budget(spark):
    rows = mixing.mix(docs(spark, corpus())).collect()
    total = sum(r.mix_tokens for r in rows)
    for d in mixing.DIMENSIONS:
        own, got = defaultdict(float), defaultdict(float)
        for r in rows:
            own[r[f"mix_{d}"]] += r.mix_tokens
            got[r[f"mix_{d}"]] += r.mix_tokens * r.mix_weight
        scale = sum(v ** mixing.POWERS[d] for v in own.values())
        for k, v in own.items():
            assert abs(got[k] / total - v ** mixing.POWERS[d] / scale) < 1e-6, (d, k)
    assert abs(sum(r.mix_tokens * r.mix_probability for r in rows) - mixing.KEEP * total) < 1e-6 * total
    assert max(r.mix_probability for r in rows) <= 1
    assert 0.3 * total < sum(r.mix_tokens for r in rows if r.mix_sampled) < 0.7 * total


def test_probability_stops_at_one(spark):
    rows = mixing.mix(docs(spark, corpus()), keep=0.95).collect()
    total = sum(r.mix_tokens for r in rows)
    assert abs(sum(r.mix_tokens * r.mix_probability for r in rows) - 0.95 * total) < 1e-6 * total
    assert any(r.mix_probability == 1 for r in rows)
    assert all(r.mix_sampled for r in mixing.mix(docs(spark, corpus()), keep=1.0).collect())


def test_many_cells_give_the_same(spark, monkeypatch):
    few = {r.doc_id: (round(r.mix_weight, 9), round(r.mix_probability, 9), r.mix_sampled) for r in mixing.mix(docs(spark, corpus()), sweeps=4).collect()}
    monkeypatch.setattr(mixing, "FEW_CELLS", 1)
    many = {r.doc_id: (round(r.mix_weight, 9), round(r.mix_probability, 9), r.mix_sampled) for r in mixing.mix(docs(spark, corpus()), sweeps=4).collect()}
    assert few == many


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, "x", "", ""), (1, "", "en", "a"), (1, "", "en", "a"), (2, "w " * 100_000, "en", None)]
    found = mixing.mix(docs(spark, rows)).collect()
    assert sorted(r.mix_tokens for r in found) == [1, 1, 1, 2, 100_001]
    assert len({r.mix_sampled for r in found if r.doc_id == 1}) == 1
    assert mixing.mix(docs(spark, [])).count() == 0


def test_given_targets(spark):
    targets = spark.createDataFrame([("lang", "de", 3.0), ("lang", "en", 1.0), ("source", "s1", 0.5), ("source", "hot", 0.25), ("source", "s4", 0.25)], "dimension string, value string, share double")
    rows = mixing.mix(docs(spark, corpus()), targets=targets).collect()
    total = sum(r.mix_tokens for r in rows)
    got = defaultdict(float)
    for r in rows:
        for d in mixing.DIMENSIONS:
            got[d, r[f"mix_{d}"]] += r.mix_tokens * r.mix_weight / total
    for (d, v), share in {("lang", "de"): 0.75, ("lang", "en"): 0.25, ("source", "s1"): 0.5, ("source", "hot"): 0.25, ("source", "s4"): 0.25, ("source", "s0"): 0}.items():
        assert abs(got[d, v] - share) < 1e-8, (d, v)
    assert not any(r.mix_sampled for r in rows if r.mix_source == "s0")
    light = {r.doc_id: (r.mix_weight, r.mix_sampled) for r in mixing.mix_weights(docs(spark, corpus()), targets=targets).collect()}
    assert light == {r.doc_id: (r.mix_weight, r.mix_sampled) for r in rows}


def test_targets_that_cannot_be_met(spark):
    with pytest.raises(ValueError, match="no document has"):
        mixing.mix(docs(spark, corpus()), targets=spark.createDataFrame([("lang", "fr", 1.0)], "dimension string, value string, share double"))
    rows = [(0, "a b", "en", "x"), (1, "a b c", "de", "y")]  # language and source go together
    both = spark.createDataFrame([("lang", "en", 0.9), ("lang", "de", 0.1), ("source", "x", 0.1), ("source", "y", 0.9)], "dimension string, value string, share double")
    with pytest.raises(ValueError, match="at once"):
        mixing.mix(docs(spark, rows), targets=both, sweeps=8)
