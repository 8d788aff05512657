"""The pipeline's stages against plain computations on their own inputs, over the whole smallest tables."""

import duckdb
import numpy as np

import corpus_pipeline
from tests.llm.test_leaks import found_by_force
from tests.llm.test_nearsets import groups_by_force
from vqspark.llm import mixing, toxicity

DATA = "/root/testdata/sf0.001"


def plain_score(text, weight_of, bias):
    """Score of a text by the definition: the sum over its distinct hashed n-grams."""
    data = text.lower().encode()
    data = bytes(5) + data + bytes(5)
    found = set()
    for n in toxicity.SIZES:
        for at in range(len(data) - n + 1):
            key = int.from_bytes(data[at : at + n], "little")
            found.add(((key + n - 1) * int(toxicity.MIX) & ((1 << 64) - 1)) >> (64 - toxicity.BITS))
    total = bias + sum(weight_of.get(f, 0.0) for f in found)
    return 1 / (1 + np.exp(-total))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 4
    stage = dict(corpus_pipeline.STAGES)

    def written(frame, name):
        frame.write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = written(stage[names[0]](spark, docs, DATA), "0")
    assert kept.columns == docs.columns
    model = toxicity.learn(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    weight_of = dict(zip(model.features.tolist(), model.weights.tolist()))
    left = {r.doc_id for r in kept.collect()}
    for r in docs.collect():
        score = plain_score(r.text or "", weight_of, model.bias)
        if abs(score - toxicity.THRESHOLD) > 1e-9:
            assert (r.doc_id in left) == (score < toxicity.THRESHOLD), r.doc_id

    single = written(stage[names[1]](spark, kept, DATA), "1")
    assert single.columns == docs.columns
    rows = sorted((r.doc_id, r.text) for r in kept.collect())
    group = groups_by_force(rows)
    want = {rows[g][0] for g in set(group)}
    left = {r.doc_id for r in single.collect()}
    assert single.count() == len(left) and want <= left  # no clean document goes
    assert len(left - want) <= 0.1 * (len(rows) - len(want)), left - want

    clean = written(stage[names[2]](spark, single, DATA), "2")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    left = {r.doc_id for r in clean.collect()}
    for r in single.collect():
        assert (r.doc_id in left) == (not any(found_by_force(t, r.text) for _, t in items)), r.doc_id
    assert clean.columns == docs.columns

    mixed = stage[names[3]](spark, clean, DATA)
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{tmp_path}/2/*.parquet'")
    sampled = db.execute(f"select doc_id, weight, probability from ({mixing.mix_sql()}) where sampled").fetchall()
    found = sorted((r.doc_id, r.mix_weight, r.mix_probability) for r in mixed.collect())
    assert [d for d, *_ in found] == sorted(d for d, *_ in sampled)
    assert np.allclose([x[1:] for x in found], [x[1:] for x in sorted(sampled)], atol=2e-6)

    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == {d for d, *_ in sampled}


def test_empty_stages_and_other_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DATA).count() == 0
    rows = [(1, "a b c", "en", "s", 3, 0.5, 1, 2, "x"), (1, "a b c", "en", "s", 3, 0.5, 1, 2, "x"), (None, None, None, None, None, None, None, None, None), (2, "", "", "", 0, 0.0, 0, 0, "")]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, toxicity_score int, _leak int, _key1 string")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, DATA)
        assert out.columns[: len(odd.columns)] == odd.columns and (k == 3 or out.count() in (2, 4))
        out.count()
