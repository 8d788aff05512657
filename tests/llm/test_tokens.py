"""Prefix counts against the tokenizers library."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vqspark.llm import tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", " ", "  ", "\n", "'s", "'re", "'", "l", "ll", "é", "9", "!", "<|endoftext|>", "<|end", "|>", "\t", "不", "ing", "the", " the", " ", "²", "\U0001f600"]


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def samples(n):
    rng = random.Random(n)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def test_every_prefix_and_budget(library):
    counter = tokens.counter_of(PATH)
    for text in samples(150):
        index = counter.index(text)
        counts = [library(text[:i]) for i in range(len(text) + 1)]
        assert [index.at(i) for i in range(len(text) + 1)] == counts, text
        assert counter.count(text) == counts[-1]
        for budget in (0, 1, 3, 6):
            assert index.fit(budget) == max(i for i, n in enumerate(counts) if n <= budget), (text, budget)


def test_memos_can_be_emptied(library, monkeypatch):
    counter = tokens.PrefixCounter(PATH)
    for memo in (counter.chunk, counter.whole, counter.stable):
        memo.most = 3
    for text in samples(40):
        assert counter.count(text) == library(text)


def test_table(spark, library):
    texts = [None, "", "x" * 30_000, "the cat " * 20_000, "<|endoftext|>" * 3, *samples(30)]
    rows = [(i if i else None, t, "n", 7) for i, t in enumerate(texts)] + [(1, "", "n", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, n_bytes int")
    found = sorted((tuple(r) for r in tokens.token_counts(docs, PATH, budget=5).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n = library(t or "")
        fit = None if len(t or "") > 1000 else max(k for k in range(len(t or "") + 1) if library((t or "")[:k]) <= 5)
        want.append((i, len((t or "").encode()), n, n > 512, fit))
    assert [r[:4] for r in found] == [r[:4] for r in sorted(want, key=str)]
    assert all(w[4] in (None, f[4]) for f, w in zip(found, sorted(want, key=str)))
    assert tokens.token_counts(docs.limit(0), PATH).count() == 0


def test_test_data(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r.n_tokens for r in tokens.token_counts(docs, PATH).collect()}
    assert found == {r.doc_id: library(r.text or "") for r in docs.collect()}


def test_long_runs_take_linear_time(library):
    counter = tokens.PrefixCounter(PATH)
    for c in " a-=0":
        index = counter.index(c * 3000)
        for i in (1, 2, 17, 511, 512, 513, 514, 700, 1023, 1999, 2600, 3000):
            assert index.at(i) == library(c * i), (c, i)
    begin = time.perf_counter()
    index = counter.index("x" + " " * 1_000_000 + "y")
    length = index.fit(100)
    assert time.perf_counter() - begin < 5  # a second or so on a quiet machine
    assert library(index.text[:length]) <= 100 < library(index.text[: length + 1])
    assert index.at(1_000_002) == index.counts[-1]


def test_budgets_of_long_texts(library):
    rng = random.Random(4)
    counter = tokens.counter_of(PATH)
    for n in range(40):
        text = "".join(rng.choice(PARTS) for _ in range(rng.choice([300, 900])))
        whole = counter.index(text)
        for budget in (0, 3, 20, 90):
            assert tokens.fit_chars(counter, text, counter.count(text), budget) == whole.fit(budget)
            assert counter.count_and_fit(text, budget) == (counter.count(text), whole.fit(budget))
        single = " ".join(x for x in text.replace("<|endoftext|>", "\n").split(" ") if x)  # what is counted by chunks
        whole = counter.index(single)
        for budget in (0, 1, 2, 3, 5, 8, 20, 90, 200):
            assert counter.count_and_fit(single, budget) == (whole.counts[-1], whole.fit(budget)), (single, budget)


def test_stored_prefixes(spark, library):
    texts = [None, "", *samples(60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ends int")
    found = tokens.prefix_counts(docs, PATH).select("doc_id", "ends", "counts", tokens.tokens_until(F.lit(9)).alias("until"), tokens.longest_within(F.lit(4)).alias("within")).collect()
    for r in found:
        text = texts[r.doc_id] or ""
        assert (r.counts or [0])[-1] == library(text) and (r.ends or [0])[-1] == len(text)
        assert r.until == max([0, *(c for e, c in zip(r.ends, r.counts) if e <= 9)])
        assert r.within == max([0, *(e for e, c in zip(r.ends, r.counts) if c <= 4)])
