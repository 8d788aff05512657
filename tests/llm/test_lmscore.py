"""Cross-entropy differences against a plain computation with dictionaries."""

import math
import random
from collections import Counter

import pytest

from vqspark.llm import lmscore


def plain(rows, wanted, words, bigrams):
    texts = [lmscore.words_of((t or "").encode()) for _, t in rows]
    own = [x for (d, _), x in zip(rows, texts) if d in wanted]
    count = [Counter(w for x in part for w in x) for part in (own, texts)]

    def least(counter, most):
        best = math.inf
        for n in sorted({v for v in counter.values() if v >= 2}, reverse=True):
            if sum(v >= n for v in counter.values()) > most:
                break
            best = n
        return best

    bound = least(Counter({w: n for w, n in count[0].items() if len(w) <= lmscore.LONGEST}), words)
    known = {w for w, n in count[0].items() if n >= bound and len(w) <= lmscore.LONGEST}
    fold = lambda x: ["<s>", *(w if w in known else "<?>" for w in x), "</s>"]
    lists = [[fold(x) for x in own], [fold(x) for x in texts]]
    pairs = [Counter(p for x in part for p in zip(x, x[1:])) for part in lists]
    clear = Counter({p: n for p, n in pairs[0].items() if "<?>" not in p})
    bound = least(clear, bigrams)
    listed = {p for p, n in clear.items() if n >= bound}
    vocabulary = [*known, "<?>", "</s>"]
    out = []
    for (d, _), text in zip(rows, lists[1]):
        losses = []
        for m in (0, 1):
            singles = Counter(w for x in lists[m] for w in x)
            total = sum(singles[w] + 1 for w in vocabulary)
            ratio = lambda p: lmscore.LAMBDA * pairs[m][p] / max(1, singles[p[0]]) if p in listed else 0  # noqa: B023, E731
            loss = 0
            for p in zip(text, text[1:]):
                left = 1 - sum(ratio(q) for q in listed if q[0] == p[0])
                loss -= math.log(ratio(p) + left * (singles[p[1]] + 1) / total)
            losses.append(loss / (len(text) - 1))
        out.append((d, len(text) - 1, *losses))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("aa bb cc dd ee, ff. GG hh ii jj".split()[: 4 + i % 7]) for _ in range(rng.randint(1, 30)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (None, "aa bb"), (3, "aa bb cc"), (102, "z" * 90 + " aa " * 500), (103, "!!! ...")]


@pytest.mark.parametrize("words,bigrams", [(1000, 1000), (5, 7), (0, 0)])
def test_against_plain(spark, words, bigrams):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1.0, 2) for d, t in rows], "doc_id long, text string, score double, n_tokens int")
    ids = spark.createDataFrame([(i,) for i in [*range(0, 60, 3), 102, 102, None]], "doc_id long")
    found = lmscore.cross_entropy_difference(docs, ids, words, bigrams).collect()
    want = plain(rows, {*range(0, 60, 3), 102}, words, bigrams)
    got = sorted(((r.doc_id, r.n_tokens, r.target_loss, r.background_loss) for r in found), key=str)
    assert [x[:2] for x in got] == [x[:2] for x in want] or sorted(str(x[:2]) for x in got) == sorted(str(x[:2]) for x in want)
    key = lambda x: (str(x[0]), x[1], round(x[2], 6))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == pytest.approx(b[3])
    assert all(abs(r.score - (r.target_loss - r.background_loss)) < 1e-12 for r in found)


@pytest.mark.parametrize("hot", [0, 9, lmscore.HOT])
def test_no_caps(spark, hot):
    """More words and bigrams than were kept at most, each twice in the target, are all known; what is sent and what is joined add up alike."""
    n = (1 << 17) + 5_000
    texts = [" ".join(f"w{i}" for i in range(at, min(n, at + 1000))) for at in range(0, n, 1000)]
    rows = [(i, t) for i, t in enumerate(texts * 2)] + [(-1, "never seen words"), (None, "w5 w6 w9"), (-2, "w5 w6 w9")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    ids = spark.createDataFrame([(i,) for i in range(2 * len(texts))], "doc_id long")
    found = {r.doc_id: r for r in lmscore.cross_entropy_difference(docs, ids, hot=hot).collect()}
    assert len(found) == len(rows) and found[-2].target_loss == pytest.approx(found[None].target_loss)
    size, tokens = n + 2 + 2 * n + 2 * len(texts), 2 * n
    known, end = 3 / size, (2 * len(texts) + 1) / size
    begin = lmscore.LAMBDA * 2 / (2 * len(texts))
    left = 1 - lmscore.LAMBDA
    words = len(texts[0].split())
    want = -(math.log(begin + left * known) + (words - 1) * math.log(lmscore.LAMBDA + left * known) + math.log(lmscore.LAMBDA + left * end)) / (words + 1)
    assert tokens == sum(found[i].n_tokens - 1 for i in range(2 * len(texts)))
    assert found[0].target_loss == pytest.approx(want) and found[0].target_loss < 0.6 < found[-1].target_loss


def test_long_words_are_known(spark):
    """A clause of an unspaced script is one word of many bytes; it counts as a short one does."""
    rows = [(i, text.replace("x", word)) for word in ("火车从柏林出发开往汉堡中途不停站", "short") for i, text in ((len(word) * 100 + k, t) for k, t in enumerate(("x ja", "x nein", "ja x")))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.target_loss, r.background_loss) for r in lmscore.cross_entropy_difference(docs, docs.select("doc_id")).collect()}
    for k in range(3):
        assert found[1600 + k] == pytest.approx(found[500 + k])


def test_probabilities_sum_to_one():
    import numpy as np

    keys = np.array([(1 << 32) | 3, (3 << 32) | 4, (4 << 32) | 2])
    models = lmscore.build_models(([b"a", b"b"], np.array([5, 3]), np.array([9, 4])), (2, 4), (1, 6), keys, (np.array([2, 3, 1]), np.array([2, 4, 1])))
    for m in (0, 1):
        for before in (0, 1, 3, 4):
            total = 0
            for after in (0, 2, 3, 4):
                total += np.exp(-models.losses(np.array([before]), np.array([after]))[m])
            assert abs(total - 1) < 1e-9


def test_no_target_and_empty(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert lmscore.cross_entropy_difference(docs, none).count() == len(corpus())
    assert lmscore.cross_entropy_difference(docs.limit(0), none).count() == 0
