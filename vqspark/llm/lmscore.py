"""Cross-entropy difference of matched target and background bigram models.

Both models share one vocabulary and one inventory of bigrams, so their losses
differ by what the corpora say and not by what they left out. Counts cover all
documents. Vocabulary and inventory are all words and bigrams that occur twice in
the target; other words are one unknown word, other bigrams are left to the
unigrams. So they grow with the input, as written tables keyed by 64-bit hashes.

A text's loss is a sum over its features: -log(backoff * unigram) splits by words,
and a listed bigram adds -log(1 + ratio / (backoff * unigram)). The features that
occur most are sent to the tasks, so none that is joined by a shuffle is frequent;
both give the same sum.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.llm.graph import cut, release, remove, written
from vqspark.llm.keymap import bit_map, listed

#: No length makes a word unknown: words are keyed by their hashes.
LONGEST = sys.maxsize
#: Features (24 bytes each) that are sent to every task; the others are joined.
HOT = 1 << 20
#: Least and most bits of the map that keeps features which no model has out of the shuffles.
MAP_BITS = (16, 28)
#: Weight of the bigrams against the unigrams.
LAMBDA = 0.6
UNKNOWN, BEGIN, END = 0, 1, 2
#: Hashes that stand for the beginning and the end of a text, and the key under which tokens are counted.
BEGIN_HASH, END_HASH, TOKENS = -0x61C8864680B583EB, 0x2545F4914F6CDD1D, 0x1D8E4E27C47D124F
#: Words that a task counts together, words whose hashes it remembers, and rows in a batch that it returns.
FLUSH, MEMO, OUT = 1 << 20, 1 << 17, 1 << 16
BROADCAST_ROWS = 1_000_000
#: Lower-cases ASCII letters and turns ASCII punctuation into spaces.
FOLD = bytes(ord(" ") if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class _Hashes(dict):
    """64-bit hash of each word, remembered for those seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        value = self[word] = int(np.uint64(xxhash.xxh64_intdigest(word) or 1).view(np.int64))
        return value


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Key of the bigram of two words; that of a word alone is its hash."""
    return ((a << 1) | ((a >> 63) & 1)) ^ b


def _chunks(batches: Iterator[pa.RecordBatch], most: int):
    """``(ids, n_words, row, a, b)`` for runs of texts: for each pair of neighbours its text's place in the run and the hashes.

    ``b`` of a text's last pair is its end, and ``a`` of its first its beginning.
    """
    hash_of = _Hashes()
    get = hash_of.__getitem__
    ids, sizes, held, size = [], [], [], 0

    def whole():
        n = np.array(sizes, np.int64)
        b = np.concatenate(held) if held else np.empty(0, np.int64)
        a = np.empty_like(b)
        a[1:] = b[:-1]
        a[(np.cumsum(n + 1) - n - 1)] = BEGIN_HASH
        return ids, n, np.repeat(np.arange(len(n)), n + 1), a, b

    for batch in batches:
        others = list(zip(*(c.to_pylist() for c in batch.columns[1:]))) or [None] * batch.num_rows
        for key, text in zip(others, batch.column(0)):
            words = words_of(text.as_py())
            ids.append(key)
            sizes.append(len(words))
            held.append(np.array([*map(get, words), END_HASH], np.int64))
            size += len(words) + 1
            if size > most:
                yield whole()
                ids, sizes, held, size = [], [], [], 0
    if ids:
        yield whole()


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """In batches that neither side needs much memory for."""
    return (batch.slice(at, OUT) for at in range(0, batch.num_rows, OUT))


def _count_target(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(a, b, n)`` of words (a is 0) and bigrams of known hashes."""
    for _, sizes, _, a, b in _chunks(batches, FLUSH):
        words, n = np.unique(b[(b != END_HASH) & (b != UNKNOWN)], return_counts=True)
        some = (a != UNKNOWN) & (b != UNKNOWN)
        a, b = a[some], b[some]
        order = np.argsort(keys := _pair_keys(a, b))
        starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[:1]] + 1))
        first, times = order[starts], np.diff(starts, append=len(keys))
        columns = [np.concatenate(x) for x in ((np.zeros(len(words), np.int64), a[first], [0]), (words, b[first], [TOKENS]), (n, times, [sizes.sum()]))]
        yield from _parts(pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["a", "b", "n"]))


def _count_listed(bits):
    """``(key, n)`` of the features that the map has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sizes, _, a, b in _chunks(batches, FLUSH):
            words, pairs = b[(b != END_HASH) & (b != UNKNOWN)], _pair_keys(a, b)[(a != UNKNOWN) & (b != UNKNOWN)]
            keys, n = np.unique(np.concatenate([x[listed(bits.value, x)] for x in (words, pairs)]), return_counts=True)
            yield from _parts(pa.RecordBatch.from_arrays([pa.array(np.append(keys, TOKENS)), pa.array(np.append(n, sizes.sum()))], names=["key", "n"]))

    return run


def _least_count(counts: DataFrame, column: str, most: int, least: int) -> int:
    """The least count, ``least`` or more, that no more than ``most`` rows reach."""
    rows = counts.where(F.col(column) >= least).groupBy(column).agg(F.count("*").alias("rows")).sort(F.desc(column))
    total, bound = 0, None
    for r in rows.toLocalIterator():  # as many rows as different counts, read from the top
        total += r["rows"]
        if total > most:
            break
        bound = r[column]
    return bound if bound is not None else 1 << 62


class Models:
    """Log probabilities of both models over few words, in memory."""

    def __init__(self, keys, ratios, backoff, unigram):
        self.keys, self.ratios, self.backoff, self.unigram = keys, ratios, backoff, unigram

    def losses(self, before: np.ndarray, after: np.ndarray) -> tuple[float, float]:
        """Mean negative log probability of a text's words in the target and the background model."""
        at = np.minimum(np.searchsorted(self.keys, key := (before << 32) | after), max(0, len(self.keys) - 1))
        hit = self.keys[at] == key if len(self.keys) else np.zeros(len(key), bool)
        return tuple(float(-np.log(np.where(hit, self.ratios[m][at] if len(self.keys) else 0, 0) + self.backoff[m][before] * self.unigram[m][after]).mean()) for m in (0, 1))


def build_models(vocabulary, texts, unknown, keys, bigrams, weight=LAMBDA) -> Models:
    """Interpolated bigrams over add-one unigrams. The backoff of a word is what its listed bigrams leave over."""
    size = len(vocabulary[0]) + 3
    ratios, backoff, unigram = [], [], []
    first, second = keys >> 32, keys & 0xFFFFFFFF
    for m in (0, 1):
        counts = np.zeros(size)
        counts[UNKNOWN], counts[END], counts[3:] = unknown[m], texts[m], vocabulary[1 + m]
        share = counts + 1
        share[BEGIN] = 0
        unigram.append(share / share.sum())
        context = counts.copy()
        context[BEGIN] = texts[m]
        ratio = weight * bigrams[m] / np.maximum(context[first], 1)
        ratios.append(ratio)
        backoff.append(1 - np.bincount(first, ratio, size)[:size])
    return Models(keys, ratios, backoff, unigram)


def _score(bits, hot, base):
    """A row for each text with its sums over sent features (n is 0), and one for each feature (n is 1) that is to be joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, *values = hot.value
        for rows, sizes, at, a, b in _chunks(batches, FLUSH // 4):
            sums = [start + sizes * each for start, each in base]
            cold_rows, cold_keys = [], []
            for key, some in ((b, (b != END_HASH) & (b != UNKNOWN)), (_pair_keys(a, b), (a != UNKNOWN) & (b != UNKNOWN))):
                some &= listed(bits.value, key)
                order = np.argsort(key[some])  # keys in order are found much faster
                key, row = key[some][order], at[some][order]
                place = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
                hit = keys[place] == key if len(keys) else np.zeros(len(key), bool)
                for m in (0, 1):
                    sums[m] = sums[m] + np.bincount(row[hit], values[m][place[hit]], len(sizes))
                cold_rows.append(row[~hit])
                cold_keys.append(key[~hit])
            own, row, key = np.array([r for r, _ in rows], np.int64), np.concatenate(cold_rows), np.concatenate(cold_keys)
            none = np.zeros(len(row))
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, own[row]])),
                    pa.array(np.concatenate([own, key])),
                    pa.array([*(d for _, d in rows), *[None] * len(row)], pa.int64()),
                    pa.array(np.repeat([0, 1], [len(own), len(row)]).astype(np.int8)),
                    pa.array(np.concatenate([sizes + 1, none.astype(np.int64)])),
                    *(pa.array(np.concatenate([x, none])) for x in sums),
                ],
                names=["row", "key", "doc_id", "n", "n_tokens", "t", "b"],
            )
            yield from _parts(out)

    return run


def learn(docs: DataFrame, target_ids: DataFrame, words: int | None = None, bigrams: int | None = None, id_col: str = "doc_id", text_col: str = "text"):
    """``(features, path, map, base)``: a written table ``(key, background, t, b)`` of what each feature adds to the losses, and
    for each model what a text and an unknown word add. Target: the rows whose id is in ``target_ids``; background: all rows.

    ``words`` and ``bigrams`` keep only so many of the most frequent; None keeps all.
    """
    ids = target_ids.select(F.col(id_col).cast("long").alias("_id")).where("_id is not null").distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = docs.select(F.col(text_col).cast("binary").alias("_text"), F.col(id_col).cast("long").alias("_id"))
    wanted = own.join(F.broadcast(ids) if few else ids, "_id", "left_semi").select("_text")
    texts = (wanted.count(), own.count())

    tokens = (F.col("a") == 0) & (F.col("b") == TOKENS)
    counted, first_path = written(wanted.mapInArrow(_count_target, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("target")).where((F.col("target") >= 2) | tokens))
    in_target = counted.where(tokens).agg(F.sum("target")).first()[0] or 0
    known, pairs = counted.where((F.col("a") == 0) & ~tokens), counted.where("a <> 0")
    if words is not None:
        known = known.where(F.col("target") >= _least_count(known, "target", words, 2))
        ends = known.select("b").union(docs.sparkSession.createDataFrame([(BEGIN_HASH,), (END_HASH,)], "b long"))
        pairs = pairs.join(ends.withColumnRenamed("b", "a"), "a", "left_semi").join(ends, "b", "left_semi").select("a", "b", "target")
    if bigrams is not None:
        pairs = pairs.where(F.col("target") >= _least_count(pairs, "target", bigrams, 2))
    turned = F.shiftleft("a", 1).bitwiseOR(F.shiftrightunsigned("a", 63))
    key = turned.bitwiseXOR(F.col("b")).alias("key")
    listed_features = known.unionByName(pairs).select("a", "b", "target", key)
    if words is not None or bigrams is not None:
        listed_features = cut(listed_features)
    release(docs.sparkSession)
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(listed_features, "key", listed_features.count(), 4, *MAP_BITS))

    everywhere = own.select("_text").mapInArrow(_count_listed(bits), "key long, n long").groupBy("key").agg(F.sum("n").alias("background"))
    both, both_path = written(everywhere.join(listed_features, "key", "left").where(F.col("a").isNotNull() | (F.col("key") == TOKENS)).select("a", "b", "target", "background"))
    del everywhere, counted, known, pairs, listed_features
    remove(docs.sparkSession, first_path)
    release(docs.sparkSession)
    in_all = both.where("a is null").agg(F.sum("background")).first()[0] or 0
    known, pairs = both.where("a = 0"), both.where("a <> 0")
    size, *sums = known.agg(F.count("*"), F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("background"), F.lit(0))).first()
    totals = [n + t + size + 2 for n, t in zip((in_target, in_all), texts)]

    over = [F.lit(LAMBDA) * F.col(c) for c in ("target", "background")]
    left = pairs.groupBy("a").agg(*(F.sum(x).alias(f"left{m}") for m, x in enumerate(over))).withColumnRenamed("a", "word")
    ends = docs.sparkSession.createDataFrame([(BEGIN_HASH, *texts), (END_HASH, *texts)], "word long, c0 long, c1 long")
    single = known.select(F.col("b").alias("word"), F.col("target").alias("c0"), F.col("background").alias("c1")).union(ends)
    of = lambda m: F.greatest(F.col(f"c{m}"), F.lit(1))
    single = single.join(left, "word", "left").select("word", *(x for m in (0, 1) for x in (of(m).alias(f"c{m}"), (1 - F.coalesce(f"left{m}", F.lit(0.0)) / of(m)).alias(f"backoff{m}"), ((F.col(f"c{m}") + 1) / totals[m]).alias(f"unigram{m}"))))
    single = cut(single)
    unknown = [float(np.log((n - s + 1) / t)) for n, s, t in zip((in_target, in_all), sums, totals)]
    begin = single.where(F.col("word") == BEGIN_HASH).first()
    base = [(float(-np.log(begin[f"backoff{m}"]) - np.log((texts[m] + 1) / totals[m])), -unknown[m]) for m in (0, 1)]

    alone = single.where(~F.col("word").isin(BEGIN_HASH, END_HASH)).select(F.col("word").alias("key"), F.col("c1").alias("background"), *((unknown[m] - F.log(F.col(f"backoff{m}")) - F.log(F.col(f"unigram{m}"))).alias("tb"[m]) for m in (0, 1)))
    first = single.select(F.col("word").alias("a"), "c0", "c1", "backoff0", "backoff1")
    second = single.select(F.col("word").alias("b"), "unigram0", "unigram1")
    ratios = pairs.join(first, "a").select("b", key, "background", *((over[m] / F.col(f"c{m}") / F.col(f"backoff{m}")).alias(f"over{m}") for m in (0, 1)))
    joined = ratios.join(second, "b").select("key", "background", *((-F.log1p(F.col(f"over{m}") / F.col(f"unigram{m}"))).alias("tb"[m]) for m in (0, 1)))
    features, path = written(alone.union(joined))
    remove(docs.sparkSession, both_path)
    return features, path, bits, base


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, words: int | None = None, bigrams: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """One row per input row: ``doc_id, n_tokens, target_loss, background_loss, score``.

    Losses are nats per token, the end of the text included; ``score`` is their
    difference, low for texts that are like the target. Words are what white
    space and ASCII punctuation separate. A null text counts as empty: it has its
    end only. Null ids belong to the background only; repeated rows are counted
    and scored each; without a target its model is uniform. Other columns are not
    looked at; an empty table gives an empty table. ``hot`` is the number of
    features sent to the tasks and doesn't change the result.
    """
    features, path, bits, base = learn(docs, target_ids, words, bigrams, id_col, text_col)
    release(docs.sparkSession)
    least = _least_count(features, "background", hot, 1)
    chosen = features.where(F.col("background") >= least).select("key", "t", "b").toArrow().sort_by("key")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(chosen.column(c).to_numpy() for c in ("key", "t", "b")))
    own = docs.select(F.col(text_col).cast("binary").alias("_text"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    scored = own.mapInArrow(_score(bits, sent, base), "row long, key long, doc_id long, n byte, n_tokens long, t double, b double")
    cold = features.where(F.col("background") < least).select("key", F.col("t").alias("t1"), F.col("b").alias("b1"))
    if cold.isEmpty():
        sums = scored.where("n = 0")
    else:
        more = [(F.col(c) + F.col("n") * F.coalesce(f"{c}1", F.lit(0.0))).alias(c) for c in "tb"]
        added = scored.join(cold, "key", "left").select("row", "doc_id", "n_tokens", *more)
        sums = added.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), F.sum("t").alias("t"), F.sum("b").alias("b"))
    losses = sums.select("doc_id", "n_tokens", (F.col("t") / F.col("n_tokens")).alias("target_loss"), (F.col("b") / F.col("n_tokens")).alias("background_loss"))
    out = cut(losses.withColumn("score", F.col("target_loss") - F.col("background_loss")))
    remove(docs.sparkSession, path)
    return out
