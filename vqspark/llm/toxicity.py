"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the lower-cased UTF-8 bytes, present or absent. The
log-count ratios come from all labelled texts that may be learned from; those of
the clearest features (chi-square) scale the inputs of a logistic regression,
which is fitted on a bounded sample of these texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vqspark.llm.graph import cut

SIZES = (4, 5, 6)
BITS = 19
#: Count added to each n-gram, ridge penalty, and weight of a toxic text against another in the regression.
ALPHA, RIDGE, POSITIVE = 1.0, 1.0, 4.0
#: Features that enter the regression, and labelled texts that it's fitted on at most.
FEATURES, SAMPLE = 2048, 10_000
THRESHOLD = 0.7
CHUNK = 1 << 20
#: Labels up to this many (9 bytes each) are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- features
def _stream(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(text, feature)`` of each n-gram of texts, in parts of bounded size.

    Zero bytes before, between and after them keep n-grams of two texts apart.
    """
    pad = bytes(max(SIZES) - 1)
    whole = pad + b"".join(t + pad for t in texts)
    lengths = np.array([len(t) + len(pad) for t in texts])
    ends = np.cumsum(lengths)  # the zeros before a text are its own; those after the last one are nobody's
    data = np.frombuffer(whole, np.uint8)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK + max(SIZES) - 1].astype(np.uint64)
        key = np.zeros(len(part), np.uint64)
        owner = None
        for n in range(max(SIZES)):
            key = key[: len(part) - n] | (part[n:] << np.uint64(8 * n))
            if n + 1 in SIZES:
                own = key[: min(CHUNK, len(key))]
                feature = (((own + np.uint64(n)) * MIX) >> np.uint64(64 - BITS)).astype(np.int32)
                if owner is None or len(owner) < len(feature):
                    owner = np.searchsorted(ends, np.arange(at, at + len(feature)), side="right").astype(np.int32)
                yield owner[: len(feature)], feature


def _normal(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def _present(texts: list[bytes], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``(text, column)`` pairs; ``chosen`` has the column of a feature, or -1."""
    found = []
    for owner, feature in _stream(texts):
        column = chosen[feature]
        hit = np.nonzero((column >= 0) & (owner < len(texts)))[0]
        found.append(_distinct((owner[hit].astype(np.int64) << 32) | column[hit]))
    found = _distinct(np.concatenate(found))
    return found >> 32, found & 0xFFFFFFFF


def _distinct(values: np.ndarray) -> np.ndarray:
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def _groups(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Consecutive texts of about a chunk together, a longer one alone."""
    group, size = [], 0
    for t in texts:
        if group and (size + len(t) > CHUNK or len(group) == 4000):
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t)
    if group:
        yield group


# ---------------------------------------------------------------- kernels
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    texts = np.zeros(2, np.int64)
    for batch in batches:
        labels = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        for group in _groups([_normal(t) for t in batch.column(0).to_pylist()]):
            own = labels[at : at + len(group)]
            at += len(group)
            pairs = _distinct(np.concatenate([_distinct((o.astype(np.int64) << BITS) | f) for o, f in _stream(group)]))
            pairs = pairs[: np.searchsorted(pairs, len(own) << BITS)]
            toxic = own[pairs >> BITS]
            feature = pairs & ((1 << BITS) - 1)
            for y in (0, 1):
                counts[y] += np.bincount(feature[toxic == y], minlength=1 << BITS)
                texts[y] += int((own == y).sum())
    seen = np.nonzero(counts.sum(axis=0) > 0)[0]
    for at in range(0, len(seen), 100_000):
        s = seen[at : at + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(counts[1, s]), pa.array(counts[0, s])], names=["feature", "toxic", "clean"])
    yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array(texts[1:]), pa.array(texts[:1])], names=["feature", "toxic", "clean"])


def _columns(features: np.ndarray) -> np.ndarray:
    chosen = np.full(1 << BITS, -1, np.int64)
    chosen[features] = np.arange(len(features))
    return chosen


def _rows(features: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _columns(features)
        for batch in batches:
            texts = [_normal(t) for t in batch.column(0).to_pylist()]
            at = 0
            for group in _groups(texts):
                who, column = _present(group, chosen)
                ends = np.searchsorted(who, np.arange(len(group) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(column.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, len(group)), lists], names=["y", "columns"])
                at += len(group)

    return run


def _score(features: np.ndarray, weights: np.ndarray, bias: float, name: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = _columns(features)
        for batch in batches:
            texts = [_normal(t) for t in batch.column(0).to_pylist()]
            sums = []
            for group in _groups(texts):
                who, column = _present(group, chosen)
                sums.append(np.bincount(who, weights[column], len(group)))
            total = np.concatenate(sums) + bias if sums else np.empty(0)
            score = 1 / (1 + np.exp(-np.clip(total, -60, 60)))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score)], names=[*batch.schema.names[1:], name])

    return run


# ---------------------------------------------------------------- regression
def fit_logistic(starts: np.ndarray, columns: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float = RIDGE, positive: float = POSITIVE, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights (scale included) and bias of a ridge logistic regression on sparse 0/1 rows times ``scale``; by L-BFGS.

    Rows of label 1 count ``positive`` times.
    """
    often = np.where(y == 1, positive, 1.0)
    rows = np.repeat(np.arange(len(y)), np.diff(starts))
    values = scale[columns]

    def loss(w):
        z = np.bincount(rows, values * w[columns], len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
        gap = often * (p - y)
        grad = np.append(np.bincount(columns, values * gap[rows], len(scale)), gap.sum())
        grad[:-1] += ridge * w[:-1]
        return (often * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * (w[:-1] ** 2).sum(), grad

    w = np.zeros(len(scale) + 1)
    now, grad = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, kept = -grad, []
        for s, g in reversed(past):
            a = (s @ step) / (s @ g)
            step = step - a * g
            kept.append(a)
        if past:
            s, g = past[-1]
            step = step * ((s @ g) / (g @ g))
        else:
            step = step / max(1.0, np.linalg.norm(grad))
        for (s, g), a in zip(past, reversed(kept)):
            step = step + (a - (g @ step) / (s @ g)) * s
        slope, size = grad @ step, 1.0
        while True:
            new, new_grad = loss(w + size * step)
            if new <= now + 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        moved, turned = size * step, new_grad - grad
        w, gain, now, grad = w + moved, now - new, new, new_grad
        if moved @ turned > 1e-12:
            past = [*past[-9:], (moved, turned)]
        if gain <= 1e-7 * max(1.0, now):
            break
    return w[:-1] * scale, float(w[-1])


# ---------------------------------------------------------------- operator
def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Chosen features, their weights and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float):
        self.features, self.weights, self.bias = features, weights, bias


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from the labelled rows of ``docs`` whose id isn't held out.

    Null ids and labels are left out; where an id has several labels, toxic wins.
    Without a text of each label all texts score the share of toxic ones (a half
    where there is no label). No more than ``sample`` rows are fitted by the
    regression, chosen by a hash of id and text (of rows that repeat beyond that
    number the first are taken); all labelled rows give the ratios.
    """
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    few = marks.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    own = docs.select(F.col(text_col).alias("_text"), F.col(id_col).cast("long").alias("_id")).where(~is_held_out(F.col("_id")))
    own = own.join(F.broadcast(marks) if few else marks, "_id").select("_text", "_y", "_id")
    counts = own.select("_text", "_y").mapInArrow(_count, "feature int, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    counts = cut(counts)
    n1, n0 = counts.where("feature = -1").select("toxic", "clean").first() or (0, 0)  # the row that counts texts
    if not n1 or not n0:
        share = (n1 + ALPHA) / (n1 + n0 + 2 * ALPHA)
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(share / (1 - share))))
    gap = a / n1 - b / n0
    mean = (a + b) / (n1 + n0)
    chi = gap * gap / (mean * (1 - mean) + 1e-9)
    best = counts.where("feature >= 0 and toxic + clean >= 3").orderBy(chi.desc(), "feature").limit(FEATURES).collect()
    best.sort(key=lambda r: r["feature"])
    features = np.array([r["feature"] for r in best], np.int64)
    toxic, clean = (np.array([r[c] for r in best], np.float64) for c in ("toxic", "clean"))
    ratio = np.log((toxic + ALPHA) / (n1 + 2 * ALPHA)) - np.log((clean + ALPHA) / (n0 + 2 * ALPHA))
    part = min(1.0, 0.95 * sample / (n1 + n0)) if n1 + n0 > sample else 1.0
    chosen = own.where(F.pmod(F.xxhash64("_id", "_text"), F.lit(1 << 20)) < int(part * (1 << 20))) if part < 1 else own
    rows = chosen.select("_text", "_y").mapInArrow(_rows(features), "y int, columns array<int>").limit(sample).toArrow()
    lists = rows.column("columns").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    starts = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))]).astype(np.int64)
    columns = lists.flatten().to_numpy().astype(np.int64)
    weights, bias = fit_logistic(starts, columns, ratio, rows.column("y").to_numpy().astype(np.float64))
    return Model(features, weights, bias)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] = (), name: str = "score") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the score of each row's whole text; a null text counts as empty."""
    if name.lower() in {c.lower() for c in keep}:
        raise ValueError(f"{name} is a column already")
    own = docs.select(F.col(text_col).cast("string").alias("_text_to_score"), *(F.col(f"`{c}`") for c in keep))
    schema = StructType([*own.schema.fields[1:], StructField(name, DoubleType())])
    return own.mapInArrow(_score(model.features, model.weights, model.bias, name), schema)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    Only the text is an input of the score, the whole of it, however long. Null texts count as empty; a null
    doc_id is never held out and never learned from; repeated rows are kept; other
    columns are not looked at; an empty table gives an empty table.
    """
    model = learn(docs, labels, id_col, text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = score(own, model, keep=["doc_id"])
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
