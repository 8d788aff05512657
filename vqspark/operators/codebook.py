"""Codebooks: sampled, trained by Lloyd rounds or by Spark ML, and their distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.config import PQConfig
from vqspark.functions import vectors as V

#: Most training rows that seeding looks at on the driver.
SEED_ROWS = 10_000


class Codebook:
    """Centroids ``[M, K, Ds]``. At most a few MB by its settings, so it is sent to all tasks."""

    def __init__(self, centroids: np.ndarray, config: PQConfig):
        self.centroids, self.config = centroids, config

    def table(self, spark: SparkSession) -> DataFrame:
        """``(m, k, centroid)``."""
        kind = "bigint" if self.config.domain == "int" else "double"
        rows = [(m, k, c.tolist()) for m, own in enumerate(self.centroids) for k, c in enumerate(own)]
        return spark.createDataFrame(rows, f"m int, k int, centroid array<{kind}>")

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances ``[n, M, K]`` of padded vectors to the centroids of each sub-space."""
        parts = vectors.reshape(len(vectors), self.config.m, 1, self.config.sub)
        if self.config.domain == "int":
            return ((parts - self.centroids[None]) ** 2).sum(-1)
        parts = parts[:, :, 0]
        cross = np.einsum("nmd,mkd->nmk", parts, self.centroids, optimize=True)
        return (parts**2).sum(-1)[..., None] - 2 * cross + (self.centroids**2).sum(-1)[None]

    def pairs(self) -> np.ndarray:
        """Squared distances ``[M, K, K]`` between centroids."""
        return ((self.centroids[:, :, None] - self.centroids[:, None]) ** 2).sum(-1)


def prepared(vectors: DataFrame, config: PQConfig, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, v)``: vectors in the domain, padded. Rows without an id or a whole vector of the right length are left out."""
    whole = F.col(id_col).isNotNull() & (F.size(vector_col) == config.dim) & F.forall(vector_col, lambda x: x.isNotNull())
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), V.pad(V.in_domain(F.col(vector_col), config), config).alias("v"))


def matrix(column: pa.ListArray, config: PQConfig) -> np.ndarray:
    kind = np.int64 if config.domain == "int" else np.float64
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), config.padded)


def sampled(vectors: DataFrame, config: PQConfig) -> Codebook:
    """Centroid k of each sub-space is that part of the vector with id k."""
    rows = prepared(vectors, config).where(F.col("vec_id") < config.k).sort("vec_id").collect()
    kind = np.int64 if config.domain == "int" else np.float64
    own = np.array([r["v"] for r in rows], kind).reshape(len(rows), config.m, config.sub)
    return Codebook(np.ascontiguousarray(own.transpose(1, 0, 2)), config)


def _seeded(vectors: DataFrame, config: PQConfig) -> np.ndarray:
    """k-means++ on a bounded sample, chosen by a hash of the id."""
    rows = prepared(vectors, config).orderBy(F.xxhash64("vec_id", F.lit(config.seed)), "vec_id").limit(SEED_ROWS).collect()
    parts = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), config.m, config.sub)
    rng = np.random.default_rng(config.seed)
    out = np.empty((config.m, config.k, config.sub))
    for m in range(config.m):
        x = parts[:, m]
        out[m, 0] = x[rng.integers(len(x))]
        gap = ((x - out[m, 0]) ** 2).sum(1)
        for k in range(1, config.k):
            total = gap.sum()
            out[m, k] = x[rng.choice(len(x), p=gap / total)] if total > 0 else x[rng.integers(len(x))]
            gap = np.minimum(gap, ((x - out[m, k]) ** 2).sum(1))
    return out


def _partial_sums(book):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Codebook = book.value
        c = own.config
        sums, counts, loss = np.zeros((c.m, c.k, c.sub)), np.zeros((c.m, c.k)), np.zeros((c.m, c.k))
        for batch in batches:
            x = matrix(batch.column(0), c)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096]
                d = own.distances(part)
                cid = d.argmin(-1)
                near = np.take_along_axis(d, cid[..., None], -1)[..., 0]
                for m in range(c.m):
                    np.add.at(sums[m], cid[:, m], part[:, m * c.sub : (m + 1) * c.sub])
                    counts[m] += np.bincount(cid[:, m], minlength=c.k)
                    loss[m] += np.bincount(cid[:, m], near[:, m], c.k)
        m, k = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(m.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(sums[m, k].tolist(), pa.list_(pa.float64())), pa.array(counts[m, k].astype(np.int64)), pa.array(loss[m, k])],
            names=["m", "k", "total", "n", "loss"],
        )

    return run


def lloyd_round(vectors: DataFrame, book: Codebook) -> tuple[Codebook, float]:
    """One round for all sub-spaces in one job, and the distortion before it.

    A task sends at most M * K partial sums; empty centroids stay where they are.
    In the int domain means are rounded down.
    """
    c = book.config
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    parts = prepared(vectors, c).select("v").mapInArrow(_partial_sums(shared), "m int, k int, total array<double>, n long, loss double")
    sums = [F.sum(F.col("total")[i]).alias(f"x{i}") for i in range(c.sub)]
    rows = parts.groupBy("m", "k").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"), *sums).collect()
    centroids = book.centroids.copy()
    for r in rows:
        mean = np.array([r[f"x{i}"] for i in range(c.sub)]) / r["n"]
        centroids[r["m"], r["k"]] = np.floor(mean) if c.domain == "int" else mean
    return Codebook(centroids, c), sum(r["loss"] for r in rows)


def fit_lloyd(vectors: DataFrame, config: PQConfig, tolerance: float = 1e-6) -> tuple[Codebook, list[float]]:
    """k-means in every sub-space: seeded, then rounds until the distortion settles. Also the distortion of each round."""
    book, losses = Codebook(_seeded(vectors, config), config), []
    if config.domain == "int":
        book = Codebook(np.floor(book.centroids).astype(np.int64), config)
    for _ in range(config.iterations):
        new, loss = lloyd_round(vectors, book)
        losses.append(loss)
        if len(losses) > 1 and losses[-2] - loss <= tolerance * losses[-2]:
            break
        book = new
    return book, losses


def fit_ml(vectors: DataFrame, config: PQConfig) -> Codebook:
    """The same by Spark ML's KMeans, a model for each sub-space."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    parts = prepared(vectors, config).select(V.split(F.col("v"), config).alias("parts")).persist()
    centers = []
    for m in range(config.m):
        own = parts.select(array_to_vector(F.col("parts")[m].cast("array<double>")).alias("features"))
        found = np.array(KMeans(k=config.k, seed=config.seed, maxIter=config.iterations).fit(own).clusterCenters())
        centers.append(np.concatenate([found, np.repeat(found[:1], config.k - len(found), axis=0)]))
    parts.unpersist()
    return Codebook(np.array(centers), config)


def distortion(vectors: DataFrame, book: Codebook) -> float:
    """Sum over vectors and sub-spaces of the squared distance to the nearest centroid."""
    return lloyd_round(vectors, book)[1]


def relocated(book: Codebook) -> tuple[Codebook, np.ndarray]:
    """Centroids renumbered so that those with a common bit prefix are near, and the old number of each new one.

    Each half of a range of numbers gets one side of a two-way split along the
    direction in which the range spreads most, cut at the median.
    """
    def halve(points: np.ndarray, own: np.ndarray) -> list[int]:
        if len(own) < 2:
            return own.tolist()
        x = points[own] - points[own].mean(axis=0)
        side = x @ np.linalg.svd(x.astype(np.float64), full_matrices=False)[2][0]
        order = own[np.lexsort((own, np.round(side, 9)))]
        cut = 1 << (len(own) - 1).bit_length() - 1
        return halve(points, order[:cut]) + halve(points, order[cut:])

    old = np.array([halve(own, np.arange(len(own))) for own in book.centroids])
    return Codebook(np.take_along_axis(book.centroids, old[..., None], 1), book.config), old


def sdc_table(spark: SparkSession, book: Codebook) -> DataFrame:
    """``(m, a, b, d)``: squared distances between the centroids of a sub-space, by a self-join on m."""
    own = book.table(spark)
    a, b = own.select("m", F.col("k").alias("a"), F.col("centroid").alias("ca")), own.select("m", F.col("k").alias("b"), F.col("centroid").alias("cb"))
    kind = "bigint" if book.config.domain == "int" else "double"
    return a.join(b, "m").select("m", "a", "b", V.squared_l2(F.col("ca"), F.col("cb"), kind).alias("d"))
