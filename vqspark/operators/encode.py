"""Vectors to codes and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.functions import codes as C
from vqspark.operators.codebook import Codebook, matrix, prepared


def code_matrix(column: pa.ListArray, m: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), m)


def encode(vectors: DataFrame, book: Codebook, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(vec_id, code)``: in each sub-space the nearest centroid, the lowest of equally near ones.

    Rows without an id, or whose vector is null, holds nulls or has another length than the codebook's, have no code.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            x = matrix(batch.column(1), own.config)
            cids = [own.distances(x[at : at + 4096]).argmin(-1) for at in range(0, len(x), 4096)]
            flat = np.concatenate(cids).astype(np.int32).reshape(-1) if cids else np.empty(0, np.int32)
            starts = np.arange(0, len(flat) + 1, own.config.m, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))], names=["vec_id", "code"])

    return prepared(vectors, book.config, id_col, vector_col).mapInArrow(run, "vec_id long, code array<int>")


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """``(vec_id, v)``: the centroids of a code, one after the other."""
    rows = codes.select("vec_id", F.posexplode("code").alias("m", "k"))
    own = F.broadcast(book.table(codes.sparkSession))  # M * K rows
    found = rows.join(own, ["m", "k"]).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("m", "centroid"))).alias("parts"))
    return found.select("vec_id", F.flatten(F.transform("parts", lambda p: p["centroid"])).alias("v"))


def renumbered(codes: DataFrame, old: np.ndarray) -> DataFrame:
    """Codes over a relocated codebook whose centroid k was ``old[m, k]``."""
    new = np.argsort(old, axis=1)
    table = F.array(*(F.array(*map(F.lit, row)) for row in new.tolist()))  # M * K numbers
    return codes.select("vec_id", F.transform("code", lambda c, i: F.get(F.get(table, i), c)).alias("code"))


def zcodes(codes: DataFrame, m: int, bits: int) -> DataFrame:
    """``(vec_id, zcode)`` of codes over a relocated codebook."""
    return codes.select("vec_id", C.zcode(F.col("code"), m, bits).alias("zcode"))


def combine(first: DataFrame, second: DataFrame, n_first: int, n_second: int) -> DataFrame:
    """The first ``n_first`` codes of one table, then the first ``n_second`` of another with ids moved behind them."""
    moved = second.where(F.col("vec_id") < n_second).withColumn("vec_id", F.col("vec_id") + n_first)
    return first.where(F.col("vec_id") < n_first).unionByName(moved)
