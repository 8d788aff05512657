"""Text and binary files of codebooks, codes and results, for exchange with other tools."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.config import PQConfig
from vqspark.operators.codebook import Codebook


# ---------------------------------------------------------------- codebook
def codebook_text(book: Codebook) -> str:
    """A line ``M,K,Ds``; then for each sub-space ``m:`` and K lines of numbers that end in a comma."""
    m, k, sub = book.centroids.shape
    lines = [f"{m},{k},{sub}"]
    for i, own in enumerate(book.centroids):
        lines.append(f"{i}:")
        lines += ["".join(f"{x!r}," for x in c.tolist()) for c in own]
    return "\n".join(lines) + "\n"


def parse_codebook(text: str, domain: str = "float") -> Codebook:
    lines = text.split("\n")
    m, k, sub = map(int, lines[0].split(","))
    kind = np.int64 if domain == "int" else np.float64
    own = np.empty((m, k, sub), kind)
    for i in range(m):
        at = 1 + i * (k + 1)
        if lines[at].strip() != f"{i}:":
            raise ValueError(f"sub-space {i} doesn't begin at line {at + 1}")
        own[i] = [[float(x) for x in line.rstrip().rstrip(",").split(",")] for line in lines[at + 1 : at + 1 + k]]
    return Codebook(own, PQConfig(m=m, k=k, dim=m * sub, domain=domain))


# ---------------------------------------------------------------- codes
def codes_bytes(codes: np.ndarray, k: int, with_id: bool = False) -> bytes:
    """A 64-bit count; then for each code M ids of one byte (two for K > 256), and with ``with_id`` its 32-bit number."""
    if with_id and k > 256:
        raise ValueError("codes with numbers have ids of one byte")
    body = np.ascontiguousarray(codes.astype("<u2" if k > 256 else np.uint8)).view(np.uint8).reshape(len(codes), -1)
    if with_id:
        body = np.concatenate([body, np.arange(len(codes), dtype="<u4")[:, None].view(np.uint8)], axis=1)
    return np.array([len(codes)], "<i8").tobytes() + body.tobytes()


def parse_codes(data: bytes, m: int, k: int, with_id: bool = False) -> np.ndarray:
    n = int(np.frombuffer(data[:8], "<i8")[0])
    width = m * (2 if k > 256 else 1) + 4 * with_id
    body = np.frombuffer(data[8:], np.uint8)
    if len(body) != n * width:
        raise ValueError("the file isn't as long as its header says")
    body = np.ascontiguousarray(body.reshape(n, width)[:, : width - 4 * with_id])
    return body.view("<u2" if k > 256 else np.uint8).astype(np.int32)


def zcodes_bytes(zcodes: np.ndarray, m: int) -> bytes:
    """Count and number of sub-spaces in 32 bits each; then 64 bits for each interleaved code."""
    return np.array([len(zcodes), m], "<i4").tobytes() + np.asarray(zcodes, "<i8").tobytes()


def parse_zcodes(data: bytes) -> tuple[np.ndarray, int]:
    n, m = np.frombuffer(data[:8], "<i4")
    return np.frombuffer(data[8:], "<i8", count=n), int(m)


def edges_bytes(root: int, edges: np.ndarray) -> bytes:
    """The root, then parent and child of each edge, in 32 bits each."""
    return np.array([root], "<u4").tobytes() + np.asarray(edges, "<u4").tobytes()


def parse_edges(data: bytes) -> tuple[int, np.ndarray]:
    own = np.frombuffer(data, "<u4")
    return int(own[0]), own[1:].reshape(-1, 2)


# ---------------------------------------------------------------- results
def write_results(results: DataFrame, path: str) -> None:
    """Lines ``id,dist,id,dist,...,`` in order of rank, one for each query, as a folder of text; results only, without a header.

    A line is a query's list, so it's written by Spark; ``results_text`` has the
    header for small ones.
    """
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "dist"))), lambda x: F.concat(x["vec_id"].cast("string"), F.lit(","), x["dist"].cast("string"), F.lit(",")))
    lines = results.groupBy("query_id").agg(F.array_join(pairs, "").alias("line"))
    lines.orderBy("query_id").select("line").write.mode("overwrite").text(path)


def results_text(results: DataFrame) -> str:
    """A line ``queries,k``, then the lines of ``write_results``; of few results, brought to the driver."""
    rows = results.orderBy("query_id", "rank").collect()
    by: dict[int, list[str]] = {}
    for r in rows:
        by.setdefault(r["query_id"], []).append(f"{r['vec_id']},{r['dist']},")
    most = max(map(len, by.values()), default=0)
    return "\n".join([f"{len(by)},{most}", *("".join(v) for v in by.values())]) + "\n"


def parse_results(spark: SparkSession, text: str, queries: list[int] | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, dist)``; queries are numbered from 0 unless their ids are given."""
    head, *lines = text.rstrip("\n").split("\n")
    n = int(head.split(",")[0])
    rows = []
    for q, line in enumerate(lines[:n]):
        parts = line.rstrip(",").split(",") if line else []
        rows += [(queries[q] if queries else q, i // 2 + 1, int(parts[i]), float(parts[i + 1])) for i in range(0, len(parts), 2)]
    return spark.createDataFrame(rows, "query_id long, rank int, vec_id long, dist double")


def scores_text(results: DataFrame, k: int) -> str:
    """Number of queries and k on lines of their own, then a line of results for each query."""
    lines = results_text(results.where(F.col("rank") <= k)).split("\n")
    return "\n".join([lines[0].split(",")[0], str(k), *lines[1:]])
