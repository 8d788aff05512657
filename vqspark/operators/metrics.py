"""Quality of results ``(query_id, rank, vec_id, dist)`` against exact ones of the same form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.functions import codes as C
from vqspark.functions import vectors as V
from vqspark.operators.codebook import prepared


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(k, recall)``: shared ids among the first k of both, over all queries of the truth times k."""
    met = results.where(F.col("rank") <= k).join(truth.where(F.col("rank") <= k).select("query_id", "vec_id"), ["query_id", "vec_id"])
    queries = truth.agg(F.countDistinct("query_id").alias("queries"))
    return met.agg(F.count("*").alias("met")).join(F.broadcast(queries)).select(F.lit(k).alias("k"), (F.col("met") / (F.col("queries") * k)).alias("recall"))


def mean_average_precision(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """``(k, map)``: the mean over queries and k' up to k of the shared ids among the first k', over k'."""
    other = truth.where(F.col("rank") <= k).select("query_id", "vec_id", F.col("rank").alias("other"))
    met = results.where(F.col("rank") <= k).join(other, ["query_id", "vec_id"])
    since = met.select("query_id", F.greatest("rank", "other").alias("since"))
    # an id shared from place s on counts 1/s + ... + 1/k
    gain = F.aggregate(F.sequence("since", F.lit(k)), F.lit(0.0), lambda s, x: s + F.lit(1.0) / x)
    queries = truth.agg(F.countDistinct("query_id").alias("queries"))
    total = since.agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("gain"))
    return total.join(F.broadcast(queries)).select(F.lit(k).alias("k"), (F.col("gain") / (F.col("queries") * k)).alias("map"))


def distance_ratios(results: DataFrame, truth: DataFrame) -> DataFrame:
    """``(avg_ratio, max_ratio)`` of the exact to the approximate distance (not squared) at the same rank."""
    other = truth.select("query_id", "rank", F.col("dist").alias("exact"))
    own = results.where("dist > 0").join(other, ["query_id", "rank"]).select(F.sqrt(F.col("exact") / F.col("dist")).alias("ratio"))
    return own.agg(F.avg("ratio").alias("avg_ratio"), F.max("ratio").alias("max_ratio"))


def reranked(results: DataFrame, vectors: DataFrame, queries: DataFrame, config) -> DataFrame:
    """Results with the exact squared distance as ``exact``."""
    base = prepared(vectors, config).withColumnRenamed("v", "base")
    own = prepared(queries, config, queries.columns[0], queries.columns[1]).select(F.col("vec_id").alias("query_id"), F.col("v").alias("query"))
    kind = "bigint" if config.domain == "int" else "double"
    return results.join(base, "vec_id").join(own, "query_id").select("query_id", "rank", "vec_id", "dist", V.squared_l2(F.col("base"), F.col("query"), kind).alias("exact"))


def epsilon_recall(exact: DataFrame, truth: DataFrame, k: int, epsilon: float = 0.1) -> DataFrame:
    """``(eps_recall, dist_recall, worst_ratio)``: how many results lie within (1 + epsilon) times, or once, the true k-th distance; the mean over queries of the worst result's ratio to it (where it isn't zero)."""
    last = truth.where(F.col("rank") == k).select("query_id", F.sqrt("dist").alias("last"))
    own = exact.where(F.col("rank") <= k).join(last, "query_id").withColumn("d", F.sqrt("exact"))
    per = own.groupBy("query_id").agg(F.avg((F.col("d") <= F.col("last") * (1 + epsilon)).cast("int")).alias("eps"), F.avg((F.col("d") <= F.col("last")).cast("int")).alias("near"), F.max(F.when(F.col("last") > 0, F.col("d") / F.col("last"))).alias("worst"))
    return per.agg(F.avg("eps").alias("eps_recall"), F.avg("near").alias("dist_recall"), F.avg("worst").alias("worst_ratio"))


def hamming_histogram(nearest: DataFrame, codes: DataFrame) -> DataFrame:
    """``(differ, n)``: in how many sub-spaces a query's code differs from that of its nearest other code."""
    own = codes.select(F.col("vec_id").alias("query_id"), F.col("code").alias("own"))
    return nearest.where("rank = 1").join(codes.select("vec_id", "code"), "vec_id").join(own, "query_id").groupBy(C.hamming(F.col("own"), F.col("code")).alias("differ")).agg(F.count("*").alias("n"))
