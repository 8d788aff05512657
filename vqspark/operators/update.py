"""Inserts: new codes become children of a tree's root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vqspark.functions import codes as C
from vqspark.lineage import cut


def as_root_children(codes: DataFrame, delta: DataFrame) -> DataFrame:
    """Rows of a delta table for new codes: each at depth 1 below the root of the shard that its id's hash picks, after all its rows."""
    heads = delta.groupBy("shard").agg(F.count("*").alias("n"), F.min_by(F.struct("vec_id", "code"), "pos").alias("root"))
    heads = cut(heads.select("shard", "n", F.col("root.vec_id").alias("parent_id"), F.col("root.code").alias("root")))
    numbers = F.array_sort(F.collect_list("shard"))
    shards = heads.agg(numbers.alias("shards")).first()["shards"]  # as many as shards
    if not shards:
        raise ValueError("there is no tree to insert into")
    at = F.element_at(F.array(*map(F.lit, shards)), (F.pmod(F.xxhash64("vec_id"), F.lit(len(shards))) + 1).cast("int"))
    own = codes.select("vec_id", "code", at.alias("shard")).join(heads, "shard")
    pos = F.col("n") + F.row_number().over(Window.partitionBy("shard").orderBy("vec_id")) - 1
    own = own.withColumn("diffs", C.diffs(F.col("root"), F.col("code"))).withColumn("pos", pos.cast("int"))
    return own.select("shard", "pos", "vec_id", "parent_id", F.lit(0).alias("parent_pos"), F.lit(1).alias("depth"), C.mask(F.col("diffs")).alias("mask"), "diffs", "code", F.lit(0.0).alias("max_dist"), F.lit(1).alias("subtree_size"))


def hashed_codes(spark: SparkSession, n: int, m: int, k: int, seed: int = 0) -> DataFrame:
    """``(vec_id, code)`` of n codes whose ids follow from a digest, the same in any engine."""
    def cid(i: int) -> Column:
        text = F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"), F.lit(f":{i}"))
        return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long") % k).cast("int")

    return spark.range(n).select(F.col("id").alias("vec_id"), F.array(*(cid(i) for i in range(m))).alias("code"))


def insert_cost(codes: DataFrame, root: Column) -> DataFrame:
    """``(vec_id, quarter_bytes)``: what each insert takes, in quarters of a byte: a bitmap, the changed ids, and a quarter for the depth."""
    return codes.select("vec_id", (4 + 4 * C.hamming(root, F.col("code")) + 1).cast("long").alias("quarter_bytes"))


def random_walk(spark: SparkSession, n: int, m: int, k: int, seed: int = 0, run: int = 4096) -> DataFrame:
    """``(vec_id, code)``: runs of codes of which each differs from the one before in one sub-space only."""
    steps = spark.range(n).select(F.col("id").alias("vec_id"), F.floor(F.col("id") / run).alias("run"))
    at = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(m)).cast("int")
    add = (F.pmod(F.xxhash64("vec_id", F.lit(seed + 1)), F.lit(max(1, k - 1))) + 1).cast("int")
    own = Window.partitionBy("run").orderBy("vec_id")
    begins = F.row_number().over(own) == 1
    moved = [F.sum(F.when(begins, F.pmod(F.xxhash64("run", F.lit(seed + 2 + i)), F.lit(k))).otherwise(F.when(F.col("at") == i, F.col("add")).otherwise(0))).over(own.rowsBetween(Window.unboundedPreceding, 0)) for i in range(m)]
    steps = steps.withColumns({"at": at, "add": add})
    return steps.select("vec_id", F.array(*((x % k).cast("int") for x in moved)).alias("code"))
