"""Queries over the ``embeddings`` table, one or more for each operator, in the int domain.

The base is all vectors, the queries are those whose id is divisible by 50.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.config import PQConfig
from vqspark.functions import codes as C
from vqspark.functions import vectors as V
from vqspark.lineage import running_total
from vqspark.operators import blocks, bounds, codebook, diffindex, encode, forest, metrics, scan, tree, update
from vqspark.sources.vecs import take_first

CONFIG = PQConfig(m=8, k=16, dim=64, domain="int")
K = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[run.__name__] = run
    return run


class Base:
    """What most queries begin with."""

    def __init__(self, spark: SparkSession, sf_dir: str, config: PQConfig = CONFIG):
        self.vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
        self.queries = self.vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
        self.config = config
        self.book = codebook.sampled(self.vectors, config)
        self.codes = encode.encode(self.vectors, self.book)

    def tree(self, rule: str = "height", form: str = "bytes") -> DataFrame:
        return blocks.pack_delta(tree.delta_table(self.codes, self.book, rule=rule), self.config.m, form)


def _cells(codes: DataFrame) -> DataFrame:
    return codes.select("vec_id", F.posexplode("code").alias("m", "cid"))


def _numbers(frame: DataFrame, *ids: str) -> DataFrame:
    return frame.select(*ids, F.posexplode("v").alias("i", "value"))


# ---------------------------------------------------------------- vectors and codebooks
@query
def exact_knn_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.exact_knn(b.vectors, b.queries, CONFIG, K)


@query
def exact_knn_others_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.exact_knn(b.vectors, b.queries, CONFIG, K, alone=True)


@query
def pad_split_subvectors(spark, sf_dir):
    config = PQConfig(m=6, k=16, dim=64, domain="int")
    own = codebook.prepared(Base(spark, sf_dir).vectors, config)
    parts = own.select("vec_id", F.posexplode(V.split(F.col("v"), config)).alias("m", "part"))
    return parts.select("vec_id", "m", F.size("part").alias("n"), F.aggregate("part", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query
def first_n_vectors(spark, sf_dir):
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return take_first(own, 100).select("vec_id", "label")


@query
def strided_sample(spark, sf_dir):
    b = Base(spark, sf_dir)
    return _numbers(encode.decode(b.codes.where(F.col("vec_id") % 7 == 0), b.book), "vec_id")


@query
def hash_order_sample(spark, sf_dir):
    own = Base(spark, sf_dir).vectors.select("vec_id")
    return own.orderBy(F.md5(F.col("vec_id").cast("string").cast("binary")), "vec_id").limit(50)


def _centroids(spark, book):
    return book.table(spark).select("m", "k", F.posexplode("centroid").alias("i", "value"))


@query
def codebook_sampled(spark, sf_dir):
    return _centroids(spark, Base(spark, sf_dir).book)


@query
def codebook_lloyd_round(spark, sf_dir):
    b = Base(spark, sf_dir)
    return _centroids(spark, codebook.lloyd_round(b.vectors, b.book)[0])


@query
def distortion(spark, sf_dir):
    b = Base(spark, sf_dir)
    return spark.createDataFrame([(int(codebook.distortion(b.vectors, b.book)),)], "distortion long")


@query
def sdc_table(spark, sf_dir):
    return codebook.sdc_table(spark, Base(spark, sf_dir).book)


@query
def adc_table(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.adc_table(b.queries, b.book)


# ---------------------------------------------------------------- codes
@query
def encode_codes(spark, sf_dir):
    return _cells(Base(spark, sf_dir).codes)


@query
def decode_reconstruct(spark, sf_dir):
    b = Base(spark, sf_dir)
    return _numbers(encode.decode(b.codes, b.book), "vec_id")


@query
def sdc_pair_distance(spark, sf_dir):
    b = Base(spark, sf_dir)
    a = b.codes.select("vec_id", F.col("code").alias("a"))
    z = b.codes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("code").alias("b"))
    pairs = a.join(z, "vec_id")
    cells = pairs.select("vec_id", F.posexplode(F.arrays_zip("a", "b")).alias("m", "x")).select("vec_id", "m", "x.a", "x.b")
    return cells.join(F.broadcast(codebook.sdc_table(spark, b.book)), ["m", "a", "b"]).groupBy("vec_id").agg(F.sum("d").alias("dist"))


@query
def code_differences(spark, sf_dir):
    own = Base(spark, sf_dir).codes
    z = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("code").alias("after"))
    changed = own.join(z, "vec_id").withColumn("diffs", C.diffs(F.col("code"), F.col("after")))
    return changed.select("vec_id", F.size("diffs").alias("n_diffs"), C.mask(F.col("diffs")).alias("mask"))


@query
def zorder_codes(spark, sf_dir):
    return encode.zcodes(Base(spark, sf_dir).codes, 8, 4)


@query
def zorder_decode(spark, sf_dir):
    z = encode.zcodes(Base(spark, sf_dir).codes, 8, 4)
    return _cells(z.select("vec_id", C.from_zcode(F.col("zcode"), 8, 4).alias("code")))


@query
def combine_codes(spark, sf_dir):
    own = Base(spark, sf_dir).codes
    return _cells(encode.combine(own, own, 100, 50))


# ---------------------------------------------------------------- plain scans
@query
def pq_scan_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.plain_scan(b.codes, b.book, b.queries, K)


@query
def pq_leave_one_out(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.plain_scan(b.codes, b.book, b.queries, 1, alone=True)


@query
def hamming_histogram(spark, sf_dir):
    b = Base(spark, sf_dir)
    own = b.codes.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "code")
    return metrics.hamming_histogram(scan.code_scan(b.codes, b.book, own, 1, alone=True), b.codes)


@query
def code_distance_range(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.distance_range(b.codes, b.book, b.queries).select("query_id", "least", "most")


@query
def stored_code_distance(spark, sf_dir):
    """The distance of each query to the stored code of the next id."""
    b = Base(spark, sf_dir)
    pairs = b.queries.select("query_id", (F.col("query_id") + 1).alias("vec_id"))
    return scan.pair_distances(pairs, b.codes, b.queries, b.book)


@query
def zorder_code_distance(spark, sf_dir):
    """The same for interleaved codes, taken apart first."""
    b = Base(spark, sf_dir)
    pairs = b.queries.select("query_id", (F.col("query_id") + 1).alias("vec_id"))
    z = encode.zcodes(b.codes, 8, 4)
    return scan.pair_distances(pairs, z.select("vec_id", C.from_zcode(F.col("zcode"), 8, 4).alias("code")), b.queries, b.book)


# ---------------------------------------------------------------- sequential differences
@query
def diff_index_rows(spark, sf_dir):
    return diffindex.diff_index(Base(spark, sf_dir).codes, 8).select("vec_id", "mask", F.size("cids").alias("n_cids"))


@query
def diff_index_size(spark, sf_dir):
    return diffindex.index_bytes(diffindex.diff_index(Base(spark, sf_dir).codes, 8), 8)


@query
def diff_index_decode(spark, sf_dir):
    return _cells(diffindex.decode_index(diffindex.diff_index(Base(spark, sf_dir).codes, 8), 8))


@query
def diff_scan_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.diff_scan(diffindex.pack_index(b.codes, 8, rows=128), b.book, b.queries, K)


@query
def diff_running_distance(spark, sf_dir):
    """What the running distances along the sequence amount to, for each query."""
    b = Base(spark, sf_dir)
    return scan.running_range(diffindex.pack_index(b.codes, 8, rows=128), b.book, b.queries)


# ---------------------------------------------------------------- delta trees
@query
def delta_tree_decode(spark, sf_dir):
    return _cells(blocks.decode_trees(Base(spark, sf_dir).tree(), 8))


@query
def delta_tree_decode_levels(spark, sf_dir):
    b = Base(spark, sf_dir)
    return _cells(tree.decode_by_levels(tree.delta_table(b.codes, b.book, shards=2), 8))


@query
def delta_scan_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.tree_scan(b.tree(), b.book, b.queries, K)


@query
def delta_scan_noheight_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.tree_scan(b.tree("first"), b.book, b.queries, K)


@query
def delta_scan_recentred_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    packed = blocks.pack_delta(tree.delta_table(b.codes, b.book, balance="center"), 8)
    return scan.tree_scan(packed, b.book, b.queries, K)


@query
def delta_bitpacked_scan_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    packed = blocks.pack_delta(tree.delta_table(b.codes, b.book, balance="center"), 8, "bits")
    return scan.tree_scan(packed, b.book, b.queries, K)


@query
def delta_sharded_scan_top10(spark, sf_dir):
    b = Base(spark, sf_dir)
    packed = blocks.pack_delta(tree.delta_table(b.codes, b.book, shards=4), 8)
    return scan.tree_scan(packed, b.book, b.queries, K)


@query
def batch_scan_top10(spark, sf_dir):
    """All vectors are queries, in one pass over the blocks, each unpacked once in memory."""
    b = Base(spark, sf_dir)
    return scan.tree_scan(b.tree(), b.book, b.vectors.withColumnRenamed("vec_id", "query_id"), K)


@query
def delta_rowstore_scan_top10(spark, sf_dir):
    """Over a tree that keeps each vector behind its code; the scan skips them."""
    b = Base(spark, sf_dir)
    packed = blocks.pack_delta(tree.delta_table(b.codes, b.book), 8, "rows", b.vectors)
    return scan.tree_scan(packed, b.book, b.queries, K)


@query
def rowstore_vectors(spark, sf_dir):
    b = Base(spark, sf_dir)
    packed = blocks.pack_delta(tree.delta_table(b.codes, b.book), 8, "rows", b.vectors)
    return blocks.stored_vectors(packed, 8).select("vec_id", F.posexplode("embedding").alias("i", "x")).select("vec_id", "i", F.col("x").cast("double").alias("x"))


@query
def delta_partial_scan(spark, sf_dir):
    b = Base(spark, sf_dir)
    return scan.tree_scan(b.tree(), b.book, b.queries, K, first=200)


@query
def tree_stats(spark, sf_dir):
    b = Base(spark, sf_dir)
    own = tree.stats(tree.delta_table(b.codes, b.book))
    return own.select("n_codes", "n_roots", "n_edges", (F.col("max_depth") <= 7).alias("depth_ok"))


@query
def tree_depth_histogram(spark, sf_dir):
    b = Base(spark, sf_dir)
    return tree.depth_histogram(tree.delta_table(b.codes, b.book))


@query
def tree_adjacency(spark, sf_dir):
    b = Base(spark, sf_dir)
    return tree.adjacency(tree.delta_table(b.codes, b.book)).select("parent_id", F.size("children").alias("n_children"))


@query
def tree_edge_diffs(spark, sf_dir):
    """Child and parent codes joined; whether the stored differences are theirs."""
    b = Base(spark, sf_dir)
    own = tree.delta_table(b.codes, b.book).where("parent_id is not null").select("vec_id", "parent_id", "diffs")
    child, parent = b.codes, b.codes.select(F.col("vec_id").alias("parent_id"), F.col("code").alias("above"))
    both = own.join(child, "vec_id").join(parent, "parent_id")
    return both.agg(F.count("*").alias("n_edges"), F.count(F.when(C.hamming(F.col("above"), F.col("code")) == F.size("diffs"), 1)).alias("n_agree"))


@query
def size_report(spark, sf_dir):
    packed = Base(spark, sf_dir).tree()
    n, d = F.col("n_codes"), F.col("n_diffs")
    sizes = [(8 + n * 8).alias("plain_bytes"), (F.length("payload") + 16).alias("packed_bytes"), (8 + d + F.floor((3 * (n - 1) + 1) / 2) + 16).alias("formula_bytes"), F.ceil((8 * d + 11 * n + 64) / 8 + 8).alias("bit_bytes")]
    return packed.select("n_codes", "n_diffs", "n_pages", *sizes)


# ---------------------------------------------------------------- groups and forests
@query
def clique_groups(spark, sf_dir):
    own = forest.groups(Base(spark, sf_dir).codes, 8, list(range(9)))
    return own.groupBy("differ").agg(F.count("*").alias("groups"), F.sum("size").alias("codes"), F.sum("first").alias("firsts"))


@query
def clique_size_histogram(spark, sf_dir):
    b = Base(spark, sf_dir)
    return forest.group_sizes(b.codes, 8, list(range(9)), b.book)


@query
def clique_chains(spark, sf_dir):
    return tree.largest_group_chains(Base(spark, sf_dir).codes, 8, 5)


@query
def closest_clique_pairs(spark, sf_dir):
    b = Base(spark, sf_dir)
    return forest.closest_pairs(b.codes, b.book, 5).select("comb", "a", "b", "dist")


@query
def near_code_pairs(spark, sf_dir):
    return forest.near_pairs(Base(spark, sf_dir).codes, 8, 3)


@query
def star_forest_edges(spark, sf_dir):
    return forest.star_forest(Base(spark, sf_dir).codes, 8)


@query
def mst_total_weight(spark, sf_dir):
    own = forest.spanning_forest(Base(spark, sf_dir).codes, 8)
    return own.agg(F.count("*").alias("n_codes"), F.count("parent_id").alias("n_edges"), F.sum(F.size("diffs")).alias("weight"))


@query
def mst_forest_scan_top1(spark, sf_dir):
    b = Base(spark, sf_dir)
    return forest.forest_scan(forest.spanning_forest(b.codes, 8, parts=2), b.book, b.queries, 2).drop("rank")


@query
def bound_search_top1(spark, sf_dir):
    b = Base(spark, sf_dir)
    near, old = codebook.relocated(b.book)
    index = bounds.bound_index(encode.renumbered(b.codes, old), 8, 4)
    return bounds.bound_search(index, near, b.queries, 4, levels=[2], by_bound=False).drop("rank")


@query
def bound_tree_top10(spark, sf_dir):
    """Down all levels, the last one by its bounds."""
    b = Base(spark, sf_dir)
    near, old = codebook.relocated(b.book)
    index = bounds.bound_index(encode.renumbered(b.codes, old), 8, 4, blocks=4)
    return bounds.bound_search(index, near, b.queries, 4, K)


# ---------------------------------------------------------------- quality
def _both(spark, sf_dir):
    b = Base(spark, sf_dir)
    return b, scan.plain_scan(b.codes, b.book, b.queries, K), scan.exact_knn(b.vectors, b.queries, CONFIG, K)


@query
def recall_at_k(spark, sf_dir):
    _, found, truth = _both(spark, sf_dir)
    own = [metrics.recall(found, truth, k).select("k", F.round("recall", 6).alias("recall")) for k in (1, 5, 10)]
    return own[0].union(own[1]).union(own[2])


@query
def map_at_k(spark, sf_dir):
    _, found, truth = _both(spark, sf_dir)
    return metrics.mean_average_precision(found, truth, K).select("k", F.round("map", 6).alias("map"))


@query
def ratio_stats(spark, sf_dir):
    _, found, truth = _both(spark, sf_dir)
    return metrics.distance_ratios(found, truth).select(F.round("avg_ratio", 6).alias("avg_ratio"), F.round("max_ratio", 6).alias("max_ratio"))


@query
def eps_recall(spark, sf_dir):
    b, found, truth = _both(spark, sf_dir)
    exact = metrics.reranked(found, b.vectors, b.queries, CONFIG)
    own = metrics.epsilon_recall(exact, truth, K)
    return own.select(*(F.round(c, 6).alias(c) for c in own.columns))


# ---------------------------------------------------------------- inserts
@query
def update_cost(spark, sf_dir):
    root = F.array(*(F.lit(0) for _ in range(8)))
    return update.insert_cost(update.hashed_codes(spark, 1000, 8, 16), root)


@query
def update_growth(spark, sf_dir):
    """The running size of inserts at each hundredth of them, in quarters of a byte."""
    own = update_cost(spark, sf_dir)
    run = running_total(own, "vec_id", "quarter_bytes").select("vec_id", "total")
    return run.where((F.col("vec_id") + 1) % 10 == 0)


@query
def appended_tree_scan(spark, sf_dir):
    """Trees over the first 300 vectors, the others inserted below their roots."""
    b = Base(spark, sf_dir)
    own = tree.delta_table(b.codes.where("vec_id < 300"), b.book, shards=2)
    more = update.as_root_children(b.codes.where("vec_id >= 300"), own)
    packed = blocks.pack_delta(own.unionByName(more), 8)
    return scan.tree_scan(packed, b.book, b.queries, K)
