"""Index building and scans timed apart: the index is built and kept in memory once, scans are the median of five warm runs.

Prints a Markdown table. BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 4), BENCH_COPIES (default 1: how often
the vectors are repeated, with a little noise, for a larger index).
"""

import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vqspark.config import PQConfig
from vqspark.operators import blocks, codebook, diffindex, encode, metrics, scan, tree


def timed(run):
    begin = time.perf_counter()
    out = run()
    return time.perf_counter() - begin, out


def kept(frame):
    frame = frame.persist()
    frame.count()
    return frame


def main() -> None:
    sf_dir, cpus, copies = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "4"), int(os.environ.get("BENCH_COPIES", "1"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    base = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    n = base.count()
    queries = base.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    if copies > 1:
        noise = lambda x, i: (x + 0.02 * (F.pmod(F.xxhash64("vec_id", "copy", i), F.lit(1000)) / 1000 - 0.5)).cast("float")
        base = base.crossJoin(F.broadcast(spark.range(copies).toDF("copy"))).select((F.col("vec_id") + n * F.col("copy")).alias("vec_id"), F.when(F.col("copy") == 0, F.col("embedding")).otherwise(F.transform("embedding", noise)).alias("embedding"))
    base = kept(base.repartition(int(cpus)))
    total = base.count()
    truth = kept(scan.exact_knn(base, queries, PQConfig(m=8, k=16, dim=64, domain="int"), 10))
    print(f"{total} vectors, {queries.count()} queries, top 10, local[{cpus}]\n")
    print("| K | codebook, encode, tree, pack s | plain, sequential, byte tree, bit tree ms a query | bytes: plain, sequential, byte tree, bit tree | recall@10, MAP, mean ratio |\n|-|-|-|-|-|")
    for k in (4, 16, 64):
        config = PQConfig(m=8, k=k, dim=64, domain="int")
        t_book, book = timed(lambda: codebook.sampled(base, config))
        t_codes, codes = timed(lambda: kept(encode.encode(base, book)))
        t_tree, delta = timed(lambda: kept(tree.delta_table(codes, book)))
        t_pack, packed = timed(lambda: kept(blocks.pack_delta(delta, 8)))
        bits = kept(blocks.pack_delta(tree.delta_table(codes, book, balance="center"), 8, "bits"))
        sequence = kept(diffindex.pack_index(codes, 8))
        runs = [lambda: scan.plain_scan(codes, book, queries, 10), lambda: scan.diff_scan(sequence, book, queries, 10), lambda: scan.tree_scan(packed, book, queries, 10), lambda: scan.tree_scan(bits, book, queries, 10)]
        times = []
        for run in runs:
            took = [timed(lambda: run().collect())[0] for _ in range(6)][1:]
            times.append(median(took) / queries.count() * 1000)
        sizes = [total * 8] + [f.agg(F.sum(F.length("payload"))).first()[0] for f in (sequence, packed, bits)]
        found = kept(runs[0]())
        quality = metrics.recall(found, truth, 10).first()["recall"], metrics.mean_average_precision(found, truth, 10).first()["map"], metrics.distance_ratios(found, truth).first()["avg_ratio"]
        print(f"| {k} | {t_book:.2f}, {t_codes:.2f}, {t_tree:.2f}, {t_pack:.2f} | {', '.join(f'{t:.2f}' for t in times)} | {', '.join(map(str, sizes))} | {', '.join(f'{q:.3f}' for q in quality)} |")
        spark.catalog.clearCache()
        base = kept(base)
    spark.stop()


if __name__ == "__main__":
    main()
