"""Command line: learn, encode, combine, build, update, query, truth, evaluate, cost. Tables are Parquet; vectors also .fvecs and .bvecs.

    python -m vqspark.cli learn --vectors base.parquet --codebook book.txt -m 8 -k 256
    python -m vqspark.cli encode --vectors base.parquet --codebook book.txt --out codes
    python -m vqspark.cli combine --codes codes --others-codes more -n 1000 --n-others 500 --out both
    python -m vqspark.cli build --codes codes --codebook book.txt --out tree [--rule first] [--height 1] [--format bits]
    python -m vqspark.cli update --delta delta --codes new --codebook book.txt --out tree
    python -m vqspark.cli query --index tree --codebook book.txt --queries query.fvecs --top 10 --out found [--first 1000] [--memory]
    python -m vqspark.cli truth --vectors base.parquet --queries query.fvecs --top 10 --out truth
    python -m vqspark.cli evaluate --found found --truth truth --top 10
    python -m vqspark.cli cost --codes codes --codebook book.txt
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vqspark.config import PQConfig
from vqspark.lineage import stored
from vqspark.operators import blocks, codebook, diffindex, encode, metrics, scan, tree, update
from vqspark.sources import text, vecs


def _vectors(spark: SparkSession, path: str, top: int) -> DataFrame:
    if path.rsplit(".", 1)[-1] in vecs.KINDS:
        return vecs.read_vectors(spark, path, top=top)
    return vecs.take_first(spark.read.parquet(path).select("vec_id", "embedding"), top)


def _dimension(vectors: DataFrame) -> int:
    return len(vectors.first()["embedding"])


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("task", choices=["learn", "encode", "combine", "build", "update", "query", "truth", "evaluate", "cost"])
    for name in ("vectors", "codes", "others-codes", "codebook", "index", "delta", "queries", "found", "truth", "out"):
        p.add_argument(f"--{name}")
    p.add_argument("-m", type=int, default=8)
    p.add_argument("-k", type=int, default=256)
    p.add_argument("-n", type=int, default=-1, help="use the first n vectors only")
    p.add_argument("--top", type=int, default=10)
    p.add_argument("--height", type=int, default=1)
    p.add_argument("--rule", choices=["height", "first"], default="height")
    p.add_argument("--format", choices=["bytes", "bits", "sequential"], default="bytes")
    p.add_argument("--shards", type=int)
    p.add_argument("--n-others", type=int, default=-1, help="combine: the first n of the other codes only")
    p.add_argument("--first", type=int, help="query: the first n codes of each block only")
    p.add_argument("--memory", action="store_true", help="query: keep the index in memory")
    p.add_argument("--others", action="store_true", help="leave a query's own id out")
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("vqspark").getOrCreate()
    book = text.parse_codebook(Path(a.codebook).read_text()) if a.codebook and a.task != "learn" else None
    if a.task == "learn":
        vectors = _vectors(spark, a.vectors, a.n)
        own, losses = codebook.fit_lloyd(vectors, PQConfig(m=a.m, k=a.k, dim=_dimension(vectors)))
        Path(a.codebook).write_text(text.codebook_text(own))
        print(f"distortion {losses[-1]:.6g} after {len(losses)} rounds")
    elif a.task == "encode":
        vectors = _vectors(spark, a.vectors, a.n)
        own = codebook.Codebook(book.centroids, PQConfig(m=book.config.m, k=book.config.k, dim=_dimension(vectors)))
        encode.encode(vectors, own).write.mode("overwrite").parquet(a.out)
    elif a.task == "combine":
        one, two = spark.read.parquet(a.codes), spark.read.parquet(a.others_codes)
        sizes = [n if n >= 0 else (t.agg(F.max("vec_id")).first()[0] or -1) + 1 for t, n in ((one, a.n), (two, a.n_others))]
        encode.combine(one, two, *sizes).write.mode("overwrite").parquet(a.out)
    elif a.task == "update":
        delta, codes = spark.read.parquet(a.delta), spark.read.parquet(a.codes)
        more = update.as_root_children(codes, delta)
        blocks.pack_delta(delta.unionByName(more), book.config.m, a.format).write.mode("overwrite").parquet(a.out)
        print(f"inserted {codes.count()}, bytes {(more.agg(F.sum(4 + 4 * F.size('diffs') + 1)).first()[0] or 0) / 4:g}")
    elif a.task == "build":
        codes = spark.read.parquet(a.codes)
        if a.format == "sequential":
            packed = diffindex.pack_index(codes, book.config.m, wide=book.config.k > 256)
        else:
            delta = tree.delta_table(codes, book, a.height, a.rule, a.shards)
            if a.delta:  # made once, and used again where it is there
                delta = stored(spark, a.delta, lambda: tree.delta_table(codes, book, a.height, a.rule, a.shards))
            packed = blocks.pack_delta(delta, book.config.m, a.format)
        packed.write.mode("overwrite").parquet(a.out)
    elif a.task == "query":
        queries = _vectors(spark, a.queries, a.n).withColumnRenamed("vec_id", "query_id")
        own = codebook.Codebook(book.centroids, PQConfig(m=book.config.m, k=book.config.k, dim=_dimension(queries.withColumnRenamed("query_id", "vec_id"))))
        index = spark.read.parquet(a.index)
        index = index.persist() if a.memory else index
        run = scan.plain_scan if "code" in index.columns else scan.diff_scan if "wide" in index.columns else scan.tree_scan
        part = {"first": a.first} if a.first is not None and run is scan.tree_scan else {}
        run(index, own, queries, a.top, a.others, **part).write.mode("overwrite").parquet(a.out)
        index.unpersist()
    elif a.task == "truth":
        vectors = _vectors(spark, a.vectors, a.n)
        queries = _vectors(spark, a.queries, -1).withColumnRenamed("vec_id", "query_id")
        scan.exact_knn(vectors, queries, PQConfig(m=1, k=1, dim=_dimension(vectors)), a.top, a.others).write.mode("overwrite").parquet(a.out)
    elif a.task == "evaluate":
        found, truth = spark.read.parquet(a.found), spark.read.parquet(a.truth)
        r, p, d = metrics.recall(found, truth, a.top).first(), metrics.mean_average_precision(found, truth, a.top).first(), metrics.distance_ratios(found, truth).first()
        print(f"recall@{a.top} {r['recall']:.6f}, map {p['map']:.6f}, ratio mean {d['avg_ratio']:.6f}, greatest {d['max_ratio']:.6f}")
    else:
        delta = tree.delta_table(spark.read.parquet(a.codes), book, a.height, a.rule, a.shards)
        row = delta.groupBy("shard").agg(F.count("*").alias("n"), F.sum(F.size("diffs")).alias("d")).agg(F.sum("n"), F.sum("d"), F.count("*"), F.sum(8 + F.col("d") + F.floor((3 * (F.col("n") - 1) + 1) / 2) + 16)).first()
        print(f"codes {row[0]}, differences {row[1]}, shards {row[2]}, plain bytes {row[0] * book.config.m}, tree bytes {row[3]}")


if __name__ == "__main__":
    main()
