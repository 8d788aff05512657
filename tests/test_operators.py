"""Codes, trees, formats, metrics and sources on small and odd inputs."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqspark import cli, lineage, sql
from vqspark.config import PQConfig
from vqspark.operators import blocks, bounds, codebook, diffindex, encode, forest, metrics, scan, tree, update
from vqspark.sources import text, vecs
from vqspark.streaming.append import append_vectors


def frame(spark, codes):
    return spark.createDataFrame([(i, list(map(int, c))) for i, c in enumerate(codes)], "vec_id long, code array<int>")


def book_of(m, k, sub=1, seed=0):
    rng = np.random.default_rng(seed)
    return codebook.Codebook(rng.integers(0, 200, (m, k, sub)), PQConfig(m=m, k=k, dim=m * sub, domain="int"))


SHAPES = [(0, 4, 4), (1, 8, 4), (2, 8, 4), (7, 4, 3), (64, 8, 2), (201, 8, 16), (300, 4, 256)]


def random_codes(n, m, k, seed=1):
    return np.random.default_rng(seed).integers(0, k, (n, m))


def order_of(code, **how):
    ids = np.arange(len(code))
    built = tree.build(ids, code, **how)
    order, depth, _, size = tree.layout(ids, code, built, None)
    changed = code[order] != code[np.maximum(built.parent[order], 0)]
    changed[:1] = False
    return built, order, depth, size, changed


@pytest.mark.parametrize("n,m,k", SHAPES)
@pytest.mark.parametrize("rule", ["height", "first"])
def test_tree_is_a_tree_and_packs_without_loss(n, m, k, rule):
    for code in (random_codes(n, m, k), np.repeat(random_codes(1, m, k), n, axis=0)):
        built, order, depth, size, changed = order_of(code, rule=rule)
        assert sorted(order.tolist()) == list(range(n))
        if not n:
            continue
        assert (built.parent < 0).sum() == 1 and size[built.root] == n
        assert depth.max() <= max(1, m - 1)
        for pack, form in ((blocks.pack_bytes, "bytes"), (blocks.pack_bits, "bits")):
            payload = pack(code[order], depth[order], changed)
            back, parent, deep, _ = blocks.unpack_tree(payload, form, n, m)
            assert (back == code[order]).all() and (deep == depth[order]).all()
        assert len(blocks.pack_bytes(code[order], depth[order], changed)) == m + changed.sum() + (3 * (n - 1) + 1) // 2
        rows = np.random.default_rng(2).integers(0, 256, (n, 12)).astype(np.uint8)
        payload = blocks.pack_bytes(code[order], depth[order], changed, rows)
        assert (blocks.unpack_tree(payload, "rows", n, m, 12)[0] == code[order]).all() and (blocks.unpack_rows(payload, n, m, 12) == rows).all()
        assert (blocks.parents_of(depth[order]) == np.where(built.parent[order] < 0, -1, np.argsort(order)[built.parent[order]])).all()
        for how in ("center", "rotate"):
            assert (tree.recentred(built, how).parent < 0).sum() == 1


def test_hand_worked_tree():
    code = np.array([[1, 1, 1, 1], [1, 1, 1, 1], [1, 1, 1, 2], [3, 1, 1, 2], [7, 8, 9, 9]])
    built, *_ , changed = order_of(code)
    assert built.root == 0 and built.finalists == 2
    assert built.parent.tolist() == [-1, 0, 0, 0, 3] and changed.sum() == 7
    assert sum((code[i] != code[i - 1]).sum() for i in range(1, 5)) == 6


@pytest.mark.parametrize("n,m,k", SHAPES)
def test_sequential_differences(n, m, k):
    code = random_codes(n, m, k)
    for wide in (False, True):
        back, _ = blocks.unpack_sequential(blocks.pack_sequential(code, wide), n, m, wide)
        assert (back == code).all()


def test_packed_formats_refuse_what_they_cannot_hold():
    with pytest.raises(ValueError):
        blocks.pack_bytes(random_codes(5, 9, 4), np.zeros(5, int), np.zeros((5, 9), bool))
    with pytest.raises(ValueError):
        blocks.pack_sequential(np.full((3, 4), 300), False)
    with pytest.raises(ValueError):
        vecs.read_vectors(None, "x.csv")
    with pytest.raises(ValueError):
        PQConfig(domain="x")


def test_spanning_tree_weight():
    code = random_codes(60, 5, 3)
    edges = forest.spanning_edges(code)
    up = list(range(60))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    weight = 0
    for d, a, b in sorted((int((code[a] != code[b]).sum()), a, b) for a in range(60) for b in range(a)):
        if find(a) != find(b):
            up[find(a)] = find(b)
            weight += d
    assert sum(d for *_, d in edges) == weight and len(edges) == 59


def test_scans_agree_with_many_ids(spark):
    """K above a byte, dimensions that don't divide, k above n, and a repeated vector."""
    config = PQConfig(m=4, k=300, dim=10, domain="int")
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=10) * 0.3).tolist()) for i in range(330)] + [(330, [0.1] * 10), (331, [0.1] * 10)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id % 60 = 0").withColumnRenamed("vec_id", "query_id")
    book = codebook.sampled(vectors, config)
    codes = encode.encode(vectors, book)
    want = sorted(map(tuple, scan.plain_scan(codes, book, queries, 400).collect()))
    assert len(want) == 6 * 332
    packed = diffindex.pack_index(codes.repartition(3), 4, rows=100, wide=True)
    assert sorted(map(tuple, scan.diff_scan(packed, book, queries, 400).collect())) == want
    few = sorted(map(tuple, scan.plain_scan(codes.repartition(7), book, queries, 5).collect()))
    assert few == [r for r in want if r[1] <= 5]
    levels = tree.decode_by_levels(tree.delta_table(codes, book, shards=1), 4)
    assert sorted(map(str, levels.collect())) == sorted(map(str, codes.collect()))


def test_query_blocks_give_the_same(spark, monkeypatch):
    config = PQConfig(m=4, k=8, dim=8, domain="float")
    rng = np.random.default_rng(5)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(90)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 20").withColumnRenamed("vec_id", "query_id")
    want = scan.exact_knn(vectors, queries, config, 3).collect()
    monkeypatch.setattr(scan, "QUERY_BLOCK", 7)
    assert sorted(map(str, scan.exact_knn(vectors, queries, config, 3).collect())) == sorted(map(str, want))
    assert scan.exact_knn(vectors, queries.limit(0), config, 3).count() == 0
    assert scan.exact_knn(vectors.limit(0), queries, config, 3).count() == 0


def test_query_groups_and_k_that_is_large(spark, monkeypatch):
    """Several groups of queries, tables that aren't kept, ties, and more asked for than there is."""
    rng = np.random.default_rng(8)
    config = PQConfig(m=4, k=6, dim=8, domain="int")
    vectors = spark.createDataFrame([(i, (rng.integers(-2, 3, 8) * 0.2).tolist()) for i in range(150)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 40").withColumnRenamed("vec_id", "query_id")
    book = codebook.sampled(vectors, config)
    codes = encode.encode(vectors, book)
    own = {r.vec_id: r.code for r in codes.collect()}
    tables = book.distances(np.array([r.v for r in codebook.prepared(vectors, config).sort("vec_id").collect()]))
    dist = {q: sorted((int(sum(tables[q, m, c[m]] for m in range(4))), v) for v, c in own.items()) for q in range(40)}
    for name, value in (("QUERY_BLOCK", 7), ("QUERY_GROUP", 14), ("TABLE_BYTES", 100)):
        monkeypatch.setattr(scan, name, value)
    for k in (3, 200):
        want = sorted((q, rank, v, d) for q in dist for rank, (d, v) in enumerate(dist[q][:k], 1))
        assert sorted(map(tuple, scan.plain_scan(codes.repartition(5), book, queries, k).collect())) == want
        near, _ = codebook.relocated(book)
        index = bounds.bound_index(encode.encode(vectors, near), 4, 3, blocks=3)
        for how in ({"levels": [1]}, {"levels": [3], "by_bound": False}, {}):
            assert sorted(map(tuple, bounds.bound_search(index, near, queries, 3, k, **how).collect())) == want
    ends = {r.query_id: (r.least, r.most, r.total, r.n) for r in scan.distance_range(codes, book, queries).collect()}
    assert ends == {q: (x[0][0], x[-1][0], sum(d for d, _ in x), 150) for q, x in dist.items()}
    assert ends == {r.query_id: (r.least, r.most, r.total, r.n) for r in scan.running_range(diffindex.pack_index(codes, 4, rows=40), book, queries).collect()}
    found = scan.code_scan(codes, book, codes.where("vec_id < 9").withColumnRenamed("vec_id", "query_id"), 1, alone=True).collect()
    pairs = book.pairs()
    for r in found:
        assert (r.dist, r.vec_id) == min((int(sum(pairs[m][own[r.query_id][m], c[m]] for m in range(4))), v) for v, c in own.items() if v != r.query_id)


def test_closest_pairs_against_all(spark):
    book = book_of(5, 6, 2)
    for code in (random_codes(90, 5, 6), random_codes(60, 5, 2)):
        pairs = book.pairs()
        found = forest.closest_pairs(frame(spark, code), book, 3).collect()
        best = {}
        for a in range(len(code)):
            for b in range(a + 1, len(code)):
                d = int(sum(pairs[m][code[a, m], code[b, m]] for m in range(5)))
                for at in combinations(range(5), 2):
                    if (code[a, at] == code[b, at]).all():
                        key = (sum(1 << p for p in at), tuple(int(code[a, p]) if p in at else -1 for p in range(5)))
                        best[key] = min(best.get(key, (d, a, b)), (d, a, b))
        assert {(r.comb, tuple(r.key)): (r.dist, r.a, r.b) for r in found} == best


def test_edge_strategies(spark):
    book, code = book_of(4, 3), random_codes(40, 4, 3)
    codes = frame(spark, code)
    near = {(a, b) for a in range(40) for b in range(a + 1, 40) if (code[a] != code[b]).sum() <= 1}
    found = {s: {(r.parent_id, r.vec_id) for r in forest.edges(codes, book, s, 1).collect()} for s in ("pairs", "star", "chain", "closest", "spanning")}
    assert found["pairs"] == near and found["star"] <= near and found["chain"] <= near and found["closest"] <= near and len(found["spanning"]) == 39
    with pytest.raises(ValueError):
        forest.edges(codes, book, "other")


def test_forest_scan_over_strips_and_shards(spark):
    config = PQConfig(m=4, k=8, dim=8, domain="int")
    rng = np.random.default_rng(12)
    vectors = spark.createDataFrame([(3 * i, (rng.normal(size=8) * 0.3).tolist()) for i in range(120)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 250").withColumnRenamed("vec_id", "query_id")
    book = codebook.sampled(vectors.withColumn("vec_id", F.expr("vec_id div 3")), config)
    codes = encode.encode(vectors, book)
    want = sorted(map(tuple, scan.plain_scan(codes, book, queries, 4).collect()))
    for parts, shards in ((1, 1), (2, 3), (4, 2)):
        own = forest.spanning_forest(codes, 4, parts, shards)
        assert sorted(map(tuple, forest.forest_scan(own, book, queries, parts, 4).collect())) == want


def test_vectors_without_a_code(spark):
    config = PQConfig(m=2, k=2, dim=4, domain="int")
    rows = [(0, [0.1, 0.2, 0.3, 0.4]), (1, [0.0] * 4), (2, None), (3, [0.1, None, 0.2, 0.3]), (4, [0.5]), (None, [0.1] * 4), (5, [])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    book = codebook.sampled(vectors, config)
    codes = encode.encode(vectors, book)
    assert sorted(r.vec_id for r in codes.collect()) == [0, 1]
    assert scan.exact_knn(vectors, vectors.withColumnRenamed("vec_id", "query_id"), config, 3).count() == 4


def test_running_totals(spark, monkeypatch):
    monkeypatch.setattr(lineage, "FAN", 7)
    rows = spark.range(400).select("id", (F.col("id") * 13 % 31).alias("v"))
    found = {r.id: r.total for r in lineage.running_total(rows, "id", "v").collect()}
    total = 0
    for i in range(400):
        total += i * 13 % 31
        assert found[i] == total


def test_tables_are_made_once(spark, tmp_path):
    path = str(tmp_path / "t")
    assert lineage.stored(spark, path, lambda: spark.range(3).toDF("x")).count() == 3
    assert lineage.stored(spark, path, lambda: 1 / 0).count() == 3
    lineage.remove(spark, path)
    assert lineage.stored(spark, path, lambda: spark.range(5).toDF("x")).count() == 5


def test_training_by_spark_ml(spark):
    config = PQConfig(m=2, k=4, dim=6, iterations=5)
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(120)], "vec_id long, embedding array<float>")
    book = codebook.fit_ml(vectors, config)
    assert book.centroids.shape == (2, 4, 3)
    assert codebook.distortion(vectors, book) < codebook.distortion(vectors, codebook.sampled(vectors, config))


def test_training_lowers_the_distortion(spark):
    config = PQConfig(m=4, k=8, dim=16, iterations=6)
    rng = np.random.default_rng(7)
    vectors = spark.createDataFrame([(i, rng.normal(size=16).tolist()) for i in range(400)], "vec_id long, embedding array<float>")
    book, losses = codebook.fit_lloyd(vectors, config)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:]))
    assert codebook.distortion(vectors, book) < codebook.distortion(vectors, codebook.sampled(vectors, config))
    near, old = codebook.relocated(book)
    assert codebook.distortion(vectors, near) == pytest.approx(codebook.distortion(vectors, book))
    assert (np.sort(old, axis=1) == np.arange(8)).all()


def test_metrics_by_hand(spark):
    found = spark.createDataFrame([(0, r, v, float(r)) for r, v in enumerate([1, 2, 3], 1)], "query_id long, rank int, vec_id long, dist double")
    truth = spark.createDataFrame([(0, r, v, float(r)) for r, v in enumerate([2, 1, 4], 1)], "query_id long, rank int, vec_id long, dist double")
    assert metrics.recall(found, truth, 3).first()["recall"] == pytest.approx(2 / 3)
    assert metrics.mean_average_precision(found, truth, 3).first()["map"] == pytest.approx(5 / 9)
    assert metrics.recall(truth, truth, 3).first()["recall"] == 1
    assert metrics.distance_ratios(truth, truth).first()["max_ratio"] == 1


@pytest.mark.parametrize("kind", ["fvecs", "bvecs"])
def test_vector_files(spark, tmp_path, kind, monkeypatch):
    vecs.register(spark)
    rows = [(i, [float((i * 7 + j) % 256) for j in range(6)]) for i in range(50)]
    spark.createDataFrame(rows, vecs.SCHEMA).coalesce(1).write.format(kind).mode("append").save(str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.format(kind).load(str(tmp_path / "out")).collect())) == rows
    single = next((tmp_path / "out").glob(f"*.{kind}"))
    assert vecs.read_vectors(spark, str(single), top=9).count() == 9
    assert vecs.from_binary_files(spark, str(single), kind).count() == 50
    assert sorted(map(tuple, vecs.read_vectors(spark, f"file://{single}").collect())) == rows
    assert vecs.read_vectors(spark, f"file://{single}", top=9).count() == 9
    monkeypatch.setattr(vecs, "RANGE_BYTES", 40)
    ranges = vecs._Reader(kind, {"path": str(single)})
    parts = [b for p in ranges.partitions() for b in ranges.read(p)]
    assert len(parts) > 1 and [i for b in parts for i in b.column(0).to_pylist()] == list(range(50))
    with pytest.raises(ValueError):
        vecs.decode(single.read_bytes()[:-1], kind)


def test_text_and_binary_files(spark):
    book = book_of(3, 5, 2)
    assert (text.parse_codebook(text.codebook_text(book), "int").centroids == book.centroids).all()
    for k, with_id in ((16, False), (16, True), (300, False)):
        code = random_codes(9, 4, k)
        assert (text.parse_codes(text.codes_bytes(code, k, with_id), 4, k, with_id) == code).all()
    z, m = text.parse_zcodes(text.zcodes_bytes(np.array([5, 1 << 40]), 8))
    assert z.tolist() == [5, 1 << 40] and m == 8
    root, edges = text.parse_edges(text.edges_bytes(4, np.array([[4, 1], [1, 2]])))
    assert root == 4 and edges.tolist() == [[4, 1], [1, 2]]
    results = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 3, 1.5), (1, 1, 2, 0.0)], "query_id long, rank int, vec_id long, dist double")
    assert sorted(map(tuple, text.parse_results(spark, text.results_text(results)).collect())) == sorted(map(tuple, results.collect()))
    assert text.scores_text(results, 1).split("\n")[:2] == ["2", "1"]


def test_walk_changes_one_id(spark):
    own = [r.code for r in update.random_walk(spark, 200, 4, 9).orderBy("vec_id").collect()]
    assert all(sum(a != b for a, b in zip(x, y)) == 1 for x, y in zip(own, own[1:]))


def test_stream_appends(spark, tmp_path):
    config = PQConfig(m=4, k=4, dim=8, domain="int")
    rng = np.random.default_rng(9)
    vectors = spark.createDataFrame([(i, (rng.normal(size=8) * 0.2).tolist()) for i in range(40)], vecs.SCHEMA)
    book = codebook.sampled(vectors, config)
    path = str(tmp_path / "delta")
    tree.delta_table(encode.encode(vectors.where("vec_id < 30"), book), book, shards=1).write.parquet(path)
    vectors.where("vec_id >= 25").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(vectors.schema).parquet(str(tmp_path / "in"))
    append_vectors(stream, book, path, str(tmp_path / "state"), availableNow=True).awaitTermination()
    packed = blocks.pack_delta(spark.read.parquet(path), 4)
    codes = encode.encode(vectors, book)
    assert sorted(map(str, blocks.decode_trees(packed, 4).collect())) == sorted(map(str, codes.collect()))


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("SELECT vq_quantize(array(0D, -1D)) AS q, vq_squared_l2(array(1D, 2D), array(3D, 2D)) AS d, vq_hamming(array(1, 2), array(1, 3)) AS h").first()
    assert (row.q, row.d, row.h) == ([127, 0], 4.0, 1)
    code = random_codes(5, 4, 3)
    _, order, depth, _, changed = order_of(code)
    payload = blocks.pack_bytes(code[order], depth[order], changed)
    spark.createDataFrame([(payload, order.tolist())], "payload binary, vec_ids array<long>").createOrReplaceTempView("packed")
    found = spark.sql("SELECT d.* FROM packed, LATERAL vq_decode_block(payload, 'bytes', vec_ids, 4) d").collect()
    assert {r.vec_id: r.code for r in found} == dict(enumerate(code.tolist()))


def test_command_line(spark, tmp_path, capsys):
    path = lambda x: str(tmp_path / x)
    rng = np.random.default_rng(11)
    vectors = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(60)], vecs.SCHEMA)
    vectors.write.parquet(path("v.parquet"))
    vectors.where(F.col("vec_id") < 5).write.parquet(path("q.parquet"))
    run = lambda *a: cli.main(list(a), spark)
    run("learn", "--vectors", path("v.parquet"), "--codebook", path("b.txt"), "-m", "4", "-k", "8")
    run("encode", "--vectors", path("v.parquet"), "--codebook", path("b.txt"), "--out", path("c"))
    for form in ("bytes", "sequential"):
        run("build", "--codes", path("c"), "--codebook", path("b.txt"), "--out", path(form), "--format", form)
        run("query", "--index", path(form), "--codebook", path("b.txt"), "--queries", path("q.parquet"), "--out", path(form + "f"))
    run("truth", "--vectors", path("v.parquet"), "--queries", path("q.parquet"), "--out", path("t"))
    run("evaluate", "--found", path("bytesf"), "--truth", path("t"))
    run("cost", "--codes", path("c"), "--codebook", path("b.txt"))
    run("build", "--codes", path("c"), "--codebook", path("b.txt"), "--out", path("t1"), "--delta", path("d"))
    run("build", "--codes", path("c"), "--codebook", path("b.txt"), "--out", path("t2"), "--delta", path("d"), "--format", "bits")
    run("combine", "--codes", path("c"), "--others-codes", path("c"), "-n", "60", "--n-others", "7", "--out", path("c2"))
    assert spark.read.parquet(path("c2")).count() == 67
    spark.read.parquet(path("c2")).where("vec_id >= 60").write.parquet(path("c3"))
    run("update", "--delta", path("d"), "--codes", path("c3"), "--codebook", path("b.txt"), "--out", path("t3"))
    run("query", "--index", path("t3"), "--codebook", path("b.txt"), "--queries", path("q.parquet"), "--out", path("t3f"), "--memory", "--top", "100")
    assert spark.read.parquet(path("t3f")).count() == 5 * 67
    run("query", "--index", path("t1"), "--codebook", path("b.txt"), "--queries", path("q.parquet"), "--out", path("t1f"), "--first", "20", "--top", "100")
    assert spark.read.parquet(path("t1f")).count() == 5 * 20
    assert "recall@10" in capsys.readouterr().out
    one, two = ([(r.query_id, r.rank, round(r.dist, 9)) for r in spark.read.parquet(path(f)).orderBy("query_id", "rank").collect()] for f in ("bytesf", "sequentialf"))
    assert one == two


@pytest.mark.parametrize("fan", [lineage.FAN, 3])
def test_differences_go_on_over_shards(spark, monkeypatch, fan):
    """One sequence, whatever ids a task takes: shards of 4 ids, some of them missing, against the definition."""
    monkeypatch.setattr(lineage, "FAN", fan)
    code = np.repeat(random_codes(40, 8, 3), 2, axis=0)
    ids = [i if i < 50 else i + 1000 for i in range(len(code))]
    codes = spark.createDataFrame([(v, c.tolist()) for v, c in zip(ids, code)], "vec_id long, code array<int>")
    index = diffindex.diff_index(codes.repartition(5), 8, rows=4)
    changed = np.vstack([np.ones((1, 8), bool), code[1:] != code[:-1]])
    found = {r.vec_id: (r.mask, r.cids) for r in index.collect()}
    assert found == {v: (int((x << np.arange(8)).sum()), c[x].tolist()) for v, c, x in zip(ids, code, changed)}
    n = int(changed[1:].sum())
    assert [tuple(r) for r in diffindex.index_bytes(index, 8).collect()] == [(80, n, 8 + 16 + n + 79)]
    assert {r.vec_id: r.code for r in diffindex.decode_index(index, 8).collect()} == {v: c.tolist() for v, c in zip(ids, code)}
    assert [tuple(r) for r in diffindex.index_bytes(diffindex.diff_index(codes.limit(0), 8), 8).collect()] == [(0, None, None)]
