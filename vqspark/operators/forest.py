"""Groups of codes that agree in some sub-spaces, and forests over them."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.functions import codes as C
from vqspark.lineage import cut
from vqspark.operators.codebook import Codebook, sdc_table
from vqspark.operators.scan import Best, _delta_distances, in_blocks, query_rows, top_k
from vqspark.operators.tree import _key, largest_group_chains

#: Codes that a shard of a forest should have.
SHARD = 100_000
#: Queries whose distances to all codes of a shard a task holds at once.
AT_ONCE = 64


def masked(codes: DataFrame, m: int, differ: list[int]) -> DataFrame:
    """``(vec_id, differ, comb, key)``: the code at each choice of sub-spaces (the set bits of ``comb``), ``differ`` of them left out."""
    combs = [sum(1 << p for p in at) for d in differ for at in combinations(range(m), m - d)]
    rows = codes.select("vec_id", "code", F.explode(F.array(*map(F.lit, combs))).alias("comb"))
    key = F.transform("code", lambda c, i: F.when(F.getbit("comb", i) == 1, c).otherwise(-1))
    return rows.select("vec_id", (m - F.bit_count("comb")).alias("differ"), "comb", key.alias("key"))


def groups(codes: DataFrame, m: int, differ: list[int]) -> DataFrame:
    """``(differ, comb, key, size, first)`` of groups of two or more codes."""
    return masked(codes, m, differ).groupBy("differ", "comb", "key").agg(F.count("*").alias("size"), F.min("vec_id").alias("first")).where("size > 1")


def group_sizes(codes: DataFrame, m: int, differ: list[int], book: Codebook | None = None) -> DataFrame:
    """``(differ, magnitude, groups, codes)``: groups by the rounded decimal logarithm of their size.

    With a ``book`` also ``distance``: the sum of the centroid distances between the members of a group and its first one
    (divided by ``codes - groups`` it is the average over the edges).
    """
    own = groups(codes, m, differ).withColumn("magnitude", F.round(F.log10("size")).cast("int"))
    counts = own.groupBy("differ", "magnitude").agg(F.count("*").alias("groups"), F.sum("size").alias("codes"))
    if book is None:
        return counts
    heads = own.join(codes.select(F.col("vec_id").alias("first"), F.col("code").alias("head")), "first").select("differ", "comb", "key", "magnitude", "first", "head")
    edges = masked(codes, m, differ).join(heads, ["differ", "comb", "key"]).where("vec_id <> first").join(codes.select("vec_id", "code"), "vec_id")
    table = book.pairs()
    flat = F.array(*(F.array(*(F.array(*(F.lit(x.item()) for x in row)) for row in own)) for own in table)) if table.size <= 4096 else None
    if flat is not None:
        terms = F.transform(F.arrays_zip(F.col("head").alias("a"), F.col("code").alias("b")), lambda p, i: F.get(F.get(F.get(flat, i), p["a"]), p["b"]))
        zero = F.lit(0).cast("bigint" if book.config.domain == "int" else "double")
        distances = edges.groupBy("differ", "magnitude").agg(F.sum(F.aggregate(terms, zero, lambda s, x: s + x)).alias("distance"))
    else:
        cells = edges.select("differ", "magnitude", F.posexplode(F.arrays_zip(F.col("head").alias("a"), F.col("code").alias("b"))).alias("m", "p")).select("differ", "magnitude", "m", "p.a", "p.b")
        distances = cells.join(sdc_table(codes.sparkSession, book), ["m", "a", "b"]).groupBy("differ", "magnitude").agg(F.sum("d").alias("distance"))
    return counts.join(distances, ["differ", "magnitude"])


def near_pairs(codes: DataFrame, m: int, differ: int) -> DataFrame:
    """``(a, b, differ)`` of pairs of codes, a < b, that differ in at most ``differ`` sub-spaces; by equal masked keys."""
    own = masked(codes.select("vec_id", "code"), m, [differ]).join(codes.select("vec_id", "code"), "vec_id")
    a = own.select("comb", "key", F.col("vec_id").alias("a"), F.col("code").alias("ca"))
    b = own.select("comb", "key", F.col("vec_id").alias("b"), F.col("code").alias("cb"))
    met = a.join(b, ["comb", "key"]).where("a < b").select("a", "b", C.hamming(F.col("ca"), F.col("cb")).alias("differ"))
    return met.distinct()


def star_forest(codes: DataFrame, m: int) -> DataFrame:
    """``(parent_id, vec_id, differ)``: each code hangs on the smallest id below its own with which it shares most.

    By ascending number of differing sub-spaces, those that have no parent yet
    meet the smallest member of their groups; the last step, where all codes are
    one group, needs its smallest id only. So there are no cycles and no bound on
    the height.
    """
    codes = codes.select("vec_id", "code")
    least = codes.agg(F.min("vec_id")).first()[0]
    left, out = cut(codes.where(F.col("vec_id") > F.lit(least))), []
    for differ in range(m):
        if left.isEmpty():
            break
        firsts = masked(codes, m, [differ]).groupBy("comb", "key").agg(F.min("vec_id").alias("first"), F.count("*").alias("size")).where("size > 1")
        met = masked(left, m, [differ]).join(firsts, ["comb", "key"]).where("first < vec_id").groupBy("vec_id").agg(F.min("first").alias("parent_id"))
        met = cut(met)
        out.append(met.select("parent_id", "vec_id", F.lit(differ).alias("differ")))
        left = cut(left.join(met.select("vec_id"), "vec_id", "left_anti"))
    rest = left.select(F.lit(least).cast("long").alias("parent_id"), "vec_id", F.lit(m).alias("differ"))
    for part in out:
        rest = rest.union(part)
    return rest


# ---------------------------------------------------------------- closest pairs
def closest_of_group(ids: np.ndarray, second: np.ndarray, code: np.ndarray, pairs: list[np.ndarray]) -> tuple[float, int, int]:
    """``(distance, a, b)`` of the closest two members of a group, by the threshold algorithm.

    ``code[n, free]`` are the distinct values in the free sub-spaces, ``ids`` and
    ``second`` the smallest and second id (-1: none) that have each. Pairs of
    centroids of all free sub-spaces are looked at in step, by ascending distance;
    their members are paired up and their whole distance taken. No pair that was
    not seen yet is nearer than the distances of this step together.
    """
    twice = np.nonzero(second >= 0)[0]
    if len(twice):
        at = twice[np.lexsort((second[twice], ids[twice]))[0]]
        return 0, int(ids[at]), int(second[at])
    free = range(code.shape[1])
    present = [np.unique(code[:, j]) for j in free]
    lists = []
    for j in free:
        a, b = np.triu_indices(len(present[j]))
        a, b = present[j][a], present[j][b]
        d = pairs[j][a, b]
        order = np.argsort(d, kind="stable")
        lists.append((d[order], a[order], b[order]))
    members = [{c: np.nonzero(code[:, j] == c)[0] for c in present[j].tolist()} for j in free]
    best = (np.inf, -1, -1)
    for step in range(max(len(x[0]) for x in lists)):
        threshold = 0
        for j in free:
            d, a, b = lists[j]
            if step >= len(d):
                threshold = np.inf  # this sub-space has seen all pairs
                continue
            threshold = threshold + d[step]
            x, y = members[j][int(a[step])], members[j][int(b[step])]
            for at in range(0, len(x), 256):
                own = x[at : at + 256]
                total = sum(pairs[i][code[own, i][:, None], code[y, i][None]] for i in free).astype(float)
                total[own[:, None] == y[None]] = np.inf
                low = total.min(initial=np.inf)
                if low <= best[0] and low < np.inf:
                    p, q = np.nonzero(total == low)
                    first, last = np.minimum(ids[own[p]], ids[y[q]]), np.maximum(ids[own[p]], ids[y[q]])
                    k = np.lexsort((last, first))[0]
                    best = min(best, (low, int(first[k]), int(last[k])))
        if best[0] < threshold:
            break
    return best


def closest_pairs(codes: DataFrame, book: Codebook, differ: int) -> DataFrame:
    """``(comb, key, a, b, dist)``: of each group that agrees outside ``differ`` sub-spaces the two codes with the nearest centroids.

    Equal codes are folded first, so a group has at most K ** differ members.
    Ties go to the smaller ids.
    """
    m = book.config.m
    kind = "bigint" if book.config.domain == "int" else "double"
    shared = codes.sparkSession.sparkContext.broadcast(book.pairs())
    least = F.min("vec_id")
    folded = cut(codes.groupBy("code").agg(least.alias("vec_id"), F.count("*").alias("n")))
    twice = codes.join(folded.where("n > 1").select("code", F.col("vec_id").alias("low")), "code").where("vec_id > low").groupBy("code").agg(least.alias("second"))
    folded = cut(folded.join(twice, "code", "left").select("vec_id", F.coalesce("second", F.lit(-1).cast("long")).alias("second"), "code"))
    rows = masked(folded, m, [differ]).select("vec_id", "comb", "key").join(folded, "vec_id")
    sizes = rows.groupBy("comb", "key").agg(F.count("*").alias("n"), F.max("second").alias("more")).where("n > 1 or more >= 0").select("comb", "key")
    rows = rows.join(sizes, ["comb", "key"])

    def run(table: pa.Table) -> pa.Table:
        comb = table.column("comb")[0].as_py()
        free = [i for i in range(m) if not comb >> i & 1]
        code = table.column("code").combine_chunks().flatten().to_numpy().reshape(-1, m)[:, free]
        found = closest_of_group(table.column("vec_id").to_numpy(), table.column("second").to_numpy(), code, [shared.value[i] for i in free])
        return pa.table({"comb": table.column("comb").slice(0, 1), "key": table.column("key").slice(0, 1), "a": [found[1]], "b": [found[2]], "dist": pa.array([int(found[0]) if kind == "bigint" else float(found[0])], pa.int64() if kind == "bigint" else pa.float64())})

    return rows.groupBy("comb", "key").applyInArrow(run, f"comb int, key array<int>, a long, b long, dist {kind}")


def edges(codes: DataFrame, book: Codebook, strategy: str, differ: int = 1) -> DataFrame:
    """Edges ``(parent_id, vec_id)`` between codes that agree outside ``differ`` sub-spaces.

    ``"pairs"``: all of them, by the smaller id; ``"star"``: each with the first
    member of its largest common part; ``"chain"``: neighbours by id in the
    largest group; ``"closest"``: the nearest two of each group; ``"spanning"``: a
    minimum spanning forest.
    """
    m = book.config.m
    if strategy == "pairs":
        return near_pairs(codes, m, differ).select(F.col("a").alias("parent_id"), F.col("b").alias("vec_id"))
    if strategy == "star":
        return star_forest(codes, m).where(F.col("differ") <= differ).select("parent_id", "vec_id")
    if strategy == "chain":
        return largest_group_chains(codes, m, differ)
    if strategy == "closest":
        return closest_pairs(codes, book, differ).select(F.col("a").alias("parent_id"), F.col("b").alias("vec_id")).distinct()
    if strategy == "spanning":
        return spanning_forest(codes, m).where("parent_id is not null").select("parent_id", "vec_id")
    raise ValueError("the strategy is pairs, star, chain, closest or spanning")


# ---------------------------------------------------------------- spanning forests
class _Sets:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def tops(self) -> np.ndarray:
        """The top of each one's tree."""
        while True:
            up = self.up[self.up]
            if (up == self.up).all():
                return up
            self.up = up

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def spanning_edges(code: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges ``(a, b, differ)`` of a minimum spanning tree under the number of differing sub-spaces.

    In a group each member is linked to the first; weights come in ascending order.
    """
    n, m = code.shape
    sets, edges = _Sets(n), []
    for differ in range(m + 1):
        for at in combinations(range(m), m - differ):
            key = _key(code, at)
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.concatenate([[True], key[1:] != key[:-1]]) if n else np.empty(0, bool)
            head = order[np.maximum.accumulate(np.where(starts, np.arange(n), 0))] if n else order
            a, b = head[~starts], order[~starts]
            top = sets.tops()
            apart = np.nonzero(top[a] != top[b])[0]
            _, once = np.unique(np.minimum(top[a], top[b])[apart] * n + np.maximum(top[a], top[b])[apart], return_index=True)
            for i in apart[np.sort(once)].tolist():  # one candidate for each two trees that it would join
                if sets.join(int(a[i]), int(b[i])):
                    edges.append((int(a[i]), int(b[i]), differ))
            if len(edges) == n - 1:
                return edges
    return edges


def strips(codes: DataFrame, m: int, parts: int) -> DataFrame:
    """``(strip, vec_id, code)``: codes cut into ``parts`` runs of sub-spaces."""
    size = -(-m // parts)
    cut = F.explode(F.array(*(F.struct(F.lit(p).alias("strip"), F.slice("code", p * size + 1, size).alias("code")) for p in range(parts))))
    return codes.select("vec_id", cut.alias("x")).select("x.strip", "vec_id", "x.code")


def spanning_forest(codes: DataFrame, m: int, parts: int = 1, shards: int | None = None) -> DataFrame:
    """``(strip, shard, parent_id, vec_id, depth, code, diffs)``: a minimum spanning tree of the codes of each strip and shard, by breadth from the smallest id.

    ``shards``: how many, dealt by a hash of the id; by default as many as keep a shard at about 100,000 codes.
    """
    if shards is None:
        shards = max(1, -(-codes.count() // SHARD))
    own = strips(codes, m, parts).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        ids = table.column("vec_id").to_numpy()
        code = np.array(table.column("code").to_pylist()).reshape(len(ids), -1)
        beside: list[list[int]] = [[] for _ in ids]
        for a, b, _ in spanning_edges(code):
            beside[a].append(b)
            beside[b].append(a)
        parent, depth, order = np.full(len(ids), -1), np.zeros(len(ids), np.int32), []
        seen = np.zeros(len(ids), bool)
        for root in range(len(ids)):
            todo = [] if seen[root] else [root]
            seen[root] = True
            for x in todo:
                order.append(x)
                for y in sorted(beside[x]):
                    if not seen[y]:
                        seen[y], parent[y], depth[y] = True, x, depth[x] + 1
                        todo.append(y)
        order = np.array(order, np.int64)
        up = parent[order]
        diffs = [[{"m": int(k), "from_cid": int(code[p, k]), "to_cid": int(code[x, k])} for k in np.nonzero(code[x] != code[p])[0]] if p >= 0 else [] for x, p in zip(order, up)]
        return pa.table(
            {
                "strip": table.column("strip"),
                "shard": table.column("shard"),
                "parent_id": pa.array(ids[np.maximum(up, 0)], mask=up < 0),
                "vec_id": pa.array(ids[order]),
                "depth": pa.array(depth[order]),
                "code": pa.array(code[order].tolist(), pa.list_(pa.int32())),
                "diffs": pa.array(diffs, pa.list_(pa.struct([("m", pa.int32()), ("from_cid", pa.int32()), ("to_cid", pa.int32())]))),
            }
        )

    schema = "strip int, shard int, parent_id long, vec_id long, depth int, code array<int>, diffs array<struct<m:int,from_cid:int,to_cid:int>>"
    return own.groupBy("strip", "shard").applyInArrow(run, schema)


def forest_scan(forest: DataFrame, book: Codebook, queries: DataFrame, parts: int, k: int = 1) -> DataFrame:
    """``(query_id, rank, vec_id, dist)``: the k nearest codes by sums of differences down the trees of all strips.

    The strips of a shard hold the same ids, so one task has all distances of
    its codes: those of a level are their parents' and what the changed ids add,
    and strips are added up by id. A task returns its k best of each query.
    """
    c = book.config
    size = -(-c.m // parts)
    kind = "bigint" if c.domain == "int" else "double"
    rows = forest.groupBy("shard").agg(F.collect_list(F.struct("strip", "depth", "vec_id", "parent_id", "code")).alias("nodes"))

    def unpack(batch):
        nodes = batch.column(1)
        for i in range(batch.num_rows):
            table = pa.Table.from_struct_array(nodes.slice(i, 1).flatten()).sort_by([("strip", "ascending"), ("depth", "ascending"), ("vec_id", "ascending")])
            strip = table.column("strip").to_numpy()
            trees, ids = [], None
            for p in np.unique(strip):
                own = table.slice(int(np.searchsorted(strip, p)), int((strip == p).sum()))
                vec = own.column("vec_id").to_numpy()
                code = own.column("code").combine_chunks().flatten().to_numpy().reshape(len(vec), -1).astype(np.int64)
                by_id = np.argsort(vec)
                above = own.column("parent_id").fill_null(int(vec[0])).to_numpy()
                parent = by_id[np.searchsorted(vec[by_id], above)]
                trees.append((int(p), code, parent, own.column("depth").to_numpy(), by_id))
                ids = vec[by_id]
            yield trees, ids

    def add(best, unit, table):
        trees, ids = unit
        for at in range(0, table.shape[2], AT_ONCE):
            some = table[:, :, at : at + AT_ONCE]
            dist = 0
            for p, code, parent, depth, by_id in trees:
                dist = dist + _delta_distances(code, parent, depth, code != code[parent], some[p * size : p * size + code.shape[1]])[by_id]
            best[at // AT_ONCE].add(dist.T, ids)

    class Bests(list):
        def batch(self):
            return pa.concat_batches([b.batch() for b in self])

    def start(ids):
        return Bests(Best(ids[at : at + AT_ONCE], k, np.int64 if kind == "bigint" else np.float64) for at in range(0, len(ids), AT_ONCE))

    schema = f"query_id long, vec_id long, dist {kind}"
    out = in_blocks(rows, query_rows(queries, c), c, unpack, add, start, schema, lambda ids, q: np.ascontiguousarray(book.distances(q).transpose(1, 2, 0)))
    return top_k(forest.sparkSession.createDataFrame([], schema) if out is None else out, k)
