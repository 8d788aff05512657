"""Delta trees of bounded height: each code as what differs from its parent's.

For a growing number of differing sub-spaces, codes that agree in the others
form groups; a group hangs its members on one of them. Members leave, the parent
stays until its tree is as high as allowed; those that are done become children
of the first of them. Groups of one step are independent of each other, so each
step is a sort and array operations. A shard is built in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vqspark.operators.codebook import Codebook

#: Codes that a shard should have.
SHARD = 200_000
DELTA = "shard int, pos int, vec_id long, parent_id long, parent_pos int, depth int, mask long, diffs array<struct<m:int,from_cid:int,to_cid:int>>, code array<int>, max_dist double, subtree_size int"


@dataclass
class Tree:
    parent: np.ndarray
    root: int
    finalists: int


def _key(code: np.ndarray, at: tuple[int, ...]) -> np.ndarray:
    """Numbers that order codes by some sub-spaces, the last of these first."""
    if not at:
        return np.zeros(len(code), np.int64)
    bits = max(1, int(code.max(initial=0)).bit_length())
    if bits * len(at) <= 62:
        key = np.zeros(len(code), np.int64)
        for m in reversed(at):
            key = (key << bits) | code[:, m]
        return key
    return np.unique(code[:, list(reversed(at))], axis=0, return_inverse=True)[1].reshape(-1)


def build(ids: np.ndarray, code: np.ndarray, height: int = 1, rule: str = "height", sample: float = 1.0, seed: int = 0) -> Tree:
    """``rule``: the parent of a group is its ``"height"``-est member, or its ``"first"``. Ties go to the smaller id.

    With ``sample`` below one, that share of the combinations of each step is tried.
    """
    n, m = code.shape
    limit = m * height
    heights, parent = np.zeros(n, np.int64), np.full(n, -1)
    active = np.argsort(ids, kind="stable")
    finalists: list[int] = []
    rng = np.random.default_rng(seed)
    for differ in range(m + 1):
        if len(active) <= 1:
            break
        kept = np.ones(len(active), bool)
        tries = list(combinations(range(m), m - differ))
        if sample < 1 and differ < m:
            tries = [tries[i] for i in sorted(rng.choice(len(tries), max(1, int(sample * len(tries))), replace=False))]
        for at in tries:
            own = active[kept]
            if len(own) < 2:
                break
            place = np.nonzero(kept)[0]
            key = _key(code[own], at)
            first = np.lexsort((ids[own], -heights[own] if rule == "height" else np.zeros(len(own)), key))
            key = key[first]
            starts = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
            sizes = np.diff(np.append(starts, len(key)))
            starts, sizes = starts[sizes > 1], sizes[sizes > 1]
            if not len(starts):
                continue
            tops = own[first[starts]]
            best = heights[tops]
            if rule == "height":
                second = heights[own[first[starts + 1]]]
                done = best + 1 >= limit - 2
                heights[tops] = best + (second == best)
            else:
                group = np.repeat(np.arange(len(starts)), sizes - 1)
                rest = np.concatenate([np.arange(s + 1, s + c) for s, c in zip(starts, sizes)])
                tallest = np.zeros(len(starts), np.int64)
                np.maximum.at(tallest, group, heights[own[first[rest]]] + 1)
                heights[tops] = np.maximum(best, tallest)
                done = heights[tops] >= limit - 2
            members = np.concatenate([np.arange(s + 1, s + c) for s, c in zip(starts, sizes)])
            parent[own[first[members]]] = np.repeat(tops, sizes - 1)
            kept[place[first[members]]] = False
            kept[place[first[starts[done]]]] = False
            finalists += tops[done].tolist()
        active = active[kept]
    finalists += active.tolist()
    root = finalists[0] if finalists else -1
    parent[finalists[1:]] = root
    return Tree(parent, root, len(finalists))


def layout(ids: np.ndarray, code: np.ndarray, tree: Tree, pairs: np.ndarray | None):
    """Pre-order of the nodes, siblings by the greatest distance from below to the parent, descending, then by id.

    Returns ``(order, depth, max_dist, size)`` by node; ``size`` counts the node and all below it.
    """
    n, m = code.shape
    depth, most, beside, size = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, np.int64)
    below, node = np.arange(n), np.arange(n)
    above = tree.parent.copy()
    while (live := above >= 0).any():
        node, below, above = node[live], below[live], above[live]
        depth[node] += 1
        np.add.at(size, above, 1)
        if pairs is not None:
            d = sum(pairs[i][code[node, i], code[above, i]] for i in range(m))
            np.maximum.at(most, above, d)
            np.maximum.at(beside, below, d)
        below, above = above, tree.parent[above]
    order = np.lexsort((ids, -beside, tree.parent))
    until = np.cumsum(size[order])
    first = np.searchsorted(tree.parent[order], tree.parent[order])  # the first sibling of each
    before = np.empty(n, np.int64)  # nodes below elder siblings, these included
    before[order] = until - size[order] - (until - size[order])[first]
    place = np.zeros(n, np.int64)
    for d in range(1, depth.max(initial=0) + 1):
        at = np.nonzero(depth == d)[0]
        place[at] = place[tree.parent[at]] + 1 + before[at]
    return np.argsort(place, kind="stable"), depth, most, size


def _delta_rows(shard: int, ids: np.ndarray, code: np.ndarray, tree: Tree, pairs) -> pa.Table:
    order, depth, most, size = layout(ids, code, tree, pairs)
    n = len(order)
    pos = np.empty(n, np.int64)
    pos[order] = np.arange(n)
    up = tree.parent[order]
    own, above = code[order], code[np.maximum(up, 0)]
    changed = own != above
    changed[0] = False
    counts = changed.sum(1)
    rows, m = np.nonzero(changed)
    entries = pa.StructArray.from_arrays([pa.array(m.astype(np.int32)), pa.array(above[rows, m].astype(np.int32)), pa.array(own[rows, m].astype(np.int32))], names=["m", "from_cid", "to_cid"])
    diffs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), entries)
    root = up < 0
    return pa.table(
        {
            "shard": pa.array(np.full(n, shard, np.int32)),
            "pos": pa.array(np.arange(n, dtype=np.int32)),
            "vec_id": pa.array(ids[order]),
            "parent_id": pa.array(ids[np.maximum(up, 0)], mask=root),
            "parent_pos": pa.array(pos[np.maximum(up, 0)].astype(np.int32), mask=root),
            "depth": pa.array(depth[order].astype(np.int32)),
            "mask": pa.array((changed * (1 << np.arange(code.shape[1]))).sum(1)),
            "diffs": diffs,
            "code": pa.ListArray.from_arrays(pa.array(np.arange(0, n * code.shape[1] + 1, code.shape[1], dtype=np.int32)), pa.array(own.reshape(-1).astype(np.int32))),
            "max_dist": pa.array(np.sqrt(most[order])),
            "subtree_size": pa.array(size[order].astype(np.int32)),
        }
    )


def delta_table(codes: DataFrame, book: Codebook, height: int = 1, rule: str = "height", shards: int | None = None, balance: str | None = None) -> DataFrame:
    """The delta table of ``(vec_id, code)``: a tree for each shard, in pre-order.

    ``shards``: how many, dealt by a hash of the id; by default as many as keep a
    shard at about 200,000 codes. ``balance`` re-roots each tree: ``"center"`` at
    the middle of its longest path, ``"rotate"`` by moving the root to its tallest
    child while the tree gets lower.
    """
    if shards is None:
        shards = max(1, -(-codes.count() // SHARD))
    m = book.config.m
    shared = codes.sparkSession.sparkContext.broadcast(book.pairs())

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        code = table.column("code").combine_chunks().flatten().to_numpy().reshape(len(ids), m).astype(np.int64)
        tree = build(ids, code, height, rule)
        if balance:
            tree = recentred(tree, balance)
        return _delta_rows(table.column("shard")[0].as_py(), ids, code, tree, shared.value)

    shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    return codes.select(shard.alias("shard"), "vec_id", "code").groupBy("shard").applyInArrow(run, DELTA)


def recentred(tree: Tree, how: str = "center") -> Tree:
    """The same edges from another root."""
    n = len(tree.parent)
    beside: list[list[int]] = [[] for _ in range(n)]
    for x, p in enumerate(tree.parent.tolist()):
        if p >= 0:
            beside[x].append(p)
            beside[p].append(x)

    def walk(root: int):
        parent, order = np.full(n, -1), [root]
        for x in order:
            for y in beside[x]:
                if y != parent[x]:
                    parent[y] = x
                    order.append(y)
        return parent, order

    def depths(parent, order):
        d = np.zeros(n, np.int64)
        for x in order[1:]:
            d[x] = d[parent[x]] + 1
        return d

    if n < 3:
        return tree
    if how == "center":
        far = int(np.argmax(depths(*walk(tree.root))))
        parent, order = walk(far)
        d = depths(parent, order)
        root = int(np.argmax(d))
        for _ in range(int(d.max()) // 2):
            root = int(parent[root])
    else:
        root, parent, order = tree.root, *walk(tree.root)
        lowest = int(depths(parent, order).max())
        while True:
            tall = np.zeros(n, np.int64)
            for x in reversed(order[1:]):
                tall[parent[x]] = max(tall[parent[x]], tall[x] + 1)
            child = max(beside[root], key=lambda y: (tall[y], -y))
            new_parent, new_order = walk(child)
            high = int(depths(new_parent, new_order).max())
            if high >= lowest:
                break
            root, parent, order, lowest = child, new_parent, new_order, high
    return Tree(walk(root)[0], root, tree.finalists)


def stats(delta: DataFrame) -> DataFrame:
    """``(shard, n_codes, n_roots, n_edges, max_depth, n_diffs)``."""
    return delta.groupBy("shard").agg(
        F.count("*").alias("n_codes"), F.count(F.when(F.col("parent_pos").isNull(), 1)).alias("n_roots"), F.count("parent_pos").alias("n_edges"), F.max("depth").alias("max_depth"), F.sum(F.size("diffs")).alias("n_diffs")
    )


def depth_histogram(delta: DataFrame) -> DataFrame:
    return delta.groupBy("depth").agg(F.count("*").alias("n"))


def adjacency(delta: DataFrame) -> DataFrame:
    """``(shard, parent_id, children)``."""
    return delta.where("parent_id is not null").groupBy("shard", "parent_id").agg(F.array_sort(F.collect_list("vec_id")).alias("children"))


def decode_by_levels(delta: DataFrame, m: int) -> DataFrame:
    """``(vec_id, code)`` from the differences only: roots, then one join with the parents for each level."""
    deepest = delta.agg(F.max("depth")).first()[0] or 0
    level = delta.where("depth = 0").select("shard", "pos", "vec_id", "code")
    out = level
    for d in range(1, deepest + 1):
        above = level.select("shard", F.col("pos").alias("parent_pos"), F.col("code").alias("above"))
        rows = delta.where(F.col("depth") == d).select("shard", "pos", "vec_id", "parent_pos", "diffs").join(above, ["shard", "parent_pos"])
        own = F.transform("above", lambda c, i: F.coalesce(F.element_at(F.map_from_arrays(F.transform("diffs", lambda x: x["m"]), F.transform("diffs", lambda x: x["to_cid"])), i.cast("int")), c))
        level = rows.select("shard", "pos", "vec_id", own.alias("code"))
        out = out.unionByName(level)
    return out.select("vec_id", "code")


def largest_group_chains(codes: DataFrame, m: int, differ: int) -> DataFrame:
    """``(parent_id, vec_id)``: each code joins its largest group at this number of differing sub-spaces; groups are chained by id."""
    combs = [sum(1 << p for p in at) for at in combinations(range(m), m - differ)]
    key = F.transform("code", lambda c, i: F.when(F.getbit("comb", i) == 1, c).otherwise(-1))
    rows = codes.select("vec_id", "code", F.explode(F.array(*map(F.lit, combs))).alias("comb")).select("vec_id", F.struct("comb", key.alias("key")).alias("g"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("size")).where("size > 1")
    best = rows.join(sizes, "g").groupBy("vec_id").agg(F.max_by("g", F.struct("size", -F.col("g.comb"), "g.key")).alias("g"))
    before = F.lag("vec_id").over(Window.partitionBy("g").orderBy("vec_id"))
    return best.select(before.alias("parent_id"), "vec_id").where("parent_id is not null")
