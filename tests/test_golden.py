"""Trees and sizes against fixed values of the test tables, and queries without SQL against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vqspark.config import PQConfig
from vqspark.operators import blocks, codebook, encode, tree
from vqspark.plans.queries import QUERIES, Base

#: Scale, K, rule, distortion, distinct codes, root, finalists, depth, tree differences, bytes, sequential differences.
GOLDEN = [
    ("0.001", 4, "height", 9979677, 486, 9, 3, 6, 1002, 1759, 2619),
    ("0.001", 16, "height", 6118315, 500, 34, 2, 6, 2357, 3114, 3633),
    ("0.001", 64, "height", 3686144, 500, 13, 1, 5, 3123, 3880, 3918),
    ("0.01", 4, "height", 9778422, 486, 5, 2, 5, 1013, 1770, 2660),
    ("0.01", 16, "height", 6167526, 500, 49, 2, 6, 2321, 3078, 3643),
    ("0.01", 64, "height", 3743012, 500, 0, 1, 5, 3116, 3873, 3920),
    ("0.1", 4, "height", 39473803, 1869, 21, 9, 6, 3156, 6163, 11104),
    ("0.1", 16, "height", 25221965, 2000, 85, 9, 6, 8390, 11397, 14572),
    ("0.1", 64, "height", 16552657, 2000, 80, 4, 7, 11520, 14527, 15633),
    ("0.01", 16, "first", 6167526, 500, 5, 6, 7, 2337, 3094, 3643),
]
DATA = "/root/testdata/sf0.001"


def codes_of(spark, folder, k):
    base = Base(spark, folder, PQConfig(m=8, k=k, dim=64, domain="int"))
    rows = base.codes.sort("vec_id").collect()
    return base, np.array([r.vec_id for r in rows]), np.array([r.code for r in rows], np.int64)


@pytest.mark.parametrize("scale,k,rule,distortion,distinct,root,finalists,depth,diffs,size,sequential", GOLDEN)
def test_fixed_values(spark, scale, k, rule, distortion, distinct, root, finalists, depth, diffs, size, sequential):
    base, ids, code = codes_of(spark, f"/root/testdata/sf{scale}", k)
    built = tree.build(ids, code, rule=rule)
    order, deep, _, _ = tree.layout(ids, code, built, base.book.pairs())
    changed = code[order] != code[np.maximum(built.parent[order], 0)]
    changed[0] = False
    assert len(np.unique(code, axis=0)) == distinct
    assert (ids[built.root], built.finalists, deep.max(), changed.sum()) == (root, finalists, depth, diffs)
    assert len(blocks.pack_bytes(code[order], deep[order], changed)) == size
    assert (code[1:] != code[:-1]).sum() == sequential
    assert int(codebook.distortion(base.vectors, base.book)) == distortion


def plain_tree(code, height=1):
    """The height-aware tree by the definition, one group after the other."""
    n, m = code.shape
    heights, parent, active, finalists = [0] * n, [-1] * n, list(range(n)), []
    for differ in range(m + 1):
        from itertools import combinations

        for at in combinations(range(m), m - differ):
            groups = {}
            for x in active:
                groups.setdefault(tuple(code[x, list(at)][::-1]), []).append(x)
            gone = set()
            for key in sorted(groups):
                own = groups[key]
                if len(own) < 2:
                    continue
                top = min(own, key=lambda x: (-heights[x], x))
                second = max(heights[x] for x in own if x != top)
                done = heights[top] + 1 >= m * height - 2
                heights[top] += second == heights[top]
                for x in own:
                    if x != top:
                        parent[x] = top
                        gone.add(x)
                if done:
                    finalists.append(top)
                    gone.add(top)
            active = [x for x in active if x not in gone]
    finalists += active
    for x in finalists[1:]:
        parent[x] = finalists[0]
    return parent, finalists


def test_tree_against_its_definition(spark):
    for k in (4, 16):
        _, ids, code = codes_of(spark, DATA, k)
        built = tree.build(ids, code)
        parent, finalists = plain_tree(code)
        assert built.parent.tolist() == parent and built.root == finalists[0] and built.finalists == len(finalists)


def test_tree_queries_against_plain_computations(spark):
    base, ids, code = codes_of(spark, DATA, 16)
    parent, _ = plain_tree(code)
    depth = []
    for x in range(len(code)):
        d = 0
        while parent[x] >= 0:
            x, d = parent[x], d + 1
        depth.append(d)
    found = {r.depth: r.n for r in QUERIES["tree_depth_histogram"](spark, DATA).collect()}
    assert found == {d: depth.count(d) for d in set(depth)}
    found = {r.parent_id: r.n_children for r in QUERIES["tree_adjacency"](spark, DATA).collect()}
    assert found == {int(ids[p]): parent.count(p) for p in set(parent) if p >= 0}
    pairs = base.book.pairs()
    most, beside = np.zeros(len(code)), {}
    for x in range(len(code)):
        below, above = x, parent[x]
        while above >= 0:
            d = sum(pairs[m][code[x, m], code[above, m]] for m in range(8))
            most[above] = max(most[above], d)
            beside[below] = max(beside.get(below, 0), d)
            below, above = above, parent[above]
    rows = tree.delta_table(base.codes, base.book, shards=1).sort("pos").collect()
    assert {r.vec_id: round(r.max_dist, 6) for r in rows} == {int(i): round(float(np.sqrt(x)), 6) for i, x in zip(ids, most)}
    children = {}
    for r in rows[1:]:
        children.setdefault(r.parent_id, []).append(r.vec_id)
    for own in children.values():
        assert own == sorted(own, key=lambda i: (-beside[i], i))
    size = QUERIES["size_report"](spark, DATA).first()
    assert (size.n_codes, size.n_diffs, size.packed_bytes - 16, size.formula_bytes - 24) == (500, 2357, 3114, 3114 - 8)
    assert size.bit_bytes == blocks.tree_bits(2357, 500)
    first = {r.vec_id for r in rows[:200]}
    tables = {q: base.book.distances(np.array([v])) for q, v in ((r.vec_id, r.v) for r in codebook.prepared(base.vectors.where("vec_id % 50 = 0"), base.config).collect())}
    want = sorted((q, rank, v, d) for q, t in tables.items() for rank, (d, v) in enumerate(sorted((int(sum(t[0, m, code[v, m]] for m in range(8))), v) for v in first)[:10], 1))
    assert sorted(map(tuple, QUERIES["delta_partial_scan"](spark, DATA).collect())) == want


def test_spanning_weight_against_growing_a_tree(spark):
    _, ids, code = codes_of(spark, DATA, 16)
    near, left, weight = (code != code[0]).sum(1), set(range(1, len(code))), 0
    while left:
        x = min(left, key=lambda i: near[i])
        weight += int(near[x])
        left.remove(x)
        near = np.minimum(near, (code != code[x]).sum(1))
    row = QUERIES["mst_total_weight"](spark, DATA).first()
    assert (row.n_codes, row.n_edges, row.weight) == (len(ids), len(ids) - 1, weight)


def test_rotation_lowers_no_edge(spark):
    base, ids, code = codes_of(spark, DATA, 16)
    built = tree.build(ids, code)
    height = lambda t: tree.layout(ids, code, t, None)[1].max()
    pairs = lambda t: {frozenset((x, p)) for x, p in enumerate(t.parent.tolist()) if p >= 0}
    for how in ("center", "rotate"):
        moved = tree.recentred(built, how)
        assert pairs(moved) == pairs(built) and height(moved) <= height(built)


def test_sampled_combinations_still_give_a_tree(spark):
    base, ids, code = codes_of(spark, DATA, 16)
    built = tree.build(ids, code, sample=0.3, seed=4)
    assert (built.parent < 0).sum() == 1 and sorted(tree.layout(ids, code, built, None)[0].tolist()) == list(range(len(ids)))
    again = encode.encode(base.vectors.where(F.col("vec_id") < 0), base.book)
    assert tree.delta_table(again, base.book).count() == 0
