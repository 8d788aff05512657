"""Exact nearest codes by bounds on bit prefixes of interleaved codes.

With a relocated codebook, codes that share the top bits of all ids are near
each other. An index keeps codes in the order of their interleaved bits, in
blocks. A block is a tree whose level l has a node for each distinct choice of
the top l bits of all ids; a node's distance to a query lies between the sums
of the least and greatest table distances of its id ranges. A search goes down
from the root and follows nodes whose lower bound doesn't exceed the best upper
one. What it begins with comes from the codes around the query's own code.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.functions import codes as C
from vqspark.operators.codebook import Codebook
from vqspark.operators.scan import Best, _sums, in_blocks, query_rows, top_k

#: Codes in a block of the index, and codes on each side that the first bound is taken from.
BLOCK, AROUND = 32_768, 8


def bound_index(codes: DataFrame, m: int, bits: int, blocks: int | None = None) -> DataFrame:
    """``(vec_ids, payload)``: blocks of codes (one or two bytes an id) in the order of their interleaved bits.

    ``blocks``: how many, cut at quantiles of the first 62 interleaved bits; by default as many as give each about 32,768 codes.
    """
    if blocks is None:
        blocks = max(1, -(-codes.count() // BLOCK))
    top = min(bits, max(1, 62 // m))
    order = C.zcode(F.transform("code", lambda c: F.call_function("shiftright", c, F.lit(bits - top))), m, top) if m <= 62 else F.col("code")[0].cast("long")
    kind = "<u1" if bits <= 8 else "<u2"

    def run(batches):
        rest: list[pa.RecordBatch] = []
        held = 0

        def flush():
            table = pa.Table.from_batches(rest)
            code = table.column("code").combine_chunks().flatten().to_numpy().reshape(-1, m)
            ids = table.column("vec_id").combine_chunks()
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([code.astype(kind).tobytes()], pa.binary())], names=["vec_ids", "payload"])

        for batch in batches:
            if batch.num_rows:
                rest.append(batch)
                held += batch.num_rows
            if held >= BLOCK:
                yield flush()
                rest, held = [], 0
        if rest:
            yield flush()

    own = codes.select("vec_id", "code").withColumn("z", order)
    own = own.repartitionByRange(blocks, "z") if blocks > 1 else own.coalesce(1)
    return own.sortWithinPartitions("z", "vec_id").select("vec_id", "code").mapInArrow(run, "vec_ids array<long>, payload binary")


class _Block:
    """Codes in order, and the first code of each node on each level."""

    def __init__(self, ids: np.ndarray, code: np.ndarray, bits: int, levels: list[int]):
        planes = np.concatenate([(code >> b) & 1 for b in range(bits - 1, -1, -1)], axis=1)
        order = np.lexsort(planes.T[::-1])
        self.ids, self.code, self.bits = ids[order], code[order], bits
        self.levels = []
        for level in levels:
            prefix = self.code >> (bits - level)
            first = np.nonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]).any(axis=1)]))[0]
            self.levels.append((level, first, prefix[first]))
        self.by_code = np.packbits(planes[order], axis=1)

    def around(self, own: np.ndarray) -> np.ndarray:
        """Places of the codes next to each given code in the order."""
        planes = np.packbits(np.concatenate([(own >> b) & 1 for b in range(self.bits - 1, -1, -1)], axis=1), axis=1)
        name = np.dtype((np.void, planes.shape[1]))
        known, asked = np.ascontiguousarray(self.by_code).view(name).reshape(-1), np.ascontiguousarray(planes).view(name).reshape(-1)
        both = np.concatenate([known, asked])
        rank = np.unique(both, return_inverse=True)[1].reshape(-1)
        at = np.searchsorted(rank[: len(known)], rank[len(known) :])
        return np.clip(at[:, None] + np.arange(-AROUND, AROUND), 0, len(known) - 1)


def _ranges(table: np.ndarray, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest entries of tables ``[M, K, queries]`` over ids with the same high bits."""
    starts = np.arange(0, table.shape[1], 1 << shift)
    return np.minimum.reduceat(table, starts, axis=1), np.maximum.reduceat(table, starts, axis=1)


def bound_search(index: DataFrame, book: Codebook, queries: DataFrame, bits: int, k: int = 1, levels: list[int] | None = None, by_bound: bool = True) -> DataFrame:
    """``(query_id, rank, vec_id, dist)``: the k nearest codes of each query, by distance and then id.

    ``index`` is a :func:`bound_index` of codes over ``book``, whose ids should
    have been relocated. ``levels`` are those looked at on the way down (1 to
    ``bits``; all by default). ``by_bound`` looks at the nodes of the last level
    by their lower bound and stops a query at its best; otherwise in the order
    of the index. Each task returns its k best.
    """
    c = book.config
    kind = np.int64 if c.domain == "int" else np.float64
    levels = sorted(set(levels or range(1, bits + 1)))
    if levels[0] < 1 or levels[-1] > bits:
        raise ValueError("levels are from 1 to the bits of an id")
    width = "<u1" if bits <= 8 else "<u2"

    def unpack(batch):
        ids, offsets = batch.column(0).flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(batch.column(0).offsets.to_numpy()))])
        for i in range(batch.num_rows):
            code = np.frombuffer(batch.column(1)[i].as_buffer(), width).reshape(-1, c.m).astype(np.int64)
            yield _Block(ids[offsets[i] : offsets[i + 1]], code, bits, levels)

    def add(best: Best, block: _Block, held) -> None:
        table, own = held
        n = len(best.queries)
        near = block.around(own)
        d = np.full((n, 2 * AROUND), best.worst, kind)
        for j in range(2 * AROUND):
            d[:, j] = sum(table[m][block.code[near[:, j], m], np.arange(n)] for m in range(c.m))
        d[:, 1:][near[:, 1:] == near[:, :-1]] = best.worst  # at the ends of a block
        coarse = np.sort(d, axis=1)[:, min(k, 2 * AROUND) - 1] if k <= 2 * AROUND else np.full(n, best.worst, kind)
        bound = np.minimum(best.bound, coarse)
        alive = np.ones((1, n), bool)
        parent = np.zeros(0, np.int64)
        first = np.zeros(1, np.int64)
        low = None
        for level, starts, prefix in block.levels:
            parent = np.searchsorted(first, starts, side="right") - 1
            least, most = _ranges(table, bits - level)
            node = np.nonzero(alive.any(axis=1)[parent])[0]  # children of what some query still follows
            lows, highs = _sums(prefix[node], least), _sums(prefix[node], most)
            if k == 1:
                seen = np.where(alive[parent[node]], highs, best.worst)
                bound = np.minimum(bound, seen.min(axis=0, initial=best.worst))
            now = np.zeros((len(starts), n), bool)
            now[node] = alive[parent[node]] & (lows <= bound[None])
            low = np.full((len(starts), n), best.worst, kind) if level == levels[-1] else None
            if low is not None:
                low[node] = lows
            alive, first = now, starts
        ends = np.append(first[1:], len(block.ids))
        nodes = np.nonzero(alive.any(axis=1))[0]
        if by_bound:
            nodes = nodes[np.argsort(low[nodes].min(axis=1), kind="stable")]
        for at in range(0, len(nodes), 64):
            some = nodes[at : at + 64]
            asked = np.nonzero((alive[some] & (low[some] <= np.minimum(best.bound, bound)[None])).any(axis=0))[0]
            if not len(asked):
                continue
            rows = np.concatenate([np.arange(first[x], ends[x]) for x in some])
            dist = np.full((n, len(rows)), best.worst, kind)
            dist[asked] = _sums(block.code[rows], np.ascontiguousarray(table[:, :, asked])).T
            best.add(dist, block.ids[rows])

    def prepare(ids, q):
        d = book.distances(q)
        return np.ascontiguousarray(d.transpose(1, 2, 0)), d.argmin(-1)

    schema = f"query_id long, vec_id long, dist {'bigint' if c.domain == 'int' else 'double'}"
    out = in_blocks(index, query_rows(queries, c), c, unpack, add, lambda ids: Best(ids, k, kind), schema, prepare)
    return top_k(index.sparkSession.createDataFrame([], schema) if out is None else out, k)
