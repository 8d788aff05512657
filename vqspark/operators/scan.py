"""Top-k searches: exact, over plain codes, over sequential differences and over delta trees.

Queries are a DataFrame. Their vectors are sent to all tasks in groups; a task
reads and unpacks each of its rows once for a whole group, keeps its own k best
per query, and a window picks the k best of these: the shuffle has no more than
queries * k rows from each task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vqspark.functions import vectors as V
from vqspark.lineage import cut
from vqspark.operators import blocks as B
from vqspark.operators.codebook import Codebook, matrix, prepared
from vqspark.operators.encode import code_matrix

#: Queries that a kernel takes at once, queries whose vectors are sent together, and rows that a kernel takes at once.
QUERY_BLOCK, QUERY_GROUP, ROWS = 512, 65_536, 2048
#: Bytes of distance tables that a task keeps; those of further query blocks are made anew for each batch of rows.
TABLE_BYTES = 64 << 20


def top_k(results: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, dist)``: by distance, then id."""
    order = Window.partitionBy("query_id").orderBy("dist", "vec_id")
    return results.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "dist")


class Best:
    """The k best of each query so far, by distance and then id."""

    def __init__(self, queries: np.ndarray, k: int, kind, alone: bool = False):
        self.queries, self.k, self.alone = queries, k, alone
        self.worst = np.iinfo(np.int64).max if np.dtype(kind).kind == "i" else np.inf
        self.bound = np.full(len(queries), self.worst, kind)
        self.query, self.ids, self.dist = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, kind)

    def add(self, dist: np.ndarray, ids: np.ndarray) -> None:
        """``dist[queries, n]`` of rows with ``ids[n]``."""
        if not self.k or not len(ids) or not len(self.queries):
            return
        if self.alone:
            dist = np.where(ids[None] == self.queries[:, None], self.worst, dist)
        bound = self.bound
        if len(ids) > self.k and (bound == self.worst).any():
            bound = np.minimum(bound, np.partition(dist, self.k - 1, axis=1)[:, self.k - 1])
        query, column = np.nonzero((dist <= bound[:, None]) & (dist != self.worst))
        if not len(query):
            return
        found = dist[query, column]
        query, found, own = np.concatenate([self.query, query]), np.concatenate([self.dist, found]), np.concatenate([self.ids, ids[column]])
        order = np.lexsort((own, found, query))
        query, found, own = query[order], found[order], own[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.k
        self.query, self.dist, self.ids = query[kept], found[kept], own[kept]
        full = rank == self.k - 1
        self.bound[query[full]] = found[full]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.queries[self.query]), pa.array(self.ids), pa.array(self.dist)], names=["query_id", "vec_id", "dist"])


# ---------------------------------------------------------------- queries
def _groups(rows: DataFrame, kind) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    """Rows ``(vec_id, v)`` as lists of blocks ``(ids, matrix)``, read one partition at a time."""
    group, ids, own, n = [], [], [], 0
    for r in rows.toLocalIterator():
        ids.append(r[0])
        own.append(r[1])
        n += 1
        if len(ids) == QUERY_BLOCK:
            group.append((np.array(ids), np.array(own, kind)))
            ids, own = [], []
        if n == QUERY_GROUP:
            yield group
            group, n = [], 0
    if ids:
        group.append((np.array(ids), np.array(own, kind)))
    if group:
        yield group


class _Held:
    """What a kernel needs of each block of queries: made once, or each time where it would take too much memory."""

    def __init__(self, blocks, prepare):
        self.blocks, self.prepare, self.kept, self.left = blocks, prepare, {}, TABLE_BYTES

    def __getitem__(self, i: int):
        if i in self.kept:
            return self.kept[i]
        made = self.prepare(*self.blocks[i])
        if (made.nbytes if isinstance(made, np.ndarray) else sum(x.nbytes for x in made)) <= self.left:
            self.left -= made.nbytes if isinstance(made, np.ndarray) else sum(x.nbytes for x in made)
            self.kept[i] = made
        return made


def in_blocks(rows: DataFrame, queries: DataFrame, config, unpack, add, start, schema: str, prepare) -> DataFrame | None:
    """The union, over groups of queries, of what tasks yield that see all their rows once for a group.

    ``unpack(batch)`` yields units of rows; ``add(state, unit, held)`` takes one
    into the state of a block of queries, which ``start(ids)`` begins and whose
    ``batch()`` is what a task returns. None without queries.
    """
    kind = np.int64 if config.domain == "int" else np.float64
    groups = _groups(queries, kind)
    now, more = next(groups, None), next(groups, None)
    if more is not None:
        rows = cut(rows)  # read again for each group, not made again
    out = None
    while now is not None:
        shared = rows.sparkSession.sparkContext.broadcast(now)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, states = _Held(shared.value, prepare), [start(ids) for ids, _ in shared.value]
            for batch in batches:
                for unit in unpack(batch):
                    for i, state in enumerate(states):
                        add(state, unit, held[i])
            for state in states:
                yield state.batch()

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
        now, more = more, next(groups, None) if more is not None else None
    return out


def query_rows(queries: DataFrame, config) -> DataFrame:
    return prepared(queries, config, queries.columns[0], queries.columns[1])


def _searched(rows: DataFrame, queries: DataFrame, config, k: int, alone: bool, unpack, distances, prepare) -> DataFrame:
    """The k best by ``distances(unit, held)``, which yields ``(dist[queries, n], ids[n])``."""
    name = "bigint" if config.domain == "int" else "double"
    kind = np.int64 if config.domain == "int" else np.float64

    def add(best: Best, unit, held) -> None:
        for dist, ids in distances(unit, held):
            best.add(dist, ids)

    schema = f"query_id long, vec_id long, dist {name}"
    out = in_blocks(rows, queries, config, unpack, add, lambda ids: Best(ids, k, kind, alone), schema, prepare)
    return top_k(rows.sparkSession.createDataFrame([], schema) if out is None else out, k)


# ---------------------------------------------------------------- exact
def exact_knn(vectors: DataFrame, queries: DataFrame, config, k: int, alone: bool = False) -> DataFrame:
    """The k nearest vectors of each query by squared distance; ``alone`` leaves out the query's own id."""

    def unpack(batch):
        x, ids = matrix(batch.column(1), config), batch.column(0).to_numpy()
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS].astype(np.float64)  # whole numbers stay exact below 2 ** 53
            yield part, (part**2).sum(1), ids[at : at + ROWS]

    def distances(unit, held):
        (part, squares, ids), (q, own) = unit, held
        d = own[:, None] - 2 * (q @ part.T) + squares[None]
        yield d.astype(np.int64) if config.domain == "int" else np.maximum(d, 0), ids

    def prepare(ids, q):
        q = q.astype(np.float64)
        return q, (q**2).sum(1)

    return _searched(prepared(vectors, config), query_rows(queries, config), config, k, alone, unpack, distances, prepare)


def adc_table(queries: DataFrame, book: Codebook) -> DataFrame:
    """``(query_id, m, k, d)``: squared distances of each query's parts to the centroids."""
    c = book.config
    parts = query_rows(queries, c).select(F.col("vec_id").alias("query_id"), F.posexplode(V.split(F.col("v"), c)).alias("m", "part"))
    table = F.broadcast(book.table(queries.sparkSession))  # M * K rows
    return parts.join(table, "m").select("query_id", "m", "k", V.squared_l2(F.col("part"), F.col("centroid"), "bigint" if c.domain == "int" else "double").alias("d"))


def pair_distances(pairs: DataFrame, codes: DataFrame, queries: DataFrame, book: Codebook) -> DataFrame:
    """``(query_id, vec_id, dist)`` of given pairs: the table distance of a query to a stored code, looked up by its id."""
    table = adc_table(queries, book).select("query_id", "m", F.col("k").alias("cid"), "d")
    own = pairs.select("query_id", "vec_id").join(codes.select("vec_id", "code"), "vec_id").select("query_id", "vec_id", F.posexplode("code").alias("m", "cid"))
    return own.join(table, ["query_id", "m", "cid"]).groupBy("query_id", "vec_id").agg(F.sum("d").alias("dist"))


# ---------------------------------------------------------------- codes
def _tables(book: Codebook) -> Callable:
    """Distance tables ``[M, K, queries]``: one addition of a row of queries for each sub-space."""
    return lambda ids, q: np.ascontiguousarray(book.distances(q).transpose(1, 2, 0))


def _code_tables(book: Codebook) -> Callable:
    """The same for queries that are codes: distances between centroids."""

    def prepare(ids, q):
        pairs, q = book.pairs(), q.astype(np.int64)
        return np.stack([pairs[m][:, q[:, m]] for m in range(book.config.m)])

    return prepare


def _units(m: int) -> Callable:
    def unpack(batch):
        code, ids = code_matrix(batch.column(1), m), batch.column(0).to_numpy()
        for at in range(0, len(code), ROWS):
            yield code[at : at + ROWS], ids[at : at + ROWS]

    return unpack


def _sums(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """``[n, queries]``: the sums of a code's entries in the tables."""
    out = table[0][code[:, 0]]
    for m in range(1, code.shape[1]):
        out += table[m][code[:, m]]
    return out


def _plain(unit, table):
    yield _sums(unit[0], table).T, unit[1]


def plain_scan(codes: DataFrame, book: Codebook, queries: DataFrame, k: int, alone: bool = False) -> DataFrame:
    """The k codes with the least sum of table distances."""
    return _searched(codes.select("vec_id", "code"), query_rows(queries, book.config), book.config, k, alone, _units(book.config.m), _plain, _tables(book))


def code_scan(codes: DataFrame, book: Codebook, queries: DataFrame, k: int, alone: bool = False) -> DataFrame:
    """The same where queries ``(query_id, code)`` are codes themselves: the distance between centroids."""
    own = queries.select(F.col("query_id").cast("long"), "code")
    return _searched(codes.select("vec_id", "code"), own, book.config, k, alone, _units(book.config.m), _plain, _code_tables(book))


class _Range:
    """Least and greatest distance, their sum and number for each query so far."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.least, self.most, self.total, self.n = ids, None, None, 0, 0

    def add(self, dist: np.ndarray) -> None:
        low, high = dist.min(axis=0), dist.max(axis=0)
        self.least = low if self.least is None else np.minimum(self.least, low)
        self.most = high if self.most is None else np.maximum(self.most, high)
        self.total, self.n = self.total + dist.sum(axis=0), self.n + len(dist)

    def batch(self) -> pa.RecordBatch:
        some = self.n > 0
        columns = [self.ids, self.least, self.most, self.total, np.full(len(self.ids), self.n)]
        return pa.RecordBatch.from_arrays([pa.array(c if some else c[:0]) for c in (columns if some else [self.ids] * 5)], names=["query_id", "least", "most", "total", "n"])


def _ranged(rows: DataFrame, queries: DataFrame, book: Codebook, unpack, distances) -> DataFrame:
    kind = "bigint" if book.config.domain == "int" else "double"

    def add(state: _Range, unit, table) -> None:
        if len(unit[0]):
            state.add(distances(unit, table))

    schema = f"query_id long, least {kind}, most {kind}, total {kind}, n long"
    out = in_blocks(rows, query_rows(queries, book.config), book.config, unpack, add, _Range, schema, _tables(book))
    out = rows.sparkSession.createDataFrame([], schema) if out is None else out
    return out.groupBy("query_id").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"), F.sum("n").alias("n"))


def distance_range(codes: DataFrame, book: Codebook, queries: DataFrame) -> DataFrame:
    """``(query_id, least, most, total, n)``: of the table distances to all codes; a row from each task and query."""
    return _ranged(codes.select("vec_id", "code"), queries, book, _units(book.config.m), lambda unit, table: _sums(unit[0], table))


# ---------------------------------------------------------------- compressed
def _delta_distances(code, parent, depth, changed, table):
    """``[n, queries]`` of a tree's codes: those of the parent and what the changed sub-spaces add.

    A changed sub-space costs two additions, so where more than 2 in 5 are
    changed, the unpacked codes are added up instead.
    """
    if 5 * np.count_nonzero(changed) > 2 * code.size:
        return _sums(code, table)
    out = np.empty((len(code), table.shape[2]), table.dtype)
    out[:1] = _sums(code[:1], table)
    for d in range(1, depth.max(initial=0) + 1):
        at = np.nonzero(depth == d)[0]
        dist = out[parent[at]]
        for m in range(code.shape[1]):
            own = np.nonzero(changed[at, m])[0]
            rows = at[own]
            dist[own] += table[m][code[rows, m]] - table[m][code[parent[rows], m]]
        out[at] = dist
    return out


def _pieces(n: int) -> Iterator[slice]:
    return (slice(at, at + ROWS) for at in range(0, n, ROWS))


def tree_scan(blocks: DataFrame, book: Codebook, queries: DataFrame, k: int, alone: bool = False, first: int | None = None) -> DataFrame:
    """The same over packed delta trees (bytes, bits or rows); ``first`` looks at that many codes of a block only.

    A block is unpacked once for all queries of a group.
    """
    m = book.config.m

    def unpack(batch):
        for form, n, ids, payload, tail in B.rows_of(batch):
            code, parent, depth, changed = B.unpack_tree(payload, form, n, m, tail)
            n = n if first is None else min(first, n)
            if n:
                yield code[:n], parent[:n], depth[:n], changed[:n], ids[:n]

    def distances(unit, table):
        *own, ids = unit
        d = _delta_distances(*own, table)
        for at in _pieces(len(d)):
            yield d[at].T, ids[at]

    return _searched(B.scannable(blocks), query_rows(queries, book.config), book.config, k, alone, unpack, distances, _tables(book))


def _sequences(m: int) -> Callable:
    def unpack(batch):
        for wide, n, ids, payload, _ in B.rows_of(batch):
            code, changed = B.unpack_sequential(payload, n, m, wide)
            if n:
                yield code, changed, ids

    return unpack


def _running(unit, table) -> np.ndarray:
    """``[n, queries]``: running sums of what each step changes; where most is changed, sums of whole codes."""
    code, changed, _ = unit
    if 5 * np.count_nonzero(changed) > 2 * code.size:
        return _sums(code, table)
    step = np.zeros((len(code), table.shape[2]), table.dtype)
    step[0] = _sums(code[:1], table)[0]
    for m in range(code.shape[1]):
        at = np.nonzero(changed[:, m])[0]
        at = at[at > 0]
        step[at] += table[m][code[at, m]] - table[m][code[at - 1, m]]
    return np.cumsum(step, axis=0, out=step)


def diff_scan(blocks: DataFrame, book: Codebook, queries: DataFrame, k: int, alone: bool = False) -> DataFrame:
    """The same over packed sequential differences."""

    def distances(unit, table):
        d = _running(unit, table)
        for at in _pieces(len(d)):
            yield d[at].T, unit[2][at]

    return _searched(B.sequences(blocks), query_rows(queries, book.config), book.config, k, alone, _sequences(book.config.m), distances, _tables(book))


def running_range(blocks: DataFrame, book: Codebook, queries: DataFrame) -> DataFrame:
    """``(query_id, least, most, total, n)`` of the running distances along packed sequential differences."""
    return _ranged(B.sequences(blocks), queries, book, _sequences(book.config.m), _running)
