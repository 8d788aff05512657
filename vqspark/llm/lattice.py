"""Near-duplicate embeddings by hashing to E8 lattice cells, with probes and a cosine check.

Every table projects the unit vectors onto 16 random orthonormal directions and
decodes both halves to their nearest point of the lattice E8. The home cell of a
vector is the pair of points; its probe cells have one of the two replaced by the
neighbouring point that comes next. Vectors meet where the home of one is a home
or probe of the other. Of the keys, only those with company are joined to the
vectors; crowded ones are dealt out as pairs of blocks. A pair that meets in
several cells counts in the first one only, which both sides can work out from
the vectors, so no list of pairs is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vqspark.llm.graph import connected_components, cut

TABLES, SCALE, SEED = 12, 0.25, 20
#: A cell with more members is dealt out in blocks of this many.
BLOCK = 1024
HALF = 8


# ---------------------------------------------------------------- lattice
@lru_cache(maxsize=1)
def shortest() -> np.ndarray:
    """The 240 shortest vectors of E8, by their rule."""
    whole = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(whole + halves)


def _even_point(x: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum."""
    near = np.rint(x)
    off = x - near
    worst = np.abs(off).argmax(-1)[..., None]
    step = np.where(np.take_along_axis(off, worst, -1) >= 0, 1.0, -1.0) * (near.sum(-1, keepdims=True) % 2 != 0)
    np.put_along_axis(near, worst, np.take_along_axis(near, worst, -1) + step, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8 to ``x`` (last axis of length 8)."""
    whole, half = _even_point(x), _even_point(x - 0.5) + 0.5
    nearer = ((x - whole) ** 2).sum(-1) <= ((x - half) ** 2).sum(-1)
    return np.where(nearer[..., None], whole, half)


def next_point(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Of the neighbours of each decoded point, the one nearest to ``x``."""
    return point + shortest()[((x - point) @ shortest().T).argmax(-1)]


@lru_cache(maxsize=8)
def _directions(dim: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim])
    wide = max(dim, 2 * HALF)  # short vectors count as padded with zeros
    axes = np.concatenate([np.linalg.qr(rng.normal(size=(wide, 2 * HALF)))[0][:dim] for _ in range(tables)], axis=1)
    return axes, rng.uniform(0, 1, 2 * HALF * tables), rng.integers(1, 2**62, (2, HALF)) * 2 + 1


def keys_of(unit: np.ndarray, tables: int = TABLES, scale: float = SCALE) -> np.ndarray:
    """``[n, tables, 3]`` hashes of the home cell and the two probe cells in each table."""
    n, dim = unit.shape
    axes, shift, mix = _directions(dim, tables)
    at = (unit @ axes / scale + shift).reshape(n, tables, 2, HALF)
    point = decode(at)
    other = next_point(at, point)
    with np.errstate(over="ignore"):
        own = ((2 * point).astype(np.int64) * mix).sum(-1)
        beside = ((2 * other).astype(np.int64) * mix).sum(-1)
        cells = np.stack([own[..., 0] + own[..., 1], beside[..., 0] + own[..., 1], own[..., 0] + beside[..., 1]], axis=-1)
        cells = (cells ^ (cells >> 29)) * np.int64(0x2545F4914F6CDD1D) + (np.arange(tables, dtype=np.int64) * 64 + dim)[None, :, None]
    return cells


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, unit vectors)`` for each length that occurs."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    for dim in np.unique(lengths):
        rows = np.nonzero(lengths == dim)[0]
        yield rows, unit_rows(flat[starts[rows][:, None] + np.arange(dim)])


# ---------------------------------------------------------------- kernels
def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2_000):
            part = batch.slice(at, 2_000)
            ids = part.column(0).to_numpy(zero_copy_only=False)
            for rows, unit in _matrices(part.column(1)):
                keys = keys_of(unit)
                n, tables, _ = keys.shape
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(ids[rows], tables * 3)),
                        pa.array(keys.reshape(-1)),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 3), n)),
                        pa.array(np.tile([True, False, False], n * tables)),
                    ],
                    names=["node", "key", "table", "home"],
                )


def _links_of(ids, weights, unit, home, block, key, table, threshold):
    """``(id, root, weight linked)`` of the members of one unit that link in it for the first time."""
    near = unit @ unit.T >= threshold
    near &= home[:, None] | home[None, :]
    near &= (block[:, None] != block[None, :]) | (block.min() == block.max())
    np.fill_diagonal(near, False)
    if not near.any():
        return None
    some = np.nonzero(near.any(axis=1))[0]
    near = near[np.ix_(some, some)]
    keys = keys_of(unit[some])
    for t in range(table):
        near &= keys[:, None, t, 0] != keys[None, :, t, 0]
    a, b = np.nonzero(np.triu(near))
    if len(a):
        ka, kb = keys[a], keys[b]
        before = np.zeros(len(a), bool)
        for t in range(table):
            before |= (ka[:, t, :1] == kb[:, t]).any(1) | (kb[:, t, :1] == ka[:, t]).any(1)
        ha, hb = ka[:, table, 0], kb[:, table, 0]
        a_in_b, b_in_a = (ha[:, None] == kb[:, table]).any(1), (hb[:, None] == ka[:, table]).any(1)
        cell = np.where(a_in_b & b_in_a, np.minimum(ha, hb), np.where(a_in_b, ha, hb))
        fresh = ~before & (cell == key)
        a, b = a[fresh], b[fresh]
    if not len(a):
        return None
    ids, weights = ids[some], weights[some]
    linked = np.bincount(a, weights[b], len(ids)) + np.bincount(b, weights[a], len(ids))
    root = np.arange(len(ids))
    while True:  # the least member of each component, by hooking and jumping
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root, low)
        low = low[low]
        if (low == root).all():
            break
        root = low
    own = np.nonzero(linked)[0]
    return ids[own], ids[root[own]], linked[own].astype(np.int64)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def units(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            batch = table.to_batches()[0]
            unit = batch.column(0).to_numpy(zero_copy_only=False)
            bounds = [0, *(np.nonzero(np.diff(unit))[0] + 1), len(unit)]
            got = []
            matrix = list(_matrices(batch.column(7)))
            places = np.empty((len(unit), 2), np.int64)
            for k, (rows, _) in enumerate(matrix):
                places[rows, 0], places[rows, 1] = k, np.arange(len(rows))
            ids, weights, block, key, t, home = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 7))
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                for k in np.unique(places[lo:hi, 0]) if hi - lo > 1 else ():  # the key holds the length; a hash clash mixes them
                    own = lo + np.flatnonzero(places[lo:hi, 0] == k)
                    if len(own) < 2:
                        continue
                    vectors = matrix[k][1][places[own, 1]]
                    if x := _links_of(ids[own], weights[own], vectors, home[own], block[own], key[lo], int(t[lo]), threshold):
                        got.append(x)
            if got:
                columns = [pa.array(np.concatenate(c)) for c in zip(*got)]
                yield pa.RecordBatch.from_arrays(columns, names=["node", "root", "linked"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            last = table.column(0)[-1].as_py()
            unit = table.column(0).to_numpy()
            cut_at = int(np.searchsorted(unit, last))  # rows are sorted by unit; the last may go on in the next batch
            if cut_at:
                yield from units(table.slice(0, cut_at))
            rest = table.slice(cut_at)
        if rest is not None and rest.num_rows:
            yield from units(rest)

    return run


# ---------------------------------------------------------------- operator
def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def lattice_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Two vectors link when a table brings them together and their cosine, in double
    precision, is at least ``threshold``. ``n_links`` counts the other rows
    linked directly, equal vectors included; ``component_id`` is the smallest
    vec_id reachable; ``kept`` marks the rows that bear it. Vectors that are null,
    empty or zero, or hold nulls or non-finite numbers, and rows with a null
    vec_id, link with nothing (component_id is their own id). Vectors of
    different lengths never link. Repeated rows are kept and link with each
    other. Other columns are not looked at; an empty table gives an empty table.
    """
    vector = F.col(vector_col)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("v"), (_usable(vector) & F.col(id_col).isNotNull()).alias("fit"))
    own = own.withColumns({"h1": F.xxhash64("v", F.size("v")), "h2": F.hash("v", F.lit(7))})
    reps = cut(own.where("fit").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"), F.first("v").alias("v")))

    keys = reps.select("h1", "v").mapInArrow(_emit_keys, "node long, key long, table int, home boolean")
    crowd = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("home").alias("any_home")).where("n > 1 and any_home")
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = keys.join(crowd, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    dealt = dealt.select(unit.alias("unit"), "node", "block", "key", "table", "home")
    met = dealt.join(reps.withColumnRenamed("h1", "node"), "node").select("unit", "node", "w", "block", "key", "table", "home", "v")
    found = cut(met.repartition("unit").sortWithinPartitions("unit").mapInArrow(_verify(threshold), "node long, root long, linked long"))

    links = found.groupBy("node").agg(F.sum("linked").alias("linked"))
    edges = found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    named = reps.select("h1", "h2", F.col("h1").alias("node"), "least", "w").join(links, "node", "left").join(connected_components(edges), "node", "left")
    named = named.select("h1", "h2", "least", (F.col("w") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("part"))
    firsts = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "part").select("h1", "h2", "n_links", "component_id")
    out = own.where("fit").select("vec_id", "h1", "h2").join(named, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = own.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
