"""Packed forms of codes: delta trees in bytes or bits, and sequential differences.

Every block is one row and decodes alone, so scans run in parallel.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 4096


# ---------------------------------------------------------------- sizes
def tree_bytes(diffs: int, n: int) -> int:
    """Bytes of the byte-aligned form of a tree, header included."""
    return 8 + diffs + (3 * (n - 1) + 1) // 2 + 16


def tree_bits(diffs: int, n: int) -> int:
    """Bytes of the bit-packed form, header included."""
    return -(-(8 * diffs + 11 * n + 64) // 8) + 8


def paged_blocks(per_node: np.ndarray) -> int:
    """Pages of 4 KiB that nodes fill in order: 10 bits for the page, 10 and 8 per changed id for a node."""
    ends = np.cumsum(10 + 8 * per_node[1:])
    pages, at, used = 1, 0, 0
    while at < len(ends):
        fits = int(np.searchsorted(ends, used + BLOCK_BYTES * 8 - 10, side="right"))
        if fits == len(ends):
            break
        pages, at, used = pages + 1, fits, int(ends[fits - 1]) if fits else 0
    return pages


# ---------------------------------------------------------------- formats
#: Number of set bits of each byte.
_COUNT = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)


def _check(m: int, k_used: int) -> None:
    if m > 8 or k_used > 256:
        raise ValueError("packed trees have one byte for the changed sub-spaces and one for an id")


def _bitmaps(changed: np.ndarray) -> np.ndarray:
    return (changed * (1 << np.arange(changed.shape[1]))).sum(1)


def _in_row(changed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, column, rank)`` of the set places; the rank counts within a row."""
    row, column = np.nonzero(changed)
    return row, column, (np.cumsum(changed, axis=1) - 1)[row, column]


def pack_bytes(code: np.ndarray, depth: np.ndarray, changed: np.ndarray, rows: np.ndarray | None = None) -> bytes:
    """Root ids; then for two nodes at a time a byte with both depths, and for each a bitmap and its changed ids.

    With ``rows[n, bytes]``, each node, the root too, is followed by its row.
    """
    n, m = code.shape
    _check(m, int(code.max(initial=0)) + 1)
    if not n:
        return b""
    if depth.max() > 15:
        raise ValueError("a depth takes four bits")
    tail = 0 if rows is None else rows.shape[1]
    changed = changed.copy()
    changed[0] = False
    size = 1 + changed.sum(1) + tail
    size[1::2] += 1  # the byte with two depths
    size[0] = m + tail
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[:m] = code[0]
    odd = np.arange(1, n, 2)
    other = np.append(depth, 0)[odd + 1]
    out[start[odd]] = depth[odd] | other << 4
    at = start.copy()
    at[1::2] += 1
    out[at[1:]] = _bitmaps(changed)[1:]
    row, column, rank = _in_row(changed)
    out[at[row] + 1 + rank] = code[row, column]
    if tail:
        out[(start + size - tail)[:, None] + np.arange(tail)] = rows
    return out.tobytes()


def pack_bits(code: np.ndarray, depth: np.ndarray, changed: np.ndarray) -> bytes:
    """For each node 3 bits of depth, 8 bits of bitmap and 8 bits for each changed id, lowest bit first; the root changes all."""
    n, m = code.shape
    _check(m, int(code.max(initial=0)) + 1)
    if n and depth.max() > 7:
        raise ValueError("a depth takes three bits")
    changed = changed.copy()
    changed[:1] = True
    size = 11 + 8 * changed.sum(1)
    start = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), np.uint8)
    head = depth | _bitmaps(changed) << 3
    bits[start[:, None] + np.arange(11)] = head[:, None] >> np.arange(11) & 1
    row, column, rank = _in_row(changed)
    bits[(start[row] + 11 + 8 * rank)[:, None] + np.arange(8)] = code[row, column][:, None] >> np.arange(8) & 1
    return np.packbits(bits, bitorder="little").tobytes()


def _chain(after: np.ndarray, start: int, n: int, doublings: int) -> np.ndarray:
    """``start, after[start], after[after[start]], ...``, n places; in strides of 2 ** doublings, then all between them."""
    jumps = [after]
    for _ in range(doublings):
        jumps.append(jumps[-1][jumps[-1]])
    far, places = jumps.pop(), [start]
    for _ in range((n - 1) >> doublings):
        places.append(int(far[places[-1]]))
    out = np.array(places, after.dtype)[:, None]
    for jump in reversed(jumps):
        out = np.stack([out, jump[out]], axis=2).reshape(len(out), -1)
    return out.reshape(-1)[:n]


def _read_bytes(payload: bytes, n: int, m: int, tail: int):
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(2 * (16 + tail), np.uint8)])
    place = np.arange(len(raw))
    last = len(raw) - 1
    skip = np.minimum(place + 1 + tail + _COUNT[raw], last)  # behind a node whose bitmap is here
    depth, maps = np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.zeros(n, np.int64)
    maps[0] = (1 << m) - 1
    at[0] = -1
    pairs = n // 2
    if pairs:
        first = np.minimum(place + 1, last)
        heads = _chain(skip[skip[first]].astype(np.int32), m + tail, pairs, 5)
        at[1::2] = heads + 1
        at[2::2] = skip[at[1::2]][: len(at[2::2])]
        depth[1::2] = raw[heads] & 15
        depth[2::2] = (raw[heads] >> 4)[: len(depth[2::2])]
        maps[1:] = raw[at[1:]]
    return depth, maps, at + 1, raw


def _read_bits(payload: bytes, n: int, m: int):
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(16, np.uint8)]).astype(np.uint16)
    eight = ((raw[:-1, None] | raw[1:, None] << 8) >> np.arange(8, dtype=np.uint16) & 255).reshape(-1)  # the byte that begins at each bit
    place = np.arange(len(eight), dtype=np.int32)
    bitmap = eight[np.minimum(place + 3, len(eight) - 1)]
    after = np.minimum(place + 11 + 8 * _COUNT[bitmap].astype(np.int32), np.int32(len(eight) - 1)).astype(np.int32)
    at = _chain(after, 0, n, 4).astype(np.int64)
    maps = bitmap[at].astype(np.int64)
    counts = _COUNT[maps]
    starts = np.cumsum(counts) - counts
    rank = np.arange(int(counts.sum())) - np.repeat(starts, counts)
    return (eight[at] & 7).astype(np.int64), maps, starts, eight[np.repeat(at + 11, counts) + 8 * rank].astype(np.int64)


def parents_of(depth: np.ndarray) -> np.ndarray:
    """In pre-order, the parent is the last node before that is one less deep."""
    parent = np.full(len(depth), -1)
    for d in range(1, depth.max(initial=0) + 1):
        above, own = np.nonzero(depth == d - 1)[0], np.nonzero(depth == d)[0]
        parent[own] = above[np.searchsorted(above, own) - 1]
    return parent


def unpack_tree(payload: bytes, form: str, n: int, m: int, tail: int = 0):
    """``(code, parent, depth, changed)`` of a packed tree, in its order."""
    if not n:
        return np.empty((0, m), np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, m), bool)
    depth, maps, starts, cids = _read_bits(payload, n, m) if form == "bits" else _read_bytes(payload, n, m, tail)
    changed = (maps[:, None] >> np.arange(m) & 1).astype(bool)
    place = starts[:, None] + np.cumsum(changed, axis=1) - 1
    parent = parents_of(depth)
    code = cids[np.where(changed, place, 0)].astype(np.int64)
    for d in range(1, depth.max() + 1):
        at = np.nonzero(depth == d)[0]
        code[at] = np.where(changed[at], code[at], code[parent[at]])
    return code, parent, depth, changed


def unpack_rows(payload: bytes, n: int, m: int, tail: int) -> np.ndarray:
    """The row of bytes that follows each node of a tree packed with rows."""
    if not n:
        return np.empty((0, tail), np.uint8)
    _, maps, starts, raw = _read_bytes(payload, n, m, tail)
    begin = starts + np.where(np.arange(n) == 0, m, _COUNT[maps])
    return raw[begin[:, None] + np.arange(tail)]


def pack_sequential(code: np.ndarray, wide: bool) -> bytes:
    """The first code; then for each a bitmap of what differs from the one before, and these ids (two bytes each if ``wide``)."""
    n, m = code.shape
    _check(m, 0 if wide else int(code.max(initial=0)) + 1)
    if not n:
        return b""
    width = 2 if wide else 1
    changed = np.ones(code.shape, bool)
    changed[1:] = code[1:] != code[:-1]
    size = 1 + width * changed.sum(1)
    size[0] = m * width
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    out[start[1:]] = _bitmaps(changed)[1:]
    start[0] = -1
    row, column, rank = _in_row(changed)
    for b in range(width):
        out[start[row] + 1 + width * rank + b] = code[row, column] >> 8 * b & 255
    return out.tobytes()


def unpack_sequential(payload: bytes, n: int, m: int, wide: bool):
    """``(code, changed)``."""
    size = 2 if wide else 1
    if not n:
        return np.empty((0, m), np.int64), np.empty((0, m), bool)
    raw = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(32, np.uint8)]).astype(np.int64)
    maps, starts = np.full(n, (1 << m) - 1), np.zeros(n, np.int64)
    if n > 1:
        after = np.minimum(np.arange(len(raw)) + 1 + size * _COUNT[raw], len(raw) - 1).astype(np.int32)
        at = _chain(after, m * size, n - 1, 5)
        maps[1:], starts[1:] = raw[at], at + 1
    changed = (maps[:, None] >> np.arange(m) & 1).astype(bool)
    place = starts[:, None] + size * (np.cumsum(changed, axis=1) - 1)
    cid = raw[np.where(changed, place, 0)]
    if wide:
        cid = cid + 256 * raw[np.where(changed, place + 1, 0)]
    last = np.maximum.accumulate(np.where(changed, np.arange(n)[:, None], 0), axis=0)
    return np.take_along_axis(cid, last, 0), changed


# ---------------------------------------------------------------- tables
BLOCKS = "shard int, format string, n_codes int, n_diffs long, n_pages int, tail_bytes int, vec_ids array<long>, payload binary"


def pack_delta(delta: DataFrame, m: int, form: str = "bytes", vectors: DataFrame | None = None) -> DataFrame:
    """``(shard, format, n_codes, n_diffs, n_pages, tail_bytes, vec_ids, payload)``: a row for each tree of a delta table.

    ``form`` is ``"bytes"``, ``"bits"``, or ``"rows"``, which keeps the vector (float32) of each code from
    ``vectors(vec_id, embedding)`` right behind it.
    """
    if form not in ("bytes", "bits", "rows") or (form == "rows") != (vectors is not None):
        raise ValueError("the format is bytes, bits, or rows with vectors")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.num_rows
        code = table.column("code").combine_chunks().flatten().to_numpy().reshape(n, m).astype(np.int64)
        depth = table.column("depth").to_numpy().astype(np.int64)
        changed = (table.column("mask").to_numpy()[:, None] >> np.arange(m) & 1).astype(bool)
        rows = None
        if form == "rows":
            rows = np.ascontiguousarray(table.column("embedding").combine_chunks().flatten().to_numpy().reshape(n, -1).astype("<f4")).view(np.uint8)
        payload = pack_bits(code, depth, changed) if form == "bits" else pack_bytes(code, depth, changed, rows)
        per_node = changed.sum(1)
        ids = table.column("vec_id").combine_chunks()
        return pa.table(
            {
                "shard": table.column("shard").slice(0, 1),
                "format": [form],
                "n_codes": pa.array([n], pa.int32()),
                "n_diffs": pa.array([int(per_node[1:].sum())], pa.int64()),
                "n_pages": pa.array([paged_blocks(per_node)], pa.int32()),
                "tail_bytes": pa.array([0 if rows is None else rows.shape[1]], pa.int32()),
                "vec_ids": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
                "payload": pa.array([payload], pa.binary()),
            }
        )

    own = delta.select("shard", "pos", "vec_id", "depth", "mask", "code")
    if vectors is not None:
        own = own.join(vectors.select("vec_id", "embedding"), "vec_id")
    return own.groupBy("shard").applyInArrow(run, BLOCKS)


def scannable(blocks: DataFrame) -> DataFrame:
    """The columns of packed trees that scans read."""
    return blocks.select("format", "n_codes", "vec_ids", "payload", "tail_bytes")


def sequences(blocks: DataFrame) -> DataFrame:
    """The columns of packed sequential differences that scans read."""
    return blocks.select("wide", "n_codes", "vec_ids", "payload", F.lit(0).alias("tail_bytes"))


def rows_of(batch: pa.RecordBatch):
    """``(format or wide, n, ids, payload, tail)`` of each packed row, without copies."""
    ids, payloads = batch.column(2), batch.column(3)
    flat, offsets = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
    for i, (form, n, tail) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(4).to_pylist())):
        yield form, n, flat[offsets[i] : offsets[i + 1]], payloads[i].as_buffer(), tail


def decode_trees(blocks: DataFrame, m: int) -> DataFrame:
    """``(vec_id, code)`` of packed trees."""

    def run(batches):
        for batch in batches:
            for form, n, ids, payload, tail in rows_of(batch):
                code = unpack_tree(payload, form, n, m, tail)[0].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, m, dtype=np.int32)), pa.array(code.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["vec_id", "code"])

    return scannable(blocks).mapInArrow(run, "vec_id long, code array<int>")


def stored_vectors(blocks: DataFrame, m: int) -> DataFrame:
    """``(vec_id, embedding)`` of trees packed with rows."""

    def run(batches):
        for batch in batches:
            for _, n, ids, payload, tail in rows_of(batch):
                flat = np.ascontiguousarray(unpack_rows(payload, n, m, tail)).view("<f4").astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * tail // 4 + 1, max(1, tail // 4), dtype=np.int32)[: n + 1]), pa.array(flat.reshape(-1)))
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["vec_id", "embedding"])

    return scannable(blocks).mapInArrow(run, "vec_id long, embedding array<float>")
