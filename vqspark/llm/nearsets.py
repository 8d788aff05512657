"""Near-duplicate documents by five-word shingles: Golay keys of long SimHash fingerprints, then the exact similarity.

Texts whose sets of shingles have a Jaccard similarity of 0.8 differ in about 39
of 256 fingerprint bits, too many for keys that reach two. So each segment of 23
bits is decoded softly: the codewords of the binary Golay code that agree best
with the counts behind the bits, not only with their signs, which two such texts
share far more often. Of the five segments of either half of a fingerprint any
three make a key, so errors in the others don't matter; a key has the best codeword of each segment, or the second
or third best of one. Texts that meet under a key are compared by their
shingles, unless numbers of shingles and parities of their hashes rule a link out.

A crowd of n near copies gives no n * n pairs: first those are compared whose
fingerprints are neighbours in a least spanning tree of the crowd. The
fingerprints only estimate the similarity, so the links of a tree may leave apart
what another pair would join. Where they do, the shingles of the whole crowd are
brought together and all its pairs compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.llm.graph import connected_components, cut, release
from vqspark.llm.keymap import fresh
from vqspark.llm.leaks import row_keys
from vqspark.llm.simhash import GOLAY_K, GOLAY_N, SEED, _remainder

#: Words in a shingle, and least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Bits of a text's parities.
PARITIES = 512
#: Halves of a fingerprint, segments of a half, those that make a key, and codewords of a segment that are tried.
HALVES, SEGMENTS, CHOSEN, RANKS = 2, 5, 3, 3
#: The multipliers of a 64-bit mixer, which gives the second half.
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: A key with more members is dealt out in pairs of blocks of this many.
BLOCK = 512
#: So many texts that meet are compared in all pairs at once, more of them first along a tree.
FEW = 8
#: Shingles of a crowd that are counted together.
COLUMNS = 4096
BROADCAST_ROWS = 200_000
#: Texts whose segments are decoded together.
TOGETHER = 256


# ---------------------------------------------------------------- shingles and keys
def shingles(text: bytes | None) -> list[bytes]:
    """Distinct 128-bit hashes of the five-word shingles, in order; of fewer words the whole sequence, of none nothing. A-Z is folded."""
    words = (text or b"").lower().split()
    digest = xxhash.xxh3_128_digest
    if len(words) < WORDS:
        return [digest(b" ".join(words), SEED)] if words else []
    return sorted({digest(b" ".join(x), SEED) for x in zip(*(words[i:] for i in range(WORDS)))})


@lru_cache(maxsize=1)
def codewords() -> np.ndarray:
    """The 4,096 codewords of the Golay code as rows of 1 and -1."""
    words = np.arange(1 << GOLAY_K, dtype=np.int64) << (GOLAY_N - GOLAY_K)
    words |= _remainder(words)
    return ((words[:, None] >> np.arange(GOLAY_N - 1, -1, -1) & 1) * 2 - 1).astype(np.float32)


def margins(found: list[bytes]) -> np.ndarray:
    """``[halves, 128]``: for each bit, by how many more shingles have it set than not."""
    total = np.zeros((HALVES, 128), np.int64)
    for at in range(0, len(found), 1 << 16):
        part = found[at : at + (1 << 16)]
        lanes = np.frombuffer(b"".join(part), np.uint64)
        for half in range(HALVES):
            total[half] += 2 * np.unpackbits(lanes.view(np.uint8).reshape(-1, 16), axis=1).sum(axis=0, dtype=np.int64) - len(part)
            lanes = (lanes ^ (lanes >> np.uint64(30))) * MIX1
            lanes = (lanes ^ (lanes >> np.uint64(27))) * MIX2
            lanes ^= lanes >> np.uint64(31)
    return total


def best_codewords(rows: np.ndarray) -> np.ndarray:
    """``[n, halves, segments, ranks]``: of margins ``[n, halves, 128]``, the codewords that agree best with each segment."""
    parts = rows[..., : SEGMENTS * GOLAY_N].reshape(-1, GOLAY_N)
    scores = parts.astype(np.float32) @ codewords().T
    some = np.argpartition(-scores, RANKS, axis=1)[:, :RANKS]
    own = np.take_along_axis(scores, some, 1)
    order = np.lexsort((some, -own), axis=1)
    return np.take_along_axis(some, order, 1).reshape(len(rows), HALVES, SEGMENTS, RANKS)


def keys_of(best: np.ndarray) -> np.ndarray:
    """``[n, keys]``: for any three segments of a half the best codewords, or the second or third of one of them."""
    out = []
    tables = [(half, at) for half in range(HALVES) for at in combinations(range(SEGMENTS), CHOSEN)]
    for t, (half, at) in enumerate(tables):
        for other in [None, *((i, r) for i in at for r in range(1, RANKS))]:
            key = np.full(len(best), t, np.int64)
            for i in at:
                key = key << GOLAY_K | best[:, half, i, other[1] if other and other[0] == i else 0]
            out.append(key)
    return np.stack(out, axis=1)


def parities(found: list[bytes]) -> np.ndarray:
    """``[PARITIES / 64]``: for each remainder of the hashes, whether an odd number of shingles has it. Two sets differ in at least as many shingles as bits."""
    at = np.frombuffer(b"".join(found), np.uint64)[::2] % np.uint64(PARITIES)
    return np.packbits(np.bincount(at.astype(np.int64), minlength=PARITIES) & 1).view(np.int64)


SKETCH = "doc_id long, key1 long, key2 long, node long, n int, fp array<long>, odd array<long>, codes array<int>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            sets = [shingles(x.as_py()) for x in part.column(0)]
            rows = np.stack([margins(s) for s in sets])
            fps = np.packbits((rows > 0).reshape(len(rows), -1), axis=1).view(">i8").astype(np.int64)
            node = np.array([xxhash.xxh64_intdigest(b"".join(s), SEED) for s in sets], np.uint64).view(np.int64)
            best = best_codewords(rows).reshape(len(rows), -1).astype(np.int32)
            odd = np.stack([parities(s) for s in sets])
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1))) for x in (fps, odd, best)]
            n = pa.array([len(s) for s in sets], pa.int32())
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(node), n, *lists], names=["doc_id", "key1", "key2", "node", "n", "fp", "odd", "codes"])


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            keys = keys_of(part.column(1).flatten().to_numpy().astype(np.int64).reshape(part.num_rows, HALVES, SEGMENTS, RANKS))
            node = np.repeat(part.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(keys.reshape(-1))], names=["node", "key"])


def spanning(apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a least spanning tree under a matrix of distances."""
    n = len(apart)
    near, by = apart[0].astype(np.int64), np.zeros(n, np.int64)
    near[0] = 1 << 40
    done = np.zeros(n, bool)
    done[0] = True
    ends = np.empty(n - 1, np.int64)
    for k in range(n - 1):
        x = ends[k] = int(near.argmin())
        done[x] = True
        closer = (apart[x] < near) & ~done
        near[closer], by[closer] = apart[x][closer], x
        near[x] = 1 << 40
    return by[ends], ends


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables that end with the last row of a unit; rows are sorted by the unit, their first column."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        begin = int(np.searchsorted(table.column(0).to_numpy(), table.column(0)[-1].as_py()))  # the last unit may go on
        if begin:
            yield table.slice(0, begin)
        rest = table.slice(begin)
    if rest is not None:
        yield rest


def _starts(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where units begin, and their sizes."""
    starts = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    return starts, np.diff(np.append(starts, len(unit)))


def _nearest(similarity: float):
    """``(a, b, crowd)``: pairs to be compared; and of a unit of many the crowds whose trees the pairs are. Rows are sorted by unit."""
    share = (1 - similarity) / (1 + similarity)

    def possible(apart: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether sets of n and m shingles that differ in ``apart`` or more can have the similarity: shared ones follow from both."""
        return np.maximum(apart, np.abs(n - m)) <= share * (n + m) + 1e-6

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for table in _whole_units(batches):
            unit, node, size = (table.column(i).to_numpy() for i in range(3))
            fp, odd = (table.column(i).combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(unit), -1) for i in (3, 4))
            order = np.lexsort((node, unit))
            unit, node, size, fp, odd = unit[order], node[order], size[order].astype(np.int64), fp[order], odd[order]
            starts, sizes = _starts(unit)
            two = starts[sizes == 2]
            close = possible(np.bitwise_count(odd[two] ^ odd[two + 1]).sum(axis=1, dtype=np.int64), size[two], size[two + 1])
            found, crowds = [(node[two[close]], node[two[close] + 1])], []
            for lo, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own, many = node[lo : lo + n], size[lo : lo + n]
                if (name := own.tobytes()) in seen:  # the same texts meet under many keys
                    continue
                if len(seen) > 10_000:
                    seen.clear()
                seen.add(name)
                close = possible(sum(np.bitwise_count(x[:, None] ^ x[None]).astype(np.int16) for x in odd[lo : lo + n].T), many[:, None], many[None])
                if n <= FEW:
                    a, b = np.nonzero(np.triu(close, 1))
                    found.append((own[a], own[b]))
                    continue
                apart = sum(np.bitwise_count(x[:, None] ^ x[None]).astype(np.int16) for x in fp[lo : lo + n].T)
                a, b = spanning(np.where(close, apart, 1 << 10))
                some = close[a, b]
                found.append((np.minimum(own[a], own[b])[some], np.maximum(own[a], own[b])[some]))
                crowd = np.arange(n)
                for x, y in zip(a[some].tolist(), b[some].tolist()):  # in the order in which the tree grew
                    crowd[y] = crowd[x]
                crowds += [own[crowd == c] for c in np.flatnonzero(np.bincount(crowd) > 2)]
            a, b = (np.concatenate(x) for x in zip(*found))
            nothing = pa.nulls(len(a), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), nothing], names=["a", "b", "crowd"])
            none = pa.nulls(len(crowds), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([x.tolist() for x in crowds], pa.list_(pa.int64()))], names=["a", "b", "crowd"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """``[n, n]``: how many shingles any two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    some = times[at] > 1
    owner, at = owner[some], (np.cumsum(times > 1) - 1)[at[some]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        part = slice(*np.searchsorted(at, [lo, lo + COLUMNS]))
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[owner[part], at[part] - lo] = 1
        total += (has @ has.T).astype(np.int64)
    return total


def _linked(similarity: float):
    """``(a, b)``: links between the components that meet in a crowd, found among all its pairs, as many as hold together what links do. Rows are sorted by crowd."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_units(batches):
            crowd, node, component = (table.column(i).to_numpy() for i in range(3))
            found = []
            for lo, n in zip(*(x.tolist() for x in _starts(crowd))):
                own, part = node[lo : lo + n], component[lo : lo + n]
                sets = [x.values.to_numpy() for x in table.column(3).slice(lo, n)]
                size = np.array([len(x) for x in sets])
                both = shared_counts(sets)
                a, b = np.nonzero(np.triu(both >= similarity * (size[:, None] + size[None] - both)) & (part[:, None] != part[None]))
                up = {c: c for c in part.tolist()}
                for x, y in zip(a.tolist(), b.tolist()):
                    p, q = (_root(up, int(part[i])) for i in (x, y))
                    if p != q:
                        up[p] = q
                        found.append((int(own[x]), int(own[y])))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _root(up: dict[int, int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            sets = [[int.from_bytes(s[:8], "little", signed=True) for s in shingles(x.as_py())] for x in part.column(0)]
            yield pa.RecordBatch.from_arrays([part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=["node", "own"])


# ---------------------------------------------------------------- operator
def _sent(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, key1, key2, node, group_key``; rows of a group share ``group_key``.

    Two texts link when they meet under a key and the Jaccard similarity of their
    sets of five-word shingles is at least ``similarity``; equal sets always do.
    A group holds all that is reachable by links. Null texts count as empty, and empty
    ones have equal sets; texts of fewer than five words have themselves as only
    shingle. Null ids and repeated rows are kept, other columns not looked at; an
    empty table gives an empty table. ``key1`` and ``key2`` are hashes of id and
    text, ``node`` one of the set.
    """
    key1, key2 = row_keys(id_col, text_col)
    own = docs.select(F.col(text_col).cast("binary").alias("text"), F.col(id_col).cast("long").alias("doc_id"), key1.alias("key1"), key2.alias("key2"))
    rows = cut(own.mapInArrow(_sketch, SKETCH))
    nodes = cut(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("n", "fp", "odd", "codes")), F.min(F.struct("key1", "key2")).alias("row")))
    keys = nodes.select("node", "codes").mapInArrow(_emit_keys, "node long, key long")
    crowd = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = keys.join(crowd, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with"))
    dealt = dealt.select(unit.alias("unit"), "node").join(nodes.select("node", F.col("n").alias("size"), "fp", "odd"), "node").select("unit", "node", "size", "fp", "odd")
    met = cut(dealt.repartition("unit").sortWithinPartitions("unit").mapInArrow(_nearest(similarity), "a long, b long, crowd array<long>").distinct())
    pairs = met.where("crowd is null").select("a", "b")
    release(docs.sparkSession)

    wanted = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "row"), "node").select("node", "row.*"))
    texts = own.select("text", "key1", "key2").join(_sent(wanted), ["key1", "key2"]).select("text", "node")
    sets = cut(texts.mapInArrow(_sets, "node long, own array<long>").groupBy("node").agg(F.first("own").alias("own")))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = both.where(shared >= F.lit(similarity) * (F.size("x") + F.size("y") - shared)).select("a", "b")
    known = cut(connected_components(links))

    crowds = met.where("crowd is not null").select(F.xxhash64("crowd").alias("crowd"), F.explode("crowd").alias("node")).distinct()
    placed = cut(crowds.join(known, "node", "left").select("crowd", "node", F.coalesce("component", "node").alias("component")))
    apart = placed.groupBy("crowd").agg((F.min("component") < F.max("component")).alias("apart")).where("apart").select("crowd")
    rest = placed.join(apart, "crowd").join(sets, "node").select("crowd", "node", "component", "own")
    more = cut(rest.repartition("crowd").sortWithinPartitions("crowd").mapInArrow(_linked(similarity), "a long, b long").distinct())
    if not more.isEmpty():
        known = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    groups = known.select("node", F.col("component").alias("group_key"))
    return rows.select("doc_id", "key1", "key2", "node").join(groups, "node", "left").select("doc_id", "key1", "key2", "node", F.coalesce("group_key", "node").alias("group_key"))


def keep_one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs``, with all its columns, with one row of each group: the one with the smallest id.

    Of rows that repeat this id one stays, of equal rows any; a row with a null id stays
    only where no row of its group has an id.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key1", "key2")
    groups = cut(near_groups(docs, id_col, text_col, similarity))
    first = groups.groupBy("group_key").agg(F.min(order).alias("x")).select("x.key1", "x.key2")
    copies = groups.groupBy("key1", "key2").agg(F.count("*").alias("n"))
    one, two, again = fresh(docs, "_key1"), fresh(docs, "_key2"), fresh(docs, "_again")
    kept = cut(first.join(copies, ["key1", "key2"]).select(F.col("key1").alias(one), F.col("key2").alias(two), (F.col("n") > 1).alias(again)))
    key1, key2 = row_keys(id_col, text_col)
    keyed = docs.select("*", key1.alias(one), key2.alias(two))
    out = keyed.join(kept.where(~F.col(again)).select(one, two), [one, two], "left_semi")
    repeated = kept.where(F.col(again)).select(one, two)
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(_sent(repeated), [one, two], "left_semi").dropDuplicates([one, two]))
    return out.select(*docs.columns)
