"""Column functions on codes (arrays of centroid ids)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def diffs(before: Column, after: Column) -> Column:
    """``array<struct<m, from_cid, to_cid>>`` of the sub-spaces in which two codes differ."""
    pairs = F.transform(F.arrays_zip(before.alias("a"), after.alias("b")), lambda p, i: F.struct(i.alias("m"), p["a"].alias("from_cid"), p["b"].alias("to_cid")))
    return F.filter(pairs, lambda d: d["from_cid"] != d["to_cid"])


def mask(changes: Column) -> Column:
    """Bit m is set for each entry with this m."""
    return F.aggregate(changes, F.lit(0).cast("long"), lambda acc, d: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), d["m"].cast("int"))))


def hamming(a: Column, b: Column) -> Column:
    """Number of sub-spaces in which two codes differ."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def set_positions(bits: Column, m: int) -> Column:
    """The positions of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.getbit(bits, i) == 1)


def zcode(code: Column, m: int, bits: int) -> Column:
    """Bit planes of the ids interleaved: the first M bits are the highest bits of all ids, and so on."""
    out = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            out = F.call_function("shiftleft", out, F.lit(1)).bitwiseOR(F.getbit(code[i].cast("long"), F.lit(b)).cast("long"))
    return out


def from_zcode(z: Column, m: int, bits: int) -> Column:
    """The ids of an interleaved code."""
    cids = []
    for i in range(m):
        cid = F.lit(0)
        for b in range(bits):
            cid = cid.bitwiseOR(F.call_function("shiftleft", F.getbit(z, F.lit(b * m + (m - 1 - i))).cast("int"), F.lit(b)))
        cids.append(cid)
    return F.array(*cids)
