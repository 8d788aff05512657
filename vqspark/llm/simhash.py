"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits. Two
fingerprints with at most two differing bits leave one segment untouched whose
successor (cyclically) has at most one error. So the key of a table is an exact
segment together with the index of a Golay codeword near the next segment. The
binary Golay code of length 23 is perfect: each word lies within three errors of
exactly one codeword. A fingerprint has as home key the codeword of its own
segment, and as probe keys those of all words one bit away; of two segments with
at most one error between them, the home of either is a probe of the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vqspark.llm.graph import connected_components, cut

#: Generator polynomial of the binary Golay code, its length and message length.
GOLAY_POLYNOMIAL, GOLAY_N, GOLAY_K = 0b101011100011, 23, 12
SEED = 42
#: (shift, width) of the segments, from the highest bits down.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
BLOCK_BYTES = 1 << 20


# ---------------------------------------------------------------- fingerprints
def _word_blocks(text: bytes) -> Iterator[list[bytes]]:
    """Lists of words whose 3-word shingles, taken list by list, are those of the text."""
    tail: list[bytes] = []
    at = 0
    while at < len(text):
        end = min(len(text), at + BLOCK_BYTES)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\f":
            end += 1
        words = tail + text[at:end].lower().split()
        yield words
        tail, at = words[-2:], end


def _bit_counts(digests: bytes) -> np.ndarray:
    """How many of the 8-byte digests have each of the 64 bits set."""
    bits = np.unpackbits(np.frombuffer(digests, np.uint8).reshape(-1, 8), axis=1)
    lanes = np.add.reduceat(bits.view(np.uint64), np.arange(0, len(bits), 255), axis=0)  # bytes can't overflow
    return lanes.view(np.uint8).astype(np.int64).sum(axis=0)


def fingerprint(text: bytes | None) -> bytes:
    """SimHash of the 3-word shingles of a UTF-8 text as 8 big-endian bytes; zeros without words."""
    digest = xxhash.xxh64_digest
    counts, n, few = np.zeros(64, np.int64), 0, []
    for words in _word_blocks(text or b""):
        if len(words) < 3:
            few = words
            continue
        found = b"".join([digest(b" ".join(x), SEED) for x in zip(words, words[1:], words[2:])])
        counts += _bit_counts(found)
        n += len(words) - 2
    if not n:
        return digest(b" ".join(few), SEED) if few else bytes(8)
    return np.packbits(2 * counts > n).tobytes()


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = b"".join(fingerprint(x.as_py()) for x in batch.column(1))
        fps = np.frombuffer(raw, ">i8").astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)``: the fingerprint as a signed 64-bit integer."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return own.mapInArrow(_fingerprints, "doc_id long, fp long")


# ---------------------------------------------------------------- Golay keys
def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of each word, as a polynomial over GF(2), by the generator."""
    rest = words.astype(np.int64)
    for bit in range(GOLAY_N - 1, GOLAY_N - GOLAY_K - 1, -1):
        rest ^= ((rest >> bit) & 1) * (GOLAY_POLYNOMIAL << (bit - (GOLAY_N - GOLAY_K)))
    return rest


def _corrections() -> np.ndarray:
    """Error pattern of each of the 2,048 syndromes."""
    patterns = [sum(1 << b for b in bits) for r in range(4) for bits in combinations(range(GOLAY_N), r)]
    table = np.zeros(1 << (GOLAY_N - GOLAY_K), np.int64)
    table[_remainder(np.array(patterns))] = patterns
    return table


_TABLE: list[np.ndarray] = []


def codeword_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one codeword within three errors of each 23-bit word."""
    if not _TABLE:
        _TABLE.append(_corrections())
    return (words ^ _TABLE[0][_remainder(words)]) >> (GOLAY_N - GOLAY_K)


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, key, home)``: each fingerprint's home key in the three tables and its distinct probe keys."""
    bits = fps.view(np.uint64)
    parts = [((bits >> np.uint64(s)) & np.uint64((1 << w) - 1)).astype(np.int64) for s, w in SEGMENTS]
    rows, keys, homes = [], [], []
    at = np.arange(len(fps))
    for t in range(3):
        exact, near = parts[t], parts[(t + 1) % 3]
        width = SEGMENTS[(t + 1) % 3][1]
        found = np.stack([codeword_index(near), *(codeword_index(near ^ (1 << b)) for b in range(width))], axis=1)
        base = (np.int64(t) << 34) | (exact << 12)
        rows.append(at)
        keys.append(base | found[:, 0])
        homes.append(np.ones(len(fps), bool))
        found = np.sort(found, axis=1)
        fresh = np.ones(found.shape, bool)
        fresh[:, 1:] = found[:, 1:] != found[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(base[r] | found[r, c])
        homes.append(np.zeros(len(r), bool))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            fps = batch.column(0).slice(at, 20_000).to_numpy(zero_copy_only=False)
            rows, keys, homes = keys_of(fps)
            yield pa.RecordBatch.from_arrays([pa.array(fps[rows]), pa.array(keys), pa.array(homes)], names=["fp", "key", "home"])


def fingerprint_links(distinct: DataFrame, max_bits: int = 2) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of distinct fingerprints (column ``fp``) at most ``max_bits`` (0 to 2) apart.

    The distance is checked inside the join, so only true links leave it, and a
    fingerprint can have no more than 2,080 of them however many rows there are.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys reach two differing bits")
    keys = distinct.select("fp").mapInArrow(_emit_keys, "fp long, key long, home boolean")
    home = keys.where("home").select("key", F.col("fp").alias("a"))
    probe = keys.where("not home").select("key", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    return home.join(probe, (home["key"] == probe["key"]) & (F.col("a") < F.col("b")) & near).select("a", "b")


# ---------------------------------------------------------------- operator
def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, fp, component_id, group_key``.

    Documents link when their fingerprints differ in at most ``max_bits`` bits;
    ``component_id`` is the smallest doc_id reachable, itself included, and
    ``group_key`` the same for all rows of a component. A null text counts as
    empty, an empty text has fingerprint zero and links like any other, repeated
    rows are kept, rows with a null doc_id take part but name no component (it is
    null only where no row of the component has an id). Other columns of
    ``docs`` are not looked at. An empty table gives an empty table.
    """
    fps = cut(fingerprints(docs, id_col, text_col))
    least = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = connected_components(fingerprint_links(least, max_bits)).select(F.col("node").alias("fp"), F.col("component").alias("group_key"))
    of = least.join(groups, "fp", "left").select("fp", "least", F.coalesce("group_key", "fp").alias("group_key"))
    firsts = of.groupBy("group_key").agg(F.min("least").alias("component_id"))
    named = of.select("fp", "group_key").join(firsts, "group_key")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id", "group_key")
