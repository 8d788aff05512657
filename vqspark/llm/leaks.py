"""Benchmark decontamination by template windows with slot consistency.

Words are folded; numbers, units and names become typed placeholders and keep
their value as a slot. Each text has two templates: ``plain`` has placeholders
for numbers and units, ``named`` also for capitalised words, a run of them being
one name. Windows of five template words of items and documents are joined on
their hash. An item that lies in a document has most of its windows there, so
one of its rarest windows at least: these make the pairs to look at. Then all
windows that a pair shares are lined up, and the slots of both sides compared:
each value of the item must stand for one value of the document everywhere. So
verbatim copies are caught, and so are questions that were given other numbers,
names or units. Items that are nearly all placeholders, or shorter than a
window, are looked up literally.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vqspark.llm.graph import cut
from vqspark.llm.keymap import bit_map, fresh, listed

WINDOW, SHARE = 5, 0.8
#: Units that count as such after a number.
UNITS = frozenset(
    "mm cm m km in inch inches ft feet foot yd yard yards mi mile miles mg g kg t lb lbs oz ton tons ml cl l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent usd eur dollar dollars cent cents euro euros "
    "kmh mph hz khz mhz ghz w kw mw v a j kj cal kcal pa kpa bar c f k degrees".split()
)
#: Scripts that are written without spaces (Thai to Lao, kana, Han); each letter counts as a word.
UNSPACED = "฀-໿぀-ヿ㐀-鿿豈-﫿"
TOKEN = re.compile(rf"\d+(?:[.,:/]\d+)*|[^\W\d_{UNSPACED}]+|[{UNSPACED}]")
#: Words are 64-bit hashes with three bits for what they are.
IS_NUMBER, IS_UNIT, IS_NAME, KINDS = 1, 2, 4, 7
#: Words that stand for a number, a unit, a name and the edge of a text, and the mixer of window hashes.
NUMBER, UNIT, NAME, EDGE = (np.int64(8 * (n + 1)) for n in range(4))
MIXER = 0x9E3779B97F4A7C15
PLAIN, NAMED, LITERAL = 0, 1, 2
#: Words without placeholders that a window needs at least, and those that a template needs.
LITERALS, TEMPLATE_LITERALS = 2, 4
#: Items with fewer words are found only in texts that hold nothing else.
WHOLE = 3
#: Words that a task looks at together (a longer text alone), and words that it remembers.
CHUNK, MEMO = 1 << 18, 1 << 20
#: The map of all item windows that goes to the tasks: bits for each, and the powers of two between which its size lies.
SPREAD, LEAST, MOST = 128, 20, 28
#: Windows or pairs up to this many (at most 80 bytes each) are broadcast; beyond it their joins shuffle.
BROADCAST_ROWS = 200_000
#: Positions of a document that are judged together, or twice an item's length if that is more.
BLOCK = 4096


# ---------------------------------------------------------------- templates
class _Words(dict):
    """The hash and kinds of each word as it stands in a text."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        low = word.lower()
        kind = IS_NUMBER if word[0].isdigit() else (IS_UNIT * (low in UNITS)) | (IS_NAME * (len(word) > 1 and not word[0].islower() and word[0] != low[0]))
        value = self[word] = int(np.uint64((xxhash.xxh64_intdigest(low) | 64) & ~KINDS | kind).view(np.int64))
        return value


class Chunk:
    """Texts as one array of words, each text between two edges, and their templates."""

    def __init__(self, texts: list[list[int]]):
        lengths = np.array([len(t) + 2 for t in texts], np.int64)
        self.owner = np.repeat(np.arange(len(texts)), lengths)
        ends = np.cumsum(lengths)
        own = np.empty(int(lengths.sum()), np.int64)
        inside = np.ones(len(own), bool)
        inside[ends - 1] = inside[ends - lengths] = False
        own[~inside] = EDGE
        own[inside] = np.fromiter((w for t in texts for w in t), np.int64, int(inside.sum()))
        self.edge = ~inside
        number = (own & IS_NUMBER).astype(bool) & inside
        unit = (own & IS_UNIT).astype(bool) & ~number & inside
        unit[1:] &= number[:-1]
        unit[:1] = False
        name = ((own & IS_NAME) != 0) & inside & ~number & ~unit
        word = own & ~np.int64(KINDS)
        self.word = word
        self.plain = np.where(number, NUMBER, np.where(unit, UNIT, word))
        self.plain_slot = np.where(number | unit, word | 1, 0)
        follows = np.zeros(len(own), bool)
        follows[1:] = name[1:] & name[:-1]
        self.kept = np.nonzero(~follows)[0]
        named = np.where(name, NAME, self.plain)[self.kept]
        slot = self.plain_slot.copy()
        if name.any():
            start = np.maximum.accumulate(np.where(~follows, np.arange(len(own)), 0))
            with np.errstate(over="ignore"):
                slot[name] = word[name] * (2 * (np.arange(len(own)) - start)[name] + 1)
                slot = np.add.reduceat(slot, self.kept)
            slot = np.where(named == NAME, slot | 1, slot)
        else:
            slot = slot[self.kept]
        self.named, self.named_slot = named, slot

    def view(self, kind: int, window: int):
        """``(hash, slots, owner)``: the hash of the window at each place, 0 where it isn't usable; the slot of each place; whose it is."""
        if kind == LITERAL:
            return _windows(self.word, np.ones(len(self.word), bool), window, LITERAL), np.zeros(len(self.word), np.int64), self.owner
        words, slots, edge, owner = (self.plain, self.plain_slot, self.edge, self.owner) if kind == PLAIN else (self.named, self.named_slot, self.edge[self.kept], self.owner[self.kept])
        return _windows(np.where(edge, 0, words), slots == 0, window, kind), slots, owner


def _windows(words: np.ndarray, literal: np.ndarray, window: int, kind: int) -> np.ndarray:
    """64-bit hash of each window of words; 0 where one is 0 or too few are literal. Windows over two edges belong to no text."""
    n = len(words) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    hashed, held = np.full(n, kind + 16 * window, np.uint64), np.ones(n, bool)
    count = np.zeros(n, np.int8)
    own = words.view(np.uint64)
    for k in range(window):
        part = own[k : k + n]
        hashed = (hashed ^ part) * np.uint64(MIXER)
        hashed ^= hashed >> np.uint64(31)
        held &= part != 0
        count += literal[k : k + n]
    for k in range(window - 1):  # an edge, and then another one
        held &= ~((words[k : k + n] == EDGE) & (words[k + 1 : k + 1 + n] == EDGE))
    return np.where(held & (count >= min(LITERALS, window)), hashed | np.uint64(1), np.uint64(0)).view(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, Chunk]]:
    """``(other columns of each text, chunk)`` for runs of texts, which are the first column."""
    find, get = TOKEN.findall, _Words().__getitem__
    rows, texts, size = [], [], 0
    for batch in batches:
        for text, *row in zip(*(c.to_pylist() for c in batch.columns)):
            words = [*map(get, find(text or ""))]
            rows.append(row)
            texts.append(words)
            size += len(words)
            if size > CHUNK:
                yield rows, Chunk(texts)
                rows, texts, size = [], [], 0
    if rows:
        yield rows, Chunk(texts)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(1, width), dtype=np.int32)[: n + 1]), pa.array(values.reshape(-1)))


# ---------------------------------------------------------------- windows of items and documents
ITEM_WINDOWS = "item long, view int, length int, size int, words int, place int, hash long, slots array<long>"


def item_views(words: list[int], window: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(view, length of windows, hash at each place, slot at each place)`` by which an item is found."""
    if not words:
        return []
    own, out = Chunk([words]), []
    for kind in (PLAIN, NAMED):
        h, slots, _ = own.view(kind, window)
        inside = len(slots) - 2 - window + 1
        literals = np.count_nonzero(slots == 0) - 2
        if literals >= TEMPLATE_LITERALS and 2 * np.count_nonzero(h) >= max(1, inside) and not (kind == NAMED and np.array_equal(own.named, own.plain)):
            out.append((kind, window, h, slots))
    if not out:
        length = min(window, len(words) if len(words) >= WHOLE else len(words) + 2)
        h, slots, _ = own.view(LITERAL, length)
        if len(words) >= WHOLE:
            h = np.where((own.edge[: len(h)] | own.edge[length - 1 :]), 0, h)
        out.append((LITERAL, length, h, slots))
    return out


def _item_windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, get = TOKEN.findall, _Words().__getitem__
        for batch in batches:
            for text, item in zip(*(c.to_pylist() for c in batch.columns)):
                words = [*map(get, find(text))]
                for kind, length, h, slots in item_views(words, window):
                    at = np.nonzero(h)[0]
                    same = lambda x, t: pa.array(np.full(len(at), x), t)
                    yield pa.RecordBatch.from_arrays(
                        [same(item, pa.int64()), same(kind, pa.int32()), same(length, pa.int32()), same(len(at), pa.int32()), same(len(words), pa.int32()), pa.array(at.astype(np.int32)), pa.array(h[at]), _lists(slots[at[:, None] + np.arange(length)])],
                        names=["item", "view", "length", "size", "words", "place", "hash", "slots"],
                    )

    return run


DOCUMENT_WINDOWS = "row long, doc_id long, key1 long, key2 long, at int, hash long, slots array<long>"


def _document_windows(views: list[tuple[int, int]], bits):
    """Windows of texts that the map has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, own in _chunks(batches):
            for kind, length in views:
                h, slots, owner = own.view(kind, length)
                at = np.nonzero(listed(bits.value, h) & (h != 0))[0]
                if len(at):
                    whose = [rows[i] for i in owner[at].tolist()]
                    columns = [pa.array(c, pa.int64()) for c in zip(*whose)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(at.astype(np.int32)), pa.array(h[at]), _lists(slots[at[:, None] + np.arange(length)])], names=["row", "doc_id", "key1", "key2", "at", "hash", "slots"])

    return run


# ---------------------------------------------------------------- judgement
def judge(hits: list[tuple[int, int, list[int]]], item: list[tuple[int, int, list[int]]], length: int, share: float) -> tuple[float, bool] | None:
    """``(share of the item's windows, verbatim)`` where enough of them lie on alignments near each other whose slots agree.

    ``hits`` are ``(at, hash, slots)`` of a document, ``item`` are ``(place, hash, slots)`` of all windows of the item. Each
    alignment is judged by itself first; words put in or left out move it by a few places, so that of its neighbours is added
    which covers places it has not.
    """
    places = defaultdict(list)
    for place, h, slots in item:
        places[h].append((place, slots))
    on: dict[int, dict[int, tuple[list[int], list[int]]]] = defaultdict(dict)
    for at, h, own in hits:
        for place, slots in places.get(h, ()):
            on[at - place][place] = (slots, own)
    need = share * len(item) - 1e-9
    if len(set().union(*on.values())) < need:
        return None
    best = None
    for shift in on:
        covered: set[int] = set()
        taken: set[int] = set()
        forth: dict[int, int] = {}
        back: dict[int, int] = {}
        same, clash = True, False
        for s in sorted((s for s in on if abs(s - shift) <= length), key=lambda s: (abs(s - shift), s)):
            for place, (slots, own) in sorted(on[s].items()):
                if place in covered:
                    continue
                for k, (a, b) in enumerate(zip(slots, own)):
                    if place + k not in taken and a and b:
                        same &= a == b
                        clash |= forth.setdefault(a, b) != b or back.setdefault(b, a) != a
            covered |= on[s].keys()
            taken |= {p + k for p in on[s] for k in range(length)}
            if len(covered) >= need and (same or not clash):
                found = (len(covered) / len(item), same)
                best = max(best, found) if best else found
    return best


def _judge(share: float):
    names = ["row", "doc_id", "key1", "key2", "item", "share", "verbatim"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                hits, item = ([(x[c], x["hash"], x["slots"]) for x in r[part]] for part, c in (("hits", "at"), ("theirs", "place")))
                if found := judge(hits, item, r["length"], share):
                    out.append((r["row"], r["doc_id"], r["key1"], r["key2"], r["item"], *found))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return run


# ---------------------------------------------------------------- operator
def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text."""
    own, text = F.col(id_col).cast("long"), F.col(text_col)
    return [F.xxhash64(own, text), F.xxhash64(F.lit("other"), text, own)]


def _sent(frame: DataFrame, most: int | None = None) -> DataFrame:
    """Broadcast where it has few rows."""
    most = BROADCAST_ROWS if most is None else most
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def _found(docs: DataFrame, benchmark: DataFrame, window: int, share: float, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    spark = docs.sparkSession
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("question")).distinct()
    items = cut(items.withColumn("item", F.monotonically_increasing_id()))  # of texts that share an item_id each is looked for
    theirs = cut(items.select("question", "item").mapInArrow(_item_windows(window), ITEM_WINDOWS))
    count = theirs.count()
    empty = spark.createDataFrame([], "doc_id long, item_id long, share double, verbatim boolean, key1 long, key2 long")
    if not count:
        return empty
    views = sorted((r["view"], r["length"]) for r in theirs.select("view", "length").distinct().collect())  # at most five
    bits = spark.sparkContext.broadcast(bit_map(theirs, "hash", count, SPREAD, LEAST, MOST))

    key1, key2 = row_keys(id_col, text_col)
    own = docs.select(F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), key1.alias("key1"), key2.alias("key2"))
    ours = cut(own.mapInArrow(_document_windows(views, bits), DOCUMENT_WINDOWS))

    # an item with n windows of which t must be met has one at least among any n - t + 1 of them: the rarest are taken
    often = theirs.groupBy("hash").agg(F.count("*").alias("often"))
    order = Window.partitionBy("item", "view").orderBy("often", "place")
    needed = F.ceil(F.col("size") * share - 1e-9)
    rare = theirs.join(often, "hash").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("size") - needed + 1).select("hash", "item", "view").distinct()
    pairs = cut(ours.select("row", "hash").join(_sent(cut(rare)), "hash").select("row", "item", "view").distinct())

    shared = _sent(pairs).join(_sent(theirs.select("item", "view", "words", "hash").distinct()), ["item", "view"])
    met = ours.join(shared, ["row", "hash"])
    half = F.greatest(F.lit(BLOCK // 2), F.col("words") + 2 * window)  # each span of this length lies in one of the blocks, which overlap
    block = F.floor(F.col("at") / half)
    met = met.withColumn("block", F.explode(F.array(block, block - 1)))
    grouped = met.groupBy("row", "item", "view", "block").agg(*(F.first(c).alias(c) for c in ("doc_id", "key1", "key2")), F.count("*").alias("n"), F.collect_list(F.struct("at", "hash", "slots")).alias("hits"))
    whole = theirs.groupBy("item", "view", "length").agg(F.collect_list(F.struct("place", "hash", "slots")).alias("theirs"))
    judged = grouped.join(whole, ["item", "view"]).select("row", "doc_id", "key1", "key2", "item", "length", "hits", "theirs")
    judged = judged.mapInArrow(_judge(share), "row long, doc_id long, key1 long, key2 long, item long, share double, verbatim boolean")
    best = judged.join(_sent(items.select("item", "item_id")), "item").groupBy("row", "item_id").agg(F.max(F.struct("share", "verbatim")).alias("x"), *(F.first(c).alias(c) for c in ("doc_id", "key1", "key2")))
    return best.select("doc_id", "item_id", "x.share", "x.verbatim", "key1", "key2")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, share, verbatim)`` of each document row and each item found in it.

    An item is found where at least ``share`` of its windows occur at one place
    with consistent slots; ``verbatim`` tells whether all slots are equal too, and
    of several places the one with the largest share counts, then a verbatim one.
    A window counts if two of its words are no placeholders. An item of which
    less than half the windows count, or with less than four such words, is
    looked up literally, in windows no longer than itself; with fewer than three words it is found only in texts that hold
    nothing else. Null or empty items and texts find nothing; rows that repeat
    are each reported; texts that share an item_id are each looked for; null
    doc_ids are kept; texts of any length are searched whole. Other columns are
    not looked at.
    """
    return _found(docs, benchmark, window, share, id_col, text_col, item_col, item_text_col).select("doc_id", "item_id", "share", "verbatim")


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, share: float = SHARE, **items: str) -> DataFrame:
    """``docs``, with all its columns, without the rows in which a benchmark item is found (see :func:`find_leaks`)."""
    one, two = fresh(docs, "_leak1"), fresh(docs, "_leak2")
    found = cut(_found(docs, benchmark, window, share, id_col, text_col, items.get("item_col", "item_id"), items.get("item_text_col", "text")).select(F.col("key1").alias(one), F.col("key2").alias(two)).distinct())
    key1, key2 = row_keys(id_col, text_col)
    return docs.join(_sent(found, 1_000_000), (key1 == F.col(one)) & (key2 == F.col(two)), "left_anti")  # 16 bytes each
