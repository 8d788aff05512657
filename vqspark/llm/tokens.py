"""Exact token counts of a byte-level BPE vocabulary at every prefix of a text.

Byte pair encoding of a string is the one sequence of tokens in which each
neighbouring pair is stable, that is, encodes to itself. So the last token of a
prefix of length i is the one token t, ending at i, that is stable after the last
token of the prefix of length i - len(t). This dynamic program gives the count at
each prefix of a pre-token; pre-tokens are counted one after the other. Counts at
all pre-token ends are stored, and any prefix or budget is answered from them and
the program's values inside one pre-token, without encoding the text again.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the white space of Unicode.
WHITE = "\t-\r \x85\xa0  -     　"
#: A worker's memos of chunks, pre-tokens and pairs of tokens are emptied when they hold this many entries.
MEMO, PIECE_MEMO, PAIR_MEMO = 300_000, 700_000, 1_500_000
#: Bytes from which a run of one byte is counted by its period, and characters a token that are looked at first for a budget.
RUN, FIRST_LOOK = 512, 8


def _class_of(kind: str) -> str:
    """Ranges of the code points whose category starts with ``kind``, for a character class."""
    found, start = [], None
    for c in range(sys.maxunicode + 2):
        own = c <= sys.maxunicode and unicodedata.category(chr(c))[0] == kind
        if own and start is None:
            start = c
        elif not own and start is not None:
            found.append(f"{re.escape(chr(start))}-{re.escape(chr(c - 1))}")
            start = None
    return "".join(found)


@lru_cache(maxsize=1)
def _splitter() -> re.Pattern:
    letters, numbers = _class_of("L"), _class_of("N")
    words = "'s|'t|'re|'ve|'m|'ll|'d"
    return re.compile(f"{words}| ?[{letters}]+| ?[{numbers}]+| ?[^{WHITE}{letters}{numbers}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@lru_cache(maxsize=1)
def _white_space() -> frozenset[str]:
    return frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c))


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write the bytes that are printable in Latin-1 as themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


class _Memo(dict):
    """Values made on demand; emptied when full."""

    def __init__(self, make, most=MEMO):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class PrefixCounter:
    """Counts of the vocabulary in a tokenizer file of kind BPE with a byte-level pre-tokenizer.

    Added tokens that stand in a text count as one token and split it, which is the library's default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer or prefix space")
        of = _byte_of_symbol()
        plain = lambda symbols: bytes(of[c] for c in symbols)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {plain(t): n for t, n in spec["model"]["vocab"].items() if t not in self.special}
        self.texts = {n: t for t, n in self.tokens.items()} | {-1: b""}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(plain(a), plain(b)): n for n, (a, b) in enumerate(pairs)}
        self.reach: dict[bytes, int] = {}  # how long a token with these last three bytes can be
        for t in self.tokens:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        self.split = _splitter().findall
        self.stable = _Memo(self._is_stable, PAIR_MEMO)
        self.chunk = _Memo(lambda text: sum(map(self.whole.__getitem__, self.split(text))))
        self.whole = _Memo(self._whole_count, PIECE_MEMO)
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def _merged(self, text: bytes) -> list[bytes]:
        """Byte pair encoding by merging the pair of the lowest rank again and again; for short strings."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(p, sys.maxsize), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == sys.maxsize:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _is_stable(self, pair: int) -> bool:
        """Of the tokens whose ids are the high and the low part of ``pair``; -1 is the empty beginning."""
        both = self.texts[pair >> 32], self.texts[pair & 0xFFFFFFFF]
        return self._merged(both[0] + both[1]) == [x for x in both if x]

    def piece(self, text: bytes) -> list[int]:
        """Token counts of the prefixes of length 0, 1, ... of one pre-token.

        In a run of one byte the next token follows from those that end at the
        last few places. Once these come again, the counts repeat with a constant gain.
        """
        find, stable, reach = self.tokens.get, self.stable, self.reach.get
        last, count = [-1 << 32], [0]
        far = reach(text[:3], 2) if len(text) > RUN and text == text[:1] * len(text) else 0
        seen: dict[tuple, int] = {}
        for end in range(1, len(text) + 1):
            if far and end > far + 3:
                now = tuple(last[-far:])
                if now in seen:
                    return self._repeated(count, seen[now], len(text))
                seen[now] = end - 1
            for start in range(max(0, end - reach(text[max(0, end - 3) : end], 2)), end):
                token = find(text[start:end])
                if token is not None and stable[last[start] | token]:
                    last.append(token << 32)
                    count.append(count[start] + 1)
                    break
            else:
                raise ValueError("a byte isn't in the vocabulary")
        return count

    @staticmethod
    def _repeated(count: list[int], since: int, n: int) -> list[int]:
        """Counts at 0 to n of which those behind ``since`` come again and again."""
        period, gain = len(count) - 1 - since, count[-1] - count[since]
        at = np.arange(len(count), n + 1) - since - 1
        times, rest = at // period, at % period + since + 1
        return count + (np.array(count)[rest] + times * gain).tolist()

    def _whole_count(self, text: str) -> int:
        raw = text.encode("utf-8", "surrogatepass")
        token = self.tokens.get(raw)
        return 1 if token is not None and self.stable[-1 << 32 | token] else self.piece(raw)[-1]

    def _unstored(self, text: str) -> int:
        """Of the beginning of a pre-token, or of white space."""
        return sum(self.piece(p.encode("utf-8", "surrogatepass"))[-1] for p in self.split(text))

    def _plain_count(self, text: str) -> int:
        """Of a text without added tokens. Single spaces always begin a pre-token, so the chunks between them can be counted apart."""
        if not text:
            return 0
        if "  " in text or text[-1] == " ":
            return sum(map(self.whole.__getitem__, self.split(text)))
        first, *rest = text.split(" ")
        return (self.chunk[first] if first else 0) + sum(map(self.chunk.__getitem__, [" " + x for x in rest]))

    def count(self, text: str) -> int:
        if self.specials is None or not self.specials.search(text):
            return self._plain_count(text)
        total, at = 0, 0
        for m in self.specials.finditer(text):
            total += self._plain_count(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain_count(text[at:])

    def count_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """Tokens of the text, and the length of its longest prefix of at most ``budget`` tokens.

        The counts at the ends of chunks tell where the budget is exceeded; only
        the chunks around it are looked at by the program. They begin and end
        where no white space goes on, so nothing outside changes their tokens.
        """
        if not text or "  " in text or text[-1] == " " or (self.specials is not None and self.specials.search(text)):
            total = self.count(text)
            return total, fit_chars(self, text, total, budget)
        first, *rest = text.split(" ")
        chunks = [first, *(" " + x for x in rest)]
        counts = [self.chunk[first] if first else 0, *map(self.chunk.__getitem__, chunks[1:])]
        total = sum(counts)
        if total <= budget:
            return total, len(text)
        white = _white_space()
        sure = lambda j: not chunks[j] or chunks[j][-1] not in white
        end, until = 0, counts[0]
        while until <= budget or not sure(end):
            if end + 1 == len(chunks):
                return total, fit_chars(self, text, total, budget)
            end += 1
            until += counts[end]
        start = end
        while start and (not sure(start - 1) or until - sum(counts[start : end + 1]) > budget):
            start -= 1
        before = until - sum(counts[start : end + 1])
        return total, sum(map(len, chunks[:start])) + self.index("".join(chunks[start : end + 1])).fit(budget - before)

    def index(self, text: str) -> PrefixIndex:
        return PrefixIndex(self, text)


class PrefixIndex:
    """Counts at the ends of all pre-tokens of a text; answers for any prefix of it, in code points."""

    def __init__(self, counter: PrefixCounter, text: str):
        self.counter, self.text = counter, text
        self.span, self.inside, self.run = (0, 0), [0], False  # the pre-token or run of white space looked at last, and its counts
        self.segments, pieces, at = [], [], 0
        for m in counter.specials.finditer(text) if counter.specials else ():
            self.segments.append((at, m.start(), m.end()))
            pieces += [(p, False) for p in counter.split(text[at : m.start()])] + [(m.group(), True)]
            at = m.end()
        self.segments.append((at, len(text), len(text)))
        pieces += [(p, False) for p in counter.split(text[at:])]
        self.ends = [0, *accumulate(len(p) for p, _ in pieces)]
        self.counts = [0, *accumulate(1 if whole else counter.whole[p] for p, whole in pieces)]

    def _region(self, length: int) -> tuple[int, int] | None:
        """``(start, base)`` where the prefix ends within ``span``, which begins at ``start`` with ``base`` tokens before; None where it must be counted anew."""
        low, high, end = self.segments[bisect_right(self.segments, length, key=lambda s: s[0]) - 1]
        if high < length < end or length == low:
            return None
        k = bisect_left(self.ends, length)
        start, stop = self.ends[k - 1], self.ends[k]
        white = self._white(length - 1)
        if white and self.run and self.span[0] < length <= self.span[1]:
            start, stop = self.span
            k = bisect_left(self.ends, start) + 1
        elif white:
            while self.ends[k - 1] > low and self._white(self.ends[k - 1] - 1):
                k -= 1
            start, stop = self.ends[k - 1], length
            while stop < high and self._white(stop):
                stop += 1
        if self.text[start] == "'":  # may be a contraction, whose beginning isn't one
            return None
        if self.span != (start, stop):
            piece = self.text[start:stop]
            counts = self.counter.piece(piece.encode("utf-8", "surrogatepass"))
            if not piece.isascii():
                counts = [counts[n] for n in accumulate((len(c.encode("utf-8", "surrogatepass")) for c in piece), initial=0)]
            self.span, self.inside = (start, stop), counts
        self.run = white
        return start, self.counts[k - 1]

    def at(self, length: int) -> int:
        """Exact number of tokens of ``text[:length]``."""
        length = max(0, min(length, len(self.text)))
        if not length:
            return 0
        if region := self._region(length):
            return region[1] + self.inside[length - region[0]]
        low, high, end = self.segments[bisect_right(self.segments, length, key=lambda s: s[0]) - 1]
        if high < length < end:  # inside an added token, whose beginning is ordinary text
            return self.counts[bisect_left(self.ends, low)] + self.counter.count(self.text[low:length])
        if length == low:  # at the end of an added token
            return self.counts[bisect_left(self.ends, length)]
        k = bisect_left(self.ends, length)
        return self.counts[k - 1] + self.counter._unstored(self.text[self.ends[k - 1] : length])

    def _white(self, at: int) -> bool:
        return self.text[at] in _white_space()

    def fit(self, budget: int) -> int:
        """Length of the longest prefix of at most ``budget`` tokens."""
        budget = max(0, budget)
        if self.counts[-1] <= budget:
            return len(self.text)
        k = bisect_right(self.counts, budget)
        while k < len(self.counts) - 1 and self._white(self.ends[k] - 1):  # a longer run of white space may need fewer tokens
            k += 1
        length = self.ends[k]
        while length > 0:
            if region := self._region(length):
                start, base = region
                found = np.nonzero(np.array(self.inside[1 : length - start + 1]) <= budget - base)[0]
                if len(found):
                    return start + int(found[-1]) + 1
                length = start
            elif self.at(length) <= budget:
                return length
            else:
                length -= 1
        return 0


def fit_chars(counter: PrefixCounter, text: str, n_tokens: int, budget: int) -> int:
    """Length of the longest prefix of at most ``budget`` tokens; of a long text only as much is indexed as that needs.

    No prefix behind a pre-token at which the budget is exceeded has fewer tokens; the last few pre-tokens of a part aren't yet sure.
    """
    if n_tokens <= budget:
        return len(text)
    size = FIRST_LOOK * (budget + 16)
    while size < len(text):
        index = counter.index(text[:size])
        sure = [n for n, end in zip(index.counts[:-4], index.ends) if end and not index._white(end - 1)]
        if sure and sure[-1] > budget:
            return index.fit(budget)
        size *= 4
    return counter.index(text).fit(budget)


@lru_cache(maxsize=2)
def counter_of(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", budget: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``, and with a ``budget`` ``fit_chars``.

    ``vocabulary`` is the path of the tokenizer file, the same on all machines.
    ``fit_chars`` is the length, in code points, of the longest prefix of at most
    ``budget`` tokens. A null text counts as empty; null ids and repeated rows are
    kept; other columns are not looked at; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [(counter.count(x or ""), None) for x in texts] if budget is None else [counter.count_and_fit(x or "", budget) for x in texts]
            columns = [batch.column(0), pa.array([n for n, _ in found], pa.int64()), batch.column(2)]
            names = ["doc_id", "n_tokens", "n_bytes"]
            if budget is not None:
                columns.append(pa.array([n for _, n in found], pa.int64()))
                names.append("fit_chars")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), size)
    schema = "doc_id long, n_tokens long, n_bytes long" + (", fit_chars long" if budget is not None else "")
    counted = own.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", *(["fit_chars"] if budget is not None else []))


def prefix_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ends, counts``, to be stored; the exact number of tokens at the end (in code points) of each pre-token.

    :func:`tokens_until` and :func:`longest_within` answer from these arrays
    without the text. Null texts have empty arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                found = [counter.index(x or "") for x in part.column(1).to_pylist()]
                lists = [pa.array([getattr(x, name)[1:] for x in found], pa.list_(pa.int32())) for name in ("ends", "counts")]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "ends", "counts"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, ends array<int>, counts array<int>")


def tokens_until(length: Column) -> Column:
    """Of rows of :func:`prefix_counts`: tokens of the whole pre-tokens within the first ``length`` code points."""
    return F.coalesce(F.get("counts", F.size(F.filter("ends", lambda e: e <= length)) - 1), F.lit(0))


def longest_within(budget: Column) -> Column:
    """Of rows of :func:`prefix_counts`: code points up to the last pre-token whose end is within ``budget`` tokens."""
    return F.coalesce(F.get("ends", F.size(F.filter("counts", lambda c: c <= budget)) - 1), F.lit(0))
