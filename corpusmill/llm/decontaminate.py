"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of WINDOW consecutive words of the benchmark items. Blocks of two words index a shift
table that skips positions where no window can end; where the shift is 0, the hash of the words up to there selects a
bucket of windows, and comparing all words confirms an occurrence. Words are numbers and all tables flat arrays: about
25 bytes a window, and a dictionary of the benchmark's distinct words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shipped, clean, extend, private, written

WINDOW = 10
#: Benchmark text that one pass over the documents searches for; more of it takes more passes.
PASS_BYTES = 16_000_000
#: ASCII letters in lower case, digits and all bytes beyond ASCII make words; the rest separates them.
_TABLE = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_K = np.uint64(0x9E3779B97F4A7C15)


def split_words(text: str | None) -> list[bytes]:
    """Words of a text, lower-cased, as UTF-8."""
    return clean(text).translate(_TABLE).split()


def hashed(numbers: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of so many numbers that begin at the starts."""
    total = np.full(len(starts), length, np.uint64)
    for i in range(length):
        total = (total ^ (total >> np.uint64(29))) * _K + numbers[starts + i]
    return total ^ (total >> np.uint64(32))


class Windows:
    """Shift table and buckets for the windows of one length, which begin at `starts` in the items' words."""

    def __init__(self, length: int, numbers: np.ndarray, starts: np.ndarray, items: np.ndarray) -> None:
        self.length, self.block, self.numbers = length, min(2, length), numbers
        self.bits = max(8, int(4 * len(starts)).bit_length())
        self.shift = np.full(1 << self.bits, length - self.block + 1, np.uint8)
        for end in range(self.block, length + 1):  # from far to near: what is written later is less
            self.shift[self.place(numbers, starts + end - self.block)] = length - end
        keys = hashed(numbers, starts, length)
        order = np.lexsort((items, keys))
        again = np.concatenate([[False], (keys[order][1:] == keys[order][:-1]) & (items[order][1:] == items[order][:-1]) & self.same(starts[order][1:], starts[order][:-1])])
        order = order[~again]
        self.keys, self.starts, self.items = keys[order], starts[order].astype(np.uint32), items[order].astype(np.uint32)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for i in range(self.length):
            out &= self.numbers[a + i] == self.numbers[b + i]
        return out

    def place(self, numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where the blocks that begin at the starts stand in the shift table; blocks that clash share the least shift."""
        return (hashed(numbers, starts, self.block) >> np.uint64(64 - self.bits)).astype(np.int64)

    def search(self, numbers: np.ndarray) -> list[tuple[int, list[int]]]:
        """Where occurrences begin, in order, and the items of each."""
        n, length, out = len(numbers), self.length, []
        if n < length or not len(self.keys):
            return out
        shifts = self.shift[self.place(numbers, np.arange(length - self.block, n - self.block + 1))]
        if shifts.all():
            return out
        skip, at, found = shifts.tobytes(), 0, []
        while at < len(skip):
            if skip[at]:
                at += skip[at]
            else:
                found.append(at)
                at += 1
        begins = np.array(found, np.int64)
        keys = hashed(numbers, begins, length)
        low, high = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        for k in np.flatnonzero(high > low).tolist():
            rows = np.arange(low[k], high[k])
            equal = (self.numbers[self.starts[rows].astype(np.int64)[:, None] + np.arange(length)] == numbers[begins[k] : begins[k] + length]).all(axis=1)
            if equal.any():
                out.append((int(begins[k]), self.items[rows[equal]].tolist()))
        return out


class Searcher:
    """The windows of all lengths, the numbers of the benchmark's words and the names of its items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW) -> None:
        self.number: dict[bytes, int] = {}
        self.names = sorted({i for i, _ in items})
        of = {name: k for k, name in enumerate(self.names)}
        parts, at, by = [], 0, {}
        for item, text in items:
            words = split_words(text)
            if not words:
                continue
            length = min(window, len(words))
            parts.append(np.array([self.number.setdefault(w, len(self.number) + 1) for w in words], np.uint32))
            starts = np.arange(at, at + len(words) - length + 1)
            by.setdefault(length, []).append((starts, np.full(len(starts), of[item])))
            at += len(words)
        numbers = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        self.tables = [Windows(k, numbers, *(np.concatenate([x[i] for x in by[k]]) for i in (0, 1))) for k in sorted(by)]

    def search(self, texts: list[str | None]) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """For each text: number of words, ranges of words that are hit, and items with an occurring window.

        The texts are searched as one, with a number that no window holds between them.
        """
        get, parts = self.number.get, []
        for text in texts:
            words = split_words(text)
            numbers = np.zeros(len(words) + 1, np.uint32)
            numbers[:-1] = [get(w, 0) for w in words]
            parts.append(numbers)
        ends = np.cumsum([len(p) for p in parts])
        out: list = [(len(p) - 1, [], set()) for p in parts]
        together = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        for table in self.tables:
            for begin, items in table.search(together):
                k = int(np.searchsorted(ends, begin, "right"))
                at = begin - int(ends[k]) + len(parts[k])
                out[k][1].append((at, at + table.length))
                out[k][2].update(self.names[i] for i in items)
        return out


def some_at_a_time(texts: list[str | None], chars: int = 2_000_000) -> Iterator[list[str | None]]:
    """The texts in groups of a bounded number of characters, a longer text alone."""
    held, n = [], 0
    for text in texts:
        if held and n + len(text or "") > chars:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text or "")
    if held:
        yield held


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of ranges, sorted and disjoint."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("hits", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])


def scan(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, pass_bytes: int = PASS_BYTES, drop: tuple[str, ...] = ()) -> DataFrame:
    """Adds n_words, n_hit, items (sorted ids of items with an occurring window), hits (word ranges) and contaminated.

    Null and empty texts have no words and no hits; items without words occur nowhere. A null item_id counts as an item
    named by the empty string, rows that repeat an item_id as one item; equal rows of the benchmark count once. Repeated
    documents are judged alike, an empty table gives an empty table. Other columns stay, except those named like an
    output. The benchmark is read in passes of about pass_bytes (an item is never cut, so a longer one is a pass of its
    own size): each broadcasts the tables of its items alone. Where there are several, what a pass found is written
    before the next, so that a task holds the tables of one pass, however large the benchmark is.
    """
    spark = docs.sparkSession
    keyed = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    size = keyed.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-size // pass_bytes))
    held = private(docs, "found")
    out, made = docs, T.StructType([T.StructField(held, FOUND)])
    for k in range(passes):
        part = keyed.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k)
        sent = Shipped(spark, Searcher(sorted(((r.item, r.text) for r in part.collect()), key=repr), window))

        def fill(batch: pa.RecordBatch, sent=sent, first: bool = not k) -> list[list]:  # noqa: ANN001
            before = [None] * batch.num_rows if first else batch.column(held).to_pylist()
            rows = []
            texts = batch.column("text").to_pylist()
            for (n, hits, items), had in zip((x for some in some_at_a_time(texts) for x in sent.value.search(some)), before, strict=True):
                if had:
                    items |= set(had["items"])
                    hits += [(s["start"], s["end"]) for s in had["hits"]]
                hits = merged(hits)
                rows.append({"n_words": n, "n_hit": sum(b - a for a, b in hits), "items": sorted(items), "hits": [{"start": a, "end": b} for a, b in hits]})
            return [rows]

        out = extend(out, made, fill, drop if k == passes - 1 else ())
        out = written(out, "decontamination") if k < passes - 1 else out
    out = out.withColumns({f.name: F.col(held)[f.name] for f in FOUND}).drop(held)
    return out.withColumn("contaminated", F.col("n_hit") > 0)
