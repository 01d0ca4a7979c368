"""Language-model scores from a log-frequency Bloom filter.

Counts of words and of word pairs are quantised on a log scale: a count of
level q goes into the filter as q entries (key, 1) ... (key, q). A count is read back by probing level after level
until one is missing. The filter is built in segments by hash, each by one reducer from all counts of its keys; pair
probabilities are smoothed by a Dirichlet prior on the base model.

Neither the filter nor the exact word counts travel as a whole: each block of documents hands its words and pairs to
the segments, and gets back the exact counts of the words and the filter's levels of both, in the order of the hashes.
The filter so grows with the input, and all pairs are in it. It is never broadcast, as nothing bounds its size: blocks
and segments have a fixed number of bytes of text on the average, and there are as many of both as the input asks for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Shipped, Vocabulary, written

#: Level q stands for counts from BASE ** (q - 1) up to BASE ** q; K bits of one 64-bit word are set per entry, and BITS
#: are provided for it.
BASE, K, BITS = 1.5, 5, 9.0
ALPHA = 0.1
#: Tokens that a task holds before it hands counts on, and words that it knows by heart.
FLUSH, KNOWN = 2_000_000, 300_000
#: Bytes of text of a block of documents and of a segment of the filter, on the average.
BLOCK_BYTES, SEGMENT_BYTES = 8_000_000, 8_000_000
END, START = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)
_PAIR, _PROBE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xA54FF53A5F1D36F1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair_keys(before: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Keys of tokens, each with the one before it."""
    return mixed(before * _PAIR + t)


def befores(t: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The token before each; the start where a text begins."""
    out = np.empty_like(t)
    out[1:] = t[:-1]
    out[starts] = START
    return out


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of hashes, so that sorted hashes fall into them in order."""
    return ((h >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def levels(counts: np.ndarray) -> np.ndarray:
    """Quantised counts."""
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / math.log(BASE) + 1e-9).astype(np.int64)


def midpoints(level: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the mean of the whole numbers in it; 0 for level 0."""
    low = np.ceil(BASE ** (level - 1.0) - 1e-9)
    return np.where(level > 0, np.maximum(low, (low + np.maximum(low, np.ceil(BASE ** (level * 1.0) - 1e-9) - 1)) / 2), 0.0)


class LogFilter:
    """A Bloom filter of 64-bit words in segments of their own sizes; cuts are the segments' first words.

    No key has a level above `top`, so probing ends there even if all bits are set.
    """

    def __init__(self, words: np.ndarray, cuts: np.ndarray, top: int) -> None:
        self.words, self.cuts, self.top = words, cuts, top

    @staticmethod
    def place(keys: np.ndarray, level: np.ndarray | int, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The word of (key, level) among so many, and the bits in it: one look into memory answers a probe."""
        h = mixed(keys + np.asarray(level).astype(np.uint64) * _PROBE)
        at = ((h >> np.uint64(32)) * np.asarray(size).astype(np.uint64)) >> np.uint64(32)
        mask = np.zeros(len(h), np.uint64)
        for k in range(K):
            mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
        return at.astype(np.int64), mask

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key: level after level is probed until one is missing."""
        out = np.zeros(len(keys), np.int64)
        seg = segment_of(keys, len(self.cuts) - 1)
        first, size = self.cuts[seg], self.cuts[seg + 1] - self.cuts[seg]
        alive = np.flatnonzero(size > 0)
        for level in range(1, self.top + 1):
            if not len(alive):
                break
            at, mask = self.place(keys[alive], level, size[alive])
            alive = alive[(self.words[first[alive] + at] & mask) == mask]
            out[alive] = level
        return out


def filled(keys: np.ndarray, level: np.ndarray, n_words: int) -> np.ndarray:
    """A segment's words with all entries of the keys set."""
    words = np.zeros(n_words, np.uint64)
    for q in range(1, int(level.max(initial=0)) + 1):
        at, mask = LogFilter.place(keys[level >= q], q, n_words)
        order = np.argsort(at, kind="stable")
        at, mask = at[order], mask[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        words[at[first]] |= np.bitwise_or.reduceat(mask, first)
    return words


def by_segment(keys: np.ndarray, counts: np.ndarray | None, segments: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Sorted keys (and counts) of each segment that has any, as bytes."""
    cuts = np.searchsorted(segment_of(keys, segments), np.arange(segments + 1))
    for s in range(segments):
        if cuts[s] < cuts[s + 1]:
            own = slice(cuts[s], cuts[s + 1])
            yield s, keys[own].tobytes(), b"" if counts is None else counts[own].astype(np.uint32).tobytes()


def gathered(docs: DataFrame, segments: int) -> DataFrame:
    """Rows (seg, block, pairs, keys, counts): words, or word pairs, of blocks, with their counts in training texts.

    Counts are added up within a task before they travel, so that frequent words and pairs come once a task. Empty
    counts stand for zeros: the keys are of other texts.
    """

    def batch_of(block: int, pairs: bool, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        columns = ([r[0] for r in rows], [block] * len(rows), [pairs] * len(rows), [r[1] for r in rows], [r[2] for r in rows])
        types = (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["seg", "block", "pairs", "keys", "counts"])

    def emit(held: dict[tuple[int, bool], list[np.ndarray]], hashes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for (block, training), some in held.items():
            numbers = np.concatenate(some)
            counts = np.bincount(numbers, minlength=len(hashes))
            order = np.argsort(hashes)
            order = order[counts[order] > 0]
            yield batch_of(block, False, list(by_segment(hashes[order], counts[order] if training else None, segments)))
            t = hashes[numbers]
            pairs = np.sort(pair_keys(befores(t, np.concatenate([[0], np.cumsum([len(x) for x in some])[:-1]])), t))
            first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            yield batch_of(block, True, list(by_segment(pairs[first], np.diff(np.append(first, len(pairs))) if training else None, segments)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, n, last = Vocabulary((int(END),)), {}, 0, None
        for batch in batches:
            for text, block, training in zip(batch.column("text"), batch.column("block").to_pylist(), batch.column("training").to_pylist(), strict=True):
                if n >= FLUSH or (block != last and held):  # a block's rows mostly come together
                    yield from emit(held, words.array())
                    held, n = {}, 0
                    words = Vocabulary((int(END),)) if len(words) > KNOWN else words
                some, last = held.setdefault((block, training), []), block
                some.append(words.numbers(text.as_py(), 1))
                n += len(some[-1])
        if held:
            yield from emit(held, words.array())

    return docs.select("text", "block", "training").mapInArrow(run, "seg int, block long, pairs boolean, keys binary, counts binary")


def added(keys: list[bytes], counts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their total counts."""
    k = np.frombuffer(b"".join(keys), np.uint64)
    c = np.frombuffer(b"".join(c or bytes(len(k) // 2) for k, c in zip(keys, counts, strict=True)), np.uint32).astype(np.int64)
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[first], np.add.reduceat(c, first) if len(first) else c


def segment_filter(words: np.ndarray, n: np.ndarray, twos: np.ndarray, m: np.ndarray) -> LogFilter:
    """A segment of the filter, with all words and pairs that training texts hold."""
    q, r = levels(n[n > 0]), levels(m[m > 0])
    size = int((q.sum() + r.sum()) * BITS / 64) + 1
    both = np.concatenate([q, r])
    return LogFilter(filled(np.concatenate([words[n > 0], twos[m > 0]]), both, size), np.array([0, size]), int(both.max(initial=0)))


def answered(counts: DataFrame) -> DataFrame:
    """Rows (seg, block, pairs, levels, counts, tokens, types): what the filter and the exact counts say to each block.

    Levels and counts (of words only) are those of the block's distinct keys in a segment, in the keys' order. A row
    without a block has the segment's totals.
    """
    names, types = ("seg", "block", "pairs", "levels", "counts", "tokens", "types"), (pa.int32(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64())

    def run(table: pa.Table) -> pa.Table:
        seg = table.column("seg")[0].as_py()
        keys, parts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        places: dict[bool, dict[int, list[int]]] = {False: {}, True: {}}
        for i, (p, block) in enumerate(zip(table.column("pairs").to_pylist(), table.column("block").to_pylist(), strict=True)):
            places[p].setdefault(block, []).append(i)
        known = {p: added([keys[i] for at in of.values() for i in at], [parts[i] for at in of.values() for i in at]) for p, of in places.items()}
        bits = segment_filter(*known[False], *known[True])
        n = known[False][1]
        rows = [(seg, None, None, None, None, int(n.sum()), int((n > 0).sum()))]
        for p, of in places.items():
            level = bits.levels(known[p][0]).astype(np.uint8)
            for block, where in of.items():
                at = np.searchsorted(known[p][0], np.unique(np.frombuffer(b"".join(keys[i] for i in where), np.uint64)))
                rows.append((seg, block, p, level[at].tobytes(), None if p else n[at].tobytes(), None, None))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return counts.groupBy("seg").applyInArrow(run, "seg int, block long, pairs boolean, levels binary, counts binary, tokens long, types long")


class Scorer:
    """The totals that smoothing needs; pull is how many counts the base model weighs in a context."""

    def __init__(self, n_tokens: int, n_types: int, n_docs: int, pull: float) -> None:
        self.n_tokens, self.n_types, self.n_docs, self.pull = n_tokens, n_types, n_docs, pull

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the base probabilities, from counts."""
        return np.log10((counts + ALPHA) / (self.n_tokens + ALPHA * (self.n_types + 1)))

    def log10(self, both: np.ndarray, context: np.ndarray, single: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens after those before them, from the filter's counts of pairs and of words.

        A pair is no more frequent than its words.
        """
        both = np.minimum(both, np.minimum(context, single))
        return np.log10((both + self.pull * 10.0 ** self.base(single)) / (context + self.pull))


def scored(docs: DataFrame, answers: DataFrame, scorer: Scorer) -> DataFrame:
    """Rows (doc_id, n_tokens, n_known, base_score, score), block by block."""
    sent = Shipped(docs.sparkSession, scorer)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    names = schema.names

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, words = sent.value, Vocabulary((int(END),))
        right = right.sort_by("seg")  # segments are ranges of hashes
        pairs = right.column("pairs").to_pylist()

        def joined(column: str, kind: type, p: bool, keys: np.ndarray) -> np.ndarray:
            got = np.frombuffer(b"".join(x for x, q in zip(right.column(column).to_pylist(), pairs, strict=True) if q == p), kind)
            if len(got) != len(keys):
                raise ValueError(f"a block has {len(keys)} keys and {len(got)} answers: the input's rows changed between two reads")
            return got

        parts: list[tuple[np.ndarray, ...]] = []

        def part(held: list[np.ndarray]) -> None:
            """Takes up texts: numbers of tokens, sizes, distinct pairs and each token's place among them."""
            sizes, numbers, hashes = np.array([len(t) for t in held]), np.concatenate(held), words.array()
            some, where = np.unique(pair_keys(befores(hashes[numbers], np.cumsum(sizes) - sizes), hashes[numbers]), return_inverse=True)
            parts.append((numbers, sizes, some, where.astype(np.int32)))

        held, n = [], 0
        for text in left.column("text"):
            held.append(words.numbers(text.as_py(), 1))
            n += len(held[-1])
            if n >= 1_000_000:
                part(held)
                held, n = [], 0
        if held:
            part(held)
        out: tuple[list, ...] = ([], [], [], [])
        if parts:
            keys, place = np.unique(words.array(), return_inverse=True)
            exact, single = joined("counts", np.int64, False, keys)[place], midpoints(joined("levels", np.uint8, False, keys).astype(np.int64))[place]
            keys = np.unique(np.concatenate([p[2] for p in parts]))
            level = joined("levels", np.uint8, True, keys)
        for numbers, sizes, some, where in parts:
            first = np.cumsum(sizes) - sizes
            both = midpoints(level[np.searchsorted(keys, some)].astype(np.int64))[where]
            q = single[numbers]
            context = np.empty_like(q)
            context[1:] = q[:-1]
            context[first] = model.n_docs
            for column, value in zip(out, (sizes, np.add.reduceat(exact[numbers] > 0, first, dtype=np.int64), np.add.reduceat(model.base(exact)[numbers], first), np.add.reduceat(model.log10(both, context, q), first)), strict=True):
                column.extend(value.tolist())
        return pa.Table.from_arrays([left.column("doc_id").combine_chunks(), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))], names=names)

    return docs.select("doc_id", "text", "block").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)


def placed(docs: DataFrame, learn: Column) -> DataFrame:
    """Rows (doc_id, text, training, file, row): each row's place in a Parquet file, the same however a scan is split."""
    columns = ("doc_id", "text", learn.alias("training"))
    place = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        if "_metadata" not in map(str.lower, docs.columns):
            return docs.select(*columns, *place)
    except AnalysisException:  # not rows of Parquet files
        pass
    return written(docs.select(*columns), "lm").select("doc_id", "text", "training", *place)


def score(docs: DataFrame, training: Column | None = None, *, segments: int | None = None, pull: float = 1000.0) -> DataFrame:
    """Rows doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs.

    The model learns from the rows where `training` holds (null: all). Null and empty texts are an end alone. Without
    training rows every count is 0 and both scores come from smoothing. Repeated rows are scored alike. Other columns
    of the input are not looked at. Blocks are runs of rows of a file, which don't hang on how a scan is split; an input
    whose rows have no place in a file is written first. A text of any length is in one block.
    """
    learn = F.lit(True) if training is None else F.coalesce(training, F.lit(False))
    rows = placed(docs, learn)
    sums = rows.agg(F.count("*").alias("n"), F.count_if("training").alias("learned"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    if segments is None:
        segments = max(8, -(-sums.bytes // SEGMENT_BYTES))
    rows_a_block = max(1, sums.n * BLOCK_BYTES // max(1, sums.bytes))
    block = F.xxhash64("file", F.floor(F.col("row") / rows_a_block))
    blocks = rows.select("doc_id", "text", block.alias("block"), "training")
    model = written(answered(gathered(blocks, segments)), "lm-model")
    totals = model.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    out = scored(blocks, model.where("block is not null").select("seg", "block", "pairs", "levels", "counts"), Scorer(totals.tokens, totals.types, sums.learned, pull))
    return out.select("doc_id", "n_tokens", "n_known", F.lit(totals.tokens).cast("long").alias("train_tokens"), "base_score", "score")
