"""Native regex spans: where matches lie, in code points, and digests and redactions made from them.

No step is quadratic in a text's length or in its number of matches: running values come from log-step scans, overlaps
from binary searches, and pieces of a text from its chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

NO_SPANS = "array<struct<start:int,end:int,text:string>>"
#: Characters of a chunk, 2 to the CHUNK_BITS.
CHUNK_BITS = 10


def _power(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), k)


def scanned(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running values of an array: each element combined with all before it, in as many passes as its size has bits.

    `combine` gets null where nothing is before.
    """

    def of(v: Column) -> Column:
        def doubled(acc: Column, k: Column) -> Column:
            return F.transform(acc, lambda x, i: combine(x, F.get(acc, i - _power(k))))

        last = F.floor(F.log2((F.size(v) - 1).cast("double"))).cast("int")
        return F.when(F.size(v) <= 1, v).otherwise(F.aggregate(F.sequence(F.lit(0), last), v, doubled))

    return let(values, of)


def sums(values: Column) -> Column:
    """Running sums."""
    return scanned(values, lambda x, y: x + F.coalesce(y, F.lit(0)))


def maxima(values: Column) -> Column:
    """Running maxima."""
    return scanned(values, lambda x, y: F.greatest(x, y))


def below(values: Column, limit: Column) -> Column:
    """How many elements of a sorted array are less than a limit, by binary search."""
    highest = F.floor(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    return F.aggregate(F.sequence(highest, F.lit(0), F.lit(-1)), F.lit(0), lambda at, k: F.when(F.get(values, at + _power(k) - 1) < limit, at + _power(k)).otherwise(at))


def find(text: Column, pattern: str, when: Column | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as array<struct<start, end, text>>, end exclusive.

    A split gives the gaps, a second search the matches; running lengths of both give the places. `when` is a cheap
    test that a text must pass to be searched at all.
    """
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("got"))

    def placed(p: Column) -> Column:
        ends = sums(F.transform(p["got"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m)))
        return let(ends, lambda e: F.transform(p["got"], lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.get(e, i).alias("end"), m.alias("text"))))

    fits = text.rlike(pattern) if when is None else when & text.rlike(pattern)
    return F.when(fits, let(parts, placed)).otherwise(F.array().cast(NO_SPANS))


def kinds(found: dict[str, Column]) -> Column:
    """One array of struct<start, order, end, kind, text>, sorted by start and then by the kinds' order."""

    def one(order: int, kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))

    return F.sort_array(F.concat(*(one(o, k, spans) for o, (k, spans) in enumerate(found.items()))))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str) -> Column:
    """Number of spans of a kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def clear_of(spans: Column, taken: Column) -> Column:
    """Those of the spans that share no character with any of `taken`, which is sorted by start."""
    reach = F.struct(F.transform(taken, lambda s: s["start"]).alias("starts"), maxima(F.transform(taken, lambda s: s["end"])).alias("ends"))

    def outside(r: Column) -> Column:
        # of those that begin before a span's end, the one that reaches farthest decides
        return F.filter(spans, lambda s: F.coalesce(F.get(r["ends"], below(r["starts"], s["end"]) - 1) <= s["start"], F.lit(True)))

    return F.when((F.size(spans) == 0) | (F.size(taken) == 0), spans).otherwise(let(reach, outside))


def chunked(text: Column) -> Column:
    """A text's chunks of 2 ** CHUNK_BITS characters; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}+"), F.lit(0))


def piece(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end of a text of which the chunks are given."""
    first, last = F.shiftright(start, CHUNK_BITS), F.shiftright(end, CHUNK_BITS)
    at, rest = start.bitwiseAND((1 << CHUNK_BITS) - 1), end.bitwiseAND((1 << CHUNK_BITS) - 1)
    within = F.substring(F.get(chunks, first), at + 1, end - start)
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    across = F.concat(F.substring(F.get(chunks, first), at + 1, F.lit(1 << CHUNK_BITS)), middle, F.coalesce(F.substring(F.get(chunks, last), F.lit(1), rest), F.lit("")))
    return F.when(end <= start, F.lit("")).when(first == last, within).otherwise(across)


def replaced(text: Column, spans: Column, by: Callable[[Column], Column]) -> Column:
    """The text with each span, in order of start, replaced; what an earlier span covers isn't replaced again."""

    def of(p: Column) -> Column:
        before = lambda i: F.coalesce(F.get(p["ends"], i - 1), F.lit(0))
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(p["chunks"], before(i), s["start"]), by(s))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), piece(p["chunks"], F.element_at(p["ends"], -1), F.length(text)))

    made = F.struct(chunked(text).alias("chunks"), maxima(F.transform(spans, lambda s: s["end"])).alias("ends"))
    return F.when(F.size(spans) == 0, text).otherwise(let(made, of))
