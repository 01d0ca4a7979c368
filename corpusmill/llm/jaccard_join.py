"""Similarity join on word shingles by vertical partitioning: all links, by 51 bits or more of each shingle's hash.

The global order of shingles is cut into fragments. Texts with equal shingle sets are one class. Within each fragment
the classes that hold a shingle are counted; shingles of one class only can't be in any overlap, and classes with too
few others can't link. The rest put the shingles of their prefix (the rarest that any partner must share) up for
meeting; a candidate pair's overlap is counted in each fragment separately and summed per pair.

For components not every pair need be compared: star rounds first compare each class with the best leader of its
prefix shingles and merge what links; then all pairs that still lie in different components and meet in a prefix are
compared, so that no link between components is lost. Of such a pair the class with fewer shingles has the shared one
among its first ninth, the other within its prefix, and their sizes lie in the same or in neighbouring classes of size:
texts that share much of a template without linking don't meet. Small tables get as many tasks as their rows ask for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Vocabulary, stored
from .graph import components, tasks

WORDS = 5
#: Fragments that a pair's overlap is summed over, and star rounds before the full comparison.
FRAGMENTS, STAR_ROUNDS = 4, 2
#: Shingles that a map task holds before it hands them on, and that a segment of the order holds on the average; words
#: that a task knows by heart.
FLUSH, SEGMENT_SHINGLES, KNOWN, CHUNK = 1_500_000, 2_500_000, 300_000, 300_000
#: Bits of a shingle's hash that travel within a segment, and bytes of a class's name.
BITS, NAME = 48, 12
_K = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finishes a hash so that all its bits depend on all others."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingled(texts: Iterator[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; a shorter text's words make one; none without words."""

    def made(numbers: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(numbers):
            return np.zeros(0, np.uint64)
        h = hashes[numbers]
        width = min(words, len(h))
        total = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            total = total * _K + h[i : len(h) - width + 1 + i]
        return np.unique(mixed(total))

    known, held, n = Vocabulary(), [], 0
    for text in texts:
        held.append(known.numbers(text))
        n += len(held[-1])
        if n >= CHUNK:  # the table of hashes is made once for many texts
            hashes = known.array()
            yield from (made(x, hashes) for x in held)
            held, n = [], 0
            known = Vocabulary() if len(known) > KNOWN else known
    hashes = known.array()
    yield from (made(x, hashes) for x in held)


def class_of(found: np.ndarray) -> bytes | None:
    """A 96-bit name of a shingle set; None for the empty set."""
    return xxhash.xxh3_128_digest(found.tobytes())[:NAME] if len(found) else None


def sketched(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows (doc_id, n_shingles, cls)."""
    schema = docs.select("doc_id").schema.add("n_shingles", "long").add("cls", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(len(s), class_of(s)) for s in shingled((t.as_py() for t in batch.column("text")), words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([c for _, c in made], pa.binary())], names=["doc_id", "n_shingles", "cls"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed(h: np.ndarray) -> bytes:
    """The low BITS bits of hashes, 4 bytes of each and then 2 of each: a segment's hashes share the high ones."""
    return h.astype(np.uint32).tobytes() + (h >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 6
    return np.frombuffer(blob, np.uint32, n).astype(np.uint64) | (np.frombuffer(blob, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def rank_of(df: np.ndarray) -> np.ndarray:
    """A byte that grows with the number of classes: the global order is by it and then by hash, alike for all classes."""
    return np.floor(7 * np.log2(df)).astype(np.uint8)


def fragmented(docs: DataFrame, segments: int, words: int = WORDS) -> DataFrame:
    """Rows (seg, hashes, classes, sizes, runs): the shingles of each class in a segment of the order, many classes a row.

    A task hands on each class once; copies in other tasks are dropped where the segments meet.
    """

    def emit(sets: list[np.ndarray], names: list[bytes]) -> pa.RecordBatch:
        everything = np.concatenate(sets)
        cls = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        seg = ((everything >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(seg, kind="stable")
        everything, cls, seg = everything[order], cls[order], seg[order]
        cuts = np.searchsorted(seg, np.arange(segments + 1))
        name, size = np.frombuffer(b"".join(names), f"V{NAME}"), np.array([len(x) for x in sets], np.int32)
        rows: tuple[list, ...] = ([], [], [], [], [])
        for s in range(segments):
            a, b = cuts[s], cuts[s + 1]
            if a < b:
                own, runs = np.unique(cls[a:b], return_counts=True)
                for column, value in zip(rows, (s, packed(everything[a:b]), name[own].tobytes(), size[own].tobytes(), runs.astype(np.int32).tobytes()), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["seg", "hashes", "classes", "sizes", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        sets, names, held = [], [], 0
        for found in shingled((t.as_py() for batch in batches for t in batch.column("text")), words):
            name = class_of(found)
            if name is None or name in seen:
                continue
            seen.add(name)
            sets.append(found)
            names.append(name)
            held += len(found)
            if held >= FLUSH:
                yield emit(sets, names)
                sets, names, held = [], [], 0
        if sets:
            yield emit(sets, names)

    return docs.select("text").mapInArrow(run, "seg int, hashes binary, classes binary, sizes binary, runs binary")


def shared(held: DataFrame, segments: int) -> DataFrame:
    """Rows (bucket, seg, classes, sizes, counts, hashes, dfs): each class's shingles that other classes have too.

    A row holds many classes, those of a bucket of names. dfs is rank_of the number of classes of each shingle.
    """
    names_of = ["bucket", "seg", "classes", "sizes", "counts", "hashes", "dfs"]

    def run(table: pa.Table) -> pa.Table:
        seg = table.column("seg")[0].as_py()
        classes, sizes, runs = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("classes", f"V{NAME}"), ("sizes", np.int32), ("runs", np.int32)))
        hashes = np.concatenate([unpacked(x.as_py()) for x in table.column("hashes")])
        names, first = np.unique(classes, return_index=True)
        starts = np.concatenate([[0], np.cumsum(runs)[:-1]])[first]
        runs, sizes = runs[first], sizes[first]
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
        h, cls = hashes[at], np.repeat(np.arange(len(names), dtype=np.int32), runs)
        order = np.argsort(h, kind="stable")
        h, cls = h[order], cls[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        df = np.diff(np.append(np.flatnonzero(new), len(h)))[np.cumsum(new) - 1]
        keep = df > 1
        h, cls, df = h[keep], cls[keep], rank_of(df[keep])
        bucket = bucket_of(names, segments)
        order = np.lexsort((cls, bucket[cls]))
        h, cls, df = h[order], cls[order], df[order]
        cuts = np.searchsorted(bucket[cls], np.arange(segments + 1))
        rows = []
        for k in range(segments):
            a, b = cuts[k], cuts[k + 1]
            if a < b:
                own, counts = np.unique(cls[a:b], return_counts=True)
                rows.append((k, seg, names[own].tobytes(), sizes[own].tobytes(), counts.astype(np.int32).tobytes(), packed(h[a:b]), df[a:b].tobytes()))
        types = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names_of)

    return held.groupBy("seg").applyInArrow(run, "bucket int, seg int, classes binary, sizes binary, counts binary, hashes binary, dfs binary")


def bucket_of(names: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket for each class by its name's first bytes."""
    words = np.frombuffer(names.tobytes(), np.uint32).reshape(-1, NAME // 4)
    return (words[:, 0] % np.uint32(buckets)).astype(np.int64)


def survivors_of(met: DataFrame, segments: int, fragments: int = FRAGMENTS) -> DataFrame:
    """Rows (cls, n, m, parts): the classes with enough shared shingles (m of n) to link, with those by fragment."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("seg", "classes", "sizes", "counts", "hashes", "dfs")), strict=True), key=lambda r: r[0])
        classes, sizes, counts, dfs = (np.frombuffer(b"".join(r[i] for r in rows), t) for i, t in ((1, f"V{NAME}"), (2, np.int32), (3, np.int32), (5, np.uint8)))
        h = np.concatenate([unpacked(r[4]) | np.uint64((r[0] & 0xFFFF) << BITS) for r in rows])
        frag = np.concatenate([np.full(len(r[5]), r[0] * fragments // segments) for r in rows])
        names, where = np.unique(classes, return_inverse=True)
        m, n = np.bincount(where, counts).astype(np.int64), np.zeros(len(names), np.int64)
        n[where] = sizes
        able = 5 * m >= 4 * n
        cls = np.repeat(where, counts)
        keep = able[cls]
        h, dfs, key = h[keep], dfs[keep], cls[keep] * fragments + frag[keep]
        order = np.argsort(key, kind="stable")
        h, dfs, key = h[order], dfs[order], key[order]
        parts: dict[int, list[dict]] = {}
        own, begin = np.unique(key, return_index=True)
        cuts = np.append(begin, len(h)).tolist()
        for k, a, b in zip(own.tolist(), cuts[:-1], cuts[1:], strict=True):
            parts.setdefault(k // fragments, []).append({"frag": k % fragments, "hashes": h[a:b].tobytes(), "dfs": dfs[a:b].tobytes()})
        kind = pa.list_(pa.struct([("frag", pa.int32()), ("hashes", pa.binary()), ("dfs", pa.binary())]))
        columns = [pa.array([names[c].tobytes() for c in parts], pa.binary()), pa.array([int(n[c]) for c in parts], pa.int64()), pa.array([int(m[c]) for c in parts], pa.int64()), pa.array(list(parts.values()), kind)]
        return pa.Table.from_arrays(columns, names=["cls", "n", "m", "parts"])

    return met.groupBy("bucket").applyInArrow(run, "cls binary, n long, m long, parts array<struct<frag:int,hashes:binary,dfs:binary>>")


def pieces(survivors: DataFrame) -> DataFrame:
    """Rows (cls, frag, hashes): each class's shared shingles by fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, parts in zip(batch.column("cls").to_pylist(), batch.column("parts").to_pylist(), strict=True):
                by: dict[int, list[bytes]] = {}
                for p in parts:
                    by.setdefault(p["frag"], []).append(p["hashes"])
                rows += [(name, frag, b"".join(blobs)) for frag, blobs in sorted(by.items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.int32(), pa.binary()))], names=["cls", "frag", "hashes"])

    return survivors.mapInArrow(run, "cls binary, frag int, hashes binary")


def prefixes(survivors: DataFrame) -> DataFrame:
    """Rows (token, cls, n, pos, lone): each shingle of a class's prefix, its place in the class's order.

    The order is by number of classes, then hash; the class's own shingles (lone of them) come first.
    """
    schema = "token long, cls binary, n long, pos int, lone int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for name, n, m, parts in zip(*(batch.column(c).to_pylist() for c in ("cls", "n", "m", "parts")), strict=True):
                h = np.frombuffer(b"".join(p["hashes"] for p in parts), np.uint64)
                df = np.frombuffer(b"".join(p["dfs"] for p in parts), np.uint8)
                lone = n - m
                count = n - (4 * n + 4) // 5 + 1 - lone
                if count > 0:
                    chosen = h[np.lexsort((h, df))[:count]]
                    out[0].extend(chosen.view(np.int64).tolist())
                    out[1].extend([name] * len(chosen))
                    out[2].extend([n] * len(chosen))
                    out[3].extend(range(lone, lone + len(chosen)))
                    out[4].extend([lone] * len(chosen))
            types = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["token", "cls", "n", "pos", "lone"])

    return survivors.mapInArrow(run, schema)


def similar(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b, na, nb) that link, by overlaps counted in each fragment and summed.

    A fragment of either side travels to its pairs; one that a side lacks adds nothing.
    """

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column("ha").to_pylist(), batch.column("hb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "b", "na", "nb")), pa.array(counts, pa.int64())], names=["a", "b", "na", "nb", "part"])

    with_a = pairs.join(parts.select(F.col("cls").alias("a"), "frag", F.col("hashes").alias("ha")), "a")
    with_b = with_a.join(parts.select(F.col("cls").alias("b"), "frag", F.col("hashes").alias("hb")), ["b", "frag"])
    partial = with_b.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(overlap, "a binary, b binary, na long, nb long, part long")
    return partial.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both")).where("9 * both >= 4 * (na + nb)").select("a", "b")


def linked(docs: DataFrame, *, words: int = WORDS, segments: int | None = None, star_rounds: int = STAR_ROUNDS) -> DataFrame:
    """Rows doc_id, n_shingles, component_id for every row of docs.

    Two texts link when 100 * overlap >= 80 * union of their shingle sets. Null, empty and wordless texts have no
    shingles and are components of their own, as their doc_id says. Repeated rows and copies are of one class and so of
    one component; a null doc_id takes part, but names no component unless all its members are null. Other columns of
    the input are not looked at.
    """
    rows = stored(sketched(docs, words))
    if segments is None:
        total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
        segments = max(8, -(-total // SEGMENT_SHINGLES))
    classes = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    survivors = stored(survivors_of(shared(fragmented(docs, segments, words), segments), segments))
    n_survivors = survivors.count()
    parts = pieces(survivors.coalesce(tasks(50 * n_survivors)))
    entries = stored(prefixes(survivors.coalesce(tasks(50 * n_survivors))))
    n_entries = entries.count()
    entries = entries.coalesce(tasks(n_entries))
    links = roots = None
    for turn in range(star_rounds + 1):
        known = entries.withColumn("root", F.col("cls")) if roots is None else entries.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")).coalesce(tasks(n_entries))
        open_tokens = known.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.min(F.struct((F.col("lone") / F.col("n")).alias("r"), F.col("cls").alias("cls"), F.col("n").alias("n"), F.col("root").alias("root"))).alias("lead")).where("lo != hi").coalesce(tasks(n_entries))
        if turn < star_rounds:
            met = known.join(open_tokens.select("token", "lead"), "token").where("root != lead.root and 5 * least(n, lead.n) >= 4 * greatest(n, lead.n)").coalesce(tasks(n_entries))
            votes = met.groupBy("cls", "n", F.col("lead.cls").alias("other"), F.col("lead.n").alias("no")).count()
            best = votes.coalesce(tasks(n_entries)).groupBy("cls", "n").agg(F.max(F.struct("count", "other", "no")).alias("x"))
            pairs = best.select(F.col("cls").alias("a"), F.col("x.other").alias("b"), F.col("n").alias("na"), F.col("x.no").alias("nb"))
        else:
            # the shorter text's overlap is at most what follows the shared shingle: 9 (n - pos) >= 4 (n + n') >= 8 n
            side = known.join(open_tokens.select("token"), "token", "left_semi").withColumn("sized", F.floor(F.log(F.col("n").cast("double")) / math.log(1.26)).cast("int"))
            short = side.where("9 * pos <= n").select("token", "sized", *(F.col(c).alias(c + "a") for c in ("cls", "n", "pos", "root")))
            long = side.select("token", F.explode(F.array("sized", F.col("sized") - 1)).alias("sized"), *(F.col(c).alias(c + "b") for c in ("cls", "n", "pos", "root")))
            near = (F.struct("na", "clsa") < F.struct("nb", "clsb")) & (F.col("roota") != F.col("rootb")) & (F.expr("5 * na >= 4 * nb")) & (9 * F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb")) >= 4 * (F.col("na") + F.col("nb")))
            met = short.join(long, ["token", "sized"]).where(near)
            pairs = met.select(F.col("clsa").alias("a"), F.col("clsb").alias("b"), "na", "nb").distinct()
        pairs = stored(pairs.coalesce(tasks(n_entries)))
        n_pairs = pairs.count()
        if not n_pairs:
            continue
        found = similar(pairs.coalesce(tasks(50 * n_pairs)), parts).coalesce(tasks(n_pairs))
        links = stored(found if links is None else found.unionByName(links))
        roots = components(links, links.count())
    if roots is None:
        named = classes.withColumn("root", F.col("cls"))
    else:
        named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(ids, "root").select(F.col("cls").alias("_cls"), "component_id")
    out = rows.join(by_class, F.col("cls") == F.col("_cls"), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
