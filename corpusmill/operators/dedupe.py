"""Deduplication: first-wins passes by URL and content, and near duplicates by MinHash bands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import stored

#: Hash functions, rows of a band, words of a shingle, and the fewest words of a text that is compared.
PERMUTATIONS, ROWS, SHINGLE, MIN_TOKENS, SEED = 128, 4, 5, 30, 20260928
_PRIME = np.uint64((1 << 61) - 1)


def first_wins(rows: DataFrame, keys: list[str], order: list[str], keep: Column | None = None) -> DataFrame:
    """Marks each row with `dup_of_first`: whether an earlier row has the same keys. Rows outside `keep` are never marked.

    The first row of a key is found by a map-side minimum and joined back, so that a key with a third of all rows is
    counted where it lies and never sorted in one task.
    """
    eligible = F.lit(True) if keep is None else F.coalesce(keep, F.lit(False))
    marked = rows.withColumn("_eligible", eligible)
    place = F.struct(*order)
    firsts = marked.where("_eligible").groupBy(*keys).agg(F.min(place).alias("_first")).select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_first")
    on = F.col("_eligible")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = marked.join(firsts, on, "left").withColumn("dup_of_first", F.coalesce(F.struct(*order) > F.col("_first"), F.lit(False)))
    return joined.drop("_eligible", "_first", *(f"_k{i}" for i in range(len(keys))))


def exact_passes(items: DataFrame, *, seq: str = "seq", url: str = "canonical_url", content: str = "content_key") -> DataFrame:
    """Adds reason: `url` for a repeat of an earlier URL; among the others `content` for one of an earlier text; else null.

    Items without a body or of kind `code` take no part in the content pass.
    """
    by_url = first_wins(items, [url], [seq]).withColumnRenamed("dup_of_first", "_url")
    able = ~F.col("_url") & (F.trim("body") != "") & (F.col("kind") != "code")
    by_content = first_wins(by_url, [content], [seq], able)
    return by_content.withColumn("reason", F.when(F.col("_url"), "url").when(F.col("dup_of_first"), "content")).drop("_url", "dup_of_first")


def _signatures(texts: list[str | None]) -> Iterator[tuple[list[int] | None, list[int] | None]]:
    import re

    rng = np.random.default_rng(SEED)
    a = rng.integers(1, 1 << 61, PERMUTATIONS, dtype=np.uint64)[:, None]
    b = rng.integers(0, 1 << 61, PERMUTATIONS, dtype=np.uint64)[:, None]
    import xxhash

    for text in texts:
        words = re.findall(r"\w+", (text or "").lower())
        if len(words) < MIN_TOKENS:
            yield None, None
            continue
        sh = sorted({xxhash.xxh3_64_intdigest(" ".join(words[i : i + SHINGLE])) >> 3 for i in range(len(words) - SHINGLE + 1)})
        low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max)
        for block in range(0, len(sh), 4096):
            h = np.array(sh[block : block + 4096], np.uint64)[None, :]
            low = np.minimum(low, ((a * h + b) & _PRIME).min(axis=1))
        yield low.astype(np.int64).tolist(), sh


def signatures(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, sig, shingles): MinHash signature and shingle hashes; both null for texts of fewer than MIN_TOKENS words."""
    schema = docs.select(key).schema.add("sig", T.ArrayType(T.LongType())).add("shingles", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = list(_signatures(batch.column(text).to_pylist()))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([m[0] for m in made], kind), pa.array([m[1] for m in made], kind)], names=[key, "sig", "shingles"])

    return docs.select(key, text).mapInArrow(run, schema)


def bands(signed: DataFrame, key: str) -> DataFrame:
    """Rows (band, band_hash, key): each signature's bands of ROWS values."""
    n = PERMUTATIONS // ROWS
    exploded = signed.where("sig is not null").select(key, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.xxhash64(F.slice("sig", b * ROWS + 1, ROWS)))).alias("band", "band_hash"))
    return exploded.select("band", "band_hash", key)


def estimated_jaccard(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, v: s + v) / F.size(a)


def near_and_copies(docs: DataFrame, key: str, text: str, threshold: float, verify: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) among the first texts of each shingle set, and those of each with its copies."""
    signed = stored(signatures(docs, key, text).where("sig is not null").withColumn("set_key", F.xxhash64("shingles")))
    leads = signed.groupBy("set_key").agg(F.min(key).alias("lead"))
    copies = signed.join(leads, "set_key").where(F.col(key) != F.col("lead")).select(F.col("lead").alias("a"), F.col(key).alias("b"), F.lit(1.0).alias("similarity"))
    reps = signed.join(leads.select(F.col("lead").alias(key)), key, "left_semi")
    rows = bands(reps, key)
    met = rows.alias("x").join(rows.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.band_hash") == F.col("y.band_hash")) & (F.col(f"x.{key}") < F.col(f"y.{key}")))
    pairs = met.select(F.col(f"x.{key}").alias("a"), F.col(f"y.{key}").alias("b")).distinct()
    side = lambda c: reps.select(F.col(key).alias(c), F.col("sig").alias(f"sig_{c}"), F.col("shingles").alias(f"sh_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("sh_a", "sh_b"))
    exact = shared / (F.size("sh_a") + F.size("sh_b") - shared)
    similarity = exact if verify == "exact" else estimated_jaccard(F.col("sig_a"), F.col("sig_b"))
    found = both.select("a", "b", similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return found, copies


def near_pairs(docs: DataFrame, *, key: str, text: str, threshold: float = 0.8, verify: str = "exact") -> DataFrame:
    """Pairs (a, b, similarity) of near duplicates, a before b, that meet in a band and reach the threshold.

    Texts with equal shingle sets are compared through one of them, so that a large group of copies meets once; each of
    the others is paired with that one alone.
    """
    found, copies = near_and_copies(docs, key, text, threshold, verify)
    return found.unionByName(copies)


def near_keep(docs: DataFrame, *, key: str, text: str, threshold: float = 0.8, verify: str = "exact") -> DataFrame:
    """Rows (key, kept): whether no earlier document that stays is near.

    Only the first text of each shingle set is decided by pairs. Its copies all go: either it stays, or what drops it
    is as near to them and comes before them.
    """
    found, copies = near_and_copies(docs, key, text, threshold, verify)
    copies = stored(copies.select(F.col("b").alias(key)).distinct())
    firsts = docs.select(key).distinct().join(copies, key, "left_anti")
    return greedy_keep(firsts, found, key).unionByName(copies.withColumn("kept", F.lit(False)))


def greedy_keep(nodes: DataFrame, pairs: DataFrame, key: str, rounds: int | None = None) -> DataFrame:
    """Rows (key, kept): the first-come independent set of the pairs (a before b).

    A row goes if an earlier row that stays is near it; rows that go pull nobody along. Each round keeps the undecided
    rows without an undecided or kept earlier neighbour and drops those with a kept one; the state is checkpointed.
    Rounds go on until every row is decided; it is an error if more than `rounds` are needed, or if pairs form a cycle.
    """
    state = stored(nodes.select(F.col(key).alias("node")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    edges = stored(pairs.select(F.col("a"), F.col("b")))
    done, last = 0, None
    while n_open := state.where("kept is null").count():
        if n_open == last or done == rounds:
            raise RuntimeError(f"{n_open} rows are undecided after {done} rounds")
        earlier = edges.join(state.select(F.col("node").alias("a"), F.col("kept").alias("kept_a")), "a").groupBy("b").agg(F.max(F.coalesce("kept_a", F.lit(False))).alias("near_kept"), F.max(F.col("kept_a").isNull()).alias("near_open"))
        joined = state.join(earlier, state.node == earlier.b, "left")
        new = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("near_kept", F.lit(False)), False).when(~F.coalesce("near_open", F.lit(False)), True)
        state = stored(joined.select("node", new.alias("kept")))
        done, last = done + 1, n_open
    return state.withColumnRenamed("node", key)


def reason_counts(marked: DataFrame) -> DataFrame:
    """Rows (reason, n) for url, content and near, zero counts included."""
    kinds = marked.sparkSession.createDataFrame([("url",), ("content",), ("near",)], "reason string")
    counts = marked.where("reason is not null").groupBy(F.split("reason", ":")[0].alias("reason")).count()
    return kinds.join(counts, "reason", "left").select("reason", F.coalesce("count", F.lit(0)).alias("n"))


def unseen(items: DataFrame, earlier: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Items whose key no earlier run had, and those that were seen before."""
    old = earlier.select(key).distinct()
    return items.join(old, key, "left_anti"), items.join(old, key, "left_semi")


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key of an append log, by a map-side maximum."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")).select(*keys, "_r.*")


def ranked(rows: DataFrame, order: list[Column], batch: int) -> DataFrame:
    """Adds rank (from 1) and batch over the whole table.

    The ranks come from ranges: rows are range-partitioned by the order, numbered within their partition, and shifted
    by the sizes of the partitions before, so that no single task sees all rows. They are stored before that, or what
    they are made of would be computed once for the ranges' sample and again for the shuffle.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = stored(stored(rows).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    sizes = ranged.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_m").alias("_base"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    rank = F.col("_before") + F.col("_m") - F.col("_base") + 1
    return ranged.join(F.broadcast(before), "_p").withColumn("rank", rank).withColumn("batch", F.floor((F.col("rank") - 1) / batch) + 1).drop("_p", "_m", "_base", "_before")
