"""Units of analysis: detections joined to units, their channels, and what items of one repository share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dedupe as D
from .extract import anchored


def item_units(items: DataFrame) -> DataFrame:
    """Rows (item_id, unit_id, query): an item's repository is its unit, else the item itself; of repeats the last by seq."""
    unit = F.coalesce("repo", "item_id").alias("unit_id")
    last = items.groupBy("item_id").agg(F.max_by(F.struct(unit, "query"), "seq").alias("u"))
    return last.select("item_id", "u.*")


def detection_units(items: DataFrame, detections: DataFrame, tools: list[dict]) -> DataFrame:
    """Detections with unit_id and channel, by their item, else by their repository; those of neither are left out.

    A tool's channel is `anchored` where the search that found the item was aimed at it, else `open`; other entries
    have none. Both ways lead to one key, so that the fallback costs a semi join and nulls meet nothing.
    """
    units = item_units(items)
    joined = detections.join(units, "item_id", "left").withColumn("unit_id", F.coalesce("unit_id", "repo"))
    known = joined.join(units.select("unit_id").distinct(), "unit_id", "left_semi")
    aimed = F.lit(False)
    for tool in tools:
        aimed = aimed | ((F.col("entry_id") == tool["id"]) & anchored(F.col("query"), tool))
    channel = F.when(F.col("entry_type") == "tool", F.when(aimed, "anchored").otherwise("open"))
    return known.withColumn("channel", channel).select(*detections.columns, "unit_id", "channel")


def suggestions(items: DataFrame, detections: DataFrame) -> DataFrame:
    """By item (item_id): its tools and methods, best level and that one's evidence, with those of its repository.

    Detections other than by text are shared by all items of a repository. A repository is summed up first, in sets no
    larger than the catalog, so items and detections of a repository never meet in pairs. Of equal levels an item's own
    detection counts before its repository's, then the smaller seq, then the later evidence. Items without any have empty lists and null level.
    """

    def summed(rows: DataFrame, key: str) -> DataFrame:
        of = lambda kind: F.collect_set(F.when(F.col("entry_type") == kind, F.col("entry_id"))).alias(kind)
        best = F.max_by(F.struct("level", "evidence"), F.struct("level", -F.col("seq"), "evidence")).alias("best")
        return rows.groupBy(key).agg(of("tool"), of("method"), best)

    def renamed(rows: DataFrame, side: str) -> DataFrame:
        return rows.withColumnsRenamed({c: f"{c}_{side}" for c in ("tool", "method", "best")})

    own = renamed(summed(detections, "item_id"), "own")
    shared = renamed(summed(detections.where("repo is not null and signal <> 'text'"), "repo"), "repo")
    joined = items.select("item_id", "repo").join(own, "item_id", "left").join(shared, "repo", "left")
    none = F.array().cast("array<string>")
    both = lambda kind: F.array_sort(F.array_union(F.coalesce(f"{kind}_own", none), F.coalesce(f"{kind}_repo", none)))
    theirs = F.coalesce(F.col("best_repo.level") > F.col("best_own.level"), F.col("best_own").isNull())
    best = F.when(theirs, F.col("best_repo")).otherwise(F.col("best_own"))
    return joined.select("item_id", both("tool").alias("tools"), both("method").alias("methods"), best["level"].alias("level"), best["evidence"].alias("evidence"))


def without_labels(items: DataFrame, excluded: list[str], labels: str = "labels") -> DataFrame:
    """Items none of whose labels is excluded, in any case; null labels exclude nothing."""
    low = [F.lit(x.lower()) for x in excluded]
    hit = F.arrays_overlap(F.transform(labels, F.lower), F.array(*low).cast("array<string>"))
    return items.where(~F.coalesce(hit, F.lit(False)))


def seeded_order(items: DataFrame, key: str, seed: int, batch: int) -> DataFrame:
    """Adds rank and batch in an order that only key and seed decide, for blind review; equal keys keep any order."""
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    return D.ranked(items.withColumn("_draw", draw), [F.col("_draw"), F.col(key)], batch).drop("_draw")
