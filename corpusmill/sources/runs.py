"""Scans over the runs of a store: listing, items with their preferred file, and detections of all runs.

A store holds `<root>/<run>/<kind>` as JSON lines, either files (`r1/items.jsonl`, gzipped or not) or the folders that a
partitioned write makes (`run=r1/file=items/part-*`). Schemas are given as DDL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import dedupe as D

CONSOLIDATED = "consolidated"
#: What tells one detection from another where runs are put together.
DETECTION_KEY = ("item_id", "entry_id", "signal", "location")


def _place(path: Column, root: str) -> dict[str, Column]:
    """Run and kind of a file by the first two names below the root."""
    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root.rstrip("/"))
    below = F.split(F.substring_index(path, f"{bare}/", -1), "/")
    run = F.regexp_replace(F.get(below, F.lit(0)), "^run=", "")
    return {"run": run, "kind": F.regexp_extract(F.get(below, F.lit(1)), r"^(?:file=)?([^./]+)", 1), "folder": F.concat_ws("/", F.get(below, F.lit(0)), F.get(below, F.lit(1)))}


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """Rows (run, kind, folder): what the store holds, from file names alone; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    return files.select(*(c.alias(n) for n, c in _place(F.col("path"), root).items())).where("kind <> ''").distinct()


def runs(held: DataFrame, with_consolidated: bool = False) -> DataFrame:
    """The names of a catalog's runs, the consolidated one only where asked for."""
    names = held.select("run").distinct()
    return names if with_consolidated else names.where(F.col("run") != CONSOLIDATED)


def _held(spark: SparkSession, root: str) -> dict[str, dict[str, str]]:
    """The catalog on the driver: a row a run and kind, so bounded by the number of runs."""
    out: dict[str, dict[str, str]] = {}
    for run, kind, folder in catalog(spark, root).collect():
        out.setdefault(run, {})[kind] = folder
    return out


def _lines(spark: SparkSession, root: str, folders: list[str], schema: str) -> DataFrame:
    """The records of folders with their run, in one scan however many runs there are; a line that doesn't parse is an error."""
    if not folders:
        return spark.createDataFrame([], f"run string, {schema}")
    text = spark.read.option("lineSep", "\n").text([f"{root.rstrip('/')}/{f}" for f in folders])
    text = text.select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("_metadata.file_path").alias("path"))
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    record = F.from_json("value", schema, {"mode": "FAILFAST"})
    return text.where(F.trim("value") != "").select(_place(path, root)["run"].alias("run"), record.alias("r")).select("run", "r.*")


def _firsts(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The first row of each key by run, the consolidated one last, then seq; a map-side minimum, null keys alike.

    Within a run seq tells rows apart, as a line's number does; which of two rows with an equal seq stays isn't defined.
    """
    rest = [c for c in rows.columns if c not in keys]
    place = F.struct(F.col("run") == CONSOLIDATED, "run", "seq")
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def read_items(spark: SparkSession, root: str, run: str, schema: str, prefer_deduped: bool = False) -> DataFrame:
    """Items of a run with the column run; none if the run isn't there.

    Of `items` and `items_deduped` the preferred one is read, else the other. `consolidated` without files of its own is
    the union of all runs: with prefer_deduped less repeated URLs and texts, else the first row of each id. The schema
    needs id and seq, for the former also url, title, body and kind.
    """
    held = _held(spark, root)
    order = ("items_deduped", "items") if prefer_deduped else ("items", "items_deduped")
    folder = {r: next((kinds[k] for k in order if k in kinds), None) for r, kinds in held.items()}
    if run != CONSOLIDATED or folder.get(run):
        return _lines(spark, root, [folder[run]] if folder.get(run) else [], schema)
    union = _lines(spark, root, [f for r, f in sorted(folder.items()) if f and r != CONSOLIDATED], schema)
    if not prefer_deduped:
        return _firsts(union, ("id",))
    place, url, text = F.struct("run", "seq"), X.canonical_url(F.col("url")), X.content_hash(F.col("title"), F.col("body"))
    marked = D.exact_passes(union.withColumns({"_place": place, "_page": url, "_text": text}), seq="_place", url="_page", content="_text")
    return marked.where("reason is null").select(*union.columns)


def read_detections(spark: SparkSession, root: str, run: str, schema: str) -> DataFrame:
    """Detections of a run with the column run; `consolidated` puts all runs together, of repeats the first. Needs seq."""
    held = _held(spark, root)
    wanted = [kinds["detections"] for r, kinds in sorted(held.items()) if "detections" in kinds and run in (r, CONSOLIDATED)]
    rows = _lines(spark, root, wanted, schema)
    return _firsts(rows, DETECTION_KEY) if run == CONSOLIDATED else rows
