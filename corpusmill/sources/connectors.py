"""Source policies, raw and item scans, sheets, sinks, and a Python data source that replays recorded API pages."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Source, requests, seconds, burst, page size, pages, total, full text, dates, redistribution.
POLICIES = (
    ("github", 30, 60, 5, 100, 10, 1000, True, True, "metadata_only"),
    ("stackexchange", 30, 60, 5, 100, 25, None, True, True, "full_text_with_attribution"),
    ("hackernews", 10, 60, 5, 1000, None, 1000, True, True, "metadata_only"),
    ("devto", 30, 60, 10, 1000, 50, None, False, False, "metadata_only"),
    ("huggingface", 30, 60, 10, 100, None, None, True, False, "metadata_only"),
    ("rss", 10, 60, 5, 50, None, None, False, False, "metadata_only"),
    ("bluesky", 30, 60, 10, 100, None, None, True, True, "metadata_only"),
    ("reddit", 10, 60, 5, 100, None, None, True, False, "metadata_only"),
    ("x_twitter", None, None, None, None, None, None, False, False, "metadata_only"),
    ("linkedin", None, None, None, None, None, None, False, False, "metadata_only"),
    ("discord", None, None, None, None, None, None, False, False, "metadata_only"),
)
POLICY_SCHEMA = "source string, requests int, seconds int, burst int, page_size int, max_pages int, total_cap int, full_text_search boolean, date_filter boolean, redistribution string"

#: Per source: where a raw payload's JSON holds an item's fields (JSON paths; the first that is there counts).
FIELDS = {
    "github": {"native": ["$.id", "$.sha"], "url": ["$.html_url"], "title": ["$.full_name", "$.title", "$.name"], "body": ["$.description", "$.body"], "author": ["$.owner.login", "$.user.login"], "created": ["$.created_at"], "votes": ["$.stargazers_count", "$.reactions.total_count"], "comments": ["$.comments"]},
    "stackexchange": {"native": ["$.question_id"], "url": ["$.link"], "title": ["$.title"], "body": ["$.body"], "author": ["$.owner.display_name"], "created": ["$.creation_date"], "votes": ["$.score"], "comments": ["$.answer_count"]},
    "hackernews": {"native": ["$.objectID"], "url": ["$.url", "$.story_url"], "title": ["$.title", "$.story_title"], "body": ["$.story_text", "$.comment_text"], "author": ["$.author"], "created": ["$.created_at_i"], "votes": ["$.points"], "comments": ["$.num_comments"]},
    "devto": {"native": ["$.id"], "url": ["$.url"], "title": ["$.title"], "body": ["$.body_markdown", "$.description"], "author": ["$.user.username"], "created": ["$.published_at"], "votes": ["$.public_reactions_count"], "comments": ["$.comments_count"]},
    "huggingface": {"native": ["$.id"], "url": ["$.url"], "title": ["$.id"], "body": ["$.description"], "author": ["$.author"], "created": ["$.createdAt"], "votes": ["$.likes"], "comments": ["$.discussions"]},
    "rss": {"native": ["$.id", "$.link"], "url": ["$.link"], "title": ["$.title"], "body": ["$.summary"], "author": ["$.author"], "created": ["$.published"], "votes": ["$.votes"], "comments": ["$.comments"]},
    "bluesky": {"native": ["$.uri"], "url": ["$.uri"], "title": ["$.record.text"], "body": ["$.record.text"], "author": ["$.author.handle"], "created": ["$.record.createdAt"], "votes": ["$.likeCount"], "comments": ["$.replyCount"]},
    "reddit": {"native": ["$.id"], "url": ["$.permalink"], "title": ["$.title"], "body": ["$.selftext"], "author": ["$.author"], "created": ["$.created_utc"], "votes": ["$.score"], "comments": ["$.num_comments"]},
}


def policies(spark: SparkSession) -> DataFrame:
    """The dimension table of sources, a row each."""
    return spark.createDataFrame(list(POLICIES), POLICY_SCHEMA)


def first_path(payload: Column, paths: list[str]) -> Column:
    return F.coalesce(*(F.get_json_object(payload, p) for p in paths))


def instant(value: Column) -> Column:
    """A timestamp from seconds since 1970 or an ISO text; null from anything else."""
    return F.when(value.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(value.cast("double"))).otherwise(F.try_to_timestamp(value))


def normalized(raw: DataFrame) -> DataFrame:
    """Items from raw records (source, payload JSON, fetched_at, seq); sources without a field map give nothing.

    One pass: each field's path is chosen by the row's source. Handles like `at://did/app.bsky.feed.post/key` become
    addresses.
    """

    def field(name: str) -> Column:
        out = F.lit(None).cast("string")
        for source, paths in FIELDS.items():
            out = F.when(F.col("source") == source, first_path(F.col("payload"), paths[name])).otherwise(out)
        return out

    made = raw.where(F.col("source").isin(*FIELDS)).select("source", "seq", "fetched_at", *(field(n).alias(n) for n in FIELDS["github"]))
    post = F.concat(F.lit("https://bsky.app/profile/"), F.col("author"), F.lit("/post/"), F.substring_index("native", "/", -1))
    url = F.when(F.col("source") == "bluesky", post).when((F.col("source") == "reddit") & F.col("url").startswith("/"), F.concat(F.lit("https://www.reddit.com"), F.col("url"))).otherwise(F.col("url"))
    title = F.when(F.col("source") == "bluesky", F.left("title", F.lit(100))).otherwise(F.col("title"))
    item_id = F.substring(F.sha2(F.concat_ws(":", "source", "native"), 256), 1, 16)
    return made.select(item_id.alias("id"), "source", "seq", url.alias("url"), title.alias("title"), "body", F.sha2("body", 256).alias("body_hash"), "author", instant(F.col("created")).alias("created_at"), F.col("votes").cast("long").alias("votes"), F.col("comments").cast("long").alias("comments"), "fetched_at")


def scan_raw(spark: SparkSession, path: str) -> DataFrame:
    """Raw JSON lines, gzipped or not: source, native_id, payload (text), fetched_at, and where each line lies.

    Lines end at \\n alone; others of Unicode's line ends stay inside a record.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"))
    get = lambda p: F.get_json_object("value", p)
    return lines.where("value <> ''").select(get("$.source").alias("source"), get("$.native_id").alias("native_id"), get("$.payload").alias("payload"), F.try_to_timestamp(get("$.fetched_at")).alias("fetched_at"), "file", "at")


def scan_items(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Items of JSON lines, and the lines that don't parse: they are counted, not fatal."""
    withbad = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    lines = spark.read.option("lineSep", "\n").text(path).where(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", withbad, {"mode": "PERMISSIVE"}))
    return parsed.where("r._corrupt_record is null").select(*(F.col(f"r.{f.name}") for f in schema.fields)), parsed.where("r._corrupt_record is not null").select("value")


def union_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """All runs, in the order of their names: seq becomes (run, seq)."""
    out = None
    for name in sorted(runs):
        part = runs[name].withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def scan_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A CSV sheet with a header; the delimiter is `;` if the header has one, else `,`; cells may span lines."""
    header = spark.read.option("lineSep", "\n").text(path).head()
    sep = ";" if header and ";" in header[0] else ","
    made = spark.read.csv(path, sep=sep, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8")
    return made.toDF(*(c.lstrip("﻿") for c in made.columns))


def cell_lists(value: Column) -> Column:
    """The distinct entries of a cell that lists by comma, semicolon or bar."""
    return F.array_distinct(F.filter(F.transform(F.split(value, "[,;|]"), lambda x: F.trim(x)), lambda x: x != ""))


def flat_csv(rows: DataFrame) -> DataFrame:
    """Rows whose maps read `a=b; c=d`, lists `a, b`, nulls as empty: what a CSV writer takes."""
    out = []
    for f in rows.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.MapType):
            c = F.array_join(F.transform(F.array_sort(F.map_entries(c)), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string"))), "; ")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ", ")
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return rows.select(*out)


def write_csv(rows: DataFrame, path: str) -> None:
    flat_csv(rows).write.mode("overwrite").csv(path, sep=";", header=True, emptyValue="", quoteAll=False)


def insert_ignore(existing: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """The rows to append: new keys alone, of repeats the first."""
    fresh = new.join(existing.select(key), key, "left_anti")
    rest = [c for c in new.columns if c != key]
    return fresh.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_r")).select(key, "_r.*").select(*new.columns)


def write_run(rows: DataFrame, path: str) -> None:
    """Items by run and source; a rewritten partition replaces itself alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "source").parquet(path)


def blinded(sheet: DataFrame, hidden: tuple[str, ...] = ("score", "evidence", "terms", "concepts", "rank")) -> DataFrame:
    """A review sheet whose hints are masked."""
    return sheet.withColumns({c: F.lit("") for c in hidden if c in sheet.columns})


def strata_wide(long: DataFrame, key: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """A coding sheet: a row per item, a column per field."""
    return long.groupBy(key).pivot(field, fields).agg(F.first(value))


def running_quota(requests: DataFrame, per_second: float, burst: int, daily: int | None) -> DataFrame:
    """When each request (source, n from 0, asked_at seconds) may start under a token bucket, and whether the day allows it.

    With a bucket of `burst` that refills at a rate, request n waits for the latest of its own time and that of any
    earlier request k plus (n - k - burst + 1) / rate: a running maximum.
    """
    w = Window.partitionBy("source").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    start = F.greatest(F.col("asked_at"), F.max(F.col("asked_at") - F.col("n") / per_second).over(w) + (F.col("n") - burst + 1) / per_second)
    return requests.withColumn("starts_at", start).withColumn("allowed", F.lit(True) if daily is None else F.col("n") < daily)


class _Page(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class ReplayReader(DataSourceReader):
    """Reads recorded pages: a partition for each planned page of the manifest, so that executors read pages at once."""

    def __init__(self, options: dict) -> None:
        self.pages = json.loads(options["pages"])

    def partitions(self) -> list[InputPartition]:
        return [_Page(json.dumps(p)) for p in self.pages] or [_Page("{}")]

    def read(self, partition: _Page) -> Iterator[tuple]:
        page = json.loads(partition.path)
        for i, hit in enumerate(page.get("hits", [])):
            yield page["source"], str(hit.get("id", i)), json.dumps(hit), page.get("seq", 0) * 100_000 + i


class ReplaySource(DataSource):
    """Data source `replay`: recorded API pages as raw records. Option `pages`: JSON list of {source, seq, hits}."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return "source string, native_id string, payload string, seq bigint"

    def reader(self, schema: T.StructType) -> ReplayReader:
        return ReplayReader(dict(self.options))
