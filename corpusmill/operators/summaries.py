"""Smaller tables of reports: methods, pain, origins, manifests, discards, detection recall, log of searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def methods_table(catalog: DataFrame, methods: DataFrame) -> DataFrame:
    """Units of each method of the catalog, zeros included."""
    counts = methods.groupBy("method_id").agg(F.count_distinct("unit_id").alias("units"))
    return catalog.join(counts, "method_id", "left").fillna(0, ["units"])


def pain(issues: DataFrame) -> DataFrame:
    """By tool of bug reports: how many, median comments and reactions (null counts as 0), share with a comment."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    return issues.groupBy("tool").agg(F.count("*").alias("n"), F.percentile(zero("comments"), 0.5).alias("median_comments"), F.percentile(zero("reactions"), 0.5).alias("median_reactions"), F.avg((zero("comments") > 0).cast("double")).alias("share_commented"))


def catalog_origin(catalog: DataFrame, seeds: DataFrame) -> DataFrame:
    """Entries by origin: seed or discovery."""
    marked = catalog.join(seeds.select("entry_id").distinct().withColumn("_s", F.lit(True)), "entry_id", "left")
    return marked.groupBy(F.when(F.col("_s"), "seed").otherwise("discovery").alias("origin")).agg(F.count("*").alias("entries"))


def merged_manifests(entries: DataFrame) -> DataFrame:
    """Manifest entries (source, run, queries) of all runs, the queries of a source in the order of the runs."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("run", "queries"))), lambda x: x["queries"])
    return entries.groupBy("source").agg(F.flatten(ordered).alias("queries"))


def distinct_discards(lines: DataFrame) -> DataFrame:
    """Discard records without exact repeats, by reason."""
    return lines.distinct().groupBy("reason").agg(F.count("*").alias("discards"))


def missed_tools(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (item_id, entry_id) that a gold set expects and no detection shows."""
    return expected.join(found.select("item_id", "entry_id").distinct(), ["item_id", "entry_id"], "left_anti")


def truncation_counts(queries: DataFrame) -> DataFrame:
    """Queries by each reason that cut them short; reasons is an array."""
    return queries.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("queries"))


def discarded(rows: DataFrame, keep: Column, reason: str = "no_term_match") -> tuple[DataFrame, DataFrame]:
    """Rows that pass a local filter, and the others with the reason for which they go: one condition, two outputs."""
    passes = F.coalesce(keep, F.lit(False))
    return rows.where(passes), rows.where(~passes).withColumn("reason", F.lit(reason))


def age_months(created: Column, now: Column) -> Column:
    return F.datediff(now, created) / 30.4375


def fetch_targets(items: DataFrame, done: DataFrame, sources: list[str], host: Column, limit: int) -> DataFrame:
    """The first items, in order, of the given sources with matched terms, not yet fetched, not of the forum itself."""
    wanted = items.where(F.col("source").isin(*sources) & (F.size("matched_terms") > 0) & (host != "news.ycombinator.com"))
    return wanted.join(done.select("item_id"), "item_id", "left_anti").orderBy("seq").limit(limit)
