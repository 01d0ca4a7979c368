"""Review and validation: agreement of coders, precision, recall, flow accounting, mining report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .analysis import n_if, wilson


def coder_pairs(records: DataFrame, item: str, coder: str, value: str) -> DataFrame:
    """Rows (a, b, item, value_a, value_b) for each two coders of an item. Coders of an item are few."""
    one = lambda s: records.select(item, F.col(coder).alias(s), F.col(value).alias(f"value_{s}"))
    return one("a").join(one("b"), item).where("a < b")


def agreement_multi(records: DataFrame, item: str, coder: str, values: str) -> DataFrame:
    """By pair of coders of list values: items, disagreements, and how often each side has each used value."""
    pairs = coder_pairs(records, item, coder, values)
    same = F.size(F.array_except("value_a", "value_b")) + F.size(F.array_except("value_b", "value_a")) == 0
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), n_if(~same).alias("disagreements")).withColumn("percent", F.round(1 - F.col("disagreements") / F.col("n"), 4))


def precision(judged: DataFrame, population: DataFrame) -> DataFrame:
    """By stratum (source/level): population, judged, correct, precision and Wilson's interval."""
    j = judged.groupBy("stratum").agg(F.count("*").alias("judged"), n_if(F.col("correct")).alias("correct"))
    out = population.join(j, "stratum", "left").fillna(0, ["judged", "correct"])
    low, high = wilson(F.col("correct"), F.col("judged"))
    return out.withColumns({"precision": F.when(F.col("judged") > 0, F.col("correct") / F.col("judged")), "low": low, "high": high})


def precision_weighted(strata: DataFrame) -> DataFrame:
    """By level and for all: precision weighted by population over the judged strata."""
    level = F.element_at(F.split("stratum", "/"), -1)
    rows = strata.where("judged > 0").withColumn("level", F.explode(F.array(level, F.lit("all"))))
    return rows.groupBy("level").agg((F.sum(F.col("population") * F.col("precision")) / F.sum("population")).alias("precision"), F.sum("judged").alias("judged"), F.sum("correct").alias("correct"))


def recall(gold: DataFrame, items: DataFrame, host: Column) -> DataFrame:
    """By host: gold entries and those that an item of the same repository or canonical URL retrieves."""
    repos = items.where("repo is not null").select("repo").distinct().withColumn("_r", F.lit(True))
    urls = items.select("canonical_url").distinct().withColumn("_u", F.lit(True))
    hit = F.coalesce("_r", F.lit(False)) | F.coalesce("_u", F.lit(False))
    return gold.join(repos, "repo", "left").join(urls, "canonical_url", "left").withColumn("host", host).groupBy("host").agg(n_if(hit).alias("retrieved"), F.count("*").alias("total"))


def prisma_identified(queries: DataFrame) -> DataFrame:
    """By source: identified, discarded, duplicates aside, not retrieved, by rows (source, items, discarded, available, reason)."""
    gap = F.greatest(F.col("available") - F.col("items") - F.col("discarded"), F.lit(0))
    return queries.groupBy("source").agg(F.sum(F.col("items") + F.col("discarded")).alias("identified"), F.sum("discarded").alias("filtered"), F.sum(F.when(F.col("reason") == "source_cap", gap).otherwise(0)).alias("not_retrieved"), F.sum(F.when(F.col("reason") == "item_limit", gap).otherwise(0)).alias("sampled_out"))


def prisma_screened(pool: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: pool, included, excluded, uncertain and pending items, from final decisions (item_id, decision)."""
    joined = pool.select("item_id").distinct().join(decisions, "item_id", "left")
    count = lambda d: n_if(F.col("decision") == d).alias(d)
    return joined.agg(F.count("*").alias("pool"), count("include"), count("exclude"), count("uncertain"), n_if(F.col("decision").isNull()).alias("pending"))


def exclusion_reasons(decisions: DataFrame) -> DataFrame:
    """Items by exclusion criterion; those without one that starts with E count as another reason."""
    reasons = F.filter(F.coalesce("criteria", F.array().cast("array<string>")), lambda c: c.startswith("E"))
    by_item = decisions.where("decision = 'exclude'").groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list(reasons))).alias("r"))
    rows = by_item.select(F.explode(F.when(F.size("r") > 0, F.col("r")).otherwise(F.array(F.lit("other (reason given)")))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("items"))


def report_by_year(items: DataFrame, since: str, until: str) -> DataFrame:
    """By source and year: items, and those outside the window."""
    day = F.to_date("created_at")
    return items.groupBy("source", F.year("created_at").alias("yr")).agg(F.count("*").alias("items"), n_if(~day.between(since, until)).alias("out_of_window"))


def language_combinations(hits: DataFrame) -> DataFrame:
    """Items by the sorted combination of their terms' languages, like `en+pt`."""
    combined = hits.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("languages"))
    return combined.groupBy("languages").agg(F.count("*").alias("items"))


def terms_without_hits(terms: DataFrame, hits: DataFrame) -> DataFrame:
    return terms.join(hits.select("term").distinct(), "term", "left_anti")


def coding_status(records: DataFrame) -> DataFrame:
    """By coder: items coded, and how many of them another coder has too."""
    shared = records.groupBy("item_id").agg(F.count_distinct("coder").alias("k"))
    return records.join(shared, "item_id").groupBy("coder").agg(F.count_distinct("item_id").alias("items"), F.count_distinct(F.when(F.col("k") >= 2, F.col("item_id"))).alias("double_coded"))


def export_rows(items: DataFrame, hits: DataFrame) -> DataFrame:
    """Flat rows for CSV: distinct sorted terms joined by comma and blank, empty strings for nulls."""
    terms = hits.groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_set("term")), ", ").alias("matched_terms"))
    return items.join(terms, "item_id", "left").fillna("", ["matched_terms"])


def policy_gate(items: DataFrame, policies: DataFrame) -> DataFrame:
    """Sources with items whose policy forbids full texts: an export with bodies must find none."""
    return items.select("source").distinct().join(policies.where("policy = 'metadata_only'"), "source", "left_semi")
