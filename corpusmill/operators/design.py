"""Sampling design: strata, fractions, weights; allocation, samples, quotas; budgets and date splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strata(queries: DataFrame) -> DataFrame:
    """Adds examined, fraction, weight and not_retrieved to rows (items, discarded, available, cut_short).

    A query that wasn't cut short has fraction 1; without a known total or examined items it is unknown and weighs 1.
    """
    examined = F.col("items") + F.col("discarded")
    known = F.col("available").isNotNull() & (F.col("available") > 0) & (examined > 0)
    fraction = F.when(~F.col("cut_short"), 1.0).when(known, F.least(F.lit(1.0), examined / F.col("available")))
    missing = F.when(F.col("cut_short") & F.col("available").isNotNull(), F.greatest(F.col("available") - examined, F.lit(0)))
    return queries.withColumns({"examined": examined, "fraction": fraction}).withColumns({"weight": F.coalesce(1 / F.col("fraction"), F.lit(1.0)), "not_retrieved": missing})


def fractions(made: DataFrame, by: list[str]) -> DataFrame:
    """Strata rolled up by columns (null is a group too); one unknown total makes the group's unknown."""
    unknown = F.col("cut_short") & F.col("available").isNull()
    total = F.when(F.sum(unknown.cast("int")) > 0, None).otherwise(F.sum(F.when(F.col("cut_short"), F.col("available")).otherwise(F.col("examined"))))
    out = made.groupBy(*by).agg(F.count("*").alias("queries"), F.sum(F.col("cut_short").cast("int")).cast("long").alias("cut_short"), F.sum(unknown.cast("int")).cast("long").alias("unknown"), F.sum("examined").alias("examined"), total.alias("available"), F.sum(F.coalesce("not_retrieved", F.lit(0))).alias("not_retrieved"))
    return out.withColumn("fraction", F.when(F.col("available") > 0, F.least(F.lit(1.0), F.col("examined") / F.col("available"))))


def kish(weight: Column) -> Column:
    """Effective sample size of positive weights; 0 without any."""
    w = F.when(weight > 0, weight)
    return F.coalesce(F.sum(w) * F.sum(w) / F.sum(w * w), F.lit(0.0))


def with_weights(items: DataFrame, made: DataFrame, on: list[str]) -> DataFrame:
    """Items with their stratum's weight; 1 and unknown where no stratum fits. The strata are few, a row a query."""
    table = made.select(*on, "weight", F.lit(True).alias("known"))
    return items.join(table, on, "left").withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "known": F.coalesce("known", F.lit(False))})


def pair_weights(detections: DataFrame, weighted: DataFrame) -> DataFrame:
    """Rows (unit_id, entry_id, rank, weight) at each pair's best rank.

    A structural signal there gives the smallest weight of the unit's repository items (1 without any), else the
    smallest weight of the items that mention the entry at that rank. detections need unit_id, entry_id, item_id, rank
    and structural; weighted needs item_id, unit_id, is_repo and weight.
    """
    best = detections.groupBy("unit_id", "entry_id").agg(F.max("rank").alias("best"))
    top = detections.join(best, ["unit_id", "entry_id"]).where("rank = best").join(weighted.select("item_id", "weight"), "item_id", "left")
    repo = weighted.where("is_repo").groupBy("unit_id").agg(F.min("weight").alias("repo_weight"))
    pairs = top.groupBy("unit_id", "entry_id", "best").agg(F.max("structural").alias("structural"), F.min(F.when(~F.col("structural"), F.coalesce("weight", F.lit(1.0)))).alias("text_weight"))
    weight = F.when(F.col("structural"), F.coalesce("repo_weight", F.lit(1.0))).otherwise(F.col("text_weight"))
    return pairs.join(repo, "unit_id", "left").select("unit_id", "entry_id", F.col("best").alias("rank"), weight.alias("weight"))


def allocation(sizes: DataFrame, n: int) -> DataFrame:
    """Rows (stratum, size, allocated): one for each stratum, then in proportion, then one pass by largest remainder.

    Windows run over the table of strata.
    """
    everything = Window.partitionBy()
    t = sizes.where("size > 0").withColumns({"_total": F.sum("size").over(everything), "_k": F.count("*").over(everything)})
    rest = F.greatest(F.lit(n) - F.col("_k"), F.lit(0))
    share = rest * F.col("size") / F.col("_total")
    t = t.withColumns({"_rest": rest, "_add": F.least(F.floor(share), F.col("size") - 1), "_frac": share - F.floor(share)})
    t = t.withColumn("_left", F.col("_rest") - F.sum("_add").over(everything))
    t = t.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(F.col("size") > 1 + F.col("_add")), F.desc("_frac"), "stratum")))
    extra = F.when((F.col("_place") <= F.col("_left")) & (F.col("size") > 1 + F.col("_add")), 1).otherwise(0)
    by_size = F.row_number().over(Window.orderBy(F.desc("size"), "stratum"))
    out = F.when(F.col("_total") <= n, F.col("size")).when(F.col("_k") >= n, F.when(by_size <= n, 1).otherwise(0)).otherwise(1 + F.col("_add") + extra)
    return t.select("stratum", "size", out.cast("long").alias("allocated"))


def sampled(rows: DataFrame, allocated: DataFrame, key: str, seed: str) -> DataFrame:
    """The allocated number of rows of each stratum, first in the order of a seeded hash. Repeats of a run agree.

    Row numbers up to a limit are cut within map tasks: the largest allocation bounds what a task keeps.
    """
    most = allocated.agg(F.coalesce(F.max("allocated"), F.lit(0))).first()[0]
    order = F.sha2(F.concat(F.col(key).cast("string"), F.lit(seed)), 256)
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy("stratum").orderBy(order, key))).where(F.col("_n") <= most)
    return numbered.join(F.broadcast(allocated.select("stratum", "allocated")), "stratum").where("_n <= allocated").drop("_n", "allocated")


def double_coding(items: DataFrame, rate: float, seed: str) -> DataFrame:
    """Of each source's distinct items the share that two coders code, one at least."""
    distinct = items.select("source", "item_id").distinct()
    sizes = distinct.groupBy("source").agg(F.greatest(F.lit(1), F.ceil(F.lit(rate) * F.count("*"))).alias("allocated")).withColumnRenamed("source", "stratum")
    return sampled(distinct.withColumnRenamed("source", "stratum"), sizes, "item_id", seed).withColumnRenamed("stratum", "source")


def language_quota(counts: DataFrame, budget: int) -> DataFrame:
    """A budget dealt to languages by largest remainder of their counts; each with items gets one at least."""
    everything = Window.partitionBy()
    share = F.lit(budget) * F.col("n") / F.sum("n").over(everything)
    t = counts.where("n > 0").withColumn("_share", share).withColumns({"_floor": F.floor("_share"), "_frac": F.col("_share") - F.floor("_share")})
    t = t.withColumn("_left", F.lit(budget) - F.sum("_floor").over(everything))
    place = F.row_number().over(Window.orderBy(F.desc("_frac"), "language"))
    return t.select("language", "n", F.greatest(F.lit(1), F.col("_floor") + F.when(place <= F.col("_left"), 1).otherwise(0)).cast("long").alias("quota"))


def split_by_year(windows: DataFrame) -> DataFrame:
    """A row for each calendar year of a window (since, until), clipped to it."""
    years = windows.withColumn("year", F.explode(F.sequence(F.year("since"), F.year("until"))))
    return years.select("*", F.greatest("since", F.make_date("year", F.lit(1), F.lit(1))).alias("from_day"), F.least("until", F.make_date("year", F.lit(12), F.lit(31))).alias("to_day"))


def halves(windows: DataFrame) -> DataFrame:
    """Both halves of each window: up to the middle day, and from the day after it."""
    mid = F.date_add("since", F.floor(F.datediff("until", "since") / 2).cast("int"))
    parts = F.array(F.struct(F.lit(1).alias("half"), F.col("since").alias("from_day"), mid.alias("to_day")), F.struct(F.lit(2).alias("half"), F.date_add(mid, 1).alias("from_day"), F.col("until").alias("to_day")))
    return windows.withColumn("_p", F.explode(parts)).select(*windows.columns, "_p.*").where("from_day <= to_day")


def request_plan(queries: DataFrame, policies: DataFrame) -> DataFrame:
    """Rows (source, requests): pages of each query within the source's caps, summed and capped; unknown totals take all pages."""
    cap = F.coalesce("total_cap", F.lit(1_000_000_000))
    pages = F.when(F.col("total").isNull(), F.col("max_pages")).otherwise(F.least("max_pages", F.ceil(F.least("total", cap) / F.col("page_size"))))
    return queries.join(F.broadcast(policies), "source").groupBy("source").agg(F.least(F.sum(pages) + F.max("estimate_requests"), F.max("max_requests")).cast("long").alias("requests"))


def fair_shares(sources: DataFrame, budget: int) -> DataFrame:
    """Caps by source: max(50, 3 * budget / n), for open sources max(25, 2 * budget / n_open); census sources have none."""
    everything = Window.partitionBy()
    n, n_open = F.count("*").over(everything), F.sum(F.col("is_open").cast("int")).over(everything)
    raw, free = F.greatest(F.lit(50), F.floor(3 * F.lit(budget) / n)), F.greatest(F.lit(25), F.floor(2 * F.lit(budget) / n_open))
    return sources.withColumn("cap", F.when(F.col("census"), None).when(F.col("is_open"), free).otherwise(raw).cast("long"))


def enrich_priority(items: DataFrame) -> DataFrame:
    """Repositories by what points to them: workflow 3, code 2, repository 1; then by first sight."""
    score = F.when(F.col("is_workflow"), 3).when(F.col("kind") == "code", 2).when(F.col("kind") == "repo", 1).otherwise(0)
    return items.where("repo is not null").groupBy("repo").agg(F.max(score).alias("score"), F.min("seq").alias("first_seq"))


def poisson_bootstrap(rows: DataFrame, value: str, draws: int, seed: int = 20261031) -> DataFrame:
    """Means of resamples: each row counts a Poisson(1) number of times in each draw, by a hash of row and draw.

    Rows aren't multiplied by draws in a shuffle: each partition adds up its own sums for all draws.
    """
    per = rows.select(F.col(value).cast("double").alias("v"), F.xxhash64("*", F.lit(seed)).alias("h"))
    u = lambda d: F.pmod(F.xxhash64(F.col("h"), d), F.lit(1_000_000)) / 1_000_000.0

    def times(x: Column) -> Column:
        # quantiles of the Poisson distribution with mean 1
        return F.when(x < 0.36788, 0).when(x < 0.73576, 1).when(x < 0.91970, 2).when(x < 0.98101, 3).when(x < 0.99634, 4).when(x < 0.99941, 5).otherwise(6)

    exploded = per.select("v", "h", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("k", times(u(F.col("draw"))))
    return exploded.groupBy("draw").agg((F.sum(F.col("v") * F.col("k")) / F.sum("k")).alias("mean"))
