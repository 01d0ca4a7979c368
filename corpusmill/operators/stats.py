"""Rank statistics from windows and counts: mid-rank percentiles, tau, rho, H, Dunn, Holm, delta, kappa.

Ranks over a whole table come from counts of distinct values (value, n), which a map-side aggregate makes first, so the
windows run over values and not over rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_midranks(rows: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Adds percentile (and weighted_percentile): the mid-rank of value within its stratum, scaled to 0..1.

    0.5 where a stratum has one row or no other weight.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("_t"), F.sum(w).alias("_wt"))
    within = Window.partitionBy(*by)
    below = within.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    table = counts.withColumns({"_below": F.coalesce(F.sum("_t").over(below), F.lit(0)), "_n": F.sum("_t").over(within), "_wbelow": F.coalesce(F.sum("_wt").over(below), F.lit(0.0)), "_w": F.sum("_wt").over(within)})
    keys = [*by, value]
    renamed = table.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), "_t", "_wt", "_below", "_n", "_wbelow", "_w")
    on = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = c if on is None else on & c
    joined = rows.join(renamed, on)
    e = F.when(F.col("_n") < 2, 0.5).otherwise((F.col("_below") + (F.col("_t") - 1) / 2) / (F.col("_n") - 1))
    out = joined.withColumn("percentile", e)
    if weight:
        others = F.col("_w") - w
        out = out.withColumn("weighted_percentile", F.when(others <= 0, 0.5).otherwise((F.col("_wbelow") + 0.5 * (F.col("_wt") - w)) / others))
    return out.drop("_t", "_wt", "_below", "_n", "_wbelow", "_w", *(f"_k{i}" for i in range(len(keys))))


def average_ranks(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Rows (by..., value, ties, rank): the average rank of each distinct value and how many rows have it."""
    by = by or []
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("ties"))
    below = Window.partitionBy(*by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("rank", F.coalesce(F.sum("ties").over(below), F.lit(0)) + (F.col("ties") + 1) / 2)


def kendall(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: concordant, discordant and tau-b of a small table with a row for each entry; null if a side is constant.

    The table is a catalog's, so its pairs are few; they are made by one range join.
    """
    a = table.select(F.col(x).alias("x1"), F.col(y).alias("y1"), F.xxhash64(*table.columns).alias("i"))
    b = a.select(F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("i").alias("j"))
    s = F.signum(F.col("x1") - F.col("x2")) * F.signum(F.col("y1") - F.col("y2"))
    pairs = a.join(b, F.col("i") < F.col("j"))
    out = pairs.agg(F.count(F.when(s > 0, 1)).alias("concordant"), F.count(F.when(s < 0, 1)).alias("discordant"), F.count("*").alias("n0"), F.count(F.when(F.col("x1") == F.col("x2"), 1)).alias("n1"), F.count(F.when(F.col("y1") == F.col("y2"), 1)).alias("n2"))
    root = F.sqrt((F.col("n0") - F.col("n1")).cast("double") * (F.col("n0") - F.col("n2")))
    return out.select("concordant", "discordant", F.when(root > 0, (F.col("concordant") - F.col("discordant")) / root).alias("tau"))


def spearman(table: DataFrame, x: str, y: str) -> DataFrame:
    """One row: the correlation of average ranks."""
    rx, ry = average_ranks(table, x).select(F.col(x).alias("_x"), F.col("rank").alias("rx")), average_ranks(table, y).select(F.col(y).alias("_y"), F.col("rank").alias("ry"))
    return table.join(rx, F.col(x) == F.col("_x")).join(ry, F.col(y) == F.col("_y")).agg(F.corr("rx", "ry").alias("rho"))


def rank_sums(rows: DataFrame, group: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Rows (group, n, rank_sum), and one row (total, tie_sum): what the rank tests need."""
    ranks = average_ranks(rows, value)
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    sums = counts.join(ranks, value).groupBy(group).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("rank")).alias("rank_sum"))
    t = F.col("ties").cast("double")
    return sums, ranks.agg(F.sum("ties").alias("total"), F.sum(t * t * t - t).alias("tie_sum"))


def kruskal(rows: DataFrame, group: str, value: str) -> DataFrame:
    """One row: tie-corrected H, its degrees of freedom and epsilon squared."""
    sums, totals = rank_sums(rows, group, value)
    n = F.col("total").cast("double")
    made = sums.agg(F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("s"), (F.count("*") - 1).alias("df")).crossJoin(totals)
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("tie_sum") / (n * n * n - n))
    return made.withColumn("h", h).select("df", "h", (F.col("h") / (n - 1)).alias("epsilon2"))


def dunn(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows (a, b, z, p, p_holm, delta): Dunn's comparison of all pairs of groups with Holm's correction, and Cliff's delta."""
    sums, totals = rank_sums(rows, group, value)
    a, b = sums.select(F.col(group).alias("a"), F.col("n").alias("na"), F.col("rank_sum").alias("ra")), sums.select(F.col(group).alias("b"), F.col("n").alias("nb"), F.col("rank_sum").alias("rb"))
    n = F.col("total").cast("double")
    se = F.sqrt((n * (n + 1) / 12 - F.col("tie_sum") / (12 * (n - 1))) * (1 / F.col("na") + 1 / F.col("nb")))
    pairs = a.join(b, F.col("a") < F.col("b")).crossJoin(totals).withColumn("z", F.when(se == 0, 0.0).otherwise((F.col("ra") / F.col("na") - F.col("rb") / F.col("nb")) / se))
    tested = holm(pairs.withColumn("p", two_sided(F.col("z"))).select("a", "b", "z", "p"), "p", ["a", "b"])
    return tested.join(cliffs_delta(rows, group, value), ["a", "b"])


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (rational Chebyshev fit, relative error below 1.2e-7)."""
    t = 1 / (1 + 0.5 * x)
    poly = F.lit(0.17087277)
    for c in (-0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def two_sided(z: Column) -> Column:
    return erfc(F.abs(z) / math.sqrt(2))


def holm(tests: DataFrame, p: str, order: list[str]) -> DataFrame:
    """Adds p_holm: the running maximum of min(1, (m - rank) * p) in the order of p."""
    by_p = Window.orderBy(p, *order)
    scaled = tests.withColumn("_s", F.least(F.lit(1.0), (F.count("*").over(Window.partitionBy()) - F.row_number().over(by_p) + 1) * F.col(p)))
    return scaled.withColumn("p_holm", F.max("_s").over(by_p.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def cliffs_delta(rows: DataFrame, group: str, value: str) -> DataFrame:
    """Rows (a, b, delta) for all pairs of groups: P(a > b) - P(a < b), from counts of distinct values."""
    counts = rows.groupBy(group, value).agg(F.count("*").alias("c"))
    totals = counts.groupBy(group).agg(F.sum("c").alias("n"))
    groups = totals.select(F.col(group).alias("a"), F.col("n").alias("na")).join(totals.select(F.col(group).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))
    one = counts.select(F.col(group).alias("a"), F.col(value).alias("v"), F.col("c").alias("ca")).join(groups, "a")
    two = counts.select(F.col(group).alias("b"), F.col(value).alias("v"), F.col("c").alias("cb")).join(groups, "b")
    merged = one.select("a", "b", "na", "nb", "v", "ca", F.lit(0).cast("long").alias("cb")).unionByName(two.select("a", "b", "na", "nb", "v", F.lit(0).cast("long").alias("ca"), "cb")).groupBy("a", "b", "na", "nb", "v").agg(F.sum("ca").alias("ca"), F.sum("cb").alias("cb"))
    w = Window.partitionBy("a", "b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    below = merged.withColumn("below", F.coalesce(F.sum("cb").over(w), F.lit(0)))
    u = F.sum(F.col("ca") * (F.col("below") + F.col("cb") / 2))
    return below.groupBy("a", "b", "na", "nb").agg(u.alias("u")).select("a", "b", (2 * F.col("u") / (F.col("na") * F.col("nb")) - 1).alias("delta"))


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, share of agreement, Cohen's kappa (null without rows or where chance explains all) and its name.

    Null is a value of its own.
    """
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("∅"))
    both = pairs.select(value(a).alias("x"), value(b).alias("y"))
    n = both.agg(F.count("*").alias("n"), F.count(F.when(F.col("x") == F.col("y"), 1)).alias("same"))
    left, right = both.groupBy(F.col("x").alias("v")).agg(F.count("*").alias("cx")), both.groupBy(F.col("y").alias("v")).agg(F.count("*").alias("cy"))
    chance = left.join(right, "v").agg(F.coalesce(F.sum(F.col("cx") * F.col("cy")), F.lit(0)).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    out = n.crossJoin(chance).withColumn("agreement", F.when(F.col("n") > 0, po)).withColumn("kappa", F.when((F.col("n") > 0) & (F.abs(1 - pe) >= 1e-9), (po - pe) / (1 - pe)))
    return out.select("n", "agreement", "kappa", landis(F.col("kappa")).alias("label"))


def landis(k: Column) -> Column:
    """The customary name of a kappa."""
    out = F.when(k.isNull(), None).when(k <= 0, "poor")
    for bound, name in ((0.2, "slight"), (0.4, "fair"), (0.6, "moderate"), (0.8, "substantial")):
        out = out.when(k <= bound, name)
    return out.otherwise("almost perfect")


def entity_summary(rows: DataFrame, by: str, top_share: float, least: int) -> DataFrame:
    """By entity: n, mean, median, share at the stratum's floor, share of the top, weighted mean; null below `least` rows.

    rows need percentile, weighted_percentile, weight and is_floor.
    """
    enough = F.col("n") >= least
    made = rows.groupBy(by).agg(F.count("*").alias("n"), F.avg("percentile").alias("mean"), F.percentile("percentile", 0.5).alias("median"), F.avg(F.col("is_floor").cast("double")).alias("share_floor"), F.avg((F.col("percentile") >= 1 - top_share).cast("double")).alias("share_top"), (F.sum(F.col("weight") * F.col("weighted_percentile")) / F.sum("weight")).alias("mean_weighted"))
    return made.select(by, "n", *(F.when(enough, F.col(c)).alias(c) for c in ("mean", "median", "share_floor", "share_top", "mean_weighted")))


def quadrants(table: DataFrame, x: str, y: str) -> DataFrame:
    """Adds quadrant: each side high where it is above the median of the table."""
    medians = table.agg(F.percentile(x, 0.5).alias("_mx"), F.percentile(y, 0.5).alias("_my"))
    high = lambda c, m: F.when(F.col(c) > F.col(m), "high").otherwise("low")
    return table.crossJoin(F.broadcast(medians)).withColumn("quadrant", F.concat_ws("-", high(x, "_mx"), high(y, "_my"))).drop("_mx", "_my")


def ols(rows: DataFrame, y: str, xs: list[str]) -> dict[str, tuple[float, float]]:
    """Least squares with HC3 errors: name -> (coefficient, standard error).

    Two passes: normal equations, then the leverage-weighted squares; the driver solves matrices of len(xs) + 1 rows.
    """
    import numpy as np

    names = ["intercept", *xs]
    cols = [F.lit(1.0), *(F.col(x).cast("double") for x in xs)]
    k = len(cols)
    row = rows.agg(*(F.sum(cols[i] * cols[j]) for i in range(k) for j in range(k)), *(F.sum(c * F.col(y)) for c in cols)).first()
    xtx, xty = np.array(row[: k * k], float).reshape(k, k), np.array(row[k * k :], float)
    inverse = np.linalg.pinv(xtx)
    beta = inverse @ xty
    fit, lever = F.lit(0.0), F.lit(0.0)
    for i in range(k):
        fit = fit + float(beta[i]) * cols[i]
        for j in range(k):
            lever = lever + float(inverse[i, j]) * cols[i] * cols[j]
    r2 = F.pow((F.col(y) - fit) / F.greatest(1 - lever, F.lit(1e-9)), 2)
    meat = np.array(rows.agg(*(F.sum(r2 * cols[i] * cols[j]) for i in range(k) for j in range(k))).first(), float).reshape(k, k)
    errors = np.sqrt(np.maximum(0, np.diag(inverse @ meat @ inverse)))
    return {n: (float(b), float(e)) for n, b, e in zip(names, beta, errors, strict=True)}


def p_value(spark, family: str, statistic: float, *parameters: float) -> float:  # noqa: ANN001
    """Upper-tail probability of a statistic on the driver: family is chi2 (df), t (df, two-sided) or f (df1, df2)."""
    d, parameters = spark._jvm.org.apache.commons.math3.distribution, tuple(map(float, parameters))
    if family == "chi2":
        return 1.0 - d.ChiSquaredDistribution(parameters[0]).cumulativeProbability(statistic)
    if family == "t":
        return 2.0 * (1.0 - d.TDistribution(parameters[0]).cumulativeProbability(abs(statistic)))
    return 1.0 - d.FDistribution(*parameters).cumulativeProbability(statistic)
