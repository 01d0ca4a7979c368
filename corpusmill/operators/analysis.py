"""Units of analysis and the tables made from them: frequency, co-occurrence, coverage, ladders, comparison, saturation.

Inputs are long tables: detections (unit_id, item_id, source, entry_id, rank, channel), unit_method (unit_id,
method_id), unit_mode (unit_id, mode) and unit (unit_id, source, batch, rag, agente, aggregation).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNGS = ("especificado", "derivado", "referencia", "pseudo-automatico", "humano")


def n_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def best_levels(detections: DataFrame) -> DataFrame:
    """Rows (entry_id, unit_id, rank, channels): the best level of each entry in each unit."""
    channel = F.coalesce("channel", F.lit("open"))
    return detections.groupBy("entry_id", "unit_id").agg(F.max("rank").alias("rank"), F.sort_array(F.collect_set(channel)).alias("channels"))


def level_summary(detections: DataFrame) -> DataFrame:
    """Rows (entry_id, n1, n2, n3): units by best level, each in one column."""
    best = detections.groupBy("entry_id", "unit_id").agg(F.max("rank").alias("rank"))
    return best.groupBy("entry_id").agg(*(n_if(F.col("rank") == k).alias(f"n{k}") for k in (1, 2, 3)))


def units_from_detections(detections: DataFrame, methods: DataFrame, units: DataFrame) -> DataFrame:
    """One row a unit: sorted item ids, systems, tools with best level, tools with channels, sorted methods."""
    best = best_levels(detections)
    tools = best.groupBy("unit_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entry_id", "rank")))).alias("tools"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("entry_id", "channels")))).alias("tool_channels"),
    )
    items = detections.groupBy("unit_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    by_method = methods.groupBy("unit_id").agg(F.sort_array(F.collect_set("method_id")).alias("methods"))
    systems = F.filter(F.array(F.when(F.col("agente"), "agente"), F.when(F.col("rag"), "rag")), lambda s: s.isNotNull())
    joined = units.select("unit_id", "source", systems.alias("systems")).join(items, "unit_id", "left").join(tools, "unit_id", "left").join(by_method, "unit_id", "left")
    return joined.withColumn("methods", F.coalesce("methods", F.array().cast("array<string>")))


def frequency(detections: DataFrame, methods: DataFrame, units: DataFrame, channel: str = "all") -> DataFrame:
    """Rows by entry and kind: units, levels, systems, channels. Methods always count as found in the open."""
    tools = best_levels(detections).select("unit_id", F.col("entry_id").alias("entry"), F.lit("tool").alias("kind"), "rank", F.array_contains("channels", "open").alias("is_open"), F.array_contains("channels", "anchored").alias("is_anchored"))
    used = methods.distinct().select("unit_id", F.col("method_id").alias("entry"), F.lit("method").alias("kind"), F.lit(None).cast("int").alias("rank"), F.lit(True).alias("is_open"), F.lit(False).alias("is_anchored"))
    rows = tools.unionByName(used)
    if channel != "all":
        rows = rows.where(f"is_{channel}")
    known = rows.join(units.select("unit_id", "source", "rag", "agente"), "unit_id")
    return known.groupBy("entry", "kind").agg(
        F.count("*").alias("units"), *(n_if(F.col("rank") == k).alias(f"n{k}") for k in (1, 2, 3)),
        n_if(F.col("rag")).alias("rag"), n_if(F.col("agente")).alias("agente"), n_if(F.col("is_open")).alias("open_units"), n_if(F.col("is_anchored")).alias("anchored_units"), F.count_distinct("source").alias("n_sources"),
    )


def pairs_within(left: DataFrame, right: DataFrame, n_units: DataFrame, same: bool, min_together: int = 1) -> DataFrame:
    """Co-occurrence of entries of two long tables (unit_id, entry) within units, with jaccard and lift.

    lift's denominator is all units, those without entries too.
    """
    a, b = left.distinct().withColumnRenamed("entry", "a"), right.distinct().withColumnRenamed("entry", "b")
    together = a.join(b, "unit_id")
    if same:
        together = together.where("a < b")
    pairs = together.groupBy("a", "b").agg(F.count("*").alias("together")).where(F.col("together") >= min_together)
    of = lambda t, c: t.groupBy(c).agg(F.count("*").alias(f"{c}_units"))
    out = pairs.join(of(a, "a"), "a").join(of(b, "b"), "b").crossJoin(F.broadcast(n_units.agg(F.count("*").alias("n"))))
    t, x, y = F.col("together"), F.col("a_units"), F.col("b_units")
    return out.select("a", "b", "together", "a_units", "b_units", F.round(t / (x + y - t), 4).alias("jaccard"), F.round(t * F.col("n") / (x * y), 4).alias("lift"))


def by_system(units: DataFrame) -> DataFrame:
    """Rows (unit_id, system): rag and agente, both for hybrids, `unlabelled` for neither."""
    systems = F.filter(F.array(F.when(F.col("rag"), "rag"), F.when(F.col("agente"), "agente"), F.when(~F.col("rag") & ~F.col("agente"), "unlabelled")), lambda s: s.isNotNull())
    return units.select("unit_id", F.explode(systems).alias("system"))


def coverage_cells(modes: DataFrame, detections: DataFrame, methods: DataFrame, units: DataFrame) -> DataFrame:
    """Units by (mode, entry, kind, system)."""
    entries = detections.select("unit_id", F.col("entry_id").alias("entry"), F.lit("tool").alias("kind")).unionByName(methods.select("unit_id", F.col("method_id").alias("entry"), F.lit("method").alias("kind"))).distinct()
    return modes.join(entries, "unit_id").join(by_system(units), "unit_id").groupBy("mode", "entry", "kind", "system").agg(F.count("*").alias("units"))


def coverage_summary(catalog: DataFrame, modes: DataFrame, detections: DataFrame, units: DataFrame, top: int = 5) -> DataFrame:
    """Each mode of the catalog (with zeros) and those outside it: units, covered units, systems, and the top entries."""
    with_tool = detections.select("unit_id").distinct().withColumn("covered", F.lit(True))
    seen = modes.distinct().join(units.select("unit_id", "rag", "agente"), "unit_id").join(with_tool, "unit_id", "left").groupBy("mode").agg(F.count("*").alias("units"), n_if(F.col("covered")).alias("covered"), n_if(F.col("rag")).alias("rag"), n_if(F.col("agente")).alias("agente"))
    counts = modes.distinct().join(detections.select("unit_id", "entry_id").distinct(), "unit_id").groupBy("mode", "entry_id").count()
    place = Window.partitionBy("mode").orderBy(F.desc("count"), "entry_id")
    best = counts.withColumn("k", F.row_number().over(place)).where(F.col("k") <= top).groupBy("mode").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "entry_id", "count"))), lambda x: F.concat(x["entry_id"], F.lit(" ("), x["count"].cast("string"), F.lit(")"))), ", ").alias("top_entries"))
    listed = catalog.select("mode").withColumn("catalogued", F.lit(True)).join(seen, "mode", "full").join(best, "mode", "left")
    return listed.select("mode", F.coalesce("catalogued", F.lit(False)).alias("catalogued"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("units", "covered", "rag", "agente")), F.coalesce("top_entries", F.lit("")).alias("top_entries"))


def coverage_matrix(cells: DataFrame, entries: list[str]) -> DataFrame:
    """Modes by entries, units summed over systems; the columns in the order given."""
    return cells.groupBy("mode").pivot("entry", entries).agg(F.sum("units")).fillna(0)


def oracle_ladder(rungs: DataFrame, unit_rung: DataFrame, units: DataFrame) -> DataFrame:
    """For all units and each system: units on each rung and their share of the units with any rung; zeros stay.

    One pass over the systems a unit counts for, `all` among them. Shares can add up to more than 1.
    """
    systems = F.filter(F.array(F.lit("all"), F.when(F.col("rag"), "rag"), F.when(F.col("agente"), "agente")), lambda s: s.isNotNull())
    member = units.select("unit_id", F.explode(systems).alias("system"))
    on = unit_rung.distinct().join(member, "unit_id")
    counts = on.groupBy("system", "rung").agg(F.count("*").alias("units"))
    totals = on.groupBy("system").agg(F.count_distinct("unit_id").alias("with_rung"))
    grid = rungs.crossJoin(F.broadcast(units.sparkSession.createDataFrame([("all",), ("rag",), ("agente",)], "system string")))
    out = grid.join(counts, ["system", "rung"], "left").join(totals, "system", "left")
    share = F.when(F.col("with_rung") > 0, F.round(F.coalesce("units", F.lit(0)) / F.col("with_rung"), 4)).otherwise(0.0)
    return out.select("system", "rung", F.coalesce("units", F.lit(0)).alias("units"), share.alias("share"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson's interval of k of n, within 0 and 1; 0 and 0 without trials."""
    p = k / n
    centre, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    low, high = F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)
    return F.when(n == 0, 0.0).otherwise(low), F.when(n == 0, 0.0).otherwise(high)


def binomial_greater(k: int, n: int, p: float = 0.5) -> float:
    """Exact one-sided probability of k or more of n."""
    if k <= 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k, n + 1)]
    top = max(logs, default=-math.inf)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs)) if logs else 0.0


def aggregation_test(units: DataFrame) -> DataFrame:
    """One row: atomic, aggregated and unidentified units, the atomic share with Wilson's interval."""
    k = n_if(F.col("aggregation") == "atomico").alias("atomic")
    row = units.agg(k, n_if(F.col("aggregation") == "agregado").alias("aggregated"), n_if(~F.col("aggregation").isin("atomico", "agregado") | F.col("aggregation").isNull()).alias("unidentified"))
    n = F.col("atomic") + F.col("aggregated")
    low, high = wilson(F.col("atomic"), n)
    return row.select("*", F.when(n > 0, F.col("atomic") / n).otherwise(0.0).alias("share"), low.alias("low"), high.alias("high"))


def compare(detections: DataFrame, methods: DataFrame, modes: DataFrame, rungs: DataFrame, units: DataFrame) -> DataFrame:
    """Entries of all kinds by the systems whose units hold them: transfers, rag-only or agent-only."""
    long = lambda t, c, k: t.select("unit_id", F.col(c).alias("entry"), F.lit(k).alias("kind"))
    rows = long(detections, "entry_id", "tool").unionByName(long(methods, "method_id", "method")).unionByName(long(modes, "mode", "failure_mode")).unionByName(long(rungs, "rung", "oracle")).distinct()
    counts = rows.join(units.select("unit_id", "rag", "agente"), "unit_id").groupBy("kind", "entry").agg(n_if(F.col("rag")).alias("rag"), n_if(F.col("agente")).alias("agente"), n_if(F.col("rag") & F.col("agente")).alias("hybrid"))
    category = F.when((F.col("rag") > 0) & (F.col("agente") > 0), "transfers").when(F.col("rag") > 0, "rag-only").otherwise("agent-only")
    return counts.where("rag + agente > 0").withColumn("category", category)


def compare_summary(compared: DataFrame) -> DataFrame:
    both, rag, agent = (n_if(F.col("category") == c) for c in ("transfers", "rag-only", "agent-only"))
    return compared.groupBy("kind").agg((rag + both).alias("n_rag"), (agent + both).alias("n_agente"), both.alias("shared"), (both / F.count("*")).alias("jaccard"), F.when(agent + both > 0, both / (agent + both)).otherwise(0.0).alias("agent_transfer_rate"))


def saturation(codes: DataFrame, batches: DataFrame, window: int = 1, tolerance: int = 0) -> DataFrame:
    """New and cumulative codes by batch, from rows (unit_id, code) and (unit_id, batch), a row for every batch.

    A batch is saturated if it and the ones before it within the window bring at most `tolerance` new codes each. The
    window runs over the batches alone.
    """
    first = batches.groupBy("unit_id").agg(F.min("batch").alias("batch"))
    new = codes.join(first, "unit_id").groupBy("code").agg(F.min("batch").alias("batch")).groupBy("batch").agg(F.count("*").alias("new"))
    units = first.groupBy("batch").agg(F.count("*").alias("units"))
    order = Window.orderBy("batch")
    out = units.join(new, "batch", "left").withColumn("new_codes", F.coalesce("new", F.lit(0))).drop("new")
    recent = order.rowsBetween(1 - window, 0)
    return out.select("batch", "units", "new_codes", F.sum("new_codes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cumulative"), ((F.max("new_codes").over(recent) <= tolerance) & (F.row_number().over(order) >= window)).alias("saturated"))


def consensus(records: DataFrame, key: str, coder: str, value: str, senior: str) -> DataFrame:
    """Rows (key, value): the senior coder's value outright, else the one all agree on (null counts), else null."""
    seen = records.groupBy(key).agg(
        F.max(F.col(coder) == senior).alias("_has"), F.max_by(value, F.col(coder) == senior).alias("_senior"),
        F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("\x00"))).alias("_n"), F.first(value).alias("_any"),
    )
    return seen.select(key, F.when(F.col("_has"), F.col("_senior")).when(F.col("_n") == 1, F.col("_any")).alias(value))


def consensus_lists(records: DataFrame, key: str, coder: str, values: str) -> DataFrame:
    """Rows (key, values): what all coders of a key list, in the order of the first coder's list."""
    order = F.sort_array(F.collect_list(F.struct(coder, values)))
    grouped = records.groupBy(key).agg(order.alias("_all"))
    shared = F.aggregate(F.slice("_all", 2, F.size("_all")), F.col("_all")[0][values], lambda acc, x: F.array_intersect(acc, x[values]))
    return grouped.select(key, shared.alias(values))


def pyramid(catalog: DataFrame, detections: DataFrame, units: DataFrame, own: DataFrame) -> DataFrame:
    """Tools of the catalog (family framework-sut left out, zeros kept): units by level without the tool's own, and ranks."""
    best = detections.groupBy("entry_id", "unit_id").agg(F.max("rank").alias("rank")).join(units.select("unit_id", "rag", "agente"), "unit_id")
    mine = own.select(F.col("entry_id").alias("_e"), F.col("unit_id").alias("_u"))
    marked = best.join(mine, (F.col("entry_id") == F.col("_e")) & (F.col("unit_id") == F.col("_u")), "left").withColumn("_self", F.col("_e").isNotNull())
    ok = ~F.col("_self")
    counts = marked.groupBy("entry_id").agg(*(n_if(ok & (F.col("rank") == k)).alias(f"n{k}") for k in (3, 2, 1)), n_if(F.col("_self")).alias("self"), n_if(ok & F.col("rag")).alias("rag"), n_if(ok & F.col("agente")).alias("agente"))
    out = catalog.where("family != 'framework-sut'").join(counts, "entry_id", "left").fillna(0)
    for k in (1, 2, 3):
        out = out.withColumn(f"rank_n{k}", F.rank().over(Window.orderBy(F.desc(f"n{k}"))))
    return out
