"""Mixing of sources to target weights by a low-discrepancy schedule.

Each source's documents are laid end to end in hash order and cut into blocks of equal token counts. Golden-ratio
points, mapped through the sources' cumulative slot shares, deal out the slots; the r-th slot of a source takes its
r-th block, from the beginning again once all are taken. All steps are native, and every running sum is taken in two
levels (chunk, then within a chunk), so that a source with a third of all rows isn't one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stored, whole

WEIGHTS = (3, 1, 2)
BLOCK_TOKENS = 256
GOLDEN = 0.6180339887498949
#: Chunks of the hash order of each source, and slots of a chunk.
CHUNKS, CHUNK_SLOTS = 4096, 8192


def targets(sizes: DataFrame, *, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """Adds weight and target to a table (source, source_size) of one row a source.

    Sources are ranked by code point, null last, and weighted in turn. The targets share `share` times all tokens by
    weight; none exceeds `most` times its source, the excess going to the others by weight. That is water-filling: in
    the order of capacity by weight, the sources up to some place are full and the rest share what is left. Windows
    run over the table of sources, a row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    out = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    room = (most * F.col("source_size")).cast("double")
    out = out.withColumns({"_room": room, "_all": share * F.sum("source_size").over(everything), "_ratio": room / F.col("weight")})
    before = Window.orderBy("_ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    full_before, weight_before = F.coalesce(F.sum("_room").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.col("_all") - full_before) / (F.sum("weight").over(everything) - weight_before)
    out = out.withColumn("_level", level)
    out = out.withColumn("_final", F.min_by(F.col("_level"), F.when(F.col("_level") < F.col("_ratio"), F.col("_ratio"))).over(everything))
    target = F.when(F.col("_final").isNull() | (F.col("_ratio") <= F.col("_final")), F.col("_room")).otherwise(F.col("_final") * F.col("weight"))
    # the first source that isn't full sets the level; later ones have higher ratios
    return out.withColumn("target", target).select("source", "source_size", "weight", "target")


def laid_out(docs: DataFrame) -> DataFrame:
    """Adds `start`: where the document's tokens begin in its source's stream, in hash order."""
    key = F.xxhash64("doc_id", "_text", F.lit("mix"))
    placed = docs.withColumns({"_key": key, "_chunk": F.pmod(key, F.lit(CHUNKS))})
    sums = placed.groupBy("source", "_chunk").agg(F.sum("size").alias("_sum"))
    ahead = F.coalesce(F.sum("_sum").over(Window.partitionBy("source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(F.col("source").alias("_source"), F.col("_chunk").alias("_of"), ahead.alias("_ahead"))
    within = Window.partitionBy("source", "_chunk").orderBy("_key", "doc_id", "_text").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(sums, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_chunk") == F.col("_of")))
    return joined.withColumn("start", F.col("_ahead") + F.col("_within")).drop("_key", "_chunk", "_source", "_of", "_ahead", "_within")


def schedule(plan: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The slots, from a table (source, source_size, target): slot, source, rank, epoch, block and used (its tokens).

    A source gets as many slots as its target needs; its last slot takes only part of a block. Points that fall to a
    source after its last slot are skipped; what the points leave owing to a source comes at the end.
    """
    spark = plan.sparkSession
    b = F.lit(block_tokens)
    goal = F.round("target").cast("long")
    p = plan.where("source_size > 0").withColumns({"_goal": F.least(goal, 2 * F.col("source_size")), "_blocks": F.ceil(F.col("source_size") / b)})
    rest = F.col("_goal") % F.col("source_size")
    p = p.withColumns({"_epochs": F.floor(F.col("_goal") / F.col("source_size")), "_rest": rest})
    p = p.withColumn("_slots", F.col("_epochs") * F.col("_blocks") + F.ceil(F.col("_rest") / b)).where("_slots > 0")
    upto = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("_to", F.sum("_slots").over(upto)).withColumn("_from", F.col("_to") - F.col("_slots"))
    p = stored(p.withColumn("_no", F.row_number().over(Window.orderBy("_to"))))
    total = p.agg(F.coalesce(F.max("_to"), F.lit(0))).first()[0]
    # a point falls to the source whose slots its place among all slots lies in: a range, met by bins of equal width
    bins = max(1, min(total, 4096))
    width = -(-total // bins) if total else 1
    ranges = p.select("_no", "_from", "_to", F.explode(F.sequence(F.floor(F.col("_from") / width), F.floor((F.col("_to") - 1) / width))).alias("_bin"))
    points = spark.range(total).withColumn("_at", F.floor((((F.col("id") + 1) * GOLDEN) % 1.0) * total)).withColumn("_bin", F.floor(F.col("_at") / width))
    dealt = points.join(ranges, "_bin").where("_at >= _from and _at < _to").select(F.col("id").alias("slot"), "_no", F.floor(F.col("id") / CHUNK_SLOTS).alias("_chunk"))
    dealt = stored(dealt)
    counts = dealt.groupBy("_no", "_chunk").count()
    ahead = F.coalesce(F.sum("count").over(Window.partitionBy("_no").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_ahead", ahead).drop("count")
    local = F.row_number().over(Window.partitionBy("_no", "_chunk").orderBy("slot")) - 1
    ranked = dealt.withColumn("_local", local).join(counts, ["_no", "_chunk"]).select("slot", "_no", (F.col("_ahead") + F.col("_local")).alias("rank"))
    sources = p.select("_no", "source", "source_size", "_slots", "_blocks", "_epochs", "_rest")
    drawn = dealt.groupBy("_no").count()
    owed = p.join(drawn, "_no", "left").select("_no", F.coalesce("count", F.lit(0)).alias("_had"), "_slots").where("_had < _slots")
    owed = owed.select(F.explode(F.sequence(F.col("_had"), F.col("_slots") - 1)).alias("rank"), "_no").select((F.lit(total) + F.col("rank")).alias("slot"), "_no", "rank")
    slots = ranked.unionByName(owed).join(F.broadcast(sources) if p.count() <= 10_000 else sources, "_no").where("rank < _slots")
    block = F.col("rank") % F.col("_blocks")
    length = F.least(b, F.col("source_size") - block * b)
    used = F.when((F.floor(F.col("rank") / F.col("_blocks")) == F.col("_epochs")), F.least(length, F.col("_rest") - block * b)).otherwise(length)
    return slots.select("slot", "source", "rank", F.floor(F.col("rank") / F.col("_blocks")).alias("epoch"), block.alias("block"), used.alias("used"))


def mix(docs: DataFrame, *, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Returns doc_id, source, size, source_size, target and taken (the tokens that the mix takes, repeats counted).

    Null and empty texts have size 0 and are never taken; a null source is a source of its own, ranked last. Repeated
    rows are documents of their own, and so are rows without a doc_id. Reruns agree: the order is by hashes of doc_id and
    text, then doc_id; rows equal in both may change places, which changes nothing but which of them is taken. An empty
    table gives an empty table. Other columns of the input are not looked at. Windows over the table of sources are one
    task's work: it has a row a source.
    """
    text = whole()
    sized = stored(docs.select("doc_id", "source", n_words(text).alias("size"), F.xxhash64(text).alias("_text")))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = stored(targets(sizes, share=share, most=most, weights=weights))
    few = plan.count() <= 10_000
    small = lambda x: F.broadcast(x) if few else x
    slots = schedule(plan, block_tokens)
    taken = slots.groupBy("source", "block").agg(F.sum("used").alias("_sum"), F.collect_list("used").alias("_used"))
    at = stored(laid_out(sized).withColumn("_row", F.monotonically_increasing_id()))
    b = F.lit(block_tokens)
    spans = at.where("size > 0").select("_row", "source", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))).alias("_block"))
    joined = spans.join(taken.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (F.col("_block") == F.col("block")))
    low = F.greatest(F.col("start") - F.col("_block") * b, F.lit(0))
    overlap = lambda u: F.greatest(F.least(F.col("start") + F.col("size") - F.col("_block") * b, u) - low, F.lit(0))
    got = joined.select("_row", F.aggregate(F.transform("_used", overlap), F.lit(0).cast("long"), lambda a, x: a + x).alias("_got")).groupBy("_row").agg(F.sum("_got").alias("_taken"))
    plan = small(plan.select(F.col("source").alias("_of"), "source_size", "target"))
    out = at.join(got, "_row", "left").join(plan, F.col("source").eqNullSafe(F.col("_of")))
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"), "_text")
