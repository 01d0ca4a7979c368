"""Coding sheets and what becomes of them: cells, decisions, consensus coders, units from codings, resolutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold

#: Words for decisions and truth values in sheets.
DECISIONS = {"include": "include", "yes": "include", "y": "include", "sim": "include", "1": "include", "exclude": "exclude", "no": "exclude", "n": "exclude", "nao": "exclude", "0": "exclude", "uncertain": "uncertain", "maybe": "uncertain", "talvez": "uncertain", "?": "uncertain"}
TRUE, FALSE = ("true", "yes", "y", "sim", "s", "1", "x"), ("false", "no", "n", "nao", "0")
#: Names that mark a consensus record.
CONSENSUS = ("consensus", "consenso", "resolved", "final", "adjudicated")


def decision(cell: Column) -> Column:
    """A sheet's decision by its aliases; null for anything else."""
    key = F.lower(fold(F.trim(cell)))
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in DECISIONS.items() for x in kv)), key)


def truth(cell: Column) -> Column:
    key = F.lower(fold(F.trim(cell)))
    return F.when(key.isin(*TRUE), True).when(key.isin(*FALSE), False)


def allowed_values(cell: Column, allowed: list[str], multi: bool) -> tuple[Column, Column]:
    """(values, problems) of a cell: entries matched to the allowed ones without regard to case and accents."""
    table = F.create_map(*(F.lit(x) for a in allowed for x in (_plain(a), a)))
    raw = F.split(cell, "[,;|]") if multi else F.array(cell)
    entries = F.array_distinct(F.filter(F.transform(raw, lambda x: F.trim(x)), lambda x: x != ""))
    found = F.transform(entries, lambda x: F.try_element_at(table, F.lower(fold(x))))
    return F.array_distinct(F.filter(found, lambda x: x.isNotNull())), F.filter(entries, lambda x: F.try_element_at(table, F.lower(fold(x))).isNull())


def _plain(text: str) -> str:
    from ..functions.text import fold_text

    return fold_text(text).lower()


def is_consensus(coder: Column) -> Column:
    """Whether a record's coder stands for all: by name or a word in it."""
    out = F.lit(False)
    for name in CONSENSUS:
        out = out | F.contains(F.lower(coder), F.lit(name))
    return out


def valid_coder(name: Column) -> Column:
    """Whether a name can be a coder's: 1 to 50 plain characters, none of the reserved words."""
    return F.coalesce(name.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ._-]{0,49}$") & ~F.lower(name).isin("all", "none", "null", "final"), F.lit(False))


def final_decisions(records: DataFrame) -> DataFrame:
    """Rows (item_id, decision): a consensus record's, else the one all coders share, else uncertain."""
    marked = records.withColumn("_c", is_consensus(F.col("coder")))
    seen = marked.groupBy("item_id").agg(F.max("_c").alias("has"), F.max_by("decision", "_c").alias("senior"), F.count_distinct("decision").alias("n"), F.min("decision").alias("any"))
    return seen.select("item_id", F.when(F.col("has"), F.col("senior")).when(F.col("n") == 1, F.col("any")).otherwise("uncertain").alias("decision"))


def units_from_codings(codings: DataFrame) -> DataFrame:
    """Units from coded items (unit_id, item_id, seq, systems, tools map of levels, methods, modes, oracle, aggregation).

    Lists are united; a tool's level is its best, and 1 without one; single values are the first given, in order.
    """
    lists = codings.groupBy("unit_id").agg(
        F.array_sort(F.array_distinct(F.collect_list("item_id"))).alias("item_ids"),
        *(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>")))))).alias(c) for c in ("systems", "methods", "modes")),
        *(F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("seq", c))).alias(c) for c in ("oracle", "aggregation")),
    )
    levels = codings.select("unit_id", F.explode("tools").alias("tool", "level")).groupBy("unit_id", "tool").agg(F.max(F.coalesce("level", F.lit(1))).alias("level"))
    tools = levels.groupBy("unit_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "level")))).alias("tools"))
    return lists.join(tools, "unit_id", "left")


def resolved(records: DataFrame, answers: DataFrame) -> DataFrame:
    """Records with the answers to disagreements put over the values of the consensus coder (item_id, field, value)."""
    new = answers.select("item_id", "field", F.col("value").alias("_new"), F.lit(True).alias("_is"))
    joined = records.join(new, ["item_id", "field"], "full")
    return joined.select("item_id", "field", F.when(F.col("_is"), F.col("_new")).otherwise(F.col("value")).alias("value"))
