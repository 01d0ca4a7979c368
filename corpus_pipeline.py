"""The corpus pipeline: STAGES in order, each working on all that the one before it kept.

Counted as part of the subpackage `llm`. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm import decontaminate, jaccard_join, language_id, mixing, pii, spans
from corpusmill.llm.common import removed, table, whole, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language can't be told: null, empty and letterless texts. Learns from the given `lang`s.

    Repeated rows all stay. If no row has a `lang`, no language is known and every document goes. An empty table gives
    an empty table.
    """
    model = language_id.train(docs)
    return language_id.identify(docs, model).where("lang_pred != 'und'").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of near copies: the least by doc_id (null last), then by a hash of the row.

    Rows are told apart by all their columns, so those that share a doc_id, or lack one, are grouped by their texts like
    others. Of equal rows one stays; so do all different rows without a word, which link with nothing. An empty table
    gives an empty table.
    """
    own = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64(*COLUMNS).alias("row"))
    rows = docs.select(own.alias("key"), *COLUMNS)
    linked = jaccard_join.linked(rows.select(F.col("key").alias("doc_id"), "text"))
    # keys are never null, so plain equality finds them, and the join deals them as the window wants them
    chosen = linked.where("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    once = rows.join(chosen, F.col("key") == F.col("first")).withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("key")))
    return once.where("n = 1").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item. Null and empty texts hold none and stay, as do repeated rows."""
    return decontaminate.scan(docs, table(spark, sf_dir, "benchmark", "item_id", "text")).where("not contaminated").select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind's name in brackets in place of each span of personal data; all documents stay.

    Null texts stay null, empty ones empty; repeated rows are masked alike. An empty table gives an empty table.
    """
    found = pii.detect(docs)
    masked = spans.replaced(whole(), F.col("spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    out = found.withColumn("text", F.when(F.col("text").isNotNull(), masked))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the tokens that it takes of each, repeats counted.

    Texts without a word are never taken; repeated rows are documents of their own. An empty table gives an empty table.
    """
    return mixing.mix(docs).where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("source_mixing", mix_sources),
]

#: SQL can't express suffix automata or fitted span classifiers; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; each one's rows are written as Parquet and read again for the next.

    What a stage read is deleted once its own rows are written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
