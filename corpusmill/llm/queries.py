"""One thin query per training-data operator: production parameters, whole tables, digest columns.

Each query derives its columns from the operator's real output (spans, slots, schedules, groups).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crf_quality, decontaminate, jaccard_join, language_id, lm_score, mixing, pii, quality_rules, secrets, url_filter
from .common import remainder, stored, table
from .spans import joined, of_kind


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(10) == 0
    scored = lm_score.score(table(spark, sf_dir, "documents", "doc_id", "text"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    counts = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages", "page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "block_score")


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    model = crf_quality.train(docs, labels.where(remainder(4) != 2))
    scored = crf_quality.score(docs, model, drop=("text",))
    return scored.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark", "item_id", "text"), drop=("text",))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language_id.train(table(spark, sf_dir, "documents", "doc_id", "text", "lang").where(remainder(4) != 2))
    found = language_id.identify(table(spark, sf_dir, "documents", "doc_id", "text"), model, drop=("text",))
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.measures(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text")
    return quality_rules.judge_measured(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stored(pii.candidates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text"))
    spans = pii.classified(found, pii.fit(found)).withColumn("base", F.filter("spans", lambda s: s["base"]))
    counts = [of_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.BASE]
    return spans.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The operators' queries, by name."""
    return {f.__name__: f for f in (op1_lm_scoring, op2_secret_scan, op3_url_filter, op4_ngram_jaccard_join, op5_quality_classifier, op6_decontamination, op7_language_id, op8_source_mixing, op9_quality_rules, op10_pii)}


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components by reachability over all links of exact shingle sets.
OP4_SQL = rf"""with recursive w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') as t from documents),
 s as (select doc_id, case when len(t) >= 5 then list_distinct([array_to_string(t[i:i+4], ' ') for i in range(1, len(t) - 3)]) when len(t) > 0 then [array_to_string(t, ' ')] else [] end as sh from w),
 e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
 o as (select a.doc_id as a, b.doc_id as b, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
 l as (select a, b from o where 100 * k >= 80 * (na + nb - k)),
 r(a, b) as (select doc_id, doc_id from s union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, len(sh)::bigint as n_shingles, (select min(b) from r where r.a = s.doc_id) as component_id from s"""

#: All windows of all items against all windows of the same lengths in all documents.
OP6_SQL = rf"""with w as (select doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t from documents),
 i as (select item_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as t from benchmark),
 j as (select item_id, t, least(10, len(t)) as n, unnest(range(1, len(t) - least(10, len(t)) + 2)) as p from i where len(t) > 0),
 iw as (select distinct item_id, n, array_to_string(t[p:p+n-1], ' ') as x from j),
 l as (select distinct n from iw),
 d as (select doc_id, t, n, unnest(range(1, len(t) - n + 2)) as p from w cross join l where len(t) >= n),
 h as (select distinct doc_id, p, d.n, item_id from d join iw on iw.n = d.n and iw.x = array_to_string(t[p:p+d.n-1], ' ')),
 c as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from h) group by 1),
 g as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from h group by 1)
select doc_id, len(t)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated from w left join c using (doc_id) left join g using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express whole: joins and searches, not fitted models or hash orders."""
    return {"op4_ngram_jaccard_join": OP4_SQL, "op6_decontamination": OP6_SQL}
