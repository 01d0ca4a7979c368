"""Queries for coding, resolutions and the smaller tables of reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coding as K
from ..operators import review as R
from ..operators import stats as S
from ..operators import summaries as Y
from .fixtures import frame, oracle


def methods_table(spark, sf_dir):  # noqa: ANN001, ANN201
    catalog = frame(spark, sf_dir, "part").select(F.col("p_type").alias("method_id")).distinct().unionByName(spark.createDataFrame([("NEVER",)], "method_id string"))
    return Y.methods_table(catalog, frame(spark, sf_dir, "fx_unit_method"))


def pain(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "fx_engagement").select("tool", F.when(F.col("kind") == "even", F.col("value")).alias("comments"), (F.col("value") % 5).alias("reactions"))
    return Y.pain(rows).withColumn("share_commented", F.round("share_commented", 6))


def catalog_origin(spark, sf_dir):  # noqa: ANN001, ANN201
    brands = frame(spark, sf_dir, "part").select(F.col("p_brand").alias("entry_id")).distinct()
    return Y.catalog_origin(brands, brands.where("entry_id < 'Brand#3'"))


def merged_manifests(spark, sf_dir):  # noqa: ANN001, ANN201
    entries = frame(spark, sf_dir, "fx_query").groupBy("source", F.col("yr").alias("run")).agg(F.array_sort(F.collect_list("family")).alias("queries"))
    return Y.merged_manifests(entries).select("source", F.array_join("queries", ",").alias("queries"))


def distinct_discards(spark, sf_dir):  # noqa: ANN001, ANN201
    return Y.distinct_discards(frame(spark, sf_dir, "events").select(F.col("event_type").alias("reason"), "user_id"))


def missed_tools(spark, sf_dir):  # noqa: ANN001, ANN201
    found = frame(spark, sf_dir, "fx_detections").select(F.col("unit_id").alias("item_id"), "entry_id", "rank")
    return Y.missed_tools(found.where("rank = 1").select("item_id", "entry_id").distinct(), found.where("rank > 1"))


def truncation_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    q = frame(spark, sf_dir, "fx_query").withColumn("reasons", F.filter(F.array(F.when(F.col("cut_short"), "item_limit"), F.when(F.col("yr") % 2 == 0, "source_cap")), lambda x: x.isNotNull()))
    return Y.truncation_counts(q)


def local_filter(spark, sf_dir):  # noqa: ANN001, ANN201
    """Documents that pass a local term filter and those that go, with the reason."""
    kept, gone = Y.discarded(frame(spark, sf_dir, "documents"), F.lower("text").rlike("(?<![\\p{L}\\p{N}_])ther(?![\\p{L}\\p{N}_])"))
    return kept.select("doc_id", F.lit("").alias("reason")).unionByName(gone.select("doc_id", "reason"))


def age_months(spark, sf_dir):  # noqa: ANN001, ANN201
    return frame(spark, sf_dir, "orders").select("o_orderkey", F.round(Y.age_months(F.col("o_orderdate"), F.lit("2002-01-01").cast("date")), 6).alias("months"))


def fetch_targets(spark, sf_dir):  # noqa: ANN001, ANN201
    items = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), F.col("doc_id").alias("seq"), "source", F.array("lang").alias("matched_terms"))
    return Y.fetch_targets(items, frame(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")), ["src1", "src2"], F.lit("example.org"), 20).select("item_id")


def final_decisions(spark, sf_dir):  # noqa: ANN001, ANN201
    records = frame(spark, sf_dir, "fx_coders").select("item_id", "coder", F.when(F.col("value") == 1, "include").otherwise("exclude").alias("decision"))
    senior = records.where("item_id % 5 = 0 and coder = 'ana'").withColumns({"coder": F.lit("consensus-1"), "decision": F.lit("include")})
    return K.final_decisions(records.unionByName(senior))


def units_from_codings(spark, sf_dir):  # noqa: ANN001, ANN201
    d = frame(spark, sf_dir, "fx_detections")
    none = F.lit(None).cast("array<string>")
    coded = d.select("unit_id", "item_id", F.substring_index("item_id", ":", -1).cast("int").alias("seq"), F.array("channel").alias("systems"), F.create_map("entry_id", F.when(F.col("rank") > 1, F.col("rank"))).alias("tools"), none.alias("methods"), F.array("source").alias("modes"), F.when(F.col("rank") == 3, F.col("entry_id")).alias("oracle"), F.lit(None).cast("string").alias("aggregation"))
    made = K.units_from_codings(coded)
    tools = F.array_join(F.transform(F.map_entries("tools"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return made.select("unit_id", F.array_join("item_ids", ",").alias("item_ids"), F.array_join("systems", ",").alias("systems"), F.array_join("modes", ",").alias("modes"), tools.alias("tools"), "oracle", F.size("methods").alias("n_methods"))


def resolved_records(spark, sf_dir):  # noqa: ANN001, ANN201
    records = frame(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.lit("quality").alias("field"), F.col("quality").cast("string").alias("value"))
    answers = frame(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("item_id"), F.lit("quality").alias("field"), F.lit("resolved").alias("value"))
    return K.resolved(records, answers)


def exclusion_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 0, "exclude").otherwise("include").alias("decision"), F.when(F.col("toxic") == 1, F.array(F.lit("E2"), F.lit("I1"))).when(F.col("doc_id") % 2 == 0, F.array(F.lit("E1"))).alias("criteria"))
    return R.exclusion_reasons(rows)


def language_combinations(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.language_combinations(frame(spark, sf_dir, "documents").select(F.col("source").alias("item_id"), "lang"))


def terms_without_hits(spark, sf_dir):  # noqa: ANN001, ANN201
    terms = spark.createDataFrame([("user",), ("assistant",), ("nobody",)], "term string")
    return R.terms_without_hits(terms, frame(spark, sf_dir, "conversations").select(F.col("role").alias("term")))


def policy_gate(spark, sf_dir):  # noqa: ANN001, ANN201
    policies = frame(spark, sf_dir, "documents").select("source").distinct().withColumn("policy", F.when(F.col("source") < "src15", "full_text").otherwise("metadata_only"))
    return R.policy_gate(frame(spark, sf_dir, "documents"), policies)


def ols_fit(spark, sf_dir):  # noqa: ANN001, ANN201
    """Least squares of price on quantity and discount, by normal equations, with HC3 errors."""
    fitted = S.ols(frame(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return spark.createDataFrame([(k, round(b, 2), round(e, 2)) for k, (b, e) in fitted.items()], "name string, coefficient double, error double")


_ALL = (methods_table, pain, catalog_origin, merged_manifests, distinct_discards, missed_tools, truncation_counts, local_filter, age_months, fetch_targets, final_decisions, units_from_codings, resolved_records, exclusion_reasons, language_combinations, terms_without_hits, policy_gate, ols_fit)
QUERIES = {f.__name__: f for f in _ALL}

ORACLES = {
    "methods_table": oracle("fx_unit_method", ", c as (select distinct p_type as method_id from part union all select 'NEVER') select method_id, count(distinct unit_id) as units from c left join fx_unit_method using (method_id) group by 1"),
    "pain": oracle("fx_engagement", ", r as (select tool, coalesce(case when kind = 'even' then value end, 0)::double as c, (value % 5)::double as x from fx_engagement) select tool, count(*) as n, quantile_cont(c, 0.5) as median_comments, quantile_cont(x, 0.5) as median_reactions, round(avg((c > 0)::int), 6) as share_commented from r group by 1"),
    "catalog_origin": "select case when p_brand < 'Brand#3' then 'seed' else 'discovery' end as origin, count(distinct p_brand) as entries from part group by 1",
    "merged_manifests": oracle("fx_query", " select source, string_agg(family, ',' order by yr, family) as queries from fx_query group by 1"),
    "distinct_discards": "select event_type as reason, count(distinct user_id) as discards from events group by 1",
    "missed_tools": oracle("fx_detections", ", a as (select distinct unit_id, entry_id from fx_detections where rank = 1), b as (select distinct unit_id, entry_id from fx_detections where rank > 1) select unit_id as item_id, entry_id from a anti join b using (unit_id, entry_id)"),
    "truncation_counts": oracle("fx_query", " select 'item_limit' as reason, count(*) as queries from fx_query where cut_short union all select 'source_cap', count(*) from fx_query where yr % 2 = 0"),
    "local_filter": "select doc_id, case when regexp_matches(lower(text), '(^|[^\\p{L}\\p{N}_])ther($|[^\\p{L}\\p{N}_])') then '' else 'no_term_match' end as reason from documents",
    "age_months": "select o_orderkey, round((date '2002-01-01' - o_orderdate::date) / 30.4375, 6) as months from orders",
    "fetch_targets": "select doc_id as item_id from documents where source in ('src1', 'src2') and doc_id not in (select doc_id from labels) order by doc_id limit 20",
    "final_decisions": "select doc_id as item_id, case when doc_id % 5 = 0 then 'include' when quality = toxic then case when quality = 1 then 'include' else 'exclude' end else 'uncertain' end as decision from labels",
    "units_from_codings": oracle("fx_detections", ", d as (select *, split_part(item_id, ':', 2)::int as seq from fx_detections), t as (select unit_id, entry_id, max(rank) as l from d group by 1, 2), ts as (select unit_id, string_agg(entry_id || '=' || l, ';' order by entry_id) as tools from t group by 1) select d.unit_id, string_agg(distinct item_id, ',' order by item_id) as item_ids, string_agg(distinct channel, ',' order by channel) as systems, string_agg(distinct source, ',' order by source) as modes, any_value(tools) as tools, (min(struct_pack(s := seq, e := entry_id)) filter (where rank = 3)).e as oracle, 0 as n_methods from d join ts using (unit_id) group by 1"),
    "resolved_records": "select doc_id as item_id, 'quality' as field, case when toxic = 1 then 'resolved' else quality::varchar end as value from labels",
    "exclusion_reasons": "select case when toxic = 1 then 'E2' when doc_id % 2 = 0 then 'E1' else 'other (reason given)' end as reason, count(*) as items from labels where quality = 0 group by 1",
    "language_combinations": "with s as (select source, string_agg(distinct lang, '+' order by lang) as languages from documents group by 1) select languages, count(*) as items from s group by 1",
    "terms_without_hits": "select term from (values ('user'), ('assistant'), ('nobody')) t(term) where term not in (select role from conversations)",
    "policy_gate": "select distinct source from documents where source >= 'src15'",
    "ols_fit": """with r as (select l_extendedprice::double as y, l_quantity::double as a, l_discount::double as b from lineitem),
 m as (select count(*)::double as n, avg(y) as my, avg(a) as ma, avg(b) as mb, count(*) * var_pop(a) as saa, count(*) * var_pop(b) as sbb, count(*) * covar_pop(a, b) as sab from r),
 w as (select y - my as dy, a - ma as da, b - mb as db, ((a - ma) * sbb - (b - mb) * sab) / (saa * sbb - sab * sab) as w1, ((b - mb) * saa - (a - ma) * sab) / (saa * sbb - sab * sab) as w2, n, my, ma, mb from r cross join m),
 c as (select sum(w1 * dy) as b1, sum(w2 * dy) as b2, any_value(my) - sum(w1 * dy) * any_value(ma) - sum(w2 * dy) * any_value(mb) as b0 from w),
 u as (select pow((dy - b1 * da - b2 * db) / (1 - 1 / n - da * w1 - db * w2), 2) as r2, 1 / n - ma * w1 - mb * w2 as w0, w1, w2, b0, b1, b2 from w cross join c),
 e as (select any_value(b0) as b0, any_value(b1) as b1, any_value(b2) as b2, sqrt(sum(r2 * w0 * w0)) as e0, sqrt(sum(r2 * w1 * w1)) as e1, sqrt(sum(r2 * w2 * w2)) as e2 from u)
select unnest(['intercept', 'l_quantity', 'l_discount']) as name, unnest([round(b0, 2), round(b1, 2), round(b2, 2)]) as coefficient, unnest([round(e0, 2), round(e1, 2), round(e2, 2)]) as error from e""",
}
