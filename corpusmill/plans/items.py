"""Queries on items: identity, URLs, deduplication, terms, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import analysis as A
from ..operators import dedupe as D
from .fixtures import frame, oracle

LEXICON = {"rag": ("tion", "ther"), "agente": ("ing", "ble"), "teste": ("ed", "ly")}
EDGE = r"[\p{L}\p{N}_]"


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixture items with their canonical URL and content key."""
    out = frame(spark, sf_dir, "fx_items").withColumn("canonical_url", X.canonical_url(F.col("url")))
    return out.withColumn("content_key", X.content_hash(F.lit(None).cast("string"), F.col("body")))


def item_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "documents")
    return docs.select("doc_id", X.item_id(F.lit("documents"), F.col("doc_id").cast("string")).alias("id"), F.sha2("text", 256).alias("body_hash"))


def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


PAGES_CANON = """'https://' || regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '^www\\.', '')
 || case when rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') = '' then '/' else rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') end
 || case when regexp_extract(url, '[?&](page=[^&#]*)', 1) = '' then '' else '?' || regexp_extract(url, '[?&](page=[^&#]*)', 1) end"""


def dedupe_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = frame(spark, sf_dir, "fx_pages").withColumn("canonical_url", X.canonical_url(F.col("url")))
    return D.first_wins(pages, ["canonical_url"], ["seq"]).select("seq", "dup_of_first")


def dedupe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.exact_passes(items(spark, sf_dir)).select("seq", "reason")


DEDUPED = """, keyed as (select *, trim(regexp_replace(body, '\\s+', ' ', 'g')) as k from fx_items),
 marked as (select *, case when row_number() over (partition by k order by seq) > 1 and k <> '' then 'content' end as reason from keyed)"""


def dedupe_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.reason_counts(D.exact_passes(items(spark, sf_dir)))


def stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: items after exact deduplication, by source, with their share of all."""
    kept = D.exact_passes(items(spark, sf_dir)).where("reason is null")
    counts = kept.groupBy("source").agg(F.count("*").alias("items"))
    total = counts.agg(F.sum("items").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("source", "items", (F.col("items") / F.col("total")).alias("share"))


def near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies with the copies of one text met through its first document."""
    found = D.near_pairs(frame(spark, sf_dir, "documents"), key="doc_id", text="text", threshold=0.8)
    return found.select("a", "b", F.round("similarity", 9).alias("similarity"))


NEAR = f"""with w as (select doc_id, regexp_extract_all(lower(text), '{EDGE}+') as t from documents),
 s as (select doc_id, list_distinct([array_to_string(t[i:i+4], ' ') for i in range(1, len(t) - 3)]) as sh from w where len(t) >= 30),
 k as (select *, min(doc_id) over (partition by list_sort(sh)) as lead from s),
 r as (select doc_id, sh from k where doc_id = lead),
 e as (select doc_id, len(sh) as n, unnest(sh) as x from r),
 o as (select a.doc_id as a, b.doc_id as b, count(*) as common_n, any_value(a.n) as na, any_value(b.n) as nb from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2)
 select a, b, round(common_n::double / (na + nb - common_n), 9) as similarity from o where common_n::double / (na + nb - common_n) >= 0.8
 union all select lead, doc_id, 1.0 from k where doc_id <> lead"""


def near_dup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.near_keep(frame(spark, sf_dir, "documents"), key="doc_id", text="text", threshold=0.8)


def term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of each lexicon term in each document, exact mode."""
    docs = frame(spark, sf_dir, "documents")
    counts = [F.struct(F.lit(t).alias("term"), F.regexp_count("text", F.lit(X.term_pattern(t, "exact"))).alias("hits")) for terms in LEXICON.values() for t in terms]
    return docs.select("doc_id", F.explode(F.array(*counts)).alias("h")).select("doc_id", "h.term", F.col("h.hits").cast("long").alias("hits")).where("hits > 0")


TERMS = ", ".join(f"('{t}')" for terms in LEXICON.values() for t in terms)
TERM_HITS = f"""with terms(term) as (values {TERMS}), tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{EDGE}+')) as w from documents)
 select doc_id, term, count(*) as hits from tok join terms on w = term group by 1, 2"""


def concept_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted concepts whose lexicon hits the document."""
    docs = frame(spark, sf_dir, "documents")
    tags = F.array(*(F.when(F.lower("text").rlike("|".join(X.term_pattern(t, "exact") for t in terms)), c) for c, terms in LEXICON.items()))
    return docs.select("doc_id", F.array_join(F.array_sort(F.filter(tags, lambda x: x.isNotNull())), ",").alias("concepts"))


CONCEPTS = "select doc_id, " + " || ".join(f"case when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(t)})($|[^\\p{{L}}\\p{{N}}_])') then ',{c}' else '' end" for c, t in sorted(LEXICON.items())) + " as c from documents"


def flexible_term_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and matches of a flexible term: any word that begins with its stem."""
    docs = frame(spark, sf_dir, "documents")
    return docs.select("doc_id", F.regexp_count("text", F.lit(X.term_pattern("thing"))).cast("long").alias("hits")).where("hits > 0")


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hit of a term with three words on either side."""
    docs = frame(spark, sf_dir, "documents")
    at = F.regexp_instr("text", F.lit(X.term_pattern("tion", "exact")))
    return docs.withColumn("at", at).where("at > 0").select("doc_id", X.context(F.col("text"), F.col("at"), F.lit(4), 3).alias("context"))


def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types, folded and stemmed."""
    words = frame(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    return words.select("word", X.stem(X.fold(F.col("word"))).alias("stem"))


STEMS = "with w as (select distinct unnest(string_split(lower(p_name), ' ')) as word from part) select word, case " + " ".join(f"when word like '%{s}' and length(word) - {len(s)} >= 4 then left(word, length(word) - {len(s)})" for s in X.SUFFIXES) + " else word end as stem from w"


def clipped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "documents").select("doc_id", X.clip(F.col("text")).alias("evidence"))


def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("visible"))


def cleaned_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "pages").select("page_id", F.length(X.clean_document(F.col("html"))).alias("n_chars"))


def thread_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one body, in the order of turns."""
    turns = frame(spark, sf_dir, "conversations")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n")
    return turns.groupBy("conv_id").agg(body.alias("body"), F.count("*").alias("turns"))


def latest_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.latest(frame(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn")


def redacted_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with bodies where the source's policy allows, and pseudonyms for sources."""
    policy = F.when(F.col("source").isin("src0", "src1", "src2", "src3", "src4"), "full_text_with_attribution").otherwise("metadata_only")
    return frame(spark, sf_dir, "fx_items").select("seq", F.length(X.redacted(F.col("body"), policy)).alias("n_body"), X.pseudonym(F.col("source"), "s").alias("author"))


def relevance_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relevance score, rank over all documents and review batch."""
    tagged = frame(spark, sf_dir, "documents").select("doc_id", *(F.lower("text").rlike("|".join(X.term_pattern(t, "exact") for t in terms)).cast("int").alias(c) for c, terms in LEXICON.items()))
    scored = tagged.select("doc_id", (F.least(F.col("rag") + F.col("agente") + F.col("teste"), F.lit(5)) + 2 * F.greatest("rag", "agente") + 2 * F.col("teste")).cast("double").alias("score"))
    return D.ranked(scored, [F.desc("score"), F.asc("doc_id")], 25).select("doc_id", "score", "rank", "batch")


def _flag(c: str) -> str:
    return f"case when regexp_matches(lower(text), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(LEXICON[c])})($|[^\\p{{L}}\\p{{N}}_])') then 1 else 0 end as {c}"


def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' pages that orders have linked to, and new ones, by canonical URL."""
    pages, earlier = (frame(spark, sf_dir, v).withColumn("key", X.canonical_url(F.col("url"))) for v in ("fx_customer_urls", "fx_order_urls"))
    fresh, seen = D.unseen(pages, earlier, "key")
    return fresh.agg(F.count_distinct("key").alias("urls")).withColumn("state", F.lit("new")).unionByName(seen.agg(F.count_distinct("key").alias("urls")).withColumn("state", F.lit("seen")))


def automated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts' first lines that a machine made."""
    return frame(spark, sf_dir, "orders").select("o_orderkey", X.is_automated_title(F.concat(F.lit("Report of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" "), F.col("o_orderpriority"))).alias("automated"))


def window_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "orders").where(X.in_window(F.col("o_orderdate"), "1996-01-01", "1997-06-30")).select("o_orderkey")


QUERIES = {f.__name__: f for f in (item_identity, canonical_urls, dedupe_pages, dedupe_exact, dedupe_report, stats_by_source, near_dup_pairs, near_dup_keep, term_hits, concept_tags, flexible_term_hits, context_window, stems, clipped_bodies, html_to_text, cleaned_documents, thread_bodies, latest_decision, redacted_export, relevance_rank, new_urls, automated_titles, window_filter)}

ORACLES = {
    "item_identity": "select doc_id, substr(sha256('documents:'||doc_id),1,16) as id, sha256(text) as body_hash from documents",
    "canonical_urls": f"select page_id, {PAGES_CANON} as canonical from pages",
    "dedupe_pages": oracle("fx_pages", f"select seq, row_number() over (partition by {PAGES_CANON} order by seq) > 1 as dup_of_first from fx_pages"),
    "dedupe_exact": oracle("fx_items", DEDUPED + " select seq, reason from marked"),
    "dedupe_report": oracle("fx_items", DEDUPED + ", r(reason) as (values ('url'), ('content'), ('near')) select r.reason, count(m.reason) as n from r left join marked m on m.reason = r.reason group by 1"),
    "stats_by_source": oracle("fx_items", DEDUPED + " select source, count(*) as items, count(*)::double / sum(count(*)) over () as share from marked where reason is null group by 1"),
    "near_dup_pairs": NEAR,
    "term_hits": TERM_HITS,
    "concept_tags": f"select doc_id, ltrim(c, ',') as concepts from ({CONCEPTS})",
    "flexible_term_hits": f"with tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{EDGE}+')) as w from documents) select doc_id, count(*) as hits from tok where w like 'thing%' group by 1",
    "context_window": f"with p as (select doc_id, text, regexp_extract(text, '(?is)^(.*?(^|[^\\p{{L}}\\p{{N}}_]))tion($|[^\\p{{L}}\\p{{N}}_])', 1) as pre, regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_])tion($|[^\\p{{L}}\\p{{N}}_])') as ok from documents), q as (select doc_id, list_filter(regexp_split_to_array(pre, '\\s+'), lambda x: x <> '') as b, substr(text, length(pre) + 1, 4) as m, list_filter(regexp_split_to_array(substr(text, length(pre) + 5), '\\s+'), lambda x: x <> '') as a from p where ok) select doc_id, array_to_string(list_concat(b[-3:], [m], a[1:3]), ' ') as context from q",
    "stems": STEMS,
    "clipped_bodies": "with c as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as t from documents) select doc_id, case when length(t) > 300 then left(t, 299) || '…' else t end as evidence from c",
    "thread_bodies": "select conv_id, string_agg(text, E'\\n\\n' order by turn) as body, count(*) as turns from conversations group by 1",
    "latest_decision": "select conv_id, role, turn, text from (select *, row_number() over (partition by conv_id, role order by turn desc) as r from conversations) where r = 1",
    "redacted_export": oracle("fx_items", "select seq, case when source in ('src0','src1','src2','src3','src4') then length(body) end as n_body, 'anon-' || left(sha256('s:' || source), 12) as author from fx_items"),
    "relevance_rank": f"with t as (select doc_id, {_flag('rag')}, {_flag('agente')}, {_flag('teste')} from documents), s as (select doc_id, (least(rag + agente + teste, 5) + 2 * greatest(rag, agente) + 2 * teste)::double as score from t), r as (select *, row_number() over (order by score desc, doc_id) as rank from s) select doc_id, score, rank, (rank - 1) // 25 + 1 as batch from r",
    "new_urls": "with s as (select c_custkey in (select o_custkey from orders where o_orderstatus = 'F') as seen from customer) select count(*) filter (where not seen) as urls, 'new' as state from s union all select count(*) filter (where seen), 'seen' from s",
    "automated_titles": "select o_orderkey, true as automated from orders",
    "window_filter": "select o_orderkey from orders where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-07-01'",
    "html_to_text": r"""with a as (select page_id, html as h from pages),
 b as (select page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?is)<noscript\b.*?</noscript\s*>', '', 'g'), '(?is)<nav\b.*?</nav\s*>', '', 'g'), '(?is)<header\b.*?</header\s*>', '', 'g'), '(?is)<footer\b.*?</footer\s*>', '', 'g'), '(?is)<aside\b.*?</aside\s*>', '', 'g'), '(?is)<form\b.*?</form\s*>', '', 'g'), '(?is)<svg\b.*?</svg\s*>', '', 'g') as h from a),
 c as (select page_id, regexp_replace(regexp_replace(regexp_replace(h, '(?is)<title\b.*?</title\s*>|<!--.*?-->|<!doctype[^>]*>', '', 'g'), '(?i)</?(p|div|section|article|li|br|h1|h2|h3|h4|pre|tr)\b[^>]*>', E'\n', 'g'), '</?[A-Za-z][^>]*>', '', 'g') as h from b),
 d as (select page_id, replace(replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') as h from c)
 select page_id, array_to_string(list_filter(list_transform(string_split(h, E'\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), E'\n') as visible from d""",
}
