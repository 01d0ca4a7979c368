"""Views that turn the driver's tables into the engine's inputs, in Spark and in DuckDB SQL.

Each view is one SQL text for both engines; {sha} is the only spelling that differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "fx_items": "select doc_id as seq, substr({sha}('documents:'||doc_id),1,16) as id, source, 'article' as kind, 'https://'||source||'.example.org/'||lang||'/'||doc_id as url, text as body, {sha}(text) as body_hash, lang from documents",
    "fx_pages": "select page_id as seq, substr({sha}('pages:'||page_id),1,16) as id, 'pages' as source, url, html from pages",
    "fx_detections": "select l_orderkey as unit_id, l_orderkey||':'||l_linenumber as item_id, o_orderpriority as source, p_brand as entry_id, case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end as rank, case l_linestatus when 'O' then 'open' else 'anchored' end as channel from lineitem join orders on o_orderkey = l_orderkey join part on p_partkey = l_partkey",
    "fx_unit_method": "select distinct l_orderkey as unit_id, p_type as method_id from lineitem join part on p_partkey = l_partkey",
    "fx_unit_mode": "select distinct l_orderkey as unit_id, 'FM'||lpad(cast(p_size % 13 + 1 as {str}),2,'0') as mode from lineitem join part on p_partkey = l_partkey where p_size % 4 = 0",
    "fx_unit": "select o_orderkey as unit_id, o_orderpriority as source, year(o_orderdate) as batch, c_mktsegment in ('AUTOMOBILE','BUILDING','FURNITURE') as rag, c_mktsegment in ('MACHINERY','FURNITURE') as agente, case o_orderstatus when 'F' then 'atomico' when 'O' then 'agregado' else 'nao-identificado' end as aggregation from orders join customer on c_custkey = o_custkey",
    "fx_query": "select o_orderpriority as source, o_orderstatus as family, year(o_orderdate) as yr, count(*) as items, count(*) filter (where o_totalprice < 50000) as discarded, cast(floor(sum(cast(o_totalprice as decimal(18,2)))/10000) as bigint) as available, count(*) % 3 <> 0 as cut_short from orders group by o_orderpriority, o_orderstatus, year(o_orderdate)",
    "fx_engagement": "select event_id as id, event_type as source, case when user_id % 2 = 0 then 'even' else 'odd' end as kind, cast(floor(value) as bigint) as value, ts as created_at, user_id % 7 as tool from events",
    "fx_coders": "select doc_id as item_id, 'ana' as coder, quality as value from labels union all select doc_id, 'bia', toxic from labels",
    "fx_run_items": "select 'lang-'||coalesce(lang, 'none') as run, cast(doc_id as {str}) as id, doc_id as seq, source, case source when 'src1' then 'code' else 'article' end as kind, 'https://'||source||'.example.org/'||doc_id as url, cast(null as {str}) as title, text as body from documents union all select 'source-'||source, cast(doc_id as {str}), doc_id, source, case source when 'src1' then 'code' else 'article' end, 'https://'||source||'.example.org/'||doc_id, cast(null as {str}), text from documents",
    "fx_run_detections": "select 'run-'||lower(l_returnflag) as run, cast(l_suppkey as {str}) as item_id, 'e'||l_linenumber as entry_id, l_linestatus as signal, cast(year(l_shipdate) as {str}) as location, 'N'||(l_partkey % 3 + 1) as level, l_orderkey * 10 + l_linenumber as seq from lineitem",
    "fx_unit_items": "select cast(o_orderkey as {str}) as item_id, o_orderkey as seq, case when o_orderpriority <> '5-LOW' then 'c/'||o_custkey end as repo, case o_orderpriority when '1-URGENT' then 'Import urgent' when '2-HIGH' then 'x repo:Acme/Brand' when '3-MEDIUM' then 'path:.github/workflows MEDIUM' when '4-NOT SPECIFIED' then 'path:x/Fran.yaml' end as query from orders",
    "fx_unit_detections": "select l_orderkey * 10 + l_linenumber as seq, case l_returnflag when 'R' then 'gone' else cast(l_orderkey as {str}) end as item_id, case when l_linestatus = 'F' then 'c/'||l_suppkey end as repo, lower(p_brand) as entry_id, case when p_size < 25 then 'tool' else 'method' end as entry_type, 'N'||(l_linenumber % 3 + 1) as level, case when l_linenumber = 1 then 'text' else 'ci' end as signal, p_type as evidence from lineitem join part on p_partkey = l_partkey",
    "fx_answers": "select event_id, case event_type when 'click' then 429 when 'view' then 403 else 500 end as status, cast(user_id % 7 as int) as attempt, cast(1000 as double) as now, case when event_id % 3 = 0 then cast(value as double) end as retry_after, cast(event_id % 2 as int) as remaining, case when event_id % 5 < 3 then cast(900 + user_id * 40 as double) end as reset_at from events",
    "fx_customer_urls": "select c_custkey as seq, 'https://n'||c_nationkey||'.example.org/c/'||c_custkey||'?utm_source=x' as url, 'shop/'||c_custkey as repo from customer",
    "fx_order_urls": "select o_orderkey as seq, case when o_orderstatus = 'F' then 'http://www.n'||c_nationkey||'.example.org/c/'||c_custkey||'/' end as url, case when o_orderpriority = '1-URGENT' then 'shop/'||c_custkey end as repo from orders join customer on c_custkey = o_custkey",
}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, or a fixture view over the tables of a folder."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name].replace("{sha}(text)", "sha2(text, 256)").replace("{str}", "string")
    text = text.replace("{sha}('documents:'||doc_id)", "sha2('documents:'||doc_id, 256)").replace("{sha}('pages:'||page_id)", "sha2('pages:'||page_id, 256)")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text or f" {t} " in text}
    for t in used:
        text = text.replace(f" from {t}", f" from {{{t}}}").replace(f" join {t} ", f" join {{{t}}} ")
    return spark.sql(text, **used)


def oracle(views: str, body: str) -> str:
    """DuckDB SQL: the named views as common table expressions, then the body (a select, or further `, x as (...)`)."""
    ctes = ", ".join(f"{v} as ({VIEWS[v].replace('{sha}', 'sha256').replace('{str}', 'varchar')})" for v in views.split())
    return f"with {ctes} {body.strip()}" if ctes else body.strip()
