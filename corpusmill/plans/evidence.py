"""Queries for sources, evidence extraction, recall, topics and streams."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import evidence as E
from ..functions import html
from ..functions import text as X
from ..operators import extract as G
from ..operators import review as R
from ..operators import topics as M
from ..sources import connectors as C
from ..storage import shared_dir
from ..streaming import accumulate as T
from .fixtures import frame, oracle

TOOLS = [
    {"id": "tion", "token": "tion", "names": ["tion"], "cli": ["tion"], "imports": ["tion_lib"], "packages": ["tion-lib"], "repos": ["src1/tion"], "configs": ["tion.yaml"], "ambiguous": True, "anchor": True, "context": ["the"]},
    {"id": "ther", "token": "ther", "names": ["ther"], "cli": ["ther run"], "imports": ["ther"], "packages": ["ther"], "repos": ["src2/ther"], "configs": [], "ambiguous": False, "anchor": True},
]
METHODS = [{"id": "thing-check", "names": ["thing"]}]
FILES = (
    ("requirements.txt", "# tools\nther>=1.0\nother==2\n"),
    ("pyproject.toml", '[project]\nname = "mine"\ndependencies = ["tion-lib[all]>=0.2"]\n'),
    (".github/workflows/ci.yml", "on: push\njobs:\n  t:\n    steps:\n      - name: ther\n        run: |\n          pip install -U ther\n          ther run all\n      - uses: actions/checkout@v4\n"),
)


def _items(spark, sf_dir):  # noqa: ANN001, ANN202
    docs = frame(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("item_id"), F.col("doc_id").alias("seq"), "source", F.when(F.col("doc_id") % 20 < 10, "repo").otherwise("code").alias("kind"), F.concat_ws("/", "source", F.lit("r")).alias("repo"), F.lit(None).cast("string").alias("title"), F.col("text").alias("body"), F.concat(F.lit("import "), F.when(F.col("doc_id") % 3 == 0, "ther").otherwise("none")).alias("query"), F.lit("src/tion.yaml").alias("path"))


def _files(spark, sf_dir):  # noqa: ANN001, ANN202
    files = spark.createDataFrame(list(FILES), "path string, content string")
    return frame(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.lit("r")).alias("repo")).distinct().join(F.broadcast(files))


def _signals(spark, sf_dir):  # noqa: ANN001, ANN202
    docs = frame(spark, sf_dir, "documents")
    return docs.groupBy(F.concat_ws("/", "source", F.lit("r")).alias("repo")).agg(F.when(F.first("source") == "src3", "gone").alias("error"), (F.count("*") % 3).cast("int").alias("contributors"), F.array(F.lit("2024-01"), F.lit("2024-02")).alias("commit_months"))


def extract_detections(spark, sf_dir):  # noqa: ANN001, ANN201
    return G.detections(_items(spark, sf_dir), _files(spark, sf_dir), _signals(spark, sf_dir), TOOLS, METHODS)


def manifest_dependencies(spark, sf_dir):  # noqa: ANN001, ANN201
    return E.declared(_files(spark, sf_dir).where("path not like '.github%'"))


def workflow_commands(spark, sf_dir):  # noqa: ANN001, ANN201
    return E.executed(_files(spark, sf_dir).where("path like '.github%'")).select("repo", "seq", "kind", "line", F.array_join("packages", ",").alias("packages"))


def html_titles(spark, sf_dir):  # noqa: ANN001, ANN201
    """Titles and visible text by the parser."""
    made = frame(spark, sf_dir, "pages").select("page_id", html.title_and_text(F.col("html")).alias("p"))
    return made.select("page_id", "p.title", F.col("p.text").alias("visible"))


def gold_recall(spark, sf_dir):  # noqa: ANN001, ANN201
    """All customers' pages against those that orders link to, by repository or canonical URL, by host."""
    gold, items = (frame(spark, sf_dir, v).withColumn("canonical_url", X.canonical_url(F.col("url"))) for v in ("fx_customer_urls", "fx_order_urls"))
    return R.recall(gold, items.where("canonical_url is not null or repo is not null"), F.regexp_extract("canonical_url", "://([^/]+)/", 1))


def source_policies(spark, sf_dir):  # noqa: ANN001, ANN201
    return C.policies(spark).select("source", "requests", "page_size", "total_cap", "redistribution")


def normalize_raw(spark, sf_dir):  # noqa: ANN001, ANN201
    """Conversations as recorded raw records of a forum, normalised to items."""
    turns = frame(spark, sf_dir, "conversations")
    raw = turns.select(F.lit("hackernews").alias("source"), F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("objectID"), F.col("role").alias("author"), F.col("text").alias("comment_text"), F.col("turn").alias("points"), (F.col("conv_id") + 1700000000).alias("created_at_i"))).alias("payload"), F.lit(None).cast("timestamp").alias("fetched_at"), F.col("conv_id").alias("seq"))
    return C.normalized(raw).select("id", "body_hash", "author", "votes", F.unix_timestamp("created_at").alias("created"))


def replay_source(spark, sf_dir):  # noqa: ANN001, ANN201
    """Recorded pages read by the Python data source."""
    spark.dataSource.register(C.ReplaySource)
    pages = [{"source": "devto", "seq": i, "hits": [{"id": 10 * i + j} for j in range(3)]} for i in range(4)]
    return spark.read.format("replay").option("pages", json.dumps(pages)).load().select("source", "native_id", "seq")


def insert_ignore(spark, sf_dir):  # noqa: ANN001, ANN201
    """All documents by the hash of their text, those of labelled ones being there before."""
    docs = frame(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("body_hash"), "doc_id", "source")
    return C.insert_ignore(docs.join(frame(spark, sf_dir, "labels").select("doc_id"), "doc_id"), docs, "body_hash", "doc_id")


def flat_csv_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    """Counts of sources by priority as `a=b; c=d`, lists joined, nulls empty."""
    orders = frame(spark, sf_dir, "orders").groupBy("o_orderpriority", "o_orderstatus").count()
    made = orders.groupBy("o_orderpriority").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "count"))).alias("by_status"), F.array_sort(F.collect_list("o_orderstatus")).alias("statuses"), F.lit(None).cast("string").alias("note"))
    return C.flat_csv(made)


def window_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return T.window_counts(frame(spark, sf_dir, "events"), "ts", "6 hours", "event_type").select("start", "event_type", "n", F.round("value", 4).alias("value"))


def user_sessions(spark, sf_dir):  # noqa: ANN001, ANN201
    return T.sessions(frame(spark, sf_dir, "events"), "ts", "12 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def late_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return T.late_counts(frame(spark, sf_dir, "events"), "ts", "2024-01-05", "2024-01-20", "event_type")


def _stream(spark, sf_dir, rows):  # noqa: ANN001, ANN202
    """Rows written in four files and read back as a stream of four batches."""
    folder = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    rows.repartition(4, F.col(rows.columns[0])).write.parquet(f"{folder}/in")
    return T.file_stream(spark, f"{folder}/in", rows.schema), folder


def stream_latest(spark, sf_dir):  # noqa: ANN001, ANN201
    """The upsert of an append log, drained, equals the batch query latest_decision."""
    log = frame(spark, sf_dir, "conversations").select("conv_id", "role", "turn")
    stream, folder = _stream(spark, sf_dir, log)
    query = T.upsert_latest(stream, ["conv_id", "role"], "turn", f"{folder}/out", f"{folder}/checkpoint")
    T.drained(query)
    last = max((p["batchId"] for p in query.recentProgress if p["numInputRows"]), default=0)
    return spark.read.parquet(f"{folder}/out/v={last}")


def stream_first_seen(spark, sf_dir):  # noqa: ANN001, ANN201
    """Users seen by the accumulating stream."""
    stream, folder = _stream(spark, sf_dir, frame(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")))
    T.drained(T.first_seen(stream, "user_id", "ts", "60 days", f"{folder}/out", f"{folder}/checkpoint"))
    return spark.read.schema("user_id bigint, ts timestamp").parquet(f"{folder}/out").select("user_id")


def topic_clusters(spark, sf_dir):  # noqa: ANN001, ANN201
    return M.clusters(frame(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", k=4)


_ALL = (extract_detections, manifest_dependencies, workflow_commands, html_titles, gold_recall, source_policies, normalize_raw, replay_source, insert_ignore, flat_csv_rows, window_counts, user_sessions, late_rows, stream_latest, stream_first_seen, topic_clusters)
QUERIES = {f.__name__: f for f in _ALL}

POLICY_ROWS = ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in (p[0], p[1], p[4], p[6], p[9])) + ")" for p in C.POLICIES)

ORACLES = {
    "manifest_dependencies": "select distinct source || '/r' as repo, v.* from documents cross join (values ('requirements.txt', 'ther', 'ther>=1.0', false), ('requirements.txt', 'other', 'other==2', false), ('pyproject.toml', 'tion-lib', 'tion-lib[all]>=0.2', false), ('pyproject.toml', 'mine', '', true)) v(path, name, line, own)",
    "workflow_commands": "select distinct source || '/r' as repo, v.* from documents cross join (values (0, 'run', 'pip install -U ther', 'ther'), (1, 'run', 'ther run all', ''), (2, 'uses', 'actions/checkout@v4', '')) v(seq, kind, line, packages)",
    "gold_recall": "with r as (select distinct o_custkey from orders where o_orderstatus = 'F' or o_orderpriority = '1-URGENT') select 'n' || c_nationkey || '.example.org' as host, count(o_custkey) as retrieved, count(*) as total from customer left join r on o_custkey = c_custkey group by 1",
    "source_policies": f"select * from (values {POLICY_ROWS}) p(source, requests, page_size, total_cap, redistribution)",
    "normalize_raw": "select substr(sha256('hackernews:' || conv_id || '-' || turn), 1, 16) as id, sha256(text) as body_hash, role as author, turn as votes, conv_id + 1700000000 as created from conversations",
    "replay_source": "select 'devto' as source, (10 * i + j)::varchar as native_id, i * 100000 + j as seq from range(4) a(i) cross join range(3) b(j)",
    "insert_ignore": "with d as (select sha256(text) as body_hash, doc_id, source from documents), e as (select body_hash from d semi join labels using (doc_id)) select body_hash, min(doc_id) as doc_id, arg_min(source, doc_id) as source from d where not exists (select 1 from e where e.body_hash = d.body_hash) group by 1",
    "flat_csv_rows": "with c as (select o_orderpriority, o_orderstatus, count(*) as n from orders group by 1, 2) select o_orderpriority, string_agg(o_orderstatus || '=' || n, '; ' order by o_orderstatus) as by_status, string_agg(o_orderstatus, ', ' order by o_orderstatus) as statuses, '' as note from c group by 1",
    "window_counts": "select time_bucket(interval '6 hours', ts, timestamp '2000-01-01') as start, event_type, count(*) as n, round(sum(value), 4) as value from events group by 1, 2",
    "user_sessions": "with l as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '12 hours' then 0 else 1 end as s from events), c as (select user_id, sum(s) over (partition by user_id order by ts rows unbounded preceding) as k from l), n as (select user_id, k, count(*) as n from c group by 1, 2) select user_id, count(*) as sessions, max(n) as longest from n group by 1",
    "late_rows": "select event_type, count(*) as n, count(*) filter (where not ts between timestamp '2024-01-05' and timestamp '2024-01-20') as outside from events group by 1",
    "stream_latest": "select conv_id, role, max(turn) as turn from conversations group by 1, 2",
    "stream_first_seen": "select distinct user_id from events",
}
