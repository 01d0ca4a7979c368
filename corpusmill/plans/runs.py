"""Queries for stores of several runs, units of analysis, review order and retries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import requests as Q
from ..operators import units as U
from ..sources import runs as S
from ..storage import shared_dir
from .fixtures import frame, oracle

ITEM = "id string, seq bigint, source string, kind string, url string, title string, body string"
DETECTION = "item_id string, entry_id string, signal string, location string, level string, seq bigint"
TOOLS = [
    {"id": "brand#11", "repos": ["acme/brand"]},
    {"id": "brand#12", "configs": ["fran.yaml"], "imports": ["urgent"]},
    {"id": "brand#13", "token": "medium"},
]


def _store(spark: SparkSession, rows: DataFrame, kind: str) -> str:
    """A store with rows of one kind by their column run."""
    root = f"{shared_dir(spark).rstrip('/')}/runs-{uuid.uuid4().hex}"
    rows.withColumn("file", F.lit(kind)).write.partitionBy("run", "file").json(root)
    return root


def _items(spark: SparkSession, sf_dir: str, kind: str = "items") -> str:
    """All documents in two runs each: one for their language, one for their source."""
    return _store(spark, frame(spark, sf_dir, "fx_run_items"), kind)


def stored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.runs(S.catalog(spark, _items(spark, sf_dir)))


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run's items, of which only a deduplicated file is there."""
    return S.read_items(spark, _items(spark, sf_dir, "items_deduped"), "source-src1", ITEM).select("id", "run", "kind")


def consolidated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_items(spark, _items(spark, sf_dir), S.CONSOLIDATED, ITEM).select("id", "run", "source")


def consolidated_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read_items(spark, _items(spark, sf_dir), S.CONSOLIDATED, ITEM, prefer_deduped=True).select("id", "run", "kind")


def consolidated_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _store(spark, frame(spark, sf_dir, "fx_run_detections"), "detections")
    return S.read_detections(spark, root, S.CONSOLIDATED, DETECTION).select("item_id", "entry_id", "signal", "location", "run")


def detection_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections by unit and channel; some find their unit by item, some by repository, some not at all."""
    made = U.detection_units(frame(spark, sf_dir, "fx_unit_items"), frame(spark, sf_dir, "fx_unit_detections"), TOOLS)
    return made.groupBy("unit_id", "entry_id", "channel").agg(F.count("*").alias("n"))


def item_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = U.suggestions(frame(spark, sf_dir, "fx_unit_items"), frame(spark, sf_dir, "fx_unit_detections"))
    return made.withColumns({c: F.array_join(c, ",") for c in ("tools", "methods")})


def labels_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frame(spark, sf_dir, "documents").select("doc_id", F.array(F.upper("lang"), "source").alias("labels"))
    return U.without_labels(docs, ["en", "SRC3"]).select("doc_id")


def blind_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return U.seeded_order(frame(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 7, 100)


def stripped_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records with their suppliers' files: paths stay, contents go."""
    files = F.map_from_arrays(F.array(F.concat("p_brand", F.lit(".yml")), F.col("p_type")), F.array("p_name", "p_name"))
    record = F.to_json(F.struct(F.col("p_partkey").alias("repo"), files.alias("workflows")))
    parts = frame(spark, sf_dir, "part").select("p_partkey", record.alias("r"))
    paths = lambda f: F.array_join(Q.paths_only(F.col("r"), f), ",").alias(f)
    return parts.select("p_partkey", paths("workflows"), paths("manifests"))


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waits after answers made of events: some limited, some with hints, some whose quota is spent."""
    answers = frame(spark, sf_dir, "fx_answers")
    hints = [F.col(c) for c in ("now", "retry_after", "remaining", "reset_at")]
    wait = Q.retry_wait(F.col("status"), F.col("attempt"), *hints)
    spent = Q.quota_spent(F.col("now"), F.col("remaining"), F.col("reset_at"))
    return answers.select("event_id", F.round(wait, 3).alias("wait"), spent.alias("spent"))


_ALL = (stored_runs, run_items, consolidated_items, consolidated_unique, consolidated_detections, detection_units, item_suggestions, labels_excluded, blind_order, stripped_contents, retry_waits)
QUERIES = {f.__name__: f for f in _ALL}

_AIMED = """case when coalesce(entry_id = 'brand#11' and contains(lower(query), 'repo:acme/brand')
 or entry_id = 'brand#12' and (contains(lower(query), 'fran.yaml') or contains(lower(query), 'import urgent'))
 or entry_id = 'brand#13' and contains(lower(query), 'path:.github/workflows') and regexp_matches(lower(query), '(^|[^a-z0-9_-])medium($|[^a-z0-9_-])'), false)
 then 'anchored' else 'open' end"""

ORACLES = {
    "stored_runs": oracle("fx_run_items", "select distinct run from fx_run_items"),
    "run_items": oracle("fx_run_items", "select id, run, kind from fx_run_items where run = 'source-src1'"),
    "consolidated_items": oracle("fx_run_items", "select id, min(run) as run, arg_min(source, run) as source from fx_run_items group by 1"),
    "consolidated_unique": oracle(
        "fx_run_items",
        """, u as (select *, row_number() over (partition by url order by run, seq) as u from fx_run_items),
 k as (select *, trim(regexp_replace(body, '\\s+', ' ', 'g')) as k, coalesce(trim(body), '') <> '' and kind <> 'code' as able from u where u = 1),
 c as (select *, row_number() over (partition by able, k order by run, seq) as c from k)
 select id, run, kind from c where not able or c = 1""",
    ),
    "consolidated_detections": oracle("fx_run_detections", "select item_id, entry_id, signal, location, min(run) as run from fx_run_detections group by 1, 2, 3, 4"),
    "detection_units": oracle(
        "fx_unit_items fx_unit_detections",
        f""", i as (select item_id, coalesce(repo, item_id) as unit, query from fx_unit_items),
 j as (select d.*, coalesce(i.unit, d.repo) as unit_id, i.query from fx_unit_detections d left join i on i.item_id = d.item_id)
 select unit_id, entry_id, case when entry_type = 'tool' then {_AIMED} end as channel, count(*) as n from j
 where unit_id in (select unit from i) group by 1, 2, 3""",
    ),
    "item_suggestions": oracle(
        "fx_unit_items fx_unit_detections",
        """, m as (select i.item_id, d.*exclude(item_id), 0 as far from fx_unit_items i join fx_unit_detections d on d.item_id = i.item_id
 union all select i.item_id, d.*exclude(item_id), 1 from fx_unit_items i join fx_unit_detections d on d.repo = i.repo where d.signal <> 'text' and d.item_id is distinct from i.item_id),
 s as (select item_id, coalesce(string_agg(distinct entry_id, ',' order by entry_id) filter (where entry_type = 'tool'), '') as tools,
 coalesce(string_agg(distinct entry_id, ',' order by entry_id) filter (where entry_type = 'method'), '') as methods from m group by 1),
 b as (select item_id, level, evidence, row_number() over (partition by item_id order by level desc, far, seq, evidence desc) as n from m)
 select item_id, coalesce(tools, '') as tools, coalesce(methods, '') as methods, level, evidence
 from fx_unit_items left join s using (item_id) left join (select * from b where n = 1) using (item_id)""",
    ),
    "labels_excluded": "select doc_id from documents where coalesce(lower(lang), '') <> 'en' and coalesce(source, '') <> 'src3'",
    "blind_order": "select o_orderkey, row_number() over (order by md5('7:' || o_orderkey), o_orderkey) as rank, (row_number() over (order by md5('7:' || o_orderkey), o_orderkey) - 1) // 100 + 1 as batch from orders",
    "stripped_contents": "select p_partkey, array_to_string(list_sort([p_brand || '.yml', p_type]), ',') as workflows, '' as manifests from part",
    "retry_waits": oracle(
        "fx_answers",
        """, h as (select *, coalesce(remaining = 0 and reset_at - now > 3600, false) as spent, greatest(coalesce(retry_after, 0), 0) + case when remaining = 0 then greatest(coalesce(reset_at - now, 0), 0) else 0 end as hinted from fx_answers)
 select event_id, spent, round(case when status not in (429, 403) or attempt >= 5 or spent then null when hinted > 0 then hinted + case when reset_at is null then 0 else 1.5 end else least(60, 5 * pow(2, attempt)) end, 3) as wait from h""",
    ),
}
