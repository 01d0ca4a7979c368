"""Queries for the tables of the analysis: levels, frequency, co-occurrence, coverage, ladders, comparison, saturation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analysis as A
from .fixtures import frame, oracle

#: part types in order, the first four on a rung.
RUNG_OF = "select p_type, row_number() over (order by p_type) as k from (select distinct p_type from part)"
RUNG_CASE = "case k when 1 then 'especificado' when 2 then 'derivado' when 3 then 'referencia' when 4 then 'humano' end"
MODES = [f"FM{i:02d}" for i in range(1, 14)] + ["FM99"]


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_detections")


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_unit_method")


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_unit")


def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, "fx_unit_mode")


def rung(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (unit_id, rung) by the unit's methods."""
    rungs = spark.sql(f"select p_type as method_id, {RUNG_CASE} as rung from ({RUNG_OF.replace('from part', 'from {part}')})", part=frame(spark, sf_dir, "part"))
    return met(spark, sf_dir).join(F.broadcast(rungs.where("rung is not null")), "method_id").select("unit_id", "rung").distinct()


def best_level(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.best_levels(det(spark, sf_dir)).select("entry_id", "unit_id", "rank", F.array_join("channels", ",").alias("channels"))


def level_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.level_summary(det(spark, sf_dir))


def units_from_detections(spark, sf_dir):  # noqa: ANN001, ANN201
    made = A.units_from_detections(det(spark, sf_dir), met(spark, sf_dir), unit(spark, sf_dir))
    tools = F.array_join(F.transform(F.map_entries("tools"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return made.select("unit_id", "source", F.array_join("systems", ",").alias("systems"), F.array_join("item_ids", ",").alias("item_ids"), tools.alias("tools"), F.array_join("methods", ",").alias("methods"))


def frequency(spark, sf_dir, channel="all"):  # noqa: ANN001, ANN201
    return A.frequency(det(spark, sf_dir), met(spark, sf_dir), unit(spark, sf_dir), channel)


def frequency_open(spark, sf_dir):  # noqa: ANN001, ANN201
    return frequency(spark, sf_dir, "open")


def frequency_anchored(spark, sf_dir):  # noqa: ANN001, ANN201
    return frequency(spark, sf_dir, "anchored")


def _tools(spark, sf_dir):  # noqa: ANN001, ANN202
    return det(spark, sf_dir).select("unit_id", F.col("entry_id").alias("entry"))


def _methods(spark, sf_dir):  # noqa: ANN001, ANN202
    return met(spark, sf_dir).select("unit_id", F.col("method_id").alias("entry"))


def cooccurrence_tool_method(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.pairs_within(_tools(spark, sf_dir), _methods(spark, sf_dir), unit(spark, sf_dir), False)


def cooccurrence_tool_tool(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.pairs_within(_tools(spark, sf_dir), _tools(spark, sf_dir), unit(spark, sf_dir), True)


def cooccurrence_method_method(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.pairs_within(_methods(spark, sf_dir), _methods(spark, sf_dir), unit(spark, sf_dir), True)


def coverage_cells(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.coverage_cells(mode(spark, sf_dir), det(spark, sf_dir), met(spark, sf_dir), unit(spark, sf_dir))


def coverage_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    catalog = spark.createDataFrame([(m,) for m in MODES], "mode string")
    return A.coverage_summary(catalog, mode(spark, sf_dir), det(spark, sf_dir), unit(spark, sf_dir))


def coverage_matrix(spark, sf_dir):  # noqa: ANN001, ANN201
    brands = ["Brand#11", "Brand#12", "Brand#13"]
    return A.coverage_matrix(coverage_cells(spark, sf_dir), brands).select("mode", *(F.col(b).cast("long").alias(b.replace("#", "_").lower()) for b in brands))


def oracle_ladder(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.oracle_ladder(spark.createDataFrame([(r,) for r in A.RUNGS], "rung string"), rung(spark, sf_dir), unit(spark, sf_dir))


def aggregation_test(spark, sf_dir):  # noqa: ANN001, ANN201
    row = A.aggregation_test(unit(spark, sf_dir))
    return row.select("atomic", "aggregated", "unidentified", *(F.round(c, 9).alias(c) for c in ("share", "low", "high")))


def compare_systems(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.compare(det(spark, sf_dir), met(spark, sf_dir), mode(spark, sf_dir), rung(spark, sf_dir), unit(spark, sf_dir))


def compare_summary(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.compare_summary(compare_systems(spark, sf_dir))


def saturation(spark, sf_dir):  # noqa: ANN001, ANN201
    units = unit(spark, sf_dir).select("unit_id", "batch")
    codes = det(spark, sf_dir).select("unit_id", F.concat_ws(":", "entry_id", "rank", "channel").alias("code")).distinct()
    return A.saturation(codes, units)


def pyramid(spark, sf_dir):  # noqa: ANN001, ANN201
    tools = frame(spark, sf_dir, "part").select(F.col("p_brand").alias("entry_id")).distinct().withColumn("family", F.when(F.col("entry_id").endswith("5"), "framework-sut").otherwise("eval"))
    own = det(spark, sf_dir).where("unit_id % 50 = 0").select("entry_id", "unit_id").distinct()
    return A.pyramid(tools, det(spark, sf_dir), unit(spark, sf_dir), own)


def systems_jaccard(spark, sf_dir):  # noqa: ANN001, ANN201
    """Jaccard of the tool-and-level sets of the two systems."""
    codes = det(spark, sf_dir).select("unit_id", F.concat_ws(":", "entry_id", "item_id").alias("code")).join(unit(spark, sf_dir), "unit_id").groupBy("code").agg(F.max("rag").alias("r"), F.max("agente").alias("a"))
    return codes.agg(A.n_if(F.col("r") & F.col("a")).alias("shared"), A.n_if(F.col("r") | F.col("a")).alias("either")).withColumn("jaccard", F.col("shared") / F.col("either"))


def consensus_values(spark, sf_dir):  # noqa: ANN001, ANN201
    return A.consensus(frame(spark, sf_dir, "fx_coders"), "item_id", "coder", "value", "resolved")


def consensus_lists(spark, sf_dir):  # noqa: ANN001, ANN201
    """Order priorities' brands: what both return flags list, in the first one's order."""
    rows = det(spark, sf_dir).where("channel = 'open'").groupBy("unit_id", "rank").agg(F.sort_array(F.collect_set("entry_id")).alias("entries"))
    return A.consensus_lists(rows, "unit_id", "rank", "entries").select("unit_id", F.array_join("entries", ",").alias("entries"))


def sustained_units(spark, sf_dir):  # noqa: ANN001, ANN201
    """Users with events of two types or more on two days or more."""
    events = frame(spark, sf_dir, "events")
    return events.groupBy("user_id").agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("event_type").alias("types")).withColumn("sustained", (F.col("days") >= 2) & (F.col("types") >= 2))


_ALL = (best_level, level_summary, units_from_detections, frequency, frequency_open, frequency_anchored, cooccurrence_tool_method, cooccurrence_tool_tool, cooccurrence_method_method, coverage_cells, coverage_summary, coverage_matrix, oracle_ladder, aggregation_test, compare_systems, compare_summary, saturation, pyramid, systems_jaccard, consensus_values, consensus_lists, sustained_units)
QUERIES = {f.__name__: f for f in _ALL}

BEST = ", best as (select entry_id, unit_id, max(rank) as rank, bool_or(channel = 'open') as is_open, bool_or(channel = 'anchored') as is_anchored from fx_detections group by 1, 2)"
ENTRIES = BEST + ", rows as (select unit_id, entry_id as entry, 'tool' as kind, rank, is_open, is_anchored from best union all select unit_id, method_id, 'method', null, true, false from fx_unit_method)"
RUNGS_CTE = f", unit_rung as (select distinct unit_id, {RUNG_CASE} as rung from fx_unit_method join ({RUNG_OF}) on p_type = method_id where k <= 4)"
SYSTEMS = ", sys as (select unit_id, 'rag' as system from fx_unit where rag union all select unit_id, 'agente' from fx_unit where agente union all select unit_id, 'unlabelled' from fx_unit where not rag and not agente)"


def _frequency(where: str) -> str:
    return oracle("fx_detections fx_unit_method fx_unit", ENTRIES + f" select entry, kind, count(*) as units, count(*) filter (where rank = 1) as n1, count(*) filter (where rank = 2) as n2, count(*) filter (where rank = 3) as n3, count(*) filter (where rag) as rag, count(*) filter (where agente) as agente, count(*) filter (where is_open) as open_units, count(*) filter (where is_anchored) as anchored_units, count(distinct source) as n_sources from rows join fx_unit using (unit_id) where {where} group by 1, 2")


def _pairs(left: str, right: str, same: bool) -> str:
    return oracle("fx_detections fx_unit_method fx_unit", f", l as (select distinct unit_id, {left[1]} as e from {left[0]}), r as (select distinct unit_id, {right[1]} as e from {right[0]}), p as (select l.e as a, r.e as b, count(*) as together from l join r using (unit_id) {'where l.e < r.e' if same else ''} group by 1, 2), ca as (select e, count(*) as n from l group by 1), cb as (select e, count(*) as n from r group by 1), t as (select count(*) as n from fx_unit) select a, b, together, ca.n as a_units, cb.n as b_units, round(together::double / (ca.n + cb.n - together), 4) as jaccard, round(together::double * t.n / (ca.n * cb.n), 4) as lift from p join ca on ca.e = a join cb on cb.e = b cross join t")


TOOL, METHOD = ("fx_detections", "entry_id"), ("fx_unit_method", "method_id")
CELLS = SYSTEMS + ", ent as (select distinct unit_id, entry_id as entry, 'tool' as kind from fx_detections union all select unit_id, method_id, 'method' from fx_unit_method), cells as (select mode, entry, kind, system, count(*) as units from fx_unit_mode join ent using (unit_id) join sys using (unit_id) group by all)"
COMPARED = RUNGS_CTE + ", rows as (select distinct unit_id, entry_id as entry, 'tool' as kind from fx_detections union all select unit_id, method_id, 'method' from fx_unit_method union all select unit_id, mode, 'failure_mode' from fx_unit_mode union all select unit_id, rung, 'oracle' from unit_rung), cmp as (select kind, entry, count(*) filter (where rag) as rag, count(*) filter (where agente) as agente, count(*) filter (where rag and agente) as hybrid, case when count(*) filter (where rag) > 0 and count(*) filter (where agente) > 0 then 'transfers' when count(*) filter (where rag) > 0 then 'rag-only' else 'agent-only' end as category from rows join fx_unit using (unit_id) group by 1, 2 having count(*) filter (where rag or agente) > 0)"

ORACLES = {
    "best_level": oracle("fx_detections", "select entry_id, unit_id, max(rank) as rank, string_agg(distinct channel, ',' order by channel) as channels from fx_detections group by 1, 2"),
    "level_summary": oracle("fx_detections", BEST + " select entry_id, count(*) filter (where rank = 1) as n1, count(*) filter (where rank = 2) as n2, count(*) filter (where rank = 3) as n3 from best group by 1"),
    "units_from_detections": oracle("fx_detections fx_unit_method fx_unit", BEST + ", t as (select unit_id, string_agg(entry_id || '=' || rank, ';' order by entry_id) as tools from best group by 1), i as (select unit_id, string_agg(distinct item_id, ',' order by item_id) as item_ids from fx_detections group by 1), m as (select unit_id, string_agg(method_id, ',' order by method_id) as methods from fx_unit_method group by 1) select unit_id, source, array_to_string(list_filter([case when agente then 'agente' end, case when rag then 'rag' end], lambda x: x is not null), ',') as systems, item_ids, tools, coalesce(methods, '') as methods from fx_unit left join t using (unit_id) left join i using (unit_id) left join m using (unit_id)"),
    "frequency": _frequency("true"),
    "frequency_open": _frequency("is_open"),
    "frequency_anchored": _frequency("is_anchored"),
    "cooccurrence_tool_method": _pairs(TOOL, METHOD, False),
    "cooccurrence_tool_tool": _pairs(TOOL, TOOL, True),
    "cooccurrence_method_method": _pairs(METHOD, METHOD, True),
    "coverage_cells": oracle("fx_detections fx_unit_method fx_unit_mode fx_unit", CELLS + " select * from cells"),
    "coverage_summary": oracle("fx_detections fx_unit_mode fx_unit", ", cat(mode) as (values " + ", ".join(f"('{m}')" for m in MODES) + "), s as (select mode, count(*) as units, count(*) filter (where unit_id in (select unit_id from fx_detections)) as covered, count(*) filter (where rag) as rag, count(*) filter (where agente) as agente from fx_unit_mode join fx_unit using (unit_id) group by 1), c as (select mode, entry_id, count(*) as n, row_number() over (partition by mode order by count(*) desc, entry_id) as k from fx_unit_mode join (select distinct unit_id, entry_id from fx_detections) using (unit_id) group by 1, 2), b as (select mode, string_agg(entry_id || ' (' || n || ')', ', ' order by k) as top_entries from c where k <= 5 group by 1) select coalesce(cat.mode, s.mode) as mode, cat.mode is not null as catalogued, coalesce(units, 0) as units, coalesce(covered, 0) as covered, coalesce(rag, 0) as rag, coalesce(agente, 0) as agente, coalesce(top_entries, '') as top_entries from cat full join s on s.mode = cat.mode left join b on b.mode = coalesce(cat.mode, s.mode)"),
    "coverage_matrix": oracle("fx_detections fx_unit_method fx_unit_mode fx_unit", CELLS + " select mode, " + ", ".join(f"coalesce(sum(units) filter (where entry = 'Brand#{k}'), 0)::bigint as brand_{k}" for k in (11, 12, 13)) + " from cells group by 1"),
    "oracle_ladder": oracle("fx_unit_method fx_unit", RUNGS_CTE + ", sysx as (select unit_id, 'all' as system from fx_unit union all select unit_id, 'rag' from fx_unit where rag union all select unit_id, 'agente' from fx_unit where agente), o as (select * from unit_rung join sysx using (unit_id)), tot as (select system, count(distinct unit_id) as t from o group by 1), cnt as (select system, rung, count(*) as n from o group by 1, 2), grid as (select * from (values " + ", ".join(f"('{r}')" for r in A.RUNGS) + ") r(rung) cross join (values ('all'), ('rag'), ('agente')) s(system)) select g.system, g.rung, coalesce(n, 0) as units, coalesce(round(coalesce(n, 0)::double / t, 4), 0.0) as share from grid g left join cnt using (system, rung) left join tot using (system)"),
    "aggregation_test": oracle("fx_unit", ", c as (select count(*) filter (where aggregation = 'atomico') as k, count(*) filter (where aggregation = 'agregado') as g, count(*) filter (where aggregation = 'nao-identificado') as u from fx_unit), d as (select *, (k + g)::double as n, k::double / (k + g) as p from c), e as (select *, (p + 1.96*1.96 / (2 * n)) / (1 + 1.96*1.96 / n) as centre, 1.96 * sqrt(p * (1 - p) / n + 1.96*1.96 / (4 * n * n)) / (1 + 1.96*1.96 / n) as half from d) select k as atomic, g as aggregated, u as unidentified, round(p, 9) as share, round(greatest(0.0::double, centre - half), 9) as low, round(least(1.0::double, centre + half), 9) as high from e"),
    "compare_systems": oracle("fx_detections fx_unit_method fx_unit_mode fx_unit", COMPARED + " select * from cmp"),
    "compare_summary": oracle("fx_detections fx_unit_method fx_unit_mode fx_unit", COMPARED + ", s as (select kind, count(*) filter (where category = 'transfers') as t, count(*) filter (where category = 'rag-only') as r, count(*) filter (where category = 'agent-only') as a, count(*) as n from cmp group by 1) select kind, r + t as n_rag, a + t as n_agente, t as shared, t::double / n as jaccard, case when a + t > 0 then t::double / (a + t) else 0.0 end as agent_transfer_rate from s"),
    "saturation": oracle("fx_detections fx_unit", ", b as (select unit_id, min(batch) as batch from fx_unit group by 1), f as (select code, min(batch) as batch from (select distinct unit_id, concat_ws(':', entry_id, rank, channel) as code from fx_detections) join b using (unit_id) group by 1), n as (select batch, count(*) as c from f group by 1), u as (select batch, count(*) as units from b group by 1) select batch, units, coalesce(c, 0) as new_codes, sum(coalesce(c, 0)) over (order by batch)::bigint as cumulative, coalesce(c, 0) <= 0 as saturated from u left join n using (batch)"),
    "pyramid": oracle("fx_detections fx_unit", ", best as (select entry_id, unit_id, max(rank) as rank, unit_id % 50 = 0 as self from fx_detections group by 1, 2), c as (select entry_id, count(*) filter (where not self and rank = 3) as n3, count(*) filter (where not self and rank = 2) as n2, count(*) filter (where not self and rank = 1) as n1, count(*) filter (where self) as self, count(*) filter (where not self and rag) as rag, count(*) filter (where not self and agente) as agente from best join fx_unit using (unit_id) group by 1), t as (select distinct p_brand as entry_id, 'eval' as family from part where not ends_with(p_brand, '5')), o as (select entry_id, family, coalesce(n3, 0) as n3, coalesce(n2, 0) as n2, coalesce(n1, 0) as n1, coalesce(self, 0) as self, coalesce(rag, 0) as rag, coalesce(agente, 0) as agente from t left join c using (entry_id)) select *, rank() over (order by n1 desc) as rank_n1, rank() over (order by n2 desc) as rank_n2, rank() over (order by n3 desc) as rank_n3 from o"),
    "systems_jaccard": oracle("fx_detections fx_unit", ", c as (select entry_id || ':' || item_id as code, bool_or(rag) as r, bool_or(agente) as a from fx_detections join fx_unit using (unit_id) group by 1) select count(*) filter (where r and a) as shared, count(*) filter (where r or a) as either, (count(*) filter (where r and a))::double / count(*) filter (where r or a) as jaccard from c"),
    "consensus_values": oracle("fx_coders", "select item_id, case when count(distinct value) = 1 then min(value) end as value from fx_coders group by 1"),
    "consensus_lists": oracle("fx_detections", ", r as (select unit_id, rank, list_sort(list(distinct entry_id)) as e from fx_detections where channel = 'open' group by 1, 2), n as (select unit_id, count(*) as k from r group by 1), x as (select unit_id, u.x as entry, count(*) as c from r, unnest(e) as u(x) group by 1, 2) select n.unit_id, coalesce(string_agg(entry, ',' order by entry) filter (where c = k), '') as entries from n join x using (unit_id) group by 1"),
    "sustained_units": "select user_id, count(distinct cast(ts as date)) as days, count(distinct event_type) as types, count(distinct cast(ts as date)) >= 2 and count(distinct event_type) >= 2 as sustained from events group by 1",
}
