"""Queries for the sampling design, rank statistics, agreement, validation and flow accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import design as W
from ..operators import review as R
from ..operators import stats as S
from .fixtures import frame, oracle


def rounded(frame_: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return frame_.withColumns({n: F.round(n, places) for n in names})


def strata(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(W.strata(frame(spark, sf_dir, "fx_query")), "fraction", "weight")


def fractions(spark, sf_dir):  # noqa: ANN001, ANN201
    made = W.strata(frame(spark, sf_dir, "fx_query")).withColumn("yr", F.when(F.col("yr") > 1999, None).otherwise(F.col("yr")))
    return rounded(W.fractions(made, ["source", "yr"]), "fraction")


def kish_effective(spark, sf_dir):  # noqa: ANN001, ANN201
    return W.strata(frame(spark, sf_dir, "fx_query")).groupBy("source").agg(F.round(W.kish(F.col("weight")), 6).alias("n_eff"))


def item_weights(spark, sf_dir):  # noqa: ANN001, ANN201
    orders = frame(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("source"), F.col("o_orderstatus").alias("family"), F.year("o_orderdate").alias("yr"))
    made = W.strata(frame(spark, sf_dir, "fx_query")).where("yr < 2000")
    return rounded(W.with_weights(orders, made, ["source", "family", "yr"]).select("o_orderkey", "weight", "known"), "weight")


def pair_weights(spark, sf_dir):  # noqa: ANN001, ANN201
    found = frame(spark, sf_dir, "fx_detections").withColumn("structural", F.col("channel") == "anchored")
    items = found.select("item_id", "unit_id", "structural").withColumns({"is_repo": F.col("structural"), "weight": (F.substring_index("item_id", ":", -1).cast("int") + 1).cast("double")}).drop("structural")
    return W.pair_weights(found, items)


def sample_allocation(spark, sf_dir):  # noqa: ANN001, ANN201
    sizes = frame(spark, sf_dir, "fx_detections").groupBy(F.concat_ws("/", "source", F.concat(F.lit("N"), F.col("rank").cast("string"))).alias("stratum")).agg(F.count("*").alias("size"))
    return W.allocation(sizes, 200)


def stratified_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "fx_detections").select(F.col("source").alias("stratum"), "item_id")
    return W.sampled(rows, W.allocation(rows.groupBy("stratum").agg(F.count("*").alias("size")), 60), "item_id", "7")


def double_coding_sample(spark, sf_dir):  # noqa: ANN001, ANN201
    return W.double_coding(frame(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("item_id")), 0.1, "s")


def language_quota(spark, sf_dir):  # noqa: ANN001, ANN201
    return W.language_quota(frame(spark, sf_dir, "documents").groupBy(F.col("lang").alias("language")).agg(F.count("*").alias("n")), 101)


def year_split(spark, sf_dir):  # noqa: ANN001, ANN201
    windows = frame(spark, sf_dir, "fx_query").groupBy("source").agg(F.make_date(F.min("yr"), F.lit(3), F.lit(15)).alias("since"), F.make_date(F.max("yr"), F.lit(6), F.lit(1)).alias("until"))
    return W.split_by_year(windows).select("source", "year", "from_day", "to_day")


def window_halves(spark, sf_dir):  # noqa: ANN001, ANN201
    windows = frame(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.to_date(F.min("o_orderdate")).alias("since"), F.to_date(F.max("o_orderdate")).alias("until"))
    return W.halves(windows).select("o_orderpriority", "half", "from_day", "to_day")


def request_plan(spark, sf_dir):  # noqa: ANN001, ANN201
    queries = frame(spark, sf_dir, "fx_query").select("source", F.when(F.col("cut_short"), F.col("available")).alias("total"))
    policies = queries.select("source").distinct().select("source", F.lit(100).alias("page_size"), F.lit(10).alias("max_pages"), F.lit(1000).alias("total_cap"), F.lit(1).alias("estimate_requests"), F.lit(150).alias("max_requests"))
    return W.request_plan(queries, policies)


def midrank_engagement(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "fx_engagement").withColumn("w", (F.col("tool") + 1).cast("double"))
    return rounded(S.with_midranks(rows, "value", ["source", "kind"], "w").select("id", "percentile", "weighted_percentile"), "percentile", "weighted_percentile")


def entity_engagement(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "fx_engagement").withColumn("weight", (F.col("tool") + 1).cast("double"))
    floors = rows.groupBy("source", "kind").agg(F.min("value").alias("floor_value"))
    ranked = S.with_midranks(rows, "value", ["source", "kind"], "weight").join(floors, ["source", "kind"]).withColumn("is_floor", F.col("value") == F.col("floor_value"))
    return rounded(S.entity_summary(ranked, "tool", 0.1, 5), "mean", "median", "share_floor", "share_top", "mean_weighted")


def kruskal_wallis(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(S.kruskal(frame(spark, sf_dir, "fx_engagement"), "tool", "value"), "h", "epsilon2")


def dunn_holm(spark, sf_dir):  # noqa: ANN001, ANN201
    made = S.dunn(frame(spark, sf_dir, "fx_engagement"), "tool", "value")
    return rounded(made, "z", "p", "p_holm", "delta")


def holm_adjusted(spark, sf_dir):  # noqa: ANN001, ANN201
    tests = frame(spark, sf_dir, "part").groupBy("p_type").agg((F.count("*") / 10_000.0).alias("p"))
    return rounded(S.holm(tests, "p", ["p_type"]), "p", "p_holm")


def cliffs_delta(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(S.cliffs_delta(frame(spark, sf_dir, "fx_engagement"), "tool", "value"), "delta")


def _levels(spark, sf_dir):  # noqa: ANN001, ANN202
    best = frame(spark, sf_dir, "fx_detections").groupBy("entry_id", "unit_id").agg(F.max("rank").alias("rank"))
    return best.groupBy("entry_id").agg(*(F.count(F.when(F.col("rank") == k, 1)).alias(f"n{k}") for k in (1, 2, 3)))


def kendall_tau(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(S.kendall(_levels(spark, sf_dir), "n1", "n3"), "tau")


def spearman_rho(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(S.spearman(_levels(spark, sf_dir), "n1", "n3"), "rho")


def quadrants(spark, sf_dir):  # noqa: ANN001, ANN201
    return S.quadrants(_levels(spark, sf_dir), "n1", "n3").select("entry_id", "quadrant")


def log_gap(spark, sf_dir):  # noqa: ANN001, ANN201
    return _levels(spark, sf_dir).select("entry_id", F.round(F.log10((F.col("n1") + 1) / (F.col("n3") + 1)), 6).alias("gap"))


def cohen_kappa(spark, sf_dir):  # noqa: ANN001, ANN201
    return rounded(S.kappa(frame(spark, sf_dir, "labels"), "quality", "toxic"), "agreement", "kappa")


def coder_agreement(spark, sf_dir):  # noqa: ANN001, ANN201
    pairs = R.coder_pairs(frame(spark, sf_dir, "fx_coders"), "item_id", "coder", "value")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(1 - F.count(F.when(~F.col("value_a").eqNullSafe(F.col("value_b")), 1)) / F.count("*"), 4).alias("percent"))


def agreement_multi(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "fx_detections").groupBy("unit_id", "channel").agg(F.collect_set("rank").alias("ranks"))
    return R.agreement_multi(rows, "unit_id", "channel", "ranks")


def precision_strata(spark, sf_dir):  # noqa: ANN001, ANN201
    found = frame(spark, sf_dir, "fx_detections").withColumn("stratum", F.concat(F.col("source"), F.lit("/N"), F.col("rank").cast("string")))
    judged = found.where("unit_id % 7 = 0 and rank < 3").withColumn("correct", F.col("channel") == "open")
    return rounded(R.precision(judged, found.groupBy("stratum").agg(F.count("*").alias("population"))), "precision", "low", "high")


def precision_weighted(spark, sf_dir):  # noqa: ANN001, ANN201
    found = frame(spark, sf_dir, "fx_detections").withColumn("stratum", F.concat(F.col("source"), F.lit("/N"), F.col("rank").cast("string")))
    judged = found.where("unit_id % 7 = 0 and rank < 3").withColumn("correct", F.col("channel") == "open")
    return rounded(R.precision_weighted(R.precision(judged, found.groupBy("stratum").agg(F.count("*").alias("population")))), "precision")


def prisma_identified(spark, sf_dir):  # noqa: ANN001, ANN201
    q = frame(spark, sf_dir, "fx_query").withColumn("reason", F.when(F.col("cut_short"), F.when(F.col("yr") % 2 == 0, "source_cap").otherwise("item_limit")))
    return R.prisma_identified(q)


def prisma_screened(spark, sf_dir):  # noqa: ANN001, ANN201
    pool = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"))
    decided = frame(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.when(F.col("quality") == 0, "exclude").when(F.col("toxic") == 1, "uncertain").otherwise("include").alias("decision"))
    return R.prisma_screened(pool, decided)


def report_by_year(spark, sf_dir):  # noqa: ANN001, ANN201
    orders = frame(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("created_at"))
    return R.report_by_year(orders, "1995-06-01", "1998-06-01")


def coding_status(spark, sf_dir):  # noqa: ANN001, ANN201
    return R.coding_status(frame(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("role").alias("coder")))


def export_csv_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    hits = frame(spark, sf_dir, "conversations").select(F.col("conv_id").alias("item_id"), F.col("role").alias("term"))
    docs = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "source", "lang")
    return R.export_rows(docs, hits)


def fair_share_caps(spark, sf_dir):  # noqa: ANN001, ANN201
    sources = frame(spark, sf_dir, "documents").select("source").distinct().withColumns({"is_open": F.col("source") < "src3", "census": F.col("source") == "src9"})
    return W.fair_shares(sources, 1000).select("source", "cap")


def enrich_priority(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = frame(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("string").alias("repo"), F.col("l_orderkey").alias("seq"), F.when(F.col("l_returnflag") == "A", "code").when(F.col("l_returnflag") == "N", "repo").otherwise("article").alias("kind"), (F.col("l_linenumber") == 7).alias("is_workflow"))
    return W.enrich_priority(rows)


def bootstrap_means(spark, sf_dir):  # noqa: ANN001, ANN201
    return W.poisson_bootstrap(frame(spark, sf_dir, "fx_engagement").select("id", "value"), "value", 20)


_ALL = (strata, fractions, kish_effective, item_weights, pair_weights, sample_allocation, stratified_sample, double_coding_sample, language_quota, year_split, window_halves, request_plan, midrank_engagement, entity_engagement, kruskal_wallis, dunn_holm, holm_adjusted, cliffs_delta, kendall_tau, spearman_rho, quadrants, log_gap, cohen_kappa, coder_agreement, agreement_multi, precision_strata, precision_weighted, prisma_identified, prisma_screened, report_by_year, coding_status, export_csv_rows, fair_share_caps, enrich_priority, bootstrap_means)
QUERIES = {f.__name__: f for f in _ALL}

STRATA = ", st as (select *, items + discarded as examined, case when not cut_short then 1.0::double when available > 0 and items + discarded > 0 then least(1.0::double, (items + discarded)::double / available) end as fraction, case when cut_short then greatest(available - items - discarded, 0) end as not_retrieved from fx_query)"
ALLOC = "tot as (select *, sum(size) over () as total, count(*) over () as k from sz), a as (select *, least(floor(({n} - k) * size / total::double), size - 1) as add_, ({n} - k) * size / total::double - floor(({n} - k) * size / total::double) as frac from tot), l as (select *, ({n} - k) - sum(add_) over () as left_, row_number() over (order by (size > 1 + add_) desc, frac desc, stratum) as place from a), al as (select stratum, size, (1 + add_ + case when place <= left_ and size > 1 + add_ then 1 else 0 end)::bigint as allocated from l)"
RANKS = ", v as (select value, count(*) as t from fx_engagement group by 1), rk as (select value, t, coalesce(sum(t) over (order by value rows between unbounded preceding and 1 preceding), 0) + (t + 1) / 2.0 as r from v), g as (select tool, count(*) as n, sum(r) as rs from fx_engagement join rk using (value) group by 1), tt as (select sum(t)::double as n, sum(t::double * t * t - t) as ties from v)"
MID = ", c as (select source, kind, value, count(*) as t, sum(tool + 1.0::double) as wt from fx_engagement group by all), b as (select *, coalesce(sum(t) over (partition by source, kind order by value rows between unbounded preceding and 1 preceding), 0) as below, sum(t) over (partition by source, kind) as n, coalesce(sum(wt) over (partition by source, kind order by value rows between unbounded preceding and 1 preceding), 0) as wbelow, sum(wt) over (partition by source, kind) as w, min(value) over (partition by source, kind) as lo from c), p as (select e.id, e.tool, e.value = b.lo as is_floor, e.tool + 1.0::double as weight, case when n < 2 then 0.5 else (below + (t - 1) / 2.0) / (n - 1) end as percentile, case when w - (e.tool + 1) <= 0 then 0.5 else (wbelow + 0.5 * (wt - (e.tool + 1))) / (w - (e.tool + 1)) end as weighted_percentile from fx_engagement e join b using (source, kind, value))"
LEVELS = ", best as (select entry_id, unit_id, max(rank) as rank from fx_detections group by 1, 2), lv as (select entry_id, count(*) filter (where rank = 1) as n1, count(*) filter (where rank = 2) as n2, count(*) filter (where rank = 3) as n3 from best group by 1)"
PREC = ", s as (select *, source || '/N' || rank as stratum from fx_detections), pop as (select stratum, count(*) as population from s group by 1), j as (select stratum, count(*) as judged, count(*) filter (where channel = 'open') as correct from s where unit_id % 7 = 0 and rank < 3 group by 1), pr as (select stratum, population, coalesce(judged, 0) as judged, coalesce(correct, 0) as correct, correct::double / judged as p, judged::double as n from pop left join j using (stratum))"

ORACLES = {
    "strata": oracle("fx_query", STRATA + " select source, family, yr, items, discarded, available, cut_short, examined, round(fraction, 6) as fraction, round(coalesce(1 / fraction, 1.0), 6) as weight, not_retrieved from st"),
    "fractions": oracle("fx_query", STRATA + ", y as (select * replace (case when yr > 1999 then null else yr end as yr) from st), f as (select source, yr, count(*) as queries, count(*) filter (where cut_short) as cut_short, count(*) filter (where cut_short and available is null) as unknown, sum(examined)::bigint as examined, case when count(*) filter (where cut_short and available is null) = 0 then sum(case when cut_short then available else examined end)::bigint end as available, sum(coalesce(not_retrieved, 0))::bigint as not_retrieved from y group by 1, 2) select *, case when available > 0 then round(least(1.0::double, examined::double / available), 6) end as fraction from f"),
    "kish_effective": oracle("fx_query", STRATA + " select source, round(sum(coalesce(1 / fraction, 1)) * sum(coalesce(1 / fraction, 1)) / sum(coalesce(1 / fraction, 1) * coalesce(1 / fraction, 1)), 6) as n_eff from st group by 1"),
    "item_weights": oracle("fx_query", STRATA + " select o_orderkey, round(coalesce(1 / st.fraction, 1.0::double), 6) as weight, st.source is not null as known from orders left join st on st.source = o_orderpriority and st.family = o_orderstatus and st.yr = year(o_orderdate) and st.yr < 2000"),
    "pair_weights": oracle("fx_detections", ", d as (select *, channel = 'anchored' as structural, split_part(item_id, ':', 2)::int + 1.0::double as w from fx_detections), b as (select unit_id, entry_id, max(rank) as rank from d group by 1, 2), rp as (select unit_id, min(w) as rw from d where structural group by 1), t as (select b.unit_id, b.entry_id, b.rank, bool_or(structural) as st, min(w) filter (where not structural) as tw from b join d using (unit_id, entry_id, rank) group by 1, 2, 3) select unit_id, entry_id, rank, case when st then coalesce(rw, 1.0) else tw end as weight from t left join rp using (unit_id)"),
    "sample_allocation": oracle("fx_detections", ", sz as (select source || '/N' || rank as stratum, count(*) as size from fx_detections group by 1), " + ALLOC.replace("{n}", "200") + " select * from al"),
    "stratified_sample": oracle("fx_detections", ", sz as (select source as stratum, count(*) as size from fx_detections group by 1), " + ALLOC.replace("{n}", "60") + ", r as (select source as stratum, item_id, row_number() over (partition by source order by sha256(item_id || '7'), item_id) as n from fx_detections) select stratum, item_id from r join al using (stratum) where n <= allocated"),
    "double_coding_sample": "with d as (select distinct source, doc_id as item_id from documents), n as (select source, greatest(1, ceil(0.1 * count(*))) as k from d group by 1), r as (select *, row_number() over (partition by source order by sha256(item_id || 's'), item_id) as i from d) select source, item_id from r join n using (source) where i <= k",
    "language_quota": "with c as (select lang as language, count(*) as n from documents group by 1), s as (select *, 101 * n / sum(n) over ()::double as share from c), f as (select *, floor(share) as fl, share - floor(share) as fr, 101 - sum(floor(share)) over () as left_ from s) select language, n, greatest(1, fl + case when row_number() over (order by fr desc, language) <= left_ then 1 else 0 end)::bigint as quota from f",
    "year_split": oracle("fx_query", ", w as (select source, make_date(min(yr), 3, 15) as since, make_date(max(yr), 6, 1) as until from fx_query group by 1), y as (select *, unnest(range(year(since), year(until) + 1)) as year from w) select source, year, greatest(since, make_date(year, 1, 1)) as from_day, least(until, make_date(year, 12, 31)) as to_day from y"),
    "window_halves": "with w as (select o_orderpriority, min(o_orderdate)::date as since, max(o_orderdate)::date as until from orders group by 1), m as (select *, since + ((until - since) // 2)::int as mid from w) select o_orderpriority, 1 as half, since as from_day, mid as to_day from m union all select o_orderpriority, 2, mid + 1, until from m where mid + 1 <= until",
    "request_plan": oracle("fx_query", " select source, least(sum(case when not cut_short then 10 else least(10, ceil(least(available, 1000) / 100.0)) end) + 1, 150)::bigint as requests from fx_query group by 1"),
    "midrank_engagement": oracle("fx_engagement", MID + " select id, round(percentile, 6) as percentile, round(weighted_percentile, 6) as weighted_percentile from p"),
    "entity_engagement": oracle("fx_engagement", MID + " select tool, count(*) as n, round(avg(percentile), 6) as mean, round(quantile_cont(percentile, 0.5), 6) as median, round(avg(is_floor::int), 6) as share_floor, round(avg((percentile >= 1 - 0.1)::int), 6) as share_top, round(sum(weight * weighted_percentile) / sum(weight), 6) as mean_weighted from p group by 1"),
    "kruskal_wallis": oracle("fx_engagement", RANKS + ", h as (select (count(*) - 1) as df, (12 / (any_value(tt.n) * (any_value(tt.n) + 1)) * sum(rs * rs / g.n) - 3 * (any_value(tt.n) + 1)) / (1 - any_value(ties) / (any_value(tt.n) * any_value(tt.n) * any_value(tt.n) - any_value(tt.n))) as h, any_value(tt.n) as n from g cross join tt) select df, round(h, 6) as h, round(h / (n - 1), 6) as epsilon2 from h"),
    "dunn_holm": oracle("fx_engagement", RANKS + """, zs as (select x.tool as a, y.tool as b, (x.rs / x.n - y.rs / y.n) / sqrt((tt.n * (tt.n + 1) / 12 - ties / (12 * (tt.n - 1))) * (1.0 / x.n + 1.0 / y.n)) as z from g x join g y on x.tool < y.tool cross join tt),
 ts as (select *, abs(z) / sqrt(2) as q, 1 / (1 + 0.5 * abs(z) / sqrt(2)) as t from zs),
 ps as (select a, b, z, t * exp(-q * q - 1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))) as p from ts),
 hs as (select *, least(1.0, (count(*) over () - row_number() over (order by p, a, b) + 1) * p) as s from ps),
 c as (select tool, value, count(*) as n from fx_engagement group by 1, 2), t as (select tool, sum(n) as n from c group by 1), u as (select x.tool as a, y.tool as b, sum(x.n * y.n * sign(x.value - y.value)) as d from c x join c y on x.tool < y.tool group by 1, 2)
 select a, b, round(z, 6) as z, round(p, 6) as p, round(max(s) over (order by p, a, b rows unbounded preceding), 6) as p_holm, round(d::double / (ta.n * tb.n), 6) as delta from hs join u using (a, b) join t ta on ta.tool = a join t tb on tb.tool = b"""),
    "holm_adjusted": "with t as (select p_type, count(*) / 10000.0::double as p from part group by 1), s as (select *, least(1.0::double, (count(*) over () - row_number() over (order by p, p_type) + 1) * p) as s, row_number() over (order by p, p_type) as k from t) select p_type, round(p, 6) as p, round(max(s) over (order by k), 6) as p_holm from s",
    "cliffs_delta": oracle("fx_engagement", ", c as (select tool, value, count(*) as n from fx_engagement group by 1, 2), t as (select tool, sum(n) as n from c group by 1), u as (select x.tool as a, y.tool as b, sum(x.n * y.n * sign(x.value - y.value)) as d from c x join c y on x.tool < y.tool group by 1, 2) select a, b, round(d::double / (ta.n * tb.n), 6) as delta from u join t ta on ta.tool = a join t tb on tb.tool = b"),
    "kendall_tau": oracle("fx_detections", LEVELS + ", p as (select sign(x.n1 - y.n1) as a, sign(x.n3 - y.n3) as b from lv x join lv y on x.entry_id < y.entry_id), s as (select count(*) filter (where a * b > 0) as concordant, count(*) filter (where a * b < 0) as discordant, count(*)::double as n0, count(*) filter (where a = 0) as t1, count(*) filter (where b = 0) as t2 from p) select concordant, discordant, round((concordant - discordant) / sqrt((n0 - t1) * (n0 - t2)), 6) as tau from s"),
    "spearman_rho": oracle("fx_detections", LEVELS + ", r as (select rank() over (order by n1) + (count(*) over (partition by n1) - 1) / 2.0 as a, rank() over (order by n3) + (count(*) over (partition by n3) - 1) / 2.0 as b from lv) select round(corr(a, b), 6) as rho from r"),
    "quadrants": oracle("fx_detections", LEVELS + " select entry_id, case when n1 > (select quantile_cont(n1, 0.5) from lv) then 'high' else 'low' end || '-' || case when n3 > (select quantile_cont(n3, 0.5) from lv) then 'high' else 'low' end as quadrant from lv"),
    "log_gap": oracle("fx_detections", LEVELS + " select entry_id, round(log10((n1 + 1) / (n3 + 1)::double), 6) as gap from lv"),
    "cohen_kappa": "with s as (select count(*)::double as n, count(*) filter (where quality = toxic) as same, count(*) filter (where quality = 1)::double as a, count(*) filter (where toxic = 1)::double as b from labels), k as (select n, same / n as po, (a * b + (n - a) * (n - b)) / (n * n) as pe from s), v as (select n, po, (po - pe) / (1 - pe) as k from k) select n::bigint as n, round(po, 6) as agreement, round(k, 6) as kappa, case when k <= 0 then 'poor' when k <= .2 then 'slight' when k <= .4 then 'fair' when k <= .6 then 'moderate' when k <= .8 then 'substantial' else 'almost perfect' end as label from v",
    "coder_agreement": "select 'ana' as a, 'bia' as b, count(*) as n, round(1 - count(*) filter (where quality <> toxic)::double / count(*), 4) as percent from labels",
    "agreement_multi": oracle("fx_detections", ", r as (select unit_id, channel, list_sort(list(distinct rank)) as v from fx_detections group by 1, 2), p as (select x.channel as a, y.channel as b, x.v = y.v as same from r x join r y on x.unit_id = y.unit_id and x.channel < y.channel) select a, b, count(*) as n, count(*) filter (where not same) as disagreements, round(1 - count(*) filter (where not same)::double / count(*), 4) as percent from p group by 1, 2"),
    "precision_strata": oracle("fx_detections", PREC + " select stratum, population, judged, correct, round(p, 6) as precision, case when judged = 0 then 0.0::double else round(greatest(0.0::double, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) - 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) end as low, case when judged = 0 then 0.0::double else round(least(1.0::double, (p + 1.96*1.96/(2*n)) / (1 + 1.96*1.96/n) + 1.96 * sqrt(p*(1-p)/n + 1.96*1.96/(4*n*n)) / (1 + 1.96*1.96/n)), 6) end as high from pr"),
    "precision_weighted": oracle("fx_detections", PREC + ", x as (select 'N' || split_part(stratum, '/N', 2) as level, * from pr where judged > 0 union all select 'all', * from pr where judged > 0) select level, round(sum(population * p) / sum(population), 6) as precision, sum(judged)::bigint as judged, sum(correct)::bigint as correct from x group by 1"),
    "prisma_identified": oracle("fx_query", ", g as (select *, greatest(available - items - discarded, 0) as gap from fx_query) select source, sum(items + discarded)::bigint as identified, sum(discarded)::bigint as filtered, sum(case when cut_short and yr % 2 = 0 then gap else 0 end)::bigint as not_retrieved, sum(case when cut_short and yr % 2 = 1 then gap else 0 end)::bigint as sampled_out from g group by 1"),
    "prisma_screened": 'with d as (select doc_id, case when quality = 0 then \'exclude\' when toxic = 1 then \'uncertain\' else \'include\' end as decision from labels) select count(*) as pool, count(*) filter (where decision = \'include\') as "include", count(*) filter (where decision = \'exclude\') as "exclude", count(*) filter (where decision = \'uncertain\') as uncertain, count(*) filter (where decision is null) as pending from documents left join d using (doc_id)',
    "report_by_year": "select o_orderpriority as source, year(o_orderdate) as yr, count(*) as items, count(*) filter (where not (o_orderdate::date between date '1995-06-01' and date '1998-06-01')) as out_of_window from orders group by 1, 2",
    "coding_status": "with k as (select conv_id, count(distinct role) as k from conversations group by 1) select role as coder, count(distinct conv_id) as items, count(distinct case when k >= 2 then conv_id end) as double_coded from conversations join k using (conv_id) group by 1",
    "export_csv_rows": "with t as (select conv_id as item_id, string_agg(distinct role, ', ' order by role) as m from conversations group by 1) select doc_id as item_id, source, lang, coalesce(m, '') as matched_terms from documents left join t on item_id = doc_id",
    "fair_share_caps": "with s as (select distinct source, source < 'src3' as is_open, source = 'src9' as census from documents) select source, case when census then null when is_open then greatest(25, floor(2 * 1000 / (sum(is_open::int) over ())::double)) else greatest(50, floor(3 * 1000 / (count(*) over ())::double)) end::bigint as cap from s",
    "enrich_priority": "select l_suppkey::varchar as repo, max(case when l_linenumber = 7 then 3 when l_returnflag = 'A' then 2 when l_returnflag = 'N' then 1 else 0 end) as score, min(l_orderkey) as first_seq from lineitem group by 1",
}
