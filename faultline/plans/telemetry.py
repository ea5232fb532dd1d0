"""Queries of the telemetry operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text
from ..operators import joins, promql, ranking, series, stats, traces
from ..sources import views
from .registry import query

HOUR = 3600


def fails(d: str = "d"):
    return F.dayofmonth(d) % 2 == 1


def r6(c, name: str | None = None):
    return F.round(c, 6).alias(name or (c if isinstance(c, str) else "value"))


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).withColumn("fail", fails().cast("int"))


# --- flagship: two-sample distance per indicator, ranked by service -----------------

EPSILON = """, l as (select service, metric, value, case when extract(day from d) % 2 = 1 then 1 else 0 end fail from m),
n as (select service, metric, sum(fail) nf, sum(1-fail) np, stddev_pop(case when fail=1 then value end) sf, stddev_pop(case when fail=0 then value end) sp from l group by service, metric),
g as (select service, metric, value, sum(fail) cf, sum(1-fail) cp from l group by service, metric, value),
c as (select service, metric, value, sum(cf) over w f, sum(cp) over w p, lead(value) over (partition by service, metric order by value) nxt from g window w as (partition by service, metric order by value rows between unbounded preceding and current row)),
x as (select c.service, c.metric, sqrt(2*sum(power(cast(f as double)/nf - cast(p as double)/np, 2)*(nxt-value))) epsilon, max(nf) nf, max(np) np from c join n on c.service=n.service and c.metric=n.metric where nxt is not null and nf>=5 and np>=5 and not (sf<1e-6 and sp<1e-6) group by c.service, c.metric)"""


def epsilon(spark: SparkSession, sf: str) -> DataFrame:
    return stats.energy_distance(labelled(spark, sf), ["service", "metric"], "value", "fail")


@query("epsilon_ranking", EPSILON + " select service, cast(count(*) as bigint) candidate_metric_count, round(sum(epsilon),6) epsilon_sum, round(max(epsilon),6) max_epsilon, cast(row_number() over (order by round(max(epsilon),9) desc, service) as bigint) as rank from x group by service", "m")
def epsilon_ranking(spark: SparkSession, sf: str) -> DataFrame:
    table = ranking.candidate_table(epsilon(spark, sf), [], "service", p_value=None)
    out = ranking.ranked(table.withColumn("_m", F.round("max_epsilon", 9)), [], F.desc("_m"), F.asc("service"))
    return out.select("service", "candidate_metric_count", r6("epsilon_sum"), r6("max_epsilon"), "rank")


@query("mlg_01_energy_distance", EPSILON + " select service, metric, round(epsilon,6) epsilon, cast(nf as bigint) n_fault, cast(np as bigint) n_normal from x", "m")
def mlg_01(spark: SparkSession, sf: str) -> DataFrame:
    return epsilon(spark, sf).select("service", "metric", r6("epsilon"), "n_fault", "n_normal")


@query("mlg_01_permutation_test")
def mlg_01_p(spark: SparkSession, sf: str) -> DataFrame:
    return stats.permutation_test(labelled(spark, sf), ["service", "metric"], "value", "fail")


# --- filters and windows -----------------------------------------------------------

@query("flt_01_closed_windows", ", j as (select r.run_id, r.label, m.* from m join r on m.ts between r.ws and r.we) select run_id, label, service, cast(count(*) as bigint) n, round(sum(value),4) total from j group by run_id, label, service", "mr")
def flt_01(spark: SparkSession, sf: str) -> DataFrame:
    rows = joins.in_windows(views.metrics(spark, sf).select("ts", "service", "value"), views.runs(spark).drop("d"))
    return rows.groupBy("run_id", "label", "service").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("flt_02_allow_deny", "select metric, cast(count(*) as bigint) n from m where service in ('svc1','svc2','svc5') and metric not in ('error') group by metric", "m")
def flt_02(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).where(F.col("service").isin("svc1", "svc2", "svc5") & ~F.col("metric").isin("error")).groupBy("metric").agg(F.count("*").alias("n"))


@query("flt_03_row_validity", "select cast(count(*) as bigint) n_rows, cast(count(try_cast(json_extract_string(props,'$.k') as double)) as bigint) n_valid from events")
def flt_03(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).agg(F.count("*").alias("n_rows"), F.count(text.number_or_null(F.get_json_object("props", "$.k"))).alias("n_valid"))


@query("flt_04_domain_completeness", ", w as (select unnest(['click','error','view','absent']) as metric), h as (select distinct metric from m) select 'missing' as kind, metric from w where metric not in (select metric from h) union all select 'extra', metric from h where metric not in (select metric from w)", "m")
def flt_04(spark: SparkSession, sf: str) -> DataFrame:
    wanted = F.array(*(F.lit(x) for x in ("click", "error", "view", "absent")))
    have = views.metrics(spark, sf).agg(F.collect_set("metric").alias("h"))
    side = lambda kind, a, b: have.select(F.lit(kind).alias("kind"), F.explode(F.array_except(a, b)).alias("metric"))
    return side("missing", wanted, F.col("h")).unionByName(side("extra", F.col("h"), wanted))


BASE = ", b as (select service, metric, avg(value) mean, stddev_samp(value) sigma from m where extract(day from d) % 2 = 0 group by service, metric)"


@query("flt_05_beyond_sigma", BASE + " select m.event_id, m.service, m.metric, round(abs(m.value-b.mean)/b.sigma,6) z from m join b on m.service=b.service and m.metric=b.metric where b.sigma>1e-8 and extract(day from m.d)%2=1 and abs(m.value-b.mean)/b.sigma > 2.5", "m")
def flt_05(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    base = rows.where(~fails()).groupBy("service", "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"))
    return series.beyond(rows.where(fails()), base, ["service", "metric"], limit=2.5).select("event_id", "service", "metric", r6("z"))


@query("flt_06_known_services", "select service, cast(min(rk) as bigint) as rank from (select concat('svc', cast(user_id % 20 as varchar)) service, row_number() over (order by event_id) rk from events) x where service in (select service from m) group by service", "m")
def flt_06(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "events").groupBy(F.concat(F.lit("svc"), (F.col("user_id") % 20).cast("string")).alias("service")).agg(F.min("event_id").alias("e"))
    numbered = series.running_total(views.table(spark, sf, "events").groupBy("event_id").agg(F.count("*").alias("n")), "event_id", "n", "rank")
    ranked = rows.join(numbered, F.col("e") == F.col("event_id")).select("service", "rank")
    return ranking.known_in_order(ranked, views.metrics(spark, sf), [], "service")


# --- joins -------------------------------------------------------------------------

@query("joi_01_window_ratio", ", g as (select service, metric, avg(case when extract(day from d)%2=0 then value end) n, avg(case when extract(day from d)%2=1 then value end) f from m group by service, metric) select service, metric, round(n,6) normal_mean, round(f,6) fault_mean, round(case when n<>0 then f/n when f=0 then 1.0 else cast('inf' as double) end,6) ratio, round(f-n,6) delta from g where n is not null and f is not null", "m")
def joi_01(spark: SparkSession, sf: str) -> DataFrame:
    out = joins.window_ratio(views.metrics(spark, sf), ["service", "metric"], fails(), "value")
    return out.select("service", "metric", *(r6(c) for c in ("normal_mean", "fault_mean", "ratio", "delta")))


INDICATORS = ", a as (select pod, metric, extract(day from d)%2=1 as f, stddev_pop(value) s, count(distinct value) u from m group by all), j as (select x.pod, x.metric, x.s sn, y.s sf, (x.s<5 and y.s<5) or (x.u<=1 and y.u<=1) as removed from a x join a y on x.pod=y.pod and x.metric=y.metric and not x.f and y.f)"


def indicator_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    normal, fault = (series.indicator_stats(rows.where(c), ["pod", "metric"]) for c in (~fails(), fails()))
    both = normal.select("pod", "metric", F.col("std").alias("sn"), F.col("is_constant").alias("cn")).join(fault.select("pod", "metric", F.col("std").alias("sf"), F.col("is_constant").alias("cf")), ["pod", "metric"])
    return both.withColumn("removed", ((F.col("sn") < 5) & (F.col("sf") < 5)) | (F.col("cn") & F.col("cf")))


@query("joi_02_indicator_stats", INDICATORS + " select pod, metric, round(sn,6) sn, round(sf,6) sf, removed from j", "m")
def joi_02(spark: SparkSession, sf: str) -> DataFrame:
    return indicator_pairs(spark, sf).select("pod", "metric", r6("sn"), r6("sf"), "removed")


@query("joi_03_anti_join", INDICATORS + " select m.pod, m.metric, cast(count(*) as bigint) n from m where not exists (select 1 from j where j.pod=m.pod and j.metric=m.metric and j.removed) group by m.pod, m.metric", "m")
def joi_03(spark: SparkSession, sf: str) -> DataFrame:
    flagged = indicator_pairs(spark, sf).where("removed").select("pod", "metric")
    return views.metrics(spark, sf).join(joins.small(flagged), ["pod", "metric"], "left_anti").groupBy("pod", "metric").agg(F.count("*").alias("n"))


EDGES = ", p as (select c.trace_id, c.span_id, q.service as source, c.service as destination, c.start_us, c.duration_us/1000.0 as rt from s c join s q on c.trace_id=q.trace_id and c.parent_span_id=q.span_id where q.service<>c.service), u as (select trace_id, source, destination, start_us, arg_min(rt, span_id) rt from p group by all)"


@query("joi_04_span_edges", EDGES + " select source, destination, cast(count(*) as bigint) n, round(avg(rt),6) mean_rt from u group by source, destination", "s")
def joi_04(spark: SparkSession, sf: str) -> DataFrame:
    edges = traces.service_edges(views.spans(spark, sf))
    return edges.groupBy("source", "destination").agg(F.count("*").alias("n"), r6(F.avg("response_time"), "mean_rt"))


@query("joi_05_interval_join", ", q as (select *, start_us + 3600000000 as end_us from s) select b.service as inner_service, a.service as outer_service, cast(count(*) as bigint) n from q a join s b on a.trace_id=b.trace_id and b.start_us between a.start_us and a.end_us group by 1,2", "s")
def joi_05(spark: SparkSession, sf: str) -> DataFrame:
    spans = views.spans(spark, sf)
    outer = spans.select("trace_id", F.col("service").alias("outer_service"), F.col("start_us").alias("a"), (F.col("start_us") + 3_600_000_000).alias("b"))
    inner = spans.select("trace_id", F.col("service").alias("inner_service"), F.col("start_us").alias("t"))
    return joins.interval_join(inner, outer, ["trace_id"], "t", "a", "b", 7_200_000_000).groupBy("inner_service", "outer_service").agg(F.count("*").alias("n"))


@query("joi_07_asof", ", a as (select * from m where metric='error'), b as (select * from m where metric='click') select a.event_id, a.service, round(b.value,6) as click_value from a asof left join b on a.service=b.service and a.ts>=b.ts", "m")
def joi_07(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    left = rows.where("metric = 'error'").select("event_id", "service", "ts")
    right = rows.where("metric = 'click'").select("service", F.col("ts").alias("at"), F.col("value").alias("click_value"), "event_id")
    return joins.asof_join(left, right, ["service"], "ts", "at", ["click_value"], ["event_id"]).select("event_id", "service", r6("click_value"))


@query("joi_08_nearest_baseline", ", n as (select * from r where label='pass'), f as (select * from r where label='fail'), x as (select f.run_id, n.run_id as baseline, row_number() over (partition by f.run_id order by case when n.we<=f.ws then 0 else 1 end, case when n.we<=f.ws then -epoch_us(n.we) else abs((epoch_us(n.ws)+epoch_us(n.we))/2 - epoch_us(f.ws)) end, n.run_id) k from f, n) select run_id, baseline from x where k=1", "r")
def joi_08(spark: SparkSession, sf: str) -> DataFrame:
    runs = views.runs(spark)
    cases = runs.where("label = 'fail'").select("run_id", F.col("window_start").alias("at"))
    bases = runs.where("label = 'pass'").select(F.col("run_id").alias("baseline"), "window_start", "window_end")
    return joins.nearest_baseline(cases, bases, "run_id", "at", "window_start", "window_end", "baseline").select("run_id", "baseline")


TWO = ", b as (select case when grouping(service)=1 then '*' else service end as service, metric, avg(value) mean, stddev_samp(value) sigma from m group by grouping sets ((service, metric),(metric)))"


@query("agg_07_two_level_baseline", TWO + " select service, metric, round(mean,6) mean, round(sigma,6) sigma from b", "m")
def agg_07(spark: SparkSession, sf: str) -> DataFrame:
    return series.two_level_baseline(views.metrics(spark, sf), "service", "metric").select("service", "metric", r6("mean"), r6("sigma"))


@query("joi_09_wildcard_lookup", ", b as (select case when grouping(service)=1 then '*' else service end as service, metric, avg(value) mean from m where service <> 'svc3' group by grouping sets ((service, metric),(metric))) select m.event_id, round(coalesce(x.mean, y.mean),6) mean from m left join b x on m.service=x.service and m.metric=x.metric left join b y on y.service='*' and m.metric=y.metric", "m")
def joi_09(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    base = series.two_level_baseline(rows.where("service <> 'svc3'"), "service", "metric")
    return joins.wildcard_join(rows.select("event_id", "service", "metric"), base, "service", ["metric"], ["mean"]).select("event_id", r6("mean"))


@query("joi_10_lookup_default", ", w as (select metric, avg(value) a from m where metric in ('click','error') group by metric) select m.service, round(sum(coalesce(w.a,0.0)),4) total from m left join w on m.metric=w.metric group by m.service", "m")
def joi_10(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    lookup = rows.where(F.col("metric").isin("click", "error")).groupBy("metric").agg(F.avg("value").alias("a"))
    return rows.join(joins.small(lookup), "metric", "left").groupBy("service").agg(F.round(F.sum(F.coalesce("a", F.lit(0.0))), 4).alias("total"))


@query("joi_11_common_keys", "select user_id, metric from m where extract(day from d)%2=0 intersect select user_id, metric from m where extract(day from d)%2=1", "m")
def joi_11(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    return rows.where(~fails()).select("user_id", "metric").intersect(rows.where(fails()).select("user_id", "metric"))


@query("joi_12_bucket_correlation", ", h as (select service, metric, (epoch_us(ts)//1000000)//86400 b, avg(value) v from m group by all), x as (select a.service, a.v x, b.v y from h a join h b on a.service=b.service and a.b=b.b and a.metric='click' and b.metric='view') select service, round(coalesce(covar_pop(x,y)/nullif(stddev_pop(x)*stddev_pop(y),0),0),6) corr from x group by service", "m")
def joi_12(spark: SparkSession, sf: str) -> DataFrame:
    values = series.bucketed(views.metrics(spark, sf), ["service", "metric"], "ts", "value", 86400, "mean")
    side = lambda m, c: values.where(F.col("metric") == m).select("service", "bucket", F.col("value").alias(c))
    pairs = side("click", "x").join(side("view", "y"), ["service", "bucket"])
    return joins.correlation(pairs, ["service"], "x", "y").select("service", r6("corr"))


@query("joi_13_full_outer_scores", ", n as (select metric, user_id, sum(value) s from m where extract(day from d)%2=0 group by all), f as (select metric, user_id, sum(value) t from m where extract(day from d)%2=1 group by all) select coalesce(n.metric,f.metric) metric, coalesce(n.user_id,f.user_id) user_id, round(coalesce(s,0.0),4) s, round(coalesce(t,0.0),4) t from n full join f on n.metric=f.metric and n.user_id=f.user_id", "m")
def joi_13(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    side = lambda condition, c: rows.where(condition).groupBy("metric", "user_id").agg(F.sum("value").alias(c))
    out = joins.full_scores(side(~fails(), "s"), side(fails(), "t"), ["metric", "user_id"], "s", "t")
    return out.select("metric", "user_id", F.round("s", 4).alias("s"), F.round("t", 4).alias("t"))


@query("joi_16_null_safe_join", ", a as (select case when o_orderstatus='F' then null else o_orderstatus end k, count(*) n from orders group by 1), b as (select case when o_orderstatus='F' then null else o_orderstatus end k, max(o_totalprice) p from orders group by 1) select a.k, cast(n as bigint) n, round(p,2) p from a join b on a.k is not distinct from b.k", "m")
def joi_16(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.table(spark, sf, "orders").withColumn("k", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")))
    a, b = rows.groupBy("k").agg(F.count("*").alias("n")), rows.groupBy(F.col("k").alias("kb")).agg(F.max("o_totalprice").alias("p"))
    return a.join(b, F.col("k").eqNullSafe(F.col("kb"))).select("k", "n", F.round("p", 2).alias("p"))


# --- aggregations ------------------------------------------------------------------

@query("agg_01_class_aggregate", "select service, (epoch_us(ts)//1000000)//3600*3600 as hour, metric, round(case when metric in ('click') then sum(value) when metric in ('error') then max(value) else avg(value) end,6) as value from m group by service, hour, metric", "m")
def agg_01(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).withColumn("hour", series.bucket("ts", HOUR))
    return series.class_aggregate(rows, ["service", "hour"], "metric", "value", ["click"], ["error"]).select("service", "hour", "metric", r6("value"))


@query("agg_02_window_mean", EDGES + " select source, destination, round(avg(rt),6) fault_mean from u where extract(day from make_timestamp(start_us))%2=1 group by all", "s")
def agg_02(spark: SparkSession, sf: str) -> DataFrame:
    edges = traces.service_edges(views.spans(spark, sf)).where(F.dayofmonth(F.timestamp_micros("start_us")) % 2 == 1)
    return edges.groupBy("source", "destination").agg(r6(F.avg("response_time"), "fault_mean"))


GRID = ", v as (select service, (epoch_us(ts)//1000000)//3600*3600 as bucket, median(value) v from m where metric='click' group by all), k as (select distinct service from v), t as (select unnest(range((select min(bucket) from v), (select max(bucket)+3600 from v), 3600)) as bucket), f as (select k.service, t.bucket, v.v from k cross join t left join v on v.service=k.service and v.bucket=t.bucket)"


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    values = series.bucketed(views.metrics(spark, sf).where("metric = 'click'"), ["service"], "ts", "value", HOUR)
    bounds = values.agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"))
    keys = values.select("service").distinct()
    full = keys.join(joins.small(bounds)).withColumn("bucket", F.explode(F.sequence("first", "last", F.lit(HOUR).cast("long")))).drop("first", "last")
    return series.on_grid(values, full, ["service"])


@query("agg_03_median_grid", GRID + " select service, bucket, round(coalesce(v,0.0),6) as value from f", "m")
def agg_03(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).select("service", "bucket", r6(F.coalesce("value", F.lit(0.0)), "value"))


@query("agg_04_filled_matrix", GRID + " select service, bucket, round(coalesce(last_value(v ignore nulls) over (partition by service order by bucket rows between unbounded preceding and current row), first_value(v ignore nulls) over (partition by service order by bucket rows between current row and unbounded following), 0.0),6) as value from f", "m")
def agg_04(spark: SparkSession, sf: str) -> DataFrame:
    return series.filled(hourly(spark, sf), ["service"]).select("service", "bucket", r6("value"))


@query("agg_05_sigma_floor", ", b as (select service, avg(value) mean, stddev_samp(value) sigma from m where metric='click' and extract(day from d)%2=0 group by service) select service, round(mean,6) mean, round(greatest(sigma, (select quantile_cont(sigma,0.2) from b where sigma>0)),6) sigma from b", "m")
def agg_05(spark: SparkSession, sf: str) -> DataFrame:
    return series.baseline(views.metrics(spark, sf).where("metric = 'click'").where(~fails()), ["service"]).select("service", r6("mean"), r6("sigma"))


@query("agg_06_indicator_stats", "select pod, metric, round(stddev_pop(value),6) std, cast(count(distinct value) as bigint) nunique, count(distinct value)<=1 as is_constant from m group by pod, metric", "m")
def agg_06(spark: SparkSession, sf: str) -> DataFrame:
    return series.indicator_stats(views.metrics(spark, sf), ["pod", "metric"]).select("pod", "metric", r6("std"), "nunique", "is_constant")


@query("agg_14_alarm_scores", ", b as (select service, avg(value) mean, stddev_samp(value) sigma from m where extract(day from d)%2=0 group by service) select m.service, round(quantile_cont(abs((m.value-b.mean)/b.sigma),0.95),6) alarm from m join b on m.service=b.service where extract(day from d)%2=1 group by m.service", "m")
def agg_14(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    base = rows.where(~fails()).groupBy("service").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sigma"))
    return series.alarm_scores(rows.where(fails()), base, ["service"]).select("service", r6("alarm"))


COVER = ", c as (select distinct r.run_id, r.label, concat(m.service,'/',cast(cast(json_extract_string(m.props,'$.k') as bigint)%10 as varchar)) as item from m join r on m.d=r.d), x as (select item, cast(count(*) filter (label='fail') as double) ef, cast(count(*) filter (label='pass') as double) ep, cast((select count(*) from r where label='fail') as double) tf, cast((select count(*) from r where label='pass') as double) tp from c group by item), y as (select *, tf-ef nf, tp-ep np from x)"


def coverage(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat("service", F.lit("/"), (F.get_json_object("props", "$.k").cast("long") % 10).cast("string"))
    return views.metrics(spark, sf).join(F.broadcast(views.runs(spark).select("d", "run_id")), "d").select("run_id", item.alias("item")).distinct()


@query("agg_08_template_counts", "select r.run_id, m.service, cast(json_extract_string(m.props,'$.k') as bigint)%10 as template_id, cast(count(*) as bigint) n from m join r on m.d=r.d group by all", "mr")
def agg_08(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).join(F.broadcast(views.runs(spark).select("d", "run_id")), "d").groupBy("run_id", "service", (F.get_json_object("props", "$.k").cast("long") % 10).alias("template_id")).agg(F.count("*").alias("n"))


@query("agg_09_coverage", COVER + " select run_id, item from c", "mr")
def agg_09(spark: SparkSession, sf: str) -> DataFrame:
    return coverage(spark, sf)


@query("agg_10_spectrum_counts", COVER + " select item, cast(ef as bigint) ef, cast(ep as bigint) ep, cast(nf as bigint) nf, cast(np as bigint) np from y", "mr")
def agg_10(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spectrum(coverage(spark, sf), views.runs(spark), "item").select("item", "ef", "ep", "nf", "np")


MEASURES = """, z as (select item, ef, ep, nf, np, ef/tf rf, ep/tp rp,
coalesce(ef/nullif(ef+ep+nf,0),0) jaccard, coalesce(ef/nullif(sqrt((ef+ep)*(ef+nf)),0),0) ochiai, coalesce(ef*np/nullif(sqrt((ef+ep)*(nf+np)*(ef+np)*(nf+ep)),0),0) ochiai2,
case when ef=0 then 0 else coalesce(ef/nullif(ef+ep+nf+10000*nf*ep/ef,0),0) end zoltar, coalesce(ef*ef/nullif(ep+nf,0),0) dstar2, ef-ep/(np+1) op2,
ef-(case when ep<=2 then ep when ep<=10 then 2+0.1*(ep-2) else 2.8+0.01*(ep-10) end) wong3, 0.5*(ef/tf+coalesce(ef/nullif(ef+ep,0),0)) kulczynski2, case when ep=0 then ef else 0.0 end failed_only from y)"""


@query("mlg_13_spectrum", COVER + MEASURES + " select item, round(coalesce(rf/nullif(rf+rp,0),0),6) tarantula, " + ", ".join(f"round({m},6) {m}" for m in stats.MEASURES[1:]) + " from z", "mr")
def mlg_13(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spectrum(coverage(spark, sf), views.runs(spark), "item").select("item", *(r6(m) for m in stats.MEASURES))


@query("agg_11_candidates", EPSILON + " select service, cast(count(*) as bigint) n, round(sum(epsilon),6) epsilon_sum, round(avg(epsilon),6) mean_epsilon, round(max(epsilon),6) max_epsilon from x group by service", "m")
def agg_11(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.candidate_table(epsilon(spark, sf), [], "service", p_value=None).select("service", F.col("candidate_metric_count").alias("n"), r6("epsilon_sum"), r6("mean_epsilon"), r6("max_epsilon"))


@query("agg_21_accuracy_rollup", ", h as (select cast(extract(day from d)%5 as bigint) as day, run_id, extract(day from d)%3=0 as a, extract(day from d)%2=0 as b from r) select coalesce(day,-1) as day, cast(count(*) as bigint) n_total, round(avg(case when a then 1.0 else 0.0 end),6) top1_accuracy, round(avg(case when a or b then 1.0 else 0.0 end),6) top3_accuracy from h group by rollup(day)", "r")
def agg_21(spark: SparkSession, sf: str) -> DataFrame:
    day = F.dayofmonth("d")
    rows = views.runs(spark).select((day % 5).cast("long").alias("day"), (day % 3 == 0).cast("int").alias("top1"), ((day % 3 == 0) | (day % 2 == 0)).cast("int").alias("top3"))
    return ranking.accuracy(rows, "day", ks=(1, 3)).select(F.coalesce("day", F.lit(-1).cast("long")).alias("day"), "n_total", r6("top1_accuracy"), r6("top3_accuracy"))


@query("agg_22_mixed_dedupe", "select service, metric, cast(min(event_id) as bigint) first_event from m group by service, metric", "m")
def agg_22(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top(views.metrics(spark, sf), ["service", "metric"], 1, F.asc("event_id")).select("service", "metric", F.col("event_id").alias("first_event"))


@query("agg_23_arg_max", "select service, arg_max(pod, value*1000000000+event_id) pod, round(max(value),6) top_value from m group by service", "m")
def agg_23(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).groupBy("service").agg(F.max_by("pod", F.col("value") * 1000000000 + F.col("event_id")).alias("pod"), r6(F.max("value"), "top_value"))


@query("agg_24_ordered_labels", "select pod, string_agg(metric, ',' order by f) as labels from (select pod, metric, min(event_id) f from m group by pod, metric) group by pod", "m")
def agg_24(spark: SparkSession, sf: str) -> DataFrame:
    first = views.metrics(spark, sf).groupBy("pod", "metric").agg(F.min("event_id").alias("f"))
    return first.groupBy("pod").agg(F.array_join(F.array_sort(F.collect_list(F.struct("f", "metric")))["metric"], ",").alias("labels"))


@query("agg_25_value_counts", "select service, cast(count(*) filter (extract(day from d)%2=0) as bigint) a, cast(count(*) filter (extract(day from d)%2=1) as bigint) b from m group by service", "m")
def agg_25(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).groupBy("service").agg(F.count_if(~fails()).alias("a"), F.count_if(fails()).alias("b"))


@query("agg_26_service_latency", EDGES + " select destination, start_us//3600000000 as hour, round(avg(rt),6) latency from u group by all", "s")
def agg_26(spark: SparkSession, sf: str) -> DataFrame:
    edges = traces.service_edges(views.spans(spark, sf))
    return edges.groupBy("destination", F.floor(F.col("start_us") / 3_600_000_000).alias("hour")).agg(r6(F.avg("response_time"), "latency"))


# --- windows -----------------------------------------------------------------------

@query("win_01_rolling_mean", "select event_id, round(avg(value) over (partition by service, metric order by ts, event_id rows between 11 preceding and current row),6) rolling from m", "m")
def win_01(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).withColumn("o", F.struct("ts", "event_id"))
    return series.rolling_mean(rows, ["service", "metric"], order="o").select("event_id", r6("rolling"))


@query("win_02_average_rank", ", x as (select service, metric, cast(count(*) as bigint) n from m group by all) select service, metric, rank() over (partition by metric order by n desc) + (count(*) over (partition by metric, n)-1)/2.0 as avg_rank, cast(dense_rank() over (partition by metric order by n desc) as bigint) dense from x", "m")
def win_02(spark: SparkSession, sf: str) -> DataFrame:
    counts = views.metrics(spark, sf).groupBy("service", "metric").agg(F.count("*").alias("n"))
    dense = F.dense_rank().over(Window.partitionBy("metric").orderBy(F.desc("n"))).cast("long")
    return series.rank_average(counts, ["metric"], "n", "avg_rank").select("service", "metric", "avg_rank", dense.alias("dense"))


@query("win_02_rank_score", ", x as (select service, metric, cast(count(*) as bigint) n from m group by all), y as (select *, rank() over (partition by metric order by n desc) + (count(*) over (partition by metric, n)-1)/2.0 k, count(*) over (partition by metric) c from x) select service, metric, round(case when c<=1 then 1.0 else 1-(k-1)/(c-1) end,6) rank_score from y", "m")
def win_02s(spark: SparkSession, sf: str) -> DataFrame:
    counts = views.metrics(spark, sf).groupBy("service", "metric").agg(F.count("*").alias("n"))
    return series.rank_score(counts, ["metric"], "n").select("service", "metric", r6("rank_score"))


@query("win_03_fill", GRID + " select service, cast(count(*) filter (v is null) as bigint) gaps, cast(count(*) as bigint) cells from f group by service", "m")
def win_03(spark: SparkSession, sf: str) -> DataFrame:
    return hourly(spark, sf).groupBy("service").agg(F.count_if(F.col("value").isNull()).alias("gaps"), F.count("*").alias("cells"))


PAIRS = ", p as (select service as label, lead(service) over (partition by trace_id order by start_us, span_id) as next_label, case when service='error' then 0.25 else 1.0 end as weight, lead(case when service='error' then 0.25 else 1.0 end) over (partition by trace_id order by start_us, span_id) as next_weight, day from s), q as (select * from p where next_label is not null)"


def event_pairs(spark: SparkSession, sf: str) -> DataFrame:
    events = views.spans(spark, sf).withColumn("label", F.col("service")).withColumn("weight", F.when(F.col("service") == "error", 0.25).otherwise(1.0))
    return traces.event_pairs(events, ["trace_id"], [F.asc("start_us"), F.asc("span_id")])


@query("win_04_event_pairs", PAIRS + " select label, next_label, cast(count(*) as bigint) n from q group by all", "s")
def win_04(spark: SparkSession, sf: str) -> DataFrame:
    return event_pairs(spark, sf).groupBy("label", "next_label").agg(F.count("*").alias("n"))


@query("agg_17_pattern_support", PAIRS + " select label, next_label, round(sum(least(weight,next_weight)),6) support from q group by all", "s")
def agg_17(spark: SparkSession, sf: str) -> DataFrame:
    return traces.pattern_support(event_pairs(spark, sf)).select("label", "next_label", r6("support"))


SCORES = PAIRS + ", n as (select label, next_label, sum(least(weight,next_weight)) n from q where cast(right(day,2) as int)%2=0 group by all), f as (select label, next_label, sum(least(weight,next_weight)) a from q where cast(right(day,2) as int)%2=1 group by all), b as (select coalesce(n.label,f.label) as label, coalesce(n.next_label,f.next_label) next_label, coalesce(n,0.0) n, coalesce(a,0.0) a from n full join f on n.label=f.label and n.next_label=f.next_label), w as (select *, a/(a+n) abnormal, n/(a+n) expected from b)"


def scored_patterns(spark: SparkSession, sf: str) -> DataFrame:
    pairs = event_pairs(spark, sf)
    odd = F.substring("day", 9, 2).cast("int") % 2 == 1
    return traces.pattern_scores(traces.pattern_support(pairs.where(~odd)), traces.pattern_support(pairs.where(odd)))


@query("mlg_22_pattern_scores", SCORES + " select label, next_label, round(n,6) n, round(a,6) a, round(abnormal,6) abnormal, round(expected,6) expected from w", "s")
def mlg_22(spark: SparkSession, sf: str) -> DataFrame:
    return scored_patterns(spark, sf).select("label", "next_label", *(r6(c) for c in ("n", "a", "abnormal", "expected")))


@query("top_06_pattern_rankers", SCORES + ", k as (select *, round(abnormal,9) sc from w where a>1 and abnormal>=0.10) select label, next_label, round(abnormal,6) abnormal from k x where not exists (select 1 from k y where y.next_label=x.label and x.sc<=y.sc and not (y.label=x.label and y.next_label=x.next_label))", "s")
def top_06(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored_patterns(spark, sf).where("a > 1 and abnormal >= 0.10").withColumn("sc", F.round("abnormal", 9))
    return traces.without_children(rows, "sc").select("label", "next_label", r6("abnormal"))


@query("agg_18_service_credit", SCORES + ", k as (select label, next_label, abnormal from w where a>1), u as (select label as service, abnormal/(case when label=next_label then 1 else 2 end) part from k union all select next_label, abnormal/2 from k where label<>next_label) select service, round(sum(part),6) score, cast(count(*) as bigint) pattern_count from u group by service", "s")
def agg_18(spark: SparkSession, sf: str) -> DataFrame:
    return traces.service_credit(scored_patterns(spark, sf).where("a > 1"), "abnormal").select("service", r6("score"), "pattern_count")


@query("win_05_sequence", "select trace_id, span_id, cast(row_number() over (partition by trace_id order by duration_us desc, span_id) as bigint) as rank from s", "s")
def win_05(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.ranked(views.spans(spark, sf), ["trace_id"], F.desc("duration_us"), F.asc("span_id")).select("trace_id", "span_id", "rank")


@query("win_06_gap_clusters", ", a as (select metric, service, round(avg(value),6) score from m group by all), k as (select *, row_number() over (partition by metric order by score desc, service) n from a), w as (select metric, service, score, n, score as top, 1 as cluster from k where n=1 union all select k.metric, k.service, k.score, k.n, case when w.top-k.score>0.5 then k.score else w.top end, w.cluster+case when w.top-k.score>0.5 then 1 else 0 end from w join k on k.metric=w.metric and k.n=w.n+1) select metric, service, score, cast(cluster as integer) as cluster from w", "m", recursive=True)
def win_06(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).groupBy("metric", "service").agg(F.round(F.avg("value"), 6).alias("score")).withColumn("limit", F.lit(0.5))
    return stats.gap_clusters(rows, "metric", "service", "score", "limit")


RANKED = ", a as (select metric as source, service, round(avg(value),9) score from m where not (metric='click' and service in ('svc1','svc2')) group by all), k as (select *, cast(row_number() over (partition by source order by score desc, service) as bigint) as rank from a)"


@query("win_07_rank_fusion", RANKED + ", n as (select source, max(rank) n, max(score) t from k group by source), z as (select s.service, n.source, coalesce(k.rank, n.n+1) rk, coalesce(k.score/n.t,0.0) sc, case when k.rank is null then 0.0 else 1.0/(60+k.rank) end rr from (select distinct service from k) s cross join n left join k on k.service=s.service and k.source=n.source) select service, round(sum(rr),9) rrf, round(avg(rk),6) avg_rank, round(avg(sc),6) avg_score from z group by service", "m")
def win_07(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).where(~((F.col("metric") == "click") & F.col("service").isin("svc1", "svc2"))).groupBy(F.col("metric").alias("source"), "service").agg(F.round(F.avg("value"), 9).alias("score"))
    ranks = ranking.ranked(rows, ["source"], F.desc("score"), F.asc("service"))
    return ranking.fuse(ranks, [], "service").select("service", F.round("rrf", 9).alias("rrf"), r6("avg_rank"), r6("avg_score"))


# --- top-k -------------------------------------------------------------------------

@query("top_01_candidates", ", a as (select metric, service, round(avg(value),9) v from m group by all), q as (select *, quantile_cont(v,0.8) over (partition by metric) t, row_number() over (partition by metric order by v desc, service) k from a) select metric, service, round(v,6) v from q where v>=t or k<=5 or service='svc0'", "m")
def top_01(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).groupBy("metric", "service").agg(F.round(F.avg("value"), 9).alias("v"))
    return ranking.select_candidates(rows, ["metric"], "service", "v", forced=["svc0"]).select("metric", "service", r6("v"))


@query("top_02_hits", ", a as (select cast(d as varchar) run_id, service, round(avg(value),9) v from m group by all), k as (select *, row_number() over (partition by run_id order by v desc, service) rk from a), t as (select run_id, concat('svc',cast(extract(day from d)%14 as varchar)) target from r) select t.run_id, t.target, cast(max(case when k.service=t.target and rk<=1 then 1 else 0 end) as bigint) top1, cast(max(case when k.service=t.target and rk<=3 then 1 else 0 end) as bigint) top3, cast(max(case when k.service=t.target and rk<=5 then 1 else 0 end) as bigint) top5 from t left join k on k.run_id=t.run_id group by t.run_id, t.target", "mr")
def top_02(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).groupBy(F.date_format("d", "yyyy-MM-dd").alias("run_id"), "service").agg(F.round(F.avg("value"), 9).alias("v"))
    truth = views.runs(spark).select("run_id", F.concat(F.lit("svc"), (F.dayofmonth("d") % 14).cast("string")).alias("target"))
    return ranking.hits(ranking.ranked(rows, ["run_id"], F.desc("v"), F.asc("service")), truth, ["run_id"], "service", "target")


@query("top_05_best_config", ", a as (select metric, round(avg(case when value>10 then 1.0 else 0.0 end),9) t1, round(avg(case when value>5 then 1.0 else 0.0 end),9) t3 from m group by metric) select metric, round(0.6*t1+0.4*t3,6) selection_score from a order by 0.6*t1+0.4*t3 desc, metric limit 1", "m")
def top_05(spark: SparkSession, sf: str) -> DataFrame:
    over = lambda x: F.round(F.avg(F.when(F.col("value") > x, 1.0).otherwise(0.0)), 9)
    rows = views.metrics(spark, sf).groupBy("metric").agg(over(10).alias("t1"), over(5).alias("t3"))
    return ranking.best_config(rows, {"t1": 0.6, "t3": 0.4}, "metric").select("metric", r6("selection_score"))


# --- sets --------------------------------------------------------------------------

@query("set_01_union_all", "select 'orders' as source, cast(count(*) as bigint) n, round(sum(o_totalprice),2) total from orders union all select 'events', cast(count(*) as bigint), round(sum(value),2) from events")
def set_01(spark: SparkSession, sf: str) -> DataFrame:
    side = lambda t, c: views.table(spark, sf, t).agg(F.lit(t).alias("source"), F.count("*").alias("n"), F.round(F.sum(c), 2).alias("total"))
    return side("orders", "o_totalprice").unionByName(side("events", "value"))


@query("set_02_key_sets", ", a as (select distinct service, metric from m where extract(day from d)=1), b as (select distinct service, metric from m where extract(day from d)=2) select 'both' kind, * from (select * from a intersect select * from b) union all select 'left', * from (select * from a except select * from b) union all select 'any', * from (select * from a union select * from b)", "m")
def set_02(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    a, b = (rows.where(F.dayofmonth("d") == k).select("service", "metric").distinct() for k in (1, 2))
    kinds = {"both": a.intersect(b), "left": a.subtract(b), "any": a.union(b).distinct()}
    parts = [df.select(F.lit(k).alias("kind"), "service", "metric") for k, df in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("set_03_vector_or", ", a as (select service, metric, round(sum(value),4) as value from m where extract(day from d)=1 group by all), b as (select service, metric, round(sum(value),4) as value from m where extract(day from d)=2 group by all) select * from a union all select * from b where not exists (select 1 from a where a.service=b.service and a.metric=b.metric)", "m")
def set_03(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    a, b = (rows.where(F.dayofmonth("d") == k).groupBy("service", "metric").agg(F.round(F.sum("value"), 4).alias("value")) for k in (1, 2))
    return promql.vector_or(a, b, ["service", "metric"])


# --- time-series expressions -------------------------------------------------------

STEP = ", c as (select *, lag(value) over (partition by service, metric order by ts, event_id) pv from m), e as (select *, case when pv is null then 0.0 when value<pv then value else value-pv end st from c)"


@query("pql_02_rate", STEP + " select event_id, round(sum(st) over (partition by service, metric order by ts range between interval 6 hour preceding and current row)/21600,9) rate from e", "m")
def pql_02(spark: SparkSession, sf: str) -> DataFrame:
    return promql.rate(views.metrics(spark, sf), ["service", "metric"], 21600).select("event_id", F.round("rate", 9).alias("rate"))


@query("pql_02_increase", STEP + " select event_id, round(sum(st) over (partition by service, metric order by ts range between interval 1 hour preceding and current row),6) as increase from e", "m")
def pql_02i(spark: SparkSession, sf: str) -> DataFrame:
    return promql.increase(views.metrics(spark, sf), ["service", "metric"], 3600).select("event_id", r6("increase"))


@query("pql_03_avg_over_time", "select event_id, round(avg(value) over (partition by service, metric order by ts range between interval 12 hour preceding and current row),6) avg_over_time from m", "m")
def pql_03(spark: SparkSession, sf: str) -> DataFrame:
    return promql.avg_over_time(views.metrics(spark, sf), ["service", "metric"], 43200).select("event_id", r6("avg_over_time"))


@query("pql_04_aggregate_by", "select service, round(sum(value),4) s, round(max(value),4) x, round(avg(value),6) a, cast(count(value) as bigint) c from m group by service", "m")
def pql_04(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    by = lambda how, c: promql.aggregate_by(rows, ["service"], how=how).withColumnRenamed("value", c)
    out = by("sum", "s").join(by("max", "x"), "service").join(by("avg", "a"), "service").join(by("count", "c"), "service")
    return out.select("service", F.round("s", 4).alias("s"), F.round("x", 4).alias("x"), r6("a"), "c")


@query("pql_05_histogram_quantile", ", b as (select service, le, cast(count(*) filter (value<=le) as double) c from m cross join (select unnest([1.0,5.0,10.0,25.0,50.0,100.0,1000000.0]) le) group by service, le), w as (select *, coalesce(lag(le) over (partition by service order by le),0.0) lo, coalesce(lag(c) over (partition by service order by le),0.0) be, 0.9*max(c) over (partition by service) rk from b), k as (select *, row_number() over (partition by service order by le) n from w where c>=rk and rk>0) select service, round(lo+(le-lo)*coalesce((rk-be)/nullif(c-be,0),0),6) quantile from k where n=1", "m")
def pql_05(spark: SparkSession, sf: str) -> DataFrame:
    bounds = F.array(*(F.lit(x) for x in (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 1000000.0)))
    rows = views.metrics(spark, sf).select("service", "value", F.explode(bounds).alias("le"))
    buckets = rows.groupBy("service", "le").agg(F.count_if(F.col("value") <= F.col("le")).cast("double").alias("value"))
    return promql.histogram_quantile(buckets, ["service"], 0.9).select("service", r6("quantile"))


@query("pql_06_vector_arithmetic", ", a as (select service, sum(value) v from m where metric='error' group by service), b as (select service, sum(value) v from m group by service) select a.service, round(a.v/greatest(b.v,1.0),6) as value from a join b on a.service=b.service", "m")
def pql_06(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    part, whole = promql.aggregate_by(rows.where("metric = 'error'"), ["service"]), promql.aggregate_by(rows, ["service"])
    return promql.arithmetic(part, whole, ["service"], "/", floor=1.0).select("service", r6("value"))


@query("pql_07_group_left", ", o as (select service, count(*)/100.0 f from m group by service) select m.pod, m.service, round(sum(m.value)*max(o.f),4) as value from m join o on m.service=o.service group by m.pod, m.service", "m")
def pql_07(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    many, one = promql.aggregate_by(rows, ["pod", "service"]), rows.groupBy("service").agg((F.count("*") / 100).alias("value"))
    return promql.group_left(many, one, ["service"], []).select("pod", "service", F.round("value", 4).alias("value"))


@query("pql_08_label_replace", "select distinct pod, case when regexp_full_match(pod,'svc(\\d+)-.*') then regexp_extract(pod,'^svc(\\d+)-.*$',1) else '' end as number from m", "m")
def pql_08(spark: SparkSession, sf: str) -> DataFrame:
    return promql.label_replace(views.metrics(spark, sf).select("pod").distinct(), "number", "pod", r"svc(\d+)-.*")


@query("pql_09_label_matchers", "select metric, cast(count(*) as bigint) n from m where regexp_full_match(service,'svc1.*') and metric<>'error' and not regexp_full_match(pod,'.*-2') group by metric", "m")
def pql_09(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    keep = promql.matches(F.col("service"), "=~", "svc1.*") & promql.matches(F.col("metric"), "!=", "error") & promql.matches(F.col("pod"), "!~", ".*-2")
    return rows.where(keep).groupBy("metric").agg(F.count("*").alias("n"))


@query("pql_01_first_candidate", ", a as (select service, metric, round(sum(value),4) as value, 0 prio from m where extract(day from d)=1 and metric='error' group by all), b as (select service, metric, round(sum(value),4) as value, 1 prio from m where metric='click' group by all), u as (select * from a union all select * from b) select service, metric, value, cast(prio as int) prio from u where prio=(select min(prio) from u x where x.service=u.service)", "m")
def pql_01(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf)
    total = lambda df: df.groupBy("service", "metric").agg(F.round(F.sum("value"), 4).alias("value"))
    return promql.first_candidate([total(rows.where("metric = 'error'").where(F.dayofmonth("d") == 1)), total(rows.where("metric = 'click'"))], ["service"])
