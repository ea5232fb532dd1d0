"""Queries of the trace, graph, mining and clustering operators; those that SQL cannot express are tested against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import drain, graph, joins, learned, ranking, series, stats, traces
from ..sources import sinks, views
from . import parsing
from .registry import query
from .telemetry import COVER, MEASURES, coverage, fails, r6

#: Call paths in SQL: the driver's spans form a chain per trace, so a path is the trace's services so far, runs collapsed.
PATHS = ", o as (select *, case when service is distinct from lag(service) over (partition by trace_id order by start_us, span_id) then service end as step from s), p as (select trace_id, span_id, service, duration_us, day, string_agg(step,'>') over (partition by trace_id order by start_us, span_id rows between unbounded preceding and current row) as path_key from o)"


def paths(spark: SparkSession, sf: str) -> DataFrame:
    return traces.call_paths(views.spans(spark, sf), ("duration_us", "day"))


def odd_day():
    return F.substring("day", 9, 2).cast("int") % 2 == 1


@query("mlg_15_call_paths", PATHS + " select trace_id, span_id, path_key from p", "s")
def mlg_15(spark: SparkSession, sf: str) -> DataFrame:
    return paths(spark, sf).select("trace_id", "span_id", F.array_join("path", ">").alias("path_key"))


@query("mlg_23_depth", "select trace_id, span_id, cast(row_number() over (partition by trace_id order by start_us, span_id) as bigint) as depth from s", "s")
def mlg_23(spark: SparkSession, sf: str) -> DataFrame:
    return traces.ancestors(views.spans(spark, sf))


TREE = ", w as (select trace_id, span_id, [service] as path, service, 1 as depth from b where not exists (select 1 from b q where q.trace_id=b.trace_id and q.span_id=b.parent_span_id) union all select c.trace_id, c.span_id, case when w.service=c.service then w.path else list_append(w.path, c.service) end, c.service, w.depth+1 from b c join w on c.trace_id=w.trace_id and c.parent_span_id=w.span_id)"


@query("mlg_15_tree_paths", TREE + " select trace_id, span_id, array_to_string(path,'>') path_key from w", "sb", recursive=True)
def mlg_15_tree(spark: SparkSession, sf: str) -> DataFrame:
    return traces.call_paths(views.tree_spans(spark, sf), ()).select("trace_id", "span_id", F.array_join("path", ">").alias("path_key"))


@query("mlg_23_tree_depth", TREE + " select trace_id, span_id, cast(depth as bigint) depth from w", "sb", recursive=True)
def mlg_23_tree(spark: SparkSession, sf: str) -> DataFrame:
    return traces.ancestors(views.tree_spans(spark, sf))


@query("agg_27_path_vocabulary", PATHS + ", v as (select distinct service, path_key from p) select service, path_key, cast(row_number() over (order by service, path_key)-1 as bigint) as dim from v", "s")
def agg_27(spark: SparkSession, sf: str) -> DataFrame:
    return traces.path_vocabulary(paths(spark, sf))


#: Vocabulary of even days, vectors of all traces.
VECTORS = PATHS + ", v as (select service, path_key, row_number() over (order by service, path_key)-1 as dim from (select distinct service, path_key from p where cast(right(day,2) as int)%2=0)), x as (select p.trace_id, p.service, p.path_key, v.dim, max(duration_us) as duration, max(day) as day from p left join v on p.service=v.service and p.path_key=v.path_key group by all)"


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All traces' vectors on the even days' vocabulary, and that vocabulary."""
    rows = sinks.stored(paths(spark, sf).drop("depth"), "paths")
    vocabulary = sinks.stored(traces.path_vocabulary(rows.where(~odd_day())), "vocabulary")
    return sinks.stored(traces.trace_vectors(rows, vocabulary), "vectors"), vocabulary


@query("agg_15_trace_vectors", VECTORS + " select trace_id, service, path_key, coalesce(cast(dim as bigint),-1) as dim, duration from x", "s")
def agg_15(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf)[0].select("trace_id", "service", "path_key", F.coalesce("dim", F.lit(-1).cast("long")).alias("dim"), "duration")


@query("joi_14_unseen_paths", VECTORS + " select trace_id, cast(count(*) filter (dim is null) as bigint) unseen, cast(count(dim) as bigint) known from x group by trace_id", "s")
def joi_14(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf)[0].groupBy("trace_id").agg(F.count_if(F.col("dim").isNull()).alias("unseen"), F.count("dim").alias("known"))


@query("joi_15_mask_keys", VECTORS + ", k as (select trace_id, string_agg(cast(dim as varchar), ',' order by dim) m from x where dim is not null group by trace_id), c as (select m, count(*) n from k group by m) select k.trace_id, sha256(k.m) as mask, cast(c.n as bigint) as same from k join c on k.m=c.m", "s")
def joi_15(spark: SparkSession, sf: str) -> DataFrame:
    masks = traces.mask_keys(vectors(spark, sf)[0]).select("trace_id", "mask")
    return masks.join(masks.groupBy("mask").agg(F.count("*").alias("same")), "mask").select("trace_id", "mask", "same")


STATS = ", t as (select dim, avg(cast(duration as double)) filter (duration>1e-5) mean, greatest(1.0, coalesce(stddev_pop(cast(duration as double)) filter (duration>1e-5),0)) sigma from x where dim is not null and cast(right(day,2) as int)%2=0 group by dim)"


def even(df: DataFrame) -> DataFrame:
    return df.where(F.substring("trace_id", -2, 2).cast("int") % 2 == 0)


@query("agg_16_dimension_stats", VECTORS + STATS + " select cast(dim as bigint) dim, round(mean,4) mean, round(sigma,4) sigma from t", "s")
def agg_16(spark: SparkSession, sf: str) -> DataFrame:
    return traces.dimension_stats(even(vectors(spark, sf)[0])).select("dim", F.round("mean", 4).alias("mean"), F.round("sigma", 4).alias("sigma"))


TRACE_SCORES = VECTORS + STATS + ", z as (select x.trace_id, max(x.day) as day, avg(-0.5*(power((x.duration-t.mean)/t.sigma,2)+ln(2*pi()*t.sigma*t.sigma))) as score, count(*) filter (x.dim is null) as unseen from x left join t on x.dim=t.dim group by x.trace_id)"


def scores(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = vectors(spark, sf)
    return sinks.stored(traces.trace_scores(rows, traces.dimension_stats(even(rows))), "scores")


@query("mlg_18_trace_scores", TRACE_SCORES + " select trace_id, round(score,5) score, cast(unseen as bigint) unseen, coalesce(unseen>0 or score < (select min(score) from z where cast(right(day,2) as int)%2=0), false) as is_anomalous from z", "s")
def mlg_18(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf)
    flagged = traces.flag_traces(rows, even(rows))
    return flagged.select("trace_id", F.round("score", 5).alias("score"), F.col("unseen_path_count").alias("unseen"), F.coalesce("is_anomalous", F.lit(False)).alias("is_anomalous"))


@query("mlg_18_left_tail", TRACE_SCORES + ", q as (select trace_id, round(score,6) as score, day from z where score is not null), f as (select score from q where cast(right(day,2) as int)%2=0) select q.trace_id, round((select count(*) from f where f.score<=q.score)/(select cast(count(*) as double) from f),6) p_value from q", "s")
def mlg_18p(spark: SparkSession, sf: str) -> DataFrame:
    rows = scores(spark, sf).where("score is not null").select("trace_id", F.round("score", 6).alias("score"))
    return traces.left_tail(rows, even(rows)).select("trace_id", r6("p_value"))


@query("mlg_19_three_sigma", VECTORS + STATS + ", w as (select x.trace_id, x.service, x.path_key, abs(x.duration-t.mean)/case when t.sigma<=1e-8 then 1.0 else t.sigma end as z from x join t on x.dim=t.dim), k as (select *, row_number() over (partition by trace_id order by len(split(path_key,'>')) desc, z desc, service, path_key) n from w where z>1.5) select trace_id, service, path_key, round(z,5) z from k where n=1", "s")
def mlg_19(spark: SparkSession, sf: str) -> DataFrame:
    rows, _ = vectors(spark, sf)
    return traces.three_sigma(rows.where("dim is not null"), traces.dimension_stats(even(rows)), limit=1.5).select("trace_id", "service", "path_key", F.round("z", 5).alias("z"))


COMMON_PATH = ", hp as (select path_key as known_path, unnest(range(1, len(split(path_key,'>'))+1)) k from v), kp as (select array_to_string(split(known_path,'>')[1:k],'>') as head, min(known_path) known_path from hp group by 1), up as (select path_key, unnest(range(1, len(split(path_key,'>'))+1)) k from (select distinct path_key from x where dim is null)), bp as (select up.path_key, max(k) prefix, arg_max(kp.known_path, k) known_path from up join kp on kp.head=array_to_string(split(up.path_key,'>')[1:k],'>') group by 1)"


@query("mlg_20_longest_common_path", VECTORS + COMMON_PATH + " select x.trace_id, x.path_key, bp.known_path, cast(bp.prefix as bigint) prefix from x join bp on x.path_key=bp.path_key where x.dim is null", "s")
def mlg_20(spark: SparkSession, sf: str) -> DataFrame:
    rows, vocabulary = vectors(spark, sf)
    return traces.longest_common_path(rows.where("dim is null").select("trace_id", "path_key"), vocabulary).select("trace_id", "path_key", "known_path", "prefix")


@query("mlg_16_trace_model")
def mlg_16(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the autoencoder that is trained on the even days, as stored rows."""
    rows, vocabulary = vectors(spark, sf)
    known = learned.normalized(even(rows), traces.dimension_stats(even(rows)))
    return learned.as_table(spark, learned.fit(known, vocabulary.count()))


@query("mlg_17_likelihoods")
def mlg_17(spark: SparkSession, sf: str) -> DataFrame:
    rows, vocabulary = vectors(spark, sf)
    width, stats_ = vocabulary.count(), traces.dimension_stats(even(rows))
    model = learned.fit(learned.normalized(even(rows), stats_), width)
    return learned.likelihoods(learned.normalized(rows, stats_), model, width)


@query("mlg_21_split", "select distinct trace_id, case when cast(concat('0x', substr(md5(trace_id),1,6)) as bigint)%10=0 then 'valid' else 'train' end as part from s", "s")
def mlg_21(spark: SparkSession, sf: str) -> DataFrame:
    valid = F.conv(F.substring(F.md5(F.col("trace_id").cast("binary")), 1, 6), 16, 10).cast("long") % 10 == 0
    return views.spans(spark, sf).select("trace_id").distinct().select("trace_id", F.when(valid, "valid").otherwise("train").alias("part"))


@query("joi_07_parent_event", ", f as (select trace_id, span_id as parent_span_id, unnest([0,1,2]) as pos, service, start_us, duration_us from s), v as (select trace_id, parent_span_id, pos, concat(service,' ',cast(pos as varchar)) as label, start_us + pos*60000000 as event_us from f), c as (select trace_id, span_id, parent_span_id, start_us from s where parent_span_id is not null) select c.trace_id, c.span_id, case when max(event_us)>max(start_us) then coalesce(arg_max(label, pos) filter (event_us<=start_us), arg_min(label, pos)) else arg_min(label, pos) end as parent_label from c join v on c.trace_id=v.trace_id and c.parent_span_id=v.parent_span_id group by c.trace_id, c.span_id", "s")
def joi_07_parent(spark: SparkSession, sf: str) -> DataFrame:
    spans = views.spans(spark, sf)
    events = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), "service", F.col("start_us").alias("_s"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pos"))
    events = events.select("trace_id", "parent_span_id", "pos", F.concat("service", F.lit(" "), F.col("pos").cast("string")).alias("label"), (F.col("_s") + F.col("pos") * 60_000_000).alias("event_us"))
    return traces.parent_event(spans.where("parent_span_id is not null").select("trace_id", "span_id", "parent_span_id", "start_us"), events)


@query("joi_06_exact_then_interval", ", l as (select trace_id, span_id, service, start_us as at from s where span_id%2=0 union all select trace_id, null, service, start_us+1000 from s where span_id%2=1), q as (select trace_id, span_id, service, start_us, start_us+2000 as end_us from s), a as (select q.trace_id, q.span_id from l join q on l.trace_id=q.trace_id and l.span_id=q.span_id), b as (select q.trace_id, q.span_id from q join l on l.trace_id=q.trace_id and l.service=q.service and l.at between q.start_us and q.end_us where not exists (select 1 from l x where x.trace_id=q.trace_id and x.span_id=q.span_id)) select trace_id, span_id, cast(count(*) as bigint) n from (select * from a union all select * from b) group by all", "s")
def joi_06(spark: SparkSession, sf: str) -> DataFrame:
    spans = views.spans(spark, sf)
    logs = spans.where("span_id % 2 = 0").select("trace_id", "span_id", "service", F.col("start_us").alias("at")).unionByName(spans.where("span_id % 2 = 1").select("trace_id", F.lit(None).cast("long").alias("span_id"), "service", (F.col("start_us") + 1000).alias("at")))
    intervals = spans.select("trace_id", "span_id", "service", "start_us", (F.col("start_us") + 2000).alias("end_us"))
    found = joins.exact_then_interval(logs, intervals, ["trace_id", "span_id"], ["trace_id", "service"], "at", "start_us", "end_us", 60_000_000)
    return found.groupBy("trace_id", "span_id").agg(F.count("*").alias("n"))


# --- service graphs ----------------------------------------------------------------

DAILY = ", g as (select cast(day as varchar) as day, source, destination, avg(rt) w from (select c.day, q.service as source, c.service as destination, c.duration_us/1000.0 rt from s c join s q on c.trace_id=q.trace_id and c.parent_span_id=q.span_id where q.service<>c.service) group by all)"


def daily_edges(spark: SparkSession, sf: str) -> DataFrame:
    spans = views.spans(spark, sf)
    parent = spans.select("trace_id", F.col("span_id").alias("parent_span_id"), F.col("service").alias("src"))
    rows = spans.join(parent, ["trace_id", "parent_span_id"]).where("src <> service")
    return rows.groupBy("day", "src", F.col("service").alias("dst")).agg(F.avg(F.col("duration_us") / 1000).alias("w"))


@query("mlg_03_call_graph", DAILY + " select day, source as src, destination as dst from g", "s")
def mlg_03(spark: SparkSession, sf: str) -> DataFrame:
    return graph.call_graph(daily_edges(spark, sf), "day")


ANOMALY = DAILY + ", b as (select source, destination, avg(w) m from g group by all), a as (select g.day, g.source src, g.destination dst, round(case when g.w>1.2*b.m then 0.55 else greatest(0.0, 1-abs(g.w-b.m)/b.m) end,3) weight, g.w>1.2*b.m as anomalous from g join b on g.source=b.source and g.destination=b.destination)"


def weighted_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily_edges(spark, sf)
    means = rows.groupBy("src", "dst").agg(F.avg("w").alias("m"))
    joined = rows.join(joins.small(means), ["src", "dst"]).withColumns({"anomalous": F.col("w") > 1.2 * F.col("m"), "corr": 1 - F.abs(F.col("w") - F.col("m")) / F.col("m")})
    return graph.edge_weights(joined, "anomalous", "corr").select("day", "src", "dst", "weight", "anomalous")


@query("mlg_04_edge_weights", ANOMALY + " select day, src, dst, weight, anomalous from a", "s")
def mlg_04(spark: SparkSession, sf: str) -> DataFrame:
    return weighted_edges(spark, sf)


def personal(spark: SparkSession, sf: str) -> DataFrame:
    corr = views.metrics(spark, sf).groupBy(F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("metric").alias("node")).agg((F.avg("value") / F.max("value")).alias("corr"))
    return graph.personalization(weighted_edges(spark, sf), corr, "day")


@query("mlg_05_personalization", ANOMALY + ", c as (select strftime(ts,'%Y-%m-%d') as day, event_type as node, avg(value)/max(value) r from events group by all), n as (select day, src as node, weight from a union all select day, dst, weight from a) select n.day, n.node, round(avg(weight)*greatest(0.01, coalesce(max(abs(c.r)),0.0))/count(*),6) personal from n left join c on n.day=c.day and n.node=c.node group by n.day, n.node", "s")
def mlg_05(spark: SparkSession, sf: str) -> DataFrame:
    return personal(spark, sf).select("day", "node", r6("personal"))


@query("mlg_06_pagerank")
def mlg_06(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank(weighted_edges(spark, sf), personal(spark, sf), "day").withColumn("score", F.round("score", 9))


@query("mlg_07_threshold_edges", DAILY + ", b as (select source, destination, avg(w) filter (cast(right(day,2) as int)%2=0) n, avg(w) filter (cast(right(day,2) as int)%2=1) f from g group by all), r as (select *, case when n<>0 then f/n when f=0 then 1.0 else cast('inf' as double) end ratio from b where n is not null and f is not null), k as (select *, row_number() over (order by round(ratio,9) desc, source, destination) i, count(*) filter (ratio>1.05) over () c from r) select source as src, destination as dst, round(ratio,6) ratio from k where ratio>1.05 or (c=0 and i<=5)", "s")
def mlg_07(spark: SparkSession, sf: str) -> DataFrame:
    ratio = joins.window_ratio(daily_edges(spark, sf), ["src", "dst"], odd_day(), "w").withColumn("_r", F.round("ratio", 9))
    some = ratio.where("ratio > 1.05")
    none = some.agg(F.count("*").alias("_over")).where("_over = 0")
    first = ratio.orderBy(F.desc("_r"), "src", "dst").limit(5).join(F.broadcast(none)).drop("_over")  # the five greatest where no edge exceeds the limit
    return some.unionByName(first).select("src", "dst", r6("ratio"))


@query("mlg_02_birch_test")
def mlg_02(spark: SparkSession, sf: str) -> DataFrame:
    values = series.bucketed(views.metrics(spark, sf), ["service", "metric"], "ts", "value", 3600)
    return graph.birch_test(values, ["service", "metric"], "bucket", "value")


def daily_matrix(spark: SparkSession, sf: str) -> DataFrame:
    values = series.bucketed(views.metrics(spark, sf), ["service"], "ts", "value", 6 * 3600, "mean")
    return values.withColumn("case_id", F.lit("all"))


@query("mlg_09_impact_graph")
def mlg_09(spark: SparkSession, sf: str) -> DataFrame:
    return graph.impact_graph(daily_matrix(spark, sf), "case_id", frontend="svc0")


@query("mlg_11_random_walk")
def mlg_11(spark: SparkSession, sf: str) -> DataFrame:
    rows = daily_matrix(spark, sf)
    front = rows.where("service = 'svc0'").select("case_id", "bucket", F.col("value").alias("y"))
    corr = joins.correlation(rows.join(front, ["case_id", "bucket"]), ["case_id", "service"], "value", "y")
    return graph.random_walk(graph.impact_graph(rows, "case_id", frontend="svc0"), corr, "case_id", "svc0")


# --- mining and clustering ---------------------------------------------------------

@query("mlg_12_templates")
def mlg_12(spark: SparkSession, sf: str) -> DataFrame:
    return drain.templates(views.table(spark, sf, "events").select(F.expr(parsing.LINE).alias("message")))


def service_scores(spark: SparkSession, sf: str) -> DataFrame:
    return views.metrics(spark, sf).groupBy("metric", "service").agg(F.round(F.avg("value"), 6).alias("score"))


#: Complete linkage on a line in SQL: each step merges the adjacent runs of least diameter, while it is within the deviation.
LINKS = ", a as (select metric, service, round(avg(value),6) score from m group by all), st as (select metric, list([score] order by score desc) runs, any_value(cut) cut, 0 step from (select distinct metric, score from a) join (select metric, stddev_pop(score) cut from a group by metric) using (metric) group by metric union all select metric, list_concat(list_concat(runs[1:k-1], [list_concat(runs[k], runs[k+1])]), runs[k+2:]), cut, step+1 from (select *, list_position(sp, list_min(sp)) k from (select *, list_transform(range(1, len(runs)), lambda i: runs[i][1]-runs[i+1][len(runs[i+1])]) sp from st where len(runs)>1)) where list_min(sp)<=cut and cut>0), fin as (select metric, arg_max(runs, step) runs from st group by metric), cl as (select metric, runs, unnest(range(1, len(runs)+1)) c from fin), sc as (select metric, c as cluster, unnest(runs[c]) score from cl), lk as (select a.metric, a.service, a.score, cast(sc.cluster as bigint) as cluster from a join sc on a.metric=sc.metric and a.score=sc.score)"


@query("mlg_14_score_clusters", LINKS + " select metric, service, score, cluster from lk", "m", recursive=True)
def mlg_14(spark: SparkSession, sf: str) -> DataFrame:
    return stats.score_clusters(service_scores(spark, sf), "metric", "service", "score")


@query("agg_12_cluster_ranks", LINKS + ", g as (select metric, cluster, round(avg(score),6) mean_score, max(score) max_score, count(*) events from lk group by all) select metric, cluster, mean_score, max_score, cast(events as bigint) events, cast(row_number() over (partition by metric order by mean_score desc, max_score desc, events desc, cluster) as bigint) as rank from g", "m", recursive=True)
def agg_12(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats.score_clusters(service_scores(spark, sf), "metric", "service", "score")
    table = rows.groupBy("metric", "cluster").agg(r6(F.avg("score"), "mean_score"), F.max("score").alias("max_score"), F.count("*").alias("events"))
    return ranking.ranked(table, ["metric"], F.desc("mean_score"), F.desc("max_score"), F.desc("events"), F.asc("cluster"))


@query("agg_13_services_by_cluster", LINKS + ", g as (select service, min(cluster) first_cluster, round(sum(score),6) weight from lk group by service) select *, cast(row_number() over (order by first_cluster, weight desc, service) as bigint) as rank from g", "m", recursive=True)
def agg_13(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats.score_clusters(service_scores(spark, sf), "metric", "service", "score")
    first = rows.groupBy("service").agg(F.min("cluster").alias("first_cluster"), r6(F.sum("score"), "weight"))
    return ranking.ranked(first, [], F.asc("first_cluster"), F.desc("weight"), F.asc("service"))


SCORES = ", q as (select item, round(coalesce(rf/nullif(rf+rp,0),0),9) tarantula, " + ", ".join(f"round({m},9) {m}" for m in stats.MEASURES[1:]) + " from z), lq as (unpivot q on " + ", ".join(stats.MEASURES) + " into name measure value score), rq as (select item, rank() over (partition by measure order by score desc)+(count(*) over (partition by measure, score)-1)/2.0 r, count(*) over (partition by measure) n from lq)"


@query("win_02_consensus", COVER + MEASURES + SCORES + " select item, round(avg(case when n<=1 then 1.0 else 1-(r-1)/(n-1) end),6) consensus from rq group by item", "mr")
def win_02_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return stats.consensus(stats.spectrum(coverage(spark, sf), views.runs(spark), "item"), "item").select("item", r6("consensus"))


@query("agg_19_votes", PATHS + ", k as (select trace_id, service, duration_us, row_number() over (partition by trace_id order by duration_us desc, span_id) n from s), d as (select trace_id, service, min(n) n from k group by all), e as (select *, row_number() over (partition by trace_id order by n) r from d) select service, round(sum(case when r=1 then 1.0 when r<=6 then 0.5 else 0 end),6) votes, cast(count(*) filter (r=1) as bigint) chosen from e group by service", "s")
def agg_19(spark: SparkSession, sf: str) -> DataFrame:
    ranks = ranking.ranked(views.spans(spark, sf), ["trace_id"], F.desc("duration_us"), F.asc("span_id"))
    best = ranking.ranked(ranks.groupBy("trace_id", "service").agg(F.min("rank").alias("n")), ["trace_id"], F.asc("n"))
    vote = F.when(F.col("rank") == 1, 1.0).when(F.col("rank") <= 6, 0.5).otherwise(0.0)
    return best.groupBy("service").agg(r6(F.sum(vote), "votes"), F.count_if(F.col("rank") == 1).alias("chosen"))


@query("agg_20_pair_candidates", ", n as (select service, metric, round(avg(value),9) v from m where extract(day from d)%2=0 group by all), f as (select service, metric, round(avg(value),9) v from m where extract(day from d)%2=1 group by all), a as (select service, sum(v) s, count(*) c from (select *, row_number() over (partition by service order by v desc, metric) k from n) where k<=3 group by service), b as (select service, sum(v) s, count(*) c from (select *, row_number() over (partition by service order by v desc, metric) k from f) where k<=3 group by service) select coalesce(a.service,b.service) as service, round(coalesce(a.s,0),6) expected_score, round(coalesce(b.s,0),6) actual_score, round(coalesce(a.s,0)+coalesce(b.s,0)+case when a.s is not null and b.s is not null then 1 else 0 end,6) combined_score from a full join b on a.service=b.service", "m")
def agg_20(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).withColumn("fault", fails())

    def side(condition, name: str) -> DataFrame:
        table = rows.where(condition).groupBy("service", "metric").agg(F.round(F.avg("value"), 9).alias("v"))
        return ranking.top(table, ["service"], 3, F.desc("v"), F.asc("metric")).groupBy("service").agg(F.sum("v").alias(name))

    both = side(~F.col("fault"), "e").join(side(F.col("fault"), "a"), "service", "full_outer")
    bonus = F.when(F.col("e").isNotNull() & F.col("a").isNotNull(), 1.0).otherwise(0.0)
    e, a = F.coalesce("e", F.lit(0.0)), F.coalesce("a", F.lit(0.0))
    return both.select("service", r6(e, "expected_score"), r6(a, "actual_score"), r6(e + a + bonus, "combined_score"))


@query("top_03_fill_from_paths", PATHS + ", l as (select trace_id, arg_max(path_key, span_id) path_key from p group by trace_id) select trace_id, array_to_string(list_slice(list_distinct_ordered, 1, 5), '>') as filled from (select trace_id, list_filter(list_concat(['svc'], list_reverse(split(path_key,'>'))), lambda x, i: list_position(list_concat(['svc'], list_reverse(split(path_key,'>'))), x) = i) as list_distinct_ordered from l)", "s")
def top_03(spark: SparkSession, sf: str) -> DataFrame:
    last = paths(spark, sf).groupBy("trace_id").agg(F.max_by("path", "span_id").alias("path")).withColumn("ranked", F.array(F.lit("svc")))
    return ranking.fill_from_paths(last, "ranked", "path").select("trace_id", F.array_join("filled", ">").alias("filled"))


@query("top_03_fill_ranked", PATHS + ", l as (select trace_id, arg_max(path_key, span_id) path_key from p group by trace_id), k as (select trace_id, service, max(duration_us) v from s group by all), q as (select *, row_number() over (partition by trace_id order by v desc, service) r from k), t as (select trace_id, list(service order by r) ranked from q where r<=2 group by trace_id), u as (select l.trace_id, list_concat(ranked, list_reverse(split(path_key,'>'))) every from l join t on l.trace_id=t.trace_id) select trace_id, array_to_string(list_filter(every, lambda x, i: list_position(every, x)=i)[1:5], '>') filled from u", "s")
def top_03_ranked(spark: SparkSession, sf: str) -> DataFrame:
    """The two services of the longest spans, then the ancestors of the trace's last span."""
    last = paths(spark, sf).groupBy("trace_id").agg(F.max_by("path", "span_id").alias("path"))
    best = ranking.top(views.spans(spark, sf).groupBy("trace_id", "service").agg(F.max("duration_us").alias("v")), ["trace_id"], 2, F.desc("v"), F.asc("service"))
    first = best.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rank", "service")))["service"].alias("ranked"))
    return ranking.fill_from_paths(last.join(first, "trace_id"), "ranked", "path").select("trace_id", F.array_join("filled", ">").alias("filled"))


@query("top_04_trace_candidates", ", k as (select trace_id, service, max(duration_us) v from s group by all), q as (select *, row_number() over (partition by trace_id order by v desc, service) r from k) select trace_id, string_agg(service, ',' order by r) services from q where r<=6 group by trace_id", "s")
def top_04(spark: SparkSession, sf: str) -> DataFrame:
    table = views.spans(spark, sf).groupBy("trace_id", "service").agg(F.max("duration_us").alias("v"))
    best = ranking.top(table, ["trace_id"], 6, F.desc("v"), F.asc("service"))
    return best.groupBy("trace_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "service")))["service"], ",").alias("services"))


@query("orc_01_hour_windows", "select strftime(t,'%Y-%m-%d %H') as hour, epoch_us(t)//1000000 as s from (select unnest(generate_series(timestamp '2024-01-01', timestamp '2024-01-02 23:00:00', interval 1 hour)) t)")
def orc_01(spark: SparkSession, sf: str) -> DataFrame:
    hours = spark.range(1).select(F.explode(F.expr("sequence(timestamp'2024-01-01', timestamp'2024-01-02 23:00:00', interval 1 hour)")).alias("t"))
    return hours.select(F.date_format("t", "yyyy-MM-dd HH").alias("hour"), F.unix_timestamp("t").alias("s"))


@query("src_08_hour_pruning", ", h as (select distinct epoch_us(date_trunc('hour',ts))//3600000000 as k from m), w as (select distinct unnest(range(epoch_us(ws)//3600000000, epoch_us(we)//3600000000+1)) as k from r where label='fail') select cast(count(*) as bigint) n from m where epoch_us(ts)//3600000000 in (select k from w)", "mr")
def src_08(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import files

    rows = views.metrics(spark, sf).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").alias("hour"))
    return files.pruned(rows, views.runs(spark).where("label = 'fail'")).agg(F.count("*").alias("n"))


@query("src_09_file_ranges", "select cast(count(*) as bigint) n, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us from events")
def src_09(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources import files

    ranges = files.file_ranges(views.table(spark, sf, "events"))
    return ranges.agg(F.sum("n").alias("n"), F.unix_micros(F.min("first_ts").cast("timestamp")).alias("first_us"), F.unix_micros(F.max("last_ts").cast("timestamp")).alias("last_us"))
