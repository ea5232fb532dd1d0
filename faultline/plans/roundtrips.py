"""Queries of sources and sinks: whole tables are written in a source's format, read back by its reader, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import extend
from ..operators import driver, graph, joins, promql, ranking
from ..sources import files, sinks, views
from .registry import query
from .telemetry import fails, r6


def written(rows: DataFrame, name: str, by: str | None = None) -> str:
    """Folder with the column ``value`` of rows as lines of text."""
    path = sinks.scratch(rows.sparkSession, name)
    (rows.write.partitionBy(by) if by else rows.write).text(path)
    return path


def answers(rows: DataFrame, labels: Column, group: str) -> DataFrame:
    """Range answers in JSON, one for each group."""
    point = F.array(F.format_string("%d.%06d", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long"), F.unix_micros(F.col("ts").cast("timestamp")) % 1_000_000), F.col("value").cast("string"))
    series = rows.groupBy(group, labels.alias("metric")).agg(F.collect_list(point).alias("values"))
    result = series.groupBy(group).agg(F.collect_list(F.struct("metric", "values")).alias("result"))
    return result.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct("result").alias("data"))).alias("value"))


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """All events as saved range answers (one is a failure), read back."""
    rows = views.metrics(spark, sf)
    labels = F.to_json(F.struct(F.col("metric").alias("__name__"), "pod", F.when(F.col("metric") == "error", F.col("service")).alias("destination_service"), F.concat(F.lit("node"), (F.col("user_id") % 3).cast("string")).alias("instance")))
    text = answers(rows, labels, "pod").withColumn("value", F.regexp_replace(F.replace(F.replace("value", F.lit('\\"'), F.lit('"')), F.lit('"{'), F.lit("{")), r'\}"', "}"))
    failed = spark.createDataFrame([('{"status":"error","data":{"result":[{"metric":{"pod":"lost"},"values":[[1,"1"]]}]}}',)], "value string")
    return files.prometheus_json(spark, written(text.unionByName(failed), "prometheus"), lines=True)


@query("src_01_range_scan", "select pod, metric, cast(count(*) as bigint) n, round(sum(value),4) total, epoch_us(min(ts)) first_us from m group by pod, metric", "m")
def src_01(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select(F.col("labels")["pod"].alias("pod"), F.col("labels")["__name__"].alias("metric"), "value", "ts")
    return rows.groupBy("pod", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.unix_micros(F.min("ts")).alias("first_us"))


@query("src_02_instant_pods", "select distinct pod from m where pod not like 'svc1-%'", "m")
def src_02(spark: SparkSession, sf: str) -> DataFrame:
    return files.pods(samples(spark, sf), without=("svc1-",))


@query("src_03_layers", ", l as (select unnest(['container','application','kpi','middleware','node','network','service_proxy']) as layer), x as (select layer, case when layer='node' then concat('node', cast(user_id%3 as varchar)) when layer='network' then case when metric='error' then service end else pod end as entity, metric from m, l) select layer, entity, metric, cast(count(*) as bigint) n from x where entity is not null group by all", "m")
def src_03(spark: SparkSession, sf: str) -> DataFrame:
    rows = sinks.stored(samples(spark, sf), "samples")
    out = None
    for layer in files.LAYERS:
        one = files.flattened(rows, layer).groupBy("entity", "metric").agg(F.count("*").alias("n")).select(F.lit(layer).alias("layer"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("src_04_log_answers", "select cast(user_id%3 as varchar) node, concat('pod', cast(user_id as varchar)) pod, '' as container, cast(count(*) as bigint) n, min(epoch_us(ts)*1000) first_ns from events group by all")
def src_04(spark: SparkSession, sf: str) -> DataFrame:
    """Two slices that share all rows of odd events, as a page cursor gives them."""
    events = views.table(spark, sf, "events")
    point = F.array((F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("string"), F.concat(F.lit("event "), F.col("event_id").cast("string")))
    rows = events.select(F.struct((F.col("user_id") % 3).cast("string").alias("node_name"), F.concat(F.lit("pod"), F.col("user_id").cast("string")).alias("pod")).alias("stream"), point.alias("p"), F.explode(F.when(F.col("event_id") % 2 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("slice"))
    streams = rows.groupBy("slice", "stream").agg(F.collect_list("p").alias("values")).groupBy("slice", (F.xxhash64("stream") % 8).alias("h")).agg(F.collect_list(F.struct("stream", "values")).alias("result"))
    text = streams.select(F.to_json(F.struct(F.lit("success").alias("status"), F.struct("result").alias("data"))).alias("value"))
    got = files.loki_json(spark, written(text, "loki"), lines=True)
    return got.groupBy("node", "pod", "container").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"))


def trace_answers(spark: SparkSession, sf: str) -> DataFrame:
    """All spans as JSON answers, a line for each trace; tags name kind, status and pod."""
    spans = views.spans(spark, sf)
    tags = F.array(F.struct(F.lit("span.kind").alias("key"), F.lit("string").alias("type"), F.when(F.col("span_id") % 2 == 0, "server").otherwise("client").alias("value")), F.struct(F.lit("http.status_code").alias("key"), F.lit("int64").alias("type"), (200 + F.col("span_id") % 3 * 100).cast("string").alias("value")), F.struct(F.lit("span.kind").alias("key"), F.lit("string").alias("type"), F.lit("second").alias("value")))
    references = F.when(F.col("parent_span_id").isNull(), F.array().cast("array<struct<refType:string,traceID:string,spanID:string>>")).otherwise(F.array(F.struct(F.lit("FOLLOWS_FROM").alias("refType"), F.col("trace_id").alias("traceID"), F.lit("x").alias("spanID")), F.struct(F.lit("CHILD_OF").alias("refType"), F.col("trace_id").alias("traceID"), F.col("parent_span_id").cast("string").alias("spanID"))))
    span = F.struct(F.col("span_id").cast("string").alias("spanID"), F.col("service").alias("processID"), F.concat(F.lit("GET /"), "service").alias("operationName"), F.col("start_us").alias("startTime"), F.col("duration_us").alias("duration"), references.alias("references"), tags.alias("tags"))
    grouped = spans.groupBy("trace_id").agg(F.collect_list(span).alias("spans"), F.collect_set("service").alias("names"))
    processes = F.map_from_entries(F.transform("names", lambda x: F.struct(x.alias("k"), F.struct(F.upper(x).alias("serviceName")).alias("v"))))
    trace = F.struct(F.col("trace_id").alias("traceID"), processes.alias("processes"), F.col("spans"))
    return grouped.select(F.to_json(F.struct(F.array(trace).alias("data"))).alias("value"))


@query("src_05_trace_answers", "select upper(service) service, cast(count(*) as bigint) n, cast(count(distinct trace_id) as bigint) traces, cast(sum(duration_us) as bigint) total from s group by service", "s")
def src_05(spark: SparkSession, sf: str) -> DataFrame:
    """Answers of overlapping windows: every trace comes twice, its spans once."""
    text = trace_answers(spark, sf)
    rows = files.spans_of(text.unionByName(text))
    return rows.groupBy("service").agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("traces"), F.sum("duration").alias("total"))


@query("src_06_span_rows", "select trace_id, cast(span_id as varchar) span_id, upper(service) service, concat('GET /', service) operation, start_us as start_time, duration_us as duration, cast(case when parent_span_id is null then 0 else 2 end as integer) n_references from s", "s")
def src_06(spark: SparkSession, sf: str) -> DataFrame:
    rows = files.jaeger_json(spark, written(trace_answers(spark, sf), "jaeger"), lines=True)
    return rows.select("trace_id", "span_id", "service", "operation", "start_time", "duration", F.size("references").alias("n_references"))


@query("prj_18_span_parse", "select trace_id, cast(span_id as varchar) span_id, coalesce(cast(parent_span_id as varchar),'') parent_span_id, start_us as timestamp, case when span_id%2=0 then 'server' else 'client' end span_kind, cast(200+span_id%3*100 as varchar) status_code, 'SUCCESS' as status, '' as pod from s", "s")
def prj_18(spark: SparkSession, sf: str) -> DataFrame:
    return files.parsed_spans(files.spans_of(trace_answers(spark, sf))).select("trace_id", "span_id", "parent_span_id", "timestamp", "span_kind", "status_code", "status", "pod")


@query("src_07_csv_scan", "select pod, metric, cast(count(*) as bigint) n, round(sum(v),4) total from (select pod, metric, date_trunc('second', ts) t, min(value) v from m where event_id%5<>0 group by all) x group by pod, metric", "m")
def src_07(spark: SparkSession, sf: str) -> DataFrame:
    """Metric files with text that does not parse and with repeated samples."""
    rows = views.metrics(spark, sf)
    least = rows.withColumn("timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).groupBy("timestamp", "pod", "metric", (F.col("event_id") % 5 == 0).alias("bad")).agg(F.min("value").alias("value"), F.min("event_id").alias("event_id"))
    path = sinks.scratch(spark, "csv")
    text = least.withColumn("value", F.when(F.col("bad"), F.when(F.col("event_id") % 2 == 0, "NaN").otherwise("x")).otherwise(F.col("value").cast("string")))
    sinks.write_csv(text.unionByName(text).withColumn("labels", F.lit(None).cast("string")), path, ["timestamp", "pod", "metric", "value", "labels"])
    return files.metrics_csv(spark, path).groupBy("pod", "metric").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("src_09_ranges_by_file", "select epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us, cast(count(*) as bigint) n from events group by cast(ts as date)")
def src_09_files(spark: SparkSession, sf: str) -> DataFrame:
    """One file a day, and its range."""
    path = sinks.scratch(spark, "days")
    events = views.table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    events.repartition("day").write.partitionBy("day").parquet(path)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return files.file_ranges(spark.read.parquet(path)).select(micros("first_ts").alias("first_us"), micros("last_ts").alias("last_us"), "n")


@query("src_08_partition_pruning", ", h as (select distinct unnest(range(epoch_us(ws)//3600000000, epoch_us(we)//3600000000+1)) as k from r where label='fail') select strftime(ts,'%Y-%m-%d') as day, cast(extract(hour from ts) as integer) as hour, cast(count(*) as bigint) n from m where epoch_us(ts)//3600000000 in (select k from h) group by all", "mr")
def src_08_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Hour-partitioned files, of which the windows' hours are read."""
    path = sinks.scratch(spark, "hours")
    sinks.write_hours(views.metrics(spark, sf).select("event_id", "ts"), path)
    rows = spark.read.schema("event_id long, ts timestamp_ntz, day string, hour int").parquet(path)
    return files.pruned(rows, views.runs(spark).where("label = 'fail'")).groupBy("day", "hour").agg(F.count("*").alias("n"))


@query("src_10_runs", "select concat('run_id=', run_id) run_id, label, epoch_us(case when label='fail' then ws else ws - interval 1 hour + interval 5 minute end) start_us, case when label='fail' then concat('svc', run_id) end gt_service from r", "r")
def src_10(spark: SparkSession, sf: str) -> DataFrame:
    start = F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    inject = F.when(F.col("label") == "fail", F.struct(start.alias("inject_start"), F.concat(F.lit("svc"), "run_id").alias("service"), F.lit("  ").alias("pod")))
    body = F.struct(F.date_format(F.col("window_start") - F.expr("interval 1 hour"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("workload_start_time"), F.date_format("window_end", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("workload_end_time"), inject.alias("injection_info"))
    path = written(views.runs(spark).select(F.to_json(body).alias("value"), "run_id"), "runs", "run_id")
    return files.runs_json(spark, path, lines=True).select("run_id", "label", F.unix_micros("window_start").alias("start_us"), "gt_service")


@query("src_11_plan", "select distinct concat('exp', cast(user_id % 50 as varchar)) exp_id from events where event_type in ('click', 'error')")
def src_11(spark: SparkSession, sf: str) -> DataFrame:
    task = F.when(F.col("event_type").isin("click", "error"), " Fault").otherwise("normal")
    body = F.struct(task.alias("task"), F.concat(F.lit("exp"), (F.col("user_id") % 50).cast("string")).alias("exp_id"), F.lit(60).alias("interval_seconds"))
    return files.plan_json(spark, written(views.table(spark, sf, "events").select(F.to_json(body).alias("value")), "plan"), lines=True).select("exp_id")


@query("src_12_inventory", "select distinct event_type as metric from events")
def src_12(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch(spark, "inventory")
    sinks.write_csv(views.table(spark, sf, "events").select(F.concat(F.lit(" "), "event_type").alias("metric_name")), path, ["metric_name"])
    return files.inventory_csv(spark, path)


@query("src_13_fault_specs", "select 'NetworkChaos' as kind, concat('delay-', lower(replace(n_name,' ','-'))) as name, concat('region', cast(n_regionkey as varchar)) as namespace, concat(cast(n_nationkey as varchar),'ms') as latency, concat('a',cast(n_nationkey as varchar),',b') as pods from nation")
def src_13(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit("# a fault\nkind: NetworkChaos\nmetadata:\n  name: 'delay-"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.lit("'\n  namespace: region"), F.col("n_regionkey").cast("string"), F.lit("\nspec:\n  delay:\n    latency: "), number, F.lit("ms  # late\n  selector:\n    pods:\n    - a"), number, F.lit("\n    - b\n"))
    path = written(views.table(spark, sf, "nation").select(body.alias("value"), "n_nationkey"), "yaml", "n_nationkey")
    params = F.col("params")
    return files.fault_specs(spark, path).select("kind", "name", "namespace", F.try_element_at(params, F.lit("delay.latency")).alias("latency"), F.try_element_at(params, F.lit("selector.pods")).alias("pods"))


@query("src_14_topology", "select r_name as src, n_name as dst from region left join nation on r_regionkey=n_regionkey")
def src_14(spark: SparkSession, sf: str) -> DataFrame:
    nations = views.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("depends_on"))
    services = views.table(spark, sf, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.struct(F.col("r_name").alias("name"), "depends_on").alias("s"))
    return files.topology_json(spark, written(services.agg(F.to_json(F.struct(F.collect_list("s").alias("services"))).alias("value")), "topology"), lines=True)


@query("src_15_load_stats", "select name, method, num_requests, round(avg_response_time,6) avg_response_time, failed from (select event_type as name, 'GET' as method, cast(count(*) as bigint) num_requests, avg(value) avg_response_time, false as failed from events group by event_type union all select null, null, null, null, true) x")
def src_15(spark: SparkSession, sf: str) -> DataFrame:
    stats_ = views.table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("num_requests"), F.avg("value").alias("avg_response_time")).withColumn("method", F.lit("GET"))
    text = stats_.agg(F.to_json(F.struct(F.collect_list(F.struct("name", "method", "num_requests", "avg_response_time")).alias("stats"))).alias("value"))
    broken = spark.createDataFrame([("{not json",)], "value string")
    return files.locust_json(spark, written(text.unionByName(broken), "locust"), lines=True).select("name", "method", "num_requests", r6("avg_response_time"), "failed")


@query("src_16_experiments", "select concat('engine', cast(user_id as varchar)) engine, cast(count(*) as bigint) n, cast(count(*) filter (event_type<>'error') as bigint) passed from events group by user_id")
def src_16(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("event_type") == "error", "Fail").otherwise("Pass")
    status = F.struct(F.struct(F.struct(verdict.alias("verdict"), F.lit("Completed").alias("phase")).alias("experimentStatus")).alias("status"))
    node = F.struct(F.lit("ChaosEngine").alias("type"), F.concat(F.lit("engine"), F.col("user_id").cast("string")).alias("name"), F.lit("Succeeded").alias("phase"), F.struct(F.lit("e").alias("engineName"), status.alias("chaosResult")).alias("chaosData"))
    other = F.struct(F.lit("Pod").alias("type"), F.lit("x").alias("name"))
    manifests = views.table(spark, sf, "events").select(F.to_json(F.struct(F.struct(other.alias("a"), node.alias("b")).alias("nodes"))).alias("execution_data"))
    return files.litmus_results(manifests).groupBy("engine").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "Pass").alias("passed"))


@query("prj_10_tolerant_json", "select event_id, cast(case when event_id%4=0 then 2 else 0 end as integer) n from events")
def prj_10(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("event_id") % 4 == 0, "[1, 2]").when(F.col("event_id") % 4 == 1, "[1, ").when(F.col("event_id") % 4 == 2, "")
    return views.table(spark, sf, "events").select("event_id", F.size(files.tolerant_list(text, "int")).alias("n"))


@query("prj_29_fault_metadata", "select event_id, concat('{\"fault_id\":\"f', cast(event_id as varchar), '\",\"injection_info\":{\"fault_type\":\"delay\",\"service\":\"', concat('svc', cast(user_id%14 as varchar)), '\"', case when event_id%3=0 then concat(',\"pod\":\"p', cast(event_id as varchar), '\"') else '' end, '}', case when event_id%2=0 then ',\"parameters\":{\"mode\":\"one\"}' else '' end, '}') metadata from events")
def prj_29(spark: SparkSession, sf: str) -> DataFrame:
    """The service stands at the top in odd events, inside injection_info in the others; some pods are blank."""
    service, odd = F.concat(F.lit("svc"), (F.col("user_id") % 14).cast("string")), F.col("event_id") % 2 == 1
    pod = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" p"), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "  ")
    info = F.struct(pod.alias("pod"), F.when(~odd, service).alias("service"), F.lit("delay").alias("fault_type"), F.when(~odd, "one").alias("mode"))
    raw = F.to_json(F.struct(F.when(odd, service).alias("target_service"), info.alias("injection_info"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("fault_id")))
    return views.table(spark, sf, "events").select("event_id", files.normalized_fault(raw).alias("metadata"))


# --- sinks -------------------------------------------------------------------------

@query("snk_01_csv", "select service, cast(count(*) as bigint) n, round(sum(value),4) total from m group by service", "m")
def snk_01(spark: SparkSession, sf: str) -> DataFrame:
    """Written and read with a fixed header; a part without rows has the header too."""
    path, columns = sinks.scratch(spark, "snk"), ["service", "value"]
    rows = views.metrics(spark, sf)
    sinks.write_csv(rows, f"{path}/all", columns)
    sinks.write_csv(rows.where("value is null"), f"{path}/none", columns)
    back = spark.read.option("header", True).schema("service string, value double").csv([f"{path}/all", f"{path}/none"])
    return back.groupBy("service").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("snk_02_hours", "select strftime(ts,'%Y-%m-%d') as day, cast(extract(hour from ts) as integer) as hour, cast(count(*) as bigint) n from events group by all")
def snk_02(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of odd days are written twice; rewriting leaves the others and doubles nothing."""
    path, rows = sinks.scratch(spark, "snk"), views.table(spark, sf, "events").select("event_id", "ts")
    sinks.write_hours(rows, path)
    sinks.write_hours(rows.where(F.dayofmonth("ts") % 2 == 1), path)
    return spark.read.schema("event_id long, ts timestamp_ntz, day string, hour int").parquet(path).groupBy("day", "hour").agg(F.count("*").alias("n"))


@query("snk_03_cases", ", x as (select strftime(d,'%Y-%m-%d') as day, service, metric, value from m) select day, service as exp_id, to_json(list_sort(list_distinct(list(metric)))) as metrics, round(max(value),6) top from x group by day, service", "m")
def snk_03(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch(spark, "snk")
    cases = views.metrics(spark, sf).groupBy(F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("service").alias("exp_id")).agg(F.array_sort(F.collect_set("metric")).alias("metrics"), r6(F.max("value"), "top"))
    sinks.write_cases(cases, path)
    return spark.read.schema("exp_id string, metrics string, top double, day string").parquet(path).select("day", "exp_id", "metrics", "top")


@query("snk_04_graph", "select strftime(d,'%Y-%m-%d') as day, service as src, metric as dst, round(avg(value),6) weight from m group by all", "m")
def snk_04(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch(spark, "snk")
    edges = views.metrics(spark, sf).groupBy(F.date_format("d", "yyyy-MM-dd").alias("day"), F.col("service").alias("src"), F.col("metric").alias("dst")).agg(r6(F.avg("value"), "weight"))
    sinks.write_graph(edges, path, "day")
    return sinks.read_graph(spark, path, "src string, dst string, weight double, day string").select("day", "src", "dst", "weight")


@query("snk_05_reuse", "select service, cast(count(*) as bigint) n, cast(1 as bigint) made from m group by service", "m")
def snk_05(spark: SparkSession, sf: str) -> DataFrame:
    """The second call under the same context reads what the first one saved."""
    root, made = sinks.scratch(spark, "snk"), []

    def make() -> DataFrame:
        made.append(1)
        return views.metrics(spark, sf).groupBy("service").agg(F.count("*").alias("n"))

    sinks.reused(spark, root, make, sf=sf, step="count")
    return sinks.reused(spark, root, make, step="count", sf=sf).withColumn("made", F.lit(len(made)).cast("long"))


# --- operators that work on what sources deliver ------------------------------------

@query("pql_10_catalogue", ", q as (select 'set' || cast(user_id%2 as varchar) as s, pod from m group by all), p as (select s, string_agg(distinct pod, '|' order by pod) pods from q group by s), c as (select * from (values ('set0','cpu','rate(cpu{pod=~\"{pod_regex}\"}[5m])'),('set1','mem','mem{pod=~\"{pod_regex}\"}'),('set1','up','up')) t(s,name,expr)) select c.s as \"set\", c.name, replace(c.expr, '{pod_regex}', concat('^(?:', p.pods, ')$')) as query from c join p on c.s=p.s", "m")
def pql_10(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.scratch(spark, "catalogue")
    rows = [("set0", "cpu", 'rate(cpu{pod=~"{pod_regex}"}[5m])'), ("set1", "mem", 'mem{pod=~"{pod_regex}"}'), ("set1", "up", "up")]
    sinks.write_csv(spark.createDataFrame(rows, "set string, name string, expr string"), path, ["set", "name", "expr"])
    catalogue = spark.read.option("header", True).option("escape", '\\').schema("set string, name string, expr string").csv(path)
    pods = views.metrics(spark, sf).select(F.concat(F.lit("set"), (F.col("user_id") % 2).cast("string")).alias("set"), "pod").distinct()
    return promql.expanded(catalogue, pods)


@query("flt_07_thresholds", "select distinct concat(event_type, case when user_id%3=0 then '-delay-' when user_id%3=1 then '-delayed-' else '_LATENCY_' end, cast(user_id%5 as varchar)) as case_id, user_id%3<>1 as latency_like, case when user_id%3<>1 then 0.02 else 0.045 end threshold from events")
def flt_07(spark: SparkSession, sf: str) -> DataFrame:
    middle = F.when(F.col("user_id") % 3 == 0, "-delay-").when(F.col("user_id") % 3 == 1, "-delayed-").otherwise("_LATENCY_")
    cases = views.table(spark, sf, "events").select(F.concat("event_type", middle, (F.col("user_id") % 5).cast("string")).alias("case_id")).distinct()
    return cases.select("case_id", graph.latency_like(F.col("case_id")).alias("latency_like"), graph.birch_threshold(F.col("case_id"), 0.045, 0.02).alias("threshold"))


@query("mlg_10_impact_edges", ", k as (select distinct strftime(d,'%Y-%m-%d') as c, service a, metric b, (extract(day from d)+length(service))%2=0 as directed from m), e as (select c, b as effect, a as cause from k union select c, a, b from k where not directed) select c as case_id, effect, cause from e", "m")
def mlg_10(spark: SparkSession, sf: str) -> DataFrame:
    skeleton = views.metrics(spark, sf).select(F.date_format("d", "yyyy-MM-dd").alias("case_id"), F.col("service").alias("a"), F.col("metric").alias("b"), ((F.dayofmonth("d") + F.length("service")) % 2 == 0).alias("directed")).distinct()
    return graph.impact_edges(skeleton, "case_id")


@query("mlg_10_without_lone", ", n as (select distinct cast(d as varchar) as case_id, service as node from m), e as (select distinct cast(d as varchar) as case_id, service as effect, concat('svc', cast(user_id%7 as varchar)) as cause from m where metric='error') select * from n where node='svc0' or exists (select 1 from e where e.case_id=n.case_id and (e.effect=n.node or e.cause=n.node))", "m")
def mlg_10_lone(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).withColumn("case_id", F.date_format("d", "yyyy-MM-dd"))
    nodes = rows.select("case_id", F.col("service").alias("node")).distinct()
    edges = rows.where("metric = 'error'").select("case_id", F.col("service").alias("effect"), F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("cause")).distinct()
    return graph.without_lone(nodes, edges, "case_id", ["svc0"])


@query("mlg_08_localize")
def mlg_08(spark: SparkSession, sf: str) -> DataFrame:
    """Each day's calls between services and their hosts; a service is anomalous on odd days if its mean is above all days'."""
    rows = views.metrics(spark, sf).withColumns({"case_id": F.date_format("d", "yyyy-MM-dd"), "host": F.concat(F.lit("host"), (F.col("user_id") % 3).cast("string"))})
    means = rows.groupBy("service").agg(F.avg("value").alias("usual"))
    services = rows.groupBy("case_id", "d", F.col("service").alias("node")).agg(F.avg("value").alias("now")).join(joins.small(means.withColumnRenamed("service", "node")), "node")
    odd = services.select("case_id", "node", F.lit("service").alias("kind"), (fails() & (F.col("now") > F.col("usual"))).alias("anomalous"))
    nodes = odd.unionByName(rows.select("case_id", F.col("host").alias("node"), F.lit("host").alias("kind"), F.lit(False).alias("anomalous")).distinct())
    calls = rows.select("case_id", F.col("service").alias("src"), F.concat(F.lit("svc"), (F.col("user_id") % 7).cast("string")).alias("dst")).distinct()
    present = odd.select("case_id", F.col("node").alias("dst"))
    edges = calls.where("src <> dst").join(present, ["case_id", "dst"]).select("case_id", "src", "dst").unionByName(rows.select("case_id", F.col("service").alias("src"), F.col("host").alias("dst")).distinct())
    corr = rows.groupBy("case_id", F.col("service").alias("node"), F.col("host").alias("resource")).agg((F.avg("value") / F.max("value")).alias("corr"))
    own = rows.groupBy("case_id", F.col("service").alias("node"), F.col("metric").alias("resource")).agg((F.avg("value") / F.max("value")).alias("corr"))
    return graph.localize(edges, nodes, corr.unionByName(own), "case_id")


@query("orc_01_day_hours", "select strftime(x.d,'%Y-%m-%d') as day, cast(h as integer) as hour, epoch_us(cast(x.d as timestamp)+to_hours(cast(h as integer))) as start_us from (select distinct cast(ts as date) d from events) x, (select unnest([0, 5, 23]) h) y")
def orc_01_days(spark: SparkSession, sf: str) -> DataFrame:
    return driver.hour_windows(views.table(spark, sf, "events").select(F.to_date("ts").alias("d")).distinct(), "d", (0, 5, 23))


@query("orc_02_days", ", x as (select strftime(d,'%Y-%m-%d') as day, service, round(sum(value),4) score from m group by all) select day, service, score, cast(row_number() over (partition by day order by score desc, service) as bigint) as rank, 'ok' as status from x", "m")
def orc_02(spark: SparkSession, sf: str) -> DataFrame:
    rows = views.metrics(spark, sf).withColumn("day", F.date_format("d", "yyyy-MM-dd"))

    def method(part: DataFrame) -> DataFrame:
        scored = part.groupBy("day", "service").agg(F.round(F.sum("value"), 4).alias("score"))
        return ranking.ranked(scored, ["day"], F.desc("score"), F.asc("service"))

    return driver.by_day(rows, "day", method, "orc-02")[0].withColumn("status", F.lit("ok"))


@query("orc_05_extension", "select service, round(max(value)-min(value),6) spread, concat('<', service, '>') marked from m group by service", "m")
def orc_05(spark: SparkSession, sf: str) -> DataFrame:
    """A function and an aggregate that a user adds by SQL text."""
    extend.sql_function(spark, "marked", "x string", "string", "concat('<', x, '>')")
    extend.metric_class("spread", lambda value: F.max(value) - F.min(value))
    return views.metrics(spark, sf).groupBy("service").agg(r6(extend.METRIC_CLASSES["spread"]("value"), "spread")).withColumn("marked", F.expr("marked(service)"))

