"""Readers of telemetry and metadata files, all with fixed schemas and no inference.  lines: a file holds one JSON document a line."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

METRICS = "timestamp string, {entity} string, metric string, value string, labels string"
RUN_FIELDS = "fault_id string, injection_tool string, workload_start_time string, workload_end_time string, target_host string, users int, spawn_rate double, run_time string, injection_info struct<fault_type:string,inject_start:string,service:string,pod:string,duration:string,mode:string,action:string>"
PROMETHEUS = "status string, data struct<result:array<struct<metric:map<string,string>,values:array<array<string>>>>>"
LOKI = "status string, data struct<result:array<struct<stream:map<string,string>,values:array<array<string>>>>>"
SPAN = "struct<spanID:string,processID:string,operationName:string,startTime:bigint,duration:bigint,references:array<struct<refType:string,traceID:string,spanID:string>>,tags:array<struct<key:string,type:string,value:string>>,logs:string>"
JAEGER = f"data array<struct<traceID:string,processes:map<string,struct<serviceName:string>>,spans:array<{SPAN}>>>"
TOPOLOGY = "services array<struct<name:string,depends_on:array<string>>>"
PLAN = "task string, exp_id string, interval_seconds int, env map<string,string>"
LOCUST = "stats array<struct<name:string,method:string,num_requests:bigint,num_failures:bigint,avg_response_time:double,current_rps:double>>"
LITMUS = "nodes map<string,struct<type:string,name:string,phase:string,chaosData:struct<engineName:string,chaosResult:struct<status:struct<experimentStatus:struct<verdict:string,phase:string>>>>>>"


def metrics_csv(spark: SparkSession, path: str, entity: str = "pod") -> DataFrame:
    """Long metric files; times and values that do not parse are dropped, repeated samples (shared hour boundaries) kept once."""
    raw = spark.read.schema(METRICS.format(entity=entity)).option("header", True).option("mode", "PERMISSIVE").csv(path)
    value = F.col("value").try_cast("double")
    rows = raw.select(F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz").alias("ts"), entity, "metric", F.when(~F.isnan(value), value).alias("value"), F.from_json("labels", "map<string,string>").alias("labels"))
    return rows.dropna(subset=["ts", "value"]).dropDuplicates(["ts", entity, "metric"])


def hours(starts: Column, ends: Column) -> Column:
    """Hours that a closed window touches."""
    return F.sequence(F.date_trunc("hour", starts), F.date_trunc("hour", ends), F.expr("interval 1 hour"))


def pruned(rows: DataFrame, windows: DataFrame, start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Rows of the (day, hour) partitions that any window touches; the partition filter reaches the scan through the broadcast join."""
    touched = windows.select(F.explode(hours(F.col(start).cast("timestamp"), F.col(end).cast("timestamp"))).alias("h")).distinct()
    return rows.join(F.broadcast(touched.select(F.date_format("h", "yyyy-MM-dd").alias("day"), F.hour("h").alias("hour"))), ["day", "hour"], "left_semi")


def file_ranges(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """First and last time in each file."""
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def prometheus_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved range answers as (labels, ts, value); answers without success give no rows."""
    raw = spark.read.schema(PROMETHEUS).option("multiLine", not lines).json(path).where("status = 'success'")
    series = raw.select(F.explode("data.result").alias("r")).select(F.col("r.metric").alias("labels"), F.explode("r.values").alias("v"))
    return series.select("labels", F.timestamp_seconds(F.get("v", F.lit(0)).try_cast("double")).alias("ts"), F.get("v", F.lit(1)).try_cast("double").alias("value"))


#: Label that names the entity of each layer, in order of preference, and whether rows without it are dropped.
LAYERS = {
    "container": ("pod", "container_label_pod"), "application": ("pod", "exported_pod"), "kpi": ("pod",), "middleware": ("pod", "exported_pod"),
    "node": ("instance",), "network": ("service", "destination_service"), "service_proxy": ("pod", "destination_pod"),
}


def flattened(samples: DataFrame, layer: str) -> DataFrame:
    """Samples of one layer as (ts, entity, metric, value, labels); rows without an entity are dropped."""
    entity = F.coalesce(*(F.nullif(F.try_element_at("labels", F.lit(k)), F.lit("")) for k in LAYERS[layer]))
    return samples.select("ts", entity.alias("entity"), F.try_element_at("labels", F.lit("__name__")).alias("metric"), "value", "labels").where("entity is not null")


def pods(samples: DataFrame, without: Sequence[str] = ("prometheus", "grafana")) -> DataFrame:
    """Distinct pods of an instant answer, in order of first appearance, without the monitoring stack's own."""
    named = samples.select(F.try_element_at("labels", F.lit("pod")).alias("pod"), F.monotonically_increasing_id().alias("pos")).where("pod is not null")
    for prefix in without:
        named = named.where(~F.startswith("pod", F.lit(prefix)))
    return named.groupBy("pod").agg(F.min("pos").alias("pos")).orderBy("pos").select("pod")


def loki_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Saved log answers as (ts_ns, node, pod, container, log), equal rows once over all slices."""
    raw = spark.read.schema(LOKI).option("multiLine", not lines).json(path)
    rows = raw.select(F.explode("data.result").alias("r")).select("r.stream", F.explode("r.values").alias("v"))
    label = lambda k: F.coalesce(F.try_element_at("stream", F.lit(k)), F.lit("")).alias(k.removesuffix("_name"))
    return rows.select(F.get("v", F.lit(0)).try_cast("bigint").alias("ts_ns"), label("node_name"), label("pod"), label("container"), F.get("v", F.lit(1)).alias("log")).dropDuplicates()


def jaeger_json(spark: SparkSession, path: str, fallback: str = "", lines: bool = False) -> DataFrame:
    """Saved traces as span rows, each (trace, span) once."""
    return spans_of(spark.read.schema(JAEGER).option("multiLine", not lines).json(path), fallback)


def spans_of(answers: DataFrame, fallback: str = "") -> DataFrame:
    """Span rows of answers; a column ``value`` holds them as JSON text, else they are parsed already."""
    raw = answers.select(F.from_json("value", JAEGER).alias("v")).select("v.*") if answers.columns == ["value"] else answers
    rows = raw.select(F.explode("data").alias("t")).select("t.traceID", "t.processes", F.explode("t.spans").alias("s"))
    service = F.coalesce(F.try_element_at("processes", F.col("s.processID"))["serviceName"], F.lit(fallback))
    return rows.select(
        F.col("s.startTime").alias("start_time"), F.col("traceID").alias("trace_id"), F.col("s.spanID").alias("span_id"), service.alias("service"), F.col("s.operationName").alias("operation"),
        F.col("s.duration").alias("duration"), F.col("s.references").alias("references"), F.col("s.tags").alias("tags"), F.col("s.logs").alias("logs"),
    ).dropDuplicates(["trace_id", "span_id"])


#: Columns of a parsed span and the tags they come from, the first that is there; status is SUCCESS where no tag says otherwise (fixed values).
SPAN_TAGS = {
    "span_kind": ("span.kind",), "status_code": ("http.status_code", "status.code"), "status": ("otel.status_code", "status"), "peer_service": ("peer.service",), "http_method": ("http.method",),
    "http_url": ("http.url",), "exception_type": ("exception.type",), "exception_message": ("exception.message",), "pod": ("pod", "k8s.pod.name"), "container": ("container", "k8s.container.name"), "node": ("node", "k8s.node.name"),
}


def parsed_spans(rows: DataFrame) -> DataFrame:
    """The 19 columns of a span: parent, timing, tags by name (empty where absent) and all tags as JSON."""
    tags = F.map_from_entries(F.transform(F.array_distinct(F.transform("tags", lambda x: x["key"])), lambda k: F.struct(k.alias("key"), F.get(F.filter("tags", lambda x: x["key"] == k), F.lit(0))["value"].alias("value"))))
    child = F.get(F.filter("references", lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]
    tagged = rows.withColumn("_tags", F.coalesce(tags, F.create_map().cast("map<string,string>")))
    found = {c: F.coalesce(*(F.try_element_at("_tags", F.lit(k)) for k in keys), F.lit("SUCCESS" if c == "status" else "")) for c, keys in SPAN_TAGS.items()}
    return tagged.select(F.col("start_time").alias("timestamp"), "trace_id", "span_id", F.coalesce(child, F.lit("")).alias("parent_span_id"), "service", "operation", "duration", *(v.alias(c) for c, v in found.items()), F.to_json("_tags").alias("tags_json"))


def tolerant_list(value: Column, kind: str) -> Column:
    """A JSON list, empty where the text is null, empty or does not parse."""
    return F.coalesce(F.from_json(value, f"array<{kind}>", {"mode": "PERMISSIVE"}), F.array().cast(f"array<{kind}>"))


def normalized_fault(metadata: Column) -> Column:
    """Fault metadata as JSON in one shape: the target service inside injection_info, no blank pod, the leading keys in order."""
    top = F.from_json(metadata, "map<string,string>")
    info = F.coalesce(F.from_json(top["injection_info"], "map<string,string>"), F.create_map().cast("map<string,string>"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    service, pod = F.coalesce(F.nullif(F.try_element_at(info, F.lit("service")), F.lit("")), F.try_element_at(top, F.lit("target_service"))), blank(F.try_element_at(info, F.lit("pod")))
    first = F.struct(F.try_element_at(info, F.lit("fault_type")).alias("fault_type"), F.try_element_at(info, F.lit("inject_start")).alias("inject_start"), service.alias("service"), pod.alias("pod"))
    named = ("fault_type", "inject_start", "service", "pod")
    rest = F.map_filter(info, lambda k, v: ~k.isin(*named) & v.isNotNull())
    return F.to_json(F.struct(F.try_element_at(top, F.lit("fault_id")).alias("fault_id"), F.try_element_at(top, F.lit("injection_tool")).alias("injection_tool"), first.alias("injection_info"), F.when(F.size(rest) > 0, rest).alias("parameters")))


def runs_json(spark: SparkSession, path: str, before_minutes: int = 5, length_minutes: int = 5, lines: bool = False) -> DataFrame:
    """Run and fault metadata with the analysis window; the run id is the folder's name."""
    raw = spark.read.schema(RUN_FIELDS).option("multiLine", not lines).json(path)
    time = lambda c: F.try_to_timestamp(F.col(c)).cast("timestamp")
    inject, start, end = time("injection_info.inject_start"), time("workload_start_time"), time("workload_end_time")
    begin = F.coalesce(inject, start + F.make_interval(mins=F.lit(before_minutes)))
    stop = begin + F.make_interval(mins=F.lit(length_minutes))
    return raw.select(
        F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_id"), F.when(inject.isNull(), "pass").otherwise("fail").alias("label"), start.alias("workload_start"), end.alias("workload_end"), inject.alias("inject_start"),
        F.coalesce("injection_info.service", F.regexp_extract("injection_info.pod", r"^(.+?)(?:-[a-z0-9]{5,}-[a-z0-9]{5}|-[0-9]+)?$", 1)).alias("gt_service"), F.nullif(F.trim("injection_info.pod"), F.lit("")).alias("gt_pod"), F.col("injection_info.fault_type").alias("fault_type"),
        begin.alias("window_start"), F.when(stop > end, end).otherwise(stop).alias("window_end"),
    )


def plan_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Fault experiments of a batch plan, each once, in order."""
    raw = spark.read.schema(PLAN).option("multiLine", not lines).json(path).withColumn("pos", F.monotonically_increasing_id())
    return raw.where(F.lower(F.trim("task")) == "fault").groupBy("exp_id").agg(F.min("pos").alias("pos")).orderBy("pos")


def inventory_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric_name string").option("header", True).csv(path).select(F.trim("metric_name").alias("metric")).where("metric <> ''").distinct()


def topology_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = spark.read.schema(TOPOLOGY).option("multiLine", not lines).json(path).select(F.explode("services").alias("s"))
    return raw.select(F.col("s.name").alias("src"), F.explode_outer("s.depends_on").alias("dst"))


def locust_json(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = spark.read.schema(LOCUST + ", _corrupt_record string").option("multiLine", not lines).option("mode", "PERMISSIVE").json(path)
    return raw.select(F.explode_outer("stats").alias("s"), F.col("_corrupt_record").isNotNull().alias("failed")).select("s.*", "failed")


def litmus_results(manifests: DataFrame, column: str = "execution_data") -> DataFrame:
    """Engine, phase and verdict of saved experiment runs."""
    nodes = F.map_values(F.from_json(column, LITMUS)["nodes"])
    engine = F.get(F.filter(nodes, lambda n: n["type"] == "ChaosEngine"), F.lit(0))
    status = engine["chaosData"]["chaosResult"]["status"]["experimentStatus"]
    return manifests.select(*[c for c in manifests.columns if c != column], engine["name"].alias("engine"), engine["phase"].alias("phase"), status["verdict"].alias("verdict"))


def fault_specs(spark: SparkSession, path: str) -> DataFrame:
    """Kind, name, namespace and the flat parameters of fault specifications (YAML of nested maps with scalar leaves; list items join by commas)."""
    lines = spark.read.text(path, wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), "value")

    def parse(batches):
        for batch in batches:
            out = [flat_yaml(t or "") for t in batch.column("value").to_pylist()]
            get = lambda k: pa.array([o.get(k) for o in out], pa.string())
            params = pa.array([[(k.removeprefix("spec."), v) for k, v in o.items() if k.startswith("spec.")] for o in out], pa.map_(pa.string(), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column("file"), get("kind"), get("metadata.name"), get("metadata.namespace"), params], names=["file", "kind", "name", "namespace", "params"])

    return lines.mapInArrow(parse, "file string, kind string, name string, namespace string, params map<string,string>")


def flat_yaml(text: str) -> dict[str, str]:
    """Dotted paths of the scalar leaves of a small YAML document."""
    out: dict[str, str] = {}
    stack: list[tuple[int, str]] = []
    for line in text.splitlines():
        body = line.split(" #")[0].rstrip()
        if not body.strip() or body.lstrip().startswith(("#", "---")):
            continue
        indent = len(body) - len(body.lstrip())
        item = body.strip()
        is_item = item.startswith("- ")
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not is_item):
            stack.pop()
        key, colon, value = (item[2:] if is_item else item).partition(":")
        path = ".".join(k for _, k in stack)
        if is_item and not (colon and (value[:1] in ("", " "))):
            out[path] = ",".join(x for x in (out.get(path), item[2:].strip("'\" ")) if x)
        elif value.strip():
            out[".".join(x for x in (path, key.strip()) if x)] = value.strip().strip("'\"")
        else:
            stack.append((indent, key.strip()))
    return out
