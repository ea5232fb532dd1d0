"""Queries of the string, label and log expressions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import text
from ..sources import views
from .registry import query

#: Made-up pods, lines and addresses, as SQL that both engines read.
POD = "concat('carts', case event_id % 5 when 0 then '-5b77c45b65-24589' when 1 then '-db-0' when 2 then '-5b77c45-ks75w' when 3 then '' else concat('-', cast(event_id as varchar(20))) end)"
LINE = "concat(case event_id % 8 when 0 then 'ts=1 level=warn msg=' when 1 then 'a ERROR b : failed ' when 2 then 'x WARN y : retry ' when 3 then 'lvl:E timeout ' when 4 then 'plain connection ' when 5 then 'severity=bogus queue ' when 6 then 'c INFO d : e : done ' else 'trace_id=ab12cd span-id: \"ff\" ok ' end, event_type, ' ', cast(user_id as varchar(20)))"
ADDRESS = "case event_id % 6 when 0 then concat('http://', event_type, ':80/x/y') when 1 then concat(event_type, '.ns.svc.cluster.local:9') when 2 then '  ' when 3 then concat('tcp://', event_type) when 4 then concat(event_type, '/a:b') else event_type end"
DURATION = "concat(cast(event_id % 97 as varchar(20)), case event_id % 5 when 0 then 'ms' when 1 then 's' when 2 then 'M' when 3 then 'h' else 'x' end)"
JSON_LINE = "case event_id % 3 when 0 then concat('{\"msg\":\"', event_type, '\",\"level\":\"W\",\"traceId\":\"', cast(user_id as varchar(20)), '\"}') when 1 then concat('a : b : ', event_type) else event_type end"


def events(spark: SparkSession, sf: str) -> DataFrame:
    return views.table(spark, sf, "events")


def counted(df: DataFrame, *columns) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def sql(body: str) -> str:
    return f"select {body}, cast(count(*) as bigint) n from events group by all"


@query("prj_02_service_of_pod", f"with x as (select {POD} p from events) select p as pod, case when regexp_matches(p,'^.+-[a-z0-9]{{5,}}-[a-z0-9]{{5}}$') then regexp_extract(p,'^(.+)-[a-z0-9]{{5,}}-[a-z0-9]{{5}}$',1) when regexp_matches(p,'^.+-[0-9]+$') then regexp_extract(p,'^(.+)-[0-9]+$',1) else p end as service, cast(count(*) as bigint) n from x group by all")
def prj_02(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf).withColumn("pod", F.expr(POD)), "pod", text.service_of_pod(F.col("pod")).alias("service"))


@query("prj_03_service_of_pod_digits_first", f"with x as (select {POD} p from events) select p as pod, case when regexp_matches(p,'^.+-[0-9]+$') then regexp_extract(p,'^(.+)-[0-9]+$',1) when regexp_matches(p,'^.+-[a-f0-9]{{8,}}-[a-z0-9]{{4,6}}$') then regexp_extract(p,'^(.+)-[a-f0-9]{{8,}}-[a-z0-9]{{4,6}}$',1) else p end as service, cast(count(*) as bigint) n from x group by all")
def prj_03(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf).withColumn("pod", F.expr(POD)), "pod", text.service_of_pod(F.col("pod"), digits_first=True).alias("service"))


@query("prj_04_service_name", f"with x as (select trim({ADDRESS}) a from events), y as (select a, split_part(split_part(regexp_replace(a,'^.*?://',''),'/',1),':',1) s from x) select a as address, nullif(split_part(s,'.svc.',1),'') as service, cast(count(*) as bigint) n from y group by all")
def prj_04(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf).withColumn("a", F.expr(ADDRESS)), F.trim("a").alias("address"), text.service_name(F.col("a")).alias("service"))


@query("prj_05_first_service", f"with x as (select trim({ADDRESS}) a, event_type from events), y as (select nullif(split_part(split_part(split_part(regexp_replace(a,'^.*?://',''),'/',1),':',1),'.svc.',1),'') s, event_type from x) select coalesce(s, event_type) as destination, cast(count(*) as bigint) n from y group by all")
def prj_05(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.first_service(F.expr(ADDRESS), F.col("event_type")).alias("destination"))


@query("prj_06_tags_map", sql("json_extract_string(props,'$.k') as k"))
def prj_06(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), F.try_element_at(text.tags_map(F.col("props")), F.lit("k")).alias("k"))


@query("prj_06_tags_list", "select concat(event_type,'!') as v, cast(count(*) as bigint) n from events group by all")
def prj_06_list(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.concat(F.lit('[{"key":"a","value":"'), "event_type", F.lit('"},{"key":"a","value":"'), "event_type", F.lit('!"},{"x":1}]'))
    return counted(events(spark, sf), F.try_element_at(text.tags_map(tags), F.lit("a")).alias("v"))


TAGS = "array<struct<key:string,value:string>>"


def tag_list() -> Column:
    return F.from_json(F.concat(F.lit('[{"key":"error.type","value":"'), "event_type", F.lit('"},{"key":"b","value":"1"},{"key":"exception.type","value":"'), F.col("user_id").cast("string"), F.lit('"}]')), TAGS)


@query("prj_07_first_tag", "select event_type as a, '1' as b, 'none' as c, cast(count(*) as bigint) n from events group by all")
def prj_07(spark: SparkSession, sf: str) -> DataFrame:
    t = events(spark, sf).withColumn("t", tag_list())
    return counted(t, text.first_tag(F.col("t"), "error.type").alias("a"), text.first_tag(F.col("t"), "b").alias("b"), text.first_tag(F.col("t"), "z", "none").alias("c"))


@query("prj_08_parent_span", "select case when event_id%3=0 then null else cast(user_id as varchar) end as parent, cast(count(*) as bigint) n from events group by all")
def prj_08(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "FOLLOWS_FROM").otherwise("CHILD_OF")
    refs = F.from_json(F.concat(F.lit('[{"refType":"FOLLOWS_FROM","spanID":"z"},{"refType":"'), kind, F.lit('","spanID":"'), F.col("user_id").cast("string"), F.lit('"}]')), "array<struct<refType:string,spanID:string>>")
    return counted(events(spark, sf), text.parent_span(refs).alias("parent"))


@query("prj_09_last_tag", "select cast(user_id as varchar) as exception_type, cast(count(*) as bigint) n from events group by all")
def prj_09(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.last_tag(tag_list(), "exception.type", "error.type").alias("exception_type"))


@query("prj_11_ids_in_line", f"with x as (select {LINE} l from events) select case when l like '%trace\\_id=%' escape '\\' then 'ab12cd' end as trace_id, case when l like '%span-id%' then 'ff' end as span_id, cast(count(*) as bigint) n from x group by all")
def prj_11(spark: SparkSession, sf: str) -> DataFrame:
    lines = events(spark, sf).withColumn("l", F.expr(LINE))
    return counted(lines, text.id_in_line(F.col("l"), "trace").alias("trace_id"), text.id_in_line(F.col("l"), "span").alias("span_id"))


LEVEL_CASE = " ".join(f"when '{k}' then '{v}'" for k, v in text.LEVELS.items())


@query("prj_12_log_level", f"with x as (select case event_id%7 when 0 then ' warning' when 1 then 'E' when 2 then 'err' when 3 then '' when 4 then 'Info ' when 5 then 'p' else 'zzz' end v from events) select v, case upper(trim(v)) {LEVEL_CASE} else 'UNKNOWN' end as level, cast(count(*) as bigint) n from x group by all")
def prj_12(spark: SparkSession, sf: str) -> DataFrame:
    v = F.expr("case event_id%7 when 0 then ' warning' when 1 then 'E' when 2 then 'err' when 3 then '' when 4 then 'Info ' when 5 then 'p' else 'zzz' end")
    return counted(events(spark, sf).withColumn("v", v), "v", text.log_level(F.col("v")).alias("level"))


NAMED = r"(?i)(?:^|[\s,])(?:level|lvl|severity)[:=]\"?(trace|debug|info|warn|warning|error|fatal|panic|[tdiwefp])\"?"


@query("prj_13_level_of_line", f"with x as (select {LINE} l from events), y as (select l, regexp_extract(l, '{NAMED}', 1) v from x) select case when v<>'' then (case upper(v) {LEVEL_CASE} else 'UNKNOWN' end) " + " ".join(f"when contains(upper(l),'{w}') then '{k}'" for k, w in text.LEVEL_WORDS) + " else 'UNKNOWN' end as level, cast(count(*) as bigint) n from y group by all")
def prj_13(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.level_of_line(F.expr(LINE)).alias("level"))


def kinds_sql(column: str, kinds, default: str) -> str:
    return "case " + " ".join(f"when regexp_matches(lower({column}),'{'|'.join(words)}') then '{kind}'" for kind, words in kinds) + f" else '{default}' end"


@query("prj_14_log_source", f"with x as (select case event_id%5 when 0 then 'Carts-DB' when 1 then 'rabbitmq' when 2 then 'istio-proxy' when 3 then 'session' else 'front' end c from events) select c, {kinds_sql('c', text.SOURCES, 'application')} as source, cast(count(*) as bigint) n from x group by all")
def prj_14(spark: SparkSession, sf: str) -> DataFrame:
    c = F.expr("case event_id%5 when 0 then 'Carts-DB' when 1 then 'rabbitmq' when 2 then 'istio-proxy' when 3 then 'session' else 'front' end")
    return counted(events(spark, sf).withColumn("c", c), "c", text.log_source(F.col("c")).alias("source"))


@query("prj_15_message_kind", f"with x as (select {LINE} l from events) select {kinds_sql('l', text.MESSAGE_KINDS, 'general_log')} as kind, cast(count(*) as bigint) n from x group by all")
def prj_15(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.message_kind(F.expr(LINE)).alias("kind"))


@query("prj_16_clean_message", f"with x as (select {JSON_LINE} l from events) select coalesce(case when left(l,1)='{{' then json_extract_string(l,'$.msg') end, split(l,' : ')[-1]) as message, cast(count(*) as bigint) n from x group by all")
def prj_16(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.clean_message(F.expr(JSON_LINE)).alias("message"))


@query("prj_17_log_parse", f"with x as (select {JSON_LINE} l, user_id from events), j as (select *, case when left(l,1)='{{' then l end as js from x) select coalesce(json_extract_string(js,'$.msg'), split(l,' : ')[-1]) as message, coalesce(nullif(json_extract_string(js,'$.traceId'),''), null) as trace_id, {kinds_sql('l', text.MESSAGE_KINDS, 'general_log')} as kind, cast(count(*) as bigint) n from j group by all")
def prj_17(spark: SparkSession, sf: str) -> DataFrame:
    line = F.expr(JSON_LINE)
    return counted(events(spark, sf), text.clean_message(line).alias("message"), text.id_in_line(line, "trace").alias("trace_id"), text.message_kind(line).alias("kind"))


@query("prj_19_masked_line", f"with x as (select concat({LINE}, ' traceId:ab12 id 0123456789abcdef at 2024-01-02T03:04:05.6Z v7y') l from events), a as (select regexp_replace(l,'(traceId:)[0-9a-fA-F]+','\\1<TRACE_ID>','g') l from x), b as (select regexp_replace(regexp_replace(l,'\\b[0-9a-fA-F]{{16,32}}\\b','<HEX_ID>','g'),'\\b\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?Z\\b','<TS>','g') l from a), c as (select regexp_replace(regexp_replace(l,'(^|[^A-Za-z0-9])\\d+($|[^A-Za-z0-9])','\\1<NUM>\\2','g'),'(^|[^A-Za-z0-9])\\d+($|[^A-Za-z0-9])','\\1<NUM>\\2','g') l from b) select l as masked, cast(count(*) as bigint) n from c group by all")
def prj_19(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.expr(LINE), F.lit(" traceId:ab12 id 0123456789abcdef at 2024-01-02T03:04:05.6Z v7y"))
    return counted(events(spark, sf), text.masked_line(line).alias("masked"))


@query("prj_20_operation_name", "with x as (select concat(upper(event_type),' /Api/', cast(user_id+10000 as varchar), '/0xDEADBEEF01') v from events) select concat(lower(split_part(v,' ',1)),'_api_num_hex') as dirty, concat(lower(split_part(v,' ',1)),'_api_num') as name, cast(count(*) as bigint) n from x group by all")
def prj_20(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat(F.upper("event_type"), F.lit(" /Api/"), (F.col("user_id") + 10000).cast("string"), F.lit("/0xDEADBEEF01"))
    return counted(events(spark, sf), F.concat(F.lower("event_type"), F.lit("_api_num_hex")).alias("dirty"), text.operation_name(v).alias("name"))


@query("prj_21_template_name", "select concat(event_type,'_from_ip_param_num_a_b_c_d_e_f_g') as name, cast(count(*) as bigint) n from events group by all")
def prj_21(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat("event_type", F.lit(" from 10.0.0.1 <*> "), F.col("user_id").cast("string"), F.lit(" a b c d e f g h i j"))
    return counted(events(spark, sf), text.template_name(v).alias("name"))


@query("prj_22_canonical_line", f"with x as (select {JSON_LINE} l, event_type from events) select case when left(l,1)='{{' then concat('msg=',json_extract_string(l,'$.msg'),' level=W') else l end as line, cast(count(*) as bigint) n from x group by all")
def prj_22(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.canonical_line(F.expr(JSON_LINE), F.col("event_type")).alias("line"))


@query("prj_23_template_weight", "with x as (select case event_id%3 when 0 then 'carts-db' when 1 then 'rabbitmq' else 'front' end s, case event_id%2 when 0 then 'Connection_accepted_from' else 'query_done' end t from events) select s, t, case when s<>'front' and t like 'Conn%' then 0.25 else 1.0 end::double as weight, cast(count(*) as bigint) n from x group by all")
def prj_23(spark: SparkSession, sf: str) -> DataFrame:
    s, t = F.expr("case event_id%3 when 0 then 'carts-db' when 1 then 'rabbitmq' else 'front' end"), F.expr("case event_id%2 when 0 then 'Connection_accepted_from' else 'query_done' end")
    rows = events(spark, sf).select(s.alias("s"), t.alias("t"))
    return counted(rows, "s", "t", text.template_weight(F.col("s"), F.col("t")).alias("weight"))


@query("prj_24_event_label", "with x as (select case event_id%4 when 0 then 'cpu_usage_pct' when 1 then 'latency_p99' when 2 then 'ready_ratio' else event_type end m from events) select m, case m when 'cpu_usage_pct' then 'CpuUsageRate' when 'latency_p99' then 'LatencyP99' when 'ready_ratio' then 'ReadyRatio' else m end as label, cast(count(*) as bigint) n from x group by all")
def prj_24(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select(F.expr("case event_id%4 when 0 then 'cpu_usage_pct' when 1 then 'latency_p99' when 2 then 'ready_ratio' else event_type end").alias("m"))
    return counted(rows, "m", text.metric_event_label(F.col("m")).alias("label"))


@query("prj_25_pattern_key", "select concat(event_type,'|||end') as key, event_type as first, 'end' as last, cast(count(*) as bigint) n from events group by all")
def prj_25(spark: SparkSession, sf: str) -> DataFrame:
    rows = events(spark, sf).select(text.pattern_key(F.array("event_type", F.lit("end"))).alias("key"))
    parts = text.pattern_labels(F.col("key"))
    return counted(rows, "key", F.get(parts, F.lit(0)).alias("first"), F.element_at(parts, -1).alias("last"))


@query("prj_26_timestamps", "select event_id, epoch_us(ts) as us, epoch_us(ts)//1000 as ms, strftime(ts,'%Y-%m-%d %H:%M:%S') as text from events")
def prj_26(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return events(spark, sf).select("event_id", F.unix_micros(at).alias("us"), F.unix_millis(at).alias("ms"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("text"))


@query("prj_27_seconds", f"with x as (select {DURATION} d, event_id%97 k, event_id%5 u from events) select d as duration, case when u=4 then -1 else greatest(1, cast(floor(k*(case u when 0 then 0.001 when 1 then 1 when 2 then 60 else 3600 end)) as bigint)) end as seconds, cast(count(*) as bigint) n from x group by all")
def prj_27(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf).withColumn("duration", F.expr(DURATION)), "duration", F.coalesce(text.seconds(F.col("duration")), F.lit(-1).cast("long")).alias("seconds"))


@query("prj_30_slug", "select concat(event_type,'-a-b-',cast(user_id as varchar)) as slug, cast(count(*) as bigint) n from events group by all")
def prj_30(spark: SparkSession, sf: str) -> DataFrame:
    return counted(events(spark, sf), text.slug(F.concat(F.lit("--"), F.initcap("event_type"), F.lit(" A/B  "), F.col("user_id").cast("string"), F.lit("!"))).alias("slug"))


@query("prj_31_number_or_null", "select case when event_id%3=0 then value end as number, cast(count(*) as bigint) n from events group by all")
def prj_31(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 3 == 0, F.col("value").cast("string")).when(F.col("event_id") % 3 == 1, "NaN").otherwise("n/a")
    return counted(events(spark, sf), text.number_or_null(raw).alias("number"))


@query("prj_32_log_schema", "select concat('[',role,'] ',left(text,20)) as log, cast(count(*) as bigint) n from conversations group by all")
def prj_32(spark: SparkSession, sf: str) -> DataFrame:
    return counted(views.log_lines(spark, sf), F.concat(F.lit("["), "service", F.lit("] "), F.left("message", F.lit(20))).alias("log"))


@query("prj_01_labels_json", "select concat('{\"a\":\"',event_type,'\",\"z\":\"',cast(user_id as varchar),'\"}') as labels, cast(count(*) as bigint) n from events group by all")
def prj_01(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.create_map(F.lit("z"), F.col("user_id").cast("string"), F.lit("pod"), F.lit("p"), F.lit("a"), F.col("event_type"), F.lit("__name__"), F.lit("up"))
    return counted(events(spark, sf), text.labels_json(labels).alias("labels"))


@query("prj_28_service_of_experiment", "with k as (select unnest(['carts','carts-db','front-end','orders']) s), x as (select distinct concat('net-delay-', case user_id%3 when 0 then 'carts-db' when 1 then 'front-end' else 'none' end, '-00', cast(user_id%10 as varchar)) e from events) select e as exp_id, arg_max(s, length(s)) as service from x left join k on contains(e, s) group by e")
def prj_28(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("carts",), ("carts-db",), ("front-end",), ("orders",)], "s string")
    ids = events(spark, sf).select(F.expr("concat('net-delay-', case user_id%3 when 0 then 'carts-db' when 1 then 'front-end' else 'none' end, '-00', cast(user_id%10 as string))").alias("exp_id")).distinct()
    return ids.join(F.broadcast(known), F.contains("exp_id", "s"), "left").groupBy("exp_id").agg(F.max_by("s", F.length("s")).alias("service"))
