"""String, label and log expressions.  All are columns of columns; none needs Python on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Log level names and their aliases.
LEVELS = {"T": "TRACE", "TRACE": "TRACE", "D": "DEBUG", "DEBUG": "DEBUG", "I": "INFO", "INFO": "INFO", "W": "WARN", "WARN": "WARN", "WARNING": "WARN", "E": "ERROR", "ERR": "ERROR", "ERROR": "ERROR", "F": "FATAL", "FATAL": "FATAL", "P": "PANIC", "PANIC": "PANIC"}
#: Words that a level-less line is searched for, in this order.
LEVEL_WORDS = (("ERROR", " ERROR "), ("WARN", " WARN "), ("WARN", " WARNING "), ("DEBUG", " DEBUG "), ("INFO", " INFO "), ("FATAL", " FATAL "), ("PANIC", " PANIC "))
#: Patterns of a level's key and of an id's key (of a given name) in a line.
LEVEL_KEY = r'(?i)(?:^|[\s,])(?:level|lvl|severity)[:=]"?(trace|debug|info|warn|warning|error|fatal|panic|[tdiwefp])"?'
ID_KEY = r'(?i)\b{what}[_-]?id\b\s*[:=]\s*"?([a-f0-9]+)"?\b'
#: Patterns of pod names: of a stateful set, of a deployment, and of a deployment in the digits-first variant; of a host with a cluster suffix; of a duration.
STATEFUL_POD, DEPLOYED_POD, DEPLOYED_POD_DIGITS = r"^(.+)-[0-9]+$", r"^(.+)-[a-z0-9]{5,}-[a-z0-9]{5}$", r"^(.+)-[a-f0-9]{8,}-[a-z0-9]{4,6}$"
CLUSTER_HOST, DURATION = r"^(.*?)(?:\.svc\..*)?$", r"^([0-9.]+)(ms|s|m|h)$"
#: Kinds of container and of message, first match wins.
SOURCES = (("database", ("mongo", "db", "session")), ("middleware", ("rabbit",)), ("infrastructure", ("istio", "envoy")))
MESSAGE_KINDS = (
    ("exception_log", ("exception", "error", "failed", "panic")), ("timeout_log", ("timeout", "deadline", "slow", "latency")), ("retry_log", ("retry", "reconnecting", "backoff")),
    ("connection_log", ("connection", "connected", "disconnected")), ("queue_log", ("queue", "publish", "consume", "message")),
)
#: Masks of changing parts of a log line, in order.
LOG_MASKS = (
    (r"(traceId:)[0-9a-fA-F]+", "$1<TRACE_ID>"), (r"(spanId:)[0-9a-fA-F]+", "$1<SPAN_ID>"), (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"\b[0-9a-fA-F]{16,32}\b", "<HEX_ID>"), (r"\b\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?Z\b", "<TS>"), (r"(?<![A-Za-z])\d+(?![A-Za-z])", "<NUM>"),
)
#: Masks of operation names and of mined templates.
UUID = r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\b"
HEX = r"(?i)\b(?:0x)?[0-9a-f]{8,}\b"
OPERATION_MASKS = ((UUID, " uuid "), (HEX, " hex "), (r"(?i)(?<=[a-z_])[0-9a-f]{8,}(?=[a-z_]|$)", " hex "), (r"\b\d{4,}\b", " num "))
TEMPLATE_MASKS = ((UUID, " uuid "), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", " ip "), (HEX, " hex "), (r"\b\d+\b", " num "), (r"<\*>", " param "))
TEMPLATE_TOKENS = 12
#: Metric names and their event labels; services and templates that count as background.
EVENT_LABELS = {
    "cpu_usage_pct": "CpuUsageRate", "memory_usage_pct": "MemoryUsage", "network_rx": "NetworkReceive", "network_tx": "NetworkTransmit", "latency_p99": "LatencyP99",
    "request_rate": "RequestRate", "success_rate": "SuccessRate", "error_count": "ErrorCount", "restart_count": "RestartCount", "ready_ratio": "ReadyRatio",
}
STORE_HINTS = ("-db", "rabbitmq", "mongodb", "mysql", "postgres", "redis", "mq")
BACKGROUND_HINTS = ("connection accepted", "connection ended", "client metadata", "client disconnected", "heartbeat", "metadata", "accepted", "ended")
BACKGROUND_WEIGHT = 0.25
#: Keys of a structured log line that its canonical form lists.
LINE_KEYS = ("msg", "message", "level", "caller", "service", "operation", "ctx", "c")
LINE_ATTRIBUTES = ("remote", "collection", "command", "commandName", "error", "connectionId", "connectionCount")


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def service_of_pod(pod: Column, digits_first: bool = False) -> Column:
    """Service of a pod name.  Default: a deployment's name with two generated parts, else a set's number; digits_first asks in the other order, with a stricter form of the parts."""
    numbered = F.regexp_extract(pod, STATEFUL_POD, 1)
    deployed = F.regexp_extract(pod, DEPLOYED_POD_DIGITS if digits_first else DEPLOYED_POD, 1)
    order = (numbered, deployed) if digits_first else (deployed, numbered)
    return F.coalesce(*(none_if_empty(c) for c in order), pod)


def service_name(raw: Column) -> Column:
    """Plain service of an address: no scheme, path, port or cluster suffix; null if empty."""
    after_scheme = F.regexp_replace(F.trim(raw), r"^.*?://", "")
    return none_if_empty(F.regexp_extract(F.split_part(F.split_part(after_scheme, F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1)), CLUSTER_HOST, 1))


def first_service(*candidates: Column) -> Column:
    """First candidate that names a service."""
    return F.coalesce(*(service_name(c) for c in candidates))


def log_level(level: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.upper(F.trim(level))), F.lit("UNKNOWN"))


def level_of_line(line: Column) -> Column:
    """Level named by a key, else by the first of the level words."""
    named = none_if_empty(F.regexp_extract(line, LEVEL_KEY, 1))
    upper, words = F.upper(line), F.lit(None).cast("string")
    for level, word in reversed(LEVEL_WORDS):
        words = F.when(F.contains(upper, F.lit(word)), level).otherwise(words)
    return F.when(named.isNotNull(), log_level(named)).otherwise(F.coalesce(words, F.lit("UNKNOWN")))


def by_words(text: Column, kinds: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """First kind of which the lower-cased text contains a word."""
    out = F.lit(default)
    for kind, words in reversed(kinds):
        out = F.when(F.lower(text).rlike("|".join(words)), kind).otherwise(out)
    return out


def log_source(container: Column) -> Column:
    return by_words(container, SOURCES, "application")


def message_kind(message: Column) -> Column:
    return by_words(message, MESSAGE_KINDS, "general_log")


def clean_message(line: Column) -> Column:
    """A JSON line's msg, else what follows the last ' : '."""
    return F.coalesce(F.get_json_object(line, "$.msg"), F.element_at(F.split(line, " : "), -1))


def id_in_line(line: Column, what: str) -> Column:
    """Hexadecimal trace or span id: a JSON field in one of three spellings, else a key in the text."""
    fields = [F.get_json_object(line, f"$.{k}") for k in (f"{what}_id", f"{what}Id", f"{what}id")]
    return F.coalesce(*(none_if_empty(f) for f in fields), none_if_empty(F.regexp_extract(line, ID_KEY.replace("{what}", what), 1)))


def masked(text: Column, masks: Sequence[tuple[str, str]]) -> Column:
    for pattern, mark in masks:
        text = F.regexp_replace(text, pattern, mark)
    return text


def masked_line(line: Column) -> Column:
    return masked(line, LOG_MASKS)


def operation_name(value: Column) -> Column:
    """Lower-case name with ids masked, marks joined by single underscores."""
    text = F.regexp_replace(masked(F.lower(F.trim(value)), OPERATION_MASKS), "[^a-zA-Z0-9]+", "_")
    text = F.regexp_replace(text, "_(hex|uuid|num)(?:_(?:hex|uuid|num))+", "_$1")
    return F.coalesce(none_if_empty(F.trim(text, F.lit("_"))), F.lit("unknown"))


def template_name(template: Column) -> Column:
    """First words of a template, ids masked."""
    text = masked(F.lower(F.trim(F.coalesce(template, F.lit("")))), TEMPLATE_MASKS)
    words = F.filter(F.split(F.regexp_replace(text, "[^a-z0-9]+", " "), " "), lambda w: w != "")
    return F.coalesce(none_if_empty(F.array_join(F.slice(words, 1, TEMPLATE_TOKENS), "_")), F.lit("unknown"))


def canonical_line(raw: Column, message: Column) -> Column:
    """key=value list of a structured line, else the raw line, else the message."""
    fields = [(k, f"$.{k}") for k in LINE_KEYS] + [(k, f"$.attr.{k}") for k in LINE_ATTRIBUTES]
    listed = F.concat_ws(" ", *(F.concat(F.lit(f"{k}="), none_if_empty(F.get_json_object(raw, path))) for k, path in fields))
    is_object = F.get_json_object(raw, "$").startswith("{")
    plain = F.when(is_object, none_if_empty(listed)).otherwise(none_if_empty(F.trim(raw)))
    return F.coalesce(plain, F.trim(F.coalesce(message, F.lit(""))))


def is_store(service: Column) -> Column:
    return F.coalesce(F.lower(F.trim(service)).rlike("|".join(STORE_HINTS)), F.lit(False))


def template_weight(service: Column, template: Column) -> Column:
    """Background chatter of stores weighs little."""
    quiet = F.lower(F.replace(template, F.lit("_"), F.lit(" "))).rlike("|".join(BACKGROUND_HINTS))
    return F.when(is_store(service) & F.coalesce(quiet, F.lit(False)), BACKGROUND_WEIGHT).otherwise(1.0)


def log_event_label(kind: Column, level: Column, template: Column) -> Column:
    parts = [F.nullif(operation_name(kind), F.lit("unknown")), F.nullif(operation_name(level), F.lit("unknown")), F.nullif(template_name(template), F.lit("unknown"))]
    return F.concat(F.lit("log_"), F.concat_ws("_", *parts))


def metric_event_label(metric: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in EVENT_LABELS.items() for x in pair))
    return F.coalesce(F.try_element_at(names, metric), metric)


def labels_json(labels: Column, keys: Sequence[str] | None = None, without: Sequence[str] = ("__name__", "pod")) -> Column:
    """The chosen labels of a map, or all but some, as JSON with sorted keys."""
    chosen = F.map_filter(labels, lambda k, v: k.isin(*keys)) if keys is not None else F.map_filter(labels, lambda k, v: ~k.isin(*without))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(chosen))))


def tags_map(text: Column) -> Column:
    """Tags given as a JSON object or as a list of {key, value}; the last of equal keys counts; empty for anything else."""
    as_object = F.from_json(text, "map<string,string>")
    as_list = F.filter(F.from_json(text, "array<struct<key:string,value:string>>"), lambda t: t["key"].isNotNull())
    last = F.filter(as_list, lambda t, i: ~F.exists(F.slice(as_list, i + 2, F.size(as_list)), lambda u: u["key"] == t["key"]))
    listed = F.map_from_entries(F.transform(last, lambda t: F.struct(t["key"], t["value"])))
    return F.coalesce(F.when(F.ltrim(text).startswith("["), listed).otherwise(as_object), F.create_map().cast("map<string,string>"))


def first_tag(tags: Column, key: str, default: str = "") -> Column:
    return F.coalesce(F.get(F.filter(tags, lambda t: t["key"] == key), F.lit(0))["value"], F.lit(default))


def last_tag(tags: Column, *keys: str) -> Column:
    found = F.filter(tags, lambda t: t["key"].isin(*keys))
    return F.get(found, F.size(found) - 1)["value"]


def parent_span(references: Column) -> Column:
    return F.get(F.filter(references, lambda r: r["refType"] == "CHILD_OF"), F.lit(0))["spanID"]


def seconds(duration: Column) -> Column:
    """'250ms', '30s', '12m' or '2h' in whole seconds, one at least; null for other text."""
    number = F.regexp_extract(F.lower(F.trim(duration)), DURATION, 1).try_cast("double")
    unit = F.regexp_extract(F.lower(F.trim(duration)), DURATION, 2)
    factor = F.when(unit == "ms", 0.001).when(unit == "s", 1.0).when(unit == "m", 60.0).when(unit == "h", 3600.0)
    return F.greatest(F.lit(1).cast("long"), F.floor(number * factor)) + F.lit(0) * factor.cast("long")


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def number_or_null(text: Column) -> Column:
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def pattern_key(labels: Column) -> Column:
    return F.array_join(labels, "|||")


def pattern_labels(key: Column) -> Column:
    return F.filter(F.split(key, r"\|\|\|"), lambda x: x != "")
