"""Paged scans of log and trace services, as Spark data sources.

A scan is cut into slices of time, one partition each, so executors page in parallel and
a lost one repeats its slices only.  ``answer`` names how a page is fetched: a url that
answers in the services' JSON.
"""

from __future__ import annotations

import json
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Slice of a log scan, rows of a page, narrowest window of a trace scan, traces of an answer, tries of a request.
SLICE_NS, PAGE, LEAST_US, TRACES, TRIES = 300 * 10**9, 5000, 10**6, 1500, 3

LogPage = Callable[[int, int, int], list[tuple[int, dict[str, str], str]]]
TracePage = Callable[[int, int, int], list[dict]]


def slices(start: int, end: int, width: int) -> list[tuple[int, int]]:
    """Closed windows that cover [start, end]."""
    return [(a, min(end, a + width - 1)) for a in range(start, end + 1, width)]


def logs_of(fetch: LogPage, start: int, end: int, page: int = PAGE) -> Iterator[tuple[int, dict[str, str], str]]:
    """All rows of a closed window: a full page is followed by one from its last time on, and rows that both hold come once.

    A time with more rows than a page cannot be paged further; it is asked for alone with
    a doubled limit until all its rows are there.
    """
    at, seen = start, set()

    def new(rows: list[tuple[int, dict[str, str], str]]) -> Iterator[tuple[int, dict[str, str], str]]:
        for row in rows:
            key = (row[0], tuple(sorted(row[1].items())), row[2])
            if key not in seen:
                seen.add(key)
                yield row

    while at <= end:
        rows = fetch(at, end, page)
        yield from new(rows)
        if len(rows) < page:
            return
        last = max(r[0] for r in rows)
        if last == at:  # the page holds one time only
            limit = page
            while len(rows) >= limit:
                limit *= 2
                rows = fetch(at, at, limit)
            yield from new(rows)
            last += 1
        seen = {k for k in seen if k[0] >= last}
        at = last


def traces_of(fetch: TracePage, start: int, end: int, limit: int = TRACES, least: int = LEAST_US) -> Iterator[dict]:
    """All traces of a closed window: an answer that reaches the limit is asked for again in halves, down to the narrowest window."""
    found = fetch(start, end, limit)
    if len(found) < limit or end - start <= least:
        yield from found
        return
    middle = (start + end) // 2
    yield from traces_of(fetch, start, middle, limit, least)
    yield from traces_of(fetch, middle + 1, end, limit, least)


def get_json(url: str, tries: int = TRIES, timeout: float = 30) -> dict:
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:  # noqa: S310
                return json.load(answer)
        except OSError:
            if k + 1 == tries:
                raise
    return {}


class Window(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Window]:
        o = self.options
        return [Window(a, b) for a, b in slices(int(o["start"]), int(o["end"]), int(o.get("slice", SLICE_NS)))]

    def read(self, window: Window) -> Iterator[tuple]:
        o = self.options

        def fetch(start: int, end: int, limit: int) -> list[tuple[int, dict[str, str], str]]:
            asked = urllib.parse.urlencode({"query": o.get("query", "{}"), "start": start, "end": end, "limit": limit, "direction": "forward"})
            answer = get_json(f"{o['url']}/loki/api/v1/query_range?{asked}")
            streams = answer.get("data", {}).get("result", []) if answer.get("status") == "success" else []
            return [(int(t), s.get("stream", {}), line) for s in streams for t, line in s.get("values", [])]

        for t, labels, line in logs_of(fetch, window.start, window.end, int(o.get("page", PAGE))):
            yield t, labels.get("node_name", ""), labels.get("pod", ""), labels.get("container", ""), line


class Logs(DataSource):
    """spark.read.format("paged_logs"): url, start, end (ns), query, slice (ns), page."""

    @classmethod
    def name(cls) -> str:
        return "paged_logs"

    def schema(self) -> str:
        return "ts_ns long, node string, pod string, container string, log string"

    def reader(self, schema) -> LogReader:  # noqa: ARG002
        return LogReader(dict(self.options))


class TraceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[Window]:
        o = self.options
        return [Window(a, b) for a, b in slices(int(o["start"]), int(o["end"]), int(o.get("slice", 300 * 10**6)))]

    def read(self, window: Window) -> Iterator[tuple]:
        o = self.options

        def fetch(start: int, end: int, limit: int) -> list[dict]:
            asked = urllib.parse.urlencode({"service": o.get("service", ""), "start": start, "end": end, "limit": limit})
            return get_json(f"{o['url']}/api/traces?{asked}").get("data") or []

        for trace in traces_of(fetch, window.start, window.end, int(o.get("limit", TRACES)), int(o.get("least", LEAST_US))):
            yield (json.dumps({"data": [trace]}),)


class Traces(DataSource):
    """spark.read.format("split_traces"): url, service, start, end (us), slice, limit, least (us).  One JSON answer a trace, for files.spans_of()."""

    @classmethod
    def name(cls) -> str:
        return "split_traces"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> TraceReader:  # noqa: ARG002
        return TraceReader(dict(self.options))


def register(spark: SparkSession) -> None:
    for source in (Logs, Traces):
        spark.dataSource.register(source)
