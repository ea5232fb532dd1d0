"""Queries with their DuckDB SQL, side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions of the telemetry-shaped views.
VIEWS = {
    "m": "m as (select event_id, ts, cast(ts as date) as d, concat('svc', cast(user_id % 14 as varchar)) as service, concat('svc', cast(user_id % 14 as varchar), '-', cast(user_id % 3 as varchar)) as pod, event_type as metric, value, user_id, props from events)",
    "r": "r as (select strftime(date '2024-01-01' + cast(i as integer), '%Y-%m-%d') as run_id, date '2024-01-01' + cast(i as integer) as d, case when i % 2 = 0 then 'fail' else 'pass' end as label, cast(date '2024-01-01' + cast(i as integer) as timestamp) + interval 5 hour as ws, cast(date '2024-01-01' + cast(i as integer) as timestamp) + interval 10 hour as we from range(30) t(i))",
    "s": "s as (select trace_id, event_id as span_id, lag(event_id) over (partition by trace_id order by ts, event_id) as parent_span_id, event_type as service, epoch_us(ts) as start_us, cast(trunc(value * 1000) as bigint) as duration_us, strftime(ts, '%Y-%m-%d') as day from (select *, concat(cast(user_id as varchar), '-', strftime(ts, '%Y-%m-%d')) as trace_id from events))",
    "b": "bt as (select *, row_number() over (partition by trace_id order by start_us, span_id) rn from s), b as (select c.trace_id, c.span_id, case when c.rn % 11 = 0 then -c.span_id else p.span_id end as parent_span_id, c.service, c.start_us, c.duration_us, c.day from bt c left join bt p on c.trace_id = p.trace_id and p.rn = c.rn // 2)",
    "e": "e as (select cast(c.c_nationkey as bigint) as src, cast(p.s_nationkey as bigint) as dst, l.l_extendedprice as weight from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey join supplier p on l.l_suppkey = p.s_suppkey)",
}


def query(name: str, sql: str | None = None, views: str = "", recursive: bool = False) -> Callable[[Query], Query]:
    """Register a query; views: letters of the common table expressions that its SQL starts with."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            head = ", ".join(VIEWS[v] for v in views)
            ORACLES[name] = (f"with {'recursive ' if recursive else ''}{head}{',' if sql.startswith(',') else ''} {sql.removeprefix(',')}" if views else sql).strip()
        return f

    return add
