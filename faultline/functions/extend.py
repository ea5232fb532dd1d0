"""What a user may add: SQL functions, aggregates of metric classes, queries.

``plans.registry.query`` registers a query with its SQL; pandas functions and table
functions are registered with Spark itself (``spark.udf``, ``spark.udtf``).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession, functions as F

#: Aggregates by name, for metrics of a class; users add theirs.
METRIC_CLASSES: dict[str, Callable[[str], Column]] = {"sum": F.sum, "mean": F.avg, "peak": F.max, "median": F.median}


def sql_function(spark: SparkSession, name: str, arguments: str, returns: str, body: str) -> None:
    """A temporary function of SQL text, which the optimizer inlines: no Python runs for it."""
    if not re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", name):
        raise ValueError(f"{name} is no function name")
    spark.sql(f"create or replace temporary function {name}({arguments}) returns {returns} return {body}")


def metric_class(name: str, aggregate: Callable[[str], Column]) -> None:
    METRIC_CLASSES[name] = aggregate
