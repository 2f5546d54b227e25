"""Register of queries. One column spec types the Spark result and the SQL result alike.

A spec lists output columns: ``name`` text, ``name:i`` bigint, ``name:f`` double rounded to
six places (adding 0.0 drops negative zero), ``name:b`` boolean.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.checks.sql_views import compose
from fieldmark.checks.views import Views, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple((c + ":s").split(":")[:2]) for c in spec.split()]


def typed(df: DataFrame, spec: str) -> DataFrame:
    kinds = {
        "s": lambda c: c.cast("string"),
        "i": lambda c: c.cast("bigint"),
        "f": lambda c: F.round(c.cast("double"), 6) + F.lit(0.0),
        "b": lambda c: c.cast("boolean"),
    }
    return df.select(*[kinds[k](F.col(n)).alias(n) for n, k in _columns(spec)])


def typed_sql(body: str, spec: str) -> str:
    kinds = {
        "s": "CAST({0} AS VARCHAR)",
        "i": "CAST({0} AS BIGINT)",
        "f": "ROUND(CAST({0} AS DOUBLE), 6) + 0.0",
        "b": "CAST({0} AS BOOLEAN)",
    }
    cols = ", ".join(kinds[k].format(f'"{n}"') + f' AS "{n}"' for n, k in _columns(spec))
    return compose(f"SELECT {cols} FROM ({body}) AS result")


def query(name: str, spec: str, sql: str | None = None):
    """Register a function of the views; ``sql`` may use any view of ``fieldmark.checks.sql_views``."""

    def wrap(fn: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: typed(fn(views(spark, sf_dir)), spec)
        if sql is not None:
            ORACLES[name] = typed_sql(sql, spec)
        return fn

    return wrap
