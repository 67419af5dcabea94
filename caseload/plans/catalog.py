"""Registry of runnable queries over the derived tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from caseload.plans.oracle_views import with_views
from caseload.session import require_utc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6
# Moves exact ties such as 0.0000005 off the edge, so that the last bit of a sum decides nothing.
NUDGE = "2.3e-10"


def comparable(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, fractions as double rounded to six digits, no negative zero."""
    out = []
    for f in df.schema.fields:
        col = f"`{f.name}`"
        if isinstance(f.dataType, T.IntegralType):
            col = f"CAST({col} AS BIGINT)"
        elif isinstance(f.dataType, (T.FractionalType, T.DecimalType)):
            col = f"round(CAST({col} AS DOUBLE) + {NUDGE}D, {DIGITS}) + 0D"
        out.append(f"{col} AS `{f.name}`")
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(spark, sf_dir)``. ``doubles`` names the columns of ``sql`` that are rounded."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            require_utc(spark)
            return comparable(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            text = with_views(sql)
            if doubles:
                cut = ", ".join(
                    f"round(CAST({c} AS DOUBLE) + {NUDGE}::DOUBLE, {DIGITS}) + 0.0::DOUBLE AS {c}" for c in doubles.split())
                text = f"SELECT * REPLACE ({cut}) FROM ({text}) AS t"
            ORACLES[name] = text
        return fn

    return wrap


def same_rows(name: str, of: str):
    """Register another way to the rows of a query, checked by the same SQL."""

    def wrap(fn):
        query(name)(fn)
        ORACLES[name] = ORACLES[of]
        return fn

    return wrap


def load() -> None:
    """Import every module that registers queries."""
    from caseload.plans import (  # noqa: F401
        agent_queries, chat_queries, filter_queries, join_queries, log_queries, metric_queries,
        normalise_queries, rollup_queries, source_queries, sql_queries, sync_queries, ticket_queries, widget_queries,
    )
