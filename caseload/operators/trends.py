"""Least-squares trend over the ordinal of already aggregated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_trend(
    df: DataFrame, order: str, values: dict[str, str], partition: list[str] | None = None,
    fallback: dict[str, str] | None = None,
) -> DataFrame:
    """Add a trend column for each ``value -> trend`` pair; ``fallback`` names a column to use when
    fewer than two rows have a value.

    x is the row ordinal, rows without a value do not take part in the fit but get a trend value.
    The input holds one row per day, week or quarter (and agent), so its size is bounded by the
    calendar and one sorted pass is enough.
    """
    part = f"PARTITION BY {', '.join(f'`{c}`' for c in partition)}" if partition else ""
    numbered = df.selectExpr("*", f"row_number() OVER ({part} ORDER BY `{order}`) - 1 AS _x")
    lines = [
        f"CASE WHEN count(`{value}`) OVER ({part}) > 1 THEN "
        f"regr_slope(CAST(`{value}` AS DOUBLE), _x) OVER ({part}) * _x "
        f"+ regr_intercept(CAST(`{value}` AS DOUBLE), _x) OVER ({part}) "
        f"ELSE {(fallback or {}).get(value, 'CAST(NULL AS DOUBLE)')} END AS `{trend}`"
        for value, trend in values.items()]
    return numbered.selectExpr(*[f"`{c}`" for c in df.columns], *lines)


def last_rows(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows in the given order, as a top-k and not a full sort."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)
