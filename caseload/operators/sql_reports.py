"""Ad-hoc SQL over registered tables and the canned questions.

The canned texts read the view ``tickets`` (canonical ticket columns); bounds are named parameters.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

_RANGE = """
  AND (:start_date IS NULL OR create_ts_utc >= CAST(:start_date AS TIMESTAMP_NTZ))
  AND (:end_date IS NULL OR create_ts_utc <= CAST(:end_date AS TIMESTAMP_NTZ))
"""

# The canned mean counts hours and minutes and leaves the seconds out.
RESPONSE_TIME = f"""
SELECT 'Time to first agent email reply (HH:mm:ss)' AS metric,
       count(*) AS ticket_count,
       avg(CASE WHEN reply_hms LIKE '%:%'
                THEN try_cast(split_part(reply_hms, ':', 1) AS DOUBLE)
                   + try_cast(split_part(reply_hms, ':', 2) AS DOUBLE) / 60 END) AS avg_hours
FROM tickets
WHERE reply_hms IS NOT NULL AND reply_hms <> '' {_RANGE}
"""

TOP_AGENTS = f"""
SELECT ticket_owner, count(*) AS ticket_count,
       CAST(count(*) * 100 AS DOUBLE) / sum(count(*)) OVER () AS percentage
FROM tickets
WHERE ticket_owner IS NOT NULL AND ticket_owner <> '' {_RANGE}
GROUP BY ticket_owner
ORDER BY ticket_count DESC, ticket_owner
LIMIT 10
"""

MONTHLY_VOLUME = """
SELECT trunc(CAST(create_ts_utc AS DATE), 'month') AS month, count(*) AS ticket_count
FROM tickets
WHERE create_ts_utc IS NOT NULL
GROUP BY 1
ORDER BY month DESC
LIMIT 12
"""

TOTAL = f"SELECT count(*) AS total_records FROM tickets WHERE true {_RANGE}"


def _bounds(start: dt.date | None, end: dt.date | None) -> dict[str, str | None]:
    text = lambda d: None if d is None else d.isoformat()
    return {"start_date": text(start), "end_date": text(end)}


def q_response_time(spark: SparkSession, start=None, end=None) -> DataFrame:
    """R1."""
    return spark.sql(RESPONSE_TIME, args=_bounds(start, end))


def q_top_agents(spark: SparkSession, start=None, end=None) -> DataFrame:
    """R2."""
    return spark.sql(TOP_AGENTS, args=_bounds(start, end))


def q_monthly_volume(spark: SparkSession) -> DataFrame:
    """R3."""
    return spark.sql(MONTHLY_VOLUME)


def q_total(spark: SparkSession, start=None, end=None) -> DataFrame:
    """R4."""
    return spark.sql(TOTAL, args=_bounds(start, end))


def sql(spark: SparkSession, text: str, **params) -> DataFrame:
    """User SQL over the registered views with named parameters."""
    return spark.sql(text, args=params or None)
