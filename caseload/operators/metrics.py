"""One-row metric extracts, the metrics log and data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseload import dims
from caseload.functions import times, values
from caseload.operators.distribution import summarize
from caseload.operators.ticket_reports import HOURS



def ticket_volume_metrics(df: DataFrame) -> DataFrame:
    """M1."""
    return df.agg(
        F.count("*").alias("total_records"), F.count("*").alias("total_tickets"),
        F.lit(0).cast("bigint").alias("total_chats"),
        F.count_if(F.col("is_weekend").eqNullSafe(False)).alias("weekday_records"),
        F.count_if(F.col("is_weekend").eqNullSafe(True)).alias("weekend_records"))


def response_metrics(df: DataFrame) -> DataFrame:
    """M2: figures of positive hours; weekend and weekday means of all hours present."""
    # Both parts start from the same counts, which one scan makes.
    counted = df.groupBy("is_weekend", F.col(HOURS).alias("h")).agg(F.count("*").alias("w"))
    stats = summarize(counted.select(F.when(F.col("h") > 0, F.col("h")).alias("v"), "w"), [], "v", weight="w")
    there = lambda flag: F.col("h").isNotNull() & F.col("is_weekend").eqNullSafe(flag)
    mean = lambda flag: (F.sum(F.when(there(flag), F.col("h") * F.col("w")))
                         / F.sum(F.when(there(flag), F.col("w"))))
    means = counted.agg(F.struct(mean(True).alias("weekend"), mean(False).alias("weekday")).alias("m")).scalar()
    stats = stats.withColumn("m", means)
    mean_of = lambda part: F.col(f"m.{part}")
    some = F.col("n") > 0
    return stats.select(
        values.rounded(F.col("mean"), 2).alias("avg_response_time_hours"),
        values.rounded(F.col("median"), 2).alias("median_response_time_hours"),
        values.rounded(F.col("min"), 3).alias("min_response_time_hours"),
        values.rounded(F.col("max"), 2).alias("max_response_time_hours"),
        F.when(some, values.rounded(mean_of("weekend"), 2)).alias("weekend_avg_response_hours"),
        F.when(some, values.rounded(mean_of("weekday"), 2)).alias("weekday_avg_response_hours"))


def agent_metrics(df: DataFrame, agents: list[str] = dims.REPORT_AGENTS) -> DataFrame:
    """M3: top volume, fastest median, number and list of team members by volume."""
    mine = df.where(F.col("case_owner").isin(agents))
    stats = summarize(mine.select("case_owner", HOURS), ["case_owner"], HOURS)
    most = F.struct(-F.col("n_rows"), F.col("case_owner"))
    fast = F.when(F.col("median").isNotNull(), F.struct("median", "case_owner"))
    # At most one entry per team member.
    names = F.transform(F.array_sort(F.collect_list(most.alias("m"))), lambda m: m["case_owner"])
    return stats.agg(
        F.min_by("case_owner", most).alias("top_volume_agent"),
        F.coalesce(F.max("n_rows"), F.lit(0)).alias("top_volume_count"),
        F.min_by("case_owner", fast).alias("fastest_agent"),
        values.rounded(F.min("median"), 2).alias("fastest_response_hours"),
        F.count("*").alias("agent_count"),
        F.array_join(names, ", ").alias("agents_list"))


def sla_metrics(df: DataFrame) -> DataFrame:
    """M4: share created in business hours and shares answered within 1 and 4 hours."""
    valid = F.col(HOURS) > 0
    within = lambda h: values.rounded(values.percent(
        F.count_if(valid & (F.col(HOURS) <= h)), F.count_if(valid), None), 1)
    open_ = times.business_hours(F.col("create_ts_local"))
    return df.agg(
        values.rounded(values.percent(F.count_if(open_), F.count("*"), None), 1).alias("business_hours_percentage"),
        within(1).alias("response_under_1hour_percentage"),
        within(4).alias("response_under_4hour_percentage"))


def quality_metrics(df: DataFrame) -> DataFrame:
    """M5."""
    return df.agg(
        F.count(HOURS).alias("records_with_response_time"),
        (F.count("*") - F.count(HOURS)).alias("records_missing_data"),
        values.rounded(values.percent(F.count(HOURS), F.count("*")), 1).alias("data_quality_score"))


def chat_metrics(df: DataFrame, agent: str = "display_agent") -> DataFrame:
    """M6: volume, bot and human counts by name, satisfaction, top country, peak hour, duration.

    A chat is counted once for every bot (or human) name that its agent's name contains. The two
    satisfaction figures are the same mean, as ratings are not split by agent type here.
    """
    low = F.lower(F.coalesce(F.col(agent), F.lit("")))
    hits = lambda names: sum(
        (F.count_if(low.contains(n.lower())) for n in names), F.lit(0).cast("bigint"))
    weekend = times.calendar_weekend(F.col("created_ts_local"))
    bots, humans = hits(dims.METRIC_BOT_NAMES), hits(dims.REPORT_AGENTS)

    # One row per country and hour, from which everything else follows.
    cells = df.groupBy("country", "hour").agg(
        F.count("*").alias("n"), F.count_if(weekend).alias("off"), bots.alias("bots"), humans.alias("humans"),
        F.sum("rating_value").alias("ratings"), F.count("rating_value").alias("rated"),
        F.sum("duration_minutes").alias("minutes"), F.count("duration_minutes").alias("timed"))
    of = lambda col: F.when(F.col(col).isNotNull(), F.struct(
        (-F.sum("n").over(Window.partitionBy(col))).alias("neg"), F.col(col).alias("k")))
    none = lambda c: F.coalesce(c, F.lit(0))
    one = cells.withColumns({"by_country": of("country"), "by_hour": of("hour")}).agg(
        none(F.sum("n")).alias("total_records"), F.lit(0).cast("bigint").alias("total_tickets"),
        none(F.sum("n")).alias("total_chats"),
        none(F.sum("n") - F.sum("off")).alias("weekday_records"), none(F.sum("off")).alias("weekend_records"),
        none(F.sum("bots")).alias("total_bot_chats"), none(F.sum("humans")).alias("total_human_chats"),
        values.rounded(F.sum("ratings") / F.nullif(F.sum("rated"), F.lit(0)), 1).alias("bot_satisfaction_rate"),
        values.rounded(F.sum("minutes") / F.nullif(F.sum("timed"), F.lit(0)), 1).alias("avg_chat_duration_minutes"),
        F.min("by_country").alias("_c"), F.min("by_hour").alias("_h"))
    total = F.col("total_records")
    share = lambda c: values.rounded(values.percent(F.col(c), total), 1)
    return one.select(
        "*",
        F.when(total > 0, share("total_human_chats")).alias("bot_transfer_rate"),
        F.when(F.col("total_bot_chats") > 0, share("total_bot_chats")).alias("bot_resolution_rate"),
        F.col("bot_satisfaction_rate").alias("human_satisfaction_rate"),
        F.col("_c.k").alias("top_country"), F.coalesce(-F.col("_c.neg"), F.lit(0)).alias("top_country_count"),
        F.format_string("%02d:00", F.col("_h.k")).alias("peak_hour"),
        F.coalesce(-F.col("_h.neg"), F.lit(0)).alias("peak_hour_count")).drop("_c", "_h")


def ticket_metrics(df: DataFrame) -> DataFrame:
    """M1 to M5 as one row."""
    one = ticket_volume_metrics(df)
    for part in (response_metrics(df), agent_metrics(df), sla_metrics(df), quality_metrics(df)):
        one = one.withColumn("_p", part.select(F.struct(*part.columns).alias("p")).scalar())
        one = one.select(*[c for c in one.columns if c != "_p"], "_p.*")
    return one


# Fixed values. Columns of the metrics log.
METRICS_SCHEMA = T.StructType([
    T.StructField(name, kind) for kind, names in [
        (T.TimestampNTZType(), ["timestamp"]),
        (T.StringType(), ["run_id", "analytics_type", "date_range", "period_description"]),
        (T.LongType(), ["total_records", "total_tickets", "total_chats", "weekday_records", "weekend_records"]),
        (T.DoubleType(), ["avg_response_time_hours", "median_response_time_hours",
                          "min_response_time_hours", "max_response_time_hours",
                          "weekend_avg_response_hours", "weekday_avg_response_hours"]),
        (T.StringType(), ["top_volume_agent"]), (T.LongType(), ["top_volume_count"]),
        (T.StringType(), ["fastest_agent"]), (T.DoubleType(), ["fastest_response_hours"]),
        (T.LongType(), ["agent_count"]), (T.StringType(), ["agents_list"]),
        (T.LongType(), ["total_bot_chats", "total_human_chats"]),
        (T.DoubleType(), ["bot_transfer_rate", "bot_resolution_rate", "avg_chat_duration_minutes",
                          "bot_satisfaction_rate", "human_satisfaction_rate"]),
        (T.StringType(), ["top_country"]), (T.LongType(), ["top_country_count"]),
        (T.StringType(), ["peak_hour"]), (T.LongType(), ["peak_hour_count"]),
        (T.DoubleType(), ["business_hours_percentage", "response_under_1hour_percentage",
                          "response_under_4hour_percentage"]),
        (T.LongType(), ["records_with_response_time", "records_missing_data"]),
        (T.DoubleType(), ["data_quality_score"]), (T.TimestampNTZType(), ["last_updated"]),
    ] for name in names])


def metrics_row(metrics: DataFrame, run_id: str, analytics_type: str, as_of, date_range: str = "",
                period_description: str = "") -> DataFrame:
    """M7: a metrics extract in the shape of the log; absent columns are NULL."""
    moment = F.lit(as_of).cast("timestamp_ntz")
    fixed = {
        "timestamp": moment, "last_updated": moment, "run_id": F.lit(run_id),
        "analytics_type": F.lit(analytics_type), "date_range": F.lit(date_range),
        "period_description": F.lit(period_description)}
    pick = lambda f: fixed.get(f.name, F.col(f.name) if f.name in metrics.columns else F.lit(None))
    return metrics.select(*[pick(f).cast(f.dataType).alias(f.name) for f in METRICS_SCHEMA.fields])


def log_metrics(row: DataFrame, path: str) -> None:
    """M7: append the row to the log table."""
    row.write.mode("append").parquet(path)


def diagnose(df: DataFrame, requirements: dict[str, list[str]], key: str) -> DataFrame:
    """M8: per report and required column whether it is there and filled, with rows and duplicate ids."""
    needed = sorted({c for cols in requirements.values() for c in cols})
    present = [c for c in needed if c in df.columns]
    # Rows are counted per id first, so that duplicates need no distinct over the whole table.
    per_id = df.groupBy(key).agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in present])
    one = per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_ids"),
        *[F.coalesce(F.sum(f"c_{c}"), F.lit(0)).alias(f"c_{c}") for c in present])
    checks = F.array(*[
        F.struct(F.lit(name).alias("report"), F.lit(c).alias("column_name"),
                 F.lit(c in df.columns).alias("present"),
                 (F.col(f"c_{c}") if c in df.columns else F.lit(0).cast("bigint")).alias("filled"))
        for name, cols in requirements.items() for c in cols])
    return one.select(F.explode(checks).alias("c"), "rows", "duplicate_ids").select(
        "c.*", "rows", "duplicate_ids")


def insights(df: DataFrame) -> DataFrame:
    """M9: all findings about a query result in their order, chosen by column name.

    Response-time columns give their mean, count-like columns their sum and maximum, agent or owner
    columns their three most frequent values; the row count comes last. A caller may filter by position.
    """
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    picks, aggs = [], [F.count("*").alias("n")]
    for i, c in enumerate(df.columns):
        low, col = c.lower(), F.col(f"`{c}`")
        if "response" in low and "time" in low:
            if c in numeric:
                aggs.append(F.avg(col).alias(f"m{i}"))
                picks.append((F.lit(True), F.concat(
                    F.lit("Average response time: "), values.decimals(F.col(f"m{i}")), F.lit(" hours"))))
        elif "count" in low:
            aggs += [F.sum(col).alias(f"s{i}"), F.max(col).alias(f"x{i}")]
            picks.append((F.lit(True), F.format_string(
                f"Total {c}: %,d (highest single: %,d)", F.col(f"s{i}").cast("bigint"),
                F.col(f"x{i}").cast("bigint"))))
        elif "agent" in low or "owner" in low:
            first = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("r"), "k")))
            text = F.array_join(F.transform(
                first, lambda t: F.concat(t["k"], F.lit(": "), (-t["r"]).cast("string"))), ", ")
            tops = (df.where(col.isNotNull()).groupBy(col.cast("string").alias("k"))
                    .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(3)
                    .agg(text.alias("t")).scalar())
            picks.append((F.lit(True), F.concat(F.lit("Top agents: "), tops)))
    picks.append((F.lit(True), F.format_string("Dataset: %,d records analyzed", F.col("n"))))
    found = F.array_compact(F.array(*[F.when(cond, text) for cond, text in picks]))
    return df.agg(*aggs).select(F.posexplode(found).alias("position", "insight"))
