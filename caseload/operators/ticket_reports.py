"""Ticket reports. Input: normalised tickets; one row per ticket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload.functions import times, values
from caseload.operators import filters
from caseload.operators.distribution import MEDIAN, Rank, counted_rows, summarize
from caseload.operators.trends import last_rows, with_trend

HOURS = "first_response_hours"


def _not_live_chat() -> Column:
    return ~values.is_live_chat(F.col("pipeline"))


def tickets_by_pipeline(df: DataFrame) -> DataFrame:
    """A1."""
    return df.where(F.col("pipeline").isNotNull()).groupBy("pipeline").agg(
        F.count("*").alias("tickets"))


def weekend_distribution(df: DataFrame) -> DataFrame:
    """A2: counts and shares of weekday and weekend tickets."""
    counts = df.groupBy(
        F.when(F.col("is_weekend"), "Weekend").otherwise("Weekday").alias("category")
    ).agg(counted_rows(df).alias("tickets"))
    whole = F.sum("tickets").over(Window.partitionBy())
    return counts.withColumn("share_pct", values.percent(F.col("tickets"), whole))


def daily_volume_trend(df: DataFrame, ts: str = "create_ts_local") -> DataFrame:
    """A3: tickets per day with the fitted line."""
    daily = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(
        F.count("*").alias("tickets"))
    return with_trend(daily, "day", {"tickets": "trend"})


def ticket_summary(df: DataFrame) -> DataFrame:
    """A4: totals, median weekday response without live chat, mean weekend response, daily rates."""
    weekday = ~F.col("is_weekend")
    typical = summarize(
        df.select(F.when(weekday & _not_live_chat(), F.col(HOURS)).alias("v")), [], "v")
    total, weekend = F.count("*"), F.count_if(F.col("is_weekend"))
    owner = F.when(weekday, F.col("case_owner"))
    one = df.agg(
        total.alias("total_tickets"),
        weekend.alias("weekend_tickets"),
        (total - weekend).alias("weekday_tickets"),
        F.avg(F.when(F.col("is_weekend"), F.col(HOURS))).alias("mean_response_weekend"),
        (times.days_between(F.min("create_ts_local"), F.max("create_ts_local")) + 1).alias("span_days"),
        (F.count_distinct(owner)
         + F.max(F.when(weekday & F.col("case_owner").isNull(), 1).otherwise(0))).alias("agent_count"),
    )
    per_day = lambda c: F.col(c) / F.nullif("span_days", F.lit(0))
    return one.select(
        "*",
        typical.select("median").scalar().alias("median_response_weekday"),
        per_day("total_tickets").alias("tickets_per_day"),
        per_day("weekday_tickets").alias("weekday_per_day"),
        per_day("weekend_tickets").alias("weekend_per_day"),
    )


def ticket_cards(df: DataFrame, as_of: dt.datetime, days: int) -> DataFrame:
    """A5: cards of the last ``days`` calendar days; rates divide by ``days``."""
    window = filters.support_team(
        filters.between(df, "create_ts_utc", as_of - dt.timedelta(days=days), as_of))
    # Counts and median start from the same counts, which one scan makes.
    counted = window.groupBy("is_weekend", _not_live_chat().alias("counts"), HOURS).agg(F.count("*").alias("w"))
    weekday = ~F.col("is_weekend") & F.col("counts")
    typical = summarize(counted.select(F.when(weekday, F.col(HOURS)).alias("v"), "w"), [], "v", weight="w")
    total = F.coalesce(F.sum("w"), F.lit(0))
    weekend = F.coalesce(F.sum(F.when(F.col("is_weekend"), F.col("w"))), F.lit(0))
    rate = lambda c: c / F.lit(float(days))
    return counted.agg(
        total.alias("total_tickets"),
        (total - weekend).alias("weekday_tickets"),
        weekend.alias("weekend_tickets"),
        rate(total).alias("tickets_per_day"),
        rate(total - weekend).alias("weekday_per_day"),
        rate(weekend).alias("weekend_per_day"),
    ).withColumn("median_response_weekday", typical.select("median").scalar())


def pipeline_breakdown(df: DataFrame, owner: str = "case_owner", weight: str | None = None) -> DataFrame:
    """Per owner: tickets, tickets outside live chat, pipeline -> count, and the top pipeline.

    The map has one entry per pipeline, and pipelines are counted before the map is built. ``weight`` says how many
    tickets a row stands for.
    """
    counts = df.groupBy(owner, "pipeline").agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    entry = F.when(F.col("pipeline").isNotNull(), F.struct("pipeline", "n"))
    # Greatest count first, then the first name.
    ranked = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["n"] != b["n"], F.when(a["n"] > b["n"], -1).otherwise(1))
        .when(a["pipeline"] < b["pipeline"], -1).when(a["pipeline"] > b["pipeline"], 1).otherwise(0))
    return counts.groupBy(owner).agg(
        F.sum("n").alias("tickets"),
        F.sum(F.when(_not_live_chat(), F.col("n")).otherwise(0)).alias("non_live_chat_tickets"),
        ranked.alias("_ranked"),
    ).select(
        owner, "tickets", "non_live_chat_tickets",
        F.map_from_entries("_ranked").alias("pipeline_breakdown"),
        F.when(F.size("_ranked") == 0, "No data").otherwise(F.concat(
            F.get("_ranked", F.lit(0))["pipeline"], F.lit(" ("), F.get("_ranked", F.lit(0))["n"],
            F.lit(")"),
            F.when(F.size("_ranked") > 1, F.concat(F.lit(" +"), F.size("_ranked") - 1, F.lit(" more")))
            .otherwise(""))).alias("top_pipeline"),
    )


def agent_table(df: DataFrame) -> DataFrame:
    """Weekday tickets per agent with response figures that leave out live chat."""
    weekday = filters.view(df, "weekday")
    span = times.days_between(F.min("create_ts_local"), F.max("create_ts_local")) + 1
    whole = weekday.agg(F.struct(F.count("*").alias("n"), span.alias("days")).alias("t")).scalar()
    # The figures and the breakdown start from the same counts.
    counted = weekday.where(F.col("case_owner").isNotNull()).groupBy("case_owner", "pipeline", HOURS).agg(F.count("*").alias("w"))
    stats = summarize(
        counted.select("case_owner", F.when(_not_live_chat(), F.col(HOURS)).alias("v"), "w"), ["case_owner"], "v", weight="w")
    joined = stats.join(pipeline_breakdown(counted, weight="w"), "case_owner").withColumn("t", whole)
    return joined.select(
        F.col("case_owner").alias("agent"), "tickets",
        values.rounded(F.col("tickets") / F.col("t.n") * 100, 1).alias("share_pct"),
        values.rounded(F.col("tickets") / F.col("t.days"), 1).alias("daily_average"),
        values.rounded(F.col("mean"), 2).alias("mean_response"),
        values.rounded(F.col("median"), 2).alias("median_response"),
        values.rounded(F.col("std"), 2).alias("std_response"),
        "pipeline_breakdown", "top_pipeline",
    )


def weekly_response(df: DataFrame, stat: str = "median") -> DataFrame:
    """Per Monday the median or mean of all, weekday and weekend tickets, counts, trends and
    the overall value of each view.

    Rows are counted by (week, weekend flag, value) first; the views and the overall row are then
    made from those counts, so the table is read once.
    """
    _check_stat(stat)
    week = times.bucket(F.col("create_ts_local"), "week_mon")
    counted = df.groupBy(week.alias("week"), "is_weekend", F.col(HOURS).alias("v")).agg(
        counted_rows(df).alias("w"))
    views = F.array(F.lit("all"), F.when(F.col("is_weekend"), "weekend").otherwise("weekday"))
    keyed = counted.withColumn("view", F.explode(views)).withColumn(
        "overall", F.explode(F.array(F.lit(False), F.lit(True))))
    keyed = keyed.where(F.col("overall") | F.col("week").isNotNull()).withColumn(
        "week", F.when(~F.col("overall"), F.col("week")))
    stats = summarize(keyed, ["overall", "week", "view"], "v", MEDIAN, weight="w")
    views = ["all", "weekday", "weekend"]
    pick = lambda v, col: f"max(if(view = '{v}', {col}, NULL))"
    wide = stats.groupBy("overall", "week").agg(*map(F.expr, [
        *[f"{pick(v, stat)} AS {v}_{stat}" for v in views],
        *[f"coalesce({pick(v, 'n')}, 0) AS {v}_count" for v in views]]))
    weekly = wide.selectExpr("*", *[
        f"max(if(overall, {v}_{stat}, NULL)) OVER () AS overall_{v}" for v in views]).where("NOT overall")
    return with_trend(
        weekly.drop("overall"), "week", {f"{v}_{stat}": f"trend_{v}" for v in views},
        fallback={f"{v}_{stat}": f"overall_{v}" for v in views})


def weekend_response(df: DataFrame) -> DataFrame:
    """Weeks with weekend responses: median, mean, count and the trend of the median."""
    weekend = filters.view(df, "weekend").withColumn(
        "week", times.bucket(F.col("create_ts_local"), "week_mon"))
    stats = summarize(weekend.select("week", HOURS), ["week"], HOURS)
    used = stats.where("n > 0").select(
        "week", F.col("median").alias("weekend_median"), F.col("mean").alias("weekend_mean"),
        F.col("n").alias("weekend_count"))
    return with_trend(used, "week", {"weekend_median": "trend"})


def top_delayed(df: DataFrame, n: int = 5) -> DataFrame:
    """Tickets with the longest wait; ties by id."""
    cols = ["ticket_id", HOURS, "case_owner", "create_ts_local", "pipeline"]
    return filters.valid_hours(df).orderBy(F.desc(HOURS), "ticket_id").limit(n).select(*cols)


def agent_mean_response(df: DataFrame) -> DataFrame:
    """A10: mean weekday response per owner, fastest first."""
    means = filters.view(df, "weekday").where(F.col("case_owner").isNotNull()).groupBy(
        F.col("case_owner").alias("agent")).agg(F.avg(HOURS).alias("mean_response"))
    return means.where(F.col("mean_response").isNotNull()).orderBy("mean_response", "agent")


VOLUME_GRAINS = {"daily": "day", "weekly": "week_mon", "monthly": "month"}


def volume_by_grain(df: DataFrame, grain: str = "monthly", n: int = 10,
                    ts: str = "create_ts_utc") -> DataFrame:
    """The last ``n`` periods with mean, peak and total over all periods."""
    if grain not in VOLUME_GRAINS:
        raise ValueError(f"unknown grain {grain!r}, expected one of {sorted(VOLUME_GRAINS)}")
    counts = df.where(F.col(ts).isNotNull()).groupBy(
        times.bucket(F.col(ts), VOLUME_GRAINS[grain]).alias("period")).agg(
        F.count("*").alias("tickets"))
    whole = Window.partitionBy()
    counts = counts.withColumns({
        "mean_tickets": F.avg("tickets").over(whole),
        "peak_tickets": F.max("tickets").over(whole),
        "total_tickets": F.sum("tickets").over(whole),
    })
    return last_rows(counts, ["period"], n)


def owner_performance(df: DataFrame, n: int = 10, owner: str = "ticket_owner",
                      hours: str = HOURS) -> DataFrame:
    """Owners with most tickets: count, share of all tickets, mean response."""
    counts = df.groupBy(F.col(owner).alias("owner")).agg(
        F.count("*").alias("tickets"), F.avg(hours).alias("mean_response"))
    share = values.percent(F.col("tickets"), F.sum("tickets").over(Window.partitionBy()))
    ranked = counts.withColumn("share_pct", share).where(F.col("owner").isNotNull())
    return ranked.orderBy(F.desc("tickets"), "owner").limit(n)


def hms_response_analysis(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Per text column the mean, upper median, count and verdict.

    Without ``cols`` all columns with "response" and "time" in their name are used.
    """
    cols = cols or [c for c in df.columns if "response" in c.lower() and "time" in c.lower()]
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), values.hms_hours(F.col(f"`{c}`")).alias("v"))
        for c in cols])).alias("r")).select("r.*")
    stats = summarize(stacked.where(F.col("v").isNotNull()), ["metric"], "v",
                      {"upper_median": Rank(upper=True)})
    return stats.select(
        "metric", F.col("mean").alias("mean_hours"), F.col("upper_median").alias("median_hours"),
        F.col("n").alias("tickets"), values.response_verdict(F.col("mean")).alias("verdict"))


def hms_agent_means(df: DataFrame, col: str, n: int = 5, owner: str = "ticket_owner") -> DataFrame:
    """Mean hours of the ``n`` owners with most tickets, from ``:`` texts only."""
    hours = F.when(F.col(col).contains(":"), values.hms_hours(F.col(col)))
    top = df.where(F.col(owner).isNotNull()).groupBy(F.col(owner).alias("agent")).agg(
        F.count("*").alias("all_tickets"), F.avg(hours).alias("mean_hours"),
        F.count(hours).alias("tickets")).orderBy(F.desc("all_tickets"), "agent").limit(n)
    return top.where("tickets > 0").select("agent", "mean_hours", "tickets")


def period_analysis(df: DataFrame, start: dt.date, end: dt.date, n: int = 5,
                    owner: str = "ticket_owner", ts: str = "create_ts_utc") -> DataFrame:
    """Total and daily average of [start, end] (midnights), with the top owners as rows."""
    midnight = lambda d: dt.datetime.combine(d, dt.time())
    inside = filters.between(df, ts, midnight(start), midnight(end))
    counts = inside.groupBy(F.col(owner).alias("owner")).agg(F.count("*").alias("tickets"))
    total = F.sum("tickets").over(Window.partitionBy())
    days = (end - start).days
    return counts.withColumns({
        "total_tickets": total,
        "daily_average": total / F.nullif(F.lit(float(days)), F.lit(0.0)),
    }).where(F.col("owner").isNotNull()).orderBy(F.desc("tickets"), "owner").limit(n)


def date_weekend_breakdown(df: DataFrame, ts: str = "create_ts_local") -> DataFrame:
    """Total, weekend and weekday tickets per day."""
    weekend = F.count_if(F.col("is_weekend"))
    return df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("date")).agg(
        F.count("*").alias("total"), weekend.alias("weekend"),
        (F.count("*") - weekend).alias("weekday"))


def _check_stat(stat: str) -> None:
    if stat not in ("median", "mean"):
        raise ValueError(f"unknown statistic {stat!r}, expected 'median' or 'mean'")


def weekly_stats_joined(df: DataFrame) -> DataFrame:
    """Per Monday the mean response of all, weekday and weekend tickets, with counts.

    One conditional aggregation instead of three grouped frames joined on the week.
    """
    wk = times.bucket(F.col("create_ts_local"), "week_mon")
    hours = F.col(HOURS)
    weekday = F.when(~F.col("is_weekend"), hours)
    weekend = F.when(F.col("is_weekend"), hours)
    return df.where(F.col("create_ts_local").isNotNull()).groupBy(wk.alias("week")).agg(
        F.avg(hours).alias("all_mean"), F.count(hours).alias("all_count"),
        F.avg(weekday).alias("weekday_mean"), F.count(weekday).alias("weekday_count"),
        F.avg(weekend).alias("weekend_mean"), F.count(weekend).alias("weekend_count"))


def volume_with_response(df: DataFrame) -> DataFrame:
    """Weekday tickets per owner next to the mean and spread of their responses."""
    eligible = F.when(_not_live_chat(), F.col(HOURS))
    return filters.view(df, "weekday").where(F.col("case_owner").isNotNull()).groupBy(
        F.col("case_owner").alias("agent")).agg(
        F.count("*").alias("tickets"), F.avg(eligible).alias("mean_response"),
        F.stddev_samp(eligible).alias("std_response"))
