"""Chat reports. Input: normalised chats."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseload import dims
from caseload.functions import times, values
from caseload.operators import filters
from caseload.operators.trends import last_rows



def _n(cond: Column | None = None) -> Column:
    return F.count("*") if cond is None else F.count_if(cond)


def _is(kind: str) -> Column:
    return F.col("agent_type") == kind


def _good() -> Column:
    return F.coalesce(F.col("rating_value") == 5, F.lit(False))


def _bad() -> Column:
    return F.coalesce(F.col("rating_value") == 1, F.lit(False))


def chat_volume(df: DataFrame) -> DataFrame:
    """One row per day and per Tuesday week with day count, daily mean and peak day.

    Both grains come from the daily counts, so the chats are read and shuffled once.
    """
    daily = df.where(F.col("date").isNotNull()).groupBy("date").agg(_n().alias("chats"))
    whole = Window.partitionBy()
    peak = F.struct(-F.col("chats"), F.col("date"))
    daily = daily.withColumns({
        "total_days": F.count("*").over(whole),
        "mean_daily": F.avg("chats").over(whole),
        "peak_day": F.min_by("date", peak).over(whole),
        "peak_chats": F.max("chats").over(whole),
    })
    both = daily.withColumn("g", F.explode(F.array(
        F.struct(F.lit("day").alias("grain"), F.col("date").alias("period")),
        F.struct(F.lit("week").alias("grain"), times.bucket(F.col("date"), "week_tue").alias("period")))))
    keep = ["total_days", "mean_daily", "peak_day", "peak_chats"]
    return both.groupBy("g.grain", "g.period").agg(
        F.sum("chats").alias("chats"), *[F.max(c).alias(c) for c in keep])


def chat_hourly(df: DataFrame) -> DataFrame:
    """Chats per hour, the peak hour and the share of 09:00 to 17:59."""
    counts = df.groupBy("hour").agg(_n().alias("chats"))
    whole = Window.partitionBy()
    busy = F.sum(F.when(F.col("hour").between(9, 17), F.col("chats")).otherwise(0)).over(whole)
    known = F.when(F.col("hour").isNotNull(), F.struct(-F.col("chats"), F.col("hour")))
    return counts.withColumns({
        "peak_hour": F.min_by("hour", known).over(whole),
        "business_hours_ratio": busy / F.sum("chats").over(whole),
    }).where(F.col("hour").isNotNull())


def chat_trend(df: DataFrame) -> DataFrame:
    """Slope of the daily volume, its direction and the growth from first to last day."""
    daily = df.groupBy("date").agg(_n().alias("chats"))
    x = F.when(F.col("date").isNotNull(), F.row_number().over(Window.orderBy(F.asc_nulls_last("date"))) - 1)
    one = daily.withColumn("x", x).agg(
        F.coalesce(F.sum("chats"), F.lit(0)).alias("n"),
        F.count("date").alias("days"),
        F.regr_slope(F.when(F.col("x").isNotNull(), F.col("chats")).cast("double"), F.col("x")).alias("s"),
        F.min_by("chats", "date").alias("first"),
        F.max_by("chats", "date").alias("last"))
    enough = (F.col("n") >= 2) & (F.col("days") > 0)
    slope = F.when(enough & (F.col("days") > 1), F.col("s")).otherwise(F.lit(0.0))
    growth = F.when(enough & (F.col("days") > 1) & (F.col("first") > 0),
                    (F.col("last") - F.col("first")) / F.col("first") * 100).otherwise(F.lit(0.0))
    return one.select(
        F.when(F.col("n") < 2, "insufficient_data").when(F.col("days") == 0, "no_data")
        .otherwise("ok").alias("trend"),
        slope.alias("trend_slope"),
        F.when(slope > 0, "increasing").when(slope < 0, "decreasing").otherwise("stable")
        .alias("trend_direction"),
        growth.alias("growth_rate"))


def bot_metrics(df: DataFrame) -> DataFrame:
    """C4: one row per bot, next to the total, share and mean duration of all bot chats."""
    counts = df.groupBy(
        F.when(_is("bot"), F.col("primary_agent")).alias("bot"),
        F.when(_is("bot"), F.col("display_agent")).alias("display_agent"),
    ).agg(
        _n().alias("chats"), F.sum("duration_minutes").alias("minutes"),
        F.avg("duration_minutes").alias("mean_duration"),
        _n(F.col("has_rating")).alias("rated_chats"), F.avg("rating_value").alias("mean_rating"))
    whole = Window.partitionBy()
    bots = F.col("bot").isNotNull()
    total = F.sum(F.when(bots, F.col("chats"))).over(whole)
    minutes = F.sum(F.when(bots, F.col("minutes"))).over(whole)
    return counts.withColumns({
        "bot_chats": total,
        "bot_share_pct": values.percent(total, F.sum("chats").over(whole)),
        "bot_mean_duration": minutes / F.nullif(total, F.lit(0)),
    }).where(bots).drop("minutes")


def credited(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """One row per chat and human named as first or second agent; a name counts once per chat."""
    both = F.array_distinct(F.array("primary_agent", "secondary_agent"))
    return df.withColumn("agent", F.explode(both)).where(F.col("agent").isin(list(agents.humans)))


def _roles(df: DataFrame, agents: dims.AgentRegistry, *more) -> DataFrame:
    """Every chat once for each of its roles, a (kind, agent, display name): each credited human, and ``more``.

    Reports on several groupings of the same chats read the table once this way; counts are combined before the shuffle.
    """
    names = F.filter(F.array_distinct(F.array("primary_agent", "secondary_agent")), lambda a: a.isin(list(agents.humans)))
    role = lambda kind, agent, shown: F.struct(
        F.lit(kind).alias("kind"), agent.alias("agent"), shown.alias("display_agent"))
    humans = F.transform(names, lambda a: role("human", a, values.agent_display(a, agents)))
    return df.withColumn("role", F.explode(F.concat(humans, *[F.array_compact(F.array(m)) for m in more])))


def _role(kind: str, agent, shown):
    return F.struct(F.lit(kind).alias("kind"), agent.alias("agent"), shown.alias("display_agent"))


def human_metrics(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """One row per credited human, next to the figures of all human chats."""
    none = F.lit(None).cast("string")
    human = _is("human")
    stats = _roles(df, agents, _role("all", none, none)).groupBy("role").agg(
        _n().alias("chats"), F.avg("duration_minutes").alias("mean_duration"),
        _n(F.col("has_rating")).alias("rated_chats"), F.avg("rating_value").alias("mean_rating"),
        _n(F.col("bot_transfer")).alias("transfers_received"),
        F.struct(_n(human).alias("n"), values.percent(_n(human), _n()).alias("share"),
                 F.avg(F.when(human, F.col("duration_minutes"))).alias("minutes")).alias("t"))
    # One row per human and one for all chats.
    total = F.max(F.when(F.col("role.kind") == "all", F.col("t"))).over(Window.partitionBy())
    return stats.withColumn("t", total).where(F.col("role.kind") == "human").select(
        "role.agent", "role.display_agent", "chats", "mean_duration", "rated_chats", "mean_rating", "transfers_received",
        F.col("t.n").alias("human_chats"), F.col("t.share").alias("human_share_pct"), F.col("t.minutes").alias("human_mean_duration"))


def agent_type_performance(df: DataFrame) -> DataFrame:
    """Bots against humans."""
    return df.where(F.col("agent_type").isin("bot", "human")).groupBy("agent_type").agg(
        _n().alias("chats"), F.avg("duration_minutes").alias("mean_duration"),
        F.avg("first_response_seconds").alias("mean_first_response"),
        values.percent(_n(_good()), _n(F.col("has_rating"))).alias("satisfaction_pct"))


def satisfaction(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """Rated, good, bad and rate: overall, per bot, per credited human and per rating value."""
    rated = df.where("has_rating")
    both = F.array_distinct(F.array("primary_agent", "secondary_agent"))
    humans = F.filter(both, lambda a: a.isin(list(agents.humans)))
    level = lambda kind, name: F.struct(F.lit(kind).alias("level"), name.alias("name"))
    groups = F.concat(
        F.array(level("overall", F.lit("all")),
                level("rating", values.decimals(F.col("rating_value")))),
        F.transform(humans, lambda a: level("human", a)),
        F.when(_is("bot"), F.array(level("bot", F.col("primary_agent")))).otherwise(
            F.array().cast("array<struct<level:string,name:string>>")))
    # Counted before the levels are unfolded: a few rows per agent pair and rating value.
    counts = rated.groupBy("primary_agent", "secondary_agent", "agent_type", "rating_value").agg(
        _n().alias("n"))
    return counts.withColumn("l", F.explode(groups)).groupBy("l.level", "l.name").agg(
        F.sum("n").alias("rated"),
        F.sum(F.when(_good(), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(_bad(), F.col("n")).otherwise(0)).alias("bad"),
    ).withColumn("satisfaction_pct", values.percent(F.col("good"), F.col("rated")))


def transfers(df: DataFrame) -> DataFrame:
    """Daily transfers and rates next to the totals. ``bot_only`` may be negative."""
    daily = df.groupBy("date").agg(
        _n().alias("chats"), _n(F.col("bot_transfer")).alias("transfers"), _n(_is("bot")).alias("bots"))
    daily = daily.withColumn("transfer_rate", values.percent(F.col("transfers"), F.col("chats")))
    whole = Window.partitionBy()
    total = lambda c: F.sum(c).over(whole)
    bot_only = total("bots") - total("transfers")
    return daily.withColumns({
        "total_transfers": total("transfers"),
        "total_transfer_rate": values.percent(total("transfers"), total("chats")),
        "bot_only_chats": bot_only,
        "bot_only_rate": values.percent(bot_only, total("chats")),
        "mean_daily_rate": F.avg(F.when(F.col("date").isNotNull(), F.col("transfer_rate"))).over(whole),
    }).where(F.col("date").isNotNull()).drop("bots")


def chat_response(df: DataFrame) -> DataFrame:
    """C9."""
    first = F.col("first_response_seconds")
    return df.agg(
        F.avg(first).alias("mean_first_response"), F.avg("avg_response_seconds").alias("mean_response"),
        F.avg(F.when(_is("bot"), first)).alias("bot_first_response"),
        F.avg(F.when(_is("human"), first)).alias("human_first_response"))


def geography(df: DataFrame, n: int = 10) -> DataFrame:
    """Countries with most chats, the number of countries and the first one."""
    counts = df.where(F.col("country").isNotNull()).groupBy("country").agg(_n().alias("chats"))
    whole = Window.partitionBy()
    return counts.withColumns({
        "total_countries": F.count("*").over(whole),
        "top_country": F.min_by("country", F.struct(-F.col("chats"), F.col("country"))).over(whole),
    }).orderBy(F.desc("chats"), "country").limit(n)


def weekly_counts_joined(df: DataFrame) -> DataFrame:
    """All, bot and human chats per Tuesday week and whether bot + human is all."""
    wk = times.bucket(F.col("created_ts_local"), "week_tue")
    counts = df.where(F.col("created_ts_local").isNotNull()).groupBy(wk.alias("week")).agg(
        _n().alias("all_chats"), _n(_is("bot")).alias("bot_chats"), _n(_is("human")).alias("human_chats"),
        _n(F.col("bot_transfer")).alias("transfers"))
    summed = F.col("bot_chats") + F.col("human_chats")
    return counts.withColumn("counts_agree", F.col("all_chats") == summed)


def weekly_chat_volume(df: DataFrame, weeks: int = 12) -> DataFrame:
    """C11: the last weeks of J4 with transfers and transfer rate."""
    counts = weekly_counts_joined(df).withColumn(
        "transfer_rate", values.percent(F.col("transfers"), F.col("all_chats")))
    return last_rows(counts, ["week"], weeks)


def weekly_satisfaction(df: DataFrame, weeks: int = 12) -> DataFrame:
    """Mean rating, count and (mean - 1) / 4 per week and agent type, last weeks."""
    wk = times.bucket(F.col("created_ts_local"), "week_tue")
    stats = df.where(F.col("has_rating") & F.col("created_ts_local").isNotNull()).groupBy(
        wk.alias("week"), "agent_type").agg(
        F.avg("rating_value").alias("mean_rating"), F.count("rating_value").alias("ratings"))
    recent = F.dense_rank().over(Window.orderBy(F.desc("week")))
    return stats.withColumn("_r", recent).where(F.col("_r") <= weeks).drop("_r").withColumn(
        "satisfaction_pct", (F.col("mean_rating") - 1) / 4 * 100)


def agent_chat_stats(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """Chats, mean duration and satisfaction per bot display name and per credited human."""
    # A display name is listed once any of its chats is a bot chat; all its chats count.
    shown = F.col("display_agent")
    stats = _roles(df, agents, _role("bot", shown, values.agent_display(shown, agents))).groupBy("role").agg(
        _n().alias("chats"), F.avg("duration_minutes").alias("mean_duration"),
        values.percent(_n(_good()), _n(F.col("has_rating"))).alias("satisfaction_pct"), F.max(_is("bot")).alias("b"))
    return stats.where((F.col("role.kind") == "human") | F.col("b")).select(
        "role.agent", "chats", "mean_duration", "satisfaction_pct", "role.kind", "role.display_agent")


def bot_comparison(df: DataFrame) -> DataFrame:
    """C14: bots by display name; satisfaction is mean rating times 20."""
    return df.where(_is("bot")).groupBy(F.col("display_agent").alias("bot")).agg(
        _n().alias("chats"), F.coalesce(F.avg("rating_value") * 20, F.lit(0.0)).alias("satisfaction_pct"),
        values.percent(_n(F.col("bot_transfer")), _n()).alias("transfer_rate"),
        F.avg("duration_minutes").alias("mean_duration"))


def daily_chat_trends(df: DataFrame) -> DataFrame:
    """C15."""
    return df.where(F.col("date").isNotNull()).groupBy("date").agg(
        F.count("created_ts_local").alias("chats"),
        F.coalesce(F.avg("rating_value") * 20, F.lit(0.0)).alias("satisfaction_pct"),
        _n(F.col("bot_transfer")).alias("transfers"),
        values.percent(_n(F.col("bot_transfer")), F.count("created_ts_local")).alias("transfer_rate"))


def chat_overview(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """One summary row. Everything comes from counts per (day, agent pair, type)."""
    counts = df.groupBy("date", "primary_agent", "secondary_agent", "agent_type").agg(
        _n().alias("n"), _n(F.col("bot_transfer")).alias("t"),
        _n(F.col("has_rating")).alias("r"), _n(_good()).alias("g"))
    people = F.filter(F.array("primary_agent", "secondary_agent"), lambda a: a.isin(list(agents.humans)))
    shown = F.transform(people, lambda a: values.agent_display(a, agents))
    kind = lambda k: F.sum(F.when(_is(k), F.col("n")).otherwise(0))
    one = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_chats"),
        (F.sum(F.when(F.col("date").isNotNull(), F.col("n")))
         / F.nullif(F.count_distinct("date"), F.lit(0))).alias("mean_daily_chats"),
        values.percent(kind("bot"), F.sum("n")).alias("bot_share_pct"),
        values.percent(kind("human"), F.sum("n")).alias("human_share_pct"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("total_transfers"),
        values.percent(F.sum("t"), F.sum("n")).alias("transfer_rate"),
        values.percent(F.sum("g"), F.sum("r")).alias("satisfaction_pct"),
        values.percent(kind("bot") - F.sum("t"), F.sum("n")).alias("bot_resolution_pct"),
        F.size(F.array_distinct(F.flatten(F.collect_set(shown)))).alias("active_agents"))
    return one


def agent_performance_table(df: DataFrame, agents: dims.AgentRegistry = dims.AGENTS) -> DataFrame:
    """C17: bots and humans in one table; satisfaction is mean rating times 20, 0 when unrated."""
    bot = F.when(_is("bot") & F.col("primary_agent").isNotNull(), _role("bot", F.col("primary_agent"), F.col("display_agent")))
    stats = _roles(df, agents, bot).groupBy("role").agg(
        _n().alias("chats"), F.avg("duration_minutes").alias("mean_duration"),
        F.coalesce(F.avg("rating_value") * 20, F.lit(0.0)).alias("satisfaction_pct"))
    table = stats.select("role.agent", "role.display_agent", "chats", "mean_duration", F.initcap("role.kind").alias("type"), "satisfaction_pct")
    return table.orderBy(F.desc("chats"), "agent")


def chat_cards(df: DataFrame, as_of: dt.datetime, days: int, ratings: DataFrame | None = None) -> DataFrame:
    """Cards of the last ``days`` calendar days.

    Satisfaction is good / (good + bad) of the daily ratings of the range, else the share of 5s
    among the rated chats.
    """
    start = as_of - dt.timedelta(days=days)
    window = filters.between(df, "created_ts_utc", start, as_of)
    one = window.agg(
        _n().alias("total_chats"), (_n() / F.lit(float(days))).alias("chats_per_day"),
        _n(F.col("bot_transfer")).alias("transfers"),
        values.percent(_n(F.col("bot_transfer")), _n()).alias("transfer_rate"),
        values.percent(_n(~F.col("bot_transfer")), _n()).alias("bot_resolution_pct"),
        values.percent(_n(_good()), _n(F.col("has_rating"))).alias("satisfaction_pct"))
    if ratings is None:
        return one
    first, last = filters.local_days((start, as_of), "chats")
    inside = ratings.where(F.col("date").between(F.lit(first), F.lit(last)))
    rate = inside.agg(values.percent(F.sum("good"), F.sum("good") + F.sum("bad"))).scalar()
    return one.withColumn("satisfaction_pct", rate)


def chat_keyword_metrics(df: DataFrame, agent: str = "primary_agent", n: int = 5) -> DataFrame:
    """Bots and humans by name keyword, bot satisfaction, and the top humans as rows."""
    kind = values.agent_type_by_word(F.col(agent), dims.METRIC_BOT_WORDS)
    counts = df.groupBy(F.col(agent).alias("agent"), kind.alias("kind")).agg(
        _n().alias("chats"), _n(F.col("rate_raw").eqNullSafe("rated good")).alias("good"),
        _n(F.col("rate_raw").eqNullSafe("rated bad")).alias("bad"))
    whole = Window.partitionBy()
    of = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))).over(whole), F.lit(0))
    total = F.sum("chats").over(whole)
    rated = of("bot", "good") + of("bot", "bad")
    return counts.withColumns({
        "total_chats": total,
        "bot_chats": of("bot", "chats"), "bot_share_pct": values.percent(of("bot", "chats"), total),
        "human_chats": of("human", "chats"),
        "human_share_pct": values.percent(of("human", "chats"), total),
        "bot_satisfaction_pct": values.percent(of("bot", "good"), rated, None),
    }).where(F.col("kind") == "human").orderBy(F.desc("chats"), "agent").limit(n).drop(
        "kind", "good", "bad")
