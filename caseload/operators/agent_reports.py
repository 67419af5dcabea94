"""Agent comparison. Input: normalised tickets without spam."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseload import dims
from caseload.functions import times, values
from caseload.operators import filters
from caseload.operators.distribution import QUARTILES, summarize
from caseload.operators.ticket_reports import HOURS, pipeline_breakdown
from caseload.operators.trends import with_trend


def _response_rows(df: DataFrame) -> DataFrame:
    """Weekday tickets outside live chat."""
    return filters.view(df, "weekday", exclude_live_chat=True)


def _week(df: DataFrame) -> DataFrame:
    return df.where(F.col("create_ts_local").isNotNull()).withColumn(
        "week", times.bucket(F.col("create_ts_local"), "week_tue"))


def agent_stats(df: DataFrame, agents: list[str] = dims.REPORT_AGENTS) -> DataFrame:
    """G1: weekday volume and response distribution; agents without a valid response are left out."""
    # Both parts below start from these counts, which one scan and one shuffle make; the null test, which the join
    # would add to one part only, keeps their plans alike.
    mine = filters.view(df, "weekday").where(F.col("case_owner").isin(agents) & F.col("case_owner").isNotNull())
    counted = mine.groupBy("case_owner", "pipeline", HOURS).agg(F.count("*").alias("w"))
    eligible = F.when(~values.is_live_chat(F.col("pipeline")), F.col(HOURS))
    stats = summarize(counted.select("case_owner", eligible.alias("v"), "w"), ["case_owner"], "v", QUARTILES, weight="w")
    joined = stats.where("n > 0").join(pipeline_breakdown(counted, weight="w"), "case_owner")
    whole = F.sum("tickets").over(Window.partitionBy())
    return joined.select(
        F.col("case_owner").alias("agent"), F.col("tickets").alias("total_tickets"),
        "non_live_chat_tickets", F.col("mean").alias("mean_hours"), F.col("median").alias("median_hours"),
        F.col("std").alias("std_hours"), F.col("min").alias("min_hours"), F.col("max").alias("max_hours"),
        F.col("q25").alias("q25_hours"), F.col("q75").alias("q75_hours"),
        values.rounded(values.percent(F.col("tickets"), whole), 1).alias("share_pct"), "pipeline_breakdown")


def weekly_agent_volume(df: DataFrame, agents: list[str] = dims.REPORT_AGENTS) -> DataFrame:
    """Every week of the data with one zero-filled column per agent and their total."""
    counts = [F.count_if(F.col("case_owner").eqNullSafe(a)).alias(a) for a in agents]
    total = F.count_if(F.col("case_owner").isin(agents)).alias("total")
    return _week(df).groupBy("week").agg(*counts, total)


def weekly_agent_response(df: DataFrame, agents: list[str] = dims.REPORT_AGENTS) -> DataFrame:
    """Every week of the data with the median response per agent, NULL when there is none."""
    keyed = _week(df).withColumn(
        "v", F.when(~F.col("is_weekend") & ~values.is_live_chat(F.col("pipeline")), F.col(HOURS)))
    owner = F.when(F.col("case_owner").isin(agents), F.col("case_owner"))
    stats = summarize(keyed.select("week", owner.alias("owner"), "v"), ["week", "owner"], "v")
    return stats.groupBy("week").agg(
        *[F.max(F.when(F.col("owner") == a, F.col("median"))).alias(a) for a in agents])


def agent_trends(grid: DataFrame, agents: list[str] = dims.REPORT_AGENTS) -> DataFrame:
    """One row per (week, agent) with the value of a G2 or G3 grid and its trend line.

    Weeks without a value keep their place on the x axis but do not enter the fit.
    """
    pairs = ", ".join(f"'{a}', CAST(`{a}` AS DOUBLE)" for a in agents)
    long = grid.select("week", F.expr(f"stack({len(agents)}, {pairs}) AS (agent, value)"))
    return with_trend(long, "week", {"value": "trend"}, partition=["agent"])


def top_pipelines(df: DataFrame, k: int = 6) -> DataFrame:
    """The ``k`` pipelines with most tickets; ties by name."""
    counts = df.where(F.col("pipeline").isNotNull()).groupBy("pipeline").agg(
        F.count("*").alias("pipeline_tickets"))
    return counts.orderBy(F.desc("pipeline_tickets"), "pipeline").limit(k)


def _grid(df: DataFrame, agents: list[str], k: int) -> DataFrame:
    """Every agent with tickets next to every top pipeline, at most ``k`` times the agents."""
    present = df.where(F.col("case_owner").isin(agents)).groupBy("case_owner").agg(
        F.count("*").alias("agent_tickets"))
    cells = top_pipelines(df, k).withColumn(
        "case_owner", F.explode(F.array(*[F.lit(a) for a in agents])))
    return cells.join(present, "case_owner")


def pipeline_distribution(df: DataFrame, agents: list[str] = dims.REPORT_AGENTS, k: int = 6) -> DataFrame:
    """Tickets and share of the agent's tickets in each top pipeline.

    One row per pipeline with a column per agent is all that one scan has to make; the agents' totals are sums over
    these rows.
    """
    part = [F.count_if(F.col("case_owner").eqNullSafe(a)).alias(f"n{i}") for i, a in enumerate(agents)]
    rows = filters.drop_spam(df).groupBy("pipeline").agg(F.count("*").alias("pipeline_tickets"), *part)
    whole = Window.partitionBy()
    rows = rows.withColumns({f"t{i}": F.sum(f"n{i}").over(whole) for i in range(len(agents))})
    top = rows.where(F.col("pipeline").isNotNull()).orderBy(F.desc("pipeline_tickets"), "pipeline").limit(k)
    cells = F.array(*[F.struct(F.lit(a).alias("agent"), F.col(f"n{i}").alias("tickets"), F.col(f"t{i}").alias("of"))
                      for i, a in enumerate(agents)])
    return top.select("pipeline", F.explode(cells).alias("c")).where("c.of > 0").select(
        "c.agent", "pipeline", "c.tickets", values.percent(F.col("c.tickets"), F.col("c.of")).alias("share_pct"))


def pipeline_performance(df: DataFrame, agents: list[str] = dims.REPORT_AGENTS, k: int = 6) -> DataFrame:
    """Median and number of responses per agent and top pipeline; live chat has a fixed value."""
    df = filters.drop_spam(df)
    mine = df.where(F.col("case_owner").isin(agents) & F.col("pipeline").isNotNull())
    stats = summarize(mine.select("case_owner", "pipeline", HOURS), ["case_owner", "pipeline"], HOURS)
    joined = _grid(df, agents, k).join(stats, ["case_owner", "pipeline"], "left")
    live = values.is_live_chat(F.col("pipeline"))
    return joined.select(
        F.col("case_owner").alias("agent"), "pipeline",
        F.when(live, F.lit(dims.LIVE_CHAT_DISPLAY_HOURS)).otherwise(F.col("median")).alias("median_hours"),
        F.coalesce(F.when(live, F.col("n_rows")).otherwise(F.col("n")), F.lit(0)).alias("responses"))


def pipeline_summary(df: DataFrame, k: int = 6) -> DataFrame:
    """Tickets, share, mean and median of each top pipeline."""
    df = filters.drop_spam(df)
    stats = summarize(df.select("pipeline", HOURS), ["pipeline"], HOURS)
    whole = F.sum("n_rows").over(Window.partitionBy())
    live = values.is_live_chat(F.col("pipeline"))
    fixed = lambda c: F.when(live, F.lit(dims.LIVE_CHAT_DISPLAY_HOURS)).otherwise(F.col(c))
    return stats.withColumn("share_pct", values.percent(F.col("n_rows"), whole)).where(
        F.col("pipeline").isNotNull()).orderBy(F.desc("n_rows"), "pipeline").limit(k).select(
        "pipeline", F.col("n_rows").alias("total_tickets"), "share_pct",
        fixed("mean").alias("mean_hours"), fixed("median").alias("median_hours"))


def leaders(stats: DataFrame) -> DataFrame:
    """From a G1 table the agent with most tickets, lowest median and lowest spread."""
    low = lambda c: F.min_by("agent", F.struct(F.coalesce(c, F.lit(float("inf"))), "agent"))
    most = F.struct(-F.col("total_tickets"), F.col("agent"))
    fast = F.struct(F.coalesce("median_hours", F.lit(float("inf"))), F.col("agent"))
    return stats.agg(
        F.min_by("agent", most).alias("volume_leader"),
        F.max("total_tickets").alias("volume_tickets"),
        F.min_by("share_pct", most).alias("volume_share_pct"),
        low("median_hours").alias("speed_leader"),
        F.min("median_hours").alias("speed_median_hours"),
        (F.min_by("median_hours", fast) * 60).alias("speed_median_minutes"),
        low("std_hours").alias("consistency_leader"),
        F.min("std_hours").alias("consistency_std_hours"))


def individual_vs_team(df: DataFrame, agent: str) -> DataFrame:
    """One agent against everybody: counts, mean, median, volume share and verdicts."""
    clean = filters.view(filters.drop_spam(df), "weekday")
    live = values.is_live_chat(F.col("pipeline"))
    who = F.array(F.lit("team"), F.when(F.col("case_owner") == agent, F.lit("agent")))
    scoped = clean.select(
        F.explode(F.array_compact(who)).alias("who"), live.alias("live"),
        F.when(~live, F.col(HOURS)).alias("v"))
    stats = summarize(scoped.select("who", "live", "v"), ["who", "live"], "v")
    of = lambda name, col: F.coalesce(
        F.max(F.when((F.col("who") == name) & ~F.col("live"), F.col(col))), F.lit(0))
    volume = lambda name: F.coalesce(
        F.sum(F.when(F.col("who") == name, F.col("n_rows"))), F.lit(0))
    one = stats.agg(
        of("agent", "n_rows").alias("agent_tickets"), of("agent", "mean").alias("agent_mean_hours"),
        of("agent", "median").alias("agent_median_hours"), volume("agent").alias("agent_volume"),
        of("team", "n_rows").alias("team_tickets"), of("team", "mean").alias("team_mean_hours"),
        of("team", "median").alias("team_median_hours"), volume("team").alias("team_volume"))
    verdict = lambda a, t: F.when(F.col(a) < F.col(t), "faster").otherwise("slower")
    return one.select(
        F.lit(agent).alias("agent"), "*",
        values.percent(F.col("agent_volume"), F.col("team_volume")).alias("volume_share_pct"),
        F.abs(F.col("team_mean_hours") - F.col("agent_mean_hours")).alias("mean_difference"),
        verdict("agent_mean_hours", "team_mean_hours").alias("mean_verdict"),
        F.abs(F.col("team_median_hours") - F.col("agent_median_hours")).alias("median_difference"),
        verdict("agent_median_hours", "team_median_hours").alias("median_verdict"))


def team_breakdown(df: DataFrame) -> DataFrame:
    """Responses, mean, median and spread per owner, three decimals, 0 where there is none."""
    rows = _response_rows(filters.drop_spam(df)).where(F.col("case_owner").isNotNull())
    stats = summarize(rows.select("case_owner", HOURS), ["case_owner"], HOURS)
    tidy = lambda c: F.coalesce(values.rounded(F.col(c), 3), F.lit(0.0))
    return stats.select(
        F.col("case_owner").alias("agent"), F.col("n").alias("responses"),
        tidy("mean").alias("mean_hours"), tidy("median").alias("median_hours"),
        tidy("std").alias("std_hours"))


def weekly_individual(df: DataFrame, agent: str) -> DataFrame:
    """Weekly medians and ticket counts of one agent and of everybody, 0 where there is none."""
    rows = _week(_response_rows(filters.drop_spam(df)))
    who = F.array(F.lit("team"), F.when(F.col("case_owner") == agent, F.lit("agent")))
    scoped = rows.select("week", F.explode(F.array_compact(who)).alias("who"), HOURS)
    stats = summarize(scoped, ["week", "who"], HOURS)
    of = lambda name, col, zero: F.coalesce(
        F.max(F.when(F.col("who") == name, F.col(col))), F.lit(zero))
    return stats.groupBy("week").agg(
        of("agent", "median", 0.0).alias("agent_median"), of("agent", "n_rows", 0).alias("agent_tickets"),
        of("team", "median", 0.0).alias("team_median"), of("team", "n_rows", 0).alias("total_tickets"))
