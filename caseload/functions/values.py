"""Column expressions for names, ratings, durations, bins and text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseload import dims


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(col: Column, table: dict[str, str]) -> Column:
    """Value of a small fixed table, NULL when the key is absent."""
    items = ", ".join(_quoted(x) for pair in table.items() for x in pair)
    return F.try_element_at(F.expr(f"map({items})"), col)


def lookup_or_same(col: Column, table: dict[str, str]) -> Column:
    return F.coalesce(lookup(col, table), col)


def contains_any(col: Column, words: list[str]) -> Column:
    """One pattern and not a chain of tests, so that a derived ``col`` is evaluated once."""
    return col.rlike("|".join(re.escape(w) for w in words))


def staff_name(owner: Column) -> Column:
    return lookup_or_same(owner, dims.STAFF_ALIASES)


def team_member(owner: Column) -> Column:
    """Canonical team name, NULL for everybody else.

    Managers, tests and administrators need no rule of their own: no name of the table contains one
    of ``NON_TEAM_WORDS``.
    """
    return lookup(F.trim(F.lower(owner)), dims.TEAM_NAMES)


def is_team_member(owner: Column) -> Column:
    return F.trim(F.lower(owner)).isin(list(dims.TEAM_NAMES))


def pipeline_label(pipeline_id: Column) -> Column:
    return lookup_or_same(pipeline_id, dims.PIPELINE_LABELS)


def pipeline_display(pipeline: Column) -> Column:
    short = lookup_or_same(F.trim(pipeline), dims.PIPELINE_DISPLAY)
    return F.coalesce(short, F.lit("Unknown"))


def is_live_chat(pipeline: Column, strict_space: bool = False) -> Column:
    """NULL-safe test. ``strict_space`` accepts only the label with its trailing space."""
    if strict_space:
        return pipeline.eqNullSafe(F.lit(dims.LIVE_CHAT_SPACED))
    return F.rtrim(pipeline).eqNullSafe(F.lit(dims.LIVE_CHAT))


def agent_type(agent: Column, agents: dims.AgentRegistry = dims.AGENTS) -> Column:
    return (
        F.when(agent.isin(list(agents.bots)), "bot")
        .when(agent.isin(list(agents.humans)), "human")
        .otherwise("unknown")
    )


def agent_display(agent: Column, agents: dims.AgentRegistry = dims.AGENTS) -> Column:
    return F.coalesce(lookup(agent, agents.bots), lookup(agent, agents.humans), agent)


def agent_type_by_word(agent: Column, words: list[str] = dims.METRIC_BOT_WORDS) -> Column:
    text = F.lower(F.coalesce(agent, F.lit("")))
    return F.when(contains_any(text, words), "bot").otherwise("human")


def rating(text: Column) -> Column:
    """1 for a text with "bad", 5 for "good", a number from 1 to 5 as it is, else NULL."""
    low = F.trim(F.lower(text))
    number = low.try_cast("double")
    return (
        F.when(low.contains("bad"), F.lit(1.0))
        .when(low.contains("good"), F.lit(5.0))
        .when(number.between(1, 5), number)
    )


def score_text(score: Column) -> Column:
    return (
        F.when(score >= 4, "rated good").when(score <= 2, "rated bad").otherwise("not rated")
    )


def number(text: Column) -> Column:
    """Text as a number; junk and ``nan`` are NULL."""
    return F.nanvl(F.trim(text).try_cast("double"), F.lit(None).cast("double"))


def number_or_zero(text: Column) -> Column:
    return F.coalesce(number(text), F.lit(0.0))


def hms_hours(text: Column) -> Column:
    """``HH:mm[:ss]`` or a plain number as hours, junk as NULL."""
    parts = F.split(text, ":")
    piece = lambda i: number(F.get(parts, F.lit(i)))
    clock = piece(0) + piece(1) / 60
    return (
        F.when(~text.contains(":"), number(text))
        .when(F.size(parts) == 3, clock + piece(2) / 3600)
        .otherwise(clock)
    )


def response_bin(hours: Column) -> Column:
    """Right-closed bins; 0 belongs to the first one, negative values to none."""
    return (
        F.when((hours < 0) | hours.isNull(), F.lit(None).cast("string"))
        .when(hours <= 1, "< 1 hour")
        .when(hours <= 4, "1-4 hours")
        .when(hours <= 24, "4-24 hours")
        .when(hours <= 72, "1-3 days")
        .otherwise("3+ days")
    )


def time_period(hour: Column) -> Column:
    return (
        F.when((hour < 0) | (hour > 24) | hour.isNull(), F.lit(None).cast("string"))
        .when(hour <= 6, "Night (0-6)")
        .when(hour <= 12, "Morning (6-12)")
        .when(hour <= 18, "Afternoon (12-18)")
        .otherwise("Evening (18-24)")
    )


def response_verdict(hours: Column) -> Column:
    return (
        F.when(hours < 1, "Excellent - Under 1 hour average")
        .when(hours < 4, "Good - Under 4 hour average")
        .when(hours < 24, "Moderate - Same day response")
        .when(hours.isNotNull(), "Slow - Over 24 hour average")
    )


def decimals(number: Column, pattern: str = "0.0") -> Column:
    """Fixed decimals as text. ``format_number`` rounds the exact binary value half to even, while
    ``format_string`` rounds its shortest decimal form half up."""
    return F.call_function("format_number", number, F.lit(pattern))


def readable_ms(ms: Column) -> Column:
    """``250ms``, ``1.5s``, ``2.0m``; zero or missing is ``N/A``."""
    return (
        F.when(ms.isNull() | (ms == 0), "N/A")
        .when(ms < 1000, F.concat(ms.cast("bigint").cast("string"), F.lit("ms")))
        .when(ms < 60000, F.concat(decimals(ms / F.lit(1000.0)), F.lit("s")))
        .otherwise(F.concat(decimals(ms / F.lit(60000.0)), F.lit("m")))
    )


def truncate_text(text: Column, limit: int) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit("...[TRUNCATED]"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def rounded(number: Column, digits: int) -> Column:
    """Round half up. The detour over a decimal removes the binary noise below the twelfth digit, so
    that a value such as 35.4 / 24 = 1.475 is a tie and not just below one."""
    return F.round(number.try_cast("decimal(38,12)"), digits).cast("double")


def percent(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``part / whole * 100`` with a value for an empty whole."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100
    return share if empty is None else F.coalesce(share, F.lit(empty))
