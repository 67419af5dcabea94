"""Exact order statistics and moments per group without gathering a group in one task.

``median`` and ``percentile`` keep every distinct value of a group in one buffer. Here the rows are
first counted by (group, value), a shuffle that spreads a hot group over all tasks. A histogram then
locates the cells that hold the wanted ranks, and only the values of those cells are ordered. Cells
are one minute wide up to six hours and 0.27 percent of the value beyond, so a group has about 3 000
cells for values up to a year, however many rows it has, and a cell spans four minutes at a day.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Values are hours. Any monotone mapping of value to cell gives the same result.
CELL = ("CAST(if(abs(v) < 6, floor(v * 60), signum(v) * (360 + floor(log2(abs(v) / 6) * 256))) AS BIGINT)")
NO_CELL = -(10**18)
# A table with this column has rows that stand for several tickets (see ``rollup``).
WEIGHT = "n_tickets"


def weight_of(df: DataFrame) -> str | None:
    return WEIGHT if WEIGHT in df.columns else None


def counted_rows(df: DataFrame) -> Column:
    """The number of tickets of a group."""
    return F.sum(WEIGHT) if weight_of(df) else F.count("*")


def mean_of(df: DataFrame, value: str) -> Column:
    """The mean over the tickets of a group that have a value."""
    if not weight_of(df):
        return F.avg(value)
    return F.sum(F.col(value) * F.col(WEIGHT)) / F.sum(F.when(F.col(value).isNotNull(), F.col(WEIGHT)))


@dataclass(frozen=True)
class Rank:
    """Which order statistic to take: ``p`` with linear interpolation, or the upper median."""

    p: float = 0.5
    upper: bool = False

    def bounds(self) -> tuple[str, str, str]:
        """Zero-based lower rank, upper rank and the weight of the upper one, as SQL over ``n``."""
        if self.upper:
            return "floor(n / 2)", "floor(n / 2)", "0D"
        at = f"(n - 1) * {float(self.p)}D"
        return f"floor({at})", f"ceil({at})", f"{at} - floor({at})"


MEDIAN = {"median": Rank()}
QUARTILES = {"q25": Rank(0.25), "median": Rank(), "q75": Rank(0.75)}


def summarize(
    df: DataFrame,
    keys: list[str],
    value: str,
    ranks: dict[str, Rank] | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per group: ``n_rows`` (all rows), ``n`` (rows with a value), mean, std, min, max and
    one column for each entry of ``ranks``. NaN and infinities count as missing. A group without any
    value keeps its row, with NULLs. ``weight`` says how many rows a row stands for.
    """
    ranks = MEDIAN if ranks is None else ranks
    group = f"struct({', '.join(f'`{k}`' for k in keys)})" if keys else "0"
    # The cell is never NULL: the join below then adds no filter under the aggregate, and both uses of
    # these counts share one shuffle.
    counted = (
        df.selectExpr(f"{group} AS g", f"`{value}` AS v", f"{weight or 1} AS w")
        .groupBy("g", "v").agg(F.expr("sum(w) AS w"))
        # After the grouping this is a test of a plain column for each distinct value, not for each row.
        .selectExpr("g", "if(abs(v) < double('infinity'), v, NULL) AS v", "w")
        .selectExpr("g", "v", "w", f"coalesce({CELL}, {NO_CELL}L) AS cell")
    )
    cells = counted.groupBy("g", "cell").agg(*map(F.expr, [
        "sum(w) AS rows",
        "sum(if(v IS NULL, 0, w)) AS w",
        "sum(v * w) AS s",
        "sum(v * v * w) AS sq",
        "min(v) AS lo",
        "max(v) AS hi",
    ]))
    placed = cells.selectExpr(
        "*",
        "sum(w) OVER (PARTITION BY g ORDER BY cell ROWS UNBOUNDED PRECEDING) AS end",
        "row_number() OVER (PARTITION BY g ORDER BY cell) AS pos",
        "sum(rows) OVER (PARTITION BY g) AS n_rows",
        "sum(w) OVER (PARTITION BY g) AS n",
        "sum(s) OVER (PARTITION BY g) / nullif(sum(w) OVER (PARTITION BY g), 0) AS mean",
        "min(lo) OVER (PARTITION BY g) AS min",
        "max(hi) OVER (PARTITION BY g) AS max",
    )
    totals = ["n_rows", "n", "mean", "m2", "min", "max"]
    wanted = ", ".join(
        f"struct({2 * i + side} AS rid, {rank.bounds()[side]} AS at)"
        for i, rank in enumerate(ranks.values()) for side in (0, 1))
    targets = (
        placed.selectExpr(
            "*",
            f"filter(array({wanted}), r -> r.at >= end - w AND r.at < end) AS here",
            # Spread inside a cell plus spread of the cell means: no cancellation of large squares.
            "sum(greatest(sq - s * s / nullif(w, 0), 0D) + w * pow(s / nullif(w, 0) - mean, 2))"
            " OVER (PARTITION BY g) AS m2")
        .where("pos = 1 OR size(here) > 0")
        .selectExpr("g", "cell", "end - w AS start", *totals, "explode_outer(here) AS r")
        # Rows that only carry the totals have no cell and match nothing below.
        .selectExpr("g", *totals, "r.rid AS rid", "if(r IS NULL, NULL, cell) AS cell", "r.at - start AS skip")
    )
    picked = (
        targets.join(counted, ["g", "cell"], "left")
        .selectExpr("*", "sum(w) OVER (PARTITION BY g, cell, rid ORDER BY v ROWS UNBOUNDED PRECEDING) AS upto")
        .where("rid IS NULL OR upto IS NULL OR (skip >= upto - w AND skip < upto)")
    )
    found = picked.groupBy("g").agg(*map(F.expr, [
        *[f"max({c}) AS {c}" for c in totals],
        *[f"max(if(rid = {j}, v, NULL)) AS at{j}" for j in range(2 * len(ranks))],
    ]))
    return found.selectExpr(
        *[f"g.`{k}` AS `{k}`" for k in keys], "n_rows", "n", "mean",
        "if(n > 1, sqrt(m2 / (n - 1)), NULL) AS std", "min", "max",
        *[f"at{2 * i} + (at{2 * i + 1} - at{2 * i}) * ({rank.bounds()[2]}) AS `{name}`"
          for i, (name, rank) in enumerate(ranks.items())])
