"""Exact group quantiles against numpy, and the shape of the plan behind them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseload.operators.distribution import MEDIAN, QUARTILES, Rank, summarize


def _expected(values, p):
    return float(np.quantile(values, p)) if values else None


def _data(seed, n=4000):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        # A third of all rows has one key, and a third of those one value.
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", None])
        kind = rng.random()
        value = None if kind < 0.1 else 0.5 if kind < 0.4 else rng.randrange(0, 300_000) / 3600 - 5
        out.append((key, rng.randrange(3), value))
    return out + [("empty", 0, None), ("one", 0, 7.25)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_numpy(rows, seed):
    data = _data(seed)
    got = {r["k"]: r for r in summarize(rows(data, "k string, z int, v double"), ["k"], "v", QUARTILES).collect()}
    assert set(got) == {k for k, _, _ in data}
    for key, r in got.items():
        mine = [v for k, _, v in data if k == key and v is not None]
        assert r["n_rows"] == sum(k == key for k, _, _ in data)
        assert r["n"] == len(mine)
        for name, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
            want = _expected(mine, p)
            assert (r[name] is None) == (want is None)
            assert want is None or r[name] == pytest.approx(want, abs=1e-12)
        if len(mine) > 1:
            assert r["std"] == pytest.approx(np.std(mine, ddof=1), rel=1e-9)
        else:
            assert r["std"] is None
        if mine:
            assert (r["min"], r["max"]) == (min(mine), max(mine))
            assert r["mean"] == pytest.approx(np.mean(mine), rel=1e-12)


def test_two_keys_and_no_key(rows):
    data = _data(9)
    df = rows(data, "k string, z int, v double")
    two = {(r["k"], r["z"]): r["median"] for r in summarize(df, ["k", "z"], "v", MEDIAN).collect()}
    for (k, z), m in two.items():
        assert m == pytest.approx(_expected([v for a, b, v in data if (a, b) == (k, z) and v is not None], 0.5))
    whole = summarize(df, [], "v", MEDIAN).collect()
    assert len(whole) == 1
    assert whole[0]["median"] == pytest.approx(_expected([v for *_, v in data if v is not None], 0.5))


def test_upper_median_and_weights(rows):
    df = rows([(1.0, 1), (2.0, 1), (3.0, 1), (10.0, 1)], "v double, w bigint")
    assert summarize(df, [], "v", {"m": Rank(upper=True)}).first()["m"] == 3.0
    assert summarize(df, [], "v", MEDIAN).first()["median"] == 2.5
    heavy = rows([(1.0, 5), (2.0, 1), (9.0, 3)], "v double, w bigint")
    r = summarize(heavy, [], "v", MEDIAN, weight="w").first()
    assert (r["median"], r["n"], r["n_rows"]) == (1.0, 9, 9)


def test_empty_input(rows):
    assert summarize(rows([], "k string, v double"), ["k"], "v").collect() == []
    assert summarize(rows([], "k string, v double"), [], "v").collect() == []


def test_hot_group_is_spread_by_value(spark, rows):
    """Rows are shuffled by group and value, never by the group alone, and the input is read once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = summarize(spark.range(1000).selectExpr("'x' AS k", "id / 7 AS v"), ["k"], "v")
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Range (") == 1 or "ReusedExchange" in plan
    first = [line for line in plan.splitlines() if "hashpartitioning" in line][-1]
    assert "v#" in first


def test_exact_for_values_within_one_cell(rows):
    data = [(float(i) / 1e6,) for i in range(999)]
    r = summarize(rows(data, "v double"), [], "v", QUARTILES).first()
    flat = [v for v, in data]
    assert [r["q25"], r["median"], r["q75"]] == pytest.approx(list(np.quantile(flat, [0.25, 0.5, 0.75])), abs=1e-15)


def test_cells_follow_the_order_of_values(spark):
    from caseload.operators.distribution import CELL

    df = spark.range(-200_000, 200_000).selectExpr("pow(id / 1000, 3) / 50 AS v").selectExpr("v", f"{CELL} AS cell")
    cells = [r["cell"] for r in df.orderBy("v").collect()]
    assert cells == sorted(cells)
    year = spark.range(0, 8766 * 60).selectExpr("id / 60 AS v").selectExpr(f"{CELL} AS cell")
    assert year.distinct().count() < 3100


def test_negative_and_large_values(rows):
    data = [(float(x),) for x in (-5000, -7.5, -6, -5.99, -0.01, 0, 0.01, 5.99, 6, 6.01, 9000.5, 1e7)]
    got = summarize(rows(data, "v double"), [], "v", QUARTILES).first()
    want = list(np.quantile([v for v, in data], [0.25, 0.5, 0.75]))
    assert [got["q25"], got["median"], got["q75"]] == pytest.approx(want)


def test_group_of_nulls_only_keeps_its_row(rows):
    r = summarize(rows([("a", None), ("a", None)], "k string, v double"), ["k"], "v").select(
        "*", F.lit(1).alias("one")).collect()
    assert [(x["k"], x["n_rows"], x["n"], x["median"]) for x in r] == [("a", 2, 0, None)]


def test_nan_and_infinity_count_as_missing(rows):
    data = [(float("nan"),), (float("inf"),), (float("-inf"),), (3.0,), (1.0,)]
    r = summarize(rows(data, "v double"), [], "v").first()
    assert (r["n_rows"], r["n"], r["median"], r["max"]) == (5, 2, 2.0, 3.0)
