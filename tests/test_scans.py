"""Sliced scans against the plain forms, on groups that cover several slices."""

import random
import re
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import joins, scans, windows

DAY = date(2000, 1, 1)


def frames(spark, seed=1):
    rng = random.Random(seed)
    key = lambda: rng.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(k, key(), None if rng.random() < 0.03 else DAY + timedelta(rng.randrange(300))) for k in range(800)]
    right = [(key(), None if rng.random() < 0.03 else DAY + timedelta(rng.randrange(300)), k) for k in range(200)]
    return spark.createDataFrame(left, "id long, key string, date date"), spark.createDataFrame(right, "key string, seen date, x long")


@pytest.mark.parametrize("hot", [0, 300, 10**9])
def test_skewed_asof_join_equals_the_plain_one(spark, hot):
    left, right = frames(spark)
    rows = lambda df: sorted(((r.id, r.key, r.date, r.seen, r.x) for r in df.collect()), key=str)
    assert rows(scans.asof_join_skewed(left, right, "key", "date", "seen", hot, 7)) == rows(joins.asof_join(left, right, "key", "date", "seen"))
    with pytest.raises(ValueError):
        scans.asof_join_sliced(left, right.withColumnRenamed("x", "date"), "key", "date", "seen")


def test_a_hot_key_covers_many_slices(spark):
    left, _ = frames(spark)
    spread = scans.sliced(left, ["key"], [F.col("date"), F.col("id")], 8).where("key = 'hot'").groupBy("_slice").count().collect()
    assert len(spread) >= 4 and max(r["count"] for r in spread) < 0.5 * sum(r["count"] for r in spread)
    assert scans.last_known(left.where("false"), ["key"], [F.col("date")], "id", "last", 3).count() == 0


def series(spark):
    rng = random.Random(4)
    rows = [(k, t, None if rng.random() < 0.05 else rng.gauss(0, 0.1)) for k in ("hot", "b", None) for t in range(400 if k == "hot" else 12) if rng.random() > 0.05]
    return rows, spark.createDataFrame(rows, "key string, t long, r double")


def test_long_drawdown_equals_the_loop(spark):
    rows, df = series(spark)
    got = {(r.key, r.t): (r.curve, r.drawdown) for r in scans.long_drawdown(df, "r", ["key"], "t", 6).collect()}
    assert len(got) == len(rows)
    for key in ("hot", "b", None):
        own = sorted((t, r or 0.0) for k, t, r in rows if k == key)
        curve = np.cumprod([1 + r for _, r in own])
        want = curve / np.maximum.accumulate(curve) - 1
        assert np.allclose([got[key, t] for t, _ in own], list(zip(curve, want, strict=True)))


def test_long_ema_equals_the_window_form(spark):
    _, df = series(spark)
    rows = lambda x: sorted(((r.key or "", r.t, r.ema) for r in x.collect()), key=lambda v: v[:2])
    got, want = rows(scans.long_ema(df, "r", ["key"], 0.7, parts=6)), rows(windows.ema(df, "r", ["key"], 0.7))
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all((g[2] is None) == (w[2] is None) and (g[2] is None or abs(g[2] - w[2]) < 1e-12) for g, w in zip(got, want, strict=True))


def crowd(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice(["p", "p", "p", "q", None]), None if rng.random() < 0.05 else float(rng.choice([rng.randrange(20), rng.gauss(0, 9)]))) for k in range(900)]
    return rows, spark.createDataFrame(rows, "id long, g string, v double")


def test_long_ranks_equal_the_window_form(spark):
    _, df = crowd(spark)
    got = {r.id: r.k for r in scans.long_average_rank(df, "v", ["g"], "k", 6).collect()}
    want = {r.id: r.k for r in windows.average_rank(df.where("v is not null"), "v", ["g"], "k").collect()}
    assert len(got) == 900 and {i: k for i, k in got.items() if k is not None} == want


def test_long_quantiles_are_exact(spark):
    rows, df = crowd(spark)
    shares = {"low": 0.01, "median": 0.5, "high": 0.99, "least": 0.0, "most": 1.0}
    got = {r.g: r for r in scans.long_quantiles(df, ["g"], "v", shares, 6).collect()}
    for g in ("p", "q", None):
        own = [v for _, k, v in rows if k == g and v is not None]
        assert np.allclose([got[g][n] for n in shares], [np.quantile(own, q) for q in shares.values()])
    both = scans.with_quantiles(df, ["g"], "v", {"m": 0.5}, 6)
    assert both.count() == 900 and {(r.g, r.m) for r in both.select("g", "m").distinct().collect()} == {(g, r.median) for g, r in got.items()}
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"windowspecdefinition\(g#", plan) and not re.search(r"windowspecdefinition\(g#\d+, (?!_slice)", plan)  # over slices' summaries only


def test_groups_of_one_value_and_empty_frames(spark):
    df = spark.createDataFrame([(k, "g", 1.0) for k in range(50)], "id long, g string, v double")
    assert {r.k for r in scans.long_average_rank(df, "v", ["g"], "k", 4).collect()} == {25.5}
    assert scans.long_quantiles(df.where("false"), ["g"], "v", {"m": 0.5}, 4).count() == 0
