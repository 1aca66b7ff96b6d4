"""Tail probabilities and clustered effects against brute force."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.tails import f_p, incomplete_beta, log_gamma, student_p
from quillon.operators import econometrics as ec


def test_log_gamma_is_the_library_one(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 3.7, 10.0, 123.4, 1e5, 1e9]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", log_gamma(F.col("x")).alias("g")).collect()
    assert all(math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-11, abs_tol=1e-11) for r in got)


def beta_by_sum(a, b, x):
    """I(x; a, b) with whole a and b: a binomial tail."""
    n = a + b - 1
    return sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1))


def test_incomplete_beta_is_a_binomial_tail(spark):
    cases = [(a, b, x) for a in (1, 2, 5, 40) for b in (1, 3, 30) for x in (0.0, 0.01, 0.3, 0.5, 0.77, 0.999, 1.0)]
    rows = spark.createDataFrame([(float(a), float(b), x) for a, b, x in cases], "a double, b double, x double")
    got = rows.select(incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("i")).collect()
    assert all(math.isclose(r.i, beta_by_sum(*c), rel_tol=1e-9, abs_tol=1e-12) for r, c in zip(got, cases, strict=True))
    odd = spark.createDataFrame([(0.0, 1.0, 0.5), (1.0, 1.0, 1.5), (None, 1.0, 0.5)], "a double, b double, x double")
    assert [r.i for r in odd.select(incomplete_beta(F.col("a"), F.col("b"), F.col("x")).alias("i")).collect()] == [None] * 3


def test_student_and_f_tails(spark):
    cauchy = lambda t: 1 - 2 / math.pi * math.atan(t)
    two = lambda t: 1 - t / math.sqrt(2 + t * t)
    normal = lambda t: math.erfc(t / math.sqrt(2))
    rows = [(t, df) for t in (0.0, 0.3, 1.0, 2.5, 12.0) for df in (1, 2, 2_000_000)]
    got = spark.createDataFrame(rows, "t double, df long").select("t", "df", student_p(F.col("t"), F.col("df")).alias("p"), student_p(-F.col("t"), F.col("df")).alias("q"), f_p(F.col("t") ** 2, F.lit(1), F.col("df")).alias("f")).collect()
    for r in got:
        want = {1: cauchy, 2: two}.get(r.df, normal)(r.t)
        assert math.isclose(r.p, want, rel_tol=1e-4, abs_tol=1e-9) and r.p == r.q and math.isclose(r.p, r.f, rel_tol=1e-9, abs_tol=1e-12)


def brute(rows, xs):
    """Dummies for both effects, least squares, and a covariance clustered by unit with the factor n / df."""
    units, dates = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    y = np.array([r[2] for r in rows])
    d = np.zeros((len(rows), len(units) + len(dates) - 1))
    for k, r in enumerate(rows):
        d[k, units.index(r[0])] = 1
        if dates.index(r[1]):
            d[k, len(units) + dates.index(r[1]) - 1] = 1
    sweep = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    x, y = sweep(np.array(xs, dtype=float)), sweep(y)
    inv = np.linalg.pinv(x.T @ x, rcond=1e-12)
    b = inv @ x.T @ y
    e = y - x @ b
    df = len(rows) - x.shape[1] - len(units) - len(dates) + 1
    scores = np.array([(x * e[:, None])[[r[0] == u for r in rows]].sum(axis=0) for u in units])
    return b, inv @ scores.T @ scores @ inv * len(rows) / df, df


def panel(seed=3):
    rng = np.random.default_rng(seed)
    months = [date(2000 + m // 12, 1 + m % 12, 1) for m in range(48)]
    return [(method, u, t, float(rng.normal() + u + (0.5 * u if u < 2 and t >= date(2002, 1, 1) else 0))) for method in ("a", "b") for u in range(7) for t in months if rng.random() > 0.15]


def test_effects_by_unit_equal_dummy_regressions(spark):
    rows = panel()
    df = spark.createDataFrame([(*r, r[3] * 2 if r[1] % 2 else None) for r in rows] + [("a", None, date(2001, 1, 1), 1.0, 1.0), ("a", 1, date(2001, 1, 15), None, None)], "method string, currency long, date date, level double, slope double")
    cohorts = {"2002-01-01": [0, 1], "2002-07-01": [3], "1999-01-01": [4]}  # the last has no rows before it
    got = {(r.method, str(r.cohort), r.outcome, r.currency): r for r in ec.did_by_unit(df.withColumn("x", F.lit(1)), cohorts, ["level", "slope"], 12).collect()}
    assert {k for k in got if k[2] == "level"} == {(m, c, "level", u) for m in "ab" for c, us in list(cohorts.items())[:2] for u in us}
    for cohort, units in list(cohorts.items())[:2]:
        lo, mid, hi = (date.fromisoformat(cohort).replace(year=int(cohort[:4]) + k) for k in (-1, 0, 1))
        for m in "ab":
            own = [(u, t, y) for k, u, t, y in rows if k == m and u in (*units, 2, 5, 6) and lo <= t <= hi]
            b, v, dof = brute(own, [[float(u == w and t >= mid) for w in units] for u, t, _ in own])
            for i, u in enumerate(units):
                r = got[m, cohort, "level", u]
                assert math.isclose(r.coef, b[i], rel_tol=1e-8) and math.isclose(r.se, math.sqrt(v[i, i]), rel_tol=1e-8) and r.n == len(own)
                assert math.isclose(r.t_stat, r.coef / r.se) and 0 <= r.p_value <= 1
    assert ec.did_by_unit(df.where("false"), cohorts, ["level"], 12).count() == 0


def test_event_study_and_pre_trend_equal_dummy_regressions(spark):
    rng = np.random.default_rng(5)
    rows = [(u, date(2000 + m // 12, 1 + m % 12, 1), float(rng.normal())) for u in range(30) for m in range(30) if rng.random() > 0.1]
    df = spark.createDataFrame([(u, t, t, y, u % 2 == 0) for u, t, y in rows], "stock_id long, period date, date date, y double, treated boolean")
    event, reach = date(2001, 4, 1), 3
    rel = lambda t: max(-reach, min(reach, math.floor((t - event).days / 60)))
    steps = [k for k in range(-reach, reach + 1) if k != -1]
    b, v, dof = brute(rows, [[float(u % 2 == 0 and rel(t) == k) for k in steps] for u, t, _ in rows])
    got = {r.step: r for r in ec.event_study(df, "2001-04-01", 60, reach).collect()}
    for i, k in enumerate(steps):
        assert math.isclose(got[k].effect, b[i], rel_tol=1e-8) and math.isclose(got[k].se, math.sqrt(v[i, i]), rel_tol=1e-8)
    one = ec.pre_trend(df, "2001-04-01", 60, reach).first()
    pre = [i for i, k in enumerate(steps) if k < -1]
    wald = b[pre] @ np.linalg.solve(v[np.ix_(pre, pre)], b[pre])
    assert math.isclose(one.wald, wald, rel_tol=1e-6) and (one.df1, one.df2) == (len(pre), dof) and one.f_stat == pytest.approx(wald / len(pre))
    # An F with two and d degrees of freedom has the tail (1 + 2 f / d)^(-d / 2).
    assert one.p_value == pytest.approx((1 + 2 * one.f_stat / dof) ** (-dof / 2), rel=1e-6)
