"""The risk model over periods present, composites, and Fama-MacBeth runs, against loops."""

import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import portfolio, validate, windows

QUARTERS = [date(2000 + q // 4, 1 + 3 * (q % 4), 1) for q in range(14)]


def test_present_periods_number_what_there_is(spark):
    gaps = [QUARTERS[k] for k in (0, 1, 5, 9)]
    rows = portfolio.present_periods(spark.createDataFrame([(n, q) for q in gaps for n in range(2)] + [(9, None)], "stock_id long, period date"))
    assert {(r.period, r.t) for r in rows.collect()} == {(q, k + 1) for k, q in enumerate(gaps)}


def test_covariance_takes_the_last_periods_present_and_fills_gaps(spark):
    rng = random.Random(2)
    have = [q for k, q in enumerate(QUARTERS) if k not in (3, 8)]
    long = [(q, f, rng.gauss(0, 0.1)) for q in have for f in ("const", "a", "b") if not (f == "b" and q == have[4])]
    got = {(r.period, r.a, r.b): (r["cov"], r.delta) for r in portfolio.present_covariance(spark.createDataFrame(long, "period date, factor string, f double"), ["const", "a", "b"], 6).collect()}
    value = {(q, f): v for q, f, v in long}
    for k in range(1, len(have)):
        x = np.array([[value.get((q, f), 0.0) for f in ("const", "a", "b")] for q in have[max(0, k - 5) : k + 1]])
        z = (x - x.mean(axis=0)) / x.std(axis=0)
        s, t = z.T @ z / len(z), len(z)
        d2 = ((s - np.trace(s) / 3 * np.eye(3)) ** 2).sum()
        b2 = min(max((((z**2).sum(axis=1) ** 2).mean() - (s**2).sum()) / t, 0), d2)
        delta = b2 / d2 if d2 > 1e-12 else 0.0
        want = np.where(np.eye(3) == 1, s, s * (1 - delta)) * np.outer(x.std(axis=0), x.std(axis=0))
        for i, a in enumerate(("const", "a", "b")):
            for j, b in enumerate(("const", "a", "b")):
                if i <= j:
                    assert got[have[k], a, b] == pytest.approx((want[i, j], delta), abs=1e-12)


def test_walk_forward_ic_is_shrunk(spark):
    rng = random.Random(5)
    ic = [(q, f, rng.gauss(0.02 * k, 0.1)) for q in QUARTERS for k, f in enumerate("abcde")]
    got = {(r.period, r.factor): r.ic for r in portfolio.walk_forward_ic(spark.createDataFrame(ic, "period date, factor string, ic double"), 8, 1).collect()}
    seen = {f: np.array([v for q, g, v in ic if g == f and q < QUARTERS[-1]]) for f in "abcde"}
    mean, se2 = {f: x.mean() for f, x in seen.items()}, np.mean([x.var(ddof=1) / len(x) for x in seen.values()])
    bar = np.mean(list(mean.values()))
    b = min(max(2 * se2 / sum((m - bar) ** 2 for m in mean.values()), 0), 1)
    assert all(got[QUARTERS[-1], f] == pytest.approx(bar + (1 - b) * (m - bar)) for f, m in mean.items()) and got[QUARTERS[5], "a"] is None


def test_composites_are_standardised_again(spark):
    rows = [(1, QUARTERS[0], 1.0, 2.0), (2, QUARTERS[0], None, 4.0), (3, QUARTERS[0], None, None), (4, QUARTERS[0], -1.0, 1.0), (1, QUARTERS[1], 1.0, 1.0), (2, QUARTERS[1], 1.0, 1.0), (1, QUARTERS[2], 3.0, None)]
    got = {(r.stock_id, r.period): r.c for r in validate.composite(spark.createDataFrame(rows, "stock_id long, period date, a double, b double"), ["a", "b"], "c").collect()}
    x = np.array([1.5, 4.0, 0.0])
    z = (x - x.mean()) / x.std(ddof=1)
    assert [got[k, QUARTERS[0]] for k in (1, 2, 4)] == pytest.approx(z.tolist()) and got[3, QUARTERS[0]] is None
    assert {got[k] for k in got if k[1] != QUARTERS[0]} == {0.0}


@pytest.mark.parametrize("pooled", [True, False])
def test_fama_macbeth_runs_equal_one_regression_each(spark, pooled):
    rng = random.Random(8)
    rows = [(q, s, *[None if rng.random() < 0.05 else rng.gauss(0, 1) for _ in range(5)]) for q in QUARTERS[:4] for s in ("bank", "bank", "life", "pc", None) for _ in range(12)]
    rows += [(QUARTERS[5], "bank", 0.1, 0.2, 0.3, 0.4, 0.5)]  # too few for any run
    df = spark.createDataFrame(rows, "period date, industry string, y double, a double, b double, nim double, fiy double")
    member = {"bank": F.col("industry") == "bank", "insurance": F.col("industry").isin("life", "pc")}
    got = {(r.sub_universe, r.period, r.factor): r.coef for r in validate.fama_macbeth_runs(df, "y", ["a", "b"], {"bank": ["nim"], "insurance": ["fiy"]}, member, pooled).collect()}
    sector = {"bank": {"bank"}, "insurance": {"life", "pc"}}
    want = {}
    for run in ([("all", [3, 4, 5, 6], [3, 4])] if pooled else []) + [("bank", [3, 4, 5], [5] if pooled else [3, 4, 5]), ("insurance", [3, 4, 6], [6] if pooled else [3, 4, 6])]:
        for q in QUARTERS[:4]:
            x, y = [], []
            for r in rows:
                inside = r[1] in (sector[run[0]] if run[0] != "all" else {"bank", "life", "pc"})
                v = [0.0 if run[0] == "all" and ((c == 5 and r[1] != "bank") or (c == 6 and r[1] == "bank")) else r[c] for c in run[1]]
                if r[0] == q and inside and r[2] is not None and None not in v:
                    x.append([1.0, *v])
                    y.append(r[2])
            beta = np.linalg.lstsq(np.array(x), np.array(y), rcond=None)[0]
            names = ["const", *["period industry y a b nim fiy".split()[c] for c in run[1]]]
            told = {"const", *["period industry y a b nim fiy".split()[c] for c in run[2]]}
            want |= {(run[0], q, n): b for n, b in zip(names, beta, strict=True) if n in told}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_nearest_bounds_are_values_of_the_cross_section(spark):
    rng = random.Random(1)
    rows = [(k, QUARTERS[k % 2], None if k % 17 == 0 else rng.gauss(0, 1)) for k in range(300)]
    got = {r.k: r.x for r in windows.winsorize(spark.createDataFrame(rows, "k long, period date, x double"), {"x": F.lit(True)}, 0.05, 0.95, interpolation="nearest").collect()}
    for q in QUARTERS[:2]:
        own = np.sort([x for _, p, x in rows if p == q and x is not None])
        lo, hi = own[round((len(own) - 1) * 0.05)], own[round((len(own) - 1) * 0.95)]
        assert all(got[k] == (None if x is None else min(max(x, lo), hi)) for k, p, x in rows if p == q)
