"""The factorised sweep and its ledger against loops over settings, books and periods."""

import math
import random
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.operators import sweep as sw

QUARTERS = [date(2000 + q // 4, 1 + 3 * (q % 4), 1) for q in range(12)]


def cells(seed=1):
    """Books whose names come and go, with gaps, large gains and losses, and one that is wiped out."""
    rng = random.Random(seed)
    rows = []
    for book in ("a", "b", "wiped"):
        for k, q in enumerate(QUARTERS):
            if book == "b" and k == 5:
                continue  # a period without a book
            for name in range(8):
                if rng.random() < 0.3:
                    continue
                r = None if rng.random() < 0.1 else rng.gauss(0.01, 0.2)
                if book == "wiped" and k == 4:
                    r = -1.5
                rows.append((book, q, name, rng.gauss(0.3 if book == "wiped" else 0.05, 0.2), r, rng.random() * 0.01, None if name == 3 else rng.gauss(1, 0.3)))
    return rows


def loop(rows, book, leverage, gone):
    """One period after the other."""
    held, out = {}, []
    for q in sorted({x[1] for x in rows if x[0] == book}):
        own = {x[2]: x for x in rows if x[0] == book and x[1] == q}
        total = sum(abs(x[3]) for x in own.values())
        s = leverage / total if leverage and total > leverage else 1.0
        w = {n: x[3] * s for n, x in own.items()}
        tc_exit = sum(abs(h) * c for n, (h, c) in held.items() if n not in own and not (n in gone and gone[n] <= q))
        step = {n: abs(w[n] - held.get(n, (0.0, 0))[0]) for n in own}
        tc_trade = sum(step[n] * own[n][5] for n in own)
        gross = sum(w[n] * (own[n][4] or 0.0) for n in own)
        net = gross - tc_trade - tc_exit
        out.append((q, gross, tc_trade, tc_exit, net, sum(step.values()), sum(map(abs, w.values())), sum(w.values()), len(own), sum(own[n][4] is None for n in own), sum(w[n] * (own[n][6] or 0.0) for n in own)))
        held = {n: (w[n] * (1 + (own[n][4] or 0.0)) / (1 + net), own[n][5]) for n in own} if 1 + net > 1e-3 else {}
    return out


def test_ledger_equals_the_loop(spark):
    rows, gone = cells(), {1: QUARTERS[3], 6: QUARTERS[0]}
    df = spark.createDataFrame(rows, "book string, period date, stock_id long, w double, r double, c double, beta double")
    exits = spark.createDataFrame(list(gone.items()) + [(6, QUARTERS[9])], "stock_id long, period date")
    for leverages in ([0.5, 1.0, 99.0], None):
        got = sw.ledger(df.withColumn("x", F.lit(1)), ["book"], leverages, exits).orderBy("period").collect()
        for book in ("a", "b", "wiped"):
            for lev in leverages or [None]:
                mine = [r for r in got if r.book == book and r.leverage == lev]
                for r, want in zip(mine, loop(rows, book, lev, gone), strict=True):
                    have = (r.period, r.gross, r.tc_trade, r.tc_exit, r.net, r.turnover, r.gross_lev, r.net_exp, r.n_names, r.n_return_gaps, r.mkt_beta)
                    assert have[0] == want[0] and np.allclose(have[1:], want[1:], atol=1e-8)
                    assert r.tc == pytest.approx(r.tc_trade + r.tc_exit) and r.n_long + r.n_short == r.n_names
    assert sw.ledger(df.where("false"), ["book"], [1.0]).count() == 0


def test_headline_figures(spark):
    rng = random.Random(2)
    rows = [("a", q, rng.gauss(0.02, 0.05), 0.5, 0.001, 1.5, 0.1, 0.9, k % 3, None if k == 4 else rng.gauss(0.01, 0.04), None if k == 5 else rng.gauss(0.01, 0.04), 0.001) for k, q in enumerate(QUARTERS)]
    df = spark.createDataFrame(rows, "book string, period date, net double, turnover double, tc double, gross_lev double, net_exp double, mkt_beta double, n_return_gaps long, mkt double, bench double, rf double")
    r = sw.headline(df, ["book"]).first()
    net = np.array([x[2] for x in rows])
    sharpe = lambda x: x.mean() / x.std(ddof=1) * 2
    curve = np.cumprod(1 + net)
    hedged = net - 0.001 - np.array([0.9 * x[9] if x[9] is not None else 0.0 for x in rows])
    want = (12, curve[-1] ** (4 / 12) - 1, net.std(ddof=1) * 2, sharpe(net), sharpe(hedged), (curve / np.maximum.accumulate(curve) - 1).min(), sharpe(net - np.array([x[10] or 0.0 for x in rows])), 0.5, 10.0, 1.5, 0.1, 0.9, 12)
    assert np.allclose(list(r)[1:], want)


def factor_frames(spark):
    rng = random.Random(4)
    factors = ["f", "g", "h", "i", "j"]
    ic = [(q, f, rng.gauss(0.03 * (k - 1), 0.1)) for q in QUARTERS for k, f in enumerate(factors)]
    premia = [(q, f, rng.gauss(0.01 * k, 0.02)) for q in QUARTERS for k, f in enumerate(factors)]
    scores = [(n, q, *[None if rng.random() < 0.2 else rng.gauss(0, 1) for _ in factors]) for q in QUARTERS for n in range(20)]
    return factors, ic, premia, scores


def test_partial_settings_equal_a_loop_and_read_scores_once(spark):
    factors, ic, premia, scores = factor_frames(spark)
    first, last = str(QUARTERS[8]), str(QUARTERS[11])
    frames = spark.createDataFrame(ic, "period date, factor string, ic double"), spark.createDataFrame(premia, "period date, factor string, coef double")
    schedule = sw.schedules(spark, [3, 6, 60], first, last)
    active = sw.active_factors(frames[0], schedule, 0.4, last)
    thetas = sw.factor_thetas(frames[1], frames[0], active, factors).cache()
    table = sw.materialize(spark.createDataFrame(scores, "stock_id long, period date, " + ", ".join(f"{f} double" for f in factors)), "test-scores")
    made = sw.partial_returns(table, thetas, factors)
    assert made.select("alloc", "js", "reselect").distinct().count() == 12
    assert made._jdf.queryExecution().executedPlan().toString().count("test-scores") == 1  # all twelve in one scan of the scores
    got = {(r.alloc, r.js, r.reselect, r.period, r.stock_id): r.mu for r in made.collect()}

    def known(series, f, q):
        x = np.array([v for p, g, v in series if g == f and p < q])
        return (x.mean(), x.var(ddof=1) / len(x), x.std(ddof=1)) if len(x) >= 8 else (None, None, None)

    checked = 0
    for months in (3, 6, 60):
        cuts = [q for k, q in enumerate(QUARTERS[8:]) if k % (months // 3) == 0]
        for q in QUARTERS[8:]:
            chosen = []
            for cut in [c for c in cuts if c <= q]:
                own = []
                for f in factors:
                    x = np.array([v for p, g, v in ic if g == f and p <= cut])
                    if abs(x.mean() / x.std(ddof=1)) > 0.4:
                        own.append(f)
                chosen = own or chosen
            prem = {f: known(premia, f, q) for f in factors}
            bar, se2 = np.mean([v[0] for v in prem.values()]), np.mean([v[1] for v in prem.values()])
            b = min(max(2 * se2 / sum((v[0] - bar) ** 2 for v in prem.values()), 0), 1)
            for js in (0, 1):
                value = {f: bar + (1 - b * js) * (v[0] - bar) for f, v in prem.items()}
                for alloc in ("equal", "ir_weighted"):
                    size = {f: 1.0 if alloc == "equal" else abs(known(ic, f, q)[0] / known(ic, f, q)[2]) for f in chosen}
                    for n, p, *z in scores:
                        if p == q and chosen and any(v is not None for v in z):
                            want = sum(size[f] / sum(size.values()) * value[f] * (z[factors.index(f)] or 0.0) for f in chosen)
                            assert math.isclose(got[alloc, js, months, q, n], want, rel_tol=1e-9, abs_tol=1e-12)
                            checked += 1
    assert checked == len(got) > 500


def test_steps_are_capped_then_centred(spark):
    rows = [("p", QUARTERS[0], n, m, 0.04, 0.001) for n, m in enumerate([0.0005, 0.01, -0.02, 0.5, 0.003])]
    df = spark.createDataFrame(rows, "partial string, period date, stock_id long, mu double, d double, c double")
    got = sw.stepped(df, ["partial"], [1.0, 5.0], [0.05, 0.1]).collect()
    for ra in (1.0, 5.0):
        for cap in (0.05, 0.1):
            raw = np.array([np.clip(np.sign(m) * max(abs(m) - 0.001, 0) / (ra * 0.04), -cap, cap) for _, _, _, m, _, _ in rows])
            mine = sorted((r.stock_id, r.w) for r in got if r.ra == ra and r.mnw == cap)
            assert np.allclose([w for _, w in mine], raw - raw.mean())


def test_leaderboard_marginals_interactions_and_slices(spark):
    rows = [(f"s{a}{b}{c}", a, b, float(c), (a * 3 + b * 2 + c) % 7 * 1.0 if (a, b, c) != (1, 1, 1) else None) for a in range(2) for b in range(3) for c in range(2)]
    df = spark.createDataFrame(rows, "strategy_id string, a int, b int, c double, obj double")
    best = sorted(rows, key=lambda r: (r[4] is None, -(r[4] or 0), r[0]))[:5]
    assert [(r.place, r.strategy_id) for r in sw.leaderboard(df, "obj", 5).orderBy("place").collect()] == [(k + 1, r[0]) for k, r in enumerate(best)]
    m = {(r.knob, r.value): (r["mean"], r.low, r.high, r.n) for r in sw.marginals(df, ["a", "b", "c"], "obj").collect()}
    own = [r[4] for r in rows if r[2] == 1 and r[4] is not None]
    assert len(m) == 7 and m["b", "1"] == (np.mean(own), min(own), max(own), len(own))
    i = {(r.knob_a, r.value_a, r.knob_b, r.value_b): r["mean"] for r in sw.interactions(df, ["a", "b", "c"], "obj").collect()}
    assert len(i) == 6 + 4 + 6 and i["a", "0", "b", "2"] == np.mean([r[4] for r in rows if r[1] == 0 and r[2] == 2])
    s = {(r.knob, r.value): (r.obj, r.gain) for r in sw.one_knob_slices(df, {"a": 0, "b": 1, "c": 1.0}, "obj").collect()}
    base = next(r[4] for r in rows if r[1:4] == (0, 1, 1.0))
    assert set(s) == {("a", "0"), ("a", "1"), ("b", "0"), ("b", "1"), ("b", "2"), ("c", "0.0"), ("c", "1.0")}
    assert s["b", "2"][1] == next(r[4] for r in rows if r[1:4] == (0, 2, 1.0)) - base and s["a", "0"] == (base, 0.0) and s["a", "1"] == (None, None)


def test_a_swept_ledger_equals_that_of_its_books_and_stores_none(spark, monkeypatch):
    rng = random.Random(7)
    rows = [(n, q, rng.gauss(0, 1), None if rng.random() < 0.1 else rng.gauss(0.01, 0.2), rng.random() * 0.01, None if n == 3 else rng.gauss(1, 0.3)) for q in QUARTERS for n in range(9) if rng.random() < 0.7]
    base = spark.createDataFrame(rows, "stock_id long, period date, z double, r double, c double, beta double")
    settings = [(f"{tilt}|{lev}|{centred}", tilt, lev, centred) for tilt in (0.1, 0.5) for lev in (0.3, 2.0) for centred in (True, False)]
    wide = [(s[0], s[1] * (1 + 0.3 * i), *s[2:], q) for k, s in enumerate(settings) for i, q in enumerate(QUARTERS) if (i + k) % 5]  # each book lacks other periods
    settled = spark.createDataFrame(wide, "book string, tilt double, leverage double, centred boolean, period date")
    exits = spark.createDataFrame([(1, QUARTERS[3]), (6, QUARTERS[0])], "stock_id long, period date")
    stored, write = [], sw.materialize

    def counted(df, what, *rest):
        out = write(df, what, *rest)
        stored.append(out.count())
        return out

    monkeypatch.setattr(sw, "materialize", counted)
    got = {(r.book, r.period): r for r in sw.swept_ledger(base, settled, ["book"], lambda x: F.least(x("z") * x("tilt"), F.lit(0.4)), lambda x: x("c"), exits).collect()}
    assert max(stored) <= 4 * len(rows) < len(rows) * len(settings)
    books = base.join(settled, "period").withColumn("u", F.least(F.col("z") * F.col("tilt"), F.lit(0.4)))
    mean = books.groupBy("book", "period").agg(F.avg("u").alias("m"))
    books = books.join(mean, ["book", "period"]).withColumn("w", F.col("u") - F.when(F.col("centred"), F.col("m")).otherwise(0.0))
    for lev in (0.3, 2.0):
        for r in sw.ledger(books.where(F.col("leverage") == lev), ["book"], [lev], exits).collect():
            mine = got.pop((r.book, r.period))
            for c in ("gross", "tc_trade", "tc_exit", "tc", "net", "turnover", "gross_lev", "net_exp", "n_long", "n_short", "n_names", "n_return_gaps", "mkt_beta"):
                assert mine[c] == pytest.approx(r[c], abs=1e-9), c
    assert not got
