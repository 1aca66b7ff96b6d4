"""Operators on small hand-computed frames."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, compound, finite, period_key, ratio, row_mean, tenor_years
from quillon.operators import clean, curves, econometrics, factors, joins, metrics, portfolio, regress, resample, validate, windows
from quillon.operators import computed  # noqa: F401 (registers the computed factors)
from quillon.sources import catalog


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scalars(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 2.0), (float("inf"), 1.0)], "a double, b double")
    assert [r[0] for r in df.select(ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.5, None, None]
    assert [r[0] for r in df.select(finite(F.col("a"))).collect()] == [1.0, 1.0, None, None]
    assert [r[0] for r in df.select(clip(F.col("a"), F.lit(2.0), F.lit(3.0))).collect()] == [2.0, 2.0, None, 3.0]
    assert df.limit(1).select(row_mean([F.col("a"), F.lit(None).cast("double")])).first()[0] == 1.0
    d = spark.createDataFrame([(dt.date(2020, 5, 17), "18M")], "d date, t string")
    assert d.select(period_key(F.col("d"), 1), period_key(F.col("d"), 3), period_key(F.col("d"), 6), tenor_years(F.col("t"))).first()[:] == (dt.date(2020, 5, 1), dt.date(2020, 4, 1), dt.date(2020, 1, 1), 1.5)
    assert df.where("a < 0").agg(compound(F.col("a"))).first()[0] == 0.0


def panel(spark, cells):
    return spark.createDataFrame(cells, "stock_id string, date date, price_local double, fx_to_usd double, total_return double, price_return double, risk_free_rate double")


def test_clean_gates_and_fills(spark):
    df = panel(spark, [
        ("A", day(0), 10.0, 1.0, None, None, 0.0), ("A", day(1), 11.0, 1.0, None, None, 0.0), ("A", day(2), 0.01, 1.0, 0.5, None, 0.0), ("A", day(3), 12.0, 1.0, 0.2, None, 0.0),
        ("A", day(30), 13.0, 1.0, None, None, 0.0), ("A", day(31), 13.5, 1.0, 5.0, None, 0.001), ("A", day(32), 14.0, None, None, 0.01, 0.0), ("A", day(33), 14.0, 1.0, 0.1, None, None),
    ])
    got = {r.date: r for r in clean.clean(df).collect()}
    want = {0: 0.0, 1: 0.1, 2: 0.0, 3: 0.0, 30: 0.0, 31: 0.0, 32: 0.01}
    assert {d: pytest.approx(got[day(d)].total_return) for d in want} == want and day(33) not in got
    assert got[day(2)].px_blanked and got[day(2)].ret_gated and got[day(31)].ret_gated and not got[day(30)].ret_gated
    assert got[day(31)].excess_return == pytest.approx(-0.001)


def test_delist_events(spark):
    cells = []
    for k in range(400):
        cells += [("ALIVE", day(k), 10.0, 0.01, 5.0)]
        if k < 200:
            cells += [("ACQ", day(k), 10.0, 0.01, 5.0), ("WIPE", day(k), 10.0 - k * 0.045, -0.01, 5.0)]
        cells += [("ZOMB", day(k), 10.0 if k < 150 else 0.0005, 0.01 if k < 150 else 0.0, 5.0 if k < 150 else 0.0)]
    df = spark.createDataFrame(cells, "stock_id string, date date, price_local double, price_return double, volume double")
    got = {r.stock_id: (r.reason, r.delist_return, r.delist_date) for r in clean.delist_events(df).collect()}
    assert got == {"ACQ": ("acquisition", 0.0, day(199)), "WIPE": ("wipeout", -1.0, day(199)), "ZOMB": ("wipeout", -1.0, day(149))}


def test_pit_filter_has_open_bounds(spark):
    window = spark.createDataFrame([("A", day(2), None), ("B", None, day(2))], "stock_id string, start_date date, end_date date")
    frame = spark.createDataFrame([(s, day(k)) for s in "ABC" for k in (1, 3)], "stock_id string, date date")
    assert rows(clean.pit_filter(frame, window), "stock_id", "date") == [("A", day(3)), ("B", day(1)), ("C", day(1)), ("C", day(3))]


def test_asof_join_takes_the_latest_known(spark):
    left = spark.createDataFrame([("A", day(k)) for k in (0, 5, 6, 9)] + [("B", day(3))], "stock_id string, date date")
    right = spark.createDataFrame([("A", day(5), 1.0), ("A", day(8), None), ("C", day(0), 9.0)], "stock_id string, seen date, x double")
    got = joins.asof_join(left, right, "stock_id", "date", "seen")
    assert rows(got, "stock_id", "date", "seen", "x") == sorted([("A", day(0), None, None), ("A", day(5), day(5), 1.0), ("A", day(6), day(5), 1.0), ("A", day(9), day(8), None), ("B", day(3), None, None)], key=str)
    with pytest.raises(ValueError):
        joins.asof_join(left, right.withColumnRenamed("x", "date"), "stock_id", "date", "seen")


def test_terminal_return_lands_in_its_period(spark):
    cells = [("W", dt.date(2020, m, 10), 0.1, "bank", 1.0, 50.0) for m in range(1, 7)] + [("L", dt.date(2020, m, 10), 0.1, "bank", 1.0, 50.0) for m in range(1, 13)]
    df = spark.createDataFrame(cells, "stock_id string, date date, excess_return double, industry string, mcap_usd double, free_float_percentage double")
    events = spark.createDataFrame([("W", dt.date(2020, 5, 20), -1.0)], "stock_id string, delist_date date, delist_return double")
    got = resample.periodic_returns(df, events).where("stock_id = 'W'")
    assert rows(got, "period", "ret_raw") == [(dt.date(2020, 1, 1), pytest.approx(1.1**3 - 1)), (dt.date(2020, 4, 1), -1.0)]


def test_no_look_ahead(spark):
    rng = np.random.default_rng(0)
    cells = [("f", dt.date(2000 + k // 4, 1 + 3 * (k % 4), 1), float(x)) for k, x in enumerate(rng.normal(size=40))]
    df = spark.createDataFrame(cells, "factor string, period date, coef double")
    bad = df.withColumn("coef", F.when(F.col("period") >= "2006-01-01", 1e6).otherwise(F.col("coef")))
    cut = "period <= '2006-01-01'"
    assert rows(windows.walk_forward(df, "coef", ["factor"]).where(cut), "period", "mean", "se2", "n") == rows(windows.walk_forward(bad, "coef", ["factor"]).where(cut), "period", "mean", "se2", "n")


def test_winsorize_nearest_and_linear(spark):
    df = spark.createDataFrame([(str(k), 1, float(k)) for k in range(11)], "stock_id string, period int, x double")
    near = windows.winsorize(df, {"x": F.lit(True)}, 0.14, 0.86, interpolation="nearest").agg(F.min("x"), F.max("x")).first()
    lin = windows.winsorize(df, {"x": F.lit(True)}, 0.14, 0.86).agg(F.min("x"), F.max("x")).first()
    assert near[:] == (1.0, 9.0) and lin[0] == pytest.approx(1.4)


def test_sub_universes_never_pool(spark):
    df = spark.createDataFrame([("a", 1, "bank", 1.0), ("b", 1, "bank", None), ("c", 1, "bank", 3.0), ("d", 1, "insurance_pc", 100.0)], "stock_id string, period int, industry string, x double")
    mask = F.col("industry").startswith("bank")
    filled = {r.stock_id: r.x for r in windows.fill_median(df, {"x": mask}).collect()}
    assert filled == {"a": 1.0, "b": 2.0, "c": 3.0, "d": None}
    z = {r.stock_id: r.x for r in windows.zscore(df, {"x": mask}).collect()}
    assert z["a"] == pytest.approx(-z["c"]) and z["d"] is None


def test_rolling_betas_recover_coefficients(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 30))
    df = spark.createDataFrame([("s", k, float(2 * x - y + 0.5), float(x), float(y)) for k, (x, y) in enumerate(zip(a, b, strict=True))], "stock_id string, period int, y double, a double, b double")
    last = windows.rolling_two(df, "y", "a", "b", 20, 10).where("period = 29").first()
    assert (last.beta_a, last.beta_b) == (pytest.approx(2), pytest.approx(-1))
    fit = regress.coefficients(regress.moments(df, ["stock_id"], F.col("y"), [F.col("a"), F.col("b")]), ["stock_id"], ["a", "b"]).first()
    assert (fit.const, fit.a, fit.b) == (pytest.approx(0.5), pytest.approx(2), pytest.approx(-1))
    flat = regress.residuals(df, ["stock_id"], ["y"], ["a", "b"]).agg(F.max(F.abs("y"))).first()[0]
    assert flat < 1e-9


def test_rank_deficient_designs_have_minimum_norm(spark):
    df = spark.createDataFrame([("g", float(k), float(k), 2.0 * k) for k in range(5)], "g string, a double, b double, y double")
    fit = regress.coefficients(regress.moments(df, ["g"], F.col("y"), [F.col("a"), F.col("b")]), ["g"], ["a", "b"]).first()
    assert (fit.a, fit.b) == (pytest.approx(1), pytest.approx(1))


def test_momentum_marks_total_losses(spark):
    df = spark.createDataFrame([("s", day(k), -1.0 if k == 5 else 0.01 * (k % 3)) for k in range(30)], "stock_id string, date date, r double")
    got = {r.date: r.momentum for r in windows.momentum(df, "r", 12, 4, 12, (6, 2, 6)).collect()}
    assert got[day(7)] is None and got[day(12)] < 0 and got[day(20)] is not None


def test_ema_counts_a_null_as_a_gap_and_bounds_its_frame(spark):
    df = spark.createDataFrame([("k", 1, None), ("k", 2, 4.0), ("k", 3, 2.0), ("k", 4, None), ("k", 5, 8.0)], "k string, t long, x double")
    assert rows(windows.ema(df, "x", ["k"], 0.5), "t", "ema") == sorted([(1, None), (2, 4.0), (3, 3.0), (4, None), (5, 8.0)], key=str)
    x = np.random.default_rng(2).normal(size=300)
    want = x[0]
    for v in x[1:]:
        want = 0.5 * want + 0.5 * v
    long = spark.createDataFrame([("k", t, float(v)) for t, v in enumerate(x)], "k string, t long, x double")
    assert windows.ema(long, "x", ["k"], 0.5).where("t = 299").first().ema == pytest.approx(want)


def test_ema_restarts_after_a_gap(spark):
    df = spark.createDataFrame([("k", t, float(t)) for t in (1, 2, 4, 5)], "k string, t long, x double")
    assert rows(windows.ema(df, "x", ["k"], 0.5), "t", "ema") == [(1, 1.0), (2, 1.5), (4, 4.0), (5, 4.5)]


def test_james_stein_limits(spark):
    flat = spark.createDataFrame([(1, f"f{k}", 0.1, 0.01) for k in range(5)], "period int, factor string, mean double, se2 double")
    assert {r.js_b for r in windows.james_stein(flat, ["period"]).collect()} == {1.0}
    assert {r.js_b for r in windows.james_stein(flat.where("factor < 'f3'"), ["period"]).collect()} == {0.0}


def test_nelson_siegel_recovers_a_curve(spark):
    cells = []
    for label in ("6M", "12M", "24M", "60M", "120M"):
        t = int(label[:-1]) / 12
        load = (1 - np.exp(-t / 2)) / (t / 2)
        cells.append((day(0), 1, label, float(0.05 - 0.02 * load + 0.01 * (load - np.exp(-t / 2)))))
    df = spark.createDataFrame([*cells, (day(0), 2, "6M", 0.01)], "date date, currency long, tenor_description string, zero_rate double")
    got = curves.nelson_siegel(df).collect()
    assert len(got) == 1 and (got[0].level, got[0].slope, got[0].curvature) == (pytest.approx(0.05), pytest.approx(-0.02), pytest.approx(0.01))


def test_newey_west_matches_its_formula(spark):
    x = np.random.default_rng(3).normal(size=30)
    df = spark.createDataFrame([("f", day(k), float(v)) for k, v in enumerate(x)], "factor string, period date, coef double")
    r = validate.newey_west(df, ["factor"]).first()
    e, lags = x - x.mean(), max(1, int(4 * 0.3 ** (2 / 9)))
    g = sum((1 if k == 0 else 2 * (1 - k / (lags + 1))) * (e[k:] @ e[: 30 - k]) / 30 for k in range(lags + 1))
    assert r.nw_se == pytest.approx(np.sqrt(g / 30)) and r.t_stat == pytest.approx(x.mean() / np.sqrt(g / 30))


def test_lasso_keeps_signals_and_drops_noise(spark):
    rng = np.random.default_rng(4)
    cells = [(f"s{i}", t, "bank", *map(float, z), float(0.5 * z[0] - 0.3 * z[1] + rng.normal() * 0.1)) for t in range(20) for i in range(30) for z in [rng.normal(size=3)]]
    df = spark.createDataFrame(cells, "stock_id string, period int, sub_universe string, a double, b double, noise double, y double")
    got = {r.factor: r.coef for r in validate.lasso_select(df, "y", ["a", "b", "noise"]).collect()}
    assert got["a"] == pytest.approx(0.5, abs=0.05) and got["b"] == pytest.approx(-0.3, abs=0.05) and abs(got["noise"]) < 0.02


def test_clusters_and_representatives(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdef"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("e", "f")], "a string, b string")
    got = dict(rows(validate.clusters(nodes, edges), "node", "cluster"))
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"}
    members = spark.createDataFrame([(1, "x", True, 0.1), (1, "y", True, -0.5), (1, "z", False, None), (2, "w", False, None)], "cluster int, factor string, has boolean, v double")
    assert rows(validate.representatives(members, "has", "v"), "cluster", "factor") == [(1, "y"), (2, "w")]


def test_representatives_read_their_statistics_once(spark):
    import random

    members = spark.createDataFrame([(k // 2, f"f{k}", True) for k in range(20)], "cluster int, factor string, has boolean").repartition(3)
    noise = F.udf(lambda: random.random(), "double").asNondeterministic()  # as sums of doubles are, in their last bits
    got = validate.representatives(members.withColumn("v", noise()), "has", "v").collect()
    assert sorted(r.cluster for r in got) == list(range(10))


def test_a_long_chain_is_one_cluster(spark):
    n = 130
    nodes = spark.createDataFrame([(f"{k:03d}",) for k in range(n)], "node string")
    edges = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(n - 1)], "a string, b string")
    assert {r.cluster for r in validate.clusters(nodes, edges).collect()} == {"000"}
    with pytest.raises(RuntimeError):
        validate.clusters(nodes, edges, rounds=1)


def test_orders_picks_and_first_rows(spark):
    card = spark.createDataFrame([("c", "a", False, 0.9, None), ("c", "b", True, None, 2.0), ("c", "d", True, -0.5, 1.0)], "cutoff string, factor string, selected boolean, ir_lag1 double, fm_t double")
    assert [r.factor for r in validate.scorecard_order(card).orderBy("place").collect()] == ["d", "b", "a"]
    df = spark.createDataFrame([("x", k, k % 7) for k in range(50)], "s string, k int, v int")
    once = [tuple(r) for r in validate.reproducible_pick(df, ["k"], "seed", 3).collect()]
    assert len(once) == 3 and once == [tuple(r) for r in validate.reproducible_pick(df.repartition(7), ["k"], "seed", 3).collect()]
    assert rows(validate.first_rows(df, ["v"], ["k"]), "v", "k") == [(v, v) for v in range(7)]
    assert rows(validate.best_rows(card, "cutoff", "fm_t"), "factor") == [("b",)]
    m = spark.createDataFrame([(1, "x", 0.1), (1, "y", -0.3), (1, "z", None), (2, "w", None)], "cluster int, factor string, ir double")
    assert rows(validate.best_ir(m), "cluster", "factor") == [(1, "y"), (2, "w")]


def test_forward_returns_dispatch(spark):
    df = spark.createDataFrame([("A", day(0), 0.1), ("A", day(91), 0.2)], "stock_id string, period date, r double")
    assert rows(windows.forward_returns(df, "r", "periodic", None), "fwd1") == sorted([(0.2,), (None,)], key=str)
    with pytest.raises(ValueError):
        windows.forward_returns(df, "r", "daily", None)
    with pytest.raises(ValueError):
        windows.forward_returns(df, "r", "weekly", None)


def test_selection_drops_the_weaker_clone(spark):
    periods = [dt.date(2000 + k // 4, 1 + 3 * (k % 4), 1) for k in range(24)]
    rng = np.random.default_rng(5)
    ic = [(p, f, 1, float(m + rng.normal() * 0.05), 30) for p in periods for f, m in (("good", 0.2), ("clone", 0.15), ("noise", 0.0))]
    coefs = [(p, f, x) for p, f, _, x, _ in ic]
    a = spark.createDataFrame(ic, "period date, factor string, lag int, ic double, n long")
    b = spark.createDataFrame(coefs, "period date, factor string, coef double")
    cut = spark.createDataFrame([(dt.date(2004, 1, 1),), (dt.date(2006, 1, 1),)], "cutoff date")
    pairs = cut.select("cutoff", F.lit("good").alias("a"), F.lit("clone").alias("b"))
    got = validate.select_factors(a, b, cut, pairs, 1.0, 1e9)
    assert {(r.factor, r.selected) for r in got.collect()} >= {("noise", False)} and got.where("selected").count() == 2
    late = validate.select_factors(a.withColumn("ic", F.when(F.col("period") > "2004-01-01", -9.0).otherwise(F.col("ic"))), b, cut, pairs, 1.0, 1e9)
    first = "cutoff = '2004-01-01'"
    assert rows(got.where(first), "factor", "selected", "ir_lag1") == rows(late.where(first), "factor", "selected", "ir_lag1")


def test_selection_runs_clusters_and_the_lasso_on_representatives(spark):
    periods = [dt.date(2000 + k // 4, 1 + 3 * (k % 4), 1) for k in range(24)]
    rng = np.random.default_rng(8)
    # A chain a - b - c: c is no neighbour of a, but in its cluster. "idle" passes the gates, yet predicts nothing. "beta" is no style factor.
    means = {"a": 0.3, "b": 0.2, "c": 0.1, "idle": 0.2, "beta": 0.2, "weak": 0.0}
    ic = [(p, f, 1, float(m + rng.normal() * 0.02) if m else float((-1) ** k * 0.1), 30) for k, p in enumerate(periods) for f, m in means.items()]
    a = spark.createDataFrame(ic, "period date, factor string, lag int, ic double, n long")
    b = a.select("period", "factor", F.col("ic").alias("coef"))
    cut = spark.createDataFrame([(dt.date(2004, 1, 1),), (dt.date(2006, 1, 1),)], "cutoff date")
    pairs = cut.select("cutoff", F.explode(F.expr("array(struct('a' AS x, 'b' AS y), struct('b' AS x, 'c' AS y), struct('c' AS x, 'weak' AS y), struct('idle' AS x, 'weak' AS y))")).alias("p")).select("cutoff", F.col("p.x").alias("a"), F.col("p.y").alias("b"))
    z = lambda: rng.normal(size=30)
    cells = []
    for p in periods:
        x, idle = z(), z()
        idle -= x * (x @ idle) / (x @ x)
        cells += [(p, "bank", float(u), None, None, 0.0 if p < dt.date(2003, 1, 1) else float(v), float(0.5 * u + (5 * v if p >= dt.date(2004, 1, 1) else 0))) for u, v in zip(x, idle, strict=True)]
    panel = spark.createDataFrame(cells, "period date, sub_universe string, a double, b double, c double, idle double, fwd1 double")
    got = validate.select_factors(a, b, cut, pairs, 1.0, 1e9, panel, "fwd1", ["a", "b", "c", "idle"])
    card = {(str(r.cutoff), r.factor): (r.cluster, r.representative, r.lasso, r.selected) for r in got.collect()}
    for c in ("2004-01-01", "2006-01-01"):
        assert card[c, "a"] == ("a", True, True, True) and card[c, "b"] == card[c, "c"] == ("a", False, None, False)
        assert card[c, "beta"] == ("beta", True, None, True) and card[c, "weak"] == (None, False, None, False)
        # What moves after a cutoff is not seen by it.
        assert card[c, "idle"] == ("idle", True, c > "2005", c > "2005")
    scores = spark.createDataFrame([(p, float(v), float(v if p < dt.date(2003, 1, 1) else -v), float(v)) for p in periods for v in range(4)], "period date, a double, b double, c double")
    found = {(str(r.cutoff), r.a, r.b): r.redundant for r in validate.average_correlation(scores, ["a", "b", "c"], 0.3, cut).collect()}
    assert found == {(c, x, y): (x, y) == ("a", "c") or c < "2005" for c in ("2004-01-01", "2006-01-01") for x, y in (("a", "b"), ("a", "c"), ("b", "c"))}


def test_twfe_recovers_an_effect(spark):
    rng = np.random.default_rng(6)
    cells = [(f"s{i}", t, float(i + 0.3 * t + (2.0 if i % 2 and t >= 5 else 0) + rng.normal() * 0.01), float(i % 2 and t >= 5)) for i in range(20) for t in range(10)]
    r = econometrics.twfe(spark.createDataFrame(cells, "stock_id string, period int, y double, d double")).first()
    assert r.beta == pytest.approx(2.0, abs=0.02) and r.t_stat > 50


def test_both_fixed_effects_go_on_unbalanced_panels(spark):
    rng = np.random.default_rng(9)
    cells = [(f"s{i}", t, float(i * 3 + t * t + rng.normal()), float(rng.normal())) for i in range(25) for t in range(30) if rng.random() < 0.3 + 0.4 * (i % 2) or t == i]
    cells += cells[:5]
    df = spark.createDataFrame(cells, "stock_id string, period int, y double, d double")
    i, t = (np.unique([c[k] for c in cells], return_inverse=True)[1] for k in (0, 1))
    dummies = np.hstack([np.eye(i.max() + 1)[i], np.eye(t.max() + 1)[t]])
    y, d = (np.array([c[k] for c in cells]) for k in (2, 3))
    left = lambda v: v - dummies @ np.linalg.lstsq(dummies, v, rcond=None)[0]
    got = econometrics.demean_two_ways(df, ["y", "d"])
    assert got.columns == df.columns
    assert np.allclose(sorted(r.y for r in got.collect()), sorted(left(y)), atol=1e-8)
    assert econometrics.twfe(df).first().beta == pytest.approx(left(y) @ left(d) / (left(d) @ left(d)))


def test_weights_follow_the_analytic_optimum(spark):
    df = spark.createDataFrame([("s", day(0), str(k), mu, 0.04, 0.001, 0.0) for k, mu in enumerate((0.01, -0.01, 0.0005, -0.0005))], "strategy_id string, period date, stock_id string, mu double, d double, c double, w0 double")
    got = {r.stock_id: r.w for r in portfolio.build_weights(df, 5.0, 1.0, 10.0).collect()}
    assert got["0"] == pytest.approx((0.01 - 0.001) / 0.2) and got["1"] == -got["0"] and got["2"] == got["3"] == 0


def test_account_identities(spark):
    cells = [("s", day(0), "a", 0.5, 0.1, 0.001, True), ("s", day(0), "b", -0.5, -1.0, 0.001, True), ("s", day(90), "a", 1.0, 0.0, 0.001, True)]
    got = portfolio.account(spark.createDataFrame(cells, "strategy_id string, period date, stock_id string, w double, r double, c double, voluntary boolean")).orderBy("period").collect()
    assert got[0].gross == pytest.approx(0.55) and got[0].tc == pytest.approx(0.001) and got[0].net == pytest.approx(0.549)
    held = 0.5 * 1.1 / 1.549
    assert got[1].turnover == pytest.approx(1.0 - held) and (got[1].n_long, got[1].n_short) == (1, 0)


def test_account_equals_the_recursion(spark):
    rng = np.random.default_rng(12)
    cells = [(s, day(91 * t), k, float(rng.normal()), float(max(rng.normal() * 0.1, -1)), 0.01, bool(rng.random() < 0.5)) for s in "ab" for t in range(12) for k in "uvwxyz" if rng.random() < 0.8]
    cells += [("wiped", day(0), "u", 1.0, -1.0, 0.001, True), ("wiped", day(91), "u", 1.0, 0.5, 0.001, True)]
    got = {(r.strategy_id, r.period): (r.net, r.turnover, r.tc) for r in portfolio.account(spark.createDataFrame(cells, "strategy_id string, period date, stock_id string, w double, r double, c double, voluntary boolean")).collect()}
    for s in ("a", "b", "wiped"):
        held = {}
        for p in sorted({c[1] for c in cells if c[0] == s}):
            rows = {c[2]: c for c in cells if c[0] == s and c[1] == p}
            step = {k: abs((rows[k][3] if k in rows else 0) - held.get(k, 0)) for k in {*rows, *held}}
            tc = sum(x * rows[k][5] for k, x in step.items() if k in rows and (rows[k][6] or rows[k][3]))
            net = sum(c[3] * c[4] for c in rows.values()) - tc
            assert got[s, p] == (pytest.approx(net), pytest.approx(sum(step.values())), pytest.approx(tc)), (s, p)
            held = {k: c[3] * (1 + c[4]) / (1 + net) for k, c in rows.items()} if 1 + net > 1e-3 else {}


def test_covariance_shrinks_correlations_alone(spark):
    x = np.random.default_rng(7).normal(size=(40, 2)) @ np.array([[1.0, 0.5], [0.0, 1.0]])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "t long, a double, b double")
    cells = {(r.a, r.b): r for r in portfolio.shrunk_covariance(df, ["a", "b"], 40).where("t = 39").collect()}
    plain = np.cov(x.T, ddof=0)
    assert cells["a", "a"].cov == pytest.approx(plain[0, 0]) and cells["a", "b"].cov == pytest.approx(plain[0, 1] * (1 - cells["a", "b"].delta))
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    s = z.T @ z / 40
    d2, b2 = ((s - np.eye(2)) ** 2).sum(), ((z**2).sum(axis=1) @ (z**2).sum(axis=1) / 40 - (s**2).sum()) / 40
    assert cells["a", "b"].delta == pytest.approx(min(b2, d2) / d2)


def test_free_float_scales_and_costs(spark):
    df = spark.createDataFrame([("a", "g", 100.0, 50.0), ("b", "g", 100.0, None), ("c", "h", 100.0, None)], "stock_id string, g string, mcap_usd double, free_float_percentage double")
    assert rows(portfolio.free_float_cap(df, "g"), "stock_id", "free_float_mcap") == [("a", 50.0), ("b", 50.0), ("c", 100.0)]
    r = df.limit(1).select(portfolio.cost_coefficient(F.lit(1e11)).alias("big"), portfolio.cost_coefficient(F.lit(None).cast("double")).alias("none"), portfolio.cost_coefficient(F.lit(1e7)).alias("small")).first()
    assert r.big == pytest.approx(6e-4) and r.none == r.small > r.big


def test_metrics(spark):
    df = spark.createDataFrame([("s", day(k), x, 0.1, 0.001) for k, x in enumerate((0.1, -0.5, 0.2))], "strategy_id string, period date, net double, turnover double, tc double")
    r = metrics.performance(df, "strategy_id", "net", 4).first()
    assert r.max_drawdown == pytest.approx(-0.5) and r.sharpe == pytest.approx(np.mean([0.1, -0.5, 0.2]) / np.std([0.1, -0.5, 0.2], ddof=1) * 2)
    one = metrics.performance(df.limit(1), "strategy_id", "net", 4).first()
    assert one.sharpe is None
    h = spark.createDataFrame([(0.1, None, 0.5), (0.1, 1.0, 0.02)], "net double, beta double, mkt double").withColumn("rf", F.lit(0.01))
    assert [r.hedged for r in metrics.hedged(h).collect()] == [None, pytest.approx(0.07)]


def test_computed_factors_and_designs(spark, tmp_path):
    assert {"TRV", "Momentum", "NIM~Level", "FIY~Slope", "Ret~Level", "Beta~MKT", "Beta~CTRY", "Beta~IND (B)", "Beta~IND (I)"} <= {n for n, f in factors.REGISTRY.items() if f.compute}
    market = spark.createDataFrame([(f"s{i}", dt.date(2000 + m // 12, 1 + m % 12, 5), "bank" if i % 2 else "insurance_pc", 100.0 + i, 0.01 * ((m * (i + 1)) % 7 - 3), True) for i in range(4) for m in range(30)], "stock_id string, date date, industry string, mcap_usd double, excess_return double, tradeable boolean")
    got = factors.factor_frames({"sector": market.withColumn("net_interest_margin", F.lit(0.1)), "market": market}, ["NIM", "Beta~MKT", "Beta~IND (B)"])
    assert got.columns == ["stock_id", "date", "industry", "NIM", "Beta~MKT", "Beta~IND (B)"] and got.count() == market.count()
    assert got.where("`Beta~MKT` is not null").count() > 0 and got.where("industry <> 'bank' and (`Beta~IND (B)` is not null or NIM is not null)").count() == 0
    with pytest.raises(ValueError):
        factors.factor_frames({"sector": market}, ["Beta~MKT"])
    assert regress.design_columns(market.select("stock_id", "date", "mcap_usd")) == ["mcap_usd"]
    with pytest.raises(ValueError):
        regress.design_columns(market.select("stock_id", "date"))
    tables = catalog.load_all(spark, {"m": catalog.write_artifact(market, str(tmp_path), "m").inputFiles()[0]}, views=True)
    assert spark.table("m").count() == tables["m"].count()
    grid = {"a": [1, 2], "b": [3, 4, 5]}
    assert [portfolio.knob_grid(spark, grid, x).count() for x in ("full", "one_at_a_time", "baseline")] == [6, 4, 1]


def test_registry_and_catalog(spark, tmp_path):
    assert factors.REGISTRY["NIM"].universe == "bank" and "E/P" in factors.applicable("insurance", ["E/P", "NIM", "B/P"]) and "NIM" not in factors.applicable("insurance", ["NIM"])
    with pytest.raises(ValueError):
        factors.require_industry(spark.range(1), ["NIM"])
    with pytest.raises(ValueError):
        factors.register(factors.Factor("NIM", "x"))
    made = catalog.write_with_manifest({"a": spark.range(3), "b": spark.range(5)}, str(tmp_path))
    assert rows(made, "artifact", "rows") == [("a", 3), ("b", 5)]
    assert catalog.load_artifacts(spark, str(tmp_path), ["a"], "the build")["a"].count() == 3
    with pytest.raises(FileNotFoundError, match="run the build first"):
        catalog.load_artifacts(spark, str(tmp_path), ["zzz"], "the build")
    with pytest.raises(KeyError):
        catalog.load_table(spark, "x", {})
    assert catalog.cast_ids(spark.range(1).withColumn("stock_id", F.lit(7))).dtypes[1] == ("stock_id", "string")
    assert factors.metadata(spark).count() == len(factors.REGISTRY)
