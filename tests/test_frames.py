"""Frames and joins whose cost follows the rows: trailing moments, rates by quarter, bounds and factors by day."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import computed, factors, resample, windows
from quillon.operators.joins import asof_join


def plan(df):
    return df._jdf.queryExecution().toString()


def panel(spark, days=23):
    rng = random.Random(5)
    x = lambda name, k: 0.02 if name == "flat" else None if rng.random() < 0.2 else rng.gauss(0.01, 0.1)
    rows = [(name, date(2000, 1, 1) + timedelta(days=7 * k), x(name, k), name != "b") for name in ("a", "b", "flat", "short") for k in range(3 if name == "short" else days)]
    return spark.createDataFrame(rows, "stock_id string, date date, x double, tradeable boolean")


@pytest.mark.parametrize("rows", [1, 4, 5, 23, 40])
def test_trailing_moments_equal_sliding_frames(spark, rows):
    w = W.partitionBy("stock_id").orderBy("date").rowsBetween(1 - rows, 0)
    want = {"n": F.count("x"), "mean": F.avg("x"), "low": F.min("x"), "high": F.max("x"), "total": F.sum(F.col("x") * 2)}
    df = windows.trailing(panel(spark), F.col("x"), rows, "t", added=F.col("x") * 2)
    df = windows.rolling_vol(df, "x", rows, 2).withColumns({f"w_{c}": e.over(w) for c, e in want.items()}).withColumn("w_vol", F.when(F.count("x").over(w) >= 2, F.stddev_samp("x").over(w)))
    for r in df.collect():
        for c in want:
            assert r.t[c] == (None if r[f"w_{c}"] is None else pytest.approx(r[f"w_{c}"], abs=1e-12)), (c, rows)
        assert r.vol == (None if r.w_vol is None else pytest.approx(r.w_vol, abs=1e-12))
        assert r.stock_id != "flat" or r.vol in (None, 0.0)


def test_long_frames_do_not_slide(spark):
    assert "-755, currentrow" not in plan(windows.rolling_vol(panel(spark), "x"))
    assert "-251, currentrow" not in plan(windows.momentum(panel(spark), "x"))


def test_fundamentals_are_looked_up_for_each_quarter_s_last_row(spark):
    days = panel(spark).withColumns({"country_code": F.lit(7), "industry": F.lit("bank")}).drop("x")
    reports = [("a", date(2000, 1, 20), 0.1, 1.0, 4.0), ("a", date(2000, 5, 1), 0.2, 3.0, 4.0), ("flat", date(2000, 4, 30), 0.3, 1.0, 0.0)]
    known = spark.createDataFrame(reports, "stock_id string, observation_date date, net_interest_margin double, investment_income double, insurance_reserves double")
    curve = spark.createDataFrame([(date(2000, m, 1), 2, tenor, m * 0.01 + k) for m in (1, 2, 4) for k, tenor in ((0.1, "24M"), (0.2, "120M"))], "date date, currency int, tenor_description string, zero_rate double")
    want = computed.quarterly_rates(asof_join(days, known, "stock_id", "date", "observation_date"), curve)
    got = computed.quarterly_rates(days, curve, known)
    key = lambda df: sorted((r.stock_id, r.period, r.date, r.nim, r.fiy, round(r.level, 9), round(r.slope, 9), r.industry) for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 7


def test_what_is_known_by_day_is_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = panel(spark).withColumn("excess_return", F.col("x"))
        bound = resample.winsorize_daily(df, "x", 0.25, 0.75, "clipped")
        factor = df.groupBy("date").agg(F.avg("x").alias("x"))
        made = resample.monthly_returns(df.drop("x"), factor, ["date"])
        assert all("SortMergeJoin" not in plan(x) and "BroadcastHashJoin" in plan(x) for x in (bound, made))
        assert bound.count() == df.count() and made.count() == 19
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_factors_of_a_frame_share_its_passes(spark):
    """Daily rows meet their factors without a join, each family reads the frames once, and values are those of each factor alone."""
    rng = random.Random(9)
    days = [date(2000 + k // 12, 1 + k % 12, day) for k in range(60) for day in (3, 17)]
    rows = [(k, x, k % 6, k % 2, "bank" if k % 3 else "insurance_pc", rng.gauss(0, 0.05), rng.uniform(1, 9), k % 5 != 4, rng.random(), rng.random(), 2.0) for k in range(12) for x in days]
    market = spark.createDataFrame(rows, "stock_id long, date date, country_code long, region_code long, industry string, excess_return double, mcap_usd double, tradeable boolean, net_interest_margin double, investment_income double, insurance_reserves double")
    market = market.withColumn("total_return", F.col("excess_return")).localCheckpoint()
    curve = spark.createDataFrame([(date(2000 + m // 12, 1 + m % 12, 1), c, tenor, rng.random()) for m in range(60) for c in range(5) for tenor in ("24M", "120M")], "date date, currency long, tenor_description string, zero_rate double")
    frames = {"sector": market.where("tradeable"), "market": market, "curve": curve}
    names = ["TRV", "NIM~Level", "NIM~Slope", "FIY~Level", "FIY~Slope", "Ret~Level", "Ret~Slope", "Beta~MKT", "Beta~CTRY", "Beta~IND (B)", "Beta~IND (I)", "NIM"]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = factors.factor_frames(frames, names)
        made = wide._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [stock_id" not in made
        few = plan(factors.factor_frames(frames, ["TRV", "NIM~Level", "Ret~Level", "Beta~MKT", "Beta~CTRY", "Beta~IND (B)"]))
        reads = lambda p: p[p.index("== Physical Plan"):].count("Scan ExistingRDD")
        assert reads(few) == reads(plan(wide)) > 0, "a family reads a frame once, however many factors it makes"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert wide.columns == ["stock_id", "date", "industry", "NIM", *names[:-1]]
    wide = {(r.stock_id, r.date): r for r in wide.collect()}
    assert len(wide) == market.where("tradeable").count()
    for n in names[:-1]:
        alone = {(r.stock_id, r.date): r[n] for r in factors.REGISTRY[n].compute(frames).collect() if r[n] is not None}
        assert alone or n == "TRV"
        assert {k: v[n] for k, v in wide.items() if v[n] is not None} == {k: pytest.approx(v, abs=1e-9) for k, v in alone.items()}, n
    groups = {"Beta~CTRY": computed.group_betas(market, "country_code", ("region_code",)), "Beta~IND (B)": computed.group_betas(market, "industry", (), True).where("industry = 'bank'")}
    for n, by in (("Beta~CTRY", "country_code"), ("Beta~IND (B)", "industry")):
        want = {(r.stock_id, r.date): r.beta for r in windows.center_by_group(groups[n], "beta", by).collect() if r.beta is not None}
        assert {k: v[n] for k, v in wide.items() if v[n] is not None} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}, n
    for n, metric, end in (("NIM~Level", "nim", "level"), ("FIY~Slope", "fiy", "slope")):
        rates = computed.metric_rate_betas(computed.quarterly_rates(frames["sector"], curve), metric).where(F.col("industry").startswith("bank" if metric == "nim" else "insurance"))
        want = {(r.stock_id, r.date): r[f"beta_d_{end}"] for r in rates.collect() if r[f"beta_d_{end}"] is not None}
        assert want and {k: v[n] for k, v in wide.items() if v[n] is not None} == {k: pytest.approx(v, rel=1e-6, abs=1e-9) for k, v in want.items()}, n
