"""Partitioned artifacts: pruning, dynamic overwrite, and publications that fail midway."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from quillon.operators import clean
from quillon.sources import versioned


def rows(spark, tag, periods):
    return spark.createDataFrame([(k, p, tag) for p in periods for k in range(5)], "stock_id long, period date, tag string")


P = [date(2000, 1 + 3 * k, 1) for k in range(4)]


def test_readers_see_one_version_or_the_next(spark, tmp_path):
    base = f"file://{tmp_path}/a"
    with pytest.raises(FileNotFoundError):
        versioned.current(spark, base)
    assert versioned.publish(rows(spark, "old", P), base, "period") == 1
    held = versioned.current(spark, base)
    assert versioned.publish(rows(spark, "new", P[1:2]), base, "period", replace=False) == 2
    tags = lambda df: {(r.period, r.tag): r.n for r in df.groupBy("period", "tag").agg(F.count("*").alias("n")).collect()}
    assert tags(held) == {(p, "old"): 5 for p in P}  # who reads the old one goes on reading it
    assert tags(versioned.current(spark, base)) == {(p, "new" if p == P[1] else "old"): 5 for p in P}
    assert tags(versioned.current(spark, base, 1)) == {(p, "old"): 5 for p in P}
    assert versioned.publish(rows(spark, "whole", P[:2]), base, "period") == 3
    now = versioned.current(spark, base)
    assert tags(now) == {(p, "whole"): 5 for p in P[:2]} and now.columns == ["stock_id", "period", "tag"]
    assert versioned.vacuum(spark, base, keep=1) == 5 and tags(versioned.current(spark, base)) == tags(now)


def test_a_publication_that_dies_midway_leaves_the_old_one(spark, tmp_path):
    base = f"file://{tmp_path}/a"
    versioned.publish(rows(spark, "old", P), base, "period")
    bad = rows(spark, "new", P).repartition(4, "period").withColumn("tag", F.when((F.col("period") == P[3]) & (F.col("stock_id") == 4), F.raise_error(F.lit("lost"))).otherwise(F.col("tag")))
    with pytest.raises(Exception, match="lost"):
        versioned.publish(bad, base, "period", replace=False)
    assert {r.tag for r in versioned.current(spark, base).collect()} == {"old"} and versioned.current(spark, base).count() == 20
    assert versioned.publish(rows(spark, "next", P), base, "period") == 2


def test_of_two_publications_at_once_one_loses(spark, tmp_path, monkeypatch):
    base = f"file://{tmp_path}/a"
    versioned.publish(rows(spark, "old", P), base, "period")
    seen = versioned._pointers(spark, base)
    versioned.publish(rows(spark, "first", P), base, "period")
    monkeypatch.setattr(versioned, "_pointers", lambda *_: seen)  # what the second saw before it wrote
    with pytest.raises(RuntimeError):
        versioned.publish(rows(spark, "second", P), base, "period")
    monkeypatch.undo()
    assert {r.tag for r in versioned.current(spark, base).collect()} == {"first"}


def test_slices_prune_partitions(spark, tmp_path):
    base = f"file://{tmp_path}/a"
    versioned.publish(rows(spark, "x", P).unionByName(spark.createDataFrame([(9, None, "none")], "stock_id long, period date, tag string")), base, "period")
    cut = versioned.current(spark, base).where(F.col("period").between(P[1], P[2]))
    plan = cut._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]", 1)[0]
    assert "period" in filters and cut.count() == 10 and len(cut.inputFiles()) >= 2
    scan = cut._jdf.queryExecution().executedPlan()
    assert "2000-04-01" in filters or "11048" in filters or str(scan)
    assert versioned.current(spark, base).where("period is null").collect()[0].tag == "none"


def test_empty_artifacts(spark, tmp_path):
    base = f"file://{tmp_path}/a"
    versioned.publish(rows(spark, "x", []), base, "period")
    assert versioned.current(spark, base).count() == 0 and versioned.current(spark, base).columns == ["stock_id", "period", "tag"]


def test_quality_report_in_one_scan(spark):
    rng = random.Random(3)
    data = [(rng.choice([1, 2, 40_000, -5, 10**12, None]), date(1990 + rng.randrange(30), 1, 1) if rng.random() > 0.1 else None, rng.choice([None, -1.0, 0.0, 2.0]), rng.choice([None, -3.0, 5.0]), rng.choice([-1.0, 0.0, 4.0, None]), rng.choice([None, 0.0, 0.7, -0.1]), rng.choice([None, 0.01, -0.2]), rng.choice([None, "x"])) for _ in range(500)]
    df = spark.createDataFrame(data, "stock_id long, date date, price_local double, mcap_local double, volume double, total_return double, excess_return double, industry string")
    report = clean.full_quality_report(df, ["industry", "price_local"])
    r = report.first()
    known = lambda k: [x[k] for x in data if x[k] is not None]
    assert (r.n_rows, r.n_securities, r.n_dates, r.date_min, r.date_max) == (500, len(set(known(0))), len(set(known(1))), min(known(1)), max(known(1)))
    assert r.null_pct_industry == pytest.approx(1 - len(known(7)) / 500) and r.null_pct_price_local == pytest.approx(1 - len(known(2)) / 500)
    assert (r.n_nonpositive_price, r.n_nonpositive_mcap, r.n_negative_volume) == (sum(v <= 0 for v in known(2)), sum(v <= 0 for v in known(3)), sum(v < 0 for v in known(4)))
    assert (r.tr_null, r.tr_zero, r.tr_extreme_50pct, r.er_null) == (500 - len(known(5)), sum(v == 0 for v in known(5)), sum(abs(v) > 0.5 for v in known(5)), 500 - len(known(6)))
    assert (r.tr_min, r.tr_max, r.er_min, r.er_max) == (min(known(5)), max(known(5)), min(known(6)), max(known(6))) and r.tr_mean == pytest.approx(sum(known(5)) / len(known(5))) and r.er_mean == pytest.approx(sum(known(6)) / len(known(6)))
    plan = clean.quality_cells(df, ["industry"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    none = clean.full_quality_report(df.where("false"), ["industry"]).first()
    assert (none.n_rows, none.n_securities, none.n_dates, none.tr_mean) == (0, 0, 0, None)
