"""Bucketed artifacts: joins and windows by the entity without an exchange."""

from datetime import date

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.sources.bucketed import save_bucketed

PERIODS = [date(2000 + k // 4, 1 + 3 * (k % 4), 1) for k in range(8)]


def plan_of(df):
    df.count()
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_and_windows_need_no_exchange(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(k, p, float(k * j)) for k in range(50) for j, p in enumerate(PERIODS) if (k + j) % 5]
        plain = spark.createDataFrame(rows, "stock_id long, period date, x double")
        left, right = save_bucketed(plain, "left", buckets=8), save_bucketed(plain.withColumnRenamed("x", "y").where("y > 3"), "right", buckets=8)
        joined = left.join(right, ["stock_id", "period"]).withColumn("s", F.sum("x").over(W.partitionBy("stock_id").orderBy("period")))
        assert "Exchange" not in plan_of(joined) and "Bucketed: true" in plan_of(joined)
        wanted = plain.join(plain.withColumnRenamed("x", "y").where("y > 3"), ["stock_id", "period"]).withColumn("s", F.sum("x").over(W.partitionBy("stock_id").orderBy("period")))
        assert "Exchange" in plan_of(wanted)
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, wanted.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_an_empty_frame_is_a_table(spark):
    empty = save_bucketed(spark.createDataFrame([], "stock_id long, period date"), "none", buckets=4)
    assert empty.count() == 0 and empty.columns == ["stock_id", "period"]
