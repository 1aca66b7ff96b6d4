"""Point-in-time joins and panel assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str) -> DataFrame:
    """The latest row of ``right`` at or before each row of ``left``; unmatched rows keep nulls.

    Both sides are stacked and sorted once by key and time, right rows first where times tie, and the last right
    row seen is carried along: one shuffle, no range join. Of right rows equal in key and time one is taken, the
    same on every run. Columns of ``right`` other than the key are added.
    """
    values = [c for c in right.columns if c != key]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    payload = F.struct(*values)
    kind = dict(right.select(payload.alias("p")).dtypes)["p"]
    up = left.select(F.col(key), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), F.lit(None).cast(kind).alias("_right"))
    row = dict(left.select(F.struct(*left.columns).alias("p")).dtypes)["p"]
    down = right.where(F.col(right_time).isNotNull()).select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_left"), payload.alias("_right"))
    order = W.partitionBy(key).orderBy(F.col("_t").asc_nulls_first(), "_side", F.xxhash64("_right")).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = up.unionByName(down).withColumn("_found", F.last("_right", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def excess_return(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """Adds the risk-free rate by country and date, and the return above it."""
    return panel.join(rates, ["country_code", "date"], "left").withColumn("excess_return", F.col("total_return") - F.col("risk_free_rate"))


def to_usd(panel: DataFrame, fx: DataFrame, on: list[str]) -> DataFrame:
    return panel.join(fx, on, "left").withColumn("mcap_usd", F.col("mcap_local") * F.col("fx_to_usd"))


def extend(fundamentals: DataFrame, extended: DataFrame) -> DataFrame:
    """Fundamentals with the further items reported for the same security and date, where there are any."""
    return fundamentals.join(extended, ["stock_id", "date_fundamental"], "left")


def full_panel(prices: DataFrame, securities: DataFrame, fx: DataFrame, rates: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Everything known of every row, unfiltered: references, dollars, excess returns, and the latest known fundamentals."""
    rows = prices.join(F.broadcast(securities), "stock_id", "left")  # one row for each security: tens of thousands
    rows = excess_return(to_usd(rows, fx, ["country_code"]), rates)
    return asof_join(rows, fundamentals, "stock_id", "date", "observation_date")


def sector_panel(panel: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Tradeable rows first, then the latest known fundamentals of each."""
    return asof_join(panel.where("tradeable"), fundamentals, "stock_id", "date", "observation_date")


def tradeable_ids(fundamentals: DataFrame, securities: DataFrame, metric: str) -> DataFrame:
    """Securities with a known industry whose sector metric was ever reported."""
    known = fundamentals.groupBy("stock_id").agg(F.bool_or(F.col(metric).isNotNull()).alias("_has"))
    return known.where("_has").join(securities.where(F.col("industry").isNotNull()), "stock_id").select("stock_id", "industry")


def step_correction(curve: DataFrame, coefs: DataFrame, outcomes: dict[str, str]) -> DataFrame:
    """Subtracts from each outcome the coefficients of all cohorts begun by then, by currency.

    ``coefs`` has cohort, currency, outcome and coef: a few rows each, which a range join on the currency adds up.
    """
    out = curve
    for outcome, column in outcomes.items():
        own = coefs.where(F.col("outcome") == outcome).select(F.col("currency").alias("_cur"), "cohort", "coef")
        step = curve.select("date", "currency").distinct().join(own, (F.col("currency") == F.col("_cur")) & (F.col("date") >= F.col("cohort"))).groupBy("date", "currency").agg(F.sum("coef").alias("_step"))
        out = out.join(step, ["date", "currency"], "left").withColumn(column, F.col(column) - F.coalesce("_step", F.lit(0.0))).drop("_step")
    return out


def downsample(frame: DataFrame, grid: DataFrame) -> DataFrame:
    return frame.join(grid, ["stock_id", "date"])


def trim_after_exit(frame: DataFrame, events: DataFrame) -> DataFrame:
    """Drops what comes after a security's exit."""
    end = events.select("stock_id", F.col("delist_date").alias("_end"))
    return frame.join(end, "stock_id", "left").where(F.col("_end").isNull() | (F.col("date") <= F.col("_end"))).drop("_end")


def settle(periodic: DataFrame, events: DataFrame, period: Column, returns: list[str]) -> DataFrame:
    """Books terminal returns in the period that holds the exit."""
    due = events.select("stock_id", period.alias("period"), F.col("delist_return").alias("_due"))
    rows = periodic.join(due, ["stock_id", "period"], "left")
    for c in returns:
        rows = rows.withColumn(c, F.when(F.col("_due").isNotNull(), (1 + F.coalesce(c, F.lit(0.0))) * (1 + F.col("_due")) - 1).otherwise(F.col(c)))
    return rows.drop("_due")


def investable(scores: DataFrame, exposures: DataFrame, events: DataFrame, factors: list[str]) -> DataFrame:
    """Per period: at least one score, an exposure row, and no exit by then."""
    some = F.greatest(*[F.col(c).isNotNull() for c in factors]) if len(factors) > 1 else F.col(factors[0]).isNotNull()
    alive = scores.where(some).join(exposures, ["stock_id", "period"], "left_semi")
    dead = events.select(F.col("stock_id").alias("_id"), "delist_date")
    return alive.join(dead, (F.col("stock_id") == F.col("_id")) & (F.col("delist_date") <= F.col("date")), "left_anti").select("stock_id", "period")
