"""Cap-weighted aggregates, calendar resampling and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, compound, period_key, ratio
from quillon.operators.joins import settle, trim_after_exit


def cap_weighted(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Return by cap weight, with the sums that a coarser level adds up again. A group of nulls sums to 0."""
    zero = F.lit(0.0)
    sums = panel.groupBy(*keys).agg(F.coalesce(F.sum(F.col("excess_return") * F.col("mcap_usd")), zero).alias("w"), F.coalesce(F.sum("mcap_usd"), zero).alias("m"))
    return sums.withColumn("r", ratio(F.col("w"), F.col("m")))


def relative_factor(panel: DataFrame, child: str, parents: tuple[str, ...] = ()) -> DataFrame:
    """Each child group's return less its parent's, which is added up from the children's sums."""
    base = ["date", *parents]
    children = cap_weighted(panel, [*base, child])
    whole = children.groupBy(*base).agg(ratio(F.sum("w"), F.sum("m")).alias("r_base"))
    return children.join(whole, base).select("date", child, (F.col("r") - F.col("r_base")).alias("factor"))


def market_series(panel: DataFrame) -> DataFrame:
    """Daily return of all securities and of the tradeable ones, in one pass."""
    w, m, t = F.col("excess_return") * F.col("mcap_usd"), F.col("mcap_usd"), F.col("tradeable")
    sums = panel.groupBy("date").agg(F.sum(w).alias("w"), F.sum(m).alias("m"), F.sum(F.when(t, w)).alias("wt"), F.sum(F.when(t, m)).alias("mt"))
    return sums.select("date", ratio(F.col("w"), F.col("m")).alias("mkt"), ratio(F.col("wt"), F.col("mt")).alias("bench"))


def rebalance_grid(panel: DataFrame, months: int = 3) -> DataFrame:
    return panel.groupBy("stock_id", period_key(F.col("date"), months).alias("period")).agg(F.max("date").alias("date"))


def monthly_returns(panel: DataFrame, factor: DataFrame, on: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Compounded monthly return of each security and of its factor ``x``; levels are those of the last day.

    ``factor`` has a row for each day, or day and group, whatever the number of securities; panels are not exchanged to meet it.
    """
    return monthly_on_factors(panel, {"x": (factor, on)}, keep)


def monthly_on_factors(panel: DataFrame, factors: dict[str, tuple[DataFrame, list[str]]], keep: tuple[str, ...] = ()) -> DataFrame:
    """``monthly_returns`` for several factors in one pass: each is a frame that has a column of the name it goes by, and the columns it is met on."""
    columns = {"stock_id", "date", "excess_return", *keep, *[c for _, on in factors.values() for c in on]}
    rows = panel.select(*[c for c in panel.columns if c in columns])
    for factor, on in factors.values():
        rows = rows.join(F.broadcast(factor), on, "left")
    return rows.groupBy("stock_id", period_key(F.col("date")).alias("period")).agg(
        F.max("date").alias("date_"), compound(F.col("excess_return")).alias("ret"), *[compound(F.col(x)).alias(x) for x in factors], *[F.max_by(c, "date").alias(c) for c in keep]
    ).withColumnRenamed("date_", "date")


def winsorize_daily(panel: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """Clips to daily quantiles: bounds are grouped by date and joined back, so no window holds a whole day of rows."""
    bounds = panel.groupBy("date").agg(F.percentile(column, [low, high]).alias("_b"))  # a row for each day
    return panel.join(F.broadcast(bounds), "date").withColumn(out, clip(F.col(column), F.col("_b")[0], F.col("_b")[1])).drop("_b")


def periodic_returns(panel: DataFrame, events: DataFrame, months: int = 3, limits: tuple[float, float] = (0.01, 0.99)) -> DataFrame:
    """Raw and winsorized returns per period in one grouping, exits settled after winsorizing, with period-end levels."""
    rows = winsorize_daily(trim_after_exit(panel, events), "excess_return", *limits, "_wins")
    levels = ("industry", "mcap_usd", "free_float_percentage")
    made = rows.groupBy("stock_id", period_key(F.col("date"), months).alias("period")).agg(
        F.max("date").alias("date_"), *[F.max_by(c, "date").alias(c) for c in levels], compound(F.col("excess_return")).alias("ret_raw"), compound(F.col("_wins")).alias("ret_wins")
    ).withColumnRenamed("date_", "date")
    return settle(made, events, period_key(F.col("delist_date"), months), ["ret_raw", "ret_wins"])


def expand_by_group(loadings: DataFrame, beta: str, group: str, levels: list[str]) -> DataFrame:
    """A slope for each group and a dummy for each but the first; sorted ``levels`` are a short, known list."""
    g = F.col(group)
    slopes = [F.when(g == x, F.col(beta)).otherwise(0.0).alias(f"beta_{x}") for x in sorted(levels)]
    dummies = [F.when(g == x, 1.0).otherwise(0.0).alias(f"is_{x}") for x in sorted(levels)[1:]]
    return loadings.select("stock_id", "date", *slopes, *dummies)


def pivot(long: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """Long to wide; the column names are given, so no scan finds them."""
    return long.groupBy(*keys).pivot(name, names).agg(F.first(value))


def unpivot(wide: DataFrame, keys: list[str], values: list[str], name: str = "factor", value: str = "value") -> DataFrame:
    return wide.unpivot(keys, values, name, value)


def coverage(scores: DataFrame, factors: list[str]) -> DataFrame:
    """Share of non-null scores by period and factor."""
    wide = scores.groupBy("period").agg(*[F.avg(F.col(c).isNotNull().cast("double")).alias(c) for c in factors])
    return unpivot(wide, ["period"], factors, "factor", "coverage")


def summarize(df: DataFrame, by: str, x: Column) -> DataFrame:
    """Count, mean, median and spread of ``x`` by group."""
    rows = df.withColumn("_x", x)
    return rows.groupBy(by).agg(F.count("_x").alias("n"), F.count_distinct("stock_id").alias("n_firms"), F.avg("_x").alias("mean"), F.percentile("_x", 0.5).alias("median"), F.var_samp("_x").alias("var"), F.stddev_samp("_x").alias("std"))
