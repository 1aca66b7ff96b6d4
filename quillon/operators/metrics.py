"""Performance and selection metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sharpe(x: Column, per_year: int) -> Column:
    """Mean over deviation, annualised; null below two points or without dispersion."""
    sd = F.stddev_samp(x)
    return F.try_divide(F.avg(x), F.when(sd > 0, sd)) * F.sqrt(F.lit(float(per_year)))


def hedged(df: DataFrame) -> DataFrame:
    """Return less the risk-free rate and beta times the market; beta and market must come together."""
    both = F.col("beta").isNotNull() == F.col("mkt").isNotNull()
    market = F.when(both, F.coalesce(F.col("beta") * F.col("mkt"), F.lit(0.0)))
    return df.withColumn("hedged", F.col("net") - F.coalesce("rf", F.lit(0.0)) - market)


def performance(df: DataFrame, by: str, value: str, per_year: int, order: str = "period") -> DataFrame:
    """Annualised return, Sharpe, drawdown (the curve does not start at 1), mean turnover and cost."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = df.withColumn("_curve", F.product(1 + F.col(value)).over(w))
    rows = rows.withColumn("_fall", F.col("_curve") / F.max("_curve").over(w) - 1)
    growth = F.product(1 + F.col(value))
    return rows.groupBy(by).agg(
        (F.pow(F.greatest(growth, F.lit(0.0)), F.lit(float(per_year)) / F.count(value)) - 1).alias("ann_return"), sharpe(F.col(value), per_year).alias("sharpe"), F.min("_fall").alias("max_drawdown"),
        F.avg("turnover").alias("avg_turnover"), F.avg("tc").alias("avg_cost"), F.count(value).alias("n_periods"),
    )


def summary(df: DataFrame, by: str, per_year: int) -> DataFrame:
    """Headline figures of net and gross returns in one grouping."""
    x = F.col("net")
    return df.groupBy(by).agg(
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), sharpe(x, per_year).alias("sharpe"), sharpe(F.col("gross"), per_year).alias("gross_sharpe"), F.min(x).alias("worst"), F.max(x).alias("best"),
        F.avg((x > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("turnover"), F.avg("tc").alias("cost"), F.avg("leverage").alias("leverage"), F.avg("net_exposure").alias("net_exposure"),
        F.avg(F.col("n_long").cast("double")).alias("n_long"), F.avg(F.col("n_short").cast("double")).alias("n_short"),
    )


def selection_frequency(history: DataFrame) -> DataFrame:
    """How often, since when and until when each factor was selected, and whether it is now."""
    last = history.agg(F.max("cutoff").alias("_last"))
    rows = history.crossJoin(F.broadcast(last))
    on = F.when(F.col("selected"), F.col("cutoff"))
    return rows.groupBy("factor").agg(
        F.count(on).alias("n_selected"), F.avg(F.col("selected").cast("double")).alias("share"), F.min(on).alias("first_selected"), F.max(on).alias("last_selected"),
        F.bool_or(F.col("selected") & (F.col("cutoff") == F.col("_last"))).alias("current"),
    )


def shortlist_turnover(history: DataFrame) -> DataFrame:
    """Size, additions, drops and Jaccard similarity of consecutive shortlists."""
    lists = history.groupBy("cutoff").agg(F.collect_set(F.when(F.col("selected"), F.col("factor"))).alias("_now"))
    rows = lists.withColumn("_old", F.lag("_now").over(W.orderBy("cutoff")))  # one row per cutoff
    union = F.size(F.array_union("_now", "_old"))
    n = lambda c: F.when(F.col("_old").isNotNull(), F.size(c)).cast("long")
    return rows.select("cutoff", F.size("_now").cast("long").alias("n"), n(F.array_except("_now", "_old")).alias("added"), n(F.array_except("_old", "_now")).alias("dropped"),
                       F.when(F.col("_old").isNotNull(), F.when(union > 0, F.size(F.array_intersect("_now", "_old")) / union).otherwise(1.0)).alias("jaccard"))


def health(card: DataFrame, columns: list[str]) -> DataFrame:
    return card.unpivot(["cutoff", "factor"], columns, "metric", "value")


def join_market(results: DataFrame, market: DataFrame, months: int) -> DataFrame:
    """Attaches to each formation period the market's return over the next one."""
    ahead = market.select(F.add_months("period", -months).alias("period"), "mkt", "rf")
    return results.join(ahead, "period", "left")
