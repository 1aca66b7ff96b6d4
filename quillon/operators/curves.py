"""Yield-curve operators: Nelson-Siegel fits from moments, and simple level and slope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import tenor_years

TAU = 2.0


def simple_curve(curve: DataFrame) -> DataFrame:
    """Level: the 120M rate. Slope: 24M less 120M."""
    at = lambda t: F.max(F.when(F.col("tenor_description") == t, F.col("zero_rate")))
    return curve.groupBy("date", "currency").agg(at("120M").alias("level"), (at("24M") - at("120M")).alias("slope"))


def ns_basis(years: Column, tau: float = TAU) -> tuple[Column, Column]:
    decay = F.exp(-years / tau)
    load = (1 - decay) / (years / tau)
    return load, load - decay


def _det(m: list[list[Column]]) -> Column:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def nelson_siegel(curve: DataFrame, tau: float = TAU, least: int = 3) -> DataFrame:
    """Level, slope and curvature of each curve with ``least`` points: moment sums, then Cramer's rule on three by three."""
    years = tenor_years(F.col("tenor_description"))
    x1, x2 = ns_basis(years, tau)
    rows = curve.where(F.col("zero_rate").isNotNull() & years.isNotNull()).select("date", "currency", F.lit(1.0).alias("x0"), x1.alias("x1"), x2.alias("x2"), F.col("zero_rate").alias("y"))
    xs = ("x0", "x1", "x2")
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}{b}") for k, a in enumerate(xs) for b in xs[k:]] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}y") for a in xs]
    m = rows.groupBy("date", "currency").agg(F.count("*").alias("n_points"), *sums).where(F.col("n_points") >= least)
    at = lambda a, b: F.col("".join(sorted((a, b))))
    full = [[at(a, b) for b in xs] for a in xs]
    det = _det(full)
    swap = lambda k: [[F.col(f"{a}y") if j == k else full[i][j] for j in range(3)] for i, a in enumerate(xs)]
    safe = F.when(F.abs(det) > 1e-14, det)
    return m.select("date", "currency", F.col("n_points").cast("long").alias("n_points"), *[F.try_divide(_det(swap(k)), safe).alias(name) for k, name in enumerate(("level", "slope", "curvature"))])


def ns_residuals(curve: DataFrame, fitted: DataFrame, tau: float = TAU) -> DataFrame:
    """Fitted rate of every point, and the root mean square error of its curve."""
    x1, x2 = ns_basis(tenor_years(F.col("tenor_description")), tau)
    rows = curve.join(fitted, ["date", "currency"]).withColumn("fitted", F.col("level") + F.col("slope") * x1 + F.col("curvature") * x2)
    return rows.groupBy("date", "currency").agg(F.sqrt(F.avg((F.col("zero_rate") - F.col("fitted")) ** 2)).alias("rmse"), F.max(F.abs(F.col("zero_rate") - F.col("fitted"))).alias("worst"))
