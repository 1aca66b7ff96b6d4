"""Factors that are computed over time: volatility, momentum, rate sensitivities and betas. Importing this registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import in_universe, period_key
from quillon.operators import curves, resample, windows
from quillon.operators.factors import Factor, register
from quillon.operators.joins import asof_join

#: Country codes share so many yield curves.
CURVES = 5


def _simple(curve: DataFrame) -> DataFrame:
    return curves.simple_curve(curve).withColumnRenamed("date", "month")


def quarterly_rates(panel: DataFrame, curve: DataFrame, fundamentals: DataFrame | None = None) -> DataFrame:
    """Per security and quarter: last date, last margin and yield, and mean level and slope of its currency's curve.

    A panel without ``fundamentals`` is given them here: they are looked up at the last date of each quarter alone.
    """
    rows = panel.withColumn("month", F.trunc("date", "MM")).withColumn("currency", F.col("country_code") % CURVES).join(F.broadcast(_simple(curve)), ["month", "currency"], "left")  # a row for each month and currency
    fiy = F.try_divide("investment_income", "insurance_reserves")
    if fundamentals is not None:
        made = rows.groupBy("stock_id", period_key(F.col("date"), 3).alias("period")).agg(F.max("date").alias("date_"), F.avg("level").alias("level"), F.avg("slope").alias("slope"), F.max_by("industry", "date").alias("industry"))
        known = fundamentals.select("stock_id", "observation_date", "net_interest_margin", fiy.alias("fiy"))
        return asof_join(made.withColumnRenamed("date_", "date"), known, "stock_id", "date", "observation_date").withColumnRenamed("net_interest_margin", "nim").select("stock_id", "period", "date", "nim", "fiy", "level", "slope", "industry")
    return rows.groupBy("stock_id", period_key(F.col("date"), 3).alias("period")).agg(
        F.max("date").alias("date_"), F.max_by("net_interest_margin", "date").alias("nim"), F.max_by(fiy, F.col("date")).alias("fiy"),
        F.avg("level").alias("level"), F.avg("slope").alias("slope"), F.max_by("industry", "date").alias("industry"),
    ).withColumnRenamed("date_", "date")


def metric_rate_betas(rates: DataFrame, metric: str, rows: int = 12, least: int = 6) -> DataFrame:
    """Slopes of a metric's changes on changes of level and slope, with an intercept."""
    return windows.rolling_two(windows.difference(rates, [metric, "level", "slope"]), f"d_{metric}", "d_level", "d_slope", rows, least)


def return_rate_betas(monthly: DataFrame, curve: DataFrame, rows: int = 36, least: int = 18) -> DataFrame:
    """The same of monthly returns, which are changes already. ``monthly`` has a ``currency``."""
    joined = monthly.join(F.broadcast(_simple(curve)).withColumnRenamed("month", "period"), ["period", "currency"], "left")
    return windows.rolling_two(windows.difference(joined, ["level", "slope"]), "ret", "d_level", "d_slope", rows, least)


def group_betas(market: DataFrame, group: str, parents: tuple[str, ...], tradeable_factor: bool = False) -> DataFrame:
    """Betas on the return of one's own group over its parent's."""
    source = market.where("tradeable") if tradeable_factor else market
    factor = resample.relative_factor(source, group, parents).withColumnRenamed("factor", "x")
    return windows.rolling_beta(resample.monthly_returns(market.where("tradeable"), factor, ["date", group], (group,)))


Frames = dict[str, DataFrame]
#: By factor: universe, metric and slope; slope; kind of group; universe.
_METRICS: dict[str, tuple[str, str, str]] = {}
_RETURNS: dict[str, str] = {}
_GROUPS = {"Beta~MKT": "market", "Beta~CTRY": "country_code", "Beta~IND (B)": "industry", "Beta~IND (I)": "industry"}
_INDUSTRIES = {"Beta~IND (B)": "bank", "Beta~IND (I)": "insurance"}


def metric_factors(frames: Frames, names: list[str]) -> DataFrame:
    """Rate sensitivities of all metrics from one table of quarters."""
    metrics = sorted({_METRICS[n][1] for n in names})
    rows = windows.difference(quarterly_rates(frames["sector"], frames["curve"]), [*metrics, "level", "slope"])
    for m in metrics:
        rows = windows.rolling_two(rows, f"d_{m}", "d_level", "d_slope", 12, 6).withColumnsRenamed({"beta_d_level": f"{m}_level", "beta_d_slope": f"{m}_slope"})
    return rows.select("stock_id", "date", *[F.when(in_universe(F.col("industry"), u), F.col(f"{m}_{end}")).alias(n) for n in names for u, m, end in [_METRICS[n]]])


def return_factors(frames: Frames, names: list[str]) -> DataFrame:
    panel = frames["sector"].withColumn("currency", F.col("country_code") % CURVES)
    monthly = panel.groupBy("stock_id", period_key(F.col("date")).alias("period")).agg(F.max("date").alias("date_"), resample.compound(F.col("excess_return")).alias("ret"), F.max_by("currency", "date").alias("currency"))
    return return_rate_betas(monthly.withColumnRenamed("date_", "date"), frames["curve"]).select("stock_id", "date", *[F.col(_RETURNS[n]).alias(n) for n in names])


def beta_factors(frames: Frames, names: list[str]) -> DataFrame:
    """Betas on the market and on one's own group from one table of months; those on groups less the group's median."""
    market, kinds = frames["market"], [k for k in ("market", "country_code", "industry") if k in {_GROUPS[n] for n in names}]
    tradeable = market.where("tradeable")
    factors = {}
    for k in kinds:
        if k == "market":
            factors[f"x_{k}"] = (resample.cap_weighted(market, ["date"]).select("date", F.col("r").alias(f"x_{k}")), ["date"])
        else:
            source, parents = (market, ("region_code",)) if k == "country_code" else (tradeable, ())
            factors[f"x_{k}"] = (resample.relative_factor(source, k, parents).withColumnRenamed("factor", f"x_{k}"), ["date", k])
    keep = tuple(k for k in kinds if k != "market")
    rows = resample.monthly_on_factors(tradeable, factors, keep)
    for k in kinds:
        rows = windows.rolling_beta(rows, x=f"x_{k}", out=f"beta_{k}")
    for k in keep:
        rows = windows.center_by_group(rows, f"beta_{k}", k)
    beta = lambda n: F.col(f"beta_{_GROUPS[n]}")
    return rows.select("stock_id", "date", *[(F.when(in_universe(F.col("industry"), _INDUSTRIES[n]), beta(n)) if n in _INDUSTRIES else beta(n)).alias(n) for n in names])


def _family(name: str, sleeve: str, family, universe: str | None = None, **more) -> None:
    register(Factor(name, sleeve, universe, compute=lambda frames: family(frames, [name]), family=family, **more))


def _column(name: str, sleeve: str, add) -> None:
    register(Factor(name, sleeve, compute=lambda frames: add(frames["sector"]).select("stock_id", "date", name), column=add))


_column("TRV", "risk", lambda panel: windows.rolling_vol(panel, "excess_return").withColumnRenamed("vol", "TRV"))
_column("Momentum", "momentum", lambda panel: windows.momentum(panel, "total_return").withColumnRenamed("momentum", "Momentum"))
for _end in ("Level", "Slope"):
    _METRICS[f"NIM~{_end}"], _METRICS[f"FIY~{_end}"], _RETURNS[f"Ret~{_end}"] = ("bank", "nim", _end.lower()), ("insurance", "fiy", _end.lower()), f"beta_d_{_end.lower()}"
    _family(f"NIM~{_end}", "rates", metric_factors, "bank")
    _family(f"FIY~{_end}", "rates", metric_factors, "insurance")
    _family(f"Ret~{_end}", "rates", return_factors)
for _name in _GROUPS:
    _family(_name, "beta", beta_factors, _INDUSTRIES.get(_name), neutralize=False, input_frame="market")
