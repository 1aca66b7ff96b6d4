"""Expected returns, risk, weights and book accounting, for all periods at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import finite
from quillon.operators.regress import coefficients, moments
from quillon.operators.windows import ema, james_stein, trailing_periods, walk_forward
from quillon.sources.shared import materialize


def systematic_return(premium: Column, z: Column) -> Column:
    return premium * z


def behavioural_return(ic: Column, sigma: Column, z: Column) -> Column:
    return ic * sigma * z


def factor_weights(df: DataFrame, by: list[str], ir: str | None = None) -> DataFrame:
    """Equal weights, or by size of the information ratio; if those add up to nothing, equal again."""
    w = W.partitionBy(*by)
    equal = 1.0 / F.count("*").over(w)
    if ir is None:
        return df.withColumn("alpha", equal)
    size = F.abs(F.coalesce(F.col(ir), F.lit(0.0)))
    total = F.sum(size).over(w)
    return df.withColumn("alpha", F.when(total > 0, size / total).otherwise(equal))


def walk_forward_premia(premia: DataFrame, least: int = 8, shift: int = 1) -> DataFrame:
    """Premia as known at each period, shrunk toward their mean across factors."""
    return james_stein(walk_forward(premia.where("factor <> 'const'"), "coef", ["factor"], least, shift), ["period"])


def walk_forward_ir(ic: DataFrame, least: int = 8, shift: int = 1) -> DataFrame:
    known = walk_forward(ic, "ic", ["factor"], least, shift)
    sd = F.sqrt(F.col("se2") * F.col("n"))
    return known.withColumn("ir", F.try_divide("mean", F.when(sd > 0, sd)))


def walk_forward_ic(ic: DataFrame, least: int = 8, lag: int = 1, shrink: bool = True) -> DataFrame:
    """``period``, ``factor`` and the information coefficient as known then: the mean up to ``lag`` periods back, shrunk toward that of all factors if asked."""
    known = walk_forward(ic, "ic", ["factor"], least, lag)
    return james_stein(known, ["period"]).select("period", "factor", F.col("mean_js").alias("ic")) if shrink else known.select("period", "factor", F.col("mean").alias("ic"))


def integrated_return(scores: DataFrame, factors: list[str], premia: DataFrame, alphas: DataFrame) -> DataFrame:
    """Sum over factors of weight x premium x score. A sub-universe's own premium overrides the pooled one ("all"); a null
    score counts as 0, but a row without any score is dropped.

    ``premia``: period, sub_universe, factor, premium; ``alphas``: period, factor, alpha.
    """
    long = scores.unpivot(["stock_id", "period", "sub_universe"], factors, "factor", "z")
    own = premia.where("sub_universe <> 'all'").withColumnRenamed("premium", "_own")
    pooled = premia.where("sub_universe = 'all'").select("period", "factor", F.col("premium").alias("_all"))
    rows = long.join(own, ["period", "sub_universe", "factor"], "left").join(pooled, ["period", "factor"], "left").join(alphas, ["period", "factor"], "left")
    mu = F.coalesce("alpha", F.lit(0.0)) * F.coalesce("_own", "_all", F.lit(0.0)) * F.coalesce("z", F.lit(0.0))
    return rows.groupBy("stock_id", "period").agg(F.sum(mu).alias("mu"), F.count("z").alias("n")).where("n > 0").drop("n")


def factor_returns(panel: DataFrame, y: str, factors: list[str], least: int, const: bool = False) -> tuple[DataFrame, DataFrame]:
    """Cross-sectional regressions of next returns on exposures: factor returns (long), the intercept's as ``const`` if asked, and residuals."""
    fit = coefficients(moments(panel, ["period"], F.col(y), [F.col(f) for f in factors]), ["period"], [f"f_{f}" for f in factors], least)
    line = F.col("const")
    for f in factors:
        line = line + F.col(f"f_{f}") * F.col(f)
    resid = panel.join(fit, "period").select("stock_id", "period", (F.col(y) - line).alias("resid"))
    told = [*(["const"] if const else []), *factors]
    long = fit.select("period", *(["const"] if const else []), *[F.col(f"f_{f}").alias(f) for f in factors]).unpivot(["period"], told, "factor", "f")
    return long, resid


def shrunk_covariance(returns: DataFrame, factors: list[str], window: int = 60) -> DataFrame:
    """Covariances of factor returns over the trailing ``window`` period numbers, correlations shrunk to the identity (Ledoit-Wolf), variances kept.

    ``returns`` is wide: t, one column per factor, without nulls. With standardised Z, S = Z'Z/T and m = tr(S)/K:
    d2 = |S - mI|^2, b2 = (sum_t |z_t|^4 / T - |S|^2) / T, and off-diagonals scale by 1 - min(b2, d2)/d2.
    Each row is handed to the ``window`` periods that see it, so they meet by an equal key.
    """
    at = returns.select(F.col("t").alias("at"))
    seen = returns.withColumn("at", F.explode(F.sequence(F.col("t"), F.col("t") + window - 1))).join(at, "at", "left_semi")
    w = W.partitionBy("at")
    z = seen.withColumns({f"z_{f}": F.try_divide(F.col(f) - F.avg(f).over(w), F.when(F.stddev_pop(f).over(w) > 0, F.stddev_pop(f).over(w))) for f in factors})
    norm = sum((F.coalesce(F.col(f"z_{f}"), F.lit(0.0)) ** 2 for f in factors), F.lit(0.0))
    pairs = [(a, b) for i, a in enumerate(factors) for b in factors[i:]]
    sums = z.withColumn("_q", norm * norm).groupBy("at").agg(
        F.count("*").alias("T"), F.avg("_q").alias("q"), *[F.var_pop(f).alias(f"v_{f}") for f in factors], *[F.coalesce(F.avg(F.col(f"z_{a}") * F.col(f"z_{b}")), F.lit(0.0)).alias(f"s_{a}|{b}") for a, b in pairs]
    )
    square = sum((F.col(f"`s_{a}|{b}`") ** 2 * (1 if a == b else 2) for a, b in pairs), F.lit(0.0))
    m = sum((F.col(f"`s_{f}|{f}`") for f in factors), F.lit(0.0)) / len(factors)
    d2 = square - len(factors) * m * m
    rows = sums.withColumn("_d2", d2).withColumn("_b2", (F.col("q") - square) / F.col("T"))
    delta = F.when(F.col("_d2") > 1e-12, F.least(F.greatest(F.col("_b2"), F.lit(0.0)), F.col("_d2")) / F.col("_d2")).otherwise(0.0)
    rows = rows.withColumn("delta", delta)
    cells = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.sqrt(F.col(f"v_{a}") * F.col(f"v_{b}")) * F.col(f"`s_{a}|{b}`") * (F.lit(1.0) if a == b else 1 - F.col("delta"))).alias("cov")) for a, b in pairs]))
    return rows.where("T > 1").select(F.col("at").alias("t"), "delta", cells.alias("c")).select("t", "delta", "c.*")


def present_periods(df: DataFrame, period: str = "period") -> DataFrame:
    """``df`` with ``t``, the number of its period among those present: a window of N numbers is one of N periods that there are, whatever the calendar lacks."""
    found = df.select(period).where(F.col(period).isNotNull()).distinct()
    numbered = found.select(F.col(period).alias("_p"), F.row_number().over(W.orderBy(period)).cast("long").alias("t"))  # a row for each period
    return df.join(F.broadcast(numbered), F.col(period) == F.col("_p")).drop("_p")


def present_covariance(returns: DataFrame, factors: list[str], window: int) -> DataFrame:
    """``shrunk_covariance`` over the last ``window`` periods present; a factor without a return in one of them counts as 0. ``returns`` is long: period, factor, f."""
    wide = returns.where(F.col("f").isNotNull()).groupBy("period").agg(*[F.coalesce(F.max(F.when(F.col("factor") == f, F.col("f"))), F.lit(0.0)).alias(f) for f in factors])
    numbered = present_periods(wide)
    names = numbered.select(F.col("t"), "period")
    return shrunk_covariance(numbered.select("t", *factors), factors, window).join(names, "t").drop("t")


def idio_variance(resid: DataFrame, window: int, least: int) -> DataFrame:
    """Residual variance of each security over the trailing ``window`` period numbers ``t``; null below ``least``."""
    w = trailing_periods(window, ["stock_id"])
    return resid.select("stock_id", "t", F.when(F.count("resid").over(w) >= least, F.var_samp("resid").over(w)).alias("idio"), F.count("resid").over(w).alias("n"))


def fill_idio(df: DataFrame, group: str, least: int, by: str = "t") -> DataFrame:
    """Nulls take the median of their group, then of all, with the least count."""
    filled = F.coalesce("idio", F.median("idio").over(W.partitionBy(by, group)), F.median("idio").over(W.partitionBy(by)))
    return df.withColumn("n", F.when(F.col("idio").isNull(), F.lit(least)).otherwise(F.col("n")).cast("long")).withColumn("idio", filled)


def shrink_idio(df: DataFrame, by: str = "t") -> DataFrame:
    """Variances drawn toward their mean: sampling error over dispersion, within 0 and 1."""
    w = W.partitionBy(by)
    rows = df.withColumn("_bar", F.avg("idio").over(w))
    noise = F.avg(2 * F.col("idio") ** 2 / F.greatest(F.col("n") - 1, F.lit(1))).over(w)
    spread = F.avg((F.col("idio") - F.col("_bar")) ** 2).over(w)
    delta = F.when(spread > 0, F.least(F.greatest(noise / spread, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    return rows.withColumn("delta", delta).withColumn("idio_shrunk", (1 - F.col("delta")) * F.col("idio") + F.col("delta") * F.col("_bar")).drop("_bar")


def smooth_risk(df: DataFrame, value: str, keys: list[str], keep: float, scale: float = 1.0) -> DataFrame:
    """Scaled to the rebalancing horizon and smoothed by key, so factors and securities never mix; a gap starts anew."""
    return ema(df.withColumn(value, F.col(value) * scale), value, keys, keep)


def risk_panel(covariance: DataFrame, idio: DataFrame, keep: float, scale: float = 1.0) -> DataFrame:
    """Factor covariances (t, a, b, cov) and own variances (t, stock_id, v) as one long table, each cell smoothed over its own past.

    ``kind`` is "factor" or "idio"; cells go by names, so a factor or security that comes or goes moves no other.
    """
    cells = covariance.select(F.lit("factor").alias("kind"), "a", "b", "t", F.col("cov").alias("v"))
    key = F.col("stock_id").cast("string")
    long = cells.unionByName(idio.select(F.lit("idio").alias("kind"), key.alias("a"), key.alias("b"), "t", "v"))
    return smooth_risk(long, "v", ["kind", "a", "b"], keep, scale).select("kind", "a", "b", "t", F.col("ema").alias("value"))


def portfolio_risk(weights: DataFrame, exposures: DataFrame, covariance: DataFrame, idio: DataFrame, factors: list[str]) -> DataFrame:
    """b'Fb + sum of D w^2 per strategy and period, with b the weighted exposures. ``covariance`` has pairs a <= b once."""
    keys = ["strategy_id", "t"]
    long = exposures.unpivot(["stock_id", "t"], factors, "factor", "x")
    b = weights.join(long, ["stock_id", "t"]).groupBy(*keys, "factor").agg(F.sum(F.col("w") * F.col("x")).alias("b"))
    left, right = b.select(*keys, F.col("factor").alias("a"), F.col("b").alias("ba")), b.select(*keys, F.col("factor").alias("b"), F.col("b").alias("bb"))
    twice = F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0)
    systematic = left.join(covariance.select("t", "a", "b", "cov"), ["t", "a"]).join(right, [*keys, "b"]).groupBy(*keys).agg(F.sum(twice * F.col("ba") * F.col("bb") * F.col("cov")).alias("factor_var"))
    own = weights.join(idio, ["stock_id", "t"]).groupBy(*keys).agg(F.sum(F.col("idio") * F.col("w") ** 2).alias("idio_var"))
    return systematic.join(own, keys).withColumn("variance", F.col("factor_var") + F.col("idio_var"))


def free_float_cap(df: DataFrame, group: str) -> DataFrame:
    """Market cap times free float. Percent scales are told by a median over 1; shares are held within 0 and 1; nulls take the group's median, else 1.

    Medians are grouped and joined back: no window holds a whole group of a large panel.
    """
    scale = df.agg(F.when(F.median("free_float_percentage") > 1, 100.0).otherwise(1.0).alias("_scale"))  # one row
    rows = df.crossJoin(F.broadcast(scale)).withColumn("_share", F.least(F.greatest(F.try_divide("free_float_percentage", "_scale"), F.lit(0.0)), F.lit(1.0)))
    rows = rows.withColumn("_share", F.when(F.col("free_float_percentage").isNotNull(), F.col("_share")))
    # Shares repeat often: medians come from counts by value, so no task sees a group's rows.
    typical = rows.groupBy(group, "_share").agg(F.count("*").alias("_n")).groupBy(F.col(group).alias("_g")).agg(F.percentile("_share", 0.5, F.col("_n")).alias("_median"))
    share = F.coalesce("_share", "_median", F.lit(1.0))
    joined = rows.join(F.broadcast(typical), F.col(group).eqNullSafe(F.col("_g")), "left")  # one row for each group
    return joined.withColumn("free_float_mcap", F.col("mcap_usd") * share).drop("_scale", "_share", "_g", "_median")


def cost_coefficient(mcap: Column) -> Column:
    """Linear cost by size, in return units; null or not finite counts as the smallest size."""
    m = F.greatest(F.coalesce(finite(mcap), F.lit(1e7)), F.lit(1e7))
    return (3 * F.pow(11 / F.log10(m), F.lit(6.0)) + 3) * 1e-4


def turnover_cost(trades: DataFrame, by: list[str]) -> DataFrame:
    """Turnover and its cost from weights before (``w0``) and after (``w``)."""
    step = F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w0", F.lit(0.0)))
    return trades.groupBy(*by).agg(F.sum(step).alias("turnover"), F.sum(step * F.col("cost")).alias("tc"))


def build_weights(df: DataFrame, risk_aversion: Column | float, cap: Column | float, gross: Column | float, net: Column | bool = True) -> DataFrame:
    """Separable optimum per name: no trade within costs of the marginal return, else the step to it; then the name cap, a
    zero net position (unless ``net`` is false), and gross scaling per strategy and period.

    ``df``: strategy_id, period, stock_id, mu, d (variance), c (cost), w0.
    """
    lam, limit, target = (x if isinstance(x, Column) else F.lit(float(x)) for x in (risk_aversion, cap, gross))
    pull = F.col("mu") - lam * F.col("d") * F.col("w0")
    soft = F.signum(pull) * F.greatest(F.abs(pull) - F.col("c"), F.lit(0.0))
    step = F.coalesce(F.try_divide(soft, lam * F.col("d")), F.lit(0.0))
    rows = df.withColumn("_w", F.least(F.greatest(F.col("w0") + step, -limit), limit))
    book = W.partitionBy("strategy_id", "period")
    rows = rows.withColumn("_w", F.col("_w") - F.when(net if isinstance(net, Column) else F.lit(net), F.avg("_w").over(book)).otherwise(0.0))
    total = F.sum(F.abs("_w")).over(book)
    return rows.withColumn("w", F.col("_w") * F.when(total > target, target / total).otherwise(1.0)).drop("_w")


def account(books: DataFrame, reset: float = 1e-3, tolerance: float = 1e-10) -> DataFrame:
    """Books over time: gross return, turnover against drifted weights, costs, net return, exposures.

    ``books``: strategy_id, period, stock_id, w, r (null: 0), c, voluntary (an exit by choice, which costs).
    Weights drift by (1 + r) / (1 + net); at 1 + net <= ``reset`` the book starts anew. All periods are done at once:
    each row meets its security's row of the strategy's period before, and the one thing that runs through time, the
    net return in the drift, comes from sweeps. A sweep scales an error by costs times turnover (some 1e-3), so a few
    meet ``tolerance``; whatever the costs, each sweep settles one more period, so there are as many as periods at most.
    """
    keys = ["strategy_id", "t"]
    periods = books.select("strategy_id", "period").distinct().withColumn("t", F.row_number().over(W.partitionBy("strategy_id").orderBy("period")))
    rows = books.join(periods, ["strategy_id", "period"]).select(*keys, "stock_id", "w", F.coalesce("r", F.lit(0.0)).alias("r"), "c", "voluntary")
    last = periods.groupBy("strategy_id").agg(F.max("t").alias("_last"))
    held = rows.join(last, "strategy_id").where("t < _last").select("strategy_id", (F.col("t") + 1).alias("t"), "stock_id", (F.col("w") * (1 + F.col("r"))).alias("h"))
    both = rows.join(held, [*keys, "stock_id"], "full")
    zero = F.lit(0.0)
    w, pays = F.coalesce("w", zero), F.coalesce("voluntary", F.lit(False)) | (F.coalesce("w", zero) != 0)
    pairs = materialize(both.select(*keys, w.alias("w"), F.coalesce("h", zero).alias("h"), F.coalesce("r", zero).alias("r"), F.when(pays, F.coalesce("c", zero)).otherwise(0.0).alias("c")), "book-pairs")
    fixed = pairs.groupBy(*keys).agg(
        F.sum(F.col("w") * F.col("r")).alias("gross"), F.sum(F.abs("w")).alias("leverage"), F.sum("w").alias("net_exposure"),
        F.sum((F.col("w") > 0).cast("long")).alias("n_long"), F.sum((F.col("w") < 0).cast("long")).alias("n_short"),
    )
    totals = materialize(fixed, "book-totals")  # one row for each strategy and period
    known = totals.select(*keys, F.col("gross").alias("net"))
    moved = tolerance + 1
    while moved > tolerance:
        before = known.select("strategy_id", (F.col("t") + 1).alias("t"), F.when(1 + F.col("net") > reset, 1 / (1 + F.col("net"))).otherwise(0.0).alias("k"))
        step = F.abs(F.col("w") - F.col("h") * F.coalesce("k", zero))
        traded = pairs.join(before, keys, "left").groupBy(*keys).agg(F.sum(step).alias("turnover"), F.sum(step * F.col("c")).alias("tc"))
        now = totals.join(traded, keys).join(known.select(*keys, F.col("net").alias("_old")), keys)
        known = materialize(now.withColumn("net", F.col("gross") - F.col("tc")).withColumn("_moved", F.abs(F.col("net") - F.col("_old"))), "book-sweep")
        moved = known.agg(F.max("_moved")).first()[0] or 0.0
    return known.join(periods, keys).select("strategy_id", "period", "gross", "turnover", "tc", "net", "leverage", "net_exposure", "n_long", "n_short")


def knob_grid(spark, knobs: dict[str, list[float]], mode: str = "full") -> DataFrame:
    """Settings of a sweep, with an id: every combination (``full``), each knob moved by itself from the first values
    (``one_at_a_time``, these included), or the first values alone (``baseline``). Products of short lists, not of data.
    """
    grid = spark.range(1)
    for name, values in knobs.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    moved = sum((F.when(F.col(k) != float(v[0]), 1).otherwise(0) for k, v in knobs.items()), F.lit(0))
    grid = grid.where(moved <= {"full": len(knobs), "one_at_a_time": 1, "baseline": 0}[mode])
    return grid.select(F.concat_ws("|", *[F.format_string(f"{k}=%.4f", k) for k in knobs]).alias("strategy_id"), *knobs)
