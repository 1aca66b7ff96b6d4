"""Cross-sectional and rolling window operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, masked

Masks = dict[str, Column]


def _stock(n: int, by: str = "period"):
    return W.partitionBy("stock_id").orderBy(by).rowsBetween(1 - n, 0)


def winsorize(df: DataFrame, masks: Masks, low: float, high: float, by: str = "period", interpolation: str = "linear") -> DataFrame:
    """Clips each column to its quantiles per period within its sub-universe; rows outside become null.

    ``linear`` interpolates between ranks; ``nearest`` takes the value at the rounded rank.
    """
    inside = {c: masked(mask, F.col(c)) for c, mask in masks.items()}
    if interpolation == "linear":
        cross = W.partitionBy(by)
        return df.withColumns({c: clip(x, F.percentile(x, low).over(cross), F.percentile(x, high).over(cross)) for c, x in inside.items()})
    # Bounds are grouped and joined back: counts by value, and the value whose counts pass the rounded rank.
    found = None
    for k, (c, x) in enumerate(inside.items()):
        counts = df.select(F.col(by).alias("_by"), x.alias("_x")).where("_x is not null").groupBy("_by", "_x").agg(F.count("*").alias("_n"))
        order = W.partitionBy("_by").orderBy("_x")
        ranked = counts.withColumn("_to", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(W.partitionBy("_by")))
        at = lambda q: F.min(F.when(F.col("_to") > F.round((F.col("_all") - 1) * q), F.col("_x")))
        bounds = ranked.groupBy("_by").agg(at(low).alias(f"_lo{k}"), at(high).alias(f"_hi{k}"))
        found = bounds if found is None else found.join(bounds, "_by", "full")
    if found is None:
        return df
    out = df.join(found, F.col(by).eqNullSafe(F.col("_by")), "left").withColumns({c: clip(x, F.col(f"_lo{k}"), F.col(f"_hi{k}")) for k, (c, x) in enumerate(inside.items())})
    return out.drop("_by", *[f"_{e}{k}" for k in range(len(inside)) for e in ("lo", "hi")])


def fill_median(df: DataFrame, masks: Masks, by: str = "period") -> DataFrame:
    cross = W.partitionBy(by)
    return df.withColumns({c: masked(m, F.coalesce(F.col(c), F.median(masked(m, F.col(c))).over(cross))) for c, m in masks.items()})


def zscore(df: DataFrame, masks: Masks, by: str = "period") -> DataFrame:
    """Sample z-scores per period and sub-universe; without dispersion 0."""
    cross = W.partitionBy(by)
    out = {}
    for c, m in masks.items():
        x = masked(m, F.col(c))
        sd = F.stddev_samp(x).over(cross)
        out[c] = F.when(x.isNotNull(), F.when(sd > 0, (x - F.avg(x).over(cross)) / sd).otherwise(0.0))
    return df.withColumns(out)


def regularize(df: DataFrame, masks: Masks, low: float = 0.01, high: float = 0.99, by: str = "period") -> DataFrame:
    """Winsorize, fill with the median, standardise: three projections over one partitioning."""
    return zscore(fill_median(winsorize(df, masks, low, high, by), masks, by), masks, by)


def center_by_group(df: DataFrame, column: str, group: str) -> DataFrame:
    """Less the median of the calendar month and group."""
    return df.withColumn(column, F.col(column) - F.median(column).over(W.partitionBy(F.trunc("date", "MM"), group)))


def fill_loading(df: DataFrame, columns: list[str], by: str = "period") -> DataFrame:
    """Nulls take the median of the period's non-zero values."""
    cross = W.partitionBy(by)
    return df.withColumns({c: F.coalesce(F.col(c), F.median(F.when(F.col(c) != 0, F.col(c))).over(cross)) for c in columns})


def forward(periodic: DataFrame, column: str, lags: tuple[int, ...] = (1,)) -> DataFrame:
    order = W.partitionBy("stock_id").orderBy("period")
    return periodic.withColumns({f"fwd{k}": F.lead(column, k).over(order) for k in lags})


def forward_returns(frame: DataFrame, column: str, kind: str, events: DataFrame | None, lags: tuple[int, ...] = (1,), months: int = 3) -> DataFrame:
    """Forward returns from either kind of input: ``daily`` rows are trimmed, winsorized, compounded and settled first; ``periodic`` ones are shifted as they are.

    ``events`` must be named for daily rows (pass an empty frame for none): a return without its exits is not a return.
    """
    from quillon.operators.resample import periodic_returns

    if kind == "periodic":
        return forward(frame, column, lags)
    if kind != "daily":
        raise ValueError(f"unknown kind of returns {kind!r}: daily or periodic")
    if events is None:
        raise ValueError("daily returns need the table of exits")
    return forward(periodic_returns(frame, events, months), column, lags)


def trailing(panel: DataFrame, value: Column, rows: int, out: str, by: str = "date", added: Column | None = None) -> DataFrame:
    """``out``: ``n``, ``mean``, ``m2`` (squared deviations), ``low``, ``high`` of ``value`` and ``total`` of ``added`` over each security's last ``rows`` rows.

    A sliding frame is added up anew for every row, which costs rows times its length. Here a security's rows lie in blocks of ``rows``: a frame is
    the end of one block and the start of the next, both frames that only grow, so a row costs the same whatever the length.
    Deviations of the two parts are merged about their means, not subtracted from running sums, so nothing cancels.
    """
    own, order = W.partitionBy("stock_id"), W.partitionBy("stock_id").orderBy(by)
    made = panel.withColumn("_i", F.row_number().over(order) - 1).withColumns({"_block": F.floor(F.col("_i") / rows), "_x": value, "_add": F.lit(None).cast("double") if added is None else added})
    block, grow = W.partitionBy("stock_id", "_block"), (W.unboundedPreceding, 0)

    def state(w) -> Column:
        x = F.col("_x")
        n = F.count(x).over(w)
        return F.struct(n.alias("n"), F.avg(x).over(w).alias("mean"), (F.var_pop(x).over(w) * n).alias("m2"), F.min(x).over(w).alias("low"), F.max(x).over(w).alias("high"), F.sum("_add").over(w).alias("total"))

    made = made.withColumn("_a", state(block.orderBy("_i").rowsBetween(*grow))).withColumn("_end", state(block.orderBy(F.desc("_i")).rowsBetween(*grow)))
    before = F.lag("_end", rows - 1).over(own.orderBy("_i")) if rows > 1 else F.lit(None).cast(made.schema["_end"].dataType)
    made = made.withColumn("_b", before).withColumn("_b", F.when((F.col("_block") > 0) & ((F.col("_i") + 1) % rows != 0), F.col("_b")))
    a, b = (lambda f: F.col(f"_a.{f}")), (lambda f: F.col(f"_b.{f}"))
    some = (a("n") > 0) & (F.coalesce(b("n"), F.lit(0)) > 0)
    n, gap = a("n") + F.coalesce(b("n"), F.lit(0)), b("mean") - a("mean")
    merged = F.struct(
        n.alias("n"), F.when(some, a("mean") + gap * b("n") / n).otherwise(F.coalesce(a("mean"), b("mean"))).alias("mean"),
        F.when(some, a("m2") + b("m2") + gap * gap * a("n") * b("n") / n).otherwise(F.coalesce(a("m2"), b("m2"))).alias("m2"),
        F.least(a("low"), b("low")).alias("low"), F.greatest(a("high"), b("high")).alias("high"), F.coalesce(a("total") + b("total"), a("total"), b("total")).alias("total"),
    )
    return made.withColumn(out, merged).drop("_i", "_block", "_x", "_add", "_a", "_b", "_end")


def _deviation(s: str) -> Column:
    """Sample standard deviation from what ``trailing`` gives; exactly 0 where all values are one."""
    n, low = F.col(f"{s}.n"), F.col(f"{s}.low")
    return F.when(n >= 2, F.when((low == F.col(f"{s}.high")) & ~F.isnan(low), 0.0).otherwise(F.sqrt(F.col(f"{s}.m2") / (n - 1))))


def rolling_vol(panel: DataFrame, column: str, rows: int = 756, least: int = 252) -> DataFrame:
    return trailing(panel, F.col(column), rows, "_v").withColumn("vol", F.when(F.col("_v.n") >= least, _deviation("_v"))).drop("_v")


def momentum(panel: DataFrame, column: str, year: int = 252, month: int = 21, vol: int = 252, least: tuple[int, int, int] = (189, 10, 126)) -> DataFrame:
    """Twelve months' log return without the last month's, over rolling volatility.

    A day of -100% makes the score -1 over volatility while it is in the year but not in the month, and null while
    it is in both; ``ln`` would skip such days, so they are looked for.
    """
    growth = F.ln(F.when(F.col(column) > -1, 1 + F.col(column)))
    rows = trailing(panel, F.col(column), year, "_long", added=growth)
    rows = trailing(rows, F.col(column), month, "_short", added=growth)
    rows = rows.withColumn("_vol", F.col("_long")) if vol == year else trailing(rows, F.col(column), vol, "_vol")
    dead = lambda s: F.coalesce(F.col(f"{s}.low") <= -1, F.lit(False))
    score = F.exp(F.col("_long.total") - F.coalesce("_short.total", F.lit(0.0))) - 1
    score = F.when(dead("_short"), None).when(dead("_long"), F.lit(-1.0)).otherwise(score)
    enough = (F.col("_long.n") >= least[0]) & (F.col("_short.n") >= least[1]) & (F.col("_vol.n") >= least[2])
    return rows.withColumn("momentum", F.when(enough, F.try_divide(score, _deviation("_vol")))).drop("_long", "_short", "_vol")


def difference(df: DataFrame, columns: list[str]) -> DataFrame:
    order = W.partitionBy("stock_id").orderBy("period")
    return df.withColumns({f"d_{c}": F.col(c) - F.lag(c).over(order) for c in columns})


def rolling_beta(monthly: DataFrame, months: int = 24, least: int = 12, x: str = "x", out: str = "beta") -> DataFrame:
    """Slope of ``ret`` on ``x`` over trailing months, with an intercept."""
    w = _stock(months)
    return monthly.withColumn(out, F.when(F.count("ret").over(w) >= least, F.regr_slope("ret", x).over(w)))


def rolling_two(df: DataFrame, y: str, a: str, b: str, rows: int, least: int) -> DataFrame:
    """Slopes of ``y`` on ``a`` and ``b`` over trailing rows where all three are known, by Cramer's rule on covariances."""
    w = _stock(rows)
    known = F.col(y).isNotNull() & F.col(a).isNotNull() & F.col(b).isNotNull()
    y_, a_, b_ = (F.when(known, F.col(c)) for c in (y, a, b))
    cov = lambda p, q: F.covar_samp(p, q).over(w)
    aa, bb, ab, ya, yb = cov(a_, a_), cov(b_, b_), cov(a_, b_), cov(y_, a_), cov(y_, b_)
    rows_ = df.withColumns({"_n": F.count(y_).over(w), "_aa": aa, "_bb": bb, "_ab": ab, "_ya": ya, "_yb": yb})
    det = F.col("_aa") * F.col("_bb") - F.col("_ab") * F.col("_ab")
    safe = F.when((det > 1e-12 * F.col("_aa") * F.col("_bb")) & (F.col("_n") >= least), det)
    beta = lambda p, q, r, s: F.try_divide(F.col(p) * F.col(q) - F.col(r) * F.col(s), safe)
    return rows_.withColumn(f"beta_{a}", beta("_ya", "_bb", "_yb", "_ab")).withColumn(f"beta_{b}", beta("_yb", "_aa", "_ya", "_ab")).drop("_n", "_aa", "_bb", "_ab", "_ya", "_yb")


def walk_forward(series: DataFrame, value: str, keys: list[str], least: int = 8, shift: int = 1, full_sample: bool = False) -> DataFrame:
    """Mean of what was known at each period, its sampling variance and count; null until ``least`` observations."""
    w = W.partitionBy(*keys)
    w = w if full_sample else w.orderBy("period").rowsBetween(W.unboundedPreceding, -shift)
    n = F.count(value).over(w)
    mean, var = F.avg(value).over(w), F.var_samp(value).over(w)
    enough = n >= least if not full_sample else F.lit(True)
    return series.select(*keys, "period", F.when(enough, mean).alias("mean"), F.when(enough & (n >= 2), F.try_divide(var, n.cast("double"))).alias("se2"), n.alias("n"))


def james_stein(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Shrinks each group's means toward their mean."""
    w = W.partitionBy(*by)
    rows = estimates.withColumns({"_k": F.count("mean").over(w), "_bar": F.avg("mean").over(w), "_se2": F.avg("se2").over(w)})
    rows = rows.withColumn("_ss", F.sum((F.col("mean") - F.col("_bar")) ** 2).over(w))
    b = F.when(F.col("_k") <= 3, 0.0).when(F.col("_ss") <= 0, 1.0).otherwise(F.least(F.greatest((F.col("_k") - 3) * F.col("_se2") / F.col("_ss"), F.lit(0.0)), F.lit(1.0)))
    return rows.withColumn("js_b", b).withColumn("mean_js", F.col("_bar") + (1 - F.col("js_b")) * (F.col("mean") - F.col("_bar"))).drop("_k", "_bar", "_se2", "_ss")


def quantile_bucket(df: DataFrame, score: str, n: int, by: list[str]) -> DataFrame:
    """Buckets 1 to n by ordinal rank, ties by security; remainders are spread as (rank - 1) * n // count says."""
    w = W.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(score, "stock_id"))
    return df.where(F.col(score).isNotNull()).withColumn("bucket", (F.floor((rank - 1) * n / F.count("*").over(w)) + 1).cast("long"))


def average_rank(df: DataFrame, column: str, by: list[str], out: str) -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    return df.withColumn(out, F.rank().over(W.partitionBy(*by).orderBy(column)) + (F.count("*").over(W.partitionBy(*by, column)) - 1) / 2.0)


def ema(df: DataFrame, column: str, keys: list[str], keep: float) -> DataFrame:
    """keep * previous + (1 - keep) * new, seeded by the first value; restarts after a missing period number ``t``.

    A null value counts as a missing period: its own result is null, and the next value starts anew. A row folds the
    values before it only as far back as their weight exceeds 1e-18, so frames are bounded however long a run is.
    """
    reach = 1 if keep <= 0 else max(1, math.ceil(math.log(1e-18) / math.log(keep)))
    order = W.partitionBy(*keys, "_known").orderBy("t")
    rows = df.withColumn("_known", F.col(column).isNotNull()).withColumn("_run", F.col("t") - F.row_number().over(order))
    path = F.collect_list(column).over(W.partitionBy(*keys, "_known", "_run").orderBy("t").rowsBetween(-reach, 0))
    fold = F.aggregate(F.slice(path, 2, F.size(path)), F.try_element_at(path, F.lit(1)), lambda a, x: keep * a + (1 - keep) * x)
    return rows.withColumn("ema", F.when(F.col("_known"), fold)).drop("_run", "_known")


def trailing_periods(n: int, by: list[str], t: str = "t"):
    """A frame of the last ``n`` distinct period numbers."""
    return W.partitionBy(*by).orderBy(t).rangeBetween(1 - n, 0)


def drawdown(series: DataFrame, column: str, by: list[str], order: str) -> DataFrame:
    """Growth of one unit, and its fall from the highest point so far."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = series.withColumn("curve", F.product(1 + F.col(column)).over(w))
    return rows.withColumn("drawdown", F.col("curve") / F.max("curve").over(w) - 1)


def transitions(history: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """Entries and exits against the window before."""
    before = F.coalesce(F.lag(flag).over(W.partitionBy(*keys).orderBy(order)), F.lit(False))
    return history.withColumn("change", F.when(F.col(flag) & ~before, "entry").when(~F.col(flag) & before, "exit"))
