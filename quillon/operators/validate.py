"""Factor tests: rank correlations, quantile portfolios, Fama-MacBeth, redundancy and selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.regress import coefficients, moments
from quillon.operators.windows import average_rank, quantile_bucket
from quillon.sources.shared import materialize, shared_dir


def correlation(a: str, b: str) -> Column:
    """Pearson correlation that is null, not an error, without dispersion."""
    return F.try_divide(F.covar_samp(a, b), F.when(F.stddev_samp(a) * F.stddev_samp(b) > 0, F.stddev_samp(a) * F.stddev_samp(b)))


def long_scores(scores: DataFrame, factors: list[str]) -> DataFrame:
    return scores.unpivot(["stock_id", "period"], factors, "factor", "score").where("score is not null")


def rank_ic(scores: DataFrame, forward: DataFrame, factors: list[str], lags: tuple[int, ...]) -> DataFrame:
    """Spearman correlation of scores with returns ``lag`` periods ahead, for all factors and lags in one job."""
    returns = forward.select("stock_id", "period", *[F.col(f"fwd{k}").alias(str(k)) for k in lags]).unpivot(["stock_id", "period"], [str(k) for k in lags], "lag", "fwd").where("fwd is not null")
    both = long_scores(scores, factors).join(returns.withColumn("lag", F.col("lag").cast("int")), ["stock_id", "period"])
    by = ["period", "factor", "lag"]
    ranked = average_rank(average_rank(both, "score", by, "_a"), "fwd", by, "_b")
    return ranked.groupBy(*by).agg(correlation("_a", "_b").alias("ic"), F.count("*").alias("n"))


def residual_returns(forward: DataFrame, exposures: DataFrame, xs: list[str], lags: tuple[int, ...]) -> DataFrame:
    """Forward returns net of what ``exposures`` (``stock_id``, ``period``, ``xs``) explain of them within each period; unknown exposures leave a null."""
    from quillon.operators.regress import residuals

    ys = [f"fwd{k}" for k in lags]
    return residuals(forward.select("stock_id", "period", *ys).join(exposures.select("stock_id", "period", *xs), ["stock_id", "period"], "left"), ["period"], ys, xs).drop(*xs)


def information_ratio(ic: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ic.groupBy("factor", "lag").agg(F.avg("ic").alias("mean_ic"), F.try_divide(F.avg("ic"), F.when(sd > 0, sd)).alias("ir"), F.count("ic").alias("n"))


def quantile_returns(scores: DataFrame, forward: DataFrame, factors: list[str], n: int, weight: str | None = None) -> DataFrame:
    """Mean forward return of each factor's buckets over periods; weighted within a period if asked."""
    rows = long_scores(scores, factors).join(forward.where("fwd1 is not null"), ["stock_id", "period"])
    ranked = quantile_bucket(rows, "score", n, ["period", "factor"])
    x = F.avg("fwd1") if weight is None else F.try_divide(F.sum(F.col("fwd1") * F.col(weight)), F.sum(F.when(F.col("fwd1").isNotNull(), F.col(weight))))
    by_period = ranked.groupBy("period", "factor", "bucket").agg(x.alias("r"))
    return by_period.groupBy("factor", "bucket").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n_periods"))


def fama_macbeth(panel: DataFrame, y: str, factors: list[str], keys: tuple[str, ...] = ("period",), least: int | None = None) -> DataFrame:
    """Coefficients of every cross-section: stage one."""
    return coefficients(moments(panel, list(keys), F.col(y), [F.col(x) for x in factors]), list(keys), factors, least)


def composite(scores: DataFrame, members: list[str], out: str, by: str = "period") -> DataFrame:
    """``out``: the mean of a cluster's known scores, standardised again within each period; 0 where a period has no spread."""
    from quillon.functions.scalars import row_mean

    cross = W.partitionBy(by)
    rows = scores.withColumn("_c", row_mean([F.col(c) for c in members]))
    sd = F.stddev_samp("_c").over(cross)
    return rows.withColumn(out, F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col("_c") - F.avg("_c").over(cross)) / sd)).drop("_c")


def fama_macbeth_runs(panel: DataFrame, y: str, common: list[str], sectors: dict[str, list[str]], member: dict[str, Column], pooled: bool) -> DataFrame:
    """Coefficients by ``sub_universe`` and period of all runs in one job; ``factor`` has ``const`` and what a run reports.

    Pooled: one run "all" over every member of a sector, sector factors 0 off their sector, reports the common factors; each sector's
    run, with the common factors as controls, reports its own. Otherwise a run for each sector reports everything. A row takes part with
    all of its run's factors known; a period needs more rows than factors. Regressors that are no run's are zeros in it, with
    coefficients of 0 that are not reported.
    """
    names = [*common, *[f for own in sectors.values() for f in own]]
    inside = {sector: F.coalesce(m, F.lit(False)) for sector, m in member.items()}
    held = {f: inside[sector] for sector, own in sectors.items() for f in own}
    runs = []
    if pooled:
        some = F.lit(False)
        for m in inside.values():
            some = some | m
        cells = [F.col(f).cast("double").alias(f) if f in common else F.when(held[f], F.col(f).cast("double")).otherwise(0.0).alias(f) for f in names]
        runs.append(F.when(some, F.struct(F.lit("all").alias("sub_universe"), F.lit(len(names)).alias("k"), *cells)))
    for sector, own in sectors.items():
        cells = [F.col(f).cast("double").alias(f) if f in common or f in own else F.lit(0.0).alias(f) for f in names]
        runs.append(F.when(inside[sector], F.struct(F.lit(sector).alias("sub_universe"), F.lit(len(common) + len(own)).alias("k"), *cells)))
    rows = panel.select("period", F.col(y).alias("_y"), F.explode(F.array(*runs)).alias("_r")).where("_r is not null").select("period", "_y", "_r.*")
    fit = coefficients(moments(rows, ["sub_universe", "k", "period"], F.col("_y"), [F.col(f) for f in names]), ["sub_universe", "k", "period"], names, 1).where(F.col("n") > F.col("k"))
    long = fit.unpivot(["sub_universe", "period"], ["const", *names], "factor", "coef")
    told = F.col("factor") == "const"
    for run in (["all"] if pooled else []) + list(sectors):
        own = common if run == "all" else sectors[run] if pooled else [*common, *sectors[run]]
        told = told | ((F.col("sub_universe") == run) & F.col("factor").isin(own))
    return long.where(told)


def pooled_design(panel: DataFrame, masks: dict[str, Column]) -> DataFrame:
    """Sector factors count as 0 off their sector, so each factor is tested once with all names as controls."""
    return panel.withColumns({c: F.when(m, F.col(c)).otherwise(0.0) for c, m in masks.items()})


def premia(coefs: DataFrame, factors: list[str], keys: tuple[str, ...] = ("period",)) -> DataFrame:
    return coefs.unpivot(list(keys), factors, "factor", "coef")


def newey_west(series: DataFrame, by: list[str], value: str = "coef") -> DataFrame:
    """Mean, Bartlett-weighted standard error and t of each series; lags grow as 4 (T / 100)^(2/9)."""
    order = W.partitionBy(*by).orderBy("period")
    group = W.partitionBy(*by)
    rows = series.where(F.col(value).isNotNull()).select(*by, F.row_number().over(order).alias("t"), F.col(value).alias("v"), F.count("*").over(group).alias("n_all"), F.avg(value).over(group).alias("m"))
    rows = rows.withColumn("e", F.col("v") - F.col("m"))
    lags = F.least(F.greatest(F.floor(4 * F.pow(F.col("n_all") / 100.0, F.lit(2.0 / 9))), F.lit(1)), F.col("n_all") - 1).cast("int")
    # Each row meets its few predecessors: an equi-join on the position it looks back to.
    back = rows.withColumn("L", lags).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("L")))).withColumn("at", F.col("t") - F.col("k"))
    prior = rows.select(*by, F.col("t").alias("at"), F.col("e").alias("e_k"))
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (F.col("L") + 1)))
    total = back.join(prior, [*by, "at"]).groupBy(*by).agg(F.sum(weight * F.col("e") * F.col("e_k")).alias("g"), F.first("n_all").alias("n_periods"), F.first("m").alias("mean_coef"))
    se = F.sqrt(F.greatest(F.col("g"), F.lit(0.0))) / F.col("n_periods")
    return total.select(*by, "mean_coef", se.alias("nw_se"), F.try_divide("mean_coef", F.when(se > 0, se)).alias("t_stat"), "n_periods")


def average_correlation(scores: DataFrame, factors: list[str], threshold: float, cutoffs: DataFrame | None = None, train: int | None = None) -> DataFrame:
    """Pairwise correlation per period, averaged over time; the pairs come from factor names, the sums from one pass.

    With ``cutoffs``, once for each ``cutoff``, over the periods up to it.
    """
    pairs = [(a, b) for i, a in enumerate(sorted(factors)) for b in sorted(factors)[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()

    def corr(a: str, b: str) -> Column:
        x, y = F.when(both(a, b), F.col(a)), F.when(both(a, b), F.col(b))
        spread = F.stddev_samp(x) * F.stddev_samp(y)
        return F.try_divide(F.covar_samp(x, y), F.when(spread > 0, spread))

    wide = scores.groupBy("period").agg(*[corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot(["period"], [f"{a}|{b}" for a, b in pairs], "pair", "corr")
    by = []
    if cutoffs is not None:
        long, by = long.join(F.broadcast(cutoffs), in_sight(0, train)), ["cutoff"]
    out = long.groupBy(*by, F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b")).agg(F.avg("corr").alias("avg_corr"))
    return out.withColumn("redundant", F.coalesce(F.abs("avg_corr") > threshold, F.lit(False)))


def clusters(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """Connected components: every node takes the smallest label around it until none changes.

    ``nodes`` has ``node``; ``edges`` has ``a`` and ``b``. Each round is a join and a grouped minimum, checkpointed in the
    shared folder; a label also jumps to the label of its label, so a chain takes the logarithm of its length.
    Components that have not settled after ``rounds`` are an error.
    """
    shared_dir(nodes.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    labels = nodes.select("node", F.col("node").alias("cluster"))
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("cluster").alias("low"))
        new = labels.join(near, labels.node == near.a, "left").select("node", F.least("cluster", F.coalesce("low", "cluster")).alias("cluster"), F.col("cluster").alias("old"))
        far = new.select(F.col("node").alias("via"), F.col("cluster").alias("jump"))
        new = new.join(far, F.col("cluster") == F.col("via"), "left").select("node", F.least("cluster", F.coalesce("jump", "cluster")).alias("cluster"), "old").checkpoint()
        labels = new.select("node", "cluster")
        if not new.where("cluster <> old").limit(1).count():
            return labels
    raise RuntimeError(f"clusters did not settle in {rounds} rounds")


def clusters_within(nodes: DataFrame, edges: DataFrame, by: str) -> DataFrame:
    """Clusters of many small graphs at once, one for each ``by``: a graph has a node for each registered factor at most.

    ``nodes`` has ``by`` and ``factor``; ``edges`` has ``by``, ``a`` and ``b``, of which those between other nodes are left out.
    """
    kind = nodes.schema[by].dataType.simpleString()
    graph = nodes.select(by, F.col("factor").alias("a"), F.col("factor").alias("b")).unionByName(edges.select(by, "a", "b"))

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        low = {x: x for x in pdf.loc[pdf["a"] == pdf["b"], "a"]}
        pairs = [(x, y) for x, y in zip(pdf["a"], pdf["b"], strict=True) if x in low and y in low and x != y]
        for _ in low:
            for x, y in pairs:
                low[x] = low[y] = min(low[x], low[y])
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(low), "factor": list(low), "cluster": list(low.values())}, dtype=object)

    return graph.groupBy(by).applyInPandas(label, f"{by} {kind}, factor string, cluster string")


def representatives(members: DataFrame, has: str, strength: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The strongest factor of each cluster; one with a statistic beats one without, then the smaller name wins.

    A rank picks it, so ``members`` is worked out once: sums of doubles differ in their last bits from run to run, and
    looking for the maximum in a second run would lose clusters. A cluster holds registered factors only.
    """
    order = W.partitionBy(*by, "cluster").orderBy(F.col(has).desc_nulls_last(), F.abs(strength).desc_nulls_last(), "factor")
    return members.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*by, "cluster", "factor")


def best_ir(members: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Representatives by the largest information ratio, whatever its sign."""
    return representatives(members.withColumn("_has", F.col("ir").isNotNull()), "_has", "ir", by)


def scorecard_order(card: DataFrame) -> DataFrame:
    """Numbers the rows of a scorecard: by cutoff, selected first, then by size of IR and of t, nulls last, then by name."""
    order = [F.col("selected").desc_nulls_last(), F.abs("ir_lag1").desc_nulls_last(), F.abs("fm_t").desc_nulls_last(), F.col("factor")]
    return card.withColumn("place", F.row_number().over(W.partitionBy("cutoff").orderBy(*order)).cast("long"))


def first_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first by ``order``."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def reproducible_pick(df: DataFrame, keys: list[str], seed: str, n: int = 1) -> DataFrame:
    """``n`` distinct keys picked at random, the same on every run and however rows are partitioned: those of the smallest seeded digests."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]))
    return df.select(*keys).distinct().orderBy(digest, *keys).limit(n)


def best_rows(df: DataFrame, key: str, strength: str) -> DataFrame:
    """The row of the strongest statistic of each key, nulls last."""
    order = W.partitionBy(key).orderBy(F.abs(strength).desc_nulls_last(), *[c for c in df.columns if c not in (key, strength)])
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _soft(x: float, a: float) -> float:
    return np.sign(x) * max(abs(x) - a, 0.0)


def _descend(xx: np.ndarray, xy: np.ndarray, alpha: float, start: np.ndarray, sweeps: int = 500) -> np.ndarray:
    w = start.copy()
    for _ in range(sweeps):
        before = w.copy()
        for j in range(len(w)):
            if xx[j, j] > 0:
                w[j] = _soft(xy[j] - xx[j] @ w + xx[j, j] * w[j], alpha) / xx[j, j]
        if np.abs(w - before).max() < 1e-10:
            break
    return w


def lasso_from_moments(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, folds: int = 5, n_alphas: int = 50, ratio: float = 1e-3) -> np.ndarray:
    """Cross-validated lasso from per-period moments (constant first), expanding folds of whole periods.

    Regressors are standardised (population moments of all rows). Fold errors are quadratic forms of fold moments, so
    no rows are needed.
    """
    def centred(lo: int, hi: int) -> tuple[float, np.ndarray, np.ndarray, float]:
        m, a, b, c = n[lo:hi].sum(), xx[lo:hi].sum(axis=0), xy[lo:hi].sum(axis=0), yy[lo:hi].sum()
        mean, my = a[0, 1:] / m, b[0] / m
        return m, a[1:, 1:] / m - np.outer(mean, mean), b[1:] / m - mean * my, c / m - my * my

    total = centred(0, len(n))
    scale = np.sqrt(np.maximum(np.diag(total[1]), 1e-300))
    gram, cov = total[1] / np.outer(scale, scale), total[2] / scale
    top = np.abs(cov).max()
    if not top > 0:
        return np.zeros(len(cov))
    alphas = np.geomspace(top, top * ratio, n_alphas)
    folds = min(folds, len(n) - 1)
    errors = np.zeros(n_alphas)
    size = len(n) // (folds + 1) if folds > 0 else 0
    for f in range(folds):
        cut = len(n) - (folds - f) * size
        train, test = centred(0, cut), (n[cut : cut + size].sum(), xx[cut : cut + size].sum(axis=0), xy[cut : cut + size].sum(axis=0), yy[cut : cut + size].sum())
        m, a, b = n[:cut].sum(), xx[:cut].sum(axis=0), xy[:cut].sum(axis=0)
        w = np.zeros(len(cov))
        for k, alpha in enumerate(alphas):
            w = _descend(train[1] / np.outer(scale, scale), train[2] / scale, alpha, w)
            beta = w / scale
            full = np.concatenate([[(b[0] - a[0, 1:] @ beta) / m], beta])
            errors[k] += (test[3] - 2 * full @ test[2] + full @ test[1] @ full) / max(test[0], 1)
    w = np.zeros(len(cov))
    best = alphas[int(errors.argmin())] if folds > 0 else alphas[-1]
    for alpha in alphas[alphas >= best]:
        w = _descend(gram, cov, alpha, w)
    return w


def lasso_select(panel: DataFrame, y: str, factors: list[str], universe: str = "sub_universe", tiny: float = 1e-5) -> DataFrame:
    """Standardised lasso coefficients by sub-universe; ``selected`` where they exceed ``tiny``.

    Moments are added up per period in one pass; a group then holds one small matrix per period.
    """
    sums = moments(panel, [universe, "period"], F.col(y), [F.col(x) for x in factors]).where("n > 0")
    k = len(factors) + 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        xx = np.stack(pdf["xx"].map(np.asarray)).astype(float).reshape(-1, k, k)
        w = lasso_from_moments(pdf["n"].to_numpy(float), xx, np.stack(pdf["xy"].map(np.asarray)).astype(float), pdf["yy"].to_numpy(float))
        return pd.DataFrame({universe: pdf[universe].iloc[0], "factor": factors, "coef": w, "selected": np.abs(w) > tiny})

    return sums.groupBy(universe).applyInPandas(fit, f"{universe} string, factor string, coef double, selected boolean")


def in_sight(horizon: int = 0, train: int | None = None) -> Column:
    """Whether a cutoff may use a period: what it predicts, ``horizon`` months ahead, is known; at most ``train`` months back."""
    seen = F.add_months("period", horizon) <= F.col("cutoff") if horizon else F.col("period") <= F.col("cutoff")
    return seen if train is None else seen & (F.col("period") > F.add_months("cutoff", -train))


def statistics_by_cutoff(series: DataFrame, cutoffs: DataFrame, by: list[str], value: str, train: int | None = None, horizon: int = 0) -> DataFrame:
    """Statistics of what each cutoff may see, all cutoffs in one join."""
    rows = series.join(F.broadcast(cutoffs), in_sight(horizon, train))  # a few dozen cutoffs
    sd = F.stddev_samp(value)
    return rows.groupBy("cutoff", *by).agg(F.avg(value).alias("mean"), F.try_divide(F.avg(value), F.when(sd > 0, sd)).alias("ir"), F.count(value).alias("n"))


def lasso_by_cutoff(panel: DataFrame, y: str, factors: list[str], chosen: DataFrame, horizon: int, train: int | None = None, universe: str = "sub_universe", tiny: float = 1e-5) -> DataFrame:
    """``cutoff``, ``factor`` of the lasso's survivors in any sub-universe, fitted on each cutoff's ``chosen`` (cutoff, factor) alone.

    Moments are added up per period, once for each set of factors that some cutoff chose: a row counts if those are
    known. A cutoff takes the periods in its sight.
    """
    sets = materialize(chosen.groupBy("cutoff").agg(F.array_join(F.array_sort(F.collect_set("factor")), "|").alias("set")), "lasso-sets")
    rows = panel.crossJoin(F.broadcast(sets.select("set").distinct()))  # one row for each cutoff at most
    inside = lambda x: F.array_contains(F.split("set", r"\|"), x)
    sums = moments(rows, ["set", universe, "period"], F.col(y), [F.when(inside(x), F.col(x)).otherwise(0.0) for x in factors]).where("n > 0")
    seen = sums.join(F.broadcast(sets), "set").where(in_sight(horizon, train))
    k = len(factors) + 1

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        xx = np.stack(pdf["xx"].map(np.asarray)).astype(float).reshape(-1, k, k)
        w = lasso_from_moments(pdf["n"].to_numpy(float), xx, np.stack(pdf["xy"].map(np.asarray)).astype(float), pdf["yy"].to_numpy(float))
        return pd.DataFrame({"cutoff": [pdf["cutoff"].iloc[0]] * len(w), "factor": list(factors), "coef": w})

    return seen.groupBy("cutoff", universe).applyInPandas(fit, "cutoff date, factor string, coef double").where(F.abs("coef") > tiny).select("cutoff", "factor").distinct()


def select_factors(ic: DataFrame, coefs: DataFrame, cutoffs: DataFrame, correlations: DataFrame, min_ir: float, min_t: float, panel: DataFrame | None = None, y: str = "fwd1", style: list[str] | None = None, horizon: int = 3, train: int | None = None) -> DataFrame:
    """Scorecard by cutoff: gates on information ratio or t, clusters of those that pass, then the lasso over style representatives.

    A cutoff sees periods whose return, ``horizon`` months ahead, is known by then, ``train`` months back at most.
    ``correlations`` has (cutoff, a, b) of redundant pairs, from data up to that cutoff. A cluster is represented by its
    largest mean coefficient; one without a coefficient goes by its information ratio. ``panel`` has the ``style`` factors, ``y`` and
    ``sub_universe``; representatives that are not style factors bypass the lasso, and all do without a panel.
    ``cluster`` and ``lasso`` are null for factors that did not come so far. Each step's table, a few rows for each
    cutoff, is written once.
    """
    ir = statistics_by_cutoff(ic.where("lag = 1"), cutoffs, ["factor"], "ic", train, horizon).select("cutoff", "factor", F.col("ir").alias("ir_lag1"))
    seen = coefs.join(F.broadcast(cutoffs), in_sight(horizon, train))
    t = newey_west(seen, ["cutoff", "factor"]).select("cutoff", "factor", F.col("t_stat").alias("fm_t"), F.col("mean_coef").alias("fm_coef"))
    card = ir.join(t, ["cutoff", "factor"], "full")
    card = materialize(card.withColumn("passed", F.coalesce(F.abs("ir_lag1") >= min_ir, F.lit(False)) | F.coalesce(F.abs("fm_t") >= min_t, F.lit(False))), "selection-gates")
    passed = card.where("passed")
    labels = clusters_within(passed.select("cutoff", "factor"), correlations.select("cutoff", "a", "b"), "cutoff")
    members = passed.join(labels, ["cutoff", "factor"]).withColumn("has", F.col("fm_coef").isNotNull()).withColumn("strength", F.coalesce("fm_coef", "ir_lag1"))
    members = materialize(members, "selection-clusters")
    best = representatives(members, "has", "strength", ("cutoff",)).select("cutoff", "factor", F.lit(True).alias("representative"))
    steps = members.select("cutoff", "factor", "cluster").join(best, ["cutoff", "factor"], "left")
    card = card.join(steps, ["cutoff", "factor"], "left").withColumn("representative", F.coalesce("representative", F.lit(False)))
    if panel is None:
        return card.withColumn("lasso", F.lit(None).cast("boolean")).withColumn("selected", F.col("representative"))
    card = materialize(card, "selection-card")
    entered = F.col("representative") & F.col("factor").isin(style)
    survivors = lasso_by_cutoff(panel, y, style, card.where(entered).select("cutoff", "factor"), horizon, train).withColumn("_kept", F.lit(True))
    card = card.join(survivors, ["cutoff", "factor"], "left").withColumn("lasso", F.when(entered, F.coalesce("_kept", F.lit(False)))).drop("_kept")
    return card.withColumn("selected", F.col("representative") & F.coalesce("lasso", F.lit(True)))


def carry_forward(history: DataFrame, by: str = "cutoff") -> DataFrame:
    """Shortlists by cutoff; one that is empty takes over the last that was not. The window runs over cutoffs."""
    lists = history.groupBy(by).agg(F.sort_array(F.collect_set(F.when(F.col("selected"), F.col("factor")))).alias("_own"))
    filled = F.last(F.when(F.size("_own") > 0, F.col("_own")), ignorenulls=True).over(W.orderBy(by).rowsBetween(W.unboundedPreceding, 0))
    return lists.select(by, filled.alias("shortlist"))
