"""Panel econometrics from moment sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.tails import f_p, student_p
from quillon.sources.shared import materialize


def balanced(panel: DataFrame, event: str) -> DataFrame:
    """Firms with rows before and from the event date on; ``post`` flags the latter."""
    firm = W.partitionBy("stock_id")
    at = F.lit(event).cast("date")
    rows = panel.withColumn("_a", F.min("date").over(firm)).withColumn("_b", F.max("date").over(firm))
    return rows.where((F.col("_a") < at) & (F.col("_b") >= at)).withColumn("post", (F.col("date") >= at).cast("int")).drop("_a", "_b")


def demean_two_ways(df: DataFrame, columns: list[str], a: str = "stock_id", b: str = "period", keys: tuple[str, ...] = ()) -> DataFrame:
    """Sweeps out both fixed effects exactly, on balanced and unbalanced panels alike; in each panel by itself if ``keys`` name several.

    ``a`` may have any number of levels and goes by one window. What is left depends on ``b``, the calendar, through
    normal equations with one row for each of its levels, whose counts come from firms that share a pattern of
    periods; one task solves those of a panel (periods squared numbers), and the effects are joined back. Nulls count for nothing.
    """
    if not keys:
        out = demean_two_ways(df.withColumn("_all", F.lit(1)), columns, a, b, ("_all",))
        return out.drop("_all")
    firm = W.partitionBy(*keys, a)
    names = [f"_d{k}" for k in range(len(columns))]
    rows = df.withColumns({n: F.col(c) - F.avg(c).over(firm) for n, c in zip(names, columns, strict=True)})
    cells = df.groupBy(*keys, a, b).agg(F.count("*").alias("m"))
    patterns = cells.groupBy(*keys, a).agg(F.sort_array(F.collect_list(F.struct(F.col(b).alias("t"), "m"))).alias("p")).groupBy(*keys, "p").agg(F.count("*").alias("firms"))
    total = F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x["m"])
    pairs = patterns.select(*keys, "p", (F.col("firms") / total).alias("w"), F.explode("p").alias("x")).select(*keys, "w", "x", F.explode("p").alias("y"))
    shared = pairs.groupBy(*keys, F.col("x.t").alias("t"), F.col("y.t").alias("s")).agg(F.sum(F.col("w") * F.col("x.m") * F.col("y.m")).alias("g"))
    sums = rows.groupBy(*keys, F.col(b).alias("t")).agg(F.count("*").cast("double").alias("n"), *[F.sum(n).alias(n) for n in names])
    system = shared.join(sums, [*keys, "t"])
    kinds = {c: df.schema[c].dataType.simpleString() for c in (*keys, b)}

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        levels = sorted(pdf["t"].unique())
        at = {t: k for k, t in enumerate(levels)}
        i, j = pdf["t"].map(at).to_numpy(), pdf["s"].map(at).to_numpy()
        left = np.zeros((len(levels), len(levels)))
        left[i, j] = -pdf["g"].to_numpy(float)
        first = pdf.drop_duplicates("t").sort_values("t")
        left[np.diag_indices(len(levels))] += first["n"].to_numpy(float)
        effects = np.linalg.pinv(left, rcond=1e-12, hermitian=True) @ first[names].to_numpy(float)
        own = {f"_k{k}": [pdf[c].iloc[0]] * len(levels) for k, c in enumerate(keys)}
        return pd.DataFrame(own | {"_t": levels} | {f"_e{k}": effects[:, k] for k in range(len(names))})

    schema = [f"_k{k} {kinds[c]}" for k, c in enumerate(keys)] + [f"_t {kinds[b]}"] + [f"_e{k} double" for k in range(len(names))]
    effects = system.groupBy(*keys).applyInPandas(solve, ", ".join(schema))
    same = F.col(b) == F.col("_t")
    for k, c in enumerate(keys):
        same = same & (F.col(c) == F.col(f"_k{k}"))
    joined = rows.join(F.broadcast(effects) if keys == ("_all",) else effects, same)  # of one panel: a row for each period
    out = joined.withColumns({c: F.col(n) - F.col(f"_e{k}") + F.avg(f"_e{k}").over(firm) for k, (n, c) in enumerate(zip(names, columns, strict=True))})
    return out.drop("_t", *names, *[f"_e{k}" for k in range(len(names))], *[f"_k{k}" for k in range(len(keys))])


def clustered_fits(swept: DataFrame, keys: list[str], y: str, xs: list[str], a: str, b: str) -> DataFrame:
    """Least squares of many designs at once, with sandwich covariances clustered by ``a``; a row for each of ``keys``.

    ``y`` and ``xs`` have both effects (of ``a`` and ``b``) swept out. Each design adds up X'X and X'y; each cluster its
    score vector X'e; each design the outer products of its clusters' scores: three grouped sums, and only K x K blocks
    are inverted. Returns ``coef`` and ``cov`` (row-wise) by the order of ``xs``, ``n``, ``k`` (regressors with any variation; the
    others have null coefficients) and ``df``, the rows beyond regressors and effects. Covariances have the factor n / df.
    """
    width = len(xs)
    x = [F.col(c).cast("double") for c in xs]
    known = materialize(swept.where(F.col(y).isNotNull()).select(*dict.fromkeys([*keys, a, b, y, *xs])), "swept")  # three sums read it
    upper = {(i, j): F.sum(x[i] * x[j]) for i in range(width) for j in range(i, width)}
    sums = known.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_distinct(a).alias("_a"), F.count_distinct(b).alias("_b"),
        F.array(*[upper[min(i, j), max(i, j)] for i in range(width) for j in range(width)]).alias("xx"), F.array(*[F.sum(x[i] * F.col(y)) for i in range(width)]).alias("xy"),
    )
    kinds = ", ".join(f"`{k}` {swept.schema[k].dataType.simpleString()}" for k in keys)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            inverse, coef, rank = [], [], []
            for xx, xy in zip(pdf["xx"], pdf["xy"], strict=True):
                xx = np.asarray(xx, dtype=float).reshape(width, width)
                live = np.diag(xx) > 1e-9
                scale = np.where(live, np.sqrt(np.maximum(np.diag(xx), 1e-300)), 1.0)
                inv = np.linalg.pinv(np.where(np.outer(live, live), xx / np.outer(scale, scale), 0.0), rcond=1e-10, hermitian=True) / np.outer(scale, scale)
                beta = inv @ np.asarray(xy, dtype=float)
                inverse.append(inv.ravel())
                coef.append(beta)
                rank.append(int(live.sum()))
            yield pdf[[*keys, "n", "_a", "_b"]].assign(inv=inverse, beta=coef, k=rank)

    fitted = sums.mapInPandas(solve, f"{kinds}, n long, _a long, _b long, inv array<double>, beta array<double>, k int")
    line = F.lit(0.0)
    for i in range(width):
        line = line + x[i] * F.col("beta")[i]
    scored = known.join(fitted.select(*keys, "beta"), keys).withColumn("_e", F.col(y) - line)
    scores = scored.groupBy(*keys, a).agg(*[F.sum(x[i] * F.col("_e")).alias(f"_s{i}") for i in range(width)])
    outer = {(i, j): F.sum(F.col(f"_s{i}") * F.col(f"_s{j}")) for i in range(width) for j in range(i, width)}
    meat = scores.groupBy(*keys).agg(F.array(*[outer[min(i, j), max(i, j)] for i in range(width) for j in range(width)]).alias("meat"))

    def sandwich(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cov, coef = [], []
            df = (pdf["n"] - pdf["k"] - pdf["_a"] - pdf["_b"] + 1).to_numpy()
            for inv, mid, beta, n, d in zip(pdf["inv"], pdf["meat"], pdf["beta"], pdf["n"], df, strict=True):
                inv = np.asarray(inv, dtype=float).reshape(width, width)
                live = np.diag(inv) > 0
                whole = inv @ np.asarray(mid, dtype=float).reshape(width, width) @ inv * (n / d if d > 0 else np.nan)
                cov.append([None if np.isnan(v) else float(v) for v in np.where(np.outer(live, live), whole, np.nan).ravel()])
                coef.append([float(v) if ok else None for v, ok in zip(beta, live, strict=True)])
            yield pdf[[*keys, "n", "k"]].assign(df=df, coef=coef, cov=cov)

    return fitted.join(meat, keys).mapInPandas(sandwich, f"{kinds}, n long, k int, df long, coef array<double>, cov array<double>")


def _tests(fits: DataFrame, keys: list[str], labels: Column, width: int) -> DataFrame:
    """A row for each label (in the order of the regressors) that has a coefficient: ``term``, ``coef``, ``se``, ``t_stat``, ``p_value``, ``n``."""
    one = fits.select(*keys, "n", "df", "coef", "cov", F.posexplode(labels).alias("_i", "term"))
    se = F.sqrt(F.try_element_at("cov", F.col("_i") * (width + 1) + 1))
    rows = one.select(*keys, "term", F.try_element_at("coef", F.col("_i") + 1).alias("coef"), F.when(se > 0, se).alias("se"), "n", "df").where("coef is not null")
    return rows.withColumn("t_stat", F.try_divide("coef", "se")).withColumn("p_value", student_p(F.col("t_stat"), F.when(F.col("df") > 0, F.col("df")))).select(*keys, "term", "coef", "se", "t_stat", "p_value", "n")


def did_by_unit(panel: DataFrame, cohorts: dict[str, list], outcomes: list[str], months: int, unit: str = "currency", date: str = "date", keys: tuple[str, ...] = ("method",)) -> DataFrame:
    """Difference in differences of every treated unit, for all cohorts, outcomes and ``keys`` in one job.

    ``cohorts`` maps an event date to the units treated from it on; units in none are controls of all. A design takes its treated
    units and the controls within ``months`` on either side of the date. Each treated unit has an effect of its own, both fixed
    effects are swept out, and errors are clustered by unit. Rows without the outcome, or the unit, play no part; a unit without
    rows on both sides has no effect. Returns ``keys``, ``cohort``, ``outcome``, the unit, ``coef``, ``se``, ``t_stat``, ``p_value``, ``n``.
    """
    kind = panel.schema[unit].dataType
    width = max(len(units) for units in cohorts.values())
    treated = F.array(*[F.lit(u).cast(kind) for units in cohorts.values() for u in units])
    all_ = F.array(*[F.struct(F.lit(d).cast("date").alias("cohort"), F.array(*[F.lit(u).cast(kind) for u in units]).alias("units")) for d, units in cohorts.items()])
    at = F.col(date).cast("date")
    seen = lambda c: (F.array_contains(c["units"], F.col(unit)) | ~F.array_contains(treated, F.col(unit))) & at.between(F.add_months(c["cohort"], -months), F.add_months(c["cohort"], months))
    framed = panel.where(F.col(unit).isNotNull() & at.isNotNull()).withColumn("_c", F.explode(F.filter(all_, seen)))
    long = framed.select(*keys, "_c.cohort", "_c.units", F.col(unit).alias("_unit"), at.alias("_date"), *[F.col(o).cast("double").alias(o) for o in outcomes])
    long = long.unpivot([*keys, "cohort", "units", "_unit", "_date"], outcomes, "outcome", "y").where("y is not null")
    xs = [f"_x{i}" for i in range(width)]
    design = [*keys, "cohort", "outcome"]
    rows = long.withColumns({x: ((F.array_position("units", F.col("_unit")) == i + 1) & (F.col("_date") >= F.col("cohort"))).cast("double") for i, x in enumerate(xs)})
    rows = materialize(rows, "did-rows")
    swept = demean_two_ways(rows, ["y", *xs], "_unit", "_date", tuple(design))
    fits = clustered_fits(swept, design, "y", xs, "_unit", "_date")
    named = F.element_at(F.map_from_arrays(F.transform(all_, lambda c: c["cohort"]), F.transform(all_, lambda c: c["units"])), F.col("cohort"))
    return _tests(fits, design, named, width).withColumnRenamed("term", unit)


def _clustered(df: DataFrame, x: str, y: str, cluster: list[str]) -> DataFrame:
    """Slope of demeaned ``y`` on demeaned ``x`` with a sandwich error clustered by ``cluster``: sums, then sums of squares of sums."""
    slope = df.agg(F.try_divide(F.sum(F.col(x) * F.col(y)), F.when(F.sum(F.col(x) * F.col(x)) > 1e-12, F.sum(F.col(x) * F.col(x)))).alias("beta"), F.sum(F.col(x) * F.col(x)).alias("xx"), F.count(y).alias("n"))
    score = df.crossJoin(F.broadcast(slope)).groupBy(*cluster).agg(F.sum(F.col(x) * (F.col(y) - F.col("beta") * F.col(x))).alias("g"), F.first("beta").alias("beta"), F.first("xx").alias("xx"), F.first("n").alias("n"))
    se = F.try_divide(F.sqrt(F.sum(F.col("g") * F.col("g"))), F.first("xx"))
    return score.agg(F.first("beta").alias("beta"), se.alias("se"), F.try_divide(F.first("beta"), F.when(se > 0, se)).alias("t_stat"), F.first("n").alias("n"))


def twfe(panel: DataFrame) -> DataFrame:
    """Two-way fixed-effects estimate of ``d`` on ``y``, clustered by security."""
    rows = panel.where("y is not null and d is not null").withColumn("y", F.col("y").cast("double")).withColumn("d", F.col("d").cast("double"))
    return _clustered(demean_two_ways(rows, ["y", "d"]), "d", "y", ["stock_id"])


def _event_fits(panel: DataFrame, event: str, days: int, reach: int) -> tuple[DataFrame, list[int]]:
    rel = F.greatest(F.least(F.floor(F.datediff("date", F.lit(event).cast("date")) / days), F.lit(reach)), F.lit(-reach)).cast("int")
    steps = [k for k in range(-reach, reach + 1) if k != -1]
    names = [f"t{i}" for i in range(len(steps))]
    rows = panel.where("y is not null").withColumn("_rel", rel).withColumns({n: (F.col("treated") & (F.col("_rel") == k)).cast("double") for n, k in zip(names, steps, strict=True)})
    swept = demean_two_ways(rows.withColumn("y", F.col("y").cast("double")), ["y", *names]).withColumn("_all", F.lit(1))
    return clustered_fits(swept, ["_all"], "y", names, "stock_id", "period"), steps


def event_study(panel: DataFrame, event: str, days: int = 30, reach: int = 6) -> DataFrame:
    """Effect of treatment by relative time, against the step before the event; both fixed effects are swept out, errors clustered by security.

    Relative times are ``-reach`` to ``reach``, further ones count as the ends. Returns ``step``, ``effect``, ``se``, ``t_stat``, ``p_value``, ``n``.
    """
    fits, steps = _event_fits(panel, event, days, reach)
    return _tests(fits, ["_all"], F.array(*[F.lit(k) for k in steps]), len(steps)).select(F.col("term").alias("step"), F.col("coef").alias("effect"), "se", "t_stat", "p_value", "n")


def pre_trend(panel: DataFrame, event: str, days: int = 30, reach: int = 6) -> DataFrame:
    """One row: whether all steps before the event are 0 together, by a Wald statistic of their clustered covariance.

    ``df1`` is that covariance's rank (the steps, unless there are too few clusters); ``f_stat`` is ``wald / df1``.
    """
    fits, steps = _event_fits(panel, event, days, reach)
    width, before = len(steps), [i for i, k in enumerate(steps) if k < -1]

    def wald(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for coef, cov, df in zip(pdf["coef"], pdf["cov"], pdf["df"], strict=True):
                beta = np.array([np.nan if v is None else v for v in coef], dtype=float)
                v = np.array([np.nan if x is None else x for x in cov], dtype=float).reshape(width, width)
                live = [i for i in before if np.isfinite(beta[i]) and np.isfinite(v[i, i]) and v[i, i] > 0]
                scale = np.sqrt(np.diag(v)[live])
                values, vectors = np.linalg.eigh(v[np.ix_(live, live)] / np.outer(scale, scale)) if live else (np.zeros(0), np.zeros((0, 0)))
                good = values > 1e-10
                out.append((float((((vectors.T @ (beta[live] / scale)) ** 2)[good] / values[good]).sum()), int(good.sum()), int(df)))
            yield pd.DataFrame(out, columns=["wald", "df1", "df2"])

    f = F.try_divide("wald", "df1")
    rows = fits.select("coef", "cov", "df").mapInPandas(wald, "wald double, df1 int, df2 long")
    return rows.withColumn("f_stat", f).withColumn("p_value", f_p(F.col("f_stat"), F.col("df1"), F.when(F.col("df2") > 0, F.col("df2"))))


def levene(panel: DataFrame, value: str) -> DataFrame:
    """Whether spread changes after the event: absolute deviations from the firm-period mean on ``post``, firm effects swept out, clustered by firm-period."""
    rows = panel.where(F.col(value).isNotNull()).withColumn("_y", F.abs(F.col(value) - F.avg(value).over(W.partitionBy("stock_id", "post"))))
    firm = W.partitionBy("stock_id")
    rows = rows.withColumn("_x", F.col("post") - F.avg("post").over(firm)).withColumn("_y", F.col("_y") - F.avg("_y").over(firm))
    return _clustered(rows, "_x", "_y", ["stock_id", "post"])
