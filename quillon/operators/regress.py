"""Grouped least squares from moment sums: one pass adds up X'X and X'y per group; only K x K blocks are solved."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: list[str], y: Column, xs: list[Column]) -> DataFrame:
    """``n``, ``xx`` (row-wise), ``xy``, ``yy`` by group, over rows where all are known; the first regressor is the constant."""
    k = len(xs) + 1
    known = y.isNotNull()
    for x in xs:
        known = known & x.isNotNull()
    rows = df.select(*keys, F.when(known, F.array(F.lit(1.0), *xs)).alias("_x"), F.when(known, y.cast("double")).alias("_y"))
    x = lambda i: F.col("_x")[i]
    upper = {(i, j): F.sum(x(i) * x(j)) for i in range(k) for j in range(i, k)}
    return rows.groupBy(*keys).agg(
        F.count("_y").alias("n"), F.array(*[upper[min(i, j), max(i, j)] for i in range(k) for j in range(k)]).alias("xx"),
        F.array(*[F.sum(x(i) * F.col("_y")) for i in range(k)]).alias("xy"), F.sum(F.col("_y") * F.col("_y")).alias("yy"),
    )


def solve_scaled(xx: np.ndarray, xy: np.ndarray, cutoff: float = 1e-10) -> np.ndarray:
    """Minimum-norm solution with columns scaled to unit length first, since X'X squares the condition number."""
    scale = np.sqrt(np.maximum(np.diag(xx), 1e-300))
    return np.linalg.pinv(xx / np.outer(scale, scale), rcond=cutoff, hermitian=True) @ (xy / scale) / scale


def coefficients(moment_rows: DataFrame, keys: list[str], names: list[str], least: int | None = None) -> DataFrame:
    """``const`` and one column per regressor; null where a group has fewer than ``least`` rows (regressors + 1 by default)."""
    k = len(names) + 1
    need = k if least is None else least
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moment_rows.schema.fields if f.name in keys)
    schema = f"{fields}, n long, const double, " + ", ".join(f"`{x}` double" for x in names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = np.full((len(pdf), k), np.nan)
            for i, (n, xx, xy) in enumerate(zip(pdf["n"], pdf["xx"], pdf["xy"], strict=True)):
                if n >= need and n > 0:
                    out[i] = solve_scaled(np.asarray(xx, dtype=float).reshape(k, k), np.asarray(xy, dtype=float))
            yield pd.concat([pdf[[*keys, "n"]].reset_index(drop=True), pd.DataFrame(out, columns=["const", *names])], axis=1)

    solved = moment_rows.mapInPandas(solve, schema)
    return solved.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ["const", *names]})


#: What names a row of a loadings frame; all else is a regressor.
ID_COLUMNS = ("stock_id", "date", "period", "industry", "sub_universe")


def design_columns(loadings: DataFrame, ids: tuple[str, ...] = ID_COLUMNS) -> list[str]:
    """The regressors of a loadings frame: every column that does not name its rows. None at all is an error."""
    names = [c for c in loadings.columns if c not in ids]
    if not names:
        raise ValueError("the loadings have no regressor")
    return names


def residuals(df: DataFrame, keys: list[str], ys: list[str], xs: list[str]) -> DataFrame:
    """Each of ``ys`` less its fit on ``xs`` within its group; a null target or regressor leaves a null."""
    out = df
    for y in ys:
        fit = coefficients(moments(df, keys, F.col(y), [F.col(x) for x in xs]), keys, [f"_b{i}" for i in range(len(xs))], least=1)
        line = F.col("const")
        for i, x in enumerate(xs):
            line = line + F.col(f"_b{i}") * F.col(x)
        out = out.join(fit.drop("n"), keys, "left").withColumn(y, F.col(y) - line).drop("const", *[f"_b{i}" for i in range(len(xs))])
    return out
