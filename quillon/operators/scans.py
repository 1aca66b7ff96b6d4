"""Scans along long groups that no single task could hold: slices of a global order, one local pass each, and a scan over slices.

Rows are range-partitioned by (keys, order), so a long group covers several slices and a slice holds its rows in order.
What a slice passes on (its last row, its largest value, its share of a recursion, its count) is one row for each
group in it; these few rows are scanned per group, and each slice is told what came before.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import clip, masked
from quillon.sources.shared import materialize

#: Rows of one key beyond which an as-of join slices it.
HOT_ROWS = 5_000_000


def sliced(df: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> DataFrame:
    """``df`` with ``_slice``, ranges of (``keys``, ``order``), written once. Slices ascend along every group's order.

    Equal rows of the order may stand in one slice or two neighbouring ones; ties should be broken by ``order``'s last columns.
    """
    n = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
    return materialize(ranged.withColumn("_slice", F.spark_partition_id()), "scan-slices")


def _before(per_slice: DataFrame, keys: list[str], carried: Column, name: str) -> DataFrame:
    """``carried`` (an aggregate over window) of each group's earlier slices: a row for each slice and group."""
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return per_slice.select(*keys, "_slice", carried.over(earlier).alias(name))


def _joined(rows: DataFrame, told: DataFrame, keys: list[str]) -> DataFrame:
    """Tells every row what its slice has been passed; keys may be null."""
    names = {k: f"_k{i}" for i, k in enumerate(keys)}
    told = told.withColumnsRenamed(names | {"_slice": "_s"})
    same = F.col("_slice") == F.col("_s")
    for k, n in names.items():
        same = same & F.col(k).eqNullSafe(F.col(n))
    return rows.join(told, same, "left").drop("_s", *names.values())


def last_known(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str, parts: int | None = None) -> DataFrame:
    """The last value that is not null at or before each row of its group, whatever the group's length."""
    rows = sliced(df.withColumns({f"_o{i}": c for i, c in enumerate(order)}), keys, [F.col(f"_o{i}") for i in range(len(order))], parts)
    names = [f"_o{i}" for i in range(len(order))]
    local = F.last(value, ignorenulls=True).over(W.partitionBy("_slice", *keys).orderBy(*names).rowsBetween(W.unboundedPreceding, 0))
    per_slice = rows.where(F.col(value).isNotNull()).groupBy(*keys, "_slice").agg(F.max_by(value, F.struct(*names)).alias("_v"))
    every = rows.select(*keys, "_slice").distinct().join(per_slice.withColumnsRenamed({k: f"_j{i}" for i, k in enumerate(keys)} | {"_slice": "_js"}), _same(keys), "left").drop("_js", *[f"_j{i}" for i in range(len(keys))])
    told = _before(every, keys, F.last("_v", ignorenulls=True), "_carried")
    return _joined(rows.withColumn("_local", local), told, keys).withColumn(out, F.coalesce("_local", "_carried")).drop("_local", "_carried", "_slice", *names)


def _same(keys: list[str]) -> Column:
    same = F.col("_slice") == F.col("_js")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_j{i}"))
    return same


def asof_join_sliced(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, parts: int | None = None) -> DataFrame:
    """``joins.asof_join`` in slices of the global order of (key, time): a key with any share of the rows is spread over tasks."""
    values = [c for c in right.columns if c != key]
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    payload, whole = F.struct(*values), F.struct(*left.columns)
    kind, row = dict(right.select(payload.alias("p")).dtypes)["p"], dict(left.select(whole.alias("p")).dtypes)["p"]
    up = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_t"), F.lit(1).alias("_side"), whole.alias("_left"), F.lit(None).cast(kind).alias("_right"))
    down = right.where(F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(row).alias("_left"), payload.alias("_right"))
    # Right rows first where times tie; of equal ones the same as without slices; left rows that tie are dealt by a hash.
    order = [F.struct(F.col("_t").isNotNull().alias("known"), "_t").alias("_o"), F.col("_side"), F.when(F.col("_side") == 0, F.xxhash64("_right")).otherwise(F.xxhash64("_left"))]
    found = last_known(up.unionByName(down), ["_key"], order, "_right", "_found", parts).where("_side = 1")
    return found.select("_left.*", *[F.col(f"_found.{c}").alias(c) for c in values])


def asof_join_skewed(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, hot: int = HOT_ROWS, parts: int | None = None) -> DataFrame:
    """The as-of join that slices keys of over ``hot`` rows and joins all others in one shuffle. Hot keys are fewer than rows / ``hot``."""
    from quillon.operators.joins import asof_join

    counts = left.select(key).unionByName(right.select(key)).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)
    keys = [r[0] for r in counts.collect()]
    if not keys:
        return asof_join(left, right, key, left_time, right_time)
    is_hot = F.coalesce(F.col(key).isin([k for k in keys if k is not None]), F.lit(None in keys))
    cold = asof_join(left.where(~is_hot), right.where(~is_hot), key, left_time, right_time)
    return cold.unionByName(asof_join_sliced(left.where(is_hot), right.where(is_hot), key, left_time, right_time, parts))


def affine(df: DataFrame, keys: list[str], order: str, a: str, b: str, out: str, start: float, parts: int | None = None) -> DataFrame:
    """The recursion x = a x + b along each group's ``order``, from ``start``: maps compose, so slices run apart and are chained.

    ``order`` names rows uniquely within a group. A null ``a`` or ``b`` counts as 0. Every row gets its slice's composed map up to
    it; a group's slices, as many as there are partitions at most, are folded in one list.
    """
    rows = sliced(df, keys, [F.col(order)], parts)

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        m, c = np.nan_to_num(pdf[a].to_numpy(dtype=float)), np.nan_to_num(pdf[b].to_numpy(dtype=float))
        up, add = np.empty(len(m)), np.empty(len(m))
        x, y = 1.0, 0.0
        for i in range(len(m)):
            x, y = m[i] * x, m[i] * y + c[i]
            up[i], add[i] = x, y
        return pdf.assign(_a=up, _b=add)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    mapped = materialize(rows.groupBy("_slice", *keys).applyInPandas(local, f"{fields}, _a double, _b double"), "scan-maps")
    ends = mapped.groupBy(*keys, "_slice").agg(F.max_by(F.struct("_a", "_b"), order).alias("_m"))
    chain = ends.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_slice", "_m"))).alias("_l"))  # a slice each
    first = F.struct(F.lit(float(start)).alias("x"), F.array().cast("array<double>").alias("seen"))
    walk = F.aggregate("_l", first, lambda s, e: F.struct((e["_m"]["_a"] * s["x"] + e["_m"]["_b"]).alias("x"), F.concat(s["seen"], F.array(s["x"])).alias("seen")))
    told = chain.select(*keys, F.explode(F.arrays_zip(F.col("_l._slice").alias("_slice"), walk["seen"].alias("_x"))).alias("_z")).select(*keys, "_z._slice", "_z._x")
    return _joined(mapped, told, keys).withColumn(out, F.col("_a") * F.col("_x") + F.col("_b")).drop("_a", "_b", "_x", "_slice")


def running_max(df: DataFrame, keys: list[str], order: str, value: str, out: str, parts: int | None = None) -> DataFrame:
    """The largest value at or before each row of its group."""
    rows = sliced(df, keys, [F.col(order)], parts)
    local = F.max(value).over(W.partitionBy("_slice", *keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    told = _before(rows.groupBy(*keys, "_slice").agg(F.max(value).alias("_m")), keys, F.max("_m"), "_carried")
    return _joined(rows.withColumn("_local", local), told, keys).withColumn(out, F.greatest("_local", "_carried")).drop("_local", "_carried", "_slice")


def long_drawdown(series: DataFrame, column: str, keys: list[str], order: str, parts: int | None = None) -> DataFrame:
    """``windows.drawdown`` for series of any length: growth of one unit, and its fall from the highest point so far. Nulls count as 0."""
    rows = series.withColumns({"_g": 1 + F.coalesce(column, F.lit(0.0)), "_z": F.lit(0.0)})
    grown = affine(rows, keys, order, "_g", "_z", "curve", 1.0, parts).drop("_g", "_z")
    return running_max(grown, keys, order, "curve", "_top", parts).withColumn("drawdown", F.col("curve") / F.col("_top") - 1).drop("_top")


def long_ema(df: DataFrame, column: str, keys: list[str], keep: float, t: str = "t", parts: int | None = None) -> DataFrame:
    """``windows.ema`` for series of any length: keep * previous + (1 - keep) * new, anew after a gap in ``t`` or a null."""
    known = F.col(column).isNotNull()
    before = df.where(known).select(*[F.col(k).alias(f"_p{i}") for i, k in enumerate(keys)], (F.col(t) + 1).alias("_pt"))
    same = F.col(t) == F.col("_pt")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_p{i}"))
    rows = df.join(before, same, "left").withColumn("_on", F.col("_pt").isNotNull() & known).drop("_pt", *[f"_p{i}" for i in range(len(keys))])
    rows = rows.withColumns({"_keep": F.when(F.col("_on"), F.lit(float(keep))).otherwise(0.0), "_new": F.when(F.col("_on"), (1 - keep) * F.col(column)).otherwise(F.coalesce(column, F.lit(0.0)))})
    return affine(rows, keys, t, "_keep", "_new", "ema", 0.0, parts).withColumn("ema", F.when(known, F.col("ema"))).drop("_on", "_keep", "_new")


def cells(df: DataFrame, by: list[str], value: str, parts: int | None = None) -> DataFrame:
    """Each distinct value of each group with its count ``_n`` and the group's rows below it, ``_below``: the exact distribution, in slices.

    Nulls are left out. A group with any number of distinct values is spread over tasks.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    rows = sliced(counts, by, [F.col("_v")], parts)
    local = F.sum("_n").over(W.partitionBy("_slice", *by).orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    told = _before(rows.groupBy(*by, "_slice").agg(F.sum("_n").alias("_m")), by, F.sum("_m"), "_ahead")
    return _joined(rows.withColumn("_local", local), told, by).select(*by, "_v", "_n", (F.col("_local") + F.coalesce("_ahead", F.lit(0))).alias("_below"))


def long_average_rank(df: DataFrame, value: str, by: list[str], out: str, parts: int | None = None) -> DataFrame:
    """``windows.average_rank`` without a task for each group: ranks are those of values, joined back by group and value. Nulls have none."""
    ranks = cells(df, by, value, parts).select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("_v"), (F.col("_below") + (F.col("_n") + 1) / 2.0).alias(out))
    same = F.col(value) == F.col("_v")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return df.join(ranks, same, "left").drop("_v", *[f"_b{i}" for i in range(len(by))])


def long_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """Exact quantiles of each group, linear between neighbours, a column for each of ``shares``; groups without a value are left out."""
    rows = cells(df, by, value, parts)
    totals = rows.groupBy(*by).agg(F.sum("_n").alias("_all"))
    both = rows.join(totals.withColumnsRenamed({c: f"_b{i}" for i, c in enumerate(by)}), _all_same(by))
    found = []
    for name, q in shares.items():
        at = F.lit(float(q)) * (F.col("_all") - 1)
        here = lambda place: (F.col("_below") <= place) & (place < F.col("_below") + F.col("_n"))
        low, high = F.max(F.when(here(F.floor(at)), F.col("_v"))), F.max(F.when(here(F.ceil(at)), F.col("_v")))
        part = F.max(at - F.floor(at))
        found.append((low + (high - low) * part).alias(name))
    return both.groupBy(*by).agg(*found)


def _all_same(by: list[str]) -> Column:
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_b{i}"))
    return same


def with_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """``df`` with its group's quantiles as columns; Spark broadcasts them where there are few groups."""
    found = long_quantiles(df, by, value, shares, parts)
    return df.join(found.withColumnsRenamed({c: f"_b{i}" for i, c in enumerate(by)}), _all_same(by), "left").drop(*[f"_b{i}" for i in range(len(by))])


def long_winsorize(df: DataFrame, masks: dict[str, Column], low: float, high: float, by: str = "period", parts: int | None = None) -> DataFrame:
    """``windows.winsorize`` (linear) without a task for each period: bounds of all columns come from one sliced pass over their distinct values."""
    return _with_shares(df, masks, {"lo": low, "hi": high}, by, lambda c, x: clip(x, F.col(f"_{c}_lo"), F.col(f"_{c}_hi")), parts)


def long_fill_median(df: DataFrame, masks: dict[str, Column], by: str = "period", parts: int | None = None) -> DataFrame:
    """``windows.fill_median`` without a task for each period."""
    return _with_shares(df, masks, {"mid": 0.5}, by, lambda c, x: F.coalesce(x, F.col(f"_{c}_mid")), parts, masks)


def _with_shares(df: DataFrame, masks: dict[str, Column], shares: dict[str, float], by: str, rule, parts: int | None, after: dict[str, Column] | None = None) -> DataFrame:
    names = list(masks)
    inside = {c: masked(m, F.col(c).cast("double")) for c, m in masks.items()}
    long = df.select(F.col(by).alias("_by"), *[x.alias(c) for c, x in inside.items()]).unpivot(["_by"], names, "_c", "_x")
    found = long_quantiles(long, ["_by", "_c"], "_x", shares, parts)
    wide = found.groupBy("_by").agg(*[F.max(F.when(F.col("_c") == c, F.col(s))).alias(f"_{c}_{s}") for c in names for s in shares])
    out = df.join(wide, F.col(by).eqNullSafe(F.col("_by")), "left")
    made = {c: rule(c, x) for c, x in inside.items()}
    return out.withColumns({c: masked(after[c], v) if after else v for c, v in made.items()}).drop("_by", *[f"_{c}_{s}" for c in names for s in shares])
