"""A sweep over settings, factorised by what each setting changes, and the ledger of its books.

Knobs that change upstream frames (how often factors are chosen anew, shrinkage, allocation) give one table of factor
weights by partial setting and period, each frame computed once for all of them. Scores meet it by period. The knobs of
the step (risk aversion, name cap) fan out only then, and gross leverage not at all: a book at another leverage is the same book
scaled by one number a period, so a ledger adds up all leverages side by side in one pass over the pairs.

``swept_ledger`` goes further: no row of any book is stored or shuffled. A row of scores and its security's row of the period before
meet the small table of books and periods in a broadcast join, weights are worked out there and added up by book and period at once, so what is
written and exchanged follows the scores, whatever the number of settings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators.metrics import sharpe
from quillon.operators.portfolio import walk_forward_ir, walk_forward_premia
from quillon.operators.validate import statistics_by_cutoff
from quillon.sources.shared import materialize

#: Weights below this do not count as held.
HELD = 1e-12
#: Figures by book and period are broadcast up to so many rows.
BROADCAST_BOOKS = 200_000


def schedules(spark, months: list[int], first: str, last: str) -> DataFrame:
    """``reselect`` and its ``cutoff``s: every so many months from ``first`` to ``last``."""
    return spark.createDataFrame([(m,) for m in months], "reselect int").select("reselect", F.expr(f"explode(sequence(date'{first}', date'{last}', make_ym_interval(0, reselect)))").alias("cutoff"))


def active_factors(ic: DataFrame, schedule: DataFrame, gate: float, last: str, months: int = 3) -> DataFrame:
    """``reselect``, ``period``, ``factor``: what each schedule's last cutoff has chosen, from cutoff to cutoff.

    A factor is chosen by the size of its information ratio up to the cutoff, worked out once for each distinct
    cutoff of all schedules. An empty choice takes over the schedule's last that was not; before the first there is none.
    """
    stats = statistics_by_cutoff(ic, schedule.select("cutoff").distinct(), ["factor"], "ic")
    chosen = stats.groupBy("cutoff").agg(F.sort_array(F.collect_set(F.when(F.coalesce(F.abs("ir") > gate, F.lit(False)), F.col("factor")))).alias("own"))
    order = W.partitionBy("reselect").orderBy("cutoff")
    held = F.last(F.when(F.size("own") > 0, F.col("own")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    until = F.coalesce(F.lead("cutoff").over(order), F.add_months(F.lit(last).cast("date"), months))
    lists = schedule.join(chosen, "cutoff", "left").withColumn("factors", held).withColumn("until", until)
    periods = F.explode(F.sequence("cutoff", F.add_months("until", -months), F.expr(f"make_ym_interval(0, {months})")))
    return lists.where("factors is not null").select("reselect", periods.alias("period"), "factors").select("reselect", "period", F.explode("factors").alias("factor"))


def factor_thetas(premia: DataFrame, ic: DataFrame, active: DataFrame, factors: list[str], allocations: tuple[str, ...] = ("equal", "ir_weighted"), shrunk: tuple[bool, ...] = (True, False)) -> DataFrame:
    """Weight times premium of each factor (a column each, 0 if it is not active) by ``alloc``, ``js``, ``reselect`` and ``period``.

    Premia and information ratios are those known at the period. Rows are settings times periods, whatever the panel.
    """
    known = walk_forward_premia(premia).where("mean is not null")
    either = F.explode(F.array(*[F.struct(F.lit(int(s)).alias("js"), (F.col("mean_js") if s else F.col("mean")).alias("premium")) for s in shrunk]))
    rows = active.join(known.select("factor", "period", either.alias("v")).select("factor", "period", "v.*"), ["factor", "period"]).join(walk_forward_ir(ic).select("factor", "period", "ir"), ["factor", "period"], "left")
    rows = rows.withColumn("alloc", F.explode(F.array(*[F.lit(a) for a in allocations])))
    own = W.partitionBy("alloc", "js", "reselect", "period")
    size = F.when(F.col("alloc") == "equal", 1.0).otherwise(F.abs(F.coalesce("ir", F.lit(0.0))))
    rows = rows.withColumn("_size", size).withColumn("_all", F.sum("_size").over(own))
    alpha = F.when(F.col("_all") > 0, F.col("_size") / F.col("_all")).otherwise(1.0 / F.count("*").over(own))
    cells = rows.withColumn("theta", alpha * F.col("premium"))
    return cells.groupBy("alloc", "js", "reselect", "period").agg(*[F.coalesce(F.sum(F.when(F.col("factor") == f, F.col("theta"))), F.lit(0.0)).alias(f"theta_{f}") for f in factors])


def partial_returns(scores: DataFrame, thetas: DataFrame, factors: list[str]) -> DataFrame:
    """``alloc``, ``js``, ``reselect``, ``period``, ``stock_id``, ``mu`` and the other columns of ``scores``: expected returns of each partial setting. A null score counts as 0; rows without any go."""
    some = F.coalesce(*[F.col(f) for f in factors]).isNotNull()
    rest = [c for c in scores.columns if c not in (*factors, "period")]
    mu = F.lit(0.0)
    for f in factors:
        mu = mu + F.col(f"theta_{f}") * F.coalesce(F.col(f), F.lit(0.0))
    return scores.where(some).join(thetas, "period").select("alloc", "js", "reselect", "period", *rest, mu.alias("mu"))


def stepped(rows: DataFrame, partial: list[str], aversions: list[float], caps: list[float]) -> DataFrame:
    """Books before leverage, of each partial setting times risk aversion (``ra``) and name cap (``mnw``): the separable step from nothing, capped, then centred.

    ``rows`` has ``mu``, ``d`` (variance) and ``c`` (cost). Centring is last, so a weight may end beyond its cap by the book's mean.
    """
    grid = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("ra"), F.lit(float(m)).alias("mnw")) for a in aversions for m in caps]))
    out = rows.withColumn("_g", grid).select(*rows.columns, "_g.ra", "_g.mnw")
    step = F.coalesce(F.try_divide(F.signum("mu") * F.greatest(F.abs("mu") - F.col("c"), F.lit(0.0)), F.col("ra") * F.col("d")), F.lit(0.0))
    out = out.withColumn("_u", F.greatest(F.least(step, F.col("mnw")), -F.col("mnw")))
    return out.withColumn("w", F.col("_u") - F.avg("_u").over(W.partitionBy(*partial, "ra", "mnw", "period"))).drop("_u", "mu", "d")


def ledger(books: DataFrame, keys: list[str], leverages: list[float] | None = None, exits: DataFrame | None = None, reset: float = 1e-3, tolerance: float = 1e-10) -> DataFrame:
    """What books of all ``keys`` earn and pay, period by period, at every gross ``leverage`` at once.

    ``books``: ``keys``, ``period``, ``stock_id``, ``w``, ``r`` (the return to come; null: a gap, counts as 0), ``c`` (cost) and ``beta``
    (null: 0). A book whose gross position passes a leverage is scaled down to it; without ``leverages`` books stay as they are.
    Weights drift by (1 + r) / (1 + net); at 1 + net <= ``reset`` a book starts anew from nothing. A name that is gone from the book is
    sold at its last cost, unless ``exits`` (``stock_id``, ``period``) has it by then: such names settle without a trade.
    Turnover is that of the names in the book. Net returns follow from sweeps over one pass of pairs, as in ``account``.
    Returns ``keys``, ``leverage``, ``period``, ``gross``, ``tc_trade``, ``tc_exit``, ``tc``, ``net``, ``turnover``, ``gross_lev``, ``net_exp``,
    ``n_long``, ``n_short``, ``n_names``, ``n_return_gaps`` and ``mkt_beta``.
    """
    zero, by = F.lit(0.0), [*keys, "t"]
    levels = leverages or [float("inf")]
    which = range(len(levels))
    books = materialize(books.select(*keys, "period", "stock_id", "w", "r", "c", "beta"), "ledger-books")
    periods = books.select(*keys, "period").distinct().withColumn("t", F.row_number().over(W.partitionBy(*keys).orderBy("period")))
    periods = materialize(periods, "ledger-periods")
    rows = books.join(periods, [*keys, "period"]).select(*by, "stock_id", F.coalesce("w", zero).alias("w"), "r", F.coalesce("c", zero).alias("c"), F.coalesce("beta", zero).alias("beta"))
    last = periods.groupBy(*keys).agg(F.max("t").alias("_last"))
    held = rows.join(last, keys).where("t < _last").select(*keys, (F.col("t") + 1).alias("t"), "stock_id", (F.col("w") * (1 + F.coalesce("r", zero))).alias("h"), F.col("c").alias("hc"))
    both = rows.withColumn("here", F.lit(True)).join(held, [*by, "stock_id"], "full")
    if exits is not None:
        dead = exits.groupBy("stock_id").agg(F.min("period").alias("_gone"))
        both = both.join(dead, "stock_id", "left").join(periods.withColumnRenamed("period", "_now"), by)
        both = both.withColumn("dead", F.coalesce(F.col("_gone") <= F.col("_now"), F.lit(False)))
    else:
        both = both.withColumn("dead", F.lit(False))
    here = F.coalesce("here", F.lit(False))
    cost = F.when(here, F.col("c")).when(F.col("dead"), 0.0).otherwise(F.coalesce("hc", zero))
    pairs = both.select(*by, here.alias("here"), F.coalesce("w", zero).alias("w"), F.coalesce("h", zero).alias("h"), cost.alias("c"), "r", F.coalesce("beta", zero).alias("beta"))
    pairs = materialize(pairs, "ledger-pairs")
    own = F.col("here")
    totals = pairs.groupBy(*by).agg(
        F.sum(F.col("w") * F.coalesce("r", zero)).alias("g"), F.sum(F.abs("w")).alias("a"), F.sum("w").alias("e"), F.sum(F.col("w") * F.col("beta")).alias("b"),
        F.sum((F.col("w") > HELD).cast("long")).alias("n_long"), F.sum((F.col("w") < -HELD).cast("long")).alias("n_short"), F.sum(own.cast("long")).alias("n_names"),
        F.sum((own & F.col("r").isNull() & (F.abs("w") > HELD)).cast("long")).alias("n_return_gaps"),
    )
    scale = F.array(*[F.when(F.col("a") > x, F.lit(x) / F.col("a")).otherwise(1.0) for x in map(float, levels)])
    totals = materialize(totals.withColumn("s", scale), "ledger-totals")  # a row for each book and period
    small = totals.count() <= BROADCAST_BOOKS
    known = totals.select(*by, "s", F.transform("s", lambda s: s * F.col("g")).alias("net"))
    moved = tolerance + 1
    while moved > tolerance:
        drift = F.zip_with("s", "net", lambda s, n: F.when(1 + n > reset, s / (1 + n)).otherwise(0.0))
        before = known.select(*keys, (F.col("t") + 1).alias("t"), drift.alias("k"))
        factors = totals.select(*by, "s").join(before, by, "left").withColumn("k", F.coalesce("k", F.array(*[zero for _ in which])))
        step = [F.abs(F.col("w") * F.col("s")[i] - F.col("h") * F.col("k")[i]) for i in which]
        met = pairs.join(F.broadcast(factors) if small else factors, by)
        sums = met.groupBy(*by).agg(
            F.array(*[F.sum(F.when(own, x).otherwise(0.0)) for x in step]).alias("turnover"), F.array(*[F.sum(F.when(own, x * F.col("c")).otherwise(0.0)) for x in step]).alias("tc_trade"),
            F.array(*[F.sum(F.when(~own, x * F.col("c")).otherwise(0.0)) for x in step]).alias("tc_exit"),
        )
        now = totals.join(sums, by).join(known.select(*by, F.col("net").alias("_old")), by)
        net = F.array(*[F.col("s")[i] * F.col("g") - F.col("tc_trade")[i] - F.col("tc_exit")[i] for i in which])
        now = now.withColumn("net", net).withColumn("_moved", F.array_max(F.zip_with("net", "_old", lambda a, b: F.abs(a - b))))
        known = materialize(now.drop("_old"), "ledger-sweep")
        moved = known.agg(F.max("_moved")).first()[0] or 0.0
    each = F.explode(F.array(*[F.struct(F.lit(float(x) if leverages else None).cast("double").alias("leverage"), F.col("s")[i].alias("s"), *[F.col(c)[i].alias(c) for c in ("turnover", "tc_trade", "tc_exit", "net")]) for i, x in enumerate(levels)]))
    flat = known.join(periods, by).select(*keys, "period", "g", "a", "e", "b", "n_long", "n_short", "n_names", "n_return_gaps", each.alias("x"))
    s = F.col("x.s")
    return flat.select(
        *keys, "x.leverage", "period", (s * F.col("g")).alias("gross"), "x.tc_trade", "x.tc_exit", (F.col("x.tc_trade") + F.col("x.tc_exit")).alias("tc"), "x.net", "x.turnover",
        (s * F.col("a")).alias("gross_lev"), (s * F.col("e")).alias("net_exp"), "n_long", "n_short", "n_names", "n_return_gaps", (s * F.col("b")).alias("mkt_beta"),
    )


def swept_ledger(
    base: DataFrame, cells: DataFrame, keys: list[str], weight: Callable[[Callable[[str], Column]], Column], cost: Callable[[Callable[[str], Column]], Column],
    exits: DataFrame | None = None, exit_costs: bool = True, held: float = HELD, reset: float = 1e-3, tolerance: float = 1e-10,
) -> DataFrame:
    """What the books of many settings over the same rows earn and pay, period by period, as ``ledger`` does for books that are given.

    ``base``: a row for each ``stock_id`` and ``period`` with ``r`` (the return to come; null: a gap, counts as 0), ``beta`` (null: 0) and what
    ``weight`` and ``cost`` read, by the function they are handed, of it and of the setting's parameters, which are columns of ``cells`` and may change by period.
    ``cells``: a row for each of the books (``keys``) and its periods, with ``leverage`` (null: as it is), ``centred`` and the parameters;
    settings times periods, whatever the panel, so it is broadcast. All rows of ``base`` in a period are in each of that period's books.
    A weight is that of ``weight``, less the book's mean if ``centred``, scaled down where the book passes its leverage. Drift, exits and
    their costs are those of ``ledger``; without ``exit_costs`` names that are gone cost nothing. Turnover of names that are gone is ``turnover_exit``.
    """
    zero, by = F.lit(0.0), ["b", "p"]
    spark = base.sparkSession
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))  # tables that are fanned out in every pass lie in many files
    names = [c for c in base.columns if c not in ("stock_id", "period")]
    terms = [c for c in cells.columns if c not in (*keys, "period")]
    if clash := set(names) & set(terms):
        raise ValueError(f"columns of rows and of settings: {sorted(clash)}")
    cells = cells.join(base.select("period").distinct(), "period", "left_semi")
    numbered = cells.select("period").distinct().withColumn("p", F.row_number().over(W.orderBy("period")))  # a row for each period
    books = cells.select(*keys).distinct().withColumn("b", F.row_number().over(W.orderBy(*keys)))  # a row for each setting
    before = F.coalesce(F.lag("p").over(W.partitionBy("b").orderBy("p")), F.lit(0))
    cells = materialize(cells.join(F.broadcast(books), keys).join(F.broadcast(numbered), "period").withColumn("q", before), "swept-cells")
    numbered = cells.select("period", "p").distinct()
    rows = materialize(base.join(F.broadcast(numbered), "period").select("stock_id", "p", *names).repartition(spread, "stock_id"), "swept-rows")

    known = lambda c: F.coalesce(F.col(c), zero)
    out = rows.join(F.broadcast(cells), "p").groupBy(*by).agg(F.avg(weight(F.col)).alias("_mean"))
    cells = materialize(cells.join(F.broadcast(out), by).withColumn("m", F.when(F.col("centred"), F.coalesce("_mean", zero)).otherwise(0.0)).drop("_mean"), "swept-means")
    w = F.col("_w")
    fixed = rows.join(F.broadcast(cells), "p").withColumn("_w", weight(F.col) - F.col("m")).groupBy(*by).agg(
        F.sum(w * known("r")).alias("g"), F.sum(F.abs(w)).alias("a"), F.sum(w).alias("e"), F.sum(w * known("beta")).alias("beta_"), F.sum((w > held).cast("long")).alias("n_long"),
        F.sum((w < -held).cast("long")).alias("n_short"), F.count("*").alias("n_names"), F.sum((F.col("r").isNull() & (F.abs(w) > held)).cast("long")).alias("n_return_gaps"),
    )
    scale = F.when(F.col("a") > F.col("leverage"), F.col("leverage") / F.col("a")).otherwise(1.0)
    cells = materialize(cells.join(F.broadcast(fixed), by).withColumn("s", scale), "swept-totals")

    # A row meets its security's row of the period before, once for each pair of periods that some book has next to each other.
    steps = F.broadcast(cells.select("p", "q").distinct())
    now = rows.join(steps, "p").select("stock_id", "p", "q", F.lit(True).alias("here"), *[F.col(c).alias(f"now_{c}") for c in names])
    old = rows.withColumnRenamed("p", "q").join(steps, "q").select("stock_id", "p", "q", F.lit(True).alias("was"), *[F.col(c).alias(f"old_{c}") for c in names])
    pairs = now.join(old, ["stock_id", "p", "q"], "full").withColumn("dead", F.lit(False))
    if exits is not None:
        dead = exits.groupBy("stock_id").agg(F.min("period").alias("_gone"))
        pairs = pairs.drop("dead").join(dead, "stock_id", "left").join(F.broadcast(numbered), "p").withColumn("dead", F.coalesce(F.col("_gone") <= F.col("period"), F.lit(False))).drop("_gone", "period")
    pairs = materialize(pairs.withColumns({"here": F.coalesce("here", F.lit(False)), "was": F.coalesce("was", F.lit(False))}).repartition(spread, "stock_id"), "swept-pairs")

    x = lambda c: F.col(c if c in terms else f"now_{c}")
    y = lambda c: F.col(f"past_{c}" if c in terms else f"old_{c}")
    here, goes = F.col("here"), ~F.col("here") & ~F.col("dead")
    weighed = F.when(here, (weight(x) - F.col("m")) * F.col("s")).otherwise(0.0)
    drifted = F.when(F.col("was"), (weight(y) - F.col("old_m")) * (1 + known("old_r")) * F.col("k")).otherwise(0.0)
    found, moved = cells.select(*by, (F.col("s") * F.col("g")).alias("net")), tolerance + 1
    while moved > tolerance:
        growth = F.when(1 + F.col("net") > reset, F.col("s") / (1 + F.col("net"))).otherwise(0.0)
        past = cells.join(found.select(*by, "net"), by).select("b", F.col("p").alias("q"), F.col("m").alias("old_m"), growth.alias("k"), *[F.col(c).alias(f"past_{c}") for c in terms])
        held_on = materialize(cells.join(past, ["b", "q"], "left").withColumns({"old_m": known("old_m"), "k": known("k")}), "swept-drift")
        met = pairs.join(F.broadcast(held_on), ["p", "q"]).withColumn("_d", F.abs(weighed - drifted))
        sums = met.groupBy(*by).agg(
            F.sum(F.when(here, F.col("_d")).otherwise(0.0)).alias("turnover"), F.sum(F.when(here, F.col("_d") * F.coalesce(cost(x), zero)).otherwise(0.0)).alias("tc_trade"),
            F.sum(F.when(here, 0.0).otherwise(F.col("_d"))).alias("turnover_exit"), F.sum(F.when(goes & F.lit(exit_costs), F.col("_d") * F.coalesce(cost(y), zero)).otherwise(0.0)).alias("tc_exit"),
        )
        net = F.col("s") * F.col("g") - F.col("tc_trade") - F.col("tc_exit")
        now_ = cells.select(*by, "s", "g").join(sums, by).join(found.select(*by, F.col("net").alias("_old")), by).withColumn("net", net)
        found = materialize(now_.withColumn("_moved", F.abs(F.col("net") - F.col("_old"))).drop("s", "g", "_old"), "swept-net")
        moved = found.agg(F.max("_moved")).first()[0] or 0.0
    s = F.col("s")
    return cells.join(found, by).select(
        *keys, "period", "leverage", (s * F.col("g")).alias("gross"), "tc_trade", "tc_exit", (F.col("tc_trade") + F.col("tc_exit")).alias("tc"), "net", "turnover", "turnover_exit",
        (s * F.col("a")).alias("gross_lev"), (s * F.col("e")).alias("net_exp"), "n_long", "n_short", "n_names", "n_return_gaps", (s * F.col("beta_")).alias("mkt_beta"),
    )


def headline(rows: DataFrame, by: list[str], per_year: int = 4) -> DataFrame:
    """The thirteen headline figures of each book: ``rows`` are those of ``ledger`` with ``mkt``, ``bench`` and ``rf`` of the period to come.

    The hedged return takes off the risk-free rate and the book's beta times the market; a null market, beta or rate counts as 0 there, a null benchmark in the information ratio.
    """
    x, zero = F.col("net"), F.lit(0.0)
    order = W.partitionBy(*by).orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    curved = rows.withColumn("_curve", F.product(1 + x).over(order)).withColumn("_fall", F.col("_curve") / F.max("_curve").over(order) - 1)
    hedge = x - F.coalesce("rf", zero) - F.coalesce(F.col("mkt_beta") * F.col("mkt"), zero)
    return curved.groupBy(*by).agg(
        F.count(x).alias("quarters_traded"), (F.pow(F.greatest(F.product(1 + x), zero), F.lit(float(per_year)) / F.count(x)) - 1).alias("ann_return_net"),
        (F.stddev_samp(x) * F.sqrt(F.lit(float(per_year)))).alias("ann_vol_net"), sharpe(x, per_year).alias("sharpe_net"), sharpe(hedge, per_year).alias("sharpe_net_hedged"), F.min("_fall").alias("max_drawdown"),
        sharpe(x - F.coalesce("bench", zero), per_year).alias("ir_vs_benchmark"), F.avg("turnover").alias("avg_turnover"), (F.avg("tc") * 1e4).alias("avg_tc_bps"),
        F.avg("gross_lev").alias("avg_gross_leverage"), F.avg("net_exp").alias("avg_net_exposure"), F.avg("mkt_beta").alias("avg_mkt_beta"), F.sum("n_return_gaps").alias("return_data_gaps"),
    )


def leaderboard(results: DataFrame, objective: str, top: int) -> DataFrame:
    """The ``top`` settings by an objective, best first; equal ones by ``strategy_id``, null ones last. ``place`` counts from 1."""
    best = results.orderBy(F.col(objective).desc_nulls_last(), "strategy_id").limit(top)
    return best.withColumn("place", F.row_number().over(W.orderBy(F.col(objective).desc_nulls_last(), "strategy_id")))


def _knob_values(results: DataFrame, knobs: list[str], objective: str) -> DataFrame:
    return results.select("strategy_id", objective, *[F.col(k).cast("string").alias(k) for k in knobs])


def marginals(results: DataFrame, knobs: list[str], objective: str) -> DataFrame:
    """The objective's mean, least and largest value and count for every value of every knob, over the others."""
    long = _knob_values(results, knobs, objective).unpivot(["strategy_id", objective], knobs, "knob", "value")
    return long.groupBy("knob", "value").agg(F.avg(objective).alias("mean"), F.min(objective).alias("low"), F.max(objective).alias("high"), F.count(objective).alias("n"))


def interactions(results: DataFrame, knobs: list[str], objective: str) -> DataFrame:
    """The objective's mean for every pair of values of every two knobs, over the others."""
    rows = _knob_values(results, knobs, objective)
    cells = [F.struct(F.lit(a).alias("knob_a"), F.col(a).alias("value_a"), F.lit(b).alias("knob_b"), F.col(b).alias("value_b")) for i, a in enumerate(knobs) for b in knobs[i + 1 :]]
    return rows.select(objective, F.explode(F.array(*cells)).alias("c")).groupBy("c.knob_a", "c.value_a", "c.knob_b", "c.value_b").agg(F.avg(objective).alias("mean"), F.count(objective).alias("n"))


def one_knob_slices(results: DataFrame, baseline: dict[str, object], objective: str) -> DataFrame:
    """``knob``, ``value``, the objective, and its ``gain`` on the baseline's, for every setting that differs from ``baseline`` in one knob at most; the baseline is in each slice."""
    text = {k: F.lit(v).cast(results.schema[k].dataType).cast("string") for k, v in baseline.items()}
    rows = _knob_values(results, list(baseline), objective)
    same = {k: F.col(k).eqNullSafe(text[k]) for k in baseline}
    base = F.max(F.when(_all(list(same.values())), F.col(objective))).over(W.partitionBy())  # a row for each setting
    slices = [F.when(_all([m for j, m in same.items() if j != k]), F.struct(F.lit(k).alias("knob"), F.col(k).alias("value"))) for k in baseline]
    near = rows.withColumn("_base", base).select(objective, "_base", F.explode(F.array(*slices)).alias("s")).where("s is not null")
    return near.select("s.knob", "s.value", objective, (F.col(objective) - F.col("_base")).alias("gain"))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
