"""Queries over the factorised sweep and the ledger of its books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import compound, period_key
from quillon.operators import portfolio as p
from quillon.operators import resample as r
from quillon.operators import sweep as sw
from quillon.operators import validate
from quillon.plans.factor_queries import masks, zscores
from quillon.plans.oracle import define
from quillon.plans.panel_queries import cleaned, events
from quillon.plans.portfolio_queries import _JS, _WF, books, idio
from quillon.plans.registry import query
from quillon.plans.validation_queries import FIVE, design, forward, quarter_beta
from quillon.sources.shared import artifact, materialize

FIRST, LAST, GATE = "1996-01-01", "2001-10-01", 0.15
RESELECT, LEVERAGES, CAPS, AVERSIONS = [24, 48, 240], [2.0, 3.0, 5.0], [0.02, 0.05], [1.0, 2.0, 5.0]
KNOBS = ["alloc", "js", "leverage", "mnw", "ra", "reselect"]
BASELINE = {"alloc": "equal", "js": 1, "leverage": 2.0, "mnw": 0.02, "ra": 2.0, "reselect": 24}
FIGURES = "ann_return_net ann_vol_net sharpe_net sharpe_net_hedged max_drawdown ir_vs_benchmark avg_turnover avg_tc_bps avg_gross_leverage avg_net_exposure avg_mkt_beta"
_FIVE, _LIST = ", ".join(FIVE), ", ".join(f"'{f}'" for f in FIVE)

define("icfive", f"""WITH l AS (SELECT stock_id, period, unnest([{_LIST}]) AS factor, unnest([{_FIVE}]) AS score FROM zscores),
  b AS (SELECT l.period, factor, score, fwd1 AS fwd FROM l JOIN fwd ON l.stock_id = fwd.stock_id AND l.period = fwd.period WHERE score IS NOT NULL AND fwd1 IS NOT NULL),
  k AS (SELECT *, rank() OVER (PARTITION BY period, factor ORDER BY score) + (count(*) OVER (PARTITION BY period, factor, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY period, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY period, factor, fwd) - 1) / 2.0 AS c FROM b)
  SELECT period, factor, covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) AS ic FROM k GROUP BY 1, 2""")
define("wfpremfive", _WF.format(v="coef", t="pooledprem"))
define("wficfive", _WF.format(v="ic", t="icfive"))
define("jsfive", _JS.format(t="wfpremfive"))
_SCHED = " UNION ALL ".join(f"SELECT {m} AS reselect, unnest(generate_series(DATE '{FIRST}', DATE '{LAST}', INTERVAL {m} MONTH))::date AS cutoff" for m in RESELECT)
define("activefactors", f"""WITH s AS ({_SCHED}), x AS (SELECT cutoff, factor, abs(avg(ic) / nullif(stddev_samp(ic), 0)) > {GATE} AS ok FROM icfive JOIN (SELECT DISTINCT cutoff FROM s) ON period <= cutoff GROUP BY 1, 2),
  o AS (SELECT cutoff, coalesce(list(factor) FILTER (coalesce(ok, false)), []) AS own FROM x GROUP BY 1),
  h AS (SELECT reselect, s.cutoff, last_value(CASE WHEN len(own) > 0 THEN own END IGNORE NULLS) OVER w AS factors, coalesce(lead(s.cutoff) OVER w, (DATE '{LAST}' + INTERVAL 3 MONTH)::date) AS until FROM s LEFT JOIN o ON o.cutoff = s.cutoff WINDOW w AS (PARTITION BY reselect ORDER BY s.cutoff)),
  q AS (SELECT reselect, factors, unnest(generate_series(cutoff, until - INTERVAL 3 MONTH, INTERVAL 3 MONTH))::date AS period FROM h WHERE factors IS NOT NULL)
  SELECT reselect, period, unnest(factors) AS factor FROM q""")
define("thetas", """WITH v AS (SELECT factor, period, unnest([1, 0]) AS js, unnest([mean_js, mean]) AS premium FROM jsfive WHERE mean IS NOT NULL),
  c AS (SELECT a.reselect, a.period, a.factor, js, premium, mean / nullif(sqrt(se2 * n), 0) AS ir, unnest(['equal', 'ir_weighted']) AS alloc FROM activefactors a JOIN v ON v.factor = a.factor AND v.period = a.period LEFT JOIN wficfive i ON i.factor = a.factor AND i.period = a.period),
  z AS (SELECT *, CASE WHEN alloc = 'equal' THEN 1.0 ELSE abs(coalesce(ir, 0)) END AS size FROM c),
  y AS (SELECT *, sum(size) OVER w AS whole, count(*) OVER w AS k FROM z WINDOW w AS (PARTITION BY alloc, js, reselect, period))
  SELECT alloc, js, reselect, period, factor, CASE WHEN whole > 0 THEN size / whole ELSE 1.0 / k END * premium AS theta FROM y""")
define("sweepmu", f"""SELECT alloc, js, reselect, t.period, stock_id, sum(theta * coalesce(score, 0)) AS mu FROM thetas t
  JOIN (SELECT stock_id, period, unnest([{_LIST}]) AS factor, unnest([{_FIVE}]) AS score FROM zscores WHERE coalesce({_FIVE}) IS NOT NULL) z ON z.period = t.period AND z.factor = t.factor GROUP BY ALL""")
_COST = "(3 * (11 / log10(greatest(coalesce(mcap_usd, 1e7), 1e7))) ** 6 + 3) * 1e-4"
define("ledgerbase", f"""SELECT m.*, fwd1 AS r, {_COST} AS c, coalesce(idio_shrunk, 0.04) AS d, mkt AS beta FROM sweepmu m JOIN fwd f ON f.stock_id = m.stock_id AND f.period = m.period
  LEFT JOIN idioshrunk i ON i.stock_id = m.stock_id AND i.t = year(m.period) * 4 + quarter(m.period) - 1 LEFT JOIN qbeta q ON q.stock_id = m.stock_id AND q.q = m.period""")
define("sweepsettings", f"""WITH g AS (SELECT unnest({AVERSIONS})::double AS ra), k AS (SELECT unnest({CAPS})::double AS mnw), l AS (SELECT unnest({LEVERAGES})::double AS leverage),
  u AS (SELECT b.*, ra, mnw, greatest(least(sign(mu) * greatest(abs(mu) - c, 0) / (ra * d), mnw), -mnw) AS u FROM ledgerbase b, g, k),
  w AS (SELECT *, u - avg(u) OVER (PARTITION BY alloc, js, reselect, ra, mnw, period) AS v FROM u),
  a AS (SELECT *, sum(abs(v)) OVER (PARTITION BY alloc, js, reselect, ra, mnw, period) AS total FROM w)
  SELECT 'alloc=' || alloc || '|js=' || js || '|gl=' || printf('%.1f', leverage) || '|mnw=' || printf('%.2f', mnw) || '|ra=' || printf('%.1f', ra) || '|rf=' || reselect AS strategy_id, period, stock_id,
         v * CASE WHEN total > leverage THEN leverage / total ELSE 1 END AS w, r, c, beta FROM a, l""")
define("gone", "SELECT stock_id, min(date_trunc('quarter', delist_date)::date) AS gone FROM exits WHERE delist_date IS NOT NULL GROUP BY 1")


def _ledger_sql(src: str, sweeps: int = 5) -> str:
    """The ledger of (strategy_id, period, stock_id, w, r, c, beta) by repeated sums."""
    ks = ["k0 AS (SELECT strategy_id, t, g AS net FROM tot)"]
    step = "abs(w - h * coalesce(k, 0))"
    for i in range(sweeps):
        ks.append(f"""k{i + 1} AS (SELECT tot.strategy_id, tot.t, g - tc_trade - tc_exit AS net, turnover, tc_trade, tc_exit FROM tot JOIN (SELECT bb.strategy_id, bb.t, coalesce(sum({step}) FILTER (here), 0) AS turnover,
            coalesce(sum({step} * c) FILTER (here), 0) AS tc_trade, coalesce(sum({step} * c) FILTER (NOT here), 0) AS tc_exit FROM bb
            LEFT JOIN (SELECT strategy_id, t + 1 AS t, CASE WHEN 1 + net > 1e-3 THEN 1 / (1 + net) ELSE 0 END AS k FROM k{i}) d ON d.strategy_id = bb.strategy_id AND d.t = bb.t GROUP BY 1, 2) s ON s.strategy_id = tot.strategy_id AND s.t = tot.t)""")
    return f"""WITH pp AS (SELECT *, dense_rank() OVER (PARTITION BY strategy_id ORDER BY period) AS t FROM ({src})), ts AS (SELECT DISTINCT strategy_id, t, period FROM pp),
      h AS (SELECT strategy_id, t + 1 AS t, stock_id, w * (1 + coalesce(r, 0)) AS h, c AS hc FROM pp),
      bb AS (SELECT ts.strategy_id, ts.t, coalesce(w, 0) AS w, r, coalesce(h, 0) AS h, coalesce(beta, 0) AS beta, pp.stock_id IS NOT NULL AS here, CASE WHEN pp.stock_id IS NOT NULL THEN coalesce(c, 0) WHEN coalesce(gone <= ts.period, false) THEN 0 ELSE coalesce(hc, 0) END AS c
             FROM pp FULL JOIN h ON pp.strategy_id = h.strategy_id AND pp.t = h.t AND pp.stock_id = h.stock_id JOIN ts ON ts.strategy_id = coalesce(pp.strategy_id, h.strategy_id) AND ts.t = coalesce(pp.t, h.t) LEFT JOIN gone ON gone.stock_id = coalesce(pp.stock_id, h.stock_id)),
      tot AS (SELECT strategy_id, t, sum(w * coalesce(r, 0)) AS g, sum(abs(w)) AS gross_lev, sum(w) AS net_exp, sum(w * beta) AS mkt_beta, count(*) FILTER (w > 1e-12) AS n_long, count(*) FILTER (w < -1e-12) AS n_short, count(*) FILTER (here) AS n_names,
                     count(*) FILTER (here AND r IS NULL AND abs(w) > 1e-12) AS n_return_gaps FROM bb GROUP BY 1, 2),
      {", ".join(ks)}
      SELECT tot.strategy_id, period, g AS gross, tc_trade, tc_exit, tc_trade + tc_exit AS tc, net, turnover, gross_lev, net_exp, n_long, n_short, n_names, n_return_gaps, mkt_beta
      FROM tot JOIN k{sweeps} k ON k.strategy_id = tot.strategy_id AND k.t = tot.t JOIN ts ON ts.strategy_id = tot.strategy_id AND ts.t = tot.t"""


define("nextmarket", """SELECT (date_trunc('quarter', date) - INTERVAL 3 MONTH)::date AS period, product(1 + mkt) - 1 AS mkt, product(1 + bench) - 1 AS bench, 0.0001::double AS rf FROM
  (SELECT date, sum(excess_return * mcap_usd) / sum(mcap_usd) AS mkt, sum(excess_return * mcap_usd) FILTER (tradeable) / sum(mcap_usd) FILTER (tradeable) AS bench FROM clean GROUP BY date) GROUP BY 1""")


def _headline_sql(src: str) -> str:
    return f"""WITH x AS (SELECT l.*, mkt, bench, rf FROM ({src}) l LEFT JOIN nextmarket m ON m.period = l.period),
      c AS (SELECT *, curve / max(curve) OVER w - 1 AS fall FROM (SELECT *, product(1 + net) OVER w AS curve FROM x WINDOW w AS (PARTITION BY strategy_id ORDER BY period)) WINDOW w AS (PARTITION BY strategy_id ORDER BY period)),
      f AS (SELECT *, net - coalesce(rf, 0) - coalesce(mkt_beta * mkt, 0) AS hedged, net - coalesce(bench, 0) AS active FROM c)
      SELECT strategy_id, count(net) AS quarters_traded, greatest(product(1 + net), 0) ** (4.0 / count(net)) - 1 AS ann_return_net, stddev_samp(net) * 2 AS ann_vol_net, avg(net) / nullif(stddev_samp(net), 0) * 2 AS sharpe_net,
             avg(hedged) / nullif(stddev_samp(hedged), 0) * 2 AS sharpe_net_hedged, min(fall) AS max_drawdown, avg(active) / nullif(stddev_samp(active), 0) * 2 AS ir_vs_benchmark, avg(turnover) AS avg_turnover, avg(tc) * 1e4 AS avg_tc_bps,
             avg(gross_lev) AS avg_gross_leverage, avg(net_exp) AS avg_net_exposure, avg(mkt_beta) AS avg_mkt_beta, sum(n_return_gaps)::bigint AS return_data_gaps FROM f GROUP BY 1"""


def next_market(spark, d) -> DataFrame:
    """Market and benchmark over the period after each, and a rate."""
    daily = r.market_series(cleaned(spark, d))
    by_quarter = daily.groupBy(period_key(F.col("date"), 3).alias("q")).agg(compound(F.col("mkt")).alias("mkt"), compound(F.col("bench")).alias("bench"))
    return by_quarter.select(F.add_months("q", -3).alias("period"), "mkt", "bench", F.lit(0.0001).alias("rf"))


def gone(spark, d) -> DataFrame:
    return events(spark, d).where("delist_date is not null").select("stock_id", F.trunc("delist_date", "quarter").alias("period"))


define("ledgerbooks", f"SELECT strategy_id, b.period, b.stock_id, w, r, {_COST} AS c, mkt AS beta FROM books b LEFT JOIN qbeta q ON q.stock_id = b.stock_id AND q.q = b.period")
define("bookledger", _ledger_sql("SELECT * FROM ledgerbooks"))
_MONEY = "gross tc_trade tc_exit tc net turnover gross_lev net_exp mkt_beta"


def book_ledger(spark, d) -> DataFrame:
    beta = quarter_beta(spark, d).select("stock_id", "period", F.col("mkt").alias("beta"))
    rows = books(spark, d).withColumn("c", p.cost_coefficient(F.col("mcap_usd"))).join(beta, ["stock_id", "period"], "left")
    return sw.ledger(rows.select("strategy_id", "period", "stock_id", "w", "r", "c", "beta"), ["strategy_id"], exits=gone(spark, d)).drop("leverage")


@query("SELECT * FROM bookledger", _MONEY)
def r17_ledger(spark, d):
    return book_ledger(spark, d)


@query(_headline_sql("SELECT * FROM bookledger"), FIGURES, 5)
def m11_headline(spark, d):
    return sw.headline(book_ledger(spark, d).join(next_market(spark, d), "period", "left"), ["strategy_id"])


def ic_five(spark, d) -> DataFrame:
    return artifact(spark, d, "icfive", lambda: validate.rank_ic(zscores(spark, d), forward(spark, d), FIVE, (1,)).select("period", "factor", "ic"))


def sweep_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    """Scores, costs, variances, betas and next returns by security and period, and the factors' weights of every partial setting; each upstream frame is worked out once."""
    ic = ic_five(spark, d)
    rows = validate.pooled_design(design(spark, d), masks())
    premia = validate.premia(validate.fama_macbeth(rows, "fwd1", FIVE).where(F.col("n") > len(FIVE)), FIVE)
    active = sw.active_factors(ic, sw.schedules(spark, RESELECT, FIRST, LAST), GATE, LAST)
    thetas = sw.factor_thetas(premia, ic, active, FIVE)
    t = (F.year("period") * 4 + F.quarter("period")).cast("long")
    own = p.shrink_idio(idio(spark, d)).select("stock_id", (F.col("t") + 1).alias("_t"), "idio_shrunk")  # what the quarter before knew
    beta = quarter_beta(spark, d).select("stock_id", "period", F.col("mkt").alias("beta"))
    base = zscores(spark, d).select("stock_id", "period", *FIVE).where(F.coalesce(*FIVE).isNotNull()).join(forward(spark, d), ["stock_id", "period"]).withColumn("_t", t).join(own, ["stock_id", "_t"], "left").join(beta, ["stock_id", "period"], "left")
    base = base.select("stock_id", "period", *FIVE, F.col("fwd1").alias("r"), p.cost_coefficient(F.col("mcap_usd")).alias("c"), F.coalesce("idio_shrunk", F.lit(0.04)).alias("d"), "beta")
    return base, thetas


def strategy_id() -> Column:
    return F.format_string("alloc=%s|js=%d|gl=%.1f|mnw=%.2f|ra=%.1f|rf=%d", "alloc", "js", "leverage", "mnw", "ra", "reselect")


def swept(spark, d) -> DataFrame:
    """The thirteen figures of all settings of the six knobs."""
    base, thetas = sweep_inputs(spark, d)
    base = materialize(base, "sweep-base")
    cells = thetas.withColumn("centred", F.lit(True))
    for knob, values in (("ra", AVERSIONS), ("mnw", CAPS), ("leverage", LEVERAGES)):
        cells = cells.withColumn(knob, F.explode(F.array(*[F.lit(float(v)) for v in values])))

    def weight(x):
        mu = F.lit(0.0)
        for f in FIVE:
            mu = mu + x(f"theta_{f}") * F.coalesce(x(f), F.lit(0.0))
        step = F.coalesce(F.try_divide(F.signum(mu) * F.greatest(F.abs(mu) - x("c"), F.lit(0.0)), x("ra") * x("d")), F.lit(0.0))
        return F.greatest(F.least(step, x("mnw")), -x("mnw"))

    books = cells.withColumn("book", strategy_id()).withColumns({"ra_": F.col("ra"), "mnw_": F.col("mnw")})
    rows = sw.swept_ledger(base, books, ["book", "alloc", "js", "reselect", "ra_", "mnw_"], weight, lambda x: x("c"), gone(spark, d)).withColumnsRenamed({"book": "strategy_id", "ra_": "ra", "mnw_": "mnw"})
    return sw.headline(rows.join(F.broadcast(next_market(spark, d)), "period", "left"), ["strategy_id", *KNOBS])  # a row for each period


def sweep(spark, d) -> DataFrame:
    return artifact(spark, d, "sweep", lambda: swept(spark, d))


define("sweptfigures", _headline_sql(_ledger_sql("SELECT * FROM sweepsettings")))


@query("SELECT * FROM sweptfigures", FIGURES, 5)
def r21_six_knobs(spark, d):
    return swept(spark, d).drop(*KNOBS)


@query("SELECT strategy_id, sharpe_net_hedged, row_number() OVER (ORDER BY round(sharpe_net_hedged, 9) DESC NULLS LAST, strategy_id) AS place FROM sweptfigures QUALIFY place <= 15", "sharpe_net_hedged", 5)
def a19_leaderboard(spark, d):
    return sw.leaderboard(sweep(spark, d).withColumn("sharpe_net_hedged", F.round("sharpe_net_hedged", 9)), "sharpe_net_hedged", 15).select("strategy_id", "sharpe_net_hedged", "place")


_PARTS = "split_part(split_part(strategy_id, '{}=', 2), '|', 1)"
define("sweptknobs", f"SELECT *, {', '.join(f'{_PARTS.format(k)} AS {k}' for k in ('alloc', 'js', 'gl', 'mnw', 'ra', 'rf'))} FROM sweptfigures")
_SHOWN = {"alloc": "alloc", "js": "js", "leverage": "gl", "mnw": "mnw::double::varchar", "ra": "ra", "reselect": "rf"}
_BASE = {k: (str(v) if k != "mnw" else "0.02") for k, v in BASELINE.items()}


@query(f"SELECT knob, value, avg(sharpe_net_hedged) AS mean, min(sharpe_net_hedged) AS low, max(sharpe_net_hedged) AS high, count(sharpe_net_hedged) AS n FROM (SELECT sharpe_net_hedged, unnest([{', '.join(f"'{k}'" for k in KNOBS)}]) AS knob, unnest([{', '.join(_SHOWN[k] for k in KNOBS)}]) AS value FROM sweptknobs) GROUP BY 1, 2", "mean low high", 5)
def a19_knob_marginals(spark, d):
    return sw.marginals(sweep(spark, d), KNOBS, "sharpe_net_hedged")


@query(" UNION ALL ".join(f"SELECT '{a}' AS knob_a, {_SHOWN[a]} AS value_a, '{b}' AS knob_b, {_SHOWN[b]} AS value_b, avg(sharpe_net_hedged) AS mean, count(sharpe_net_hedged) AS n FROM sweptknobs GROUP BY 1, 2, 3, 4" for i, a in enumerate(KNOBS) for b in KNOBS[i + 1 :]), "mean", 5)
def a19_knob_interactions(spark, d):
    return sw.interactions(sweep(spark, d), KNOBS, "sharpe_net_hedged")


@query("WITH b AS (SELECT sharpe_net_hedged AS base FROM sweptknobs WHERE " + " AND ".join(f"{_SHOWN[k]} = '{v}'" for k, v in _BASE.items()) + ") " + " UNION ALL ".join(
    f"SELECT '{k}' AS knob, {_SHOWN[k]} AS value, sharpe_net_hedged, sharpe_net_hedged - base AS gain FROM sweptknobs, b WHERE " + " AND ".join(f"{_SHOWN[j]} = '{v}'" for j, v in _BASE.items() if j != k) for k in KNOBS), "sharpe_net_hedged gain", 5)
def a19_one_knob_slices(spark, d):
    return sw.one_knob_slices(sweep(spark, d), BASELINE, "sharpe_net_hedged")
