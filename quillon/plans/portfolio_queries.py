"""Queries over expected returns, risk, weights, books and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import compound, period_key
from quillon.operators import metrics as m
from quillon.operators import portfolio as p
from quillon.operators import sweep as sw
from quillon.operators import validate
from quillon.operators import windows as w
from quillon.plans.factor_queries import zscores
from quillon.plans.oracle import define
from quillon.plans.panel_queries import cleaned, market_daily, periodic
from quillon.plans.registry import query
from quillon.plans.validation_queries import STYLE, design, fm_coefs, forward, quarter_beta, schedule, scorecard

_WF = """SELECT factor, period, CASE WHEN count({v}) OVER w >= 8 THEN avg({v}) OVER w END AS mean, CASE WHEN count({v}) OVER w >= 8 THEN var_samp({v}) OVER w / count({v}) OVER w END AS se2, count({v}) OVER w AS n
 FROM {t} WINDOW w AS (PARTITION BY factor ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
define("wfpremia", _WF.format(v="coef", t="premia"))
define("ic_lag1", "SELECT * FROM icser WHERE lag = 1")
define("wfic", _WF.format(v="ic", t="ic_lag1"))
_JS = """SELECT factor, period, n, mean, se2, CASE WHEN k <= 3 THEN 0 WHEN ss <= 0 THEN 1 ELSE least(greatest((k - 3) * s / ss, 0), 1) END AS js_b,
 bar + (1 - CASE WHEN k <= 3 THEN 0 WHEN ss <= 0 THEN 1 ELSE least(greatest((k - 3) * s / ss, 0), 1) END) * (mean - bar) AS mean_js
 FROM (SELECT *, sum((mean - bar) ** 2) OVER (PARTITION BY period) AS ss FROM (SELECT *, count(mean) OVER g AS k, avg(mean) OVER g AS bar, avg(se2) OVER g AS s FROM {t} WINDOW g AS (PARTITION BY period)))"""


def premia(spark, d) -> DataFrame:
    return validate.premia(fm_coefs(spark, d), ["ep", "size"])


def ic1(spark, d) -> DataFrame:
    return validate.rank_ic(zscores(spark, d), forward(spark, d), STYLE, (1,)).drop("lag", "n")


@query(_WF.format(v="coef", t="premia"), "mean se2", 5)
def w15_walk_forward(spark, d):
    return w.walk_forward(premia(spark, d), "coef", ["factor"])


@query(_JS.format(t="wfpremia"), "mean se2 js_b mean_js", 5)
def r3_walk_forward_premia(spark, d):
    return p.walk_forward_premia(premia(spark, d))


define("js4", "SELECT period, factor, unnest([coef, coef * 2, coef * coef, coef - 0.01]) AS mean, unnest([0.0001, 0.0002, 0.0001, 0.0003]) AS se2, unnest([1, 2, 3, 4]) AS v FROM premia")
define("js8", "SELECT period, factor || v AS factor, mean, se2, 8 AS n FROM js4")


@query(_JS.format(t="js8"), "mean se2 js_b mean_js", 5)
def w16_james_stein(spark, d):
    c = F.col("coef")
    cells = F.explode(F.array(*[F.struct(x.alias("mean"), F.lit(e).alias("se2"), F.lit(k).alias("v")) for k, (x, e) in enumerate(((c, 0.0001), (c * 2, 0.0002), (c * c, 0.0001), (c - 0.01, 0.0003)), 1)]))
    rows = premia(spark, d).select("period", "factor", cells.alias("x")).select("period", F.concat("factor", F.col("x.v").cast("string")).alias("factor"), "x.mean", "x.se2", F.lit(8).alias("n"))
    return w.james_stein(rows, ["period"])


@query("""SELECT z.stock_id, z.period, p.mean * ep AS systematic, i.mean * sigma * ep AS behavioural FROM zscores z JOIN (SELECT * FROM wfpremia WHERE factor = 'ep') p ON p.period = z.period
          JOIN (SELECT * FROM wfic WHERE factor = 'ep') i ON i.period = z.period JOIN (SELECT period, stddev_samp(ret_wins) AS sigma FROM periodic GROUP BY 1) s ON s.period = z.period""", "systematic behavioural", 5)
def r1_expected_returns(spark, d):
    ep = F.col("factor") == "ep"
    premium = w.walk_forward(premia(spark, d), "coef", ["factor"]).where(ep).select("period", F.col("mean").alias("premium"))
    skill = w.walk_forward(ic1(spark, d), "ic", ["factor"]).where(ep).select("period", F.col("mean").alias("skill"))
    sigma = periodic(spark, d).groupBy("period").agg(F.stddev_samp("ret_wins").alias("sigma"))
    rows = zscores(spark, d).join(premium, "period").join(skill, "period").join(sigma, "period")
    z = F.col("ep")
    return rows.select("stock_id", "period", p.systematic_return(F.col("premium"), z).alias("systematic"), p.behavioural_return(F.col("skill"), F.col("sigma"), z).alias("behavioural"))


@query("SELECT factor, period, mean, se2, n, mean / nullif(sqrt(se2 * n), 0) AS ir FROM wfic", "mean se2 ir", 5)
def r5_walk_forward_ir(spark, d):
    return p.walk_forward_ir(ic1(spark, d))


@query("SELECT factor, period, CASE WHEN sum(abs(coalesce(mean, 0))) OVER w > 0 THEN abs(coalesce(mean, 0)) / sum(abs(coalesce(mean, 0))) OVER w ELSE 1.0 / count(*) OVER w END AS alpha FROM wfic WINDOW w AS (PARTITION BY period)", "alpha", 5)
def r2_factor_weights(spark, d):
    known = w.walk_forward(ic1(spark, d), "ic", ["factor"])
    return p.factor_weights(known, ["period"], "mean").select("factor", "period", "alpha")


def expected(spark, d) -> DataFrame:
    z = zscores(spark, d).withColumn("sub_universe", F.when(F.col("industry") == "bank", "bank").otherwise("insurance"))
    known = p.walk_forward_premia(premia(spark, d)).select("period", F.lit("all").alias("sub_universe"), "factor", F.col("mean_js").alias("premium"))
    alphas = p.factor_weights(known, ["period"]).select("period", "factor", "alpha")
    return p.integrated_return(z, ["ep", "size"], known, alphas)


@query("""SELECT z.stock_id, z.period, 0.5::double * coalesce(a.mean, 0) * coalesce(ep, 0) + 0.5::double * coalesce(b.mean, 0) * coalesce(size, 0) AS mu FROM zscores z
          LEFT JOIN (SELECT * FROM wfpremia WHERE factor = 'ep') a ON a.period = z.period LEFT JOIN (SELECT * FROM wfpremia WHERE factor = 'size') b ON b.period = z.period WHERE ep IS NOT NULL OR size IS NOT NULL""", "mu", 5)
def r6_integrated_return(spark, d):
    return expected(spark, d)


def risk_inputs(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = design(spark, d)
    return p.factor_returns(rows, "fwd1", ["ep", "size"], 8)


define("frets", "SELECT period, const, ep, size FROM fmcoef")
define("resids", """SELECT z.stock_id, z.period, fwd1 - (const + c.ep * z.ep + c.size * z.size) AS resid, (year(z.period) * 4 + quarter(z.period))::bigint AS t
       FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period JOIN fmcoef c ON c.period = z.period""")


@query("SELECT stock_id, period, resid FROM resids", "resid", 5)
def r7_residuals(spark, d):
    long, resid = risk_inputs(spark, d)
    kept = long.where("f is not null").select("period").distinct()
    return resid.join(kept, "period", "left_semi").select("stock_id", "period", "resid")


def _t() -> Column:
    return (F.year("period") * 4 + F.quarter("period")).cast("long")


define("shrunk", """WITH f AS (SELECT (year(period) * 4 + quarter(period))::bigint AS t, ep, size FROM frets WHERE ep IS NOT NULL AND size IS NOT NULL),
  s AS (SELECT a.t, b.ep, b.size FROM f a JOIN f b ON b.t <= a.t AND b.t > a.t - 20),
  z AS (SELECT t, (ep - avg(ep) OVER w) / nullif(stddev_pop(ep) OVER w, 0) AS x, (size - avg(size) OVER w) / nullif(stddev_pop(size) OVER w, 0) AS y, var_pop(ep) OVER w AS vx, var_pop(size) OVER w AS vy FROM s WINDOW w AS (PARTITION BY t)),
  m AS (SELECT t, count(*) AS n, avg((coalesce(x, 0) ** 2 + coalesce(y, 0) ** 2) ** 2) AS q, coalesce(avg(x * x), 0) AS xx, coalesce(avg(y * y), 0) AS yy, coalesce(avg(x * y), 0) AS xy, any_value(vx) AS vx, any_value(vy) AS vy FROM z GROUP BY 1 HAVING count(*) > 1),
  d AS (SELECT *, xx * xx + yy * yy + 2 * xy * xy - (xx + yy) ** 2 / 2 AS d2, (q - (xx * xx + yy * yy + 2 * xy * xy)) / n AS b2 FROM m),
  e AS (SELECT *, CASE WHEN d2 > 1e-12 THEN least(greatest(b2, 0), d2) / d2 ELSE 0 END AS delta FROM d)
  SELECT t, delta, unnest(['ep', 'ep', 'size']) AS a, unnest(['ep', 'size', 'size']) AS b, unnest([sqrt(vx * vx) * xx, sqrt(vx * vy) * xy * (1 - delta), sqrt(vy * vy) * yy]) AS cov FROM e""")


def factor_covariance(spark, d) -> DataFrame:
    long, _ = risk_inputs(spark, d)
    wide = long.groupBy("period").pivot("factor", ["ep", "size"]).agg(F.first("f")).where("ep is not null and size is not null").select(_t().alias("t"), "ep", "size")
    return p.shrunk_covariance(wide, ["ep", "size"], 20)


@query("SELECT t, delta, a, b, cov FROM shrunk", "delta cov", 7)
def r8_shrunk_covariance(spark, d):
    return factor_covariance(spark, d)


_IDIO = """SELECT r.stock_id, t, industry, CASE WHEN count(resid) OVER w >= 4 THEN var_samp(resid) OVER w END AS idio, count(resid) OVER w AS n FROM resids r JOIN securities USING (stock_id)
 WINDOW w AS (PARTITION BY r.stock_id ORDER BY t RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)"""
_FILL = f"SELECT stock_id, t, industry, CASE WHEN idio IS NULL THEN 4 ELSE n END AS n, coalesce(idio, median(idio) OVER (PARTITION BY t, industry), median(idio) OVER (PARTITION BY t)) AS idio FROM ({_IDIO})"


def idio(spark, d) -> DataFrame:
    from quillon.sources import surrogate as s

    long, resid = risk_inputs(spark, d)
    kept = long.where("f is not null").select("period").distinct()
    rows = resid.join(kept, "period", "left_semi").withColumn("t", _t())
    return p.fill_idio(p.idio_variance(rows, 12, 4).join(s.securities(spark, d).select("stock_id", "industry"), "stock_id"), "industry", 4)


@query(f"SELECT stock_id, t, idio, n FROM ({_IDIO})", "idio", 7)
def a14_idio_variance(spark, d):
    long, resid = risk_inputs(spark, d)
    kept = long.where("f is not null").select("period").distinct()
    return p.idio_variance(resid.join(kept, "period", "left_semi").withColumn("t", _t()), 12, 4)


@query(_FILL, "idio", 7)
def r10_fill_idio(spark, d):
    return idio(spark, d).select("stock_id", "t", "industry", "n", "idio")


define("idioshrunk", f"""SELECT stock_id, t, (1 - delta) * idio + delta * bar AS idio_shrunk FROM (SELECT *, CASE WHEN spread > 0 THEN least(greatest(noise / spread, 0), 1) ELSE 1 END AS delta FROM
           (SELECT *, avg((idio - bar) ** 2) OVER (PARTITION BY t) AS spread, avg(2 * idio ** 2 / greatest(n - 1, 1)) OVER (PARTITION BY t) AS noise FROM (SELECT *, avg(idio) OVER (PARTITION BY t) AS bar FROM ({_FILL}))))""")


@query("SELECT stock_id, t, idio_shrunk FROM idioshrunk", "idio_shrunk", 7)
def r9_shrink_idio(spark, d):
    return p.shrink_idio(idio(spark, d)).select("stock_id", "t", "idio_shrunk")


# Half-yearly rebalancing over quarterly returns: variances count twice.
@query("""WITH RECURSIVE q AS (SELECT 'factor' AS kind, a, b, t, 2 * cov AS x FROM shrunk UNION ALL SELECT 'idio', stock_id::varchar, stock_id::varchar, t, 2 * idio_shrunk FROM idioshrunk WHERE idio_shrunk IS NOT NULL),
          e AS (SELECT q.kind, q.a, q.b, q.t, q.x AS ema FROM q LEFT JOIN q p ON p.kind = q.kind AND p.a = q.a AND p.b = q.b AND p.t = q.t - 1 WHERE p.t IS NULL
                UNION ALL SELECT q.kind, q.a, q.b, q.t, 0.5 * e.ema + 0.5 * q.x FROM e JOIN q ON q.kind = e.kind AND q.a = e.a AND q.b = e.b AND q.t = e.t + 1)
          SELECT kind, a, b, t, ema AS value FROM e UNION ALL SELECT 'idio', stock_id::varchar, stock_id::varchar, t, NULL FROM idioshrunk WHERE idio_shrunk IS NULL""", "value", 7)
def r11_risk_panel(spark, d):
    own = p.shrink_idio(idio(spark, d)).select("stock_id", "t", F.col("idio_shrunk").alias("v"))
    return p.risk_panel(factor_covariance(spark, d), own, 0.5, 2.0)


define("books", """SELECT 'q' || bucket AS strategy_id, stock_id, period, fwd1 AS r, mcap_usd, 1.0::double / count(*) OVER (PARTITION BY period, bucket) AS w FROM (SELECT z.stock_id, z.period, fwd1, mcap_usd,
       (row_number() OVER (PARTITION BY z.period ORDER BY ep, z.stock_id) - 1) * 5 // count(*) OVER (PARTITION BY z.period) + 1 AS bucket FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period WHERE ep IS NOT NULL)""")


def books(spark, d) -> DataFrame:
    """Long-only books of each quintile of one score."""
    rows = w.quantile_bucket(design(spark, d).where("ep is not null"), "ep", 5, ["period"])
    each = W.partitionBy("period", "bucket")
    return rows.select(F.concat(F.lit("q"), F.col("bucket").cast("string")).alias("strategy_id"), "stock_id", "period", F.col("fwd1").alias("r"), "mcap_usd", (1.0 / F.count("*").over(each)).alias("w"))


@query("""WITH h AS (SELECT strategy_id, (year(period) * 4 + quarter(period))::bigint AS t, stock_id, w FROM books), z AS (SELECT stock_id, (year(period) * 4 + quarter(period))::bigint AS t, ep, size FROM zscores),
  b AS (SELECT strategy_id, h.t, sum(w * ep) AS bx, sum(w * size) AS by_ FROM h JOIN z ON h.stock_id = z.stock_id AND h.t = z.t GROUP BY 1, 2),
  f AS (SELECT t, max(CASE WHEN a = 'ep' AND b = 'ep' THEN cov END) AS xx, max(CASE WHEN a = 'ep' AND b = 'size' THEN cov END) AS xy, max(CASE WHEN a = 'size' THEN cov END) AS yy FROM shrunk GROUP BY 1),
  i AS (SELECT strategy_id, h.t, sum(idio_shrunk * w ** 2) AS idio_var FROM h JOIN idioshrunk s ON h.stock_id = s.stock_id AND h.t = s.t GROUP BY 1, 2)
  SELECT strategy_id, t, bx * bx * xx + 2 * bx * by_ * xy + by_ * by_ * yy AS factor_var, idio_var, bx * bx * xx + 2 * bx * by_ * xy + by_ * by_ * yy + idio_var AS variance FROM b JOIN f USING (t) JOIN i USING (strategy_id, t)""", "factor_var idio_var variance", 7)
def r12_portfolio_risk(spark, d):
    held = books(spark, d).withColumn("t", _t()).select("strategy_id", "t", "stock_id", "w")
    exposures = zscores(spark, d).withColumn("t", _t()).select("stock_id", "t", "ep", "size")
    own = p.shrink_idio(idio(spark, d)).select("stock_id", "t", F.col("idio_shrunk").alias("idio"))
    return p.portfolio_risk(held, exposures, factor_covariance(spark, d), own, ["ep", "size"])


@query("""SELECT stock_id, period, mcap_usd * coalesce(share, median(share) OVER (PARTITION BY industry), 1) AS free_float_mcap FROM (SELECT *, CASE WHEN ff IS NOT NULL THEN least(greatest(ff / CASE WHEN (SELECT median(free_float_percentage) FROM periodic WHERE stock_id % 9 <> 0) > 1 THEN 100 ELSE 1 END, 0), 1) END AS share
          FROM (SELECT *, CASE WHEN stock_id % 9 <> 0 THEN free_float_percentage END AS ff FROM periodic))""", "free_float_mcap", 3)
def r13_free_float(spark, d):
    rows = periodic(spark, d).withColumn("free_float_percentage", F.when(F.col("stock_id") % 9 != 0, F.col("free_float_percentage")))
    return p.free_float_cap(rows, "industry").select("stock_id", "period", "free_float_mcap")


@query("SELECT stock_id, period, (3 * (11 / log10(greatest(coalesce(mcap_usd, 1e7), 1e7))) ** 6 + 3) * 1e-4 AS cost FROM periodic", "cost", 9)
def r14_cost_coefficient(spark, d):
    return periodic(spark, d).select("stock_id", "period", p.cost_coefficient(F.col("mcap_usd")).alias("cost"))


@query("SELECT strategy_id, period, sum(abs(w - w0)) AS turnover, sum(abs(w - w0) * 0.001) AS tc FROM (SELECT *, coalesce(lag(w) OVER (PARTITION BY strategy_id, stock_id ORDER BY period), 0) AS w0 FROM books) GROUP BY 1, 2", "turnover tc")
def r15_turnover_cost(spark, d):
    order = W.partitionBy("strategy_id", "stock_id").orderBy("period")
    return p.turnover_cost(books(spark, d).withColumn("w0", F.lag("w").over(order)).withColumn("cost", F.lit(0.001)), ["strategy_id", "period"])


_MU = """SELECT z.stock_id, z.period, ep * 0.01::double + size * 0.005::double AS mu, 0.04::double AS d, 0.001::double AS c, 0::double AS w0 FROM zscores z WHERE ep IS NOT NULL AND size IS NOT NULL"""


def _targets(spark, d) -> DataFrame:
    z = zscores(spark, d).where("ep is not null and size is not null")
    return z.select("stock_id", "period", (F.col("ep") * 0.01 + F.col("size") * 0.005).alias("mu"), F.lit(0.04).alias("d"), F.lit(0.001).alias("c"), F.lit(0.0).alias("w0"))


_BUILD = """SELECT strategy_id, stock_id, period, c, v * CASE WHEN sum(abs(v)) OVER b > gross THEN gross / sum(abs(v)) OVER b ELSE 1 END AS w FROM (SELECT *, u - CASE WHEN net = 1 THEN avg(u) OVER (PARTITION BY strategy_id, period) ELSE 0 END AS v FROM
 (SELECT *, least(greatest(w0 + sign(mu - lam * d * w0) * greatest(abs(mu - lam * d * w0) - c, 0) / (lam * d), -cap), cap) AS u FROM ({t}))) WINDOW b AS (PARTITION BY strategy_id, period)"""


@query(f"""SELECT strategy_id, stock_id, period, w FROM ({_BUILD.format(t=f"SELECT 'base' AS strategy_id, 5::double AS lam, 0.05::double AS cap, 1::double AS gross, 1 AS net, * FROM ({_MU})")})""", "w")
def r16_build_weights(spark, d):
    return p.build_weights(_targets(spark, d).withColumn("strategy_id", F.lit("base")), 5.0, 0.05, 1.0).select("strategy_id", "stock_id", "period", "w")


def _account_sql(src: str, sweeps: int = 5) -> str:
    """Book accounting over (strategy_id, period, stock_id, w, r, c), every name charged but those without a row."""
    ks = ["k0 AS (SELECT strategy_id, t, gross AS net, 0.0::double AS turnover, 0.0::double AS tc FROM g)"]
    for i in range(sweeps):
        ks.append(f"""k{i + 1} AS (SELECT g.strategy_id, g.t, gross - tc AS net, turnover, tc FROM g JOIN (SELECT bb.strategy_id, bb.t, sum(abs(w - h * coalesce(k, 0))) AS turnover, sum(abs(w - h * coalesce(k, 0)) * c) AS tc FROM bb
            LEFT JOIN (SELECT strategy_id, t + 1 AS t, CASE WHEN 1 + net > 1e-3 THEN 1 / (1 + net) ELSE 0 END AS k FROM k{i}) d ON d.strategy_id = bb.strategy_id AND d.t = bb.t GROUP BY 1, 2) s ON s.strategy_id = g.strategy_id AND s.t = g.t)""")
    return f"""WITH pp AS (SELECT *, dense_rank() OVER (PARTITION BY strategy_id ORDER BY period) AS t FROM ({src})), l AS (SELECT strategy_id, max(t) AS last FROM pp GROUP BY 1),
      h AS (SELECT pp.strategy_id, t + 1 AS t, stock_id, w * (1 + coalesce(r, 0)) AS h FROM pp JOIN l ON l.strategy_id = pp.strategy_id WHERE t < last),
      bb AS (SELECT coalesce(pp.strategy_id, h.strategy_id) AS strategy_id, coalesce(pp.t, h.t) AS t, coalesce(w, 0) AS w, coalesce(r, 0) AS r, coalesce(h, 0) AS h, coalesce(c, 0) AS c
             FROM pp FULL JOIN h ON pp.strategy_id = h.strategy_id AND pp.t = h.t AND pp.stock_id = h.stock_id),
      g AS (SELECT strategy_id, t, sum(w * r) AS gross, sum(abs(w)) AS leverage, sum(w) AS net_exposure, sum((w > 0)::int)::bigint AS n_long, sum((w < 0)::int)::bigint AS n_short FROM bb GROUP BY 1, 2),
      {", ".join(ks)}
      SELECT g.strategy_id, q.period, gross, turnover, tc, net, leverage, net_exposure, n_long, n_short FROM g JOIN k{sweeps} k ON k.strategy_id = g.strategy_id AND k.t = g.t JOIN (SELECT DISTINCT strategy_id, t, period FROM pp) q ON q.strategy_id = g.strategy_id AND q.t = g.t"""


define("accounts", _account_sql("SELECT strategy_id, period, stock_id, w, r, (3 * (11 / log10(greatest(coalesce(mcap_usd, 1e7), 1e7))) ** 6 + 3) * 1e-4 AS c FROM books"))
_FIGURES = "gross turnover tc net leverage net_exposure"


def booked(spark, d) -> DataFrame:
    rows = books(spark, d).withColumn("c", p.cost_coefficient(F.col("mcap_usd"))).withColumn("voluntary", F.lit(True))
    return p.account(rows.select("strategy_id", "period", "stock_id", "w", "r", "c", "voluntary"))


@query("SELECT * FROM accounts", _FIGURES)
def r17_book_accounting(spark, d):
    return booked(spark, d)


@query("SELECT strategy_id, period, sum(w * coalesce(r, 0)) AS pnl FROM books GROUP BY 1, 2", "pnl")
def r18_cross_section_pnl(spark, d):
    return books(spark, d).groupBy("strategy_id", "period").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("pnl"))


@query("""WITH c AS (SELECT DISTINCT unnest(generate_series((SELECT min(period) FROM grid), (SELECT max(period) FROM grid), INTERVAL 24 MONTH))::date AS cutoff)
          SELECT row_number() OVER (ORDER BY cutoff) AS regime, cutoff, count(DISTINCT g.period) AS n_periods FROM c LEFT JOIN grid g ON g.period >= cutoff AND g.period < cutoff + INTERVAL 24 MONTH GROUP BY cutoff""")
def r19_regime_schedule(spark, d):
    from quillon.operators.resample import rebalance_grid

    periods = rebalance_grid(cleaned(spark, d)).select("period").distinct()
    ends = periods.agg(F.min("period").alias("a"), F.max("period").alias("b"))
    cut = ends.select(F.explode(F.expr("sequence(a, b, interval 24 months)")).alias("cutoff"))
    inside = (F.col("period") >= F.col("cutoff")) & (F.col("period") < F.add_months("cutoff", 24))
    counts = cut.join(periods, inside, "left").groupBy("cutoff").agg(F.count_distinct("period").alias("n_periods"))
    return counts.select(F.row_number().over(W.orderBy("cutoff")).cast("long").alias("regime"), "cutoff", "n_periods")


@query("SELECT cutoff, array_to_string(last_value(CASE WHEN len(l) > 0 THEN l END IGNORE NULLS) OVER (ORDER BY cutoff), ',') AS shortlist FROM (SELECT cutoff, coalesce(list(factor ORDER BY factor) FILTER (selected), []) AS l FROM selectioncard GROUP BY cutoff)")
def r20_shortlist_history(spark, d):
    return validate.carry_forward(scorecard(spark, d)).select("cutoff", F.array_join("shortlist", ",").alias("shortlist"))


#: The reference has six knobs as well, 216 settings in all.
KNOBS = {"lam": [5, 2, 10], "cap": [0.05, 0.02, 0.1], "gross": [1, 0.5, 2], "cost": [1, 2], "tilt": [1, 0.5], "net": [1, 0]}
_LISTS = " CROSS JOIN ".join(f"(SELECT unnest([{', '.join(f'{float(v)}::double' for v in values)}]) AS {k}) AS list_{k}" for k, values in KNOBS.items())
_IDS = " || '|' || ".join(f"printf('{k}=%.4f', {k})" for k in KNOBS)
_GRID = f"SELECT {_IDS} AS strategy_id, lam, cap, gross, net, stock_id, period, ep * 0.01::double + tilt * size * 0.005::double AS mu, 0.04::double AS d, cost * 0.001::double AS c, 0::double AS w0 FROM zscores CROSS JOIN {_LISTS} WHERE ep IS NOT NULL AND size IS NOT NULL"
define("sweepbooks", f"SELECT x.*, fwd1 AS r FROM ({_BUILD.format(t=_GRID)}) x LEFT JOIN fwd USING (stock_id, period)")


def sweep(spark, d, mode: str) -> DataFrame:
    """Books of every setting, built, held and accounted for in one job; no book is stored row by row."""
    z = zscores(spark, d).where("ep is not null and size is not null").select("stock_id", "period", "ep", "size")
    base = z.join(forward(spark, d).select("stock_id", "period", F.col("fwd1").alias("r")), ["stock_id", "period"], "left").withColumn("beta", F.lit(0.0))
    grid = p.knob_grid(spark, KNOBS, mode).withColumnsRenamed({"cost": "fee", "net": "neutral"})
    cells = base.select("period").distinct().crossJoin(F.broadcast(grid)).withColumns({"leverage": F.col("gross"), "centred": F.col("neutral") == 1})  # 216 settings at most

    def weight(x):
        mu = x("ep") * 0.01 + x("tilt") * x("size") * 0.005
        step = F.signum(mu) * F.greatest(F.abs(mu) - x("fee") * 0.001, F.lit(0.0)) / (x("lam") * 0.04)
        return F.least(F.greatest(step, -x("cap")), x("cap"))

    rows = sw.swept_ledger(base, cells.drop("gross"), ["strategy_id"], weight, lambda x: x("fee") * 0.001, exit_costs=False, held=0.0)
    turnover = (F.col("turnover") + F.col("turnover_exit")).alias("turnover")
    return rows.select("strategy_id", "period", "gross", turnover, "tc", "net", F.col("gross_lev").alias("leverage"), F.col("net_exp").alias("net_exposure"), "n_long", "n_short")


_SWEPT = "SELECT strategy_id, avg(net) AS mean, stddev_samp(net) AS std, avg(turnover) AS turnover, avg(tc) AS tc, avg(leverage) AS leverage, count(*) AS n FROM ({}) GROUP BY 1"


@query(_SWEPT.format(_account_sql("SELECT * FROM sweepbooks", 4)), "mean std turnover tc leverage")
def r21_grid_sweep(spark, d):
    return sweep(spark, d, "full").groupBy("strategy_id").agg(F.avg("net").alias("mean"), F.stddev_samp("net").alias("std"), F.avg("turnover").alias("turnover"), F.avg("tc").alias("tc"), F.avg("leverage").alias("leverage"), F.count("*").alias("n"))


_FIRST = {k: float(v[0]) for k, v in KNOBS.items()}
_ONE = f"SELECT * FROM ({_GRID.replace('mu,', 'mu, cost, tilt,', 1)}) WHERE {' + '.join(f'({k} <> {v})::int' for k, v in _FIRST.items())} <= 1"


@query(_account_sql(f"SELECT x.*, fwd1 AS r FROM ({_BUILD.format(t=_ONE)}) x LEFT JOIN fwd USING (stock_id, period)", 4), _FIGURES)
def r21_one_at_a_time(spark, d):
    return sweep(spark, d, "one_at_a_time")


define("perf", "SELECT strategy_id, period, sum(w * coalesce(r, 0)) AS net, sum(abs(w)) AS turnover, 0.001::double * sum(abs(w)) AS tc FROM books GROUP BY 1, 2")


def perf(spark, d) -> DataFrame:
    turn = F.sum(F.abs("w"))
    return books(spark, d).groupBy("strategy_id", "period").agg(F.sum(F.col("w") * F.coalesce("r", F.lit(0.0))).alias("net"), turn.alias("turnover"), (0.001 * turn).alias("tc"))


define("mktq", "SELECT date_trunc('quarter', date)::date AS period, product(1 + r) - 1 AS mkt, 0.0001::double AS rf FROM mkt_daily GROUP BY 1")


@query("""SELECT strategy_id, p.period, net, mkt, net - coalesce(rf, 0) - CASE WHEN mkt IS NOT NULL THEN 1.0 * mkt ELSE NULL END AS hedged FROM perf p LEFT JOIN (SELECT (period - INTERVAL 3 MONTH)::date AS period, mkt, rf FROM mktq) m ON m.period = p.period""", "net mkt hedged", 5)
def m1_hedged_returns(spark, d):
    market = market_daily(spark, d).groupBy(period_key(F.col("date"), 3).alias("period")).agg(compound(F.col("x")).alias("mkt")).withColumn("rf", F.lit(0.0001))
    return m.hedged(m.join_market(perf(spark, d), market, 3).withColumn("beta", F.lit(1.0))).select("strategy_id", "period", "net", "mkt", "hedged")


@query("""SELECT strategy_id, greatest(product(1 + net), 0) ** (4.0 / count(net)) - 1 AS ann_return, avg(net) / nullif(stddev_samp(net), 0) * 2 AS sharpe, min(fall) AS max_drawdown, avg(turnover) AS avg_turnover, avg(tc) AS avg_cost, count(net) AS n_periods
          FROM (SELECT *, curve / max(curve) OVER w - 1 AS fall FROM (SELECT *, product(1 + net) OVER w AS curve FROM perf WINDOW w AS (PARTITION BY strategy_id ORDER BY period)) WINDOW w AS (PARTITION BY strategy_id ORDER BY period)) GROUP BY 1""", "ann_return sharpe max_drawdown avg_turnover avg_cost", 5)
def m9_performance(spark, d):
    return m.performance(perf(spark, d), "strategy_id", "net", 4)


@query("SELECT strategy_id, avg(net - mkt) / nullif(stddev_samp(net - mkt), 0) * 2 AS ir FROM perf p JOIN (SELECT (period - INTERVAL 3 MONTH)::date AS period, mkt FROM mktq) m ON m.period = p.period GROUP BY 1", "ir", 5)
def m4_information_ratio(spark, d):
    market = market_daily(spark, d).groupBy(period_key(F.col("date"), 3).alias("period")).agg(compound(F.col("x")).alias("mkt")).withColumn("rf", F.lit(0.0))
    both = m.join_market(perf(spark, d), market, 3).where("mkt is not null")
    return both.groupBy("strategy_id").agg(m.sharpe(F.col("net") - F.col("mkt"), 4).alias("ir"))


define("picks", """SELECT cutoff, factor, coalesce(abs(avg(ic) / nullif(stddev_samp(ic), 0)) > 0.15, false) AS selected, avg(ic) AS mean
       FROM ic_lag1 JOIN (SELECT unnest(generate_series(DATE '1998-01-01', DATE '2001-10-01', INTERVAL 12 MONTH))::date AS cutoff) ON period <= cutoff GROUP BY 1, 2""")


def picks(spark, d) -> DataFrame:
    stats = validate.statistics_by_cutoff(ic1(spark, d), schedule(spark, "1998-01-01", "2001-10-01", 12), ["factor"], "ic")
    return stats.select("cutoff", "factor", F.coalesce(F.abs("ir") > 0.15, F.lit(False)).alias("selected"), "mean")


@query("SELECT factor, cutoff, selected, mean FROM picks QUALIFY row_number() OVER (PARTITION BY factor ORDER BY abs(mean) DESC NULLS LAST, cutoff, selected) = 1", "mean", 5)
def t1_best_rows(spark, d):
    return validate.best_rows(picks(spark, d), "factor", "mean")


define("cards", """SELECT cutoff, factor, abs(avg(ic) / nullif(stddev_samp(ic), 0)) > 0.15 AS selected, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) AS ir_lag1, count(ic)::double AS fm_t
       FROM ic_lag1 JOIN (SELECT unnest(generate_series(DATE '1998-01-01', DATE '2001-10-01', INTERVAL 12 MONTH))::date AS cutoff) ON period <= cutoff GROUP BY 1, 2""")


@query("SELECT cutoff, factor, selected, row_number() OVER (PARTITION BY cutoff ORDER BY selected DESC NULLS LAST, abs(ir_lag1) DESC NULLS LAST, abs(fm_t) DESC NULLS LAST, factor) AS place FROM cards")
def t2_scorecard_order(spark, d):
    stats = validate.statistics_by_cutoff(ic1(spark, d), schedule(spark, "1998-01-01", "2001-10-01", 12), ["factor"], "ic")
    card = stats.select("cutoff", "factor", (F.abs("ir") > 0.15).alias("selected"), F.round("ir", 6).alias("ir_lag1"), F.col("n").cast("double").alias("fm_t"))
    return validate.scorecard_order(card).select("cutoff", "factor", "selected", "place")


@query("SELECT cutoff, last_value(CASE WHEN len(l) > 0 THEN array_to_string(l, ',') END IGNORE NULLS) OVER (ORDER BY cutoff) AS shortlist FROM (SELECT cutoff, coalesce(list(factor ORDER BY factor) FILTER (selected), []) AS l FROM picks GROUP BY cutoff)")
def r20_carry_forward(spark, d):
    return validate.carry_forward(picks(spark, d)).select("cutoff", F.array_join("shortlist", ",").alias("shortlist"))


@query("""SELECT factor, count(CASE WHEN selected THEN 1 END) AS n_selected, avg(selected::int) AS share, min(CASE WHEN selected THEN cutoff END) AS first_selected, max(CASE WHEN selected THEN cutoff END) AS last_selected,
          bool_or(selected AND cutoff = (SELECT max(cutoff) FROM picks)) AS current FROM picks GROUP BY factor""", "share")
def m5_selection_frequency(spark, d):
    return m.selection_frequency(picks(spark, d))


@query("SELECT cutoff, factor, CASE WHEN selected AND NOT b THEN 'entry' WHEN NOT selected AND b THEN 'exit' END AS change FROM (SELECT *, coalesce(lag(selected) OVER (PARTITION BY factor ORDER BY cutoff), false) AS b FROM picks)")
def m6_transitions(spark, d):
    return w.transitions(picks(spark, d), "selected", ["factor"], "cutoff").select("cutoff", "factor", "change")


@query("""WITH l AS (SELECT cutoff, coalesce(list(factor) FILTER (selected), []) AS now FROM picks GROUP BY cutoff), p AS (SELECT *, lag(now) OVER (ORDER BY cutoff) AS old FROM l)
          SELECT cutoff, len(now)::bigint AS n, len(list_filter(now, lambda x: NOT list_contains(old, x)))::bigint * CASE WHEN old IS NULL THEN NULL ELSE 1 END AS added, len(list_filter(old, lambda x: NOT list_contains(now, x)))::bigint AS dropped,
                 CASE WHEN old IS NOT NULL THEN CASE WHEN len(list_distinct(list_concat(now, old))) > 0 THEN len(list_intersect(now, old)) / len(list_distinct(list_concat(now, old))) ELSE 1 END END AS jaccard FROM p""", "jaccard")
def m7_shortlist_turnover(spark, d):
    return m.shortlist_turnover(picks(spark, d))


@query("SELECT cutoff, factor, 'mean' AS metric, mean AS value FROM picks", "value", 5)
def m8_factor_health(spark, d):
    return m.health(picks(spark, d), ["mean"])


@query("""SELECT strategy_id, avg(net) AS mean, stddev_samp(net) AS std, avg(net) / nullif(stddev_samp(net), 0) * 2 AS sharpe, avg(gross) / nullif(stddev_samp(gross), 0) * 2 AS gross_sharpe, min(net) AS worst, max(net) AS best,
          avg((net > 0)::int) AS hit_rate, avg(turnover) AS turnover, avg(tc) AS cost, avg(leverage) AS leverage, avg(net_exposure) AS net_exposure, avg(n_long) AS n_long, avg(n_short) AS n_short FROM accounts GROUP BY 1""",
       "mean std sharpe gross_sharpe worst best hit_rate turnover cost leverage net_exposure n_long n_short", 5)
def m11_summary(spark, d):
    return m.summary(booked(spark, d), "strategy_id", 4)


@query("SELECT z.stock_id, z.period, coalesce(mkt, median(CASE WHEN mkt <> 0 THEN mkt END) OVER (PARTITION BY z.period), 0) AS mkt, coalesce(ep, 0) AS ep FROM zscores z JOIN qbeta q ON z.stock_id = q.stock_id AND z.period = q.q", "mkt ep")
def j17_risk_exposures(spark, d):
    rows = w.fill_loading(zscores(spark, d).join(quarter_beta(spark, d), ["stock_id", "period"]), ["mkt"])
    return rows.select("stock_id", "period", F.coalesce("mkt", F.lit(0.0)).alias("mkt"), F.coalesce("ep", F.lit(0.0)).alias("ep"))
