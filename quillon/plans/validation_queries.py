"""Queries over factor tests, redundancy, selection and panel econometrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.operators import curves as cv
from quillon.operators import econometrics as ec
from quillon.operators import regress, validate
from quillon.operators import windows as w
from quillon.plans.factor_queries import NS_SQL, _reg_sql, masks, zscores
from quillon.plans.oracle import CTES, define
from quillon.plans.panel_queries import monthly, periodic
from quillon.plans.registry import query
from quillon.sources import surrogate as s
from quillon.sources.shared import artifact, materialize

STYLE = ["ep", "dy", "size"]


def forward(spark, d) -> DataFrame:
    return artifact(spark, d, "forward", lambda: w.forward(periodic(spark, d), "ret_wins", (1, 2)).select("stock_id", "period", "fwd1", "fwd2", "mcap_usd"))


def design(spark, d) -> DataFrame:
    return zscores(spark, d).join(forward(spark, d), ["stock_id", "period"])


def quarter_beta(spark, d) -> DataFrame:
    rows = w.rolling_beta(monthly(spark, d)).withColumn("q", F.trunc("period", "quarter"))
    return rows.groupBy("stock_id", F.col("q").alias("period")).agg(F.max_by("beta", "date").alias("mkt"))


define("qbeta", "SELECT stock_id, date_trunc('quarter', period)::date AS q, arg_max_null(beta, date) AS mkt FROM mktbeta GROUP BY 1, 2")
define("resid", """SELECT z.stock_id, z.date, z.period, industry, ep - (regr_intercept(CASE WHEN mkt IS NOT NULL THEN ep END, mkt) OVER p + regr_slope(CASE WHEN mkt IS NOT NULL THEN ep END, mkt) OVER p * mkt) AS ep,
       dy - (regr_intercept(dy, mkt) OVER p + regr_slope(dy, mkt) OVER p * mkt) AS dy, size, nim, fiy
       FROM zscores z LEFT JOIN qbeta q ON z.stock_id = q.stock_id AND z.period = q.q WINDOW p AS (PARTITION BY z.period)""")
define("fwd", "SELECT stock_id, period, fwd1, fwd2, mcap_usd FROM forward")
define("icser", """WITH l AS (SELECT stock_id, period, unnest(['ep', 'dy', 'size']) AS factor, unnest([ep, dy, size]) AS score FROM zscores),
       f AS (SELECT stock_id, period, unnest([1, 2]) AS lag, unnest([fwd1, fwd2]) AS fwd FROM fwd),
       b AS (SELECT l.period, factor, lag, score, fwd FROM l JOIN f ON l.stock_id = f.stock_id AND l.period = f.period WHERE score IS NOT NULL AND fwd IS NOT NULL),
       k AS (SELECT *, rank() OVER (PARTITION BY period, factor, lag ORDER BY score) + (count(*) OVER (PARTITION BY period, factor, lag, score) - 1) / 2.0 AS a,
                    rank() OVER (PARTITION BY period, factor, lag ORDER BY fwd) + (count(*) OVER (PARTITION BY period, factor, lag, fwd) - 1) / 2.0 AS c FROM b)
       SELECT period, factor, lag, covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) AS ic, count(*) AS n FROM k GROUP BY 1, 2, 3""")
define("fmcoef", """WITH m AS (SELECT z.period, count(*) AS n, var_samp(ep) AS aa, var_samp(size) AS bb, covar_samp(ep, size) AS ab, covar_samp(fwd1, ep) AS ya, covar_samp(fwd1, size) AS yb, avg(fwd1) AS my, avg(ep) AS ma, avg(size) AS mb
       FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period WHERE fwd1 IS NOT NULL AND ep IS NOT NULL AND size IS NOT NULL GROUP BY 1)
       SELECT period, n, my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * ma - (yb * aa - ya * ab) / (aa * bb - ab * ab) * mb AS const,
              (ya * bb - yb * ab) / (aa * bb - ab * ab) AS ep, (yb * aa - ya * ab) / (aa * bb - ab * ab) AS size FROM m WHERE n >= 8""")
define("premia", "SELECT period, unnest(['ep', 'size']) AS factor, unnest([ep, size]) AS coef FROM fmcoef")
_PAIRS = [("dy", "ep"), ("dy", "fiy"), ("dy", "nim"), ("dy", "size"), ("ep", "fiy"), ("ep", "nim"), ("ep", "size"), ("fiy", "nim"), ("fiy", "size"), ("nim", "size")]
define("avgcorr", " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, avg(c) AS avg_corr, coalesce(abs(avg(c)) > 0.3, false) AS redundant FROM (SELECT covar_samp({a}, {b}) / nullif(stddev_samp({a}) FILTER ({b} IS NOT NULL) * stddev_samp({b}) FILTER ({a} IS NOT NULL), 0) AS c FROM zscores GROUP BY period)"
    for a, b in _PAIRS))


@query("SELECT stock_id, period, ep, dy FROM resid", "ep dy", 5)
def v1_residuals(spark, d):
    rows = zscores(spark, d).join(quarter_beta(spark, d), ["stock_id", "period"], "left")
    return regress.residuals(rows, ["period"], ["ep", "dy"], ["mkt"]).select("stock_id", "period", "ep", "dy")


_ALL = {"ep": "true", "dy": "true"}


@query(f"SELECT stock_id, period, ep, dy FROM ({_reg_sql('resid', _ALL)[2]})", "ep dy", 4)
def v2_neutralize(spark, d):
    rows = zscores(spark, d).join(quarter_beta(spark, d), ["stock_id", "period"], "left")
    rows = regress.residuals(rows, ["period"], ["ep", "dy"], ["mkt"])
    return w.regularize(rows, {"ep": F.lit(True), "dy": F.lit(True)}).select("stock_id", "period", "ep", "dy")


@query("SELECT period, factor, lag, ic, n FROM icser", "ic")
def v3_rank_ic(spark, d):
    return validate.rank_ic(zscores(spark, d), forward(spark, d), STYLE, (1, 2))


@query("SELECT factor, lag, avg(ic) AS mean_ic, avg(ic) / nullif(stddev_samp(ic), 0) AS ir, count(ic) AS n FROM icser GROUP BY 1, 2", "mean_ic ir")
def v4_information_ratio(spark, d):
    return validate.information_ratio(validate.rank_ic(zscores(spark, d), forward(spark, d), STYLE, (1, 2)))


@query("SELECT factor, lag, avg(ic) AS mean_ic FROM icser GROUP BY 1, 2", "mean_ic")
def v5_ic_decay(spark, d):
    return validate.information_ratio(validate.rank_ic(zscores(spark, d), forward(spark, d), STYLE, (1, 2))).select("factor", "lag", "mean_ic")


@query("""WITH l AS (SELECT stock_id, period, unnest(['ep', 'dy', 'size']) AS factor, unnest([ep, dy, size]) AS score FROM zscores),
          b AS (SELECT l.period, factor, fwd1, mcap_usd, (row_number() OVER o - 1) * 5 // count(*) OVER (PARTITION BY l.period, factor) + 1 AS bucket
                FROM l JOIN fwd ON l.stock_id = fwd.stock_id AND l.period = fwd.period WHERE score IS NOT NULL AND fwd1 IS NOT NULL WINDOW o AS (PARTITION BY l.period, factor ORDER BY score, l.stock_id)),
          r AS (SELECT period, factor, bucket, sum(fwd1 * mcap_usd) / nullif(sum(mcap_usd), 0) AS r FROM b GROUP BY 1, 2, 3)
          SELECT factor, bucket::bigint AS bucket, avg(r) AS mean, stddev_samp(r) AS std, count(r) AS n_periods FROM r GROUP BY 1, 2""", "mean std")
def v6_quantile_returns(spark, d):
    return validate.quantile_returns(zscores(spark, d), forward(spark, d), STYLE, 5, "mcap_usd")


def fm_coefs(spark, d) -> DataFrame:
    return validate.fama_macbeth(design(spark, d), "fwd1", ["ep", "size"], least=8).where("n >= 8")


@query("SELECT period, n, const, ep, size FROM fmcoef", "const ep size", 5)
def v7_fama_macbeth(spark, d):
    return fm_coefs(spark, d)


_NW = """WITH s AS (SELECT factor, row_number() OVER (PARTITION BY factor ORDER BY period) AS t, count(*) OVER (PARTITION BY factor) AS n, coef, avg(coef) OVER (PARTITION BY factor) AS m FROM premia WHERE coef IS NOT NULL),
 e AS (SELECT *, coef - m AS e, least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9)), 1), n - 1) AS L FROM s),
 g AS (SELECT a.factor, sum(CASE WHEN a.t = b.t THEN 1 ELSE 2 * (1 - (a.t - b.t) / (a.L + 1)) END * a.e * b.e) AS g, any_value(a.n) AS n, any_value(a.m) AS m FROM e a JOIN e b ON a.factor = b.factor AND b.t <= a.t AND b.t >= a.t - a.L GROUP BY 1)
 SELECT factor, m AS mean_coef, sqrt(greatest(g, 0)) / n AS nw_se, m / nullif(sqrt(greatest(g, 0)) / n, 0) AS t_stat, n AS n_periods FROM g"""


@query(_NW, "mean_coef nw_se t_stat", 5)
def v8_newey_west(spark, d):
    return validate.newey_west(validate.premia(fm_coefs(spark, d), ["ep", "size"]), ["factor"])


def _ols_sql(src: str, keys: str, y: str, xs: list[str], least: int, const: bool = True) -> str:
    """Least squares by group in plain SQL: moment sums, then one elimination step for each regressor, each a table of its own."""
    names = (["1.0::double"] if const else []) + xs
    k = len(names)
    known = " AND ".join(f"{x} IS NOT NULL" for x in [y, *xs])
    cell = lambda i, j: f"sum({names[i]} * {names[j] if j < k else y}) AS m{i}_{j}"
    steps = [f"s0 AS (SELECT {keys}, count(*) AS n, {', '.join(cell(i, j) for i in range(k) for j in range(k + 1))} FROM ({src}) WHERE {known} GROUP BY {keys} HAVING count(*) >= {least})"]
    for p in range(k):
        row = lambda j, p=p: f"m{p}_{j} / m{p}_{p}"
        out = [f"{row(j) if i == p else f'm{i}_{j} - m{i}_{p} * {row(j)}'} AS m{i}_{j}" for i in range(k) for j in range(p + 1, k + 1)]
        steps.append(f"s{p + 1} AS (SELECT {keys}, n, {', '.join(out)} FROM s{p})")
    betas = ", ".join(f"m{i}_{k} AS {x}" for i, x in enumerate((["const"] if const else []) + xs))
    return f"WITH {', '.join(steps)} SELECT {keys}, n, {betas} FROM s{k}"


FIVE = ["ep", "dy", "size", "nim", "fiy"]
define("pooled", """SELECT z.stock_id, z.period, fwd1, ep, dy, size, CASE WHEN starts_with(industry, 'bank') THEN nim ELSE 0 END AS nim, CASE WHEN starts_with(industry, 'insurance') THEN fiy ELSE 0 END AS fiy
       FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period""")
define("pooledprem", f"SELECT period, unnest(['ep', 'dy', 'size', 'nim', 'fiy']) AS factor, unnest([ep, dy, size, nim, fiy]) AS coef FROM ({_ols_sql('SELECT * FROM pooled', 'period', 'fwd1', FIVE, 6)})")


@query(_NW.replace("premia", "pooledprem"), "mean_coef nw_se t_stat", 4)
def v9_pooled_fama_macbeth(spark, d):
    rows = validate.pooled_design(design(spark, d), masks())
    return validate.newey_west(validate.premia(validate.fama_macbeth(rows, "fwd1", FIVE), FIVE), ["factor"])


@query("""WITH m AS (SELECT z.stock_id, z.period, ep, size, mkt FROM zscores z JOIN qbeta q ON z.stock_id = q.stock_id AND z.period = q.q WHERE mkt IS NOT NULL AND ep IS NOT NULL AND size IS NOT NULL),
          s AS (SELECT period, avg(ep) AS my, avg(mkt) AS ma, avg(size) AS mb, var_pop(mkt) AS aa, var_pop(size) AS bb, covar_pop(mkt, size) AS ab, covar_pop(ep, mkt) AS ya, covar_pop(ep, size) AS yb, count(*) AS n FROM m GROUP BY 1)
          SELECT stock_id, m.period, ep - my - (ya * bb - yb * ab) / (aa * bb - ab * ab) * (mkt - ma) - (yb * aa - ya * ab) / (aa * bb - ab * ab) * (size - mb) AS ep FROM m JOIN s USING (period) WHERE n >= 8""", "ep", 5)
def p13_design_residuals(spark, d):
    loadings = quarter_beta(spark, d).join(zscores(spark, d).select("stock_id", "period", "size"), ["stock_id", "period"])
    names = regress.design_columns(loadings)
    rows = zscores(spark, d).select("stock_id", "period", "ep").join(loadings, ["stock_id", "period"]).dropna(subset=["ep", *names])
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy("period"))).where("n >= 8")
    return regress.residuals(rows, ["period"], ["ep"], names).select("stock_id", "period", "ep")


@query("SELECT period, factor, coef FROM premia", "coef", 5)
def v10_premia(spark, d):
    return validate.premia(fm_coefs(spark, d), ["ep", "size"])


@query("SELECT a, b, avg_corr, redundant FROM avgcorr", "avg_corr")
def v11_average_correlation(spark, d):
    return validate.average_correlation(zscores(spark, d), ["ep", "dy", "size", "nim", "fiy"], 0.3)


define("edges", "SELECT a, b FROM avgcorr WHERE redundant UNION ALL SELECT b, a FROM avgcorr WHERE redundant")
_REACH = "WITH RECURSIVE reach AS (SELECT f AS node, f AS hit FROM (VALUES ('ep'), ('dy'), ('size'), ('nim'), ('fiy')) v(f) UNION SELECT node, e.b FROM reach JOIN edges e ON e.a = reach.hit) SELECT node, min(hit) AS cluster FROM reach GROUP BY node"


def factor_clusters(spark, d) -> DataFrame:
    pairs = validate.average_correlation(zscores(spark, d), ["ep", "dy", "size", "nim", "fiy"], 0.3).where("redundant")
    nodes = spark.createDataFrame([(x,) for x in ("ep", "dy", "size", "nim", "fiy")], "node string")
    return validate.clusters(nodes, pairs)


@query(_REACH)
def v12_clusters(spark, d):
    return factor_clusters(spark, d)


@query(f"""WITH c AS ({_REACH}), m AS (SELECT cluster, node AS factor, mean_coef IS NOT NULL AS has, abs(mean_coef) AS v FROM c LEFT JOIN ({_NW}) n ON n.factor = c.node)
           SELECT cluster, factor FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY has DESC, v DESC NULLS LAST, factor) = 1""")
def v13_representatives(spark, d):
    stats = validate.newey_west(validate.premia(fm_coefs(spark, d), ["ep", "size"]), ["factor"]).select(F.col("factor").alias("node"), "mean_coef")
    members = factor_clusters(spark, d).join(stats, "node", "left").select("cluster", F.col("node").alias("factor"), F.col("mean_coef").isNotNull().alias("has"), "mean_coef")
    return validate.representatives(members, "has", "mean_coef")


@query(f"""WITH c AS ({_REACH}), i AS (SELECT factor, avg(ic) / nullif(stddev_samp(ic), 0) AS ir FROM icser WHERE lag = 1 GROUP BY 1), m AS (SELECT cluster, node AS factor, ir FROM c LEFT JOIN i ON i.factor = c.node)
           SELECT cluster, factor FROM m QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY ir IS NOT NULL DESC, abs(ir) DESC NULLS LAST, factor) = 1""")
def v13_best_ir(spark, d):
    ir = validate.information_ratio(validate.rank_ic(zscores(spark, d), forward(spark, d), STYLE, (1,))).select(F.col("factor").alias("node"), "ir")
    members = factor_clusters(spark, d).join(ir, "node", "left").select("cluster", F.col("node").alias("factor"), "ir")
    return validate.best_ir(members)


def lasso_panel(spark, d) -> DataFrame:
    rows = validate.pooled_design(design(spark, d), masks())
    return rows.withColumn("sub_universe", F.when(F.col("industry") == "bank", "bank").otherwise("insurance"))


def _lasso_sql(src: str, by: str, xs: list[str], y: str, folds: int = 5, n_alphas: int = 50, sweeps: int = 250) -> str:
    """The cross-validated lasso by coordinate descent on moment sums: all groups, folds and penalties side by side, far past convergence."""
    k = len(xs)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    known = " AND ".join(f"{c} IS NOT NULL" for c in [*xs, y])
    sums = ["n", "sy", "yy", *[f"s{i}" for i in range(k)], *[f"c{i}" for i in range(k)], *[f"q{i}{j}" for i, j in pairs]]
    raw = f"count(*) AS n, sum({y}) AS sy, sum({y} * {y}) AS yy, {', '.join(f'sum({x}) AS s{i}, sum({x} * {y}) AS c{i}' for i, x in enumerate(xs))}, {', '.join(f'sum({xs[i]} * {xs[j]}) AS q{i}{j}' for i, j in pairs)}"
    added = ", ".join(f"sum({c}) AS {c}" for c in sums)
    g = lambda i, j: f"g{min(i, j)}{max(i, j)}"
    soft = lambda j, w: f"sign(h{j} - ({' + '.join(f'{g(i, j)} * {w[i]}' for i in range(k) if i != j)})) * greatest(abs(h{j} - ({' + '.join(f'{g(i, j)} * {w[i]}' for i in range(k) if i != j)})) - alpha, 0) / nullif({g(j, j)}, 0)"
    state = ", ".join([by, "run", "a", "alpha", *[f"h{i}" for i in range(k)], *[g(i, j) for i, j in pairs]])
    step = f"SELECT {state}, step, {', '.join(f'w{i}' for i in range(k))} FROM it WHERE step < {sweeps}"
    for j in range(k):  # one coordinate after the other
        step = f"SELECT * REPLACE (coalesce({soft(j, [f'w{i}' for i in range(k)])}, 0) AS w{j}) FROM ({step})"
    beta = [f"(w{i} / d{i})" for i in range(k)]
    inner = " + ".join(f"{beta[i]} * t.c{i}" for i in range(k))
    square = " + ".join(f"{1 if i == j else 2} * {beta[i]} * {beta[j]} * t.q{i}{j}" for i, j in pairs)
    line = " + ".join(f"{beta[i]} * t.s{i}" for i in range(k))
    return f"""WITH RECURSIVE p AS (SELECT {by}, period, row_number() OVER (PARTITION BY {by} ORDER BY period) AS k, count(*) OVER (PARTITION BY {by}) AS periods, * EXCLUDE ({by}, period) FROM (SELECT {by}, period, {raw} FROM ({src}) WHERE {known} GROUP BY 1, 2)),
      f AS (SELECT unnest(generate_series(-1, {folds - 1})) AS run), c AS (SELECT DISTINCT {by}, periods, run, CASE WHEN run < 0 THEN periods ELSE periods - ({folds} - run) * (periods // {folds + 1}) END AS cut, periods // {folds + 1} AS size FROM p, f),
      m AS (SELECT c.{by}, run, {added} FROM c JOIN p ON p.{by} = c.{by} AND p.k <= c.cut GROUP BY ALL), t AS (SELECT c.{by}, run, {added} FROM c JOIN p ON p.{by} = c.{by} AND p.k > c.cut AND p.k <= c.cut + c.size WHERE run >= 0 GROUP BY ALL),
      d AS (SELECT {by}, {', '.join(f'CASE WHEN q{i}{i} > 0 THEN sqrt(q{i}{i} / n - (s{i} / n) ** 2) ELSE 1 END AS d{i}' for i in range(k))} FROM m WHERE run < 0),
      z AS (SELECT m.{by}, run, {', '.join(f'(c{i} / n - s{i} / n * sy / n) / d{i} AS h{i}' for i in range(k))}, {', '.join(f'(q{i}{j} / n - s{i} / n * s{j} / n) / (d{i} * d{j}) AS {g(i, j)}' for i, j in pairs)} FROM m JOIN d ON d.{by} = m.{by}),
      o AS (SELECT {by}, greatest({', '.join(f'abs(h{i})' for i in range(k))}) AS top FROM z WHERE run < 0), a AS (SELECT {by}, unnest(generate_series(0, {n_alphas - 1})) AS a, top FROM o),
      it AS (SELECT {', '.join(['z.' + by, 'run', 'a', f'top * pow(1e-3, a / {n_alphas - 1}.0) AS alpha', *[f'h{i}' for i in range(k)], *[g(i, j) for i, j in pairs]])}, 0 AS step, {', '.join(f'0.0::double AS w{i}' for i in range(k))} FROM z JOIN a ON a.{by} = z.{by}
             UNION ALL SELECT * REPLACE (step + 1 AS step) FROM ({step})),
      w AS (SELECT * FROM it WHERE step = {sweeps}),
      e AS (SELECT w.{by}, w.a, sum((t.yy - 2 * (b0 * t.sy + {inner}) + t.n * b0 * b0 + 2 * b0 * ({line}) + {square}) / greatest(t.n, 1)) AS err
            FROM (SELECT w.*, {', '.join(f'd{i}' for i in range(k))}, (m.sy - ({' + '.join(f'{beta[i]} * m.s{i}' for i in range(k))})) / m.n AS b0 FROM w JOIN d ON d.{by} = w.{by} JOIN m ON m.{by} = w.{by} AND m.run = w.run WHERE w.run >= 0) w JOIN t ON t.{by} = w.{by} AND t.run = w.run GROUP BY 1, 2),
      b AS (SELECT {by}, arg_min(a, err) AS a FROM e GROUP BY 1)
      SELECT w.{by}, unnest([{', '.join(f"'{x}'" for x in xs)}]) AS factor, unnest([{', '.join(f'w{i}' for i in range(k))}]) AS coef FROM w JOIN b ON b.{by} = w.{by} AND b.a = w.a WHERE w.run < 0"""


_LASSO_ROWS = "SELECT CASE WHEN industry = 'bank' THEN 'bank' ELSE 'insurance' END AS sub_universe, z.period, ep, dy, size, fwd1 FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period"


@query(f"SELECT *, abs(coef) > 1e-5 AS selected FROM ({_lasso_sql(_LASSO_ROWS, 'sub_universe', STYLE, 'fwd1')})", "coef", 7)
def v15_lasso(spark, d):
    return validate.lasso_select(lasso_panel(spark, d), "fwd1", STYLE)


def cutoffs(spark) -> DataFrame:
    return schedule(spark, "1998-01-01", "2001-10-01", 12)


def schedule(spark, first: str, last: str, months: int) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval {months} months)) AS cutoff")


def scorecard(spark, d, train: int = 60) -> DataFrame:
    """The three-step selection over all style factors and the market beta, which bypasses the lasso, at each cutoff."""
    z, fwd, cut = zscores(spark, d), forward(spark, d), cutoffs(spark)
    pairs = validate.average_correlation(w.fill_median(z, masks()), FIVE, 0.3, cut, train).where("redundant").select("cutoff", "a", "b")
    both = z.join(quarter_beta(spark, d).select("stock_id", "period", F.col("mkt").alias("beta")), ["stock_id", "period"], "left")
    ic = validate.rank_ic(both, fwd, [*FIVE, "beta"], (1,))
    panel = materialize(lasso_panel(spark, d), "selection-panel")
    coefs = validate.premia(validate.fama_macbeth(panel, "fwd1", FIVE), FIVE)
    return validate.select_factors(ic, coefs, cut, pairs, 0.1, 1.0, panel, "fwd1", FIVE, 3, train)


_CUTS = "SELECT unnest(generate_series(DATE '1998-01-01', DATE '2001-10-01', INTERVAL 12 MONTH))::date AS cutoff"
_SIX = [*FIVE, "beta"]
_SEEN = "period + INTERVAL 3 MONTH <= cutoff AND period > cutoff - INTERVAL 60 MONTH"
_BANK, _INSURER = "starts_with(industry, 'bank')", "starts_with(industry, 'insurance')"
define("icsix", f"""WITH l AS (SELECT z.stock_id, z.period, unnest([{', '.join(f"'{f}'" for f in _SIX)}]) AS factor, unnest([{', '.join(FIVE)}, mkt]) AS score FROM zscores z LEFT JOIN qbeta q ON z.stock_id = q.stock_id AND z.period = q.q),
  b AS (SELECT l.period, factor, score, fwd1 AS fwd FROM l JOIN fwd ON l.stock_id = fwd.stock_id AND l.period = fwd.period WHERE score IS NOT NULL AND fwd1 IS NOT NULL),
  k AS (SELECT *, rank() OVER (PARTITION BY period, factor ORDER BY score) + (count(*) OVER (PARTITION BY period, factor, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY period, factor ORDER BY fwd) + (count(*) OVER (PARTITION BY period, factor, fwd) - 1) / 2.0 AS c FROM b)
  SELECT period, factor, covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) AS ic FROM k GROUP BY 1, 2""")
define("zfilled", f"""SELECT period, {', '.join(f'coalesce({c}, median({c}) OVER p) AS {c}' for c in STYLE)}, CASE WHEN {_BANK} THEN coalesce(nim, median(CASE WHEN {_BANK} THEN nim END) OVER p) END AS nim,
  CASE WHEN {_INSURER} THEN coalesce(fiy, median(CASE WHEN {_INSURER} THEN fiy END) OVER p) END AS fiy FROM zscores WINDOW p AS (PARTITION BY period)""")
define("seenpairs", f"WITH c AS ({_CUTS}), " + "x AS (" + " UNION ALL ".join(
    f"SELECT period, '{a}' AS a, '{b}' AS b, covar_samp({a}, {b}) / nullif(stddev_samp({a}) FILTER ({b} IS NOT NULL) * stddev_samp({b}) FILTER ({a} IS NOT NULL), 0) AS r FROM zfilled GROUP BY period" for a, b in _PAIRS)
    + ") SELECT cutoff, a, b FROM x JOIN c ON period <= cutoff AND period > cutoff - INTERVAL 60 MONTH GROUP BY ALL HAVING abs(avg(r)) > 0.3")
define("seenprem", f"SELECT period, cutoff::varchar || '/' || factor AS factor, coef FROM pooledprem JOIN ({_CUTS}) ON {_SEEN}")
define("gatecards", f"""WITH i AS (SELECT cutoff, factor, avg(ic) / nullif(stddev_samp(ic), 0) AS ir_lag1 FROM icsix JOIN ({_CUTS}) ON {_SEEN} GROUP BY 1, 2),
  t AS (SELECT split_part(factor, '/', 1)::date AS cutoff, split_part(factor, '/', 2) AS factor, t_stat AS fm_t, mean_coef AS fm_coef FROM ({_NW.replace('premia', 'seenprem')}))
  SELECT cutoff, factor, ir_lag1, fm_t, fm_coef, coalesce(abs(ir_lag1) >= 0.1, false) OR coalesce(abs(fm_t) >= 1, false) AS passed FROM i FULL JOIN t USING (cutoff, factor)""")
define("cardclusters", """WITH RECURSIVE n AS (SELECT cutoff, factor FROM gatecards WHERE passed), e AS (SELECT cutoff, a, b FROM seenpairs UNION ALL SELECT cutoff, b, a FROM seenpairs),
  r AS (SELECT cutoff, factor, factor AS hit FROM n UNION SELECT r.cutoff, r.factor, e.b FROM r JOIN e ON e.cutoff = r.cutoff AND e.a = r.hit JOIN n ON n.cutoff = e.cutoff AND n.factor = e.b)
  SELECT cutoff, factor, min(hit) AS cluster FROM r GROUP BY 1, 2""")
define("cardreps", """SELECT *, row_number() OVER (PARTITION BY cutoff, cluster ORDER BY fm_coef IS NOT NULL DESC, abs(coalesce(fm_coef, ir_lag1)) DESC NULLS LAST, factor) = 1 AS representative FROM cardclusters JOIN gatecards USING (cutoff, factor)""")
_ENTERED = f"representative AND factor IN ({', '.join(repr(f) for f in FIVE)})"
define("lassorows", f"""WITH s AS (SELECT cutoff, {', '.join(f"bool_or(factor = '{f}') AS s_{f}" for f in FIVE)} FROM cardreps WHERE {_ENTERED} GROUP BY 1)
  SELECT cutoff::varchar || '/' || CASE WHEN industry = 'bank' THEN 'bank' ELSE 'insurance' END AS grp, p.period, fwd1, {', '.join(f'CASE WHEN s_{f} THEN {f} ELSE 0.0::double END AS {f}' for f in FIVE)}
  FROM (SELECT z.period, industry, fwd1, ep, dy, size, CASE WHEN {_BANK} THEN nim ELSE 0 END AS nim, CASE WHEN {_INSURER} THEN fiy ELSE 0 END AS fiy FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period) p JOIN s ON {_SEEN}""")
define("survivors", f"SELECT DISTINCT split_part(grp, '/', 1)::date AS cutoff, factor FROM ({_lasso_sql('SELECT * FROM lassorows', 'grp', FIVE, 'fwd1')}) WHERE abs(coef) > 1e-5")
define("selectioncard", f"""WITH x AS (SELECT g.*, cluster, coalesce(representative, false) AS representative FROM gatecards g LEFT JOIN (SELECT cutoff, factor, cluster, representative FROM cardreps) c USING (cutoff, factor)),
  y AS (SELECT x.*, CASE WHEN {_ENTERED} THEN s.factor IS NOT NULL END AS lasso FROM x LEFT JOIN survivors s ON s.cutoff = x.cutoff AND s.factor = x.factor)
  SELECT *, representative AND coalesce(lasso, true) AS selected FROM y""".replace(_ENTERED, _ENTERED.replace("factor IN", "x.factor IN")))


@query("SELECT * REPLACE (lasso::varchar AS lasso), row_number() OVER (PARTITION BY cutoff ORDER BY selected DESC NULLS LAST, abs(ir_lag1) DESC NULLS LAST, abs(fm_t) DESC NULLS LAST, factor) AS place FROM selectioncard", "ir_lag1 fm_t fm_coef", 4)
def v16_selection(spark, d):
    return validate.scorecard_order(scorecard(spark, d)).withColumn("lasso", F.col("lasso").cast("string"))


def _swept_sql(src: str, columns: list[str], rounds: int = 120) -> str:
    """Both fixed effects swept out by turns, far past convergence."""
    by = lambda key: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY {key}) AS {c}" for c in columns)
    return f"""WITH RECURSIVE it AS (SELECT 0 AS step, stock_id, period, {", ".join(columns)} FROM ({src}) UNION ALL
       SELECT step + 1, stock_id, period, {by("period")} FROM (SELECT step, stock_id, period, {by("stock_id")} FROM it WHERE step < {rounds}))
       SELECT stock_id, period, {", ".join(columns)} FROM it WHERE step = {rounds}"""


_DID = "SELECT stock_id, period, ret_wins AS y, (stock_id % 2 = 0 AND period >= DATE '1998-01-01')::int::double AS d FROM periodic WHERE ret_wins IS NOT NULL"


@query(f"""WITH w AS ({_swept_sql(_DID, ["y", "d"])}), o AS (SELECT sum(y * d) / sum(d * d) AS beta, sum(d * d) AS xx, count(*) AS n FROM w),
  c AS (SELECT sum(d * (y - beta * d)) AS g FROM w, o GROUP BY stock_id)
  SELECT any_value(beta) AS beta, sqrt(sum(g * g)) / any_value(xx) AS se, any_value(beta) / (sqrt(sum(g * g)) / any_value(xx)) AS t_stat, any_value(n) AS n FROM c, o""", "beta se t_stat")
def v17_twfe_did(spark, d):
    rows = periodic(spark, d).withColumn("d", ((F.col("stock_id") % 2 == 0) & (F.col("period") >= "1998-01-01")).cast("double"))
    return ec.twfe(rows.select("stock_id", "period", F.col("ret_wins").alias("y"), "d"))


def _solve_sql(src: str, keep: str, k: int) -> str:
    """Solves M z = r in every row of ``src`` (columns m0_0, ..., r0, ...) by elimination; regressors without variation get the row of the identity."""
    steps = [f"e0 AS (SELECT {keep}, {', '.join(f'CASE WHEN m{i}_{i} > 1e-9 THEN m{i}_{i} ELSE 1 END AS m{i}_{i}' if i == j else f'm{i}_{j}' for i in range(k) for j in range(k))}, {', '.join(f'r{i}' for i in range(k))} FROM ({src}))"]
    for p in range(k):
        cells = [f"{f'm{p}_{j} / m{p}_{p}' if i == p else f'm{i}_{j} - m{i}_{p} * m{p}_{j} / m{p}_{p}'} AS m{i}_{j}" for i in range(k) for j in range(p + 1, k)]
        right = [f"{f'r{p} / m{p}_{p}' if i == p else f'r{i} - m{i}_{p} * r{p} / m{p}_{p}'} AS r{i}" for i in range(k)]
        steps.append(f"e{p + 1} AS (SELECT {keep}, {', '.join(cells + right)} FROM e{p})")
    return f"WITH {', '.join(steps)} SELECT {keep}, {', '.join(f'r{i} AS z{i}' for i in range(k))} FROM e{k}"


def _clustered_sql(swept: str, keys: str, y: str, xs: list[str], a: str, b: str) -> tuple[str, str]:
    """Coefficients z0, ... with n, df by design; and each cluster's z: the inverse of X'X times its score vector."""
    k = len(xs)
    cells = ", ".join(f"sum({xs[i]} * {xs[j]}) AS m{i}_{j}" for i in range(k) for j in range(k))
    live = " + ".join(f"(sum({x} * {x}) > 1e-9)::int" for x in xs)
    gram = f"SELECT {keys}, count(*) AS n, count(*) - ({live}) - count(DISTINCT {a}) - count(DISTINCT {b}) + 1 AS df, {cells}, {', '.join(f'sum({x} * {y}) AS r{i}' for i, x in enumerate(xs))} FROM ({swept}) GROUP BY {keys}"
    fit = _solve_sql(gram, f"{keys}, n, df", k)
    resid = f"{y} - ({' + '.join(f'z{i} * {x}' for i, x in enumerate(xs))})"
    scores = f"SELECT {keys}, {a}, {', '.join(f'sum({x} * e) AS r{i}' for i, x in enumerate(xs))} FROM (SELECT *, {resid} AS e FROM ({swept}) JOIN ({fit}) USING ({keys})) GROUP BY {keys}, {a}"
    both = f"SELECT {keys}, {a}, {', '.join(f'm{i}_{j}' for i in range(k) for j in range(k))}, {', '.join(f's.r{i}' for i in range(k))} FROM ({scores}) s JOIN ({gram}) g USING ({keys})"
    return fit, _solve_sql(both, f"{keys}, {a}", k)


def _student_sql(t: str, nu: str) -> str:
    """Two-sided tail of Student's t for whole degrees of freedom, by the finite sums over powers of the cosine."""
    c2, angle = f"({nu} / ({nu} + ({t}) ** 2))", f"atan(abs({t}) / sqrt({nu}))"
    even = f"sin({angle}) * list_sum(list_transform(generate_series(0, ({nu} - 2) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1) - 0.5 * ln(pi()) + k * ln({c2}))))"
    odd = f"2 / pi() * ({angle} + sin({angle}) * cos({angle}) * list_sum(list_transform(generate_series(0, ({nu} - 3) // 2), lambda k: exp(lgamma(k + 1) - lgamma(k + 1.5) + 0.5 * ln(pi()) - ln(2) + k * ln({c2})))))"
    return f"1 - CASE WHEN {nu} % 2 = 0 THEN {even} ELSE {odd} END"


def _f_sql(f: str, a: str, b: str) -> str:
    """Upper tail of F by Simpson's rule over the angle whose squared sine is beta-distributed."""
    top = f"asin(sqrt({b} / ({b} + {a} * ({f}))))"
    body = lambda x: f"2 * exp(lgamma(({a} + {b}) / 2) - lgamma({a} / 2) - lgamma({b} / 2)) * sin({x}) ** ({b} - 1) * cos({x}) ** ({a} - 1)"
    point = f"({top} * k / 4000)"
    return f"{top} / 12000 * list_sum(list_transform(generate_series(0, 4000), lambda k: (CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {body(point)}))"


_COHORTS = {"1997-01-01": [0, 1, 2], "1998-07-01": [3, 4], "1999-07-01": [5]}
_UNITS = " UNION ALL ".join(f"SELECT DATE '{d}' AS cohort, {u}::bigint AS unit, {i} AS slot" for d, us in _COHORTS.items() for i, u in enumerate(us))
define("curveten", CTES["curve"].replace("c_nationkey % 5", "c_nationkey % 10"))
define("curvepanel", f"""SELECT 'nelson_siegel' AS method, date, currency, level, slope FROM ({NS_SQL.replace("FROM curve)", "FROM curveten)")}) UNION ALL
  SELECT 'simple', date, currency, max(CASE WHEN tenor_description = '120M' THEN zero_rate END),
         max(CASE WHEN tenor_description = '24M' THEN zero_rate END) - max(CASE WHEN tenor_description = '120M' THEN zero_rate END) FROM curveten GROUP BY 2, 3""")
define("didrows", f"""WITH u AS ({_UNITS}), f AS (SELECT p.*, c.cohort, slot FROM curvepanel p CROSS JOIN (SELECT DISTINCT cohort FROM u) c LEFT JOIN u ON u.cohort = c.cohort AND u.unit = p.currency
    WHERE (slot IS NOT NULL OR p.currency NOT IN (SELECT unit FROM u)) AND date BETWEEN c.cohort - INTERVAL 24 MONTH AND c.cohort + INTERVAL 24 MONTH)
  SELECT method || '/' || cohort::varchar || '/' || outcome AS design, currency AS stock_id, date AS period, y, {", ".join(f"(coalesce(slot, -1) = {i} AND date >= cohort)::int::double AS x{i}" for i in range(3))}
  FROM (SELECT *, unnest(['level', 'slope']) AS outcome, unnest([level, slope]) AS y FROM f) WHERE y IS NOT NULL""")


def _swept_by_sql(src: str, columns: list[str], rounds: int = 200) -> str:
    by = lambda key: ", ".join(f"{c} - avg({c}) OVER (PARTITION BY design, {key}) AS {c}" for c in columns)
    return f"""WITH RECURSIVE it AS (SELECT 0 AS step, design, stock_id, period, {", ".join(columns)} FROM {src} UNION ALL
       SELECT step + 1, design, stock_id, period, {by("period")} FROM (SELECT step, design, stock_id, period, {by("stock_id")} FROM it WHERE step < {rounds}))
       SELECT design, stock_id, period, {", ".join(columns)} FROM it WHERE step = {rounds}"""


define("didswept", _swept_by_sql("didrows", ["y", "x0", "x1", "x2"]))
_DID_FIT, _DID_Z = _clustered_sql("SELECT * FROM didswept", "design", "y", ["x0", "x1", "x2"], "stock_id", "period")
define("didfit", _DID_FIT)
define("didvar", f"SELECT design, {', '.join(f'sum(z{i} * z{i}) AS v{i}' for i in range(3))} FROM ({_DID_Z}) GROUP BY design")


def curve_panel(spark, d) -> DataFrame:
    """Level and slope by currency and month, by either method of fitting."""
    curve = s.zero_curve(spark, d, 10)
    fitted = [cv.nelson_siegel(curve).select("date", "currency", "level", "slope"), cv.simple_curve(curve)]
    return fitted[0].withColumn("method", F.lit("nelson_siegel")).unionByName(fitted[1].withColumn("method", F.lit("simple")))


@query(f"""WITH u AS ({_UNITS}), e AS (SELECT split_part(design, '/', 1) AS method, split_part(design, '/', 2)::date AS cohort, split_part(design, '/', 3) AS outcome, slot, n, df,
            CASE slot WHEN 0 THEN z0 WHEN 1 THEN z1 ELSE z2 END AS coef, sqrt(CASE slot WHEN 0 THEN v0 WHEN 1 THEN v1 ELSE v2 END * n / df) AS se FROM didfit JOIN didvar USING (design) CROSS JOIN (SELECT unnest([0, 1, 2]) AS slot))
  SELECT method, cohort, outcome, unit AS currency, coef, se, coef / se AS t_stat, {_student_sql("coef / se", "df")} AS p_value, n FROM e JOIN u USING (cohort, slot)""", "coef se t_stat p_value", 5)
def v17_did_by_unit(spark, d):
    return ec.did_by_unit(curve_panel(spark, d), _COHORTS, ["level", "slope"], 24)


define("fwdresid", """SELECT f.stock_id, f.period, mkt, fwd1 - (regr_intercept(fwd1, mkt) OVER p + regr_slope(fwd1, mkt) OVER p * mkt) AS fwd1, fwd2 - (regr_intercept(fwd2, mkt) OVER p + regr_slope(fwd2, mkt) OVER p * mkt) AS fwd2
       FROM fwd f LEFT JOIN qbeta q ON f.stock_id = q.stock_id AND f.period = q.q WINDOW p AS (PARTITION BY f.period)""")


@query("""WITH l AS (SELECT stock_id, period, unnest(['ep', 'dy', 'size']) AS factor, unnest([ep, dy, size]) AS score FROM zscores), f AS (SELECT stock_id, period, unnest([1, 2]) AS lag, unnest([fwd1, fwd2]) AS fwd FROM fwdresid),
          b AS (SELECT l.period, factor, lag, score, round(fwd, 9) AS fwd FROM l JOIN f ON l.stock_id = f.stock_id AND l.period = f.period WHERE score IS NOT NULL AND fwd IS NOT NULL),
          k AS (SELECT *, rank() OVER (PARTITION BY period, factor, lag ORDER BY score) + (count(*) OVER (PARTITION BY period, factor, lag, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY period, factor, lag ORDER BY fwd) + (count(*) OVER (PARTITION BY period, factor, lag, fwd) - 1) / 2.0 AS c FROM b)
          SELECT period, factor, lag, covar_samp(a, c) / nullif(stddev_samp(a) * stddev_samp(c), 0) AS ic, count(*) AS n FROM k GROUP BY 1, 2, 3""", "ic")
def v3_rank_ic_residual(spark, d):
    net = validate.residual_returns(forward(spark, d), quarter_beta(spark, d), ["mkt"], (1, 2))
    return validate.rank_ic(zscores(spark, d), net.withColumns({c: F.round(c, 9) for c in ("fwd1", "fwd2")}), STYLE, (1, 2))


_SECTORS = {"bank": ["nim"], "insurance": ["fiy"]}


def _runs_sql() -> str:
    """Every run's premia as a series, ``factor`` naming run, sub-universe and factor."""
    out = []
    for kind in ("pooled", "legacy"):
        runs = ([("all", FIVE, "SELECT * FROM pooled WHERE true", ["const", *STYLE])] if kind == "pooled" else []) + [
            (sector, [*STYLE, *own], f"SELECT z.period, fwd1, ep, dy, size, nim, fiy FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period WHERE starts_with(industry, '{sector}')", ["const", *([] if kind == "pooled" else STYLE), *own]) for sector, own in _SECTORS.items()]
        for sub, xs, src, told in runs:
            out.append(f"SELECT period, unnest([{', '.join(repr(f'{kind}/{sub}/{x}') for x in told)}]) AS factor, unnest([{', '.join(told)}]) AS coef FROM ({_ols_sql(src, 'period', 'fwd1', xs, len(xs) + 1)})")
    return " UNION ALL ".join(out)


define("runprem", _runs_sql())


@query(f"SELECT split_part(factor, '/', 1) AS run, split_part(factor, '/', 2) AS sub_universe, * REPLACE (split_part(factor, '/', 3) AS factor) FROM ({_NW.replace('premia', 'runprem')})", "mean_coef nw_se t_stat", 4)
def v9_fama_macbeth_runs(spark, d):
    rows = design(spark, d)
    member = {k: F.col("industry").startswith(k) for k in _SECTORS}
    series = [validate.fama_macbeth_runs(rows, "fwd1", STYLE, _SECTORS, member, pooled).withColumn("run", F.lit("pooled" if pooled else "legacy")) for pooled in (True, False)]
    return validate.newey_west(series[0].unionByName(series[1]), ["run", "sub_universe", "factor"])


_STEPS = [k for k in range(-4, 5) if k != -1]
_DUMMY = [f"t{k + 4}" for k in _STEPS]
_REL = "greatest(least(floor(date_diff('day', DATE '1998-01-01', period) / 92), 4), -4)"
_EVENT = f"SELECT stock_id, period, ret_wins AS y, {', '.join(f'(stock_id % 2 = 0 AND {_REL} = {k})::int::double AS {n}' for k, n in zip(_STEPS, _DUMMY, strict=True))} FROM periodic WHERE ret_wins IS NOT NULL"
define("eventswept", f"SELECT 1 AS one, * FROM ({_swept_sql(_EVENT, ['y', *_DUMMY])})")
_EVENT_FIT, _EVENT_Z = _clustered_sql("SELECT * FROM eventswept", "one", "y", _DUMMY, "stock_id", "period")
define("eventfit", _EVENT_FIT)
define("eventz", _EVENT_Z)
_EVENT_VAR = f"SELECT {', '.join(f'sum(z{i} * z{i}) AS v{i}' for i in range(8))} FROM eventz"


@query(f"""SELECT step, effect, se, effect / se AS t_stat, {_student_sql("effect / se", "df")} AS p_value, n FROM (SELECT unnest({_STEPS}) AS step, unnest([{', '.join(f'z{i}' for i in range(8))}]) AS effect,
           unnest([{', '.join(f'sqrt(v{i} * n / df)' for i in range(8))}]) AS se, n, df FROM eventfit, ({_EVENT_VAR}))""", "effect se t_stat p_value", 5)
def v18_event_study(spark, d):
    return ec.event_study(event_panel(spark, d), "1998-01-01", 92, 4)


_PRE = f"SELECT n, df, {', '.join(f'sum(c.z{i} * c.z{j}) * any_value(n) / any_value(df) AS m{i}_{j}' for i in range(3) for j in range(3))}, {', '.join(f'any_value(f.z{i}) AS r{i}, any_value(f.z{i}) AS b{i}' for i in range(3))} FROM eventz c, eventfit f GROUP BY n, df"


@query(f"""WITH w AS (SELECT df, {' + '.join(f'b{i} * z{i}' for i in range(3))} AS wald FROM ({_solve_sql(_PRE, "df, b0, b1, b2", 3)}))
  SELECT wald, 3 AS df1, df AS df2, wald / 3 AS f_stat, {_f_sql("wald / 3", "3.0::double", "df::double")} AS p_value FROM w""", "wald f_stat p_value", 4)
def v18_pre_trend(spark, d):
    return ec.pre_trend(event_panel(spark, d), "1998-01-01", 92, 4)


def event_panel(spark, d) -> DataFrame:
    rows = periodic(spark, d).withColumn("date", F.col("period"))
    return rows.select("stock_id", "period", "date", F.col("ret_wins").alias("y"), (F.col("stock_id") % 2 == 0).alias("treated"))


_BAL = """SELECT stock_id, date_fundamental, (date_fundamental >= DATE '1998-01-01')::int AS post, loan_loss_provision / nullif(net_loans, 0) AS pr, losses / nullif(insurance_premium, 0) AS lr
 FROM (SELECT *, min(date_fundamental) OVER (PARTITION BY stock_id) AS a, max(date_fundamental) OVER (PARTITION BY stock_id) AS b FROM fundamentals) WHERE a < DATE '1998-01-01' AND b >= DATE '1998-01-01'"""


def ratio_panel(spark, d) -> DataFrame:
    rows = ec.balanced(s.fundamentals(spark, d).withColumn("date", F.col("date_fundamental")), "1998-01-01")
    return rows.select("stock_id", "date_fundamental", "post", F.try_divide("loan_loss_provision", "net_loans").alias("pr"), F.try_divide("losses", "insurance_premium").alias("lr"))


@query(f"""WITH b AS (SELECT stock_id, post, abs(pr - avg(pr) OVER (PARTITION BY stock_id, post)) AS y FROM ({_BAL})),
  w AS (SELECT stock_id, post, y - avg(y) OVER (PARTITION BY stock_id) AS y, post - avg(post) OVER (PARTITION BY stock_id) AS x FROM b),
  o AS (SELECT sum(x * y) / sum(x * x) AS beta, sum(x * x) AS xx, count(*) AS n FROM w),
  c AS (SELECT sum(x * (y - beta * x)) AS g FROM w, o GROUP BY stock_id, post)
  SELECT any_value(beta) AS beta, sqrt(sum(g * g)) / any_value(xx) AS se, any_value(beta) / (sqrt(sum(g * g)) / any_value(xx)) AS t_stat, any_value(n) AS n FROM c, o""", "beta se t_stat", 7)
def v19_levene(spark, d):
    return ec.levene(ratio_panel(spark, d), "pr")


@query(_BAL, "pr lr")
def v20_ratio_panels(spark, d):
    return ratio_panel(spark, d)
