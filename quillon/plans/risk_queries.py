"""Queries over the risk model with its intercept, over periods present, and over standardised composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import portfolio as p
from quillon.operators import validate
from quillon.plans.factor_queries import zscores
from quillon.plans.portfolio_queries import _JS
from quillon.plans.registry import query
from quillon.plans.sweep_queries import ic_five
from quillon.plans.validation_queries import design

_SPREAD = "stddev_samp(c) OVER (PARTITION BY period)"


@query(f"""SELECT stock_id, period, CASE WHEN coalesce({_SPREAD}, 0) = 0 THEN 0 ELSE (c - avg(c) OVER (PARTITION BY period)) / {_SPREAD} END AS score
           FROM (SELECT stock_id, period, (coalesce(ep, 0) + coalesce(dy, 0)) / nullif((ep IS NOT NULL)::int + (dy IS NOT NULL)::int, 0) AS c FROM zscores)""", "score")
def v14_composite_standardized(spark, d):
    return validate.composite(zscores(spark, d), ["ep", "dy"], "score").select("stock_id", "period", "score")


@query(f"SELECT period, factor, mean_js AS ic FROM ({_JS.format(t='wficfive')})", "ic", 5)
def r4_walk_forward_ic(spark, d):
    return p.walk_forward_ic(ic_five(spark, d))


NAMES = ["const", "ep", "size"]


def returns(spark, d):
    long, resid = p.factor_returns(design(spark, d), "fwd1", NAMES[1:], 8, const=True)
    return long.where("f is not null"), resid.join(long.where("f is not null").select("period").distinct(), "period", "left_semi")


@query("SELECT period, unnest(['const', 'ep', 'size']) AS factor, unnest([const, ep, size]) AS f FROM fmcoef", "f", 5)
def r7_factor_returns(spark, d):
    return returns(spark, d)[0]


def _covariance_sql(src: str, names: list[str], window: int) -> str:
    """Ledoit-Wolf correlations toward the identity over the last rows of ``src`` (period and one column for each name)."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    square, trace = " + ".join(f"{1 if a == b else 2} * m_{a}_{b} ** 2" for a, b in pairs), " + ".join(f"m_{a}_{a}" for a in names)
    return f"""WITH f AS (SELECT row_number() OVER (ORDER BY period) AS t, * FROM ({src})), s AS (SELECT a.t, a.period AS asof_, b.* EXCLUDE (t, period) FROM f a JOIN f b ON b.t <= a.t AND b.t > a.t - {window}),
      z AS (SELECT t, asof_, {', '.join(f'({a} - avg({a}) OVER w) / nullif(stddev_pop({a}) OVER w, 0) AS z_{a}, var_pop({a}) OVER w AS v_{a}' for a in names)} FROM s WINDOW w AS (PARTITION BY t)),
      m AS (SELECT asof_, count(*) AS n, avg(({' + '.join(f'coalesce(z_{a}, 0) ** 2' for a in names)}) ** 2) AS q, {', '.join(f'coalesce(avg(z_{a} * z_{b}), 0) AS m_{a}_{b}' for a, b in pairs)}, {', '.join(f'any_value(v_{a}) AS v_{a}' for a in names)} FROM z GROUP BY 1 HAVING count(*) > 1),
      d AS (SELECT *, {square} - ({trace}) ** 2 / {len(names)} AS d2, (q - ({square})) / n AS b2 FROM m), e AS (SELECT *, CASE WHEN d2 > 1e-12 THEN least(greatest(b2, 0), d2) / d2 ELSE 0 END AS delta FROM d)
      SELECT asof_ AS period, delta, unnest([{', '.join(f"'{a}'" for a, _ in pairs)}]) AS a, unnest([{', '.join(f"'{b}'" for _, b in pairs)}]) AS b, unnest([{', '.join(f"sqrt(v_{a} * v_{b}) * m_{a}_{b}{'' if a == b else ' * (1 - delta)'}" for a, b in pairs)}]) AS cov FROM e"""


@query(_covariance_sql("SELECT period, const, ep, size FROM fmcoef", NAMES, 12), "delta cov", 7)
def r8_covariance_with_const(spark, d):
    return p.present_covariance(returns(spark, d)[0], NAMES, 12)


@query("""SELECT stock_id, period, CASE WHEN count(resid) OVER w >= 4 THEN var_samp(resid) OVER w END AS idio, count(resid) OVER w AS n FROM (SELECT *, dense_rank() OVER (ORDER BY period) AS k FROM resids WHERE quarter(period) <> 2)
          WINDOW w AS (PARTITION BY stock_id ORDER BY k RANGE BETWEEN 7 PRECEDING AND CURRENT ROW)""", "idio", 7)
def w23_present_periods(spark, d):
    rows = p.present_periods(returns(spark, d)[1].where(F.quarter("period") != 2))  # a calendar with gaps
    return p.idio_variance(rows, 8, 4).join(rows.select("stock_id", "t", "period"), ["stock_id", "t"]).select("stock_id", "period", "idio", "n")
