"""Queries over sliced scans (the forms for long groups) and over bucketed artifacts, held against the same SQL as the plain ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.operators import scans
from quillon.operators import windows as w
from quillon.plans.factor_queries import FILLED_SQL, NAMES, WINSORIZED_SQL, masks, scores, zscores
from quillon.plans.panel_queries import market_daily, monthly, periodic
from quillon.plans.registry import query
from quillon.plans.validation_queries import forward
from quillon.sources.bucketed import save_bucketed

_KEY = "CASE WHEN event_id % 2 = 0 THEN -1 ELSE user_id END"


@query(f"""WITH v AS (SELECT event_id, {_KEY} AS k, ts FROM events WHERE event_type = 'view'), b AS (SELECT {_KEY} AS k, max(event_id) AS buy_id, ts FROM events WHERE event_type = 'purchase' GROUP BY 1, 3)
           SELECT v.event_id, v.k AS user_key, b.buy_id FROM v ASOF LEFT JOIN b ON v.k = b.k AND v.ts >= b.ts""")
def j1_asof_hot_key(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("user_key", F.expr(_KEY).cast("long"))  # one key has half of all rows
    bought = e.where("event_type = 'purchase'").groupBy("user_key", F.col("ts").alias("buy_ts")).agg(F.max("event_id").alias("buy_id"))
    return scans.asof_join_skewed(e.where("event_type = 'view'").select("event_id", "user_key", "ts"), bought, "user_key", "ts", "buy_ts", hot=1000).select("event_id", "user_key", "buy_id")


@query(WINSORIZED_SQL, NAMES)
def w1_winsorize_sliced(spark, d):
    return scans.long_winsorize(scores(spark, d), masks(), 0.01, 0.99)


@query(FILLED_SQL, NAMES)
def w3_fill_median_sliced(spark, d):
    return scans.long_fill_median(scans.long_winsorize(scores(spark, d), masks(), 0.01, 0.99), masks())


@query("SELECT stock_id, period, CASE WHEN ep IS NOT NULL THEN (rank() OVER (PARTITION BY period ORDER BY ep) + (count(*) OVER (PARTITION BY period, ep) - 1) / 2.0) END AS rk FROM scores", "rk")
def w18_average_rank_sliced(spark, d):
    return scans.long_average_rank(scores(spark, d).select("stock_id", "period", "ep"), "ep", ["period"], "rk").select("stock_id", "period", "rk")


@query("SELECT date, curve, curve / max(curve) OVER (ORDER BY date) - 1 AS drawdown FROM (SELECT date, product(1 + r) OVER (ORDER BY date) AS curve FROM mkt_daily)", "curve drawdown", 5)
def w20_drawdown_sliced(spark, d):
    rows = market_daily(spark, d).select("date", F.col("x").alias("r"), F.lit("market").alias("series"))
    return scans.long_drawdown(rows, "r", ["series"], "date").select("date", "curve", "drawdown")


@query("""WITH RECURSIVE q AS (SELECT stock_id, period, mcap_usd AS x, (year(period) * 4 + quarter(period))::bigint AS t FROM periodic),
          e AS (SELECT q.stock_id, q.t, q.period, q.x AS ema FROM q LEFT JOIN q p ON p.stock_id = q.stock_id AND p.t = q.t - 1 WHERE p.t IS NULL
                UNION ALL SELECT q.stock_id, q.t, q.period, 0.5 * e.ema + 0.5 * q.x FROM e JOIN q ON q.stock_id = e.stock_id AND q.t = e.t + 1)
          SELECT stock_id, period, ema FROM e""", "ema", 6)
def w22_ema_sliced(spark, d):
    t = (F.year("period") * 4 + F.quarter("period")).cast("long")
    return scans.long_ema(periodic(spark, d).select("stock_id", "period", "mcap_usd", t.alias("t")), "mcap_usd", ["stock_id"], 0.5).select("stock_id", "period", "ema")


@query("SELECT z.stock_id, z.period, industry, ep, dy, size, fwd1, fwd2 FROM zscores z JOIN fwd ON z.stock_id = fwd.stock_id AND z.period = fwd.period", "ep dy size fwd1 fwd2")
def j12_copartitioned(spark, d):
    z, f = save_bucketed(zscores(spark, d), "zscores", buckets=16), save_bucketed(forward(spark, d), "forward", buckets=16)
    return z.join(f, ["stock_id", "period"]).select("stock_id", "period", "industry", "ep", "dy", "size", "fwd1", "fwd2")


@query("SELECT stock_id, period, beta FROM mktbeta", "beta", 5)
def w13_copartitioned(spark, d):
    return w.rolling_beta(save_bucketed(monthly(spark, d), "monthly", buckets=16)).select("stock_id", "period", "beta")
