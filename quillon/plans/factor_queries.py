"""Queries over windows, curves and factors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import in_universe, period_key, row_mean
from quillon.operators import clean as c
from quillon.operators import computed, curves, factors
from quillon.operators import joins as j
from quillon.operators import windows as w
from quillon.plans.oracle import define
from quillon.plans.panel_queries import cleaned, market_daily, monthly, periodic, sector
from quillon.plans.registry import query
from quillon.sources import surrogate as s
from quillon.sources.shared import artifact

RATIOS = {
    "E/P": ("earnings_ltm", "mcap_local", None), "DY": ("dividend_ltm", "mcap_local", None), "TBV/P": ("book_value - goodwill", "mcap_local", "bank"),
    "PPNR/P": ("operating_income + loan_loss_provision", "mcap_local", "bank"), "NPL Coverage": ("loan_loss_reserve", "nonperforming_loans", "bank"),
    "NPL Ratio": ("nonperforming_loans", "net_loans", "bank"), "PTX/AA": ("interest_expense + operating_expense + loan_loss_provision", "total_assets", "bank"),
    "ER": ("operating_expense", "sales_ltm", "bank"), "ROTCE": ("earnings_ltm", "total_equity - goodwill", "bank"), "B/P": ("book_value", "mcap_local", "insurance"),
    "PI/P": ("insurance_premium", "mcap_local", "insurance"), "RLR": ("insurance_reserves", "total_equity", "insurance"), "FIY": ("investment_income", "insurance_reserves", "insurance"),
    "LA/TR": ("cash_and_st_investments", "insurance_reserves", "insurance"), "ROE": ("earnings_ltm", "total_equity", "insurance"),
    "UWM": ("insurance_premium - losses - underwriting_expense", "insurance_premium", "insurance"),
}
_RATIO_SQL = ", ".join(f"""CASE WHEN {"true" if u is None else f"starts_with(industry, '{u}')"} THEN ({a}) / nullif({b}, 0) END AS "{n}" """ for n, (a, b, u) in RATIOS.items())
_SECTOR_GRID = """SELECT c.*, g.period FROM sector c JOIN (SELECT stock_id, date_trunc('quarter', date)::date AS period, max(date) AS date FROM sector GROUP BY 1, 2) g ON c.stock_id = g.stock_id AND c.date = g.date"""
define("sector_grid", _SECTOR_GRID)
define("scores", """SELECT stock_id, date, period, industry, earnings_ltm / nullif(mcap_local, 0) AS ep, dividend_ltm / nullif(mcap_local, 0) AS dy,
       ln(CASE WHEN mcap_usd > 0 THEN mcap_usd END) AS size, CASE WHEN starts_with(industry, 'bank') THEN net_interest_margin END AS nim,
       CASE WHEN starts_with(industry, 'insurance') THEN investment_income / nullif(insurance_reserves, 0) END AS fiy FROM sector_grid""")
_W = "OVER (PARTITION BY period)"


def _reg_sql(src: str, cols: dict[str, str]) -> tuple[str, str, str]:
    clip = ", ".join(f"CASE WHEN {m} AND {c} IS NOT NULL THEN least(greatest({c}, quantile_cont(CASE WHEN {m} THEN {c} END, 0.01) {_W}), quantile_cont(CASE WHEN {m} THEN {c} END, 0.99) {_W}) END AS {c}" for c, m in cols.items())
    fill = ", ".join(f"CASE WHEN {m} THEN coalesce({c}, median(CASE WHEN {m} THEN {c} END) {_W}) END AS {c}" for c, m in cols.items())
    z = ", ".join(f"CASE WHEN {m} AND {c} IS NOT NULL THEN CASE WHEN stddev_samp(CASE WHEN {m} THEN {c} END) {_W} > 0 THEN ({c} - avg(CASE WHEN {m} THEN {c} END) {_W}) / stddev_samp(CASE WHEN {m} THEN {c} END) {_W} ELSE 0 END END AS {c}" for c, m in cols.items())
    names = "stock_id, date, period, industry"
    a = f"SELECT {names}, {clip} FROM {src}"
    b = f"SELECT {names}, {fill} FROM ({a})"
    return a, b, f"SELECT {names}, {z} FROM ({b})"


_MASKS = {"ep": "true", "dy": "true", "size": "true", "nim": "starts_with(industry, 'bank')", "fiy": "starts_with(industry, 'insurance')"}
WINSORIZED_SQL, FILLED_SQL, _Z = _reg_sql("scores", _MASKS)
define("zscores", _Z)
NAMES = "ep dy size nim fiy"


def scores(spark, d) -> DataFrame:
    return artifact(spark, d, "scores", lambda: make_scores(spark, d))


def sector_grid(spark, d) -> DataFrame:
    """The sector panel's last row of each security and quarter. Rows are picked first, so fundamentals are looked up for them alone."""
    rows = cleaned(spark, d).where("tradeable")
    return j.sector_panel(c.latest_in_period(rows, "stock_id", period_key(F.col("date"), 3), "date"), s.fundamentals(spark, d))


def make_scores(spark, d) -> DataFrame:
    wide = factors.ratio_scores(sector_grid(spark, d), ["E/P", "DY", "ln(MCap)", "NIM", "FIY"]).toDF("stock_id", "date", "industry", "ep", "dy", "size", "nim", "fiy")
    return wide.withColumn("period", period_key(F.col("date"), 3)).select("stock_id", "date", "period", "industry", *NAMES.split())


def masks() -> dict:
    industry = F.col("industry")
    return {"ep": F.lit(True), "dy": F.lit(True), "size": F.lit(True), "nim": in_universe(industry, "bank"), "fiy": in_universe(industry, "insurance")}


def zscores(spark, d) -> DataFrame:
    return artifact(spark, d, "zscores", lambda: w.regularize(scores(spark, d), masks()))


@query(f"SELECT stock_id, date, industry, {_RATIO_SQL}, ln(CASE WHEN mcap_usd > 0 THEN mcap_usd END) AS \"ln(MCap)\", CASE WHEN starts_with(industry, 'bank') THEN tier1_capital_ratio END AS \"T1CR\", CASE WHEN starts_with(industry, 'bank') THEN net_interest_margin END AS \"NIM\" FROM sector_grid")
def f1_ratio_factors(spark, d):
    return factors.ratio_scores(sector_grid(spark, d))


@query(WINSORIZED_SQL, NAMES)
def w1_winsorize(spark, d):
    return w.winsorize(scores(spark, d), masks(), 0.01, 0.99)


@query("""SELECT stock_id, period, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) END AS x FROM (SELECT stock_id, period, ep AS x,
          quantile_cont(ep, 0.05) OVER (PARTITION BY period) AS lo, quantile_cont(ep, 0.95) OVER (PARTITION BY period) AS hi FROM scores)""", "x")
def w2_winsorize_series(spark, d):
    rows = scores(spark, d).select("stock_id", "period", F.col("ep").alias("x"))
    return w.winsorize(rows, {"x": F.lit(True)}, 0.05, 0.95)


@query(FILLED_SQL, NAMES)
def w3_fill_median(spark, d):
    return w.fill_median(w.winsorize(scores(spark, d), masks(), 0.01, 0.99), masks())


@query(_Z, NAMES)
def w5_regularize(spark, d):
    return w.regularize(scores(spark, d), masks())


@query("SELECT stock_id, period, beta - median(beta) OVER (PARTITION BY date_trunc('month', date), industry) AS beta FROM mktbeta", "beta")
def w6_center_by_group(spark, d):
    return w.center_by_group(w.rolling_beta(monthly(spark, d)), "beta", "industry").select("stock_id", "period", "beta")


@query("SELECT stock_id, period, coalesce(b, median(CASE WHEN b <> 0 THEN b END) OVER (PARTITION BY period)) AS b FROM (SELECT stock_id, period, CASE WHEN industry = 'bank' THEN beta ELSE 0 END AS b FROM mktbeta)", "b")
def w7_fill_loading(spark, d):
    rows = w.rolling_beta(monthly(spark, d)).select("stock_id", "period", F.when(F.col("industry") == "bank", F.col("beta")).otherwise(0.0).alias("b"))
    return w.fill_loading(rows, ["b"])


@query("SELECT stock_id, period, fwd1, fwd2 FROM forward", "fwd1 fwd2", 5)
def w8_forward_returns(spark, d):
    return w.forward(periodic(spark, d), "ret_wins", (1, 2)).select("stock_id", "period", "fwd1", "fwd2")


@query("SELECT stock_id, date, CASE WHEN count(excess_return) OVER w >= 252 THEN stddev_samp(excess_return) OVER w END AS vol FROM clean WINDOW w AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)", "vol")
def w10_rolling_vol(spark, d):
    return w.rolling_vol(cleaned(spark, d), "excess_return").select("stock_id", "date", "vol")


@query("""SELECT stock_id, date, CASE WHEN count(x) OVER y >= 189 AND count(x) OVER m >= 10 AND count(x) OVER v >= 126 THEN
            (CASE WHEN min(x) OVER m <= -1 THEN NULL WHEN min(x) OVER y <= -1 THEN -1 ELSE exp(sum(CASE WHEN x > -1 THEN ln(1 + x) END) OVER y - sum(CASE WHEN x > -1 THEN ln(1 + x) END) OVER m) - 1 END)
            / nullif(stddev_samp(x) OVER v, 0) END AS momentum FROM (SELECT stock_id, date, total_return AS x FROM clean)
          WINDOW y AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW), m AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW),
                 v AS (PARTITION BY stock_id ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW)""", "momentum", 5)
def w11_momentum(spark, d):
    return w.momentum(cleaned(spark, d), "total_return").select("stock_id", "date", "momentum")


@query("SELECT stock_id, period, ret - lag(ret) OVER (PARTITION BY stock_id ORDER BY period) AS d_ret FROM monthly", "d_ret")
def w12_difference(spark, d):
    return w.difference(monthly(spark, d), ["ret"]).select("stock_id", "period", "d_ret")


@query("SELECT stock_id, period, date, beta FROM mktbeta", "beta")
def w13_rolling_beta(spark, d):
    return w.rolling_beta(monthly(spark, d)).select("stock_id", "period", "date", "beta")


define("curve_simple", """SELECT date AS period, currency, max(CASE WHEN tenor_description = '120M' THEN zero_rate END) AS level,
       max(CASE WHEN tenor_description = '24M' THEN zero_rate END) - max(CASE WHEN tenor_description = '120M' THEN zero_rate END) AS slope FROM curve GROUP BY 1, 2""")
define("rates_quarterly", """SELECT stock_id, date_trunc('quarter', c.date)::date AS period, max(c.date) AS date, max_by(net_interest_margin, c.date) AS nim,
       max_by(investment_income / nullif(insurance_reserves, 0), c.date) AS fiy, avg(level) AS level, avg(slope) AS slope, max_by(industry, c.date) AS industry
       FROM sector c LEFT JOIN curve_simple k ON date_trunc('month', c.date)::date = k.period AND c.country_code % 5 = k.currency GROUP BY 1, 2""")
define("rates_diff", """SELECT stock_id, period, date, industry, nim - lag(nim) OVER o AS d_nim, fiy - lag(fiy) OVER o AS d_fiy, level - lag(level) OVER o AS d_level, slope - lag(slope) OVER o AS d_slope
       FROM rates_quarterly WINDOW o AS (PARTITION BY stock_id ORDER BY period)""")


def _two_sql(src: str, y: str, rows: int, least: int, keep: str) -> str:
    ok = f"{y} IS NOT NULL AND d_level IS NOT NULL AND d_slope IS NOT NULL"
    win = f"WINDOW w AS (PARTITION BY stock_id ORDER BY period ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW)"
    cov = lambda a, b: f"covar_samp({a}, {b}) OVER w"
    return f"""SELECT {keep}, CASE WHEN n >= {least} AND aa * bb - ab * ab > 1e-12 * aa * bb THEN (ya * bb - yb * ab) / (aa * bb - ab * ab) END AS beta_d_level,
               CASE WHEN n >= {least} AND aa * bb - ab * ab > 1e-12 * aa * bb THEN (yb * aa - ya * ab) / (aa * bb - ab * ab) END AS beta_d_slope
        FROM (SELECT *, count(y) OVER w AS n, {cov("a", "a")} AS aa, {cov("b", "b")} AS bb, {cov("a", "b")} AS ab, {cov("y", "a")} AS ya, {cov("y", "b")} AS yb
              FROM (SELECT *, CASE WHEN {ok} THEN {y} END AS y, CASE WHEN {ok} THEN d_level END AS a, CASE WHEN {ok} THEN d_slope END AS b FROM {src}) {win})"""


def rates_quarterly(spark, d) -> DataFrame:
    return computed.quarterly_rates(cleaned(spark, d).where("tradeable"), s.zero_curve(spark, d), s.fundamentals(spark, d))


@query("SELECT stock_id, period, date, nim, fiy, level, slope FROM rates_quarterly", "nim fiy level slope", 8)
def a8_quarterly_metric(spark, d):
    return rates_quarterly(spark, d).drop("industry")


@query(_two_sql("rates_diff", "d_nim", 12, 6, "stock_id, period"), "beta_d_level beta_d_slope", 4)
def w14_nim_rate_betas(spark, d):
    return computed.metric_rate_betas(rates_quarterly(spark, d), "nim").select("stock_id", "period", "beta_d_level", "beta_d_slope")


@query(f"SELECT stock_id, period, CASE WHEN starts_with(industry, 'insurance') THEN beta_d_level END AS \"FIY~Level\", CASE WHEN starts_with(industry, 'insurance') THEN beta_d_slope END AS \"FIY~Slope\" FROM ({_two_sql('rates_diff', 'd_fiy', 12, 6, 'stock_id, period, industry')})")
def f24_fiy_rate_betas(spark, d):
    own = in_universe(F.col("industry"), "insurance")
    out = computed.metric_rate_betas(rates_quarterly(spark, d), "fiy")
    return out.select("stock_id", "period", F.when(own, F.col("beta_d_level")).alias("FIY~Level"), F.when(own, F.col("beta_d_slope")).alias("FIY~Slope"))


define("monthly_rates", """SELECT m.stock_id, m.period, ret, level - lag(level) OVER o AS d_level, slope - lag(slope) OVER o AS d_slope
       FROM monthly m JOIN securities USING (stock_id) LEFT JOIN curve_simple k ON m.period = k.period AND country_code % 5 = k.currency WINDOW o AS (PARTITION BY stock_id ORDER BY m.period)""")


@query(_two_sql("monthly_rates", "ret", 36, 18, "stock_id, period"), "beta_d_level beta_d_slope", 3)
def f26_return_rate_betas(spark, d):
    rows = monthly(spark, d).join(s.securities(spark, d).select("stock_id", (F.col("country_code") % 5).alias("currency")), "stock_id")
    return computed.return_rate_betas(rows, s.zero_curve(spark, d)).select("stock_id", "period", "beta_d_level", "beta_d_slope")


def _group_sql(group: str, parents: str, extra: str = "") -> str:
    by = f"date{parents}"
    return f"""SELECT * REPLACE (CASE WHEN count(ret) OVER w >= 12 THEN regr_slope(ret, x) OVER w END AS beta) FROM (
        SELECT c.stock_id, date_trunc('month', c.date)::date AS period, max(c.date) AS date, max_by(c.{group}, c.date) AS {group}, product(1 + excess_return) - 1 AS ret, coalesce(product(1 + f.factor), 1) - 1 AS x, 0.0::double AS beta
        FROM clean c LEFT JOIN (SELECT date, {group}, w / m - sum(w) OVER (PARTITION BY {by}) / sum(m) OVER (PARTITION BY {by}) AS factor
             FROM (SELECT {by}, {group}, sum(excess_return * mcap_usd) AS w, sum(mcap_usd) AS m FROM clean {extra} GROUP BY ALL)) f ON c.date = f.date AND c.{group} = f.{group}
        WHERE tradeable GROUP BY 1, 2) WINDOW w AS (PARTITION BY stock_id ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"""


@query(f"SELECT stock_id, period, country_code, beta FROM ({_group_sql('country_code', ', region_code')})", "beta", 4)
def n2_country_beta(spark, d):
    return computed.group_betas(cleaned(spark, d), "country_code", ("region_code",)).select("stock_id", "period", "country_code", "beta")


@query(f"SELECT stock_id, period, industry, beta FROM ({_group_sql('industry', '', 'WHERE tradeable')})", "beta", 4)
def n3_industry_beta(spark, d):
    return computed.group_betas(cleaned(spark, d), "industry", (), True).select("stock_id", "period", "industry", "beta")


def frames(spark, d) -> dict[str, DataFrame]:
    curve = artifact(spark, d, "zero_curve", lambda: s.zero_curve(spark, d))  # a few rows a month from all orders: made once, read by all
    return {"sector": sector(spark, d), "market": cleaned(spark, d), "curve": curve}


_CENTRED = "SELECT stock_id, date, {g}, beta - median(beta) OVER (PARTITION BY date_trunc('month', date), {g}) AS b FROM ({sql})"
_IND = _CENTRED.format(g="industry", sql=_group_sql("industry", "", "WHERE tradeable"))
_CTRY = _CENTRED.format(g="country_code", sql=_group_sql("country_code", ", region_code"))


@query(f"""SELECT stock_id, date, CASE WHEN starts_with(industry, 'bank') THEN b END AS bank, CASE WHEN starts_with(industry, 'insurance') THEN b END AS insurance FROM ({_IND})""", "bank insurance", 4)
def f30_industry_beta_signals(spark, d):
    rows = w.center_by_group(computed.group_betas(cleaned(spark, d), "industry", (), True), "beta", "industry")
    return rows.select("stock_id", "date", *[F.when(in_universe(F.col("industry"), u), F.col("beta")).alias(u) for u in ("bank", "insurance")])


_RATES_J12 = _two_sql("rates_diff", "{y}", 12, 6, "stock_id, date, industry")


@query(f"""SELECT p.stock_id, p.date, p.industry, p.earnings_ltm / nullif(p.mcap_local, 0) AS ep, CASE WHEN starts_with(p.industry, 'bank') THEN p.net_interest_margin END AS nim,
   CASE WHEN count(p.excess_return) OVER v >= 252 THEN stddev_samp(p.excess_return) OVER v END AS trv,
   CASE WHEN starts_with(p.industry, 'bank') THEN n.beta_d_level END AS nim_level, CASE WHEN starts_with(p.industry, 'insurance') THEN f.beta_d_slope END AS fiy_slope,
   r.beta_d_level AS ret_level, m.beta AS beta_mkt, c.b AS beta_ctry, CASE WHEN starts_with(p.industry, 'bank') THEN i.b END AS beta_ind_b
   FROM sector p LEFT JOIN ({_RATES_J12.format(y="d_nim")}) n ON p.stock_id = n.stock_id AND p.date = n.date LEFT JOIN ({_RATES_J12.format(y="d_fiy")}) f ON p.stock_id = f.stock_id AND p.date = f.date
   LEFT JOIN mktbeta m ON p.stock_id = m.stock_id AND p.date = m.date LEFT JOIN ({_CTRY}) c ON p.stock_id = c.stock_id AND p.date = c.date LEFT JOIN ({_IND}) i ON p.stock_id = i.stock_id AND p.date = i.date
   LEFT JOIN (SELECT x.*, y.date FROM ({_two_sql("monthly_rates", "ret", 36, 18, "stock_id, period")}) x JOIN monthly y USING (stock_id, period)) r ON p.stock_id = r.stock_id AND p.date = r.date
   WINDOW v AS (PARTITION BY p.stock_id ORDER BY p.date ROWS BETWEEN 755 PRECEDING AND CURRENT ROW)""", "ep nim trv nim_level fiy_slope ret_level beta_mkt beta_ctry beta_ind_b", 3)
def j12_factor_frame(spark, d):
    names = {"E/P": "ep", "NIM": "nim", "TRV": "trv", "NIM~Level": "nim_level", "FIY~Slope": "fiy_slope", "Ret~Level": "ret_level", "Beta~MKT": "beta_mkt", "Beta~CTRY": "beta_ctry", "Beta~IND (B)": "beta_ind_b"}
    wide = factors.factor_frames(frames(spark, d), list(names))
    return wide.select("stock_id", "date", "industry", *[F.col(f"`{a}`").alias(b) for a, b in names.items()])


@query(f"""SELECT m.stock_id, m.period, m.beta AS "Beta~MKT", n.b AS "Beta~CTRY" FROM mktbeta m JOIN
           (SELECT stock_id, period, beta - median(beta) OVER (PARTITION BY date_trunc('month', date), country_code) AS b FROM ({_group_sql('country_code', ', region_code')})) n USING (stock_id, period)""")
def f28_beta_signals(spark, d):
    mkt = w.rolling_beta(monthly(spark, d)).select("stock_id", "period", F.col("beta").alias("Beta~MKT"))
    own = w.center_by_group(computed.group_betas(cleaned(spark, d), "country_code", ("region_code",)), "beta", "country_code")
    return mkt.join(own.select("stock_id", "period", F.col("beta").alias("Beta~CTRY")), ["stock_id", "period"])


NS_SQL = """WITH pts AS (SELECT date, currency, zero_rate AS y, regexp_extract(tenor_description, '(\\d+)', 1)::double / 12 AS t FROM curve),
 b AS (SELECT date, currency, y, (1 - exp(-t / 2)) / (t / 2) AS p, (1 - exp(-t / 2)) / (t / 2) - exp(-t / 2) AS q FROM pts),
 m AS (SELECT date, currency, count(*) AS n, sum(p) AS sp, sum(q) AS sq, sum(p * p) AS pp, sum(p * q) AS pq, sum(q * q) AS qq, sum(y) AS sy, sum(p * y) AS py, sum(q * y) AS qy FROM b GROUP BY 1, 2 HAVING count(*) >= 3),
 e AS (SELECT *, n * (pp * qq - pq * pq) - sp * (sp * qq - pq * sq) + sq * (sp * pq - pp * sq) AS det FROM m)
 SELECT date, currency, n AS n_points, (sy * (pp * qq - pq * pq) - sp * (py * qq - pq * qy) + sq * (py * pq - pp * qy)) / nullif(det, 0) AS level,
   (n * (py * qq - pq * qy) - sy * (sp * qq - pq * sq) + sq * (sp * qy - py * sq)) / nullif(det, 0) AS slope,
   (n * (pp * qy - py * pq) - sp * (sp * qy - py * sq) + sy * (sp * pq - pp * sq)) / nullif(det, 0) AS curvature FROM e"""


@query(NS_SQL, "level slope curvature", 4)
def n4_nelson_siegel(spark, d):
    return curves.nelson_siegel(s.zero_curve(spark, d))


@query("SELECT period AS date, currency, level, slope FROM curve_simple", "level slope", 7)
def n5_simple_curve(spark, d):
    return curves.simple_curve(s.zero_curve(spark, d))


@query(f"""SELECT c.date, c.currency, sqrt(avg((zero_rate - f) ** 2)) AS rmse, max(abs(zero_rate - f)) AS worst FROM (SELECT k.date, k.currency, zero_rate,
           level + slope * (1 - exp(-t / 2)) / (t / 2) + curvature * ((1 - exp(-t / 2)) / (t / 2) - exp(-t / 2)) AS f
           FROM (SELECT *, regexp_extract(tenor_description, '(\\d+)', 1)::double / 12 AS t FROM curve) k JOIN ({NS_SQL}) n USING (date, currency)) c GROUP BY 1, 2""", "rmse worst")
def n7_curve_fit(spark, d):
    curve = s.zero_curve(spark, d)
    return curves.ns_residuals(curve, curves.nelson_siegel(curve))


@query("SELECT stock_id, period, (rank() OVER (PARTITION BY period ORDER BY ep) + (count(*) OVER (PARTITION BY period, ep) - 1) / 2.0) AS rk FROM scores WHERE ep IS NOT NULL", "rk")
def w18_average_rank(spark, d):
    return w.average_rank(scores(spark, d).where("ep is not null"), "ep", ["period"], "rk").select("stock_id", "period", "rk")


@query("SELECT stock_id, period, ((row_number() OVER (PARTITION BY period ORDER BY ep, stock_id) - 1) * 5 // count(*) OVER (PARTITION BY period) + 1)::bigint AS bucket FROM scores WHERE ep IS NOT NULL")
def w17_quantile_bucket(spark, d):
    return w.quantile_bucket(scores(spark, d), "ep", 5, ["period"]).select("stock_id", "period", "bucket")


@query("""SELECT period, curve, curve / max(curve) OVER (ORDER BY period) - 1 AS drawdown FROM (SELECT period, product(1 + r) OVER (ORDER BY period) AS curve
          FROM (SELECT date_trunc('month', date)::date AS period, product(1 + r) - 1 AS r FROM mkt_daily GROUP BY 1))""", "curve drawdown", 5)
def w20_drawdown(spark, d):
    from quillon.functions.scalars import compound

    rows = market_daily(spark, d).groupBy(F.trunc("date", "MM").alias("period")).agg(compound(F.col("x")).alias("r")).withColumn("one", F.lit(1))
    return w.drawdown(rows, "r", ["one"], "period").select("period", "curve", "drawdown")


@query("SELECT stock_id, period, abs(x - avg(x) OVER (PARTITION BY stock_id, post)) AS dev FROM (SELECT stock_id, period, ret_raw AS x, period >= DATE '1998-01-01' AS post FROM periodic)", "dev")
def w21_absolute_deviation(spark, d):
    post = F.col("period") >= F.lit("1998-01-01").cast("date")
    return periodic(spark, d).select("stock_id", "period", F.abs(F.col("ret_raw") - F.avg("ret_raw").over(W.partitionBy("stock_id", post))).alias("dev"))


@query("""WITH RECURSIVE q AS (SELECT stock_id, period, mcap_usd AS x, (year(period) * 4 + quarter(period))::bigint AS t FROM periodic),
          e AS (SELECT q.stock_id, q.t, q.period, q.x AS ema FROM q LEFT JOIN q p ON p.stock_id = q.stock_id AND p.t = q.t - 1 WHERE p.t IS NULL
                UNION ALL SELECT q.stock_id, q.t, q.period, 0.5 * e.ema + 0.5 * q.x FROM e JOIN q ON q.stock_id = e.stock_id AND q.t = e.t + 1)
          SELECT stock_id, period, ema FROM e""", "ema", 6)
def w22_ema(spark, d):
    t = (F.year("period") * 4 + F.quarter("period")).cast("long")
    return w.ema(periodic(spark, d).withColumn("t", t), "mcap_usd", ["stock_id"], 0.5).select("stock_id", "period", "ema")


@query("SELECT stock_id, period, (ep_ + dy_) / nullif((ep IS NOT NULL)::int + (dy IS NOT NULL)::int, 0) AS score FROM (SELECT *, coalesce(ep, 0) AS ep_, coalesce(dy, 0) AS dy_ FROM zscores)", "score")
def v14_composite(spark, d):
    return zscores(spark, d).select("stock_id", "period", row_mean([F.col("ep"), F.col("dy")]).alias("score"))
