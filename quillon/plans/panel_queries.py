"""Queries over sources, predicates, joins, cleaning and resampling."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.scalars import period_key, quarter_label, ratio, tenor_years
from quillon.operators import clean as c
from quillon.operators import joins as j
from quillon.operators import resample as r
from quillon.operators import windows as w
from quillon.operators.validate import first_rows, reproducible_pick
from quillon.plans.oracle import define
from quillon.plans.registry import query
from quillon.sources import catalog, versioned
from quillon.sources import surrogate as s
from quillon.sources.shared import artifact, materialize, shared_dir


# Frames that many queries start from are artifacts: built once per application, then rescanned. The queries of the operators
# that build them run those operators themselves.


def cleaned(spark, d) -> DataFrame:
    return artifact(spark, d, "clean", lambda: c.clean(s.market_frame(spark, d)))


def events(spark, d) -> DataFrame:
    return artifact(spark, d, "exits", lambda: c.delist_events(s.prices(spark, d)))


def market_daily(spark, d) -> DataFrame:
    return r.cap_weighted(cleaned(spark, d), ["date"]).select("date", F.col("r").alias("x"))


def make_monthly(spark, d) -> DataFrame:
    return r.monthly_returns(cleaned(spark, d).where("tradeable"), market_daily(spark, d), ["date"], ("mcap_usd", "industry"))


def monthly(spark, d) -> DataFrame:
    return artifact(spark, d, "monthly", lambda: make_monthly(spark, d))


def make_periodic(spark, d) -> DataFrame:
    return r.periodic_returns(cleaned(spark, d).where("tradeable"), events(spark, d))


def periodic(spark, d) -> DataFrame:
    return artifact(spark, d, "periodic", lambda: make_periodic(spark, d))


def make_sector(spark, d) -> DataFrame:
    return j.sector_panel(cleaned(spark, d), s.fundamentals(spark, d))


def sector(spark, d) -> DataFrame:
    return artifact(spark, d, "sector", lambda: make_sector(spark, d))


@query("SELECT stock_id::varchar AS stock_id, country_code::varchar AS country_code, region_code::varchar AS region_code, industry FROM securities")
def s3_cast_ids(spark, d):
    return catalog.cast_ids(s.securities(spark, d)).select("stock_id", "country_code", "region_code", "industry")


@query("SELECT industry, count(*) AS n_rows, sum(px_blanked::int)::bigint AS n_blanked, sum(ret_gated::int)::bigint AS n_gated FROM clean GROUP BY industry")
def s8_scrub_audit(spark, d):
    return c.scrub_audit(cleaned(spark, d), "industry")


@query("SELECT DISTINCT f.stock_id, industry FROM fundamentals f JOIN securities USING (stock_id) WHERE net_interest_margin IS NOT NULL")
def p1_tradeable_ids(spark, d):
    return j.tradeable_ids(s.fundamentals(spark, d), s.securities(spark, d), "net_interest_margin")


@query("""SELECT stock_id, date_fundamental, max(earnings_ltm > 7000) OVER (PARTITION BY stock_id) AS in_set, industry LIKE 'insurance%' AS insurer
          FROM fundamentals JOIN securities USING (stock_id)""")
def p2_sector_set(spark, d):
    from pyspark.sql import Window as W

    rows = s.fundamentals(spark, d).join(s.securities(spark, d), "stock_id")
    has = F.max(F.col("earnings_ltm") > 7000).over(W.partitionBy("stock_id"))
    return rows.select("stock_id", "date_fundamental", has.alias("in_set"), F.col("industry").startswith("insurance").alias("insurer"))


@query("""SELECT c.stock_id, c.date, price_local FROM clean c LEFT JOIN exits e USING (stock_id)
          WHERE (stock_start_date IS NULL OR c.date >= stock_start_date) AND (delist_date IS NULL OR c.date <= delist_date)""", "price_local")
def p7_pit_filter(spark, d):
    window = c.tradeability_window(s.securities(spark, d), events(spark, d))
    return c.pit_filter(cleaned(spark, d).select("stock_id", "date", "price_local"), window)


@query("SELECT stock_id, period, ret_wins, fwd1 FROM (SELECT *, lead(ret_wins) OVER (PARTITION BY stock_id ORDER BY period) AS fwd1 FROM periodic WHERE period BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')", "ret_wins fwd1")
def p8_pit_slice(spark, d):
    return w.forward(periodic(spark, d).where("period between '1997-01-01' and '1999-12-31'"), "ret_wins").select("stock_id", "period", "ret_wins", "fwd1")


@query("SELECT stock_id, period, ret_wins, fwd1 FROM (SELECT *, lead(ret_wins) OVER (PARTITION BY stock_id ORDER BY period) AS fwd1 FROM periodic WHERE period BETWEEN DATE '1997-01-01' AND DATE '1999-12-31')", "ret_wins fwd1")
def p8_pit_slice_pruned(spark, d):
    base = f"{shared_dir(spark)}/periodic-{uuid.uuid4().hex}"
    versioned.publish(periodic(spark, d), base, "period")
    late = periodic(spark, d).where("period >= '1999-01-01'")
    versioned.publish(late, base, "period", replace=False)  # a rebuild of the last years leaves the others as they are
    rows = versioned.current(spark, base).where("period between '1997-01-01' and '1999-12-31'")
    return w.forward(rows, "ret_wins").select("stock_id", "period", "ret_wins", "fwd1")


@query("""SELECT p.stock_id, p.period FROM periodic p JOIN mktbeta b ON p.stock_id = b.stock_id AND p.period = b.period LEFT JOIN exits e ON p.stock_id = e.stock_id
          WHERE (p.ret_raw IS NOT NULL OR p.mcap_usd IS NOT NULL) AND NOT coalesce(delist_date <= p.date, false)""")
def p15_investable(spark, d):
    return j.investable(periodic(spark, d), w.rolling_beta(monthly(spark, d)), events(spark, d), ["ret_raw", "mcap_usd"])


@query("SELECT stock_id, date, date_fundamental, earnings_ltm FROM sector", "earnings_ltm")
def j1_asof_fundamentals(spark, d):
    return make_sector(spark, d).select("stock_id", "date", "date_fundamental", "earnings_ltm")


TABLES = "region nation customer supplier part orders lineitem events".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def s2_load_all(spark, d):
    tables = catalog.load_all(spark, {t: f"{d}/{t}.parquet" for t in TABLES})
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t, df in tables.items()])


@query("SELECT stock_id, date, price_local, volume FROM prices", "price_local volume")
def s5_materialize(spark, d):
    return materialize(s.prices(spark, d), "prices").select("stock_id", "date", "price_local", "volume")


@query("SELECT 'exits' AS artifact, count(*) AS rows FROM exits UNION ALL SELECT 'periodic', count(*) FROM periodic")
def s7_manifest(spark, d):
    return catalog.write_with_manifest({"exits": events(spark, d), "periodic": periodic(spark, d)}, f"{shared_dir(spark)}/build-{uuid.uuid4().hex}")


@query("SELECT stock_id, reason, delist_return FROM exits")
def s4_load_artifacts(spark, d):
    folder = f"{shared_dir(spark)}/build-{uuid.uuid4().hex}"
    catalog.write_artifact(events(spark, d), folder, "exits")
    return catalog.load_artifacts(spark, folder, ["exits"], "the build")["exits"].select("stock_id", "reason", "delist_return")


_STEPS = "SELECT cohort, currency, 'level' AS outcome, round(avg(CASE WHEN date >= cohort THEN level END) - avg(CASE WHEN date < cohort THEN level END), 9) AS coef FROM curve_simple_all, (VALUES (DATE '1997-01-01'), (DATE '1999-01-01')) c(cohort) GROUP BY 1, 2"
define("curve_simple_all", "SELECT date, currency, max(CASE WHEN tenor_description = '120M' THEN zero_rate END) AS level FROM curve GROUP BY 1, 2")


@query(f"SELECT b.date, b.currency, level - coalesce((SELECT sum(coef) FROM ({_STEPS}) s WHERE s.currency = b.currency AND s.cohort <= b.date), 0) AS level FROM curve_simple_all b", "level", 6)
def s9_did_table(spark, d):
    from quillon.operators.curves import simple_curve

    curve = simple_curve(s.zero_curve(spark, d)).select("date", "currency", "level")
    cohorts = F.explode(F.array(*[F.lit(x).cast("date") for x in ("1997-01-01", "1999-01-01")]))
    x = lambda after: F.avg(F.when((F.col("date") >= F.col("cohort")) == F.lit(after), F.col("level")))
    made = curve.withColumn("cohort", cohorts).groupBy("cohort", "currency").agg(F.round(x(True) - x(False), 9).alias("coef")).withColumn("outcome", F.lit("level"))
    folder = f"{shared_dir(spark)}/did-{uuid.uuid4().hex}"
    catalog.write_artifact(made, folder, "did")
    return j.step_correction(curve, catalog.did_table(spark, f"{folder}/did"), {"level": "level"}).select("date", "currency", "level")


@query("SELECT f.stock_id, f.date_fundamental, earnings_ltm, n_lines, top_quantity FROM fundamentals f LEFT JOIN extended x ON f.stock_id = x.stock_id AND f.date_fundamental = x.date_fundamental", "earnings_ltm")
def j2_extended_fundamentals(spark, d):
    return j.extend(s.fundamentals(spark, d), s.extended(spark, d)).select("stock_id", "date_fundamental", "earnings_ltm", "n_lines", "top_quantity")


@query("""SELECT m.stock_id, m.date, m.industry, m.mcap_usd, m.excess_return, f.earnings_ltm, f.n_lines FROM market m ASOF LEFT JOIN
          (SELECT f.stock_id, f.observation_date, earnings_ltm, n_lines FROM fundamentals f LEFT JOIN extended x ON f.stock_id = x.stock_id AND f.date_fundamental = x.date_fundamental) f
          ON m.stock_id = f.stock_id AND m.date >= f.observation_date""", "mcap_usd excess_return earnings_ltm", 4)
def j8_full_panel(spark, d):
    known = j.extend(s.fundamentals(spark, d), s.extended(spark, d))
    rows = j.full_panel(s.prices(spark, d), s.securities(spark, d), s.fx_rates(spark, d), s.risk_free(spark, d), known)
    return rows.select("stock_id", "date", "industry", "mcap_usd", "excess_return", "earnings_ltm", "n_lines")


@query("SELECT * FROM (SELECT stock_id, date_trunc('quarter', date)::date AS period, date, price_local FROM clean) QUALIFY row_number() OVER (PARTITION BY stock_id, period ORDER BY date) = 1", "price_local")
def t3_first_rows(spark, d):
    rows = cleaned(spark, d).select("stock_id", period_key(F.col("date"), 3).alias("period"), "date", "price_local")
    return first_rows(rows, ["stock_id", "period"], ["date"])


@query("SELECT date, currency FROM (SELECT DISTINCT date, currency FROM curve) ORDER BY md5('spot|' || date::varchar || '|' || currency::varchar), date, currency LIMIT 3")
def t8_reproducible_pick(spark, d):
    return reproducible_pick(s.zero_curve(spark, d), ["date", "currency"], "spot", 3)


@query("""SELECT 'daily' AS kind, stock_id, period, fwd1 FROM forward UNION ALL
          SELECT 'periodic', stock_id, period, lead(ret_raw) OVER (PARTITION BY stock_id ORDER BY period) FROM periodic""", "fwd1", 5)
def w9_forward_dispatch(spark, d):
    daily = w.forward_returns(cleaned(spark, d).where("tradeable"), "ret_wins", "daily", events(spark, d))
    shifted = w.forward_returns(periodic(spark, d), "ret_raw", "periodic", None)
    return daily.select(F.lit("daily").alias("kind"), "stock_id", "period", "fwd1").unionByName(shifted.select(F.lit("periodic").alias("kind"), "stock_id", "period", "fwd1"))


@query("""SELECT v.event_id, v.user_id, b.event_id AS buy_id FROM (SELECT * FROM events WHERE event_type = 'view') v
          LEFT JOIN (SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS k FROM events WHERE event_type = 'purchase') WHERE k = 1) b0 ON false
          ASOF LEFT JOIN (SELECT user_id, max(event_id) AS event_id, ts FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) b ON v.user_id = b.user_id AND v.ts >= b.ts""")
def j1_asof_events(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    bought = e.where("event_type = 'purchase'").groupBy("user_id", F.col("ts").alias("buy_ts")).agg(F.max("event_id").alias("buy_id"))
    return j.asof_join(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), bought, "user_id", "ts", "buy_ts").select("event_id", "user_id", "buy_id")


@query("SELECT stock_id, date, country_code, region_code, industry, fx_to_usd, risk_free_rate, mcap_usd, tradeable, excess_return FROM market", "fx_to_usd risk_free_rate mcap_usd excess_return")
def j6_market_frame(spark, d):
    return s.market_frame(spark, d).select("stock_id", "date", "country_code", "region_code", "industry", "fx_to_usd", "risk_free_rate", "mcap_usd", "tradeable", "excess_return")


@query("SELECT industry, date_trunc('quarter', date)::date AS period, count(*) AS n, count(earnings_ltm) AS n_known, sum(mcap_usd) AS mcap_usd FROM sector GROUP BY 1, 2", "mcap_usd", 2)
def j7_sector_panel(spark, d):
    return make_sector(spark, d).groupBy("industry", period_key(F.col("date"), 3).alias("period")).agg(F.count("*").alias("n"), F.count("earnings_ltm").alias("n_known"), F.sum("mcap_usd").alias("mcap_usd"))


_COEFS = [("1996-01-01", 0, "level", 0.0005), ("1998-01-01", 0, "level", 0.0002), ("1997-06-01", 2, "slope", -0.0003), ("1999-01-01", 3, "level", 0.0001)]


@query("""WITH co(cohort, currency, outcome, coef) AS (VALUES (DATE '1996-01-01', 0, 'level', 0.0005), (DATE '1998-01-01', 0, 'level', 0.0002), (DATE '1997-06-01', 2, 'slope', -0.0003), (DATE '1999-01-01', 3, 'level', 0.0001)),
          base AS (SELECT date, currency, max(CASE WHEN tenor_description = '120M' THEN zero_rate END) AS level,
                   max(CASE WHEN tenor_description = '24M' THEN zero_rate END) - max(CASE WHEN tenor_description = '120M' THEN zero_rate END) AS slope FROM curve GROUP BY 1, 2)
          SELECT date, currency, level - coalesce((SELECT sum(coef) FROM co WHERE co.currency = b.currency AND outcome = 'level' AND cohort <= b.date), 0) AS level,
                 slope - coalesce((SELECT sum(coef) FROM co WHERE co.currency = b.currency AND outcome = 'slope' AND cohort <= b.date), 0) AS slope FROM base b""", "level slope", 7)
def j10_step_correction(spark, d):
    from quillon.operators.curves import simple_curve

    coefs = spark.createDataFrame(_COEFS, "cohort string, currency long, outcome string, coef double").withColumn("cohort", F.col("cohort").cast("date"))
    return j.step_correction(simple_curve(s.zero_curve(spark, d)), coefs, {"level": "level", "slope": "slope"})


@query("SELECT c.stock_id, g.period, c.date, price_local, earnings_ltm FROM sector c JOIN (SELECT stock_id, date_trunc('quarter', date)::date AS period, max(date) AS date FROM sector GROUP BY 1, 2) g ON c.stock_id = g.stock_id AND c.date = g.date", "price_local earnings_ltm")
def j11_downsample(spark, d):
    rows = sector(spark, d)
    return j.downsample(rows, r.rebalance_grid(rows)).select("stock_id", "period", "date", "price_local", "earnings_ltm")


@query("SELECT stock_id, count(*) AS n, max(c.date) AS last FROM clean c LEFT JOIN exits e USING (stock_id) WHERE delist_date IS NULL OR c.date <= delist_date GROUP BY stock_id")
def j15_trim_after_exit(spark, d):
    return j.trim_after_exit(cleaned(spark, d), events(spark, d)).groupBy("stock_id").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query("SELECT stock_id, date, price_local, total_return, excess_return, px_blanked, ret_gated FROM clean", "price_local total_return excess_return")
def c4_clean(spark, d):
    return c.clean(s.market_frame(spark, d)).select("stock_id", "date", "price_local", "total_return", "excess_return", "px_blanked", "ret_gated")


@query("SELECT * FROM exits")
def c8_delist_events(spark, d):
    return c.delist_events(s.prices(spark, d))


@query("""SELECT count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date, count(DISTINCT stock_id) AS n_stocks, round(avg((price_local IS NULL)::int), 9) AS null_price,
          round(avg((total_return IS NULL)::int), 9) AS null_return, coalesce(sum((price_local <= 0)::int), 0)::bigint AS n_bad_price, sum((abs(total_return) > 0.5)::int)::bigint AS n_large_return,
          round(avg(total_return), 9) AS mean_return, round(stddev_samp(total_return), 9) AS std_return, round(min(total_return), 9) AS min_return, round(max(total_return), 9) AS max_return FROM market""")
def c9_quality_report(spark, d):
    return c.quality_report(s.market_frame(spark, d))


_COVERED = ["country_code", "industry", "fx_to_usd", "risk_free_rate", "mcap_usd", "stock_start_date", "earnings_ltm", "book_value"]


@query(f"""SELECT count(*) AS n_rows, min(date) AS date_min, max(date) AS date_max, count(DISTINCT stock_id) AS n_securities, count(DISTINCT date) AS n_dates, {", ".join(f"avg(({c} IS NULL)::int) AS null_pct_{c}" for c in _COVERED)},
          coalesce(sum((price_local <= 0)::int), 0)::bigint AS n_nonpositive_price, coalesce(sum((mcap_local <= 0)::int), 0)::bigint AS n_nonpositive_mcap, coalesce(sum((volume < 0)::int), 0)::bigint AS n_negative_volume,
          min(total_return) AS tr_min, max(total_return) AS tr_max, avg(total_return) AS tr_mean, sum((total_return IS NULL)::int)::bigint AS tr_null, coalesce(sum((total_return = 0)::int), 0)::bigint AS tr_zero, coalesce(sum((abs(total_return) > 0.5)::int), 0)::bigint AS tr_extreme_50pct,
          min(excess_return) AS er_min, max(excess_return) AS er_max, avg(excess_return) AS er_mean, sum((excess_return IS NULL)::int)::bigint AS er_null
          FROM market m ASOF LEFT JOIN (SELECT stock_id AS fid, observation_date, earnings_ltm, book_value FROM fundamentals) f ON m.stock_id = f.fid AND m.date >= f.observation_date""",
       " ".join(f"null_pct_{c}" for c in _COVERED) + " tr_min tr_max tr_mean er_min er_max er_mean", 7)
def c9_quality_full(spark, d):
    return c.full_quality_report(j.asof_join(s.market_frame(spark, d), s.fundamentals(spark, d), "stock_id", "date", "observation_date"), _COVERED)


@query("SELECT l_suppkey::bigint AS stock_id, l_shipdate::date AS date, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c10_duplicate_keys(spark, d):
    return c.duplicate_keys(s.lines(spark, d), ["stock_id", "date"])


@query("SELECT stock_id, date, price_local, volume FROM prices QUALIFY row_number() OVER (PARTITION BY stock_id, date_trunc('quarter', date) ORDER BY date DESC) = 1", "price_local volume")
def c11_quarter_end(spark, d):
    return c.latest_in_period(s.prices(spark, d), "stock_id", period_key(F.col("date"), 3), "date").select("stock_id", "date", "price_local", "volume")


@query("SELECT date, region_code, coalesce(sum(excess_return * mcap_usd), 0) AS w, coalesce(sum(mcap_usd), 0) AS m, sum(excess_return * mcap_usd) / sum(mcap_usd) AS r FROM clean GROUP BY 1, 2", "w m r", 5)
def a1_cap_weighted(spark, d):
    return r.cap_weighted(cleaned(spark, d), ["date", "region_code"])


@query("""WITH ch AS (SELECT date, region_code, country_code, sum(excess_return * mcap_usd) AS w, sum(mcap_usd) AS m FROM clean GROUP BY 1, 2, 3)
          SELECT date, country_code, w / m - sum(w) OVER (PARTITION BY date, region_code) / sum(m) OVER (PARTITION BY date, region_code) AS factor FROM ch""", "factor")
def a2_relative_factor(spark, d):
    return r.relative_factor(cleaned(spark, d), "country_code", ("region_code",))


@query("SELECT date, sum(excess_return * mcap_usd) / sum(mcap_usd) AS mkt, sum(excess_return * mcap_usd) FILTER (tradeable) / sum(mcap_usd) FILTER (tradeable) AS bench FROM clean GROUP BY date", "mkt bench")
def a4_market_series(spark, d):
    return r.market_series(cleaned(spark, d))


@query("SELECT * FROM grid")
def a6_rebalance_grid(spark, d):
    return r.rebalance_grid(cleaned(spark, d))


@query("SELECT stock_id, period, date, ret, x, mcap_usd, industry FROM monthly", "ret x mcap_usd", 5)
def a7_monthly_returns(spark, d):
    return make_monthly(spark, d)


@query("SELECT stock_id, period, date, industry, mcap_usd, free_float_percentage, ret_raw, ret_wins FROM periodic", "mcap_usd ret_raw ret_wins", 5)
def a9_periodic_returns(spark, d):
    return make_periodic(spark, d).select("stock_id", "period", "date", "industry", "mcap_usd", "free_float_percentage", "ret_raw", "ret_wins")


@query("SELECT period, max(CASE WHEN industry = 'bank' THEN r END) AS bank, max(CASE WHEN industry = 'insurance_life' THEN r END) AS insurance_life, max(CASE WHEN industry = 'insurance_pc' THEN r END) AS insurance_pc FROM (SELECT period, industry, avg(ret_raw) AS r FROM periodic GROUP BY 1, 2) GROUP BY period", "bank insurance_life insurance_pc")
def a11_pivot(spark, d):
    return r.pivot(periodic(spark, d).groupBy("period", "industry").agg(F.avg("ret_raw").alias("r")), ["period"], "industry", "r", ["bank", "insurance_life", "insurance_pc"])


@query("SELECT stock_id, period, 'ret_raw' AS factor, ret_raw AS value FROM periodic UNION ALL SELECT stock_id, period, 'ret_wins', ret_wins FROM periodic", "value", 5)
def a12_unpivot(spark, d):
    return r.unpivot(periodic(spark, d).select("stock_id", "period", "ret_raw", "ret_wins"), ["stock_id", "period"], ["ret_raw", "ret_wins"])


@query("""SELECT stock_id, date, CASE WHEN industry = 'bank' THEN beta ELSE 0 END AS beta_bank, CASE WHEN industry = 'insurance_life' THEN beta ELSE 0 END AS beta_insurance_life,
          CASE WHEN industry = 'insurance_pc' THEN beta ELSE 0 END AS beta_insurance_pc, (industry = 'insurance_life')::int::double AS is_insurance_life, (industry = 'insurance_pc')::int::double AS is_insurance_pc FROM mktbeta""", "beta_bank beta_insurance_life beta_insurance_pc")
def a13_expand_by_group(spark, d):
    return r.expand_by_group(w.rolling_beta(monthly(spark, d)), "beta", "industry", ["bank", "insurance_life", "insurance_pc"])


@query("SELECT period, industry, count(DISTINCT stock_id) AS n FROM grid JOIN securities USING (stock_id) GROUP BY 1, 2")
def a15_universe_coverage(spark, d):
    return r.rebalance_grid(cleaned(spark, d)).join(s.securities(spark, d), "stock_id").groupBy("period", "industry").agg(F.count_distinct("stock_id").alias("n"))


@query("SELECT period, 'fwd1' AS factor, avg((fwd1 IS NOT NULL)::int) AS coverage FROM forward GROUP BY 1 UNION ALL SELECT period, 'fwd2', avg((fwd2 IS NOT NULL)::int) FROM forward GROUP BY 1", "coverage")
def a16_factor_coverage(spark, d):
    return r.coverage(w.forward(periodic(spark, d), "ret_wins", (1, 2)), ["fwd1", "fwd2"])


@query("SELECT year(delist_date)::int AS year, reason, count(*) AS n FROM exits GROUP BY 1, 2")
def a17_delist_counts(spark, d):
    return events(spark, d).groupBy(F.year("delist_date").alias("year"), "reason").agg(F.count("*").alias("n"))


@query("""SELECT (date >= DATE '1998-01-01')::int AS post, count(x) AS n, count(DISTINCT stock_id) AS n_firms, avg(x) AS mean, median(x) AS median, var_samp(x) AS var, stddev_samp(x) AS std
          FROM (SELECT stock_id, date_fundamental AS date, loan_loss_provision / net_loans AS x, min(date_fundamental) OVER (PARTITION BY stock_id) AS a, max(date_fundamental) OVER (PARTITION BY stock_id) AS b FROM fundamentals)
          WHERE a < DATE '1998-01-01' AND b >= DATE '1998-01-01' GROUP BY 1""", "mean median var std", 8)
def a18_pre_post_summary(spark, d):
    from quillon.operators.econometrics import balanced

    rows = balanced(s.fundamentals(spark, d).withColumn("date", F.col("date_fundamental")), "1998-01-01")
    return r.summarize(rows, "post", ratio(F.col("loan_loss_provision"), F.col("net_loans")))


@query("SELECT CASE WHEN grouping(industry) = 0 THEN industry END AS industry, CASE WHEN grouping(label) = 0 THEN label END AS label, avg(ret_raw) AS mean, count(*) AS n FROM (SELECT *, year(period) || 'Q' || quarter(period) AS label FROM periodic) GROUP BY GROUPING SETS ((industry), (label), (industry, label))", "mean")
def a19_marginals(spark, d):
    rows = periodic(spark, d).withColumn("label", quarter_label(F.col("period")))
    keys = [F.col("industry"), F.col("label")]
    return rows.groupingSets([[keys[0]], [keys[1]], keys], *keys).agg(F.avg("ret_raw").alias("mean"), F.count("*").alias("n"))


@query("SELECT floor(date_diff('day', DATE '1998-01-01', date) / 30)::bigint AS rel, stock_id % 2 = 0 AS treated, avg(price_local) AS mean FROM clean GROUP BY 1, 2", "mean", 10)
def a20_event_time(spark, d):
    rel = F.floor(F.datediff("date", F.lit("1998-01-01").cast("date")) / 30).cast("long")
    return cleaned(spark, d).groupBy(rel.alias("rel"), (F.col("stock_id") % 2 == 0).alias("treated")).agg(F.avg("price_local").alias("mean"))


@query("SELECT DISTINCT tenor_description, regexp_extract(tenor_description, '(\\d+)', 1)::double / 12 AS years FROM curve", "years")
def n6_tenor_years(spark, d):
    return s.zero_curve(spark, d).select("tenor_description", tenor_years(F.col("tenor_description")).alias("years")).distinct()
