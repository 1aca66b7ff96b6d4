"""An equity-like panel derived from the star-schema tables: suppliers are securities, nations countries and currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPOCH, EXIT = "1995-01-01", "2000-06-30"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def securities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``stock_id``, ``country_code``, ``region_code``, ``industry``, ``free_float_percentage``, ``stock_start_date``."""
    s, n = _read(spark, sf_dir, "supplier"), _read(spark, sf_dir, "nation")
    key = F.col("s_suppkey").cast("long")
    industry = F.when(key % 3 == 0, "bank").when(key % 3 == 1, "insurance_life").otherwise("insurance_pc")
    start = F.when(key % 5 == 0, F.date_add(F.lit(EPOCH).cast("date"), (key % 400).cast("int")))
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        key.alias("stock_id"), F.col("s_nationkey").cast("long").alias("country_code"), F.col("n_regionkey").cast("long").alias("region_code"),
        industry.alias("industry"), (20 + key % 80).cast("double").alias("free_float_percentage"), start.alias("stock_start_date"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("stock_id"), F.col("l_shipdate").cast("date").alias("date"),
        F.col("l_extendedprice").alias("ext"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty"),
    )


def lines_by_security(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``lines`` with the lines of a security side by side: groupings, windows and joins by security follow without another exchange.

    A day or quarter of a security has few lines, spread over the whole table, so adding them up before the exchange would save nothing.
    """
    return lines(spark, sf_dir).select("stock_id", "date", *columns).repartition("stock_id")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per security and day: prices near 1, stubs, an exit wave with decays, and returns with gaps."""
    day = F.datediff("date", F.lit(EPOCH).cast("date"))
    gross = F.round(F.sum(F.col("ext") * (1 - F.col("disc"))), 4)
    cap = F.round(F.sum("ext"), 2)
    rows = lines_by_security(spark, sf_dir, "ext", "disc", "qty").groupBy("stock_id", "date").agg(F.round(gross / cap, 6).alias("mark"), cap.alias("mcap_local"), F.round(F.sum("qty"), 2).alias("volume"))
    rows = rows.where((F.col("stock_id") % 7 != 0) | (F.col("date") <= EXIT))
    left = F.datediff(F.lit(EXIT).cast("date"), F.col("date"))
    decay = F.when((F.col("stock_id") % 14 == 0) & (left < 120), 1 - 0.9 * (120 - left) / 120).otherwise(1.0)
    price = F.when((F.col("stock_id") * 31 + day) % 997 == 0, F.lit(0.005)).otherwise(F.col("mark") * decay)
    order = W.partitionBy("stock_id").orderBy("date")
    rows = rows.withColumn("price_local", price).withColumn("_move", F.col("price_local") / F.lag("price_local").over(order) - 1)
    gap = F.col("stock_id") + day
    return rows.select(
        "stock_id", "date", "price_local", "mcap_local", "volume",
        F.when(gap % 100 != 0, F.col("_move")).alias("price_return"), F.when(gap % 50 != 0, F.col("_move")).alias("total_return"),
    )


def fx_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("country_code"), (0.5 + 0.05 * F.col("n_nationkey")).alias("fx_to_usd"))


def market_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with country, region, industry, exchange rate, market cap in dollars, risk-free rate and excess return."""
    key = F.col("country_code")
    rows = prices(spark, sf_dir).join(securities(spark, sf_dir), "stock_id").join(F.broadcast(fx_rates(spark, sf_dir)), "country_code", "left")  # a row for each country
    rf = F.when(~((key == 3) & (F.col("date") < "1996-01-01")), 0.00001 * (1 + key % 5))
    rows = rows.withColumn("risk_free_rate", rf).withColumn("mcap_usd", F.col("mcap_local") * F.col("fx_to_usd")).withColumn("tradeable", F.col("stock_id") % 4 != 0)
    return rows.withColumn("excess_return", F.col("total_return") - F.col("risk_free_rate"))


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per security and quarter, known 45 days after its end."""
    quarter = F.trunc("date", "quarter")
    sums = lines_by_security(spark, sf_dir, "ext", "disc", "tax", "qty").groupBy("stock_id", quarter.alias("q")).agg(
        F.round(F.sum("ext"), 2).alias("e"), F.round(F.sum(F.col("ext") * F.col("disc")), 4).alias("d"), F.round(F.sum(F.col("ext") * F.col("tax")), 4).alias("t"),
        F.round(F.sum("qty"), 2).alias("cash_and_st_investments"), F.round(F.avg("tax"), 6).alias("net_interest_margin"), F.round(F.avg("disc"), 6).alias("tier1_capital_ratio"),
    )
    end = F.date_sub(F.add_months("q", 3), 1)
    derived = {
        "earnings_ltm": ("d", 1.0), "dividend_ltm": ("t", 1.0), "book_value": ("e", 1.0), "goodwill": ("d", 0.5), "operating_income": ("e", 0.1),
        "loan_loss_provision": ("t", 0.3), "loan_loss_reserve": ("t", 0.2), "nonperforming_loans": ("d", 0.1), "net_loans": ("e", 0.6), "interest_expense": ("t", 0.5),
        "operating_expense": ("d", 0.4), "total_assets": ("e", 3.0), "sales_ltm": ("e", 1.5), "total_equity": ("e", 0.3), "insurance_premium": ("e", 0.4),
        "insurance_reserves": ("e", 0.5), "investment_income": ("d", 0.2), "losses": ("t", 0.6), "underwriting_expense": ("t", 0.1),
    }
    return sums.select(
        "stock_id", end.alias("date_fundamental"), F.date_add(end, 45).alias("observation_date"), "cash_and_st_investments", "net_interest_margin", "tier1_capital_ratio",
        *[(F.col(c) * k).alias(name) for name, (c, k) in derived.items()],
    )


def extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Further items per security and quarter, which a quarter of the securities do not report."""
    quarter = F.trunc("date", "quarter")
    sums = lines_by_security(spark, sf_dir, "qty").where("stock_id % 4 <> 1").groupBy("stock_id", quarter.alias("q")).agg(F.count("*").alias("n_lines"), F.round(F.max("qty"), 2).alias("top_quantity"))
    return sums.select("stock_id", F.date_sub(F.add_months("q", 3), 1).alias("date_fundamental"), "n_lines", "top_quantity")


def risk_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk-free rate by country and day, where it is known."""
    days = lines(spark, sf_dir).select("date").distinct()
    key = F.col("country_code")
    known = fx_rates(spark, sf_dir).select("country_code").crossJoin(days).where(~((key == 3) & (F.col("date") < "1996-01-01")))  # countries by days
    return known.withColumn("risk_free_rate", 0.00001 * (1 + key % 5))


def zero_curve(spark: SparkSession, sf_dir: str, currencies: int = 5) -> DataFrame:
    """Five tenors per month and currency-like key, from order priorities."""
    o, c = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    tenor = F.element_at(F.create_map(*[F.lit(x) for kv in (("1", "6M"), ("2", "12M"), ("3", "24M"), ("4", "60M"), ("5", "120M")) for x in kv]), F.substring("o_orderpriority", 1, 1))
    rows = o.join(c, o.o_custkey == c.c_custkey).select(F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("date"), (F.col("c_nationkey") % currencies).cast("long").alias("currency"), tenor.alias("tenor_description"), "o_totalprice")
    return rows.groupBy("date", "currency", "tenor_description").agg(F.round(F.avg("o_totalprice") / 1e7, 12).alias("zero_rate"))
