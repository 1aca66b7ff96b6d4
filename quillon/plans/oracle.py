"""DuckDB SQL of the surrogate panel and its derived frames, as common table expressions that queries pick from."""

from __future__ import annotations

import re

CTES = {
    "securities": """
        SELECT s_suppkey::bigint AS stock_id, s_nationkey::bigint AS country_code, n_regionkey::bigint AS region_code,
               CASE s_suppkey % 3 WHEN 0 THEN 'bank' WHEN 1 THEN 'insurance_life' ELSE 'insurance_pc' END AS industry,
               (20 + s_suppkey % 80)::double AS free_float_percentage,
               CASE WHEN s_suppkey % 5 = 0 THEN DATE '1995-01-01' + (s_suppkey % 400)::int END AS stock_start_date
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "daily": """
        SELECT l_suppkey::bigint AS stock_id, l_shipdate::date AS date, round(round(sum(l_extendedprice * (1 - l_discount)), 4) / round(sum(l_extendedprice), 2), 6) AS mark,
               round(sum(l_extendedprice), 2) AS mcap_local, round(sum(l_quantity), 2) AS volume
        FROM lineitem GROUP BY 1, 2""",
    "priced": """
        SELECT stock_id, date, mcap_local, volume, date_diff('day', DATE '1995-01-01', date) AS day,
               CASE WHEN (stock_id * 31 + date_diff('day', DATE '1995-01-01', date)) % 997 = 0 THEN 0.005::double
                    ELSE mark * CASE WHEN stock_id % 14 = 0 AND date_diff('day', date, DATE '2000-06-30') < 120
                                     THEN 1::double - 0.9::double * (120 - date_diff('day', date, DATE '2000-06-30')) / 120 ELSE 1::double END END AS price_local
        FROM daily WHERE stock_id % 7 <> 0 OR date <= DATE '2000-06-30'""",
    "prices": """
        SELECT stock_id, date, price_local, mcap_local, volume, CASE WHEN (stock_id + day) % 100 <> 0 THEN move END AS price_return,
               CASE WHEN (stock_id + day) % 50 <> 0 THEN move END AS total_return
        FROM (SELECT *, price_local / lag(price_local) OVER (PARTITION BY stock_id ORDER BY date) - 1 AS move FROM priced)""",
    "market": """
        SELECT p.*, country_code, region_code, industry, free_float_percentage, stock_start_date, 0.5::double + 0.05::double * country_code AS fx_to_usd,
               CASE WHEN NOT (country_code = 3 AND date < DATE '1996-01-01') THEN 0.00001::double * (1 + country_code % 5) END AS risk_free_rate,
               mcap_local * (0.5::double + 0.05::double * country_code) AS mcap_usd, stock_id % 4 <> 0 AS tradeable,
               total_return - CASE WHEN NOT (country_code = 3 AND date < DATE '1996-01-01') THEN 0.00001::double * (1 + country_code % 5) END AS excess_return
        FROM prices p JOIN securities USING (stock_id)""",
    "gates": """
        SELECT *, lag(px) OVER w AS prev_px, lag(date) OVER w AS prev_date, coalesce(lag(valid) OVER w, true) AS prev_valid
        FROM (SELECT *, CASE WHEN valid THEN price_local END AS px FROM
              (SELECT *, coalesce(price_local > 0 AND coalesce(price_local * fx_to_usd >= 0.1, true), false) AS valid FROM market))
        WINDOW w AS (PARTITION BY stock_id ORDER BY date)""",
    "filled": """
        SELECT *, CASE WHEN total_return IS NOT NULL THEN total_return WHEN price_return IS NOT NULL THEN price_return
                       WHEN px IS NOT NULL AND prev_px IS NOT NULL AND px <> prev_px AND date_diff('day', prev_date, date) <= 10 THEN px / prev_px - 1 ELSE 0 END AS tr
        FROM gates""",
    "clean": """
        SELECT * EXCLUDE (total_return, excess_return, tr), CASE WHEN bad THEN 0 ELSE tr END AS total_return, NOT valid AS px_blanked, (total_return IS NOT NULL) AND bad AS ret_gated,
               CASE WHEN bad THEN 0 ELSE tr END - risk_free_rate AS excess_return
        FROM (SELECT *, (NOT valid) OR (NOT prev_valid) OR abs(tr) > 1 AS bad FROM filled) WHERE risk_free_rate IS NOT NULL""",
    "exits": """
        WITH act AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date DESC) AS back FROM prices WHERE volume > 0 OR coalesce(price_return <> 0, false)),
        seen AS (SELECT stock_id, max(date) AS last_active_date, max(CASE WHEN back <= 252 THEN price_local END) AS peak FROM act GROUP BY stock_id),
        ended AS (SELECT p.stock_id, max_by(price_local, date) FILTER (price_local IS NOT NULL AND date <= last_active_date) AS exit_price, min(price_local) AS low
                  FROM prices p JOIN seen USING (stock_id) GROUP BY p.stock_id)
        SELECT stock_id, last_active_date, last_active_date AS delist_date, CASE WHEN exit_price <= 0.2 * peak OR low <= 0.001 THEN 'wipeout' ELSE 'acquisition' END AS reason,
               CASE WHEN exit_price <= 0.2 * peak OR low <= 0.001 THEN -1.0::double ELSE 0.0::double END AS delist_return
        FROM seen JOIN ended USING (stock_id) WHERE last_active_date < (SELECT max(date) - 90 FROM prices)""",
    "fundamentals": """
        SELECT stock_id, end_ AS date_fundamental, end_ + 45 AS observation_date, cash_and_st_investments, net_interest_margin, tier1_capital_ratio,
               d AS earnings_ltm, t AS dividend_ltm, e AS book_value, d * 0.5::double AS goodwill, e * 0.1::double AS operating_income, t * 0.3::double AS loan_loss_provision,
               t * 0.2::double AS loan_loss_reserve, d * 0.1::double AS nonperforming_loans, e * 0.6::double AS net_loans, t * 0.5::double AS interest_expense,
               d * 0.4::double AS operating_expense, e * 3::double AS total_assets, e * 1.5::double AS sales_ltm, e * 0.3::double AS total_equity, e * 0.4::double AS insurance_premium,
               e * 0.5::double AS insurance_reserves, d * 0.2::double AS investment_income, t * 0.6::double AS losses, t * 0.1::double AS underwriting_expense
        FROM (SELECT l_suppkey::bigint AS stock_id, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::date AS end_, round(sum(l_extendedprice), 2) AS e,
                     round(sum(l_extendedprice * l_discount), 4) AS d, round(sum(l_extendedprice * l_tax), 4) AS t, round(sum(l_quantity), 2) AS cash_and_st_investments,
                     round(avg(l_tax), 6) AS net_interest_margin, round(avg(l_discount), 6) AS tier1_capital_ratio FROM lineitem GROUP BY 1, 2)""",
    "extended": """
        SELECT l_suppkey::bigint AS stock_id, (date_trunc('quarter', l_shipdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::date AS date_fundamental, count(*) AS n_lines, round(max(l_quantity), 2) AS top_quantity
        FROM lineitem WHERE l_suppkey % 4 <> 1 GROUP BY 1, 2""",
    "sector": """
        SELECT c.*, f.* EXCLUDE (stock_id) FROM (SELECT * FROM clean WHERE tradeable) c
        ASOF LEFT JOIN fundamentals f ON c.stock_id = f.stock_id AND c.date >= f.observation_date""",
    "curve": """
        SELECT date_trunc('month', o_orderdate)::date AS date, (c_nationkey % 5)::bigint AS currency,
               CASE left(o_orderpriority, 1) WHEN '1' THEN '6M' WHEN '2' THEN '12M' WHEN '3' THEN '24M' WHEN '4' THEN '60M' ELSE '120M' END AS tenor_description,
               round(avg(o_totalprice) / 1e7, 12) AS zero_rate
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3""",
    "mkt_daily": """
        SELECT date, coalesce(sum(excess_return * mcap_usd), 0) / coalesce(sum(mcap_usd), 0) AS r FROM clean GROUP BY date""",
    "monthly": """
        SELECT c.stock_id, date_trunc('month', c.date)::date AS period, max(c.date) AS date, coalesce(product(1 + excess_return), 1) - 1 AS ret, coalesce(product(1 + r), 1) - 1 AS x,
               max_by(mcap_usd, c.date) AS mcap_usd, max_by(industry, c.date) AS industry
        FROM clean c LEFT JOIN mkt_daily m ON c.date = m.date WHERE tradeable GROUP BY 1, 2""",
    "mktbeta": """
        SELECT *, CASE WHEN count(ret) OVER w >= 12 THEN regr_slope(ret, x) OVER w END AS beta
        FROM monthly WINDOW w AS (PARTITION BY stock_id ORDER BY period ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    "grid": "SELECT stock_id, date_trunc('quarter', date)::date AS period, max(date) AS date FROM clean GROUP BY 1, 2",
    "periodic": """
        WITH trimmed AS (SELECT c.* FROM clean c LEFT JOIN exits e USING (stock_id) WHERE tradeable AND (delist_date IS NULL OR c.date <= delist_date)),
        bounds AS (SELECT date, quantile_cont(excess_return, 0.01) AS lo, quantile_cont(excess_return, 0.99) AS hi FROM trimmed GROUP BY date),
        made AS (SELECT stock_id, date_trunc('quarter', t.date)::date AS period, max(t.date) AS date, product(1 + excess_return) - 1 AS raw,
                        product(1 + least(greatest(excess_return, lo), hi)) - 1 AS wins, max_by(mcap_usd, t.date) AS mcap_usd, max_by(industry, t.date) AS industry,
                        max_by(free_float_percentage, t.date) AS free_float_percentage
                 FROM trimmed t JOIN bounds USING (date) GROUP BY 1, 2)
        SELECT m.stock_id, m.period, m.date, industry, mcap_usd, free_float_percentage,
               CASE WHEN delist_return IS NOT NULL THEN (1 + coalesce(raw, 0)) * (1 + delist_return) - 1 ELSE raw END AS ret_raw,
               CASE WHEN delist_return IS NOT NULL THEN (1 + coalesce(wins, 0)) * (1 + delist_return) - 1 ELSE wins END AS ret_wins
        FROM made m LEFT JOIN exits e ON m.stock_id = e.stock_id AND m.period = date_trunc('quarter', delist_date)::date""",
    "forward": "SELECT *, lead(ret_wins) OVER w AS fwd1, lead(ret_wins, 2) OVER w AS fwd2 FROM periodic WINDOW w AS (PARTITION BY stock_id ORDER BY period)",
}


def _needs(sql: str) -> list[str]:
    return [n for n in CTES if re.search(rf"\b{n}\b", re.sub(r"AS \w+", "", sql))]


def define(name: str, sql: str) -> None:
    CTES[name] = sql


def with_ctes(sql: str) -> str:
    """``sql`` behind all expressions that it needs, in order."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for other in _needs(CTES[name]):
            if other != name and other not in out:
                add(other)
        out.setdefault(name, CTES[name])

    for name in _needs(sql):
        add(name)
    head = ",\n".join(f"{k} AS MATERIALIZED ({v})" for k, v in out.items())
    return f"WITH {head}\nSELECT * FROM ({sql})" if out else sql
