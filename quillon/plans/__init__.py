"""Queries by name, and their SQL."""

from quillon.plans import factor_queries, panel_queries, portfolio_queries, risk_queries, scan_queries, sweep_queries, validation_queries  # noqa: F401
from quillon.plans.registry import QUERIES, SQL
