"""Registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.oracle import with_ctes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Registers a query; ``doubles`` are rounded alike on both sides."""
    names = doubles.split()

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in names}) if names else df

        QUERIES[fn.__name__] = run
        if sql is not None:
            rounded = ", ".join(f"round({c}::double, {digits}) + 0.0 AS {c}" for c in names)
            whole = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
            SQL[fn.__name__] = with_ctes(whole)
        return fn

    return register
