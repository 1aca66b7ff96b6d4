"""The factor registry: metadata, ratio expressions fused into one projection, and computed factors."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillon.functions.scalars import finite, in_universe, ratio


@dataclass(frozen=True)
class Factor:
    """``expr`` gives a column of the sector panel; ``compute`` instead makes a frame of (stock_id, date, factor) from the frames by name.

    ``input_frame`` names the one whose rows it scores; a factor without it among the frames is an error.
    Factors that share their passes over the frames name a ``family``, which makes those asked for at once. ``column`` adds a
    factor to the sector panel's own rows, by windows within a security. For both, ``compute`` gives the factor alone.
    """

    name: str
    sleeve: str
    universe: str | None = None
    neutralize: bool = True
    input_frame: str = "sector"
    expr: Callable[[], Column] | None = None
    compute: Callable[[dict[str, DataFrame]], DataFrame] | None = None
    family: Callable[[dict[str, DataFrame], list[str]], DataFrame] | None = None
    column: Callable[[DataFrame], DataFrame] | None = None


REGISTRY: dict[str, Factor] = {}


def register(factor: Factor) -> Factor:
    if factor.name in REGISTRY:
        raise ValueError(f"factor {factor.name} is registered already")
    REGISTRY[factor.name] = factor
    return factor


def _over(top: str, bottom: str) -> Callable[[], Column]:
    """A ratio of two SQL expressions over panel columns."""
    return lambda: ratio(F.expr(top), F.expr(bottom))


# The factors' short names and the accounting ratios that define them.
_RATIOS = (
    ("E/P", "value", None, "earnings_ltm", "mcap_local"),
    ("DY", "value", None, "dividend_ltm", "mcap_local"),
    ("TBV/P", "value", "bank", "book_value - goodwill", "mcap_local"),
    ("PPNR/P", "value", "bank", "operating_income + loan_loss_provision", "mcap_local"),
    ("NPL Coverage", "quality", "bank", "loan_loss_reserve", "nonperforming_loans"),
    ("NPL Ratio", "quality", "bank", "nonperforming_loans", "net_loans"),
    ("PTX/AA", "quality", "bank", "interest_expense + operating_expense + loan_loss_provision", "total_assets"),
    ("ER", "quality", "bank", "operating_expense", "sales_ltm"),
    ("ROTCE", "quality", "bank", "earnings_ltm", "total_equity - goodwill"),
    ("B/P", "value", "insurance", "book_value", "mcap_local"),
    ("PI/P", "value", "insurance", "insurance_premium", "mcap_local"),
    ("RLR", "quality", "insurance", "insurance_reserves", "total_equity"),
    ("FIY", "quality", "insurance", "investment_income", "insurance_reserves"),
    ("LA/TR", "quality", "insurance", "cash_and_st_investments", "insurance_reserves"),
    ("ROE", "quality", "insurance", "earnings_ltm", "total_equity"),
    ("UWM", "quality", "insurance", "insurance_premium - losses - underwriting_expense", "insurance_premium"),
)
for _name, _sleeve, _universe, _top, _bottom in _RATIOS:
    register(Factor(_name, _sleeve, _universe, expr=_over(_top, _bottom)))
register(Factor("ln(MCap)", "size", expr=lambda: finite(F.ln(F.when(F.col("mcap_usd") > 0, F.col("mcap_usd"))))))
register(Factor("T1CR", "quality", "bank", expr=lambda: finite(F.col("tier1_capital_ratio"))))
register(Factor("NIM", "quality", "bank", expr=lambda: finite(F.col("net_interest_margin"))))


def applicable(universe: str | None, columns: list[str]) -> list[str]:
    """Factors among ``columns`` that a sub-universe uses: its own and those of all."""
    return [n for n in columns if n in REGISTRY and REGISTRY[n].universe in (None, universe)]


def require_industry(frame: DataFrame, factors: list[str]) -> None:
    """Sector factors need an industry label."""
    needy = [n for n in factors if REGISTRY[n].universe]
    if needy and "industry" not in frame.columns:
        raise ValueError(f"an industry column is needed for {', '.join(needy)}")


def ratio_scores(panel: DataFrame, names: list[str] | None = None, more: dict[str, str] | None = None) -> DataFrame:
    """All expression factors in one projection; off their sub-universe they are null. ``more`` columns of the panel follow them, by their new names."""
    names = [n for n, f in REGISTRY.items() if f.expr] if names is None else names
    require_industry(panel, names)
    columns = [F.when(in_universe(F.col("industry"), REGISTRY[n].universe), REGISTRY[n].expr()).alias(n) for n in names]
    return panel.select("stock_id", "date", "industry", *columns, *[F.col(f"`{c}`").alias(n) for n, c in (more or {}).items()])


def factor_frames(frames: dict[str, DataFrame], names: list[str]) -> DataFrame:
    """The wide score frame over the rows of the sector panel: expression factors in one projection, computed ones by security and date.

    Each family passes over the frames once. What is made, a row a month or quarter, is gathered by one grouping and stacked with the panel, which
    is exchanged once, by security: a row takes what stands before it on its own day, and factors on the panel's own rows follow in the same order.
    """
    for n in names:
        if REGISTRY[n].input_frame not in frames:
            raise ValueError(f"factor {n} needs the frame {REGISTRY[n].input_frame!r}")
    own, panel = [n for n in names if REGISTRY[n].column], frames["sector"]
    computed = [n for n in names if REGISTRY[n].compute and n not in own]
    families: dict[Callable, list[str]] = {}
    for n in computed:
        families.setdefault(REGISTRY[n].family or REGISTRY[n].compute, []).append(n)
    made = []
    for make, group in families.items():
        df = make(frames, group) if REGISTRY[group[0]].family else make(frames)
        made.append(df.select("stock_id", "date", *[F.col(f"`{n}`").alias(f"_f{computed.index(n)}") for n in group]))
    if made:
        values = [f"_f{k}" for k in range(len(computed))]
        stacked = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), made).where(F.coalesce(*values).isNotNull() & F.col("stock_id").isNotNull() & F.col("date").isNotNull())
        known = stacked.groupBy("stock_id", "date").agg(*[F.max(v).alias(v) for v in values]).select("stock_id", "date", F.struct("date", *values).alias("_known"), F.lit(0).alias("_own"))
        rows = panel.withColumn("_own", F.lit(1)).unionByName(known, allowMissingColumns=True).repartition("stock_id")
        before = W.partitionBy("stock_id").orderBy("date", "_own").rowsBetween(W.unboundedPreceding, 0)
        panel = rows.withColumn("_known", F.last("_known", ignorenulls=True).over(before)).where("_own = 1")
        panel = panel.withColumns({v: F.when(F.col("_known.date") == F.col("date"), F.col(f"_known.{v}")) for v in values}).drop("_known", "_own")
    for n in own:
        panel = REGISTRY[n].column(panel)
    more = {n: f"_f{computed.index(n)}" if n in computed else n for n in names if REGISTRY[n].compute}
    return ratio_scores(panel, [n for n in names if REGISTRY[n].expr], more)


def metadata(spark: SparkSession) -> DataFrame:
    """The registry as a table."""
    rows = [(f.name, f.sleeve, f.universe, f.neutralize, f.input_frame) for f in REGISTRY.values()]
    return spark.createDataFrame(rows, "factor string, sleeve string, universe string, neutralize boolean, input_frame string")
