"""Registered queries against their SQL, and the rules of registration."""

import os
from numbers import Number

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from quillon.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = "v15_lasso v16_selection r20_shortlist_history c9_quality_full p8_pit_slice_pruned r21_six_knobs r8_covariance_with_const j1_asof_hot_key w1_winsorize_sliced w18_average_rank_sliced w22_ema_sliced v3_rank_ic_residual v9_fama_macbeth_runs r17_ledger m11_headline v18_pre_trend c4_clean c8_delist_events j1_asof_fundamentals j1_asof_events j10_step_correction a9_periodic_returns w5_regularize w13_rolling_beta n4_nelson_siegel f1_ratio_factors v3_rank_ic v11_average_correlation r16_build_weights m9_performance w14_nim_rate_betas r11_risk_panel r17_book_accounting v9_pooled_fama_macbeth v17_twfe_did v18_event_study j12_factor_frame s7_manifest".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = ["" if x is None or pd.isna(x) else f"{float(x):.4f}" if isinstance(x, Number) else str(x)[:10] for x in df[c]]
    return sorted(map(tuple, df.values.tolist()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 80
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_training_data_operators():
    root = os.path.join(os.path.dirname(entry.__file__), "quillon")
    for folder, _, names in os.walk(root):
        if os.sep + "llm" not in folder:
            for n in names:
                if n.endswith(".py"):
                    assert "quillon.llm" not in open(os.path.join(folder, n)).read()
