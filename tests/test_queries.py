"""Registered queries against their SQL. All of them with MS_ALL=1, else a cross-section."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402
from marketspark.plans import load  # noqa: E402

SF = "/root/testdata/sf0.001"
SOME = """bar_1_ticks_to_bars bar_3_resample_bars win_3_rolling_quantile win_14_running win_18_max_consecutive ind_5_macd ind_8_vwap ta_12_three_bar_candles
fs_1_features_base rg_6_regime_stats sg_4b_breakout_retest_scored lb_1_triple_barrier lb_4_adaptive_two_sided lb_9_quantile_return jn_2_asof_join_closed jn_3_blackout_join
mt_1_trade_metrics mt_2_backtest_metrics mt_10_period_rollup tr_1_barrier_trades tr_3_compound_equity sc_6_vote_performance_weighted sz_2_trade_costs gt_1_guardrails gt_5_hard_gates
qa_1_audit_timestamps fsl_3_drop_collinear cv_1_walk_forward_splits rp_1_loss_breakdown rp_13_sentiment_by_symbol src_2_read_quotes snk_5_stamp_changes st_1_stream_bars st_4_suppress_duplicates
win_11_ema_sparse win_12_ema_adjusted_sparse mt_9_block_bootstrap st_2_live_features st_3_latest_upsert ml_2_robust_scaling""".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) > 200
    assert set(load()[0]) <= set(q)
    assert {k for k in load()[0] if k not in s} == {"ml_3_logistic", "ml_3_forest", "ml_3_boosted", "ml_4_stacking", "ml_5_walk_forward_evaluation",
                                            "ml_6_batch_scoring", "fsl_6_select_by_importance"}


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("MS_ALL") else SOME)
def test_query_matches_sql(spark, con, name):
    msg, _ = compare(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name])
    assert msg.startswith("ok"), msg


def test_entry_runs(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.flat_n + r.up_n + r.down_n == r.total for r in rows)


def test_bootstrap_is_reproducible(spark):
    a, b = (sorted(map(tuple, entry.queries()["mt_9_block_bootstrap"](spark, SF).collect())) for _ in range(2))
    assert a == b and a
