"""Hand-computed cases and invariants of the operators."""

import datetime as dt
import operator

import numpy as np
import pandas as pd
import pytest
from helpers import T0, bars, closes, column, walk
from pyspark.sql import functions as F

from marketspark.functions.sessions import in_hours
from marketspark.operators import bootstrap as BS
from marketspark.operators import comoments as CM
from marketspark.operators import joins as J
from marketspark.operators import labels as L
from marketspark.operators import metrics as M
from marketspark.operators import quality as QA
from marketspark.operators import selection as FSL
from marketspark.operators import setups as SG
from marketspark.operators import sizing as SZ
from marketspark.operators import trades as TR
from marketspark.operators.bars import market_open, ticks_to_bars
from marketspark.operators.series import blocked
from marketspark.schema import timeframe_seconds
from marketspark.sources import dims


def with_atr(df, a=1.0):
    return df.withColumn("atr14", F.lit(a))


def test_ticks_to_bars_prices_and_empty_buckets(spark):
    rows = [("S", T0 + dt.timedelta(minutes=m), b, a, p, 1.0, i) for i, (m, b, a, p) in enumerate([(0, 1.0, 3.0, 9.0), (5, None, None, 4.0), (59, 5.0, 7.0, None), (185, 1.0, 1.0, 1.0)])]
    t = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, bid double, ask double, price double, size double, id long")
    b = ticks_to_bars(t, "1H").orderBy("bar_ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in b] == [(2.0, 6.0, 2.0, 6.0, 3.0), (1.0, 1.0, 1.0, 1.0, 1.0)]
    assert ticks_to_bars(t, "1H", source="trade", volume="size").orderBy("bar_ts").first().open == 9.0
    assert timeframe_seconds("15T") == 900 and timeframe_seconds("4H") == 14400
    with pytest.raises(ValueError):
        timeframe_seconds("x")


def test_market_week(spark):
    days = [(dt.datetime(2024, 1, 5, 21), True), (dt.datetime(2024, 1, 5, 22), False), (dt.datetime(2024, 1, 6, 12), False), (dt.datetime(2024, 1, 7, 21), False), (dt.datetime(2024, 1, 7, 22), True)]
    df = spark.createDataFrame([(d,) for d, _ in days], "ts timestamp_ntz").withColumn("o", market_open(F.col("ts")))
    assert {r.ts: r.o for r in df.collect()} == dict(days)


def test_label_tie_goes_down_and_tail_is_zero(spark):
    rows = [(100, 100.5, 99.5, 100, 1)] + [(100, 110, 90, 100, 1)] * 11
    s = L.barrier_series(with_atr(bars(spark, rows)), 3)
    out = L.triple_barrier(s, 3, 2.0, 1.0).orderBy("bar_ts").collect()
    assert len(out) == 12 - 3
    assert out[0].target == 2 and out[0].sl_hit == 1 and out[0].expected_duration == 1
    assert (out[-1].target, out[-1].expected_return, out[-1].expected_duration) == (0, 0.0, 0)
    assert {r.target for r in out} <= {0, 1, 2}


def test_label_up_flat_and_block_size(spark):
    rows = [(100, 100.2, 99.8, 100, 1), (100, 100.5, 99.5, 100, 1), (100, 102.5, 99.8, 102, 1)] + [(102, 102.1, 101.9, 102, 1)] * 8
    df = with_atr(bars(spark, rows))
    out = L.triple_barrier(L.barrier_series(df, 3), 3, 2.0, 1.0).orderBy("bar_ts").collect()
    assert (out[0].target, out[0].expected_duration, round(out[0].expected_return, 6)) == (1, 2, 0.02)
    assert (out[3].target, out[3].expected_duration) == (0, 3)
    long = with_atr(bars(spark, walk(600)), 2.0)
    a, b = (L.triple_barrier(L.barrier_series(long, 6, block=blk), 6, 2.0, 1.0).orderBy("bar_ts").toPandas() for blk in (None, 50))
    assert a.target.tolist() == b.target.tolist() and len(a) == 594


def test_asof_sees_finished_bars_only(spark):
    low = closes(spark, range(10)).select("symbol", "bar_ts", "close")
    high = spark.createDataFrame([("S0", T0 + dt.timedelta(hours=4 * i), float(100 + i)) for i in range(3)], "symbol string, bar_ts timestamp_ntz, close double")
    for rows_per_task in (1, 10 ** 6):
        assert column(J.asof_join(low, high, rows_per_task=rows_per_task), "close_htf") == column(J.asof_join(low, high), "close_htf")
    open_ = column(J.asof_join(low, high), "close_htf")
    closed = column(J.asof_join(low, high, period_seconds=4 * 3600), "close_htf")
    assert open_ == [100.0] * 4 + [101.0] * 4 + [102.0] * 2
    assert closed == [None] * 4 + [100.0] * 4 + [101.0] * 2


def test_sessions_and_gate(spark):
    hours = spark.range(24).withColumn("i", in_hours(F.col("id"), 22, 7))
    assert [r.id for r in hours.where("i").orderBy("id").collect()] == [0, 1, 2, 3, 4, 5, 6, 22, 23]
    df = closes(spark, range(1, 25)).withColumns({"regime": F.when(F.hour("bar_ts") == 8, "Range").otherwise("Trend"), "atr14": F.lit(1.0)})
    r = {x.bar_ts.hour: x.reason for x in SG.strategy_gate(df, SG.Gate(("Trend",))).collect()}
    assert r[8] == "regime" and r[3] == "session" and r[12] == "ok"


def test_sizing_and_costs(spark):
    df = spark.createDataFrame([("S", "BUY", 100.0, 99.9), ("S", "BUY", 100.0, 50.0), ("S", "HOLD", 100.0, 99.0)], "symbol string, signal string, entry_price double, sl_price double")
    out = SZ.position_size(df, 10000.0).orderBy("sl_price").collect()
    by = {r.sl_price: r for r in out}
    assert by[99.9].position_value == 1000.0 and by[99.9].position_size == 10.0
    assert by[50.0].position_size == pytest.approx(2.0) and by[99.0].position_size == 0
    t = J.with_costs(spark.createDataFrame([("XAUUSD", d, 2000.0, 10000.0) for d in ("long", "short")], "symbol string, direction string, p double, n double"), dims.costs(spark))
    c = {r.direction: r for r in SZ.with_trade_costs(t, "p", "p", "n").collect()}
    assert c["long"].adjusted_entry > 2000 > c["long"].adjusted_exit and c["short"].adjusted_entry < 2000 < c["short"].adjusted_exit
    with pytest.raises(Exception, match="no costs for NOPE"):
        J.with_costs(spark.createDataFrame([("NOPE",)], "symbol string"), dims.costs(spark)).select("spread_pips").collect()


def trades(spark, pnls):
    rows = [("S", "1H", T0 + dt.timedelta(hours=9 * i), i, float(p), "tp" if p > 0 else "sl", 3) for i, p in enumerate(pnls)]
    return spark.createDataFrame(rows, "symbol string, timeframe string, exit_time timestamp_ntz, trade_id long, pnl double, exit_reason string, bars_held int")


def test_metrics_edges(spark):
    k = ["symbol", "timeframe"]
    streak = M.max_consecutive(trades(spark, [1, -1, -1, -1, 2, -1]), k, ["exit_time", "trade_id"], F.col("pnl") < 0)
    assert streak.first().max_consecutive == 3
    wins = trades(spark, [10, 20, 30])
    assert M.trade_metrics(wins).first().profit_factor == 60.0 and M.backtest_metrics(wins).first().profit_factor == 60.0
    m = M.trade_metrics(trades(spark, [1000, -500, -700, 3000, -100, 50])).first()
    assert m.max_drawdown_pct == pytest.approx(1.2) and m.total_trades == 6
    curve = M.equity_curve(trades(spark, [-1000, 2000, -3000])).orderBy("trade_id").collect()
    assert [round(r.drawdown_pct, 6) for r in curve] == [1.0, 0.0, round(3000 / 101000 * 100, 6)]
    assert M.max_drawdown(trades(spark, [-5, 1]), k, ["exit_time"], F.col("pnl"), start=0.0).first().max_drawdown == 5.0


def test_deviation_keeps_its_digits_at_a_large_mean(spark):
    t = trades(spark, [1e8 + (1 if i % 2 else -1) for i in range(200)])
    assert M.trade_metrics(t).first().sharpe_ratio == pytest.approx(1e8, rel=1e-6)
    own = t.withColumn("return_pct", F.when(F.col("pnl") > 1e8, 3.0).otherwise(1.0))
    assert M.trade_metrics(own).first().sharpe_ratio == pytest.approx(2.0)


@pytest.mark.parametrize("held", [2_000_000, 0])
def test_bootstrap_equals_plain_loops_and_keeps_short_keys(spark, held):
    rng = np.random.default_rng(4)
    pnls, rets = rng.normal(20, 900, 5300), rng.normal(0, 0.01, 5300)
    rows = [("S", T0 + dt.timedelta(hours=9 * i), i, float(p), float(r)) for i, (p, r) in enumerate(zip(pnls, rets))] + [("T", T0, i, 1.0, 0.1) for i in range(10)]
    t = spark.createDataFrame(rows, "symbol string, exit_time timestamp_ntz, trade_id long, pnl double, return_pct double")
    got = {r.symbol: r for r in M.block_bootstrap(t, sims=40, held=held).collect()}
    assert got["T"].sims == 0 and got["T"].pf_mean is None and got["S"].sims == 40
    starts = {(s, b): BS.start(s, b, 5290, 7, operator.xor, operator.rshift) for s in range(40) for b in range(530)}
    counts = np.bincount([x // 529 for x in starts.values()], minlength=10)
    assert ((counts - 2120) ** 2 / 2120).sum() < 28  # even over tenths of the trades: chi-squared of 9, one in a thousand
    pf, sharpe, dd = [], [], []
    for s in range(40):
        at = np.concatenate([np.arange(starts[s, b], starts[s, b] + 10) for b in range(530)])
        p, r = pnls[at], rets[at]
        total = np.cumsum(p)
        pf.append(p[p > 0].sum() / -p[p < 0].sum())
        sharpe.append(r.mean() / r.std())
        dd.append((np.maximum.accumulate(total) - total).max() / 1000)
    want = [np.mean(pf), np.std(pf), np.percentile(pf, 5), np.percentile(pf, 95), np.mean(sharpe), np.mean(dd), np.percentile(dd, 95)]
    np.testing.assert_allclose([got["S"][k] for k in ("pf_mean", "pf_std", "pf_5th", "pf_95th", "sharpe_mean", "dd_mean", "dd_95th")], want, rtol=1e-9)


def test_bootstrap_of_long_keys_broadcasts_no_draws(spark):
    """300,000 draws of two long keys; a broadcast of more than 4 MB would fail here, as it fails a driver at size."""
    rng = np.random.default_rng(5)
    rows = [(k, T0 + dt.timedelta(hours=i), i, float(p), None if k == "T" and i % 7 == 0 else float(p) / 1e4) for k in ("S", "T") for i, p in enumerate(rng.normal(20, 900, 3003))]
    t = spark.createDataFrame(rows, "symbol string, exit_time timestamp_ntz, trade_id long, pnl double, return_pct double")
    want = sorted(map(tuple, M.block_bootstrap(t, sims=500).collect()))
    spark.conf.set("spark.sql.maxBroadcastTableSize", "4m")
    try:
        got = sorted(map(tuple, M.block_bootstrap(t, sims=500, held=100).collect()))
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    assert [r[:2] for r in got] == [("S", 500), ("T", 500)] and len(want) == 2
    np.testing.assert_allclose([r[2:] for r in got], [r[2:] for r in want], rtol=1e-12)


def test_winsorize_many_features_in_one_pass(spark):
    names = [f"f{i}" for i in range(60)]
    df = spark.range(300).select(F.lit("A").alias("symbol"), F.lit("1H").alias("timeframe"), "id", *((F.col("id") * (i + 1)).cast("double").alias(n) for i, n in enumerate(names)))
    r = QA.winsorize_quantile(df, names).orderBy("id").toPandas()
    for i in (0, 31, 59):
        x = pd.Series(np.arange(300) * float(i + 1))
        np.testing.assert_allclose(r[f"f{i}"], x.clip(x.quantile(0.01), x.quantile(0.99)))


def test_stop_comes_before_target_in_trades(spark):
    rows = [(100, 101, 99, 100, 1)] * 20 + [(100, 140, 60, 100, 1)] * 60
    sig = spark.createDataFrame([("EURUSD", "1H", T0 + dt.timedelta(hours=19), "long", 0.9)], "symbol string, timeframe string, bar_ts timestamp_ntz, direction string, confidence double")
    t = TR.barrier_trades(bars(spark, rows, symbol="EURUSD"), sig, dims.costs(spark), dims.tp_sl(spark)).first()
    assert t.exit_reason == "sl" and t.bars_held == 0 and t.pnl < t.gross_pnl < 0


def test_strategy_registry_checks_inputs(spark):
    s = blocked(closes(spark, range(30)), back=5)
    with pytest.raises(ValueError, match="missing columns"):
        SG.run_strategy(s, "momentum_breakout")
    SG.register("noop_test", SG.RuleStrategy(lambda x: x.add(flag1=F.lit(1)), ("close",), ("flag1",)))
    assert SG.run_strategy(s, "noop_test").has("flag1")
    with pytest.raises(ValueError, match="exists"):
        SG.register("noop_test", SG.REGISTRY["noop_test"])


def test_asof_join_of_one_day_in_many_ranges(spark):
    """All rows on one day, most of one key; ranges of a few rows, keys over many ranges, keys without a right side."""
    rng = np.random.default_rng(3)
    n = 3000
    left = pd.DataFrame({"k": rng.choice(["a", "b", "c", "d"], n, p=[0.9, 0.05, 0.03, 0.02]), "t": rng.integers(0, 80_000, n), "v": np.arange(n)})
    right = pd.DataFrame({"k": rng.choice(["a", "b", "d", "e"], 60, p=[0.2, 0.4, 0.2, 0.2]), "t": rng.choice(80_000, 60, replace=False), "w": rng.normal(0, 1, 60), "v": 1})
    right.loc[::7, "w"] = np.nan  # a null on the right is carried like any value
    stamp = lambda d: spark.createDataFrame(d).withColumn("t", F.timestamp_seconds(F.col("t") + 86400 * 10000).cast("timestamp_ntz")).withColumn("w", F.when(~F.isnan("w"), F.col("w"))) if "w" in d else spark.createDataFrame(d).withColumn("t", F.timestamp_seconds(F.col("t") + 86400 * 10000).cast("timestamp_ntz"))
    want = pd.merge_asof(left.sort_values("t", kind="stable"), right.sort_values("t"), on="t", by="k", suffixes=("", "_htf"))
    want = {r.v: (None if r.v_htf != r.v_htf else 1, None if r.w != r.w else r.w) for r in want.itertuples()}
    for rows_per_task in (40, 10 ** 6):
        got = J.asof_join(stamp(left), stamp(right), ["k"], "t", rows_per_task=rows_per_task).collect()
        assert len(got) == n and {r["v"]: (r["v_htf"], r["w"]) for r in got} == want
    nulls = spark.createDataFrame([(None, 5, 1), ("a", None, 2), ("a", 5, 3)], "k string, s long, v long").select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("t"), "v")
    got = {r["v"]: r["x"] for r in J.asof_join(nulls, nulls.withColumnRenamed("v", "x"), ["k"], "t").collect()}
    assert got == {1: None, 2: None, 3: 3}
    assert J.asof_join(nulls.limit(0), nulls, ["k"], "t").collect() == []


def test_correlations_of_many_columns_in_one_reading(spark, monkeypatch):
    """More columns than a tile, pairwise gaps, large means, constants; a hot key over many tasks."""
    monkeypatch.setattr(CM, "HELD", 10)
    rng = np.random.default_rng(8)
    n, p = 900, 150
    base = rng.normal(0, 1, (n, 5))
    x = base[:, rng.integers(0, 5, p)] + rng.normal(0, 0.7, (n, p)) + np.where(np.arange(p) % 10 == 0, 1e8, 0)
    x[rng.random((n, p)) < 0.1] = np.nan
    x[:, 7] = 0.1
    x[:, 8] = np.nan
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(p)]).assign(k=np.where(np.arange(n) < 700, "hot", "cold"))
    df = spark.createDataFrame(pdf).select("k", *(F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")).alias(f"c{i}") for i in range(p))).repartition(6)
    got = CM.correlations(df, [f"c{i}" for i in range(p)], ["k"]).toPandas()
    assert len(got) == 2 * p * (p - 1) // 2
    for k, g in got.groupby("k"):
        own = pdf[pdf.k == k].drop(columns="k")
        want = own.corr()
        a, b = g.a.str[1:].astype(int), g.b.str[1:].astype(int)
        assert (a < b).all()
        w = want.to_numpy()[a, b]
        w[(a == 7) | (b == 7)] = np.nan
        np.testing.assert_allclose(g["corr"], w, atol=1e-7, equal_nan=True)
        has = own.notna().to_numpy().astype(int)
        np.testing.assert_array_equal(g.n, (has.T @ has)[a, b])
    assert CM.correlations(df.limit(0), ["c0", "c1"], ["k"]).collect() == []
    one = FSL.collinear(df, ["c1"], 0.5, ["k"]).collect()
    assert {(r["k"], r["feature"], r["keep"]) for r in one} == {("hot", "c1", True), ("cold", "c1", True)}
