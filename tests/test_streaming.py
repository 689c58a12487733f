"""Streams fed file by file agree with batch, and late or repeated rows are handled."""

import datetime as dt
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from helpers import T0, bars, walk
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.operators.series import blocked
from marketspark.sources.sinks import latest_features
from marketspark.streaming import stateful as SF
from marketspark.streaming import stateless as SL


def feed(spark, df, path, parts, out, tmp, sink=None, run=None):
    """Append chunks to a folder and run the query after each."""
    for i, p in enumerate(parts):
        p.write.mode("append").parquet(path)
        src = spark.readStream.schema(df.schema).parquet(path)
        q = run(src) if run else src
        SL.run_available(q, out, str(tmp / "ckpt"), foreach=sink)
    return spark.read.parquet(out) if sink is None else None


def test_late_tick_is_dropped(spark, tmp_path):
    schema = "symbol string, ts timestamp, price double, id long"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    chunks = [[("S", at(5), 1.0, 1), ("S", at(50), 2.0, 2)], [("S", at(200), 3.0, 3)], [("S", at(30), 99.0, 4), ("S", at(400), 4.0, 5)], [("S", at(900), 5.0, 6)]]
    dfs = [spark.createDataFrame(c, schema) for c in chunks]
    out = feed(spark, dfs[0], str(tmp_path / "in"), dfs, str(tmp_path / "out"), tmp_path, run=lambda s: SL.stream_bars(s, "1H"))
    got = {r.bar_ts.hour: (r.open, r.high, r.close, r.volume) for r in out.collect()}
    assert got[0] == (1.0, 2.0, 2.0, 2.0) and got[3] == (3.0, 3.0, 3.0, 1.0) and got[6][0] == 4.0


@pytest.mark.parametrize("hours", [(0, 300), (0, 150, 230, 300), (0, 20, 40, 41, 45, 90, 160, 200, 250, 299, 300)])
def test_live_features_equal_batch(spark, tmp_path, hours):
    """Every bar's features, in one, three and ten triggers; two symbols, of which one is silent for a while."""
    a, b = bars(spark, walk(300)), bars(spark, walk(300, seed=2), symbol="S1").where("hour(bar_ts) < 12")
    df = a.union(b)
    t = F.col("bar_ts")
    edge = [T0 + dt.timedelta(hours=h) for h in hours]
    parts = [df.where((t >= F.lit(lo)) & (t < F.lit(hi))) for lo, hi in zip(edge, edge[1:])]
    features = lambda s: ind.rsi(ind.sma(s, 20), 14)
    every, latest = str(tmp_path / "every"), str(tmp_path / "latest")

    def sink(batch, batch_id):
        live = SL.live_features(batch, features, 60).persist()
        SL.change_sink(every, lambda _: live)(batch, batch_id)
        SL.change_sink(latest, lambda _: latest_features(live))(batch, batch_id)
        SL.change_sink(latest, lambda _: latest_features(live))(batch, batch_id)  # a replay
    feed(spark, df, str(tmp_path / "in"), parts, "", tmp_path, sink=sink, run=lambda s: SF.with_recent(s, 60))
    want = {(r.symbol, r.bar_ts): (r.sma20, r.rsi14) for r in features(blocked(df, back=60)).rows().collect()}
    got = {(r.symbol, r.bar_ts): (r.sma20, r.rsi14) for r in spark.read.parquet(every).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k] == pytest.approx(w, abs=1e-9) or (got[k][0] is None) == (w[0] is None) and got[k] == w
    now = SL.current(spark, latest).collect()
    assert {(r.symbol, r.bar_ts) for r in now} == {max(k for k in want if k[0] == s) for s in ("S0", "S1")}


def test_upserts_keep_the_newest_row_and_replays_do_no_harm(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame([("S0" if k == "a" else "S1", "1H", T0 + dt.timedelta(hours=h), v) for k, h, v in r], "symbol string, timeframe string, bar_ts timestamp_ntz, v int")
    sink = SL.change_sink(path, lambda b: b)
    sink(rows(("a", 0, 1), ("b", 0, 1)), 0)
    for _ in range(2):
        sink(rows(("b", 0, 2), ("a", -1, 9)), 1)
    assert {(r.symbol, r.v) for r in SL.current(spark, path).collect()} == {("S0", 1), ("S1", 2)}


@pytest.mark.parametrize("batches", [1, 3, 10])
@pytest.mark.parametrize("delay", [None, "1 hour"])
def test_duplicates_restart_at_each_kept_signal(spark, tmp_path, batches, delay):
    schema = "symbol string, timeframe string, ts timestamp, n int"
    rng = np.random.default_rng(batches)
    at = {("S", "5T"): (0, 10, 20, 31, 36, 200, 201, 216), ("T", "15T"): sorted(rng.choice(600, 60, replace=False).tolist()), ("U", "4H"): (5, 94, 95, 300)}
    rows = sorted((m, k) for k, ms in at.items() for m in ms)
    cut = np.array_split(np.arange(len(rows)), batches)
    dfs = [spark.createDataFrame([(*rows[i][1], T0 + dt.timedelta(minutes=rows[i][0]), rows[i][0]) for i in c], schema).repartition(2) for c in cut]
    out = feed(spark, dfs[0], str(tmp_path / "in"), dfs, str(tmp_path / "out"), tmp_path, run=lambda s: SF.suppress_duplicates(s, delay=delay))
    want = set()
    for k, ms in at.items():
        last = None
        for m in ms:
            if last is None or m >= last + SF.VALIDITY.get(k[1], SF.DEFAULT_VALIDITY):
                last = m
                want.add((*k, m))
    assert {(r.symbol, r.timeframe, r.n) for r in out.collect()} == want and out.count() == len(want)


def test_cooldown_and_open_position(spark, tmp_path):
    schema = "symbol string, timeframe string, ts timestamp, bar_index long, position_open boolean"
    rows = [("S", "1H", T0 + dt.timedelta(hours=i), i, i == 6) for i in (0, 3, 6, 7, 9, 12)]
    dfs = [spark.createDataFrame(rows[:3], schema), spark.createDataFrame(rows[3:], schema)]
    out = feed(spark, dfs[0], str(tmp_path / "in"), dfs, str(tmp_path / "out"), tmp_path, run=lambda s: SF.cooldown(s))
    assert {r.bar_index: r.veto for r in out.collect()} == {0: "", 3: "cooldown", 6: "position_open", 7: "", 9: "cooldown", 12: ""}


def test_drift_state_survives_batches(spark, tmp_path):
    schema = "symbol string, timeframe string, trade_id long, ts timestamp, pnl double"
    rows = [("S", "1H", i, T0 + dt.timedelta(hours=i), 10.0 if i % 3 else -25.0) for i in range(60)]
    one = spark.createDataFrame(rows, schema)
    parts = [spark.createDataFrame(rows[a:b], schema) for a, b in ((0, 7), (7, 33), (33, 60))]
    a = feed(spark, one, str(tmp_path / "a"), parts, str(tmp_path / "oa"), tmp_path / "x", run=lambda s: SF.drift_monitor(s)).orderBy("trade_id").collect()
    b = feed(spark, one, str(tmp_path / "b"), [one], str(tmp_path / "ob"), tmp_path / "y", run=lambda s: SF.drift_monitor(s)).orderBy("trade_id").collect()
    assert a == b and a[18].status == "insufficient_data" and a[19].rolling_pf is not None


def test_drift_monitor_holds_plain_numbers_and_lets_pieces_go():
    """a trigger's rows of a key take some 100 bytes each at most; before, whole frames with strings were held and joined."""
    rng, rows, size = np.random.default_rng(3), 400_000, 10_000
    order, pnl = rng.permutation(rows), rng.normal(0, 10, rows)
    state = SimpleNamespace(exists=False, get=None, update=lambda x: vars(state).update(exists=True, get=x))
    step = SF.drift_monitor(SimpleNamespace(groupBy=lambda *k: SimpleNamespace(applyInPandasWithState=lambda f, *a: f)))

    def chunks():
        for lo in range(0, rows, size):
            i = order[lo:lo + size]
            yield pd.DataFrame({"symbol": [f"S{0 * x}" for x in i], "timeframe": [f"{1 + 0 * x}H" for x in i], "trade_id": i, "ts": pd.Timestamp(T0) + pd.to_timedelta(i // 3, "min"), "pnl": pnl[i]})
    sizes, ids, pf, halted = [], [], [], []
    tracemalloc.start()
    for out in step(("S0", "1H"), chunks(), state):
        sizes.append(len(out))
        ids.append(out["trade_id"].to_numpy(np.int64))
        pf.append(out["rolling_pf"].to_numpy())
        halted.append(out["halted"].to_numpy())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert max(sizes) <= SF.PIECE and peak < 100 * rows + 30e6
    assert (np.concatenate(ids) == np.arange(rows)).all()
    w = np.lib.stride_tricks.sliding_window_view(pnl, 20)
    np.testing.assert_allclose(np.concatenate(pf)[19:], np.maximum(w, 0).sum(axis=1) / np.maximum(-w, 0).sum(axis=1), rtol=1e-9)
    eq = 100000 + np.cumsum(pnl)
    peaks = np.maximum.accumulate(np.concatenate([[100000], eq]))[1:]
    assert (np.concatenate(halted) == ((peaks - eq) / peaks * 100 > 6)).all() and len(state.get[0]) == 19


def test_drift_monitor_keeps_rows_without_time_id_or_result():
    state = SimpleNamespace(exists=False, get=None, update=lambda x: None)
    step = SF.drift_monitor(SimpleNamespace(groupBy=lambda *k: SimpleNamespace(applyInPandasWithState=lambda f, *a: f)), n=2)
    rows = pd.DataFrame({"symbol": "S", "timeframe": "1H", "trade_id": [4.0, np.nan, 2.0, 1.0], "ts": pd.to_datetime([None, "2024-01-01", "2024-01-01", "2024-01-02"]), "pnl": [1.0, 5.0, -5.0, np.nan]})
    out = next(iter(step(("S", "1H"), iter([rows]), state)))
    assert [None if x is pd.NA else int(x) for x in out["trade_id"]] == [2, None, 1, 4]
    assert out["status"].tolist() == ["insufficient_data", "warning", "insufficient_data", "insufficient_data"]
