"""The blocked window engine: exactness across block sizes, exponential averages, scans, quantiles."""

import numpy as np
import pandas as pd
import pytest
from helpers import bars, closes, column, walk
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.functions import ta
from marketspark.operators import features as FS
from marketspark.operators.order_stats import Wavelet
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.scan import range_bucketed, running
from marketspark.operators.series import blocked, ema_halo, span


@pytest.mark.parametrize("block", [64, 500, 1000])
def test_block_size_does_not_change_finite_windows(spark, block):
    df = bars(spark, walk(1500))
    out = []
    for b in (None, block):
        s = ind.bollinger(ind.rsi(ind.atr(blocked(df, back=130, fwd=10, block=b), 14), 14))
        s = s.add(nxt=s.lead("close", 7))
        out.append(s.rows().orderBy("bar_ts").select("atr14", "rsi14", "bb_width_pct", "nxt").toPandas())
    assert len(out[0]) == len(out[1]) == 1500
    np.testing.assert_allclose(out[0].to_numpy(float), out[1].to_numpy(float), rtol=1e-9, equal_nan=True)


def test_block_size_does_not_change_recursive_features(spark):
    df = bars(spark, walk(9000))
    a, b = (FS.base(blocked(df, back=FS.HALO, block=blk)).rows().orderBy("bar_ts").select("ema200", "macd_signal", "obv", "obv_ema", "adx", "vol_percentile").toPandas()
            for blk in (None, 2000))
    np.testing.assert_allclose(a.to_numpy(float), b.to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("n", [2, 3, 12, 50, 200, 233])
@pytest.mark.parametrize("adjust", [False, True])
def test_ema_matches_pandas(spark, n, adjust):
    rows = walk(3000, seed=n)
    s = blocked(bars(spark, rows), back=ema_halo(span(n)) + 1, block=1000)
    got = column(s.emas(adjust=adjust, dense=True, e=("close", span(n))).rows(), "e")
    want = pd.Series([r[3] for r in rows]).ewm(span=n, adjust=adjust).mean()
    np.testing.assert_allclose(got, want, rtol=1e-11)


@pytest.mark.parametrize("block", [64, 500, 65536])
def test_ema_through_gaps_matches_pandas(spark, block):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 5, 1200)
    x[rng.random(1200) < 0.2] = np.nan
    x[:3] = x[40:43] = np.nan
    df = closes(spark, x).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    s = blocked(df, back=2 * ema_halo(span(20)), block=block)
    s = s.emas(y=("close", span(20))).emas(adjust=True, z=("close", span(20)))
    got = s.select("y", "z").orderBy("bar_ts").toPandas()
    for name, adjust in (("y", False), ("z", True)):
        want = pd.Series(x).ewm(span=20, adjust=adjust).mean().to_numpy()
        np.testing.assert_allclose(got[name].to_numpy(float), want, rtol=1e-9)


@pytest.mark.parametrize("block", [128, 65536])
@pytest.mark.parametrize("adjust", [False, True])
def test_sparse_averages_carry_all_earlier_blocks(spark, block, adjust):
    """Densities of 1, 5 and 10 percent, spans up to 5,000, a halo of 10 rows: pandas has the whole series at hand."""
    rng = np.random.default_rng(7)
    n, spans = 20_000, (1, 2, 20, 200, 5000)
    x = {f"x{k}": np.where(rng.random(n) < k / 100, rng.normal(100, 5, n), np.nan) for k in (1, 5, 10)}
    x["x5"][:900] = x["x5"][9000:13000] = np.nan
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(n), **x}))
    df = df.select(F.lit("S").alias("symbol"), F.lit("1H").alias("timeframe"), F.timestamp_seconds(F.col("i") * 60).cast("timestamp_ntz").alias("bar_ts"), *(F.when(~F.isnan(c), F.col(c)).alias(c) for c in x))
    s = blocked(df, back=10, block=block).emas(adjust=adjust, **{f"{c}_{k}": (c, span(k)) for c in x for k in spans})
    got = s.rows().orderBy("bar_ts").toPandas()
    assert len(got) == n
    for c, v in x.items():
        for k in spans:
            want = pd.Series(v).ewm(span=k, adjust=adjust).mean()
            np.testing.assert_allclose(got[f"{c}_{k}"].to_numpy(float), want, rtol=1e-9, equal_nan=True, err_msg=f"{c} {k}")


def test_constant_stays_constant_on_a_sparse_column(spark):
    df = bars(spark, [(100, 100, 100, 100, i % 100 == 0) for i in range(4000)]).withColumn("x", F.when(F.col("volume") > 0, F.col("close")))
    got = column(blocked(df, back=500, block=128).emas(y=("x", span(200))).rows(), "y")
    np.testing.assert_allclose(got, 100.0, rtol=1e-12)


def test_kama_is_a_plain_recursion(spark):
    rows = walk(2500, seed=3)
    got = column(ta.kama(blocked(bars(spark, rows), back=40, block=70)).rows(), "kama_30")
    x = np.array([r[3] for r in rows])
    y, want = x[29], [None] * 30
    for t in range(30, len(x)):
        e = abs(x[t] - x[t - 30]) / np.abs(np.diff(x[t - 30:t + 1])).sum()
        y += (e * (2 / 3 - 2 / 31) + 2 / 31) ** 2 * (x[t] - y)
        want.append(y)
    assert got[:30] == want[:30]
    np.testing.assert_allclose(got[30:], want[30:], rtol=1e-10)


def test_long_means_match_pandas_through_nulls(spark):
    rows = walk(2000, seed=9)
    s = blocked(bars(spark, rows), back=210, block=300)
    s = s.add(x=F.when(F.col("volume") > 5, F.col("close")))
    s = s.add(m=R.mean(s, "x", 200, min_rows=20), t=R.total(s, "x", 50, end=-1, min_rows=1), f=R.mean(s, "close", 20))
    got = s.rows().orderBy("bar_ts").select("m", "t", "f").toPandas()
    c = pd.Series([r[3] for r in rows])
    x = c.where(pd.Series([r[4] for r in rows]) > 5)
    np.testing.assert_allclose(got.m, x.rolling(200, min_periods=20).mean(), rtol=1e-10, equal_nan=True)
    np.testing.assert_allclose(got.t, x.shift(1).rolling(50, min_periods=1).sum(), rtol=1e-10, equal_nan=True)
    np.testing.assert_allclose(got.f, c.rolling(20).mean(), rtol=1e-10, equal_nan=True)


@pytest.mark.parametrize("n", [65, 100, 200, 333])
def test_long_frames_leave_no_trace_of_what_is_outside(spark, n):
    rng = np.random.default_rng(n)
    x = rng.normal(50, 3, 1600)
    x[rng.random(1600) < 0.15] = np.nan
    x[200], x[201], x[700] = 1e17, -3e17, np.inf
    df = closes(spark, x).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    s = blocked(df, back=2 * n + 5, block=400)
    s = s.add(m=R.mean(s, "close", n, min_rows=3), t=R.total(s, "close", n, end=-2, min_rows=3), hi=R.high(s, "close", n, min_rows=1), lo=R.low(s, "close", n, end=-1, min_rows=n // 2), sd=R.std(s, "close", n), p=R.std_pop(s, "volume", n), z=R.mean(s, "close", n))
    got = s.rows().orderBy("bar_ts").select("m", "t", "hi", "lo", "p", "z").toPandas()
    for i in range(len(x)):
        def frame(end=0):
            w = x[max(i + end - n + 1, 0):max(i + end + 1, 0)]
            return w[~np.isnan(w)]
        w, t, lo = frame(), frame(-2), frame(-1)
        check = [("m", len(w) >= 3, lambda: w.mean()), ("t", len(t) >= 3, lambda: t.sum()), ("hi", len(w) >= 1, lambda: w.max()), ("lo", len(lo) >= n // 2, lambda: lo.min()), ("z", len(w) >= n, lambda: w.mean()), ("p", i >= n - 1, lambda: 0.0)]
        for name, full, want in check:
            assert (not np.isnan(got[name][i])) == full and (not full or got[name][i] == pytest.approx(want(), rel=1e-12)), (name, i)


def test_long_deviations_match_pandas(spark):
    rows = walk(1500, seed=4)
    s = blocked(bars(spark, rows), back=320, block=600)
    s = s.add(a=R.std(s, "close", 100), b=R.std(s, "close", 255), c=R.std_pop(s, "volume", 65), d=R.zscore(s, "volume", 128))
    got = s.rows().orderBy("bar_ts").select("a", "b", "c", "d").toPandas()
    c, v = pd.Series([r[3] for r in rows]), pd.Series([float(r[4]) for r in rows])
    want = {"a": c.rolling(100).std(), "b": c.rolling(255).std(), "c": v.rolling(65).std(ddof=0), "d": (v - v.rolling(128).mean()) / v.rolling(128).std()}
    for k, w in want.items():
        np.testing.assert_allclose(got[k], w, rtol=1e-8, equal_nan=True)


def test_prefix_stability(spark):
    """Features of the first rows do not change when later rows arrive."""
    rows = walk(800)
    full = FS.base(blocked(bars(spark, rows), back=FS.HALO)).rows().orderBy("bar_ts").limit(500).toPandas()
    part = FS.base(blocked(bars(spark, rows[:500]), back=FS.HALO)).rows().orderBy("bar_ts").toPandas()
    num = full.select_dtypes("number").columns
    np.testing.assert_allclose(full[num].to_numpy(float), part[num].to_numpy(float), rtol=1e-9, atol=1e-9, equal_nan=True)


def test_rsi_edges_and_short_series(spark):
    up = column(ind.rsi(blocked(closes(spark, range(100, 120)), back=15), 14).rows(), "rsi14")
    flat = column(ind.rsi(blocked(closes(spark, [100] * 20), back=15), 14).rows(), "rsi14")
    assert up[-1] == 100.0 and flat[-1] is None
    s = ind.bollinger(blocked(closes(spark, [1, 2, 3]), back=130))
    row = s.add(f=R.flag(F.col("bb_width_pct") < 0.2)).rows().first()
    assert row.bb_upper is None and row.f == 0


def ledger(spark, n=5000, days=40):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.9, "hot", "cold"), "day": rng.integers(0, days, n), "i": np.arange(n), "v": rng.normal(0, 10, n)})
    return spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds(F.col("day") * 86400).cast("timestamp_ntz")), pdf.sort_values(["day", "i"])


@pytest.mark.parametrize("n", [1, 7, 100, 700])
def test_moving_quantiles_and_ranks_match_pandas(spark, n):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 3, 2500), 1)  # many ties
    x[rng.random(2500) < 0.1] = np.nan
    x[[40, 41, 900]] = np.inf
    df = closes(spark, x).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    need = max(n // 2, 1)
    for block in (700, 65536):
        s = blocked(df, back=n + 5, block=block).add(twice=F.col("close") * 2)
        s = s.add(q=R.quantile(s, "close", n, 0.3, need), m=R.median(s, "twice", n, need), full=R.quantile(s, "close", n, 0.9), r=R.pct_rank(s, "close", n), b=R.frac_below(s, "close", n))
        s = s.add(diff=F.col("q") - F.col("full"), again=R.quantile(s, "q", 5, 0.5, 1))
        got = s.rows().orderBy("bar_ts").select("q", "m", "full", "r", "b", "again").toPandas()
        finite = pd.Series(np.where(np.isinf(x), 1e300, x))  # pandas leaves infinities out
        q = finite.rolling(n, min_periods=need).quantile(0.3)
        want = {"q": q, "m": (finite * 2).rolling(n, min_periods=need).median(), "full": finite.rolling(n).quantile(0.9), "r": finite.rolling(n).rank(pct=True),
                "b": finite.rolling(n).apply(lambda w: (w < w[-1]).mean(), raw=True), "again": q.rolling(5, min_periods=1).median()}
        for k, w in want.items():
            np.testing.assert_allclose(got[k], np.where(w > 1e290, np.inf, w), rtol=1e-12, atol=1e-12, equal_nan=True, err_msg=k)


def test_wavelet_counts_and_selects():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 5, 64, 300):
        x = np.round(rng.normal(0, 2, size), 1)
        w = Wavelet(x)
        lo = rng.integers(0, size + 1, 200)
        hi = np.maximum(lo, rng.integers(0, size + 1, 200))
        for a, b in zip(lo, hi):
            one = np.array([a]), np.array([b])
            for r in range(len(w.values) + 1):
                assert w.below(*one, np.array([r]))[0] == (w.rank[a:b] < r).sum()
            if b > a:
                assert [w.kth(*one, np.array([k]))[0] for k in range(b - a)] == sorted(x[a:b])


def test_running_scan_matches_pandas_and_range_buckets(spark):
    df, pdf = ledger(spark)
    kw = dict(sums={"s": F.col("v")}, maxes={"m": F.col("v")}, peaks={"p": "s"}, counts={"c": F.col("v") > 0}, lasts={"l": F.when(F.col("v") > 15, F.col("v"))})
    day = running(df, ["k"], ["ts", "i"], **kw).orderBy("i").toPandas()
    ranged = running(range_bucketed(df, ["k"], ["ts", "i"], 16), ["k"], ["ts", "i"], **kw).orderBy("i").toPandas()
    g = pdf.groupby("k")["v"]
    want = pd.DataFrame({"i": pdf.i, "s": g.cumsum(), "m": g.cummax(), "l": pdf.v.where(pdf.v > 15).groupby(pdf.k).ffill(), "c": (pdf.v > 0).astype(int).groupby(pdf.k).cumsum()})
    want["p"] = want.s.groupby(pdf.k).cummax()
    want = want.sort_values("i")
    for got in (day, ranged):
        for c in ("s", "m", "p", "c", "l"):
            np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, equal_nan=True)


def test_exact_quantiles_on_a_hot_key_with_ties(spark):
    rng = np.random.default_rng(2)
    big = np.concatenate([np.full(30000, 3.0), rng.normal(0, 5, 60000)])
    pdf = pd.DataFrame({"k": ["a"] * len(big) + ["b"] * 7, "v": np.concatenate([big, [1, 2, 3, 4, 5, 6, 100.0]])})
    qs = {"q01": 0.01, "q50": 0.5, "q60": 0.6, "q99": 0.99, "q0": 0.0, "q100": 1.0}
    for few in (50_000, 40):  # a small bound takes several rounds
        got = {r.k: r for r in exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", qs, few).collect()}
        for k, g in pdf.groupby("k"):
            for n, p in qs.items():
                assert got[k][n] == pytest.approx(np.quantile(g.v, p), rel=1e-12, abs=1e-12)
    whole = exact_quantiles(spark.createDataFrame(pdf), [], "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(np.quantile(pdf.v, 0.5))
