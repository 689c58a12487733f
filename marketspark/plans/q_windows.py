"""Window building blocks and single indicators over hourly bars."""

from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.operators.series import blocked, ema_halo, span
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.registry import query

BARS = I.SQL_BARS


def rounded(s, cols, n=6):
    """Keys and the named columns, doubles rounded."""
    return s.select(*(F.round(F.col(c).cast("double"), n).alias(c) for c in cols.split())).drop("timeframe")


def bars(spark, sf, back, fwd=0):
    return blocked(I.bars(spark, sf), back=back, fwd=fwd)


FS1_HALO = ema_halo(span(200)) + 200


@query("win_1_changes", q.chain(BARS, "bars", {
    "change_1": q.pct("close", 1), "change_5": q.pct("close", 5), "diff_1": f"close - {q.lag('close')}",
    "log_return": f"ln(close / {q.lag('close')})"}, out=q.outs("change_1 change_5 diff_1 log_return")))
def win_1(spark, sf):
    s = bars(spark, sf, 5)
    s = s.add(change_1=R.pct_change(s, "close", 1), change_5=R.pct_change(s, "close", 5),
              diff_1=R.diff(s, "close"), log_return=R.log_return(s, "close"))
    return rounded(s, "change_1 change_5 diff_1 log_return")


EMA_COLS = "ema10 ema20 ema50 ema100 ema200"


@query("win_11_ema", q.chain(BARS, "bars", {f"ema{n}": q.ema("close", q.sp(n)) for n in (10, 20, 50, 100, 200)},
                             out=q.outs(EMA_COLS)))
def win_11(spark, sf):
    s = bars(spark, sf, FS1_HALO)
    return rounded(s.emas(dense=True, **{f"ema{n}": ("close", span(n)) for n in (10, 20, 50, 100, 200)}), EMA_COLS)


@query("ind_13_obv", q.chain(BARS, "bars", {"sv": f"sign(close - {q.lag('close')}) * volume"},
    {"obv": f"CASE WHEN sv IS NOT NULL THEN sum(sv) OVER ({q.PART}) END"},
    {"obv_ema": q.ema_adj("obv", q.sp(20))}, out=q.outs("obv obv_ema")))
def ind_13(spark, sf):
    return rounded(ind.obv(bars(spark, sf, FS1_HALO)), "obv obv_ema")


def simple(name, back, cols, steps, fwd=0):
    """Register a query over hourly bars: ``fn(series) -> series`` against a chain of SQL steps."""
    def deco(fn):
        @query(name, q.chain(BARS, "bars", *steps, out=q.outs(cols)))
        def run(spark, sf):
            return rounded(fn(bars(spark, sf, back, fwd)), cols)
        return run
    return deco


RET = {"r": q.pct("close", 1)}


@simple("win_2_rolling_stats", 50, "mean20 sum20 min20 max20 std20 mean_min5", [{
    "mean20": q.mean("close", 20), "sum20": q.total("volume", 20), "min20": q.lo("low", 20), "max20": q.hi("high", 20),
    "std20": q.std("close", 20), "mean_min5": q.mean("close", 50, min_rows=5)}])
def win_2(s):
    return s.add(mean20=R.mean(s, "close", 20), sum20=R.total(s, "volume", 20), min20=R.low(s, "low", 20),
                 max20=R.high(s, "high", 20), std20=R.std(s, "close", 20), mean_min5=R.mean(s, "close", 50, min_rows=5))


@simple("win_3_rolling_quantile", 100, "med100 q60 q90 med_min20", [{
    "med100": q.quant("close", 100, 0.5), "q60": q.quant("close", 100, 0.6), "q90": q.quant("volume", 60, 0.9),
    "med_min20": q.quant("close", 100, 0.5, 20)}])
def win_3(s):
    return s.add(med100=R.median(s, "close", 100), q60=R.quantile(s, "close", 100, 0.6),
                 q90=R.quantile(s, "volume", 60, 0.9), med_min20=R.median(s, "close", 100, 20))


@simple("win_4_rolling_pct_rank", 120, "rank100 rank_vol120",
        [{"rank100": q.prank("close", 100), "rank_vol120": q.prank("volume", 120)}])
def win_4(s):
    return s.add(rank100=R.pct_rank(s, "close", 100), rank_vol120=R.pct_rank(s, "volume", 120))


@simple("win_5_frac_below", 100, "below100", [{"below100": f"""(CASE WHEN count(close) {q.over(100)} = 100 THEN
 len(list_filter(list(close) {q.over(100)}, lambda v: v < close)) / 100.0 END)"""}])
def win_5(s):
    return s.add(below100=R.frac_below(s, "close", 100))


@simple("win_6_skew_kurt", 55, "skew50 kurt50",
        [RET, {"skew50": q.roll("skewness", "r", 50), "kurt50": q.roll("kurtosis", "r", 50)}])
def win_6(s):
    s = s.add(r=R.pct_change(s, "close", 1))
    return s.add(skew50=R.skew(s, "r", 50), kurt50=R.kurt(s, "r", 50))


@simple("win_7_rolling_corr", 25, "corr20",
        [RET, {"corr20": f"(CASE WHEN count(r) {q.over(20)} = 20 THEN corr(r, volume) {q.over(20)} END)"}])
def win_7(s):
    s = s.add(r=R.pct_change(s, "close", 1))
    return s.add(corr20=R.corr(s, "r", "volume", 20))


@simple("win_8_rolling_autocorr", 60, "ac1 ac3 ac5",
        [RET, {f"r{k}": q.lag("r", k) for k in (1, 3, 5)},
         {f"ac{k}": f"(CASE WHEN count(r) {q.over(50)} = 50 THEN corr(r, r{k}) {q.over(50 - k)} END)" for k in (1, 3, 5)}])
def win_8(s):
    s = s.add(r=R.pct_change(s, "close", 1))
    s = s.add(**{f"r{k}": s.lag("r", k) for k in (1, 3, 5)})
    return s.add(**{f"ac{k}": F.when(F.count("r").over(s.w(50)) == 50, R.corr(s, "r", f"r{k}", 50 - k))
                    for k in (1, 3, 5)})


@simple("win_9_rolling_zscore", 125, "vol_z volume_z",
        [RET, {"vol20": q.std("r", 20)}, {"vol_z": f"((vol20 - {q.mean('vol20', 100)}) / nullif({q.std('vol20', 100)}, 0))",
               "volume_z": f"((volume - {q.mean('volume', 20)}) / nullif({q.std('volume', 20)}, 0))"}])
def win_9(s):
    s = s.add(r=R.pct_change(s, "close", 1))
    s = s.add(vol20=R.std(s, "r", 20))
    return s.add(vol_z=R.zscore(s, "vol20", 100), volume_z=R.zscore(s, "volume", 20))


@simple("win_10_any_count", 15, "any10 count10",
        [{"up": q.flag(f"close > {q.lag('close')}"), "big": q.flag("volume > 6")},
         {"any10": q.flag(f"{q.hi('big', 10)} = 1"), "count10": q.total("up", 10)}])
def win_10(s):
    s = s.add(up=R.flag(F.col("close") > s.lag("close")), big=R.flag(F.col("volume") > 6))
    return s.add(any10=R.any_of(s, "big", 10), count10=R.count_of(s, "up", 10))


@simple("win_12_ema_adjusted", FS1_HALO, "ema12a ema26a ema200a",
        [{f"ema{n}a": q.ema_adj("close", q.sp(n)) for n in (12, 26, 200)}])
def win_12(s):
    return s.emas(adjust=True, dense=True, **{f"ema{n}a": ("close", span(n)) for n in (12, 26, 200)})


def sql_gaps(cols: str) -> str:
    """Bars whose close is missing on a fifth of the rows, as ``x``, with its row ``i`` and that of the value before."""
    up = f"({q.PART} ROWS UNBOUNDED PRECEDING)"
    return f"""WITH {BARS}, gx AS (SELECT *, CASE WHEN volume % 5 <> 0 THEN close END AS x, row_number() OVER ({q.PART}) AS i FROM bars),
gq AS (SELECT *, max(CASE WHEN x IS NOT NULL THEN i END) OVER ({q.PART} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS qi FROM gx)
SELECT symbol, bar_ts, {cols.format(up=up)} FROM gq"""


def _gap_ema(n: int) -> str:
    a = repr(q.sp(n))
    p = f"power(1 - {a}, i - qi)"
    v = f"{{{{'y': x, 'k': CASE WHEN qi IS NULL THEN 0 ELSE {p} / ({p} + {a}) END}}}}"
    return q.r6(f"struct_extract(list_reduce(list({v}) FILTER (x IS NOT NULL) OVER {{up}}, lambda y, v: {{{{'y': y.y * v.k + v.y * (1 - v.k), 'k': v.k}}}}), 'y')") + f" AS ema{n}"


def _gap_ema_adjusted(n: int) -> str:
    w = f"power(1 - {q.sp(n)!r}, -i)"
    return q.r6(f"sum(x * {w}) OVER {{up}} / sum(CASE WHEN x IS NOT NULL THEN {w} END) OVER {{up}}") + f" AS ema{n}a"


def gapped(spark, sf):
    """The same bars in blocks of 128 rows, so that most averages are carried over borders."""
    b = I.bars(spark, sf).withColumn("x", F.when(F.col("volume") % 5 != 0, F.col("close")))
    return blocked(b, back=2 * ema_halo(span(26)), block=128)


@query("win_11_ema_gaps", sql_gaps(", ".join(_gap_ema(n) for n in (10, 26))))
def win_11_gaps(spark, sf):
    return rounded(gapped(spark, sf).emas(ema10=("x", span(10)), ema26=("x", span(26))), "ema10 ema26")


def sparse(spark, sf):
    """The same bars with a close on one row in 20, in blocks of 128 rows and a halo of one row."""
    b = I.bars(spark, sf).withColumn("x", F.when(F.col("high") * 100 % 20 < 1, F.col("close")))
    return blocked(b, back=1, block=128)


SPARSE = (20, 200, 1000)


@query("win_11_ema_sparse", sql_gaps(", ".join(_gap_ema(n) for n in SPARSE)).replace("volume % 5 <> 0", "high * 100 % 20 < 1"))
def win_11_sparse(spark, sf):
    return rounded(sparse(spark, sf).emas(**{f"ema{n}": ("x", span(n)) for n in SPARSE}), " ".join(f"ema{n}" for n in SPARSE))


@query("win_12_ema_adjusted_sparse", sql_gaps(", ".join(_gap_ema_adjusted(n) for n in SPARSE)).replace("volume % 5 <> 0", "high * 100 % 20 < 1"))
def win_12_sparse(spark, sf):
    return rounded(sparse(spark, sf).emas(adjust=True, **{f"ema{n}a": ("x", span(n)) for n in SPARSE}), " ".join(f"ema{n}a" for n in SPARSE))


@query("win_12_ema_adjusted_gaps", sql_gaps(", ".join(_gap_ema_adjusted(n) for n in (12, 26))))
def win_12_gaps(spark, sf):
    return rounded(gapped(spark, sf).emas(adjust=True, ema12a=("x", span(12)), ema26a=("x", span(26))), "ema12a ema26a")


@simple("win_13_wilder", FS1_HALO, "wilder14 wilder7", [{f"wilder{n}": q.ema("close", 1 / n) for n in (14, 7)}])
def win_13(s):
    return ind.wilder(s, dense=True, wilder14=("close", 14), wilder7=("close", 7))


@simple("win_15_ffill", 10, "filled filled_full",
        [{"spike": "CASE WHEN volume > 6 THEN high END"},
         {"filled": f"last_value(spike IGNORE NULLS) {q.over(7)}", "filled_full": f"coalesce(spike, last_value(spike IGNORE NULLS) {q.over(4)}, -1)"}])
def win_15(s):
    s = s.add(spike=F.when(F.col("volume") > 6, F.col("high")))
    return s.add(filled=R.ffill(s, "spike", 6), filled_full=F.coalesce(R.ffill(s, "spike", 3), F.lit(-1.0)))


@simple("win_16_bars_since_high", 50, "since", [{"since": f"""(CASE WHEN count(close) {q.over(50)} = 50 THEN
 50 - list_position(list(close) {q.over(50)}, max(close) {q.over(50)}) END)"""}])
def win_16(s):
    return s.add(since=R.bars_since_high(s, "close", 50))


@simple("win_17_crosses", 55, "up down",
        [{"fast": q.mean("close", 10), "slow": q.mean("close", 50)},
         {"up": q.flag(f"fast > slow AND {q.lag('fast')} <= {q.lag('slow')}"),
          "down": q.flag(f"fast < slow AND {q.lag('fast')} >= {q.lag('slow')}")}])
def win_17(s):
    s = s.add(fast=R.mean(s, "close", 10), slow=R.mean(s, "close", 50))
    return s.add(up=R.crosses_above(s, "fast", "slow"), down=R.crosses_below(s, "fast", "slow"))


@simple("win_19_linear_fit", 60, "beta slope intercept angle forecast",
        [{"r": q.pct("close", 1), "rv": q.pct("volume", 1), "i": f"CAST(row_number() OVER ({q.PART}) - 1 AS DOUBLE)"},
         {"beta": f"(CASE WHEN count(r) {q.over(20)} = 20 AND var_pop(rv) {q.over(20)} > 0 THEN covar_pop(r, rv) {q.over(20)} / var_pop(rv) {q.over(20)} END)",
          "slope": f"(CASE WHEN count(close) {q.over(14)} = 14 THEN regr_slope(close, i) {q.over(14)} END)",
          "m": f"avg(close) {q.over(14)}"},
         {"intercept": "m - slope * 6.5", "angle": "degrees(atan(slope))", "forecast": "m - slope * 6.5 + slope * 14"}])
def win_19(s):
    s = s.add(r=R.pct_change(s, "close", 1), rv=R.pct_change(s, "volume", 1), **{
        k: v for k, v in zip(("slope", "intercept", "angle", "_e", "forecast"), R.slope(s, "close", 14).values())})
    w = s.w(20)
    return s.add(beta=F.when(F.count("r").over(w) == 20,
                             R.div(F.covar_pop("r", "rv").over(w), F.var_pop("rv").over(w))))


# ---- indicators -------------------------------------------------------------------------
TR = {"pc": q.lag("close"), "trange": f"greatest(high - low, abs(high - {q.lag('close')}), abs(low - {q.lag('close')}))"}
ATR = {"atr14": q.mean("trange", 14), "atr20": q.mean("trange", 20)}


@simple("ind_1_atr", 20, "trange atr14 atr14_pct", [TR, ATR, {"atr14_pct": "atr14 / close"}])
def ind_1(s):
    return ind.atr(s, 14)


@simple("ind_2_ema_dist", FS1_HALO, " ".join(f"ema{n} ema{n}_dist" for n in (10, 20, 50, 100, 200)),
        [{f"ema{n}": q.ema("close", q.sp(n)) for n in (10, 20, 50, 100, 200)},
         {f"ema{n}_dist": f"(close - ema{n}) / close" for n in (10, 20, 50, 100, 200)}])
def ind_2(s):
    return ind.ema(s, 10, 20, 50, 100, 200)


@simple("ind_3_sma", 50, "sma10 sma50 sma10_dist sma50_dist close_vs_sma10",
        [{"sma10": q.mean("close", 10), "sma50": q.mean("close", 50)},
         {"sma10_dist": "(close - sma10) / close", "sma50_dist": "(close - sma50) / close",
          "close_vs_sma10": "(close - sma10) / sma10"}])
def ind_3(s):
    return ind.sma(s, 10, 50)


GL = {"gain": f"CASE WHEN close - {q.lag('close')} > 0 THEN close - {q.lag('close')} ELSE 0 END",
      "loss": f"CASE WHEN close - {q.lag('close')} < 0 THEN {q.lag('close')} - close ELSE 0 END"}


def sql_rsi(n):
    g, lo = q.mean("gain", n), q.mean("loss", n)
    return f"(CASE WHEN {lo} > 0 THEN 100 - 100 / (1 + {g} / {lo}) WHEN {g} > 0 THEN 100.0 END)"


@simple("ind_4_rsi", 25, "rsi7 rsi14 rsi21 rsi14_oversold rsi14_overbought",
        [GL, {f"rsi{n}": sql_rsi(n) for n in (7, 14, 21)},
         {"rsi14_oversold": q.flag("rsi14 < 30"), "rsi14_overbought": q.flag("rsi14 > 70")}])
def ind_4(s):
    return ind.rsi(s, 7, 14, 21)


def sql_macd(ema):
    return [{"macd": f"{ema('close', q.sp(12))} - {ema('close', q.sp(26))}"}, {"macd_signal": ema("macd", q.sp(9))},
            {"macd_hist": "macd - macd_signal", "macd_positive": q.flag("macd > 0"),
             "macd_cross_up": q.flag(f"macd > macd_signal AND {q.lag('macd')} <= {q.lag('macd_signal')}")}]


MACD_COLS = "macd macd_signal macd_hist macd_positive macd_cross_up"


@simple("ind_5_macd", FS1_HALO, MACD_COLS, sql_macd(q.ema))
def ind_5(s):
    return ind.macd(s)


@simple("ind_5_macd_adjusted", FS1_HALO, MACD_COLS, sql_macd(q.ema_adj))
def ind_5a(s):
    return ind.macd(s, adjust=True)


BB = [{"bb_middle": q.mean("close", 20), "sd": q.std("close", 20)},
      {"bb_upper": "bb_middle + 2 * sd", "bb_lower": "bb_middle - 2 * sd"},
      {"bb_width": "(bb_upper - bb_lower) / bb_middle", "bb_pct": "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)"}]


@simple("ind_6_bollinger", 125, "bb_upper bb_middle bb_lower bb_width bb_pct bb_width_pct",
        [*BB, {"bb_width_pct": q.prank("bb_width", 100)}])
def ind_6(s):
    return ind.bollinger(s)


DON = [{"donchian_high": q.hi("high", 20, -1), "donchian_low": q.lo("low", 20, -1)},
       {"donchian_mid": "(donchian_high + donchian_low) / 2", "donchian_width": "(donchian_high - donchian_low) / close"}]


@simple("ind_7_donchian", 25, "donchian_high donchian_low donchian_mid donchian_width", DON)
def ind_7(s):
    return ind.donchian(s)


VWAP = [{"tpv": "(high + low + close) / 3 * volume"},
        {"vwap": f"{q.total('tpv', 100)} / nullif({q.total('volume', 100)}, 0)"}, {"vwap_dist": "(close - vwap) / close"}]


@simple("ind_8_vwap", 100, "vwap vwap_dist vwap_cum",
        [*VWAP, {"vwap_cum": f"sum(tpv) OVER ({q.PART}) / nullif(sum(volume) OVER ({q.PART}), 0)"}])
def ind_8(s):
    return ind.vwap_cumulative(ind.vwap(s))


DM = [TR, {"up": f"high - {q.lag('high')}", "dn": f"{q.lag('low')} - low"},
      {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END"}]
ADX = [*DM, {"plus_di": f"100 * {q.mean('pdm', 14)} / nullif({q.mean('trange', 14)}, 0)",
             "minus_di": f"100 * {q.mean('mdm', 14)} / nullif({q.mean('trange', 14)}, 0)"},
       {"dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)"}, {"adx": q.mean("dx", 14)}]


@simple("ind_9_adx", 40, "plus_di minus_di adx", ADX)
def ind_9(s):
    return ind.adx(s)


@simple("ind_9_adx_ewm", FS1_HALO, "plus_di minus_di adx",
        [*DM, {f"{n}e": q.ema(n, q.sp(14)) for n in ("trange", "pdm", "mdm")},
         {"plus_di": "100 * pdme / trangee", "minus_di": "100 * mdme / trangee"},
         {"dx": "coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0)"}, {"adx": q.ema("dx", q.sp(14))}])
def ind_9e(s):
    return ind.adx_ewm(s)


VOLS = [{"return_1": q.pct("close", 1)}, {f"vol{n}": q.std("return_1", n) for n in (10, 20, 50)}]


@simple("ind_10_volatility", 125, "vol10 vol20 vol50 vol_percentile", [*VOLS, {"vol_percentile": q.prank("vol20", 100)}])
def ind_10(s):
    return ind.volatility(s)


LR = {"lr2": "power(ln(high / low), 2) / (4 * ln(2))"}


@simple("ind_11_parkinson", 20, "parkinson_vol parkinson_mean",
        [LR, {"parkinson_vol": f"sqrt({q.mean('lr2', 20)})", "parkinson_mean": q.mean("sqrt(lr2)", 20)}])
def ind_11(s):
    return ind.parkinson(s)


VOLUME = [{f"vol_ma{n}": q.mean("volume", n) for n in (10, 20, 50)}, {f"vol_ratio{n}": f"volume / vol_ma{n}" for n in (10, 20, 50)},
          {"vol_spike": q.flag("vol_ratio20 > 1.5"), "vol_surge": q.flag("vol_ratio20 > 2"), "vol_dry": q.flag("vol_ratio20 < 0.5")}]


@simple("ind_12_volume", 50, "vol_ma10 vol_ma20 vol_ma50 vol_ratio10 vol_ratio20 vol_ratio50 vol_spike vol_surge vol_dry", VOLUME)
def ind_12(s):
    return ind.volume_features(s)


KELT = [{"ema20": q.ema("close", q.sp(20)), **TR}, *BB, ATR,
        {"kelt_up": "ema20 + 2 * coalesce(atr20, atr14)", "kelt_lo": "ema20 - 2 * coalesce(atr20, atr14)"},
        {"kelt_bw": "(kelt_up - kelt_lo) / ema20"}, {"squeeze_on": q.flag("bb_width < kelt_bw")}]


@simple("ind_14_keltner", FS1_HALO, "kelt_up kelt_lo kelt_bw squeeze_on", KELT)
def ind_14(s):
    return ind.keltner(s)


PULL = [{"rh": q.hi("close", 50), "rl": q.lo("low", 50), "pullback_time": f"""coalesce(CASE WHEN count(close) {q.over(50)} = 50
 THEN 50 - list_position(list(close) {q.over(50)}, max(close) {q.over(50)}) END, 0)"""},
        {"pullback_depth": "(rh - close) / nullif(atr14, 0)",
         "dist_nearest_sr0": "least(abs(rh - close), abs(close - rl)) / nullif(atr14, 0)"}]


@simple("ind_15_pullback", 55, "pullback_depth pullback_time dist_nearest_sr0", [TR, ATR, *PULL])
def ind_15(s):
    return ind.pullback(s)


WICKS = [{"upper_wick_ratio": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)",
          "lower_wick_ratio": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)"},
         {"wick_pressure": "upper_wick_ratio - lower_wick_ratio", "body_ratio": "coalesce(abs(close - open) / nullif(high - low, 0), 0)",
          "close_position": "coalesce((close - low) / nullif(high - low, 0), 0)", "bar_range": "(high - low) / close"}]


@simple("ind_16_wicks", 0, "upper_wick_ratio lower_wick_ratio wick_pressure body_ratio close_position bar_range", WICKS)
def ind_16(s):
    return s.add(**ind.wicks())


@simple("ind_17_ema_slope", FS1_HALO, "ema20_slope ema20_slope_abs ema50_slope ema50_slope_abs",
        [{f"ema{n}": q.ema("close", q.sp(n)) for n in (20, 50)},
         {"ema20_slope": q.pct("ema20", 10), "ema20_slope_abs": f"(ema20 - {q.lag('ema20', 10)}) / abs({q.lag('ema20', 10)})",
          "ema50_slope": q.pct("ema50", 5), "ema50_slope_abs": f"(ema50 - {q.lag('ema50', 5)}) / abs({q.lag('ema50', 5)})"}])
def ind_17(s):
    s = ind.ema(s, 20, 50)
    return s.add(**ind.ema_slope(s, 20, 10), **ind.ema_slope(s, 50, 5))


@simple("ind_18_gaps", 25, "gap gap_pct volume_surge volume_anomaly",
        [{"gap": f"open - {q.lag('close')}", "gap_pct": f"(open - {q.lag('close')}) / {q.lag('close')}",
          "volume_surge": f"volume / {q.mean('volume', 20)}"}, {"volume_anomaly": q.flag("volume_surge > 2")}])
def ind_18(s):
    return ind.gaps(s)


@simple("ind_19_fib_levels", 25, "swing_high swing_low fib_382 fib_500 fib_618",
        [{"swing_high": q.hi("high", 20), "swing_low": q.lo("low", 20)},
         {f"fib_{int(v * 1000)}": f"swing_high - (swing_high - swing_low) * {v}" for v in (0.382, 0.5, 0.618)}])
def ind_19(s):
    return ind.swing_fib(s)


@simple("ind_20_setup_helpers", 60, "breakout_strength dev_sma20 consolidating at_sma20 momentum_5 momentum_10 momentum_20 vol_ratio_10_50 prev_max prev_min",
        [{**TR, "sma20": q.mean("close", 20), "return_1": q.pct("close", 1)}, ATR,
         {"breakout_strength": "(close - open) / nullif(atr14, 0)", "dev_sma20": "(close - sma20) / nullif(atr14, 0)",
          "consolidating": q.flag(f"{q.hi('high', 20, -1)} - {q.lo('low', 20, -1)} < atr14 * 4"),
          "at_sma20": q.flag("abs(close - sma20) < atr14 * 0.5"), **{f"momentum_{k}": q.pct("close", k) for k in (5, 10, 20)},
          "vol_ratio_10_50": f"{q.std('return_1', 10)} / nullif({q.std('return_1', 50)}, 0)",
          "prev_max": q.hi("high", 20, -1), "prev_min": q.lo("low", 20, -1)}])
def ind_20(s):
    s = ind.sma(ind.returns(ind.atr(s, 14)), 20)
    return s.add(breakout_strength=ind.breakout_strength(), dev_sma20=ind.deviation("sma20"),
                 consolidating=ind.consolidation(s, 20, 4.0), at_sma20=ind.at_level("sma20"), **ind.momentum(s, 5, 10, 20),
                 vol_ratio_10_50=ind.volatility_ratio(s), prev_max=R.high(s, "high", 20, -1), prev_min=R.low(s, "low", 20, -1))


@simple("ind_21_momentum_shape", 20, "momentum_accel momentum_consistency hh ll hh_count ll_count",
        [{"r": q.pct("close", 1), "momentum_5": q.pct("close", 5), "hh": q.flag(f"high > {q.lag('high')}"), "ll": q.flag(f"low < {q.lag('low')}")},
         {"momentum_accel": f"momentum_5 - {q.lag('momentum_5', 5)}", "sg": "sign(r)"},
         {"momentum_consistency": q.mean("sg", 10), "hh_count": q.total("hh", 10), "ll_count": q.total("ll", 10)}])
def ind_21(s):
    return ind.momentum_shape(s)
