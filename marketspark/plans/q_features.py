"""Feature sets, regimes, setups and plug-ins over hourly bars."""

import math

from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.operators import features as FS
from marketspark.operators import joins as J
from marketspark.operators import regimes as RG
from marketspark.operators import setups as SG
from marketspark.operators.series import blocked
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.q_ta import OSC, latest
from marketspark.plans.q_windows import BARS, GL, TR, bars, rounded, simple, sql_rsi
from marketspark.plans.registry import query

H = FS.HALO
EMAS = (10, 20, 50, 100, 200)

#: the base set, level by level
FS1 = [
    {**TR, **{f"return_{k}": q.pct("close", k) for k in (1, 5, 10, 20)}, "log_return": f"ln(close / {q.lag('close')})", **{f"ema{n}": q.ema("close", q.sp(n)) for n in EMAS},
     "e12": q.ema("close", q.sp(12)), "e26": q.ema("close", q.sp(26)), **{f"sma{n}": q.mean("close", n) for n in EMAS}, **GL, "bb_middle": q.mean("close", 20), "sd": q.std("close", 20),
     "donchian_high": q.hi("high", 20, -1), "donchian_low": q.lo("low", 20, -1), "tpv": "(high + low + close) / 3 * volume", "up": f"high - {q.lag('high')}", "dn": f"{q.lag('low')} - low",
     **{f"vol_ma{n}": q.mean("volume", n) for n in (10, 20, 50)}, "lr2": "power(ln(high / low), 2) / (4 * ln(2))", "sv": f"sign(close - {q.lag('close')}) * volume"},
    {"atr14": q.mean("trange", 14), "rsi14": sql_rsi(14), "macd": "e12 - e26", "bb_upper": "bb_middle + 2 * sd", "bb_lower": "bb_middle - 2 * sd",
     "donchian_mid": "(donchian_high + donchian_low) / 2", "donchian_width": "(donchian_high - donchian_low) / close", "vwap": f"{q.total('tpv', 100)} / {q.total('volume', 100)}",
     "pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END", **{f"vol{n}": q.std("return_1", n) for n in (10, 20, 50)},
     "parkinson_vol": f"sqrt({q.mean('lr2', 20)})", **{f"vol_ratio{n}": f"volume / vol_ma{n}" for n in (10, 20, 50)}, "obv": f"CASE WHEN sv IS NOT NULL THEN sum(sv) OVER ({q.PART}) END",
     **{f"ema{n}_dist": f"(close - ema{n}) / close" for n in EMAS}, **{f"sma{n}_dist": f"(close - sma{n}) / close" for n in EMAS}},
    {"atr14_pct": "atr14 / close", "rsi14_oversold": q.flag("rsi14 < 30"), "rsi14_overbought": q.flag("rsi14 > 70"), "macd_signal": q.ema("macd", q.sp(9)), "bb_width": "(bb_upper - bb_lower) / bb_middle",
     "bb_pct": "(close - bb_lower) / nullif(bb_upper - bb_lower, 0)", "vwap_dist": "(close - vwap) / close", "plus_di": f"100 * {q.mean('pdm', 14)} / nullif(atr14, 0)",
     "minus_di": f"100 * {q.mean('mdm', 14)} / nullif(atr14, 0)", "vol_percentile": q.prank("vol20", 100), "vol_spike": q.flag("vol_ratio20 > 1.5"), "obv_ema": q.ema_adj("obv", q.sp(20))},
    {"macd_hist": "macd - macd_signal", "macd_positive": q.flag("macd > 0"), "macd_cross_up": q.flag(f"macd > macd_signal AND {q.lag('macd')} <= {q.lag('macd_signal')}"),
     "bb_width_pct": q.prank("bb_width", 100), "dx": "100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0)"},
    {"adx": q.mean("dx", 14)},
]
FS1_COLS = ("return_1 return_5 return_10 return_20 log_return atr14 atr14_pct " + " ".join(f"ema{n} ema{n}_dist sma{n} sma{n}_dist" for n in EMAS)
            + " rsi14 rsi14_oversold rsi14_overbought macd macd_signal macd_hist macd_positive macd_cross_up bb_upper bb_middle bb_lower bb_width bb_pct bb_width_pct"
            " donchian_high donchian_low donchian_mid donchian_width vwap vwap_dist adx plus_di minus_di vol10 vol20 vol50 vol_percentile parkinson_vol"
            " vol_ma10 vol_ratio10 vol_ma20 vol_ratio20 vol_ma50 vol_ratio50 vol_spike obv obv_ema")


def over_base(name, cols, steps):
    """A query on top of the base features."""
    def deco(fn):
        simple(name, H, cols, [*FS1, *steps])(lambda s: fn(FS.base(s)))
        return fn
    return deco


@simple("fs_1_features_base", H, FS1_COLS, FS1)
def fs_1(s):
    return FS.base(s)


LIVE = ("trange atr14 vol_percentile bb_mid_20 bb_bbp_20 bb_bw_20 kelt_bw_20 squeeze_on ema20_slope ema50_slope ema200_slope trend_strength pullback_depth pullback_time adx14"
        " aroon14_up aroon14_dn rsi_14 macd macdh stoch_k obv adosc dist_nearest_sr0 upper_wick_ratio lower_wick_ratio wick_pressure minute_of_day dow session session_pos vol_ratio close_vs_sma10")
LIVE_SQL = [*OSC[:-2], {**OSC[-2], "atr14": q.mean("trange", 14), "atr20": q.mean("trange", 20), "r1": q.pct("close", 1), "sma10": q.mean("close", 10), **{f"ema{n}": q.ema("close", q.sp(n)) for n in (20, 50, 200)},
            "bbm": q.mean("close", 20), "sd": q.std("close", 20), "macd": f"{q.ema('close', q.sp(12))} - {q.ema('close', q.sp(26))}", "rh": q.hi("close", 50), "rl": q.lo("low", 50),
            "svv": f"CASE WHEN {q.lag('close')} IS NULL THEN volume ELSE sign(close - {q.lag('close')}) * volume END", "mff": "coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume",
            "a14u": f"(14 - {latest('max', 'high', 15)}) * 100.0 / 14", "a14d": f"(14 - {latest('min', 'low', 15)}) * 100.0 / 14", "md": "hour(bar_ts) * 60 + minute(bar_ts)",
            "pullback_time": f"coalesce(CASE WHEN count(close) {q.over(50)} = 50 THEN 50 - list_position(list(close) {q.over(50)}, max(close) {q.over(50)}) END, 0)"},
            {"vol_10": q.std("r1", 10), "vol_20": q.std("r1", 20), "macds": q.ema("macd", q.sp(9)), "obv": f"sum(svv) OVER ({q.PART})", "ad": f"sum(mff) OVER ({q.PART})",
             **{f"ema{n}_slope": f"(ema{n} - {q.lag(f'ema{n}', 5)}) / abs({q.lag(f'ema{n}', 5)})" for n in (20, 50, 200)}},
            {"vol_percentile": q.prank("vol_20", 120), "adosc": f"{q.ema('ad', q.sp(3))} - {q.ema('ad', q.sp(10))}", "vol_ratio": "vol_10 / nullif(vol_20, 0)", "macdh": "macd - macds", "bb_mid_20": "bbm",
             "bb_bbp_20": "(close - bbm + 2 * sd) / nullif(4 * sd, 0)", "bb_bw_20": "4 * sd / bbm", "kelt_bw_20": "4 * coalesce(atr20, atr14) / ema20", "trend_strength": "abs(ema20 - ema50) / nullif(atr14, 0)",
             "pullback_depth": "(rh - close) / nullif(atr14, 0)", "dist_nearest_sr0": "least(abs(rh - close), abs(close - rl)) / nullif(atr14, 0)", "adx14": "adx", "aroon14_up": "a14u", "aroon14_dn": "a14d",
             "stoch_k": "slowk", "upper_wick_ratio": "coalesce((high - greatest(open, close)) / nullif(high - low, 0), 0)", "lower_wick_ratio": "coalesce((least(open, close) - low) / nullif(high - low, 0), 0)",
             "minute_of_day": "md", "dow": "(dayofweek(bar_ts) + 6) % 7", "session": "CASE WHEN md < 420 THEN 0 WHEN md < 780 THEN 1 WHEN md < 1260 THEN 2 ELSE 3 END",
             "session_pos": "CASE WHEN md < 420 THEN md / 420.0 WHEN md < 780 THEN (md - 420) / 360.0 WHEN md < 1260 THEN (md - 780) / 480.0 ELSE (md - 1260) / 180.0 END", "close_vs_sma10": "(close - sma10) / sma10"},
            {"squeeze_on": q.flag("bb_bw_20 < kelt_bw_20"), "wick_pressure": "upper_wick_ratio - lower_wick_ratio"}]


@query("fs_2_features_live", q.chain(BARS, "bars", *LIVE_SQL, out=q.outs(LIVE), where=" AND ".join(
    f"{c} IS NOT NULL" for c in LIVE.split() if c not in ("session_pos", "vol_ratio", "close_vs_sma10"))))
def fs_2(spark, sf):
    df = FS.live_rows(bars(spark, sf, H))
    return df.select("symbol", "bar_ts", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in LIVE.split()))


SHARED_SQL = [{**TR, **GL, "returns": q.pct("close", 1), "log_returns": f"ln(close / {q.lag('close')})", **{f"sma{n}": q.mean("close", n) for n in (10, 20, 50)}, "sd": q.std("close", 20),
               "macd": f"{q.ema_adj('close', q.sp(12))} - {q.ema_adj('close', q.sp(26))}", "volume_sma20": q.mean("volume", 20)},
              {"atr14": q.mean("trange", 14), "rsi14": sql_rsi(14), **{f"close_vs_sma{n}": f"(close - sma{n}) / sma{n}" for n in (10, 20, 50)}, "bb_upper": "sma20 + 2 * sd", "bb_lower": "sma20 - 2 * sd",
               "bb_position": "(close - sma20 + 2 * sd) / nullif(4 * sd, 0)", "volume_ratio": "volume / volume_sma20", "macd_signal": q.ema_adj("macd", q.sp(9))}, {"macd_hist": "macd - macd_signal"}]


@query("fs_3_features_shared", q.chain(BARS, "bars", *SHARED_SQL, out=q.outs(list(FS.SHARED)), where=" AND ".join(f"{c} IS NOT NULL" for c in FS.SHARED)))
def fs_3(spark, sf):
    df = FS.shared(bars(spark, sf, H)).rows().dropna(subset=list(FS.SHARED))
    return df.select("symbol", "bar_ts", *(F.round(F.col(c).cast("double"), 6).alias(c) for c in FS.SHARED))


A2, A15 = "coalesce(atr14, close * 0.02)", "coalesce(atr14, close * 0.015)"


@over_base("fs_4_features_universal", "momentum_5 momentum_50 volatility_expanding ema_distance_fast ema_distance_slow dist_from_vwap dist_from_ema50 rsi_normalized rsi_momentum rsi_extreme_oversold"
           " rsi_extreme_overbought volume_surge volume_declining breakout_strength hour day_of_week is_asian_session is_london_session is_ny_session adx_strong_trend adx_very_strong macd_normalized"
           " macd_hist_positive bb_oversold bb_overbought bb_squeeze higher_high lower_low price_above_ema20 ema20_slope price_above_ema50 ema50_slope long_signal_strength short_signal_strength",
           [{**{f"momentum_{k}": q.pct("close", k) for k in (5, 20, 50)}, "volume_surge": "vol_ratio20", "mid": f"({q.hi('close', 20)} + {q.lo('close', 20)}) / 2", "volume_declining": q.flag(f"volume < {q.lag('volume')}"),
             "higher_high": q.flag(f"close > {q.lag('close', 5)}"), "lower_low": q.flag(f"close < {q.lag('close', 5)}"), "ema20_slope": q.pct("ema20", 5), "ema50_slope": q.pct("ema50", 10),
             "rsi_momentum": f"rsi14 - {q.lag('rsi14', 3)}", "bb_squeeze": q.flag(f"bb_width < {q.quant('bb_width', 100, 0.2)}"), "h": "hour(bar_ts)"},
            {"volatility_expanding": q.flag("vol10 > vol20"), "ema_distance_fast": f"(ema10 - ema20) / {A2}", "ema_distance_slow": f"(ema50 - ema100) / {A2}", "dist_from_vwap": f"(close - vwap) / {A2}",
             "dist_from_ema50": f"(close - ema50) / {A2}", "rsi_normalized": "(rsi14 - 50) / 50", "rsi_extreme_oversold": q.flag("rsi14 < 25"), "rsi_extreme_overbought": q.flag("rsi14 > 75"),
             "breakout_strength": f"(close - mid) / {A2}", "hour": "h", "day_of_week": "(dayofweek(bar_ts) + 6) % 7", "is_asian_session": q.flag("h <= 8"), "is_london_session": q.flag("h BETWEEN 8 AND 16"),
             "is_ny_session": q.flag("h BETWEEN 13 AND 21"), "adx_strong_trend": q.flag("adx > 25"), "adx_very_strong": q.flag("adx > 35"), "macd_normalized": f"macd / {A2}", "macd_hist_positive": q.flag("macd_hist > 0"),
             "bb_oversold": q.flag("bb_pct < 0.2"), "bb_overbought": q.flag("bb_pct > 0.8"), "price_above_ema20": q.flag("close > ema20"), "price_above_ema50": q.flag("close > ema50"),
             "bo": f"0.1 * {q.flag('vol_ratio20 > 1.2')} + 0.1 * {q.flag('adx > 20')}"},
            {"long_signal_strength": f"0.15 * {q.flag('momentum_20 > 0')} + 0.15 * {q.flag('rsi14 BETWEEN 40 AND 70')} + bo",
             "short_signal_strength": f"0.15 * {q.flag('momentum_20 < 0')} + 0.15 * {q.flag('rsi14 BETWEEN 30 AND 60')} + bo"}])
def fs_4(s):
    return FS.universal(s)


MOMS = (3, 5, 10, 20, 40, 60)


@over_base("fs_5_features_multiscale", " ".join([*(f"mom_{k} mom_{k}_rank" for k in MOMS), *(f"vol_{n} vol_{n}_rank" for n in (5, 10, 20, 40)), "mom_accel_5 mom_accel_20 vol_regime_change vol_expanding dist_ema20 ema_cross"
           " ema_spread vwap_momentum rsi_zscore rsi_mom rsi_extreme rsi_divergence bb_position bb_width_rank bb_squeeze bb_expansion adx_momentum di_ratio vol_ratio40 surge18 dry06 return_autocorr_1 return_autocorr_3"
           " return_autocorr_5 session_overlap mom_vol_ratio mean_reversion_score trend_score"]),
           [{**{f"mom_{k}": q.pct("close", k) for k in MOMS}, **{f"vol_{n}": q.std("return_1", n) for n in (5, 10, 20, 40)}, "dist_ema20": f"(close - ema20) / {A15}", "dist_ema50": f"(close - ema50) / {A15}",
             "dist_vwap": f"(close - vwap) / {A15}", "ema_spread": f"(ema20 - ema50) / {A15}", "bb_width_rank": q.prank("bb_width", 100), "vol_ratio40": f"volume / {q.mean('volume', 40)}",
             **{f"r{k}": q.lag("return_1", k) for k in (1, 3, 5)}, "rsi_mom": f"rsi14 - {q.lag('rsi14', 5)}", "rsi10": f"rsi14 - {q.lag('rsi14', 10)}", "adx_momentum": f"adx - {q.lag('adx', 5)}"},
            {**{f"mom_{k}_rank": q.prank(f"mom_{k}", 100) for k in MOMS}, **{f"vol_{n}_rank": q.prank(f"vol_{n}", 200) for n in (5, 10, 20, 40)}, "mom_accel_5": f"mom_5 - {q.lag('mom_5', 2)}",
             "mom_accel_20": f"mom_20 - {q.lag('mom_20', 5)}", "vwap_momentum": f"dist_vwap - {q.lag('dist_vwap', 3)}", "vol_regime_change": f"coalesce(vol_20 / nullif({q.mean('vol_40', 20)}, 0), 1)",
             **{f"return_autocorr_{k}": f"(CASE WHEN count(return_1) {q.over(50)} = 50 THEN corr(return_1, r{k}) {q.over(50 - k)} END)" for k in (1, 3, 5)}},
            {"vol_expanding": q.flag("vol_10 > vol_20"), "ema_cross": f"{q.flag('ema20 > ema50')} * 2 - 1", "rsi_zscore": "(rsi14 - 50) / 15", "rsi_extreme": q.flag("rsi14 < 25 OR rsi14 > 75"),
             "rsi_divergence": "rsi10 - mom_10 * 100", "bb_position": "(bb_pct - 0.5) * 2", "bb_squeeze": q.flag("bb_width_rank < 0.2"), "bb_expansion": q.flag("bb_width_rank > 0.8"),
             "di_ratio": "ln(1 + plus_di) - ln(1 + minus_di)", "surge18": q.flag("vol_ratio20 > 1.8"), "dry06": q.flag("vol_ratio20 < 0.6"), "session_overlap": q.flag("hour(bar_ts) >= 13 AND hour(bar_ts) < 16"),
             "mom_vol_ratio": "mom_20 / (vol_20 + 1e-6)", "mean_reversion_score": "abs(dist_ema50) * (1 - vol_20_rank)", "trend_score": "adx / 50 * abs(mom_20) * 100"}])
def fs_5(s):
    return FS.multiscale(s)


@over_base("fs_6_features_engineered", "momentum_5 momentum_5_ema momentum_10_ema momentum_20_ema momentum_50_ema vol_10_zscore vol_20_zscore vol_50_zscore mean_reversion_20 mean_reversion_20_extreme trend_alignment"
           " trend_strength rsi_divergence rsi_regime volume_zscore volume_trend volume_price_correlation higher_high lower_low inside_bar bb_squeeze bb_extreme adx_slope di_spread di_crossover macd_hist_slope"
           " macd_zero_cross is_overlap skewness_20 kurtosis_20 favorable_regime",
           [{**{f"momentum_{k}": q.pct("close", k) for k in (5, 10, 20, 50)}, "volume_zscore": f"(volume - {q.mean('volume', 20)}) / nullif({q.std('volume', 20)}, 0)",
             "volume_trend": f"{q.mean('volume', 10)} / {q.mean('volume', 50)}", "volume_price_correlation": f"(CASE WHEN count(return_1) {q.over(20)} = 20 THEN corr(volume, return_1) {q.over(20)} END)",
             "higher_high": q.flag(f"close > {q.hi('close', 10, -1)}"), "lower_low": q.flag(f"close < {q.lo('close', 10, -1)}"), "inside_bar": q.flag(f"abs(close - {q.lag('close', 5)}) < {A2} * 0.5"),
             "bb_squeeze": q.flag(f"bb_width < {q.quant('bb_width', 100, 0.2)}"), "rsi_divergence": f"rsi14 - {q.lag('rsi14', 5)} - return_5 * 100", "adx_slope": f"adx - {q.lag('adx', 3)}",
             "macd_hist_slope": f"macd_hist - {q.lag('macd_hist', 3)}", "macd_zero_cross": q.flag(f"macd_hist * {q.lag('macd_hist')} < 0"), "skewness_20": q.roll("skewness", "return_1", 20),
             "kurtosis_20": q.roll("kurtosis", "return_1", 20), **{f"vol_{n}_zscore": f"(vol{n} - {q.mean(f'vol{n}', 100)}) / nullif({q.std(f'vol{n}', 100)}, 0)" for n in (10, 20, 50)}},
            {**{f"momentum_{k}_ema": q.ema_adj(f"momentum_{k}", q.sp(k // 2)) for k in (5, 10, 20, 50)}, "mean_reversion_20": f"(close - ema20) / {A2}", "trend_alignment": f"{q.flag('ema10 > ema50')} * 2 - 1",
             "trend_strength": "abs(ema10 - ema50) / ema50", "rsi_regime": "CASE WHEN rsi14 > 0 AND rsi14 <= 30 THEN 0 WHEN rsi14 > 70 THEN 2 WHEN rsi14 > 30 THEN 1 END", "bb_extreme": q.flag("bb_pct < 0.05 OR bb_pct > 0.95"),
             "di_spread": "plus_di - minus_di", "di_crossover": f"{q.flag('plus_di > minus_di')} * 2 - 1", "is_overlap": q.flag("hour(bar_ts) BETWEEN 13 AND 16"),
             "favorable_regime": f"{q.flag('adx > 25')} * 0.3 + {q.flag('vol_20_zscore < 0')} * 0.3 + {q.flag('volume_trend > 1')} * 0.2"}, {"mean_reversion_20_extreme": q.flag("abs(mean_reversion_20) > 2")}])
def fs_6(s):
    return FS.engineered(s)


SPANS = (8, 21, 55, 144, 233)
AT = "(CASE WHEN atr_14 > 0 THEN atr_14 ELSE close * 0.02 END)"


@simple("fs_7_features_trend", H, " ".join([*(f"mom_{k}" for k in (*MOMS, 120)), *(f"ema_{n} dist_ema_{n}" for n in SPANS), "mom_accel_short mom_accel_long mom_consistency atr_14 atr_28 atr_ratio vol_pct vol_breakout ema_8_slope"
        " ema_21_slope ema_55_slope ema_bullish ema_bearish hh_count_10 ll_count_10 range_expansion plus_di minus_di adx adx_strong adx_rising dc_pos breakout_high breakout_low"]),
        [{**TR, **{f"mom_{k}": q.pct("close", k) for k in (*MOMS, 120)}, **{f"ema_{n}": q.ema("close", q.sp(n)) for n in SPANS}, "r": q.pct("close", 1), "hh": q.flag(f"high > {q.lag('high')}"),
          "ll": q.flag(f"low < {q.lag('low')}"), "rg": "(high - low) / close", "up": f"high - {q.lag('high')}", "dn": f"{q.lag('low')} - low", "h20": q.hi("high", 20), "l20": q.lo("low", 20),
          "breakout_high": q.flag(f"close >= {q.hi('high', 20, -1)}"), "breakout_low": q.flag(f"close <= {q.lo('low', 20, -1)}")},
         {"pdm": "CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END", "mdm": "CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END", "atr_14": q.mean("trange", 14), "atr_28": q.mean("trange", 28), "vol_pct": q.std("r", 10),
          "hh_count_10": q.total("hh", 10), "ll_count_10": q.total("ll", 10), "range_expansion": f"rg / nullif({q.mean('rg', 20)}, 0)", "ema_8_slope": q.pct("ema_8", 5), "ema_21_slope": q.pct("ema_21", 10), "ema_55_slope": q.pct("ema_55", 20)},
         {"plus_di": f"100 * {q.ema('pdm', q.sp(14))} / {q.ema('trange', q.sp(14))}", "minus_di": f"100 * {q.ema('mdm', q.sp(14))} / {q.ema('trange', q.sp(14))}", "vol_breakout": q.flag(f"vol_pct > {q.mean('vol_pct', 50)} * 1.5"),
          "mom_accel_short": "mom_10 - mom_5", "mom_accel_long": "mom_40 - mom_20", "mom_consistency": "(sign(mom_5) + sign(mom_10) + sign(mom_20)) / 3.0", "atr_ratio": "atr_14 / nullif(atr_28, 0)",
          **{f"dist_ema_{n}": f"(close - ema_{n}) / {AT}" for n in SPANS}, "ema_bullish": q.flag("ema_8 > ema_21 AND ema_21 > ema_55 AND ema_55 > ema_144"), "ema_bearish": q.flag("ema_8 < ema_21 AND ema_21 < ema_55 AND ema_55 < ema_144"),
          "dc_pos": "coalesce((close - l20) / nullif(h20 - l20, 0), 0)"},
         {"dx": "coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0)"}, {"adx": q.ema("dx", q.sp(14))}, {"adx_strong": q.flag("adx > 25"), "adx_rising": q.flag(f"adx > {q.lag('adx', 5)}")}])
def fs_7(s):
    return FS.trend(s)


FAST_SQL = [*FS1, {"vol_ratio": "vol10 / nullif(vol20, 0)", **{f"mom_{k}": q.pct("close", k) for k in (5, 10, 20)}, "vol_regime": q.flag("vol10 > vol20"), "trend": f"{q.flag('ema20 > ema50')} * 2 - 1",
            "trend_strength": f"abs(ema20 - ema50) / {A2}", "dist_ema50": f"(close - ema50) / {A2}", "rsi_norm": "(rsi14 - 50) / 50", "rsi_extreme": q.flag("rsi14 < 30 OR rsi14 > 70"), "adx_strong": q.flag("adx > 25"),
            "bb_pos": "(bb_pct - 0.5) * 2", "vol_surge": "vol_ratio20"}]


@simple("fs_8_features_fast", H, "mom_5 mom_10 mom_20 vol_regime vol_ratio trend trend_strength dist_ema50 rsi_norm rsi_extreme adx_strong bb_pos vol_surge", FAST_SQL)
def fs_8(s):
    return FS.fast(s)


@simple("fs_9_features_realtime", H, "returns log_returns high_low_ratio close_open_ratio atr14 sma_5 price_to_sma_50 roc_5 roc_50 volatility_5 volatility_20 rsi7 rsi14 rsi21 macd macd_signal macd_hist bb_upper bb_lower bb_pct volume_ratio",
        [{**TR, **GL, "returns": q.pct("close", 1), "log_returns": f"ln(close / {q.lag('close')})", "high_low_ratio": "(high - low) / close", "close_open_ratio": "(close - open) / open", "sma_5": q.mean("close", 5),
          "price_to_sma_50": f"close / {q.mean('close', 50)}", "roc_5": q.pct("close", 5), "roc_50": q.pct("close", 50), "bbm": q.mean("close", 20), "sd": q.std("close", 20),
          "macd": f"{q.ema('close', q.sp(12))} - {q.ema('close', q.sp(26))}", "volume_ratio": f"volume / {q.mean('volume', 20)}"},
         {"atr14": q.mean("trange", 14), **{f"rsi{n}": sql_rsi(n) for n in (7, 14, 21)}, "volatility_5": q.std("returns", 5), "volatility_20": q.std("returns", 20), "macd_signal": q.ema("macd", q.sp(9)),
          "bb_upper": "bbm + 2 * sd", "bb_lower": "bbm - 2 * sd", "bb_pct": "(close - bbm + 2 * sd) / nullif(4 * sd, 0)"}, {"macd_hist": "macd - macd_signal"}])
def fs_9(s):
    return FS.realtime(s)


@over_base("fs_10_features_micro", "regime_vol_percentile regime_vol regime_trend_20_50 regime_trend_50_200 regime_session_asian regime_session_london regime_session_ny regime_range_position momentum_roc_5 momentum_strength_5"
           " momentum_strength_10 momentum_accel mr_distance_sma_20 mr_distance_sma_100 mr_bb_position mr_bb_extreme mr_rsi_oversold mr_rsi_neutral micro_body micro_upper_wick micro_body_ratio micro_wick_ratio micro_volume_surge"
           " micro_volume_anomaly micro_gap micro_gap_pct",
           [{"regime_vol_percentile": f"(CASE WHEN count(atr14) {q.over(100)} = 100 THEN len(list_filter(list(atr14) {q.over(100)}, lambda v: v < atr14)) / 100.0 END)", "h20": q.hi("high", 20), "l20": q.lo("low", 20),
             "momentum_roc_5": "return_5", "momentum_strength_5": f"(close - {q.lag('close', 5)}) / nullif(atr14, 0)", "momentum_strength_10": f"(close - {q.lag('close', 10)}) / nullif(atr14, 0)", "momentum_accel": "return_5 - return_10",
             "micro_gap": f"open - {q.lag('close')}", "micro_gap_pct": f"(open - {q.lag('close')}) / {q.lag('close')}", "h": "hour(bar_ts)", "micro_upper_wick": "high - greatest(open, close)", "lw": "least(open, close) - low"},
            {"regime_vol": "CASE WHEN regime_vol_percentile > 0 AND regime_vol_percentile <= 0.33 THEN 0 WHEN regime_vol_percentile > 0.67 THEN 2 WHEN regime_vol_percentile > 0.33 THEN 1 END",
             "regime_trend_20_50": f"{q.flag('ema20 > ema50')} * 2 - 1", "regime_trend_50_200": f"{q.flag('ema50 > ema200')} * 2 - 1", "regime_session_asian": q.flag("h < 8"), "regime_session_london": q.flag("h >= 8 AND h < 16"),
             "regime_session_ny": q.flag("h >= 13 AND h < 21"), "regime_range_position": "CASE WHEN h20 IS NOT NULL THEN coalesce((close - l20) / nullif(h20 - l20, 0), 0) END", "mr_distance_sma_20": "(close - sma20) / sma20",
             "mr_distance_sma_100": "(close - sma100) / sma100", "mr_bb_position": "bb_pct", "mr_bb_extreme": q.flag("bb_pct > 0.95 OR bb_pct < 0.05"), "mr_rsi_oversold": q.flag("rsi14 < 30"), "mr_rsi_neutral": q.flag("rsi14 >= 40 AND rsi14 <= 60"),
             "micro_body": "abs(close - open)", "micro_body_ratio": "coalesce(abs(close - open) / nullif(high - low, 0), 0)", "micro_wick_ratio": "coalesce((micro_upper_wick + lw) / nullif(high - low, 0), 0)",
             "micro_volume_surge": "volume / (vol_ma20 + 1)", "micro_volume_anomaly": q.flag("volume / (vol_ma20 + 1) > 2")}])
def fs_10(s):
    return FS.micro(s)


# ---- regimes --------------------------------------------------------------------------------
@over_base("rg_1_trend_regime", "regime_trend_weak regime_trend_moderate regime_trend_strong regime_trend_up regime_trend_down",
           [{"regime_trend_weak": q.flag("adx < 20"), "regime_trend_moderate": q.flag("adx >= 20 AND adx < 30"), "regime_trend_strong": q.flag("adx >= 30"), "regime_trend_up": q.flag("plus_di > minus_di"), "regime_trend_down": q.flag("plus_di < minus_di")}])
def rg_1(s):
    return RG.trend_regime(s)


@over_base("rg_2_volatility_regime", "atr_percentile regime_vol_low regime_vol_medium regime_vol_high atr_expanding",
           [{"atr_percentile": q.prank("atr14", 100), "atr_expanding": q.flag(f"atr14 > {q.lag('atr14', 5)}")},
            {"regime_vol_low": q.flag("atr_percentile < 0.33"), "regime_vol_medium": q.flag("atr_percentile >= 0.33 AND atr_percentile < 0.67"), "regime_vol_high": q.flag("atr_percentile >= 0.67")}])
def rg_2(s):
    return RG.volatility_regime(s)


@over_base("rg_3_ema_alignment", "ema20_slope ema200_slope ema50_slope_up ema100_slope_down ema_aligned_up ema_aligned_down",
           [{f"ema{n}_slope": q.pct(f"ema{n}", 10) for n in (20, 50, 100, 200)},
            {"ema50_slope_up": q.flag("ema50_slope > 0"), "ema100_slope_down": q.flag("ema100_slope < 0"), "ema_aligned_up": q.flag("ema20_slope > 0 AND ema50_slope > 0 AND ema100_slope > 0"),
             "ema_aligned_down": q.flag("ema20_slope < 0 AND ema50_slope < 0 AND ema100_slope < 0")}])
def rg_3(s):
    return RG.ema_alignment(s)


@simple("rg_4_ranging", 55, "range_pct regime_ranging", [{"range_pct": f"({q.hi('high', 50)} - {q.lo('low', 50)}) / close"}, {"regime_ranging": q.flag("range_pct < 0.25")}])
def rg_4(s):
    return RG.ranging(s, 50, 0.25)


CLASSIFY = [*FS1, {"slope": f"(ema100 - {q.lag('ema100', 5)}) / {q.lag('ema100', 5)}", "med": q.quant("atr14", 100, 0.5, 20), "bw": q.quant("bb_width", 100, 0.4, 20)}, {"cut": q.quant("slope", 100, 0.6, 20)},
            {"it": "coalesce(adx > 25 AND atr14 > med AND abs(slope) > abs(cut), false)", "ir": "coalesce(adx < 20 AND bb_width < bw AND atr14 < med, false)"},
            {"regime": "CASE WHEN it THEN 'Trend' WHEN ir THEN 'Range' ELSE 'Neutral' END", "regime_confidence": "CASE WHEN it THEN greatest(0, least(1, (adx - 25) / 25)) WHEN ir THEN greatest(0, least(1, (20 - adx) / 20)) ELSE 0.3 END"}]
CLASSIFIED = q.chain(BARS, "bars", *CLASSIFY, out="*")


def classified(spark, sf):
    return RG.classify(FS.base(bars(spark, sf, H)))


@query("rg_5_classify_regime", f"SELECT symbol, bar_ts, regime, {q.r6('regime_confidence')} AS regime_confidence FROM ({CLASSIFIED})")
def rg_5(spark, sf):
    return classified(spark, sf).select("regime", F.round("regime_confidence", 6).alias("regime_confidence")).drop("timeframe")


RSTATS = f"""rs AS (SELECT symbol, timeframe, count(*) AS total_bars, count(*) FILTER (regime = 'Trend') AS trend_bars, count(*) FILTER (regime = 'Range') AS range_bars, count(*) FILTER (regime = 'Neutral') AS neutral_bars,
 count(*) FILTER (regime = 'Trend') * 100.0 / count(*) AS trend_pct, count(*) FILTER (regime = 'Range') * 100.0 / count(*) AS range_pct, count(*) FILTER (regime = 'Neutral') * 100.0 / count(*) AS neutral_pct,
 avg(regime_confidence) AS avg_confidence FROM ({CLASSIFIED}) GROUP BY symbol, timeframe)"""


@query("rg_6_regime_stats", f"WITH {RSTATS} SELECT symbol, timeframe, total_bars, trend_bars, range_bars, neutral_bars, {', '.join(f'{q.r6(c)} AS {c}' for c in ('trend_pct', 'range_pct', 'neutral_pct', 'avg_confidence'))} FROM rs")
def rg_6(spark, sf):
    df = RG.regime_stats(classified(spark, sf).rows())
    return df.select("symbol", "timeframe", "total_bars", "trend_bars", "range_bars", "neutral_bars", *(F.round(c, 6).alias(c) for c in ("trend_pct", "range_pct", "neutral_pct", "avg_confidence")))


@query("rg_7_regime_by_asset_class", f"""WITH {RSTATS} SELECT asset_class, count(*) AS count, {q.r6('avg(trend_pct)')} AS avg_trend, {q.r6('avg(range_pct)')} AS avg_range, {q.r6('avg(neutral_pct)')} AS avg_neutral
 FROM (SELECT *, CASE WHEN symbol IN ('S0', 'S1') THEN 'metals' ELSE 'fx' END AS asset_class FROM rs UNION ALL SELECT *, 'all' FROM rs) GROUP BY asset_class""")
def rg_7(spark, sf):
    df = RG.by_asset_class(RG.regime_stats(classified(spark, sf).rows()), ["S0", "S1"])
    return df.select("asset_class", "count", *(F.round(c, 6).alias(c) for c in ("avg_trend", "avg_range", "avg_neutral")))


@query("rg_7_recommendations", f"""WITH {RSTATS} SELECT symbol, array_to_string(list_filter([CASE WHEN neutral_pct > 50 THEN 'use mean reversion' END, CASE WHEN trend_pct < 25 THEN 'wider targets, tighter stops' END,
 CASE WHEN range_pct > 20 THEN 'good for mean reversion' END, CASE WHEN trend_pct > 30 THEN 'good for momentum' END], lambda x: x IS NOT NULL), ';') AS recommendations FROM rs""")
def rg_7r(spark, sf):
    return RG.recommendations(RG.regime_stats(classified(spark, sf).rows())).select("symbol", F.concat_ws(";", "recommendations").alias("recommendations"))


# ---- setups ---------------------------------------------------------------------------------
@over_base("sg_1_momentum_breakout", "s1_bb_compressed s1_breakout_strength s1_is_breakout s1_breakout_up s1_breakout_down s1_vol_spike s1_ema_fast_above_slow s1_ema_slope s1_ema_momentum_up s1_price_vs_vwap s1_long_setup s1_short_setup",
           [{"s1_bb_compressed": q.flag("bb_width_pct < 0.2"), "s1_breakout_strength": "(close - open) / nullif(atr14, 0)", "s1_ema_slope": q.pct("ema10", 5), "s1_vol_spike": q.flag("vol_ratio20 > 1.5"), "s1_ema_fast_above_slow": q.flag("ema10 > ema20"),
             "s1_price_vs_vwap": "(close - vwap) / nullif(atr14, 0)"},
            {"s1_is_breakout": q.flag("abs(s1_breakout_strength) > 1"), "s1_breakout_up": q.flag("s1_breakout_strength > 1"), "s1_breakout_down": q.flag("s1_breakout_strength < -1"), "s1_ema_momentum_up": q.flag("s1_ema_slope > 0")},
            {"s1_long_setup": q.flag("s1_bb_compressed = 1 AND s1_breakout_up = 1 AND s1_vol_spike = 1 AND s1_ema_fast_above_slow = 1"),
             "s1_short_setup": q.flag("s1_bb_compressed = 1 AND s1_breakout_down = 1 AND s1_vol_spike = 1 AND s1_ema_fast_above_slow = 0")}])
def sg_1(s):
    return SG.momentum_breakout(s)


@over_base("sg_1b_momentum_breakout_scored", "s1b_enter s1b_confidence s1b_tp s1b_sl",
           [{"w2": "2 * sd / bb_middle", "bs": "abs(close - open) / nullif(atr14, 0)", "vr": "vol_ratio20"}, {"th": q.quant("w2", 100, 0.35)}, {"s1b_enter": q.flag("atr14 > 0 AND w2 <= th AND bs >= 1 AND vr >= 1.5")},
            {"s1b_confidence": "CASE WHEN s1b_enter = 1 THEN least(1, (bs - 1) * 0.3 + (vr - 1.5) * 0.2 + 0.5) ELSE 0 END", "s1b_tp": "close + atr14 * 1.8", "s1b_sl": "close - atr14 * 0.9"}])
def sg_1b(s):
    return SG.momentum_breakout_scored(s)


@over_base("sg_2_mean_reversion", "s2_vwap_deviation s2_ema50_deviation s2_extreme_high s2_extreme_low s2_rsi_extreme s2_ranging_regime s2_long_setup s2_short_setup",
           [{"s2_vwap_deviation": "(close - vwap) / nullif(atr14, 0)", "s2_ema50_deviation": "(close - ema50) / nullif(atr14, 0)", "s2_rsi_extreme": q.flag("rsi14 < 30 OR rsi14 > 70"), "s2_ranging_regime": q.flag("adx < 30")},
            {"s2_extreme_high": f"greatest({q.flag('s2_vwap_deviation > 1.5')}, {q.flag('s2_ema50_deviation > 1.5')})", "s2_extreme_low": f"greatest({q.flag('s2_vwap_deviation < -1.5')}, {q.flag('s2_ema50_deviation < -1.5')})"},
            {"s2_long_setup": q.flag("s2_extreme_low = 1 AND rsi14 < 30 AND s2_ranging_regime = 1"), "s2_short_setup": q.flag("s2_extreme_high = 1 AND rsi14 > 70 AND s2_ranging_regime = 1")}])
def sg_2(s):
    return SG.mean_reversion(s)


@over_base("sg_2b_mean_reversion_scored", "s2b_enter s2b_confidence",
           [{"vc": f"sum(tpv) OVER ({q.PART}) / sum(volume) OVER ({q.PART})"}, {"dist": "abs(close - vc)"},
            {"s2b_enter": q.flag("atr14 > 0 AND adx < 25 AND dist >= 1.5 * atr14 AND ((rsi14 <= 30 AND close < vc) OR (rsi14 >= 70 AND close > vc))")},
            {"s2b_confidence": "CASE WHEN s2b_enter = 1 THEN least(1, 0.5 + least(30 - rsi14, rsi14 - 70) / 20 * 0.3 + (dist / atr14 - 1.5) / 1.5 * 0.2) ELSE 0 END"}])
def sg_2b(s):
    return SG.mean_reversion_scored(s)


FIB = {f"fib_{int(v * 1000)}": f"sh - (sh - sl) * {v}" for v in (0.382, 0.5, 0.618)}


@over_base("sg_3_pullback_trend", "s3_ema100_slope s3_dist_to_ema20 s3_at_ema20 s3_near_any_fib s3_uptrend s3_downtrend s3_long_setup s3_short_setup",
           [{"sh": q.hi("high", 20), "sl": q.lo("low", 20), "s3_ema100_slope": q.pct("ema100", 20), "s3_dist_to_ema20": "(close - ema20) / nullif(atr14, 0)"}, FIB,
            {"s3_at_ema20": q.flag("abs(s3_dist_to_ema20) < 0.5"), "s3_near_any_fib": "greatest(" + ", ".join(q.flag(f"abs(close - {f}) < atr14 * 0.5") for f in FIB) + ")", "s3_uptrend": q.flag("s3_ema100_slope > 0.001"),
             "s3_downtrend": q.flag("s3_ema100_slope < -0.001")},
            {"s3_long_setup": q.flag("s3_uptrend = 1 AND close > ema100 AND (s3_at_ema20 = 1 OR s3_near_any_fib = 1) AND rsi14 > 50 AND macd > 0"),
             "s3_short_setup": q.flag("s3_downtrend = 1 AND close < ema100 AND (s3_at_ema20 = 1 OR s3_near_any_fib = 1) AND rsi14 < 50 AND macd < 0")}])
def sg_3(s):
    return SG.pullback_trend(s)


@over_base("sg_3b_pullback_trend_scored", "s3b_slope s3b_uptrend s3b_downtrend s3b_touching s3b_in_fib_zone s3b_is_pullback s3b_bounce s3b_volume_ok s3b_long_setup s3b_short_setup s3b_signal_strength",
           [{"s3b_slope": f"(ema100 - {q.lag('ema100', 5)}) / ema100", "h5": q.hi("high", 50), "l5": q.lo("low", 50), "i": f"row_number() OVER ({q.PART}) - 1"},
            {"s3b_uptrend": q.flag("s3b_slope > 0.0001 AND close > ema100"), "s3b_downtrend": q.flag("s3b_slope < -0.0001 AND close < ema100"), "s3b_touching": q.flag("abs(close - ema20) / nullif(atr14, 0) < 0.3"),
             "s3b_in_fib_zone": q.flag("close >= l5 + (h5 - l5) * 0.382 AND close <= l5 + (h5 - l5) * 0.5"), "s3b_volume_ok": q.flag("volume >= vol_ma20")},
            {"s3b_is_pullback": "greatest(s3b_touching, s3b_in_fib_zone)"}, {"s3b_bounce": q.flag(f"{q.lag('s3b_is_pullback')} = 1 AND close > {q.lag('close')} AND i >= 2")},
            {"s3b_long_setup": q.flag("s3b_uptrend = 1 AND s3b_is_pullback = 1 AND s3b_bounce = 1 AND rsi14 > 50 AND s3b_volume_ok = 1"),
             "s3b_short_setup": q.flag("s3b_downtrend = 1 AND s3b_is_pullback = 1 AND s3b_bounce = 1 AND rsi14 < 50 AND s3b_volume_ok = 1")}, {"s3b_signal_strength": "s3b_long_setup - s3b_short_setup"}])
def sg_3b(s):
    return SG.pullback_trend_scored(s)


@over_base("sg_4_breakout_retest", "s4_consolidation s4_narrow s4_breakout_high s4_breakout_low s4_strong_breakout_high s4_strong_breakout_low s4_retesting_high s4_retesting_low s4_long_setup s4_short_setup",
           [{"ph": q.lag("donchian_high"), "pl": q.lag("donchian_low"), "s4_consolidation": q.flag("donchian_high - donchian_low < atr14 * 1.5"), "s4_narrow": q.flag("donchian_width < 0.015"), "rh": q.hi("donchian_high", 10, -1), "rl": q.lo("donchian_low", 10, -1)},
            {"s4_breakout_high": q.flag("close > ph"), "s4_breakout_low": q.flag("close < pl"), "s4_strong_breakout_high": q.flag("(close - ph) / nullif(atr14, 0) > 0.5"), "s4_strong_breakout_low": q.flag("(pl - close) / nullif(atr14, 0) > 0.5"),
             "s4_retesting_high": q.flag("abs(close - rh) / nullif(atr14, 0) < 0.5"), "s4_retesting_low": q.flag("abs(close - rl) / nullif(atr14, 0) < 0.5"), "was": q.lag("s4_consolidation", 5)},
            {"s4_long_setup": q.flag(f"was = 1 AND {q.hi('s4_breakout_high', 10)} = 1 AND s4_retesting_high = 1 AND rsi14 > 55 AND macd > 0"),
             "s4_short_setup": q.flag(f"was = 1 AND {q.hi('s4_breakout_low', 10)} = 1 AND s4_retesting_low = 1 AND rsi14 < 45 AND macd < 0")}])
def sg_4(s):
    return SG.breakout_retest(s)


@over_base("sg_4b_breakout_retest_scored", "s4b_breakout_up s4b_breakout_down s4b_level_up s4b_level_down s4b_range s4b_retest_up s4b_retest_down s4b_confirmed_up s4b_confirmed_down s4b_long_setup s4b_short_setup s4b_signal_strength s4b_tp_distance",
           [{"h12": q.hi("high", 12, -1), "l12": q.lo("low", 12, -1), "pa": q.lag("atr14")},
            {"s4b_breakout_up": q.flag("close > h12 + atr14 * 0.8 AND h12 - l12 < pa * 1.5"), "s4b_breakout_down": q.flag("close < l12 - atr14 * 0.8 AND h12 - l12 < pa * 1.5")},
            {"lu": "CASE WHEN s4b_breakout_up = 1 THEN h12 END", "ld": "CASE WHEN s4b_breakout_down = 1 AND s4b_breakout_up = 0 THEN l12 END", "rg": "CASE WHEN s4b_breakout_up = 1 OR s4b_breakout_down = 1 THEN h12 - l12 END"},
            {"s4b_level_up": f"last_value(lu IGNORE NULLS) {q.over(7)}", "s4b_level_down": f"last_value(ld IGNORE NULLS) {q.over(7)}", "s4b_range": f"last_value(rg IGNORE NULLS) {q.over(7)}"},
            {"s4b_retest_up": q.flag("abs(low - s4b_level_up) <= atr14 * 0.3"), "s4b_retest_down": q.flag("abs(high - s4b_level_down) <= atr14 * 0.3")},
            {"s4b_confirmed_up": q.flag(f"{q.lag('s4b_retest_up')} = 1 AND close > {q.lag('close')}"), "s4b_confirmed_down": q.flag(f"{q.lag('s4b_retest_down')} = 1 AND close < {q.lag('close')}")},
            {"s4b_long_setup": q.flag("s4b_confirmed_up = 1 AND volume >= vol_ma20 * 1.2 AND (macd > 0 OR rsi14 > 55)"), "s4b_short_setup": q.flag("s4b_confirmed_down = 1 AND volume >= vol_ma20 * 1.2 AND (macd < 0 OR rsi14 < 45)"),
             "s4b_tp_distance": "s4b_range * 1.5"}, {"s4b_signal_strength": "s4b_long_setup - s4b_short_setup"}])
def sg_4b(s):
    return SG.breakout_retest_scored(s)


@over_base("sg_5_momentum_adx", "s5_atr_above_median s5_atr_percentile s5_ema50_slope s5_ema20_slope s5_di_spread s5_cross_up s5_cross_down s5_regime_trending s5_long_setup s5_short_setup s5_exit_long",
           [{"s5_atr_above_median": q.flag(f"atr14 > {q.quant('atr14', 100, 0.5)}"), "s5_atr_percentile": q.prank("atr14", 100), "s5_ema50_slope": q.pct("ema50", 10), "s5_ema20_slope": q.pct("ema20", 5), "s5_di_spread": "plus_di - minus_di",
             "ab": q.flag("ema20 > ema50")}, {"s5_cross_up": q.flag(f"ab = 1 AND {q.lag('ab')} = 0"), "s5_cross_down": q.flag(f"ab = 0 AND {q.lag('ab')} = 1"), "s5_regime_trending": q.flag("adx > 25 AND s5_atr_percentile > 0.5")},
            {"s5_long_setup": q.flag("s5_regime_trending = 1 AND s5_ema50_slope > 0 AND s5_di_spread > 0 AND close > ema50 AND (s5_ema20_slope > 0 OR s5_cross_up = 1)"),
             "s5_short_setup": q.flag("s5_regime_trending = 1 AND s5_ema50_slope < 0 AND s5_di_spread < 0 AND close < ema50 AND (s5_ema20_slope < 0 OR s5_cross_down = 1)"), "s5_exit_long": q.flag("s5_cross_down = 1 OR close < ema20")}])
def sg_5(s):
    return SG.momentum_adx(s)


@simple("sg_5b_momentum_adx_scored", H, "s5b_adx_rising s5b_strong s5b_at_ema20 s5b_cross_down s5b_cross_up s5b_spread_ok s5b_atr_ok s5b_bounce_up s5b_bounce_down s5b_long_setup s5b_short_setup s5b_signal_strength s5b_tp_distance",
        [*FS1, {"spread": "(high - low) / 10"}, {"med": q.quant("atr14", 100, 0.5), "q9": q.quant("atr14", 100, 0.9), "s5b_spread_ok": q.flag(f"spread < {q.quant('spread', 60, 0.9)}"), "s5b_adx_rising": q.flag(f"adx > {q.lag('adx')}"),
         "s5b_strong": q.flag("adx >= 25"), "s5b_at_ema20": q.flag("abs(close - ema20) / nullif(atr14, 0) < 0.3"), "s5b_cross_down": q.flag(f"close < ema20 AND {q.lag('close')} >= {q.lag('ema20')}"),
         "s5b_cross_up": q.flag(f"close > ema20 AND {q.lag('close')} <= {q.lag('ema20')}")},
         {"s5b_atr_ok": q.flag("atr14 >= med AND atr14 < q9"), "s5b_bounce_up": q.flag(f"{q.lag('s5b_at_ema20')} = 1 AND close > {q.lag('close')} AND close > ema50"), "s5b_bounce_down": q.flag(f"{q.lag('s5b_at_ema20')} = 1 AND close < {q.lag('close')} AND close < ema50")},
         {"s5b_long_setup": q.flag("s5b_strong = 1 AND close > ema50 AND s5b_bounce_up = 1 AND s5b_atr_ok = 1 AND s5b_spread_ok = 1"),
          "s5b_short_setup": q.flag("s5b_strong = 1 AND close < ema50 AND s5b_bounce_down = 1 AND s5b_atr_ok = 1 AND s5b_spread_ok = 1"), "s5b_tp_distance": "atr14 * 1.8"}, {"s5b_signal_strength": "s5b_long_setup - s5b_short_setup"}])
def sg_5b(s):
    return SG.momentum_adx_scored(FS.base(s).add(spread=(F.col("high") - F.col("low")) / 10))


S6 = [{"s100": q.pct("ema100", 10), "s50": q.pct("ema50", 10), "s6_dist_to_ema20": "(close - ema20) / nullif(atr14, 0)", "s6_atr_percentile": q.prank("atr14", 100), "htf": q.pct("ema100_htf", 5)},
      {"s6_daily_uptrend": q.flag("htf > 0"), "s6_daily_downtrend": q.flag("htf < 0"), "s6_trend_aligned_up": q.flag("s100 > 0.001 AND s50 > 0"), "s6_trend_aligned_down": q.flag("s100 < -0.001 AND s50 < 0")},
      {"s6_mtf_aligned_up": q.flag("s6_daily_uptrend = 1 AND s6_trend_aligned_up = 1"), "s6_mtf_aligned_down": q.flag("s6_daily_downtrend = 1 AND s6_trend_aligned_down = 1")},
      {"s6_long_setup": q.flag("s6_mtf_aligned_up = 1 AND close > ema50 AND abs(s6_dist_to_ema20) < 1 AND rsi14 > 55 AND s6_atr_percentile > 0.4"),
       "s6_short_setup": q.flag("s6_mtf_aligned_down = 1 AND close < ema50 AND abs(s6_dist_to_ema20) < 1 AND rsi14 < 45 AND s6_atr_percentile > 0.4")}]
S6_COLS = "s6_dist_to_ema20 s6_atr_percentile s6_daily_uptrend s6_daily_downtrend s6_trend_aligned_up s6_trend_aligned_down s6_mtf_aligned_up s6_mtf_aligned_down s6_long_setup s6_short_setup"


@query("sg_6_mtf_alignment", q.chain(f"""{BARS}, {I.sql_resample('bd', 24)}, hd AS (SELECT symbol, bar_ts + INTERVAL 24 HOUR AS vis, {q.ema('close', q.sp(100))} AS ema100_htf FROM bd),
base AS ({q.chain('dummy AS (SELECT 1)', 'bars', *FS1, out='*')}), j AS (SELECT b.*, hd.ema100_htf FROM base b ASOF LEFT JOIN hd ON b.symbol = hd.symbol AND b.bar_ts >= hd.vis)""", "j", *S6, out=q.outs(S6_COLS)))
def sg_6(spark, sf):
    feats = FS.base(bars(spark, sf, H)).rows()
    daily = ind.ema(blocked(I.bars_from_hourly(spark, sf, "1D"), back=H), 100).rows().select("symbol", "bar_ts", "ema100")
    df = J.asof_join(feats, daily, period_seconds=86400)
    return rounded(SG.mtf_alignment(blocked(df, back=110)), S6_COLS)


@over_base("sg_6b_mtf_alignment_scored", "s6b_aligned_up s6b_aligned_down s6b_bounce_up s6b_bounce_down s6b_atr_extreme s6b_long_setup s6b_short_setup s6b_signal_strength s6b_position_multiplier s6b_tp_distance s6b_sl_distance_long s6b_sl_distance_short",
           [{"datr": f"{q.mean('atr14', 6)} * {math.sqrt(6)!r}", "dc": f"CASE WHEN row_number() OVER ({q.PART}) >= 6 THEN close END", "at5": q.flag("abs(close - ema50) / nullif(atr14, 0) < 0.3"), "sh": q.hi("high", 50), "sl": q.lo("low", 50)},
            {"dema": q.ema("dc", q.sp(100))}, {"slope": f"(dema - {q.lag('dema', 6)}) / dema", "q9": q.quant("datr", 100, 0.9), "wa": q.lag("at5"), "pcl": q.lag("close")},
            {"s6b_aligned_up": q.flag("dc > dema AND slope > 0.001 AND close > ema50"), "s6b_aligned_down": q.flag("dc < dema AND slope < -0.001 AND close < ema50"), "s6b_bounce_up": q.flag("wa = 1 AND close > pcl AND close > ema50"),
             "s6b_bounce_down": q.flag("wa = 1 AND close < pcl AND close < ema50"), "s6b_atr_extreme": q.flag("datr >= q9")},
            {"s6b_long_setup": q.flag("s6b_aligned_up = 1 AND s6b_bounce_up = 1 AND rsi14 > 55"), "s6b_short_setup": q.flag("s6b_aligned_down = 1 AND s6b_bounce_down = 1 AND rsi14 < 45"),
             "s6b_position_multiplier": "CASE WHEN s6b_atr_extreme = 1 THEN 0.5 ELSE 1 END", "s6b_tp_distance": "atr14 * 2.5", "s6b_sl_distance_long": "close - sl", "s6b_sl_distance_short": "sh - close"},
            {"s6b_signal_strength": "s6b_long_setup - s6b_short_setup"}])
def sg_6b(s):
    return SG.mtf_alignment_scored(s)


@query("sg_7_strategy_gate", f"""SELECT symbol, bar_ts, CASE WHEN regime NOT IN ('Trend', 'Neutral') THEN 'regime' WHEN NOT (hour(bar_ts) >= 22 OR hour(bar_ts) < 7) THEN 'session' WHEN volume * 0.05 > atr14 * 0.02 THEN 'spread'
 WHEN hour(bar_ts) BETWEEN 13 AND 14 AND ((dayofweek(bar_ts) = 5 AND day(bar_ts) <= 7) OR day(bar_ts) BETWEEN 12 AND 18) THEN 'blackout' ELSE 'ok' END AS reason FROM ({CLASSIFIED})""")
def sg_7(spark, sf):
    df = classified(spark, sf).rows().withColumn("spread", F.col("volume") * 0.05)
    return SG.strategy_gate(df, SG.Gate(("Trend", "Neutral"), 22, 7, 0.02, ("NFP", "CPI"))).select("symbol", "bar_ts", "reason")


@query("sg_8_signal_strength", f"SELECT symbol, bar_ts, CAST(s3b_long_setup - s3b_short_setup AS INTEGER) AS signal_strength FROM (SELECT symbol, bar_ts, {q.flag('adx > 25 AND plus_di > minus_di')} AS s3b_long_setup, {q.flag('adx > 25 AND plus_di < minus_di')} AS s3b_short_setup FROM ({q.chain(BARS, 'bars', *FS1, out='*')}))")
def sg_8(spark, sf):
    s = ind.adx(bars(spark, sf, 60))
    s = s.add(di_long_setup=R.flag((F.col("adx") > 25) & (F.col("plus_di") > F.col("minus_di"))), di_short_setup=R.flag((F.col("adx") > 25) & (F.col("plus_di") < F.col("minus_di"))))
    return s.select(SG.signal_strength("di").alias("signal_strength")).drop("timeframe")


# ---- plug-ins -------------------------------------------------------------------------------
@over_base("ud_1_strategy_plugin", "s1_long_setup s2_long_setup s5_long_setup s5_short_setup",
           [{"cmp": q.flag("bb_width_pct < 0.2"), "bs": "(close - open) / nullif(atr14, 0)", "s5p": q.prank("atr14", 100), "s5e": q.pct("ema50", 10), "s2e": q.pct("ema20", 5), "ab": q.flag("ema20 > ema50")},
            {"cu": q.flag(f"ab = 1 AND {q.lag('ab')} = 0"), "cd": q.flag(f"ab = 0 AND {q.lag('ab')} = 1")},
            {"s1_long_setup": q.flag("cmp = 1 AND bs > 1 AND vol_ratio20 > 1.5 AND ema10 > ema20"),
             "s2_long_setup": q.flag("((close - vwap) / nullif(atr14, 0) < -1.5 OR (close - ema50) / nullif(atr14, 0) < -1.5) AND rsi14 < 30 AND adx < 30"),
             "s5_long_setup": q.flag("adx > 25 AND s5p > 0.5 AND s5e > 0 AND plus_di > minus_di AND close > ema50 AND (s2e > 0 OR cu = 1)"),
             "s5_short_setup": q.flag("adx > 25 AND s5p > 0.5 AND s5e < 0 AND plus_di < minus_di AND close < ema50 AND (s2e < 0 OR cd = 1)")}])
def ud_1(s):
    for name in ("momentum_breakout", "mean_reversion", "momentum_adx"):
        s = SG.run_strategy(s, name)
    return s


@simple("ud_2_rolling_apply", 20, "range_share", [{"range_share": f"(CASE WHEN count(close) {q.over(20)} = 20 THEN (close - min(close) {q.over(20)}) / nullif(max(close) {q.over(20)} - min(close) {q.over(20)}, 0) END)"}])
def ud_2(s):
    return s.add(range_share=R.rolling_apply(s, "close", 20, lambda v, c: R.div(c - F.array_min(v), F.array_max(v) - F.array_min(v))))
