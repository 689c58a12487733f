"""Named feature sets: compositions of indicators, one function per set, each ``Series -> Series``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.functions import sessions as S
from marketspark.functions import ta
from marketspark.functions.rolling import div, flag
from marketspark.operators.series import Series, ema_halo, span

#: halo that suits every feature set here
HALO = ema_halo(span(233)) + 600


def atr_or(share: float = 0.02) -> Column:
    """ATR, or a share of the close while there is none."""
    return F.coalesce(F.col("atr14"), F.col("close") * share)


def base(s: Series) -> Series:
    """Returns, ATR, averages, RSI, MACD, bands, channels, VWAP, ADX, volatility and volume columns."""
    s = ind.obv(s)  # first: its two-level sum reads the series twice, so the less is in it the better
    s = ind.returns(s)
    s = ind.atr(s, 14)
    s = ind.ema(s, 10, 20, 50, 100, 200)
    s = ind.sma(s, 10, 20, 50, 100, 200)
    s = ind.rsi(s, 14)
    s = ind.macd(s)
    s = ind.bollinger(s)
    s = ind.donchian(s)
    s = ind.vwap(s)
    s = ind.adx(s)
    s = ind.volatility(s)
    s = ind.parkinson(s)
    return ind.volume_features(s)


def live(s: Series) -> Series:
    """Essential live columns; library indicators are Wilder and exponential ones."""
    s = ta.volume_lines(s)  # first: it reads the series twice
    s = ind.keltner(s)
    s = s.emas(dense=True, ema50=("close", span(50)), ema200=("close", span(200)))
    s = s.add(returns=R.pct_change(s, "close", 1), log_returns=R.log_return(s, "close"), **{f"sma{n}": R.mean(s, "close", n) for n in (10, 20, 50)})
    s = s.add(vol_10=R.std(s, "returns", 10), vol_20=R.std(s, "returns", 20), **{f"close_vs_sma{n}": div(F.col("close") - F.col(f"sma{n}"), f"sma{n}") for n in (10, 20, 50)},
              **{f"ema{n}_slope": div(R.diff(s, f"ema{n}", 5), F.abs(s.lag(f"ema{n}", 5))) for n in (20, 50, 200)},
              trend_strength=div(F.abs(F.col("ema20") - F.col("ema50")), "atr14"))
    s = s.add(vol_percentile=R.pct_rank(s, "vol_20", 120), vol_ratio=div("vol_10", "vol_20"))
    s = ind.pullback(s)
    s = ta.wilder_family(s)
    s = ta.oscillators(s)
    s = ind.macd(s)
    s = s.add(**ind.wicks())
    ts = F.col("bar_ts")
    sess = S.window_session(ts)
    s = s.add(minute_of_day=S.minute_of_day(ts), dow=F.weekday(ts), session=sess, session_pos=S.session_pos(ts), sess_asia=flag(sess == 0),
              sess_eu=flag(sess == 1), sess_us=flag(sess == 2), **{f"aroon14_{k[6:]}": v for k, v in ta.aroon(s, 14).items()})
    return s.add(bb_mid_20=F.col("bb_middle"), bb_bbp_20=F.col("bb_pct"), bb_bw_20=F.col("bb_width"), kelt_bw_20=F.col("kelt_bw"), macdh=F.col("macd_hist"),
                 adx14=F.col("adx"), stoch_k=F.col("slowk"))


#: fixed values: columns a live row must have
ESSENTIAL = ("atr14", "trange", "vol_percentile", "bb_mid_20", "bb_bbp_20", "bb_bw_20", "kelt_bw_20", "squeeze_on", "ema20_slope", "ema50_slope", "ema200_slope",
             "trend_strength", "pullback_depth", "pullback_time", "adx14", "aroon14_up", "aroon14_dn", "rsi_14", "macd", "macdh", "stoch_k", "obv", "adosc",
             "dist_nearest_sr0", "upper_wick_ratio", "lower_wick_ratio", "wick_pressure", "minute_of_day", "dow", "session", "sess_asia")


def live_rows(s: Series) -> DataFrame:
    """Live features of bars that have every essential column."""
    return live(s).rows().dropna(subset=list(ESSENTIAL))


def shared(s: Series) -> Series:
    """Compact set with bias-corrected exponential averages; rows without every column are for the caller to drop."""
    s = ind.atr(s, 14)
    s = s.add(returns=R.pct_change(s, "close", 1), log_returns=R.log_return(s, "close"))
    s = ind.macd(ind.bollinger(ind.rsi(ind.sma(s, 10, 20, 50), 14), rank=None), adjust=True)
    s = s.add(volume_sma20=R.mean(s, "volume", 20), bb_position=F.col("bb_pct"))
    return s.add(volume_ratio=div("volume", "volume_sma20"))


#: columns of the compact set
SHARED = ("atr14", "returns", "log_returns", "sma10", "close_vs_sma10", "sma20", "close_vs_sma20", "sma50", "close_vs_sma50", "rsi14", "bb_upper", "bb_lower",
          "bb_position", "volume_sma20", "volume_ratio", "macd", "macd_signal", "macd_hist")


def universal(s: Series) -> Series:
    """Momentum, volatility, distance, RSI, volume, session and strength columns over the base set."""
    atr, c = atr_or(), F.col("close")
    s = s.add(**ind.momentum(s, 5, 10, 20, 50), volume_ma20=R.mean(s, "volume", 20), _q=R.quantile(s, "bb_width", 100, 0.2),
              _mid=(R.high(s, "close", 20) + R.low(s, "close", 20)) / 2, volume_declining=flag(F.col("volume") < s.lag("volume")),
              higher_high=flag(c > s.lag("close", 5)), lower_low=flag(c < s.lag("close", 5)), ema20_slope=R.pct_change(s, "ema20", 5),
              ema50_slope=R.pct_change(s, "ema50", 10), rsi_momentum=R.diff(s, "rsi14", 3))
    h = F.hour("bar_ts")
    x = F.col
    s = s.add(volatility_expanding=flag(x("vol10") > x("vol20")), ema_distance_fast=div(x("ema10") - x("ema20"), atr), ema_distance_slow=div(x("ema50") - x("ema100"), atr),
              dist_from_vwap=div(c - x("vwap"), atr), dist_from_ema50=div(c - x("ema50"), atr), rsi_normalized=(x("rsi14") - 50) / 50,
              rsi_extreme_oversold=flag(x("rsi14") < 25), rsi_extreme_overbought=flag(x("rsi14") > 75), volume_surge=div("volume", "volume_ma20"),
              breakout_strength=div(c - x("_mid"), atr), hour=h, day_of_week=F.weekday("bar_ts"), **S.overlap_flags(h), adx_strong_trend=flag(x("adx") > 25),
              adx_very_strong=flag(x("adx") > 35), macd_normalized=div("macd", atr), macd_hist_positive=flag(x("macd_hist") > 0), bb_oversold=flag(x("bb_pct") < 0.2),
              bb_overbought=flag(x("bb_pct") > 0.8), bb_squeeze=flag(x("bb_width") < x("_q")), price_above_ema20=flag(c > x("ema20")), price_above_ema50=flag(c > x("ema50")))
    both = flag(x("volume_surge") > 1.2) * 0.10 + flag(x("adx") > 20) * 0.10
    return s.add(long_signal_strength=flag(x("momentum_20") > 0) * 0.15 + flag(x("rsi14").between(40, 70)) * 0.15 + both,
                 short_signal_strength=flag(x("momentum_20") < 0) * 0.15 + flag(x("rsi14").between(30, 60)) * 0.15 + both)


def multiscale(s: Series) -> Series:
    """Momentum and volatility ranks, distances, autocorrelation, cyclic time and composite scores over the base set."""
    x, c, atr = F.col, F.col("close"), atr_or(0.015)
    s = s.add(**{f"mom_{k}": R.pct_change(s, "close", k) for k in (3, 5, 10, 20, 40, 60)}, **{f"vol_{n}": R.std(s, "return_1", n) for n in (5, 10, 20, 40)},
              dist_ema20=div(c - x("ema20"), atr), dist_ema50=div(c - x("ema50"), atr), dist_vwap=div(c - x("vwap"), atr), ema_spread=div(x("ema20") - x("ema50"), atr),
              bb_width_rank=R.pct_rank(s, "bb_width", 100), vol_ma40=R.mean(s, "volume", 40), **{f"_r{k}": s.lag("return_1", k) for k in (1, 3, 5)},
              rsi_mom=R.diff(s, "rsi14", 5), _rsi10=R.diff(s, "rsi14", 10), adx_momentum=R.diff(s, "adx", 5))
    s = s.add(**{f"mom_{k}_rank": R.pct_rank(s, f"mom_{k}", 100) for k in (3, 5, 10, 20, 40, 60)}, **{f"vol_{n}_rank": R.pct_rank(s, f"vol_{n}", 200) for n in (5, 10, 20, 40)},
              mom_accel_5=R.diff(s, "mom_5", 2), mom_accel_20=R.diff(s, "mom_20", 5), vwap_momentum=R.diff(s, "dist_vwap", 3),
              vol_regime_change=F.coalesce(div("vol_20", R.mean(s, "vol_40", 20)), F.lit(1.0)),
              **{f"return_autocorr_{k}": F.when(F.count("return_1").over(s.w(50)) == 50, R.corr(s, "return_1", f"_r{k}", 50 - k)) for k in (1, 3, 5)})
    h = F.hour("bar_ts")
    t = S.time_features(F.col("bar_ts"))
    return s.add(vol_expanding=flag(x("vol_10") > x("vol_20")), ema_cross=flag(x("ema20") > x("ema50")) * 2 - 1, rsi_zscore=(x("rsi14") - 50) / 15,
                 rsi_extreme=flag((x("rsi14") < 25) | (x("rsi14") > 75)), rsi_divergence=x("_rsi10") - x("mom_10") * 100, bb_position=(x("bb_pct") - 0.5) * 2,
                 bb_squeeze=flag(x("bb_width_rank") < 0.2), bb_expansion=flag(x("bb_width_rank") > 0.8), adx_normalized=x("adx") / 50, adx_trending=flag(x("adx") > 25),
                 di_diff=x("plus_di") - x("minus_di"), di_ratio=F.log1p("plus_di") - F.log1p("minus_di"), vol_ratio40=div("volume", "vol_ma40"),
                 surge18=flag(x("vol_ratio20") > 1.8), dry06=flag(x("vol_ratio20") < 0.6), **ind.wicks(), hour_sin=t["hour_sin"], hour_cos=t["hour_cos"], dow_sin=t["dow_sin"],
                 dow_cos=t["dow_cos"], session_overlap=flag((h >= 13) & (h < 16)), mom_vol_ratio=x("mom_20") / (x("vol_20") + 1e-6),
                 mean_reversion_score=F.abs(x("dist_ema50")) * (1 - x("vol_20_rank")), trend_score=x("adx") / 50 * F.abs(x("mom_20")) * 100)


def engineered(s: Series) -> Series:
    """Decayed momentum, z-scores, skewness, kurtosis and a regime score over the base set."""
    x, c, atr = F.col, F.col("close"), atr_or()
    s = s.add(**ind.momentum(s, 5, 10, 20, 50), **{f"vol_{n}": R.std(s, "return_1", n) for n in (10, 20, 50)}, volume_zscore=R.zscore(s, "volume", 20),
              volume_trend=div(R.mean(s, "volume", 10), R.mean(s, "volume", 50)), volume_price_correlation=R.corr(s, "volume", "return_1", 20),
              higher_high=flag(c > R.high(s, "close", 10, -1)), lower_low=flag(c < R.low(s, "close", 10, -1)), inside_bar=flag(F.abs(R.diff(s, "close", 5)) < atr * 0.5),
              _q=R.quantile(s, "bb_width", 100, 0.2), rsi_divergence=R.diff(s, "rsi14", 5) - x("return_5") * 100, adx_slope=R.diff(s, "adx", 3),
              macd_hist_slope=R.diff(s, "macd_hist", 3), macd_zero_cross=flag(x("macd_hist") * s.lag("macd_hist") < 0), skewness_20=R.skew(s, "return_1", 20),
              kurtosis_20=R.kurt(s, "return_1", 20))
    s = s.emas(adjust=True, dense=True, **{f"momentum_{k}_ema": (f"momentum_{k}", span(k // 2), k) for k in (5, 10, 20, 50)})
    s = s.add(**{f"vol_{n}_zscore": R.zscore(s, f"vol_{n}", 100) for n in (10, 20, 50)})
    h, rsi = F.hour("bar_ts"), x("rsi14")
    s = s.add(mean_reversion_20=div(c - x("ema20"), atr), mean_reversion_50=div(c - x("ema50"), atr), trend_alignment=flag(x("ema10") > x("ema50")) * 2 - 1,
              trend_strength=div(F.abs(x("ema10") - x("ema50")), "ema50"), rsi_zscore=(rsi - 50) / 25,
              rsi_regime=F.when((rsi > 0) & (rsi <= 30), 0).when(rsi > 70, 2).when(rsi > 30, 1), bb_squeeze=flag(x("bb_width") < x("_q")),
              bb_extreme=flag((x("bb_pct") < 0.05) | (x("bb_pct") > 0.95)), bb_mean_reversion=(x("bb_pct") - 0.5) * 2, adx_strong=flag(x("adx") > 25),
              di_spread=x("plus_di") - x("minus_di"), di_crossover=flag(x("plus_di") > x("minus_di")) * 2 - 1, is_london_open=flag(h.between(8, 16)),
              is_ny_open=flag(h.between(13, 21)), is_overlap=flag(h.between(13, 16)))
    return s.add(mean_reversion_20_extreme=flag(F.abs(x("mean_reversion_20")) > 2),
                 favorable_regime=x("adx_strong") * 0.3 + flag(x("vol_20_zscore") < 0) * 0.3 + flag(x("volume_trend") > 1) * 0.2)


def trend(s: Series) -> Series:
    """Trend set from raw bars: EMA 8/21/55/144/233, alignment, range expansion, exponential ADX and breakouts."""
    x, c = F.col, F.col("close")
    spans = (8, 21, 55, 144, 233)
    s = ind.adx_ewm(s)
    s = s.emas(dense=True, **{f"ema_{n}": ("close", span(n)) for n in spans})
    s = s.add(**{f"mom_{k}": R.pct_change(s, "close", k) for k in (3, 5, 10, 20, 40, 60, 120)}, atr_14=R.mean(s, "_tr", 14), atr_28=R.mean(s, "_tr", 28),
              return_1=R.pct_change(s, "close", 1), hh=flag(x("high") > s.lag("high")), ll=flag(x("low") < s.lag("low")), range=div(x("high") - x("low"), "close"),
              ema_8_slope=R.pct_change(s, "ema_8", 5), ema_21_slope=R.pct_change(s, "ema_21", 10), ema_55_slope=R.pct_change(s, "ema_55", 20),
              adx_rising=flag(x("adx") > s.lag("adx", 5)), _h20=R.high(s, "high", 20), _l20=R.low(s, "low", 20), _ph=R.high(s, "high", 20, -1), _pl=R.low(s, "low", 20, -1))
    s = s.add(vol_pct=R.std(s, "return_1", 10), hh_count_10=R.count_of(s, "hh", 10), ll_count_10=R.count_of(s, "ll", 10), range_avg=R.mean(s, "range", 20),
              _at=F.when(x("atr_14") > 0, x("atr_14")).otherwise(c * 0.02))
    e = [x(f"ema_{n}") for n in spans]
    return s.add(vol_breakout=flag(x("vol_pct") > R.mean(s, "vol_pct", 50) * 1.5), mom_accel_short=x("mom_10") - x("mom_5"), mom_accel_long=x("mom_40") - x("mom_20"),
                 mom_consistency=(F.signum("mom_5") + F.signum("mom_10") + F.signum("mom_20")) / 3, atr_ratio=div("atr_14", "atr_28"),
                 **{f"dist_ema_{n}": div(c - x(f"ema_{n}"), "_at") for n in spans}, ema_bullish=flag((e[0] > e[1]) & (e[1] > e[2]) & (e[2] > e[3])),
                 ema_bearish=flag((e[0] < e[1]) & (e[1] < e[2]) & (e[2] < e[3])), range_expansion=div("range", "range_avg"), adx_strong=flag(x("adx") > 25),
                 adx_very_strong=flag(x("adx") > 40), dc_pos=F.coalesce(div(c - x("_l20"), x("_h20") - x("_l20")), F.lit(0.0)),
                 breakout_high=flag(c >= x("_ph")), breakout_low=flag(c <= x("_pl")))


def fast(s: Series) -> Series:
    """Small set: momentum, volatility regime, trend, RSI, ADX, bands, volume and named sessions."""
    x, c, atr = F.col, F.col("close"), atr_or()
    s = ind.adx(ind.bollinger(ind.rsi(ind.ema(ind.atr(s, 14), 20, 50), 14), rank=None))
    s = s.add(**{f"mom_{k}": R.pct_change(s, "close", k) for k in (5, 10, 20)}, return_1=R.pct_change(s, "close", 1), _vm=R.mean(s, "volume", 20))
    s = s.add(vol_10=R.std(s, "return_1", 10), vol_20=R.std(s, "return_1", 20))
    ts = F.col("bar_ts")
    return s.add(vol_regime=flag(x("vol_10") > x("vol_20")), vol_ratio=div("vol_10", "vol_20"), trend=flag(x("ema20") > x("ema50")) * 2 - 1,
                 trend_strength=div(F.abs(x("ema20") - x("ema50")), atr), dist_ema50=div(c - x("ema50"), atr), rsi_norm=(x("rsi14") - 50) / 50,
                 rsi_extreme=flag((x("rsi14") < 30) | (x("rsi14") > 70)), adx_strong=flag(x("adx") > 25), bb_pos=(x("bb_pct") - 0.5) * 2, vol_surge=div("volume", "_vm"),
                 minute_of_day=S.minute_of_day(ts), dow=F.weekday(ts), session=S.named_session(F.hour(ts)))


def realtime(s: Series) -> Series:
    """Set computed on the newest bars: ratios, averages, rates of change, volatility, RSI, MACD and bands."""
    s = ind.macd(ind.bollinger(ind.rsi(ind.atr(s, 14), 7, 14, 21), rank=None))
    s = s.add(returns=R.pct_change(s, "close", 1), log_returns=R.log_return(s, "close"), high_low_ratio=div(F.col("high") - F.col("low"), "close"),
              close_open_ratio=div(F.col("close") - F.col("open"), "open"), **{f"sma_{n}": R.mean(s, "close", n) for n in (5, 10, 20, 50)},
              **{f"roc_{n}": R.pct_change(s, "close", n) for n in (5, 10, 20, 50)}, volume_sma_20=R.mean(s, "volume", 20))
    return s.add(**{f"price_to_sma_{n}": div("close", f"sma_{n}") for n in (5, 10, 20, 50)}, **{f"volatility_{n}": R.std(s, "returns", n) for n in (5, 10, 20)},
                 volume_ratio=div("volume", "volume_sma_20"))


def micro(s: Series) -> Series:
    """Regime, momentum, mean reversion and microstructure blocks."""
    x, c = F.col, F.col("close")
    s = ind.bollinger(ind.rsi(ind.ema(ind.atr(s, 14), 20, 50, 200), 14), rank=None)
    s = s.add(regime_vol_percentile=R.frac_below(s, "atr14", 100), _h=R.high(s, "high", 20), _l=R.low(s, "low", 20), **{f"momentum_roc_{k}": R.pct_change(s, "close", k) for k in (5, 10, 20)},
              **{f"momentum_strength_{k}": div(R.diff(s, "close", k), "atr14") for k in (5, 10)}, **{f"sma_{n}": R.mean(s, "close", n) for n in (20, 50, 100)},
              _vm=R.mean(s, "volume", 20), micro_gap=x("open") - s.lag("close"), micro_gap_pct=div(x("open") - s.lag("close"), s.lag("close")))
    p, h, rng = x("regime_vol_percentile"), F.hour("bar_ts"), x("high") - x("low")
    up, dn = x("high") - F.greatest("open", "close"), F.least("open", "close") - x("low")
    z = F.lit(0.0)
    return s.add(regime_vol=F.when((p > 0) & (p <= 0.33), 0).when((p > 0.33) & (p <= 0.67), 1).when(p > 0.67, 2), regime_trend_20_50=flag(x("ema20") > x("ema50")) * 2 - 1,
                 regime_trend_50_200=flag(x("ema50") > x("ema200")) * 2 - 1, regime_session_asian=flag(h < 8), regime_session_london=flag((h >= 8) & (h < 16)),
                 regime_session_ny=flag((h >= 13) & (h < 21)), regime_range_position=F.when(x("_h").isNotNull(), F.coalesce(div(c - x("_l"), x("_h") - x("_l")), z)),
                 momentum_accel=x("momentum_roc_5") - x("momentum_roc_10"), **{f"mr_distance_sma_{n}": div(c - x(f"sma_{n}"), f"sma_{n}") for n in (20, 50, 100)},
                 mr_bb_position=x("bb_pct"), mr_bb_extreme=flag((x("bb_pct") > 0.95) | (x("bb_pct") < 0.05)), mr_rsi_oversold=flag(x("rsi14") < 30),
                 mr_rsi_overbought=flag(x("rsi14") > 70), mr_rsi_neutral=flag((x("rsi14") >= 40) & (x("rsi14") <= 60)), micro_body=F.abs(c - x("open")), micro_upper_wick=up,
                 micro_lower_wick=dn, micro_total_range=rng, micro_body_ratio=F.coalesce(div(F.abs(c - x("open")), rng), z), micro_wick_ratio=F.coalesce(div(up + dn, rng), z),
                 micro_volume_surge=div("volume", x("_vm") + 1), micro_volume_anomaly=flag(div("volume", x("_vm") + 1) > 2.0))


