"""Indicators as steps on a blocked series; each takes a Series and returns it with columns added."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketspark.functions import rolling as R
from marketspark.functions.rolling import div, flag
from marketspark.operators.series import Series, span, wilder_alpha


def tr_expr(s: Series) -> Column:
    """True range; the first row has only its own high-low."""
    pc = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def returns(s: Series) -> Series:
    return s.add(**{f"return_{k}": R.pct_change(s, "close", k) for k in (1, 5, 10, 20)},
                 log_return=R.log_return(s, "close"))


def atr(s: Series, *periods: int) -> Series:
    """Simple mean of the true range, and its share of the close."""
    periods = periods or (14,)
    s = s if s.has("trange") else s.add(trange=tr_expr(s))
    s = s.add(**{f"atr{n}": R.mean(s, "trange", n) for n in periods})
    return s.add(**{f"atr{n}_pct": div(f"atr{n}", F.col("close")) for n in periods})


def ema(s: Series, *periods: int) -> Series:
    s = s.emas(dense=True, **{f"ema{n}": ("close", span(n)) for n in periods})
    return s.add(**{f"ema{n}_dist": div(F.col("close") - F.col(f"ema{n}"), F.col("close")) for n in periods})


def sma(s: Series, *periods: int) -> Series:
    s = s.add(**{f"sma{n}": R.mean(s, "close", n) for n in periods})
    return s.add(**{f"sma{n}_dist": div(F.col("close") - F.col(f"sma{n}"), F.col("close")) for n in periods},
                 **{f"close_vs_sma{n}": div(F.col("close") - F.col(f"sma{n}"), f"sma{n}") for n in periods})


def rsi_expr(gain: Column, loss: Column) -> Column:
    """100 with no losses, null with neither gains nor losses."""
    return F.when(loss > 0, 100 - 100 / (1 + F.try_divide(gain, loss))).when(gain > 0, F.lit(100.0))


def rsi(s: Series, *periods: int) -> Series:
    """Relative strength from simple means of gains and losses."""
    periods = periods or (14,)
    if not s.has("_gain"):
        d = R.diff(s, "close")
        s = s.add(_gain=F.when(d > 0, d).otherwise(0.0), _loss=F.when(d < 0, -d).otherwise(0.0))
    s = s.add(**{f"rsi{n}": rsi_expr(R.mean(s, "_gain", n), R.mean(s, "_loss", n)) for n in periods})
    return s.add(**{f"rsi{n}_oversold": flag(F.col(f"rsi{n}") < 30) for n in periods},
                 **{f"rsi{n}_overbought": flag(F.col(f"rsi{n}") > 70) for n in periods})


def macd(s: Series, fast: int = 12, slow: int = 26, signal: int = 9, adjust: bool = False) -> Series:
    s = s.emas(adjust=adjust, dense=True, _fast=("close", span(fast)), _slow=("close", span(slow)))
    s = s.add(macd=F.col("_fast") - F.col("_slow")).emas(adjust=adjust, dense=True, macd_signal=("macd", span(signal)))
    return s.add(macd_hist=F.col("macd") - F.col("macd_signal"), macd_positive=flag(F.col("macd") > 0),
                 macd_cross_up=R.crosses_above(s, "macd", "macd_signal"))


def bollinger(s: Series, n: int = 20, k: float = 2.0, rank: int | None = 100) -> Series:
    s = s.add(bb_middle=R.mean(s, "close", n), _sd=R.std(s, "close", n))
    s = s.add(bb_upper=F.col("bb_middle") + F.col("_sd") * k, bb_lower=F.col("bb_middle") - F.col("_sd") * k)
    s = s.add(bb_width=div(F.col("bb_upper") - F.col("bb_lower"), "bb_middle"),
              bb_pct=div(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")))
    return s.add(bb_width_pct=R.pct_rank(s, "bb_width", rank)) if rank else s


def donchian(s: Series, n: int = 20, lagged: bool = True) -> Series:
    """Channel of the ``n`` rows before the current one (or up to it)."""
    end = -1 if lagged else 0
    s = s.add(donchian_high=R.high(s, "high", n, end), donchian_low=R.low(s, "low", n, end))
    hi, lo = F.col("donchian_high"), F.col("donchian_low")
    return s.add(donchian_mid=(hi + lo) / 2, donchian_width=div(hi - lo, F.col("close")))


def typical() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(s: Series, n: int = 100) -> Series:
    s = s.add(_tpv=typical() * F.col("volume"))
    s = s.add(vwap=div(R.total(s, "_tpv", n), R.total(s, "volume", n)))
    return s.add(vwap_dist=div(F.col("close") - F.col("vwap"), F.col("close")))


def vwap_cumulative(s: Series) -> Series:
    s = s.running_sums(_pv=typical() * F.col("volume"), _vv=F.col("volume"))
    return s.add(vwap_cum=div("_pv", "_vv"))


def directional(s: Series) -> Series:
    """True range and directional movements."""
    s = s.add(_up=R.diff(s, "high"), _down=-R.diff(s, "low"), _tr=tr_expr(s))
    up, down = F.col("_up"), F.col("_down")
    return s.add(_pdm=F.when((up > down) & (up > 0), up).otherwise(0.0),
                 _mdm=F.when((down > up) & (down > 0), down).otherwise(0.0))


def _dx() -> Column:
    return div(F.abs(F.col("plus_di") - F.col("minus_di")) * 100, F.col("plus_di") + F.col("minus_di"))


def adx(s: Series, n: int = 14) -> Series:
    """Directional index with simple means."""
    s = directional(s)
    s = s.add(_atr=R.mean(s, "_tr", n), _p=R.mean(s, "_pdm", n), _m=R.mean(s, "_mdm", n))
    s = s.add(plus_di=div("_p", "_atr") * 100, minus_di=div("_m", "_atr") * 100)
    s = s.add(_dxv=_dx())
    return s.add(adx=R.mean(s, "_dxv", n))


def adx_ewm(s: Series, n: int = 14) -> Series:
    """Directional index smoothed with ``n``-span exponential averages; DX is 0 with no movement."""
    s = directional(s)
    s = s.emas(dense=True, _atr=("_tr", span(n)), _p=("_pdm", span(n)), _m=("_mdm", span(n)))
    s = s.add(plus_di=div("_p", "_atr") * 100, minus_di=div("_m", "_atr") * 100)
    s = s.add(_dxe=F.coalesce(_dx(), F.lit(0.0)))
    return s.emas(adx=("_dxe", span(n)))


def volatility(s: Series, rank: int = 100) -> Series:
    s = s if s.has("return_1") else s.add(return_1=R.pct_change(s, "close", 1))
    s = s.add(**{f"vol{n}": R.std(s, "return_1", n) for n in (10, 20, 50)})
    return s.add(vol_percentile=R.pct_rank(s, "vol20", rank))


def parkinson(s: Series, n: int = 20) -> Series:
    """Root of the mean of squared log ranges, and the mean of their roots."""
    lr = F.ln(div(F.col("high"), F.col("low")))
    k = 1 / (4 * math.log(2))
    s = s.add(_lr2=lr * lr, _lra=F.abs(lr) * (k ** 0.5))
    return s.add(parkinson_vol=F.sqrt(R.mean(s, "_lr2", n) * k), parkinson_mean=R.mean(s, "_lra", n))


def volume_features(s: Series) -> Series:
    s = s.add(**{f"vol_ma{n}": R.mean(s, "volume", n) for n in (10, 20, 50)})
    s = s.add(**{f"vol_ratio{n}": div(F.col("volume"), f"vol_ma{n}") for n in (10, 20, 50)})
    return s.add(vol_spike=flag(F.col("vol_ratio20") > 1.5), vol_surge=flag(F.col("vol_ratio20") > 2.0),
                 vol_dry=flag(F.col("vol_ratio20") < 0.5))


def obv(s: Series) -> Series:
    """Signed running volume; the first row has no change and stays null."""
    s = s.add(_sv=F.signum(R.diff(s, "close")) * F.col("volume")).running_sums(_obv="_sv")
    s = s.add(obv=F.when(F.col("_sv").isNotNull(), F.col("_obv")))
    return s.emas(adjust=True, dense=True, obv_ema=("obv", span(20), 1))


def keltner(s: Series, n: int = 20, k: float = 2.0) -> Series:
    s = s if s.has("ema20") else s.emas(dense=True, **{f"ema{n}": ("close", span(n))})
    s = s if s.has("bb_width") else bollinger(s, n, rank=None)
    s = atr(s, 14, 20)
    band, mid = F.coalesce("atr20", "atr14"), F.col(f"ema{n}")
    s = s.add(kelt_up=mid + band * k, kelt_lo=mid - band * k)
    s = s.add(kelt_bw=div(F.col("kelt_up") - F.col("kelt_lo"), mid))
    return s.add(squeeze_on=flag(F.col("bb_width") < F.col("kelt_bw")))


def pullback(s: Series, n: int = 50) -> Series:
    s = s if s.has("atr14") else atr(s, 14)
    s = s.add(_rh=R.high(s, "close", n), _rl=R.low(s, "low", n), _since=R.bars_since_high(s, "close", n))
    return s.add(pullback_depth=div(F.col("_rh") - F.col("close"), "atr14"), pullback_time=F.coalesce(F.col("_since"), F.lit(0)),
                 dist_nearest_sr0=div(F.least(F.abs(F.col("_rh") - F.col("close")), F.abs(F.col("close") - F.col("_rl"))), "atr14"))


def wicks() -> dict[str, Column]:
    """Shape of one bar; ratios of an empty range are 0."""
    rng = F.col("high") - F.col("low")
    up, lo = F.col("high") - F.greatest(F.col("open"), F.col("close")), F.least(F.col("open"), F.col("close")) - F.col("low")
    z = F.lit(0.0)
    ur, lr = F.coalesce(div(up, rng), z), F.coalesce(div(lo, rng), z)
    return {"upper_wick_ratio": ur, "lower_wick_ratio": lr, "wick_pressure": ur - lr,
            "body_ratio": F.coalesce(div(F.abs(F.col("close") - F.col("open")), rng), z),
            "close_position": F.coalesce(div(F.col("close") - F.col("low"), rng), z), "bar_range": div(rng, F.col("close"))}


def ema_slope(s: Series, n: int, k: int) -> dict[str, Column]:
    e = F.col(f"ema{n}")
    p = s.lag(e, k)
    return {f"ema{n}_slope": div(e, p) - 1, f"ema{n}_slope_abs": div(e - p, F.abs(p))}


def gaps(s: Series) -> Series:
    s = s.add(gap=F.col("open") - s.lag("close"), _vm=R.mean(s, "volume", 20))
    return s.add(gap_pct=div("gap", s.lag("close")), volume_surge=div(F.col("volume"), "_vm"),
                 volume_anomaly=flag(div(F.col("volume"), "_vm") > 2))


#: fixed values: retracement levels
FIB_LEVELS = {"fib_382": 0.382, "fib_500": 0.5, "fib_618": 0.618}


def fib_levels(hi: Column, lo: Column) -> dict[str, Column]:
    return {n: hi - (hi - lo) * v for n, v in FIB_LEVELS.items()}


def swing_fib(s: Series, n: int = 20) -> Series:
    s = s.add(swing_high=R.high(s, "high", n), swing_low=R.low(s, "low", n))
    return s.add(**fib_levels(F.col("swing_high"), F.col("swing_low")))


def breakout_strength(atr_col: str = "atr14") -> Column:
    return div(F.col("close") - F.col("open"), atr_col)


def deviation(ma: str, atr_col: str = "atr14") -> Column:
    return div(F.col("close") - F.col(ma), atr_col)


def consolidation(s: Series, n: int = 20, k: float = 1.5) -> Column:
    return flag(R.high(s, "high", n, -1) - R.low(s, "low", n, -1) < F.col("atr14") * k)


def at_level(level: str, tol: float = 0.5) -> Column:
    return flag(F.abs(F.col("close") - F.col(level)) < F.col("atr14") * tol)


def momentum(s: Series, *ks: int) -> dict[str, Column]:
    return {f"momentum_{k}": R.pct_change(s, "close", k) for k in ks}


def volatility_ratio(s: Series, short: int = 10, long: int = 50) -> Column:
    return div(R.std(s, "return_1", short), R.std(s, "return_1", long))


def momentum_shape(s: Series) -> Series:
    """Acceleration, sign consistency, and counts of higher highs and lower lows."""
    s = s.add(_r=R.pct_change(s, "close", 1), **momentum(s, 5, 10),
              hh=flag(F.col("high") > s.lag("high")), ll=flag(F.col("low") < s.lag("low")))
    return s.add(momentum_accel=R.diff(s, "momentum_5", 5), momentum_consistency=R.mean(s, F.signum("_r"), 10),
                 hh_count=R.count_of(s, "hh", 10), ll_count=R.count_of(s, "ll", 10))


def wilder(s: Series, dense: bool = False, **specs) -> Series:
    """Wilder averages ``name=(column, n)``; ``dense`` as in :meth:`~marketspark.operators.series.Series.emas`."""
    return s.emas(dense=dense, **{k: (v[0], wilder_alpha(v[1]), *v[2:]) for k, v in specs.items()})


