"""Rule-based setups: flags per bar over the base features, in flag and in scored form."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.functions.rolling import div, flag
from marketspark.functions.sessions import in_hours
from marketspark.operators.gates import reasons
from marketspark.operators.joins import rule_blackout
from marketspark.operators.series import Series, span

x = lambda c: F.col(c)


def on(*flags: str) -> Column:
    """All 0/1 flags set."""
    out = F.col(flags[0]) == 1
    for f in flags[1:]:
        out = out & (F.col(f) == 1)
    return out


def momentum_breakout(s: Series) -> Series:
    """Compressed bands, a body beyond one ATR, a volume spike, averages that agree."""
    s = s.add(s1_bb_compressed=flag(x("bb_width_pct") < 0.20), s1_breakout_strength=ind.breakout_strength(), s1_ema_slope=R.pct_change(s, "ema10", 5),
              s1_vol_ratio=div("volume", "vol_ma20"), s1_ema_fast_above_slow=flag(x("ema10") > x("ema20")), s1_price_vs_vwap=div(x("close") - x("vwap"), "atr14"))
    b = x("s1_breakout_strength")
    s = s.add(s1_is_breakout=flag(F.abs(b) > 1.0), s1_breakout_up=flag(b > 1.0), s1_breakout_down=flag(b < -1.0), s1_vol_spike=flag(x("s1_vol_ratio") > 1.5),
              s1_ema_momentum_up=flag(x("s1_ema_slope") > 0))
    return s.add(s1_long_setup=flag(on("s1_bb_compressed", "s1_breakout_up", "s1_vol_spike", "s1_ema_fast_above_slow")),
                 s1_short_setup=flag(on("s1_bb_compressed", "s1_breakout_down", "s1_vol_spike") & (x("s1_ema_fast_above_slow") == 0)))


def momentum_breakout_scored(s: Series, percentile: float = 0.35) -> Series:
    """Band squeeze, body of an ATR and volume surge, with a confidence that grows with both."""
    s = s.add(_w=div(F.col("_sd") * 2, "bb_middle"), _vr=div("volume", R.mean(s, "volume", 20)), _bs=div(F.abs(x("close") - x("open")), "atr14"))
    s = s.add(_th=R.quantile(s, "_w", 100, percentile))
    enter = (x("atr14") > 0) & (x("_w") <= x("_th")) & (x("_bs") >= 1.0) & (x("_vr") >= 1.5)
    conf = F.least(F.lit(1.0), (x("_bs") - 1.0) * 0.3 + (x("_vr") - 1.5) * 0.2 + 0.5)
    s = s.add(s1b_enter=flag(enter))
    return s.add(s1b_confidence=F.when(x("s1b_enter") == 1, conf).otherwise(0.0), s1b_tp=x("close") + x("atr14") * 1.8, s1b_sl=x("close") - x("atr14") * 0.9)


def mean_reversion(s: Series) -> Series:
    """Far from VWAP or EMA50 in a ranging market with RSI at an extreme."""
    s = s.add(s2_vwap_deviation=ind.deviation("vwap"), s2_ema50_deviation=ind.deviation("ema50"), s2_rsi_oversold=flag(x("rsi14") < 30),
              s2_rsi_overbought=flag(x("rsi14") > 70), s2_ranging_regime=flag(x("adx") < 30))
    v, e = x("s2_vwap_deviation"), x("s2_ema50_deviation")
    s = s.add(s2_extreme_high=F.greatest(flag(v > 1.5), flag(e > 1.5)), s2_extreme_low=F.greatest(flag(v < -1.5), flag(e < -1.5)),
              s2_rsi_extreme=F.greatest("s2_rsi_oversold", "s2_rsi_overbought"))
    return s.add(s2_long_setup=flag(on("s2_extreme_low", "s2_rsi_oversold", "s2_ranging_regime")),
                 s2_short_setup=flag(on("s2_extreme_high", "s2_rsi_overbought", "s2_ranging_regime")))


def mean_reversion_scored(s: Series) -> Series:
    """Quiet trend, 1.5 ATR from cumulative VWAP, RSI extreme on the far side.

    The RSI term of the confidence takes the smaller of its two distances and so always lowers it.
    """
    s = s if s.has("vwap_cum") else ind.vwap_cumulative(s)
    dist, rsi, c, vw = F.abs(x("close") - x("vwap_cum")), x("rsi14"), x("close"), x("vwap_cum")
    low, high = (rsi <= 30) & (c < vw), (rsi >= 70) & (c > vw)
    enter = (x("atr14") > 0) & (x("adx") < 25) & (dist >= x("atr14") * 1.5) & (low | high)
    conf = F.least(F.lit(1.0), F.least(30 - rsi, rsi - 70) / 20 * 0.3 + (div(dist, "atr14") - 1.5) / 1.5 * 0.2 + 0.5)
    s = s.add(s2b_enter=flag(enter))
    return s.add(s2b_confidence=F.when(x("s2b_enter") == 1, conf).otherwise(0.0))


def pullback_trend(s: Series) -> Series:
    """Trend by the EMA100 slope, a pullback to EMA20 or a retracement level, RSI and MACD on its side."""
    s = ind.swing_fib(s, 20)
    s = s.add(s3_ema100_slope=R.pct_change(s, "ema100", 20), s3_dist_to_ema20=ind.deviation("ema20"), s3_above_ema100=flag(x("close") > x("ema100")),
              s3_below_ema100=flag(x("close") < x("ema100")), **{f"s3_near_{f}": ind.at_level(f) for f in ind.FIB_LEVELS}, s3_rsi_above_50=flag(x("rsi14") > 50),
              s3_rsi_below_50=flag(x("rsi14") < 50), s3_macd_positive=flag(x("macd") > 0), s3_macd_negative=flag(x("macd") < 0))
    s = s.add(s3_uptrend=flag(x("s3_ema100_slope") > 0.001), s3_downtrend=flag(x("s3_ema100_slope") < -0.001), s3_at_ema20=flag(F.abs("s3_dist_to_ema20") < 0.5),
              s3_near_any_fib=F.greatest(*(f"s3_near_{f}" for f in ind.FIB_LEVELS)))
    at = on("s3_at_ema20") | on("s3_near_any_fib")
    return s.add(s3_long_setup=flag(on("s3_uptrend", "s3_above_ema100", "s3_rsi_above_50", "s3_macd_positive") & at),
                 s3_short_setup=flag(on("s3_downtrend", "s3_below_ema100", "s3_rsi_below_50", "s3_macd_negative") & at))


def pullback_trend_scored(s: Series) -> Series:
    """Pullback to EMA20 or into the 38-50 % zone of a 50-bar swing, then a rising close, with volume."""
    s = s.add(s3b_slope=div(R.diff(s, "ema100", 5), "ema100"), _h=R.high(s, "high", 50), _l=R.low(s, "low", 50), _vm=R.mean(s, "volume", 20))
    lo, hi = x("_l") + (x("_h") - x("_l")) * 0.382, x("_l") + (x("_h") - x("_l")) * 0.5
    s = s.add(s3b_uptrend=flag((x("s3b_slope") > 0.0001) & (x("close") > x("ema100"))), s3b_downtrend=flag((x("s3b_slope") < -0.0001) & (x("close") < x("ema100"))),
              s3b_touching=flag(div(F.abs(x("close") - x("ema20")), "atr14") < 0.3), s3b_in_fib_zone=flag((x("close") >= lo) & (x("close") <= hi)),
              s3b_volume_ok=flag(x("volume") >= x("_vm")))
    s = s.add(s3b_is_pullback=F.greatest("s3b_touching", "s3b_in_fib_zone"))
    s = s.add(s3b_bounce=flag((s.lag("s3b_is_pullback") == 1) & (x("close") > s.lag("close")) & (s.index >= 2)))
    s = s.add(s3b_long_setup=flag(on("s3b_uptrend", "s3b_is_pullback", "s3b_bounce", "s3b_volume_ok") & (x("rsi14") > 50)),
              s3b_short_setup=flag(on("s3b_downtrend", "s3b_is_pullback", "s3b_bounce", "s3b_volume_ok") & (x("rsi14") < 50)))
    return s.add(s3b_signal_strength=signal_strength("s3b"))


def breakout_retest(s: Series) -> Series:
    """Was consolidating, broke its channel within ten bars, and is back at the level."""
    ph, pl = s.lag("donchian_high"), s.lag("donchian_low")
    s = s.add(s4_consolidation=ind.consolidation(s), s4_narrow=flag(x("donchian_width") < 0.015), s4_breakout_high=flag(x("close") > ph), s4_breakout_low=flag(x("close") < pl),
              s4_dist_high=div(x("close") - ph, "atr14"), s4_dist_low=div(pl - x("close"), "atr14"), _rh=R.high(s, "donchian_high", 10, -1), _rl=R.low(s, "donchian_low", 10, -1),
              s4_rsi_strong=flag(x("rsi14") > 55), s4_rsi_weak=flag(x("rsi14") < 45), s4_macd_positive=flag(x("macd") > 0), s4_macd_negative=flag(x("macd") < 0))
    s = s.add(s4_strong_breakout_high=flag(x("s4_dist_high") > 0.5), s4_strong_breakout_low=flag(x("s4_dist_low") > 0.5),
              s4_retesting_high=flag(div(F.abs(x("close") - x("_rh")), "atr14") < 0.5), s4_retesting_low=flag(div(F.abs(x("close") - x("_rl")), "atr14") < 0.5),
              _was=s.lag("s4_consolidation", 5), _bh=R.any_of(s, "s4_breakout_high", 10), _bl=R.any_of(s, "s4_breakout_low", 10))
    return s.add(s4_long_setup=flag(on("_was", "_bh", "s4_retesting_high", "s4_rsi_strong", "s4_macd_positive")),
                 s4_short_setup=flag(on("_was", "_bl", "s4_retesting_low", "s4_rsi_weak", "s4_macd_negative")))


def breakout_retest_scored(s: Series, n: int = 12, keep: int = 6) -> Series:
    """Break of the range of the bars before this one, level kept for six bars, retest, then confirmation."""
    s = s.add(_h=R.high(s, "high", n, -1), _l=R.low(s, "low", n, -1), _vm=R.mean(s, "volume", 20))
    a = x("atr14")
    s = s.add(_rng=x("_h") - x("_l"))
    tight = x("_rng") < s.lag("atr14") * 1.5
    s = s.add(s4b_breakout_up=flag((x("close") > x("_h") + a * 0.8) & tight), s4b_breakout_down=flag((x("close") < x("_l") - a * 0.8) & tight))
    up, dn = x("s4b_breakout_up") == 1, x("s4b_breakout_down") == 1
    s = s.add(_lu=F.when(up, x("_h")), _ld=F.when(dn & ~up, x("_l")), _rh=F.when(up | dn, x("_rng")))
    s = s.add(s4b_level_up=R.ffill(s, "_lu", keep), s4b_level_down=R.ffill(s, "_ld", keep), s4b_range=R.ffill(s, "_rh", keep))
    s = s.add(s4b_retest_up=flag(F.abs(x("low") - x("s4b_level_up")) <= a * 0.3), s4b_retest_down=flag(F.abs(x("high") - x("s4b_level_down")) <= a * 0.3))
    pc = s.lag("close")
    s = s.add(s4b_confirmed_up=flag((s.lag("s4b_retest_up") == 1) & (x("close") > pc)), s4b_confirmed_down=flag((s.lag("s4b_retest_down") == 1) & (x("close") < pc)),
              s4b_volume_ok=flag(x("volume") >= x("_vm") * 1.2))
    s = s.add(s4b_long_setup=flag(on("s4b_confirmed_up", "s4b_volume_ok") & ((x("macd") > 0) | (x("rsi14") > 55))),
              s4b_short_setup=flag(on("s4b_confirmed_down", "s4b_volume_ok") & ((x("macd") < 0) | (x("rsi14") < 45))))
    return s.add(s4b_signal_strength=signal_strength("s4b"), s4b_tp_distance=x("s4b_range") * 1.5)


def momentum_adx(s: Series) -> Series:
    """Strong and volatile trend with direction, price and EMA20 on one side; exit when EMA20 is lost."""
    s = s.add(s5_atr_above_median=flag(x("atr14") > R.median(s, "atr14", 100)), s5_atr_percentile=R.pct_rank(s, "atr14", 100), s5_ema50_slope=R.pct_change(s, "ema50", 10),
              s5_ema20_slope=R.pct_change(s, "ema20", 5), s5_adx_strong=flag(x("adx") > 25), s5_adx_very_strong=flag(x("adx") > 35), s5_di_spread=x("plus_di") - x("minus_di"),
              _above=flag(x("ema20") > x("ema50")))
    s = s.add(s5_high_volatility=flag(x("s5_atr_percentile") > 0.5), s5_cross_up=flag((x("_above") == 1) & (s.lag("_above") == 0)), s5_cross_down=flag((x("_above") == 0) & (s.lag("_above") == 1)))
    trending = on("s5_adx_strong", "s5_high_volatility")
    long = trending & (x("s5_ema50_slope") > 0) & (x("s5_di_spread") > 0) & (x("close") > x("ema50")) & ((x("s5_ema20_slope") > 0) | on("s5_cross_up"))
    short = trending & (x("s5_ema50_slope") < 0) & (x("s5_di_spread") < 0) & (x("close") < x("ema50")) & ((x("s5_ema20_slope") < 0) | on("s5_cross_down"))
    return s.add(s5_regime_trending=flag(trending), s5_long_setup=flag(long), s5_short_setup=flag(short), s5_exit_long=flag(on("s5_cross_down") | (x("close") < x("ema20"))))


def momentum_adx_scored(s: Series) -> Series:
    """Trend with an ATR between its median and 90th percentile, a bounce off EMA20, and a normal spread if one is given."""
    s = s.add(_med=R.median(s, "atr14", 100), _q90=R.quantile(s, "atr14", 100, 0.90), s5b_adx_rising=flag(x("adx") > s.lag("adx")), s5b_strong=flag(x("adx") >= 25),
              s5b_uptrend=flag(x("close") > x("ema50")), s5b_downtrend=flag(x("close") < x("ema50")), s5b_at_ema20=flag(div(F.abs(x("close") - x("ema20")), "atr14") < 0.3),
              s5b_cross_down=R.crosses_below(s, "close", "ema20"), s5b_cross_up=R.crosses_above(s, "close", "ema20"),
              s5b_spread_ok=flag(x("spread") < R.quantile(s, "spread", 60, 0.90)) if s.has("spread") else F.lit(1))
    pc, was = s.lag("close"), s.lag("s5b_at_ema20") == 1
    s = s.add(s5b_atr_ok=flag((x("atr14") >= x("_med")) & (x("atr14") < x("_q90"))), s5b_bounce_up=flag(was & (x("close") > pc) & on("s5b_uptrend")),
              s5b_bounce_down=flag(was & (x("close") < pc) & on("s5b_downtrend")))
    s = s.add(s5b_long_setup=flag(on("s5b_strong", "s5b_uptrend", "s5b_bounce_up", "s5b_atr_ok", "s5b_spread_ok")),
              s5b_short_setup=flag(on("s5b_strong", "s5b_downtrend", "s5b_bounce_down", "s5b_atr_ok", "s5b_spread_ok")))
    return s.add(s5b_signal_strength=signal_strength("s5b"), s5b_tp_distance=x("atr14") * 1.8)


def mtf_alignment(s: Series) -> Series:
    """Own and daily trend agree, price is near EMA20 on the right side. ``ema100_htf`` comes from an as-of join; without it the own trend stands in."""
    s = s.add(_s100=R.pct_change(s, "ema100", 10), _s50=R.pct_change(s, "ema50", 10), s6_dist_to_ema20=ind.deviation("ema20"), s6_atr_percentile=R.pct_rank(s, "atr14", 100),
              s6_swing_high=R.high(s, "high", 10), s6_swing_low=R.low(s, "low", 10))
    if s.has("ema100_htf"):
        s = s.add(_htf=R.pct_change(s, "ema100_htf", 5))
        up, dn = flag(x("_htf") > 0), flag(x("_htf") < 0)
    else:
        up, dn = flag(x("_s100") > 0.001), flag(x("_s100") < -0.001)
    s = s.add(s6_daily_uptrend=up, s6_daily_downtrend=dn, s6_trend_aligned_up=flag((x("_s100") > 0.001) & (x("_s50") > 0)), s6_trend_aligned_down=flag((x("_s100") < -0.001) & (x("_s50") < 0)),
              s6_near_ema20=flag(F.abs("s6_dist_to_ema20") < 1.0), s6_at_ema20=flag(F.abs("s6_dist_to_ema20") < 0.5), s6_atr_sufficient=flag(x("s6_atr_percentile") > 0.40))
    s = s.add(s6_mtf_aligned_up=flag(on("s6_daily_uptrend", "s6_trend_aligned_up")), s6_mtf_aligned_down=flag(on("s6_daily_downtrend", "s6_trend_aligned_down")))
    return s.add(s6_long_setup=flag(on("s6_mtf_aligned_up", "s6_near_ema20", "s6_atr_sufficient") & (x("close") > x("ema50")) & (x("rsi14") > 55)),
                 s6_short_setup=flag(on("s6_mtf_aligned_down", "s6_near_ema20", "s6_atr_sufficient") & (x("close") < x("ema50")) & (x("rsi14") < 45)))


def mtf_alignment_scored(s: Series, day: int = 6) -> Series:
    """Day trend from six-bar frames, bounce off EMA50, half size when the day's ATR is extreme, swing stops."""
    s = s.add(_datr=R.mean(s, "atr14", day) * (day ** 0.5), _dc=F.when(s.index >= day - 1, x("close")), _at=flag(div(F.abs(x("close") - x("ema50")), "atr14") < 0.3),
              s6b_swing_high=R.high(s, "high", 50), s6b_swing_low=R.low(s, "low", 50))
    s = s.emas(dense=True, _dema=("_dc", span(100), day - 1))
    s = s.add(_slope=div(R.diff(s, "_dema", day), "_dema"), _q=R.quantile(s, "_datr", 100, 0.90), _pc=s.lag("close"), _was=s.lag("_at"))
    up4, dn4 = x("close") > x("ema50"), x("close") < x("ema50")
    s = s.add(s6b_aligned_up=flag((x("_dc") > x("_dema")) & (x("_slope") > 0.001) & up4), s6b_aligned_down=flag((x("_dc") < x("_dema")) & (x("_slope") < -0.001) & dn4),
              s6b_bounce_up=flag((x("_was") == 1) & (x("close") > x("_pc")) & up4), s6b_bounce_down=flag((x("_was") == 1) & (x("close") < x("_pc")) & dn4),
              s6b_atr_extreme=flag(x("_datr") >= x("_q")))
    s = s.add(s6b_long_setup=flag(on("s6b_aligned_up", "s6b_bounce_up") & (x("rsi14") > 55)), s6b_short_setup=flag(on("s6b_aligned_down", "s6b_bounce_down") & (x("rsi14") < 45)))
    return s.add(s6b_signal_strength=signal_strength("s6b"), s6b_position_multiplier=F.when(x("s6b_atr_extreme") == 1, 0.5).otherwise(1.0), s6b_tp_distance=x("atr14") * 2.5,
                 s6b_sl_distance_long=x("close") - x("s6b_swing_low"), s6b_sl_distance_short=x("s6b_swing_high") - x("close"))


def signal_strength(prefix: str) -> Column:
    """1 long, -1 short, 0 neither or both."""
    return F.col(f"{prefix}_long_setup") - F.col(f"{prefix}_short_setup")


@dataclass(frozen=True)
class Gate:
    """What must hold before a setup may trade."""
    regimes: tuple[str, ...]
    start_hour: int = 7
    end_hour: int = 22
    max_spread_atr: float = 0.02
    blackout: tuple[str, ...] = ()


def strategy_gate(df: DataFrame, gate: Gate) -> DataFrame:
    """First filter that blocks a bar, or ``ok``; absent inputs are not checked."""
    checks = []
    if "regime" in df.columns:
        checks.append(F.when(~F.col("regime").isin(*gate.regimes), "regime"))
    checks.append(F.when(~in_hours(F.hour("bar_ts"), gate.start_hour, gate.end_hour), "session"))
    if "spread" in df.columns:
        checks.append(F.when(F.col("spread") > F.col("atr14") * gate.max_spread_atr, "spread"))
    if gate.blackout:
        checks.append(F.when(rule_blackout(F.col("bar_ts"), "NFP" in gate.blackout, "CPI" in gate.blackout), "blackout"))
    return df.withColumn("reason", F.coalesce(F.get(reasons(*checks), F.lit(0)), F.lit("ok"))).withColumn("can_trade", F.col("reason") == "ok")


class Strategy(Protocol):
    """A plug-in: named inputs, named outputs, and a function that adds columns to a series."""
    requires: tuple[str, ...]
    produces: tuple[str, ...]

    def build(self, s: Series) -> Series: ...


@dataclass(frozen=True)
class RuleStrategy:
    build: Callable[[Series], Series]
    requires: tuple[str, ...]
    produces: tuple[str, ...]
    gate: Gate = field(default_factory=lambda: Gate(("Trend", "Neutral")))


REGISTRY: dict[str, Strategy] = {
    "momentum_breakout": RuleStrategy(momentum_breakout, ("bb_width_pct", "atr14", "vol_ma20", "ema10", "ema20", "vwap"), ("s1_long_setup", "s1_short_setup")),
    "mean_reversion": RuleStrategy(mean_reversion, ("vwap", "ema50", "atr14", "rsi14", "adx"), ("s2_long_setup", "s2_short_setup"), Gate(("Range", "Neutral"))),
    "pullback_trend": RuleStrategy(pullback_trend, ("ema100", "ema20", "atr14", "rsi14", "macd"), ("s3_long_setup", "s3_short_setup")),
    "breakout_retest": RuleStrategy(breakout_retest, ("donchian_high", "donchian_low", "donchian_width", "atr14", "rsi14", "macd"), ("s4_long_setup", "s4_short_setup")),
    "momentum_adx": RuleStrategy(momentum_adx, ("adx", "atr14", "ema50", "ema20", "plus_di", "minus_di"), ("s5_long_setup", "s5_short_setup"), Gate(("Trend",))),
    "mtf_alignment": RuleStrategy(mtf_alignment, ("ema100", "ema50", "ema20", "atr14", "rsi14"), ("s6_long_setup", "s6_short_setup")),
}


def register(name: str, strategy: Strategy) -> None:
    """Add a strategy of one's own; a name is taken once."""
    if name in REGISTRY:
        raise ValueError(f"strategy {name!r} exists")
    REGISTRY[name] = strategy


def run_strategy(s: Series, name: str) -> Series:
    """Run a registered strategy after checking what it reads, and check what it wrote."""
    st = REGISTRY[name]
    missing = [c for c in st.requires if not s.has(c)]
    if missing:
        raise ValueError(f"{name}: missing columns {missing}")
    out = st.build(s)
    missing = [c for c in st.produces if not out.has(c)]
    if missing:
        raise ValueError(f"{name}: did not write {missing}")
    return out
