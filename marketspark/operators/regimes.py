"""Market regimes: trend, volatility, alignment, ranging, and the Trend/Range/Neutral class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketspark.functions import rolling as R
from marketspark.functions.rolling import clip, div, flag
from marketspark.operators.series import Series


def trend_regime(s: Series) -> Series:
    """ADX below 20, 20 to 30, from 30; direction by the directional indicators."""
    a = F.col("adx")
    return s.add(regime_trend_weak=flag(a < 20), regime_trend_moderate=flag((a >= 20) & (a < 30)), regime_trend_strong=flag(a >= 30),
                 regime_trend_up=flag(F.col("plus_di") > F.col("minus_di")), regime_trend_down=flag(F.col("plus_di") < F.col("minus_di")))


def volatility_regime(s: Series) -> Series:
    """Rank of the ATR among 100 rows at .33 and .67; expanding against 5 rows ago."""
    s = s.add(atr_percentile=R.pct_rank(s, "atr14", 100), atr_expanding=flag(F.col("atr14") > s.lag("atr14", 5)))
    p = F.col("atr_percentile")
    return s.add(regime_vol_low=flag(p < 0.33), regime_vol_medium=flag((p >= 0.33) & (p < 0.67)), regime_vol_high=flag(p >= 0.67))


def ema_alignment(s: Series, back: int = 10) -> Series:
    """Slopes of the averages over ``back`` rows and whether 20, 50 and 100 agree."""
    s = s.add(**{f"ema{n}_slope": R.pct_change(s, f"ema{n}", back) for n in (20, 50, 100, 200)})
    up = [F.col(f"ema{n}_slope") > 0 for n in (20, 50, 100)]
    dn = [F.col(f"ema{n}_slope") < 0 for n in (20, 50, 100)]
    return s.add(**{f"ema{n}_slope_up": flag(F.col(f"ema{n}_slope") > 0) for n in (20, 50, 100, 200)},
                 **{f"ema{n}_slope_down": flag(F.col(f"ema{n}_slope") < 0) for n in (20, 50, 100, 200)},
                 ema_aligned_up=flag(up[0] & up[1] & up[2]), ema_aligned_down=flag(dn[0] & dn[1] & dn[2]))


def ranging(s: Series, n: int = 50, limit: float = 0.03) -> Series:
    s = s.add(range_pct=div(R.high(s, "high", n) - R.low(s, "low", n), "close"))
    return s.add(regime_ranging=flag(F.col("range_pct") < limit))


def classify(s: Series, trend_adx: float = 25.0, range_adx: float = 20.0) -> Series:
    """Trend, Range or Neutral with a confidence; reads ``adx, atr14, ema100, bb_width``."""
    x = F.col
    s = s.add(_slope=div(R.diff(s, "ema100", 5), s.lag("ema100", 5)), _med=R.median(s, "atr14", 100, 20), _bw=R.quantile(s, "bb_width", 100, 0.40, 20))
    s = s.add(_cut=R.quantile(s, "_slope", 100, 0.60, 20))
    is_trend = F.coalesce((x("adx") > trend_adx) & (x("atr14") > x("_med")) & (F.abs(x("_slope")) > F.abs(x("_cut"))), F.lit(False))
    is_range = F.coalesce((x("adx") < range_adx) & (x("bb_width") < x("_bw")) & (x("atr14") < x("_med")), F.lit(False))
    return s.add(regime=F.when(is_trend, "Trend").when(is_range, "Range").otherwise("Neutral"),
                 regime_confidence=F.when(is_trend, clip((x("adx") - trend_adx) / trend_adx, 0, 1)).when(is_range, clip((range_adx - x("adx")) / range_adx, 0, 1)).otherwise(0.3))


NAMES = {"trend": "Trend", "range": "Range", "neutral": "Neutral"}


def regime_stats(df: DataFrame, *keys: str) -> DataFrame:
    n = F.count(F.lit(1))
    cnt = {k: F.count_if(F.col("regime") == v) for k, v in NAMES.items()}
    return df.groupBy(*(keys or ("symbol", "timeframe"))).agg(
        n.alias("total_bars"), *(c.alias(f"{k}_bars") for k, c in cnt.items()), *((c * 100.0 / n).alias(f"{k}_pct") for k, c in cnt.items()),
        F.avg("regime_confidence").alias("avg_confidence"))


def by_asset_class(stats: DataFrame, metals: list[str]) -> DataFrame:
    """Mean regime mix of metals, currencies and all series; one pass with each series counted in two classes."""
    cls = F.explode(F.array(F.when(F.col("symbol").isin(metals), "metals").otherwise("fx"), F.lit("all")))
    return stats.withColumn("asset_class", cls).groupBy("asset_class").agg(
        F.count(F.lit(1)).alias("count"), *(F.avg(f"{k}_pct").alias(f"avg_{k}") for k in NAMES))


def recommendations(stats: DataFrame) -> DataFrame:
    """Advice per series from its regime mix."""
    c = F.col
    return stats.withColumn("recommendations", F.array_compact(F.array(
        F.when(c("neutral_pct") > 50, "use mean reversion"), F.when(c("trend_pct") < 25, "wider targets, tighter stops"),
        F.when(c("range_pct") > 20, "good for mean reversion"), F.when(c("trend_pct") > 30, "good for momentum"))))
