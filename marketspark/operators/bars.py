"""Bars from ticks and from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.schema import require_columns, timeframe_seconds


def bar_start(ts: str, tf: str) -> Column:
    """Start of the left-closed bucket that holds ``ts``."""
    return F.window(F.col(ts), f"{timeframe_seconds(tf)} seconds").start


def _ohlc(order: Column) -> list[Column]:
    return [F.min_by("_p", order).alias("open"), F.max("_p").alias("high"), F.min("_p").alias("low"),
            F.max_by("_p", order).alias("close")]


def ticks_to_bars(ticks: DataFrame, tf: str, source: str = "mid", volume: str = "count") -> DataFrame:
    """OHLCV bars; empty buckets do not appear.

    ``source='mid'`` prices a tick at the middle of bid and ask, else its trade price;
    ``source='trade'`` takes price, then bid, then ask. ``volume`` is ``count`` or ``size``.
    Partial aggregation folds each task's ticks before the shuffle, so a hot symbol is harmless.
    """
    require_columns(ticks, "symbol", "ts", who="ticks_to_bars")
    have = set(ticks.columns)
    parts = {c: F.col(c) if c in have else F.lit(None).cast("double") for c in ("bid", "ask", "price")}
    price = (F.coalesce((parts["bid"] + parts["ask"]) / 2, parts["price"]) if source == "mid"
             else F.coalesce(parts["price"], parts["bid"], parts["ask"]))
    order = F.struct("ts", *(c for c in ("id",) if c in have), "_p")
    vol = F.count(F.lit(1)).cast("double") if volume == "count" else F.sum("size")
    return (ticks.withColumn("_p", price).where(F.col("_p").isNotNull())
            .groupBy("symbol", F.lit(tf).alias("timeframe"), bar_start("ts", tf).alias("bar_ts"))
            .agg(*_ohlc(order), vol.alias("volume")))


def resample_bars(bars: DataFrame, tf: str) -> DataFrame:
    """Coarser bars from finer ones: first, max, min, last, sum."""
    return (bars.groupBy("symbol", F.lit(tf).alias("timeframe"), bar_start("bar_ts", tf).alias("_start"))
            .agg(F.min_by("open", "bar_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                 F.max_by("close", "bar_ts").alias("close"), F.sum("volume").alias("volume"))
            .withColumnRenamed("_start", "bar_ts"))


def market_open(ts: Column) -> Column:
    """Whether the currency market trades: Sunday 22:00 to Friday 22:00 UTC."""
    day, hour = F.weekday(ts), F.hour(ts)
    return ~((day == 5) | ((day == 4) & (hour >= 22)) | ((day == 6) & (hour < 22)))
