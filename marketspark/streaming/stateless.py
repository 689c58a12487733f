"""Streaming bars, health windows, and live features and upserts per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.series import Series, blocked
from marketspark.schema import KEYS, ORDER, timeframe_seconds


#: the state store that keyed state with timers and lists needs
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_bars(ticks: DataFrame, tf: str, delay: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Bars of a tick stream, each sent once its bucket can no longer change.

    Ticks later than ``delay`` are dropped by the watermark; Spark counts them in the query progress
    (``numRowsDroppedByWatermark``).
    """
    t = ticks.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    price = F.col("price")
    order = F.struct(ts, *(c for c in ("id",) if c in ticks.columns))
    return (t.groupBy("symbol", F.window(ts, f"{timeframe_seconds(tf)} seconds"))
            .agg(F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume"))
            .select("symbol", F.lit(tf).alias("timeframe"), F.col("window.start").cast("timestamp_ntz").alias(ORDER), "open", "high", "low", "close", "volume"))


def signal_health_stream(signals: DataFrame, ts: str = "ts", hours: int = 6, slide: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Count, mean confidence and mean edge over a sliding window per series."""
    s = signals.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return (s.groupBy(*KEYS, F.window(ts, f"{hours} hours", slide))
            .agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence"), F.avg("edge").alias("avg_edge"), F.max(ts).alias("last_ts"))
            .select(*KEYS, F.col("window.start").alias("start"), F.col("window.end").alias("end"), "rows", "avg_confidence", "avg_edge", "last_ts"))


def live_features(recent: DataFrame, features: Callable[[Series], Series], lookback: int) -> DataFrame:
    """Features of the fresh bars in ``recent`` (bars with their ``lookback`` rows before them), by the batch code."""
    out = features(blocked(recent, back=lookback)).rows()
    return out.where("fresh").drop("fresh")


def change_sink(path: str, rows: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function: ``rows(batch)`` into the batch's own folder, so that a replay overwrites what it wrote."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return run


def current(spark: SparkSession, path: str, keys: Sequence[str] = KEYS, ts: str = ORDER) -> DataFrame:
    """What upserts by ``keys`` into ``path`` (see :func:`change_sink`) have come to: the newest row, of equal ones the last written."""
    changes = spark.read.parquet(path)
    cols = [c for c in changes.columns if c != "batch"]
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(ts, "batch")).alias("_r")).select("_r.*")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append", foreach: Callable | None = None) -> None:
    """Run a streaming query over everything available and stop. State is kept in RocksDB, outside the heap."""
    w = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    w = w.foreachBatch(foreach) if foreach else w.outputMode(mode).format("parquet").option("path", path)
    conf, key = df.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(key)
    conf.set(key, ROCKS)
    try:
        w.start().awaitTermination()
    finally:
        conf.set(key, before)


