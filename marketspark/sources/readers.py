"""Readers for bar tables, tick and bar files, bar JSON and trade ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketspark.schema import KEYS, OHLCV, ORDER, require_columns

QUOTES = "ticker string, sip_timestamp long, bid_price double, ask_price double, price double, size double"
MINUTES = "ticker string, volume double, open double, close double, high double, low double, window_start long, transactions long"
BAR_JSON = "array<struct<t: bigint, o: double, h: double, l: double, c: double, v: double, n: bigint>>"
TRADES = ("entry_time timestamp, exit_time timestamp, direction string, entry_price double, exit_price double, sl_price double, tp_price double, position_size double,"
          " gross_pnl double, commission double, net_pnl double, r_multiple double, exit_reason string, confidence double, bars_held int")
SIGNALS = "symbol string, timeframe string, created_at timestamp, direction string, confidence double, status string, return_pct double, pnl double"


def _ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, timeframe: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of a partitioned store; symbol and timeframe prune folders, the closed time range reaches the scan."""
    df = require_columns(spark.read.parquet(path), *KEYS, ORDER, *OHLCV, who="read_bars")
    if symbols:
        df = df.where(F.col("symbol").isin(*symbols))
    if timeframe:
        df = df.where(F.col("timeframe") == timeframe)
    if start:
        df = df.where(F.col(ORDER) >= F.lit(start).cast("timestamp_ntz"))
    if end:
        df = df.where(F.col(ORDER) <= F.lit(end).cast("timestamp_ntz"))
    return df


def read_quotes(spark: SparkSession, path: str, tickers: list[str] | None = None) -> DataFrame:
    """Tick files: nanosecond stamps to time, mid of bid and ask (else the trade price), weekdays only."""
    df = spark.read.schema(QUOTES).option("header", True).csv(path)
    if tickers:
        df = df.where(F.col("ticker").isin(*tickers))
    ts = F.expr("timestamp_micros(sip_timestamp div 1000)")
    df = df.select(F.col("ticker").alias("symbol"), _ntz(ts).alias("ts"), F.col("bid_price").alias("bid"), F.col("ask_price").alias("ask"),
                   F.coalesce((F.col("bid_price") + F.col("ask_price")) / 2, F.col("price")).alias("price"), "size")
    return df.where(F.weekday("ts") < 5)


def read_minute_bars(spark: SparkSession, path: str) -> DataFrame:
    """Minute aggregate files with a millisecond start."""
    df = spark.read.schema(MINUTES).option("header", True).csv(path)
    return df.select(F.col("ticker").alias("symbol"), F.lit("1T").alias("timeframe"), _ntz(F.timestamp_millis("window_start")).alias(ORDER), *OHLCV)


def parse_bar_json(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows of a JSON array of bars with short names, one per bar; other columns are kept."""
    rest = [c for c in df.columns if c != payload]
    b = df.select(*rest, F.inline(F.from_json(payload, BAR_JSON)))
    return b.select(*rest, _ntz(F.timestamp_millis("t")).alias(ORDER), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"),
                    F.col("c").alias("close"), F.col("v").alias("volume"))


def _typed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV read as text by header name and cast; a malformed value is null, an absent column is null."""
    raw = spark.read.option("header", True).csv(path)
    fields = T._parse_datatype_string(schema).fields
    return raw.select(*((F.col(f.name).try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields))


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, TRADES)


def read_signals_csv(spark: SparkSession, path: str) -> DataFrame:
    return _typed(spark, path, SIGNALS)


def tail_bars(bars: DataFrame, n: int, keys=KEYS, order: str = ORDER) -> DataFrame:
    """Last ``n`` bars per series. Spark keeps only ``n`` rows per key and task before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))
    return bars.withColumn("_rn", rn).where(F.col("_rn") <= n).drop("_rn")
