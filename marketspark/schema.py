"""Core column names, schemas and small checks shared by all operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KEYS = ("symbol", "timeframe")
ORDER = "bar_ts"
OHLC = ("open", "high", "low", "close")
OHLCV = OHLC + ("volume",)

BAR_SCHEMA = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("timeframe", T.StringType()),
     T.StructField("bar_ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in OHLCV]
)

TICK_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("bid", T.DoubleType()),
    T.StructField("ask", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("size", T.DoubleType()),
    T.StructField("id", T.LongType()),
])

#: seconds per timeframe unit: minutes, hours, days
_UNIT_SECONDS = {"T": 60, "H": 3600, "D": 86400}


def timeframe_seconds(tf: str) -> int:
    """``15T`` -> 900, ``4H`` -> 14400, ``1D`` -> 86400."""
    unit = tf[-1].upper()
    if unit not in _UNIT_SECONDS or not tf[:-1].isdigit():
        raise ValueError(f"unknown timeframe {tf!r}")
    return int(tf[:-1]) * _UNIT_SECONDS[unit]


def require_columns(df: DataFrame, *cols: str, who: str = "operator") -> DataFrame:
    """Raise when ``df`` lacks a column the operator reads."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{who}: missing columns {missing}")
    return df
