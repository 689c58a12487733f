"""The given tables in the roles the operators read: ticks, bars, trades, predictions and so on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.operators.bars import resample_bars, ticks_to_bars
from marketspark.session import materialize


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"),
                    F.col("ts").cast("timestamp_ntz").alias("ts"), (F.col("value") + 100).alias("price"),
                    F.get_json_object("props", "$.k").cast("double").alias("size"), F.col("event_id").alias("id"))


def bars(spark: SparkSession, sf: str, tf: str = "1H") -> DataFrame:
    """Bars, computed once and kept: block positions and windows both read them, the ticks are read once."""
    return materialize(_bars(spark, sf, tf))


def _bars(spark: SparkSession, sf: str, tf: str) -> DataFrame:
    return ticks_to_bars(ticks(spark, sf).select("symbol", "ts", "price", "id"), tf)


def bars_from_hourly(spark: SparkSession, sf: str, tf: str) -> DataFrame:
    return resample_bars(bars(spark, sf), tf)


def daily_history(spark: SparkSession, sf: str) -> DataFrame:
    """Long daily history: one series per eighth of the parts, priced per unit shipped."""
    li = table(spark, sf, "lineitem")
    t = li.select(F.concat(F.lit("P"), (F.col("l_partkey") % 8).cast("string")).alias("symbol"),
                  F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
                  (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("size"),
                  (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("id"))
    return ticks_to_bars(t, "1D", source="trade", volume="size")


def trades(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    tf = F.element_at(F.split("o_orderpriority", "-"), 1)
    k = F.col("o_orderkey")
    return o.select(
        k.alias("trade_id"), F.concat(F.lit("S"), (F.col("o_custkey") % 4).cast("string")).alias("symbol"),
        F.when(tf == "1", "5T").when(tf == "2", "15T").when(tf == "3", "30T").when(tf == "4", "1H").otherwise("4H")
        .alias("timeframe"),
        F.when(k % 2 == 0, "long").otherwise("short").alias("direction"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("exit_time"),
        ((F.col("o_totalprice") - 200000) / 100).alias("pnl"), ((F.col("o_totalprice") - 200000) / F.col("o_totalprice")).alias("return_pct"),
        F.when(F.col("o_orderstatus") == "F", "tp").when(F.col("o_orderstatus") == "O", "sl").otherwise("timeout")
        .alias("exit_reason"),
        ((k % 70) / 100 + 0.3).alias("confidence"), (k % 48 + 1).cast("int").alias("bars_held"))


def predictions(bars_: DataFrame) -> DataFrame:
    """One row of class probabilities per bar and model, as three positive scores made to sum to 1."""
    h = F.hour("bar_ts")
    out = None
    scores: list[tuple[str, Column, Column, Column]] = [
        ("5T", 1.0 + h % 5, F.col("volume") % 7 + 1, F.abs(F.col("close") - F.col("open")) + 0.5),
        ("15T", 2.0 + h % 3, F.abs(F.col("close") - F.col("open")) + 1, F.col("volume") % 5 + 0.5),
        ("30T", 1.5 + h % 7, F.col("volume") % 3 + 2, F.col("volume") % 4 + 1.25),
    ]
    rows = F.array(*(F.struct(F.lit(m).alias("model"), a.cast("double").alias("a"), b.cast("double").alias("b"),
                              c.cast("double").alias("c")) for m, a, b, c in scores))
    out = bars_.select("symbol", "timeframe", "bar_ts", "close", F.inline(rows))
    tot = F.col("a") + F.col("b") + F.col("c")
    return out.select("symbol", "timeframe", "bar_ts", "close", "model", (F.col("a") / tot).alias("p_flat"),
                      (F.col("b") / tot).alias("p_long"), (F.col("c") / tot).alias("p_short"))


# ---- the same roles in SQL --------------------------------------------------------------
SQL_TICKS = """ticks AS (SELECT 'S' || (user_id % 4) AS symbol, ts, value + 100 AS price,
 CAST(json_extract_string(props, '$.k') AS DOUBLE) AS size, event_id AS id FROM events)"""
SQL_BARS = SQL_TICKS + """,
bars AS (SELECT symbol, '1H' AS timeframe, date_trunc('hour', ts) AS bar_ts, arg_min(price, ts) AS open,
 max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
 FROM ticks GROUP BY symbol, date_trunc('hour', ts))"""


def sql_resample(name: str, hours: int) -> str:
    return f"""{name} AS (SELECT symbol, '{'1D' if hours == 24 else f'{hours}H'}' AS timeframe,
 time_bucket(INTERVAL '{hours} hours', bar_ts, TIMESTAMP '1970-01-01') AS bar_ts, arg_min(open, b.bar_ts) AS open,
 max(high) AS high, min(low) AS low, arg_max(close, b.bar_ts) AS close, sum(volume) AS volume
 FROM bars b GROUP BY symbol, time_bucket(INTERVAL '{hours} hours', b.bar_ts, TIMESTAMP '1970-01-01'))"""


SQL_TRADES = """trades AS (SELECT o_orderkey AS trade_id, 'S' || (o_custkey % 4) AS symbol,
 CASE left(o_orderpriority, 1) WHEN '1' THEN '5T' WHEN '2' THEN '15T' WHEN '3' THEN '30T' WHEN '4' THEN '1H'
 ELSE '4H' END AS timeframe, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS direction,
 o_orderdate AS exit_time, (o_totalprice - 200000) / 100 AS pnl, (o_totalprice - 200000) / o_totalprice AS return_pct,
 CASE o_orderstatus WHEN 'F' THEN 'tp' WHEN 'O' THEN 'sl' ELSE 'timeout' END AS exit_reason,
 CAST(o_orderkey % 70 AS DOUBLE) / 100 + 0.3 AS confidence, CAST(o_orderkey % 48 + 1 AS INTEGER) AS bars_held
 FROM orders)"""
SQL_PREDICTIONS = """scored AS (
 SELECT *, '5T' AS model, 1.0 + hour(bar_ts) % 5 AS a, volume % 7 + 1 AS b, abs(close - open) + 0.5 AS c FROM bars
 UNION ALL SELECT *, '15T', 2.0 + hour(bar_ts) % 3, abs(close - open) + 1, volume % 5 + 0.5 FROM bars
 UNION ALL SELECT *, '30T', 1.5 + hour(bar_ts) % 7, volume % 3 + 2, volume % 4 + 1.25 FROM bars),
preds AS (SELECT symbol, timeframe, bar_ts, close, model, CAST(a AS DOUBLE) / (a + b + c) AS p_flat,
 CAST(b AS DOUBLE) / (a + b + c) AS p_long, CAST(c AS DOUBLE) / (a + b + c) AS p_short FROM scored)"""
SQL_DAILY = """daily AS (SELECT 'P' || (l_partkey % 8) AS symbol, '1D' AS timeframe,
 date_trunc('day', l_shipdate)::TIMESTAMP AS bar_ts,
 arg_min(l_extendedprice / l_quantity, row(l_orderkey * 16 + l_linenumber, l_extendedprice / l_quantity)) AS open,
 max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
 arg_max(l_extendedprice / l_quantity, row(l_orderkey * 16 + l_linenumber, l_extendedprice / l_quantity)) AS close, sum(l_quantity) AS volume
 FROM lineitem GROUP BY 1, 3)"""
