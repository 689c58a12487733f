"""Bar construction."""

from pyspark.sql import functions as F

from marketspark.operators.bars import bar_start, market_open, resample_bars, ticks_to_bars
from marketspark.plans import inputs as I
from marketspark.plans.registry import query

BAR_COLS = "symbol, timeframe, bar_ts, open, high, low, close, volume"


@query("bar_1_ticks_to_bars", f"WITH {I.SQL_BARS} SELECT {BAR_COLS} FROM bars")
def bar_1(spark, sf):
    return ticks_to_bars(I.ticks(spark, sf).select("symbol", "ts", "price", "id"), "1H")


@query("bar_2_trade_bars", f"""WITH {I.SQL_TICKS} SELECT symbol, '15T' AS timeframe,
 time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS bar_ts, arg_min(price, ts) AS open,
 max(price) AS high, min(price) AS low, arg_max(price, ts) AS close, sum(size) AS volume FROM ticks
 GROUP BY symbol, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01')""")
def bar_2(spark, sf):
    return ticks_to_bars(I.ticks(spark, sf), "15T", source="trade", volume="size")


@query("bar_3_resample_bars", f"WITH {I.SQL_BARS}, {I.sql_resample('b4', 4)} SELECT {BAR_COLS} FROM b4")
def bar_3(spark, sf):
    return resample_bars(I.bars(spark, sf), "4H")


@query("bar_4_market_open", """SELECT date_trunc('hour', ts) AS hour_ts, count(*) AS ticks,
 NOT (dayofweek(date_trunc('hour', ts)) = 6 OR (dayofweek(date_trunc('hour', ts)) = 5 AND hour(ts) >= 22)
  OR (dayofweek(date_trunc('hour', ts)) = 0 AND hour(ts) < 22)) AS is_open
 FROM events GROUP BY date_trunc('hour', ts), hour(ts)""")
def bar_4(spark, sf):
    return (I.ticks(spark, sf).groupBy(bar_start("ts", "1H").alias("hour_ts")).agg(F.count("*").alias("ticks"))
            .withColumn("is_open", market_open(F.col("hour_ts"))))


@query("bar_1_daily_history", f"WITH {I.SQL_DAILY} SELECT {BAR_COLS} FROM daily")
def bar_1_daily(spark, sf):
    return I.daily_history(spark, sf)
