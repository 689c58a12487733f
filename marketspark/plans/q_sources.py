"""Sources, sinks and table maintenance over derived files."""

from pyspark.sql import functions as F

from marketspark.functions import rolling as R
from marketspark.operators.series import blocked
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.q_bars import BAR_COLS
from marketspark.plans.registry import query
from marketspark.session import scratch_path
from marketspark.sources import readers as RD
from marketspark.sources import sinks as SK

B = I.SQL_BARS


def ntz(s):
    return F.lit(s).cast("timestamp_ntz")


@query("src_1_read_bars", f"WITH {B} SELECT {BAR_COLS} FROM bars WHERE symbol IN ('S1', 'S3') AND bar_ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'")
def src_1(spark, sf):
    p = scratch_path(spark, "bars")
    SK.write_feature_store(I.bars(spark, sf), p)
    return RD.read_bars(spark, p, ["S1", "S3"], "1H", "2024-01-05 00:00:00", "2024-01-20 12:00:00").select(*BAR_COLS.split(", "))


@query("src_2_read_quotes", f"WITH {I.SQL_TICKS} SELECT symbol, ts, {q.r6('price')} AS price, size FROM ticks WHERE symbol <> 'S0' AND dayofweek(ts) BETWEEN 1 AND 5")
def src_2(spark, sf):
    p = scratch_path(spark, "quotes")
    t = I.ticks(spark, sf)
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    t.select(F.col("symbol").alias("ticker"), (us * 1000).alias("sip_timestamp"), (F.col("price") - 0.25).alias("bid_price"), (F.col("price") + 0.25).alias("ask_price"), "price", "size",
             F.col("ts").cast("date").alias("day")).repartition("day").write.partitionBy("day").option("header", True).option("compression", "gzip").csv(p)
    return RD.read_quotes(spark, f"{p}/day=*", ["S1", "S2", "S3"]).select("symbol", "ts", F.round("price", 6).alias("price"), "size")


@query("src_3_read_minute_bars", f"""WITH {I.SQL_TICKS} SELECT symbol, '1T' AS timeframe, date_trunc('minute', ts) AS bar_ts, arg_min(price, ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ts) AS close,
 CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY symbol, date_trunc('minute', ts)""")
def src_3(spark, sf):
    p = scratch_path(spark, "minutes")
    m = I.bars(spark, sf, "1T")
    m.select(F.col("symbol").alias("ticker"), "volume", "open", "close", "high", "low", (F.unix_micros(F.col("bar_ts").cast("timestamp")) / 1000).cast("long").alias("window_start"),
             F.col("volume").cast("long").alias("transactions")).write.option("header", True).option("compression", "gzip").csv(p)
    return RD.read_minute_bars(spark, p)


@query("src_4_parse_bar_json", f"WITH {B} SELECT symbol, bar_ts, open, high, low, close, volume FROM bars")
def src_4(spark, sf):
    b = I.bars(spark, sf)
    item = F.struct((F.unix_micros(F.col("bar_ts").cast("timestamp")) / 1000).cast("long").alias("t"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c"),
                    F.col("volume").alias("v"), F.col("volume").cast("long").alias("n"))
    # a day of hourly bars per payload, as a bar service returns it
    days = b.groupBy("symbol", F.col("bar_ts").cast("date").alias("day")).agg(F.to_json(F.collect_list(item)).alias("payload"))
    return RD.parse_bar_json(days).select("symbol", "bar_ts", "open", "high", "low", "close", "volume")


@query("src_5_read_trades_csv", f"WITH {I.SQL_TRADES} SELECT CAST(exit_time AS TIMESTAMP) AS exit_time, direction, pnl AS net_pnl, exit_reason, confidence, bars_held FROM trades")
def src_5(spark, sf):
    p = scratch_path(spark, "trades")
    I.trades(spark, sf).select("exit_time", "direction", F.col("pnl").alias("net_pnl"), "exit_reason", "confidence", "bars_held").write.option("header", True).csv(p)
    return RD.read_trades_csv(spark, p).select(F.col("exit_time").cast("timestamp_ntz").alias("exit_time"), "direction", "net_pnl", "exit_reason", "confidence", "bars_held")


@query("src_5_read_signals_csv", f"""WITH {I.SQL_TRADES} SELECT symbol, timeframe, CAST(exit_time AS TIMESTAMP) AS created_at, direction, confidence, exit_reason AS status,
 {q.r6('return_pct')} AS return_pct, pnl FROM trades""")
def src_5_signals(spark, sf):
    p = scratch_path(spark, "signals")
    t = I.trades(spark, sf).select("symbol", "timeframe", F.col("exit_time").alias("created_at"), "direction", "confidence", F.col("exit_reason").alias("status"), "return_pct", "pnl")
    t.write.option("header", True).csv(p)
    return RD.read_signals_csv(spark, p).withColumns({"created_at": F.col("created_at").cast("timestamp_ntz"), "return_pct": F.round("return_pct", 6)})


@query("src_6_tail_bars", f"WITH {B} SELECT {BAR_COLS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) <= 200")
def src_6(spark, sf):
    return RD.tail_bars(I.bars(spark, sf), 200)


@query("snk_1_write_feature_store", f"WITH {B} SELECT symbol, timeframe, count(*) AS rows, {q.r6('sum(close)', 4)} AS close_sum FROM bars GROUP BY symbol, timeframe")
def snk_1(spark, sf):
    p = scratch_path(spark, "store")
    SK.write_feature_store(I.bars(spark, sf), p)
    return spark.read.parquet(p).groupBy("symbol", "timeframe").agg(F.count("*").alias("rows"), F.round(F.sum("close"), 4).alias("close_sum"))


OLD, NEW = "bar_ts < TIMESTAMP '2024-01-20'", "bar_ts >= TIMESTAMP '2024-01-18'"


def old_new(spark, sf):
    b = I.bars(spark, sf)
    return b.where(F.col("bar_ts") < ntz("2024-01-20")), b.where(F.col("bar_ts") >= ntz("2024-01-18")).withColumn("close", F.col("close") + 1)


@query("snk_2_append_dedupe", f"WITH {B} SELECT {BAR_COLS.replace('close', 'close + 1 AS close')} FROM bars WHERE {NEW} UNION ALL SELECT {BAR_COLS} FROM bars WHERE NOT ({NEW})")
def snk_2(spark, sf):
    return SK.append_dedupe(*old_new(spark, sf))


@query("snk_3_append_newer_only", f"""WITH {B}, l AS (SELECT symbol, max(bar_ts) AS m FROM bars WHERE {OLD} GROUP BY symbol) SELECT {BAR_COLS} FROM bars WHERE {OLD}
 UNION ALL SELECT {BAR_COLS.replace('close', 'close + 1 AS close')} FROM bars JOIN l USING (symbol) WHERE {NEW} AND bar_ts > m""")
def snk_3(spark, sf):
    return SK.append_newer_only(*old_new(spark, sf))


@query("snk_4_upsert", f"WITH {B} SELECT {BAR_COLS.replace('close', 'close + 1 AS close')} FROM bars WHERE {NEW} UNION ALL SELECT {BAR_COLS} FROM bars WHERE NOT ({NEW})")
def snk_4(spark, sf):
    return SK.upsert(*old_new(spark, sf), ["symbol", "timeframe", "bar_ts"])


@query("snk_9_append_rows", f"WITH {B} SELECT symbol, count(*) AS rows FROM (SELECT * FROM bars WHERE {OLD} UNION ALL SELECT * FROM bars WHERE {NEW}) GROUP BY symbol")
def snk_9(spark, sf):
    p = scratch_path(spark, "append")
    for part in old_new(spark, sf):
        SK.append_rows(part, p)
    return spark.read.parquet(p).groupBy("symbol").agg(F.count("*").alias("rows"))


@query("snk_5_expire_rows", f"WITH {B} SELECT {BAR_COLS} FROM bars WHERE bar_ts >= TIMESTAMP '2024-01-25' - INTERVAL 1 DAY")
def snk_5(spark, sf):
    return SK.expire_rows(I.bars(spark, sf), "bar_ts", ntz("2024-01-25"))


@query("snk_5_stamp_changes", f"""WITH {B} SELECT symbol, timeframe, bar_ts, CASE WHEN {NEW} AND volume > 3 THEN close + 1 ELSE close END AS close,
 CASE WHEN {NEW} AND (volume > 3 OR NOT ({OLD})) THEN TIMESTAMP '2024-02-01' ELSE TIMESTAMP '2024-01-20' END AS updated_at FROM bars""")
def snk_5s(spark, sf):
    b = I.bars(spark, sf).select("symbol", "timeframe", "bar_ts", "close", "volume")
    old = b.where(F.col("bar_ts") < ntz("2024-01-20")).drop("volume").withColumn("updated_at", ntz("2024-01-20"))
    new = b.where(F.col("bar_ts") >= ntz("2024-01-18")).withColumn("close", F.when(F.col("volume") > 3, F.col("close") + 1).otherwise(F.col("close"))).drop("volume")
    return SK.stamp_changes(old, new, ["symbol", "timeframe", "bar_ts"], ntz("2024-02-01"))


@query("snk_6_latest_features", f"WITH {B} SELECT {BAR_COLS} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1")
def snk_6(spark, sf):
    return SK.latest_features(I.bars(spark, sf))


@query("snk_7_feature_payload", f"""WITH {B}, f AS (SELECT *, close / nullif({q.lag('close', 5)}, 0) - 1 AS roc FROM bars) SELECT symbol, bar_ts, CASE WHEN roc IS NULL THEN 2 ELSE 3 END AS feature_count, {q.r6('close')} AS close_back, {q.r6('roc')} AS roc_back FROM f""")
def snk_7(spark, sf):


    s = blocked(I.bars(spark, sf), back=5)
    p = SK.feature_payload(s.add(roc=R.pct_change(s, "close", 5)).rows(), ["close", "volume", "roc"])
    back = F.from_json("payload", "close double, volume double, roc double")
    return p.select("symbol", "bar_ts", "feature_count", F.round(F.col("features")["close"], 6).alias("close_back"), F.round(back["roc"], 6).alias("roc_back"))


@query("snk_8_freshness", f"WITH {B} SELECT symbol, timeframe, count(*) AS rows, max(bar_ts) AS last_ts, CAST(date_diff('day', max(bar_ts), TIMESTAMP '2024-02-01') AS INTEGER) AS days_behind, date_diff('day', max(bar_ts), TIMESTAMP '2024-02-01') <= 1 AS up_to_date FROM bars GROUP BY symbol, timeframe")
def snk_8(spark, sf):
    return SK.freshness(I.bars(spark, sf), ntz("2024-02-01"))
