"""Streaming operators run over the given tables as streams, everything available at once."""

from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.plans import inputs as I
from marketspark.plans import q_trades as QT
from marketspark.plans import sqlkit as q
from marketspark.plans.q_bars import BAR_COLS
from marketspark.plans.registry import query
from marketspark.session import scratch_path
from marketspark.sources.sinks import latest_features
from marketspark.streaming import stateful as SF
from marketspark.streaming import stateless as SL

B = I.SQL_BARS


def events(spark, sf):
    """Ticks as a stream of the events table."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return e.select(F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") + 100).alias("price"),
                    F.col("event_id").alias("id"))


def as_stream(spark, df, name):
    """Write a derived table and read it back as a stream."""
    p = scratch_path(spark, name)
    df.write.parquet(p)
    return spark.readStream.schema(spark.read.parquet(p).schema).parquet(p)


def run(spark, df, name, mode="append"):
    out = scratch_path(spark, name)
    SL.run_available(df, out, scratch_path(spark, name + "-ckpt"), mode)
    return spark.read.schema(df.schema).parquet(out)


@query("st_1_stream_bars", f"WITH {B} SELECT {BAR_COLS} FROM bars WHERE bar_ts + INTERVAL 1 HOUR <= (SELECT date_trunc('milliseconds', max(ts)) FROM ticks) - INTERVAL 10 MINUTE")
def st_1(spark, sf):
    return run(spark, SL.stream_bars(events(spark, sf), "1H"), "bars").select(*BAR_COLS.split(", "))


@query("st_2_live_features", f"WITH {B} SELECT symbol, bar_ts, {q.r6('close')} AS close, {q.r6('e')} AS ema20 FROM (SELECT *, {q.ema('close', q.sp(20))} AS e FROM bars) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1")
def st_2(spark, sf):
    path = scratch_path(spark, "latest")
    recent = SF.with_recent(as_stream(spark, I.bars(spark, sf), "barstream"), 500)
    sink = SL.change_sink(path, lambda b: latest_features(SL.live_features(b, lambda s: ind.ema(s, 20), 500)))
    SL.run_available(recent, "", scratch_path(spark, "ckpt"), foreach=sink)
    return SL.current(spark, path).select("symbol", "bar_ts", F.round("close", 6).alias("close"), F.round("ema20", 6).alias("ema20"))


@query("st_3_latest_upsert", f"WITH {B} SELECT symbol, timeframe, bar_ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_ts DESC) = 1")
def st_3(spark, sf):
    path = scratch_path(spark, "upsert")
    sink = SL.change_sink(path, lambda b: latest_features(b.select("symbol", "timeframe", "bar_ts", "close")))
    SL.run_available(as_stream(spark, I.bars(spark, sf), "barstream"), "", scratch_path(spark, "ckpt"), foreach=sink)
    return SL.current(spark, path)


def signal_stream(spark, sf):
    """The models' directional signals as a stream; the model's timeframe is the series' timeframe."""
    s = QT.signals(spark, sf).where(F.col("signal") != "flat")
    return as_stream(spark, s.select("symbol", F.col("model").alias("timeframe"), F.col("bar_ts").cast("timestamp").alias("ts"), "signal", "confidence", "edge", F.hour("bar_ts").cast("long").alias("bar_index")), "signals")


SG = f"{QT.SIG}, sgn AS (SELECT symbol, model AS timeframe, bar_ts AS ts, signal, confidence, edge FROM sig WHERE signal <> 'flat')"


@query("st_4_suppress_duplicates", f"""WITH RECURSIVE {SG}, acc AS (SELECT symbol, timeframe, min(ts) AS ts FROM sgn GROUP BY symbol, timeframe
 UNION ALL SELECT a.symbol, a.timeframe, (SELECT min(s.ts) FROM sgn s WHERE s.symbol = a.symbol AND s.timeframe = a.timeframe AND s.ts >= a.ts + CASE a.timeframe WHEN '5T' THEN INTERVAL 210 MINUTE WHEN '15T' THEN INTERVAL 150 MINUTE ELSE INTERVAL 90 MINUTE END) FROM acc a WHERE a.ts IS NOT NULL)
SELECT symbol, timeframe, ts FROM acc WHERE ts IS NOT NULL""")
def st_4(spark, sf):
    out = run(spark, SF.suppress_duplicates(signal_stream(spark, sf), validity={"5T": 210, "15T": 150, "30T": 90}), "dedup")
    return out.select("symbol", "timeframe", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("st_5_cooldown", f"""WITH RECURSIVE {SG}, ix AS (SELECT *, CAST(epoch(ts) / 3600 AS BIGINT) AS i FROM sgn), acc AS (SELECT symbol, timeframe, min(i) AS i FROM ix GROUP BY symbol, timeframe
 UNION ALL SELECT a.symbol, a.timeframe, (SELECT min(s.i) FROM ix s WHERE s.symbol = a.symbol AND s.timeframe = a.timeframe AND s.i >= a.i + 5) FROM acc a WHERE a.i IS NOT NULL)
SELECT ix.symbol, ix.timeframe, ix.ts, acc.i IS NOT NULL AS accepted, CASE WHEN acc.i IS NULL THEN 'cooldown' ELSE '' END AS veto FROM ix LEFT JOIN acc ON ix.symbol = acc.symbol AND ix.timeframe = acc.timeframe AND ix.i = acc.i""")
def st_5(spark, sf):
    s = signal_stream(spark, sf).withColumn("bar_index", (F.unix_timestamp("ts") / 3600).cast("long"))
    return run(spark, SF.cooldown(s), "cooldown").select("symbol", "timeframe", F.col("ts").cast("timestamp_ntz").alias("ts"), "accepted", "veto")


@query("st_6_monitor_outcomes", f"""WITH {QT.ENTRY}, sg AS (SELECT *, CAST(epoch(bar_ts) / 3600 AS BIGINT) * 10 + CAST(substr(symbol, 2) AS BIGINT) AS signal_id, bar_ts + INTERVAL 24 HOUR AS expires_at FROM ent2),
t AS (SELECT sg.*, b.bar_ts AS pt, b.close AS price, CASE WHEN b.bar_ts > expires_at THEN 'expired' WHEN s * (b.close - tp_price) >= 0 THEN 'take_profit' WHEN s * (b.close - sl_price) <= 0 THEN 'stop_loss' END AS st FROM sg JOIN bars b ON b.symbol = sg.symbol AND b.bar_ts > sg.bar_ts),
f AS (SELECT * FROM t WHERE st IS NOT NULL QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY pt) = 1)
SELECT signal_id, symbol, direction, st AS status, {q.r6("CASE st WHEN 'take_profit' THEN s * (tp_price - entry_price) WHEN 'stop_loss' THEN s * (sl_price - entry_price) END")} AS pnl, CASE WHEN st = 'expired' THEN expires_at ELSE pt END AS exit_ts FROM f""")
def st_6(spark, sf):
    e = QT.entries(spark, sf).withColumns({"ts": F.col("bar_ts").cast("timestamp"), "expires_at": (F.col("bar_ts") + F.expr("INTERVAL 24 HOURS")).cast("timestamp")})
    e = e.withColumn("signal_id", (F.unix_timestamp("ts") / 3600).cast("long") * 10 + F.substring("symbol", 2, 5).cast("long"))
    sig = as_stream(spark, e.select("signal_id", "symbol", "ts", "direction", "entry_price", "tp_price", "sl_price", "expires_at"), "entries")
    px = as_stream(spark, I.bars(spark, sf).select("symbol", F.col("bar_ts").cast("timestamp").alias("ts"), F.col("close").alias("price")), "prices")
    out = run(spark, SF.monitor_outcomes(sig, px), "outcomes")
    return out.select("signal_id", "symbol", "direction", "status", F.round("pnl", 6).alias("pnl"), F.col("exit_ts").cast("timestamp_ntz").alias("exit_ts"))


W20 = "OVER (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("st_7_drift_monitor", f"""WITH {I.SQL_TRADES}, {QT.SQL_CURVE}, d AS (SELECT trade_id, drawdown_pct > 6 AS halted, CASE WHEN count(*) {W20} = 20 THEN coalesce(sum(greatest(pnl, 0)) {W20} / nullif(sum(greatest(-pnl, 0)) {W20}, 0), 0) END AS pf FROM eq)
SELECT trade_id, halted, {q.r6('pf')} AS rolling_pf, CASE WHEN pf IS NULL THEN 'insufficient_data' WHEN pf < 0.9 THEN 'halt' WHEN pf < 1.1 THEN 'warning' ELSE 'healthy' END AS status FROM d""")
def st_7(spark, sf):
    t = I.trades(spark, sf).select("symbol", "timeframe", "trade_id", F.col("exit_time").cast("timestamp").alias("ts"), "pnl")
    return run(spark, SF.drift_monitor(as_stream(spark, t, "trades")), "drift").select("trade_id", "halted", F.round("rolling_pf", 6).alias("rolling_pf"), "status")


@query("st_8_staleness_alerts", f"""WITH {SG}, g AS (SELECT *, lead(ts) OVER (PARTITION BY symbol, timeframe ORDER BY ts) AS nx, (SELECT max(ts) FROM sgn) AS wm FROM sgn)
SELECT symbol, timeframe, ts AS last_ts, CASE WHEN nx IS NULL THEN 'silent' ELSE 'gap' END AS kind FROM g WHERE nx - ts > INTERVAL 180 MINUTE OR (nx IS NULL AND ts + INTERVAL 180 MINUTE < wm)""")
def st_8(spark, sf):
    out = run(spark, SF.staleness_alerts(signal_stream(spark, sf), minutes=180), "stale")
    return out.select("symbol", "timeframe", F.col("last_ts").cast("timestamp_ntz").alias("last_ts"), "kind")


@query("st_9_signal_health_stream", f"""WITH {SG}, w AS (SELECT *, unnest(range(0, 36)) AS k FROM sgn), x AS (SELECT *, time_bucket(INTERVAL 10 MINUTE, ts, TIMESTAMP '1970-01-01') - to_minutes(10 * k) AS st FROM w)
SELECT symbol, timeframe, st AS start, count(*) AS rows, {q.r6('avg(confidence)')} AS avg_confidence, {q.r6('avg(edge)')} AS avg_edge FROM x WHERE st + INTERVAL 6 HOUR <= (SELECT max(ts) FROM sgn) - INTERVAL 10 MINUTE GROUP BY symbol, timeframe, st""")
def st_9(spark, sf):
    out = run(spark, SL.signal_health_stream(signal_stream(spark, sf)), "health")
    return out.select("symbol", "timeframe", F.col("start").cast("timestamp_ntz").alias("start"), "rows", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_edge", 6).alias("avg_edge"))
