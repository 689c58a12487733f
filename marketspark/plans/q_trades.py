"""Joins, sizing, scoring, gates, trades and metrics."""

from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import sessions as S
from marketspark.operators import gates as G
from marketspark.operators import joins as J
from marketspark.operators import labels as L
from marketspark.operators import metrics as M
from marketspark.operators import scoring as SC
from marketspark.operators import sizing as SZ
from marketspark.operators import trades as TR
from marketspark.operators.bootstrap import start_sql
from marketspark.operators.scan import running
from marketspark.operators.series import blocked
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.q_labels import ahead, sql_triple
from marketspark.plans.q_windows import TR as SQL_TR
from marketspark.plans.registry import query
from marketspark.sources import dims

RENAME = {"S0": "XAUUSD", "S1": "XAGUSD", "S2": "EURUSD", "S3": "GBPUSD"}
B, T, P = I.SQL_BARS, I.SQL_TRADES, I.SQL_PREDICTIONS


def rnd(df, *keep, n=6, **doubles):
    """Keep some columns and round the named others."""
    return df.select(*keep, *(F.round(F.col(c).cast("double"), n).alias(c) for c in doubles.get("d", "").split()))


def values(name, cols, rows):
    lit = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    return f"{name}({cols}) AS (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ")"


COSTS = values("costs", "symbol, spread_pips, commission_pct, slippage_pct, min_distance_pips",
               [(n, *r[1:]) for n, o in RENAME.items() for r in dims.COSTS if r[0] == o])
TPSL = values("tpsl", "symbol, timeframe, tp_mult, sl_mult",
              [(n, tf, tp, 1.0) for n, o in RENAME.items() for tf, tp in zip(dims.TIMEFRAMES, dims.TAKE_PROFIT[o])])
PIPS = values("pips", "symbol, pip_value, spread_pip",
              [(n, dims.PIP[o], dims.SPREAD_PIP.get(o, 0.0001)) for n, o in RENAME.items() if n != "S3"])
DCAST = lambda c: f"CAST({c} AS DOUBLE)"


# ---- joins ------------------------------------------------------------------------------
def sql_asof(shift):
    return f"""WITH {B}, {I.sql_resample('b4', 4)},
h AS (SELECT symbol, bar_ts + INTERVAL '{shift} hours' AS vis, high, close, volume FROM b4)
SELECT b.symbol, b.bar_ts, b.close, h.high AS high_htf, h.close AS close_htf, h.volume AS htf_volume
FROM bars b ASOF LEFT JOIN h ON b.symbol = h.symbol AND b.bar_ts >= h.vis"""


def _asof(spark, sf, period):
    b = I.bars(spark, sf)
    h = I.bars_from_hourly(spark, sf, "4H").select("symbol", "bar_ts", "high", "close", F.col("volume").alias("htf_volume"))
    df = J.asof_join(b, h, period_seconds=period)
    return df.select("symbol", "bar_ts", "close", "high_htf", "close_htf", "htf_volume")


@query("jn_1_asof_join", sql_asof(0))
def jn_1(spark, sf):
    return _asof(spark, sf, None)


@query("jn_2_asof_join_closed", sql_asof(4))
def jn_2(spark, sf):
    return _asof(spark, sf, 4 * 3600)


CAL = """cal AS (SELECT ts AS event_time, 'C' || (user_id % 3) AS currency, CASE WHEN event_type = 'error' THEN 'high' ELSE 'low' END AS impact
 FROM events), cur(symbol, currency) AS (VALUES ('S0','C0'),('S1','C0'),('S1','C1'),('S2','C1'),('S2','C2'),('S3','C2'))"""


def calendar(spark, sf):
    return I.table(spark, sf, "events").select(
        F.col("ts").cast("timestamp_ntz").alias("event_time"), F.concat(F.lit("C"), (F.col("user_id") % 3).cast("string")).alias("currency"),
        F.when(F.col("event_type") == "error", "high").otherwise("low").alias("impact"))


def currencies(spark):
    return spark.createDataFrame([("S0", "C0"), ("S1", "C0"), ("S1", "C1"), ("S2", "C1"), ("S2", "C2"), ("S3", "C2")],
                                 "symbol string, currency string")


@query("jn_3_blackout_join", f"""WITH {B}, {CAL}, h AS (SELECT b.symbol, b.bar_ts, count(*) AS n,
 min(CASE WHEN epoch(event_time) // 1 >= epoch(bar_ts) THEN (floor(epoch(event_time)) - epoch(bar_ts)) / 60.0 END) AS t1,
 min(CASE WHEN floor(epoch(event_time)) < epoch(bar_ts) THEN (epoch(bar_ts) - floor(epoch(event_time))) / 60.0 END) AS t2
 FROM bars b JOIN cur USING (symbol) JOIN cal ON cal.currency = cur.currency AND impact = 'high'
 AND event_time BETWEEN bar_ts - INTERVAL 30 MINUTE AND bar_ts + INTERVAL 30 MINUTE GROUP BY b.symbol, b.bar_ts)
SELECT b.symbol, b.bar_ts, coalesce(n, 0) AS events_near, n IS NOT NULL AS in_blackout, {q.r6('t1')} AS minutes_to_event,
 {q.r6('t2')} AS minutes_after_event FROM bars b LEFT JOIN h ON b.symbol = h.symbol AND b.bar_ts = h.bar_ts""")
def jn_3(spark, sf):
    df = J.blackout_join(I.bars(spark, sf), calendar(spark, sf), currencies(spark))
    return rnd(df, "symbol", "bar_ts", "events_near", "in_blackout", d="minutes_to_event minutes_after_event")


@query("jn_4_rule_blackout", f"""WITH {B} SELECT symbol, bar_ts, hour(bar_ts) BETWEEN 13 AND 14 AND
 ((dayofweek(bar_ts) = 5 AND day(bar_ts) <= 7) OR day(bar_ts) BETWEEN 12 AND 18) AS in_blackout FROM bars""")
def jn_4(spark, sf):
    return I.bars(spark, sf).select("symbol", "bar_ts", J.rule_blackout(F.col("bar_ts")).alias("in_blackout"))


@query("jn_5_dimension_joins", f"""WITH {T}, {COSTS}, {TPSL}, {PIPS} SELECT trade_id, {DCAST('spread_pips')} AS spread_pips,
 {DCAST('commission_pct')} AS commission_pct, {DCAST('tp_mult')} AS tp_mult, {DCAST('sl_mult')} AS sl_mult,
 {DCAST('coalesce(pip_value, 0.0001)')} AS pip_value, {DCAST('coalesce(spread_pip, 0.0001)')} AS spread_pip
 FROM trades JOIN costs USING (symbol) JOIN tpsl USING (symbol, timeframe) LEFT JOIN pips USING (symbol)""")
def jn_5(spark, sf):
    known = {k: v for k, v in RENAME.items() if k != "S3"}
    t = J.with_tp_sl(J.with_costs(I.trades(spark, sf), dims.costs(spark, RENAME)), dims.tp_sl(spark, RENAME))
    return J.with_pip_value(t, dims.pips(spark, known)).select(
        "trade_id", "spread_pips", "commission_pct", "tp_mult", "sl_mult", "pip_value", "spread_pip")


@query("jn_6_dims_complete", f"""WITH {I.SQL_TICKS}, {I.SQL_DAILY}, a AS (SELECT DISTINCT symbol FROM ticks UNION SELECT 'P' || (p_partkey % 3) FROM part),
 b AS (SELECT DISTINCT symbol FROM daily)
 SELECT symbol, 'targets' AS missing_in FROM a WHERE symbol NOT IN (SELECT symbol FROM b)
 UNION ALL SELECT symbol, 'costs' FROM b WHERE symbol NOT IN (SELECT symbol FROM a)""")
def jn_6(spark, sf):
    parts = I.table(spark, sf, "part").select(F.concat(F.lit("P"), (F.col("p_partkey") % 3).cast("string")).alias("symbol"))
    return J.dims_complete(I.ticks(spark, sf).select("symbol").union(parts), I.daily_history(spark, sf).select("symbol"))


# ---- trade metrics ------------------------------------------------------------------------
WK = "PARTITION BY {k} ORDER BY {o}"


def sql_metrics(src, keys="symbol, timeframe", order="exit_time, trade_id", pnl="pnl", returns="return_pct"):
    w = f"PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING"
    on = ", ".join(k.strip() for k in keys.split(","))
    return f"""(WITH c AS (SELECT *, sum({pnl}) OVER ({w}) AS cum FROM {src}),
 d AS (SELECT *, max(cum) OVER ({w}) - cum AS dd FROM c),
 g AS (SELECT {on}, count(*) AS total_trades, count(*) FILTER ({pnl} > 0) AS win_count, count(*) FILTER ({pnl} < 0) AS loss_count,
  coalesce(sum({pnl}) FILTER ({pnl} > 0), 0) AS gp, coalesce(-sum({pnl}) FILTER ({pnl} < 0), 0) AS gl, avg({returns}) AS m,
  stddev_pop({returns}) AS sd, max(dd) / 1000 AS max_drawdown_pct, sum({pnl}) / 1000 AS total_return_pct,
  coalesce(avg({pnl}) FILTER ({pnl} > 0), 0) AS avg_win, coalesce(-avg({pnl}) FILTER ({pnl} < 0), 0) AS avg_loss FROM d GROUP BY {on})
 SELECT {on}, total_trades, win_count, loss_count, CASE WHEN gl > 0 THEN gp / gl ELSE gp END AS profit_factor,
  win_count * 100.0 / total_trades AS win_rate, coalesce(m / nullif(sd, 0), 0) AS sharpe_ratio, max_drawdown_pct, total_return_pct,
  win_count::DOUBLE / total_trades * avg_win - (1 - win_count::DOUBLE / total_trades) * avg_loss AS expectancy, avg_win, avg_loss FROM g)"""


MT1 = "profit_factor win_rate sharpe_ratio max_drawdown_pct total_return_pct expectancy avg_win avg_loss"
MT1_OUT = "total_trades, win_count, loss_count, " + ", ".join(f"{q.r6(c)} AS {c}" for c in MT1.split())


@query("mt_1_trade_metrics", f"WITH {T} SELECT symbol, timeframe, {MT1_OUT} FROM {sql_metrics('trades')}")
def mt_1(spark, sf):
    return rnd(M.trade_metrics(I.trades(spark, sf)), "symbol", "timeframe", "total_trades", "win_count", "loss_count", d=MT1)


SQL_CURVE = """curve AS (SELECT *, 100000 + sum(pnl) OVER w AS equity FROM trades WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)),
curve2 AS (SELECT *, greatest(100000, max(equity) OVER (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)) AS peak FROM curve),
eq AS (SELECT *, (peak - equity) / peak * 100 AS drawdown_pct FROM curve2)"""
SQL_BT = f"""bt AS (SELECT symbol, timeframe, count(*) AS total_trades, count(*) FILTER (pnl > 0) * 100.0 / count(*) AS win_rate,
 coalesce(coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(coalesce(abs(sum(pnl) FILTER (pnl <= 0)), 1), 0), 0) AS profit_factor,
 sum(pnl) / 1000 AS total_return_pct, max(drawdown_pct) AS max_drawdown_pct,
 coalesce(avg(pnl / (equity - pnl)) / nullif(stddev_samp(pnl / (equity - pnl)), 0) * sqrt(252), 0) AS sharpe_ratio,
 avg(bars_held) AS avg_bars_held, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss,
 max(pnl) FILTER (pnl > 0) AS largest_win, min(pnl) FILTER (pnl <= 0) AS largest_loss, avg(pnl) / 1000 AS avg_r,
 count(*) FILTER (exit_reason = 'tp') * 100.0 / count(*) AS tp_hit_rate, count(*) FILTER (exit_reason = 'sl') * 100.0 / count(*) AS sl_hit_rate,
 count(*) FILTER (exit_reason = 'timeout') * 100.0 / count(*) AS timeout_rate FROM eq GROUP BY symbol, timeframe)"""
MT2 = ("win_rate profit_factor total_return_pct max_drawdown_pct sharpe_ratio avg_bars_held avg_win avg_loss largest_win largest_loss "
       "avg_r tp_hit_rate sl_hit_rate timeout_rate")


@query("mt_2_backtest_metrics", f"WITH {T}, {SQL_CURVE}, {SQL_BT} SELECT symbol, timeframe, total_trades, " + ", ".join(
    f"{q.r6(c)} AS {c}" for c in MT2.split()) + " FROM bt")
def mt_2(spark, sf):
    return rnd(M.backtest_metrics(I.trades(spark, sf)), "symbol", "timeframe", "total_trades", d=MT2)


@query("mt_3_equity_drawdown", f"WITH {T}, {SQL_CURVE} SELECT trade_id, {q.r6('equity', 4)} AS equity, {q.r6('peak', 4)} AS peak, {q.r6('drawdown_pct')} AS drawdown_pct FROM eq")
def mt_3(spark, sf):
    df = M.equity_curve(I.trades(spark, sf))
    return df.select("trade_id", F.round("equity", 4).alias("equity"), F.round("peak", 4).alias("peak"), F.round("drawdown_pct", 6).alias("drawdown_pct"))


@query("mt_4_risk_halt", f"""WITH {T}, {SQL_CURVE} SELECT trade_id, drawdown_pct > 6 AS halt_drawdown, (equity - 100000) / 1000 < -2 AS halt_loss,
 drawdown_pct > 6 OR (equity - 100000) / 1000 < -2 AS halted FROM eq""")
def mt_4(spark, sf):
    return M.risk_halt(M.equity_curve(I.trades(spark, sf))).select("trade_id", "halt_drawdown", "halt_loss", "halted")


@query("win_14_running", f"""WITH {T} SELECT trade_id, {q.r6('sum(pnl) OVER w', 4)} AS cum_pnl, {q.r6('max(pnl) OVER w', 4)} AS best_so_far,
 {q.r6('product(1 + pnl / 1000000) OVER w')} AS growth, count(*) FILTER (pnl > 0) OVER w AS wins_so_far
 FROM trades WINDOW w AS (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)""")
def win_14(spark, sf):
    df = running(I.trades(spark, sf), ["symbol", "timeframe"], ["exit_time", "trade_id"], sums={"cum_pnl": F.col("pnl")},
                 maxes={"best_so_far": F.col("pnl")}, products={"growth": 1 + F.col("pnl") / 1000000}, counts={"wins_so_far": F.col("pnl") > 0})
    return df.select("trade_id", F.round("cum_pnl", 4).alias("cum_pnl"), F.round("best_so_far", 4).alias("best_so_far"),
                     F.round("growth", 6).alias("growth"), "wins_so_far")


STREAK = """streaks AS (SELECT symbol, timeframe, coalesce(max(n) FILTER (l), 0) AS max_consecutive FROM (SELECT symbol, timeframe, l, count(*) AS n FROM
 (SELECT symbol, timeframe, pnl < 0 AS l, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id)
  - row_number() OVER (PARTITION BY symbol, timeframe, pnl < 0 ORDER BY exit_time, trade_id) AS isl FROM trades)
 GROUP BY symbol, timeframe, l, isl) GROUP BY symbol, timeframe)"""


@query("win_18_max_consecutive", f"WITH {T}, {STREAK} SELECT * FROM streaks")
def win_18(spark, sf):
    return M.max_consecutive(I.trades(spark, sf), ["symbol", "timeframe"], ["exit_time", "trade_id"], F.col("pnl") < 0)


MONTHS = """months AS (SELECT symbol, timeframe, count(*) AS months, count(*) FILTER (p > 0) * 100.0 / count(*) AS month_pct, avg(n) AS trades_per_month
 FROM (SELECT symbol, timeframe, date_trunc('month', exit_time) AS mo, sum(pnl) AS p, count(*) AS n FROM trades GROUP BY ALL) GROUP BY symbol, timeframe)"""


@query("mt_5_monthly_consistency", f"WITH {T}, {MONTHS} SELECT symbol, timeframe, months, {q.r6('month_pct')} AS month_pct, {q.r6('trades_per_month')} AS trades_per_month FROM months")
def mt_5(spark, sf):
    return rnd(M.monthly_consistency(I.trades(spark, sf)), "symbol", "timeframe", "months", d="month_pct trades_per_month")


#: index returns stand-in for the years of the given orders
YEARS = {1995: 0.289, 1996: 0.164, 1997: 0.269, 1998: -0.182, 1999: 0.243}
SQL_YEARLY = f"""{values('idx', 'year, index_return', list(YEARS.items()))},
ty AS (SELECT *, year(exit_time) AS year FROM trades),
yearly AS (SELECT m.*, coalesce(index_return, 0.15) * 100 AS index_return_pct, total_return_pct > coalesce(index_return, 0.15) * 100 AS beat_index,
 total_return_pct - coalesce(index_return, 0.15) * 100 AS outperformance FROM {sql_metrics('ty', 'symbol, year')} m LEFT JOIN idx USING (year))"""


def yearly(spark, sf):
    return M.yearly_report(I.trades(spark, sf), dims.index_returns(spark, YEARS))


@query("mt_6_yearly_report", f"""WITH {T}, {SQL_YEARLY} SELECT symbol, year::INTEGER AS year, total_trades, beat_index, {q.r6('total_return_pct')} AS total_return_pct,
 {q.r6('max_drawdown_pct')} AS max_drawdown_pct, {q.r6('win_rate')} AS win_rate, {q.r6('profit_factor')} AS profit_factor,
 {q.r6('sharpe_ratio')} AS sharpe_ratio, {q.r6('outperformance')} AS outperformance FROM yearly""")
def mt_6(spark, sf):
    return rnd(yearly(spark, sf), "symbol", "year", "total_trades", "beat_index",
               d="total_return_pct max_drawdown_pct win_rate profit_factor sharpe_ratio outperformance")


@query("mt_6_viability", f"""WITH {T}, {SQL_YEARLY}, g AS (SELECT symbol, count(*) AS years, avg(total_return_pct) AS avg_return, min(total_return_pct) AS min_return,
 max(total_return_pct) AS max_return, max(max_drawdown_pct) AS max_drawdown, count(*) FILTER (beat_index) AS years_beat, sum(total_trades)::BIGINT AS total_trades,
 avg(win_rate) AS avg_win_rate, avg(sharpe_ratio) AS avg_sharpe FROM yearly GROUP BY symbol), c AS (SELECT *, ((avg_return >= 15)::INT + (min_return >= 0)::INT
 + (max_drawdown < 6)::INT + (years_beat >= years * 0.7)::INT + (total_trades >= 500)::INT + (avg_sharpe >= 1)::INT) AS criteria_passed FROM g)
SELECT symbol, years, years_beat, total_trades, criteria_passed, criteria_passed >= 5 AS viable, {q.r6('avg_return')} AS avg_return, {q.r6('min_return')} AS min_return,
 {q.r6('max_return')} AS max_return, {q.r6('max_drawdown')} AS max_drawdown, {q.r6('avg_win_rate')} AS avg_win_rate, {q.r6('avg_sharpe')} AS avg_sharpe FROM c""")
def mt_6b(spark, sf):
    return rnd(M.viability(yearly(spark, sf)), "symbol", "years", "years_beat", "total_trades", "criteria_passed", "viable",
               d="avg_return min_return max_return max_drawdown avg_win_rate avg_sharpe")


@query("jn_8_index_returns", f"WITH {T}, {SQL_YEARLY} SELECT symbol, year::INTEGER AS year, {q.r6('index_return_pct')} AS index_return_pct, beat_index FROM yearly")
def jn_8(spark, sf):
    return rnd(yearly(spark, sf), "symbol", "year", "beat_index", d="index_return_pct")


@query("mt_7_index_comparison", f"""WITH {T} SELECT symbol, timeframe, {q.r6('total_return_pct / 100 / (80 / 12.0) * 100')} AS annual_return_pct,
 {q.r6('(total_return_pct / 100 / (80 / 12.0) - 0.1) * 100')} AS excess_return_pct, {q.r6('sharpe_ratio - 0.5')} AS excess_sharpe,
 {q.r6('(0.2 - max_drawdown_pct / 100) * 100')} AS dd_improvement_pct, total_return_pct / 100 / (80 / 12.0) > 0.1 AND sharpe_ratio > 0.5
 AND max_drawdown_pct / 100 < 0.2 AS beats_index FROM {sql_metrics('trades')}""")
def mt_7(spark, sf):
    return rnd(M.index_comparison(M.trade_metrics(I.trades(spark, sf)), 80), "symbol", "timeframe", "beats_index",
               d="annual_return_pct excess_return_pct excess_sharpe dd_improvement_pct")


@query("mt_8_stress_costs", f"""WITH {T}, st AS (SELECT * REPLACE (pnl - abs(pnl) * 0.02 * 0.25 - pnl * 0.05 AS pnl) FROM trades),
 a AS (SELECT * FROM {sql_metrics('st')}), b AS (SELECT * FROM {sql_metrics('trades')})
SELECT a.symbol, a.timeframe, {q.r6('a.profit_factor')} AS profit_factor, {q.r6('a.max_drawdown_pct')} AS max_drawdown_pct, {q.r6('a.total_return_pct')} AS total_return_pct,
 {q.r6('b.profit_factor * 0.85 * 0.9')} AS stressed_pf, {q.r6('b.max_drawdown_pct * 1.2')} AS stressed_dd FROM a JOIN b USING (symbol, timeframe)""")
def mt_8(spark, sf):
    t = I.trades(spark, sf).withColumn("cost", F.abs("pnl") * 0.02)
    a = M.trade_metrics(M.stress_costs(t))
    b = M.approximate_stress(M.trade_metrics(t)).select("symbol", "timeframe", "stressed_pf", "stressed_dd")
    return rnd(a.join(b, ["symbol", "timeframe"]), "symbol", "timeframe", d="profit_factor max_drawdown_pct total_return_pct stressed_pf stressed_dd")


SQL_BOOT = f"""boot AS (SELECT symbol, pnl, return_pct, row_number() OVER (PARTITION BY symbol ORDER BY exit_time, trade_id) - 1 AS i FROM trades),
sizes AS (SELECT symbol, count(*) AS n FROM boot GROUP BY symbol),
plan AS (SELECT symbol, sim, b, {start_sql('sim', 'b', '(n - 10)', 7)} AS first FROM (SELECT symbol, n, sim, unnest(range(n // 10)) AS b FROM sizes, (SELECT unnest(range(1000)) AS sim) WHERE n > 10)),
laid AS (SELECT symbol, sim, b * 10 + k AS place, pnl, return_pct FROM (SELECT symbol, sim, b, k, first + k AS i FROM plan, (SELECT unnest(range(10)) AS k)) JOIN boot USING (symbol, i)),
upto AS (SELECT *, sum(pnl) OVER (PARTITION BY symbol, sim ORDER BY place ROWS UNBOUNDED PRECEDING) AS cum FROM laid),
peaks AS (SELECT *, max(cum) OVER (PARTITION BY symbol, sim ORDER BY place ROWS UNBOUNDED PRECEDING) - cum AS fall FROM upto),
runs AS (SELECT symbol, sim, sum(greatest(pnl, 0)) AS gp, sum(greatest(-pnl, 0)) AS gl, max(fall) / 1000 AS dd, coalesce(avg(return_pct) / nullif(stddev_pop(return_pct), 0), 0) AS sharpe FROM peaks GROUP BY symbol, sim),
figures AS (SELECT symbol, count(*) AS sims, avg(pf) AS pf_mean, stddev_pop(pf) AS pf_std, quantile_cont(pf, 0.05) AS pf_5th, quantile_cont(pf, 0.95) AS pf_95th, avg(sharpe) AS sharpe_mean, avg(dd) AS dd_mean, quantile_cont(dd, 0.95) AS dd_95th
 FROM (SELECT *, CASE WHEN gl > 0 THEN gp / gl ELSE gp END AS pf FROM runs) GROUP BY symbol)"""
MT9 = "pf_mean pf_std pf_5th pf_95th sharpe_mean dd_mean dd_95th"


@query("mt_9_block_bootstrap", f"WITH {T}, {SQL_BOOT} SELECT symbol, coalesce(sims, 0) AS sims, {', '.join(f'{q.r6(c)} AS {c}' for c in MT9.split())} FROM sizes LEFT JOIN figures USING (symbol)")
def mt_9(spark, sf):
    return rnd(M.block_bootstrap(I.trades(spark, sf)), "symbol", "sims", d=MT9)


@query("mt_10_period_rollup", f"""WITH {T}, x AS (SELECT symbol, timeframe, pnl, 'daily' AS period, exit_time::DATE AS period_start FROM trades
 UNION ALL SELECT symbol, timeframe, pnl, 'weekly', date_trunc('week', exit_time)::DATE FROM trades
 UNION ALL SELECT symbol, timeframe, pnl, 'monthly', date_trunc('month', exit_time)::DATE FROM trades
 UNION ALL SELECT symbol, timeframe, pnl, 'all_time', NULL FROM trades)
SELECT symbol, timeframe, period, period_start, count(*) AS total_trades, count(*) FILTER (pnl > 0) AS winning_trades, {q.r6('sum(pnl)', 4)} AS total_pnl,
 {q.r6('count(*) FILTER (pnl > 0) * 100.0 / count(*)')} AS win_rate, {q.r6('min(pnl)', 4)} AS worst_trade, {q.r6('max(pnl)', 4)} AS best_trade
FROM x GROUP BY symbol, timeframe, period, period_start""")
def mt_10(spark, sf):
    df = M.period_rollup(I.trades(spark, sf))
    return df.select("symbol", "timeframe", "period", "period_start", "total_trades", "winning_trades", F.round("total_pnl", 4).alias("total_pnl"),
                     F.round("win_rate", 6).alias("win_rate"), F.round("worst_trade", 4).alias("worst_trade"), F.round("best_trade", 4).alias("best_trade"))


# ---- scoring ------------------------------------------------------------------------------
SIG = f"""{B}, {P}, e AS (SELECT *, list_reverse_sort([p_flat, p_long, p_short]) AS top FROM preds),
sig AS (SELECT *, top[1] - top[2] AS edge, CASE WHEN p_long > p_short AND p_long > p_flat THEN 'long' WHEN p_short > p_long AND p_short > p_flat THEN 'short' ELSE 'flat' END AS signal,
 CASE WHEN p_long > p_short AND p_long > p_flat THEN p_long WHEN p_short > p_long AND p_short > p_flat THEN p_short ELSE p_flat END AS confidence FROM e)"""


def preds(spark, sf):
    return I.predictions(I.bars(spark, sf))


def signals(spark, sf):
    return SC.signal_from_probs(preds(spark, sf))


@query("sc_1_signal_from_probs", f"WITH {SIG} SELECT symbol, bar_ts, model, signal, {q.r6('confidence')} AS confidence, {q.r6('edge')} AS edge FROM sig")
def sc_1(spark, sf):
    return rnd(signals(spark, sf), "symbol", "bar_ts", "model", "signal", d="confidence edge")


@query("sc_2_trade_filter", f"""WITH {SIG} SELECT symbol, bar_ts, model, CAST(p_long = top[1] AND edge >= 0.08 AND top[1] >= 0.42 AS INTEGER) AS long_signal,
 CAST(p_long <> top[1] AND p_short = top[1] AND edge >= 0.08 AND top[1] >= 0.42 AS INTEGER) AS short_signal FROM sig""")
def sc_2(spark, sf):
    return SC.trade_filter(preds(spark, sf), 0.42, 0.08).select("symbol", "bar_ts", "model", "long_signal", "short_signal")


@query("sc_3_signal_quality", f"""WITH {SIG}, z AS (SELECT *, CASE WHEN p_flat = top[1] THEN 'flat' WHEN p_long = top[1] THEN 'long' ELSE 'short' END AS sg,
 greatest(p_long, p_short) AS dc FROM sig) SELECT symbol, bar_ts, model, sg AS signal, CASE WHEN p_long > p_short THEN 'long' ELSE 'short' END AS directional_signal,
 {q.r6('dc')} AS directional_confidence, CASE WHEN sg <> 'flat' AND top[1] >= 0.45 AND edge >= 0.1 THEN 'high' WHEN dc >= 0.40 AND edge >= 0.05 THEN 'medium' ELSE 'low' END AS signal_quality FROM z""")
def sc_3(spark, sf):
    return rnd(SC.signal_quality(preds(spark, sf), 0.45, 0.10), "symbol", "bar_ts", "model", "signal", "directional_signal", "signal_quality", d="directional_confidence")


@query("sc_4_vote_majority", f"""WITH {SIG}, g AS (SELECT symbol, bar_ts, count(*) FILTER (signal = 'long') AS votes_long, count(*) FILTER (signal = 'short') AS votes_short,
 count(*) FILTER (signal = 'flat') AS votes_flat, avg(confidence) AS c, avg(edge) AS e, count(*) AS num_models FROM sig GROUP BY symbol, bar_ts)
SELECT symbol, bar_ts, votes_long, votes_short, votes_flat, num_models, {q.r6('c')} AS confidence, {q.r6('e')} AS edge,
 CASE WHEN votes_long >= votes_short AND votes_long >= votes_flat THEN 'long' WHEN votes_short >= votes_flat THEN 'short' ELSE 'flat' END AS signal FROM g""")
def sc_4(spark, sf):
    return rnd(SC.vote_majority(signals(spark, sf)), "symbol", "bar_ts", "votes_long", "votes_short", "votes_flat", "num_models", "signal", d="confidence edge")


def sql_vote(weight, src="sig"):
    return f"""WITH {SIG}, {{extra}} g AS (SELECT symbol, bar_ts, count(*) AS num_models, sum(w) FILTER (signal = 'long') AS l, sum(w) FILTER (signal = 'short') AS s,
 sum(w) FILTER (signal = 'flat') AS f, sum(w) AS t FROM (SELECT *, {weight} AS w FROM {src}) GROUP BY symbol, bar_ts),
n AS (SELECT symbol, bar_ts, num_models, coalesce(l / t, 0) AS l, coalesce(s / t, 0) AS s, coalesce(f / t, 0) AS f FROM g)
SELECT symbol, bar_ts, num_models, CASE WHEN l >= s AND l >= f THEN 'long' WHEN s >= f THEN 'short' ELSE 'flat' END AS signal,
 {q.r6('greatest(l, s, f)')} AS confidence, {q.r6('list_reverse_sort([l, s, f])[1] - list_reverse_sort([l, s, f])[2]')} AS edge FROM n"""


@query("sc_5_vote_confidence_weighted", sql_vote("confidence").format(extra=""))
def sc_5(spark, sf):
    return rnd(SC.vote_confidence_weighted(signals(spark, sf)), "symbol", "bar_ts", "num_models", "signal", d="confidence edge")


@query("sc_6_vote_performance_weighted", sql_vote("coalesce(win_rate / 100, 0.5) * confidence", "sp").format(extra=f"""{T},
 wr AS (SELECT symbol, timeframe AS model, count(*) FILTER (pnl > 0) * 100.0 / count(*) AS win_rate FROM trades GROUP BY ALL),
 sp AS (SELECT sig.*, win_rate FROM sig LEFT JOIN wr USING (symbol, model)), """))
def sc_6(spark, sf):
    wr = (I.trades(spark, sf).groupBy("symbol", F.col("timeframe").alias("model"))
          .agg((F.count_if(F.col("pnl") > 0) * 100.0 / F.count("*")).alias("win_rate")))
    return rnd(SC.vote_performance_weighted(signals(spark, sf), wr), "symbol", "bar_ts", "num_models", "signal", d="confidence edge")


@query("sc_7_blend_probs", f"""WITH {B}, {P}, w AS (SELECT *, CASE model WHEN '5T' THEN 0.395 WHEN '15T' THEN 0.251 ELSE 0.354 END AS w FROM preds)
SELECT symbol, bar_ts, {q.r6('sum(p_flat * w) / sum(w)')} AS p_flat, {q.r6('sum(p_long * w) / sum(w)')} AS p_long, {q.r6('sum(p_short * w) / sum(w)')} AS p_short
FROM w GROUP BY symbol, bar_ts""")
def sc_7(spark, sf):
    return rnd(SC.blend_probs(preds(spark, sf), {"5T": 0.395, "15T": 0.251, "30T": 0.354}), "symbol", "bar_ts", d="p_flat p_long p_short")


@query("sc_8_confidence_histogram", f"""WITH {SIG} SELECT symbol, model, count(*) AS rows, {q.r6('avg(confidence)')} AS avg_confidence, {q.r6('stddev_pop(confidence)')} AS std_confidence,
 {', '.join(f"{q.r6(f'count(*) FILTER (confidence >= {t}) * 100.0 / count(*)')} AS pct_ge_{round(t * 100)}" for t in (0.5, 0.55, 0.6, 0.7, 0.8))},
 {', '.join(f"{q.r6(chr(99) + f'ount(*) FILTER (signal = {chr(39)}{s}{chr(39)}) * 100.0 / count(*)')} AS pct_{s}" for s in ('long', 'short', 'flat'))},
 CASE WHEN count(*) FILTER (confidence >= 0.55) * 100.0 / count(*) > 80 THEN 'not_selective' WHEN count(*) FILTER (confidence >= 0.55) * 100.0 / count(*) > 50 THEN 'too_frequent'
 WHEN count(*) FILTER (confidence >= 0.55) * 100.0 / count(*) > 20 THEN 'moderate' ELSE 'selective' END AS verdict FROM sig GROUP BY symbol, model""")
def sc_8(spark, sf):
    return rnd(SC.confidence_histogram(signals(spark, sf)), "symbol", "model", "rows", "verdict",
               d="avg_confidence std_confidence pct_ge_50 pct_ge_55 pct_ge_60 pct_ge_70 pct_ge_80 pct_long pct_short pct_flat")


@query("sc_9_regime_veto", f"""WITH {SIG}, z AS (SELECT *, CASE WHEN confidence >= 0.6 THEN 'Trend' WHEN confidence < 0.42 THEN 'Range' ELSE 'Neutral' END AS regime FROM sig)
SELECT symbol, bar_ts, model, regime, regime IN ('Range', 'Chop') AS vetoed, CASE WHEN regime IN ('Range', 'Chop') THEN 'flat' ELSE signal END AS final_signal FROM z""")
def sc_9(spark, sf):
    s = signals(spark, sf).withColumn("regime", F.when(F.col("confidence") >= 0.6, "Trend").when(F.col("confidence") < 0.42, "Range").otherwise("Neutral"))
    return SC.regime_veto(s, ["Range", "Chop"]).select("symbol", "bar_ts", "model", "regime", "vetoed", "final_signal")


# ---- sizing -------------------------------------------------------------------------------
ENTRY = f"""{B}, {COSTS}, {TPSL}, {PIPS}, a1 AS (SELECT *, {SQL_TR['trange']} AS trange FROM bars), a2 AS (SELECT *, {q.mean('trange', 14)} AS atr FROM a1),
ent AS (SELECT a2.symbol, a2.timeframe, bar_ts, close AS entry_price, atr, volume, CASE WHEN close >= open THEN 'long' ELSE 'short' END AS direction,
 CASE WHEN close >= open THEN 1 ELSE -1 END AS s, spread_pips, commission_pct, slippage_pct, tp_mult, sl_mult FROM a2 JOIN costs USING (symbol) JOIN tpsl USING (symbol, timeframe)
 WHERE atr IS NOT NULL), ent2 AS (SELECT *, entry_price + s * atr * tp_mult AS tp_price, entry_price - s * atr * sl_mult AS sl_price FROM ent)"""


def entries(spark, sf):
    """Every bar with an ATR as an entry at its close in the direction of its body, with dimensions joined."""
    e = ind.atr(blocked(I.bars(spark, sf), back=20), 14).rows().where("atr14 IS NOT NULL")
    e = e.select("symbol", "timeframe", "bar_ts", F.col("close").alias("entry_price"), F.col("atr14").alias("atr"), "volume",
                 F.when(F.col("close") >= F.col("open"), "long").otherwise("short").alias("direction"))
    e = J.with_tp_sl(J.with_costs(e, dims.costs(spark, RENAME)), dims.tp_sl(spark, RENAME))
    return SZ.tp_sl_prices(e)


@query("sz_1_tp_sl_prices", f"WITH {ENTRY} SELECT symbol, bar_ts, direction, {q.r6('tp_price')} AS tp_price, {q.r6('sl_price')} AS sl_price FROM ent2")
def sz_1(spark, sf):
    return rnd(entries(spark, sf), "symbol", "bar_ts", "direction", d="tp_price sl_price")


@query("sz_2_trade_costs", f"""WITH {ENTRY}, c AS (SELECT *, 10000.0 AS notional, entry_price + s * spread_pips * 0.01 AS e1, tp_price - s * spread_pips * 0.01 AS x1 FROM ent2)
SELECT symbol, bar_ts, {q.r6('e1 + s * e1 * slippage_pct')} AS adjusted_entry, {q.r6('x1 - s * x1 * slippage_pct')} AS adjusted_exit,
 {q.r6('notional * commission_pct * 2')} AS commission, {q.r6('notional * slippage_pct * 2')} AS slippage FROM c""")
def sz_2(spark, sf):
    df = SZ.with_trade_costs(entries(spark, sf).withColumn("notional", F.lit(10000.0)), "entry_price", "tp_price", "notional")
    return rnd(df, "symbol", "bar_ts", d="adjusted_entry adjusted_exit commission slippage")


@query("sz_3_position_size", f"""WITH {ENTRY}, c AS (SELECT *, abs(entry_price - sl_price) AS dist, volume < 2 AS hold FROM ent2)
SELECT symbol, bar_ts, {q.r6('dist')} AS stop_distance, {q.r6('CASE WHEN hold OR dist = 0 THEN 0 ELSE least(1000 / nullif(dist, 0) * entry_price, 10000) END')} AS position_value,
 {q.r6('CASE WHEN hold OR dist = 0 THEN 0 ELSE least(1000 / nullif(dist, 0) * entry_price, 10000) / entry_price END')} AS position_size,
 {q.r6('CASE WHEN hold OR dist = 0 THEN 0 ELSE 1000 END')} AS risk_amount FROM c""")
def sz_3(spark, sf):
    e = entries(spark, sf).withColumn("signal", F.when(F.col("volume") < 2, "HOLD").otherwise("BUY"))
    return rnd(SZ.position_size(e, 100000.0), "symbol", "bar_ts", d="stop_distance position_value position_size risk_amount")


@query("sz_4_position_size_leveraged", f"""WITH {ENTRY}, c AS (SELECT *, abs(entry_price - sl_price) AS dist FROM ent2),
d AS (SELECT *, 2000 / nullif(dist, 0) * entry_price AS want FROM c), e AS (SELECT *, want / 5 > 20000 AS capped, CASE WHEN want / 5 > 20000 THEN 100000 ELSE want END AS val,
 dist > 0 AND want / 5 <= 100000 AND CASE WHEN want / 5 > 20000 THEN 100000 ELSE want END >= 100 AS ok FROM d)
SELECT symbol, bar_ts, {q.r6('CASE WHEN ok THEN val / entry_price ELSE 0 END')} AS position_size, {q.r6('CASE WHEN ok THEN val ELSE 0 END')} AS position_value,
 {q.r6('CASE WHEN ok AND capped THEN val / entry_price * dist WHEN ok THEN 2000 ELSE 0 END')} AS actual_risk FROM e""")
def sz_4(spark, sf):
    return rnd(SZ.position_size_leveraged(entries(spark, sf), 100000.0, 0.02, 5.0, 0.20), "symbol", "bar_ts", d="position_size position_value actual_risk")


@query("sz_5_market_frictions", f"""WITH {ENTRY}, g AS (SELECT symbol, bar_ts, dayofweek(bar_ts) = 5 AND dayofweek({q.lead('bar_ts')}) = 1 AS weekend_gap,
 abs({q.lead('open')} - close) / close AS gp FROM bars) SELECT symbol, bar_ts, coalesce(weekend_gap, false) AS weekend_gap,
 {q.r6('CASE WHEN weekend_gap THEN gp ELSE 0 END')} AS gap_pct, {q.r6('''greatest(0.8, least(5, CASE WHEN hour(bar_ts) >= 22 OR hour(bar_ts) < 2 THEN 1.5 ELSE 1 END
 * CASE WHEN hour(bar_ts) >= 13 AND hour(bar_ts) < 17 THEN 0.8 ELSE 1 END * CASE WHEN atr / entry_price > 0.01 THEN 1 + (atr / entry_price - 0.01) * 20 ELSE 1 END))''')} AS spread_multiplier,
 {q.r6('s * entry_price * (50000 * 0.5 / 100000 / volume / 10000)', 9)} AS market_impact FROM g JOIN ent2 USING (symbol, bar_ts)""")
def sz_5(spark, sf):
    s = ind.atr(blocked(I.bars(spark, sf), back=20, fwd=2), 14)
    nxt = s.lead("bar_ts")
    s = s.add(weekend_gap=F.coalesce((F.weekday("bar_ts") == 4) & (F.weekday(nxt) == 0), F.lit(False)),
              _g=F.abs(s.lead("open") - F.col("close")) / F.col("close"),
              direction=F.when(F.col("close") >= F.col("open"), "long").otherwise("short"))
    s = s.add(gap_pct=F.when(F.col("weekend_gap"), F.col("_g")).otherwise(0.0),
              spread_multiplier=SZ.spread_multiplier(F.hour("bar_ts"), F.col("atr14_pct")),
              market_impact=SZ.market_impact(F.lit(50000.0), F.col("close"), F.col("volume")))
    # nine digits: at six, exact values lie on ties that engines round either way
    rows = s.rows().where("atr14 IS NOT NULL").withColumn("market_impact", F.round("market_impact", 9))
    return rnd(rows, "symbol", "bar_ts", "weekend_gap", "market_impact", d="gap_pct spread_multiplier")


@query("sz_6_pip_spread_to_price", f"""WITH {ENTRY} SELECT symbol, bar_ts, {q.r6('spread_pips * coalesce(spread_pip, 0.0001)', 8)} AS spread FROM ent2 LEFT JOIN pips USING (symbol)""")
def sz_6(spark, sf):
    e = J.with_pip_value(entries(spark, sf), dims.pips(spark, {k: v for k, v in RENAME.items() if k != "S3"}))
    return e.select("symbol", "bar_ts", F.round(SZ.pip_spread_to_price(F.col("spread_pips"), F.col("spread_pip")), 8).alias("spread"))


# ---- gates --------------------------------------------------------------------------------
@query("gt_1_guardrails", f"""WITH {ENTRY}, n AS (SELECT max(bar_ts) AS now FROM bars), c AS (SELECT ent2.*, now, 0.3 + (hour(bar_ts) * 3 % 50) / 100.0 AS confidence, atr * (volume % 5) / 20 AS spread,
 40.0 * volume AS latency_ms, epoch(now) - epoch(bar_ts) AS age, CASE WHEN dayofweek(now) IN (0, 6) OR (dayofweek(now) = 1 AND hour(now) < 2) THEN 259200 ELSE greatest(1800, 7200 + 300) END AS lim FROM ent2, n),
d AS (SELECT *, list_filter([CASE WHEN age > lim THEN 'staleness' END, CASE WHEN spread / atr > 0.15 THEN 'spread' END,
 CASE WHEN atr / entry_price < 0.003 OR atr / entry_price > 0.05 THEN 'volatility' END, CASE WHEN hour(bar_ts) >= 21 THEN 'session' END,
 CASE WHEN dayofweek(bar_ts) IN (0, 6) THEN 'weekend' END, CASE WHEN confidence < 0.55 THEN 'confidence' END, CASE WHEN latency_ms > 250 THEN 'latency' END], lambda x: x IS NOT NULL) AS f FROM c)
SELECT symbol, bar_ts, CAST(age AS BIGINT) AS age_seconds, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM d""")
def gt_1(spark, sf):
    b = I.bars(spark, sf)
    now = b.agg(F.max("bar_ts")).scalar()
    e = entries(spark, sf).withColumns({
        "price": F.col("entry_price"), "confidence": F.lit(0.3) + (F.hour("bar_ts") * 3 % 50) / 100.0,
        "spread": F.col("atr") * (F.col("volume") % 5) / 20, "latency_ms": F.lit(40.0) * F.col("volume")})
    df = G.guardrails(e, G.PRESETS["moderate"], now, F.lit(60))
    return df.select("symbol", "bar_ts", "age_seconds", F.concat_ws(",", "failures").alias("failures"), "passed")


@query("gt_2_post_filters", f"""WITH {ENTRY}, c AS (SELECT *, 0.3 + (hour(bar_ts) * 3 % 50) / 100.0 AS confidence, atr * (volume % 5) / 6 AS spread, volume % 9 AS bars_since_trade,
 CASE WHEN volume < 2 THEN 'HOLD' WHEN s > 0 THEN 'BUY' ELSE 'SELL' END AS sg FROM ent2), d AS (SELECT *, list_filter([CASE WHEN bars_since_trade < 5 THEN 'cooldown' END,
 CASE WHEN spread > atr * 0.5 THEN 'spread' END, CASE WHEN confidence < 0.4 AND sg <> 'HOLD' THEN 'confidence' END], lambda x: x IS NOT NULL) AS f FROM c)
SELECT symbol, bar_ts, sg AS original_signal, CASE WHEN len(f) > 0 THEN 'HOLD' ELSE sg END AS signal, array_to_string(f, ',') AS filter_reasons, len(f) > 0 AS filtered FROM d""")
def gt_2(spark, sf):
    e = entries(spark, sf).withColumns({
        "confidence": F.lit(0.3) + (F.hour("bar_ts") * 3 % 50) / 100.0, "spread": F.col("atr") * (F.col("volume") % 5) / 6,
        "bars_since_trade": F.col("volume") % 9,
        "signal": F.when(F.col("volume") < 2, "HOLD").when(F.col("direction") == "long", "BUY").otherwise("SELL")})
    return G.post_filters(e).select("symbol", "bar_ts", "original_signal", "signal", F.concat_ws(",", "filter_reasons").alias("filter_reasons"), "filtered")


@query("gt_3_expiry", f"""WITH {ENTRY} SELECT symbol, bar_ts, bar_ts + to_minutes(CAST(volume AS BIGINT) * 15) AS expires_at,
 coalesce(row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 > CASE WHEN volume > 2 THEN volume * 40 END, false) AS expired FROM ent2""")
def gt_3(spark, sf):
    s = blocked(entries(spark, sf))
    s = s.add(expires_at=G.expires_at(F.col("bar_ts"), F.col("volume").cast("int") * 15),
              expired=G.expired(s.index, F.when(F.col("volume") > 2, F.col("volume") * 40)))
    return s.select("expires_at", "expired").drop("timeframe")


def sql_fail(extra, need):
    return f"""list_filter([CASE WHEN profit_factor < 1.6 THEN 'PF' END, CASE WHEN max_drawdown_pct > 6.0 THEN 'DD' END, CASE WHEN sharpe_ratio < {extra[0]} THEN 'Sharpe' END,
 CASE WHEN win_rate < {extra[1]} THEN 'WR' END, CASE WHEN total_trades < {need} THEN 'Trades' END], lambda x: x IS NOT NULL)"""


@query("gt_4_benchmark_check", f"""WITH {T}, f AS (SELECT symbol, timeframe, {sql_fail((1.0, 45.0), "CASE timeframe WHEN '5T' THEN 200 WHEN '15T' THEN 150 WHEN '30T' THEN 100 WHEN '1H' THEN 60 ELSE 40 END")} AS f,
 {sql_fail((0.25, 52.0), 200)} AS g FROM {sql_metrics('trades')})
SELECT symbol, timeframe, array_to_string(f, ',') AS failures, len(f) = 0 AS passes_strict, NOT list_has_any(f, ['PF', 'DD']) AND len(f) <= 1 AS passes_lenient, array_to_string(g, ',') AS go_live_failures FROM f""")
def gt_4(spark, sf):
    m = M.trade_metrics(I.trades(spark, sf))
    live = G.benchmark_check(m, G.GO_LIVE).select("symbol", "timeframe", F.concat_ws(",", "failures").alias("go_live_failures"))
    df = G.benchmark_check(m).select("symbol", "timeframe", F.concat_ws(",", "failures").alias("failures"), "passes_strict", "passes_lenient")
    return df.join(live, ["symbol", "timeframe"])


@query("gt_5_hard_gates", f"""WITH {T}, {SQL_CURVE}, {SQL_BT}, {MONTHS}, {STREAK}, m AS (SELECT bt.*, month_pct, max_consecutive AS streak, abs(avg_loss) AS al,
 coalesce((win_rate / 100 * avg_win - (1 - win_rate / 100) * abs(avg_loss)) / nullif(abs(avg_loss), 0), 0) AS ex FROM bt JOIN months USING (symbol, timeframe) JOIN streaks USING (symbol, timeframe)),
l AS (SELECT *, max_drawdown_pct > 6 AS dd, profit_factor < 1.6 AS pf, sharpe_ratio < 0.25 AS sh, month_pct < 70 AS mo, win_rate < 52 AND ex < 0.08 AS qu, total_trades < 200 AS few,
 total_trades >= 200 AND total_trades / 80.0 < 30 AS slow FROM m),
r AS (SELECT *, list_filter([CASE WHEN dd THEN 'DD' END, CASE WHEN pf THEN 'PF' END, CASE WHEN sh THEN 'Sharpe' END, CASE WHEN mo THEN 'months' END, CASE WHEN qu THEN 'quality' END,
  CASE WHEN few THEN 'trades' END, CASE WHEN slow THEN 'trades_per_month' END], lambda x: x IS NOT NULL) AS f,
 list_filter([CASE WHEN dd AND streak >= 5 THEN 'loss_streak' END, CASE WHEN dd AND sl_hit_rate > 60 THEN 'stops_hit' END, CASE WHEN dd AND abs(largest_loss) / 1000 > 2 THEN 'single_large_loss' END,
  CASE WHEN pf AND win_rate < 45 THEN 'low_win_rate' END, CASE WHEN pf AND avg_win > 0 AND al > 0 AND avg_win / al < 1.2 THEN 'poor_reward_risk' END, CASE WHEN pf AND timeout_rate > 30 THEN 'timeouts' END,
  CASE WHEN sh THEN 'inconsistent_returns' END, CASE WHEN mo THEN 'inconsistent_months' END, CASE WHEN qu THEN 'poor_trade_quality' END, CASE WHEN few THEN 'too_few_trades' END], lambda x: x IS NOT NULL) AS c,
 list_filter([CASE WHEN dd THEN '1 tighten regime filter' END, CASE WHEN dd THEN '1 raise cooldown' END, CASE WHEN dd THEN '1 add circuit breaker' END, CASE WHEN pf AND win_rate < 48 THEN '2 raise entry thresholds' END,
  CASE WHEN pf AND timeout_rate > 30 THEN '2 shorten horizon' END, CASE WHEN sh THEN '3 raise decision threshold' END, CASE WHEN sh THEN '3 add session filter' END, CASE WHEN few OR slow THEN '3 loosen filters' END], lambda x: x IS NOT NULL) AS x FROM l)
SELECT symbol, timeframe, array_to_string(f, ',') AS failures, array_to_string(c, ',') AS root_causes, CASE WHEN len(c) > 0 THEN array_to_string(x, ',') ELSE '' END AS ranked_fixes,
 len(f) = 0 AS live_ready, {q.r6('ex')} AS expectancy_r FROM r""")
def gt_5(spark, sf):
    t, k = I.trades(spark, sf), ["symbol", "timeframe"]
    m = M.backtest_metrics(t).join(M.monthly_consistency(t), k).join(
        M.max_consecutive(t, k, ["exit_time", "trade_id"], F.col("pnl") < 0).withColumnRenamed("max_consecutive", "max_loss_streak"), k)
    df = G.hard_gates(m, months=80)
    return df.select(*k, *(F.concat_ws(",", c).alias(c) for c in ("failures", "root_causes", "ranked_fixes")), "live_ready", F.round("expectancy_r", 6).alias("expectancy_r"))


OLDNEW = f"""told AS (SELECT * FROM trades WHERE exit_time < TIMESTAMP '1998-06-01'), tnew AS (SELECT * FROM trades WHERE exit_time >= TIMESTAMP '1998-06-01'),
o AS (SELECT * FROM {sql_metrics('told')}), n AS (SELECT * FROM {sql_metrics('tnew')})"""


def old_new(spark, sf):
    """Metrics before and after a date: what a model promised and what it did."""
    t = I.trades(spark, sf)
    cut = F.lit("1998-06-01").cast("timestamp_ntz")
    return M.trade_metrics(t.where(F.col("exit_time") < cut)), M.trade_metrics(t.where(F.col("exit_time") >= cut))


@query("gt_6_deploy_decision", f"""WITH {T}, {OLDNEW}, s AS (SELECT n.symbol, n.timeframe, n.profit_factor * 0.4 + n.win_rate / 100 * 0.3 + n.sharpe_ratio * 0.2 - n.max_drawdown_pct / 100 * 0.1 AS new_score,
 o.profit_factor * 0.4 + o.win_rate / 100 * 0.3 + o.sharpe_ratio * 0.2 - o.max_drawdown_pct / 100 * 0.1 AS old_score, n.profit_factor >= 1.4 AS np, o.profit_factor >= 1.4 AS op FROM n JOIN o USING (symbol, timeframe)),
g AS (SELECT *, CASE WHEN old_score > 0 THEN (new_score - old_score) / old_score * 100 ELSE 100 END AS imp FROM s)
SELECT symbol, timeframe, {q.r6('new_score')} AS new_score, {q.r6('old_score')} AS old_score, {q.r6('imp')} AS improvement_pct, imp >= 5 OR (np AND NOT op) OR (imp >= 0 AND np) AS deploy FROM g""")
def gt_6(spark, sf):
    old, new = (m.withColumn("passed", F.col("profit_factor") >= 1.4) for m in old_new(spark, sf))
    return rnd(G.deploy_decision(new, old), "symbol", "timeframe", "deploy", d="new_score old_score improvement_pct")


@query("jn_7_join_expected", f"""WITH {T}, {OLDNEW} SELECT n.symbol, n.timeframe, {q.r6('n.win_rate')} AS win_rate, {q.r6('o.win_rate')} AS expected_win_rate, {q.r6('n.total_return_pct')} AS total_return_pct,
 {q.r6('o.total_return_pct')} AS expected_total_return_pct FROM n LEFT JOIN o USING (symbol, timeframe)""")
def jn_7(spark, sf):
    old, new = old_new(spark, sf)
    return rnd(J.join_expected(new, old), "symbol", "timeframe", d="win_rate expected_win_rate total_return_pct expected_total_return_pct")


@query("jn_9_signals_to_outcome", f"""WITH {ENTRY}, lp AS (SELECT symbol, arg_max(close, bar_ts) AS px, max(bar_ts) AS pts FROM bars GROUP BY symbol),
j AS (SELECT *, CASE WHEN s > 0 THEN px >= tp_price ELSE px <= tp_price END AS tp, CASE WHEN s > 0 THEN px <= sl_price ELSE px >= sl_price END AS sl FROM ent2 JOIN lp USING (symbol))
SELECT symbol, bar_ts, direction, CASE WHEN tp THEN 'take_profit' WHEN sl THEN 'stop_loss' WHEN pts > bar_ts + INTERVAL 48 HOUR THEN 'expired' ELSE 'open' END AS status,
 {q.r6('CASE WHEN tp THEN s * (tp_price - entry_price) WHEN sl THEN s * (sl_price - entry_price) END')} AS pnl FROM j""")
def jn_9(spark, sf):
    e = entries(spark, sf).withColumn("expires_at", F.col("bar_ts") + F.expr("INTERVAL 48 HOURS"))
    return rnd(J.signals_to_outcome(e, I.bars(spark, sf)), "symbol", "bar_ts", "direction", "status", d="pnl")


# ---- trades from signals ------------------------------------------------------------------
TR1 = f"""{SIG}, {COSTS}, {TPSL}, a1 AS (SELECT *, {SQL_TR['trange']} AS trange FROM bars), a2 AS (SELECT *, {q.mean('trange', 14)} AS atr14,
 count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS left_n FROM a1),
p1 AS (SELECT symbol, timeframe, bar_ts, left_n, {q.lead('open')} AS entry_price, {q.lead('atr14')} AS ea, list(high) {ahead(50)} AS hi, list(low) {ahead(50)} AS lo, last(close) {ahead(51)} AS tc FROM a2),
t1 AS (SELECT sig.symbol, sig.timeframe, sig.bar_ts, model, signal AS direction, confidence, entry_price, CASE WHEN ea > 0 THEN ea ELSE entry_price * 0.02 END AS atr, hi, lo, tc,
 CASE WHEN signal = 'long' THEN 1 ELSE -1 END AS s FROM sig JOIN p1 USING (symbol, timeframe, bar_ts) WHERE left_n >= 51 AND signal <> 'flat'),
t2 AS (SELECT *, entry_price + s * atr * tp_mult AS tpp, entry_price - s * atr * sl_mult AS slp FROM t1 JOIN costs USING (symbol) JOIN tpsl USING (symbol, timeframe)),
t3 AS (SELECT *, coalesce(list_position(CASE WHEN s > 0 THEN list_transform(hi, lambda x: x >= tpp) ELSE list_transform(lo, lambda x: x <= tpp) END, true), 0) AS ti,
 coalesce(list_position(CASE WHEN s > 0 THEN list_transform(lo, lambda x: x <= slp) ELSE list_transform(hi, lambda x: x >= slp) END, true), 0) AS si,
 1000 / nullif(abs(entry_price - slp), 0) AS size FROM t2),
t4 AS (SELECT *, CASE WHEN si > 0 AND (ti = 0 OR si <= ti) THEN 'sl' WHEN ti > 0 THEN 'tp' ELSE 'timeout' END AS exit_reason FROM t3 WHERE abs(entry_price - slp) >= entry_price * 0.001 AND size * entry_price <= 1000000),
t5 AS (SELECT *, CASE exit_reason WHEN 'sl' THEN slp WHEN 'tp' THEN tpp ELSE tc END AS xp, CASE exit_reason WHEN 'sl' THEN si - 1 WHEN 'tp' THEN ti - 1 ELSE 49 END AS bars_held,
 (entry_price + s * spread_pips * 0.01) * (1 + s * slippage_pct) AS ae FROM t4),
bt1 AS (SELECT *, (xp - s * spread_pips * 0.01) * (1 - s * slippage_pct) AS ax, size * entry_price * 2 * (commission_pct + slippage_pct) AS cost FROM t5),
btr AS (SELECT *, s * (ax - ae) * size - cost AS pnl, s * (xp - entry_price) * size AS gross_pnl FROM bt1)"""


def signal_trades(spark, sf):
    sg = signals(spark, sf).where(F.col("signal") != "flat").withColumnRenamed("signal", "direction")
    sg = sg.select("symbol", "timeframe", "bar_ts", "model", "direction", "confidence")
    return TR.barrier_trades(I.bars(spark, sf), sg, dims.costs(spark, RENAME), dims.tp_sl(spark, RENAME))


@query("tr_1_barrier_trades", f"""WITH {TR1} SELECT symbol, bar_ts, model, direction, exit_reason, CAST(bars_held AS INTEGER) AS bars_held, {q.r6('gross_pnl', 4)} AS gross_pnl,
 {q.r6('cost', 4)} AS cost, {q.r6('pnl', 4)} AS pnl FROM btr""")
def tr_1(spark, sf):
    return rnd(signal_trades(spark, sf), "symbol", "bar_ts", "model", "direction", "exit_reason", "bars_held", n=4, d="gross_pnl cost pnl")


@query("tr_1_barrier_trade_metrics", f"WITH {TR1} SELECT symbol, model, {MT1_OUT} FROM {sql_metrics('btr', 'symbol, model', 'bar_ts', returns='pnl')}")
def tr_1m(spark, sf):
    m = M.trade_metrics(signal_trades(spark, sf), ("symbol", "model"), ("bar_ts",))
    return rnd(m, "symbol", "model", "total_trades", "win_count", "loss_count", d=MT1)


THRESH = [0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70, 0.75, 0.80]
SWEEP = f"""{{src}}, th AS (SELECT unnest({THRESH!r}) AS confidence_threshold), sw AS (SELECT symbol, {{k}}, confidence_threshold, count(*) AS total_trades, count(*) FILTER (pnl > 0) * 100.0 / count(*) AS win_rate,
 coalesce(coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(coalesce(-sum(pnl) FILTER (pnl <= 0), 1), 0), 0) AS profit_factor, avg(pnl) / 1000 AS avg_r,
 coalesce(avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252), 0) AS sharpe_per_trade FROM {{t}} JOIN th ON confidence >= confidence_threshold GROUP BY ALL)"""


@query("tr_2_threshold_sweep", f"""WITH {SWEEP.format(src=T, k='timeframe', t='trades')} SELECT symbol, timeframe, confidence_threshold::DOUBLE AS confidence_threshold, total_trades, {q.r6('win_rate')} AS win_rate,
 {q.r6('profit_factor')} AS profit_factor, {q.r6('avg_r')} AS avg_r, {q.r6('sharpe_per_trade')} AS sharpe_per_trade FROM sw""")
def tr_2(spark, sf):
    return rnd(TR.threshold_sweep(I.trades(spark, sf), THRESH), "symbol", "timeframe", "confidence_threshold", "total_trades",
               d="win_rate profit_factor avg_r sharpe_per_trade")


@query("tr_2_pick_threshold", f"""WITH {SWEEP.format(src=T, k='timeframe', t='trades')}, k AS (SELECT *, profit_factor >= 1.3 AND win_rate >= 50 AND total_trades >= 50 AS ok FROM sw),
 r AS (SELECT *, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY ok DESC, CASE WHEN ok THEN sharpe_per_trade ELSE profit_factor END DESC, confidence_threshold) AS rn FROM k)
SELECT symbol, timeframe, confidence_threshold::DOUBLE AS confidence_threshold, total_trades, ok AS meets_targets, {q.r6('profit_factor')} AS profit_factor FROM r WHERE rn = 1""")
def tr_2p(spark, sf):
    df = TR.pick_threshold(TR.threshold_sweep(I.trades(spark, sf), THRESH))
    return rnd(df, "symbol", "timeframe", "confidence_threshold", "total_trades", "meets_targets", d="profit_factor")


OUTCOMES = f"outc AS ({sql_triple(6, 2.0, 1.0, 'symbol, timeframe, bar_ts, close AS entry_price, close + a * 2.0 AS tp_price, close - a AS sl_price, target, volume')})"


def outcomes(spark, sf):
    """Bars as long entries at the close with their barrier label as the outcome."""
    df = L.triple_barrier(L.barrier_series(I.bars(spark, sf), 6), 6, 2.0, 1.0)
    atr = F.when(F.col("atr14") > 0, F.col("atr14")).otherwise(F.col("close") * L.FALLBACK_ATR)
    return df.select("symbol", "timeframe", "bar_ts", F.col("close").alias("entry_price"), (F.col("close") + atr * 2.0).alias("tp_price"),
                     (F.col("close") - atr).alias("sl_price"), "target", "volume")


SCEN = values("scen", "cost_scenario, position_scenario, com, slip, cap",
              [(c, p, a, b, cap) for c, (a, b) in TR.COST_SCENARIOS.items() for p, cap in TR.POSITION_SCENARIOS.items()])


@query("tr_3_compound_equity", f"""WITH {OUTCOMES}, {SCEN}, r1 AS (SELECT o.*, scen.*, least(0.02 * entry_price / (entry_price - sl_price), cap) AS val FROM outc o, scen WHERE entry_price > sl_price),
r2 AS (SELECT *, 1 + val * ((CASE WHEN target = 1 THEN tp_price ELSE sl_price END - entry_price) / entry_price - com * 0.00001 - slip * 0.000005) AS f FROM r1),
r3 AS (SELECT *, product(f) OVER (PARTITION BY symbol, cost_scenario, position_scenario ORDER BY bar_ts ROWS UNBOUNDED PRECEDING) AS growth FROM r2),
r4 AS (SELECT *, greatest(1, max(growth) OVER (PARTITION BY symbol, cost_scenario, position_scenario ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)) AS pk FROM r3),
st AS (SELECT symbol, cost_scenario, position_scenario, min(bar_ts) AS stop FROM r4 WHERE 1 - growth / pk > 0.1 GROUP BY ALL),
r5 AS (SELECT r4.*, stop, 100000 * (growth - growth / f) AS pnl, stop IS NULL OR bar_ts < stop AS kept FROM r4 LEFT JOIN st USING (symbol, cost_scenario, position_scenario)),
g AS (SELECT symbol, cost_scenario, position_scenario, count(*) FILTER (kept) AS trades, count(*) FILTER (kept AND target = 1) * 100.0 AS w, sum(pnl) FILTER (kept AND target = 1) AS gw,
 abs(sum(pnl) FILTER (kept AND target <> 1)) AS gl, arg_max(growth, bar_ts) AS fin, max(1 - growth / pk) * 100 AS dd, bool_or(stop IS NOT NULL) AS stopped FROM r5 WHERE stop IS NULL OR bar_ts <= stop GROUP BY ALL),
h AS (SELECT *, coalesce(w / nullif(trades, 0), 0) AS win_rate, (fin - 1) * 100 AS ret, coalesce(coalesce(gw, 0) / nullif(coalesce(gl, 1), 0), 0) AS pf FROM g)
SELECT symbol, cost_scenario, position_scenario, trades, stopped, {q.r6('win_rate')} AS win_rate, {q.r6('ret')} AS total_return_pct, {q.r6('dd')} AS max_drawdown_pct, {q.r6('pf')} AS profit_factor,
 ret > 10 AND dd < 6 AND pf > 1.5 AS viable FROM h""")
def tr_3(spark, sf):
    df = TR.compound_equity(outcomes(spark, sf))
    return rnd(df, "symbol", "cost_scenario", "position_scenario", "trades", "stopped", "viable", d="win_rate total_return_pct max_drawdown_pct profit_factor")


ALLOC = [("A", 0.395), ("B", 0.251), ("C", 0.354)]


@query("tr_4_allocated_equity", f"""WITH {OUTCOMES}, {values('al', 'config, allocation', ALLOC)}, r1 AS (SELECT o.*, config, least(0.02 * entry_price / (entry_price - sl_price), 0.1) * allocation AS val
 FROM outc o, al WHERE entry_price > sl_price),
r2 AS (SELECT *, 1 + val * ((CASE WHEN target = 1 THEN tp_price ELSE sl_price END - entry_price) / entry_price - 0.00001 - 0.000005) AS f FROM r1),
r3 AS (SELECT *, product(f) OVER (PARTITION BY symbol ORDER BY bar_ts, config ROWS UNBOUNDED PRECEDING) AS growth FROM r2),
bb AS (SELECT symbol, bar_ts, arg_max(growth, config) AS growth FROM r3 GROUP BY ALL), pk AS (SELECT *, greatest(1, max(growth) OVER (PARTITION BY symbol ORDER BY bar_ts ROWS UNBOUNDED PRECEDING)) AS pk FROM bb),
dd AS (SELECT symbol, max(1 - growth / pk) * 100 AS max_drawdown_pct, arg_max(growth, bar_ts) * 100000 AS final_equity FROM pk GROUP BY symbol)
SELECT symbol, config, count(*) AS trades, count(*) FILTER (target = 1) AS wins, {q.r6('sum(100000 * (growth - growth / f))', 4)} AS pnl, {q.r6('count(*) FILTER (target = 1) * 100.0 / count(*)', 4)} AS win_rate,
 {q.r6('any_value(max_drawdown_pct)', 4)} AS max_drawdown_pct, {q.r6('any_value(final_equity)', 4)} AS final_equity FROM r3 JOIN dd USING (symbol) GROUP BY symbol, config""")
def tr_4(spark, sf):
    o = outcomes(spark, sf).withColumn("config", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    df = TR.allocated_equity(o, spark.createDataFrame(ALLOC, "config string, allocation double"))
    return rnd(df, "symbol", "config", "trades", "wins", n=4, d="pnl win_rate max_drawdown_pct final_equity")


@query("tr_5_allocation_weights", f"""WITH {T}, m AS (SELECT *, CASE WHEN max_drawdown_pct > 0 THEN total_return_pct / max_drawdown_pct ELSE total_return_pct END AS score FROM {sql_metrics('trades')})
SELECT symbol, timeframe, {q.r6('score')} AS score, {q.r6('''CASE WHEN sum(score) OVER (PARTITION BY symbol) > 0 THEN score / sum(score) OVER (PARTITION BY symbol)
 ELSE 1.0 / count(*) OVER (PARTITION BY symbol) END''')} AS weight FROM m""")
def tr_5(spark, sf):
    return rnd(TR.allocation_weights(M.trade_metrics(I.trades(spark, sf))), "symbol", "timeframe", d="score weight")


# ---- calendar and sessions ----------------------------------------------------------------
@query("ind_22_time_features", f"""WITH {B} SELECT symbol, bar_ts, hour(bar_ts)::INTEGER AS hour, ((dayofweek(bar_ts) + 6) % 7)::INTEGER AS dow, (hour(bar_ts) * 60 + minute(bar_ts))::INTEGER AS minute_of_day,
 {q.r6('sin(hour(bar_ts) * 2 * pi() / 24)')} AS hour_sin, {q.r6('cos(hour(bar_ts) * 2 * pi() / 24)')} AS hour_cos,
 {q.r6('sin(((dayofweek(bar_ts) + 6) % 7) * 2 * pi() / 7)')} AS dow_sin, {q.r6('cos(((dayofweek(bar_ts) + 6) % 7) * 2 * pi() / 7)')} AS dow_cos FROM bars""")
def ind_22(spark, sf):
    df = I.bars(spark, sf).withColumns(S.time_features(F.col("bar_ts")))
    return rnd(df, "symbol", "bar_ts", "hour", "dow", "minute_of_day", d="hour_sin hour_cos dow_sin dow_cos")


@query("ind_23_sessions", """WITH t AS (SELECT event_id, ts, hour(ts) AS h, hour(ts) * 60 + minute(ts) AS m FROM events),
s AS (SELECT *, CASE WHEN m < 420 THEN 0 WHEN m < 780 THEN 1 WHEN m < 1260 THEN 2 ELSE 3 END AS session FROM t)
SELECT event_id, session, """ + q.r6("CASE session WHEN 0 THEN m / 420.0 WHEN 1 THEN (m - 420) / 360.0 WHEN 2 THEN (m - 780) / 480.0 ELSE (m - 1260) / 180.0 END") + """ AS session_pos,
 (h BETWEEN 0 AND 8)::INTEGER AS is_asian_session, (h BETWEEN 8 AND 16)::INTEGER AS is_london_session, (h BETWEEN 13 AND 21)::INTEGER AS is_ny_session,
 CASE WHEN h BETWEEN 13 AND 21 THEN 'ny' WHEN h BETWEEN 8 AND 16 THEN 'london' WHEN h < 9 THEN 'asian' ELSE 'off' END AS named,
 CASE WHEN h < 8 THEN 'asia' WHEN h < 16 THEN 'europe' WHEN h < 21 THEN 'us' ELSE 'overnight' END AS guard,
 CASE WHEN h >= 22 OR h < 2 THEN 'Asian' WHEN h >= 7 AND h < 16 THEN 'London' WHEN h >= 13 AND h < 21 THEN 'NY' ELSE 'Off-hours' END AS audit FROM s""")
def ind_23(spark, sf):
    t = I.ticks(spark, sf)
    ts, h = F.col("ts"), F.hour("ts")
    return t.select(F.col("id").alias("event_id"), S.window_session(ts).alias("session"), F.round(S.session_pos(ts), 6).alias("session_pos"),
                    *(c.alias(n) for n, c in S.overlap_flags(h).items()), S.named_session(h).alias("named"), S.guard_session(h).alias("guard"),
                    S.audit_session(h).alias("audit"))


