"""Reports and sentiment."""

from pyspark.sql import functions as F

from marketspark.operators import metrics as M
from marketspark.operators import reports as RP
from marketspark.operators import sentiment as ST
from marketspark.operators.joins import signals_to_outcome
from marketspark.plans import inputs as I
from marketspark.plans import q_trades as QT
from marketspark.plans import sqlkit as q
from marketspark.plans.q_trades import OLDNEW, SIG, TR1, old_new, rnd, sql_metrics
from marketspark.plans.registry import ORACLES, query
from marketspark.sources import dims

T = I.SQL_TRADES
R4 = lambda x: q.r6(x, 4)


@query("rp_1_loss_breakdown", f"""WITH {T}, l AS (SELECT *, CASE WHEN confidence <= 0.4 THEN 'Low' WHEN confidence <= 0.5 THEN 'Medium' WHEN confidence <= 0.6 THEN 'High' ELSE 'Very High' END AS cb FROM trades WHERE pnl < 0)
{' UNION ALL '.join(f"SELECT '{n}' AS dimension, {c} AS value, count(*) AS pnl_count, {R4('sum(pnl)')} AS pnl_sum, {R4('avg(pnl)')} AS pnl_mean, {R4('avg(confidence)')} AS confidence_mean FROM l GROUP BY {c}"
                    for n, c in (('symbol', 'symbol'), ('timeframe', 'timeframe'), ('direction', 'direction'), ('exit_reason', 'exit_reason'), ('confidence_bucket', 'cb')))}""")
def rp_1(spark, sf):
    return rnd(RP.loss_breakdown(I.trades(spark, sf)), "dimension", "value", "pnl_count", n=4, d="pnl_sum pnl_mean confidence_mean")


@query("rp_2_worst_combos", f"""WITH {T} SELECT symbol || '_' || timeframe || '_' || direction AS combo, count(*) AS pnl_count, {R4('sum(pnl)')} AS pnl_sum, {R4('avg(pnl)')} AS pnl_mean, {R4('avg(confidence)')} AS confidence_mean
 FROM trades WHERE pnl < 0 GROUP BY 1 ORDER BY sum(pnl), 1 LIMIT 10""")
def rp_2(spark, sf):
    return rnd(RP.worst_combos(I.trades(spark, sf)), "combo", "pnl_count", n=4, d="pnl_sum pnl_mean confidence_mean")


@query("rp_3_winner_loser_compare", f"""WITH {T} SELECT CASE WHEN pnl > 0 THEN 'Winners' ELSE 'Losers' END AS side, count(*) AS n, {R4('avg(confidence)')} AS avg_confidence, {R4('avg(bars_held)')} AS avg_bars_held, {R4('avg(pnl)')} AS avg_pnl FROM trades WHERE pnl <> 0 GROUP BY 1""")
def rp_3(spark, sf):
    return rnd(RP.winner_loser_compare(I.trades(spark, sf)), "side", "n", n=4, d="avg_confidence avg_bars_held avg_pnl")


SIDES = """sd AS (SELECT symbol, count(*) AS trades, count(*) FILTER (pnl > 0) AS winners, count(*) FILTER (pnl < 0) AS losers, avg(pnl) FILTER (pnl < 0) AS lm, avg(confidence) FILTER (pnl < 0) AS lc, avg(confidence) FILTER (pnl > 0) AS wc,
 count(*) FILTER (pnl < 0 AND direction = 'long') AS ll, count(*) FILTER (pnl < 0 AND direction = 'short') AS sl, count(*) FILTER (pnl > 0 AND direction = 'long') AS lw, count(*) FILTER (pnl > 0 AND direction = 'short') AS sw,
 count(*) FILTER (pnl < 0 AND exit_reason = 'sl') AS st FROM trades GROUP BY symbol)"""


@query("rp_4_loss_recommendations", f"""WITH {T}, {SIDES} SELECT symbol, losers, array_to_string(list_filter([CASE WHEN lc < 0.45 THEN 'raise minimum confidence' END, CASE WHEN losers > 5 AND lm < -50 THEN 'exclude or retrain' END,
 CASE WHEN ll > sl * 2 THEN 'long bias' WHEN sl > ll * 2 THEN 'short bias' END], lambda x: x IS NOT NULL), ';') AS recommendations FROM sd""")
def rp_4(spark, sf):
    return RP.loss_recommendations(I.trades(spark, sf)).select("symbol", "losers", F.concat_ws(";", "recommendations").alias("recommendations"))


@query("rp_4_error_patterns", f"""WITH {T}, {SIDES} SELECT symbol, {R4('winners / trades')} AS live_win_rate, {R4('coalesce(wc, 0) + 0.05')} AS new_min_conf, array_to_string(list_filter([CASE WHEN losers > 0 AND lc > coalesce(wc, 0) - 0.05 THEN 'confidence_threshold' END,
 CASE WHEN ll > lw * 1.5 THEN 'long_bias' END, CASE WHEN sl > sw * 1.5 THEN 'short_bias' END, CASE WHEN st > losers * 0.7 THEN 'stop_loss' END], lambda x: x IS NOT NULL), ';') AS adjustments FROM sd""")
def rp_4e(spark, sf):
    df = RP.error_patterns(I.trades(spark, sf)).withColumn("adjustments", F.concat_ws(";", "adjustments"))
    return rnd(df, "symbol", "adjustments", n=4, d="live_win_rate new_min_conf")


@query("rp_5_session_problems", f"""WITH {T}, r AS (SELECT * FROM trades WHERE exit_time >= (SELECT max(exit_time) FROM trades) - INTERVAL 240 HOUR), g AS (SELECT symbol, timeframe, count(*) AS trades, count(*) FILTER (exit_reason = 'tp') AS wins,
 count(*) FILTER (exit_reason = 'sl') AS losses, sum(pnl) AS tp, count(*) FILTER (exit_reason = 'sl' AND confidence > 0.5) AS overconfident, count(*) FILTER (direction = 'long') AS ln, count(*) FILTER (direction = 'long' AND exit_reason = 'tp') AS lw,
 count(*) FILTER (direction = 'short') AS sn, count(*) FILTER (direction = 'short' AND exit_reason = 'tp') AS sw FROM r GROUP BY symbol, timeframe)
SELECT symbol, timeframe, trades, wins, losses, overconfident, {R4('tp')} AS total_pnl, {R4('wins * 100.0 / trades')} AS win_rate, losses >= 3 AND trades >= 5 AS should_retrain, array_to_string(list_filter([
 CASE WHEN trades >= 2 AND wins * 100.0 / trades < 40 THEN 'low_win_rate' END, CASE WHEN overconfident > 0 THEN 'overconfident' END, CASE WHEN trades >= 3 AND ln > 0 AND lw * 100.0 / ln < 35 THEN 'long_weak' END,
 CASE WHEN trades >= 3 AND sn > 0 AND sw * 100.0 / sn < 35 THEN 'short_weak' END], lambda x: x IS NOT NULL), ';') AS problems FROM g""")
def rp_5(spark, sf):
    df = RP.session_problems(I.trades(spark, sf), hours=240).withColumn("problems", F.concat_ws(";", "problems"))
    return rnd(df, "symbol", "timeframe", "trades", "wins", "losses", "overconfident", "should_retrain", "problems", n=4, d="total_pnl win_rate")


@query("rp_6_signal_audit", f"""WITH {TR1}, qq AS (SELECT symbol, model, quantile_cont(confidence, 0.25) AS q1, quantile_cont(confidence, 0.5) AS q2, quantile_cont(confidence, 0.75) AS q3 FROM btr GROUP BY symbol, model),
s AS (SELECT btr.*, pnl > 0 AS win, CASE WHEN hour(bar_ts) >= 22 OR hour(bar_ts) < 2 THEN 'Asian' WHEN hour(bar_ts) >= 7 AND hour(bar_ts) < 16 THEN 'London' WHEN hour(bar_ts) >= 13 AND hour(bar_ts) < 21 THEN 'NY' ELSE 'Off-hours' END AS session,
 CASE WHEN confidence <= q1 THEN 1 WHEN confidence <= q2 THEN 2 WHEN confidence <= q3 THEN 3 ELSE 4 END AS qt, row_number() OVER (PARTITION BY symbol, model ORDER BY bar_ts) AS n, count(*) OVER (PARTITION BY symbol, model) AS tot FROM btr JOIN qq USING (symbol, model)),
b AS (SELECT symbol, model, count(*) AS closed, count(*) FILTER (win) AS wins, coalesce(coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(abs(sum(pnl) FILTER (pnl <= 0)), 0), 0) AS pf,
 count(*) FILTER (win AND n > floor(tot * 0.8)) * 100.0 / count(*) FILTER (n > floor(tot * 0.8)) AS rw FROM s GROUP BY symbol, model),
ss AS (SELECT symbol, model, session, count(*) FILTER (win) * 100.0 / count(*) AS w FROM s GROUP BY ALL), s1 AS (SELECT symbol, model, first(session ORDER BY w DESC, session) AS best_session, first(session ORDER BY w, session) AS worst_session FROM ss GROUP BY symbol, model),
qs AS (SELECT symbol, model, qt, count(*) FILTER (win) * 100.0 / count(*) AS w, min(confidence) AS lo, max(confidence) AS hi FROM s GROUP BY symbol, model, qt), q2 AS (SELECT symbol, model, first(qt ORDER BY w DESC, qt) AS best_quartile, first(lo ORDER BY w DESC, qt) AS lo,
 first(hi ORDER BY w DESC, qt) AS hi, first(qt ORDER BY w, qt) AS worst_quartile FROM qs GROUP BY symbol, model), z AS (SELECT *, wins * 100.0 / closed AS wr FROM b JOIN s1 USING (symbol, model) JOIN q2 USING (symbol, model))
SELECT symbol, model, closed, wins, best_session, worst_session, best_quartile, worst_quartile, {R4('wr')} AS win_rate, {R4('pf')} AS profit_factor, {R4('lo')} AS suggested_min_conf, {R4('rw')} AS recent_win_rate, {R4('abs(rw - wr)')} AS drift_severity,
 abs(rw - wr) > 10 AS drift_detected, abs(rw - wr) > 10 OR wr < 45 OR pf < 1.2 OR closed > 100 AS should_retrain, CASE WHEN pf > 2 AND wr > 60 THEN 0.5 WHEN pf > 1.5 AND wr > 50 THEN 0.3 ELSE 0.2 END::DOUBLE AS suggested_pos_size FROM z""")
def rp_6(spark, sf):
    df = RP.signal_audit(QT.signal_trades(spark, sf), keys=("symbol", "model"))
    return rnd(df, "symbol", "model", "closed", "wins", "best_session", "worst_session", "best_quartile", "worst_quartile", "drift_detected", "should_retrain", "suggested_pos_size", n=4,
               d="win_rate profit_factor suggested_min_conf recent_win_rate drift_severity")


@query("rp_7_performance_vs_expected", f"""WITH {T}, {OLDNEW}, j AS (SELECT n.symbol, n.timeframe, n.win_rate AS w, o.win_rate AS ew, CASE WHEN o.total_return_pct > 0 THEN n.total_return_pct / o.total_return_pct ELSE 0 END AS r FROM n LEFT JOIN o USING (symbol, timeframe))
SELECT symbol, timeframe, {R4('r')} AS performance_ratio, CASE WHEN r >= 0.8 AND w >= ew * 0.9 THEN 'excellent' WHEN r >= 0.6 AND w >= ew * 0.8 THEN 'good' WHEN r >= 0.4 THEN 'marginal' ELSE 'degraded' END AS status FROM j""")
def rp_7(spark, sf):
    old, new = old_new(spark, sf)
    return rnd(RP.performance_vs_expected(new, old), "symbol", "timeframe", "status", n=4, d="performance_ratio")


W20 = "OVER (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@query("rp_8_rolling_drift", f"""WITH {T}, d AS (SELECT trade_id, CASE WHEN count(*) {W20} = 20 THEN coalesce(sum(greatest(pnl, 0)) {W20} / nullif(sum(greatest(-pnl, 0)) {W20}, 0), 0) END AS pf, CASE WHEN count(*) {W20} = 20 THEN avg((pnl > 0)::INT) {W20} * 100 END AS wr FROM trades)
SELECT trade_id, {q.r6('pf')} AS rolling_pf, {q.r6('wr')} AS rolling_wr, CASE WHEN pf IS NULL THEN 'insufficient_data' WHEN pf < 0.9 THEN 'halt' WHEN pf < 1.1 THEN 'warning' ELSE 'healthy' END AS status FROM d""")
def rp_8(spark, sf):
    return rnd(RP.rolling_drift(I.trades(spark, sf)), "trade_id", "status", d="rolling_pf rolling_wr")


@query("rp_9_signal_health", f"""WITH {SIG}, n AS (SELECT max(bar_ts) AS now FROM sig), g AS (SELECT symbol, timeframe, count(*) AS rows, avg(confidence) AS c, avg(edge) AS e, max(bar_ts) AS last_ts, any_value(now) AS now FROM sig, n WHERE bar_ts >= now - INTERVAL 6 HOUR GROUP BY symbol, timeframe)
SELECT symbol, timeframe, rows, last_ts, {q.r6('c')} AS avg_confidence, {q.r6('e')} AS avg_edge, {q.r6('(epoch(now) - epoch(last_ts)) / 60')} AS stale_minutes, (epoch(now) - epoch(last_ts)) / 60 > 10 AS is_stale, c < 0.4 AS low_confidence, e < 0.02 AS low_edge FROM g""")
def rp_9(spark, sf):
    return rnd(RP.signal_health(QT.signals(spark, sf)), "symbol", "timeframe", "rows", "last_ts", "is_stale", "low_confidence", "low_edge", d="avg_confidence avg_edge stale_minutes")


@query("rp_10_catalogue_summary", f"""WITH {T}, m AS (SELECT * FROM {sql_metrics('trades')}), u AS (SELECT 'symbol' AS level, symbol AS name, * FROM m UNION ALL SELECT 'timeframe', timeframe, * FROM m UNION ALL SELECT 'all', 'all', * FROM m)
SELECT level, name, count(*) AS models, {R4('avg(win_rate)')} AS avg_win_rate, {R4('avg(profit_factor)')} AS avg_profit_factor, {R4('avg(sharpe_ratio)')} AS avg_sharpe_ratio, {R4('avg(max_drawdown_pct)')} AS avg_max_drawdown_pct FROM u GROUP BY level, name""")
def rp_10(spark, sf):
    return rnd(RP.catalogue_summary(M.trade_metrics(I.trades(spark, sf))), "level", "name", "models", n=4, d="avg_win_rate avg_profit_factor avg_sharpe_ratio avg_max_drawdown_pct")


@query("rp_10_model_status", f"""WITH {T} SELECT symbol, timeframe, CASE WHEN total_return_pct > 50 AND win_rate > 60 AND profit_factor > 2 THEN 'excellent' WHEN total_return_pct > 20 AND win_rate > 50 AND profit_factor > 1.5 THEN 'good'
 WHEN total_return_pct > 10 AND win_rate > 45 AND profit_factor > 1.3 THEN 'fair' ELSE 'poor' END AS tier FROM {sql_metrics('trades')}""")
def rp_10s(spark, sf):
    return RP.model_status(M.trade_metrics(I.trades(spark, sf))).select("symbol", "timeframe", "tier")


@query("rp_11_cumulative_performance", f"""WITH {T} SELECT trade_id, {R4('sum(pnl) OVER (PARTITION BY symbol, timeframe ORDER BY exit_time, trade_id ROWS UNBOUNDED PRECEDING)')} AS cumulative_pnl, {R4(f'avg((pnl > 0)::INT) {W20} * 100')} AS rolling_win_rate FROM trades""")
def rp_11(spark, sf):
    return rnd(RP.cumulative_performance(I.trades(spark, sf)), "trade_id", n=4, d="cumulative_pnl rolling_win_rate")


@query("rp_11_win_rate_by_symbol", f"WITH {T} SELECT symbol, count(*) AS trades, {R4('count(*) FILTER (pnl > 0) * 100.0 / count(*)')} AS win_rate FROM trades GROUP BY symbol")
def rp_11w(spark, sf):
    return rnd(RP.win_rate_by(I.trades(spark, sf), "symbol"), "symbol", "trades", n=4, d="win_rate")


@query("rp_12_recent_trades", f"WITH {T} SELECT trade_id, symbol, exit_time, {R4('pnl')} AS pnl FROM trades ORDER BY exit_time DESC, trade_id DESC LIMIT 50")
def rp_12(spark, sf):
    return rnd(RP.recent_trades(I.trades(spark, sf), 50), "trade_id", "symbol", "exit_time", n=4, d="pnl")


@query("rp_12_retrain_due", f"""WITH {T}, l AS (SELECT symbol, timeframe, max(exit_time) AS m FROM trades GROUP BY ALL) SELECT symbol, timeframe, count(*) AS closed, count(*) >= 10 AS due FROM trades JOIN l USING (symbol, timeframe) WHERE exit_time >= m - INTERVAL 96 HOUR GROUP BY symbol, timeframe""")
def rp_12r(spark, sf):
    return RP.retrain_due(I.trades(spark, sf), hours=96)


@query("rp_12_active_signals", f"SELECT symbol, bar_ts, direction, status FROM ({ORACLES['jn_9_signals_to_outcome']}) WHERE status = 'open'")
def rp_12a(spark, sf):
    e = QT.entries(spark, sf).withColumn("expires_at", F.col("bar_ts") + F.expr("INTERVAL 48 HOURS"))
    return RP.active_signals(signals_to_outcome(e, I.bars(spark, sf))).select("symbol", "bar_ts", "direction", "status")


@query("rp_14_config_comparison", f"""WITH {T}, {QT.values('idx', 'year, index_return', list(QT.YEARS.items()))}, ty AS (SELECT *, year(exit_time) AS year, substr('ABCD', CAST(trade_id % 4 AS INTEGER) + 1, 1) AS config FROM trades),
y AS (SELECT m.*, total_return_pct > coalesce(index_return, 0.15) * 100 AS bi FROM {sql_metrics('ty', 'config, year')} m LEFT JOIN idx USING (year)),
g AS (SELECT config, avg(total_return_pct) AS a, min(total_return_pct) AS mi, max(total_return_pct) AS ma, max(max_drawdown_pct) AS dd, count(*) FILTER (bi) AS years_beat, count(*) AS years, CAST(sum(total_trades) AS BIGINT) AS total_trades FROM y GROUP BY config)
SELECT config, {R4('a')} AS avg_return, {R4('mi')} AS min_return, {R4('ma')} AS max_return, {R4('dd')} AS max_drawdown, years_beat, years, total_trades, CAST(rank() OVER (ORDER BY a DESC) AS INTEGER) AS rank FROM g""")
def rp_14(spark, sf):
    t = I.trades(spark, sf).withColumn("config", F.substring(F.lit("ABCD"), (F.col("trade_id") % 4).cast("int") + 1, F.lit(1)))
    return rnd(RP.config_comparison(M.yearly_report(t, dims.index_returns(spark, QT.YEARS), keys=("config",))), "config", "years_beat", "years", "total_trades", "rank", n=4,
               d="avg_return min_return max_return max_drawdown")


#: words that occur in the given texts stand in for names and opinions
WORDS = {"S0": ("the", "thr"), "S1": ("worthless", "rally"), "S2": ("eur", "tion"), "S3": ("qui", "mente")}
SCORES = {**ST.LEXICON, "with": 1.0, "that": 0.5, "was": -1.0, "from": -0.5, "des": 1.0, "qui": -0.5}


@query("rp_13_sentiment_by_symbol", f"""WITH k AS (SELECT doc_id, lower(text) AS t, CASE WHEN doc_id % 3 = 0 THEN 'social' ELSE 'news' END AS kind FROM documents),
h AS (SELECT *, list_filter(list_transform(string_split_regex(t, '[^a-z]+'), lambda w: CASE w {' '.join(f"WHEN '{w}' THEN {v}::DOUBLE" for w, v in SCORES.items())} END), lambda v: v IS NOT NULL) AS hits FROM k),
p AS (SELECT *, coalesce(list_sum(hits) / nullif(len(hits), 0), 0) AS p FROM h), s AS ({' UNION ALL '.join(f"SELECT '{s}' AS symbol, kind, p FROM p WHERE p <> 0 AND (" + ' OR '.join(f"contains(t, '{w}')" for w in ws) + ')' for s, ws in WORDS.items())}),
g AS (SELECT symbol, count(*) FILTER (kind = 'news') AS news_count, count(*) FILTER (kind = 'social') AS social_count, coalesce(avg(p) FILTER (kind = 'news'), 0) AS n, coalesce(avg(p) FILTER (kind = 'social'), 0) AS o FROM s GROUP BY symbol),
z AS (SELECT *, (n * news_count * 0.6 + o * social_count * 0.4) / (news_count * 0.6 + social_count * 0.4) AS a FROM g)
SELECT symbol, news_count, social_count, {q.r6('n')} AS news_sentiment, {q.r6('o')} AS social_sentiment, {q.r6('a')} AS aggregate_sentiment, CASE WHEN a > 0.2 THEN 'bullish' WHEN a < -0.2 THEN 'bearish' ELSE 'neutral' END AS interpretation FROM z""")
def rp_13(spark, sf):
    kind = F.when(F.col("doc_id") % 3 == 0, "social").otherwise("news")
    df = ST.sentiment_by_symbol(I.table(spark, sf, "documents"), kind, WORDS, SCORES)
    return rnd(df, "symbol", "news_count", "social_count", "interpretation", d="news_sentiment social_sentiment aggregate_sentiment")
