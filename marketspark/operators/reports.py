"""Trade, signal and catalogue reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions import rolling as R
from marketspark.functions.rolling import div
from marketspark.functions.sessions import audit_session
from marketspark.operators.joins import join_expected
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.scan import running
from marketspark.operators.series import blocked
from marketspark.session import materialize

KEYS = ("symbol", "timeframe")


def confidence_bucket(c: Column) -> Column:
    """Right-closed bins with edges 0, .4, .5, .6, 1."""
    return (F.when((c > 0) & (c <= 0.4), "Low").when((c > 0.4) & (c <= 0.5), "Medium").when((c > 0.5) & (c <= 0.6), "High")
            .when((c > 0.6) & (c <= 1.0), "Very High"))


def loss_breakdown(trades: DataFrame) -> DataFrame:
    """Losing trades by symbol, timeframe, direction, exit reason and confidence bucket.

    Trades fold over all five dimensions first; only those few rows are spread over dimensions.
    """
    dims = ["symbol", "timeframe", "direction", "exit_reason", "confidence_bucket"]
    f = (trades.where(F.col("pnl") < 0).withColumn("confidence_bucket", confidence_bucket(F.col("confidence"))).groupBy(*dims)
         .agg(F.count(F.lit(1)).alias("n"), F.sum("pnl").alias("s"), F.sum("confidence").alias("c")))
    long = f.select("n", "s", "c", F.inline(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims))))
    return long.where(F.col("value").isNotNull()).groupBy("dimension", "value").agg(
        F.sum("n").alias("pnl_count"), F.sum("s").alias("pnl_sum"), (F.sum("s") / F.sum("n")).alias("pnl_mean"), (F.sum("c") / F.sum("n")).alias("confidence_mean"))


def worst_combos(trades: DataFrame, limit: int = 10) -> DataFrame:
    """Symbol, timeframe and direction combinations that lost most."""
    combo = F.concat_ws("_", "symbol", "timeframe", "direction")
    g = trades.where(F.col("pnl") < 0).groupBy(combo.alias("combo")).agg(
        F.count(F.lit(1)).alias("pnl_count"), F.sum("pnl").alias("pnl_sum"), F.avg("pnl").alias("pnl_mean"), F.avg("confidence").alias("confidence_mean"))
    return g.orderBy("pnl_sum", "combo").limit(limit)


def winner_loser_compare(trades: DataFrame) -> DataFrame:
    side = F.when(F.col("pnl") > 0, "Winners").when(F.col("pnl") < 0, "Losers")
    return trades.withColumn("side", side).where("side IS NOT NULL").groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.avg("bars_held").alias("avg_bars_held"), F.avg("pnl").alias("avg_pnl"))


def _sides(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: counts and mean confidence of winners and losers, in total, per direction and stopped out."""
    w, lo = F.col("pnl") > 0, F.col("pnl") < 0
    d = F.col("direction")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.count_if(w).alias("winners"), F.count_if(lo).alias("losers"), F.avg(F.when(lo, F.col("pnl"))).alias("loss_mean"),
        F.avg(F.when(lo, F.col("confidence"))).alias("loser_conf"), F.avg(F.when(w, F.col("confidence"))).alias("winner_conf"),
        F.count_if(lo & (d == "long")).alias("long_losses"), F.count_if(lo & (d == "short")).alias("short_losses"), F.count_if(w & (d == "long")).alias("long_wins"),
        F.count_if(w & (d == "short")).alias("short_wins"), F.count_if(lo & (F.col("exit_reason") == "sl")).alias("stopped"))


def loss_recommendations(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    c = F.col
    df = _sides(trades, keys)
    return df.withColumn("recommendations", F.array_compact(F.array(
        F.when(c("loser_conf") < 0.45, "raise minimum confidence"), F.when((c("losers") > 5) & (c("loss_mean") < -50), "exclude or retrain"),
        F.when(c("long_losses") > c("short_losses") * 2, "long bias").when(c("short_losses") > c("long_losses") * 2, "short bias"))))


def error_patterns(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Losers as sure as winners, a side that mostly loses, most losses by stop."""
    c = F.col
    df = _sides(trades, keys).withColumn("live_win_rate", c("winners") / c("trades"))
    return df.withColumn("adjustments", F.array_compact(F.array(
        F.when((c("losers") > 0) & (c("loser_conf") > F.coalesce(c("winner_conf"), F.lit(0.0)) - 0.05), "confidence_threshold"),
        F.when(c("long_losses") > c("long_wins") * 1.5, "long_bias"), F.when(c("short_losses") > c("short_wins") * 1.5, "short_bias"),
        F.when(c("stopped") > c("losers") * 0.7, "stop_loss")))).withColumn("new_min_conf", F.coalesce(c("winner_conf"), F.lit(0.0)) + 0.05)


def session_problems(trades: DataFrame, hours: int = 4, now: Column | None = None, min_losers: int = 3, min_trades: int = 5) -> DataFrame:
    """Weak series, overconfident losers and weak sides among trades that closed in the last hours."""
    now = trades.agg(F.max("exit_time")).scalar() if now is None else now
    t = trades.where(F.col("exit_time") >= now - F.make_dt_interval(hours=F.lit(hours)))
    win, n = F.col("exit_reason") == "tp", F.count(F.lit(1))
    g = t.groupBy("symbol", "timeframe").agg(
        n.alias("trades"), F.count_if(win).alias("wins"), F.count_if(F.col("exit_reason") == "sl").alias("losses"), F.sum("pnl").alias("total_pnl"),
        F.count_if((F.col("exit_reason") == "sl") & (F.col("confidence") > 0.5)).alias("overconfident"), F.count_if(F.col("direction") == "long").alias("_ln"),
        F.count_if(win & (F.col("direction") == "long")).alias("_lw"), F.count_if(F.col("direction") == "short").alias("_sn"), F.count_if(win & (F.col("direction") == "short")).alias("_sw"))
    wr = F.col("wins") * 100.0 / F.col("trades")
    weak = lambda w, k, name: F.when((F.col("trades") >= 3) & (F.col(k) > 0) & (F.col(w) * 100.0 / F.col(k) < 35), name)
    return g.withColumn("win_rate", wr).withColumn("problems", F.array_compact(F.array(
        F.when((F.col("trades") >= 2) & (wr < 40), "low_win_rate"), F.when(F.col("overconfident") > 0, "overconfident"), weak("_lw", "_ln", "long_weak"), weak("_sw", "_sn", "short_weak"))
    )).withColumn("should_retrain", (F.col("losses") >= min_losers) & (F.col("trades") >= min_trades)).drop("_ln", "_lw", "_sn", "_sw")


def signal_audit(signals: DataFrame, ts: str = "bar_ts", keys: Sequence[str] = KEYS, order: Sequence[str] | None = None) -> DataFrame:
    """Closed signals per series: best and worst session and confidence quartile, drift of the last fifth, advice."""
    k, order = list(keys), list(order or (ts,))
    signals = materialize(signals)
    cut = exact_quantiles(signals, k, "confidence", {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    c = F.col("confidence")
    s = signals.join(cut, k).withColumns({
        "win": F.col("pnl") > 0, "session": audit_session(F.hour(ts)),
        "quartile": F.when(c <= F.col("_q1"), 1).when(c <= F.col("_q2"), 2).when(c <= F.col("_q3"), 3).otherwise(4)})
    s = running(s, k, order, counts={"_n": F.lit(True)})
    total = s.groupBy(*k).agg(F.count(F.lit(1)).alias("closed"))
    # three aggregates read the tagged signals, so they are computed once
    s = materialize(s.join(total, k).withColumn("_recent", F.col("_n") > F.floor(F.col("closed") * 0.8)))
    n, w, p = F.count(F.lit(1)), F.count_if("win"), F.col("pnl")
    base = s.groupBy(*k).agg(n.alias("closed"), w.alias("wins"), F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("_g"), F.abs(F.sum(F.when(p <= 0, p))).alias("_l"),
                             (F.count_if(F.col("win") & F.col("_recent")) * 100.0 / F.count_if("_recent")).alias("recent_win_rate"))
    wr = w * 100.0 / n

    def extremes(by: str, payload: list[Column], name: str) -> DataFrame:
        g = s.groupBy(*k, by).agg(wr.alias("_wr"), *payload)
        row = F.struct(by, *(x for x in g.columns if x not in (*k, by, "_wr")))
        # ties go to the first value in order
        return g.groupBy(*k).agg(F.min_by(row, F.struct(-F.col("_wr"), F.col(by))).alias(f"best_{name}"), F.min_by(row, F.struct(F.col("_wr"), F.col(by))).alias(f"worst_{name}"))
    ses = extremes("session", [], "s")
    qua = extremes("quartile", [F.min("confidence").alias("lo"), F.max("confidence").alias("hi")], "q")
    df = base.join(ses, k).join(qua, k).withColumn("win_rate", F.col("wins") * 100.0 / F.col("closed"))
    pf, drift = F.coalesce(div("_g", "_l"), F.lit(0.0)), F.abs(F.col("recent_win_rate") - F.col("win_rate"))
    df = df.withColumns({"profit_factor": pf, "drift_severity": drift, "drift_detected": drift > 10})
    x = F.col
    return df.select(
        *k, "closed", "wins", "win_rate", "profit_factor", x("best_s.session").alias("best_session"), x("worst_s.session").alias("worst_session"),
        x("best_q.quartile").alias("best_quartile"), x("best_q.lo").alias("suggested_min_conf"), x("best_q.hi").alias("best_conf_high"), x("worst_q.quartile").alias("worst_quartile"),
        "recent_win_rate", "drift_severity", "drift_detected",
        (x("drift_detected") | (x("win_rate") < 45) | (x("profit_factor") < 1.2) | (x("closed") > 100)).alias("should_retrain"),
        F.when((x("profit_factor") > 2) & (x("win_rate") > 60), 0.5).when((x("profit_factor") > 1.5) & (x("win_rate") > 50), 0.3).otherwise(0.2).alias("suggested_pos_size"))


def performance_vs_expected(live: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Live against expected return and win rate."""
    df = join_expected(live, catalogue)
    exp_ret, exp_wr = F.coalesce("expected_total_return_pct", F.lit(0.0)), F.coalesce("expected_win_rate", F.lit(50.0))
    df = df.withColumn("performance_ratio", F.when(exp_ret > 0, F.col("total_return_pct") / exp_ret).otherwise(0.0))
    r, wr = F.col("performance_ratio"), F.col("win_rate")
    return df.withColumn("status", F.when((r >= 0.8) & (wr >= exp_wr * 0.9), "excellent").when((r >= 0.6) & (wr >= exp_wr * 0.8), "good")
                         .when(r >= 0.4, "marginal").otherwise("degraded"))


def rolling_drift(trades: DataFrame, n: int = 20, warn: float = 1.1, halt: float = 0.9, keys: Sequence[str] = KEYS, order: Sequence[str] = ("exit_time", "trade_id")) -> DataFrame:
    """Profit factor and win rate of the last ``n`` trades at every trade."""
    p = F.col("pnl")
    s = blocked(trades, back=n, keys=keys, order=order)
    s = s.add(_g=F.when(p > 0, p).otherwise(0.0), _l=F.when(p <= 0, -p).otherwise(0.0), _w=R.flag(p > 0))
    s = s.add(rolling_pf=F.when(s.index >= n - 1, F.coalesce(div(R.total(s, "_g", n), R.total(s, "_l", n)), F.lit(0.0))), rolling_wr=R.mean(s, "_w", n) * 100)
    pf = F.col("rolling_pf")
    return s.add(status=F.when(pf.isNull(), "insufficient_data").when(pf < halt, "halt").when(pf < warn, "warning").otherwise("healthy")).rows()


def signal_health(signals: DataFrame, hours: int = 6, stale_minutes: int = 10, min_conf: float = 0.40, min_edge: float = 0.02, now: Column | None = None) -> DataFrame:
    """Signals of the last hours per series with staleness and weakness flags."""
    now = signals.agg(F.max("bar_ts")).scalar() if now is None else now
    g = (signals.where(F.col("bar_ts") >= now - F.make_dt_interval(hours=F.lit(hours))).groupBy(*KEYS)
         .agg(F.count(F.lit(1)).alias("rows"), F.avg("confidence").alias("avg_confidence"), F.avg("edge").alias("avg_edge"), F.max("bar_ts").alias("last_ts")))
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))) / 60.0
    return g.withColumn("stale_minutes", age).withColumns({"is_stale": age > stale_minutes, "low_confidence": F.col("avg_confidence") < min_conf, "low_edge": F.col("avg_edge") < min_edge})


def catalogue_summary(catalogue: DataFrame) -> DataFrame:
    """Models and mean results per symbol, per timeframe and in total; each model folds into three rows."""
    levels = F.array(F.struct(F.lit("symbol").alias("level"), F.col("symbol").alias("name")), F.struct(F.lit("timeframe").alias("level"), F.col("timeframe").alias("name")),
                     F.struct(F.lit("all").alias("level"), F.lit("all").alias("name")))
    return catalogue.select("*", F.inline(levels)).groupBy("level", "name").agg(
        F.count(F.lit(1)).alias("models"), *(F.avg(c).alias(f"avg_{c}") for c in ("win_rate", "profit_factor", "sharpe_ratio", "max_drawdown_pct")))


def model_status(catalogue: DataFrame) -> DataFrame:
    ret, wr, pf = F.col("total_return_pct"), F.col("win_rate"), F.col("profit_factor")
    return catalogue.withColumn("tier", F.when((ret > 50) & (wr > 60) & (pf > 2.0), "excellent").when((ret > 20) & (wr > 50) & (pf > 1.5), "good")
                                .when((ret > 10) & (wr > 45) & (pf > 1.3), "fair").otherwise("poor"))


def cumulative_performance(trades: DataFrame, n: int = 20, keys: Sequence[str] = KEYS, order: Sequence[str] = ("exit_time", "trade_id")) -> DataFrame:
    """Running profit and win rate of the last ``n`` trades (fewer at the start)."""
    t = running(trades, keys, order, sums={"cumulative_pnl": F.col("pnl")})
    s = blocked(t, back=n, keys=keys, order=order)
    s = s.add(_w=R.flag(F.col("pnl") > 0))
    return s.add(rolling_win_rate=R.mean(s, "_w", n, min_rows=1) * 100).rows()


def win_rate_by(trades: DataFrame, key: str) -> DataFrame:
    return trades.groupBy(key).agg(F.count(F.lit(1)).alias("trades"), (F.count_if(F.col("pnl") > 0) * 100.0 / F.count(F.lit(1))).alias("win_rate"))


def recent_trades(trades: DataFrame, limit: int = 50) -> DataFrame:
    return trades.orderBy(F.col("exit_time").desc(), F.col("trade_id").desc()).limit(limit)


def active_signals(outcomes: DataFrame) -> DataFrame:
    return outcomes.where(F.col("status") == "open")


def retrain_due(trades: DataFrame, hours: int = 24, need: int = 10, keys: Sequence[str] = KEYS) -> DataFrame:
    """Series with enough trades closed in the last hours before their own newest trade."""
    last = trades.groupBy(*keys).agg(F.max("exit_time").alias("_last"))
    t = trades.join(last, list(keys)).where(F.col("exit_time") >= F.col("_last") - F.make_dt_interval(hours=F.lit(hours)))
    return t.groupBy(*keys).agg(F.count(F.lit(1)).alias("closed")).withColumn("due", F.col("closed") >= need)


def config_comparison(yearly: DataFrame) -> DataFrame:
    """Configurations by mean yearly return, with extremes, years that beat the index and worst drawdown."""
    g = yearly.groupBy("config").agg(
        F.avg("total_return_pct").alias("avg_return"), F.min("total_return_pct").alias("min_return"), F.max("total_return_pct").alias("max_return"),
        F.max("max_drawdown_pct").alias("max_drawdown"), F.count_if("beat_index").alias("years_beat"), F.count(F.lit(1)).alias("years"), F.sum("total_trades").alias("total_trades"))
    # one row per configuration: the global ranking is over a handful of rows
    return g.withColumn("rank", F.rank().over(Window.orderBy(F.col("avg_return").desc())))

