"""Live guardrails, signal filters, benchmark gates and deployment decisions.

Each check is a column that is null when passed and a short reason when not; a gate is the array
of reasons left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.sessions import guard_session


def reasons(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def why(bad: Column, text: str) -> Column:
    """``text`` when the check fails; unknown counts as failed."""
    return F.when(F.coalesce(bad, F.lit(True)), F.lit(text))


@dataclass(frozen=True)
class Guardrails:
    """Limits of one preset."""
    max_spread_atr: float
    max_age_seconds: int
    min_confidence: float
    max_latency_ms: float
    blocked_sessions: tuple[str, ...]
    min_atr_pct: float
    max_atr_pct: float


#: fixed values: limits per preset
PRESETS = {
    "conservative": Guardrails(0.10, 180, 0.65, 200, ("asia", "overnight"), 0.005, 0.04),
    "moderate": Guardrails(0.15, 300, 0.55, 250, ("overnight",), 0.003, 0.05),
    "aggressive": Guardrails(0.20, 600, 0.50, 500, (), 0.002, 0.08),
}


def guardrails(df: DataFrame, g: Guardrails, now: Column, tf_minutes: Column) -> DataFrame:
    """Checks on staleness, spread, volatility, session, confidence and latency; ``passed`` and ``failures``."""
    sec = lambda c: F.unix_timestamp(c.cast("timestamp"))
    age = sec(now) - sec(F.col("bar_ts"))
    rest = (F.weekday(now) >= 5) | ((F.weekday(now) == 0) & (F.hour(now) < 2))
    max_age = F.when(rest, 72 * 3600).otherwise(F.greatest(F.lit(1800), tf_minutes * 120 + g.max_age_seconds))
    ratio = F.try_divide(F.col("spread"), F.col("atr"))
    atr_pct = F.try_divide(F.col("atr"), F.col("price"))
    hour, day = F.hour("bar_ts"), F.weekday("bar_ts")
    checks = [why(age > max_age, "staleness"), why(ratio > g.max_spread_atr, "spread"),
              why((atr_pct < g.min_atr_pct) | (atr_pct > g.max_atr_pct), "volatility"),
              why(guard_session(hour).isin(*g.blocked_sessions) if g.blocked_sessions else F.lit(False), "session"),
              why(day >= 5, "weekend"), why(F.col("confidence") < g.min_confidence, "confidence")]
    if "latency_ms" in df.columns:
        checks.append(F.when(F.col("latency_ms") > g.max_latency_ms, "latency"))
    df = df.withColumns({"age_seconds": age, "failures": reasons(*checks)})
    return df.withColumn("passed", F.size("failures") == 0)


def post_filters(df: DataFrame, cooldown: int = 5, spread_atr: float = 0.5, min_conf: float = 0.40) -> DataFrame:
    """Cooldown, spread and confidence turn a signal into HOLD; the original and the reasons are kept."""
    cool = F.when(F.col("bars_since_trade") < cooldown, "cooldown")
    wide = F.when(F.col("spread") > F.col("atr") * spread_atr, "spread")
    weak = F.when((F.col("confidence") < min_conf) & (F.col("signal") != "HOLD"), "confidence")
    df = df.withColumns({"original_signal": F.col("signal"), "filter_reasons": reasons(cool, wide, weak)})
    df = df.withColumn("filtered", F.size("filter_reasons") > 0)
    return df.withColumn("signal", F.when(F.col("filtered"), "HOLD").otherwise(F.col("signal")))


def expires_at(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(mins=minutes)


def expired(index: Column, expiry_index: Column) -> Column:
    """A signal without an expiry never expires."""
    return F.coalesce(index > expiry_index, F.lit(False))


#: fixed values: least profit factor, most drawdown %, least Sharpe, least win rate, trades needed per timeframe
BENCHMARK = {"profit_factor": 1.6, "max_drawdown_pct": 6.0, "sharpe_ratio": 1.0, "win_rate": 45.0}
MIN_TRADES = {"5T": 200, "15T": 150, "30T": 100, "1H": 60, "4H": 40}
DEFAULT_MIN_TRADES = 60
#: fixed values: the looser per-trade variant
GO_LIVE = {"profit_factor": 1.6, "max_drawdown_pct": 6.0, "sharpe_ratio": 0.25, "win_rate": 52.0, "total_trades": 200}


def benchmark_check(metrics: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Failed benchmarks, the strict verdict (none failed) and the lenient one (at most one, not PF or DD)."""
    b = limits or BENCHMARK
    need = F.lit(int(b["total_trades"])) if "total_trades" in b else F.coalesce(
        F.create_map(*(F.lit(x) for kv in MIN_TRADES.items() for x in kv))[F.col("timeframe")], F.lit(DEFAULT_MIN_TRADES))
    df = metrics.withColumn("failures", reasons(
        why(F.col("profit_factor") < b["profit_factor"], "PF"), why(F.col("max_drawdown_pct") > b["max_drawdown_pct"], "DD"),
        why(F.col("sharpe_ratio") < b["sharpe_ratio"], "Sharpe"), why(F.col("win_rate") < b["win_rate"], "WR"),
        why(F.col("total_trades") < need, "Trades")))
    critical = F.arrays_overlap("failures", F.array(F.lit("PF"), F.lit("DD")))
    return df.withColumns({"passes_strict": F.size("failures") == 0,
                           "passes_lenient": ~critical & (F.size("failures") <= 1)})


#: fixed values: hard gates for live readiness
HARD = {"min_pf": 1.60, "warn_pf": 1.45, "max_dd": 6.0, "warn_dd": 4.5, "min_sharpe": 0.25, "min_month_pct": 70.0,
        "min_wr": 52.0, "min_expectancy_r": 0.08, "min_trades": 200, "min_per_month": 30}


def hard_gates(m: DataFrame, months: float = 6.0, capital: float = 100000.0) -> DataFrame:
    """Failures, warnings, root causes and ranked fixes from one row of metrics per key.

    Reads ``profit_factor, max_drawdown_pct, sharpe_ratio, win_rate, total_trades, avg_win, avg_loss,
    sl_hit_rate, timeout_rate, largest_loss, max_loss_streak, month_pct``.
    """
    c, h = F.col, HARD
    avg_loss = F.abs(c("avg_loss"))
    m = m.withColumn("expectancy_r", F.coalesce(
        F.try_divide(c("win_rate") / 100 * c("avg_win") - (1 - c("win_rate") / 100) * avg_loss, avg_loss), F.lit(0.0)))
    low_dd, low_pf = c("max_drawdown_pct") > h["max_dd"], c("profit_factor") < h["min_pf"]
    low_sh, low_mo = c("sharpe_ratio") < h["min_sharpe"], c("month_pct") < h["min_month_pct"]
    low_q = (c("win_rate") < h["min_wr"]) & (c("expectancy_r") < h["min_expectancy_r"])
    few = c("total_trades") < h["min_trades"]
    slow = ~few & (c("total_trades") / max(months, 1.0) < h["min_per_month"])
    m = m.withColumns({
        "failures": reasons(F.when(low_dd, "DD"), F.when(low_pf, "PF"), F.when(low_sh, "Sharpe"), F.when(low_mo, "months"),
                            F.when(low_q, "quality"), F.when(few, "trades"), F.when(slow, "trades_per_month")),
        "warnings": reasons(F.when(~low_dd & (c("max_drawdown_pct") > h["warn_dd"]), "DD"),
                            F.when(~low_pf & (c("profit_factor") < h["warn_pf"]), "PF")),
        "root_causes": reasons(
            F.when(low_dd & (c("max_loss_streak") >= 5), "loss_streak"), F.when(low_dd & (c("sl_hit_rate") > 60), "stops_hit"),
            F.when(low_dd & (F.abs(c("largest_loss")) / capital * 100 > 2), "single_large_loss"),
            F.when(low_pf & (c("win_rate") < 45), "low_win_rate"),
            F.when(low_pf & (c("avg_win") > 0) & (avg_loss > 0) & (F.try_divide(c("avg_win"), avg_loss) < 1.2), "poor_reward_risk"),
            F.when(low_pf & (c("timeout_rate") > 30), "timeouts"), F.when(low_sh, "inconsistent_returns"),
            F.when(low_mo, "inconsistent_months"), F.when(low_q, "poor_trade_quality"), F.when(few, "too_few_trades"))})
    fixes = reasons(F.when(low_dd, "1 tighten regime filter"), F.when(low_dd, "1 raise cooldown"), F.when(low_dd, "1 add circuit breaker"),
                    F.when(low_pf & (c("win_rate") < 48), "2 raise entry thresholds"),
                    F.when(low_pf & (c("timeout_rate") > 30), "2 shorten horizon"),
                    F.when(low_sh, "3 raise decision threshold"), F.when(low_sh, "3 add session filter"),
                    F.when(few | slow, "3 loosen filters"))
    return m.withColumns({"ranked_fixes": F.when(F.size("root_causes") > 0, F.slice(fixes, 1, 10)).otherwise(F.array().cast("array<string>")),
                          "live_ready": F.size("failures") == 0})


def deploy_score() -> Column:
    return (F.col("profit_factor") * 0.4 + F.col("win_rate") / 100 * 0.3 + F.col("sharpe_ratio") * 0.2
            - F.col("max_drawdown_pct") / 100 * 0.1)


def deploy_decision(new: DataFrame, old: DataFrame, keys=("symbol", "timeframe")) -> DataFrame:
    """Deploy a model that scores 5 % better, or passes where the old one does not, or passes and is no worse."""
    a = new.select(*keys, deploy_score().alias("new_score"), F.col("passed").alias("new_passed"))
    b = old.select(*keys, deploy_score().alias("old_score"), F.col("passed").alias("old_passed"))
    df = a.join(b, list(keys), "left")
    gain = F.when(F.col("old_score") > 0, (F.col("new_score") - F.col("old_score")) / F.col("old_score") * 100).otherwise(100.0)
    df = df.withColumn("improvement_pct", F.when(F.col("old_score").isNotNull(), gain))
    g, ok = F.col("improvement_pct"), F.col("new_passed")
    return df.withColumn("deploy", F.when(g.isNull(), ok).otherwise((g >= 5) | (ok & ~F.coalesce("old_passed", F.lit(False)))
                                                                    | ((g >= 0) & ok)))


