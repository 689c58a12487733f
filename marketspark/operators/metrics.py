"""Trade metrics, equity curves and periodic reports.

Drawdowns need running sums over a key. A bucket of trades folds to (sum, highest and lowest running
sum, own drawdown), and those rows compose in order, so no key runs through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions.rolling import div
from marketspark.operators.bootstrap import RUN, simulated, simulated_long
from marketspark.operators.joins import join_index_returns
from marketspark.operators.scan import day_of, running
from marketspark.session import materialize, stash

CAPITAL = 100000.0


def max_drawdown(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, bucket: Column | None = None,
                 start: float | None = None, sums: dict[str, Column] | None = None, spread: Column | None = None) -> DataFrame:
    """Largest fall of the running sum from its running maximum, one row per key.

    ``start`` lets the maximum begin at a value (0 for the account itself) instead of the first sum.
    ``sums`` are further totals per key, taken in the same pass, and ``spread`` a value whose mean and population
    deviation are (``mean``, ``deviation``): each bucket's own deviation and its distance from the mean of all, so that
    a large mean costs no digits.
    """
    keys, sums = list(keys), sums or {}
    sums = {**sums, **({} if spread is None else {"_x": spread.cast("double")})}
    w = Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.select(*keys, *order, value.alias("_v"), (day_of(order[0]) if bucket is None else bucket).alias("_bkt"), *(c.alias(n) for n, c in sums.items()))
    rows = rows.withColumn("_s", F.sum("_v").over(w)).withColumn("_p", F.max("_s").over(w))
    b = rows.groupBy(*keys, "_bkt").agg(F.sum("_v").alias("_t"), F.max("_s").alias("_hi"), F.min("_s").alias("_lo"),
                                        F.max(F.col("_p") - F.col("_s")).alias("_dd"), *(F.sum(n).alias(n) for n in sums),
                                        *(() if spread is None else (F.count("_x").alias("_xn"), F.avg("_x").alias("_xm"), F.var_pop("_x").alias("_xv"))))
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0.0)))
    b = b.withColumn("_peak", F.max(F.col("_off") + F.col("_hi")).over(before))
    if start is not None:
        b = b.withColumn("_peak", F.greatest(F.col("_peak"), F.lit(start)))
    fall = F.greatest(F.col("_dd"), F.col("_peak") - F.col("_off") - F.col("_lo"))
    more = ()
    if spread is not None:
        key = Window.partitionBy(*keys)
        b = b.withColumn("_mean", F.try_divide(F.sum(F.col("_xn") * F.col("_xm")).over(key), F.sum("_xn").over(key)))
        square = F.sum(F.col("_xn") * (F.col("_xv") + F.pow(F.col("_xm") - F.col("_mean"), 2)))
        more = (F.max("_mean").alias("mean"), F.sqrt(F.try_divide(square, F.sum("_xn"))).alias("deviation"))
    return b.groupBy(*keys).agg(F.max(fall).alias("max_drawdown"), *(F.sum(n).alias(n) for n in sums if n != "_x"), *more)


def trade_metrics(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"),
                  order: Sequence[str] = ("exit_time", "trade_id"), pnl: str = "pnl", capital: float = CAPITAL,
                  bucket: Column | None = None, returns: str = "return_pct") -> DataFrame:
    """Counts, profit factor (gross profit when nothing was lost), win rate, Sharpe per trade, drawdown, expectancy.

    Sharpe is of the trades' own ``returns``; trades without that column are measured by ``pnl``.
    One pass: every figure is a sum over trades, taken with the drawdown's buckets.
    """
    p = F.col(pnl)
    win, loss = p > 0, p < 0
    m = max_drawdown(trades, keys, order, p, bucket, spread=F.col(returns) if returns in trades.columns else p, sums={
        "total_trades": F.lit(1), "win_count": win.cast("int"), "loss_count": loss.cast("int"), "_gp": F.when(win, p).otherwise(0.0),
        "_gl": F.when(loss, -p).otherwise(0.0), "_net": p})
    n, c = F.col("total_trades"), F.col
    mean, sd = c("mean"), c("deviation")
    m = m.withColumns({"win_rate": c("win_count") * 100.0 / n, "avg_win": F.coalesce(div("_gp", "win_count"), F.lit(0.0)),
                       "avg_loss": F.coalesce(div("_gl", "loss_count"), F.lit(0.0))})
    return m.select(
        *keys, "total_trades", "win_count", "loss_count", F.when(c("_gl") > 0, c("_gp") / c("_gl")).otherwise(c("_gp")).alias("profit_factor"),
        "win_rate", F.coalesce(F.when(sd > F.abs(mean) * 1e-14, mean / sd), F.lit(0.0)).alias("sharpe_ratio"),
        (c("max_drawdown") / capital * 100).alias("max_drawdown_pct"), (c("_net") / capital * 100).alias("total_return_pct"),
        (c("win_rate") / 100 * c("avg_win") - (1 - c("win_rate") / 100) * c("avg_loss")).alias("expectancy"), "avg_win", "avg_loss")


def equity_curve(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"),
                 order: Sequence[str] = ("exit_time", "trade_id"), pnl: str = "pnl", capital: float = CAPITAL) -> DataFrame:
    """Equity after each trade, its peak so far (from the starting capital) and the drawdown in percent."""
    df = running(trades, keys, order, sums={"_cum": F.col(pnl)}, peaks={"_pk": "_cum"}, floor=0.0)
    return (df.withColumns({"equity": F.col("_cum") + capital, "peak": F.col("_pk") + capital})
            .withColumn("drawdown_pct", (F.col("peak") - F.col("equity")) / F.col("peak") * 100).drop("_cum", "_pk"))


def backtest_metrics(trades: DataFrame, keys: Sequence[str] = ("symbol", "timeframe"),
                     order: Sequence[str] = ("exit_time", "trade_id"), pnl: str = "pnl", capital: float = CAPITAL,
                     risk: float = 0.01) -> DataFrame:
    """Variant that counts flat trades as losses and measures drawdown against the equity peak."""
    e = equity_curve(trades, keys, order, pnl, capital)
    p = F.col(pnl)
    win = p > 0
    n = F.count(F.lit(1))
    share = lambda r: F.count_if(F.col("exit_reason") == r) * 100.0 / n
    r = p / (F.col("equity") - p)
    g = e.groupBy(*keys).agg(
        n.alias("total_trades"), (F.count_if(win) * 100.0 / n).alias("win_rate"),
        F.coalesce(F.sum(F.when(win, p)), F.lit(0.0)).alias("_w"), F.abs(F.sum(F.when(~win, p))).alias("_l"),
        (F.sum(p) / capital * 100).alias("total_return_pct"), F.max("drawdown_pct").alias("max_drawdown_pct"),
        (F.avg(r)).alias("_m"), F.stddev_samp(r).alias("_s"), F.avg("bars_held").alias("avg_bars_held"),
        F.coalesce(F.avg(F.when(win, p)), F.lit(0.0)).alias("avg_win"), F.coalesce(F.avg(F.when(~win, p)), F.lit(0.0)).alias("avg_loss"),
        F.max(F.when(win, p)).alias("largest_win"), F.min(F.when(~win, p)).alias("largest_loss"),
        (F.avg(p) / (capital * risk)).alias("avg_r"), share("tp").alias("tp_hit_rate"), share("sl").alias("sl_hit_rate"),
        share("timeout").alias("timeout_rate"))
    loss = F.coalesce(F.col("_l"), F.lit(1.0))
    return (g.withColumn("profit_factor", F.coalesce(div(F.col("_w"), loss), F.lit(0.0)))
            .withColumn("sharpe_ratio", F.coalesce(div("_m", "_s") * (252 ** 0.5), F.lit(0.0))).drop("_w", "_l", "_m", "_s"))


def risk_halt(curve: DataFrame, max_dd: float = 6.0, max_loss: float = 2.0, capital: float = CAPITAL) -> DataFrame:
    """Flags for a drawdown or a loss since the start that should stop trading."""
    loss = (F.col("equity") - capital) / capital * 100
    df = curve.withColumns({"halt_drawdown": F.col("drawdown_pct") > max_dd, "halt_loss": loss < -max_loss})
    return df.withColumn("halted", F.col("halt_drawdown") | F.col("halt_loss"))


def max_consecutive(df: DataFrame, keys: Sequence[str], order: Sequence[str], cond: Column) -> DataFrame:
    """Longest run of rows where ``cond`` holds. The number of misses so far names the run."""
    df = running(df.withColumn("_f", F.coalesce(cond, F.lit(False))), keys, order, counts={"_run": ~F.col("_f")})
    runs = df.where("_f").groupBy(*keys, "_run").agg(F.count(F.lit(1)).alias("_n"))
    longest = runs.groupBy(*keys).agg(F.max("_n").alias("max_consecutive"))
    return (df.select(*keys).distinct().join(longest, list(keys), "left")
            .withColumn("max_consecutive", F.coalesce("max_consecutive", F.lit(0))))


def monthly_consistency(trades: DataFrame, keys=("symbol", "timeframe"), ts: str = "exit_time", pnl: str = "pnl") -> DataFrame:
    """Share of months that made money and trades per month."""
    month = F.trunc(F.col(ts).cast("date"), "month")
    m = trades.groupBy(*keys, month.alias("month")).agg(F.sum(pnl).alias("p"), F.count(F.lit(1)).alias("n"))
    return m.groupBy(*keys).agg(F.count(F.lit(1)).alias("months"), (F.count_if(F.col("p") > 0) * 100.0 / F.count(F.lit(1))).alias("month_pct"),
                                F.avg("n").alias("trades_per_month"))


def yearly_report(trades: DataFrame, returns: DataFrame, keys=("symbol",), ts: str = "exit_time") -> DataFrame:
    """Metrics per year beside the index return of that year."""
    y = trade_metrics(trades.withColumn("year", F.year(ts)), (*keys, "year"), (ts, "trade_id"))
    return join_index_returns(y, returns)


def viability(yearly: DataFrame, keys=("symbol",)) -> DataFrame:
    """Six criteria over the yearly rows; five make a strategy viable."""
    n = F.count(F.lit(1))
    g = yearly.groupBy(*keys).agg(
        n.alias("years"), F.avg("total_return_pct").alias("avg_return"), F.min("total_return_pct").alias("min_return"),
        F.max("total_return_pct").alias("max_return"), F.max("max_drawdown_pct").alias("max_drawdown"),
        F.count_if(F.col("beat_index")).alias("years_beat"), F.sum("total_trades").alias("total_trades"),
        F.avg("win_rate").alias("avg_win_rate"), F.avg("sharpe_ratio").alias("avg_sharpe"))
    tests = [F.col("avg_return") >= 15, F.col("min_return") >= 0, F.col("max_drawdown") < 6,
             F.col("years_beat") >= F.col("years") * 0.7, F.col("total_trades") >= 500, F.col("avg_sharpe") >= 1]
    passed = sum((t.cast("int") for t in tests[1:]), tests[0].cast("int"))
    return g.withColumn("criteria_passed", passed).withColumn("viable", F.col("criteria_passed") >= 5)


#: fixed values: yearly return, Sharpe and drawdown of the index to beat
INDEX = (0.10, 0.5, 0.20)


def index_comparison(m: DataFrame, months: float, index: tuple[float, float, float] = INDEX) -> DataFrame:
    """Annualised return, Sharpe and drawdown against the index; all three must be better."""
    ann = F.col("total_return_pct") / 100 / (months / 12)
    ret, sharpe, dd = (F.lit(x) for x in index)
    own = F.col("max_drawdown_pct") / 100
    return m.withColumns({
        "annual_return_pct": ann * 100, "excess_return_pct": (ann - ret) * 100, "excess_sharpe": F.col("sharpe_ratio") - sharpe,
        "dd_improvement_pct": (dd - own) * 100, "beats_index": (ann > ret) & (F.col("sharpe_ratio") > sharpe) & (own < dd)})


def stress_costs(trades: DataFrame, cost_mult: float = 1.25, latency_bars: int = 1, pnl: str = "pnl", cost: str = "cost") -> DataFrame:
    """Trade results after dearer costs and 5 % latency drag per bar."""
    p = F.col(pnl)
    return trades.withColumn(pnl, p - F.col(cost) * (cost_mult - 1) - p * 0.05 * latency_bars)


def approximate_stress(m: DataFrame) -> DataFrame:
    """Rule-of-thumb shrink of profit factor and growth of drawdown under stress."""
    return m.withColumns({"stressed_pf": F.col("profit_factor") * 0.85 * 0.9, "stressed_dd": F.col("max_drawdown_pct") * 1.2})


def block_bootstrap(trades: DataFrame, keys=("symbol",), order=("exit_time", "trade_id"), pnl: str = "pnl", sims: int = 1000,
                    block: int = 10, seed: int = 7, returns: str = "return_pct", held: int = 2_000_000) -> DataFrame:
    """Spread of profit factor, Sharpe and drawdown over resampled blocks of consecutive trades.

    Block starts come from a generator over (seed, simulation, block number), so reruns and partitionings agree. A key
    of up to ``held`` trades is simulated where its trades are (:func:`~marketspark.operators.bootstrap.simulated`):
    blocks are looked up and folded there, and only a row for each simulation leaves. Of longer keys a task holds the
    trades alone, 16 bytes each, and folds a block when it is drawn (:func:`~marketspark.operators.bootstrap.simulated_long`),
    with the same result; draws are neither shuffled nor broadcast. A key of ``block`` trades or fewer has no block to
    draw: 0 ``sims`` and null figures.
    """
    keys = list(keys)
    idx = trades.select(*keys, *order, F.coalesce(F.col(pnl).cast("double"), F.lit(0.0)).alias("_v"), F.col(returns if returns in trades.columns else pnl).cast("double").alias("_r"))
    idx = stash(running(idx, keys, order, counts={"_n": F.lit(True)}).select(*keys, (F.col("_n") - 1).alias("_i"), "_v", "_r"), "trades")
    every = stash(idx.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total")), "totals")
    near = every.where(F.col("_total").between(block + 1, held)).select(*keys)
    far = every.where(F.col("_total") > max(held, block))
    m = simulated(idx.join(near, keys, "left_semi"), keys, sims, block, seed).select(*keys, *RUN)
    if far.limit(1).count():
        m = m.unionByName(simulated_long(idx.join(far, keys), keys, sims, block, seed).select(*keys, *RUN))
    mean, sd = F.col("m"), F.sqrt(F.try_divide("s", "n"))
    m = m.select(*keys, F.when(F.col("gl") > 0, F.col("gp") / F.col("gl")).otherwise(F.col("gp")).alias("pf"),
                 F.coalesce(F.when(sd > F.abs(mean) * 1e-14, mean / sd), F.lit(0.0)).alias("sharpe"), (F.col("dd") / CAPITAL * 100).alias("dd"))
    m = m.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sims"), F.avg("pf").alias("pf_mean"), F.stddev_pop("pf").alias("pf_std"),
        F.percentile("pf", F.lit(0.05)).alias("pf_5th"), F.percentile("pf", F.lit(0.95)).alias("pf_95th"),
        F.avg("sharpe").alias("sharpe_mean"), F.avg("dd").alias("dd_mean"), F.percentile("dd", F.lit(0.95)).alias("dd_95th"))
    return every.select(*keys).join(m, keys, "left").withColumn("sims", F.coalesce("sims", F.lit(0)).cast("long"))


def period_rollup(trades: DataFrame, keys=("symbol", "timeframe"), ts: str = "exit_time", pnl: str = "pnl") -> DataFrame:
    """Counts and results per day, week, month and over all time. Each day is folded once, then rolled up."""
    p = F.col(pnl)
    day = trades.groupBy(*keys, F.col(ts).cast("date").alias("_d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("w"), F.sum(p).alias("s"), F.min(p).alias("lo"), F.max(p).alias("hi"))
    starts = {"daily": F.col("_d"), "weekly": F.trunc("_d", "week"), "monthly": F.trunc("_d", "month"), "all_time": F.lit(None).cast("date")}
    kinds = F.array(*(F.struct(F.lit(k).alias("period"), c.alias("period_start")) for k, c in starts.items()))
    x = day.select(*keys, "n", "w", "s", "lo", "hi", F.inline(kinds))
    return x.groupBy(*keys, "period", "period_start").agg(
        F.sum("n").alias("total_trades"), F.sum("w").alias("winning_trades"), F.sum("s").alias("total_pnl"),
        (F.sum("w") * 100.0 / F.sum("n")).alias("win_rate"), F.min("lo").alias("worst_trade"), F.max("hi").alias("best_trade"))
