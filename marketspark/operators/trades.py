"""From signals to trades and account curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions.rolling import div
from marketspark.operators import labels as L
from marketspark.operators.joins import with_costs, with_tp_sl
from marketspark.operators.scan import running
from marketspark.operators.series import blocked
from marketspark.operators.sizing import tp_sl_prices, with_trade_costs
from marketspark.session import stash

CAPITAL = 100000.0


def barrier_trades(bars: DataFrame, signals: DataFrame, costs: DataFrame, targets: DataFrame, risk: float = 0.01,
                   max_bars: int = 50, capital: float = CAPITAL, block: int | None = None) -> DataFrame:
    """Resolve every signal on its own: next-open entry, stop before target, close after ``max_bars``.

    Signals too close to the end of a series, with a stop nearer than 0.1 % or a value above ten times
    the capital are left out. Costs are paid both ways.
    """
    # both sides of every bar are resolved inside the blocks, so that only four positions per bar are joined, not price paths
    s = ind.atr(blocked(bars.join(F.broadcast(targets), ["symbol", "timeframe"]), back=20, fwd=max_bars + 3, block=block), 14)
    s = L.paths(s, max_bars).add(entry_time=s.lead("bar_ts"), entry_price=s.lead("open"), _ea=s.lead("atr14"), timeout_close=F.last("close").over(s.ahead(1, max_bars + 1)))
    s = s.add(atr=F.when(F.col("_ea") > 0, F.col("_ea")).otherwise(F.col("entry_price") * L.FALLBACK_ATR))
    e, tp_d, sl_d = F.col("entry_price"), F.col("atr") * F.col("tp_mult"), F.col("atr") * F.col("sl_mult")
    s = s.add(lt=L.touch_high(e + tp_d, max_bars), ls=L.touch_low(e - sl_d, max_bars), st=L.touch_low(e - tp_d, max_bars), ss=L.touch_high(e + sl_d, max_bars))
    entries = s.where(s.from_end >= max_bars + 1).select("entry_time", "entry_price", "atr", "timeout_close", "lt", "ls", "st", "ss")
    t = tp_sl_prices(with_tp_sl(with_costs(signals, costs), targets).join(entries, ["symbol", "timeframe", "bar_ts"]))
    tp, sl, long = F.col("tp_price"), F.col("sl_price"), F.col("direction") == "long"
    t = t.withColumns({"_t": F.when(long, F.col("lt")).otherwise(F.col("st")), "_s": F.when(long, F.col("ls")).otherwise(F.col("ss")),
                       "_dist": F.abs(F.col("entry_price") - sl)})
    t = t.withColumns({"position_size": div(F.lit(capital * risk), "_dist")})
    t = t.withColumn("notional", F.col("position_size") * F.col("entry_price"))
    t = t.where((F.col("_dist") >= F.col("entry_price") * 0.001) & (F.col("notional") <= capital * 10))
    stop = (F.col("_s") > 0) & ((F.col("_t") == 0) | (F.col("_s") <= F.col("_t")))
    hit = ~stop & (F.col("_t") > 0)
    t = t.withColumns({
        "exit_reason": F.when(stop, "sl").when(hit, "tp").otherwise("timeout"),
        "exit_price": F.when(stop, sl).when(hit, tp).otherwise(F.col("timeout_close")),
        "bars_held": F.when(stop, F.col("_s") - 1).when(hit, F.col("_t") - 1).otherwise(max_bars - 1).cast("int")})
    t = with_trade_costs(t, "entry_price", "exit_price", "notional")
    d = F.when(long, 1.0).otherwise(-1.0)
    t = t.withColumns({
        "gross_pnl": d * (F.col("exit_price") - F.col("entry_price")) * F.col("position_size"),
        "cost": F.col("commission") + F.col("slippage"),
        "pnl": d * (F.col("adjusted_exit") - F.col("adjusted_entry")) * F.col("position_size") - F.col("commission") - F.col("slippage")})
    return t.drop("lt", "ls", "st", "ss", "timeout_close", "_t", "_s", "_dist")


def threshold_sweep(trades: DataFrame, thresholds: Sequence[float], keys=("symbol", "timeframe"), capital: float = CAPITAL,
                    risk: float = 0.01) -> DataFrame:
    """Metrics of the trades at or above each confidence threshold.

    A trade belongs to the thresholds at or below its confidence. Trades fold to one row per (key, number
    of thresholds met) before they are spread over thresholds.
    """
    ts = sorted(thresholds)
    met = sum(((F.col("confidence") >= t).cast("int") for t in ts[1:]), (F.col("confidence") >= ts[0]).cast("int"))
    p = F.col("pnl")
    f = trades.withColumn("_m", met).where(F.col("_m") > 0).groupBy(*keys, "_m").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(p > 0).alias("w"), F.sum(F.when(p > 0, p).otherwise(0.0)).alias("g"),
        F.sum(F.when(p <= 0, -p).otherwise(0.0)).alias("l"), F.count_if(p <= 0).alias("ln"), F.sum(p).alias("s"), F.var_pop(p).alias("v"))
    f = f.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_m"))))
    each = Window.partitionBy(*keys, "_k")
    f = f.withColumn("_mean", F.sum("s").over(each) / F.sum("n").over(each))
    square = F.sum(F.col("n") * (F.col("v") + F.pow(F.col("s") / F.col("n") - F.col("_mean"), 2))).alias("q")
    g = f.groupBy(*keys, "_k").agg(*(F.sum(c).alias(c) for c in ("n", "w", "g", "l", "ln", "s")), square)
    n, mean = F.col("n"), F.col("s") / F.col("n")
    var = F.try_divide(F.col("q"), n - 1)
    return g.select(
        *keys, F.element_at(F.array(*(F.lit(t) for t in ts)), F.col("_k")).alias("confidence_threshold"), n.alias("total_trades"),
        (F.col("w") * 100.0 / n).alias("win_rate"),
        F.coalesce(div(F.col("g"), F.when(F.col("ln") > 0, F.col("l")).otherwise(1.0)), F.lit(0.0)).alias("profit_factor"),
        (mean / (capital * risk)).alias("avg_r"),
        F.coalesce(F.try_divide(mean, F.sqrt(var)) * (252 ** 0.5), F.lit(0.0)).alias("sharpe_per_trade"))


def pick_threshold(sweep: DataFrame, keys=("symbol", "timeframe"), pf: float = 1.3, wr: float = 50.0, n: int = 50) -> DataFrame:
    """Best Sharpe among thresholds that reach the targets, else the best profit factor; lowest threshold on ties."""
    c = F.col
    ok = (c("profit_factor") >= pf) & (c("win_rate") >= wr) & (c("total_trades") >= n)
    row = F.struct(ok.alias("meets_targets"), *sweep.columns)
    rank = F.struct(ok, F.when(ok, c("sharpe_per_trade")).otherwise(c("profit_factor")), -c("confidence_threshold"))
    return sweep.groupBy(*keys).agg(F.max_by(row, rank).alias("_r")).select("_r.*")


#: fixed values: cost multipliers (commission, slippage) and position caps of the stress grid
COST_SCENARIOS = {"best_case": (0.5, 0.5), "normal": (1.0, 1.0), "realistic": (1.5, 2.0), "worst_case": (3.0, 4.0),
                  "extreme": (5.0, 5.0)}
POSITION_SCENARIOS = {"aggressive": 0.20, "normal": 0.10, "conservative": 0.05, "very_conservative": 0.02}
BASE_COMMISSION = 0.00001
BASE_SLIPPAGE = 0.000005


def _returns(outcomes: DataFrame, risk: float, com: Column, slip: Column, cap: Column, share: Column) -> DataFrame:
    """Return on equity of each trade when size follows equity: value is risk over stop distance, capped."""
    entry = F.col("entry_price")
    value = F.least(div(F.lit(risk) * entry, entry - F.col("sl_price")), cap) * share
    target = F.when(F.col("target") == 1, F.col("tp_price")).otherwise(F.col("sl_price"))
    move = (target - entry) / entry
    return (outcomes.where(entry > F.col("sl_price"))
            .withColumn("r", value * (move - com * BASE_COMMISSION - slip * BASE_SLIPPAGE)))


def compound_equity(outcomes: DataFrame, risk: float = 0.02, keys=("symbol", "timeframe"),
                    order=("bar_ts",), capital: float = CAPITAL, stop_dd: float = 0.10) -> DataFrame:
    """Equity that compounds through every scenario, stopped after the first drawdown beyond ``stop_dd``.

    Size is proportional to equity, so equity is the capital times the product of ``1 + r`` and needs no loop. All
    scenarios of a trade stay in its row: one scan runs them as columns, and they become rows only after the fold.
    """
    k, entry = list(keys), F.col("entry_price")
    grid = [(c, p, com, slip, cap) for c, (com, slip) in COST_SCENARIOS.items() for p, cap in POSITION_SCENARIOS.items()]
    exit_ = F.when(F.col("target") == 1, F.col("tp_price")).otherwise(F.col("sl_price"))
    t = outcomes.where(entry > F.col("sl_price")).select(*k, *order, (F.col("target") == 1).alias("win"), div(F.lit(risk) * entry, entry - F.col("sl_price")).alias("size"), ((exit_ - entry) / entry).alias("move"))
    step = [1 + F.least("size", F.lit(cap)) * (F.col("move") - com * BASE_COMMISSION - slip * BASE_SLIPPAGE) for _, _, com, slip, cap in grid]
    t = stash(running(t, k, order, products={f"g{i}": f for i, f in enumerate(step)}, peaks={f"p{i}": f"g{i}" for i in range(len(grid))}, floor=1.0), "equity")
    at, dd = F.struct(*order), [1 - F.col(f"g{i}") / F.col(f"p{i}") for i in range(len(grid))]
    stop = t.groupBy(*k).agg(*(F.min(F.when(d > stop_dd, at)).alias(f"s{i}") for i, d in enumerate(dd)))
    out = []
    for i, f in enumerate(step):
        end, g, win = F.col(f"s{i}"), F.col(f"g{i}"), F.col("win")
        kept, seen = end.isNull() | (at < end), end.isNull() | (at <= end)
        pnl = F.lit(capital) * (g - g / f)
        out += [F.count_if(kept).alias(f"trades{i}"), (F.count_if(kept & win) * 100.0).alias(f"w{i}"), F.sum(F.when(kept & win, pnl)).alias(f"gain{i}"), F.abs(F.sum(F.when(kept & ~win, pnl))).alias(f"loss{i}"),
                F.max_by(F.when(seen, g), F.when(seen, at)).alias(f"end{i}"), (F.max(F.when(seen, dd[i])) * 100).alias(f"dd{i}"), F.max(end.isNotNull()).alias(f"stopped{i}")]
    g = t.join(stop, k).groupBy(*k).agg(*out)
    rows = F.array(*(F.struct(F.lit(c).alias("cost_scenario"), F.lit(p).alias("position_scenario"), F.col(f"trades{i}").alias("trades"), F.coalesce(div(f"w{i}", f"trades{i}"), F.lit(0.0)).alias("win_rate"),
                              ((F.col(f"end{i}") - 1) * 100).alias("total_return_pct"), F.col(f"dd{i}").alias("max_drawdown_pct"),
                              F.coalesce(div(F.coalesce(f"gain{i}", F.lit(0.0)), F.coalesce(f"loss{i}", F.lit(1.0))), F.lit(0.0)).alias("profit_factor"), F.col(f"stopped{i}").alias("stopped")) for i, (c, p, *_) in enumerate(grid)))
    g = g.select(*k, F.inline(rows))
    return g.withColumn("viable", (F.col("total_return_pct") > 10) & (F.col("max_drawdown_pct") < 6) & (F.col("profit_factor") > 1.5))


def allocated_equity(outcomes: DataFrame, allocations: DataFrame, risk: float = 0.02, cap: float = 0.10, keys=("symbol",),
                     ts: str = "bar_ts", capital: float = CAPITAL) -> DataFrame:
    """One account shared by several configs; within a bar configs act in name order on their share of equity."""
    k = list(keys)
    t = outcomes.join(allocations, "config")
    t = _returns(t, risk, F.lit(1.0), F.lit(1.0), F.lit(cap), F.col("allocation"))
    t = running(t.withColumn("_f", 1 + F.col("r")), k, (ts, "config"), products={"growth": F.col("_f")})
    pnl = F.lit(capital) * (F.col("growth") - F.col("growth") / F.col("_f"))
    bars = t.groupBy(*k, ts).agg(F.max_by("growth", "config").alias("growth"))
    bars = running(bars, k, (ts,), maxes={"_pk": F.col("growth")})
    dd = bars.groupBy(*k).agg((F.max(1 - F.col("growth") / F.greatest(F.col("_pk"), F.lit(1.0))) * 100).alias("max_drawdown_pct"),
                              (F.max_by("growth", ts) * capital).alias("final_equity"))
    n = F.count(F.lit(1))
    win = F.col("target") == 1
    per = t.groupBy(*k, "config").agg(n.alias("trades"), F.count_if(win).alias("wins"), F.sum(pnl).alias("pnl"),
                                      (F.count_if(win) * 100.0 / n).alias("win_rate"))
    return per.join(dd, k)


def allocation_weights(results: DataFrame, keys=("symbol",)) -> DataFrame:
    """Weights proportional to return over drawdown, equal when the scores do not sum above zero."""
    score = F.when(F.col("max_drawdown_pct") > 0, F.col("total_return_pct") / F.col("max_drawdown_pct")).otherwise(F.col("total_return_pct"))
    w = Window.partitionBy(*keys)
    df = results.withColumn("score", score)
    total = F.sum("score").over(w)
    return df.withColumn("weight", F.when(total > 0, F.col("score") / total).otherwise(1.0 / F.count(F.lit(1)).over(w)))
