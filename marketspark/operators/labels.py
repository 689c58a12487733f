"""Forward-looking labels: 0 flat, 1 up, 2 down.

The bars after the current one are a bounded array (a frame of ``horizon`` rows inside the block's
halo); the first bar that touches a price is a position in that array. A label needs no loop and no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions.rolling import div, flag
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.series import Series, blocked

#: fixed values: horizon in bars, take-profit and stop in ATRs per timeframe
HORIZONS = {
    "5T": (10, 1.5, 1.0),
    "15T": (8, 1.5, 1.0),
    "30T": (6, 1.5, 1.0),
    "1H": (6, 2.0, 1.0),
    "2H": (4, 2.0, 1.0),
    "4H": (3, 2.5, 1.0),
}
FALLBACK_ATR = 0.02


def paths(s: Series, n: int) -> Series:
    """Highs and lows of the next ``n`` bars as arrays, shared by every touch of that horizon."""
    if s.has(f"_fh{n}"):
        return s
    return s.add(**{f"_fh{n}": F.expr(f"collect_list(high) {s.over(1, n)}"), f"_fl{n}": F.expr(f"collect_list(low) {s.over(1, n)}")})


def touch_high(price: Column, n: int) -> Column:
    """1-based position of the first of the next ``n`` bars whose high reaches ``price``; 0 if none. Needs :func:`paths`."""
    return F.coalesce(F.array_position(F.transform(F.col(f"_fh{n}"), lambda x: x >= price), True), F.lit(0))


def touch_low(price: Column, n: int) -> Column:
    return F.coalesce(F.array_position(F.transform(F.col(f"_fl{n}"), lambda x: x <= price), True), F.lit(0))


def before(a: str, b: str) -> Column:
    """Touch ``a`` happened and came strictly before touch ``b``."""
    a_, b_ = F.col(a), F.col(b)
    return (a_ > 0) & ((b_ == 0) | (a_ < b_))


def _close_at(s: Series, n: int) -> Column:
    return F.last("close").over(s.ahead(1, n))


def barrier_series(bars: DataFrame, horizon: int, back: int = 20, block: int | None = None) -> Series:
    """Bars with ``atr14`` (computed unless present), ready for a label of up to ``horizon`` bars ahead."""
    s = blocked(bars, back=back, fwd=horizon + 2, block=block)
    return s if "atr14" in bars.columns else ind.atr(s, 14)


LABEL_COLS = ("target", "expected_return", "expected_duration", "tp_hit", "sl_hit")


def triple_barrier(s: Series, horizon: int, tp: float, sl: float) -> DataFrame:
    """Enter at the next open; the first barrier touched in ``horizon`` bars decides, ties go down."""
    atr = F.when(F.col("atr14") > 0, F.col("atr14")).otherwise(F.col("close") * FALLBACK_ATR)
    s = paths(s, horizon).add(_a=atr, _e=s.lead("open"), _end=_close_at(s, horizon))
    s = s.add(_up=F.col("_e") + F.col("_a") * tp, _dn=F.col("_e") - F.col("_a") * sl)
    s = s.add(_tp=touch_high(F.col("_up"), horizon), _sl=touch_low(F.col("_dn"), horizon))
    known = s.from_end > horizon
    up, down = known & before("_tp", "_sl"), known & (F.col("_sl") > 0) & ~before("_tp", "_sl")
    gain = lambda px: F.col(px) / F.col("_e") - 1
    s = s.add(
        target=F.when(up, 1).when(down, 2).otherwise(0),
        expected_return=F.when(up, gain("_up")).when(down, gain("_dn")).when(known, gain("_end")).otherwise(0.0),
        expected_duration=F.when(up, F.col("_tp")).when(down, F.col("_sl")).when(known, horizon).otherwise(0).cast("int"),
        tp_hit=flag(up), sl_hit=flag(down))
    return s.where(s.from_end >= horizon).rows()


def triple_barrier_partial(s: Series, horizon: int, tp: float, sl: float, share: float = 0.9) -> DataFrame:
    """Next-open entry over ``horizon + 1`` bars; an untouched row still counts when it ends beyond
    ``share`` of a barrier. ``hit_type`` tells which rule fired."""
    n = horizon + 1
    a = F.col("atr14")
    s = paths(s, n).add(_e=s.lead("open"), _end=_close_at(s, n))
    s = s.add(_tp=touch_high(F.col("_e") + a * tp, n), _sl=touch_low(F.col("_e") - a * sl, n),
              _mv=div(F.col("_end") - F.col("_e"), a))
    up, touched = before("_tp", "_sl"), (F.col("_tp") > 0) | (F.col("_sl") > 0)
    part_up = ~touched & (F.col("_mv") >= tp * share)
    part_dn = ~touched & (F.col("_mv") <= -sl * share)
    s = s.add(
        target=F.when(up | part_up, 1).when(touched | part_dn, 2).otherwise(0),
        expected_return=F.when(up, a * tp / F.col("_e")).when(touched, -a * sl / F.col("_e"))
        .otherwise((F.col("_end") - F.col("_e")) / F.col("_e")),
        expected_duration=F.when(up, F.col("_tp")).when(touched, F.col("_sl")).otherwise(n).cast("int"),
        hit_type=F.when(up, "tp").when(touched, "sl").when(part_up, "partial_up").when(part_dn, "partial_down")
        .otherwise("flat"))
    return s.where(s.from_end >= n).rows()


def _two_sided(s: Series, horizon: int, tp: float, sl: float, share: float = 1.0, atr: Column | None = None) -> Series:
    """Touches of both sides from the current close; ``share`` shortens the targets, not the stops."""
    s = paths(s, horizon).add(_a=F.col("atr14") if atr is None else atr)
    a, c = F.col("_a"), F.col("close")
    return s.add(_tl=touch_high(c + a * (tp * share), horizon), _sl=touch_low(c - a * sl, horizon),
                 _ts=touch_low(c - a * (tp * share), horizon), _ss=touch_high(c + a * sl, horizon),
                 _mx=F.max("high").over(s.ahead(1, horizon)), _mn=F.min("low").over(s.ahead(1, horizon)),
                 _end=_close_at(s, horizon))


def adaptive_two_sided(s: Series, horizon: int, tp: float, sl: float, flat: float) -> DataFrame:
    """Long target, short target, long stop (down), short stop (up), else the move against ``tp*flat`` ATRs."""
    s = _two_sided(s, horizon, tp, sl)
    a, c = F.col("_a"), F.col("close")
    mv = div(F.col("_end") - c, a)
    r1, r2, r3, r4 = before("_tl", "_sl"), before("_ts", "_ss"), before("_sl", "_tl"), before("_ss", "_ts")
    s = s.add(
        target=F.when(r1, 1).when(r2, 2).when(r3, 2).when(r4, 1).when(mv >= tp * flat, 1).when(mv <= -tp * flat, 2)
        .otherwise(0),
        expected_return=F.when(r1 | r2, a * tp / c).when(r3 | r4, -a * sl / c).otherwise((F.col("_end") - c) / c),
        expected_duration=F.when(r1, F.col("_tl")).when(r2, F.col("_ts")).when(r3, F.col("_sl")).when(r4, F.col("_ss"))
        .otherwise(horizon).cast("int"))
    return s.where(s.from_end >= horizon).rows()


def tp_first_only(s: Series, horizon: int, tp: float, sl: float, share: float = 1.0, gate: float | None = None,
                  fill_atr: bool = False) -> DataFrame:
    """Directional only when a target comes strictly before its stop, the long side first.

    ``share`` < 1 tests a shorter target against the full stop. With ``gate`` the best excursion in ATRs
    must reach it, and a long excursion that does shuts out the short side.
    """
    atr = F.coalesce("atr14", F.col("close") * FALLBACK_ATR) if fill_atr else None
    s = _two_sided(s, horizon, tp, sl, share, atr)
    long, short = before("_tl", "_sl"), before("_ts", "_ss")
    if gate is not None:
        up = F.coalesce(div(F.col("_mx") - F.col("close"), "_a") >= gate, F.lit(False))
        down = F.coalesce(div(F.col("close") - F.col("_mn"), "_a") >= gate, F.lit(False))
        long, short = up & long, ~up & down & short
    s = s.add(target=F.when(long, 1).when(short, 2).otherwise(0))
    return s.where(s.from_end >= horizon).rows()


def quantile_return(s: Series, ahead: int = 10, q: float = 0.6) -> DataFrame:
    """1 when the forward return is in the upper, 0 when in the lower tail of its own series; rest dropped."""
    s = s.add(future_return=div(s.lead("close", ahead), "close") - 1)
    df = s.rows().where(F.col("future_return").isNotNull())
    cut = exact_quantiles(df, s.keys, F.abs("future_return"), {"_cut": q})
    r = F.col("future_return")
    return (df.join(cut, list(s.keys)).where((r >= F.col("_cut")) | (r <= -F.col("_cut")))
            .withColumn("target", F.when(r >= F.col("_cut"), 1).otherwise(0)).drop("_cut"))


def from_signals(trades: DataFrame) -> DataFrame:
    """Class a closed trade teaches: its side when it won, the other side when it lost."""
    win = F.col("pnl") > 0
    long = F.col("direction") == "long"
    return trades.withColumn("actual_outcome", flag(win)).withColumn("target", F.when(win == long, 1).otherwise(2))


def label_distribution(labels: DataFrame, *keys: str) -> DataFrame:
    """Counts and shares per class, and a verdict on the flat share."""
    keys = keys or ("symbol", "timeframe")
    n = F.count(F.lit(1))
    cls = {"flat": 0, "up": 1, "down": 2}
    df = labels.groupBy(*keys).agg(n.alias("total"), *(F.count_if(F.col("target") == v).alias(f"{k}_n") for k, v in cls.items()))
    df = df.withColumns({f"{k}_pct": F.round(F.col(f"{k}_n") * 100.0 / F.col("total"), 4) for k in cls})
    return df.withColumn("verdict", F.when(F.col("flat_pct") < 20, "overtrading").when(F.col("flat_pct") > 40, "conservative")
                         .otherwise("balanced"))


def forward_outcome_by_label(s: Series, label: str = "target", ahead: int = 10) -> DataFrame:
    """Mean forward return and share of right calls per label; flat is right within 0.2 %."""
    s = s.add(_fr=div(s.lead("close", ahead), "close") - 1)
    df = s.where(F.col("_fr").isNotNull()).select(label, F.col("_fr").alias("fr"))
    right = F.when(F.col(label) == 1, F.col("fr") > 0).when(F.col(label) == 2, F.col("fr") < 0).otherwise(F.abs("fr") < 0.002)
    return df.groupBy(label).agg(F.count("fr").alias("n"), F.avg(F.col("fr") * 100).alias("avg_return_pct"),
                                 (F.avg(right.cast("double")) * 100).alias("hit_rate_pct"))
