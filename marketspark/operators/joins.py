"""As-of, interval and dimension joins."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from marketspark.operators.scan import running
from marketspark.session import stash
from marketspark.sources import dims


#: rows of both sides of an as-of join that a task holds, on average
ASOF_ROWS = 1_000_000


def asof_join(low: DataFrame, high: DataFrame, on: Sequence[str] = ("symbol",), ts: str = "bar_ts",
              period_seconds: int | None = None, suffix: str = "_htf", rows_per_task: int = ASOF_ROWS) -> DataFrame:
    """Latest row of ``high`` at or before each row of ``low``; clashing names get ``suffix``.

    Both sides are stacked, cut into balanced ranges of (keys, time) and sorted, so a range may be any part of one
    key's one moment and no key, day or hour is a task of its own. Inside a range the last ``high`` row is carried
    forward. What a key's first rows in a range lack is the last ``high`` row of the ranges before: one row for each
    range, joined back by its number. With ``period_seconds`` a bar of ``high`` counts only from its end, so no
    unfinished bar is seen; without, from its start. A null key or time meets nothing.
    """
    spark, on = low.sparkSession, list(on)
    extra = [c for c in high.columns if c not in (*on, ts)]
    own = [c for c in low.columns if c not in (*on, ts)]
    seen = F.col(ts) if period_seconds is None else F.col(ts) + F.make_dt_interval(secs=F.lit(period_seconds))
    known = F.lit(True)
    for c in on:
        known = known & F.col(c).isNotNull()
    right = high.select(*on, seen.alias(ts), F.lit(0).alias("_side"), F.struct(F.lit(1).alias("_"), *extra).alias("_h")).where(known & F.col(ts).isNotNull())
    left = low.select(*on, ts, F.lit(1).alias("_side"), F.struct(F.lit(1).alias("_"), *own).alias("_l"))
    both = stash(left.unionByName(right, allowMissingColumns=True), "asof-rows")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-both.count() // rows_per_task))
    order = [*on, ts, "_side", F.xxhash64("_l", "_h")]
    cut = both.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    filled = StructType([*both.schema.fields, StructField("_part", IntegerType()), StructField("_open", BooleanType())])
    told = stash(cut.mapInArrow(_carried_forward(on), filled), "asof")
    # the last right row of each range's last key, which the next range that holds rows begins with
    upto = Window.partitionBy(*on).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = told.where("_side = 2").withColumn("_next", F.lead("_part").over(Window.orderBy("_part")))  # a row for each range
    heads = ends.select(*on, F.col("_next").alias("_part"), F.last("_h", True).over(upto).alias("_in"), F.lit(True).alias("_open")).where("_in IS NOT NULL")
    rows = told.where("_side = 1").join(F.broadcast(heads), [*on, "_part", "_open"], "left")
    h = F.coalesce("_h", "_in")
    names = {c: c + suffix if c in low.columns else c for c in extra}
    return rows.select(*on, ts, *(F.col(f"_l.{c}").alias(c) for c in own), *(h[c].alias(n) for c, n in names.items()))


def _carried_forward(on: list[str]):
    """Over a sorted range: left rows with the last right row of their key in the range; ``_open`` where the key may have
    one in an earlier range; and for the range's last key its last right row, as a row of side 2."""
    def run(batches):
        part, first, key, held, last = TaskContext.get().partitionId(), True, None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            n, side, h = batch.num_rows, batch.column("_side").to_numpy(), batch.column("_h")
            new = np.zeros(n, bool)
            for c in on:
                code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy()
                new[1:] |= code[1:] != code[:-1]
            own = tuple(batch.column(c)[0].as_py() for c in on)
            new[0] = key is None or own != key
            if new[0]:
                held = None
                first = key is None
            starts = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            latest = np.maximum.accumulate(np.where(side == 0, np.arange(n), -1))
            inside = latest >= starts
            later = starts > 0  # rows of keys that begin in this batch behind its first row
            pool = pa.concat_arrays([held if held is not None else pa.nulls(1, h.type), h])
            take = np.where(inside, latest + 1, np.where(later, -1, 0 if held is not None else -1))
            at = np.flatnonzero(side == 1)
            whole = pool.take(pa.array(take[at], mask=take[at] < 0))
            open_ = (first & ~later & (take < 0))[at]
            cols = [whole if f.name == "_h" else batch.column(f.name).take(pa.array(at)) for f in batch.schema]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(len(at), part, np.int32)), pa.array(open_)], names=[*batch.schema.names, "_part", "_open"])
            if take[-1] >= 0:
                held = pool.slice(int(take[-1]), 1)
            elif later[-1]:
                held = None
            if new[1:].any():
                first = False
            key, last = tuple(batch.column(c)[n - 1].as_py() for c in on), batch
        if last is not None:
            end = last.slice(last.num_rows - 1, 1)
            fixed = {"_side": pa.array([2], pa.int32()), "_h": held if held is not None else pa.nulls(1, last.column("_h").type), "_l": pa.nulls(1, last.column("_l").type)}
            cols = [fixed.get(f.name, end.column(f.name)) for f in last.schema]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([part], pa.int32()), pa.array([False])], names=[*last.schema.names, "_part", "_open"])
    return run


def blackout_join(bars: DataFrame, events: DataFrame, currencies: DataFrame, minutes: int = 30) -> DataFrame:
    """Mark bars within ``minutes`` of a high-impact event of one of the symbol's currencies.

    Events are spread over the hours their window touches (at most three), so the interval join is
    an equi-join on (currency, hour) with a range check.
    """
    ev = events.where(F.col("impact") == "high").select("currency", "event_time")
    pad = F.make_dt_interval(mins=F.lit(minutes))
    hour = lambda c: F.floor(F.unix_timestamp(c.cast("timestamp")) / 3600)
    ev = ev.withColumn("_h", F.explode(F.sequence(hour(F.col("event_time") - pad), hour(F.col("event_time") + pad))))
    keyed = bars.select("symbol", "timeframe", "bar_ts").join(currencies, "symbol").withColumn("_h", hour(F.col("bar_ts")))
    gap = (F.unix_timestamp(F.col("event_time").cast("timestamp")) - F.unix_timestamp(F.col("bar_ts").cast("timestamp"))) / 60.0
    hits = (keyed.join(ev, ["currency", "_h"])
            .where(F.col("event_time").between(F.col("bar_ts") - pad, F.col("bar_ts") + pad))
            .withColumn("_g", gap).groupBy("symbol", "timeframe", "bar_ts")
            .agg(F.count(F.lit(1)).alias("events_near"), F.min(F.when(F.col("_g") >= 0, F.col("_g"))).alias("minutes_to_event"),
                 F.min(F.when(F.col("_g") < 0, -F.col("_g"))).alias("minutes_after_event")))
    return (bars.join(hits, ["symbol", "timeframe", "bar_ts"], "left")
            .withColumn("in_blackout", F.col("events_near").isNotNull())
            .withColumn("events_near", F.coalesce("events_near", F.lit(0))))


def rule_blackout(ts: Column, nfp: bool = True, cpi: bool = True) -> Column:
    """Payroll Friday (first of the month) and mid-month inflation days, 13:00 to 14:59 UTC."""
    hour = F.hour(ts).between(13, 14)
    first_friday = (F.weekday(ts) == 4) & (F.dayofmonth(ts) <= 7)
    mid_month = F.dayofmonth(ts).between(12, 18)
    return hour & ((F.lit(nfp) & first_friday) | (F.lit(cpi) & mid_month))


def _with_dim(df: DataFrame, dim: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Left join with a fixed-size dimension; a key without a row raises."""
    joined = df.join(F.broadcast(dim.withColumn("_hit", F.lit(True))), keys, "left")
    key = F.concat_ws("/", *keys)
    first = [c for c in dim.columns if c not in keys][0]
    checked = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), key)).cast("double")).otherwise(F.col(first))
    return joined.withColumn(first, checked).drop("_hit")


def with_costs(df: DataFrame, costs: DataFrame) -> DataFrame:
    return _with_dim(df, costs, ["symbol"], "costs")


def with_tp_sl(df: DataFrame, tp_sl: DataFrame) -> DataFrame:
    return _with_dim(df, tp_sl, ["symbol", "timeframe"], "targets")


def with_pip_value(df: DataFrame, pips: DataFrame) -> DataFrame:
    out = df.join(F.broadcast(pips), "symbol", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(dims.DEFAULT_PIP)) for c in ("pip_value", "spread_pip")})


def dims_complete(costs: DataFrame, targets: DataFrame, key: str = "symbol") -> DataFrame:
    """Keys one table has and the other lacks."""
    a, b = costs.select(key).distinct(), targets.select(key).distinct()
    return (a.join(b, key, "left_anti").withColumn("missing_in", F.lit("targets"))
            .unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit("costs"))))


def join_expected(metrics: DataFrame, catalogue: DataFrame, keys: Sequence[str] = ("symbol", "timeframe")) -> DataFrame:
    """Live metrics beside the expected ones (prefixed ``expected_``)."""
    exp = catalogue.select(*keys, *(F.col(c).alias(f"expected_{c}") for c in catalogue.columns if c not in keys))
    return metrics.join(exp, list(keys), "left")


def join_index_returns(yearly: DataFrame, returns: DataFrame, default: float = dims.DEFAULT_INDEX_RETURN) -> DataFrame:
    """Index return of the year, whether the strategy beat it, and by how much; returns in percent."""
    df = yearly.join(F.broadcast(returns), "year", "left")
    df = df.withColumn("index_return_pct", F.coalesce("index_return", F.lit(default)) * 100).drop("index_return")
    return df.withColumns({"beat_index": F.col("total_return_pct") > F.col("index_return_pct"),
                           "outperformance": F.col("total_return_pct") - F.col("index_return_pct")})


def signals_to_outcome(signals: DataFrame, prices: DataFrame, now: Column | None = None) -> DataFrame:
    """Compare each open signal with its symbol's latest price: target, stop, expired or open."""
    last = prices.groupBy("symbol").agg(F.max_by("close", "bar_ts").alias("current_price"), F.max("bar_ts").alias("price_ts"))
    df = signals.join(last, "symbol")
    long, px = F.col("direction") == "long", F.col("current_price")
    tp = F.when(long, px >= F.col("tp_price")).otherwise(px <= F.col("tp_price"))
    sl = F.when(long, px <= F.col("sl_price")).otherwise(px >= F.col("sl_price"))
    exit_px = F.when(tp, F.col("tp_price")).when(sl, F.col("sl_price"))
    move = exit_px - F.col("entry_price")
    late = (F.col("price_ts") if now is None else now) > F.col("expires_at")
    return df.withColumns({
        "status": F.when(tp, "take_profit").when(sl, "stop_loss").when(late, "expired").otherwise("open"),
        "exit_price": exit_px, "pnl": F.when(long, move).otherwise(-move)})
