"""Data audits and repairs. Audits return one row per key and check; nothing is collected."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.sessions import in_hours
from marketspark.operators.quantiles import exact_quantiles
from marketspark.operators.series import Series, blocked

KEYS = ("symbol", "timeframe")


def _seconds(c: Column) -> Column:
    return F.unix_timestamp(c.cast("timestamp"))


def audit_timestamps(df: DataFrame, ts: str, arrival: str, keys: Sequence[str] = KEYS, gap_days: int = 7, arrival_bucket: int = 4096) -> DataFrame:
    """Rows that go back in time in order of arrival, gaps over a week, count, start and end."""
    k = list(keys)
    rows = df.select(*k, ts, arrival)
    a = blocked(rows, back=1, keys=k, order=(arrival,), bucket=F.floor(F.col(arrival) / arrival_bucket))
    a = a.add(back=F.col(ts) < a.lag(ts)).rows().groupBy(*k).agg(
        F.count(F.lit(1)).alias("count"), F.min(ts).alias("start"), F.max(ts).alias("end"), F.count_if("back").alias("reversals"))
    g = blocked(rows.select(*k, ts).distinct(), back=1, keys=k, order=(ts,))
    g = g.add(gap=_seconds(F.col(ts)) - _seconds(g.lag(ts))).rows().groupBy(*k).agg(F.count_if(F.col("gap") > gap_days * 86400).alias("gaps"))
    return a.join(g, k).withColumn("passed", F.col("reversals") == 0)


def audit_duplicates(df: DataFrame, ts: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows beyond the first per (key, time)."""
    n = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.sum(F.col("_n") - 1).alias("duplicates")).withColumn("passed", F.col("duplicates") == 0)


def dedupe_keep_first(df: DataFrame, ts: str, arrival: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """First arrival per (key, time); partial aggregation keeps heavy duplicates cheap."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys, ts).agg(F.min_by(row, arrival).alias("_r")).select("_r.*")


def audit_lookahead(s: Series, label: str = "target", tail: int = 40, share: float = 0.2) -> DataFrame:
    """Labels set in the last ``tail`` rows, where no future is known, and columns named after the future."""
    named = [c for c in sorted(s.columns) if "future" in c.lower() or "forward" in c.lower()]
    last = s.add(tail_label=F.when(s.from_end < tail, F.col(label) != 0)).rows()
    df = last.groupBy(*s.keys).agg(F.count_if("tail_label").alias("labels_in_tail"))
    return df.withColumns({"suspicious_tail": F.col("labels_in_tail") > tail * share, "future_columns": F.lit(",".join(named)), "passed": F.lit(not named)})


#: fixed values: usual spread, commission and slippage as shares of price
SPREAD_METALS, SPREAD_FX, COMMISSION, SLIPPAGE = 0.0002, 0.00005, 0.00001, 0.000005


def audit_costs(quotes: DataFrame, metals: Sequence[str], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Configured cost totals and whether the median quoted spread is within half of the configured one."""
    med = exact_quantiles(quotes, keys, (F.col("ask") - F.col("bid")) / F.col("close"), {"actual_spread": 0.5})
    exp = F.when(F.col("symbol").isin(*metals), SPREAD_METALS).otherwise(SPREAD_FX)
    df = med.withColumn("expected_spread", exp)
    return df.withColumns({"total_cost_bps": (F.col("expected_spread") + COMMISSION + SLIPPAGE) * 10000,
                           "differs": F.abs(F.col("actual_spread") - F.col("expected_spread")) > F.col("expected_spread") * 0.5})


def audit_sessions(bars: DataFrame, hours: dict[str, tuple[int, int]], keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Share of bars inside the symbol's hours; a session may wrap midnight."""
    h = F.hour("bar_ts")
    inside = None
    for sym, (a, b) in hours.items():
        c = F.col("symbol") == sym
        inside = F.when(c, in_hours(h, a, b)) if inside is None else inside.when(c, in_hours(h, a, b))
    df = bars.withColumn("_in", inside).groupBy(*keys).agg(F.avg(F.col("_in").cast("double")).alias("_s"), F.count_if(~F.col("_in")).alias("bars_outside"))
    return df.select(*keys, (F.col("_s") * 100).alias("pct_in_session"), "bars_outside", F.coalesce(F.col("_s") < 0.5, F.lit(False)).alias("warning"))


def _long(df: DataFrame, keys: Sequence[str], feats: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """One row per key and feature from columns ``<part>_<feature>``."""
    items = F.array(*(F.struct(F.lit(f).alias("feature"), *(F.col(f"{p}_{f}").alias(p) for p in parts)) for f in feats))
    return df.select(*keys, F.inline(items))


def audit_outliers(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = KEYS, z: float = 5.0, share: float = 0.01) -> DataFrame:
    """Values beyond ``z`` standard deviations per feature; two one-pass aggregates over all features."""
    stats = df.groupBy(*keys).agg(*(F.avg(f).alias(f"m_{f}") for f in feats), *(F.stddev_samp(f).alias(f"s_{f}") for f in feats))
    j = df.join(stats, list(keys))
    far = {f: F.count_if(F.abs(F.col(f) - F.col(f"m_{f}")) > (F.col(f"s_{f}") + 1e-10) * z) for f in feats}
    agg = j.groupBy(*keys).agg(*(c.alias(f"outliers_{f}") for f, c in far.items()), *(F.count(f).alias(f"n_{f}") for f in feats))
    return _long(agg, keys, feats, ("outliers", "n")).withColumn("flagged", F.col("outliers") > F.col("n") * share)


def audit_missing(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = KEYS, limit_pct: float = 5.0) -> DataFrame:
    """Nulls per feature in one pass."""
    agg = df.groupBy(*keys).agg(*(F.count_if(F.col(f).isNull()).alias(f"missing_{f}") for f in feats), *(F.count(F.lit(1)).alias(f"n_{f}") for f in feats))
    out = _long(agg, keys, feats, ("missing", "n")).withColumn("missing_pct", F.col("missing") * 100.0 / F.col("n"))
    return out.withColumn("severity", F.when(F.col("missing_pct") > limit_pct, "error").when(F.col("missing") > 0, "warning").otherwise("ok"))


def audit_ohlc(bars: DataFrame, keys: Sequence[str] = KEYS, min_rows: int = 1000) -> DataFrame:
    """Impossible or absent prices and too few rows, in one pass."""
    c = F.col
    return bars.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(c("open").isNull() | c("high").isNull() | c("low").isNull() | c("close").isNull()).alias("null_ohlc"),
        F.count_if(c("high") < c("low")).alias("high_below_low"), F.count_if((c("close") > c("high")) | (c("close") < c("low"))).alias("close_outside"),
    ).withColumn("enough_rows", c("rows") >= min_rows).withColumn(
        "passed", (c("null_ohlc") == 0) & (c("high_below_low") == 0) & (c("close_outside") == 0) & c("enough_rows"))


def audit_report(checks: dict[str, tuple[DataFrame, Column, str]], keys: Sequence[str] = KEYS) -> DataFrame:
    """Stack of checks: ``name -> (audit, failed condition, severity)`` as (key, check, severity, failed)."""
    out = None
    for name, (df, failed, severity) in checks.items():
        row = df.groupBy(*keys).agg(F.max(failed).alias("failed")).select(*keys, F.lit(name).alias("check"), F.lit(severity).alias("severity"), "failed")
        out = row if out is None else out.unionByName(row)
    return out


def winsorize_quantile(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = KEYS, lower: float = 0.01, upper: float = 0.01) -> DataFrame:
    """Clip each feature to its own quantiles per key. All features go through one quantile pass and one join."""
    keys, feats = list(keys), list(feats)
    long = df.select(*keys, F.inline(F.array(*(F.struct(F.lit(i).alias("_f"), F.col(f).cast("double").alias("_value")) for i, f in enumerate(feats)))))
    cuts = exact_quantiles(long, [*keys, "_f"], "_value", {"_low": lower, "_high": 1 - upper})
    cuts = cuts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_f", F.struct("_low", "_high")))).alias("_cuts"))
    at = lambda i, end: F.col("_cuts")[F.lit(i)][end]
    clipped = {f: F.when(F.col(f).isNotNull(), F.greatest(at(i, "_low"), F.least(F.col(f), at(i, "_high")))) for i, f in enumerate(feats)}
    return df.join(cuts, keys, "left").withColumns(clipped).drop("_cuts")


def winsorize_z(df: DataFrame, feats: Sequence[str], keys: Sequence[str] = KEYS, z: float = 5.0) -> DataFrame:
    """Clip to ``z`` standard deviations around the mean; constant features stay."""
    stats = df.groupBy(*keys).agg(*(F.avg(f).alias(f"_m_{f}") for f in feats), *(F.stddev_samp(f).alias(f"_s_{f}") for f in feats))
    j = df.join(stats, list(keys))

    def clipped(f):
        m, sd, v = F.col(f"_m_{f}"), F.col(f"_s_{f}"), F.col(f)
        return F.when(v.isNull() | sd.isNull() | (sd < 1e-10), v).otherwise(F.greatest(m - sd * z, F.least(v, m + sd * z)))
    return j.withColumns({f: clipped(f) for f in feats}).select(*df.columns)


