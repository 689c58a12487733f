"""Feature screening: leakage, look-ahead, collinearity, null share, predictiveness, and time splits."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.functions import rolling as R
from marketspark.functions.rolling import div
from marketspark.operators.comoments import correlations
from marketspark.operators.series import Series

KEYS = ("symbol", "timeframe")


def agg_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate over pairs, null when a side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _rows(df: DataFrame, keys: Sequence[str], feats: Sequence[str], parts: dict) -> DataFrame:
    """One aggregate for all features, then one row per key and feature."""
    agg = df.groupBy(*keys).agg(*(fn(f).alias(f"{p}__{f}") for f in feats for p, fn in parts.items()))
    items = F.array(*(F.struct(F.lit(f).alias("feature"), *(F.col(f"{p}__{f}").alias(p) for p in parts)) for f in feats))
    return agg.select(*keys, F.inline(items))


def leakage_check(s: Series, feats: Sequence[str], target: str = "target", limit: float = 0.25, peek: float = 0.15) -> DataFrame:
    """Correlation with the target and with the next return, and constant features."""
    s = s.add(next_return=div(s.lead("close"), "close") - 1)
    out = _rows(s.rows(), s.keys, feats, {
        "target_corr": lambda f: agg_corr(F.col(f).cast("double"), F.col(target).cast("double")),
        "next_corr": lambda f: agg_corr(F.col(f).cast("double"), F.col("next_return")),
        "constant": lambda f: F.coalesce(F.min(f) == F.max(f), F.lit(True))})
    return out.withColumns({"suspicious": F.coalesce(F.abs("target_corr") > limit, F.lit(False)), "peeking": F.coalesce(F.abs("next_corr") > peek, F.lit(False))})


@dataclass(frozen=True)
class LookaheadPreset:
    """Limits on correlation with returns ``h`` rows ahead, and on future against past correlation."""
    ahead: dict[int, float]
    past: int | None = None
    ratio: float = 0.0
    floor: float = 0.0
    sign_limit: float | None = None


#: fixed values: the screening presets
LOOKAHEAD = {
    "balanced": LookaheadPreset({5: 0.03}, past=5, ratio=2.0, floor=0.02),
    "ultra_strict": LookaheadPreset({1: 0.03, 3: 0.03, 5: 0.03}, past=5, ratio=1.5, floor=0.02),
    "strict": LookaheadPreset({1: 0.04, 3: 0.04, 5: 0.04, 10: 0.04}, past=10, ratio=1.5, floor=0.03),
    "direction": LookaheadPreset({1: 0.05, 5: 0.04}, sign_limit=0.08),
}


def lookahead_test(s: Series, feats: Sequence[str], preset: LookaheadPreset) -> DataFrame:
    """Flag features that correlate with future returns more than a past-only feature should."""
    far = sorted({*preset.ahead, *([preset.past] if preset.past else [])})
    s = s.add(**{f"fwd_{h}": div(s.lead("close", h), "close") - 1 for h in far})
    if preset.past:
        s = s.add(past_ret=R.pct_change(s, "close", preset.past))
    x = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    parts = {f"corr_{h}": (lambda f, h=h: F.abs(agg_corr(x(f), F.col(f"fwd_{h}")))) for h in far}
    if preset.past:
        parts["past_corr"] = lambda f: F.abs(agg_corr(x(f), F.col("past_ret")))
    if preset.sign_limit:
        parts["sign_corr"] = lambda f: F.abs(agg_corr(x(f), F.signum(F.col("fwd_5"))))
    out = _rows(s.rows(), s.keys, feats, parts)
    bad = F.lit(False)
    for h, lim in preset.ahead.items():
        bad = bad | F.coalesce(F.col(f"corr_{h}") > lim, F.lit(False))
    if preset.past:
        fut = F.col(f"corr_{preset.past}")
        bad = bad | F.coalesce((fut > F.col("past_corr") * preset.ratio) & (fut > preset.floor), F.lit(False))
    if preset.sign_limit:
        bad = bad | F.coalesce(F.col("sign_corr") > preset.sign_limit, F.lit(False))
    return out.withColumn("suspicious", bad)


def collinear(df: DataFrame, feats: Sequence[str], threshold: float = 0.95, keys: Sequence[str] = KEYS) -> DataFrame:
    """Features an earlier feature (kept or not) correlates with beyond the threshold are dropped.

    All pairs come from one reading of the rows, see :func:`~marketspark.operators.comoments.correlations`.
    """
    feats = list(feats)
    if len(feats) < 2:
        return df.select(*keys).distinct().select(*keys, F.lit(feats[0]).alias("feature"), F.lit(None).cast("double").alias("max_corr"), F.lit(True).alias("keep"))
    own = F.struct(F.col("b").alias("feature"), F.abs("corr").alias("max_corr"))
    first = F.struct(F.lit(feats[0]).alias("feature"), F.lit(None).cast("double").alias("max_corr"))  # it has no earlier one
    rows = F.when((F.col("a") == feats[0]) & (F.col("b") == feats[1]), F.array(own, first)).otherwise(F.array(own))
    best = correlations(df, feats, keys).select(*keys, F.inline(rows)).groupBy(*keys, "feature").agg(F.max("max_corr").alias("max_corr"))
    return best.withColumn("keep", F.coalesce(F.col("max_corr") <= threshold, F.lit(True)))


#: fixed values: columns that are never features, name parts that hint at structure-based features
NOT_FEATURES = ("timestamp", "bar_ts", "open", "high", "low", "close", "volume", "target", "expected_return", "expected_duration", "tp_hit", "sl_hit")
STRUCTURE_NAMES = ("swing", "fvg", "ob_", "bos", "choch", "eq_", "order_block", "orderblock", "fair_value", "fairvalue", "liquidity", "liq_", "inducement",
                   "mitigation", "breaker", "rejection", "displacement", "imbalance", "void", "gap", "premium", "discount", "optimal_entry")
TREND_WORDS = ("mom", "trend", "adx", "ma_sep", "dist_ema", "hh", "ll")


def candidate_features(df: DataFrame, exclude: Sequence[str] = STRUCTURE_NAMES) -> list[str]:
    """Numeric columns that are neither inputs nor labels nor named after an excluded pattern."""
    num = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float", "integer", "long", "short", "byte")]
    return [c for c in num if c not in NOT_FEATURES and not any(p in c.lower() for p in exclude)]


def prioritized(feats: Sequence[str], words: Sequence[str] = TREND_WORDS, first: int = 25, rest: int = 15) -> list[str]:
    """First trend-named features, then others."""
    hot = [f for f in feats if any(w in f.lower() for w in words)]
    return hot[:first] + [f for f in feats if f not in hot][:rest]


def null_fraction(df: DataFrame, feats: Sequence[str], limit: float = 0.5) -> DataFrame:
    """Null share per feature over all rows and whether it may stay."""
    agg = df.agg(*(F.avg(F.col(f).isNull().cast("double")).alias(f) for f in feats))
    items = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("null_fraction")) for f in feats))
    return agg.select(F.inline(items)).withColumn("keep", F.col("null_fraction") < limit)


def predictiveness(s: Series, feats: Sequence[str], top: int = 40) -> DataFrame:
    """Mean absolute correlation with returns 5, 10 and 20 rows ahead, best features of each series first."""
    s = s.add(**{f"fwd_{h}": div(s.lead("close", h), "close") - 1 for h in (5, 10, 20)})
    out = _rows(s.rows(), s.keys, feats, {f"corr_{h}": (lambda f, h=h: F.abs(agg_corr(F.col(f).cast("double"), F.col(f"fwd_{h}")))) for h in (5, 10, 20)})
    out = out.withColumn("avg_corr", (F.col("corr_5") + F.col("corr_10") + F.col("corr_20")) / 3)
    # features per series are bounded by the schema, so this ranking is small
    rank = F.row_number().over(Window.partitionBy(*s.keys).orderBy(F.col("avg_corr").desc_nulls_last(), "feature"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top)


# ---- time splits --------------------------------------------------------------------------
#: fixed values: folds, embargo and purge rows of the walk-forward presets
WALK_FORWARD = {"ten": (10, 100, 50), "six": (6, 50, 25), "eight": (8, 100, 50)}


def walk_forward_splits(s: Series, folds: int, embargo: int, purge: int, min_train: int = 100, min_val: int = 20) -> DataFrame:
    """Rows with the folds they train or validate; training is all rows before validation less ``purge``."""
    df = s.rows(keep_index=True).withColumn("_size", F.floor(F.col("_total") / (folds + 1)))
    sz, i, n = F.col("_size"), F.col("_i"), F.col("_total")
    val = F.floor(i / sz) - 1
    first = F.greatest(F.lit(0), F.floor((i + purge) / sz))
    train = F.when(first <= folds - 1, F.transform(F.sequence(first, F.lit(folds - 1)), lambda k: F.struct(k.cast("int").alias("fold"), F.lit("train").alias("part"))))
    held = F.when((val >= 0) & (val < folds) & (i < n - embargo), F.array(F.struct(val.cast("int").alias("fold"), F.lit("val").alias("part"))))
    empty = F.array().cast("array<struct<fold:int,part:string>>")
    df = df.where(sz > 0).withColumn("_f", F.explode(F.concat(F.coalesce(train, empty), F.coalesce(held, empty))))
    df = df.withColumns({"fold": F.col("_f.fold"), "part": F.col("_f.part")})
    start = (F.col("fold") + 1) * sz
    ok = (start - purge > min_train) & (F.least(start + sz, n - embargo) - start > min_val)
    return df.where(ok).drop("_f", "_size", "_i", "_total")


def fold_dates(splits: DataFrame, ts: str = "bar_ts", keys: Sequence[str] = KEYS) -> DataFrame:
    return splits.groupBy(*keys, "fold", "part").agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("rows"))


def split_overlap_check(train: DataFrame, test: DataFrame, ts: str = "exit_time", keys: Sequence[str] = KEYS) -> DataFrame:
    """Whether the test period starts after training ends, and the gap in days."""
    a = train.groupBy(*keys).agg(F.min(ts).alias("train_start"), F.max(ts).alias("train_end"))
    b = test.groupBy(*keys).agg(F.min(ts).alias("test_start"), F.max(ts).alias("test_end"))
    df = a.join(b, list(keys))
    return df.withColumns({"overlap": F.col("test_start") <= F.col("train_end"), "gap_days": F.datediff("test_start", "train_end")})


def implausible(metrics: DataFrame) -> DataFrame:
    """Results too good to be true."""
    c = F.col
    return metrics.withColumn("issues", F.array_compact(F.array(F.when(c("win_rate") > 75, "win_rate"), F.when(c("profit_factor") > 5, "profit_factor"),
                                                               F.when(c("max_drawdown_pct") < 1, "drawdown"), F.when(c("sharpe_ratio") > 5, "sharpe"))))


def train_oos_split(df: DataFrame, train_end: Column, oos_months: int, ts: str = "bar_ts") -> tuple[DataFrame, DataFrame]:
    """Rows up to ``30 * oos_months`` days before the end, and the rows from there to the end."""
    cut = train_end - F.make_dt_interval(days=F.lit(30 * oos_months))
    return df.where(F.col(ts) < cut), df.where((F.col(ts) >= cut) & (F.col(ts) <= train_end))
