"""Writers and table maintenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketspark.schema import KEYS, ORDER


def write_feature_store(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by symbol and timeframe. Rows are spread by month first, so a large symbol is written by many tasks;
    only partitions present in ``df`` are replaced."""
    month = F.trunc(F.col(ORDER).cast("date"), "month")
    (df.repartition(*KEYS, month).sortWithinPartitions(*KEYS, ORDER).write.mode(mode)
     .option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(path))


def append_dedupe(existing: DataFrame, new: DataFrame, keys: Sequence[str] = (*KEYS, ORDER)) -> DataFrame:
    """Union that keeps the new row where a key is in both. Rows fold per task before the shuffle."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    row = F.struct(*existing.columns)
    return both.groupBy(*keys).agg(F.max_by(row, F.col("_p")).alias("_r")).select("_r.*")


def append_newer_only(existing: DataFrame, new: DataFrame, keys: Sequence[str] = KEYS, ts: str = ORDER) -> DataFrame:
    """Existing rows plus new rows later than the newest existing row of their series."""
    last = existing.groupBy(*keys).agg(F.max(ts).alias("_last"))
    fresh = new.join(last, list(keys), "left").where(F.col("_last").isNull() | (F.col(ts) > F.col("_last"))).drop("_last")
    return existing.unionByName(fresh)


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key is not in the source, plus the source."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def expire_rows(df: DataFrame, ts: str, now: Column, days: int = 1) -> DataFrame:
    """Drop rows older than ``days`` and stamp the rest."""
    return df.where(F.col(ts) >= now - F.make_dt_interval(days=F.lit(days)))


def stamp_changes(target: DataFrame, source: DataFrame, keys: Sequence[str], now: Column) -> DataFrame:
    """Upsert that sets ``updated_at`` only where a value changed; unchanged rows keep their stamp."""
    vals = [c for c in target.columns if c not in (*keys, "updated_at")]
    a = target.select(*keys, F.struct(*vals).alias("_a"), F.col("updated_at").alias("_at"))
    b = source.select(*keys, F.struct(*vals).alias("_b"))
    j = a.join(b, list(keys), "full")
    row = F.coalesce(F.col("_b"), F.col("_a"))
    changed = F.col("_b").isNotNull() & (F.col("_a").isNull() | ~F.col("_a").eqNullSafe(F.col("_b")))
    return j.select(*keys, *(row[c].alias(c) for c in vals), F.when(changed, now).otherwise(F.col("_at")).alias("updated_at"))


def latest_features(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = ORDER) -> DataFrame:
    """Newest row per series."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), ts).alias("_r")).select("_r.*")


def feature_payload(df: DataFrame, features: Sequence[str], keys: Sequence[str] = (*KEYS, ORDER)) -> DataFrame:
    """Features as one JSON object and one map, nulls left out, with their number."""
    m = F.map_filter(F.map_from_arrays(F.array(*(F.lit(f) for f in features)), F.array(*(F.col(f).cast("double") for f in features))), lambda _, v: v.isNotNull())
    return df.select(*keys, m.alias("features"), F.to_json(F.struct(*features)).alias("payload")).withColumn("feature_count", F.size("features"))


def freshness(df: DataFrame, now: Column, keys: Sequence[str] = KEYS, ts: str = ORDER, max_days: int = 1) -> DataFrame:
    """Last time, days behind and whether a series is up to date."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.max(ts).alias("last_ts"))
    return g.withColumn("days_behind", F.datediff(now, F.col("last_ts"))).withColumn("up_to_date", F.col("days_behind") <= max_days)
