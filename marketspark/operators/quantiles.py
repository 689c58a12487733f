"""Exact quantiles per group without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.session import stash

#: rank error of a round's sketch is (values left) / ACCURACY
ACCURACY = 10000
#: a round narrows a bracket to about 3 of so many parts of the values left in it
PARTS = 256
#: brackets are narrowed until each holds at most so many rows, then those are ranked
FEW = 50_000


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column | str, qs: dict[str, float], few: int = FEW) -> DataFrame:
    """One row per key with linearly interpolated quantiles named by ``qs``; null values do not count.

    Distributed selection. A round counts, for every key and quantile, the values below the bracket and those in it,
    and sketches the latter; the part of the sketch that holds the rank is the next bracket. Both fold before the
    shuffle, so a round moves as much for a hot key as for any other. Rounds end when every bracket holds ``few`` rows
    or fewer, or one value only; then these rows, their equals folded before the shuffle as well, are all that is sorted.
    """
    whole = not keys
    keys = list(keys) or ["_all"]
    df = df.withColumn("_all", F.lit(0)) if whole else df
    v = F.col(value) if isinstance(value, str) else value
    rows = stash(df.select(*keys, v.cast("double").alias("_v")).where(F.col("_v").isNotNull()), "values")
    names = list(enumerate(qs.items()))
    grid = [k / PARTS for k in range(PARTS + 1)]
    found = rows.withColumns({f"_{e}{i}": F.lit(float(x)) for i, _ in names for e, x in (("lo", "-inf"), ("hi", "inf"))})
    while True:
        told = [F.count("*").alias("_n")]
        for i, _ in names:
            own = F.col("_v").between(F.col(f"_lo{i}"), F.col(f"_hi{i}"))
            told += [F.first(f"_lo{i}").alias(f"_lo{i}"), F.first(f"_hi{i}").alias(f"_hi{i}"), F.count_if(F.col("_v") < F.col(f"_lo{i}")).alias(f"_below{i}"),
                     F.count_if(own).alias(f"_in{i}"), F.percentile_approx(F.when(own, F.col("_v")), grid, ACCURACY).alias(f"_s{i}")]
        g, wide = found.groupBy(*keys).agg(*told), F.lit(False)
        for i, (_, q) in names:
            lo, hi, many = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_in{i}")
            place = F.lit(q) * (F.col("_n") - 1) - F.col(f"_below{i}")
            a, b = F.floor(place / many * PARTS) - 1, F.ceil((place + 1) / many * PARTS) + 1  # a part more on both sides is far beyond the sketch's error
            low = F.when(a >= 0, F.greatest(lo, F.get(f"_s{i}", a.cast("int")))).otherwise(lo)
            high = F.when(b <= PARTS, F.least(hi, F.get(f"_s{i}", b.cast("int")))).otherwise(hi)
            wide = wide | ((many > few) & ((low > lo) | (high < hi)))
            g = g.withColumns({f"_new_lo{i}": low, f"_new_hi{i}": high})
        g = g.select(*keys, "_n", *(F.col(f"_new_{e}{i}").alias(f"_{e}{i}") for i, _ in names for e in ("lo", "hi")), wide.alias("_wide"))
        g = stash(g, "brackets")
        known = g.drop("_wide")
        if not g.where("_wide").limit(1).count():
            return _ranked(rows, keys, known, names, list(qs), whole)
        found = rows.join(known.drop("_n"), keys)


def _ranked(rows: DataFrame, keys: list[str], known: DataFrame, names: list, order: list[str], whole: bool) -> DataFrame:
    """The quantiles, from the values inside the brackets and the counts below them."""
    x = rows.join(known, keys)
    zone = lambda i: F.when(F.col("_v") < F.col(f"_lo{i}"), -1).when(F.col("_v") > F.col(f"_hi{i}"), 1).otherwise(0)
    tag = F.array(*(F.struct(F.lit(n).alias("_q"), (F.lit(q) * (F.col("_n") - 1)).alias("_r"), zone(i).alias("_z"), F.when(zone(i) == 0, F.col("_v")).alias("_k")) for i, (n, q) in names))
    x = x.select(*keys, F.inline(tag)).where("_z <= 0")
    g = x.groupBy(*keys, "_q", "_r", "_z", "_k").agg(F.count("*").alias("_c"))  # all below a bracket is one row
    g = g.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*keys, "_q").orderBy("_z", "_k")))
    at = lambda rank: F.min(F.when((F.col("_cum") > rank) & (F.col("_z") == 0), F.col("_k")))
    res = g.groupBy(*keys, "_q", "_r").agg(at(F.floor("_r")).alias("_lo"), at(F.ceil("_r")).alias("_hi"))
    res = res.withColumn("_x", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (F.col("_r") - F.floor("_r"))))
    out = res.groupBy(*keys).pivot("_q", order).agg(F.first("_x"))
    return out.drop("_all") if whole else out
