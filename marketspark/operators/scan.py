"""Two-level running aggregates: sums, maxima, products and last values from the start of a series.

An unbounded-preceding window over a hot key runs in one task. Here rows are cut into time
buckets, each bucket is folded to one row, the small bucket table is scanned per key, and what
came before is joined back on (key, bucket) and combined with a window inside the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketspark.session import materialize


def range_bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int, name: str = "_bkt") -> DataFrame:
    """Rows with a bucket number from balanced ranges of (keys, order), for data where a key's day is itself too large.

    Range bounds come from a sample, so the numbered rows are written before anything reads them twice.
    """
    cut = df.repartitionByRange(buckets, *keys, *order).withColumn(name, F.spark_partition_id())
    return materialize(cut)


def day_of(c: str) -> Column:
    return F.col(c).cast("date")


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | None = None,
            sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, products: dict[str, Column] | None = None,
            peaks: dict[str, str] | None = None, counts: dict[str, Column] | None = None,
            floor: float | None = None) -> DataFrame:
    """Add running aggregates named by the given dictionaries.

    ``lasts`` keeps the last non-null value. ``counts`` counts rows where the condition holds.
    ``peaks={name: sum_name}`` is the running maximum of a running sum (or product) of this call;
    ``floor`` is a lower bound every peak starts from. ``order`` must be a total order per key.
    """
    sums = {**(sums or {}), **{n: c.cast("long") for n, c in (counts or {}).items()}}
    maxes, lasts, products, peaks = maxes or {}, lasts or {}, products or {}, peaks or {}
    keys, order = list(keys), list(order)
    given = df.columns
    src = {**sums, **maxes, **lasts, **products}
    bucket = F.col("_bkt") if bucket is None and "_bkt" in given else bucket
    base = df.withColumns({"_bkt": day_of(order[0]) if bucket is None else bucket,
                           **{f"_x_{n}": c for n, c in src.items()}})
    inner = (Window.partitionBy(*keys, "_bkt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    x = {n: F.col(f"_x_{n}") for n in src}
    local = {**{f"_l_{n}": F.sum(x[n]).over(inner) for n in sums},
             **{f"_l_{n}": F.max(x[n]).over(inner) for n in maxes},
             **{f"_l_{n}": F.last(x[n], True).over(inner) for n in lasts},
             **{f"_l_{n}": F.product(x[n]).over(inner) for n in products}}
    rows = base.withColumns(local)
    if peaks:
        rows = rows.withColumns({f"_m_{n}": F.max(f"_l_{of}").over(inner) for n, of in peaks.items()})
    stamp = F.struct(*order)
    fold = [*(F.sum(x[n]).alias(f"_t_{n}") for n in sums), *(F.max(x[n]).alias(f"_t_{n}") for n in maxes),
            *(F.max_by(x[n], F.when(x[n].isNotNull(), stamp)).alias(f"_t_{n}") for n in lasts),
            *(F.product(x[n]).alias(f"_t_{n}") for n in products),
            *(F.max(f"_m_{n}").alias(f"_tm_{n}") for n in peaks)]
    before = Window.partitionBy(*keys).orderBy("_bkt").rowsBetween(Window.unboundedPreceding, -1)
    zero, one = F.lit(0.0), F.lit(1.0)
    table = rows.groupBy(*keys, "_bkt").agg(*fold)
    prev = {**{f"_b_{n}": F.sum(f"_t_{n}").over(before) for n in sums},
            **{f"_b_{n}": F.max(f"_t_{n}").over(before) for n in maxes},
            **{f"_b_{n}": F.last(f"_t_{n}", True).over(before) for n in lasts},
            **{f"_b_{n}": F.product(F.col(f"_t_{n}")).over(before) for n in products}}
    table = table.withColumns(prev)
    if peaks:
        absolute = {n: (F.coalesce(F.col(f"_b_{of}"), zero) + F.col(f"_tm_{n}")) if of in sums
                    else F.coalesce(F.col(f"_b_{of}"), one) * F.col(f"_tm_{n}") for n, of in peaks.items()}
        table = table.withColumns({f"_a_{n}": c for n, c in absolute.items()})
        table = table.withColumns({f"_bm_{n}": F.max(f"_a_{n}").over(before) for n in peaks})
    table = table.select(*keys, "_bkt", *prev, *(f"_bm_{n}" for n in peaks))
    joined = rows.join(table, [*keys, "_bkt"])
    out: dict[str, Column] = {}
    for n in sums:
        out[n] = F.coalesce(F.col(f"_b_{n}"), F.lit(0)) + F.coalesce(F.col(f"_l_{n}"), F.lit(0))
    for n in maxes:
        out[n] = F.greatest(f"_b_{n}", f"_l_{n}")
    for n in lasts:
        out[n] = F.coalesce(f"_l_{n}", f"_b_{n}")
    for n in products:
        out[n] = F.coalesce(F.col(f"_b_{n}"), one) * F.col(f"_l_{n}")
    for n, of in peaks.items():
        here = (F.coalesce(F.col(f"_b_{of}"), zero) + F.col(f"_m_{n}")) if of in sums \
            else F.coalesce(F.col(f"_b_{of}"), one) * F.col(f"_m_{n}")
        out[n] = F.greatest(here, F.col(f"_bm_{n}"), *([F.lit(floor)] if floor is not None else []))
    return joined.select(*(F.col(c) for c in given if c not in out and c != "_bkt"), *(c.alias(n) for n, c in out.items()))
