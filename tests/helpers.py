"""Small bar tables for tests."""

import datetime as dt

import numpy as np

T0 = dt.datetime(2024, 1, 1)
BAR = "symbol string, timeframe string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"


def bars(spark, rows, symbol="S0", tf="1H", step=3600):
    """rows: (open, high, low, close, volume) in time order."""
    data = [(symbol, tf, T0 + dt.timedelta(seconds=step * i), *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, BAR)


def closes(spark, xs, **k):
    return bars(spark, [(x, x + 1, x - 1, x, 5) for x in xs], **k)


def walk(n, seed=1):
    rng = np.random.default_rng(seed)
    c = 200 + np.cumsum(rng.normal(0, 1, n))
    o = c + rng.normal(0, 0.5, n)
    return [(a, max(a, b) + abs(h), min(a, b) - abs(lo), b, v) for a, b, h, lo, v in
            zip(o, c, rng.normal(0, 0.7, n), rng.normal(0, 0.7, n), rng.integers(1, 50, n))]


def column(df, name, order="bar_ts"):
    return [r[name] for r in df.orderBy(order).select(name).collect()]
