"""All pairwise correlations of many columns in one pass: a blocked Gram matrix of mergeable co-moments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: columns of a tile; a tile of two column groups is what is shuffled and merged, about 200 kB
TILE = 64
#: numbers a task holds for keys it has met before it passes them on
HELD = 16_000_000


def comoments(x: np.ndarray) -> np.ndarray:
    """(n, mean of a, mean of b, co-moment, squared deviations of a, of b) for every pair of columns of ``x``, over the
    rows where both have a value (NaN: none).

    Columns are moved to their means first, so products do not cancel; a pair's own means, over its rows, then come off.
    """
    has = ~np.isnan(x)
    shift = np.where(has, x, 0.0).sum(axis=0) / np.maximum(has.sum(axis=0), 1)
    y, m = np.where(has, x - shift, 0.0), has.astype(float)
    n = m.T @ m
    a = (y.T @ m) / np.maximum(n, 1)
    raw = (y * y).T @ m
    v = raw - n * a * a
    v = np.where(v <= 1e-13 * raw, 0.0, v)  # what is left of a constant is rounding
    return np.stack([n, a + shift[:, None], a.T + shift[None, :], y.T @ y - n * a * a.T, v, v.T])


def merged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Co-moments (n, mean a, mean b, co-moment, deviations of a, of b) of two sets of rows together."""
    n = p[0] + q[0]
    w = np.divide(p[0] * q[0], n, out=np.zeros_like(n), where=n > 0)
    share = np.divide(q[0], n, out=np.zeros_like(n), where=n > 0)
    da, db = np.where(p[0] * q[0] > 0, q[1] - p[1], 0.0), np.where(p[0] * q[0] > 0, q[2] - p[2], 0.0)
    first = p[0] > 0
    return np.stack([n, np.where(first, p[1] + da * share, q[1]), np.where(first, p[2] + db * share, q[2]),
                     p[3] + q[3] + da * db * w, p[4] + q[4] + da * da * w, p[5] + q[5] + db * db * w])


def correlations(df: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, a, b, n, corr) for every pair of ``cols``, a before b, over the rows where both have a value.

    One reading of ``df``, however many columns. A task adds up its rows' co-moments for each key; column groups of
    TILE meet as tiles, which are merged by (key, tile), so neither a hot key nor a wide table is one task. A constant
    side or fewer than two common rows give null.
    """
    cols, keys = list(cols), list(keys)
    groups = [(i, cols[i:i + TILE]) for i in range(0, len(cols), TILE)]
    p = len(cols)

    def fold(batches):
        held: dict[tuple, np.ndarray] = {}
        raw: dict[tuple, pa.RecordBatch] = {}

        def out():
            for k, t in held.items():
                at = [(i, j) for i, _ in groups for j, _ in groups if i <= j]
                blobs = [np.ascontiguousarray(t[:, i:i + TILE, j:j + TILE]).tobytes() for i, j in at]
                one = raw[k]
                yield pa.RecordBatch.from_arrays([*(one.column(c).take(pa.array(np.zeros(len(at), np.int64))) for c in keys),
                                                  pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), pa.array(blobs, pa.binary())], names=[*keys, "_ti", "_tj", "_m"])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in cols], axis=1)
            names = list(zip(*(batch.column(c).to_pylist() for c in keys))) if keys else [()] * batch.num_rows
            number: dict[tuple, int] = {}
            code = np.array([number.setdefault(k, len(number)) for k in names])
            for k, i in number.items():
                rows = np.flatnonzero(code == i) if len(number) > 1 else slice(None)
                t = comoments(x[rows])
                held[k] = merged(held[k], t) if k in held else t
                raw.setdefault(k, batch.slice(names.index(k), 1).select(keys))
            if len(held) * 6 * p * p > HELD:
                yield from out()
                held, raw = {}, {}
        yield from out()

    def merge(table: pa.Table) -> pa.Table:
        i, j = table.column("_ti")[0].as_py(), table.column("_tj")[0].as_py()
        h, w = min(TILE, p - i), min(TILE, p - j)
        t = None
        for blob in table.column("_m"):
            q = np.frombuffer(blob.as_buffer()).reshape(6, h, w)
            t = q if t is None else merged(t, q)
        a, b = np.nonzero(np.add.outer(np.arange(i, i + h), -np.arange(j, j + w)) < 0)
        n, c, va, vb = t[0, a, b], t[3, a, b], t[4, a, b], t[5, a, b]
        least = [n * (1e-14 * t[k, a, b]) ** 2 for k in (1, 2)]  # means of a constant may differ in the last digit
        ok = (n > 1) & (va > least[0]) & (vb > least[1])
        with np.errstate(invalid="ignore", divide="ignore"):
            corr = np.where(ok, c / np.sqrt(va * vb), np.nan)
        zero = pa.array(np.zeros(len(a), np.int64))
        return pa.table([*(table.column(k).take(zero) for k in keys), pa.array([cols[i + k] for k in a], pa.string()), pa.array([cols[j + k] for k in b], pa.string()),
                         pa.array(n.astype(np.int64)), pa.array(corr, mask=~ok)], names=[*keys, "a", "b", "n", "corr"])
    key = df.select(*keys).schema
    ddl = lambda more: ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in key), more])
    rows = df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols))
    tiles = rows.mapInArrow(fold, ddl("_ti int, _tj int, _m binary"))
    return tiles.groupBy(*keys, "_ti", "_tj").applyInArrow(merge, ddl("a string, b string, n long, corr double"))
