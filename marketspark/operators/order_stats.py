"""Quantiles and ranks of moving frames of any length, at a cost a row that does not depend on the length.

A block's values are ranked once and put into a wavelet matrix: one bit a level, stably partitioned by it, with
running counts of ones. A frame is a range of positions; following its ends through the levels finds the k-th value
in it, or how many of its values are smaller, in as many steps as ranks have bits. All rows take a step together.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stat:
    """``kind`` (quantile, rank, below) of ``column`` over the last ``n`` rows, null with fewer than ``need`` values."""

    kind: str
    column: str
    n: int
    need: int
    q: float = 0.0


class Wavelet:
    """Order statistics of any range of positions of ``values`` (no NaN)."""

    def __init__(self, values: np.ndarray):
        self.values, self.rank = np.unique(values, return_inverse=True)
        self.rank, cur = self.rank.astype(np.int64), self.rank.astype(np.int64)
        self.levels = []
        for b in reversed(range(len(self.values).bit_length())):
            bit = (cur >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit)))
            self.levels.append((b, ones, len(cur) - int(ones[-1])))
            cur = np.concatenate((cur[bit == 0], cur[bit == 1]))

    def kth(self, lo: np.ndarray, hi: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest (from 0) of positions lo..hi-1; k below hi - lo."""
        r = np.zeros(len(k), np.int64)
        for b, ones, zeros in self.levels:
            a, z = ones[lo], ones[hi]
            small = (hi - lo) - (z - a)
            up = k >= small
            k = np.where(up, k - small, k)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
            r |= up.astype(np.int64) << b
        return self.values[r]

    def below(self, lo: np.ndarray, hi: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """How many of positions lo..hi-1 have a rank below ``rank``."""
        n = np.zeros(len(rank), np.int64)
        for b, ones, zeros in self.levels:
            a, z = ones[lo], ones[hi]
            up = (rank >> b) & 1 == 1
            n += np.where(up, (hi - lo) - (z - a), 0)
            lo, hi = np.where(up, zeros + a, lo - a), np.where(up, zeros + z, hi - z)
        return n


def moving(x: np.ndarray, stats: Sequence[Stat]) -> list[np.ndarray]:
    """The statistics for every position of one block's column ``x`` (NaN: no value)."""
    has = ~np.isnan(x)
    seen = np.concatenate(([0], np.cumsum(has)))
    w = Wavelet(x[has])
    out = []
    for s in stats:
        res = np.full(len(x), np.nan)
        hi, lo = seen[1:], seen[np.maximum(np.arange(len(x)) - s.n + 1, 0)]
        at = np.flatnonzero((hi - lo >= max(s.need, 1)) & (has if s.kind != "quantile" else True))
        lo, hi = lo[at], hi[at]
        if s.kind == "quantile":
            place = (hi - lo - 1) * s.q
            k = np.floor(place).astype(np.int64)
            a, b = w.kth(lo, hi, k), w.kth(lo, hi, np.ceil(place).astype(np.int64))
            with np.errstate(invalid="ignore"):
                res[at] = np.where(a == b, a, (k + 1 - place) * a + (place - k) * b)
        else:
            own = w.rank[hi - 1]
            less = w.below(lo, hi, own)
            res[at] = less / s.n if s.kind == "below" else (less + (w.below(lo, hi, own + 1) - less + 1) / 2) / s.n
        out.append(res)
    return out


def with_stats(df: DataFrame, part: Sequence[str], order: Sequence[str], stats: dict[str, Stat]) -> DataFrame:
    """``df``, whose blocks ``part`` each lie in one task, with the statistics as columns.

    A task's rows pass through in Arrow batches; a block (a bounded number of rows) is held until it is whole. The
    result of a row depends on the rows around it, so the function is marked as not deterministic: no filter may be
    moved in front of it.
    """
    cols = list(dict.fromkeys(s.column for s in stats.values()))

    @F.pandas_udf(", ".join(f"`{n}` double" for n in stats))
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        held: list[list[np.ndarray]] = []

        def done() -> pd.DataFrame:
            by = dict(zip(cols, (np.concatenate(c) for c in zip(*held))))
            out = {}
            for c, x in by.items():
                own = {n: s for n, s in stats.items() if s.column == c}
                out |= dict(zip(own, moving(x, list(own.values()))))
            return pd.DataFrame({n: out[n] for n in stats})
        block = None
        for key, *xs in batches:
            key, xs = key.to_numpy(), [x.to_numpy(np.float64, na_value=np.nan) for x in xs]
            cut = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cut, cut[1:]):
                if a < b:
                    if key[a] != block and held:
                        yield done()
                        held = []
                    block = key[a]
                    held.append([x[a:b] for x in xs])
        if held:
            yield done()
    values = run.asNondeterministic()(F.xxhash64(*part), *(F.col(c).cast("double") for c in cols))
    df = df.sortWithinPartitions(*part, *order).withColumn("_stats", values)
    return df.select("*", *(F.col(f"_stats.`{n}`").alias(n) for n in stats)).drop("_stats")
