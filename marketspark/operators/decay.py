"""Decayed running sums ``y_t = exp(-d_t) y_{t-1} + b_t`` as windows, for any decays and any length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: a step's decay is cut here: what is older weighs less than exp(-280) = 1e-122
MOST = 280.0
#: rows are summed together while their decays add up to this; exp of it is still a double, and a step cannot skip it
_REACH = 300.0


def decayed(df: DataFrame, part: Sequence[str], order: Sequence[str], scans: dict[str, tuple[str, dict[str, str]]]) -> DataFrame:
    """``df`` with ``_D_<name>``, the decay summed over the partition, and the decayed sums of every scan
    ``name: (decay column, {new column: added column})``. The last column of ``order`` numbers the rows.

    Rows are cut into stretches by the summed decay, not by count. Scaled by its stretch a row's weight is a double
    that neither over- nor underflows, and only the stretch before can still weigh on a row: what lies two stretches
    back has lost exp(-300). Null decays count as zero, null additions as nothing.
    """
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_D_{n}": F.sum(F.least(F.coalesce(F.col(d), F.lit(0.0)), F.lit(MOST))).over(upto) for n, (d, _) in scans.items()})
    df = df.withColumns({f"_g_{n}": F.floor(F.col(f"_D_{n}") / _REACH) for n in scans})
    here = {n: F.col(f"_D_{n}") - F.col(f"_g_{n}") * _REACH for n in scans}
    inner = {n: Window.partitionBy(*part, f"_g_{n}").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0) for n in scans}
    df = df.withColumns({f"_s_{c}": F.coalesce(F.sum(F.col(b) * F.exp(here[n])).over(inner[n]), F.lit(0.0)) for n, (_, adds) in scans.items() for c, b in adds.items()})
    # what the stretch before came to; its rows are one frame for all rows of a stretch, and already in order
    past = {n: Window.partitionBy(*part).orderBy(f"_g_{n}").rangeBetween(-1, -1) for n in scans}
    df = df.withColumns({f"_t_{c}": F.coalesce(F.max_by(f"_s_{c}", order[-1]).over(past[n]), F.lit(0.0)) for n, (_, adds) in scans.items() for c in adds})
    df = df.withColumns({c: F.exp(-here[n]) * F.col(f"_s_{c}") + F.exp(-here[n] - _REACH) * F.col(f"_t_{c}") for n, (_, adds) in scans.items() for c in adds})
    return df.drop(*(f"_g_{n}" for n in scans), *(f"_{k}_{c}" for _, adds in scans.values() for c in adds for k in "st"))


def step_decay(age: Column, alpha: float, rate: float, adjust: bool) -> Column:
    """Decay of the old value at a value ``age`` rows after the one before, ``rate`` = -ln(1 - alpha).

    The old weight is ``p = exp(-rate * age)``; an adjusted average decays by it, another takes the new value at
    ``alpha`` against ``p``.
    """
    lost = age * rate
    if adjust:
        return F.least(lost, F.lit(MOST))
    return F.when(age == 1, F.lit(min(rate, MOST))).otherwise(F.least(lost + F.ln(F.exp(-lost) + alpha), F.lit(MOST)))
