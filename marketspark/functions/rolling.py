"""Rolling-window columns over a blocked :class:`~marketspark.operators.series.Series`.

A window gives null until it holds enough non-null rows (all ``n`` unless ``min_rows`` says less).
Division by zero gives null. Comparisons with null count as false in flags.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketspark.operators.order_stats import Stat
from marketspark.operators.series import Series


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str | float, b: Column | str | float) -> Column:
    """``a / b``, null when ``b`` is zero."""
    a, b = (x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x)) for x in (a, b))
    return F.try_divide(a, b)


def flag(cond: Column) -> Column:
    """1 when the condition holds, 0 when it is false or unknown."""
    return F.coalesce(cond, F.lit(False)).cast("int")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Bound a value; null stays null."""
    return F.when(c.isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), c)))


#: longer frames are put together from shorter ones
LONG = 64
#: the shortest of these, which Spark sums row by row
SHORT = 16


def _back(s: Series, name: str, k: int, other: str) -> str:
    """The column ``k`` rows ago, ``other`` before the first row."""
    return f"lag(`{name}`, {k}, {other}) {s.over()}" if k else f"`{name}`"


def _doubled(s: Series, c: str, n: int, kind: str, first: str, step, other: str) -> list[tuple[int, str]]:
    """Columns over the last 16, 32, 64 ... rows, up to ``n``: each is put together from the one before at two places.

    Nothing is ever taken away, so values outside a frame, of whatever size, leave no trace in it; a frame of ``n``
    rows costs steps in the logarithm of ``n``.
    """
    size, out = SHORT, []
    while size <= n:
        name = f"_f{kind}{size}__{c}"
        s.ensure(**{name: step(out[-1][1], size // 2) if out else first})
        out.append((size, name))
        size *= 2
    return out


def _pieces(n: int, sizes: list[int]) -> list[tuple[int, int]]:
    """(size, rows ago) of frames that together are the last ``n`` rows; sizes of none of them come last, under SHORT."""
    out, at = [], 0
    while at < n:
        size = max((z for z in sizes if z <= n - at), default=n - at)
        out.append((size, at))
        at += size
    return out


def _seen(s: Series, c: str) -> str:
    """How many values the series has had; a frame's count is the difference of two, in whole numbers."""
    name = f"_fc__{c}"
    s.ensure(**{name: f"count(`{c}`) {s.over().removesuffix(')')} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})
    return name


def _moments(s: Series, c: str, n: int, end: int, squares: bool) -> tuple[str, str, str]:
    """(count, sum, squared deviations from the mean) of a long frame, as SQL text."""
    seen = _seen(s, c)

    def count(size: int, at: int) -> str:
        return f"({_back(s, seen, at, '0L')} - {_back(s, seen, at + size, '0L')})"

    def merged(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
        apart = f"({a[1]}) / {a[0]} - ({b[1]}) / {b[0]}"
        return f"({a[2]} + {b[2]} + CASE WHEN {a[0]} > 0 AND {b[0]} > 0 THEN ({apart}) * ({apart}) * {a[0]} * {b[0]} / ({a[0]} + {b[0]}) ELSE 0D END)"
    sums = _doubled(s, c, n, "s", f"coalesce(CAST(sum(`{c}`) {s.over(1 - SHORT)} AS DOUBLE), 0D)", lambda name, k: f"`{name}` + {_back(s, name, k, '0D')}", "0D")
    by = dict(sums)
    if squares:
        def step(name: str, k: int) -> str:
            one, two = ((count(k, at), _back(s, by[k], at, "0D"), _back(s, name, at, "0D")) for at in (0, k))
            return merged(one, two)
        dev = dict(_doubled(s, c, n, "d", f"coalesce(var_pop(`{c}`) {s.over(1 - SHORT)} * count(`{c}`) {s.over(1 - SHORT)}, 0D)", step, "0D"))
    total, out = "0L", None
    for size, at in _pieces(n, list(by)):
        o = s.over(end - at - size + 1, end - at)
        own = count(size, at - end)
        t = _back(s, by[size], at - end, "0D") if size in by else f"coalesce(CAST(sum(`{c}`) {o} AS DOUBLE), 0D)"
        d = "0D" if not squares else _back(s, dev[size], at - end, "0D") if size in by else f"coalesce(var_pop(`{c}`) {o} * {own}, 0D)"
        out = (own, t, d) if out is None else (f"({out[0]} + {own})", f"{out[1]} + {t}", merged(out, (own, t, d)) if squares else "0D")
    return count(n, -end), out[1], out[2]


def _long(s: Series, c: str, n: int, end: int, need: int, fn: str) -> Column:
    """A sum, mean, deviation or extreme over a long frame of a named column."""
    if fn in ("max", "min"):
        pick = "greatest" if fn == "max" else "least"
        size, name = _doubled(s, c, n, fn, f"{fn}(`{c}`) {s.over(1 - SHORT)}", lambda name, k: f"{pick}(`{name}`, {_back(s, name, k, 'NULL')})", "NULL")[-1]
        seen = _seen(s, c)
        value = f"{pick}({_back(s, name, -end, 'NULL')}, {_back(s, name, n - size - end, 'NULL')})"  # the two may overlap
        return F.expr(f"CASE WHEN {_back(s, seen, -end, '0L')} - {_back(s, seen, n - end, '0L')} >= {need} THEN {value} END")
    count, total, squares = _moments(s, c, n, end, fn.startswith("stddev"))
    value = {"sum": total, "avg": f"({total}) / {count}", "stddev_pop": f"sqrt({squares} / {count})", "stddev_samp": f"sqrt(try_divide({squares}, {count} - 1))"}[fn]
    return F.expr(f"CASE WHEN {count} >= {max(need, 1)} THEN {value} END")


def _full(s: Series, c: Column | str, n: int, end: int, min_rows: int | None, fn: str, more: str = "") -> Column:
    """``fn`` over the ``n`` rows up to ``end``, null until enough of them hold a value."""
    need = n if min_rows is None else min_rows
    if isinstance(c, str) and n > LONG and end <= 0 and fn in ("sum", "avg", "min", "max", "stddev_samp", "stddev_pop"):
        return _long(s, c, n, end, need, fn)
    if isinstance(c, str):
        o = s.over(end - n + 1, end)
        return F.expr(f"CASE WHEN count(`{c}`) {o} >= {need} THEN {fn}(`{c}`{more}) {o} END")
    w = s.w(n, end)
    return F.when(F.count(c).over(w) >= need, F.call_function(fn, c, *([F.expr(more.strip(", "))] if more else [])).over(w))


def mean(s: Series, c, n: int, end: int = 0, min_rows: int | None = None) -> Column:
    return _full(s, c, n, end, min_rows, "avg")


def total(s: Series, c, n: int, end: int = 0, min_rows: int | None = None) -> Column:
    return _full(s, c, n, end, min_rows, "sum")


def high(s: Series, c, n: int, end: int = 0, min_rows: int | None = None) -> Column:
    return _full(s, c, n, end, min_rows, "max")


def low(s: Series, c, n: int, end: int = 0, min_rows: int | None = None) -> Column:
    return _full(s, c, n, end, min_rows, "min")


def std(s: Series, c, n: int, end: int = 0) -> Column:
    """Sample standard deviation."""
    return _full(s, c, n, end, None, "stddev_samp")


def std_pop(s: Series, c, n: int) -> Column:
    return _full(s, c, n, 0, None, "stddev_pop")


def quantile(s: Series, c, n: int, q: float, min_rows: int | None = None) -> Column:
    """Exact quantile with linear interpolation; of a named column for frames of any length."""
    if isinstance(c, str):
        return s.order_stat(Stat("quantile", c, n, n if min_rows is None else min_rows, q))
    return _full(s, c, n, 0, min_rows, "percentile", f", {q}D")


def median(s: Series, c, n: int, min_rows: int | None = None) -> Column:
    return quantile(s, c, n, 0.5, min_rows)


def rolling_apply(s: Series, c, n: int, fn) -> Column:
    """``fn(values, current)`` on the array of the last ``n`` values; null until the window is full."""
    w = s.w(n)
    return F.when(F.count(col(c)).over(w) == n, fn(F.collect_list(col(c)).over(w), col(c)))


def pct_rank(s: Series, c, n: int) -> Column:
    """Rank of the current value among the last ``n``, ties averaged, in (0, 1]; of a named column for frames of any length."""
    if isinstance(c, str):
        return s.order_stat(Stat("rank", c, n, n))

    def rank(values: Column, x: Column) -> Column:
        less = F.size(F.filter(values, lambda v: v < x))
        same = F.size(F.filter(values, lambda v: v == x))
        return (less + (same + 1) / 2) / n
    return rolling_apply(s, c, n, rank)


def frac_below(s: Series, c, n: int) -> Column:
    """Share of the last ``n`` values below the current one."""
    if isinstance(c, str):
        return s.order_stat(Stat("below", c, n, n))
    return rolling_apply(s, c, n, lambda vs, x: F.size(F.filter(vs, lambda v: v < x)) / F.lit(float(n)))


def skew(s: Series, c, n: int) -> Column:
    """Bias-corrected skewness."""
    return _full(s, c, n, 0, None, "skewness") * ((n * (n - 1)) ** 0.5 / (n - 2))


def kurt(s: Series, c, n: int) -> Column:
    """Bias-corrected excess kurtosis."""
    return ((_full(s, c, n, 0, None, "kurtosis") * (n + 1) + 6) * ((n - 1) / ((n - 2) * (n - 3))))


def corr(s: Series, x, y, n: int) -> Column:
    """Pearson correlation; null when a side is constant or the window is not full."""
    w, x, y = s.w(n), col(x), col(y)
    both = F.when(x.isNotNull() & y.isNotNull(), F.lit(1))
    r = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
    return F.when(F.count(both).over(w) == n, r)


def zscore(s: Series, c, n: int) -> Column:
    return div(col(c) - mean(s, c, n), std(s, c, n))


def any_of(s: Series, f, n: int) -> Column:
    """1 when the flag was set in any of the last ``n`` rows (all present)."""
    return flag(high(s, f, n) == 1)


def count_of(s: Series, f, n: int) -> Column:
    return total(s, f, n)


def pct_change(s: Series, c, k: int) -> Column:
    if isinstance(c, str):
        return F.expr(f"try_divide(`{c}`, lag(`{c}`, {k}) {s.over()}) - 1")
    return div(c, s.lag(c, k)) - 1


def diff(s: Series, c, k: int = 1) -> Column:
    return F.expr(f"`{c}` - lag(`{c}`, {k}) {s.over()}") if isinstance(c, str) else c - s.lag(c, k)


def log_return(s: Series, c) -> Column:
    return F.ln(div(c, s.lag(c)))


def ffill(s: Series, c, limit: int) -> Column:
    """Last non-null value at most ``limit`` rows back."""
    return F.last(col(c), True).over(s.w(limit + 1))


def bars_since_high(s: Series, c, n: int) -> Column:
    """Rows since the first maximum of the last ``n`` rows."""
    return rolling_apply(s, c, n, lambda vs, _: n - F.array_position(vs, F.array_max(vs)))


def bars_since_low(s: Series, c, n: int) -> Column:
    return rolling_apply(s, c, n, lambda vs, _: n - F.array_position(vs, F.array_min(vs)))


def crosses_above(s: Series, a, b) -> Column:
    return flag((col(a) > col(b)) & (s.lag(a) <= s.lag(b)))


def crosses_below(s: Series, a, b) -> Column:
    return flag((col(a) < col(b)) & (s.lag(a) >= s.lag(b)))


def slope(s: Series, c, n: int) -> dict[str, Column]:
    """Least squares line over the last ``n`` rows with x = 0..n-1: slope, intercept, angle, forecasts."""
    w = s.w(n)
    x = s.index.cast("double")
    b = F.when(F.count(col(c)).over(w) == n, F.regr_slope(col(c), x).over(w))
    avg = F.avg(col(c)).over(w)
    a = avg - b * ((n - 1) / 2)
    return {"slope": b, "intercept": a, "angle": F.degrees(F.atan(b)), "end": a + b * (n - 1), "next": a + b * n}
