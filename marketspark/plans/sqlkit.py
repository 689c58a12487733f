"""Small text helpers for the checking SQL."""

from __future__ import annotations

PART = "PARTITION BY symbol, timeframe ORDER BY bar_ts"


def r6(x: str, n: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {n}) + 0.0)"


def over(n: int, end: int = 0) -> str:
    hi = "CURRENT ROW" if end == 0 else f"{-end} PRECEDING"
    return f"OVER ({PART} ROWS BETWEEN {n - 1 - end} PRECEDING AND {hi})"


def roll(fn: str, x: str, n: int, end: int = 0, min_rows: int | None = None) -> str:
    o = over(n, end)
    return f"(CASE WHEN count({x}) {o} >= {n if min_rows is None else min_rows} THEN {fn}({x}) {o} END)"


def mean(x, n, end=0, min_rows=None):
    return roll("avg", x, n, end, min_rows)


def std(x, n):
    return roll("stddev_samp", x, n)


def hi(x, n, end=0):
    return roll("max", x, n, end)


def lo(x, n, end=0):
    return roll("min", x, n, end)


def total(x, n, end=0):
    return roll("sum", x, n, end)


def quant(x, n, q, min_rows=None):
    o = over(n)
    m = n if min_rows is None else min_rows
    return f"(CASE WHEN count({x}) {o} >= {m} THEN quantile_cont({x}, {q}) {o} END)"


def lag(x, k=1):
    return f"lag({x}, {k}) OVER ({PART})"


def lead(x, k=1):
    return f"lead({x}, {k}) OVER ({PART})"


def pct(x, k):
    return f"({x} / nullif({lag(x, k)}, 0) - 1)"


def prank(x, n):
    o = over(n)
    return (f"(CASE WHEN count({x}) {o} = {n} THEN (list_sum(list_transform(list({x}) {o}, lambda v: "
            f"CASE WHEN v < {x} THEN 1.0 WHEN v = {x} THEN 0.5 ELSE 0.0 END)) + 0.5) / {n} END)")


def ema(x, alpha: float):
    """Recursive average as a fold over everything up to the row, seeded with the first value."""
    o = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return (f"(CASE WHEN {x} IS NOT NULL THEN list_reduce(list(CAST({x} AS DOUBLE)) FILTER ({x} IS NOT NULL) {o}, "
            f"lambda y, v: y * {1 - alpha!r}::DOUBLE + v * {alpha!r}::DOUBLE) END)")


def sp(n):
    return 2.0 / (n + 1.0)


def ema_adj(x, alpha: float):
    """Weighted average with weights (1-alpha)^age over everything up to the row."""
    o = f"OVER ({PART} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    f = f"FILTER ({x} IS NOT NULL)"
    return (f"(CASE WHEN {x} IS NOT NULL THEN list_reduce(list(CAST({x} AS DOUBLE)) {f} {o}, "
            f"lambda y, v: y * {1 - alpha!r}::DOUBLE + v) * {alpha!r}::DOUBLE / "
            f"(1 - power({1 - alpha!r}::DOUBLE, count({x}) {o})) END)")


def div(a, b):
    return f"(({a}) / nullif(CAST(({b}) AS DOUBLE), 0))"


def flag(cond):
    return f"CAST(coalesce({cond}, false) AS INTEGER)"


def chain(ctes: str, base: str, *steps: dict[str, str], out: str, where: str = "") -> str:
    """``WITH ctes, s1 AS (SELECT *, ... FROM base), s2 ... SELECT out FROM last``."""
    parts, prev = [ctes], base
    for i, st in enumerate(steps):
        parts.append(f"s{i + 1} AS (SELECT *, " + ",\n ".join(f"{e} AS {n}" for n, e in st.items()) + f" FROM {prev})")
        prev = f"s{i + 1}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT {out} FROM {prev}" + (f" WHERE {where}" if where else "")


def outs(cols: list[str] | str, keys: str = "symbol, bar_ts", n: int = 6) -> str:
    cols = cols.split() if isinstance(cols, str) else cols
    return keys + ", " + ", ".join(f"{r6(c, n)} AS {c}" for c in cols)
