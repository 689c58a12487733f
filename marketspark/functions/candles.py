"""Candle patterns of one to five bars: 100 bullish, -100 bearish, 0 none.

Rules are SQL conditions over the current bar (suffix 0) and the bars before it (1 to 4):
``o h l c`` prices, ``b`` body, ``u`` upper and ``d`` lower shadow, ``r`` range, ``ab`` and ``ar`` mean body and
range of the ten bars before that bar. Each rule is (bullish, bearish); None where a side does not exist.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from marketspark.functions import rolling as R
from marketspark.operators.series import Series


def white(k):
    return f"c{k} > o{k}"


def black(k):
    return f"c{k} < o{k}"


def long(k):
    return f"b{k} > ab{k}"


def short(k):
    return f"b{k} < ab{k}"


def doji(k):
    return f"b{k} <= 0.1 * ar{k}"


def noup(k):
    return f"u{k} <= 0.1 * ar{k}"


def nodn(k):
    return f"d{k} <= 0.1 * ar{k}"


def near(a, b, k):
    return f"abs({a} - {b}) <= 0.05 * ar{k}"


def top(k):
    return f"greatest(o{k}, c{k})"


def bot(k):
    return f"least(o{k}, c{k})"


def inside(a, b):
    """Body of bar ``a`` within body of bar ``b``."""
    return f"{top(a)} < {top(b)} AND {bot(a)} > {bot(b)}"


def gap_up(a, b):
    return f"{bot(a)} > {top(b)}"


def gap_dn(a, b):
    return f"{top(a)} < {bot(b)}"


def AND(*xs):
    return " AND ".join(f"({x})" for x in xs)


def OR(*xs):
    return "(" + " OR ".join(f"({x})" for x in xs) + ")"


W, B = white, black

ONE_BAR = {
    "belthold": (AND(W(0), long(0), nodn(0)), AND(B(0), long(0), noup(0))),
    "closingmarubozu": (AND(W(0), long(0), noup(0)), AND(B(0), long(0), nodn(0))),
    "doji": (doji(0), None),
    "dragonflydoji": (AND(doji(0), noup(0), "d0 > 0.1 * ar0"), None),
    "gravestonedoji": (AND(doji(0), nodn(0), "u0 > 0.1 * ar0"), None),
    "hammer": (AND(short(0), "d0 > 2 * b0", noup(0), f"{bot(0)} <= l1 + 0.2 * ar1"), None),
    "hangingman": (None, AND(short(0), "d0 > 2 * b0", noup(0), f"{bot(0)} >= h1 - 0.2 * ar1")),
    "highwave": (AND(W(0), short(0), "u0 > 2 * b0", "d0 > 2 * b0"), AND("c0 <= o0", short(0), "u0 > 2 * b0", "d0 > 2 * b0")),
    "invertedhammer": (AND(short(0), "u0 > 2 * b0", nodn(0), gap_dn(0, 1)), None),
    "longleggeddoji": (AND(doji(0), OR("u0 > b0 + 0.3 * ar0", "d0 > b0 + 0.3 * ar0")), None),
    "longline": (AND(W(0), long(0), "u0 < b0", "d0 < b0"), AND(B(0), long(0), "u0 < b0", "d0 < b0")),
    "marubozu": (AND(W(0), long(0), noup(0), nodn(0)), AND(B(0), long(0), noup(0), nodn(0))),
    "rickshawman": (AND(doji(0), "u0 > b0", "d0 > b0", f"abs({bot(0)} + b0 / 2 - (l0 + r0 / 2)) <= 0.2 * ar0"), None),
    "shootingstar": (None, AND(short(0), "u0 > 2 * b0", nodn(0), gap_up(0, 1))),
    "shortline": (AND(W(0), short(0), "u0 < b0", "d0 < b0"), AND(B(0), short(0), "u0 < b0", "d0 < b0")),
    "spinningtop": (AND(W(0), short(0), "u0 > b0", "d0 > b0"), AND("c0 <= o0", short(0), "u0 > b0", "d0 > b0")),
    "takuri": (AND(doji(0), noup(0), "d0 > 3 * b0", "d0 > 0.3 * ar0"), None),
}

TWO_BAR = {
    "counterattack": (AND(B(1), W(0), long(1), long(0), near("c0", "c1", 1)), AND(W(1), B(0), long(1), long(0), near("c0", "c1", 1))),
    "darkcloudcover": (None, AND(W(1), long(1), B(0), "o0 > h1", "c0 > o1", "c0 < c1 - 0.5 * b1")),
    "dojistar": (AND(B(1), long(1), doji(0), gap_dn(0, 1)), AND(W(1), long(1), doji(0), gap_up(0, 1))),
    "engulfing": (AND(B(1), W(0), "c0 >= o1", "o0 <= c1", "b0 > b1"), AND(W(1), B(0), "o0 >= c1", "c0 <= o1", "b0 > b1")),
    "harami": (AND(B(1), long(1), short(0), inside(0, 1)), AND(W(1), long(1), short(0), inside(0, 1))),
    "haramicross": (AND(B(1), long(1), doji(0), inside(0, 1)), AND(W(1), long(1), doji(0), inside(0, 1))),
    "homingpigeon": (AND(B(1), long(1), B(0), short(0), inside(0, 1)), None),
    "inneck": (None, AND(B(1), long(1), W(0), "o0 < l1", "c0 >= c1", "c0 <= c1 + 0.05 * ar1")),
    "kicking": (AND(B(1), long(1), noup(1), nodn(1), W(0), long(0), noup(0), nodn(0), "l0 > h1"),
                AND(W(1), long(1), noup(1), nodn(1), B(0), long(0), noup(0), nodn(0), "h0 < l1")),
    "kickingbylength": (AND(noup(1), nodn(1), long(1), noup(0), nodn(0), long(0), OR(AND(B(1), W(0), "l0 > h1"), AND(W(1), B(0), "h0 < l1")),
                            OR(AND("b0 >= b1", W(0)), AND("b1 > b0", W(1)))),
                        AND(noup(1), nodn(1), long(1), noup(0), nodn(0), long(0), OR(AND(B(1), W(0), "l0 > h1"), AND(W(1), B(0), "h0 < l1")),
                            OR(AND("b0 >= b1", B(0)), AND("b1 > b0", B(1))))),
    "matchinglow": (AND(B(1), B(0), near("c0", "c1", 1)), None),
    "onneck": (None, AND(B(1), long(1), W(0), "o0 < l1", near("c0", "l1", 1))),
    "piercing": (AND(B(1), long(1), W(0), long(0), "o0 < l1", "c0 < o1", "c0 > c1 + 0.5 * b1"), None),
    "separatinglines": (AND(B(1), W(0), near("o0", "o1", 1), long(0), nodn(0)), AND(W(1), B(0), near("o0", "o1", 1), long(0), noup(0))),
    "thrusting": (None, AND(B(1), long(1), W(0), "o0 < l1", "c0 > c1 + 0.05 * ar1", "c0 <= c1 + 0.5 * b1")),
}

THREE_BAR = {
    "2crows": (None, AND(W(2), long(2), B(1), gap_up(1, 2), B(0), "o0 < o1", "o0 > c1", "c0 > o2", "c0 < c2")),
    "3blackcrows": (None, AND(B(2), B(1), B(0), nodn(2), nodn(1), nodn(0), "o1 < o2", "o1 > c2", "o0 < o1", "o0 > c1", "c1 < c2", "c0 < c1")),
    "3inside": (AND(B(2), long(2), short(1), inside(1, 2), W(0), "c0 > o2"), AND(W(2), long(2), short(1), inside(1, 2), B(0), "c0 < o2")),
    "3outside": (AND(B(2), W(1), "c1 > o2", "o1 < c2", "c0 > c1"), AND(W(2), B(1), "o1 > c2", "c1 < o2", "c0 < c1")),
    "3starsinsouth": (AND(B(2), B(1), B(0), long(2), "d2 > b2", "b1 < b2", "o1 > c2", "o1 <= h2", "l1 < c2", "l1 >= l2", "d1 > 0",
                          short(0), noup(0), nodn(0), "l0 > l1", "h0 < h1"), None),
    "3whitesoldiers": (AND(W(2), W(1), W(0), noup(2), noup(1), noup(0), "c1 > c2", "c0 > c1", "o1 > o2", "o1 <= c2 + 0.2 * ar2", "o0 > o1",
                           "o0 <= c1 + 0.2 * ar1", "b1 > b2 - 0.6 * ar2", "b0 > b1 - 0.6 * ar1"), None),
    "abandonedbaby": (AND(long(2), doji(1), B(2), "h1 < l2", W(0), "l0 > h1", "c0 > c2 + 0.3 * b2"),
                      AND(long(2), doji(1), W(2), "l1 > h2", B(0), "h0 < l1", "c0 < c2 - 0.3 * b2")),
    "advanceblock": (None, AND(W(2), W(1), W(0), "c1 > c2", "c0 > c1", "o1 > o2", "o1 <= c2", "o0 > o1", "o0 <= c1", long(2),
                               OR(AND("b1 < 0.8 * b2", "b0 < 0.8 * b1"), AND("b0 < b1", "b1 < b2", OR("u0 > 0.5 * b0", "u1 > 0.5 * b1"))))),
    "eveningdojistar": (None, AND(W(2), long(2), doji(1), gap_up(1, 2), B(0), "c0 < c2 - 0.3 * b2")),
    "eveningstar": (None, AND(W(2), long(2), short(1), gap_up(1, 2), B(0), "c0 < c2 - 0.3 * b2")),
    "gapsidesidewhite": (AND(W(1), W(0), gap_up(1, 2), gap_up(0, 2), "abs(b0 - b1) <= 0.2 * ar1", near("o0", "o1", 1)),
                         AND(W(1), W(0), gap_dn(1, 2), gap_dn(0, 2), "abs(b0 - b1) <= 0.2 * ar1", near("o0", "o1", 1))),
    "hikkake": (AND("h1 < h2", "l1 > l2", "h0 < h1", "l0 < l1"), AND("h1 < h2", "l1 > l2", "h0 > h1", "l0 > l1")),
    "identical3crows": (None, AND(B(2), B(1), B(0), nodn(2), nodn(1), nodn(0), "c1 < c2", "c0 < c1", near("o1", "c2", 2), near("o0", "c1", 1))),
    "morningdojistar": (AND(B(2), long(2), doji(1), gap_dn(1, 2), W(0), "c0 > c2 + 0.3 * b2"), None),
    "morningstar": (AND(B(2), long(2), short(1), gap_dn(1, 2), W(0), "c0 > c2 + 0.3 * b2"), None),
    "stalledpattern": (None, AND(W(2), W(1), W(0), "c1 > c2", "c0 > c1", long(2), long(1), noup(1), "o1 > o2", "o1 <= c2 + 0.2 * ar2", short(0),
                                 "o0 >= c1 - b0 - 0.2 * ar1")),
    "sticksandwich": (AND(B(2), W(1), B(0), "l1 > c2", near("c0", "c2", 2)), None),
    "tasukigap": (AND(gap_up(1, 2), W(1), B(0), "o0 < c1", "o0 > o1", "c0 < o1", f"c0 > {top(2)}", "abs(b1 - b0) < 0.2 * ar1"),
                  AND(gap_dn(1, 2), B(1), W(0), "o0 < o1", "o0 > c1", "c0 > o1", f"c0 < {bot(2)}", "abs(b1 - b0) < 0.2 * ar1")),
    "tristar": (AND(doji(2), doji(1), doji(0), gap_dn(1, 2), f"{bot(0)} > {bot(1)}"), AND(doji(2), doji(1), doji(0), gap_up(1, 2), f"{top(0)} < {top(1)}")),
    "unique3river": (AND(B(2), long(2), B(1), "c1 > c2", "o1 <= o2", "l1 < l2", W(0), short(0), "o0 > l1"), None),
    "upsidegap2crows": (None, AND(W(2), long(2), B(1), short(1), gap_up(1, 2), B(0), "o0 > o1", "c0 < c1", "c0 > c2")),
    "xsidegap3methods": (AND(W(2), W(1), gap_up(1, 2), B(0), "o0 < c1", "o0 > o1", "c0 < c2", "c0 > o2"),
                         AND(B(2), B(1), gap_dn(1, 2), W(0), "o0 > c1", "o0 < o1", "c0 > c2", "c0 < o2")),
}

FOUR_FIVE_BAR = {
    "3linestrike": (AND(W(3), W(2), W(1), B(0), "c2 > c3", "c1 > c2", "o0 > c1", "c0 < o3"), AND(B(3), B(2), B(1), W(0), "c2 < c3", "c1 < c2", "o0 < c1", "c0 > o3")),
    "breakaway": (AND(B(4), long(4), B(3), gap_dn(3, 4), "h2 < h3", "l2 < l3", "h1 < h2", "l1 < l2", B(1), W(0), "c0 > o3", "c0 < c4"),
                  AND(W(4), long(4), W(3), gap_up(3, 4), "h2 > h3", "l2 > l3", "h1 > h2", "l1 > l2", W(1), B(0), "c0 < o3", "c0 > c4")),
    "concealbabyswall": (AND(B(3), B(2), B(1), B(0), noup(3), nodn(3), noup(2), nodn(2), gap_dn(1, 2), "u1 > 0.1 * ar1", "h1 > c2", "h0 > h1", "l0 < l1"), None),
    "hikkakemod": (AND("h2 < h3", "l2 > l3", "h1 < h2", "l1 > l2", "h0 < h1", "l0 < l1", "c2 <= l2 + 0.2 * ar2"),
                   AND("h2 < h3", "l2 > l3", "h1 < h2", "l1 > l2", "h0 > h1", "l0 > l1", "c2 >= h2 - 0.2 * ar2")),
    "ladderbottom": (AND(B(4), B(3), B(2), "o3 < o4", "o2 < o3", "c3 < c4", "c2 < c3", B(1), "u1 > 0.1 * ar1", W(0), "o0 > o1", "c0 > h1"), None),
    "mathold": (AND(W(4), long(4), short(3), short(2), short(1), B(3), gap_up(3, 4), f"{bot(2)} < c4", f"{bot(1)} < c4", f"{bot(2)} > c4 - 0.5 * b4",
                    f"{bot(1)} > c4 - 0.5 * b4", W(0), "o0 > c1", "c0 > greatest(h3, h2, h1)"), None),
    "risefall3methods": (AND(W(4), long(4), short(3), short(2), short(1), B(3), B(2), B(1), "l3 > l4", "l1 > l4", "h3 < h4", "h1 < h4", W(0), long(0), "o0 > c1", "c0 > c4"),
                         AND(B(4), long(4), short(3), short(2), short(1), W(3), W(2), W(1), "h3 < h4", "h1 < h4", "l3 > l4", "l1 > l4", B(0), long(0), "o0 < c1", "c0 < c4")),
}


def shape(s: Series, bars: int) -> Series:
    """Columns the rules read for the current bar and ``bars - 1`` bars before it."""
    s = s.add(_b=F.abs(F.col("close") - F.col("open")), _r=F.col("high") - F.col("low"))
    s = s.add(_ab=R.mean(s, "_b", 10, -1), _ar=R.mean(s, "_r", 10, -1))
    src = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "_b", "r": "_r", "ab": "_ab", "ar": "_ar"}
    n = max(bars, 2)
    cols = {f"{k}{i}": (F.col(c) if i == 0 else s.lag(c, i)) for i in range(n) for k, c in src.items()}
    s = s.add(**cols)
    return s.add(**{f"u{i}": F.col(f"h{i}") - F.greatest(f"o{i}", f"c{i}") for i in range(n)},
                 **{f"d{i}": F.least(f"o{i}", f"c{i}") - F.col(f"l{i}") for i in range(n)})


def patterns(s: Series, rules: dict, bars: int) -> Series:
    """Flags ``cdl<name>`` of every rule."""
    s = shape(s, bars)
    out = {}
    for name, (bull, bear) in rules.items():
        e = F.when(F.expr(bull), 100) if bull else None
        if bear:
            e = F.when(F.expr(bear), -100) if e is None else e.when(F.expr(bear), -100)
        out[f"cdl{name}"] = e.otherwise(0)
    return s.add(**out)
