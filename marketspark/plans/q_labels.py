"""Barrier and return labels over hourly bars."""

from pyspark.sql import functions as F

from marketspark.operators import labels as L
from marketspark.operators.series import blocked
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.q_windows import ATR, TR
from marketspark.plans.registry import query

H1 = L.HORIZONS["1H"]


def ahead(n):
    return f"OVER ({q.PART} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING)"


def touch(col, op, price, n):
    return f"coalesce(list_position(list_transform(list({col}) {ahead(n)}, lambda x: x {op} {price}), true), 0)"


BASE = [TR, ATR, {"left_n": f"count(*) OVER (PARTITION BY symbol, timeframe) - row_number() OVER ({q.PART})"}]


def first(a, b):
    return f"({a} > 0 AND ({b} = 0 OR {a} < {b}))"


def rounded(df, *doubles, ints=("target",)):
    return df.select("symbol", "bar_ts", *(F.col(c).cast("int") for c in ints), *(F.round(c, 6).alias(c) for c in doubles))


def outs(*doubles, ints=("target",)):
    return "symbol, bar_ts, " + ", ".join([f"CAST({c} AS INTEGER) AS {c}" for c in ints] + [f"{q.r6(c)} AS {c}" for c in doubles])


def sql_triple(h, tp, sl, out, ctes=I.SQL_BARS, base="bars"):
    return q.chain(ctes, base, *BASE,
        {"a": "CASE WHEN atr14 > 0 THEN atr14 ELSE close * 0.02 END", "e": q.lead("open"), "fin": f"last(close) {ahead(h)}"},
        {"tpp": f"e + a * {tp}", "slp": f"e - a * {sl}"},
        {"tpi": touch("high", ">=", "tpp", h), "sli": touch("low", "<=", "slp", h)},
        {"k": f"left_n > {h}", "win": first("tpi", "sli")},
        {"target": "CASE WHEN NOT k THEN 0 WHEN win THEN 1 WHEN sli > 0 THEN 2 ELSE 0 END"},
        {"expected_return": "CASE WHEN NOT k THEN 0 WHEN win THEN tpp / e - 1 WHEN sli > 0 THEN slp / e - 1 ELSE fin / e - 1 END",
         "expected_duration": f"CASE WHEN NOT k THEN 0 WHEN win THEN tpi WHEN sli > 0 THEN sli ELSE {h} END",
         "tp_hit": "CASE WHEN target = 1 THEN 1 ELSE 0 END", "sl_hit": "CASE WHEN target = 2 THEN 1 ELSE 0 END"},
        out=out, where=f"left_n >= {h}")


def series(spark, sf, h):
    return L.barrier_series(I.bars(spark, sf), h)


TB_INTS = ("target", "expected_duration", "tp_hit", "sl_hit")


@query("lb_1_triple_barrier", sql_triple(*H1, out=outs("expected_return", ints=TB_INTS)))
def lb_1(spark, sf):
    return rounded(L.triple_barrier(series(spark, sf, H1[0]), *H1), "expected_return", ints=TB_INTS)


@query("lb_1_triple_barrier_long", sql_triple(50, 3.0, 2.0, out=outs("expected_return", ints=TB_INTS)))
def lb_1_long(spark, sf):
    return rounded(L.triple_barrier(series(spark, sf, 50), 50, 3.0, 2.0), "expected_return", ints=TB_INTS)


def sql_partial(h, tp, sl, share, out):
    n = h + 1
    return q.chain(I.SQL_BARS, "bars", *BASE, {"e": q.lead("open"), "fin": f"last(close) {ahead(n)}"},
        {"tpi": touch("high", ">=", f"e + atr14 * {tp}", n), "sli": touch("low", "<=", f"e - atr14 * {sl}", n),
         "mv": "(fin - e) / nullif(atr14, 0)"},
        {"hit_type": f"""CASE WHEN {first('tpi', 'sli')} THEN 'tp' WHEN sli > 0 THEN 'sl'
          WHEN mv >= {tp} * {share} THEN 'partial_up' WHEN mv <= -({sl} * {share}) THEN 'partial_down' ELSE 'flat' END"""},
        {"target": "CASE WHEN hit_type IN ('tp', 'partial_up') THEN 1 WHEN hit_type = 'flat' THEN 0 ELSE 2 END",
         "expected_return": f"CASE hit_type WHEN 'tp' THEN {tp} * atr14 / e WHEN 'sl' THEN -{sl} * atr14 / e ELSE (fin - e) / e END",
         "expected_duration": f"CASE hit_type WHEN 'tp' THEN tpi WHEN 'sl' THEN sli ELSE {n} END"},
        out=out, where=f"left_n >= {n}")


@query("lb_2_triple_barrier_partial", sql_partial(12, 2.2, 1.0, 0.9, outs("expected_return", ints=("target", "expected_duration"))))
def lb_2(spark, sf):
    return rounded(L.triple_barrier_partial(series(spark, sf, 13), 12, 2.2, 1.0, 0.9), "expected_return",
                   ints=("target", "expected_duration"))


@query("lb_3_triple_barrier_hit_type", sql_partial(39, 2.6, 2.0, 0.85, "hit_type, " + outs("expected_return", ints=("target", "expected_duration"))))
def lb_3(spark, sf):
    df = L.triple_barrier_partial(series(spark, sf, 40), 39, 2.6, 2.0, 0.85)
    return df.select("symbol", "bar_ts", "hit_type", F.col("target").cast("int").alias("target"), "expected_duration",
                     F.round("expected_return", 6).alias("expected_return"))


def sides(h, tp, sl, share=1.0, atr="atr14"):
    return {"tl": touch("high", ">=", f"close + {atr} * {tp * share!r}", h), "sl": touch("low", "<=", f"close - {atr} * {sl}", h),
            "ts": touch("low", "<=", f"close - {atr} * {tp * share!r}", h), "ss": touch("high", ">=", f"close + {atr} * {sl}", h),
            "mx": f"max(high) {ahead(h)}", "mn": f"min(low) {ahead(h)}", "fin": f"last(close) {ahead(h)}"}


@query("lb_4_adaptive_two_sided", q.chain(I.SQL_BARS, "bars", *BASE, sides(20, 2.0, 1.2),
    {"r1": first("tl", "sl"), "r2": first("ts", "ss"), "r3": first("sl", "tl"), "r4": first("ss", "ts"), "mv": "(fin - close) / nullif(atr14, 0)"},
    {"target": """CASE WHEN r1 THEN 1 WHEN r2 OR r3 THEN 2 WHEN r4 THEN 1 WHEN mv >= 2.0 * 0.6 THEN 1
      WHEN mv <= -2.0 * 0.6 THEN 2 ELSE 0 END""",
     "expected_return": "CASE WHEN r1 OR r2 THEN 2.0 * atr14 / close WHEN r3 OR r4 THEN -1.2 * atr14 / close ELSE (fin - close) / close END",
     "expected_duration": "CASE WHEN r1 THEN tl WHEN r2 THEN ts WHEN r3 THEN sl WHEN r4 THEN ss ELSE 20 END"},
    out=outs("expected_return", ints=("target", "expected_duration")), where="left_n >= 20"))
def lb_4(spark, sf):
    return rounded(L.adaptive_two_sided(series(spark, sf, 20), 20, 2.0, 1.2, 0.6), "expected_return",
                   ints=("target", "expected_duration"))


def sql_tp_first(h, tp, sl, share=1.0, gate=None, atr="atr14"):
    long, short = first("tl", "sl"), first("ts", "ss")
    up, down = f"coalesce((mx - close) / nullif({atr}, 0) >= {gate}, false)", f"coalesce((close - mn) / nullif({atr}, 0) >= {gate}, false)"
    if gate is not None:
        long, short = f"({up} AND {long})", f"(NOT {up} AND {down} AND {short})"
    return q.chain(I.SQL_BARS, "bars", *BASE, sides(h, tp, sl, share, atr),
                   {"target": f"CASE WHEN {long} THEN 1 WHEN {short} THEN 2 ELSE 0 END"}, out=outs(), where=f"left_n >= {h}")


@query("lb_5_tp_first_only", sql_tp_first(30, 1.5, 1.0))
def lb_5(spark, sf):
    return rounded(L.tp_first_only(series(spark, sf, 30), 30, 1.5, 1.0))


@query("lb_6_reduced_tp_gated", sql_tp_first(25, 2.0, 1.5, 0.8, gate=2.0 * 0.8))
def lb_6(spark, sf):
    return rounded(L.tp_first_only(series(spark, sf, 25), 25, 2.0, 1.5, 0.8, gate=2.0 * 0.8))


@query("lb_7_min_move_strict", sql_tp_first(25, 2.0, 1.0, gate=2.5, atr="coalesce(atr14, close * 0.02)"))
def lb_7(spark, sf):
    return rounded(L.tp_first_only(series(spark, sf, 25), 25, 2.0, 1.0, gate=2.5, fill_atr=True))


@query("lb_8_reduced_tp_simple", sql_tp_first(20, 1.6, 1.0, 0.7))
def lb_8(spark, sf):
    return rounded(L.tp_first_only(series(spark, sf, 20), 20, 1.6, 1.0, 0.7))


@query("lb_9_quantile_return", f"""WITH {I.SQL_BARS}, f AS (SELECT *, {q.lead('close', 10)} / close - 1 AS future_return FROM bars),
c AS (SELECT symbol, quantile_cont(abs(future_return), 0.6) AS cut FROM f GROUP BY symbol)
SELECT symbol, bar_ts, CASE WHEN future_return >= cut THEN 1 ELSE 0 END AS target, {q.r6('future_return')} AS future_return
FROM f JOIN c USING (symbol) WHERE future_return >= cut OR future_return <= -cut""")
def lb_9(spark, sf):
    return rounded(L.quantile_return(blocked(I.bars(spark, sf), fwd=10)), "future_return")


@query("lb_10_from_signals", f"""WITH {I.SQL_TRADES} SELECT trade_id, direction, pnl, CAST(pnl > 0 AS INTEGER) AS actual_outcome,
 CASE WHEN (pnl > 0) = (direction = 'long') THEN 1 ELSE 2 END AS target FROM trades""")
def lb_10(spark, sf):
    return L.from_signals(I.trades(spark, sf)).select("trade_id", "direction", "pnl", "actual_outcome", "target")


def _dist(label_sql):
    return f"""SELECT symbol, timeframe, count(*) AS total, count(*) FILTER (target = 0) AS flat_n, count(*) FILTER (target = 1) AS up_n,
 count(*) FILTER (target = 2) AS down_n, round(count(*) FILTER (target = 0) * 100.0 / count(*), 4)::DOUBLE AS flat_pct,
 round(count(*) FILTER (target = 1) * 100.0 / count(*), 4)::DOUBLE AS up_pct, round(count(*) FILTER (target = 2) * 100.0 / count(*), 4)::DOUBLE AS down_pct,
 CASE WHEN count(*) FILTER (target = 0) * 100.0 / count(*) < 20 THEN 'overtrading'
  WHEN count(*) FILTER (target = 0) * 100.0 / count(*) > 40 THEN 'conservative' ELSE 'balanced' END AS verdict
FROM ({label_sql}) GROUP BY symbol, timeframe"""


@query("lb_11_label_distribution", _dist(sql_triple(*H1, out="symbol, timeframe, target")))
def lb_11(spark, sf):
    return L.label_distribution(L.triple_barrier(series(spark, sf, H1[0]), *H1))


@query("lb_12_forward_outcome_by_label", f"""WITH l AS ({sql_triple(*H1, out='symbol, timeframe, bar_ts, close, target')}),
 f AS (SELECT target, {q.lead('close', 10)} / close - 1 AS fr FROM l)
SELECT target, count(*) AS n, {q.r6('avg(fr * 100)')} AS avg_return_pct, {q.r6('''avg(CASE WHEN target = 1 THEN (fr > 0)::INT
 WHEN target = 2 THEN (fr < 0)::INT ELSE (abs(fr) < 0.002)::INT END) * 100''')} AS hit_rate_pct FROM f WHERE fr IS NOT NULL GROUP BY target""")
def lb_12(spark, sf):
    labelled = L.triple_barrier(series(spark, sf, H1[0]), *H1)
    df = L.forward_outcome_by_label(blocked(labelled, fwd=10))
    return df.select("target", "n", *(F.round(c, 6).alias(c) for c in ("avg_return_pct", "hit_rate_pct")))
