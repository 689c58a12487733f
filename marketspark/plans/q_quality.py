"""Audits, repairs, feature screening and splits."""

from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.operators import labels as L
from marketspark.operators import metrics as M
from marketspark.operators import quality as QA
from marketspark.operators import selection as FSL
from marketspark.operators.series import blocked
from marketspark.plans import inputs as I
from marketspark.plans import sqlkit as q
from marketspark.plans.q_labels import sql_triple
from marketspark.plans.q_trades import rnd, sql_metrics
from marketspark.plans.q_windows import ATR, BB, GL, TR, sql_rsi
from marketspark.plans.registry import query

B, T = I.SQL_BARS, I.SQL_TRADES
KEY = "symbol, timeframe"


@query("qa_1_audit_timestamps", f"""WITH {T}, a AS (SELECT *, exit_time < lag(exit_time) OVER (PARTITION BY {KEY} ORDER BY trade_id) AS bk FROM trades),
 d AS (SELECT DISTINCT symbol, timeframe, exit_time FROM trades), g AS (SELECT *, epoch(exit_time) - epoch(lag(exit_time) OVER (PARTITION BY {KEY} ORDER BY exit_time)) AS gap FROM d),
 x AS (SELECT symbol, timeframe, count(*) AS count, min(exit_time) AS start, max(exit_time) AS "end", count(*) FILTER (bk) AS reversals FROM a GROUP BY {KEY}),
 y AS (SELECT symbol, timeframe, count(*) FILTER (gap > 604800) AS gaps FROM g GROUP BY {KEY}) SELECT *, reversals = 0 AS passed FROM x JOIN y USING (symbol, timeframe)""")
def qa_1(spark, sf):
    return QA.audit_timestamps(I.trades(spark, sf), "exit_time", "trade_id")


@query("qa_2_audit_duplicates", f"""WITH {T} SELECT symbol, timeframe, CAST(count(*) - count(DISTINCT exit_time) AS BIGINT) AS duplicates, count(*) = count(DISTINCT exit_time) AS passed FROM trades GROUP BY {KEY}""")
def qa_2(spark, sf):
    return QA.audit_duplicates(I.trades(spark, sf), "exit_time")


@query("qa_2_dedupe_keep_first", f"WITH {T} SELECT trade_id, symbol, timeframe, exit_time, pnl FROM trades QUALIFY row_number() OVER (PARTITION BY {KEY}, exit_time ORDER BY trade_id) = 1")
def qa_2d(spark, sf):
    return QA.dedupe_keep_first(I.trades(spark, sf), "exit_time", "trade_id").select("trade_id", "symbol", "timeframe", "exit_time", "pnl")


FWD = f"""tl AS (SELECT symbol, timeframe, bar_ts, close, CASE WHEN future_return > 0.05 THEN 1 WHEN future_return < -0.05 THEN 2 ELSE 0 END AS target,
 count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) AS left_n FROM (SELECT *, coalesce({q.lead('close', 10)}, close * 1.1) / close - 1 AS future_return FROM bars))"""


@query("qa_3_audit_lookahead", f"WITH {B}, {FWD} SELECT symbol, timeframe, count(*) FILTER (left_n < 40 AND target <> 0) AS labels_in_tail, count(*) FILTER (left_n < 40 AND target <> 0) > 8 AS suspicious_tail, 'future_return' AS future_columns, false AS passed FROM tl GROUP BY {KEY}")
def qa_3(spark, sf):
    s = blocked(I.bars(spark, sf), fwd=10)
    s = s.add(future_return=F.coalesce(s.lead("close", 10), F.col("close") * 1.1) / F.col("close") - 1)
    s = s.add(target=F.when(F.col("future_return") > 0.05, 1).when(F.col("future_return") < -0.05, 2).otherwise(0))
    return QA.audit_lookahead(s)


@query("qa_4_audit_costs", f"""WITH {B}, m AS (SELECT symbol, quantile_cont(((close + 0.006) - (close - 0.004)) / close, 0.5) AS a, CASE WHEN symbol IN ('S0', 'S1') THEN 0.0002 ELSE 0.00005 END AS e FROM bars GROUP BY symbol)
SELECT symbol, {q.r6('a', 9)} AS actual_spread, e::DOUBLE AS expected_spread, {q.r6('(e + 0.000015) * 10000')} AS total_cost_bps, abs(a - e) > e * 0.5 AS differs FROM m""")
def qa_4(spark, sf):
    df = QA.audit_costs(I.bars(spark, sf).withColumns({"bid": F.col("close") - 0.004, "ask": F.col("close") + 0.006}), ["S0", "S1"])
    return df.select("symbol", F.round("actual_spread", 9).alias("actual_spread"), "expected_spread", F.round("total_cost_bps", 6).alias("total_cost_bps"), "differs")


HOURS = {"S0": (7, 22), "S1": (7, 22), "S2": (22, 7), "S3": (12, 22)}


@query("qa_5_audit_sessions", f"""WITH {B}, s AS (SELECT *, CASE symbol WHEN 'S2' THEN hour(bar_ts) >= 22 OR hour(bar_ts) < 7 WHEN 'S3' THEN hour(bar_ts) >= 12 AND hour(bar_ts) < 22 ELSE hour(bar_ts) >= 7 AND hour(bar_ts) < 22 END AS i FROM bars)
SELECT symbol, {q.r6('avg(i::INT) * 100')} AS pct_in_session, count(*) FILTER (NOT i) AS bars_outside, avg(i::INT) < 0.5 AS warning FROM s GROUP BY symbol""")
def qa_5(spark, sf):
    return rnd(QA.audit_sessions(I.bars(spark, sf), HOURS), "symbol", "bars_outside", "warning", d="pct_in_session")


FEATS = ["return_1", "atr14", "rsi14", "bb_width", "bb_pct", "vol_ratio", "body", "rng"]
FEAT_SQL = [{**TR, **GL, "return_1": q.pct("close", 1), "sma20": q.mean("close", 20), "body": "close - open", "rng": "high - low"}, ATR, *BB, {"rsi14": sql_rsi(14), "vol_ratio": f"volume / {q.mean('volume', 20)}"}]
FT = f"ft AS ({q.chain(B, 'bars', *FEAT_SQL, out='symbol, timeframe, bar_ts, open, high, low, close, volume, ' + ', '.join(FEATS))})"


def feats(spark, sf, fwd=0):
    """A small feature table as a series that also sees ``fwd`` rows ahead."""
    s = ind.bollinger(ind.rsi(ind.atr(blocked(I.bars(spark, sf), back=45, fwd=fwd), 14), 14), rank=None)
    return s.add(return_1=R.pct_change(s, "close", 1), vol_ratio=R.div("volume", R.mean(s, "volume", 20)), body=F.col("close") - F.col("open"), rng=F.col("high") - F.col("low"))


def unpivot(exprs, keys="symbol, timeframe", src="ft", extra=""):
    """One row per feature: ``exprs(f)`` gives 'expr AS name, ...'."""
    return " UNION ALL ".join(f"SELECT {keys}, '{f}' AS feature, {exprs(f)} FROM {src}{extra} GROUP BY {keys}" for f in FEATS)


@query("qa_6_audit_outliers", f"""WITH {FT}, st AS (SELECT symbol, timeframe, {', '.join(f'avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}' for f in FEATS)} FROM ft GROUP BY {KEY}), j AS (SELECT * FROM ft JOIN st USING (symbol, timeframe)),
u AS ({unpivot(lambda f: f'count(*) FILTER (abs({f} - m_{f}) > 3 * (s_{f} + 1e-10)) AS outliers, count({f}) AS n', src='j')}) SELECT *, outliers > n * 0.01 AS flagged FROM u""")
def qa_6(spark, sf):
    return QA.audit_outliers(feats(spark, sf).rows(), FEATS, z=3.0)


@query("qa_7_audit_missing", f"WITH {FT}, u AS ({unpivot(lambda f: f'count(*) - count({f}) AS missing, count(*) AS n')}) SELECT symbol, timeframe, feature, missing, n, {q.r6('missing * 100.0 / n')} AS missing_pct, CASE WHEN missing * 100.0 / n > 5 THEN 'error' WHEN missing > 0 THEN 'warning' ELSE 'ok' END AS severity FROM u")
def qa_7(spark, sf):
    return rnd(QA.audit_missing(feats(spark, sf).rows(), FEATS), "symbol", "timeframe", "feature", "missing", "n", "severity", d="missing_pct")


OHLC = f"""oh AS (SELECT symbol, timeframe, count(*) AS rows, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS null_ohlc, count(*) FILTER (high < low) AS high_below_low,
 count(*) FILTER (close > high OR close < low) AS close_outside, count(*) >= 600 AS enough_rows FROM bars GROUP BY {KEY})"""


@query("qa_11_audit_ohlc", f"WITH {B}, {OHLC} SELECT *, null_ohlc = 0 AND high_below_low = 0 AND close_outside = 0 AND enough_rows AS passed FROM oh")
def qa_11(spark, sf):
    return QA.audit_ohlc(I.bars(spark, sf), min_rows=600)


@query("qa_8_audit_report", f"""WITH {T}, {FT},
ms AS (SELECT symbol, timeframe, bool_or(p > 5) AS f FROM ({unpivot(lambda f: f'(count(*) - count({f})) * 100.0 / count(*) AS p')}) GROUP BY {KEY}),
oc AS (SELECT symbol, timeframe, count(*) < 690 AS f FROM ft GROUP BY {KEY})
SELECT symbol, timeframe, 'missing' AS "check", 'error' AS severity, f AS failed FROM ms UNION ALL SELECT symbol, timeframe, 'ohlc', 'error', f FROM oc
UNION ALL SELECT symbol, timeframe, 'duplicates', 'warning', count(*) > count(DISTINCT bar_ts) FROM ft GROUP BY {KEY}""")
def qa_8(spark, sf):
    f = feats(spark, sf).rows()
    return QA.audit_report({
        "missing": (QA.audit_missing(f, FEATS), F.col("severity") == "error", "error"), "ohlc": (QA.audit_ohlc(f, min_rows=690), ~F.col("passed"), "error"),
        "duplicates": (QA.audit_duplicates(f, "bar_ts"), ~F.col("passed"), "warning")})


@query("qa_9_winsorize_quantile", f"""WITH {FT}, c AS (SELECT symbol, timeframe, quantile_cont(rng, 0.01) AS l, quantile_cont(rng, 0.99) AS h, quantile_cont(body, 0.01) AS l2, quantile_cont(body, 0.99) AS h2 FROM ft GROUP BY {KEY})
SELECT symbol, bar_ts, {q.r6('greatest(l, least(rng, h))')} AS rng, {q.r6('greatest(l2, least(body, h2))')} AS body FROM ft JOIN c USING (symbol, timeframe)""")
def qa_9(spark, sf):
    b = I.bars(spark, sf).withColumns({"rng": F.col("high") - F.col("low"), "body": F.col("close") - F.col("open")})
    return rnd(QA.winsorize_quantile(b, ["rng", "body"]), "symbol", "bar_ts", d="rng body")


@query("qa_10_winsorize_z", f"""WITH {FT}, c AS (SELECT symbol, timeframe, avg(rng) AS m, stddev_samp(rng) AS s, avg(return_1) AS m2, stddev_samp(return_1) AS s2 FROM ft GROUP BY {KEY})
SELECT symbol, bar_ts, {q.r6('greatest(m - 2 * s, least(rng, m + 2 * s))')} AS rng, {q.r6('CASE WHEN return_1 IS NOT NULL THEN greatest(m2 - 2 * s2, least(return_1, m2 + 2 * s2)) END')} AS return_1 FROM ft JOIN c USING (symbol, timeframe)""")
def qa_10(spark, sf):
    return rnd(QA.winsorize_z(feats(spark, sf).rows(), ["rng", "return_1"], z=2.0), "symbol", "bar_ts", d="rng return_1")


# ---- screening ------------------------------------------------------------------------------
LT = f"lt AS ({sql_triple(6, 2.0, 1.0, 'symbol, timeframe, bar_ts, target')}), ft2 AS (SELECT ft.*, target, {q.lead('close')} / close - 1 AS nx FROM ft JOIN lt USING (symbol, timeframe, bar_ts))"


def labelled(spark, sf):
    lab = L.triple_barrier(L.barrier_series(I.bars(spark, sf), 6), 6, 2.0, 1.0).select("symbol", "timeframe", "bar_ts", "target")
    return blocked(feats(spark, sf).rows().join(lab, ["symbol", "timeframe", "bar_ts"]), back=20, fwd=20)


@query("fsl_1_leakage_check", f"""WITH {FT}, {LT}, u AS ({unpivot(lambda f: f'corr({f}, target) AS tc, corr({f}, nx) AS nc, min({f}) = max({f}) AS constant', src='ft2')})
SELECT symbol, timeframe, feature, {q.r6('tc')} AS target_corr, {q.r6('nc')} AS next_corr, constant, abs(tc) > 0.25 AS suspicious, abs(nc) > 0.15 AS peeking FROM u""")
def fsl_1(spark, sf):
    return rnd(FSL.leakage_check(labelled(spark, sf), FEATS), "symbol", "timeframe", "feature", "constant", "suspicious", "peeking", d="target_corr next_corr")


def fwd_sql(hs, past=None):
    return ("fw AS (SELECT *, " + ", ".join(f"{q.lead('close', h)} / close - 1 AS f{h}" for h in hs) + (f", {q.pct('close', past)} AS pr" if past else "") + " FROM ft)")


for _name, _p in FSL.LOOKAHEAD.items():
    _hs = sorted({*_p.ahead, *([_p.past] if _p.past else [])})

    def _expr(f, p=_p, hs=tuple(_hs)):
        x = f"coalesce({f}, 0)"
        bad = [f"abs(corr({x}, f{h})) > {lim}" for h, lim in p.ahead.items()]
        if p.past:
            bad.append(f"(abs(corr({x}, f{p.past})) > abs(corr({x}, pr)) * {p.ratio} AND abs(corr({x}, f{p.past})) > {p.floor})")
        if p.sign_limit:
            bad.append(f"abs(corr({x}, sign(f5))) > {p.sign_limit}")
        return f"{q.r6(f'abs(corr({x}, f5))')} AS corr_5, coalesce({' OR '.join(bad)}, false) AS suspicious"

    @query(f"fsl_2_lookahead_{_name}", f"WITH {FT}, {fwd_sql(_hs, _p.past)} {unpivot(_expr, src='fw')}")
    def _run(spark, sf, p=_p):
        return rnd(FSL.lookahead_test(feats(spark, sf, fwd=20), FEATS, p), "symbol", "timeframe", "feature", "suspicious", d="corr_5")


@query("fsl_3_drop_collinear", f"""WITH {FT} {" UNION ALL ".join(f"SELECT symbol, timeframe, '{b}' AS feature, {q.r6('greatest(' + ', '.join(f'abs(corr({a}, {b}))' for a in FEATS[:j]) + ')') if j else 'CAST(NULL AS DOUBLE)'} AS max_corr, "
       + (f"greatest({', '.join(f'abs(corr({a}, {b}))' for a in FEATS[:j])}) <= 0.6" if j else "true") + f" AS keep FROM ft GROUP BY {KEY}" for j, b in enumerate(FEATS))}""")
def fsl_3(spark, sf):
    return rnd(FSL.collinear(feats(spark, sf).rows(), FEATS, 0.6), "symbol", "timeframe", "feature", "keep", d="max_corr")


@query("fsl_4_null_fraction", f"WITH {FT} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {q.r6(f'avg(({f} IS NULL)::INT)')} AS null_fraction, avg(({f} IS NULL)::INT) < 0.02 AS keep FROM ft" for f in ("return_1", "atr14", "rsi14", "bb_width", "bb_pct", "vol_ratio", "body", "rng")))
def fsl_4(spark, sf):
    df = feats(spark, sf).rows().select(*FEATS)
    return rnd(FSL.null_fraction(df, FSL.prioritized(FSL.candidate_features(df)), 0.02), "feature", "keep", d="null_fraction")


@query("fsl_5_predictiveness", f"""WITH {FT}, {fwd_sql((5, 10, 20))}, u AS ({unpivot(lambda f: f'abs(corr({f}, f5)) AS c5, abs(corr({f}, f10)) AS c10, abs(corr({f}, f20)) AS c20', src='fw')}),
r AS (SELECT *, (c5 + c10 + c20) / 3 AS a, row_number() OVER (PARTITION BY {KEY} ORDER BY (c5 + c10 + c20) / 3 DESC, feature) AS rk FROM u)
SELECT symbol, timeframe, feature, CAST(rk AS INTEGER) AS rank, {q.r6('a')} AS avg_corr FROM r WHERE rk <= 5""")
def fsl_5(spark, sf):
    return rnd(FSL.predictiveness(feats(spark, sf, fwd=20), FEATS, top=5), "symbol", "timeframe", "feature", "rank", d="avg_corr")


# ---- splits ---------------------------------------------------------------------------------
def sql_splits(folds, embargo, purge, mt, mv):
    return f"""ix AS (SELECT symbol, timeframe, bar_ts, row_number() OVER (PARTITION BY symbol ORDER BY bar_ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), fz AS (SELECT *, n // {folds + 1} AS sz FROM ix),
fl AS (SELECT unnest(range({folds})) AS fold), sp AS (SELECT symbol, timeframe, bar_ts, fold, CASE WHEN i < (fold + 1) * sz - {purge} THEN 'train' ELSE 'val' END AS part FROM fz, fl
 WHERE (i < (fold + 1) * sz - {purge} OR (i >= (fold + 1) * sz AND i < least((fold + 2) * sz, n - {embargo}))) AND (fold + 1) * sz - {purge} > {mt} AND least((fold + 2) * sz, n - {embargo}) - (fold + 1) * sz > {mv})"""


@query("cv_1_walk_forward_splits", f"WITH {B}, {sql_splits(6, 50, 25, 100, 20)} SELECT symbol, bar_ts, CAST(fold AS INTEGER) AS fold, part FROM sp")
def cv_1(spark, sf):
    return FSL.walk_forward_splits(blocked(I.bars(spark, sf)), *FSL.WALK_FORWARD["six"]).select("symbol", "bar_ts", "fold", "part")


@query("cv_2_fold_dates", f"WITH {B}, {sql_splits(10, 100, 50, 100, 20)} SELECT symbol, timeframe, CAST(fold AS INTEGER) AS fold, part, min(bar_ts) AS start, max(bar_ts) AS \"end\", count(*) AS rows FROM sp GROUP BY symbol, timeframe, fold, part")
def cv_2(spark, sf):
    return FSL.fold_dates(FSL.walk_forward_splits(blocked(I.bars(spark, sf)), *FSL.WALK_FORWARD["ten"]))


@query("cv_3_split_overlap_check", f"""WITH {T}, a AS (SELECT * FROM trades WHERE exit_time < TIMESTAMP '1999-01-10'), b AS (SELECT * FROM trades WHERE exit_time >= TIMESTAMP '1999-01-20' OR (timeframe = '1H' AND exit_time >= TIMESTAMP '1999-01-01')),
x AS (SELECT symbol, timeframe, min(exit_time) AS train_start, max(exit_time) AS train_end FROM a GROUP BY {KEY}), y AS (SELECT symbol, timeframe, min(exit_time) AS test_start, max(exit_time) AS test_end FROM b GROUP BY {KEY})
SELECT *, test_start <= train_end AS overlap, CAST(date_diff('day', train_end, test_start) AS INTEGER) AS gap_days FROM x JOIN y USING (symbol, timeframe)""")
def cv_3(spark, sf):
    t = I.trades(spark, sf)
    at = lambda d: F.lit(d).cast("timestamp_ntz")
    ts = F.col("exit_time")
    test = t.where((ts >= at("1999-01-20")) | ((F.col("timeframe") == "1H") & (ts >= at("1999-01-01"))))
    return FSL.split_overlap_check(t.where(ts < at("1999-01-10")), test)


@query("cv_3_implausible_metrics", f"""WITH {T} SELECT symbol, timeframe, array_to_string(list_filter([CASE WHEN win_rate > 75 THEN 'win_rate' END, CASE WHEN profit_factor > 5 THEN 'profit_factor' END, CASE WHEN max_drawdown_pct < 1 THEN 'drawdown' END,
 CASE WHEN sharpe_ratio > 5 THEN 'sharpe' END], lambda x: x IS NOT NULL), ',') AS issues FROM {sql_metrics('trades')}""")
def cv_3i(spark, sf):
    return FSL.implausible(M.trade_metrics(I.trades(spark, sf))).select("symbol", "timeframe", F.concat_ws(",", "issues").alias("issues"))


@query("src_7_train_oos_split", f"""WITH {B} SELECT symbol, count(*) FILTER (bar_ts < TIMESTAMP '2024-02-20' - INTERVAL 30 DAY) AS train_rows,
 count(*) FILTER (bar_ts >= TIMESTAMP '2024-02-20' - INTERVAL 30 DAY AND bar_ts <= TIMESTAMP '2024-02-20') AS oos_rows FROM bars GROUP BY symbol""")
def src_7(spark, sf):
    tr, oos = FSL.train_oos_split(I.bars(spark, sf), F.lit("2024-02-20").cast("timestamp_ntz"), 1)
    a, b = tr.groupBy("symbol").agg(F.count("*").alias("train_rows")), oos.groupBy("symbol").agg(F.count("*").alias("oos_rows"))
    return a.join(b, "symbol")
