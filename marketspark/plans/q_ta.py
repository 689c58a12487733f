"""The indicator library and candle patterns."""

from marketspark.functions import candles as K
from marketspark.functions import ta
from marketspark.operators.series import ema_halo, span, wilder_alpha
from marketspark.plans import sqlkit as q
from marketspark.plans.q_windows import DM, FS1_HALO, TR, simple

MA = ta.MA_PERIODS
DEEP = ema_halo(span(200)) + ema_halo(*[span(30)] * 3) + 300
WILDER = ema_halo(wilder_alpha(21), wilder_alpha(14)) + 200


def wma(n):
    return (f"(CASE WHEN count(close) {q.over(n)} = {n} THEN list_sum(list_transform(list(close) {q.over(n)}, lambda x, i: x * i)) / {n * (n + 1) / 2} END)")


@simple("ta_1_moving_averages", 210, " ".join([*(f"sma_{n}" for n in MA), *(f"wma_{n}" for n in MA), *(f"trima_{n}" for n in (10, 20, 30)),
        "midpoint midprice max_10 min_10 sum_10 max_20 min_20 sum_20"]),
        [{**{f"sma_{n}": q.mean("close", n) for n in MA}, **{f"wma_{n}": wma(n) for n in MA}, **{f"h{n}": q.mean("close", n // 2) for n in (10, 20, 30)},
          "midpoint": f"({q.hi('close', 14)} + {q.lo('close', 14)}) / 2", "midprice": f"({q.hi('high', 14)} + {q.lo('low', 14)}) / 2",
          **{f"max_{n}": q.hi("close", n) for n in (10, 20)}, **{f"min_{n}": q.lo("close", n) for n in (10, 20)}, **{f"sum_{n}": q.total("close", n) for n in (10, 20)}},
         {f"trima_{n}": q.mean(f"h{n}", n // 2 + 1) for n in (10, 20, 30)}])
def ta_1(s):
    return ta.moving_averages(s)


E3 = (5, 10, 20, 30)


@simple("ta_2_ema_family", DEEP, "ema_5 ema_200 dema_10 dema_20 dema_30 tema_10 tema_20 tema_30 t3 trix macd macd_signal macd_hist macdfix macdfix_signal macdfix_hist apo ppo macdext macdext_signal macdext_hist",
        [{**{f"ema_{n}": q.ema("close", q.sp(n)) for n in (*E3, 200)}, "macd": f"{q.ema('close', q.sp(12))} - {q.ema('close', q.sp(26))}",
          "macdfix": f"{q.ema('close', 0.15)} - {q.ema('close', 0.075)}", "a": q.mean("close", 12), "b": q.mean("close", 26)},
         {**{f"d{n}": q.ema(f"ema_{n}", q.sp(n)) for n in E3}, "apo": "a - b", "ppo": "100 * (a - b) / b", "macdext": "a - b", "macd_signal": q.ema("macd", q.sp(9)), "macdfix_signal": q.ema("macdfix", q.sp(9))},
         {**{f"t{n}": q.ema(f"d{n}", q.sp(n)) for n in E3}, "macdext_signal": q.mean("macdext", 9)}, {"q5": q.ema("t5", q.sp(5))}, {"v5": q.ema("q5", q.sp(5))}, {"x5": q.ema("v5", q.sp(5))},
         {**{f"dema_{n}": f"2 * ema_{n} - d{n}" for n in E3[1:]}, **{f"tema_{n}": f"3 * ema_{n} - 3 * d{n} + t{n}" for n in E3[1:]},
          "t3": "-0.343 * x5 + (3 * 0.49 + 3 * 0.343) * v5 + (-6 * 0.49 - 2.1 - 3 * 0.343) * q5 + (1 + 2.1 + 0.343 + 3 * 0.49) * t5", "trix": f"100 * {q.pct('t30', 1)}",
          "macd_hist": "macd - macd_signal", "macdfix_hist": "macdfix - macdfix_signal", "macdext_hist": "macdext - macdext_signal"}])
def ta_2(s):
    return ta.ema_family(s)


@simple("ta_3_kama", 12000, "kama_30",
        [{"ch": f"abs(close - {q.lag('close')})", "i": f"row_number() OVER ({q.PART}) - 1"},
         {"sc": f"power(coalesce(abs(close - {q.lag('close', 30)}) / nullif({q.total('ch', 30)}, 0), 0) * (2.0 / 3 - 2.0 / 31) + 2.0 / 31, 2)"},
         {"kama_30": f"""CASE WHEN i >= 30 THEN list_reduce(list({{'s': CAST(sc AS DOUBLE), 'x': CAST(close AS DOUBLE)}}) FILTER (i >= 29) OVER ({q.PART} ROWS UNBOUNDED PRECEDING),
          lambda a, v: {{'s': v.s, 'x': a.x + v.s * (v.x - a.x)}}).x END"""}])
def ta_3(s):
    return ta.kama(s)


def wil(x, n):
    return q.ema(x, 1 / n)


RS = (7, 14, 21)
WILD = [*DM, {"g": f"CASE WHEN close > {q.lag('close')} THEN close - {q.lag('close')} WHEN pc IS NOT NULL THEN 0 END",
              "ls": f"CASE WHEN close < {q.lag('close')} THEN {q.lag('close')} - close WHEN pc IS NOT NULL THEN 0 END"},
        {"atr": wil("trange", 14), "plus_dm": wil("pdm", 14), "minus_dm": wil("mdm", 14), **{f"g{k}": wil("g", k) for k in RS}, **{f"l{k}": wil("ls", k) for k in RS}},
        {"natr": "100 * atr / close", "plus_di": "100 * plus_dm / nullif(atr, 0)", "minus_di": "100 * minus_dm / nullif(atr, 0)",
         **{f"rsi_{k}": f"CASE WHEN l{k} > 0 THEN 100 - 100 / (1 + g{k} / l{k}) WHEN g{k} > 0 THEN 100.0 END" for k in RS}, "cmo": "100 * (g14 - l14) / nullif(g14 + l14, 0)"},
        {"dx": "coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0)"}, {"adx": wil("dx", 14)}]


@simple("ta_4_wilder_family", WILDER, "atr natr rsi_7 rsi_14 rsi_21 plus_dm minus_dm plus_di minus_di dx adx adxr cmo", [*WILD, {"adxr": f"(adx + {q.lag('adx', 13)}) / 2"}])
def ta_4(s):
    return ta.wilder_family(s)


def latest(fn, x, n):
    return f"(CASE WHEN count({x}) {q.over(n)} = {n} THEN list_position(list_reverse(list({x}) {q.over(n)}), {fn}({x}) {q.over(n)}) - 1 END)"


OSC = [*WILD, {"tp": "(high + low + close) / 3", "bp": "close - least(low, pc)", "rg": "greatest(high, pc) - least(low, pc)",
               "fastk": f"100 * (close - {q.lo('low', 5)}) / nullif({q.hi('high', 5)} - {q.lo('low', 5)}, 0)",
               "fastk_rsi": f"100 * (rsi_14 - {q.lo('rsi_14', 5)}) / nullif({q.hi('rsi_14', 5)} - {q.lo('rsi_14', 5)}, 0)",
               "willr": f"-100 * ({q.hi('high', 14)} - close) / nullif({q.hi('high', 14)} - {q.lo('low', 14)}, 0)", "bop": "coalesce((close - open) / nullif(high - low, 0), 0)",
               "mom": f"close - {q.lag('close', 10)}", "rocp": q.pct("close", 10), "aroon_up": f"(25 - {latest('max', 'high', 26)}) * 100.0 / 25", "aroon_dn": f"(25 - {latest('min', 'low', 26)}) * 100.0 / 25"},
       {"slowk": q.mean("fastk", 3), "fastd": q.mean("fastk", 3), "fastd_rsi": q.mean("fastk_rsi", 3), "m14": q.mean("tp", 14), "pf": f"CASE WHEN tp > {q.lag('tp')} THEN tp * volume ELSE 0 END",
        "nf": f"CASE WHEN tp < {q.lag('tp')} THEN tp * volume ELSE 0 END", **{f"u{n}": f"{q.total('bp', n)} / nullif({q.total('rg', n)}, 0)" for n in (7, 14, 28)},
        "roc": "rocp * 100", "rocr": "rocp + 1", "rocr100": "(rocp + 1) * 100", "aroonosc": "aroon_up - aroon_dn"},
       {"slowd": q.mean("slowk", 3), "cci": f"(tp - m14) / nullif(0.015 * list_avg(list_transform(list(tp) {q.over(14)}, lambda x: abs(x - m14))), 0)",
        "mfi": f"100 * {q.total('pf', 14)} / nullif({q.total('pf', 14)} + {q.total('nf', 14)}, 0)", "ultosc": "100 * (4 * u7 + 2 * u14 + u28) / 7"}]


@simple("ta_5_oscillators", WILDER, "slowk slowd fastk fastd fastk_rsi fastd_rsi willr cci mfi ultosc bop mom roc rocp rocr rocr100 aroon_up aroon_dn aroonosc", OSC)
def ta_5(s):
    return ta.oscillators(s)


@simple("ta_6_volume_lines", FS1_HALO, "obv ad adosc",
        [{"sv": f"CASE WHEN {q.lag('close')} IS NULL THEN volume ELSE sign(close - {q.lag('close')}) * volume END", "mf": "coalesce((2 * close - low - high) / nullif(high - low, 0), 0) * volume"},
         {"obv": f"sum(sv) OVER ({q.PART})", "ad": f"sum(mf) OVER ({q.PART})"}, {"adosc": f"{q.ema('ad', q.sp(3))} - {q.ema('ad', q.sp(10))}"}])
def ta_6(s):
    return ta.volume_lines(s)


@simple("ta_7_price_transforms", 1, "avgprice medprice typprice wclprice trange",
        [{**TR, "avgprice": "(open + high + low + close) / 4", "medprice": "(high + low) / 2", "typprice": "(high + low + close) / 3", "wclprice": "(high + low + 2 * close) / 4"}])
def ta_7(s):
    return s.add(**ta.price_transforms(), trange=ta.ind.tr_expr(s))


@simple("ta_8_bands", FS1_HALO, "bb_up_20 bb_mid_20 bb_lo_20 bb_width_20 bb_up_50 bb_mid_50 bb_lo_50 bb_width_50 kelt_up_20 kelt_lo_20 donch_up20 donch_lo20 donch_mid20",
        [{**TR, "e": q.ema("close", q.sp(20)), **{f"bb_mid_{n}": q.mean("close", n) for n in (20, 50)}, **{f"sd{n}": q.roll("stddev_pop", "close", n) for n in (20, 50)},
          "donch_up20": q.hi("high", 20), "donch_lo20": q.lo("low", 20)},
         {"ka": q.mean("trange", 20), **{f"bb_up_{n}": f"bb_mid_{n} + 2 * sd{n}" for n in (20, 50)}, **{f"bb_lo_{n}": f"bb_mid_{n} - 2 * sd{n}" for n in (20, 50)},
          "donch_mid20": "(donch_up20 + donch_lo20) / 2", **{f"bb_width_{n}": f"4 * sd{n} / bb_mid_{n}" for n in (20, 50)}},
         {"kelt_up_20": "e + 2 * ka", "kelt_lo_20": "e - 2 * ka"}])
def ta_8(s):
    return ta.bands(s)


@simple("ta_9_statistics", 35, "beta correl linearreg linearreg_angle linearreg_intercept linearreg_slope tsf stddev var",
        [{"rh": q.pct("high", 1), "rl": q.pct("low", 1), "i": f"CAST(row_number() OVER ({q.PART}) - 1 AS DOUBLE)"},
         {"beta": f"CASE WHEN count(rh) {q.over(5)} = 5 THEN covar_pop(rh, rl) {q.over(5)} / nullif(var_pop(rh) {q.over(5)}, 0) END",
          "correl": f"CASE WHEN count(high) {q.over(30)} = 30 THEN corr(high, low) {q.over(30)} END", "linearreg_slope": f"CASE WHEN count(close) {q.over(14)} = 14 THEN regr_slope(close, i) {q.over(14)} END",
          "m": f"avg(close) {q.over(14)}", "stddev": q.roll("stddev_pop", "close", 5), "var": q.roll("var_pop", "close", 5)},
         {"linearreg": "m + 6.5 * linearreg_slope", "linearreg_angle": "degrees(atan(linearreg_slope))", "linearreg_intercept": "m - 6.5 * linearreg_slope", "tsf": "m + 7.5 * linearreg_slope"}])
def ta_9(s):
    return ta.statistics(s)


def sql_shape(bars):
    src = {"o": "open", "h": "high", "l": "low", "c": "close", "b": "b", "r": "r", "ab": "ab", "ar": "ar"}
    n = max(bars, 2)
    return [{"b": "abs(close - open)", "r": "high - low"}, {"ab": q.mean("b", 10, -1), "ar": q.mean("r", 10, -1)},
            {f"{k}{i}": (c if i == 0 else q.lag(c, i)) for i in range(n) for k, c in src.items()},
            {**{f"u{i}": f"h{i} - greatest(o{i}, c{i})" for i in range(n)}, **{f"d{i}": f"least(o{i}, c{i}) - l{i}" for i in range(n)}}]


def candle_query(name, rules, bars):
    cols = " ".join(f"cdl{k}" for k in rules)
    steps = [*sql_shape(bars), {f"cdl{k}": "CASE " + (f"WHEN {a} THEN 100 " if a else "") + (f"WHEN {b} THEN -100 " if b else "") + "ELSE 0 END" for k, (a, b) in rules.items()}]
    simple(name, 20, cols, steps)(lambda s: K.patterns(s, rules, bars))


candle_query("ta_10_one_bar_candles", K.ONE_BAR, 1)
candle_query("ta_11_two_bar_candles", K.TWO_BAR, 2)
candle_query("ta_12_three_bar_candles", K.THREE_BAR, 3)
candle_query("ta_13_four_five_bar_candles", K.FOUR_FIVE_BAR, 5)
