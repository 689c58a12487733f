"""The classic indicator library as window expressions over a blocked series.

Definitions are given per function. Recursive averages start from their first input value; a window
is null until full.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketspark.functions import indicators as ind
from marketspark.functions import rolling as R
from marketspark.functions.rolling import div
from marketspark.operators.series import Series, span

#: periods the moving averages are produced for
MA_PERIODS = (5, 10, 20, 50, 100, 200)


def wma(s: Series, c: str, n: int) -> Column:
    """Weights 1..n, newest heaviest; from plain and position-weighted sums."""
    pos = s.index - F.col("_blk") * s.block
    w = s.w(n)
    weighted = F.sum(F.col(c) * pos).over(w) - (pos - n) * F.sum(c).over(w)
    return F.when(F.count(c).over(w) == n, weighted / (n * (n + 1) / 2))


def moving_averages(s: Series) -> Series:
    """SMA, WMA; TRIMA = mean of means; MIDPOINT and MIDPRICE of 14; MAX, MIN, SUM of 10 and 20."""
    s = s.add(**{f"sma_{n}": R.mean(s, "close", n) for n in MA_PERIODS}, **{f"wma_{n}": wma(s, "close", n) for n in MA_PERIODS},
              **{f"_t{n}": R.mean(s, "close", n // 2) for n in (10, 20, 30)},
              midpoint=(R.high(s, "close", 14) + R.low(s, "close", 14)) / 2, midprice=(R.high(s, "high", 14) + R.low(s, "low", 14)) / 2,
              **{f"max_{n}": R.high(s, "close", n) for n in (10, 20)}, **{f"min_{n}": R.low(s, "close", n) for n in (10, 20)},
              **{f"sum_{n}": R.total(s, "close", n) for n in (10, 20)})
    return s.add(**{f"trima_{n}": R.mean(s, f"_t{n}", n // 2 + 1) for n in (10, 20, 30)})


def ema_family(s: Series) -> Series:
    """EMA; DEMA = 2a-b, TEMA = 3a-3b+c of repeated averages; T3 with volume factor .7; TRIX = change of the triple
    average; MACD 12/26/9, MACDFIX with factors .15 and .075; APO, PPO and MACDEXT from simple means."""
    s = s.emas(dense=True, **{f"ema_{n}": ("close", span(n)) for n in (5, 10, 20, 30, 50, 100, 200)},
               _e12=("close", span(12)), _e26=("close", span(26)), _f1=("close", 0.15), _f2=("close", 0.075))
    s = s.add(macd=F.col("_e12") - F.col("_e26"), macdfix=F.col("_f1") - F.col("_f2"), _a=R.mean(s, "close", 12), _b=R.mean(s, "close", 26))
    s = s.add(apo=F.col("_a") - F.col("_b"), ppo=div(F.col("_a") - F.col("_b"), "_b") * 100, macdext=F.col("_a") - F.col("_b"))
    s = s.emas(dense=True, **{f"_d{n}": (f"ema_{n}", span(n)) for n in (5, 10, 20, 30)}, macd_signal=("macd", span(9)), macdfix_signal=("macdfix", span(9)))
    s = s.emas(dense=True, **{f"_t{n}": (f"_d{n}", span(n)) for n in (5, 10, 20, 30)}).emas(dense=True, _q5=("_t5", span(5))).emas(dense=True, _v5=("_q5", span(5)))
    s = s.emas(dense=True, _x5=("_v5", span(5))).add(macdext_signal=R.mean(s, "macdext", 9))
    a = 0.7
    t3 = (F.col("_x5") * -a ** 3 + F.col("_v5") * (3 * a ** 2 + 3 * a ** 3) + F.col("_q5") * (-6 * a ** 2 - 3 * a - 3 * a ** 3)
          + F.col("_t5") * (1 + 3 * a + a ** 3 + 3 * a ** 2))
    return s.add(**{f"dema_{n}": F.col(f"ema_{n}") * 2 - F.col(f"_d{n}") for n in (10, 20, 30)},
                 **{f"tema_{n}": F.col(f"ema_{n}") * 3 - F.col(f"_d{n}") * 3 + F.col(f"_t{n}") for n in (10, 20, 30)},
                 t3=t3, trix=R.pct_change(s, "_t30", 1) * 100, macd_hist=F.col("macd") - F.col("macd_signal"),
                 macdfix_hist=F.col("macdfix") - F.col("macdfix_signal"), macdext_hist=F.col("macdext") - F.col("macdext_signal"))


def kama(s: Series, n: int = 30) -> Series:
    """Adaptive average: factor ``(e (2/3 - 2/31) + 2/31)^2`` with ``e`` the net move over the path length of ``n`` rows;
    starts from the close of row ``n-1``, first shown on row ``n``."""
    fast, slow = 2 / 3, 2 / 31
    s = s.add(_ch=F.abs(R.diff(s, "close")))
    s = s.add(_er=F.coalesce(div(F.abs(R.diff(s, "close", n)), R.total(s, "_ch", n)), F.lit(0.0)))
    s = s.add(_sc=F.pow(F.col("_er") * (fast - slow) + slow, F.lit(2.0)))
    seed = s.index == n - 1
    keep = F.when(seed, 1.0).otherwise(1 - F.col("_sc"))
    s = s.affine(f"_kama{n}", keep, F.when(seed, F.col("close")).otherwise(F.col("_sc") * F.col("close")), n - 1, warm=n + 1)
    return s.add(**{f"kama_{n}": F.when(s.index >= n, F.col(f"_kama{n}"))})


def wilder_family(s: Series, n: int = 14) -> Series:
    """Wilder averages of true range, gains, losses and directional moves; ADXR = mean of ADX and ADX ``n-1`` rows ago."""
    s = ind.directional(s)
    d = R.diff(s, "close")
    s = s.add(trange=F.col("_tr"), _g=F.when(d > 0, d).otherwise(F.when(d.isNotNull(), 0.0)), _ls=F.when(d < 0, -d).otherwise(F.when(d.isNotNull(), 0.0)))
    s = ind.wilder(s, dense=True, atr=("_tr", n), plus_dm=("_pdm", n), minus_dm=("_mdm", n),
                   **{f"_g{k}": ("_g", k, 1) for k in (7, 14, 21)}, **{f"_l{k}": ("_ls", k, 1) for k in (7, 14, 21)})
    s = s.add(natr=div("atr", "close") * 100, plus_di=div("plus_dm", "atr") * 100, minus_di=div("minus_dm", "atr") * 100,
              **{f"rsi_{k}": ind.rsi_expr(F.col(f"_g{k}"), F.col(f"_l{k}")) for k in (7, 14, 21)},
              cmo=div(F.col("_g14") - F.col("_l14"), F.col("_g14") + F.col("_l14")) * 100)
    s = s.add(dx=F.coalesce(div(F.abs(F.col("plus_di") - F.col("minus_di")) * 100, F.col("plus_di") + F.col("minus_di")), F.lit(0.0)))
    s = ind.wilder(s, dense=True, adx=("dx", n))
    return s.add(adxr=(F.col("adx") + s.lag("adx", n - 1)) / 2)


def _stoch_k(s: Series, c: Column, hi, lo, n: int) -> Column:
    h, lw = R.high(s, hi, n), R.low(s, lo, n)
    return div(c - lw, h - lw) * 100


def aroon(s: Series, n: int = 25) -> dict[str, Column]:
    """100 * (n - rows since the latest extreme of the last n+1 rows) / n."""
    up = R.rolling_apply(s, "high", n + 1, lambda v, _: F.array_position(F.reverse(v), F.array_max(v)) - 1)
    dn = R.rolling_apply(s, "low", n + 1, lambda v, _: F.array_position(F.reverse(v), F.array_min(v)) - 1)
    return {"aroon_up": (n - up) * 100.0 / n, "aroon_dn": (n - dn) * 100.0 / n}


def oscillators(s: Series) -> Series:
    """STOCH 5/3/3, STOCHF 5/3, STOCHRSI 14/5/3, WILLR 14, CCI 14 (mean absolute deviation * .015), MFI 14, ULTOSC 7/14/28,
    BOP, MOM, ROC, ROCP, ROCR, ROCR100 of 10, AROON 25."""
    s = s if s.has("rsi_14") else wilder_family(s)
    h, lw, c, pc = F.col("high"), F.col("low"), F.col("close"), s.lag("close")
    tp = ind.typical()
    s = s.add(_tp=tp, _flow=tp * F.col("volume"), _bp=c - F.least(lw, pc), _rng=F.greatest(h, pc) - F.least(lw, pc),
              fastk=_stoch_k(s, c, "high", "low", 5), fastk_rsi=_stoch_k(s, F.col("rsi_14"), "rsi_14", "rsi_14", 5),
              willr=div(R.high(s, "high", 14) - c, R.high(s, "high", 14) - R.low(s, "low", 14)) * -100,
              bop=F.coalesce(div(c - F.col("open"), h - lw), F.lit(0.0)), mom=R.diff(s, "close", 10),
              rocp=R.pct_change(s, "close", 10), **aroon(s))
    up = F.col("_tp") > s.lag("_tp")
    down = F.col("_tp") < s.lag("_tp")
    s = s.add(slowk=R.mean(s, "fastk", 3), fastd=R.mean(s, "fastk", 3), fastd_rsi=R.mean(s, "fastk_rsi", 3), _m=R.mean(s, "_tp", 14),
              _pf=F.when(up, F.col("_flow")).otherwise(0.0), _nf=F.when(down, F.col("_flow")).otherwise(0.0),
              **{f"_u{n}": div(R.total(s, "_bp", n), R.total(s, "_rng", n)) for n in (7, 14, 28)},
              roc=F.col("rocp") * 100, rocr=F.col("rocp") + 1, rocr100=(F.col("rocp") + 1) * 100, aroonosc=F.col("aroon_up") - F.col("aroon_dn"))
    dev = R.rolling_apply(s, "_tp", 14, lambda v, _: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_m"))) / 14)
    return s.add(slowd=R.mean(s, "slowk", 3), cci=div(F.col("_tp") - F.col("_m"), dev * 0.015),
                 mfi=div(R.total(s, "_pf", 14) * 100, R.total(s, "_pf", 14) + R.total(s, "_nf", 14)),
                 ultosc=(F.col("_u7") * 4 + F.col("_u14") * 2 + F.col("_u28")) * (100 / 7))


def volume_lines(s: Series) -> Series:
    """OBV from the first row's volume; AD adds volume by close position in the range; ADOSC = EMA3 - EMA10 of AD."""
    rng = F.col("high") - F.col("low")
    clv = F.coalesce(div(F.col("close") * 2 - F.col("low") - F.col("high"), rng), F.lit(0.0))
    s = s.add(_sv=F.when(s.index == 0, F.col("volume")).otherwise(F.signum(R.diff(s, "close")) * F.col("volume")), _mf=clv * F.col("volume"))
    s = s.running_sums(obv="_sv", ad="_mf").emas(dense=True, _a3=("ad", span(3)), _a10=("ad", span(10)))
    return s.add(adosc=F.col("_a3") - F.col("_a10"))


def price_transforms() -> dict[str, Column]:
    o, h, lw, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return {"avgprice": (o + h + lw + c) / 4, "medprice": (h + lw) / 2, "typprice": (h + lw + c) / 3, "wclprice": (h + lw + c * 2) / 4}


def bands(s: Series) -> Series:
    """Bollinger of 20 and 50 with population deviation, Keltner 20 around EMA20 with 2 ATR20, Donchian 20 of current rows."""
    s = s.emas(dense=True, _e=("close", span(20)))
    s = s.add(_tr=ind.tr_expr(s), **{f"bb_mid_{n}": R.mean(s, "close", n) for n in (20, 50)}, **{f"_sd{n}": R.std_pop(s, "close", n) for n in (20, 50)},
              donch_up20=R.high(s, "high", 20), donch_lo20=R.low(s, "low", 20))
    s = s.add(_ka=R.mean(s, "_tr", 20), **{f"bb_up_{n}": F.col(f"bb_mid_{n}") + F.col(f"_sd{n}") * 2 for n in (20, 50)},
              **{f"bb_lo_{n}": F.col(f"bb_mid_{n}") - F.col(f"_sd{n}") * 2 for n in (20, 50)}, donch_mid20=(F.col("donch_up20") + F.col("donch_lo20")) / 2)
    return s.add(**{f"bb_width_{n}": div(F.col(f"bb_up_{n}") - F.col(f"bb_lo_{n}"), f"bb_mid_{n}") for n in (20, 50)},
                 kelt_up_20=F.col("_e") + F.col("_ka") * 2, kelt_lo_20=F.col("_e") - F.col("_ka") * 2)


def statistics(s: Series) -> Series:
    """BETA of low on high changes over 5, CORREL of high and low over 30, line fits and TSF over 14, STDDEV and VAR of 5."""
    s = s.add(_rh=R.pct_change(s, "high", 1), _rl=R.pct_change(s, "low", 1))
    w = s.w(5)
    fit = R.slope(s, "close", 14)
    return s.add(beta=F.when(F.count("_rh").over(w) == 5, div(F.covar_pop("_rh", "_rl").over(w), F.var_pop("_rh").over(w))),
                 correl=R.corr(s, "high", "low", 30), linearreg=fit["end"], linearreg_angle=fit["angle"], linearreg_intercept=fit["intercept"],
                 linearreg_slope=fit["slope"], tsf=fit["next"], stddev=R.std_pop(s, "close", 5),
                 var=F.when(F.count("close").over(w) == 5, F.var_pop("close").over(w)))
