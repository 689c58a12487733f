"""Targets, costs and position sizes as row expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketspark.functions.rolling import clip, div

#: fixed value: price of a spread pip the cost model applies to every symbol
COST_PIP = 0.01


def sign_of(direction: str = "direction") -> Column:
    d = F.lower(F.col(direction))
    return (F.when(d == "long", 1.0).when(d == "short", -1.0)
            .otherwise(F.raise_error(F.concat(F.lit("bad direction "), d)).cast("double")))


def tp_sl_prices(df: DataFrame, entry: str = "entry_price", atr: str = "atr") -> DataFrame:
    """Target above and stop below a long entry, mirrored for a short."""
    s = sign_of()
    return df.withColumns({"tp_price": F.col(entry) + s * F.col(atr) * F.col("tp_mult"),
                           "sl_price": F.col(entry) - s * F.col(atr) * F.col("sl_mult")})


def costed_price(price: Column, opening: bool, pip: Column | None = None) -> Column:
    """Price after spread, then slippage, both against the trader."""
    s = sign_of() if opening else -sign_of()
    p = price + s * F.col("spread_pips") * (F.lit(COST_PIP) if pip is None else pip)
    return p + s * p * F.col("slippage_pct")


def with_trade_costs(df: DataFrame, entry: str, exit_: str, notional: str, pip_source: str = "fixed") -> DataFrame:
    """Costed entry and exit prices, commission and slippage in money for both ways."""
    pip = F.col("pip_value") if pip_source == "symbol" else None
    n = F.col(notional)
    return df.withColumns({
        "adjusted_entry": costed_price(F.col(entry), True, pip), "adjusted_exit": costed_price(F.col(exit_), False, pip),
        "commission": n * F.col("commission_pct") * 2, "slippage": n * F.col("slippage_pct") * 2})


def position_size(df: DataFrame, equity: float, risk: float = 0.01, cap: float = 0.10) -> DataFrame:
    """Size that loses ``risk`` of equity at the stop, its value capped at ``cap`` of equity; HOLD is 0."""
    hold = (F.col("signal") == "HOLD") | (F.col("entry_price") == F.col("sl_price"))
    dist = F.abs(F.col("entry_price") - F.col("sl_price"))
    value = F.least(div(F.lit(equity * risk), dist) * F.col("entry_price"), F.lit(equity * cap))
    z = F.lit(0.0)
    return df.withColumns({
        "stop_distance": dist, "position_value": F.when(hold, z).otherwise(value),
        "position_size": F.when(hold, z).otherwise(div(value, "entry_price")),
        "risk_amount": F.when(hold, z).otherwise(F.lit(equity * risk))})


def position_size_leveraged(df: DataFrame, equity: float, risk: float, leverage: float, max_margin: float) -> DataFrame:
    """Size by risk with the margin capped at ``max_margin`` of equity; 0 when the margin tops equity or
    the value is below 0.1 % of it."""
    dist = F.abs(F.col("entry_price") - F.col("sl_price"))
    want = div(F.lit(equity * risk), dist) * F.col("entry_price")
    margin = want / leverage
    capped = margin > equity * max_margin
    value = F.when(capped, F.lit(equity * max_margin * leverage)).otherwise(want)
    ok = (dist > 0) & (margin <= equity) & (value >= equity * 0.001)
    size = value / F.col("entry_price")
    z = F.lit(0.0)
    return df.withColumns({
        "position_size": F.when(ok, size).otherwise(z), "position_value": F.when(ok, value).otherwise(z),
        "actual_risk": F.when(ok & capped, size * dist).when(ok, F.lit(equity * risk)).otherwise(z)})


def spread_multiplier(hour: Column, atr_pct: Column) -> Column:
    """Wider spreads at night and in volatile markets, tighter where sessions overlap."""
    m = F.when((hour >= 22) | (hour < 2), 1.5).otherwise(1.0) * F.when((hour >= 13) & (hour < 17), 0.8).otherwise(1.0)
    m = m * F.when(atr_pct > 0.01, 1 + (atr_pct - 0.01) * 20).otherwise(1.0)
    return clip(m, 0.8, 5.0)


def market_impact(notional: Column, price: Column, liquidity: Column, factor: float = 0.5) -> Column:
    """Price impact against the trader in the direction of the trade."""
    return sign_of() * price * (div(notional * factor / 100000.0, liquidity) / 10000.0)


def pip_spread_to_price(pips: Column, spread_pip: Column) -> Column:
    return pips * spread_pip
