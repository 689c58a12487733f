"""Dimension tables of fixed size: trading costs, targets and stops, pip values, currencies, index returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: fixed values: symbol, spread in pips, commission and slippage as shares of notional, least distance in pips
COSTS = [
    ("XAUUSD", 3.0, 0.00002, 0.00001, 5.0),
    ("XAGUSD", 2.0, 0.00002, 0.00001, 3.0),
    ("EURUSD", 0.8, 0.00002, 0.000005, 1.0),
    ("GBPUSD", 1.2, 0.00002, 0.000005, 1.0),
    ("AUDUSD", 0.9, 0.00002, 0.000005, 1.0),
    ("NZDUSD", 1.5, 0.00002, 0.000005, 1.0),
    ("USDJPY", 0.8, 0.00002, 0.000005, 1.0),
    ("USDCAD", 1.5, 0.00002, 0.000005, 1.0),
]

#: fixed values: take-profit in ATRs per timeframe; the stop is 1 ATR everywhere
TIMEFRAMES = ("5T", "15T", "30T", "1H", "4H")
TAKE_PROFIT = {
    "XAUUSD": (1.4, 1.6, 2.0, 2.2, 2.5),
    "XAGUSD": (1.4, 1.5, 2.0, 2.2, 2.5),
    "EURUSD": (1.1, 1.3, 1.5, 1.7, 1.9),
    "GBPUSD": (1.2, 1.4, 1.6, 1.8, 2.0),
    "AUDUSD": (1.1, 1.3, 1.5, 1.7, 1.9),
    "NZDUSD": (1.1, 1.3, 1.5, 1.7, 1.9),
    "USDJPY": (1.1, 1.3, 1.5, 1.7, 1.9),
    "USDCAD": (1.1, 1.3, 1.5, 1.7, 1.9),
}
STOP_LOSS = 1.0

#: fixed values: price of one pip, and of one quoted spread pip where it differs
PIP = {"XAUUSD": 0.01, "XAGUSD": 0.001, "EURUSD": 0.0001, "GBPUSD": 0.0001, "AUDUSD": 0.0001, "NZDUSD": 0.0001,
       "USDJPY": 0.01, "USDCAD": 0.0001}
DEFAULT_PIP = 0.0001
SPREAD_PIP = {"XAUUSD": 0.10, "XAGUSD": 0.01}

#: fixed values: yearly return of the index, and what to assume for other years
INDEX_RETURNS = {2019: 0.289, 2020: 0.164, 2021: 0.269, 2022: -0.182, 2023: 0.243, 2024: 0.235, 2025: 0.15}
DEFAULT_INDEX_RETURN = 0.15


def costs(spark: SparkSession, rename: dict[str, str] | None = None) -> DataFrame:
    """Cost table; ``rename`` maps a symbol of ours to the one whose values it takes."""
    rows = COSTS if rename is None else [(new, *r[1:]) for new, old in rename.items() for r in COSTS if r[0] == old]
    return spark.createDataFrame(
        rows, "symbol string, spread_pips double, commission_pct double, slippage_pct double, min_distance_pips double")


def tp_sl(spark: SparkSession, rename: dict[str, str] | None = None) -> DataFrame:
    names = rename or {s: s for s in TAKE_PROFIT}
    rows = [(new, tf, tp, STOP_LOSS) for new, old in names.items() for tf, tp in zip(TIMEFRAMES, TAKE_PROFIT[old])]
    return spark.createDataFrame(rows, "symbol string, timeframe string, tp_mult double, sl_mult double")


def pips(spark: SparkSession, rename: dict[str, str] | None = None) -> DataFrame:
    names = rename or {s: s for s in PIP}
    rows = [(new, PIP[old], SPREAD_PIP.get(old, DEFAULT_PIP)) for new, old in names.items()]
    return spark.createDataFrame(rows, "symbol string, pip_value double, spread_pip double")


def index_returns(spark: SparkSession, values: dict[int, float] | None = None) -> DataFrame:
    return spark.createDataFrame(list((values or INDEX_RETURNS).items()), "year int, index_return double")
