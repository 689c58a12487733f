"""Operators that need ordered state per series: duplicate suppression, cooldown, recent bars, outcome, drift, staleness.

State is small and bounded (a time, a run of bars, open signals, twenty results) and lives in the state store. A
trigger's rows of a key arrive in chunks; they are put in time order before the state moves, so the size of a trigger
(``maxFilesPerTrigger`` at the source) bounds memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KEYS = ("symbol", "timeframe")

#: fixed values: minutes a signal stays valid per timeframe
VALIDITY = {"5T": 15, "15T": 45, "30T": 90}
DEFAULT_VALIDITY = 90

#: rows of a key whose figures are worked out and handed on at a time
PIECE = 65_536


def _ordered(chunks: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    parts = list(chunks)
    return pd.concat(parts, ignore_index=True).sort_values(list(by), kind="stable") if parts else pd.DataFrame()


class _LastAccepted(StatefulProcessor):
    """One number a series: when its last accepted signal was. A subclass says which rows of a trigger are accepted."""

    def init(self, handle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")

    def close(self) -> None:
        pass

    def _get(self) -> int | None:
        return self.last.get()[0] if self.last.exists() else None


class _Suppress(_LastAccepted):
    def __init__(self, ts: str, minutes: dict[str, int], expire: bool):
        self.ts, self.minutes, self.expire = ts, minutes, expire

    def handleInputRows(self, key, rows, timerValues):
        got = _ordered(rows, self.ts)
        times = got[self.ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        gap = self.minutes.get(key[1], DEFAULT_VALIDITY) * 60_000_000
        last, keep = self._get(), []
        i = 0 if last is None else int(np.searchsorted(times, last + gap))
        while i < len(times):  # from one kept signal to the next, not row by row
            keep.append(i)
            last = int(times[i])
            i = int(np.searchsorted(times, last + gap))
        if keep:
            self.last.update((last,))
        if self.expire and last is not None:
            self._until(last + gap)
        yield got.iloc[keep]

    def _until(self, end: int) -> None:
        """The series is forgotten once event time is past ``end``: no later signal can be suppressed any more."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(end // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.last.clear()
        return iter(())


def suppress_duplicates(signals: DataFrame, ts: str = "ts", validity: dict[str, int] | None = None, delay: str | None = None) -> DataFrame:
    """Keep a signal only when the last kept one of its series is no longer valid.

    With ``delay`` signals later than that are dropped, and a series' state goes by a timer as soon as event time has
    passed its last signal's validity; without, state is one number for every series ever seen.
    """
    schema = signals.schema
    if delay is not None:
        signals = signals.withWatermark(ts, delay)
    step = _Suppress(ts, validity or VALIDITY, delay is not None)
    return signals.groupBy(*KEYS).transformWithStateInPandas(step, schema, "append", "EventTime" if delay is not None else "None")


class _Cooldown(_LastAccepted):
    def __init__(self, ts: str, index: str, bars: int):
        self.ts, self.index, self.bars = ts, index, bars

    def handleInputRows(self, key, rows, timerValues):
        got = _ordered(rows, self.ts)
        at = got[self.index].to_numpy()
        free = ~got["position_open"].to_numpy(dtype=bool) if "position_open" in got else np.ones(len(got), dtype=bool)
        last = self._get()
        ready, accepted = np.zeros(len(got), dtype=bool), np.zeros(len(got), dtype=bool)
        i = 0
        while i < len(got):  # from one accepted signal to the next
            start = i if last is None else max(i, int(np.searchsorted(at, last + self.bars)))
            hits = np.flatnonzero(free[start:])
            stop = start + int(hits[0]) if len(hits) else len(got)
            ready[start:stop + 1] = True
            if stop >= len(got):
                break
            accepted[stop] = True
            last, i = int(at[stop]), stop + 1
        if accepted.any():
            self.last.update((last,))
        yield got.assign(accepted=accepted, veto=np.where(accepted, "", np.where(ready, "position_open", "cooldown")))


def cooldown(signals: DataFrame, ts: str = "ts", index: str = "bar_index", bars: int = 5) -> DataFrame:
    """Veto signals within ``bars`` bars of the last accepted one, or while a position is open (``position_open``)."""
    schema = signals.withColumn("accepted", F.lit(True)).withColumn("veto", F.lit("")).schema
    return signals.groupBy(*KEYS).transformWithStateInPandas(_Cooldown(ts, index, bars), schema, "append", "None")


class _Recent(StatefulProcessor):
    def __init__(self, ts: str, n: int, state: str):
        self.ts, self.n, self.state = ts, n, state

    def init(self, handle) -> None:
        self.tail = handle.getListState("tail", self.state)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        new = _ordered(rows, self.ts).drop_duplicates(self.ts, keep="last")
        old = pd.DataFrame(list(self.tail.get()), columns=new.columns) if self.tail.exists() else new.iloc[:0]
        old = old[~old[self.ts].isin(new[self.ts])]
        both = pd.concat([old.assign(fresh=False), new.assign(fresh=True)] if len(old) else [new.assign(fresh=True)], ignore_index=True).sort_values(self.ts, kind="stable")
        kept = both.drop(columns="fresh").tail(self.n).astype(object)
        self.tail.put([tuple(None if v is pd.NaT or v != v else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in r) for r in kept.itertuples(index=False)])
        first = int(np.argmax(both["fresh"].to_numpy()))
        yield both.iloc[max(first - self.n, 0):]


def with_recent(bars: DataFrame, n: int, ts: str = "bar_ts") -> DataFrame:
    """New bars (``fresh``) of each trigger, with up to ``n`` bars of their series before them, from state.

    Work per trigger depends on the series it touches and on ``n``, never on the history. A bar that comes again
    replaces the one in state.
    """
    state = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema)
    out = bars.withColumn("fresh", F.lit(True)).schema
    return bars.groupBy(*KEYS).transformWithStateInPandas(_Recent(ts, n, state), out, "append", "None")


OUTCOME = "signal_id long, symbol string, direction string, status string, exit_price double, pnl double, exit_ts timestamp"


def monitor_outcomes(signals: DataFrame, prices: DataFrame) -> DataFrame:
    """Close each open signal at its target, its stop or its expiry.

    ``signals``: signal_id, symbol, ts, direction, entry_price, tp_price, sl_price, expires_at; ``prices``: symbol, ts, price.
    A price of the signal's own instant does not count. Open signals wait in state until closed.
    """
    cols = ["ts", "signal_id", "direction", "entry_price", "tp_price", "sl_price", "expires_at", "price"]
    typed = {"ts": "timestamp", "signal_id": "long", "direction": "string", "expires_at": "timestamp"}
    pad = lambda df: df.select("symbol", *((F.col(c) if c in df.columns else F.lit(None)).cast(typed.get(c, "double")).alias(c) for c in cols))
    both = pad(signals).unionByName(pad(prices))
    fields = "id array<long>, dir array<string>, entry array<double>, tp array<double>, sl array<double>, since array<timestamp>, until array<timestamp>"

    def step(key, chunks, state: GroupState):
        rows = _ordered(chunks, "ts")
        opened = [list(x) for x in zip(*state.get)] if state.exists else []
        new = rows[rows["signal_id"].notna()]
        opened += [[int(r.signal_id), r.direction, r.entry_price, r.tp_price, r.sl_price, r.ts.to_pydatetime(), r.expires_at.to_pydatetime()] for r in new.itertuples(index=False)]
        quotes = rows[rows["price"].notna()]
        at, px = quotes["ts"].to_numpy(), quotes["price"].to_numpy()
        out, left = [], []
        for o in opened:  # one array scan per open signal
            i, d, e, tp, sl, since, until = o
            sign = 1 if d == "long" else -1
            a, b = np.searchsorted(at, [np.datetime64(since), np.datetime64(until)], side="right")
            hit = np.flatnonzero((sign * (px[a:b] - tp) >= 0) | (sign * (px[a:b] - sl) <= 0))
            if len(hit):
                k = a + int(hit[0])
                won = sign * (px[k] - tp) >= 0
                exit_px = tp if won else sl
                out.append((i, key[0], d, "take_profit" if won else "stop_loss", exit_px, sign * (exit_px - e), pd.Timestamp(at[k])))
            elif len(at) and at[-1] > np.datetime64(until):
                out.append((i, key[0], d, "expired", None, None, until))
            else:
                left.append(o)
        opened = left
        if opened:
            state.update(tuple([list(c) for c in zip(*opened)]))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[f.split()[0] for f in OUTCOME.split(", ")])
    return both.groupBy("symbol").applyInPandasWithState(step, OUTCOME, fields, "append", GroupStateTimeout.NoTimeout)


def _columns(chunks: Iterator[pd.DataFrame], ts: str, whole: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, values) of a trigger's rows of a key by time and id, nulls last (the largest number): 24 bytes a row, no strings."""
    none, parts = np.iinfo(np.int64).max, []
    for c in chunks:
        at = c[ts].to_numpy().astype("datetime64[us]").astype(np.int64)
        parts.append((np.where(c[ts].isna(), none, at), c[whole].astype("Int64").to_numpy(np.int64, na_value=none), c[value].to_numpy(np.float64, na_value=np.nan)))
    at, ids, values = (np.concatenate(x) if x else np.zeros(0) for x in (list(zip(*parts)) or [()] * 3))
    del parts
    by = np.lexsort((ids, at))
    return ids[by], values[by]


def _trailing(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``n`` values in a row, each added up anew: the same whatever came in which trigger or piece."""
    out = np.zeros(max(len(x) - n + 1, 0))
    for k in range(n):
        out += x[k:k + len(out)]
    return out


def drift_monitor(trades: DataFrame, ts: str = "ts", trade_id: str = "trade_id", n: int = 20, warn: float = 1.1, halt: float = 0.9, capital: float = 100000.0,
                  max_dd: float = 6.0) -> DataFrame:
    """Rolling profit factor of the last ``n`` trades with a status, and a halt when drawdown passes ``max_dd`` percent.

    Of a trigger's rows of a key only time, id and result are held, as plain numbers; figures are worked out and leave
    in pieces of PIECE rows.
    """
    schema = f"symbol string, timeframe string, {trade_id} long, rolling_pf double, status string, halted boolean"

    def step(key, chunks, state: GroupState):
        ids, values = _columns(chunks, ts, trade_id, "pnl")
        last, equity, peak = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], capital, capital)
        for lo in range(0, len(ids), PIECE):
            own, p = ids[lo:lo + PIECE], values[lo:lo + PIECE]
            run = np.concatenate([np.array(last, float), p])
            finite = np.where(np.isinf(run), np.nan, run)
            win, loss = _trailing(np.maximum(finite, 0.0), n), _trailing(np.maximum(-finite, 0.0), n)
            ratio = np.where(loss > 0, np.divide(win, loss, out=np.zeros_like(win), where=loss > 0), np.where(np.isnan(win), np.nan, 0.0))
            pf = np.concatenate([np.full(len(run) - len(ratio), np.nan), ratio])[len(last):]
            eq = np.cumsum(np.concatenate([[equity], p]))[1:]
            peaks = np.maximum.accumulate(np.concatenate([[peak], eq]))[1:]
            status = np.select([np.isnan(pf), pf < halt, pf < warn], ["insufficient_data", "halt", "warning"], "healthy")
            last, equity, peak = run[max(len(run) - n + 1, 0):].tolist(), float(eq[-1]), float(peaks[-1])
            state.update((last, equity, peak))
            yield pd.DataFrame({"symbol": key[0], "timeframe": key[1], trade_id: pd.arrays.IntegerArray(own, own == np.iinfo(np.int64).max), "rolling_pf": pf, "status": status, "halted": (peaks - eq) / peaks * 100 > max_dd})
    return trades.groupBy(*KEYS).applyInPandasWithState(step, schema, "last array<double>, equity double, peak double", "append", GroupStateTimeout.NoTimeout)


def staleness_alerts(signals: DataFrame, ts: str = "ts", minutes: int = 10, delay: str = "0 seconds") -> DataFrame:
    """An alert when a series is silent for ``minutes`` of event time, between its signals or after its last one."""
    s = signals.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(*KEYS, ts)

    def step(key, chunks, state: GroupState):
        names = ["symbol", "timeframe", "last_ts", "kind"]
        if state.hasTimedOut:
            last = pd.Timestamp(state.get[0])
            state.remove()
            yield pd.DataFrame([(*key, last, "silent")], columns=names)
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for t in _ordered(chunks, ts)[ts]:
            if last is not None and t - last > pd.Timedelta(minutes=minutes):
                out.append((*key, last, "gap"))
            last = t if last is None else max(last, t)
        state.update((last.to_pydatetime(),))
        limit = int(last.timestamp() * 1000) + minutes * 60000
        state.setTimeoutTimestamp(max(limit, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)
    return s.groupBy(*KEYS).applyInPandasWithState(step, "symbol string, timeframe string, last_ts timestamp, kind string", "last timestamp", "append",
                                                   GroupStateTimeout.EventTimeTimeout)
