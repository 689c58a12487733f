"""Trading sessions by hour or minute of the day (UTC). The schemes differ on purpose."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketspark.functions.rolling import clip, flag

#: fixed values: start and end minute of sessions 0 Asia, 1 Europe, 2 US, 3 late
WINDOWS = [(0, 420), (420, 780), (780, 1260), (1260, 1440)]


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def window_session(ts: Column) -> Column:
    """0 Asia, 1 Europe, 2 US, 3 late."""
    m = minute_of_day(ts)
    return F.when(m < 420, 0).when(m < 780, 1).when(m < 1260, 2).otherwise(3)


def session_pos(ts: Column) -> Column:
    """How far into its session a time is, 0 to 1."""
    m = minute_of_day(ts)
    pos = None
    for a, b in WINDOWS:
        here = (m - a) / (b - a)
        pos = F.when(m < b, here) if pos is None else pos.when(m < b, here)
    return clip(pos, 0, 1)


def overlap_flags(hour: Column) -> dict[str, Column]:
    """Sessions with inclusive bounds that overlap."""
    return {"is_asian_session": flag(hour.between(0, 8)), "is_london_session": flag(hour.between(8, 16)),
            "is_ny_session": flag(hour.between(13, 21))}


def named_session(hour: Column) -> Column:
    """The latest session to have opened: NY over London over Asian; what is left is off hours."""
    return (F.when((hour >= 13) & (hour < 22), "ny").when((hour >= 8) & (hour < 17), "london")
            .when(hour < 9, "asian").otherwise("off"))


def guard_session(hour: Column) -> Column:
    return (F.when(hour < 8, "asia").when(hour < 16, "europe").when((hour >= 13) & (hour < 21), "us").otherwise("overnight"))


def audit_session(hour: Column) -> Column:
    return (F.when((hour >= 22) | (hour < 2), "Asian").when((hour >= 7) & (hour < 16), "London")
            .when((hour >= 13) & (hour < 21), "NY").otherwise("Off-hours"))


def in_hours(hour: Column, start: int, end: int) -> Column:
    """Start inclusive, end exclusive; a session may wrap midnight."""
    return (hour >= start) & (hour < end) if start < end else (hour >= start) | (hour < end)


def time_features(ts: Column) -> dict[str, Column]:
    """Clock and calendar columns, plain and cyclic; Monday is day 0."""
    h, d = F.hour(ts), F.weekday(ts)
    t, w = h * (2 * math.pi / 24), d * (2 * math.pi / 7)
    return {"hour": h, "dow": d, "minute_of_day": minute_of_day(ts), "hour_sin": F.sin(t), "hour_cos": F.cos(t),
            "dow_sin": F.sin(w), "dow_cos": F.cos(w)}
