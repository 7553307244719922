"""As-of reads, validity windows, freshness and relative windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SKEW = dt.timedelta(minutes=1)
MAX_RANGE = dt.timedelta(days=400)
STALE_HOURS = 24
#: Relative evidence windows in days, by the phrase that asks for them.
WINDOWS = {"month": 30, "quarter": 90, "year": 365}


def stamp(t: dt.datetime) -> Column:
    """A timestamp literal without zone, as the source columns are."""
    return F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")


def as_of(df: DataFrame, column: str | Column, t: dt.datetime | None) -> DataFrame:
    """Rows up to ``t``; no filter at all without one, so that scans prune."""
    return df if t is None else df.filter((F.col(column) if isinstance(column, str) else column) <= stamp(t))


def trailing(df: DataFrame, column: str | Column, days: int, t: dt.datetime | None, now: dt.datetime) -> DataFrame:
    """Rows of the ``days`` before ``t`` (or ``now``); 0 days: all."""
    if not days:
        return df
    c = F.col(column) if isinstance(column, str) else column
    return df.filter(c >= stamp((t or now) - dt.timedelta(days=days)))


def valid_at(valid_from: Column, valid_to: Column, t: Column) -> Column:
    """Half-open: the start belongs to the window, the end does not; null is unbounded."""
    return (valid_from.isNull() | (valid_from <= t)) & (valid_to.isNull() | (valid_to > t))


def valid_in(valid_from: Column, valid_to: Column, start: Column, end: Column) -> Column:
    return (valid_from.isNull() | (valid_from <= end)) & (valid_to.isNull() | (valid_to > start))


def intersect_validity(*windows: tuple[Column, Column]) -> tuple[Column, Column]:
    """The common window; an inverted one collapses to its start.  Null stays unbounded."""
    if len(windows) == 1:
        return windows[0]
    start, end = F.greatest(*[a for a, _ in windows]), F.least(*[b for _, b in windows])
    return start, F.when(start > end, start).otherwise(end)


def check_time(axis: str, now: dt.datetime, start: dt.datetime | None = None, end: dt.datetime | None = None) -> tuple[dt.datetime | None, dt.datetime | None]:
    """Validated bounds: at most a minute in the future (clamped to now), ranges of at most 400 days."""
    if axis not in ("current", "valid_time", "observed_time", "range"):
        raise ValueError(f"unknown time axis {axis}")
    if axis == "current":
        return None, None
    for t in (start, end):
        if t is not None and t > now + MAX_SKEW:
            raise ValueError("the time lies in the future")
    if axis == "range" and (start is None or end is None or end < start or end - start > MAX_RANGE):
        raise ValueError("a range needs a start before its end and at most 400 days")
    return start and min(start, now), end and min(end, now)


def freshness(observed: Column, at: Column) -> Column:
    """missing, stale (over a day old) or fresh."""
    return F.when(observed.isNull(), "missing").when(observed < at - F.expr(f"INTERVAL {STALE_HOURS} HOURS"), "stale").otherwise("fresh")


def window_days(question: Column) -> Column:
    """Days of the one relative window that a question names; null if it names none or several."""
    named = [F.when(question.rlike(rf"(?i)\b(last|past)\s+{word}\b"), F.lit(days)) for word, days in WINDOWS.items()]
    hits = sum((n.isNotNull().cast("int") for n in named[1:]), named[0].isNotNull().cast("int"))
    return F.when(hits == 1, F.coalesce(*named))
