"""Time helpers: epoch conversion, tumbling buckets, ISO parsing, market hours.

All expressions are built-in Column expressions (codegen, no Python rows).
Timestamps are ``timestamp`` (session time zone pinned to UTC) or
``timestamp_ntz``; both are accepted.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickspark.functions.values import wire_number

MICROS = 1_000_000


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def as_ts(c) -> Column:
    """Cast to ``timestamp`` (UTC session) so epoch functions apply."""
    return _col(c).cast("timestamp")


def epoch_micros(c) -> Column:
    return F.unix_micros(as_ts(c))


def epoch_seconds_double(c) -> Column:
    """Wire form: epoch seconds as a double (``timestamp`` field of a tick)."""
    return epoch_micros(c) / F.lit(1e6)


def bucket_start(c, window_sec: int | Column) -> Column:
    """Epoch-aligned tumbling bucket start: ``int(ts) - int(ts) % w``.

    Works on micros so sub-second ticks fall into the bucket of their whole
    second, like the integer truncation of the reference.
    """
    us = epoch_micros(c)
    w_us = (F.lit(window_sec) if isinstance(window_sec, int) else window_sec).cast("long") * F.lit(MICROS)
    return F.timestamp_micros(us - F.pmod(us, w_us))


def plus_seconds(c, seconds: int | Column) -> Column:
    s = F.lit(seconds) if isinstance(seconds, int) else seconds
    return F.timestamp_micros(epoch_micros(c) + s.cast("long") * F.lit(MICROS))


def event_order_key(time_col, id_col) -> Column:
    """Exact order of events: (micros, event id). ``min_by``/``max_by`` keyed by it combine map-side
    before the shuffle; a struct buffer makes that a sort-based partial aggregate."""
    return F.struct(epoch_micros(time_col).alias("t"), _col(id_col).alias("id"))


def ts_literal(value: str | dt.datetime) -> Column:
    """A UTC timestamp literal from an ISO string or datetime."""
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.to_timestamp(F.lit(value))


def parse_epoch_or_iso(c, now: Column | None = None) -> Column:
    """Alert/tick time on the wire: epoch seconds (number or numeric string),
    else an ISO-8601 string (``Z`` suffix allowed), else ``now``."""
    s = _col(c).cast("string")
    epoch = F.timestamp_micros(F.round(wire_number(s) * F.lit(1e6)).try_cast("long"))
    iso = F.try_to_timestamp(F.regexp_replace(s, "Z$", "+00:00"))
    out = F.coalesce(epoch, iso)
    return F.coalesce(out, now) if now is not None else out


def market_open(c) -> Column:
    """New York regular session: Monday-Friday, 09:30 <= t < 16:00 (no holidays)."""
    ny = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), as_ts(c).cast("timestamp_ntz"))
    minutes = F.hour(ny) * 60 + F.minute(ny)
    weekday = F.weekday(ny)  # 0 = Monday
    return (weekday < 5) & (minutes >= 9 * 60 + 30) & (minutes < 16 * 60)
