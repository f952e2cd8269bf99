"""Calendar keys and wall-clock text. Everything is UTC."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def date_key(date: Column) -> Column:
    """``yyyymmdd`` as an integer."""
    return (F.year(date) * 10_000 + F.month(date) * 100 + F.dayofmonth(date)).cast("int")


def iso_utc(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def as_of_date(as_of: dt.date | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of)


def load_time(load_ts: dt.datetime | None) -> Column:
    """Audit timestamp of a load as UTC wall clock."""
    now = F.current_timestamp() if load_ts is None else F.lit(load_ts.replace(tzinfo=load_ts.tzinfo or dt.timezone.utc))
    return now.cast("timestamp_ntz")
