"""Date expressions: parsing, keys, hour buckets, weeks and windows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from casebook import fixed


def parse_timestamp(c: Column) -> Column:
    """First format that fits: fractional, plain, date only, then ISO with zone."""
    formats = [
        (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "yyyy-M-d H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
        (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-M-d H:m:s"),
        (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    ]
    tries = [F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt))) for shape, fmt in formats]
    iso = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T"), c.try_cast("timestamp"))
    return F.coalesce(*tries, iso)


def date_key(c: Column) -> Column:
    """Day of a timestamp, as a date."""
    return F.to_date(c)


def text_date_key(c: Column) -> Column:
    """First ten characters of a textual date."""
    return F.substring(c.cast("string"), 1, 10)


def hour_bucket(c: Column) -> Column:
    return F.date_format(F.date_trunc("hour", c), "yyyy-MM-dd HH:00")


def local_hour(c: Column, zone: str = "America/Sao_Paulo") -> Column:
    """Hour label of a UTC timestamp in a local zone."""
    return F.date_format(F.from_utc_timestamp(c.cast("timestamp"), zone), "dd/MM HH:00")


def week_key(c: Column) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", c))


def period_key(c: Column) -> Column:
    """Canonical day period; spelling variants are merged."""
    return F.when(F.lower(c).isin("manha", "manhã"), F.lit("manhã")).otherwise(c)


def period_rank(c: Column) -> Column:
    pos = F.array_position(F.array(*[F.lit(p) for p in fixed.PERIOD_ORDER]), F.lower(c))
    return F.when(pos > 0, pos).otherwise(99)


def rolling_window(c: Column, as_of: dt.datetime, days: int) -> Column:
    """Rows within [as_of - days, as_of]; NULL and future dates drop out."""
    return c.between(ntz(as_of - dt.timedelta(days=days)), ntz(as_of))


def ntz(value: dt.datetime) -> Column:
    """A zone-free timestamp literal."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
