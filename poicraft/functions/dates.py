"""Date and time text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poicraft.functions._col import col
from poicraft.functions.text import as_text

# Fixed value: default look-back of the search date, in days.
DELAY_DAYS = 2
# Fixed value: suffix that turns a 'YYYY-MM' month into a timestamp text.
MONTH_SUFFIX = "-01T12:00:00.00Z"


def search_date(as_of, days: int = DELAY_DAYS) -> Column:
    """``as_of`` minus ``days`` as ``yyyyMMdd`` text."""
    return F.date_format(F.date_sub(F.to_date(col(as_of)), days), "yyyyMMdd")


def month_timestamp(c) -> Column:
    """``'YYYY-MM'`` → ``'YYYY-MM-01T12:00:00.00Z'`` (null month → ``'None…'``)."""
    return F.concat(as_text(c), F.lit(MONTH_SUFFIX))


def timestamp_text(as_of) -> Column:
    """``date 'T' time 'Z'`` with microseconds, for an explicit UTC ``as_of``.

    ``as_of`` is a timestamp text literal (e.g. ``'2019-05-23 12:00:00'``) or a Column.
    """
    ts = F.lit(as_of) if isinstance(as_of, str) else as_of
    return F.date_format(F.to_timestamp(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
