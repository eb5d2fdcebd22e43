"""Calendar expressions (DTE*, PRJ11, PRJ12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English month names in calendar order.
MONTHS = ["January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def date_parts(col) -> list[Column]:
    """year, month, day, ISO week, weekday (Monday = 0), day of year."""
    d = F.to_date(_c(col))
    return [F.year(d).alias("year"), F.month(d).alias("month"), F.dayofmonth(d).alias("day"),
            F.weekofyear(d).alias("week"), F.weekday(d).alias("weekday"),
            F.dayofyear(d).alias("dayofyear")]


def month_name(col) -> Column:
    """Full English month name."""
    return F.date_format(_c(col), "MMMM")


def week_start(col) -> Column:
    """Monday of the row's week (period label)."""
    return F.to_date(F.date_trunc("week", _c(col)))


def week_end_sunday(col) -> Column:
    """Sunday that ends the row's week (label of a weekly resample)."""
    return F.date_add(week_start(col), 6)


def calendar_rank(col, order=MONTHS) -> Column:
    """Position (1-based) of a label in a fixed order (ordered categorical)."""
    return F.array_position(F.array(*[F.lit(x) for x in order]), _c(col))


def parse_date(col, fmt: str) -> Column:
    """Text -> date with a stated format; unparsable text -> NULL."""
    return F.to_date(F.try_to_timestamp(_c(col), F.lit(fmt)))
