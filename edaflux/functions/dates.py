"""Calendar rules as Column expressions (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days ahead of the next evaluation, and (step, length) of evaluation intervals in days.
EVALUATION_DAYS = {"P1D": 1, "P1W": 14}
INTERVAL_DAYS = {"P1D": (1, 1), "P1W": (7, 14)}
RELEASE_DAY = 15  # a month's observations come out on this day of the following month


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(ts: Column | str) -> Column:
    return F.to_date(_col(ts))


def week_start(ts: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", _col(ts)))


def month_start(day: Column | str) -> Column:
    return F.to_date(F.trunc(F.to_date(_col(day)), "month"))


def month_label(day: Column | str) -> Column:
    return F.date_format(_col(day), "yyyy-MM")


def days_of_month(day: Column | str) -> Column:
    """Every date of the month ``day`` lies in, as an array."""
    first = month_start(day)
    return F.sequence(first, F.last_day(first), F.expr("interval 1 day"))


def months_before(day: Column | str, n: int | Column) -> Column:
    return F.add_months(month_start(day), -n)


def preceding_months(day: Column | str, n: int) -> Column:
    """First days of the n months before the month of ``day``, latest first."""
    first = month_start(day)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.add_months(first, -i))


def next_month(day: Column | str) -> Column:
    return F.add_months(month_start(day), 1)


def training_month(day: Column | str) -> Column:
    """First day of the latest month whose observations were out on ``day``."""
    day = F.to_date(_col(day))
    return F.add_months(month_start(day), F.when(F.dayofmonth(day) < RELEASE_DAY, F.lit(-2)).otherwise(F.lit(-1)))


def training_year(day: Column | str) -> Column:
    """The calendar year before the training month's year."""
    return F.year(training_month(day)) - 1


def horizon_days(day: Column | str, reference: Column | str) -> Column:
    return F.datediff(_col(day), _col(reference))


def next_evaluation(day: Column | str, duration: Column | str) -> Column:
    """The date an observation's forecast is checked on."""
    ahead = F.when(_col(duration) == "P1D", F.lit(EVALUATION_DAYS["P1D"])).otherwise(F.lit(EVALUATION_DAYS["P1W"]))
    return F.date_add(F.to_date(_col(day)), ahead)


def days_between(later: Column | str, earlier: Column | str) -> Column:
    """Elapsed days with fraction."""
    def micros(c: Column | str) -> Column:
        return F.unix_micros(_col(c).cast("timestamp"))

    return (micros(later) - micros(earlier)) / F.lit(86_400_000_000)


def interval_id(ts: Column | str, start: Column | str, end: Column | str, duration: str) -> Column:
    """Number (from 1) of the first closed evaluation interval that holds ``ts``; null if none does.

    Intervals begin at ``start`` every step days, last length days, and count only if they end by ``end``.
    A row on a boundary belongs to the earlier interval.
    """
    step, length = INTERVAL_DAYS[duration]
    offset, extent = days_between(ts, start), days_between(end, start)
    k = F.greatest(F.lit(1), F.ceil((offset - length) / step) + 1)
    last = F.floor((extent - length) / step) + 1
    return F.when((offset >= 0) & (extent >= length) & (k <= last), k.cast("int"))


def in_months(ts: Column | str, first: Column | str, after: Column | str) -> Column:
    """Half-open date range ``[first, after)``: a plain comparison, so it prunes partitions and row groups."""
    ts = _col(ts)
    return (ts >= _col(first)) & (ts < _col(after))
