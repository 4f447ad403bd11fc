"""Month and week expressions. Months are ``YYYY-MM`` strings, ids ``12 y + m``, or ``YYYYMM`` numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def yyyymm(ts: Column) -> Column:
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def month_id(m: Column) -> Column:
    """12 y + m of ``YYYY-MM`` or ``YYYYMM``; NULL for anything else."""
    s = m.cast("string")
    y, k = F.regexp_extract(s, r"^(\d{4})-?(\d{2})$", 1), F.regexp_extract(s, r"^(\d{4})-?(\d{2})$", 2)
    n = k.try_cast("int")
    return F.when(n.between(1, 12), y.try_cast("int") * 12 + n)


def month_of_id(i: Column) -> Column:
    """The ``YYYY-MM`` of a month id."""
    z = i - 1
    return F.format_string("%04d-%02d", F.floor(z / 12).cast("int"), (F.pmod(z, F.lit(12)) + 1).cast("int"))


def normal_month(c: Column) -> Column:
    """``YYYY-MM`` of ``YYYY-MM``, ``YYYYMM`` (also as 202501.0), or an ISO date; NULL otherwise."""
    s = F.trim(c.cast("string"))
    parts = [F.regexp_extract(s, p, 0) for p in (r"^\d{4}-\d{2}$", r"^\d{4}-\d{2}(?=-\d{2})")]
    packed = F.regexp_replace(F.regexp_extract(s, r"^(\d{6})(\.0)?$", 1), r"^(\d{4})(\d{2})$", "$1-$2")
    found = F.coalesce(*[F.when(p != "", p) for p in [*parts, packed]])
    return F.when(F.substring(found, 6, 2).try_cast("int").between(1, 12), found)


def without_zone(ts: Column) -> Column:
    """The wall clock of the session's zone."""
    return ts.cast("timestamp_ntz")


def within(c: Column, first: str, end: str) -> Column:
    """first <= c < end, for dates, times and text that sorts by time; false for NULL."""
    return F.coalesce((c >= F.lit(first)) & (c < F.lit(end)), F.lit(False))


def event_in_range(event: Column, after: int, to: int) -> Column:
    """Whether a month (YYYY-MM or YYYYMM as text) is valid and in (after, to], both YYYYMM."""
    packed = F.regexp_replace(event.cast("string"), "-", "")
    n = F.when(packed.rlike(r"^\d{6}$"), packed.try_cast("int"))
    return F.coalesce((n > after) & (n <= to), F.lit(False))


def add_months_yyyymm(m: Column, n: Column | int) -> Column:
    z = F.floor(m / 100) * 12 + m % 100 - 1 + n
    return (F.floor(z / 12) * 100 + F.pmod(z, F.lit(12)) + 1).cast("int")


def month_diff(a: Column, b: Column) -> Column:
    """Whole months from b to a, both ``YYYY-MM`` or ``YYYYMM``."""
    return month_id(a) - month_id(b)


def month_start(m: Column) -> Column:
    return F.to_date(F.concat(m, F.lit("-01")))


def month_end(m: Column) -> Column:
    return F.last_day(month_start(m))


def months_between_inclusive(a: Column, b: Column) -> Column:
    """Array of ``YYYY-MM`` from a to b; empty if b is earlier."""
    ids = F.when(month_id(b) >= month_id(a), F.sequence(month_id(a), month_id(b))).otherwise(F.array().cast("array<int>"))
    return F.transform(ids, month_of_id)


def quarter(ts: Column) -> Column:
    return F.concat_ws("-Q", F.year(ts).cast("string"), F.quarter(ts).cast("string"))


def week(ts: Column) -> Column:
    """``YYYY-Www`` with weeks that begin on Monday; days before the first Monday are week 00."""
    days = F.dayofyear(ts) - 1 + 7 - F.weekday(ts)
    return F.format_string("%04d-W%02d", F.year(ts), F.floor(days / 7).cast("int"))


def week_monday(label: Column) -> Column:
    """The Monday of a week label; of week 00 the Monday in the year before."""
    first = F.to_date(F.concat(F.substring(label, 1, 4), F.lit("-01-01")))
    n = F.substring(label, 7, 2).cast("int")
    monday = F.date_add(first, F.pmod(F.lit(7) - F.weekday(first), F.lit(7)).cast("int"))
    return F.date_add(monday, ((n - 1) * 7).cast("int"))


def week_diff(a: Column, b: Column) -> Column:
    return F.round(F.date_diff(a, b) / 7).cast("int")


def age_days(now: Column, first: Column) -> Column:
    """Days since the first event, 0 at least, NULL if there was none."""
    return F.when(first.isNotNull(), F.greatest(F.date_diff(now, first), F.lit(0)))
