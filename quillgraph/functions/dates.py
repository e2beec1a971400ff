"""Dates of letters: a value of year, month, day or time precision denotes the interval from its first to its last instant.

``bounds`` works on single values for parsers and as a column expression on tables. The lexical form of a bound is kept;
comparison is by UTC instant for zoned values. Mixing zoned and floating bounds is an error, never a guess.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PATTERN = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"
_VALUE = re.compile(PATTERN)


class DateError(ValueError):
    """A value that denotes no interval."""


@dataclass(frozen=True)
class Interval:
    begin: str | None
    end: str | None
    source: str = ""


def _zone(text: str | None) -> dt.tzinfo | None:
    if not text:
        return None
    if text == "Z":
        return dt.timezone.utc
    hours, minutes = int(text[1:3]), int(text[4:6])
    if minutes > 59 or hours * 60 + minutes > 14 * 60:
        raise DateError(f"offset {text} is out of range")
    return dt.timezone((1 if text[0] == "+" else -1) * dt.timedelta(hours=hours, minutes=minutes))


def bounds(value: str) -> tuple[str, str]:
    """First and last instant of a value, in lexical form."""
    match = _VALUE.match(value.strip())
    if not match:
        raise DateError(f"not a date: {value!r}")
    year, month, day, hour, minute, second, fraction, zone = match.groups()
    try:
        if month is None:
            dt.date(int(year), 1, 1)
            return f"{year}-01-01T00:00:00", f"{year}-12-31T23:59:59"
        if day is None:
            last = calendar.monthrange(int(year), int(month))[1]
            return f"{year}-{month}-01T00:00:00", f"{year}-{month}-{last:02d}T23:59:59"
        dt.date(int(year), int(month), int(day))
        if hour is None:
            return f"{year}-{month}-{day}T00:00:00", f"{year}-{month}-{day}T23:59:59"
        if fraction is not None and len(fraction) > 6:
            raise DateError("a fraction may have six digits")
        _zone(zone)
        dt.time(int(hour), int(minute), int(second or 0))
    except (ValueError, calendar.IllegalMonthError) as error:
        raise DateError(str(error)) from error
    start, zone = f"{year}-{month}-{day}T{hour}:{minute}", zone or ""
    if second is None:
        return f"{start}:00{zone}", f"{start}:59{zone}"
    exact = f"{start}:{second}" + (f".{fraction}" if fraction else "") + zone
    return exact, exact


def zoned(lexical: str) -> bool:
    return bool(re.search(r"(Z|[+-]\d{2}:\d{2})$", lexical.partition("T")[2]))


def instant(lexical: str) -> dt.datetime:
    """For ordering; floating values are compared with each other as written."""
    match = _VALUE.match(lexical)
    year, month, day, hour, minute, second, fraction, zone = match.groups()
    at = dt.datetime(int(year), int(month), int(day), int(hour), int(minute), int(second), int((fraction or "0").ljust(6, "0")), _zone(zone) or dt.timezone.utc)
    return at


def check_order(begin: str | None, end: str | None) -> None:
    if begin is None or end is None:
        return
    if zoned(begin) != zoned(end):
        raise DateError(f"{begin} and {end}: one has a time zone, the other has none")
    if instant(begin) > instant(end):
        raise DateError(f"{begin} is after {end}")


def interval(attributes: dict[str, str], source: str = "") -> Interval | None:
    """The interval of date attributes: ``when``, else lower and upper bounds; each may come as its ``-iso`` twin."""
    get = lambda *names: next((attributes[k] for name in names for k in (name, f"{name}-iso") if attributes.get(k)), None)
    when = get("when")
    if when:
        return Interval(*bounds(when), source)
    low, high = get("notBefore", "from"), get("notAfter", "to")
    if not low and not high:
        return None
    begin, end = bounds(low)[0] if low else None, bounds(high)[1] if high else None
    check_order(begin, end)
    return Interval(begin, end, source)


def intersect(intervals: list[Interval]) -> Interval | None:
    """Latest begin to earliest end; the winning bounds keep their lexical form."""
    if not intervals:
        return None
    begins, ends = [i.begin for i in intervals if i.begin], [i.end for i in intervals if i.end]
    if len({zoned(x) for x in (*begins, *ends)}) > 1:
        raise DateError("some bounds have a time zone, others have none")
    begin, end = max(begins, key=instant, default=None), min(ends, key=instant, default=None)
    check_order(begin, end)
    return Interval(begin, end, "; ".join(dict.fromkeys(i.source for i in intervals if i.source)))


# -- columns --------------------------------------------------------------------------------------------------------------


def bounds_column(value: Column) -> Column:
    """A struct (begin, end) of lexical bounds; null if the value denotes no interval."""
    text = F.regexp_replace(value, r"(?U)^\s+|\s+$", "")
    part = lambda k: F.regexp_extract(text, PATTERN, k)
    year, month, day, hour, minute, second, fraction, zone = (part(k) for k in range(1, 9))
    first = F.concat(year, F.lit("-"), F.when(month == "", "01").otherwise(month), F.lit("-"), F.when(day == "", "01").otherwise(day))
    date = first.try_cast("date")
    last = F.when(month == "", F.concat(year, F.lit("-12-31"))).when(day == "", F.date_format(F.last_day(date), "yyyy-MM-dd")).otherwise(first)
    offset = F.when(zone.isin("", "Z"), 0).otherwise(F.substr(zone, F.lit(2), F.lit(2)).cast("int") * 60 + F.substr(zone, F.lit(5), F.lit(2)).cast("int"))
    in_range = (hour.cast("int") < 24) & (minute.cast("int") < 60) & ((second == "") | (second.cast("int") < 60)) & (F.length(fraction) <= 6) & (offset <= 840) & ((zone.isin("", "Z")) | (F.substr(zone, F.lit(5), F.lit(2)).cast("int") < 60))
    exact = F.concat(first, F.lit("T"), hour, F.lit(":"), minute, F.lit(":"), second, F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), zone)
    whole = lambda d, t: F.concat(d, F.lit(t))
    begin = F.when(hour == "", whole(first, "T00:00:00")).when(second == "", F.concat(first, F.lit("T"), hour, F.lit(":"), minute, F.lit(":00"), zone)).otherwise(exact)
    end = F.when(hour == "", whole(last, "T23:59:59")).when(second == "", F.concat(first, F.lit("T"), hour, F.lit(":"), minute, F.lit(":59"), zone)).otherwise(exact)
    fits = F.coalesce(text.rlike(PATTERN), F.lit(False)) & (year != "0000") & date.isNotNull() & ((hour == "") | F.coalesce(in_range, F.lit(False)))
    return F.when(fits, F.struct(begin.alias("begin"), end.alias("end")))


def micros(lexical: Column) -> Column:
    """Microseconds of a lexical bound; floating values count as UTC, and are only compared with each other."""
    return F.unix_micros(F.when(lexical.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$"), lexical).otherwise(F.concat(lexical, F.lit("Z"))).try_cast("timestamp"))


def is_zoned(lexical: Column) -> Column:
    return lexical.rlike(r"T.*(Z|[+-]\d{2}:\d{2})$")


def intersection(begin: Column, end: Column) -> list[Column]:
    """Aggregates over lexical bounds of a group: begin, end (lexical) and error ('zones', 'empty' or null)."""
    low, high = micros(begin), micros(end)
    kinds = F.size(F.array_union(F.collect_set(is_zoned(begin)), F.collect_set(is_zoned(end))))
    error = F.when(kinds > 1, "zones").when(F.max(low) > F.min(high), "empty")
    return [F.max_by(begin, low).alias("begin"), F.min_by(end, high).alias("end"), error.alias("error")]
