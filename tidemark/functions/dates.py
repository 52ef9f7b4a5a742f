"""Dates and times: texts, Julian days or Unix seconds, with modifiers, as Column expressions on milliseconds since 1970.

A day beyond a month's end runs on into the next month; what can't be read is NULL; local time is refused.  Each step binds
the value before it once (`_let`): named in the expression wherever it is used, a text would be read hundreds of times a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col

DAY = 86_400_000
_TEXT = r"^\s*(?:([0-9]{4})-([0-9]{2})-([0-9]{2})(?:[ T]+|$))?(?:([0-9]{2}):([0-9]{2})(?::([0-9]{2})(\.[0-9]+)?)?)?\s*(Z|z|[+-][0-9]{2}:[0-9]{2})?\s*$"


def _let(c: Column, body: Callable[[Column], Column]) -> Column:
    """The body of a value that is computed once a row, however often the body names it."""
    return F.get(F.transform(F.array(c), lambda x: body(x)), F.lit(0))


def _int(c: Column) -> Column:
    return F.when(c != "", c.try_cast("bigint"))  # a cast that fails costs more than all the rest of a row


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970 of a date whose month may be any number and whose day may run over."""
    first = lambda month: F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.unix_date(_let(y * 12 + m - 1, first)).cast("bigint") + d - 1


def parse(c) -> Column:
    """A text as milliseconds; a bare number in it is a Julian day."""
    return _let(col(c).cast("string"), _parsed)


def _parsed(c: Column) -> Column:
    parts = F.split(F.regexp_replace(c, _TEXT, ",".join(f"${k}" for k in range(1, 9))), ",")
    julian = F.trim(c).try_cast("double")
    return F.when(c.rlike(_TEXT), _let(parts, _composed)).when(c.rlike(r"^\s*[0-9.]+\s*$") & julian.isNotNull(), from_julian(julian))


def _composed(p: Column) -> Column:
    """Milliseconds of the eight groups of _TEXT, '' where one is absent."""
    y, m, d, h, mi, s = (_int(p[k]) for k in range(6))
    has_date, has_time = p[0] != "", p[3] != ""
    y, m, d = (F.when(has_date, v).otherwise(F.lit(w)) for v, w in ((y, 2000), (m, 1), (d, 1)))
    h, mi, s = (F.coalesce(v, F.lit(0)) for v in (h, mi, s))
    ms = F.coalesce(F.when(p[6] != "", F.round(p[6].try_cast("double") * 1000).cast("bigint")), F.lit(0))
    zone = p[7]
    shift = F.when(zone.rlike("^[+-]"), (F.when(zone.startswith("-"), -1).otherwise(1)) * (_int(F.substring(zone, 2, 2)) * 60 + _int(F.substring(zone, 5, 2)))).otherwise(0) * 60_000
    fine = (has_date | has_time) & m.between(1, 12) & d.between(1, 31) & (h < 24) & (mi < 60) & (s < 60)
    return F.when(fine, _days(y, m, d) * DAY + ((h * 60 + mi) * 60 + s) * 1000 + ms - shift)


def from_julian(n) -> Column:
    n = col(n).cast("double")
    return F.when((n >= 0) & (n < 5373484.5), F.round((n - 2440587.5) * DAY).cast("bigint"))


def from_unix(n) -> Column:
    n = col(n).cast("double")
    return F.round(n * 1000).cast("bigint")


def from_timestamp(c) -> Column:
    return F.unix_millis(col(c))


def _date(ms: Column) -> Column:
    return F.date_from_unix_date(F.floor(ms / DAY).cast("int"))


_UNITS = {"second": 1000, "minute": 60_000, "hour": 3_600_000, "day": DAY}


def modify(ms: Column, modifier: str) -> Column:
    m = modifier.strip().lower()
    day, clock = F.floor(ms / DAY), F.pmod(ms, F.lit(DAY))
    date = _date(ms)
    if found := re.fullmatch(r"([+-]?\d+(?:\.\d+)?)\s*(second|minute|hour|day|month|year)s?", m):
        n, unit = float(found[1]), found[2]
        if unit in _UNITS:
            return ms + round(n * _UNITS[unit])
        months = int(n) * (12 if unit == "year" else 1)
        return _days(F.year(date).cast("bigint"), F.month(date) + months, F.dayofmonth(date).cast("bigint")) * DAY + clock
    if found := re.fullmatch(r"([+-])(\d{2}):(\d{2})(?::(\d{2}))?", m):
        return ms + (-1 if found[1] == "-" else 1) * (int(found[2]) * 3600 + int(found[3]) * 60 + int(found[4] or 0)) * 1000
    if found := re.fullmatch(r"([+-])(\d{4})-(\d{2})-(\d{2})(?: (\d{2}):(\d{2})(?::(\d{2}))?)?", m):
        sign = -1 if found[1] == "-" else 1
        moved = _days(F.year(date).cast("bigint"), F.month(date) + sign * (int(found[2]) * 12 + int(found[3])), F.dayofmonth(date).cast("bigint")) + sign * int(found[4])
        return moved * DAY + clock + sign * (int(found[5] or 0) * 3600 + int(found[6] or 0) * 60 + int(found[7] or 0)) * 1000
    if m == "start of day":
        return (day * DAY).cast("bigint")
    if m in ("start of month", "start of year"):
        return F.unix_date(F.trunc(date, m.rsplit(" ", 1)[1])).cast("bigint") * DAY
    if found := re.fullmatch(r"weekday ([0-6])", m):
        return ms + F.pmod(F.lit(int(found[1]) + 7) - (F.dayofweek(date) - 1), F.lit(7)) * DAY
    if m in ("subsec", "subsecond", "ceiling", "unixepoch", "julianday", "auto"):
        return ms
    if m == "floor":
        return ms
    if m in ("localtime", "utc"):
        raise NotImplementedError(f"modifier {m!r}: there is no local time")
    raise ValueError(f"no such modifier: {modifier!r}")


def moment(value, *modifiers: str, kind: str = "text") -> Column:
    """Milliseconds of a time value after its modifiers.  kind: text, timestamp, unix or julian."""
    if kind != "timestamp" and modifiers and modifiers[0].strip().lower() == "unixepoch":
        kind = "unix"
    ms = {"text": parse, "timestamp": from_timestamp, "unix": from_unix, "julian": from_julian}[kind](value)
    for k, m in enumerate(modifiers):
        # `floor` undoes the running over of the month step before it.
        if m.strip().lower() == "floor" and k and re.search(r"(month|year)s?$", modifiers[k - 1].strip().lower()):
            before = moment(value, *modifiers[: k - 1], kind=kind)
            ms = _let(ms, lambda x, before=before: F.when(F.dayofmonth(_date(x)) < F.dayofmonth(_date(before)), x - F.dayofmonth(_date(x)) * DAY).otherwise(x))
        else:
            ms = _let(ms, lambda x, m=m: modify(x, m))
    return ms


def _pad(c: Column, n: int) -> Column:
    return F.lpad(c.cast("string"), n, "0")


def _clock(ms: Column) -> tuple[Column, Column, Column, Column]:
    s = F.floor(F.pmod(ms, F.lit(DAY)) / 1000)
    return F.floor(s / 3600), F.floor(s / 60) % 60, s % 60, F.pmod(ms, F.lit(1000))


def strftime(form: str, ms: Column) -> Column:
    """A literal format compiled to one expression; an unknown specifier makes the result NULL."""
    return _let(ms, lambda x: _formatted(form, x))


def _formatted(form: str, ms: Column) -> Column:
    d, (h, mi, s, milli) = _date(ms), _clock(ms)
    iso_year = F.extract(F.lit("YEAROFWEEK"), d)
    twelve = F.when(h % 12 == 0, 12).otherwise(h % 12)
    monday, sunday = F.weekday(d), F.dayofweek(d) - 1
    specs = {
        "d": lambda: _pad(F.dayofmonth(d), 2), "e": lambda: F.lpad(F.dayofmonth(d).cast("string"), 2, " "), "f": lambda: F.concat(_pad(s, 2), F.lit("."), _pad(milli, 3)),
        "F": lambda: F.date_format(d, "yyyy-MM-dd"), "G": lambda: _pad(iso_year, 4), "g": lambda: _pad(iso_year % 100, 2), "H": lambda: _pad(h, 2), "I": lambda: _pad(twelve, 2),
        "j": lambda: _pad(F.dayofyear(d), 3), "J": lambda: (ms / DAY + 2440587.5).cast("string"), "k": lambda: F.lpad(h.cast("string"), 2, " "), "l": lambda: F.lpad(twelve.cast("string"), 2, " "),
        "m": lambda: _pad(F.month(d), 2), "M": lambda: _pad(mi, 2), "p": lambda: F.when(h < 12, "AM").otherwise("PM"), "P": lambda: F.when(h < 12, "am").otherwise("pm"),
        "R": lambda: F.concat(_pad(h, 2), F.lit(":"), _pad(mi, 2)), "s": lambda: F.floor(ms / 1000).cast("string"), "S": lambda: _pad(s, 2), "T": lambda: F.concat(_pad(h, 2), F.lit(":"), _pad(mi, 2), F.lit(":"), _pad(s, 2)),
        "u": lambda: (monday + 1).cast("string"), "w": lambda: sunday.cast("string"), "U": lambda: _pad(F.floor((F.dayofyear(d) + 6 - sunday) / 7), 2), "W": lambda: _pad(F.floor((F.dayofyear(d) + 6 - monday) / 7), 2),
        "V": lambda: _pad(F.weekofyear(d), 2), "Y": lambda: _pad(F.year(d), 4), "%": lambda: F.lit("%"),
    }
    parts, k = [], 0
    while k < len(form):
        if form[k] == "%":
            if k + 1 >= len(form) or form[k + 1] not in specs:
                return F.lit(None).cast("string")
            parts.append(specs[form[k + 1]]())
            k += 2
        else:
            end = form.find("%", k)
            end = len(form) if end < 0 else end
            parts.append(F.lit(form[k:end]))
            k = end
    return F.when(ms.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def date(value, *modifiers: str, kind: str = "text") -> Column:
    return strftime("%F", moment(value, *modifiers, kind=kind))


def time(value, *modifiers: str, kind: str = "text") -> Column:
    return strftime("%H:%M:%f" if "subsec" in modifiers else "%T", moment(value, *modifiers, kind=kind))


def datetime(value, *modifiers: str, kind: str = "text") -> Column:
    return strftime("%F %H:%M:%f" if "subsec" in modifiers else "%F %T", moment(value, *modifiers, kind=kind))


def unixepoch(value, *modifiers: str, kind: str = "text") -> Column:
    ms = moment(value, *modifiers, kind=kind)
    return ms / 1000.0 if "subsec" in modifiers else F.floor(ms / 1000)
