"""Date math, date formats, durations and intervals, resolved on the driver."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

_UNITS = {"s": "seconds", "m": "minutes", "h": "hours", "H": "hours", "d": "days", "w": "weeks"}
_SPANS = {"nanos": 1e-6, "micros": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def parse_duration_ms(text: str) -> int:
    """``90m``, ``1d`` and so on in milliseconds."""
    m = re.fullmatch(r"([+-]?\d+(?:\.\d+)?)(nanos|micros|ms|s|m|h|d|w)", str(text).strip())
    if not m:
        raise ValueError(f"failed to parse time value [{text}]")
    return int(float(m[1]) * _SPANS[m[2]])


def zone(text: str | None) -> timezone | ZoneInfo:
    if not text or text in ("Z", "UTC"):
        return timezone.utc
    if m := re.fullmatch(r"([+-])(\d{2}):?(\d{2})", text):
        return timezone((1 if m[1] == "+" else -1) * timedelta(hours=int(m[2]), minutes=int(m[3])))
    return ZoneInfo(text)


def add_months(t: datetime, n: int) -> datetime:
    y, m = divmod(t.year * 12 + t.month - 1 + n, 12)
    return t.replace(year=y, month=m + 1, day=min(t.day, calendar.monthrange(y, m + 1)[1]))


def _floor(t: datetime, unit: str) -> datetime:
    day = t.replace(hour=0, minute=0, second=0, microsecond=0)
    return {"y": day.replace(month=1, day=1) if unit == "y" else day, "M": day.replace(day=1), "w": day - timedelta(days=t.weekday()), "d": day, "h": t.replace(minute=0, second=0, microsecond=0), "H": t.replace(minute=0, second=0, microsecond=0), "m": t.replace(second=0, microsecond=0), "s": t.replace(microsecond=0)}[unit]


def _plus(t: datetime, n: int, unit: str) -> datetime:
    if unit in "yM":
        return add_months(t, n * (12 if unit == "y" else 1))
    return t + timedelta(**{_UNITS[unit]: n})


#: What a letter of a Java date pattern stands for: the part of a time and the digits it may take.
_PARTS = {"y": ("year", r"\d{4}"), "u": ("year", r"\d{4}"), "M": ("month", r"\d{1,2}"), "d": ("day", r"\d{1,2}"), "H": ("hour", r"\d{1,2}"), "h": ("hour", r"\d{1,2}"), "m": ("minute", r"\d{1,2}"), "s": ("second", r"\d{1,2}"), "S": ("fraction", r"\d{1,9}"), "X": ("zone", r"Z|[+-]\d{2}:?\d{2}"), "Z": ("zone", r"Z|[+-]\d{2}:?\d{2}"), "a": ("half", "AM|PM|am|pm"), "D": ("of_year", r"\d{1,3}")}


def from_pattern(text: str, pattern: str, tz: timezone | ZoneInfo) -> tuple[datetime, str | None] | None:
    """The time that a text gives by a Java date pattern, with the finest unit that is in it; None where it does not fit."""
    regex = ""
    for quoted, run, _ in re.findall(r"'([^']*)'|((?:([A-Za-z])\3*)|[^A-Za-z'])", pattern):
        letter = run[:1]
        if not run:
            regex += re.escape(quoted)
        elif letter in _PARTS:
            name, digits = _PARTS[letter]
            regex += f"(?P<{name}>{digits if len(run) == 1 or letter not in 'MdHms' else chr(92) + 'd{2}'})" if f"<{name}>" not in regex else ""
        else:
            regex += re.escape(run)
    m = re.fullmatch(regex, text)
    if not m:
        return None
    got = {k: v for k, v in m.groupdict().items() if v}
    at = datetime(int(got.get("year", 1970)), int(got.get("month", 1)), int(got.get("day", 1)), tzinfo=zone(got["zone"]) if "zone" in got else tz)
    if "of_year" in got:
        at += timedelta(days=int(got["of_year"]) - 1)
    hour = int(got.get("hour", 0))
    if "half" in got:
        hour = hour % 12 + (12 if got["half"].lower() == "pm" else 0)
    at = at.replace(hour=hour, minute=int(got.get("minute", 0)), second=int(got.get("second", 0)), microsecond=int(got.get("fraction", "0").ljust(6, "0")[:6]))
    finest = None if "second" in got else next((u for n, u in (("minute", "m"), ("hour", "h"), ("day", "d"), ("of_year", "d"), ("month", "M"), ("year", "y")) if n in got), None)
    return at, finest


def resolve(text: object, *, now: datetime | None = None, round_up: bool = False, time_zone: str | None = None, fmt: str | None = None) -> datetime:
    """A naive UTC time from a date, with date math after ``now`` or ``||``. ``round_up`` takes the last millisecond of a unit that is rounded to or left out."""
    tz = zone(time_zone)
    if isinstance(text, datetime):
        return text
    patterns = [p for p in (fmt or "").split("||") if re.search("[yuMdHmsD]", p) and not re.match("(strict_)?(date|epoch|basic|ordinal|year|week|hour|time|t_time)", p)]
    if isinstance(text, (int, float)) or not patterns and re.fullmatch(r"-?\d{5,}", str(text)):
        scale = 1 if fmt and "epoch_second" in fmt else 1000
        return datetime(1970, 1, 1) + timedelta(milliseconds=float(text) * 1000 / scale)
    text = str(text)
    if text.startswith("now"):
        t, math = now or datetime.now(timezone.utc).replace(tzinfo=None), text[3:]
        t = t.replace(tzinfo=timezone.utc).astimezone(tz)
    else:
        date, _, math = text.partition("||")
        for pattern in patterns:
            if found := from_pattern(date.strip(), pattern, tz):
                t, unit = found
                if round_up and not math and unit:
                    t = _plus(t, 1, unit) - timedelta(milliseconds=1)
                return _computed(t, math, round_up)
        m = re.fullmatch(r"(\d{4})(?:[-/](\d{1,2})(?:[-/](\d{1,2})(?:[T ](\d{1,2})(?::(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?)?)?)?)?(Z|[+-]\d{2}:?\d{2})?", date.strip())
        if not m:
            raise ValueError(f"failed to parse date field [{text}]")
        given = [int(x) if x else None for x in m.groups()[:6]]
        t = datetime(given[0], given[1] or 1, given[2] or 1, given[3] or 0, given[4] or 0, given[5] or 0, int((m[7] or "0").ljust(6, "0")[:6]), tzinfo=zone(m[8]) if m[8] else tz)
        if round_up and not math and None in given:
            unit = "yMdhms"[given.index(None) - 1]
            t = _plus(t, 1, unit) - timedelta(milliseconds=1)
    return _computed(t, math, round_up)


def _computed(t: datetime, math: str, round_up: bool) -> datetime:
    """A time after date math, in naive UTC."""
    for sign, n, unit in re.findall(r"([+-/])(\d*)([yMwdhHms])", math):
        if sign == "/":
            t = _floor(t, unit)
            if round_up:
                t = _plus(t, 1, unit) - timedelta(milliseconds=1)
        else:
            t = _plus(t, int(n or 1) * (1 if sign == "+" else -1), unit)
    return t.astimezone(timezone.utc).replace(tzinfo=None)
