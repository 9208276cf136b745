"""Time columns. Clocks are parameters: no query reads the current time."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Names of months in mail times.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a zoneless UTC timestamp, whatever the session zone."""
    return F.timestamp_diff("SECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), ts)


def from_epoch(seconds: Column) -> Column:
    """Zoneless UTC timestamp of epoch seconds."""
    return F.timestamp_add("SECOND", seconds, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def parse_iso(text: Column) -> Column:
    """Zoneless UTC timestamp of an ISO text, also compact; offsets are applied, blank and bad text is null."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    base = F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?", 0)
    plain = F.replace(base, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")
    compact = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})Z?$", "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")
    sign = F.regexp_extract(t, r"[T ]\d{2}:\d{2}.*?([+-])(\d{2}):?(\d{2})$", 1)
    hours = F.regexp_extract(t, r"[T ]\d{2}:\d{2}.*?([+-])(\d{2}):?(\d{2})$", 2).try_cast("int")
    minutes = F.regexp_extract(t, r"[T ]\d{2}:\d{2}.*?([+-])(\d{2}):?(\d{2})$", 3).try_cast("int")
    shift = F.when(sign == "-", 1).when(sign == "+", -1).otherwise(0) * (F.coalesce(hours, F.lit(0)) * 60 + F.coalesce(minutes, F.lit(0)))
    return F.coalesce(F.timestamp_add("MINUTE", shift, plain), compact)


def parse_rfc822(text: Column) -> Column:
    """Zoneless UTC timestamp of a mail time, ``Wed, 03 Jan 2024 10:00:00 +0100``; named zones but GMT, UT, UTC and Z count as UTC; bad text is null."""
    t = F.regexp_replace(text, r"^\s*(?:[A-Za-z]{3},)?\s*|\s+$", "")
    pattern = r"^(\d{1,2}) ([A-Za-z]{3}) (\d{4}) (\d{2}:\d{2})(:\d{2})?(?: ([+-]\d{4}|[A-Za-z]+))?$"
    part = lambda i: F.regexp_extract(t, pattern, i)
    months = F.array(*map(F.lit, MONTHS))
    month = F.lpad(F.nullif(F.array_position(months, F.lower(part(2))), F.lit(0)).cast("string"), 2, "0")
    local = F.concat(part(3), F.lit("-"), month, F.lit("-"), F.lpad(part(1), 2, "0"), F.lit(" "), part(4), F.coalesce(F.nullif(part(5), F.lit("")), F.lit(":00"))).try_cast("timestamp_ntz")
    digits = F.regexp_extract(part(6), r"^[+-](\d{2})(\d{2})$", 1).try_cast("int") * 60 + F.regexp_extract(part(6), r"^[+-](\d{2})(\d{2})$", 2).try_cast("int")
    shift = F.coalesce(F.when(part(6).startswith("-"), digits).otherwise(-digits), F.lit(0))
    return F.timestamp_add("MINUTE", shift, local)


def since_bound(text: Column, now: Column) -> Column:
    """``since`` as a column: ``24h``, ``7d`` or an ISO time; anything else is null, no bound."""
    t = F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))
    n = F.regexp_extract(t, r"^(\d+)[hd]$", 1).try_cast("int")
    hours = F.when(t.endswith("h"), n).otherwise(n * 24)
    return F.when(n.isNotNull(), F.timestamp_add("HOUR", F.negate(hours), now)).otherwise(parse_iso(text))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def since(text: str | None, now: datetime) -> datetime | None:
    """``24h``, ``7d`` or an ISO time; anything else is no bound."""
    if not text:
        return None
    if m := re.fullmatch(r"(\d+)([hd])", text.strip().lower()):
        return now - timedelta(**{"hours" if m[2] == "h" else "days": int(m[1])})
    try:
        parsed = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        return None
    return (parsed - parsed.utcoffset()).replace(tzinfo=None) if parsed.tzinfo else parsed


def age_hours(now: Column, then: Column) -> Column:
    return F.greatest(F.lit(0.0), (epoch_seconds(now) - epoch_seconds(then)) / 3600.0)


def relative(now: Column, then: Column) -> Column:
    """``Just now``, minutes or hours ago, else the date."""
    seconds = epoch_seconds(now) - epoch_seconds(then)
    return (
        F.when(seconds < 60, "Just now")
        .when(seconds < 3600, F.concat(F.floor(seconds / 60).cast("string"), F.lit("m ago")))
        .when(seconds < 86_400, F.concat(F.floor(seconds / 3600).cast("string"), F.lit("h ago")))
        .otherwise(F.date_format(then, "yyyy-MM-dd"))
    )
