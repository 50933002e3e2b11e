"""Date tests on digits, and retry delays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions import text as t


def is_calendar_date(day: Column, month: Column, year: Column) -> Column:
    """A real date; years of two digits are of this century."""
    y = F.when(year < 100, year + 2000).otherwise(year)
    s = F.format_string("%04d-%02d-%02d", y.cast("int"), month.cast("int"), day.cast("int"))
    return F.coalesce(s.try_cast("date").isNotNull(), F.lit(False))


def is_compact_date(digits: Column) -> Column:
    """ddMMyy or yyMMdd of six digits, ddMMyyyy or yyyyMMdd of eight."""
    part = lambda a, n: F.substring(digits, a, n).try_cast("int")
    six = is_calendar_date(part(1, 2), part(3, 2), part(5, 2)) | is_calendar_date(part(5, 2), part(3, 2), part(1, 2))
    eight = is_calendar_date(part(1, 2), part(3, 2), part(5, 4)) | is_calendar_date(part(7, 2), part(5, 2), part(1, 4))
    return F.when(digits.rlike("^[0-9]{6}$"), six).when(digits.rlike("^[0-9]{8}$"), eight).otherwise(False)


def artifact_variants(digits: Column) -> Column:
    """The digits, and what is left when one or two of their 1s, which may be misread separators, are dropped."""

    def dropped(d: Column) -> Column:
        ones = F.filter(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: F.substring(d, i, F.lit(1)) == "1")
        return F.concat(F.array(d), F.transform(ones, lambda i: F.concat(F.substring(d, F.lit(1), i - 1), F.substring(d, i + 1, F.length(d)))))

    return F.array_remove(F.array_distinct(F.flatten(F.transform(dropped(digits), dropped))), "")


def looks_like_date(digits: Column, around: Column) -> Column:
    """Whether the text around holds a date with separators, or the digits, some 1s dropped or not, can be one."""
    separated = t.normalize_noise(around).rlike(r"\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b")
    return separated | F.exists(artifact_variants(digits), is_compact_date)


def brazilian_date(x: Column) -> Column:
    """(dd/MM/yyyy, ISO) of a day, month and year separated by . - or /; nulls where it is no date."""
    parts = F.split(F.translate(t.normalize_noise(x), ".-", "//"), "/", -1)
    at = lambda i: F.get(parts, F.lit(i))
    year = F.when(F.length(at(2)) == 2, F.concat(F.lit("20"), at(2))).otherwise(at(2))
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(at(1), 2, "0"), F.lpad(at(0), 2, "0")).try_cast("date")
    shaped = (F.size(parts) == 3) & at(0).rlike("^[0-9]{1,2}$") & at(1).rlike("^[0-9]{1,2}$") & year.rlike("^[0-9]{4}$")
    day = F.when(shaped, iso)
    return F.struct(F.date_format(day, "dd/MM/yyyy").alias("date"), F.date_format(day, "yyyy-MM-dd").alias("iso"))


def on_local_date(ts: Column, day: str, zone: str = "UTC") -> Column:
    """Whether a UTC time is on that day in the zone."""
    return F.to_date(F.from_utc_timestamp(ts, zone)) == F.to_date(F.lit(day))


def key_parts(ts: Column) -> Column:
    """yyyy/MM/dd of an object's key."""
    return F.date_format(ts, "yyyy/MM/dd")


def date_only(x: Column) -> Column:
    """yyyy-MM-dd of epoch seconds or milliseconds, or of a text; null where it isn't one."""
    n = x.try_cast("long")
    ms = F.when(F.abs(n) < 10_000_000_000, n * 1000).otherwise(n)
    return F.coalesce(F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd"), F.date_format(x.try_cast("timestamp"), "yyyy-MM-dd"))


def retry_delay_ms(attempt: Column, base_ms: int) -> Column:
    """Doubles with every attempt, from a second or more."""
    return (F.lit(max(1000, base_ms)) * F.pow(F.lit(2), attempt - 1)).cast("long")


def local_date_time(ts: Column, zone: str = "UTC") -> Column:
    """yyyy-MM-dd HH:mm:ss of a UTC time in the zone."""
    return F.date_format(F.from_utc_timestamp(ts, zone), "yyyy-MM-dd HH:mm:ss")


def iso_date(x: Column) -> Column:
    """ISO 8601 in UTC of a text or time, null where it is none."""
    return F.date_format(x.try_cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stage_timings(marks: dict[str, Column]) -> Column:
    """Milliseconds of each stage, from its mark to the next one's, and in all; the last mark ends the last stage."""
    names, at = list(marks), list(marks.values())
    each = [(at[k + 1] - at[k]).alias(names[k]) for k in range(len(at) - 1)]
    return F.struct(*each, (at[-1] - at[0]).alias("total"))


def stamped_id(prefix: str, ts: Column, *parts: Column) -> Column:
    """prefix-time-hash: the time's digits, and eight characters that the parts decide, so that a run again gives the same id."""
    return F.concat_ws("-", F.lit(prefix), F.date_format(ts, "yyyyMMddHHmmssSSS"), F.substring(F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256), 1, 8))
