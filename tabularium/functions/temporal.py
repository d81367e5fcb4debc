"""Dates, times of day (nanoseconds since midnight) and timestamps as column expressions. Zones are never interpreted."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Days from the Modified Julian Date's epoch to 1970-01-01, and from the Julian Date's to the Modified's.
MJD_UNIX, JD_MJD = 40587, 2400000.5
UNITS = {"s": 1, "ms": 10**3, "us": 10**6, "ns": 10**9}


def date_to_mjd(d: Column) -> Column:
    return F.unix_date(d) + MJD_UNIX


def mjd_to_date(mjd: Column) -> Column:
    return F.date_from_unix_date((mjd - MJD_UNIX).cast("int"))


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def _from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def to_unix(ts: Column, unit: str = "s") -> Column:
    """Whole units since the epoch, rounded towards the past where the unit is coarser than the value."""
    us = _micros(ts)
    per = UNITS[unit]
    return us * (per // 10**6) if per >= 10**6 else F.floor(us / (10**6 // per)).cast("long")


def from_unix(n: Column, unit: str = "s") -> Column:
    per = UNITS[unit]
    return _from_micros((F.floor(n / (per // 10**6)) if per > 10**6 else n * (10**6 // per)).cast("long"))


def to_mjd(ts: Column) -> Column:
    return _micros(ts) / 86400e6 + MJD_UNIX


def from_mjd(mjd: Column) -> Column:
    return _from_micros(F.round((mjd - MJD_UNIX) * 86400e6).cast("long"))


def to_jd(ts: Column) -> Column:
    return to_mjd(ts) + JD_MJD


def from_jd(jd: Column) -> Column:
    return from_mjd(jd - JD_MJD)


def diff_seconds(a: Column, b: Column) -> Column:
    return (_micros(a) - _micros(b)) / 1e6


def offset(ts: Column, nanoseconds: Column | int) -> Column:
    return F.timestamp_add("MICROSECOND", F.floor(F.lit(nanoseconds) / 1000).cast("long"), ts)


def make_time(hour: Column, minute: Column, second: Column, nanosecond: Column | int = 0) -> Column:
    """Nanoseconds since midnight; fields out of range raise."""
    ns = nanosecond if isinstance(nanosecond, Column) else F.lit(nanosecond)
    ok = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59) & ns.between(0, 10**9 - 1)
    value = ((hour * 60 + minute) * 60 + second).cast("long") * 10**9 + ns
    return F.when(ok, value).when(hour.isNull() | minute.isNull() | second.isNull() | ns.isNull(), F.lit(None).cast("long")).otherwise(F.raise_error(F.lit("no such time of day")).cast("long"))


def time_fields(t: Column) -> dict[str, Column]:
    s = F.floor(t / 10**9).cast("long")
    return {"hour": F.floor(s / 3600).cast("int"), "minute": F.pmod(F.floor(s / 60), F.lit(60)).cast("int"), "second": F.pmod(s, F.lit(60)).cast("int"), "nanosecond": F.pmod(t, F.lit(10**9)).cast("int")}


def time_to_string(t: Column) -> Column:
    """HH:MM:SS, with a fraction where there is one."""
    f = time_fields(t)
    whole = F.format_string("%02d:%02d:%02d", f["hour"], f["minute"], f["second"])
    part = F.rtrim(F.lpad(f["nanosecond"].cast("string"), 9, "0"), F.lit("0"))
    return F.when(t.isNull(), None).when(f["nanosecond"] == 0, whole).otherwise(F.concat(whole, F.lit("."), part))


def parse_time(s: Column) -> Column:
    """From HH:MM:SS[.fraction]; anything else is null."""
    pattern = r"^([01]\d|2[0-3]):([0-5]\d):([0-5]\d)(?:\.(\d{1,9}))?$"
    g = lambda i: F.regexp_extract(s, pattern, i)
    whole = ((g(1).cast("long") * 60 + g(2).cast("long")) * 60 + g(3).cast("long")) * 10**9
    return F.when(s.rlike(pattern), F.when(g(4) == "", whole).otherwise(whole + F.rpad(g(4), 9, "0").try_cast("long")))
