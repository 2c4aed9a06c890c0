"""Numbers, times and alerts as text."""

from __future__ import annotations

import json
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_PREFIXES = ("", "k", "M", "G", "T")


def si(value: float, base: str, prefixes: tuple[str, ...] = _PREFIXES) -> str:
    """SI prefixes; the unit changes where three digits would round up to the next."""
    k = 0
    while abs(value) >= 999.5 and k + 1 < len(prefixes):
        value, k = value / 1000, k + 1
    digits = 0 if not k else 2 if abs(value) < 9.995 else 1 if abs(value) < 99.95 else 0
    return f"{value:.{digits}f} {prefixes[k]}{base}"  # Python rounds exact halves to even, as C does


def format_bytes_text(n: float) -> str:
    return si(n, "B")


def format_rate_text(bytes_per_second: float, bits: bool = False) -> str:
    return si(bytes_per_second * 8, "b/s", _PREFIXES[:4]) if bits else si(bytes_per_second, "B/s", _PREFIXES[:4])


def printed(pattern: str, value: Column) -> Column:
    """A number as C prints it: the exact binary value is rounded, which decimals cannot tell from a half."""

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else pattern % v)

    return show(value.cast("double"))


def format_bytes(n: Column) -> Column:
    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else format_bytes_text(float(v)))

    return show(n.cast("double"))


def format_rate(n: Column, bits: bool = False) -> Column:
    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if pd.isna(v) else format_rate_text(float(v), bits))

    return show(n.cast("double"))


def format_count(n: Column) -> Column:
    """Digits in groups of three."""
    return F.format_number(n, 0)


def format_clock(ts_usec: Column) -> Column:
    """HH:MM:SS in the session's zone."""
    return F.date_format(F.timestamp_micros(ts_usec), "HH:mm:ss")


def format_iso_utc(ts_usec: Column) -> Column:
    """Milliseconds, cut and not rounded; the session's zone is UTC."""
    return F.date_format(F.timestamp_micros(ts_usec), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_duration(seconds: Column) -> Column:
    """``5 s``, ``3 min`` or ``1 h 2 min``; halves go to the even number."""
    s = seconds.cast("double")
    whole = lambda c: F.bround(c).cast("bigint").cast("string")
    long = F.concat(F.floor(s / 3600).cast("string"), F.lit(" h "), F.floor((s % 3600) / 60).cast("string"), F.lit(" min"))
    return F.when(s < 60, F.concat(whole(s), F.lit(" s"))).when(s < 3600, F.concat(whole(s / 60), F.lit(" min"))).otherwise(long)


def endpoint(addr: Column, port: Column) -> Column:
    """``a:p``, IPv6 in brackets."""
    return F.when(addr.contains(":"), F.concat(F.lit("["), addr, F.lit("]:"), port.cast("string"))).otherwise(F.concat(addr, F.lit(":"), port.cast("string")))


def alert_json_text(ts_usec: int, kind: str, severity: str, title: str, message: str, src: str | None, dst: str | None) -> str:
    """One alert as a JSON line; keys in fixed order, empty ends left out, text as UTF-8."""
    at = datetime.fromtimestamp(ts_usec // 1_000_000, UTC).strftime("%Y-%m-%dT%H:%M:%S") + f".{ts_usec // 1000 % 1000:03d}Z"
    out = {"time": at, "type": kind, "severity": severity, "title": title, "message": message}
    out |= {k: v for k, v in (("src", src), ("dst", dst)) if v}
    text = json.dumps(out, ensure_ascii=False, separators=(",", ":"))
    return text.replace("\\b", "\\u0008").replace("\\f", "\\u000c")


def alert_json(ts: Column, kind: Column, severity: Column, title: Column, message: Column, src: Column, dst: Column) -> Column:
    """The same as an expression; control characters are escaped as JSON allows."""
    none = lambda c: F.when(c != "", c)
    return F.to_json(F.struct(format_iso_utc(ts).alias("time"), kind.alias("type"), severity.alias("severity"), title.alias("title"), message.alias("message"), none(src).alias("src"), none(dst).alias("dst")))


def percent(share: Column) -> Column:
    """``<1%`` for a positive share that would show as 0."""
    n = F.round(share * 100).cast("int")
    return F.when((share > 0) & (n < 1), "<1%").otherwise(F.concat(n.cast("string"), F.lit("%")))
