"""IP addresses: text, bytes and predicates.

Predicates are expressions over the address bytes (4 or 16) as hexadecimal text, so ranges are
string comparisons that stay in generated code. Only parsing and printing IPv6 needs Python.
"""

from __future__ import annotations

import socket
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAPPED = "00000000000000000000FFFF"


def parse_ip_text(text: str | None) -> bytes | None:
    """Strict dotted or IPv6 text to bytes; anything else is None."""
    if not text or "%" in text:
        return None
    for family in (socket.AF_INET, socket.AF_INET6):
        try:
            return socket.inet_pton(family, text)
        except (OSError, ValueError, UnicodeError):
            continue
    return None


@dataclass(frozen=True)
class Facts:
    """What the expressions below tell of an address, for code that has it as text."""

    order: bytes
    local: bool
    multicast: bool


@lru_cache(65_536)
def address_facts(text: str, local: tuple[bytes, ...] = ()) -> Facts:
    raw = parse_ip_text(text)
    if raw is None:
        return Facts(b"", False, False)
    plain = raw[12:] if raw[:12] == b"\0" * 10 + b"\xff\xff" and len(raw) == 16 else raw
    if local:
        is_local = plain in local or (raw[0] == 127 if len(raw) == 4 else raw == b"\0" * 15 + b"\1")
    elif len(plain) == 4:
        a, b = plain[0], plain[1]
        is_local = a in (10, 127) or (a == 172 and 16 <= b < 32) or (a, b) in ((192, 168), (169, 254)) or (a == 100 and 64 <= b < 128)
    else:
        is_local = plain == b"\0" * 15 + b"\1" or (plain[0] == 0xFE and plain[1] & 0xC0 == 0x80) or plain[0] & 0xFE == 0xFC
    multicast = raw[0] == 255 if len(raw) == 16 else 224 <= raw[0] < 240 or raw == b"\xff" * 4
    return Facts((b"4" if len(raw) == 4 else b"6") + raw, is_local, multicast)


def format_ip_bytes(raw: bytes | None) -> str:
    """Canonical text; "-" for an unset address."""
    if raw is None or len(raw) not in (4, 16):
        return "-"
    return socket.inet_ntop(socket.AF_INET if len(raw) == 4 else socket.AF_INET6, bytes(raw))


def parse_ip(text: Column) -> Column:
    @F.pandas_udf("binary")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(parse_ip_text)

    return parse(text)


def format_ip(raw: Column) -> Column:
    """IPv4 is printed by an expression, the rest in Python."""

    @F.pandas_udf("string")
    def show(s: pd.Series) -> pd.Series:
        return s.map(format_ip_bytes)

    octet = [F.conv(F.hex(F.substring(raw, k, 1)), 16, 10) for k in range(1, 5)]
    return F.when(raw.isNull(), F.lit("-")).when(F.length(raw) == 4, F.concat_ws(".", *octet)).otherwise(show(raw))


def ipv4_bytes(text: Column) -> Column:
    """Bytes of dotted text that is known to be a valid IPv4 address, without Python."""
    parts = F.split(text, r"\.")
    return F.unhex(F.concat(*[F.lpad(F.hex(F.get(parts, F.lit(k)).cast("int")), 2, "0") for k in range(4)]))


def unmapped(raw: Column) -> Column:
    """::ffff:a.b.c.d becomes a.b.c.d; others stay."""
    return F.when((F.length(raw) == 16) & F.hex(raw).startswith(_MAPPED), F.substring(raw, 13, 4)).otherwise(raw)


def _hex(raw: Column) -> Column:
    return F.hex(raw)


def _range(h: Column, low: str, high: str) -> Column:
    return (h >= low) & (h <= high)


def without_scope(raw: Column) -> Column:
    """A link-local address without the scope some systems keep in bytes 2 and 3."""
    h = _hex(raw)
    local = (F.length(raw) == 16) & _range(F.substring(h, 1, 4), "FE80", "FEBF")
    return F.when(local, F.unhex(F.concat(F.substring(h, 1, 4), F.lit("0000"), F.substring(h, 9, 24)))).otherwise(raw)


def is_loopback(raw: Column) -> Column:
    h = _hex(raw)
    return F.when(F.length(raw) == 4, h.startswith("7F")).when(F.length(raw) == 16, h == "0" * 31 + "1").otherwise(False)


def is_private(raw: Column) -> Column:
    """Private, loopback, link-local and carrier-shared ranges, mapped addresses as IPv4."""
    raw = unmapped(raw)
    h = _hex(raw)
    v4 = (
        _range(h, "0A000000", "0AFFFFFF") | _range(h, "7F000000", "7FFFFFFF") | _range(h, "AC100000", "AC1FFFFF")
        | _range(h, "C0A80000", "C0A8FFFF") | _range(h, "A9FE0000", "A9FEFFFF") | _range(h, "64400000", "647FFFFF")
    )
    v6 = (h == "0" * 31 + "1") | _range(F.substring(h, 1, 4), "FE80", "FEBF") | _range(F.substring(h, 1, 2), "FC", "FD")
    return F.when(F.length(raw) == 4, v4).when(F.length(raw) == 16, v6).otherwise(False)


def is_multicast_or_broadcast(raw: Column) -> Column:
    h = _hex(raw)
    v4 = _range(h, "E0000000", "EFFFFFFF") | (h == "FFFFFFFF")
    return F.when(F.length(raw) == 4, v4).when(F.length(raw) == 16, h.startswith("FF")).otherwise(False)


def is_local(raw: Column, local: tuple[bytes, ...] = ()) -> Column:
    """With a list: loopback or listed; without one: any private address."""
    if not local:
        return is_private(raw)
    return is_loopback(raw) | _hex(unmapped(raw)).isin([a.hex().upper() for a in local])


def order_key(raw: Column) -> Column:
    """Sorts by family, then bytes."""
    return F.concat(F.when(F.length(raw) == 4, F.lit("4")).otherwise(F.lit("6")), _hex(raw))


def flow_key(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> tuple[Column, Column]:
    """(struct a, pa, b, pb, proto; whether the source is side a), the same for both directions.

    Addresses are compared as bytes, family first; ICMP has no ports.
    """
    icmp = proto.isin(1, 58)
    sp, dp = F.when(icmp | sport.isNull(), 0).otherwise(sport), F.when(icmp | dport.isNull(), 0).otherwise(dport)
    s, d = order_key(src), order_key(dst)
    src_is_a = (s < d) | ((s == d) & (sp <= dp))
    return F.struct(
        F.when(src_is_a, src).otherwise(dst).alias("a"), F.when(src_is_a, sp).otherwise(dp).cast("int").alias("pa"),
        F.when(src_is_a, dst).otherwise(src).alias("b"), F.when(src_is_a, dp).otherwise(sp).cast("int").alias("pb"), proto.alias("proto"),
    ), src_is_a
