"""Server names in TLS ClientHello messages."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FOUND, NEED_MORE, NO_SNI, NOT_TLS = "Found", "NeedMore", "NoSni", "NotTls"
_HOST = re.compile(r"[A-Za-z0-9._-]{1,253}")
_SERVER_NAME = 0
#: A hello's version and random number, and the bytes of a session id at most.
_FIXED, _SESSION = 34, 32


def looks_like_tls(d: bytes) -> bool:
    """A handshake record that begins with a ClientHello."""
    return len(d) >= 6 and d[0] == 0x16 and d[1] == 3 and d[2] <= 4 and d[5] == 1


class _Cut(Exception):
    """The bytes end inside a field."""


class _NotHello(Exception):
    pass


class _Fields(io.BytesIO):
    def take(self, n: int) -> bytes:
        got = self.read(n)
        if len(got) < n:
            raise _Cut
        return got

    def number(self, n: int) -> int:
        return int.from_bytes(self.take(n))

    def sized(self, n: int) -> bytes:
        """Bytes behind their own length, which has ``n`` bytes."""
        return self.take(self.number(n))


def _extensions(record: bytes, whole: bool) -> Iterator[tuple[int, bytes]]:
    """(type, data) of the extensions of the hello in a record."""
    r = _Fields(record)
    r.take(1)
    if r.number(3) < _FIXED + 4:
        raise _NotHello
    r.take(_FIXED)
    if len(r.getvalue()) > r.tell() and r.getvalue()[r.tell()] > _SESSION:
        raise _NotHello
    for width in (1, 2, 1):  # session, ciphers, compressions
        r.sized(width)
    size = r.number(2)
    stop = r.tell() + size
    if whole and stop > len(record):
        raise _NotHello
    while r.tell() < stop:
        yield r.number(2), r.sized(2)


def _host(names: bytes) -> str:
    """The first host name in the data of the extension, if it is one."""
    r = _Fields(names[2:])
    try:
        while True:
            kind, name = r.number(1), r.sized(2)
            if kind == 0 and 0 < len(name) <= 253:
                text = name.decode("latin-1")
                return text.lower() if _HOST.fullmatch(text) else ""
    except _Cut:
        return ""


def extract_sni(d: bytes) -> tuple[str, str]:
    """(result, host). A record that is not whole yet asks for more; one that lies is not TLS."""
    if len(d) < 6:
        return (NEED_MORE if not d or d[0] == 0x16 else NOT_TLS), ""
    if not looks_like_tls(d):
        return NOT_TLS, ""
    size = int.from_bytes(d[3:5])
    whole = len(d) >= 5 + size
    try:
        for kind, data in _extensions(d[5 : 5 + size], whole):
            if kind == _SERVER_NAME:
                host = _host(data)
                return (FOUND if host else NO_SNI), host
    except _NotHello:
        return NOT_TLS, ""
    except _Cut:
        return (NO_SNI if whole else NEED_MORE), ""
    return NO_SNI, ""


def sni(payload: Column) -> Column:
    @F.pandas_udf("result string, host string")
    def parse(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([extract_sni(bytes(d or b"")) for d in s], columns=["result", "host"])

    return parse(payload)
