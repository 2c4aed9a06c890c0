"""DNS messages over UDP and TCP."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.addresses import format_ip_bytes
from ..schemas import DNS_MESSAGE

TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 64: "SVCB", 65: "HTTPS", 255: "ANY"}
_PRINTED = [chr(c).lower() if 0x21 <= c < 0x7F else "?" for c in range(256)]


class _Bad(Exception):
    pass


def _u16(d: bytes, at: int) -> int:
    return d[at] << 8 | d[at + 1]


def _name(d: bytes, at: int, end: int) -> tuple[str, int]:
    """A possibly compressed name and the place behind it; loops and overlong names are refused."""
    labels, size, jumps, after = [], 0, 0, None
    while True:
        if at >= end:
            raise _Bad
        n = d[at]
        if n >= 0xC0:
            if at + 1 >= end:
                raise _Bad
            after = at + 2 if after is None else after
            at, jumps = _u16(d, at) & 0x3FFF, jumps + 1
            if jumps > 16 or at >= end:
                raise _Bad
        elif n >= 0x40:
            raise _Bad
        elif n == 0:
            return ".".join(labels), at + 1 if after is None else after
        else:
            size += n + 1
            if at + 1 + n > end or size > 255:
                raise _Bad
            labels.append("".join([_PRINTED[c] for c in d[at + 1 : at + 1 + n]]))
            at += 1 + n


def parse_dns(d: bytes | None) -> dict | None:
    """A standard query or its response; a cut message keeps the answers before the cut, if any."""
    if d is None or len(d) < 12 or d[2] >> 3 & 15 or _u16(d, 4) > 4:
        return None
    out = {"id": _u16(d, 0), "response": d[2] >= 128, "rcode": d[3] & 15, "question": "", "qtype": 0, "answers": []}
    at, n = 12, len(d)
    try:
        for k in range(_u16(d, 4)):
            name, at = _name(d, at, n)
            if at + 4 > n:
                return None
            if not k:
                out["question"], out["qtype"] = name, _u16(d, at)
            at += 4
    except _Bad:
        return None
    for _ in range(min(64, _u16(d, 6))):
        try:
            name, at = _name(d, at, n)
        except _Bad:
            return out if out["answers"] else None
        if at + 10 > n or at + 10 + _u16(d, at + 8) > n:
            return out if out["answers"] else None
        kind, size = _u16(d, at), _u16(d, at + 8)
        answer = {"name": name, "type": kind, "ttl": int.from_bytes(d[at + 4 : at + 8], "big"), "addr": None, "target": ""}
        at += 10
        if (kind, size) in ((1, 4), (28, 16)):
            answer["addr"] = format_ip_bytes(d[at : at + size])
        elif kind == 5:
            try:
                answer["target"], _ = _name(d, at, at + size)
            except _Bad:
                return None
        at += size
        out["answers"].append(answer)
    return out


def parse_dns_tcp(d: bytes | None) -> dict | None:
    """The message behind the two length bytes, which has to be whole in this segment."""
    if d is None or len(d) < 2 or _u16(d, 0) + 2 > len(d):
        return None
    return parse_dns(d[2 : 2 + _u16(d, 0)])


def dns_message(payload: Column, proto: Column) -> Column:
    """The parsed message, null if there is none; ``proto`` 6 has the length bytes of TCP."""

    @F.pandas_udf(_STRUCT)
    def parse(data: pd.Series, kind: pd.Series) -> pd.DataFrame:
        rows = [parse_dns_tcp(d) if k == 6 else parse_dns(d) for d, k in zip(data, kind, strict=True)]
        return pd.DataFrame([{"ok": r is not None, **(r or _NONE)} for r in rows], columns=["ok", *_NONE])

    got = parse(payload, proto)
    return F.when(got["ok"], got)


_STRUCT = "ok boolean, " + DNS_MESSAGE
_NONE = {"id": 0, "response": False, "rcode": 0, "question": "", "qtype": 0, "answers": []}


def dns_type_name(qtype: Column) -> Column:
    out = F.lit("?")
    for k, name in TYPES.items():
        out = F.when(qtype == k, name).otherwise(out)
    return out
