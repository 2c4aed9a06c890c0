"""Packet decoding: link, IP and transport headers to one row of facts.

``decode_one`` is the definition, one packet at a time; ``decode_packets`` decodes whole Arrow
batches to the same (``columnar``). A packet that is no IP or is malformed keeps its row, as counters
include it.
"""

from __future__ import annotations

from struct import unpack_from

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.addresses import format_ip_bytes
from ..schemas import DECODED, PACKETS

OK, NOT_IP, MALFORMED = "Ok", "NotIp", "Malformed"
LINK_NAMES = {0: "loopback", 108: "loopback", 1: "Ethernet", 12: "raw IP", 14: "raw IP", 101: "raw IP", 228: "raw IP", 229: "raw IP", 113: "Linux cooked", 276: "Linux cooked"}
VLAN = (0x8100, 0x88A8, 0x9100)
CHAINED = (0, 43, 60, 51)
FIELDS = tuple(f.split()[0] for f in DECODED.split(", "))


class UnsupportedLink(ValueError):
    """A capture of a link type that cannot be decoded."""


def _transport(out: dict, d: bytes, at: int, end: int, total: int) -> str:
    """``total`` bytes as the IP header claims, of which those before ``end`` were captured."""
    have, proto = end - at, out["proto"]
    if proto == 6:
        if have < 20:
            return OK
        header = (d[at + 12] >> 4) * 4
        if not 20 <= header <= total:
            return MALFORMED
        sport, dport, seq, ack = unpack_from(">HHII", d, at)
        rest = total - header
        payload = d[at + header : min(end, at + header + rest)] if header <= have else b""
        out.update(has_l4=True, sport=sport, dport=dport, seq=seq, ack=ack, tcp_flags=d[at + 13], payload=payload, payload_total=rest)
    elif proto == 17:
        if have < 8:
            return OK
        sport, dport, length = unpack_from(">HHH", d, at)
        length = length or total
        if length < 8 or total < 8:
            return MALFORMED
        rest = min(length, total) - 8
        out.update(has_l4=True, sport=sport, dport=dport, payload=d[at + 8 : min(end, at + 8 + rest)], payload_total=rest)
    elif proto in (1, 58) and have >= 2:
        out.update(has_l4=True, icmp_type=d[at], icmp_code=d[at + 1])
    return OK


def _v4(out: dict, d: bytes, at: int) -> str:
    n = len(d) - at
    if n < 20 or d[at] >> 4 != 4:
        return MALFORMED
    header, total = (d[at] & 15) * 4, unpack_from(">H", d, at + 2)[0] or n
    if not 20 <= header <= n or total < header:
        return MALFORMED
    out.update(ip_version=4, src=d[at + 12 : at + 16], dst=d[at + 16 : at + 20], proto=d[at + 9], fragment=bool(unpack_from(">H", d, at + 6)[0] & 0x1FFF))
    return OK if out["fragment"] else _transport(out, d, at + header, at + min(n, total), total - header)


def _v6(out: dict, d: bytes, at: int) -> str:
    n = len(d) - at
    if n < 40 or d[at] >> 4 != 6:
        return MALFORMED
    total = 40 + (unpack_from(">H", d, at + 4)[0] or n - 40)
    end, kind, place = at + min(n, total), d[at + 6], at + 40
    out.update(ip_version=6, src=d[at + 8 : at + 24], dst=d[at + 24 : at + 40])
    for _ in range(8):
        if kind in CHAINED:
            if place + 2 > end:
                return MALFORMED
            size = (d[place + 1] + 2) * 4 if kind == 51 else (d[place + 1] + 1) * 8
            kind, place = d[place], place + size
            if place > end:
                return MALFORMED
        elif kind == 44:
            if place + 8 > end:
                return MALFORMED
            later = unpack_from(">H", d, place + 2)[0] >> 3
            kind, place = d[place], place + 8
            if later:
                out.update(proto=kind, fragment=True)
                return OK
        else:
            break
    out["proto"] = kind
    return _transport(out, d, place, end, at + total - place)


def _ether(out: dict, kind: int, d: bytes, at: int) -> str:
    return _v4(out, d, at) if kind == 0x0800 else _v6(out, d, at) if kind == 0x86DD else NOT_IP


def _link(out: dict, link: int, d: bytes) -> str:
    n = len(d)
    if link == 1:
        if n < 14:
            return MALFORMED
        kind, at = unpack_from(">H", d, 12)[0], 14
        for _ in range(2):
            if kind in VLAN:
                if at + 4 > n:
                    return MALFORMED
                kind, at = unpack_from(">H", d, at + 2)[0], at + 4
        return _ether(out, kind, d, at)
    if link in (0, 108):
        if n < 4:
            return MALFORMED
        family = {*unpack_from("<I", d), *unpack_from(">I", d)}
        return _v4(out, d, 4) if 2 in family else _v6(out, d, 4) if family & {24, 28, 30} else NOT_IP
    if link in (12, 14, 101, 228, 229):
        if not n:
            return MALFORMED
        return _v4(out, d, 0) if d[0] >> 4 == 4 else _v6(out, d, 0) if d[0] >> 4 == 6 else NOT_IP
    if link == 113:
        return MALFORMED if n < 16 else _ether(out, unpack_from(">H", d, 14)[0], d, 16)
    if link == 276:
        return MALFORMED if n < 20 else _ether(out, unpack_from(">H", d)[0], d, 20)
    raise UnsupportedLink(f"link type {link} is not supported")


def decode_one(link: int, data: bytes) -> dict:
    """The facts of one packet; what is unset is None, addresses are text."""
    out: dict = {"fragment": False, "has_l4": False}
    status = _link(out, link, data)
    if status != OK:
        out = {"fragment": False, "has_l4": False}
    else:
        out["src"], out["dst"] = format_ip_bytes(out["src"]), format_ip_bytes(out["dst"])
        out["payload_len"], out["payload_total"] = len(out.get("payload") or b""), out.get("payload_total", 0)
    out["decode_status"] = status
    return {f: out.get(f) for f in FIELDS}


def decode_packets(raw: DataFrame, snap_len: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``raw_packets`` to ``packets``; ``snap_len`` cuts the kept bytes first, not the wire length; columns to ``keep`` come behind."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    if snap_len is not None:
        raw = raw.withColumn("data", F.substring("data", 1, snap_len)).withColumn("cap_len", F.least("cap_len", F.lit(snap_len).cast("bigint")))
    full = T.StructType([*T.StructType.fromDDL(PACKETS).fields, *(raw.schema[c] for c in keep)])

    def run(batches):
        from .columnar import decode_columns

        types = to_arrow_schema(full)
        for b in batches:
            got = decode_columns(b.column("link_type").to_numpy(zero_copy_only=False), b.column("data"))
            cols = [b.column(c) for c in ("pkt_no", "ts_usec", "wire_len", "cap_len")] + [got[f] for f in FIELDS] + [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(cols, schema=types)

    return raw.select("pkt_no", "ts_usec", "wire_len", "cap_len", "link_type", "data", *keep).mapInArrow(run, full)


def native_ipv4(raw: DataFrame) -> DataFrame:
    """Headers of plain Ethernet/IPv4 TCP and UDP as expressions, without Python; other packets are left out."""
    from pyspark.sql import functions as F

    def number(at, n):
        return F.conv(F.hex(F.substring(F.col("data"), at, n)), 16, 10).cast("bigint")

    plain = raw.where((F.col("link_type") == 1) & (F.length("data") >= 38) & (F.hex(F.substring("data", 13, 3)) == "080045") & F.hex(F.substring("data", 24, 1)).isin("06", "11") & (number(21, 2).bitwiseAND(0x1FFF) == 0))
    octets = lambda at: F.concat_ws(".", *[number(at + k, 1).cast("string") for k in range(4)])
    tcp = number(24, 1) == 6
    return plain.select(
        "pkt_no", "ts_usec", "wire_len", "cap_len", octets(27).alias("src"), octets(31).alias("dst"), number(24, 1).cast("int").alias("proto"),
        number(35, 2).cast("int").alias("sport"), number(37, 2).cast("int").alias("dport"), F.when(tcp, number(48, 1).cast("int")).alias("tcp_flags"),
    )


def is_attempt(flags, proto=None):
    """A SYN without ACK."""
    syn = flags.bitwiseAND(0x12) == 0x02
    return syn if proto is None else (proto == 6) & syn


def is_truncated(payload_len, payload_total):
    return payload_len < payload_total
