"""Decoding of a whole Arrow batch of packets at once, in numpy.

``link.decode_one`` defines what a packet decodes to; this gives the same for all packets of a batch
with a fixed number of array operations. Places outside a packet may be read, as lengths are
checked before anything read is used.
"""

from __future__ import annotations

import socket

import numpy as np
import pyarrow as pa

from .link import CHAINED, LINK_NAMES, MALFORMED, NOT_IP, OK, VLAN, UnsupportedLink

_OK, _NOT_IP, _MALFORMED = range(3)
_STATUS = pa.array([OK, NOT_IP, MALFORMED])


class _Bytes:
    """Big-endian numbers at many places of one buffer."""

    def __init__(self, data: np.ndarray):
        self.data = np.concatenate([data, np.zeros(64, np.uint8)])
        self.top = len(data)

    def u8(self, at: np.ndarray) -> np.ndarray:
        return self.data[np.minimum(at, self.top)].astype(np.int64)

    def u16(self, at: np.ndarray) -> np.ndarray:
        at = np.minimum(at, self.top)
        return self.data[at].astype(np.int64) << 8 | self.data[at + 1]

    def u32(self, at: np.ndarray) -> np.ndarray:
        return self.u16(at) << 16 | self.u16(at + 2)

    def rows(self, at: np.ndarray, size: int) -> np.ndarray:
        return self.data[np.minimum(at, self.top)[:, None] + np.arange(size)]


def binary_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Buffer | None]:
    """Bytes, n + 1 offsets into them, and the bytes' buffer, of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buffer = column.buffers()[2]
    return (np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)), offsets, buffer


def cut(buffer: pa.Buffer | None, start: np.ndarray, stop: np.ndarray, known: np.ndarray) -> pa.Array:
    """Ascending, disjoint parts of a buffer as binary values, null where not ``known``.

    The parts and the gaps between them are one array without a copy, of which every second is taken.
    """
    n = len(start)
    offsets = np.zeros(2 * n + 1, np.int32)
    offsets[0:-1:2], offsets[1::2] = start, stop
    if n:
        offsets[-1] = stop[-1]
    both = pa.BinaryArray.from_buffers(pa.binary(), 2 * n, [None, pa.py_buffer(offsets), buffer if buffer is not None else pa.py_buffer(b"")])
    return both.take(pa.array(np.arange(0, 2 * n, 2), mask=~known))


def _texts(raw4: np.ndarray, raw6: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct addresses as text; which of them each of the IPv4 numbers and IPv6 rows is."""
    u4, i4 = np.unique(raw4, return_inverse=True)
    u6, i6 = np.unique(np.ascontiguousarray(raw6).view("V16").ravel(), return_inverse=True)
    texts = [socket.inet_ntop(socket.AF_INET, int(v).to_bytes(4, "big")) for v in u4.tolist()]
    return texts + [socket.inet_ntop(socket.AF_INET6, v.tobytes()) for v in u6], i4, i6 + len(u4)


def decode_columns(links: np.ndarray, data: pa.Array) -> dict[str, pa.Array]:
    """Columns of decoded packets by name, from link types and bytes (null: empty)."""
    if data.null_count:
        data = data.fill_null(b"")
    flat, offsets, buffer = binary_parts(data)
    b, start, stop = _Bytes(flat), offsets[:-1], offsets[1:]
    n = stop - start
    status = np.zeros(len(n), np.int8)
    family, at = np.zeros(len(n), np.int64), start.copy()

    def fail(where: np.ndarray, code: int) -> None:
        status[where & (status == _OK)] = code

    def ether(rows: np.ndarray, kind: np.ndarray, place: np.ndarray) -> None:
        family[rows] = np.where(kind == 0x0800, 4, np.where(kind == 0x86DD, 6, 0))[rows]
        at[rows] = place[rows]

    for link in np.unique(links).tolist():
        if link not in LINK_NAMES:
            raise UnsupportedLink(f"link type {link} is not supported")
        mine = links == link
        if link == 1:
            fail(mine & (n < 14), _MALFORMED)
            kind, place = b.u16(start + 12), start + 14
            for _ in range(2):
                tagged = np.isin(kind, VLAN)
                fail(mine & tagged & (place + 4 > stop), _MALFORMED)
                kind, place = np.where(tagged, b.u16(place + 2), kind), place + 4 * tagged
            ether(mine, kind, place)
        elif link in (0, 108):
            fail(mine & (n < 4), _MALFORMED)
            big = b.u32(start)
            little = big >> 24 | big >> 8 & 0xFF00 | big << 8 & 0xFF0000 | big << 24 & 0xFF000000
            family[mine] = np.where((big == 2) | (little == 2), 4, np.where(np.isin(big, (24, 28, 30)) | np.isin(little, (24, 28, 30)), 6, 0))[mine]
            at[mine] += 4
        elif link == 113:
            fail(mine & (n < 16), _MALFORMED)
            ether(mine, b.u16(start + 14), start + 16)
        elif link == 276:
            fail(mine & (n < 20), _MALFORMED)
            ether(mine, b.u16(start), start + 20)
        else:
            fail(mine & (n == 0), _MALFORMED)
            version = b.u8(start) >> 4
            family[mine] = np.where((version == 4) | (version == 6), version, 0)[mine]
    fail(family == 0, _NOT_IP)

    have = stop - at
    version = b.u8(at) >> 4
    four, six = (status == _OK) & (family == 4), (status == _OK) & (family == 6)
    proto, fragment = b.u8(at + 9), np.zeros(len(n), bool)
    # IPv4
    header, total = (b.u8(at) & 15) * 4, b.u16(at + 2)
    total = np.where(total == 0, have, total)
    fail(four & ((have < 20) | (version != 4) | (header < 20) | (header > have) | (total < header)), _MALFORMED)
    fragment |= four & (b.u16(at + 6) & 0x1FFF != 0)
    l4, end, claim = at + header, at + np.minimum(have, total), total - header
    # IPv6 and its chain of headers
    if six.any():
        fail(six & ((have < 40) | (version != 6)), _MALFORMED)
        size = b.u16(at + 4)
        whole = 40 + np.where(size == 0, have - 40, size)
        last = at + np.minimum(have, whole)
        kind, place = b.u8(at + 6), at + 40
        active = six & (status == _OK)
        for _ in range(8):
            chained, part = active & np.isin(kind, CHAINED), active & (kind == 44)
            fail(chained & (place + 2 > last), _MALFORMED)
            more = b.u8(place + 1)
            step = np.where(part, 8, np.where(kind == 51, (more + 2) * 4, (more + 1) * 8))
            fail((chained | part) & (place + step > last), _MALFORMED)
            later = part & (b.u16(place + 2) >> 3 != 0)
            go = chained | part
            kind, place = np.where(go, b.u8(place), kind), np.where(go, place + step, place)
            fragment |= later
            active = go & ~later & (status == _OK)
            if not active.any():
                break
        proto = np.where(six, kind, proto)
        l4, end, claim = np.where(six, place, l4), np.where(six, last, end), np.where(six, at + whole - place, claim)

    fragment &= status == _OK
    inner = (status == _OK) & ~fragment
    have = end - l4
    tcp, udp, icmp = inner & (proto == 6) & (have >= 20), inner & (proto == 17) & (have >= 8), inner & np.isin(proto, (1, 58)) & (have >= 2)
    header = np.where(tcp, (b.u8(l4 + 12) >> 4) * 4, 8)
    fail(tcp & ((header < 20) | (header > claim)), _MALFORMED)
    length = b.u16(l4 + 4)
    length = np.where(length == 0, claim, length)
    fail(udp & ((length < 8) | (claim < 8)), _MALFORMED)
    ok = status == _OK
    tcp, udp, icmp, fragment = tcp & ok, udp & ok, icmp & ok, fragment & ok
    ports = tcp | udp
    rest = np.where(ports, np.where(tcp, claim, np.minimum(length, claim)) - header, 0)
    first = np.where(ports, np.minimum(l4 + header, end), stop)
    first = np.clip(first, start, stop)
    behind = np.where(ports, np.clip(np.minimum(end, l4 + header + rest), first, stop), first)

    v4, v6 = np.flatnonzero(ok & (family == 4)), np.flatnonzero(ok & (family == 6))
    raw6 = np.concatenate([b.rows(at[v6] + 8, 16), b.rows(at[v6] + 24, 16)])
    texts, i4, i6 = _texts(np.concatenate([b.u32(at[v4] + 12), b.u32(at[v4] + 16)]), raw6)
    ends = []
    for k in range(2):
        which = np.zeros(len(n), np.int64)
        which[v4], which[v6] = i4[k * len(v4) : (k + 1) * len(v4)], i6[k * len(v6) : (k + 1) * len(v6)]
        ends.append(pa.array(texts, pa.string()).take(pa.array(which, mask=~ok)))

    def column(values: np.ndarray, known: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.array(values, mask=~known).cast(kind, safe=False)

    i32, i64 = pa.int32(), pa.int64()
    return {
        "decode_status": _STATUS.take(pa.array(status)), "ip_version": column(family, ok, i32), "src": ends[0], "dst": ends[1], "proto": column(proto, ok, i32),
        "fragment": pa.array(fragment), "has_l4": pa.array(tcp | udp | icmp), "sport": column(b.u16(l4), ports, i32), "dport": column(b.u16(l4 + 2), ports, i32),
        "tcp_flags": column(b.u8(l4 + 13), tcp, i32), "seq": column(b.u32(l4 + 4), tcp, i64), "ack": column(b.u32(l4 + 8), tcp, i64),
        "icmp_type": column(b.u8(l4), icmp, i32), "icmp_code": column(b.u8(l4 + 1), icmp, i32), "payload": cut(buffer, first, behind, ports),
        "payload_len": column(behind - first, ok, i64), "payload_total": column(rest, ok, i64),
    }
