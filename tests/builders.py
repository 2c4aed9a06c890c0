"""Packets made by hand."""

from __future__ import annotations

import socket
import struct


def tcp(sport, dport, seq=0, ack=0, flags=0x10, payload=b"", options=b""):
    return struct.pack(">HHIIBBHHH", sport, dport, seq % 2**32, ack % 2**32, (20 + len(options)) // 4 << 4, flags, 65535, 0, 0) + options + payload


def udp(sport, dport, payload=b"", length=None):
    return struct.pack(">HHHH", sport, dport, 8 + len(payload) if length is None else length, 0) + payload


def ipv4(src, dst, proto, body, fragment=0, total=None):
    return struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body) if total is None else total, 1, fragment, 64, proto, 0) + socket.inet_aton(src) + socket.inet_aton(dst) + body


def ipv6(src, dst, kind, body, length=None):
    return struct.pack(">IHBB", 6 << 28, len(body) if length is None else length, kind, 64) + socket.inet_pton(socket.AF_INET6, src) + socket.inet_pton(socket.AF_INET6, dst) + body


def ether(body, kind=0x0800):
    return b"\2" * 6 + b"\4" * 6 + struct.pack(">H", kind) + body


def name(text):
    return b"".join(bytes([len(p)]) + p.encode() for p in text.split(".")) + b"\0"


def dns(question, addresses=(), cname=None, rcode=0, qtype=1):
    answers, owner = [], b"\xc0\x0c"
    if cname:
        answers.append(owner + struct.pack(">HHIH", 5, 1, 60, len(name(cname))) + name(cname))
    for a in addresses:
        raw = socket.inet_aton(a)
        answers.append(owner + struct.pack(">HHIH", 1, 1, 60, len(raw)) + raw)
    return struct.pack(">HHHHHH", 7, 0x8180 | rcode, 1, len(answers), 0, 0) + name(question) + struct.pack(">HH", qtype, 1) + b"".join(answers)


def hello(host, pad=0, sni=True):
    ext = struct.pack(">HH", 21, pad) + b"\0" * pad if pad else b""
    if sni:
        raw = host.encode()
        entry = b"\0" + struct.pack(">H", len(raw)) + raw
        ext += struct.pack(">HHH", 0, len(entry) + 2, len(entry)) + entry
    body = b"\3\3" + b"r" * 32 + b"\0" + struct.pack(">H", 2) + b"\x13\1" + b"\1\0" + struct.pack(">H", len(ext)) + ext
    shake = b"\1" + struct.pack(">I", len(body))[1:] + body
    return b"\x16\3\1" + struct.pack(">H", len(shake)) + shake
