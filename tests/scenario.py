"""A seeded three-minute capture with five incidents, as (ts_usec, wire length, bytes)."""

from __future__ import annotations

import random

from builders import dns, ether, hello, ipv4, tcp, udp

START = 1_790_168_400
ME, GATEWAY = "192.168.1.23", "192.168.1.1"
SITES = {"news.example": "203.0.113.10", "mail.example": "203.0.113.20", "video.example": "203.0.113.30"}
EICAR = rb"X5O!P%@AP[4\PZX54(P^)7CC)7}$EICAR-STANDARD-ANTIVIRUS-TEST-FILE!$H+H*"


class Capture:
    def __init__(self):
        self.rows: list[tuple[int, int, bytes]] = []

    def add(self, at: float, src: str, dst: str, proto: int, body: bytes, wire: int | None = None):
        frame = ether(ipv4(src, dst, proto, body, total=None if wire is None else wire - 14))
        self.rows.append((int(START * 1e6 + at * 1e6), wire or len(frame), frame))

    def connection(self, at: float, src: str, sport: int, dst: str, dport: int, up: list[bytes], down: list[bytes] = ()):
        a, b = 1000, 5000
        self.add(at, src, dst, 6, tcp(sport, dport, a, 0, 2))
        self.add(at + 0.01, dst, src, 6, tcp(dport, sport, b, a + 1, 18))
        self.add(at + 0.02, src, dst, 6, tcp(sport, dport, a + 1, b + 1, 16))
        a, b, t = a + 1, b + 1, at + 0.03
        for data in up:
            self.add(t, src, dst, 6, tcp(sport, dport, a, b, 24, data))
            a, t = a + len(data), t + 0.001
        for data in down:
            self.add(t, dst, src, 6, tcp(dport, sport, b, a, 24, data))
            b, t = b + len(data), t + 0.001


def build() -> list[tuple[int, int, bytes]]:
    c, rng = Capture(), random.Random(3)
    for k, (name, addr) in enumerate(SITES.items()):
        c.add(1 + k, GATEWAY, ME, 17, udp(53, 40000 + k, dns(name, [addr])))
        c.add(1.05 + k, GATEWAY, ME, 17, udp(53, 40000 + k, dns(name, [], qtype=28)))
    c.add(5, GATEWAY, ME, 17, udp(53, 40009, dns("gone.example", rcode=3)))
    for s in range(178):  # steady traffic, never silent
        n, addr = rng.choice(list(SITES.items()))
        c.connection(s + rng.random() * 0.5, ME, 50000 + s, addr, 443, [hello(n)], [b"\x17\3\3" + bytes(rng.randrange(500, 900))])
    c.connection(45, ME, 41000, "192.168.1.50", 80, [b"GET /admin HTTP/1.1\r\nHost: printer.local\r\nAuthorization: Basic dTpw\r\n\r\n"])
    for p in range(300):
        c.add(70 + p * 0.01, "192.168.1.44", ME, 6, tcp(33000, 1 + p, 9, 0, 2))
    c.connection(95, ME, 42000, "203.0.113.80", 80, [b"GET /f HTTP/1.1\r\nHost: files.example\r\n\r\n"], [b"HTTP/1.1 200 OK\r\n\r\n" + EICAR[:30], EICAR[30:] + b"\r\n"])
    for k in range(10 * 500):  # 30 MB a second
        c.add(120 + k / 500, SITES["video.example"], ME, 6, tcp(443, 60000, 1 + k * 59000, 0, 16, b"v" * 20), wire=60000)
    for k in range(6 * 200):
        c.add(160 + k / 200, f"198.51.{rng.randrange(100)}.{rng.randrange(1, 250)}", ME, 6, tcp(rng.randrange(1024, 65000), 3000, 7, 0, 2))
    return sorted(c.rows, key=lambda r: r[0])
