"""A subset of the capture filter language as a DataFrame filter.

``tcp udp icmp ip ip6``, ``[src|dst] host A``, ``[src|dst] [tcp|udp] port N``, ``[src|dst] net A/n``,
``and or not ( )``. What is filtered out is in no counter, as a filter runs before everything.
"""

from __future__ import annotations

import ipaddress
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"\(|\)|!|&&|\|\||[^\s()!&|]+")
_PROTO = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}


class FilterError(ValueError):
    """An expression outside the subset."""


def _in_net(addr: Column, net) -> Column:
    if net.version == 4:
        parts = F.split(addr, r"\.")
        number = sum((F.get(parts, F.lit(k)).try_cast("bigint") * 256 ** (3 - k) for k in range(4)), F.lit(0))
        low = int(net.network_address)
        return ~addr.contains(":") & (number >= low) & (number <= int(net.broadcast_address))
    from ..functions.addresses import parse_ip

    h, bits = F.hex(parse_ip(addr)), f"{int(net.network_address):032X}"
    whole, rest = divmod(net.prefixlen, 4)
    ok = addr.contains(":") & (F.substring(h, 1, whole) == bits[:whole])
    if rest:
        digit = F.conv(F.substring(h, whole + 1, 1), 16, 10).cast("int")
        low = int(bits[whole], 16) >> (4 - rest) << (4 - rest)
        ok &= (digit >= low) & (digit < low + (1 << (4 - rest)))
    return ok


class _Parser:
    def __init__(self, text: str):
        self.words, self.at = _WORD.findall(text), 0

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def take(self) -> str:
        word = self.peek()
        if word is None:
            raise FilterError("the filter ends too early")
        self.at += 1
        return word

    def either(self) -> Column:
        out = self.both()
        while self.peek() in ("or", "||"):
            self.take()
            out = out | self.both()
        return out

    def both(self) -> Column:
        out = self.one()
        while self.peek() in ("and", "&&"):
            self.take()
            out = out & self.one()
        return out

    def one(self) -> Column:
        word = self.take()
        if word in ("not", "!"):
            return ~F.coalesce(self.one(), F.lit(False))
        if word == "(":
            out = self.either()
            if self.take() != ")":
                raise FilterError("a ( is not closed")
            return out
        ends = ("src", "dst")
        if word in ends:
            ends, word = (word,), self.take()
        proto = None
        if word in _PROTO:
            proto = F.col("proto") == _PROTO[word]
            if self.peek() != "port":
                if ends != ("src", "dst"):
                    raise FilterError(f"src or dst before {word}")
                return proto
            word = self.take()
        if word in ("ip", "ip6"):
            return F.col("ip_version") == (4 if word == "ip" else 6)
        if word == "port":
            n = self.take()
            if not n.isdigit() or int(n) > 65535:
                raise FilterError(f"{n} is no port")
            cols = [F.col("sport" if e == "src" else "dport") == int(n) for e in ends]
            got = F.col("proto").isin(6, 17) & (cols[0] if len(cols) == 1 else cols[0] | cols[1])
            return got if proto is None else proto & got
        if word in ("host", "net"):
            name = self.take()
            try:
                net = ipaddress.ip_network(name, strict=False) if word == "net" else ipaddress.ip_network(ipaddress.ip_address(name))
            except ValueError as e:
                raise FilterError(str(e)) from None
            tests = [F.col(e) == str(net.network_address) if word == "host" else _in_net(F.col(e), net) for e in ends]
            return tests[0] if len(tests) == 1 else tests[0] | tests[1]
        raise FilterError(f"{word} is not understood")


def capture_filter(text: str) -> Column:
    """The expression over decoded packets; null facts do not match."""
    parser = _Parser(text)
    if parser.peek() is None:
        return F.lit(True)
    out = parser.either()
    if parser.peek() is not None:
        raise FilterError(f"{parser.peek()} was not expected")
    return F.coalesce(out, F.lit(False))


def apply_filter(packets: DataFrame, text: str) -> DataFrame:
    return packets.where(capture_filter(text))
