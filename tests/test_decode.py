import random
import socket

import numpy as np
import pyarrow as pa
import pytest

from builders import dns, ether, hello, ipv4, ipv6, tcp, udp
from flowloom.decode import tls
from flowloom.decode.columnar import decode_columns
from flowloom.decode.dns import parse_dns, parse_dns_tcp
from flowloom.decode.link import FIELDS, UnsupportedLink, decode_one
from flowloom.functions import addresses


def test_tcp_over_ethernet_with_options_and_padding():
    r = decode_one(1, ether(ipv4("10.0.0.1", "192.168.1.2", 6, tcp(1234, 443, 2**32 - 1, 5, 0x18, b"hello", b"\1" * 8))) + b"\0" * 9)
    assert (r["decode_status"], r["src"], r["dst"], r["sport"], r["dport"], r["seq"], r["tcp_flags"]) == ("Ok", "10.0.0.1", "192.168.1.2", 1234, 443, 2**32 - 1, 0x18)
    assert r["payload"] == b"hello" and r["payload_total"] == r["payload_len"] == 5


def test_vlan_ipv6_extension_headers_and_fragments():
    body = ipv6("fe80::1", "ff02::fb", 0, b"\x3c\0" + b"\0" * 6 + b"\x11\0" + b"\0" * 6 + udp(5353, 5353, b"x"))
    r = decode_one(1, b"\0" * 12 + b"\x88\xa8\0\1\x81\0\0\2\x86\xdd" + body)
    assert (r["ip_version"], r["proto"], r["sport"], r["payload"]) == (6, 17, 5353, b"x")
    r = decode_one(1, ether(ipv4("1.2.3.4", "5.6.7.8", 17, b"x" * 30, fragment=5)))
    assert r["fragment"] and not r["has_l4"] and r["sport"] is None and r["decode_status"] == "Ok"
    r = decode_one(1, ether(ipv6("::1", "::2", 44, b"\x11\0\0\x08" + b"\0" * 4 + b"y" * 8), 0x86DD))
    assert r["fragment"] and r["proto"] == 17


@pytest.mark.parametrize("link,head", [(0, b"\2\0\0\0"), (108, b"\0\0\0\2"), (12, b""), (101, b""), (228, b""), (113, b"\0" * 14 + b"\x08\0"), (276, b"\x08\0" + b"\0" * 18)])
def test_link_types(link, head):
    r = decode_one(link, head + ipv4("10.0.0.1", "10.0.0.2", 1, b"\x08\0xx"))
    assert (r["decode_status"], r["icmp_type"], r["icmp_code"]) == ("Ok", 8, 0)


def test_what_is_not_decoded():
    assert decode_one(1, b"\0" * 13)["decode_status"] == "Malformed"
    assert decode_one(1, ether(b"x" * 40, 0x0806))["decode_status"] == "NotIp"
    assert decode_one(1, ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1, 2)[:12] + b"\x10" + tcp(1, 2)[13:])))["decode_status"] == "Malformed"
    assert decode_one(1, ether(ipv4("1.1.1.1", "2.2.2.2", 17, udp(1, 2, b"", 7))))["decode_status"] == "Malformed"
    cut = decode_one(1, ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1, 2)[:10], total=40)))
    assert cut["decode_status"] == "Ok" and not cut["has_l4"]
    with pytest.raises(UnsupportedLink):
        decode_one(147, b"")


def test_lengths_of_zero_and_truncation():
    assert decode_one(1, ether(ipv4("1.1.1.1", "2.2.2.2", 6, tcp(1, 2, payload=b"abc"), total=0)))["payload"] == b"abc"
    r = decode_one(1, ether(ipv4("1.1.1.1", "2.2.2.2", 17, udp(1, 2, b"abc", 108), total=128)))
    assert (r["payload"], r["payload_len"], r["payload_total"]) == (b"abc", 3, 100)


def test_every_prefix_and_random_bytes_are_survived():
    frame, rng = ether(ipv6("::1", "::2", 0, b"\x06\0" + b"\0" * 6 + tcp(1, 2, payload=b"hi")), 0x86DD), random.Random(5)
    for n in range(len(frame)):
        decode_one(1, frame[:n])
    for _ in range(5000):
        data = bytearray(frame)
        for _ in range(rng.randrange(1, 8)):
            data[rng.randrange(len(data))] = rng.randrange(256)
        for link in (1, 0, 12, 113, 276):
            decode_one(link, bytes(data[: rng.randrange(len(data))]))


def test_dns_answers_names_and_cuts():
    m = parse_dns(dns("WWW.Example.org", ["1.2.3.4", "5.6.7.8"], cname="cdn.example.net"))
    assert (m["question"], m["response"], [a["addr"] for a in m["answers"]], m["answers"][0]["target"]) == ("www.example.org", True, [None, "1.2.3.4", "5.6.7.8"], "cdn.example.net")
    whole = dns("a.b", ["1.2.3.4", "5.6.7.8"])
    assert len(parse_dns(whole[:-3])["answers"]) == 1 and parse_dns(whole[:-20]) is None
    assert parse_dns(dns("x.y", rcode=3))["rcode"] == 3
    loop = b"\0\7\x81\x80\0\1\0\0\0\0\0\0\xc0\x0c\0\1\0\1"
    assert parse_dns(loop) is None and parse_dns(b"\0" * 11) is None
    assert parse_dns_tcp(len(whole).to_bytes(2, "big") + whole)["question"] == "a.b" and parse_dns_tcp(b"\0\xff" + whole) is None


def test_server_names():
    d = hello("Shop.Example.org", pad=300)
    for n in range(len(d)):
        result, host = tls.extract_sni(d[:n])
        assert result in (tls.NEED_MORE, tls.FOUND) and (result != tls.FOUND or host == "shop.example.org")
    assert tls.extract_sni(d) == (tls.FOUND, "shop.example.org")
    assert tls.extract_sni(hello("x", sni=False))[0] == tls.NO_SNI
    assert tls.extract_sni(hello("bad host!"))[0] == tls.NO_SNI
    assert tls.extract_sni(b"GET / HTTP/1.1")[0] == tls.NOT_TLS
    rng = random.Random(1)
    for _ in range(3000):
        e = bytearray(d)
        e[rng.randrange(len(e))] = rng.randrange(256)
        tls.extract_sni(bytes(e))
        parse_dns(bytes(e))
    assert socket.AF_INET


def test_batches_decode_to_what_single_packets_do():
    rng, rows = random.Random(3), []
    frames = [
        ether(ipv4("10.0.0.1", "192.168.1.2", 6, tcp(1234, 443, 2**32 - 1, 5, 0x18, b"hello", b"\1" * 8))) + b"\0" * 9,
        b"\0" * 12 + b"\x88\xa8\0\1\x81\0\0\2\x86\xdd" + ipv6("fe80::1", "ff02::fb", 0, b"\x3c\0" + b"\0" * 6 + b"\x11\0" + b"\0" * 6 + udp(5353, 5353, b"x")),
        ether(ipv4("1.2.3.4", "5.6.7.8", 17, b"x" * 30, fragment=5)), ether(ipv6("::1", "::2", 44, b"\x11\0\0\x08" + b"\0" * 4 + b"y" * 8), 0x86DD),
        ether(ipv6("::1", "::ffff:1.2.3.4", 44, b"\x11\0\0\x00" + b"\0" * 4 + udp(1, 2, b"yyy")), 0x86DD), ether(ipv6("::1", "::2", 51, b"\x06\4" + b"\0" * 22 + tcp(1, 2, payload=b"abc")), 0x86DD),
        b"\2\0\0\0" + ipv4("10.0.0.1", "10.0.0.2", 1, b"\x08\0xx"), b"\0\0\0\x1e" + ipv6("::1", "::2", 58, b"\x80\0xx"), ipv4("10.0.0.1", "10.0.0.2", 6, tcp(1, 2, payload=b"z" * 40)), ipv6("::5", "::6", 17, udp(7, 8, b"hey")),
        b"\0" * 14 + b"\x08\0" + ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2, b"qq")), b"\x08\0" + b"\0" * 18 + ipv4("10.0.0.1", "10.0.0.2", 17, udp(1, 2, b"qq", 0)), ether(b"x" * 40, 0x0806), b"",
    ]
    for _ in range(20_000):
        d = bytearray(rng.choice(frames))
        for _ in range(rng.randrange(4) if d else 0):
            d[rng.randrange(min(len(d), rng.choice((20, 40, 80))))] = rng.choice((0, 1, 4, 6, 17, 44, 51, 60, 0x45, 0x60, 255, rng.randrange(256)))
        if rng.random() < 0.4:
            d = d[: rng.randrange(len(d) + 1)]
        rows.append((rng.choice((1, 1, 1, 0, 108, 12, 101, 113, 276)), bytes(d) if rng.random() < 0.99 else None))
    got = decode_columns(np.array([k for k, _ in rows]), pa.array([None, *(d for _, d in rows)], pa.binary()).slice(1))
    want = [decode_one(k, d or b"") for k, d in rows]
    for f in FIELDS:
        assert got[f].to_pylist() == [w[f] for w in want], f
    assert sum(w["has_l4"] for w in want) > 1000
    assert decode_columns(np.zeros(0, np.int64), pa.array([], pa.binary()))["src"].to_pylist() == []
    with pytest.raises(UnsupportedLink):
        decode_columns(np.array([147]), pa.array([b""], pa.binary()))


def test_facts_of_addresses_agree_with_the_expressions(spark):
    from pyspark.sql import functions as F

    texts = ["10.0.0.1", "127.9.9.9", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.1", "192.168.1.1", "192.169.1.1", "169.254.0.1", "100.63.0.1", "100.64.0.1", "100.128.0.1", "224.0.0.1", "239.9.9.9", "240.0.0.1", "255.255.255.255", "8.8.8.8", "::1", "::", "fe80::1", "febf::1", "fec0::1", "fc00::1", "fdff::1", "fe00::1", "ff02::fb", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "2001:db8::1", "nonsense"]
    raw, mine = addresses.parse_ip(F.col("t")), (addresses.parse_ip_text("8.8.8.8"), addresses.parse_ip_text("2001:db8::1"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", addresses.is_local(raw).alias("p"), addresses.is_local(raw, mine).alias("l"), addresses.is_multicast_or_broadcast(raw).alias("m"), addresses.order_key(raw).alias("o")).collect()
    facts = {t: addresses.address_facts(t) for t in texts}
    for r in rows:
        assert (bool(r.p), bool(r.l), bool(r.m)) == (facts[r.t].local, addresses.address_facts(r.t, mine).local, facts[r.t].multicast), r.t
    known = [r for r in rows if r.o is not None]
    assert [r.t for r in sorted(known, key=lambda r: r.o)] == sorted((r.t for r in known), key=lambda t: facts[t].order)
