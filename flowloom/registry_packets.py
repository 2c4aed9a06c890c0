"""Registered queries at the level of packets and bytes: TCP folds, hellos, DNS, other link types.

Each customer is given one short conversation or message, in a variant that its key chooses; a
variant is a list of steps with what the definition says they lead to, and the oracle is that list.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .config import EngineConfig
from .decode import dns, link, tls
from .functions import addresses
from .operators import flows

QUERIES: dict = {}
ORACLES: dict = {}
LOCAL = ("192.168.1.10", "192.168.1.11")
START = 1_790_168_400_000_000
SYN, ACK, FIN, RST, PUSH = 2, 16, 1, 4, 8
ME, PEER, OTHER = "'192.168.1.10'", "'93.' || (c_custkey {div} 62500 % 250) || '.' || (c_custkey {div} 250 % 250) || '.' || (c_custkey % 250)", "'8.8.4.4'"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _customers(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")


@dataclass
class Step:
    """A packet: seconds after the start, from side one or not, and what it carries; ``want`` is what the flow is after it."""

    at: float
    up: bool
    want: tuple
    flags: int = ACK
    seq: int = 0
    payload: str | Callable[[], Column] = ""
    lost: int = 0


@dataclass
class Variant:
    """One conversation between two ends, given in SQL."""

    steps: list[Step]
    one: str = ME
    two: str = PEER
    ports: tuple[int, int] = (50000, 9999)
    proto: int = 6


def conversations(customers: DataFrame, variants: list[Variant]) -> DataFrame:
    """Decoded packets; ``pkt_no`` is a hundred times the customer's key and the step's place."""
    k = F.col("c_custkey")
    of = [
        F.array(*[
            F.struct(
                F.lit(n).alias("n"), F.lit(int(s.at * 1e6)).alias("at"), F.expr((v.one if s.up else v.two).format(div="div")).alias("src"), F.expr((v.two if s.up else v.one).format(div="div")).alias("dst"),
                F.lit(v.ports[0] if s.up else v.ports[1]).alias("sport"), F.lit(v.ports[1] if s.up else v.ports[0]).alias("dport"), F.lit(v.proto).alias("proto"), F.lit(s.flags).alias("flags"),
                F.lit(s.seq % (1 << 32)).cast("bigint").alias("seq"), (F.lit(s.payload) if isinstance(s.payload, str) else s.payload()).cast("binary").alias("payload"), F.lit(s.lost).alias("lost"),
            )
            for n, s in enumerate(v.steps)
        ])
        for v in variants
    ]
    chosen = F.lit(None)
    for i, steps in enumerate(of):
        chosen = F.when(k % len(variants) == i, steps).otherwise(chosen)
    p = customers.select("c_custkey", F.explode(chosen).alias("p")).select("c_custkey", "p.*")
    tcp, size = F.col("proto") == 6, F.length("payload").cast("bigint")
    return p.select(
        (k * 100 + F.col("n")).alias("pkt_no"), (F.lit(START) + F.col("at")).alias("ts_usec"), (size + 54).alias("wire_len"), (size + 54).alias("cap_len"), F.lit("Ok").alias("decode_status"), F.lit(4).alias("ip_version"), "src", "dst", "proto",
        F.lit(False).alias("fragment"), F.lit(True).alias("has_l4"), "sport", "dport", F.when(tcp, F.col("flags")).alias("tcp_flags"), F.when(tcp, F.col("seq")).alias("seq"), F.lit(0).cast("bigint").alias("ack"), F.lit(None).cast("int").alias("icmp_type"),
        F.lit(None).cast("int").alias("icmp_code"), "payload", size.alias("payload_len"), (size + F.col("lost")).alias("payload_total"),
    )


def _sql(value) -> str:
    return str(value).lower() if isinstance(value, bool | int) else value if value.startswith("(") else "'" + value + "'"


def wanted(variants: list[Variant], names: str) -> str:
    """The oracle of ``conversations``: a text in parentheses is an expression of the customer's key."""
    cases = [f"select c_custkey * 100 + {n} as pkt_no, {', '.join(f'{_sql(w)} as {name}' for w, name in zip(s.want, names.split(), strict=True))} from customer where c_custkey % {len(variants)} = {i}" for i, v in enumerate(variants) for n, s in enumerate(v.steps)]
    return " union all ".join(cases)


def _folded(spark, sf_dir, variants: list[Variant], rules: list[dict] | None = None, answers: DataFrame | None = None) -> DataFrame:
    return flows.fold_flows(conversations(_customers(spark, sf_dir), variants), answers, EngineConfig(local=LOCAL), rules).where("event = 'packet'")


def _opening(seq: int = 1000, at: float = 0.0, want=(None, None, None)) -> list[Step]:
    return [Step(at, True, want[0], SYN, seq), Step(at + 0.1, False, want[1], SYN | ACK, 5000), Step(at + 0.2, True, want[2], ACK, seq + 1)]


# How long a TCP flow may be idle. session, half open, closed

_OPEN = ((0, True, False), (0, True, False), (0, False, False))
_GAPS = [
    Variant([*_opening(want=_OPEN), Step(0.3, False, (0, False, True), RST, 5001), Step(10.9, True, (0, False, True), ACK, 1001), Step(21.5, True, (1, True, False), ACK, 1001)]),
    Variant([Step(0.5, True, (0, True, False), SYN, 1000), Step(30.9, True, (0, True, False), SYN, 1000), Step(61.2, True, (1, True, False), SYN, 1000)]),
    Variant([*_opening(want=_OPEN), *(Step(t, True, (s, s == 1, False), ACK, 1001) for t, s in ((300.1, 0), (600.5, 0), (901.6, 1)))]),
    Variant([*_opening(want=_OPEN), Step(1, True, (0, False, False), FIN | ACK, 1001), Step(1.5, False, (0, False, True), FIN | ACK, 5001), Step(11.9, True, (0, False, True), ACK, 1002), Step(22.95, True, (1, True, False), ACK, 1002)]),
]


@query(wanted(_GAPS, "session half_open closed"))
def t2_tcp_gaps(spark, sf_dir):
    """T2 and W7 for TCP: closed flows end after 10 idle seconds, half-open ones after 30, others after 300."""
    return _folded(spark, sf_dir, _GAPS).select("pkt_no", "session", "half_open", "closed")


# Who is the client. source is client, service

_LOOP = "'127.' || (c_custkey {div} 62500 % 250) || '.' || (c_custkey {div} 250 % 250) || '.' || (c_custkey % 250)"
_ROLES = [
    Variant([Step(0, True, (True, "TLS")), Step(0.1, False, (False, "TLS"))], ports=(50000, 443)),
    Variant([Step(0, True, (False, "TLS"))], ports=(443, 50000)),
    Variant([Step(0, True, (True, "DNS"))], ports=(443, 53)),
    Variant([Step(0, True, (False, "DNS"))], ports=(53, 443)),
    Variant([Step(0, True, (True, "TCP"))], ports=(50000, 50001)),
    Variant([Step(0, True, (False, "TCP"))], PEER, ME, (50000, 50001)),
    Variant([Step(0, True, (False, "TCP"), SYN | ACK, 7), Step(0.1, False, (True, "TCP"))], ports=(9999, 50000)),
    Variant([Step(0, True, (True, "TCP"), SYN, 7)], ports=(443, 50000)),
    Variant([Step(0, True, (True, "UDP"))], PEER, OTHER, (40000, 40001), 17),
]


@query(wanted(_ROLES, "src_is_client service"))
def t3_tcp_roles(spark, sf_dir):
    """Roles by SYN, by service port, by the lower port, by the local side."""
    return _folded(spark, sf_dir, _ROLES).select("pkt_no", (F.col("client_is_a") == F.col("from_a")).alias("src_is_client"), "service")


# T4: which side is local. outbound, transit

_SIDES = [
    Variant([Step(0, True, (True, False)), Step(1, False, (False, False))], ME, PEER, (50000, 443), 17),
    Variant([Step(0, True, (False, False))], PEER, ME, (443, 50000), 17),
    Variant([Step(0, True, (True, False)), Step(1, False, (False, False))], ME, _LOOP, (50000, 443), 17),
    Variant([Step(0, True, (False, False)), Step(1, False, (True, False))], ME, _LOOP, (443, 50000), 17),
    Variant([Step(0, True, (False, True)), Step(1, False, (True, True))], PEER, OTHER, (50000, 443), 17),
    Variant([Step(0, True, (False, False))], PEER, "'224.0.0.251'", (5353, 5353), 17),
    Variant([Step(0, True, (False, False))], PEER, "'255.255.255.255'", (68, 67), 17),
]


@query(wanted(_SIDES, "outbound transit"))
def t4_sides(spark, sf_dir):
    """T4: one local end, both (the client's side counts), none (transit, unless it is sent to a group)."""
    return _folded(spark, sf_dir, _SIDES).select("pkt_no", "outbound", "transit")


# T5: a port used again. session, incarnation, half open, completed, host


def _get(host: str) -> str:
    return f"GET / HTTP/1.1\r\nHost: {host}\r\n\r\n"


def _talk(at: float, seq: int, n: int, host: str, before: str = "") -> list[Step]:
    state = lambda half, done, name: (0, n, half, done, name)
    return [*_opening(seq, at, (state(True, False, before), state(True, False, before), state(False, True, before))), Step(at + 0.3, True, state(False, False, host), ACK | PUSH, seq + 1, _get(host))]


_REUSED = [
    Variant([*_talk(0, 1000, 0, "one.example"), Step(1, True, (0, 0, False, False, "one.example"), FIN | ACK, 1100), *_talk(2, 900_000, 1, "two.example")]),
    Variant([*_talk(0, 1000, 0, "one.example"), Step(1, False, (0, 0, False, False, "one.example"), RST, 5001), *_talk(2, 900_000, 1, "two.example"), *_talk(4, 70_000, 2, "three.example")]),
    Variant([*_talk(0, 1000, 0, "one.example"), *_talk(2, 900_000, 1, "two.example")]),
    Variant([Step(0, True, (0, 0, True, False, ""), SYN, 1000), Step(3, True, (0, 0, True, False, ""), SYN, 1000), *_talk(4, 1000, 0, "one.example")]),
]


@query(wanted(_REUSED, "session incarnation half_open completed host"))
def t5_port_reuse(spark, sf_dir):
    """T5: a SYN after FIN or RST, or with a new number, begins an incarnation; a repeated one does not."""
    return _folded(spark, sf_dir, _REUSED).select("pkt_no", "session", "incarnation", "half_open", "completed", "host")


# Handshakes. half open, completed

_HANDS = [
    Variant([*_opening(want=((True, False), (True, False), (False, True))), Step(1, True, (False, False), ACK, 1001), Step(1.1, False, (False, False), ACK, 5001)]),
    Variant([Step(0, True, (True, False), SYN, 1000), Step(0.1, True, (True, False), ACK, 1001)]),
    Variant([Step(0, True, (True, False), SYN, 1000), Step(0.1, False, (True, False), SYN | ACK, 5000), Step(0.2, False, (True, False), ACK, 5001), Step(0.3, True, (False, True), ACK, 1001)]),
    Variant([Step(0, False, (True, False), SYN | ACK, 5000), Step(0.2, True, (False, True), ACK, 1001)]),
]


@query(wanted(_HANDS, "half_open completed"))
def t6_handshake(spark, sf_dir):
    """The client's first ACK behind a SYN+ACK completes a handshake, once."""
    return _folded(spark, sf_dir, _HANDS).select("pkt_no", "half_open", "completed")


# Places in the stream. matches of one rule

_RULE = [{"rule_id": 0, "content": b"NEEDLE", "nocase": False}]
_TOP = (1 << 32) - 3


def _stream(*segments: tuple) -> Variant:
    """(offset, payload, matches[, bytes lost]) of segments from the client."""
    return Variant([Step(n, True, (m,), ACK, 1000 + o, text, *lost) for n, (o, text, m, *lost) in enumerate(segments)])


_STREAMS = [
    _stream((0, "xxNEE", 0), (5, "DLEyy", 1), (10, "NEEDLE NEEDLE", 2)),
    _stream((0, "xxNEE", 0), (0, "xxNEE", 0), (5, "DLEyy", 1)),
    _stream((0, "xxNEE", 0), (3, "EEDLEyy", 1)),
    _stream((0, "xxNEE", 0), (6, "DLEyy", 0), (11, "NEEDLE", 1)),
    _stream((0, "xxNEE", 0, 4), (9, "DLEyy", 0)),
    _stream((0, "NEEDLE", 1), (0, "NEEDLE", 0), (6, "NEEDLE", 1)),
    Variant([Step(0, True, (0,), ACK, _TOP, "xxNEE"), Step(1, True, (1,), ACK, 2, "DLEyy"), Step(2, False, (0,), ACK, 9, "DLE NEE"), Step(3, True, (0,), ACK, 7, "DLE")]),
    Variant([Step(0, True, (0,), payload="xxNEE"), Step(1, True, (0,), payload="DLE"), Step(2, True, (1,), payload="NEEDLE")], proto=17, ports=(50000, 50001)),
]


@query(wanted(_STREAMS, "matches"))
def t7_stream_position(spark, sf_dir):
    """What is sent again is not read again, overlaps are trimmed, holes and lost bytes end a match, numbers wrap, directions and datagrams are apart."""
    return _folded(spark, sf_dir, _STREAMS, _RULE).select("pkt_no", F.size("rules").alias("matches"))


# hellos


def _number(value, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(value)), digits, "0")


def hello(host: Column) -> Column:
    """A ClientHello with a server name, as hexadecimal text."""
    n = F.length(host)
    name = F.concat(F.lit("0000"), _number(n + 5, 4), _number(n + 3, 4), F.lit("00"), _number(n, 4), F.lower(F.hex(host.cast("binary"))))
    body = F.concat(F.lit("0303" + "72" * 32 + "00" + "0002" + "1301" + "0100"), _number(n + 9, 4), name)
    return F.concat(F.lit("160301"), _number(n + 56, 4), F.lit("01"), _number(n + 52, 6), body)


def _site() -> Column:
    return F.concat(F.lit("C"), F.col("c_custkey").cast("string"), F.lit(".Example"))


_SITE_SQL = "('c' || c_custkey || '.example')"


@query("""select c_custkey, case c_custkey % 8 when 0 then 'Found' when 1 then 'NeedMore' when 2 then 'NoSni' when 3 then 'NotTls' when 4 then 'NeedMore' when 5 then 'NotTls' when 6 then 'NoSni' else 'Found' end as result,
  case when c_custkey % 8 in (0, 7) then 'c' || c_custkey || '.example' else '' end as host, c_custkey % 8 not in (3, 4) as looks_like_tls from customer""")
def f15_server_name(spark, sf_dir):
    """whole, cut, nameless, no TLS at all, too short to tell, a session id too long, a bad name, with more behind."""
    k, whole = F.col("c_custkey") % 8, hello(_site())
    bare = F.concat(F.lit("160301002d" + "01" + "000029" + "0303" + "72" * 32 + "00" + "0002" + "1301" + "0100"))
    payload = (
        F.when(k == 0, whole).when(k == 1, F.substring(whole, 1, 100)).when(k == 2, bare).when(k == 3, F.hex(F.lit("GET / HTTP/1.1").cast("binary"))).when(k == 4, F.lit("160301"))
        .when(k == 5, F.concat(F.substring(whole, 1, 86), F.lit("21"), F.substring(whole, 89, 4000))).when(k == 6, hello(F.concat(_site(), F.lit("!")))).otherwise(F.concat(whole, F.lit("ffff")))
    )
    rows = _customers(spark, sf_dir).select("c_custkey", F.unhex(payload).alias("payload"))
    looks = (F.length("payload") >= 6) & F.hex("payload").rlike("^16030[0-4]....01")
    return rows.withColumn("sni", tls.sni(F.col("payload"))).select("c_custkey", "sni.result", "sni.host", looks.alias("looks_like_tls"))


def _part(start: int, stop: int | None = None) -> Callable[[], Column]:
    """Bytes [start, stop) of the customer's hello."""
    return lambda: F.unhex(F.substring(hello(_site()), 2 * start + 1, 4000 if stop is None else 2 * (stop - start)))


_HELLOS = [
    Variant([*_opening(want=(("TLS", ""), ("TLS", ""), ("TLS", ""))), Step(1, True, ("TLS", _SITE_SQL), ACK, 1001, _part(0))], ports=(50000, 443)),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, True, ("TLS", ""), ACK, 1001, _part(0, 30)), Step(2, True, ("TLS", _SITE_SQL), ACK, 1031, _part(30))], ports=(50000, 9443)),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, True, ("TLS", ""), ACK, 1001, _part(0, 3)), Step(2, True, ("TLS", _SITE_SQL), ACK, 1004, _part(3))]),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, True, ("TLS", ""), ACK, 1001, _part(0, 30)), Step(2, True, ("TLS", ""), ACK, 1032, _part(31))]),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, True, ("SSH", ""), ACK, 1001, "SSH-2.0-x"), Step(2, True, ("SSH", ""), ACK, 1010, "GET / HTTP/1.1\r\nHost: no.example\r\n")]),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, True, ("HTTP", "web.example"), ACK, 1001, _get("Web.Example"))]),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, True, ("TLS", ""), ACK, 1001, _part(0, 3)), Step(2, True, ("TCP", ""), ACK, 1004, "no hello at all")]),
    Variant([Step(0, True, ("TCP", ""), SYN, 1000), Step(1, False, ("TCP", ""), ACK, 5000, _get("answer.example")), Step(2, True, ("TCP", ""), ACK, 1001, "abc"), Step(3, True, ("TCP", ""), ACK, 1004, _get("late.example"))]),
]


@query(wanted(_HELLOS, "service host"))
def t8_client_hello(spark, sf_dir):
    """The client's first bytes, whole or in parts, name the service and the host."""
    return _folded(spark, sf_dir, _HELLOS).select("pkt_no", "service", "host")


# DNS


def _label(text: Column) -> Column:
    return F.concat(_number(F.length(text), 2), F.lower(F.hex(text.cast("binary"))))


@query("""with c as (select c_custkey as k from customer), m as (select k, k % 7 = 6 as tcp, case when k % 5 = 4 then 3 else 0 end as rcode, case when k % 5 = 4 then 0 else k % 3 end as n, (array[1, 28, 65, 99])[1 + k % 4] as qtype, k % 11 = 10 as bad, k % 13 = 12 and k % 5 <> 4 and k % 3 > 0 as cut from c)
select k as c_custkey, 'c' || k || '.example.org' as question, qtype, (array['A', 'AAAA', 'HTTPS', '?'])[1 + k % 4] as type, rcode, cast(case when cut then least(n, 1) else n end as int) as answers, case when n > 0 then '10.1.' || (k % 250) || '.0' end as first from m where not bad and not (cut and n = 1)
  and not (cut and tcp)""")
def f16_dns_messages(spark, sf_dir):
    """Questions, compressed names, A answers, answers cut short, loops, messages behind a length."""
    k = F.col("c_custkey")
    n = F.when(k % 5 == 4, 0).otherwise(k % 3).cast("int")
    rcode = F.when(k % 5 == 4, 3).otherwise(0)
    qtype = F.get(F.array(*map(F.lit, (1, 28, 65, 99))), (k % 4).cast("int"))
    asked = F.concat(_label(F.concat(F.lit("C"), k.cast("string"))), _label(F.lit("example")), F.when(k % 11 == 10, F.lit("c00c")).otherwise(F.concat(_label(F.lit("org")), F.lit("00"))))
    answer = lambda i: F.concat(F.lit("c00c000100010000003c00040a01"), _number(k % 250, 2), _number(i, 2))
    message = F.concat(
        F.lit("0007818"), rcode.cast("string"), F.lit("0001"), _number(n, 4), F.lit("00000000"), asked, _number(qtype, 4), F.lit("0001"),
        F.when(n > 0, answer(F.lit(0))).otherwise(""), F.when(n > 1, answer(F.lit(1))).otherwise(""),
    )
    sized = F.when(k % 7 == 6, F.concat(_number((F.length(message) / 2).cast("int"), 4), message)).otherwise(message)
    kept = F.when((k % 13 == 12) & (n > 0), F.expr("left(sized, length(sized) - 6)")).otherwise(F.col("sized"))
    rows = _customers(spark, sf_dir).withColumn("sized", sized).select("c_custkey", F.unhex(kept).alias("payload"), F.when(k % 7 == 6, 6).otherwise(17).alias("proto"))
    m = rows.withColumn("m", dns.dns_message(F.col("payload"), F.col("proto"))).where("m is not null")
    return m.select("c_custkey", "m.question", "m.qtype", dns.dns_type_name(F.col("m.qtype")).alias("type"), "m.rcode", F.size("m.answers").alias("answers"), F.get("m.answers", F.lit(0))["addr"].alias("first"))


# Other links, IPv6, ICMP

_LINKS = {0: "18000000", 108: "0000001e", 1: "02" * 12 + "86dd", 12: "", 113: "00" * 14 + "86dd", 276: "86dd" + "00" * 18, 101: ""}
_V4_LINKS = {0: "00000002", 108: "02000000", 1: "02" * 12 + "8100000788a800080800", 12: "", 113: "00" * 14 + "0800", 276: "0800" + "00" * 18, 101: ""}


@query("""with c as (select c_custkey as k from customer), v as (select k, k % 2 = 0 as six, (array[0, 108, 1, 12, 113, 276, 101])[1 + k // 2 % 7] as link_type, k // 14 % 4 as kind from c)
select k as pkt_no, case when six then 'fe80::' || printf('%x', 1 + k % 60000) else '10.2.' || (k % 250) || '.1' end as src, case when six then '2001:db8::' || printf('%x', 1 + k % 250) || ':1' else '224.0.0.1' end as dst,
  case kind when 0 then 17 when 1 then 6 when 2 then case when six then 58 else 1 end else 17 end as proto, case when kind = 3 then null when kind < 2 then 4000 end as sport, case when kind < 2 then 53 end as dport,
  case when kind = 2 then 128 end as icmp_type, case when kind = 2 then cast(k % 5 as int) end as icmp_code, kind = 3 as fragment, case when kind = 3 then 0 when kind = 2 then 0 else k % 9 end as payload_len from v""")
def d3_other_links(spark, sf_dir):
    """Loopback, raw and cooked links, two VLAN tags, IPv6 behind extension headers, ICMP, later fragments."""
    k = F.col("c_custkey")
    six, kind, size = k % 2 == 0, F.expr("c_custkey div 14 % 4"), (k % 9).cast("int")
    link_type = F.get(F.array(*map(F.lit, (0, 108, 1, 12, 113, 276, 101))), F.expr("cast(c_custkey div 2 % 7 as int)"))
    head = lambda table: F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), link_type)
    body = F.repeat(F.lit("61"), size)
    udp = F.concat(F.lit("0fa00035"), _number(size + 8, 4), F.lit("0000"), body)
    tcp = F.concat(F.lit("0fa00035" + "00000001" + "00000000" + "5018" + "ffff00000000"), body)
    icmp = F.concat(F.lit("80"), _number(k % 5, 2), F.lit("000000000000"))
    l4 = F.when(kind == 1, tcp).when(kind == 2, icmp).otherwise(udp)
    proto4 = F.when(kind == 1, "06").when(kind == 2, "01").otherwise("11")
    proto6 = F.when(kind == 1, "06").when(kind == 2, "3a").otherwise("11")
    n = (F.length(l4) / 2).cast("int")
    v4 = F.concat(F.lit("4500"), _number(n + 20, 4), F.lit("0000"), F.when(kind == 3, "0005").otherwise("0000"), F.lit("40"), proto4, F.lit("00000a02"), _number(k % 250, 2), F.lit("01e0000001"), l4)
    # hop-by-hop, then authentication, then a fragment header
    chain = F.concat(F.lit("3300" + "00" * 6), F.lit("2c02" + "00" * 14), proto6, F.lit("00"), F.when(kind == 3, "0008").otherwise("0001"), F.lit("00000000"))
    v6 = F.concat(
        F.lit("60000000"), _number(n + 32, 4), F.lit("0040"), F.lit("fe80" + "00" * 12), _number(k % 60000 + 1, 4), F.lit("20010db8" + "00" * 8), _number(k % 250 + 1, 4), F.lit("0001"), chain, l4
    )
    data = F.unhex(F.when(six, F.concat(head(_LINKS), v6)).otherwise(F.concat(head(_V4_LINKS), v4)))
    raw = _customers(spark, sf_dir).select(k.alias("pkt_no"), F.lit(START).alias("ts_usec"), link_type.alias("link_type"), F.length(data).cast("bigint").alias("cap_len"), F.length(data).cast("bigint").alias("wire_len"), data.alias("data"))
    return link.decode_packets(raw).where("decode_status = 'Ok'").select("pkt_no", "src", "dst", "proto", "sport", "dport", "icmp_type", "icmp_code", "fragment", "payload_len")


# F1 to F9 for IPv6


@query("""with c as (select c_custkey as k, c_custkey % 6 as v, printf('%x', 1 + c_custkey % 60000) as h from customer)
select k as c_custkey, case v when 0 then 'fe80::' || h when 1 then '10.3.' || (k % 250) || '.9' when 2 then '2001:db8::' || h when 3 then 'ff02::' || h when 4 then 'fd00::' || h else '-' end as shown,
  v in (0, 1, 4) as private, v = 3 as multicast, cast(case v when 1 then 4 when 5 then null else 16 end as int) as size from c""")
def f1_addresses(spark, sf_dir):
    """F1 to F7 for both families: a scope that is taken out, a mapped address, what is no address."""
    k = F.col("c_custkey")
    h = F.lower(F.hex(k % 60000 + 1))
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("fe80:7::"), h)).when(k % 6 == 1, F.concat(F.lit("::ffff:10.3."), (k % 250).cast("string"), F.lit(".9"))).when(k % 6 == 2, F.concat(F.lit("2001:0db8:0:0::"), h))
        .when(k % 6 == 3, F.concat(F.lit("FF02::"), h)).when(k % 6 == 4, F.concat(F.lit("fd00::"), h)).otherwise("10.3.1.256")
    )
    rows = _customers(spark, sf_dir).withColumn("text", text).withColumn("raw", addresses.unmapped(addresses.without_scope(addresses.parse_ip(F.col("text")))))
    raw = F.col("raw")
    return rows.select("c_custkey", addresses.format_ip(raw).alias("shown"), F.coalesce(addresses.is_private(raw), F.lit(False)).alias("private"), F.coalesce(addresses.is_multicast_or_broadcast(raw), F.lit(False)).alias("multicast"), F.length(raw).alias("size"))
