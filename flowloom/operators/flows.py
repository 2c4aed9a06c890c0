"""Flows: sessions, roles, handshakes, stream positions and names, folded packet by packet.

Packets are dealt by flow key and sorted by time; a Python fold walks each flow once and holds only
its state, so a flow may have any number of packets. Everything that needs other flows (DNS
answers) comes into the same order as rows of the flows it may concern.

Whole-second ticks happen before the packets of their second. A flow is gone when a tick finds it
idle for longer than its limit, which depends on its state; a later packet then begins a session.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import EngineConfig
from ..decode import tls
from ..functions.addresses import address_facts, parse_ip_text
from ..functions.services import is_service, label_of
from . import naming
from .naming import DNS, HTTP, SNI
from .signatures import _matcher, matcher_blob

_US = 1_000_000
SYN, ACK, FIN, RST = 0x02, 0x10, 0x01, 0x04
MAX_HELLO = 16384
_METHODS = tuple(m + b" " for m in (b"GET", b"POST", b"PUT", b"HEAD", b"DELETE", b"OPTIONS", b"PATCH", b"CONNECT"))
_NAME_CHARS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")

OUT = (
    "a string, pa int, b string, pb int, proto int, session bigint, incarnation int, event string, pkt_no bigint, ts_usec bigint, wire_len bigint, "
    "from_a boolean, outbound boolean, service string, host string, host_source int, client_is_a boolean, local_is_a boolean, transit boolean, "
    "half_open boolean, closed boolean, completed boolean, rules array<int>"
)


def http_host(data: bytes) -> str:
    """The first Host header in the first 4096 bytes; an invalid one does not lead to the next."""
    head = data[:4096]
    at = head.lower().find(b"\nhost:")
    if at < 0:
        return ""
    value = head[at + 6 :].lstrip(b" ")
    for stop in (b"\r", b"\n", b":"):
        value = value.split(stop, 1)[0]
    return value.decode("ascii").lower() if 0 < len(value) <= 253 and _NAME_CHARS.issuperset(value) else ""


def ahead(seq: int, expected: int) -> int:
    """Signed distance of two 32-bit sequence numbers."""
    return (seq - expected + 0x80000000) % 0x100000000 - 0x80000000


@dataclass
class Flow:
    """State of one flow in one session; directions are 0 (from side a) and 1."""

    session: int
    first: int
    last: int = 0
    incarnation: int = 0
    client_is_a: bool = True
    local_is_a: bool = True
    transit: bool = False
    service: str = "Other"
    host: str = ""
    source: int = 0
    syn_seen: bool = False
    synack_seen: bool = False
    established: bool = False
    reset: bool = False
    fin: list = field(default_factory=lambda: [False, False])
    expect: list = field(default_factory=lambda: [None, None])
    tails: list = field(default_factory=lambda: [b"", b""])
    hello: str = "waiting"
    held: bytes = b""
    late: tuple | None = None

    def limit(self, proto: int) -> int:
        if self.reset or all(self.fin):
            return 10
        if proto == 6:
            return 30 if self.syn_seen and not self.established else 300
        return _SHORTEST_OTHER


class Fold:
    """Walks the rows of one flow key after another."""

    def __init__(self, matcher=None):
        self.matcher = matcher
        self.flow: Flow | None = None
        self.key = None
        self.names: dict[str, str] = {}
        self.sessions = 0

    def start_key(self, key) -> list[tuple]:
        out = self.finish()
        self.key, self.flow, self.names, self.sessions = key, None, {}, 0
        return out

    def finish(self) -> list[tuple]:
        """A name that a tick gave after the flow's last packet."""
        f = self.flow
        if f is None or f.late is None or f.source >= DNS:
            return []
        tick, name = f.late
        if tick - f.last > f.limit(self.key[4]) * _US + _US:
            return []
        f.host, f.source, f.late = name, DNS, None
        return [(self.key, tick, self.state())]

    def state(self) -> tuple:
        """What the flow is now, in the order of ``STATE``."""
        f = self.flow
        half = self.key[4] == 6 and not f.established
        return f.session, f.incarnation, f.service, f.host, f.source, f.client_is_a, f.local_is_a, f.transit, half, f.reset or all(f.fin)

    def _remote(self) -> str:
        a, _, b, _, _ = self.key
        return plain(b if self.flow.local_is_a else a)

    def answer(self, ts: int, addr: str, name: str) -> None:
        self._ticks(ts)
        self.names[addr] = name
        f = self.flow
        if f is not None and f.source < DNS and self._remote() == addr:
            f.late = ((ts // _US + 1) * _US, name)

    def _ticks(self, ts: int) -> None:
        """What the ticks up to ``ts`` did to the flow."""
        f = self.flow
        if f is None:
            return
        if f.late is not None and f.late[0] <= ts // _US * _US and f.source < DNS and f.late[0] - f.last <= (f.limit(self.key[4]) + 1) * _US:
            f.host, f.source, f.late = f.late[1], DNS, None
        if ts // _US * _US - f.last > f.limit(self.key[4]) * _US:
            self.flow = None

    def packet(self, p: dict) -> tuple[bool, list[int]]:
        """Takes one packet in: whether it completes a handshake, and the rules it matches."""
        ts, proto, flags = p["ts_usec"], self.key[4], p["tcp_flags"] or 0
        d = 0 if p["from_a"] else 1
        tcp = proto == 6 and p["has_l4"]
        self._ticks(ts)
        opens = tcp and flags & (SYN | ACK) == SYN
        f = self.flow
        if f is None:
            f = self.flow = Flow(self.sessions, ts)
            self.sessions += 1
            self._begin(f, p, tcp, flags)
        elif opens and (f.reset or any(f.fin) or (f.expect[d] is not None and f.expect[d] != (p["seq"] + 1) % (1 << 32))):
            fresh = Flow(f.session, f.first, incarnation=f.incarnation + 1)
            f = self.flow = fresh
            self._begin(f, p, tcp, flags)
        f.last = ts
        completed = tcp and self._handshake(f, p, d, flags)
        rules: list[int] = []
        if p["payload_len"] > 0 or (proto == 6 and (p["payload_total"] or 0) > 0):
            rules = self._payload(f, p, d, flags)
        return completed, rules

    def dull(self, run: Run) -> bool:
        """Takes in a run of packets that change nothing but times and stream positions; False if they might."""
        f = self.flow
        if f is None or f.late is not None or (self.key[4] == 6 and f.synack_seen and not f.established):
            return False
        if self.key[4] == 6 and run.moves.any():
            if f.hello != "done" and ((run.payload if f.hello == "waiting" else run.moves) & (run.from_a == f.client_is_a)).any():
                return False
            after = list(f.expect)
            for d in (0, 1):
                own = np.flatnonzero(run.moves & (run.from_a == (d == 0)))
                if len(own):
                    start = f.expect[d] if f.expect[d] is not None else int(run.seq[own[0]])
                    gone = (run.seq[own] + run.total[own] - start + 0x80000000) % 0x100000000 - 0x80000000
                    if np.abs(gone).max() >= 0x40000000 or run.total[own].max() >= 0x40000000:
                        return False  # too far apart to tell which is ahead of which
                    after[d] = (start + max(0, int(gone.max()))) % (1 << 32)
            for d in (0, 1):
                if after[d] != f.expect[d]:
                    f.expect[d], f.tails[d] = after[d], b""
        f.last = int(run.ts[-1])
        return True

    def _begin(self, f: Flow, p: dict, tcp: bool, flags: int) -> None:
        sport, dport, proto = p["sport"] or 0, p["dport"] or 0, self.key[4]
        src_local, dst_local = p["src_local"], p["dst_local"]
        if tcp and flags & SYN:
            from_client = not flags & ACK
        else:
            s, t = (p["has_l4"] and is_service(proto, x) for x in (sport, dport))
            from_client = t if s != t else sport > dport if s and sport != dport else src_local or not dst_local
        f.client_is_a = from_client == p["from_a"]
        if src_local != dst_local:
            at_src = src_local
        elif src_local:
            at_src = from_client
        else:
            at_src, f.transit = False, not p["dst_multicast"]
        f.local_is_a = at_src == p["from_a"]
        f.service = label_of(proto, self._server_port(f) if p["has_l4"] else 0)
        name = self.names.get(self._remote())
        if name:
            f.host, f.source = name, DNS

    def _server_port(self, f: Flow) -> int:
        return self.key[3] if f.client_is_a else self.key[1]

    def _name(self, f: Flow, host: str, source: int) -> None:
        if host and source >= f.source:
            f.host, f.source = host, source

    def _handshake(self, f: Flow, p: dict, d: int, flags: int) -> bool:
        completed = False
        if flags & SYN:
            f.expect[d] = (p["seq"] + 1) % (1 << 32)
            if flags & ACK:
                f.synack_seen = True
            else:
                f.syn_seen = True
        elif flags & ACK and (d == 0) == f.client_is_a and f.synack_seen and not f.established:
            f.established = completed = True
        if flags & FIN:
            f.fin[d] = True
        if flags & RST:
            f.reset = True
        return completed

    def _payload(self, f: Flow, p: dict, d: int, flags: int) -> list[int]:
        data, total = p["payload"] or b"", p["payload_total"] or 0
        short = p["payload_len"] < total
        if self.key[4] != 6:
            return [r for r, _ in self.matcher.scan(data)] if self.matcher else []
        seq = (p["seq"] + (1 if flags & SYN else 0)) % (1 << 32) if p["seq"] is not None else 0
        hole = False
        if f.expect[d] is None:
            f.expect[d], hole = seq, True
        end, far = (seq + total) % (1 << 32), ahead(seq, f.expect[d])
        if far < 0:
            if ahead(end, f.expect[d]) <= 0:
                return []
            if -far >= len(data):
                f.expect[d], f.tails[d] = end, b""
                return []
            data = data[-far:]
        elif far > 0:
            hole, f.tails[d] = True, b""
        f.expect[d] = end
        if (d == 0) == f.client_is_a and f.hello != "done":
            self._hello(f, data, hole and f.hello == "held")
            if short and f.hello == "held":
                self._hello(f, b"", True)
        found: list[int] = []
        if self.matcher and data:
            found = [r for r, _ in self.matcher.scan(data, f.tails[d])]
            f.tails[d] = self.matcher.tail(data, f.tails[d])
        if short:
            f.tails[d] = b""
        return found

    def _hello(self, f: Flow, data: bytes, broken: bool) -> None:
        """The first bytes a client sends: a TLS hello, possibly in parts, or plain text."""
        if broken:
            f.hello, f.held = "done", b""
            return
        if f.hello == "waiting":
            if not data:
                return
            if len(data) < 6 and data[0] == 0x16:
                f.service, f.held, f.hello = "TLS", data, "held"
                return
            if not tls.looks_like_tls(data):
                f.hello = "done"
                if data.startswith(_METHODS):
                    f.service = "HTTP"
                    self._name(f, http_host(data), HTTP)
                elif data.startswith(b"SSH-"):
                    f.service = "SSH"
                return
            f.service = "TLS"
            result, host = tls.extract_sni(data)
            self._name(f, host, SNI)
            f.hello, f.held = ("held", data) if result == tls.NEED_MORE else ("done", b"")
            return
        f.held += data
        result, host = tls.extract_sni(f.held)
        self._name(f, host, SNI)
        if result == tls.NOT_TLS:
            f.service = label_of(self.key[4], self._server_port(f))
        if result != tls.NEED_MORE or len(f.held) > MAX_HELLO:
            f.hello, f.held = "done", b""


def plain(addr: str) -> str:
    """A mapped address as IPv4."""
    return addr[7:] if addr.startswith("::ffff:") and "." in addr else addr


KEY = ["a", "pa", "b", "pb", "proto"]
_OF_PACKET = ["ts_usec", "pkt_no", "wire_len", "has_l4", "sport", "dport", "tcp_flags", "seq", "payload", "payload_len", "payload_total"]
_OF_KEY = "a string, pa int, b string, pb int, from_a boolean, src_local boolean, dst_local boolean, dst_multicast boolean"


def add_keys(packets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Decoded packets with the ends of their flow in key order, direction and what addresses tell (null without addresses).

    The same as ``functions.addresses.flow_key`` and its predicates, for both families: addresses
    are parsed once for each distinct one of a batch, and the other columns pass through untouched.
    """
    local = tuple(x for x in map(parse_ip_text, cfg.local) if x is not None)
    names = packets.columns
    schema = T.StructType([*packets.schema.fields, *T.StructType.fromDDL(_OF_KEY).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        for b in batches:
            src, dst, known = b.column("src"), b.column("dst"), pc.is_valid(b.column("src"))
            both = pa.chunked_array([src, dst]).combine_chunks().fill_null("0.0.0.0").dictionary_encode()
            facts = [address_facts(t, local) for t in both.dictionary.to_pylist()]
            rank = np.zeros(len(facts), np.int64)
            rank[sorted(range(len(facts)), key=lambda k: facts[k].order)] = np.arange(len(facts))
            s, d = (x.to_numpy(zero_copy_only=False) for x in (both.indices.slice(0, len(src)), both.indices.slice(len(src))))
            is_local, multicast = np.array([f.local for f in facts], bool), np.array([f.multicast for f in facts], bool)
            icmp = np.isin(pc.fill_null(b.column("proto"), 0).to_numpy(zero_copy_only=False), (1, 58))
            sp, dp = (np.where(icmp, 0, pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False)) for c in ("sport", "dport"))
            from_a = (rank[s] < rank[d]) | ((s == d) & (sp <= dp))
            which = pa.array(from_a)
            own = [
                pc.if_else(which, src, dst), pa.array(np.where(from_a, sp, dp)), pc.if_else(which, dst, src), pa.array(np.where(from_a, dp, sp)), which,
                pa.array(is_local[s]), pa.array(is_local[d]), pa.array(multicast[d]),
            ]
            own = [pc.if_else(known, c, pa.scalar(None, c.type)) for c in own]
            yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip([*(b.column(n) for n in names), *own], types, strict=True)], schema=types)

    return packets.mapInArrow(run, schema)


def with_keys(packets: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The packets that belong to flows, in the columns of the fold; keys are added where ``packets`` have none yet."""
    own = packets.where("decode_status = 'Ok' and not fragment")
    if "from_a" not in packets.columns:
        own = add_keys(own.select("src", "dst", "proto", *_OF_PACKET), cfg)
    none = F.lit(None).cast("string")
    return own.select(*KEY, *_OF_PACKET, F.lit(1).alias("kind"), "from_a", "src_local", "dst_local", "dst_multicast", none.alias("addr"), none.alias("name"))


#: Seconds of a slot that flows and answers are matched in, and for how long after its last packet an answer may name a flow.
SLOT, AFTER = 300, 302


def answers_for_flows(keyed: DataFrame, answers: DataFrame) -> DataFrame:
    """DNS answers (``addr, name, ts_usec, pkt_no``) as rows of the flows that they may name.

    An answer that repeats the name its address has changes nothing; whether it does is told within
    slots of time, so a busy address is not one task. Of the rest a flow gets the newest one up to
    its first packet (``naming.asof_name``), and those that come while it lasts, by a join on address
    and slots of time; so a busy address does not pair all its flows with all its answers.
    """
    unmapped = lambda c: F.regexp_replace(c, r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1")
    spans = keyed.groupBy(*KEY).agg(F.min(F.struct("ts_usec", "pkt_no")).alias("f"), F.max("ts_usec").alias("last"))
    ends = spans.withColumn("addr", F.explode(F.array_distinct(F.array(unmapped("a"), unmapped("b")))))
    ends = ends.join(answers.select("addr").distinct(), "addr", "left_semi")  # most flows' ends are never answered
    in_order = W.partitionBy("addr", F.expr(f"ts_usec div {SLOT * _US}")).orderBy("ts_usec", "pkt_no")
    told = answers.groupBy("addr", "ts_usec", "pkt_no").agg(F.max("name").alias("name"))
    told = told.withColumn("same", F.lag("name").over(in_order) == F.col("name")).where("same is null or not same").drop("same")
    before = naming.asof_name(ends.select(*KEY, "addr", "f.*"), told, keep=tuple(KEY)).where("name is not null")
    before = before.select(*KEY, "addr", "ts_usec", "pkt_no", "name")
    slots = ends.withColumn("slot", F.explode(F.sequence(F.expr(f"f.ts_usec div {SLOT * _US}"), F.expr(f"(last + {AFTER * _US}) div {SLOT * _US}"))))
    during = slots.join(told.withColumn("slot", F.expr(f"ts_usec div {SLOT * _US}")), ["addr", "slot"])
    during = during.where(f"(ts_usec > f.ts_usec or (ts_usec = f.ts_usec and pkt_no > f.pkt_no)) and ts_usec <= last + {AFTER * _US}")
    return before.unionByName(during.select(*before.columns)).withColumn("kind", F.lit(0))


def fold_flows(packets: DataFrame, answers: DataFrame | None = None, cfg: EngineConfig = EngineConfig(), rules: list[dict] | None = None) -> DataFrame:
    """A row for each packet of a flow with what the flow is after it, and for each name given later (``event``)."""
    keyed = with_keys(packets, cfg)
    rows = keyed if answers is None else keyed.unionByName(answers_for_flows(keyed, answers), allowMissingColumns=True)
    blob = matcher_blob(rules) if rules else None
    schema = T.StructType.fromDDL(OUT)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(schema)
        fold = Fold(_matcher(blob) if blob else None)
        for b in batches:
            yield from fold_batch(fold, b, types)
        if fold.key is not None and (late := fold.finish()):
            yield _named(late, types)

    return rows.repartition(*KEY).sortWithinPartitions(*KEY, "ts_usec", "pkt_no", "kind").mapInArrow(run, schema)


STATE = ("session", "incarnation", "service", "host", "host_source", "client_is_a", "local_is_a", "transit", "half_open", "closed")
#: The shortest idle times that end a TCP flow and any other; packets closer than this need no look at the flow's state.
_SHORTEST, _SHORTEST_OTHER = 10, 120


@dataclass
class Run:
    """Consecutive packets of one flow, as arrays."""

    ts: np.ndarray
    from_a: np.ndarray
    seq: np.ndarray
    total: np.ndarray
    moves: np.ndarray
    payload: np.ndarray


def _named(late: list[tuple], types: pa.Schema) -> pa.RecordBatch:
    """Rows of event ``named``."""
    rows = []
    for key, tick, state in late:
        rows.append(dict(zip(KEY, key, strict=True)) | dict(zip(STATE, state, strict=True)) | {"event": "named", "pkt_no": -1, "ts_usec": tick, "wire_len": 0, "from_a": False, "outbound": False, "completed": False, "rules": []})
    return pa.RecordBatch.from_pylist(rows, schema=types)


def fold_batch(fold: Fold, b: pa.RecordBatch, types: pa.Schema):
    """Folds one batch of rows sorted by flow and time.

    Most packets of a flow carry on what is known of it. Arrays tell which rows may change a flow
    (its first, those with SYN, FIN or RST, what has to be matched or read, those after a pause and
    answers); only these are taken in one by one, the runs between them at once.
    """
    n = b.num_rows
    if not n:
        return
    array = lambda name, none=0: pc.fill_null(b.column(name), none).to_numpy(zero_copy_only=False)
    new = np.zeros(n, bool)
    for name in KEY:
        c = b.column(name)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    new[0] = tuple(b.column(name)[0].as_py() for name in KEY) != fold.key
    is_packet, ts, proto, from_a = array("kind") == 1, array("ts_usec"), array("proto"), array("from_a", False)
    flags, seq, length, total = array("tcp_flags"), array("seq"), array("payload_len"), array("payload_total")
    has_l4 = array("has_l4", False)
    tcp, payload = proto == 6, length > 0
    moves = payload | (tcp & (total > 0))
    hard = new | ~is_packet | (payload & (fold.matcher is not None)) | (tcp & (flags & (SYN | FIN | RST) != 0))
    hard[1:] |= ~is_packet[:-1] | (ts[1:] // _US * _US - ts[:-1] > np.where(tcp, _SHORTEST, _SHORTEST_OTHER)[1:] * _US)
    hard[0] = True  # what was before it is in another batch
    stops = np.flatnonzero(hard)
    text, facts = ("addr", "name"), ("sport", "dport", "src_local", "dst_local", "dst_multicast", "payload")
    taken = b.select([*facts, *text, *KEY]).take(pa.array(stops)).to_pydict()  # of hard rows, all at once
    place = {h: k for k, h in enumerate(stops.tolist())}
    states: list[tuple] = []
    counts: list[int] = []
    completed = np.zeros(n, bool)
    matched: dict[int, list[int]] = {}
    late: list[tuple] = []

    def single(i: int) -> None:
        k = place.get(i)
        got = {c: b.column(c)[i].as_py() for c in facts} if k is None else {c: taken[c][k] for c in facts}
        got |= {"ts_usec": int(ts[i]), "from_a": bool(from_a[i]), "has_l4": bool(has_l4[i]), "tcp_flags": int(flags[i]), "seq": int(seq[i]), "payload_len": int(length[i]), "payload_total": int(total[i])}
        completed[i], rules = fold.packet(got)
        if rules:
            matched[i] = rules
        state = fold.state()
        if counts and states[-1] == state:
            counts[-1] += 1
        else:
            states.append(state), counts.append(1)

    for h, stop in zip(stops.tolist(), [*stops[1:].tolist(), n], strict=True):
        if new[h]:
            late += fold.start_key(tuple(taken[c][place[h]] for c in KEY))
        if not is_packet[h]:
            fold.answer(int(ts[h]), *(taken[c][place[h]] for c in text))
            continue
        single(h)
        i = h + 1
        while i < stop:
            part = slice(i, stop)
            if fold.dull(Run(ts[part], from_a[part], seq[part], total[part], moves[part], payload[part])):
                state = fold.state()
                if states[-1] == state:
                    counts[-1] += stop - i
                else:
                    states.append(state), counts.append(stop - i)
                break
            single(i)
            i += 1
    if late:
        yield _named(late, types)
    rows = np.flatnonzero(is_packet)
    if not len(rows):
        return
    of = pa.array(np.repeat(np.arange(len(states)), counts))
    out = dict(zip(STATE, (pa.array(c, types.field(k).type).take(of) for k, c in zip(STATE, zip(*states, strict=True), strict=True)), strict=True))
    at = pa.array(rows)
    out |= {name: b.column(name).take(at) for name in (*KEY, "pkt_no", "ts_usec", "wire_len", "from_a")}
    sizes = np.zeros(n, np.int64)
    for i, r in matched.items():
        sizes[i] = len(r)
    out["rules"] = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes[rows])]), pa.int32()), pa.array([x for i in sorted(matched) for x in matched[i]], pa.int32()))
    out["outbound"] = pc.equal(out["from_a"], out["local_is_a"])
    out["event"] = pa.repeat("packet", len(rows))
    out["completed"] = pa.array(completed[rows])
    yield pa.RecordBatch.from_arrays([out[f.name].cast(f.type) for f in types], schema=types)


def flow_totals(folded: DataFrame) -> DataFrame:
    """A row for each session: ends, roles, totals by direction, times, last service and name."""
    keys = ["a", "pa", "b", "pb", "proto", "session"]
    last = F.max_by(F.struct("service", "host", "host_source", "client_is_a", "local_is_a", "transit", "half_open", "closed"), F.struct("ts_usec", "pkt_no"))
    own = F.col("event") == "packet"
    out = folded.groupBy(*keys).agg(
        F.sum(F.when(F.col("outbound"), F.col("wire_len")).otherwise(0)).alias("bytes_out"), F.sum(F.when(~F.col("outbound"), F.col("wire_len")).otherwise(0)).alias("bytes_in"),
        F.count_if(own).alias("packets"), F.min("ts_usec").alias("first_usec"), F.max(F.when(own, F.col("ts_usec"))).alias("last_usec"), F.max("incarnation").alias("incarnation"), last.alias("l"),
    )
    mine = F.col("l.local_is_a")
    return out.select(
        *keys, "bytes_in", "bytes_out", "packets", "first_usec", "last_usec", "incarnation", "l.*",
        F.when(mine, F.col("a")).otherwise(F.col("b")).alias("local_addr"), F.when(mine, F.col("pa")).otherwise(F.col("pb")).alias("local_port"),
        F.when(mine, F.col("b")).otherwise(F.col("a")).alias("remote_addr"), F.when(mine, F.col("pb")).otherwise(F.col("pa")).alias("remote_port"),
    )


def evict(flows: DataFrame, max_flows: int) -> DataFrame:
    """The flows that stay when a full table gives up a tenth: half-open ones first, then the longest idle.

    An optional bound, for a table that must be one; what is given up is chosen by a distributed
    sort and limit, with the key as the last word.
    """
    n = flows.count()
    if n < max_flows:
        return flows
    keys = ["a", "pa", "b", "pb", "proto", "session"]
    gone = flows.orderBy(F.col("half_open").desc(), "last_usec", *keys).limit(max(1, n // 10)).select(*keys)
    return flows.join(gone, keys, "left_anti")
