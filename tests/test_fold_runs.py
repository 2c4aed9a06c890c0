"""Runs of packets taken in at once against the same packets taken in one by one."""

import random

import pyarrow as pa
import pytest

from builders import hello
from flowloom.operators import flows
from flowloom.operators.signatures import Matcher

TYPES = pa.schema([
    ("a", pa.string()), ("pa", pa.int32()), ("b", pa.string()), ("pb", pa.int32()), ("proto", pa.int32()), ("session", pa.int64()), ("incarnation", pa.int32()), ("event", pa.string()), ("pkt_no", pa.int64()),
    ("ts_usec", pa.int64()), ("wire_len", pa.int64()), ("from_a", pa.bool_()), ("outbound", pa.bool_()), ("service", pa.string()), ("host", pa.string()), ("host_source", pa.int32()), ("client_is_a", pa.bool_()),
    ("local_is_a", pa.bool_()), ("transit", pa.bool_()), ("half_open", pa.bool_()), ("closed", pa.bool_()), ("completed", pa.bool_()), ("rules", pa.list_(pa.int32())),
])
KEYED = pa.schema([
    ("a", pa.string()), ("pa", pa.int32()), ("b", pa.string()), ("pb", pa.int32()), ("proto", pa.int32()), ("ts_usec", pa.int64()), ("pkt_no", pa.int64()), ("kind", pa.int32()), ("wire_len", pa.int64()), ("from_a", pa.bool_()),
    ("has_l4", pa.bool_()), ("sport", pa.int32()), ("dport", pa.int32()), ("tcp_flags", pa.int32()), ("seq", pa.int64()), ("payload", pa.binary()), ("payload_len", pa.int64()), ("payload_total", pa.int64()), ("src_local", pa.bool_()),
    ("dst_local", pa.bool_()), ("dst_multicast", pa.bool_()), ("addr", pa.string()), ("name", pa.string()),
])


def made(rng: random.Random) -> list[dict]:
    """Random rows of a few flows, sorted as the fold gets them."""
    rows, no = [], 0
    for f in range(rng.randrange(1, 5)):
        proto = rng.choice((6, 6, 6, 17, 1))
        key = {"a": "10.0.0.1", "pa": 40000 + f, "b": "9.9.9.9", "pb": rng.choice((80, 443, 22)), "proto": proto}
        ts, seq = 1_790_168_400_000_000, [rng.choice((5, 2**32 - 300)), rng.choice((9, 2**32 - 40))]
        data = hello("a.example") + b"x" * 60
        sent = 0
        for _ in range(rng.randrange(1, 40)):
            ts += rng.choice((1000, 1000, 1000, 400_000, 9_000_000, 12_000_000, 40_000_000, 130_000_000) if rng.random() < 0.3 else (1000,))
            no += 1
            base = {c: None for c in KEYED.names} | key | {"ts_usec": ts, "pkt_no": no}
            if rng.random() < 0.05:
                rows.append(base | {"kind": 0, "addr": "9.9.9.9", "name": f"n{no}.example"})
                continue
            d = rng.random() < 0.5
            flags = rng.choice((16, 16, 16, 16, 24, 2, 18, 17, 4)) if rng.random() < 0.4 else 16
            total = rng.choice((0, 0, 0, 10, 30, 100)) if proto != 1 else 0
            kept = total if rng.random() < 0.6 else rng.choice((0, min(5, total)))
            at = (seq[d] + rng.choice((0, 0, 0, 0, -10, 20, -100))) % 2**32
            body = data[sent : sent + kept] if d else bytes(rng.choice(b"abc") for _ in range(kept))
            body = body.ljust(kept, b"z")
            sent += kept * d
            l4 = proto != 1 and rng.random() < 0.95
            rows.append(base | {
                "kind": 1, "wire_len": 60 + total, "from_a": d, "has_l4": l4, "sport": (key["pa"] if d else key["pb"]) if l4 else None, "dport": (key["pb"] if d else key["pa"]) if l4 else None,
                "tcp_flags": flags if proto == 6 and l4 else None, "seq": at if proto == 6 and l4 else None, "payload": body if l4 else None, "payload_len": kept if l4 else 0, "payload_total": total if l4 else 0,
                "src_local": d, "dst_local": not d, "dst_multicast": False,
            })
            seq[d] = (at + total + (1 if flags & 2 else 0)) % 2**32
    return rows


def folded(rows, matcher, size) -> list[dict]:
    fold, out = flows.Fold(matcher), []
    for s in range(0, len(rows), size):
        for b in flows.fold_batch(fold, pa.RecordBatch.from_pylist(rows[s : s + size], schema=KEYED), TYPES):
            out += b.to_pylist()
    if late := fold.finish():
        out += flows._named(late, TYPES).to_pylist()
    return sorted(out, key=lambda r: (r["pa"], r["event"], r["pkt_no"], r["ts_usec"]))


@pytest.mark.parametrize("with_rules", (False, True))
def test_runs_are_the_same_as_single_packets(monkeypatch, with_rules):
    rng = random.Random(11)
    matcher = Matcher([{"rule_id": 3, "content": b"abca", "nocase": False}, {"rule_id": 4, "content": b"CC", "nocase": True}]) if with_rules else None
    taken = 0
    for _ in range(120):
        rows = made(rng)
        at_once = folded(rows, matcher, rng.choice((3, 7, 1000)))
        with monkeypatch.context() as m:
            m.setattr(flows.Fold, "dull", lambda self, run: False)
            one_by_one = folded(rows, matcher, 1000)
        assert at_once == one_by_one
        taken += len(at_once)
    assert taken > 3_000
