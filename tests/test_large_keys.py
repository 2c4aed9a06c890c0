"""Queries whose ports come from keys, on tables with keys beyond 16 bits of ports, against their oracles; hosts in one pass."""

import glob
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from builders import dns, ether, ipv4, tcp, udp
from flowloom import registry
from flowloom.config import EngineConfig
from flowloom.decode.link import decode_packets
from flowloom.operators import rates
from flowloom.plans import engine
from flowloom.schemas import OWNERS, RAW_PACKETS
from flowloom.sources import text
from test_registry import canon

ME = "192.168.1.10"
SHIFTS = (0, 25_000, 40_000, 300_000)


@pytest.fixture(scope="module")
def large(sf, tmp_path_factory):
    """Tables of customers and events over and over, each time with larger keys."""
    d, c = str(tmp_path_factory.mktemp("large")), duckdb.connect()
    times = f"(select unnest({list(SHIFTS)}) as s)"
    c.execute(f"copy (select * exclude s replace (c_custkey + s as c_custkey) from '{sf}/customer.parquet', {times} order by all) to '{d}/customer.parquet' (format parquet)")
    c.execute(f"copy (select * exclude s replace (event_id + s as event_id, user_id + s as user_id) from '{sf}/events.parquet', {times} order by all) to '{d}/events.parquet' (format parquet)")
    return d


def against_oracle(spark, folder, name):
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    want = c.execute(registry.ORACLES[name])
    columns, got = [d[0] for d in want.description], registry.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(columns)
    rows = canon(want.fetchall(), columns)
    assert canon([tuple(r) for r in got.collect()], got.columns) == rows
    return rows


def test_frames_of_large_ports(spark, large):
    rows = against_oracle(spark, large, "d1_decode_frames")
    assert max(int(r[9]) for r in rows if r[9] != "null") >= 340_000
    against_oracle(spark, large, "d11_truncated")


def test_a_capture_of_large_ports(spark, large):
    rows = against_oracle(spark, large, "s1_capture_file")
    assert max(int(r[5]) for r in rows) >= 340_000


def test_owners_of_large_ports(spark, large):
    assert any("340000" in r for r in against_oracle(spark, large, "s7_owner_sink"))


def test_owner_lines_by_their_numbers(spark):
    lines = ["tcp 10.0.0.1 65535 10.0.0.2 443 a", "tcp 10.0.0.1 65536 10.0.0.2 443 b c", "tcp 10.0.0.3 70000 10.0.0.2 2147483647 d", "tcp 10.0.0.1 x 10.0.0.2 443 e", "tcp 10.0.0.1 2147483648 10.0.0.2 443 f"]
    rows = spark.createDataFrame(list(enumerate(lines)), "line_no int, value string")
    assert sorted((r.local_port, r.remote_port, r.app) for r in text.parse_owners(rows).collect()) == [(65535, 443, "a"), (65536, 443, "b c"), (70000, 2147483647, "d")]
    assert {r.addr for r in text.local_addresses(rows).collect()} == {"10.0.0.1", "10.0.0.3"}


def _hosts_step_by_step(a):
    """``engine.view_hosts`` as defined: names carried over a flow's seconds, and groups of live flows."""
    live = engine.live_flows(a)
    now = rates.grouped(live, "shown", "app", a.tick)
    label = F.when(F.col("host") != "", F.col("host")).otherwise(F.when(F.col("local_is_a"), F.col("b")).otherwise(F.col("a")))
    steps = a.folded.groupBy(*engine.KEYS, (F.expr("ts_usec div 1000000") + F.when(F.col("event") == "packet", 1).otherwise(0)).alias("tick")).agg(F.max_by(label, F.struct("ts_usec", "pkt_no")).alias("name"))
    credit = rates.credited_totals(rates.flow_seconds(a.folded.where("event = 'packet'"), engine.KEYS), steps, engine.KEYS)
    both = credit.join(now.drop("total_in", "total_out"), "name", "left").where("total_in + total_out > 0")
    return {r.name: (r.detail, r.service or "", r.flows or 0, round(r.rate_in or 0, 6), round(r.rate_out or 0, 6), r.total_in, r.total_out) for r in both.collect()}


def test_hosts_take_one_pass_over_the_fold(spark):
    rng, start, rows, ts = random.Random(3), 1_790_168_400_000_000, [], 1_790_168_400_000_000
    for k in range(1500):
        ts += rng.choice((1000, 50_000, 400_000, 1_100_000)) if rng.random() < 0.97 else rng.choice((15_000_000, 130_000_000))
        peer, port = f"9.9.9.{rng.randrange(6)}", 5000 + rng.randrange(4)
        near, far = (ME, port), (peer, rng.choice((443, 80)))
        src, dst = (near, far) if rng.random() < 0.5 else (far, near)
        if rng.random() < 0.1:
            l4, proto = udp(53, 5300, dns(f"n{rng.randrange(5)}.example", (peer,))), 17
            src, dst = ("8.8.8.8", 53), (ME, 5300)
        elif rng.random() < 0.5:
            l4, proto = udp(src[1], dst[1], b"x" * rng.randrange(50)), 17
        else:
            l4, proto = tcp(src[1], dst[1], k, 0, rng.choice((2, 18, 16, 16, 16, 17, 4)), b"GET / HTTP/1.1\r\nHost: h%d.example\r\n\r\n" % rng.randrange(3) if src == near else b"y"), 6
        rows.append((ts, ether(ipv4(src[0], dst[0], proto, l4))))
    for _ in range(5):  # names that come after the last packet
        ts += 700_000
        rows.append((ts, ether(ipv4("8.8.8.8", ME, 17, udp(53, 5300, dns("late.example", ("9.9.9.1",)))))))
    packets = decode_packets(spark.createDataFrame([(k, t, 1, len(d), len(d), bytearray(d)) for k, (t, d) in enumerate(rows)], RAW_PACKETS))
    owners = spark.createDataFrame([("udp", ME, 5000 + k, "0.0.0.0", 0, f"app{k}") for k in range(4)], OWNERS)
    for recorded in (None, owners):
        a = engine.analyse(packets, EngineConfig((ME,)), recorded=recorded, want_alerts=False)
        view = engine.view_hosts(a)
        got = {r.name: (r.detail, r.service, r.flows, round(r.rate_in, 6), round(r.rate_out, 6), r.total_in, r.total_out) for r in view.collect()}
        assert got == _hosts_step_by_step(a) and len(got) > 8 and {d[:3] for d, *_ in got.values() if d} == ({"app"} if recorded else set())
        if recorded is None:
            plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
            assert plan(view) == plan(a.folded)
