import json
import os
import random

import pytest
from pyspark.sql import functions as F

import scenario
from builders import dns, ether, hello, ipv4, tcp, udp
from flowloom import cli
from flowloom.config import DetectorConfig, EngineConfig
from flowloom.decode.link import decode_one, decode_packets, native_ipv4
from flowloom.operators import detectors, flows, series
from flowloom.plans import engine
from flowloom.schemas import PACKETS, RAW_PACKETS
from flowloom.sources import pcap, text

LOCAL = ("192.168.1.10",)
ME, PEER = "192.168.1.10", "203.0.113.5"


@pytest.fixture(scope="module")
def capture(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("capture") / "day.pcap")
    pcap.write_packets(path, scenario.build())
    return path


@pytest.fixture(scope="module")
def analysis(spark, capture, tmp_path_factory):
    pcap.register(spark)
    packets = decode_packets(spark.read.format("pcap").option("path", capture).load())
    rules = text.load_rules(cli.RULES)
    return engine.analyse(packets, EngineConfig((scenario.ME,)), rules, write_to=str(tmp_path_factory.mktemp("folded") / "t"))


def raw_frame(spark, rows):
    """(ts_usec, frame) as raw packets."""
    return spark.createDataFrame([(k, ts, 1, len(d), len(d), bytearray(d)) for k, (ts, d) in enumerate(rows)], RAW_PACKETS)


def fold(spark, rows, rules=None, cfg=EngineConfig(LOCAL)):
    packets = decode_packets(raw_frame(spark, rows))
    return flows.fold_flows(packets, engine.dns_answers(engine.dns_messages(packets)), cfg, rules)


def script(*steps, start=1_790_168_400_000_000, gap=1000):
    """(direction, flags, seq, ack, payload) between one client and one server."""
    out = []
    for k, (d, flags, seq, ack, data) in enumerate(steps):
        a, b, s, t = (ME, PEER, 40000, 80) if d else (PEER, ME, 80, 40000)
        out.append((start + k * gap, ether(ipv4(a, b, 6, tcp(s, t, seq, ack, flags, data)))))
    return out


OPEN = [(1, 2, 100, 0, b""), (0, 18, 500, 101, b""), (1, 16, 101, 501, b"")]


def test_incidents_of_the_scenario_come_once_and_in_order(analysis):
    got = [(r.kind, r.title) for r in analysis.alerts.orderBy("ts_usec").collect()]
    assert [k for k, _ in got] == ["signature", "port_scan", "signature", "traffic_spike", "syn_flood"]
    by = {r.kind: r for r in analysis.alerts.collect()}
    assert by["port_scan"].src == "192.168.1.44" and "ports on 192.168.1.23 in" in by["port_scan"].message
    assert by["syn_flood"].dst == "192.168.1.23:3000" and by["syn_flood"].message.endswith("0% completed")
    assert by["traffic_spike"].message.startswith("Inbound 30.")
    assert any("(printer.local)" in r.message and "web-password" in r.message for r in analysis.alerts.collect())


def test_views_of_the_scenario(analysis):
    views = {k: f(analysis).collect() for k, f in engine.VIEWS.items()}
    assert {r.name for r in views["lookups"]} == {*scenario.SITES, "gone.example"}
    assert [r.note for r in views["lookups"] if r.name == "gone.example"] == ["(not found)"]
    hosts = {r.name: r for r in views["hosts"]}
    assert set(scenario.SITES) < set(hosts) and hosts["video.example"].total_in > 290_000_000
    assert views["services"][0].service in ("TCP", "TLS") and len(views["throughput"]) == len({r.sec for r in views["throughput"]}) >= 178
    assert views["header"][0].total_packets == len(scenario.build()) == views["summary"][0].packets
    assert views["apps"][0].name == "Unknown" and views["summary"][0].alerts == 5
    assert len(views["connections"]) == 200 and views["alerts"][0].kind == "syn_flood"
    assert analysis.seconds.agg(F.sum("bytes_in") + F.sum("bytes_out")).first()[0] == views["header"][0].total_bytes


def test_capture_files_round_trip(spark, capture, tmp_path):
    pcap.register(spark)
    raw = spark.read.format("pcap").option("path", capture).load()
    raw.limit(200).coalesce(1).write.format("pcap").mode("append").option("path", str(tmp_path / "out")).save()
    files = os.listdir(tmp_path / "out")
    assert [f for f in files if f.endswith(".pcap") and not f.startswith(".")]
    again = spark.read.format("pcap").option("path", str(tmp_path / "out")).load()
    assert again.count() == 200
    assert {(r.ts_usec, bytes(r.data)) for r in again.collect()} == {(r.ts_usec, bytes(r.data)) for r in raw.limit(200).collect()}
    with open(tmp_path / "bad", "wb") as f:
        f.write(b"not a capture")
    with pytest.raises(pcap.CaptureError):
        list(pcap.read_packets(str(tmp_path / "bad")))


def test_byte_orders_nanoseconds_and_pcapng(tmp_path):
    import struct

    p = tmp_path / "x"
    p.write_bytes(struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 101) + struct.pack(">IIII", 7, 1999, 2, 9) + b"ab")
    assert list(pcap.read_packets(str(p))) == [(7_000_001, 101, 9, b"ab")]
    block = lambda kind, body: struct.pack("<II", kind, len(body) + 12) + body + struct.pack("<I", len(body) + 12)
    ng = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535) + struct.pack("<HHB3x", 9, 1, 9) + b"\0\0\0\0")
    ng += block(6, struct.pack("<IIIII", 0, 1, 5_000, 3, 60) + b"abc\0")
    p.write_bytes(ng)
    assert list(pcap.read_packets(str(p))) == [(((1 << 32) + 5_000) // 1000, 1, 60, b"abc")]


def test_native_headers_agree_with_the_decoder(spark, capture):
    pcap.register(spark)
    raw = spark.read.format("pcap").option("path", capture).load().limit(500)
    cols = ["pkt_no", "src", "dst", "proto", "sport", "dport", "tcp_flags"]
    assert {tuple(r) for r in native_ipv4(raw).select(cols).collect()} == {tuple(r) for r in decode_packets(raw).select(cols).collect()}


def test_hello_in_two_segments_one_sent_twice(spark):
    h = hello("shop.example.org", pad=100)
    rows = script(*OPEN, (1, 24, 101, 501, h[:80]), (1, 24, 101, 501, h[:80]), (1, 24, 181, 501, h[80:]))
    t = flows.flow_totals(fold(spark, rows)).collect()
    assert [(r.host, r.service, r.session) for r in t] == [("shop.example.org", "TLS", 0)]
    short = script(*OPEN, (1, 24, 101, 501, h[:3]), (1, 24, 104, 501, h[3:]))
    assert flows.flow_totals(fold(spark, short)).first().host == "shop.example.org"


RULE = [{"rule_id": 0, "severity": "high", "name": "secret", "content": b"open sesame", "nocase": False, "message": "m"}]


def test_pattern_over_segments_retransmitted_and_with_a_hole(spark):
    first, rest = b"GET / HTTP/1.1\r\nHost: a.example\r\n\r\nopen ", b"sesame"
    n = 101 + len(first)
    once = script(*OPEN, (1, 24, 101, 501, first), (1, 24, 101, 501, first), (1, 24, n, 501, rest), (1, 24, n, 501, rest))
    hits = fold(spark, once, RULE).where(F.size("rules") > 0).collect()
    assert len(hits) == 1 and hits[0].host == "a.example" and hits[0].service == "HTTP"
    assert not fold(spark, script(*OPEN, (1, 24, 101, 501, first), (1, 24, n + 100, 501, rest)), RULE).where(F.size("rules") > 0).count()
    overlap = script(*OPEN, (1, 24, 101, 501, first), (1, 24, n - 3, 501, first[-3:] + rest))
    assert fold(spark, overlap, RULE).where(F.size("rules") > 0).count() == 1
    wrapped = script((1, 2, 2**32 - 3, 0, b""), (1, 24, 2**32 - 2, 0, b"open "), (1, 24, 3, 0, b"sesame"))
    assert fold(spark, wrapped, RULE).where(F.size("rules") > 0).count() == 1


def test_names_from_dns_before_and_after_the_connection(spark):
    start = 1_790_168_400_000_000
    answer = (start, ether(ipv4("192.168.1.1", ME, 17, udp(53, 4000, dns("www.example.org", [PEER], cname="cdn.example")))))
    t = {r.remote_addr: r for r in flows.flow_totals(fold(spark, [answer, *script(*OPEN, start=start + 10)])).collect()}
    assert t[PEER].host == "www.example.org" and t[PEER].host_source == 2
    late = (start + 500_000, answer[1])
    after = script(*OPEN, start=start) + [late] + script((1, 16, 101, 501, b""), start=start + 3_000_000)
    seen = [r.host for r in fold(spark, after).where(F.col("pb") == 80).union(fold(spark, after).where(F.col("pa") == 80)).orderBy("ts_usec", "pkt_no").collect()]
    assert seen[0] == "" and seen[-1] == "www.example.org"
    only = script(*OPEN, start=start) + [late]
    r = fold(spark, only).where("event = 'named'").collect()
    assert [(x.host, x.ts_usec) for x in r] == [("www.example.org", start + 1_000_000)]


def test_ports_used_again_and_sessions(spark):
    get = lambda host: f"GET / HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    reuse = script(*OPEN, (1, 24, 101, 501, get("one.example")), (1, 17, 160, 501, b""), (1, 2, 9000, 0, b""), (0, 18, 1, 9001, b""), (1, 24, 9001, 2, get("two.example")))
    t = flows.flow_totals(fold(spark, reuse)).collect()
    assert [(r.host, r.incarnation, r.packets) for r in t] == [("two.example", 1, 8)]
    start = 1_790_168_400_000_000
    for flags, limit in ((2, 30), (16, 300), (4, 10)):
        near = script((1, flags, 1, 0, b""), start=start) + script((1, 16, 2, 0, b""), start=start + limit * 1_000_000 + 999_999)
        far = script((1, flags, 1, 0, b""), start=start + 1) + script((1, 16, 2, 0, b""), start=start + (limit + 2) * 1_000_000)
        assert [flows.flow_totals(fold(spark, x)).count() for x in (near, far)] == [1, 2], flags


def test_handshake_completes_once_for_the_server(spark):
    done = fold(spark, script(*OPEN, (1, 16, 101, 501, b""))).where("completed").collect()
    assert len(done) == 1 and not done[0].half_open


def test_directions_roles_and_foreign_multicast(spark):
    t0 = 1_790_168_400_000_000
    rows = [(t0, ether(ipv4("192.168.7.7", "239.1.1.1", 17, udp(5000, 5353, b"x")))), (t0 + 1, ether(ipv4("8.8.8.8", "9.9.9.9", 17, udp(5000, 53, b"x")))), (t0 + 2, ether(ipv4(ME, PEER, 17, udp(5000, 443, b"x"))))]
    got = {r.b if r.a in ("192.168.7.7", "8.8.8.8", ME) else r.a: r for r in fold(spark, rows).collect()}
    assert not got["239.1.1.1"].outbound and not got["239.1.1.1"].transit
    assert got["9.9.9.9"].transit and got[PEER].outbound and got[PEER].service == "QUIC"


def test_gap_fill_and_long_silence(spark):
    s = spark.createDataFrame([(10, 1, 0, 1), (13, 2, 0, 1), (13 + 5000, 4, 0, 1)], "sec long, bytes_in long, bytes_out long, packets long")
    got = [(r.sec, r.bytes_in) for r in series.gap_fill(s).orderBy("sec").collect()]
    assert got[:4] == [(10, 1), (11, 0), (12, 0), (13, 2)]
    assert got[-2:] == [(13 + 4999, 0), (13 + 5000, 4)] and len(got) == 3 + 901 + 1
    empty = spark.createDataFrame([], s.schema)
    assert series.gap_fill(empty).count() == 0


def attempts(spark, rows):
    return spark.createDataFrame(rows, "ts_usec long, src string, dst string, dport int")


def test_port_scan_thresholds_and_memory(spark):
    t0 = 1_790_168_400_000_000
    some = lambda n, at=t0, src="a": [(at + k * 1000, src, "b", k) for k in range(n)]
    assert detectors.port_scans(attempts(spark, some(19))).count() == 0
    got = detectors.scan_alerts(detectors.port_scans(attempts(spark, some(20) + some(100, t0 + 3_000_000)))).collect()
    assert [r.message for r in got] == ["a tried 20 ports on b in 19 ms"]
    again = detectors.port_scans(attempts(spark, some(20) + some(20, t0 + 11_000_000))).count()
    assert again == 2 and detectors.port_scans(attempts(spark, some(20) + some(20, t0 + 10_000_000))).count() == 1
    assert detectors.port_scans(attempts(spark, [(t0, f"h{k}", "b", 80) for k in range(200)])).count() == 0


def test_flood_thresholds(spark):
    t0 = 1_790_168_400_000_000
    tries = attempts(spark, [(t0 + k * 1000, "x", "b", 80) for k in range(1500)])
    none = tries.limit(0)
    got = detectors.flood_alerts(detectors.syn_floods(tries, none)).collect()
    assert [(r.dst, r.message) for r in got] == [("b:80", "b:80 got 1,000 connection attempts a second, 0% completed")]
    assert detectors.syn_floods(tries, tries.where("ts_usec % 10000 <> 0")).count() == 0
    assert detectors.syn_floods(attempts(spark, [(t0 + k * 20_000, "x", "b", 80) for k in range(500)]), none).count() == 0


def test_spikes_warm_up_and_sustained(spark):
    rng = random.Random(2)
    base = [0 if k in (20, 21, 22) else int(2e6 * (0.9 + rng.random() / 5)) for k in range(120)]
    frame = lambda v: spark.createDataFrame([(k, x) for k, x in enumerate(v)], "sec long, bytes_in long")
    got = detectors.spike_alerts(detectors.spikes(frame([*base, *[40_000_000] * 5]), "bytes_in"), "Inbound").collect()
    assert [r.ts_usec for r in got] == [123_000_000] and "20× the usual 2.0" in got[0].message
    assert detectors.spikes(frame([*base[:50], *[40_000_000] * 5]), "bytes_in").count() == 0
    assert detectors.spikes(frame([x // 1000 for x in base] + [400_000] * 9), "bytes_in").count() == 0
    assert detectors.spikes(frame([*base, *[40_000_000] * 4, *base, *[40_000_000] * 4]), "bytes_in").count() == 1


def test_command_line(spark, capture, tmp_path, capsys):
    assert cli.main(["-r", capture, "--local", scenario.ME, "--json", "--alert-log", str(tmp_path / "log")]) == 0
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["type"] for x in lines] == ["signature", "port_scan", "signature", "traffic_spike", "syn_flood"]
    assert list(lines[0])[:5] == ["time", "type", "severity", "title", "message"] and lines[0]["time"].endswith("Z")
    assert cli.main(["-r", capture, "tcp", "port", "3000", "-s", "none"]) == 0
    assert "syn_flood" not in capsys.readouterr().out
    (tmp_path / "bad").write_text('high x "abc')
    assert cli.main(["-r", capture, "-s", str(tmp_path / "bad")]) == 1
    assert "bad, line 1: " in capsys.readouterr().err
    assert cli.main(["-r", capture, "tcp port"]) == 1


def test_schema_of_decoded_packets(spark, capture):
    pcap.register(spark)
    got = decode_packets(spark.read.format("pcap").option("path", capture).load())
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == PACKETS
    assert decode_one(1, b"")["decode_status"] == "Malformed"


def test_answers_that_matter_name_flows_as_all_answers_do(spark, monkeypatch):
    rng, start = random.Random(9), 1_790_168_400_000_000
    rows, ts = [], start
    for _ in range(300):
        ts += rng.choice((1000, 200_000, 1_500_000, 20_000_000, 200_000_000) if rng.random() < 0.3 else (1000, 50_000))
        rows.append((ts, ether(ipv4(ME, f"9.9.9.{rng.randrange(4)}", 17, udp(5000 + rng.randrange(5), 443, b"x")))))
    told = [(f"9.9.9.{rng.randrange(4)}", f"n{rng.randrange(3)}.example", rng.choice(rows)[0] + rng.choice((-400_000_000, -1, 0, 1, 900_000, 100_000_000)), 10_000 + k) for k in range(150)]
    packets = decode_packets(raw_frame(spark, rows))
    answers = spark.createDataFrame(told, "addr string, name string, ts_usec long, pkt_no long")
    columns = ["pa", "pb", "b", "a", "session", "event", "pkt_no", "ts_usec", "host", "host_source"]
    got = sorted(map(tuple, flows.fold_flows(packets, answers, EngineConfig(LOCAL)).select(columns).collect()))

    def every(keyed, answers):
        ends = keyed.select(*flows.KEY).distinct().withColumn("addr", F.explode(F.array("a", "b")))
        return ends.join(answers, "addr").withColumn("kind", F.lit(0))

    monkeypatch.setattr(flows, "answers_for_flows", every)
    want = sorted(map(tuple, flows.fold_flows(packets, answers, EngineConfig(LOCAL)).select(columns).collect()))
    assert got == want and len({r[8] for r in got}) == 4


def test_a_clock_that_jumps_back_resets_the_scan_detector(spark, tmp_path):
    start = 1_790_168_400_000_000

    def scan(at):
        return [(at + p * 1000, ether(ipv4(PEER, ME, 6, tcp(33000, 1 + p, 9, 0, 2)))) for p in range(25)] + [(at + 2_000_000, ether(ipv4(PEER, ME, 17, udp(9, 9))))]

    for back, alerts in ((0, 1), (8_000_000, 2)):  # 8 seconds apart one alert is left out, unless the clock has restarted
        rows = scan(start) + scan(start - back if back else start + 8_000_000)
        for folder in (None, str(tmp_path / str(back))):
            a = engine.analyse(decode_packets(raw_frame(spark, rows)), EngineConfig(LOCAL), write_to=folder)
            assert [r.kind for r in a.alerts.collect()] == ["port_scan"] * alerts


def test_captures_by_uri_and_pattern(spark, tmp_path):
    pcap.register(spark)
    for name in ("b1.pcap", "b2.pcap", "c1.pcap", "_b3.pcap"):
        pcap.write_packets(f"file://{tmp_path}/{name}", [(7, 60, name.encode())])
    read = lambda path: [bytes(r.data).decode() for r in spark.read.format("pcap").option("path", path).load().orderBy("pkt_no").collect()]
    assert read(f"file://{tmp_path}") == ["b1.pcap", "b2.pcap", "c1.pcap"]
    assert read(f"{tmp_path}/b*.pcap") == ["b1.pcap", "b2.pcap"] and read(f"file://{tmp_path}/c1.pcap") == ["c1.pcap"]
    spark.createDataFrame([(0, 5, 1, 3, 3, bytearray(b"abc"))], RAW_PACKETS).write.format("pcap").mode("append").option("path", f"file://{tmp_path}/out").save()
    assert read(f"file://{tmp_path}/out") == ["abc"]
