"""Headless analysis of capture files: ``python -m flowloom.cli --read FILE [--json]``."""

from __future__ import annotations

import argparse
import os
import sys
import time

from .config import DetectorConfig, EngineConfig
from .decode.link import LINK_NAMES, decode_packets
from .operators.filters import FilterError, apply_filter
from .plans import engine
from .session import session
from .sources import pcap, text

RULES = os.path.join(os.path.dirname(__file__), "data", "rules.txt")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="flowloom", description="Analyses packet captures on Spark.")
    p.add_argument("-r", "--read", required=True, metavar="PATH", help="a capture, a folder of captures or a pattern")
    p.add_argument("filter", nargs="*", help="a capture filter, such as: tcp port 443")
    p.add_argument("-s", "--signatures", default=RULES, metavar="FILE", help="payload rules; 'none' for none")
    p.add_argument("-w", "--write", metavar="DIR", help="writes the filtered packets as captures")
    p.add_argument("--work", metavar="DIR", help="a folder that all executors share, for decoded packets and flows")
    p.add_argument("--owners", metavar="FILE", help="recorded owners of connections")
    p.add_argument("--local", action="append", default=[], metavar="ADDR", help="an address of this machine")
    p.add_argument("--snaplen", type=int, default=65535)
    p.add_argument("--repeat", type=int, default=1, help="analyses the capture so often, one after another")
    p.add_argument("--scan-ports", type=int, default=20)
    p.add_argument("--flood-rate", type=float, default=100)
    p.add_argument("--spike-sigma", type=float, default=4)
    p.add_argument("--json", action="store_true", help="alerts as JSON lines")
    p.add_argument("--alert-log", metavar="DIR", help="appends alerts as JSON lines")
    p.add_argument("--view", choices=sorted(engine.VIEWS), action="append", default=[], help="shows a view at the end")
    p.add_argument("--bench", action="store_true", help="tells packets a second")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        cfg = EngineConfig(tuple(args.local), snap_len=args.snaplen, detectors=DetectorConfig(scan_ports=args.scan_ports, flood_rate=args.flood_rate, spike_sigma=args.spike_sigma))
        rules = [] if args.signatures == "none" else text.load_rules(args.signatures)
    except (ValueError, OSError) as e:
        print(f"flowloom: {e}", file=sys.stderr)
        return 1
    spark = session()
    pcap.register(spark)
    raw = spark.read.format("pcap").option("path", args.read).option("snaplen", args.snaplen).load()
    try:
        links = {r.link_type for r in raw.select("link_type").distinct().collect()}  # a handful of codes
        if links - LINK_NAMES.keys():
            raise ValueError(f"link types {sorted(links - LINK_NAMES.keys())} are not supported")
        packets = apply_filter(decode_packets(raw), " ".join(args.filter)) if args.filter else decode_packets(raw)
    except (FilterError, ValueError) as e:
        print(f"flowloom: {e}", file=sys.stderr)
        return 1
    if args.repeat > 1:
        packets = text.repeat_packets(packets, args.repeat)
    if args.write:
        kept = raw.join(packets.select("pkt_no"), "pkt_no", "left_semi") if args.filter else raw
        kept.sortWithinPartitions("ts_usec", "pkt_no").write.format("pcap").mode("append").option("path", args.write).option("linktype", next(iter(links), 1)).save()
    recorded = text.parse_owners(text.read_owner_lines(spark, args.owners)) if args.owners else None
    began = time.time()
    a = engine.analyse(packets, cfg, rules, recorded, args.work)
    alerts = a.alerts.orderBy("ts_usec", "kind", "message")
    lines = text.alert_json_lines(alerts) if args.json else text.alert_text(alerts)
    for row in lines.toLocalIterator():
        print(row.value)
    if args.alert_log:
        text.write_alert_log(a.alerts, args.alert_log)
    for name in args.view:
        engine.VIEWS[name](a).show(50, truncate=False)
    final = engine.summary(a).first()
    if args.bench:
        print(engine.bench_summary(a, time.time() - began).first().asDict(), file=sys.stderr)
    print(f"{final.packets} packets, {final.bytes} bytes, {final.alerts} alerts", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main())
