"""The whole analysis of a capture as one plan of DataFrames, and the views a user sees.

``analyse`` decodes nothing itself: it takes decoded packets, folds flows once (the only Python on
the path besides decoding) and derives the rest with relational operators. If it is given a folder,
packets with the keys of their flows, folded flows and alerts are written there, so that none is
computed more than once and later steps read only the columns they need.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..decode.dns import dns_message
from ..decode.link import is_attempt
from ..functions.addresses import is_local, parse_ip, parse_ip_text
from ..operators import detectors, flows, folds, naming, owners, rates, series, signatures

KEYS = ["a", "pa", "b", "pb", "proto", "session"]


def dns_messages(packets: DataFrame) -> DataFrame:
    """Responses from port 53 with a question: ``ts_usec, pkt_no, m``."""
    asked = packets.where("decode_status = 'Ok' and has_l4 and sport = 53 and payload_len > 0 and proto in (6, 17)")
    return asked.select("ts_usec", "pkt_no", dns_message(F.col("payload"), F.col("proto")).alias("m")).where("m.response and m.question <> ''")


def dns_answers(messages: DataFrame) -> DataFrame:
    """``addr, name, ts_usec, pkt_no``: the name asked for, for each address answered."""
    rows = messages.select("ts_usec", "pkt_no", F.col("m.question").alias("name"), F.explode("m.answers").alias("r")).where("r.addr is not null")
    return rows.select(F.regexp_replace("r.addr", r"^::ffff:(\d+\.\d+\.\d+\.\d+)$", "$1").alias("addr"), "name", "ts_usec", "pkt_no")


@dataclass
class Analysis:
    """All results; ``last`` is the last packet's time, so the closing tick is the second after it."""

    packets: DataFrame
    annotated: DataFrame
    folded: DataFrame
    flows: DataFrame
    seconds: DataFrame
    service_seconds: DataFrame
    lookups: DataFrame
    alerts: DataFrame
    last: int
    first: int
    owned: bool = False

    @property
    def tick(self) -> int:
        return self.last // 1_000_000 + 1


def analyse(packets: DataFrame, cfg: EngineConfig = EngineConfig(), rules: list[dict] | None = None, recorded: DataFrame | None = None, write_to: str | None = None, want_alerts: bool = True) -> Analysis:
    """Everything about decoded ``packets``; ``recorded`` are owners, ``write_to`` is a folder for the tables.

    Alerts need passes of their own over the packets before any view is computed; without ``want_alerts`` there are none.
    """
    spark = packets.sparkSession
    if write_to:
        flows.add_keys(packets, cfg).write.mode("overwrite").parquet(f"{write_to}/packets")
        packets = spark.read.parquet(f"{write_to}/packets")
    messages = dns_messages(packets)
    answers = dns_answers(messages)
    folded = flows.fold_flows(packets, answers, cfg, rules)
    if write_to:
        folded.write.mode("overwrite").parquet(f"{write_to}/flows")
        folded = spark.read.parquet(f"{write_to}/flows")
    span = packets.agg(F.min("ts_usec").alias("first"), F.max("ts_usec").alias("last")).first()
    first, last = span.first or 0, span.last or 0

    of_flow = folded.where("event = 'packet'")
    local = tuple(x for x in map(parse_ip_text, cfg.local) if x is not None)
    rest = packets.where("decode_status <> 'Ok' or fragment")
    src, dst = parse_ip(F.col("src")), parse_ip(F.col("dst"))
    out = F.coalesce((F.col("decode_status") == "Ok") & is_local(src, local) & ~is_local(dst, local), F.lit(False))
    annotated = of_flow.select("ts_usec", "pkt_no", "wire_len", "outbound", "service").unionByName(rest.select("ts_usec", "pkt_no", "wire_len", out.alias("outbound"), F.lit("Other").alias("service")))
    seconds = series.gap_fill(series.per_second(annotated))

    table = flows.flow_totals(folded).withColumn("flow_id", F.xxhash64(*KEYS))
    if recorded is not None:
        who = owners.exact_owner(table.where("not transit and proto in (6, 17)").select("flow_id", F.when(F.col("proto") == 6, "tcp").otherwise("udp").alias("proto"), "local_addr", "local_port", "remote_addr", "remote_port"), recorded).select("flow_id", "app")
        table = table.join(who, "flow_id", "left").withColumn("app", F.coalesce("app", F.lit("")))
    else:
        table = table.withColumn("app", F.lit(""))

    lookups = naming.dedupe_lookups(messages.select("ts_usec", "pkt_no", F.col("m.question").alias("name"), F.col("m.qtype").alias("qtype"), F.col("m.rcode").alias("rcode")))
    alerts = _alerts(packets, of_flow, table, seconds, cfg, rules) if want_alerts else None
    if write_to and want_alerts:
        alerts.write.mode("overwrite").parquet(f"{write_to}/alerts")
        alerts = spark.read.schema(alerts.schema).parquet(f"{write_to}/alerts")
    return Analysis(packets, annotated, folded, table, seconds, series.service_second(annotated), lookups, alerts, last, first, recorded is not None)


def _alerts(packets: DataFrame, of_flow: DataFrame, table: DataFrame, seconds: DataFrame, cfg: EngineConfig, rules: list[dict] | None) -> DataFrame:
    """Alerts of all detectors; the clock is followed through the packets at once."""
    d = cfg.detectors
    known = ["pkt_no", "ts_usec", "decode_status", "has_l4", "tcp_flags", "proto", "src", "dst", "dport"]
    clock = folds.clock_epochs(packets.select(*known), if_any=True)  # where the clock restarts, the two detectors of SYNs begin anew
    by = () if clock is None else ("epoch",)
    tries = (packets if clock is None else clock).where((F.col("decode_status") == "Ok") & F.col("has_l4") & is_attempt(F.col("tcp_flags"), F.col("proto"))).select("ts_usec", "src", "dst", "dport", *by)
    server = F.when(F.col("client_is_a"), F.struct(F.col("b").alias("dst"), F.col("pb").alias("dport"))).otherwise(F.struct(F.col("a").alias("dst"), F.col("pa").alias("dport")))
    done = of_flow.where("completed").select("ts_usec", "pkt_no", server.alias("s"))
    done = (done if clock is None else done.join(clock.select("pkt_no", "epoch"), "pkt_no")).select("ts_usec", "s.dst", "s.dport", *by)
    found = [detectors.scan_alerts(detectors.port_scans(tries, d, by)), detectors.flood_alerts(detectors.syn_floods(tries, done, d, by))]
    for value, direction in (("bytes_in", "Inbound"), ("bytes_out", "Outbound")):
        found.append(detectors.spike_alerts(detectors.spikes(seconds, value, d), direction, d.spike_seconds))
    if rules:
        ends = F.when(F.col("from_a"), F.struct(F.col("a").alias("src"), F.col("pa").alias("sport"), F.col("b").alias("dst"), F.col("pb").alias("dport"))).otherwise(
            F.struct(F.col("b").alias("src"), F.col("pb").alias("sport"), F.col("a").alias("dst"), F.col("pa").alias("dport"))
        )
        remote = F.when(F.col("local_is_a"), F.col("b")).otherwise(F.col("a"))
        hits = of_flow.where(F.size("rules") > 0).select("ts_usec", "pkt_no", F.explode("rules").alias("rule_id"), ends.alias("e"), F.when(F.col("host") != remote, F.col("host")).otherwise("").alias("host"), *KEYS)
        hits = hits.join(table.select(*KEYS, "app"), KEYS, "left").select("ts_usec", "pkt_no", "rule_id", "e.*", "host", "app")
        found.append(signatures.signature_alerts(hits, signatures.rules_table(packets.sparkSession, rules), d.cooldown))
    return detectors.alert_union(*found)


# Views


def live_flows(a: Analysis) -> DataFrame:
    """Flows with rates, display host and totals at the closing tick."""
    r = rates.rates_at(rates.flow_seconds(a.folded.where("event = 'packet'"), KEYS), KEYS, a.tick)
    shown = F.when(F.coalesce("host", F.lit("")) != "", F.col("host")).otherwise(F.col("remote_addr"))
    return a.flows.join(r, KEYS, "left").select(
        "*", F.coalesce("rate_bytes_in", F.lit(0.0)).alias("rate_in"), F.coalesce("rate_bytes_out", F.lit(0.0)).alias("rate_out"), shown.alias("shown"), F.col("bytes_in").alias("total_in"), F.col("bytes_out").alias("total_out")
    ).drop("rate_bytes_in", "rate_bytes_out")


def view_header(a: Analysis) -> DataFrame:
    """One row: rates of the last closed second, active flows, totals. Files lose nothing: drops are 0."""
    final = a.seconds.agg(F.max_by(F.struct("bytes_in", "bytes_out", "packets"), "sec").alias("s"))
    totals = series.counters(a.packets).select(F.col("packets").alias("total_packets"), F.col("bytes").alias("total_bytes"), "not_ip", "malformed")
    active = rates.active_flows(a.flows, a.tick)
    one = final.crossJoin(totals).crossJoin(active)  # one row each
    return one.select(F.col("s.bytes_in").alias("rate_in"), F.col("s.bytes_out").alias("rate_out"), F.col("s.packets").alias("packets_per_second"), F.col("active").alias("active_flows"), F.col("tracked").alias("tracked_flows"), "total_packets", "total_bytes", "not_ip", "malformed", F.lit(0).alias("kernel_drops"), F.lit(0).alias("ring_drops"))


def view_throughput(a: Analysis, columns: int = 900) -> DataFrame:
    """The last seconds with the peak of each direction among them."""
    from pyspark.sql import Window as W

    shown = series.recent(a.seconds, columns)
    every = W.partitionBy(F.lit(1))
    return shown.select("sec", "bytes_in", "bytes_out", "packets", F.max("bytes_in").over(every).alias("peak_in"), F.max("bytes_out").over(every).alias("peak_out"))


def view_connections(a: Analysis, keep: int = 200) -> DataFrame:
    from ..functions.formats import endpoint

    top = rates.top_connections(live_flows(a), a.tick, keep)
    active = F.lit(a.tick * 1_000_000) - F.col("last_usec") < 5_000_000
    return top.select("app", F.col("shown").alias("host"), endpoint(F.col("remote_addr"), F.col("remote_port")).alias("remote"), "service", "rate_in", "rate_out", "total_in", "total_out", "first_usec", "last_usec", active.alias("active"))


def view_apps(a: Analysis, keep: int = 100) -> DataFrame:
    named = rates.top_groups(rates.grouped(live_flows(a), "app", "shown", a.tick), keep)
    return named.withColumn("name", F.when(F.col("name") == "", "Unknown").otherwise(F.col("name")))


def view_hosts(a: Analysis, keep: int = 200) -> DataFrame:
    """Rates and busiest application by host; bytes are credited to the name a flow had when they came.

    One pass over the folded flows: they are reduced to seconds, whose last row tells the name that
    the second's bytes go to, and seconds to names and flows at once.
    """
    own = F.col("event") == "packet"
    label = F.when(F.col("host") != "", F.col("host")).otherwise(F.when(F.col("local_is_a"), F.col("b")).otherwise(F.col("a")))
    way = lambda out: F.sum(F.when(F.col("outbound") == out, F.col("wire_len")).otherwise(0)).cast("bigint")
    at = F.struct("ts_usec", "pkt_no")
    seconds = a.folded.groupBy(*KEYS, (series.second(F.col("ts_usec")) + F.when(own, 1).otherwise(0)).alias("tick")).agg(
        way(False).alias("bytes_in"), way(True).alias("bytes_out"), F.max(F.when(own, F.col("ts_usec"))).alias("last_usec"), F.max(F.struct(at.alias("at"), label.alias("label"), "service", "local_is_a")).alias("l")
    )
    of_flow = F.col("kind") == 1  # each second counts for its name (0) and for its flow (1)
    sec = F.col("tick") - 1
    recent = F.when(of_flow & F.col("last_usec").isNotNull() & rates.is_recent(sec, a.tick), F.struct(sec.alias("sec"), "bytes_in", "bytes_out"))
    rows = seconds.withColumn("kind", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "kind", *[F.when(of_flow, F.col(c)).alias(c) for c in (*KEYS, "last_usec", "l")], F.when(~of_flow, F.col("l.label")).alias("credited"), "bytes_in", "bytes_out", recent.alias("slot")
    )
    both = rows.groupBy("kind", *KEYS, "credited").agg(F.sum("bytes_in").alias("bytes_in"), F.sum("bytes_out").alias("bytes_out"), F.max("last_usec").alias("last_usec"), F.max("l").alias("l"), F.collect_list("slot").alias("slots"))
    flow = lambda c: F.when(of_flow, c)
    both = both.select(
        "kind", *KEYS, "last_usec", F.coalesce("credited", "l.label").alias("shown"), F.col("l.service").alias("service"), flow(F.xxhash64(*KEYS)).alias("flow_id"),
        *[flow(F.coalesce(rates.slot_rate(F.col("slots"), f"bytes_{d}", a.tick), F.lit(0.0))).alias(f"rate_{d}") for d in ("in", "out")],
        *[flow(F.col(f"bytes_{d}")).alias(f"total_{d}") for d in ("in", "out")], *[F.when(~of_flow, F.col(f"bytes_{d}")).alias(f"credit_{d}") for d in ("in", "out")],
    )
    both = both.join(a.flows.select(*KEYS, "app"), KEYS, "left") if a.owned else both.withColumn("app", flow(F.lit("")))
    named = rates.all_groups(both, "shown", "app", a.tick, *[F.sum(c).cast("bigint").alias(c) for c in ("credit_in", "credit_out")])
    now = F.coalesce(F.col("total_in") + F.col("total_out"), F.lit(0)) > 0
    known = lambda c, none: F.when(now, F.col(c)).otherwise(none).alias(c)
    full = named.select("name", known("detail", None), known("service", ""), known("flows", 0), known("rate_in", 0.0), known("rate_out", 0.0), F.col("credit_in").alias("total_in"), F.col("credit_out").alias("total_out"))
    return rates.top_groups(full.where("total_in + total_out > 0"), keep)


def view_services(a: Analysis) -> DataFrame:
    from ..functions.formats import percent

    share = series.service_share(a.service_seconds, 60, a.tick - 1)
    return share.select("service", "bytes", percent(F.col("share")).alias("percent")).orderBy(F.col("bytes").desc(), "service")


def view_lookups(a: Analysis, keep: int = 50) -> DataFrame:
    from ..decode.dns import dns_type_name

    newest = a.lookups.orderBy(F.col("ts_usec").desc(), "name").limit(keep)
    return newest.select("ts_usec", "name", dns_type_name(F.col("qtype")).alias("type"), F.when(F.col("failed"), "(not found)").otherwise("").alias("note"))


def view_alerts(a: Analysis, keep: int = 100) -> DataFrame:
    return a.alerts.orderBy(F.col("ts_usec").desc(), "kind", "message").limit(keep)


def summary(a: Analysis) -> DataFrame:
    """``packets, bytes, alerts``."""
    return series.counters(a.packets).select("packets", "bytes").crossJoin(a.alerts.agg(F.count("*").alias("alerts")))


def bench_summary(a: Analysis, seconds: float) -> DataFrame:
    """``packets_per_second, wire_gbps, captured_gbps`` of a run that took so long."""
    t = a.packets.agg(F.count("*").alias("n"), F.sum("wire_len").alias("w"), F.sum("cap_len").alias("c"))
    return t.select((F.col("n") / seconds).alias("packets_per_second"), (F.col("w") * 8 / seconds / 1e9).alias("wire_gbps"), (F.col("c") * 8 / seconds / 1e9).alias("captured_gbps"))


VIEWS = {
    "header": view_header, "throughput": view_throughput, "connections": view_connections, "apps": view_apps, "hosts": view_hosts,
    "services": view_services, "lookups": view_lookups, "alerts": view_alerts, "summary": summary,
}
