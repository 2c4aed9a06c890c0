"""Schemas of the tables that operators take and give."""

RAW_PACKETS = "pkt_no bigint, ts_usec bigint, link_type int, cap_len bigint, wire_len bigint, data binary"

#: Addresses are canonical text for keys and output; what is unset is null.
DECODED = (
    "decode_status string, ip_version int, src string, dst string, proto int, fragment boolean, has_l4 boolean, sport int, dport int, "
    "tcp_flags int, seq bigint, ack bigint, icmp_type int, icmp_code int, payload binary, payload_len bigint, payload_total bigint"
)
PACKETS = f"pkt_no bigint, ts_usec bigint, wire_len bigint, cap_len bigint, {DECODED}"
ALERTS = "ts_usec bigint, kind string, severity string, title string, message string, src string, dst string"
SIGNATURES = "rule_id int, severity string, name string, content binary, nocase boolean, message string"
OWNERS = "proto string, local_addr string, local_port int, remote_addr string, remote_port int, app string"
SOCKETS = "entry_id bigint, proto string, local_addr string, local_port int, remote_addr string, remote_port int, pid bigint, app string"
DNS_MESSAGE = (
    "id int, response boolean, rcode int, question string, qtype int, "
    "answers array<struct<name:string,type:int,ttl:bigint,addr:string,target:string>>"
)
