"""Service labels from protocol and server port."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TCP, UDP, ICMP, ICMPV6 = 6, 17, 1, 58

PORTS = {
    TCP: {
        "TLS": (443, 8443, 853), "HTTP": (80, 8080, 8000), "DNS": (53,), "SSH": (22,), "Push": (5223, 5228),
        "Mail": (25, 465, 587, 143, 993, 110, 995), "SMB": (445, 139), "VPN": (1194,),
    },
    UDP: {
        "QUIC": (443,), "DNS": (53,), "mDNS": (5353,), "NTP": (123,), "DHCP": (67, 68, 546, 547), "SSDP": (1900,),
        "STUN": (3478, 3479, 19302, 19305), "VPN": (51820, 500, 4500, 1194),
    },
}
LABELS = ("TLS", "QUIC", "HTTP", "DNS", "mDNS", "SSH", "Push", "Mail", "SMB", "NTP", "DHCP", "SSDP", "STUN", "VPN", "ICMP", "TCP", "UDP", "Other")


def label_of(proto: int, port: int) -> str:
    """The label of a flow to ``port``."""
    for label, ports in PORTS.get(proto, {}).items():
        if port in ports:
            return label
    return {TCP: "TCP", UDP: "UDP", ICMP: "ICMP", ICMPV6: "ICMP"}.get(proto, "Other")


def is_service(proto: int, port: int) -> bool:
    return port != 0 and (port < 1024 or label_of(proto, port) not in ("TCP", "UDP"))


def classify_port(proto: Column, port: Column) -> Column:
    def of(table: dict, default: str) -> Column:
        out = F.lit(default)
        for label, ports in reversed(table.items()):
            out = F.when(port.isin(*ports), label).otherwise(out)
        return out

    return (
        F.when(proto == TCP, of(PORTS[TCP], "TCP")).when(proto == UDP, of(PORTS[UDP], "UDP"))
        .when(proto.isin(ICMP, ICMPV6), "ICMP").otherwise("Other")
    )


def is_service_port(proto: Column, port: Column) -> Column:
    return (port != 0) & ((port < 1024) | ~classify_port(proto, port).isin("TCP", "UDP"))
