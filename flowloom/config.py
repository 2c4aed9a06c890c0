"""Settings of the engine, with the defaults its alerts are defined by."""

from __future__ import annotations

from dataclasses import dataclass, field

US = 1_000_000


@dataclass(frozen=True)
class DetectorConfig:
    """Thresholds; the lower bounds are those of the command line."""

    scan_ports: int = 20
    scan_window: int = 10
    flood_rate: float = 100.0
    flood_window: int = 5
    flood_completed: float = 0.2
    spike_history: int = 300
    spike_warmup: int = 60
    spike_sigma: float = 4.0
    spike_min_bytes: float = 1e6
    spike_seconds: int = 3
    spike_cooldown: int = 300
    cooldown: int = 60

    def __post_init__(self):
        if self.scan_ports < 2 or self.flood_rate < 1 or self.spike_sigma < 1:
            raise ValueError("scan_ports is at least 2, flood_rate and spike_sigma at least 1")


@dataclass(frozen=True)
class EngineConfig:
    """``local`` lists this machine's addresses; empty means any private address is local."""

    local: tuple[str, ...] = ()
    link_type: int = 1
    snap_len: int = 65535
    max_flows: int | None = None
    detectors: DetectorConfig = field(default_factory=DetectorConfig)

    def __post_init__(self):
        if self.snap_len < 64:
            raise ValueError("snap_len is at least 64")
