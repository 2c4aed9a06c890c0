"""Streaming twins of the detectors, as Structured Streaming state.

Keys carry their own clock: a tick is handled when a later packet or the watermark shows that its
second is over. State is dropped when its window is empty, so no bound on the number of keys has to
throw any away; what is behind the watermark is late and is left out by Spark.

The state machines are plain Python, so batch, streaming and tests share them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import DetectorConfig

_US = 1_000_000
NEVER = -(1 << 60)


def scan_steps(ports: dict[int, int], last_alert: int, from_tick: int, to_tick: int, cfg: DetectorConfig):
    """Ticks ``from_tick`` to ``to_tick`` of one pair: (alerts, last alert). ``ports`` loses what is too old.

    Silent ticks are not walked through: nothing happens once the window is empty.
    """
    out = []
    for tick in range(from_tick, min(to_tick, max(ports.values(), default=0) // _US + cfg.scan_window + 1) + 1):
        old = (tick - cfg.scan_window) * _US
        for p in [p for p, ts in ports.items() if ts < old]:
            del ports[p]
        if not ports:
            return out, NEVER
        if len(ports) >= cfg.scan_ports and tick - last_alert >= cfg.cooldown:
            last_alert = tick
            out.append((tick, len(ports), min(ports.values()), max(ports.values())))
    return out, last_alert


def flood_steps(seconds: dict[int, list[int]], last_alert: int, from_tick: int, to_tick: int, cfg: DetectorConfig):
    """The same for one target; ``seconds`` are attempts and completions."""
    out = []
    for tick in range(from_tick, min(to_tick, max(seconds, default=0) + cfg.flood_window + 1) + 1):
        for s in [s for s in seconds if s < tick - cfg.flood_window]:
            del seconds[s]
        if not seconds:
            return out, NEVER
        tried, done = (sum(v[k] for s, v in seconds.items() if s < tick) for k in (0, 1))
        if tried / cfg.flood_window >= cfg.flood_rate and done < cfg.flood_completed * tried and tick - last_alert >= cfg.cooldown:
            last_alert = tick
            out.append((tick, tried, done, max(seconds) - min(seconds) + 1))
    return out, last_alert


def _watermarked(df: DataFrame, delay: str) -> DataFrame:
    return df.withColumn("event_time", F.timestamp_micros("ts_usec")).withWatermark("event_time", delay)


def port_scans(attempts: DataFrame, cfg: DetectorConfig = DetectorConfig(), delay: str = "1 second") -> DataFrame:
    """``src, dst, tick, n_ports, first_ts, last_ts`` of each alert of a stream ``ts_usec, src, dst, dport``."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ports, last_alert, tick = ({}, NEVER, 0)
        if state.exists:
            held, times, last_alert, tick = state.get
            ports = dict(zip(held, times, strict=True))
        out = []

        def upto(t: int):
            nonlocal last_alert, tick
            got, last_alert = scan_steps(ports, last_alert, tick, t, cfg)
            out.extend(got)
            tick = max(tick, t + 1)

        if state.hasTimedOut:
            upto(state.getCurrentWatermarkMs() // 1000)
        else:
            rows = pd.concat(list(batches)).sort_values("ts_usec", kind="stable")
            for ts, port in zip(rows["ts_usec"].tolist(), rows["dport"].tolist(), strict=True):
                if not ports:
                    tick, last_alert = ts // _US + 1, NEVER
                elif ts // _US >= tick:
                    upto(ts // _US)
                    if not ports:
                        tick, last_alert = ts // _US + 1, NEVER
                ports[port] = ts
        if ports:
            state.update((list(ports), list(ports.values()), last_alert, tick))
            state.setTimeoutTimestamp(max(tick * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *o) for o in out], columns=["src", "dst", "tick", "n_ports", "first_ts", "last_ts"])

    return _watermarked(attempts, delay).groupBy("src", "dst").applyInPandasWithState(
        step, "src string, dst string, tick long, n_ports long, first_ts long, last_ts long", "ports array<int>, times array<long>, last_alert long, tick long", "append", GroupStateTimeout.EventTimeTimeout
    )


def syn_floods(tries: DataFrame, cfg: DetectorConfig = DetectorConfig(), delay: str = "1 second") -> DataFrame:
    """``dst, dport, tick, attempts, completed, busy`` of a stream ``ts_usec, dst, dport, completed boolean``."""

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, last_alert, tick = {}, NEVER, 0
        if state.exists:
            secs, tried, done, last_alert, tick = state.get
            seconds = {s: [a, d] for s, a, d in zip(secs, tried, done, strict=True)}
        out = []

        def upto(t: int):
            nonlocal last_alert, tick
            got, last_alert = flood_steps(seconds, last_alert, tick, t, cfg)
            out.extend(got)
            tick = max(tick, t + 1)

        if state.hasTimedOut:
            upto(state.getCurrentWatermarkMs() // 1000)
        else:
            rows = pd.concat(list(batches)).sort_values("ts_usec", kind="stable")
            for ts, done in zip(rows["ts_usec"].tolist(), rows["completed"].tolist(), strict=True):
                sec = ts // _US
                if seconds and sec >= tick:
                    upto(sec)
                if not seconds:
                    tick, last_alert = sec + 1, NEVER
                newest = max(sec, max(seconds, default=sec))  # a late event goes to the newest second
                seconds.setdefault(newest, [0, 0])[1 if done else 0] += 1
        if seconds:
            state.update((list(seconds), [v[0] for v in seconds.values()], [v[1] for v in seconds.values()], last_alert, tick))
            state.setTimeoutTimestamp(max(tick * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(*key, *o) for o in out], columns=["dst", "dport", "tick", "attempts", "completed", "busy"])

    return _watermarked(tries, delay).groupBy("dst", "dport").applyInPandasWithState(
        step, "dst string, dport int, tick long, attempts long, completed long, busy long", "secs array<long>, tried array<long>, done array<long>, last_alert long, tick long", "append", GroupStateTimeout.EventTimeTimeout
    )


def cooldown(events: DataFrame, keys: list[str], gap_sec: int = 60, delay: str = "1 second") -> DataFrame:
    """``keys, ts_usec`` of the events that are emitted: ``gap_sec`` after the key's last emitted one."""
    gap = gap_sec * _US

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else NEVER
        out = []
        for ts in sorted(t for b in batches for t in b["ts_usec"].tolist()):
            if ts - last >= gap:
                last = ts
                out.append((*key, ts))
        state.update((last,))
        # an event may follow as long as it is not late, and then the memory must still be there
        state.setTimeoutTimestamp(max((last + gap) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=[*keys, "ts_usec"])

    types = ", ".join(f"{k} {events.schema[k].dataType.simpleString()}" for k in keys)
    return _watermarked(events, delay).groupBy(*keys).applyInPandasWithState(step, f"{types}, ts_usec long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def per_second(packets: DataFrame, delay: str = "1 second") -> DataFrame:
    """``sec, bytes_in, bytes_out, packets`` of closed seconds; silent ones are filled in by the reader."""
    out = F.col("outbound")
    return _watermarked(packets, delay).groupBy(F.window("event_time", "1 second").alias("w")).agg(
        F.sum(F.when(out, 0).otherwise(F.col("wire_len"))).cast("bigint").alias("bytes_in"), F.sum(F.when(out, F.col("wire_len")).otherwise(0)).cast("bigint").alias("bytes_out"), F.count("*").alias("packets")
    ).select(F.unix_seconds("w.start").alias("sec"), "bytes_in", "bytes_out", "packets")
