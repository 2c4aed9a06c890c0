"""Micro-batch sinks: alert logs, spikes over the growing series, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import DetectorConfig
from ..operators import detectors, series
from ..sources.text import alert_json_lines


def alert_log(path: str):
    """For ``foreachBatch``: alerts as JSON lines, a folder for each batch, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        alert_json_lines(batch).write.mode("overwrite").text(f"{path}/batch={batch_id}")

    return write


def series_table(path: str):
    """For ``foreachBatch`` of per-second rows: a Parquet table, a folder for each batch."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def spikes_of_table(spark: SparkSession, path: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """Spike alerts over the series a stream has written: 86,400 rows a day, so it is read as a whole."""
    seconds = series.gap_fill(spark.read.parquet(path).select("sec", "bytes_in", "bytes_out", "packets"))
    return detectors.alert_union(*[detectors.spike_alerts(detectors.spikes(seconds, v, cfg), d, cfg.spike_seconds) for v, d in (("bytes_in", "Inbound"), ("bytes_out", "Outbound"))])


def losses(progress: list) -> dict[str, int]:
    """What a stream has read and lost, from its progress reports: files lose nothing, late rows are left out by watermarks."""
    late = sum(s.numRowsDroppedByWatermark for p in progress for s in p.stateOperators)
    return {"packets": sum(p.numInputRows for p in progress), "kernel_drops": 0, "ring_drops": 0, "late": late}


def replay(spark: SparkSession, path: str, per_trigger: int = 1, snap_len: int = 65535, speed: float = 0) -> DataFrame:
    """Captures of a folder as a stream, so many files a trigger.

    ``speed`` times as fast as they were captured, by the files' first packets; 0 is flat out.
    """
    from ..sources.pcap import register

    register(spark)
    return spark.readStream.format("pcap").option("path", path).option("maxFilesPerTrigger", per_trigger).option("snaplen", snap_len).option("speed", speed).load()
