"""Counters, per-second series, protocol shares.

Packets here have ``ts_usec, wire_len, decode_status`` and, where a direction counts, a boolean
``outbound``; undecodable packets are inbound and of service Other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Seconds of silence that are still given samples.
LONGEST_SILENCE = 900


def second(ts: Column) -> Column:
    """The whole second a time is in."""
    return F.floor(ts / F.lit(SECOND)).cast("bigint")


def counters(packets: DataFrame) -> DataFrame:
    """``packets, bytes, not_ip, malformed`` over everything captured."""
    return packets.agg(
        F.count("*").alias("packets"), F.coalesce(F.sum("wire_len"), F.lit(0)).cast("bigint").alias("bytes"),
        F.count_if(F.col("decode_status") == "NotIp").alias("not_ip"), F.count_if(F.col("decode_status") == "Malformed").alias("malformed"),
    )


def is_outbound(status: Column, fragment: Column, src_local: Column, dst_local: Column, flow_out: Column) -> Column:
    """Undecodable: in. A fragment: out if only its source is local. Else what its flow says."""
    return F.when(status != "Ok", F.lit(False)).when(fragment, src_local & ~dst_local).otherwise(flow_out)


def per_second(packets: DataFrame) -> DataFrame:
    """``sec, bytes_in, bytes_out, packets``; only seconds with packets."""
    out = F.col("outbound")
    return packets.groupBy(second(F.col("ts_usec")).alias("sec")).agg(
        F.sum(F.when(out, 0).otherwise(F.col("wire_len"))).cast("bigint").alias("bytes_in"),
        F.sum(F.when(out, F.col("wire_len")).otherwise(0)).cast("bigint").alias("bytes_out"), F.count("*").alias("packets"),
    )


def gap_fill(seconds: DataFrame, values: tuple[str, ...] = ("bytes_in", "bytes_out", "packets"), by: str = "sec") -> DataFrame:
    """A row for every second from the first to the last, zeros included.

    A silence of more than 900 seconds gets the first 900 and the last of its samples. Each second
    tells the next one that has packets, so no axis is built apart and joined: the zeros are made
    where the gap is. There is a row for each second of the capture at most (86,400 a day).
    """
    following = F.lead(by).over(W.orderBy(by))
    n = F.coalesce(F.col("__next") - F.col(by), F.lit(1))
    # n - 1 ticks follow the one that closes this second; after 900 in a row the clock jumps
    steps = F.when(n <= LONGEST_SILENCE, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(
        F.array_append(F.sequence(F.lit(0).cast("bigint"), F.lit(LONGEST_SILENCE - 1).cast("bigint")), n - 1)
    )
    filled = seconds.withColumn("__next", following).select("*", F.explode(steps).alias("__k"))
    return filled.select((F.col(by) + F.col("__k")).alias(by), *[F.when(F.col("__k") == 0, F.col(v)).otherwise(F.lit(0)).cast("bigint").alias(v) for v in values])


def service_second(packets: DataFrame) -> DataFrame:
    """``sec, service, bytes``; ``service`` is the flow's label after the packet, null for Other."""
    return packets.groupBy(second(F.col("ts_usec")).alias("sec"), F.coalesce("service", F.lit("Other")).alias("service")).agg(F.sum("wire_len").cast("bigint").alias("bytes"))


def service_share(by_second: DataFrame, window: int = 60, at: int | None = None) -> DataFrame:
    """``service, bytes, share`` over the last ``window`` seconds up to ``at`` (the last second)."""
    last = F.lit(at) if at is not None else F.col("__last")
    if at is None:
        by_second = by_second.crossJoin(F.broadcast(by_second.agg(F.max("sec").alias("__last"))))  # one row
    total = by_second.where((F.col("sec") > last - window) & (F.col("sec") <= last)).groupBy("service").agg(F.sum("bytes").cast("bigint").alias("bytes")).where("bytes > 0")
    return total.withColumn("share", F.round(F.col("bytes") / F.sum("bytes").over(W.partitionBy(F.lit(1))), 6))  # 18 rows at most


def trailing_sum(series: DataFrame, value: str, rows: int, by: str = "sec") -> DataFrame:
    """The sum over the last ``rows`` samples, this one included."""
    return series.withColumn(f"{value}_{rows}", F.sum(value).over(W.orderBy(by).rowsBetween(-(rows - 1), 0)).cast("bigint"))


def recent(series: DataFrame, keep: int = 900, by: str = "sec") -> DataFrame:
    """The newest ``keep`` samples."""
    return series.orderBy(F.col(by).desc()).limit(keep)
