"""Rates and totals by flow, application and host at a tick."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .folds import ewma
from .series import second

#: A rate of any size is under 1, that is 0, after so many silent ticks.
FADES = 64


def flow_seconds(folded: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, sec, bytes_in, bytes_out`` of each flow and second with packets."""
    return folded.groupBy(*keys, second(F.col("ts_usec")).alias("sec")).agg(
        F.sum(F.when(F.col("outbound"), 0).otherwise(F.col("wire_len"))).cast("bigint").alias("bytes_in"), F.sum(F.when(F.col("outbound"), F.col("wire_len")).otherwise(0)).cast("bigint").alias("bytes_out")
    )


def rates_at(seconds: DataFrame, keys: list[str], tick: int, values: tuple[str, ...] = ("bytes_in", "bytes_out")) -> DataFrame:
    """``keys`` and ``rate_<value>`` at ``tick`` for each of ``values``.

    Only the last seconds matter: a rate halves at each tick and is 0 under 1, so what is older
    than ``FADES`` seconds would have to exceed 2**64 bytes to show. A flow's array is that short.
    """
    recent = seconds.where(is_recent(F.col("sec"), tick))
    slots = recent.groupBy(*keys).agg(F.collect_list(F.struct("sec", *values)).alias("__slots"))
    return slots.select(*keys, *[slot_rate(F.col("__slots"), v, tick).alias(f"rate_{v}") for v in values])


def is_recent(sec: Column, tick: int) -> Column:
    """Whether a second may still show in a rate at ``tick``."""
    return (sec < tick) & (sec >= tick - FADES)


def slot_rate(slots: Column, value: str, tick: int) -> Column:
    """The rate of ``value`` at ``tick`` from an array of a flow's recent seconds (``sec`` and values, in any order); null if it is empty."""
    of = F.map_from_entries(F.transform(slots, lambda s: F.struct(s["sec"], s[value])))
    axis = F.sequence(F.array_min(F.transform(slots, lambda s: s["sec"])), F.lit(tick - 1).cast("bigint"))
    return ewma(F.transform(axis, lambda s: F.coalesce(F.try_element_at(of, s), F.lit(0))))


def grouped(flows: DataFrame, name: str, detail: str, tick: int) -> DataFrame:
    """``name, detail, service, flows, rate_in, rate_out, total_in, total_out`` at a tick.

    ``flows``: a row for each flow with ``name, detail, service, last_usec, rate_in, rate_out,
    total_in, total_out, flow_id``. Only flows of the last minute count and add to rates; the
    busiest of them gives detail and service, of equally busy ones the one with the least id.
    """
    return all_groups(flows, name, detail, tick).where("total_in + total_out > 0")


def all_groups(flows: DataFrame, name: str, detail: str, tick: int, *more: Column) -> DataFrame:
    """``grouped`` with groups that have no bytes, and ``more`` aggregates behind; rows without ``last_usec`` only count there and in totals."""
    active = F.lit(tick * 1_000_000) - F.col("last_usec") < 60_000_000
    busiest = F.max_by(F.struct(F.col(detail).alias("d"), F.col("service").alias("s")), F.when(active, F.struct(F.col("rate_in") + F.col("rate_out"), -F.col("flow_id"))))
    total = flows.groupBy(F.coalesce(name, F.lit("")).alias("name")).agg(
        busiest.alias("b"), F.count_if(active).alias("flows"), F.coalesce(F.sum(F.when(active, F.col("rate_in"))), F.lit(0.0)).alias("rate_in"),
        F.coalesce(F.sum(F.when(active, F.col("rate_out"))), F.lit(0.0)).alias("rate_out"), F.sum("total_in").cast("bigint").alias("total_in"), F.sum("total_out").cast("bigint").alias("total_out"), *more,
    )
    own = ("name", "b", "flows", "rate_in", "rate_out", "total_in", "total_out")
    return total.select("name", F.col("b.d").alias("detail"), F.when(F.col("flows") > 0, F.col("b.s")).otherwise("").alias("service"), *own[2:], *[c for c in total.columns if c not in own])


def credited_totals(named_seconds: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """``name, total_in, total_out``: a second's bytes go to the name the flow had at the tick that closed it.

    ``named_seconds``: flow seconds; ``names``: ``keys, tick, name`` from when on a flow has a name.
    The names are carried forward over the flow's seconds in one sorted pass.
    """
    from pyspark.sql import Window as W

    at = named_seconds.select(*keys, (F.col("sec") + 1).alias("tick"), F.lit(None).cast("string").alias("n"), F.lit(1).alias("k"), "bytes_in", "bytes_out")
    told = names.select(*keys, "tick", F.col("name").alias("n"), F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("bytes_in"), F.lit(0).cast("bigint").alias("bytes_out"))
    w = W.partitionBy(*keys).orderBy("tick", "k").rowsBetween(W.unboundedPreceding, 0)
    carried = at.unionByName(told).withColumn("name", F.last("n", ignorenulls=True).over(w)).where("k = 1")
    return carried.groupBy(F.coalesce("name", F.lit("")).alias("name")).agg(F.sum("bytes_in").cast("bigint").alias("total_in"), F.sum("bytes_out").cast("bigint").alias("total_out"))


def active_flows(flows: DataFrame, tick: int) -> DataFrame:
    """``active, tracked``: flows of the last five seconds, and all."""
    return flows.agg(F.count_if(F.lit(tick * 1_000_000) - F.col("last_usec") < 5_000_000).alias("active"), F.count("*").alias("tracked"))


def top_connections(flows: DataFrame, tick: int, keep: int = 200, last: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """The busiest flows of the last minute: rates first, then the latest packet, then ``last``."""
    return flows.where(F.lit(tick * 1_000_000) - F.col("last_usec") < 60_000_000).orderBy((F.col("rate_in") + F.col("rate_out")).desc(), F.col("last_usec").desc(), *last).limit(keep)


def top_groups(groups: DataFrame, keep: int) -> DataFrame:
    """The busiest groups: rates first, then totals, then the name."""
    return groups.orderBy((F.col("rate_in") + F.col("rate_out")).desc(), (F.col("total_in") + F.col("total_out")).desc(), "name").limit(keep)
