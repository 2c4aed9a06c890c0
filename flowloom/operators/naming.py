"""Names of hosts: as-of joins with DNS answers, priorities, lookups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranks of where a host name comes from; an equal or higher one replaces it.
DNS, HTTP, SNI = 2, 3, 4


#: Microseconds of a slot of time that names are carried forward in.
SLOT = 300_000_000


def asof_name(left: DataFrame, answers: DataFrame, addr: str = "addr", ts: str = "ts_usec", order: str = "pkt_no", keep: tuple[str, ...] = (), slot: int = SLOT) -> DataFrame:
    """``left`` with ``name``: the newest answer for its address so far, its own packet's included.

    Both sides are sorted together by address and time within slots of time and the last name is
    carried forward, so no range join is made and a busy address is not one task. A slot that begins
    without a name takes the one the address had before, from a table with a row for each address
    and slot. ``answers``: ``addr, ts, order, name``; of several at one place the largest name counts.
    """
    place = F.floor(F.col(ts) / F.lit(slot)).cast("bigint").alias("__slot")
    cols = [addr, ts, order, *keep]
    told = answers.groupBy(addr, ts, order).agg(F.max("name").alias("__name"))
    ask = left.select(*cols, F.lit(None).cast("string").alias("__name"), F.lit(1).alias("__asks"), place)
    give = told.select(addr, ts, order, *[F.lit(None).cast(left.schema[k].dataType).alias(k) for k in keep], "__name", F.lit(0).alias("__asks"), place)
    w = W.partitionBy(addr, "__slot").orderBy(ts, order, "__asks").rowsBetween(W.unboundedPreceding, 0)
    inside = ask.unionByName(give).withColumn("name", F.last("__name", ignorenulls=True).over(w)).where("__asks = 1").drop("__asks", "__name")
    ends = told.groupBy(addr, place).agg(F.max_by("__name", F.struct(ts, order)).alias("__end"))
    asked = left.select(addr, place).distinct().withColumn("__end", F.lit(None).cast("string"))
    slots = ends.unionByName(asked).groupBy(addr, "__slot").agg(F.max("__end").alias("__end"))
    before = slots.withColumn("__before", F.last("__end", ignorenulls=True).over(W.partitionBy(addr).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)))
    known = before.where("__before is not null").select(F.col(addr).alias("__addr"), F.col("__slot").alias("__of"), "__before")
    out = inside.join(known, (F.col(addr) == F.col("__addr")) & (F.col("__slot") == F.col("__of")), "left")
    return out.select(*cols, F.coalesce("name", "__before").alias("name"))


def late_name(flows: DataFrame, answers: DataFrame) -> DataFrame:
    """For flows without a name the first that a tick can give: ``flow_id, name, tick``.

    ``flows``: ``flow_id, addr, first_ts, last_tick``. An answer counts from the next whole second,
    and at the first such tick within the flow's life the newest answer is taken.
    """
    told = answers.withColumn("tick", F.floor(F.col("ts_usec") / 1_000_000).cast("bigint") + 1).groupBy("addr", "tick").agg(F.max_by("name", F.struct("ts_usec", "pkt_no")).alias("name"))
    first_tick = F.floor(F.col("first_ts") / 1_000_000).cast("bigint") + 1
    # the newest name at the flow's first tick, by the as-of join above
    ask = flows.select("flow_id", "addr", "last_tick", first_tick.alias("ts_usec"), F.lit(0).cast("bigint").alias("pkt_no"))
    before = asof_name(ask, told.select("addr", F.col("tick").alias("ts_usec"), F.lit(0).cast("bigint").alias("pkt_no"), "name"), keep=("flow_id", "last_tick"))
    # else the first answer after it: the same, carried backwards
    w = W.partitionBy("addr").orderBy(F.col("t").desc(), F.col("asks").desc()).rowsBetween(W.unboundedPreceding, 0)
    later = (
        ask.select("flow_id", "addr", "last_tick", F.col("ts_usec").alias("t"), F.lit(0).alias("asks"), F.lit(None).cast("struct<tick:bigint,name:string>").alias("n"))
        .unionByName(told.select(F.lit(None).cast(flows.schema["flow_id"].dataType).alias("flow_id"), "addr", F.lit(None).cast("bigint").alias("last_tick"), F.col("tick").alias("t"), F.lit(1).alias("asks"), F.struct(F.col("tick").alias("tick"), "name").alias("n")))
        .withColumn("n", F.last("n", ignorenulls=True).over(w)).where("asks = 0")
    )
    now = before.where("name is not null").select("flow_id", "name", F.col("ts_usec").alias("tick"))
    then = later.where("n.tick > t and n.tick <= last_tick").join(now.select("flow_id"), "flow_id", "left_anti").select("flow_id", "n.name", "n.tick")
    return now.unionByName(then)


def best_name(names: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, host, host_source``: the highest source wins, of equal ones the latest; empty names never do.

    ``names``: ``keys, host, source, ts_usec, pkt_no``.
    """
    top = F.max_by(F.struct("host", "source"), F.struct("source", "ts_usec", "pkt_no"))
    return names.where("host <> ''").groupBy(*keys).agg(top.alias("t")).select(*keys, "t.host", F.col("t.source").alias("host_source"))


def dedupe_lookups(lookups: DataFrame, window_usec: int = 2_000_000, slot: int = 10_000_000) -> DataFrame:
    """``ts_usec, name, qtype, failed``: answers for the newest lookup's name within two seconds of it are one.

    Only the newest lookup can take an answer in, so an answer whose predecessor has another name or
    is two seconds older begins a chain, and chains are folded apart from each other. Predecessors
    are found in slots of time; what a slot's first rows need of earlier ones comes from a table with
    a row for each slot. ``lookups``: ``ts_usec, pkt_no, name, qtype, rcode``; empty names are left
    out. A merged answer without error clears ``failed``.
    """
    at = F.struct("ts_usec", "pkt_no")
    rows = lookups.where("name <> ''").withColumn("slot", F.floor(F.col("ts_usec") / F.lit(slot)).cast("bigint"))
    w = W.partitionBy("slot").orderBy("ts_usec", "pkt_no")
    one_a_slot = W.orderBy("slot")  # rows of slots, not of lookups
    ends = rows.groupBy("slot").agg(F.max_by(F.struct("name", "ts_usec"), at).alias("end"))
    known = rows.join(ends.select("slot", F.lag("end").over(one_a_slot).alias("before")), "slot")
    prior = F.coalesce(F.lag(F.struct("name", "ts_usec")).over(w), F.col("before"))
    begun = known.withColumn("prior", prior).withColumn("begins", F.col("prior").isNull() | (F.col("prior.name") != F.col("name")) | (F.col("ts_usec") - F.col("prior.ts_usec") >= window_usec))
    begun = begun.withColumn("chain", F.last(F.when(F.col("begins"), at), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    lasts = begun.groupBy("slot").agg(F.max("chain").alias("end"))
    carried = lasts.select("slot", F.last("end", ignorenulls=True).over(one_a_slot.rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    chains = begun.join(carried, "slot").select(F.coalesce("chain", "carried").alias("c"), "ts_usec", "pkt_no", "name", F.col("qtype").cast("int").alias("qtype"), "rcode")
    chains = chains.select(F.col("c.ts_usec").alias("c_ts"), F.col("c.pkt_no").alias("c_no"), "ts_usec", "pkt_no", "name", "qtype", "rcode")

    def fold(batches):
        chain, newest = None, None  # the newest lookup: ts, name, qtype, failed
        for b in batches:
            out = []
            for c_ts, c_no, ts, name, qtype, rcode in zip(*(b.column(k).to_pylist() for k in ("c_ts", "c_no", "ts_usec", "name", "qtype", "rcode")), strict=True):
                if newest is not None and (c_ts, c_no) == chain and ts - newest[0] < window_usec:
                    newest[3] = newest[3] and rcode != 0
                    continue
                if newest is not None:
                    out.append(newest)
                chain, newest = (c_ts, c_no), [ts, name, qtype, rcode == 3]
            yield _lookups(out)
        if newest is not None:
            yield _lookups([newest])

    return chains.repartition("c_ts", "c_no").sortWithinPartitions("c_ts", "c_no", "ts_usec", "pkt_no").mapInArrow(fold, "ts_usec long, name string, qtype int, failed boolean")


def _lookups(rows: list[list]) -> pa.RecordBatch:
    ts, name, qtype, failed = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(ts, pa.int64()), pa.array(name, pa.string()), pa.array(qtype, pa.int32()), pa.array(failed, pa.bool_())], ["ts_usec", "name", "qtype", "failed"])
