"""Which application has a connection.

Socket tables are dimensions whose size depends on machines, not on traffic; Spark broadcasts them
while they are under its threshold and shuffles them beyond it, so no hint is given here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANY = ("0.0.0.0", "::")


def exact_owner(flows: DataFrame, owners: DataFrame) -> DataFrame:
    """``flows`` with ``app``: the recorded connection, else the one recorded without a remote end.

    ``flows``: ``proto (tcp, udp), local_addr, local_port, remote_addr, remote_port``.
    """
    full = ["proto", "local_addr", "local_port", "remote_addr", "remote_port"]
    near = owners.where("remote_addr = '0.0.0.0' and remote_port = 0").select(*full[:3], F.col("app").alias("__bound"))
    return (
        flows.join(owners.select(*full, F.col("app").alias("__exact")), full, "left").join(near, full[:3], "left")
        .withColumn("app", F.coalesce("__exact", "__bound")).drop("__exact", "__bound")
    )


def scored_owner(flows: DataFrame, sockets: DataFrame, flow_id: str = "flow_id") -> DataFrame:
    """``flows`` with ``app`` of the best socket on its protocol and local port.

    A socket bound to another local address is none of it. A socket with this remote end scores 3,
    one bound to the local address 2, one bound to any 1; of equal ones the lowest ``entry_id`` wins.
    A socket connected elsewhere does not match.
    """
    s = sockets.select("proto", "local_port", F.col("local_addr").alias("__l"), F.col("remote_addr").alias("__r"), F.col("remote_port").alias("__rp"), F.col("app").alias("__app"), "entry_id")
    joined = flows.join(s, ["proto", "local_port"], "left")
    here, free = F.col("__l") == F.col("local_addr"), F.col("__l").isin(*ANY)
    idle = F.col("__r").isin(*ANY) & (F.col("__rp") == 0)
    score = F.when(~(here | free), None).when((F.col("__r") == F.col("remote_addr")) & (F.col("__rp") == F.col("remote_port")), 3).when(idle & here, 2).when(idle, 1)
    best = F.max_by("__app", F.when(score.isNotNull(), F.struct(score, -F.col("entry_id"))))
    own = joined.groupBy(flow_id).agg(best.alias("app"))
    return flows.join(own, flow_id, "left")


def local_only(packets: DataFrame, local: DataFrame, addr: str = "src") -> DataFrame:
    """Packets whose address is one of this machine's: a semi join with ``addr``."""
    return packets.join(local.select(F.col("addr").alias(addr)), addr, "left_semi")


def retried_owner(flows: DataFrame, sightings: DataFrame, tries: int = 6, flow_id: str = "flow_id") -> DataFrame:
    """``flows`` with ``app`` where owners only appear in time.

    An owner is asked for when a flow begins (``first_tick``) and at each tick after, ``tries`` times
    in all; the first answer stays. ``sightings``: ``proto, local_addr, local_port, remote_addr,
    remote_port, tick, app``, one that is seen stays seen; of one tick's the least name counts. With a
    fixed table the first answer is the only one, so ``exact_owner`` joins once.
    """
    full = ["proto", "local_addr", "local_port", "remote_addr", "remote_port"]
    asked = flows.select(flow_id, "first_tick", *full).join(sightings.select(*full, "tick", F.col("app").alias("__app")), full)
    at = F.greatest("tick", "first_tick")
    found = asked.where(at - F.col("first_tick") < tries).groupBy(flow_id).agg(F.min(F.struct(at.alias("at"), F.col("__app").alias("app"))).alias("__own"))
    return flows.join(found, flow_id, "left").withColumn("app", F.col("__own.app")).drop("__own")
