"""Packets projected from a table of events: the input of the registered queries.

The projection compresses the events' sparse clock to twenty packets a second. One template gives
the same text for Spark and for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEMPLATE = """
select event_id as pkt_no, v, cast(1790168400000000 + event_id * 50000 + (v % 7) * 1000 as bigint) as ts_usec,
  '10.0.0.' || cast(user_id % 4 + 1 as string) as src, '192.168.1.' || cast(user_id % 3 + 10 as string) as dst,
  cast(40000 + user_id as int) as sport, cast(1 + (event_id * 7 + user_id) % 64 as int) as dport,
  cast(case user_id % 3 when 0 then 80 when 1 then 443 else 22 end as int) as svc_port,
  cast(case event_type when 'error' then 2 when 'signup' then 18 when 'click' then 16 when 'purchase' then 24 else 17 end as int) as flags,
  cast(60 + v % 1440 as bigint) as wire_len,
  cast((60 + v % 1440) * case when (event_id {div} 200) % 23 = 11 then 2000 else 1 end as bigint) as burst_len,
  cast(case when user_id % 5 = 0 then 17 else 6 end as int) as proto,
  case when event_id % 50 = 7 then 'NotIp' when event_id % 50 = 13 then 'Malformed' else 'Ok' end as decode_status,
  event_id % 40 = 3 as fragment, event_id % 3 = 0 as reply, event_type, event_id, user_id
from (select *, cast(round(value * 100) as bigint) as v from {events}) e
"""


def projection_sql(dialect: str, events: str = "events") -> str:
    return _TEMPLATE.format(div="div" if dialect == "spark" else "//", events=events)


#: After every 80 seconds a silence of 20.
_HOLES = "ts_usec + (event_id {div} 1600) * 20000000"


def packets(spark: SparkSession, sf_dir: str, holes: bool = False) -> DataFrame:
    """The projection; ``holes`` puts 20 silent seconds behind every 80, so that idle state ages out."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = spark.sql(projection_sql("spark", "{events}"), events=events)
    return out.selectExpr(*[c if c != "ts_usec" else _HOLES.format(div="div") + " as ts_usec" for c in out.columns]) if holes else out


def oracle_cte(holes: bool = False) -> str:
    columns = f"* replace ({_HOLES.format(div='//')} as ts_usec)" if holes else "*"
    return f"with recursive p0 as (select {columns} from ({projection_sql('duckdb')}) q)"
