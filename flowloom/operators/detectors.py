"""Port scans, SYN floods and traffic spikes, and their alerts.

Detectors look at whole-second ticks, before the packets of the second that begins. A window of n
seconds at tick t is the seconds t-n to t-1, so an event of second s is seen at ticks s+1 to s+n.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DetectorConfig
from ..functions.formats import printed
from .folds import greedy, nth_of_run, trailing_medians
from .series import second

_US = 1_000_000


def latest_attempts(attempts: DataFrame, *more) -> DataFrame:
    """``src, dst, dport, last_ts``: the latest attempt on each port; by ``more`` too, if given."""
    return attempts.groupBy("src", "dst", "dport", *more).agg(F.max("ts_usec").alias("last_ts"))


def attempts_by_second(attempts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same in each second ``sec``."""
    return latest_attempts(attempts, *by, second(F.col("ts_usec")).alias("sec"))


def with_lives(rows: DataFrame, keys: list[str], window: int) -> DataFrame:
    """``life``: numbers the spans in which a key's state exists without a break.

    State, and with it the memory of the last alert, is dropped at the first tick that finds its
    window empty, so an event more than ``window`` seconds after the one before begins a new life.
    """
    w = W.partitionBy(*keys).orderBy("sec")
    new = F.coalesce((F.col("sec") - F.lag("sec").over(w) > window).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn("life", F.sum("__new").over(w)).drop("__new")


def scan_candidates(attempts: DataFrame, cfg: DetectorConfig = DetectorConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, life, tick, n_ports, first_ts, last_ts`` where enough distinct ports were tried in the window.

    ``attempts``: ``ts_usec, src, dst, dport``. Repeats in a second are combined before anything is
    expanded; a pair's ports of ten seconds are counted by (pair, tick, port), never collected. All
    seconds of one window are of one life. What ``by`` tells apart (restarts of the clock) shares no state.
    """
    keys = ["src", "dst", *by]
    ticks = F.explode(F.sequence(F.col("sec") + 1, F.col("sec") + cfg.scan_window)).alias("tick")
    living = with_lives(attempts_by_second(attempts, by), keys, cfg.scan_window)
    latest = living.select(*keys, "life", "dport", "last_ts", ticks).groupBy(*keys, "life", "tick", "dport").agg(F.max("last_ts").alias("last_ts"))
    return latest.groupBy(*keys, "life", "tick").agg(F.count("*").alias("n_ports"), F.min("last_ts").alias("first_ts"), F.max("last_ts").alias("last_ts")).where(F.col("n_ports") >= cfg.scan_ports)


def with_cooldown(candidates: DataFrame, keys: list[str], gap: int) -> DataFrame:
    """The candidates that become alerts: ``gap`` seconds after the last alert of the same life."""
    taken = candidates.groupBy(*keys, "life").agg(F.array_sort(F.collect_set("tick")).alias("t")).select(*keys, "life", F.explode(greedy(F.col("t"), gap)).alias("tick"))
    return candidates.join(taken, [*keys, "life", "tick"]).drop("life")


def port_scans(attempts: DataFrame, cfg: DetectorConfig = DetectorConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """``src, dst, tick, n_ports, first_ts, last_ts`` of each alert."""
    return with_cooldown(scan_candidates(attempts, cfg, by), ["src", "dst", *by], cfg.cooldown).drop(*by)


def flood_seconds(attempts: DataFrame, completed: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``dst, dport, sec, attempts, completed`` of each target and second; a completion alone makes one too."""
    both = attempts.select("ts_usec", "dst", "dport", *by, F.lit(1).alias("a"), F.lit(0).alias("c")).union(completed.select("ts_usec", "dst", "dport", *by, F.lit(0), F.lit(1)))
    return both.groupBy("dst", "dport", *by, second(F.col("ts_usec")).alias("sec")).agg(F.sum("a").cast("bigint").alias("attempts"), F.sum("c").cast("bigint").alias("completed"))


def flood_candidates(seconds: DataFrame, cfg: DetectorConfig = DetectorConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """``dst, dport, life, tick, attempts, completed, busy`` where attempts are many and few complete."""
    ticks = F.explode(F.sequence(F.col("sec") + 1, F.col("sec") + cfg.flood_window)).alias("tick")
    keys = ["dst", "dport", *by]
    sums = with_lives(seconds, keys, cfg.flood_window).select("*", ticks).groupBy(*keys, "life", "tick").agg(
        F.sum("attempts").cast("bigint").alias("attempts"), F.sum("completed").cast("bigint").alias("completed"), (F.max("sec") - F.min("sec") + 1).alias("busy")
    )
    many = F.col("attempts") / F.lit(float(cfg.flood_window)) >= cfg.flood_rate
    return sums.where(many & (F.col("completed").cast("double") < F.col("attempts").cast("double") * cfg.flood_completed))


def syn_floods(attempts: DataFrame, completed: DataFrame, cfg: DetectorConfig = DetectorConfig(), by: tuple[str, ...] = ()) -> DataFrame:
    """``dst, dport, tick, attempts, completed, busy`` of each alert."""
    return with_cooldown(flood_candidates(flood_seconds(attempts, completed, by), cfg, by), ["dst", "dport", *by], cfg.cooldown).drop(*by)


def spike_scores(series: DataFrame, value: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """``sec, bytes, seen, median, mad, z, high`` of a gap-filled series: one row a second, in one order."""
    x = F.log1p(F.greatest(F.col("bytes").cast("double"), F.lit(0.0)))
    rows = trailing_medians(series.select("sec", F.col(value).alias("bytes")).withColumn("x", x), "x", cfg.spike_history)
    rows = rows.withColumn("z", (F.col("x") - F.col("median")) / F.greatest(F.col("mad") * 1.4826, F.lit(0.25)))
    high = (F.col("seen") >= cfg.spike_warmup) & (F.col("z") >= cfg.spike_sigma) & (F.col("bytes") >= cfg.spike_min_bytes)
    return rows.withColumn("high", F.coalesce(high, F.lit(False))).drop("x")


def spikes(series: DataFrame, value: str, cfg: DetectorConfig = DetectorConfig()) -> DataFrame:
    """``tick, bytes, median, z`` of each alert: the third high second of a run, unless one was shortly before."""
    gap = max(cfg.cooldown, cfg.spike_cooldown)
    third = nth_of_run(spike_scores(series, value, cfg), "high", "sec", cfg.spike_seconds).withColumn("tick", F.col("sec") + 1)
    taken = third.agg(F.array_sort(F.collect_set("tick")).alias("t")).select(F.explode(greedy(F.col("t"), gap)).alias("tick"))
    return third.join(taken, "tick").select("tick", "bytes", "median", "z")


def scan_alerts(scans: DataFrame) -> DataFrame:
    span = (F.col("last_ts") - F.col("first_ts")) / F.lit(1e6)
    took = F.when(span < 0.9995, printed("%.0f ms", span * 1000)).otherwise(printed("%.1f s", span))
    text = F.concat("src", F.lit(" tried "), F.format_number("n_ports", 0), F.lit(" ports on "), "dst", F.lit(" in "), took)
    return _alert(scans, "port_scan", "high", "Port scan", text, F.col("src"), F.col("dst"))


def flood_alerts(floods: DataFrame) -> DataFrame:
    target = F.concat("dst", F.lit(":"), F.col("dport").cast("string"))  # IPv6 without brackets, by definition
    rate = F.format_number(F.floor(F.col("attempts") / F.greatest(F.col("busy"), F.lit(1))), 0)
    done = printed("%.0f%%", F.lit(100.0) * F.col("completed") / F.col("attempts"))
    return _alert(floods, "syn_flood", "high", "SYN flood", F.concat(target, F.lit(" got "), rate, F.lit(" connection attempts a second, "), done, F.lit(" completed")), F.lit(""), target)


def spike_alerts(found: DataFrame, direction: str, seconds: int = 3) -> DataFrame:
    from ..functions.formats import format_rate

    usual = F.expm1("median")
    times = printed("%.0f", F.col("bytes") / F.greatest(usual, F.lit(1.0)))
    text = F.concat(
        F.lit(f"{direction} "), format_rate(F.col("bytes")), F.lit(f" for {seconds} s, "), times, F.lit("× the usual "), format_rate(usual),
        F.lit(" ("), printed("%.1fσ", F.col("z")), F.lit(")"),
    )
    return _alert(found, "traffic_spike", "medium", "Traffic spike", text, F.lit(""), F.lit(""))


def _alert(df: DataFrame, kind: str, severity: str, title: str, message, src, dst) -> DataFrame:
    return df.select((F.col("tick") * _US).alias("ts_usec"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(title).alias("title"), message.alias("message"), src.alias("src"), dst.alias("dst"))


def alert_union(*alerts: DataFrame) -> DataFrame:
    """All kinds in one table; ordering it is the reader's."""
    out, *rest = alerts
    for a in rest:
        out = out.unionByName(a)
    return out
