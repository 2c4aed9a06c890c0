"""Order-sensitive accumulations: expressions over ordered arrays where these are short, else folds over sorted Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def greedy(times: Column, gap: Column | int) -> Column:
    """Of ascending ``times`` those at least ``gap`` after the last one taken."""
    gap = F.lit(gap) if isinstance(gap, int) else gap
    return F.aggregate(
        times, F.array().cast("array<bigint>"),
        lambda kept, t: F.when((F.size(kept) == 0) | (t - F.try_element_at(kept, F.lit(-1)) >= gap), F.array_append(kept, t)).otherwise(kept),
    )


def cooldown(events: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """``keys, time`` of the events that are emitted: at least ``gap`` after the key's last emitted one.

    A key's distinct times are one array; in whole seconds it has 86,400 elements a day at most.
    """
    return events.groupBy(*keys).agg(F.array_sort(F.collect_set(time)).alias("__t")).select(*keys, F.explode(greedy(F.col("__t"), gap)).alias(time))


def ewma(values: Column) -> Column:
    """The rate after the last value: half of the rate before and half of the value, under 1 being 0."""
    def step(r, b):
        n = r * 0.5 + b * 0.5
        return F.when(n < 1, F.lit(0.0)).otherwise(n)

    return F.aggregate(F.transform(values, lambda x: x.cast("double")), F.lit(0.0), step)


def nth_of_run(df: DataFrame, flag: str, order: str, n: int) -> DataFrame:
    """Rows that are the ``n``-th in an unbroken run of true ``flag``."""
    w = W.orderBy(order)
    runs = df.withColumn("__run", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w))
    place = F.row_number().over(W.partitionBy("__run", F.col(flag)).orderBy(order))
    return runs.withColumn("__n", place).where(F.col(flag) & (F.col("__n") == n)).drop("__run", "__n")


def trailing_medians(series: DataFrame, value: str, n: int, order: str = "sec") -> DataFrame:
    """``series`` with ``seen``, ``median`` and ``mad`` of the ``n`` values before each row: upper medians, null for none.

    One row a second in one order, so this is one pass; a batch's windows are sorted together, and
    only the last ``n`` values are carried on.
    """

    def run(batches):
        held = np.zeros(0)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(value).cast(pa.float64()).to_numpy()
            every = np.concatenate([held, x])
            count = np.minimum(len(held) + np.arange(len(x)), n)
            median, mad = np.zeros(len(x)), np.zeros(len(x))
            for s in range(0, len(x), 4096):
                own = count[s : s + 4096]
                short = np.flatnonzero(own < n)
                for k in short.tolist():  # at the beginning of the series only
                    h = np.sort(every[len(held) + s + k - own[k] : len(held) + s + k])
                    if len(h):
                        median[s + k] = h[len(h) // 2]
                        mad[s + k] = np.sort(np.abs(h - median[s + k]))[len(h) // 2]
                full = np.flatnonzero(own == n)
                if len(full):
                    first = len(held) + s + int(full[0]) - n
                    w = np.sort(np.lib.stride_tricks.sliding_window_view(every[first : first + n + len(full) - 1], n), axis=1)
                    m = w[:, n // 2]
                    median[s + full], mad[s + full] = m, np.partition(np.abs(w - m[:, None]), n // 2, axis=1)[:, n // 2]
            none = pa.array(count == 0)
            more = [pa.array(count, pa.int32()), pc.if_else(none, None, pa.array(median)), pc.if_else(none, None, pa.array(mad))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "seen", "median", "mad"])
            held = every[-n:]

    schema = T.StructType([*series.schema.fields, *T.StructType.fromDDL("seen int, median double, mad double").fields])
    return series.repartition(1).sortWithinPartitions(order).mapInArrow(run, schema)


def session_ids(df: DataFrame, keys: list[str], ts: str, order: list[str], limit_sec: int) -> DataFrame:
    """``session``: 0, 1, … by key; one ends where the next packet's whole second is more than
    ``limit_sec`` after the last packet. For keys whose limit is constant (all but TCP)."""
    w = W.partitionBy(*keys).orderBy(*order)
    floor_sec = F.floor(F.col(ts) / 1_000_000).cast("bigint") * 1_000_000
    starts = F.coalesce((floor_sec - F.lag(ts).over(w) > limit_sec * 1_000_000).cast("int"), F.lit(0))
    return df.withColumn("__new", starts).withColumn("session", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("bigint")).drop("__new")


def key_changes(batch: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where each key's rows begin in a sorted batch with rows (0 left out if the batch goes on with ``last``), and its last key."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
    at = lambda i: tuple(batch.column(k)[i].as_py() for k in keys)
    new[0] = at(0) != last
    return np.flatnonzero(new), at(n - 1)


def greedy_rows(df: DataFrame, keys: list[str], time: str, gap: int) -> DataFrame:
    """The rows of ``df`` at least ``gap`` after the last one taken of their key; times of a key are distinct.

    Rows are dealt by key and sorted by time; what is kept of a key is the time of its last taken
    row, so a key may have any number of rows and a batch is passed through in jumps.
    """

    def run(batches):
        key, until = None, None
        for b in batches:
            if not b.num_rows:
                continue
            t = b.column(time).to_numpy()
            starts, last = key_changes(b, keys, key)
            key, taken = last, []
            edges = [*([] if len(starts) and starts[0] == 0 else [0]), *starts.tolist(), len(t)]
            fresh = set(starts.tolist())
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                until = None if s in fresh else until
                i = s if until is None else s + int(np.searchsorted(t[s:e], until))
                while i < e:
                    taken.append(i)
                    until = int(t[i]) + gap
                    i = s + int(np.searchsorted(t[s:e], until))
            yield b.take(pa.array(taken, pa.int64()))

    return df.repartition(*keys).sortWithinPartitions(*keys, time).mapInArrow(run, df.schema)


def range_part(value: Column, bounds: list) -> Column:
    """Which of the ranges between ascending bounds a value is in, by bisection."""
    if not bounds:
        return F.lit(0)

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(value < F.lit(bounds[middle]), pick(lo, middle)).otherwise(pick(middle + 1, hi))

    return pick(0, len(bounds))


class _Clock:
    """The clock over the whole seconds of packets in their order."""

    def __init__(self, tolerance: int, tick: int | None = None, epoch: int = 0):
        self.tolerance, self.tick, self.epoch = tolerance, tick, epoch

    def see(self, sec: int) -> None:
        if self.tick is None or sec >= self.tick:
            self.tick = sec + 1
        elif sec < self.tick - self.tolerance:
            self.tick, self.epoch = sec + 1, self.epoch + 1


def _seconds(batch: pa.RecordBatch, ts: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows where the second changes, and these seconds; times that are not positive do not move the clock."""
    t = pc.fill_null(batch.column(ts), 0).to_numpy()
    rows = np.flatnonzero(t > 0)
    sec = t[rows] // 1_000_000
    change = np.ones(len(rows), bool)
    change[1:] = sec[1:] != sec[:-1]
    return rows[change], sec[change]


def clock_epochs(packets: DataFrame, ts: str = "ts_usec", order: str = "pkt_no", tolerance_sec: int = 10, parts: int | None = None, if_any: bool = False) -> DataFrame | None:
    """``packets`` with ``epoch``: how often the clock has restarted.

    The clock follows the packets; one that is more than ten seconds before the next tick restarts
    it. Packets are dealt into ranges of their order. How a range carries the clock on depends on
    its tick only within the tolerance of the range's first second, so a range tells its outcome for
    each of these few ticks in one pass over its seconds; chaining the ranges gives each its start,
    and where the clock ever restarted a second pass follows it through all ranges side by side.
    With ``if_any`` there is no result if it never did.
    """
    parts = parts or int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = packets.agg(F.percentile_approx(order, [k / parts for k in range(1, parts)] or [0.5], 10_000)).first()[0] or []
    part = range_part(F.col(order), sorted(set(cuts)) if parts > 1 else []).cast("int")
    by_range = lambda df: df.withColumn("__part", part).repartition(parts, "__part").sortWithinPartitions("__part", order)

    def outcomes(batches):
        known: dict[int, tuple[int, _Clock, dict[int, _Clock], dict[int, int]]] = {}
        for b in batches:
            of = b.column("__part").to_numpy()
            rows, secs = _seconds(b, ts)
            for p, sec in zip(of[rows].tolist(), secs.tolist(), strict=True):
                if p not in known:
                    # the clock without a tick before, clocks that begin up to the tolerance ahead, and those that have met the first
                    known[p] = sec, _Clock(tolerance_sec), {d: _Clock(tolerance_sec, sec + 1 + d) for d in range(1, tolerance_sec)}, {0: 0}
                _, main, apart, met = known[p]
                main.see(sec)
                for d, c in list(apart.items()):
                    c.see(sec)
                    if c.tick == main.tick:
                        met[d] = c.epoch - main.epoch
                        del apart[d]
        out = []
        for p, (first, main, apart, met) in known.items():
            ends = {d: (main.tick, main.epoch + more) for d, more in met.items()} | {d: (c.tick, c.epoch) for d, c in apart.items()}
            out.append({"part": p, "first": first, "ticks": [ends[d][0] for d in range(tolerance_sec)], "epochs": [ends[d][1] for d in range(tolerance_sec)]})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int32()), ("first", pa.int64()), ("ticks", pa.list_(pa.int64())), ("epochs", pa.list_(pa.int64()))]))

    found = by_range(packets.select(order, ts)).mapInArrow(outcomes, "part int, first long, ticks array<long>, epochs array<long>")
    tick, epoch, starts = None, 0, {}
    for r in sorted(found.collect(), key=lambda r: r.part):  # a row for each range
        starts[r.part] = tick, epoch
        ahead = 0 if tick is None else tick - r.first - 1
        restart = ahead >= tolerance_sec
        ahead = 0 if restart else max(0, ahead)
        tick, epoch = r.ticks[ahead], epoch + restart + r.epochs[ahead]
    if not epoch:
        return None if if_any else packets.withColumn("epoch", F.lit(0))
    names = packets.columns

    def follow(batches):
        clocks: dict[int, _Clock] = {}
        for b in batches:
            of = b.column("__part").to_numpy()
            epochs = np.full(len(of), -1, np.int32)
            rows, secs = _seconds(b, ts)
            begins = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
            for i in begins.tolist():
                clock = clocks.setdefault(int(of[i]), _Clock(tolerance_sec, *starts.get(int(of[i]), (None, 0))))
                epochs[i] = clock.epoch
                stop = int(np.searchsorted(of, of[i], "right"))
                own = slice(*np.searchsorted(rows, [i, stop]).tolist())
                for k, sec in zip(rows[own].tolist(), secs[own].tolist(), strict=True):
                    clock.see(sec)
                    epochs[k] = clock.epoch
            at = np.maximum.accumulate(np.where(epochs >= 0, np.arange(len(of)), 0))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(epochs[at])], [*names, "epoch"])

    return by_range(packets).mapInArrow(follow, T.StructType([*packets.schema.fields, T.StructField("epoch", T.IntegerType())]))
