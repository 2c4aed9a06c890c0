"""Folds over many rows against packet-by-packet accounts."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import folds, naming


def epochs(rows):
    out, tick, epoch = {}, None, 0
    for no, ts in sorted(rows):
        if ts > 0:
            sec = ts // 1_000_000
            if tick is not None and sec < tick - 10:
                tick, epoch = sec + 1, epoch + 1
            else:
                tick = sec + 1 if tick is None else max(tick, sec + 1)
        out[no] = epoch
    return out


@pytest.mark.parametrize("seed", range(6))
def test_clock_over_ranges(spark, seed):
    rng = random.Random(seed)
    rows, now = [], 5_000
    for no in range(600):
        now += rng.choice((0, 0, 0, 1, 2))
        if rng.random() < (0.0, 0.01, 0.05, 0.3, 0.5, 0.9)[seed]:
            now = max(1, now + rng.choice((-3, -9, -10, -11, -12, -13, -200, 30, 15, 12)))
        rows.append((no * 3, 0 if rng.random() < 0.02 else now * 1_000_000 + rng.randrange(1_000_000)))
    df = spark.createDataFrame([(*r, "x") for r in rows], "pkt_no long, ts_usec long, other string").repartition(3)
    for parts in (1, 7):
        got = folds.clock_epochs(df, parts=parts)
        assert got.columns == ["pkt_no", "ts_usec", "other", "epoch"]
        assert {r.pkt_no: r.epoch for r in got.collect()} == epochs(rows)
    assert folds.clock_epochs(df.limit(0)).count() == 0


def test_greedy_rows(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice("abc"), rng.randrange(4000)) for _ in range(900)})
    df = spark.createDataFrame([(k, t, t * 2) for k, t in rows], "k string, t long, v long").repartition(4)
    want, last = [], {}
    for k, t in rows:
        if k not in last or t - last[k] >= 60:
            last[k] = t
            want.append((k, t, t * 2))
    assert sorted(map(tuple, folds.greedy_rows(df, ["k"], "t", 60).collect())) == want


def lookups(rows):
    out = []
    for ts, _, name, qtype, rcode in sorted(rows):
        if name and out and out[-1][1] == name and ts - out[-1][0] < 2_000_000:
            out[-1][3] = out[-1][3] and rcode != 0
        elif name:
            out.append([ts, name, qtype, rcode == 3])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("slot", [10_000_000, 700_000])
def test_lookups_over_slots(spark, slot):
    rng = random.Random(slot)
    rows, ts = [], 1_000_000_000
    for no in range(500):
        ts += rng.choice((1, 1000, 300_000, 900_000, 1_999_999, 2_000_000, 40_000_000 if rng.random() < 0.1 else 5))
        rows.append((ts, no, rng.choice(("a", "a", "a", "b", "")), 1, rng.choice((0, 2, 3, 3))))
    df = spark.createDataFrame(rows, "ts_usec long, pkt_no long, name string, qtype int, rcode int").repartition(4)
    assert sorted(map(tuple, naming.dedupe_lookups(df, slot=slot).collect())) == lookups(rows)
    assert naming.dedupe_lookups(df.limit(0)).count() == 0


@pytest.mark.parametrize("slot", [1 << 40, 1000, 7])
def test_names_are_carried_over_slots(spark, slot):
    rng = random.Random(slot)
    told = [(rng.choice("xy"), rng.randrange(5000), n, f"n{rng.randrange(9)}") for n in range(60)]
    asks = [(rng.choice("xyz"), rng.randrange(5000), n) for n in range(60, 200)]
    answers = spark.createDataFrame(told, "addr string, ts_usec long, pkt_no long, name string")
    left = spark.createDataFrame(asks, "addr string, ts_usec long, pkt_no long")
    want = {n: max(((t, k, name) for x, t, k, name in told if x == a and (t, k) <= (ts, n)), default=(0, 0, None))[2] for a, ts, n in asks}
    got = naming.asof_name(left, answers, slot=slot)
    assert {r.pkt_no: r.name for r in got.collect()} == want and got.where(F.col("name") == "").count() == 0
