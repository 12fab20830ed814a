"""Streams of many keys: results against a plain replay, and states that do not grow with the number of keys."""

import random

from pyspark.sql import functions as F

from marl.shared import fresh_path
from marl.streaming import state, status

TTL, DELAY, SLICE, START = 7200, 3600, 21_600, 1_704_067_200


def brute_force(rows):
    told, live, watermark, latest = [], {}, 0, 0
    for nth in sorted({at // SLICE for _, at in rows}):
        for key, at in sorted((r for r in rows if r[1] // SLICE == nth), key=lambda r: r[1]):
            if at * 1000 <= watermark:
                continue
            latest, before = max(latest, at), live.get(key)
            if before is not None and at - before >= TTL:
                told.append((key, before, "expired"))
            told.append((key, at, "hit" if before is not None and at - before < TTL else "miss"))
            live[key] = at
        for key in [k for k, at in live.items() if (at + TTL) * 1000 <= watermark]:
            told.append((key, live.pop(key), "expired"))
        watermark = max(watermark, (latest - DELAY) * 1000)
    return told + [(k, at, "expired") for k, at in live.items() if (at + TTL) * 1000 <= watermark]


def lived(spark, rows, kind):
    df = spark.createDataFrame([(k, at) for k, at in rows], f"k {kind}, at long").select("k", F.timestamp_seconds("at").alias("ts"))
    stream = state.replay(df, "ts", "6 hours", fresh_path(spark, "replay"))
    found, told = status.watched(spark, lambda: state.run_once(state.lives(stream, "k", "ts", TTL, "1 hour"), fresh_path(spark, "stream")))
    return sorted((r.k, r.at_ms // 1000, r.what) for r in found.collect()), told


def test_lives_of_many_keys_take_few_states(spark):
    pick = random.Random(3)
    rows = [(pick.randrange(2000), START + pick.randrange(0, 4 * SLICE)) for _ in range(6000)]
    got, told = lived(spark, rows, "long")
    assert got == sorted(brute_force(rows))
    states = [r[5] for r in told.rows if r[0] == "progress" and r[5] is not None]
    assert states and max(states) <= 256  # before: a state, and a call of Python in each micro-batch, for each key


def test_lives_that_end_with_the_watermark(spark):
    # the last watermark is an hour before the last row: one value ends with it, one a second later; a row comes just when its value ends
    last = START + 3 * SLICE
    rows = [("ends", last - DELAY - TTL), ("lives", last - DELAY - TTL + 1), ("late", START), ("late", START + TTL), ("in time", START), ("in time", START + TTL - 1), ("last", last)]
    got, _ = lived(spark, rows, "string")
    assert got == sorted(brute_force(rows))
    assert ("ends", last - DELAY - TTL, "expired") in got and ("lives", last - DELAY - TTL + 1, "expired") not in got
    assert ("late", START, "expired") in got and ("in time", START + TTL - 1, "hit") in got
