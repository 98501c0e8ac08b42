"""Streams with timers, fed in many small files: as one run over ordered rows, and as the batch forms."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions.times import micros
from tidemark.operators import alerts
from tidemark.streaming import jobs, timers

SECOND = 1_000_000
LATE_MS = 20_000


@pytest.fixture(scope="module")
def rows():
    """Rows whose arrival is up to 15 seconds out of order; keys fall silent at times, one for good."""
    rng = np.random.default_rng(6)
    out, at = [], 0
    for i in range(400):
        at += int(rng.integers(0, 6)) + (400 if i % 90 == 0 else 0)
        out.append((at * SECOND + int(rng.integers(0, SECOND)), i, "abc"[int(rng.integers(0, 3 if i < 200 else 2))], f"f{int(rng.integers(0, 4))}", bool(rng.integers(0, 2))))
    return out


@pytest.fixture(scope="module")
def stream(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("files"))
    rng = np.random.default_rng(3)
    arrival = sorted(rows, key=lambda r: r[0] + int(rng.integers(0, 15 * SECOND)))
    base = dt.datetime(1970, 1, 1)
    for n in range(0, len(arrival), 40):
        part = [(base + dt.timedelta(microseconds=r[0]), *r[1:]) for r in arrival[n : n + 40]]
        spark.createDataFrame(part, "ts timestamp_ntz, id long, k string, f string, firing boolean").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    return lambda: jobs.event_stream(spark, folder, "*.parquet", schema).withColumn("us", micros(F.col("ts"))).withColumn("state", F.when(F.col("firing"), "firing").otherwise("resolved"))


def straight(rows, machine, pick, until):
    """The machine over all rows in order, without batches or watermarks."""
    kept, out = {}, []

    def upto(key, at):
        while (due := machine.due(kept[key])) is not None and due <= at:
            out.extend((key, *r) for r in machine.fire(kept[key], due))

    for r in sorted(rows):
        if r[0] <= until:
            upto(r[2], r[0]) if r[2] in kept else kept.setdefault(r[2], {})
            out.extend((r[2], *x) for x in machine.row(kept[r[2]], r[0], pick(r)))
    for key in kept:
        upto(key, until)
    return sorted(out)


MACHINES = {
    "group": (timers.GroupTimer(30 * SECOND, 60 * SECOND, 45 * SECOND), ["f", "firing"], lambda r: [r[3], r[4]]),
    "cache": (timers.CacheTimer(50 * SECOND), ["id", "state"], lambda r: [r[1], "firing" if r[4] else "resolved"]),
    "compat": (timers.CacheTimer(50 * SECOND, compat=True), ["id", "state"], lambda r: [r[1], "firing" if r[4] else "resolved"]),
    "state": (timers.StateTimer(2 * SECOND, 25 * SECOND, 200 * SECOND), ["firing"], lambda r: [r[4]]),
}


@pytest.mark.parametrize("name", MACHINES)
def test_batches_and_lateness_change_nothing(spark, tmp_path, rows, stream, name):
    machine, columns, pick = MACHINES[name]
    until = timers.horizon_us(max(r[0] for r in rows), LATE_MS)
    want = straight(rows, machine, pick, until)
    out = jobs.run_available(timers.folded(stream(), "k", ["us", "id"], columns, machine, machine.SCHEMA, LATE_MS), str(tmp_path))
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 20


@pytest.mark.parametrize("buckets", [1, 2])
def test_a_call_folds_the_keys_of_a_bucket(spark, tmp_path, rows, stream, monkeypatch, buckets):
    """Keys share calls and state, null and "null" among them; chunks of few rows."""
    monkeypatch.setattr(timers, "BUCKETS", buckets)
    monkeypatch.setattr(timers, "CHUNK", 7)
    machine, columns, pick = MACHINES["cache"]
    until = timers.horizon_us(max(r[0] for r in rows), LATE_MS)
    odd = {"a": None, "b": "null", "c": "c"}
    s = stream().withColumn("k", F.when(F.col("k") == "b", "null").when(F.col("k") == "c", "c"))
    df = timers.folded(s, "k", ["us", "id"], columns, machine, machine.SCHEMA, LATE_MS)
    assert "bucket" in df._jdf.queryExecution().analyzed().toString()
    out = jobs.run_available(df, str(tmp_path))
    want = [(odd[k], *r) for k, *r in straight(rows, machine, pick, until)]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)


def test_batch_forms(spark, rows):
    until = timers.horizon_us(max(r[0] for r in rows), LATE_MS)
    df = spark.createDataFrame(rows, "us long, id long, k string, f string, firing boolean").withColumn("state", F.when(F.col("firing"), "firing").otherwise("resolved"))
    for width in (7 * SECOND, 10**12):
        got = alerts.timed_flushes(df, "k", "f", ["us", "id"], "firing", 30 * SECOND, 60 * SECOND, 45 * SECOND, until, width)
        assert sorted(tuple(r) for r in got.collect()) == straight(rows, MACHINES["group"][0], MACHINES["group"][2], until)
        for name in ("cache", "compat"):
            machine, _, pick = MACHINES[name]
            kept = alerts.cached(df, ["k"], ["us", "id"], "state", 50 * SECOND, name == "compat", width)
            assert sorted((r.k, r.us, r.id, r.state) for r in kept.collect()) == straight(rows, machine, pick, 10**18)


def test_a_silent_key_is_resolved_and_forgotten():
    machine, kept = timers.StateTimer(0, 10, 100), {}
    assert [list(machine.row(kept, t, [True])) for t in (0, 1)] == [[(0, "pending")], [(1, "firing")]]
    assert machine.due(kept) == 11 and list(machine.fire(kept, 11)) == [(11, "resolved")] and machine.due(kept) == 111
    assert list(machine.fire(kept, 111)) == [] and kept == {}


def test_a_group_is_sent_without_further_rows_and_forgotten():
    machine, kept = timers.GroupTimer(10, 20, 25), {}
    list(machine.row(kept, 0, ["x", True]))
    assert list(machine.fire(kept, machine.due(kept))) == [(10, 1, 1)] and list(machine.fire(kept, machine.due(kept))) == [(30, 1, 1)]
    list(machine.row(kept, 32, ["x", False]))
    assert list(machine.fire(kept, machine.due(kept))) == [(50, 1, 0)] and machine.due(kept) == 57 and list(machine.fire(kept, 57)) == [] and kept == {}


def test_timed_flushes_read_their_rows_once(spark):
    """The rows, the stretches and the sends are each worked out once, and stretches meet their own life only."""
    df = spark.range(400).select((F.col("id") * 7 * SECOND).alias("us"), "id", F.lit("k").alias("k"), (F.col("id") % 3).cast("string").alias("f"), (F.col("id") % 40 < 5).alias("firing"))
    got = alerts.timed_flushes(df, "k", "f", ["us", "id"], "firing", 30 * SECOND, 60 * SECOND, 15 * SECOND, 10**18, 100 * SECOND)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Range" not in plan and not any(" < _stop" in line or "_stop#" in line for line in plan.splitlines() if "Join" in line)
    machine = timers.GroupTimer(30 * SECOND, 60 * SECOND, 15 * SECOND)
    rows = [(r.us, r.id, r.k, r.f, r.firing) for r in df.collect()]
    assert sorted(tuple(r) for r in got.collect()) == straight(rows, machine, lambda r: [r[3], r[4]], 10**18)
