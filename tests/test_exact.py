"""Results that have to be exact beyond small tables: whole rates, ties of an order, quantiles, dense moving windows, large stream states."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.operators import graphs, scans, sketches, triggers
from tidemark.operators import series as S
from tidemark.streaming import jobs, timers


def test_a_whole_rate_is_not_cut_off_below(spark):
    df = spark.createDataFrame([("e", 0, 51.64), ("e", 1_088_000, 58.95)], "name string, us long, value double")
    got = S.counter_rates(df, ["us"], whole=True, scale=1_000_000).orderBy("us").collect()
    assert [r.rate for r in got] == [None, int((58.95 - 51.64) * 1e6 / 1.088)] and got[1].rate == 6718750


def test_equal_places_follow_their_counters(spark):
    """Rows of one place, as they come after a shuffle: each change is one row's, whatever the order they arrive in."""
    rows = [("n", 1, 2.0, 0.0), ("n", 2, 8.0, 3.0), ("n", 2, 5.0, 3.0), ("n", 2, 4.0, 2.0), ("n", 2, 3.0, 1.0), ("n", 3, 9.0, 3.0)]
    for part in (rows, rows[::-1]):
        got = S.busy_percent(spark.createDataFrame(part, "name string, seq long, total double, idle double").coalesce(1), "idle", "total", "name", ["seq"]).orderBy("total").collect()
        assert [r.busy for r in got] == [0.0, 0.0, 0.0, 0.0, 100.0, 100.0]


def test_running_sums(spark):
    rng = np.random.default_rng(1)
    rows = [("ab"[i % 2], i, None if i % 11 == 0 else float(rng.integers(0, 9))) for i in range(300)]
    want, upto = {}, {"a": 0.0, "b": 0.0}
    for n, i, x in rows:
        want[i] = upto[n] = upto[n] + (x or 0.0)
    df = spark.createDataFrame(rows, "name string, at long, value double").repartition(5)
    for wide in (1, 37, 10**6):
        assert {r.at: r.total for r in scans.running_sums(df, ["name"], ["at"], {"total": F.col("value")}, wide).collect()} == want


def test_exact_quantiles(spark):
    """More distinct values than a sketch holds, repeated ones, a null key and a single row."""
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(0, 100, 20_000), "b": np.round(rng.exponential(3, 9_000), 1), None: rng.normal(5, 1, 700), "c": np.array([7.5])}
    df = spark.createDataFrame([(k, i * 10, float(x)) for k, v in groups.items() for i, x in enumerate(v)], "name string, us long, value double")
    points = (0.01, 0.25, 0.5, 0.9, 0.95, 0.99)
    for low, high in ((None, None), (2_000, 90_000)):
        got = {r.name: r for r in sketches.from_counts(sketches.counted(df, ["name"], "value", "us", 1_000), ["name"], points, low, high).collect()}
        for k, v in groups.items():
            part = np.sort(v if low is None else v[low // 10 : high // 10])
            if len(part):
                assert [got[k][sketches.point_name(p)] for p in points] == [part[max(1, -(-len(part) * int(p * 100) // 100)) - 1] for p in points] and got[k]["count"] == len(part)


def test_dense_frames_against_plain_ones(spark):
    """Equal times, nulls, frames over slices' edges; and no frame that Spark makes up row by row."""
    rng = np.random.default_rng(8)
    rows = [("ab"[i % 2], int(rng.integers(0, 4_000)), None if i % 13 == 0 else float(rng.normal(1e6, 1)), i) for i in range(900)]
    df = spark.createDataFrame(rows, "name string, us long, value double, row_id long").repartition(3)
    moved = {r.row_id: r for r in triggers.moving(df, "name", 50).collect()}
    most = {r.row_id: r for r in triggers.moving_at_most(df, "name", ["us", "row_id"], 50, 5).collect()}
    steep = {r.row_id: r for r in triggers.slopes(df, "name", 50, 1.0).collect()}
    assert len(moved) == len(most) == len(steep) == 900
    for name, us, _, i in rows:
        frame = [r for r in rows if r[0] == name and us - 50 <= r[1] <= us]
        x = [r[2] for r in frame if r[2] is not None]
        assert (moved[i].m_count, moved[i].m_min, moved[i].m_max) == (len(x), min(x, default=None), max(x, default=None))
        assert not x or np.allclose([moved[i].m_sum, moved[i].m_mean], [sum(x), np.mean(x)], rtol=1e-14)
        last = [r for r in sorted(frame, key=lambda r: (r[1], r[3])) if (r[1], r[3]) <= (us, i)][-5:]
        y = [r[2] for r in last if r[2] is not None]
        assert (most[i].m_count, most[i].m_oldest) == (len(y), last[0][1]) and np.isclose(most[i].m_sum, sum(y), rtol=1e-14)
        t, p = np.array([r[1] / 1000 for r in frame if r[2] is not None]), np.array(x)
        spread = np.var([r[1] / 1000 for r in frame])
        want = np.mean((t - t.mean()) * (p - p.mean())) / spread * 0.05 if len(x) > 1 and spread > 1e-10 else 0.0
        assert np.isclose(steep[i].change, want, rtol=1e-6, atol=1e-9)
    for out in (triggers.moving(df, "name", 50), triggers.moving_at_most(df, "name", ["us", "row_id"], 50, 5), triggers.slopes(df, "name", 50, 1.0)):
        assert "RangeFrame" not in out._jdf.queryExecution().executedPlan().toString()


def test_export_batches_put_only_the_newest_slices_in_order(spark):
    rng = np.random.default_rng(5)
    day = scans.SLICE_US
    rows = [("ab"[i % 2], None if i % 50 == 0 else int(rng.integers(0, 40)) * day + int(rng.integers(0, 5)), i) for i in range(600)] + [("c", None, i) for i in range(3)] + [(None, 7, 1), (None, None, 2)]
    df = spark.createDataFrame(rows, "service string, us long, id long")
    for queue in (20, 280, 1000):
        want = set()
        for s in ("a", "b", "c", None):
            newest = sorted([r for r in rows if r[0] == s], key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[-queue:]
            want |= {(s, r[2], i // 10) for i, r in enumerate(newest)}
        out = graphs.export_batches(df, ["us", "id"], "service", 10, queue)
        assert {(r.service, r.id, r.batch) for r in out.collect()} == want
    assert "_oldest" in out._jdf.queryExecution().optimizedPlan().toString()


def test_stream_states_of_equal_times_follow_their_number(spark, tmp_path):
    rows = [("x", 10, 3, True), ("x", 10, 2, False), ("x", 10, 1, True), ("x", 5, 9, True), ("x", 20, 4, None)]
    spark.createDataFrame(rows, "name string, us long, id long, met boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, us long, id long, met boolean").parquet(str(tmp_path / "in"))
    got = jobs.run_available(jobs.alert_states(stream, "name", "us", "met", 0, "id"), str(tmp_path / "out"))
    assert sorted((r.us, r.state) for r in got.collect()) == [(5, "pending"), (10, "firing"), (10, "pending"), (10, "resolved"), (20, "inactive")]


def test_waiting_rows_take_few_bytes():
    rows = pa.table({"_0": np.arange(100_000) * 3_000_017, "_1": np.arange(100_000), "_2": [None, True] * 50_000, "_3": ["a", None] * 50_000})
    kept = timers._packed(rows)
    assert timers._unpacked(kept).equals(rows) and len(kept) < 20 * len(rows)
