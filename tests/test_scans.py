"""Scans over time slices against plain loops: one long series in many slices, whatever their width; nulls and single rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, scans, series, triggers

WIDTHS = [1, 7, 100, 10**6]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    at = np.cumsum(rng.integers(0, 4, 700))
    return [("a" if i < 600 else None, int(t), i, float(v)) for i, (t, v) in enumerate(zip(at, rng.normal(size=700) ** 3 * 10 + 1e6, strict=True))]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, us long, row_id long, value double").repartition(4).cache()


def each(rows):
    for name in ("a", None):
        yield [r for r in rows if r[0] == name]


@pytest.mark.parametrize("width", WIDTHS)
def test_outliers(frame, rows, width):
    want = {}
    for part in each(rows):
        for i, r in enumerate(part):
            before = np.array([x[3] for x in part[:i]])
            want[r[2]] = i > 10 and abs(r[3] - before.mean()) / (before.std(ddof=1) + 1e-10) > 3
    got = {r.row_id: r.outlier for r in triggers.outliers(frame, "name", ["us", "row_id"], slice_us=width).collect()}
    assert got == want and any(want.values())


def test_absolute_outliers(spark):
    df = spark.createDataFrame([("a", i, i, 5.0) for i in range(12)] + [("a", 12, 12, 5.1), ("a", 13, 13, 9.0)], "name string, us long, row_id long, value double")
    relative = triggers.outliers(df, "name", ["us", "row_id"], slice_us=3).where("outlier").collect()
    absolute = triggers.outliers(df, "name", ["us", "row_id"], more_than=9, slice_us=3, relative=False).where("outlier").collect()
    assert {r.us for r in relative} == {12, 13} and {r.us for r in absolute} == {13}


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("hold", [0, 3, 25])
def test_states(frame, rows, width, hold):
    want = {}
    for part in each(rows):
        state, since = "inactive", 0
        for _, us, i, v in part:
            met = v > 1e6 - 8
            if met and state in ("inactive", "resolved"):
                state, since = "pending", us
            elif met and state == "pending" and us - since >= hold:
                state = "firing"
            elif not met:
                state = {"firing": "resolved", "pending": "inactive"}.get(state, state)
            want[i] = state
    df = frame.withColumn("met", F.col("value") > 1e6 - 8)
    got = {r.row_id: r.state for r in alerts.states(df, ["name"], ["us", "row_id"], "met", hold, width).collect()}
    assert got == want and len(set(want.values())) == 4


@pytest.mark.parametrize("width", WIDTHS)
def test_cooldowns(frame, rows, width):
    want = set()
    for part in each(rows):
        last = None
        for _, us, i, _ in part:
            if last is None or us - last >= 3:
                want.add((us, part[0][0]))
                last = us
    out = alerts.cooled(frame, ["name"], 3, width).collect()
    assert {(r.us, r.name) for r in out} == want and len(out) == len(want)


@pytest.mark.parametrize("width", WIDTHS)
def test_neighbours_and_last_values(frame, rows, width):
    kept, known = set(), {}
    for part in each(rows):
        for i, (_, us, n, v) in enumerate(part):
            if 0 < i < len(part) - 1:
                (_, b, _, p), (_, a, _, q) = part[i - 1], part[i + 1]
                if abs(v - (p + (q - p) * ((us - b) / (a - b) if a != b else 0))) <= 5:
                    continue
            kept.add(n)
        last = None
        for _, _, n, v in part:
            last = v if n % 9 == 0 else last
            known[n] = last
    assert {r.row_id for r in series.compressed(frame, 5.0, ["us", "row_id"], width).collect()} == kept
    some = F.when(F.col("row_id") % 9 == 0, F.col("value"))
    assert {r.row_id: r.last for r in scans.last_known(frame, ["name"], ["us", "row_id"], some, "last", width).collect()} == known


@pytest.mark.parametrize("width", WIDTHS)
def test_smoothing_and_calculus(frame, rows, width):
    want = {}
    for part in each(rows):
        s = part[0][3]
        for _, _, n, v in part:
            s = 0.05 * v + 0.95 * s
            want[n] = s
    got = {r.row_id: r.smoothed for r in series.smoothed(frame, "name", ["us", "row_id"], 0.05, width).collect()}
    assert all(math.isclose(got[n], s, rel_tol=1e-12) for n, s in want.items()) and len(got) == 700
    one = {r.name: r for r in series.calculus(frame, ["us", "row_id"], width).collect()}
    for part in each(rows):
        area = sum((p[3] + q[3]) / 2 * (q[1] - p[1]) / 1e6 for p, q in zip(part, part[1:], strict=False))
        assert math.isclose(one[part[0][0]].integral, area, rel_tol=1e-9)


def test_no_window_takes_a_whole_series(frame):
    """Every window over rows is partitioned by the slice too."""
    df = alerts.states(triggers.outliers(frame, "name", ["us", "row_id"], slice_us=100), ["name"], ["us", "row_id"], "outlier", 3, 100)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_slice" in line.split("], [")[1] for line in windows)
