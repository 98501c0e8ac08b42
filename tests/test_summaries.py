"""Sketches, samples, windows of two limits, open intervals, rules as rows, flushes and stores against plain loops."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import conditions, sketches, triggers
from tidemark.sources import storage
from tidemark.streaming import jobs


def test_quantiles_from_stored_sketches(spark, tmp_path):
    """Any range of slices is answered from the sketches alone, within the rank error."""
    rng = np.random.default_rng(2)
    values = rng.gamma(0.5, 100, 60_000)
    df = spark.createDataFrame([("a" if i % 3 else "b", i, float(v)) for i, v in enumerate(values)], "name string, us long, value double").repartition(8)
    sketches.sketched(df, ["name"], "value", "us", 1000).write.parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    points = (0.01, 0.5, 0.9, 0.99, 0.999)
    for low, high in ((0, 60_000), (7000, 45_000)):
        for r in sketches.from_sketches(stored, ["name"], points, low, high).collect():
            part = np.sort(values[[i for i in range(low, high) if ("a" if i % 3 else "b") == r.name]])
            assert r["count"] == len(part) and r.min_value == part[0] and r.max_value == part[-1] and r["mean"] == pytest.approx(part.mean())
            for p in points:
                at = np.searchsorted(part, r[sketches.point_name(p)], side="right") / len(part)
                assert abs(at - p) < 0.003
    assert sketches.from_sketches(sketches.sketched(df.limit(0), ["name"], "value", "us", 10), ["name"], points).count() == 0


def test_reservoirs_dont_depend_on_order(spark):
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), "id", F.when(F.col("id") % 10 != 0, F.col("id") * 1.0).alias("value"))
    one = {r.id for r in sketches.reservoir(df.repartition(7), ["g"], F.col("id"), 300).collect()}
    two = {r.id for r in sketches.reservoir(df.orderBy(F.desc("id")).coalesce(2), ["g"], F.col("id"), 300).collect()}
    assert one == two and len(one) == 600 and abs(np.mean(list(one)) - 10_000) < 1200
    rows = sketches.reservoir_timer(df, ["g"], "value", F.col("id"), (0.5,), 300).collect()
    assert all(r.sampled == 300 and r["count"] in (8000, 10_000) and abs(r.p50 - 10_000) < 2500 for r in rows)
    plan = sketches.reservoir(df, ["g"], F.col("id"), 300)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2  # before the shuffle and after it


@pytest.mark.parametrize("span,most", [(10, 4), (3, 100), (200, 7), (50, 1)])
def test_window_of_age_and_size(spark, span, most):
    rng = np.random.default_rng(span)
    at = np.cumsum(rng.integers(0, 5, 400))
    rows = [("a", int(t), i, None if i % 11 == 0 else float(i % 17)) for i, t in enumerate(at)]
    want = {}
    for i, r in enumerate(rows):
        frame = [x for x in rows[: i + 1] if x[1] >= r[1] - span][-most:]
        values = [x[3] for x in frame if x[3] is not None]
        want[i] = (len(values), round(sum(values), 6), frame[0][1])
    df = spark.createDataFrame(rows, "name string, us long, row_id long, value double").repartition(3)
    got = triggers.moving_at_most(df, "name", ["us", "row_id"], span, most).collect()
    assert {r.row_id: (r.m_count, round(r.m_sum, 6), r.m_oldest) for r in got} == want


def test_open_intervals(spark):
    rng = np.random.default_rng(0)
    rows = [("a", int(s), None if i % 4 == 0 else int(s + rng.integers(0, 60))) for i, s in enumerate(rng.integers(-50, 300, 200))]
    got = sketches.active_intervals(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], "s", "e", 10, 25, 0, 200).collect()
    want = [(t, sum(s <= t and (e is None or t < e) for _, s, e in rows), sum(s <= t and (e is None or t < e) and t - s > 25 for _, s, e in rows)) for t in range(0, 201, 10)]
    assert sorted((r.us, r.active, r.overdue) for r in got) == want


def tree(rng, depth=0):
    kind = int(rng.integers(0, 5 if depth < 4 else 2))
    if kind == 0:
        return {"field": "xyz"[int(rng.integers(3))], "op": (">", "<", ">=", "<=", "==", "!=")[int(rng.integers(6))], "value": float(rng.integers(0, 5))}
    if kind == 1:
        return {"field": "st"[int(rng.integers(2))], "op": ("contains", "not_contains", "regex")[int(rng.integers(3))], "value": "abc"[int(rng.integers(3))]}
    if kind == 2:
        return {"not": tree(rng, depth + 1)}
    return {("all", "any")[kind - 3]: [tree(rng, depth + 1) for _ in range(int(rng.integers(0, 4)))]}


def holds(t, row):
    if "all" in t:
        return all(holds(p, row) for p in t["all"])
    if "any" in t:
        return any(holds(p, row) for p in t["any"])
    if "not" in t:
        return not holds(t["not"], row)
    v, x = row.get(t["field"]), t["value"]
    if v is None:
        return False
    return {">": lambda: v > x, "<": lambda: v < x, ">=": lambda: v >= x, "<=": lambda: v <= x, "==": lambda: v == x, "!=": lambda: v != x, "contains": lambda: x in v, "not_contains": lambda: x not in v, "regex": lambda: x in v}[t["op"]]()


def test_a_thousand_rules_in_one_plan(spark):
    rng = np.random.default_rng(8)
    trees = [tree(rng) for _ in range(1000)]
    rules = spark.createDataFrame([(i, "ab"[i % 2], json.dumps(t)) for i, t in enumerate(trees)] + [(-1, "a", "no json"), (-2, "a", None), (-3, "a", '{"field": 1}')], "rule long, metric string, json string")
    rules = rules.withColumn("tokens", conditions.loaded(F.col("json")))
    again = {r.rule: json.loads(r.back) for r in rules.where("rule >= 0").select("rule", conditions.saved(F.col("tokens")).alias("back")).collect()}
    assert again == dict(enumerate(trees))
    rows = [(i, "ab"[i % 2], {k: float(rng.integers(0, 5)) for k in "xyz"[: 1 + i % 3]}, {k: "abc"[: int(rng.integers(0, 4))] for k in "st"}) for i in range(12)]
    df = spark.createDataFrame(rows, "id long, name string, numbers map<string,double>, texts map<string,string>")
    hits = conditions.matched(df, rules.drop("json"), ["id"])
    want = {(j, i) for j, t in enumerate(trees) for i, n, x, s in rows if n == "ab"[j % 2] and holds(t, x | s)}
    assert {(r.rule, r.id) for r in hits.collect()} == want and len(want) > 1000
    assert len(hits._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_a_cooldown_for_each_rule(spark):
    rules = spark.createDataFrame([("r", "a", '{"all": []}', 10), ("s", "a", '{"not": {"any": []}}', 25)], "rule string, metric string, json string, cooldown_us long")
    rows = spark.range(60).select(F.lit("a").alias("name"), (F.col("id") * 3).alias("us"), F.create_map(F.lit("x"), F.lit(1.0)).alias("numbers"), F.create_map(F.lit("s"), F.lit("")).alias("texts"))
    got = conditions.raised(rows, rules.select("rule", "metric", conditions.loaded(F.col("json")).alias("tokens"), "cooldown_us"), ["us"]).collect()
    assert sorted(r.us for r in got if r.rule == "r") == list(range(0, 180, 12)) and sorted(r.us for r in got if r.rule == "s") == list(range(0, 180, 27))


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    flush = jobs.Flush(str(tmp_path / "f"), "name", ["us"], 3)
    batches = [spark.createDataFrame(rows, "name string, us long") for rows in ([("a", 5), ("b", 1), ("a", 6)], [("c", 9), ("d", 8), ("b", 7)], [("e", 1), ("d", 12)], [("x", 1)])]
    for number, batch in enumerate(batches):
        flush(batch, number)
    want = sorted(map(tuple, flush.read(spark).collect()))
    assert want == [("a", 5), ("a", 6), ("b", 1), ("b", 7), ("d", 8), ("d", 12)] and flush.batches(spark) == [0, 1, 2, 3]
    for number in (3, 1):
        flush(batches[number], number)
    assert sorted(map(tuple, flush.read(spark).collect())) == want


def test_a_jdbc_store_on_derby(spark, tmp_path):
    options = {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    store = storage.create_store(spark, {"target": "metrics", "kind": "jdbc", "options": options})
    rows = [("cpu", 1, 0.5), ("mem", 2, 1.5)]
    store.append(spark.createDataFrame(rows, "name string, us long, value double"))
    store.append(spark.createDataFrame([("cpu", 3, 2.5)], "name string, us long, value double"))
    assert sorted(tuple(r) for r in store.read().collect()) == sorted([*rows, ("cpu", 3, 2.5)])
    assert store.read().where("us > 1")._jdf.queryExecution().executedPlan().toString().count("PushedFilters: [*IsNotNull(us), *GreaterThan(us,1)]") == 1
