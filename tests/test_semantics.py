"""Small fixtures: known values of statistics, triggers, states, graphs, formats and stores."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import labels as L
from tidemark.operators import aggregates as A
from tidemark.operators import alerts as AL
from tidemark.operators import folds, graphs
from tidemark.operators import series as S
from tidemark.operators import triggers as T
from tidemark.sources import encoders as E
from tidemark.sources import storage


def series(spark, values, name="s", step=1_000_000):
    return spark.createDataFrame([(name, i * step, float(v), 1, i) for i, v in enumerate(values)], "name string, us long, value double, n int, row_id long")


def test_range_query_excludes_the_end(spark):
    s = series(spark, range(60))
    points = S.range_query(s, 10_000_000, 50_000_000, 10_000_000)
    rows = [(r.step_start // 1_000_000, r.ts // 1_000_000, r.value, r.sample_count) for r in points.orderBy("step_start").collect()]
    assert rows == [(10, 19, 14.5, 10), (20, 29, 24.5, 10), (30, 39, 34.5, 10), (40, 49, 44.5, 10)]
    one = S.range_summary(points).first()
    assert (one.total_samples, one.average, one.rate, one.min_value, one.max_value) == (40, 29.5, 1.0, 14.5, 44.5)


def test_empty_range(spark):
    assert S.range_query(series(spark, []), 0, 10, 5).count() == 0


def test_moments(spark):
    one = A.stream_stats(series(spark, [1, 2, 3, 4, 5]), ["name"]).first()
    assert (one["count"], one["mean"], one["min_value"], one["max_value"], one["variance"]) == (5, 3.0, 1.0, 5.0, 2.5)
    assert A.stream_stats(series(spark, [7]), ["name"]).first()["variance"] == 0.0
    assert A.summary(series(spark, [2, 4, 4, 4, 5, 5, 7, 9]), ["name"]).first()["std_dev"] == 2.0


def test_percentiles(spark):
    assert series(spark, [10, 20]).agg(A.percentiles(F.col("value"), (0.0, 0.5, 1.0))).first()[0] == [10.0, 15.0, 20.0]
    one = A.nearest_rank(series(spark, range(1, 101)), ["name"], "value", (0.95, 0.99)).first()
    assert (one.p95, one.p99) == (95.0, 99.0)


def test_histogram_is_cumulative(spark):
    h = A.histogram(series(spark, [0.004, 0.03, 0.03, 0.2, 3, 40]), ["name"]).collect()
    assert [r.bucket_count for r in h] == [1, 1, 1, 3, 3, 3, 4, 4, 4, 4, 4, 5, 5, 5, 6]
    assert h[0]["sum"] == pytest.approx(43.264)


def test_ramp_compresses_to_its_ends(spark):
    assert [r.value for r in S.compressed(series(spark, range(100)), 0.1).orderBy("us").collect()] == [0.0, 99.0]


def test_delta_and_anomaly(spark):
    d = T.deltas(series(spark, [10, 12, 14, 25, 27]), "name", ["us"], 5.0).orderBy("us").collect()
    assert [r.delta for r in d] == [False, False, False, True, False]
    values = [50 + (0.5 if i % 2 else -0.5) for i in range(20)] + [200]
    assert [r.anomaly for r in T.anomalies(series(spark, values), "name", ["us"], k=2).orderBy("us").collect()][-1]
    assert not T.anomalies(series(spark, [10.0] * 12), "name", ["us"]).where("anomaly").count()


def test_outliers_use_prior_rows(spark):
    rows = T.outliers(series(spark, [*range(45, 56), 100, 0]), "name", ["us"], k=2).orderBy("us").collect()
    assert [r.outlier for r in rows][-2:] == [True, True]


def test_slope(spark):
    s = spark.createDataFrame([("s", 0, 0.0), ("s", 10_000, 100.0)], "name string, us long, value double")
    assert T.slopes(s, "name", 1_000_000, 5.0, "increasing").orderBy("us").collect()[1].change == pytest.approx(10_000)


@pytest.mark.parametrize("values,expected", [
    ([60, 60, 60, 40, 60, 60, 40, 40], ["pending", "firing", "firing", "resolved", "pending", "firing", "resolved", "resolved"]),
    ([60, 40, 60], ["pending", "inactive", "pending"]),
    ([60, 60, 40, 60, 40], ["pending", "firing", "resolved", "pending", "inactive"]),
])
def test_alert_states(spark, values, expected):
    s = AL.states(series(spark, values).withColumn("met", F.col("value") > 50), ["name"], ["us"], "met")
    assert [r.state for r in s.orderBy("us").collect()] == expected


def test_dedup_modes(spark):
    a = spark.createDataFrame([("x", i, "firing") for i in range(3)], "key string, us long, state string")
    assert AL.deduplicated(a, ["key"], ["us"]).count() == 1
    assert AL.deduplicated(a, ["key"], ["us"], compat=True).count() == 2


def test_cooldown_is_greedy(spark):
    a = spark.createDataFrame([("x", t) for t in (0, 6, 10, 12, 19, 20, 45)], "key string, us long")
    assert [r.us for r in AL.cooled(a, ["key"], 10).orderBy("us").collect()] == [0, 10, 20, 45]


def test_keys(spark):
    one = spark.range(1).select(
        L.fingerprint(F.lit("high_cpu"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("f"),
        L.group_key(F.lit("api"), F.create_map(F.lit("service"), F.lit("x")), ["env"]).alias("g"), L.fnv1a_32(F.lit("abc")).alias("h")).first()
    assert (one.f, one.g, one.h) == ("high_cpu{a=1,b=2,}", "api::", 440920331)


def test_names(spark):
    names = ["disk/read bytes", "9lives", "queue:depth%é"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select(L.prometheus_name(F.col("n"))).collect()
    assert [r[0] for r in got] == ["disk_read_bytes", "_9lives", "queue:depth__"]


def test_lines(spark):
    tags = F.create_map(F.lit("method"), F.lit("GET"), F.lit("status"), F.lit("200"))
    one = spark.range(1).select(
        E.prometheus_text(F.lit("http_requests_total"), F.lit(1500), tags, F.lit(1640995200000), F.lit("counter")).alias("p"),
        E.statsd_line(F.lit("request_duration"), F.lit(250), F.lit("timer"), 0.1).alias("s")).first()
    assert one.p.endswith('{method="GET",status="200"} 1500 1640995200000') and "# TYPE http_requests_total counter" in one.p
    assert one.s == "request_duration:250|ms|@0.1"


def test_traceparent(spark):
    h = "00-0af7651916cd43dd8448eb211c80319c-b7ad6b7169203331-01"
    one = spark.range(1).select(L.parsed_traceparent(F.lit(h)).alias("a"), L.parsed_traceparent(F.lit("00-1-2-3")).alias("b")).first()
    assert one.a.trace_id == "0af7651916cd43dd8448eb211c80319c" and one.b is None


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "dependent string, dependency string")


def test_failure_impact_and_cycles(spark):
    e = edges(spark, [("api", "database"), ("frontend", "api"), ("worker", "database")])
    hit = {r.affected for r in graphs.failure_impact(e).where("failed = 'database'").collect()}
    assert hit == {"api", "frontend", "worker"}
    assert graphs.would_cycle(e, "database", "frontend") and not graphs.would_cycle(e, "frontend", "worker")
    order = {r.node: r.place for r in graphs.topological(edges(spark, [("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])).collect()}
    assert order["D"] < order["B"] < order["A"] and order["C"] < order["A"]
    with pytest.raises(ValueError):
        graphs.topological(edges(spark, [("A", "B"), ("B", "C"), ("C", "A")]))


def test_adaptive_levels(spark):
    df = spark.createDataFrame([("x", 0, 30.0, 40.0), ("x", 1, 85.0, 70.0)], "name string, us long, cpu double, memory double")
    assert [r.level for r in folds.adaptive_levels(df, "name", alpha=1.0).orderBy("us").collect()] == ["low", "critical"]


def test_adaptive_levels_carry_state_between_batches(spark):
    rows = [(k, i, float(i * 37 % 101), float(i * 53 % 101)) for k in ("x", "y", None) for i in range(200)]
    df = spark.createDataFrame(rows[::-1], "name string, us long, cpu double, memory double")
    settings = {"margin": 5.0, "cooldown_us": 7}
    want = sorted(tuple(map(str, r)) for r in folds.adaptive_levels(df, "name", **settings).collect())
    alone = [r for k in ("x", "y") for r in folds.adaptive_levels(df.where(df.name == k), "name", **settings).collect()]
    assert sorted(tuple(map(str, r)) for r in alone) == [r for r in want if r[0] != "None"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = folds.adaptive_levels(df, "name", **settings)
        assert sorted(tuple(map(str, r)) for r in out.collect()) == want and len({r[4] for r in want}) > 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_topological_order_is_numbered_in_ranges(spark):
    out = graphs.topological(edges(spark, [(f"a{i:03}", f"b{i % 7}") for i in range(300)]))
    assert [(r.node, r.place) for r in out.orderBy("place").collect()] == [(n, i + 1) for i, n in enumerate([f"b{i}" for i in range(7)] + [f"a{i:03}" for i in range(300)])]
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_degradation_and_bucket(spark):
    calls = spark.createDataFrame([("x", i, ok) for i, ok in enumerate([False] * 3 + [True, True])], "k string, us long, ok boolean")
    assert [r.level for r in folds.degradation(calls, "k", "us", "ok").orderBy("us").collect()] == [0, 0, 1, 0, 0]
    asks = spark.createDataFrame([("x", t * 100_000) for t in range(6)], "k string, us long")
    assert [r.admitted for r in folds.token_bucket(asks, "k", "us", 5.0, 2.0).orderBy("us").collect()] == [True, True, True, False, True, False]


def test_silence_treats_missing_as_empty(spark):
    a = spark.createDataFrame([(1, 5, {"a": "1"}), (2, 5, {"a": "2"})], "id long, us long, labels map<string,string>")
    s = spark.createDataFrame([({"a": "1", "z": ""}, 0, 10)], "matchers map<string,string>, starts_us long, ends_us long")
    assert [r.id for r in AL.silenced(a, s).collect()] == [2]


@pytest.mark.parametrize("kind,compression", [("parquet", "zstd"), ("json", "gzip"), ("csv", None), ("orc", None)])
def test_stores(spark, tmp_path, kind, compression):
    store = storage.create_store(spark, {"target": str(tmp_path / kind), "kind": kind, "compression": compression})
    s = series(spark, [1, 2, 3]).select("name", "us", "value")
    store.append(s)
    store.append(s)
    assert sorted(map(tuple, store.read("name string, us long, value double").collect())) == sorted(map(tuple, s.union(s).collect()))


def test_unknown_store(spark):
    with pytest.raises(ValueError):
        storage.create_store(spark, {"target": "x", "kind": "tape"})
