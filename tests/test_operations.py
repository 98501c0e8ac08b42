"""Small fixtures of rules, notifications, traces, smoothing, sketches and exports."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import config as C
from tidemark.operators import aggregates as A
from tidemark.operators import alerts as AL
from tidemark.operators import derived, graphs
from tidemark.operators import series as S
from tidemark.plans import registry
from tidemark.sources import encoders as E

SPANS = "trace_id long, span_id long, parent_span_id long, start_us long"


def test_deep_traces_orphans_and_circles(spark):
    chain = [(1, i, i - 1 if i else None, i) for i in range(40)]
    rows = [*chain, (2, 5, 99, 0), (2, 6, 5, 1), (3, 1, 2, 0), (3, 2, 1, 1), (3, 3, 2, 2), (4, 7, None, 0)]
    got = {(r.trace_id, r.span_id): r.depth for r in graphs.trace_tree(spark.createDataFrame(rows, SPANS)).collect()}
    assert got == {(1, i): i for i in range(40)} | {(2, 5): 0, (2, 6): 1, (4, 7): 0}
    assert graphs.trace_tree(spark.createDataFrame([], SPANS)).count() == 0


def test_bounded_traces(spark):
    rows = [(t, s, None, 10 * t + s) for t in range(6) for s in range(5)]
    got = graphs.capped_spans(spark.createDataFrame(rows, SPANS), ["start_us"], most_spans=3, most_traces=2)
    assert sorted((r.trace_id, r.span_id) for r in got.collect()) == [(t, s) for t in (4, 5) for s in (0, 1, 2)]


@pytest.mark.parametrize("alpha", [0.01, 0.7, 1.0])
@pytest.mark.parametrize("width", [7, 1_000_000])
def test_smoothing_from_the_first_row(spark, alpha, width):
    values = [100.0] + [0.0] * 99 + [float(i * 37 % 11) for i in range(50)]
    df = spark.createDataFrame([(k, i, v) for k in ("a", None) for i, v in enumerate(values)], "name string, us long, value double")
    want, s = [], None
    for v in values:
        s = v if s is None else alpha * v + (1 - alpha) * s
        want.append(s)
    got = S.smoothed(df, "name", ["us"], alpha, width).collect()
    for k in ("a", None):
        assert [r.smoothed for r in sorted(got, key=lambda r: r.us) if r.name == k] == pytest.approx(want, rel=1e-12, abs=1e-12)


def test_previous_rows_across_slices(spark):
    df = spark.createDataFrame([("a", t, float(t)) for t in (1, 2, 11, 35, 36)] + [(None, 3, 1.0), (None, 33, 2.0)], "name string, us long, value double")
    got = {(r.name, r.us): r.previous and r.previous.value for r in S.with_previous(df, "name", ["us"], ["value"], 10).collect()}
    assert got == {("a", 1): None, ("a", 2): 1.0, ("a", 11): 2.0, ("a", 35): 11.0, ("a", 36): 35.0, (None, 3): None, (None, 33): 1.0}


def test_notifications_start_again_after_silence(spark):
    states = ["pending", "firing", "firing", "firing", "resolved", "pending", "firing"]
    df = spark.createDataFrame([("a", 10 * i, s) for i, s in enumerate(states)], "name string, us long, state string")
    sent = lambda d: sorted(r.us for r in AL.notifications(d, ["name"], ["us"], 20).collect())
    assert sent(df) == [10, 30, 40, 60]
    assert sent(df.where("us <> 10")) == [20, 40, 60]


def test_groups_wait_and_count_once(spark):
    df = spark.createDataFrame([(t, t, f) for t, f in ((0, "x"), (3, "y"), (6, "x"), (8, "z"), (20, "x"))], "us long, id long, fingerprint string").withColumn("k", F.lit(1))
    assert [(r.us, r["size"]) for r in AL.group_flushes(df, ["k"], 5, 10).orderBy("us").collect()] == [(6, 2), (20, 3)]


def test_pool_rejections_and_settings(spark):
    row = spark.sql("SELECT 0.1D AS saturation, 0.95D AS utilisation, 0.0D AS failures, 0.02D AS rejections, 0 AS wait_ms")
    one = derived.pool_issues(row).first()
    assert one.issues == ["utilisation:critical", "rejections:warning"] and one.health == "unhealthy"
    assert derived.pool_issues(row.drop("rejections")).first().issues == ["utilisation:critical"]
    t = lambda x: F.lit(x)
    one = spark.range(1).select(
        C.duration_us(t("2h"), 1).alias("a"), C.duration_us(t("x"), 1).alias("b"), C.duration_us(t("1.9 MIN"), 1).alias("c"), C.boolean(t(" On "), False).alias("d"), C.boolean(t("?"), True).alias("e"),
        C.clamped(t("9"), 1, 2, 5).alias("f"), C.items(t("a, ,b")).alias("g"), C.matching(t("ab"), "-", "a").alias("h"), C.duration_us(F.lit(None).cast("string"), 4).alias("i")).first()
    assert tuple(one) == (7_200_000_000, 1, 60_000_000, True, True, 5.0, ["a", "b"], "-", 4)


def test_sketched_percentiles_are_near(spark):
    df = spark.range(100_000).withColumn("v", F.col("id").cast("double"))
    got, exact = (df.agg(A.percentiles(F.col("v"), exact=e)).first()[0] for e in (False, True))
    assert all(abs(a - b) <= 100 for a, b in zip(got, exact, strict=True))


def test_formats(spark):
    with pytest.raises(ValueError, match="tape"):
        E.exported(spark.range(1), "tape")
    df = spark.createDataFrame([("hits_total", 3, {"a": "b"}, 5)], "name string, value long, tags map<string,string>, us long")
    assert {f: E.exported(df, f).first().text.split("\n")[-1] for f in ("influx", "statsd", "prometheus")} == {"influx": "hits_total,a=b value=3 5000", "statsd": "hits_total:3|c|#a:b", "prometheus": 'hits_total{a="b"} 3 0'}
    assert '"isMonotonic":true' in E.exported(df, "otlp").first().text


def test_all_statements_have_queries():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
