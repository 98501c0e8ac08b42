"""Derived metrics, buffers, collectors and streams on small fixtures."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import buffers, derived
from tidemark.sources import collectors, storage
from tidemark.sources import encoders as E
from tidemark.streaming import jobs


def test_findings(spark):
    long = spark.createDataFrame([("cpu", 74.9), ("cpu", 75.0), ("disk", 95.0), ("other", 99.0)], "name string, value double")
    assert sorted((r.name, r.level) for r in derived.findings(long).collect()) == [("cpu", "warning"), ("disk", "critical")]


def test_percent_guards_zero(spark):
    assert spark.range(1).select(derived.percent(F.lit(3), F.lit(0)).alias("p")).first().p == 0.0


def test_adaptive_batches_change_with_load(spark):
    rows = [("x", i, 90.0 if 4 <= i < 8 else 10.0) for i in range(12)]
    b = buffers.adaptive(spark.createDataFrame(rows, "k string, us long, load double"), "k", ["us"], "load", 2, 4).orderBy("us").collect()
    sizes = [len(list(g)) for _, g in __import__("itertools").groupby(r.batch for r in b)]
    assert sizes == [2, 2, 4, 2, 2]


def test_overflow_keeps_the_highest(spark):
    df = spark.createDataFrame([("x", i, i % 3) for i in range(9)], "k string, us long, p int")
    assert sorted(r.us for r in buffers.kept(df, ["k"], ["us"], 3, "drop_lowest", "p").collect()) == [2, 5, 8]
    with pytest.raises(ValueError):
        buffers.kept(df, ["k"], ["us"], 3, "block")


def test_dead_letters(spark):
    good, bad = buffers.dead_letters(spark.createDataFrame([(1, "2.5"), (2, "x"), (3, None)], "id long, v string"), "v", 1, ["id"])
    assert [tuple(r) for r in good.collect()] == [(1, 2.5)] and [r.id for r in bad.collect()] == [3]


def test_custom_analysis(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "k string, v double")
    def spread(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [rows.k.iloc[0]], "spread": [rows.v.max() - rows.v.min()]})
    assert sorted(map(tuple, derived.analysed(df, ["k"], spread, "k string, spread double").collect())) == [("a", 2.0), ("b", 0.0)]


def test_collectors_make_a_union(spark):
    a = collectors.collect(spark, "tidemark.sources.collectors:ramp", 3, rows="7")
    b = spark.createDataFrame([("own", 5)], "name string, extra int")
    both = storage.collected(a, b)
    assert both.count() == 8 and both.columns == ["name", "us", "value", "extra"]


def test_exporter_labels(spark):
    df = spark.createDataFrame([("m", 1.0, {"env": "prod", "component": "tagged"})], "name string, value double, tags map<string,string>")
    labels = E.exporter_rows(df, "component", F.lit("web"), {"env": "default", "zone": "z"}, "host1").first().labels
    assert labels == {"component": "tagged", "env": "prod", "zone": "z", "instance": "host1"}


def test_baggage(spark):
    m = F.create_map(F.lit("user"), F.lit("7"))
    one = spark.range(1).select(E.baggage_headers(m).alias("h"), E.extracted_baggage(E.baggage_headers(m)).alias("b")).first()
    assert one.h == {"baggage-user": "7"} and one.b == {"user": "7"}


def test_stream_states_survive_batches(spark, tmp_path):
    for i, on in enumerate([True, True, False, True]):
        spark.createDataFrame([("x", i * 10, on)], "name string, us long, met boolean").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    files = sorted((tmp_path / "in").glob("*/*.parquet"), key=lambda p: int(p.parent.name))
    flat = tmp_path / "flat"
    flat.mkdir()
    for i, f in enumerate(files):
        f.rename(flat / f"{i}.parquet")
    schema = spark.read.parquet(str(flat)).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(flat))
    got = jobs.run_available(jobs.alert_states(stream, "name", "us", "met"), str(tmp_path / "out"))
    assert [(r.us, r.state) for r in got.orderBy("us").collect()] == [(0, "pending"), (10, "firing"), (20, "resolved"), (30, "pending")]
