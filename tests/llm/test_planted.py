"""Planted links, host graphs and hot keys, which the driver's tables lack, against the queries' own SQL or brute force."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, embed_dedup, mixing, queries, simhash, urlfilter, warc
from tidemark.llm.components import connected_components


def planted(n=2500, dim=32, seed=7):
    """Vectors with partners at cosines just below, at about and just above 0.98, in chains and groups."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    out, label = [], []
    for i, v in enumerate(x):
        v = v / np.linalg.norm(v)
        out.append(v)
        label.append(i % 5)
        for cosine in ((0.979, 0.9799, 0.9801, 0.981, 0.99, 1.0)[i % 6],) * (1 + i % 3):
            w = rng.normal(size=dim)
            w -= (w @ v) * v
            w /= np.linalg.norm(w)
            out.append((cosine * v + np.sqrt(1 - cosine * cosine) * w) * rng.uniform(0.5, 2))
            label.append(i % 5 if i % 11 else None)
    return [(i, [float(np.float32(c)) for c in v], lab) for i, (v, lab) in enumerate(zip(out, label, strict=True))]


@pytest.mark.parametrize("settings", [{}, {"block": 64}, {"pivots": 64, "block": 40}])
def test_planted_links_against_the_sql(spark, tmp_path, settings):
    rows = planted(2500 if not settings else 800)
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    want = {r[0]: (r[1], r[2]) for r in con.sql(f"SELECT vec_id, n_links, component_id FROM ({queries.OP1_SQL})").fetchall()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "e")), **settings).collect()}
    assert sum(n for n, _ in want.values()) > 800 and got == want


def test_split_lists_lose_few_links(spark):
    """Lists that are much longer than a block, of vectors that share one hot pivot and differ in the others: at most a link in a thousand is lost."""
    rng = np.random.default_rng(3)
    base = np.concatenate([np.ones((1500, 1)) * 0.9, rng.normal(size=(1500, 23)) * 0.25], axis=1)
    near = base + rng.normal(size=base.shape) * 0.02
    x = np.concatenate([base, near]).astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.98
    np.fill_diagonal(links, False)
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df, pivots=256, block=100).collect()}
    assert links.sum() > 2500 and sum(got.values()) >= 0.999 * links.sum() and all(got[i] <= n for i, n in enumerate(links.sum(axis=1).tolist()))


def graph(seed=5, hosts=400):
    rng = np.random.default_rng(seed)
    names = ["seed.org", "bad.com", "x.example.org", *[f"h{i}.net" for i in range(hosts)], "hub.net"]
    paths = {"seed.org": "/", "bad.com": "/de/1", "x.example.org": "/es/2"}
    rows = []
    for k in range(3 * hosts):
        a = names[int(rng.integers(len(names)))]
        to = [names[int(j)] for j in rng.integers(0, len(names), rng.integers(0, 4))]
        rows.append((len(rows), f"http://{a}{paths.get(a, f'/p{k}')}", "".join(f"<a href='http://{t}/'>" for t in to)))
    rows += [(len(rows) + i, f"http://hub.net/{i}", f"<a href='//{n}/'>") for i, n in enumerate(names)]
    return rows


def test_host_graph_against_converged_ranks(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "HOT", 20)
    rows = graph()
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string"), tolerance=1e-7).collect()
    con = duckdb.connect()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").toPandas()  # noqa: F841
    con.sql("CREATE TABLE pages AS SELECT * FROM frame")
    want = {r[0]: r[1] for r in con.sql(f"SELECT page_id, verdict FROM ({queries._op8_sql(rounds=80)})").fetchall()}
    verdicts = {r.page_id: r.verdict for r in got}
    free = [r for r in got if r.rule is None]
    assert len(got) == len(rows) and len({r.verdict for r in free}) == 2 and sum(r.trust > 0 and r.distrust > 0 for r in free) > 200
    close = {r.page_id for r in got if r.rule is None and abs(r.trust - r.distrust) < 1e-6}
    assert not close and verdicts == want


def test_hosts_of_many_dots(spark):
    df = spark.createDataFrame([(1, "http://" + "." * 100_000 + "org/", ""), (2, "http://" + "a." * 100_000 + "example.org/es/", ""), (3, "http://.org./", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in urlfilter.judge(df).select("page_id", "rule", "verdict").collect()}
    assert got == {1: ("org/", "allow"), 2: ("example.org/es/", "block"), 3: (None, "allow")}


def test_a_key_with_most_rows_is_spread(spark):
    left = spark.range(10_000).select("id", F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(-1).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    out = common.spread_join(left, right, "k", "n", "id", most=500)
    assert sorted(map(tuple, out.collect())) == sorted((k, i, 9999 if k < 0 else i) for i in range(10_000) for k in [i if i % 10 == 0 else -1])
    assert sorted(out.columns) == ["id", "k", "top"]


def test_nothing_is_broadcast_by_an_estimate(spark, monkeypatch):
    """Anchors that a fingerprint visits, components of all documents and keys beyond the counted number are shuffled, however low Spark sizes them."""
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    prints = spark.range(3000).select(F.xxhash64("id").alias("p"))
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("some own words "), "id").alias("text"))
    keyed = spark.range(300).select("id", (F.col("id") % 30).alias("k"))
    spread = common.spread_join(keyed, keyed.groupBy("k").agg(F.count("*").alias("n")), "k", "n", "id")
    for df in (simhash.near_prints(prints, "p"), spread, simhash.with_components(docs), simhash.drop_near_duplicates(docs)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        kinds = [line for line in plan.splitlines() if "HashJoin" in line or "SortMergeJoin" in line]
        assert any("SortMergeJoin" in k for k in kinds) and all("LeftOuter" in k for k in kinds if "Broadcast" in k)  # the counted hot keys


def test_hot_roots_and_prints(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 100)
    star = spark.createDataFrame([(0, i) for i in range(1, 2000)] + [(5000 + i, 5001 + i) for i in range(60)], "x long, y long")
    got = {r.node: r.root for r in connected_components(star, "x", "y").collect()}
    assert got == {i: 0 for i in range(2000)} | {5000 + i: 5000 for i in range(61)}
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 > 0, "").otherwise(F.concat(F.lit("some own words "), "id")).alias("text"))
    parts = {r.doc_id: r.component_id for r in simhash.with_components(docs).collect()}
    assert all(parts[i] == 1 for i in range(3000) if i % 10) and len(parts) == 3000


def test_hot_digest(spark):
    rows = [(i, f"http://a/{i}", "" if i % 10 else f"page {i}") for i in range(2000)]
    folder = common.shared_dir(spark, "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {r.page_id: r.refers_to for r in warc.read_warc(spark, folder, with_payload=False).collect()}
    assert got == {i: (1 if i % 10 and i > 1 else None) for i in range(2000)}


def test_rows_without_ids_are_mixed(spark):
    texts = [" ".join("w" * (1 + i % 5) for _ in range(i % 23)) for i in range(3000)]
    df = spark.createDataFrame([(None if i % 10 else i, t, "ab"[i % 2]) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    assert len(got) == 3000 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    for s in "ab":
        assert sum(r.taken for r in got if r.source == s) == int(next(r.target for r in got if r.source == s))
    ordered = [r.position for r in mixing.in_order(mixing.mix(df)).collect()]
    placed = [p for p in ordered if p is not None]
    assert placed == sorted(placed) and ordered[len(placed):] == [None] * (3000 - len(placed))


def test_rows_without_or_with_equal_ids_keep_the_budget(spark):
    ids = [None if i % 3 == 0 else i % 7 if i % 3 == 1 else i for i in range(900)]
    rows = [(i, " ".join(f"w{n}" for _ in range(1 + n % 13)), "ab"[n % 4 == 0], n) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, number long").repartition(5)
    targets = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    got = mixing.mix_documents(df).collect()
    for s in "ab":
        words = sum(len(r.text.split()) for r in got if r.source == s)
        assert abs(words - targets[s]) <= 2 * 13
    times = {}
    for r in got:
        times[r.number] = times.get(r.number, 0) + 1
    assert max(times.values()) <= 2 and {tuple(r) for r in got} <= set(rows)


def test_a_chain_of_hosts_and_links_that_stay(spark, monkeypatch):
    """Trust runs down a chain of 200 hosts, each round's join leaves the links where they are."""
    names = ["seed.org", *[f"h{i}.net" for i in range(200)]]
    edges = spark.createDataFrame([(a, b, 1) for a, b in zip(names, names[1:], strict=False)], "src string, dst string, links long")
    seeds = spark.createDataFrame([("seed.org", 10.0)], "host string, seed double")
    plans = []
    keep = urlfilter.checkpointed

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(urlfilter, "checkpointed", noted)
    got = {r.host: r.rank for r in urlfilter.propagate(edges, seeds, "src", "dst", 0.85, 1e-2).collect()}
    for i, name in enumerate(names[:16]):
        assert got[name] == pytest.approx(1.5 * 0.85**i)
    assert len(got) < 25 and len(plans) > 15
    for plan in plans[2:]:  # of the totals, of what is sent (twice) and of the sums, not of the links
        links = plan[: plan.index("onto", plan.index("Scan ExistingRDD"))].splitlines()
        assert plan.count("Exchange hashpartitioning") == 4 and "Exchange" not in links[-2] + links[-3]


def test_cuts_of_repeated_keys(spark):
    few = spark.range(10_000).select((F.col("id") % 3).alias("k"))
    assert common.range_cuts(few, "k", 4) == sorted(set(common.range_cuts(few, "k", 4))) and set(common.range_cuts(few, "k", 4)) <= {0, 1, 2}
    many = spark.range(50_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    cuts = common.range_cuts(many, "k", 8, 8)
    assert len(cuts) == 7 and all(abs(c - 50_000 * (i + 1) / 8) < 15_000 for i, c in enumerate(cuts))
