"""Embeddings, neighbours, archives, URLs: brute force, odd rows, empty tables."""

import base64
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, embed_dedup, queries, urlfilter, warc
from tidemark.llm.common import range_cuts, shared_dir
from tidemark.llm.components import connected_components

from .helpers import SF, duck, roots

VECTORS = "vec_id long, embedding array<float>, label int, c string, l string, links int, cell int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], VECTORS)


def clouds(n=400, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 10, dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 0.12
    x[: n // 8] = x[0]  # copies
    x[n // 8 : n // 8 + 5] = x[0] * 2.5  # equal directions
    return [(i, [float(np.float32(v)) for v in row], int(i % 3)) for i, row in enumerate(x)]


ODD = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [None] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, [float("inf")] + [1.0] * 15, 1), (1005, [1.0] * 16, None), (1006, [1.0] * 4, 1), (None, [1.0] * 16, 2), (1007, [1.0] * 16, 2), (1007, [1.0] * 16, 2), (1008, [], 1)]


@pytest.mark.parametrize("block", [2048, 16])
def test_embedding_links(spark, block):
    rows = clouds() + ODD
    x = [np.array(r[1], dtype=float) if r[1] and None not in r[1] else None for r in rows]
    ok = [v is not None and np.isfinite(v).all() and v.any() and r[2] is not None for v, r in zip(x, rows, strict=True)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.98]
    degree = np.bincount(np.array(pairs).ravel(), minlength=len(rows))
    part = roots(len(rows), pairs)
    ids = {}
    for i, p in enumerate(part):
        if rows[i][0] is not None:
            ids[p] = min(ids.get(p, 1 << 60), rows[i][0])
    want = sorted((r[0], int(degree[i]), ids[part[i]]) for i, r in enumerate(rows) if r[0] is not None)
    got = embed_dedup.near_duplicates(vectors(spark, rows), block=block).collect()
    assert len(got) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_no_embeddings(spark):
    assert embed_dedup.near_duplicates(vectors(spark, [])).count() == 0
    assert [tuple(r) for r in embed_dedup.near_duplicates(vectors(spark, ODD[:3])).orderBy("vec_id").collect()] == [(i, 0, i, True) for i in (1000, 1001, 1002)]
    assert ann.nearest_neighbours(vectors(spark, ODD[:3]), F.lit(True)).count() == 0


def near(rows, q, k=10):
    ok = [r for r in rows if r[0] is not None and r[1] and len(r[1]) == 16 and None not in r[1] and np.isfinite(r[1]).all() and np.any(r[1])]
    d = sorted({(float(np.sqrt(((np.array(r[1]) - np.array(q[1])) ** 2).sum())), r[0]) for r in ok if r[0] != q[0]})
    return d[:k]


@pytest.mark.parametrize("settings", [{"probe": 1.0}, {"probe": 1.0, "block": 20, "query_block": 3, "centroids": 4}, {"recall": 1.0}])
def test_all_neighbours_when_all_cells_are_visited(spark, settings):
    rows = clouds() + ODD
    got = ann.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, **settings).collect()
    for q in rows:
        if q[0] is not None and q[0] % 50 == 0 and q[0] < 1000:
            mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q[0])
            assert [r[1] for r in mine] == [v for _, v in near(rows, q)] and [r[0] for r in mine] == list(range(1, 11))
            assert np.allclose([r[2] for r in mine], [d for d, _ in near(rows, q)], rtol=0, atol=1e-12)


@pytest.mark.parametrize("often", [2, 20])
def test_repeated_rows_take_no_slots(spark, often):
    rows = clouds()
    more = rows * 2 if often == 2 else rows + rows[:1] * 19
    got = ann.nearest_neighbours(vectors(spark, more), F.col("vec_id") % 50 == 0, probe=1.0).collect()
    for q in rows[::50]:
        assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q[0]] == [v for _, v in near(rows, q)]


def test_few_candidates(spark):
    got = ann.nearest_neighbours(vectors(spark, clouds()[:4]), F.col("vec_id") == 0).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (2, 2), (3, 3)]


@pytest.mark.parametrize("settings", [{}, {"tried": 8, "block": 64, "query_block": 7}])
def test_recall_with_partial_visits(spark, settings):
    rows = clouds(4000, seed=9)
    got = ann.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, centroids=16, **settings).collect()
    hits = sum(len({r.vec_id for r in got if r.query_id == q[0]} & {v for _, v in near(rows, q)}) for q in rows[::50])
    assert hits / (10 * len(rows[::50])) >= 0.9


def test_few_cells_are_visited_where_rows_cluster():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(3200, 16)) * 0.01
    parts = [(slice(0, 8), ann.lloyd(x[:, :8], 32)), (slice(8, None), ann.lloyd(x[:, 8:], 32))]
    cell = ann.nearest_centre(x[:, :8], parts[0][1]) * 32 + ann.nearest_centre(x[:, 8:], parts[1][1])
    counts = np.bincount(cell, minlength=1024)
    d = [ann.centre_distances(x[:1, s], c)[0] for s, c in parts]
    asked = ann.needed(*d, counts, cell[:10].tolist())
    assert max(asked) < 320
    for n, c in zip(asked, cell[:10].tolist(), strict=True):
        assert c in ann.traverse(*d, counts, n) and (n == 1 or c not in ann.traverse(*d, counts, n - 1))


def test_neighbour_query_against_brute_force(spark):
    folder = SF.replace("0.001", "0.01")
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, x = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], dtype=float)
    got = {}
    for r in queries.op9_nearest_neighbours(spark, folder).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:10]
        mine = sorted(got.pop(int(ids[i])))
        assert [r for r, _, _ in mine] == list(range(1, 11)) and all(abs(s - d[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in mine)
        assert [(s, v) for _, v, s in mine] == sorted((s, v) for _, v, s in mine)
        hits += len({v for _, v, _ in mine} & set(ids[order].tolist()))
    assert not got and hits >= 0.9 * 10 * len(np.flatnonzero(ids % 100 == 0))


def test_heap_walks_in_order():
    a, b = np.array([3.0, 1.0, 2.0]), np.array([0.5, 0.1])
    assert ann.traverse(a, b, np.ones(6, int), 6) == sorted(range(6), key=lambda c: a[c // 2] + b[c % 2])
    assert ann.traverse(a, b, np.array([0, 0, 5, 5, 5, 5]), 7) == [3, 2]


PAGES = "page_id long, url string, html string, sha1 string, shard int, kind int"
ROWS = [(3, "http://a/x", "<p>same</p>"), (1, "http://a/ü y\r\n", "<p>same</p>"), (2, None, None), (4, "u", ""), (5, "v", "Ä" * 50_000), (5, "v", "Ä" * 50_000), (None, "w", "<p>same</p>"), (6, "q", "only"), (None, None, None), (7, "z", "two")]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], PAGES)


@pytest.mark.parametrize("settings", [{}, {"shards": 3, "max_file_bytes": 200}, {"least_bytes": 5}])
def test_warc_round_trip(spark, settings):
    folder = shared_dir(spark, "w")
    manifest = warc.write_warc(pages(spark), folder, **settings)
    got = warc.read_warc(spark, folder).collect()
    assert manifest["records"] == len(got) == len(ROWS)
    least = settings.get("least_bytes", 0)
    first, seen = {}, set()
    for i, _, html in ROWS:
        if i is not None:
            first[html or ""] = min(first.get(html or "", 1 << 60), i)
    want = []
    for i, _, html in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (html or "").encode()
        to = first.get(html or "") if len(data) >= least and (i != first.get(html or "") or (i, html) in seen) else None
        seen.add((i, html))
        want.append((i or -1, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to or -1))
    assert sorted((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got) == sorted(want)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)


def test_warc_files_are_the_same_again(spark):
    one, two = (warc.write_warc(pages(spark).repartition(n), shared_dir(spark, "w"), shards=3, max_file_bytes=300) for n in (1, 4))
    assert one == two and len(one["files"]) > 3


def test_empty_warc(spark):
    folder = shared_dir(spark, "w")
    assert warc.write_warc(pages(spark, []), folder)["files"] == [] and warc.read_warc(spark, folder).count() == 0


def test_damage_is_noticed(spark):
    folder = shared_dir(spark, "w")
    manifest = warc.write_warc(pages(spark), folder, shards=1)
    name = f"{folder}/{manifest['files'][0]['name']}"
    data = open(name, "rb").read()
    open(name, "wb").write(data[: len(data) - 9])
    with pytest.raises(Exception, match="ends inside|Error"):
        warc.read_warc(spark, folder).collect()


def test_cuts_depend_on_the_rows_alone(spark):
    df = spark.range(10_000).withColumnRenamed("id", "k")
    assert range_cuts(df, "k", 8) == range_cuts(df.repartition(7), "k", 8)
    assert range_cuts(df.limit(0), "k", 8) == []


LINKS = [
    (1, "http://a.org/x", "<a href='http://b.net/'>"), (2, "http://b.net/q", '<a href="//c.net/x"><a href="/rel">'), (3, "http://c.net", "<a href=http://evil.com/de/>"), (4, "HTTP://EVIL.com/de/1", ""),
    (5, "nohost", None), (6, None, None), (7, "http://x.example.org/es/1", ""), (8, "http://example.org/en/123?x", ""), (9, "http://EXAMPLE.org/en/2#y", ""), (10, "http://d.net/", "<a href='http://evil.com/'>"),
    (10, "http://d.net/", "<a href='http://evil.com/'>"), (None, "https://e.net?x://", "<img src='https://b.net/i'>"),
]


def brute_ranks(links, seeds, rounds=12, damping=0.85):
    hosts = {h for e in links for h in e} | set(seeds)
    out = {h: sum(n for (a, _), n in links.items() if a == h) for h in hosts}
    rank = {h: (1 - damping) * seeds.get(h, 0.0) for h in hosts}
    for _ in range(rounds):
        new = {h: (1 - damping) * seeds.get(h, 0.0) for h in hosts}
        for (a, b), n in links.items():
            new[b] += damping * rank[a] * n / out[a]
        rank = new
    return rank


@pytest.mark.parametrize("few", [True, False])
def test_url_verdicts(spark, monkeypatch, few):
    monkeypatch.setattr(urlfilter, "BROADCAST_HOSTS", 1000 if few else 0)
    df = spark.createDataFrame([(*r, "h", "p") for r in LINKS], "page_id long, url string, html string, host string, path string")
    got = urlfilter.judge(df).collect()
    assert len(got) == len(LINKS)
    links = {("a.org", "b.net"): 1, ("b.net", "c.net"): 1, ("c.net", "evil.com"): 1, ("d.net", "evil.com"): 2, ("e.net", "b.net"): 1}
    good = brute_ranks(links, {"a.org": 1.0, "example.org": 1.0})
    bad = brute_ranks({(b, a): n for (a, b), n in links.items()}, {"evil.com": 1.0, "x.example.org": 1.0, "example.org": 1.0})
    for r in got:
        assert r.trust == pytest.approx(good.get(r.host, 0.0)) and r.distrust == pytest.approx(bad.get(r.host, 0.0))
        if r.rule is None:
            assert r.verdict == ("block" if r.distrust > r.trust else "allow")
    rules = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert rules[4] == ("evil.com", "/de/1", "com/de/", "block") and rules[7][2:] == ("example.org/es/", "block") and rules[8][2:] == ("example.org/en/1", "block")
    assert rules[9] == ("example.org", "/en/2", "org/", "allow") and rules[5] == rules[6] == ("", "", None, "allow") and rules[None][:2] == ("e.net", "")
    assert urlfilter.judge(df.limit(0)).count() == 0


def test_verdicts_reach_the_end_of_a_long_chain(spark):
    rows = [(i, f"http://h{i}.net/", f"<a href='http://h{i + 1}.net/'>") for i in range(16)] + [(16, "http://h16.net/", "<a href='http://evil.com/'>"), (17, "http://evil.com/de/1", "")]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(17):
        assert got[i].verdict == "block" and got[i].distrust == pytest.approx(0.15 * 0.85 ** (17 - i))


def test_components(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(400, 480)]
    df = spark.createDataFrame([*pairs, (None, 3), (7, 7)], "x long, y long")
    got = {r.node: r.root for r in connected_components(df, "x", "y").collect()}
    part = roots(500, pairs)
    want = {n: part[n] for a, b in pairs if a != b for n in (a, b)}
    assert got == want


def test_manifest_is_json(spark):
    folder = shared_dir(spark, "w")
    warc.write_warc(pages(spark), folder)
    assert json.load(open(f"{folder}/manifest.json"))["version"] == 1
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
