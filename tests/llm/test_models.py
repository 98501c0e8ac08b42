"""Whitening, clustering and the hidden Markov model against numpy and plain loops; odd rows, copies, empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from tidemark.llm import clustering, hmm, queries, whitening

from .helpers import SF, duck, empty, odd

VECTORS = "vec_id long, embedding array<float>, label int, x int, owner string, n string, component int, cluster int"
BAD = [None, [None] * 64, [float("nan")] * 64, [float("inf")] + [1.0] * 63, [1.0] * 4, []]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", "y", 3, 4) for i, v in rows], VECTORS)


def clouds(n=600, dim=64, seed=5):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(12, dim))[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.3).astype(np.float32)
    x[: n // 3] = x[0]  # a hot vector
    x[n // 3] = 0
    return [(i, v.tolist()) for i, v in enumerate(x)]


def check_whitening(rows, got, components=4):
    x = np.floor(256 * np.array([v for _, v in rows], dtype=np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == components * len(rows)
    for c in range(components):
        found = sorted((r for r in got if r.component == c + 1), key=lambda r: r.vec_id)
        want = (x - sums / n) @ vectors[:, c] / np.sqrt(values[c])
        y = np.array([r.whitened for r in found])
        assert np.allclose(y, want, atol=1e-9) or np.allclose(y, -want, atol=1e-9)
        assert [r.deviation for r in found] == deviation.tolist()
        assert all(r.n == n and r.explained == pytest.approx(values[c] / values.sum()) and r.identity_error < 1e-9 for r in found)


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_whitening(spark, parts):
    rows = clouds()
    df = vectors(spark, rows + [(2000 + i, b) for i, b in enumerate(BAD)]).repartition(parts)
    check_whitening(rows, whitening.whiten(df).collect())


def test_whitening_of_the_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, queries.op11_whitening(spark, SF).collect())


def test_merged_moments_are_those_of_all():
    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (500, 6)) + 10**9  # a mean far from zero
    parts = [whitening.Moments.of(p) for p in np.split(x, [1, 2, 90, 400])]
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    exact = sum(np.outer(v, v) for v in (500 * x - x.sum(axis=0)).astype(object)) / 500**2
    assert total.n == 500 and total.sums == x.sum(axis=0).tolist() and np.allclose(total.scatter, exact.astype(float), rtol=1e-9, atol=1e-4)


def test_whitening_without_variance(spark):
    same = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [1.0])])).collect()
    assert sorted((r.vec_id or 0, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same) == [(i, c, 1, 0, None, None, None) for i in (0, 1, 2) for c in (1, 2)]
    line = whitening.whiten(vectors(spark, [(i, [float(i % 5), 1.0, 0.0, 0.0, 0.0]) for i in range(50)])).collect()
    assert {r.component for r in line if r.whitened is None} == {2, 3, 4} and len(line) == 200 and all(r.identity_error < 1e-9 for r in line)
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 3.0]), (3, [1e9, 1.0])])).collect()
    assert len(huge) == 6 and {r.deviation is None for r in huge if r.vec_id < 3} == {True}
    none = whitening.whiten(vectors(spark, [(i, b) for i, b in enumerate(BAD[:4])]))
    assert none.count() == 0 and whitening.whiten(vectors(spark, [])).columns == none.columns


def lloyd(rows, k=40, rounds=5):
    x = np.array([np.floor(256 * np.array(v, dtype=np.float32).astype(float)) for _, v in rows]).astype(np.int64)
    first = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"2:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[first]
    for turn in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        owner = d.argmin(axis=1)
        if turn < rounds:
            c = np.stack([np.floor_divide(x[owner == i].sum(axis=0), (owner == i).sum()) if (owner == i).any() else c[i] for i in range(len(c))])
    return owner, d.min(axis=1), c


@pytest.mark.parametrize("block", [4096, 7])
def test_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(clustering, "BLOCK", block)
    rows = clouds()
    got = sorted(clustering.cluster(vectors(spark, rows + [(2000 + i, b) for i, b in enumerate(BAD)]).repartition(5)).collect(), key=lambda r: r.vec_id)
    owner, distance, c = lloyd(rows)
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c.tolist()]
    sums = [int(distance[owner == i].sum()) for i in range(40)]
    assert [tuple(r) for r in got] == [(i, o, d, sums[o], int(distance.sum()), names[o]) for i, (o, d) in enumerate(zip(owner.tolist(), distance.tolist(), strict=True))]


def test_clusters_against_the_sql(spark):
    got = {tuple(r) for r in queries.op12_clustering(spark, SF).collect()}
    assert got == set(duck().sql(queries.ORACLE_SQL["op12_clustering"]).fetchall()) and len(got) == 500


def test_few_and_no_vectors(spark):
    got = clustering.cluster(vectors(spark, [(5, [0.5] * 64), (5, [0.25] * 64), (None, [0.5] * 64), (7, [1e30] * 64), (8, [-1e30] * 64)]))
    rows = got.collect()
    assert len(rows) == 5 and all(r.distance == 0 and r.inertia == 0 for r in rows) and len({r.cluster for r in rows}) == 4
    assert [r.vec_id for r in rows if r.centroid_sha256 == next(n.centroid_sha256 for n in rows if n.vec_id is None)].count(5) == 1
    nameless = clustering.cluster(vectors(spark, [(None, [0.5] * 64), (None, [0.5] * 64)])).collect()
    assert [tuple(r) for r in nameless] == [(None,) * 6] * 2
    assert clustering.cluster(vectors(spark, [])).columns == got.columns and clustering.cluster(vectors(spark, [(1, None)])).count() == 0


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (9, 64))
    want = [[sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c.tolist()] for v in x.tolist()]
    assert clustering.distances(x, c).tolist() == want and clustering.distances(x % 1000, c % 1000).tolist() == [[sum((a % 1000 - b % 1000) ** 2 for a, b in zip(v, m, strict=True)) for m in c.tolist()] for v in x.tolist()]


def tokens(text):
    lower = "".join(chr(ord(ch) + 32) if "A" <= ch <= "Z" else ch for ch in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), hmm.END]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def brute_force(docs, states, rounds, own, weight):
    """Counts, Baum-Welch and scores by plain loops over probabilities (texts here are short)."""
    texts = [(i, held(i), tokens(t)) for i, t in docs]
    counts = {}
    for _, h, ws in texts:
        for w in () if h else ws:
            counts[w] = counts.get(w, 0) + 1
    ranked = sorted(counts, key=lambda w: (w != hmm.END, -counts[w], w.encode()))
    total, distinct = sum(counts.values()), len(counts)
    space = total + distinct + 1
    row = {w: i for i, w in enumerate(ranked[:own])}
    prior = [(counts[w] + 1) / space for w in ranked[:own]]
    prior.append(1 - sum(prior))
    rare = space - sum(counts[w] + 1 for w in ranked[:own])
    names = hmm.Lexicon(None, np.array([counts[w] for w in ranked[:own]], dtype=np.int64), total, distinct, len(row))
    model = hmm.Hidden.first(names, states)
    pi, a, e = model.start, model.move, model.emit
    ids = [[row.get(w, len(row)) for w in ws] for _, _, ws in texts]
    for _ in range(rounds):
        ne, na, np_ = np.zeros_like(e), np.zeros_like(a), np.zeros_like(pi)
        for (_, h, _), seq in zip(texts, ids, strict=True):
            if h:
                continue
            f = [pi * e[seq[0]]]
            for w in seq[1:]:
                f.append(f[-1] @ a * e[w])
            b = [np.ones(states)]
            for w in reversed(seq[1:]):
                b.append(a @ (e[w] * b[-1]))
            b, p = b[::-1], f[-1].sum()
            np_ += f[0] * b[0] / p
            for t, w in enumerate(seq):
                ne[w] += f[t] * b[t] / p
                if t + 1 < len(seq):
                    na += a * np.outer(f[t], e[seq[t + 1]] * b[t + 1]) / p
        e = ne + weight * np.array(prior)[:, None]
        a, pi, e = na + 1 / states, np_ + 1 / states, e / e.sum(axis=0)
        a, pi = a / a.sum(axis=1, keepdims=True), pi / pi.sum()
    out = []
    for (i, h, ws), seq in zip(texts, ids, strict=True):
        f = pi * e[seq[0]]
        for w in seq[1:]:
            f = f @ a * e[w]
        inside = sum(math.log10((counts.get(w, 0) + 1) / rare) for w in ws if w not in row)
        base = sum(math.log10((counts.get(w, 0) + 1) / space) for w in ws)
        out.append((i, h, len(ws), sum(w in counts for w in ws), total, base, math.log10(f.sum()) + inside))
    return out


@pytest.mark.parametrize("own,listed,cells", [(1000, 1000, 1 << 19), (6, 9, 8), (3, 4, 1)])
def test_language_model_against_plain_loops(spark, monkeypatch, own, listed, cells):
    monkeypatch.setattr(hmm, "TOKENS", cells)
    monkeypatch.setattr(hmm, "GROUP", 64)
    rng = np.random.default_rng(4)
    names = ["The", "cat", "dog", "ÄRGER", "ärger", "sat", "run", "x\x1cy", "a", "b", "c d", " "]
    docs = [(i, "".join(names[j % 12] + " \t\n\x0b"[j % 4] for j in rng.integers(0, 3 + i % 12, int(rng.integers(0, 20))))) for i in range(80)]
    docs += [(None, "the cat"), (None, None), (81, None), (82, ""), (83, " \n "), (5, "cat cat only-held-out"), (next(i for i in range(100, 200) if held(i)), "never seen word cat")]
    extra = [(i, t, "z", "z", 1, "z", "z") for i, t in docs]
    df = spark.createDataFrame(extra, "doc_id long, text string, ids string, row string, word int, n string, held_out string").repartition(3)
    want = brute_force(docs, 3, 3, own, 2.5)
    got = [tuple(r) for r in hmm.score_texts(df, states=3, rounds=3, weight=2.5, own=own, listed=listed).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5]) and g[6] == pytest.approx(w[6])
    assert any(r[1] and r[3] < r[2] for r in want)


def test_language_model_on_odd_and_empty_tables(spark):
    got = {r.doc_id: r for r in hmm.score_texts(odd(spark), states=2, rounds=1, own=5, listed=8).collect()}
    assert len(got) == 11 and got[5].n_tokens == 300_001 and got[2].n_tokens == got[3].n_tokens == got[4].n_tokens == 1
    assert hmm.score_texts(empty(spark)).count() == 0
    alone = hmm.score_texts(spark.createDataFrame([(i, "some words") for i in range(60) if held(i)], "doc_id long, text string"), states=2, rounds=1).collect()
    assert alone and all(r.held_out and r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score == pytest.approx(0) for r in alone)


def test_language_model_on_the_table(spark):
    rows = queries.op13_language_model(spark, SF).collect()
    sql = r"""
    WITH w AS (SELECT doc_id, crc % 7 = 2 AS h, unnest(list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), '')) AS w
      FROM documents JOIN crcs USING (doc_id)),
    c AS (SELECT w, count(*) AS n FROM w WHERE NOT h GROUP BY w), t AS (SELECT sum(n) AS n, count(*) AS v FROM c)
    SELECT doc_id, count(*), count(c.n), sum(log10((coalesce(c.n, 0) + 1) / ((SELECT n FROM t) + (SELECT v FROM t) + 1))) FROM w LEFT JOIN c USING (w) GROUP BY doc_id"""
    con = duck()
    con.execute("CREATE TABLE crcs (doc_id BIGINT, crc BIGINT)")
    con.executemany("INSERT INTO crcs VALUES (?, ?)", [(r.doc_id, zlib.crc32(str(r.doc_id).encode())) for r in rows])
    want = {r[0]: r[1:] for r in con.sql(sql).fetchall()}
    assert len(rows) == len(want) == 200
    for r in rows:
        assert (r.n_tokens, r.n_known) == want[r.doc_id][:2] and r.base_score == pytest.approx(want[r.doc_id][2])
    out = [r for r in rows if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
