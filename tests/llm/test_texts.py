"""BPE, token files, quality, line dedup, SimHash, mixing: brute force, odd rows, empty tables."""

import hashlib
import json
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, linededup, mixing, quality, queries, simhash, tokenstore
from tidemark.llm.common import shared_dir

from .helpers import ODD, SF, duck, empty, odd, roots

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_padding()
    t.no_truncation()
    return t


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=40) | st.text("aehinst '\x1c<|>/wßİΣ", max_size=40))
@settings(max_examples=400, deadline=None)
def test_prefix_encoder_equals_the_merge_loop(text):
    codec = bpe.Codec.of(PATH)
    text = text.encode("utf-8", "ignore").decode()
    assert codec.encode(text).tolist() == codec.vocabulary.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_last_tokens_are_compatible(name):
    spec = json.load(open(queries.tokenizer_path(name), encoding="utf-8"))
    coder = bpe.PrefixEncoder(spec)
    vocab = spec["model"]["vocab"]
    for word in ("hello", "thththth", "aaaaaaaaaaa", "antidisestablishmentarianism"):
        found = coder.encode(word)
        names = {i: t for t, i in vocab.items()}
        assert "".join(names[i] for i in found).replace("</w>", "") == word


def test_bpe_round_trip(spark, library):
    rows = bpe.encode_table(odd(spark), PATH, decoded_col="decoded").select("text", "ids", "decoded").collect()
    assert len(rows) == len(ODD)
    for r in rows:
        assert list(r.ids) == ids_of(library, r.text)
        assert r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe.encode_table(empty(spark), PATH, decoded_col="d").count() == 0


def test_bpe_query(spark, library):
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, SF).collect()}
    for d in pd.read_parquet(f"{SF}/documents.parquet").itertuples():
        ids = ids_of(library, d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_token_files(spark, library):
    folder = shared_dir(spark, "t")
    manifest = tokenstore.write_tokens(odd(spark), folder, PATH, shards=3)
    got = tokenstore.read_tokens(spark, folder).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is None, r[0] or 0))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    start = 0
    for r, row in zip(got, rows, strict=True):
        ids = [*ids_of(library, row[1]), 2]
        assert (list(r.ids), r.start, r.n_tokens, r.ids_crc32) == (ids, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert manifest["tokens"] == start and len(manifest["files"]) > 1
    assert manifest == tokenstore.write_tokens(odd(spark), shared_dir(spark, "t"), PATH, shards=3)
    none = shared_dir(spark, "t")
    tokenstore.write_tokens(empty(spark), none, PATH)
    assert tokenstore.read_tokens(spark, none).count() == 0


def test_token_file_gives_one_document(spark):
    folder = shared_dir(spark, "t")
    manifest = tokenstore.write_tokens(odd(spark), folder, PATH, shards=1)
    dictionary = open(f"{folder}/dictionary.bin", "rb").read()
    file = tokenstore.TokenFile(folder, manifest["files"][0]["name"], dictionary, manifest["width"])
    assert file.document(1).tolist() == [2]
    with pytest.raises(ValueError):
        tokenstore.TokenFile(folder, manifest["files"][0]["name"], b"other", manifest["width"])


def test_quality_on_held_out_rows(spark):
    sf = SF.replace("0.001", "0.01")
    got = queries.op3_quality_classifier(spark, sf).toPandas()
    assert len(got) == 1000 and got.score.between(0, 1).all()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out and r.predicted == (r.score >= 0.3) for r in got.itertuples())
    held = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.9
    assert (held[held.quality == 1].predicted == 1).mean() > 0.97


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, None, 0), (None, 1, 0), (9, 1, 1), (9, 0, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(odd(spark), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).count() == 0
    kept = quality.keep_good(odd(spark), labels.limit(0))
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_tables_are_additive():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(quality.NAMES)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9  # only a pair tells them apart
    one = model.intercept + sum(t[b] for t, b in zip(model.tables, model.bins(x[:1])[0], strict=True))
    one += sum(t[cf[model.bins(x[:1])[0, f]], cg[model.bins(x[:1])[0, g]]] for f, g, cf, cg, t in model.pairs)
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-one)))


def brute_lines(rows, ratio=linededup.RATIO, least=linededup.LEAST):
    pages, on = Counter(r[3] for r in rows), Counter()
    for r in rows:
        on.update({(r[3], line) for line in (r[1].split("\n") if r[1] is not None else []) if line.strip(" ")})
    bad = {k for k, n in on.items() if n >= least and n > ratio * pages[k[0]]}
    return [None if r[1] is None else "\n".join(x for x in r[1].split("\n") if (r[3], x) not in bad) for r in rows]


@pytest.mark.parametrize("few", [True, False])
def test_line_dedup(spark, monkeypatch, few):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", 1000 if few else 0)
    rows = ODD + [(100 + i, f"boiler plate\nown line {i}\n\nsecond {i % 2}", "en", None if i % 3 else "h", 1) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "1 AS __bad", "2 AS __host")
    got = linededup.drop_boilerplate(df, counts=("before", "dropped"))
    assert got.columns == [*df.columns, "before", "dropped"]
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], t) for r, t in zip(rows, brute_lines(rows), strict=True))
    assert linededup.drop_boilerplate(empty(spark)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_match_sql(spark, name):
    con = duck()
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    show = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(show(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(show(r[i]) for i in order) for r in want.fetchall())


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_query(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    prints = np.array([slow_print(t) for t in docs.text], dtype=np.uint64)
    pairs = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints) <= 2) if i < j]
    want = [docs.doc_id.iloc[r] for r in roots(len(prints), pairs)]
    got = queries.op7_simhash(spark, SF).orderBy("doc_id").collect()
    assert [int(r.fingerprint, 16) for r in got] == prints.tolist() and [r.component_id for r in got] == want


def test_every_near_pair_meets_at_an_anchor(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.int64) * 2 + 1
    near = np.concatenate([base] + [base ^ sum(np.left_shift(np.int64(1), rng.integers(0, 64, 300)) for _ in range(k)) for k in (1, 2, 3)])
    values = sorted(set(near.tolist()))
    found = {(r.a, r.b) for r in simhash.near_prints(spark.createDataFrame([(v,) for v in values], "p long"), "p").collect()}
    x = np.array(values)
    want = {(values[i], values[j]) for i in range(len(x)) for j in np.flatnonzero(np.bitwise_count((x[i] ^ x).view(np.uint64)) <= 2) if i < j}
    assert found == want and len(want) > 500


def test_every_block_has_one_home():
    anchors = simhash.Anchors()
    assert (np.sort(anchors.cost, axis=1)[:, 0] == 0).all() and ((anchors.cost == 0).sum(axis=1) == 1).all()


def test_simhash_of_odd_rows(spark):
    got = simhash.with_components(odd(spark)).collect()
    assert len(got) == len(ODD)
    assert {r.component_id for r in got if r.doc_id in (2, 3, 4)} == {2}
    assert {r.component_id for r in got if r.doc_id in (9, 10)} == {9}
    kept = simhash.drop_near_duplicates(odd(spark))
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert kept.columns == odd(spark).columns and sorted(i for i in ids if i) == [1, 2, 5, 8, 9, 11] and None in ids
    assert simhash.with_components(empty(spark)).count() == 0


def test_long_texts_are_hashed_whole(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text) == whole == slow_print(text)


def test_mix_of_odd_rows(spark):
    got = mixing.mix(odd(spark)).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size + 1e-6
    by = {r.source: (r.source_size, r.target) for r in got}
    for s, (_, target) in by.items():
        assert sum(r.taken for r in got if r.source == s) == int(target)
    total = sum(r["size"] for r in got)
    assert sum(t for _, t in by.values()) == pytest.approx(1.5 * total)
    assert mixing.mix(empty(spark)).count() == 0


def test_curriculum_inverts_its_demand(spark):
    row = spark.range(1)
    for w0, w1 in mixing.SCHEDULE:
        for a in (0.0, 0.3, 1.0):
            t = row.select(mixing.position(F.lit(a), F.lit(w0), F.lit(w1))).first()[0]
            assert (w0 * t + (w1 - w0) * t * t / 2) / ((w0 + w1) / 2) == pytest.approx(a)


def test_mixed_documents(spark):
    plan = {r.doc_id: r.copies for r in mixing.mix(odd(spark)).where("doc_id is not null and doc_id <> 6").collect()}
    got = mixing.mix_documents(odd(spark))
    counts = Counter(r.doc_id for r in got.select("doc_id").collect())
    assert got.columns == odd(spark).columns and all(counts[d] == n for d, n in plan.items())


@given(st.lists(st.text(max_size=30) | st.text("aehinst '\x1c<|>/wßİΣH̱é.,!", max_size=30), max_size=8))
@settings(max_examples=300, deadline=None)
def test_library_pieces_equal_whole_texts(texts):
    codec = tokenstore.LibraryCodec.of(PATH)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts] + ["a <|endoftext|>B <|EndOfText|> c.D'S"]
    want = [codec.vocabulary.library.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    assert [ids.tolist() for ids in tokenstore._documents(pa.array(texts), PATH, 2)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_vocabularies_are_not_cut(name):
    path = queries.tokenizer_path(name)
    codec, other = bpe.Codec.of(path), tokenstore.LibraryCodec.of(path)
    texts = ["", "Hello  World's\n\nnew, <|endoftext|> Ünï 123", "x" * 3000]
    for t, (n, ids, text) in zip(texts, zip(*codec.digests(pa.array(texts)), strict=True), strict=True):
        want = codec.vocabulary.library.encode(t, add_special_tokens=False).ids
        assert codec.encode(t).tolist() == want and np.frombuffer(other.whole(t), "<u4").tolist() == want and n == len(want)
        assert ids == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert text == hashlib.sha256(codec.vocabulary.library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert codec.vocabulary.cuts == (name == "word_bpe_49k.json")


def test_long_texts_with_and_without_blanks():
    codec, other = bpe.Codec.of(PATH), tokenstore.LibraryCodec.of(PATH)
    unbroken = "abcdefghij" * 500_000
    want = codec.encode("abcdefghij" * 50)
    (n,), _, _ = codec.digests(pa.array([unbroken]))
    ids = codec.encode(unbroken)
    assert n == len(ids) and ids[:40].tolist() == want[:40].tolist() and "".join(codec.vocabulary.names[i] for i in ids).removesuffix("</w>") == unbroken
    words = "Some words, Über all. " * 250_000
    (n,), (sha,), _ = codec.digests(pa.array([words]))
    ids = np.concatenate([i for _, i in other.pieces.slices(pa.array([words]))])
    assert n == len(ids) and sha == hashlib.sha256(" ".join(map(str, ids.tolist())).encode()).hexdigest() and ids.tolist() == other.vocabulary.library.encode(words[:22], add_special_tokens=False).ids * 250_000


def test_files_roll_and_spread_samples(spark, library):
    folder = shared_dir(spark, "t")
    manifest = tokenstore.write_tokens(odd(spark), folder, PATH, shards=2, max_file_bytes=1)
    assert len(manifest["files"]) == len(ODD) and tokenstore.read_tokens(spark, folder).count() == len(ODD)
    data = np.arange(100_000, dtype="<u2").tobytes()
    assert tokenstore._spread(data[:9]) == data[:9] and len(tokenstore._spread(data)) == 16384 and tokenstore._spread(data)[-2:] == data[-2:]


def test_token_query(spark, library):
    start = 0
    got = queries.op10_token_files(spark, SF).orderBy("doc_id").collect()
    docs = pd.read_parquet(f"{SF}/documents.parquet").sort_values("doc_id")
    assert len(got) == len(docs)
    for r, d in zip(got, docs.itertuples(), strict=True):
        ids = [*ids_of(library, d.text), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
