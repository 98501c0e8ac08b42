"""The stages of the corpus pipeline against brute force on the smallest tables."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, queries, simhash

from .helpers import SF, empty, odd
from .test_texts import brute_lines


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    scores = {r.doc_id: r.predicted for r in queries.op3_quality_classifier(spark, SF).collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if p}
    clean = corpus_pipeline.line_stage(spark, kept, SF).cache()
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in kept.collect()]
    assert clean.columns == columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter((r[0], t) for r, t in zip(rows, brute_lines(rows), strict=True))
    assert clean.where(F.col("n_chars") != F.char_length("text")).count() == 0
    single = corpus_pipeline.simhash_stage(spark, clean, SF).cache()
    parts = {r.doc_id: r.component_id for r in simhash.with_components(clean).collect()}
    assert single.columns == columns and Counter(r.doc_id for r in single.collect()) == Counter(set(parts.values()))
    mixed = corpus_pipeline.mixing_stage(spark, single, SF).cache()
    plan = {r.doc_id: r.copies for r in mixing.mix(single).collect()}
    assert mixed.columns == columns and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in plan.items() if n})
    tokens = corpus_pipeline.token_stage(spark, mixed, SF)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    codec = bpe.Codec.of(queries.tokenizer_path())
    for r in tokens.collect():
        assert list(r.ids) == codec.vocabulary.library.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_boilerplate_of_a_large_source_goes(spark):
    notice = "All rights reserved."
    rows = [(i, f"{notice}\nown line {i}\nshared {i // 2}" if i % 50 == 0 else f"own line {i}\nshared {i // 2}", "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_stage(spark, docs, SF).collect()}
    assert got == {i: f"own line {i}\nshared {i // 2}" for i in range(400)}


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "source", "ids", "n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "simhash_near_dedup", "source_mix", "bpe_encoding"]


def test_odd_and_empty_rows_pass(spark):
    for docs in (odd(spark, extra=False), empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        corpus_pipeline.token_stage(spark, docs, SF).collect()
