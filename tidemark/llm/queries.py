"""The training-data queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, clustering, embed_dedup, hmm, linededup, mixing, quality, simhash, tokenstore, urlfilter, warc, whitening
from .common import shared_dir, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe.bpe_digests(F.col("text"), tokenizer_path()).alias("d")).select("doc_id", "d.*")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.in_order(mixing.mix(table(spark, sf_dir, "documents")))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), folder, least_bytes=0)
    return warc.read_warc(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text_md5`` of each document; a document's host is its source."""
    clean = linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), counts=("n_lines", "n_dropped"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op6_source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`op6_line_dedup` with the ratio that boilerplate reaches in a whole source, as in the pipeline."""
    clean = linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), ratio=linededup.SOURCE_RATIO, counts=("n_lines", "n_dropped"))
    return clean.select("doc_id", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.with_components(table(spark, sf_dir, "documents"))
    return linked.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "tokens")
    tokenstore.write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, tokenizer_path(), end_id=END_ID)
    return tokenstore.read_tokens(spark, folder, with_ids=False)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_texts(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_embedding_near_dedup, op2_bpe_round_trip, op3_quality_classifier, op4_source_mix, op5_warc, op6_line_dedup, op6_source_lines, op7_simhash, op8_url_filter,
        op9_nearest_neighbours, op10_token_files, op11_whitening, op12_clustering, op13_language_model,
    )
}

OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(doc_id::VARCHAR), '') AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
  [1.0, 1.0, 3.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w0,
  [3.0, 1.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w1, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(most) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
v AS (SELECT arg_min(level, most / weight) AS level FROM l WHERE most / weight > level),
t AS (SELECT source AS src, source_size, w0, w1, coalesce(least(most, (SELECT level FROM v) * weight), most) AS target FROM w),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY turn, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
j AS (SELECT doc_id, source, size, source_size, target, w0, w1, start, floor(target)::BIGINT AS goal FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.src),
c AS (SELECT *, size > 0 AND start < goal AS b1, size > 0 AND start + source_size < goal AS b2, start / target AS f1, (start + source_size) / target AS f2 FROM j)
SELECT doc_id, source, size, source_size, target,
  greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - source_size - start)) AS taken, b1::INT + b2::INT AS copies,
  CASE WHEN b1 THEN f1 * (w0 + w1) / (w0 + sqrt(w0 * w0 + (w1 - w0) * f1 * (w0 + w1))) END AS position,
  CASE WHEN b2 THEN f2 * (w0 + w1) / (w0 + sqrt(w0 * w0 + (w1 - w0) * f2 * (w0 + w1))) END AS position_2
FROM c
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(encode(html), ''::BLOB) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS s FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS first FROM h),
x AS (SELECT *, [('0x' || substr(s, 10 * i + 1, 10))::BIGINT FOR i IN range(4)] AS part FROM f)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v >> (35 - 5 * k)) & 31)::INT + 1, 1) FOR k IN range(8)] FOR v IN part]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM x
"""

OP6_SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(list_distinct(string_split(text, chr(10)))) AS line FROM documents),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
c AS (SELECT source, line, count(*) AS pages FROM l WHERE trim(line) <> '' GROUP BY source, line),
b AS (SELECT c.source, list(line) AS bad FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source WHERE pages >= 3 AND pages > 0.1 * total GROUP BY c.source),
d AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines, bad FROM documents LEFT JOIN b ON documents.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, CASE WHEN bad IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(bad, x)) END AS kept FROM d)
SELECT doc_id, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped,
  CASE WHEN text IS NULL THEN NULL ELSE md5(array_to_string(kept, chr(10))) END AS text_md5
FROM k
"""

OP6_SOURCE_SQL = OP6_SQL.replace("0.1 * total", f"{linededup.SOURCE_RATIO} * total")

OP1_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT a AS node, a AS seen FROM l UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
n AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT vec_id, coalesce(links, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id, vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN n ON vec_id = n.a LEFT JOIN c ON vec_id = node
"""


def _op8_sql(rounds: int = 12, damping: float = 0.85) -> str:
    """The verdicts with a step of the propagation in each of ``rounds`` expressions."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urlfilter.RULES)
    link = urlfilter.LINK.replace("'", "''")
    steps = []
    for name, seed, source, to in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        steps.append(f"{name}e AS (SELECT {source} AS a, {to} AS b, n / sum(n) OVER (PARTITION BY {source}) * {damping}::DOUBLE AS part FROM edges)")
        steps.append(f"{name}0 AS (SELECT host, {seed} * {1 - damping}::DOUBLE AS rank FROM seeds WHERE {seed} > 0)")
        for i in range(rounds):
            steps.append(f"{name}{i + 1} AS (SELECT host, sum(rank) AS rank FROM (SELECT * FROM {name}0 UNION ALL SELECT b, part * rank FROM {name}e JOIN {name}{i} ON a = host) GROUP BY host)")
    return rf"""
WITH p AS (SELECT page_id, html, {lower.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, h, s) AS (VALUES {rules}),
hosts AS (SELECT DISTINCT host FROM p WHERE host <> ''),
fits AS (SELECT host, verdict, s, h || s AS rule FROM hosts JOIN r ON host = h OR ends_with(host, '.' || h)),
best AS (SELECT DISTINCT ON (p.host, p.path) p.host, p.path, rule, verdict FROM (SELECT DISTINCT host, path FROM p) p JOIN fits ON p.host = fits.host AND starts_with(p.path, s) ORDER BY p.host, p.path, length(rule) DESC, rule),
j AS (SELECT p.page_id, p.host, p.path, rule, verdict FROM p LEFT JOIN best USING (host, path)),
seeds AS (SELECT host, count(*) FILTER (WHERE verdict = 'allow')::DOUBLE AS good, count(*) FILTER (WHERE verdict = 'block')::DOUBLE AS bad FROM j WHERE verdict IS NOT NULL GROUP BY host),
links AS (SELECT host AS src, {lower.format("regexp_replace(x, '^(?i:https?:)?//', '')")} AS dst FROM (SELECT host, unnest(list_distinct(regexp_extract_all(html, '{link}', 1))) AS x FROM p WHERE host <> '')),
edges AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst AND dst <> '' GROUP BY ALL),
{", ".join(steps)}
SELECT page_id, j.host AS host, path, rule, coalesce(verdict, CASE WHEN coalesce(d{rounds}.rank, 0) > coalesce(t{rounds}.rank, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN t{rounds} ON t{rounds}.host = j.host LEFT JOIN d{rounds} ON d{rounds}.host = j.host
"""


def _op12_sql(rounds: int = 5) -> str:
    """Plain Lloyd rounds, one common table for each step."""
    parts = []
    for i in range(rounds + 1):
        parts.append(
            f"a{i} AS MATERIALIZED (SELECT row, arg_min(c, d * 1000 + c) AS c, min(d) AS d FROM (SELECT row, c, list_sum(list_transform(list_zip(x, m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM k, c{i}) GROUP BY row)"
        )
        parts.append(
            f"c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(n.m, c{i}.m) AS m FROM c{i} LEFT JOIN (SELECT c, list(floor(s / n)::BIGINT ORDER BY i) AS m FROM "
            f"(SELECT c, i, sum(v)::DOUBLE AS s, count(*)::DOUBLE AS n FROM (SELECT c, unnest(x) AS v, unnest(range(64)) AS i FROM k JOIN a{i} USING (row)) GROUP BY c, i) GROUP BY c) n ON n.c = c{i}.c)"
        )
    return f"""
WITH k AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(256 * v::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x AS m FROM k WHERE vec_id IS NOT NULL ORDER BY c LIMIT 40),
{", ".join(parts[:-1])}
SELECT vec_id, a{rounds}.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a{rounds}.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM k JOIN a{rounds} USING (row) JOIN c{rounds} ON c{rounds}.c = a{rounds}.c
"""


ORACLE_SQL = {"op1_embedding_near_dedup": OP1_SQL, "op4_source_mix": OP4_SQL, "op5_warc": OP5_SQL, "op6_line_dedup": OP6_SQL, "op6_source_lines": OP6_SOURCE_SQL, "op8_url_filter": _op8_sql(), "op12_clustering": _op12_sql()}
