"""Fixtures that all training-data tests share."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor sit amet " * 60_000

#: Nulls in every column, empty and blank and very long texts, ties, repeated rows.
ODD = [
    (1, "The quick brown fox.\nJumps over it.", "en", "a", 30), (2, None, "en", "a", 0), (3, "", "en", None, 0), (4, " \t\n ", None, "b", 4),
    (5, LONG, "en", "b", len(LONG)), (6, "The quick brown fox.\nJumps over it.", "en", "a", 30), (6, "The quick brown fox.\nJumps over it.", "en", "a", 30),
    (None, "no id here at all", "en", "a", 17), (8, "Ünïcode ÀB <|endoftext|> 你好 don't", "fr", "c", None), (9, "one two", "en", "a", 7), (10, "ONE TWO", "en", "c", 7),
    (11, "nul\x00l \x1c x\x85y\u00a0z", "en", "c", 9),
]


def odd(spark, extra=True):
    df = spark.createDataFrame(ODD, DOCS)
    if extra:
        for name in ("score", "kept", "print", "component_id", "target", "size", "ids", "__kept", "piece", "turn", "copies", "position", "host", "times"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def duck(folder=SF):
    con = duckdb.connect()
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
