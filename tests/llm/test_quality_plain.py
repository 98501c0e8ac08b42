"""The quality model's features, bins and boosting against plain loops over whole texts."""

import math
import re
import string

import numpy as np
import pytest

from tidemark.llm import quality

from .helpers import SF

MARKS = "!#$%&*@^~+=_|"


def plain(text):
    data = (text or "").encode()
    share = lambda chars: sum(data.count(bytes([c])) for c in chars) / max(1, len(data))
    words = re.findall(rb"[^ \t\n\r\x0b\x0c]+", data)
    sizes, m = [len(w) for w in words], max(1, len(words))
    mean = sum(sizes) / m
    windows = [words[i : i + 400] for i in range(0, len(words), 400)]
    pairs = sum(len({(x[j], x[j + 1]) for j in range(len(x) - 1)}) + 1 for x in windows)
    lines = [r for r in data.split(b"\n") if r]
    k = max(1, len(lines))
    return [
        math.log1p(len(words)), share(string.ascii_uppercase.encode()), share(string.ascii_lowercase.encode()), share(b"0123456789"), share(range(128, 256)), share(b" \t\n\r\f\v"), share(b","), share(b"."), share(b"!"),
        share(b"?"), share(b"'\""), share(b"()[]{}<>"), share(b"#$%&*@^~+=_"), share(b"|"), share(b"/\\:"),
        mean, math.sqrt(max(0.0, sum(s * s for s in sizes) / m - mean * mean)), sum(s > 18 for s in sizes) / m, sum(w.isupper() for w in words) / m, sum(chr(w[-1]) in MARKS for w in words) / m, sum(w.isalpha() for w in words) / m,
        sum(len(set(x)) for x in windows) / max(1, len(words)), pairs / max(1, len(words)), sum(a == b for a, b in zip(words, words[1:], strict=False)) / m,
        math.log1p(len(words) / k), len(set(lines)) / k, sum(len(r) < 30 for r in lines) / k, sum(chr(r[-1]) in ".!?:;\"'" for r in lines) / k,
    ]


@pytest.fixture(scope="module")
def texts(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


def test_features_of_whole_texts(texts):
    for text in [*texts, None, "", " \n\t ", "ÀB né!\n\nA A A a.", "x" * 5000]:
        assert quality.features(text) == pytest.approx(plain(text), abs=1e-12)


def test_a_long_text_is_read_whole():
    """Shares of a text of several slices are those of one slice, but for what a cut adds."""
    unit = "Some words, and MORE words; 12 of them!\n" * 1000
    one, many = quality.features(unit), quality.features(unit * 80)
    assert len(unit) * 80 > 2 * quality.SLICE and many[0] == pytest.approx(math.log1p(80 * len(unit.split())))
    assert many[1:25] == pytest.approx(one[1:25], abs=2e-3)
    assert quality.features(unit * 79 + "#" * len(unit))[12] > many[12] + 0.01  # the end counts


def test_the_fit_is_that_of_plain_loops(texts):
    """One round of boosting without pairs: in turn, each feature's best two cuts of binned gradients, added to its table."""
    x = np.array([plain(t) for t in texts])
    y = np.array([float(i % 3 == 0 or f[3] > np.median(x[:, 3])) for i, f in enumerate(x)])
    model = quality.fit(x, y, bins=8, rounds=1, pairs=0)
    start = math.log(y.mean() / (1 - y.mean()))
    total, tables = np.full(len(y), start), []
    for f, edges in enumerate(model.edges):
        assert edges == pytest.approx(np.unique(np.quantile(x[:, f], np.arange(1, 8) / 8)))
        cell = [sum(v >= e for e in edges) for v in x[:, f]]
        p = 1 / (1 + np.exp(-total))
        g = [sum(y[i] - p[i] for i in range(len(y)) if cell[i] == c) for c in range(len(edges) + 1)]
        h = [sum(p[i] * (1 - p[i]) for i in range(len(y)) if cell[i] == c) for c in range(len(edges) + 1)]
        cuts = [0, len(g)]
        gain = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
        for _ in range(2):
            options = [(gain(a, c) + gain(c, b) - gain(a, b), c) for a, b in zip(cuts, cuts[1:], strict=False) for c in range(a + 1, b) if sum(h[a:c]) >= 5 and sum(h[c:b]) >= 5]
            if not options or max(options)[0] <= 1e-9:
                break
            cuts = sorted([*cuts, max(options)[1]])
        table = np.zeros(len(g))
        for a, b in zip(cuts, cuts[1:], strict=False):
            table[a:b] = 0.15 * sum(g[a:b]) / (sum(h[a:b]) + 1)
        table = table if len(g) > 1 else np.zeros(1)
        tables.append(table)
        total = total + table[cell]
    for mine, theirs in zip(tables, model.tables, strict=True):
        assert theirs == pytest.approx(mine, abs=1e-9)
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-total))) and any(t.any() for t in tables)
