"""Text quality by a generalised additive model with pairwise interactions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, fresh

NAMES = (
    "log_words", "upper", "lower", "digit", "wide", "blank", "comma", "stop", "bang", "question", "quote", "bracket", "symbol", "bar", "slash",
    "word_mean", "word_spread", "long_words", "shout_words", "marked_words", "bare_words", "distinct", "pairs_distinct", "same_next", "line_words",
    "lines_distinct", "short_lines", "ended_lines",
)
SLICE = 1 << 20
WINDOW = 400


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256)
    t[list(chars)] = 1
    return t


#: Shares of these bytes are features.
CLASSES = np.stack([
    _table(bytes(range(65, 91))), _table(bytes(range(97, 123))), _table(b"0123456789"), _table(bytes(range(128, 256))), _table(b" \t\n\r\f\v"), _table(b","), _table(b"."), _table(b"!"),
    _table(b"?"), _table(b"'\""), _table(b"()[]{}<>"), _table(b"#$%&*@^~+=_"), _table(b"|"), _table(b"/\\:"),
], axis=1)
MARKS = b"!#$%&*@^~+=_|"


def slices(data: bytes):
    """A text in slices of about a million bytes, cut at blanks where there are any near."""
    at = 0
    while at < len(data):
        end = at + SLICE
        if end < len(data):
            cut = data.find(b" ", end, end + SLICE)
            end = cut + 1 if cut >= 0 else end + SLICE
        yield data[at:end]
        at = end


def features(text: str | None) -> np.ndarray:
    """Numbers of ``NAMES`` for a whole text: shares of bytes, words and lines, so that length alone counts little.

    Repetition is measured inside windows of ``WINDOW`` words, and its mean taken, so that it doesn't grow with length. Texts of over a
    million bytes are read in :func:`slices`, whose windows begin anew and whose distinct lines add up; the words on both sides of a
    cut don't count as a repetition, and a line that is cut counts as two.
    Null and empty texts and texts of blanks have zeros, but for shares that are complete by definition.
    """
    data = text.encode("utf-8", "surrogatepass") if text else b""
    octets, words, chars, squares, long, shout, marked, bare, same = np.zeros(256), 0, 0, 0, 0, 0, 0, 0, 0
    windows, distinct, pairs, lines, line_distinct, short, ended = 0, 0.0, 0.0, 0, 0, 0, 0
    for part in slices(data):
        octets += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        w = part.split()
        sizes = np.fromiter(map(len, w), np.int64, len(w))
        words += len(w)
        chars += int(sizes.sum())
        squares += int((sizes * sizes).sum())
        long += int((sizes > 18).sum())
        shout += sum(map(bytes.isupper, w))
        bare += sum(map(bytes.isalpha, w))
        marked += len([1 for x in w if x[-1] in MARKS])
        same += sum(map(eq, w, w[1:]))
        for i in range(0, len(w), WINDOW):
            x = w[i : i + WINDOW]
            windows += len(x)
            distinct += len(set(x))
            pairs += len(set(zip(x, x[1:], strict=False))) + 1
        rows = [r for r in part.split(b"\n") if r]
        lines += len(rows)
        line_distinct += len(set(rows))
        short += len([1 for r in rows if len(r) < 30])
        ended += len([1 for r in rows if r[-1] in b".!?:;\"'"])
    n, m, k = max(1, len(data)), max(1, words), max(1, lines)
    mean = chars / m
    return np.concatenate([[math.log1p(words)], octets @ CLASSES / n, [
        mean, math.sqrt(max(0.0, squares / m - mean * mean)), long / m, shout / m, marked / m, bare / m, distinct / max(1, windows), pairs / max(1, windows), same / m,
        math.log1p(words / k), line_distinct / k, short / k, ended / k,
    ]])


@dataclass
class Additive:
    """Bin edges and lookup tables: a score is the logistic of the intercept plus one number a feature and a pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0)
        own = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, t in enumerate(self.tables):
            total += t[own[:, f]]
        for f, g, coarse_f, coarse_g, t in self.pairs:
            total += t[coarse_f[own[:, f]], coarse_g[own[:, g]]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of binned gradients; place 0 for none."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    ok = (hl >= least) & (hr >= least)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, gl * gl / (hl + 1) + gr * gr / (hr + 1), 0)
    at = int(gain.argmax())
    return float(gain[at] - g.sum() ** 2 / (h.sum() + 1)), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """Values by bin of a tree that splits its best leaf until it has ``leaves``."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        options = [(*_best_cut(g[a:b], h[a:b], least), a) for a, b in zip(cuts, cuts[1:], strict=False)]
        gain, at, a = max(options)
        if gain <= 1e-9 or not at:
            break
        cuts = sorted([*cuts, a + at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """Values by cell of a tree of four leaves: the cut of the rows whose two sides gain most by a cut of the columns."""
    def side(part: slice) -> tuple[float, np.ndarray]:
        values = _shallow_tree(g[part].sum(0), h[part].sum(0), 2, least)
        return float((values * g[part].sum(0)).sum()), values

    best, out = -1.0, np.zeros_like(g)
    for at in range(len(g)):
        parts = [slice(0, at), slice(at, None)] if at else [slice(None)]
        sides = [side(p) for p in parts]
        if (total := sum(gain for gain, _ in sides)) > best:
            best, out = total, np.concatenate([np.broadcast_to(v, g[p].shape) for p, (_, v) in zip(parts, sides, strict=True)])
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, leaves: int = 3, pairs: int = 6, pair_bins: int = 8, least: float = 5.0) -> Additive:
    """Boosts the features in turn, each round adding a shallow tree of one feature to its table, then pairs alike.

    Pairs are those whose coarse cells explain most of what the single features leave. Without rows of both labels the
    score is the share of label 1 (0.5 without rows).
    """
    share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(NAMES))]
    model = Additive(math.log(share / (1 - share)), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if not 0 < y.sum() < len(y):
        return model
    own = model.bins(x)
    total = np.full(len(x), model.intercept)

    def gradients(cell: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return np.bincount(cell, y - p, cells), np.bincount(cell, p * (1 - p), cells)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            if len(table) > 1:
                step = rate * _shallow_tree(*gradients(own[:, f], len(table)), leaves, least)
                table += step
                total += step[own[:, f]]
    coarse = [(np.arange(len(t)) * pair_bins // max(pair_bins, len(t))).astype(int) for t in model.tables]
    gains = []
    for f in range(len(NAMES)):
        for g in range(f):
            a, b = gradients(coarse[f][own[:, f]] * pair_bins + coarse[g][own[:, g]], pair_bins * pair_bins)
            gains.append((float((a * a / (b + 1)).sum()), f, g))
    for _, f, g in sorted(gains, reverse=True)[:pairs]:
        model.pairs.append((f, g, coarse[f], coarse[g], np.zeros((pair_bins, pair_bins))))
    for _ in range(rounds // 4):
        for f, g, cf, cg, table in model.pairs:
            a, b = (v.reshape(pair_bins, pair_bins) for v in gradients(cf[own[:, f]] * pair_bins + cg[own[:, g]], pair_bins * pair_bins))
            step = rate * _pair_tree(a, b, least)
            table += step
            total += step[cf[own[:, f]], cg[own[:, g]]]
    return model


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = 20_000) -> Additive:
    """Fits on at most ``sample`` labelled rows outside the held-out fold, those with the smallest id hashes.

    A label counts once an id (its mean if repeated, rounded up at a half), and of repeated ids the document with the
    smallest features; null ids and labels are left out.
    """
    chosen = labels.where((fold(F.col(id_col)) != 0) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("k")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("k"), "k").limit(sample)  # bounded, so it may be broadcast

    @F.arrow_udf("array<double>")
    def described(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in each(texts)], pa.list_(pa.float64()))

    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", described("t").alias("x"))
    rows = sorted(rows.groupBy("k", "y").agg(F.min("x").alias("x")).collect(), key=lambda r: r["k"])  # ``sample`` rows at most
    x = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES))
    return fit(x, np.array([r["y"] for r in rows], dtype=float))


def score(text: Column, model: Additive) -> Column:
    """The model's probability of label 1 for each whole text; nulls count as empty."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        x = np.array([features(t) for t in each(texts)]).reshape(-1, len(NAMES))
        return pa.array(model.score(x))

    return scored(text)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The model sees texts only. Null and empty texts get the score of a text without words; rows with null ids are scored
    like others and count as not held out; repeated rows score alike; without usable labels every score is 0.5. Extra
    columns are ignored, empty tables give empty results.
    """
    model = train(docs, labels, id_col, text_col)
    held = F.coalesce(fold(F.col(id_col)) == 0, F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), score(F.col(text_col), model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, with their columns."""
    name = fresh(docs, "score")
    model = train(docs, labels, id_col, text_col)
    scored = docs.withColumn(name, score(F.col(text_col), model)).where(F.col(name) >= threshold)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
