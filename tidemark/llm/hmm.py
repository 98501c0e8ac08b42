"""Scoring texts by a hidden Markov language model: Baum-Welch over all training texts, scaled forward recursion."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir

#: The token that ends every text; no word is empty.
END = ""
#: Characters of text that are cut into words at once, and tokens that the recursions keep in memory at once.
GROUP, TOKENS = 1 << 22, 1 << 18


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts one behind the other, in lower case (A-Z only), and each text's number of them."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, offsets = cut.flatten(), np.asarray(cut.offsets) - cut.offsets[0].as_py()
    real = np.asarray(pc.not_equal(pc.binary_length(flat), 0))  # blanks at either end leave empty words
    return flat.filter(pa.array(real)), np.diff(np.concatenate([[0], np.cumsum(real)])[offsets])


def groups(texts: pa.Array) -> Iterator[pa.Array]:
    """A column in runs of texts of about ``GROUP`` bytes; a longer text is a run of its own."""
    run = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64)) // GROUP
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(texts)]
    return (texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def fold(doc_id: Column) -> Column:
    """True for held-out rows; rows without an id are training rows."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def token_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over a table of ``text``, the end of each text counted as ``END``. Counts combine before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"word": [END], "n": pa.array([batch.num_rows], pa.int64())})
            for run in groups(batch.column(0)):
                found = words(run)[0].value_counts()
                yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["word", "n"])

    return texts.mapInArrow(count, "word string, n long").where("n > 0").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """Training counts of the end and the most frequent words in order, of all tokens together (``total``), and the number of distinct ones.

    The first ``own`` have emissions of their own; all others share one class, in which each has its smoothed share.
    """

    names: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    own: int

    @property
    def space(self) -> int:
        """Denominator of the add-one shares: all counts, and one for each distinct token and for unknown ones."""
        return self.total + self.distinct + 1

    @property
    def rare(self) -> int:
        """Numerators of the shared class: of its tokens and of unknown ones."""
        return self.space - int((self.counts[: self.own] + 1).sum())

    def prior(self) -> np.ndarray:
        """Shares of the tokens with own emissions and, last, of the shared class."""
        return np.append(self.counts[: self.own] + 1, self.rare) / self.space


def lexicon(counts: DataFrame, own: int, listed: int) -> Lexicon:
    """The end and the most frequent words, ``listed`` in all (ties by word), on the driver; ``counts`` should be a table."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.col("word") != END, F.desc("n"), "word").limit(listed).toArrow()
    return Lexicon(top.column("word").combine_chunks().cast(pa.string()), np.asarray(top.column("n"), np.int64), total.n, total.v, min(own, top.num_rows))


def coded(text: Column, known: Lexicon) -> Column:
    """``ids`` of a text's tokens in the lexicon, its end included (``len(names)`` for tokens beyond it), and those ``others`` with their number."""

    @F.arrow_udf("struct<ids: array<int>, others: array<struct<word: string, times: int>>>")
    def code(texts: pa.Array) -> pa.Array:
        end = pc.index_in(pa.scalar(END), known.names).as_py()
        parts = [_code(run, known.names, len(known.names) if end is None else end) for run in groups(texts)]
        kind = pa.struct({"ids": pa.list_(pa.int32()), "others": pa.list_(pa.struct({"word": pa.string(), "times": pa.int32()}))})
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return code(text)


def _code(texts: pa.Array, names: pa.Array, end: int) -> pa.Array:
    flat, sizes = words(texts)
    terms = flat.dictionary_encode()
    known = np.asarray(pc.fill_null(pc.index_in(terms.dictionary, names), len(names)), np.int32)
    term = np.asarray(terms.indices, np.int64)
    ends = np.cumsum(sizes + 1)
    ids = np.full(ends[-1], end, np.int32)
    inner = np.ones(len(ids), dtype=bool)
    inner[ends - 1] = False
    ids[inner] = known[term] if len(term) else 0
    row = np.repeat(np.arange(len(sizes)), sizes)
    other = known[term] == len(names) if len(term) else np.zeros(0, dtype=bool)
    cells, times = np.unique(row[other] * max(1, len(known)) + term[other], return_counts=True)
    at = np.searchsorted(cells // max(1, len(known)), np.arange(len(sizes) + 1))
    pairs = pa.StructArray.from_arrays([terms.dictionary.take(pa.array(cells % max(1, len(known)))), pa.array(times.astype(np.int32))], ["word", "times"])
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pairs)], ["ids", "others"])


@dataclass
class Hidden:
    """Start and transition probabilities, and emissions by token (rows) and state; the last row is the shared class."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, known: Lexicon, states: int, seed: int = 7, spread: float = 1.0, stay: float = 0.8) -> Hidden:
        """The add-one shares, disturbed differently in each state (by rank, so alike in every run)."""
        prior = known.prior()
        emit = prior[:, None] * np.exp(spread * np.random.default_rng(seed).normal(size=(len(prior), states)))
        return cls(np.full(states, 1 / states), np.full((states, states), (1 - stay) / states) + stay * np.eye(states), emit / emit.sum(axis=0))

    @classmethod
    def of(cls, expected: dict[int, np.ndarray], known: Lexicon, states: int, weight: float) -> Hidden:
        """From expected counts, ``weight`` counts of the add-one shares added to each state's emissions, one to its moves and to the starts.

        Rows -1 to -states hold the moves from each state, the row before them the starts.
        """
        emit = known.prior()[:, None] * np.full(states, weight)
        at = [i for i in expected if i >= 0]
        if at:
            emit[at] += np.stack([expected[i] for i in at])
        none = np.zeros(states)
        move = np.stack([expected.get(-1 - s, none) for s in range(states)]) + 1 / states
        start = expected.get(-1 - states, none) + 1 / states
        return cls(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


class Batch:
    """Texts of similar length, longest first, so that the texts that go on at each step are the first ones.

    Cells are in the order of steps. The recursions work on blocks of steps of at most twice ``TOKENS`` cells and keep one state
    vector a text between blocks; the backward one recomputes its block's forward numbers from there.
    """

    def __init__(self, model: Hidden, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.model, self.ids, self.starts, self.sizes = model, ids, starts, sizes
        self.live = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
        after = np.concatenate([[0], np.cumsum(self.live)])
        cuts = [0]
        while cuts[-1] < sizes[0]:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(after, after[cuts[-1]] + 2 * TOKENS, side="right")) - 1))
        self.blocks = list(zip(cuts, cuts[1:], strict=False))

    def cells(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Emission rows of the steps from a to b, and where each step's cells begin."""
        at = np.concatenate([[0], np.cumsum(self.live[a:b])])
        step = np.repeat(np.arange(a, b), self.live[a:b])
        text = np.arange(at[-1]) - np.repeat(at[:-1], self.live[a:b])
        return np.minimum(self.ids[self.starts[text] + step], len(self.model.emit) - 1), at

    def forward(self, a: int, emit: np.ndarray, at: np.ndarray, entry: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled state probabilities and scales of a block's cells; ``entry``: those before its first step."""
        alpha, scale, ones, move = np.empty_like(emit), np.empty((len(emit), 1)), np.ones((len(self.model.start), 1)), self.model.move
        ends = at.tolist()
        for t, (low, high) in enumerate(zip(ends, ends[1:], strict=False)):
            now, total = alpha[low:high], scale[low:high]
            np.multiply(entry[: high - low] @ move if a + t else self.model.start, emit[low:high], out=now)
            np.matmul(now, ones, out=total)
            now /= total
            entry = now
        return alpha, scale[:, 0]

    def entries(self) -> tuple[list[np.ndarray | None], np.ndarray]:
        """State probabilities before each block, and each text's log10 likelihood."""
        entry, found, logs = None, [], np.zeros(len(self.sizes))
        for a, b in self.blocks:
            found.append(entry)
            rows, at = self.cells(a, b)
            alpha, scale = self.forward(a, self.model.emit[rows], at, entry)
            logs += np.bincount(np.arange(at[-1]) - np.repeat(at[:-1], self.live[a:b]), np.log10(scale), len(logs))
            entry = alpha[at[-2] :].copy()
        return found, logs

    def expect(self, emitted: np.ndarray, moved: np.ndarray, started: np.ndarray) -> None:
        """Adds the texts' expected emissions, moves and starts."""
        model, states = self.model, len(self.model.start)
        found = self.entries()[0] if len(self.blocks) > 1 else [None]
        later = np.zeros((0, states))  # emission times backward number over scale, of the step behind
        for (a, b), entry in zip(reversed(self.blocks), reversed(found), strict=True):
            rows, at = self.cells(a, b)
            emit = model.emit[rows]
            alpha, scale = self.forward(a, emit, at, entry)
            emit /= scale[:, None]
            beta, back, ends = np.ones_like(emit), model.move.T.copy(), at.tolist()
            moved += alpha[ends[-2] :][: len(later)].T @ later
            for low, high in zip(ends[-2::-1], ends[:0:-1], strict=True):
                np.matmul(later, back, out=beta[low : low + len(later)])
                later = emit[low:high]
                later *= beta[low:high]
            after = np.arange(at[1], at[-1])  # cells with one before them, which stands as far from its step's first
            moved += alpha[after - np.repeat(self.live[a : b - 1], self.live[a + 1 : b])].T @ emit[at[1] :]
            alpha *= beta
            if a == 0:
                started += alpha[: at[1]].sum(axis=0)
            for s in range(states):
                emitted[:, s] += np.bincount(rows, alpha[:, s], len(emitted))


def batches_of(model: Hidden, column: pa.ListArray) -> Iterator[tuple[np.ndarray, Batch]]:
    """``(rows, batch)`` over a column of ids: texts by falling length, together while they hold ``TOKENS`` tokens or fewer."""
    ids, offsets = np.asarray(column.flatten(), np.int64), np.asarray(column.offsets, np.int64)
    starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
    order = np.argsort(-sizes, kind="stable")
    part = np.cumsum(sizes[order]) // TOKENS
    for rows in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        if len(rows):
            yield rows, Batch(model, ids, starts[rows], sizes[rows])


def expected_counts(ids: DataFrame, model: Hidden) -> dict[int, np.ndarray]:
    """Baum-Welch's expected counts over all rows: each task adds up its texts', Spark adds up the tasks'.

    What reaches the driver is a row a token with own emissions, bounded by the model's size.
    """
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitted, moved, started = np.zeros(model.emit.shape), np.zeros((states, states)), np.zeros(states)
        for batch in batches:
            for _, texts in batches_of(model, batch.column(0)):
                texts.expect(emitted, moved, started)
        at = np.flatnonzero(emitted.any(axis=1))
        if len(at):
            keys = np.concatenate([at, -1 - np.arange(states), [-1 - states]])
            values = np.concatenate([emitted[at], moved * model.move, started[None]])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), *[pa.array(values[:, s]) for s in range(states)]], ["key", *[f"e{s}" for s in range(states)]])

    rows = ids.select("ids").mapInArrow(run, "key int, " + ", ".join(f"e{s} double" for s in range(states)))
    total = rows.groupBy("key").agg(*[F.sum(f"e{s}").alias(f"e{s}") for s in range(states)]).toArrow()
    values = np.stack([np.asarray(total.column(f"e{s}")) for s in range(states)], axis=1) if total.num_rows else np.zeros((0, states))
    return dict(zip(total.column("key").to_pylist(), values, strict=True))


def likelihoods(ids: Column, model: Hidden, known: Lexicon) -> Column:
    """Of coded texts: number of tokens and of those listed, and log10 of the add-one and the model's likelihood without the ``others``' numerators."""
    base = np.append(np.log10(known.counts + 1.0), 0.0) - np.log10(known.space)
    inside = np.append(np.where(np.arange(len(known.counts)) < known.own, 0.0, np.log10(known.counts + 1.0) - np.log10(max(1, known.rare))), -np.log10(max(1, known.rare)))
    names = ("n_tokens", "n_listed", "base", "hidden")

    @F.arrow_udf("struct<n_tokens: bigint, n_listed: bigint, base: double, hidden: double>")
    def score(column: pa.Array) -> pa.Array:
        flat, offsets = np.asarray(column.flatten(), np.int64), np.asarray(column.offsets, np.int64)
        sizes, hidden = np.diff(offsets), np.zeros(len(column))
        for rows, texts in batches_of(model, column):
            hidden[rows] = texts.entries()[1]
        if not len(column):
            return pa.array([], pa.struct({n: pa.int64() if n[0] == "n" else pa.float64() for n in names}))
        first = offsets[:-1] - offsets[0]
        listed = np.add.reduceat((flat < len(known.counts)).astype(np.int64), first)
        sums = [np.add.reduceat(table[flat], first) for table in (base, inside)]
        return pa.StructArray.from_arrays([pa.array(sizes), pa.array(listed), pa.array(sums[0]), pa.array(hidden + sums[1])], list(names))

    return score(ids)


def train(ids: DataFrame, known: Lexicon, states: int, rounds: int, weight: float) -> Hidden:
    model = Hidden.first(known, states)
    for _ in range(rounds):
        model = Hidden.of(expected_counts(ids, model), known, states, weight)
    return model


def score_texts(df: DataFrame, states: int = 8, rounds: int = 5, weight: float = 3000.0, own: int = 1 << 15, listed: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    Tokens are words between ASCII blanks, A-Z in lower case, and an end; null texts are empty, so only an end. Counts are
    those of all rows outside the held-out fold. ``base_score`` sums log10 of the add-one shares. The model has ``states``
    states, each with emissions of the ``own`` most frequent tokens and of one class of all others, unknown ones included, in
    which a token has its add-one share; each state's counts begin with ``weight`` counts of the add-one shares, as few texts say
    little about a state. ``rounds`` of Baum-Welch over all training rows fit it, and ``score`` is the exact log10
    probability that it gives to the text. Its emissions, starts and moves sum to 1, so scores compare with ``base_score``.

    The ``listed`` most frequent tokens' counts go to the tasks; tokens beyond them meet their counts in a shuffled join, one row a
    document and distinct token. Coded texts and counts are tables in the shared folder. Rows without an id are training rows;
    repeated rows count and score each; an empty fold gives shares of 1; empty tables give empty results; other columns are ignored.
    """
    spark, folder = df.sparkSession, shared_dir(df.sparkSession, "hmm")
    rows = df.select(F.col(id_col).alias("doc_id"), fold(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    token_counts(rows.where("not held_out").select("text")).write.parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts")
    known = lexicon(counts, own, listed)
    codes = rows.withColumn("c", coded(F.col("text"), known)).select("doc_id", "held_out", F.monotonically_increasing_id().alias("row"), "c.ids", "c.others")
    codes.write.parquet(f"{folder}/codes")
    codes = spark.read.parquet(f"{folder}/codes")
    model = train(codes.where("not held_out"), known, states, rounds, weight)
    beyond = codes.select("row", F.explode("others").alias("o")).select("row", "o.word", "o.times")
    met = beyond.join(counts.withColumnRenamed("n", "count"), "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("count") + 1.0)).alias("log"), F.sum("times").alias("times"))
    scored = codes.withColumn("s", likelihoods(F.col("ids"), model, known)).select("doc_id", "held_out", "row", "s.*")
    log, times = F.coalesce("log", F.lit(0.0)), F.coalesce("times", F.lit(0))
    return scored.join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_listed") + times).alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("hidden") + log).alias("score"),
    )
