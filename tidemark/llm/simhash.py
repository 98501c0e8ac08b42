"""SimHash near-duplicates by anchor-point covering with a perfect code."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, each, fresh, partitions, spread_join
from .components import connected_components

SHINGLE, SEED, LINK = 3, 42, 2
#: The perfect binary Golay code: length, covering radius, generator polynomial (fixed values).
LENGTH, RADIUS, GENERATOR = 23, 3, 0b101011100011
BLOCK = (1 << LENGTH) - 1
SLICE = 200_000

_BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None) -> int:
    """64 bits, each 1 if it is set in over half the shingle hashes; 0 if there is no word.

    A-Z are lower-cased, words lie between ASCII blanks, shingles are three words joined by a space (fewer words: the
    whole sequence), repeats count, hashes are XXH64 of UTF-8 with seed 42. Long texts are hashed in slices.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    shingles = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros((8, 256), dtype=np.int64)
    hashed, seed = xxhash.xxh64_intdigest, SEED
    for at in range(0, shingles, SLICE):
        part = words[at : min(at + SLICE, shingles) + SHINGLE - 1]
        if len(words) < SHINGLE:
            h = [hashed(b" ".join(words), seed)]
        else:
            h = [hashed(b"%b %b %b" % t, seed) for t in zip(part, part[1:], part[2:], strict=False)]
        octets = np.array(h, dtype="<u8").view(np.uint8).reshape(-1, 8)
        for i in range(8):
            counts[i] += np.bincount(octets[:, i], minlength=256)
    ones = (counts @ _BITS_OF_BYTE).reshape(64)
    return int(np.packbits(ones * 2 > shingles, bitorder="little").view("<u8")[0])


def simhash(text: Column) -> Column:
    """The fingerprint as a BIGINT with the same bits."""

    @F.arrow_udf("long")
    def prints(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t) for t in each(texts)], dtype=np.uint64).view(np.int64))

    return prints(text)


def _remainders() -> np.ndarray:
    """Syndromes of the 23 unit vectors: x^i modulo the generator."""
    out, r = [], 1
    for _ in range(LENGTH):
        out.append(r)
        r <<= 1
        if r >> (LENGTH - 12):
            r ^= GENERATOR
    return np.array(out, dtype=np.int64)


class Anchors:
    """Two Golay blocks of 23 bits; the other 18 bits are free.

    Every block is within distance 3 of exactly one codeword, so pairs of codewords are anchors that cover all
    fingerprints. For a syndrome, the error patterns of weight up to ``RADIUS + LINK`` lead to every codeword that is
    near enough.
    """

    def __init__(self, link: int = LINK):
        unit = _remainders()
        self.tables = [np.zeros(256, dtype=np.int64) for _ in range(3)]
        for k, table in enumerate(self.tables):
            for b in range(min(8, LENGTH - 8 * k)):
                table ^= np.where(np.arange(256) >> b & 1, unit[8 * k + b], 0)
        found: list[list[tuple[int, int]]] = [[] for _ in range(1 << (LENGTH - 12))]
        for weight in range(RADIUS + link + 1):
            for places in combinations(range(LENGTH), weight):
                found[int(np.bitwise_xor.reduce(unit[list(places)])) if places else 0].append((max(0, weight - RADIUS), sum(1 << p for p in places)))
        most = max(map(len, found))
        self.cost = np.full((len(found), most), link + 1, dtype=np.int64)
        self.error = np.zeros((len(found), most), dtype=np.int64)
        for s, entries in enumerate(found):
            for i, (cost, error) in enumerate(sorted(entries)):
                self.cost[s, i], self.error[s, i] = cost, error
        self.link = link

    def syndrome(self, block: np.ndarray) -> np.ndarray:
        return self.tables[0][block & 255] ^ self.tables[1][block >> 8 & 255] ^ self.tables[2][block >> 16]

    def home(self, prints: np.ndarray) -> np.ndarray:
        """The one anchor within the covering radius of both blocks."""
        a, b = prints & BLOCK, prints >> LENGTH & BLOCK
        return (a ^ self.error[self.syndrome(a), 0]) | (b ^ self.error[self.syndrome(b), 0]) << LENGTH

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and anchors for all anchors within the covering radius plus the threshold, shared by the blocks."""
        a, b = prints & BLOCK, prints >> LENGTH & BLOCK
        s, t = self.syndrome(a), self.syndrome(b)
        row, i, j = np.nonzero(self.cost[s][:, :, None] + self.cost[t][:, None, :] <= self.link)
        return row, (a[row] ^ self.error[s[row], i]) | (b[row] ^ self.error[t[row], j]) << LENGTH


def near_prints(prints: DataFrame, col: str) -> DataFrame:
    """``a < b`` for each two distinct values of ``col`` that differ in at most ``LINK`` bits.

    A fingerprint has one home anchor and visits every anchor within covering radius plus threshold (about 61); if two
    fingerprints are near, the larger visits the smaller's home, and each pair is compared there once. A fingerprint has
    at most 2,080 neighbours, whatever the number of documents, so the result grows with the distinct fingerprints.
    Spark takes the visits for as many rows as came in, and would broadcast them; the hint forbids that.
    """

    def homes(batches):
        anchors = Anchors()
        for b in batches:
            x = np.asarray(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(anchors.home(x)), b.column(0)], ["anchor", "a"])

    def visits(batches):
        anchors = Anchors()
        for b in batches:
            x = np.asarray(b.column(0))
            for at in range(0, len(x), 2000):
                part = x[at : at + 2000]
                row, anchor = anchors.near(part)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row])], ["anchor", "b"])

    # without a count and a key of its own, the few bytes here would be read by few tasks, each making 61 rows of one
    one = prints.select(F.col(col).alias("p"), F.xxhash64(col).alias("turn")).repartition(partitions(prints.sparkSession), "turn").select("p")
    left = one.mapInArrow(homes, "anchor long, a long")
    right = one.mapInArrow(visits, "anchor long, b long")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK)
    return left.join(right.hint("merge"), (left.anchor == right.anchor) & near).select("a", "b")


def with_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, print, component_id`` for each row: fingerprint bits as BIGINT, and the smallest id reachable by links.

    Equal fingerprints are one node first, so groups of copies never meet as rows; nulls and texts without words share
    fingerprint zero and link like any other. Repeated rows stay. Null ids belong to components, but don't name them
    unless a component has no other. Empty tables give empty results; other columns are ignored.
    """
    prints = checkpointed(df.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("print")))
    nodes = prints.groupBy("print").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    roots = connected_components(near_prints(nodes, "print"), "a", "b")
    known = nodes.join(roots.withColumnRenamed("node", "print").hint("merge"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("prints"))
    named = checkpointed(spread_join(known, least, "root", "prints", "print").select("print", "component_id", "rows"))
    return spread_join(prints, named, "print", "rows", "doc_id").select("doc_id", "print", "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component: that with its smallest id, and of repeated rows with that id any one.

    Rows with null ids stay, as they can't be told apart. Columns are those of ``df``.
    """
    name = fresh(df, "kept")
    kept = with_components(df, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    stay = df.join(kept.hint("merge"), F.col(id_col) == F.col(name), "left_semi")  # as many ids as documents, nearly
    return stay.dropDuplicates([id_col]).unionByName(df.where(F.col(id_col).isNull()))
