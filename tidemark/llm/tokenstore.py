"""Token-id files: documents compressed one by one with a shared zstandard dictionary, with an offset index.

A file holds, in order: ``MAGIC``; the SHA-256 of the dictionary; the frames; the index, which is three little-endian
64-bit columns (document id, frame offset, ids in the document) and a column of bytes that tells null ids; and a
footer with the index offset, the number of documents and ``MAGIC`` again. A frame is the zstandard compression of the
ids as unsigned integers of the manifest's width. ``manifest.json`` lists the files in order with their first token's
position, and is written last, so a folder without one holds no finished data. Files roll at a size.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, fresh, partitions, piece_of, range_cuts
from .pieces import Pieces, Vocabulary

MAGIC = b"TMTOKEN1"
FOOTER = "<QQ8s"  # a format, as functions that use it are sent to workers
DICTIONARY = 64 * 1024
#: Pieces that the library encodes at a time.
TOGETHER = 4000


class LibraryCodec:
    """The library's tokenizer on whole texts: it encodes each distinct piece of them, many in one call, while they are kept."""

    _made: dict[str, "LibraryCodec"] = {}

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        suffix = self.vocabulary.spec["model"].get("end_of_word_suffix")
        self.ends = np.array([n.endswith(suffix) and i not in self.vocabulary.added.values() for i, n in enumerate(self.vocabulary.names)]) if suffix else np.zeros(0, bool)
        self.pieces = Pieces(self.vocabulary, self.many, self.whole)

    @classmethod
    def of(cls, path: str) -> "LibraryCodec":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def whole(self, text: str) -> bytes:
        return array("I", self.vocabulary.library.encode(text, add_special_tokens=False).ids).tobytes()

    def many(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece; pieces are joined by blanks, and the ids dealt out."""
        out, words, others = dict.fromkeys(pieces), [], []
        for p in pieces:
            (words if p.isalpha() else others).append(p)
        for some in (words, others):
            for s in range(0, len(some), TOGETHER):
                part = some[s : s + TOGETHER]
                out |= zip(part, (some is words and self._by_word_ends(part)) or self._by_offsets(part), strict=True)
        return list(out.values())

    def _by_word_ends(self, words: list[str]) -> list[bytes] | None:
        """Ids of words that have one pre-token each, so that one word-end token ends each; None if any has more."""
        ids = np.array(self.vocabulary.library.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1 if len(self.ends) else []
        return _dealt(ids.tobytes(), 4 * ends) if len(ends) == len(words) else None

    def _by_offsets(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces by where in the joined text they begin."""
        coded = self.vocabulary.library.encode(" ".join(pieces), add_special_tokens=False)
        begins = np.fromiter((o[0] for o in coded.offsets), np.int64, len(coded))
        return _dealt(array("I", coded.ids).tobytes(), 4 * np.searchsorted(begins, np.cumsum([len(p) + 1 for p in pieces])))


def _dealt(data: bytes, ends: np.ndarray) -> list[bytes]:
    ends = ends.tolist()
    return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _documents(texts: pa.Array, path: str, end_id: int):
    """The ids of each text in turn, with the end id."""
    end, parts, at = np.array([end_id], dtype="<u4"), [], 0
    for row, ids in LibraryCodec.of(path).pieces.slices(texts):
        if row != at:
            yield np.concatenate([*parts, end])
            parts, at = [], row
        parts.append(ids)
    if len(texts):
        yield np.concatenate([*parts, end])


def _spread(data: bytes, pieces: int = 16, size: int = 1024) -> bytes:
    """All of a short string, and evenly spread pieces of a long one."""
    if len(data) <= pieces * size:
        return data
    starts = np.linspace(0, len(data) - size, pieces).astype(np.int64) & ~3  # at whole ids
    return b"".join(data[s : s + size] for s in starts.tolist())


def train_dictionary(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, width: int, documents: int = 1000) -> bytes:
    """A dictionary of at most 64 KB from the ids of the ``documents`` documents whose ids have the smallest hashes.

    A dictionary is only an aid to compression, so a bounded sample suffices: of rows with equal ids the smallest text,
    and 16 pieces of 1 KB spread over each document's ids. Too few or too small rows give an empty dictionary, which
    compresses as without one.
    """
    keys = df.select(F.col(id_col).alias("k")).where("k is not null").distinct().orderBy(F.xxhash64("k"), "k").limit(documents)
    keys = [r[0] for r in keys.collect()]

    @F.arrow_udf("binary")
    def serialized(texts: pa.Array) -> pa.Array:
        return pa.array([_spread(ids.astype(f"<u{width}").tobytes()) for ids in _documents(texts, path, end_id)], pa.binary())

    chosen = df.where(F.col(id_col).isin(keys)).groupBy(F.col(id_col).alias("k")).agg(F.min(text_col).alias("t"))
    samples = [bytes(r[1]) for r in chosen.select("k", serialized("t").alias("b")).orderBy("k").collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_tokens(
    df: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
    shards: int | None = None, level: int = 3, max_file_bytes: int = 256 << 20,
) -> dict:
    """Writes every row's ids, with ``end_id`` after each document, in ascending id order; returns the manifest.

    ``df`` needs an integer id; null ids come last, rows with equal ids in the order of their ids' bytes. Null and
    empty texts hold only the end id. Rows are cut into ``shards`` ranges of ids (default: the session's shuffle
    partitions) whose cuts depend on the data alone; each is sorted and written by one task, streaming, into files that
    roll at ``max_file_bytes`` and have temporary names until the driver has all of them. A task that runs again writes
    other temporary files, so lost executors cost only their shards. Only one line for each file reaches the driver.
    """
    spark = df.sparkSession
    vocabulary = Vocabulary(path)
    width = 2 if max(end_id, len(vocabulary.names) - 1) < 65536 else 4
    dictionary = train_dictionary(df, id_col, text_col, path, end_id, width)
    digest = hashlib.sha256(dictionary).digest()
    fs, root = filesystem(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    with fs.open_output_stream(f"{root}/dictionary.bin") as f:
        f.write(dictionary)
    told = spark.sparkContext.broadcast(dictionary)

    @F.arrow_udf("struct<n: int, frame: binary>")
    def pack(texts: pa.Array) -> pa.Array:
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(told.value) if told.value else None)
        counts, frames = [], []
        for ids in _documents(texts, path, end_id):
            counts.append(len(ids))
            frames.append(packer.compress(ids.astype(f"<u{width}").tobytes()))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int32()), pa.array(frames, pa.binary())], ["n", "frame"])

    def write(batches):
        fs, root = filesystem(folder)
        file, shard, part, done = None, None, 0, []
        for b in batches:
            for s, k, n, frame in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if file is not None and (s != shard or file.size >= max_file_bytes):
                    done.append(file.close(shard, part))
                    file, part = None, part + 1 if s == shard else 0
                if file is None:
                    shard, file = s, _Writer(fs, root, f"_temporary/{s:06d}-{uuid.uuid4().hex}", digest)
                file.add(k, n, frame)
        if file is not None:
            done.append(file.close(shard, part))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("docs", pa.int64()), ("tokens", pa.int64()), ("sha256", pa.string())]))

    key, piece = fresh(df, "key"), fresh(df, "piece")
    shards = shards or partitions(spark)
    rows = df.select(F.col(id_col).cast("long").alias(key), pack(F.col(text_col)).alias("p"))
    cuts = range_cuts(df, id_col, shards)
    ranged = rows.select(piece_of(F.col(key), cuts).alias(piece), key, "p.n", "p.frame").repartitionById(len(cuts) + 1, F.col(piece))
    ordered = ranged.sortWithinPartitions(piece, F.col(key).asc_nulls_last(), "n", "frame")
    lines = ordered.mapInArrow(write, "shard int, part int, name string, bytes long, docs long, tokens long, sha256 string").collect()
    files, start = [], 0
    for r in sorted(lines, key=lambda r: (r.shard, r.part)):
        name = f"shard-{r.shard:06d}-{r.part:04d}.tok"
        fs.move(f"{root}/{r.name}", f"{root}/{name}")
        files.append({"name": name, "bytes": r.bytes, "docs": r.docs, "tokens": r.tokens, "start": start, "sha256": r.sha256})
        start += r.tokens
    fs.delete_dir(f"{root}/_temporary")
    manifest = {"version": 1, "width": width, "end_id": end_id, "dictionary_sha256": digest.hex(), "tokens": start, "files": files}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


class _Writer:
    """One file under a temporary name; keeps 25 bytes of index for each document."""

    def __init__(self, fs, root: str, name: str, digest: bytes):
        self.out, self.name = fs.open_output_stream(f"{root}/{name}"), name
        self.sha, self.size, self.tokens = hashlib.sha256(), 0, 0
        self.index, self.absent = [array("q") for _ in range(3)], bytearray()
        self.write(MAGIC + digest)

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)

    def add(self, key: int | None, n: int, frame: bytes) -> None:
        for column, value in zip(self.index, (key or 0, self.size, n), strict=True):
            column.append(value)
        self.absent.append(key is None)
        self.write(frame)
        self.tokens += n

    def close(self, shard: int, part: int) -> dict:
        at, docs = self.size, len(self.absent)
        for column in self.index:
            self.write(np.frombuffer(column, np.int64).astype("<i8").tobytes())
        self.write(bytes(self.absent) + struct.pack(FOOTER, at, docs, MAGIC))
        self.out.close()
        return {"shard": shard, "part": part, "name": self.name, "bytes": self.size, "docs": docs, "tokens": self.tokens, "sha256": self.sha.hexdigest()}


class TokenFile:
    """Random access to one file's documents by position."""

    def __init__(self, folder: str, name: str, dictionary: bytes, width: int):
        fs, root = filesystem(folder)
        self.file, self.width = fs.open_input_file(f"{root}/{name}"), width
        total = self.file.size()
        at, count, magic = struct.unpack(FOOTER, self.file.read_at(struct.calcsize(FOOTER), total - struct.calcsize(FOOTER)))
        if magic != MAGIC or self.file.read_at(40, 0) != MAGIC + hashlib.sha256(dictionary).digest():
            raise ValueError(f"{name} is damaged or needs another dictionary")
        index = self.file.read_at(25 * count, at)
        self.ids, self.offsets, self.lengths = np.frombuffer(index, "<i8", 3 * count).reshape(3, count)
        self.absent = np.frombuffer(index, "u1", count, 24 * count)
        self.ends = np.append(self.offsets[1:], at)
        self.unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, k: int) -> bytes:
        return self.file.read_at(int(self.ends[k] - self.offsets[k]), int(self.offsets[k]))

    def document(self, k: int, frame: bytes | None = None) -> np.ndarray:
        """Ids of the file's k-th document."""
        return np.frombuffer(self.unpacker.decompress(frame or self.frame(k)), f"<u{self.width}")

    def all(self, slice_bytes: int = 8 << 20):
        """All documents in order, read in slices."""
        k = 0
        while k < len(self):
            stop = max(k + 1, int(np.searchsorted(self.ends, self.offsets[k] + slice_bytes)))
            base = int(self.offsets[k])
            part = self.file.read_at(int(self.ends[stop - 1]) - base, base)
            for i in range(k, stop):
                yield i, self.document(i, part[int(self.offsets[i]) - base : int(self.ends[i]) - base])
            k = stop


def read_tokens(spark, folder: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if asked for, ``ids``, from the files of a finished folder."""
    fs, root = filesystem(folder)
    manifest = json.loads(fs.open_input_file(f"{root}/manifest.json").readall())
    dictionary = spark.sparkContext.broadcast(fs.open_input_file(f"{root}/dictionary.bin").readall())
    width = manifest["width"]
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids)

    def read(batches):
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                file, rows, held = TokenFile(folder, name, dictionary.value, width), [], 0
                for k, ids in file.all():
                    row = {"doc_id": None if file.absent[k] else int(file.ids[k]), "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
                    rows.append(row | {"ids": ids} if with_ids else row)
                    start, held = start + len(ids), held + len(ids) * with_ids
                    if len(rows) >= 5000 or held >= 1_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    files = [(f["name"], f["start"]) for f in manifest["files"]]
    listed = spark.createDataFrame(files, "name string, start long").repartitionByRange(max(1, min(len(files), partitions(spark))), "name")
    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
