"""Deterministic sharded WARC files: written in page order, read back record by record."""

from __future__ import annotations

import base64
import hashlib
import json
import urllib.parse
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, filesystem, partitions, piece_of, range_cuts, spread_join

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122's name space for URLs
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: All printable ASCII characters but the blank; other bytes of a URL are percent-encoded in headers.
URL_SAFE = "".join(map(chr, range(33, 127)))


def record_id(page_id: int | None, digest: str, repeat: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'page:{page_id}:{digest}:{repeat}')}>"


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def target(url: str | None, page_id: int | None) -> str:
    return urllib.parse.quote(url, safe=URL_SAFE) if url else f"urn:page:{page_id}"


def member(headers: list[tuple[str, object]], block: bytes, level: int) -> bytes:
    """One record as a gzip member without a time stamp."""
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    headers = [*headers, ("WARC-Block-Digest", f"sha1:{digest}"), ("Content-Length", len(block))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(page_id, url, payload: bytes, sha1: str, repeat: int, refers_to, refers_url, level: int) -> bytes:
    digest = base32(sha1)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, sha1, repeat)), ("WARC-Date", DATE),
        ("WARC-Target-URI", target(url, page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Payload-Length", len(payload)),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", page_id))
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1)), ("WARC-Refers-To-Target-URI", target(refers_url, refers_to)), ("X-Refers-To-Page-ID", refers_to)]
    return member(headers, http if revisit else http + payload, level)


LINES = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("name", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())])


def write_warc(
    df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0,
    max_file_bytes: int = 256 << 20, shards: int | None = None, level: int = 6,
) -> dict:
    """Writes one record a row in ascending page order to ``folder`` and returns the manifest, which is written last.

    Of equal payloads of at least ``least_bytes`` bytes, the one with the smallest id is a response record, the others
    are revisit records of it. Payloads are moved once: the facts about revisits come as rows of their own that sort
    right before their page. Rows are cut into ``shards`` ranges (default: the session's shuffle partitions) at ids that
    depend on the data alone; a task sorts one range, writes records and digests as they come, and starts another file
    when one has ``max_file_bytes`` compressed bytes. Files have temporary names until all tasks are done; then the
    driver, which gets a line for each file, renames them. Equal tables give equal files, byte for byte.

    Null payloads are empty, null URLs become ``urn:page:<id>``; null ids come last and revisit an equal payload with an
    id, else all are responses. Of repeated rows, the first is a response and the others revisit it. Empty tables give
    a manifest without files; other columns are ignored.
    """
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    pages = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha1", F.sha1("payload"))
    facts = pages.where(F.octet_length("payload") >= least_bytes).select("id", "sha1", "url")
    firsts = facts.groupBy("sha1").agg(F.min("id").alias("to"), F.min_by("url", "id").alias("to_url"), F.count("*").alias("n"))
    firsts = checkpointed(firsts.where("n > 1 and to is not null"))
    none = F.lit(None)
    notes = spread_join(facts.select("id", "sha1"), firsts, "sha1", "n", "id").distinct().select(
        "id", "sha1", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "to", "to_url")
    records = pages.select("id", "sha1", F.lit(1).alias("kind"), "url", "payload", none.cast("long").alias("to"), none.cast("string").alias("to_url"))
    cuts = range_cuts(df, id_col, shards or partitions(spark))
    rows = notes.union(records).withColumn("shard", piece_of(F.col("id"), cuts)).repartitionById(len(cuts) + 1, F.col("shard"))
    ordered = rows.sortWithinPartitions("shard", F.col("id").asc_nulls_last(), "sha1", "kind", "url")
    fs, root = filesystem(folder)
    fs.create_dir(f"{root}/_temporary", recursive=True)
    names = ("shard", "id", "sha1", "kind", "url", "payload", "to", "to_url")

    def write(batches):
        fs, root = filesystem(folder)
        shard, part, out, size, count, sha, name = None, 0, None, 0, 0, None, ""
        last, repeat, note = None, 0, None
        done = []

        def put(data: bytes):
            nonlocal size
            out.write(data)
            sha.update(data)
            size += len(data)

        def start():
            nonlocal out, size, count, sha, name
            name = f"_temporary/{shard:06d}-{part:04d}-{uuid.uuid4().hex}"
            out, sha, size, count = fs.open_output_stream(f"{root}/{name}"), hashlib.sha256(), 0, 0
            info = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {shard} part {part}\r\n".encode()
            put(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, f"info:{shard}:{part}")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], info, level))

        def close():
            out.close()
            done.append({"shard": shard, "part": part, "name": name, "bytes": size, "records": count, "sha256": sha.hexdigest()})

        for b in batches:
            for s, id_, sha1, kind, url, data, to, to_url in zip(*(b.column(n).to_pylist() for n in names), strict=True):
                if kind == 0:
                    note = (id_, sha1, to, to_url)
                    continue
                if s != shard:
                    if out:
                        close()
                    shard, part = s, 0
                    start()
                elif size >= max_file_bytes:
                    close()
                    part += 1
                    start()
                repeat = repeat + 1 if last == (id_, sha1) else 0
                last = (id_, sha1)
                known = note is not None and note[:2] == last
                revisit = known and (id_ != note[2] or repeat > 0)
                put(page_record(id_, url, data, sha1, repeat, note[2] if revisit else None, note[3] if revisit else None, level))
                count += 1
        if out:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=LINES)

    lines = ordered.select(*names).mapInArrow(write, "shard int, part int, name string, bytes long, records long, sha256 string").collect()
    files = []
    for r in sorted(lines, key=lambda r: (r.shard, r.part)):
        name = f"pages-{r.shard:06d}-{r.part:04d}.warc.gz"
        fs.move(f"{root}/{r.name}", f"{root}/{name}")
        files.append({"name": name, "bytes": r.bytes, "records": r.records, "sha256": r.sha256})
    fs.delete_dir(f"{root}/_temporary")
    manifest = {"version": 1, "records": sum(f["records"] for f in files), "files": files}
    with fs.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def members(stream, size: int = 1 << 20):
    """Uncompressed gzip members of a stream, one at a time."""
    unpacker, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            break
        parts.append(unpacker.decompress(data))
        if unpacker.eof:
            rest = unpacker.unused_data
            yield b"".join(parts)
            unpacker, parts = zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the archive ends inside a record")


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, and the block; checks lengths and digests."""
    head, _, body = record.partition(b"\r\n\r\n")
    version, *fields = head.decode().split("\r\n")
    headers = {k.lower(): v for k, v in (f.split(": ", 1) for f in fields)}
    block = body[: int(headers["content-length"])]
    if version != "WARC/1.1" or body[len(block) :] != b"\r\n\r\n" or headers["warc-block-digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {headers.get('warc-record-id')}")
    return headers, block


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """A row for each page record: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` and ``payload``.

    A revisit has its original's length and digest and a null payload; a response's are taken from its payload.
    """
    fs, root = filesystem(folder)
    files = json.loads(fs.open_input_file(f"{root}/manifest.json").readall())["files"]
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields + [("payload", pa.binary())] * with_payload)

    def read(batches):
        for b in batches:
            for name in b.column("name").to_pylist():
                fs, root = filesystem(folder)
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for record in members(stream):
                        h, block = parse(record)
                        kind = h["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        digest, length = h["warc-payload-digest"].removeprefix("sha1:"), int(h["x-payload-length"])
                        if payload is not None and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (length, digest):
                            raise ValueError(f"damaged payload in {h['warc-record-id']}")
                        number = lambda k: int(h[k]) if k in h else None  # noqa: B023, E731
                        row = {"page_id": number("x-page-id"), "url": h["warc-target-uri"], "record_type": kind, "payload_bytes": length, "payload_digest": digest, "refers_to": number("x-refers-to-page-id")}
                        rows.append(row | {"payload": payload} if with_payload else row)
                        held += length * with_payload
                        if len(rows) >= 2000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    listed = spark.createDataFrame([(f["name"],) for f in files], "name string").repartitionByRange(max(1, min(len(files), partitions(spark))), "name")
    return listed.mapInArrow(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * with_payload)
