"""WARC archives compressed record by record with a shared Zstandard dictionary.

A dictionary is built from archived records, embedded in a leading skippable frame of every
archive, and each record is a frame of its own, so any record can be read alone. Records whose
payload (of at least ``min_revisit`` bytes) an earlier record holds are written as revisits.

The dictionary is fitted on a bounded sample of records: those of the ``DICT_RECORDS`` distinct payloads
of at most ``DICT_RECORD_BYTES`` bytes that come first in hash order; all other work covers all rows. A task
holds one record at a time, buffers one archive of at most about ``ARCHIVE_BYTES``, writes it
under a name of its own attempt and reports it; archives of lost attempts are in no report and are
not read. Only slim rows (digest, id) are grouped. The ``BROADCAST_DIGESTS`` most repeated digests go to all
tasks, so a digest left over repeats in at most one row of that many. Rows that may have one of the others, told by a
sieve of bits, are joined by a shuffle with their payloads; all other payloads stay where they are read. The sieve
has 16 bits a digest up to ``SIEVE_BITS``; with many more digests than a sixteenth of that it lets through rows that repeat nothing, which
costs a shuffle of them and changes no row.

Defined results: a null payload is empty; of equal payloads the smallest id is the response, rows
that repeat that id are responses too, and a null id is the response only if no row has an id; a
null url leaves out the target header; rows that repeat id and payload are one record twice and share
its Record-ID; an empty table gives no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, materialise

# Fixed values of the format: the skippable frame's number for a dictionary, and the number of a dictionary.
SKIPPABLE_MAGIC, DICT_MAGIC = 0x184D2A5D, 0xEC30A437
DICT_RECORDS, DICT_RECORD_BYTES, DICT_BYTES = 256, 32 << 10, 64 << 10
ARCHIVE_BYTES = 8 << 20
#: So many of the repeated digests (some 100 bytes each) are broadcast, the most repeated first; the others are joined by a shuffle.
BROADCAST_DIGESTS = 50_000
#: Most bits of the sieve of the other digests, which is broadcast as at most one row for 64 of them.
SIEVE_BITS = 1 << 25
MIN_REVISIT = 100
#: Hadoop's names of stores that Arrow calls otherwise.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss", "wasbs": "abfss"}
_DATE = "1970-01-01T00:00:00Z"


def record_bytes(row: dict[str, Any]) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's HTTP header alone."""
    page, digest = row["page_id"], row["payload_digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = http + row["payload"] if row["record_type"] == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{record_id(page, digest)}>", f"WARC-Date: {_DATE}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"]))
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page is None else page}"]
    if row["record_type"] == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(row['refers_to'], digest)}>", f"X-Refers-To-Page-ID: {row['refers_to']}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page: int | None, digest: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}"


def parse_record(data: bytes) -> dict[str, Any]:
    """What a record says: page_id, payload_bytes, payload_digest, record_type, refers_to, payload, intact."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    said = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    response = fields["WARC-Type"] == "response"
    own = hashlib.sha256(payload).hexdigest() if response else said
    as_id = lambda x: int(x) if x else None
    return {
        "page_id": as_id(fields["X-Page-ID"]),
        "payload_bytes": len(payload) if response else length,
        "payload_digest": own,
        "record_type": fields["WARC-Type"],
        "refers_to": as_id(fields.get("X-Refers-To-Page-ID", "")),
        "payload": payload if response else None,
        "intact": own == said and rest[len(block) :] == b"\r\n\r\n" and (not response or length == len(payload)),
    }


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A dictionary from sample records; b'' if they are too few or too short for one."""
    if len(samples) < 16 or sum(map(len, samples)) < 4 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # samples without anything in common
        return b""


def archive_head(dictionary: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE_MAGIC, len(dictionary)) + dictionary


def split_frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each decompressed from its own frame with the embedded dictionary."""
    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("no leading dictionary frame")
    embedded = content[8 : 8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(embedded)) if embedded else zstandard.ZstdDecompressor()
    view, at, step = memoryview(content), 8 + size, 16 << 10
    while at < len(content):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a record")
            piece = view[at : at + step]
            out.append(one.decompress(piece))
            at += len(piece) - len(one.unused_data)
        yield b"".join(out)


def _bit(bits: int) -> Column:
    """The digest's place in a sieve of ``bits`` bits."""
    return F.pmod(F.xxhash64("payload_digest"), F.lit(bits))


def digest_sieve(digests: DataFrame, bits: int) -> DataFrame:
    """(at, word): words of 64 bits, of which those at the places of the digests are set; words without any are left out."""
    place = F.expr(f"shiftleft(1L, int(pmod(xxhash64(payload_digest), {bits}L) % 64))")
    return digests.groupBy(F.floor(_bit(bits) / 64).alias("at")).agg(F.bit_or(place).alias("word"))


def mark_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type and refers_to of every row."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    slim = rows.where(F.col("payload_bytes") >= min_revisit).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c"))
    repeated = materialise(slim.where("c > 1"), "repeated_digests")
    hot = materialise(repeated.orderBy(F.desc("c"), "payload_digest").limit(BROADCAST_DIGESTS).select("payload_digest", "first_id", F.lit(True).alias("hot")), "hot_digests")
    cold = materialise(repeated.drop("c").join(F.broadcast(hot), "payload_digest", "left_anti"), "cold_digests")
    bits = min(SIEVE_BITS, max(64, 1 << (16 * cold.count()).bit_length()))
    met = rows.join(F.broadcast(hot), "payload_digest", "left").withColumn("at", F.floor(_bit(bits) / 64)).join(F.broadcast(digest_sieve(cold, bits)), "at", "left")
    let_through = F.coalesce(F.getbit("word", (_bit(bits) % 64).cast("int")) == 1, F.lit(False))
    asks = let_through & F.col("hot").isNull() & (F.col("payload_bytes") >= min_revisit)  # copies of a hot or a short payload never meet in a task
    joined = met.where(asks).drop("first_id").join(cold, "payload_digest", "left").unionByName(met.where(~asks)).drop("hot", "at", "word")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.withColumns({"record_type": F.when(revisit, "revisit").otherwise("response"), "refers_to": F.when(revisit, F.col("first_id"))}).drop("first_id")


def write_archives(records: DataFrame, folder: str, dictionary: bytes, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Writes ``folder``/*.warc.zst and returns the written report: archive (file name), n_records, n_bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scheme, colon, path = folder.partition(":")
        store, root = fs.FileSystem.from_uri(ARROW_SCHEMES.get(scheme, scheme) + colon + path)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        mine = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        writer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=level)
        done: list[tuple[str, int, int]] = []
        parts, size, n = [archive_head(dictionary)], 0, 0

        def close() -> None:
            name = f"{mine}-{len(done):05d}.warc.zst"
            data = b"".join(parts)
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            done.append((name, n, len(data)))

        for batch in batches:
            cols = batch.schema.names
            for i in range(batch.num_rows):
                frame = writer.compress(record_bytes({c: batch.column(k)[i].as_py() for k, c in enumerate(cols)}))
                parts.append(frame)
                size, n = size + len(frame), n + 1
                if size >= archive_bytes:
                    close()
                    parts, size, n = [archive_head(dictionary)], 0, 0
        if n:
            close()
        if done:
            names, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["archive", "n_records", "n_bytes"])

    ordered = records.select("page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return materialise(ordered.mapInArrow(work, "archive string, n_records long, n_bytes long"), "archive_report")


def sample_records(pages: DataFrame) -> list[bytes]:
    """The bounded sample that the dictionary is fitted on. Hashes alone decide it, so a task sends the driver few bytes, and copies count once."""
    size = F.octet_length("html")
    small = pages.where((size >= MIN_REVISIT) & (size <= DICT_RECORD_BYTES)).select("html", "page_id", "url", F.xxhash64("html").alias("h"))
    least = [r["h"] for r in small.select("h").distinct().orderBy("h").limit(DICT_RECORDS).collect()]
    if not least:
        return []
    rows = small.where(F.col("h") <= max(least)).groupBy("h").agg(F.min(F.struct("html", "page_id", "url")).alias("r")).select("r.*").collect()  # DICT_RECORDS rows
    payloads = sorted((r["html"].encode(), r["page_id"] or 0, r["url"]) for r in rows)
    return [record_bytes({"page_id": page, "url": url, "payload": p, "payload_bytes": len(p), "payload_digest": hashlib.sha256(p).hexdigest(), "record_type": "response"}) for p, page, url in payloads]


def write_warc(pages: DataFrame, folder: str | None = None) -> tuple[str, DataFrame]:
    """Archives every row; (folder, report)."""
    folder = folder or fresh_path(pages.sparkSession, "warc")
    return folder, write_archives(mark_revisits(pages), folder, train_dictionary(sample_records(pages)))


def read_warc(spark: SparkSession, folder: str, report: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record of the reported archives: page_id, payload_bytes, payload_digest, record_type, refers_to, intact, archive and, if wanted, payload."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, archive string" + ", payload binary" * payloads

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.string(), pa.binary()][: 7 + payloads]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact", "archive", "payload"][: 7 + payloads]
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, size = batch.column(0)[i].as_py(), [], 0
                for data in split_frames(batch.column(1)[i].as_py()):
                    row = parse_record(data)
                    rows.append([row[c] if c != "archive" else name for c in names])
                    size += len(data)
                    if size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    if report.isEmpty():
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content").join(report.select("archive"), "archive", "left_semi")
    return named.select("archive", "content").mapInArrow(work, schema)
