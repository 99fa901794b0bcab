"""WARC archives with one Zstandard frame per record and a dictionary in front."""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablekeep.llm.common import settle
from tablekeep.session import scratch_dir

#: Payload bytes of an archive, all but the last record of which fit in.
ARCHIVE_BYTES = 64 << 20
#: Records and bytes at the start of an archive that its dictionary is trained on, and its size.
SAMPLE_RECORDS = 1000
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Bytes of an archive looked at together for the end of a frame.
FRAME_BYTES = 4096

# The skippable frame that holds a dictionary, and an empty skippable frame of another
# kind. The empty one is all ASCII; it is the line separator with which Spark ends each record.
DICTIONARY_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record; a revisit keeps the HTTP header of the full payload but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    target = "".join((url or "").split())  # white space would end the header
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_uri(refers_to))] if is_revisit else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{name}: {value}\r\n" for name, value in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def dictionary_of(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def archive_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The frames of one archive: the dictionary, then each record compressed with it by itself.

    Holds the sample of the dictionary and one record. No records give no frames.
    """
    samples, size = [], 0
    for one in records:
        samples.append(one)
        size += len(one)
        if len(samples) == SAMPLE_RECORDS or size >= SAMPLE_BYTES:
            break
    if not samples:
        return
    dictionary = dictionary_of(samples)
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
    yield dictionary_frame(dictionary)
    for one in samples:
        yield compressor.compress(one)
    for one in records:
        yield compressor.compress(one)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The records of an archive, as they were before compression; one that is cut off is an error."""
    at, decompressor = 0, None
    while at < len(content):
        if at + 8 > len(content):
            raise ValueError("the archive is cut off within a frame")
        magic, length = struct.unpack_from("<II", content, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # a skippable frame
            if magic == DICTIONARY_MAGIC:
                found = zstandard.ZstdCompressionDict(content[at + 8 : at + 8 + length])
                decompressor = zstandard.ZstdDecompressor(dict_data=found)
            at += 8 + length
            if at > len(content):
                raise ValueError("the archive is cut off within its dictionary")
            continue
        one, parts = decompressor.decompressobj(), []
        while not one.eof:  # in short pieces, as what lies behind the frame is handed back
            if at >= len(content):
                raise ValueError("the archive is cut off within a record")
            parts.append(one.decompress(content[at : at + FRAME_BYTES]))
            at += FRAME_BYTES
        at = min(at, len(content)) - len(one.unused_data)
        yield b"".join(parts)


def parsed(one: bytes) -> dict:
    """The fields of a record that matter here, with its payload; the digest of a payload is verified."""
    head, _, rest = one.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not version.startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    if fields["WARC-Type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not that of its digest")
    ids = [fields.get(name, "").removeprefix("<urn:page:").removesuffix(">") for name in ("WARC-Record-ID", "WARC-Refers-To")]
    page_id, refers_to = (int(x) if x else None for x in ids)
    return {
        "page_id": page_id, "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": refers_to,
        "payload_bytes": length, "payload_digest": digest, "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES
) -> None:
    """Write a WARC record for each row of ``pages`` into archives of bounded size under ``path``.

    A payload is the text in UTF-8, a null one is empty. Of rows with equal payloads of at least
    ``min_revisit_bytes`` that with the smallest id is a response and the others are revisits of
    it; repeated rows with that id are responses too, and rows without id are revisits of it if
    there is one. Spark's own writer commits the files, so a task that runs again leaves no second
    copy; records are told to be equal by SHA-256 and length. A table without rows gives no records.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keys = settle(rows.select("id", F.sha2("payload", 256).alias("digest"), F.length("payload").cast("long").alias("size")), "payload-digests")
    equal = keys.where(F.col("size") >= min_revisit_bytes).groupBy("digest", "size")
    first = equal.agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "size", "first")
    first = settle(first, "first-payloads")
    total = keys.agg(F.sum("size")).first()[0] or 0
    archives = max(1, -(-total // archive_bytes))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                for page_id, url, body, to in zip(*(column for column in batch.columns), strict=True):
                    page_id, to = page_id.as_py(), to.as_py()
                    yield record(page_id, url.as_py(), body.as_py(), to, to is not None)

        held, size = [], 0
        for frame in archive_frames(records()):
            held.append(frame)
            size += len(frame)
            if size >= 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["value"])

    # Which rows are revisits is found from the keys alone. Payloads are then shuffled once, evenly,
    # into their archives, and meet the keys of revisits there by a hash of id and digest.
    slot = F.xxhash64("id", "digest")
    refers = F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    to = keys.join(first, ["digest", "size"]).select(slot.alias("slot"), F.col("digest").alias("same"), refers.alias("refers_to"))
    to = settle(to.where("refers_to IS NOT NULL").distinct(), "revisits").repartition(archives, "slot")
    marked = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("slot", slot).repartition(archives, "slot")
    joined = marked.join(to, "slot", "left")
    dealt = joined.select("id", "url", "payload", F.when(F.col("digest") == F.col("same"), F.col("refers_to")).alias("refers_to"))
    dealt.mapInArrow(frames, "value binary").select(F.col("value").cast("string")).write.option("lineSep", SEPARATOR.decode()).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload)`` of all archives.

    Archives are read whole, one per row and batch, and are of bounded size; every digest is verified.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                held, size = [], 0
                for one in read_archive(content.as_py()):
                    held.append(parsed(one))
                    size += len(one)
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=_RECORD)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema=_RECORD)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(task, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary")


_RECORD = pa.schema(
    [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())]
)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, **columns) -> DataFrame:
    """Archives of ``pages`` in the shared folder, read back; see ``write_archives``."""
    path = scratch_dir(pages.sparkSession, "llm-archives")
    write_archives(pages, path, min_revisit_bytes=min_revisit_bytes, **columns)
    return read_archives(pages.sparkSession, path)
