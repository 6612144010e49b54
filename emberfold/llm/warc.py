"""WARC archives of single Zstandard frames with a dictionary, written and read by Spark.

An archive starts with a skippable frame that holds the dictionary, as the WARC-Zstandard proposal
says; then every record is one frame. Spark's text writer puts frames into files, one archive a task:
its line separator is an empty skippable frame, which decoders pass over, so files stay valid streams,
commits are Spark's own, and any file system that Spark reaches will do. The same separator lets
the text reader split a large archive over tasks. A record whose compressed frame holds the separator by
chance, or by intent of its page, is stored in a frame of raw blocks that end inside every occurrence,
so no payload can break an archive apart.

The dictionary is trained on the `SAMPLES` records with the smallest hash of their id, `SAMPLE_BYTES`
of each at most, chosen by hashes before any payload moves; this affects sizes only. Where they are too few to train on, their bytes are the
dictionary.

Payloads of at least `REVISIT_BYTES` that occur again are stored once: the record with the smallest
page_id is the response, the others are revisits of it. Equal payloads meet as digests only, which
are aggregated map-side, so a payload that a third of the pages share moves no text.

Defined cases: a null html is an empty payload; a null page_id comes after all others; rows repeating
both id and payload get the same record type; a null url leaves out its header line. An empty table
gives an archive without records.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm.common import NULL_ID, lookup, prepare, real_id, stored
from emberfold.session import new_path

REVISIT_BYTES = 100
SAMPLES = 400
SAMPLE_BYTES = 16384
DICTIONARY_BYTES = 65536
LEVEL = 3
RAW_BLOCK = 1 << 16
DATE = "1970-01-01T00:00:00Z"  # archives of one table are to be equal; a crawl has its own date

# Fixed values of the formats.
DICTIONARY_MAGIC = struct.pack("<I", 0x184D2A5D)
EMPTY_FRAME = struct.pack("<II", 0x184D2A50, 0)
FRAME_MAGIC = struct.pack("<I", 0xFD2FB528)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEPARATOR = EMPTY_FRAME.decode("ascii")


def record(page: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: the HTTP response, without its payload if it revisits another."""
    name = "" if page == NULL_ID else page
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
              f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record; checks its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")

    def page(name: str | None) -> int | None:
        digits = name[len("<urn:page:") : -1] if name else ""
        return int(digits) if digits else None

    return page(fields["WARC-Record-ID"]), size, digest, kind, page(fields.get("WARC-Refers-To"))


def decided(pages: DataFrame) -> DataFrame:
    """page, url, html, digest and refers_to (null: a response) of every page."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NULL_ID)).alias("page"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("html")).withColumn("digest", F.sha2("html", 256))
    ids, _ = stored(rows.where(F.length("html") >= REVISIT_BYTES).select("page", "digest"), "payloads")
    # Stored before it is joined, so that Spark can split the rows of a digest that many pages share.
    firsts, _ = stored(ids.groupBy("digest").agg(F.min("page").alias("refers_to"), F.max("page").alias("last")).where(
        "refers_to < last").drop("last"), "firsts")
    revisits, seen = stored(ids.join(firsts, "digest").where("page > refers_to").distinct(), "revisits")
    return rows.join(lookup(revisits, seen["rows"]), ["page", "digest"], "left")


def dictionary(pages: DataFrame) -> bytes:
    html = F.col("html").cast("binary")
    rows = pages.where(html.isNotNull()).select(
        F.xxhash64(F.col("page_id").cast("long")).alias("o"), F.xxhash64(html).alias("h"),
        F.substring(html, 1, SAMPLE_BYTES).alias("html"))
    chosen = rows.select("o", "h").distinct().orderBy("o", "h").limit(SAMPLES)
    found = rows.join(F.broadcast(chosen), ["o", "h"]).groupBy("o", "h").agg(F.min("html").alias("html")).collect()
    found.sort(key=lambda r: (r.o, r.h))
    samples = [record(k, "http://example.org/", bytes(r.html), "0" * 64, None) for k, r in enumerate(found)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def raw_frame(data: bytes, dictionary_id: int) -> bytes:
    """A frame of raw blocks in which the separator does not occur.

    A block ends after the third byte of every separator in `data`; no block header can complete it, as
    its fourth byte is followed by four zeros in `data` itself and a header's third byte is 0x10 at most.
    """
    cuts = [0]
    at = data.find(EMPTY_FRAME)
    while at >= 0:
        cuts.append(at + 3)
        at = data.find(EMPTY_FRAME, at + 3)
    cuts.append(len(data))
    spans = [(k, min(k + RAW_BLOCK, b)) for a, b in zip(cuts, cuts[1:]) for k in range(a, b, RAW_BLOCK)] or [(0, 0)]
    # Eight bytes of content size, four of dictionary id, no checksum, one segment.
    out = [FRAME_MAGIC, bytes([0b11100011]), struct.pack("<I", dictionary_id), struct.pack("<Q", len(data))]
    for k, (a, b) in enumerate(spans):
        out += [struct.pack("<I", (b - a) << 3 | (k == len(spans) - 1))[:3], data[a:b]]
    return b"".join(out)


def frame(data: bytes, compressor: zstandard.ZstdCompressor, dictionary_id: int) -> bytes:
    packed = compressor.compress(data)
    return packed if EMPTY_FRAME not in packed else raw_frame(data, dictionary_id)


def _frames(words: bytes):
    """Dictionary frame, then a frame for each record of a partition."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = zstandard.ZstdCompressionDict(words) if words else None
        compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=learned)
        number = learned.dict_id() if learned else 0
        leading = [DICTIONARY_MAGIC + struct.pack("<I", len(words)) + words]
        for batch in batches:
            frames, leading = leading, []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html", "digest", "refers_to"))):
                frames.append(frame(record(*row), compressor, number))
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    return compress


def write(pages: DataFrame, path: str) -> None:
    """Archive `pages` in the folder `path`, a file for each task."""
    prepare(pages.sparkSession)
    words = dictionary(pages)
    if EMPTY_FRAME in words:
        words = words.replace(EMPTY_FRAME, b"")
    frames = decided(pages).select("page", "url", "html", "digest", "refers_to").mapInArrow(_frames(words), "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).text(path)


def _records(dictionaries: dict[int, bytes]):
    schema = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoders = {k: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(w) if w else None)
                    for k, w in dictionaries.items()}
        for batch in batches:
            rows = []
            for frame in batch.column("frame").to_pylist():
                number = zstandard.get_frame_parameters(frame).dict_id
                rows.append(parse_record(decoders[number].decompress(frame)))
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema)], names=names)

    return parse


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives in a folder, their payloads checked."""
    frames = prepare(spark).read.option("lineSep", SEPARATOR).text(path).select(F.col("value").cast("binary").alias("frame"))
    leading = frames.where(F.substring("frame", 1, 4) == F.lit(DICTIONARY_MAGIC)).distinct().limit(65).collect()
    if len(leading) > 64:
        raise ValueError("a folder may hold 64 dictionaries at most")
    dictionaries = {}
    for row in leading:
        words = bytes(row.frame)[8:]
        number = zstandard.ZstdCompressionDict(words).dict_id() if words else 0
        if number in dictionaries:
            raise ValueError("two dictionaries have one id")
        dictionaries[number] = words
    records = frames.where(F.substring("frame", 1, 4) == F.lit(FRAME_MAGIC))
    return records.mapInArrow(
        _records(dictionaries), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write `pages` to the shared folder and read the records back."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, path)
    return read(spark, path).withColumn("refers_to", real_id("refers_to"))


ORACLE_SQL = """
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM payloads GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM payloads JOIN firsts USING (payload_digest)
"""
