"""Files of token ids: written and read by Spark, in chunks of whole documents.

Documents are ranged by doc_id and sorted within a range, so the files, in the order of their part numbers,
hold the ids in ascending order of doc_id. A task turns texts into ids and groups whole documents
into chunks of about CHUNK_IDS; a longer document is a chunk of its own. A chunk is

    magic, version and size of an id, part, number in the part, ids before it in the part, its ids (its head);
    the number of documents and of blocks, bytes of the codes, a checksum of the head and of the two tables;
    the table of documents: doc_id, whether there is one, number of ids;
    the table of blocks: number of ids, checksum of the ids, bytes of the code;
    the blocks' codes, by the range coder of `rangecoder`.

A file is a sequence of chunks, each followed by END; within a chunk every ESCAPE byte is followed by a zero,
so END occurs nowhere else and Spark's line reader can split a file over tasks. Spark's own writer commits
the files, on any file system it reaches.

Each document ends with the id `end`. The start of a document, in ids, comes from its chunk's head, from the
documents before it in the chunk, and from the totals of the parts before, one number for each file.

Defined cases: a null text is an empty one and has its end id alone; a null doc_id comes after all others;
rows with equal doc_id follow each other by a hash of the text, and repeated rows all stay. An empty table
gives no documents. Other columns of the input do not come back.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberfold.llm import rangecoder
from emberfold.llm.common import doc_key, prepare
from emberfold.llm.tokens import shared
from emberfold.session import new_path

CHUNK_IDS = 4_000_000
PIECE_BYTES = 4 << 20  # texts turned into ids at once, one text at least

# Fixed values of the format.
MAGIC = b"TIDS"
VERSION = 3
HEAD = struct.Struct("<4sBBxxIIQQ")  # magic, version, bytes of an id, part, number, ids before, ids
SIZES = struct.Struct("<IIII")  # documents, blocks, bytes of the codes, checksum
DOCUMENT = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("ids", "<u8")])
BLOCK = np.dtype([("ids", "<u4"), ("crc", "<u4"), ("bytes", "<u4")])
ESCAPE = b"\x1b"
END = "\x1b\x01"


def pack_chunk(part: int, number: int, before: int, docs: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    id_bytes = rangecoder.id_bytes_of(int(ids.max(initial=0)))
    blocks = rangecoder.encode(ids, id_bytes)
    documents = np.zeros(len(docs), DOCUMENT)
    documents["doc_id"] = [d or 0 for d in docs]
    documents["known"] = [d is not None for d in docs]
    documents["ids"] = sizes
    table = np.array([(n, crc, len(code)) for n, crc, code in blocks], BLOCK)
    codes = b"".join(code for _, _, code in blocks)
    head = HEAD.pack(MAGIC, VERSION, id_bytes, part, number, before, len(ids))
    tables = documents.tobytes() + table.tobytes()
    crc = zlib.crc32(tables, zlib.crc32(head))
    return (head + SIZES.pack(len(documents), len(table), len(codes), crc) + tables + codes).replace(ESCAPE, ESCAPE + b"\0")


def unpack_chunk(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Part, ids before the chunk in it, the table of documents, and all ids; checked."""
    data = data.replace(ESCAPE + b"\0", ESCAPE)
    magic, version, id_bytes, part, _, before, count = HEAD.unpack_from(data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a chunk of token ids")
    documents, blocks, size, crc = SIZES.unpack_from(data, HEAD.size)
    at = HEAD.size + SIZES.size
    codes = at + documents * DOCUMENT.itemsize + blocks * BLOCK.itemsize
    if len(data) != codes + size or zlib.crc32(data[at:codes], zlib.crc32(data[: HEAD.size])) != crc:
        raise ValueError("a chunk does not match its checksum")
    table = np.frombuffer(data, DOCUMENT, documents, at)
    ends = np.frombuffer(data, BLOCK, blocks, at + documents * DOCUMENT.itemsize)
    stops = codes + np.cumsum(ends["bytes"].astype(np.int64))
    pieces = [(int(n), int(c), data[stop - size : stop])
              for n, c, size, stop in zip(ends["ids"], ends["crc"], ends["bytes"].tolist(), stops.tolist())]
    ids = rangecoder.decode(pieces, id_bytes)
    if not int(table["ids"].sum()) == count == len(ids):
        raise ValueError("a chunk's documents do not match its ids")
    return part, before, table, ids


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """doc_ids, bounds and bytes of runs of texts of about PIECE_BYTES, one text at least."""
    docs: list = []
    sizes: list[np.ndarray] = []
    bodies: list[np.ndarray] = []
    held = 0

    def run() -> tuple[list, np.ndarray, np.ndarray]:
        nonlocal docs, sizes, bodies, held
        out = docs, np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(bodies)
        docs, sizes, bodies, held = [], [], [], 0
        return out

    for batch in batches:
        texts = batch.column("text").cast(pa.large_string())
        if not len(texts):
            continue
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        body = texts.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body else np.zeros(0, np.uint8)
        names = batch.column("doc_id").to_pylist()
        start = 0
        while start < len(names):
            stop = int(np.searchsorted(bounds, bounds[start] + PIECE_BYTES - held, side="right")) - 1
            if stop <= start and docs:
                yield run()
                continue
            stop = max(stop, start + 1)
            docs += names[start:stop]
            sizes.append(np.diff(bounds[start : stop + 1]))
            bodies.append(data[bounds[start] : bounds[stop]])
            held += int(bounds[stop] - bounds[start])
            start = stop
    if docs:
        yield run()


def _with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(sizes), end)


def _chunks(settings, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared(settings.value)
        part = TaskContext.get().partitionId()
        docs: list = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []
        count = number = before = 0

        def chunk() -> pa.RecordBatch:
            nonlocal docs, sizes, held, count, number, before
            data = pack_chunk(part, number, before, docs, np.concatenate(sizes), np.concatenate(held))
            number, before = number + 1, before + count
            docs, sizes, held, count = [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["chunk"])

        for names, bounds, data in _texts(batches):
            ids, found = tokens.encode(bounds, data)
            if count and count + len(ids) + len(found) > CHUNK_IDS:
                yield chunk()
            docs += names
            sizes.append(found + 1)
            held.append(_with_end(ids, found, end))
            count += len(held[-1])
        if docs:
            yield chunk()

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end: int = 0) -> None:
    """Ids of the texts of `docs`, by the tokenizer in the file `tokenizer`, to files in the folder `path`."""
    spark = prepare(docs.sparkSession)
    with open(tokenizer, encoding="utf-8") as file:
        settings = spark.sparkContext.broadcast(file.read())  # a vocabulary, of the same size for any data
    order = ["_key", "_tie", "_row"]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        doc_key().alias("_key"))
    # Equal rows may follow each other in any order: the last key only spreads them over ranges.
    rows = rows.withColumns({"_tie": F.xxhash64("text"), "_row": F.monotonically_increasing_id()})
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    chunks = ordered.mapInArrow(_chunks(settings, end), "chunk binary")
    chunks.select(F.col("chunk").cast("string").alias("value")).write.option("lineSep", END).text(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "part", "offset", "n_tokens", "ids"]
    for batch in batches:
        for data in batch.column("chunk"):
            part, before, table, ids = unpack_chunk(data.as_py())
            ends = np.cumsum(table["ids"].astype(np.int64))
            starts = ends - table["ids"].astype(np.int64)
            step = max(1, len(table) * PIECE_BYTES // max(4 * len(ids), 1))
            for a in range(0, len(table), step):
                rows = slice(a, a + step)
                first = int(starts[a])
                offsets = np.append(starts[rows], ends[rows][-1:]) - first
                body = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(table[rows]), [None, pa.py_buffer(offsets * 4),
                                                          pa.py_buffer(ids[first : int(ends[rows][-1])])])
                yield pa.RecordBatch.from_arrays([
                    pa.array(table["doc_id"][rows].astype(np.int64), mask=table["known"][rows] == 0),
                    pa.array(np.full(len(table[rows]), part, np.int64)), pa.array(starts[rows] + before),
                    pa.array(table["ids"][rows].astype(np.int64)), body.cast(pa.binary())], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit integers) of all documents in a folder."""
    chunks = prepare(spark).read.option("lineSep", END).text(path).select(F.col("value").cast("binary").alias("chunk"))
    rows = chunks.where(F.length("chunk") > 0).mapInArrow(
        _documents, "doc_id long, part long, offset long, n_tokens long, ids binary")
    # One row for each file that was written, so its size is that of the folder's listing.
    totals = sorted(tuple(r) for r in part_sizes(chunks).collect())
    before, starts = 0, []
    for part, size in totals:
        starts.append((part, before))
        before += size
    first = spark.createDataFrame(starts, "part long, first long")
    return rows.join(F.broadcast(first), "part").select(
        "doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids")


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = [HEAD.unpack_from(h.as_py().replace(ESCAPE + b"\0", ESCAPE)) for h in batch.column("head")]
        yield pa.RecordBatch.from_arrays(
            [pa.array([h[3] for h in heads], pa.int64()), pa.array([h[5] + h[6] for h in heads], pa.int64())],
            names=["part", "size"])


def part_sizes(chunks: DataFrame) -> DataFrame:
    """Ids of each part, from its chunks' heads."""
    heads = chunks.where(F.length("chunk") > 0).select(F.substring("chunk", 1, 2 * HEAD.size).alias("head"))
    return heads.mapInArrow(_heads, "part long, size long").groupBy("part").agg(F.max("size").alias("size"))


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of `docs` to the shared folder, read them back, and take a checksum of each document."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write(docs, path, tokenizer)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
