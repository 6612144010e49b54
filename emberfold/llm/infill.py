"""Fill-in-middle: texts are cut in three and put together in another order, and can be put back.

The bytes of a batch of texts are moved at once. A scan over the code points finds the cuts; a difference
array holds, where a piece begins, by how much its shift differs from that of the piece before; its running
sum is every byte's displacement, by which the bytes are scattered into the output. Restoring needs the
output and its form only: the three marks give the places of the pieces, and the same displacements
gather every byte back. The work goes block by block, so that a very long text needs no more memory than
its own bytes a few times over.

Where a text is cut and which form it takes depends on a hash of its doc_id alone, so reruns and retried
tasks give the same output.

Defined cases: a null text is an empty one; empty texts and texts that hold a mark stay plain; a null
doc_id hashes as the empty text; rows that repeat give equal rows. An empty table gives no rows. Other
columns of the input do not come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import prepare

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = 3
PLAIN_FROM = 90  # of 100 texts, those drawn from here on stay plain
SPM_BELOW = 20  # of 100 texts, those drawn below put the suffix first

BATCH_BYTES = 4 << 20
BLOCK = 1 << 18

#: How the pieces (0 prefix, 1 middle, 2 suffix) follow each other, and the mark before each.
ORDERS = {"psm": ((0, PREFIX), (2, SUFFIX), (1, MIDDLE)), "spm": ((2, SUFFIX), (0, PREFIX), (1, MIDDLE))}


def marks(data: np.ndarray) -> np.ndarray:
    """Places of all marks in `data`."""
    at = np.flatnonzero(data[: max(len(data) - 2, 0)] == 0x3C)
    inner = data[at + 1]
    return at[(data[at + 2] == 0x3E) & ((inner == 0x50) | (inner == 0x53) | (inner == 0x4D))]


def unit_offset(lead: np.ndarray, start: int, end: int, units: int) -> int:
    """Where, within [start, end), code point number `units` begins; the end if there are not as many."""
    for low in range(start, end, BLOCK):
        high = min(low + BLOCK, end)
        here = int(np.count_nonzero(lead[low:high]))
        if units < here:
            return low + int(np.flatnonzero(lead[low:high])[units])
        units -= here
    return end


def displacements(size: int, breaks: np.ndarray, shifts: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(low, high, where each of these bytes goes); from `breaks[k]` on the shift is `shifts[k]`."""
    steps = np.diff(shifts, prepend=0)
    carried = 0
    for low in range(0, size, BLOCK):
        high = min(low + BLOCK, size)
        first, last = np.searchsorted(breaks, [low, high])
        moved = np.zeros(high - low, np.int64)
        np.add.at(moved, breaks[first:last] - low, steps[first:last])
        moved[0] += carried
        np.cumsum(moved, out=moved)
        carried = int(moved[-1])
        moved += np.arange(low, high)
        yield low, high, moved


def _strings(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data))


def _raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of texts without nulls."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data else np.zeros(0, np.uint8)
    return bounds - bounds[0], body


def cut(texts: pa.Array, draws: list[tuple[int, int, int, int]]) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of each text."""
    bounds, data = _raw(texts)
    lead = (data & 0xC0) != 0x80
    # A mark lies inside one text: neither begins nor ends in the next.
    found = marks(data)
    marked = np.searchsorted(found, bounds - MARK + 1)
    here = np.searchsorted(found, bounds[:-1])
    units = [int(np.count_nonzero(lead[a:b])) for a, b in zip(bounds, bounds[1:])]
    forms, prefixes, middles = [], [], []
    breaks, shifts, out_bounds, signs = [], [], [0], []
    for k, (h1, h2, h3, h4) in enumerate(draws):
        start, end, n = int(bounds[k]), int(bounds[k + 1]), units[k]
        to = out_bounds[-1]
        if start == end or marked[k + 1] > here[k] or h3 % 100 >= PLAIN_FROM:
            forms.append("plain")
            prefixes.append(None)
            middles.append(None)
            breaks.append(start)
            shifts.append(to - start)
            out_bounds.append(to + end - start)
            continue
        first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
        one = unit_offset(lead, start, end, first)
        two = unit_offset(lead, one, end, last - first)
        pieces = ((start, one), (one, two), (two, end))
        form = "spm" if h4 % 100 < SPM_BELOW else "psm"
        placed = [0, 0, 0]
        for piece, mark in ORDERS[form]:
            signs.append((to, mark))
            placed[piece] = to + MARK - pieces[piece][0]
            to += MARK + pieces[piece][1] - pieces[piece][0]
        breaks += [start, one, two]
        shifts += placed
        forms.append(form)
        prefixes.append(first)
        middles.append(last - first)
        out_bounds.append(to)
    out = np.empty(out_bounds[-1], np.uint8)
    for low, high, to in displacements(len(data), np.array(breaks, np.int64), np.array(shifts, np.int64)):
        out[to] = data[low:high]
    if signs:
        at = np.array([s[0] for s in signs])
        out[at[:, None] + np.arange(MARK)] = np.frombuffer(b"".join(s[1] for s in signs), np.uint8).reshape(-1, MARK)
    return {"n": pa.array(units, pa.int64()), "form": pa.array(forms, pa.string()),
            "prefix_chars": pa.array(prefixes, pa.int64()), "middle_chars": pa.array(middles, pa.int64()),
            "output": _strings(np.array(out_bounds), out)}


def rebuild(outputs: pa.Array, forms: list[str]) -> pa.Array:
    """The texts that gave these outputs."""
    bounds, data = _raw(outputs)
    found = marks(data)
    first = np.searchsorted(found, bounds)
    breaks, shifts, text_bounds = [], [], [0]
    for k, form in enumerate(forms):
        start, end, to = int(bounds[k]), int(bounds[k + 1]), text_bounds[-1]
        if form == "plain":
            breaks.append(to)
            shifts.append(start - to)
            text_bounds.append(to + end - start)
            continue
        a, b, c = (int(x) for x in found[first[k] : first[k] + 3])
        spans = ((a + MARK, b), (b + MARK, c), (c + MARK, end))
        held = {piece: span for (piece, _), span in zip(ORDERS[form], spans)}
        for piece in range(3):
            low, high = held[piece]
            breaks.append(to)
            shifts.append(low - to)
            to += high - low
        text_bounds.append(to)
    out = np.empty(text_bounds[-1], np.uint8)
    for low, high, source in displacements(len(out), np.array(breaks, np.int64), np.array(shifts, np.int64)):
        out[low:high] = data[source]
    return _strings(np.array(text_bounds), out)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Rows (from, to) whose texts hold about BATCH_BYTES together, one text at least."""
    start, held = 0, 0
    for k, size in enumerate(sizes.tolist()):
        if k > start and held + size > BATCH_BYTES:
            yield start, k
            start, held = k, 0
        held += size
    if start < len(sizes):
        yield start, len(sizes)


def _cut_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, _ = _raw(batch.column("text"))
        for a, b in _slices(np.diff(bounds)):
            part = batch.slice(a, b - a)
            draws = list(zip(*(part.column(h).to_pylist() for h in ("h1", "h2", "h3", "h4"))))
            made = cut(part.column("text"), draws)
            made["output"] = made["output"].cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *made.values()], names=["doc_id", *made])


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bounds, _ = _raw(batch.column("output"))
        for a, b in _slices(np.diff(bounds)):
            part = batch.slice(a, b - a)
            texts = rebuild(part.column("output"), part.column("form").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*part.columns, texts.cast(pa.string())], names=[*part.schema.names, "restored"])


def draw(number: int) -> Column:
    """The draw h1 to h4 of a row: a group of eight hexadecimal digits of a hash of its doc_id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[draw(k).alias(f"h{k}") for k in (1, 2, 3, 4)])
    return rows.mapInArrow(
        _cut_batches, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(made: DataFrame) -> DataFrame:
    """`made` (with the columns form and output) and the text it was made from as `restored`."""
    prepare(made.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema)
    return made.mapInArrow(_restore_batches, f"{schema}, restored string")


def digests(docs: DataFrame) -> DataFrame:
    """The outputs of `docs` and the texts rebuilt from them, as hashes."""
    both = restore(transform(docs))
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLE_SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
numbers AS (
  SELECT doc_id, t, n,
    CAST('0x' || substr(x, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(x, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(x, 17, 8) AS BIGINT) % 100 AS c, CAST('0x' || substr(x, 25, 8) AS BIGINT) % 100 AS d FROM drawn),
cuts AS (
  SELECT doc_id, t, n, least(a, b) AS first, greatest(a, b) AS last,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain'
         WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form FROM numbers),
pieces AS (
  SELECT *, substr(t, 1, first) AS prefix, substr(t, first + 1, last - first) AS middle, substr(t, last + 1) AS suffix FROM cuts)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(first AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(last - first AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
