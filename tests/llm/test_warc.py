import hashlib
import io
import struct
from pathlib import Path

import zstandard

from emberfold.llm import warc as w

SCHEMA = "page_id long, url string, html string, page string, digest string, frame string"


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


def page(k, size=400):
    return f"<html><body><p>page {k % 7} " + "some words that pages share " * (size // 28) + "</p></body></html>"


def expected(rows):
    first = {}
    for k, _, html in rows:
        if k is not None:
            first[html or ""] = min(first.get(html or "", k), k)
    out = []
    for k, _, html in rows:
        data = (html or "").encode()
        again = len(data) >= w.REVISIT_BYTES and html in first and k != first[html]
        out.append((k, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", first[html] if again else None))
    return sorted(out, key=str)


def test_round_trip_with_odd_rows(spark):
    rows = [(k, f"http://a.org/{k}", page(k)) for k in range(60)]
    rows += [(100, None, None), (101, "", ""), (102, "u\r\nWARC-Type: x", "short"), (103, "u", "short"), (5, "again", page(5)),
             (None, "n", page(1)), (None, "n", "alone " * 30), (104, "u", "é\U0001f600\r\n\r\n" * 40_000), (104, "u", "é" * 300)]
    got = sorted([tuple(r) for r in w.archived(table(spark, rows)).collect()], key=str)
    assert got == expected(rows)
    assert w.archived(table(spark, [])).count() == 0
    assert [tuple(r)[:2] for r in w.archived(table(spark, [(1, "u", "x")])).collect()] == [(1, 1)]


def test_files_are_plain_zstandard_streams_with_a_leading_dictionary(spark, tmp_path):
    rows = [(k, f"http://a.org/{k}", page(k, 2000) + str(k)) for k in range(500)]
    w.write(table(spark, rows).repartition(3), str(tmp_path / "out"))
    pages = 0
    for path in Path(tmp_path, "out").glob("part-*"):
        data = path.read_bytes()
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D
        words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
        reader = zstandard.ZstdDecompressor(dict_data=words).stream_reader(io.BytesIO(data), read_across_frames=True)
        plain = reader.read()
        pages += plain.count(b"WARC/1.1\r\n")
        assert len(data) < len(plain) / 5
    assert pages == 500


def test_damage_is_noticed(spark):
    record = w.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert w.parse_record(record)[:2] == (1, 7)
    try:
        w.parse_record(record.replace(b"payload\r\n", b"payloaD\r\n"))
    except ValueError:
        return
    raise AssertionError("a changed payload was accepted")


def test_no_payload_breaks_an_archive(spark):
    """The separator at every offset, alone and repeated, inside text that compresses and text that does not."""
    sign = "P*M\x18\0\0\0\0"
    rows = [(k, "u", "<p>" + "x" * k + sign + "</p>") for k in range(40)]
    rows += [(100 + k, "u", page(k) + sign * (k + 1) + "\u6f22" * k) for k in range(12)]
    rows += [(200, "u", sign * 20_000), (201, "u", sign[3:] + sign + sign[:3]), (202, "u", "P*M" * 30 + "\x18\0\0\0\0\0\0")]
    got = sorted([tuple(r) for r in w.archived(table(spark, rows)).collect()], key=str)
    assert got == expected(rows)


def test_raw_frames_hold_no_separator():
    for before in range(20):
        for after in range(12):
            data = b"\0" * before + w.EMPTY_FRAME * 2 + b"\0" * after + w.EMPTY_FRAME[:before % 8] + b"x" * (70_000 * (after == 0))
            made = w.raw_frame(data, 0)
            assert w.EMPTY_FRAME not in made and zstandard.ZstdDecompressor().decompress(made) == data
    learned = zstandard.ZstdCompressionDict(zstandard.train_dictionary(4096, [page(k).encode() for k in range(200)]).as_bytes())
    data = page(3).encode() + w.EMPTY_FRAME
    made = w.raw_frame(data, learned.dict_id())
    assert zstandard.get_frame_parameters(made).dict_id == learned.dict_id()
    assert zstandard.ZstdDecompressor(dict_data=learned).decompress(made) == data
    assert w.raw_frame(b"", 0) and zstandard.ZstdDecompressor().decompress(w.raw_frame(b"x", 0)) == b"x"
