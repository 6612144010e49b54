import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from emberfold.llm import rangecoder, tokenfile, tokens
from tests.llm import odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
SETTINGS = open(PATH, encoding="utf-8").read()
PLAIN = Tokenizer.from_str(SETTINGS)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def raw(texts):
    data = "".join(texts).encode()
    sizes = [len(t.encode()) for t in texts]
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(data, np.uint8)


def test_pieces_give_the_ids_of_whole_texts():
    random = np.random.default_rng(1)
    signs = ["a", "it's", "é", " ", " ", "　", "\u0085", "\x1f", " ", "  ", "\n", "\t", "\r\n", "12", ".", "漢字",
             "\U0001f600", "<|endoftext|>", "the", "'ll", "!", "a.b", "-", "x'", "'S", "re", "<", "|>", "_", "A1", "​", "ŠĠ"]
    texts = ["".join(random.choice(signs, random.integers(0, 30))) for _ in range(3000)] + ["", " ", "x" * 5000]
    known = tokens.Tokens(SETTINGS)
    assert known.by_piece
    for _ in range(3):  # the second time pieces come from the older generation, then all are known
        ids, sizes = known.encode(*raw(texts))
        if not known.old.known:
            known.old, known.young = known.young, tokens.Pieces()
        assert [list(p) for p in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts]
    known.by_piece = False
    ids, sizes = known.encode(*raw(texts))
    assert [list(p) for p in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts]
    assert not tokens.cuts_at_spaces(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_accented_words_are_cut_from_signs_and_learned_once():
    random = np.random.default_rng(3)
    signs = ["ä", "Ö", "ß", "à", "Å", "×", "÷", "ÿ", "a", " ", "\u00a0", "\u0085", "\n", "\t", "$", ".", "'", "s", "1", "<", "ñé", "Ġ", "漢"]
    texts = ["".join(random.choice(signs, random.integers(0, 20))) for _ in range(3000)]
    known = tokens.Tokens(SETTINGS)
    ids, sizes = known.encode(*raw(texts))
    assert [list(p) for p in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(t) for t in texts]
    bounds, data = raw(["grüß$$$ über.Öl", "\nÄhre", "a×b÷ c"])
    body, at = data.tobytes(), tokens.cuts(bounds, data)
    assert [body[a:b].decode() for a, b in zip(at, at[1:])] == [
        "grüß", "$$$", " über", ".", "Öl", "\n", "Ähre", "a×b÷", " c"]


def test_words_are_spelled_together():
    words = ["Ähre", " über", "x", " Ċ", "straße"]
    assert tokens.spelled_words(words) == [tokens.spelled(w) for w in words] and tokens.spelled_words([]) == []


def test_words_are_spelled_byte_by_byte():
    for piece in (a + b for a in map(chr, range(600)) for b in (" ", "A", "\n", "\x7f", "é", "")):
        assert tokens.spelled(piece) == "".join(tokens.SIGNS[b] for b in piece.encode())


@pytest.mark.parametrize("size", [0, 1, 2, 1023, 1024, 1025, 20_000])
@pytest.mark.parametrize("kind", ["text", "one", "random", "large"])
def test_blocks_round_trip(kind, size):
    random = np.random.default_rng(size)
    ids = {"text": random.zipf(1.3, size) % 50_257, "one": np.full(size, 7),
           "random": random.integers(0, 50_257, size), "large": random.integers(0, (1 << 28) - 1, size)}[kind]
    width = rangecoder.id_bytes_of(int(ids.max(initial=0)))
    blocks = rangecoder.encode(ids.astype(np.int32), width)
    assert rangecoder.decode(blocks, width).tolist() == ids.tolist()
    # Blocks are independent: any of them decodes alone, in any company.
    if len(blocks) > 2:
        assert rangecoder.decode(blocks[1:2] + blocks[:1], width).tolist() == ids[1024:2048].tolist() + ids[:1024].tolist()
    if kind == "one" and size == 20_000:
        assert sum(len(code) for _, _, code in blocks) < size // 8


def test_blocks_of_unequal_sizes_and_orders():
    random = np.random.default_rng(5)
    ids = np.concatenate([np.tile(random.integers(0, 50_257, 40), 60), random.zipf(1.2, 3000) % 50_257]).astype(np.int32)
    blocks = rangecoder.encode(ids, 2)
    assert rangecoder.decode(blocks, 2).tolist() == ids.tolist()
    assert rangecoder.decode(blocks[::-1], 2).tolist() == np.concatenate(
        [ids[k : k + 1024] for k in range(0, len(ids), 1024)][::-1]).tolist()
    # What repeats is foretold by the id before it.
    assert sum(len(code) for _, _, code in blocks[:2]) < 2 * 2048 // 4


def test_the_last_two_ids_foretell_what_the_last_one_cannot():
    random = np.random.default_rng(11)
    following = random.integers(0, 12, (12, 12))
    blocks = []
    for _ in range(20):  # each id has many successors, each pair of ids has one
        ids = list(random.integers(0, 12, 2))
        while len(ids) < rangecoder.BLOCK_IDS:
            ids.append(following[ids[-2], ids[-1]] if len(ids) % 60 else random.integers(0, 12))
        blocks.append(ids)
    ids = np.array(blocks).reshape(-1).astype(np.int32) + 40_000
    coded = rangecoder.encode(ids, 2)
    assert rangecoder.decode(coded, 2).tolist() == ids.tolist()
    assert sum(len(code) for _, _, code in coded) < len(ids) // 5


def test_a_guess_of_order_1_has_its_own_code_beside_order_2():
    random = np.random.default_rng(12)
    ids = np.concatenate([random.permutation(30)[:6] for _ in range(1500)])
    ids = np.where(random.random(len(ids)) < 0.5, ids, np.roll(ids, 1) * 7 % 30).astype(np.int32)
    kinds = np.zeros(4, int)
    pick = rangecoder.Encoder.pick

    def counted(self, ends, choice):
        kinds[:] += np.bincount(choice, minlength=4)
        return pick(self, ends, choice)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(rangecoder.Encoder, "pick", counted)
        coded = rangecoder.encode(ids, 2)
    assert rangecoder.decode(coded, 2).tolist() == ids.tolist()
    assert kinds.sum() == len(ids) and kinds.min() > 0


def test_damage_is_noticed():
    ids = (np.random.default_rng(2).zipf(1.3, 5000) % 50_257).astype(np.int32)
    chunk = tokenfile.pack_chunk(3, 0, 17, [5, None], np.array([4000, 1000]), ids)
    part, before, table, back = tokenfile.unpack_chunk(chunk)
    assert (part, before, table["doc_id"].tolist(), table["known"].tolist()) == (3, 17, [5, 0], [1, 0])
    assert back.tolist() == ids.tolist() and tokenfile.END.encode() not in chunk
    for at in (0, 9, 30, 50, 80, 120, len(chunk) // 2, len(chunk) - 9):
        broken = bytearray(chunk)
        broken[at] ^= 0x55
        with pytest.raises(Exception):
            if tokenfile.unpack_chunk(bytes(broken))[3].tolist() == ids.tolist():
                raise ValueError("no difference to the ids")


def test_every_byte_survives_the_line_format():
    for byte in (0x1B, 0x01, 0x00, 0x0A):
        names = [int.from_bytes(bytes([byte]) * 8, "little", signed=True)] * 3
        chunk = tokenfile.pack_chunk(0x1B1B1B1B, 0x011B, 0x1B, names, np.array([1, 1, 1]), np.array([27, 1, 0], np.int32))
        assert tokenfile.END.encode() not in chunk and not chunk.endswith(b"\x1b")
        assert tokenfile.unpack_chunk(chunk)[2]["doc_id"].tolist() == names


def expected(rows):
    start, out = 0, []
    for doc_id, text in rows:
        ids = [*ids_of(text), 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_documents_in_order_with_odd_rows(spark, monkeypatch):
    docs = odd.documents(spark)
    got = [tuple(r) for r in tokenfile.digests(docs, PATH).orderBy("start").collect()]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted((r[0] is None, r[0] or 0) for r in got) == [(r[0] is None, r[0] or 0) for r in got]
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])])[:-1].tolist()
    assert sorted((str(r[0]), *r[2:]) for r in got) == sorted((str(r[0]), *r[2:]) for r in expected(rows))
    assert tokenfile.digests(odd.empty(spark), PATH).count() == 0


def test_many_documents_over_several_files(spark):
    texts = [(k * 7 % 501, " ".join(f"word{(k * j) % 37}" for j in range(k % 90)), "en", "a") for k in range(501)]
    docs = odd.documents(spark, texts).repartition(5)
    got = sorted(tuple(r) for r in tokenfile.digests(docs, PATH).collect())
    assert got == expected(sorted(t[:2] for t in texts))


def test_texts_are_taken_in_bounded_runs(monkeypatch):
    monkeypatch.setattr(tokenfile, "PIECE_BYTES", 10)
    texts = ["", "12345678901234567890", "abc", "", "de", "fghijk", ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts})
    runs = list(tokenfile._texts(iter([batch.slice(0, 3), batch.slice(3)])))
    assert [d for names, _, _ in runs for d in names] == list(range(7))
    assert [data[a:b].tobytes().decode() for _, bounds, data in runs for a, b in zip(bounds, bounds[1:])] == texts
