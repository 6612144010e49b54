import hashlib

import numpy as np
import pyarrow as pa
import pytest

from emberfold.llm import infill as f
from tests.llm import odd


def plain_version(doc_id, text):
    """The contract, one text at a time."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def draws(doc_id):
    digest = hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


@pytest.mark.parametrize("block", [1, 2, 7, 1 << 18])
def test_one_batch_of_awkward_texts(block, monkeypatch):
    monkeypatch.setattr(f, "BLOCK", block)
    random = np.random.default_rng(3)
    texts = ["".join(random.choice(list("aé漢\U0001f600<PSM> \n"), random.integers(0, 40))) for _ in range(300)]
    texts += ["<P", ">x", "", "<", "S>", "<M>", "a<S>", "é<", "P>"]
    made = f.cut(pa.array(texts), [draws(k) for k in range(len(texts))])
    rows = list(zip(*(made[c].to_pylist() for c in ("n", "form", "prefix_chars", "middle_chars", "output"))))
    assert rows == [plain_version(k, t) for k, t in enumerate(texts)]
    assert {r[1] for r in rows} == {"plain", "psm", "spm"}
    assert f.rebuild(made["output"], made["form"].to_pylist()).to_pylist() == texts


def test_slices_of_arrays_and_empty_batches():
    texts = pa.array(["lost", "kept é", "also kept", "lost"]).slice(1, 2)
    made = f.cut(texts, [draws(1), draws(2)])
    assert f.rebuild(made["output"], made["form"].to_pylist()).to_pylist() == ["kept é", "also kept"]
    assert f.cut(pa.array([], pa.string()), [])["output"].to_pylist() == []
    assert f.rebuild(pa.array([], pa.string()), []).to_pylist() == []


def test_table_with_odd_rows(spark, monkeypatch):
    docs = odd.documents(spark)
    got = sorted(map(tuple, f.restore(f.transform(docs)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored").collect()), key=str)
    want = sorted([(r.doc_id, *plain_version(r.doc_id, r.text), r.text or "") for r in docs.collect()], key=str)
    assert got == want
    digest = f.digests(docs).collect()
    assert {r.restored_sha256 for r in digest} == {hashlib.sha256(w[-1].encode()).hexdigest() for w in want}
    assert f.digests(odd.empty(spark)).count() == 0
