import itertools
import time

import numpy as np

from emberfold.llm import extract as e
from emberfold.llm.blocks import leaves

SCHEMA = "page_id long, url string, html string, text string, words string"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>Alpha</a><li><a href=/b>Beta</a></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div>
<article><h1>Title &amp; more</h1><p>First <b>bold
 text</b> of the story, it is long enough.<p>Second &lt;x&gt; one with&nbsp;space and a good length.
<div class="ad">Buy something today, it is cheap.</div><ul><li>An item of the list.<li>Another item of it.</ul>
<script>var x = "</p><p>no</p>";</script><!-- <p>no</p> -->
<section id="comments"><h3>Comments</h3><p>I liked this story very much indeed.</p></section></article>
<aside class="sidebar"><p>Related: other stories</p></aside><form><label>Mail</label><button>Send</button></form>
<footer>&copy; site</footer></body></html>"""
TEXT = ("Title & more\nFirst bold text of the story, it is long enough.\nSecond <x> one with space and a good length.\n"
        "An item of the list.\nAnother item of it.")


def test_chain_sums_equal_enumeration():
    random = np.random.default_rng(2)
    unary, moves = random.normal(size=(6, 2)), random.normal(size=(2, 2))
    scores = {y: sum(unary[k, v] for k, v in enumerate(y)) + sum(moves[a, b] for a, b in zip(y, y[1:]))
              for y in itertools.product((0, 1), repeat=6)}
    total = np.log(sum(np.exp(s) for s in scores.values()))
    single, pairs, log_total = e.chain(unary, moves)
    assert abs(log_total - total) < 1e-9
    for k in range(6):
        assert abs(single[k, 1] - sum(np.exp(s - total) for y, s in scores.items() if y[k])) < 1e-9
    assert abs(pairs[2, 1, 0] - sum(np.exp(s - total) for y, s in scores.items() if y[2] and not y[3])) < 1e-9
    assert tuple(e.decode([tuple(u) for u in unary], moves.tolist())) == max(scores, key=scores.get)


def test_blocks_of_broken_pages():
    def texts(page):
        return [leaf.text for leaf in leaves(page)]

    assert texts("") == texts("<p") == texts("<script>x") == texts("<!-- x") == []
    assert texts("a < b and c > d") == ["a < b and c > d"]
    assert texts("<p>a<p>b</div></p><br>c") == ["a", "b", "c"]
    assert texts('<a href="x>y">k</a><img alt="<p>">l') == ["kl"]
    assert texts("<div hidden>z</div><p style='display: none'>y</p>q &#65;&bogus;") == ["z", "y", "q A&bogus;"]
    assert texts("<p>a<math><mi>x</mi></math>b<noscript>c</noscript><object>d<object>e</object>f</object><svg><title>no</title>g</svg>") == ["axbcdefg"]
    assert texts("<p>a<textarea>no</textarea><p>b<template><p>no</template>c") == ["a", "bc"]
    assert texts("<![CDATA[a <p> b]]>") == ["a <p> b"]
    assert texts("<ul><li>a<ul><li>b</ul><li>c</ul>") == ["a", "b", "c"]
    assert len(texts("<p>x" * 50_000)) == 50_000


def test_held_out_layouts(spark):
    pages = spark.createDataFrame([(k, "u", PAGE, None, None) for k in range(3)], SCHEMA)
    model, moves = e.fit(pages)
    held = e.Layouts(e.SEED + 1)
    hit = wrong = missed = 0
    for _ in range(100):
        found, labels = held.page()
        for a, b in zip(e.decode(e.block_scores(found, model), moves), labels):
            hit, wrong, missed = hit + (a and b), wrong + (a and not b), missed + (b and not a)
    assert 2 * hit / (2 * hit + wrong + missed) > 0.93
    got = e.extract(pages).collect()
    assert [(r.text, r.n_chars) for r in got] == [(TEXT, len(TEXT))] * 3


def test_odd_rows(spark):
    long = "<article>" + "<p>A sentence of the article, long enough.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "u", ""), (3, "u", "<nav><a href=/>x</a></nav>"), (4, "u", long)]
    table = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = [(r.page_id, r.url, r.text, r.n_chars) for r in e.extract(table).collect()]
    assert got.count((1, "u", TEXT, len(TEXT))) == 2
    assert (None, None, "", 0) in got and (2, "u", "", 0) in got and (3, "u", "", 0) in got
    assert [len(t.split("\n")) for k, _, t, _ in got if k == 4] == [20_000]
    assert e.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_scores_equal_sums_of_features():
    random = np.random.default_rng(4)
    for seed in range(20):
        found, _ = e.Layouts(seed).page()
        listed = e.features(found)
        model = {f: tuple(random.normal(size=2)) for f in {f for block in listed for f in block}}
        for block, score in zip(listed, e.block_scores(found, model)):
            assert np.allclose(score, np.sum([model[f] for f in block], axis=0))


def test_hidden_formulas_and_fallbacks_stay(spark):
    story = "A long sentence of the story that goes on and on until its end."
    page = PAGE.replace("<ul><li>An", f"<div hidden><p>{story}</div><p>Sum <math><mi>x</mi></math> is in this formula, as all know."
                        f"<noscript><p>{story}</noscript><ul><li>An")
    got = e.extract(spark.createDataFrame([(1, "u", page, None, None)], SCHEMA)).first().text
    assert got.count(story) == 2 and "Sum x is in this formula, as all know." in got
    assert got.replace(f"{story}\n", "").replace("Sum x is in this formula, as all know.\n", "") == TEXT


def test_deep_pages_take_linear_time():
    began = time.process_time()
    deep = leaves("<div class=a><p>x" * 50_000)
    assert len(deep) == 50_000
    scores = e.block_scores(deep, {"in div": (1.0, 0.0), "name a": (0.0, 1.0), "own p": (0.5, 0.5)})
    assert set(scores) == {(1.5, 1.5)}
    leaves("<div>" * 50_000 + "</span></b></li>" * 50_000 + "</div>" * 50_000)
    assert time.process_time() - began < 30
