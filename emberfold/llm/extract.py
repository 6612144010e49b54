"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

Each leaf block is described by the tags and class names of its ancestors and by its text (length,
share of linked characters, punctuation, place on the page). The field scores every block and every
pair of neighbours and is decoded by Viterbi; the main blocks in page order are the text.

It is trained by gradient ascent on labelled pages: `LAYOUTS` generated ones, whose generator knows
which block is main text, in many arrangements of the elements and class names in use, and at most
`SAMPLE` pages of the table that name their regions themselves (one article or main element, the
usual elements for the rest), which are labelled by these elements. Training sees a bounded number of
pages; extraction covers all.

Defined cases: a null or empty html, or one without a main block, gives an empty text; repeated rows
give equal rows. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberfold.llm.blocks import Leaf, leaves
from emberfold.llm.common import prepare

LAYOUTS = 300
SAMPLE = 100
SAMPLE_BYTES = 262_144  # longer pages are not used as examples
SAMPLE_LEAVES = 200
EPOCHS = 12
RATE = 0.3
PENALTY = 1e-4
SEED = 5

# What the parts of a page are called in practice.
ASIDE_TAGS = frozenset("nav aside footer form header dialog button select menu".split())
MAIN_NAMES = "content post entry article story body text main page prose copy".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation topbar breadcrumb breadcrumbs pagination pager toc".split(),
    "header": "header masthead banner branding logo".split(),
    "footer": "footer bottom copyright legal colophon".split(),
    "aside": "sidebar aside related recommended widget trending popular archive tags".split(),
    "notice": "cookie consent notice gdpr alert popup modal overlay message disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promotion banner".split(),
    "form": "form login search newsletter subscribe signup".split(),
    "comments": "comment comments reply replies discussion respond disqus reader".split(),
    "share": "share social sharing follow buttons".split(),
}

Model = dict[str, tuple[float, float]]


def own_features(page: list[Leaf]) -> list[list[str]]:
    """What describes each block but the marks of the elements around it."""
    out = []
    for k, leaf in enumerate(page):
        text, inner = leaf.text, leaf.inside
        words = text.count(" ") + 1
        density = leaf.linked / len(text)
        found = {"bias", f"words {int(math.log2(words))}", f"links {math.ceil(density * 3)}",
                 f"place {4 * k // len(page)}", "first" if k == 0 else "last" if k == len(page) - 1 else "between"}
        found.add("ends" if text[-1] in ".!?:;\"'”’)…。" else "open")
        if "©" in text or "copyright" in text[:200].lower():
            found.add("copyright")
        if inner is not None:
            found.add(f"own {inner.tag}")
            found.add(f"pair {inner.tag} {int(math.log2(words)) > 2} {density > 0.5}")
        out.append(sorted(found))
    return out


def features(page: list[Leaf]) -> list[list[str]]:
    """All that describes each block; for pages of bounded size."""
    return [sorted({*own, *(m for element in leaf.path() for m in element.fresh)})
            for leaf, own in zip(page, own_features(page))]


def block_scores(page: list[Leaf], model: Model) -> list[tuple[float, float]]:
    """Sums of the weights of each block's features; those of an element serve all blocks in it."""
    none = (0.0, 0.0)
    sums: dict[int, tuple[float, float]] = {}

    def around(element) -> tuple[float, float]:
        chain = []
        while element is not None and id(element) not in sums:
            chain.append(element)
            element = element.parent
        total = sums[id(element)] if element is not None else none
        for element in reversed(chain):
            pairs = [model.get(m, none) for m in element.fresh]
            total = (total[0] + sum(p[0] for p in pairs), total[1] + sum(p[1] for p in pairs))
            sums[id(element)] = total
        return total

    out = []
    for leaf, own in zip(page, own_features(page)):
        pairs = [model.get(f, none) for f in own]
        outer = around(leaf.inside)
        out.append((outer[0] + sum(p[0] for p in pairs), outer[1] + sum(p[1] for p in pairs)))
    return out


def chain(unary: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of blocks and of neighbours, and the log partition, by forward and backward sums."""
    n = len(unary)
    ahead, behind = np.zeros((n, 2)), np.zeros((n, 2))
    ahead[0] = unary[0]
    for k in range(1, n):
        ahead[k] = unary[k] + np.logaddexp(ahead[k - 1, 0] + moves[0], ahead[k - 1, 1] + moves[1])
    for k in range(n - 2, -1, -1):
        later = unary[k + 1] + behind[k + 1]
        behind[k] = np.logaddexp(moves[:, 0] + later[0], moves[:, 1] + later[1])
    total = float(np.logaddexp(ahead[-1, 0], ahead[-1, 1]))
    single = np.exp(ahead + behind - total)
    pairs = np.exp(ahead[:-1, :, None] + moves + (unary[1:] + behind[1:])[:, None, :] - total)
    return single, pairs, total


def train(pages: list[tuple[list[list[str]], list[int]]]) -> tuple[Model, list[list[float]]]:
    """Weights by Adagrad on the pages' log likelihood."""
    index: dict[str, int] = {}
    coded = [([np.array([index.setdefault(f, len(index)) for f in block]) for block in blocks], np.array(labels))
             for blocks, labels in pages if blocks]
    weights, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    seen_w, seen_m = np.full_like(weights, 1e-2), np.full_like(moves, 1e-2)
    random = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for p in random.permutation(len(coded)):
            blocks, labels = coded[p]
            unary = np.stack([weights[block].sum(axis=0) for block in blocks])
            single, pairs, _ = chain(unary, moves)
            error = -single
            error[np.arange(len(labels)), labels] += 1
            step_m = -pairs.sum(axis=0)
            np.add.at(step_m, (labels[:-1], labels[1:]), 1)
            used = np.concatenate(blocks)
            step_w = np.zeros_like(weights)
            np.add.at(step_w, used, np.repeat(error, [len(b) for b in blocks], axis=0))
            touched = np.unique(used)
            gradient = step_w[touched] - PENALTY * weights[touched]
            seen_w[touched] += gradient**2
            weights[touched] += RATE * gradient / np.sqrt(seen_w[touched])
            seen_m += step_m**2
            moves += RATE * step_m / np.sqrt(seen_m)
    return {f: (float(weights[k, 0]), float(weights[k, 1])) for f, k in index.items()}, moves.tolist()


def decode(unary: list[tuple[float, float]], moves: list[list[float]]) -> list[int]:
    """The most probable labels, by Viterbi."""
    (m00, m01), (m10, m11) = moves
    best0 = best1 = 0.0
    back: list[tuple[int, int]] = []
    for k, (u0, u1) in enumerate(unary):
        if k == 0:
            best0, best1 = u0, u1
            continue
        from0, from1 = best1 + m10 > best0 + m00, best1 + m11 > best0 + m01
        back.append((int(from0), int(from1)))
        best0, best1 = (u0 + (best1 + m10 if from0 else best0 + m00), u1 + (best1 + m11 if from1 else best0 + m01))
    if not unary:
        return []
    labels = [int(best1 > best0)]
    for step in reversed(back):
        labels.append(step[labels[-1]])
    return labels[::-1]


class Layouts:
    """Pages with known main blocks, in varied arrangements."""

    def __init__(self, seed: int) -> None:
        self.random = np.random.default_rng(seed)

    def chance(self, p: float) -> bool:
        return bool(self.random.random() < p)

    def one(self, options: list):
        return options[int(self.random.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        n = int(self.random.integers(low, high + 1))
        text = " ".join("".join(self.one("abcdeilmnorstu") for _ in range(self.random.integers(2, 9))) for _ in range(n))
        return text.capitalize()

    def sentences(self) -> str:
        """A block of main text: any length, mostly long, mostly with a full stop."""
        long = self.chance(0.75)
        text = self.words(8, 120) if long else self.words(1, 8)
        if self.chance(0.12):
            text += f' <a href="/x">{self.words(1, 4)}</a> {self.words(1, 12)}'
        return text + ("." if self.chance(0.9 if long else 0.6) else "")

    def part(self, kind: str) -> list[tuple[str, int]]:
        """Markup pieces of a part that is not main text, each with label 0."""
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form"}.get(kind, "div")
        name = self.one(OTHER_NAMES[kind])
        styled = self.chance(0.35) or tag == "div"
        tag = tag if tag != "div" and self.chance(0.6) else self.one(["div", "div", "section", "aside"])
        if tag in ("div", "section"):
            styled = True
        attribute = ""
        if styled:
            attribute = f' {self.one(["class", "class", "id"])}="{name}{self.one(["", "", "-box", "_wrap", " x1"])}"'
        out = [(f"<{tag}{attribute}>", -1)]
        if kind in ("nav", "share"):
            out.append(("<ul>", -1))
            for _ in range(self.random.integers(2, 9)):
                out.append((f'<li><a href="/y">{self.words(1, 3)}</a>', 0))
                out.append(("</li>" if self.chance(0.8) else "", -1))
            out.append(("</ul>", -1))
        elif kind == "form":
            out += [(f"<label>{self.words(1, 4)}</label><input>", 0), (f"<button>{self.words(1, 2)}</button>", 0)]
        else:
            if self.chance(0.4):
                out.append((f"<{self.one(['h2', 'h3', 'h4'])}>{self.words(1, 5)}", 0))
            for _ in range(self.random.integers(1, 5)):
                end = self.one([".", ".", ""])
                sign = "&copy; " if kind == "footer" and self.chance(0.6) else ""
                low, high = (5, 60) if kind in ("comments", "notice", "ad", "aside", "footer") else (1, 10)
                inner = sign + self.words(low, high) + end
                if self.chance(0.3):
                    inner = f'<a href="/z">{inner}</a>'
                out.append((f"<{self.one(['p', 'p', 'div'])}>{inner}", 0))
                if self.chance(0.2):
                    out[-1] = (out[-1][0].split(">", 1)[1], 0)
                    break
        out.append((f"</{tag}>", -1))
        return out

    def article(self) -> list[tuple[str, int]]:
        tag = self.one(["article", "article", "main", "div", "section"])
        name = self.one(MAIN_NAMES)
        attribute = f' class="{name}{self.one(["", "-body", " y2", "-content"])}"' if self.chance(0.4) or tag in ("div", "section") else ""
        out = [(f"<{tag}{attribute}>", -1)]
        if self.chance(0.75):
            out.append((f"<h1>{self.words(2, 12)}</h1>", 1))
        for _ in range(self.random.integers(1, 14)):
            kind = self.random.random()
            if kind < 0.72:
                bold = "<b>" if self.chance(0.1) else ""
                out.append((f"<p>{bold}{self.sentences()}{'<br>' if bold else ''}", 1))
            elif kind < 0.82:
                out.append((f"<{self.one(['h2', 'h3'])}>{self.words(1, 8)}", 1))
            elif kind < 0.9:
                out.append((f"<{self.one(['ul', 'ol'])}>", -1))
                out += [(f"<li>{self.sentences()}", 1) for _ in range(self.random.integers(1, 6))]
                out.append(("</li></ul>", -1))
                out[-1] = ("</ul></ol>", -1)
            elif kind < 0.95:
                out += [(f"<blockquote>{self.sentences()}", 1), ("</blockquote>", -1)]
            else:
                out += [("<table><tr>", -1), (f"<td>{self.words(1, 6)}", 1), (f"<td>{self.words(1, 6)}", 1), ("</table>", -1)]
            if self.chance(0.06):
                out += self.part(self.one(["ad", "aside", "share", "form", "notice"]))
        if self.chance(0.25):
            out += self.part("comments")
        out.append((f"</{tag}>" if self.chance(0.95) else "", -1))
        return out

    def page(self) -> tuple[list[Leaf], list[int]]:
        before = [k for k in ("notice", "header", "nav", "form", "ad") if self.chance(0.55)]
        after = [k for k in ("share", "comments", "aside", "form", "ad", "footer") if self.chance(0.5)]
        pieces = [piece for k in before for piece in self.part(k)] + self.article()
        pieces += [piece for k in after for piece in self.part(k)]
        # Marks of the private-use area carry the labels through the reader.
        marked = "".join(m if label < 0 else _mark(m, label) for m, label in pieces)
        return _labelled(leaves(f"<html><head><title>x</title></head><body>{marked}</body></html>"))


def _mark(markup: str, label: int) -> str:
    at = markup.find(">") + 1 if markup.startswith("<") else 0
    while markup.startswith("<", at):
        at = markup.index(">", at) + 1
    return markup[:at] + chr(0xE000 + label) + markup[at:]


def _labelled(found: list[Leaf]) -> tuple[list[Leaf], list[int]]:
    labels = []
    for leaf in found:
        labels.append(int("\ue001" in leaf.text))
        leaf.text = leaf.text.replace("\ue000", "").replace("\ue001", "").strip() or "x"
    return found, labels


def self_labelled(page: str) -> tuple[list[Leaf], list[int]] | None:
    """Blocks of a page whose elements say what is main text, or nothing."""
    found = leaves(page)
    outside = {name for names in OTHER_NAMES.values() for name in names}
    if len(found) > SAMPLE_LEAVES:
        return None
    labels = []
    for leaf in found:
        tags = [e.tag for e in leaf.path()]
        main = any(t in ("article", "main") for t in tags)
        other = ASIDE_TAGS.intersection(tags) or any(outside.intersection(e.names) for e in leaf.path())
        labels.append(int(main and not other))
    return (found, labels) if sum(labels) else None


def fit(pages: DataFrame) -> tuple[Model, list[list[float]]]:
    html = F.col("html").cast("string")
    usable = pages.where((F.length(html) <= SAMPLE_BYTES) & html.rlike("(?i)<(article|main)[ >]")).select(
        F.xxhash64(F.col("page_id").cast("long")).alias("o"), F.xxhash64(html).alias("h"), html.alias("html"))
    # Chosen by their hashes first, so that tasks send no pages that are not wanted.
    chosen = usable.select("o", "h").distinct().orderBy("o", "h").limit(SAMPLE)
    rows = usable.join(F.broadcast(chosen), ["o", "h"]).groupBy("o", "h").agg(F.min("html").alias("html")).collect()
    rows.sort(key=lambda r: (r.o, r.h))
    examples = [e for row in rows if (e := self_labelled(row.html))]
    layouts = Layouts(SEED)
    examples += [layouts.page() for _ in range(LAYOUTS)]
    return train([(features(found), labels) for found, labels in examples])


def main_text(page: str, model: Model, moves: list[list[float]]) -> str:
    found = leaves(page)
    labels = decode(block_scores(found, model), moves)
    return "\n".join(leaf.text for leaf, label in zip(found, labels) if label)


def _extract(fitted: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, moves = fitted.value
        for batch in batches:
            texts = [main_text(p.as_py(), model, moves) if p.is_valid else "" for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`."""
    spark = prepare(pages.sparkSession)
    fitted = spark.sparkContext.broadcast(fit(pages))  # a few hundred features
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extract(fitted), "page_id long, url string, text string, n_chars long")
