"""Quality rules: word statistics of whole texts, and robust multivariate outliers per language and source.

Base rules reject a text with few words or with much repetition. The rest is judged by a minimum
covariance determinant (MCD) estimate: among the base-passing rows of a group, the subset of
`SUPPORT` of the rows whose covariance determinant is smallest is approached by concentration steps
(Rousseeuw and Van Driessen, 1999); rows far from its centre by Mahalanobis distance are rejected.

Every step is one aggregation by (group, bin of the distance), so any group, however large, is
summed map-side; bins are cumulated per group to find the support. Statistics are fixed-point
numbers, so sums are exact and reruns agree.

Defined cases: null and empty texts have no words and fail the base rules; null `lang` or `source`
is a group of its own; groups under `MIN_GROUP` rows are estimated together with the other small
groups of their language, then with all small ones; where even these are too few, the base rules
decide alone. Repeated rows count as often as they occur. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberfold.llm.common import doc_key, lookup, prepare, real_id, split_by_keys, stored, text_tie

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
NGRAM = 5

SUPPORT = 0.75
STEPS = 4
MIN_GROUP = 50
#: Rows beyond this squared distance are rejected. For five normal statistics the chance of a clean
#: row to lie there is below 1e-12; the wide margin is for tails heavier than normal.
CUT = 70.0
#: Least standard deviation of each statistic: many groups have no spread at all in some of them.
FLOORS = (0.30, 0.05, 0.50, 0.70, 0.70)
SCALE = 1024
STEADY = 20
BINS = 16
P = len(FLOORS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 5-word windows that occur at least twice in the text."""
    n = len(words)
    if n <= NGRAM:
        return 0
    first: dict[bytes, int] = {}
    ids = np.fromiter(map(first.setdefault, words, count()), np.int64, n)
    bits = n.bit_length()
    if NGRAM * bits <= 63:
        codes = ids[: n - NGRAM + 1].copy()
        for k in range(1, NGRAM):
            codes = (codes << bits) | ids[k : n - NGRAM + 1 + k]
    else:
        codes = ids
        for k in range(1, NGRAM):  # ranks stay under n, so a pair of them always fits
            pairs = codes[:-1] * n + ids[k:] if k == 1 else codes[: n - k] * n + ids[k:]
            codes = np.unique(pairs, return_inverse=True)[1]
    ordered = np.sort(codes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    starts = np.isin(codes, twice).astype(np.int64)
    edges = np.zeros(n + 1, np.int64)
    edges[: len(starts)] += starts
    edges[NGRAM : NGRAM + len(starts)] -= starts
    return int((np.cumsum(edges[:n]) > 0).sum())


def text_statistics(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        len(text.translate(None, CONTINUATION + SPACE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [text_statistics(t.as_py()) for t in batch.column("text")]
        columns = zip(*found) if found else [[]] * len(STATS)
        arrays = [pa.array(c, pa.int64()) for c in columns]
        names = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + arrays, names=names + STATS)


def statistics(docs: DataFrame) -> DataFrame:
    """doc, tie, lang, source and the five statistics, a row for each row of `docs`."""
    rows = docs.select(
        doc_key().alias("doc"), text_tie().alias("tie"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").cast("binary").alias("text"))
    schema = "doc long, tie long, lang string, source string, " + ", ".join(f"{s} long" for s in STATS)
    return rows.mapInArrow(_measure, schema)


def _vector() -> list[Column]:
    """The transformed statistics as fixed-point numbers."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    parts = [
        F.log1p(F.col("n_words").cast("double")),
        F.log((chars + 5.0 * STEADY) / (words + STEADY)),  # few words say little about their mean length
        F.log1p(1000.0 * F.col("n_symbols") / chars),
        F.log1p(F.col("n_dup_lines").cast("double")),
        F.log1p(100.0 * F.col("n_repeat_words") / words),
    ]
    return [F.round(part * SCALE).cast("long").alias(f"x{i}") for i, part in enumerate(parts)]


def chi_square_share(x: float, k: int) -> float:
    """P(chi-square with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    term = total = 1 / a
    n = 1
    while term > total * 1e-15:
        term *= half / (a + n)
        total += term
        n += 1
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the central `share` of normal rows that of all of them."""
    low, high = 0.0, 200.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_share(middle, p) < share else (low, middle)
    return share / chi_square_share(high, p + 2)


def _shape(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Centre and inverse covariance from the sums of a group's support."""
    factor = consistency(SUPPORT, P)
    for frame in frames:
        centres, inverses = [], []
        for row in frame.itertuples():
            n = float(row.n)
            mean = np.array([getattr(row, f"s{i}") for i in range(P)]) / n
            cov = np.zeros((P, P))
            for i, j in PAIRS:  # exact integers up to here
                cov[i, j] = cov[j, i] = (int(getattr(row, f"s{i}_{j}")) * int(row.n)
                                         - int(getattr(row, f"s{i}")) * int(getattr(row, f"s{j}"))) / (n * n)
            cov = cov * factor / SCALE**2 + np.diag(np.square(FLOORS))
            centres.append(mean.tolist())
            inverses.append(np.linalg.inv(cov).ravel().tolist())
        yield pd.DataFrame({"grp": frame["grp"], "centre": centres, "inverse": inverses})


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile widths: exact, since a group has few distinct fixed-point values."""
    quartiles = rows.groupBy("grp").agg(*[
        F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q{i}") for i in range(P)])
    scale = [F.greatest((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / (1.349 * SCALE), F.lit(FLOORS[i])) for i in range(P)]
    zero = F.lit(0.0)
    return quartiles.select(
        "grp", F.array(*[F.col(f"q{i}")[1] for i in range(P)]).alias("centre"),
        F.array(*[1 / (scale[i] * scale[i]) if i == j else zero for i in range(P) for j in range(P)]).alias("inverse"))


def _distance() -> Column:
    off = [(F.col(f"x{i}") - F.col("centre")[i]) / SCALE for i in range(P)]
    return sum((off[i] * off[j] * F.col("inverse")[i * P + j] * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def _concentrate(rows: DataFrame, shapes: DataFrame, groups: int) -> DataFrame:
    """One concentration step: the estimate from the SUPPORT of rows nearest to the present one."""
    placed = rows.join(lookup(shapes, groups), "grp").withColumn(
        "bin", F.floor(BINS * F.log(_distance() + 1e-3)).cast("int"))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    sums += [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS]
    names = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}_{j}" for i, j in PAIRS]]
    bins = placed.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    upto = W.partitionBy("grp").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("grp")
    run = bins.select("grp", "bin", F.sum("n").over(whole).alias("all"), *[F.sum(c).over(upto).alias(c) for c in names])
    support = run.where(F.col("n") >= SUPPORT * F.col("all")).groupBy("grp").agg(
        F.min_by(F.struct(*names), "bin").alias("best")).select("grp", "best.*")
    return support.mapInPandas(_shape, "grp string, centre array<double>, inverse array<double>")


def judge(stats: DataFrame) -> DataFrame:
    """The rows of `stats` with base_failed, distance (null where not estimated) and kept."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("-"))
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    measured, seen = stored(stats.select(
        "doc", "tie", *STATS, failed.alias("base_failed"), lang.alias("g_lang"), source.alias("g_source"), *_vector()),
        "statistics")
    sizes = measured.where("not base_failed").groupBy("g_lang", "g_source").agg(F.count(F.lit(1)).alias("n"))
    own = F.concat_ws("\n", "g_lang", "g_source")
    small = F.sum(F.when(F.col("n") < MIN_GROUP, F.col("n")).otherwise(0)).over(W.partitionBy("g_lang"))
    names, count_ = stored(sizes.withColumn("pooled", small).select(
        "g_lang", "g_source",
        F.when(F.col("n") >= MIN_GROUP, own).when(F.col("pooled") >= MIN_GROUP, F.col("g_lang"))
        .otherwise(F.lit("all")).alias("grp")), "groups")
    groups = count_["rows"]
    rows = measured.join(lookup(names, groups), ["g_lang", "g_source"], "left")
    passing = rows.where("not base_failed").select("grp", *[f"x{i}" for i in range(P)])
    shapes, _ = stored(_start(passing), "shapes")
    for _ in range(STEPS):
        shapes, _ = stored(_concentrate(passing, shapes, groups), "shapes")
    enough = passing.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_GROUP).select("grp")
    shapes, _ = stored(shapes.join(enough, "grp", "left_semi"), "shapes")
    return rows.join(lookup(shapes, groups), "grp", "left").withColumn("distance", _distance()).withColumn(
        "kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUT, F.lit(True)))


def rate(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics, base_failed, kept and distance, a row for each row of `docs`."""
    prepare(docs.sparkSession)
    return judge(statistics(docs)).select(
        real_id("doc").alias("doc_id"), *STATS, "base_failed", "kept", F.round("distance", 6).alias("distance"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that the rules keep."""
    prepare(docs.sparkSession)
    verdicts = judge(statistics(docs)).where("not kept").select("doc", "tie").distinct()
    rejected, seen = stored(verdicts, "rejected")
    return split_by_keys(docs, rejected, seen["rows"], "left_anti")
