"""Mixing sources to target weights: a min-cost flow from membership patterns to source quotas.

Documents that belong to the same set of sources form a pattern. A pattern's words may be used up
to `repeats` times; the k-th use costs more than the one before (convex cost), so the cheapest flow
uses fresh words before repeated ones anywhere in the mix. The flow routes the capacity of patterns
to the quotas of their sources; the words it draws from a pattern are then taken as whole uses of
every document plus one seeded selection of documents for the rest.

Only the network (one row per pattern or source, `MAX_NODES` at most, or an error) is solved on the
driver: a mix names its sources, so its size is that of the recipe. Documents stay in Spark: the
selection cumulates sizes over bins of a seeded hash first, and over the documents of the one bin in
which the needed amount ends, so no source is sorted in one task.

Defined cases: a null source sorts last and is a source like any other; a null or empty text has size
0 and nothing is taken from it; repeated rows count as often as they occur; documents without any
source are never taken. Equal hashes are ordered by id, then text. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberfold.llm.common import NULL_ID, doc_key, lookup, prepare, real_id, split_by_keys, stored, text_tie

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 20240229
BIN_BITS = 12
MAX_NODES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Shares of `total` by weight; none exceeds `most` times its size, the excess is shared anew.

    Sources that stop are those with the least room per unit of weight, so one pass in that order
    settles all of them.
    """
    left, weight = float(total), float(sum(weights))
    out = [0.0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: (most * sizes[k] / weights[k], k)):
        out[k] = float(min(most * sizes[k], left * weights[k] / weight)) if weight > 0 else 0.0
        left -= out[k]
        weight -= weights[k]
    return out


class Network:
    """Maximum flow by shortest augmenting layers; arcs can be opened between runs."""

    def __init__(self) -> None:
        self.arcs: dict[object, list[int]] = defaultdict(list)
        self.to: list[object] = []
        self.room: list[int] = []

    def arc(self, a: object, b: object, room: int) -> int:
        for head, tail, amount in ((b, a, room), (a, b, 0)):
            self.arcs[tail].append(len(self.to))
            self.to.append(head)
            self.room.append(amount)
        return len(self.to) - 2

    def saturate(self, start: object, end: object) -> None:
        while True:
            level, queue = {start: 0}, deque([start])
            while queue:
                node = queue.popleft()
                for k in self.arcs[node]:
                    if self.room[k] and self.to[k] not in level:
                        level[self.to[k]] = level[node] + 1
                        queue.append(self.to[k])
            if end not in level:
                return
            following = {node: 0 for node in level}
            while self._push(start, end, level, following):
                pass

    def _push(self, start: object, end: object, level: dict, following: dict) -> bool:
        path, node = [], start
        while node != end:
            arcs = self.arcs[node]
            while following[node] < len(arcs):
                k = arcs[following[node]]
                if self.room[k] and level.get(self.to[k]) == level[node] + 1:
                    break
                following[node] += 1
            if following[node] == len(arcs):
                if not path:
                    return False
                node = self.to[path.pop() ^ 1]
                following[node] += 1
                continue
            path.append(arcs[following[node]])
            node = self.to[path[-1]]
        amount = min(self.room[k] for k in path)
        for k in path:
            self.room[k] -= amount
            self.room[k ^ 1] += amount
        return True


def route(capacity: dict[tuple, int], quota: dict[object, int], repeats: int) -> dict[tuple, int]:
    """Words drawn from each pattern by the cheapest flow that fills the quotas as far as possible.

    The cost of a path is that of the use it opens at its pattern, so opening uses in the order of
    their cost and saturating the network after each gives the minimum cost.
    """
    network = Network()
    uses = defaultdict(list)
    for pattern, words in capacity.items():
        for source in pattern:
            network.arc(("pattern", pattern), ("source", source), words * repeats)
    for source, words in quota.items():
        network.arc(("source", source), "end", words)
    for _ in range(repeats):
        for pattern, words in capacity.items():
            uses[pattern].append(network.arc("start", ("pattern", pattern), words))
        network.saturate("start", "end")
    return {p: sum(network.room[k ^ 1] for k in arcs) for p, arcs in uses.items()}


def _bounded(df: DataFrame, what: str) -> list:
    rows = df.limit(MAX_NODES + 1).collect()
    if len(rows) > MAX_NODES:
        raise ValueError(f"a mix may name {MAX_NODES} {what} at most")
    return rows


def select(sized: DataFrame, repeats: int = REPEATS, quotas: dict | None = None, *, seed: int = SEED,
           weights: tuple = WEIGHTS, share: float = SHARE) -> tuple[DataFrame, dict]:
    """(doc, tie, pattern, size, taken) of every row, and the target of each source.

    `sized` holds doc, tie, size and pattern, the array of sources of the row. Without `quotas`,
    sources by code point, null last, take `weights` in turn and share `share` of all words.
    """
    kept, _ = stored(sized.select(
        "doc", "tie", "size", F.array_sort(F.array_distinct("pattern")).alias("pattern")), "sizes")
    patterns = _bounded(kept.groupBy("pattern").agg(F.sum("size").alias("words")), "patterns")
    capacity = {tuple(r.pattern): int(r.words) for r in patterns}
    volume = defaultdict(int)
    for pattern, words in capacity.items():
        for source in pattern:
            volume[source] += words
    if quotas is None:
        names = sorted(volume, key=lambda s: (s is None, s or ""))
        own = [weights[k % len(weights)] for k in range(len(names))]
        shares = targets([volume[s] for s in names], own, share * sum(capacity.values()), repeats)
        quotas = dict(zip(names, shares))
    drawn = route(capacity, {s: round(q) for s, q in quotas.items()}, repeats)
    spark = sized.sparkSession
    plan = spark.createDataFrame(
        [(list(p), drawn[p] // words if words else 0, drawn[p] % words if words else 0)
         for p, words in capacity.items()], "pattern array<string>, whole long, part long")
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc").cast("string"))).alias("rank")
    rows = kept.withColumn("rank", rank).withColumn(
        "bin", F.conv(F.substring("rank", 1, BIN_BITS // 4), 16, 10).cast("int"))
    before = W.partitionBy("pattern").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    bins = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("words")).withColumn(
        "before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    bins = bins.join(F.broadcast(plan), "pattern")
    bins, seen = stored(bins, "bins")  # at most 2^BIN_BITS rows a pattern
    placed = rows.join(lookup(bins, seen["rows"]), ["pattern", "bin"])
    ends = (F.col("before") < F.col("part")) & (F.col("before") + F.col("words") > F.col("part"))
    clear = placed.where(~ends).withColumn("more", (F.col("before") < F.col("part")).cast("long"))
    within = W.partitionBy("pattern", "bin").orderBy("rank", "doc", "tie").rowsBetween(W.unboundedPreceding, -1)
    # A document is taken if more than half of it lies before the end of the needed amount.
    last = placed.where(ends).withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    last = last.withColumn("more", (2 * F.col("at") + F.col("size") <= 2 * F.col("part")).cast("long"))
    columns = ["doc", "tie", "pattern", "size", (F.col("size") * (F.col("whole") + F.col("more"))).alias("taken"),
               (F.col("whole") + F.col("more")).alias("uses")]
    return clear.select(*columns).unionByName(last.select(*columns)), quotas


def sized_documents(docs: DataFrame) -> DataFrame:
    """Documents of one source each, with their number of words."""
    prepare(docs.sparkSession)
    return docs.select(doc_key().alias("doc"), text_tie().alias("tie"), word_count(F.col("text")).alias("size"),
                       F.array(F.col("source").cast("string")).alias("pattern"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, a row for each row of `docs`."""
    chosen, quotas = select(sized_documents(docs))
    spark = docs.sparkSession
    wanted = spark.createDataFrame(list(quotas.items()), "source string, target double")
    rows = chosen.withColumn("source", F.col("pattern")[0])
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    facts, seen = stored(sizes.join(F.broadcast(wanted), sizes["source"].eqNullSafe(wanted["source"])).select(
        sizes["source"].alias("s"), "source_size", F.round("target", 6).alias("target")), "sources")
    return rows.join(lookup(facts, seen["rows"]), F.col("source").eqNullSafe(F.col("s"))).select(
        real_id("doc").alias("doc_id"), "size", "source_size", "target", "taken")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
sources AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
weighed AS (SELECT *, CASE place % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS w FROM sources),
levels AS (
  SELECT *, 2 * source_size / w AS room,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY 2 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_left,
    1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_left
  FROM weighed),
-- up to the first source that stays below its bound, all before it have stopped
split AS (SELECT *, max(CASE WHEN room > words_left / w_left THEN 1 ELSE 0 END) OVER
  (ORDER BY room, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free FROM levels),
level AS (SELECT max_by(words_left / w_left, w_left) AS unit FROM split WHERE free = 1),
wanted AS (
  SELECT source, source_size, CASE WHEN free = 1 THEN w * unit ELSE 2 * source_size END AS target FROM split, level),
ordered AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    least(round(target), 2 * source_size)::BIGINT // greatest(source_size, 1)::BIGINT AS whole,
    least(round(target), 2 * source_size)::BIGINT % greatest(source_size, 1)::BIGINT AS part,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY
      md5('20240229:' || coalesce(s.doc_id, 9223372036854775807)), s.doc_id NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN wanted t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, round(target, 6) AS target,
  (size * (whole + CASE WHEN part > before AND 2 * before + size <= 2 * part THEN 1 ELSE 0 END))::BIGINT AS taken
FROM ordered
"""
