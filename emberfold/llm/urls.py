"""URL filter by a path-template tree, with DataFrame functions only.

Rules decide first. Per host, paths form a tree of segments. Numbers and the like are wildcards from
the start; level by level, a segment stays literal if it holds a fair share of its parent's urls, and
becomes a wildcard (with its file extension) otherwise. From the deepest level up, sibling branches (those
that differ in the segment of this level alone) are merged, in the order of their share of blocked
urls, while a sibling's share does not differ from that of the branch so far by a two-proportion
test; siblings without a label join where all others are one branch. Only then is the evidence judged: a branch of enough labelled urls is rejected if the smoothed share of blocked ones
reaches `PURITY`, and its urls without a rule are blocked. Labels are what the rules say, or a column that
the caller gives.

The tree is as deep as the paths. Levels that no `LITERAL_URLS` urls of one template reach can hold
wildcards only and are done in one step.

All statistics come from (host, template) aggregates, which Spark sums map-side, so a host with a
third of all urls gives few rows; only rejected templates are joined back to the urls.

Defined cases: a null url or one without `://` has an empty host and path, which no rule fits; a path
without segments has the template ``; repeated urls count as often as they occur; of several rules that fit, the longest decides, of equally long ones the first
by name. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import lookup, prepare, stored

PART_BYTES = 16  # that an array of texts adds to each of them
LITERAL_URLS, LITERAL_SHARE = 10, 0.02
Z = 1.96
EVIDENCE = 5
STRENGTH = 5.0
PURITY = 0.9

RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block")]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A segment that names one item: a number, a date, or a long hexadecimal name, with an extension.
ITEM = r"^(\d[\d_.-]*\d|\d|[0-9a-fA-F-]{16,})(\.[A-Za-z]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null where none does."""
    rule, verdict = F, F
    for name, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        site, slash, start = name.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith(slash + start)
        rule, verdict = rule.when(fits, F.lit(name)), verdict.when(fits, F.lit(says))
    return (rule, verdict) if rules else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def wildcard(segment: Column) -> Column:
    return F.concat(F.lit("*"), F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1))


def segments(path: Column) -> Column:
    """Segments of a path with items as wildcards."""
    found = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(found, lambda s: F.when(s.rlike(ITEM), wildcard(s)).otherwise(s))


def _bytes(*texts: Column | str) -> Column:
    return F.sum(sum((F.octet_length(t) for t in texts), F.lit(0)).cast("long")).alias("bytes")


def template_tree(urls: DataFrame) -> DataFrame:
    """(host, parts, template, n, labelled, blocked): the template of each kind of path."""
    tree, seen = stored(urls.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("bad").alias("labelled"),
        F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("blocked"),
    ).withColumn("template", F.lit("")), "paths", F.max(F.size("parts")).alias("depth"))
    for level in range(seen["depth"] or 0):
        part = F.col("parts")[level]
        reached = tree.where(F.size("parts") > level).select("host", "template", part.alias("part"), "n")
        most = reached.groupBy("host", "template").agg(F.sum("n").alias("all")).agg(F.max("all")).first()[0]
        if most < LITERAL_URLS:
            rest = F.slice("parts", level + 1, F.greatest(F.size("parts") - level, F.lit(0)))
            return tree.withColumn("template", F.concat("template", F.array_join(
                F.transform(rest, lambda s: F.concat(F.lit("/"), wildcard(s))), "")))
        values = reached.groupBy("host", "template", "part").agg(F.sum("n").alias("own"))
        totals = values.groupBy("host", "template").agg(F.sum("own").alias("all"))
        literals = values.where(F.col("own") >= LITERAL_URLS).join(totals, ["host", "template"]).where(
            F.col("own") >= LITERAL_SHARE * F.col("all")).select("host", "template", "part")
        literals, kept = stored(literals.withColumn("literal", F.lit(True)), "literals", _bytes("host", "template", "part"))
        placed = tree.withColumn("part", F.get("parts", F.lit(level))).join(
            lookup(literals, kept["rows"], kept["bytes"]), ["host", "template", "part"], "left")
        step = F.when(F.col("literal"), F.col("part")).otherwise(wildcard(F.col("part")))
        tree, _ = stored(placed.withColumn("template", F.when(
            F.col("part").isNotNull(), F.concat("template", F.lit("/"), step)).otherwise(F.col("template"))).drop(
                "part", "literal"), "paths")
    return tree


def _alike(a: str, b: str) -> str:
    """SQL for: the shares of blocked urls of two groups do not differ by a two-proportion test."""
    pooled = f"(({a}.blocked + {b}.blocked) / ({a}.labelled + {b}.labelled))"
    apart = f"abs({b}.blocked / {b}.labelled - {a}.blocked / {a}.labelled)"
    return f"{apart} <= {Z} * sqrt({pooled} * (1 - {pooled}) * (1 / {a}.labelled + 1 / {b}.labelled))"


def merged(leaves: DataFrame, level: int) -> DataFrame:
    """`leaves` with the segments of one level of their `pattern` replaced by the name of their branch.

    Siblings are patterns of a host that differ in this segment alone.
    """
    family = F.concat(F.slice("pattern", 1, level), F.array(F.lit("")), F.slice("pattern", level + 2, F.size("pattern")))
    here = leaves.where(F.size("pattern") > level).select(
        "host", family.alias("family"), F.col("pattern")[level].alias("name"), "labelled", "blocked")
    nodes = here.groupBy("host", "family", "name").agg(*[F.sum(c).alias(c) for c in ("labelled", "blocked")])
    sibling = F.struct((F.col("blocked") / F.col("labelled")).alias("rate"), "name", "labelled", "blocked")
    # Siblings are few: literals hold a fair share each, all others are wildcards with a file extension.
    families = nodes.groupBy("host", "family").agg(
        F.array_sort(F.collect_list(F.when(F.col("labelled") > 0, sibling))).alias("known"),
        F.collect_list(F.when(F.col("labelled") == 0, F.col("name"))).alias("unknown"))
    branches = families.select("host", "family", "unknown", F.expr(f"""
        aggregate(known, CAST(array() AS array<struct<labelled: bigint, blocked: bigint, names: array<string>>>),
          (made, s) -> CASE WHEN size(made) > 0 AND {_alike("element_at(made, -1)", "s")}
            THEN concat(slice(made, 1, size(made) - 1), array(named_struct(
              'labelled', element_at(made, -1).labelled + s.labelled, 'blocked', element_at(made, -1).blocked + s.blocked,
              'names', concat(element_at(made, -1).names, array(s.name)))))
            ELSE concat(made, array(named_struct(
              'labelled', s.labelled, 'blocked', s.blocked, 'names', array(s.name)))) END)""").alias("branches"))
    branches = branches.select("host", "family", "unknown", F.size("branches").alias("count"), F.explode("branches").alias("branch"))
    names = F.when(F.col("count") == 1, F.concat("branch.names", "unknown")).otherwise(F.col("branch.names"))
    renamed, seen = stored(branches.select(
        "host", "family", F.array_min("branch.names").alias("branch"), F.explode(names).alias("name")).where("name <> branch"),
        "branches", _bytes("host", "name", "branch", F.array_join("family", "/" * PART_BYTES)))
    placed = leaves.withColumns({"family": F.when(F.size("pattern") > level, family), "name": F.get("pattern", F.lit(level))}).join(
        lookup(renamed, seen["rows"], seen["bytes"]), ["host", "family", "name"], "left")
    pattern = F.when(F.col("branch").isNull(), F.col("pattern")).otherwise(F.concat(
        F.slice("pattern", 1, level), F.array("branch"), F.slice("pattern", level + 2, F.size("pattern"))))
    return placed.withColumn("pattern", pattern).drop("family", "name", "branch")


def rejected(tree: DataFrame) -> DataFrame:
    """(host, parts) of rejected templates: branches are merged from the deepest level up, then judged."""
    sums = [F.sum(c).alias(c) for c in ("labelled", "blocked")]
    leaves, seen = stored(tree.groupBy("host", "template").agg(*sums).withColumn(
        "pattern", F.filter(F.split("template", "/"), lambda s: s != "")), "leaves",
        F.sum("labelled").alias("l"), F.sum("blocked").alias("b"), F.max(F.size("pattern")).alias("depth"))
    prior = (seen["b"] or 0) / seen["l"] if seen["l"] else 0.0
    for level in range((seen["depth"] or 0) - 1, -1, -1):
        leaves, _ = stored(merged(leaves, level), "merged")
    purity = (F.col("blocked") + STRENGTH * prior) / (F.col("labelled") + STRENGTH)
    bad = leaves.groupBy("host", "pattern").agg(*sums).where((F.col("labelled") >= EVIDENCE) & (purity >= PURITY))
    bad = leaves.join(bad.select("host", "pattern"), ["host", "pattern"], "left_semi").select("host", "template")
    return tree.join(bad, ["host", "template"], "left_semi").select("host", "parts")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, label: Column | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict of each row; `label` (true: bad) replaces the rules' labels."""
    prepare(pages.sparkSession)
    host, path = host_and_path(F.col("url").cast("string"))
    given = label if label is not None else F.lit(None).cast("boolean")
    split = pages.select("page_id", host.alias("host"), path.alias("path"), given.alias("given"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = split.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("says"),
                        segments(F.col("path")).alias("parts"), "given")
    known = F.col("given") if label is not None else F.col("says") == "block"
    bad, seen = stored(rejected(template_tree(rows.withColumn("bad", known))).withColumn("bad", F.lit(True)), "templates",
                       _bytes("host", F.array_join("parts", "/" * PART_BYTES)))
    # Only rejected templates are joined back.
    return rows.join(lookup(bad, seen["rows"], seen["bytes"]), ["host", "parts"], "left").select(
        "page_id", "host", "path", "rule",
        F.coalesce("says", F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
