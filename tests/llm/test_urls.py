import random
import re

from pyspark.sql import functions as F

from emberfold.llm import urls as u

SCHEMA = "page_id long, url string, host string, verdict string, template string, n string"


def table(spark, pairs):
    return spark.createDataFrame([(k, url, None, None, None, None) for k, url in pairs], SCHEMA)


def slow_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def slow_rule(host, path):
    fits = [(len(r), r, v) for r, v in u.RULES
            if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def test_parts_and_rules(spark):
    random.seed(12)
    pieces = ["http", "://", "www.", "example", ".com", ".net", "/en/", "/es/", "/fr/", "?q=/x", "#f", "É", "A", "12", ".html", "//"]
    urls = ["".join(random.choice(pieces) for _ in range(random.randint(0, 7))) for _ in range(600)]
    urls += ["https://example.com/en/1", "https://a.example.com/en/1", "https://WWW.Example.com/en/1", "https://xexample.com/en/1",
             "http://com/", "http://a.net/es/", "http://a.net/es", "http://com", None, ""]
    got = {r.page_id: r for r in u.judge(table(spark, enumerate(urls))).collect()}
    for k, url in enumerate(urls):
        host, path = slow_parts(url)
        rule, verdict = slow_rule(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == verdict or verdict is None and got[k].verdict in ("allow", "block")


def test_templates_with_labels(spark):
    """Spam under /promo/, news under /news/, one page each; section names vary for both."""
    rows = [(k, f"https://site.org/promo/offer-{k}x/{k}.html") for k in range(100)]
    rows += [(1000 + k, f"https://site.org/news/{k}") for k in range(100)]
    rows += [(2000 + k, f"https://other.org/promo/offer-{k}x/{k}.html") for k in range(5)]
    label = F.when(F.col("page_id") % 2 == 0, F.col("url").contains("site.org/promo"))
    got = {r.page_id: r.verdict for r in u.judge(table(spark, rows), [], label).collect()}
    assert {got[k] for k in range(100)} == {"block"}
    assert {got[k] for k, _ in rows[100:]} == {"allow"}


def test_similar_siblings_are_merged_and_different_ones_are_not(spark):
    """Three small spam sections reject only together; a clean sibling stays apart."""
    rows = [(k, f"https://s.org/p{'abc'[k % 3]}/{k}") for k in range(60)] + [(100 + k, f"https://s.org/ok/{k}") for k in range(60)]
    got = {r.page_id: r.verdict for r in u.judge(table(spark, rows), [], F.col("page_id") < 100).collect()}
    assert {got[k] for k in range(60)} == {"block"} and {got[100 + k] for k in range(60)} == {"allow"}


def slow_wildcard(part):
    found = re.search(r"(\.[A-Za-z]{1,5})$", part)
    return "*" + (found[1] if found else "")


def slow_verdicts(rows):
    """Tree, merging and purity, one host and family at a time; rows are (host, path, bad or None)."""
    parts = [[slow_wildcard(p) if re.match(u.ITEM, p) else p for p in path.split("/") if p] for _, path, _ in rows]
    names = [""] * len(rows)
    for level in range(max(map(len, parts), default=0)):
        groups = {}
        for k, found in enumerate(parts):
            if len(found) > level:
                groups.setdefault((rows[k][0], names[k]), []).append(k)
        for members in groups.values():
            count = {}
            for k in members:
                count[parts[k][level]] = count.get(parts[k][level], 0) + 1
            for k in members:
                part = parts[k][level]
                literal = count[part] >= u.LITERAL_URLS and count[part] >= u.LITERAL_SHARE * len(members)
                names[k] += "/" + (part if literal else slow_wildcard(part))
    known = [bad for _, _, bad in rows if bad is not None]
    prior = sum(known) / len(known) if known else 0.0
    templates = {}
    for (host, _, bad), name in zip(rows, names):
        labels = templates.setdefault((host, name), [])
        if bad is not None:
            labels.append(bad)
    patterns = {key: [p for p in key[1].split("/") if p] for key in templates}
    for level in range(max(map(len, patterns.values())) - 1, -1, -1):
        families = {}
        for key, pattern in patterns.items():
            if len(pattern) > level:
                family = families.setdefault((key[0], *pattern[:level], None, *pattern[level + 1:]), {})
                family.setdefault(pattern[level], []).append(key)
        for family in families.values():
            pooled = {name: [bad for key in keys for bad in templates[key]] for name, keys in family.items()}
            branches = []
            for rate, name in sorted((sum(t) / len(t), name) for name, t in pooled.items() if t):
                t = pooled[name]
                if branches:
                    last = branches[-1]
                    share = (last[1] + sum(t)) / (last[0] + len(t))
                    error = (share * (1 - share) * (1 / last[0] + 1 / len(t))) ** 0.5
                    if abs(rate - last[1] / last[0]) <= u.Z * error:
                        last[0], last[1] = last[0] + len(t), last[1] + sum(t)
                        last[2].append(name)
                        continue
                branches.append([len(t), sum(t), [name]])
            unknown = [name for name, t in pooled.items() if not t]
            for _, _, inside in branches:
                for name in inside + (unknown if len(branches) == 1 else []):
                    for key in family[name]:
                        patterns[key] = patterns[key][:level] + [min(inside)] + patterns[key][level + 1:]
    groups = {}
    for key, pattern in patterns.items():
        groups.setdefault((key[0], *pattern), []).append(key)
    rejected = set()
    for members in groups.values():
        t = [bad for key in members for bad in templates[key]]
        if len(t) >= u.EVIDENCE and (sum(t) + u.STRENGTH * prior) / (len(t) + u.STRENGTH) >= u.PURITY:
            rejected |= set(members)
    return ["block" if (host, name) in rejected else "allow" for (host, _, _), name in zip(rows, names)]


def labelled(spark, rows):
    """Verdicts for (host, path, bad or None) without rules."""
    urls = [(k, f"https://{host}/{path}") for k, (host, path, _) in enumerate(rows)]
    marks = {k: bad for k, (_, _, bad) in enumerate(rows)}
    known = [k for k, bad in marks.items() if bad is not None]
    bad = [k for k, b in marks.items() if b]
    label = F.when(F.col("page_id").isin(known), F.col("page_id").isin(bad))
    return [r.verdict for r in u.judge(table(spark, urls), [], label).orderBy("page_id").collect()]


def test_equals_the_slow_version(spark):
    random.seed(8)
    rows = []
    for host in ("a.org", "b.org", "c.org"):
        odds = {}
        for _ in range(400):
            depth = random.randint(0, 11)
            path = "/".join(random.choice(["x", "y", "z", "p.html", "q.html", str(random.randint(0, 99)), f"n{random.randint(0, 200)}.php"])
                            if level > 1 else f"s{random.randint(0, 4)}" for level in range(depth))
            odds.setdefault(path[:5], random.choice([0, 0.05, 0.9, 1, 1]))
            rows.append((host, path, random.random() < odds[path[:5]] if random.random() < 0.4 else None))
    want = slow_verdicts(rows)
    assert labelled(spark, rows) == want
    assert 20 < want.count("block") < len(want) - 20


def test_thin_siblings_are_judged_together(spark):
    rows = [("t.org", f"sec{'abcdefghij'[s % 10]}{'xyz'[s // 10]}/{k}", True if k < 4 else None) for s in range(30) for k in range(10)]
    rows += [("o.org", "ok", False)] * 3
    assert set(labelled(spark, rows)[:300]) == {"block"}


def test_unlabelled_siblings_join_a_uniform_family_only(spark):
    rows = [("t.org", f"p{s}x/{k}", True if s != "c" else None) for s in "abc" for k in range(20)]
    rows += [("m.org", f"p{s}x/{k}", {"a": True, "b": False}.get(s)) for s in "abc" for k in range(40)]
    got = labelled(spark, rows)
    assert set(got[:60]) == {"block"} and set(got[140:]) == {"allow"}


def test_paths_that_differ_deep_down(spark):
    rows = [("d.org", "a/b/c/d/e/f/g/" + ("good" if k % 2 else "bad") + f"/h/i/{k}", k % 2 == 0) for k in range(40)]
    assert labelled(spark, rows) == ["block" if k % 2 == 0 else "allow" for k in range(40)]


def test_odd_rows(spark):
    deep = "https://d.org/" + "/".join(f"s{k}" for k in range(40))
    rows = [(1, None), (1, None), (None, "https://a.com/x"), (2, "://"), (3, deep), (3, deep), (4, "https://l.org/" + "a" * 200_000)]
    got = u.judge(table(spark, rows)).collect()
    assert len(got) == 7 and {r.host for r in got if r.page_id == 1} == {""}
    assert [r.verdict for r in got if r.page_id is None] == ["allow"]
    assert u.judge(table(spark, [])).count() == 0
