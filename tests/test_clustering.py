import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF, seen
from emberfold import settings
from emberfold.operators import components, hull, incidents as I, joins, links
from emberfold.operators.components import connected_components
from emberfold.operators.normalize import coerce_for_clustering
from emberfold.plans import catalog, derive


def km(a, b):
    la, lo, lb, ob = map(math.radians, (a[0], a[1], b[0], b[1]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - lo) / 2) ** 2
    return 2 * settings.EARTH_RADIUS_KM * math.asin(min(1.0, math.sqrt(h)))


def brute_components(points, radius=2.0, window=86400):
    parent = list(range(len(points)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, a in enumerate(points):
        for j in range(i):
            b = points[j]
            if abs(a[2] - b[2]) <= window and km(a, b) <= radius:
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(points)):
        groups.setdefault(root(i), set()).add(i)
    return {frozenset(g) for g in groups.values()}


def spark_components(spark, points, radius=2.0, hours=24):
    rows = [(i, *p) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "i int, latitude double, longitude double, t long").withColumn(
        "observed_at", F.timestamp_seconds("t"))
    labelled = links.find_clusters(df, radius, hours).label(df)
    groups = {}
    for row in labelled.select("i", "component", "cluster_size").collect():
        groups.setdefault(row.component, set()).add(row.i)
        groups.setdefault(("size", row.component), row.cluster_size)
    for key in [k for k in groups if not isinstance(k, tuple)]:
        assert groups[("size", key)] == len(groups[key])
    return {frozenset(g) for k, g in groups.items() if not isinstance(k, tuple)}


def scattered(seed, centre, spread_deg, n, days=4):
    rng = random.Random(seed)
    lat, lon = centre
    wide = spread_deg / max(math.cos(math.radians(lat)), 0.02)
    points = []
    for _ in range(n):
        a = max(-90.0, min(90.0, lat + rng.uniform(-spread_deg, spread_deg)))
        b = (lon + rng.uniform(-wide, wide) + 180) % 360 - 180
        points.append((round(a, 5), round(b, 5), 1_700_000_000 + rng.randrange(0, days * 86400, 60)))
    return points


@pytest.mark.parametrize("seed,centre,spread,n", [
    (1, (42.0, -8.6), 0.15, 300),     # a mixture of groups and singletons
    (2, (42.0, -8.6), 0.03, 250),     # crowded: many undecided boxes
    (3, (0.0, 180.0), 0.1, 200),      # antimeridian and equator
    (4, (89.98, 10.0), 0.05, 150),    # pole
    (5, (-60.0, -179.99), 0.08, 200),
])
def test_components_equal_brute_force(spark, seed, centre, spread, n):
    points = scattered(seed, centre, spread, n)
    assert spark_components(spark, points) == brute_components(points)


def test_two_crowds_a_radius_apart_need_refining(spark):
    """Two dense spots whose nearest members are just inside or just outside the radius."""
    rng = random.Random(9)
    for gap_km, expected in ((1.9995, 1), (2.0005, 2)):
        step = math.degrees(gap_km / settings.EARTH_RADIUS_KM)
        west = [(42.0 + rng.uniform(-1, 1) * 1e-3 - 1e-3, -8.6 + rng.uniform(-1, 1) * 2e-3, 1_700_000_000 + 60 * i)
                for i in range(60)] + [(42.0, -8.6, 1_700_000_000)]
        east = [(42.0 + step + rng.uniform(0, 1) * 1e-3 + 1e-6, -8.6 + rng.uniform(-1, 1) * 2e-3, 1_700_000_000 + 60 * i)
                for i in range(60)] + [(42.0 + step, -8.6, 1_700_000_000)]
        points = west + east
        want = brute_components(points)
        assert spark_components(spark, points) == want
        if gap_km < 2:
            assert len(want) == expected


def test_window_end_is_inclusive(spark):
    base = 1_700_000_000
    assert len(spark_components(spark, [(42.0, -8.6, base), (42.0, -8.6, base + 86400)])) == 1
    assert len(spark_components(spark, [(42.0, -8.6, base), (42.0, -8.6, base + 86460)])) == 2


def test_hot_key_paths_give_the_same_components(spark, monkeypatch):
    points = scattered(11, (42.0, -8.6), 0.1, 150) + [(42.0, -8.6, 1_700_000_000)] * 120
    want = brute_components(points)
    monkeypatch.setattr(settings, "HOT_MIN_ROWS", 10)
    monkeypatch.setattr(settings, "HOT_SHARE", 20)
    assert spark_components(spark, points) == want


def test_hot_key_join(spark, monkeypatch):
    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)], "k long, v long")
    lookup = spark.range(0, 300, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w"))
    plain = {h: sorted(map(tuple, rows.join(lookup, "k", h).collect()), key=str) for h in ("inner", "left", "left_semi")}
    monkeypatch.setattr(settings, "HOT_MIN_ROWS", 10)
    monkeypatch.setattr(settings, "HOT_SHARE", 10)
    for how, want in plain.items():
        got = joins.join_lookup(rows, lookup, "k", 300, how)
        assert sorted(map(tuple, got.collect()), key=str) == want
        counted = lookup.join(rows.groupBy("k").count(), "k", "left")
        got = joins.join_lookup(rows, counted, "k", 300, how, count="count")
        assert sorted(map(tuple, got.collect()), key=str) == want


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = dict((r.node, r.component) for r in connected_components(df).collect())
    assert {got[i] for i in range(201)} == {0}
    assert {got[1000 + i] for i in range(300)} == {1000}
    assert got[5001] == got[5000] == 5000


def described(raw, *rows):
    members, clusters = I.assign_clusters(raw(*rows))
    return members, I.describe(members, clusters.largest)


def records(raw, *rows):
    return I.ranked(described(raw, *rows)[1]).collect()


def counts_by_case(raw, cases):
    """Detection counts of the records of each case; cases lie 60 km apart, so they cannot meet."""
    rows = [seen(minutes, north=north + 60_000 * k) for k, case in enumerate(cases) for minutes, north in case]
    found = {}
    for r in described(raw, *rows)[1].collect():
        found.setdefault(round((r.center.latitude - 38.75) * 111_195 / 60_000), []).append(r.detection_count)
    return [sorted(found[k]) for k in range(len(cases))]


def test_both_limits_must_hold_and_chains_reach_beyond_them(raw):
    apart = {(1990, 0): [2], (2010, 0): [1, 1], (0, 1440): [2], (0, 1441): [1, 1], (1990, 1440): [2], (1500, -1441): [1, 1]}
    cases = [[(0, 0), (minutes, metres)] for metres, minutes in apart]
    chain = [(700 * k, 1900 * k) for k in range(6)]
    assert counts_by_case(raw, cases + [chain, chain[:2] + chain[3:]]) == [*apart.values(), [6], [2, 3]]


def test_values_of_one_record(raw):
    rows = [seen(30, frp=30, level="l"), seen(10, north=400, frp=None, level="l"), seen(20, north=800, frp=12.5, level="h")]
    members, table = described(raw, *rows)
    record = table.first()
    assert (record.total_frp_mw, record.maximum_frp_mw, record.confidence, record.severity) == (42.5, 30.0, "low", "moderate")
    listed = I.member_list(members, table, 3).orderBy("place").collect()
    assert [(r.place, r.acq_time, r.frp, r.confidence) for r in listed] == [
        (1, "0010", None, "l"), (2, "0020", 12.5, "h"), (3, "0030", 30.0, "l")]


def test_identity_is_a_digest_of_the_members(raw):
    import hashlib
    rows = [seen(0), seen(15, east=700), seen(15, east=700)]
    texts = [f"{float(r[0]):.5f},{float(r[1]):.5f},{r[3]}T{r[4][:2]}:{r[4][2:]}:00+00:00,{r[5]}" for r in rows]
    sums = [sum(int(hashlib.sha256(t.encode()).hexdigest()[12 * k : 12 * k + 12], 16) for t in texts) for k in range(4)]
    want = hashlib.sha256("|".join(map(str, [3, *sums])).encode()).hexdigest()[:10]
    assert {records(raw, *order)[0].id for order in (rows, rows[::-1])} == {f"incident-{want}"}


def test_trend_compares_the_halves(raw):
    cases = [([4, 4, 8, 8], "increasing"), ([8, 8, 4, 4], "decreasing"), ([4, 4, 4.7, 4.7], "stable"),
             ([0, 0, 0, 2], "increasing"), ([None, 7, 3, 3], "decreasing"), ([None, None, None], "stable"),
             ([3, 9], "stable"), ([0.1, 0.12, 0.12], "stable"), ([None], "stable")]
    rows = [seen(40 * j, north=60_000 * k, frp=p) for k, (powers, _) in enumerate(cases) for j, p in enumerate(powers)]
    # At one time, nothing has a trend.
    rows += [seen(0, north=60_000 * k, east=100_000 + 20 * j, frp=p) for k, (powers, _) in enumerate(cases) for j, p in enumerate(powers)]
    found = {(round((r.center.latitude - 38.75) * 111_195 / 60_000), r.center.longitude > -6.7): r for r in described(raw, *rows)[1].collect()}
    for k, (powers, trend) in enumerate(cases):
        assert (found[k, False].trend, found[k, True].trend) == (trend, "stable"), powers
    single = found[8, False]
    assert (single.total_frp_mw, single.severity, len(single.boundary)) == (0, "low", 12)


def sample(spark):
    return derive.detections(derive.table(spark, SF, "events"))


def test_values_do_not_depend_on_the_size_that_counts_as_large(spark, monkeypatch):
    """The way to an envelope may change with the size; no value may."""
    events = sample(spark)
    # Equal times and repeated rows inside one cluster exercise the order of members.
    crowd = events.where("event_id < 40").withColumns({
        "latitude": 42 + F.col("event_id") % 7 / 1000, "longitude": F.lit(-8.6) + F.col("event_id") % 5 / 1000,
        "acq_date": F.lit("2024-01-05"), "acq_time": F.lit(1200) + F.col("event_id") % 3})
    members, clusters = I.assign_clusters(events.unionByName(crowd).unionByName(crowd.where("event_id % 4 = 0")))
    usual = {r.component: r for r in I.describe(members, clusters.largest).collect()}
    monkeypatch.setattr(hull, "PART_POSITIONS", 4)
    assert {r.component: r for r in I.describe(members, clusters.largest).collect()} == usual
    places = members.groupBy("component").agg(F.sort_array(F.collect_list("place")).alias("p")).collect()
    assert all(r.p == list(range(1, len(r.p) + 1)) for r in places)


def test_hull_with_more_vertices_than_a_part_ends(spark):
    ring = [(1, math.cos(k / 20 * math.tau), math.sin(k / 20 * math.tau)) for k in range(20)]
    members = spark.createDataFrame(ring, "component long, longitude double, latitude double")
    whole, parts = (hull.envelopes_of_large(members, part=n).first().boundary for n in (4000, 12))
    assert whole == parts and len(whole) >= 20


def test_hull_of_parts_equals_whole_hull(spark):
    members = sample(spark).withColumn("component", (F.col("event_id") % 3).cast("long"))
    whole = {r.component: r.boundary for r in hull.envelopes_of_large(members).collect()}
    parts = {r.component: r.boundary for r in hull.envelopes_of_large(members, part=40).collect()}
    assert whole == parts and all(len(b) >= 3 for b in whole.values())


def test_results_do_not_depend_on_row_order_or_partitioning(spark):
    data = sample(spark)
    first = sorted(map(str, I.incidents(data).collect()))
    again = sorted(map(str, I.incidents(data.orderBy(F.xxhash64("event_id")).repartition(7)).collect()))
    assert first == again


def test_ranking_and_contract(spark):
    members, clusters = I.assign_clusters(sample(spark))
    table = I.describe(members, clusters.largest)
    ordered = [r.id for r in I.ranked(table).collect()]
    assert [r.id for r in I.with_rank(table).orderBy("rank").collect()] == ordered
    assert I.contract_violations(table, members).count() == 0
    bad = table.withColumn("trend", F.lit("sideways")).limit(3)
    assert {r.violation for r in I.contract_violations(bad, members).collect()} == {"trend_unknown_label"}
    short = members.where("place > 1")
    found = {r.violation for r in I.contract_violations(table, short).collect()}
    assert found == {"no_detections", "count_differs"}


def test_no_pairwise_join_in_the_plan(spark):
    grid = links.SpaceTimeGrid()
    slots = links.add_runs(links.build_slots(coerce_for_clustering(sample(spark)), grid), grid)
    plan = links.slot_pairs(slots, grid)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_rounds_run_only_where_stars_share_a_node(spark, monkeypatch):
    rounds = []
    whole = components._round
    monkeypatch.setattr(components, "_round", lambda edges, size: rounds.append(size) or whole(edges, size))
    paths = [(10 * p + k, 10 * p + k + 1) for p in range(50) for k in range(4)]
    found = connected_components(spark.createDataFrame(paths, "src long, dst long").repartition(1))
    assert {(r.node, r.component) for r in found.collect()} == {(10 * p + k, 10 * p) for p in range(50) for k in range(5)}
    assert rounds == []
    # In chunks that meet, only the centres of their stars go on.
    monkeypatch.setattr(components, "CHUNK_EDGES", 1)
    line = [(k, k + 1) for k in range(40)]
    random.Random(3).shuffle(line)
    found = connected_components(spark.createDataFrame(line, "src long, dst long").repartition(5))
    assert {(r.node, r.component) for r in found.collect()} == {(k, 0) for k in range(41)}


def test_totals_take_neither_places_nor_envelopes(spark, monkeypatch):
    rows = derive.detections(derive.table(spark, SF, "events"))
    members, clusters = I.assign_clusters(rows)
    described = I.describe(members, clusters.largest)

    def refused(*_, **__):
        raise AssertionError("not needed")

    monkeypatch.setattr(I, "with_place", refused)
    monkeypatch.setattr(hull, "envelopes_of_large", refused)
    monkeypatch.setattr(hull, "PART_POSITIONS", 1)
    for name in ("c05_incident_id", "c06_center", "c07_frp_totals", "c08_time_extent", "c09_confidence", "c11_severity"):
        catalog.queries()[name](spark, SF)
    totals = I.totals(I.label_clusters(rows)[0])
    assert "trend" not in totals.columns and "boundary" not in totals.columns
    same = [c for c in totals.columns if c != "component"]
    assert {repr(r) for r in totals.select(same).collect()} == {repr(r) for r in described.select(same).collect()}


def test_few_stars_are_joined_in_one_task(spark, monkeypatch):
    line = [(k, k + 1) for k in range(40)] + [(100, 101), (102, 101), (7, 7)]
    random.Random(4).shuffle(line)
    edges = spark.createDataFrame(line, "src long, dst long").repartition(5)
    by_rounds = {(r.node, r.component) for r in connected_components(edges).collect()}
    monkeypatch.setattr(components, "_round", lambda *_: pytest.fail("no rounds are needed"))
    found = connected_components(edges, whole=1000).collect()
    assert {(r.node, r.component) for r in found} == by_rounds and len(found) == len(by_rounds) == 44
    monkeypatch.undo()
    assert {(r.node, r.component) for r in connected_components(edges, whole=1).collect()} == by_rounds
