import hashlib
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import DAY, NOW, START, UTC, seen, where
from emberfold.operators import bloom
from emberfold.operators import history as H
from emberfold.operators import normalize as N
from emberfold.plans import hours, reads, snapshot
from emberfold.sources import history as store
from emberfold.streaming import ingest

AT = NOW


def clean(raw, *rows, at=AT):
    return N.normalize(raw(*rows), 1, at)[0]


def batch_of(spark, detections, prior, at=AT):
    table = spark.createDataFrame(list(prior.items()), "detection_id string, prior_id string")
    return snapshot.build_batch(detections, lambda facts, rows: table, at)


def ids_of(detections):
    return {(r.latitude, r.longitude): r.detection_id for r in H.with_ids(detections).collect()}


def test_identity_of_one_observation(spark):
    latitude, longitude = where(250, -90)
    rows = spark.createDataFrame(
        [(latitude, longitude, START, name) for name in ("N21", " N21 ")],
        "latitude double, longitude double, observed_at timestamp, satellite string")
    text = f"VIIRS_NOAA20_NRT|N21|2025-03-05T00:00:00+00:00|{latitude:.5f}|{longitude:.5f}"
    assert {r.d for r in rows.select(H.detection_id().alias("d")).collect()} == {hashlib.sha256(text.encode()).hexdigest()}
    assert H.hour_of(AT) == datetime(2025, 3, 5, 12, tzinfo=UTC)


def test_repeated_detection_is_one_member(spark, raw):
    batch = batch_of(spark, raw(seen(50, frp=2), seen(50, frp=2), seen(50, frp=2)), {})
    facts, rows, members = batch.detections.collect(), batch.clusters.collect(), batch.members.collect()
    assert len(facts) == len(rows) == len(members) == 1
    assert facts[0].cluster_id == rows[0].cluster_id == members[0].cluster_id and rows[0].detection_count == 1
    assert members[0].detection_id == facts[0].detection_id and rows[0].total_frp_mw == 6.0


def test_bridge_merges_into_the_earliest_assignment(spark, raw):
    data = clean(raw, *[seen(60 * k, north=1800 * k) for k in range(3)])
    ids = ids_of(data)
    batch = batch_of(spark, data, {ids[where(0)]: "cluster-south", ids[where(3600)]: "cluster-north"})
    rows = {r.status: r for r in batch.clusters.collect()}
    assert (rows["active"].cluster_id, rows["merged"].cluster_id) == ("cluster-south", "cluster-north")
    assert rows["merged"].merged_into_cluster_id == "cluster-south"
    assert (rows["merged"].detection_count, rows["merged"].total_frp_mw) == (0, 0)
    assert {r.cluster_id for r in batch.detections.collect()} == {"cluster-south"}
    assert batch.members.count() == 3 and batch.merged == 1
    assert {r.cluster_id: r.survivor for r in H.merged_lineage(batch.clusters).collect()} == {"cluster-north": "cluster-south"}


def test_split_keeps_one_owner(spark, raw):
    data = clean(raw, seen(100), seen(130, north=7000))
    batch = batch_of(spark, data, {i: "cluster-before" for i in ids_of(data).values()})
    owners = {r.latitude: r.cluster_id for r in batch.detections.collect()}
    assert owners[where(0)[0]] == "cluster-before" and owners[where(7000)[0]] != "cluster-before"


def greedy(components, prior):
    """components: {component: (first_at, incident_id, [(id, at)])}; walks them oldest first."""
    taken, result, merged = set(), {}, {}
    for name, (first, incident, members) in sorted(components.items(), key=lambda kv: kv[1][:2]):
        held = [(at, prior[i]) for i, at in members if i in prior and prior[i] not in taken]
        owned = {c for _, c in held}
        taken |= owned
        result[name] = min(held)[1] if held else None
        merged[name] = owned - {result[name]}
    return result, merged


def test_ownership_equals_the_oldest_first_walk(spark):
    rng = random.Random(4)
    facts, heads, prior, expected = [], [], {}, {}
    for case in range(60):
        components = {}
        for c in range(rng.randint(1, 5)):
            key = case * 10 + c
            members = [(f"d{key}-{i}", rng.randint(0, 6)) for i in range(rng.randint(1, 5))]
            components[key] = (min(t for _, t in members), f"i{rng.random():.6f}", members)
            for i, t in members:
                facts.append((key, i, t))
                if rng.random() < 0.6:
                    prior[i] = f"p{case}-{rng.randint(0, 3)}"
            heads.append((key, components[key][0], components[key][1]))
        kept, merged = greedy(components, prior)
        expected.update({k: (kept[k], merged[k]) for k in components})
    stamp = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    fact_df = spark.createDataFrame(facts, "component long, detection_id string, observed_at long").select(
        "component", "detection_id", stamp("observed_at"))
    head_df = spark.createDataFrame(heads, "component long, first_detected_at long, incident_id string").select(
        "component", stamp("first_detected_at"), "incident_id")
    prior_df = spark.createDataFrame(list(prior.items()), "detection_id string, prior_id string")
    identities, merged = H.resolve_identities(fact_df, head_df, prior_df)
    got = {r.component: r.cluster_id for r in identities.collect()}
    gone = {}
    for r in merged.collect():
        gone.setdefault(r.component, set()).add(r.merged_id)
    for key, (kept, merged_ids) in expected.items():
        assert got[key] == kept if kept else got[key].startswith("cluster-")
        assert gone.get(key, set()) == merged_ids
    assert H.collisions(identities, merged).count() == 0


def test_snapshots_over_hours(spark, raw, tmp_path):
    root = str(tmp_path)
    hour = lambda h: START + timedelta(hours=h, minutes=8)
    first = snapshot.run_snapshot(spark, raw(seen(90, frp=3)), root, hour(4)).first()
    assert (first.status, first.detections_processed, first.cluster_snapshots_processed) == ("ingested", 1, 1)
    grown = raw(seen(90, frp=4), seen(200, east=600, frp=9))
    for _ in range(2):  # the second run is a retry of the same hour
        again = snapshot.run_snapshot(spark, grown, root, hour(6)).first()
        assert (again.detections_processed, again.clusters_merged) == (2, 0)
    days = (DAY, DAY)
    clusters = store.read_history(spark, root, "fire_clusters", *days).orderBy("snapshot_at").collect()
    assert len(clusters) == 2 and len({c.cluster_id for c in clusters}) == 1
    assert store.read_history(spark, root, "fire_cluster_members", *days).count() == 3
    facts = {r.longitude: r for r in store.read_history(spark, root, "fire_detections", *days).collect()}
    assert len(facts) == 2
    old = facts[where()[1]]
    assert (old.first_ingested_at.hour, old.last_ingested_at.hour, old.frp_mw) == (4, 6, 4.0)
    assert snapshot.run_snapshot(spark, grown.limit(0), root, hour(7)).first().status == "no_data"
    with pytest.raises(snapshot.StaleSource):
        snapshot.run_snapshot(spark, grown, root, hour(7), stale=True)
    with pytest.raises(store.StorageLimit):
        snapshot.run_snapshot(spark, grown, root, hour(7), storage_limit=1)
    assert len(store.read_history(spark, root, "fire_clusters", *days).collect()) == 2
    with pytest.raises(TypeError):
        store.read_history(spark, root, "fire_clusters", None, None)
    plan = store.read_history(spark, root, "fire_clusters", *days)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_date" in plan


def test_orphans_and_repeats_refuse_the_batch(spark, raw):
    batch = batch_of(spark, clean(raw, seen(75)), {})
    store.check_relationships(batch.detections, batch.clusters)
    with pytest.raises(N.InvalidBatch, match="orphan_cluster_reference"):
        store.check_relationships(batch.detections.withColumn("cluster_id", F.lit("missing")), batch.clusters)
    with pytest.raises(N.InvalidBatch, match="duplicate_cluster_snapshot"):
        store.check_relationships(batch.detections, batch.clusters.unionByName(batch.clusters))
    with pytest.raises(N.InvalidBatch, match="duplicate_detection"):
        store.check_relationships(batch.detections.unionByName(batch.detections), batch.clusters)


def test_json_pages_keep_every_value(spark, raw):
    batch = batch_of(spark, clean(raw, *[seen(30, north=9000 * i, frp=4 if i else None) for i in range(9)]), {})
    for df in (batch.detections, batch.clusters):
        dates = {n: F.col(n).cast("string") for n, t in df.dtypes if t == "date"}
        df = df.withColumns(dates)
        pages = store.encode_json_pages(df, "cluster_id", df.count(), page_rows=4)
        assert pages.count() > 1
        assert sorted(map(str, store.decode_json_pages(pages, df.schema).collect())) == sorted(map(str, df.collect()))


def test_retention(spark, raw, tmp_path):
    batch = batch_of(spark, clean(raw, seen(80), seen(-45)), {})
    store.upsert(spark, str(tmp_path), {"fire_detections": batch.detections})
    listed = store.expire_partitions(spark, str(tmp_path), "fire_detections", DAY, days=0)
    assert listed == [DAY - timedelta(days=1)]
    assert store.partitions(spark, str(tmp_path), "fire_detections") == [DAY - timedelta(days=1), DAY]
    store.expire_partitions(spark, str(tmp_path), "fire_detections", DAY, days=0, dry_run=False)
    assert store.partitions(spark, str(tmp_path), "fire_detections") == [DAY]


def test_a_batch_with_repeated_keys_is_refused(spark, raw, tmp_path):
    batch = batch_of(spark, clean(raw, seen(75)), {})
    with pytest.raises(store.DuplicateKeys):
        store.upsert(spark, str(tmp_path), {"fire_detections": batch.detections.unionByName(batch.detections)})


def test_held_rows_keep_flags_and_new_rows_win(spark, raw, tmp_path):
    root = str(tmp_path)
    at = lambda m: START + timedelta(minutes=m)
    snapshot.run_snapshot(spark, raw(seen(60, craft="N21\x07", frp=5.5), seen(60, east=500, frp=7)), root, at(60))
    later = raw(seen(60, east=500, frp=9.9), seen(90, east=900))
    snapshot.run_snapshot(spark, later, root, at(90), held=hours.held_detections(spark, root, at(90) - timedelta(days=1), at(90)))
    rows = {r.longitude: r for r in store.read_history(spark, root, "fire_detections", DAY, DAY).collect()}
    assert len(rows) == 3 and len({r.cluster_id for r in rows.values()}) == 1
    assert (rows[where()[1]].frp_mw, rows[where()[1]].quality_flags) == (5.5, ["satellite_sanitized"])
    assert rows[where(0, 500)[1]].frp_mw == 9.9


def test_a_backlog_longer_than_the_window_reaches_history(spark, raw, tmp_path):
    root, landing = str(tmp_path / "history"), str(tmp_path / "landing")
    raw(seen(100), seen(100 - 2880)).write.parquet(landing)
    stream = spark.readStream.schema(raw(seen()).schema).parquet(landing)
    ingest.start_snapshots(stream, root, str(tmp_path / "offsets"), clock=lambda: NOW, availableNow=True).awaitTermination()
    days = (DAY - timedelta(days=9), DAY)
    assert store.read_history(spark, root, "fire_detections", *days).count() == 2
    assert store.read_history(spark, root, "fire_clusters", *days).count() == 2


def test_names_over_hours_equal_one_hour_after_the_other(spark):
    """Many small cases at once: ties, merges, splits, returning names, and ids of earlier snapshots."""
    rng = random.Random(11)
    facts, heads, prior, expected, gone = [], [], [], {}, {}
    name = lambda text: "cluster-" + hashlib.sha256(text.encode()).hexdigest()[:16]
    stamp = lambda hour: 3600 * hour
    for case in range(150):
        at = {f"d{case}-{i}": rng.randint(0, 2) for i in range(7)}
        alive = {i: (rng.randint(0, 3), rng.randint(3, 6)) for i in at}
        held = {i: f"p{case}-{rng.randint(0, 2)}" for i, (start, _) in alive.items() if start == 0 and rng.random() < 0.6}
        prior += list(held.items())
        before = {}
        for hour in range(6):
            groups = {}
            for i, (start, end) in alive.items():
                if start <= hour <= end:
                    groups.setdefault(rng.randint(0, 2), []).append(i)
            components = {}
            for g, members in groups.items():
                key = (case * 10 + hour) * 10 + g
                components[key] = (min(at[i] for i in members), f"i{rng.randint(0, 3)}", [(i, at[i]) for i in members])
                heads.append((key, components[key][0], components[key][1]))
                facts += [(hour, key, i, at[i], stamp(hour), before.get(i)) for i in members]
            kept, merged = greedy({k: (f, (inc, k), m) for k, (f, inc, m) in components.items()}, held)
            claims = [c for c in kept.values() if c] + [m for ms in merged.values() for m in ms]
            held = {}
            for key, (_, _, members) in components.items():
                anchor = min((t, i) for i, t in members)[1]
                own = kept[key] or name(anchor)
                if not kept[key] and own in claims:
                    own = name(f"{anchor}|{stamp(hour)}")
                expected[key], gone[key] = own, merged[key]
                held.update({i: own for i, _ in members})
            before = {i: key for key, (_, _, members) in components.items() for i, _ in members}
    moment = lambda c: F.timestamp_seconds(F.col(c)).alias(c)
    fact_df = spark.createDataFrame(
        facts, "number int, component long, detection_id string, observed_at long, snapshot_hour long, before long").select(
        "number", "component", "detection_id", moment("observed_at"), moment("snapshot_hour"), "before")
    head_df = spark.createDataFrame(heads, "component long, first_detected_at long, incident_id string").select(
        "component", moment("first_detected_at"), "incident_id")
    names, merged = hours.resolve_hours(
        fact_df, head_df, spark.createDataFrame(prior, "detection_id string, prior_id string"))
    got = {r.component: r.cluster_id for r in names.collect()}
    assert got == expected
    found = {}
    for r in merged.collect():
        found.setdefault(r.component, set()).add(r.merged_id)
    assert found == {k: v for k, v in gone.items() if v}
    assert any(v != name(i) for v in got.values() for i in ["x"]) and len(set(got.values())) > 100


def plain_history(rows):
    """Snapshot after snapshot of (minutes, metres north): active clusters, tombstones and final assignments."""
    text = lambda row: hashlib.sha256("|".join([
        "VIIRS_NOAA20_NRT", "N21", (START + timedelta(minutes=row[0])).isoformat(),
        *(f"{c:.5f}" for c in where(row[1]))]).encode()).hexdigest()
    held, clusters, final = {}, [], {}
    for hour in sorted({m // 60 for m, _ in rows}):
        end = max(m for m, _ in rows if m // 60 == hour)
        left = [r for r in rows if end - 1440 <= r[0] <= end]
        components = {}
        while left:
            group, grown = [left.pop()], True
            while grown:
                near = [r for r in left if any(abs(r[1] - g[1]) <= 2000 for g in group)]
                group, left, grown = group + near, [r for r in left if r not in near], bool(near)
            components[len(components)] = (min(group)[0], "", [(text(r), r[0]) for r in group])
        kept, merged = greedy(components, held)
        held = {}
        for key, (_, _, members) in components.items():
            own = kept[key] or "cluster-" + hashlib.sha256(min((t, i) for i, t in members)[1].encode()).hexdigest()[:16]
            at = START + timedelta(hours=hour)
            clusters.append((at, own, "active", "", len(members)))
            clusters += [(at, m, "merged", own, 0) for m in merged[key]]
            held.update({i: own for i, _ in members})
            final.update({i: (own, at) for i, _ in members})
    return sorted(clusters), sorted((i, *v) for i, v in final.items())


def test_tables_depend_on_the_rows_alone(spark, raw, tmp_path):
    """One batch, and batches that cut hours and come late, give what snapshot after snapshot gives."""
    rng = random.Random(5)
    rows = [(m, 1500 * rng.randint(0, 9)) for m in rng.sample(range(-600, 760, 5), 26)]
    rows += [(-1500, 0), (-1500 + 1430, 1500), (-1490, 3000)]  # two that are joined, and joined again later
    schema = raw(seen()).schema
    days = (DAY - timedelta(days=9), DAY)

    def history(name, batches):
        root, landing = str(tmp_path / name), str(tmp_path / f"{name}-landing")
        for batch in batches:
            raw(*[seen(m, north=n) for m, n in batch]).coalesce(1).write.mode("append").parquet(landing)
            ingest.start_snapshots(
                spark.readStream.schema(schema).parquet(landing), root, str(tmp_path / f"{name}-offsets"),
                clock=lambda: NOW, availableNow=True).awaitTermination()
        read = lambda table: store.read_history(spark, root, table, *days).collect()
        clusters = sorted((r.snapshot_at.replace(tzinfo=UTC), r.cluster_id, r.status, r.merged_into_cluster_id or "", r.detection_count)
                          for r in read("fire_clusters"))
        return clusters, sorted((r.detection_id, r.cluster_id, r.cluster_snapshot_at.replace(tzinfo=UTC)) for r in read("fire_detections"))

    expected = plain_history(rows)
    assert {s for _, _, s, _, _ in expected[0]} == {"active", "merged"}
    assert history("once", [rows]) == expected
    late = [r for r in rows if r[1] % 4000 == 0]
    assert history("parts", [[r for r in rows if r not in late], late]) == expected


def test_a_cluster_is_described_once_while_it_stays_the_same(spark, raw):
    """Lasting spots: their clusters are rows of a span each, however many snapshots the span has."""
    rows = [(0, 0), (30, 500), (300, 500), *[(60 * k + 20, 90_000 + 9000 * k) for k in range(20)]]
    table = H.with_ids(N.normalize(raw(*[seen(m, north=n) for m, n in rows]), 9, START + timedelta(days=1))[0])
    at = [int((START + timedelta(minutes=60 * k + (30 if k == 0 else 20))).timestamp()) for k in range(20)]
    members, largest = hours._clusters_of_all_hours(spark, table, [(t - t % 3600, t) for t in at], 1)
    spans = Counter((r.number, r.until, r.cluster_size) for r in members.collect())
    lone = {(k, 19, 1): 1 for k in range(1, 20)}
    assert spans == Counter({(0, 19, 1): 1, (0, 4, 2): 2, (5, 19, 3): 3}) + Counter(lone)
    assert largest == 3


def test_chains_of_pointers_end_alike_in_one_task_and_by_doubling(spark, monkeypatch):
    chains = [("#1", "#0"), ("#2", "#1"), ("#3", "#2"), ("#0", "cluster-a"), ("#9", "#8"), ("#8", "#7"), ("#20", "cluster-b"), ("#31", "#30")]
    random.Random(1).shuffle(chains)
    pointers = lambda rows: spark.createDataFrame(rows, "key string, root string").repartition(3)
    want = {("#1", "cluster-a"), ("#2", "cluster-a"), ("#3", "cluster-a"), ("#0", "cluster-a"), ("#9", "#7"), ("#8", "#7"),
            ("#20", "cluster-b"), ("#31", "#30")}
    at_once = hours._roots(pointers(chains))
    with pytest.raises(Exception, match="cycle"):
        hours._roots(pointers([("#1", "#2"), ("#2", "#3"), ("#3", "#1"), ("#5", "#1")]))
    assert hours._roots(pointers(chains).where("key = ''")).count() == 0
    monkeypatch.setattr(hours, "WHOLE_POINTERS", 0)
    by_doubling = hours._roots(pointers(chains))
    assert {tuple(r) for r in at_once.collect()} == {tuple(r) for r in by_doubling.collect()} == want


def test_rows_of_a_span_are_written_once(spark, raw, tmp_path, monkeypatch):
    rows = [(0, 0), (30, 500), (300, 500), *[(60 * k + 20, 90_000 + 9000 * k) for k in range(12)]]
    table = N.normalize(raw(*[seen(m, north=n) for m, n in rows]), 9, START + timedelta(days=1))[0]
    sizes, plain = {}, hours.written

    def counted(df, name, *metrics):
        out, state = plain(df, name, *metrics)
        sizes[name] = state["rows"]
        return out, state

    monkeypatch.setattr(hours, "written", counted)
    assert hours.run_hours(spark, table, str(tmp_path), 1) == 12
    # The spot has a span of two and one of three members; each lone one has a span.
    assert (sizes["cluster-rows"], sizes["member-rows"]) == (2 + 12, 5 + 12)
    read = lambda name: store.read_history(spark, str(tmp_path), name, DAY, DAY)
    assert Counter(r.snapshot_at.hour for r in read("fire_clusters").collect()) == Counter({k: k + 2 for k in range(12)})
    held = Counter(r.snapshot_at.hour for r in read("fire_cluster_members").collect())
    assert held == Counter({k: k + 1 + (3 if k >= 5 else 2) for k in range(12)})


def test_calls_side_by_side_keep_their_order_and_leave_nothing(spark):
    from emberfold.session import scratch, together, written
    with scratch(spark):
        made = together(spark, *[lambda k=k: written(spark.range(k), "some") for k in (3, 1, 2)])
        paths = [path for df, _ in made for path in df.inputFiles()]
        assert [state["rows"] for _, state in made] == [3, 1, 2] and paths
        with pytest.raises(ZeroDivisionError):
            together(spark, lambda: 1, lambda: 1 // 0)
    assert not any(store.exists(spark, path) for path in paths)


def test_a_stopped_commit_leaves_the_version_before(spark, raw, tmp_path, monkeypatch):
    root = str(tmp_path)
    batch = batch_of(spark, clean(raw, seen(80), seen(95, north=300)), {})
    whole = {"fire_clusters": batch.clusters, "fire_cluster_members": batch.members, "fire_detections": batch.detections}
    store.upsert(spark, root, whole)
    count = lambda: [store.read_history(spark, root, t, DAY, DAY).count() for t in whole]
    reader = store.read_history(spark, root, "fire_clusters", DAY, DAY)
    before = count()
    other = batch.clusters.withColumn("cluster_id", F.lit("cluster-other"))

    def stop(*_):
        raise RuntimeError("killed")

    for step in ("write_partitions", "_dates", "_publish"):
        with monkeypatch.context() as patch:
            patch.setattr(store, step, stop)
            with pytest.raises(RuntimeError, match="killed"):
                store.upsert(spark, root, {"fire_clusters": other})
        assert count() == before and store.versions(spark, root) == [1]
    stale = store.read_manifest(spark, root)
    store.commit(spark, root, {"fire_clusters": other})
    with pytest.raises(store.ConcurrentCommit):
        store.commit(spark, root, {"fire_clusters": other}, stale)
    assert reader.count() == before[0] and {r.cluster_id for r in reader.collect()} != {"cluster-other"}
    removed = store.expire_versions(spark, root, keep=1)
    assert len(removed) >= 3 and store.versions(spark, root) == [2]  # two stopped ones, and that of version 1
    assert count() == [1, *before[1:]]


def test_intermediates_go_when_the_run_ends(spark):
    from emberfold.session import scratch, written
    with pytest.raises(ValueError), scratch(spark):
        kept = written(spark.range(3), "aside")[0]
        path = kept.inputFiles()[0].rsplit("/", 1)[0]
        assert store.exists(spark, path)
        raise ValueError
    assert not store.exists(spark, path)


def facts_of(spark, rows):
    """History rows of (id, day, minute, satellite, frp)."""
    values = [(f"d{i}", START + timedelta(days=day, minutes=minute), craft, frp) for i, day, minute, craft, frp in rows]
    df = spark.createDataFrame(values, "detection_id string, observed_at timestamp, satellite string, frp_mw double")
    df = df.withColumn("observation_date", F.to_date("observed_at"))
    return df.select(*[F.col(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name)
                       for f in store.FIRE_DETECTIONS])


def test_rolling_reads_equal_a_scan_after_corrections(spark, tmp_path):
    rng, root = random.Random(5), str(tmp_path)
    crafts = ["N20", "N21", "NPP"]
    rows = [(i, rng.randrange(9), rng.randrange(1440), rng.choice(crafts), rng.choice([None, 0.0, round(rng.random() * 90, 2)]))
            for i in range(300)]
    rows += [(900 + d, d, m, "N20", 5e3) for d, m in ((0, 0), (2, 1439), (5, 600))]  # maxima that go again
    store.upsert(spark, root, {"fire_detections": facts_of(spark, rows)})
    rows = [r[:4] + (1.25,) if r[0] >= 900 or r[0] % 7 == 0 else r for r in rows]
    store.upsert(spark, root, {"fire_detections": facts_of(spark, [r for r in rows if r[0] >= 900 or r[0] % 7 == 0])})
    for now in (START + timedelta(days=8), START + timedelta(days=8, hours=9, minutes=17), START + timedelta(days=40)):
        got = {r.days: tuple(r)[1:] for r in reads.rolling_summary(spark, root, now, [1, 2, 6]).collect()}
        for days, found in got.items():
            inside = [r for r in rows if now - timedelta(days=days) <= START + timedelta(days=r[1], minutes=r[2])
                      <= now + timedelta(minutes=15)]
            known = [r[4] for r in inside if r[4] is not None]
            assert found[0] == len(inside)
            assert abs(found[1] - (sum(known) / len(known) if known else 0)) <= 0.00501
            assert found[2] == max(known, default=0)
            crafts_seen = {r.satellite: r.total_detections for r in reads.rolling_by_satellite(spark, root, now, days).collect()}
            assert crafts_seen == Counter(r[3] for r in inside)


def test_partials_go_with_their_rows_and_old_histories_have_none(spark, tmp_path):
    root = str(tmp_path)
    rows = [(i, i % 4, 30 * i, "N21", float(i)) for i in range(20)]
    store.commit(spark, root, {"fire_detections": facts_of(spark, rows)})
    day = lambda k: DAY + timedelta(days=k)
    count = lambda manifest=None: sum(r.detections for r in store.read_partials(
        spark, root, "fire_daily_detections", day(0), day(9), manifest).collect())
    assert count() == 20
    old = store.read_manifest(spark, root)
    files = store._read(spark, root, "fire_daily_detections", day(0), day(9), old)
    assert files.count() == 4  # a row for each date and satellite
    del old["tables"]["fire_daily_detections"]
    assert count(old) == 20
    store.expire_partitions(spark, root, "fire_detections", day(2), days=0, dry_run=False)
    assert count() == 10


def test_a_bloom_filter_never_loses_a_key(spark, monkeypatch):
    keys = spark.range(0, 60_000, 3).select(F.col("id").cast("string").alias("k")).unionByName(
        spark.sql("SELECT CAST(NULL AS STRING) AS k"))
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("k"), "id")
    flagged = bloom.with_likely(rows, keys, ["k"], 20_001)
    found = flagged.groupBy((F.col("id") % 3 == 0).alias("held")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_likely").alias("likely")).collect()
    by = {r.held: r for r in found}
    assert by[True].likely == by[True].n == 20_000 and by[False].n == 40_000
    assert by[False].likely < 0.01 * by[False].n
    monkeypatch.setattr(bloom, "MAX_BYTES", 4096)  # too small: lets more through, still loses none
    assert bloom.with_likely(rows, keys, ["k"], 20_001).where("_likely AND id % 3 = 0").count() == 20_000
    assert bloom.likely(rows, keys, ["k"], 20_001).count() == 60_000


def test_large_batches_give_the_same_history(spark, tmp_path, monkeypatch):
    rows = [(i, i % 3, i, "NPP", float(i)) for i in range(200)]
    later = [(i, i % 3, i, "NPP", -1.0) for i in range(150, 260)]
    out = []
    for most in (store.settings.BROADCAST_ROWS, 10):
        monkeypatch.setattr(store.settings, "BROADCAST_ROWS", most)
        root = f"{tmp_path}/{most}"
        for batch in (rows, later):
            store.upsert(spark, root, {"fire_detections": facts_of(spark, batch)})
        past = store.read_history(spark, root, "fire_detections", DAY, DAY + timedelta(days=5))
        prior = H.prior_assignments(facts_of(spark, later), past.fillna("c", ["cluster_id"]), len(later))
        out.append((sorted((r.detection_id, r.frp_mw) for r in past.collect()), sorted(map(tuple, prior.collect()))))
    assert out[0] == out[1] and len(out[0][0]) == 260 and len(out[0][1]) == 110
