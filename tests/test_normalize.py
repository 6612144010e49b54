import itertools
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from conftest import NOW, START, seen, where
from emberfold import settings
from emberfold.operators import normalize as N
from emberfold.operators import stats
from emberfold.sources import detections as source

# Field values by what the rules say of them; every combination is tested below.
PLACES = {"good": {}, "bad": {"latitude": "91"}, "bad too": {"longitude": "-inf"}}
TIMES = {"good": {}, "bad": {"acq_time": "1261"}, "bad too": {"acq_date": "2025-02-29"}}
CRAFT = {"good": {}, "bad": {"satellite": " \t\x07"}, "bad too": {"satellite": None}}


def test_first_broken_rule_decides(raw):
    """Place comes before time, time before satellite; each row counts once."""
    rows, expected = [], {"invalid_coordinates": 0, "invalid_timestamps": 0, "invalid_satellites": 0}
    for place, time, craft in itertools.product(PLACES, TIMES, CRAFT):
        rows.append(seen(**{**PLACES[place], **TIMES[time], **CRAFT[craft]}))
        for name, kind in zip(expected, (place, time, craft)):
            if kind != "good":
                expected[name] += 1
                break
    clean, report = N.normalize(raw(*rows), 1, NOW)
    counts = report.first().asDict()
    assert clean.count() == 1 and counts["received_rows"] == 27 and counts["dropped_rows"] == 26
    assert {name: counts[name] for name in expected} == expected


def test_flags_follow_the_values(raw):
    levels = {"h": [], "h\u200b": ["confidence_sanitized"], "very sure": ["confidence_unknown"]}
    powers = {"3.5": [], str(settings.HIGH_FRP_MW): [], str(settings.HIGH_FRP_MW + 0.5): ["frp_high"], "-1": ["frp_invalid"],
              "much": ["frp_invalid"]}
    crafts = {"N21": [], "N21\x1f": ["satellite_sanitized"]}
    rows, expected = [], {}
    for k, (level, power, craft) in enumerate(itertools.product(levels, powers, crafts)):
        rows.append(seen(north=500 * k, level=level, frp=power, craft=craft))
        expected[where(500 * k)[0]] = sorted(levels[level] + powers[power] + crafts[craft])
    clean, report = N.normalize(raw(*rows), 1, NOW)
    assert {r.latitude: r.quality_flags for r in clean.collect()} == expected
    counts = report.first()
    for column, flag in (("high_frp", "frp_high"), ("invalid_frp", "frp_invalid"), ("unknown_confidence", "confidence_unknown")):
        assert counts[column] == sum(flag in f for f in expected.values())


def test_window_ends_belong_to_it(raw):
    """From one day before now until a quarter of an hour after it, by minutes, across midnight."""
    for now in (NOW, START + timedelta(minutes=20)):
        at = int((now - START).total_seconds() // 60)
        offsets = [-1441, -1440, -1439, 0, 15, 16]
        rows = [seen(at + m, north=500 * k) for k, m in enumerate(offsets)]
        clean, report = N.normalize(raw(*rows), 1, now)
        assert sorted(r.latitude for r in clean.collect()) == [where(500 * k)[0] for k in (1, 2, 3, 4)]
        assert report.first().invalid_timestamps == 2


def test_duplicates_resolve_the_same_way_in_any_order(raw):
    rows = [seen(level="h", frp=20), seen(level="l", frp=10), seen(level="h", frp=5),
            seen(level="h", frp="10.0"), seen(level="h", frp="oops")]
    results = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        clean, report = N.normalize(raw(*order), 1, NOW)
        counts = report.first()
        results.append((clean.collect(), counts.duplicates_removed, counts.conflicting_duplicates))
    assert results[0] == results[1] == results[2]
    winner, removed, conflicts = results[0]
    # Text order: "10.0" < "20.0" < "5.0" < missing.
    assert (winner[0].confidence, winner[0].frp, removed, conflicts) == ("h", 10.0, 4, 4)


def test_identical_copies_are_not_conflicts(raw):
    _, report = N.normalize(raw(seen(), seen(), seen()), 1, NOW)
    counts = report.first()
    assert (counts.duplicates_removed, counts.conflicting_duplicates) == (2, 0)


@pytest.mark.parametrize("missing", ["latitude", "acq_time", "frp"])
def test_a_batch_without_a_column_is_refused(raw, missing):
    with pytest.raises(N.InvalidBatch, match="required columns"):
        N.normalize(raw(seen()).drop(missing), 1, NOW)


def test_a_batch_needs_one_valid_row_unless_it_is_empty(raw):
    late = raw(*[seen(-3000 - k) for k in range(4)])
    for rows, refused in ((late, True), (late.unionByName(raw(seen())), False), (late.limit(0), False)):
        report = N.normalize(rows, 1, NOW)[1]
        if refused:
            with pytest.raises(N.InvalidBatch, match="no valid rows"):
                N.require_valid_rows(report)
        else:
            assert N.require_valid_rows(report)["received_rows"] == rows.count()


def test_row_guard(raw):
    rows = raw(*[seen(k) for k in range(5)])
    assert source.check_rows(rows, 5).count() == 5
    with pytest.raises(source.BatchTooLarge):
        source.check_rows(rows, 4)


def test_csv_by_name_with_guards(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("frp,longitude,latitude,extra,satellite,acq_time,acq_date,confidence\n5.5,-8.6,42.1,x,N20,0900,2025-03-05,n\n")
    row = source.read_detections_csv(spark, str(good)).first()
    assert (row.latitude, row.longitude, row.acq_time) == ("42.1", "-8.6", "0900")
    size = good.stat().st_size
    assert source.check_bytes(spark, str(good), size) == size
    with pytest.raises(source.BatchTooLarge):
        source.read_detections_csv(spark, str(good), max_bytes=size - 1)
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    with pytest.raises(N.InvalidBatch):
        source.check_bytes(spark, str(empty), 10)
    short = tmp_path / "short.csv"
    short.write_text("latitude,longitude\n1,2\n")
    with pytest.raises(N.InvalidBatch):
        source.read_detections_csv(spark, str(short))
    mixed = tmp_path / "mixed.csv"
    mixed.write_text("latitude,longitude,confidence,acq_date,acq_time,satellite,frp\n1,2,n,2025-03-05,900,N20,5\n1,2\n")
    rows, bad = source.read_with_quarantine(spark, str(mixed))
    assert (rows.count(), [r.record for r in bad.collect()]) == (1, ["1,2"])


def test_stats(raw):
    clean, _ = N.normalize(raw(seen(frp=10.5), seen(north=900, frp=20.5)), 1, NOW)
    assert stats.summarize(clean).first().asDict() == {
        "total_detections": 2, "average_frp": 15.5, "maximum_frp": 20.5}
    clean, _ = N.normalize(raw(seen(frp=None)), 1, NOW)
    assert stats.summarize(clean).first().asDict() == {
        "total_detections": 1, "average_frp": 0.0, "maximum_frp": 0.0}
    assert [tuple(r) for r in stats.counts_by_satellite(clean).collect()] == [("N21", 1)]


def test_coercion_keeps_rows_outside_the_area(raw):
    rows = N.coerce_for_clustering(raw(
        seen(latitude=-33.5, frp="?", level="HIGH", acq_time="1107.0"), seen(latitude="x"),
        seen(acq_time="9999"), seen(acq_date=None))).collect()
    assert [(r.latitude, r.frp, r.confidence_normalized, r.acq_time_text) for r in rows] == [
        (-33.5, None, "high", "1107")]


def test_filters_do_not_repeat_the_parsing(raw):
    plan = N.accepted_rows(N.annotate(raw(seen()), 1, NOW))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= 8


def test_places_count_the_whole_order(raw):
    rows = [seen(600 - 7 * (k % 5), north=300 * (k % 4), east=200 * k) for k in range(40)]
    clean, _ = N.normalize(raw(*rows), 1, NOW)
    ordered = [tuple(r[c] for c in N.CANONICAL_ORDER) for r in N.canonical_sort(clean).collect()]
    placed = {r.place: tuple(r[c] for c in N.CANONICAL_ORDER) for r in N.canonical_places(clean).collect()}
    assert [placed[k + 1] for k in range(40)] == ordered and len(placed) == 40
