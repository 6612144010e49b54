"""History queries over events of which some are one observation."""

from datetime import datetime, timedelta

import pytest

from emberfold.plans import catalog


@pytest.fixture
def repeated(spark, tmp_path):
    """120 events, every third the same observation as the one before, three of them as one."""
    rows, at = [], datetime(2024, 1, 14, 6, 30)
    for k in range(120):
        twin = k - 41 if 41 <= k and k % 3 == 0 else k  # 41 events later lies at the same offsets
        moment = at + timedelta(hours=3 * (twin % 41 if k % 3 == 0 else k))
        rows.append((k, moment, 7, "view", 10.0 + k, "{}"))
    spark.createDataFrame(
        rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    ids = {(r[1], r[0] % 41) for r in rows}
    assert len(ids) < len(rows)
    return str(tmp_path), rows


def test_upsert_of_repeated_observations(spark, repeated):
    folder, rows = repeated
    got = catalog.queries()["h13_upsert_detections"](spark, folder).collect()
    assert sorted(r.frp_mw for r in got) == [r[4] + 1 for r in rows]
    assert {len(r.detection_id) for r in got} == {64} and {r.cluster_id for r in got} == {"cluster-7"}
    first = {r.frp_mw - 1: r.first_ingested_at for r in got}
    assert all(first[r[4]] == ("2024-01-30 00:00:00" if r[1] < datetime(2024, 1, 16) else "2024-01-31 00:00:00") for r in rows)


def test_reads_count_repeated_observations(spark, repeated):
    folder, rows = repeated
    now = datetime(2024, 1, 30, 15, 30)

    def stats(low, high):
        frp = [r[4] * (1 + r[0] % 2) for r in rows if low <= r[1] < high]
        return len(frp), round(sum(frp) / len(frp), 2) if frp else 0.0, max(frp, default=0.0)

    end, run = now + timedelta(minutes=16), lambda name: catalog.queries()[name](spark, folder).collect()
    assert [tuple(r)[1:] for r in run("t07_history_rolling")] == [stats(now - timedelta(days=n), end) for n in (1, 3, 7, 30)]
    assert [tuple(r)[1:] for r in run("a02_history_satellites")] == [stats(now - timedelta(days=10), end)]
    cut = now - timedelta(days=9)
    (row,) = run("a06_period_comparison")
    assert tuple(row)[1:4] == stats(cut, end) and tuple(row)[4:7] == stats(cut - timedelta(days=9), cut)
