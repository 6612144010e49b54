import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from emberfold.operators import series

START = datetime(2024, 3, 1, 5, 20, tzinfo=timezone.utc)
NOW = START + timedelta(hours=90)
SCHEMA = "cluster_id string, observed_at timestamp, frp_mw double"


def slow(rows):
    """Gap-filled hours of each key, walked one by one."""
    found = {}
    for key, at, frp in rows:
        if key is None or at is None or at > NOW:
            continue
        hour = int(at.timestamp()) // 3600
        held = found.setdefault(key, {}).setdefault(hour, [0, 0.0])
        held[0] += 1
        held[1] += frp or 0.0
    return {k: [(h, *hours.get(h, (0, 0.0))) for h in range(min(hours), max(hours) + 1)] for k, hours in found.items()}


def test_series_and_persistence_equal_a_walk(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "a", "a", "b", "c"]), START + timedelta(minutes=rng.randrange(100 * 60)),
             rng.choice([None, 0.0, round(rng.random() * 80, 2)])) for _ in range(150)]
    rows += [("single", START, 3.5), (None, START, 1.0), ("late", NOW + timedelta(hours=3), 1.0), ("a", None, 2.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = slow(rows)
    got = {}
    for r in series.hourly_series(df, "cluster_id", NOW).orderBy("hour_start").collect():
        got.setdefault(r.cluster_id, []).append((r.detections, round(r.total_frp, 2)))
    assert got == {k: [(n, round(y, 2)) for _, n, y in v] for k, v in expected.items()}
    end = int(NOW.timestamp()) // 3600
    facts = {r.cluster_id: r for r in series.persistence(df, "cluster_id", NOW).collect()}
    assert set(facts) == set(expected)
    for key, hours in expected.items():
        r = facts[key]
        assert (r.span_hours, r.active_hours) == (len(hours), sum(n > 0 for _, n, _ in hours))
        pause = max(len(p) for p in "".join("x" if n else "." for _, n, _ in hours).split("x"))
        assert (r.longest_pause_hours, r.detections) == (pause, sum(n for _, n, _ in hours))
        y = [v for _, _, v in hours]
        if len(y) > 1:
            assert r.slope_mw_per_hour == pytest.approx(np.polyfit(range(len(y)), y, 1)[0], abs=1e-9)
        else:
            assert r.slope_mw_per_hour is None
        last = sum(v for h, _, v in hours if h > end - 24)
        before = sum(v for h, _, v in hours if end - 48 < h <= end - 24)
        assert (r.last_24h_frp, r.before_24h_frp) == (pytest.approx(last), pytest.approx(before))
        assert r.change_frp == pytest.approx(last - before)


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert series.persistence(df, "cluster_id", NOW).count() == series.hourly_series(df, "cluster_id", NOW).count() == 0
