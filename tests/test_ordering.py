"""Block-stitched order against plain Python on skewed data."""

import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import skew, trips
from shoebox.operators.ordering import running_sum, segment

HOUR = 3_600_000


def _photos(seed, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        owner = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        # A third of the photos share one instant.
        taken = 5 * HOUR if rng.random() < 0.33 else rng.randint(0, 400) * HOUR
        gps = rng.random() < 0.7
        rows.append((i, owner, taken, rng.choice([0.0, 10.0, 48.85]) if gps else None, 2.35 if gps else None))
    return rows


SCHEMA = "image_id long, owner long, taken_unix_ms long, latitude double, longitude double"


def _km(a, b):
    import math

    la, lo, lb, lp = (math.radians(x) for x in (a[3], a[4], b[3], b[4]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def _expected(rows, gap, km):
    out, last, trip, pos = {}, None, 0, 0
    for row in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if last is None or last[1] != row[1]:
            trip, pos = 1, 1
        elif row[2] - last[2] > gap * HOUR or (None not in (row[3], last[3]) and _km(last, row) > km):
            trip, pos = trip + 1, 1
        else:
            pos += 1
        out[row[0]], last = (trip, pos), row
    return out


@pytest.mark.parametrize("seed,blocks", [(1, 1), (2, 7), (3, 40)])
def test_trips_equal_sequential_scan(spark, seed, blocks):
    rows = _photos(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = trips.assign_trips(df, trips.TripThresholds(12, 300), by=["owner"], blocks=blocks)
    assert {r.image_id: (r.trip_id, r.pos) for r in got.collect()} == _expected(rows, 12, 300)


def test_trips_without_owner(spark):
    rows = [(i, 0, t, la, lo) for i, _, t, la, lo in _photos(9)]
    got = trips.assign_trips(spark.createDataFrame(rows, SCHEMA), trips.TripThresholds(3, 300), blocks=6)
    assert {r.image_id: (r.trip_id, r.pos) for r in got.collect()} == _expected(rows, 3, 300)


def test_trip_bounds_are_inclusive(spark):
    rows = [(1, 0, 0, 0.0, 0.0), (2, 0, 48 * HOUR, None, None), (3, 0, 96 * HOUR + 1, 0.0, 0.0), (4, 0, 96 * HOUR + 2, 0.0, 3.0)]
    got = trips.assign_trips(spark.createDataFrame(rows, SCHEMA))
    assert [r.trip_id for r in got.orderBy("image_id").collect()] == [1, 1, 2, 3]


def test_sweep_equals_separate_runs(spark):
    df = spark.createDataFrame(_photos(4), SCHEMA)
    settings = [trips.TripThresholds(12, 300), trips.TripThresholds(0, 0), trips.TripThresholds(168, 1000)]
    swept = {(r.max_gap_hours, r.max_distance_km): r.trips for r in trips.sweep(df, settings, ["owner"], 5).collect()}
    for s in settings:
        found = trips.trip_table(trips.assign_trips(df, s, ["owner"]), ["owner"]).count()
        limits = s.resolved()
        assert swept[(limits.max_gap_hours, limits.max_distance_km)] == found


def test_thresholds(spark):
    assert trips.TripThresholds().resolved() == trips.TripThresholds(48, 300)
    for bad in [(0.5, 0), (169, 0), (0, 9), (0, 1001)]:
        with pytest.raises(ValueError):
            trips.TripThresholds(*bad).resolved()


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    found = trips.trip_table(trips.assign_trips(empty, by=["owner"]), ["owner"])
    assert found.count() == 0
    assert tuple(trips.trip_summary(empty, found).first()) == (0, 0)


def test_running_sum(spark):
    rng = random.Random(5)
    values = [(i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(values, "id long, n long").repartition(6)
    got = {r.id: r.total for r in running_sum(df, ["id"], {"total": "n"}, blocks=9).collect()}
    total = 0
    for i, n in values:
        total += n
        assert got[i] == total


def test_segment_ranks_inside_a_hot_group(spark):
    rows = [(1 if i % 3 else 2, -(i % 5), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, worse long, id long")
    got = segment(df, ["g", "worse", "id"], ["g"], blocks=8).collect()
    for g in (1, 2):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, len(mine) + 1))
        assert [(r.worse, r.id) for r in mine] == sorted((r.worse, r.id) for r in mine)
        assert {r.outer_no for r in mine} == {g}


def test_spread_join_equals_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    right = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).filter("k != 11")
    for how in ("left", "inner"):
        want = left.join(right, "k", how)
        got = skew.spread_join(left, right, ["k"], ["id"], how, share=10)
        assert sorted(map(tuple, got.select("k", "id", "v").collect()), key=repr) == sorted(
            map(tuple, want.select("k", "id", "v").collect()), key=repr
        )
    pieces = {r.k: r._pieces for r in skew.hot_keys(left, ["k"], 20).collect()}
    assert set(pieces) == {7} and pieces[7] > 5
