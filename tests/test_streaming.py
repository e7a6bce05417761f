"""Streams over several files must equal the batch operators on all data."""

import os
import random
import time
import types

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.operators import decisions, trips
from shoebox.sources import listing
from shoebox.streaming import decisions as stream_fold
from shoebox.streaming import events, ingest, sinks
from shoebox.streaming import trips as stream_trips
from tests.test_decisions import LOG, _apply, _log

HOUR = 3_600_000


def _parts(spark, rows, schema, folder, count):
    """Write ``rows`` as ``count`` files, oldest first; returns a stream taking one file per batch."""
    step = -(-len(rows) // count)
    for i in range(count):
        part = spark.createDataFrame(rows[i * step : (i + 1) * step], schema)
        part.coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    frame = spark.read.parquet(str(folder)).schema
    return spark.readStream.schema(frame).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_decision_fold_over_batches(spark, tmp_path):
    rows = _log(11, n=200)
    stream = _parts(spark, rows, LOG, tmp_path / "log", 4)
    sinks.finish(stream_fold.follow(stream, str(tmp_path / "out"), str(tmp_path / "progress"), span=16))
    want, keepers = _apply(rows)
    for _ in range(2):
        got = stream_fold.standing(spark, str(tmp_path / "out"), T.LongType())
        assert {r.image_id: (r.decision, r.updated_at) for r in got.collect()} == want
        got = stream_fold.keepers(spark, str(tmp_path / "out"), T.LongType())
        assert {r.group_id: r.keeper_id for r in got.collect()} == keepers
        stream_fold.compact_all(spark, str(tmp_path / "out"), T.LongType(), T.LongType())


def test_decision_fold_goes_on_after_compaction(spark, tmp_path):
    rows = _log(12, n=160)
    out = str(tmp_path / "out")
    for part, number in ((rows[:90], 1), (rows[90:], 2)):
        stream = _parts(spark, part, LOG, tmp_path / f"log{number}", 2)
        first = number == 1
        # Two streams here; the second writes batches after those of the first.
        live = stream_fold.follow(stream, out if first else f"{out}-later", str(tmp_path / f"p{number}"), span=16)
        sinks.finish(live)
        if first:
            stream_fold.compact_all(spark, out, T.LongType(), T.LongType())
    for kind in ("spans", "keepers", "resets"):
        for batch in (0, 1):
            rows_of = spark.read.parquet(f"{out}-later/{kind}/batch_id={batch}")
            sinks.write_batch(rows_of, f"{out}/{kind}", batch + 2)
    want, keepers = _apply(rows)
    assert {r.image_id: (r.decision, r.updated_at) for r in stream_fold.standing(spark, out, T.LongType()).collect()} == want
    assert {r.group_id: r.keeper_id for r in stream_fold.keepers(spark, out, T.LongType()).collect()} == keepers


def test_repeated_batch_changes_nothing(spark, tmp_path):
    batch = spark.createDataFrame([(1, "x")], "a long, b string")
    for _ in range(2):
        sinks.write_batch(batch, str(tmp_path / "t"), 3)
    assert sinks.stored(spark, str(tmp_path / "t"), batch.schema).count() == 1
    assert sinks.stored(spark, str(tmp_path / "none"), batch.schema).count() == 0


def test_index_over_batches(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"id{rng.randrange(8)}", i, i * 10) for i in range(60)]
    stream = _parts(spark, rows, "id string, seq long, v long", tmp_path / "in", 3)
    sinks.finish(events.index(stream, str(tmp_path / "out"), str(tmp_path / "progress")))
    kept = T.StructType.fromDDL("id string, first_seen long, v long, last_seen long")
    got = {r.id: (r.first_seen, r.v) for r in events.current_index(spark, str(tmp_path / "out"), kept).collect()}
    want = {}
    for key, seq, v in rows:
        want[key] = (want.get(key, (seq, 0))[0], v)
    assert got == want
    path = str(tmp_path / "out")
    events.compact_index(spark, path, kept)
    assert sinks.stored(spark, path, kept).count() == len(want)
    more = spark.createDataFrame([("id1", 100, 5, 100), ("new", 101, 6, 101)], "id string, first_seen long, v long, last_seen long")
    sinks.write_batch(more, path, 9)
    want |= {"id1": (want["id1"][0], 5), "new": (101, 6)}
    for _ in range(2):
        assert {r.id: (r.first_seen, r.v) for r in events.current_index(spark, path, kept).collect()} == want
        events.compact_index(spark, path, kept)


def test_split_drops_events_without_kind(spark, tmp_path):
    schema = "seq long, kind string, progress struct<done:long>, row struct<id:string>, complete struct<flagged:long>"
    rows = [(1, "progress", (5,), None, None), (2, "row", None, ("a",), None), (3, None, None, None, None), (4, "complete", None, None, (1,))]
    stream = _parts(spark, rows, schema, tmp_path / "in", 2)
    sinks.finish(events.split(stream, str(tmp_path / "out"), str(tmp_path / "progress")))
    got = {k: spark.read.parquet(str(tmp_path / "out" / k)).drop("batch_id").collect() for k in events.KINDS}
    assert {k: [tuple(r) for r in v] for k, v in got.items()} == {"progress": [(1, 5)], "row": [(2, "a")], "complete": [(4, 1)]}


def test_new_files_only(spark, tmp_path):
    folder = tmp_path / "photos"
    (folder / ".cache").mkdir(parents=True)
    (folder / "_card" / "100").mkdir(parents=True)
    for name in ["a.jpg", "b.txt", ".cache/c.jpg", "_DSC1.jpg", "_card/100/.h.png"]:
        (folder / name).write_bytes(b"123")
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    for extra in [None, "d.PNG", "_card/_e.jpg"]:
        if extra:
            (folder / extra).write_bytes(b"12345")
            # As a copy that keeps the camera's time does.
            os.utime(folder / extra, (10**9, 10**9))
        time.sleep(0.2)
        sinks.finish(sinks.append(ingest.watch_folder(spark, str(folder), settle_ms=50), out, progress))
    got = spark.read.parquet(out).collect()
    names = sorted((r.path.rsplit("/", 1)[1], r.length) for r in got)
    assert names == [(".h.png", 3), ("_DSC1.jpg", 3), ("_e.jpg", 5), ("a.jpg", 3), ("d.PNG", 5)]
    assert sum(r.modified.year == 2001 for r in got) == 2


def test_folder_source_equals_a_plain_walk(spark, tmp_path):
    rng = random.Random(3)
    folders = [tmp_path / "tree" / f for f in ("", "one", "one/two", "one/two/three/four", ".five", "six/_seven")]
    for k, folder in enumerate(folders):
        folder.mkdir(parents=True, exist_ok=True)
        for i in range(rng.randint(0, 400)):
            (folder / f"{'._x'[i % 3]}{k}-{i}").write_bytes(b"x" * (i % 9))
    (tmp_path / "tree" / "loop").symlink_to(tmp_path / "tree")
    spark.dataSource.register(listing.FolderSource)
    want = sorted((os.path.join(at, n), os.path.getsize(os.path.join(at, n))) for at, _, names in os.walk(tmp_path / "tree") for n in names if n != "loop")
    for tasks, page in ((1, 7), (5, 10_000)):
        found = spark.read.format("folder").option("path", str(tmp_path / "tree")).option("tasks", tasks).option("page", page).load().collect()
        assert sorted((r.path, r.length) for r in found) == want and all(r.problem is None for r in found)
    flat = spark.read.format("folder").option("path", str(tmp_path / "tree")).option("recursive", "false").load()
    assert sorted(r.path for r in flat.collect()) == sorted(p for p, _ in want if os.path.dirname(p) == str(tmp_path / "tree"))
    gone = spark.read.format("folder").option("path", str(tmp_path / "none")).load().collect()
    assert [(r.path, r.length, r.problem) for r in gone] == [(str(tmp_path / "none"), None, "No such file or directory")]


def test_folder_of_many_names_comes_in_pages(tmp_path, monkeypatch):
    read, names = [], 25_000

    class Entry:
        def __init__(self, k):
            self.path = f"{tmp_path}/{k}.jpg"
            read.append(k)

        def is_dir(self, follow_symlinks=True):
            return False

        def is_file(self):
            return True

        def stat(self):
            return types.SimpleNamespace(st_ctime_ns=0, st_size=1, st_mtime_ns=0)

    class Folder:
        def __enter__(self):
            return map(Entry, range(names))

        def __exit__(self, *args):
            return False

    monkeypatch.setattr(listing.os, "scandir", lambda folder: Folder())
    pages = listing._pages(str(tmp_path), listing.Share(0, 1), True, 100)
    # The first page is out after its own names have been read, and no page is larger.
    assert next(pages).num_rows == 100 and len(read) == 100
    assert sum(p.num_rows for p in pages) == names - 100


def test_repeats_within_delay(spark, tmp_path):
    rows = [("a", 0), ("a", 60), ("b", 30), ("a", 90), ("b", 10)]
    stream = _parts(spark, rows, "id string, s long", tmp_path / "in", 2).select("id", F.timestamp_seconds("s").alias("at"))
    out = ingest.without_repeats(stream, ["id"], "at", "10 minutes")
    sinks.finish(sinks.append(out, str(tmp_path / "out"), str(tmp_path / "progress")))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_stream_trips_equal_batch(spark, tmp_path):
    rng = random.Random(8)
    rows, clock = [], 0
    for i in range(160):
        clock += rng.choice([0, 1, 1, 2, 30]) * HOUR
        gps = rng.random() < 0.7
        owner = 1 if rng.random() < 0.6 else 2
        rows.append((i, owner, clock, rng.choice([0.0, 20.0]) if gps else None, 0.0 if gps else None))
    # A last photo far ahead closes everything before it.
    rows.append((1000, 3, clock + 900 * HOUR, None, None))
    schema = "image_id long, owner long, taken_unix_ms long, latitude double, longitude double"
    stream = _parts(spark, rows, schema, tmp_path / "in", 3)
    limits = trips.TripThresholds(24, 300)
    photos = str(tmp_path / "photos")
    sinks.finish(stream_trips.store_photos(stream, photos, str(tmp_path / "p1")))
    frame = spark.read.parquet(photos).schema
    sinks.finish(stream_trips.follow(stream, photos, frame, str(tmp_path / "out"), str(tmp_path / "p2"), limits))
    got = sinks.stored(spark, str(tmp_path / "out"), stream_trips.TRIPS).drop("batch_id")
    batch = trips.trip_table(trips.assign_trips(spark.createDataFrame(rows[:-1], schema), limits, ["owner"]), ["owner"])
    want = batch.select(*stream_trips.TRIPS.names)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    whole = trips.trip_table(trips.assign_trips(spark.createDataFrame(rows, schema), limits, ["owner"]), ["owner"])
    closed = stream_trips.close(spark, photos, frame, str(tmp_path / "out"), limits)
    assert sorted(map(tuple, closed.collect()), key=repr) == sorted(map(tuple, whole.select(*stream_trips.TRIPS.names).collect()), key=repr)


def test_late_photos_are_repaired(spark, tmp_path):
    rng = random.Random(11)
    rows, clock = [], 0
    for i in range(200):
        clock += rng.choice([0, 1, 5, 30]) * HOUR
        rows.append((i, 1 if rng.random() < 0.6 else rng.choice([2, 3]), clock, rng.choice([0.0, 20.0]) if rng.random() < 0.7 else None, 0.0))
    rows.append((1000, 4, clock + 900 * HOUR, None, None))
    # All late photos are of two owners; the third one's trips stay as they were stored.
    late = [r for r in rows if r[0] % 9 == 4 and r[1] != 3 and r[0] < 180]
    schema = "image_id long, owner long, taken_unix_ms long, latitude double, longitude double"
    limits = trips.TripThresholds(24, 300)
    photos, out = str(tmp_path / "photos"), str(tmp_path / "out")
    whole = trips.trip_table(trips.assign_trips(spark.createDataFrame(rows, schema), limits, ["owner"]), ["owner"]).select(*stream_trips.TRIPS.names)
    want = sorted(map(tuple, whole.collect()), key=repr)
    for part in ([r for r in rows if r not in late], late):
        spark.createDataFrame(part, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        sinks.finish(stream_trips.store_photos(stream, photos, str(tmp_path / "p1")))
        frame = spark.read.parquet(photos).schema
        sinks.finish(stream_trips.follow(stream, photos, frame, out, str(tmp_path / "p2"), limits))
    assert len(late) > 10
    stale = sinks.stored(spark, out, stream_trips.TRIPS).drop("batch_id").collect()
    closed = stream_trips.close(spark, photos, frame, out, limits)
    assert sorted(map(tuple, closed.collect()), key=repr) == want != sorted(map(tuple, stale), key=repr)
    stream_trips.repair(spark, photos, frame, out, limits)
    fixed = sinks.stored(spark, out, stream_trips.TRIPS).drop("batch_id").collect()
    # The last photo's trip is still open.
    assert sorted(map(tuple, fixed), key=repr) == [w for w in want if w[0] != 4]
    closed = stream_trips.close(spark, photos, frame, out, limits)
    assert sorted(map(tuple, closed.collect()), key=repr) == want
