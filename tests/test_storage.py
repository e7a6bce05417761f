"""Listings of all names, and stored tables that survive a failed writer."""

import pytest
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators import commit
from shoebox.plans import passes
from shoebox.sources import files, tables
from shoebox.streaming import sinks

SCHEMA = "id string, n long, scanned_at long"


@pytest.fixture()
def folder(tmp_path, png):
    root = tmp_path / "photos"
    for name in ("_DSC1.png", "plain.png", ".x.PNG", "_set/_MG_2.png", "_set/plain.png", ".cache/res-768/small.png", "_DSC1.xmp", "other.xmp", "notes.txt"):
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(png([[(9, 9, 9)] * 4] * 3) if name.lower().endswith("png") else b"text")
    (root / "_bad.png").write_bytes(b"no picture")
    return str(root)


def test_every_name_is_listed_and_decoded(spark, folder):
    listed = {r.path[len(folder) + 1 :]: r.length for r in files.list_files(spark, folder).collect()}
    assert set(listed) == {"_DSC1.png", "plain.png", ".x.PNG", "_set/_MG_2.png", "_set/plain.png", ".cache/res-768/small.png", "_DSC1.xmp", "other.xmp", "notes.txt", "_bad.png"}
    assert listed["notes.txt"] == 4
    flat = {r.path[len(folder) + 1 :] for r in files.list_files(spark, folder, recursive=False).collect()}
    assert flat == {n for n in listed if "/" not in n}
    seen = {r.path[len(folder) + 1 :]: (r.width, r.height) for r in files.read_pixels(spark, folder).collect()}
    assert seen == {"_bad.png": (-1, -1), **{n: (4, 3) for n in ("_DSC1.png", "plain.png", ".x.PNG", "_set/_MG_2.png", "_set/plain.png")}}
    assert {r.path[len(folder) + 1 :] for r in files.read_pixels(spark, folder, recursive=False).collect()} == {"_DSC1.png", "plain.png", ".x.PNG", "_bad.png"}


def test_scan_counts_and_sidecars(spark, folder, tmp_path):
    sums = passes.measure(spark, folder)
    found = passes.scan(spark, folder, sums, str(tmp_path / "images"))
    report = found["report"].first()
    assert (report.files_seen, report.images_found, report.images, report.errors) == (10, 6, 5, 1)
    kept = found["images"].select(F.col("absolute_path").alias("path"))
    beside = commit.sidecars(files.list_files(spark, folder), kept).collect()
    assert [paths_of.path.rpartition("/")[2] for paths_of in beside] == ["_DSC1.xmp"]
    assert paths.SIDECAR_EXTENSIONS


def test_a_failed_writer_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    schema = spark.createDataFrame([], SCHEMA).schema
    assert tables.read_table(spark, path, schema).count() == 0
    first = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "id string, n long").withColumn("seq", F.col("n"))
    tables.insert_images(spark, path, first, schema)
    broken = first.withColumn("n", F.when(F.col("id") == "b", F.raise_error(F.lit("stop"))).otherwise(F.col("n")).cast("long"))
    for write in (lambda: tables.save(broken.withColumn("scanned_at", F.lit(0)), path, schema), lambda: tables.open_library(spark, path, broken, schema, force_fresh=True)):
        with pytest.raises(Exception, match="stop"):
            write()
        assert sorted((r.id, r.n) for r in tables.read_table(spark, path, schema).collect()) == [("a", 1), ("b", 2)]
    more = spark.createDataFrame([("b", 9), ("c", 4)], "id string, n long").withColumn("seq", F.col("n"))
    state = tables.open_library(spark, path, more, schema).first()
    assert tuple(state) == (True, 3)
    state = tables.open_library(spark, path, more, schema, force_fresh=True).first()
    assert tuple(state) == (False, 2)
    tables.save(tables.read_table(spark, path, schema).filter("id = 'c'"), path, schema)
    assert [r.id for r in tables.read_table(spark, path, schema).collect()] == ["c"]


def test_part_file_goes_after_a_failed_copy(spark, tmp_path):
    (tmp_path / "in").write_bytes(b"x" * 10)
    target = tmp_path / "out" / "pic.jpg"
    (tmp_path / "out" / "pic.jpg.d").mkdir(parents=True)
    planned = spark.createDataFrame([("pic.jpg", str(tmp_path / "missing"), str(target), 10, "copy", None)], "id string, source string, target string, size_bytes long, status string, error string")
    assert commit.copy_files(planned).first().status == "failed"
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["pic.jpg.d"]


def test_image_of_unknown_size_is_no_unknown_id(spark):
    keep = spark.createDataFrame([("a",), ("b",)], "id string")
    images = spark.createDataFrame([("a", None)], "id string, size_bytes long")
    rows = commit.manifest(keep, images, images.limit(0), "/to").collect()
    assert {r.id: r.status for r in rows} == {"a": "copy", "b": "unknown"}


def test_no_batches_stored(spark, tmp_path):
    assert sinks.stored(spark, str(tmp_path / "none"), spark.createDataFrame([], SCHEMA).schema).count() == 0
