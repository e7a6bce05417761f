"""The folder passes on hand-made pictures, and the two pixel paths against each other."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.operators import commit, quality, similar
from shoebox.plans import passes
from shoebox.sources import files, pictures, tables
from tests import pixel_rows

SIZES = {"a/one": (17, 12), "a/two": (17, 12), "b/flat": (9, 8), "b/dark": (30, 20), "c/thin": (2, 14), "c/dot": (1, 1), "c/big": (40, 31)}


def _picture(name, size):
    rng = random.Random("one" if name in ("a/one", "a/two") else name)
    w, h = size
    if name == "b/flat":
        return [[(200, 200, 200)] * w for _ in range(h)]
    top = 12 if name == "b/dark" else 255
    return [[tuple(rng.randint(0, top) for _ in range(3)) for _ in range(w)] for _ in range(h)]


@pytest.fixture(scope="module")
def library(tmp_path_factory, png):
    root = tmp_path_factory.mktemp("library")
    for name, size in SIZES.items():
        path = root / f"{name}.PNG" if name == "c/big" else root / f"{name}.png"
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(png(_picture(name, size)))
    (root / "a" / "broken.jpg").write_bytes(b"no picture")
    (root / "a" / "one.xmp").write_text("sidecar of one")
    (root / "a" / "other.xmp").write_text("sidecar of nothing")
    (root / "notes.txt").write_text("text")
    (root / ".jpg").write_text("hidden name, no extension")
    (root / ".cache").mkdir()
    (root / ".cache" / "old.png").write_bytes(png(_picture("b/flat", (9, 8))))
    return str(root)


@pytest.fixture(scope="module")
def sums(spark, library):
    return passes.measure(spark, library)


def test_scan_indexes_splits_errors_and_resumes(spark, library, sums, tmp_path):
    capture = spark.createDataFrame([("a/one.png", 1000, 48.85, 2.35)], "id string, taken_unix_ms long, latitude double, longitude double")
    table = str(tmp_path / "images")
    out = passes.scan(spark, library, sums, table, capture)
    rows = {r.id: r for r in out["images"].collect()}
    assert set(rows) == {"a/one.png", "a/two.png", "b/flat.png", "b/dark.png", "c/thin.png", "c/dot.png", "c/big.PNG"}
    one = rows["a/one.png"]
    assert (one.original_width, one.original_height, one.file_name) == (17, 12, "one.png")
    assert one.size_bytes > 0 and one.scanned_at > 1_600_000_000
    assert one.working_image_path.endswith(f"/.cache/res-768/one_{one.size_bytes}.jpg")
    assert (one.taken_unix_ms, one.latitude) == (1000, 48.85) and rows["a/two.png"].taken_unix_ms is None
    assert [r.error for r in out["errors"].collect()] == ["a/broken.jpg: File corrupt or encoding format unsupported."]
    report = out["report"].first()
    assert (report.images_found, report.images, report.errors) == (8, 7, 1)
    assert report.files_seen - report.skipped_files == 8
    assert out["state"].first().resumed_session is False
    again = passes.scan(spark, library, sums, table)["state"].first()
    assert (again.resumed_session, again.images) == (True, 7)
    fresh = passes.scan(spark, library, sums, table, force_fresh=True)["state"].first()
    assert (fresh.resumed_session, fresh.images) == (False, 7)


def _row_wise(spark):
    rows = []
    for name, size in SIZES.items():
        px = [p for row in _picture(name, size) for p in row]
        ext = ".PNG" if name == "c/big" else ".png"
        rows.append((name + ext, size[1], size[0], *[[p[i] for p in px] for i in range(3)]))
    return spark.createDataFrame(rows, "image_id string, height int, width int, r array<int>, g array<int>, b array<int>")


def _by_id(df):
    return {r.image_id: r.asDict() for r in df.collect()}


def test_both_pixel_paths_agree(spark, sums):
    colour = _row_wise(spark)
    gray = quality.gray_images(colour)
    slow, fast = _by_id(pixel_rows.metrics(gray)), _by_id(pictures.metrics(sums).filter("valid"))
    assert set(slow) == set(fast)
    for key, row in slow.items():
        for name, value in row.items():
            assert fast[key][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (key, name)
    slow, fast = _by_id(pixel_rows.contrast(gray)), _by_id(pictures.contrast(sums))
    assert {k: pytest.approx(v["contrast"], abs=1e-9) for k, v in slow.items()} == {k: v["contrast"] for k, v in fast.items()}
    slow, fast = _by_id(pixel_rows.junk_features(gray)), _by_id(pictures.junk_features(sums))
    assert slow == {k: pytest.approx(v) for k, v in fast.items()}
    slow, fast = _by_id(pixel_rows.features(colour, gray)), _by_id(pictures.feature_rows(sums).filter("valid"))
    assert set(slow) == set(fast)
    for key in slow:
        assert slow[key]["dhash"] == fast[key]["dhash"]
        assert slow[key]["histogram"] == pytest.approx(fast[key]["histogram"])


def test_screenshot_rules_judge_decoded_pictures(spark, sums):
    judged = {r.image_id: r.is_junk for r in passes.screenshot_pass(sums).collect()}
    assert judged["b/flat.png"] == 1 and judged["a/one.png"] == 0 and "a/broken.jpg" not in judged


def test_unreadable_picture_is_low_quality_and_not_grouped(spark, sums):
    out = passes.analyze(sums)
    judged = _by_id(out["judged"])
    assert judged["a/broken.jpg"]["reasons"] == ["UNREADABLE"] and judged["a/broken.jpg"]["low_quality"]
    assert "UNDER_EXPOSED" not in judged["b/flat.png"]["reasons"] and "BLURRY" in judged["b/flat.png"]["reasons"]
    members = out["members"].collect()
    assert "a/broken.jpg" not in {m.image_id for m in members}
    pair = [(m.rank, m.image_id, m.is_keeper) for m in members if m.image_id.startswith("a/")]
    assert sorted(pair) == [(1, "a/one.png", True), (2, "a/two.png", False)]


def test_results_are_stored_and_resumed(spark, tmp_path):
    standing = spark.createDataFrame([("a", "EXPLICIT_KEEP", 4)], "image_id string, decision string, updated_at long")
    passes.save_results(str(tmp_path), user_decisions=standing)
    again = standing.unionByName(passes.load_results(spark, str(tmp_path))["user_decisions"]).limit(1)
    passes.save_results(str(tmp_path), user_decisions=again)
    stored = passes.load_results(spark, str(tmp_path))
    assert [tuple(r) for r in stored["user_decisions"].collect()] == [("a", "EXPLICIT_KEEP", 4)]
    assert stored["trips"].columns == schemas.TRIPS.names and stored["trips"].isEmpty()


def test_commit_copies_once_and_reports_conflicts(spark, library, sums, tmp_path):
    images = passes.scan(spark, library, sums, str(tmp_path / "images"))["images"]
    analysis = passes.analyze(sums)
    log = spark.createDataFrame(
        [(1, "keep_all", ["b/flat.png", "a/one.png", "c/big.PNG"], None, None), (2, "mark", ["c/big.PNG"], None, None)],
        "seq long, action string, image_ids array<string>, group_id long, keeper_id string",
    )
    none = spark.createDataFrame([], "image_id string")
    resolved = passes.resolve(images, log, analysis["flags"], none, analysis["members"])
    kept = {r.image_id for r in resolved.filter(~F.col("deleted")).collect()}
    assert {"a/one.png", "b/flat.png"} <= kept and "c/big.PNG" not in kept and "a/two.png" not in kept
    dest = tmp_path / "dest"
    (dest / "b").mkdir(parents=True)
    (dest / "b" / "flat.png").write_bytes(b"something else")
    result = {r.id: (r.status, r.error) for r in passes.copy_kept(spark, resolved, images, library, str(dest)).collect()}
    assert result["a/one.png"] == ("copied", None) and result["a/one.xmp"] == ("copied", None)
    assert result["b/flat.png"] == ("conflict", "b/flat.png: name conflict")
    assert "a/other.xmp" not in result and (dest / "b" / "flat.png").read_bytes() == b"something else"
    with open(f"{library}/a/one.png", "rb") as source:
        assert (dest / "a" / "one.png").read_bytes() == source.read()
    again = passes.copy_kept(spark, resolved, images, library, str(dest))
    assert {r.id: r.status for r in again.collect()}["a/one.png"] == "present"
    totals = commit.summary(again).first()
    assert totals.skipped == 1 and totals.copied == len(result) - 1


def test_copy_failure_is_a_row(spark, tmp_path):
    planned = spark.createDataFrame(
        [("gone.jpg", "/nowhere/gone.jpg", str(tmp_path / "gone.jpg"), 5, "copy", None)],
        "id string, source string, target string, size_bytes long, status string, error string",
    )
    row = commit.copy_files(planned).first()
    assert row.status == "failed" and row.error.startswith("gone.jpg: ")


def test_working_images(spark, library):
    decoded = files.read_pixels(spark, library, [".png"])
    small = {r.id: r for r in pictures.working_images(decoded, library, edge=10).collect()}
    assert (small["a/one.png"].width, small["a/one.png"].height) == (10, 7)
    assert (small["c/dot.png"].width, small["c/thin.png"].height) == (1, 10)
    flat = small["b/flat.png"]
    assert (flat.width, flat.height) == (9, 8) and set(flat.data) == {200}
    sums = passes.measure(spark, library, working=pictures.working_images(decoded, library))
    full = {r.image_id: r.sharpness for r in pictures.metrics(passes.measure(spark, library, [".png"])).collect()}
    assert {r.image_id: r.sharpness for r in pictures.metrics(sums).collect() if r.image_id in full} == full
    wanted = files.pending(decoded.select(F.lit("a/one.png").alias("id")), spark.createDataFrame([("a/one.png",)], "id string"))
    assert wanted.isEmpty()


def test_model_pass_is_incremental(spark, tmp_path):
    images = spark.createDataFrame([("x", 1), ("y", 2)], "image_id string, n int")
    seen = spark.sparkContext.accumulator(0)

    def load():
        import pandas as pd

        def judge(batch):
            seen.add(len(batch))
            return pd.DataFrame({"is_junk": (batch["n"] > 1).astype(int), "reason": "scan", "confidence": 0.5})

        return judge

    table = str(tmp_path / "junk")
    stored = passes.junk_pass(images, load, table, load=True)
    assert {(r.image_id, r.is_junk) for r in stored.collect()} == {("x", 0), ("y", 1)}
    more = images.unionByName(spark.createDataFrame([("z", 3)], "image_id string, n int"))
    stored = passes.junk_pass(more, load, table, load=True)
    assert stored.count() == 3 and seen.value == 3
    rules = tables.Rules("junk_flags", "image_id", ["confidence"], {"is_junk": [0, 1]})
    assert tables.violations(stored, rules).isEmpty()
    assert stored.schema.names == schemas.JUNK_FLAGS.names


def test_trip_pass_without_owner(spark):
    rows = [("a", 0, 48.85, 2.35, 1), ("b", 48 * 3_600_000, None, None, 1), ("c", 96 * 3_600_000 + 1, 48.9, 2.3, 1), ("d", None, None, None, 1)]
    images = spark.createDataFrame(rows, "id string, taken_unix_ms long, latitude double, longitude double, size_bytes long")
    out = passes.trip_pass(images)
    got = {r.trip_id: r for r in out["trips"].collect()}
    assert (got[1].photos, got[1].centroid_lat, got[2].photos) == (2, 48.85, 1)
    assert tuple(out["summary"].first()) == (2, 1)


def test_member_arrays_are_whole(spark):
    rows = spark.createDataFrame([(1, i + 1, i, 1.0 / (i + 1)) for i in range(25)], "group_id long, rank long, image_id long, score double")
    packed = similar.member_arrays(rows, chunk=10).orderBy("chunk_no").collect()
    assert [len(r.image_ids) for r in packed] == [10, 10, 5]
    assert [x for r in packed for x in r.image_ids] == list(range(25))


def test_bands_do_not_change_sums(monkeypatch):
    import numpy as np

    from shoebox.functions import kernels

    rng = np.random.default_rng(3)
    whole, parts = [], []
    for size in ((37, 23, 3), (5, 1, 3), (1, 9, 1), (64, 64, 4)):
        pixels = rng.integers(0, 256, size).astype(np.uint8) // 64 * 64
        for band, out in ((1 << 18, whole), (50, parts)):
            monkeypatch.setattr(kernels, "BAND", band)
            gray = kernels.gray_of(pixels)
            out.append(
                [gray, kernels.laplacian_sums(gray), kernels.level_counts(gray), kernels.shrunken(gray), *kernels.colour_bins(pixels),
                 kernels.flat_blocks(gray, 2), kernels.straight_lines(gray, 32, 0.5), kernels.bilinear(pixels, 7, 5)]
            )
    for a, b in zip(whole, parts):
        for x, y in zip(a, b):
            np.testing.assert_array_equal(x, y)


def test_twelve_megapixels_stay_small():
    import tracemalloc

    import numpy as np

    from shoebox.functions import kernels

    pixels = np.random.default_rng(0).integers(0, 256, (3000, 4000, 3)).astype(np.uint8)
    tracemalloc.start()
    gray = kernels.gray_of(pixels)
    for kernel in (kernels.laplacian_sums, kernels.level_counts, kernels.shrunken, lambda g: kernels.flat_blocks(g, 2), lambda g: kernels.straight_lines(g, 32, 0.75)):
        kernel(gray)
    kernels.colour_bins(pixels)
    assert tracemalloc.get_traced_memory()[1] < 100_000_000
    tracemalloc.stop()


def test_sums_are_made_of_few_rows_at_a_time(spark):
    batches = [pa.RecordBatch.from_pydict({"i": list(range(s, e))}) for s, e in ((0, 1000), (1000, 1000), (1000, 1003))]
    parts = [b.column("i").to_pylist() for b in pictures._few(batches)]
    assert sum(parts, []) == list(range(1003)) and max(map(len, parts)) <= pictures.SUMS_HELD < 1000
    rows = spark.range(600, numPartitions=1).selectExpr("id AS image_id", "2 AS height", "2 AS width", "array(int(id % 256), 0, 0, 0) AS gray")
    sums = pictures.picture_sums(pictures.from_planes(rows), wanted=["levels"])
    found = {int(r.image_id): r.n for r in sums.selectExpr("image_id", "levels[int(image_id) % 256] AS n").collect()}
    assert found == {i: 4 if i % 256 == 0 else 1 for i in range(600)}
