"""Edge cases of the pixel sums, path rules and stored tables."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.functions.geo import haversine_km
from shoebox.operators import features, junk, quality
from shoebox.sources import files, pictures, tables

IMAGE = "image_id string, height int, width int, gray array<int>"


def _judge(spark, rows, limits=quality.QualityThresholds()):
    sums = pictures.picture_sums(pictures.from_planes(spark.createDataFrame(rows, IMAGE)))
    out = quality.verdicts(pictures.metrics(sums, limits), limits)
    return {r.image_id: r for r in out.collect()}


def test_uniform_thin_and_unreadable_images(spark):
    got = _judge(
        spark,
        [
            ("black", 6, 6, [0] * 36),
            ("white", 6, 6, [255] * 36),
            ("gray", 6, 6, [128] * 36),
            ("thin", 4, 2, [0, 255] * 4),
            ("none", -1, -1, None),
            ("edge", 3, 3, [15, 240] * 4 + [15]),
        ],
    )
    assert got["black"].reasons == ["BLURRY", "UNDER_EXPOSED"] and got["black"].exposure_score == 0.0
    assert got["white"].reasons == ["BLURRY", "OVER_EXPOSED"] and got["white"].exposure_score == 1.0
    assert got["gray"].reasons == ["BLURRY"] and got["gray"].good_cells == 9 and got["gray"].exposure_score == 0.5
    assert got["thin"].good_cells == 0 and got["thin"].reasons == ["UNDER_EXPOSED", "OVER_EXPOSED"]
    assert got["none"].reasons == ["UNREADABLE"] and got["none"].low_quality and got["none"].exposure_score is None
    # Weights are zero at the limits themselves.
    assert (got["edge"].under, got["edge"].over) == (0.0, 0.0)


def test_limits_are_strict(spark):
    rows = [("a", 6, 6, [0, 255] * 18)]
    sharp = _judge(spark, rows)["a"].sharpness
    at = quality.QualityThresholds(blur_threshold=sharp, underexposed_threshold=0.5, overexposed_threshold=0.5)
    assert _judge(spark, rows, at)["a"].reasons == []


def test_unknown_reason_is_an_error(spark):
    rows = spark.createDataFrame([(["BLURRY", "OVER_EXPOSED"],)], "r array<string>")
    assert rows.select(quality.reason_labels(F.col("r"))).first()[0] == ["Blurry", "Overexposed"]
    with pytest.raises(PySparkException, match="no label for this reason: NOISY"):
        spark.createDataFrame([(["NOISY"],)], "r array<string>").select(quality.reason_labels(F.col("r"))).collect()


def test_flat_image_is_junk_and_noise_is_not(spark):
    noise = [(i * 97 + (i * i) % 31) % 251 for i in range(64)]
    bars = ([0] * 8 + [255] * 8) * 4
    rows = [("bars", 8, 8, bars), ("noise", 8, 8, noise), ("dot", 1, 1, [5]), ("none", -1, -1, None)]
    measured = pictures.junk_features(pictures.picture_sums(pictures.from_planes(spark.createDataFrame(rows, IMAGE))))
    got = {r.image_id: r for r in junk.classify(measured).collect()}
    assert set(got) == {"bars", "noise", "dot"}
    assert (got["bars"].is_junk, got["bars"].reason) == (1, "screenshot")
    assert (got["noise"].is_junk, got["noise"].reason) == (0, None)
    assert tuple(junk.summary(junk.classify(measured)).first())[1] == 3


def test_hue_and_saturation(spark):
    rows = [(255, 0, 0), (0, 255, 0), (0, 0, 255), (0, 0, 0), (80, 80, 80), (255, 0, 1), (200, 100, 50)]
    df = spark.createDataFrame(rows, "r int, g int, b int")
    hue, saturation = features.hue_saturation(F.col("r"), F.col("g"), F.col("b"))
    got = [tuple(r) for r in df.select(hue, saturation).collect()]
    assert got == [(0, 255), (60, 255), (120, 255), (0, 0), (0, 0), (0, 255), (10, 191)]


def test_full_histogram_is_scaled_from_its_least_count(spark):
    rows = [
        ("steps", list(range(features.BINS)), [i % 3 + 1 for i in range(features.BINS)], 1, 3),
        ("even", list(range(features.BINS)), [2] * features.BINS, 2, 2),
        ("gaps", [1, features.BINS - 2], [5, 10], 5, 10),
    ]
    df = spark.createDataFrame(rows, "id string, bins array<int>, counts array<long>, least long, most long")
    scaled = features.scaled_histogram(F.col("bins"), F.col("counts"), F.col("least"), F.col("most"))
    got = {r.id: r.h for r in df.select("id", scaled.alias("h")).collect()}
    assert got["steps"] == [0.0, 0.5, 1.0] * (features.BINS // 3)
    assert got["even"] == [0.0] * features.BINS
    assert got["gaps"] == [0.0, 0.5] + [0.0] * (features.BINS - 4) + [1.0, 0.0]


def test_hash_uses_all_64_bits(spark):
    levels = F.array(*[F.lit(9 - i % 9) for i in range(72)])
    assert spark.range(1).select(features.dhash_bits(levels)).first()[0] == -1
    a, b = F.lit(-1).cast("long"), F.lit(0).cast("long")
    assert spark.range(1).select(features.hamming(a, b)).first()[0] == 64


def test_invalid_images_are_far(spark):
    row = spark.range(1).select(features.joint_distance(F.lit(1.0), F.lit(0), F.lit(False))).first()
    assert row[0] == features.FAR


@pytest.mark.parametrize(
    "path,name,ext,stem,image",
    [
        ("/p/a.b.JPG", "a.b.JPG", ".JPG", "a.b", True),
        ("/p/.jpg", ".jpg", "", ".jpg", False),
        ("/p/x", "x", "", "x", False),
        ("/p/x.", "x.", ".", "x", False),
        ("/p/.cache/x.jpg", "x.jpg", ".jpg", "x", False),
        ("/p/x.heic", "x.heic", ".heic", "x", True),
        ("/p/x.txt", "x.txt", ".txt", "x", False),
    ],
)
def test_path_rules(spark, path, name, ext, stem, image):
    p = F.lit(path)
    row = spark.range(1).select(paths.file_name(p), paths.extension(p), paths.stem(p), paths.is_image(p)).first()
    assert tuple(row) == (name, ext, stem, image)


def test_working_size_never_enlarges(spark):
    rows = spark.createDataFrame([("a", 4032, 3024), ("b", 768, 10), ("c", 100, 3000), ("d", 769, 768)], "id string, original_width int, original_height int")
    got = {r.id: (r.width, r.height) for r in files.working_sizes(rows).collect()}
    assert got == {"a": (768, 576), "b": (768, 10), "c": (25, 768), "d": (768, 767)}


def test_distance_without_position_is_null(spark):
    cols = [F.lit(48.85), F.lit(2.35), F.lit(None).cast("double"), F.lit(0.0)]
    assert spark.range(1).select(haversine_km(*cols)).first()[0] is None
    quarter = haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))
    assert spark.range(1).select(quarter).first()[0] == pytest.approx(6371.0 * 3.141592653589793 / 2)


def test_insert_keeps_first_row_and_known_ids(spark):
    known = spark.createDataFrame([("a", "old")], "id string, v string")
    batch = spark.createDataFrame([("a", "x", 1), ("b", "second", 3), ("b", "first", 2)], "id string, v string, seq long")
    assert [(r.id, r.v) for r in tables.new_rows(known, batch).collect()] == [("b", "first")]


def test_only_the_sums_asked_for(spark):
    rows = [("a", 7, 5, [(i * 37) % 256 for i in range(35)]), ("none", -1, -1, None), ("empty", 2, 2, [])]
    planes = pictures.from_planes(spark.createDataFrame(rows, IMAGE))
    every = {r.image_id: r.asDict() for r in pictures.picture_sums(planes).collect()}
    for wanted in (pictures.QUALITY_SUMS, pictures.CONTRAST_SUMS, pictures.FEATURE_SUMS, pictures.COLOUR_SUMS, pictures.JUNK_SUMS):
        some = pictures.picture_sums(planes, wanted=wanted)
        assert set(some.columns) == {"image_id", "height", "width", *wanted}
        for r in some.collect():
            assert all(every[r.image_id][name] == value for name, value in r.asDict().items())
    assert every["none"]["levels"] is None and every["empty"]["counts"] is None and sum(every["a"]["levels"][:256]) == 35
    with pytest.raises(ValueError, match="no such sums"):
        pictures.picture_sums(planes, wanted=["colour"])
