"""The curation passes over a folder of pictures, each from stored table to stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox import schemas
from shoebox.functions import paths
from shoebox.operators import commit, decisions, junk, quality, similar, trips
from shoebox.operators.skew import spread_join
from shoebox.session import cut
from shoebox.sources import files, pictures, storage, tables

# A decoded 12-megapixel picture takes 36 MB; a batch handed to Python holds this many.
PICTURES_PER_BATCH = 4
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def measure(
    spark: SparkSession,
    folder: str,
    extensions: list[str] | None = None,
    cache_marker: str = ".cache",
    working: DataFrame | None = None,
    recursive: bool = True,
) -> DataFrame:
    """Sizes and pixel sums of every picture below ``folder``.

    Pictures are decoded once; the stored sums serve the scan and all later passes. With
    ``working`` (rows of ``pictures.working_images``) the scaled pictures are measured instead.
    """
    if working is not None:
        decoded = working.withColumnRenamed("id", "path")
    else:
        decoded = files.read_pixels(spark, folder, extensions, recursive, cache_marker).filter(
            paths.is_image(F.col("path"), extensions, cache_marker)
        )
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(PICTURES_PER_BATCH))
    try:
        return cut(pictures.picture_sums(decoded, folder), "sums")
    finally:
        spark.conf.set(BATCH_SETTING, before)


def scan(
    spark: SparkSession,
    folder: str,
    sums: DataFrame,
    table_path: str,
    capture: DataFrame | None = None,
    extensions: list[str] | None = None,
    cache_marker: str = ".cache",
    force_fresh: bool = False,
    recursive: bool = True,
) -> dict[str, DataFrame]:
    """Index a folder. Returns ``images`` (stored), ``errors``, ``report`` and ``state``."""
    listing = files.list_files(spark, folder, recursive)
    keyed = listing.withColumn("image_id", paths.relative_id(F.col("path"), folder))
    known = cut(keyed.join(sums.select("image_id", "width", "height"), "image_id", "left"), "listing")
    image_files = known.filter(paths.is_image(F.col("path"), extensions, cache_marker))
    rows = files.image_rows(image_files, folder)
    if capture is not None:
        rows = files.with_capture(rows, capture)
    state = tables.open_library(spark, table_path, rows.withColumn("seq", F.col("id")), schemas.IMAGES, force_fresh)
    return {
        "images": tables.read_table(spark, table_path, schemas.IMAGES),
        "errors": files.scan_errors(image_files, folder),
        "report": files.scan_report(known, extensions, cache_marker),
        "state": state,
    }


def analyze(
    sums: DataFrame,
    limits: quality.QualityThresholds = quality.QualityThresholds(),
    radius: float = similar.DEFAULT_RADIUS,
    weights: similar.ScoreWeights = similar.ScoreWeights(),
) -> dict[str, DataFrame]:
    """Quality and similar passes: ``judged``, ``flags``, ``groups`` and ranked ``members``."""
    judged = cut(quality.verdicts(pictures.metrics(sums, limits), limits), "judged")
    assigned = similar.assign_leaders(pictures.feature_rows(sums), radius)
    found = cut(similar.groups(assigned), "groups")
    rated = judged.select("image_id", "sharpness").join(pictures.contrast(sums), "image_id")
    scored = similar.score(similar.members(assigned, found), rated, weights)
    ranked = similar.best_first(scored)
    return {"judged": judged, "flags": quality.flags(judged), "groups": found, "members": ranked}


RESULTS = {
    "quality_flags": schemas.QUALITY_FLAGS,
    "similar_groups": schemas.GROUP_MEMBERS,
    "trips": schemas.TRIPS,
    "user_decisions": schemas.USER_DECISIONS,
    "user_group_keepers": schemas.USER_GROUP_KEEPERS,
    "session_state": schemas.SESSION_STATE,
}


def save_results(base: str, **results: DataFrame) -> None:
    """Store pass results and user choices by table name, to resume a session from."""
    for name, rows in results.items():
        tables.save(rows, f"{base}/{name}", RESULTS[name])


def load_results(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Everything stored so far; a pass that has not run yet gives an empty table."""
    return {name: tables.read_table(spark, f"{base}/{name}", schema) for name, schema in RESULTS.items()}


def resolve(
    images: DataFrame, log: DataFrame, quality_flags: DataFrame, junk_flags: DataFrame, members: DataFrame
) -> DataFrame:
    """Which images go: ``image_id, size_bytes, deleted``.

    ``members`` are ranked group members; ``log`` is the action log.
    """
    live = decisions.settled_log(log)
    # A group may hold a third of the library.
    with_best = spread_join(members, similar.keepers(members), ["group_id"], ["image_id"], "inner")
    keepers = decisions.keeper_map(with_best, decisions.fold_keepers(live))
    rows = images.select(F.col("id").alias("image_id"), "size_bytes")
    return decisions.final_decisions(rows, decisions.fold(live), quality_flags, junk_flags, keepers)


def copy_kept(spark: SparkSession, resolved: DataFrame, images: DataFrame, folder: str, destination: str) -> DataFrame:
    """Copy kept images and their sidecars to ``destination``; one stored result row per file."""
    kept = images.join(resolved.filter(~F.col("deleted")).select(F.col("image_id").alias("id")), "id", "left_semi")
    beside = commit.sidecars(files.list_files(spark, folder), kept.select(F.col("absolute_path").alias("path")))
    side_rows = beside.select(
        paths.relative_id(F.col("path"), folder).alias("id"),
        F.col("length").alias("size_bytes"),
        F.col("path").alias("source"),
    )
    wanted = kept.select("id", "size_bytes", F.col("absolute_path").alias("source")).unionByName(side_rows)
    planned = commit.manifest(wanted, wanted, destination_listing(spark, destination), destination)
    return cut(commit.copy_files(planned.join(wanted.select("id", "source"), "id", "left")), "copied")


def destination_listing(spark: SparkSession, destination: str) -> DataFrame:
    """``id, size_bytes`` of the destination, which is created when missing."""
    if not storage.exists(spark, destination):
        storage.make_folder(spark, destination)
        return spark.createDataFrame([], "id string, size_bytes long")
    return files.list_files(spark, destination).select(
        paths.relative_id(F.col("path"), destination).alias("id"), F.col("length").alias("size_bytes")
    )


def trip_pass(images: DataFrame, limits: trips.TripThresholds = trips.TripThresholds()) -> dict[str, DataFrame]:
    """Trips of one library: ``members``, ``trips`` and ``summary``."""
    rows = images.withColumnRenamed("id", "image_id")
    members = cut(trips.assign_trips(rows, limits), "trips")
    found = trips.trip_table(members)
    return {"members": members, "trips": found, "summary": trips.trip_summary(rows, found)}


def junk_pass(images: DataFrame, model, table_path: str, load: bool = False) -> DataFrame:
    """Judge images without a stored verdict and store the verdicts; returns all stored ones."""
    spark = images.sparkSession
    before = tables.read_table(spark, table_path, schemas.JUNK_FLAGS)
    fresh = cut(junk.classify_with(junk.unjudged(images, before), model, load), "verdicts")
    junk.store(fresh, table_path)
    return tables.read_table(spark, table_path, schemas.JUNK_FLAGS)


def screenshot_pass(sums: DataFrame, rules: junk.JunkRules = junk.JunkRules()) -> DataFrame:
    """Judge measured pictures by simple rules, without a model: ``image_id, is_junk, reason, confidence``."""
    return junk.classify(pictures.junk_features(sums), rules)
