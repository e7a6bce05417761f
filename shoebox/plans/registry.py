"""Registered queries over the given tables, one per operator or report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoebox.operators import trips
from shoebox.sources import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _owner_trips(spark: SparkSession, sf_dir: str, limits=trips.TripThresholds()) -> DataFrame:
    return trips.assign_trips(fixtures.photos(spark, sf_dir), limits, by=["owner"])


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query
def trip_list(spark, sf_dir):
    table = trips.trip_table(_owner_trips(spark, sf_dir), ["owner"])
    return _rounded(table, "centroid_lat", "centroid_lon")


@query
def trip_photos(spark, sf_dir):
    return _owner_trips(spark, sf_dir).select("owner", "trip_id", "pos", "image_id")


@query
def trip_id_arrays(spark, sf_dir):
    members = trips.trip_members(_owner_trips(spark, sf_dir), ["owner"], chunk=100)
    return members.select("owner", "trip_id", "chunk_no", F.array_join(F.col("image_ids").cast("array<string>"), ",").alias("image_ids"))


@query
def trip_summary(spark, sf_dir):
    found = trips.trip_table(_owner_trips(spark, sf_dir), ["owner"])
    return trips.trip_summary(fixtures.photos(spark, sf_dir), found)


@query
def trips_one_library(spark, sf_dir):
    limits = trips.TripThresholds(max_gap_hours=1, max_distance_km=1000)
    # Split into blocks even where the table is small.
    members = trips.assign_trips(fixtures.photos(spark, sf_dir), limits, blocks=16)
    return _rounded(trips.trip_table(members), "centroid_lat", "centroid_lon")


SWEEP = [trips.TripThresholds(g, d) for g in (12, 24, 48, 168) for d in (10, 300, 1000)]


@query
def trip_sweep(spark, sf_dir):
    return trips.sweep(fixtures.photos(spark, sf_dir), SWEEP, by=["owner"])


@query
def photo_steps(spark, sf_dir):
    return _rounded(trips.with_steps(fixtures.photos(spark, sf_dir), ["owner"]).select("image_id", "gap_ms", "km"), "km")


from shoebox.operators import dbscan  # noqa: E402


@query
def density_clusters(spark, sf_dir):
    return dbscan.cluster(fixtures.photos(spark, sf_dir), dbscan.Density(3 * trips.HOUR_MS, 50.0, 4))


# --- decisions -------------------------------------------------------------

from shoebox.operators import commit, decisions  # noqa: E402


def _library(spark: SparkSession, sf_dir: str):
    """Images that are members of a group, with decisions, flags and keepers."""
    log = fixtures.actions(spark, sf_dir)
    members = fixtures.groups(spark, sf_dir)
    log = decisions.settled_log(log)
    standing = decisions.fold(log)
    keepers = decisions.keeper_map(members, decisions.fold_keepers(log))
    quality, junk = fixtures.flagged(spark, sf_dir)
    return members, standing, keepers, quality, junk


@query
def user_decisions(spark, sf_dir):
    return decisions.fold(decisions.after_reset(fixtures.actions(spark, sf_dir)))


@query
def group_keepers(spark, sf_dir):
    return decisions.fold_keepers(decisions.after_reset(fixtures.actions(spark, sf_dir)))


@query
def saved_decisions(spark, sf_dir):
    log = decisions.settled_log(fixtures.actions(spark, sf_dir))
    return decisions.saved_decisions(decisions.fold(log), decisions.fold_keepers(log))


@query
def keeper_map(spark, sf_dir):
    log = decisions.after_reset(fixtures.actions(spark, sf_dir))
    return decisions.keeper_map(fixtures.groups(spark, sf_dir), decisions.fold_keepers(log))


@query
def marked_by_step(spark, sf_dir):
    members, standing, keepers, quality, junk = _library(spark, sf_dir)
    images = members.select("image_id")
    steps = {"quality": {"flagged": quality}, "junk": {"flagged": junk}, "similar": {"keepers": keepers}, None: {}}
    parts = [
        decisions.marked_for_deletion(images, standing, step, **extra).withColumn("step", F.lit(step or "none"))
        for step, extra in steps.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query
def marked_similar(spark, sf_dir):
    members, standing, keepers, _, _ = _library(spark, sf_dir)
    return decisions.similar_marked_count(members, standing, keepers)


@query
def final_keep(spark, sf_dir):
    members, standing, keepers, quality, junk = _library(spark, sf_dir)
    return decisions.final_decisions(members.select("image_id"), standing, quality, junk, keepers)


@query
def keep_summary(spark, sf_dir):
    members, standing, keepers, quality, junk = _library(spark, sf_dir)
    images = members.select("image_id", (F.col("image_id") * 1000 + 7).alias("size_bytes"))
    return decisions.keep_summary(decisions.final_decisions(images, standing, quality, junk, keepers))


# --- commit ------------------------------------------------------------------


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commit.manifest(
        fixtures.keep_ids(spark, sf_dir), fixtures.library_images(spark, sf_dir), fixtures.destination(spark, sf_dir), "/out"
    )


@query
def commit_manifest(spark, sf_dir):
    return _manifest(spark, sf_dir)


@query
def commit_progress(spark, sf_dir):
    done = commit.progress(_manifest(spark, sf_dir))
    return _rounded(done, "fraction")


@query
def commit_summary(spark, sf_dir):
    return commit.summary(_manifest(spark, sf_dir))


@query
def commit_errors(spark, sf_dir):
    return commit.errors(_manifest(spark, sf_dir))


# --- scan ----------------------------------------------------------------------

from shoebox.functions import paths  # noqa: E402
from shoebox.sources import files, tables  # noqa: E402

# The listing holds gif files, which the shipped scanner does not accept.
FORMATS = [*paths.BASIC_EXTENSIONS, ".gif"]


def _image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image files of the listing; every 13th size stands for a file that cannot be decoded."""
    listing = fixtures.files(spark, sf_dir).filter(paths.is_image(F.col("path"), FORMATS))
    return listing.withColumn("height", F.when(F.col("length") % 13 == 0, -1).otherwise(F.col("height")))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.image_rows(_image_files(spark, sf_dir), fixtures.LIBRARY_ROOT)


@query
def sidecars(spark, sf_dir):
    listing = fixtures.files(spark, sf_dir)
    kept = listing.filter(paths.is_image(F.col("path"), [".jpg", ".jpeg"]))
    return commit.sidecars(listing, kept).select("path")


@query
def image_filter(spark, sf_dir):
    return fixtures.files(spark, sf_dir).filter(paths.is_image(F.col("path"), FORMATS)).select("path")


@query
def path_parts(spark, sf_dir):
    path = F.col("path")
    return fixtures.files(spark, sf_dir).select(
        "path",
        paths.file_name(path).alias("file_name"),
        paths.stem(path).alias("stem"),
        paths.extension(path).alias("extension"),
        paths.folder(path).alias("folder"),
    )


@query
def image_meta(spark, sf_dir):
    return _images(spark, sf_dir)


@query
def images_with_capture(spark, sf_dir):
    taken = fixtures.photos(spark, sf_dir).select(
        F.concat(
            F.lit("d"), (F.floor(F.col("image_id") / 8) % 10).cast("string"), F.lit("/img_"), F.col("image_id").cast("string"), F.lit(".jpg")
        ).alias("id"),
        "taken_unix_ms",
        "latitude",
        "longitude",
    )
    out = files.with_capture(_images(spark, sf_dir), taken)
    return _rounded(out.select("id", "taken_unix_ms", "latitude", "longitude"), "latitude", "longitude")


@query
def scan_errors(spark, sf_dir):
    return files.scan_errors(_image_files(spark, sf_dir), fixtures.LIBRARY_ROOT)


@query
def scan_summary(spark, sf_dir):
    listing = fixtures.files(spark, sf_dir)
    decoded = listing.withColumn("height", F.when(F.col("length") % 13 == 0, -1).otherwise(F.col("height")))
    return files.scan_report(decoded, FORMATS)


@query
def working_geometry(spark, sf_dir):
    return files.working_sizes(_images(spark, sf_dir))


@query
def working_name_collisions(spark, sf_dir):
    # Sizes of this listing repeat, so stems alone decide.
    return files.working_name_collisions(fixtures.files(spark, sf_dir).withColumn("length", F.col("length") % 2))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier scan that took png files only."""
    return files.image_rows(_image_files(spark, sf_dir).filter(paths.is_image(F.col("path"), [".png"])), fixtures.LIBRARY_ROOT)


@query
def pending_images(spark, sf_dir):
    return files.pending(_images(spark, sf_dir), _known(spark, sf_dir)).select("id")


@query
def insert_new(spark, sf_dir):
    rows = _images(spark, sf_dir).select("id", "absolute_path", F.col("size_bytes").alias("seq"))
    again = rows.withColumns({"absolute_path": F.concat(F.lit("/copy"), "absolute_path"), "seq": 200_000 - F.col("seq")})
    return tables.new_rows(_known(spark, sf_dir), rows.unionByName(again))


@query
def stored_paths(spark, sf_dir):
    stored = _images(spark, sf_dir).withColumn(
        "working_image_path", F.when(F.col("size_bytes") % 5 != 0, F.col("working_image_path"))
    )
    working = tables.working_paths(stored).select(F.lit("working").alias("kind"), F.col("working_image_path").alias("path"))
    return working.unionByName(
        tables.original_paths(stored).select(F.lit("original").alias("kind"), F.col("absolute_path").alias("path"))
    )


def _verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored junk verdicts, some of them broken on purpose."""
    eid = F.col("event_id")
    return fixtures.table(spark, sf_dir, "events").select(
        F.floor(eid / 2 * F.when(eid % 50 == 0, 1).otherwise(2)).cast("long").alias("image_id"),
        F.when(eid % 40 == 0, 2).otherwise((eid % 2).cast("int")).alias("is_junk"),
        F.when(eid % 30 != 0, F.col("value")).alias("confidence"),
    )


def _survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images that are left: one per part."""
    return fixtures.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))


@query
def constraint_audit(spark, sf_dir):
    rules = tables.Rules("junk_flags", "image_id", ["confidence"], {"is_junk": [0, 1]}, ("image_id", "id"))
    return tables.violations(_verdicts(spark, sf_dir), rules, _survivors(spark, sf_dir))


@query
def cascade_delete(spark, sf_dir):
    return tables.cascade(_verdicts(spark, sf_dir), _survivors(spark, sf_dir)).select("image_id", "is_junk")


@query
def session_state(spark, sf_dir):
    log = fixtures.table(spark, sf_dir, "events").select(
        F.concat_ws(".", "event_type", F.col("user_id").cast("string")).alias("key"),
        F.col("props").alias("value"),
        F.col("event_id").alias("updated_at"),
    )
    return tables.latest_state(log)


@query
def image_index(spark, sf_dir):
    events = fixtures.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "props"
    )
    return tables.image_index(events)


# --- quality -----------------------------------------------------------------

from shoebox.operators import junk, quality, similar  # noqa: E402
from shoebox.sources import pictures  # noqa: E402


def _sums(tiles: DataFrame, wanted=None) -> DataFrame:
    """Tiles through the path that every decoded picture takes."""
    sums = pictures.picture_sums(pictures.from_planes(tiles), wanted=wanted)
    return sums.withColumn("image_id", F.col("image_id").cast("long"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles judged; every 31st is unreadable."""
    tiles = fixtures.tiles(spark, sf_dir)
    tiles = tiles.withColumn("gray", F.when(F.col("image_id") % 31 != 30, F.col("gray")))
    return quality.verdicts(pictures.metrics(_sums(tiles, pictures.QUALITY_SUMS)))


def _labels(reasons):
    return F.array_join(reasons, ",")


@query
def luminance(spark, sf_dir):
    rows = quality.gray_images(fixtures.colour_tiles(spark, sf_dir))
    return rows.select("image_id", F.posexplode("gray").alias("pos", "v"))


@query
def level_histogram(spark, sf_dir):
    return pictures.levels(_sums(fixtures.tiles(spark, sf_dir), pictures.CONTRAST_SUMS))


@query
def cell_clipping(spark, sf_dir):
    return _rounded(pictures.cell_clipping(_sums(fixtures.tiles(spark, sf_dir), pictures.CONTRAST_SUMS)), "under", "over")


@query
def quality_metrics(spark, sf_dir):
    judged = _judged(spark, sf_dir).drop("reasons", "low_quality", "exposure_score")
    return _rounded(judged, "raw_under", "under", "over")


@query
def quality_flags(spark, sf_dir):
    out = _rounded(quality.flags(_judged(spark, sf_dir)), "exposure_score", digits=9)
    return out.withColumn("reasons", _labels(F.col("reasons")))


@query
def quality_reason_labels(spark, sf_dir):
    return quality.flags(_judged(spark, sf_dir)).select("image_id", _labels(quality.reason_labels(F.col("reasons"))).alias("labels"))


@query
def quality_summary(spark, sf_dir):
    return quality.summary(_judged(spark, sf_dir))


@query
def low_quality_images(spark, sf_dir):
    return quality.low_quality(_judged(spark, sf_dir))


STRICT = quality.QualityThresholds(blur_threshold=5000.0, low_bin_index=40, high_bin_index=200, cell_passing_score=0.5, min_passing_cells=4)


@query
def quality_strict_limits(spark, sf_dir):
    judged = quality.verdicts(pictures.metrics(_sums(fixtures.tiles(spark, sf_dir), pictures.QUALITY_SUMS), STRICT), STRICT)
    return judged.select("image_id", "good_cells", _labels(F.col("reasons")).alias("reasons"))


@query
def luma_contrast(spark, sf_dir):
    return _rounded(pictures.contrast(_sums(fixtures.tiles(spark, sf_dir), pictures.CONTRAST_SUMS)), "contrast", digits=9)


# --- junk ----------------------------------------------------------------------


@query
def junk_features(spark, sf_dir):
    out = pictures.junk_features(_sums(fixtures.tiles(spark, sf_dir), pictures.JUNK_SUMS))
    return _rounded(out, "flat_ratio", "unique_ratio", "straight_ratio")


def _junk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return junk.classify(pictures.junk_features(_sums(fixtures.tiles(spark, sf_dir), pictures.JUNK_SUMS)))


@query
def junk_flags(spark, sf_dir):
    return _rounded(junk.flags(_junk(spark, sf_dir)), "confidence")


@query
def junk_summary(spark, sf_dir):
    return junk.summary(_junk(spark, sf_dir))


@query
def junk_unjudged(spark, sf_dir):
    """The label table stands for verdicts stored before."""
    stored = fixtures.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"))
    return _rounded(junk.classify(pictures.junk_features(_sums(junk.unjudged(fixtures.tiles(spark, sf_dir), stored), pictures.JUNK_SUMS))), "confidence")


def _dark_model(batch):
    """Stand-in for a user's model: very dark tiles are no photos."""
    import pandas as pd

    mean = batch["gray"].map(lambda g: float(sum(g)) / len(g))
    return pd.DataFrame(
        {"is_junk": (mean < 40).astype(int), "reason": mean.map(lambda m: "scan" if m < 40 else None), "confidence": 1 - mean / 255}
    )


@query
def junk_by_model(spark, sf_dir):
    return _rounded(junk.classify_with(fixtures.tiles(spark, sf_dir), _dark_model), "confidence")


# --- features and similar groups -----------------------------------------------------


@query
def shrunken_levels(spark, sf_dir):
    return pictures.shrunken_levels(_sums(fixtures.tiles(spark, sf_dir), ["shrunk"]))


@query
def dhash(spark, sf_dir):
    low = F.col("dhash").bitwiseAND(F.lit(0xFFFFFFFF))
    out = pictures.feature_rows(_sums(fixtures.tiles(spark, sf_dir), pictures.FEATURE_SUMS))
    return out.select("image_id", low.alias("low_bits"), F.shiftrightunsigned("dhash", 32).alias("high_bits"))


@query
def colour_bins(spark, sf_dir):
    return pictures.colour_counts(_sums(fixtures.colour_tiles(spark, sf_dir), pictures.COLOUR_SUMS))


@query
def colour_histogram(spark, sf_dir):
    bins = pictures.scaled_bins(_sums(fixtures.colour_tiles(spark, sf_dir), pictures.COLOUR_SUMS))
    return _rounded(bins.filter(F.col("level") != 0), "level")


def _assigned(spark: SparkSession, sf_dir: str, radius: float = similar.DEFAULT_RADIUS) -> DataFrame:
    return similar.assign_leaders(fixtures.bursts(spark, sf_dir), radius)


@query
def similar_search(spark, sf_dir):
    """Neighbours of every hundredth image."""
    library = fixtures.bursts(spark, sf_dir)
    found = similar.search(library.filter(F.col("image_id") % 100 == 0), library)
    return _rounded(found.select("target_id", "image_id", "hamming", "distance"), "distance")


@query
def similar_leaders(spark, sf_dir):
    return _assigned(spark, sf_dir)


@query
def leader_distances(spark, sf_dir):
    assigned = _assigned(spark, sf_dir)
    out = similar.leader_distances(assigned, fixtures.bursts(spark, sf_dir))
    return _rounded(out, "hist_distance", "distance")


def _scored(spark: SparkSession, sf_dir: str):
    """Groups of the bursts; each copy k of a vector is scored as its tile, with a made-up sharpness loss."""
    assigned = _assigned(spark, sf_dir)
    found = similar.groups(assigned)
    tile, k = F.floor(F.col("image_id") / 3), F.col("image_id") % 3
    vec = fixtures.table(spark, sf_dir, "embeddings").select("vec_id", "label")
    rated = (
        fixtures.bursts(spark, sf_dir)
        .select("image_id", tile.alias("vec_id"), k.alias("k"))
        .join(vec, "vec_id")
        .select(
            "image_id",
            (100.0 + F.col("vec_id") % 50 - 3 * ((F.col("k") + F.col("label")) % 3)).alias("sharpness"),
            ((F.col("k") * 2 + 1) / 7.0).alias("contrast"),
            F.when(F.col("vec_id") % 4 == 0, F.col("k") / 4.0).alias("face_score"),
        )
    )
    scored = similar.score(similar.members(assigned, found), rated)
    return found, similar.best_first(scored)


@query
def similar_groups(spark, sf_dir):
    assigned = _assigned(spark, sf_dir)
    return similar.groups(assigned)


@query
def group_members_ranked(spark, sf_dir):
    return _rounded(_scored(spark, sf_dir)[1], "score")


@query
def recommended_keepers(spark, sf_dir):
    return similar.keepers(_scored(spark, sf_dir)[1])


@query
def group_member_arrays(spark, sf_dir):
    packed = similar.member_arrays(_scored(spark, sf_dir)[1])
    scores = F.transform("member_scores", lambda s: F.format_number(s, 6))
    return packed.select(
        "group_id",
        "chunk_no",
        F.array_join(F.col("image_ids").cast("array<string>"), ",").alias("image_ids"),
        F.array_join(scores, ",").alias("member_scores"),
    )


@query
def similar_summary(spark, sf_dir):
    assigned = _assigned(spark, sf_dir)
    return similar.summary(similar.groups(assigned))


# --- streams ---------------------------------------------------------------------------

from pyspark.sql import types as T  # noqa: E402

from shoebox.session import scratch_path  # noqa: E402
from shoebox.streaming import decisions as stream_fold  # noqa: E402
from shoebox.streaming import events as feed  # noqa: E402
from shoebox.streaming import ingest, sinks  # noqa: E402
from shoebox.streaming import trips as stream_trip  # noqa: E402


def _replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.replay(spark, sf_dir, "events.parquet")


@query
def stream_decisions(spark, sf_dir):
    work = scratch_path(spark, "decisions")
    sinks.finish(stream_fold.follow(fixtures.actions_from(_replay(spark, sf_dir)), f"{work}/out", f"{work}/progress"))
    return stream_fold.standing(spark, f"{work}/out", T.LongType())


@query
def stream_keepers(spark, sf_dir):
    work = scratch_path(spark, "keepers")
    sinks.finish(stream_fold.follow(fixtures.actions_from(_replay(spark, sf_dir)), f"{work}/out", f"{work}/progress"))
    return stream_fold.keepers(spark, f"{work}/out", T.LongType())


@query
def stream_index(spark, sf_dir):
    work = scratch_path(spark, "index")
    rows = _replay(spark, sf_dir).select(
        F.col("user_id").alias("id"), F.col("event_id").alias("seq"), "event_type", "props"
    )
    sinks.finish(feed.index(rows, f"{work}/out", f"{work}/progress"))
    kept = T.StructType.fromDDL("id long, first_seen long, event_type string, props string, last_seen long")
    return feed.current_index(spark, f"{work}/out", kept)


@query
def stream_split(spark, sf_dir):
    work = scratch_path(spark, "split")
    kind = (
        F.when(F.col("event_type") == "view", "progress")
        .when(F.col("event_type").isin("click", "purchase"), "row")
        .when(F.col("event_type") == "signup", "complete")
    )
    tagged = _replay(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        kind.alias("kind"),
        F.struct(F.col("event_id").alias("done"), F.col("user_id").alias("total")).alias("progress"),
        F.struct(F.col("user_id").alias("id"), F.col("props").alias("payload")).alias("row"),
        F.struct(F.col("user_id").alias("flagged"), F.col("event_id").alias("total")).alias("complete"),
    )
    sinks.finish(feed.split(tagged, f"{work}/out", f"{work}/progress"))
    parts = {
        "progress": ("seq long, done long, total long", ["done", "total"]),
        "row": ("seq long, id long, payload string", ["id", "payload"]),
        "complete": ("seq long, flagged long, total long", ["flagged", "total"]),
    }
    out = None
    for name, (ddl, columns) in parts.items():
        rows = sinks.stored(spark, f"{work}/out/{name}", T.StructType.fromDDL(ddl))
        part = rows.select(F.lit(name).alias("kind"), "seq", F.concat_ws("|", *columns).alias("payload"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def stream_without_repeats(spark, sf_dir):
    work = scratch_path(spark, "repeats")
    seen = _replay(spark, sf_dir).select(
        (F.col("user_id") % 40).alias("id"), F.timestamp_millis(fixtures.epoch_ms(F.col("ts"))).alias("seen_at")
    )
    sinks.finish(sinks.append(ingest.without_repeats(seen, ["id"], "seen_at", "400 days"), f"{work}/out", f"{work}/progress"))
    return spark.read.schema("id long, seen_at timestamp").parquet(f"{work}/out").select("id")


def _followed_trips(spark: SparkSession, sf_dir: str):
    """A finished trip stream: photo table, photo schema, trip table and limits."""
    work = scratch_path(spark, "trips")
    schema = fixtures.photos(spark, sf_dir).schema
    photos = fixtures.photos_from(_replay(spark, sf_dir))
    sinks.finish(stream_trip.store_photos(photos, f"{work}/photos", f"{work}/stored"))
    limits = trips.TripThresholds(max_gap_hours=12, max_distance_km=300)
    found = stream_trip.follow(photos, f"{work}/photos", schema, f"{work}/trips", f"{work}/progress", limits, "1 hour")
    sinks.finish(found)
    return f"{work}/photos", schema, f"{work}/trips", limits


@query
def stream_trips(spark, sf_dir):
    _, _, path, _ = _followed_trips(spark, sf_dir)
    rows = sinks.stored(spark, path, stream_trip.TRIPS).drop("batch_id")
    return _rounded(rows, "centroid_lat", "centroid_lon")


@query
def stream_trips_closed(spark, sf_dir):
    photos, schema, path, limits = _followed_trips(spark, sf_dir)
    return _rounded(stream_trip.close(spark, photos, schema, path, limits), "centroid_lat", "centroid_lon")


@query
def stream_trips_late(spark, sf_dir):
    """Every fiftieth event comes a run later, far behind the watermark: trips after a repair and the stream's end."""
    work = scratch_path(spark, "late")
    events = fixtures.table(spark, sf_dir, "events")
    limits = trips.TripThresholds(max_gap_hours=12, max_distance_km=300)
    schema = fixtures.photos(spark, sf_dir).schema
    where = (f"{work}/photos", schema, f"{work}/trips", limits)
    for late in (False, True):
        events.filter((F.col("event_id") % 50 == 0) == late).write.mode("append").parquet(f"{work}/events")
        photos = fixtures.photos_from(spark.readStream.schema(events.schema).parquet(f"{work}/events"))
        sinks.finish(stream_trip.store_photos(photos, where[0], f"{work}/stored"))
        sinks.finish(stream_trip.follow(photos, where[0], schema, where[2], f"{work}/progress", limits, "1 hour"))
        stream_trip.repair(spark, *where)
    return _rounded(stream_trip.close(spark, *where), "centroid_lat", "centroid_lon")


# --- files made from the tables --------------------------------------------------------

import time  # noqa: E402

from shoebox import schemas  # noqa: E402
from shoebox.session import cut  # noqa: E402
from shoebox.sources.listing import FolderSource  # noqa: E402


def _picture_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "pictures")
    fixtures.picture_files(fixtures.colour_tiles(spark, sf_dir), folder)
    return folder


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """``id, path, length`` of all files below a folder."""
    spark.dataSource.register(FolderSource)
    found = spark.read.format("folder").option("path", folder).load().filter("problem IS NULL")
    return found.select(paths.relative_id(F.col("path"), folder.removeprefix("file:")).alias("id"), "path", "length")


@query
def folder_listing(spark, sf_dir):
    """Every file of a folder, hidden names included, and which are pictures by name."""
    found = _listed(spark, _picture_folder(spark, sf_dir))
    return found.select("id", "length", paths.is_image(F.col("path")).alias("picture"))


@query
def folder_stream(spark, sf_dir):
    """Pictures that arrive in two lots, followed by a stream that is started twice."""
    folder, work = scratch_path(spark, "arriving"), scratch_path(spark, "seen")
    tiles = fixtures.colour_tiles(spark, sf_dir)
    for lot in (0, 1):
        fixtures.picture_files(tiles.filter(F.col("image_id") % 2 == lot), folder)
        time.sleep(0.5)
        sinks.finish(sinks.append(ingest.watch_folder(spark, folder, settle_ms=250), f"{work}/out", f"{work}/progress"))
    seen = spark.read.schema("path string, length long, modified timestamp").parquet(f"{work}/out")
    return seen.select(paths.relative_id(F.col("path"), folder.removeprefix("file:")).alias("id"), "length")


@query
def folder_pictures(spark, sf_dir):
    """Decoded pictures: size and sum of all points; unreadable files stay as rows."""
    folder = _picture_folder(spark, sf_dir)
    byte = lambda i: F.conv(F.hex(F.substring("data", i, 1)), 16, 10).cast("long")
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.octet_length("data")), byte), F.lit(0).cast("long"), lambda a, b: a + b)
    readable = F.col("height") > 0
    return files.read_pixels(spark, folder).select(
        paths.relative_id(F.col("path"), folder.removeprefix("file:")).alias("id"),
        F.when(readable, F.col("width")).alias("width"),
        F.when(readable, F.col("height")).alias("height"),
        F.when(readable, total).alias("light"),
    )


@query
def library_resumed(spark, sf_dir):
    """A library that is opened, opened again, and started afresh: what each reports, and how many rows are stamped."""
    folder, table_path = _picture_folder(spark, sf_dir), scratch_path(spark, "library")
    found = _listed(spark, folder).filter(paths.is_image(F.col("path"))).withColumns({"width": F.lit(fixtures.TILE), "height": F.lit(fixtures.TILE)})
    rows = files.image_rows(found, folder.removeprefix("file:")).withColumn("seq", F.col("id"))
    states = None
    for step, fresh in enumerate((False, False, True)):
        state = tables.open_library(spark, table_path, rows, schemas.IMAGES, fresh)
        stamped = tables.read_table(spark, table_path, schemas.IMAGES).agg(F.count_if(F.col("scanned_at") > 0).alias("stamped"))
        row = state.select(F.lit(step).alias("step"), "resumed_session", "images", stamped.select("stamped").scalar().alias("stamped"))
        states = row if states is None else states.unionByName(row)
    return states


@query
def junk_stored(spark, sf_dir):
    """Verdicts that are stored twice stand once in the table."""
    path = scratch_path(spark, "verdicts")
    for _ in range(2):
        junk.store(_junk(spark, sf_dir), path)
    stored = tables.read_table(spark, path, schemas.JUNK_FLAGS)
    return _rounded(junk.flags(stored).withColumn("image_id", F.col("image_id").cast("long")), "confidence")


@query
def copied_files(spark, sf_dir):
    """All pictures and sidecars copied, and copied again: the second run finds them."""
    folder, target = _picture_folder(spark, sf_dir), scratch_path(spark, "copies")
    found = cut(_listed(spark, folder).select("id", F.col("path").alias("source"), F.col("length").alias("size_bytes")), "found")
    runs = []
    for _ in range(2):
        there = spark.createDataFrame([], "id string, size_bytes long") if not runs else _listed(spark, target).withColumnRenamed("length", "size_bytes")
        planned = commit.manifest(found, found, there, target).join(found.select("id", "source"), "id")
        runs.append(cut(commit.copy_files(planned, 10_000), "copied"))
    first, second = (r.select("id", F.col("status").alias(name)) for r, name in zip(runs, ("first_run", "second_run")))
    return first.join(second, "id").join(_listed(spark, target).select("id", "length"), "id", "left")
