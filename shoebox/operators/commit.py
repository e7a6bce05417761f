"""Copying the kept images to a destination."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.functions import paths
from shoebox.operators.ordering import running_sum
from shoebox.session import default_blocks
from shoebox.sources import storage

# Fixed value: error text for an existing destination file of another size.
NAME_CONFLICT = "name conflict"
UNKNOWN_ID = "unknown image id"


def manifest(keep_ids: DataFrame, images: DataFrame, listing: DataFrame, destination: str) -> DataFrame:
    """One row per kept id with its target path and what to do with it.

    ``status``: copy, present (same size already there), conflict (other size
    there) or unknown. ``images`` and ``listing`` carry ``id, size_bytes``.
    """
    there = listing.select("id", F.col("size_bytes").alias("there_bytes"))
    known = images.select("id", "size_bytes", F.lit(True).alias("known"))
    there = there.withColumn("found", F.lit(True))
    rows = keep_ids.select("id").distinct().join(known, "id", "left").join(there, "id", "left")
    # An image of unknown size is copied, but never taken for what is there already.
    status = (
        F.when(F.col("known").isNull(), "unknown")
        .when(F.col("found").isNull(), "copy")
        .when(F.col("there_bytes") == F.col("size_bytes"), "present")
        .otherwise("conflict")
    )
    error = F.when(F.col("status") == "conflict", F.concat_ws(": ", "id", F.lit(NAME_CONFLICT))).when(
        F.col("status") == "unknown", F.concat_ws(": ", "id", F.lit(UNKNOWN_ID))
    )
    return rows.withColumn("status", status).select(
        "id", F.concat(F.lit(destination.rstrip("/") + "/"), "id").alias("target"), "size_bytes", "status", error.alias("error")
    )


def sidecars(files: DataFrame, kept: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    """Sidecar files in the folder of a kept image with the same stem; both inputs carry ``path``.

    A folder and stem name at most one file per extension, so no key is hot.
    """
    key = [paths.folder(F.col("path")).alias("folder"), paths.stem(F.col("path")).alias("stem")]
    side = files.filter(F.lower(paths.extension(F.col("path"))).isin(extensions or paths.SIDECAR_EXTENSIONS))
    return side.select("*", *key).join(kept.select(*key), ["folder", "stem"], "left_semi").drop("folder", "stem")


def progress(planned: DataFrame, blocks: int | None = None) -> DataFrame:
    """Running files and bytes done, in id order, next to the totals and the share of bytes done."""
    work = planned.filter(F.col("status").isin("copy", "present")).select("id", "size_bytes", F.lit(1).cast("long").alias("one"))
    total = work.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))
    done = running_sum(work, ["id"], {"done": "one", "done_bytes": "size_bytes"}, blocks)
    return done.select(
        "id",
        "done",
        total.select("total").scalar().alias("total"),
        "done_bytes",
        total.select("total_bytes").scalar().alias("total_bytes"),
    ).withColumn("fraction", F.try_divide("done_bytes", "total_bytes"))


def summary(results: DataFrame) -> DataFrame:
    """Copied (files already present count) and skipped; error texts are in ``errors``."""
    return results.agg(
        F.count_if(F.col("status").isin("copy", "present", "copied")).alias("copied"),
        F.count_if(F.col("status") == "conflict").alias("skipped"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def errors(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull()).select("error")


def _copy_one(source: str, target: str, attempt: str) -> tuple[str, str | None]:
    from pyarrow import fs

    part = None
    try:
        src_fs, src = storage.open_place(source)
        dst_fs, dst = storage.open_place(target)
        size = src_fs.get_file_info(src).size
        there = dst_fs.get_file_info(dst)
        if there.type != fs.FileType.NotFound:
            return ("present", None) if there.size == size else ("conflict", NAME_CONFLICT)
        parent, _, name = dst.rpartition("/")
        dst_fs.create_dir(parent, recursive=True)
        # A retried or speculative task writes its own part file; the move publishes it whole.
        part = f"{parent}/.{name}.{attempt}"
        with src_fs.open_input_stream(src) as reader, dst_fs.open_output_stream(part) as writer:
            while chunk := reader.read(8 << 20):
                writer.write(chunk)
        dst_fs.move(part, dst)
        return "copied", None
    except Exception as failure:  # noqa: BLE001 - a failed file is a row, not an abort
        if part is not None:
            with contextlib.suppress(OSError):
                dst_fs.delete_file(part)
        return "failed", str(failure).splitlines()[0] if str(failure) else type(failure).__name__


BYTES_PER_TASK = 1 << 30


def copy_files(planned: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """Copy every ``status = 'copy'`` row (``id, source, target, size_bytes``); one result row per planned file.

    A manifest row is small but its file is not: files are packed into bins of about ``bytes_per_task`` by their running
    total, and each bin is a task. A lost task finds the files it has moved into place.
    """
    copied = F.when(F.col("status") == "copy", F.coalesce("size_bytes", F.lit(0))).otherwise(0).cast("long")
    before = running_sum(planned.withColumn("_bytes", copied), ["id"], {"upto": "_bytes"})
    total = before.agg(F.max("upto")).first()[0] or 0
    bins = max(default_blocks(planned.sparkSession), -(-total // bytes_per_task))
    packed = before.withColumn("bin", F.floor(F.col("upto") * F.lit(bins) / F.lit(total + 1)).cast("int"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        attempt = str(TaskContext.get().taskAttemptId())
        for batch in batches:
            done = [
                (row.status, row.error) if row.status != "copy" else _copy_one(row.source, row.target, attempt)
                for row in batch.itertuples()
            ]
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "status": [status for status, _ in done],
                    "error": [
                        error if row_status != "copy" or error is None else f"{image_id}: {error}"
                        for image_id, row_status, (_, error) in zip(batch["id"], batch["status"], done)
                    ],
                }
            )

    rows = packed.select("id", "source", "target", "status", "error", "bin").repartitionByRange(bins, "bin").drop("bin")
    return rows.mapInPandas(run, "id string, status string, error string")
