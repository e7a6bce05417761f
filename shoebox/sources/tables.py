"""Stored tables: idempotent inserts, lookups, constraint audits, cascades."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.sources import storage


def first_per_id(batch: DataFrame, order: str = "seq", key: str = "id") -> DataFrame:
    """The first row per id. A partial aggregate, so a much repeated id costs nothing extra."""
    rest = [c for c in batch.columns if c != key]
    return batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def new_rows(existing: DataFrame, batch: DataFrame, order: str = "seq", key: str = "id") -> DataFrame:
    """Rows an insert-or-ignore would add: unknown ids, the first row of each.

    Repeats collapse before the join, so no id is hot there.
    """
    return first_per_id(batch, order, key).join(existing.select(key), key, "left_anti")


def insert_images(spark: SparkSession, table_path: str, batch: DataFrame, schema: T.StructType, order: str = "seq") -> None:
    """Add unknown images, stamped with the scan time in seconds; all of them or none."""
    stamped = new_rows(read_table(spark, table_path, schema), batch, order).withColumn("scanned_at", F.unix_timestamp())
    missing = [f for f in schema.fields if f.name not in stamped.columns]
    append(stamped.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else stamped, table_path, schema)


# A stored table is a folder of numbered parts: ``full-n`` replaces all parts before it, ``more-n`` adds to them. A part
# counts from the moment that Spark's commit marks it as complete, so a failed writer changes nothing, and of two
# writers of one number the second fails.
_PART = re.compile(r"(full|more)-(\d+)$")


def _parts(spark: SparkSession, table_path: str) -> tuple[list[str], int]:
    """Complete parts that make up the table, and the next free number."""
    found = sorted((int(m[2]), m[0]) for m in map(_PART.match, storage.names(spark, table_path)) if m)
    live: list[str] = []
    for _, name in found:
        if storage.exists(spark, f"{table_path}/{name}/_SUCCESS"):
            live = [name] if name.startswith("full") else [*live, name]
    return live, found[-1][0] + 1 if found else 0


def read_table(spark: SparkSession, table_path: str, schema: T.StructType) -> DataFrame:
    """A stored table, or an empty one where none was written yet."""
    live, _ = _parts(spark, table_path)
    if not live:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table_path}/{name}" for name in live])


def _write(df: DataFrame, table_path: str, schema: T.StructType, kind: str) -> None:
    _, number = _parts(df.sparkSession, table_path)
    rows = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    rows.write.mode("errorifexists").parquet(f"{table_path}/{kind}-{number:09d}")


def save(df: DataFrame, table_path: str, schema: T.StructType) -> None:
    """Replace a stored table; ``df`` may read the table itself. Parts of the old one may be deleted by hand later."""
    _write(df, table_path, schema, "full")


def append(df: DataFrame, table_path: str, schema: T.StructType) -> None:
    """Add rows to a stored table."""
    _write(df, table_path, schema, "more")


def open_library(
    spark: SparkSession, table_path: str, batch: DataFrame, schema: T.StructType, force_fresh: bool = False
) -> DataFrame:
    """Start or resume a library; returns one row: ``resumed_session, images``.

    ``force_fresh`` replaces the table; otherwise known images are kept and only new ones added.
    """
    known = read_table(spark, table_path, schema)
    resumed = not force_fresh and not known.isEmpty()
    if force_fresh:
        # The new rows replace the old table in one step.
        fresh = first_per_id(batch).withColumn("scanned_at", F.unix_timestamp())
        missing = [f for f in schema.fields if f.name not in fresh.columns]
        save(fresh.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else fresh, table_path, schema)
    else:
        insert_images(spark, table_path, batch, schema)
    stored = read_table(spark, table_path, schema)
    return stored.agg(F.lit(resumed).alias("resumed_session"), F.count(F.lit(1)).alias("images"))


def working_paths(images: DataFrame) -> DataFrame:
    return images.select("working_image_path").dropna()


def original_paths(images: DataFrame) -> DataFrame:
    return images.select("absolute_path").dropna()


def latest_state(log: DataFrame) -> DataFrame:
    """Session state: the last value written per key."""
    return log.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))


def image_index(events: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Row events to one row per id: last write wins, ``first_seen`` gives the display order."""
    rest = [c for c in events.columns if c not in (key, seq)]
    return events.groupBy(key).agg(
        F.min(seq).alias("first_seen"), F.max_by(F.struct(*rest), seq).alias("_row")
    ).select(key, "first_seen", "_row.*")


@dataclass(frozen=True)
class Rules:
    """Constraints of one table."""

    name: str
    key: str
    required: list[str] = field(default_factory=list)
    domains: dict[str, list] = field(default_factory=dict)
    parent: tuple[str, str] | None = None  # (child column, parent key)


def violations(df: DataFrame, rules: Rules, parent: DataFrame | None = None) -> DataFrame:
    """One row per broken constraint: ``table_name, rule, row_key``."""
    key = F.col(rules.key).cast("string").alias("row_key")

    def found(rows: DataFrame, rule: str) -> DataFrame:
        return rows.select(F.lit(rules.name).alias("table_name"), F.lit(rule).alias("rule"), key)

    # Row-wise rules in one scan: each row yields the names of the rules it breaks.
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is null")) for c in rules.required]
    checks += [F.when(~F.col(c).isin(allowed), F.lit(f"{c} out of domain")) for c, allowed in rules.domains.items()]
    out = df.select(
        F.lit(rules.name).alias("table_name"), F.explode(F.array_compact(F.array(*checks))).alias("rule"), key
    )
    repeated = df.groupBy(rules.key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    out = out.unionByName(found(repeated, f"{rules.key} repeated"))
    if rules.parent and parent is not None:
        column, parent_key = rules.parent
        known = parent.select(F.col(parent_key).alias(column))
        orphans = df.filter(F.col(column).isNotNull()).join(known, column, "left_anti")
        out = out.unionByName(found(orphans, f"{column} has no parent"))
    return out


def cascade(children: DataFrame, surviving: DataFrame, column: str = "image_id", parent_key: str = "id") -> DataFrame:
    """Child rows left after their parents were deleted."""
    return children.join(surviving.select(F.col(parent_key).alias(column)), column, "left_semi")
