"""User decisions: fold an action log, then resolve what gets deleted.

The log has one row per action: ``seq`` (unique, increasing), ``action``,
``image_ids`` (for keep, mark, toggle, keep_all, mark_all) and ``group_id`` /
``keeper_id`` (for assign_keeper). ``reset`` forgets everything before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.operators.skew import spread_join
from shoebox.session import cut

# Stored decision names.
EXPLICIT_KEEP = "EXPLICIT_KEEP"
EXPLICIT_DELETE = "EXPLICIT_DELETE"

# Sequence numbers are unique, so one (image, span) group has at most this many rows,
# however many actions a single image collects.
SPAN = 1 << 20


def last_reset(actions: DataFrame) -> DataFrame:
    """One row: the sequence number of the last reset, -1 if there was none."""
    return actions.agg(F.coalesce(F.max(F.when(F.col("action") == "reset", F.col("seq"))), F.lit(-1)).alias("reset_seq"))


def after_reset(actions: DataFrame) -> DataFrame:
    return actions.filter(F.col("seq") > last_reset(actions).scalar())


def image_actions(actions: DataFrame) -> DataFrame:
    """Per-image actions: ``image_id, seq, sets`` where sets is a decision, or null for a toggle."""
    sets = F.when(F.col("action").isin("keep", "keep_all"), EXPLICIT_KEEP).when(
        F.col("action").isin("mark", "mark_all"), EXPLICIT_DELETE
    )
    return actions.filter(F.col("action").isin("keep", "keep_all", "mark", "mark_all", "toggle")).select(
        F.explode(F.array_distinct("image_ids")).alias("image_id"), "seq", sets.alias("sets")
    )


def summarise(rows: DataFrame, span: Column) -> DataFrame:
    """Per (image, span): the last set decision, toggles after it, last sequence number.

    A span is any contiguous stretch of the log, so an image with a third of all
    actions is spread over many tasks.
    """
    within = Window.partitionBy("image_id", "span")
    is_set = F.col("sets").isNotNull()
    marked = rows.withColumn("span", span).withColumn(
        "set_seq", F.max(F.when(is_set, F.col("seq"))).over(within)
    )
    later = F.col("set_seq").isNull() | (F.col("seq") > F.col("set_seq"))
    return marked.groupBy("image_id", "span").agg(
        F.max_by("sets", F.when(is_set, F.col("seq"))).alias("base"),
        F.count_if(later & ~is_set).alias("toggles"),
        F.max("seq").alias("updated_at"),
    )


def merged(spans: DataFrame) -> DataFrame:
    """Per image: its span summaries, composed in log order into one, ``image_id, base, toggles, updated_at``."""
    per_image = Window.partitionBy("image_id")
    set_at = F.when(F.col("base").isNotNull(), F.col("updated_at"))
    dated = spans.withColumn("_from", F.max(set_at).over(per_image))
    return dated.groupBy("image_id").agg(
        F.max_by("base", set_at).alias("base"),
        F.sum(F.when(F.col("_from").isNull() | (F.col("updated_at") >= F.col("_from")), F.col("toggles"))).alias("toggles"),
        F.max("updated_at").alias("updated_at"),
    )


def combine(spans: DataFrame) -> DataFrame:
    """Per image: the standing decision that its span summaries make."""
    return merged(spans).select("image_id", decision(F.col("base"), F.col("toggles")).alias("decision"), "updated_at")


def decision(base: Column, toggles: Column) -> Column:
    """A toggle turns deleted into kept and anything else into deleted."""
    odd = toggles % 2 == 1
    from_deleted = F.when(odd, EXPLICIT_KEEP).otherwise(EXPLICIT_DELETE)
    from_other = F.when(odd, EXPLICIT_DELETE).otherwise(EXPLICIT_KEEP)
    return F.when(toggles == 0, base).when(base == EXPLICIT_DELETE, from_deleted).otherwise(from_other)


def settled_log(actions: DataFrame) -> DataFrame:
    """The log after its last reset as a table: the reset is looked up once for all that read it."""
    return cut(after_reset(actions), "log")


def fold(live: DataFrame, span: int = SPAN) -> DataFrame:
    """Standing decision per image of a log after its last reset: ``image_id, decision, updated_at``."""
    rows = image_actions(live)
    return combine(summarise(rows, F.floor(F.col("seq") / span)))


def fold_keepers(live: DataFrame) -> DataFrame:
    """Keeper the user chose per group in a log after its last reset; the last choice wins."""
    return (
        live
        .filter(F.col("action") == "assign_keeper")
        .groupBy("group_id")
        .agg(F.max_by("keeper_id", "seq").alias("keeper_id"))
    )


def saved_decisions(decisions: DataFrame, keepers: DataFrame) -> DataFrame:
    """Read-back of a saved session as ``kind, value`` rows; keepers read "group:keeper"."""
    kind = F.when(F.col("decision") == EXPLICIT_KEEP, "explicit_kept").otherwise("explicit_deleted")
    return decisions.select(kind.alias("kind"), F.col("image_id").cast("string").alias("value")).unionByName(
        keepers.select(F.lit("keeper").alias("kind"), F.concat_ws(":", "group_id", "keeper_id").alias("value"))
    )


def keeper_map(members: DataFrame, keepers: DataFrame, group_order: str = "group_id") -> DataFrame:
    """Effective keeper per image: the user's choice, else the recommended one.

    ``members`` has one row per (group, image) with ``recommended_id``. An image
    in several groups takes the keeper of the last one.
    """
    chosen = spread_join(members, keepers, ["group_id"], ["image_id"])
    return chosen.groupBy("image_id").agg(
        F.max_by(F.coalesce("keeper_id", "recommended_id"), group_order).alias("keeper_id")
    )


def _flag(ids: DataFrame, name: str) -> DataFrame:
    return ids.select("image_id").distinct().withColumn(name, F.lit(True))


def _not_keeper() -> Column:
    keeper = F.col("keeper_id").cast("string")
    return keeper.isNotNull() & (keeper != "") & (keeper != F.col("image_id").cast("string"))


def _resolve(default: Column) -> Column:
    return (
        F.when(F.col("decision") == EXPLICIT_DELETE, True)
        .when(F.col("decision") == EXPLICIT_KEEP, False)
        .otherwise(F.coalesce(default, F.lit(False)))
    )


def marked_for_deletion(
    images: DataFrame,
    decisions: DataFrame,
    step: str | None,
    flagged: DataFrame | None = None,
    keepers: DataFrame | None = None,
) -> DataFrame:
    """Add ``marked``: explicit delete, else explicit keep, else the default of the step.

    ``step`` is "quality" or "junk" (default: the image is in ``flagged``), "similar"
    (default: the image is not its group's keeper in ``keepers``) or None (no default).
    """
    out = images.join(decisions.select("image_id", "decision"), "image_id", "left")
    default = F.lit(False)
    if step in ("quality", "junk"):
        out = out.join(_flag(flagged, "_flagged"), "image_id", "left")
        default = F.col("_flagged")
    elif step == "similar":
        out = out.join(keepers.select("image_id", "keeper_id"), "image_id", "left")
        default = _not_keeper()
    elif step is not None:
        raise ValueError(f"unknown step: {step}")
    return out.select(*images.columns, _resolve(default).alias("marked"))


def similar_marked_count(members: DataFrame, decisions: DataFrame, keepers: DataFrame) -> DataFrame:
    """How many memberships are marked in the similar step."""
    marks = marked_for_deletion(members.select("image_id"), decisions, "similar", keepers=keepers)
    return marks.agg(F.count_if("marked").alias("marked_count"))


def final_decisions(
    images: DataFrame, decisions: DataFrame, quality: DataFrame, junk: DataFrame, keepers: DataFrame
) -> DataFrame:
    """Add ``deleted``: explicit choices first, then the default of any step."""
    out = (
        images.join(decisions.select("image_id", "decision"), "image_id", "left")
        .join(_flag(quality, "_quality"), "image_id", "left")
        .join(_flag(junk, "_junk"), "image_id", "left")
        .join(keepers.select("image_id", "keeper_id"), "image_id", "left")
    )
    default = F.coalesce("_quality", F.lit(False)) | F.coalesce("_junk", F.lit(False)) | _not_keeper()
    return out.select(*images.columns, _resolve(default).alias("deleted"))


def keep_summary(resolved: DataFrame) -> DataFrame:
    """Images and bytes that stay, and images left behind."""
    keep = ~F.col("deleted")
    return resolved.agg(
        F.count_if(keep).alias("keep_count"),
        F.coalesce(F.sum(F.when(keep, F.col("size_bytes"))), F.lit(0)).alias("keep_bytes"),
        F.count_if("deleted").alias("left_behind"),
    )
