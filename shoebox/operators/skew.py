"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds more than 1/MAX_HOT_KEYS of the rows, so there are never more
# than MAX_HOT_KEYS hot keys and their list is safe to broadcast.
MAX_HOT_KEYS = 1000


def hot_keys(df: DataFrame, on: list[str], share: int = MAX_HOT_KEYS) -> DataFrame:
    """Hot keys with the number of pieces (``_pieces``) to split each into."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    # The total is the sum of the same counts, whose exchange Spark reuses: one pass over ``df``.
    limit = F.ceil(counts.agg(F.sum("_n").alias("_total")).select("_total").scalar() / share)
    return counts.withColumn("_limit", limit).filter(F.col("_n") > F.col("_limit")).select(
        *on, F.ceil(F.col("_n") / F.col("_limit")).cast("int").alias("_pieces")
    )


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "left",
    share: int = MAX_HOT_KEYS,
    hint: str | None = None,
) -> DataFrame:
    """Join a large ``left`` to ``right`` (few rows per key), splitting hot keys of ``left``.

    Rows of a hot key are spread by a hash of ``spread_by``; the matching right
    rows are repeated once per piece. At most ``2 * share`` pieces exist.
    ``left`` is read for the counts and for the join: settle it first where it is costly.
    ``hint`` names the join strategy.
    """
    hot = hot_keys(left, on, share)
    piece = F.pmod(F.xxhash64(*spread_by), F.col("_pieces")).cast("int")
    salted_left = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt", F.when(F.col("_pieces").isNull(), 0).otherwise(piece)
    )
    salts = F.when(F.col("_pieces").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("_pieces") - 1))
    salted_right = right.join(F.broadcast(hot), on, "left").withColumn("_salt", F.explode(salts)).drop("_pieces")
    if hint:
        salted_right = salted_right.hint(hint)
    return salted_left.drop("_pieces").join(salted_right, [*on, "_salt"], how).drop("_salt")
