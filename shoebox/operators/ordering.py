"""Global order without a single-task window.

A window over a whole table, or over one owner that holds a third of it, runs in
one task. Here rows are range-partitioned on the full (unique) ordering key into
blocks of similar size, numbered inside each block, and the blocks are stitched
with a summary of one row per block. One hot key simply spans several blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoebox.session import cut, default_blocks

BLOCK = "_block"
Break = Callable[[Column, Column], Column]


def place(df: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """Range-partition on ``keys`` and label every row with its block number.

    The label is only stable once the result is materialised with ``cut``.
    """
    n = blocks or default_blocks(df.sparkSession)
    return df.repartitionByRange(n, *keys).withColumn(BLOCK, F.spark_partition_id())


def _in_block(keys: list[str]):
    return Window.partitionBy(BLOCK).orderBy(*keys)


def _blocks_before():
    # One row per block, so this unpartitioned window is bounded by the block count.
    return Window.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)


def running_sum(
    df: DataFrame, keys: list[str], sums: dict[str, str], blocks: int | None = None
) -> DataFrame:
    """Running totals in ``keys`` order; ``sums`` maps output name to input column."""
    kept = [c for c in df.columns if c not in sums]
    w = _in_block(keys).rowsBetween(Window.unboundedPreceding, 0)
    placed = place(df, keys, blocks)
    local = cut(placed.select("*", *[F.sum(F.col(src)).over(w).alias(out) for out, src in sums.items()]), "running")
    totals = local.groupBy(BLOCK).agg(*[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()])
    carry = totals.select(
        BLOCK,
        *[F.coalesce(F.sum(f"_t_{out}").over(_blocks_before()), F.lit(0)).alias(f"_c_{out}") for out in sums],
    )
    joined = local.join(F.broadcast(carry), BLOCK)
    return joined.select(*kept, *[(F.col(out) + F.col(f"_c_{out}")).alias(out) for out in sums])


def segment(
    df: DataFrame,
    keys: list[str],
    outer: list[str],
    carried: list[str] | None = None,
    inner_break: Break | None = None,
    blocks: int | None = None,
) -> DataFrame:
    """Number nested runs of rows in ``keys`` order.

    ``outer`` is a prefix of ``keys`` (an owner, a group): a new outer run starts
    when it changes. Inside it, ``inner_break(previous, current)`` starts a new inner run,
    where both arguments are structs of ``outer + carried``. Added columns, all 1-based:

    - ``row_no``     position in the whole table
    - ``outer_no``   number of the outer run
    - ``inner_no``   number of the inner run inside its outer run
    - ``pos``        position inside the inner run
    """
    names = list(dict.fromkeys(outer + (carried or [])))
    here = F.struct(*names)
    w = _in_block(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def outer_change(prev: Column, cur: Column) -> Column:
        same = F.lit(True)
        for name in outer:
            same = same & prev[name].eqNullSafe(cur[name])
        return prev.isNull() | ~same

    def changed(prev: Column, cur: Column) -> Column:
        new_outer = outer_change(prev, cur)
        return new_outer if inner_break is None else new_outer | inner_break(prev, cur)

    def flag(cond: Column) -> Column:
        return F.coalesce(cond, F.lit(False)).cast("long")

    # The first row of a block has no local predecessor; its flags are settled below.
    inside = F.col("_prev").isNotNull()
    local = (
        place(df, keys, blocks).select("*", here.alias("_here"))
        .select("*", F.lag("_here").over(w).alias("_prev"), F.row_number().over(w).cast("long").alias("_rn"))
        .select(
            "*",
            flag(inside & outer_change(F.col("_prev"), F.col("_here"))).alias("_ob"),
            flag(inside & changed(F.col("_prev"), F.col("_here"))).alias("_ib"),
        )
        .select("*", F.sum("_ob").over(upto).alias("_o"), F.sum("_ib").over(upto).alias("_i"))
        .select(
            "*",
            F.max(F.when(F.col("_ob") == 1, F.col("_i"))).over(upto).alias("_outer_start"),
            F.max(F.when(F.col("_ib") == 1, F.col("_rn"))).over(upto).alias("_inner_start"),
        )
        .drop("_here", "_prev", "_ob", "_ib")
    )
    local = cut(local, "segment")

    # One row per block.
    edge = local.groupBy(BLOCK).agg(
        F.min_by(here, "_rn").alias("_first"),
        F.max_by(here, "_rn").alias("_last"),
        F.max("_rn").alias("_rows"),
        F.max("_o").alias("_outers"),
        F.max("_i").alias("_inners"),
        F.max("_outer_start").alias("_last_outer"),
        F.max("_inner_start").alias("_last_inner"),
    )
    before = _blocks_before()
    edge = edge.withColumn("_prev", F.lag("_last").over(Window.orderBy(BLOCK)))
    edge = edge.withColumn("_fo", flag(outer_change(F.col("_prev"), F.col("_first"))))
    edge = edge.withColumn("_fi", flag(changed(F.col("_prev"), F.col("_first"))))
    zero = F.lit(0)
    edge = (
        edge.withColumn("_row_off", F.coalesce(F.sum("_rows").over(before), zero))
        .withColumn("_outer_off", F.coalesce(F.sum(F.col("_outers") + F.col("_fo")).over(before), zero) + F.col("_fo"))
        .withColumn("_inner_off", F.coalesce(F.sum(F.col("_inners") + F.col("_fi")).over(before), zero) + F.col("_fi"))
        .withColumn("_own_outer", F.when(F.col("_fo") == 1, F.col("_inner_off")))
        .withColumn("_own_inner", F.when(F.col("_fi") == 1, F.col("_row_off") + 1))
    )
    carry = edge.select(
        BLOCK,
        "_row_off",
        "_outer_off",
        "_inner_off",
        F.coalesce(
            "_own_outer",
            F.max(F.coalesce(F.col("_inner_off") + F.col("_last_outer"), F.col("_own_outer"))).over(before),
        ).alias("_outer_from"),
        F.coalesce(
            "_own_inner",
            F.max(F.coalesce(F.col("_row_off") + F.col("_last_inner"), F.col("_own_inner"))).over(before),
        ).alias("_inner_from"),
    )
    joined = local.join(F.broadcast(carry), BLOCK)
    row_no = F.col("_row_off") + F.col("_rn")
    outer_from = F.coalesce(F.col("_inner_off") + F.col("_outer_start"), F.col("_outer_from"))
    inner_from = F.coalesce(F.col("_row_off") + F.col("_inner_start"), F.col("_inner_from"))
    return joined.select(
        *df.columns,
        row_no.alias("row_no"),
        (F.col("_outer_off") + F.col("_o")).alias("outer_no"),
        (F.col("_inner_off") + F.col("_i") - outer_from + 1).alias("inner_no"),
        (row_no - inner_from + 1).alias("pos"),
    )


def pack(df: DataFrame, group: list[str], pos: str, columns: dict[str, str], chunk: int = 10_000) -> DataFrame:
    """Ordered arrays per group, at most ``chunk`` entries per row.

    ``columns`` maps output array name to input column. A group of any size
    becomes several rows numbered by ``chunk_no``; nothing is dropped.
    """
    item = F.struct(F.col(pos).alias("_pos"), *[F.col(src).alias(out) for out, src in columns.items()])
    rows = (
        df.withColumn("chunk_no", F.floor((F.col(pos) - 1) / F.lit(chunk)).cast("long"))
        .groupBy(*group, "chunk_no")
        .agg(F.array_sort(F.collect_list(item)).alias("_items"))
    )
    return rows.select(*group, "chunk_no", *[F.col("_items")[out].alias(out) for out in columns])


def previous(
    df: DataFrame,
    keys: list[str],
    outer: list[str],
    carried: list[str],
    blocks: int | None = None,
) -> DataFrame:
    """Add ``_prev``: the ``carried`` struct of the preceding row with equal ``outer``, else null."""
    names = list(dict.fromkeys(outer + carried))
    w = _in_block(keys)
    local = cut(
        place(df, keys, blocks)
        .withColumn("_here", F.struct(*names))
        .withColumn("_rn", F.row_number().over(w))
        .withColumn("_before", F.lag("_here").over(w)),
        "previous",
    )
    edge = local.groupBy(BLOCK).agg(F.max_by("_here", "_rn").alias("_last"))
    carry = edge.select(BLOCK, F.lag("_last").over(Window.orderBy(BLOCK)).alias("_edge"))
    joined = local.join(F.broadcast(carry), BLOCK)
    prev = F.when(F.col("_rn") == 1, F.col("_edge")).otherwise(F.col("_before"))
    same = F.lit(True)
    for name in outer:
        same = same & prev[name].eqNullSafe(F.col(name))
    return joined.select(*df.columns, F.when(same, prev).alias("_prev"))
