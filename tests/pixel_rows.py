"""Every pixel a row: a slow, plain version of the pixel sums, to compare the package's with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.operators.features import BINS, HASH_COLS, HASH_ROWS, HUE_BINS, HUE_RANGE, SATURATION_BINS, SATURATION_RANGE, dhash_bits, hue_saturation, scaled_histogram  # noqa: F401
from shoebox.operators.junk import JunkRules
from shoebox.operators.quality import GRID, QualityThresholds, highlight_weight, shadow_weight, verdict_inputs


def _mirrored(index: Column, size: Column) -> Column:
    """Index reflected at the border without repeating the edge pixel."""
    inside = F.when(index < 0, -index).when(index >= size, 2 * size - 2 - index).otherwise(index)
    return F.when(size == 1, 0).otherwise(inside)


def pixels(images: DataFrame) -> DataFrame:
    """One row per pixel: ``image_id, height, width, row, col, v, laplacian, cell``.

    ``laplacian`` compares a pixel with its four neighbours; ``cell`` numbers the
    3x3 grid, null for the right and bottom remainder.
    """
    h, w = F.col("height"), F.col("width")

    def at(row: Column, col: Column) -> Column:
        return F.get("gray", (_mirrored(row, h) * w + _mirrored(col, w)).cast("int"))

    def pixel(v: Column, i: Column) -> Column:
        row, col = F.floor(i / w).cast("int"), (i % w).cast("int")
        around = at(row - 1, col) + at(row + 1, col) + at(row, col - 1) + at(row, col + 1)
        return F.struct(
            row.alias("row"), col.alias("col"), v.alias("v"), (around - 4 * v).cast("long").alias("laplacian")
        )

    spread = images.select("image_id", "height", "width", F.inline_outer(F.transform("gray", pixel)))
    ch, cw = F.floor(h / GRID).cast("int"), F.floor(w / GRID).cast("int")
    inside = (F.col("row") < GRID * ch) & (F.col("col") < GRID * cw)
    cell = F.floor(F.col("row") / ch).cast("int") * GRID + F.floor(F.col("col") / cw).cast("int")
    return spread.withColumn("cell", F.when(inside, cell))


def levels(images: DataFrame) -> DataFrame:
    """Intensity histogram rows: ``image_id, v, n``."""
    flat = images.select("image_id", F.explode("gray").alias("v"))
    return flat.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))


def cell_clipping(images: DataFrame, limits: QualityThresholds = QualityThresholds()) -> DataFrame:
    """Clipping per image and grid cell: ``image_id, cell, under, over``."""
    return (
        pixels(images)
        .filter(F.col("cell").isNotNull())
        .groupBy("image_id", "cell")
        .agg(
            F.avg(shadow_weight(F.col("v"), limits)).alias("under"),
            F.avg(highlight_weight(F.col("v"), limits)).alias("over"),
        )
    )


def metrics(images: DataFrame, limits: QualityThresholds = QualityThresholds()) -> DataFrame:
    """``image_id, valid, sharpness, raw_under, under, over, good_cells`` for every image.

    One aggregation: whole-image and per-cell sums are taken together. With
    enough well exposed cells ``under`` is set to zero.
    """
    v, cell = F.col("v"), F.col("cell")
    px = pixels(images).withColumns({"_s": shadow_weight(v, limits), "_h": highlight_weight(v, limits)})
    sums = []
    for k in range(GRID * GRID):
        here = F.when(cell == k, F.lit(1))
        sums += [
            F.sum(F.when(cell == k, F.col("_s"))).alias(f"_s{k}"),
            F.sum(F.when(cell == k, F.col("_h"))).alias(f"_h{k}"),
            F.count(here).alias(f"_n{k}"),
        ]
    per_image = px.groupBy("image_id").agg(
        F.count("v").alias("_n"),
        F.sum("laplacian").alias("_l"),
        F.sum(F.col("laplacian") * F.col("laplacian")).alias("_ll"),
        F.avg(F.when(v.isNotNull(), F.col("_s"))).alias("raw_under"),
        F.avg(F.when(v.isNotNull(), F.col("_h"))).alias("over"),
        *sums,
    )
    return per_image.select("image_id", *verdict_inputs(limits))


def contrast(images: DataFrame) -> DataFrame:
    """``image_id, contrast``: entropy of the gray histogram, 1 for an even spread over 256 levels."""
    per_level = levels(images)
    sums = per_level.groupBy("image_id").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.ln(F.col("n"))).alias("n_ln_n")
    )
    # -sum(p ln p) with p = n_i / n, from two sums.
    entropy = F.ln(F.col("n")) - F.col("n_ln_n") / F.col("n")
    return sums.select("image_id", (entropy / F.ln(F.lit(256.0))).alias("contrast"))


def _targets(pos: Column, size: Column, cells: int) -> Column:
    """Target cells a source line overlaps, with the overlap in 1/(size*cells) of the edge."""
    # Source line p covers [p*cells, (p+1)*cells); target cell t covers [t*size, (t+1)*size).
    first = F.floor(pos * cells / size).cast("int")
    last = F.floor(((pos + 1) * cells - 1) / size).cast("int")
    return F.transform(
        F.sequence(first, last),
        lambda t: F.struct(
            t.alias("cell"),
            (F.least((pos + 1) * cells, (t + 1) * size) - F.greatest(pos * cells, t * size)).cast("long").alias("part"),
        ),
    )


def shrink(images: DataFrame) -> DataFrame:
    """Area-averaged 9x8 gray image: ``image_id, ty, tx, level`` (rounded half up)."""
    h, w = F.col("height"), F.col("width")
    px = images.select("image_id", "height", "width", F.posexplode("gray").alias("i", "v"))
    px = px.select(
        "image_id",
        "height",
        "width",
        "v",
        F.floor(F.col("i") / w).cast("int").alias("row"),
        (F.col("i") % w).cast("int").alias("col"),
    )
    parts = px.withColumn("ty", F.explode(_targets(F.col("row"), h, HASH_ROWS))).withColumn(
        "tx", F.explode(_targets(F.col("col"), w, HASH_COLS))
    )
    area = F.first("height").cast("long") * F.first("width")
    total = F.sum(F.col("v") * F.col("ty.part") * F.col("tx.part"))
    level = F.floor((2 * total + area) / (2 * area))
    return parts.groupBy("image_id", F.col("ty.cell").alias("ty"), F.col("tx.cell").alias("tx")).agg(
        level.cast("int").alias("level")
    )


def dhash(images: DataFrame) -> DataFrame:
    """``image_id, dhash`` of gray images."""
    # 72 entries per image.
    cells = F.array_sort(F.collect_list(F.struct("ty", "tx", "level")))
    small = shrink(images).groupBy("image_id").agg(cells["level"].alias("levels"))
    return small.select("image_id", dhash_bits(F.col("levels")).alias("dhash"))


def colour_counts(colour: DataFrame) -> DataFrame:
    """Non-empty histogram bins: ``image_id, h_bin, s_bin, n``."""
    hue, saturation = hue_saturation(F.col("r"), F.col("g"), F.col("b"))
    px = colour.select("image_id", F.inline(F.arrays_zip("r", "g", "b")))
    binned = px.select(
        "image_id",
        F.floor(hue * HUE_BINS / HUE_RANGE).cast("int").alias("h_bin"),
        F.floor(saturation * SATURATION_BINS / SATURATION_RANGE).cast("int").alias("s_bin"),
    )
    return binned.groupBy("image_id", "h_bin", "s_bin").agg(F.count(F.lit(1)).alias("n"))


def colour_histogram(colour: DataFrame) -> DataFrame:
    """``image_id, histogram``: all bins scaled by the smallest and largest count."""
    bin_no = F.col("h_bin") * SATURATION_BINS + F.col("s_bin")
    # At most BINS entries per image.
    entries = F.array_sort(F.collect_list(F.struct(bin_no.alias("bin"), "n")))
    rows = colour_counts(colour).groupBy("image_id").agg(
        entries["bin"].alias("bins"), entries["n"].alias("counts"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    histogram = scaled_histogram(F.col("bins"), F.col("counts"), F.col("least"), F.col("most"))
    return rows.select("image_id", histogram.alias("histogram"))


def features(colour: DataFrame, gray: DataFrame) -> DataFrame:
    """Feature rows ``image_id, dhash, histogram, valid``."""
    out = colour_histogram(colour).join(dhash(gray), "image_id")
    return out.select("image_id", "dhash", "histogram", F.lit(True).alias("valid"))


def junk_features(images: DataFrame, rules: JunkRules = JunkRules()) -> DataFrame:
    """``image_id, flat_ratio, unique_ratio, straight_ratio`` of readable images.

    - flat_ratio: blocks of one single level among all blocks
    - unique_ratio: distinct levels per pixel
    - straight_ratio: rows and columns that are one long edge, among all borders
    """
    readable = images.filter(F.col("gray").isNotNull() & (F.size("gray") > 0))
    w, h, side = F.col("width"), F.col("height"), rules.block

    def edge(i: Column, offset: Column, inside: Column) -> Column:
        jump = F.abs(F.get("gray", i) - F.get("gray", (i + offset).cast("int"))) >= rules.edge_step
        return F.when(inside, jump.cast("int"))

    def parts(v: Column, i: Column) -> Column:
        """A pixel as part of its block, of the border below its row and of the border right of its column."""
        row, col = F.floor(i / w).cast("int"), (i % w).cast("int")
        block = F.floor(row / side) * w + F.floor(col / side)

        def part(kind: str, line: Column, level: Column, hit: Column) -> Column:
            return F.struct(
                F.lit(kind).alias("kind"), line.cast("long").alias("line"), level.alias("v"), hit.alias("edge")
            )

        none = F.lit(None).cast("int")
        return F.array(
            part("block", block, v, none),
            part("row", row, none, edge(i, w, row < h - 1)),
            part("column", col, none, edge(i, F.lit(1), col < w - 1)),
        )

    unique = F.size(F.array_distinct("gray")).cast("double") / F.size("gray")
    spread = readable.select("image_id", unique.alias("unique_ratio"), F.inline(F.flatten(F.transform("gray", parts))))
    # One row per block and line, summed before the shuffle; then one row per image.
    lines = spread.groupBy("image_id", "unique_ratio", "kind", "line").agg(
        (F.min("v") == F.max("v")).cast("double").alias("flat"),
        (F.avg("edge") >= rules.straight_share).cast("double").alias("straight"),
    )
    return lines.groupBy("image_id", "unique_ratio").agg(
        F.avg("flat").alias("flat_ratio"), F.coalesce(F.avg("straight"), F.lit(0.0)).alias("straight_ratio")
    )
