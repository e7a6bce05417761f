"""Density clusters of photos in time and space.

Two photos are neighbours when taken within ``max_gap_ms`` and ``max_km`` of each other. A
photo with at least ``min_points`` neighbours, itself included, is a core; cores that
are neighbours share a cluster, other photos join the lowest cluster of a neighbouring
core, and the rest is noise.

Positions are points in space, so neither the date line nor the poles are special. The grid
is fine enough that all photos of one cell are neighbours. So a full cell needs no pairs
at all, a sparse one has few photos to compare, and whether two cells touch is
decided on bounding boxes, refined only where boxes leave it open. The photos of a
place that holds a third of the library are never paired up.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoebox.functions.geo import EARTH_RADIUS_KM
from shoebox.operators.graph import components
from shoebox.operators.skew import spread_join
from shoebox.session import cut, default_blocks

AXES = ["x", "y", "z"]
CELL = ["ct", "cx", "cy", "cz"]


@dataclass(frozen=True)
class Density:
    max_gap_ms: int
    max_km: float
    min_points: int

    @property
    def chord(self) -> float:
        """Straight-line distance of two points ``max_km`` apart on the ground."""
        return 2 * EARTH_RADIUS_KM * math.sin(self.max_km / (2 * EARTH_RADIUS_KM))

    @property
    def side(self) -> float:
        return self.chord / math.sqrt(3)


def _cells(limits: Density, level: int = 0) -> list[Column]:
    scale = float(2**level)
    time = F.floor(F.col("t") / limits.max_gap_ms * scale).alias("ct")
    return [time, *[F.floor(F.col(a) / limits.side * scale).alias(f"c{a}") for a in AXES]]


def place_points(photos: DataFrame, limits: Density) -> DataFrame:
    """``image_id, t, x, y, z`` and grid cell of photos with time and position."""
    lat, lon = F.radians("latitude"), F.radians("longitude")
    usable = photos.filter(
        F.col("taken_unix_ms").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    )
    points = usable.select(
        "image_id",
        F.col("taken_unix_ms").alias("t"),
        (EARTH_RADIUS_KM * F.cos(lat) * F.cos(lon)).alias("x"),
        (EARTH_RADIUS_KM * F.cos(lat) * F.sin(lon)).alias("y"),
        (EARTH_RADIUS_KM * F.sin(lat)).alias("z"),
    )
    return points.select("*", *_cells(limits))


def near_cells(cells: DataFrame, occupied: DataFrame, limits: Density) -> DataFrame:
    """Pairs of cells that may hold neighbours: ``CELL`` columns and ``n_`` twins, the cell itself included.

    Only cells that meet the earth's surface are probed.
    """
    side, r2 = limits.side, EARTH_RADIUS_KM**2
    probed = cells.select(*CELL).repartition(default_blocks(cells.sparkSession))
    # One step either way in time, two along each axis: 375 cells.
    for c, reach in zip(CELL, (1, 2, 2, 2)):
        steps = F.sequence(F.col(c) - reach, F.col(c) + reach)
        probed = probed.select("*", F.explode(steps).alias(f"n_{c}"))
    low, high = F.lit(0.0), F.lit(0.0)
    for a in AXES:
        lo, hi = F.col(f"n_c{a}") * side, (F.col(f"n_c{a}") + 1) * side
        nearest = F.when((lo <= 0) & (hi >= 0), 0.0).otherwise(F.least(F.abs(lo), F.abs(hi)))
        farthest = F.greatest(F.abs(lo), F.abs(hi))
        low, high = low + nearest * nearest, high + farthest * farthest
    on_surface = probed.filter((low <= r2 * (1 + 1e-9)) & (high >= r2 * (1 - 1e-9)))
    there = occupied.select(*[F.col(c).alias(f"n_{c}") for c in CELL])
    # Every cell makes many probes, which size estimates do not see: no broadcast of them.
    return on_surface.hint("merge").join(there, [f"n_{c}" for c in CELL])


def _is_near(limits: Density) -> Column:
    square = sum(((F.col(f"p_{a}") - F.col(a)) * (F.col(f"p_{a}") - F.col(a)) for a in AXES), F.lit(0.0))
    return (F.abs(F.col("p_t") - F.col("t")) <= limits.max_gap_ms) & (square <= limits.chord**2)


def _probes(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """``points`` repeated for each of their near cells, which become the join key."""
    named = points.select(F.col("image_id").alias("p_id"), *[F.col(c).alias(f"p_{c}") for c in ["t", *AXES]], *CELL)
    return named.join(pairs, CELL).select("p_id", "p_t", "p_x", "p_y", "p_z", *[F.col(f"n_{c}").alias(c) for c in CELL])


def cores(points: DataFrame, limits: Density) -> DataFrame:
    """``points`` with ``is_core``. Only photos of sparse cells are compared with others."""
    counts = points.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"))
    counts = cut(counts, "cells")
    sparse = counts.filter(F.col("n") < limits.min_points)
    pairs = cut(near_cells(sparse, counts, limits), "near")
    few = points.join(sparse.select(*CELL), CELL, "left_semi")
    met = spread_join(points, _probes(few, pairs), CELL, ["image_id"], "inner").filter(_is_near(limits))
    enough = met.groupBy("p_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= limits.min_points)
    dense = spread_join(points, counts, CELL, ["image_id"], "inner")
    return (
        dense.join(enough.select(F.col("p_id").alias("image_id"), F.lit(True).alias("met")), "image_id", "left")
        .withColumn("is_core", (F.col("n") >= limits.min_points) | F.col("met").isNotNull())
        .drop("n", "met")
    )


def _boxes(points: DataFrame, limits: Density, level: int) -> DataFrame:
    """Bounding boxes of the points per grid cell of the given fineness, with the coarser cell."""
    sub = [c.alias(f"s{i}") for i, c in enumerate(_cells(limits, level))]
    up = [c.alias(f"u{i}") for i, c in enumerate(_cells(limits, max(0, level - 1)))]
    sizes = [f(c).alias(f"{name}_{c}") for c in ["t", *AXES] for name, f in (("lo", F.min), ("hi", F.max))]
    rows = points.select(*CELL, "t", *AXES, *sub, *up)
    boxes = rows.groupBy(*CELL, *[f"s{i}" for i in range(4)], *[f"u{i}" for i in range(4)]).agg(*sizes)
    return boxes.select(
        F.struct(*CELL).alias("cell"),
        F.struct(*[f"s{i}" for i in range(4)]).alias("sub"),
        F.struct(*[f"u{i}" for i in range(4)]).alias("up"),
        F.struct(*[f"{n}_{c}" for c in ["t", *AXES] for n in ("lo", "hi")]).alias("box"),
    )


def _compare(limits: Density) -> Column:
    """Two boxes: true if all their points are neighbours, false if none, null if open."""
    a, b = F.col("a_box"), F.col("b_box")

    def gaps(c: str) -> tuple[Column, Column]:
        least = F.greatest(a[f"lo_{c}"] - b[f"hi_{c}"], b[f"lo_{c}"] - a[f"hi_{c}"])
        most = F.greatest(a[f"hi_{c}"] - b[f"lo_{c}"], b[f"hi_{c}"] - a[f"lo_{c}"])
        return F.greatest(least, F.lit(0).cast("double")), most

    near, far = F.lit(0.0), F.lit(0.0)
    for axis in AXES:
        least, most = gaps(axis)
        near, far = near + least * least, far + most * most
    soonest, latest = gaps("t")
    limit = limits.chord**2
    return F.when((far <= limit) & (latest <= limits.max_gap_ms), True).when(
        (near > limit) | (soonest > limits.max_gap_ms), False
    )


def touching_cells(core_points: DataFrame, limits: Density, deepest: int = 40) -> DataFrame:
    """Pairs of core cells with at least one neighbouring pair of cores: ``a, b`` (cell structs, a < b)."""
    cells = cut(core_points.select(*CELL).distinct(), "core_cells")
    near = near_cells(cells, cells, limits)
    a, b = F.struct(*CELL), F.struct(*[F.col(f"n_{c}").alias(c) for c in CELL])
    open_pairs = near.select(a.alias("a"), b.alias("b")).filter(F.col("a") < F.col("b"))
    open_pairs = cut(open_pairs.select("*", F.col("a").alias("a_sub"), F.col("b").alias("b_sub")), "open")
    touching: DataFrame | None = None
    for level in range(deepest):
        undecided = open_pairs.select("a.*").union(open_pairs.select("b.*")).distinct()
        boxes = _boxes(core_points.join(undecided, CELL, "left_semi"), limits, level)

        def side(name: str, boxes: DataFrame = boxes) -> DataFrame:
            return boxes.select(
                F.col("cell").alias(name),
                F.col("up").alias(f"{name}_sub"),
                F.col("sub").alias(f"{name}_next"),
                F.col("box").alias(f"{name}_box"),
            )

        tested = (
            open_pairs.join(side("a"), ["a", "a_sub"])
            .join(side("b"), ["b", "b_sub"])
            .select("a", "b", F.col("a_next").alias("a_sub"), F.col("b_next").alias("b_sub"), _compare(limits).alias("hit"))
            .filter(F.col("hit").isNull() | F.col("hit"))
        )
        tested = cut(tested, "tested")
        found = tested.filter("hit").select("a", "b").distinct()
        touching = found if touching is None else touching.unionByName(found)
        open_pairs = tested.filter(F.col("hit").isNull()).drop("hit").join(found, ["a", "b"], "left_anti")
        if open_pairs.isEmpty():
            return touching
    # What is open now lies on the limit to within rounding: the few points left are compared as they are.
    sub = F.struct(*[c.alias(f"s{i}") for i, c in enumerate(_cells(limits, deepest - 1))])
    placed = core_points.select(F.struct(*CELL).alias("cell"), sub.alias("sub"), "t", *AXES)
    first = placed.select(F.col("cell").alias("a"), F.col("sub").alias("a_sub"), *[F.col(c).alias(f"p_{c}") for c in ["t", *AXES]])
    second = placed.withColumnsRenamed({"cell": "b", "sub": "b_sub"})
    exact = open_pairs.join(first, ["a", "a_sub"]).join(second, ["b", "b_sub"]).filter(_is_near(limits))
    return touching.unionByName(exact.select("a", "b").distinct())


def cluster(photos: DataFrame, limits: Density) -> DataFrame:
    """``image_id, cluster_id, is_core`` of photos with time and position.

    A cluster is named by the least id of its cores; noise has none.
    """
    points = cut(cores(place_points(photos, limits), limits), "points")
    core_points = points.filter("is_core")
    cell = F.struct(*CELL).alias("node")
    nodes = core_points.select(cell).distinct()
    labels = components(nodes, touching_cells(core_points, limits))
    by_cell = labels.select("node.*", "label")
    labelled = spread_join(core_points, by_cell, CELL, ["image_id"], "inner")
    names = labelled.groupBy("label").agg(F.min("image_id").alias("cluster_id"))
    named_cells = cut(by_cell.join(names, "label").select(*CELL, "cluster_id"), "named")
    members = spread_join(core_points, named_cells, CELL, ["image_id"], "inner")
    rest = points.filter(~F.col("is_core"))
    pairs = near_cells(rest.select(*CELL).distinct(), named_cells, limits)
    met = spread_join(members, _probes(rest, pairs), CELL, ["image_id"], "inner").filter(_is_near(limits))
    border = met.groupBy(F.col("p_id").alias("image_id")).agg(F.min("cluster_id").alias("cluster_id"))
    return members.select("image_id", "cluster_id", "is_core").unionByName(
        rest.select("image_id", "is_core").join(border, "image_id", "left").select("image_id", "cluster_id", "is_core")
    )
