"""Near-duplicate groups: exact radius search and first-come leader grouping.

Images are taken in id order. An image joins the earliest leader within the
radius, or becomes a leader itself. Only leaders are searched.

How this stays whole and bounded on a cluster:

- Exact copies (equal hash and histogram) collapse first; a copy always lands
  where its first occurrence lands.
- A joint distance within the radius allows at most H differing hash bits. The images are dealt to blocks, and each
  task compares the hashes of two blocks, a small tile at a time. That is about a nanosecond a pair, where
  probing hash bands would meet thousands of joined rows an image.
- Many unrelated images differ in few hash bits. Each row therefore carries a short sketch of its
  histogram that bounds the colour distance from both sides. Most candidates are decided by it
  inside the task, and whole histograms only travel for those between the bounds.
- A search for a few images takes its candidates from equi-joins on hash bands: at least one band
  differs in no more bits than its share of H, so probing the band values within that
  share finds every candidate.
- The images are worked off in growing prefixes of the order. Pairs are only formed inside a
  prefix; its leaders then absorb everything later that lies within the radius.
  A huge group of near copies is thus reduced by its first member and never paired up. The
  size of a prefix follows from an estimate of the pairs it would form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoebox.operators import features as ft
from shoebox.operators.graph import components
from shoebox.operators.ordering import pack, running_sum, segment
from shoebox.operators.skew import spread_join
from shoebox.session import cut, default_blocks

DEFAULT_RADIUS = 0.15
# A prefix that would form too many pairs is cut to this part; each later one is as many times the one before.
PREFIX_GROWTH = 8
PAIRS_PER_BLOCK = 1_000_000  # that one task of a join may form
PROBE_COST = 25  # one probe row costs about as much as this many hash comparisons


SCORE_DIGITS = 12
SKETCH_BINS = 6
BLOCK_SKETCH_BINS = 64  # rows of blocks are copied less often than probes
FIRST_BINS = 16  # of these, compared before the others
BLOCK_ROWS, LEAST_ROWS, FEW_BLOCKS = 1 << 17, 1 << 12, 8  # images of a block at most; where few, blocks enough for all cores
TILE = 32, 4096  # hashes of two blocks compared at a time
PAIRS_HELD = 1 << 18
SKETCH_SAMPLE = 5_000  # images that decide which bins make the sketch; any choice is correct
# Two histograms above this spread never count as constant in the correlation.
FLAT = 1.5e-8
FIRM = 1e-6  # share of a histogram's squares that must be its spread, or rounding blurs the correlation
SLACK = 1e-5  # sketches are single precision


@dataclass(frozen=True)
class Bands:
    """Cover of all pairs within ``max_bits`` differing hash bits.

    Band i holds bits [offset_i, offset_i + width_i) and is probed with every
    value differing in at most share_i bits. The shares satisfy
    sum(share_i + 1) = max_bits + 1, so a pair exceeding every share differs in more than max_bits bits.
    """

    max_bits: int
    offsets: tuple[int, ...]
    widths: tuple[int, ...]
    shares: tuple[int, ...]

    def probes(self) -> int:
        return sum(_ball(w, s) for w, s in zip(self.widths, self.shares))


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def _split(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def plan_bands(radius: float, rows: int) -> Bands:
    """The cover with the least expected work for ``rows`` images."""
    max_bits = min(ft.HASH_BITS, math.floor(ft.HASH_BITS * radius / ft.HASH_WEIGHT + 1e-6))
    best = None
    for count in range(1, min(max_bits + 1, 32) + 1):
        widths = _split(ft.HASH_BITS, count)
        shares = [s - 1 for s in _split(max_bits + 1, count)]
        if any(_ball(w, s) > 20_000 for w, s in zip(widths, shares)):
            continue
        work = sum(_ball(w, s) * (PROBE_COST + rows / 2**w) for w, s in zip(widths, shares))
        if best is None or work < best[0]:
            best = (work, widths, shares)
    _, widths, shares = best
    offsets = [sum(widths[:i]) for i in range(len(widths))]
    return Bands(max_bits, tuple(offsets), tuple(widths), tuple(shares))


def _band_value(dhash: Column, offset: int, width: int) -> Column:
    mask = (1 << width) - 1 if width < ft.HASH_BITS else -1
    return F.shiftrightunsigned(dhash, offset).bitwiseAND(F.lit(mask).cast("long"))


def _masks(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(width), k)]


def index_rows(df: DataFrame, bands: Bands) -> DataFrame:
    """One row per image and band: its own value."""
    own = [
        F.struct(F.lit(i).alias("band"), _band_value(F.col("dhash"), o, w).alias("value"))
        for i, (o, w) in enumerate(zip(bands.offsets, bands.widths))
    ]
    return df.select("rank", "dhash", "sketch", F.inline(F.array(*own)))


def probe_rows(df: DataFrame, bands: Bands) -> DataFrame:
    """One row per image, band and probed value."""

    def probed(band: int, offset: int, width: int, share: int) -> Column:
        own = _band_value(F.col("dhash"), offset, width)
        return F.transform(
            F.lit(_masks(width, share)),
            lambda mask: F.struct(F.lit(band).alias("band"), own.bitwiseXOR(mask).alias("value")),
        )

    parts = [probed(i, o, w, s) for i, (o, w, s) in enumerate(zip(bands.offsets, bands.widths, bands.shares))]
    return df.select("rank", "dhash", "sketch", F.inline(F.concat(*parts)))


def _unit(histogram: Column, moments: Column) -> Column:
    """Histogram shifted to mean zero and scaled to length one; products are correlations."""
    mean = moments["s"] / moments["n"]
    length = F.sqrt(moments["ss"] - moments["s"] * mean)
    return F.transform(histogram, lambda x: (x - mean) / length)


def _varied(moments: Column) -> Column:
    squares = moments["n"] * moments["ss"]
    spread = squares - moments["s"] * moments["s"]
    return (spread >= FLAT) & (spread >= FIRM * squares)


def sketch_bins(features: DataFrame, images: int, most: int = SKETCH_BINS) -> list[int]:
    """The bins that vary most, from a sample."""
    some = features.filter(_varied(F.col("moments"))).filter(
        F.pmod(F.xxhash64("image_id"), F.lit(max(1, images // SKETCH_SAMPLE))) == 0
    )
    bins = some.select(F.posexplode(_unit(F.col("histogram"), F.col("moments"))).alias("bin", "x"))
    spread = bins.groupBy("bin").agg(F.var_pop("x").alias("v"))
    return sorted(r.bin for r in spread.orderBy(F.desc("v"), "bin").limit(most).collect())


def sketch(histogram: Column, moments: Column, bins: list[int]) -> Column:
    """The unit histogram at ``bins`` and the length of its remainder; null for a constant one.

    Half the squared difference of two sketches never exceeds the colour distance: the
    remainders are at least as far apart as their lengths differ.
    """
    mean = moments["s"] / moments["n"]
    length = F.sqrt(moments["ss"] - moments["s"] * mean)
    parts = [(F.get(histogram, F.lit(b)) - mean) / length for b in bins]
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - sum((x * x for x in parts), F.lit(0.0))))
    columns = [x.cast("float").alias(f"f{i}") for i, x in enumerate([*parts, rest])]
    return F.when(_varied(moments), F.struct(*columns))


def sketch_array(histogram: Column, moments: Column, bins: list[int]) -> Column:
    """The values of ``sketch`` as an array, of NaN for a constant histogram; many bins would be too many columns."""
    mean = moments["s"] / moments["n"]
    length = F.sqrt(moments["ss"] - moments["s"] * mean)
    parts = F.transform(F.lit(bins).cast("array<int>"), lambda b: F.get(histogram, b) - mean)
    square = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x * x)
    rest = F.sqrt(F.greatest(F.lit(0.0), 1 - square / (length * length)))
    whole = F.concat(F.transform(parts, lambda x: x / length), F.array(rest)).cast("array<float>")
    return F.when(_varied(moments), whole).otherwise(F.array_repeat(F.lit(float("nan")).cast("float"), len(bins) + 1))


def _colour_bound(a: Column, b: Column, size: int) -> Column:
    square = sum(((a[f"f{i}"] - b[f"f{i}"]) * (a[f"f{i}"] - b[f"f{i}"]) for i in range(size)), F.lit(0.0))
    return F.coalesce(square / 2, F.lit(0.0))


def hash_candidates(
    earlier: DataFrame, later: DataFrame, bands: Bands, radius: float, ordered: bool = True
) -> DataFrame:
    """Pairs ``a < b`` (ranks) that may lie within ``radius``; each once. Inputs carry ``rank, dhash, sketch``.

    Without ``ordered`` every ``a`` of ``earlier`` meets all others in ``later``.

    One image makes many probe rows, which size estimates do not see: the sort-merge
    hint keeps them from being broadcast, and the rows are spread before they are multiplied.
    """
    n = default_blocks(earlier.sparkSession)
    probe = probe_rows(earlier.repartition(n, "rank"), bands).select(
        F.col("rank").alias("a"), F.col("dhash").alias("ha"), F.col("sketch").alias("sa"), "band", "value"
    )
    index = index_rows(later, bands).select(
        F.col("rank").alias("b"), F.col("dhash").alias("hb"), F.col("sketch").alias("sb"), "band", "value"
    )
    # Many images may share a band value: split those buckets.
    pairs = spread_join(index, probe, ["band", "value"], ["b"], "inner", hint="merge")
    diff = F.col("ha").bitwiseXOR(F.col("hb"))
    # A pair may meet in several bands; it counts in the first one that covers it.
    first = F.lit(None)
    for i in reversed(range(len(bands.widths))):
        hit = F.bit_count(_band_value(diff, bands.offsets[i], bands.widths[i])) <= bands.shares[i]
        first = F.when(hit, i).otherwise(first)
    size = len(earlier.schema["sketch"].dataType.fields)
    colour = _colour_bound(F.col("sa"), F.col("sb"), size)
    least = ft.COLOUR_WEIGHT * colour + ft.HASH_WEIGHT * (F.bit_count(diff) / ft.HASH_BITS)
    return pairs.filter(
        (F.col("a") < F.col("b") if ordered else F.col("a") != F.col("b"))
        & (F.bit_count(diff) <= bands.max_bits)
        & (least <= radius + SLACK)
        & (F.col("band") == first)
    ).select("a", "b")


def _block_count(rows: int) -> int:
    return max(1, -(-rows // BLOCK_ROWS), min(FEW_BLOCKS, -(-rows // LEAST_ROWS)))


def _near(a: tuple, b: tuple, max_bits: int, radius: float, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of the pairs of two blocks (hashes, sketches) that may lie within ``radius``, and whether they surely do, about PAIRS_HELD at most at a time.

    If both are the ``same`` block, some of the pairs of a later row with an earlier one are left out.
    """
    (ha, sa), (hb, sb) = a, b
    fa, fb = (np.ascontiguousarray(s[:, : min(FIRST_BINS, s.shape[1] - 1)]) for s in (sa, sb))
    most = TILE[0] * TILE[1]
    diff, bits, low = np.empty(most, np.uint64), np.empty(most, np.uint8), np.zeros(-(-most // 8) * 8, bool)

    def bounded(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, n = (np.concatenate(x) for x in zip(*found))
        # Twice the colour distance that is left; an image without a sketch (NaN) is as near as its hash.
        room = 2 * (radius - ft.HASH_WEIGHT * (n / ft.HASH_BITS)) / ft.COLOUR_WEIGHT
        slack = 2 * SLACK / ft.COLOUR_WEIGHT
        part = fa[i] - fb[j]
        on = ~(np.einsum("ij,ij->i", part, part) > room + slack)
        i, j, room = i[on], j[on], room[on]
        part = sa[i] - sb[j]
        rest, part = part[:, -1], part[:, :-1]
        square = np.einsum("ij,ij->i", part, part)
        on = ~(square + rest * rest > room + slack)
        i, j = i[on], j[on]
        # The remainders are at most as far apart as their lengths add up to.
        return i, j, square[on] + (sa[i, -1] + sb[j, -1]) ** 2 <= room[on] - slack

    for top in range(0, len(ha), TILE[0]):
        found, held = [], 0
        rows = ha[top : top + TILE[0], None]
        for left in range(top // TILE[1] * TILE[1] if same else 0, len(hb), TILE[1]):
            columns = hb[None, left : left + TILE[1]]
            size = len(rows) * columns.shape[1]
            d, n, m = diff[:size], bits[:size], low[: -(-size // 8) * 8]
            np.bitwise_xor(rows, columns, out=d.reshape(len(rows), -1))
            np.bitwise_count(d, out=n)
            np.less_equal(n, max_bits, out=m[:size])
            m[size:] = False
            # Few are near: eight at a time are looked at.
            words = np.flatnonzero(m.view(np.uint64))
            if len(words):
                at, inner = np.nonzero(m.reshape(-1, 8)[words])
                at = words[at] * 8 + inner
                i, j = np.divmod(at, columns.shape[1])
                found.append((i + top, j + left, n[at]))
                held += len(i)
                if held >= PAIRS_HELD:
                    yield bounded(found)
                    found, held = [], 0
        if found:
            yield bounded(found)


def block_pairs(earlier: DataFrame, later: DataFrame | None, radius: float, first: bool = False) -> DataFrame:
    """Pairs ``a < b`` (ranks) of ``earlier`` with ``later``, or within ``earlier`` if that is None, that may lie within ``radius``; each once.

    ``sure`` says that they do; the others are still to be compared. With ``first``, pairs of a ``b`` behind one that is sure
    may be left out: the least ``a`` within the radius is among those that stay.
    Inputs carry ``rank, dhash, sketch`` (columns or arrays) and are read for their counts too. Each task holds two blocks of rows.
    """
    max_bits = min(ft.HASH_BITS, math.floor(ft.HASH_BITS * radius / ft.HASH_WEIGHT + 1e-6))
    within = later is None
    rows_high = earlier.count()
    high = _block_count(rows_high)
    wide = high if within else _block_count(later.count())
    if not within:
        # Where one side has blocks enough for all cores, the other is not cut further.
        high = min(high, max(-(-rows_high // BLOCK_ROWS), FEW_BLOCKS * FEW_BLOCKS // wide, 1))

    def dealt(df: DataFrame, own: int, others: int) -> DataFrame:
        sketch = F.col("sketch")
        if isinstance(kind := df.schema["sketch"].dataType, T.StructType):
            sketch = F.array(*[F.coalesce(sketch[f], F.lit(float("nan")).cast("float")) for f in kind.names])
        flat = df.select("rank", "dhash", sketch.alias("sketch"))
        block = F.pmod(F.xxhash64("rank"), F.lit(own)).cast("int")
        return flat.select("*", block.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("other"))

    if within:
        side = F.sign(F.col("own") - F.col("other")).cast("int")
        rows = dealt(earlier, high, high).withColumns({"cell": F.least("own", "other") * high + F.greatest("own", "other"), "side": side})
    else:
        above = dealt(earlier, high, wide).withColumns({"cell": F.col("own") * wide + F.col("other"), "side": F.lit(-1)})
        below = dealt(later, wide, high).withColumns({"cell": F.col("other") * wide + F.col("own"), "side": F.lit(1)})
        rows = above.unionByName(below)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        side, rank, dhash = (table.column(c).to_numpy() for c in ("side", "rank", "dhash"))
        sketches = np.concatenate([c.flatten().to_numpy() for c in table.column("sketch").chunks]).reshape(len(rank), -1)
        del held, table
        # Both sides of a cell on the diagonal are the same rows.
        (ra, *a), (rb, *b) = ((rank[on], dhash[on].view(np.uint64), sketches[on]) for on in (side <= 0, side >= 0))
        del sketches
        same, kept, size = within and (side == 0).all(), [], 0
        least = np.full(len(rb), np.iinfo(np.int64).max)

        def made(kept: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([np.concatenate(c) for c in zip(*kept)], names=["a", "b", "sure"])

        for i, j, sure in _near(a, b, max_bits, radius, same):
            x, y = ra[i], rb[j]
            if within:
                x, y = np.minimum(x, y), np.maximum(x, y)
            # An image may come in several rows.
            on = (x < y) & (i < j) if same else x < y
            x, y, j, sure = x[on], y[on], j[on], sure[on]
            if first:
                np.minimum.at(least, j[sure], x[sure])
                on = ~sure & (x < least[j])
                x, y, sure = x[on], y[on], sure[on]
            kept, size = [*kept, (x, y, sure)], size + len(x)
            if size >= PAIRS_HELD:
                yield made(kept)
                kept, size = [], 0
        if first:
            on = least < np.iinfo(np.int64).max
            kept.append((least[on], rb[on], np.ones(on.sum(), bool)))
        if kept:
            yield made(kept)

    # A cell is a partition of its own: its work follows from the pairs, not from the bytes.
    cells = rows.repartitionById(high * wide, F.col("cell")).select("rank", "dhash", "sketch", "side")
    return cells.mapInArrow(compare, "a long, b long, sure boolean")


def block_candidates(earlier: DataFrame, later: DataFrame | None, radius: float) -> DataFrame:
    """All pairs of ``block_pairs``, without what is known of them."""
    return block_pairs(earlier, later, radius).select("a", "b")


def _side(features: DataFrame, side: str) -> DataFrame:
    return features.select(
        F.col("rank").alias(side),
        F.col("dhash").alias(f"h_{side}"),
        F.col("histogram").alias(f"x_{side}"),
        F.col("moments").alias(f"m_{side}"),
    )


def with_distance(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """``a, b, hamming, hist_distance, distance`` of pairs of images.

    Nothing here needs the pairs of an image together, so Spark splits those of one that occurs very often.
    """
    both = pairs.join(_side(features, "b"), "b").join(_side(features, "a"), "a")
    corr = ft.correlation(F.col("x_a"), F.col("x_b"), F.col("m_a"), F.col("m_b"))
    scored = both.select("a", "b", ft.hamming(F.col("h_a"), F.col("h_b")).alias("hamming"), corr.alias("corr"))
    return scored.select(
        "a",
        "b",
        "hamming",
        ft.histogram_distance(F.col("corr")).alias("hist_distance"),
        ft.joint_distance(F.col("corr"), F.col("hamming"), F.lit(True)).alias("distance"),
    )


def _edges(earlier: DataFrame, later: DataFrame | None, features: DataFrame, radius: float) -> DataFrame:
    """All pairs within the radius; with ``later``, the least ``a`` of each ``b`` at least."""
    pairs = cut(block_pairs(earlier, later, radius, first=later is not None), "candidates")
    near = with_distance(pairs.filter("NOT sure").select("a", "b"), features).filter(F.col("distance") <= radius)
    return pairs.filter("sure").select("a", "b").unionByName(cut(near.select("a", "b"), "edges"))


def _settle_round(links: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """One round over links ``a, b, odd``: the links left, the images covered, and those of them whose links are still to be read.

    A link says that ``b`` is covered if ``a`` leads (``odd`` 0), or if ``a`` is covered (1). Images without a link to
    them lead, but for those ``known`` to be covered. ``known`` is only there after a contraction, as are odd links.
    """
    leads = links.select("a").distinct().join(links.select(F.col("b").alias("a")), "a", "left_anti")
    if known is None:
        covered = links.join(leads, "a", "left_semi").select("b").distinct()
        read, later = leads, None
    else:
        leads = leads.join(known.select(F.col("b").alias("a")), "a", "left_anti")
        state = leads.withColumn("lead", F.lit(1)).unionByName(known.select(F.col("b").alias("a"), F.lit(0).alias("lead")))
        stated = links.join(state, "a")
        covered = cut(stated.filter(F.col("lead") != F.col("odd")).select("b").distinct(), "covered")
        later = links.filter("odd = 1").join(covered.select(F.col("b").alias("a")), "a", "left_semi").select("b").distinct()
        later = later.join(covered, "b", "left_anti")
        read = state.select("a")
    done = covered if later is None else covered.unionByName(later)
    still = (
        links.join(read, "a", "left_anti")
        .join(covered.select(F.col("b").alias("a")), "a", "left_anti")
        .join(done, "b", "left_anti")
    )
    # Covered images (without an ``a``) and the links still open, settled in one write.
    marks = covered.select(F.lit(None).cast("long").alias("a"), "b", F.lit(0).alias("odd"))
    rows = still.unionByName(marks)
    if later is not None:
        rows = rows.unionByName(later.select(F.lit(None).cast("long").alias("a"), "b", F.lit(1).alias("odd")))
    step = cut(rows, "round")
    new = step.filter(F.col("a").isNull())
    return step.filter(F.col("a").isNotNull()), new.select("b"), None if later is None else new.filter("odd = 1").select("b")


def _contract(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Skip images whose state follows from one other image; also the images this shows to be covered.

    An image with a single link to it is the opposite of the image there, or the same where the link is odd. Such steps
    compose: pointers double until each of these images points at one that is not of the kind, in as many rounds
    as the logarithm of the longest run. All links then start at such ends. One that is linked both ways, evenly and oddly, to the
    same end is covered either way.
    """
    single = links.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.first("a").alias("to"), F.first("odd").alias("odd")).filter("n = 1")
    points = cut(single.select("b", "to", (1 - F.col("odd")).alias("flip")), "points")
    while True:
        onward = points.select(F.col("b").alias("to"), F.col("to").alias("next"), F.col("flip").alias("turn"))
        moved = spread_join(points, onward, ["to"], ["b"])
        points = cut(
            moved.select("b", F.coalesce("next", "to").alias("to"), F.col("flip").bitwiseXOR(F.coalesce("turn", F.lit(0))).alias("flip"), F.col("next").isNotNull().alias("more")),
            "points",
        )
        if points.filter("more").isEmpty():
            break
        points = points.drop("more")
    ends = points.select(F.col("b").alias("a"), "to", "flip")
    skipped = spread_join(links, ends, ["a"], ["b"])
    skipped = skipped.select(F.coalesce("to", "a").alias("a"), "b", F.col("odd").bitwiseXOR(F.coalesce("flip", F.lit(0))).alias("odd")).distinct()
    skipped = cut(skipped, "skipped")
    both = skipped.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select("b").distinct()
    covered = cut(both, "both")
    return skipped.join(covered, "b", "left_anti"), covered


def non_leaders(edges: DataFrame, rounds: int = 4, walk_edges: int = 500_000) -> DataFrame:
    """Ranks of images that are not leaders, given all pairs ``a < b`` within the radius.

    Each round, an image without an earlier open neighbour leads and its neighbours are covered;
    their own pairs then no longer count. That settles all but long chains, as in a slow pan, where each image resembles the
    next. After every ``rounds`` rounds these are contracted. Where images resemble several earlier ones, a
    contraction alone may leave chains, so the connected components are then walked in order, each one a task, by
    ``walk_edges`` links a time. A component of any size moves on by as many.
    """
    links = edges.select("a", "b", F.lit(0).alias("odd"))
    covered, passed, known = links.select(F.col("b").alias("rank")).limit(0), 0, None
    while not links.isEmpty():
        links, new, known = _settle_round(links, known)
        covered, passed = covered.unionByName(new.select(F.col("b").alias("rank"))), passed + 1
        if known is not None and known.isEmpty():
            known = None if links.filter("odd = 1").isEmpty() else known
        if passed % rounds == 0 and not links.isEmpty():
            # The state of covered images must have been read before their links are skipped.
            while known is not None and not known.isEmpty():
                links, new, known = _settle_round(links, known)
                covered = covered.unionByName(new.select(F.col("b").alias("rank")))
            if passed % (2 * rounds) == 0:
                links, known = _walk_components(links, walk_edges)
            else:
                links, known = _contract(links)
            covered = covered.unionByName(known.select(F.col("b").alias("rank")))
    return covered


def _walk_components(links: DataFrame, walk_edges: int) -> tuple[DataFrame, DataFrame]:
    """Walk the earliest ``walk_edges`` links of each connected component: the links left, and the images found covered."""
    nodes = links.select(F.col("a").alias("node")).union(links.select("b")).distinct()
    labels = components(nodes, links.select("a", "b")).withColumnRenamed("node", "a")
    labelled = cut(spread_join(links, labels, ["a"], ["b"], "inner"), "labelled")
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("b", F.lit(0.0)).alias("first"))
    large = sizes.filter(F.col("n") > walk_edges).select("label", "n", "first")
    ends = sizes.filter(F.col("n") <= walk_edges).select("label", F.lit(None).cast("long").alias("end"))
    # Of a large component, the links to its earliest images, of which there are about as many as are asked for.
    share = F.lit(float(walk_edges)) / F.col("n")
    quantiles = spread_join(labelled, large, ["label"], ["b"], "inner").groupBy("label").agg(
        F.percentile_approx("b", F.array(*[F.lit(i / 1000) for i in range(1001)]), 100_000).alias("q"), F.first("n").alias("n")
    )
    ends = ends.unionByName(quantiles.select("label", F.get("q", F.floor(share * 1000).cast("int")).alias("end")))
    dealt = cut(spread_join(labelled, ends, ["label"], ["b"], "inner").withColumn("now", F.coalesce(F.col("b") <= F.col("end"), F.lit(True))), "dealt")

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        state: dict[int, int] = {}
        order = rows.sort_values("b", kind="stable")
        # An image leads unless some link covers it; links come by their later end, so all earlier states are known.
        for b, a, odd in zip(order["b"].tolist(), order["a"].tolist(), order["odd"].tolist()):
            if state.setdefault(a, 1) != odd:
                state[b] = 0
            else:
                state.setdefault(b, 1)
        return pd.DataFrame({"node": list(state), "lead": list(state.values())}, dtype="int64")

    walked = cut(dealt.filter("now").select("label", "a", "b", "odd").groupBy("label").applyInPandas(walk, "node long, lead long"), "walked")
    rest = dealt.filter(~F.col("now")).select("a", "b", "odd")
    stated = spread_join(rest, walked.withColumnRenamed("node", "a"), ["a"], ["b"])
    # A link from a walked image is read here; the others stay.
    met = stated.filter(F.col("lead") != F.col("odd")).select("b").distinct()
    covered = walked.filter("lead = 0").select(F.col("node").alias("b"))
    met = cut(met.join(covered, "b", "left_anti"), "met")
    left = stated.filter(F.col("lead").isNull()).select("a", "b", "odd").join(met, "b", "left_anti")
    return cut(left, "left"), cut(covered.unionByName(met), "walked")


def _ranked(features: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """Distinct features in id order, and the copies that stand behind each.

    Returns ``rank, rep_id, dhash, sketch, histogram, moments``, then ``image_id, rep_id``,
    and the number of rows of both.
    """
    signature = F.sha2(F.col("histogram").cast("string"), 256)
    valid = cut(
        features.filter("valid").select(
            "image_id", "dhash", "histogram", signature.alias("signature"), ft.moments(F.col("histogram")).alias("moments")
        ),
        "valid",
    )
    images = valid.count()
    keys = valid.select("image_id", "dhash", "signature")
    reps = keys.groupBy("dhash", "signature").agg(F.min("image_id").alias("rep_id"))
    one = F.lit(1).cast("long").alias("one")
    ranks = running_sum(reps.withColumn("one", one), ["rep_id"], {"rank": "one"})
    distinct = ranks.count()
    if distinct == images:
        copies = valid.select("image_id", F.col("image_id").alias("rep_id"))
    else:
        same = keys.join(ranks, ["dhash", "signature"])
        copies = same.select("image_id", "rep_id")
    table = valid.select(F.col("image_id").alias("rep_id"), "dhash", "histogram", "moments").join(
        ranks.select("rep_id", "rank"), "rep_id"
    )
    bins = sketch_bins(valid, images, BLOCK_SKETCH_BINS)
    table = table.withColumn("sketch", sketch_array(F.col("histogram"), F.col("moments"), bins))
    return cut(table, "features"), copies, distinct, images


def _prefix_end(open_rows: DataFrame, left: int, last: int, wanted: int, radius: float, budget: int) -> int:
    """Last rank of the next prefix: about ``wanted`` open images, fewer while they would form too many pairs."""
    size = wanted
    while True:
        ahead = last if size >= left else open_rows.agg(F.percentile_approx("rank", size / left, 100_000)).first()[0]
        if size <= 1:
            return ahead
        batch = open_rows.filter(F.col("rank") <= ahead)
        every = max(1, size // 256)
        probes = batch.filter(F.pmod(F.xxhash64("rank"), F.lit(every)) == 0)
        found = block_candidates(probes, batch, radius).count()
        if found * every <= budget:
            return ahead
        size = max(1, size // PREFIX_GROWTH)


def assign_leaders(
    features: DataFrame,
    radius: float = DEFAULT_RADIUS,
    first_prefix: int | None = None,
    pair_budget: int | None = None,
) -> DataFrame:
    """``image_id, leader_id`` for every valid image; a leader is its own.

    ``features`` has ``image_id, dhash, histogram, valid``; invalid images take no part. The first prefix is of
    ``first_prefix`` images, or all; a prefix is made smaller until it forms at most ``pair_budget`` pairs.
    """
    table, copies, total, images = _ranked(features)
    narrow = table.select("rank", "dhash", "sketch")
    open_rows, left = narrow, total
    settled: list[DataFrame] = []
    wanted = first_prefix or total
    budget = pair_budget or PAIRS_PER_BLOCK * default_blocks(features.sparkSession)
    while left > 0:
        end = _prefix_end(open_rows, left, total, min(wanted, left), radius, budget)
        batch = open_rows.filter(F.col("rank") <= end)
        edges = _edges(batch, None, table, radius)
        covered = non_leaders(edges)
        leaders = cut(batch.join(covered, "rank", "left_anti"), "leaders")
        settled.append(leaders.select("rank", F.col("rank").alias("leader")))
        joined = edges.join(leaders.select(F.col("rank").alias("a")), "a", "left_semi")
        settled.append(joined.groupBy(F.col("b").alias("rank")).agg(F.min("a").alias("leader")))
        if end >= total:
            break
        rest = open_rows.filter(F.col("rank") > end)
        near = _edges(leaders, rest, table, radius)
        absorbed = near.groupBy(F.col("b").alias("rank")).agg(F.min("a").alias("leader"))
        settled.append(absorbed)
        open_rows = cut(rest.join(absorbed, "rank", "left_anti"), "open")
        done_before, left = left, open_rows.count()
        wanted = min(wanted * PREFIX_GROWTH, done_before)
    ids = table.select("rank", "rep_id")
    if not settled:
        return copies.select("image_id", F.col("rep_id").alias("leader_id")).limit(0)
    every = settled[0]
    for part in settled[1:]:
        every = every.unionByName(part)
    leader_ids = ids.select(F.col("rank").alias("leader"), F.col("rep_id").alias("leader_id"))
    named = every.join(leader_ids, "leader")
    by_rep = named.join(ids, "rank").select("rep_id", "leader_id")
    if images > total:
        by_rep = copies.join(by_rep, "rep_id")
    else:
        by_rep = by_rep.withColumnRenamed("rep_id", "image_id")
    return cut(by_rep.select("image_id", "leader_id"), "assigned")


def search(targets: DataFrame, features: DataFrame, radius: float = DEFAULT_RADIUS) -> DataFrame:
    """All images within ``radius`` of the given ones: ``target_id, image_id, hamming, hist_distance, distance``.

    ``targets`` names images of ``features`` by ``image_id``. Only targets are probed, the library is indexed once.
    """
    valid = features.filter("valid").select("image_id", "dhash", "histogram", ft.moments(F.col("histogram")).alias("moments"))
    valid = cut(valid, "valid")
    images = valid.count()
    bins = sketch_bins(valid, images)
    table = valid.withColumn("sketch", sketch(F.col("histogram"), F.col("moments"), bins)).withColumnRenamed("image_id", "rank")
    asked = targets.select(F.col("image_id").alias("rank")).distinct()
    narrow = table.select("rank", "dhash", "sketch")
    pairs = hash_candidates(narrow.join(asked, "rank", "left_semi"), narrow, plan_bands(radius, images), radius, ordered=False)
    near = with_distance(cut(pairs, "candidates"), table).filter(F.col("distance") <= radius)
    return near.withColumnsRenamed({"a": "target_id", "b": "image_id"})


def leader_distances(assigned: DataFrame, features: DataFrame) -> DataFrame:
    """Hash, colour and joint distance of every image to its leader."""
    ranked = features.select(
        F.col("image_id").alias("rank"), "dhash", "histogram", ft.moments(F.col("histogram")).alias("moments")
    )
    pairs = assigned.select(F.col("leader_id").alias("a"), F.col("image_id").alias("b"))
    out = with_distance(pairs, ranked)
    return out.withColumnsRenamed({"a": "leader_id", "b": "image_id"})


def groups(assigned: DataFrame) -> DataFrame:
    """Groups of at least two images: ``group_id, raw_group_idx, leader_id, size``.

    ``group_id`` counts such groups in leader order from 1; ``raw_group_idx``
    counts all leaders from 0, single images included.
    """
    sizes = assigned.groupBy("leader_id").agg(F.count(F.lit(1)).alias("size")).withColumns(
        {"one": F.lit(1).cast("long"), "big": (F.col("size") >= 2).cast("long")}
    )
    numbered = running_sum(sizes, ["leader_id"], {"seen": "one", "group_id": "big"})
    return numbered.filter("size >= 2").select(
        "group_id", (F.col("seen") - 1).alias("raw_group_idx"), "leader_id", "size"
    )


def members(assigned: DataFrame, found: DataFrame) -> DataFrame:
    """``group_id, image_id`` of all group members."""
    numbers = found.select("leader_id", "group_id")
    return spread_join(assigned, numbers, ["leader_id"], ["image_id"], "inner").select("group_id", "image_id")


@dataclass(frozen=True)
class ScoreWeights:
    """Weights of sharpness, contrast and (where known) face quality."""

    sharpness: float = 0.6
    contrast: float = 0.4
    face: float = 0.5


def score(
    group_members: DataFrame, quality: DataFrame, weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    """Add ``score`` to members.

    ``quality`` has ``image_id, sharpness, contrast`` and optionally ``face_score``. Sharpness
    counts relative to the sharpest of the group; weights are rescaled to
    sum to 1 over the parts that are known. A member without metrics has no score.
    """
    if "face_score" not in quality.columns:
        quality = quality.withColumn("face_score", F.lit(None).cast("double"))
    rated = group_members.join(quality.select("image_id", "sharpness", "contrast", "face_score"), "image_id", "left")
    top = rated.groupBy("group_id").agg(F.max("sharpness").alias("top"))
    rated = spread_join(rated, top, ["group_id"], ["image_id"], "inner")
    known = F.col("sharpness").isNotNull() & F.col("contrast").isNotNull()
    relative = F.when(F.col("top") > 0, F.col("sharpness") / F.col("top")).otherwise(0.0)
    face = F.when(F.col("face_score").isNotNull(), weights.face).otherwise(0.0)
    sum_of = (
        weights.sharpness * relative
        + weights.contrast * F.col("contrast")
        + face * F.coalesce(F.col("face_score"), F.lit(0.0))
    )
    return rated.select(
        "group_id", "image_id", F.when(known, sum_of / (weights.sharpness + weights.contrast + face)).alias("score")
    )


def best_first(scored: DataFrame, blocks: int | None = None) -> DataFrame:
    """``group_id, rank, image_id, score, is_keeper``.

    Scores equal to SCORE_DIGITS digits tie and go to the earlier image; members without score come last.
    """
    by_worst = scored.withColumn("_worse", F.coalesce(-F.round("score", SCORE_DIGITS), F.lit(float("inf"))))
    ordered = segment(by_worst, ["group_id", "_worse", "image_id"], ["group_id"], blocks=blocks)
    return ordered.select(
        "group_id", F.col("pos").alias("rank"), "image_id", "score", (F.col("pos") == 1).alias("is_keeper")
    )


def keepers(ranked: DataFrame) -> DataFrame:
    """Recommended image per group."""
    return ranked.filter("is_keeper").select("group_id", F.col("image_id").alias("recommended_id"))


def member_arrays(ranked: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Best-first ids with parallel scores per group, in chunks of bounded length."""
    return pack(ranked, ["group_id"], "rank", {"image_ids": "image_id", "member_scores": "score"}, chunk)


def summary(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_images"))
