"""Leader grouping against the sequential definition."""

import random

import pytest
from pyspark.sql import functions as F

from shoebox.operators import features as ft
from shoebox.operators import similar

SCHEMA = "image_id long, dhash long, histogram array<double>, valid boolean"


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def _features(seed, n=220, hot=0.0):
    """Random scenes with copies; a share ``hot`` of the images are variations of one scene."""
    rng = random.Random(seed)
    scenes = [(rng.getrandbits(64), [rng.random() for _ in range(6)]) for _ in range(25)]
    rows = []
    for i in range(n):
        bits, hist = scenes[0] if rng.random() < hot else rng.choice(scenes)
        for _ in range(rng.choice([0, 0, 2, 6, 12])):
            bits ^= 1 << rng.randrange(64)
        if rng.random() < 0.5:
            hist = [h + rng.uniform(-0.15, 0.15) for h in hist]
        rows.append((i * 3, _signed(bits), hist, rng.random() > 0.05))
    return rows


def _distance(a, b):
    n = len(a[2])
    ma, mb = sum(a[2]) / n, sum(b[2]) / n
    num = sum((x - ma) * (y - mb) for x, y in zip(a[2], b[2]))
    den = (sum((x - ma) ** 2 for x in a[2]) * sum((y - mb) ** 2 for y in b[2])) ** 0.5
    corr = num / den if den else 1.0
    return 0.4 * (1 - max(-1, min(1, corr))) + 0.6 * bin((a[1] ^ b[1]) & (2**64 - 1)).count("1") / 64


def _sequential(rows, radius):
    leaders, out = [], {}
    for row in sorted(r for r in rows if r[3]):
        found = next((lead for lead in leaders if _distance(lead, row) <= radius), None)
        if found is None:
            leaders.append(row)
        out[row[0]] = (found or row)[0]
    return out


@pytest.mark.parametrize(
    "seed,radius,hot,prefix,budget",
    [(1, 0.15, 0.0, 8192, 10**8), (2, 0.15, 0.5, 20, 10**8), (3, 0.05, 0.3, 16, 40), (4, 0.3, 0.3, 64, 500)],
)
def test_leaders_equal_sequential(spark, seed, radius, hot, prefix, budget):
    rows = _features(seed, hot=hot)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = similar.assign_leaders(df, radius, first_prefix=prefix, pair_budget=budget)
    assert {r.image_id: r.leader_id for r in got.collect()} == _sequential(rows, radius)


@pytest.mark.parametrize("rows", [10**6, 40])
def test_blocks_meet_every_pair_once(spark, monkeypatch, rows):
    monkeypatch.setattr(similar, "BLOCK_ROWS", rows)
    made = [r for r in _features(6, n=200, hot=0.3) if r[3]] + [(10**6, 7, [0.5] * 6, True), (10**6 + 1, 6, [0.5] * 6, True)]
    df = spark.createDataFrame(made, SCHEMA).withColumnRenamed("image_id", "rank")
    df = df.withColumn("sketch", similar.sketch(F.col("histogram"), ft.moments(F.col("histogram")), [0, 2, 4]))
    near = {(a[0], b[0]) for a in made for b in made if a[0] < b[0] and _distance(a, b) <= 0.15}
    close = {(a[0], b[0]) for a in made for b in made if a[0] < b[0] and bin((a[1] ^ b[1]) & (2**64 - 1)).count("1") <= 16}
    found = [tuple(r) for r in similar.block_candidates(df, None, 0.15).collect()]
    assert len(found) == len(set(found)) and near <= set(found) <= close and len(found) < len(close)
    some, rest = df.filter("rank % 2 = 0"), df.filter("rank % 4 <> 0")
    found = [tuple(r) for r in similar.block_candidates(some, rest, 0.15).collect()]
    want = {(a, b) for a, b in near if a % 2 == 0 and b % 4}
    assert len(found) == len(set(found)) and want <= set(found) <= {(a, b) for a, b in close if a % 2 == 0 and b % 4}
    assert similar.block_candidates(df.limit(0), None, 0.15).count() == 0


@pytest.mark.parametrize("bins,rows", [([0, 2, 4], 10**6), ([0, 1, 2, 3, 4, 5], 40)])
def test_sure_pairs_are_near_and_the_first_leader_stays(spark, monkeypatch, bins, rows):
    monkeypatch.setattr(similar, "BLOCK_ROWS", rows)
    monkeypatch.setattr(similar, "TILE", (8, 64))
    made = [r for r in _features(9, n=200, hot=0.3) if r[3]] + [(10**6, 7, [0.5] * 6, True), (10**6 + 1, 6, [0.5] * 6, True)]
    # Rounding blurs what little these histograms vary.
    made += [(10**7 + k, 7 ^ k, [1e6 + x * 1e-3 for x in (k, 2, 5, 1, 7, 3)], True) for k in range(3)]
    df = spark.createDataFrame(made, SCHEMA).withColumnRenamed("image_id", "rank")
    df = df.withColumn("sketch", similar.sketch_array(F.col("histogram"), ft.moments(F.col("histogram")), bins))
    near = {(a[0], b[0]) for a in made for b in made if a[0] < b[0] and _distance(a, b) <= 0.15}
    found = similar.block_pairs(df, None, 0.15).collect()
    sure, open_pairs = ({(r.a, r.b) for r in found if r.sure == kind} for kind in (True, False))
    assert len(found) == len(sure | open_pairs) and sure <= near and near <= sure | open_pairs
    assert sure and all(b < 10**6 for _, b in sure) and any(b >= 10**7 for _, b in open_pairs)
    some, rest = df.filter("rank % 2 = 0"), df.filter("rank % 4 <> 0")
    want = {}
    for a, b in sorted(near, reverse=True):
        if a % 2 == 0 and b % 4:
            want[b] = a
    found = similar.block_pairs(some, rest, 0.15, first=True).collect()
    got = {}
    for r in sorted(found, reverse=True):
        if r.sure or (r.a, r.b) in near:
            got[r.b] = r.a
    assert got == want
    if len(bins) == 6:
        assert len(found) < sum(a % 2 == 0 and b % 4 != 0 for a, b in near)


def test_few_pairs_are_compared_whole(spark, monkeypatch):
    rows = _features(6, hot=0.3)
    seen, whole = [], similar.with_distance
    monkeypatch.setattr(similar, "with_distance", lambda pairs, features: seen.append(pairs.count()) or whole(pairs, features))
    got = similar.assign_leaders(spark.createDataFrame(rows, SCHEMA))
    assert {r.image_id: r.leader_id for r in got.collect()} == _sequential(rows, 0.15)
    made = [r for r in rows if r[3]]
    near = sum(_distance(a, b) <= 0.15 for a in made for b in made if a[0] < b[0])
    assert sum(seen) < near / 10


def test_constant_histograms_and_empty_input(spark):
    rows = [(1, 0, [0.5] * 6, True), (2, 1, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6], True), (3, -1, [0.5] * 6, True), (4, 0, [0.5] * 6, True)]
    got = similar.assign_leaders(spark.createDataFrame(rows, SCHEMA))
    # A constant histogram correlates fully with anything, so the hash decides.
    assert {r.image_id: r.leader_id for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 1}
    assert similar.assign_leaders(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sketch_never_exceeds_the_colour_distance(spark):
    rows = [r for r in _features(5, n=60) if r[3]]
    df = spark.createDataFrame(rows, SCHEMA)
    moments = ft.moments(F.col("histogram"))
    for bins in ([0, 2, 4], [5], []):
        named = df.select("image_id", "histogram", similar.sketch(F.col("histogram"), moments, bins).alias("s"))
        other = named.select(F.col("image_id").alias("other"), F.col("histogram").alias("y"), F.col("s").alias("t"))
        corr = ft.correlation(F.col("histogram"), F.col("y"), moments, ft.moments(F.col("y")))
        bound = similar._colour_bound(F.col("s"), F.col("t"), len(bins) + 1)
        pairs = named.join(other, F.col("image_id") < F.col("other"))
        assert pairs.filter(bound > ft.histogram_distance(corr) + similar.SLACK).isEmpty()


def test_chain_of_neighbours(spark):
    # Each image is close to the next only: every other one leads, along the whole chain.
    rows = [(i, _signed(((1 << 64) - 1) >> (64 - 4 * i) if i else 0), [0.0, 1.0, 0.0], True) for i in range(16)]
    radius = 0.6 * 4 / 64
    got = similar.assign_leaders(spark.createDataFrame(rows, SCHEMA), radius)
    assert {r.image_id: r.leader_id for r in got.collect()} == {i: i - i % 2 for i in range(16)}


def _walked(pairs):
    """Images covered by some earlier leader, in order."""
    covered: set[int] = set()
    for a, b in sorted(pairs):
        if a not in covered:
            covered.add(b)
    return covered


def _chains(rng):
    pairs = [(i, i + 1) for i in range(40)] + [(100 + 3 * i + j, 101 + 3 * i + j) for i in range(20) for j in range(2) if rng.random() < 0.8]
    pairs += [(200, 201 + i) for i in range(10)]
    # A ladder, where each image resembles the next two, and a thin random tangle.
    pairs += [(300 + i, 300 + i + k) for i in range(60) for k in (1, 2)]
    pairs += list({tuple(sorted(rng.sample(range(400, 460), 2))) for _ in range(70)})
    # Chains that join: both ways round a loop of even and odd length.
    pairs += [(500, 501), (501, 502), (500, 503), (502, 504), (503, 504), (504, 505), (600, 601), (600, 602), (602, 603), (601, 604), (603, 604)]
    return pairs


@pytest.mark.parametrize("seed,rounds,walk_edges", [(7, 1, 10**6), (8, 1, 60)])
def test_long_chains_are_contracted_and_walked(spark, seed, rounds, walk_edges):
    pairs = _chains(random.Random(seed))
    edges = spark.createDataFrame(pairs, "a long, b long")
    got = [r.rank for r in similar.non_leaders(edges, rounds, walk_edges).collect()]
    assert sorted(got) == sorted(_walked(pairs))


def test_chain_of_a_million_settles_in_few_rounds(spark, monkeypatch):
    n, writes = 1_000_000, []
    settle, once = similar._settle_round, similar.cut
    monkeypatch.setattr(similar, "_settle_round", lambda *args: writes.append("round") or settle(*args))
    monkeypatch.setattr(similar, "cut", lambda df, label="cut": writes.append(label) or once(df, label))
    monkeypatch.setattr(similar, "_walk_components", None)
    edges = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = similar.non_leaders(edges, rounds=3)
    assert got.count() == n // 2 and got.filter("rank % 2 = 0").isEmpty()
    assert writes.count("round") // 2 + writes.count("points") < 30


@pytest.mark.parametrize("radius", [0.0, 0.05, 0.15, 0.3])
@pytest.mark.parametrize("rows", [100, 10**6, 10**9])
def test_bands_cover_every_pair(radius, rows):
    bands = similar.plan_bands(radius, rows)
    assert sum(bands.widths) == 64 and sum(s + 1 for s in bands.shares) == bands.max_bits + 1
    rng = random.Random(radius * rows)
    for _ in range(300):
        diff = rng.sample(range(64), rng.randint(0, bands.max_bits))
        assert any(
            sum(o <= b < o + w for b in diff) <= s for o, w, s in zip(bands.offsets, bands.widths, bands.shares)
        )


def test_groups_scores_and_keepers(spark):
    assigned = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 4), (5, 4), (6, 4)], "image_id long, leader_id long")
    found = similar.groups(assigned)
    assert sorted(map(tuple, found.collect())) == [(1, 1, 2, 2), (2, 2, 4, 3)]
    quality = spark.createDataFrame(
        [(2, 50.0, 0.5, None), (3, 100.0, 0.5, None), (4, 10.0, 0.5, 1.0), (5, 10.0, 0.5, None), (6, 0.0, 0.5, None)],
        "image_id long, sharpness double, contrast double, face_score double",
    )
    ranked = similar.best_first(similar.score(similar.members(assigned, found), quality)).collect()
    got = sorted((r.group_id, r.rank, r.image_id, round(r.score, 6)) for r in ranked)
    assert got == [(1, 1, 3, 0.8), (1, 2, 2, 0.5), (2, 1, 4, round(1.3 / 1.5, 6)), (2, 2, 5, 0.8), (2, 3, 6, 0.2)]
    assert tuple(similar.summary(found).first()) == (2, 5)
