"""Density clusters against comparing all pairs."""

import math
import random

import pytest

from shoebox.operators import dbscan, graph

HOUR = 3_600_000
SCHEMA = "image_id long, taken_unix_ms long, latitude double, longitude double"


def _photos(seed, n=250):
    rng = random.Random(seed)
    places = [(48.8, 2.3), (0.0, 179.95), (0.0, -179.95), (89.9, 10.0), (89.9, 190.0), (-33.0, 151.0)]
    rows = []
    for i in range(n):
        # A third of the photos are taken at one place within an hour.
        if rng.random() < 0.33:
            la, lo, t = 48.8, 2.3, rng.randint(0, HOUR)
        else:
            la, lo = rng.choice(places)
            t = rng.randint(0, 40) * HOUR + rng.randint(0, 1000)
        la, lo = la + rng.uniform(-0.1, 0.1) * rng.choice([0, 1]), lo + rng.uniform(-0.2, 0.2) * rng.choice([0, 1])
        rows.append((i, None if rng.random() < 0.05 else t, None if rng.random() < 0.05 else la, lo))
    return rows


def _near(a, b, gap, km):
    la, lo, lb, lp = (math.radians(x) for x in (a[2], a[3], b[2], b[3]))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return abs(a[1] - b[1]) <= gap and 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))) <= km


def _expected(rows, gap, km, least):
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    near = {a[0]: [b[0] for b in rows if _near(a, b, gap, km)] for a in rows}
    core = {i for i, ns in near.items() if len(ns) >= least}
    name = {}
    for i in sorted(core):
        if i in name:
            continue
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in name:
                name[j] = i
                todo += [k for k in near[j] if k in core]
    out = {}
    for i in near:
        options = [name[j] for j in near[i] if j in core]
        out[i] = (name[i], True) if i in core else (min(options) if options else None, False)
    return out


@pytest.mark.parametrize("seed,hours,km,least", [(1, 2, 5.0, 4), (2, 1, 20.0, 3)])
def test_clusters_equal_all_pairs(spark, seed, hours, km, least):
    rows = _photos(seed)
    got = dbscan.cluster(spark.createDataFrame(rows, SCHEMA), dbscan.Density(hours * HOUR, km, least))
    assert {r.image_id: (r.cluster_id, r.is_core) for r in got.collect()} == _expected(rows, hours * HOUR, km, least)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 200]], "node long")
    got = {r.node: r.label for r in graph.components(nodes, edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 200: 200}
