"""Runs of inner cells as aligned stretches."""

import random

from finegrid.operators import geometry as G


def test_stretches_tile_every_run(spark):
    """Each cell of a run is in exactly one stretch, no level holds more than two, whatever the signs; empty runs have none."""
    rng = random.Random(3)
    runs = [(a, a + n) for a in (-70000, -9, -1, 0, 1, 7, 65535) for n in (0, 1, 2, 3, 8, 100, 1000)] + [(-5, -9), (-200001, 200003)]
    runs += [(a := rng.randrange(-3000, 3000), a + rng.randrange(1, 900)) for _ in range(60)]
    df = spark.createDataFrame([(i, 1, a, z) for i, (a, z) in enumerate(runs)], "k int, ci int, a bigint, z bigint")
    got = {}
    for r in G._stretches(df).collect():
        got.setdefault(r.k, []).append((r.level, r.at))
    for k, (a, z) in enumerate(runs):
        cells = [c for level, at in got.get(k, []) for c in range(at << level, (at + 1) << level)]
        assert sorted(cells) == list(range(a, z))
        below = [level for level, _ in got.get(k, []) if level < G.LEVELS]
        assert all(below.count(level) <= 2 for level in set(below))
    assert got[len(runs) - 61] and max(level for level, _ in got[len(runs) - 61]) == G.LEVELS
