"""Crowded cells: beads of a tree of cells against all pairs, and the work that a dense cell makes."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoloom.operators import structures as S


def frame(spark, parts):
    return spark.createDataFrame([(s, k, *map(float, p)) for s, points in parts.items() for k, p in enumerate(points)], "structure string, bead bigint, x double, y double, z double").repartition(4).cache()


def brute(points, r, min_sep):
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    i, j = np.nonzero(np.triu(d < r, min_sep))
    return {(int(a), int(b)) for a, b in zip(i, j)}


@pytest.fixture(scope="module")
def crowded(spark):
    r = np.random.default_rng(4)
    dense = np.concatenate([r.normal(0, 40, (700, 3)), r.uniform(-400, 400, (150, 3)), np.repeat(r.normal(0, 30, (1, 3)), 120, axis=0)])
    parts = {"dense": r.permutation(dense), "thin": r.uniform(-900, 900, (80, 3))}
    return parts, frame(spark, parts)


@pytest.mark.parametrize("leaf", [16, 10_000])
def test_pairs_and_counts_equal_all_pairs(spark, crowded, leaf, monkeypatch):
    monkeypatch.setattr(S, "LEAF", leaf)
    parts, beads = crowded
    for min_sep in (1, 5):
        want = {(s, i, j) for s, p in parts.items() for i, j in brute(p, 60.0, min_sep)}
        got = S.neighbor_pairs(beads, 60.0, min_sep).collect()
        assert len(got) == len(want) and {(x.structure, x.i, x.j) for x in got} == want
        counts = {(x.structure, x.bead): x.density for x in S.local_density(beads, 60.0, min_sep).collect()}
        own = Counter((s, k) for s, i, j in want for k in (i, j))
        assert counts == {(s, k): own[s, k] for s, p in parts.items() for k in range(len(p))}


def test_a_cell_of_many_beads_is_counted_without_its_pairs(spark):
    # 60,000 beads in one cell: 1.8e9 pairs, nearly all within reach
    n = 60_000
    beads = spark.range(n).select(F.lit("a").alias("structure"), F.col("id").alias("bead"), *[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 50.0).alias(k) for k in S.XYZ])
    counts = S.local_density(beads, 40.0).agg(F.min("density"), F.max("density"), F.count(F.lit(1))).first()
    assert counts == (n - 3, n - 2, n)                    # all beads lie in 20 nm; each but the ends has two bonded ones
