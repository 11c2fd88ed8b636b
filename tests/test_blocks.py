"""Sums over pairs by blocks, the exact diameter and greedy selection, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoloom.functions import blocks, groups
from karyoloom.operators import structures as S


def test_coinciding_positions(spark):
    r = np.random.default_rng(1)
    at = {g: np.sort(r.choice(3000, n, replace=False)) for g, n in (("a", 700), ("b", 1), ("c", 40))}
    df = spark.createDataFrame([(g, int(p)) for g, x in at.items() for p in x], "g string, p bigint")
    want = {}
    for g, x in at.items():
        d = (x[None] - x[:, None])[np.triu_indices(len(x))]
        want |= {(g, int(k)): int(n) for k, n in zip(*np.unique(d, return_counts=True))}
    for width in (64, 4096):
        got = {(x.g, x.d): x.k for x in blocks.coinciding(df, ["g"], "p", width=width).collect()}
        assert got == want


def test_distance_sums_and_moments(spark):
    r = np.random.default_rng(2)
    x, y = r.normal(1000, 5, (90, 3)), r.normal(0, 3, (90, 3))
    x[7] = x[8]                                                    # a pair at distance 0 has no logarithm
    df = spark.createDataFrame([("g", k, *map(float, x[k]), *map(float, y[k])) for k in range(90)], "g string, bead bigint, x1 double, y1 double, z1 double, x2 double, y2 double, z2 double")
    i, j = np.triu_indices(90, 1)
    d1, d2 = (np.linalg.norm(p[i] - p[j], axis=1) for p in (x, y))
    for width in (16, 512):
        got = blocks.distance_moments(df, ["g"], "bead", ["x1", "y1", "z1"], ["x2", "y2", "z2"], width).first()
        assert got.pairs == len(i) and got.correlation == pytest.approx(np.corrcoef(d1, d2)[0, 1], abs=1e-10)
        sums = {s.s: (s.k, s.one, s.two) for s in blocks.log_distance_sums(df, ["g"], "bead", ["x1", "y1", "z1"], 3, 50, width).collect()}
        use = (j - i >= 3) & (j - i <= 50) & (d1 > 0)
        for s in range(3, 51):
            ld = np.log(d1[use & (j - i == s)])
            assert sums[s] == (len(ld), pytest.approx(ld.sum()), pytest.approx((ld * ld).sum()))
        assert set(sums) == set(range(3, 51))


@pytest.mark.parametrize("leaf", [4, 64])
def test_diameter(spark, leaf, monkeypatch):
    monkeypatch.setattr(S, "SPAN_LEAF", leaf)
    r = np.random.default_rng(3)
    shell = r.normal(size=(250, 3))
    parts = {"shell": 100 * shell / np.linalg.norm(shell, axis=1)[:, None], "line": np.arange(40)[:, None] * np.ones(3), "one": np.ones((1, 3)), "same": np.ones((9, 3)), "cloud": r.normal(size=(300, 3))}
    df = spark.createDataFrame([(s, k, *map(float, p)) for s, x in parts.items() for k, p in enumerate(x)], "structure string, bead bigint, x double, y double, z double")
    got = {x.structure: x.span for x in S.max_span(df).collect()}
    assert set(got) == set(parts)
    for s, x in parts.items():
        assert got[s] == pytest.approx(np.linalg.norm(x[:, None] - x[None], axis=2).max(), rel=1e-12)


def one_at_a_time(rows, radius):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[-1], *r[:-1])):
        if not any(all(abs(a - b) <= w for a, b, w in zip(r[:-1], k[:-1], radius)) for k in kept):
            kept.append(r)
    return set(kept)


@pytest.mark.parametrize("n", [1, 2])
def test_greedy_equals_one_at_a_time(spark, n, monkeypatch):
    monkeypatch.setattr(groups, "BLOCK", (40, 40, 40))
    r = np.random.default_rng(5)
    rows = {tuple(int(x) for x in r.integers(-60, 300 if n == 1 else 120, n)): float(r.integers(0, 12)) for _ in range(600)}
    rows = [(*c, s) for c, s in rows.items()]
    coords = ["p", "q"][:n]
    df = spark.createDataFrame([("g", *x) for x in rows], "g string, " + ", ".join(f"{c} bigint" for c in coords) + ", score double")
    got = {tuple(x)[1:] for x in groups.greedy(df, ["g"], coords, [3, 5][:n]).collect()}
    assert got == one_at_a_time(rows, [3, 5][:n])


def test_falling_scores_need_few_rounds(spark, monkeypatch):
    rounds, real = [], groups.cut
    monkeypatch.setattr(groups, "cut", lambda df: rounds.append(1) or real(df))
    ramp = spark.range(10_000).select(F.lit("g").alias("g"), F.col("id").alias("p"), (10_000.0 - F.col("id")).alias("score"))
    got = [x.p for x in groups.greedy(ramp, ["g"], ["p"], [4]).orderBy("p").collect()]
    assert got == list(range(0, 10_000, 5)) and len(rounds) <= 4
    assert groups.greedy(ramp.limit(0), ["g"], ["p"], [4]).count() == 0
