"""Planted truth on generated maps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoloom.operators import balance, compare, compartments, loops, sequence, structures

MAP = "sample string, chrom string, i long, j long, cnt double"


def frame(spark, m, sample="s"):
    i, j = np.nonzero(np.triu(m, 1))
    return spark.createDataFrame([(sample, "c", int(a), int(b), float(m[a, b])) for a, b in zip(i, j)], MAP)


def sizes(spark, n, *samples):
    return spark.createDataFrame([(s, "c", n) for s in samples or ("s",)], "sample string, chrom string, n long")


def decay(n, depth, rng, bias=None):
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    lam = depth / (d + 1.0) ** 1.0
    if bias is not None:
        lam = lam * np.outer(bias, bias)
    m = np.triu(rng.poisson(lam), 1)
    return m + m.T


def test_loops_are_found(spark):
    rng = np.random.default_rng(11)
    n, planted = 230, [(22, 51), (67, 133), (90, 118), (150, 209)]
    m = decay(n, 360, rng)
    shape = np.array([[18, 30, 18], [30, 75, 30], [18, 30, 18]])
    for a, b in planted:
        m[a - 1:a + 2, b - 1:b + 2] += rng.poisson(shape)
    w = spark.createDataFrame([("s", "c", k, 1.0) for k in range(n)], "sample string, chrom string, bin long, weight double")
    got = [(r.i, r.j) for r in loops.call_loops(frame(spark, m), sizes(spark, n), w, 10_000, tile=64).collect()]
    assert all(any(abs(a - x) <= 2 and abs(b - y) <= 2 for x, y in got) for a, b in planted)
    far = [g for g in got if all(abs(g[0] - a) > 2 or abs(g[1] - b) > 2 for a, b in planted)]
    assert len(far) <= 3


def test_balancing_recovers_the_bias(spark):
    rng = np.random.default_rng(5)
    n = 60
    bias = rng.uniform(0.5, 1.8, n)
    bias[17] = 0
    m = decay(n, 400, rng, bias)
    ice, report = balance.ice(frame(spark, m), sizes(spark, n), max_iter=400)
    got = {r.bin: r.bias for r in ice.collect()}
    assert got[17] is None and report.first().converged
    keep = [k for k in range(5, n - 5) if got[k] is not None]
    assert np.corrcoef([got[k] for k in keep], bias[keep])[0, 1] > 0.97
    kr, report = balance.kr(frame(spark, m), sizes(spark, n))
    r = report.first()
    assert r.converged and r.row_sum_cv < 1e-5


def test_compartments(spark):
    rng = np.random.default_rng(6)
    lab = np.repeat([0, 1, 0, 1, 0], [31, 18, 44, 27, 36])              # blocks of uneven length
    n = len(lab)
    same = np.equal.outer(lab, lab)
    d = np.abs(np.subtract.outer(np.arange(n), np.arange(n)))
    m = np.triu(rng.poisson(np.where(same, 48, 19) / (d + 1) ** 0.4), 1)
    track = spark.createDataFrame([("s", "c", k, float(lab[k])) for k in range(n)], "sample string, chrom string, bin long, value double")
    ev = {r.bin: r.eigenvector for r in compartments.compartments(frame(spark, m + m.T), sizes(spark, n), track).collect()}
    assert np.mean([(ev[k] > 0) == (lab[k] == 1) for k in range(n)]) > 0.95


def test_compartments_carry_the_track_once(spark):
    """No pixel carries the orientation track of its map, and maps are ordered by no window over their pixels."""
    n = 40
    m = np.fromfunction(lambda i, j: 10.0 + 5 * ((i < 20) == (j < 20)) + (i * 7 + j * 7) % 3, (n, n))
    for sign in (1, -1):
        track = spark.createDataFrame([("s", "c", k, float(sign * k)) for k in range(n)], "sample string, chrom string, bin long, value double")
        df = compartments.compartments(frame(spark, m), sizes(spark, n), track)
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "map_from_entries" not in plan and "Window" not in plan
        ev = {r.bin: r.eigenvector for r in df.collect()}
        assert len(ev) == n and sign * np.cov([ev[k] for k in range(n)], np.arange(n))[0, 1] > 0



def test_differential_pixels(spark):
    rng = np.random.default_rng(8)
    n = 80
    base = 3000 / (np.abs(np.subtract.outer(np.arange(n), np.arange(n))) + 1.0)
    spikes = [(10 + 3 * k, 30 + 3 * k) for k in range(12)]
    rows = []
    for cond, rep in (("a", "a1"), ("a", "a2"), ("b", "b1"), ("b", "b2")):
        lam = base.copy()
        if cond == "b":
            for i, j in spikes:
                lam[i, j] *= 4
        m = np.triu(rng.poisson(lam), 1)
        rows += [(cond, rep, "c", int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))]
    reps = spark.createDataFrame(rows, "condition string, replicate string, chrom string, i long, j long, cnt double")
    px = compare.differential_pixels(reps).toPandas()
    sig = {(r.i, r.j) for r in px[px["q"] <= 0.05].itertuples()}
    assert len(sig & set(spikes)) >= 6 and len(sig - set(spikes)) <= 0.02 * len(px)


def test_chain_exponents(spark):
    rod = spark.createDataFrame([("rod", k, 50.0 * k, 0.0, 0.0) for k in range(300)], "structure string, bead long, x double, y double, z double")
    rng = np.random.default_rng(3)
    walks = [(f"w{s}", int(k), *map(float, p)) for s in range(8) for k, p in enumerate(rng.normal(size=(2000, 3)).cumsum(0))]
    ideal = spark.createDataFrame(walks, "structure string, bead long, x double, y double, z double")
    fit = structures.scaling_fit(structures.distance_scaling(rod)).first()
    assert fit.nu == pytest.approx(1.0, abs=1e-6)
    nu = [r.nu for r in structures.scaling_fit(structures.distance_scaling(ideal)).collect()]
    assert np.mean(nu) == pytest.approx(0.5, abs=0.06)
    assert structures.decay_fit(rod, 4, 30).first().gamma == pytest.approx(1.0, abs=1e-6)


def test_density_of_a_hot_structure_equals_all_pairs(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(0, 300, (150, 3))
    b = spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(x)], "structure string, bead long, x double, y double, z double")
    d = np.linalg.norm(x[:, None] - x[None], axis=-1)
    near = (d < 90) & (np.abs(np.subtract.outer(np.arange(150), np.arange(150))) >= 2)
    assert {r.bead: r.density for r in structures.local_density(b, 90.0).collect()} == {k: int(v) for k, v in enumerate(near.sum(1))}
    span = structures.max_span(b).first().span
    assert span == pytest.approx(d.max())
    rot = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    moved = spark.createDataFrame([("s", k, *map(float, p)) for k, p in enumerate(x @ rot + 5)], b.schema)
    assert structures.superposed_rmsd(moved, b).first().rmsd == pytest.approx(0, abs=1e-6)


def test_motif_across_chunk_edges(spark):
    pwm = sequence.log_odds([[9, 0, 0, 9, 0], [0, 9, 0, 0, 9], [0, 0, 9, 0, 0], [0, 0, 0, 0, 0]])
    text = "T" * 98 + "ACGAC" + "N" * 50 + "T" * 60
    chunks = spark.createDataFrame([("k", s, text[s:s + 100]) for s in range(0, len(text), 100)], "contig string, chunk_start long, bases string")
    r = sequence.scan_contigs(chunks, pwm, 100).first()
    assert (round(r.score, 6), r.strand) == (1.0, 1)
    gc = {q.bin: (q.gc, q.valid) for q in sequence.gc_per_bin(chunks, 50).collect()}
    assert gc[0] == (0.0, True) and gc[2][1] is False
