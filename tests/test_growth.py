"""Steps that must not make more rows than their inputs and results call for."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoloom.functions import blocks, ranks
from karyoloom.operators import balance, evaluate, genes, imaging, loops, maps, predict, variants
from karyoloom.plans import jobs
from karyoloom.registry.base import rounded
from karyoloom.sources import catalog


def most_rows(df):
    """(rows collected, largest number of rows that any step of the executed plan gave on)."""
    got, most = df.collect(), 0
    todo = [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
            continue
        if kind.endswith("QueryStageExec"):
            todo.append(p.plan())
            continue
        if p.metrics().contains("numOutputRows"):
            most = max(most, p.metrics().apply("numOutputRows").value())
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return got, most


# ---- genes
def test_genes_meet_only_maps_with_their_bin(spark):
    """1000 genes and 20 maps of 13 bins: genes outside the bins are never copied to the maps."""
    g = spark.range(1000).select(F.lit("chr1").alias("chrom"), F.concat(F.lit("g"), "id").alias("name"), (F.col("id") * 100).alias("tss"), F.lit("+").alias("strand"),
                                 F.lit(1.0).alias("tpm"), F.lit(3).alias("neighbours"))
    bins = spark.range(20).select(F.concat(F.lit("s"), "id").alias("sample"), F.lit("chr1").alias("chrom"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(12).cast("long"))).alias("bin"))
    tracks = bins.select("*", F.lit(0.1).alias("compartment"), F.col("bin").cast("double").alias("insulation"), (F.col("bin") + 1).alias("cov"))
    oe = bins.withColumn("local_oe", F.lit(0.5))
    got, most = most_rows(genes.feature_rows(g, tracks, bins.filter("bin = 6"), oe, 100, 2000))
    want = {(f"s{s}", f"g{b}") for s in range(20) for b in range(5, 8)}                # the slope needs five bins on either side
    assert {(r.sample, r.name) for r in got} == want and len(got) == len(want) and most <= 1000


def test_neighbours_of_a_crowded_place(spark):
    rng = np.random.default_rng(3)
    rows = [("a", int(x)) for x in rng.integers(0, 400, 300)] + [("b", 5), ("b", None), (None, 7)]
    got = genes.neighbours_within(spark.createDataFrame(rows, "chrom string, tss long"), 50)
    want = sorted((c, x, sum(d == c and y is not None and abs(x - y) <= 50 for d, y in rows) - 1) for c, x in rows if c is not None and x is not None)
    assert sorted(map(tuple, got.collect())) == want
    many = spark.range(2000).select(F.lit("a").alias("chrom"), F.col("id").alias("tss"))
    got, most = most_rows(genes.neighbours_within(many, 1000))
    assert {r.tss: r.neighbours for r in got} == {k: min(k, 1000) + min(1999 - k, 1000) for k in range(2000)} and most <= 8000


# ---- tracks
def best_by_pairs(structures, tracks):
    folder = lambda p: p.rsplit("/", 1)[0] if "/" in p else ""                       # noqa: E731
    words = lambda p: {w for w in __import__("re").split(r"[^a-z0-9]+", __import__("re").sub(r"\.[^./]*$", "", p.lower())) if len(w) > 1}      # noqa: E731
    best = defaultdict(list)
    for state, s, n, full in structures:
        for other, k, m, genomic in tracks:
            score = 2 if m is not None and m == n else 1 if genomic or (m is not None and m == full) else 0
            if state == other and score:
                same = int(folder(s) == folder(k))
                shared = len(words(s) & words(k))
                best[state, s].append(((-score, -same, -shared, k), (k, score, same, shared)))
    return {k: min(v)[1] for k, v in best.items()}


def test_best_track(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(6)}_{['bed', 'hg', 'x1'][rng.integers(3)]}_c{rng.integers(9)}"                      # noqa: E731
    path = lambda: f"{['', 'd1/', 'd2/', 'd1/sub/'][rng.integers(4)]}{word()}.bed"                                       # noqa: E731
    length = lambda: None if rng.integers(8) == 0 else int(rng.integers(4))                                                 # noqa: E731
    structures = [(f"s{rng.integers(3)}", path(), length(), 3) for _ in range(200)]
    tracks = [(f"s{rng.integers(3)}", path(), length(), [True, False, None][rng.integers(3)]) for _ in range(25)]
    got = catalog.best_track(spark.createDataFrame(structures, "state string, structure string, n long, n_full int"),
                             spark.createDataFrame(tracks, "state string, track string, track_n long, genomic boolean"))
    assert {(r.state, r.structure): (r.track, r.length_score, r.same_folder, r.shared) for r in got.collect()} == best_by_pairs(structures, tracks)


def test_best_track_makes_no_pairs_of_files(spark):
    """600 structures and 600 tracks in one state, each length and folder held by six of them."""
    name = F.concat(F.lit("d"), F.col("id") % 10, F.lit("/name"), F.col("id"), F.lit(".bed"))
    f = spark.range(600).select(F.lit("a").alias("state"), name.alias("path"), (F.col("id") % 100).alias("n"))
    s = f.select("state", F.col("path").alias("structure"), "n", F.lit(-1).alias("n_full"))
    t = f.select("state", F.col("path").alias("track"), F.col("n").alias("track_n"), F.lit(False).alias("genomic"))
    got, most = most_rows(catalog.best_track(s, t))
    assert len(got) == 600 and {(r.length_score, r.same_folder, r.shared) for r in got} == {(2, 1, 2)} and all(r.track == r.structure for r in got) and most <= 6000


# ---- traces
def traces_of(spark, rows):
    return spark.createDataFrame(rows, "dataset string, copy string, locus int, x double, y double, z double")


def pair_lists(rows):
    found = defaultdict(list)
    for d, c, i, *p in rows:
        for e, k, j, *q in rows:
            if d is not None and c is not None and (d, c) == (e, k) and i < j and None not in (*p, *q):
                found[d, i, j].append(math.dist(p, q))
    return found


@pytest.fixture
def copies():
    """Two datasets with undetected loci, a repeated row and rows without a key."""
    rng = np.random.default_rng(4)
    rows = [(f"set{c % 2}", f"c{c}", k, *(None if rng.integers(9) == 0 else float(v) for v in rng.normal(0, 100, 3))) for c in range(7) for k in range(11)]
    return [*rows, rows[3], rows[40], (None, "c0", 1, 0.0, 0.0, 0.0), ("set0", None, 1, 0.0, 0.0, 0.0)]


@pytest.mark.parametrize("tile, strip", [(256, 2_000_000), (4, 5)])
def test_half_stats_by_tiles(spark, copies, monkeypatch, tile, strip):
    monkeypatch.setattr(blocks, "PAIRS", strip)
    monkeypatch.setattr(blocks, "TILE", tile)
    monkeypatch.setattr(imaging, "TILE", tile)
    got = imaging.half_stats(traces_of(spark, copies), 90.0).collect()
    want = {k: (len(d), sum(x < 90 for x in d) / len(d), float(np.median(d))) for k, d in pair_lists(copies).items()}
    assert len(got) == len(want)
    for r in got:
        assert (r.seen, r.freq, r.median) == pytest.approx(want[r.dataset, r.i, r.j])


@pytest.mark.parametrize("tile, together", [(256, 64), (4, 2)])
def test_distances_with_spreads_by_tiles(spark, copies, monkeypatch, tile, together):
    monkeypatch.setattr(blocks, "TILE", tile)
    monkeypatch.setattr(imaging, "TILE", tile)
    monkeypatch.setattr(imaging, "COPIES", together)
    sigma = [(d, i, j, s) for d in ("set0", "set1") for i in range(11) for j in range(i, 11) if (i + j) % 5 for s in ([2.0 + i] if (i, j) != (1, 2) else [2.0, 5.0, 0.0, None])]
    got = sorted((r.dataset, round(r.z, 9)) for r in imaging.standard_distances(traces_of(spark, copies), spark.createDataFrame(sigma, "dataset string, i int, j int, sigma double")).collect())
    want = sorted((d, round(x / s, 9)) for (d, i, j), xs in pair_lists(copies).items() for x in xs for e, a, b, s in sigma if (d, i, j) == (e, a, b) and s)
    assert got == want


def test_pairs_of_copies_are_never_shuffled(spark):
    """30 copies of 60 loci have 53,100 pairs; a task gives back the 1770 pairs of loci."""
    t = traces_of(spark, [("s", f"c{c}", k, float(k * c), 1.0, float(k)) for c in range(30) for k in range(60)])
    got, most = most_rows(imaging.half_stats(t, 10.0))
    assert len(got) == 1770 and most <= 1800
    sigma = t.select("dataset", F.col("locus").alias("i")).distinct().crossJoin(t.select(F.col("locus").alias("j")).distinct()).filter("i < j").withColumn("sigma", F.lit(20.0))
    h = imaging.pit_histogram(imaging.standard_distances(t, sigma))
    assert sum(r.n for r in h.collect()) == 53_100
    plan = imaging.standard_distances(t, sigma)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan
    cover = imaging.recalibrated_coverage(imaging.standard_distances(t, sigma), imaging.recalibrate(imaging.pit_histogram(imaging.standard_distances(t, sigma))))
    assert "broadcast" in cover._jdf.queryExecution().optimizedPlan().toString().lower()


def test_bead_medians(spark):
    rows = [("a", 0, 1, 2.0, 1.0), ("a", 0, 2, 4.0, None), ("a", 1, 2, 9.0, 5.0), ("a", 0, 3, 7.0, None), ("b", 0, 1, None, 3.0), (None, 0, 1, 1.0, 1.0)]
    got = imaging.bead_medians(spark.createDataFrame(rows, "chrom string, i long, j long, pred double, other double"), ["chrom"], ["pred", "other"]).collect()
    assert {(r.chrom, r.bead): (r.pred, r.other) for r in got} == {
        ("a", 0): (4.0, 1.0), ("a", 1): (5.5, 3.0), ("a", 2): (6.5, 5.0), ("a", 3): (7.0, None), ("b", 0): (None, 3.0), ("b", 1): (None, 3.0), (None, 0): (1.0, 1.0), (None, 1): (1.0, 1.0)}


def test_counts_of_distances_are_made_once_where_they_arise(spark, copies, monkeypatch):
    """Bins and coverages by tiles equal those of the single distances; the pairs are dealt out in arrays, the distances made once."""
    monkeypatch.setattr(blocks, "TILE", 4)
    monkeypatch.setattr(imaging, "TILE", 4)
    monkeypatch.setattr(imaging, "COPIES", 2)
    rows = [(d, i, j, 20.0 + 3 * i + j) for d in ("set0", "set1") for i in range(11) for j in range(i, 11) if (i + j) % 5]
    np.random.default_rng(5).shuffle(rows)
    sigma = spark.createDataFrame([(d, int(i), int(j), float(s)) for d, i, j, s in rows], "dataset string, i int, j int, sigma double")
    t = traces_of(spark, copies)
    z = imaging.standard_distances(t, sigma)
    plain = z.select("dataset", "z")                                                   # the same rows, counted one by one
    counts = lambda h: {(r.dataset, r.bin): r.n for r in h.collect()}                   # noqa: E731
    h = imaging.pit_histogram(z, 50)
    assert counts(h) == counts(imaging.pit_histogram(plain, 50)) and sum(counts(h).values()) == z.count() > 50 and len(counts(h)) == 100
    assert h._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 1
    bounds = spark.createDataFrame([("set0", 0.5, 0.5, 2.0), ("set0", 0.8, None, 3.0), ("set0", 0.9, 0.2, None), ("set1", 0.5, 1.0, 1.5)], "dataset string, level double, low_sigma double, high_sigma double")
    cover = lambda x: sorted((r.dataset, r.level, f"{r.coverage or 0:.12f}", r.measurements) for r in imaging.recalibrated_coverage(x, bounds).collect())          # noqa: E731
    assert cover(z) == cover(plain) and len(cover(z)) == 4
    medians = sigma.withColumns({"median": F.col("sigma"), "sep": (F.col("j") - F.col("i")) * 10}).withColumnRenamed("dataset", "unit")
    got = imaging.log_ratio_histogram(t.withColumnRenamed("dataset", "unit"), medians, [0.0, 30.0, 60.0, 1e9], -1.0, 1.0, 8)
    want = defaultdict(int)
    for (d, i, j), xs in pair_lists(copies).items():
        for x in xs:
            for s in [s for e, a, b, s in rows if (d, i, j) == (e, a, b)]:
                r = min(1.0, max(-1.0, math.log(x / s))) if x else -1.0
                want[d, sum((j - i) * 10 >= e for e in (30, 60)), min(7, math.floor((r + 1) / 2 * 8))] += 1
    assert {(r.unit, r.band, r.bin): r.n for r in got.collect()} == want


def test_bins_of_probability_by_the_table():
    from karyoloom.operators.ensemble import maxwell_p, maxwell_x
    near = maxwell_x(np.arange(1, 200) / 200)
    z = np.concatenate([np.random.default_rng(1).uniform(0, 6, 20_000), near, np.nextafter(near, 0), np.nextafter(near, 9), near * (1 + 1e-10), [0.0, 40.0, 1e12]])
    assert (imaging._pit_bins(200)(z) == np.minimum(np.floor(maxwell_p(z) * 200), 199)).all()
    assert list(imaging._pit_bins(200)(np.array([np.nan, 0.0]))) == [199, 0] and list(imaging._pit_bins(1)(z[:3])) == [0, 0, 0]


# ---- ranks
def test_buckets_come_from_one_sort(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 50)
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1500).cast("double").alias("v"))
    b = ranks.value_buckets(df, ["g"], "v")
    assert "percentile" not in b._jdf.queryExecution().optimizedPlan().toString()
    rows, spans = b.collect(), defaultdict(list)
    for r in rows:
        spans[r.g, r._b].append(r.v)
    ordered = sorted((g, n, min(v), max(v)) for (g, n), v in spans.items())
    assert len(rows) == 3000 and all(x[3] < y[2] for x, y in zip(ordered, ordered[1:]) if x[0] == y[0])
    assert max(map(len, spans.values())) <= 400


@pytest.mark.parametrize("most", [50_000, 20])
def test_rank_correlation_of_small_and_large_groups(spark, monkeypatch, most):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", most)
    rng = np.random.default_rng(2)
    rows = [(None if k % 50 == 0 else f"g{k % 3}", *(None if rng.integers(15) == 0 else float(v) for v in rng.integers(0, 12, 2))) for k in range(400)]
    got = {r.g: (r.n, round(r.rho, 9)) for r in ranks.spearman(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], "x", "y").collect()}
    import pandas as pd
    full = pd.DataFrame(rows, columns=["g", "x", "y"]).dropna()
    assert got == {g: (len(p), round(p.x.rank().corr(p.y.rank()), 9)) for g, p in full.groupby("g")}


def test_contact_fit_keeps_beads_out_of_the_samples(spark):
    """50 samples over 3 bins, 200 beads: distances are made once for the pixels that occur."""
    px = spark.range(50).select(F.concat(F.lit("s"), "id").alias("sample"), F.lit("c").alias("chrom"), F.inline(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(float(n)).alias("cnt")) for i, j, n in ((0, 1, 9), (0, 2, 4), (1, 2, 7))])))
    beads = spark.range(200).select(F.lit("c").alias("chrom"), F.lit("m").alias("structure"), F.col("id").alias("bead"), (F.col("id") * F.col("id")).cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    got, most = most_rows(maps.contact_fit(px, beads, ["sample", "chrom"]))
    assert len(got) == 50 and {(r.structure, r.n, r.rho) for r in got} == {("m", 3, 1.0)} and most <= 200


# ---- bins outside deletions
def test_kept_bins(spark):
    sizes = [("a", 10), ("b", 6), ("b", 6), ("c", 4), ("d", 3)]
    cuts = [("a", 2, 4), ("a", 3, 5), ("a", 8, 8), ("b", 0, 2), ("b", 0, 2), ("d", 0, 9), ("d", None, 2)]
    got = variants.kept_bins(spark.createDataFrame(cuts, "sample string, a long, b long"), spark.createDataFrame(sizes, "sample string, n long"))
    want = []
    for name in "abcd":
        left = sorted(x for s, n in sizes if s == name for x in range(n) if not any(s == t and a is not None and a <= x < b for t, a, b in cuts))
        jumps = [int(k > 0 and x - left[k - 1] > 1) for k, x in enumerate(left)]
        want += [(name, x, k, sum(j for y, j in zip(left, jumps) if y <= x)) for k, x in enumerate(left)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_domain_scores_by_running_sums(spark):
    # windows over several blocks of bins, against a plain sum over the pixels of each window
    import random
    from collections import defaultdict

    from karyoloom.operators import domains
    rng, n, most = random.Random(4), 41, 7
    px = {(i, j): float(rng.randint(1, 9)) for i in range(n) for j in range(i, n) if rng.random() < 0.6}
    bounds = sorted(rng.sample(range(1, n), 17))
    c = spark.createDataFrame([("s", "c", i, j, v) for (i, j), v in px.items()] + [("s", "c", 1, 2, None), ("t", "c", 0, 1, 1.0)], "sample string, chrom string, i long, j long, cnt double")
    b = spark.createDataFrame([("s", "c", k) for k in bounds], "sample string, chrom string, bin long")
    z = spark.createDataFrame([("s", "c", n), ("t", "c", 2)], "sample string, chrom string, n long")
    want, edges = {}, sorted({0, n, *bounds})
    for a in edges:
        for e in edges:
            size, (lo, hi) = e - a, (max(0, 2 * a - e), min(n, 2 * e - a))
            if not 3 <= size <= most:
                continue
            every, part, out = defaultdict(float), defaultdict(float), defaultdict(float)
            for (i, j), v in px.items():
                if i >= lo and j < hi and j > i:
                    every[j - i] += v
                    part[j - i] += v * (i >= a and j < e)
                    out[j - i] += v * ((i < a <= j < e) or (a <= i < e <= j))
            over = lambda x: sum(x[d] / (every[d] / (hi - lo - d)) for d in every)          # noqa: B023, E731
            flank = size * ((a - lo) + (hi - e))
            if flank and over(out) > 0:
                ratio = (over(part) / (size * (size - 1) / 2)) / (over(out) / flank)
                if ratio >= 0.9:
                    want[a, e] = round(ratio, 9)
    scored = domains.domain_scores(c, b, z, min_ratio=0.9, max_bins=most)
    assert {(r.start, r.end): round(r.ratio, 9) for r in scored.collect()} == want and want
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInPandas") == 1


def test_touching_genes_travel_with_their_beads(spark):
    # more genes on a bead than a bundle holds, a crowded cell, repeated genes; a search carries columns and needs no join after
    import math
    import random
    from collections import Counter

    from karyoloom.operators import structures
    rng = random.Random(5)
    at = [(k, *(rng.random() * (0.2 if k % 2 else 4.0) for _ in range(3))) for k in range(330)]
    beads = spark.createDataFrame([("m", *b) for b in at] + [("m", 999, 0.0, 0.0, 0.0)], "structure string, bead long, x double, y double, z double")
    held = [(7, g) for g in range(150)] + [(7, 3)] + [(k, 1000 + k) for k in range(0, 330, 6)] + [(2, 5), (12345, 6)]
    got = genes.touching_pairs(spark.createDataFrame([("m", *h) for h in held], "structure string, bead long, gene long"), beads, 0.25, 1_000_000)
    where, want = {b[0]: b[1:] for b in at}, Counter()
    for n, (p, g) in enumerate(held):
        for q, h in held[n + 1:]:
            if p in where and q in where and (p != q or g != h) and math.dist(where[p], where[q]) < 0.5:
                want[min(g, h), max(g, h), float(abs(p - q))] += 1
    assert Counter((r.gene_a, r.gene_b, r.apart_mb) for r in got.collect()) == want
    tagged = beads.withColumn("tag", F.col("bead") * 10)
    pairs = structures.neighbor_pairs(tagged, 0.5, 1, ["structure"], ["tag"])
    assert pairs.filter("tag_i <> i * 10 OR tag_j <> j * 10").count() == 0 < pairs.count()


# ---- pair features
def test_marks_between_loci(spark):
    """Overlapping, repeated, reversed and incomplete loci; marks beyond the loci, on their edges, repeated and incomplete."""
    rng = np.random.default_rng(5)
    loci = [(c, k, 10 * k, 10 * k + [10, 25, 0, -5][k % 7 % 4]) for c in "ab" for k in range(9)]
    loci += [loci[1], ("a", None, 0, 10), ("a", 20, None, 90), ("a", 21, 5, None), (None, 1, 0, 10), ("c", 1, 0, 10)]
    marks = [(["rad21", "h3k27ac"][rng.integers(2)], "ab"[rng.integers(2)], int(rng.integers(-20, 130)), float(rng.integers(1, 9))) for _ in range(150)]
    marks += [*marks[:9], ("rad21", "a", None, 3.0), ("rad21", "b", 12, None), (None, "a", 3, 1.0), ("rad21", None, 3, 1.0), ("other", "a", None, 2.0)]
    want = []
    for mark, c in {m[:2] for m in marks if m[0] and m[1]}:
        at = [(p, v) for m, k, p, v in marks if (m, k) == (mark, c) and p is not None]
        mine = [r for r in loci if r[0] == c]
        held = lambda k: sum(v or 0 for r in mine if r[1] == k and None not in r for p, v in at if r[2] <= p < r[3])                  # noqa: E731
        s = [math.log1p(held(r[1])) for r in mine]
        mean = sum(s) / len(s) if s else 0
        full = [(r, x, x - mean) for r, x in zip(mine, s) if None not in r]
        below = lambda x: sum(p < x for p, _ in at)                                                                                  # noqa: E731
        for (_, i, a1, e1), x, dx in full:
            for (_, j, a2, e2), y, dy in full:
                if i < j:
                    log = math.log10(max(abs((a2 + e2) / 2 - (a1 + e1) / 2), 1.0))
                    base = [dx * dy, x + y, math.log1p(max(below(a2) - below(e1), 0)) if mark == "rad21" else -1.0]
                    want.append((c, mark, i, j, *(round(v, 6) for v in base), *(round(v * log, 6) if k < 2 or mark == "rad21" else -1.0 for k, v in enumerate(base))))
    got = predict.mark_features(spark.createDataFrame(loci, "chrom string, locus long, start long, end long"), spark.createDataFrame(marks, "mark string, chrom string, pos long, value double"))
    got, want = sorted(tuple(-1.0 if v is None else v for v in r) for r in got.collect()), sorted(want)
    assert len(got) == len(want) and [r[:4] for r in got] == [r[:4] for r in want]
    # equal keys stand for repeated loci, whose rows can differ in the last digits only
    assert all(x[4:] == pytest.approx(y[4:], abs=2e-6) for x, y in zip(got, want))


def test_pairs_of_loci_start_from_cells(spark):
    """20,000 marks over 30 loci: what the pairs are made from has a row for each locus and mark, the marks are not read again."""
    marks = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "rad21").otherwise("h3k27ac").alias("mark"), F.lit("a").alias("chrom"), F.col("id").alias("pos"), F.lit(1.0).alias("value"))
    loci = spark.range(30).select(F.lit("a").alias("chrom"), F.col("id").alias("locus"), (F.col("id") * 500).alias("start"), (F.col("id") * 500 + 500).alias("end"))
    got, most = most_rows(predict.mark_features(loci, marks))
    assert len(got) == 2 * 435 and most <= 2000
    assert {(r.mark, r.between and round(r.between, 9)) for r in got if (r.i, r.j) == (3, 7)} == {("rad21", round(math.log1p(750), 9)), ("h3k27ac", None)}


def test_rounded_is_round(spark):
    rng = np.random.default_rng(1)
    values = [None, float("nan"), math.inf, -math.inf, 0.0, -0.0, 5e-7, -5e-7, 1.5e-6, 2.5e-6, 1.0000005, 4.35e-5 + 5e-7, 123456.7890125, 1e10 + 0.1234565, 1e15 + 0.3, 1e300, -4e-7]
    values += [float(v) for v in rng.normal(0, 1, 2000)] + [float(k) / 2e6 for k in range(-500, 500)] + [float(v) for v in 10.0 ** rng.uniform(-9, 14, 2000)]
    d = spark.createDataFrame([(v,) for v in values], "v double")
    assert d.filter(~rounded("v").eqNullSafe(F.round("v", 6) + 0.0)).collect() == []
    assert "-0.0" not in {str(r[0]) for r in d.select(rounded("v")).collect()}


# ---- structures
def test_slopes_come_from_sums_per_separation(spark):
    """Two chains of 90 and 30 beads; a table of 120 beads has 1,000 pairs within reach, none of which is written."""
    rng = np.random.default_rng(4)
    chains = {"m": np.cumsum(rng.normal(size=(90, 3)), 0), "o": np.cumsum(rng.normal(size=(30, 3)), 0)}
    chains["m"][7] = chains["m"][9]                                                    # a distance of 0 has no logarithm
    rows = [(name, k, *map(float, xyz)) for name, m in chains.items() for k, xyz in enumerate(m)]
    rows[20] = ("m", 20, None, 1.0, 1.0)
    got, most = most_rows(evaluate.exponents(spark.createDataFrame(rows, "structure string, bead long, x double, y double, z double")))
    assert most <= 150 and {r.structure for r in got} == {"m", "o"}
    for r in got:
        m = {k: np.array(xyz) for name, k, *xyz in rows if name == r.structure and None not in xyz}
        n = len(chains[r.structure])
        hi, p = max(8, n // 10), []
        for a in m:
            for b in m:
                d = math.dist(m[a], m[b])
                if a < b and d > 0:
                    p.append((b - a, math.log(d)))
        mid = round(math.sqrt(4 * hi))
        for name, low, high in (("gamma_d", 4, hi), ("gamma_short", 2, 10), ("gamma_low", 4, mid), ("gamma_high", mid, hi)):
            s, ld = np.array([q for q in p if low <= q[0] <= high]).T
            assert r[name] == pytest.approx(np.polyfit(np.log(s), ld, 1)[0], rel=1e-9)


# ---- balancing
@pytest.mark.parametrize("side", [256, 4])
def test_row_sums_in_tiles_leave_the_pixels_where_they_are(spark, monkeypatch, side):
    monkeypatch.setattr(balance, "SIDE", side)
    rng = np.random.default_rng(8)
    full = {name: np.triu(rng.integers(0, 5, (n, n)), 1) for name, n in (("a", 11), ("b", 3))}
    rows = [(name, "c", int(i), int(j), float(m[i, j])) for name, m in full.items() for i, j in zip(*np.nonzero(m))] + [("a", "c", 0, 1, None), ("a", "c", 2, 9, 4.0), (None, "c", 0, 1, 3.0)]
    full["a"][2, 9] += 4                                                               # a pixel that comes twice
    px = maps.mirrored(spark.createDataFrame(rows, "sample string, chrom string, i long, j long, cnt double"))
    kept = {"a": [0, 1, 2, 5, 8, 9, 10], "b": [0, 1, 2]}
    good = spark.createDataFrame([(name, "c", b) for name, bs in kept.items() for b in bs], "sample string, chrom string, bin long")
    tiles = balance._prepare(px, good, ["sample", "chrom"])
    bias = good.withColumn("b", F.col("bin") / 4 + 1)
    s = balance._row_sums(tiles, bias, ["sample", "chrom"], -1)
    want = {}
    for name, m in full.items():
        sym, b = m + m.T, np.array([k / 4 + 1 for k in range(len(m))])
        want |= {(name, k): (b[k], sum(sym[k, o] / b[o] for o in kept[name])) for k in kept[name]}
    got = {(r["sample"], r.bin): (r.b, r._s) for r in s.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = balance._row_sums(tiles, bias, ["sample", "chrom"], -1)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 2                                                             # the values of the bins and the sums, not the tiles


# ---- loops
@pytest.mark.parametrize("most", [None, 200])
def test_q_values_of_small_families_in_place(spark, monkeypatch, most):
    rng = np.random.default_rng(6)
    rows = [(f"g{k % 3}", None if k % 40 == 0 else float(rng.integers(1, 60)) / 60) for k in range(500)] + [("one", 0.5), (None, 0.1)]
    got = {(r.g, r.p): r.q for r in ranks.bh_table(spark.createDataFrame(rows, "g string, p double"), ["g"], most=most).collect()}
    want = {}
    for g in ("g0", "g1", "g2", "one"):
        ps = sorted(p for h, p in rows if h == g and p is not None)
        for p in set(ps):
            want[g, p] = min(1.0, *(x * len(ps) / sum(y <= x for y in ps) for x in ps if x >= p), 1.0)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)
    if most:
        monkeypatch.setattr(ranks, "cut", None)                                        # nothing is written
        ranks.bh_table(spark.createDataFrame(rows, "g string, p double"), ["g"], most=most).collect()


def test_tested_pixels_are_written_by_tiles(spark):
    """What is written of the pixels that are no peaks are their p-values, in a row per tile."""
    rng = np.random.default_rng(7)
    m = rng.poisson(3, (40, 40))
    m[10, 22] = m[30, 18] = m[18, 30] = 60
    px = spark.createDataFrame([("s", "c", i, j, float(m[i, j])) for i in range(40) for j in range(i, 40) if m[i, j]], "sample string, chrom string, i long, j long, cnt double")
    size = spark.createDataFrame([("s", "c", 40)], "sample string, chrom string, n long")
    w = maps.bins_of(size).select("sample", "chrom", "bin", F.lit(1.0).alias("weight"))
    every = loops.neighbourhood_tests(px, size, w, 10_000, tile=16).toPandas()
    tiles = loops._tested_tiles(px, size, w, 10_000, tile=16).toPandas()
    assert len(tiles) <= 6 and 0 < tiles["i"].map(len).sum() < len(every) / 2
    for k in loops.KERNELS:
        assert sorted(p for ps in tiles[f"all_{k}"] for p in ps) == sorted(every[f"p_{k}"])
    oe = {k: np.where(every[f"e_{k}"] > 0, every.obs / every[f"e_{k}"].where(every[f"e_{k}"] > 0, 1), 0) for k in loops.KERNELS}
    ok = (np.maximum(oe["donut"], oe["lower_left"]) >= 2) & np.all([oe[k] >= f for k, f in loops.FLOORS.items()], axis=0)
    assert sorted((i, j) for a, b in zip(tiles["i"], tiles["j"]) for i, j in zip(a, b)) == sorted(zip(every[ok].i, every[ok].j))


# ---- sample sheets
def test_the_summary_of_a_sheet_reads_the_steps_that_are_written(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(1)
    at = rng.integers(0, 40_000, (3000, 2))
    pairs = spark.createDataFrame([(f"0{k % 2}", "c", "c", int(a), int(b)) for k, (a, b) in enumerate(at)], "sample string, chrom1 string, chrom2 string, pos1 long, pos2 long")
    sizes = spark.createDataFrame([("00", "c", 40), ("01", "c", 40)], "sample string, chrom string, n long")
    seen, summary = [], jobs.suite.summary
    monkeypatch.setattr(jobs.suite, "summary", lambda tables, n: seen.append({k: v._jdf.queryExecution().optimizedPlan().toString() for k, v in tables.items()}) or summary(tables, n))
    run = lambda s, *steps: jobs.run_sheet(spark, pairs, s, sizes, 1000, 5, str(tmp_path), *steps)         # noqa: E731
    sheet = sizes.select("sample")
    run(sheet.filter("sample = '00'"), ("boundaries", "domains"))
    assert not seen
    assert {tuple(r) for r in run(sheet).collect()} == {("00", s) for s in ("tracks", "p_s", "summary")} | {("01", s) for s in jobs.STEPS}
    assert all("parquet" in seen[0][k] and "Window" not in seen[0][k] for k in ("boundaries", "domains", "tracks", "p_s"))
    c = jobs.C.bin_pairs(pairs, 1000)
    want = summary(jobs.suite.analyze(c, sizes, 1000, 5, call=False), sizes).drop("slope").collect()
    got = spark.read.schema("sample string, chrom string, bins long, insulation_boundaries long, rank_sum_boundaries long, scored_domains long, a_fraction double").parquet(f"{tmp_path}/summary").select(list(want[0].asDict())).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2
