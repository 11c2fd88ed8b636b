"""Small inputs with exact expected rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from karyoloom.functions import groups, intervals, ranks, special
from karyoloom.operators import balance, bins, contacts, liftover, variants as V
from karyoloom.sources.lines import read_lines
from karyoloom.sources import catalog, names, sinks, tables, variants as RV


def lines(spark, text, file="x"):
    return spark.createDataFrame([(file, k, v) for k, v in enumerate(text.split("\n"), 1)], "file string, line_no long, value string")


def test_folder_catalogue(spark, tmp_path):
    """Kind, state and chromosome from the places below the folder, not from the folder's own name."""
    root = tmp_path / "cancer chr9 (x).d"
    for name in ("wt/map_chr3.cool", "a b/tumor.v2/chrX.bed", "plain.txt", "wt/deep/senescent_chr22.npy", "notes.md"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"12345")
    found = catalog.scan_folder(spark, f"{root}/")
    assert {(r.path, r.kind, r.state, r.chrom, r.length) for r in found.collect()} == {
        ("wt/map_chr3.cool", "contacts", catalog.HEALTHY, "chr3", 5), ("a b/tumor.v2/chrX.bed", "track", catalog.DISEASE, "chrX", 5),
        ("plain.txt", "table", None, None, 5), ("wt/deep/senescent_chr22.npy", "structure", catalog.SENESCENT, "chr22", 5), ("notes.md", "unsupported", None, None, 5)}


def test_chain_of_many_splits(spark, tmp_path):
    """Line numbers and blocks of two files, one over many splits, equal those of one pass in order."""
    rng = np.random.default_rng(1)
    want, numbers, folder = set(), {}, tmp_path / "chains"
    folder.mkdir()
    for name, chains in (("long.chain", 400), ("short.chain", 3)):
        text = ["# no chain line counts before the first header", "7 1 1"] if chains == 3 else []
        for c in range(chains):
            t, q = int(rng.integers(0, 10**6)), int(rng.integers(0, 10**6))
            text += ["", f"chain 9 chr{c % 5} 9 + {t} 9 q{c} 1000 - {q} 9 {c}"]
            for n in rng.integers(1, 90, rng.integers(1, 40)):
                dt, dq = rng.integers(0, 50, 2)
                want.add((name, f"chr{c % 5}", t, t + n, f"q{c}", q))
                text.append(f"{n} {dt} {dq}")
                t, q = t + int(n) + int(dt), q + int(n) + int(dq)
        (folder / name).write_text("\n".join(text) + "\n")
        numbers |= {(name, k): v for k, v in enumerate(text, 1)}
    sizes = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in sizes:
            spark.conf.set(k, "4096")
        read = read_lines(spark, str(folder)).withColumn("file", F.element_at(F.split("file", "/"), -1))
        assert read.rdd.getNumPartitions() > 3
        assert {(r.file, r.line_no): r.value for r in read.collect()} == numbers
        for rows in (10, 65_536):
            got = tables.parse_chain(read, rows).collect()
            assert {(r.file, r.chrom, r.t_start, r.t_end, r.q_chrom, r.q_start) for r in got} == want and len(got) == len(want)
    finally:
        for k, v in sizes.items():
            spark.conf.set(k, v)


def test_chain_positions_and_intervals(spark):
    chain = "chain 1 chr1 9999 + 100 300 chrA 9999 + 500 710 1\n100 50 60\n50\n\nchain 1 chr2 9999 + 0 100 chrB 1000 - 0 100 2\n100\n"
    blocks = tables.parse_chain(lines(spark, chain)).drop("file")
    pts = spark.createDataFrame([("chr1", 100), ("chr1", 210), ("chr1", 260), ("chr2", 10), ("chr9", 5)], "chrom string, pos long")
    got = {(r.chrom, r.pos): (r.q_chrom, r.q_pos, r.q_strand) for r in liftover.lift_positions(pts, blocks).collect()}
    assert got == {("chr1", 100): ("chrA", 500, "+"), ("chr1", 210): (None, None, None), ("chr1", 260): ("chrA", 670, "+"), ("chr2", 10): ("chrB", 989, "-"), ("chr9", 5): (None, None, None)}
    iv = spark.createDataFrame([("chr1", 110, 150), ("chr1", 190, 230), ("chr2", 10, 20)], "chrom string, start long, end long")
    out = {r.start: (r.q_chrom, r.q_start, r.q_end) for r in liftover.lift_intervals(iv, blocks).collect()}
    assert out == {110: ("chrA", 510, 550), 190: (None, None, None), 10: ("chrB", 980, 990)}


def test_vcf_and_bedpe(spark):
    vcf = "\n".join(["##fileformat=VCFv4.2", "chr1\t1001\ta\tN\t<DEL>\t.\tPASS\tSVTYPE=DEL;END=2000", "1\t5001\tb\tN\t<DUP:TANDEM>\t.\tPASS\tSVLEN=300",
                     "chr1\t100\tc\tN\tN[chr2:500[\t.\tPASS\tSVTYPE=BND", "chr1\t10\td\tN\t<CNV>\t.\tPASS\tEND=20", "chr1\t10\te"])
    ok, bad = RV.read_vcf(lines(spark, vcf))
    rows = {r.vid: (r.kind, r.chrom, r.start, r.end, r.mate_chrom, r.mate_pos) for r in ok.collect()}
    assert rows == {"a": ("DEL", "chr1", 1001, 2000, None, None), "b": ("DUP", "chr1", 5001, 5301, None, None), "c": ("BND", "chr1", 99, 100, "chr2", 499)}
    assert sorted(r.source_line for r in bad.collect()) == [5, 6]
    bedpe = "chrom1\tstart1\tend1\tchrom2\tstart2\tend2\nchr1\t100\t200\tchr1\t900\t1000\tx\t.\t+\t-\nchr1\t100\t200\tchr2\t900\t1000\ty\nchr1\t1\t2\tchr1\t5\t6\tz"
    ok, bad = RV.read_bedpe(lines(spark, bedpe))
    assert {r.vid: (r.kind, r.start, r.end) for r in ok.collect()} == {"x": ("DEL", 150, 950), "y": ("BND", 150, 151)}
    assert [r.reason for r in bad.collect()] == ["type unknown"]


def test_tracks(spark):
    chroms = spark.createDataFrame([("chr1", 40_000)], "chrom string, size long")
    bg = tables.parse_intervals(lines(spark, "\n".join(f"chr1\t{k * 5000}\t{(k + 1) * 5000}\t2.0" for k in range(4)), "a.bedGraph"))
    assert [r.value for r in bins.bin_intervals(bg, chroms, 10_000).orderBy("bin").collect()] == [2.0, 2.0, None, None]
    bed = tables.parse_intervals(lines(spark, "chr1\t0\t15000\tn\t4", "b.bed"))
    assert [r.value for r in bins.bin_intervals(bed, chroms, 10_000, "coverage").orderBy("bin").collect()] == [4.0, 2.0, 0.0, 0.0]


def test_false_discovery_values(spark):
    values = {1: [0.002, 0.2, 0.018, 0.019, 0.7], 2: [0.3]}
    p = spark.createDataFrame([(f, x) for f, xs in values.items() for x in xs], "f int, p double")
    got = {(r.f, r.p): r.q for r in ranks.benjamini_hochberg(p, ["f"]).collect()}
    # 5 p / rank, and no more than that of a larger p: 0.018 takes the value of 0.019
    want = {(1, 0.002): 0.01, (1, 0.018): 0.095 / 3, (1, 0.019): 0.095 / 3, (1, 0.2): 0.25, (1, 0.7): 0.7, (2, 0.3): 0.3}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_names_and_assembly(spark):
    raw = spark.createDataFrame([(v,) for v in ("9", "Chr9", "chrMT", "X", "NC_000009.12", "CM001012.3", "bad")], "raw string")
    alias = spark.createDataFrame([("cm001012.3", "chr19")], "alias string, ucsc string")
    got = {r.raw: r.chrom_norm for r in names.normalize(raw, "raw", alias).collect()}
    assert got == {"9": "chr9", "Chr9": "chr9", "chrMT": "chrM", "X": "chrX", "NC_000009.12": "chr9", "CM001012.3": "chr19", "bad": None}


def test_special_functions():
    assert special.poisson_upper(np.array([3.0, 0.0]), np.array([2.0, 1.0])) == pytest.approx([1 - math.exp(-2) * (1 + 2 + 2), 1.0])
    tail = sum(math.exp(-100 + k * math.log(100) - math.lgamma(k + 1)) for k in range(150, 400))
    assert special.poisson_upper(np.array([150.0]), np.array([100.0]))[0] == pytest.approx(tail, rel=1e-8)
    assert special.t_two_sided(np.array([2.0]), np.array([10.0]))[0] == pytest.approx(0.07338803, abs=1e-7)
    assert special.t_two_sided(np.array([1.959963985]), np.array([1e6]))[0] == pytest.approx(0.05, abs=1e-6)
    assert special.trigamma(1.0) == pytest.approx(math.pi ** 2 / 6) and special.digamma(1.0) == pytest.approx(-0.5772156649)
    assert special.trigamma(special.inverse_trigamma(0.7)) == pytest.approx(0.7)
    assert special.rank_sum_upper(np.array([4.0, 3.0]), 2, 2) == pytest.approx([1 / 6, 1 / 3])


def test_significant_digits(spark):
    v = spark.createDataFrame([(2.0,), (0.1234567,), (1e-7,), (1234567.0,), (0.0,)], "v double")
    assert [r.t for r in v.select(sinks.significant("v").alias("t")).collect()] == ["2", "0.123457", "1e-07", "1.23457e+06", "0"]


def test_long_and_short_intervals_meet_their_points(spark):
    rng = np.random.default_rng(1)
    iv = [(int(k), int(s), int(s + w)) for k, (s, w) in enumerate(zip(rng.integers(0, 10 ** 7, 60), 10 ** rng.uniform(0, 7, 60)))]
    pts = [int(v) for v in rng.integers(0, 2 * 10 ** 7, 300)]
    a = spark.createDataFrame([("c", p) for p in pts], "chrom string, pos long")
    b = spark.createDataFrame([("c", *t) for t in iv], "chrom string, id int, start long, end long")
    got = sorted((r.pos, r.id) for r in intervals.points_in_intervals(a, b, ["chrom"]).collect())
    assert got == sorted((p, k) for p in pts for k, s, e in iv if s <= p < e)


def test_reciprocal_translocation_and_fold_back(spark):
    sizes = spark.createDataFrame([("t", "A", 100), ("t", "B", 80), ("f", "A", 100)], "sample string, source string, n long")
    joins = spark.createDataFrame([("t", "A", 40, "L", "B", 30, "R"), ("t", "B", 30, "L", "A", 40, "R"), ("f", "A", 40, "L", "A", 60, "L"), ("f", "A", 40, "R", "A", 60, "R")],
                                  "sample string, source1 string, cut1 long, side1 string, source2 string, cut2 long, side2 string")
    d, lost = V.derivatives(joins, sizes)
    rows = sorted((r["sample"], r.derivative, r.ord, r.source, r.a, r.b, r.reverse, r.offset) for r in d.collect())
    assert [r[0:1] + r[3:] for r in rows] == [("f", "A", 0, 40, False, 0), ("f", "A", 40, 60, True, 40), ("f", "A", 60, 100, False, 60), ("t", "A", 0, 40, False, 0), ("t", "B", 30, 80, False, 40),
                                              ("t", "B", 0, 30, False, 0), ("t", "A", 40, 100, False, 30)]
    assert lost.count() == 0


def test_groups(spark):
    pairs = spark.createDataFrame([("g", a, b, abs(a - b)) for a in (1, 5, 9) for b in (2, 6, 7) if abs(a - b) <= 2], "g string, a int, b int, d int")
    assert sorted((r.a, r.b) for r in groups.match_one_to_one(pairs, ["g"], "a", "b", ["d", "a", "b"]).collect()) == [(1, 2), (5, 6), (9, 7)]
    p = spark.createDataFrame([("g", k, s) for k, s in ((0, 1.0), (2, 3.0), (3, 2.0), (9, 1.0), (10, 1.0))], "g string, x int, score double")
    assert sorted(r.x for r in groups.greedy(p, ["g"], ["x"], [2]).collect()) == [2, 9]
    nodes = spark.createDataFrame([("g", k) for k in range(12)], "g string, node int")
    edges = spark.createDataFrame([("g", k, k + 1) for k in range(8)] + [("g", 10, 11)], "g string, a int, b int")
    got = {r.node: r.component for r in groups.components(nodes, edges, ["g"]).collect()}
    assert got == {**{k: 0 for k in range(9)}, 9: 9, 10: 10, 11: 10}


def test_result_does_not_depend_on_partitions(spark):
    rows = [("s", "c", int(i), int(j), 1.0) for i, j in np.random.default_rng(3).integers(0, 30, (400, 2))]
    df = spark.createDataFrame(rows, "sample string, chrom string, i long, j long, cnt double")
    out = [sorted(map(tuple, contacts.sum_contacts(df.repartition(n)).collect())) for n in (1, 7, 32)]
    assert out[0] == out[1] == out[2]


def test_hot_group_ranks_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BUCKET_ROWS", 40)
    rng = np.random.default_rng(0)
    v = np.round(rng.normal(size=4000), 2)
    df = spark.createDataFrame([("hot", float(x)) for x in v] + [("cold", 1.0)], "g string, v double")
    got = {r.v: r["rank"] for r in ranks.value_ranks(df, ["g"], "v").filter("g = 'hot'").collect()}
    for x in (v.min(), np.median(v), v.max(), v[17]):
        below, same = (v < x).sum(), (v == x).sum()
        assert got[float(x)] == pytest.approx(below + (same + 1) / 2)
    q = ranks.quantiles(df, ["g"], "v", {"a": 0.1, "b": 0.73}).filter("g = 'hot'").first()
    assert (q.a, q.b) == (pytest.approx(np.quantile(v, 0.1)), pytest.approx(np.quantile(v, 0.73)))


def test_a_map_is_balanced_alike_alone_and_in_a_cohort(spark):
    rng = np.random.default_rng(9)
    rows = []
    for name, n in (("quick", 20), ("slow", 34), ("tiny", 2)):
        bias = rng.uniform(0.2, 2.0, n)
        rows += [(name, "c", i, j, float(rng.poisson(40 * bias[i] * bias[j]) + 1)) for i in range(n) for j in range(i + 1, n)]
    df = spark.createDataFrame(rows, "sample string, chrom string, i long, j long, cnt double")
    size = spark.createDataFrame([("quick", "c", 20), ("slow", "c", 34), ("tiny", "c", 2)], "sample string, chrom string, n long")
    together, report = balance.kr(df, size)
    alone, _ = balance.kr(df.filter("sample = 'quick'"), size.filter("sample = 'quick'"))
    weight = {(r["sample"], r.bin): r.weight for r in together.collect()}
    assert all(weight["quick", r.bin] == pytest.approx(r.weight, rel=1e-12) for r in alone.collect() if r.weight is not None)
    assert weight["tiny", 0] is None and weight["slow", 5] is not None
    assert {r["sample"]: r.reason for r in report.collect()} == {"quick": None, "slow": None, "tiny": "too few bins with contacts"}
