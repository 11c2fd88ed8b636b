"""Contact tables, bins and tracks."""

from pyspark.sql import functions as F

from ..core import scratch
from ..operators import bins as B, contacts as C
from ..sources import sinks, tables
from .base import query, view

view("v_windows", """
SELECT concat('w', cast(k AS varchar(9))) AS window, sample, chrom, cast(10 * k AS bigint) AS lo, cast(10 * k + 47 AS bigint) AS hi
FROM {v_sizes} CROSS JOIN (SELECT explode(array(1, 2, 5)) AS k) t""", """
SELECT concat('w', cast(k AS varchar(9))) AS window, sample, chrom, cast(10 * k AS bigint) AS lo, cast(10 * k + 47 AS bigint) AS hi
FROM {v_sizes} CROSS JOIN (SELECT unnest([1, 2, 5]) AS k) t""")
view("v_regions", """SELECT concat('r', cast(r_regionkey AS varchar(9))) AS region,
CASE WHEN r_regionkey % 2 = 0 THEN 'chrA' ELSE 'chrR' END AS chrom, cast(r_regionkey * 310000 + 7000 AS bigint) AS start,
cast(r_regionkey * 310000 + 607000 AS bigint) AS end FROM {region}""")
# both triangles and repeated rows, as unsorted exports have them
view("v_loose", """
SELECT sample, chrom, i, j, cnt FROM {v_contacts} UNION ALL SELECT sample, chrom, j AS i, i AS j, cnt + 1 AS cnt FROM {v_contacts}""")
view("v_pixels", """
SELECT sample, i + o1 AS bin1_id, j + o2 AS bin2_id, cast(cnt AS bigint) AS count FROM (
  SELECT *, CASE chrom WHEN 'chrA' THEN 0 WHEN 'chrN' THEN 100 ELSE 200 END AS o1,
            CASE WHEN cnt > 6 THEN 200 WHEN chrom = 'chrA' THEN 0 WHEN chrom = 'chrN' THEN 100 ELSE 200 END AS o2
  FROM {v_contacts}) t""")
view("v_pixel_bins", """
SELECT o + bin AS bin_id, chrom, bin * 20000 AS start, (bin + 1) * 20000 AS end FROM (
  SELECT DISTINCT chrom, bin, CASE chrom WHEN 'chrA' THEN 0 WHEN 'chrN' THEN 100 ELSE 200 END AS o FROM {v_bins}) t""")
view("v_gaps", """
SELECT event_type AS chrom, s AS gap_start, s + 4000 AS gap_end FROM (
  SELECT chrom AS event_type, start - start % 5000 AS s FROM {v_intervals} GROUP BY chrom, start - start % 5000) t""")
view("v_bands", """
SELECT chrom, n_nationkey * 110000 AS band_start, (n_nationkey + 1) * 110000 AS band_end, n_name AS band
FROM {v_chroms} CROSS JOIN (SELECT n_nationkey, n_name FROM {nation}) n""")
view("v_loci", """
SELECT sample, chrom, cast(k AS bigint) AS locus, cast(k * k * 9000 + 3000 AS bigint) AS start,
       cast((k + 1) * (k + 1) * 9000 + 3000 AS bigint) AS stop
FROM {v_sizes} CROSS JOIN (SELECT n_nationkey AS k FROM {nation}) t""")

PX = "sample, chrom, i, j"


@query("bin_pairs", "A1", "SELECT * FROM v_contacts")
def _(t):
    return C.bin_pairs(t("v_pairs"), 20_000)


@query("bin_pairs_in_regions", "A1", """
SELECT sample, region, chrom, least(a, b) AS i, greatest(a, b) AS j, cast(count(*) AS DOUBLE) AS cnt FROM (
  SELECT p.sample, r.region, r.chrom, pos1 // 20000 - start // 20000 AS a, pos2 // 20000 - start // 20000 AS b
  FROM v_pairs p JOIN v_regions r ON p.chrom1 = r.chrom AND p.chrom2 = r.chrom
  WHERE pos1 >= r.start AND pos1 < r.end AND pos2 >= r.start AND pos2 < r.end) t GROUP BY ALL""")
def _(t):
    return C.bin_pairs_in_regions(t("v_pairs"), t("v_regions"), 20_000)


@query("sum_contacts", "A3", f"""
SELECT sample, chrom, least(i, j) AS i, greatest(i, j) AS j, sum(cnt) AS cnt FROM v_loose WHERE i <> j
GROUP BY sample, chrom, least(i, j), greatest(i, j)""")
def _(t):
    return C.sum_contacts(t("v_loose"))


@query("canonical_contacts", "A5", """
SELECT sample, chrom, least(i, j) AS i, greatest(i, j) AS j, max(cnt) AS cnt FROM v_loose WHERE i <> j
GROUP BY sample, chrom, least(i, j), greatest(i, j)""")
def _(t):
    return C.canonical(t("v_loose"))


@query("canonical_min_separation", "A6", """
SELECT sample, chrom, least(i, j) AS i, greatest(i, j) AS j, max(cnt) AS cnt FROM v_loose WHERE abs(i - j) >= 3
GROUP BY sample, chrom, least(i, j), greatest(i, j)""")
def _(t):
    return C.canonical(t("v_loose"), min_sep=3)


PIXEL_SQL = """
SELECT p.sample, a.chrom, least(a.start, b.start) // {r} AS i, greatest(a.start, b.start) // {r} AS j,
       cast({f}(p.count) AS DOUBLE) AS cnt
FROM v_pixels p JOIN v_pixel_bins a ON p.bin1_id = a.bin_id JOIN v_pixel_bins b ON p.bin2_id = b.bin_id
WHERE a.chrom = b.chrom AND a.start // {r} <> b.start // {r} GROUP BY ALL"""


@query("pixels_own_resolution", "A4", PIXEL_SQL.format(r=20000, f="max").replace(
    "least(a.start, b.start) // 20000 AS i, greatest(a.start, b.start) // 20000 AS j",
    "least(a.start // 20000, b.start // 20000) AS i, greatest(a.start // 20000, b.start // 20000) AS j"))
def _(t):
    return C.pixels_to_contacts(t("v_pixels"), t("v_pixel_bins"))


@query("pixels_coarser_resolution", "A4", """
SELECT p.sample, a.chrom, least(a.start // 40000, b.start // 40000) AS i, greatest(a.start // 40000, b.start // 40000) AS j,
       cast(sum(p.count) AS DOUBLE) AS cnt
FROM v_pixels p JOIN v_pixel_bins a ON p.bin1_id = a.bin_id JOIN v_pixel_bins b ON p.bin2_id = b.bin_id
WHERE a.chrom = b.chrom AND a.start // 40000 <> b.start // 40000 GROUP BY ALL""")
def _(t):
    return C.pixels_to_contacts(t("v_pixels"), t("v_pixel_bins"), 40_000)


@query("coarsen", "A7", "SELECT sample, chrom, i // 7 AS i, j // 7 AS j, sum(cnt) AS cnt FROM v_contacts GROUP BY ALL")
def _(t):
    return C.coarsen(t("v_contacts"), 7)


@query("coarsen_whole_blocks", "A7", """
SELECT c.sample, c.chrom, i // 7 AS i, j // 7 AS j, sum(cnt) AS cnt FROM v_contacts c
JOIN v_sizes s ON c.sample = s.sample AND c.chrom = s.chrom WHERE j // 7 < n // 7 GROUP BY ALL""")
def _(t):
    return C.coarsen(t("v_contacts"), 7, sizes=t("v_sizes"))


@query("coarsen_windows", "A7", """
SELECT "window", sample, chrom, k, i, j, cnt FROM (
  SELECT "window", sample, chrom, k, a AS i, b AS j, cnt FROM blocks UNION ALL
  SELECT "window", sample, chrom, k, b, a, cnt FROM blocks WHERE a <> b)
""".replace("SELECT \"window\", sample, chrom, k, i, j, cnt FROM (", """WITH blocks AS (
  SELECT w."window", c.sample, c.chrom, cast(ceil((hi - lo) / 20.0) AS BIGINT) AS k,
         (i - lo) // cast(ceil((hi - lo) / 20.0) AS BIGINT) AS a, (j - lo) // cast(ceil((hi - lo) / 20.0) AS BIGINT) AS b, sum(cnt) AS cnt
  FROM v_contacts c JOIN v_windows w ON c.sample = w.sample AND c.chrom = w.chrom WHERE i >= lo AND j < hi GROUP BY ALL)
SELECT * FROM (""", 1))
def _(t):
    return C.coarsen_windows(t("v_contacts"), t("v_windows").withColumn("k", F.ceil((F.col("hi") - F.col("lo")) / 20)))


@query("pyramid", "A8", """
SELECT sample, chrom, f * 20000 AS resolution, i // f AS i, j // f AS j, sum(cnt) AS cnt
FROM v_contacts CROSS JOIN (SELECT unnest([1, 2, 5, 10, 25]) AS f) t GROUP BY ALL""")
def _(t):
    return C.pyramid(t("v_contacts"), 20_000)


@query("pick_resolution", "A9", """
SELECT p_brand AS file, max(CASE WHEN 600000 % (p_size * 1000) = 0 THEN p_size * 1000 END) AS resolution FROM part GROUP BY p_brand""")
def _(t):
    files = t("part").select(F.col("p_brand").alias("file"), (F.col("p_size") * 1000).alias("resolution"))
    return C.pick_resolution(files, 600_000)


TRACK_SQL = """
SELECT g.chrom, g.bin, {v} AS value FROM (
  SELECT chrom, size, unnest(generate_series(cast(0 AS BIGINT), (size - 1) // 21600)) AS bin FROM v_chroms) g
LEFT JOIN (SELECT i.chrom, bin, sum(value * ov) AS s, sum(ov) AS c FROM (
    SELECT chrom, value, bin, least("end", (bin + 1) * 21600) - greatest(start, bin * 21600) AS ov FROM (
      SELECT *, unnest(generate_series(start // 21600, ("end" - 1) // 21600)) AS bin FROM v_intervals) u) i
  GROUP BY i.chrom, bin) a ON g.chrom = a.chrom AND g.bin = a.bin"""


@query("track_mean", "A10, A11, A24", TRACK_SQL.format(v="round(s / c, 6)"))
def _(t):
    return B.bin_intervals(t("v_intervals"), t("v_chroms"), 21_600).withColumn("value", F.round("value", 6))


@query("track_coverage", "A10", TRACK_SQL.format(v="round(coalesce(s, 0) / 21600, 4)"))
def _(t):
    return B.bin_intervals(t("v_intervals"), t("v_chroms"), 21_600, "coverage").withColumn("value", F.round("value", 4))


@query("binned_mean", "A11", "SELECT chrom, start // 3600 AS bin, round(avg(value), 6) AS value FROM v_intervals GROUP BY ALL")
def _(t):
    return B.binned_mean(t("v_intervals"), 3_600, pos="start").withColumn("value", F.round("value", 6))


@query("bin_grid", "A17", """
SELECT chrom, bin, bin * 21600 AS start, least((bin + 1) * 21600, size) AS "end", least((bin + 1) * 21600, size) - bin * 21600 AS length
FROM (SELECT chrom, size, unnest(generate_series(cast(0 AS BIGINT), (size - 1) // 21600)) AS bin FROM v_chroms) g""")
def _(t):
    return B.bin_grid(t("v_chroms"), 21_600)


RES_LIST = "[5000, 10000, 20000, 25000, 40000, 50000, 100000, 250000, 500000, 1000000]"


@query("default_resolution", "A17", f"""
SELECT c_custkey, size, coalesce((SELECT min(r) FROM (SELECT unnest({RES_LIST}) AS r) WHERE ceil(size / r) <= 6000), 1000000) AS resolution
FROM (SELECT c_custkey, c_custkey * 300000 + 1 AS size FROM customer) t""")
def _(t):
    return B.default_resolution(t("customer").select("c_custkey", (F.col("c_custkey") * 300_000 + 1).alias("size")))


@query("resolution_for_beads", "A17", f"""
SELECT c_custkey, size, beads, coalesce((SELECT min(r) FROM (SELECT unnest({RES_LIST}) AS r) WHERE ceil(size / r) = beads),
  greatest(1, cast(ceil(size / greatest(beads, 1)) AS BIGINT))) AS resolution
FROM (SELECT c_custkey, c_custkey * 300000 + 1 AS size, c_custkey * (2 + c_nationkey) + 1 AS beads FROM customer) t""")
def _(t):
    return B.resolution_for_beads(t("customer").select(
        "c_custkey", (F.col("c_custkey") * 300_000 + 1).alias("size"),
        (F.col("c_custkey") * (2 + F.col("c_nationkey")) + 1).alias("beads")))


@query("gap_fraction", "A18", """
SELECT g.chrom, g.bin, round(coalesce(sum(CASE WHEN gap_end IS NOT NULL THEN greatest(0, least(hi, gap_end) - greatest(lo, gap_start)) END), 0) / (hi - lo), 9) AS gap_fraction,
       coalesce(sum(CASE WHEN gap_end IS NOT NULL THEN greatest(0, least(hi, gap_end) - greatest(lo, gap_start)) END), 0) / (hi - lo) <= 0.5 AS assembled
FROM (SELECT chrom, bin, bin * 21600 AS lo, least((bin + 1) * 21600, size) AS hi FROM (
        SELECT chrom, size, unnest(generate_series(cast(0 AS BIGINT), (size - 1) // 21600)) AS bin FROM v_chroms) u) g
LEFT JOIN v_gaps x ON g.chrom = x.chrom AND x.gap_start < hi AND x.gap_end > lo GROUP BY g.chrom, g.bin, lo, hi""")
def _(t):
    grid = B.bin_grid(t("v_chroms"), 21_600)
    return (B.gap_fraction(grid, t("v_gaps"), 21_600)
            .select("chrom", "bin", F.round("gap_fraction", 9).alias("gap_fraction"), "assembled"))


@query("band_for_bins", "A18", """
SELECT g.chrom, g.bin, b.band FROM (SELECT chrom, bin, (bin * 21600 + least((bin + 1) * 21600, size)) // 2 AS mid FROM (
        SELECT chrom, size, unnest(generate_series(cast(0 AS BIGINT), (size - 1) // 21600)) AS bin FROM v_chroms) u) g
JOIN v_bands b ON g.chrom = b.chrom AND mid >= band_start AND mid < band_end""")
def _(t):
    return B.band_for_bins(B.bin_grid(t("v_chroms"), 21_600), t("v_bands")).select("chrom", "bin", "band")


@query("sum_to_loci", "A25", """
SELECT c.sample, c.chrom, least(x.locus, y.locus) AS a, greatest(x.locus, y.locus) AS b, sum(cnt) AS cnt FROM v_contacts c
JOIN v_loci x ON c.sample = x.sample AND c.chrom = x.chrom AND i * 20000 + 10000 >= x.start AND i * 20000 + 10000 < x.stop
JOIN v_loci y ON c.sample = y.sample AND c.chrom = y.chrom AND j * 20000 + 10000 >= y.start AND j * 20000 + 10000 < y.stop
GROUP BY ALL""")
def _(t):
    return C.sum_to_loci(t("v_contacts"), t("v_loci"), 20_000)


@query("validate_contacts", "A29", """
SELECT c.sample, c.chrom, count(*) AS pixels, count(*) FILTER (i < 0 OR j < 0 OR i >= 90 OR j >= 90) AS bad_index,
       count(*) FILTER (c IS NULL) AS not_finite, count(*) FILTER (c < 0) AS negative
FROM (SELECT sample, chrom, i, j - 5 AS j, CASE WHEN cnt <> 2 THEN cnt - 3 END AS c FROM v_contacts) c GROUP BY ALL""")
def _(t):
    rough = t("v_contacts").select("sample", "chrom", "i", (F.col("j") - 5).alias("j"),
                                   F.when(F.col("cnt") != 2, F.col("cnt") - 3).alias("cnt"))
    return C.validate(rough, t("v_sizes").withColumn("n", F.lit(90)))


@query("window_mismatch", "A29", """
SELECT chrom, count(DISTINCT (start, n, resolution)) AS windows FROM (
  SELECT concat('chr', l_returnflag) AS chrom, l_suppkey % 4 AS sample, min(l_orderkey) AS start, 100 AS n, 20000 AS resolution
  FROM lineitem GROUP BY ALL) t GROUP BY chrom HAVING count(DISTINCT (start, n, resolution)) > 1""")
def _(t):
    w = t("lineitem").groupBy(F.concat(F.lit("chr"), "l_returnflag").alias("chrom"), (F.col("l_suppkey") % 4).alias("sample")).agg(
        F.min("l_orderkey").alias("start")).withColumns({"n": F.lit(100), "resolution": F.lit(20_000)})
    return C.window_mismatch(w)


@query("window_slice", "A30", """
SELECT "window", c.sample, c.chrom, i - lo AS i, j - lo AS j, cnt FROM v_contacts c
JOIN v_windows w ON c.sample = w.sample AND c.chrom = w.chrom WHERE i >= lo AND j < hi AND i <> j""")
def _(t):
    w = t("v_windows").select("window", "sample", "chrom", F.col("lo").alias("bin0"), (F.col("hi") - F.col("lo")).alias("n"))
    return C.window_slice(t("v_contacts"), w)


@query("track_slice", "A30", """
SELECT "window", b.sample, b.chrom, bin - lo AS bin, cov FROM v_cover b
JOIN v_windows w ON b.sample = w.sample AND b.chrom = w.chrom WHERE bin >= lo AND bin < hi""")
def _(t):
    w = t("v_windows").select("window", "sample", "chrom", F.col("lo").alias("bin0"), (F.col("hi") - F.col("lo")).alias("n"))
    return C.track_slice(t("v_cover").drop("n"), w).select("window", "sample", "chrom", "bin", "cov")


@query("clamp_region", "G11", """
SELECT o_orderkey, 5000000 AS size, greatest(0, least(s, 4800000)) AS start,
       least(5000000, greatest(e, greatest(0, least(s, 4800000)) + 200000)) AS "end"
FROM (SELECT o_orderkey, o_custkey * 7919 % 6000000 - 500000 AS s, o_custkey * 7919 % 6000000 - 500000 + o_orderkey % 900 * 1000 AS e FROM orders) t""")
def _(t):
    s = F.col("o_custkey") * 7919 % 6_000_000 - 500_000
    r = t("orders").select("o_orderkey", F.lit(5_000_000).alias("size"), s.alias("start"),
                           (s + F.col("o_orderkey") % 900 * 1000).alias("end"))
    return C.clamp_region(r, "size", min_size=200_000)


@query("share_into_loci", "A31", """
SELECT l.chrom, l.locus, l.pos, round(coalesce(sum(value * ov / ("end" - start)), 0), 6) AS signal FROM (
  SELECT chrom, n_nationkey AS locus, n_nationkey * 90000 + 500 AS pos FROM v_chroms CROSS JOIN nation) l
LEFT JOIN (SELECT p.chrom, x.pos, value, start, "end", least("end", x.pos + 30000) - greatest(start, x.pos) AS ov
  FROM v_intervals p JOIN (SELECT n_nationkey * 90000 + 500 AS pos FROM nation) x ON start < x.pos + 30000 AND "end" > x.pos) o
  ON l.chrom = o.chrom AND l.pos = o.pos GROUP BY l.chrom, l.locus, l.pos""")
def _(t):
    loci = t("v_chroms").select("chrom").join(t("nation").select(
        F.col("n_nationkey").alias("locus"), (F.col("n_nationkey") * 90_000 + 500).alias("pos")), how="cross")
    return B.share_into_loci(t("v_intervals"), loci, 30_000).withColumn("signal", F.round("signal", 6))


@query("pyramid_weights", "A8, B2", """
SELECT p.sample, p.chrom, p.resolution, p.i, p.j, p.cnt, round(CASE WHEN p.resolution = 20000 THEN a.weight END, 9) AS weight_i,
       round(CASE WHEN p.resolution = 20000 THEN b.weight END, 9) AS weight_j
FROM (SELECT sample, chrom, 20000 * f AS resolution, i // f AS i, j // f AS j, sum(cnt) AS cnt FROM v_contacts, (VALUES (1), (4)) t(f) GROUP BY ALL) p
LEFT JOIN v_weights a ON p.sample = a.sample AND p.chrom = a.chrom AND p.i = a.bin
LEFT JOIN v_weights b ON p.sample = b.sample AND p.chrom = b.chrom AND p.j = b.bin""")
def _(t):
    p = C.pyramid(t("v_contacts"), 20_000, (1, 4), weights=t("v_weights"))
    return p.withColumns({k: F.round(k, 9) for k in ("weight_i", "weight_j")})


@query("pyramid_written", "A8, A27", """SELECT sample, chrom, resolution, count(*) AS pixels, sum(i) AS i, sum(j) AS j, sum(cnt) AS cnt FROM (
  SELECT sample, chrom, 20000 * f AS resolution, i // f AS i, j // f AS j, sum(cnt) AS cnt FROM v_contacts, (VALUES (1), (2), (8)) t(f) GROUP BY ALL) p GROUP BY ALL""")
def _(t):
    path = scratch(t.spark, "pyramid")
    sinks.write_pyramid(C.pyramid(t("v_contacts"), 20_000, (1, 2, 8)), path)
    back = t.spark.read.parquet(path)
    return back.groupBy("sample", "chrom", F.col("resolution").cast("long").alias("resolution")).agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("i").alias("i"), F.sum("j").alias("j"), F.sum("cnt").alias("cnt"))


@query("pixels_written", "A27, C9", """SELECT concat_ws(chr(9), chrom, i * 20000, (i + 1) * 20000, chrom, j * 20000, (j + 1) * 20000, '.', '.', cast(cnt AS VARCHAR), '.') AS line, count(*) AS times
FROM v_off GROUP BY ALL""")
def _(t):
    path = scratch(t.spark, "pixels")
    px = t("v_off").withColumns({"start": F.lit(0).cast("long"), "log2_fc": F.col("cnt")})
    sinks.write_lines(sinks.pixel_bedpe_lines(px, 20_000), path)
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("times"))


@query("pairs_from_files", "A2, A13", """SELECT kind, chrom1, chrom2, count(*) AS pairs, cast(sum(pos1) AS BIGINT) AS first, cast(sum(pos2) AS BIGINT) AS second
FROM v_pairs, (SELECT 'pairs' AS kind) k GROUP BY ALL""")
def _(t):
    path = scratch(t.spark, "files")
    line = F.concat_ws("\t", F.lit("."), "chrom1", F.col("pos1").cast("string"), "chrom2", F.col("pos2").cast("string"), F.lit("+"), F.lit("-"))
    t("v_pairs").select(line.alias("value"), "sample").write.partitionBy("sample").text(path)
    got = tables.read_pairs(t.spark, f"{path}/*")
    return got.groupBy(F.lit("pairs").alias("kind"), "chrom1", "chrom2").agg(F.count(F.lit(1)).alias("pairs"), F.sum("pos1").alias("first"), F.sum("pos2").alias("second"))
