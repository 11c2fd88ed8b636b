"""Structural variants, jobs and streaming."""

from pyspark.sql import functions as F

from ..core import cut, scratch
from ..operators import variants as V
from ..plans import jobs as J, suite as SU
from ..sources import variants as RV
from ..streaming import pairs as SP
from .base import ORACLES, query, view
from .compare import TESTED
from .maps import BOUND_TAIL, INS, PS, r

# VCF-like text with one line per order
view("v_vcf", """SELECT 'cohort.vcf' AS file, o_orderkey + 1 AS line_no, CASE WHEN o_custkey % 41 = 0 THEN concat_ws('\t', 'chr1', 'x', 'short') ELSE
 concat_ws('\t', CASE o_orderkey % 3 WHEN 0 THEN 'chr1' WHEN 1 THEN '2' ELSE 'MT' END, cast(o_orderkey % 4000 * 1000 + 5001 AS varchar(20)), concat('v', cast(o_orderkey AS varchar(20))), 'N',
  CASE o_orderpriority WHEN '1-URGENT' THEN '<DEL>' WHEN '2-HIGH' THEN '<DUP:TANDEM>' WHEN '3-MEDIUM' THEN concat('N[chr2:', cast(o_custkey % 3000 * 1000 + 7 AS varchar(20)), '[') WHEN '4-NOT SPECIFIED' THEN '<INV>' ELSE '<CNV>' END, '.', 'PASS',
  CASE WHEN o_custkey % 2 = 0 THEN concat('END=', cast(o_orderkey % 4000 * 1000 + 5001 + o_custkey % 90 * 7000 AS varchar(20)), ';CN=', cast(o_custkey % 5 AS varchar(20)))
       WHEN o_custkey % 3 = 0 THEN concat('SVLEN=-', cast(o_custkey % 90 * 7000 AS varchar(20))) ELSE 'IMPRECISE' END, 'GT:CN',
  concat(CASE o_custkey % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '1|1' WHEN 2 THEN './.' ELSE '1/2' END, ':', CASE WHEN o_custkey % 7 = 0 THEN '.' ELSE cast(o_custkey % 6 AS varchar(20)) END), CASE WHEN o_custkey % 5 = 0 THEN '0|0:2' ELSE '1/1' END) END AS value FROM {orders}""")
view("v_sv", """SELECT *, CASE pr WHEN '1-URGENT' THEN 'DEL' WHEN '2-HIGH' THEN 'DUP' WHEN '3-MEDIUM' THEN 'BND' WHEN '4-NOT SPECIFIED' THEN 'INV' ELSE '' END AS kind FROM (
 SELECT o_orderkey + 1 AS source_line, o_custkey, o_orderpriority AS pr, o_custkey % 41 = 0 AS short, CASE o_orderkey % 3 WHEN 0 THEN 'chr1' WHEN 1 THEN 'chr2' ELSE 'chrM' END AS chrom, o_orderkey % 4000 * 1000 + 5000 AS p0,
  CASE WHEN o_custkey % 2 = 0 THEN o_orderkey % 4000 * 1000 + 5001 + o_custkey % 90 * 7000 WHEN o_custkey % 3 = 0 THEN o_orderkey % 4000 * 1000 + 5001 + o_custkey % 90 * 7000 END AS e, concat('v', cast(o_orderkey AS varchar(20))) AS vid,
  concat('N[chr2:', cast(o_custkey % 3000 * 1000 + 7 AS varchar(20)), '[') AS alt, o_custkey % 3000 * 1000 + 6 AS mpos FROM {orders}) t""")


@query("read_vcf", "A19", """SELECT source_line, kind, chrom, CASE WHEN kind = 'BND' THEN p0 ELSE p0 + 1 END AS start, CASE WHEN kind = 'BND' THEN p0 + 1 ELSE e END AS "end", CASE WHEN kind = 'BND' THEN 'chr2' END AS mate_chrom,
  CASE WHEN kind = 'BND' THEN mpos END AS mate_pos, CASE WHEN kind = 'BND' THEN alt ELSE '' END AS orientation, vid FROM v_sv WHERE NOT short AND kind <> '' AND (kind = 'BND' OR e > p0 + 1)""")
def _(t):
    return RV.read_vcf(t("v_vcf"))[0].drop("file")


@query("rejected_vcf_lines", "A19", """SELECT source_line, CASE WHEN short THEN 'fewer than 8 VCF columns' WHEN kind = '' THEN 'unsupported SV type' WHEN e IS NULL THEN 'no END or SVLEN' ELSE 'END is not after POS' END AS reason
FROM v_sv WHERE short OR kind = '' OR (kind <> 'BND' AND (e IS NULL OR e <= p0 + 1))""")
def _(t):
    return RV.read_vcf(t("v_vcf"))[1].drop("file")


view("v_bedpe", """SELECT 'calls.bedpe' AS file, o_orderkey + 1 AS line_no, concat_ws('\t', CASE WHEN o_custkey % 3 = 0 THEN 'chr1' ELSE '2' END, cast(o_custkey * 100 AS varchar(20)), cast(o_custkey * 100 + 50 AS varchar(20)), CASE WHEN o_custkey % 5 = 0 THEN 'chr3' WHEN o_custkey % 3 = 0 THEN 'chr1' ELSE '2' END,
  cast(o_orderkey % 3000 * 90 AS varchar(20)), cast(o_orderkey % 3000 * 90 + 50 AS varchar(20)), concat('n', cast(o_orderkey AS varchar(20))), '.', CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END,
  CASE o_orderstatus WHEN 'F' THEN 'deletion' WHEN 'O' THEN '.' ELSE 'INV' END) AS value FROM {orders}""")


@query("read_bedpe", "A20", """WITH q AS (SELECT o_orderkey + 1 AS source_line, CASE WHEN o_custkey % 3 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, o_custkey * 100 + 25 AS m1, o_orderkey % 3000 * 90 + 25 AS m2, o_custkey % 5 = 0 AS x, concat('n', o_orderkey) AS vid,
  concat(CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END, CASE WHEN o_custkey % 2 = 0 THEN '+' ELSE '-' END) AS st, o_orderstatus AS s FROM orders)
SELECT source_line, CASE WHEN x THEN 'BND' WHEN s = 'F' THEN 'DEL' WHEN s <> 'O' THEN 'INV' ELSE CASE st WHEN '+-' THEN 'DEL' WHEN '-+' THEN 'DUP' ELSE 'INV' END END AS kind, chrom, CASE WHEN x THEN m1 ELSE least(m1, m2) END AS start,
  CASE WHEN x THEN m1 + 1 ELSE greatest(m1, m2) END AS "end", CASE WHEN x THEN 'chr3' END AS mate_chrom, CASE WHEN x THEN m2 END AS mate_pos, st AS orientation, vid FROM q WHERE x OR m1 <> m2""")
def _(t):
    return RV.read_bedpe(t("v_bedpe"))[0].drop("file")


@query("genotypes", "A21", """WITH o AS (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN cast(o_custkey % 5 AS DOUBLE) END AS info FROM orders WHERE o_custkey % 41 <> 0)
SELECT o_orderkey + 1 AS source_line, 1 AS sample_no, CASE o_custkey % 4 WHEN 0 THEN '0/1' WHEN 1 THEN '1/1' WHEN 2 THEN './.' ELSE '1/2' END AS gt,
  CASE WHEN o_custkey % 7 <> 0 THEN cast(o_custkey % 6 AS DOUBLE) ELSE info END AS cn, CASE WHEN o_custkey % 4 IN (1, 3) THEN 'homozygous' ELSE 'heterozygous' END AS zygosity FROM o
UNION ALL SELECT o_orderkey + 1, 2, CASE WHEN o_custkey % 5 = 0 THEN '0/0' ELSE '1/1' END, CASE WHEN o_custkey % 5 = 0 THEN 2.0 ELSE info END, CASE WHEN o_custkey % 5 = 0 THEN 'heterozygous' ELSE 'homozygous' END FROM o""")
def _(t):
    return RV.genotypes(t("v_vcf")).drop("file")


# variants as a table; each nation is a cohort sample with two windows
view("v_variants", """SELECT concat('n', cast(c_nationkey AS varchar(9))) AS sample, vid, CASE WHEN kind = '' THEN 'DEL' ELSE kind END AS kind, CASE WHEN s.o_custkey % 3 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, p0 AS start, CASE WHEN kind = 'BND' THEN p0 + 1 ELSE p0 + 1 + s.o_custkey % 90 * 7000 END AS end,
  CASE WHEN kind = 'BND' THEN 'chr2' END AS mate_chrom, CASE WHEN kind = 'BND' THEN mpos END AS mate_pos, CASE WHEN kind = 'BND' THEN CASE WHEN s.o_custkey % 9 = 0 THEN '++' WHEN s.o_custkey % 9 = 1 THEN 'odd' ELSE alt END ELSE '' END AS orientation FROM {v_sv} s JOIN {customer} c ON s.o_custkey = c.c_custkey""".replace(" AS end,", " AS `end`,"),
     """SELECT concat('n', c_nationkey) AS sample, vid, CASE WHEN kind = '' THEN 'DEL' ELSE kind END AS kind, CASE WHEN s.o_custkey % 3 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, p0 AS start, CASE WHEN kind = 'BND' THEN p0 + 1 ELSE p0 + 1 + s.o_custkey % 90 * 7000 END AS "end",
  CASE WHEN kind = 'BND' THEN 'chr2' END AS mate_chrom, CASE WHEN kind = 'BND' THEN mpos END AS mate_pos, CASE WHEN kind = 'BND' THEN CASE WHEN s.o_custkey % 9 = 0 THEN '++' WHEN s.o_custkey % 9 = 1 THEN 'odd' ELSE alt END ELSE '' END AS orientation FROM {v_sv} s JOIN {customer} c ON s.o_custkey = c.c_custkey""")
view("v_svwin", """SELECT concat('n', cast(n_nationkey AS varchar(9))) AS sample, source, chrom, bin0, n, ord FROM {nation} CROSS JOIN (
  SELECT 'A' AS source, 'chr1' AS chrom, cast(20 AS bigint) AS bin0, cast(150 AS bigint) AS n, 0 AS ord UNION ALL SELECT 'B', 'chr2', cast(0 AS bigint), cast(120 AS bigint), 1) w""")


@query("place_in_windows", "I1", """WITH j AS (SELECT v.*, w.source, w.chrom AS wc, bin0, n, start // 20000 - bin0 AS a0, cast(ceil("end" / 20000.0) AS BIGINT) - bin0 AS b0, kind = 'BND' AS bnd, v.chrom = w.chrom AS here, coalesce(mate_chrom = w.chrom, false) AS mate FROM v_variants v JOIN v_svwin w ON v.sample = w.sample),
k AS (SELECT *, greatest(0, a0) AS a, least(n, b0) AS b, CASE WHEN here THEN start ELSE mate_pos END // 20000 - bin0 AS bp FROM j),
q AS (SELECT *, CASE WHEN NOT bnd AND NOT here THEN 'on another chromosome' WHEN NOT bnd AND (b0 <= 0 OR a0 >= n) THEN 'outside the loaded window' WHEN kind = 'INV' AND b - a < 2 THEN 'inversion shorter than two beads at this resolution'
  WHEN kind = 'DEL' AND a = 0 AND b = n THEN 'deletes the whole loaded window' WHEN bnd AND here AND mate THEN 'both breakends on this chromosome: give it as DEL, DUP or INV' WHEN bnd AND NOT here AND NOT mate THEN 'joins other chromosomes'
  WHEN bnd AND (bp < 2 OR bp > n - 1) THEN 'breakpoint outside the loaded window' END AS reason FROM k)
SELECT sample, vid, source, CASE WHEN reason IS NULL THEN CASE kind WHEN 'BND' THEN 'translocation' WHEN 'DEL' THEN 'deletion' WHEN 'DUP' THEN 'duplication' ELSE 'inversion' END END AS operation, CASE WHEN reason IS NULL AND NOT bnd THEN a END AS a, CASE WHEN reason IS NULL AND NOT bnd THEN b END AS b,
  CASE WHEN reason IS NULL AND bnd THEN bp END AS breakpoint, CASE WHEN reason IS NULL AND bnd THEN CASE WHEN here THEN mate_chrom ELSE chrom END END AS partner, CASE WHEN reason IS NULL AND bnd THEN CASE WHEN here THEN mate_pos ELSE start END END AS partner_start, reason FROM q""")
def _(t):
    return V.place_in_windows(t("v_variants"), t("v_svwin"), 20_000)


@query("breakend_joins", "I2", """WITH p AS (SELECT v.*, CASE kind WHEN 'BND' THEN mate_chrom ELSE chrom END AS c2, CASE kind WHEN 'BND' THEN mate_pos ELSE "end" END AS x2, CASE WHEN orientation = '++' THEN 'LL' WHEN ends_with(orientation, '[') THEN 'LR' END AS sd FROM v_variants v),
c AS (SELECT p.*, a.source AS s1, cast(round_even(start / 20000.0, 0) AS BIGINT) - a.bin0 AS k1, b.source AS s2, cast(round_even(x2 / 20000.0, 0) AS BIGINT) - b.bin0 AS k2 FROM p
  LEFT JOIN v_svwin a ON a.sample = p.sample AND a.chrom = p.chrom AND cast(round_even(start / 20000.0, 0) AS BIGINT) - a.bin0 > 0 AND cast(round_even(start / 20000.0, 0) AS BIGINT) - a.bin0 < a.n
  LEFT JOIN v_svwin b ON b.sample = p.sample AND b.chrom = p.c2 AND cast(round_even(x2 / 20000.0, 0) AS BIGINT) - b.bin0 > 0 AND cast(round_even(x2 / 20000.0, 0) AS BIGINT) - b.bin0 < b.n),
q AS (SELECT *, CASE WHEN kind = 'BND' AND sd IS NULL THEN 'breakend orientation not given' WHEN kind = 'BND' AND (s1 IS NULL OR s2 IS NULL) THEN 'a breakend is outside the loaded windows' WHEN kind <> 'BND' AND (s1 IS NULL OR s2 IS NULL OR s1 <> s2) THEN 'the variant is not inside one loaded window'
  WHEN kind <> 'BND' AND k2 - k1 < 1 THEN 'shorter than one bead at this resolution' WHEN kind = 'DUP' THEN 'tandem duplication: use the copy-number path' END AS reason FROM c),
x AS (SELECT *, unnest(CASE WHEN reason IS NOT NULL THEN [NULL] WHEN kind = 'BND' THEN [sd] WHEN kind = 'DEL' THEN ['LR'] ELSE ['LL', 'RR'] END) AS s FROM q)
SELECT sample, vid, kind, CASE WHEN reason IS NULL THEN s1 END AS source1, CASE WHEN reason IS NULL THEN k1 END AS cut1, s[1] AS side1, CASE WHEN reason IS NULL THEN s2 END AS source2, CASE WHEN reason IS NULL THEN k2 END AS cut2, s[2] AS side2, reason FROM x""")
def _(t):
    return V.joins_of(t("v_variants"), t("v_svwin"), 20_000)


# one deletion-like or inversion-like join set per customer: cuts from its keys
view("v_karyo_sizes", "SELECT concat('c', cast(c_custkey AS varchar(12))) AS sample, source, cast(100 AS bigint) AS n FROM {customer} CROSS JOIN (SELECT 'A' AS source UNION ALL SELECT 'B') s")
view("v_joins", """SELECT concat('c', cast(c_custkey AS varchar(12))) AS sample, 'A' AS source1, 10 + c_custkey % 30 AS cut1, 'L' AS side1, CASE WHEN c_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS source2, 50 + c_custkey % 41 AS cut2, CASE WHEN c_nationkey % 3 = 0 THEN 'L' ELSE 'R' END AS side2 FROM {customer}""")
# what one join does: a deletion (LR within A), a fold-back (LL within A), or an exchange with B
DERIV = """d AS (SELECT sample, cut1, cut2, CASE WHEN source2 = 'A' AND side2 = 'R' THEN 'del' WHEN source2 = 'A' THEN 'fold' WHEN side2 = 'R' THEN 'AB' ELSE 'ABrev' END AS k FROM v_joins)"""


@query("derivative_chromosomes", "I3", f"""WITH {DERIV}
SELECT sample, 1 AS ord, 'A' AS source, 0 AS a, cut1 AS b, false AS reverse, 0 AS "offset", false AS junction FROM d
UNION ALL SELECT sample, 2, CASE WHEN k IN ('del') THEN 'A' WHEN k = 'fold' THEN 'A' ELSE 'B' END, CASE WHEN k IN ('del', 'AB') THEN cut2 WHEN k = 'fold' THEN cut1 ELSE 0 END,
  CASE WHEN k IN ('del', 'AB') THEN 100 ELSE cut2 END, k IN ('fold', 'ABrev'), cut1, true FROM d""")
def _(t):
    d, _lost = V.derivatives(t("v_joins"), t("v_karyo_sizes"))
    return d.drop("derivative")


@query("lost_pieces", "I3", f"WITH {DERIV} SELECT sample, 'A' AS source, cut1 AS a, cut2 AS b FROM d WHERE k = 'del'")
def _(t):
    return V.derivatives(t("v_joins"), t("v_karyo_sizes"))[1]


@query("rejected_samples", "I3", "SELECT DISTINCT concat('n', c_nationkey) AS sample, 'a breakend side is joined twice' AS reason FROM customer")
def _(t):
    j = t("v_joins").join(t("customer"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")) == F.col("sample")).withColumn("sample", F.concat(F.lit("n"), F.col("c_nationkey").cast("string")))
    sizes = t("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("sample"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("source"), F.lit(100).alias("n"))
    return V.rejected_samples(j, sizes)


view("v_zyg", "SELECT concat('c', cast(c_custkey AS varchar(12))) AS sample, CASE WHEN c_acctbal > 5000 THEN 'homozygous' ELSE 'heterozygous' END AS zygosity FROM {customer}")


@query("karyotype_copies", "I4", "SELECT s.sample, s.source, CASE WHEN zygosity = 'homozygous' THEN 0.0 ELSE 1.0 END AS reference_copies, CASE WHEN zygosity = 'homozygous' THEN 2.0 ELSE 1.0 END AS derivative_copies FROM v_karyo_sizes s JOIN v_zyg z USING (sample)")
def _(t):
    seg = t("v_karyo_sizes").select("sample", F.lit("d").alias("derivative"))
    d, ref = V.karyotype(seg, t("v_karyo_sizes"), t("v_zyg"))
    return ref.join(d.select("sample", F.col("copies").alias("derivative_copies")), "sample")


@query("parse_segments", "I4", """SELECT c_custkey, ord, source, a, b, reverse FROM (SELECT c_custkey, 1 AS ord, 'A' AS source, 0 AS a, 10 + c_custkey % 30 AS b, false AS reverse FROM customer UNION ALL
  SELECT c_custkey, 2, 'B', 5, 60 + c_custkey % 7, true FROM customer UNION ALL SELECT c_custkey, 3, NULL, NULL, NULL, NULL FROM customer WHERE c_nationkey % 2 = 0) t""")
def _(t):
    text = F.concat(F.lit("A:0-"), (10 + F.col("c_custkey") % 30).cast("string"), F.lit(" + B:5-"), (60 + F.col("c_custkey") % 7).cast("string"), F.lit("(-)"), F.when(F.col("c_nationkey") % 2 == 0, " + oops").otherwise(""))
    return V.parse_segments(t("customer").select("c_custkey", text.alias("text"))).drop("text")


view("v_cnseg", "SELECT concat('c', cast(c_custkey AS varchar(12))) AS sample, 'A' AS source, cast(c_custkey % 40 AS bigint) AS a, cast(c_custkey % 40 + 20 AS bigint) AS b, cast(c_nationkey % 4 AS double) AS cn FROM {customer}")


@query("karyotype_from_copy_number", "I4", """SELECT sample, source, concat(CASE WHEN cn < 2 THEN 'loss' ELSE 'gain' END, ' of ', a, '-', b) AS derivative, 1 AS ord, CASE WHEN cn > 2 THEN a ELSE 0 END AS a, CASE WHEN cn > 2 THEN b ELSE a END AS b, abs(cn - 2) AS copies FROM v_cnseg WHERE cn > 2 OR (cn < 2 AND a > 0)
UNION ALL SELECT sample, source, concat('loss of ', a, '-', b), 2, b, 100, 2 - cn FROM v_cnseg WHERE cn < 2""")
def _(t):
    return V.karyotype_from_copy_number(t("v_cnseg"), t("v_karyo_sizes"))[0]


@query("homologs_left", "I4", """SELECT s.sample, s.source, 2 - coalesce(sum(2 - cn) FILTER (cn < 2), 0) AS reference_copies
FROM v_karyo_sizes s LEFT JOIN v_cnseg c ON s.sample = c.sample AND s.source = c.source GROUP BY s.sample, s.source""")
def _(t):
    return V.karyotype_from_copy_number(t("v_cnseg"), t("v_karyo_sizes"))[1]


@query("copy_number_bed", "I5", """SELECT w."window", greatest(0, s // 1000 - bin0) AS a, least(n, cast(ceil(e / 1000.0) AS BIGINT) - bin0) AS b, cn FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, p_partkey * 700 AS s, p_partkey * 700 + p_size * 900 AS e, cast(p_size % 5 AS DOUBLE) AS cn FROM part) p
JOIN (SELECT 'w1' AS "window", 'chr1' AS chrom, 100 AS bin0, 700 AS n UNION ALL SELECT 'w2', 'chr2', 0, 500) w ON w.chrom = p.chrom WHERE least(n, cast(ceil(e / 1000.0) AS BIGINT) - bin0) > greatest(0, s // 1000 - bin0)""")
def _(t):
    p = F.col("p_partkey")
    lines = t("part").select(F.lit("cn.bed").alias("file"), p.alias("line_no"), F.concat_ws("\t", F.when(F.col("p_size") % 2 == 0, "chr1").otherwise("2"), (p * 700).cast("string"), (p * 700 + F.col("p_size") * 900).cast("string"), (F.col("p_size") % 5).cast("string")).alias("value"))
    win = t("region").filter("r_regionkey < 2").select(F.concat(F.lit("w"), F.col("r_regionkey") + 1).alias("window"), F.concat(F.lit("chr"), F.col("r_regionkey") + 1).alias("chrom"),
                                                      (100 - 100 * F.col("r_regionkey")).alias("bin0"), (700 - 200 * F.col("r_regionkey")).alias("n"))
    return RV.copy_number_segments(lines, win, 1000).drop("file")


view("v_deriv", """SELECT sample, 'd' AS derivative, 1 AS ord, 'A' AS source, cast(0 AS bigint) AS a, cast(cut1 AS bigint) AS b, false AS reverse, cast(0 AS bigint) AS offset, false AS junction FROM {v_joins}
UNION ALL SELECT sample, 'd', 2, 'B', cast(cut2 - 30 AS bigint), cast(cut2 AS bigint), true, cast(cut1 AS bigint), true FROM {v_joins}""".replace("AS offset", "AS `offset`"),
     """SELECT sample, 'd' AS derivative, 1 AS ord, 'A' AS source, cast(0 AS bigint) AS a, cast(cut1 AS bigint) AS b, false AS reverse, cast(0 AS bigint) AS "offset", false AS junction FROM {v_joins}
UNION ALL SELECT sample, 'd', 2, 'B', cast(cut2 - 30 AS bigint), cast(cut2 AS bigint), true, cast(cut1 AS bigint), true FROM {v_joins}""")
INDEX = """ix AS (SELECT sample, derivative, "offset" + k AS pos, source, CASE WHEN reverse THEN b - 1 - k ELSE a + k END AS bead, reverse FROM (SELECT *, unnest(generate_series(cast(0 AS BIGINT), b - a - 1)) AS k FROM v_deriv) t)"""


@query("bin_index", "I6", f"WITH {INDEX} SELECT * FROM ix")
def _(t):
    return V.bin_index(t("v_deriv"))


@query("kept_bins", "I6", """WITH k AS (SELECT s.sample, bin FROM (SELECT sample, unnest(generate_series(0, 99)) AS bin FROM v_karyo_sizes WHERE source = 'A') s JOIN v_cnseg c ON c.sample = s.sample WHERE bin < c.a OR bin >= c.b)
SELECT sample, bin, rank, sum(CASE WHEN bin - pb > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sample ORDER BY bin) AS run FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY bin) - 1 AS rank, lag(bin) OVER (PARTITION BY sample ORDER BY bin) AS pb FROM k) q""")
def _(t):
    return V.kept_bins(t("v_cnseg"), t("v_karyo_sizes").filter("source = 'A'").drop("source"))


# pair probabilities per sample map: pooled counts turned into probabilities, derivative built from the end of the map
view("v_pbefore", "SELECT concat(sample, chrom) AS sample, 'A' AS source, i, j, cnt / (cnt + 20) AS p FROM {v_pooled} WHERE i < j")
view("v_pseg", """SELECT sample, 'd' AS derivative, 1 AS ord, 'A' AS source, cast(0 AS bigint) AS a, cast(40 AS bigint) AS b, false AS reverse, cast(0 AS bigint) AS `offset`, false AS junction FROM (SELECT DISTINCT sample FROM {v_pbefore}) s
UNION ALL SELECT sample, 'd', 2, 'A', cast(60 AS bigint), cast(100 AS bigint), true, cast(40 AS bigint), true FROM (SELECT DISTINCT sample FROM {v_pbefore}) s""",
     """SELECT sample, 'd' AS derivative, 1 AS ord, 'A' AS source, cast(0 AS bigint) AS a, cast(40 AS bigint) AS b, false AS reverse, cast(0 AS bigint) AS "offset", false AS junction FROM (SELECT DISTINCT sample FROM {v_pbefore}) s
UNION ALL SELECT sample, 'd', 2, 'A', cast(60 AS bigint), cast(100 AS bigint), true, cast(40 AS bigint), true FROM (SELECT DISTINCT sample FROM {v_pbefore}) s""")
view("v_pafter", "SELECT sample, 'd' AS derivative, i, j, p * 0.9 AS p FROM {v_pbefore} WHERE j < 80")
IMPACT = """dix AS (SELECT sample, "offset" + k AS pos, CASE WHEN reverse THEN b - 1 - k ELSE a + k END AS bead FROM (SELECT *, unnest(generate_series(cast(0 AS BIGINT), b - a - 1)) AS k FROM v_pseg) t),
w AS (SELECT sample, i, j, p AS pb, rc * p AS w FROM v_pbefore CROSS JOIN (SELECT {rc} AS rc) z UNION ALL SELECT d.sample, least(x.bead, y.bead), greatest(x.bead, y.bead), NULL, {dc} * p FROM v_pafter d JOIN dix x ON x.sample = d.sample AND x.pos = d.i JOIN dix y ON y.sample = d.sample AND y.pos = d.j),
im AS (SELECT sample, 'A' AS source1, i, 'A' AS source2, j, p_before, CASE WHEN {gone} THEN NULL ELSE pa END AS p_after, CASE WHEN NOT ({gone}) AND pa > 0 AND p_before > 0 THEN log2(pa / p_before) END AS log2_fc FROM (
  SELECT sample, i, j, max(pb) AS p_before, sum(w) / 2 AS pa FROM w GROUP BY ALL) q)"""
HET = IMPACT.format(rc="1.0", dc="1.0", gone="false")
HOM = IMPACT.format(rc="0.0", dc="2.0", gone="(i >= 40 AND i < 60) OR (j >= 40 AND j < 60)")


def impact(t, copies):
    idx = V.bin_index(t("v_pseg"))
    ref = t("v_pbefore").select("sample").distinct().select("sample", F.lit("A").alias("source"), F.lit(2.0 - copies).alias("reference_copies"), F.lit(100).cast("long").alias("n"))
    cp = ref.select("sample", F.lit("d").alias("derivative"), F.lit(float(copies)).alias("copies"))
    return V.project(t("v_pbefore"), ref, t("v_pafter"), idx, cp), V.bead_copies(ref, idx, cp), idx


@query("impact_heterozygous", "I7", f"WITH {HET} SELECT sample, source1, i, source2, j, round(p_before, 6) AS p_before, round(p_after, 6) AS p_after, round(log2_fc, 6) + 0.0 AS log2_fc FROM im")
def _(t):
    m = r(impact(t, 1)[0], "p_before", "p_after")
    return m.withColumn("log2_fc", F.round("log2_fc", 6) + 0.0)


@query("impact_homozygous", "I7", f"WITH {HOM} SELECT sample, source1, i, source2, j, round(p_before, 6) AS p_before, round(p_after, 6) AS p_after, round(log2_fc, 6) + 0.0 AS log2_fc FROM im")
def _(t):
    m = r(impact(t, 2)[0], "p_before", "p_after")
    return m.withColumn("log2_fc", F.round("log2_fc", 6) + 0.0)


@query("top_changes", "I8", f"WITH {HET} SELECT sample, i, j, rank FROM (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY round(abs(log2_fc), 9) DESC, i, j) AS rank FROM im WHERE log2_fc IS NOT NULL AND j - i >= 2) q WHERE rank <= 20")
def _(t):
    m = impact(t, 1)[0].withColumn("log2_fc", F.round("log2_fc", 9))
    return V.top_changes(m).select("sample", "i", "j", "rank")


@query("variant_boundary_changes", "I9", """WITH b AS (SELECT chrom AS sample, bin FROM v_marks WHERE sample = 'a'), a AS (SELECT chrom AS sample, bin FROM v_marks WHERE sample = 'b')
SELECT sample, 'A' AS source, bin, CASE WHEN bin >= 40 AND bin < 60 THEN 'boundary deleted' ELSE 'boundary lost (domains fused)' END AS change FROM b WHERE (bin >= 40 AND bin < 60) OR NOT EXISTS (SELECT 1 FROM a WHERE a.sample = b.sample AND abs(a.bin - b.bin) <= 2)
UNION ALL SELECT sample, 'A', bin, 'boundary gained' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.sample = b.sample AND abs(a.bin - b.bin) <= 2)""")
def _(t):
    m = t("v_marks").withColumn("source", F.lit("A"))
    side = lambda s: m.filter(F.col("sample") == s).select(F.col("chrom").alias("sample"), "source", "bin")      # noqa: E731
    cn = t("v_bins").select(F.col("chrom").alias("sample"), F.lit("A").alias("source"), F.col("bin").alias("bead")).distinct().withColumn("copies", F.when(F.col("bead").between(40, 59), 0.0).otherwise(2.0))
    return V.boundary_changes(side("a"), side("b"), cn)


@query("junction_domains", "I9", """SELECT d.sample, d.derivative, j.at_bin AS bin, d.start, d."end", 'domain spans a junction (neo-domain)' AS change FROM (SELECT concat('c', c_custkey) AS sample, 'd' AS derivative, c_custkey % 50 AS start, c_custkey % 50 + 25 AS "end" FROM customer) d
JOIN (SELECT sample, cut1 AS at_bin FROM v_joins) j ON j.sample = d.sample WHERE d.start + 2 <= at_bin AND at_bin <= d."end" - 2""")
def _(t):
    k = F.col("c_custkey")
    d = t("customer").select(F.concat(F.lit("c"), k.cast("string")).alias("sample"), F.lit("d").alias("derivative"), (k % 50).alias("start"), (k % 50 + 25).alias("end"))
    return V.junction_domains(d, t("v_joins").select("sample", F.lit("d").alias("derivative"), F.col("cut1").alias("junction_at")))


view("v_vgenes", "SELECT DISTINCT s.sample, 'A' AS source, concat(g.name, cast(g.gene_id AS varchar(12))) AS gene, (g.gene_id * 7) % 95 AS tss, (g.gene_id * 7) % 95 AS first, (g.gene_id * 7) % 95 + g.gene_id % 4 AS last FROM {v_genes} g JOIN (SELECT DISTINCT sample FROM {v_pbefore}) s ON true WHERE g.chrom = 'chr1'",
     "SELECT DISTINCT s.sample, 'A' AS source, concat(g.name, g.gene_id) AS gene, (g.gene_id * 7) % 95 AS tss, (g.gene_id * 7) % 95 AS \"first\", (g.gene_id * 7) % 95 + g.gene_id % 4 AS \"last\" FROM {v_genes} g JOIN (SELECT DISTINCT sample FROM {v_pbefore}) s ON true WHERE g.chrom = 'chr1'")


def gene_effects(t):
    m, cn, idx = impact(t, 2)
    seg = t("v_pseg")
    cuts = seg.filter("junction").select("sample", "source", F.col("b").alias("cut")).unionByName(seg.filter("NOT junction").select("sample", "source", F.col("b").alias("cut")))
    inv = idx.filter("reverse").select("sample", "source", "bead")
    near = V.junction_neighbourhood(seg, idx, 100_000)
    return V.affected_genes(t("v_vgenes"), cn, cuts, inv, near, m), m, cn


@query("affected_genes", "I10", f"""WITH {HOM}, strong AS (SELECT sample, t AS tss, arg_max(log2_fc, abs(log2_fc)) AS s FROM (SELECT sample, i AS t, j AS o, log2_fc, p_before, p_after FROM im UNION ALL SELECT sample, j, i, log2_fc, p_before, p_after FROM im) q
  WHERE abs(t - o) > 1 AND greatest(coalesce(p_before, 0), coalesce(p_after, 0)) >= 0.01 AND log2_fc IS NOT NULL GROUP BY ALL),
g AS (SELECT v.*, s, "first" >= 40 AND "last" < 60 AS alldel, "last" >= 40 AND "first" < 60 AS del FROM v_vgenes v LEFT JOIN strong USING (sample, tss)),
e AS (SELECT *, list_filter([CASE WHEN alldel THEN 'deleted' WHEN del THEN 'partly deleted' END, CASE WHEN ("first" < 40 AND 40 <= "last") OR ("first" < 100 AND 100 <= "last") THEN 'breakpoint inside the gene' END, CASE WHEN tss >= 60 THEN 'inverted' END,
  CASE WHEN (tss >= 35 AND tss < 40) OR (tss >= 95) THEN 'next to a new junction' END, CASE WHEN abs(s) >= 1 THEN 'contacts changed' END], lambda x: x IS NOT NULL) AS effects FROM g)
SELECT sample, source, gene, tss, array_to_string(effects, '|') AS effects, round(s, 6) AS strongest_log2_change, 0.0 AS max_new_contact_p FROM e WHERE len(effects) > 0""")
def _(t):
    g = gene_effects(t)[0]
    return r(g.withColumn("effects", F.array_join("effects", "|")), "strongest_log2_change")


view("v_enh", "SELECT DISTINCT concat(c.sample2, c.chrom) AS sample, 'A' AS source, c.bin AS bead, c.cov AS signal FROM (SELECT CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END AS sample2, chrom, bin, max(cov) AS cov FROM {v_cover} GROUP BY CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END, chrom, bin) c")


@query("enhancer_bins", "I12", "SELECT sample, source, bead, signal FROM v_enh JOIN (SELECT sample, quantile_cont(signal, 0.9) AS t FROM v_enh GROUP BY sample) q USING (sample) WHERE signal >= t")
def _(t):
    return V.enhancer_bins(t("v_enh"))


EP = """en AS (SELECT sample, bead FROM v_enh JOIN (SELECT sample, quantile_cont(signal, 0.9) AS t FROM v_enh GROUP BY sample) q USING (sample) WHERE signal >= t),
ep AS (SELECT g.sample, gene, g.tss AS pb, en.bead AS eb, p_before, p_after, log2_fc, CASE WHEN p_before IS NOT NULL AND p_after IS NULL THEN 'removed' WHEN abs(log2_fc) >= 0.5 AND greatest(p_before, p_after) >= 0.01 THEN CASE WHEN log2_fc > 0 THEN 'gained' ELSE 'lost' END END AS change
  FROM v_vgenes g JOIN en ON en.sample = g.sample AND abs(en.bead - g.tss) >= 2 JOIN im ON im.sample = g.sample AND im.i = least(g.tss, en.bead) AND im.j = greatest(g.tss, en.bead))"""


def promoters(t):
    return t("v_vgenes").select("sample", "source", "gene", F.col("tss").alias("bead"))


@query("enhancer_promoter_pairs", "I11", f"WITH {HOM}, {EP} SELECT sample, gene, 'A' AS ps, pb, 'A' AS es, eb, round(p_before, 6) AS p_before, round(p_after, 6) AS p_after, round(log2_fc, 6) AS log2_fc, change FROM ep WHERE change IS NOT NULL")
def _(t):
    e = V.enhancer_promoter(impact(t, 2)[0], promoters(t), V.enhancer_bins(t("v_enh")), min_log2=0.5)
    return r(e, "p_before", "p_after", "log2_fc")


@query("replicate_intervals", "I13", """SELECT chrom AS sample, 'A' AS source1, i, 'A' AS source2, j, round(quantile_cont(ln(cnt), 0.05), 6) AS log2_fc_lo, round(quantile_cont(ln(cnt), 0.95), 6) AS log2_fc_hi, round(quantile_cont(cnt / 100, 0.05), 6) AS p_after_lo, round(quantile_cont(cnt / 100, 0.95), 6) AS p_after_hi, count(*) AS reps
FROM v_contacts GROUP BY chrom, i, j""")
def _(t):
    m = t("v_contacts").select(F.col("chrom").alias("sample"), F.lit("A").alias("source1"), "i", F.lit("A").alias("source2"), "j", F.ln("cnt").alias("log2_fc"), (F.col("cnt") / 100).alias("p_after"))
    return r(V.replicate_intervals(m), "log2_fc_lo", "log2_fc_hi", "p_after_lo", "p_after_hi")


@query("ranked_variants", "I14", """WITH g AS (SELECT c_nationkey AS s, count(*) FILTER (c_custkey % 5 = 0) AS hard, count(*) FILTER (c_custkey % 5 <> 0) AS soft FROM customer GROUP BY ALL), e AS (SELECT s_nationkey AS s, count(*) FILTER (s_acctbal > 0 OR s_acctbal < -500) AS ep FROM supplier GROUP BY ALL),
b AS (SELECT n_nationkey AS s, count(*) FILTER (n_regionkey < 3) AS bnd FROM nation GROUP BY ALL)
SELECT b.s AS sample, coalesce(hard, 0) AS hard, coalesce(soft, 0) AS soft, coalesce(ep, 0) AS ep, bnd, 3 * coalesce(hard, 0) + 2 * coalesce(ep, 0) + 2 * bnd + coalesce(soft, 0) AS score, coalesce(hard, 0) + coalesce(soft, 0) AS genes_affected FROM b LEFT JOIN g USING (s) LEFT JOIN e USING (s)""")
def _(t):
    g = t("customer").select(F.col("c_nationkey").alias("sample"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("deleted"), F.lit("inverted"))).otherwise(F.array(F.lit("inverted"))).alias("effects"))
    e = t("supplier").select(F.col("s_nationkey").alias("sample"), F.col("s_acctbal").alias("log2_fc_lo"), (F.col("s_acctbal") + 500).alias("log2_fc_hi"))
    b = t("nation").select(F.col("n_nationkey").alias("sample"), F.when(F.col("n_regionkey") < 3, "boundary lost (domains fused)").otherwise("boundary gained").alias("change"))
    return V.ranking(g, e, b)


@query("preset_windows", "I15", """SELECT s_suppkey AS preset, a.chrom, CASE k WHEN 0 THEN a.start // 10000 WHEN 2 THEN cast(floor((a.start - 500000) / 10000.0) AS BIGINT) END AS a, CASE k WHEN 0 THEN cast(ceil(b."end" / 10000.0) AS BIGINT) WHEN 2 THEN cast(ceil((a."end" + 500000) / 10000.0) AS BIGINT) END AS b,
  CASE k WHEN 1 THEN (a.start + a."end") // 2 // 10000 END AS breakpoint, CASE k WHEN 1 THEN b.chrom END AS partner, CASE k WHEN 1 THEN b.start END AS partner_start
FROM (SELECT s_suppkey, s_suppkey % 3 AS k FROM supplier) s JOIN v_genes a ON a.gene_id = s_suppkey LEFT JOIN v_genes b ON b.gene_id = s_suppkey + 7""")
def _(t):
    k = F.col("s_suppkey")
    p = t("supplier").select(k.alias("preset"), F.when(k % 3 == 0, "span").when(k % 3 == 1, "break").otherwise("flank").alias("kind"), k.cast("string").alias("gene_a"), (k + 7).cast("string").alias("gene_b"))
    return V.preset_windows(p, t("v_genes").withColumn("name", F.col("gene_id").cast("string")), 10_000)


# ---------------------------------------------------------------- jobs
@query("analysis_suite", "B18")
def _(t):
    tables = SU.analyze(t("v_pooled"), pooled_sizes(t), 20_000, 12)
    return SU.summary(tables, pooled_sizes(t)).withColumn("slope", F.round("slope", 6))


def pooled_sizes(t):
    return t("v_pooled").select("sample", "chrom").distinct().withColumn("n", F.lit(100).cast("long"))


@query("compare_conditions", "B18, C7, C8")
def _(t):
    sizes = t("v_sizes").select("chrom", "n").distinct()
    return SU.compare_conditions(t("v_reps"), sizes, 20_000, 12, 2.0)["summary"]


@query("pending_samples", "J1", "SELECT c_custkey AS sample FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(t):
    return J.pending(t("customer").select(F.col("c_custkey").alias("sample")), t("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("sample")))


@query("sample_sheet_run", "J1", "SELECT sample, count(*) AS maps FROM v_sizes GROUP BY sample")
def _(t):
    out = scratch(t.spark, "sheet")
    sheet = t("v_sizes").select("sample").distinct()
    J.run_sheet(t.spark, t("v_pairs"), sheet.filter("sample <> 's3'"), t("v_sizes"), 20_000, 12, out)
    J.run_sheet(t.spark, t("v_pairs"), sheet, t("v_sizes"), 20_000, 12, out)             # only s3 is left
    return t.spark.read.parquet(f"{out}/summary").groupBy("sample").agg(F.count(F.lit(1)).alias("maps"))


@query("graph_nodes", "J2", """WITH b AS (SELECT contig, k AS bin, substring(bases, k * 170 + 1, 170) AS s FROM (SELECT *, unnest(generate_series(cast(0 AS BIGINT), (length(bases) - 1) // 170)) AS k FROM v_whole) t),
g AS (SELECT contig, bin, length(s) - length(translate(s, 'GC', '')) AS g, length(s) - length(translate(s, 'ACGT', '')) AS c, length(s) AS n FROM b), sg AS (SELECT user_id AS contig, event_id % 900 // 170 AS bin, avg(value) AS v FROM events GROUP BY ALL)
SELECT g.contig, g.bin, CASE WHEN c > 0 AND c >= 0.5 * n THEN round(g / c, 9) END AS gc, CASE WHEN c > 0 AND c >= 0.5 * n THEN round(v, 6) END AS signal, c > 0 AND c >= 0.5 * n AS valid FROM g LEFT JOIN sg USING (contig, bin)""")
def _(t):
    sig = t("events").select(F.col("user_id").alias("contig"), (F.col("event_id") % 900).alias("pos"), "value")
    none = t("v_contacts").select(F.lit(1).cast("long").alias("contig"), "i", "j", "cnt")
    return r(r(J.graph_table(t("v_sequence"), sig, none, 170)[0], "gc", digits=9), "signal")


@query("drug_likeness", "J3", """SELECT l_orderkey, l_linenumber, CASE WHEN x <= 5 OR x IS NULL THEN true ELSE false END AS xlogp_ok, mw <= 500 AS mw_ok, (CASE WHEN mw <= 500 THEN 0 ELSE 1 END) + (CASE WHEN x IS NULL OR x <= 5 THEN 0 ELSE 1 END) + (CASE WHEN hbd <= 5 THEN 0 ELSE 1 END) + (CASE WHEN hba <= 10 THEN 0 ELSE 1 END) AS ro5_violations, rot <= 10 AS rot_ok, tpsa <= 140 AS tpsa_ok
FROM (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS mw, CASE WHEN l_tax > 0.01 THEN l_discount * 80 END AS x, l_linenumber AS hbd, l_quantity / 4 AS hba, l_quantity / 3 AS rot, l_quantity * 4 AS tpsa FROM lineitem) t""")
def _(t):
    q = F.col("l_quantity")
    p = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 100).alias("mw"), F.when(F.col("l_tax") > 0.01, F.col("l_discount") * 80).alias("xlogp"), F.col("l_linenumber").alias("hbd"), (q / 4).alias("hba"), (q / 3).alias("rot"), (q * 4).alias("tpsa"))
    return J.drug_likeness(p).select("l_orderkey", "l_linenumber", "mw_ok", "xlogp_ok", "ro5_violations", "rot_ok", "tpsa_ok")


@query("grouped_split", "J4", "SELECT p_type AS scaffold, count(*) AS size FROM part GROUP BY p_type")
def _(t):
    return J.grouped_split(t("part").select(F.col("p_type").alias("scaffold"))).select("scaffold", "size")


@query("grouped_split_parts", "J4")
def _(t):
    return J.grouped_split(t("part").select(F.concat("p_type", "p_brand").alias("scaffold"))).groupBy("part").agg(F.sum("size").alias("items"), F.count(F.lit(1)).alias("groups"))


@query("streamed_pairs", "K1", "SELECT * FROM v_contacts")
def _(t):
    base = scratch(t.spark, "stream")
    t("v_pairs").repartition(4).write.parquet(f"{base}/in")
    s = SP.pair_stream(t.spark, f"{base}/in", t("v_pairs").schema, max_files=1)
    q = SP.count_pairs(s, 20_000, f"{base}/out", f"{base}/ckpt")
    q.awaitTermination()
    return SP.totals(t.spark, f"{base}/out")


@query("streamed_pairs_resumed", "K1", "SELECT * FROM v_contacts")
def _(t):
    # twenty batches, added up as the stream does: batches 6 and 13 are delivered twice, batch 15 fails between its run and its manifest
    out = scratch(t.spark, "stream")
    part = F.pmod(F.xxhash64("sample", "chrom", "i", "j"), F.lit(20))
    pieces = cut(t("v_contacts").withColumn("_part", part))
    for k in range(20):
        batch = pieces.filter(F.col("_part") == k).drop("_part")
        if k == 15:
            # a torn run that no manifest names
            batch.limit(1).write.parquet(f"{out}/runs/level-2/slot-0-0")
        SP.add_batch(batch, k, out)
        if k in (6, 13):
            SP.add_batch(batch, k, out)
    return SP.totals(t.spark, out)


@query("sample_sheet_resumed", "J1", """SELECT sample, step, n AS n, step IN ('tracks', 'p_s', 'summary') OR sample = 's3' AS run_again
FROM (SELECT DISTINCT sample FROM v_sizes) s CROSS JOIN (SELECT unnest(['boundaries', 'domains', 'tracks', 'p_s', 'summary']) AS step, 1 AS n) t""")
def _(t):
    # stopped after two steps of all samples but s3; the second run does what is left, the third nothing
    out = scratch(t.spark, "sheet")
    sheet = t("v_sizes").select("sample").distinct()
    run = lambda s, *steps: J.run_sheet(t.spark, t("v_pairs"), s, t("v_sizes"), 20_000, 12, out, *steps)         # noqa: E731
    run(sheet.filter("sample <> 's3'"), ("boundaries", "domains"))
    again = run(sheet)
    third = run(sheet)
    markers = t.spark.read.schema(J.MARKERS).parquet(f"{out}/steps").groupBy("sample", "step").agg(F.count(F.lit(1)).cast("int").alias("n"))
    done = again.withColumn("run_again", F.lit(True)).unionByName(third.withColumn("run_again", F.lit(None).cast("boolean")))
    return markers.join(done, ["sample", "step"], "left").na.fill(False, ["run_again"])


@query("sample_sheet_comparison", "J1, B18", f"WITH {TESTED} SELECT chrom, i, j, round(mean_count, 6) AS mean_count FROM tested")
def _(t):
    out = scratch(t.spark, "sheet")
    sheet = t("v_sizes").select("sample").distinct().select("sample", F.when(F.col("sample").isin("s0", "s1"), "untreated").otherwise("treated").alias("condition"),
                                                            F.substring("sample", 2, 9).cast("int").alias("row_no"), F.lit("all").alias("region"))
    run = lambda: J.run_comparison(t.spark, t("v_pairs"), sheet, t("v_sizes"), 20_000, 12, out, min_count=2.0, max_sep_bp=1_200_000)          # noqa: E731
    if not run() or run():
        raise RuntimeError("the comparison runs once")
    return r(t.spark.read.parquet(f"{out}/comparison/pixels").select("chrom", "i", "j", "mean_count"), "mean_count")


@query("graph_contacts", "J2", f"""WITH nodes AS ({ORACLES["graph_nodes"]}),
c AS (SELECT contig, least(i, j) AS i, greatest(i, j) AS j, max(cnt) AS cnt FROM (SELECT user_id AS contig, event_id % 900 // 170 AS i, event_id * 7 % 900 // 170 AS j, cast(count(*) AS DOUBLE) AS cnt FROM events GROUP BY ALL) e
  WHERE i <> j GROUP BY contig, least(i, j), greatest(i, j))
SELECT c.* FROM c JOIN nodes a ON a.contig = c.contig AND a.bin = c.i AND a.valid JOIN nodes b ON b.contig = c.contig AND b.bin = c.j AND b.valid""")
def _(t):
    e = t("events")
    at = lambda k: F.floor(F.col("event_id") * k % 900 / 170).cast("long")               # noqa: E731
    contacts = e.select(F.col("user_id").alias("contig"), at(1).alias("i"), at(7).alias("j")).groupBy("contig", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("cnt"))
    return J.graph_table(t("v_sequence"), e.select(F.col("user_id").alias("contig"), (F.col("event_id") % 900).alias("pos"), "value"), contacts, 170)[1]


@query("suite_boundaries", "B18", f"""WITH RECURSIVE {INS}, {BOUND_TAIL}
SELECT sample, chrom, bin * 20000 AS start, (bin + 1) * 20000 AS "end", 'insulation' AS method FROM bounds
UNION ALL SELECT sample, chrom, bin * 20000, (bin + 1) * 20000, 'rank sum' FROM ({ORACLES["rank_sum_boundaries"]}) k""")
def _(t):
    # the two callers at the windows of their own queries
    table = lambda w, m: SU.analyze(t("v_contacts"), t("v_sizes"), 20_000, w, call=False)["boundaries"].filter(F.col("method") == m)         # noqa: E731
    return table(12, "insulation").unionByName(table(10, "rank sum"))


@query("suite_p_s", "B18", f"WITH {PS} SELECT sample, chrom, d, separation_bp, round(p, 9) AS p FROM ps")
def _(t):
    tables = SU.analyze(t("v_contacts"), t("v_sizes"), 20_000, 12, t("v_weights"), call=False)
    return r(tables["p_s"].drop("max_d"), "p", digits=9)


@query("analysis_written", "B18, A27", f"""WITH RECURSIVE {INS}, {BOUND_TAIL}
SELECT 'bed' AS kind, concat_ws(chr(9), chrom, bin * 20000, (bin + 1) * 20000, 'insulation') AS line, count(*) AS times FROM bounds GROUP BY chrom, bin
UNION ALL SELECT 'p_of_s', concat_ws(chr(9), sample, chrom, d), 1 FROM (SELECT sample, chrom, unnest(generate_series(cast(0 AS BIGINT), n - 1)) AS d FROM v_sizes) s""")
def _(t):
    # the files of a whole analysis, read back: boundaries of one caller, keys of the P(s) table
    out = scratch(t.spark, "analysis")
    SU.write_analysis(SU.analyze(t("v_contacts"), t("v_sizes"), 20_000, 12, call=False), out)
    bed = t.spark.read.text(f"{out}/boundaries.bed").filter(F.col("value").endswith("insulation")).select(F.lit("bed").alias("kind"), F.col("value").alias("line"))
    ps = t.spark.read.option("sep", "\t").option("header", True).csv(f"{out}/p_of_s").select(F.lit("p_of_s").alias("kind"), F.concat_ws("\t", "sample", "chrom", "d").alias("line"))
    return bed.unionByName(ps).groupBy("kind", "line").agg(F.count(F.lit(1)).alias("times"))
