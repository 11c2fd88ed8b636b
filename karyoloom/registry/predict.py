"""Distance prediction and calibration tables."""

from pyspark.sql import functions as F

from ..operators import predict as P
from .base import query, rounded, view
from .maps import r

# one locus per bin of a map with motif counts and GC from its coverage; peaks from the read positions near bin starts
view("v_ploci", """SELECT concat(sample, chrom) AS chrom, bin AS locus, bin * 20000 AS start, (bin + 1) * 20000 AS end, cov % 4 AS fwd, cov % 3 AS rev, cov % 2 AS unk, CASE WHEN cov > 20 THEN cov / 200 END AS gc FROM {v_cover}""")
view("v_ppeaks", "SELECT concat(sample, chrom) AS chrom, i * 20000 + j * 171 AS mid FROM {v_contacts}")
PAIRS = """lc AS (SELECT l.*, ln(1 + fwd) AS f, ln(1 + rev) AS rv, ln(1 + fwd + rev + unk) AS a, coalesce(gc - avg(gc) OVER (PARTITION BY chrom), 0) AS g FROM v_ploci l),
cn AS (SELECT chrom, mid, count(*) AS k FROM v_ppeaks GROUP BY ALL),
bl AS (SELECT l.chrom, locus, coalesce(sum(k) FILTER (mid < start), 0) AS ns, coalesce(sum(k) FILTER (mid < "end"), 0) AS ne FROM v_ploci l LEFT JOIN cn ON cn.chrom = l.chrom GROUP BY ALL),
lx AS (SELECT lc.*, ns, ne FROM lc JOIN bl USING (chrom, locus)),
pr AS (SELECT x.chrom, x.locus AS i, y.locus AS j, (y.start + y."end" - x.start - x."end") / 2 AS sep, x.f * y.rv AS convergent, x.rv * y.f AS divergent, x.f * y.f + x.rv * y.rv AS tandem,
  x.a + y.a AS anchor, ln(1 + y.ns - x.ne) AS "between", x.g * y.g AS gc FROM lx x JOIN lx y ON x.chrom = y.chrom AND x.locus < y.locus)"""
NAMES = ["convergent", "divergent", "tandem", "anchor", "between", "gc"]


def features(t):
    return P.pair_features(t("v_ploci"), t("v_ppeaks"))


@query("pair_features", "F1", f"WITH {PAIRS} SELECT chrom, i, j, sep, " + ", ".join(f'round("{n}", 6) + 0.0 AS "{n}", round("{n}" * log10(sep), 6) + 0.0 AS "{n}_s"' for n in NAMES) + " FROM pr")
def _(t):
    f = features(t)
    return f.select("chrom", "i", "j", "sep", *[rounded(c).alias(c) for c in P.FEATURES])


view("v_pmarks", "SELECT CASE WHEN (i + j) % 2 = 0 THEN 'rad21' ELSE 'h3k27ac' END AS mark, concat(sample, chrom) AS chrom, i * 20000 + j * 171 AS pos, cnt AS value FROM {v_contacts}")
MARKS = """mk AS (SELECT mark, chrom, pos, sum(value) AS v, count(*) AS k FROM v_pmarks GROUP BY ALL),
ms AS (SELECT m.mark, l.chrom, l.locus, l.start, l."end", ln(1 + coalesce(sum(v) FILTER (pos >= start AND pos < "end"), 0)) AS s, coalesce(sum(k) FILTER (pos < start), 0) AS ns, coalesce(sum(k) FILTER (pos < "end"), 0) AS ne
  FROM v_ploci l JOIN mk m ON m.chrom = l.chrom GROUP BY ALL),
md AS (SELECT *, s - avg(s) OVER (PARTITION BY mark, chrom) AS d FROM ms),
mp AS (SELECT x.mark, x.chrom, x.locus AS i, y.locus AS j, (y.start + y."end" - x.start - x."end") / 2 AS sep, x.d * y.d AS similarity, x.s + y.s AS anchor, CASE WHEN x.mark = 'rad21' THEN ln(1 + greatest(y.ns - x.ne, 0)) END AS "between"
  FROM md x JOIN md y ON x.mark = y.mark AND x.chrom = y.chrom AND x.locus < y.locus)"""


@query("mark_features", "F2", f"WITH {MARKS} SELECT chrom, mark, i, j, " + ", ".join(f'round("{n}", 6) + 0.0 AS "{n}", round("{n}" * log10(sep), 6) + 0.0 AS "{n}_s"' for n in ("similarity", "anchor", "between")) + " FROM mp")
def _(t):
    m = P.mark_features(t("v_ploci"), t("v_pmarks"))
    return m.select("chrom", "mark", "i", "j", *[rounded(c).alias(c) for c in ("similarity", "anchor", "between", "similarity_s", "anchor_s", "between_s")])


@query("trend_residual", "F3", "SELECT chrom, i, j, round(ln(truth) - avg(ln(truth)) OVER (PARTITION BY chrom, sep), 6) + 0.0 AS residual FROM v_maps")
def _(t):
    d = P.trend_residual(t("v_maps").withColumn("l", F.ln("truth")), ["chrom"], "l")
    return d.select("chrom", "i", "j", (F.round("residual", 6) + 0.0).alias("residual"))


@query("fit_trend", "F4", """WITH u AS (SELECT chrom, avg(log10(sep)) AS x, avg(ln(truth)) AS y, avg(log10(sep) * log10(sep)) AS xx, avg(log10(sep) * ln(truth)) AS xy FROM v_maps GROUP BY chrom), m AS (SELECT avg(x) AS x, avg(y) AS y, avg(xx) AS xx, avg(xy) AS xy FROM u)
SELECT round(y - (xy - x * y) / (xx - x * x) * x, 6) AS intercept, round((xy - x * y) / (xx - x * x), 6) AS slope FROM m""")
def _(t):
    return r(P.fit_trend(t("v_maps"), F.ln("truth"), unit=["chrom"]), "intercept", "slope")


def training(t):
    m = t("v_maps").withColumnRenamed("chrom", "c")
    f = features(t).withColumn("c", F.substring("chrom", 3, 4))
    return f.join(m.select("c", "i", "j", F.ln("truth").alias("y")), ["c", "i", "j"])


@query("fit_ridge", "F5")
def _(t):
    d = P.trend_residual(training(t), ["chrom"], "y")
    return r(P.fit_ridge(d, F.col("residual"), 0.1, unit=["chrom"]), "beta", "mu", "sd", digits=5)


@query("ridge_two_features", "F5", """WITH m AS (SELECT chrom, avg(pred) AS a, avg(other) AS b, avg(truth) AS y, avg(pred * pred) AS aa, avg(other * other) AS bb, avg(pred * other) AS ab, avg(pred * truth) AS ay, avg(other * truth) AS b_y FROM v_maps GROUP BY chrom),
s AS (SELECT avg(a) AS a, avg(b) AS b, avg(y) AS y, avg(aa) AS aa, avg(bb) AS bb, avg(ab) AS ab, avg(ay) AS ay, avg(b_y) AS b_y FROM m),
z AS (SELECT *, sqrt(aa - a * a) AS sa, sqrt(bb - b * b) AS sb FROM s),
g AS (SELECT *, 1.1 AS d, (ab - a * b) / (sa * sb) AS o, (ay - a * y) / sa AS ra, (b_y - b * y) / sb AS rb FROM z)
SELECT 'pred' AS feature, round((ra * d - o * rb) / (d * d - o * o), 5) AS beta, round(a, 5) AS mu, round(sa, 5) AS sd FROM g UNION ALL SELECT 'other', round((rb * d - o * ra) / (d * d - o * o), 5), round(b, 5), round(sb, 5) FROM g""")
def _(t):
    return r(P.fit_ridge(t("v_maps"), F.col("truth"), 0.1, ["pred", "other"], ["chrom"]), "beta", "mu", "sd", digits=5)


@query("apply_model", "F6", f"WITH {PAIRS} SELECT chrom, i, j, round(exp(2.5 + 0.6 * log10(greatest(sep, 1)) + (convergent - 0.8) / 0.5 * -0.05 + (anchor - 2) / 0.7 * 0.02), 6) AS distance FROM pr")
def _(t):
    d = P.apply_model(features(t), {"convergent": (-0.05, 0.8, 0.5), "anchor": (0.02, 2.0, 0.7)}, (2.5, 0.6))
    return r(d, "distance").select("chrom", "i", "j", "distance")


@query("input_summary", "F6", """SELECT chrom, count(*) AS loci, count(*) FILTER (fwd + rev + unk > 0) AS loci_with_peak, round(avg(gc), 9) AS gc_mean, any_value(p.n) AS peaks, any_value(p.m) AS peaks_with_motif FROM v_ploci l
LEFT JOIN (SELECT chrom, count(*) AS n, count(*) FILTER (mid % 3 <> 0) AS m FROM v_ppeaks GROUP BY ALL) p USING (chrom) GROUP BY chrom""")
def _(t):
    return r(P.input_summary(t("v_ppeaks").withColumn("strand", F.col("mid") % 3), t("v_ploci")), "gc_mean", digits=9)


@query("compare_maps", "F7", """WITH x AS (SELECT *, round(truth / avg(truth) OVER (PARTITION BY chrom, sep), 12) AS xf, round(pred / avg(pred) OVER (PARTITION BY chrom, sep), 12) AS yf FROM v_maps),
k AS (SELECT *, rank() OVER (PARTITION BY chrom ORDER BY truth) + (count(*) OVER (PARTITION BY chrom, truth) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY chrom ORDER BY pred) + (count(*) OVER (PARTITION BY chrom, pred) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY chrom ORDER BY xf) + (count(*) OVER (PARTITION BY chrom, xf) - 1) / 2.0 AS fx, rank() OVER (PARTITION BY chrom ORDER BY yf) + (count(*) OVER (PARTITION BY chrom, yf) - 1) / 2.0 AS fy FROM x)
SELECT chrom, count(*) AS pairs, round(corr(rx, ry), 6) AS spearman, round(corr(fx, fy), 6) AS spearman_trend_removed, round(quantile_cont(pred / truth, 0.5), 6) AS median_ratio FROM k GROUP BY chrom""")
def _(t):
    m = t("v_maps")
    return r(P.compare_maps(m.withColumnRenamed("truth", "value"), m.withColumnRenamed("pred", "value"), ["chrom"]), "spearman", "spearman_trend_removed", "median_ratio")


@query("cohesin_loss", "F8", """SELECT chrom, i, j, round(exp(l + 0.3 - 0.2 * x + 0.02 * x * x - 0.4 * (l - avg(l) OVER (PARTITION BY chrom, sep))), 6) AS after FROM (
  SELECT chrom, i, j, sep, ln(truth) AS l, log10(greatest(pow(10, 4.5), least(pow(10, 6), sep * 20000))) AS x FROM v_maps) t""")
def _(t):
    m = t("v_maps").withColumn("sep", F.col("sep") * 20_000)
    return r(P.cohesin_loss(m, 0.4, (0.3, -0.2, 0.02), (4.5, 6.0), ["chrom"], "truth"), "after").select("chrom", "i", "j", "after")


view("v_units", """SELECT chrom AS unit, i, j, sep * 20000 AS sep, pred AS model, truth, CASE chrom WHEN 'chrA' THEN 20000 WHEN 'chrN' THEN 30000 ELSE 50000 END AS step, CASE chrom WHEN 'chrA' THEN 900 ELSE 4000 END AS n_eff,
  CASE chrom WHEN 'chrA' THEN 'intact' ELSE 'dilution' END AS protocol, CASE WHEN other > 30 THEN other / 400 END AS f, other AS counts, CASE WHEN chrom = 'chrA' THEN 1 ELSE 0 END AS hic FROM {v_maps}""")


@query("fit_size_calibration", "F9")
def _(t):
    return r(P.fit_size(t("v_units")), "beta", digits=4)


@query("fit_size_simple", "F9", """WITH u AS (SELECT unit, avg(log10(sep)) AS x, avg(ln(truth / model)) AS y, avg(log10(sep) * log10(sep)) AS xx, avg(log10(sep) * ln(truth / model)) AS xy FROM v_units GROUP BY unit), m AS (SELECT avg(x) AS x, avg(y) AS y, avg(xx) AS xx, avg(xy) AS xy FROM u)
SELECT '1' AS feature, round(y - (xy - x * y) / (xx - x * x) * x, 5) AS beta FROM m UNION ALL SELECT 'L', round((xy - x * y) / (xx - x * x), 5) FROM m""")
def _(t):
    return r(P.fit_size(t("v_units"), ("L",)), "beta", digits=5)


@query("apply_size_calibration", "F9", "SELECT unit, i, j, round(model * exp(0.2 - 0.05 * log10(sep) + 0.01 * log10(n_eff)), 6) AS calibrated FROM v_units")
def _(t):
    d = P.apply_size(t("v_units"), {"1": 0.2, "L": -0.05, "depth": 0.01}, ("L", "depth"))
    return r(d, "calibrated").select("unit", "i", "j", "calibrated")


RES = """res AS (SELECT chrom, i, j, ln(pred) - avg(ln(pred)) OVER (PARTITION BY chrom, sep) AS v FROM v_maps)"""


@query("neighbourhood_mean", "F10", f"""WITH {RES}, mir AS (SELECT chrom, i AS r, j AS c, v FROM res UNION ALL SELECT chrom, j, i, v FROM res)
SELECT a.chrom, a.i, a.j, round(avg(b.v), 6) + 0.0 AS smooth FROM res a JOIN mir b ON a.chrom = b.chrom AND abs(a.i - b.r) <= 1 AND abs(a.j - b.c) <= 1 GROUP BY a.chrom, a.i, a.j""")
def _(t):
    d = P.trend_residual(t("v_maps").withColumn("l", F.ln("pred")), ["chrom"], "l")
    n = P.neighbourhood_mean(d.select("chrom", "i", "j", "residual"), ["chrom"], "residual", "smooth")
    return n.select("chrom", "i", "j", (F.round("smooth", 6) + 0.0).alias("smooth"))


@query("correction_features", "F10")
def _(t):
    f = P.correction_features(t("v_units"), 150.0)
    return r(f, "log_sep", "model_residual", "input_residual", "input_smooth", "model_smooth", "log_count", "depth", "step", digits=5)


@query("fit_correction", "F11")
def _(t):
    f = P.correction_features(t("v_units"), 150.0).join(t("v_units").select("unit", "i", "j", F.ln(F.col("truth") / F.col("model")).alias("y")), ["unit", "i", "j"])
    cols = ["log_sep", "model_residual", "input_residual", "input_smooth", "model_smooth", "log_count"]
    return r(P.fit_correction(f, cols, "y"), "beta", digits=4)


@query("fit_one_with_missing", "F11", """WITH s AS (SELECT avg(f) AS mu, stddev_pop(f) AS sd FROM v_units), z AS (SELECT unit, coalesce((f - mu) / sd, 0) AS z, ln(truth / model) AS y FROM v_units, s),
u AS (SELECT unit, avg(z) AS z, avg(y) AS y, avg(z * z) AS zz, avg(z * y) AS zy FROM z GROUP BY unit), m AS (SELECT avg(z) AS z, avg(y) AS y, avg(zz) + 1 AS zz, avg(zy) AS zy FROM u)
SELECT 'f' AS feature, round((zy - z * y) / (zz - z * z), 5) AS beta FROM m UNION ALL SELECT '1', round(y - z * (zy - z * y) / (zz - z * z), 5) FROM m""")
def _(t):
    return r(P.fit_correction(t("v_units").withColumn("y", F.ln(F.col("truth") / F.col("model"))), ["f"], "y"), "beta", digits=5)
