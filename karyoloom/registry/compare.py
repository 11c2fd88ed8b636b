"""Two conditions with replicates."""

from pyspark.sql import functions as F

from ..operators import compare as X
from .base import query, view
from .maps import insulation_cte, r

TESTED = """nreps AS (SELECT chrom, count(DISTINCT replicate) AS k FROM v_reps GROUP BY ALL),
tested AS (SELECT chrom, i, j, sum(cnt) / max(k) AS mean_count FROM v_reps JOIN nreps USING (chrom) WHERE j - i BETWEEN 2 AND 60 GROUP BY ALL HAVING sum(cnt) / max(k) >= 2),
filled AS (SELECT t.chrom, t.i, t.j, t.mean_count, r.condition, r.replicate, coalesce(c.cnt, 0) AS cnt FROM tested t
  JOIN (SELECT DISTINCT chrom, condition, replicate FROM v_reps) r ON t.chrom = r.chrom
  LEFT JOIN v_reps c ON c.chrom = t.chrom AND c.replicate = r.replicate AND c.i = t.i AND c.j = t.j),
cpm AS (SELECT *, log2((cnt + 0.5) / (sum(cnt) OVER (PARTITION BY chrom, replicate) + 1) * 1e6) AS y0 FROM filled),
val AS (SELECT *, y0 + avg(y0) OVER (PARTITION BY chrom, j - i) - avg(y0) OVER (PARTITION BY chrom, replicate, j - i) AS y FROM cpm),
stat AS (SELECT chrom, i, j, mean_count, avg(y) FILTER (condition = 'a') AS ma, avg(y) FILTER (condition = 'b') AS mb,
  (2 * var_pop(y) FILTER (condition = 'a') + 2 * var_pop(y) FILTER (condition = 'b')) / 2 AS s2 FROM val GROUP BY ALL)"""


def tested(t):
    return X.tested_pixels(t("v_reps"), 2, 60, 2.0)


@query("tested_pixels", "C1", f"WITH {TESTED} SELECT * FROM tested")
def _(t):
    return tested(t)


@query("log_cpm", "C2", f"WITH {TESTED} SELECT chrom, i, j, condition, replicate, cnt, round(y0, 6) AS y FROM cpm")
def _(t):
    return r(X.log_cpm(t("v_reps"), tested(t)), "y").drop("mean_count")


@query("centre_by_distance", "C3", f"WITH {TESTED} SELECT chrom, i, j, replicate, round(y, 6) AS y FROM val")
def _(t):
    return r(X.centre_by_distance(X.log_cpm(t("v_reps"), tested(t))), "y").select("chrom", "i", "j", "replicate", "y")


@query("pixel_strata", "C4", f"""WITH {TESTED}, edges AS (
  SELECT chrom, list_distinct(quantile_cont(round((ma + mb) / 2, 6), [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])) AS e FROM stat GROUP BY chrom)
SELECT s.chrom, i, j, round(mb - ma, 6) AS log2_fc, round(s2, 6) AS s2,
  cast(least(len(list_filter(e, lambda x: x <= round((ma + mb) / 2, 6) + 1e-9)) - 1, greatest(len(e) - 2, 0)) AS INTEGER) AS stratum
FROM stat s JOIN edges USING (chrom)""")
def _(t):
    y = X.centre_by_distance(X.log_cpm(t("v_reps"), tested(t)))
    s = X.two_means(y, ["chrom"], ["i", "j"]).withColumn("ab", F.round((F.col("mean_a") + F.col("mean_b")) / 2, 6))
    return r(X.strata(s, ["chrom"], "ab"), "log2_fc", "s2").select("chrom", "i", "j", "log2_fc", "s2", "stratum")


def pixels(t):
    return X.differential_pixels(t("v_reps"), 2, 60, 2.0)


@query("differential_pixels", "C4, G3")
def _(t):
    return r(pixels(t), "mean_a", "mean_b", "log2_fc", "t", "p", "q")


@query("fold_changes", "C5", f"WITH {TESTED} SELECT chrom, i, j, round(mb - ma, 6) AS log2_fc FROM stat")
def _(t):
    return r(X.fold_changes(t("v_reps"), 2.0, max_sep=60), "log2_fc")


def insulation_tracks(t):
    from ..operators.domains import insulation
    ins = insulation(t("v_contacts"), t("v_sizes"), 12)
    return ins.select("chrom", F.when(F.col("sample").isin("s0", "s1"), "a").otherwise("b").alias("condition"),
                      F.col("sample").alias("replicate"), "bin", F.col("insulation").alias("value"))


@query("track_test", "C6", f"""WITH {insulation_cte("v_contacts", 12)}, whole AS (SELECT chrom, bin FROM ins WHERE v IS NOT NULL GROUP BY ALL HAVING count(*) = (SELECT count(DISTINCT sample) FROM v_sizes))
SELECT chrom, bin, round(avg(v) FILTER (sample IN ('s0', 's1')), 6) AS mean_a, round(avg(v) FILTER (sample NOT IN ('s0', 's1')), 6) AS mean_b,
  round(avg(v) FILTER (sample NOT IN ('s0', 's1')) - avg(v) FILTER (sample IN ('s0', 's1')), 6) AS difference FROM ins JOIN whole USING (chrom, bin) GROUP BY ALL""")
def _(t):
    return r(X.track_test(insulation_tracks(t)), "mean_a", "mean_b", "difference").drop("t", "p", "q")


@query("track_test_full", "C6")
def _(t):
    return r(X.track_test(insulation_tracks(t)), "t", "p", "q", "mean_a", "mean_b", "difference")


# features of two conditions: bins covered more than both neighbours in their sample pair
view("v_marks", """SELECT sample, chrom, bin FROM (SELECT *, lag(cov) OVER (PARTITION BY sample, chrom ORDER BY bin) AS l, lead(cov) OVER (PARTITION BY sample, chrom ORDER BY bin) AS r FROM (
  SELECT CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END AS sample, chrom, bin, max(cov) AS cov FROM {v_cover} GROUP BY CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END, chrom, bin) m) t WHERE cov > l AND cov > r""")


@query("boundary_changes", "C7", """WITH a AS (SELECT chrom, bin FROM v_marks WHERE sample = 'a'), b AS (SELECT chrom, bin FROM v_marks WHERE sample = 'b')
SELECT chrom, bin, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.chrom = a.chrom AND abs(b.bin - a.bin) <= 2) THEN 'kept' ELSE 'lost in B' END AS change FROM a
UNION ALL SELECT chrom, bin, 'gained in B' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND abs(b.bin - a.bin) <= 2)""")
def _(t):
    m = t("v_marks")
    return X.feature_changes(m.filter("sample = 'a'"), m.filter("sample = 'b'"), ["chrom"], ["bin"])


@query("loop_changes", "C9", """WITH s AS (SELECT sample, chrom, i, j FROM v_pooled WHERE j - i >= 3),
a AS (SELECT * FROM s WHERE sample = 'a'), b AS (SELECT * FROM s WHERE sample = 'b')
SELECT chrom, i, j, CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.chrom = a.chrom AND abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1) THEN 'kept' ELSE 'lost in B' END AS change FROM a
UNION ALL SELECT chrom, i, j, 'gained in B' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.chrom = b.chrom AND abs(b.i - a.i) <= 1 AND abs(b.j - a.j) <= 1)""")
def _(t):
    s = t("v_pooled").filter(F.col("j") - F.col("i") >= 3)
    return X.feature_changes(s.filter("sample = 'a'"), s.filter("sample = 'b'"), ["chrom"], ["i", "j"], 1)


def cover_tracks(t):
    return t("v_cover").select("chrom", F.when(F.col("sample").isin("s0", "s1"), "a").otherwise("b").alias("condition"),
                               F.col("sample").alias("replicate"), "bin", (F.col("cov") / 60.0 - 1).alias("value"))


@query("compartment_switches", "C8", """WITH v AS (SELECT chrom, sample, bin, cov / 60 - 1 AS v FROM v_cover),
sg AS (SELECT x.chrom, x.sample, CASE WHEN corr(x.v, y.v) < 0 THEN -1 ELSE 1 END AS sg FROM v x JOIN v y ON x.chrom = y.chrom AND x.bin = y.bin AND y.sample = 's0' GROUP BY ALL),
m AS (SELECT chrom, bin, avg(v * sg) FILTER (sample IN ('s0', 's1')) AS a, avg(v * sg) FILTER (sample NOT IN ('s0', 's1')) AS b FROM v JOIN sg USING (chrom, sample) GROUP BY ALL)
SELECT chrom, bin, round(a, 6) AS eigenvector_a, round(b, 6) AS eigenvector_b, CASE WHEN b > 0 THEN 'sign + in B' ELSE 'sign - in B' END AS "switch"
FROM m WHERE sign(a) <> sign(b) AND abs(b - a) > 0.01""")
def _(t):
    return r(X.compartment_switches(cover_tracks(t), False), "eigenvector_a", "eigenvector_b")


@query("compartment_switches_oriented", "C8", """WITH m AS (SELECT chrom, bin, avg(cov / 60 - 1) FILTER (sample IN ('s0', 's1')) AS a,
  avg(cov / 60 - 1) FILTER (sample NOT IN ('s0', 's1')) AS b FROM v_cover GROUP BY ALL)
SELECT chrom, bin, round(a, 6) AS eigenvector_a, round(b, 6) AS eigenvector_b, CASE WHEN b > 0 THEN 'B to A' ELSE 'A to B' END AS "switch"
FROM m WHERE sign(a) <> sign(b) AND abs(b - a) > 0.01""")
def _(t):
    return r(X.compartment_switches(cover_tracks(t), True), "eigenvector_a", "eigenvector_b")


@query("differential_summary", "C10", """SELECT l_returnflag AS chrom, count(*) AS tested, count(*) FILTER (l_discount <= 0.03) AS significant,
  count(*) FILTER (l_discount <= 0.03 AND l_quantity > 25) AS gained, count(*) FILTER (l_discount <= 0.03 AND l_quantity < 25) AS lost FROM lineitem GROUP BY ALL""")
def _(t):
    p = t("lineitem").select(F.col("l_returnflag").alias("chrom"), F.col("l_discount").alias("q"), (F.col("l_quantity") - 25).alias("log2_fc"))
    return X.summary(p, 0.03)


@query("measured_change", "C11", """WITH p AS (SELECT chrom, i, j, coalesce(sum(cnt) FILTER (sample = 'a'), 0) AS u, coalesce(sum(cnt) FILTER (sample = 'b'), 0) AS a
  FROM v_pooled WHERE j - i >= 2 GROUP BY ALL)
SELECT chrom, i, j, round(log2((a + 1) / ta) - log2((u + 1) / tu), 6) AS change FROM p JOIN (SELECT chrom, sum(u) AS tu, sum(a) AS ta FROM p GROUP BY ALL) q USING (chrom) WHERE u + a >= 10""")
def _(t):
    m = t("v_pooled")
    return r(X.measured_change(m.filter("sample = 'a'"), m.filter("sample = 'b'")), "change")


@query("plant_changes", "C12")
def _(t):
    c = t("v_off")
    spikes = c.filter(F.col("cnt") >= 3).select("sample", "chrom", "i", "j", F.when(F.col("j") % 2 == 0, 4.0).otherwise(0.25).alias("fold"))
    return X.plant_changes(c, spikes, 1, ["sample", "chrom"])


@query("thin_counts", "C12")
def _(t):
    return X.thin_counts(t("v_contacts"), 0.5, 1, ["sample", "chrom"])


view("v_runs", """SELECT o_orderpriority AS region, cast(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS double) AS fold,
  o_custkey % 20 AS discoveries, o_custkey % 20 - o_custkey % 20 % 7 AS "false", cast(10 AS bigint) AS planted, o_custkey % 20 % 7 AS found FROM {orders}""".replace('"false"', "`false`"),
     """SELECT o_orderpriority AS region, cast(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 4 END AS double) AS fold,
  o_custkey % 20 AS discoveries, o_custkey % 20 - o_custkey % 20 % 7 AS "false", cast(10 AS bigint) AS planted, o_custkey % 20 % 7 AS found FROM {orders}""")


@query("discovery_summary", "C13", """SELECT fold, count(*) AS runs, round(avg("false" / greatest(discoveries, 1)), 6) AS mean_fdp,
  round(avg(found / greatest(planted, 1)), 6) AS recall, cast(sum(discoveries) AS BIGINT) AS discoveries FROM v_runs GROUP BY fold""")
def _(t):
    return r(X.discovery_summary(t("v_runs"), 50), "mean_fdp", "recall").drop("low", "high")


@query("discovery_interval", "C13, G8")
def _(t):
    return r(X.discovery_summary(t("v_runs"), 200), "low", "high", "mean_fdp", "recall")


@query("distance_change", "C14", """WITH m AS (SELECT chrom, i, j, ln(max(cnt) FILTER (sample = 'b') / max(cnt) FILTER (sample = 'a')) AS m FROM v_pooled WHERE i < j GROUP BY ALL)
SELECT chrom, i, j, round(m - avg(m) OVER (PARTITION BY chrom), 6) AS change FROM m WHERE m IS NOT NULL""")
def _(t):
    p = t("v_pooled").filter("i < j").withColumnRenamed("cnt", "median")
    return r(X.distance_change(p.filter("sample = 'a'"), p.filter("sample = 'b'"), ["chrom"]), "change")
