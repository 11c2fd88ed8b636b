"""Imaging statistics, accuracy scores and shared primitives."""

from pyspark.sql import functions as F

from ..functions import groups as GR, ranks as R, stats as ST
from ..operators import ensemble as EN, imaging as H
from .base import query, view
from .maps import r

view("v_traces", """SELECT concat('set', cast(label % 2 AS varchar(9))) AS dataset, concat('c', cast(label AS varchar(9))) AS copy, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS locus,
  CASE WHEN element_at(embedding, 4) > -0.12 THEN cast(element_at(embedding, 1) AS double) * 1000 END AS x, cast(element_at(embedding, 2) AS double) * 1000 AS y, cast(element_at(embedding, 3) AS double) * 1000 AS z FROM {embeddings}""",
     """SELECT concat('set', cast(label % 2 AS varchar(9))) AS dataset, concat('c', cast(label AS varchar(9))) AS copy, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS locus,
  CASE WHEN embedding[4] > -0.12 THEN embedding[1]::DOUBLE * 1000 END AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z FROM {embeddings}""")
view("v_places", "SELECT DISTINCT dataset, locus FROM {v_traces}")
# every pair of loci: in Spark the loci meet by tiles of 256, and a pair keeps its tile
view("v_tiles", "SELECT dataset, locus, t, explode(ts) AS o FROM (SELECT /*+ BROADCAST(n) */ p.*, ts FROM (SELECT dataset, locus, cast(floor(locus / 256) AS bigint) AS t FROM {v_places}) p JOIN (SELECT dataset, collect_set(cast(floor(locus / 256) AS bigint)) AS ts FROM {v_places} GROUP BY dataset) n ON p.dataset = n.dataset)")
view("v_sigma", """SELECT a.dataset, a.locus AS i, b.locus AS j, cast(70 + 3 * (b.locus - a.locus) + (a.locus * 7) % 11 AS double) AS sigma, a.t AS tile_i, b.t AS tile_j
FROM {v_tiles} a JOIN {v_tiles} b ON a.dataset = b.dataset AND a.t = b.o AND a.o = b.t AND a.locus < b.locus""",
     "SELECT a.dataset, a.locus AS i, b.locus AS j, cast(70 + 3 * (b.locus - a.locus) + (a.locus * 7) % 11 AS double) AS sigma FROM {v_places} a JOIN {v_places} b ON a.dataset = b.dataset AND a.locus < b.locus")
D2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
CD = f"""cd AS (SELECT a.dataset, a.copy, a.locus AS i, b.locus AS j, sqrt({D2}) AS d FROM v_traces a JOIN v_traces b ON a.dataset = b.dataset AND a.copy = b.copy AND a.locus < b.locus WHERE a.x IS NOT NULL AND b.x IS NOT NULL)"""


@query("keep_copies", "A24", """SELECT t.dataset, t.copy, locus FROM v_traces t JOIN (SELECT dataset, copy, count(*) AS k FROM v_traces WHERE x IS NOT NULL GROUP BY ALL) k USING (dataset, copy)
JOIN (SELECT dataset, count(DISTINCT locus) AS n FROM v_traces GROUP BY ALL) n USING (dataset) WHERE k >= 0.8 * n""")
def _(t):
    return H.keep_copies(t("v_traces"), 0.8).select("dataset", "copy", "locus")


@query("half_stats", "H1", f"""WITH {CD}, r AS (SELECT dataset, quantile_cont(d, 0.5) AS r FROM cd WHERE j = i + 1 GROUP BY ALL)
SELECT dataset, i, j, count(*) AS seen, round(avg(CASE WHEN d < r THEN 1.0 ELSE 0 END), 6) AS freq, round(quantile_cont(d, 0.5), 6) AS median FROM cd JOIN r USING (dataset) GROUP BY dataset, i, j""")
def _(t):
    return r(H.half_stats(t("v_traces")), "freq", "median")


@query("half_stats_fixed_radius", "H1", f"WITH {CD} SELECT dataset, i, j, count(*) AS seen, round(avg(CASE WHEN d < 150 THEN 1.0 ELSE 0 END), 6) AS freq, round(quantile_cont(d, 0.5), 6) AS median FROM cd GROUP BY dataset, i, j")
def _(t):
    return r(H.half_stats(t("v_traces"), 150.0), "freq", "median")


@query("split_copies", "H2", """SELECT dataset, n // 2 AS a, n - n // 2 AS b FROM (SELECT o_orderpriority AS dataset, count(DISTINCT o_custkey) AS n FROM orders GROUP BY ALL) t""")
def _(t):
    c = t("orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_custkey").alias("copy"))
    return H.split_copies(c, 3).groupBy("dataset").agg(F.count_if(F.col("half") == "a").alias("a"), F.count_if(F.col("half") == "b").alias("b"))


# two positive maps of the same pairs: pooled counts of both conditions turned into distances
view("v_maps", """SELECT a.chrom, a.i, a.j, a.j - a.i AS sep, 300 / (a.cnt + 1) + (a.i * 13) % 7 AS pred, 280 / (b.cnt + 1) + (a.j * 5) % 9 AS truth, 290 / (a.cnt + b.cnt) + (a.j * 3) % 5 AS other
FROM {v_pooled} a JOIN {v_pooled} b ON a.chrom = b.chrom AND a.i = b.i AND a.j = b.j AND a.sample = 'a' AND b.sample = 'b' WHERE a.i < a.j""", stored=True)
RANKS = """{p} AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY {x}) + (count(*) OVER (PARTITION BY {k}, {x}) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY {k} ORDER BY {y}) + (count(*) OVER (PARTITION BY {k}, {y}) - 1) / 2.0 AS ry,
  rank() OVER (PARTITION BY {k} ORDER BY {xf}) + (count(*) OVER (PARTITION BY {k}, {xf}) - 1) / 2.0 AS fx, rank() OVER (PARTITION BY {k} ORDER BY {yf}) + (count(*) OVER (PARTITION BY {k}, {yf}) - 1) / 2.0 AS fy FROM {src})"""


def scored(src, x, y, key="chrom", name="k"):
    return (f"free AS (SELECT *, round({x} / avg({x}) OVER (PARTITION BY {key}, sep), 12) AS xf, round({y} / avg({y}) OVER (PARTITION BY {key}, sep), 12) AS yf FROM {src}),\n"
            + RANKS.format(p=name, k=key, x=x, y=y, xf="xf", yf="yf", src="free"))


@query("map_scores", "H3, G5, G6", f"""WITH {scored('v_maps', 'pred', 'truth')}
SELECT chrom, count(*) AS pairs, round(corr(rx, ry), 6) AS spearman, round(corr(fx, fy), 6) AS spearman_trend_removed, round(corr(pred, truth), 6) AS pearson,
  round(2 * covar_pop(pred, truth) / (var_pop(pred) + var_pop(truth) + pow(avg(pred) - avg(truth), 2)), 6) AS ccc, round(quantile_cont(pred / truth, 0.5), 6) AS scale FROM k GROUP BY chrom""")
def _(t):
    return r(H.map_scores(t("v_maps"), ["chrom"]), "spearman", "spearman_trend_removed", "pearson", "ccc", "scale")


@query("agreement", "G6", """SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS pearson, round(2 * covar_pop(l_quantity, l_extendedprice) / (var_pop(l_quantity) + var_pop(l_extendedprice) + pow(avg(l_quantity) - avg(l_extendedprice), 2)), 9) AS ccc,
  round(quantile_cont(l_extendedprice / l_quantity, 0.5), 6) AS scale FROM lineitem GROUP BY l_returnflag""")
def _(t):
    return r(r(ST.agreement(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "pearson", "scale"), "ccc", digits=9)


@query("genomic_baseline", "H4", """SELECT m.chrom, i, j, round(exp(c) * pow(sep, k), 6) AS baseline FROM v_maps m JOIN (SELECT chrom, regr_slope(ln(truth), ln(sep)) AS k, regr_intercept(ln(truth), ln(sep)) AS c FROM v_maps GROUP BY ALL) q USING (chrom)""")
def _(t):
    return r(H.genomic_baseline(t("v_maps"), ["chrom"], "truth"), "baseline").select("chrom", "i", "j", "baseline")


_B = {lv: EN.central_interval(lv) for lv in H.LEVELS}


@query("interval_coverage", "H5", f"WITH {CD}, z AS (SELECT dataset, d / sigma AS z FROM cd JOIN v_sigma USING (dataset, i, j))\n" + "\nUNION ALL ".join(
    f"SELECT dataset, count(*) AS measurements, {lv} AS level, round(avg(CASE WHEN z > {lo!r} AND z < {hi!r} THEN 1.0 ELSE 0 END), 6) AS coverage FROM z GROUP BY dataset" for lv, (lo, hi) in _B.items()))
def _(t):
    return r(H.interval_coverage(H.standard_distances(t("v_traces"), t("v_sigma"))), "coverage")


@query("pit_total", "H5", f"WITH {CD} SELECT dataset, count(*) AS measurements, 200 AS bins FROM cd JOIN v_sigma USING (dataset, i, j) GROUP BY dataset")
def _(t):
    h = H.pit_histogram(H.standard_distances(t("v_traces"), t("v_sigma")))
    return h.groupBy("dataset").agg(F.sum("n").alias("measurements"), F.count(F.lit(1)).alias("bins"))


@query("pit_histogram", "H5")
def _(t):
    return H.pit_histogram(H.standard_distances(t("v_traces"), t("v_sigma")))


view("v_pit", """SELECT dataset, cast(bin AS int) AS bin, n FROM (SELECT l_returnflag AS dataset, l_quantity - 1 AS bin, count(*) + 0 AS n FROM {lineitem} GROUP BY l_returnflag, l_quantity - 1) t""")


@query("recalibrate", "H6", """WITH h AS (SELECT *, sum(n) OVER (PARTITION BY dataset ORDER BY bin) / sum(n) OVER (PARTITION BY dataset) AS hi, (sum(n) OVER (PARTITION BY dataset ORDER BY bin) - n) / sum(n) OVER (PARTITION BY dataset) AS lo, count(*) OVER (PARTITION BY dataset) AS b FROM v_pit),
u AS (SELECT dataset, level, side, (bin + (q - lo) / (hi - lo)) / b AS u FROM h CROSS JOIN (SELECT l AS level, unnest(['low', 'high']) AS side, unnest([(1 - l) / 2, (1 + l) / 2]) AS q FROM (SELECT unnest([0.5::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS l) x) p WHERE q > lo AND q <= hi)
SELECT dataset, level, round(max(u) FILTER (side = 'low'), 6) AS low, round(max(u) FILTER (side = 'high'), 6) AS high FROM u GROUP BY ALL""")
def _(t):
    return r(H.recalibrate(t("v_pit")), "low", "high").drop("low_sigma", "high_sigma")


@query("recalibrated_coverage", "H6")
def _(t):
    z = H.standard_distances(t("v_traces"), t("v_sigma"))
    return r(H.recalibrated_coverage(z, H.recalibrate(H.pit_histogram(z))), "coverage")


view("v_medians", "SELECT dataset AS unit, i, j, 1.4 * sigma AS median, (j - i) * 30000 AS sep, tile_i, tile_j FROM {v_sigma}",
     "SELECT dataset AS unit, i, j, 1.4 * sigma AS median, (j - i) * 30000 AS sep FROM {v_sigma}")
BANDS = [0.0, 100_000.0, 300_000.0, 1_000_000.0, 1e12]
HIST = f"""{CD}, hist AS (SELECT unit, CASE WHEN sep >= 1000000 THEN 3 WHEN sep >= 300000 THEN 2 WHEN sep >= 100000 THEN 1 ELSE 0 END AS band,
  cast(least(39, floor((least(4.0, greatest(-4.0, ln(d / median))) + 4) / 8 * 40)) AS INTEGER) AS bin, count(*) AS n FROM cd JOIN v_medians m ON m.unit = cd.dataset AND m.i = cd.i AND m.j = cd.j GROUP BY ALL)"""


def ratio_hist(t):
    return H.log_ratio_histogram(t("v_traces").withColumnRenamed("dataset", "unit"), t("v_medians"), BANDS, -4.0, 4.0, 40)


@query("log_ratio_histogram", "H7", f"WITH {HIST} SELECT * FROM hist")
def _(t):
    return ratio_hist(t)


POOL = f"""{HIST}, pool AS (SELECT band, bin, sum(n / t / u) AS share FROM hist JOIN (SELECT unit, band, sum(n) AS t FROM hist GROUP BY ALL) a USING (unit, band) JOIN (SELECT band, count(DISTINCT unit) AS u FROM hist GROUP BY ALL) b USING (band) GROUP BY ALL)"""


@query("pooled_histograms", "H7", f"WITH {POOL} SELECT band, bin, round(share, 9) AS share FROM pool")
def _(t):
    return r(H.pool_histograms(ratio_hist(t)), "share", digits=9)


QUANT = f"""{POOL}, run AS (SELECT *, sum(share) OVER (PARTITION BY band ORDER BY bin) / sum(share) OVER (PARTITION BY band) AS hi, (sum(share) OVER (PARTITION BY band ORDER BY bin) - share) / sum(share) OVER (PARTITION BY band) AS lo FROM pool),
qq AS (SELECT band, q, -4 + (bin + (q - lo) / (hi - lo)) / 40 * 8 AS value FROM run CROSS JOIN (SELECT unnest([0.05::DOUBLE, 0.95::DOUBLE]) AS q) p WHERE q > lo AND q <= hi)"""


@query("conformal_quantiles", "H7", f"WITH {QUANT} SELECT band, q, round(value, 6) AS value FROM qq")
def _(t):
    return r(H.histogram_quantiles(H.pool_histograms(ratio_hist(t)), [0.05, 0.95], -4.0, 4.0, 40), "value")


@query("conformal_coverage", "H7", f"""WITH {QUANT}, b AS (SELECT band, min(value) AS lo, max(value) AS hi FROM qq GROUP BY band)
SELECT band, 0.9 AS level, round(sum(greatest(0, least(hi, -4 + (bin + 1) * 0.2) - greatest(lo, -4 + bin * 0.2)) / 0.2 * n) / sum(n), 6) AS coverage, round(max(exp(hi - lo)), 6) AS width FROM hist JOIN b USING (band) GROUP BY band""")
def _(t):
    h = ratio_hist(t)
    q = H.histogram_quantiles(H.pool_histograms(h), [0.05, 0.95], -4.0, 4.0, 40)
    b = q.groupBy("band").agg(F.lit(0.9).alias("level"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return r(H.histogram_coverage(h, b, -4.0, 4.0, 40), "coverage", "width")


STRATA = """st AS (SELECT m.*, least(greatest(len(list_filter(e, lambda x: x <= sep)) - 1, 0), len(e) - 2) AS stratum FROM v_maps m JOIN (
  SELECT chrom, list_distinct(quantile_cont(sep, [0, .2, .4, .6, .8, 1])) AS e FROM v_maps GROUP BY chrom) q USING (chrom)),
er AS (SELECT st.*, abs(ln(pred / truth) - m) AS error FROM st JOIN (SELECT chrom, stratum, quantile_cont(ln(pred / truth), 0.5) AS m FROM st GROUP BY ALL) q USING (chrom, stratum))"""


def errors(t):
    s = H.separation_strata(t("v_maps").withColumn("sep", F.col("sep").cast("double")), ["chrom"], 5)
    return H.pair_error(s, ["chrom"], "pred", "truth")


@query("pair_error", "H8", f"WITH {STRATA} SELECT chrom, i, j, cast(stratum AS INTEGER) AS stratum, round(error, 6) AS error FROM er")
def _(t):
    return r(errors(t), "error").select("chrom", "i", "j", "stratum", "error")


@query("stratified_spearman", "H8", f"""WITH {STRATA}, k AS (SELECT chrom, stratum, rank() OVER (PARTITION BY chrom, stratum ORDER BY other) + (count(*) OVER (PARTITION BY chrom, stratum, other) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY chrom, stratum ORDER BY round(-error, 9)) + (count(*) OVER (PARTITION BY chrom, stratum, round(-error, 9)) - 1) / 2.0 AS b FROM er),
c AS (SELECT chrom, stratum, count(*) AS n, corr(a, b) AS rho FROM k GROUP BY ALL HAVING count(*) >= 10)
SELECT chrom, round(sum(rho * n) / sum(n), 6) AS rho, cast(sum(n) AS BIGINT) AS pairs FROM c WHERE rho IS NOT NULL AND NOT isnan(rho) GROUP BY chrom""")
def _(t):
    return r(H.stratified_spearman(errors(t).withColumn("error", F.round("error", 9)), ["chrom"], "other"), "rho")


@query("bead_medians", "H8", """SELECT chrom, bead, round(quantile_cont(pred, 0.5), 6) AS pred, round(quantile_cont(other, 0.5), 6) AS other FROM (
  SELECT chrom, i AS bead, pred, other FROM v_maps UNION ALL SELECT chrom, j, pred, other FROM v_maps) t GROUP BY chrom, bead""")
def _(t):
    return r(H.bead_medians(t("v_maps"), ["chrom"], ["pred", "other"]), "pred", "other")


@query("reliability_scores", "H9")
def _(t):
    p = t("v_off").select("sample", "chrom", "i", "j", (F.col("cnt") / (F.col("cnt") + 9)).alias("f"), F.col("cnt").alias("counts"), (F.col("cnt") + 20).alias("n_obs"),
                          (F.lit(150.0) + F.col("j") - F.col("i")).alias("sigma"))
    return r(H.input_scores(p, ["sample", "chrom"], 150.0), "input_se", "misfit", "combined").select("sample", "chrom", "i", "j", "input_se", "misfit", "combined")


view("v_scores", """SELECT p_brand AS dataset, substr(p_type, 1, 5) AS input, concat('m', cast(p_size % 6 AS varchar(9))) AS method, CASE WHEN p_partkey % 9 = 0 THEN 'failed' ELSE 'ok' END AS status,
  p_retailprice / 20 AS percent_of_ceiling, p_retailprice / 3000 AS raw_spearman FROM {part}""")
MEAN = "mean AS (SELECT dataset, input, method, avg(percent_of_ceiling) AS percent_of_ceiling, avg(raw_spearman) AS raw_spearman, count(*) AS splits FROM v_scores WHERE status = 'ok' GROUP BY ALL)"


@query("mean_over_splits", "H10", f"WITH {MEAN} SELECT dataset, input, method, round(percent_of_ceiling, 6) AS percent_of_ceiling, round(raw_spearman, 6) AS raw_spearman, splits FROM mean")
def _(t):
    return r(H.mean_over_splits(t("v_scores"), ["dataset", "input", "method"], ["percent_of_ceiling", "raw_spearman"]), "percent_of_ceiling", "raw_spearman")


@query("where_beaten", "H10", f"""WITH {MEAN}, l AS (SELECT dataset, input, method, 'percent_of_ceiling' AS metric, percent_of_ceiling AS value FROM mean UNION ALL SELECT dataset, input, method, 'raw_spearman', raw_spearman FROM mean),
b AS (SELECT dataset, input, metric, max(value) AS best, arg_max(method, value) AS best_method FROM l WHERE method IN ('m0', 'm1') GROUP BY ALL)
SELECT dataset, input, metric, method, round(value, 6) AS value, round(best, 6) AS best, best_method FROM l JOIN b USING (dataset, input, metric) WHERE method NOT IN ('m0', 'm1') AND value > best""")
def _(t):
    m = H.mean_over_splits(t("v_scores"), ["dataset", "input", "method"], ["percent_of_ceiling", "raw_spearman"])
    return r(H.where_beaten(m, ["m0", "m1"], ["dataset", "input"], ["percent_of_ceiling", "raw_spearman"]), "value", "best")


@query("mean_by_separation", "H11", "SELECT chrom, j - i AS sep, round(avg(truth), 6) AS mean, count(*) AS pairs FROM v_maps WHERE j - i <= 40 GROUP BY ALL")
def _(t):
    return r(H.mean_by_separation(t("v_maps").drop("sep"), ["chrom"], "truth", 40), "mean")


view("v_loops", "SELECT sample, chrom, i * 20000 AS a, j * 20000 AS b FROM {v_pooled} WHERE cnt >= 7 AND j - i >= 4")


@query("loops_in_windows", "H12", """SELECT w.region AS window_name, sample, l.chrom, a, b FROM v_loops l JOIN v_regions w ON l.chrom = w.chrom WHERE a >= start AND b < start + 600000 AND b - a BETWEEN 100000 AND 500000""")
def _(t):
    w = t("v_regions").select("region", "chrom", "start", F.lit(600_000).alias("span"))
    return H.loops_in_windows(t("v_loops"), w, 100_000, 500_000).select(F.col("region").alias("window_name"), "sample", "chrom", "a", "b")


@query("pooled_f1", "H12", """SELECT p_brand, cast(sum(p_size % 5) AS BIGINT) AS tp, cast(sum(p_size % 3) AS BIGINT) AS fp, cast(sum(p_size % 4) AS BIGINT) AS fn, round(sum(p_size % 5) / (sum(p_size % 5) + sum(p_size % 3)), 6) AS precision,
  round(sum(p_size % 5) / (sum(p_size % 5) + sum(p_size % 4)), 6) AS recall, round(2 * sum(p_size % 5) / (2 * sum(p_size % 5) + sum(p_size % 3) + sum(p_size % 4)), 6) AS f1 FROM part GROUP BY p_brand""")
def _(t):
    c = t("part").select("p_brand", (F.col("p_size") % 5).alias("tp"), (F.col("p_size") % 3).alias("fp"), (F.col("p_size") % 4).alias("fn"))
    return r(H.pooled_f1(c, ["p_brand"]), "precision", "recall", "f1")


view("v_labels_scores", "SELECT lang, quality AS label, cast(n_chars AS double) AS score FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id")


@query("roc_auc", "H13", """WITH k AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM v_labels_scores)
SELECT lang, round((sum(rk * label) - sum(label) * (sum(label) + 1) / 2) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM k GROUP BY lang""")
def _(t):
    return r(H.roc_auc(t("v_labels_scores"), ["lang"]), "auc")


@query("score_spearman", "H13", """WITH k AS (SELECT lang, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY label) + (count(*) OVER (PARTITION BY lang, label) - 1) / 2.0 AS b FROM v_labels_scores)
SELECT lang, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY lang""")
def _(t):
    return r(R.spearman(t("v_labels_scores"), ["lang"], "score", "label"), "rho")


TILED = """m AS (SELECT chrom, 'all_pairs' AS pair_set, i, j, sep, pred, other, truth FROM v_maps UNION ALL SELECT chrom, 'within_tiles', i, j, sep, pred, other, truth FROM v_maps WHERE
  list_position(list_transform([33, 67], lambda e: i < e), true) IS NOT DISTINCT FROM list_position(list_transform([33, 67], lambda e: j < e), true)),
fa AS (SELECT *, round(other / avg(other) OVER w, 12) AS a, round(truth / avg(truth) OVER w, 12) AS b, round(pred / avg(pred) OVER w, 12) AS p FROM m WINDOW w AS (PARTITION BY chrom, pair_set, sep)),
kk AS (SELECT *, rank() OVER (PARTITION BY chrom, pair_set ORDER BY a) + (count(*) OVER (PARTITION BY chrom, pair_set, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY chrom, pair_set ORDER BY b) + (count(*) OVER (PARTITION BY chrom, pair_set, b) - 1) / 2.0 AS rb,
  rank() OVER (PARTITION BY chrom, pair_set ORDER BY p) + (count(*) OVER (PARTITION BY chrom, pair_set, p) - 1) / 2.0 AS rp FROM fa)"""


@query("share_of_ceiling", "H14", f"WITH {TILED} SELECT chrom, pair_set, count(*) AS pairs, round(corr(ra, rb), 6) AS ceiling, round(corr(rp, rb), 6) AS spearman_trend_removed, round(100 * corr(rp, rb) / corr(ra, rb), 3) AS percent_of_ceiling FROM kk GROUP BY chrom, pair_set")
def _(t):
    p = t("v_maps").select("chrom", "i", "j", "sep", "pred", F.col("other").alias("median_a"), F.col("truth").alias("median_b"), F.lit(100).alias("n"), F.lit(3).alias("tiles"))
    s = H.share_of_ceiling(p, ["chrom"])
    return r(s, "ceiling", "spearman_trend_removed").select("chrom", "pair_set", "pairs", "ceiling", "spearman_trend_removed", F.round("percent_of_ceiling", 3).alias("percent_of_ceiling"))


@query("stratum_ranks", "H15", f"""WITH {STRATA} SELECT chrom, i, j, round((rank() OVER (PARTITION BY chrom, stratum ORDER BY other) + (count(*) OVER (PARTITION BY chrom, stratum, other) - 1) / 2.0 - 1) / greatest(count(*) OVER (PARTITION BY chrom, stratum) - 1, 1), 6) AS rank_share FROM st""")
def _(t):
    s = H.separation_strata(t("v_maps").withColumn("sep", F.col("sep").cast("double")), ["chrom"], 5)
    return r(H.stratum_ranks(s, ["chrom"], "other", "rank_share"), "rank_share").select("chrom", "i", "j", "rank_share")


@query("pooled_units", "H15", "SELECT round(sum(rho * pairs) / sum(pairs), 6) AS rho, count(*) AS units FROM (SELECT p_brand AS unit, avg(p_retailprice) / 3000 AS rho, count(*) AS pairs FROM part GROUP BY ALL) t")
def _(t):
    u = t("part").groupBy(F.col("p_brand").alias("unit")).agg((F.avg("p_retailprice") / 3000).alias("rho"), F.count(F.lit(1)).alias("pairs"))
    return r(H.pooled_units(u, reps=50), "rho").drop("low", "high")


@query("pooled_units_interval", "H15, G8")
def _(t):
    u = t("part").groupBy(F.col("p_brand").alias("unit")).agg((F.avg("p_retailprice") / 3000).alias("rho"), F.count(F.lit(1)).alias("pairs"))
    return r(H.pooled_units(u, reps=200), "rho", "low", "high")


# ---------------------------------------------------------------- shared primitives
@query("clusters_within_radius", "G2", """WITH RECURSIVE p AS (SELECT sample, chrom, i, j, i * 1000 + j AS node FROM v_pooled WHERE cnt >= 6 AND j - i >= 3),
e AS (SELECT a.sample, a.chrom, a.node AS u, b.node AS v FROM p a JOIN p b ON a.sample = b.sample AND a.chrom = b.chrom AND pow(a.i - b.i, 2) + pow(a.j - b.j, 2) <= 4),
reach(sample, chrom, u, v) AS (SELECT sample, chrom, u, v FROM e UNION SELECT reach.sample, reach.chrom, reach.u, e.v FROM reach JOIN e ON reach.sample = e.sample AND reach.chrom = e.chrom AND reach.v = e.u)
SELECT sample, chrom, u AS node, min(v) AS component FROM reach GROUP BY ALL""")
def _(t):
    p = t("v_pooled").filter((F.col("cnt") >= 6) & (F.col("j") - F.col("i") >= 3)).select("sample", "chrom", "i", "j", (F.col("i") * 1000 + F.col("j")).alias("node"))
    o = p.select("sample", "chrom", F.col("i").alias("i2"), F.col("j").alias("j2"), F.col("node").alias("b"))
    from ..functions.intervals import within
    e = within(p, o, ["sample", "chrom"], [("i", "i2"), ("j", "j2")], [2, 2]).filter((F.pow(F.col("i") - F.col("i2"), 2) + F.pow(F.col("j") - F.col("j2"), 2) <= 4) & (F.col("node") < F.col("b")))
    return GR.components(p, e.select("sample", "chrom", F.col("node").alias("a"), "b"), ["sample", "chrom"])


@query("false_discovery", "G3", """WITH k AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_extendedprice % 1000) / 1000 AS p FROM lineitem),
o AS (SELECT *, p * count(*) OVER (PARTITION BY l_returnflag) / row_number() OVER (PARTITION BY l_returnflag ORDER BY p) AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY p) AS rk FROM k)
SELECT l_orderkey, l_linenumber, round(p, 6) AS p, round(least(1.0, min(v) OVER (PARTITION BY l_returnflag ORDER BY rk DESC)), 6) AS q FROM o""")
def _(t):
    p = t("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", (F.col("l_extendedprice") % 1000 / 1000).alias("p"))
    return r(R.benjamini_hochberg(p, ["l_returnflag"]), "p", "q").select("l_orderkey", "l_linenumber", "p", "q")


@query("runs_of_equal_values", "G4", """WITH d AS (SELECT c_custkey AS pos, c_mktsegment AS chrom, c_custkey % 2 = 0 AS f FROM customer),
g AS (SELECT *, sum(CASE WHEN pos - p > 4 THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM (SELECT *, lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS p FROM d) q)
SELECT chrom, min(pos) AS start, max(pos) + 1 AS "end", count(*) AS length FROM g GROUP BY chrom, k HAVING count(*) >= 2""")
def _(t):
    return GR.runs(t("customer").select(F.col("c_mktsegment").alias("chrom"), F.col("c_custkey").alias("pos")), ["chrom"], "pos", 3, 2)


@query("rank_correlation", "G5", """WITH k AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY l_returnflag""")
def _(t):
    return r(R.spearman(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), "rho")


MATCH = """c AS (SELECT a.chrom, a.a AS pa, a.b AS pb, b.a AS ra, b.b AS rb, abs(a.a - b.a) + abs(a.b - b.b) AS dist FROM v_loops a JOIN v_loops b ON a.chrom = b.chrom AND a.sample = 'a' AND b.sample = 'b' AND abs(a.a - b.a) <= 20000 AND abs(a.b - b.b) <= 20000),
o AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY dist, pa, pb, ra, rb) AS rk FROM c),
pick AS (SELECT chrom, 0 AS rk, cast([] AS VARCHAR[]) AS used, 0 AS tp FROM (SELECT DISTINCT chrom FROM v_loops) UNION ALL
  SELECT p.chrom, o.rk, CASE WHEN ok THEN list_concat(p.used, [concat('p', pa, '_', pb), concat('r', ra, '_', rb)]) ELSE p.used END, p.tp + CASE WHEN ok THEN 1 ELSE 0 END
  FROM (SELECT p.*, o.*, NOT list_contains(p.used, concat('p', o.pa, '_', o.pb)) AND NOT list_contains(p.used, concat('r', o.ra, '_', o.rb)) AS ok FROM (SELECT chrom AS pc, rk AS prk, used, tp FROM pick) p JOIN o ON p.pc = o.chrom AND o.rk = p.prk + 1) x
  JOIN (SELECT chrom, rk, used, tp FROM pick) p ON p.chrom = x.pc AND p.rk = x.prk JOIN o ON o.chrom = x.chrom AND o.rk = x.rk)"""
MATCH = MATCH.replace("""  FROM (SELECT p.*, o.*, NOT list_contains(p.used, concat('p', o.pa, '_', o.pb)) AND NOT list_contains(p.used, concat('r', o.ra, '_', o.rb)) AS ok FROM (SELECT chrom AS pc, rk AS prk, used, tp FROM pick) p JOIN o ON p.pc = o.chrom AND o.rk = p.prk + 1) x
  JOIN (SELECT chrom, rk, used, tp FROM pick) p ON p.chrom = x.pc AND p.rk = x.prk JOIN o ON o.chrom = x.chrom AND o.rk = x.rk)""",
                      "  FROM pick p JOIN o ON p.chrom = o.chrom AND o.rk = p.rk + 1)")
for _a in ("CASE WHEN ok THEN list", "CASE WHEN ok THEN 1"):
    MATCH = MATCH.replace(_a, _a.replace("ok", "NOT list_contains(p.used, concat('p', o.pa, '_', o.pb)) AND NOT list_contains(p.used, concat('r', o.ra, '_', o.rb))"))


@query("match_loops", "G7, H12", f"""WITH RECURSIVE {MATCH}, n AS (SELECT chrom, count(*) FILTER (sample = 'a') AS p, count(*) FILTER (sample = 'b') AS r FROM v_loops GROUP BY ALL)
SELECT chrom, tp, p - tp AS fp, r - tp AS fn, round(tp / p, 6) AS precision, round(tp / r, 6) AS recall, round(2 * tp / (p + r), 6) AS f1 FROM (SELECT chrom, max(tp) AS tp FROM pick GROUP BY chrom) k JOIN n USING (chrom)""")
def _(t):
    from ..functions.intervals import within
    lp = t("v_loops")
    a, b = lp.filter("sample = 'a'").select("chrom", "a", "b"), lp.filter("sample = 'b'").select("chrom", F.col("a").alias("ra"), F.col("b").alias("rb"))
    c = within(a, b, ["chrom"], [("a", "ra"), ("b", "rb")], [20_000, 20_000]).select(
        "chrom", F.struct("a", "b").alias("p"), F.struct("ra", "rb").alias("q"), (F.abs(F.col("a") - F.col("ra")) + F.abs(F.col("b") - F.col("rb"))).alias("dist"))
    m = GR.match_one_to_one(c, ["chrom"], "p", "q", ["dist", "p", "q"])
    return r(GR.precision_recall(a, b, m, ["chrom"]), "precision", "recall", "f1")


@query("bootstrap_rows", "G8", "SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean FROM lineitem GROUP BY l_returnflag")
def _(t):
    return r(ST.bootstrap_mean(t("lineitem"), ["l_returnflag"], ["l_suppkey"], "l_extendedprice", 50), "mean").drop("low", "high")


@query("bootstrap_interval", "G8")
def _(t):
    return r(ST.bootstrap_mean(t("lineitem"), ["l_returnflag"], ["l_suppkey"], "l_extendedprice", 100), "mean", "low", "high")


@query("bootstrap_pairs", "G8")
def _(t):
    return r(ST.bootstrap_pairs(t("v_maps"), ["chrom"], "i", "j", "pred", "truth", 30), "low", "mid", "high")


@query("percentile_of_reference", "G10", """SELECT e.event_id, round((SELECT count(*) FROM v_cover c WHERE c.cov <= e.v) / (SELECT count(*) FROM v_cover), 6) AS pct FROM (SELECT event_id, floor(value) AS v FROM events) e""")
def _(t):
    e = t("events").select("event_id", F.floor("value").cast("double").alias("v"), F.lit(0).alias("g"))
    ref = t("v_cover").select(F.lit(0).alias("g"), F.col("cov").alias("ref"))
    return R.share_at_or_below(e, ["g"], "v", ref, "ref").select("event_id", F.round(F.coalesce("pct", F.lit(0.0)), 6).alias("pct"))
