"""Map statistics, domains, compartments, balancing and loops."""

from pyspark.sql import functions as F

from ..operators import balance as BAL, compartments as COMP, domains as D, loops as L, maps as M
from .base import query, view

view("v_beads_map", """
SELECT concat('chr', CASE WHEN label % 3 = 0 THEN 'A' WHEN label % 3 = 1 THEN 'N' ELSE 'R' END) AS chrom,
       concat('m', cast(label AS varchar(9))) AS structure, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bead,
       cast(element_at(embedding, 1) AS double) AS x, cast(element_at(embedding, 2) AS double) AS y,
       cast(element_at(embedding, 3) AS double) AS z FROM {embeddings}""", """
SELECT concat('chr', CASE WHEN label % 3 = 0 THEN 'A' WHEN label % 3 = 1 THEN 'N' ELSE 'R' END) AS chrom,
       concat('m', label::VARCHAR) AS structure, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bead,
       embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM {embeddings}""")


def r(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("coverage_mask", "B4", """
SELECT c.sample, c.chrom, bin, cov, CASE WHEN m > 0 THEN cov >= 0.9 * m ELSE cov > 0 END AS ok
FROM v_cover c JOIN (SELECT sample, chrom, quantile_cont(cov, 0.5) AS m FROM v_cover WHERE cov > 0 GROUP BY ALL) q
  ON c.sample = q.sample AND c.chrom = q.chrom""")
def _(t):
    return M.coverage_mask(t("v_contacts"), t("v_sizes"), 0.9)


EXPECTED = """expd AS (SELECT b.sample, b.chrom, b.bin AS d, coalesce(s, 0) / (n - b.bin) AS expected FROM v_bins b LEFT JOIN (
  SELECT sample, chrom, j - i AS d, sum(cnt) AS s FROM v_contacts GROUP BY ALL) e ON b.sample = e.sample AND b.chrom = e.chrom AND b.bin = e.d)"""


@query("expected_by_distance", "B5", f"WITH {EXPECTED} SELECT sample, chrom, d, round(expected, 9) AS expected FROM expd")
def _(t):
    return r(M.expected(t("v_contacts"), t("v_sizes")), "expected", digits=9)


EXPBAL = """pairs AS (SELECT a.sample, a.chrom, b.bin - a.bin AS d, count(*) AS pairs FROM v_weights a JOIN v_weights b
    ON a.sample = b.sample AND a.chrom = b.chrom AND b.bin >= a.bin WHERE a.weight IS NOT NULL AND b.weight IS NOT NULL GROUP BY ALL),
sums AS (SELECT c.sample, c.chrom, j - i AS d, sum(cnt * x.weight * y.weight) AS s FROM v_contacts c
    JOIN v_weights x ON c.sample = x.sample AND c.chrom = x.chrom AND c.i = x.bin
    JOIN v_weights y ON c.sample = y.sample AND c.chrom = y.chrom AND c.j = y.bin WHERE x.weight * y.weight IS NOT NULL GROUP BY ALL),
expb AS (SELECT b.sample, b.chrom, b.bin AS d, n, coalesce(p.pairs, 0) AS pairs, coalesce(s, 0) / greatest(coalesce(p.pairs, 0), 1) AS expected
    FROM v_bins b LEFT JOIN pairs p ON b.sample = p.sample AND b.chrom = p.chrom AND b.bin = p.d
    LEFT JOIN sums e ON b.sample = e.sample AND b.chrom = e.chrom AND b.bin = e.d)"""


@query("expected_balanced", "B6", f"WITH {EXPBAL} SELECT sample, chrom, d, pairs, round(expected, 9) AS expected FROM expb")
def _(t):
    return r(M.expected_balanced(t("v_contacts"), t("v_sizes"), t("v_weights")), "expected", digits=9)


@query("observed_over_expected", "B7", f"""WITH {EXPECTED}
SELECT c.sample, c.chrom, i, j, round(CASE WHEN expected > 0 THEN cnt / expected ELSE 0 END, 6) AS oe
FROM v_contacts c JOIN expd e ON c.sample = e.sample AND c.chrom = e.chrom AND c.j - c.i = e.d""")
def _(t):
    oe = M.observed_over_expected(t("v_contacts"), M.expected(t("v_contacts"), t("v_sizes")))
    return r(oe.select("sample", "chrom", "i", "j", "oe"), "oe")


PS = f"""{EXPBAL}, ps AS (SELECT sample, chrom, d, n, d * 20000 AS separation_bp, CASE WHEN d >= 1 AND expected > 0 THEN
  expected / sum(CASE WHEN d >= 1 AND expected > 0 THEN expected END) OVER (PARTITION BY sample, chrom) END AS p FROM expb)"""


@query("p_of_s", "B8", f"WITH {PS} SELECT sample, chrom, d, separation_bp, round(p, 9) AS p FROM ps")
def _(t):
    return r(M.p_of_s(t("v_contacts"), t("v_sizes"), t("v_weights"), 20_000).drop("max_d"), "p", digits=9)


@query("p_of_s_slope", "B8", f"""WITH {PS} SELECT sample, chrom, round(CASE WHEN count(p) >= 3 THEN regr_slope(log10(p), log10(separation_bp)) END, 6) AS slope
FROM ps WHERE d >= 2 AND d <= greatest(3, n // 10) GROUP BY sample, chrom""")
def _(t):
    return r(M.p_of_s_slope(M.p_of_s(t("v_contacts"), t("v_sizes"), t("v_weights"), 20_000)), "slope")


@query("contact_decay", "B9", f"""WITH {EXPECTED} SELECT DISTINCT e.sample, e.chrom, d, round(expected, 9) AS expected
FROM expd e JOIN (SELECT sample, chrom, cast(round_even(pow(n - 1, k / 29.0), 0) AS BIGINT) AS d
   FROM v_sizes CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS k) u) g USING (sample, chrom, d)""")
def _(t):
    return r(M.contact_decay(t("v_contacts"), t("v_sizes")).drop("n"), "expected", digits=9)


@query("decay_exponent", "B9", f"""WITH {EXPECTED} SELECT sample, chrom, round(-regr_slope(ln(expected), ln(d)), 6) AS gamma FROM (
  SELECT DISTINCT e.sample, e.chrom, d, expected FROM expd e JOIN (SELECT sample, chrom, cast(round_even(pow(n - 1, k / 29.0), 0) AS BIGINT) AS d
    FROM v_sizes CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS k) u) g USING (sample, chrom, d)) t
WHERE d BETWEEN 2 AND 10 AND expected > 0 GROUP BY sample, chrom""")
def _(t):
    return r(M.decay_exponent(M.contact_decay(t("v_contacts"), t("v_sizes"))), "gamma")


def insulation_cte(table, w):
    return f"""raw AS (SELECT b.sample, b.chrom, b.bin, b.n, coalesce(sum(cnt), 0) AS s FROM (SELECT DISTINCT sample, chrom, bin, 100 AS n FROM
    (SELECT DISTINCT sample, chrom FROM {table}) q CROSS JOIN (SELECT unnest(generate_series(cast(0 AS BIGINT), 99)) AS bin) u) b
  LEFT JOIN {table} c ON b.sample = c.sample AND b.chrom = c.chrom AND c.i < b.bin AND b.bin < c.j AND b.bin - c.i <= {w} AND c.j - b.bin <= {w}
  GROUP BY ALL),
ins AS (SELECT sample, chrom, bin, n, s, CASE WHEN bin >= {w} AND bin < n - {w} THEN log2(greatest(s, 1e-9) /
    avg(CASE WHEN bin >= {w} AND bin < n - {w} THEN s END) OVER (PARTITION BY sample, chrom)) END AS v FROM raw)"""


INS = insulation_cte("v_contacts", 12)
# candidates, then the greedy choice as a recursion over depth order
BOUND_TAIL = """cand AS (SELECT sample, chrom, bin, n, least(l, rr) - v AS depth FROM (
    SELECT *, min(v) OVER (PARTITION BY sample, chrom ORDER BY bin ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS m,
      max(v) OVER (PARTITION BY sample, chrom ORDER BY bin ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS l,
      max(v) OVER (PARTITION BY sample, chrom ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND 12 FOLLOWING) AS rr FROM ins) t
  WHERE v IS NOT NULL AND v <= m AND l IS NOT NULL AND rr IS NOT NULL AND least(l, rr) - v >= 0.15),
ordered AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom ORDER BY depth DESC, bin) AS rk FROM cand),
pick AS (SELECT sample, chrom, 0 AS rk, cast([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT sample, chrom FROM ordered)
  UNION ALL SELECT p.sample, p.chrom, o.rk, CASE WHEN len(list_filter(p.kept, lambda x: abs(x - o.bin) < 6)) = 0 THEN list_append(p.kept, o.bin) ELSE p.kept END
  FROM pick p JOIN ordered o ON p.sample = o.sample AND p.chrom = o.chrom AND o.rk = p.rk + 1),
bounds AS (SELECT sample, chrom, unnest(kept) AS bin FROM (SELECT sample, chrom, arg_max(kept, rk) AS kept FROM pick GROUP BY ALL))"""


@query("insulation", "B10", f"WITH {INS} SELECT sample, chrom, bin, s AS sum, round(v, 6) AS insulation FROM ins")
def _(t):
    return r(D.insulation(t("v_contacts"), t("v_sizes"), D.window_for(20_000, 100)).drop("n"), "insulation")


def _bounds(t, table="v_contacts"):
    sizes = t(table).select("sample", "chrom").distinct().withColumn("n", F.lit(100).cast("long"))
    return D.boundaries(D.insulation(t(table), sizes, 12), 12), sizes


@query("boundaries", "B11, G1", f"WITH RECURSIVE {INS}, {BOUND_TAIL} SELECT b.sample, b.chrom, b.bin, round(depth, 6) AS depth FROM bounds b JOIN cand c USING (sample, chrom, bin)")
def _(t):
    return r(_bounds(t)[0].drop("n"), "depth")


DOMS = """edges AS (SELECT sample, chrom, 0 AS bin FROM v_sizes UNION SELECT sample, chrom, bin FROM bounds),
doms AS (SELECT *, (row_number() OVER (PARTITION BY sample, chrom ORDER BY start) - 1) % 2 AS label FROM (
  SELECT sample, chrom, bin AS start, coalesce(lead(bin) OVER (PARTITION BY sample, chrom ORDER BY bin), 100) AS "end" FROM edges) t
  WHERE "end" - start >= 3)"""


@query("domains", "B12", f"WITH RECURSIVE {INS}, {BOUND_TAIL}, {DOMS} SELECT * FROM doms")
def _(t):
    return D.domains(_bounds(t)[0], t("v_sizes"))


@query("domain_summary", "B12", f"""WITH RECURSIVE {INS}, {BOUND_TAIL}, {DOMS}
SELECT sample, chrom, count(*) AS domains, round(quantile_cont(("end" - start) * 20000 / 1e6, 0.5), 3) AS median_mb FROM doms GROUP BY ALL""")
def _(t):
    return D.domain_summary(D.domains(_bounds(t)[0], t("v_sizes")), 20_000)


@query("diamond_signal", "B16", """
SELECT b.sample, b.chrom, b.bin, CASE WHEN b.bin >= 5 AND b.bin < 95 THEN round(coalesce(sum(cnt), 0) / 25, 9) END AS signal
FROM v_bins b LEFT JOIN v_contacts c ON b.sample = c.sample AND b.chrom = c.chrom AND c.i > b.bin - 5 AND c.i <= b.bin AND c.j > b.bin AND c.j <= b.bin + 5
GROUP BY b.sample, b.chrom, b.bin""")
def _(t):
    return r(D.diamond_signal(t("v_contacts"), t("v_sizes")).drop("n"), "signal", digits=9)


@query("rank_sum_boundaries", "B16", """WITH sig AS (
  SELECT b.sample, b.chrom, b.bin, CASE WHEN b.bin >= 5 AND b.bin < 95 THEN coalesce(sum(cnt), 0) / 25 END AS signal
  FROM v_bins b LEFT JOIN v_contacts c ON b.sample = c.sample AND b.chrom = c.chrom AND c.i > b.bin - 5 AND c.i <= b.bin AND c.j > b.bin AND c.j <= b.bin + 5
  GROUP BY b.sample, b.chrom, b.bin),
cand AS (SELECT * FROM (SELECT *, min(signal) OVER (PARTITION BY sample, chrom ORDER BY bin ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS m FROM sig) s
  WHERE signal IS NOT NULL AND signal <= m),
cells AS (SELECT q.sample, q.chrom, q.bin, x <= 0 AND y >= 1 AS dia, coalesce(c.cnt, 0) AS v FROM cand q
  CROSS JOIN (SELECT unnest(generate_series(-4, 5)) AS x) a CROSS JOIN (SELECT unnest(generate_series(-4, 5)) AS y) b
  LEFT JOIN v_contacts c ON c.sample = q.sample AND c.chrom = q.chrom AND c.i = q.bin + x AND c.j = q.bin + y WHERE x < y),
us AS (SELECT sample, chrom, bin, sum(CASE WHEN a.v < b.v THEN 1.0 WHEN a.v = b.v THEN 0.5 ELSE 0 END) AS u2
  FROM cells a JOIN cells b USING (sample, chrom, bin) WHERE a.dia AND NOT b.dia GROUP BY ALL),
ties AS (SELECT sample, chrom, bin, sum(t * t * t - t) AS ties, count(*) AS kinds FROM (
  SELECT sample, chrom, bin, v, count(*) AS t FROM cells GROUP BY ALL) q GROUP BY ALL)
SELECT sample, chrom, bin, round(z, 6) AS z FROM (
  SELECT sample, chrom, bin, (u2 - 250 - 0.5) / sqrt(500 / 12.0 * (46 - ties / (45 * 44))) AS z FROM us JOIN ties USING (sample, chrom, bin) WHERE kinds > 1) f
WHERE z > 1.6448536269514722""")
def _(t):
    return r(D.rank_sum_boundaries(t("v_contacts"), t("v_sizes")).drop("p"), "z")


# candidate boundaries: bins covered less than both neighbours
view("v_grid_bounds", """SELECT sample, chrom, bin FROM (SELECT *, lag(cov) OVER (PARTITION BY sample, chrom ORDER BY bin) AS l, lead(cov) OVER (PARTITION BY sample, chrom ORDER BY bin) AS r FROM {v_cover}) t
WHERE cov < l AND cov < r""")


@query("domain_scores", "B17", """WITH edges AS (SELECT sample, chrom, bin FROM v_grid_bounds UNION SELECT sample, chrom, 0 FROM v_sizes UNION SELECT sample, chrom, n FROM v_sizes),
cand AS (SELECT a.sample, a.chrom, a.bin AS a, b.bin AS b, greatest(0, 2 * a.bin - b.bin) AS lo, least(100, 2 * b.bin - a.bin) AS hi
  FROM edges a JOIN edges b ON a.sample = b.sample AND a.chrom = b.chrom AND b.bin - a.bin >= 3),
px AS (SELECT q.*, j - i AS d, i, j, cnt, sum(cnt) OVER (PARTITION BY q.sample, q.chrom, a, b, j - i) / (hi - lo - (j - i)) AS mu
  FROM cand q JOIN v_off c ON c.sample = q.sample AND c.chrom = q.chrom AND i >= lo AND j < hi),
s AS (SELECT sample, chrom, a, b, lo, hi, sum(CASE WHEN i >= a AND j < b THEN cnt / mu ELSE 0 END) AS si,
  sum(CASE WHEN (i < a AND j >= a AND j < b) OR (i >= a AND i < b AND j >= b) THEN cnt / mu ELSE 0 END) AS so FROM px GROUP BY ALL)
SELECT sample, chrom, a AS start, b AS "end", round(ratio, 6) AS ratio FROM (
  SELECT *, (si / ((b - a) * (b - a - 1) / 2)) / (so / ((b - a) * ((a - lo) + (hi - b)))) AS ratio FROM s WHERE so > 0) f WHERE ratio >= 1.1""")
def _(t):
    return r(D.domain_scores(t("v_contacts"), t("v_grid_bounds"), t("v_sizes"), min_ratio=1.1), "ratio")


@query("copy_number", "B19", """WITH cov AS (SELECT b.sample, b.chrom, b.bin, coalesce(sum(c.cnt), 0) AS cov FROM v_bins b LEFT JOIN (
    SELECT sample, chrom, i AS bin, cnt FROM v_contacts UNION ALL SELECT sample, chrom, j, cnt FROM v_contacts) c
    ON b.sample = c.sample AND b.chrom = c.chrom AND b.bin = c.bin GROUP BY ALL),
raw AS (SELECT cov.*, CASE WHEN cov > 0 THEN 2 * cov / m END AS raw FROM cov JOIN (
    SELECT sample, chrom, quantile_cont(cov, 0.5) AS m FROM cov WHERE cov > 0 GROUP BY ALL) q USING (sample, chrom))
SELECT sample, chrom, bin, round_even(quantile_cont(raw, 0.5) OVER (PARTITION BY sample, chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) AS copies FROM raw""")
def _(t):
    return M.copy_number(t("v_contacts"), t("v_sizes"))


@query("copy_number_segments", "B19, G4", """WITH c AS (SELECT sample, chrom, bin, floor(cov / 14) AS copies FROM v_cover),
f AS (SELECT *, bin - row_number() OVER (PARTITION BY sample, chrom, copies ORDER BY bin) AS g FROM c WHERE copies <> 4)
SELECT sample, chrom, copies, min(bin) AS start, max(bin) + 1 AS "end", count(*) AS length FROM f GROUP BY sample, chrom, copies, g HAVING count(*) >= 2""")
def _(t):
    cn = t("v_cover").select("sample", "chrom", "bin", F.floor(F.col("cov") / 14).cast("double").alias("copies"))
    return M.copy_number_segments(cn, 4, 2)


@query("target_distance", "B20", """WITH ref AS (SELECT sample, chrom, coalesce(quantile_cont(CASE WHEN j - i = 1 THEN cnt END, 0.5), quantile_cont(cnt, 0.95)) AS m_ref
  FROM v_off GROUP BY ALL)
SELECT o.sample, o.chrom, i, j, m_ref, round(least(400.0, greatest(40.0, 50 * pow(cnt / m_ref, -1.0 / 3.0))), 6) AS distance FROM v_off o JOIN ref USING (sample, chrom)""")
def _(t):
    return r(M.target_distance(t("v_off")).drop("cnt"), "distance")


@query("counts_to_probability", "B21", """SELECT o.sample, o.chrom, i, j, cnt, round(least(0.999, cnt * (0.5 / m)), 9) AS p FROM v_off o JOIN (
  SELECT sample, chrom, quantile_cont(cnt, 0.5) AS m FROM v_off WHERE j - i = 1 GROUP BY ALL) q USING (sample, chrom)""")
def _(t):
    return r(M.counts_to_probability(t("v_off")), "p", digits=9)


@query("contact_fit", "B22, G5", """WITH p AS (SELECT c.sample, c.chrom, a.structure, cnt, -sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS d
  FROM v_off c JOIN v_beads_map a ON c.chrom = a.chrom AND c.i = a.bead JOIN v_beads_map b ON c.chrom = b.chrom AND c.j = b.bead AND a.structure = b.structure),
k AS (SELECT *, rank() OVER (PARTITION BY sample, chrom, structure ORDER BY d) + (count(*) OVER (PARTITION BY sample, chrom, structure, d) - 1) / 2.0 AS rd,
  rank() OVER (PARTITION BY sample, chrom, structure ORDER BY cnt) + (count(*) OVER (PARTITION BY sample, chrom, structure, cnt) - 1) / 2.0 AS rc FROM p)
SELECT sample, chrom, structure, count(*) AS n, round(corr(rd, rc), 6) AS rho FROM k GROUP BY ALL""")
def _(t):
    return r(M.contact_fit(t("v_off"), t("v_beads_map"), ["sample", "chrom"]), "rho")


view("v_samples", "SELECT sample, chrom FROM {v_sizes}")


@query("ice_balance", "B1")
def _(t):
    w, _report = BAL.ice(t("v_contacts"), t("v_sizes"), max_iter=200)
    return r(w, "bias", "weight")


@query("ice_report", "B1")
def _(t):
    return BAL.ice(t("v_pooled"), t("v_pooled").select("sample", "chrom").distinct().withColumn("n", F.lit(100).cast("long")), max_iter=200)[1]


@query("balanced_contacts", "B2", """WITH b AS (SELECT c.sample, c.chrom, i, j, cnt, cnt * x.weight * y.weight AS bal FROM v_contacts c
    JOIN v_weights x ON c.sample = x.sample AND c.chrom = x.chrom AND c.i = x.bin
    JOIN v_weights y ON c.sample = y.sample AND c.chrom = y.chrom AND c.j = y.bin WHERE x.weight * y.weight > 0)
SELECT sample, chrom, i, j, round(bal * s, 6) AS cnt FROM b JOIN (
  SELECT sample, chrom, quantile_cont(cnt, 0.5) / quantile_cont(bal, 0.5) AS s FROM b GROUP BY ALL) q USING (sample, chrom)""")
def _(t):
    return r(BAL.balanced_contacts(t("v_contacts"), t("v_weights")), "cnt")


@query("kr_balance", "B3")
def _(t):
    return r(BAL.kr(t("v_contacts"), t("v_sizes"))[0], "weight")


@query("kr_row_sums", "B3", """SELECT sample, chrom, true AS balanced FROM v_sizes""")
def _(t):
    # after balancing, every kept bin has the row sum 1: checked against a constant answer
    c = t("v_pooled")
    sizes = c.select("sample", "chrom").distinct().withColumn("n", F.lit(100).cast("long"))
    w, report = BAL.kr(c, sizes)
    back = t("v_sizes").select("sample", "chrom").withColumn("side", F.when(F.col("sample").isin("s0", "s1"), "a").otherwise("b"))
    rep = report.select(F.col("sample").alias("side"), "chrom", (F.col("converged") & (F.col("row_sum_cv") < 1e-5)).alias("balanced"))
    return back.join(rep, ["side", "chrom"]).select("sample", "chrom", "balanced")


@query("compartments", "B13")
def _(t):
    track = t("v_cover").select("sample", "chrom", "bin", F.col("cov").cast("double").alias("value"))
    return r(COMP.compartments(t("v_contacts"), t("v_sizes"), track), "eigenvector", digits=4)


@query("quick_loop_candidates", "B14", f"""WITH {EXPECTED}, band AS (SELECT c.sample, c.chrom, i, j, cnt, cnt / expected AS oe
  FROM v_contacts c JOIN expd e ON c.sample = e.sample AND c.chrom = e.chrom AND c.j - c.i = e.d WHERE j - i BETWEEN 5 AND 25 AND expected > 0)
SELECT sample, chrom, i, j, round(oe, 6) AS oe FROM band JOIN (SELECT sample, chrom, quantile_cont(cnt, 0.9) AS f FROM band GROUP BY ALL) q USING (sample, chrom)
WHERE oe >= 2 AND cnt >= greatest(f, 2.0)""")
def _(t):
    return r(L.quick_loop_candidates(t("v_contacts"), t("v_sizes"), min_oe=2.0, min_count=2.0), "oe")


@query("quick_loops", "B14, G1", f"""WITH RECURSIVE {EXPECTED}, band AS (SELECT c.sample, c.chrom, i, j, cnt, cnt / expected AS oe
  FROM v_contacts c JOIN expd e ON c.sample = e.sample AND c.chrom = e.chrom AND c.j - c.i = e.d WHERE j - i BETWEEN 5 AND 25 AND expected > 0),
cand AS (SELECT *, row_number() OVER (PARTITION BY sample, chrom ORDER BY oe DESC, i, j) AS rk FROM band JOIN (
  SELECT sample, chrom, quantile_cont(cnt, 0.9) AS f FROM band GROUP BY ALL) q USING (sample, chrom) WHERE oe >= 2 AND cnt >= greatest(f, 2.0)),
pick AS (SELECT sample, chrom, 0 AS rk, cast([] AS STRUCT(i BIGINT, j BIGINT)[]) AS kept FROM (SELECT DISTINCT sample, chrom FROM cand)
  UNION ALL SELECT p.sample, p.chrom, o.rk, CASE WHEN len(list_filter(p.kept, lambda x: abs(x.i - o.i) <= 4 AND abs(x.j - o.j) <= 4)) = 0
    THEN list_append(p.kept, struct_pack(i := o.i, j := o.j)) ELSE p.kept END FROM pick p JOIN cand o ON p.sample = o.sample AND p.chrom = o.chrom AND o.rk = p.rk + 1),
kept AS (SELECT sample, chrom, unnest(kept) AS k FROM (SELECT sample, chrom, arg_max(kept, rk) AS kept FROM pick GROUP BY ALL))
SELECT * FROM (SELECT k.sample, k.chrom, c.i, c.j, round(c.oe, 6) AS oe, row_number() OVER (PARTITION BY k.sample, k.chrom ORDER BY c.oe DESC, c.i, c.j) AS rank
  FROM kept k JOIN cand c ON k.sample = c.sample AND k.chrom = c.chrom AND k.k.i = c.i AND k.k.j = c.j) t""")
def _(t):
    return r(L.quick_loops(t("v_contacts"), t("v_sizes"), min_oe=2.0, min_count=2.0), "oe")


STENCIL = {"donut": "abs(y) <= 3 AND abs(x) <= 3 AND NOT (abs(y) <= 1 AND abs(x) <= 1) AND y <> 0 AND x <> 0",
           "lower_left": "y > 0 AND x < 0 AND NOT (abs(y) <= 1 AND abs(x) <= 1)",
           "horizontal": "abs(y) <= 1 AND NOT (abs(y) <= 1 AND abs(x) <= 1)",
           "vertical": "abs(x) <= 1 AND NOT (abs(y) <= 1 AND abs(x) <= 1)"}
_SUMS = ", ".join(f"sum(CASE WHEN {c} THEN bal ELSE 0 END) AS s_{k}, sum(CASE WHEN {c} THEN ex ELSE 0 END) AS t_{k}" for k, c in STENCIL.items())
_LAM = ", ".join(f"round(CASE WHEN t_{k} > 0 AND s_{k} > 0 THEN s_{k} * e0 / t_{k} / ww ELSE 0 END, 6) AS e_{k}" for k in STENCIL)


@query("loop_neighbourhoods", "B15", f"""WITH {EXPBAL},
target AS (SELECT c.sample, c.chrom, i, j, cnt AS obs, a.weight * b.weight AS ww, e.expected AS e0 FROM v_contacts c
  JOIN v_weights a ON c.sample = a.sample AND c.chrom = a.chrom AND c.i = a.bin JOIN v_weights b ON c.sample = b.sample AND c.chrom = b.chrom AND c.j = b.bin
  JOIN expb e ON e.sample = c.sample AND e.chrom = c.chrom AND e.d = c.j - c.i
  WHERE j - i BETWEEN 4 AND 40 AND a.weight * b.weight IS NOT NULL),
cell AS (SELECT t.*, y, x, t.i + y AS r, t.j + x AS c FROM target t CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS y) a CROSS JOIN (SELECT unnest(generate_series(-3, 3)) AS x) b),
val AS (SELECT q.sample, q.chrom, q.i, q.j, q.obs, q.ww, q.e0, y, x, coalesce(p.cnt * a.weight * b.weight, 0) AS bal, CASE WHEN abs(q.c - q.r) < 45 THEN e.expected ELSE 0 END AS ex FROM cell q
  JOIN v_weights a ON a.sample = q.sample AND a.chrom = q.chrom AND a.bin = q.r AND a.weight IS NOT NULL
  JOIN v_weights b ON b.sample = q.sample AND b.chrom = q.chrom AND b.bin = q.c AND b.weight IS NOT NULL
  JOIN expb e ON e.sample = q.sample AND e.chrom = q.chrom AND e.d = abs(q.c - q.r)
  LEFT JOIN v_contacts p ON p.sample = q.sample AND p.chrom = q.chrom AND p.i = least(q.r, q.c) AND p.j = greatest(q.r, q.c)),
agg AS (SELECT sample, chrom, i, j, obs, ww, e0, {_SUMS} FROM val GROUP BY sample, chrom, i, j, obs, ww, e0)
SELECT sample, chrom, i, j, obs, {_LAM} FROM agg""")
def _(t):
    tests = L.neighbourhood_tests(t("v_contacts"), t("v_sizes"), t("v_weights"), 20_000, max_sep_bp=800_000, min_sep_bp=60_000,
                                  p=1, w=3, tile=32)
    keep = [f"e_{k}" for k in L.KERNELS]
    return r(tests.select("sample", "chrom", "i", "j", "obs", *keep), *keep)


@query("call_loops", "B15, G2, G3")
def _(t):
    return L.call_loops(t("v_contacts"), t("v_sizes"), t("v_weights"), 20_000, fdr=0.5)
