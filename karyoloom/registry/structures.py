"""Bead tables: size, shape, scaling, neighbours, superposition, evaluation, ensembles."""

from pyspark.sql import functions as F

from ..operators import ensemble as EN, evaluate as EV, structures as S
from .base import query, view
from .maps import r

# conformations of one chain: every frame displaces the beads by a rule of their coordinates
view("v_frames", """SELECT structure, f AS frame, bead, x + f * z / 10 AS x, y - f * x / 10 AS y, z + f * f * y / 10 AS z
FROM {v_beads} CROSS JOIN (SELECT explode(sequence(0, 3)) AS f) t""", """SELECT structure, f AS frame, bead, x + f * z / 10 AS x, y - f * x / 10 AS y, z + f * f * y / 10 AS z
FROM {v_beads} CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS f) t""")
D2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
SIZE = """sz AS (SELECT structure, count(*) AS beads, sqrt(var_pop(x) + var_pop(y) + var_pop(z)) AS rg,
  sqrt(pow(arg_max(x, bead) - arg_min(x, bead), 2) + pow(arg_max(y, bead) - arg_min(y, bead), 2) + pow(arg_max(z, bead) - arg_min(z, bead), 2)) AS re,
  quantile_cont(bond, 0.5) AS mb, avg(bond) AS ab FROM (
  SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS bond FROM v_beads WINDOW w AS (PARTITION BY structure ORDER BY bead)) t
  GROUP BY structure)"""


@query("structure_size", "E1", f"WITH {SIZE} SELECT structure, beads, round(rg, 6) AS rg, round(re, 6) AS end_to_end, round(mb, 6) AS median_bond, round(ab, 6) AS mean_bond FROM sz")
def _(t):
    return r(S.size(t("v_beads")), "rg", "end_to_end", "median_bond", "mean_bond")


@query("calibrate_bonds", "E2", f"WITH {SIZE} SELECT structure, bead, round(x * 50 / mb, 6) AS x, round(y * 50 / mb, 6) AS y, round(z * 50 / mb, 6) AS z, round(50 / mb, 9) AS scale FROM v_beads JOIN sz USING (structure)")
def _(t):
    c = S.calibrate(t("v_beads").drop("signal"))
    return r(r(c, "x", "y", "z"), "scale", digits=9)


SCALING = f"""grid AS (SELECT DISTINCT structure, n, cast(round_even(pow(n - 1, k / 39.0), 0) AS BIGINT) AS s FROM (
  SELECT structure, count(*) AS n FROM v_beads GROUP BY ALL) q CROSS JOIN (SELECT unnest(generate_series(0, 39)) AS k) u),
sc AS (SELECT g.structure, n, s, sqrt(avg({D2})) AS r FROM grid g JOIN v_beads a ON a.structure = g.structure
  JOIN v_beads b ON b.structure = g.structure AND b.bead = a.bead + s GROUP BY ALL)"""


@query("distance_scaling", "E3", f"WITH {SCALING} SELECT structure, n, s, round(r, 6) AS r FROM sc")
def _(t):
    return r(S.distance_scaling(t("v_beads")), "r")


@query("scaling_fit", "E3", f"""WITH {SCALING}, f AS (SELECT structure, regr_slope(ln(r), ln(s)) AS nu, regr_r2(ln(r), ln(s)) AS r2,
  sqrt((regr_syy(ln(r), ln(s)) - pow(regr_sxy(ln(r), ln(s)), 2) / regr_sxx(ln(r), ln(s))) / (count(*) - 2) / regr_sxx(ln(r), ln(s))) AS nu_se FROM sc WHERE s BETWEEN 2 AND 20 GROUP BY ALL)
SELECT structure, round(nu, 6) AS nu, round(nu_se, 6) AS nu_se, round(r2, 6) AS r2, CASE WHEN nu < 0.28 THEN 'saturated (confined / territory-limited)'
  WHEN abs(nu - 1 / 3.0) <= 0.05 THEN 'fractal globule' WHEN abs(nu - 0.5) <= 0.05 AND abs(nu - 0.5) <= abs(nu - 0.5876) THEN 'ideal chain'
  WHEN abs(nu - 0.5876) <= 0.05 THEN 'self-avoiding walk' WHEN nu > 0.5876 THEN 'stiff (persistence-dominated)' ELSE 'intermediate' END AS regime FROM f""")
def _(t):
    return r(S.scaling_fit(S.distance_scaling(t("v_beads")), (2, 20)), "nu", "nu_se", "r2")


@query("decay_fit", "E4", f"""SELECT a.structure, round(regr_slope(ln(sqrt({D2})), ln(b.bead - a.bead)), 6) AS gamma, round(regr_r2(ln(sqrt({D2})), ln(b.bead - a.bead)), 6) AS r2
FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND b.bead - a.bead BETWEEN 4 AND 20 GROUP BY a.structure""")
def _(t):
    return r(S.decay_fit(t("v_beads"), 4, 20), "gamma", "r2")


@query("decay_bins", "E4", f"""WITH p AS (SELECT a.structure, b.bead - a.bead AS s, ln(sqrt({D2})) AS ld FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND b.bead > a.bead),
e AS (SELECT DISTINCT structure, round_even(pow(greatest(2, top), k / 29.0), 0) AS e FROM (SELECT structure, max(s) AS top FROM p GROUP BY ALL) q CROSS JOIN (SELECT unnest(generate_series(0, 29)) AS k) u),
c AS (SELECT structure, s, (SELECT count(*) FROM e WHERE e.structure = q.structure AND e.e <= q.s) AS class FROM (SELECT DISTINCT structure, s FROM p) q)
SELECT structure, cast(class AS INTEGER) AS class, round(exp(avg(ln(s))), 6) AS s, round(exp(avg(ld)), 6) AS d FROM p JOIN c USING (structure, s) GROUP BY structure, class""")
def _(t):
    return r(S.decay_bins(t("v_beads")), "s", "d")


@query("gyration_invariants", "E5", """WITH c AS (SELECT structure, var_pop(x) AS xx, var_pop(y) AS yy, var_pop(z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz FROM v_beads GROUP BY ALL)
SELECT structure, round(xx + yy + zz, 3) AS trace, round((xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz) / 1e6, 3) AS second,
  round((xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)) / 1e9, 3) AS determinant,
  round(1 - 3 * (xx * yy + xx * zz + yy * zz - xy * xy - xz * xz - yz * yz) / pow(xx + yy + zz, 2), 6) AS anisotropy FROM c""")
def _(t):
    a, b, c = F.col("l1"), F.col("l2"), F.col("l3")
    return S.gyration_shape(t("v_beads")).select(
        "structure", F.round(a + b + c, 3).alias("trace"), F.round((a * b + a * c + b * c) / 1e6, 3).alias("second"),
        F.round(a * b * c / 1e9, 3).alias("determinant"), F.round("anisotropy", 6).alias("anisotropy"))


@query("gyration_shape", "E5")
def _(t):
    return r(S.gyration_shape(t("v_beads")), "l1", "l2", "l3", "asphericity", "asphericity_normed", "anisotropy", "acylindricity", digits=4)


@query("max_span", "E6", f"SELECT a.structure, round(max(sqrt({D2})), 6) AS span FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND a.bead < b.bead GROUP BY a.structure")
def _(t):
    return r(S.max_span(t("v_beads")), "span")


@query("superposed_rmsd", "E7")
def _(t):
    f = t("v_frames")
    return r(S.superposed_rmsd(f.filter("frame > 0"), f.filter("frame = 0").drop("frame"), ["structure", "frame"]), "rmsd")


@query("superpose_rotated", "E7", "SELECT structure, bead, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z FROM v_beads")
def _(t):
    # a rotated, shifted copy must come back onto the original
    b = t("v_beads").drop("signal")
    moved = b.select("structure", "bead", (F.col("y") * -1 + 7).alias("x"), (F.col("x") * 0.6 - F.col("z") * 0.8).alias("y"), (F.col("x") * 0.8 + F.col("z") * 0.6 - 3).alias("z"))
    s = S.superpose(moved, b)
    return s.select("structure", "bead", *[(F.round(c, 4) + 0.0).alias(c) for c in "xyz"])


NEAR = f"""near AS (SELECT a.structure, a.bead AS i, b.bead AS j, sqrt({D2}) AS d FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND b.bead - a.bead >= 2 AND {D2} < 150 * 150)"""


@query("neighbor_pairs", "E8", f"WITH {NEAR} SELECT structure, i, j, round(d, 6) AS d FROM near")
def _(t):
    return r(S.neighbor_pairs(t("v_beads"), 150.0), "d")


@query("proximity_contacts", "E8", f"SELECT a.structure, a.bead AS i, b.bead AS j, 1.0 AS cnt FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND b.bead > a.bead AND {D2} < 120 * 120")
def _(t):
    return S.proximity_contacts(t("v_beads"), 80.0)


@query("local_density", "E9", f"""WITH {NEAR} SELECT v.structure, v.bead, count(n.b) AS density FROM v_beads v LEFT JOIN (SELECT structure, i AS b FROM near UNION ALL SELECT structure, j FROM near) n
ON v.structure = n.structure AND v.bead = n.b GROUP BY v.structure, v.bead""")
def _(t):
    return S.local_density(t("v_beads"), 150.0).select("structure", "bead", "density")


@query("distance_correlation", "E10", f"""WITH f AS (SELECT p.structure, p.bead, p.x, p.y, p.z, q.x AS x2, q.y AS y2, q.z AS z2 FROM v_frames p JOIN v_frames q ON p.structure = q.structure AND p.bead = q.bead
  AND p.frame = 0 AND q.frame = 3)
SELECT a.structure, count(*) AS pairs, round(corr(sqrt({D2}), sqrt(pow(a.x2 - b.x2, 2) + pow(a.y2 - b.y2, 2) + pow(a.z2 - b.z2, 2))), 6) AS correlation
FROM f a JOIN f b ON a.structure = b.structure AND a.bead < b.bead GROUP BY a.structure""")
def _(t):
    f = t("v_frames")
    return r(S.distance_correlation(f.filter("frame = 0"), f.filter("frame = 3")), "correlation")


@query("coarse_distance_map", "E11", f"""WITH p AS (SELECT structure, bead // k AS block, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM v_beads JOIN (
  SELECT structure, cast(greatest(1, ceil(count(*) / 20.0)) AS BIGINT) AS k FROM v_beads GROUP BY ALL) q USING (structure) GROUP BY ALL)
SELECT a.structure, a.block AS i, b.block AS j, round(sqrt({D2}), 6) AS distance FROM p a JOIN p b ON a.structure = b.structure AND a.block < b.block""")
def _(t):
    return r(S.coarse_distance_map(t("v_beads"), 20), "distance")


@query("block_mean", "E11", "SELECT sample, chrom, i // 6 AS i, j // 6 AS j, round(avg(cnt), 6) AS cnt FROM v_contacts GROUP BY ALL")
def _(t):
    return r(S.block_mean(t("v_contacts"), 6, ["sample", "chrom"], "cnt"), "cnt")


@query("frame_metrics", "E12", """WITH b AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS bond FROM v_frames WINDOW w AS (PARTITION BY structure, frame ORDER BY bead)),
m AS (SELECT f.structure, f.frame, sqrt(avg(pow(f.x - o.x, 2) + pow(f.y - o.y, 2) + pow(f.z - o.z, 2))) AS rmsd, sqrt(max(pow(f.x - o.x, 2) + pow(f.y - o.y, 2) + pow(f.z - o.z, 2))) AS md
  FROM v_frames f JOIN v_frames o ON f.structure = o.structure AND f.bead = o.bead AND o.frame = 0 GROUP BY ALL)
SELECT structure, frame, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) AS rg,
  round(sqrt(pow(arg_max(x, bead) - arg_min(x, bead), 2) + pow(arg_max(y, bead) - arg_min(y, bead), 2) + pow(arg_max(z, bead) - arg_min(z, bead), 2)), 6) AS end_to_end,
  round(quantile_cont(bond, 0.5), 6) AS median_bond, round(any_value(rmsd), 6) AS rmsd, round(any_value(md), 6) AS max_displacement FROM b JOIN m USING (structure, frame) GROUP BY structure, frame""")
def _(t):
    return r(S.frame_metrics(t("v_frames")), "rg", "end_to_end", "median_bond", "rmsd", "max_displacement")


@query("rmsf", "E13")
def _(t):
    return r(S.rmsf(t("v_frames").withColumnRenamed("frame", "member")), "rmsf", digits=4)


@query("evaluate_structures", "E14, G9")
def _(t):
    return r(EV.evaluate(t("v_beads")), "rg", "b", "gamma_d", "gamma_c", "scaling_break", "spike_fraction", digits=4)


@query("exponents", "E14", f"""WITH p AS (SELECT a.structure, b.bead - a.bead AS s, ln(sqrt({D2})) AS ld, n, cast(greatest(8, n // 10) AS BIGINT) AS hi FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND b.bead > a.bead
  JOIN (SELECT structure, count(*) AS n FROM v_beads GROUP BY ALL) q ON q.structure = a.structure)
SELECT structure, round(regr_slope(ld, ln(s)) FILTER (s BETWEEN 4 AND hi), 6) AS gamma_d, round(regr_slope(ld, ln(s)) FILTER (s BETWEEN 2 AND 10), 6) AS gamma_short,
  round(regr_slope(ld, ln(s)) FILTER (s BETWEEN 4 AND round_even(sqrt(4 * hi), 0)), 6) AS gamma_low, round(regr_slope(ld, ln(s)) FILTER (s BETWEEN round_even(sqrt(4 * hi), 0) AND hi), 6) AS gamma_high
FROM p GROUP BY structure""")
def _(t):
    return r(EV.exponents(t("v_beads")), "gamma_d", "gamma_short", "gamma_low", "gamma_high")


@query("robust_z", "G9, E14", """WITH m AS (SELECT structure, median(signal) AS med FROM v_beads GROUP BY ALL), d AS (SELECT structure, median(abs(signal - med)) * 1.4826 AS mad FROM v_beads JOIN m USING (structure) GROUP BY ALL)
SELECT structure, bead, round((signal - med) / mad, 6) AS z FROM v_beads JOIN m USING (structure) JOIN d USING (structure)""")
def _(t):
    from ..functions.stats import robust_z
    return r(robust_z(t("v_beads"), ["structure"], "signal"), "z").select("structure", "bead", "z")


@query("population_summary", "E15", f"""WITH {SIZE}, l AS (SELECT beads % 2 AS population, 'rg' AS metric, rg AS v FROM sz UNION ALL SELECT beads % 2, 'end_to_end', re FROM sz UNION ALL SELECT beads % 2, 'mean_bond', ab FROM sz)
SELECT population, metric, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.9), 6) AS p90, count(*) AS members FROM l GROUP BY ALL""")
def _(t):
    s = S.size(t("v_beads")).withColumn("population", F.col("beads") % 2)
    return r(EV.population_summary(s, ["population"], ("rg", "end_to_end", "mean_bond")), "median", "p10", "p90")


@query("population_labels", "E15")
def _(t):
    return EV.label_counts(EV.evaluate(t("v_beads")))


@query("signal_metrics", "E16, G5", f"""WITH {SIZE}, near AS (SELECT a.structure, a.bead AS i, b.bead AS j FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND abs(b.bead - a.bead) >= 2 AND {D2} < 150 * 150),
d AS (SELECT v.structure, v.bead, signal, x, y, z, count(n.j) AS density FROM v_beads v LEFT JOIN near n ON v.structure = n.structure AND v.bead = n.i GROUP BY ALL),
e AS (SELECT *, sqrt(pow(x - avg(x) OVER w, 2) + pow(y - avg(y) OVER w, 2) + pow(z - avg(z) OVER w, 2)) AS radial FROM d WINDOW w AS (PARTITION BY structure)),
k AS (SELECT *, rank() OVER (PARTITION BY structure ORDER BY signal) + (count(*) OVER (PARTITION BY structure, signal) - 1) / 2.0 AS rs,
  rank() OVER (PARTITION BY structure ORDER BY density) + (count(*) OVER (PARTITION BY structure, density) - 1) / 2.0 AS rd,
  rank() OVER (PARTITION BY structure ORDER BY radial) + (count(*) OVER (PARTITION BY structure, radial) - 1) / 2.0 AS rr FROM e)
SELECT k.structure, beads, round(rg, 6) AS rg, round(beads * 1e6 / (8 * pow(sqrt(5 / 3.0) * rg, 3)), 6) AS packing, round(avg(density), 6) AS mean_neighbours,
  round(avg(CASE WHEN density >= 12 THEN 1.0 ELSE 0 END), 6) AS dense_fraction, round(avg(signal), 6) AS mean_signal, round(median(signal), 6) AS median_signal,
  round(stddev_pop(signal), 6) AS signal_sd, CASE WHEN count(*) >= 20 THEN round(corr(rs, rd), 6) END AS rho_density, CASE WHEN count(*) >= 20 THEN round(corr(rs, rr), 6) END AS rho_radial
FROM k JOIN sz USING (structure) GROUP BY k.structure, beads, rg""")
def _(t):
    m = EV.signal_metrics(t("v_beads"), 100.0)
    return r(m, "rg", "packing", "mean_neighbours", "dense_fraction", "mean_signal", "median_signal", "signal_sd", "rho_density", "rho_radial")


@query("notable_loci", "E16, G1")
def _(t):
    return EV.notable_loci(t("v_beads"), 100.0)


PICK = """o AS (SELECT structure, bead, round(signal, 6) AS v, row_number() OVER (PARTITION BY structure ORDER BY round(signal, 6) DESC, bead) AS rk FROM v_beads),
pick AS (SELECT structure, 0 AS rk, cast([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT structure FROM o) UNION ALL
  SELECT p.structure, o.rk, CASE WHEN len(list_filter(p.kept, lambda x: abs(x - o.bead) < 8)) = 0 AND len(p.kept) < 5 THEN list_append(p.kept, o.bead) ELSE p.kept END
  FROM pick p JOIN o ON p.structure = o.structure AND o.rk = p.rk + 1)"""


@query("spaced_top", "E17, G1", f"""WITH RECURSIVE {PICK} SELECT structure, bead, row_number() OVER (PARTITION BY structure ORDER BY v DESC, bead) AS rank FROM (
  SELECT structure, unnest(kept) AS bead FROM (SELECT structure, arg_max(kept, rk) AS kept FROM pick GROUP BY ALL)) k JOIN o USING (structure, bead)""")
def _(t):
    s = t("v_beads").select("structure", "bead", F.round("signal", 6).alias("score"))
    return S.spaced_top(s, ["structure"], "score", 5, 8).drop("score")


@query("best_window", "E17", """WITH w AS (SELECT structure, bead, sum(coalesce(signal, 0)) OVER (PARTITION BY structure ORDER BY bead ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS s, count(*) OVER (PARTITION BY structure) AS n FROM v_beads)
SELECT structure, bead AS start, bead + 12 AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY structure ORDER BY round(s, 9) DESC, bead) AS k FROM w WHERE bead + 12 <= n) q WHERE k = 1""")
def _(t):
    return S.best_window(t("v_beads").select("structure", "bead", F.col("signal").alias("score")), 12)


@query("structure_checks", "E18", """SELECT structure, beads, CASE WHEN beads < 4 THEN 'fewer than 4 beads' WHEN missing > 0 THEN 'missing or infinite coordinates'
  WHEN beads > 50 THEN 'bins outside the chromosome' END AS reason FROM (SELECT structure, count(*) AS beads, count(*) FILTER (signal < -0.42) AS missing FROM v_beads GROUP BY ALL) t
WHERE beads < 4 OR missing > 0 OR beads > 50""")
def _(t):
    b = t("v_beads").withColumn("x", F.when(F.col("signal") >= -0.42, F.col("x")))
    sizes = b.select("structure").distinct().withColumns({"start_bin": F.lit(0), "bins": F.lit(50)})
    return S.checks(b, sizes)


@query("frame_checks", "E18", "SELECT structure, 4 AS frames, count(*) AS times, count(*) AS labels FROM v_beads WHERE signal > 0.2 GROUP BY structure HAVING count(*) <> 4")
def _(t):
    b = t("v_beads").filter("signal > 0.2").select("structure", F.col("signal").alias("time"), F.lit("x").alias("label"))
    return S.frame_checks(t("v_frames").join(b.select("structure").distinct(), "structure"), b)


# P(|r| < r_c) by its power series; the spread keeps the argument below 5
@query("contact_probability", "E19", """SELECT l_orderkey, l_linenumber, round(sqrt(2 / pi()) * list_sum([CASE WHEN k % 2 = 0 THEN 1.0 ELSE -1.0 END * pow(x, 2 * k + 3) / (pow(2.0, k) * gamma(k + 1.0) * (2 * k + 3)) FOR k IN generate_series(0, 60)]), 4) AS p
FROM (SELECT l_orderkey, l_linenumber, 1 / (0.25 + l_quantity / 20) AS x FROM lineitem) t""")
def _(t):
    s = t("lineitem").select("l_orderkey", "l_linenumber", (0.25 + F.col("l_quantity") / 20).alias("s"))
    return s.select("l_orderkey", "l_linenumber", F.round(EN.contact_probability(F.col("s")), 4).alias("p"))


@query("sigma_round_trip", "E19", "SELECT l_orderkey, l_linenumber, round(l_quantity / 20 + 0.2, 3) AS sigma FROM lineitem")
def _(t):
    s = t("lineitem").select("l_orderkey", "l_linenumber", EN.contact_probability(F.col("l_quantity") / 20 + 0.2).alias("p"))
    return s.select("l_orderkey", "l_linenumber", F.round(EN.sigma_of(F.col("p")), 3).alias("sigma"))


@query("summarise_sigma", "E19", """SELECT l_orderkey, l_linenumber, round(sqrt(8 / pi()) * s, 6) AS mean, round(sqrt(3 - 8 / pi()) * s, 6) AS sd, round(1.5381722544550522 * s, 6) AS median FROM (
  SELECT l_orderkey, l_linenumber, l_quantity * 10 AS s FROM lineitem) t""")
def _(t):
    s = t("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 10).alias("sigma"))
    return r(EN.summarise_sigma(s, 150.0), "mean", "sd", "median").select("l_orderkey", "l_linenumber", "mean", "sd", "median")


view("v_freq", """SELECT concat(sample, chrom) AS map, i, j, cnt / (cnt + 9) AS f, cnt + 20 AS n_obs FROM {v_off}
UNION ALL SELECT concat(sample, chrom), j, i, CASE WHEN cnt > 2 THEN cnt / (cnt + 4) END, cnt + 10 FROM {v_off}""")
TARGETS = """tg AS (SELECT map, least(i, j) AS i, greatest(i, j) AS j, avg(f) AS f, greatest(max(n_obs), 1) AS n FROM v_freq WHERE f IS NOT NULL GROUP BY map, least(i, j), greatest(i, j)),
tw AS (SELECT *, c * n / (1 - c) AS w FROM (SELECT *, greatest(0.5 / n, least(1 - 0.5 / n, f)) AS c FROM tg) q)"""


@query("fit_targets", "E20", f"WITH {TARGETS} SELECT map, i, j, round(f, 6) AS f, n AS n_obs, round(c, 6) AS clipped, round(w / avg(w) OVER (PARTITION BY map), 6) AS weight FROM tw")
def _(t):
    return r(EN.fit_targets(t("v_freq"), by=["map"]), "f", "clipped", "weight").drop("log_target")


@query("fit_target_values", "E20")
def _(t):
    return r(EN.fit_targets(t("v_freq"), by=["map"]), "log_target", "weight")


@query("bead_reliability", "E21")
def _(t):
    tg = EN.fit_targets(t("v_freq"), by=["map"])
    model = t("v_off").select(F.concat("sample", "chrom").alias("map"), "i", "j", (F.lit(150.0) + F.col("j") - F.col("i")).alias("sigma"))
    beads = t("v_bins").select(F.concat("sample", "chrom").alias("map"), F.col("bin").alias("bead"))
    return r(EN.bead_reliability(tg, model, beads, 150.0, by=["map"]), "reliability")


@query("bead_coverage", "E21", f"""WITH {TARGETS}, e AS (SELECT map, i AS bead FROM tw UNION ALL SELECT map, j FROM tw)
SELECT concat(b.sample, b.chrom) AS map, bin AS bead, round(count(e.bead) / 99.0, 6) AS reliability FROM v_bins b LEFT JOIN e ON e.map = concat(b.sample, b.chrom) AND e.bead = b.bin GROUP BY ALL""")
def _(t):
    # a model equal to its targets leaves the coverage alone
    tg = EN.fit_targets(t("v_freq"), by=["map"])
    model = tg.select("map", "i", "j", F.exp(F.col("log_target") / 2).alias("sigma"))
    beads = t("v_bins").select(F.concat("sample", "chrom").alias("map"), F.col("bin").alias("bead"))
    return r(EN.bead_reliability(tg, model, beads, 1.0, by=["map"]), "reliability")


@query("overlap_report", "E22", f"""WITH p AS (SELECT a.structure, sqrt({D2}) AS d FROM v_beads a JOIN v_beads b ON a.structure = b.structure AND b.bead - a.bead >= 2 AND sqrt({D2}) < 120)
SELECT structure, round(coalesce(sum(pow((120 - d) / 150, 2)), 0) / n, 6) AS penalty, count(*) FILTER (120 - d > 3) AS overlaps, round(coalesce(max(120 - d), 0), 6) AS deepest, round(min(d), 6) AS closest
FROM (SELECT structure, count(*) AS n FROM v_beads GROUP BY ALL) q LEFT JOIN p USING (structure) GROUP BY structure, n""")
def _(t):
    return r(S.overlaps(t("v_beads"), 150.0, 120.0), "penalty", "deepest", "closest")


@query("message_graph", "E23", """WITH back AS (SELECT a.sample, a.chrom, a.bin AS dst, b.bin AS src, coalesce(c.cnt, 0) AS cnt, 1.0 AS backbone FROM v_bins a JOIN v_bins b ON a.sample = b.sample AND a.chrom = b.chrom AND abs(a.bin - b.bin) BETWEEN 1 AND 2
  LEFT JOIN v_contacts c ON c.sample = a.sample AND c.chrom = a.chrom AND c.i = least(a.bin, b.bin) AND c.j = greatest(a.bin, b.bin)),
far AS (SELECT sample, chrom, a AS dst, b AS src, cnt, 0.0 AS backbone FROM (SELECT *, row_number() OVER (PARTITION BY sample, chrom, a ORDER BY cnt DESC, b) AS k FROM (
  SELECT sample, chrom, i AS a, j AS b, cnt FROM v_contacts WHERE j - i > 2 UNION ALL SELECT sample, chrom, j, i, cnt FROM v_contacts WHERE j - i > 2) m) q WHERE k <= 8),
e AS (SELECT * FROM back UNION ALL SELECT * FROM far)
SELECT e.sample, e.chrom, dst, src, round(ln(1 + cnt) / ln(1 + m), 6) AS strength, round(ln(1 + abs(dst - src)) / ln(101), 6) AS separation, backbone, count(*) OVER (PARTITION BY e.sample, e.chrom, dst) AS degree
FROM e JOIN (SELECT sample, chrom, greatest(max(cnt), 1) AS m FROM v_contacts GROUP BY ALL) x ON e.sample = x.sample AND e.chrom = x.chrom""")
def _(t):
    return r(EN.message_graph(t("v_contacts"), t("v_sizes")), "strength", "separation")


@query("node_features", "E23", """WITH n AS (SELECT sample, chrom, bin, CASE WHEN weight IS NOT NULL THEN cov END AS g, CASE WHEN weight IS NOT NULL THEN ln(1 + cov * 2) END AS e, weight IS NOT NULL AS ok FROM v_cover JOIN v_weights USING (sample, chrom, bin))
SELECT sample, chrom, bin, round(coalesce((g - avg(g) OVER w) / (stddev_pop(g) OVER w + 1e-8), 0), 6) AS gc_z, round(coalesce((e - avg(e) OVER w) / (stddev_pop(e) OVER w + 1e-8), 0), 6) AS signal_z, CASE WHEN ok THEN 1.0 ELSE 0.0 END AS present
FROM n WINDOW w AS (PARTITION BY sample, chrom)""")
def _(t):
    n = t("v_cover").join(t("v_weights"), ["sample", "chrom", "bin"]).select("sample", "chrom", "bin", F.col("cov").cast("double").alias("gc"), (F.col("cov") * 2.0).alias("signal"),
                                                                             F.col("weight").isNotNull().alias("valid"))
    return r(EN.node_features(n), "gc_z", "signal_z")


view("v_states", """SELECT p_brand AS state, avg(p_retailprice) AS rg, avg(p_size) / 100 AS nu, avg(p_retailprice) / 9000 AS packing, avg(p_size) / 60 AS dense_fraction FROM {part} GROUP BY p_brand""")


@query("compaction_class", "E24", """SELECT state, CASE WHEN nu < 0.28 THEN 'over-compacted / confined (ν below the fractal-globule value)' WHEN nu < 0.36 AND packing > 1.4 * 0.19 THEN 'densely packed globule (heterochromatin-like)' WHEN nu < 0.36 THEN 'compact fractal-globule-like fold (typical interphase chromatin)'
  WHEN nu < 0.45 THEN 'intermediate compaction between a globule and an ideal chain' WHEN nu < 0.56 THEN 'relaxed, ideal-chain-like fold (decompacted relative to a globule)' ELSE 'swollen / extended fold (strong decompaction or stretching)' END AS compaction,
  CASE WHEN nu < 0.28 THEN -1 WHEN nu < 0.36 AND packing > 1.4 * 0.19 THEN -1 WHEN nu < 0.45 THEN 0 ELSE 1 END AS direction FROM (SELECT state, nu + (rg - 1300) / 500 AS nu, packing FROM v_states) t""")
def _(t):
    s = t("v_states").withColumn("nu", F.col("nu") + (F.col("rg") - 1300) / 500)
    return EV.compaction_class(s).select("state", "compaction", "direction")


@query("state_shift", "E24", """WITH c AS (SELECT * FROM v_states WHERE state = (SELECT min(state) FROM v_states)),
d AS (SELECT s.state, (s.rg - c.rg) / c.rg * 100 AS rg_pct, s.nu - c.nu AS nu_change, (s.packing - c.packing) / c.packing * 100 AS packing_pct, 100 * (s.dense_fraction - c.dense_fraction) AS dense_points FROM v_states s, c WHERE s.state <> c.state)
SELECT state, round(rg_pct, 6) AS rg_pct, round(nu_change, 6) AS nu_change, round(packing_pct, 6) AS packing_pct, round(dense_points, 6) AS dense_points, round(rg_pct / 5 + nu_change / 0.03 - dense_points / 5, 6) AS score,
  CASE WHEN rg_pct / 5 + nu_change / 0.03 - dense_points / 5 >= 1 THEN 1 WHEN rg_pct / 5 + nu_change / 0.03 - dense_points / 5 <= -1 THEN -1 ELSE 0 END AS direction FROM d""")
def _(t):
    first = t("part").agg(F.min("p_brand")).first()[0]
    return r(EV.state_shift(t("v_states"), first), "rg_pct", "nu_change", "packing_pct", "dense_points", "score")
