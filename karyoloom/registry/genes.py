"""Genes, liftover and sequence."""

from pyspark.sql import functions as F

from ..operators import compartments as COMP, domains as D, genes as G, liftover as L, sequence as Q
from .base import query, view
from .maps import r

view("v_gene_regions", "SELECT concat('g', cast(s_suppkey AS varchar(9))) AS region, concat('chr', cast(1 + s_nationkey % 5 AS varchar(9))) AS chrom, s_suppkey * 15000 AS r_start, s_suppkey * 15000 + 120000 AS r_end FROM {supplier}")
view("v_symbols", "SELECT DISTINCT CASE WHEN p_size > 25 THEN lower(p_name) ELSE substr(p_name, 1, 3 + p_size % 9) END AS query FROM {part}")


@query("lift_positions", "D1", """SELECT o.id, chrom, pos, q_chrom, CASE WHEN q_strand = '+' THEN q_start + pos - t_start ELSE q_size - (q_start + pos - t_start) - 1 END AS q_pos, q_strand
FROM (SELECT id, chrom, start AS pos FROM v_lift) o LEFT JOIN v_blocks b USING (chrom) WHERE false OR (b.t_start <= pos AND pos < b.t_end)
UNION ALL SELECT id, chrom, start, NULL, NULL, NULL FROM v_lift o WHERE NOT EXISTS (SELECT 1 FROM v_blocks b WHERE b.chrom = o.chrom AND b.t_start <= o.start AND o.start < b.t_end)""")
def _(t):
    return L.lift_positions(t("v_lift").select("id", "chrom", F.col("start").alias("pos")), t("v_blocks")).select("id", "chrom", "pos", "q_chrom", "q_pos", "q_strand")


MAPPED = """m AS (SELECT p.chrom, p.pos, q_chrom, q_strand, CASE WHEN q_strand = '+' THEN q_start + p.pos - t_start ELSE q_size - (q_start + p.pos - t_start) - 1 END AS q_pos
  FROM (SELECT chrom, start AS pos FROM v_lift UNION SELECT chrom, "end" - 1 FROM v_lift UNION SELECT chrom, start + 4000 FROM v_lift UNION SELECT chrom, "end" + 3999 FROM v_lift) p
  JOIN v_blocks b ON p.chrom = b.chrom AND t_start <= p.pos AND p.pos < t_end)"""
SPAN = """CASE WHEN {a}.q_chrom = {z}.q_chrom AND {a}.q_strand = {z}.q_strand AND abs(greatest({a}.q_pos, {z}.q_pos) + 1 - least({a}.q_pos, {z}.q_pos) - (e - s)) <= 0.5 * (e - s) THEN {v} END"""


@query("lift_intervals", "D2", f"""WITH {MAPPED} SELECT id, l.chrom, s AS start, e AS "end", {SPAN.format(a='a', z='z', v='a.q_chrom')} AS q_chrom, {SPAN.format(a='a', z='z', v='least(a.q_pos, z.q_pos)')} AS q_start,
  {SPAN.format(a='a', z='z', v='greatest(a.q_pos, z.q_pos) + 1')} AS q_end FROM (SELECT id, chrom, start AS s, "end" AS e FROM v_lift) l
LEFT JOIN m a ON a.chrom = l.chrom AND a.pos = s LEFT JOIN m z ON z.chrom = l.chrom AND z.pos = e - 1""")
def _(t):
    return L.lift_intervals(t("v_lift"), t("v_blocks"))


@query("lift_pairs", "D2", f"""WITH {MAPPED}, x AS (SELECT id, l.chrom, s, e, {SPAN.format(a='a', z='z', v='a.q_chrom')} AS q1, {SPAN.format(a='b', z='y', v='b.q_chrom')} AS q2, least(a.q_pos, z.q_pos) AS s1, least(b.q_pos, y.q_pos) AS s2
  FROM (SELECT id, chrom, start AS s, "end" AS e FROM v_lift) l LEFT JOIN m a ON a.chrom = l.chrom AND a.pos = s LEFT JOIN m z ON z.chrom = l.chrom AND z.pos = e - 1
  LEFT JOIN m b ON b.chrom = l.chrom AND b.pos = s + 4000 LEFT JOIN m y ON y.chrom = l.chrom AND y.pos = e + 3999)
SELECT id, CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN q1 END AS q1_chrom, CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN s1 END AS q1_start,
  CASE WHEN q1 IS NOT NULL AND q2 IS NOT NULL THEN s2 END AS q2_start FROM x""")
def _(t):
    v = t("v_lift")
    p = v.select("id", F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), F.col("end").alias("end1"), F.col("chrom").alias("chrom2"), (F.col("start") + 4000).alias("start2"), (F.col("end") + 4000).alias("end2"))
    return L.lift_pairs(p, t("v_blocks")).select("id", "q1_chrom", "q1_start", "q2_start")


@query("genes_in_regions", "D4", "SELECT region, g.name, g.gene_id FROM v_gene_regions r JOIN v_genes g ON g.chrom = r.chrom AND g.start < r_end AND g.\"end\" > r_start")
def _(t):
    return G.in_regions(t("v_genes"), t("v_gene_regions")).select("region", "name", "gene_id")


@query("genes_on_chromosome", "D4", "SELECT name, gene_id, start, \"end\", strand, tss FROM v_genes WHERE chrom = 'chr1'")
def _(t):
    return t("v_genes").filter("chrom = 'chr1'").select("name", "gene_id", "start", "end", "strand", "tss")


@query("find_genes", "D4", """WITH q AS (SELECT query, upper(trim(query)) AS q FROM v_symbols), e AS (SELECT query, q, gene_id, row_number() OVER (PARTITION BY q ORDER BY chrom, start) AS k FROM q JOIN v_genes ON upper(name) = q),
p AS (SELECT query, q, gene_id FROM q JOIN v_genes ON starts_with(upper(name), q) WHERE q NOT IN (SELECT q FROM e))
SELECT query, gene_id FROM e WHERE k = 1 UNION ALL SELECT query, gene_id FROM p WHERE q IN (SELECT q FROM p GROUP BY q HAVING count(*) = 1)""")
def _(t):
    return G.find(t("v_genes"), t("v_symbols")).select("query", "gene_id")


@query("gene_labels", "D5", """WITH b AS (SELECT chrom, name, start, unnest(generate_series(start // 20000, ("end" - 1) // 20000)) AS bin FROM v_genes),
k AS (SELECT *, row_number() OVER (PARTITION BY chrom, bin ORDER BY start, name) AS k, count(*) OVER (PARTITION BY chrom, bin) AS n FROM b)
SELECT chrom, bin, concat(string_agg(name, ', ' ORDER BY k), CASE WHEN max(n) > 2 THEN concat(' +', max(n) - 2) ELSE '' END) AS label FROM k WHERE k <= 2 GROUP BY chrom, bin""")
def _(t):
    return G.labels_per_bin(t("v_genes"), 20_000)


@query("annotate_loci", "D6", """SELECT g.chrom, g.region AS locus, count(*) FILTER (s = 1) AS fwd, count(*) FILTER (s = -1) AS rev, count(*) FILTER (s = 0) AS unk
FROM (SELECT region, chrom, r_start, r_end FROM v_gene_regions) g LEFT JOIN (SELECT chrom, tss AS mid, CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS s FROM v_genes JOIN part ON p_partkey = gene_id) p
ON p.chrom = g.chrom AND mid >= r_start AND mid < r_end GROUP BY g.chrom, g.region""")
def _(t):
    peaks = t("v_genes").join(t("part"), F.col("p_partkey") == F.col("gene_id")).select("chrom", F.col("tss").alias("mid"), F.expr("CASE p_size % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END").alias("strand"))
    loci = t("v_gene_regions").select("chrom", F.col("region").alias("locus"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    return G.annotate_loci(loci, peaks).select("chrom", "locus", "fwd", "rev", "unk")


@query("signal_hubs", "D7, G4", """WITH d AS (SELECT c.sample, c.chrom, c.bin, weight IS NOT NULL AS ok, CASE WHEN weight IS NOT NULL THEN cov ELSE 0 END AS e FROM v_cover c JOIN v_weights USING (sample, chrom, bin)),
s AS (SELECT *, sum(e) OVER (PARTITION BY sample, chrom ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5.0 AS sm FROM d),
h AS (SELECT s.* FROM s JOIN (SELECT sample, chrom, quantile_cont(sm, 0.8) AS t FROM s WHERE ok GROUP BY ALL) q USING (sample, chrom) WHERE ok AND sm >= t),
g AS (SELECT *, sum(CASE WHEN bin - pb > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY sample, chrom ORDER BY bin) AS k FROM (SELECT *, lag(bin) OVER (PARTITION BY sample, chrom ORDER BY bin) AS pb FROM h) q),
r AS (SELECT sample, chrom, min(bin) AS start, max(bin) + 1 AS "end" FROM g GROUP BY sample, chrom, k HAVING count(*) >= 2)
SELECT r.sample, r.chrom, start, "end", max(e) AS peak, row_number() OVER (PARTITION BY r.sample, r.chrom ORDER BY max(e) DESC, start) AS rank
FROM r JOIN d ON d.sample = r.sample AND d.chrom = r.chrom AND d.bin >= start AND d.bin < "end" GROUP BY r.sample, r.chrom, start, "end\"""")
def _(t):
    track = t("v_cover").join(t("v_weights"), ["sample", "chrom", "bin"]).select("sample", "chrom", "bin", F.col("cov").cast("double").alias("value"), F.col("weight").isNotNull().alias("valid"))
    return G.signal_hubs(track, 80.0, by=["sample", "chrom"])


D2 = "pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)"
SCORES = f"""den AS (SELECT v.structure, v.bead, v.signal, v.signal > -0.25 AS ok, cast(count(n.j) AS DOUBLE) AS d FROM v_beads v LEFT JOIN (SELECT a.structure, a.bead AS i, b.bead AS j FROM v_beads a JOIN v_beads b
    ON a.structure = b.structure AND abs(a.bead - b.bead) >= 2 AND sqrt({D2}) < 150) n ON n.structure = v.structure AND n.i = v.bead GROUP BY ALL),
cr AS (SELECT *, (coalesce(lag(d, 2) OVER w, first_value(d) OVER f) + coalesce(lag(d) OVER w, first_value(d) OVER f) + d + coalesce(lead(d) OVER w, last_value(d) OVER f) + coalesce(lead(d, 2) OVER w, last_value(d) OVER f)) / 5 AS c,
    ln(1 + greatest(signal, 0)) AS ls FROM den WINDOW w AS (PARTITION BY structure ORDER BY bead), f AS (PARTITION BY structure ORDER BY bead ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
zz AS (SELECT *, CASE WHEN ok THEN -(c - avg(c) FILTER (ok) OVER p) / nullif(stddev_pop(c) FILTER (ok) OVER p, 0) ELSE 0 END AS op,
    CASE WHEN ok THEN (ls - avg(ls) FILTER (ok) OVER p) / nullif(stddev_pop(ls) FILTER (ok) OVER p, 0) ELSE 0 END AS ac FROM cr WINDOW p AS (PARTITION BY structure)),
sc AS (SELECT structure, bead, signal, c AS crowding, op + 0.0 AS openness, ac AS activity, CASE WHEN ok THEN (op + ac) / 2 END AS score FROM zz)"""


def scores(t):
    return G.bead_scores(t("v_beads").withColumn("valid", F.col("signal") > -0.25), 100.0)


@query("bead_scores", "D8", f"WITH {SCORES} SELECT structure, bead, round(crowding, 6) AS crowding, round(openness, 6) + 0.0 AS openness, round(activity, 6) + 0.0 AS activity, round(score, 6) + 0.0 AS score FROM sc")
def _(t):
    s = r(scores(t), "crowding", "openness", "activity", "score")
    return s.select("structure", "bead", "crowding", *[(F.col(c) + 0.0).alias(c) for c in ("openness", "activity", "score")])


view("v_gene_windows", "SELECT structure, concat('chr', CASE WHEN count(*) % 2 = 0 THEN '1' ELSE '2' END) AS chrom, cast(3 AS bigint) AS first_bin, count(*) AS beads FROM {v_beads} GROUP BY structure")
view("v_categories", "SELECT DISTINCT p_name AS gene, CASE WHEN p_type LIKE 'LARGE%' THEN 'cancer' ELSE 'neuro' END AS category FROM {part}")
view("v_category", "SELECT gene, min(category) AS category FROM {v_categories} GROUP BY gene")
TABLE = f"""{SCORES}, tab AS (SELECT w.structure, g.name AS gene, tss, tss // 20000 - first_bin AS bead, biotype, coalesce(c.category, '') AS category, round(crowding, 2) AS crowding, round(s.signal, 3) AS signal, round(score, 3) AS score,
    CASE WHEN round(score, 3) >= 0.5 THEN 'Hyper-accessible (predicted active)' WHEN round(score, 3) <= -0.5 THEN 'Buried (predicted silenced)' ELSE 'Intermediate' END AS status, x.value AS expression
  FROM v_genes g JOIN v_gene_windows w ON g.chrom = w.chrom AND tss // 20000 >= first_bin AND tss // 20000 < first_bin + beads JOIN sc s ON s.structure = w.structure AND s.bead = tss // 20000 - first_bin
  LEFT JOIN v_category c ON c.gene = g.name LEFT JOIN (SELECT upper(gene) AS u, arg_min(value, row_no) AS value FROM v_expression GROUP BY ALL) x ON x.u = upper(g.name))"""


def table(t):
    return G.accessibility_table(t("v_genes"), scores(t), t("v_gene_windows"), 20_000, t("v_category"), t("v_expression"))


@query("accessibility_table", "D9", f"WITH {TABLE} SELECT structure, gene, bead, biotype, category, crowding, signal, score, status, expression FROM tab")
def _(t):
    return table(t).drop("locus")


@query("accessibility_summary", "D10", f"""WITH {TABLE} SELECT structure, count(*) AS genes, count(*) FILTER (status LIKE 'Hyper%') AS open, count(*) FILTER (status = 'Intermediate') AS intermediate,
  count(*) FILTER (status LIKE 'Buried%') AS buried, count(*) FILTER (category <> '') AS flagged FROM tab GROUP BY structure""")
def _(t):
    return G.accessibility_summary(table(t))


@query("accessibility_extremes", "D10", f"""WITH {TABLE} SELECT structure, status, rank, gene, score FROM (SELECT *, row_number() OVER (PARTITION BY structure, status ORDER BY CASE WHEN status LIKE 'Hyper%' THEN -score ELSE score END, gene) AS rank
  FROM tab WHERE status <> 'Intermediate') q WHERE rank <= 8""")
def _(t):
    return G.accessibility_extremes(table(t))


@query("expression_agreement", "D11, G5", f"""WITH {TABLE}, k AS (SELECT structure, rank() OVER (PARTITION BY structure ORDER BY score) + (count(*) OVER (PARTITION BY structure, score) - 1) / 2.0 AS a,
  rank() OVER (PARTITION BY structure ORDER BY expression) + (count(*) OVER (PARTITION BY structure, expression) - 1) / 2.0 AS b FROM tab WHERE score IS NOT NULL AND expression IS NOT NULL)
SELECT structure, count(*) AS n, CASE WHEN count(*) >= 20 THEN round(corr(a, b), 6) END AS rho FROM k GROUP BY structure""")
def _(t):
    return r(G.expression_agreement(table(t)), "rho")


@query("touching_gene_pairs", "D12", f"""WITH g AS (SELECT w.structure, g.gene_id AS gene, tss // 20000 - first_bin AS bead FROM v_genes g JOIN v_gene_windows w ON g.chrom = w.chrom AND tss // 20000 >= first_bin AND tss // 20000 < first_bin + beads)
SELECT p.structure, least(p.gene, q.gene) AS gene_a, greatest(p.gene, q.gene) AS gene_b, round(sqrt({D2}), 6) AS d, round(abs(p.bead - q.bead) * 20000 / 1e6, 6) AS apart_mb FROM g p JOIN g q ON p.structure = q.structure AND p.gene < q.gene
JOIN v_beads a ON a.structure = p.structure AND a.bead = p.bead JOIN v_beads b ON b.structure = q.structure AND b.bead = q.bead WHERE sqrt({D2}) < 120""")
def _(t):
    g = t("v_genes").withColumn("_b", F.floor(F.col("tss") / 20_000)).join(t("v_gene_windows"), "chrom").withColumn("bead", F.col("_b") - F.col("first_bin")).filter("bead >= 0 AND bead < beads")
    return r(G.touching_pairs(g.select("structure", F.col("gene_id").alias("gene"), "bead"), t("v_beads"), 60.0, 20_000), "d", "apart_mb")


@query("neighbouring_genes", "D13", "SELECT a.gene_id, count(*) - 1 AS neighbours FROM v_genes a JOIN v_genes b ON a.chrom = b.chrom AND abs(a.tss - b.tss) <= 250000 GROUP BY a.gene_id")
def _(t):
    return G.neighbours_within(t("v_genes")).select("gene_id", "neighbours")


@query("local_enrichment", "D13", """WITH e AS (SELECT sample, chrom, d, coalesce(s, 0) / (100 - d) AS e FROM (SELECT sample, chrom, unnest(generate_series(1, 10)) AS d FROM v_sizes) g LEFT JOIN (SELECT sample, chrom, j - i AS d, sum(cnt) AS s FROM v_contacts GROUP BY ALL) q USING (sample, chrom, d))
SELECT a.sample, a.chrom, a.bin, round(avg(log2((coalesce(c.cnt, 0) + 1) / (e + 1))), 6) AS local_oe FROM v_bins a JOIN v_bins b ON a.sample = b.sample AND a.chrom = b.chrom AND abs(a.bin - b.bin) BETWEEN 1 AND 10
JOIN e ON e.sample = a.sample AND e.chrom = a.chrom AND e.d = abs(a.bin - b.bin) LEFT JOIN v_contacts c ON c.sample = a.sample AND c.chrom = a.chrom AND c.i = least(a.bin, b.bin) AND c.j = greatest(a.bin, b.bin) GROUP BY ALL""")
def _(t):
    return r(G.local_enrichment(t("v_contacts"), t("v_sizes")), "local_oe")


@query("gene_features", "D13")
def _(t):
    c, s = t("v_contacts"), t("v_sizes")
    ins = D.insulation(c, s, 12).select("sample", "chrom", "bin", "insulation")
    ev = COMP.compartments(c, s).select("sample", "chrom", "bin", F.col("eigenvector").alias("compartment"))
    bins = ins.join(ev, ["sample", "chrom", "bin"]).join(t("v_cover").select("sample", "chrom", "bin", "cov"), ["sample", "chrom", "bin"])
    genes = G.neighbours_within(t("v_genes").withColumn("chrom", F.when(F.col("chrom") == "chr1", "chrA").when(F.col("chrom") == "chr2", "chrN").otherwise("chrR")))
    genes = genes.join(t("v_expression").select(F.col("row_no").alias("gene_id"), F.col("value").alias("tpm")), "gene_id")
    return r(G.feature_rows(genes, bins, t("v_grid_bounds"), G.local_enrichment(c, s), 20_000, 2_000_000),
             "compartment", "insulation", "coverage", "log_dist_boundary", "gene_density", "local_oe", "insulation_slope", digits=4)


@query("annotate_genes", "D14", """SELECT gene, category, alleles FROM (SELECT DISTINCT name AS gene FROM v_genes) g LEFT JOIN v_category USING (gene)
LEFT JOIN (SELECT p_name AS gene, count(*) AS alleles FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL) a USING (gene) WHERE category IS NOT NULL OR alleles IS NOT NULL""")
def _(t):
    path = (t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_name").alias("gene")).agg(F.count(F.lit(1)).alias("alleles")))
    return G.annotate(t("v_genes"), t("v_category"), path)


# whole texts read as bases: every letter stands for one of A, C, G, T, anything else is an uncalled base
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ACGT = "ACCAGTGCATTGCAACGTAGTCAGTC" * 2
view("v_sequence", f"""SELECT doc_id AS contig, s AS chunk_start, translate(substring(text, cast(s + 1 AS int), 500), '{LETTERS}', '{ACGT}') AS bases
FROM (SELECT doc_id, text, explode(sequence(cast(0 AS bigint), cast(length(text) - 1 AS bigint), cast(500 AS bigint))) AS s FROM {{documents}} WHERE length(text) > 0) t""",
     f"""SELECT doc_id AS contig, s AS chunk_start, translate(substring(text, s + 1, 500), '{LETTERS}', '{ACGT}') AS bases
FROM (SELECT doc_id, text, unnest(generate_series(cast(0 AS BIGINT), length(text) - 1, 500)) AS s FROM {{documents}} WHERE length(text) > 0) t""")
view("v_whole", f"SELECT doc_id AS contig, translate(text, '{LETTERS}', '{ACGT}') AS bases FROM {{documents}} WHERE length(text) > 0")
GCN = "length({0}) - length(translate({0}, 'GC', ''))"
ACN = "length({0}) - length(translate({0}, 'ACGT', ''))"


@query("gc_per_bin", "D15", f"""WITH b AS (SELECT contig, k AS bin, substring(bases, k * 170 + 1, 170) AS s FROM (SELECT *, unnest(generate_series(cast(0 AS BIGINT), (length(bases) - 1) // 170)) AS k FROM v_whole) t)
SELECT contig, bin, CASE WHEN c > 0 AND c >= 0.5 * n THEN round(g / c, 9) END AS gc, c > 0 AND c >= 0.5 * n AS valid FROM (SELECT contig, bin, {GCN.format('s')} AS g, {ACN.format('s')} AS c, length(s) AS n FROM b) q""")
def _(t):
    return r(Q.gc_per_bin(t("v_sequence"), 170), "gc", digits=9)


view("v_spans", "SELECT doc_id AS contig, cast(quality * 40 + toxic * 300 AS bigint) AS start, cast(quality * 40 + toxic * 300 + 750 AS bigint) AS end FROM {labels}",
     "SELECT doc_id AS contig, cast(quality * 40 + toxic * 300 AS bigint) AS start, cast(quality * 40 + toxic * 300 + 750 AS bigint) AS \"end\" FROM {labels}")


@query("gc_of_intervals", "D15", f"""SELECT contig, start, "end", CASE WHEN c > 0 THEN round(g / c, 9) END AS gc FROM (SELECT v.contig, start, "end", {GCN.format('s')} AS g, {ACN.format('s')} AS c
FROM (SELECT v.*, coalesce(substring(w.bases, start + 1, "end" - start), '') AS s FROM v_spans v LEFT JOIN v_whole w USING (contig)) v) q""")
def _(t):
    return r(Q.gc_of_intervals(t("v_spans"), t("v_sequence"), 500), "gc", digits=9)


MOTIF = [[9, 0, 1, 3, 2], [0, 8, 0, 3, 1], [1, 1, 9, 2, 0], [0, 1, 0, 2, 7]]
PWM = Q.log_odds(MOTIF)


def _duck_score(pwm):
    return " + ".join("CASE substring(win, %d, 1) %s END" % (k + 1, " ".join(f"WHEN '{b}' THEN '{row[k]!r}'::DOUBLE" for b, row in zip("ACGT", pwm))) for k in range(5))


_lo, _hi = sum(min(c) for c in zip(*PWM)), sum(max(c) for c in zip(*PWM))
_REV = [row[::-1] for row in PWM[::-1]]
BEST = f"round((greatest(max(f), max(v)) - ('{_lo!r}'::DOUBLE)) / '{_hi - _lo!r}'::DOUBLE, 6) AS score, CASE WHEN max(f) >= max(v) THEN 1 ELSE -1 END AS strand"


@query("motif_best_match", "D16", f"""WITH w AS (SELECT contig, substring(bases, p, 5) AS win FROM (SELECT *, unnest(generate_series(1, length(bases) - 4)) AS p FROM v_whole) t)
SELECT contig, {BEST} FROM (SELECT contig, {_duck_score(PWM)} AS f, {_duck_score(_REV)} AS v FROM w) q WHERE f IS NOT NULL GROUP BY contig""")
def _(t):
    return r(Q.scan_contigs(t("v_sequence"), PWM, 500), "score")


view("v_peaks", "SELECT concat('p', cast(doc_id AS varchar(12))) AS peak, doc_id AS contig, cast(quality * 90 + toxic * 200 + 450 AS bigint) AS start, cast(quality * 90 + toxic * 200 + 640 AS bigint) AS end, CASE WHEN toxic = 1 THEN 70 ELSE -1 END AS summit FROM {labels}",
     "SELECT concat('p', cast(doc_id AS varchar(12))) AS peak, doc_id AS contig, cast(quality * 90 + toxic * 200 + 450 AS bigint) AS start, cast(quality * 90 + toxic * 200 + 640 AS bigint) AS \"end\", CASE WHEN toxic = 1 THEN 70 ELSE -1 END AS summit FROM {labels}")


@query("orient_peaks", "D17", f"""WITH p AS (SELECT *, greatest(start, c - 60) AS lo, least("end", c + 60) AS hi FROM (SELECT *, CASE WHEN summit >= 0 THEN start + summit ELSE (start + "end") // 2 END AS c FROM v_peaks) t),
w AS (SELECT peak, substring(bases, s + 1, 5) AS win FROM (SELECT peak, contig, unnest(generate_series(lo, hi - 5)) AS s FROM p) t JOIN v_whole USING (contig) WHERE s + 5 <= length(bases)),
m AS (SELECT peak, {BEST} FROM (SELECT peak, {_duck_score(PWM)} AS f, {_duck_score(_REV)} AS v FROM w) q WHERE f IS NOT NULL GROUP BY peak)
SELECT p.peak, score, CASE WHEN score >= 0.8 THEN strand ELSE 0 END AS strand FROM v_peaks p LEFT JOIN m USING (peak)""")
def _(t):
    return r(Q.orient_peaks(t("v_peaks"), t("v_sequence"), PWM, 500, half_width=60), "score").select("peak", "score", "strand")
