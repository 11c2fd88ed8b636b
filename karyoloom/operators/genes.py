"""Genes: lookup, labels, hubs, accessibility, expression agreement, feature rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..core import cut, idiv
from ..functions.groups import runs
from ..functions.intervals import overlaps, points_in_intervals
from ..functions.ranks import count_below, spearman, top_k
from ..functions.stats import zscore
from .structures import local_density, neighbor_pairs

BUNDLE = 64                      # genes of a bead that travel in one row
# fixed values: readings of accessibility
OPEN, MIDDLE, BURIED = "Hyper-accessible (predicted active)", "Intermediate", "Buried (predicted silenced)"
# fixed values: curated symbols that are flagged
CANCER_GENES = """
ABL1 AKT1 ALK APC AR ARID1A ASXL1 ATM ATR BAP1 BCL2 BCL6 BCR BRAF BRCA1 BRCA2 CALR CCND1 CDH1 CDK4 CDKN2A
CDKN2B CHEK2 CIC CREBBP CTNNB1 DNMT3A EGFR EP300 ERBB2 ESR1 ETV6 EWSR1 EZH2 FGFR1 FGFR2 FGFR3 FLI1 FLT3
FOXA1 GATA3 HRAS IDH1 IDH2 JAK2 KDM6A KEAP1 KIT KMT2A KRAS LZTR1 MAP2K1 MDM2 MET MLH1 MN1 MPL MSH2 MSH6
MYC MYCN NF1 NF2 NFE2L2 NOTCH1 NPM1 NRAS PAX3 PAX7 PDGFB PDGFRA PIK3CA PMS2 POLE PTCH1 PTEN RB1 RET RUNX1
SF3B1 SMAD4 SMARCA4 SMARCB1 SMO SOX2 SRSF2 STK11 SUFU TERT TET2 TP53 TSC1 TSC2 U2AF1 VHL WT1
""".split()
NEURO_GENES = """
APOE APP ATP13A2 C9orf72 COMT DNAJC6 FUS GBA1 HTT LRRK2 MAPT PARK7 PINK1 PRKN PSEN1 PSEN2 SNCA SOD1
SYNJ1 TARDBP TBX1 VPS35
""".split()


def curated(spark: SparkSession) -> DataFrame:
    """(gene, category) of the curated lists: a fixed table."""
    return spark.createDataFrame([(g, "cancer") for g in CANCER_GENES] + [(g, "neuro") for g in NEURO_GENES], "gene string, category string")


def in_regions(genes: DataFrame, regions: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Genes (by, start, end, ...) overlapping each region (region, by, r_start, r_end)."""
    return overlaps(regions, genes, list(by), ("r_start", "r_end"), ("start", "end"))


def find(genes: DataFrame, symbols: DataFrame, name: str = "name") -> DataFrame:
    """Gene per query symbol: exact match ignoring case, else the only gene that starts with it. Prefixes meet through their
    first three letters or, for shorter queries, their own length."""
    q = symbols.select("query", F.upper(F.trim("query")).alias("_q")).filter(F.length("_q") > 0).distinct()
    g = genes.withColumn("_n", F.upper(name))
    exact = top_k(q.join(g, F.col("_q") == F.col("_n")).drop("_n"), ["_q"], [F.asc("chrom"), F.asc("start")], 1).drop("rank")
    rest = q.join(exact.select("_q").distinct(), "_q", "left_anti")
    keyed = g.withColumn("_k", F.explode(F.expr("array_distinct(transform(sequence(1, 3), k -> left(_n, k)))")))
    hit = rest.withColumn("_k", F.expr("left(_q, 3)")).join(keyed, "_k").filter(F.startswith("_n", "_q")).drop("_k", "_n")
    one = hit.groupBy("_q").agg(F.count(F.lit(1)).alias("_c")).filter("_c = 1").select("_q")
    return exact.unionByName(hit.join(one, "_q")).drop("_q")


def labels_per_bin(genes: DataFrame, resolution: int, max_names: int = 2, by: list[str] = ("chrom",)) -> DataFrame:
    """'A, B +2' for every bin with genes, in order of start then name."""
    by = list(by)
    b = genes.withColumn("bin", F.explode(F.sequence(idiv("start", resolution), idiv(F.col("end") - 1, resolution))))
    total = b.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_n"))
    first = top_k(b, [*by, "bin"], [F.asc("start"), F.asc("name")], max_names, "_k")
    names = first.groupBy(*by, "bin").agg(F.array_sort(F.collect_list(F.struct("_k", "name"))).alias("_l"))      # at most max_names
    more = F.when(F.col("_n") > max_names, F.concat(F.lit(" +"), F.col("_n") - max_names)).otherwise("")
    return names.join(total, [*by, "bin"]).select(*by, "bin", F.concat(F.array_join(F.transform("_l", lambda s: s["name"]), ", "), more).alias("label"))


def annotate_loci(loci: DataFrame, peaks: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Forward, reverse and unoriented peaks with their centre in each locus (by, locus, start, end); peaks (by, mid, strand)
    are counted per position before they meet the loci."""
    p = peaks.groupBy(*by, "mid").agg(*[F.count_if(F.col("strand") == s).alias(f"_{n}") for n, s in (("f", 1), ("r", -1), ("u", 0))])
    c = points_in_intervals(p, loci, list(by), "mid").groupBy(*by, "locus").agg(F.sum("_f").alias("fwd"), F.sum("_r").alias("rev"), F.sum("_u").alias("unk"))
    return loci.join(c, [*by, "locus"], "left").na.fill(0, ["fwd", "rev", "unk"])


def signal_hubs(track: DataFrame, pct: float = 97.0, gap: int = 2, min_len: int = 2, by: list[str] = ("chrom",)) -> DataFrame:
    """Runs of bins whose 5-bin mean reaches the percentile of valid bins (track: by, bin, value, valid; complete bins),
    at most `gap` bins apart and at least min_len long, strongest first."""
    by = list(by)
    at = W.partitionBy(*by).orderBy("bin").rowsBetween(-2, 2)
    d = track.withColumn("_e", F.when(F.col("valid") & F.col("value").isNotNull(), F.col("value")).otherwise(0.0)).withColumn("smooth", F.sum("_e").over(at) / 5)
    thr = d.filter("valid").groupBy(*by).agg(F.percentile("smooth", F.lit(pct / 100)).alias("_thr"))
    hot = d.join(thr, by).filter(F.col("valid") & (F.col("smooth") >= F.col("_thr")))
    r = runs(hot.select(*by, "bin"), by, "bin", gap, min_len).select(*by, "start", "end")
    peak = points_in_intervals(d.select(*by, "bin", "_e"), r, by, "bin").groupBy(*by, "start", "end").agg(F.max("_e").alias("peak"))
    return peak.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("peak"), "start")))


def bead_scores(beads: DataFrame, b0: float, by: list[str] = ("structure",)) -> DataFrame:
    """Crowding (5-bead mean, edges repeated), openness, activity and their mean per bead (beads carry signal and valid)."""
    by = list(by)
    d = local_density(beads, 1.5 * b0, by=by).withColumn("density", F.col("density").cast("double"))
    at = W.partitionBy(*by).orderBy("bead")
    whole = at.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ends = (F.first("density").over(whole), F.last("density").over(whole))
    side = lambda k: F.coalesce(F.lag("density", -k).over(at), ends[0] if k < 0 else ends[1])                     # noqa: E731
    d = d.withColumn("crowding", sum((side(k) for k in (-2, -1, 1, 2)), F.col("density")) / 5)
    d = d.withColumns({"_c": F.when(F.col("valid"), F.col("crowding")), "_s": F.when(F.col("valid"), F.log1p(F.greatest("signal", F.lit(0.0))))})
    use = F.count("_s").over(W.partitionBy(*by)) >= 10
    d = d.withColumns({"openness": F.coalesce(-zscore("_c", by), F.lit(0.0)), "activity": F.when(use, F.coalesce(zscore("_s", by), F.lit(0.0))).otherwise(0.0), "_use": use})
    score = F.when(F.col("_use"), (F.col("openness") + F.col("activity")) / 2).otherwise(F.col("openness"))
    return d.withColumn("score", F.when(F.col("valid"), score)).drop("_c", "_s", "_use", "density")


def status(score) -> F.Column:
    return F.when(score >= 0.5, OPEN).when(score <= -0.5, BURIED).otherwise(MIDDLE)


def accessibility_table(genes: DataFrame, scores: DataFrame, windows: DataFrame, resolution: int, categories: DataFrame,
                        expression: DataFrame | None = None, by: list[str] = ("structure",)) -> DataFrame:
    """One row per gene whose TSS lies in the window of a structure (by, chrom, first_bin, beads): bead, rounded scores,
    status, category, expression by upper-case symbol, and the rank by score with missing scores last."""
    by = list(by)
    spans = windows.withColumn("_last", F.col("first_bin") + F.col("beads"))
    g = points_in_intervals(genes.withColumn("_bin", idiv("tss", resolution)), spans, ["chrom"], "_bin", "first_bin", "_last")
    g = g.withColumn("bead", F.col("_bin") - F.col("first_bin")).drop("_last")
    s = scores.select(*by, "bead", F.round("crowding", 2).alias("crowding"), F.round("signal", 3).alias("signal"), F.round("score", 3).alias("score"))
    t = g.join(s, [*by, "bead"]).join(categories.withColumnRenamed("gene", "name"), "name", "left")
    t = t.select(*by, F.col("name").alias("gene"), F.format_string("%s:%s", "chrom", F.format_number(F.col("tss") + 1, 0)).alias("locus"), "bead", "biotype",
                 F.coalesce("category", F.lit("")).alias("category"), "crowding", "signal", "score", status(F.col("score")).alias("status"), F.upper("name").alias("_u"))
    if expression is not None:
        t = t.join(expression.groupBy(F.upper("gene").alias("_u")).agg(F.min_by("value", "row_no").alias("expression")), "_u", "left")
    else:
        t = t.withColumn("expression", F.lit(None).cast("double"))
    return t.drop("_u")


def accessibility_summary(table: DataFrame, by: list[str] = ("structure",)) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s)                                                                # noqa: E731
    return table.groupBy(*by).agg(F.count(F.lit(1)).alias("genes"), n(OPEN).alias("open"), n(MIDDLE).alias("intermediate"), n(BURIED).alias("buried"),
                                  F.count_if(F.col("category") != "").alias("flagged"))


def accessibility_extremes(table: DataFrame, k: int = 8, by: list[str] = ("structure",)) -> DataFrame:
    """The k most open and k most buried genes."""
    o = top_k(table.filter(F.col("status") == OPEN), list(by), [F.desc("score"), F.asc("gene")], k)
    b = top_k(table.filter(F.col("status") == BURIED), list(by), [F.asc("score"), F.asc("gene")], k)
    return o.unionByName(b).select(*by, "status", "rank", "gene", "score")


def expression_agreement(table: DataFrame, by: list[str] = ("structure",)) -> DataFrame:
    """Rank correlation of score and log1p expression, NULL below 20 genes."""
    return spearman(table.withColumn("_e", F.log1p(F.greatest("expression", F.lit(0.0)))), list(by), "score", "_e", 20)


def touching_pairs(gene_beads: DataFrame, beads: DataFrame, b0: float, resolution: int, by: list[str] = ("structure",)) -> DataFrame:
    """Gene pairs whose promoters are closer than 2 b0, nearest beads first joined in space, then named. Genes on one bead
    touch at distance 0."""
    by = list(by)
    # a bead carries its genes in bundles through the search; a pair of beads is never shuffled
    here = gene_beads.select(*by, "bead", F.struct("gene").alias("_g"))
    count = gene_beads.groupBy(*by, "bead").agg(F.ceil(F.count(F.lit(1)) / BUNDLE).cast("bigint").alias("_k"))
    bundle = F.pmod(F.xxhash64("_g"), F.col("_k"))
    bundles = here.join(count, [*by, "bead"]).groupBy(*by, "bead", bundle.alias("_k")).agg(F.collect_list("_g").alias("_genes")).drop("_k")
    near = neighbor_pairs(beads.join(bundles, [*by, "bead"]), 2 * b0, 1, by, ["_genes"])
    p = (near.select(*by, "i", "j", "d", F.explode("_genes_i").alias("g1"), "_genes_j")
         .select(*by, "i", "j", "d", F.col("g1.gene").alias("g1"), F.explode("_genes_j").alias("g2")).withColumn("g2", F.col("g2.gene")))
    side = lambda n: gene_beads.select(*by, "bead", F.col("gene").alias(n))                    # noqa: E731
    own = beads.select(*by, "bead").join(side("g1"), [*by, "bead"]).join(side("g2"), [*by, "bead"]).filter("g1 < g2").select(
        *by, F.col("bead").alias("i"), F.col("bead").alias("j"), F.lit(0.0).alias("d"), "g1", "g2")
    return p.unionByName(own).select(*by, F.least("g1", "g2").alias("gene_a"), F.greatest("g1", "g2").alias("gene_b"), "d",
                                     ((F.col("j") - F.col("i")) * resolution / 1e6).alias("apart_mb"))


def neighbours_within(genes: DataFrame, reach: int = 250_000, by: list[str] = ("chrom",)) -> DataFrame:
    """Other genes whose TSS lies within `reach`: the running count of TSS at the upper end of the reach less that below its
    lower end, so no pair of genes is made."""
    by = list(by)
    placed = genes.filter(F.col("tss").isNotNull()).select(*by, "tss")
    low, high = F.col("tss") - reach, F.col("tss") + reach + 1
    below = cut(count_below(placed.select(*by, F.explode(F.array(low, high)).alias("_at")), placed, by, "_at", "tss", "_below"))
    side = lambda k: below.select(*by, F.col("_at").alias(f"_at{k}"), F.col("_below").alias(f"_{k}"))             # noqa: E731
    c = placed.distinct().withColumns({"_atlow": low, "_athigh": high}).join(side("low"), [*by, "_atlow"]).join(side("high"), [*by, "_athigh"])
    k = c.select(*by, "tss", (F.col("_high") - F.col("_low") - 1).alias("neighbours"))
    return genes.join(k, [*by, "tss"])


def feature_rows(genes: DataFrame, bins: DataFrame, bounds: DataFrame, oe: DataFrame, resolution: int, window_bp: int, by: list[str] = ("sample", "chrom")) -> DataFrame:
    """Feature row per gene: compartment, insulation, z of log coverage, log distance to the nearest boundary, gene density,
    local log2 O/E within 10 bins, strand-aware insulation slope, and expression. Rows with a missing feature are left out.
    bins: (by, bin, compartment, insulation, cov); oe: (by, bin, local_oe); genes carry tss, strand, tpm and neighbours. Genes
    without some column of `by` (the sample) stand in every map that agrees in the others and has their bin."""
    by = list(by)
    cov = F.when(F.col("cov") > 0, F.log1p("cov"))
    w = W.partitionBy(*by)
    at = w.orderBy("bin")
    b = bins.withColumn("_lc", cov).withColumn("coverage", (F.col("_lc") - F.avg("_lc").over(w)) / F.coalesce(F.nullif(F.stddev_pop("_lc").over(w), F.lit(0.0)), F.lit(1.0)))
    b = b.withColumn("_up", F.lead("insulation", 5).over(at) - F.lag("insulation", 5).over(at))
    # nearest boundary on either side, over the bins of one map
    b = b.join(bounds.select(*by, "bin", F.col("bin").alias("_b")), [*by, "bin"], "left")
    left = F.last("_b", ignorenulls=True).over(at.rowsBetween(W.unboundedPreceding, 0))
    right = F.first("_b", ignorenulls=True).over(at.rowsBetween(0, W.unboundedFollowing))
    b = b.withColumns({"_l": left, "_r": right})
    gap = F.least(F.col("bin") - F.col("_l"), F.col("_r") - F.col("bin")) * resolution
    b = b.withColumn("log_dist_boundary", F.log10(F.coalesce(gap, F.lit(window_bp)) + resolution)).filter(F.col("cov") > 0)
    own = [c for c in by if c in genes.columns]
    g = genes.withColumn("bin", idiv("tss", resolution)).join(b.join(oe, [*by, "bin"]), [*own, "bin"])
    g = g.withColumns({"gene_density": F.log1p("neighbours"), "insulation_slope": F.when(F.col("strand") == "+", F.col("_up")).otherwise(-F.col("_up"))})
    cols = ["compartment", "insulation", "coverage", "log_dist_boundary", "gene_density", "local_oe", "insulation_slope", "tpm"]
    return g.select(*by, "name", "tss", *cols).dropna(subset=cols)


def local_enrichment(contacts: DataFrame, sizes: DataFrame, reach: int = 10, by: list[str] = ("sample", "chrom")) -> DataFrame:
    """Mean over the neighbours within `reach` bins of log2((count + 1) / (diagonal mean + 1)), absent pixels counting 0."""
    from .maps import expected, mirrored
    by = list(by)
    e = expected(contacts, sizes, by).filter(F.col("d").between(1, reach))
    grid = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))
    offs = F.array(*[F.lit(k).cast("long") for k in range(-reach, reach + 1) if k])
    grid = grid.withColumn("_off", F.explode(offs)).withColumn("partner", F.col("bin") + F.col("_off")).drop("_off").filter((F.col("partner") >= 0) & (F.col("partner") < F.col("n")))
    m = mirrored(contacts.filter((F.col("j") - F.col("i")).between(1, reach)), by)
    v = grid.join(m, [*by, "bin", "partner"], "left").withColumn("d", F.abs(F.col("bin") - F.col("partner"))).join(e, [*by, "d"])
    return v.groupBy(*by, "bin").agg(F.avg(F.log2((F.coalesce("cnt", F.lit(0.0)) + 1) / (F.col("expected") + 1))).alias("local_oe"))


def annotate(genes: DataFrame, categories: DataFrame, pathogenic: DataFrame, name: str = "name") -> DataFrame:
    """Curated list and pathogenic allele count, for genes that have either."""
    g = genes.select(F.col(name).alias("gene")).distinct()
    j = g.join(categories, "gene", "left").join(pathogenic, "gene", "left")
    return j.filter(F.col("category").isNotNull() | F.col("alleles").isNotNull())
