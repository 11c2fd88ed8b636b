"""The analyses of a map as one set of tables that share their inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import MAP, cut
from ..operators import compartments, compare, domains, loops, maps
from ..sources import sinks


def analyze(contacts: DataFrame, sizes: DataFrame, resolution: int, window: int, weights: DataFrame | None = None, orient: DataFrame | None = None,
            call: bool = True, fdr: float = 0.1, by: list[str] = MAP, **loop_settings) -> dict[str, DataFrame]:
    """Insulation, boundaries (two callers), domain scores, compartments, P(s) and loops of every map, with bp coordinates."""
    by = list(by)
    contacts = cut(contacts)
    w = weights if weights is not None else maps.bins_of(sizes, by).select(*by, "bin", F.lit(1.0).alias("weight"))
    ins = domains.insulation(contacts, sizes, window, by)
    bnd = domains.boundaries(ins, window, by=by).select(*by, "bin")
    rank = domains.rank_sum_boundaries(contacts, sizes, max(3, window // 2), by=by).select(*by, "bin")
    both = cut(bnd.withColumn("method", F.lit("insulation")).unionByName(rank.withColumn("method", F.lit("rank sum"))))
    ev = compartments.compartments(contacts, sizes, orient, by=by)
    bp = lambda c: F.col(c) * resolution                                                           # noqa: E731
    out = {
        "boundaries": both.select(*by, bp("bin").alias("start"), (bp("bin") + resolution).alias("end"), "method"),
        "domains": domains.domain_scores(contacts, both.select(*by, "bin").distinct(), sizes, by=by).select(*by, bp("start").alias("start"), bp("end").alias("end"), F.round("ratio", 3).alias("inside_over_flank")),
        "tracks": ins.select(*by, "bin", "insulation").join(ev, [*by, "bin"]).select(*by, bp("bin").alias("start"), (bp("bin") + resolution).alias("end"), "insulation", F.col("eigenvector").alias("compartment_eigenvector")),
        "p_s": maps.p_of_s(contacts, sizes, w, resolution, by=by),
    }
    if call:
        lp = cut(loops.call_loops(contacts, sizes, w, resolution, fdr, by=by, **loop_settings))
        out["loops"] = lp.select(*by, F.col("chrom").alias("chrom1"), bp("i").alias("start1"), (bp("i") + resolution).alias("end1"), F.col("chrom").alias("chrom2"), bp("j").alias("start2"),
                                 (bp("j") + resolution).alias("end2"), F.col("obs").alias("observed"), "expected_donut", "oe_donut", "q_donut", "cluster_size")
    return out


def summary(tables: dict[str, DataFrame], sizes: DataFrame, by: list[str] = MAP) -> DataFrame:
    """One row per map: counts of each feature, share of A, P(s) slope."""
    by = list(by)
    out = sizes.select(*by, F.col("n").alias("bins"))
    count = lambda d, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))                      # noqa: E731
    out = out.join(tables["boundaries"].groupBy(*by).agg(F.count_if(F.col("method") == "insulation").alias("insulation_boundaries"),
                                                         F.count_if(F.col("method") == "rank sum").alias("rank_sum_boundaries")), by, "left")
    out = out.join(count(tables["domains"], "scored_domains"), by, "left")
    if "loops" in tables:
        out = out.join(count(tables["loops"], "loops"), by, "left")
    a = tables["tracks"].groupBy(*by).agg(F.round(F.avg((F.col("compartment_eigenvector") > 0).cast("double")), 3).alias("a_fraction"))
    out = out.join(a, by, "left").join(maps.p_of_s_slope(tables["p_s"], by), by, "left")
    return out.na.fill(0, [c for c in ("insulation_boundaries", "rank_sum_boundaries", "scored_domains", "loops") if c in out.columns])


def compare_conditions(reps: DataFrame, sizes: DataFrame, resolution: int, window: int, min_count: float = 5.0, max_sep_bp: int = 2_000_000, orient: DataFrame | None = None,
                       by: list[str] = ("chrom",), call: bool = False, **loop_settings) -> dict[str, DataFrame]:
    """Differential pixels, insulation and compartment tests, boundary, compartment and loop changes of conditions a and b."""
    by = list(by)
    rep = [*by, *compare.REP]
    each = sizes.join(reps.select(*rep).distinct(), by)
    track = lambda d, v: d.select(*rep, "bin", F.col(v).alias("value"))                            # noqa: E731
    ins = cut(track(domains.insulation(reps, each, window, rep), "insulation"))
    ev = cut(track(compartments.compartments(reps, each, orient, by=rep), "eigenvector"))
    pool = cut(reps.groupBy(*by, "condition", "i", "j").agg(F.sum("cnt").alias("cnt")))
    key = [*by, "condition"]
    psz = sizes.join(pool.select(*key).distinct(), by)
    bnd = cut(domains.boundaries(domains.insulation(pool, psz, window, key), window, by=key).select(*key, "bin"))
    px = cut(compare.differential_pixels(reps, 2, max_sep_bp // resolution, min_count, by=by))
    side = lambda d, c: d.filter(F.col("condition") == c)                                          # noqa: E731
    tests = cut(compare.track_test(ins, by))
    out = {"pixels": px, "insulation": tests, "compartment": compare.track_test(ev, by),
           "boundaries": compare.feature_changes(side(bnd, "a"), side(bnd, "b"), by, ["bin"]).join(tests.select(*by, "bin", F.col("q").alias("insulation_q")), [*by, "bin"], "left"),
           "switches": compare.compartment_switches(ev, orient is not None, by), "summary": compare.summary(px, by=by)}
    if call:
        w = maps.bins_of(psz, key).select(*key, "bin", F.lit(1.0).alias("weight"))
        lp = cut(loops.call_loops(pool, psz, w, resolution, by=key, **loop_settings))
        ch = compare.feature_changes(side(lp, "a"), side(lp, "b"), by, ["i", "j"])
        out["loops"] = ch.join(px.select(*by, "i", "j", "log2_fc", "q"), [*by, "i", "j"], "left")
    return out


def write_analysis(tables: dict[str, DataFrame], path: str) -> None:
    """BED, bedGraph, paired BED and Juicebox text beside the P(s) table."""
    if "loops" in tables:
        sinks.write_lines(sinks.bedpe_lines(tables["loops"], ["observed", "expected_donut", "oe_donut", "q_donut", "cluster_size"]), f"{path}/loops.bedpe")
        sinks.write_lines(sinks.juicebox_lines(tables["loops"]), f"{path}/loops_juicebox_2d.txt")
    sinks.write_lines(sinks.bed_lines(tables["boundaries"], "method"), f"{path}/boundaries.bed")
    sinks.write_lines(sinks.bed_lines(tables["domains"]), f"{path}/domains.bed")
    sinks.write_lines(sinks.bedgraph_lines(tables["tracks"], "insulation"), f"{path}/insulation.bedGraph")
    sinks.write_lines(sinks.bedgraph_lines(tables["tracks"], "compartment_eigenvector"), f"{path}/compartments.bedGraph")
    sinks.write_tables({"p_of_s": tables["p_s"]}, path)
