"""Statistics of contact maps: coverage, expected counts, decay, targets, copy number.

Windows here run over bins of one map; their number is set by the chromosome length, not by the reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import MAP, idiv
from ..functions.groups import runs
from ..functions.blocks import coinciding
from ..functions.ranks import quantiles, spearman
from ..functions.stats import median

# fixed values: contact frequency / distance exponent, bond length of a 10 kb bead (nm), target clip in bond lengths
ALPHA, B0_NM, TARGET_CLIP = 3.0, 50.0, (0.8, 8.0)


def mirrored(contacts: DataFrame, by: list[str] = MAP, diagonal_twice: bool = False) -> DataFrame:
    """(by, bin, partner, cnt) seen from both ends; a diagonal pixel once unless asked otherwise."""
    ends = F.array(F.struct(F.col("i").alias("bin"), F.col("j").alias("partner")),
                   F.struct(F.col("j").alias("bin"), F.col("i").alias("partner")))
    if not diagonal_twice:
        ends = F.when(F.col("i") == F.col("j"), F.slice(ends, 1, 1)).otherwise(ends)
    return contacts.select(*by, "cnt", F.inline(ends))


def bins_of(sizes: DataFrame, by: list[str] = MAP) -> DataFrame:
    return sizes.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bin"))


def coverage(contacts: DataFrame, sizes: DataFrame, by: list[str] = MAP, diagonal_twice: bool = False) -> DataFrame:
    s = mirrored(contacts, by, diagonal_twice).groupBy(*by, "bin").agg(F.sum("cnt").alias("cov"))
    return bins_of(sizes, by).join(s, [*by, "bin"], "left").na.fill(0.0, ["cov"])


def coverage_mask(contacts: DataFrame, sizes: DataFrame, min_frac: float = 0.2, by: list[str] = MAP) -> DataFrame:
    """Bins whose total reaches min_frac of the median covered bin."""
    c = coverage(contacts, sizes, by)
    med = c.filter("cov > 0").groupBy(*by).agg(median("cov").alias("_m"))
    ok = F.when(F.col("_m") > 0, F.col("cov") >= min_frac * F.col("_m")).otherwise(F.col("cov") > 0)
    return c.join(med, list(by), "left").select(*by, "bin", "cov", ok.alias("ok"))


def expected(contacts: DataFrame, sizes: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Mean count per pair at each separation, zero pairs included."""
    s = contacts.groupBy(*by, (F.col("j") - F.col("i")).alias("d")).agg(F.sum("cnt").alias("_s"))
    grid = bins_of(sizes, by).withColumnRenamed("bin", "d")
    return grid.join(s, [*by, "d"], "left").select(
        *by, "d", (F.coalesce("_s", F.lit(0.0)) / F.greatest(F.col("n") - F.col("d"), F.lit(1))).alias("expected"))


def valid_pairs(sizes: DataFrame, weights: DataFrame, max_d: Column, by: list[str] = MAP) -> DataFrame:
    """Pairs at each separation with both bins valid: all pairs, minus those with an invalid left or right bin, plus
    those with both invalid, which come from correlating the mask of invalid bins with itself, block by block."""
    by = list(by)
    lim = sizes.select(*by, "n", max_d.alias("_max"))
    bad = weights.filter(F.col("weight").isNull() | ~(F.col("weight") > 0)).select(*by, "bin").join(lim, by)
    last = F.col("_max") - 1
    left = bad.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.least(last, F.col("n") - 1 - F.col("bin")))).alias("d"))
    right = bad.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.least(last, F.col("bin")))).alias("d"))
    both = coinciding(bad, by, "bin").withColumnRenamed("k", "_k")
    lost = (left.unionByName(right).withColumn("_k", F.lit(-1).cast("long")).unionByName(both)
            .groupBy(*by, "d").agg(F.sum("_k").alias("_k")))
    grid = lim.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    n = F.greatest(F.col("n") - F.col("d"), F.lit(0)) + F.coalesce("_k", F.lit(0))
    return grid.join(lost, [*by, "d"], "left").select(*by, "d", n.alias("pairs"))


def balanced(contacts: DataFrame, weights: DataFrame, by: list[str] = MAP) -> DataFrame:
    """cnt * w_i * w_j of pixels whose bins are both valid."""
    side = lambda k: weights.filter("weight > 0").select(*by, F.col("bin").alias(k), F.col("weight").alias(f"w_{k}"))
    return (contacts.join(side("i"), [*by, "i"]).join(side("j"), [*by, "j"])
            .withColumn("bal", F.col("cnt") * F.col("w_i") * F.col("w_j")))


def expected_balanced(contacts: DataFrame, sizes: DataFrame, weights: DataFrame, max_d: int | None = None,
                      by: list[str] = MAP) -> DataFrame:
    """Mean balanced count per separation below max_d over pairs with both bins valid."""
    top = F.col("n") if max_d is None else F.lit(max_d).cast("long")
    pairs = valid_pairs(sizes, weights, top, by)
    s = balanced(contacts, weights, by).groupBy(*by, (F.col("j") - F.col("i")).alias("d")).agg(F.sum("bal").alias("_s"))
    return pairs.join(s, [*by, "d"], "left").select(
        *by, "d", "pairs", (F.coalesce("_s", F.lit(0.0)) / F.greatest("pairs", F.lit(1))).alias("expected"))


def observed_over_expected(contacts: DataFrame, exp: DataFrame, by: list[str] = MAP, value: str = "cnt") -> DataFrame:
    d = contacts.withColumn("d", F.col("j") - F.col("i"))
    return d.join(exp.select(*by, "d", "expected"), [*by, "d"]).withColumn(
        "oe", F.when(F.col("expected") > 0, F.col(value) / F.col("expected")).otherwise(0.0))


def p_of_s(contacts: DataFrame, sizes: DataFrame, weights: DataFrame, resolution: int, max_sep_bp: int | None = None,
           by: list[str] = MAP) -> DataFrame:
    """Contact probability per separation, summing to 1 over d >= 1; NULL where nothing was seen."""
    max_d = None if max_sep_bp is None else max_sep_bp // resolution + 1
    e = expected_balanced(contacts, sizes, weights, max_d, by)
    ok = (F.col("d") >= 1) & (F.col("expected") > 0)
    total = F.sum(F.when(ok, F.col("expected"))).over(W.partitionBy(*by))
    return e.select(*by, "d", (F.col("d") * resolution).alias("separation_bp"), F.when(ok, F.col("expected") / total).alias("p"),
                    F.count(F.lit(1)).over(W.partitionBy(*by)).alias("max_d"))


def p_of_s_slope(ps: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Log-log slope over 2 <= d <= max(3, D / 10), at least three separations."""
    fit = F.col("p").isNotNull() & (F.col("d") >= 2) & (F.col("d") <= F.greatest(F.lit(3), idiv("max_d", 10)))
    x, y = F.when(fit, F.log10("separation_bp")), F.when(fit, F.log10("p"))
    return ps.groupBy(*by).agg(F.when(F.count(x) >= 3, F.regr_slope(y, x)).alias("slope"))


def log_grid(top: Column, points: int) -> Column:
    """Distinct rounded log-spaced integers 1 ... top."""
    step = lambda k: F.bround(F.pow(top.cast("double"), k / (points - 1))).cast("long")     # noqa: E731
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), step))


def contact_decay(contacts: DataFrame, sizes: DataFrame, points: int = 30, by: list[str] = MAP) -> DataFrame:
    """Mean count at log-spaced separations."""
    grid = sizes.select(*by, "n", F.explode(log_grid(F.greatest(F.lit(2), F.col("n") - 1), points)).alias("d"))
    return grid.join(expected(contacts, sizes, by), [*by, "d"])


def decay_exponent(decay: DataFrame, by: list[str] = MAP) -> DataFrame:
    """gamma in P ~ s^-gamma over s = 2 ... max(10, n / 10); NULL below 30 bins or 4 separations."""
    fit = (F.col("d") >= 2) & (F.col("d") <= F.greatest(F.lit(10), idiv("n", 10))) & (F.col("expected") > 0)
    x, y = F.when(fit, F.ln("d")), F.when(fit, F.ln("expected"))
    return decay.groupBy(*by).agg(F.when((F.count(x) >= 4) & (F.max("n") >= 30), -F.regr_slope(y, x)).alias("gamma"))


def reference_count(contacts: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Median count of adjacent bins, or the 95th percentile of all counts when there is none. Counts are small
    integers, so the percentile buffers hold few distinct values whatever the number of pixels."""
    adj = F.when(F.col("j") - F.col("i") == 1, F.col("cnt"))
    return contacts.groupBy(*by).agg(F.coalesce(median(adj), F.percentile("cnt", F.lit(0.95))).alias("m_ref"))


def target_distance(contacts: DataFrame, b0: float = B0_NM, by: list[str] = MAP) -> DataFrame:
    """Distance implied by a count, b0 (M / M_ref)^(-1/3), clipped to multiples of b0."""
    d = b0 * F.pow(F.col("cnt") / F.col("m_ref"), -1.0 / ALPHA)
    lo, hi = (F.lit(c * b0) for c in TARGET_CLIP)
    return contacts.join(reference_count(contacts, by), list(by)).withColumn("distance", F.least(hi, F.greatest(lo, d)))


def counts_to_probability(contacts: DataFrame, p_adjacent: float = 0.5, by: list[str] = MAP) -> DataFrame:
    """Counts scaled so that the median adjacent count has probability p_adjacent, capped below 1."""
    anchor = contacts.filter((F.col("j") - F.col("i") == 1) & (F.col("cnt") > 0)).groupBy(*by).agg(median("cnt").alias("_m"))
    p = F.least(F.lit(0.999), F.greatest(F.lit(0.0), F.col("cnt") * (F.lit(p_adjacent) / F.col("_m"))))
    return contacts.join(anchor, list(by)).withColumn("p", p).drop("_m")


def copy_number(contacts: DataFrame, sizes: DataFrame, ploidy: float = 2.0, smooth: int = 5, by: list[str] = MAP) -> DataFrame:
    """Copy number per bin: coverage over its median, running median, rounded half to even."""
    c = coverage(contacts, sizes, by, diagonal_twice=True)
    med = c.filter("cov > 0").groupBy(*by).agg(median("cov").alias("_m"), F.count(F.lit(1)).alias("_k"))
    raw = F.when((F.col("cov") > 0) & (F.col("_k") >= 10), ploidy * F.col("cov") / F.col("_m"))
    h = max(1, smooth // 2)
    near = F.array_sort(F.collect_list("_raw").over(W.partitionBy(*by).orderBy("bin").rowsBetween(-h, h)))
    mid = (F.try_element_at(near, idiv(F.size(near) + 1, 2).cast("int")) + F.try_element_at(near, idiv(F.size(near) + 2, 2).cast("int"))) / 2
    return (c.join(med, list(by)).withColumn("_raw", raw)
            .select(*by, "bin", F.when(F.size(near) > 0, F.bround(mid)).alias("copies")))


def copy_number_segments(cn: DataFrame, ploidy: float = 2.0, min_bins: int = 3, by: list[str] = MAP) -> DataFrame:
    """Runs of at least min_bins equal copy numbers that differ from the ploidy."""
    return runs(cn.filter(F.col("copies").isNotNull() & (F.col("copies") != ploidy)), list(by), "bin", 0, min_bins, ["copies"])


def contact_fit(contacts: DataFrame, beads: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Rank correlation of -distance and count over observed pixels (beads: by, structure, bead, x, y, z). Beads without some
    column of `by` (the sample) belong to every map that agrees in the others."""
    own = [c for c in by if c in beads.columns]
    side = lambda k: beads.select(*own, "structure", F.col("bead").alias(k),          # noqa: E731
                                  *[F.col(c).alias(f"{c}_{k}") for c in "xyz"])
    d2 = sum((F.pow(F.col(f"{c}_i") - F.col(f"{c}_j"), 2) for c in "xyz"), F.lit(0.0))
    places = contacts.select(*own, "i", "j").distinct()                                # the distance is the same in all maps
    pairs = (contacts.join(places.join(side("i"), [*own, "i"]).join(side("j"), [*own, "structure", "j"]), [*own, "i", "j"])
             .select(*by, "structure", "cnt", (-F.sqrt(d2)).alias("_closeness")))
    return spearman(pairs, [*by, "structure"], "_closeness", "cnt", min_n=3)


def median_scale(before: DataFrame, value: str, raw: str, by: list[str] = MAP) -> DataFrame:
    """Factor that gives `value` the median of `raw` (both are exact, bucketed quantiles)."""
    a = quantiles(before, list(by), raw, {"_raw": 0.5})
    b = quantiles(before, list(by), value, {"_new": 0.5})
    return a.join(b, list(by)).select(*by, (F.col("_raw") / F.col("_new")).alias("scale"))
