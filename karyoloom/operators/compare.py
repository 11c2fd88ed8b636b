"""Comparison of two conditions with replicates (condition 'a' or 'b', replicate, chrom, i, j, cnt)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from pyspark.sql.types import DoubleType, StructField, StructType

from ..core import cut
from ..functions.special import beta_i, digamma, gamma_p, inverse_trigamma, t_tail, trigamma
from ..functions.intervals import within
from ..functions.ranks import benjamini_hochberg, quantiles
from ..functions.stats import poisson_weight, uniform

REP = ["condition", "replicate"]
CHROM = ("chrom",)
STRATA = 10
PRIOR = StructType([StructField("d0", DoubleType()), StructField("s0", DoubleType())])


def tested_pixels(reps: DataFrame, min_sep: int = 2, max_sep: int | None = None, min_count: float = 5.0,
                  by: list[str] = CHROM) -> DataFrame:
    """Pixels of the band whose mean over all replicates, absent ones counting 0, reaches min_count."""
    n = reps.select(*by, *REP).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("reps"))
    d = F.col("j") - F.col("i")
    band = reps.filter(d >= min_sep if max_sep is None else d.between(min_sep, max_sep))
    s = band.groupBy(*by, "i", "j").agg(F.sum("cnt").alias("_s")).join(n, list(by))
    return s.withColumn("mean_count", F.col("_s") / F.col("reps")).filter(F.col("mean_count") >= min_count).drop("_s", "reps")


def log_cpm(reps: DataFrame, tested: DataFrame, by: list[str] = CHROM) -> DataFrame:
    """log2 counts per million of every tested pixel in every replicate; the library is the sum over tested pixels."""
    names = reps.select(*by, *REP).distinct()
    full = tested.join(names, list(by)).join(reps, [*by, *REP, "i", "j"], "left").na.fill(0.0, ["cnt"])
    lib = full.groupBy(*by, *REP).agg(F.sum("cnt").alias("_lib"))
    y = F.log2((F.col("cnt") + 0.5) / (F.col("_lib") + 1.0) * 1e6)
    return full.join(lib, [*by, *REP]).withColumn("y", y).drop("_lib")


def centre_by_distance(values: DataFrame, by: list[str] = CHROM) -> DataFrame:
    """Each replicate's mean per separation moved to the mean of all replicates. The joined table has one row per
    replicate and separation."""
    d = values.withColumn("d", F.col("j") - F.col("i"))
    own = d.groupBy(*by, *REP, "d").agg(F.avg("y").alias("_own"))
    own = own.withColumn("_shift", F.avg("_own").over(W.partitionBy(*by, "d")) - F.col("_own")).drop("_own")
    return d.join(own, [*by, *REP, "d"]).withColumn("y", F.col("y") + F.col("_shift")).drop("_shift", "d")


def two_means(values: DataFrame, by: list[str], feature: list[str], y: str = "y") -> DataFrame:
    """Means of both conditions and the pooled within-condition variance per feature."""
    side = lambda c: F.when(F.col("condition") == c, F.col(y))                    # noqa: E731
    a, b = side("a"), side("b")
    s = values.groupBy(*by, *feature).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
                                          (F.var_pop(a) * F.count(a) + F.var_pop(b) * F.count(b)).alias("_ss"))
    df = F.col("n_a") + F.col("n_b") - 2
    return (s.withColumns({"log2_fc": F.col("mean_b") - F.col("mean_a"), "s2": F.when(df > 0, F.col("_ss") / df)}).drop("_ss"))


def strata(stats: DataFrame, by: list[str], abundance: str, parts: int = STRATA) -> DataFrame:
    """Stratum of each feature among the distinct decile edges of `abundance` in its group."""
    names = {f"_e{k}": k / parts for k in range(parts + 1)}
    edges = quantiles(stats, list(by), abundance, names).select(*by, F.array_distinct(F.array(*names)).alias("_edges"))
    k = F.size(F.filter("_edges", lambda e: e <= F.col(abundance))) - 1
    return stats.join(edges, list(by)).withColumn("stratum", F.least(k, F.greatest(F.size("_edges") - 2, F.lit(0)))).drop("_edges")


def moderated_t(stats: DataFrame, by: list[str], family: list[str] | None = None) -> DataFrame:
    """t with a variance shrunk towards the prior of its stratum (method of moments on log variances), two-sided p, q over
    the family. `stats` comes from `two_means` with a `stratum` column; only one row per stratum meets Python for the
    prior, p-values come in Arrow batches."""
    key = [*by, "stratum", "n_a", "n_b"]
    log = F.when(F.col("s2") > 0, F.ln("s2"))
    prior = stats.groupBy(*key).agg(F.count(log).alias("_k"), F.avg(log).alias("_mean"), F.var_samp(log).alias("_var"),
                                    F.avg(F.when(F.col("s2") > 0, F.col("s2"))).alias("_plain"))

    @F.pandas_udf(PRIOR)
    def squeeze(k: pd.Series, mean: pd.Series, var: pd.Series, plain: pd.Series, df: pd.Series) -> pd.DataFrame:
        rows = []
        for n, m, v, p, d in zip(k, mean, var, plain, df):
            if n < 3:
                rows.append((0.0, p if n else 1.0))
                continue
            e = m - digamma(d / 2) + np.log(d / 2)
            left = v - trigamma(d / 2)
            if left <= 0:
                rows.append((np.inf, np.exp(e)))
                continue
            d0 = 2 * inverse_trigamma(left)
            rows.append((d0, np.exp(e + digamma(d0 / 2) - np.log(d0 / 2))))
        return pd.DataFrame(rows, columns=["d0", "s0"])

    d = (F.col("n_a") + F.col("n_b") - 2).cast("double")
    prior = prior.filter(d > 0).withColumn("_p", squeeze("_k", "_mean", "_var", "_plain", d)).select(*key, "_p.d0", "_p.s0")
    flat = F.col("d0") == float("inf")
    post = F.when(flat, F.col("s0")).otherwise((F.col("d0") * F.col("s0") + d * F.col("s2")) / (F.col("d0") + d))
    se = F.sqrt(F.greatest(post, F.lit(1e-12)) * (1 / F.col("n_a") + 1 / F.col("n_b")))
    out = (stats.join(prior, key).withColumns({"t": F.col("log2_fc") / se, "_df": F.when(flat, F.lit(float("inf"))).otherwise(d + F.col("d0"))})
           .withColumn("p", t_tail("t", "_df")))
    return benjamini_hochberg(cut(out.drop("d0", "s0", "_df")), list(family or by))


def differential_pixels(reps: DataFrame, min_sep: int = 2, max_sep: int | None = None, min_count: float = 5.0,
                        distance_normalise: bool = True, by: list[str] = CHROM) -> DataFrame:
    """Tested pixels with log2 fold change, t, p and q between conditions (each with at least two replicates)."""
    y = log_cpm(reps, tested_pixels(reps, min_sep, max_sep, min_count, by), by)
    y = centre_by_distance(y, by) if distance_normalise else y
    s = cut(two_means(y, list(by), ["i", "j", "mean_count"]).withColumn("_ab", (F.col("mean_a") + F.col("mean_b")) / 2))
    return moderated_t(strata(s, list(by), "_ab"), list(by)).drop("_ab", "stratum", "s2", "n_a", "n_b")


def fold_changes(reps: DataFrame, min_count: float = 5.0, by: list[str] = CHROM, **band) -> DataFrame:
    """Fold changes without p-values, for conditions with a single replicate."""
    y = centre_by_distance(log_cpm(reps, tested_pixels(reps, min_count=min_count, by=by, **band), by), by)
    return two_means(y, list(by), ["i", "j"]).select(*by, "i", "j", "log2_fc")


def track_test(tracks: DataFrame, by: list[str] = CHROM, min_bins: int = 5) -> DataFrame:
    """Per-bin test of a track (condition, replicate, by, bin, value) over bins present in every replicate; all bins share
    one variance prior."""
    by = list(by)
    names = tracks.select(*by, *REP).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_reps"))
    whole = tracks.filter(F.col("value").isNotNull()).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("_k")).join(names, by).filter("_k = _reps")
    enough = whole.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_bins).select(*by)
    ok = tracks.join(whole.select(*by, "bin"), [*by, "bin"]).join(enough, by)
    s = two_means(ok, by, ["bin"], "value").filter((F.col("n_a") >= 2) & (F.col("n_b") >= 2)).withColumn("stratum", F.lit(0))
    return moderated_t(s, by).select(*by, "bin", "mean_a", "mean_b", F.col("log2_fc").alias("difference"), "t", "p", "q")


def _near(x: DataFrame, other: DataFrame, by: list[str], coords: list[str], tol: int) -> DataFrame:
    o = other.select(*by, *[F.col(c).alias(f"_{c}") for c in coords])
    return within(x, o, by, [(c, f"_{c}") for c in coords], [tol] * len(coords)).select(*by, *coords).distinct()


def feature_changes(a: DataFrame, b: DataFrame, by: list[str], coords: list[str], tolerance: int = 2) -> DataFrame:
    """kept (seen from a), lost in B, gained in B: features matched when all coordinates agree within the tolerance."""
    by, cols = list(by), [*by, *coords]
    a, b = a.select(*cols).distinct(), b.select(*cols).distinct()
    kept, back = _near(a, b, by, coords, tolerance), _near(b, a, by, coords, tolerance)
    tag = lambda d, c: d.select(*cols, F.lit(c).alias("change"))                  # noqa: E731
    return (tag(kept, "kept").unionByName(tag(a.join(kept, cols, "left_anti"), "lost in B"))
            .unionByName(tag(b.join(back, cols, "left_anti"), "gained in B")))


def compartment_switches(tracks: DataFrame, oriented: bool, by: list[str] = CHROM, min_change: float = 0.01) -> DataFrame:
    """Bins whose mean eigenvector changes sign between conditions; without a track each replicate is first aligned to the
    first replicate of condition a by the sign of their correlation."""
    by = list(by)
    v = tracks.filter(F.col("value").isNotNull())
    if not oriented:
        first = v.filter(F.col("condition") == "a").groupBy(*by).agg(F.min("replicate").alias("replicate"))
        ref = v.filter(F.col("condition") == "a").join(first, [*by, "replicate"]).select(*by, "bin", F.col("value").alias("_ref"))
        sign = v.join(ref, [*by, "bin"]).groupBy(*by, *REP).agg(
            F.when((F.count(F.lit(1)) > 3) & (F.corr("value", "_ref") < 0), -1.0).otherwise(1.0).alias("_sign"))
        v = v.join(sign, [*by, *REP], "left").withColumn("value", F.col("value") * F.coalesce("_sign", F.lit(1.0)))
    m = v.groupBy(*by, "bin").agg(F.avg(F.when(F.col("condition") == "a", F.col("value"))).alias("eigenvector_a"),
                                  F.avg(F.when(F.col("condition") == "b", F.col("value"))).alias("eigenvector_b"))
    a, b = F.col("eigenvector_a"), F.col("eigenvector_b")
    up, down = ("B to A", "A to B") if oriented else ("sign + in B", "sign - in B")
    return m.filter((F.signum(a) != F.signum(b)) & (F.abs(b - a) > min_change)).withColumn("switch", F.when(b > 0, up).otherwise(down))


def summary(pixels: DataFrame, fdr: float = 0.05, by: list[str] = CHROM) -> DataFrame:
    sig = F.col("q") <= fdr
    return pixels.groupBy(*by).agg(F.count(F.lit(1)).alias("tested"), F.count_if(sig).alias("significant"),
                                   F.count_if(sig & (F.col("log2_fc") > 0)).alias("gained"),
                                   F.count_if(sig & (F.col("log2_fc") < 0)).alias("lost"))


def measured_change(u: DataFrame, a: DataFrame, by: list[str] = CHROM, min_reads: float = 10, min_sep: int = 2) -> DataFrame:
    """log2 change of a over u after depth normalisation with one pseudo-read, where both maps together have min_reads."""
    far = lambda d, name: d.filter(F.col("j") - F.col("i") >= min_sep).select(*by, "i", "j", F.col("cnt").alias(name))
    both = far(u, "u").join(far(a, "a"), [*by, "i", "j"], "full").na.fill(0.0, ["u", "a"])
    tot = both.groupBy(*by).agg(F.sum("u").alias("_tu"), F.sum("a").alias("_ta"))
    change = F.log2((F.col("a") + 1) / F.col("_ta")) - F.log2((F.col("u") + 1) / F.col("_tu"))
    return both.filter(F.col("u") + F.col("a") >= min_reads).join(tot, list(by)).select(*by, "i", "j", change.alias("change"))


def _first_at(cdf, u: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Smallest whole number at which the distribution function reaches u, by bisection below `top`."""
    low, high = np.full(u.shape, -1.0), top.copy()
    while np.any(high - low > 1):
        mid = np.floor((low + high) / 2)
        mid = np.where(high - low > 1, mid, high)
        reached = cdf(np.maximum(mid, 0.0)) >= u
        low, high = np.where(reached, low, mid), np.where(reached, mid, high)
    return high


@F.pandas_udf(DoubleType())
def _draw(count: pd.Series, fold: pd.Series, u: pd.Series) -> pd.Series:
    """Binomial (fold < 1) or added Poisson (fold > 1) count at which the distribution function reaches u, for any mean."""
    c, f, u = count.to_numpy(float), fold.to_numpy(float), np.minimum(u.to_numpy(float), 1 - 1e-15)
    out, thin = c.copy(), f < 1
    n, q = np.rint(c[thin]), f[thin]
    # P(X <= k) of the binomial law is I(1 - q; n - k, k + 1)
    kept = lambda k: np.where(k >= n, 1.0, beta_i(np.maximum(n - k, 1e-300), k + 1, 1 - q, q))                # noqa: E731
    out[thin] = np.where(q <= 0, 0.0, _first_at(kept, u[thin], n))
    mean = c[~thin] * (f[~thin] - 1)
    added = lambda k: np.where(mean > 0, 1 - gamma_p(k + 1, mean), 1.0)                                        # noqa: E731
    out[~thin] += _first_at(added, u[~thin], np.ceil(mean + 12 * np.sqrt(mean) + 60))
    return pd.Series(out)


def plant_changes(contacts: DataFrame, pixels: DataFrame, seed: int = 0, by: list[str] = CHROM) -> DataFrame:
    """Spike-in: chosen pixels (by, i, j, fold) are thinned or enriched, all others stay."""
    u = uniform(F.lit(seed), *[F.col(c) for c in (*by, "i", "j")])
    return (contacts.join(pixels, [*by, "i", "j"], "left")
            .withColumn("cnt", F.when(F.col("fold").isNotNull(), _draw("cnt", "fold", u)).otherwise(F.col("cnt"))).drop("fold"))


def thin_counts(contacts: DataFrame, frac: float, seed: int = 0, by: list[str] = CHROM) -> DataFrame:
    """Each off-diagonal read kept with probability frac."""
    u = uniform(F.lit(seed), *[F.col(c) for c in (*by, "i", "j")])
    thin = _draw("cnt", F.lit(float(frac)), u)
    return contacts if frac >= 1 else contacts.withColumn("cnt", F.when(F.col("i") == F.col("j"), F.col("cnt")).otherwise(thin))


def discovery_summary(runs: DataFrame, reps: int = 1000, seed: int = 7) -> DataFrame:
    """(fold, runs, mean_fdp, low, high, recall, discoveries) of spike-in runs (region, fold, discoveries, false, planted,
    found); the interval resamples regions. Rows of fold 1 report the discoveries without any planted change."""
    fdp, rec = F.col("false") / F.greatest("discoveries", F.lit(1)), F.col("found") / F.greatest("planted", F.lit(1))
    base = runs.groupBy("fold").agg(F.count(F.lit(1)).alias("runs"), F.avg(fdp).alias("mean_fdp"), F.avg(rec).alias("recall"),
                                    F.sum("discoveries").alias("discoveries"))
    per = runs.groupBy("fold", "region").agg(F.sum(fdp).alias("_s"), F.count(F.lit(1)).alias("_c"))
    draws = (per.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
             .withColumn("_w", poisson_weight(F.lit(seed), F.col("rep"), F.col("region")))
             .groupBy("fold", "rep").agg((F.sum(F.col("_w") * F.col("_s")) / F.nullif(F.sum(F.col("_w") * F.col("_c")), F.lit(0))).alias("_m")))
    ci = draws.groupBy("fold").agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return base.join(ci, "fold")


def distance_change(a: DataFrame, b: DataFrame, by: list[str] = (), value: str = "median") -> DataFrame:
    """Log change of a pair distance between two conditions, centred on its mean."""
    j = a.select(*by, "i", "j", F.col(value).alias("_a")).join(b.select(*by, "i", "j", F.col(value).alias("_b")), [*by, "i", "j"])
    j = j.filter((F.col("_a") > 0) & (F.col("_b") > 0)).withColumn("_m", F.ln(F.col("_b") / F.col("_a")))
    keyed = j.withColumn("_g", F.lit(0))
    mean = keyed.groupBy(*by, "_g").agg(F.avg("_m").alias("_mean"))
    return keyed.join(mean, [*by, "_g"]).select(*by, "i", "j", (F.col("_m") - F.col("_mean")).alias("change"))
