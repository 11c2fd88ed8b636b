"""Scores, agreement measures and resampling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .ranks import quantiles



def _poisson_1() -> list[float]:
    """Cumulative Poisson(1) up to the last value that a double tells from 1."""
    out, k = [math.exp(-1)], 0
    while out[-1] < 1:
        k += 1
        out.append(min(1.0, math.fsum(math.exp(-1) / math.factorial(j) for j in range(k + 1))))
    return out[:-1]


POISSON_1 = _poisson_1()


def median(c) -> Column:
    return F.percentile(c, F.lit(0.5))


def zscore(value: str, by: list[str], min_n: int = 3) -> Column:
    """Plain z inside a group of bins or beads; 0 without spread or below `min_n` values."""
    w = W.partitionBy(*by)
    sd = F.stddev_pop(value).over(w)
    ok = (F.count(value).over(w) >= min_n) & (sd > 0)
    return F.when(F.col(value).isNotNull(), F.when(ok, (F.col(value) - F.avg(value).over(w)) / sd).otherwise(0.0))


def robust_z(df: DataFrame, by: list[str], value: str, out: str = "z") -> DataFrame:
    """(v - median) / (1.4826 MAD), with the standard deviation when the MAD is 0."""
    med = df.groupBy(*by).agg(median(value).alias("_med"), F.stddev_pop(value).alias("_sd"))
    d = df.join(med, by)
    mad = d.groupBy(*by).agg((median(F.abs(F.col(value) - F.col("_med"))) * 1.4826).alias("_mad"))
    diff = F.col(value) - F.col("_med")
    z = (F.when(F.col("_mad") > 0, diff / F.col("_mad")).when(F.col("_sd") > 0, diff / F.col("_sd")).otherwise(0.0))
    return d.join(mad, by).withColumn(out, z).drop("_med", "_sd", "_mad")


def agreement(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson, Lin's concordance and median ratio y / x over rows where both are present. The ratio takes any number of
    distinct values, so its median comes from bucketed quantiles."""
    ok = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    mx, my, vx, vy = F.avg(x), F.avg(y), F.var_pop(x), F.var_pop(y)
    den = vx + vy + (mx - my) ** 2
    s = ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.when((vx > 0) & (vy > 0), F.covar_pop(x, y) / F.sqrt(vx * vy)).alias("pearson"),
        F.when(den > 0, 2 * F.covar_pop(x, y) / den).alias("ccc"))
    ratio = ok.filter(F.col(x) > 0).select(*by, (F.col(y) / F.col(x)).alias("_ratio"))
    return s.join(quantiles(ratio, list(by), "_ratio", {"scale": 0.5}), list(by), "left")


def uniform(*parts) -> Column:
    """Deterministic draw in [0, 1) from row keys."""
    h = F.xxhash64(*parts)
    return F.pmod(h, F.lit(2 ** 53)).cast("double") / float(2 ** 53)


def poisson_weight(*parts) -> Column:
    """How often a row is drawn in one bootstrap replicate (Poisson(1))."""
    u = uniform(*parts)
    return sum((F.when(u >= t, 1).otherwise(0) for t in POISSON_1), F.lit(0))


def bootstrap_mean(df: DataFrame, by: list[str], unit: list[str], value: str, reps: int = 100, seed: int = 0,
                   level: float = 0.95) -> DataFrame:
    """Percentile interval of a mean when `unit` (rows, loci, blocks, copies) is resampled. Units are summed first, so
    the replicates cost one pass over unit totals and not over the rows."""
    units = df.filter(F.col(value).isNotNull()).groupBy(*by, *unit).agg(F.sum(value).alias("_s"),
                                                                        F.count(value).alias("_c"))
    draws = (units.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
             .withColumn("_w", poisson_weight(F.lit(seed), F.col("rep"), *[F.col(u) for u in unit])))
    per = (draws.groupBy(*by, "rep").agg((F.sum(F.col("_w") * F.col("_s")) /
                                          F.nullif(F.sum(F.col("_w") * F.col("_c")), F.lit(0))).alias("_m")))
    a = (1 - level) / 2
    ci = per.groupBy(*by).agg(F.percentile("_m", F.lit(a)).alias("low"), F.percentile("_m", F.lit(1 - a)).alias("high"))
    return units.groupBy(*by).agg((F.sum("_s") / F.sum("_c")).alias("mean")).join(ci, by, "left")


def bootstrap_pairs(df: DataFrame, by: list[str], i: str, j: str, x: str, y: str, reps: int = 50,
                    seed: int = 0) -> DataFrame:
    """Interval of the correlation of two pair maps when loci are resampled: a pair weighs w_i * w_j."""
    d = (df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
         .withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
         .withColumn("_w", poisson_weight(F.lit(seed), F.col("rep"), F.col(i))
                     * poisson_weight(F.lit(seed), F.col("rep"), F.col(j))).filter(F.col("_w") > 0))
    w, a, b = F.col("_w"), F.col(x), F.col(y)
    s = d.groupBy(*by, "rep").agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"),
                                  F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), F.sum(w * a * b).alias("ab"))
    va, vb = F.col("n") * F.col("aa") - F.col("a") ** 2, F.col("n") * F.col("bb") - F.col("b") ** 2
    r = F.when((va > 0) & (vb > 0), (F.col("n") * F.col("ab") - F.col("a") * F.col("b")) / F.sqrt(va * vb))
    return s.withColumn("r", r).groupBy(*by).agg(F.percentile("r", F.lit(0.025)).alias("low"), median("r").alias("mid"),
                                                 F.percentile("r", F.lit(0.975)).alias("high"))
