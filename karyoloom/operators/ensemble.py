"""Distances of Gaussian pair vectors: contact probability, spread, intervals, fit targets and reliability; the neighbour
graph of a map."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType

from ..core import MAP
from ..functions.special import gamma_p
from .contacts import strongest

# fixed values: mean, standard deviation and median of |N(0, I3)|
MAXWELL_MEAN, MAXWELL_SD, MAXWELL_MEDIAN = math.sqrt(8 / math.pi), math.sqrt(3 - 8 / math.pi), 1.5381722544550522
LOWEST, HIGHEST = 1e-3, 30.0          # fixed values: range of the quantiles, beyond which the law is 0 or 1 to a double


UNSTATED_OBSERVATIONS = 1000.0        # fixed value: observations of a frequency that comes without their number


def maxwell_p(x: np.ndarray) -> np.ndarray:
    """P(|r| < x): half the square of |r| has the gamma law of shape 3/2."""
    v = np.maximum(np.asarray(x, float), 0.0)
    return gamma_p(np.full(v.shape, 1.5), v * v / 2)


def maxwell_x(p: np.ndarray) -> np.ndarray:
    """x with P(|r| < x) = p, by Newton steps kept inside a shrinking bracket."""
    p = np.asarray(p, float)
    low, high = np.full(p.shape, LOWEST), np.full(p.shape, HIGHEST)
    x = np.clip(np.cbrt(3 * np.sqrt(np.pi / 2) * p), LOWEST, 5.0)          # the law near zero
    for _ in range(60):
        miss = maxwell_p(x) - p
        low, high = np.where(miss < 0, x, low), np.where(miss > 0, x, high)
        slope = math.sqrt(2 / math.pi) * x * x * np.exp(-x * x / 2)
        step = x - miss / np.maximum(slope, 1e-300)
        new = np.where((step > low) & (step < high), step, (low + high) / 2)
        if np.all(np.abs(new - x) <= 1e-14 * x):
            break
        x = new
    return x


@F.pandas_udf(DoubleType())
def maxwell_cdf(x: pd.Series) -> pd.Series:
    known = x.notna().to_numpy()
    out = np.full(len(x), np.nan)
    out[known] = maxwell_p(x.to_numpy(float)[known])
    return pd.Series(out).where(known)


@F.pandas_udf(DoubleType())
def maxwell_quantile(q: pd.Series) -> pd.Series:
    known = q.notna().to_numpy()
    out = np.full(len(q), np.nan)
    out[known] = maxwell_x(q.to_numpy(float)[known])
    return pd.Series(out).where(known)


def contact_probability(sigma: Column, r_c: float = 1.0) -> Column:
    """P(|r| < r_c) for a pair vector of standard deviation sigma per axis."""
    return maxwell_cdf(F.lit(float(r_c)) / F.greatest(sigma, F.lit(1e-12)))


def sigma_of(p: Column, r_c: float = 1.0) -> Column:
    return F.lit(float(r_c)) / maxwell_quantile(p)


def median_distance(p: Column, r_c: float = 1.0) -> Column:
    return MAXWELL_MEDIAN * sigma_of(p, r_c)


def central_interval(level: float) -> tuple[float, float]:
    """Multiples of sigma that bound the central share `level` of distances."""
    low, high = maxwell_x(np.array([(1 - level) / 2, (1 + level) / 2]))
    return float(low), float(high)


def summarise_sigma(df: DataFrame, r_c: float, level: float = 0.8, bounds: tuple[float, float] | None = None, sigma: str = "sigma") -> DataFrame:
    lo, hi = bounds or central_interval(level)
    s = F.col(sigma)
    return df.withColumns({"mean": MAXWELL_MEAN * s, "sd": MAXWELL_SD * s, "median": MAXWELL_MEDIAN * s, "lower": lo * s, "upper": hi * s,
                           "contact_probability": contact_probability(s / r_c)})


def symmetric_frequency(freq: DataFrame, by: list[str]) -> DataFrame:
    """Mean of both triangles over present values (by, i, j, f, n_obs)."""
    d = freq.filter(F.col("f").isNotNull() & (F.col("i") != F.col("j")))
    return d.groupBy(*by, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).agg(F.avg("f").alias("f"), F.max("n_obs").alias("n_obs"))


def fit_targets(freq: DataFrame, weighting: str = "binomial", by: list[str] = ("map",)) -> DataFrame:
    """Clipped frequency, target log variance (in r_c^2) and weight, normalised to mean 1, per observed pair."""
    by = list(by)
    seen = F.greatest(F.lit(1.0), F.coalesce("n_obs", F.lit(UNSTATED_OBSERVATIONS)))
    half = 0.5 / F.col("n_obs")                              # half an observation away from never and always
    pairs = symmetric_frequency(freq, by).withColumn("n_obs", seen)
    pairs = pairs.withColumn("clipped", F.least(F.greatest(F.col("f"), half), 1 - half))
    odds = F.col("clipped") / (1 - F.col("clipped"))
    pairs = pairs.withColumn("_raw", F.col("n_obs") * odds if weighting == "binomial" else F.lit(1.0))
    pairs = pairs.withColumn("log_target", 2.0 * F.ln(sigma_of(F.col("clipped"))))
    scale = pairs.groupBy(*by).agg((F.count(F.lit(1)) / F.sum("_raw")).alias("_scale"))
    return pairs.join(scale, by).withColumn("weight", F.col("_raw") * F.col("_scale")).drop("_raw", "_scale")


def bead_reliability(targets: DataFrame, model: DataFrame, beads: DataFrame, r_c: float, tau: float = 0.25, by: list[str] = ("map",)) -> DataFrame:
    """coverage * exp(-weighted mean |log variance misfit| / tau) per bead. `model` holds sigma per pair, `beads` all
    (by, bead)."""
    by = list(by)
    m = targets.join(model.select(*by, "i", "j", (2.0 * F.ln(F.greatest(F.col("sigma") / r_c, F.lit(1e-12)))).alias("_log")), [*by, "i", "j"], "left")
    err = m.select(*by, F.explode(F.array("i", "j")).alias("bead"), "weight", (F.abs(F.coalesce("_log", F.lit(0.0)) - F.col("log_target")) * F.col("weight")).alias("_e"))
    s = err.groupBy(*by, "bead").agg(F.count(F.lit(1)).alias("_k"), F.sum("weight").alias("_w"), F.sum("_e").alias("_e"))
    n = beads.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    r = F.when(F.col("_w") > 0, F.col("_k") / F.greatest(F.col("_n") - 1, F.lit(1)) * F.exp(-(F.col("_e") / F.col("_w")) / tau)).otherwise(0.0)
    return beads.join(n, by).join(s, [*by, "bead"], "left").select(*by, "bead", F.least(F.lit(1.0), F.coalesce(r, F.lit(0.0))).alias("reliability"))


def message_graph(contacts: DataFrame, sizes: DataFrame, k: int = 8, by: list[str] = MAP) -> DataFrame:
    """Directed edges dst <- src: neighbours one and two bins away plus each bin's k strongest longer contacts, with scaled
    strength, scaled separation, backbone flag and the degree of dst."""
    by = list(by)
    bins = sizes.select(*by, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("a"))
    back = bins.withColumn("b", F.explode(F.array(*[(F.col("a") + k).cast("long") for k in (-2, -1, 1, 2)]))).filter((F.col("b") >= 0) & (F.col("b") < F.col("n")))
    near = contacts.filter((F.col("j") - F.col("i")).between(1, 2))
    w = back.select(*by, "a", "b", F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j")).join(near, [*by, "i", "j"], "left")
    back = w.select(*by, F.col("a").alias("dst"), F.col("b").alias("src"), F.coalesce("cnt", F.lit(0.0)).alias("cnt"), F.lit(1.0).alias("backbone"))
    top = strongest(contacts.filter(F.col("j") - F.col("i") > 2), by, k)
    ends = F.array(F.struct(F.col("bin").alias("dst"), F.col("partner").alias("src")))
    far = top.select(*by, "cnt", F.lit(0.0).alias("backbone"), F.inline(ends)).select(*back.columns)
    edges = back.unionByName(far)
    high = contacts.groupBy(*by).agg(F.greatest(F.max("cnt"), F.lit(1.0)).alias("_m"))
    deg = edges.groupBy(*by, "dst").agg(F.count(F.lit(1)).alias("degree"))
    e = edges.join(sizes, by).join(high, by).join(deg, [*by, "dst"])
    return e.select(*by, "dst", "src", (F.log1p("cnt") / F.log1p("_m")).alias("strength"),
                    (F.log1p(F.abs(F.col("dst") - F.col("src"))) / F.log1p(F.greatest(F.col("n"), F.lit(2)))).alias("separation"), "backbone", "degree")


def node_features(nodes: DataFrame, by: list[str] = MAP) -> DataFrame:
    """z of GC and of log1p signal over valid bins (0 elsewhere) with the validity flag (nodes: by, bin, gc, signal, valid)."""
    ok = F.coalesce(F.col("valid"), F.lit(False)) & F.col("gc").isNotNull() & F.col("signal").isNotNull()
    d = nodes.withColumns({"_g": F.when(ok, F.col("gc")), "_e": F.when(ok, F.log1p(F.greatest("signal", F.lit(0.0))))})
    w = W.partitionBy(*by)
    z = lambda c: F.coalesce((F.col(c) - F.avg(c).over(w)) / (F.stddev_pop(c).over(w) + 1e-8), F.lit(0.0))          # noqa: E731
    return d.select(*by, "bin", z("_g").alias("gc_z"), z("_e").alias("signal_z"), ok.cast("double").alias("present"))
