"""Pair features of loci, distance models and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import cut
from ..functions.intervals import pair_tiles, points_in_intervals
from ..functions.ranks import quantiles, spearman
from ..functions.regress import least_squares, ridge, ridge_with_missing
from .ensemble import median_distance

BASE = ("convergent", "divergent", "tandem", "anchor", "between", "gc")


def log10_sep(c: str = "sep") -> Column:
    return F.log10(F.greatest(F.col(c).cast("double"), F.lit(1.0)))


def axis_cells(loci: DataFrame, by: list[str]) -> DataFrame:
    """The axis of each group cut at all starts and ends of its loci: (by, _at, _end), the last cell without an end."""
    edges = loci.select(*by, F.explode(F.array("start", "end")).alias("_at")).dropna().distinct()
    return edges.withColumn("_end", F.lead("_at").over(W.partitionBy(*by).orderBy("_at")))


def in_cells(points: DataFrame, cells: DataFrame, by: list[str], pos: str, *also: str) -> DataFrame:
    """(by, also, _at, _n, _v): number and summed `value` of the points of each cell that holds some. A point meets its cell
    once; all later steps work on cells."""
    hit = points_in_intervals(points.withColumnRenamed(pos, "_pos"), cells.filter("_end IS NOT NULL"), by, "_pos", "_at", "_end")
    return hit.groupBy(*by, *also, "_at").agg(F.count(F.lit(1)).alias("_n"), F.sum("value").alias("_v"))


def with_counts(loci: DataFrame, cells: DataFrame, by: list[str]) -> DataFrame:
    """Loci with n_start and n_end, the points from the first edge of the group up to the start and up to the end of a locus,
    for counts between two loci. `cells`: a row (by, _at, _n) for every edge."""
    before = W.partitionBy(*by).orderBy("_at").rowsBetween(W.unboundedPreceding, -1)
    c = cells.select(*by, "_at", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    side = lambda k, n: c.select(*by, F.col("_at").alias(k), F.col("_below").alias(n))              # noqa: E731
    return loci.join(side("start", "n_start"), [*by, "start"]).join(side("end", "n_end"), [*by, "end"])


def loci_with_counts(loci: DataFrame, peaks: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Peaks up to the start and up to the end of each locus, for counts between two loci."""
    by = list(by)
    cells = axis_cells(loci, by)
    held = in_cells(peaks.select(*by, "mid", F.lit(0).alias("value")), cells, by, "mid")
    return with_counts(loci, cut(cells.join(held, [*by, "_at"], "left").select(*by, "_at", F.coalesce("_n", F.lit(0)).alias("_n"))), by)


def pair_features(loci: DataFrame, peaks: DataFrame, by: list[str] = ("chrom",), max_sep: int | None = None) -> DataFrame:
    """Six features of each locus pair i < j and each of them times log10 s (loci: by, locus, start, end, fwd, rev, unk, gc)."""
    by = list(by)
    mean = loci.groupBy(*by).agg(F.avg("gc").alias("_g"))
    d = loci_with_counts(loci, peaks, by).join(mean, by).withColumn("g", F.coalesce(F.col("gc") - F.col("_g"), F.lit(0.0)))
    L = F.log1p
    d = d.withColumns({"f": L("fwd"), "r": L("rev"), "a": L(F.col("fwd") + F.col("rev") + F.col("unk")), "c": (F.col("start") + F.col("end")) / 2})
    p = pair_tiles(d, by, "locus", ["f", "r", "a", "g", "c", "n_start", "n_end"], max_sep=max_sep)
    fi, ri, fj, rj = (F.col(k) for k in ("f_i", "r_i", "f_j", "r_j"))
    base = {"convergent": fi * rj, "divergent": ri * fj, "tandem": fi * fj + ri * rj, "anchor": F.col("a_i") + F.col("a_j"),
            "between": L(F.col("n_start_j") - F.col("n_end_i")), "gc": F.col("g_i") * F.col("g_j")}
    out = p.withColumns({"sep": F.abs(F.col("c_j") - F.col("c_i")), **base})
    return out.select(*by, "i", "j", "sep", *BASE, *[(F.col(k) * log10_sep()).alias(f"{k}_s") for k in BASE])


FEATURES = [*BASE, *[f"{k}_s" for k in BASE]]


def mark_features(loci: DataFrame, marks: DataFrame, cohesin: str = "rad21", by: list[str] = ("chrom",)) -> DataFrame:
    """Per mark (mark, by, pos, value): similarity and sum of the log signals of both loci, each also times log10 s, and for
    the cohesin mark the log count of peaks between them."""
    by, key = list(by), [*by, "mark"]
    loci, cells = loci.select(*by, "locus", "start", "end"), axis_cells(loci, by)
    names = marks.select(*key).distinct()
    held = cut(in_cells(marks.select(*key, "pos", "value"), cells, by, "pos", "mark"))
    s = points_in_intervals(held.select(*key, "_at", "_v"), loci, by, "_at").groupBy(*key, "locus").agg(F.sum("_v").alias("_s"))
    d = loci.join(names, by).join(s, [*key, "locus"], "left").filter("mark IS NOT NULL").withColumn("s", F.log1p(F.coalesce("_s", F.lit(0.0))))
    d = d.withColumn("d", F.col("s") - F.avg("s").over(W.partitionBy(*key))).withColumn("c", (F.col("start") + F.col("end")) / 2)
    grid = cells.join(names, by).join(held, [*key, "_at"], "left").select(*key, "_at", F.coalesce("_n", F.lit(0)).alias("_n"))
    d = cut(with_counts(d, grid, key).select(*key, "locus", "s", "d", "c", "n_start", "n_end"))
    p = pair_tiles(d, key, "locus", ["s", "d", "c", "n_start", "n_end"]).withColumn("sep", F.abs(F.col("c_j") - F.col("c_i")))
    between = F.when(F.col("mark") == cohesin, F.log1p(F.greatest(F.col("n_start_j") - F.col("n_end_i"), F.lit(0))))
    p = p.withColumns({"similarity": F.col("d_i") * F.col("d_j"), "anchor": F.col("s_i") + F.col("s_j"), "between": between})
    return p.select(*key, "i", "j", *["similarity", "anchor", "between"], *[(F.col(k) * log10_sep()).alias(f"{k}_s") for k in ("similarity", "anchor", "between")])


def trend_residual(df: DataFrame, by: list[str], value: str, sep: str = "sep", out: str = "residual") -> DataFrame:
    """value minus its mean at the same separation. The means form a small table, so a separation that holds most pairs is
    not gathered in one task."""
    m = df.groupBy(*by, sep).agg(F.avg(value).alias("_mean"))
    return df.join(m, [*by, sep]).withColumn(out, F.col(value) - F.col("_mean")).drop("_mean")


def fit_trend(df: DataFrame, log_d: Column, sep: str = "sep", unit: list[str] = ("dataset",)) -> DataFrame:
    """(intercept, slope) of log d on log10 s with every dataset weighing the same: averages of dataset averages."""
    x = F.when(F.col(sep) > 0, F.log10(sep))
    d = df.select(*unit, x.alias("x"), log_d.alias("y")).dropna(subset=["x", "y"])
    u = d.groupBy(*unit).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.col("x") * F.col("x")).alias("xx"), F.avg(F.col("x") * F.col("y")).alias("xy"))
    m = u.agg(*[F.avg(k).alias(k) for k in ("x", "y", "xx", "xy")])
    b = (F.col("xy") - F.col("x") * F.col("y")) / (F.col("xx") - F.col("x") ** 2)
    return m.select((F.col("y") - b * F.col("x")).alias("intercept"), b.alias("slope"))


def fit_ridge(df: DataFrame, y: Column, lam: float, features: list[str] = FEATURES, unit: list[str] = ("dataset",)) -> DataFrame:
    return ridge(df, {f: F.col(f) for f in features}, y, list(unit), lam)


def apply_model(df: DataFrame, model: dict[str, tuple[float, float, float]], trend: tuple[float, float], sep: str = "sep") -> DataFrame:
    """Median distance exp(a + b log10 s + residual) from features standardised by the model (feature -> beta, mu, sd)."""
    res = sum(((F.col(f) - mu) / sd * beta for f, (beta, mu, sd) in model.items()), F.lit(0.0))
    return df.withColumn("distance", F.exp(trend[0] + trend[1] * log10_sep(sep) + res))


def input_summary(peaks: DataFrame, loci: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    p = peaks.groupBy(*by).agg(F.count(F.lit(1)).alias("peaks"), F.count_if(F.col("strand") != 0).alias("peaks_with_motif"))
    l = loci.groupBy(*by).agg(F.count(F.lit(1)).alias("loci"), F.count_if(F.col("fwd") + F.col("rev") + F.col("unk") > 0).alias("loci_with_peak"), F.avg("gc").alias("gc_mean"))
    return l.join(p, list(by), "left")


def ratio_to_trend(df: DataFrame, by: list[str], value: str, out: str, sep: str = "sep") -> DataFrame:
    m = df.groupBy(*by, sep).agg(F.avg(value).alias("_mean"))
    return df.join(m, [*by, sep]).withColumn(out, F.col(value) / F.col("_mean")).drop("_mean")


def compare_maps(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rank agreement of two distance maps (by, i, j, value), raw and with the separation trend divided out, and the median
    ratio; all pairs, without sampling."""
    by = list(by)
    j = a.select(*by, "i", "j", F.col("value").alias("x")).join(b.select(*by, "i", "j", F.col("value").alias("y")), [*by, "i", "j"])
    j = j.filter((F.col("x") > 0) & (F.col("y") > 0)).withColumn("sep", F.col("j") - F.col("i"))
    j = cut(ratio_to_trend(ratio_to_trend(j, by, "x", "xr"), by, "y", "yr").withColumns({"xr": F.round("xr", 12), "yr": F.round("yr", 12)}))
    raw = spearman(j, by, "x", "y", out="spearman", n_out="pairs")
    free = spearman(j, by, "xr", "yr", out="spearman_trend_removed", n_out="_n").drop("_n")
    ratio = quantiles(j.withColumn("_q", F.col("y") / F.col("x")), by, "_q", {"median_ratio": 0.5})
    return raw.join(free, by).join(ratio, by)


def cohesin_loss(df: DataFrame, lam: float, c: tuple[float, float, float], log_range: tuple[float, float], by: list[str], value: str = "value", sep_bp: str = "sep") -> DataFrame:
    """Distances after cohesin loss: log d plus a quadratic shift in log separation minus lam times the trend residual."""
    d = trend_residual(df.withColumn("_l", F.when(F.col(value) > 0, F.ln(value))), by, "_l", sep_bp, "_r")
    x = F.log10(F.greatest(F.lit(10.0 ** log_range[0]), F.least(F.lit(10.0 ** log_range[1]), F.col(sep_bp).cast("double"))))
    return d.withColumn("after", F.exp(F.col("_l") + c[0] + c[1] * x + c[2] * x * x - lam * F.coalesce("_r", F.lit(0.0)))).drop("_l", "_r")


SIZE_COLUMNS = ("L", "L2", "step", "depth", "intact", "dilution")


def size_design(columns: tuple[str, ...] = SIZE_COLUMNS) -> dict[str, Column]:
    x = F.log10(F.col("sep").cast("double"))
    every = {"L": x, "L2": x * x, "step": F.log10(F.col("step").cast("double")), "depth": F.log10(F.greatest(F.col("n_eff").cast("double"), F.lit(1.0))),
             "intact": (F.col("protocol") == "intact").cast("double"), "dilution": (F.col("protocol") == "dilution").cast("double")}
    return {k: every[k] for k in columns}


def fit_size(df: DataFrame, columns: tuple[str, ...] = SIZE_COLUMNS, unit: list[str] = ("unit",)) -> DataFrame:
    """Log size correction by least squares on separation, step, depth and protocol, units weighing the same."""
    return least_squares(df, size_design(columns), F.ln(F.col("truth") / F.col("model")), list(unit))


def apply_size(df: DataFrame, beta: dict[str, float], columns: tuple[str, ...] = SIZE_COLUMNS) -> DataFrame:
    x = sum((c * beta[k] for k, c in size_design(columns).items()), F.lit(beta["1"]))
    return df.withColumn("calibrated", F.col("model") * F.exp(x))


def neighbourhood_mean(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    """Mean of the 3 x 3 neighbourhood of each pair over present values; a mirrored pair only reaches targets near the
    diagonal, so nearly all pixels are sent out once."""
    ends = F.when(F.col("j") - F.col("i") <= 2, F.array(F.struct(F.col("i").alias("r"), F.col("j").alias("c")), F.struct(F.col("j").alias("r"), F.col("i").alias("c")))).otherwise(
        F.array(F.struct(F.col("i").alias("r"), F.col("j").alias("c"))))
    src = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), F.inline(ends))
    near = F.array(*[F.struct((F.col("r") + a).alias("i"), (F.col("c") + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    m = src.select(*by, "_v", F.inline(near)).filter(F.col("i") < F.col("j")).groupBy(*by, "i", "j").agg(F.avg("_v").alias(out))
    return df.join(m, [*by, "i", "j"], "left")


def correction_features(df: DataFrame, r_c: float, by: list[str] = ("unit",)) -> DataFrame:
    """Nine features of a pair (model, f, counts, sep, hic, n_eff, step): log separation, residuals of model and input, their
    3 x 3 means, log count, input kind, depth and step."""
    by = list(by)
    f = F.greatest(F.lit(1e-4), F.least(F.lit(0.999), F.col("f")))
    d = df.withColumns({"_m": F.when(F.col("model") > 0, F.ln("model")), "_s": F.greatest(F.col("sep").cast("double"), F.lit(1.0)),
                        "_i": F.when(F.col("f").isNotNull(), F.ln(median_distance(f, r_c)))})
    d = cut(trend_residual(trend_residual(d, by, "_m", "_s", "model_residual"), by, "_i", "_s", "input_residual"))
    d = neighbourhood_mean(neighbourhood_mean(d, by, "input_residual", "input_smooth"), by, "model_residual", "model_smooth")
    return d.select(*by, "i", "j", F.log10("_s").alias("log_sep"), "model_residual", "input_residual", "input_smooth", "model_smooth",
                    F.log1p(F.coalesce("counts", F.lit(0.0))).alias("log_count"), F.col("hic").cast("double").alias("hic"),
                    F.log10(F.greatest(F.col("n_eff").cast("double"), F.lit(1.0))).alias("depth"), F.log10(F.greatest(F.col("step").cast("double"), F.lit(1.0))).alias("step"))


def fit_correction(df: DataFrame, features: list[str], y: str, lam: float = 1.0, unit: list[str] = ("unit",)) -> DataFrame:
    return ridge_with_missing(df, features, F.col(y), list(unit), lam)
