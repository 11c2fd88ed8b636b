"""Bin grids, genome annotation per bin, and signal tracks on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..core import idiv
from ..functions.intervals import overlap_cells, points_in_intervals

# fixed values: standard bin sizes in bp, and the largest default number of bins
RESOLUTIONS = (5_000, 10_000, 20_000, 25_000, 40_000, 50_000, 100_000, 250_000, 500_000, 1_000_000)
MAX_BINS = 6_000


def bin_grid(chroms: DataFrame, resolution: int, by: list[str] = ("chrom",)) -> DataFrame:
    """Every bin of every chromosome (by, size): start, end, length; the last one may be shorter."""
    b = chroms.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), idiv(F.col("size") - 1, resolution))))
    start, end = F.col("bin") * resolution, F.least((F.col("bin") + 1) * resolution, F.col("size"))
    return b.select(*by, "bin", start.alias("start"), end.alias("end"), (end - start).alias("length"))


def _first_resolution(ok) -> F.Column:
    return F.coalesce(*[F.when(ok(r), F.lit(r).cast("long")) for r in RESOLUTIONS])


def default_resolution(chroms: DataFrame) -> DataFrame:
    """Finest standard resolution with at most 6,000 bins, else the coarsest."""
    pick = _first_resolution(lambda r: F.ceil(F.col("size") / r) <= MAX_BINS)
    return chroms.withColumn("resolution", F.coalesce(pick, F.lit(RESOLUTIONS[-1]).cast("long")))


def resolution_for_beads(chroms: DataFrame, beads: str = "beads") -> DataFrame:
    """Standard resolution giving exactly that many bins, else size / beads rounded up."""
    pick = _first_resolution(lambda r: F.ceil(F.col("size") / r) == F.col(beads))
    own = F.greatest(F.lit(1), F.ceil(F.col("size") / F.greatest(F.col(beads), F.lit(1)))).cast("long")
    return chroms.withColumn("resolution", F.coalesce(pick, own))


def gap_fraction(grid: DataFrame, gaps: DataFrame, resolution: int, by: list[str] = ("chrom",), max_gap: float = 0.5) -> DataFrame:
    """Share of each bin covered by assembly gaps, and whether the bin counts as assembled."""
    cells = overlap_cells(gaps, "gap_start", "gap_end", resolution).groupBy(*by, "bin").agg(F.sum("overlap").alias("_cov"))
    g = grid.join(cells, [*by, "bin"], "left")
    frac = F.coalesce(F.col("_cov"), F.lit(0)) / F.greatest(F.col("length"), F.lit(1))
    return g.withColumn("gap_fraction", frac).withColumn("assembled", F.col("gap_fraction") <= max_gap).drop("_cov")


def band_for_bins(grid: DataFrame, bands: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Cytoband holding the midpoint of each bin (bands: by, band_start, band_end, band)."""
    mids = grid.withColumn("_mid", idiv(F.col("start") + F.col("end"), 2))
    return points_in_intervals(mids, bands, list(by), "_mid", "band_start", "band_end").select(*grid.columns, "band")


def bin_intervals(intervals: DataFrame, chroms: DataFrame, resolution: int, how: str = "mean",
                  by: list[str] = ("chrom",)) -> DataFrame:
    """Interval records (by, start, end, value) -> one value per bin: length-weighted mean (NULL without data) or
    coverage sum / resolution (0 without data). Intervals are clipped to the chromosome."""
    clip = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("size")))      # noqa: E731
    iv = (intervals.filter(F.col("value").isNotNull()).join(chroms, list(by))
          .select(*by, clip("start").alias("start"), clip("end").alias("end"), "value").filter(F.col("end") > F.col("start")))
    per = overlap_cells(iv, "start", "end", resolution).groupBy(*by, "bin").agg(
        F.sum(F.col("value") * F.col("overlap")).alias("_s"), F.sum("overlap").alias("_c"))
    out = bin_grid(chroms, resolution, by).select(*by, "bin").join(per, [*by, "bin"], "left")
    value = F.col("_s") / F.col("_c") if how == "mean" else F.coalesce(F.col("_s"), F.lit(0.0)) / resolution
    return out.select(*by, "bin", value.alias("value"))


def binned_mean(signal: DataFrame, resolution: int, by: list[str] = ("chrom",), pos: str = "pos") -> DataFrame:
    """Mean of a per-base signal per bin, missing bases ignored."""
    return signal.groupBy(*by, idiv(F.col(pos), resolution).alias("bin")).agg(F.avg("value").alias("value"))


def share_into_loci(peaks: DataFrame, loci: DataFrame, width: int, by: list[str] = ("chrom",)) -> DataFrame:
    """Peak values shared into loci by overlap / peak width (peaks: by, start, end, value; loci: by, locus, pos)."""
    cells = overlap_cells(peaks.filter(F.col("end") > F.col("start")), "start", "end", width, "_cell").drop("overlap")
    spots = loci.withColumn("_cell", F.explode(F.sequence(idiv(F.col("pos"), width), idiv(F.col("pos") + width - 1, width))))
    hit = spots.join(cells, [*by, "_cell"])
    # a pair meeting in two cells counts once, in the cell where the overlap begins
    first = F.greatest(F.col("start"), F.col("pos"))
    ov = F.least(F.col("end"), F.col("pos") + width) - first
    hit = hit.filter((ov > 0) & (idiv(first, width) == F.col("_cell")))
    s = hit.groupBy(*by, "locus").agg(F.sum(F.col("value") * ov / (F.col("end") - F.col("start"))).alias("signal"))
    return loci.join(s, [*by, "locus"], "left").na.fill(0.0, ["signal"])
