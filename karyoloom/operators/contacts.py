"""Contact tables: binning, canonical form, coarsening, windows, irregular loci (keyed by sample and chromosome)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import MAP, idiv
from ..functions.intervals import last_before, points_in_intervals

FACTORS = (1, 2, 5, 10, 25)
PIXEL = ["i", "j"]


def ordered(df: DataFrame, a: str = "i", b: str = "j") -> DataFrame:
    """Upper triangle: i <= j."""
    return df.withColumns({"i": F.least(a, b), "j": F.greatest(a, b)})


def bin_pairs(pairs: DataFrame, resolution: int, by: list[str] = ("sample",)) -> DataFrame:
    """Cis read pairs -> contacts (by, chrom, i, j, cnt) of the whole genome. Counting is combined map-side, so a hot
    pixel costs one row per task."""
    cis = pairs.filter(F.col("chrom1") == F.col("chrom2"))
    binned = cis.select(*by, F.col("chrom1").alias("chrom"), idiv("pos1", resolution).alias("a"),
                        idiv("pos2", resolution).alias("b"))
    return ordered(binned, "a", "b").groupBy(*by, "chrom", "i", "j").agg(F.count(F.lit(1)).cast("double").alias("cnt"))


def bin_pairs_in_regions(pairs: DataFrame, regions: DataFrame, resolution: int, by: list[str] = ("sample",)) -> DataFrame:
    """Contacts of `regions` (region, chrom, start, end): both ends inside, bins counted from start div resolution."""
    cis = pairs.filter(F.col("chrom1") == F.col("chrom2")).withColumn("chrom", F.col("chrom1"))
    inside = points_in_intervals(cis.withColumn("_first", F.least("pos1", "pos2")), regions, ["chrom"], "_first").filter(
        F.greatest("pos1", "pos2") < F.col("end"))
    lo = idiv("start", resolution)
    binned = inside.select(*by, "region", "chrom", (idiv("pos1", resolution) - lo).alias("a"),
                           (idiv("pos2", resolution) - lo).alias("b"))
    return ordered(binned, "a", "b").groupBy(*by, "region", "chrom", "i", "j").agg(
        F.count(F.lit(1)).cast("double").alias("cnt"))


def sum_contacts(df: DataFrame, by: list[str] = MAP, n: int | None = None) -> DataFrame:
    """Duplicates and mirror images summed, diagonal and non-positive counts dropped (text tables, coarser maps)."""
    ok = ordered(df).filter((F.col("i") != F.col("j")) & (F.col("i") >= 0) & (F.col("cnt") > 0))
    if n is not None:
        ok = ok.filter(F.col("j") < n)
    return ok.groupBy(*by, "i", "j").agg(F.sum("cnt").alias("cnt"))


def canonical(df: DataFrame, by: list[str] = MAP, min_sep: int = 1, n: int | None = None) -> DataFrame:
    """Duplicates and mirror images keep the larger count; only j - i >= min_sep stays."""
    ok = ordered(df).filter((F.col("j") - F.col("i") >= max(1, min_sep)) & (F.col("i") >= 0) & (F.col("cnt") > 0))
    if n is not None:
        ok = ok.filter(F.col("j") < n)
    return ok.groupBy(*by, "i", "j").agg(F.max("cnt").alias("cnt"))


def pixels_to_contacts(pixels: DataFrame, bins: DataFrame, resolution: int | None = None, by: list[str] = ("sample",)) -> DataFrame:
    """Cooler-style pixels (bin1_id, bin2_id, count) with bins (bin_id, chrom, start, end) -> cis contacts; at the own
    resolution duplicates keep the maximum, at a coarser one (must divide) they are summed."""
    own = bins.agg(F.max(F.col("end") - F.col("start"))).first()[0]       # one number of a dimension table
    resolution = resolution or own
    if resolution % own:
        raise ValueError(f"Bins of {own} bp cannot be summed to {resolution} bp.")
    b = lambda k: bins.select(F.col("bin_id").alias(f"bin{k}_id"), F.col("chrom").alias(f"c{k}"),
                              idiv("start", resolution).alias(f"x{k}"))
    cis = (pixels.join(b(1), "bin1_id").join(b(2), "bin2_id").filter(F.col("c1") == F.col("c2"))
           .select(*by, F.col("c1").alias("chrom"), F.col("x1").alias("i"), F.col("x2").alias("j"),
                   F.col("count").cast("double").alias("cnt")))
    return (canonical if resolution == own else sum_contacts)(cis, [*by, "chrom"])


def coarsen(contacts: DataFrame, k: int, by: list[str] = MAP, sizes: DataFrame | None = None) -> DataFrame:
    """Sum k x k blocks. With `sizes` (by, n) the incomplete last block is dropped, without it it is kept."""
    c = contacts.withColumns({"i": idiv("i", k), "j": idiv("j", k)})
    if sizes is not None:
        c = c.join(sizes, list(by)).filter(F.col("j") < idiv("n", k))
    return c.groupBy(*by, "i", "j").agg(F.sum("cnt").alias("cnt"))


def coarsen_windows(contacts: DataFrame, windows: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Sums of k x k blocks of windows (window, by, lo, hi, k); both triangles are returned."""
    c = (points_in_intervals(contacts, windows, list(by), "i", "lo", "hi").filter(F.col("j") < F.col("hi"))
         .groupBy("window", *by, "k", idiv(F.col("i") - F.col("lo"), F.col("k")).alias("i"),
                  idiv(F.col("j") - F.col("lo"), F.col("k")).alias("j")).agg(F.sum("cnt").alias("cnt")))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return c.select("window", *by, "k", "cnt", F.inline(both))


def pyramid(contacts: DataFrame, base: int, factors: tuple[int, ...] = FACTORS, by: list[str] = MAP,
            weights: DataFrame | None = None) -> DataFrame:
    """All resolutions of a map in one pass (by, resolution, i, j, cnt); partial sums shrink the copies map-side. With
    balancing weights (by, bin, weight) the pixels of the base resolution carry those of their bins, others NULL."""
    c = contacts.withColumn("_f", F.explode(F.array(*[F.lit(f).cast("long") for f in factors])))
    out = (c.groupBy(*by, (F.col("_f") * base).alias("resolution"), idiv(F.col("i"), F.col("_f")).alias("i"),
                     idiv(F.col("j"), F.col("_f")).alias("j")).agg(F.sum("cnt").alias("cnt")))
    if weights is None:
        return out
    end = lambda k: weights.select(*by, F.lit(base).cast("long").alias("resolution"), F.col("bin").alias(k), F.col("weight").alias(f"weight_{k}"))
    return out.join(end("i"), [*by, "resolution", "i"], "left").join(end("j"), [*by, "resolution", "j"], "left")


def pick_resolution(available: DataFrame, requested: int, by: list[str] = ("file",)) -> DataFrame:
    """Coarsest stored resolution that divides the request (itself when present); NULL when none does."""
    ok = F.when(F.lit(requested) % F.col("resolution") == 0, F.col("resolution"))
    return available.groupBy(*by).agg(F.max(ok).alias("resolution"))


def window_slice(contacts: DataFrame, windows: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Contacts of each window (window, by, bin0, n) in window-local bins: both ends inside, no diagonal."""
    shown = ordered(contacts.select(*by, "i", "j", "cnt")).filter((F.col("i") != F.col("j")) & (F.col("cnt") > 0))
    spans = windows.select(*by, "window", "bin0", (F.col("bin0") + F.col("n")).alias("_end"))
    hit = points_in_intervals(shown, spans, list(by), "i", "bin0", "_end").filter(F.col("j") < F.col("_end"))
    return hit.select("window", *by, (F.col("i") - F.col("bin0")).alias("i"), (F.col("j") - F.col("bin0")).alias("j"), "cnt")


def track_slice(track: DataFrame, windows: DataFrame, by: list[str] = MAP) -> DataFrame:
    spans = windows.withColumn("_end", F.col("bin0") + F.col("n"))
    return points_in_intervals(track, spans, list(by), "bin", "bin0", "_end").withColumn("bin", F.col("bin") - F.col("bin0")).drop("bin0", "n", "_end")


def clamp_region(df: DataFrame, size: str, start: str = "start", end: str = "end", min_size: int = 1) -> DataFrame:
    """Half-open regions pushed inside [0, size), at least `min_size` long where the axis allows; swapped ends are put right."""
    least = F.greatest(F.lit(1), F.least(F.lit(min_size), F.col(size)))
    lo, hi = F.least(start, end), F.greatest(start, end)
    a = F.greatest(F.lit(0), F.least(lo, F.col(size) - least))
    return df.withColumns({start: a, end: F.greatest(a + least, F.least(hi, F.col(size)))})


def validate(contacts: DataFrame, sizes: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Violation counts per map: negative or out-of-range indices, missing or non-finite counts, negative counts."""
    bad_index = (F.col("i") < 0) | (F.col("j") < 0) | (F.col("i") >= F.col("n")) | (F.col("j") >= F.col("n"))
    not_finite = F.col("cnt").isNull() | F.isnan("cnt") | F.col("cnt").isin(float("inf"), float("-inf"))
    return contacts.join(sizes, list(by), "left").groupBy(*by).agg(
        F.count(F.lit(1)).alias("pixels"), F.count_if(bad_index).alias("bad_index"),
        F.count_if(not_finite).alias("not_finite"), F.count_if(F.col("cnt") < 0).alias("negative"))


def window_mismatch(windows: DataFrame, by: list[str] = ("chrom",)) -> DataFrame:
    """Groups of replicates whose windows differ (they cannot be compared)."""
    return windows.groupBy(*by).agg(F.countDistinct("start", "n", "resolution").alias("windows")).filter("windows > 1")


def sum_to_loci(contacts: DataFrame, loci: DataFrame, binsize: int, by: list[str] = MAP) -> DataFrame:
    """Fine contacts onto irregular loci (by, locus, start, stop): a fine bin belongs to the last locus starting at or
    before its midpoint, up to the end of the last locus. Full square without mirror duplicates: i <= j loci."""
    mids = contacts.select(*by, F.col("i").alias("bin")).union(contacts.select(*by, F.col("j").alias("bin"))).distinct()
    mids = mids.withColumn("mid", F.col("bin") * binsize + binsize // 2)
    stop = loci.groupBy(*by).agg(F.max("stop").alias("stop"))
    place = (last_before(mids, loci.select(*by, "locus", "start"), list(by), "mid", "start").join(stop, list(by))
             .filter(F.col("locus").isNotNull() & (F.col("mid") < F.col("stop"))).select(*by, "bin", "locus"))
    side = lambda k: place.select(*by, F.col("bin").alias(k), F.col("locus").alias(f"l{k}"))     # noqa: E731
    c = contacts.join(side("i"), [*by, "i"]).join(side("j"), [*by, "j"])
    return (c.groupBy(*by, F.least("li", "lj").alias("a"), F.greatest("li", "lj").alias("b")).agg(F.sum("cnt").alias("cnt")))


def strongest(contacts: DataFrame, by: list[str] = MAP, k: int = 8) -> DataFrame:
    """Each bin's k strongest partners, from either side of the diagonal."""
    both = contacts.select(*by, F.col("i").alias("bin"), F.col("j").alias("partner"), "cnt").unionByName(
        contacts.select(*by, F.col("j").alias("bin"), F.col("i").alias("partner"), "cnt"))
    w = W.partitionBy(*by, "bin").orderBy(F.desc("cnt"), "partner")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
