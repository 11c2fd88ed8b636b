"""3D structures as bead tables (structure, bead, x, y, z): size, shape, scaling, neighbours, superposition.

Windows run along one chain; its number of beads is set by the chromosome, and structures are spread over tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..core import cut, idiv
from ..functions.blocks import distance_moments, log_distance_sums
from ..functions.groups import greedy
from ..functions.intervals import pair_tiles
from ..functions.ranks import top_k
from ..functions.stats import median, uniform
from .maps import log_grid

ONE = ("structure",)
XYZ = ["x", "y", "z"]
# fixed values: bond length of a 10 kb bead (nm), excluded diameter in bond lengths, contact / distance exponent,
# scaling exponents of the globule, the ideal chain and the self-avoiding walk
B0_NM, D_MIN_FACTOR, ALPHA = 50.0, 0.8, 3.0
NU_GLOBULE, NU_IDEAL, NU_SAW = 1.0 / 3.0, 0.5, 0.5876


def dist(a: str, b: str) -> Column:
    """Distance between coordinates with suffixes a and b."""
    return F.sqrt(sum((F.pow(F.col(c + a) - F.col(c + b), 2) for c in XYZ), F.lit(0.0)))


def bonds(beads: DataFrame, by: list[str] = ONE) -> DataFrame:
    w = W.partitionBy(*by).orderBy("bead")
    d = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in XYZ), F.lit(0.0)))
    return beads.withColumn("bond", d)


def size(beads: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Radius of gyration, end-to-end distance, median and mean bond."""
    ends = [F.struct(*XYZ)]
    s = bonds(beads, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("beads"), F.sqrt(sum((F.var_pop(c) for c in XYZ), F.lit(0.0))).alias("rg"),
        F.min_by(ends[0], "bead").alias("_a"), F.max_by(ends[0], "bead").alias("_b"), median("bond").alias("median_bond"), F.avg("bond").alias("mean_bond"))
    re = F.sqrt(sum((F.pow(F.col(f"_b.{c}") - F.col(f"_a.{c}"), 2) for c in XYZ), F.lit(0.0)))
    return s.select(*by, "beads", "rg", re.alias("end_to_end"), "median_bond", "mean_bond")


def bond_length_for(resolution: int, nu: float = 1.0 / 3.0) -> float:
    return B0_NM * (resolution / 10_000) ** nu


def calibrate(beads: DataFrame, b0: float = B0_NM, by: list[str] = ONE) -> DataFrame:
    """Coordinates scaled so that the median bond is b0; structures without a positive median bond are an error."""
    m = bonds(beads, by).groupBy(*by).agg(median("bond").alias("_m"))
    s = F.when(F.col("_m") > 0, b0 / F.col("_m")).otherwise(F.raise_error(F.lit("median bond length is zero or undefined")).cast("double"))
    return beads.join(m.select(*by, s.alias("scale")), list(by)).withColumns({c: F.col(c) * F.col("scale") for c in XYZ})


def mean_square_by_separation(beads: DataFrame, seps: Column, by: list[str] = ONE) -> DataFrame:
    """Root mean square distance at chosen separations (an array column over the bead count `n`)."""
    n = beads.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).withColumn("_s", seps)
    a = beads.join(n, list(by)).select(*by, "n", "bead", *[F.col(c).alias(f"{c}_a") for c in XYZ], F.explode("_s").alias("s"))
    b = beads.select(*by, F.col("bead").alias("_e"), *[F.col(c).alias(f"{c}_b") for c in XYZ])
    j = a.withColumn("_e", F.col("bead") + F.col("s")).join(b, [*by, "_e"])
    return j.groupBy(*by, "n", "s").agg(F.sqrt(F.avg(F.pow(dist("_a", "_b"), 2))).alias("r"))


def distance_scaling(beads: DataFrame, points: int = 40, by: list[str] = ONE) -> DataFrame:
    """RMS distance at up to `points` log-spaced separations."""
    return mean_square_by_separation(beads, log_grid(F.col("n") - 1, points), by)


def regime(nu: Column) -> Column:
    near = lambda ref: F.abs(nu - ref)                                  # noqa: E731
    least = F.least(near(NU_GLOBULE), near(NU_IDEAL), near(NU_SAW))
    name = (F.when(near(NU_GLOBULE) == least, "fractal globule").when(near(NU_IDEAL) == least, "ideal chain").otherwise("self-avoiding walk"))
    return (F.when(nu.isNull(), "undetermined").when(nu < 0.28, "saturated (confined / territory-limited)").when(least <= 0.05, name)
            .when(nu > NU_SAW, "stiff (persistence-dominated)").otherwise("intermediate"))


def scaling_fit(scaling: DataFrame, fit_range: tuple[int, int] | None = None, by: list[str] = ONE) -> DataFrame:
    """nu, its standard error and R2 of log r on log s over 4 ... n / 10 (or the given range); NULL with fewer than four
    separations or less than a factor five."""
    lo, hi = (F.lit(fit_range[0]), F.lit(fit_range[1])) if fit_range else (F.lit(4), F.greatest(F.lit(4), idiv("n", 10)))
    sel = (F.col("s") >= lo) & (F.col("s") <= hi)
    x, y = F.when(sel, F.ln("s")), F.when(sel, F.ln(F.greatest("r", F.lit(1e-12))))
    k, ok = F.count(x), (F.count(x) >= 4) & F.max(hi / F.greatest(lo, F.lit(1)) >= 5)
    sse = F.regr_syy(y, x) - F.pow(F.regr_sxy(y, x), 2) / F.regr_sxx(y, x)
    out = scaling.groupBy(*by).agg(F.when(ok, F.regr_slope(y, x)).alias("nu"),
                                   F.when(ok, F.sqrt(F.greatest(sse, F.lit(0.0)) / (k - 2) / F.regr_sxx(y, x))).alias("nu_se"),
                                   F.when(ok, F.regr_r2(y, x)).alias("r2"))
    return out.withColumn("regime", regime(F.col("nu")))


def log_distances(beads: DataFrame, s_min: int = 1, s_max: int | None = None, by: list[str] = ONE) -> DataFrame:
    """ln s and ln d of every pair in a separation window, all pairs instead of a sample."""
    p = pair_tiles(beads, list(by), "bead", XYZ, min_sep=s_min, max_sep=s_max)
    d = dist("_i", "_j")
    return p.select(*by, (F.col("j") - F.col("i")).alias("s"), F.when(d > 0, F.ln(d)).alias("ld")).filter(F.col("ld").isNotNull())


def _known(beads: DataFrame) -> DataFrame:
    return beads.filter(" AND ".join(f"{c} IS NOT NULL" for c in XYZ))


def decay_fit(beads: DataFrame, s_min: int = 1, s_max: int | None = None, by: list[str] = ONE) -> DataFrame:
    """Slope and fit of ln d on ln s over all pairs of a separation window, from sums per separation."""
    m = log_distance_sums(_known(beads), list(by), "bead", XYZ, s_min, s_max).withColumn("_l", F.ln("s"))
    c = m.groupBy(*by).agg(F.sum("k").alias("_n"), F.sum(F.col("k") * F.col("_l")).alias("_x"), F.sum(F.col("k") * F.col("_l") * F.col("_l")).alias("_xx"), F.sum("one").alias("_y"),
                           F.sum("two").alias("_yy"), F.sum(F.col("_l") * F.col("one")).alias("_xy"), ((F.sum("k") >= 3) & (F.min("s") < F.max("s"))).alias("_ok"))
    sxx, syy = F.col("_xx") - F.col("_x") * F.col("_x") / F.col("_n"), F.col("_yy") - F.col("_y") * F.col("_y") / F.col("_n")
    sxy = F.col("_xy") - F.col("_x") * F.col("_y") / F.col("_n")
    return c.select(*by, F.when(F.col("_ok"), sxy / sxx).alias("gamma"), F.when(F.col("_ok"), F.when(syy > 0, sxy * sxy / (sxx * syy)).otherwise(1.0)).alias("r2"))


def decay_bins(beads: DataFrame, by: list[str] = ONE, points: int = 30) -> DataFrame:
    """Geometric means of separation and distance in log-spaced separation classes."""
    p = cut(log_distance_sums(_known(beads), list(by), "bead", XYZ, 1, None))
    top = p.groupBy(*by).agg(F.max("s").alias("_top")).select(*by, log_grid(F.greatest(F.lit(2), F.col("_top")), points).alias("_e"))
    c = p.join(top, list(by)).withColumn("class", F.size(F.filter("_e", lambda e: e <= F.col("s"))))
    n = F.sum("k")
    return c.groupBy(*by, "class").agg(F.exp(F.sum(F.ln("s") * F.col("k")) / n).alias("s"), F.exp(F.sum("one") / n).alias("d"))


def gyration_shape(beads: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Eigenvalues of the gyration tensor (largest first, closed form of a symmetric 3 x 3 matrix), both asphericities, the
    relative anisotropy and the acylindricity."""
    cov = {a + b: F.covar_pop(a, b) for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    t = beads.groupBy(*by).agg(*[c.alias(k) for k, c in cov.items()])
    m = {k: F.col(k) for k in cov}
    q = (m["xx"] + m["yy"] + m["zz"]) / 3
    a, b, c = m["xx"] - q, m["yy"] - q, m["zz"] - q
    p = F.sqrt((a * a + b * b + c * c + 2 * (m["xy"] ** 2 + m["xz"] ** 2 + m["yz"] ** 2)) / 6)
    det = (a * (b * c - m["yz"] ** 2) - m["xy"] * (m["xy"] * c - m["yz"] * m["xz"]) + m["xz"] * (m["xy"] * m["yz"] - b * m["xz"]))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * p * p * p)))) / 3
    l1 = F.when(p > 0, q + 2 * p * F.cos(phi)).otherwise(q)
    l3 = F.when(p > 0, q + 2 * p * F.cos(phi + 2 * math.pi / 3)).otherwise(q)
    e = t.select(*by, l1.alias("l1"), (3 * q - l1 - l3).alias("l2"), l3.alias("l3"))
    x, y, z = F.col("l1"), F.col("l2"), F.col("l3")
    tr = x + y + z
    mean = tr / 3
    return e.select("*", F.when(tr > 0, (x - (y + z) / 2) / tr).alias("asphericity"),
                    F.when(tr > 0, 1.5 * ((x - mean) ** 2 + (y - mean) ** 2 + (z - mean) ** 2) / (tr * tr)).alias("asphericity_normed"),
                    F.when(tr > 0, 1 - 3 * (x * y + y * z + x * z) / (tr * tr)).alias("anisotropy"), (y - z).alias("acylindricity"))


def max_span(beads: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Exact diameter by a tree of boxes. A first bound is the distance from the bead furthest from the centre to the one
    furthest from it. Boxes of the beads are paired; a pair stays if its furthest corners are further apart than the bound,
    which nearest corners raise; the boxes that stay are halved in each direction until they hold at most SPAN_LEAF beads, and only
    the beads of the last pairs of boxes are compared."""
    by = list(by)
    allow = 1 - 1e-9                                              # keeps the outermost pair itself
    c = beads.groupBy(*by).agg(*[F.avg(k).alias(f"{k}_c") for k in XYZ])
    d = beads.join(c, by).withColumn("_r", F.sqrt(sum((F.pow(F.col(k) - F.col(f"{k}_c"), 2) for k in XYZ), F.lit(0.0))))
    far = d.groupBy(*by).agg(F.max("_r").alias("_rmax"), F.max_by(F.struct(*XYZ), F.struct("_r", F.negative("bead"))).alias("_far"))
    d = d.join(far, by).withColumn("_to", F.sqrt(sum((F.pow(F.col(k) - F.col(f"_far.{k}"), 2) for k in XYZ), F.lit(0.0))))
    best = cut(d.groupBy(*by).agg(F.max("_to").alias("_best"), F.max("_rmax").alias("_rmax"), *[F.min(k).alias(f"{k}_0") for k in XYZ],
                                  F.greatest(*[F.max(k) - F.min(k) for k in XYZ]).alias("_edge")))
    live = cut(d.drop("_rmax").join(best, by).filter((F.col("_r") + F.col("_rmax") > F.col("_best") * allow) & (F.col("_edge") > 0)).select(*by, *XYZ, "_edge", *[f"{k}_0" for k in XYZ]))
    place = lambda level: F.struct(*[F.floor(F.least((F.col(k) - F.col(f"{k}_0")) / F.col("_edge") * 2 ** level, F.lit(2.0 ** level - 1))).alias(k) for k in XYZ])      # noqa: E731
    box = [F.count(F.lit(1)).alias("n"), *[f(k).alias(f"{k}_{n}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))]]
    longest = lambda f: F.sqrt(sum((F.pow(f(k), F.lit(2)) for k in XYZ), F.lit(0.0)))                       # noqa: E731
    apart = lambda k: F.greatest(F.col(f"_i.{k}_hi") - F.col(f"_j.{k}_lo"), F.col(f"_j.{k}_hi") - F.col(f"_i.{k}_lo"))                     # noqa: E731
    gap = lambda k: F.greatest(F.col(f"_i.{k}_lo") - F.col(f"_j.{k}_hi"), F.col(f"_j.{k}_lo") - F.col(f"_i.{k}_hi"), F.lit(0.0))           # noqa: E731
    bound, level, pairs = best.select(*by, "_best"), 1, None
    while True:
        boxes = live.groupBy(*by, place(level - 1).alias("_up"), place(level).alias("_cell")).agg(*box)
        side = lambda k: boxes.select(*by, F.col("_up").alias(f"_up{k}"), F.col("_cell").alias(f"_cell{k}"), F.struct(*boxes.columns[-7:]).alias(k))      # noqa: E731, B023
        tried = side("_i").join(side("_j"), by).filter(F.col("_cell_i") <= F.col("_cell_j")) if pairs is None else pairs.join(side("_i"), [*by, "_up_i"]).join(side("_j"), [*by, "_up_j"])
        # parts of one box meet once, parts of two boxes as the boxes did
        tried = tried.filter((F.col("_up_i") != F.col("_up_j")) | (F.col("_cell_i") <= F.col("_cell_j"))).select(*by, "_cell_i", "_cell_j", longest(apart).alias("_most"), longest(gap).alias("_least"),
                                                                          F.greatest("_i.n", "_j.n").alias("_n"))
        tried = cut(tried)
        bound = cut(bound.join(tried.groupBy(*by).agg(F.max("_least").alias("_l")), by, "left").select(*by, F.greatest("_best", "_l").alias("_best")))
        kept = tried.join(bound, by).filter(F.col("_most") > F.col("_best") * allow)
        if level >= DEPTH or (kept.agg(F.max("_n")).first()[0] or 0) <= SPAN_LEAF:
            break
        pairs = kept.select(*by, F.col("_cell_i").alias("_up_i"), F.col("_cell_j").alias("_up_j"))
        level += 1
    own = lambda k: live.select(*by, place(level).alias(f"_cell{k}"), *[F.col(c).alias(f"{c}{k}") for c in XYZ])              # noqa: E731
    last = kept.select(*by, "_cell_i", "_cell_j").join(own("_i"), [*by, "_cell_i"]).join(own("_j"), [*by, "_cell_j"]).groupBy(*by).agg(F.max(dist("_i", "_j")).alias("_p"))
    return bound.join(last, by, "left").select(*by, F.greatest("_best", "_p").alias("span"))


LEAF, DEPTH = 256, 10            # beads of a leaf of the cell tree; halvings of a cell's edge
SPAN_LEAF = 64                   # beads of the last boxes of the diameter


def _cells(beads: DataFrame, r: float | Column, by: list[str], carry: list[str] = ()) -> DataFrame:
    """Beads with their radius and cubic cell of that edge, and the columns to carry."""
    rad = F.lit(float(r)) if isinstance(r, (int, float)) else r
    c = beads.withColumn("_rad", rad).filter(F.col("_rad") > 0)
    return c.select(*by, "bead", *XYZ, "_rad", *[F.floor(F.col(k) / F.col("_rad")).alias(f"c{k}") for k in XYZ], *carry)


def _crowded(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells with more beads than a leaf may have."""
    return cut(cells.groupBy(*by, "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > LEAF))


def _tree(cells: DataFrame, crowded: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Beads with `_leaf` (null outside crowded cells), and the leaves with their count and bounding box. A crowded cell is
    halved in each direction until a part has at most LEAF beads; beads that share one part at the last level are dealt to
    leaves of about that size by a hash. All levels are counted in one pass."""
    cell = [*by, "cx", "cy", "cz"]
    inside = cells.join(crowded.select(*cell), cell, "left_semi")
    place = [F.floor((F.col(k) / F.col("_rad") - F.col(f"c{k}")) * F.pow(F.lit(2.0), F.col("_level"))).alias(f"_{k}") for k in XYZ]
    parts = inside.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(DEPTH)))).select(*cell, "bead", *XYZ, "_level", F.struct("_level", *place).alias("_part"))
    sizes = parts.groupBy(*cell, "_part").agg(F.count(F.lit(1)).alias("_n"))
    fits = parts.join(sizes, [*cell, "_part"]).filter((F.col("_n") <= LEAF) | (F.col("_level") == DEPTH))
    own = fits.groupBy(*cell, "bead", *XYZ).agg(F.min_by(F.struct("_part", "_n"), "_level").alias("_p"))
    share = F.pmod(F.xxhash64("bead", *XYZ), F.ceil(F.col("_p._n") / LEAF).cast("bigint"))
    own = cut(own.select(*cell, "bead", *XYZ, F.struct(F.col("_p._part").alias("part"), share.alias("share")).alias("_leaf")))
    boxes = own.groupBy(*cell, "_leaf").agg(F.count(F.lit(1)).alias("_n"), *[f(k).alias(f"_{k}_{n}") for k in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    return cells.join(own, [*cell, "bead", *XYZ], "left"), boxes


def _surrounding(cells: DataFrame, by: list[str], all_sides: bool, carry: list[str] = ()) -> DataFrame:
    """Each bead at the cells around its own; without `all_sides` each pair of cells is visited once."""
    steps = [(a, b, g) for a in (-1, 0, 1) for b in (-1, 0, 1) for g in (-1, 0, 1) if all_sides or (a, b, g) >= (0, 0, 0)]
    around = F.array(*[F.struct((F.col("cx") + a).alias("cx"), (F.col("cy") + b).alias("cy"), (F.col("cz") + g).alias("cz"),
                                F.lit((a, b, g) == (0, 0, 0)).alias("own")) for a, b, g in steps])
    return cells.select(*by, F.col("bead").alias("_a"), *[F.col(k).alias(f"{k}_a") for k in (*XYZ, *carry)], "_rad", F.inline(around))


def _met(cells: DataFrame, by: list[str], carry: list[str] = ()) -> DataFrame:
    leaf = ["_leaf"] if "_leaf" in cells.columns else []
    return cells.select(*by, F.col("bead").alias("_b"), *[F.col(k).alias(f"{k}_b") for k in (*XYZ, *carry)], "cx", "cy", "cz", *leaf)


def _at_leaves(left: DataFrame, boxes: DataFrame, cell: list[str]) -> DataFrame:
    """Beads at the leaves of crowded cells that reach into their radius, `_whole` where the leaf lies within it; beads at
    other cells once, with a null leaf."""
    near = lambda k: F.greatest(F.col(f"_{k}_lo") - F.col(f"{k}_a"), F.col(f"{k}_a") - F.col(f"_{k}_hi"), F.lit(0.0))              # noqa: E731
    far = lambda k: F.greatest(F.col(f"_{k}_hi") - F.col(f"{k}_a"), F.col(f"{k}_a") - F.col(f"_{k}_lo"))                          # noqa: E731
    length = lambda f: F.sqrt(sum((F.pow(f(k), F.lit(2)) for k in XYZ), F.lit(0.0)))                                              # noqa: E731
    margin = 1e-9                                                # what rounding could decide is left to the beads themselves
    joined = left.join(boxes, cell, "left").filter(F.col("_leaf").isNull() | (length(near) < F.col("_rad") * (1 + margin)))
    return joined.withColumn("_whole", F.col("_leaf").isNotNull() & (length(far) < F.col("_rad") * (1 - margin))).drop(*[f"_{k}_{n}" for k in XYZ for n in ("lo", "hi")])


def _beads_of_leaves(left: DataFrame, right: DataFrame, cell: list[str], carry: list[str] = ()) -> DataFrame:
    met = F.col("l._leaf").eqNullSafe(F.col("r._leaf"))
    for k in cell:
        met = met & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    return left.alias("l").join(right.alias("r"), met).select("l.*", "_b", *[f"{k}_b" for k in (*XYZ, *carry)])


def neighbor_pairs(beads: DataFrame, r: float | Column, min_sep: int = 2, by: list[str] = ONE, carry: list[str] = ()) -> DataFrame:
    """Pairs i < j with j - i >= min_sep closer than r (a number, or a column of the bead table): beads meet through cubic
    cells of edge r; of the 27 surrounding cells each pair of cells is visited once. Crowded cells are split into a tree, so
    that a bead meets only leaves within its reach and a join key never holds more than a leaf. Columns of `carry` travel with
    the beads and come back as c_i and c_j, so that pairs need not be joined with them."""
    by = list(by)
    cell = [*by, "cx", "cy", "cz"]
    c = _cells(beads, r, by, carry)
    crowded = _crowded(c, by)
    if crowded.isEmpty():
        met = _surrounding(c, by, False, carry).join(_met(c, by, carry), cell)
    else:
        tagged, boxes = _tree(c, crowded, by)
        met = _beads_of_leaves(_at_leaves(_surrounding(c, by, False, carry), boxes, cell), _met(tagged, by, carry), cell, carry)
    d = dist("_a", "_b")
    hit = met.filter((~F.col("own") | (F.col("_a") < F.col("_b"))) & (d < F.col("_rad")) & (F.abs(F.col("_a") - F.col("_b")) >= min_sep))
    of = lambda k, lower: F.when((F.col("_a") < F.col("_b")) == F.lit(lower), F.col(f"{k}_a")).otherwise(F.col(f"{k}_b"))          # noqa: E731
    return hit.select(*by, F.least("_a", "_b").alias("i"), F.greatest("_a", "_b").alias("j"), d.alias("d"), *[of(k, low).alias(f"{k}_{n}") for k in carry for n, low in (("i", True), ("j", False))])


def neighbor_counts(beads: DataFrame, r: float | Column, min_sep: int = 2, by: list[str] = ONE) -> DataFrame:
    """(by, bead, density) of the beads that have neighbours as in `neighbor_pairs`. In crowded cells a leaf within reach
    counts as a whole and no pair is made; the beads closer than min_sep on the chain are counted apart and taken off."""
    by = list(by)
    cell = [*by, "cx", "cy", "cz"]
    c = _cells(beads, r, by)
    crowded = _crowded(c, by)
    if crowded.isEmpty():
        p = neighbor_pairs(beads, r, min_sep, by)
        return p.select(*by, F.explode(F.array("i", "j")).alias("bead")).groupBy(*by, "bead").agg(F.count(F.lit(1)).alias("density"))
    tagged, boxes = _tree(c, crowded, by)
    at = _at_leaves(_surrounding(c, by, True), boxes, cell)
    near = dist("_a", "_b") < F.col("_rad")
    one = F.lit(1).cast("bigint")
    whole = at.filter("_whole").groupBy(*by, "_a").agg(F.sum("_n").alias("_k"))
    single = _beads_of_leaves(at.filter("NOT _whole"), _met(tagged, by), cell).filter(near).groupBy(*by, "_a").agg(F.count(one).alias("_k"))
    steps = F.transform(F.sequence(F.lit(1 - min_sep), F.lit(min_sep - 1)), lambda k: F.col("_a") + k)
    chain = _surrounding(c, by, False).filter("own").drop("cx", "cy", "cz").withColumn("_b", F.explode(steps))
    chain = chain.join(_met(c, by).drop("cx", "cy", "cz"), [*by, "_b"]).filter(near).groupBy(*by, "_a").agg((-F.count(one)).alias("_k"))
    counted = whole.unionByName(single).unionByName(chain).groupBy(*by, F.col("_a").alias("bead")).agg(F.sum("_k").alias("density"))
    return counted.filter("density > 0")


def proximity_contacts(beads: DataFrame, b0: float, radius_b0: float = 1.5, by: list[str] = ONE) -> DataFrame:
    return neighbor_pairs(beads, radius_b0 * b0, 1, by).select(*by, "i", "j", F.lit(1.0).alias("cnt"))


def local_density(beads: DataFrame, r: float | Column, min_sep: int = 2, by: list[str] = ONE) -> DataFrame:
    """Non-bonded beads within r of each bead, zeros included."""
    k = neighbor_counts(beads, r, min_sep, by)
    return beads.join(k, [*by, "bead"], "left").na.fill(0, ["density"])


def overlaps(beads: DataFrame, b0: float = B0_NM, d_min: float | None = None, tolerance: float | None = None, by: list[str] = ONE) -> DataFrame:
    """Non-bonded pairs inside the excluded diameter: penalty, counted overlaps, deepest overlap, smallest distance."""
    d_min = D_MIN_FACTOR * b0 if d_min is None else d_min
    tol = 0.02 * b0 if tolerance is None else tolerance
    pen = d_min - F.col("d")
    s = neighbor_pairs(beads, d_min, 2, by).groupBy(*by).agg(F.sum(F.pow(pen / b0, F.lit(2))).alias("_p"), F.count_if(pen > tol).alias("overlaps"),
                                                            F.max(pen).alias("deepest"), F.min("d").alias("closest"))
    n = beads.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return n.join(s, list(by), "left").select(*by, (F.coalesce("_p", F.lit(0.0)) / F.col("_n")).alias("penalty"),
                                              F.coalesce("overlaps", F.lit(0)).alias("overlaps"), F.coalesce("deepest", F.lit(0.0)).alias("deepest"), "closest")


def distance_correlation(a: DataFrame, b: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Correlation of the distances of all pairs of beads in two conformations."""
    by = list(by)
    side = lambda x, k: _known(x).select(*by, "bead", *[F.col(c).alias(f"{c}{k}") for c in XYZ])              # noqa: E731
    both = side(a, 1).join(side(b, 2), [*by, "bead"])
    return distance_moments(both, by, "bead", [f"{c}1" for c in XYZ], [f"{c}2" for c in XYZ])


def rotation(moments: DataFrame, allow_reflection: bool = True) -> DataFrame:
    """3 x 3 rotation (row-major array `rot`) from the nine cross moments in array `h`; one small matrix per structure."""
    @F.pandas_udf(ArrayType(DoubleType()))
    def best(h: pd.Series) -> pd.Series:
        u, _, vt = np.linalg.svd(np.stack(h.to_list()).reshape(-1, 3, 3))
        rot = u @ vt
        if not allow_reflection:
            flip = np.linalg.det(rot) < 0
            u[flip, :, -1] *= -1
            rot = u @ vt
        return pd.Series(list(rot.reshape(-1, 9)))
    return moments.withColumn("rot", best("h"))


def superpose(mobile: DataFrame, reference: DataFrame, by: list[str] = ONE, on: list[str] = ("bead",), allow_reflection: bool = True) -> DataFrame:
    """Mobile beads rotated onto the reference: (by, on, x, y, z, x_ref, y_ref, z_ref). `reference` shares the columns `on`
    and those of `by` it has."""
    by, on = list(by), list(on)
    keys = [k for k in [*by, *on] if k in reference.columns]
    both = mobile.select(*by, *on, *XYZ).join(reference.select(*keys, *[F.col(c).alias(f"{c}_ref") for c in XYZ]), keys)
    h = [F.covar_pop(a, f"{b}_ref") for a in XYZ for b in XYZ]
    mom = both.groupBy(*by).agg(F.array(*h).alias("h"), *[F.avg(c).alias(f"_{c}") for c in XYZ], *[F.avg(f"{c}_ref").alias(f"_{c}_ref") for c in XYZ])
    d = both.join(rotation(mom, allow_reflection), by)
    new = {c: sum(((F.col(a) - F.col(f"_{a}")) * F.col("rot")[3 * k + m] for k, a in enumerate(XYZ)), F.lit(0.0)) + F.col(f"_{c}_ref")
           for m, c in enumerate(XYZ)}
    return d.select(*by, *on, *[new[c].alias(c) for c in XYZ], *[f"{c}_ref" for c in XYZ])


def superposed_rmsd(mobile: DataFrame, reference: DataFrame, by: list[str] = ONE, **kw) -> DataFrame:
    d2 = sum((F.pow(F.col(c) - F.col(f"{c}_ref"), 2) for c in XYZ), F.lit(0.0))
    return superpose(mobile, reference, by, **kw).groupBy(*by).agg(F.sqrt(F.avg(d2)).alias("rmsd"))


def coarse_distance_map(beads: DataFrame, max_px: int = 400, by: list[str] = ONE) -> DataFrame:
    """Distances between block centroids, at most max_px full blocks a side (the rest forms one more block)."""
    by = list(by)
    n = beads.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*by, F.greatest(F.lit(1), F.ceil(F.col("_n") / max_px)).cast("long").alias("k"))
    pooled = beads.join(n, by).groupBy(*by, "k", idiv(F.col("bead"), F.col("k")).alias("block")).agg(*[F.avg(c).alias(c) for c in XYZ])
    return pair_tiles(pooled, by, "block", XYZ).select(*by, "i", "j", dist("_i", "_j").alias("distance"))


def block_mean(pairs: DataFrame, k: int, by: list[str], value: str = "value") -> DataFrame:
    """k x k block means of a pair map over present values."""
    return pairs.groupBy(*by, idiv(F.col("i"), k).alias("i"), idiv(F.col("j"), k).alias("j")).agg(F.avg(value).alias(value))


def frame_metrics(frames: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Per frame: radius of gyration, end-to-end distance, RMSD to frame 0 (no superposition), median bond."""
    key = [*by, "frame"]
    first = frames.filter("frame = 0").select(*by, "bead", *[F.col(c).alias(f"{c}0") for c in XYZ])
    d2 = sum((F.pow(F.col(c) - F.col(f"{c}0"), 2) for c in XYZ), F.lit(0.0))
    moved = frames.join(first, [*by, "bead"]).groupBy(*key).agg(F.sqrt(F.avg(d2)).alias("rmsd"), F.sqrt(F.max(d2)).alias("max_displacement"))
    return size(frames, key).drop("beads", "mean_bond").join(moved, key)


def rmsf(members: DataFrame, by: list[str] = ONE, member: str = "member") -> DataFrame:
    """Fluctuation of each bead after superposing every member on the first one."""
    by = list(by)
    first = members.join(members.groupBy(*by).agg(F.min(member).alias(member)), [*by, member], "left_semi").select(*by, "bead", *XYZ)
    s = superpose(members, first, [*by, member], allow_reflection=False)
    return s.groupBy(*by, "bead").agg(F.sqrt(sum((F.var_pop(c) for c in XYZ), F.lit(0.0))).alias("rmsf"))


def checks(beads: DataFrame, sizes: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Structures that cannot be used, with the reason (sizes: by, start_bin, bins)."""
    bad = sum((F.when(F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), 1).otherwise(0) for c in XYZ), F.lit(0))
    s = beads.groupBy(*by).agg(F.count(F.lit(1)).alias("beads"), F.sum(bad).alias("missing")).join(sizes, list(by), "left")
    out = F.when(F.col("beads") < 4, "fewer than 4 beads").when(F.col("missing") > 0, "missing or infinite coordinates").when(
        F.col("bins").isNull(), "unknown chromosome").when((F.col("start_bin") < 0) | (F.col("start_bin") + F.col("beads") > F.col("bins")), "bins outside the chromosome")
    return s.select(*by, "beads", out.alias("reason")).filter(F.col("reason").isNotNull())


def frame_checks(bundle: DataFrame, frames: DataFrame, by: list[str] = ONE) -> DataFrame:
    """Structures whose number of frame labels or times differs from their number of frames."""
    a = bundle.groupBy(*by).agg(F.countDistinct("frame").alias("frames"))
    b = frames.groupBy(*by).agg(F.count("time").alias("times"), F.count("label").alias("labels"))
    return a.join(b, list(by), "left").na.fill(0, ["times", "labels"]).filter((F.col("frames") != F.col("times")) | (F.col("frames") != F.col("labels")))


def spaced_top(df: DataFrame, by: list[str], score: str, k: int, spacing: int, coord: str = "bead") -> DataFrame:
    """The k best-scoring places at least `spacing` apart."""
    return top_k(greedy(df, list(by), [coord], [spacing - 1], score), list(by), [F.desc(score), F.asc(coord)], k)


def best_window(scores: DataFrame, width: int, by: list[str] = ONE) -> DataFrame:
    """Window of `width` beads with the largest total score (the whole chain when it is shorter); the first one on ties."""
    ahead = F.sum(F.coalesce("score", F.lit(0.0))).over(W.partitionBy(*by).orderBy("bead").rowsBetween(0, width - 1))
    n = F.count(F.lit(1)).over(W.partitionBy(*by))
    s = scores.select(*by, "bead", ahead.alias("_s"), n.alias("_n")).filter((F.col("bead") + width <= F.col("_n")) | (F.col("bead") == 0))
    best = s.groupBy(*by).agg(F.max_by("bead", F.struct(F.round("_s", 9), F.negative("bead"))).alias("start"), F.max("_n").alias("_n"))
    return best.select(*by, F.when(F.col("_n") <= width, 0).otherwise(F.col("start")).alias("start"),
                       F.least(F.col("_n"), F.when(F.col("_n") <= width, F.col("_n")).otherwise(F.col("start") + width)).alias("end"))
