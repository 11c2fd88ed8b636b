"""Matrix balancing of all maps at once.

Every round needs one join (block of partner bins -> their bias) and one aggregation. The mirrored pixels are written once, in
tiles of SIDE x SIDE bins that are hashed by their join key, so a round shuffles bias values and row sums but never the pixels;
the sums of a map of up to SIDE bins are complete in one task. Rounds are grouped between checkpoints. A map that has converged is set aside, so its weights do not depend on the other maps of the job; a map that
does not converge within the rounds it is given gets no weights, and the report says so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import MAP, cut, cut_as_dealt, idiv
from .maps import balanced, bins_of, median_scale, mirrored


SIDE = 256                # bins along a side of a tile of pixels


def _row_sums(px: DataFrame, bias: DataFrame, by: list[str], power: int) -> DataFrame:
    """(by, bin, b, _s): each bin's own value and the sum over partners of cnt * b(partner)^power, for the bins of `bias`. The
    tiles carry one empty self pixel per bin, so the own value comes with the same join and the plan stays linear in the rounds."""
    entry = F.struct(F.pmod("bin", F.lit(SIDE)).alias("at"), "b")
    held = bias.groupBy(*by, idiv("bin", SIDE).alias("_block")).agg(F.array_sort(F.collect_list(entry)).alias("_e"))            # at most SIDE entries
    # a value at the place of each bin of the block, NULL for those that are not balanced
    before = lambda k: F.coalesce(F.get(F.col("_e"), k - 1)["at"], F.lit(-1))                           # noqa: E731
    dense = F.flatten(F.transform("_e", lambda e, k: F.concat(F.array_repeat(F.lit(None).cast("double"), (e["at"] - before(k) - 1).cast("int")), F.array(e["b"]))))
    v = px.join(held.select(*by, "_block", dense.alias("_b")), [*by, "_block"]).select(*by, "_block", "_to", "_b", F.inline(F.arrays_zip("cell", "cnt")))
    cell = F.col("cell").cast("int") + SIDE * SIDE // 2
    v = v.select(*by, (F.col("_to") * SIDE + F.floor(cell / SIDE)).alias("bin"), (F.col("_block") * SIDE + cell % SIDE).alias("partner"), "cnt", F.get("_b", cell % SIDE).alias("b"))
    s = v.groupBy(*by, "bin").agg(F.max(F.when(F.col("bin") == F.col("partner"), F.col("b"))).alias("b"),
                                  F.sum(F.col("cnt") * F.pow("b", F.lit(power))).alias("_s"))
    return s.filter(F.col("b").isNotNull())


def _prepare(px: DataFrame, good: DataFrame, by: list[str]) -> DataFrame:
    """(by, _block, _to, cell, cnt): the pixels between block _block of partners and block _to of bins as arrays. Pixels of other
    bins than the good ones stay: they meet no value and add nothing."""
    own = good.select(*by, "bin", F.col("bin").alias("partner"), F.lit(0.0).alias("cnt"))
    cell = (F.pmod("bin", F.lit(SIDE)) * SIDE + F.pmod("partner", F.lit(SIDE)) - SIDE * SIDE // 2).cast("short")
    t = px.select(*by, "bin", "partner", F.coalesce("cnt", F.lit(0.0)).cast("double").alias("cnt")).unionByName(own).select(
        *by, idiv("partner", SIDE).alias("_block"), idiv("bin", SIDE).alias("_to"), F.struct(cell.alias("cell"), "cnt").alias("_p"))
    tiles = t.repartition(*by, "_block").groupBy(*by, "_block", "_to").agg(F.collect_list("_p").alias("_p"))       # at most SIDE^2 pixels
    return cut_as_dealt(tiles.select(*by, "_block", "_to", "_p.cell", "_p.cnt"))


def _keep_pixels(px: DataFrame, good: DataFrame, by: list[str]) -> DataFrame:
    g = good.select(*by, "bin")
    return px.join(g, [*by, "bin"], "left_semi").join(g.withColumnRenamed("bin", "partner"), [*by, "partner"], "left_semi")


def ice_mask(px: DataFrame, min_nnz: int, mad_max: float, by: list[str]) -> DataFrame:
    """Bins worth balancing: enough non-zero pixels, log coverage not far below the median, both again among the kept."""
    st = px.groupBy(*by, "bin").agg(F.sum("cnt").alias("cov"), F.count_if(F.col("cnt") > 0).alias("nnz"))
    good = st.filter((F.col("nnz") >= min_nnz) & (F.col("cov") > 0)).withColumn("_l", F.ln("cov"))
    # bins of one map: bounded by the chromosome length
    m = good.groupBy(*by).agg(F.percentile("_l", F.lit(0.5)).alias("_m"), F.count(F.lit(1)).alias("_k"))
    d = good.join(m, by)
    mad = d.groupBy(*by).agg(F.percentile(F.abs(F.col("_l") - F.col("_m")), F.lit(0.5)).alias("_mad"))
    low = (F.lit(mad_max) > 0) & (F.col("_k") >= 3) & (F.col("_mad") > 0) & (F.col("_l") < F.col("_m") - mad_max * F.col("_mad"))
    good = cut(d.join(mad, by).filter(~low).select(*by, "bin"))
    size = good.count()
    while True:
        live = _keep_pixels(px.filter("cnt > 0"), good, by).groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("nnz"))
        good = cut(live.filter(F.col("nnz") >= min_nnz).select(*by, "bin"))
        new = good.count()
        if new == size:
            return good
        size = new


def _until_settled(start: DataFrame, step, by: list[str], tol: float, max_iter: int, rounds: int) -> DataFrame:
    """Repeat `step` on (by, bin, b); it adds _e, the error of each bin or of its map. Returns the last state of every map with
    converged and iterations; maps leave when their largest error is below `tol`."""
    live, out, done = start, None, 0
    while done < max_iter:
        for _ in range(min(rounds, max_iter - done)):
            live = step(live)
            done += 1
        ok = F.coalesce(F.max("_e").over(W.partitionBy(*by)) < tol, F.lit(False))
        state = cut(live.select(*by, "bin", "b", ok.alias("converged"), F.lit(done).alias("iterations")))
        over = state if done >= max_iter else state.filter("converged")
        out = over if out is None else out.unionByName(over)
        live = state.filter("not converged").select(*by, "bin", "b")
        if live.isEmpty():
            break
    return out


def _report(settled: DataFrame, residual: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """(by, row_sum_cv, kept_bins, converged, iterations, reason) of every map; residual holds _r per kept bin."""
    spread = residual.groupBy(*by).agg((F.stddev_pop("_r") / F.avg("_r")).alias("row_sum_cv"), F.count(F.lit(1)).alias("kept_bins"))
    ends = settled.groupBy(*by).agg(F.bool_and("converged").alias("converged"), F.max("iterations").alias("iterations"))
    reason = F.when(F.col("kept_bins").isNull(), "too few bins with contacts").when(~F.col("converged"), "not converged")
    return (sizes.select(*by).distinct().join(spread.join(ends, by), by, "left").withColumns({
        "converged": F.coalesce("converged", F.lit(False)), "reason": reason}))


def ice(contacts: DataFrame, sizes: DataFrame, ignore_diags: int = 2, min_nnz: int = 10, mad_max: float = 5.0,
        max_iter: int = 5000, tol: float = 1e-5, by: list[str] = MAP, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """Iterative correction. Returns (by, bin, bias, weight), NULL for masked bins and for maps that do not converge, and one
    report row per map."""
    by = list(by)
    px = mirrored(contacts.filter(F.col("j") - F.col("i") >= ignore_diags), by)
    good = ice_mask(px, min_nnz, mad_max, by)
    px = _prepare(px, good, by)
    mapw = W.partitionBy(*by)

    def step(bias: DataFrame) -> DataFrame:
        s = _row_sums(px, bias, by, -1).withColumn("_s", F.col("_s") / F.col("b"))
        s = s.withColumn("_s", F.col("_s") / F.avg("_s").over(mapw))
        return s.select(*by, "bin", (F.col("b") * F.col("_s")).alias("b"), F.var_pop("_s").over(mapw).alias("_e"))

    settled = _until_settled(good.withColumn("b", F.lit(1.0)), step, by, tol, max_iter, rounds)
    final = _row_sums(px, settled, by, -1).withColumn("_r", F.col("_s") / F.col("b"))
    out = bins_of(sizes, by).join(settled.filter("converged"), [*by, "bin"], "left").select(
        *by, "bin", F.col("b").alias("bias"), (1 / F.col("b")).alias("weight"))
    return out, _report(settled, final, sizes, by)


def kr(contacts: DataFrame, sizes: DataFrame, ignore_diags: int = 1, min_coverage_quantile: float = 0.02, tol: float = 1e-6,
       max_iter: int = 300, by: list[str] = MAP, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """Weights x with x * (A x) = 1, by x <- sqrt(x / (A x)): the fixed point of
    Knight-Ruiz balancing. Bins without contacts or in the lowest coverage quantile are masked; maps with fewer than three
    bins, and those that do not converge, have NULL weights and a reason in the report."""
    by = list(by)
    px = mirrored(contacts.filter((F.col("j") - F.col("i") >= ignore_diags) & (F.col("cnt") > 0)), by)
    cov = px.groupBy(*by, "bin").agg(F.sum("cnt").alias("cov"))
    thr = cov.groupBy(*by).agg(F.percentile("cov", F.lit(float(min_coverage_quantile))).alias("_t"), F.count(F.lit(1)).alias("_k"))
    good = cut(cov.join(thr, by).filter((F.col("_k") <= 10) | (F.col("cov") >= F.col("_t"))).select(*by, "bin"))
    px = _prepare(px, good, by)
    # start at one over the root of the mean row sum
    m = _row_sums(px, good.withColumn("b", F.lit(1.0)), by, 1).groupBy(*by).agg(F.sum("_s").alias("_t"), F.count(F.lit(1)).alias("_m")).filter("_m >= 3")
    x = good.join(m, by).select(*by, "bin", F.sqrt(F.col("_m") / F.col("_t")).alias("b"))

    def step(x: DataFrame) -> DataFrame:
        # the error is from before the update, so the result is at least as good
        return _row_sums(px, x, by, 1).select(*by, "bin", F.sqrt(F.col("b") / F.col("_s")).alias("b"), F.abs(F.col("b") * F.col("_s") - 1).alias("_e"))

    settled = _until_settled(x, step, by, tol, max_iter, rounds)
    rs = _row_sums(px, settled, by, 1).withColumn("_r", F.col("b") * F.col("_s"))
    out = bins_of(sizes, by).join(settled.filter("converged"), [*by, "bin"], "left").select(*by, "bin", F.col("b").alias("weight"))
    return out, _report(settled, rs, sizes, by)


def balanced_contacts(contacts: DataFrame, weights: DataFrame, by: list[str] = MAP) -> DataFrame:
    """Pixels with both bins valid, balanced and rescaled to the median of their raw counts."""
    b = balanced(contacts, weights, by).filter(F.col("bal") > 0)
    return (b.join(median_scale(b, "bal", "cnt", by), list(by))
            .select(*by, "i", "j", (F.col("bal") * F.col("scale")).alias("cnt")))
