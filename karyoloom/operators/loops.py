"""Loop calls: quick enrichment peaks, and peaks over four local neighbourhoods."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import MAP, cut, idiv
from ..functions.groups import components, greedy
from ..functions.intervals import within
from ..functions.ranks import bh_table, top_k
from ..functions.special import poisson_upper
from .maps import expected, expected_balanced, observed_over_expected

# fixed values: half-widths in bins of the peak and of the window at 5 kb, at other resolutions below 25 kb, and from there on
FINE, MEDIUM, COARSE = (4, 7), (2, 5), (1, 3)
KERNELS = ("donut", "lower_left", "horizontal", "vertical")


def quick_loop_candidates(contacts: DataFrame, sizes: DataFrame, min_sep: int = 5, max_sep: int | None = None, min_oe: float = 3.0,
                          min_count: float = 5.0, by: list[str] = MAP) -> DataFrame:
    """Enriched pixels of the band: O/E and count over their floors (the count floor is the 90th percentile of the band).
    Maps whose counts are all equal have no loops."""
    by = list(by)
    top = F.lit(max_sep) if max_sep else F.greatest(F.lit(min_sep + 1), idiv("n", 4))
    uneven = contacts.groupBy(*by).agg(F.min("cnt").alias("_lo"), F.max("cnt").alias("_hi")).filter("_lo < _hi").select(*by)
    band = (observed_over_expected(contacts, expected(contacts, sizes, by), by).join(uneven, by).join(sizes, by)
            .filter((F.col("d") >= min_sep) & (F.col("d") <= top) & (F.col("expected") > 0)))
    floor = band.groupBy(*by).agg(F.greatest(F.percentile("cnt", F.lit(0.9)), F.lit(float(min_count))).alias("_floor"))
    return band.join(floor, by).filter((F.col("oe") >= min_oe) & (F.col("cnt") >= F.col("_floor"))).select(*by, "i", "j", "oe")


def quick_loops(contacts: DataFrame, sizes: DataFrame, suppress: int = 4, top: int | None = None, by: list[str] = MAP, **floors) -> DataFrame:
    """Candidates, one per neighbourhood, with their rank in the map; only the best `top` where that is given."""
    kept = greedy(quick_loop_candidates(contacts, sizes, by=by, **floors), list(by), ["i", "j"], [suppress, suppress], "oe")
    order = [F.desc("oe"), F.asc("i"), F.asc("j")]
    if top is not None:
        return top_k(kept, list(by), order, top)
    # loops kept per neighbourhood: their number is bounded by the places of a map
    return kept.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def _box(total: np.ndarray, y0: int, y1: int, x0: int, x1: int, w: int) -> np.ndarray:
    """Sums over rows y0..y1 and columns x0..x1 around every inner cell, from a padded cumulative table."""
    r, c = total.shape[0] - 1 - 2 * w, total.shape[1] - 1 - 2 * w
    at = lambda y, x: total[w + y:w + y + r, w + x:w + x + c]            # noqa: E731
    return at(y1 + 1, x1 + 1) - at(y0, x1 + 1) - at(y1 + 1, x0) + at(y0, x0)


def _neighbourhoods(m: np.ndarray, p: int, w: int) -> dict[str, np.ndarray]:
    """The four neighbourhood sums of every inner cell as differences of boxes."""
    t = np.zeros((m.shape[0] + 1, m.shape[1] + 1))
    t[1:, 1:] = m.cumsum(0).cumsum(1)
    b = lambda y0, y1, x0, x1: _box(t, y0, y1, x0, x1, w)                # noqa: E731
    cross = (b(0, 0, -w, w) - b(0, 0, -p, p)) + (b(-w, w, 0, 0) - b(-p, p, 0, 0))
    return {"donut": b(-w, w, -w, w) - b(-p, p, -p, p) - cross,
            "lower_left": b(1, w, -w, -1) - b(1, p, -p, -1),
            "horizontal": b(-1, 1, -w, w) - b(-1, 1, -p, p),
            "vertical": b(-w, w, -1, 1) - b(-p, p, -1, 1)}


LEAST_OE, FLOORS = 2.0, dict(zip(KERNELS, (1.75, 1.75, 1.5, 1.5)))          # fixed values: enrichment of a peak over its neighbourhoods
TESTED = ("i", "j", "obs", *(f"{c}_{k}" for k in KERNELS for c in "ep"))


def neighbourhood_tests(contacts: DataFrame, sizes: DataFrame, weights: DataFrame, resolution: int, max_sep_bp: int = 2_000_000,
                        min_sep_bp: int = 30_000, p: int | None = None, w: int | None = None, tile: int = 256,
                        by: list[str] = MAP) -> DataFrame:
    """(by, i, j, obs, e_<kernel>, p_<kernel>) of every non-zero pixel of the band between valid bins."""
    tests = _tested_tiles(contacts, sizes, weights, resolution, max_sep_bp, min_sep_bp, p, w, tile, by, False)
    return tests.select(*by, F.inline(F.arrays_zip(*TESTED)))


def _tested_tiles(contacts: DataFrame, sizes: DataFrame, weights: DataFrame, resolution: int, max_sep_bp: int = 2_000_000,
                  min_sep_bp: int = 30_000, p: int | None = None, w: int | None = None, tile: int = 256,
                  by: list[str] = MAP, peaks_only: bool = True) -> DataFrame:
    """One row per tile of a map with the columns of neighbourhood_tests as arrays, for all tested pixels or only those that stand
    out of their neighbourhoods, and the p-values of all tested pixels as arrays all_<kernel>.

    The map is cut into tiles with a margin of w bins; each pixel travels once, a few percent twice, and one task sees at
    most (tile + 2 w)^2 cells of any map however deep it is sequenced."""
    by = list(by)
    usual = COARSE if resolution >= 25_000 else FINE if resolution == 5_000 else MEDIUM
    p, w = usual[0] if p is None else p, usual[1] if w is None else w
    # separations dmin .. depth - 1 are tested: from the first that keeps the window off the diagonal, whole bins of the band
    dmin = max(w + 1, math.ceil(min_sep_bp / resolution))
    depth = 1 + max(w + 1, math.floor(max_sep_bp / resolution))
    reach = depth + w + 1
    exp = expected_balanced(contacts, sizes, weights, reach, by).select(*by, "d", "expected")
    ed = exp.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "expected"))), lambda s: s["expected"]).alias("ed"))
    wt = weights.select(*by, "bin", F.when(F.col("weight") > 0, F.col("weight")).alias("weight"))
    side = lambda k: wt.select(*by, F.col("bin").alias(k), F.col("weight").alias(f"w_{k}"))           # noqa: E731
    tiles = lambda c: F.sequence(idiv(c - w, tile), idiv(c + w, tile))                                # noqa: E731
    px = contacts.filter(F.col("j") - F.col("i") < reach + w).join(side("i"), [*by, "i"]).join(side("j"), [*by, "j"])
    ends = F.array(F.struct(F.col("i").alias("r"), F.col("j").alias("c"), F.col("w_i").alias("wr"), F.col("w_j").alias("wc")),
                   F.struct(F.col("j").alias("r"), F.col("i").alias("c"), F.col("w_j").alias("wr"), F.col("w_i").alias("wc")))
    ends = F.when(F.col("i") == F.col("j"), F.slice(ends, 1, 1)).otherwise(ends)
    cells = (px.select(*by, "cnt", F.inline(ends)).withColumn("ti", F.explode(tiles(F.col("r")))).withColumn("tj", F.explode(tiles(F.col("c"))))
             .filter((F.col("ti") >= 0) & (F.col("tj") >= F.col("ti"))).select(*by, "ti", "tj", "r", "c", "cnt", "wr", "wc"))
    used = cells.select(*by, "ti", "tj").distinct()
    # invalid bins matter for the expected sums of every tile whose margin contains them
    bad = wt.filter(F.col("weight").isNull()).withColumn("_t", F.explode(tiles(F.col("bin")))).select(*by, "bin", "_t")
    none = lambda t: F.lit(None).cast(t)                                                              # noqa: E731
    bad_r = used.join(bad.withColumnRenamed("_t", "ti"), [*by, "ti"]).select(*by, "ti", "tj", F.col("bin").alias("r"), none("long").alias("c"))
    bad_c = used.join(bad.withColumnRenamed("_t", "tj"), [*by, "tj"]).select(*by, "ti", "tj", none("long").alias("r"), F.col("bin").alias("c"))
    head = used.join(ed, by).join(sizes, by).select(*by, "ti", "tj", "n", "ed")
    rows = (cells.withColumns({"n": none("long"), "ed": none("array<double>")})
            .unionByName(bad_r.unionByName(bad_c), allowMissingColumns=True).unionByName(head, allowMissingColumns=True))
    types = {f.name: f.dataType.simpleString() for f in sizes.schema.fields}
    schema = ", ".join(f"{b} {types[b]}" for b in by) + ", i array<long>, j array<long>, obs array<double>" + "".join(
        f", e_{k} array<double>, p_{k} array<double>" for k in KERNELS) + "".join(f", all_{k} array<double>" for k in KERNELS)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
        info = pdf[pdf["n"].notna()].iloc[0]
        n, e = int(info["n"]), np.asarray(info["ed"], float)
        size = tile + 2 * w
        r0, c0 = ti * tile - w, tj * tile - w
        rows, cols = r0 + np.arange(size), c0 + np.arange(size)
        ok_r, ok_c = (rows >= 0) & (rows < n), (cols >= 0) & (cols < n)
        b = pdf[pdf["n"].isna() & pdf["c"].isna()]["r"].to_numpy(np.int64) - r0
        ok_r[b[(b >= 0) & (b < size)]] = False
        b = pdf[pdf["n"].isna() & pdf["r"].isna()]["c"].to_numpy(np.int64) - c0
        ok_c[b[(b >= 0) & (b < size)]] = False
        d = pdf[pdf["cnt"].notna()]
        y, x = d["r"].to_numpy(np.int64) - r0, d["c"].to_numpy(np.int64) - c0
        raw, bal = np.zeros((size, size)), np.zeros((size, size))
        raw[y, x] = d["cnt"]
        bal[y, x] = np.nan_to_num(d["cnt"] * d["wr"] * d["wc"])
        sep = np.abs(cols[None, :] - rows[:, None])
        ex = np.where(sep < len(e), e[np.minimum(sep, len(e) - 1)], 0.0) * ok_r[:, None] * ok_c[None, :]
        inner = slice(w, w + tile)
        up = (cols[None, inner] - rows[inner, None])
        hit = (up >= dmin) & (up < depth) & (raw[inner, inner] > 0) & ok_r[inner, None] & ok_c[None, inner]
        ty, tx = np.nonzero(hit)
        out, whole = {}, {}
        obs, here = raw[inner, inner][ty, tx], ex[inner, inner][ty, tx]
        scale = np.zeros((size, size))
        scale[y, x] = np.nan_to_num(d["wr"] * d["wc"])
        ww = scale[inner, inner][ty, tx]
        out.update(i=rows[inner][ty], j=cols[inner][tx], obs=obs)
        sb, se = _neighbourhoods(bal, p, w), _neighbourhoods(ex, p, w)
        for k in KERNELS:
            s, t = np.maximum(sb[k][ty, tx], 0.0), se[k][ty, tx]
            s = np.where(s < 1e-12 * max(bal.sum(), 1e-300), 0.0, s)
            fine = t > 1e-12 * max(ex.sum(), 1e-300)
            lam = np.where(fine, s * here / np.where(fine, t, 1.0), np.nan) / np.maximum(ww, 1e-300)
            use = np.isfinite(lam) & (lam > 0)
            pv = np.ones(len(ty))
            pv[use] = poisson_upper(obs[use], lam[use])
            out[f"e_{k}"], out[f"p_{k}"] = np.where(use, lam, 0.0), pv
            whole[f"all_{k}"] = pv if peaks_only else pv[:0]
        if peaks_only:
            oe = {k: np.divide(obs, out[f"e_{k}"], out=np.zeros(len(ty)), where=out[f"e_{k}"] > 0) for k in KERNELS}
            ok = np.maximum(oe["donut"], oe["lower_left"]) >= LEAST_OE
            for k in KERNELS:
                ok &= oe[k] >= FLOORS[k]
            out = {c: v[ok] for c, v in out.items()}
        return pd.DataFrame({**{b: [pdf[b].iloc[0]] for b in by}, **{c: [v] for c, v in (out | whole).items()}})

    return rows.groupBy(*by, "ti", "tj").applyInPandas(test, schema)


def call_loops(contacts: DataFrame, sizes: DataFrame, weights: DataFrame, resolution: int, fdr: float = 0.1, cluster_bp: int = 20_000,
               by: list[str] = MAP, **settings) -> DataFrame:
    """Pixels above all four neighbourhoods, clustered; the best pixel of each cluster with its cluster size. The p-values
    of each neighbourhood form one false-discovery family per map."""
    by = list(by)
    # arrays per tile, of which the pixels that are no peaks keep their p-values only
    tiles = cut(_tested_tiles(contacts, sizes, weights, resolution, by=by, **settings))
    tests = tiles.select(*by, F.inline(F.arrays_zip(*TESTED)))
    # all four families in one pass over the distinct p-values; only enriched pixels look their q-values up
    long = tiles.select(*by, F.inline(F.array(*[F.struct(F.lit(k).alias("kernel"), F.col(f"all_{k}").alias("_p")) for k in KERNELS]))).select(*by, "kernel", F.explode("_p").alias("p"))
    largest = tiles.groupBy(*by).agg(F.sum(F.size("all_donut")).alias("_n")).agg(F.max("_n")).first()[0] or 0
    table = cut(bh_table(long, [*by, "kernel"], "p", most=largest).filter(F.col("q") <= fdr))
    oe = {k: F.when(F.col(f"e_{k}") > 0, F.col("obs") / F.col(f"e_{k}")).otherwise(0.0) for k in KERNELS}
    q = tests
    for k in KERNELS:
        one = table.filter(F.col("kernel") == k).select(*by, F.col("p").alias(f"p_{k}"), F.col("q").alias(f"q_{k}"))
        q = q.join(one, [*by, f"p_{k}"])
    peaks = cut(q.select(*by, "i", "j", "obs", F.col("e_donut").alias("expected_donut"), oe["donut"].alias("oe_donut"),
                                    sum((F.col(f"q_{k}") for k in KERNELS), F.lit(0.0)).alias("q_sum"),
                                    *[f"q_{k}" for k in KERNELS], F.concat_ws(":", "i", "j").alias("node")))
    radius = max(1.0, cluster_bp / resolution)
    other = peaks.select(*by, F.col("i").alias("_i"), F.col("j").alias("_j"), F.col("node").alias("_node"))
    t = int(radius)
    near = within(peaks, other, by, [("i", "_i"), ("j", "_j")], [t, t]).filter(
        (F.pow(F.col("i") - F.col("_i"), 2) + F.pow(F.col("j") - F.col("_j"), 2) <= (radius + 1e-9) ** 2) & (F.col("node") < F.col("_node")))
    comp = components(peaks, near.select(*by, F.col("node").alias("a"), F.col("_node").alias("b")), by)
    c = peaks.join(comp, [*by, "node"])
    best = c.groupBy(*by, "component").agg(F.count(F.lit(1)).alias("cluster_size"), F.min_by(
        F.struct("i", "j", "obs", "expected_donut", "oe_donut", "q_sum", *[f"q_{k}" for k in KERNELS]),
        F.struct(-F.col("oe_donut"), "i", "j")).alias("b"))
    return (best.select(*by, "b.*", "cluster_size").filter((F.col("cluster_size") > 1) | (F.col("q_sum") <= 0.02)).drop("q_sum"))
