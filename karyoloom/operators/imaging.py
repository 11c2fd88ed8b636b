"""Imaging statistics: traces (dataset, copy, locus, x, y, z; NULL or absent = undetected) and accuracy scores of pair maps.

A pair statistic needs every pair of loci of every copy. The traces are dealt to tiles of pairs of loci, where a task makes the
pairs of its tile and reduces them: what is shuffled are traces and tables of locus pairs, never a row for a pair of a copy.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import cut, idiv
from ..functions.blocks import TILE, cell_of, spread, tile_pairs, tiled
from ..functions.intervals import pair_tiles, points_in_intervals
from ..functions.ranks import quantiles, spearman, value_ranks
from ..functions.stats import agreement, median
from .ensemble import central_interval, maxwell_cdf, maxwell_p, maxwell_quantile, maxwell_x, sigma_of
from .predict import ratio_to_trend
from .structures import XYZ, dist

SET = ("dataset",)
LEVELS = (0.5, 0.8, 0.9)
COPIES = 64               # copies whose distances one task gives back for a tile of locus pairs
AT_ONCE = 1 << 17         # distances that a task makes at a time: they stay in its cache
PIT_CELLS = 1 << 17       # cells of the table that tells most probability bins without the probability


def detected(traces: DataFrame) -> DataFrame:
    return traces.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())


def keep_copies(traces: DataFrame, min_share: float = 0.5, by: list[str] = SET) -> DataFrame:
    """Copies with at least min_share of the loci of their dataset detected."""
    loci = traces.groupBy(*by).agg(F.countDistinct("locus").alias("_n"))
    ok = detected(traces).groupBy(*by, "copy").agg(F.countDistinct("locus").alias("_k")).join(loci, list(by)).filter(F.col("_k") >= min_share * F.col("_n"))
    return traces.join(ok.select(*by, "copy"), [*by, "copy"], "left_semi")


def copy_distances(traces: DataFrame, by: list[str] = SET) -> DataFrame:
    """Distance of every detected locus pair of every copy."""
    p = pair_tiles(detected(traces), [*by, "copy"], "locus", XYZ)
    return p.select(*by, "copy", "i", "j", dist("_i", "_j").alias("d"))


def adjacent_median(traces: DataFrame, by: list[str] = SET) -> DataFrame:
    """Median distance of consecutive loci (an equi-join of each locus with the next)."""
    t = detected(traces)
    a = t.select(*by, "copy", "locus", *[F.col(c).alias(f"{c}_a") for c in XYZ])
    b = t.select(*by, "copy", (F.col("locus") - 1).alias("locus"), *[F.col(c).alias(f"{c}_b") for c in XYZ])
    d = a.join(b, [*by, "copy", "locus"]).select(*by, dist("_a", "_b").alias("_d"))
    return quantiles(d, list(by), "_d", {"adjacent": 0.5})


def _placed(traces: DataFrame, by: list[str], *more: str) -> DataFrame:
    """Detected loci with all their keys."""
    t = detected(traces).dropna(subset=[*by, "copy", "locus"])
    return t.select(*by, "copy", "locus", *[F.col(c).cast("double").alias(c) for c in XYZ], *more)


def _tile_distances(rows: pa.Table, tile_i: int, tile_j: int):
    """(cell, locus i, locus j, distance) of the pairs of a tile, strip by strip."""
    if not rows.num_rows:
        return
    copy = rows.column("copy").combine_chunks().dictionary_encode()
    copy = copy.combine_chunks() if isinstance(copy, pa.ChunkedArray) else copy
    locus, at = rows.column("locus").to_numpy().astype(np.int64), [rows.column(c).to_numpy() for c in XYZ]
    for i, j in tile_pairs(copy.indices.to_numpy(), locus, tile_i, tile_j):
        d = np.sqrt(sum((x[i] - x[j]) ** 2 for x in at))
        yield cell_of(locus[i], locus[j], tile_i, tile_j), locus[i], locus[j], d


def half_stats(traces: DataFrame, r_c: float | None = None, by: list[str] = SET) -> DataFrame:
    """Per pair: copies with both loci, share of them closer than r_c (median adjacent distance when absent), median distance."""
    by = list(by)
    t = _placed(traces, by)
    if r_c is None:
        t = t.join(F.broadcast(adjacent_median(traces, by)).withColumnRenamed("adjacent", "_r"), by)                # one number per dataset
    else:
        t = t.withColumn("_r", F.lit(float(r_c)))
    kinds = {f.name: f.dataType.simpleString() for f in t.schema}

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        tile_i, tile_j, near, parts = key[-2].as_py(), key[-1].as_py(), rows.column("_r")[0].as_py(), []
        for cell, i, j, d in _tile_distances(rows, tile_i, tile_j):
            order = np.lexsort((d, cell))
            cell, d = cell[order], d[order]
            start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])
            if len(start):
                n = np.diff(np.append(start, len(cell)))
                parts.append((i[order[start]], j[order[start]], n, np.add.reduceat((d < near).astype(float), start) / n, (d[start + (n - 1) // 2] + d[start + n // 2]) / 2))
        i, j, n, freq, median = (np.concatenate(c) for c in zip(*parts)) if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0)] * 2
        place = rows.schema.field("locus").type
        return pa.table({**{c: pa.repeat(k, len(i)) for c, k in zip(by, key)}, "i": pa.array(i).cast(place), "j": pa.array(j).cast(place), "seen": n, "freq": freq, "median": median})

    names = [*(f"`{c}` {kinds[c]}" for c in by), f"i {kinds['locus']}", f"j {kinds['locus']}", "seen long", "freq double", "median double"]
    return tiled(t, by, "locus").groupBy(*by, "tile_i", "tile_j").applyInArrow(run, ", ".join(names))


def _packed(pairs: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, tile_i, tile_j, cell, columns): pairs of one tile that follow each other, as arrays of one row, so that a pair is not
    dealt out and sorted on its own."""
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}

    def pack(batches):
        for b in batches:
            code, many = np.zeros(b.num_rows, np.int64), 1
            i, j = (b.column(c).to_numpy().astype(np.int64) for c in "ij")
            tiles = [pa.array(x // TILE) for x in (i, j)]
            for c in (*(b.column(c) for c in by), *tiles):
                held = c.dictionary_encode()
                if many * len(held.dictionary) >= 1 << 62:
                    code = np.unique(code, return_inverse=True)[1]
                    many = len(code)
                code, many = code * len(held.dictionary) + held.indices.to_numpy(), many * len(held.dictionary)
            if np.any(code[1:] < code[:-1]):
                order = np.argsort(code, kind="stable")
                code, i, j, b = code[order], i[order], j[order], b.take(pa.array(order))
            begin = np.flatnonzero(np.append(True, code[1:] != code[:-1])[:len(code)])
            ends = pa.array(np.append(begin, len(code)).astype(np.int32))
            cell = pa.array(cell_of(i, j, i // TILE, j // TILE).view(np.int16))
            first = [*(b.column(c).take(pa.array(begin)) for c in by), pa.array(i[begin] // TILE), pa.array(j[begin] // TILE)]
            yield pa.RecordBatch.from_arrays([*first, *(pa.ListArray.from_arrays(ends, v) for v in (cell, *(b.column(c) for c in columns)))], names=[*by, "tile_i", "tile_j", "cell", *columns])

    names = ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "tile_i long, tile_j long, cell array<smallint>", *(f"`{c}` array<{kinds[c]}>" for c in columns)])
    return pairs.filter(F.col("i") < F.col("j")).dropna(subset=by).select(*by, "i", "j", *columns).mapInArrow(pack, names)


def _distances_at(rows: pa.Table, i: np.ndarray, j: np.ndarray, tile_i: int, tile_j: int):
    """(distances, which of them exist) of the pairs (i, j), places within the sides of a tile, in some of the copies at a time."""
    copy = rows.column("copy").combine_chunks().dictionary_encode()
    copy = (copy.combine_chunks() if isinstance(copy, pa.ChunkedArray) else copy).indices.to_numpy()
    locus, at, copies = rows.column("locus").to_numpy().astype(np.int64), [rows.column(c).to_numpy() for c in XYZ], int(copy.max()) + 1
    sides = []
    for tile in (tile_i, tile_j):
        mine = np.flatnonzero(locus // TILE == tile)
        cell = copy[mine] * np.int64(TILE) + locus[mine] - tile * TILE
        order = np.argsort(cell, kind="stable")
        mine, cell = mine[order], cell[order]
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[:len(cell)])
        turn = np.arange(len(cell)) - np.repeat(begin, np.diff(np.append(begin, len(cell))))         # a locus that comes more than once in its copy
        layers = []
        for k in range(int(turn.max()) + 1 if len(turn) else 0):
            there, grid = np.zeros(copies * TILE, bool), [np.zeros(copies * TILE) for _ in XYZ]
            there[cell[turn == k]] = True
            for g, x in zip(grid, at):
                g[cell[turn == k]] = x[mine[turn == k]]
            layers.append((there.reshape(copies, TILE), [g.reshape(copies, TILE) for g in grid]))
        sides.append(layers)
    step = max(1, AT_ONCE // len(i))
    for (here, left), (there, right) in itertools.product(*sides):
        for k in range(0, copies, step):
            some = slice(k, k + step)
            yield np.sqrt(sum((x[some].take(i, 1) - y[some].take(j, 1)) ** 2 for x, y in zip(left, right))), here[some].take(i, 1) & there[some].take(j, 1)


def copy_distances_with(traces: DataFrame, pairs: DataFrame, columns: list[str], by: list[str] = SET) -> DataFrame:
    """(by, columns, d): the distance of every detected locus pair of every copy beside the columns of its row in `pairs` (by, i, j,
    columns). Traces and pairs meet by tiles.

    The result also has `tallied(fold, names, beside)`, which reduces the distances in the task that makes them to rows (by, names):
    fold(parts, held, more) gets the (distances, which exist) of all pairs of a tile in some copies at a time, the columns of the
    pairs, and the columns of `beside`, a frame of one row per group. A step that counts distances takes it instead of the rows."""
    by = list(by)
    t = _placed(traces, by)
    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    key = [*by, "tile_i", "tile_j"]
    t, p = tiled(t, by, "locus"), _packed(pairs, by, columns)
    most = traces.select(*by, "copy").distinct().groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    parts = -(-most // COPIES)
    if parts > 1:
        key.append("_part")
        t = t.withColumn("_part", F.pmod(F.xxhash64("copy"), F.lit(parts)).cast("int"))
        p = p.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    mine = [f"_{c}" for c in key]                                                      # both sides may come from one table
    t = t.select(*[F.col(c).alias(m) for c, m in zip(key, mine)], "copy", "locus", *XYZ)

    def tallied(fold, names: str, beside: DataFrame | None = None) -> DataFrame:
        more = [c for c in beside.columns if c not in by] if beside is not None else []
        own = t if beside is None else t.join(F.broadcast(beside.select(*[F.col(c).alias(f"_{c}") for c in by], *more)), [f"_{c}" for c in by])

        def run(key: tuple, rows: pa.Table, held: pa.Table) -> pa.Table:
            flat = {c: pa.chunked_array([x.flatten() for x in held.column(c).chunks], held.schema.field(c).type.value_type) for c in ("cell", *columns)}
            cells = flat.pop("cell").to_numpy().astype(np.int16).view(np.uint16).astype(np.int64)
            found = rows.num_rows and len(cells)
            parts = _distances_at(rows, cells // TILE, cells % TILE, key[len(by)].as_py(), key[len(by) + 1].as_py()) if found else ()
            out = fold(parts, flat, {c: rows.column(c)[0].as_py() if found else None for c in more})
            return pa.table({**{c: pa.repeat(k, len(next(iter(out.values())))) for c, k in zip(by, key)}, **out})

        return own.groupBy(*mine).cogroup(p.groupBy(*key)).applyInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), names]))

    def whole(parts, held, more) -> dict:
        taken, far = [np.empty(0, np.int64)], [np.empty(0)]
        for d, use in parts:
            taken.append(np.nonzero(use)[1])
            far.append(d[use])
        taken = pa.array(np.concatenate(taken))
        return {**{c: held[c].take(taken) for c in columns}, "d": np.concatenate(far)}

    d = tallied(whole, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), "d double"]))
    d.tallied = tallied
    return d


def split_copies(traces: DataFrame, seed: int = 0, by: list[str] = SET) -> DataFrame:
    """(by, copy, half): a random half of the copies is 'a' (n div 2 of them), the others are 'b'."""
    c = traces.select(*by, "copy").distinct().withColumn("_h", F.xxhash64(F.col("copy"), F.lit(seed)))
    ranks = value_ranks(c, list(by), "_h").join(c.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), list(by))
    half = F.when(F.col("rank") <= idiv("_n", 2), "a").otherwise("b")
    return c.join(ranks.select(*by, "_h", half.alias("half")), [*by, "_h"]).drop("_h")


def map_scores(pairs: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth", sep: str = "sep") -> DataFrame:
    """Spearman, Pearson, trend-removed Spearman, concordance and median scale of two positive pair maps; at least 3 pairs."""
    by = list(by)
    ok = pairs.filter((F.col(pred) > 0) & (F.col(truth) > 0))
    ok = ratio_to_trend(ratio_to_trend(ok, by, pred, "_p", sep), by, truth, "_t", sep)
    ok = cut(ok.withColumns({"_p": F.round("_p", 12), "_t": F.round("_t", 12)}))
    raw = spearman(ok, by, pred, truth, out="spearman", n_out="pairs")
    free = spearman(ok, by, "_p", "_t", out="spearman_trend_removed", n_out="_n").drop("_n")
    ag = agreement(ok, by, truth, pred).drop("n")
    return raw.join(free, by).join(ag, by)


def genomic_baseline(pairs: DataFrame, by: list[str], value: str = "median", sep: str = "sep") -> DataFrame:
    """Distance from separation alone: a power law fitted to the positive medians."""
    x, y = F.when((F.col(value) > 0) & (F.col(sep) > 0), F.ln(sep)), F.when((F.col(value) > 0) & (F.col(sep) > 0), F.ln(value))
    m = pairs.groupBy(*by).agg(F.regr_slope(y, x).alias("_k"), F.regr_intercept(y, x).alias("_c"))
    return pairs.join(m, list(by)).withColumn("baseline", F.exp(F.col("_c")) * F.pow(F.greatest(F.col(sep), F.lit(1)).cast("double"), F.col("_k"))).drop("_k", "_c")


def standard_distances(traces: DataFrame, sigma: DataFrame, by: list[str] = SET) -> DataFrame:
    """Single-copy distances in units of the pair's predicted spread. `tallied(fold, names, beside)` as in copy_distances_with, its
    fold(values, more) getting arrays of them."""
    d = copy_distances_with(traces, sigma.filter(F.col("sigma") > 0), ["sigma"], by)
    z = d.select(*by, (F.col("d") / F.col("sigma")).alias("z"))

    def tallied(fold, names: str, beside: DataFrame | None = None) -> DataFrame:
        def scaled(parts, held, more):
            sigma = held["sigma"].to_numpy().astype(float)
            return fold(((d / sigma)[use] for d, use in parts), more)
        return d.tallied(scaled, names, beside)

    z.tallied = tallied
    return z


def interval_coverage(z: DataFrame, bounds: dict[float, tuple[float, float]] | None = None, by: list[str] = SET) -> DataFrame:
    """(by, level, coverage, measurements): share of distances inside each central interval."""
    b = bounds or {lv: central_interval(lv) for lv in LEVELS}
    agg = z.groupBy(*by).agg(F.count(F.lit(1)).alias("measurements"), *[F.avg(((F.col("z") > lo) & (F.col("z") < hi)).cast("double")).alias(f"_c{k}")
                                                                       for k, (lo, hi) in enumerate(b.values())])
    return agg.select(*by, "measurements", F.inline(F.array(*[F.struct(F.lit(lv).alias("level"), F.col(f"_c{k}").alias("coverage")) for k, lv in enumerate(b)])))


def _pit_bins(bins: int):
    """Function from distances in units of the spread to their bins of the cumulative probability: a table of narrow cells gives the
    bin, and the probability itself is worked out only in the cells that an edge of a bin comes near."""
    edges = maxwell_x(np.arange(1, bins) / bins) if bins > 1 else np.array([1.0])
    width = 1.01 * edges[-1] / PIT_CELLS
    at = np.arange(PIT_CELLS + 1) * width
    low, high = (np.searchsorted(edges, x, "right") for x in (at - 1e-6 * width - 1e-9 * at, at + width + 1e-6 * width + 1e-9 * at))
    high[-1] = low[-1] = bins - 1
    table = np.where(low == high, low, -1).astype(np.int32)

    def binned(z: np.ndarray) -> np.ndarray:
        z = np.where(np.isnan(z), np.inf, z) if np.isnan(z.sum()) else z
        b = table[np.minimum(z / width, PIT_CELLS).astype(np.int32)]
        near = np.flatnonzero(b < 0)
        b[near] = np.minimum(np.floor(maxwell_p(z[near]) * bins), bins - 1)
        return b

    return binned


def pit_histogram(z: DataFrame, bins: int = 200, by: list[str] = SET) -> DataFrame:
    """Counts of the predicted cumulative probability in equal bins (empty ones included)."""
    by = list(by)
    if hasattr(z, "tallied"):
        binned = _pit_bins(bins)

        def count(values, more) -> dict:
            n = sum((np.bincount(binned(v), minlength=bins) for v in values), np.zeros(bins, np.int64))
            b = np.flatnonzero(n)
            return {"bin": b.astype(np.int32), "n": n[b].astype(np.int64)}

        u = z.tallied(count, "bin int, n long")
    else:
        u = z.select(*by, F.least(F.lit(bins - 1), F.floor(maxwell_cdf(F.col("z")) * bins)).cast("int").alias("bin"), F.lit(1).cast("long").alias("n"))
    h = u.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    held = h.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("_n"))              # at most `bins` entries
    grid = held.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.select(*by, "bin", F.coalesce(F.try_element_at("_n", "bin"), F.lit(0).cast("long")).alias("n"))


def recalibrate(hist: DataFrame, levels: tuple[float, ...] = LEVELS, by: list[str] = SET) -> DataFrame:
    """(by, level, low, high, low_sigma, high_sigma): where the empirical distribution of a PIT histogram (by, bin, n) reaches
    both tails of each level, by linear interpolation, and the spread multiples there. The window runs over the bins."""
    w = W.partitionBy(*by)
    n = F.sum("n").over(w)
    run = w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    h = hist.withColumns({"_hi": F.sum("n").over(run) / n, "_lo": (F.sum("n").over(run) - F.col("n")) / n, "_bins": F.count(F.lit(1)).over(w)})
    qs = [(lv, side, (1 - lv) / 2 if side == "low" else (1 + lv) / 2) for lv in levels for side in ("low", "high")]
    d = h.select("*", F.inline(F.array(*[F.struct(F.lit(lv).alias("level"), F.lit(s).alias("side"), F.lit(q).alias("q")) for lv, s, q in qs])))
    at = d.filter((F.col("q") > F.col("_lo")) & (F.col("q") <= F.col("_hi")))
    u = (F.col("bin") + (F.col("q") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))) / F.col("_bins")
    out = at.groupBy(*by, "level").agg(F.max(F.when(F.col("side") == "low", u)).alias("low"), F.max(F.when(F.col("side") == "high", u)).alias("high"))
    return out.withColumns({"low_sigma": maxwell_quantile(F.col("low")), "high_sigma": maxwell_quantile(F.col("high"))})


def recalibrated_coverage(z: DataFrame, bounds: DataFrame, by: list[str] = SET) -> DataFrame:
    """Coverage of the recalibrated intervals: a handful of numbers per dataset go to the distances, which stay where they are."""
    by = list(by)
    b = bounds.groupBy(*by).agg(F.collect_list(F.struct("level", "low_sigma", "high_sigma")).alias("_b"))           # one entry per level
    if hasattr(z, "tallied"):
        def count(values, more) -> dict:
            levels = more["_b"] or []
            inside, told, n = (np.zeros(len(levels), np.int64) for _ in range(3))
            for v in values:
                n += len(v)
                for k, x in enumerate(levels):
                    low, high = x["low_sigma"], x["high_sigma"]
                    over, under = (None if low is None else v > low), (None if high is None else v < high)
                    if over is not None and under is not None:
                        inside[k] += np.count_nonzero(over & under)
                        told[k] += len(v)
                    elif over is not None or under is not None:          # one end is not known: only those beyond the other are told
                        told[k] += len(v) - np.count_nonzero(under if over is None else over)
            return {"level": np.array([x["level"] for x in levels], float), "_in": inside, "_told": told, "measurements": n}

        c = z.tallied(count, "level double, _in long, _told long, measurements long", b).filter("measurements > 0").groupBy(*by, "level").agg(*[F.sum(x).alias(x) for x in ("_in", "_told", "measurements")])
        return c.select(*by, "level", (F.col("_in") / F.nullif(F.col("_told"), F.lit(0))).alias("coverage"), "measurements")
    d = z.join(F.broadcast(b), by).select(*by, "z", F.inline("_b"))
    return d.groupBy(*by, "level").agg(F.avg(((F.col("z") > F.col("low_sigma")) & (F.col("z") < F.col("high_sigma"))).cast("double")).alias("coverage"),
                                       F.count(F.lit(1)).alias("measurements"))


def band_of(sep: Column, edges: list[float]) -> Column:
    return sum((F.when(sep >= e, 1).otherwise(0) for e in edges[1:-1]), F.lit(0))


def log_ratio_histogram(traces: DataFrame, medians: DataFrame, bands: list[float], low: float, high: float, bins: int, by: list[str] = ("unit",)) -> DataFrame:
    """(by, band, bin, n) of log(single-copy distance / predicted median), clipped to [low, high], in equal bins. The counts are written
    once: pooling reads them several times."""
    by, parts_of = list(by), max(1, len(bands) - 1)
    d = copy_distances_with(traces, medians.filter(F.col("median") > 0).withColumn("_band", band_of(F.col("sep"), bands)), ["median", "_band"], by)

    def count(parts, held, more) -> dict:
        median, first = held["median"].to_numpy().astype(float), held["_band"].to_numpy().astype(np.int64) * bins
        n = np.zeros(parts_of * bins, np.int64)
        for far, use in parts:
            with np.errstate(divide="ignore", invalid="ignore"):
                x = np.log(far / median)
            x = np.where(np.isnan(x), high, x)
            x = np.floor((np.minimum(high, np.maximum(low, x)) - low) / (high - low) * bins)
            n += np.bincount((first + np.minimum(bins - 1, x).astype(np.int64))[use], minlength=parts_of * bins)
        k = np.flatnonzero(n)
        return {"band": (k // bins).astype(np.int32), "bin": (k % bins).astype(np.int32), "n": n[k]}

    return cut(d.tallied(count, "band int, bin int, n long").groupBy(*by, "band", "bin").agg(F.sum("n").alias("n")))


def pool_histograms(hist: DataFrame, min_pairs: int = 1, banded: bool = True, unit: str = "unit") -> DataFrame:
    """Mean of the units' normalised histograms per band (or the mean over bands)."""
    tot = hist.groupBy(unit, "band").agg(F.sum("n").alias("_n")).filter(F.col("_n") >= min_pairs)
    units = tot.groupBy("band").agg(F.count(F.lit(1)).alias("_u"))
    p = hist.join(tot, [unit, "band"]).join(units, "band").groupBy("band", "bin").agg(F.sum(F.col("n") / F.col("_n") / F.col("_u")).alias("share"))
    if banded:
        return p
    k = p.agg(F.countDistinct("band").alias("_k"))
    flat = p.groupBy("bin").agg(F.sum("share").alias("_s")).join(F.broadcast(k), F.lit(True))                       # one number
    return flat.select("bin", (F.col("_s") / F.col("_k")).alias("share"))


def histogram_quantiles(hist: DataFrame, qs: list[float], low: float, high: float, bins: int, by: list[str] = ("band",), weight: str = "share") -> DataFrame:
    """(by, q, value): quantiles of a histogram by linear interpolation inside its bins."""
    w = W.partitionBy(*by)
    run = F.sum(weight).over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
    tot = F.sum(weight).over(w)
    h = hist.withColumns({"_hi": run / tot, "_lo": (run - F.col(weight)) / tot})
    d = h.select("*", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).filter((F.col("q") > F.col("_lo")) & (F.col("q") <= F.col("_hi")))
    x = F.col("bin") + (F.col("q") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    return d.select(*by, "q", (low + x / bins * (high - low)).alias("value"))


def histogram_coverage(hist: DataFrame, bounds: DataFrame, low: float, high: float, bins: int, by: list[str] = ("band",)) -> DataFrame:
    """Share of a held-out histogram (by, bin, n) inside [lo, hi] of each row of bounds (by, level, lo, hi), with the interval's
    multiplicative width; cut bins count in proportion."""
    step = (high - low) / bins
    a = low + F.col("bin") * step
    part = F.greatest(F.lit(0.0), F.least(F.col("hi"), a + step) - F.greatest(F.col("lo"), a)) / step
    return hist.join(bounds, list(by)).groupBy(*by, "level").agg((F.sum(part * F.col("n")) / F.sum("n")).alias("coverage"), F.max(F.exp(F.col("hi") - F.col("lo"))).alias("width"))


def separation_strata(pairs: DataFrame, by: list[str], parts: int, sep: str = "sep") -> DataFrame:
    """Stratum of each pair among the distinct quantile edges of the separation."""
    names = {f"_e{k}": k / parts for k in range(parts + 1)}
    e = quantiles(pairs, list(by), sep, names).select(*by, F.array_distinct(F.array(*names)).alias("_e"))
    k = F.size(F.filter("_e", lambda v: v <= F.col(sep))) - 1
    return pairs.join(e, list(by)).withColumn("stratum", F.greatest(F.lit(0), F.least(k, F.size("_e") - 2))).drop("_e")


def pair_error(pairs: DataFrame, by: list[str], model: str = "model", truth: str = "truth") -> DataFrame:
    """|log(model / truth) - median of its stratum|; NULL where either is missing."""
    r = F.when((F.col(model) > 0) & (F.col(truth) > 0), F.ln(F.col(model) / F.col(truth)))
    d = cut(pairs.withColumn("_r", r))
    m = quantiles(d, [*by, "stratum"], "_r", {"_m": 0.5})
    return d.join(m, [*by, "stratum"], "left").withColumn("error", F.abs(F.col("_r") - F.col("_m"))).drop("_r", "_m")


def stratified_spearman(pairs: DataFrame, by: list[str], score: str = "score", error: str = "error") -> DataFrame:
    """Mean over strata with at least 10 pairs, weighted by pairs, of the rank correlation of score and -error. An infinite
    negative score ranks last."""
    d = pairs.withColumns({"_s": F.when(F.col(score) == float("-inf"), F.lit(-1e300)).otherwise(F.col(score)), "_e": -F.col(error)})
    s = spearman(d, [*by, "stratum"], "_s", "_e", 10, "_rho", "_n").filter(F.col("_rho").isNotNull())
    return s.groupBy(*by).agg((F.sum(F.col("_rho") * F.col("_n")) / F.sum("_n")).alias("rho"), F.sum("_n").alias("pairs"))


def bead_medians(pairs: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Median over a bead's partners of each column."""
    return pairs.select(*by, F.explode(F.array("i", "j")).alias("bead"), *columns).groupBy(*by, "bead").agg(*[median(c).alias(c) for c in columns])


def stratum_ranks(pairs: DataFrame, by: list[str], score: str, out: str) -> DataFrame:
    """Average rank from 0, divided by (stratum size - 1); missing scores rank lowest."""
    key = [*by, "stratum"]
    d = pairs.withColumn("_v", F.coalesce(score, F.lit(-1e9)))
    n = d.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    k = value_ranks(d, key, "_v", out="_k").drop("ties")
    return d.join(k, [*key, "_v"]).join(n, key).withColumn(out, (F.col("_k") - 1) / F.greatest(F.col("_n") - 1, F.lit(1))).drop("_v", "_k", "_n")


def pooled_units(units: DataFrame, weight: str = "pairs", reps: int = 1000, seed: int = 0) -> DataFrame:
    """Weighted mean of unit scores with an interval from resampling the units (units: unit, rho, pairs)."""
    from ..functions.stats import poisson_weight
    u = units.filter(F.col("rho").isNotNull())
    draws = u.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("_w", poisson_weight(F.lit(seed), F.col("rep"), F.col("unit")) * F.col(weight))
    m = draws.groupBy("rep").agg((F.sum(F.col("_w") * F.col("rho")) / F.nullif(F.sum("_w"), F.lit(0))).alias("_m"))
    ci = m.agg(F.percentile("_m", F.lit(0.025)).alias("low"), F.percentile("_m", F.lit(0.975)).alias("high"))
    return u.agg((F.sum(F.col("rho") * F.col(weight)) / F.sum(weight)).alias("rho"), F.count(F.lit(1)).alias("units")).join(F.broadcast(ci), F.lit(True))


def input_scores(pairs: DataFrame, by: list[str], r_c: float) -> DataFrame:
    """Reliability scores of a pair from its input frequency f, count and model spread: input error, misfit, both. Higher is
    better; a pair without input has misfit -infinity."""
    seen = F.col("f").isNotNull() & (F.coalesce("counts", F.lit(0.0)) > 0)
    fill = quantiles(pairs, list(by), "f", {"_fill": 0.5})
    d = pairs.join(fill, list(by), "left").withColumn("_f", F.when(seen, F.col("f")).otherwise(F.coalesce("_fill", F.lit(0.1))))
    f = F.greatest(F.lit(1e-6), F.least(F.lit(0.999), F.col("_f")))
    up, down = F.least(f * F.exp(F.lit(0.01)), F.lit(0.9995)), f * F.exp(F.lit(-0.01))
    slope = F.abs(F.ln(sigma_of(up)) - F.ln(sigma_of(down))) / (F.ln(up) - F.ln(down))
    se = slope * F.sqrt(F.greatest(F.lit(1e-6), F.least(F.lit(1.0), 1 - F.col("_f"))) / F.greatest(F.coalesce("counts", F.lit(0.0)), F.lit(0.5)))
    n = F.greatest(F.coalesce("n_obs", F.lit(1000.0)), F.lit(1.0))
    target = 2.0 * F.ln(sigma_of(F.greatest(0.5 / n, F.least(1 - 0.5 / n, F.col("f")))))
    mis = F.when(F.col("f").isNotNull(), F.abs(2.0 * F.ln(F.greatest(F.col("sigma") / r_c, F.lit(1e-12))) - target)).otherwise(float("inf"))
    d = d.withColumns({"_se": se, "_mis": mis})
    return d.select(*pairs.columns, (-F.col("_se")).alias("input_se"), (-F.col("_mis")).alias("misfit"), (-F.sqrt(F.col("_se") ** 2 + F.col("_mis") ** 2)).alias("combined"))


def mean_over_splits(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    return rows.filter(F.col("status") == "ok").groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics], F.count(F.lit(1)).alias("splits"))


def where_beaten(summary: DataFrame, own: list[str], keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, method, value, best_method, best): every other method above the best own one."""
    long = summary.select(*keys, "method", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics]))).filter(F.col("value").isNotNull())
    mine = long.filter(F.col("method").isin(own)).groupBy(*keys, "metric").agg(F.max("value").alias("best"), F.max_by("method", F.struct("value", "method")).alias("best_method"))
    return long.filter(~F.col("method").isin(own)).join(mine, [*keys, "metric"]).filter(F.col("value") > F.col("best"))


def mean_by_separation(pairs: DataFrame, by: list[str], value: str = "value", max_sep: int | None = None) -> DataFrame:
    d = pairs.filter(F.col(value).isNotNull()).withColumn("sep", F.col("j") - F.col("i"))
    d = d if max_sep is None else d.filter(F.col("sep") <= max_sep)
    return d.groupBy(*by, "sep").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("pairs"))


def loops_in_windows(loops: DataFrame, windows: DataFrame, min_sep: int, max_sep: int) -> DataFrame:
    """Loops (chrom, a, b) wholly inside a window (window, chrom, start, span) and within the separation range."""
    d = F.col("b") - F.col("a")
    spans = windows.withColumn("_stop", F.col("start") + F.col("span"))
    hit = points_in_intervals(loops.filter(d.between(min_sep, max_sep)), spans, ["chrom"], "a", "start", "_stop")
    return hit.filter(F.col("b") < F.col("_stop")).drop("_stop")


def pooled_f1(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    """Precision, recall and F1 of summed true positives, false positives and false negatives."""
    s = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("*", F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"), F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"),
                    F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1"))


def roc_auc(df: DataFrame, by: list[str], label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve from average ranks; NULL with a single class."""
    d = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    cells = cut(d.groupBy(*by, score).agg(F.sum(label).cast("double").alias("_p"), F.count(F.lit(1)).alias("_n")))
    k = cells.join(value_ranks(cells, list(by), score, "_n").drop("ties"), [*by, score])
    s = k.groupBy(*by).agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"), F.sum(F.col("_p") * F.col("rank")).alias("r"))
    neg = F.col("n") - F.col("p")
    return s.select(*by, F.when((F.col("p") > 0) & (neg > 0), (F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * neg)).alias("auc"))


def tile_of(n: Column, locus: Column, k: Column) -> Column:
    """Index of the one of k equal windows over n loci that holds a locus (edges rounded half to even)."""
    guess = F.floor(locus * k / n)
    edge = lambda t: F.bround(n * t / k)                                                     # noqa: E731
    return F.when(locus < edge(guess), guess - 1).when(locus >= edge(guess + 1), guess + 1).otherwise(guess)


def share_of_ceiling(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Trend-removed agreement of a prediction with half b over that of half a with half b, for all pairs and for pairs inside
    one of the `tiles` equal tiles of the loci (pairs: by, i, j, sep, pred, median_a, median_b, n, tiles)."""
    by = list(by)
    tile = lambda c: tile_of(F.col("n"), F.col(c), F.col("tiles"))                            # noqa: E731
    d = pairs.withColumn("_in", tile("i") == tile("j"))
    sets = F.when(F.col("_in"), F.array(F.lit("all_pairs"), F.lit("within_tiles"))).otherwise(F.array(F.lit("all_pairs")))
    d = cut(d.withColumn("pair_set", F.explode(sets)))
    key = [*by, "pair_set"]
    top = map_scores(d, key, "median_a", "median_b").select(*key, F.col("spearman_trend_removed").alias("ceiling"))
    s = map_scores(d, key, "pred", "median_b")
    return s.join(top, key).withColumn("percent_of_ceiling", 100 * F.col("spearman_trend_removed") / F.col("ceiling"))
