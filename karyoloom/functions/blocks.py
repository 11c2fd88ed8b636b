"""Sums over pairs of positions on one axis, block by block.

Rows are gathered into blocks of `width` positions, pairs of blocks meet by their distance in blocks, and a task adds up all
pairs of blocks of one group and one such distance. Only sums leave a task: no pair of positions is ever a row. A block holds
the positions of `width` places of one axis, whatever the number of reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..core import idiv, same


def blocked(df: DataFrame, by: list[str], pos: str, values: list[str], width: int) -> DataFrame:
    """(by, _block, _pos, values): positions within the block and their values as arrays, in the order of the positions."""
    rows = df.select(*by, F.floor(F.col(pos) / width).alias("_block"), F.struct(F.pmod(F.col(pos), F.lit(width)).cast("int").alias("_pos"), *[F.col(v).cast("double").alias(v) for v in values]).alias("_r"))
    held = rows.groupBy(*by, "_block").agg(F.array_sort(F.collect_list("_r")).alias("_r"))          # at most the rows of `width` positions
    return held.select(*by, "_block", *[F.col(f"_r.{c}").alias(c) for c in ("_pos", *values)])


def pair_sums(df: DataFrame, by: list[str], pos: str, values: list[str], width: int, names: str, add: Callable, finish: Callable, min_sep: int = 0,
              max_sep: Column | int | None = None) -> DataFrame:
    """Rows (by, names) of all pairs of positions, summed per distance of blocks. `add(total, left, right, own)` takes the sum so far
    (None at first) and the arrays of two blocks (`own`: a block with itself); `finish(total, shift)` gives the columns of `names`,
    where separations count from `shift` = distance in positions of the blocks. Pairs of blocks beyond max_sep are left out."""
    by = list(by)
    held = blocked(df, by, pos, values, width)
    columns = ["_pos", *values]
    side = lambda k: held.select(*by, "_block", F.struct(*columns).alias("_v")).alias(k)                     # noqa: E731
    gap = F.col("b._block") - F.col("a._block")
    met = same("a", "b", by) & (gap >= 0) & ((gap + 1) * width > min_sep)
    if max_sep is not None:
        met = met & ((gap - 1) * width < (F.lit(max_sep) if isinstance(max_sep, int) else max_sep))
    pairs = side("a").join(side("b"), met).select(*[F.col(f"a.{c}") for c in by], gap.cast("long").alias("_gap"), *[F.col(f"a._v.{c}").alias(f"l{c}") for c in columns],
                                                  *[F.col(f"b._v.{c}").alias(f"r{c}") for c in columns])
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        total, gap = None, int(key[-1])
        for row in zip(*[frame[f"{s}{c}"] for s in "lr" for c in columns]):
            arrays = [np.asarray(x) for x in row]
            total = add(total, dict(zip(columns, arrays)), dict(zip(columns, arrays[len(columns):])), gap == 0)
        out = pd.DataFrame(finish(total, gap * width))
        for k, c in enumerate(by):
            out.insert(k, c, [key[k]] * len(out))
        return out

    return pairs.groupBy(*by, "_gap").applyInPandas(run, ", ".join([*kinds, names]))


def coinciding(df: DataFrame, by: list[str], pos: str, max_sep: Column | int | None = None, width: int = 4096) -> DataFrame:
    """(by, d, k): how many pairs of the (distinct) positions lie d >= 0 apart: correlation of the blocks' masks by FFT."""
    size = 2 * width

    def add(total, left, right, own):
        mask = [np.bincount(x["_pos"], minlength=size).astype(np.float64) for x in (left, right)]
        one = np.conj(np.fft.rfft(mask[0])) * np.fft.rfft(mask[1])
        return one if total is None else total + one

    def finish(total, shift):
        k = np.rint(np.fft.irfft(total, size)).astype(np.int64)
        d = np.concatenate([np.arange(width), np.arange(-width, 0)]) + shift
        keep = (k > 0) & (d >= 0)
        return {"d": d[keep], "k": k[keep]}

    sums = pair_sums(df, by, pos, [], width, "d long, k long", add, finish, max_sep=max_sep)
    return sums.groupBy(*by, "d").agg(F.sum("k").alias("k"))


def _distances(left: dict, right: dict, axes: list[str]) -> np.ndarray:
    return np.sqrt(sum((left[c][:, None] - right[c][None]) ** 2 for c in axes))


def log_distance_sums(df: DataFrame, by: list[str], pos: str, axes: list[str], min_sep: int, max_sep: int | None, width: int = 512) -> DataFrame:
    """(by, s, k, one, two): pairs at each separation with a distance above 0, and the sums of ln d and its square."""
    def add(total, left, right, own):
        s = right["_pos"][None].astype(np.int64) - left["_pos"][:, None] + width
        d = _distances(left, right, axes)
        use = (d > 0) & (s > width if own else True)
        ld, s = np.log(d[use]), s[use]
        one = np.stack([np.bincount(s, w, 2 * width + 1) for w in (None, ld, ld * ld)])
        return one if total is None else total + one

    def finish(total, shift):
        s = np.arange(2 * width + 1) - width + shift
        keep = (total[0] > 0) & (s >= min_sep) & (s <= (max_sep if max_sep is not None else s.max()))
        return {"s": s[keep], "k": total[0][keep].astype(np.int64), "one": total[1][keep], "two": total[2][keep]}

    sums = pair_sums(df, by, pos, axes, width, "s long, k long, one double, two double", add, finish, min_sep, None if max_sep is None else max_sep + 1)
    return sums.groupBy(*by, "s").agg(*[F.sum(c).alias(c) for c in ("k", "one", "two")])


def distance_moments(df: DataFrame, by: list[str], pos: str, first: list[str], second: list[str], width: int = 512) -> DataFrame:
    """(by, pairs, correlation) of the distances of all pairs in two sets of coordinates. Blocks send count, means and centred
    sums, which are put together about the mean of all."""
    def add(total, left, right, own):
        a, b = _distances(left, right, first), _distances(left, right, second)
        use = np.triu(np.ones(a.shape, bool), 1) if own else np.ones(a.shape, bool)
        total = total if total is not None else []
        if use.any():
            a, b = a[use], b[use]
            ma, mb = a.mean(), b.mean()
            total.append((a.size, ma, mb, ((a - ma) ** 2).sum(), ((b - mb) ** 2).sum(), ((a - ma) * (b - mb)).sum()))
        return total

    names = ["n", "ma", "mb", "saa", "sbb", "sab"]
    finish = lambda total, shift: {c: [t[k] for t in total] for k, c in enumerate(names)}                # noqa: E731
    parts = pair_sums(df, by, pos, [*first, *second], width, "n long, ma double, mb double, saa double, sbb double, sab double", add, finish)
    n = F.sum("n")
    whole = parts.groupBy(*by).agg(n.alias("pairs"), (F.sum(F.col("n") * F.col("ma")) / n).alias("_a"), (F.sum(F.col("n") * F.col("mb")) / n).alias("_b"))
    da, db = F.col("ma") - F.col("_a"), F.col("mb") - F.col("_b")
    centred = parts.join(whole, list(by)) if by else parts.crossJoin(whole)
    total = lambda s, x: F.sum(F.col(s) + F.col("n") * x)                                               # noqa: E731
    top, below = total("sab", da * db), F.sqrt(total("saa", da * da) * total("sbb", db * db))
    return centred.groupBy(*by).agg(n.alias("pairs"), F.when(below > 0, top / below).alias("correlation"))


TILE = 256                # places along a side of a tile of pairs
PAIRS = 2_000_000         # pairs of rows that a task compares at a time


def tiled(df: DataFrame, by: list[str], index: str) -> DataFrame:
    """Rows of `df` under every tile (tile_i, tile_j), tile_i <= tile_j, of pairs of places that their own place takes part in. The
    tiles of a group are one number for every TILE places of its axis."""
    d = df.withColumn("_own", idiv(F.col(index), TILE))
    held = d.groupBy(*by).agg(F.collect_set("_own").alias("_tiles"))
    d = d.join(F.broadcast(held), list(by)).withColumn("_other", F.explode("_tiles"))
    return d.withColumns({"tile_i": F.least("_own", "_other"), "tile_j": F.greatest("_own", "_other")}).drop("_own", "_other", "_tiles")


def spread(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """`many` consecutive numbers from each `begin`."""
    return np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin, many)


def tile_pairs(unit: np.ndarray, place: np.ndarray, tile_i: int, tile_j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) of one tile with place i < place j and the same unit (numbers from 0), in strips of whole places i."""
    left, right = np.flatnonzero(place // TILE == tile_i), np.flatnonzero(place // TILE == tile_j)
    if not len(left) or not len(right):
        return
    left, right = left[np.argsort(place[left], kind="stable")], right[np.argsort(unit[right], kind="stable")]
    held = np.bincount(unit[right], minlength=int(unit.max()) + 1)
    begin, many = (np.cumsum(held) - held)[unit[left]], held[unit[left]]
    total = np.cumsum(many)
    ends = np.flatnonzero(np.append(place[left][1:] != place[left][:-1], True)) + 1
    a = 0
    while a < len(left):
        done = total[a - 1] if a else 0
        fits = ends[(ends > a) & (total[ends - 1] - done <= PAIRS)]
        e = int(fits[-1]) if len(fits) else int(ends[ends > a][0])
        i, j = np.repeat(left[a:e], many[a:e]), right[spread(begin[a:e], many[a:e])]
        use = place[i] < place[j]
        yield i[use], j[use]
        a = e


def cell_of(place_i: np.ndarray, place_j: np.ndarray, tile_i: int, tile_j: int) -> np.ndarray:
    """Number of a pair of places within its tile."""
    return ((place_i - tile_i * TILE) * TILE + place_j - tile_j * TILE).astype(np.uint16)
