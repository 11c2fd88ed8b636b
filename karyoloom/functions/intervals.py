"""Interval, as-of and tolerance joins as equi-joins on position buckets.

An interval is stored at the smallest bucket width that is not shorter than it, so it meets at most two buckets however
long it is; a point looks up one bucket per width. A chromosome with most of the rows is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import idiv

WIDTHS = tuple(1024 * 16 ** k for k in range(6))      # 1 kb ... 1.07 Gb


def points_in_intervals(points: DataFrame, intervals: DataFrame, by: list[str], pos: str = "pos",
                        start: str = "start", end: str = "end") -> DataFrame:
    """Every (point, interval) with start <= pos < end. Column names other than `by` must differ. A point looks up only
    the widths that some interval has."""
    size = F.col(end) - F.col(start)
    level = sum((F.when(size > w, 1).otherwise(0) for w in WIDTHS[:-1]), F.lit(0))
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in WIDTHS]), F.col("_lv") + 1)
    sized = intervals.filter(size > 0).withColumn("_lv", level)
    iv = sized.withColumn("_bk", F.explode(F.sequence(idiv(F.col(start), width), idiv(F.col(end) - 1, width))))
    present = sized.select("_lv").distinct()                                           # six rows at most
    pt = points.join(F.broadcast(present), F.lit(True)).withColumn("_bk", idiv(F.col(pos), width))
    hit = pt.join(iv, [*by, "_lv", "_bk"])
    return hit.filter((F.col(pos) >= F.col(start)) & (F.col(pos) < F.col(end))).drop("_lv", "_bk")


def overlaps(a: DataFrame, b: DataFrame, by: list[str], a_span=("a_start", "a_end"),
             b_span=("b_start", "b_end")) -> DataFrame:
    """Every overlapping pair of two interval tables: either b starts inside a, or a starts strictly inside b."""
    (s1, e1), (s2, e2) = a_span, b_span
    one = points_in_intervals(b, a, by, s2, s1, e1).filter(F.col(e2) > F.col(s2))
    two = (points_in_intervals(a, b, by, s1, s2, e2)
           .filter((F.col(s1) > F.col(s2)) & (F.col(e1) > F.col(s1))))
    return one.unionByName(two)


def last_before(points: DataFrame, events: DataFrame, by: list[str], pos: str, at: str) -> DataFrame:
    """As-of join: each point with the last event at or before it (none = NULL). `events` holds one row per place, so
    its window is bounded by the length of the axis; the points are never sorted. The last event of a group has no end."""
    spans = events.withColumn("_end", F.lead(at).over(W.partitionBy(*by).orderBy(at)))
    places = points.select(*by, pos).distinct()
    hit = points_in_intervals(places, spans.filter(F.col("_end").isNotNull()), by, pos, at, "_end").drop("_end")
    last = spans.filter(F.col("_end").isNull()).drop("_end")                            # a row for each group
    after = places.join(last, by).filter(F.col(pos) >= F.col(at)).select(*hit.columns)
    return points.join(hit.unionByName(after), [*by, pos], "left")


def within(a: DataFrame, b: DataFrame, by: list[str], pairs: list[tuple[str, str]], tolerance: list[int],
           ) -> DataFrame:
    """Pairs of rows whose coordinates `pairs` (name in a, name in b) all differ by at most `tolerance`."""
    names = [f"_k{k}" for k in range(len(pairs))]
    left, right = a, b
    for (x, y), t, k in zip(pairs, tolerance, names):
        w = max(1, int(t) + 1)
        left = left.withColumn(k, F.explode(F.sequence(idiv(F.col(x) - int(t), w), idiv(F.col(x) + int(t), w))))
        right = right.withColumn(k, idiv(F.col(y), w))
    hit = left.join(right, [*by, *names]).drop(*names)
    for (x, y), t in zip(pairs, tolerance):
        hit = hit.filter(F.abs(F.col(x) - F.col(y)) <= int(t))
    return hit


def pair_tiles(df: DataFrame, by: list[str], index: str, fields: list[str], tile: int = 256,
               min_sep: int = 1, max_sep: int | None = None) -> DataFrame:
    """All index pairs i < j of a group with min_sep <= j - i <= max_sep, as tile joins: a pair map has n^2/2 rows by
    definition, and each (tile, tile) block of it is an independent join key of at most tile^2 pairs."""
    t = idiv(F.col(index), tile)
    top = df.groupBy(*by).agg(F.max(t).alias("_top"))
    reach = F.col("_top") if max_sep is None else F.least(F.col("_top"), idiv(F.col(index) + int(max_sep), tile))
    low = F.lit(0) if max_sep is None else F.greatest(F.lit(0), idiv(F.col(index) - int(max_sep), tile))
    src = df.join(top, by)
    a = src.select(*by, F.col(index).alias("i"), *[F.col(f).alias(f"{f}_i") for f in fields], t.alias("_ti"),
                   F.explode(F.sequence(t, reach)).alias("_tj"))
    b = src.select(*by, F.col(index).alias("j"), *[F.col(f).alias(f"{f}_j") for f in fields], t.alias("_tj"),
                   F.explode(F.sequence(low.cast("long"), t)).alias("_ti"))
    sep = F.col("j") - F.col("i")
    keep = sep >= min_sep if max_sep is None else (sep >= min_sep) & (sep <= max_sep)
    return a.join(b, [*by, "_ti", "_tj"]).filter(keep).drop("_ti", "_tj")


def overlap_cells(df: DataFrame, start: str, end: str, width: int, out: str = "bin") -> DataFrame:
    """One row per bin an interval touches, with `overlap` in bp."""
    b = df.withColumn(out, F.explode(F.sequence(idiv(F.col(start), width), idiv(F.col(end) - 1, width))))
    return b.withColumn("overlap", F.least(F.col(end), (F.col(out) + 1) * width) - F.greatest(F.col(start), F.col(out) * width))
