"""Coordinate liftover through chain blocks (chrom, t_start, t_end, q_chrom, q_start, q_strand, q_size)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.intervals import points_in_intervals


def _reach(blocks: DataFrame) -> DataFrame:
    """A position belongs to the last block starting at or before it, so a block reaches to the next start at most. The
    window runs over the blocks of a chain file, not over positions."""
    w = W.partitionBy("chrom").orderBy("t_start", "t_end", "q_chrom", "q_start", "q_strand", "q_size")
    return blocks.withColumn("_reach", F.least("t_end", F.coalesce(F.lead("t_start").over(w), "t_end")))


def positions(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Distinct (chrom, pos) that map, with q_chrom, q_pos and q_strand."""
    hit = points_in_intervals(points.select("chrom", "pos").distinct(), _reach(blocks), ["chrom"], "pos", "t_start", "_reach")
    off = F.col("q_start") + F.col("pos") - F.col("t_start")
    return hit.select("chrom", "pos", "q_chrom", F.when(F.col("q_strand") == "+", off).otherwise(F.col("q_size") - off - 1).alias("q_pos"), "q_strand")


def lift_positions(points: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of `points` with target columns, NULL where unmapped."""
    return points.join(positions(points, blocks), ["chrom", "pos"], "left")


def _lift_spans(df: DataFrame, blocks: DataFrame, spans: list[tuple[str, str, str, str]], max_change: float) -> DataFrame:
    """Add mapped (chrom, start, end) per span (chrom, start, end, prefix); NULL when an end is unmapped, the ends disagree
    or the length changes too much."""
    ends = None
    for c, s, e, _ in spans:
        for p in (F.col(s), F.col(e) - 1):
            one = df.select(F.col(c).alias("chrom"), p.alias("pos"))
            ends = one if ends is None else ends.unionByName(one)
    mapped = positions(ends, blocks)
    for c, s, e, out in spans:
        side = lambda k: mapped.select(F.col("chrom").alias(c), F.col("pos").alias(f"_p{k}"), F.col("q_chrom").alias(f"_c{k}"),       # noqa: E731
                                       F.col("q_pos").alias(f"_q{k}"), F.col("q_strand").alias(f"_s{k}"))
        df = df.withColumns({"_p1": F.col(s), "_p2": F.col(e) - 1}).join(side(1), [c, "_p1"], "left").join(side(2), [c, "_p2"], "left")
        lo, hi = F.least("_q1", "_q2"), F.greatest("_q1", "_q2") + 1
        size = F.col(e) - F.col(s)
        ok = (F.col("_c1") == F.col("_c2")) & (F.col("_s1") == F.col("_s2")) & (F.abs(hi - lo - size) <= max_change * size)
        df = df.withColumns({f"{out}chrom": F.when(ok, F.col("_c1")), f"{out}start": F.when(ok, lo), f"{out}end": F.when(ok, hi)})
        df = df.drop("_p1", "_p2", "_c1", "_c2", "_q1", "_q2", "_s1", "_s2")
    return df


def lift_intervals(df: DataFrame, blocks: DataFrame, max_change: float = 0.5) -> DataFrame:
    """Intervals (chrom, start, end, ...) with q_chrom, q_start, q_end; NULL means lost."""
    return _lift_spans(df, blocks, [("chrom", "start", "end", "q_")], max_change)


def lift_pairs(df: DataFrame, blocks: DataFrame, max_change: float = 0.5) -> DataFrame:
    """Paired intervals (chrom1, start1, end1, chrom2, start2, end2, ...) with q1_ and q2_ columns; both NULL when either
    side is lost."""
    d = _lift_spans(df, blocks, [("chrom1", "start1", "end1", "q1_"), ("chrom2", "start2", "end2", "q2_")], max_change)
    both = F.col("q1_chrom").isNotNull() & F.col("q2_chrom").isNotNull()
    return d.withColumns({f"{q}{k}": F.when(both, F.col(f"{q}{k}")) for q in ("q1_", "q2_") for k in ("chrom", "start", "end")})
