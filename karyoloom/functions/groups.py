"""Runs, greedy selection, components and matching."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..core import cut


def runs(df: DataFrame, by: list[str], pos: str, gap: int = 0, min_len: int = 1, equal: list[str] = ()) -> DataFrame:
    """Islands of positions: consecutive when at most `gap` places are missing and `equal` columns agree. The window
    runs over places of one axis (bins, beads), whose number does not grow with the reads."""
    w = W.partitionBy(*by).orderBy(pos)
    new = (F.col(pos) - F.lag(pos).over(w) > gap + 1)
    for c in equal:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    marked = df.withColumn("_isl", F.sum(F.when(F.coalesce(new, F.lit(False)), 1).otherwise(0)).over(w))
    out = marked.groupBy(*by, *equal, "_isl").agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end"),
                                                 F.count(F.lit(1)).alias("length"))
    return out.filter(F.col("length") >= min_len).drop("_isl")


BLOCK = (8192, 256, 64)          # places along each coordinate of a block, by the number of coordinates
OPEN, KEPT, DROPPED = 0, 1, 2


def _settled(order: np.ndarray, points: np.ndarray, state: np.ndarray, own: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """States after going through `order`, best first. A row near a kept one is dropped; one with a better open row near it
    stays open, and so does one of the halo, whose neighbours are not all here; any other is kept."""
    state = state.copy()
    cells = points // (radius + 1)
    steps = np.stack(np.meshgrid(*[[-1, 0, 1]] * points.shape[1], indexing="ij"), axis=-1).reshape(-1, points.shape[1])
    there: dict[tuple, list[int]] = {}
    for k in np.flatnonzero(state == KEPT):
        there.setdefault(tuple(cells[k]), []).append(k)
    for k in order:
        if state[k] == KEPT:
            continue
        near = [m for s in steps for m in there.get(tuple(cells[k] + s), ()) if (np.abs(points[m] - points[k]) <= radius).all()]
        if any(state[m] == KEPT for m in near):
            state[k] = DROPPED
            continue
        state[k] = OPEN if near or not own[k] else KEPT
        there.setdefault(tuple(cells[k]), []).append(k)
    return state


def greedy(df: DataFrame, by: list[str], coords: list[str], radius: list[int], score: str = "score") -> DataFrame:
    """Take the best score, drop everything within `radius` of it, repeat; ties go to the smaller coordinates. The axis is cut
    into blocks wider than the radius, and a task settles all rows of a block that don't hang on open rows outside it. The
    next round cuts at the middles of these blocks, so a round carries a chain of falling scores on by half a block: the same
    set as one row at a time, in rounds that follow from the longest such chain in blocks, not in rows. A null score is the
    least."""
    by, n = list(by), len(coords)
    width = [max(BLOCK[min(n, len(BLOCK)) - 1], 32 * (r + 1)) for r in radius]
    reach = np.array(radius)
    rows = df.select(*by, *coords, F.coalesce(F.col(score).cast("double"), F.lit(float("-inf"))).alias("_s")).distinct()
    live = rows.withColumn("_state", F.lit(OPEN))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in live.schema)
    at, own = [f"_at{k}" for k in range(n)], [f"_own{k}" for k in range(n)]

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        mine = (frame[at].to_numpy() == frame[own].to_numpy()).all(axis=1)
        points = frame[coords].to_numpy(np.int64)
        order = np.lexsort([*points.T[::-1], -frame["_s"].to_numpy(float)])
        frame["_state"] = _settled(order, points, frame["_state"].to_numpy(np.int32), mine, reach)
        return frame.loc[mine & (frame["_state"] != DROPPED).to_numpy(), [*by, *coords, "_s", "_state"]]

    turn = 0
    while True:
        placed = live
        for c, w, r, a, o in zip(coords, width, radius, at, own):
            moved = F.col(c) + (turn % 2) * (w // 2)
            placed = placed.withColumn(o, F.floor(moved / w)).withColumn(a, F.explode(F.sequence(F.floor((moved - r) / w), F.floor((moved + r) / w))))
        live = cut(placed.groupBy(*by, *at).applyInPandas(settle, kinds))
        if live.filter(F.col("_state") == OPEN).isEmpty():
            return df.join(live.select(*by, *coords), [*by, *coords], "left_semi").select(*df.columns)
        turn += 1


def components(nodes: DataFrame, edges: DataFrame, by: list[str], node: str = "node", a: str = "a",
               b: str = "b") -> DataFrame:
    """(by, node, component): smallest reachable node, by label propagation with shortcuts."""
    by = list(by)
    both = cut(edges.select(*by, F.col(a).alias("u"), F.col(b).alias("v"))
               .unionByName(edges.select(*by, F.col(b).alias("u"), F.col(a).alias("v"))).distinct())
    label = cut(nodes.select(*by, F.col(node).alias("u"), F.col(node).alias("c")).distinct())
    while True:
        seen = both.join(label.select(*by, F.col("u").alias("v"), F.col("c").alias("d")), [*by, "v"]) \
            .groupBy(*by, "u").agg(F.min("d").alias("d"))
        step = label.join(seen, [*by, "u"], "left").select(*by, "u", "c", F.least("c", "d").alias("m"))
        # jump to the label of the label
        jump = step.join(step.select(*by, F.col("u").alias("m"), F.col("m").alias("mm")), [*by, "m"], "left")
        nxt = cut(jump.select(*by, "u", F.coalesce(F.least("m", "mm"), "m").alias("n"), "c"))
        changed = not nxt.filter(F.col("n") < F.col("c")).isEmpty()
        label = nxt.select(*by, "u", F.col("n").alias("c"))
        if not changed:
            return label.select(*by, F.col("u").alias(node), F.col("c").alias("component"))


def match_one_to_one(pairs: DataFrame, by: list[str], a: str, b: str, order: list[str]) -> DataFrame:
    """Greedy one-to-one matching of candidate pairs, smallest `order` first, in rounds of mutual best pairs."""
    by = list(by)
    key = F.struct(*order)
    live, kept = cut(pairs), None
    while not live.isEmpty():
        ranked = (live.withColumn("_ka", F.min(key).over(W.partitionBy(*by, a)))
                  .withColumn("_kb", F.min(key).over(W.partitionBy(*by, b))))
        win = cut(ranked.filter((key == F.col("_ka")) & (key == F.col("_kb"))).drop("_ka", "_kb"))
        kept = win if kept is None else kept.unionByName(win)
        live = cut(live.join(win.select(*by, a), [*by, a], "left_anti").join(win.select(*by, b), [*by, b], "left_anti"))
    return pairs.limit(0) if kept is None else kept


def precision_recall(predicted: DataFrame, reference: DataFrame, matched: DataFrame, by: list[str]) -> DataFrame:
    """tp, fp, fn, precision, recall and F1 per group; a rate without a denominator is NULL."""
    n = lambda d, name: d.groupBy(*by).agg(F.count(F.lit(1)).alias(name))        # noqa: E731
    c = n(predicted, "_p").join(n(reference, "_r"), by, "full").join(n(matched, "tp"), by, "left").na.fill(0, ["_p", "_r", "tp"])
    tp, fp, fn = F.col("tp"), F.col("_p") - F.col("tp"), F.col("_r") - F.col("tp")
    return c.select(*by, tp, fp.alias("fp"), fn.alias("fn"),
                    F.when(tp + fp > 0, tp / (tp + fp)).alias("precision"),
                    F.when(tp + fn > 0, tp / (tp + fn)).alias("recall"),
                    F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1"))
