"""Near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, turns every vector into a code of sign bits, and orders the vectors by code, then by
projection on one more direction, then by id. The order is cut into blocks; a vector is compared with its own block and the
next one, a window of at least one block on either side. The cosine is computed in double precision; only pairs at or above the threshold link. The
number of passes follows from the number of vectors: a pair at the threshold keeps each bit with probability 1 - angle / pi,
and must keep the bits that tell blocks apart; passes are added until a pair at the threshold is met with `recall`.

Pairs are not written out. A block returns a spanning forest of its links, and the passes serve to find the components. Links lie
within components, so they are counted there: a component is cut into chunks of at most about `block_rows` vectors, and all
pairs of chunks are compared, however large it is. Equal vectors are one class with a count, so a vector that holds a third of
the rows is compared once.

Defined cases: a vector that is null, zero, or holds null or non-finite components, or has another length than most, links
with nothing: n_links 0, itself as component; rows with equal ids are rows of their own; null ids are kept and count as no
smallest id; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.groups import components
from .common import partitions, stored
from .vantage_simhash import _joined

BLOCK_ROWS = 2_048
RECALL = 0.999
BITS = 48


def passes_for(n: int, threshold: float, block_rows: int, recall: float) -> int:
    """Passes until a pair at the threshold shares a window with probability `recall`: its codes must agree on the bits that
    tell blocks apart."""
    bits = math.ceil(math.log2(max(n / block_rows, 1)))
    keep = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if keep >= recall else math.ceil(math.log(1 - recall) / math.log(1 - keep))


def planes(dims: int, number: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, number]).standard_normal((BITS + 1, dims))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.stack(vectors.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)             # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def codes(classes: DataFrame, number: int, dims: int, seed: int) -> DataFrame:
    """(cls, code, along): sign bits of the pass, first plane highest, and the projection that orders equal codes."""
    def project(batches):
        p = planes(dims, number, seed)
        power = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            if len(batch):
                y = _unit(batch.vec) @ p.T
                yield pd.DataFrame({"cls": batch.cls, "code": (y[:, :BITS] > 0) @ power, "along": y[:, BITS]})

    return classes.select("cls", "vec").mapInPandas(project, "cls bigint, code bigint, along double")


def ranked(coded: DataFrame, block_rows: int) -> DataFrame:
    """(cls, block): the rank of a vector in the order of (code, along, cls), in blocks. The order is cut into ranges of even
    size, which are counted and ordered each on its own, whatever codes are common."""
    rows = stored(coded.repartitionByRange(partitions(coded.sparkSession), "code", "along", "cls").withColumn("_part", F.spark_partition_id()))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)            # a row for each range
    base = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inner = F.row_number().over(W.partitionBy("_part").orderBy("code", "along", "cls")) - 1
    return rows.withColumn("_in", inner).join(base, "_part").select(
        "cls", F.floor((F.col("_base") + F.col("_in")) / block_rows).cast("int").alias("block"))


def _compare(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links of the home rows (side 0) among themselves and with the next block (side 1): a row for each vector that is joined to
    another: cls, root (a vector of its group in this window)."""
    group = group.sort_values(["side", "cls"], ignore_index=True)
    x, cls = _unit(group.vec), group.cls.to_numpy(np.int64)
    home = int((group.side == 0).sum())
    label = np.arange(len(group))
    for a in range(0, home, 512):
        b = min(a + 512, home)
        near = x[a:b] @ x.T >= threshold
        near[:, :a] = False
        near[:, a:b] &= np.arange(a, b)[:, None] < np.arange(a, b)[None, :]
        i, j = np.nonzero(near)
        i = i + a
        open_ = label[i] != label[j]
        if open_.any():
            label = _joined(label, i[open_], j[open_])
    told = label != np.arange(len(label))
    return pd.DataFrame({"cls": cls[told], "root": cls[label[told]]})


def _comparer(threshold: float):
    return lambda group: _compare(group, threshold)


def _counted(members: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(cls, n): the vectors that each of `members` (cls, size, vec, group) links to in its group. Small groups share a task;
    a pair of chunks of a larger one is a task of its own."""
    sizes = stored(members.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_m")))
    tasks = max(1, math.ceil(members.count() / block_rows))
    own = F.when(F.col("_m") > 1, F.pmod(F.xxhash64("cls"), "_m").cast("int")).otherwise(0)
    other = F.explode(F.sequence(F.lit(0), F.col("_m") - 1))
    dealt = members.join(sizes, "group").withColumn("_own", own).withColumn("_other", other).select(
        "cls", "size", "vec", "group", F.when(F.col("_m") > 1, F.col("group")).otherwise(F.pmod(F.xxhash64("group"), F.lit(tasks))).alias("_g"),
        F.col("_m").alias("_m"), F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), "_own")

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = rows["_a"].iloc[0], rows["_b"].iloc[0]
        left, right = (rows, rows) if a == b else (rows[rows["_own"] == a], rows[rows["_own"] == b])
        if left.empty or right.empty:
            return pd.DataFrame({"cls": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        x, y = _unit(left.vec), _unit(right.vec)
        u, v = left.group.to_numpy(), right.group.to_numpy()
        here, there = left["size"].to_numpy(np.int64), right["size"].to_numpy(np.int64)
        n, back = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for k in range(0, len(x), 512):
            near = (x[k:k + 512] @ y.T >= threshold) & (u[k:k + 512, None] == v[None, :])
            if a == b:
                near[np.arange(len(near)), np.arange(k, k + len(near))] = False
            n[k:k + 512] = near @ there
            back += here[k:k + 512] @ near
        if a == b:
            return pd.DataFrame({"cls": left.cls, "n": n})
        return pd.DataFrame({"cls": np.concatenate([left.cls, right.cls]), "n": np.concatenate([n, back])})

    return dealt.groupBy("_m", "_g", "_a", "_b").applyInPandas(count, "cls bigint, n bigint").groupBy("cls").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, block_rows: int = BLOCK_ROWS, recall: float = RECALL, passes: int | None = None,
                    seed: int = 7, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector."""
    plain = F.array().cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vec"))
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))          # noqa: E731
    good = F.coalesce(F.forall("vec", fine) & F.exists("vec", lambda v: v != 0), F.lit(False))
    rows = stored(rows.select("vec_id", F.when(good, F.col("vec")).otherwise(plain).alias("vec")))
    common = rows.filter(F.size("vec") > 0).groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common.d if common else 0
    # equal vectors are one class; adding zero makes -0.0 and 0.0 one value
    usable = rows.filter((F.size("vec") == dims) & (F.size("vec") > 0)).select("vec_id", F.transform("vec", lambda v: v + F.lit(0.0)).alias("vec"))
    classes = stored(usable.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("size"))
                     .withColumn("cls", F.xxhash64("vec")))
    total = classes.count()
    passes = passes or passes_for(total, threshold, block_rows, recall)
    blocks = classes.select("cls", F.array().cast("array<int>").alias("blocks"))
    for k in range(passes):
        found = ranked(codes(classes, k, max(dims, 1), seed), block_rows)
        blocks = stored(blocks.join(found, "cls").select("cls", F.concat("blocks", F.array("block")).alias("blocks")))
    ready = stored(classes.select("cls", "size", "vec").join(blocks, "cls"))
    made = None
    for k in range(passes):
        at = F.element_at("blocks", k + 1)
        sides = ready.select("cls", "vec", F.explode(F.array(F.struct(at.alias("window"), F.lit(0).alias("side")), F.struct(
            (at - 1).alias("window"), F.lit(1).alias("side")))).alias("_s")).select("cls", "vec", "_s.*")
        part = sides.groupBy("window").applyInPandas(_comparer(threshold), "cls bigint, root bigint")
        made = part if made is None else made.unionByName(part)
    made = stored(made)
    edges = made.select(F.col("cls").alias("a"), F.col("root").alias("b")).distinct()
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    labels = stored(components(ends, edges, []).select(F.col("node").alias("cls"), "component"))
    members = classes.select("cls", "size", "vec").join(labels.select("cls", F.col("component").alias("group")), "cls")
    counted = _counted(members, threshold, block_rows)
    named = classes.select("cls", "least", "size").join(labels, "cls", "left").join(counted, "cls", "left") \
        .withColumn("group", F.coalesce("component", "cls"))
    least = named.groupBy("group").agg(F.min("least").alias("component_id"))
    facts = named.join(least, "group").select("cls", "component_id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    keyed = rows.select("vec_id", F.when((F.size("vec") == dims) & (F.size("vec") > 0), F.xxhash64(F.transform("vec", lambda v: v + F.lit(0.0)))).alias("cls"))
    out = keyed.join(facts, "cls", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("cls").isNull(), F.col("vec_id")).otherwise(
            F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
