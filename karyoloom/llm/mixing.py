"""Mixing sources to target weights.

The words of each source, document after document, are packed into blocks of fixed length. A target number of words per source
follows from the weights, no more than `most_times` its size. The mix has as many slots as blocks are wanted; output shards
draw how many slots each source gets: multinomial counts, held to the source's total (each node of a binary tree over the
shards splits its counts by a multivariate hypergeometric draw seeded by the node), so any shard is drawn on its own and the
totals hold exactly. Slot number r of a source takes block perm(r mod blocks) in round r div blocks: a pseudorandom index
permutation per source and round, evaluated per index. Slots and blocks meet by an equi-join on (source, block).

Defined cases: a null text has no words; a document without words, or of a source without words, takes none; a null source is
a source of its own, last in order; a null id orders first; rows with equal ids are rows of their own, in order of their text;
an empty table gives an empty mix; columns other than the three named are kept by `mix_documents`. The order of documents
within a source is that of a hash of the id, so no task holds a source. Texts of any length are cut over blocks.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import field, mix64, partitions, rows_of, stored, whole

BLOCK_WORDS = 64
SHARD_SLOTS = 4_096
VOLUME_SLOTS = 1 << 26               # slots of a tree of draws; more slots are cut into volumes of even shares
BUCKETS = 2_048                      # parts of a source within which documents are ordered
ROUNDS = 8                           # of the permutation network


def words_in(text: Column | str) -> Column:
    """Number of words between white space, as a long."""
    return F.regexp_count(whole(text), F.lit(r"[^\x20\x09-\x0D]++")).cast("bigint")


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (5, 2, 1), most_times: int = 3) -> dict[str | None, Fraction]:
    """Words wanted per source: weights in code-point order, null last, shares of all words; what exceeds `most_times` a
    source's size is shared among the others by weight until none exceeds it."""
    order = sorted(s for s in sizes if s is not None) + [s for s in sizes if s is None]
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = Fraction(sum(sizes.values())), list(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most_times * sizes[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = Fraction(most_times * sizes[s])
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Place of each index under the permutation of range(size) that `key` names: rounds of swap-or-not. The partner of x is
    c - x modulo the size; both or neither of a pair swap, by one bit of the larger of the two."""
    x = index.astype(np.int64)
    rounds = np.maximum(ROUNDS, 6 * np.ceil(np.log2(np.maximum(size, 2)))).astype(np.int64)
    for r in range(int(rounds.max()) if len(rounds) else 0):
        c = (mix64(key, 2 * r) % size.astype(np.uint64)).astype(np.int64)
        partner = (c - x) % size
        top = np.maximum(x, partner)
        swap = (mix64(key ^ mix64(top), 2 * r + 1) & np.uint64(1)).astype(bool) & (r < rounds)
        x = np.where(swap, partner, x)
    return x


def shard_counts(slots: np.ndarray, shard_slots: np.ndarray, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(slots of each source in the shard, slots of each source in the shards before), by the tree of draws."""
    left, before, lo, hi, node = slots.astype(np.int64).copy(), np.zeros(len(slots), np.int64), 0, len(shard_slots), 1
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, node])
        near = rng.multivariate_hypergeometric(left, int(shard_slots[lo:mid].sum()), method="marginals")
        if shard < mid:
            left, hi, node = near, mid, 2 * node
        else:
            before, left, lo, node = before + near, left - near, mid, 2 * node + 1
    return left, before


def _source_sizes(sized: DataFrame, source: str) -> dict[str | None, int]:
    """Words per source: a row for each source comes to the driver, as the target weights do."""
    return {r[0]: int(r[1]) for r in sized.groupBy(source).agg(F.sum("_size")).collect()}


def plan(sizes: dict[str | None, int], weights: tuple[int, ...], most_times: int, block_words: int) -> pd.DataFrame:
    """A row for each source: number, size, target, blocks, slots."""
    goal = targets(sizes, weights, most_times)
    rows = []
    for k, s in enumerate(goal):
        blocks = -(-sizes[s] // block_words)
        mean = sizes[s] / blocks if blocks else 1
        slots = min(most_times * blocks, round(float(goal[s]) / mean))
        rows.append((s, k, sizes[s], float(goal[s]), blocks, slots))
    return pd.DataFrame(rows, columns=["source", "source_no", "source_size", "target", "blocks", "slots"])


def draw_slots(spark, table: pd.DataFrame, seed: int = 0, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source_no, round, block): the blocks that each output shard takes, a row for each slot."""
    slots, blocks = table.slots.to_numpy(np.int64), table.blocks.to_numpy(np.int64)
    total = int(slots.sum())
    volumes = max(1, math.ceil(total / VOLUME_SLOTS))
    per_volume = max(1, math.ceil(total / volumes / shard_slots))
    shards = volumes * per_volume
    numbers = spark.range(0, shards, 1, max(1, min(shards, partitions(spark))))

    def draw(batches):
        for batch in batches:
            for shard in batch.id:
                volume, inside = divmod(int(shard), per_volume)
                first, last = slots * volume // volumes, slots * (volume + 1) // volumes
                mine = last - first
                even = np.diff(np.arange(per_volume + 1) * int(mine.sum()) // per_volume)
                count, before = shard_counts(mine, even, inside, seed * 1_000_003 + volume)
                source = np.repeat(np.arange(len(slots)), count)
                rank = np.repeat(first + before, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                turn = rank // blocks[source]
                key = mix64((source + 1).astype(np.uint64) * np.uint64(1 << 20) + turn.astype(np.uint64), seed)
                yield pd.DataFrame({"shard": shard, "source_no": source, "round": turn,
                                    "block": permuted(rank % blocks[source], blocks[source], key)})

    return numbers.mapInPandas(draw, "shard bigint, source_no int, round int, block bigint")


def pack(sized: DataFrame) -> DataFrame:
    """Rows of (doc_id, source_no, _size, _tie) with _first: words of its source before each document."""
    rows = sized.withColumn("_part", F.pmod(F.xxhash64("doc_id", "_tie"), F.lit(BUCKETS)))
    parts = rows.groupBy("source_no", "_part").agg(F.sum("_size").alias("_words"))
    before = W.partitionBy("source_no").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)       # at most BUCKETS rows
    parts = parts.select("source_no", "_part", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy("source_no", "_part").orderBy("doc_id", "_tie").rowsBetween(W.unboundedPreceding, -1)
    return (rows.withColumn("_in", F.coalesce(F.sum("_size").over(inner), F.lit(0))).join(parts, ["source_no", "_part"])
            .withColumn("_first", F.col("_base") + F.col("_in")).drop("_base", "_in", "_part"))


def pieces(packed: DataFrame, block_words: int) -> DataFrame:
    """A row for each document and block that share words: block, _from and _words within the document."""
    first, size = F.col("_first"), F.col("_size")
    block = F.explode(F.sequence(F.floor(first / block_words), F.floor((first + size - 1) / block_words)))
    rows = packed.filter(size > 0).withColumn("block", block)
    start = F.greatest(F.col("block") * block_words, first)
    stop = F.least((F.col("block") + 1) * block_words, first + size)
    return rows.withColumns({"_from": start - first, "_words": stop - start})


def _with_sources(spark, light: DataFrame, table: pd.DataFrame) -> DataFrame:
    if table.empty:
        return light.withColumns({c: F.lit(None).cast(t) for c, t in (("source_no", "int"), ("source_size", "bigint"), ("target", "double"))})
    known = spark.createDataFrame(list(table[["source", "source_no", "source_size", "target"]].itertuples(index=False, name=None)),
                                  "source string, source_no int, source_size bigint, target double")
    # as many rows as sources, which the plan above has on the driver
    return light.alias("l").join(F.broadcast(known.alias("k")), F.col("l.source").eqNullSafe(F.col("k.source"))).select("l.*", "source_no", "source_size", "target")


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_times: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """A row for each document: doc_id, _tie, size, source_size, target, taken, takes (array of (round, from, words), sorted)."""
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words_in(text).alias("_size"),
                        F.xxhash64(whole(text), source).alias("_tie"))
    light = stored(sized)
    table = plan(_source_sizes(light, "source"), weights, most_times, block_words)
    rows = stored(pack(_with_sources(spark, light, table)))
    # the planner takes the drawn slots for as few as the shards, and would broadcast them
    chosen = draw_slots(spark, table, seed).groupBy("source_no", "block").agg(F.collect_list("round").alias("rounds")).hint("merge")
    met = pieces(rows, block_words).join(chosen, ["source_no", "block"]).select(
        "source_no", "_first", "doc_id", "_tie", F.explode("rounds").alias("round"), "_from", "_words")
    # documents without words share their _first with the next one, and take nothing
    by = ["source_no", "_first", "_tie"]
    takes = met.groupBy(*by).agg(F.sum("_words").alias("taken"), F.array_sort(F.collect_list(F.struct(
        "round", F.col("_from").alias("from"), F.col("_words").alias("words")))).alias("takes"))
    full = rows.join(takes, by, "left")
    some = (F.col("_size") > 0) & F.col("taken").isNotNull()
    return full.select("doc_id", "source", "_tie", F.col("_size").alias("size"), "source_size", "target",
                       F.when(some, F.col("taken")).otherwise(F.lit(0)).alias("taken"), F.when(some, F.col("takes")).alias("takes"))


def _cut(text: str, takes) -> str:
    """The taken words, round by round, with the white space that follows them; a round with all words is the whole text."""
    import re
    ends = [m.end() for m in re.finditer(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)]
    begins = [0, *ends]
    out, last = [], None
    for t in takes:
        piece = text[begins[t["from"]]:begins[t["from"] + t["words"]]]
        joined = last == (t["round"], t["from"])
        out.append(piece if joined or not out else ("" if out[-1][-1:].isspace() else "\n") + piece)
        last = (t["round"], t["from"] + t["words"])
    return "".join(out)


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most_times: int = 3, block_words: int = BLOCK_WORDS, seed: int = 0,
                  doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents with the text that the mix takes, repeats included; documents of which it takes nothing go. Rows equal in
    id, text and source become one row with the words that all of them give."""
    taken = mix(docs, weights, most_times, block_words, seed, doc_id, text, source).filter("taken > 0")
    listed = taken.groupBy("_tie", F.xxhash64("doc_id").alias("_key")).agg(F.flatten(F.collect_list("takes")).alias("_takes"))
    keyed = rows_of(docs, _tie=F.xxhash64(whole(text), source), _key=F.xxhash64(doc_id))
    joined = keyed.join(listed, ["_tie", "_key"]).dropDuplicates(["_tie", "_key"])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([_cut(t, x) for t, x in zip(texts, lists)], dtype=object)

    takes, old = F.col("_takes"), field(text)
    once = F.forall(takes, lambda t: t["round"] == 0) & (
        F.aggregate(takes, F.lit(0).cast("bigint"), lambda a, t: a + t["words"]) == words_in(old))
    split = joined.withColumn("_once", once)
    new = lambda c: [(c if n == text else field(n)).alias(n) for n in docs.columns]          # noqa: E731
    return split.filter("_once").select(*new(old)).unionByName(split.filter("not _once").select(*new(cut(old, takes))))
