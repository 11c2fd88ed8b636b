"""Placement of documents by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: (offset + k * skip) mod size, with offset and
skip hashed from its name. Shards take turns, each claiming the first slot of its order that is still free, until the
table is full. Shares differ by at most one turn, and a change of the shard list moves few slots. The table has a fixed size
(a parameter), so it is broadcast; a document finds its shard by one look at slot hash(key) mod size.

Defined cases: a null key is placed as the empty string; equal keys share a shard; an empty table gives an empty result;
`slot` and `shard` of the input are replaced, other columns stay; texts are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n ** 0.5) + 1))


def _hash(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "big")


def fill_table(shards: list[str], size: int = TABLE_SIZE) -> np.ndarray:
    """Index of the shard of each slot."""
    if not _is_prime(size):
        raise ValueError("the size of the table must be prime")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shard names must be distinct, at least one and no more than slots")
    at = [_hash(s, "offset") % size for s in shards]
    skip = [_hash(s, "skip") % (size - 1) + 1 for s in shards]
    table, filled = np.full(size, -1, np.int32), 0
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            filled += 1
            if filled == size:
                return table


def table_frame(spark: SparkSession, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    rows = [(i, int(k), shards[k]) for i, k in enumerate(fill_table(shards, size))]
    return spark.createDataFrame(rows, "slot int, shard_no int, shard string")


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", size: int = TABLE_SIZE) -> DataFrame:
    """`docs` with slot (int) and shard (string). The slot is the first 60 bits of the md5 of the key's text, modulo `size`."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    slot = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")
    table = table_frame(docs.sparkSession, shards, size).select("slot", "shard")
    # the table has `size` rows whatever the input
    return docs.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot", "left").select(
        *[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")
