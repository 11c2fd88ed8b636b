"""Parts shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..core import scratch

def stored(df: DataFrame) -> DataFrame:
    """Write `df` once below the shared checkpoint folder and read it back: later readers prune its columns, nothing is
    computed twice, and a lost executor costs no more than a read."""
    path = scratch(df.sparkSession, "llm")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rows_of(docs: DataFrame, **columns: Column) -> DataFrame:
    """`docs` as one struct column _row, with the given columns beside it: no name of the input can clash with one of ours."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(row.alias("_row"), *[c.alias(k) for k, c in columns.items()])


def field(name: str, row: Column | str = "_row") -> Column:
    return (F.col(row) if isinstance(row, str) else row).getField(name)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the number the user sizes with the input."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(text: Column | str) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")


def crc_part(doc_id: str, of: int) -> Column:
    """crc32 of the decimal digits of an id, modulo `of`; null ids fall in part 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of)), F.lit(0))


def worker_cache(name: str, make: Callable):
    """One object per Python worker process, kept over the tasks that the worker runs."""
    box = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if not hasattr(box, name):
        setattr(box, name, make())
    return getattr(box, name)


def free_memory(cache: bool = True) -> None:
    """At the end of a task: give freed memory back to the system, and forget cached objects unless the next task of this
    operator needs them. A worker process goes on to other operators, whose memory would come on top."""
    if cache:
        sys.modules.pop("_llm_worker_cache", None)
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(texts: pa.Array, most_bytes: int = 8_000_000):
    """(start, stop) row ranges of at most `most_bytes` text each, or a single longer row: bounds memory, drops nothing."""
    if len(texts) == 0:
        return
    size = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(size, size[a] + most_bytes, "right")) - 1)
        yield a, min(b, len(texts))
        a = b


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words between ASCII white space: (code of each word, distinct words, offsets of the rows into the codes). Null rows
    and empty words have no code."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary
    empty = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if empty.any():
        keep = ~empty[codes]
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        new = np.cumsum(~empty) - 1
        codes, words = new[codes[keep]], words.filter(pa.array(~empty))
    return codes, words, offsets - offsets[0]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every (start, length), one after another."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


def segment_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[k]:offsets[k+1]] along axis 0; empty segments give zero."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = offsets[1:] > offsets[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Mixing of 64-bit integers (the splitmix finaliser)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
