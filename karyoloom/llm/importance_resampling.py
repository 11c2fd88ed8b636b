"""Resampling towards a target distribution: weights from arrays of feature-bucket gains, noise from a hash of the key, and
ranks by parallel sorting with regular sampling.

Features are the runs of 1 to `most_words` consecutive words of a text, hashed into `buckets`. One pass counts the buckets
of the documents, one those of the target; both come back as arrays of fixed length. A bucket's gain is the scaled log ratio
of its two smoothed shares; a document's weight is the sum of gains over its features, and its score adds Gumbel noise
hashed from its key, so that the highest scores are a sample without replacement in proportion to the weights.

Ranks: each partition sorts its scores and writes them as a run; rows at regular positions of all runs give the splitters;
rows are exchanged by segment, each segment is sorted on its own, and the prefix counts of the segments make its positions
exact ranks. Segments are told by score, then key, then place in the runs, so that neither equal scores nor repeated rows
pile up. At most `MOST_SEGMENTS` samples of each run reach the driver, whatever its length.

Defined cases: a null or empty text has no features and weight 0; a null key is hashed as the empty string and comes last
among equal scores; repeated rows are documents of their own and tie by their place; an empty table gives an empty result;
an empty target is smoothed like any other; input columns named like those of the result are replaced; documents below
`min_words` are scored but never drawn.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import coded_words, field, free_memory, rows_of, segment_sums, slices, stored, whole

BUCKETS = 10_000
MOST_SEGMENTS = 128
ADDED = ("n_words", "n_features", "weight", "score", "rank")

_LETTERS = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def cut_to_words(texts: pa.Array) -> pa.Array:
    """A-Z in lower case and every other ASCII character but digits and letters as a space; no length changes."""
    mask, offsets, data = texts.buffers()
    if data is None:
        return texts
    return pa.Array.from_buffers(texts.type, len(texts), [mask, offsets, pa.py_buffer(data.to_pybytes().translate(_LETTERS))], -1, texts.offset)


def feature_buckets(texts: pa.Array, buckets: int, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every feature, offsets of the rows into them, words of the rows) of texts that `cut_to_words` has seen."""
    codes, words, offsets = coded_words(texts)
    n = np.diff(offsets)
    if most_words == 1:
        table = np.fromiter((zlib.crc32(w) % buckets for w in words.cast(pa.large_binary()).to_pylist()), np.int64, len(words))
        return table[codes] if len(codes) else codes, offsets, n
    names = np.array(words.cast(pa.large_binary()).to_pylist(), object)
    parts, rows = [], []
    row = np.repeat(np.arange(len(n)), n)
    for k in range(1, most_words + 1):
        start = np.arange(max(len(codes) - k + 1, 0))
        start = start[row[start] == row[start + k - 1]] if len(start) else start
        runs, which = np.unique(codes[start[:, None] + np.arange(k)], axis=0, return_inverse=True) if len(start) else (np.zeros((0, k), int), np.zeros(0, int))
        hashed = np.fromiter((zlib.crc32(b" ".join(names[r])) % buckets for r in runs), np.int64, len(runs))
        parts.append(hashed[which.ravel()])
        rows.append(row[start])
    rows, parts = np.concatenate(rows), np.concatenate(parts)
    order = np.argsort(rows, kind="stable")
    return parts[order], np.searchsorted(rows[order], np.arange(len(n) + 1)), n


def bucket_counts(texts: DataFrame, text: str = "text", buckets: int = BUCKETS, most_words: int = 1) -> np.ndarray:
    """Features of all texts in each bucket: tasks add up arrays, which are summed by bucket."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            words = cut_to_words(batch.column(0))
            for a, b in slices(words):
                total += np.bincount(feature_buckets(words.slice(a, b - a), buckets, most_words)[0], minlength=buckets)
        free_memory()
        have = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(total[have])], names=["bucket", "n"])

    parts = texts.select(whole(text).alias("text")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():          # a row a bucket
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log ratio) of the smoothed shares in the target and in the documents, bucket by bucket."""
    k = len(raw)
    up = (target + 1.0) * (float(raw.sum()) + k)
    down = (raw + 1.0) * (float(target.sum()) + k)
    return np.floor(1000.0 * np.log(up / down)).astype(np.int64)


def score_documents(docs: DataFrame, gains: np.ndarray, seed: int, doc_id: str = "doc_id", text: str = "text", most_words: int = 1,
                    keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with n_words, n_features, weight and score (longs)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = cut_to_words(batch.column(1)), []
            for a, b in slices(texts):
                hit, offsets, n = feature_buckets(texts.slice(a, b - a), buckets, most_words)
                found.append(np.stack([n, np.diff(offsets), segment_sums(gains[hit], offsets)]))
            n, features, weight = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in (n, features, weight)]],
                                             names=["_row", "n_words", "n_features", "weight"])
        free_memory()

    rows = rows_of(docs.select(*[F.col(f"`{c}`") for c in {doc_id: 0, **dict.fromkeys(keep)}], F.col(text).alias("_text_of")), text=whole("_text_of"))
    rows = rows.select(F.struct(*[field(c).alias(c) for c in {doc_id: 0, **dict.fromkeys(keep)}]).alias("_row"), "text")
    kind = rows.schema["_row"].dataType.simpleString()
    out = rows.mapInArrow(weigh, f"_row {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(field(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return out.select(field(doc_id).alias("_key"), *[field(c).alias(c) for c in keep], "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def _splitters(runs: DataFrame, n: int) -> list[tuple]:
    """Up to MOST_SEGMENTS - 1 keys (-score, key is null, key, place) that cut the runs into even segments."""
    n_runs = runs.agg(F.count_distinct(F.shiftright("_place", 33))).first()[0]
    segments = min(max(n_runs, 1), MOST_SEGMENTS)
    stride = max(1, n // (segments * max(n_runs, 1)))
    regular = runs.filter(F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) % stride == stride // 2)
    found = sorted((-r[0], r[1] is None, 0 if r[1] is None else r[1], r[2]) for r in regular.select("score", "_key", "_place").collect())
    return [found[len(found) * k // segments] for k in range(1, segments)] if found else []


def rank_highest(scored: DataFrame, drawn: int, n: int) -> DataFrame:
    """`rank` (1, 2, ... by score downwards, key upwards) on the `drawn` first rows of `scored` (n rows, with score and _key);
    null on the others."""
    order = [F.col("score").desc(), F.col("_key").asc_nulls_last()]
    runs = stored(scored.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    cuts = _splitters(runs, n)
    first = np.array([c[0] for c in cuts], np.int64)

    @F.pandas_udf("int")
    def segment(score: pd.Series, key: pd.Series, place: pd.Series) -> pd.Series:
        down = -score.to_numpy()
        at, last = np.searchsorted(first, down, "left"), np.searchsorted(first, down, "right")
        for k in np.flatnonzero(at < last):                      # as high as a splitter: the rest of the key decides
            null = pd.isna(key.iloc[k])
            at[k] = bisect.bisect_right(cuts, (int(down[k]), bool(null), 0 if null else key.iloc[k], int(place.iloc[k])), int(at[k]), int(last[k]))
        return pd.Series(at.astype(np.int32))

    cut = stored(runs.withColumn("_segment", segment("score", "_key", "_place")))
    sizes = dict(cut.groupBy("_segment").count().collect())                      # a row a segment
    before, total = [], 0
    for k in range(len(cuts) + 1):
        before.append((k, total))
        total += sizes.get(k, 0)
    needed = [b for b in before if b[1] < drawn]
    spark: SparkSession = scored.sparkSession
    offsets = spark.createDataFrame(needed or [(-1, 0)], "_segment int, _before long")
    inside = Window.partitionBy("_segment").orderBy(*order, "_place")
    ranked = (cut.join(F.broadcast(offsets), "_segment").withColumn("rank", F.col("_before") + F.row_number().over(inside))     # at most MOST_SEGMENTS rows
              .withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("bigint")).drop("_before"))
    rest = cut.join(F.broadcast(offsets), "_segment", "left_anti").withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).drop("_segment", "_place")


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (10, 100), min_words: int = 20, seed: int = 2024, buckets: int = BUCKETS,
             most_words: int = 1, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """All documents with n_words, n_features, weight, score and rank; ranked are floor(share of the documents with at least
    `min_words` words), the highest scores."""
    raw = bucket_counts(docs, text, buckets, most_words)
    gains = bucket_gains(raw, bucket_counts(target, target_text, buckets, most_words))
    scored = stored(score_documents(docs, gains, seed, doc_id, text, most_words, keep))
    able = F.col("n_words") >= min_words
    n = scored.filter(able).count()
    ranked = rank_highest(scored.filter(able), n * share[0] // share[1], n)
    others = scored.filter(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(others).drop("_key")
