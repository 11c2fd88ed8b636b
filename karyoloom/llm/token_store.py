"""Token ids as binary shards with a minimal perfect hash index.

A store is a folder with two Parquet tables. `payload` has a row for each chunk of a shard: the raw ids of consecutive
documents (little-endian, 2 bytes each where the vocabulary allows, else 4), and its directory (document ids, token
counts). Shards and chunks follow ascending document id. `index` has a row for each bucket of hashed keys: the bit
levels of a minimal perfect hash, a 32-bit fingerprint per slot, and the places (shard, chunk, position, documents) of
each slot, so that a key is found by a few probes whatever the size of the store.

Defined cases: a null text is empty; an empty text has only the end id; rows with equal or null ids are all kept, nulls
first, equal ids by the hash of their text (a lookup of an id, or of null, returns all its rows; in the index null stands as
the least long, which no document may have as its id); an empty table gives an empty store; columns other than the two named are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import gc
import json
import math
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..core import scratch
from .common import coded_words, free_memory, mix64, partitions, ragged, slices, whole, worker_cache

PAYLOAD = "shard int, chunk int, first_token bigint, ids binary, doc_ids array<bigint>, n_tokens array<int>"
INDEX = ("bucket bigint, n_keys int, levels array<binary>, fingerprints binary, first_place binary, shards binary, "
         "chunks binary, positions binary, counts binary")
CHUNK_BYTES = 1 << 20
KEYS_PER_BUCKET = 20_000
# letters below U+0250 but for U+0130: stable under NFC, with one lower case
LATIN = r"^[A-Za-z\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}]+$"
SLICE_BYTES = 1_000_000         # text encoded at a time: the memory of a worker follows it, its time does not
MEMO_WORDS = 400_000            # stems a worker remembers before it starts anew


# fixed values: the normaliser and the split of the tokenizers that can be read word by word
NORMALIZER = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LENGTH_BITS = 32


class Encoder:
    """Ids of texts by a tokenizer. One that lower-cases and splits as above never joins text over white space: the stems of its
    words are encoded once and looked up after. Any other encodes whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        told = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (told["normalizer"] or {}).get("normalizers", [])]
        splits = [(p["type"], (p.get("pattern") or {}).get("Regex")) for p in (told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.by_word = steps == NORMALIZER and splits == [("Split", SPLIT), ("ByteLevel", None)] and told["model"]["type"] == "BPE"
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        other = iter(range(256, 512))
        self.byte_chars = {b: chr(b) if b in plain else chr(next(other)) for b in range(256)}
        self._clear()

    def _clear(self) -> None:
        """Stems (letters in lower case, or words that are looked up whole) have a place in `flat`: start, and length in the low bits."""
        self.places: dict[str, int] = {"": 0}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def _append(self, lists: list[list[int]]) -> list[int]:
        """Places of lists of ids that join the table in one go."""
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        total = int(lengths.sum())
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used:self.used + total] = np.fromiter(chain.from_iterable(lists), np.uint32, total)
        starts = self.used + np.cumsum(lengths) - lengths
        self.used += total
        return (starts << LENGTH_BITS | lengths).tolist()

    def _learn(self, stems: list[str], letters: list[bool]) -> None:
        """Stems of letters are words of the model as they stand, others go through the whole tokenizer."""
        simple = [w for w, ok in zip(stems, letters) if ok]
        other = [w for w, ok in zip(stems, letters) if not ok]
        chars, tokenize = self.byte_chars, self.model.tokenize
        self.places.update(zip(simple, self._append([[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(chars))] for w in simple])))
        self.places.update(zip(other, self._append([e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)])))

    def _table(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after another, their number in each word). Words of letters with at most one point or comma behind
        are the ids of the letters in lower case and of the mark; other words are looked up whole."""
        core = pc.utf8_rtrim(words, ".,")
        marks = pc.subtract(pc.binary_length(words), pc.binary_length(core))
        simple = pc.and_(pc.match_substring_regex(core, LATIN), pc.less_equal(marks, 1))
        stems = pc.if_else(simple, pc.utf8_lower(core), words).dictionary_encode()
        at = stems.indices.to_numpy(zero_copy_only=False)
        is_simple = simple.to_numpy(zero_copy_only=False)
        letters = np.zeros(len(stems.dictionary), bool)
        letters[at[is_simple]] = True
        names = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.places) + len(names) > MEMO_WORDS:
            self._clear()
        known = self.places
        gc.disable()             # many small lists, none in a cycle: looking for cycles would take a third of the time
        try:
            new = [k for k, w in enumerate(names) if w not in known]
            self._learn([".", ",", *[names[k] for k in new]], [False, False, *letters[new].tolist()])
        finally:
            gc.enable()
        stem = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[at]
        marked = is_simple & (marks.to_numpy(zero_copy_only=False) == 1)
        mark = np.where(marked, np.where(pc.ends_with(words, ".").to_numpy(zero_copy_only=False), known["."], known[","]), 0)
        both = np.stack([stem, mark], axis=1).ravel()
        lengths = both & ((1 << LENGTH_BITS) - 1)
        return self.flat[ragged(both >> LENGTH_BITS, lengths)], lengths.reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of the texts)."""
        if not self.by_word:
            whole_texts = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
            offsets = np.concatenate([[0], np.cumsum([len(e.ids) for e in whole_texts], dtype=np.int64)]).astype(np.int64)
            return np.fromiter(chain.from_iterable(e.ids for e in whole_texts), np.uint32, int(offsets[-1])), offsets
        codes, words, offsets = coded_words(texts)
        ids, counts = self._table(words)
        lengths = counts[codes]
        return ids[ragged((np.cumsum(counts) - counts)[codes], lengths)], np.concatenate([[0], np.cumsum(lengths)])[offsets]


def _encoder(path: str) -> Encoder:
    return worker_cache(f"encoder:{path}", lambda: Encoder(path))


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    out = np.full(len(ids) + len(offsets) - 1, end_id, ids.dtype)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out[np.arange(len(ids)) + owner] = ids
    return out, offsets + np.arange(len(offsets))


@dataclass(frozen=True)
class Store:
    """A written store: `path` of its folder, bytes of an id, and number of index buckets."""
    spark: SparkSession
    path: str
    dtype: str
    buckets: int

    def payload(self) -> DataFrame:
        return self.spark.read.schema(PAYLOAD).parquet(f"{self.path}/payload")

    def index(self) -> DataFrame:
        return self.spark.read.schema(INDEX).parquet(f"{self.path}/index")

    def places(self, keys: DataFrame, key: str) -> DataFrame:
        """(key, shard, chunk, position, documents) of each distinct key of `keys` that the store has."""
        wanted = keys.select(_told(F.col(key)).alias("key")).distinct()
        wanted = wanted.withColumn("bucket", _bucket(F.col("key"), self.buckets))
        return wanted.groupBy("bucket").cogroup(self.index().groupBy("bucket")).applyInPandas(
            _look_up, "key bigint, shard int, chunk int, position int, documents int")

    def fetch(self, keys: DataFrame, key: str) -> DataFrame:
        """A row for each stored document of the keys: doc_id, shard, shard_start (ids of the shard before it), n_tokens,
        ids (little-endian unsigned 32-bit)."""
        dtype = self.dtype

        def read(places: pd.DataFrame, chunks: pd.DataFrame) -> pd.DataFrame:
            cols = ["doc_id", "shard", "shard_start", "n_tokens", "ids"]
            if places.empty or chunks.empty:
                return pd.DataFrame({c: [] for c in cols})
            chunk = chunks.iloc[0]
            n = np.asarray(chunk.n_tokens, np.int64)
            start = np.concatenate([[0], np.cumsum(n)])
            ids = np.frombuffer(chunk.ids, dtype).astype("<u4")
            docs = np.concatenate([np.arange(p, p + d) for p, d in zip(places.position, places.documents)])
            owner = np.repeat(places.key.to_numpy(), places.documents)
            return pd.DataFrame({"doc_id": owner, "shard": chunk.shard, "shard_start": chunk.first_token + start[docs],
                                 "n_tokens": n[docs], "ids": [ids[start[k]:start[k + 1]].tobytes() for k in docs]})[cols]

        by = ["shard", "chunk"]
        return self.places(keys, key).groupBy(*by).cogroup(self.payload().groupBy(*by)).applyInPandas(
            read, "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, ids binary").withColumn("doc_id", F.when(F.col("doc_id") != NO_KEY, F.col("doc_id")))

    def shard_starts(self) -> DataFrame:
        """(shard, base): ids of all shards before; one row per shard is ordered, not per document."""
        totals = self.payload().groupBy("shard").agg(
            F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("total"))
        before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
        return totals.select("shard", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


NO_KEY = -(1 << 63)              # stands for null in the index


def _told(key: Column) -> Column:
    return F.coalesce(key.cast("bigint"), F.lit(NO_KEY))


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def _levels(keys: np.ndarray) -> list[np.ndarray]:
    """Bit arrays of a minimal perfect hash: a key that is alone at its place of a level sets the bit there, the others go
    on to the next level. The slot of a key is the number of set bits before its own."""
    levels, left = [], keys
    while len(left):
        place = (mix64(left, len(levels)) % np.uint64(2 * len(left) + 1)).astype(np.int64)
        alone = np.bincount(place, minlength=2 * len(left) + 1) == 1
        levels.append(alone)
        left = left[~alone[place]]
    return levels


def _slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit."""
    slot, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, bits in enumerate(levels):
        place = (mix64(keys[open_], k) % np.uint64(len(bits))).astype(np.int64)
        rank = np.cumsum(bits) - 1
        hit = bits[place]
        slot[open_[hit]] = base + rank[place[hit]]
        base += int(bits.sum())
        open_ = open_[~hit]
    return slot


def _fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys, 1_000) >> np.uint64(32)).astype("<u4")


def _build(group: pd.DataFrame) -> pd.DataFrame:
    keys = np.unique(group.key.to_numpy().astype(np.int64))
    levels = _levels(keys)
    slot_of = _slots(levels, keys)
    prints = np.zeros(len(keys), "<u4")
    prints[slot_of] = _fingerprints(keys)
    slot = _slots(levels, group.key.to_numpy().astype(np.int64))
    order = np.lexsort((group.position, group.chunk, group.shard, slot))
    g = group.iloc[order]
    first = np.searchsorted(slot[order], np.arange(len(keys) + 1)).astype("<i8")
    raw = lambda c: g[c].to_numpy().astype("<i4").tobytes()       # noqa: E731
    return pd.DataFrame([{
        "bucket": group.bucket.iloc[0], "n_keys": len(keys),
        "levels": [len(b).to_bytes(8, "little") + np.packbits(b).tobytes() for b in levels],
        "fingerprints": prints.tobytes(), "first_place": first.tobytes(), "shards": raw("shard"), "chunks": raw("chunk"),
        "positions": raw("position"), "counts": raw("documents")}])


def _look_up(wanted: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    cols = ["key", "shard", "chunk", "position", "documents"]
    if wanted.empty or index.empty:
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in cols})
    entry, keys = index.iloc[0], wanted.key.to_numpy().astype(np.int64)
    levels = [np.unpackbits(np.frombuffer(b[8:], np.uint8), count=int.from_bytes(b[:8], "little")).astype(bool) for b in entry.levels]
    slot = _slots(levels, keys)
    known = slot >= 0
    known[known] = np.frombuffer(entry.fingerprints, "<u4")[slot[known]] == _fingerprints(keys[known])
    first = np.frombuffer(entry.first_place, "<i8")
    n = first[slot[known] + 1] - first[slot[known]]
    at = ragged(first[slot[known]], n)
    pick = lambda c: np.frombuffer(entry[c], "<i4")[at]           # noqa: E731
    return pd.DataFrame({"key": np.repeat(keys[known], n), "shard": pick("shards"), "chunk": pick("chunks"),
                         "position": pick("positions"), "documents": pick("counts")})[cols]


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None, key: str = "doc_id",
                text: str = "text", shards: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> Store:
    """Encode every text, append `end_id`, and write the shards and their index to `path` (a new folder below the shared
    checkpoint folder by default). Shards are ranges of (key, hash of the text): a repeated key is split like any other."""
    spark = docs.sparkSession
    path = path or scratch(spark, "tokens")
    shards = shards or partitions(spark)
    from tokenizers import Tokenizer
    dtype = id_type(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1))
    rows = docs.select(F.col(key).cast("bigint").alias("doc_id"), whole(text).alias("text"))
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    placed = rows.repartitionByRange(shards, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first_token", pa.int64()), ("ids", pa.binary()),
                        ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32()))])

    def encode(batches):
        from pyspark import TaskContext
        shard, encoder = TaskContext.get().partitionId(), _encoder(tokenizer_path)
        chunk = first = size = 0
        parts, names, counts = [], [], []

        def closed():
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "chunk": chunk, "first_token": first, "ids": b"".join(parts),
                "doc_ids": [x for n in names for x in n], "n_tokens": np.concatenate(counts).tolist()}], schema)

        for batch in batches:
            for a, b in slices(batch.column(1), SLICE_BYTES):
                ids, offsets = _with_end(*encoder.encode(batch.column(1).slice(a, b - a)), end_id)
                ids = ids.astype(dtype)
                start = 0
                while start < b - a:
                    room = (chunk_bytes - size) // ids.itemsize
                    stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + max(room, 1), "right")) - 1)
                    parts.append(ids[offsets[start]:offsets[stop]].tobytes())
                    names.append(batch.column(0).slice(a + start, stop - start).to_pylist())
                    counts.append(np.diff(offsets[start:stop + 1]))
                    size += len(parts[-1])
                    start = stop
                    if size >= chunk_bytes or start < b - a:
                        yield closed()
                        chunk, first, size = chunk + 1, first + int(sum(c.sum() for c in counts)), 0
                        parts, names, counts = [], [], []
        if parts:
            yield closed()
        free_memory(cache=False)

    placed.mapInArrow(encode, PAYLOAD).write.option("compression", "zstd").parquet(f"{path}/payload")
    made = spark.read.schema(PAYLOAD).parquet(f"{path}/payload")
    count = made.select(F.sum(F.size("doc_ids"))).first()[0] or 0
    buckets = max(1, math.ceil(count / KEYS_PER_BUCKET))
    entries = (made.select("shard", "chunk", F.posexplode("doc_ids").alias("position", "key")).withColumn("key", _told(F.col("key")))
               .groupBy("key", "shard", "chunk").agg(F.min("position").alias("position"), F.count(F.lit(1)).cast("int").alias("documents"))
               .withColumn("bucket", _bucket(F.col("key"), buckets)))
    entries.groupBy("bucket").applyInPandas(_build, INDEX).write.option("compression", "zstd").parquet(f"{path}/index")
    return Store(spark, path, dtype, buckets)


def read_documents(store: Store, keys: DataFrame, key: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (binary) of the documents of `keys`."""
    return store.fetch(keys, key).join(store.shard_starts(), "shard").select(
        "doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")
