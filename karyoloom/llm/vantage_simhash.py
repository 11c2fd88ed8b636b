"""Near duplicates by SimHash fingerprints, searched with vantage-point trees.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of the text's word shingles. Two fingerprints
within `max_bits` differing bits agree in parts: cut into as many blocks as `max_bits`, one block differs by one bit at most
or another does not differ at all. So there is a tree for each block, with Hamming distance over that block as its metric and
radius 1 for the first block, 0 for the others. A tree cuts space at vantage points: near (distance up to the median) or far.
Every fingerprint has one home leaf and visits the leaves that the triangle inequality can not rule out for its radius.
Leaves are the shards: whatever meets there is compared exactly over all 64 bits. Vantage points come from a bounded sample
(`sample` fingerprints); all fingerprints are placed, and no pair within the limit is lost, whatever the sample.

A leaf with more rows than a task should hold is cut into chunks, compared pair by pair of chunks. Equal fingerprints are
one class before the search. A leaf returns a spanning forest of its links, so a group of n near copies gives n - 1 edges.

Defined cases: a null text is empty; a text without words has fingerprint zero, linked like any other; fewer words than a
shingle: the whole sequence; rows with equal ids are rows of one class or not, by their text; a null id has a fingerprint and
the class of its text, and counts as no smallest id (a class of null ids only has a null id); an empty table gives an empty
result; other columns are kept by `keep_one` and ignored by the others. Texts of any length are read whole.

`similar_documents` and `keep_similar` link by the Jaccard similarity of the sets of shingles instead, 0.8 with five words.
Their fingerprints are wider (512 bits over distinct shingles), as a bit of two texts differs with probability acos(cosine)/pi,
15 % at a similarity of 0.8. Each tree has its own drawn bits, log2(texts / rows of a leaf) of them, and as many trees grow as
bring two texts of that similarity into one leaf with probability `recall`, at every size of the corpus. In a leaf, pairs far
closer than the limit (four standard deviations of the distance) are links; all others up to six deviations beyond it are links
if the shingles of their whole texts say so: first those of a minimum spanning forest, then every pair that is still in two
groups. A leaf returns a row for each document in such pairs, not one for each pair; the pairs left between two groups are
compared in the task of their leaf, which is sent the shingles of the documents in them, SET_BYTES at a time. Equal sets of
shingles are one class before the search; texts without words have equal (empty) sets; the other defined cases are those above.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions.groups import components
from .common import free_memory, mix64, ragged, rows_of, segment_sums, slices, stored, whole

SHINGLE_WORDS, MAX_BITS = 4, 4
SAMPLE, LEAF_ROWS = 8_192, 2_048
HOME_ROWS, VISIT_ROWS = 8_192, 32_768
PIECE = 400_000                     # shingles whose bits are unpacked at a time
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
SIMILAR_WORDS, SIMILARITY, RECALL = 5, 0.8, 0.995
WIDE = 8                            # 64-bit words of a wide fingerprint
DEVIATIONS, BEYOND = 4.0, 6.0       # of the distance: a link without a look at the texts, no link without one
PART = 5                            # words of a wide fingerprint that rule out most pairs
SURE, FOREST, REST = 0, 1, 2        # kinds of candidate links
SET_BYTES = 16_000_000              # shingles that one part of a leaf holds; two parts meet in a task


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64, seed 42, of every shingle; offsets of the texts)."""
    import xxhash
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = lists.values
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate([[0], np.cumsum(full)])[lists.offsets.to_numpy()]
    spaced = pc.binary_join_element_wise(flat.filter(pa.array(full)), "", " ")
    spaced = spaced.combine_chunks() if isinstance(spaced, pa.ChunkedArray) else spaced
    begin = np.frombuffer(spaced.buffers()[1], np.int32, len(spaced) + 1, spaced.offset * 4) if len(spaced) else np.zeros(1, np.int32)
    data = spaced.buffers()[2].to_pybytes() if len(spaced) else b""
    n = np.diff(offsets)
    count = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(offsets[:-1] - out[:-1], count) + np.arange(out[-1])
    last = first + np.repeat(np.minimum(n, words), count)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(data[a:b], 42) for a, b in zip(begin[first].tolist(), (begin[last] - 1).tolist())), np.uint64, int(out[-1]))
    return hashes, out


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Fingerprint of each text as an unsigned 64-bit integer."""
    n = len(offsets) - 1
    counts = np.zeros((n, 64), np.int64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for a in range(0, len(hashes), PIECE):
        part, own = hashes[a:a + PIECE], owner[a:a + PIECE]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        counts[own[starts]] += np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    over = 2 * counts > np.diff(offsets)[:, None]
    return np.packbits(over, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, tie, fp): a row for each document; fp is the fingerprint as a signed long, tie a hash of the text."""
    def of(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), 3_000_000):
                part = batch.slice(a, b - a)
                fp = majority(*shingle_hashes(part.column(2), words)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(fp)], ["id", "tie", "fp"])
        free_memory()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(doc_id, whole(text)).alias("tie"), whole(text).alias("text"))
    return rows.mapInArrow(of, "id bigint, tie bigint, fp bigint")


def block_masks(blocks: int) -> list[int]:
    cut = [64 * k // blocks for k in range(blocks + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(cut, cut[1:])]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def grow(sample: np.ndarray, mask: int, total: int, leaf_rows: int, seed: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, limit, near child, far child) of a tree over `sample`; a child below zero is leaf -1 - child. A node
    is cut until its share of `total` rows fits a leaf or all its values agree within the block."""
    rng, nodes, leaves = np.random.default_rng(seed), [], 0
    share = total / max(len(sample), 1)

    def build(rows: np.ndarray) -> int:
        nonlocal leaves
        values = np.unique(rows)
        if len(rows) * share > leaf_rows and len(values) > 1:
            best = None
            for v in rng.choice(values, min(8, len(values)), replace=False):
                d = _bits(rows ^ v)
                limit = int(np.median(d)) if d.max() > np.median(d) else int(d.max()) - 1
                near = int((d <= limit).sum())
                edge = int(((d == limit) | (d == limit + 1)).sum())
                if 0 < near < len(rows):
                    cost = abs(2 * near - len(rows)) + edge
                    best = (cost, int(v), limit) if best is None or cost < best[0] else best
            if best is not None:
                at = len(nodes)
                nodes.append(None)
                d = _bits(rows ^ np.uint64(best[1]))
                nodes[at] = (best[1], best[2], build(rows[d <= best[2]]), build(rows[d > best[2]]))
                return at
        leaves += 1
        return -leaves

    build(np.asarray(sample, np.uint64) & np.uint64(mask))
    return nodes


def visit(values: np.ndarray, nodes: list, radius: int):
    """(leaf, indices of the values that visit it, which of them have it as their home)."""
    todo = [(0 if nodes else -1, np.arange(len(values)), np.ones(len(values), bool))]
    while todo:
        at, rows, home = todo.pop()
        if not len(rows):
            continue
        if at < 0:
            yield -1 - at, rows, home
            continue
        vantage, limit, near, far = nodes[at]
        d = _bits(values[rows] ^ np.uint64(vantage)).astype(np.int64)
        inside, near_rows, far_rows = d <= limit, d <= limit + radius, d > limit - radius
        todo.append((near, rows[near_rows], (home & inside)[near_rows]))
        todo.append((far, rows[far_rows], (home & ~inside)[far_rows]))


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Smallest label over the links (u, v), followed to the end."""
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            return label
        label = new


def spanning(homes: np.ndarray, visitors: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, root) that join what the links between homes and visitors join."""
    values = np.unique(np.concatenate([homes, visitors]))
    at_home, at_visit = np.searchsorted(values, homes), np.searchsorted(values, visitors)
    label = np.arange(len(values))
    step = max(1, 4_000_000 // max(len(visitors), 1))
    for a in range(0, len(homes), step):
        near = _bits(homes[a:a + step, None] ^ visitors[None, :]) <= max_bits
        i, j = np.nonzero(near)
        u, v = at_home[a + i], at_visit[j]
        open_ = label[u] != label[v]
        if open_.any():
            label = _joined(label, u[open_], v[open_])
    moved = label != np.arange(len(values))
    return values[moved], values[label[moved]]


def links(classes: DataFrame, max_bits: int = MAX_BITS, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS, home_rows: int = HOME_ROWS,
          visit_rows: int = VISIT_ROWS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all that links within `max_bits` join."""
    blocks = max(1, max_bits)
    masks, radii = block_masks(blocks), [1 if max_bits else 0] + [0] * (blocks - 1)
    total = classes.count()
    picked = [r.fp for r in classes.orderBy(F.xxhash64("fp")).limit(sample).collect()]       # at most `sample` longs
    picked = np.array(picked, np.int64).view(np.uint64)
    trees = [grow(picked, m, total, leaf_rows, k) for k, m in enumerate(masks)]

    def route(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for tree, (mask, radius, nodes) in enumerate(zip(masks, radii, trees)):
                for leaf, rows, home in visit(fp & np.uint64(mask), nodes, radius):
                    value = np.concatenate([fp[rows], fp[rows[home]]]).view(np.int64)
                    is_home = np.repeat([False, True], [len(rows), int(home.sum())])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(value), tree, np.int32)), pa.array(np.full(len(value), leaf, np.int32)), pa.array(value), pa.array(is_home)],
                        ["tree", "leaf", "fp", "home"])

    routed = stored(classes.select("fp").mapInArrow(route, "tree int, leaf int, fp bigint, home boolean"))
    by = ["tree", "leaf"]
    sizes = routed.groupBy(*by).agg(F.ceil(F.sum(F.col("home").cast("int")) / home_rows).cast("int").alias("_h"),
                                    F.ceil(F.sum((~F.col("home")).cast("int")) / visit_rows).cast("int").alias("_v"))
    own = F.when(F.col("home"), F.pmod(F.xxhash64("fp"), "_h")).otherwise(F.pmod(F.xxhash64("fp"), "_v")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("_v")).otherwise(F.col("_h")) - 1))
    dealt = (routed.join(sizes.filter("_h > 0 and _v > 0"), by).withColumn("_own", own).withColumn("_other", other)
             .select(*by, "fp", "home", F.when(F.col("home"), F.col("_own")).otherwise(F.col("_other")).alias("_a"),
                     F.when(F.col("home"), F.col("_other")).otherwise(F.col("_own")).alias("_b")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        value, home = group.fp.to_numpy().view(np.uint64), group.home.to_numpy().astype(bool)
        a, b = spanning(value[home], value[~home], max_bits)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy(*by, "_a", "_b").applyInPandas(compare, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    **limits: int) -> DataFrame:
    """(id, tie, fp, root, component_id) per document: root is a fingerprint of its group, component_id the smallest id."""
    made = stored(fingerprints(docs, doc_id, text, words))
    edges = stored(links(made.select("fp").distinct(), max_bits, **limits))
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    found = components(ends, edges, []).select(F.col("node").alias("fp"), F.col("component").alias("_c"))
    rows = made.join(found, "fp", "left").withColumn("root", F.coalesce("_c", "fp")).drop("_c")
    least = rows.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.join(least, "root").select("id", "tie", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The documents without all but one of each group: the one with the smallest id (null last), ties by text."""
    groups = near_duplicates(docs, doc_id, text, **options)
    best = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("m"))
    chosen = best.select(F.col("m.tie").alias("_tie")).distinct()
    keyed = rows_of(docs, _tie=F.xxhash64(doc_id, whole(text)))
    return keyed.join(chosen, "_tie", "left_semi").dropDuplicates(["_tie"]).select("_row.*")


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of every text; offsets of the texts)."""
    hashes, offsets = shingle_hashes(texts, words)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(offsets) - 1))]).astype(np.int64)


def wide_fingerprints(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(id, tie, key, fp): key is a hash of the set of shingles, fp the bytes of its wide fingerprint."""
    def of(batches):
        import xxhash
        for batch in batches:
            for a, b in slices(batch.column(2), 2_000_000):
                part = batch.slice(a, b - a)
                hashes, offsets = shingle_sets(part.column(2), words)
                data = hashes.tobytes()
                key = np.array([xxhash.xxh64_intdigest(data[8 * x:8 * y], 1) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
                fp = np.stack([majority(mix64(hashes, k), offsets) for k in range(WIDE)], axis=1).astype("<u8")
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(key.view(np.int64)),
                                                  pa.array([row.tobytes() for row in fp], pa.binary())], ["id", "tie", "key", "fp"])
        free_memory()

    rows = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(doc_id, whole(text)).alias("tie"), whole(text).alias("text"))
    return rows.mapInArrow(of, "id bigint, tie bigint, key bigint, fp binary")


def differing(similarity: float) -> float:
    """Largest expected share of differing bits of two sets with this Jaccard similarity (sets of equal size have it)."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def bounds(bits: int, share: float) -> tuple[int, int]:
    """Distances over `bits` bits up to which a pair surely is similar, and beyond which it surely is not."""
    spread = math.sqrt(bits * share * (1 - share))
    return math.floor(bits * share - DEVIATIONS * spread), math.ceil(bits * share + BEYOND * spread)


def forest(u: np.ndarray, v: np.ndarray, far: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Indices of the pairs (u, v) of a minimum spanning forest over the classes of `label`, nearest pairs first."""
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((v, u, far))] = np.arange(len(u))
    at = np.argsort(rank)
    chosen = []
    while True:
        open_ = np.flatnonzero(label[u] != label[v])
        if not len(open_):
            return at[np.concatenate(chosen)] if chosen else np.empty(0, np.int64)
        best = np.full(len(label), len(u), np.int64)
        np.minimum.at(best, label[u[open_]], rank[open_])
        np.minimum.at(best, label[v[open_]], rank[open_])
        pick = np.unique(best[best < len(u)])
        chosen.append(pick)
        label = _joined(label, u[at[pick]], v[at[pick]])


def near_pairs(fp: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(label of every row after all sure links, then all unsure pairs of two labels: u, v, whether a spanning forest has them)."""
    n = len(fp)
    sure, most = bounds(64 * WIDE, share)
    label, found = np.arange(n), [(np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int16))]
    step = max(1, 1_000_000 // max(n, 1))
    for a in range(0, n, step):
        # no distance is smaller than over some of the words; a sum that runs over a byte only lets a pair pass
        part = _bits(fp[a:a + step, None, 0] ^ fp[None, a:, 0])
        for k in range(1, PART):
            part += _bits(fp[a:a + step, None, k] ^ fp[None, a:, k])
        i, j = np.nonzero(part <= most)
        i, j = i[i < j] + a, j[i < j] + a
        d = _bits(fp[i] ^ fp[j]).sum(axis=1, dtype=np.int16)
        close = d <= sure
        if (label[i[close]] != label[j[close]]).any():
            label = _joined(label, i[close], j[close])
            found = [tuple(x[label[u] != label[v]] for x in (u, v, far)) for u, v, far in found]
        unsure = ~close & (d <= most) & (label[i] != label[j])
        found.append((i[unsure].astype(np.int32), j[unsure].astype(np.int32), d[unsure]))
    u, v, far = (np.concatenate(x) for x in zip(*found))
    first = np.zeros(len(u), bool)
    first[forest(u, v, far, label)] = True
    return label, u, v, first


def crossing(fp: np.ndarray, group: np.ndarray, share: float) -> np.ndarray:
    """Indices of the rows that have an unsure pair with a row of another group."""
    n, most = len(fp), bounds(64 * WIDE, share)[1]
    out = np.zeros(n, bool)
    step = max(1, 1_000_000 // max(n, 1))
    for a in range(0, n, step):
        near = (group[a:a + step, None] != group[None, a:]) & (_bits(fp[a:a + step, None, 0] ^ fp[None, a:, 0]) <= most)
        i, j = np.nonzero(near)
        i, j = i[i < j] + a, j[i < j] + a
        for k in range(0, len(i), PIECE):
            x, y = i[k:k + PIECE], j[k:k + PIECE]
            hit = _bits(fp[x] ^ fp[y]).sum(axis=1, dtype=np.int16) <= most
            out[x[hit]] = out[y[hit]] = True
    return np.flatnonzero(out)


def similar_pairs(fp: np.ndarray, group: np.ndarray, hashes: np.ndarray, offsets: np.ndarray, share: float, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that join the groups which some unsure pair joins whose sets of shingles have this Jaccard similarity."""
    most, size = bounds(64 * WIDE, share)[1], np.diff(offsets)
    label = np.unique(group, return_inverse=True)[1]
    names, codes = np.unique(hashes, return_inverse=True)
    mine = np.zeros(len(names), bool)
    found = []
    for k in range(len(fp)):
        rest = k + 1 + np.flatnonzero((label[k + 1:] != label[k]) & (np.minimum(size[k + 1:], size[k]) >= similarity * np.maximum(size[k + 1:], size[k])))
        rest = rest[_bits(fp[rest] ^ fp[k]).sum(axis=1, dtype=np.int16) <= most]
        if not len(rest):
            continue
        own = codes[offsets[k]:offsets[k + 1]]
        mine[own] = True
        both = segment_sums(mine[codes[ragged(offsets[rest], size[rest])]].astype(np.int64), np.concatenate([[0], np.cumsum(size[rest])]))
        mine[own] = False
        rest = rest[both >= similarity * (size[rest] + size[k] - both)]
        joined, first = np.unique(label[rest], return_index=True)
        found.extend((k, int(x)) for x in rest[first])
        label[np.isin(label, joined)] = label[k]
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return u, v


def paired(rows: DataFrame, by: list[str], parts: DataFrame) -> DataFrame:
    """`rows` dealt by key to the parts of their group, `_n` in `parts`, and sent to every pair (_a, _b) of parts with their own."""
    own, other = F.pmod(F.xxhash64("key"), "_n").cast("int"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return (rows.join(parts, by).withColumn("_own", own).withColumn("_other", other)
            .select(*rows.columns, F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b")))


def wide(column) -> np.ndarray:
    """The bytes of wide fingerprints, a row each."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 * WIDE)


def candidate_links(classes: DataFrame, similarity: float, recall: float, sample: int, leaf_rows: int) -> DataFrame:
    """Edges (a, b, kind, at) between keys of the classes (key, fp), at names the part of a leaf that saw them. The unsure pairs
    beyond the forest (REST) can be many times the rows: every row in them comes with one of its pairs."""
    share, total = differing(similarity), classes.count()
    depth = max(0, math.ceil(math.log2(max(total, 1) / leaf_rows)))
    together = (1 - share) ** depth
    count = 1 if together == 1 else math.ceil(math.log(1 - recall) / math.log1p(-together))
    rng = np.random.default_rng(0)
    places = [rng.choice(64 * WIDE, depth, replace=False) for _ in range(count)]
    picked = classes.orderBy(F.xxhash64("key")).select("fp").limit(sample).toArrow().column(0)       # at most `sample` fingerprints

    def block(fp: np.ndarray, at: np.ndarray) -> np.ndarray:
        bits = (fp[:, at // 8] >> (at % 8).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(len(at), dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    heads = wide(picked)
    trees = [grow(block(heads, at), (1 << depth) - 1, total, leaf_rows, k) for k, at in enumerate(places)]

    def route(batches):
        for batch in batches:
            fp = wide(batch.column(1))
            for tree, (at, nodes) in enumerate(zip(places, trees)):
                leaf_of = np.empty(len(fp), np.int32)
                for leaf, rows, _ in visit(block(fp, at), nodes, 0):
                    leaf_of[rows] = leaf
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), tree, np.int32)), pa.array(leaf_of), batch.column(0), batch.column(1)],
                                                 ["tree", "leaf", "key", "fp"])

    by = ["tree", "leaf"]
    routed = stored(classes.select("key", "fp").mapInArrow(route, "tree int, leaf int, key bigint, fp binary"))
    sizes = routed.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / (2 * leaf_rows)).cast("int").alias("_n"))
    dealt = paired(routed, by, sizes)

    def compare(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        key, fp = key[order], wide(table.column("fp"))[order].view("<u8")
        label, u, v, first = near_pairs(fp, share)
        moved = np.flatnonzero(label != np.arange(len(label)))
        rest = np.flatnonzero(~first)
        rest = rest[np.union1d(*(np.unique(x[rest], return_index=True)[1] for x in (u, v)))]
        some = np.concatenate([np.flatnonzero(first), rest])
        kind = np.repeat(np.array([SURE, FOREST, REST], np.int32), [len(moved), len(some) - len(rest), len(rest)])
        at = "-".join(str(table.column(c)[0]) for c in (*by, "_a", "_b"))
        return pa.table({"a": np.concatenate([key[label[moved]], key[u[some]]]), "b": np.concatenate([key[moved], key[v[some]]]),
                         "kind": kind, "at": pa.array([at] * len(kind), pa.string())})

    return dealt.groupBy(*by, "_a", "_b").applyInArrow(compare, "a bigint, b bigint, kind int, at string")


def verified(edges: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The edges (a, b) whose texts (key, text) have at least this Jaccard similarity of their shingles."""
    def check(batches):
        for batch in batches:
            for x, y in slices(batch.column(2), 1_000_000):
                part = batch.slice(x, y - x)
                left, right = shingle_sets(part.column(2), words), shingle_sets(part.column(3), words)
                keep = []
                for k in range(part.num_rows):
                    p, q = left[0][left[1][k]:left[1][k + 1]], right[0][right[1][k]:right[1][k + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    keep.append(both >= similarity * (len(p) + len(q) - both))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        free_memory()

    with_a = edges.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a")
    both = with_a.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a bigint, b bigint")


def links_between(rest: DataFrame, classes: DataFrame, found: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that join all groups of `found` (key, root) with a similar pair among the rows that meet in `rest` (a, b, at)."""
    share = differing(similarity)

    def open_rows(table: pa.Table) -> pa.Table:
        return table.select(["at", "key", "fp", "root"]).take(pa.array(crossing(wide(table.column("fp")).view("<u8"), table.column("root").to_numpy(), share)))

    def sets(batches):
        for batch in batches:
            for x, y in slices(batch.column(1), 1_000_000):
                hashes, offsets = shingle_sets(batch.column(1).slice(x, y - x), words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array([hashes[p:q].tobytes() for p, q in zip(offsets[:-1], offsets[1:])], pa.binary())],
                                                 ["key", "hashes"])
        free_memory()

    def compare(table: pa.Table) -> pa.Table:
        key, data = table.column("key").to_numpy(), table.column("hashes").to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(x) // 8 for x in data])]).astype(np.int64)
        u, v = similar_pairs(wide(table.column("fp")).view("<u8"), table.column("root").to_numpy(), np.frombuffer(b"".join(data), np.uint64), offsets, share, similarity)
        return pa.table({"a": key[u], "b": key[v]})

    rows = rest.select("at", F.col("a").alias("key")).union(rest.select("at", F.col("b").alias("key"))).distinct()
    rows = rows.join(classes.select("key", "fp"), "key").join(found, "key", "left").select("at", "key", "fp", F.coalesce("root", "key").alias("root"))
    open_ = stored(rows.groupBy("at").applyInArrow(open_rows, "at string, key bigint, fp binary, root bigint"))
    used = stored(texts.join(open_.select("key").distinct(), "key", "left_semi").select("key", "text").mapInArrow(sets, "key bigint, hashes binary"))
    full = open_.join(used, "key").select("at", "key", "fp", "root", "hashes")
    parts = open_.join(used.select("key", F.length("hashes").alias("_size")), "key").groupBy("at").agg(F.greatest(F.lit(1), F.ceil(F.sum("_size") / SET_BYTES)).cast("int").alias("_n"))
    return paired(full, ["at"], parts).groupBy("at", "_a", "_b").applyInArrow(compare, "a bigint, b bigint").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(key, root) of the keys that edges (a, b) link."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    return stored(components(nodes, edges, []).select(F.col("node").alias("key"), F.col("component").alias("root")))


def similar_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SIMILAR_WORDS, similarity: float = SIMILARITY,
                    recall: float = RECALL, sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows (id, tie, key) of the documents, and (key, root, first) of their classes: root names the group of a class, first is
    its smallest (id is null, id, tie)."""
    made = stored(wide_fingerprints(docs, doc_id, text, words))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tie")).alias("first")
    classes = stored(made.groupBy("key").agg(first, F.max("fp").alias("fp")))
    edges = stored(candidate_links(classes, similarity, recall, sample, leaf_rows))
    of = lambda kind: edges.filter(F.col("kind") == kind).select("a", "b").distinct()                  # noqa: E731
    open_ = edges.filter(F.col("kind") != SURE)
    ends = open_.select(F.col("a").alias("key")).union(open_.select(F.col("b").alias("key"))).distinct()
    ties = classes.join(ends, "key", "left_semi").select("key", F.col("first.tie").alias("tie"))
    texts = docs.select(F.xxhash64(doc_id, whole(text)).alias("tie"), whole(text).alias("text")).join(ties, "tie").dropDuplicates(["key"])
    texts = stored(texts.select("key", "text"))
    linked = stored(of(SURE).union(verified(of(FOREST), texts, words, similarity)))
    found, rest = roots(linked), edges.filter(F.col("kind") == REST)
    if not rest.isEmpty():
        # a pair inside one group changes nothing; any other may link two groups that the forest left apart
        found = roots(stored(linked.union(links_between(rest, classes, found, texts, words, similarity))))
    groups = classes.join(found, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first")
    return made.select("id", "tie", "key"), groups


def similar_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(id, component_id) per document: component_id is the smallest id of its group."""
    rows, groups = similar_classes(docs, doc_id, text, **options)
    least = groups.groupBy("root").agg(F.min("first.id").alias("component_id"))
    return rows.join(groups.join(least, "root").select("key", "component_id"), "key").select("id", "component_id")


def keep_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents without all but one of each group of similar ones: the one with the smallest id (null last), ties by text."""
    _, groups = similar_classes(docs, doc_id, text, **options)
    chosen = groups.groupBy("root").agg(F.min("first").alias("m")).select(F.col("m.tie").alias("_tie")).distinct()
    keyed = rows_of(docs, _tie=F.xxhash64(doc_id, whole(text)))
    return keyed.join(chosen, "_tie", "left_semi").dropDuplicates(["_tie"]).select("_row.*")
