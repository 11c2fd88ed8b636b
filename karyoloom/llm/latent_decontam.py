"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of two half-windows (a half-window has half as many words as the median item), overlapping by
one. The terms are the words of the benchmark; their weights come from the passages of the whole corpus, log(passages /
passages with the term), and terms in more than `stop_share` of the passages weigh nothing, unless an item has fewer than
`min_terms` others. A randomised SVD of the tf-idf matrix, all passages of the corpus and the items, is computed in two distributed
passes: range finder Z = A'(A O), and the Gram matrix of A Q for the singular vectors. Passages and items are compared by
cosine in the latent space; pairs from `min_cosine` on are checked on the text itself: the longest common subsequence of the item
and a run of half-windows, weighted by term weights. A run is as long as a passage with one item length on either side. A pair
is a copy from `copy_share` of the item on, and a paraphrase from `near_share` on if the item's answer, its last quarter, is
there too by `answer_share`.

The latent space holds little of an item once the benchmark is larger than its rank, and a copy's cosine falls with that. So
the rare terms of each item are indexed too, until those left out weigh less than half of what a match needs: runs with the
rest of that weight are checked whatever their cosine. No pair that the check on the text accepts can be missed; the cosine is told.

The benchmark is held by every task; more than `MOST_ITEMS` items are refused (give them in parts). What a task adds to the sums
has the size of benchmark words times rank, whatever the corpus.

Defined cases: a null text is empty; an item without words, or null, matches nothing; items with equal texts each match; an item of
common words only keeps their weights; rows with equal ids are judged each by its text; a null id is kept; empty tables give
empty results; other columns are kept by `decontaminate`. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import coded_words, free_memory, ragged, rows_of, segment_sums, slices, stored, whole

RANK, OVERSAMPLE = 128, 16
MOST_ITEMS = 100_000
STOP_SHARE, MIN_TERMS = 0.125, 4
MIN_COSINE, COPY_SHARE, NEAR_SHARE, ANSWER_SHARE = 0.25, 0.7, 0.45, 0.6
EDGES = ".,;:!?\"'()[]{}<>*#$%&-_"
PIECE_ROWS = 200                      # documents whose passages a worker holds at a time
MOST_PAIRS = 2_000_000                # terms with an item, or passages with an item, that are held at a time
ENTRIES = 100_000                     # terms of items that are multiplied at a time
PARTS = 16                            # row blocks in which the sums of the range finder are added up


def normal(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), EDGES)


class Items:
    """The benchmark as term sequences: vocabulary, and the terms of each item in order."""

    def __init__(self, rows: list):
        texts = [(r.item, r.text) for r in rows if r.text]
        codes, words, offsets = coded_words(pa.array([t for _, t in texts], pa.string()))
        names = normal(words).to_pylist()
        self.vocabulary = sorted({n for n in names if n})
        at = {w: k for k, w in enumerate(self.vocabulary)}
        term = np.fromiter((at.get(n, -1) for n in names), np.int64, len(names))[codes] if len(names) else np.zeros(0, np.int64)
        lists = [x[x >= 0] for x in np.split(term, offsets[1:-1])] if texts else []
        keep = [k for k, x in enumerate(lists) if len(x)]
        self.names, self.terms = [texts[k][0] for k in keep], [lists[k] for k in keep]
        self.half = max(4, int(np.median([len(x) for x in self.terms]) / 2)) if keep else 4


def _terms(texts: pa.Array, vocabulary: pa.Array, half: int):
    """(term of each word or -1, half-window of each word counted over all rows, half-windows of each row)."""
    codes, words, offsets = coded_words(texts)
    found = pc.fill_null(pc.index_in(normal(words), value_set=vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(offsets)
    windows = np.maximum(-(-n // half), 1)
    first = np.cumsum(windows) - windows
    inside = np.arange(len(codes)) - np.repeat(offsets[:-1], n)
    return found[codes], np.repeat(first, n) + inside // half, windows


def passages_with(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """(passages with each term, all passages), over the corpus."""
    vocabulary, half = pa.array(items.vocabulary, pa.string()), items.half

    def count(batches):
        size = len(vocabulary)
        seen, total = np.zeros(size, np.int64), 0
        for batch in batches:
            for a, b in slices(batch.column(0), 2_000_000):
                term, window, windows = _terms(batch.column(0).slice(a, b - a), vocabulary, half)
                last = np.repeat(np.cumsum(windows) - 1, windows)
                pair = np.unique(window[term >= 0] * size + term[term >= 0])          # a term of a half-window, once
                w, t = pair // size, pair % size
                # the passages of half-window w are w and w - 1 of its row: a term is counted in w, and in w - 1 unless that has it too
                start = np.repeat(np.cumsum(windows) - windows, windows)
                own = (w < last[w]) | (last[w] == start[w])
                seen += np.bincount(t[own], minlength=size)
                back = w > start[w]
                both = np.isin(pair[back] - size, pair)
                seen += np.bincount(t[back][~both], minlength=size)
                total += int(np.maximum(windows - 1, 1).sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(seen), pa.array(np.full(size, total))], ["term", "n", "total"])
        free_memory()

    counts = docs.select(whole("text").alias("text")).mapInArrow(count, "term bigint, n bigint, total bigint")
    rows = counts.groupBy("term").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()    # a row per word of the benchmark
    out = np.zeros(len(items.vocabulary), np.int64)
    for r in rows:
        out[r.term] = r.n
    return out, int(rows[0].total) if rows else 0


def weights(items: Items, seen: np.ndarray, total: int, stop_share: float, min_terms: int) -> np.ndarray:
    w = np.log((total + 1) / (seen + 1)) + 1e-6
    live = seen <= stop_share * max(total, 1)
    for x in items.terms:
        if live[np.unique(x)].sum() < min_terms:
            live[x] = True
    return np.where(live, np.maximum(w, 1e-3), 0.0)


def compact(docs: DataFrame, items: Items, weight: np.ndarray) -> DataFrame:
    """(id, tie, terms binary, counts array): the weighted terms of each document in order, and how many each half-window
    has. Documents without any are left out: they are orthogonal to every item."""
    vocabulary, half = pa.array(items.vocabulary, pa.string()), items.half

    def encode(batches):
        for batch in batches:
            for a, b in slices(batch.column(2), 2_000_000):
                term, window, windows = _terms(batch.column(2).slice(a, b - a), vocabulary, half)
                use = (term >= 0) & (weight[term] > 0)
                per = np.bincount(window[use], minlength=int(windows.sum()))
                ends = np.concatenate([[0], np.cumsum(windows)])
                at = np.concatenate([[0], np.cumsum(per)])[ends]
                flat = term[use].astype("<i4")
                full = np.flatnonzero(np.diff(at))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(full)), part.column(1).take(pa.array(full)),
                    pa.array([flat[at[k]:at[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array([per[ends[k]:ends[k + 1]].astype(np.int32) for k in full], pa.list_(pa.int32()))], ["id", "tie", "terms", "counts"])
        free_memory()

    return docs.mapInArrow(encode, "id bigint, tie bigint, terms binary, counts array<int>")


class Passages:
    """The half-windows and passages of some compact rows."""

    def __init__(self, batch: pa.RecordBatch):
        data = batch.column(2)
        self.terms = np.frombuffer(b"".join(data.to_pylist()), "<i4").astype(np.int64)
        per = batch.column(3)
        self.counts = per.flatten().to_numpy().astype(np.int64)
        windows = np.diff(per.offsets.to_numpy()).astype(np.int64)
        self.row_ends = np.concatenate([[0], np.cumsum(windows)])
        self.at = np.concatenate([[0], np.cumsum(self.counts)])
        number = np.maximum(windows - 1, 1)
        self.row = np.repeat(np.arange(len(windows)), number)
        inside = np.arange(len(self.row)) - np.repeat(np.cumsum(number) - number, number)
        self.first = self.row_ends[self.row] + inside                       # half-windows first .. last of each passage
        self.last = np.minimum(self.first + 1, self.row_ends[self.row + 1] - 1)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over each passage of the values of its terms: half-windows first, those with most terms in front, one term of
        each at a time."""
        order = np.argsort(-self.counts, kind="stable")
        start, size = self.at[:-1][order], self.counts[order]
        made = np.zeros((len(order), *values.shape[1:]), values.dtype)
        for k in range(int(size[0]) if len(size) else 0):
            m = int(np.searchsorted(-size, -k, "left"))
            made[:m] += values[self.terms[start[:m] + k]]
        of = np.empty_like(made)
        of[order] = made
        out, two = of[self.first], self.last > self.first
        out[two] += of[self.last[two]]
        return out

    def spread(self, y: np.ndarray, size: int) -> np.ndarray:
        """Sum of the rows of y over the passages of each occurrence, by term."""
        of, two = np.zeros((len(self.counts), y.shape[1]), y.dtype), self.last > self.first
        of[self.first] += y                                   # a half-window is the first of one passage, the last of one
        of[self.last[two]] += y[two]
        window = np.repeat(np.arange(len(self.counts)), self.counts)
        order = np.argsort(self.terms, kind="stable")
        ends = np.searchsorted(self.terms[order], np.arange(size + 1))
        return segment_sums(of[window[order]], ends)


def _sum_matrices(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Add up matrices that tasks give in row blocks (part, data); the sum has a fixed size and comes to the driver."""
    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in group["data"])
        return pd.DataFrame({"part": group["part"].iloc[:1], "data": [np.asarray(total, "<f8").tobytes()]})

    out = np.zeros((rows, columns))
    cut = np.linspace(0, rows, PARTS + 1).astype(int)
    for r in parts.groupBy("part").applyInPandas(add, "part int, data binary").collect():
        out[cut[r.part]:cut[r.part + 1]] = np.frombuffer(r.data, "<f8").reshape(-1, columns)
    return out


def _in_parts(x: np.ndarray) -> pa.RecordBatch:
    cut = np.linspace(0, len(x), PARTS + 1).astype(int)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(
        [x[a:b].astype("<f4").tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], ["part", "data"])


def _pieces(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(a, PIECE_ROWS)


class ItemRows:
    """The tf-idf rows of the items as (item, term, weight) entries: a dense matrix would grow with items times words."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray):
        n, self.words = len(terms), len(weight)
        entry, times = np.unique(np.repeat(np.arange(n), [len(x) for x in terms]) * self.words + np.concatenate(terms), return_counts=True)
        self.item, self.term = entry // self.words, entry % self.words
        value = weight[self.term] * times
        norm = np.sqrt(np.bincount(self.item, value ** 2, n))
        self.value = (value / (np.maximum(norm, 1e-9) * np.sqrt(n))[self.item]).astype(np.float32)
        self.rows = np.searchsorted(self.item, np.arange(n + 1))
        self.order = np.argsort(self.term, kind="stable")
        self.columns = np.searchsorted(self.term[self.order], np.arange(self.words + 1))

    @staticmethod
    def _sums(ends: np.ndarray, at: np.ndarray, value: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Row k: the sum of value * x[at] over the entries ends[k] .. ends[k + 1], a bounded number of entries at a time."""
        out, a, n = np.zeros((len(ends) - 1, x.shape[1]), np.float32), 0, len(ends) - 1
        while a < n:
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + ENTRIES, "right")) - 1)
            of = slice(ends[a], ends[b])
            out[a:b] = segment_sums(value[of, None] * x[at[of]], ends[a:b + 1] - ends[a])
            a = b
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        """(items, k) from (words, k)."""
        return self._sums(self.rows, self.term, self.value, x)

    def transposed(self, y: np.ndarray) -> np.ndarray:
        """(words, k) from (items, k)."""
        return self._sums(self.columns, self.item[self.order], self.value[self.order], y)


def latent(rows: DataFrame, items: Items, weight: np.ndarray, total: int, rank: int, seed: int = 0) -> np.ndarray:
    """Right singular vectors (terms, rank) of the tf-idf matrix of all passages and items; corpus and benchmark have
    equal say."""
    d = len(items.vocabulary)
    k = min(d, rank + OVERSAMPLE)
    own = ItemRows(items.terms, weight)
    w = (weight / np.sqrt(max(total, 1) * max(items.half, 1) * (weight.max() ** 2 or 1))).astype(np.float32)
    omega = np.random.default_rng(seed).standard_normal((d, k)).astype(np.float32)

    def find(batches):
        z, by = np.zeros((d, k), np.float32), w[:, None] * omega
        for part in _pieces(batches):
            p = Passages(part)
            z += w[:, None] * p.spread(p.sums(by), d)
        yield _in_parts(z)

    z = _sum_matrices(rows.mapInArrow(find, "part int, data binary"), d, k) + own.transposed(own.times(omega))
    q = np.linalg.qr(z)[0].astype(np.float32)

    def gram(batches):
        g, by = np.zeros((k, k), np.float64), w[:, None] * q
        for part in _pieces(batches):
            b = Passages(part).sums(by).astype(np.float64)
            g += b.T @ b
        yield _in_parts(g)

    g = _sum_matrices(rows.mapInArrow(gram, "part int, data binary"), k, k)
    b = own.times(q)
    values, vectors = np.linalg.eigh(g + b.T @ b)
    return (q @ vectors[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)


def common_weight(item: np.ndarray, body: np.ndarray, weight: np.ndarray) -> float:
    """Largest weight of a common subsequence."""
    best = np.zeros(len(body) + 1)
    for t in item:
        step = np.where(body == t, best[:-1] + weight[t], 0.0)
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], step))
    return float(best[-1])


class Index:
    """Items by their rare terms. `floor` is the least share of an item that can be a match; the terms indexed leave out less
    than half of it, so a match has the other part in them."""

    def __init__(self, terms: list[np.ndarray], weight: np.ndarray, lengths: np.ndarray, floor: float):
        self.words, self.lengths, self.longest = len(weight), lengths, int(lengths.max())
        self.need = np.zeros(len(terms))
        term, item, share = [], [], []
        for i, x in enumerate(terms):
            t, times = np.unique(x, return_counts=True)
            part = weight[t] * times / weight[x].sum()
            order = np.argsort(-weight[t], kind="stable")
            left = 1.0 - np.cumsum(part[order])
            use = order[:int(np.argmax(left <= floor / 2 + 1e-12)) + 1]
            self.need[i] = floor - (1.0 - part[use].sum()) - 1e-6
            term.append(t[use])
            item.append(np.full(len(use), i))
            share.append(part[use])
        term, order = np.concatenate(term), np.argsort(np.concatenate(term), kind="stable")
        self.item, self.share = np.concatenate(item)[order], np.concatenate(share)[order]
        self.start = np.searchsorted(term[order], np.arange(self.words))
        self.size = np.bincount(term, minlength=self.words)

    def runs(self, p: Passages):
        """(first half-window, item) of the runs that have enough of an item; a run starts where a term of the item stands."""
        n = len(p.counts)
        pair = np.unique(np.repeat(np.arange(n), p.counts) * self.words + p.terms)
        window, term = pair // self.words, pair % self.words
        window, term = window[self.size[term] > 0], term[self.size[term] > 0]
        many = self.size[term]
        cost = np.concatenate([[0], np.cumsum(np.bincount(window, many, n))])
        row_end = np.repeat(p.row_ends[1:], np.diff(p.row_ends))
        a = 0
        while a < n:
            b = max(a + 1, int(np.searchsorted(cost, cost[a] + MOST_PAIRS, "right")) - 1)
            stop = min(n, b + self.longest)
            u, v = np.searchsorted(window, [a, stop])
            at, wide = ragged(self.start[term[u:v]], many[u:v]), stop - a
            key, of = np.unique(self.item[at] * wide + np.repeat(window[u:v], many[u:v]) - a, return_inverse=True)
            before = np.concatenate([[0], np.cumsum(np.bincount(of, self.share[at], len(key)))])
            item, first = key // wide, key % wide + a
            last = np.minimum(np.minimum(first + self.lengths[item], row_end[first]), stop)
            have = before[np.searchsorted(key, item * wide + last - a)] - before[:-1]
            told = (have >= self.need[item]) & (first < b)
            yield first[told], item[told]
            a = b


def best_run(starts: list[int], length: int, end: int, p: Passages, item: np.ndarray, weight: np.ndarray, copy_share: float, near_share: float,
             answer_share: float) -> tuple[float, float, int] | None:
    """(share, answer, first half-window) of the run with the largest share among those that match; the runs have `length`
    half-windows from one of `starts` (ascending), up to `end`. What several runs together lack none of them has."""
    answer = item[-max(1, len(item) // 4):]
    size, answer_size = float(weight[item].sum()), float(weight[answer].sum())
    present = np.zeros(len(weight), bool)
    best = None

    def told(some: list[int]) -> tuple[float, float] | None:
        body = p.terms[p.at[some[0]]:p.at[min(some[-1] + length, end)]]
        present[body] = True
        most = float(weight[item[present[item]]].sum()) / size        # no subsequence can weigh more than the terms in common
        present[body] = False
        if most < min(copy_share, near_share):
            return None
        body = body[np.isin(body, item)]
        share = common_weight(item, body, weight) / size
        of = common_weight(answer, body, weight) / answer_size
        return (share, of) if share >= copy_share or (share >= near_share and of >= answer_share) else None

    groups: list[list[int]] = []
    for s in starts:
        if groups and s < groups[-1][0] + length:
            groups[-1].append(s)
        else:
            groups.append([s])
    todo = [(g, told(g)) for g in reversed(groups)]
    while todo:
        some, got = todo.pop()
        if got is None or (best is not None and got[0] <= best[0]):
            continue
        if len(some) == 1:
            best = (*got, some[0])
            continue
        half = len(some) // 2
        parts = [(x, told(x)) for x in (some[:half], some[half:])]
        todo += sorted(parts, key=lambda x: x[1] or (0.0, 0.0))
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rank: int = RANK,
          stop_share: float = STOP_SHARE, min_terms: int = MIN_TERMS, min_cosine: float = MIN_COSINE, copy_share: float = COPY_SHARE, near_share: float = NEAR_SHARE,
          answer_share: float = ANSWER_SHARE) -> DataFrame:
    """(doc_id, tie, item_id, cosine, share, answer, kind): a row for each document and item found in it."""
    rows = benchmark.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: give the benchmark in parts")
    items = Items(sorted(rows, key=lambda r: (r.item is not None, r.item or 0, r.text or "")))
    schema = "doc_id bigint, tie bigint, item_id bigint, cosine double, share double, answer double, kind string"
    if not items.terms:
        return docs.sparkSession.createDataFrame([], schema)
    read = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.xxhash64(doc_id, whole(text)).alias("tie"), whole(text).alias("text"))
    seen, total = passages_with(read, items)
    weight = weights(items, seen, total, stop_share, min_terms)
    short = stored(compact(read, items, weight))
    basis = latent(short, items, weight, total, rank)
    by = (weight[:, None] * basis).astype(np.float32)
    square = (weight ** 2).astype(np.float32)
    terms = [x[weight[x] > 0] for x in items.terms]
    goal = np.stack([by[x].sum(axis=0) for x in terms])
    goal = (goal / np.sqrt([square[x].sum() for x in terms])[:, None]).astype(np.float32)
    reach = np.array([-(-len(x) // items.half) for x in items.terms])
    index = Index(terms, weight, 2 + 2 * reach, min(copy_share, near_share))
    names, step = items.names, max(1, MOST_PAIRS // len(terms))

    def search(batches):
        out = []
        for part in _pieces(batches):
            p = Passages(part)
            y = p.sums(by) / np.sqrt(np.maximum(p.sums(square), 1e-12))[:, None]
            runs: dict[tuple[int, int], set] = {}
            row_of = np.repeat(np.arange(part.num_rows), np.diff(p.row_ends))
            for a in range(0, len(y), step):
                where, item = np.nonzero(y[a:a + step] @ goal.T >= min_cosine)
                first = np.maximum(p.first[a + where] - reach[item], p.row_ends[p.row[a + where]])
                for h, i in zip(first.tolist(), item.tolist()):
                    runs.setdefault((int(row_of[h]), i), set()).add(h)
            for first, item in index.runs(p):
                for h, i in zip(first.tolist(), item.tolist()):
                    runs.setdefault((int(row_of[h]), i), set()).add(h)
            ids, ties = part.column(0).to_pylist(), part.column(1).to_pylist()
            for (row, i), starts in runs.items():
                length, end = int(index.lengths[i]), int(p.row_ends[row + 1])
                found = best_run(sorted(starts), length, end, p, terms[i], weight, copy_share, near_share, answer_share)
                if found is not None:
                    share, answer, h = found
                    of = slice(*np.searchsorted(p.row, [row, row + 1]))
                    inside = (p.last[of] >= h) & (p.first[of] < h + length)
                    cosine = float((y[of][inside] @ goal[i]).max())
                    out.append((ids[row], ties[row], names[i], min(1.0, cosine), share, answer, "copy" if share >= copy_share else "paraphrase"))
        columns = list(zip(*out)) if out else [[] for _ in range(7)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["doc_id", "tie", "item_id", "cosine", "share", "answer", "kind"])

    return short.mapInArrow(search, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents in which no item was found."""
    found = stored(leaks(docs, benchmark, doc_id, text, **options)).select(F.col("tie").alias("_tie")).distinct()
    return rows_of(docs, _tie=F.xxhash64(doc_id, whole(text))).join(found, "_tie", "left_anti").select("_row.*")
