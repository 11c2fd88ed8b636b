"""Language-model scores by a hashed maximum-entropy model with class-factored softmax.

The probability of a token is that of its class given the context, times that of the token in its class. Frequent tokens
(heads) are put into classes by k-means of their neighbours' counts; all others, unseen ones included, belong to a class by a
hash of their last two characters. The class factor is a softmax over hashed features of the context: the token before, the
token before that one (a skip), and both together. In a class of heads the most frequent members and one slot for the rest
have a softmax of their own over features hashed with the class; below a slot, and in the other classes, tokens follow their
smoothed share of the class. Offsets of both softmaxes are the log shares of the counts, so untrained features leave a class
unigram model.

Training: in each round every task runs gradient steps (AdaGrad) over its documents of that round; changes are averaged per
feature row, weighted by how often the task met the row, in a tree of sums. All training documents are used once. Counts of
tokens, neighbours and classes cover all training documents and live in a table; the MOST_LOOKUP most frequent tokens travel
with the model, scores of others are completed by a join. Model size is set by the parameters alone.

Defined cases: a null or empty text has the end token only; a null key belongs to the held-out part; repeated rows are
documents of their own; without training documents N = V = 0 and all tokens are unseen; input columns named like those of the
result are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import coded_words, field, free_memory, mix64, partitions, ragged, rows_of, segment_sums, slices, stored, whole

END = ""                         # the end token: no word is empty
MOST_LOOKUP = 262_144            # tokens whose counts travel with the model
HEADS, ANCHORS = 8_192, 32       # tokens put into classes by their neighbours; neighbours that are told apart
GROUPS, SHAPES = 16, 8           # classes of heads, classes by the last two characters
CLASSES, SLOTS = GROUPS + SHAPES, 16
ROWS, SLOT_ROWS = 1 << 15, 1 << 14
BLOCK = 512                      # feature rows sent together
ROUNDS, BATCH, RATE = 2, 8_192, 0.3
LEARNER = 2_000_000              # training tokens that a task should have at least: what it sends doesn't shrink with its share
SALTS = 16
FEW = 6                          # gradients of a feature row that are added up side by side
SMOOTH = 0.1


@dataclass
class Vocabulary:
    """Frequent tokens by descending count, their counts, and the totals of the training tokens."""
    words: pa.Array
    counts: np.ndarray
    total: int
    distinct: int
    shape_counts: np.ndarray     # tokens and distinct tokens of the classes by last characters
    shape_distinct: np.ndarray
    group: np.ndarray            # class of each head
    slot: np.ndarray             # its slot in the class

    @property
    def heads(self) -> int:
        return len(self.group)


def shape_of(word: str) -> int:
    return zlib.crc32(word[-2:].encode()) % SHAPES


def shapes_of(words: pa.Array) -> np.ndarray:
    """Shape of each word; every pair of last characters is hashed once."""
    ends = pc.utf8_slice_codeunits(words, -2).dictionary_encode()
    of = np.fromiter(map(shape_of, ends.dictionary.to_pylist()), np.int8, len(ends.dictionary))
    return of[ends.indices.to_numpy(zero_copy_only=False)]


# ---------------------------------------------------------------- tokens of a slice of texts

@dataclass
class Tokens:
    """Tokens of some texts, each with its end token: codes into `words`, whose last entry is the end token; `offsets` of the rows."""
    codes: np.ndarray
    offsets: np.ndarray
    words: pa.Array


def tokens_of(texts: pa.Array) -> Tokens:
    codes, words, offsets = coded_words(texts, lower=True)
    rows = len(offsets) - 1
    n = np.diff(offsets)
    out = np.full(len(codes) + rows, len(words), np.int64)
    out[np.arange(len(codes)) + np.repeat(np.arange(rows), n)] = codes
    return Tokens(out, np.concatenate([[0], np.cumsum(n + 1)]), pa.concat_arrays([words.cast(pa.string()), pa.array([END], pa.string())]))


def before(values: np.ndarray, offsets: np.ndarray, back: int, begin: int) -> np.ndarray:
    """The value `back` places before each; `begin` before a text."""
    out = np.full(len(values), begin, values.dtype)
    out[back:] = values[:-back]
    out[ragged(offsets[:-1], np.minimum(np.diff(offsets), back))] = begin
    return out


# ---------------------------------------------------------------- counts

def count_tokens(texts: DataFrame) -> DataFrame:
    """(token, n) of all tokens; each task adds up its own before the shuffle."""
    most = 1_000_000

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def merged() -> pa.Table:
            return pa.concat_tables(held).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])

        for batch in batches:
            for a, b in slices(batch.column(0)):
                tokens = tokens_of(batch.column(0).slice(a, b - a))
                n = np.bincount(tokens.codes, minlength=len(tokens.words))
                held.append(pa.table({"token": tokens.words, "n": pa.array(n, pa.int64())}))
                size += len(tokens.words)
                if size > most:
                    held = [merged()]
                    size = held[0].num_rows
                    if size > most // 2:
                        yield from held[0].combine_chunks().to_batches(65_536)
                        held, size = [], 0
        if held:
            yield from merged().combine_chunks().to_batches(65_536)
        free_memory()

    return texts.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def added_up(parts: DataFrame) -> dict[int, np.ndarray]:
    """Sum of the float32 arrays `data` by `block`, in two levels, as a dictionary: one array a block."""
    def add(table: pa.Table) -> pa.Table:
        total = None
        for chunk in table.column("data"):
            one = np.frombuffer(chunk.as_py(), np.float32)
            total = one.astype(np.float64) if total is None else total + one
        return pa.table({"block": table.column("block").slice(0, 1), "part": table.column("part").slice(0, 1), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    kind = "block int, part int, data binary"
    some = parts.withColumn("part", F.pmod("part", F.lit(SALTS))).groupBy("block", "part").applyInArrow(add, kind)
    return {r["block"]: np.frombuffer(r["data"], np.float32) for r in some.groupBy("block").applyInArrow(add, kind).collect()}


def _sent(arrays: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task, those of zeros left out."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    for block, data in arrays.items():
        if data.any():
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], names=["block", "part", "data"])


def fewer(texts: DataFrame, tokens: int) -> DataFrame:
    """`texts` in no more tasks than their tokens are worth; partitions are read together, nothing is shuffled."""
    return texts.coalesce(max(1, tokens // LEARNER))


def neighbour_counts(texts: DataFrame, words: pa.Array, heads: int) -> np.ndarray:
    """How often each head stands before and behind each of the ANCHORS most frequent tokens."""
    width = 2 * ANCHORS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(heads * width)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                tokens = tokens_of(batch.column(0).slice(a, b - a))
                known = pc.fill_null(pc.index_in(tokens.words, value_set=words.slice(0, heads)), heads).to_numpy(zero_copy_only=False)
                now = known[tokens.codes].astype(np.int64)
                last = before(now, tokens.offsets, 1, heads)
                up = (now < heads) & (last < ANCHORS)
                total += np.bincount(now[up] * width + last[up], minlength=len(total))
                down = (last < heads) & (now < ANCHORS)
                total += np.bincount(last[down] * width + ANCHORS + now[down], minlength=len(total))
        free_memory()
        size = BLOCK * width
        yield from _sent({k: total[k * size:(k + 1) * size] for k in range(-(-len(total) // size))})

    got = added_up(texts.mapInArrow(count, "block int, part int, data binary"))
    out = np.zeros(heads * width, np.float32)
    for k, data in got.items():
        out[k * BLOCK * width:k * BLOCK * width + len(data)] = data
    return out.reshape(heads, width)


def grouped_heads(neighbours: np.ndarray, counts: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Class of each head: k-means of the square roots of its neighbours' shares, weighted by counts, from centres far apart."""
    side = neighbours.reshape(len(neighbours), 2, -1).astype(np.float64)
    x = np.sqrt(side / np.maximum(side.sum(axis=2, keepdims=True), 1)).reshape(len(neighbours), -1)
    w = np.sqrt(counts[:len(x)].astype(np.float64))
    centres, near = [x[0]], ((x - x[0]) ** 2).sum(axis=1)
    for _ in range(GROUPS - 1):
        centres.append(x[int(np.argmax(near * w))])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(axis=1))
    centres = np.stack(centres)
    for _ in range(rounds):
        at = np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)
        for g in np.unique(at):
            centres[g] = np.average(x[at == g], axis=0, weights=w[at == g])
    return np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def vocabulary(texts: DataFrame, counts: DataFrame) -> Vocabulary:
    """What travels with the model: the frequent tokens down to the least count that keeps them below MOST_LOOKUP."""
    steps = counts.groupBy(F.floor(F.log2("n") * 8).alias("step")).agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()
    total, distinct, kept, least = 0, 0, 0, None
    for r in sorted(steps, key=lambda r: -r["step"]):
        total, distinct = total + r["n"], distinct + r["types"]
        if kept is not None and kept + r["types"] <= MOST_LOOKUP:
            kept, least = kept + r["types"], r["least"]
        else:
            kept = None
    top = counts.filter(F.col("n") >= (least if least is not None else 1 << 62)).toPandas().sort_values(["n", "token"], ascending=[False, True])
    words, n = pa.array(top["token"].tolist(), pa.string()), top["n"].to_numpy(np.int64)
    heads = min(HEADS, len(words))
    group = grouped_heads(neighbour_counts(fewer(texts, total), words, heads), n) if heads else np.zeros(0, np.int64)
    slot = np.zeros(heads, np.int64)
    for g in range(GROUPS):
        mine = np.flatnonzero(group == g)
        slot[mine] = np.minimum(np.arange(len(mine)), SLOTS - 1)
    shapes_n, shapes_v = np.zeros(SHAPES), np.zeros(SHAPES)
    shape = F.pmod(F.crc32(F.substring("token", -2, 2).cast("binary")), F.lit(SHAPES))
    for s, tokens, types in counts.groupBy(shape.alias("s")).agg(F.sum("n"), F.count(F.lit(1))).collect():
        shapes_n[s], shapes_v[s] = tokens, types
    for word, c in zip(words.slice(0, heads).to_pylist(), n):
        shapes_n[shape_of(word)] -= c
        shapes_v[shape_of(word)] -= 1
    return Vocabulary(words, n, total, distinct, shapes_n, shapes_v, group, slot)


# ---------------------------------------------------------------- the model

class Maxent:
    """Feature rows of the class factor (`rows`, ROWS x CLASSES) and of the slots in classes of heads (`inner`)."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.rows = np.zeros((ROWS, CLASSES), np.float32)
        self.inner = np.zeros((SLOT_ROWS, SLOTS), np.float32)
        heads, n = vocab.heads, vocab.counts[:vocab.heads].astype(np.float64)
        of_group = np.bincount(vocab.group, n, GROUPS) if heads else np.zeros(GROUPS)
        shares = np.concatenate([of_group, vocab.shape_counts]) + 1.0
        self.offset = np.log(shares / shares.sum()).astype(np.float32)
        slots = np.zeros((GROUPS, SLOTS))
        np.add.at(slots, (vocab.group, vocab.slot), n)
        with np.errstate(divide="ignore"):
            self.slot_offset = np.maximum(np.log(slots / np.maximum(slots.sum(axis=1, keepdims=True), 1)), -30).astype(np.float32)
        self.rest = slots[:, SLOTS - 1]                          # tokens of the last slot, shared out by count

    def coded(self, tokens: Tokens) -> "Coded":
        return Coded(self, tokens)

    def class_logits(self, c: "Coded", a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        hit = c.features(a, b)
        logits = self.rows[hit[0]] + self.offset
        logits += self.rows[hit[1]]
        logits += self.rows[hit[2]]
        return logits, hit

    def slot_logits(self, c: "Coded", at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = c.slot_features(at)
        logits = self.slot_offset[c.cls[at]]
        logits += self.inner[hit[0]]
        logits += self.inner[hit[1]]
        return logits, hit


class Coded:
    """Classes, slots and feature rows of the tokens of a slice."""

    def __init__(self, model: Maxent, tokens: Tokens):
        v = model.vocab
        words = tokens.words
        self.place = pc.fill_null(pc.index_in(words, value_set=v.words), -1).to_numpy(zero_copy_only=False) if len(v.words) else np.full(len(words), -1)
        name = np.fromiter(map(zlib.crc32, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
        head = (self.place >= 0) & (self.place < v.heads)
        cls = shapes_of(words)
        cls += GROUPS
        cls[head] = v.group[self.place[head]]
        slot = np.zeros(len(words), np.int8)
        slot[head] = v.slot[self.place[head]]
        self.codes, self.offsets = tokens.codes, tokens.offsets
        self.cls, self.slot, self.head = cls[tokens.codes], slot[tokens.codes], head[tokens.codes]
        name = name[tokens.codes]
        self.one, self.two = (before(name, tokens.offsets, back, 1 << 40) for back in (1, 2))         # 1 << 40 is no hash of a word

    def features(self, a: int, b: int) -> tuple[np.ndarray, ...]:
        one, two = self.one[a:b], self.two[a:b]
        both = one * np.uint64(0x9E3779B97F4A7C15) + two
        return tuple((mix64(x, k) & np.uint64(ROWS - 1)).astype(np.int64) for k, x in enumerate((one, two, both)))

    def slot_features(self, at: np.ndarray) -> tuple[np.ndarray, ...]:
        c = self.cls[at].astype(np.uint64) << np.uint64(42)
        return tuple((mix64(x + c, k + 7) & np.uint64(SLOT_ROWS - 1)).astype(np.int64) for k, x in enumerate((self.one[at], self.two[at])))


def _top(logits: np.ndarray) -> np.ndarray:
    """Largest logit of each row, as a column; the columns are halved, which numpy does faster than reducing short rows."""
    while logits.shape[1] > 1 and logits.shape[1] % 2 == 0:
        half = logits.shape[1] // 2
        logits = np.maximum(logits[:, :half], logits[:, half:])
    return logits.max(axis=1, keepdims=True)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Probabilities, in the place of the logits."""
    logits -= _top(logits)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def _log_total(logits: np.ndarray) -> np.ndarray:
    """Log normaliser of each row; the logits are used up."""
    top = _top(logits)
    logits -= top
    np.exp(logits, out=logits)
    return top[:, 0] + np.log(logits.sum(axis=1))


def _run_sums(values: np.ndarray, at: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of values[at] over runs of `n` places from `first`, runs of more than FEW before the others and these by falling
    length. Most runs are short: they are added up place by place, all runs at once, in the order that reduceat has (the
    first to the sum of the rest), so the sums are the same to the last bit."""
    longer = [int((n > k).sum()) for k in range(FEW + 1)]                     # runs of more than k places
    many, out = longer[FEW], values[at[first]]
    if many:
        ends = np.cumsum(n[:many])
        out[:many] = np.add.reduceat(values[at[ragged(first[:many], n[:many])]], ends - n[:many], axis=0)
    rest = values[at[first[many:longer[1]] + 1]]
    for k in range(2, FEW):
        rest[:longer[k] - many] += values[at[first[many:longer[k]] + k]]
    out[many:longer[1]] += rest
    return out


class _Steps:
    """AdaGrad on the rows of a table; remembers how often each row was met."""

    def __init__(self, table: np.ndarray, rate: float):
        self.table, self.rate = table, rate
        self.square, self.met = np.full(len(table), 1.0, np.float32), np.zeros(len(table), np.float32)

    def step(self, hit: np.ndarray, gradient: np.ndarray) -> None:
        """`hit`: rows of one or more features, one after another, each with the same gradients."""
        order = np.argsort(hit.astype(np.uint16), kind="stable")         # tables have at most 65,536 rows: a radix sort
        sorted_hit = hit[order]
        first = np.flatnonzero(np.diff(sorted_hit, prepend=-1))
        n = np.diff(first, append=len(hit))
        longest = np.argsort(-np.minimum(n, FEW + 1).astype(np.int8), kind="stable")
        first, n = first[longest], n[longest]
        rows, g = sorted_hit[first], _run_sums(gradient, order % len(gradient), first, n)
        self.square[rows] += (g * g).sum(axis=1)
        self.met[rows] += n
        self.table[rows] -= self.rate * g / np.sqrt(self.square[rows])[:, None]


def train_on(model: Maxent, texts: Iterator[pa.Array], rate: float) -> tuple[_Steps, _Steps]:
    """Gradient steps over the texts; `model` changes."""
    outer, inner = _Steps(model.rows, rate), _Steps(model.inner, rate)
    for text in texts:
        c = model.coded(tokens_of(text))
        for a in range(0, len(c.codes), BATCH):
            b = min(a + BATCH, len(c.codes))
            logits, hit = model.class_logits(c, a, b)
            p = _softmax(logits)
            p[np.arange(b - a), c.cls[a:b]] -= 1
            outer.step(np.concatenate(hit), p)
            at = a + np.flatnonzero(c.head[a:b])
            if len(at):
                logits, hit = model.slot_logits(c, at)
                p = _softmax(logits)
                p[np.arange(len(at)), c.slot[at]] -= 1
                inner.step(np.concatenate(hit), p)
    return outer, inner


def train(texts: DataFrame, vocab: Vocabulary) -> Maxent:
    """`texts`: (text, _round)."""
    model = Maxent(vocab)
    for k in range(ROUNDS):
        rows, inner = model.rows, model.inner

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Maxent(vocab)
            own.rows, own.inner = rows.copy(), inner.copy()
            steps = train_on(own, (batch.column(0).slice(a, b - a) for batch in batches for a, b in slices(batch.column(0))), RATE / (k + 1))
            sent = {}
            for first, step, old in ((0, steps[0], rows), (ROWS // BLOCK, steps[1], inner)):
                change = np.concatenate([(step.table - old) * step.met[:, None], step.met[:, None]], axis=1)
                sent |= {first + i: change[i * BLOCK:(i + 1) * BLOCK].ravel() for i in range(len(old) // BLOCK)}
            free_memory()
            yield from _sent(sent)

        got = added_up(fewer(texts.filter(F.col("_round") == k).select("text"), vocab.total // ROUNDS).mapInArrow(learn, "block int, part int, data binary"))
        model.rows, model.inner = rows.copy(), inner.copy()
        for block, data in got.items():
            table, at, width = (model.rows, block, CLASSES) if block < ROWS // BLOCK else (model.inner, block - ROWS // BLOCK, SLOTS)
            data = data.reshape(BLOCK, width + 1)
            table[at * BLOCK:(at + 1) * BLOCK] += data[:, :width] / np.maximum(data[:, width:], 1)
    return model


def log_probabilities(model: Maxent, c: Coded) -> np.ndarray:
    """Natural log probability of each token, without log(count + SMOOTH) for tokens beyond the heads."""
    v = model.vocab
    out = np.empty(len(c.codes))
    shape_z = np.log(v.shape_counts + SMOOTH * (v.shape_distinct + 1))
    rest_z = np.log(np.maximum(model.rest, 1))
    place = c.place[c.codes]
    for a in range(0, len(c.codes), BATCH):
        b = min(a + BATCH, len(c.codes))
        logits, _ = model.class_logits(c, a, b)
        out[a:b] = logits[np.arange(b - a), c.cls[a:b]]
        out[a:b] -= _log_total(logits)
        at = a + np.flatnonzero(c.head[a:b])
        if len(at):
            logits, _ = model.slot_logits(c, at)
            out[at] += logits[np.arange(len(at)), c.slot[at]]
            out[at] -= _log_total(logits)
            last = at[c.slot[at] == SLOTS - 1]
            out[last] += np.log(v.counts[place[last]]) - rest_z[c.cls[last]]
        tail = a + np.flatnonzero(~c.head[a:b])
        out[tail] -= shape_z[c.cls[tail] - GROUPS]
    return out


# ---------------------------------------------------------------- scores of documents

ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_documents(docs: DataFrame, counts: DataFrame, model: Maxent, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns (all by default) with n_tokens, n_known, train_tokens, base_score and score (log10)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    v = model.vocab
    base_z = np.log10(v.total + SMOOTH * (v.distinct + 1))
    kind = F.struct(*[F.col(f"`{c}`") for c in keep])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = np.log10(np.append(v.counts, 0) + SMOOTH)       # the last entry: told by the join
        common[-1] = 0
        for batch in batches:
            found, names, numbers, sizes = [], [], [], []
            for a, b in slices(batch.column(1)):
                tokens = tokens_of(batch.column(1).slice(a, b - a))
                c = model.coded(tokens)
                place = c.place[c.codes]
                tail = ~c.head
                logs = log_probabilities(model, c) / np.log(10)
                logs[tail] += common[place[tail]]
                n = np.diff(c.offsets)
                found.append(np.stack([n, segment_sums((place >= 0).astype(np.float64), c.offsets), segment_sums(common[place], c.offsets) - n * base_z, segment_sums(logs, c.offsets)]))
                rare = np.flatnonzero(place < 0)
                row = np.repeat(np.arange(len(n)), n)[rare]
                pair, times = np.unique(row * len(tokens.words) + c.codes[rare], return_counts=True)
                names.append(tokens.words.take(pa.array(pair % len(tokens.words))))
                numbers.append(times)
                sizes.append(np.bincount(pair // len(tokens.words), minlength=len(n)))
            if not found:
                continue
            n, known, base, logs = np.concatenate(found, axis=1)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), pa.int32()),
                                             pa.StructArray.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(numbers), pa.int64())], ["token", "n"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n.astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base), pa.array(logs), lists],
                                             names=["_row", "_n", "_known", "_base", "_logs", "_rare"])
        free_memory()

    rows = docs.select(kind.alias("_row"), whole(text).alias("text"))
    row_kind = rows.schema["_row"].dataType.simpleString()
    part = stored(rows.mapInArrow(score, f"_row {row_kind}, _n long, _known long, _base double, _logs double, _rare array<struct<token:string,n:bigint>>")
                  .withColumn("_at", F.monotonically_increasing_id()))
    rare = part.select("_at", F.explode("_rare").alias("r")).select("_at", "r.token", F.col("r.n").alias("times"))
    less = counts.filter(F.col("n") < (int(v.counts[-1]) if len(v.counts) else 1 << 62))
    told = rare.join(less, "token", "left").groupBy("_at").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times"))).alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return part.join(told, "_at", "left").select(
        *[field(c).alias(c) for c in keep], F.col("_n").alias("n_tokens"), (F.col("_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(v.total).cast("bigint").alias("train_tokens"), (F.col("_base") + more).alias("base_score"), (F.col("_logs") + more).alias("score"))


def score_corpus(docs: DataFrame, learn_from: Column, round_key: Column, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Learn from the documents where `learn_from` holds, dealt to the rounds by `round_key` (an integer), and score all."""
    learning = docs.filter(learn_from)
    texts = learning.select(whole(text).alias("text"))
    counts = stored(count_tokens(texts))
    vocab = vocabulary(texts, counts)
    model = train(learning.select(whole(text).alias("text"), F.pmod(round_key, F.lit(ROUNDS)).alias("_round")), vocab)
    return score_documents(docs, counts, model, text, keep)
