"""Language of documents by a linear-chain conditional random field over their words.

Each word has hashed features: all its character n-grams (those with a border mark are its affixes) and its entry in a learned
lexicon of common words. Labels are languages; transitions are learned, so a word in a code-switched text is labelled from
its own letters and its neighbours. Forward-backward gives each word a distribution over languages; a document takes the
mean of its words.

The field is fitted on a bounded sample of labelled rows (about `train_docs` documents per language, `train_words` words of
each, both parameters), strung together over languages so that switches occur. Prediction reads whole texts: all words of a
batch are one chain that starts anew at each document, cut into blocks whose transfer matrices are multiplied first, so
texts of any length are labelled exactly.

Defined cases: a null text, or one without letters, is `und` with score 0; rows with a null language teach nothing; without
labelled rows all documents are `und`; equal means go to the first language in order; rows with equal or null ids each give a
row; an empty table gives an empty result; other columns are kept, `lang_pred` and `score` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from .common import coded_words, free_memory, segment_sums, slices, whole

TRAIN_DOCS, TRAIN_WORDS = 1_000, 40
HASH_BITS, NGRAMS = 17, (1, 2, 3, 4)
LEXICON_DOCS = 5
STEPS, RATE, RIDGE = 80, 0.1, 1e-6
BLOCK = 128
UNKNOWN = "und"


def letters(word: str) -> str:
    return word.lower() if word.isalpha() else "".join(c for c in word.lower() if c.isalpha())


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers of all words one after another, offsets of the words)."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    marks = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), size)
    found, owners = [], []
    with np.errstate(over="ignore"):
        for n in NGRAMS:
            if len(marks) < n:
                break
            h = np.full(len(marks) - n + 1, n, np.uint64)
            for k in range(n):
                h = (h ^ marks[k:len(marks) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            own = owner[:len(h)] == owner[n - 1:]
            found.append((h[own] >> np.uint64(64 - HASH_BITS)).astype(np.int64))
            owners.append(owner[:len(h)][own])
    known = [(i, lexicon[w]) for i, w in enumerate(words) if w in lexicon]
    if known:
        at, number = np.array(known).T
        found.append((1 << HASH_BITS) + number)
        owners.append(at)
    if not found:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    ids, of = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))])


def posteriors(emission: np.ndarray, first: np.ndarray, transition: np.ndarray, start: np.ndarray):
    """Label distribution of each word, with the scaled forward and backward vectors. emission: log scores (words, labels);
    first: whether a word starts a chain; transition, start: log weights. The batch is one chain whose step into a first
    word is the start vector from any label."""
    n, labels = emission.shape
    blocks = -(-n // BLOCK)
    pad = blocks * BLOCK - n
    e = np.exp(emission - emission.max(axis=1, keepdims=True))
    e = np.concatenate([e, np.ones((pad, labels))]).reshape(blocks, BLOCK, labels)
    f = np.concatenate([first, np.ones(pad, bool)]).reshape(blocks, BLOCK)
    move = np.exp(transition - transition.max())
    reset = np.broadcast_to(np.exp(start - start.max()), (labels, labels))
    step = lambda t: np.where(f[:, t, None, None], reset, move) * e[:, t, None, :]          # noqa: E731  (blocks, from, to)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)                                    # noqa: E731
    whole_ = lambda x: x / x.sum(axis=(1, 2), keepdims=True)                               # noqa: E731
    product = np.broadcast_to(np.eye(labels), (blocks, labels, labels))
    for t in range(BLOCK):
        product = whole_(product @ step(t))
    enter, leave = np.empty((blocks, labels)), np.empty((blocks, labels))
    a, b = np.full(labels, 1 / labels), np.ones(labels)
    for k in range(blocks):
        enter[k] = a
        a = a @ product[k]
        a = a / a.sum()
    for k in range(blocks - 1, -1, -1):
        leave[k] = b
        b = product[k] @ b
        b = b / b.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    now = enter
    for t in range(BLOCK):
        now = norm(np.einsum("bi,bij->bj", now, step(t)))
        alpha[:, t] = now
    now = leave
    for t in range(BLOCK - 1, -1, -1):
        beta[:, t] = now
        now = norm(np.einsum("bij,bj->bi", step(t), now))
    post = norm(alpha * beta).reshape(-1, labels)[:n]
    return post, alpha.reshape(-1, labels)[:n], beta.reshape(-1, labels)[:n]


@dataclass(frozen=True)
class Field:
    labels: list[str]
    lexicon: dict[str, int]
    weights: np.ndarray                # (features, labels)
    transition: np.ndarray
    start: np.ndarray

    def emission(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return segment_sums(self.weights[ids], offsets)

    def label_words(self, words: list[str], codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distribution over the languages of each word of the chains."""
        scores = self.emission(*features(words, self.lexicon)).astype(np.float64)
        return posteriors(scores[codes], first, self.transition, self.start)[0]


def fit(chains: list[list[tuple[str, str]]]) -> Field:
    """Maximum likelihood by Adam. chains: (word, language) of each word."""
    flat = [w for c in chains for w, _ in c]
    labels = sorted({x for c in chains for _, x in c})
    words = sorted(set(flat))
    at = {w: k for k, w in enumerate(words)}
    code = np.fromiter(map(at.__getitem__, flat), np.int64, len(flat))
    seen = np.zeros(len(words), np.int64)
    for c in chains:
        for w in {w for w, _ in c}:
            seen[at[w]] += 1
    lexicon = {w: k for k, w in enumerate(w for w in words if seen[at[w]] >= LEXICON_DOCS)}
    gold = np.fromiter((labels.index(x) for c in chains for _, x in c), np.int64, len(flat))
    first = np.zeros(len(flat), bool)
    first[np.concatenate([[0], np.cumsum([len(c) for c in chains])[:-1]]).astype(int)] = True
    ids, offsets = features(words, lexicon)
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    shape = ((1 << HASH_BITS) + len(lexicon), len(labels))
    w, move, start = np.zeros(shape), np.zeros((len(labels), len(labels))), np.zeros(len(labels))
    gold_rows = np.zeros((len(flat), len(labels)))
    gold_rows[np.arange(len(flat)), gold] = 1
    inner = np.flatnonzero(~first)
    seen_moves = np.zeros_like(move)
    np.add.at(seen_moves, (gold[inner - 1], gold[inner]), 1)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (w, move, start)]
    for k in range(1, STEPS + 1):
        scores = segment_sums(w[ids], offsets)[code]
        post, alpha, beta = posteriors(scores, first, move, start)
        diff = post - gold_rows
        word_diff = np.stack([np.bincount(code, diff[:, j], len(words)) for j in range(len(labels))], axis=1)
        grad_w = np.stack([np.bincount(ids, word_diff[owner, j], shape[0]) for j in range(len(labels))], axis=1)
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        pair = alpha[inner - 1][:, :, None] * np.exp(move - move.max())[None] * (e[inner] * beta[inner])[:, None, :]
        pair = (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        grads = [grad_w / len(flat) + RIDGE * w, (pair - seen_moves) / len(flat) + RIDGE * move, diff[first].sum(axis=0) / len(flat)]
        for p, g, s in zip((w, move, start), grads, state):
            s[0][:] = 0.9 * s[0] + 0.1 * g
            s[1][:] = 0.999 * s[1] + 0.001 * g * g
            p -= RATE * (s[0] / (1 - 0.9 ** k)) / (np.sqrt(s[1] / (1 - 0.999 ** k)) + 1e-8)
    return Field(labels, lexicon, w.astype(np.float32), move, start)


def sample(docs: DataFrame, train: Column, lang: str, doc_id: str, text: str, train_docs: int, train_words: int) -> list[tuple[str, list[str]]]:
    """(language, words) of about `train_docs` documents per language, chosen by hash, a run of `train_words` words of each."""
    labelled = docs.filter(train & F.col(lang).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang).count().collect()}            # a row for each language
    share = F.coalesce(*[F.when(F.col(lang) == k, F.lit(min(1.0, train_docs / n))) for k, n in counts.items()], F.lit(0.0))
    lot = F.pmod(F.xxhash64(F.lit("crf"), doc_id), F.lit(1 << 30)) / float(1 << 30)

    def runs(batches):
        for batch in batches:
            out = []
            for key, name, body in zip(batch.key, batch.lang, batch.text):
                words = [x for x in map(letters, body.split()) if x]
                begin = key % max(1, len(words) - train_words + 1)
                if words:
                    out.append((key, name, words[begin:begin + train_words]))
            yield pd.DataFrame(out, columns=["key", "lang", "words"])

    chosen = labelled.filter(lot < share).select(F.xxhash64(doc_id, text).alias("key"), F.col(lang).alias("lang"), whole(text).alias("text"))
    rows = chosen.mapInPandas(runs, "key bigint, lang string, words array<string>").collect()        # bounded by the two parameters
    return [(r.lang, list(r.words)) for r in sorted(rows, key=lambda r: (r.key, r.lang))]


def train_field(docs: DataFrame, train: Column, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", train_docs: int = TRAIN_DOCS,
                train_words: int = TRAIN_WORDS) -> Field | None:
    """Field fitted on rows for which `train` holds; None without such rows."""
    runs = sample(docs, train, lang, doc_id, text, train_docs, train_words)
    chains = [[(w, name) for name, words in runs[k:k + 3] for w in words] for k in range(0, len(runs), 3)]
    return fit(chains) if chains else None


def predict(docs: DataFrame, field: Field | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of `docs` (all by default) with lang_pred (string) and score (double): the mean share of the
    language over the words."""
    keep = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]
    if field is None:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def label(batches):
        for batch in batches:
            texts = batch.column(at)
            for a, b in slices(texts, 2_000_000):
                codes, words, offsets = coded_words(texts.slice(a, b - a))
                plain = [letters(w) for w in words.to_pylist()]
                full = np.fromiter(map(bool, plain), bool, len(plain))
                use = full[codes]
                offsets = np.concatenate([[0], np.cumsum(use)])[offsets]
                codes = codes[use]
                means = np.zeros((b - a, len(field.labels)))
                n = np.diff(offsets)
                if len(codes):
                    first = np.zeros(len(codes), bool)
                    first[offsets[:-1][n > 0]] = True
                    means = segment_sums(field.label_words(plain, codes, first), offsets) / np.maximum(n, 1)[:, None]
                best = means.argmax(axis=1)
                name = [field.labels[k] if m else UNKNOWN for k, m in zip(best, n)]
                score = np.where(n > 0, np.minimum(means[np.arange(b - a), best], 1.0), 0.0)
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:len(keep)], pa.array(name, pa.string()), pa.array(score)], names=out_names)
        free_memory()

    out_names = [*keep, "lang_pred", "score"]
    at = keep.index(text) if text in keep else len(keep)
    given = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text in keep else [whole(text).alias("_text")]))
    schema = StructType([docs.schema[c] for c in keep]).add("lang_pred", StringType()).add("score", DoubleType())
    return given.mapInArrow(label, schema)
