"""Toxicity of documents by gradient-boosted trees over dense features, with isotonic calibration.

At most `train_rows` labelled rows teach. A lexicon is learned first: of the documents of those rows, how much more often toxic ones have a word, or a word that
begins with some stem. Features then describe a text: density, number and strength of lexicon words and stems, how many stand
near a second-person pronoun, capitals, punctuation, obfuscated spellings (letters replaced by signs, split by dots) and
those among them that spell a lexicon word. Trees are fitted by Spark on the training rows outside the calibration part (a
fifth by hash), and scores are calibrated on that part.

Defined cases: a null text is empty and gets a score like any other; rows without label, or with a label other than 0 and 1,
teach nothing; without both labels every score is the share of label 1 (0 without labels); rows with equal or null ids each
give a row (labels meet ids by equality, so a null id has none); a label that is given twice counts twice; an empty table
gives an empty result; columns other than those named are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, functions as F

from .common import coded_words, segment_sums, slices, stored, whole

# forms of address in the languages of the corpus
SECOND_PERSON = set("""you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre
vos usted ustedes ti tú tu tus vosotros os vuestro""".split())
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i"})
STEMS = (4, 5, 6)
LEXICON_SIZE, MIN_DOCS, MIN_ODDS = 4_000, 5, 1.0
NEAR = 4                              # words on either side of a pronoun
NAMES = ("word_density", "word_count", "word_most", "stem_density", "stem_count", "stem_most", "near_person", "capitals", "shouted",
         "marks", "repeated_marks", "obfuscated", "obfuscated_hits", "length", "variety")
TREES, DEPTH = 30, 3
TRAIN_ROWS = 20_000                   # labelled rows that teach, chosen by hash where there are more


def plain(word: str) -> tuple[str, bool]:
    """(the letters that a word spells in lower case, whether it hides them)."""
    core = word.strip(".,;:!?\"'()[]{}<>-*#&%").lower()
    if core.isalpha() or not any(c.isalpha() for c in core):
        return (core if core.isalpha() else "", False)
    spelled = "".join(c for c in core.translate(SIGNS) if c.isalpha())
    return spelled, len(spelled) >= 3


def keys_of(word: str) -> list[str]:
    """A word and its beginnings, as entries of the lexicon."""
    return ["=" + word, *["^" + word[:n] for n in STEMS if len(word) > n]]


def learn_lexicon(train: DataFrame) -> dict[str, float]:
    """Log-odds of the strongest entries; `train` has text and label. Documents are counted over all its rows."""
    def count(batches):
        for batch in batches:
            for a, b in slices(batch.column(0), 6_000_000):
                codes, words, offsets = coded_words(batch.column(0).slice(a, b - a))
                toxic = batch.column(1).slice(a, b - a).to_numpy(zero_copy_only=False).astype(bool)
                number, lists = {}, []
                for w in words.to_pylist():
                    core = plain(w)[0]
                    lists.append([number.setdefault(k, len(number)) for k in (keys_of(core) if len(core) > 2 else [])])
                if not number:
                    continue
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((k for x in lists for k in x), np.int64, int(size.sum()))
                pair = np.unique(np.repeat(np.arange(b - a), np.diff(offsets)) * len(words) + codes)       # words of a document, once
                doc, word = pair // len(words), pair % len(words)
                begin = np.cumsum(size) - size
                at = np.repeat(begin[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(size[word].sum())
                both = np.unique(np.repeat(doc, size[word]) * len(number) + flat[at])
                key, hit = both % len(number), toxic[both // len(number)]
                yes = np.bincount(key[hit], minlength=len(number))
                all_ = np.bincount(key, minlength=len(number))
                yield pa.RecordBatch.from_arrays([pa.array(list(number)), pa.array(yes), pa.array(all_ - yes)], ["key", "yes", "no"])

    counts = train.select(whole("text").alias("text"), (F.col("label") == 1).alias("toxic")).mapInArrow(count, "key string, yes bigint, no bigint")
    n = train.agg(F.sum((F.col("label") == 1).cast("int")).alias("y"), F.count(F.lit(1)).alias("n")).first()
    base = np.log((n.y + 1) / (n.n - n.y + 1))
    summed = counts.groupBy("key").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")).filter(F.col("yes") >= MIN_DOCS)
    odds = F.log((F.col("yes") + 0.5) / (F.col("no") + 0.5)) - float(base)
    strong = summed.withColumn("odds", odds).filter(F.col("odds") >= MIN_ODDS)
    rows = strong.orderBy((F.col("odds") * F.sqrt("yes")).desc(), "key").limit(LEXICON_SIZE).collect()       # at most LEXICON_SIZE
    return {r.key: float(r.odds) for r in rows}


def _describe(texts: pa.Array, lexicon: dict[str, float]) -> np.ndarray:
    codes, words, offsets = coded_words(texts)
    listed = words.to_pylist()
    spelled = [plain(w) for w in listed]
    word_odds = np.fromiter((lexicon.get("=" + w, 0.0) for w, _ in spelled), float, len(listed))
    stem_odds = np.fromiter((max([lexicon.get("^" + w[:n], 0.0) for n in STEMS if len(w) > n] or [0.0]) for w, _ in spelled), float, len(listed))
    hidden = np.fromiter((h for _, h in spelled), bool, len(listed))
    person = np.fromiter((w in SECOND_PERSON for w, _ in spelled), bool, len(listed))
    upper = np.fromiter((sum(map(str.isupper, w)) if not w.islower() else 0 for w in listed), np.int64, len(listed))
    letter = np.fromiter((len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in listed), np.int64, len(listed))
    mark = np.fromiter((0 if w.isalpha() else sum(c in "!?*#$%&@" for c in w) for w in listed), np.int64, len(listed))
    double = np.fromiter(("!!" in w or "??" in w or "***" in w or "###" in w for w in listed), bool, len(listed))
    n = np.diff(offsets)
    total = lambda x: segment_sums(x[codes].astype(float), offsets)                     # noqa: E731
    safe = np.maximum(n, 1)

    def most(x):
        out = np.zeros(len(n))
        if (n > 0).any():
            out[n > 0] = np.maximum.reduceat(x[codes], offsets[:-1][n > 0])
        return out

    owner = np.repeat(np.arange(len(n)), n)
    around = np.zeros(len(codes), bool)
    at = np.flatnonzero(person[codes])
    for k in range(-NEAR, NEAR + 1):
        to = at + k
        fine = (to >= 0) & (to < len(codes))
        fine[fine] = owner[to[fine]] == owner[at[fine]]
        around[to[fine]] = True
    hit = np.maximum(word_odds, stem_odds)[codes] > 0
    near = np.bincount(owner[hit & around], minlength=len(n)).astype(float)
    pair = np.unique(owner * max(len(listed), 1) + codes)
    kinds = np.bincount(pair // max(len(listed), 1), minlength=len(n))
    letters = np.maximum(total(letter), 1)
    return np.column_stack([
        total(word_odds) / safe, np.log1p(total(word_odds > 0)), most(word_odds), total(stem_odds) / safe, np.log1p(total(stem_odds > 0)), most(stem_odds),
        np.log1p(near), total(upper) / letters, total((upper == letter) & (letter > 2)) / safe, total(mark) / safe, total(double) / safe,
        total(hidden) / safe, np.log1p(total(hidden & ((word_odds > 0) | (stem_odds > 0)))), np.log1p(n), kinds / safe])


def describe(docs: DataFrame, lexicon: dict[str, float], doc_id: str, text: str) -> DataFrame:
    """(doc_id, features) of every document."""
    def rows(batches):
        for batch in batches:
            for a, b in slices(batch.column(1), 6_000_000):
                x = _describe(batch.column(1).slice(a, b - a), lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], ["doc_id", "features"])

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), whole(text).alias("text")).mapInArrow(rows, "doc_id bigint, features array<double>")


def teaching_rows(labels: DataFrame, train, label: str, doc_id: str, most: int) -> DataFrame:
    """(doc_id, label) of at most `most` rows with label 0 or 1 for which `train` holds, the first by a hash of the id."""
    known = labels.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("label")) \
        .filter(F.col("label").isin(0, 1) & train(F.col("doc_id")))
    lot = F.pmod(F.xxhash64(F.lit("toxicity"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, 1.2 * most / max(known.count(), 1))
    return stored(known.withColumn("_lot", lot).filter(F.col("_lot") <= share).orderBy("_lot", "doc_id", "label").limit(most).drop("_lot"))


def score(docs: DataFrame, labels: DataFrame, train, label: str = "toxic", threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text",
          train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, score, predicted) of every document. train: function of the id column that tells which labelled rows may teach."""
    # train_rows rows at most, so they go to the texts and not the texts to them
    known = F.broadcast(teaching_rows(labels, train, label, doc_id, train_rows))
    texts = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    shares = known.join(texts.select("doc_id"), "doc_id").agg(F.sum("label").alias("y"), F.count(F.lit(1)).alias("n")).first()
    if not shares.n or shares.y in (0, shares.n):
        value = float(shares.y or 0) / max(shares.n, 1)
        return texts.select("doc_id", F.lit(value).alias("score"), F.lit(int(value >= threshold)).alias("predicted"))
    lexicon = learn_lexicon(stored(texts.join(known, "doc_id").select("text", "label")))
    facts = stored(describe(docs, lexicon, doc_id, text))
    taught = facts.join(known, "doc_id").select("doc_id", array_to_vector("features").alias("features"), F.col("label").cast("double").alias("label"))
    aside = F.pmod(F.xxhash64(F.lit("calibration"), "doc_id"), F.lit(5)) == 0
    fit_on = taught.filter(~aside)
    if fit_on.select("label").distinct().count() < 2:
        fit_on = taught
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=5, seed=1, maxBins=64).fit(stored(fit_on))
    raw = lambda d: trees.transform(d).withColumn("raw", vector_to_array("rawPrediction")[1])       # noqa: E731
    held = raw(taught.filter(aside)).select("raw", "label")
    if held.isEmpty():
        held = raw(taught).select("raw", "label")
    steps = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="step").fit(held)
    out = steps.transform(raw(facts.select("doc_id", array_to_vector("features").alias("features"))))
    value = F.least(F.greatest(F.col("step"), F.lit(0.0)), F.lit(1.0))
    return out.select("doc_id", value.alias("score"), (value >= threshold).cast("int").alias("predicted"))
