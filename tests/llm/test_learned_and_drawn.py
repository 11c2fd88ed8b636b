"""Conversation repair, language-model scores and importance resampling against plain versions, and their defined edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from karyoloom.llm import conversation_repair as repairs, hashed_maxent as lm, importance_resampling as drawn

LONG = " ".join(f"wort{k % 977} the of" for k in range(20_000))
TEXTS = [(1, "the cat sat on the mat"), (2, None), (3, ""), (4, " \t\n "), (5, LONG), (6, "Der Zug fährt. 12 ÄÖ"), (6, "Der Zug fährt. 12 ÄÖ"), (None, "a b c"), (7, "x" * 300_000),
         *[(k, " ".join(f"w{(k * j) % 37}" for j in range(25))) for k in range(8, 60)]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1.0, "r", 5, "n") for i, t in TEXTS], "doc_id bigint, text string, score double, _row string, rank int, n_words string").repartition(3).cache()


# ---------------------------------------------------------------- conversation repair

def cheapest(codes):
    """Plain recursion from the back, with the edits as strings."""
    after = [(0, ""), (6, "II"), (3, "I"), (0, "")]
    for code in reversed(codes):
        fault, initial = divmod(code, 4)
        now = []
        for q in range(4):
            options = [(after[q][0] + 4, "D" + after[q][1])]
            if fault < 2:
                kept = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}.get((q, initial))
                if kept:
                    options.append((after[kept][0] + 3 * fault, "K" + after[kept][1]))
                to = 3 if q == 2 else 2
                options.append((after[to][0] + 3 + 3 * fault, "R" + after[to][1]))
            now.append(min(options))
        for _ in range(3):
            now = [min(now[q], (now[3 if q == 2 else 2][0] + 3, "I" + now[3 if q == 2 else 2][1])) for q in range(4)]
        after = now
    return after[0]


def test_auction_equals_recursion():
    r = random.Random(7)
    for _ in range(1500):
        codes = bytes(r.randrange(16) for _ in range(r.randrange(40)))
        assert repairs.solve(codes) == cheapest(codes)
    codes = bytes(r.choice([1, 2, 1, 2, 3, 5, 13]) for _ in range(3000))
    assert repairs.solve(codes) == cheapest(codes)


def test_auction_is_linear_in_the_rows():
    calls = []
    for n in (2_000, 8_000):
        lattice_arcs, count = repairs.Lattice.arcs, [0]

        def counted(self, node):
            count[0] += 1
            return lattice_arcs(self, node)
        repairs.Lattice.arcs = counted
        try:
            repairs.solve(bytes([1]) * n)
        finally:
            repairs.Lattice.arcs = lattice_arcs
        calls.append(count[0])
    assert calls[1] < 5 * calls[0]


def plain_repair(rows):
    """The report of one conversation whose rows are in order."""
    seen, codes = set(), []
    for turn, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = 3 if not end else 2 if (role, text) in seen else 0 if end[-1] in ".!?" else 1
        seen.add((role, text))
        codes.append(4 * fault + ("sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3))
    cost, audit = cheapest(codes)
    lines, state, k = [], "", 0
    for e in audit:
        asked = "assistant" if state == "u" else "user"
        if e == "I":
            lines.append(asked + ":")
        elif e != "D":
            lines.append((rows[k][1] if e == "K" else asked) + ":" + rows[k][2])
        if e != "D":
            state = lines[-1][0]
        k += e != "I"
    turns = {t for t, *_ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, sum(c >= 12 for c in codes), sum(8 <= c < 12 for c in codes), sum(4 <= c < 8 for c in codes),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


@pytest.mark.parametrize("records", [3, 10_000])
def test_repair_equals_plain_version(spark, records):
    r = random.Random(3)
    rows = []
    for conv in [None, *range(25)]:
        n = 400 if conv == 3 else r.randrange(1, 9)                # one conversation holds most of the rows
        for k in range(n):
            turn = None if k == 0 and conv in (None, 4) else k + (k > 5)
            rows.append((conv, turn, r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(["Yes. ", "no", "", "\n", None, f"t{k}?", f"u{k}!"]), "x", 1))
    # copies of a row are duplicates of it
    rows += [rows[5]] * 7
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, _at int").repartition(4)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(records))
    try:
        report, turns = repairs.repair(frame)
        got = {x.conv_id: tuple(x)[1:] for x in report.collect()}
        n_turns = turns.count()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    # rows of equal turn are copies here, so the order of (turn, role, text) is the defined one
    own = {}
    for conv, turn, role, text, *_ in rows:
        own.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert n_turns == len(rows)
    assert got == {c: plain_repair(sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))) for c, v in own.items()}


def test_repair_of_nothing(spark):
    report, turns = repairs.repair(spark.createDataFrame([], "conv_id string, turn int, role string, text string"))
    assert report.count() == 0 and turns.count() == 0


# ---------------------------------------------------------------- importance resampling

def plain_words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def runs(words, most):
    return [" ".join(words[k:k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


@pytest.mark.parametrize("most", [1, 2])
def test_resampling_equals_plain_version(spark, docs, most):
    target = [("the cat sat",), (None,), ("w3 w5 w7 Zug",)]
    got = drawn.resample(docs, spark.createDataFrame(target, "text string"), (30, 100), 20, 5, 97, most, keep=["doc_id", "_row"])
    assert got.columns == ["doc_id", "_row", "n_words", "n_features", "weight", "score", "rank"]
    bucket = lambda f: zlib.crc32(f.encode()) % 97                  # noqa: E731
    count = lambda texts: Counter(bucket(f) for t in texts for f in runs(plain_words(t), most))            # noqa: E731
    s, t = count(x for _, x in TEXTS), count(x for x, in target)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 97) / ((s[b] + 1) * (t.total() + 97)))) for b in range(97)}
    want = []
    for i, text in TEXTS:
        f = runs(plain_words(text), most)
        h = int(hashlib.sha256(f"5:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[bucket(x)] for x in f)
        want.append([i, len(plain_words(text)), len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), None])
    able = sorted((x for x in want if x[1] >= 20), key=lambda x: (-x[4], x[0]))
    for k, x in enumerate(able[:len(able) * 30 // 100]):
        x[5] = k + 1
    assert sorted(map(repr, ((x.doc_id, x.n_words, x.n_features, x.weight, x.score, x.rank) for x in got.collect()))) == sorted(repr(tuple(x)) for x in want)


def test_ranks_of_ties_and_repeated_rows(spark):
    scored = spark.range(5000).select((F.col("id") % 3).alias("score"), F.when(F.col("id") % 50 > 0, F.col("id") % 700).alias("_key"), F.lit(1).alias("other")).repartition(7)
    got = drawn.rank_highest(scored, 1234, 5000).collect()
    assert sorted(x["rank"] for x in got if x["rank"]) == list(range(1, 1235)) and len(got) == 5000
    key = lambda x: (-x["score"], x["_key"] is None, x["_key"] or 0)            # noqa: E731
    in_order = sorted((x for x in got if x["rank"]), key=lambda x: x["rank"])
    assert [key(x) for x in in_order] == sorted(map(key, got))[:1234]


def test_resampling_of_nothing(spark, docs):
    empty = docs.limit(0)
    assert drawn.resample(empty, docs.select("text")).count() == 0
    got = drawn.resample(docs, empty.select("text"), keep=["doc_id"])
    assert got.count() == len(TEXTS) and got.filter("rank = 1").count() == 1


# ---------------------------------------------------------------- language-model scores

def lm_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x20\x09-\x0D]+", low) + [lm.END]


def test_base_scores_equal_plain_version(spark, docs, monkeypatch):
    monkeypatch.setattr(lm, "MOST_LOOKUP", 20)                      # most tokens are told by the join
    learn = F.col("doc_id").isNotNull() & (F.col("doc_id") % 5 != 0)
    got = {(x.doc_id, x.n_tokens): x for x in lm.score_corpus(docs, learn, F.col("doc_id")).collect()}
    counts = Counter(w for i, t in TEXTS if i is not None and i % 5 for w in lm_words(t))
    n, v = counts.total(), len(counts)
    for i, t in TEXTS:
        words = lm_words(t)
        row = got[i, len(words)]
        assert (row.n_known, row.train_tokens) == (sum(w in counts for w in words), n)
        assert row.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert row.score < 0


def toy(heads=40):
    r = np.random.default_rng(1)
    n = np.sort(r.integers(5, 500, heads))[::-1].copy()
    words = pa.array([f"w{k}" for k in range(heads - 1)] + [lm.END])
    group = r.integers(0, lm.GROUPS, heads)
    slot = np.array([int((group[:k] == group[k]).sum()) for k in range(heads)])
    return lm.Vocabulary(words, n, int(n.sum()) + 1000, heads + 100, np.full(lm.SHAPES, 62.5), np.full(lm.SHAPES, 6.25), group, np.minimum(slot, lm.SLOTS - 1))


def test_probabilities_sum_to_one_and_gradients_are_right():
    v = toy()
    model = lm.Maxent(v)
    r = np.random.default_rng(2)
    model.rows[:], model.inner[:] = r.normal(0, 0.3, model.rows.shape), r.normal(0, 0.3, model.inner.shape)
    # after one context: all heads, and each class by last characters with its own tokens and one unseen token
    context = "w3 w1"
    texts = pa.array([f"{context} {w}" if w else context for w in v.words.to_pylist()])
    c = model.coded(lm.tokens_of(texts))
    third = c.offsets[:-1] + 2
    heads = np.exp(lm.log_probabilities(model, c))[third].sum()
    logits, _ = model.class_logits(c, int(third[0]), int(third[0]) + 1)
    shapes = np.exp(logits[0] - np.log(np.exp(logits[0]).sum()))[lm.GROUPS:].sum()
    used = np.isin(np.arange(lm.GROUPS), v.group)
    empty = np.exp(logits[0] - np.log(np.exp(logits[0]).sum()))[:lm.GROUPS][~used].sum()
    assert heads + shapes + empty == pytest.approx(1, abs=1e-3)
    # gradient of the class factor against differences
    hit = [f[0] for f in c.features(int(third[0]), int(third[0]) + 1)]
    for col in (0, 5, 20):
        def loss():
            z, _ = model.class_logits(c, int(third[0]), int(third[0]) + 1)
            return float(np.log(np.exp(z[0].astype(np.float64)).sum()) - z[0, c.cls[third[0]]])
        p = lm._softmax(model.class_logits(c, int(third[0]), int(third[0]) + 1)[0])
        want = p[0, col] - (c.cls[third[0]] == col)
        old, base = model.rows[hit[0], col], loss()
        model.rows[hit[0], col] = old + 1e-2
        assert (loss() - base) / 1e-2 == pytest.approx(want, abs=2e-2)
        model.rows[hit[0], col] = old


def test_model_learns_what_follows(spark):
    # two languages of 30 words; the next word is of the language of the words before
    r = random.Random(5)
    rows = [(k, " ".join(f"{'ab'[k % 2]}{int(r.random() ** 2 * 30)}" for _ in range(60))) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = lm.score_corpus(docs, F.col("doc_id") % 10 != 0, F.col("doc_id"), keep=["doc_id"]).filter("doc_id % 10 = 0").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.15 * got[2]                          # at most log10(2) = 0.3 a token is to be won


def test_scores_without_training_documents(spark, docs):
    got = lm.score_corpus(docs, F.lit(False), F.lit(0), keep=["doc_id"]).collect()
    assert len(got) == len(TEXTS) and all(x.train_tokens == 0 and x.n_known == 0 for x in got)
    assert lm.score_corpus(docs.limit(0), F.lit(True), F.lit(0)).count() == 0


def test_gradient_sums_of_runs_are_exact():
    """Runs of one to forty gradients, sums equal to the last bit; a step moves every row by the sum of its gradients."""
    rng = np.random.default_rng(4)
    n = np.sort(rng.integers(1, 41, 300) ** rng.integers(0, 2, 300))[::-1]
    n = np.concatenate([n[n > lm.FEW], n[n <= lm.FEW]])
    at, values = rng.integers(0, 500, n.sum()), rng.normal(0, 1, (500, 24)).astype(np.float32)
    first = np.cumsum(n) - n
    assert np.array_equal(lm._run_sums(values, at, first, n), np.add.reduceat(values[at], first, axis=0))
    for hit in (rng.integers(0, 60, 900), np.arange(900) % 900, np.zeros(900, np.int64)):
        steps = lm._Steps(np.zeros((1000, 16), np.float32), 0.5)
        gradient = rng.normal(0, 1, (300, 16)).astype(np.float32)
        steps.step(hit, gradient)
        total = np.zeros((1000, 16))
        np.add.at(total, hit, np.concatenate([gradient] * 3).astype(np.float64))
        assert np.allclose(steps.table, -0.5 * total / np.sqrt(1 + (total ** 2).sum(axis=1, keepdims=True)), atol=1e-5)
        assert np.array_equal(steps.met, np.bincount(hit, minlength=1000))


def test_shapes_and_largest_logits():
    words = ["", "a", "ab", "xab", "é", "né", "日本語", "😀x", "x😀", "a b"]
    assert lm.shapes_of(pa.array(words, pa.string())).tolist() == [lm.shape_of(w) for w in words]
    assert lm.shapes_of(pa.array([], pa.string())).tolist() == []
    for width in (1, 3, 16, 24):
        x = np.random.default_rng(width).normal(0, 1, (50, width)).astype(np.float32)
        assert np.array_equal(lm._top(x), x.max(axis=1, keepdims=True))
