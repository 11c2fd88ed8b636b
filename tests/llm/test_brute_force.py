"""Operators against plain Python on the smallest tables."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from karyoloom.llm import crf_language, disclosure, latent_decontam, lookup_shards, mixing, projection_dedup, queries, token_store, toxicity, vantage_simhash

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").collect()


def ran(spark, name):
    return queries.QUERIES[name](spark, FOLDER).collect()


class Groups:
    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def test_token_store(spark, rows):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    want, start = {}, 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, queries.END_ID]
        want[r.doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in ran(spark, "op1_token_store")} == want


def test_encoder_equals_the_tokenizer():
    import pyarrow as pa
    texts = ["It's a dog's 123 can't", "İstanbul ΣΑΣ ǅ", "a\x0bb\x0cc d e\x85f\x1cg", "é x́ K Å <|endoftext|>x", "日本語 テスト 🎉🎉", "ª µ ß ẞ", "", " x.,. y"]
    encoder = token_store.Encoder(queries.TOKENIZER)
    ids, ends = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_of_another_tokenizer_reads_whole_texts():
    import public_tokenizers
    import pyarrow as pa
    encoder = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_word and token_store.Encoder(queries.TOKENIZER).by_word
    texts = ["It's a dog's 123  can't\n\n x", None, "", "İstanbul\tΣΑΣ", " a  b "]
    ids, ends = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_encoder_forgets_words(monkeypatch):
    import pyarrow as pa
    monkeypatch.setattr(token_store, "MEMO_WORDS", 3)
    encoder = token_store.Encoder(queries.TOKENIZER)
    for text in ["Zug Zug, zug. fährt", "Der Zug fährt 12", "a b c d e f", "Zug, zug"]:
        assert encoder.encode(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_learns_a_stem_once():
    import pyarrow as pa
    encoder, texts = token_store.Encoder(queries.TOKENIZER), ["Zug zug, ZUG. zug", "zUg Ñandú ñandú, ÑANDÚ.", "Zug., x1 Ⱥb ⱥb,"]
    ids, ends = encoder.encode(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k]:ends[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    assert {"zug", "ñandú"} < set(encoder.places) and not {"Zug", "zug,", "ZUG.", "ÑANDÚ."} & set(encoder.places)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(-2**62, 2**62, 5_000))
    levels = token_store._levels(keys)
    slots = token_store._slots(levels, keys)
    assert sorted(slots) == list(range(len(keys)))


def test_lookup_table(spark, rows):
    shards, size = ["a", "b", "c", "d", "e"], 211
    order = []
    for s in shards:
        h = lambda what: int.from_bytes(hashlib.sha256(f"{what}:{s}".encode()).digest()[:8], "big")          # noqa: B023, E731
        order.append(iter([(h("offset") + k * (h("skip") % (size - 1) + 1)) % size for k in range(size)]))
    table = [None] * size
    for turn in itertools.cycle(range(len(shards))):
        if None not in table:
            break
        table[next(k for k in order[turn] if table[k] is None)] = turn
    assert lookup_shards.fill_table(shards, size).tolist() == table
    full = lookup_shards.fill_table(queries.SHARDS)
    got = {r.doc_id: (r.slot, r.shard) for r in ran(spark, "op2_lookup_shards")}
    for r in rows:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % len(full)
        assert got[r.doc_id] == (slot, queries.SHARDS[full[slot]])


def test_forward_backward():
    rng = np.random.default_rng(1)
    n, labels, starts = 300, 3, [0, 5, 6, 200, 300]
    e, move, start = rng.normal(size=(n, labels)), rng.normal(size=(labels, labels)), rng.normal(size=labels)
    first = np.isin(np.arange(n), starts)
    got = crf_language.posteriors(e, first, move, start)[0]
    for a, b in zip(starts, starts[1:]):
        fwd = [np.exp(start + e[a])]
        for t in range(a + 1, b):
            fwd.append((fwd[-1] / fwd[-1].sum()) @ np.exp(move) * np.exp(e[t]))
        bwd = [np.ones(labels)]
        for t in range(b - 1, a, -1):
            bwd.append(np.exp(move) @ (np.exp(e[t]) * bwd[-1] / bwd[-1].sum()))
        want = np.array(fwd) * np.array(bwd[::-1])
        assert np.allclose(got[a:b], want / want.sum(axis=1, keepdims=True))


def test_language_held_out_and_switched(spark, rows):
    lang = {r.doc_id: r.lang for r in rows}
    held = [r for r in ran(spark, "op3_crf_language") if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(lang[r.doc_id] == r.lang_pred for r in held) >= 0.98 * len(held)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    field = crf_language.train_field(docs, F.lit(True))
    mixed = [next(r.text for r in rows if r.lang == x and r.n_chars > 400).split()[:40] for x in ("en", "de")]
    words = [crf_language.letters(w) for w in mixed[0] + mixed[1]]
    names = sorted(set(words) - {""})
    at = {w: k for k, w in enumerate(names)}
    codes = np.array([at[w] for w in words if w])
    first = np.arange(len(codes)) == 0
    best = [field.labels[k] for k in field.label_words(names, codes, first).argmax(axis=1)]
    want = ["en"] * sum(map(bool, words[:40])) + ["de"] * sum(map(bool, words[40:]))
    assert sum(a == b for a, b in zip(best, want)) >= 0.9 * len(want)


def test_mix(spark, rows):
    got = {r.doc_id: r for r in ran(spark, "op4_source_mix")}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    total, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        total[r.source] += size[r.doc_id]
        taken[r.source] += got[r.doc_id].taken
        assert got[r.doc_id].taken <= 3 * size[r.doc_id] and got[r.doc_id]["size"] == size[r.doc_id]
    goal = mixing.targets(total)
    for r in rows:
        assert got[r.doc_id].source_size == total[r.source] and got[r.doc_id].target == pytest.approx(float(goal[r.source]))
    assert all(abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 64 for s in total)
    assert got == {r.doc_id: r for r in ran(spark, "op4_source_mix")}


def test_targets_stop_at_three_times():
    goal = mixing.targets({"a": 10, "b": 1_000, None: 90}, (5, 2, 1))
    assert goal["a"] == 30 and goal[None] == 270 and goal["b"] == 800


def test_permutations():
    for n in (1, 2, 7, 100):
        x = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, np.uint64))
        assert sorted(x) == list(range(n))


def test_shard_draws_meet_totals():
    slots, even = np.array([50, 7, 0, 43]), np.full(10, 10)
    made = [mixing.shard_counts(slots, even, k, 3) for k in range(10)]
    assert (sum(c for c, _ in made) == slots).all() and all(c.sum() == 10 for c, _ in made)
    assert all((made[k][1] == sum(c for c, _ in made[:k])).all() for k in range(1, 10))


def test_leaks(spark, rows):
    plain = lambda t: [w.strip(latent_decontam.EDGES).lower() for w in t.split()]                # noqa: E731
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()}
    want = set()
    for r in rows:
        text = f" {' '.join(plain(r.text))} "
        want |= {(r.doc_id, i) for i, w in items.items() if f" {' '.join(w)} " in text}
    got = {(r.doc_id, r.item_id) for r in ran(spark, "op5_latent_decontam")}
    assert want and want <= got and len(got - want) <= 0.02 * len(rows)


def test_paraphrased_leaks(spark, rows):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    rng = np.random.default_rng(3)
    made, clean = [], [r for r in rows if r.lang == "en"][:200]
    other = [w for r in clean for w in r.text.split()]
    for k, r in enumerate(benchmark.collect()):
        words = r.text.split()
        if len(words) >= 24:
            for j in rng.choice(len(words), len(words) // 5, replace=False):
                words[j] = other[rng.integers(len(other))]
            filler = [other[j] for j in rng.integers(len(other), size=200)]
            made.append((10_000 + k, " ".join(filler[:100] + words + filler[100:])))
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in rows] + made, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id for r in latent_decontam.leaks(docs, benchmark).collect()}
    assert sum(i in got for i, _ in made) >= 0.9 * len(made)


def test_leaks_of_a_large_benchmark(spark):
    """1,200 items of 10 to 1,000 words against every run of half-windows of every document."""
    rng = np.random.default_rng(5)
    odds = 1 / (np.arange(9_000) + 20)
    draw = lambda n: [f"w{k}" for k in rng.choice(9_000, n, p=odds / odds.sum())]                # noqa: E731
    lengths = np.exp(rng.uniform(np.log(10), np.log(1_000), 1_200)).astype(int)
    benchmark = [(k, draw(n)) for k, n in enumerate(lengths)]
    texts, planted = [], set()
    for k in range(150):
        words = benchmark[8 * k][1]
        if k % 3 == 2:                              # a paraphrase: every sixth word is another
            words = [draw(1)[0] if j % 6 == 0 else w for j, w in enumerate(words)]
        texts.append(draw(60 + k) + words + draw(90))
        planted |= {(k, 8 * k)} if k % 3 < 2 else set()
    texts += [draw(400) for _ in range(50)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string").repartition(3)
    table = spark.createDataFrame([(k, " ".join(t)) for k, t in benchmark], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.share for r in latent_decontam.leaks(docs, table).collect()}
    assert planted <= set(got)
    items = latent_decontam.Items([type("R", (), {"item": k, "text": " ".join(t)}) for k, t in benchmark])
    weight = latent_decontam.weights(items, *latent_decontam.passages_with(docs, items), latent_decontam.STOP_SHARE, latent_decontam.MIN_TERMS)
    at = {w: k for k, w in enumerate(items.vocabulary)}
    want = {}
    for d, t in enumerate(texts):
        codes = np.array([at.get(w, -1) for w in t])
        body = [x[(x >= 0) & (weight[x] > 0)] for x in np.split(codes, range(items.half, len(codes), items.half))]
        have = np.isin(np.arange(len(weight)), np.concatenate(body))
        for i, x in enumerate(items.terms):
            length, x = 2 + 2 * -(-len(x) // items.half), x[weight[x] > 0]
            if weight[x[have[x]]].sum() < 0.45 * weight[x].sum():
                continue
            last = x[-max(1, len(x) // 4):]
            for h in range(max(1, len(body) - length + 1)):
                run = np.concatenate(body[h:h + length])
                share, answer = (latent_decontam.common_weight(y, run, weight) / weight[y].sum() for y in (x, last))
                if share >= 0.7 or (share >= 0.45 and answer >= 0.6):
                    want[d, i] = max(share, want.get((d, i), 0))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in got)


def test_toxicity_held_out(spark):
    scored = pd.DataFrame([r.asDict() for r in ran(spark, "op6_toxicity")])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").toPandas().merge(scored, on="doc_id")
    held = labels[labels.held_out]
    order = held.score.rank()
    yes, no = (held.toxic == 1).sum(), (held.toxic == 0).sum()
    auc = (order[held.toxic == 1].sum() - yes * (yes + 1) / 2) / (yes * no)
    assert auc > 0.75                        # 300 labelled rows teach it here


def spelled_plainly(word):
    core = word.strip(".,;:!?\"'()[]{}<>-*#&%").lower()
    if core.isalpha():
        return core, False
    if not any(c.isalpha() for c in core):
        return "", False
    signs = dict(zip("013457@$!|", "oieastasii"))
    letters = "".join(c for c in (signs.get(c, c) for c in core) if c.isalpha())
    return letters, len(letters) >= 3


def lexicon_counts(pairs):
    """Documents of either label that have each word (=) or beginning of a word (^), from (text, label)."""
    yes, no = defaultdict(int), defaultdict(int)
    for text, label in pairs:
        have = set()
        for w in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
            core = spelled_plainly(w)[0]
            if len(core) > 2:
                have |= {"=" + core} | {"^" + core[:n] for n in (4, 5, 6) if len(core) > n}
        for k in have:
            (yes if label == 1 else no)[k] += 1
    return yes, no


def features_of(text, lexicon):
    """The 15 features of a text, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, core = len(words), [spelled_plainly(w) for w in words]
    odds = [lexicon.get("=" + w, 0.0) for w, _ in core]
    stem = [max([lexicon.get("^" + w[:k], 0.0) for k in (4, 5, 6) if len(w) > k], default=0.0) for w, _ in core]
    hit = [a > 0 or b > 0 for a, b in zip(odds, stem)]
    person = [k for k, (w, _) in enumerate(core) if w in toxicity.SECOND_PERSON]
    near = sum(hit[k] and any(abs(k - p) <= 4 for p in person) for k in range(n))
    letters = [sum(c.isalpha() for c in w) for w in words]
    upper = [sum(c.isupper() for c in w) for w in words]
    mark = [sum(c in "!?*#$%&@" for c in w) for w in words]
    twice = [any(m in w for m in ("!!", "??", "***", "###")) for w in words]
    each = lambda x: sum(x) / max(n, 1)                                                           # noqa: E731
    return [each(odds), np.log1p(sum(x > 0 for x in odds)), max(odds, default=0), each(stem), np.log1p(sum(x > 0 for x in stem)), max(stem, default=0),
            np.log1p(near), sum(upper) / max(sum(letters), 1), each([u == m and m > 2 for u, m in zip(upper, letters)]), each(mark), each(twice),
            each([h for _, h in core]), np.log1p(sum(h and x for (_, h), x in zip(core, hit))), np.log1p(n), len(set(words)) / max(n, 1)]


HARSH = ["You are an IDIOT!! 1d10t, id!ot...", "", "...", "!!! ??? ***", "dich und Dein Haß-Dummkopf", "tú eres t0nt0 TONTO tontos", "a@b 12 x",
         "STOP stop STOP you", "İ ß ẞ ǅ Σ you", "idiots " * 40 + "your"]


def test_toxicity_lexicon_and_features(spark, rows):
    """Lexicon and features against counts word by word, over the labelled documents and some odd texts."""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    pairs = [(r.text, labels[r.doc_id]) for r in rows if labels.get(r.doc_id) in (0, 1)]
    pairs += [(t, k % 2) for k in range(24) for t in HARSH[k % 2::2]]
    got = toxicity.learn_lexicon(spark.createDataFrame(pairs, "text string, label int").repartition(5))
    yes, no = lexicon_counts(pairs)
    toxic = sum(x == 1 for _, x in pairs)
    base = np.log((toxic + 1) / (len(pairs) - toxic + 1))
    odds = {k: np.log((n + 0.5) / (no.get(k, 0) + 0.5)) - base for k, n in yes.items() if n >= toxicity.MIN_DOCS}
    strong = {k: v for k, v in odds.items() if v >= toxicity.MIN_ODDS}
    top = sorted(strong, key=lambda k: (-strong[k] * np.sqrt(yes[k]), k))[:toxicity.LEXICON_SIZE]
    assert got.keys() == set(top) and len(got) > 3 and all(abs(got[k] - strong[k]) < 1e-9 for k in got)
    texts = [*HARSH, None, *(r.text for r in rows[:400])]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    told = {r.doc_id: r.features for r in toxicity.describe(table, got, "doc_id", "text").collect()}
    assert len(told) == len(texts) and len(toxicity.NAMES) == len(told[0])
    for k, t in enumerate(texts):
        want = features_of(t, got)
        assert np.allclose(told[k], want, atol=1e-9), (t, [(a, b, c) for a, b, c in zip(toxicity.NAMES, told[k], want) if abs(b - c) > 1e-9])


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(150, 16))
    near = np.concatenate([base, base[:60] + rng.normal(scale=0.05, size=(60, 16)), base[:1] + rng.normal(scale=0.05, size=(200, 16)), base[5:6], base[5:6]])
    table = spark.createDataFrame([(int(k), [float(v) for v in x]) for k, x in enumerate(near)], "vec_id bigint, embedding array<double>")
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    groups = Groups(range(len(near)))
    for a, b in zip(*np.nonzero(link)):
        groups.join(int(a), int(b))
    got = {r.vec_id: r for r in projection_dedup.near_duplicates(table).collect()}
    assert all(got[k].n_links == link[k].sum() and got[k].component_id == groups.find(k) for k in got)
    small = {r.vec_id: r for r in projection_dedup.near_duplicates(table, block_rows=40).collect()}
    assert all(small[k].n_links <= link[k].sum() for k in small)
    assert sum(r.n_links for r in small.values()) >= 0.9 * link.sum()


def test_vectors_of_a_large_group(spark):
    """A group of 4,500 distinct near copies, wider than a window, against brute force."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = np.concatenate([base, base[:1] + rng.normal(scale=0.16, size=(4_500, 16)), base[1:100] + rng.normal(scale=0.05, size=(99, 16))])
    table = spark.createDataFrame([(int(k), x.tolist()) for k, x in enumerate(near)], "vec_id bigint, embedding array<double>")
    unit = near / np.linalg.norm(near, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.95
    np.fill_diagonal(link, False)
    want = {k: int(n) for k, n in enumerate(link.sum(axis=1))}
    assert max(want.values()) > 4_000
    assert {r.vec_id: r.n_links for r in projection_dedup.near_duplicates(table).collect()} == want
    small = {r.vec_id: r.n_links for r in projection_dedup.near_duplicates(table, block_rows=700).collect()}
    assert all(small[k] == want[k] for k in [0, *range(300, 4_800)])


def test_item_rows_equal_the_dense_matrix(monkeypatch):
    rng = np.random.default_rng(3)
    terms, weight = [rng.integers(0, 90, rng.integers(1, 30)) for _ in range(40)], rng.random(100)
    dense = np.zeros((40, 100))
    for i, x in enumerate(terms):
        np.add.at(dense[i], x, weight[x])
    dense /= np.linalg.norm(dense, axis=1, keepdims=True) * np.sqrt(40)
    own, x, y = latent_decontam.ItemRows(terms, weight), rng.random((100, 5)), rng.random((40, 5))
    for most in (latent_decontam.ENTRIES, 7):
        monkeypatch.setattr(latent_decontam, "ENTRIES", most)
        assert np.allclose(own.times(x), dense @ x, atol=1e-5) and np.allclose(own.transposed(y), dense.T @ y, atol=1e-5)


def test_item_rows_stay_small():
    """20,000 items of 38 words over 130,000 words: 10 GB as a dense matrix."""
    import tracemalloc
    rng = np.random.default_rng(4)
    terms = [rng.integers(0, 130_000, 38) for _ in range(20_000)]
    tracemalloc.start()
    own = latent_decontam.ItemRows(terms, rng.random(130_000))
    made = own.transposed(own.times(rng.standard_normal((130_000, 144)).astype(np.float32)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made.shape == (130_000, 144) and peak < 700e6, peak


def test_simhash(spark, rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").translate(low))
        parts = [" ".join(w[k:k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
        h = np.array([xxhash.xxh64_intdigest(p.encode(), 42) for p in parts], np.uint64)
        prints[r.doc_id] = sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))
    groups, ids = Groups(prints), sorted(prints)
    value = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(value[:k] ^ value[k]) <= 4):
            groups.join(i, ids[j])
    want = {i: (f"{prints[i]:016x}", groups.find(i)) for i in ids}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in ran(spark, "op8_vantage_simhash")} == want
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    split = vantage_simhash.near_duplicates(docs, sample=64, leaf_rows=40, home_rows=16, visit_rows=20).collect()
    assert {r.id: r.component_id for r in split} == {i: groups.find(i) for i in ids}


def shingle_set(text, n=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(low))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def jaccard_groups(texts, least=0.8):
    """Groups of the ids of `texts` by links of this similarity, and every link."""
    sets, groups, links = {i: shingle_set(t) for i, t in texts.items()}, Groups(texts), []
    having = defaultdict(list)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in having[s]:
                shared[j] += 1
            having[s].append(i)
        links += [(i, j) for j, n in shared.items() if n >= least * (len(sets[i]) + len(sets[j]) - n)]
    empty = [i for i in sorted(sets) if not sets[i]]
    for i, j in [*links, *zip(empty, empty[1:])]:
        groups.join(i, j)
    return groups, links


def changed(text, share, rng):
    """`text` with this share of its words replaced, one after another."""
    w = text.split()
    a, n = int(rng.integers(0, max(1, len(w) - int(len(w) * share)))), int(len(w) * share)
    return " ".join([*w[:a], *(f"new{k}x{rng.integers(1 << 30)}" for k in range(n)), *w[a + n:]])


def test_similar_documents(spark, rows):
    """Groups equal those of all pairs by the Jaccard similarity of whole texts, with one leaf and with many."""
    rng = np.random.default_rng(5)
    texts = {r.doc_id: r.text for r in rows}
    base = [t for t in texts.values() if t and len(t.split()) >= 60][:300]
    for k, t in enumerate(base):
        texts[1_000_000 + k] = changed(t, 0.02 + 0.12 * (k % 30) / 30, rng)
    for k in range(400):                                 # one group, far from any other text of the table
        texts[2_000_000 + k] = changed(" ".join(f"hot{m}" for m in range(300)), 0.04, rng)
    groups, links = jaccard_groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(8).cache()
    for leaf_rows in (100_000, 64):
        got = {r.id: r.component_id for r in vantage_simhash.similar_documents(docs, leaf_rows=leaf_rows).collect()}
        assert got.keys() == texts.keys()
        lost = sum(got[i] != got[j] for i, j in links)
        assert lost <= 0.002 * len(links), (leaf_rows, lost, len(links))
        assert not [i for i in texts if groups.find(got[i]) != groups.find(i)], leaf_rows      # nothing joins dissimilar texts
        kept = {r.doc_id for r in vantage_simhash.keep_similar(docs, leaf_rows=leaf_rows).collect()}
        assert kept == {i for i in got if got[i] == i}


def test_spanning_forest_of_unsure_pairs():
    rng = np.random.default_rng(2)
    u, v, far = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.integers(0, 9, 400)
    u, v, far = u[u != v], v[u != v], far[u != v]
    picked = vantage_simhash.forest(u, v, far, np.arange(60))
    want, weight = Groups(range(60)), 0
    for k in np.lexsort((v, u, far)):
        if want.find(int(u[k])) != want.find(int(v[k])):
            want.join(int(u[k]), int(v[k]))
            weight += int(far[k])
    got = Groups(range(60))
    for k in picked:
        got.join(int(u[k]), int(v[k]))
    assert [got.find(i) for i in range(60)] == [want.find(i) for i in range(60)]
    assert int(far[picked].sum()) == weight and len(picked) == 60 - len({want.find(i) for i in range(60)})


def test_no_unsure_pair_is_left_out():
    """All pairs up to the limit come back, those of no spanning forest and those that differ in one word most."""
    rng = np.random.default_rng(6)
    share = vantage_simhash.differing(0.8)
    sure, most = vantage_simhash.bounds(64 * vantage_simhash.WIDE, share)
    bits = rng.integers(0, 2, (1, 512)).astype(np.uint8).repeat(40, axis=0)
    for k in range(1, 40):
        at = rng.choice(512, int(rng.integers(10, 70)), replace=False) if k % 4 else rng.choice(64, 50, replace=False)
        bits[k, at] ^= 1
    fp = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    far = {(i, j): int((bits[i] != bits[j]).sum()) for i in range(40) for j in range(i + 1, 40)}
    label, u, v, first = vantage_simhash.near_pairs(fp, share)
    groups = Groups(range(40))
    for (i, j), d in far.items():
        if d <= sure:
            groups.join(i, j)
    assert all((label[i] == label[j]) == (groups.find(i) == groups.find(j)) for i, j in far)
    want = {p for p, d in far.items() if sure < d <= most and label[p[0]] != label[p[1]]}
    assert {(int(i), int(j)) for i, j in zip(u, v)} == want and len(u) == len(want)
    assert 0 < first.sum() < len(u) and any((bits[i, :64] != bits[j, :64]).sum() > 40 for i, j in want)


def test_link_that_no_forest_has(spark, monkeypatch):
    """Two groups stay linked when the pair of the forest fails the look at the texts and a farther one passes."""
    words = [f"w{k}" for k in range(120)]
    texts = {1: " ".join(words), 2: " ".join([*words[:114], *(f"x{k}" for k in range(6))])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    real = vantage_simhash.candidate_links
    kinds = lambda *a: real(*a).withColumn("kind", F.lit(vantage_simhash.REST))                          # noqa: E731
    monkeypatch.setattr(vantage_simhash, "candidate_links", kinds)
    assert {r.component_id for r in vantage_simhash.similar_documents(docs).collect()} == {1}


def test_unsure_pairs_give_a_row_for_each_document(spark, monkeypatch):
    """A group of near copies that no fingerprint is sure of: candidates grow with its documents, not with their pairs, and the
    pairs left after the forest are compared in parts of any size."""
    rng = np.random.default_rng(8)
    base = [[f"{c}{k}" for k in range(200)] for c in "ab"]
    texts = {k: changed(" ".join(base[k % 2]), 0.03, rng) for k in range(240)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    seen = []
    real = vantage_simhash.candidate_links
    monkeypatch.setattr(vantage_simhash, "candidate_links", lambda *a: seen.append(real(*a)) or seen[-1])
    groups, links = jaccard_groups(texts)
    for size in (vantage_simhash.SET_BYTES, 4_000):
        monkeypatch.setattr(vantage_simhash, "SET_BYTES", size)
        got = {r.id: r.component_id for r in vantage_simhash.similar_documents(docs).collect()}
        assert sum(got[i] != got[j] for i, j in links) <= 0.002 * len(links)
        assert not [i for i in texts if groups.find(got[i]) != groups.find(i)]
    kinds = {r.kind: r["count"] for r in seen[0].groupBy("kind").count().collect()}
    assert 0 < kinds[vantage_simhash.REST] and sum(kinds.values()) <= 4 * len(texts)


def test_pairs_between_groups_are_compared_on_their_sets():
    """Links join the groups that a similar pair joins, and no others."""
    rng = np.random.default_rng(9)
    share, pool = vantage_simhash.differing(0.8), rng.integers(0, 1 << 62, 90).astype(np.uint64)
    sets = [np.sort(rng.choice(pool[:45] if k % 3 else pool[40:], int(rng.integers(28, 42)), replace=False)) for k in range(60)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)
    fp, group = np.zeros((60, vantage_simhash.WIDE), np.uint64), np.arange(60) // 2 + 7
    u, v = vantage_simhash.similar_pairs(fp, group, np.concatenate(sets), offsets, share, 0.8)
    want, got = Groups(range(60)), Groups(range(60))
    for k in range(0, 60, 2):
        want.join(k, k + 1)
        got.join(k, k + 1)
    for i in range(60):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                want.join(i, j)
    for i, j in zip(u.tolist(), v.tolist()):
        got.join(i, j)
    assert len(u) < 30 and [got.find(i) == got.find(j) for i in range(60) for j in range(i)] == [want.find(i) == want.find(j) for i in range(60) for j in range(i)]
    assert 1 < len({want.find(i) for i in range(60)}) < 30
    fp[::2] = np.uint64(0xFFFFFFFFFFFFFFFF)                                  # rows too far apart by their fingerprints are no pair
    far = vantage_simhash.similar_pairs(fp[:2], np.arange(2), np.concatenate([sets[1], sets[1]]), np.array([0, len(sets[1]), 2 * len(sets[1])]), share, 0.8)
    assert len(far[0]) == 0
    assert vantage_simhash.crossing(fp[:4], np.array([1, 2, 1, 3]), share).tolist() == [1, 3]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        twice = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return True


def spans_of(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if holds(kind, m.group())]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_base_spans(spark, rows):
    got = {r.doc_id: r for r in ran(spark, "op9_disclosure")}
    for r in rows:
        want = spans_of(r.text or "")
        assert got[r.doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [s for s in got[r.doc_id].spans.split(",") if s and not s.startswith("term")] == [s for s in want.split(",") if s]
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0255", "4111 1111-1111 1111 4111111111111112", "+1 (456) 555-2186+49 30 1234567", "x@y z@w.v.",
           "é🎉 q@r.st", "9" * 5_000, "a" * 5_000 + "@b.c"]
    table = spark.createDataFrame(list(enumerate(odd)), "doc_id bigint, text string")
    for r in disclosure.sanitise(table).collect():
        pass
    got = {r.doc_id: r for r in disclosure.sanitise(table).select("doc_id", disclosure.digest(F.col("spans")).alias("d")).collect()}
    assert {k: got[k].d for k in got} == {k: spans_of(t) for k, t in enumerate(odd)}


def test_disclosing_terms(spark):
    said = [f"ask {'zorblatt' if k < 4 else 'somebody'} at {'ann@mail.example' if k < 4 else 'desk@other.example'} today" for k in range(12)]
    rest = [f"nothing said about number words here {k}" for k in range(100)] + ["zorblatt was seen again"]
    table = spark.createDataFrame([(k, t) for k, t in enumerate(said + rest)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in disclosure.sanitise(table, min_docs=3, min_bits=4.0, remove_share=0.9).collect()}
    # 4 of the 5 documents with the name have the address: disclosed, but below the share for removal
    assert got[0].text == "ask [TERM] at [EMAIL] today" and got[112].text == "[TERM] was seen again"
    # somebody stands with one address in 8 of 113 documents: below 4 bits
    assert got[5].text == "ask somebody at [EMAIL] today"


def test_terms_right_behind_an_entity(spark):
    """Behind and before an entity in texts of 1,000 characters; closing words, and words far away, do not stand next to it."""
    far = "so it goes on and on " * 25
    texts = [f"{far} 17 quuxley 22 ann@mail.example or +49 30 12345678 call 99 ask Zorblatt {far} 12 farewellia" for _ in range(4)]
    texts += [f"nothing said {k} here at all" for k in range(120)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in disclosure.sanitise(table).collect()}
    assert "Zorblatt" not in got[0] and "quuxley" not in got[0] and got[0].endswith("12 farewellia")
    assert "Zorblatt" in next(r.text for r in disclosure.sanitise(table, min_chars=9).collect() if r.doc_id == 0)


def test_context_of_spans(spark):
    """What stands next to a span against slices of the text."""
    rng = np.random.default_rng(4)
    bits = ["ann@mail.example", "10.0.0.1", "4111 1111 1111 1111", "+49 30 12345678", "7", "12", "wort", "énde 🎉", "x" * 70, "\n"]
    texts = [" ".join(bits[j] for j in rng.integers(len(bits), size=rng.integers(1, 120))) for _ in range(60)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = disclosure.base_spans(table, around=60).collect()
    assert len(found) > 500
    for r in found:
        t, a, b = texts[r["_id"]], r.start, r.end
        words = lambda x, y: {m.group() for m in re.finditer(r"[^\W\d_]+", t) if m.start() >= x and m.end() <= y}            # noqa: B023, E731
        assert set(re.findall(r"[^\W\d_]+", r.before)) == words(a - 60, a), (t, a)
        assert set(re.findall(r"[^\W\d_]+", r.after)) == words(b, b + 60), (t, b)


def test_pipeline(spark, rows):
    """Each stage against what the operators' own checks say about its input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, docs, FOLDER).cache()
    assert kept.count() == sum(any(c.isalpha() for c in r.text or "") for r in rows)
    one = stages["near_duplicates"](spark, kept, FOLDER).cache()
    groups, links = jaccard_groups({r.doc_id: r.text for r in kept.collect()})
    want, got = {groups.find(i) for i in groups.up}, {r.doc_id for r in one.collect()}
    assert want <= got and len(got - want) <= 0.002 * len(links)
    clean = stages["decontamination"](spark, one, FOLDER).cache()
    bad = {r.doc_id for r in ran(spark, "op5_latent_decontam")}
    left = {r.doc_id for r in clean.collect()}
    assert not left & bad and len(left) >= one.count() - len(bad) - 0.01 * len(rows)
    mixed = stages["source_mix"](spark, clean, FOLDER).cache()
    taken = {r.doc_id: r.taken for r in mixing.mix(clean).collect() if r.taken}
    assert {r.doc_id: len(r.text.split()) for r in mixed.collect()} == taken
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    texts = {r.doc_id: r.text for r in mixed.collect()}
    for r in stages["tokens"](spark, mixed, FOLDER).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == [*tokenizer.encode(texts.pop(r.doc_id), add_special_tokens=False).ids, queries.END_ID]
    assert not texts
