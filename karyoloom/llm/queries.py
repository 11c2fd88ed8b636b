"""Registered queries of the operators, each over its whole table, and their DuckDB texts where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core import plain_unions
from . import conversation_repair, crf_language, disclosure, hashed_maxent, importance_resampling, latent_decontam, line_dedup, lookup_shards, mixing, projection_dedup, token_store, toxicity, vantage_simhash
from .common import crc_part

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
SHARDS = [f"shard-{k:03d}" for k in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return plain_unions(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = token_store.write_store(docs, TOKENIZER, END_ID)
    return token_store.read_documents(store, docs, "doc_id").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_lookup_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup_shards.place(table(spark, sf_dir, "documents"), SHARDS).select("doc_id", "slot", "shard")


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_part("doc_id", 5) == 0
    field = crf_language.train_field(docs, ~held_out)
    return crf_language.predict(docs.withColumn("held_out", held_out), field, keep=["doc_id", "held_out"])


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_latent_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latent_decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "cosine", "share", "answer", "kind")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(4)) == 2            # noqa: E731
    scored = toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), lambda c: ~held_out(c))
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op7_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.95)


def op8_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = vantage_simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = disclosure.sanitise(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")     # noqa: E731
    return clean.select("doc_id", *[number(k) for k in ("email", "ip", "card", "phone")],
                        F.sha2(disclosure.digest(base).cast("binary"), 256).alias("base_sha256"), disclosure.digest(F.col("spans")).alias("spans"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.drop_shared_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """The test damage of the conversation query: by a hash of conversation and turn a row is dropped, emptied, cut of its ends
    of sentences, repeated or given to the user."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))            # noqa: E731
    fault = F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn")).cast("binary")), F.lit(20))
    rows = rows.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), fault.alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("fault") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    report, _ = conversation_repair.repair(damaged(rows), texts=False)
    every = rows.select("conv_id").distinct()
    joined = every.alias("e").join(report.alias("r"), F.col("e.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("e.conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                         F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_hashed_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_part("doc_id", 10) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    return hashed_maxent.score_corpus(docs, ~F.col("held_out"), F.floor(F.crc32(F.col("doc_id").cast("string").cast("binary")) / 10), keep=["doc_id", "held_out"])


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (op1_token_store, op2_lookup_shards, op3_crf_language, op4_source_mix, op5_latent_decontam, op6_toxicity, op7_projection_dedup, op8_vantage_simhash, op9_disclosure, op10_line_dedup, op11_conversation_repair, op12_hashed_maxent,
                                    op13_importance_resampling)}

CRC_TABLE = """
crc_table AS (
  SELECT list(list_reduce([i]::BIGINT[] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i))"""


def duck_crc32(text: str, table: str = "t") -> str:
    """crc32 of the UTF-8 bytes of a text, with the column `t` of crc_table in reach."""
    code = f"hex(encode({text}))"
    return (f"xor(list_reduce([4294967295]::BIGINT[] || list_transform(range(length({code}) // 2), lambda k: ('0x' || substr({code}, 2 * k::INT + 1, 2))::BIGINT), "
            f"lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)")


ORACLES = {
    "op11_conversation_repair": rf"""
WITH RECURSIVE {CRC_TABLE},
hit AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {duck_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations, crc_table),
bad AS (
  SELECT conv_id, turn, copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy FROM hit WHERE fault <> 0)),
put AS (
  SELECT *, row_number() OVER w AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM bad WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, copy)),
told AS (
  SELECT *, substr(role, 1, 1) AS i, CASE WHEN t = '' THEN 3 WHEN seen > 1 THEN 2 WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS f,
         lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM put),
sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 3) AS blank, count(*) FILTER (f = 2) AS duplicate,
         count(*) FILTER (f = 1) AS truncated, count(*) FILTER (before IS NOT NULL AND before || i NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
  FROM told GROUP BY conv_id),
-- cheapest (cost, edits, repaired turns) of the rows from k on, in the states start, system, user, assistant; inserts are tried last
best AS (
  SELECT conv_id, n + 1 AS k, {{'c': 0, 'e': '', 'r': []::VARCHAR[]}} AS q0, {{'c': 6, 'e': 'II', 'r': ['user:', 'assistant:']}} AS qs,
         {{'c': 3, 'e': 'I', 'r': ['assistant:']}} AS qu, {{'c': 0, 'e': '', 'r': []::VARCHAR[]}} AS qa FROM sums
  UNION ALL
  SELECT conv_id, k,
         list_min([g0, {{'c': gu.c + 3, 'e': 'I' || gu.e, 'r': list_prepend('user:', gu.r)}}, {{'c': ga.c + 6, 'e': 'II' || ga.e, 'r': ['user:', 'assistant:'] || ga.r}}]),
         list_min([gs, {{'c': gu.c + 3, 'e': 'I' || gu.e, 'r': list_prepend('user:', gu.r)}}, {{'c': ga.c + 6, 'e': 'II' || ga.e, 'r': ['user:', 'assistant:'] || ga.r}}]),
         list_min([gu, {{'c': ga.c + 3, 'e': 'I' || ga.e, 'r': list_prepend('assistant:', ga.r)}}]),
         list_min([ga, {{'c': gu.c + 3, 'e': 'I' || gu.e, 'r': list_prepend('user:', gu.r)}}])
  FROM (
    SELECT b.conv_id, t.k,
      list_min([{{'c': q0.c + 4, 'e': 'D' || q0.e, 'r': q0.r}},
                {{'c': CASE WHEN f < 2 AND i = 's' THEN qs.c + 3 * f WHEN f < 2 AND i = 'u' THEN qu.c + 3 * f ELSE 1000000000 END,
                 'e': 'K' || CASE i WHEN 's' THEN qs.e ELSE qu.e END, 'r': list_prepend(role || ':' || text, CASE i WHEN 's' THEN qs.r ELSE qu.r END)}},
                {{'c': CASE WHEN f < 2 THEN qu.c + 3 + 3 * f ELSE 1000000000 END, 'e': 'R' || qu.e, 'r': list_prepend('user:' || text, qu.r)}}]) AS g0,
      list_min([{{'c': qs.c + 4, 'e': 'D' || qs.e, 'r': qs.r}},
                {{'c': CASE WHEN f < 2 AND i = 'u' THEN qu.c + 3 * f ELSE 1000000000 END, 'e': 'K' || qu.e, 'r': list_prepend(role || ':' || text, qu.r)}},
                {{'c': CASE WHEN f < 2 THEN qu.c + 3 + 3 * f ELSE 1000000000 END, 'e': 'R' || qu.e, 'r': list_prepend('user:' || text, qu.r)}}]) AS gs,
      list_min([{{'c': qu.c + 4, 'e': 'D' || qu.e, 'r': qu.r}},
                {{'c': CASE WHEN f < 2 AND i = 'a' THEN qa.c + 3 * f ELSE 1000000000 END, 'e': 'K' || qa.e, 'r': list_prepend(role || ':' || text, qa.r)}},
                {{'c': CASE WHEN f < 2 THEN qa.c + 3 + 3 * f ELSE 1000000000 END, 'e': 'R' || qa.e, 'r': list_prepend('assistant:' || text, qa.r)}}]) AS gu,
      list_min([{{'c': qa.c + 4, 'e': 'D' || qa.e, 'r': qa.r}},
                {{'c': CASE WHEN f < 2 AND i = 'u' THEN qu.c + 3 * f ELSE 1000000000 END, 'e': 'K' || qu.e, 'r': list_prepend(role || ':' || text, qu.r)}},
                {{'c': CASE WHEN f < 2 THEN qu.c + 3 + 3 * f ELSE 1000000000 END, 'e': 'R' || qu.e, 'r': list_prepend('user:' || text, qu.r)}}]) AS ga
    FROM best b JOIN told t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.k = b.k - 1)),
done AS (SELECT conv_id, q0 FROM best WHERE k = 1)
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated,
       coalesce(s.illegal, 0) AS illegal, coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.e, '') AS audit, sha256(coalesce(array_to_string(q0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id""",
    "op13_importance_resampling": rf"""
WITH {CRC_TABLE},
texts AS (SELECT doc_id, text, 0 AS side FROM documents UNION ALL SELECT NULL, text, 1 FROM benchmark),
words AS (
  SELECT doc_id, side, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts),
seen AS (SELECT doc_id, side, w, count(*) AS n FROM words GROUP BY doc_id, side, w),
placed AS (SELECT w, {duck_crc32("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM seen), crc_table),
totals AS (SELECT sum(n) FILTER (side = 0) AS big_s, sum(n) FILTER (side = 1) AS big_t FROM seen),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(sum(n) FILTER (side = 1), 0) + 1)::DOUBLE * (big_s + 10000)::DOUBLE
                                 / ((coalesce(sum(n) FILTER (side = 0), 0) + 1)::DOUBLE * (big_t + 10000)::DOUBLE)))::BIGINT AS gain
  FROM seen JOIN placed USING (w), totals GROUP BY bucket, big_s, big_t),
weights AS (
  SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight
  FROM seen JOIN placed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents d LEFT JOIN weights w USING (doc_id)),
ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)""",
    "op10_line_dedup": r"""
WITH l AS (
  SELECT doc_id, xs, generate_subscripts(xs, 1) AS pos, unnest(xs) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents)),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.key IS NULL THEN k.line END, chr(10) ORDER BY k.pos), '')) AS kept_sha256
FROM k LEFT JOIN f USING (key) GROUP BY k.doc_id""",
}
