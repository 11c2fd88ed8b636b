"""Removal of lines that many documents share: lines are exploded, normalised and hashed, documents are counted per hash, and
the documents are put together again from the lines that stay, by position. DataFrame functions only.

Defined cases: a null or empty text is one empty line; a key shorter than `min_chars` is never dropped; several copies of a
line in one document count once; rows with the same id and text are one document in the count and each give a row of the
result; a null id is an id like any other; a document may lose all its lines and then has the empty text; other columns are
kept, but n_lines and n_dropped are replaced. A line is told by 128 bits of hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..core import once
from .common import field, rows_of, whole

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 32                       # parts of a line that most documents have


def line_key(line: Column) -> Column:
    """The line without white space at both ends, A-Z in lower case."""
    space = F.lit("\x20\x09\x0a\x0b\x0c\x0d")
    return F.translate(F.trim(line, space), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def keyed_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(_id, _tie, pos, h1, h2) of each line whose key has at least `min_chars` characters."""
    rows = docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))
    lines = rows.select("_id", "_tie", F.posexplode(_lines(F.col("_text"))).alias("pos", "_line"))
    lines = lines.select("_id", "_tie", "pos", line_key(F.col("_line")).alias("_key"))
    if min_chars > 0:
        lines = lines.filter(F.length("_key") >= min_chars)
    return lines.select("_id", "_tie", "pos", F.xxhash64("_key").alias("h1"), F.xxhash64(F.lit(1), "_key").alias("h2"))


def frequent_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n_docs) of the keys found in at least `min_docs` documents. Lines are counted first, then documents: both
    counts start within the task that reads the text."""
    per_doc = lines.groupBy("h1", "h2", "_id", "_tie").agg(F.lit(1).alias("one"))
    return (per_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))
            .filter(F.col("n_docs") >= min_docs))


def drop_shared_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, doc_id: str = "doc_id",
                      text: str = "text") -> DataFrame:
    """The documents with `text` cut to the lines that stay, and n_lines, n_dropped (longs)."""
    lines = keyed_lines(docs, doc_id, text, min_chars)
    shared = frequent_lines(lines, min_docs).select("h1", "h2").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("_salt", F.pmod(F.hash("_id", "_tie"), F.lit(SALTS)))
    dropped = (salted.join(shared, ["h1", "h2", "_salt"]).select("_id", "_tie", "pos").distinct()
               .groupBy("_id", "_tie").agg(F.collect_list("pos").alias("_gone")))
    rows = rows_of(docs, _id=F.col(doc_id), _tie=F.xxhash64(whole(text)))
    joined = rows.alias("d").join(dropped.alias("g"), F.col("d._id").eqNullSafe(F.col("g._id")) & (F.col("d._tie") == F.col("g._tie")), "left")
    joined = joined.select("_row", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    old = whole(field(text))
    # lines are split once, and what stays is a difference of position sets: linear in the lines of a document
    joined = once(joined, _lines=F.when(F.size("_gone") > 0, _lines(old)), _n=F.length(old) - F.length(F.translate(old, "\n", "")) + 1)
    gone = F.col("_gone")
    stay = F.array_except(F.sequence(F.lit(0), F.col("_n") - 1), gone)
    new = F.when(F.size(gone) == 0, old).otherwise(F.array_join(F.transform(stay, lambda k: F.col("_lines")[k]), "\n"))
    same = [(new if c == text else field(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*same, F.col("_n").cast("bigint").alias("n_lines"), F.size(gone).cast("bigint").alias("n_dropped"))
