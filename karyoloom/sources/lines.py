"""Text inputs as rows (file, line_no, value); every reader below works on such a table, from files or from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


SCAN_ROWS = 65_536               # lines of a file that one task goes through in order


def read_lines(spark: SparkSession, path: str, numbered: bool = True) -> DataFrame:
    """Lines of text files (gzip accepted). Numbers restart per file: a line's place in its split, behind the lines of the
    splits before; only one row per split is put in order, so a file of any size is read by many tasks."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_s"), "value")
    if not numbered:
        return raw.select("file", "value", F.lit(None).cast("long").alias("line_no"))
    d = raw.withColumn("_k", F.monotonically_increasing_id())
    before = W.partitionBy("file").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    splits = d.groupBy("file", "_s").agg(F.min("_k").alias("_first"), F.count(F.lit(1)).alias("_n"))
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return d.join(splits, ["file", "_s"]).select("file", "value", (F.col("_k") - F.col("_first") + F.col("_before") + 1).alias("line_no"))


def running(lines: DataFrame, values: dict[str, Column], rows: int = SCAN_ROWS) -> DataFrame:
    """Add to each line the sum of every value over the lines of its file before it (nulls count 0), as a scan on two levels:
    within blocks of `rows` line numbers, and over the totals of the blocks."""
    d = lines.withColumn("_b", F.floor(F.col("line_no") / rows)).withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in values.items()})
    before = W.partitionBy("file").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy("file", "_b").agg(*[F.sum(f"_v_{k}").alias(f"_o_{k}") for k in values])
    totals = totals.select("file", "_b", *[F.coalesce(F.sum(f"_o_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in values])
    inside = W.partitionBy("file", "_b").orderBy("line_no").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({k: F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in values}).join(totals, ["file", "_b"])
    return d.withColumns({k: F.col(k) + F.col(f"_o_{k}") for k in values}).drop("_b", *[f"{x}{k}" for k in values for x in ("_v_", "_o_")])


def data_lines(lines: DataFrame, header_words: tuple[str, ...] = ("#", "track", "browser")) -> DataFrame:
    ok = F.length(F.trim("value")) > 0
    for w in header_words:
        ok = ok & ~F.startswith("value", F.lit(w))
    return lines.filter(ok)


def fields(value: str | Column = "value") -> Column:
    """Tab-separated fields, or fields separated by other white space when there is no tab."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(F.contains(v, F.lit("\t")), F.split(F.rtrim(v), "\t")).otherwise(F.split(F.trim(v), r"\s+"))


def at(parts: str, k: int) -> Column:
    """Field k (from 0), NULL when the line is shorter."""
    return F.try_element_at(F.col(parts), F.lit(k + 1))


def whole(c: Column) -> Column:
    """Integer field, NULL when it is not one."""
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("long"))


def number(c: Column) -> Column:
    return F.trim(c).try_cast("double")
