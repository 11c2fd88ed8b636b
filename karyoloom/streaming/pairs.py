"""Contacts counted from a growing folder of pair files.

Counts add up in any order, so late files need no watermark and the stream keeps no state: every micro-batch is counted on
its own and joins a log of runs, each the summed contacts of consecutive batches. A level holds at most FAN - 1 runs; the
batch that would be the next merges all runs of the full levels into one run of the level above. So n batches leave at most
(FAN - 1) * (log_FAN(n) + 1) live runs, and a contact is written log_FAN(n) times.

A manifest lists the live runs and the last batch that they hold. It is written after its run, in one of two places by turns,
so that the other stays valid while one is replaced; the one with the later batch counts. A batch that is delivered again is
known by its number and skipped; one that failed before its manifest writes the same run again. A run is never written to a
folder that the present manifest or the one before it lists, so readers of either go on undisturbed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..core import read_if_there
from ..operators.contacts import bin_pairs

FAN = 4                          # runs of a level that make one of the next
MANIFEST = "batch long, level int, slot int, copy int, first long, last long, live boolean"


def pair_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(fmt)
    return (r.option("maxFilesPerTrigger", max_files) if max_files else r).load(folder)


def _read(spark: SparkSession, path: str) -> list:
    """Rows of a manifest; none if it was never written, or was lost while being replaced."""
    return read_if_there(spark, path, MANIFEST).collect()


def manifest(spark: SparkSession, out: str) -> tuple[int, list]:
    """(last batch, entries) of the valid manifest; (-1, []) before the first batch."""
    found = max((_read(spark, f"{out}/manifest-{k}") for k in (0, 1)), key=lambda rows: max((r["batch"] for r in rows), default=-1))
    return max((r["batch"] for r in found), default=-1), found


def run_path(out: str, run) -> str:
    return f"{out}/runs/level-{run['level']}/slot-{run['slot']}-{run['copy']}"


def add_batch(contacts: DataFrame, number: int, out: str, by: list[str] = ("sample",)) -> bool:
    """Add the contacts of batch `number` to the log; False if the log has them already."""
    spark = contacts.sparkSession
    done, entries = manifest(spark, out)
    if number <= done:
        return False
    live = [r.asDict() for r in entries if r["live"]]
    level = 0
    while sum(r["level"] == level for r in live) >= FAN - 1:
        level += 1
    merged, stay = [r for r in live if r["level"] < level], [r for r in live if r["level"] >= level]
    slot = sum(r["level"] == level for r in stay)
    taken = {r["copy"] for r in entries if (r["level"], r["slot"]) == (level, slot)}
    run = {"level": level, "slot": slot, "copy": min({0, 1} - taken), "first": min([number, *(r["first"] for r in merged)]), "last": number, "live": True}
    columns = [*by, "chrom", "i", "j"]
    rows = contacts.select(*columns, "cnt")
    if merged:
        rows = rows.unionByName(spark.read.schema(rows.schema).parquet(*[run_path(out, r) for r in merged])).groupBy(*columns).agg(F.sum("cnt").alias("cnt"))
    rows.write.mode("overwrite").parquet(run_path(out, run))
    listed = [*stay, *({**r, "live": False} for r in merged), run]
    order = ["level", "slot", "copy", "first", "last", "live"]
    batches = [max((r["batch"] for r in _read(spark, f"{out}/manifest-{k}")), default=-1) for k in (0, 1)]
    target = batches.index(min(batches))                       # the older manifest is replaced
    spark.createDataFrame([(number, *(r[c] for c in order)) for r in listed], MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest-{target}")
    return True


def count_pairs(pairs: DataFrame, resolution: int, out: str, checkpoint: str, by: list[str] = ("sample",), trigger: dict | None = None) -> StreamingQuery:
    """Start counting a stream of pairs into the log of runs at `out`."""
    def write(batch: DataFrame, number: int) -> None:
        add_batch(bin_pairs(batch, resolution, list(by)), number, out, list(by))

    return pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_runs(spark: SparkSession, out: str) -> list[str]:
    """Folders of the live runs."""
    return [run_path(out, r) for r in manifest(spark, out)[1] if r["live"]]


def totals(spark: SparkSession, out: str, by: list[str] = ("sample",)) -> DataFrame:
    """Contacts of all batches so far."""
    runs = live_runs(spark, out)
    if not runs:
        raise FileNotFoundError(f"no batch has been counted at {out}")
    return spark.read.parquet(*runs).groupBy(*by, "chrom", "i", "j").agg(F.sum("cnt").alias("cnt"))


def compact(spark: SparkSession, out: str, target: str, by: list[str] = ("sample",)) -> None:
    """Write the running totals as one sorted table."""
    totals(spark, out, by).repartition(*by, "chrom").sortWithinPartitions("i", "j").write.mode("overwrite").partitionBy("chrom").parquet(target)
