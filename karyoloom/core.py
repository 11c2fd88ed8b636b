"""Session helpers used by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

MAP = ("sample", "chrom")          # default grouping of a contact map


def plain_unions(spark: SparkSession) -> SparkSession:
    """Spark 4.1 lets a union pass on the partitioning of its inputs; under adaptive execution a window or an aggregate over
    such a union can then see one key in several partitions. Off, unions are dealt out anew like in earlier versions."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut lineage: the session's own setting, or, on a local master only, a temporary one
    that goes with the process."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder every executor can reach.")
        folder = tempfile.mkdtemp(prefix="karyoloom-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder, so that loops keep short plans and survive lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def cut_as_dealt(df: DataFrame) -> DataFrame:
    """`cut` that keeps how the rows are dealt, so that later joins on that key leave them where they are. The plan of adaptive
    execution does not tell it: with it on, such a table is shuffled again in each join."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def null_nan(c: Column | str) -> Column:
    """NaN (missing in text inputs) becomes NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def idiv(a, b) -> Column:
    """Floor division that stays integral."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.lit(b) if isinstance(b, int) else b
    return F.floor(a / b).cast("long")


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def same(a: str, b: str, keys) -> Column:
    """Equality of `keys` between two aliased frames."""
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns computed exactly once per row: a generator keeps the optimiser from copying their expressions into every
    later use, which would repeat pattern matching many times over."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def scratch(spark: SparkSession, prefix: str) -> str:
    """New path below the checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{prefix}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Parquet at `path`, or no rows if nothing was written there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
