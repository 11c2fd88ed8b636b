"""Text exports (each row becomes one `value` line, written in parallel), Parquet maps and run records."""

from __future__ import annotations

import datetime
import platform

import pandas as pd
import pyspark
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def six_digits(v: pd.Series) -> pd.Series:
    """'%.6g' of C: six significant digits of the exact binary value, no trailing zeros (Java's %g keeps them)."""
    return pd.Series([None if x is None or x != x else "%.6g" % x for x in v], dtype=object)


def significant(c: str | Column) -> Column:
    return six_digits((F.col(c) if isinstance(c, str) else c).cast("double"))


def _line(*cols, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[c.cast("string") if isinstance(c, Column) else F.col(c).cast("string") for c in cols]).alias("value")


def bed_lines(df: DataFrame, name: str | None = None) -> DataFrame:
    return df.select(_line("chrom", "start", "end", *([name] if name else [])))


def bedgraph_lines(df: DataFrame, value: str) -> DataFrame:
    """Finite values only, six significant digits."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    return df.filter(ok).select(_line("chrom", "start", "end", significant(value)))


def bedpe_lines(df: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Loops (chrom, i, j bins as start1, end1, start2, end2) as paired intervals with further columns."""
    return df.select(_line("chrom1", "start1", "end1", "chrom2", "start2", "end2", *extra))


def pixel_bedpe_lines(df: DataFrame, resolution: int, extra: list[str] = ("log2_fc", "q")) -> DataFrame:
    """Differential pixels as paired intervals; a missing column value prints '.'."""
    a, b = F.col("start") + F.col("i") * resolution, F.col("start") + F.col("j") * resolution
    more = [F.coalesce(F.round(F.col(c), 6).cast("string"), F.lit(".")) if c in df.columns else F.lit(".") for c in extra]
    return df.select(_line("chrom", a, a + resolution, "chrom", b, b + resolution, F.lit("."), F.lit("."), *more))


def juicebox_lines(loops: DataFrame | None = None, domains: DataFrame | None = None) -> DataFrame:
    short = lambda c: F.regexp_replace(c, "^chr", "")                                                     # noqa: E731
    out = []
    if loops is not None:
        out.append(loops.select(_line(short("chrom1"), "start1", "end1", short("chrom2"), "start2", "end2", F.lit("0,255,255"), F.lit("loop"))))
    if domains is not None:
        out.append(domains.select(_line(short("chrom"), "start", "end", short("chrom"), "start", "end", F.lit("255,255,0"), F.lit("domain"))))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


JUICEBOX_HEADER = "chr1\tx1\tx2\tchr2\ty1\ty2\tcolor\tcomment"


def juicer_short_lines(contacts: DataFrame, resolution: int, start: int = 0) -> DataFrame:
    c = F.regexp_replace("chrom", "^chr", "")
    return contacts.select(_line(F.lit("0"), c, F.lit(start) + F.col("i") * resolution, F.lit("0"), F.lit("0"), c, F.lit(start) + F.col("j") * resolution, F.lit("1"),
                                 significant("cnt"), sep=" "))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite", compression: str | None = None) -> None:
    w = lines.write.mode(mode)
    (w.option("compression", compression) if compression else w).text(path)


def write_pyramid(pyramid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Multi-resolution maps partitioned by resolution and chromosome and sorted by bins, so a region reads few row groups."""
    whole = F.col("cnt") == F.floor("cnt")
    d = pyramid.withColumn("count", F.when(whole, F.col("cnt").cast("long"))).repartition("resolution", "chrom", F.floor(F.col("i") / 4096))
    d.sortWithinPartitions("resolution", "chrom", "i", "j").write.mode(mode).partitionBy("resolution", "chrom").parquet(path)


def write_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """TSV folders, one per table, and JSON for one-row summaries."""
    for name, df in tables.items():
        if name == "summary":
            df.write.mode(mode).json(f"{path}/{name}")
        else:
            df.write.mode(mode).option("sep", "\t").option("header", True).csv(f"{path}/{name}")


def input_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256) of input files, hashed where they are read."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def run_record(inputs: DataFrame, command: str, parameters: dict) -> DataFrame:
    """One row: command, parameters (array arguments as their length only), inputs with digests, versions, record digest."""
    flat = {k: f"<array len={len(v)}>" if isinstance(v, (list, tuple)) else str(v) for k, v in parameters.items()}
    params = F.create_map(*[F.lit(x) for kv in sorted(flat.items()) for x in kv]) if flat else F.create_map()
    rec = inputs.agg(F.array_sort(F.collect_list(F.struct("path", "sha256"))).alias("inputs")).select(          # one entry per input file of the run
        F.lit(command).alias("command"), params.alias("parameters"), "inputs", F.lit(pyspark.__version__).alias("spark"), F.lit(platform.python_version()).alias("python"))
    rec = rec.withColumn("record_sha256", F.sha2(F.to_json(F.struct(*rec.columns)), 256))
    return rec.withColumn("utc", F.lit(datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="seconds")))


def append_log(record: DataFrame, path: str) -> None:
    record.write.mode("append").json(path)
