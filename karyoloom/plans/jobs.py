"""Jobs over many inputs: sample sheets with resume, graph tables, property flags, grouped splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core import cut, read_if_there
from ..functions.ranks import scan, value_buckets
from ..functions.stats import uniform
from ..operators import bins, contacts as C, sequence
from ..operators.balance import balanced_contacts
from . import suite


def pending(sheet: DataFrame, done: DataFrame) -> DataFrame:
    """Samples of the sheet without results yet."""
    return sheet.join(done.select("sample").distinct(), "sample", "left_anti")


STEPS = ("boundaries", "domains", "tracks", "p_s", "summary")
COMPARISON = "comparison"
MARKERS = "sample string, step string"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(sample, step) of the steps whose tables are complete: a marker is written after its table."""
    return read_if_there(spark, f"{path}/steps", MARKERS).distinct()


def run_sheet(spark: SparkSession, pairs: DataFrame, sheet: DataFrame, sizes: DataFrame, resolution: int, window: int, path: str, steps: tuple[str, ...] = STEPS) -> DataFrame:
    """Analyse the samples of the sheet, each step for all samples that lack it in one job, into tables partitioned by sample.
    A run that stops between two steps goes on there, and one that stops within a step writes its samples again. The summary is
    made from the tables that are there, so a step is worked out once. Returns the (sample, step) that were run."""
    every = sheet.select("sample").distinct().withColumn("step", F.explode(F.array(*[F.lit(s) for s in steps])))
    wanted = cut(every.join(committed(spark, path), ["sample", "step"], "left_anti"))
    todo = wanted.select("sample").distinct()
    if wanted.isEmpty():
        return wanted
    n = sizes.join(todo, "sample", "left_semi")
    tables = suite.analyze(C.bin_pairs(pairs.join(todo, "sample", "left_semi"), resolution), n, resolution, window, call=False)
    for step in steps:
        own = wanted.filter(F.col("step") == step)
        if step == "summary":
            tables[step] = suite.summary(tables, n)
        if not own.isEmpty():
            (tables[step].join(own.select("sample"), "sample", "left_semi").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("sample").parquet(f"{path}/{step}"))
            own.write.mode("append").parquet(f"{path}/steps")
        # by now every sample of `todo` has this step, from this run or an earlier one
        tables[step] = read_if_there(spark, f"{path}/{step}", tables[step].schema).select(tables[step].columns).join(todo, "sample", "left_semi")
    return wanted


def run_comparison(spark: SparkSession, pairs: DataFrame, sheet: DataFrame, sizes: DataFrame, resolution: int, window: int, path: str, **settings) -> bool:
    """Compare the first two conditions of the sheet, samples as replicates, into tables below `path`/comparison. Nothing is
    done, and False returned, if the sheet has no two conditions of one region or the comparison is there already."""
    named = cut(first_two_conditions(sheet).select("sample", "condition", "side").distinct())
    sides = [r["condition"] for r in named.select("side", "condition").distinct().orderBy("side").collect()]          # two rows
    marker = spark.createDataFrame([(" / ".join(sides), COMPARISON)], MARKERS)
    if len(sides) < 2 or not marker.join(committed(spark, path), ["sample", "step"], "left_semi").isEmpty():
        return False
    maps = C.bin_pairs(pairs.join(named.select("sample"), "sample", "left_semi"), resolution)
    reps = cut(maps.join(named.select("sample", "side"), "sample").select(F.col("side").alias("condition"), F.col("sample").alias("replicate"), "chrom", "i", "j", "cnt"))
    for name, df in suite.compare_conditions(reps, sizes.select("chrom", "n").distinct(), resolution, window, **settings).items():
        df.write.mode("overwrite").parquet(f"{path}/{COMPARISON}/{name}")
    marker.write.mode("append").parquet(f"{path}/steps")
    return True


def first_two_conditions(sheet: DataFrame) -> DataFrame:
    """The first two conditions of a sheet as a and b, kept only when all their samples share one region."""
    order = sheet.groupBy("condition").agg(F.min("row_no").alias("_r"))
    two = order.orderBy("_r").limit(2)                                       # the feature: the first two conditions
    named = two.join(F.broadcast(two.agg(F.min("_r").alias("_lo"), F.count(F.lit(1)).alias("_k"))), F.lit(True)).filter("_k = 2")
    s = sheet.join(named.select("condition", F.when(F.col("_r") == F.col("_lo"), "a").otherwise("b").alias("side")), "condition")
    one = s.agg(F.countDistinct("region").alias("_n"))
    return s.join(F.broadcast(one), F.lit(True)).filter("_n = 1").drop("_n")


def graph_table(chunks: DataFrame, signal: DataFrame, contacts: DataFrame, resolution: int, weights: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (contig, bin, gc, signal, valid) and contacts between valid bins (contig, i, j, cnt), optionally balanced."""
    gc = sequence.gc_per_bin(chunks, resolution)
    nodes = gc.join(bins.binned_mean(signal, resolution, ["contig"]), ["contig", "bin"], "left").select(
        "contig", "bin", "gc", F.when(F.col("valid"), F.col("value")).alias("signal"), "valid")
    ok = gc.filter("valid").select("contig", "bin")
    c = C.canonical(contacts, ["contig"])
    for k in ("i", "j"):
        c = c.join(ok.withColumnRenamed("bin", k), ["contig", k], "left_semi")
    return nodes, (balanced_contacts(c, weights, ["contig"]) if weights is not None else c)


def drug_likeness(props: DataFrame) -> DataFrame:
    """Rule-of-five and Veber flags of a property table (mw, xlogp, hbd, hba, rot, tpsa); a missing XLogP passes."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0))                             # noqa: E731
    f = {"mw_ok": z("mw") <= 500, "xlogp_ok": F.col("xlogp").isNull() | (F.col("xlogp") <= 5), "hbd_ok": z("hbd") <= 5, "hba_ok": z("hba") <= 10, "rot_ok": z("rot") <= 10, "tpsa_ok": z("tpsa") <= 140}
    d = props.withColumns(f)
    return d.withColumn("ro5_violations", sum((F.when(F.col(k), 0).otherwise(1) for k in ("mw_ok", "xlogp_ok", "hbd_ok", "hba_ok")), F.lit(0)))


def grouped_split(items: DataFrame, group: str = "scaffold", train: float = 0.8, seed: int = 0) -> DataFrame:
    """(group, size, part): whole groups go to train or test; large groups first, then in random order, a group that no longer
    fits is passed over and the next ones are tried. Each round takes every group up to the first that does not fit."""
    g = items.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    total = int(g.agg(F.sum("size")).first()[0] or 0)                        # one number
    room = round(train * total)
    half = (total - room) / 2
    key = F.when(F.col("size") > half, 0.0).otherwise(1.0) + uniform(F.lit(seed), F.col(group)) * 0.999
    left = cut(g.withColumns({"_k": key, "_g": F.lit(0)}))
    taken = None
    while room > 0:
        fit = left.filter(F.col("size") <= room)
        if fit.isEmpty():
            break
        run = cut(scan(value_buckets(fit, ["_g"], "_k"), ["_g"], "_k", F.col("size"), "_run"))
        win = cut(run.filter(F.col("_run") <= room).select(group, "size"))
        taken = win if taken is None else taken.unionByName(win)
        room -= int(win.agg(F.sum("size")).first()[0])
        stop = run.join(win, group, "left_anti")
        first = stop.agg(F.min("_k")).first()[0]
        if first is None:
            break
        left = cut(stop.filter(F.col("_k") > first).select(group, "size", "_k", "_g"))
    inside = taken.select(group, F.lit("train").alias("part")) if taken is not None else g.select(group, F.lit("train").alias("part")).limit(0)
    return g.join(inside, group, "left").withColumn("part", F.coalesce("part", F.lit("test")))
