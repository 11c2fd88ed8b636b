"""Chromosome names and assemblies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# fixed values: chromosome lengths that identify an assembly
KNOWN_LENGTHS = {"hg19": {"chr1": 249_250_621, "chrX": 155_270_560}, "hg38": {"chr1": 248_956_422, "chrX": 156_040_895},
                 "mm10": {"chr1": 195_471_971, "chrX": 171_031_299}, "mm39": {"chr1": 195_154_279, "chrX": 169_476_592}}
CONTIG_ENDS = ("ALT", "RANDOM", "FIX")


def simple_name(c: str | Column) -> Column:
    """'chr' spelling of plain names: 9, Chr9, MT."""
    n = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(F.lower(F.substring(n, 1, 3)) == "chr", F.concat(F.lit("chr"), F.substr(n, F.lit(4)))).when(
        n.isin("MT", "M"), "chrM").otherwise(F.concat(F.lit("chr"), n))


def _only(c: Column, characters: str) -> Column:
    return (F.length(c) > 0) & (F.translate(c, characters, "") == "")


def _names_contig(core: Column) -> Column:
    """Chromosome, accession and, for some, the kind of contig, joined by underscores, in capitals."""
    digits, letters = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    part = F.split(core, "_")
    at = lambda k: F.try_element_at(part, F.lit(k))                                   # noqa: E731
    return (_only(at(1), digits) | at(1).isin("X", "Y", "UN")) & _only(at(2), digits + letters) & (
        (F.size(part) == 2) | ((F.size(part) == 3) & at(3).isin(*CONTIG_ENDS)))


def spelled_name(c: str | Column) -> Column:
    """Name by its spelling alone; NULL when it names no chromosome or contig. Human RefSeq accessions NC_000001 ... follow
    their number."""
    raw = F.trim(F.col(c) if isinstance(c, str) else c)
    acc = F.upper(F.split_part(raw, F.lit("."), F.lit(1)))
    num = F.regexp_extract(acc, r"^NC_0000(\d\d)$", 1).try_cast("int")
    refseq = (F.when(num.between(1, 22), F.concat(F.lit("chr"), num)).when(num == 23, "chrX").when(num == 24, "chrY").when(acc == "NC_012920", "chrM"))
    has = F.lower(F.substring(raw, 1, 3)) == "chr"
    rest = F.when(has, F.substr(raw, F.lit(4))).otherwise(raw)
    core = F.upper(F.trim(rest))
    n = F.when(core.rlike(r"^[0-9]{1,9}$"), core.try_cast("int"))
    return F.coalesce(refseq, F.when(core.isin("M", "MT"), "chrM").when(core.isin("X", "Y"), F.concat(F.lit("chr"), core)).when(
        n.between(1, 99), F.concat(F.lit("chr"), n)).when(_names_contig(core), F.concat(F.lit("chr"), rest)))


def normalize(df: DataFrame, column: str, aliases: DataFrame | None = None, out: str = "chrom_norm") -> DataFrame:
    """Add `out`: alias table (alias, ucsc) first, as written, in lower case, or without version; else by spelling. Names are
    looked up once per distinct spelling. NULL marks a name to reject."""
    names = df.select(F.col(column).alias("_raw")).distinct()
    if aliases is not None:
        a = aliases.select(F.col("alias").alias("_key"), F.col("ucsc").alias("_ucsc")).dropDuplicates(["_key"])
        t = F.trim("_raw")
        keys = F.array_distinct(F.array(t, F.lower(t), F.lower(F.split_part(t, F.lit("."), F.lit(1)))))
        found = names.select("_raw", F.posexplode(keys).alias("_p", "_key")).join(a, "_key").groupBy("_raw").agg(F.min_by("_ucsc", "_p").alias("_alias"))
        names = names.join(found, "_raw", "left")
    else:
        names = names.withColumn("_alias", F.lit(None).cast("string"))
    names = names.select(F.col("_raw").alias(column), F.coalesce("_alias", spelled_name("_raw")).alias(out))
    return df.join(names, column, "left")


def rejects(df: DataFrame, column: str, out: str = "chrom_norm") -> DataFrame:
    return df.filter(F.col(out).isNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def detect_assembly(lengths: DataFrame, by: list[str] = ("file",)) -> DataFrame:
    """(by, assembly): the known assembly whose lengths match all its chromosomes present in a file, NULL when none does."""
    known = F.array(*[F.struct(F.lit(a).alias("assembly"), F.lit(c).alias("_c"), F.lit(n).cast("long").alias("_n"), F.lit(k).alias("_o"))
                      for k, (a, d) in enumerate(KNOWN_LENGTHS.items()) for c, n in d.items()])
    m = lengths.withColumn("_name", simple_name("chrom")).select(*by, "_name", "length", F.inline(known)).filter(F.col("_name") == F.col("_c"))
    ok = m.groupBy(*by, "assembly", "_o").agg(F.bool_and(F.col("length") == F.col("_n")).alias("_ok")).filter("_ok")
    first = ok.groupBy(*by).agg(F.min_by("assembly", "_o").alias("assembly"))
    return lengths.select(*by).distinct().join(first, list(by), "left")


def assembly_mismatch(detected: DataFrame, expected: str) -> DataFrame:
    """Files of a known assembly other than the expected one: an error for the caller."""
    return detected.filter(F.col("assembly").isNotNull() & (F.col("assembly") != expected))
