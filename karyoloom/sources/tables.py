"""Readers of text tables: pairs, contacts, tracks, peaks, chains, expression, annotations, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..core import idiv, once
from ..operators.contacts import sum_contacts
from .lines import SCAN_ROWS, at, data_lines, fields, number, read_lines, running, whole
from .names import simple_name

DEFAULT_PAIR_COLUMNS = ["readID", "chrom1", "pos1", "chrom2", "pos2", "strand1", "strand2"]


def pair_columns(lines: DataFrame) -> DataFrame:
    """(file, columns) from '#columns:' header lines."""
    h = lines.filter(F.startswith("value", F.lit("#columns:")))
    return h.groupBy("file").agg(F.min_by(F.slice(F.split(F.trim("value"), r"\s+"), F.lit(2), F.size(F.split(F.trim("value"), r"\s+"))), "line_no").alias("columns"))


def chromosome_sizes(lines: DataFrame) -> DataFrame:
    """(file, chrom, length) from '#chromsize:' header lines."""
    h = lines.filter(F.startswith("value", F.lit("#chromsize:"))).withColumn("p", F.split(F.trim("value"), r"\s+")).filter(F.size("p") >= 3)
    return h.select("file", F.element_at("p", 2).alias("chrom"), whole(F.element_at("p", 3)).alias("length"))


def parse_pairs(lines: DataFrame) -> DataFrame:
    """Read pairs (file, chrom1, pos1, chrom2, pos2) by the column order of each file's header. Only the header table is
    joined; the pair lines themselves are split in place."""
    cols = pair_columns(lines)
    default = F.array(*[F.lit(c) for c in DEFAULT_PAIR_COLUMNS])
    d = lines.filter(~F.startswith("value", F.lit("#")) & (F.length("value") > 0)).join(cols, "file", "left")
    d = d.withColumns({"p": F.split("value", "\t"), "columns": F.coalesce("columns", default)})
    get = lambda c: F.try_element_at("p", F.array_position("columns", c).cast("int"))                                           # noqa: E731
    return d.select("file", get("chrom1").alias("chrom1"), whole(get("pos1")).alias("pos1"), get("chrom2").alias("chrom2"), whole(get("pos2")).alias("pos2"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return parse_pairs(read_lines(spark, path, numbered=False).withColumn("line_no", F.monotonically_increasing_id()))


def parse_contacts(lines: DataFrame, resolution: int) -> DataFrame:
    """Contacts (file, chrom, i, j, cnt) of text tables: three columns are bins and a count, five are chr pos chr pos count,
    six or more are paired intervals with the count in column seven or 1. Duplicates are summed, the diagonal dropped."""
    d = once(data_lines(lines), p=fields())
    k = F.size("p")
    d = once(d, c1=simple_name(at("p", 0)), c2=simple_name(F.when(k == 5, at("p", 2)).otherwise(at("p", 3))), f0=whole(at("p", 0)), f1=whole(at("p", 1)),
             f3=F.when(k == 5, whole(at("p", 3))).otherwise(whole(at("p", 4))), n=F.when(k == 3, number(at("p", 2))).otherwise(F.coalesce(F.when(k == 5, number(at("p", 4))).when(k >= 7, number(at("p", 6))), F.lit(1.0))))
    rows = d.select("file", F.when(k > 3, F.col("c1")).alias("chrom"), F.when(k == 3, F.col("f0")).otherwise(idiv("f1", resolution)).alias("i"),
                    F.when(k == 3, F.col("f1")).otherwise(idiv("f3", resolution)).alias("j"), F.col("n").alias("cnt"), ((k == 3) | (F.col("c1") == F.col("c2"))).alias("_cis"))
    rows = rows.filter(F.col("_cis") & F.col("i").isNotNull() & F.col("j").isNotNull() & F.col("cnt").isNotNull())
    return sum_contacts(rows.withColumn("chrom", F.coalesce("chrom", F.lit(""))), ["file", "chrom"])


def parse_intervals(lines: DataFrame) -> DataFrame:
    """bedGraph (four columns) and BED (score in column five, default 1) rows (file, chrom, start, end, value)."""
    d = data_lines(lines).withColumn("p", fields())
    v = F.when(F.size("p") == 4, F.coalesce(number(at("p", 3)), F.lit(0.0))).otherwise(F.coalesce(number(at("p", 4)), F.lit(1.0)))
    return d.select("file", simple_name(at("p", 0)).alias("chrom"), whole(at("p", 1)).alias("start"), whole(at("p", 2)).alias("end"), v.alias("value")).dropna(subset=["start", "end"])


def parse_peaks(lines: DataFrame) -> DataFrame:
    """Peaks (file, chrom, start, end, summit, signal) of narrowPeak or BED lines; summit -1 when absent."""
    d = data_lines(lines).withColumn("p", fields()).filter(F.size("p") >= 3)
    p = d.select("file", at("p", 0).alias("chrom"), whole(at("p", 1)).alias("start"), whole(at("p", 2)).alias("end"),
                 F.coalesce(whole(at("p", 9)), F.lit(-1)).alias("summit"), number(at("p", 6)).alias("signal"))
    return p.filter(F.col("end") > F.col("start"))


def peak_positions(peaks: DataFrame) -> DataFrame:
    """Summit, or the middle of peaks without one."""
    mid = F.when(F.col("summit") >= 0, F.col("start") + F.col("summit")).otherwise(idiv(F.col("start") + F.col("end"), 2))
    return peaks.withColumn("mid", mid)


def parse_chain(lines: DataFrame, rows: int = SCAN_ROWS) -> DataFrame:
    """Blocks of UCSC chain text: positions run along each chain by the sizes and gaps of the lines above. Chains are
    numbered per file (a chain file describes one pair of assemblies). The sums run over a whole file in blocks of `rows`
    lines; a position is the sum at its line less that at its header."""
    d = lines.filter(F.length(F.trim("value")) > 0).withColumn("p", F.split(F.trim("value"), r"\s+")).withColumn("_head", at("p", 0) == "chain")
    size, gap = whole(at("p", 0)), lambda k: F.coalesce(whole(at("p", k)), F.lit(0))                                              # noqa: E731
    step = lambda k: F.when(~F.col("_head"), size + gap(k))                                                                      # noqa: E731
    d = running(d, {"_heads": F.col("_head").cast("int"), "_t": step(1), "_q": step(2)}, rows)
    h = d.filter("_head").select("file", (F.col("_heads") + 1).alias("_c"), at("p", 2).alias("chrom"), (whole(at("p", 5)) - F.col("_t")).alias("_t0"),
                                 at("p", 7).alias("q_chrom"), whole(at("p", 8)).alias("q_size"), at("p", 9).alias("q_strand"), (whole(at("p", 10)) - F.col("_q")).alias("_q0"))
    b = d.filter(~F.col("_head")).select("file", F.col("_heads").alias("_c"), size.alias("_n"), "_t", "_q").join(h, ["file", "_c"])
    t = F.col("_t0") + F.col("_t")
    return b.select("file", "chrom", t.alias("t_start"), (t + F.col("_n")).alias("t_end"), "q_chrom", (F.col("_q0") + F.col("_q")).alias("q_start"), "q_strand", "q_size")


def parse_expression(lines: DataFrame) -> DataFrame:
    """(file, gene, value): first text column and first numeric column by the rows below the header, first duplicate kept,
    non-finite values dropped."""
    d = data_lines(lines, ("#",)).withColumn("p", F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).otherwise(F.split("value", ",")))
    first = d.groupBy("file").agg(F.min("line_no").alias("_head"))
    d = d.join(first, "file").filter(F.col("line_no") > F.col("_head"))
    cells = d.select("file", F.posexplode("p").alias("k", "v"))
    kinds = cells.groupBy("file", "k").agg(F.bool_and(number(F.col("v")).isNotNull() | (F.trim("v") == "")).alias("_num"))
    pick = kinds.groupBy("file").agg(F.min(F.when(F.col("_num"), F.col("k"))).alias("_v"), F.min(F.when(~F.col("_num"), F.col("k"))).alias("_g"))
    rows = d.join(pick, "file").select("file", "line_no", F.trim(F.try_element_at("p", F.col("_g") + 1)).alias("gene"), number(F.try_element_at("p", F.col("_v") + 1)).alias("value"))
    one = rows.groupBy("file", "gene").agg(F.min_by(F.struct("value"), "line_no")["value"].alias("value"))
    return one.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")))


def classify_tables(lines: DataFrame) -> DataFrame:
    """(file, kind): track, contacts, expression or unknown, from the share of numeric and chromosome-like fields."""
    d = data_lines(lines).withColumn("p", F.when(F.contains("value", F.lit("\t")), F.split("value", "\t")).when(F.contains("value", F.lit(",")), F.split("value", ",")).otherwise(F.split(F.trim("value"), r"\s+")))
    words = ("chrom", "chr", "chrom1", "bin1", "bin_i", "gene", "start")
    d = d.filter(~((F.col("line_no") == 1) & F.arrays_overlap(F.transform("p", lambda c: F.lower(c)), F.array(*[F.lit(w) for w in words]))))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))                                                          # noqa: E731
    num = lambda k: share(number(at("p", k)).isNotNull()) > 0.95                                                                 # noqa: E731
    chromish = lambda k: share(at("p", k).rlike(r"^(chr)?([0-9]{1,2}|[XYM])$")) > 0.9                                            # noqa: E731
    bins = F.min(F.coalesce((number(at("p", 0)) % 1 == 0) & (number(at("p", 1)) % 1 == 0) & (number(at("p", 0)) >= 0) & (number(at("p", 1)) >= 0), F.lit(False)))
    g = d.groupBy("file").agg(F.mode(F.size("p")).alias("k"), *[num(k).alias(f"n{k}") for k in range(4)], *[chromish(k).alias(f"c{k}") for k in (0, 2, 3)], bins.alias("bins"))
    k, n = F.col("k"), [F.col(f"n{q}") for q in range(4)]
    any_num = n[1] | ((k >= 3) & n[2]) | ((k >= 4) & n[3])
    kind = (F.when((k == 2) & ~n[0] & n[1], "expression").when((k == 3) & n[0] & n[1] & n[2], F.when(F.col("bins"), "contacts").otherwise("unknown"))
            .when((k >= 5) & F.col("c0") & n[1] & n[2] & F.when(k >= 6, F.col("c3")).otherwise(F.col("c2")), "contacts")
            .when((k >= 3) & F.col("c0") & n[1] & n[2], "track").when((k >= 2) & ~n[0] & any_num, "expression").otherwise("unknown"))
    return g.select("file", kind.alias("kind"))


def pathogenic_counts(rows: DataFrame, symbol: str, alleles: str) -> DataFrame:
    """Pathogenic alleles per gene: the last row of a symbol counts, missing numbers are 0."""
    n = F.coalesce(number(F.col(alleles)), F.lit(0.0)).cast("int")
    return rows.groupBy(F.col(symbol).alias("gene")).agg(F.max_by(n, "line_no").alias("alleles"))


def tissue_maximum(rows: DataFrame, gene: str, tissue: str, value: str) -> DataFrame:
    """Largest value of a gene symbol per tissue."""
    return rows.groupBy(F.col(gene).alias("gene"), F.col(tissue).alias("tissue")).agg(F.max(value).alias("value"))


def symbol_set(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.trim(column).alias("gene")).distinct()


def mean_over_replicates(rows: DataFrame, symbols: DataFrame, replicates: int) -> DataFrame:
    """Mean TPM of symbols measured in all replicates (rows: replicate, gene_id, tpm; symbols: gene_id, gene), identifiers
    without their version; several identifiers of one symbol are added."""
    base = lambda c: F.split_part(F.col(c), F.lit("."), F.lit(1))                                                                # noqa: E731
    s = symbols.select(base("gene_id").alias("_id"), "gene").dropDuplicates(["_id"])
    t = rows.withColumn("_id", base("gene_id")).join(s, "_id").groupBy("gene", "replicate").agg(F.sum("tpm").alias("tpm"))
    return t.groupBy("gene").agg(F.avg("tpm").alias("tpm"), F.count(F.lit(1)).alias("_k")).filter(F.col("_k") == replicates).drop("_k")


def traces_from_rows(rows: DataFrame, copy_keys: list[str], min_share: float = 0.5, by: list[str] = ("dataset",), per: list[str] = ()) -> DataFrame:
    """Long traces from any row layout: the copy is named by its key columns (cell, homolog, fibre, ...), undetected rows
    carry NULL or NaN. Copies with fewer than min_share of the loci (of their own chromosome with per=['chrom']) are dropped."""
    from ..operators.imaging import keep_copies
    clean = lambda c: F.when(~F.isnan(c), F.col(c))                                                                              # noqa: E731
    d = rows.withColumns({"copy": F.concat_ws("|", *copy_keys), "x": clean("x"), "y": clean("y"), "z": clean("z")})
    return keep_copies(d, min_share, [*by, *per])


def nearest_kb(rows: DataFrame, pos: str = "start") -> DataFrame:
    """Loci named by the nearest kilobase (halves to even)."""
    return rows.withColumn("locus_kb", F.bround(F.col(pos) / 1000).cast("long"))


def scale_to_nm(traces: DataFrame, by: list[str] = ("dataset",), limit: float = 20.0) -> DataFrame:
    """Coordinates in micrometres (median step of a copy's consecutive loci at most `limit`) become nanometres."""
    from ..operators.imaging import adjacent_median
    m = adjacent_median(traces, by)
    f = F.when(F.col("adjacent") <= limit, 1000.0).otherwise(1.0)
    return traces.join(m, list(by)).withColumns({c: F.col(c) * f for c in "xyz"}).drop("adjacent")
