"""Text sources, catalogues, names and sinks, over lines written from the given tables."""

from pyspark.sql import functions as F

from ..core import scratch
from ..sources import catalog as CAT, names as N, sinks as SK, tables as T
from ..sources.lines import read_lines
from .base import query, view
from .maps import r

# pair files: one per supplier class, half of them with an unusual column order
view("v_pair_lines", """SELECT concat('f', cast(s AS varchar(9)), '.pairs') AS file, line_no, value FROM (
 SELECT s_suppkey % 10 AS s, cast(0 AS bigint) AS line_no, CASE WHEN s_suppkey % 2 = 0 THEN '#columns: readID chrom1 pos1 chrom2 pos2 strand1 strand2' ELSE '#columns: chrom1 chrom2 pos1 pos2' END AS value FROM {supplier} WHERE s_suppkey < 10
 UNION ALL SELECT s_suppkey % 10, 1 + s_suppkey, concat('#chromsize: chr', cast(s_suppkey AS varchar(9)), ' ', cast(1000000 + s_nationkey * 5000 AS varchar(12))) FROM {supplier}
 UNION ALL SELECT l_suppkey % 10, 1000 + l_orderkey * 10 + l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN concat_ws('\t', concat('r', cast(l_orderkey AS varchar(12))), concat('chr', l_returnflag), cast(l_partkey * 500 AS varchar(12)), concat('chr', l_returnflag), cast(l_suppkey * 9000 AS varchar(12)), '+', '-')
   ELSE concat_ws('\t', concat('chr', l_returnflag), concat('chr', l_returnflag), cast(l_partkey * 500 AS varchar(12)), cast(l_suppkey * 9000 AS varchar(12))) END FROM {lineitem}) t""")


@query("pair_file_headers", "A2", "SELECT concat('f', s_suppkey % 10, '.pairs') AS file, concat('chr', s_suppkey) AS chrom, 1000000 + s_nationkey * 5000 AS length FROM supplier")
def _(t):
    return T.chromosome_sizes(t("v_pair_lines"))


@query("pair_file_columns", "A2", "SELECT concat('f', s, '.pairs') AS file, CASE WHEN s % 2 = 0 THEN 'readID,chrom1,pos1,chrom2,pos2,strand1,strand2' ELSE 'chrom1,chrom2,pos1,pos2' END AS columns FROM (SELECT DISTINCT s_suppkey % 10 AS s FROM supplier) t")
def _(t):
    return T.pair_columns(t("v_pair_lines")).select("file", F.array_join("columns", ",").alias("columns"))


@query("parse_pairs", "A1, A2", "SELECT concat('f', l_suppkey % 10, '.pairs') AS file, concat('chr', l_returnflag) AS chrom1, l_partkey * 500 AS pos1, concat('chr', l_returnflag) AS chrom2, l_suppkey * 9000 AS pos2 FROM lineitem")
def _(t):
    return T.parse_pairs(t("v_pair_lines"))


view("v_contact_lines", """SELECT concat('t', cast(l_suppkey % 3 AS varchar(9))) AS file, l_orderkey * 10 + l_linenumber AS line_no, CASE l_suppkey % 3 WHEN 0 THEN concat_ws('\t', cast(l_partkey % 90 AS varchar(9)), cast(l_suppkey % 70 AS varchar(9)), cast(l_linenumber AS varchar(9)))
 WHEN 1 THEN concat_ws(' ', '1', cast(l_partkey % 90 * 1000 AS varchar(9)), CASE WHEN l_tax > 0.07 THEN 'chr2' ELSE 'chr1' END, cast(l_suppkey % 70 * 1000 + 5 AS varchar(9)), '2')
 ELSE concat_ws('\t', 'chr3', cast(l_partkey % 90 * 1000 AS varchar(9)), cast(l_partkey % 90 * 1000 + 1000 AS varchar(9)), '3', cast(l_suppkey % 70 * 1000 AS varchar(9)), cast(l_suppkey % 70 * 1000 + 1000 AS varchar(9))) END AS value FROM {lineitem}""")


@query("parse_contact_tables", "A3", """SELECT file, chrom, least(i, j) AS i, greatest(i, j) AS j, cast(sum(c) AS DOUBLE) AS cnt FROM (SELECT concat('t', l_suppkey % 3) AS file, CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'chr1' ELSE 'chr3' END AS chrom, l_partkey % 90 AS i, l_suppkey % 70 AS j, CASE l_suppkey % 3 WHEN 0 THEN l_linenumber WHEN 1 THEN 2 ELSE 1 END AS c FROM lineitem
  WHERE l_suppkey % 3 <> 1 OR l_tax <= 0.07) t WHERE i <> j GROUP BY file, chrom, least(i, j), greatest(i, j)""")
def _(t):
    return T.parse_contacts(t("v_contact_lines"), 1000)


view("v_track_lines", """SELECT CASE WHEN user_id % 2 = 0 THEN 'a.bedGraph' WHEN user_id % 3 = 0 THEN 'b.bed' ELSE 'c.bed' END AS file, event_id AS line_no, CASE WHEN user_id % 2 = 0 THEN concat_ws('\t', 'chr1', cast(event_id * 7 AS varchar(12)), cast(event_id * 7 + 90 AS varchar(12)), cast(user_id % 13 AS varchar(12)))
 WHEN user_id % 3 = 0 THEN concat_ws('\t', '2', cast(event_id * 5 AS varchar(12)), cast(event_id * 5 + 40 AS varchar(12)), 'n', cast(user_id % 17 AS varchar(12))) ELSE concat_ws('\t', '2', cast(event_id * 5 AS varchar(12)), cast(event_id * 5 + 40 AS varchar(12))) END AS value FROM {events}""")


@query("parse_intervals", "A10", """SELECT CASE WHEN user_id % 2 = 0 THEN 'a.bedGraph' WHEN user_id % 3 = 0 THEN 'b.bed' ELSE 'c.bed' END AS file, CASE WHEN user_id % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, CASE WHEN user_id % 2 = 0 THEN event_id * 7 ELSE event_id * 5 END AS start, CASE WHEN user_id % 2 = 0 THEN event_id * 7 + 90 ELSE event_id * 5 + 40 END AS "end",
  cast(CASE WHEN user_id % 2 = 0 THEN user_id % 13 WHEN user_id % 3 = 0 THEN user_id % 17 ELSE 1 END AS DOUBLE) AS value FROM events""")
def _(t):
    return T.parse_intervals(t("v_track_lines"))


view("v_peak_lines", """SELECT 'p.narrowPeak' AS file, l_orderkey * 10 + l_linenumber AS line_no, CASE WHEN l_linenumber % 2 = 0 THEN concat_ws('\t', 'chr1', cast(l_partkey AS varchar(12)), cast(l_partkey + l_suppkey % 50 AS varchar(12)), 'p', '0', '.', cast(l_linenumber AS varchar(3)), '1', '1', cast(l_suppkey % 9 AS varchar(9)))
 ELSE concat_ws('\t', 'chr2', cast(l_partkey AS varchar(12)), cast(l_partkey + l_suppkey % 50 AS varchar(12))) END AS value FROM {lineitem} UNION ALL SELECT 'p.narrowPeak', 0, 'track name=x' FROM {region}""")


@query("parse_peaks", "A22", """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'chr1' ELSE 'chr2' END AS chrom, l_partkey AS start, l_partkey + l_suppkey % 50 AS "end", CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 9 ELSE -1 END AS summit, CASE WHEN l_linenumber % 2 = 0 THEN cast(l_linenumber AS DOUBLE) END AS signal,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey + l_suppkey % 9 ELSE (2 * l_partkey + l_suppkey % 50) // 2 END AS mid FROM lineitem WHERE l_suppkey % 50 > 0""")
def _(t):
    return T.peak_positions(T.parse_peaks(t("v_peak_lines"))).drop("file")


view("v_chain_lines", """SELECT 'x.chain' AS file, c_custkey * 4 + k AS line_no, CASE k WHEN 0 THEN concat_ws(' ', 'chain', '1', concat('chr', cast(c_nationkey AS varchar(9))), '9', '+', cast(c_custkey * 1000 AS varchar(12)), '9', concat('q', cast(c_nationkey AS varchar(9))), '1000000', CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END, cast(c_custkey * 900 AS varchar(12)), '9', '1')
 WHEN 1 THEN concat_ws('\t', '100', '10', cast(c_nationkey AS varchar(9))) WHEN 2 THEN '50' ELSE '' END AS value FROM {customer} CROSS JOIN (SELECT r_regionkey AS k FROM {region} WHERE r_regionkey < 4) r""")


@query("parse_chain", "D3", """SELECT concat('chr', c_nationkey) AS chrom, c_custkey * 1000 + k * 110 AS t_start, c_custkey * 1000 + k * 110 + CASE k WHEN 0 THEN 100 ELSE 50 END AS t_end, concat('q', c_nationkey) AS q_chrom, c_custkey * 900 + k * (100 + c_nationkey) AS q_start, CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS q_strand, 1000000 AS q_size
FROM customer CROSS JOIN (SELECT unnest([0, 1]) AS k) r""")
def _(t):
    return T.parse_chain(t("v_chain_lines")).drop("file")


view("v_expr_lines", """SELECT CASE WHEN p_size % 2 = 0 THEN 'e1.tsv' ELSE 'e2.csv' END AS file, p_partkey + 2 AS line_no, CASE WHEN p_size % 2 = 0 THEN concat_ws('\t', p_name, cast(p_partkey % 77 AS varchar(9)), p_brand) ELSE concat_ws(',', cast(p_partkey % 50 AS varchar(9)), p_name, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE '4' END) END AS value FROM {part}
 UNION ALL SELECT CASE WHEN r_regionkey = 0 THEN 'e1.tsv' ELSE 'e2.csv' END, 1, CASE WHEN r_regionkey = 0 THEN concat_ws('\t', 'gene', 'tpm', 'note') ELSE 'tpm,gene,extra' END FROM {region} WHERE r_regionkey < 2""")


@query("parse_expression", "A23", "SELECT CASE WHEN p_size % 2 = 0 THEN 'e1.tsv' ELSE 'e2.csv' END AS file, p_name AS gene, cast(arg_min(CASE WHEN p_size % 2 = 0 THEN p_partkey % 77 ELSE p_partkey % 50 END, p_partkey) AS DOUBLE) AS value FROM part GROUP BY CASE WHEN p_size % 2 = 0 THEN 'e1.tsv' ELSE 'e2.csv' END, p_name")
def _(t):
    return T.parse_expression(t("v_expr_lines"))


@query("classify_tables", "A12", "SELECT * FROM (VALUES ('a.bedGraph', 'track'), ('b.bed', 'track'), ('c.bed', 'contacts'), ('e1.tsv', 'expression'), ('e2.csv', 'unknown'), ('t0', 'contacts'), ('t1', 'unknown'), ('t2', 'contacts')) v(file, kind)")
def _(t):
    lines = t("v_track_lines").unionByName(t("v_expr_lines")).unionByName(t("v_contact_lines"))
    return T.classify_tables(lines)


PATHS = """SELECT o_orderkey, concat_ws('/', CASE o_orderpriority WHEN '1-URGENT' THEN 'Patient_data' WHEN '2-HIGH' THEN 'normalized' WHEN '3-MEDIUM' THEN 'WT-samples' WHEN '4-NOT SPECIFIED' THEN 'senescent' ELSE 'misc' END,
 concat(CASE o_orderstatus WHEN 'F' THEN 'abnormal' WHEN 'O' THEN 'run' ELSE 'control_tumor' END, '_chr', cast(o_custkey % 22 + 1 AS varchar(3)), '_', cast(o_orderkey AS varchar(12)), CASE WHEN o_custkey % 3 = 0 THEN '.bed' WHEN o_custkey % 3 = 1 THEN '.npy' ELSE '.mcool' END)) AS path FROM {orders}"""
view("v_paths", PATHS)


@query("describe_paths", "A13", """SELECT o_orderkey, path, CASE WHEN o_custkey % 3 = 0 THEN 'track' WHEN o_custkey % 3 = 1 THEN 'structure' ELSE 'contacts' END AS kind, concat('chr', o_custkey % 22 + 1) AS chrom,
 CASE WHEN o_orderstatus = 'F' THEN 'Disease State / Cancer' WHEN o_orderstatus = 'O' OR o_orderstatus NOT IN ('F', 'O') AND false THEN d WHEN length('control') > length('tumor') THEN 'Healthy Control' END AS state FROM (
 SELECT o.*, p.path, CASE o_orderpriority WHEN '1-URGENT' THEN 'Disease State / Cancer' WHEN '3-MEDIUM' THEN 'Healthy Control' WHEN '4-NOT SPECIFIED' THEN 'Senescent State' END AS d FROM orders o JOIN v_paths p USING (o_orderkey)) t""")
def _(t):
    return CAT.describe(t("v_paths"))


@query("files_by_state", "A13", """SELECT CASE l_returnflag WHEN 'A' THEN 'Healthy Control' WHEN 'N' THEN 'Disease State / Cancer' END AS state, concat('chr', l_linenumber) AS chrom, CASE WHEN l_linestatus = 'O' THEN 'table' ELSE 'unsupported' END AS kind,
 count(*) AS lines, sum(length(concat(l_orderkey, '')) + 1) AS bytes FROM lineitem GROUP BY ALL""")
def _(t):
    rows = t("lineitem").select(F.concat(F.when(F.col("l_returnflag") == "A", "control").when(F.col("l_returnflag") == "N", "tumor").otherwise("run"), F.lit("_chr"), F.col("l_linenumber").cast("string")).alias("folder"),
                                F.col("l_orderkey").cast("string").alias("value"), "l_linestatus")
    root = scratch(t.spark, "catalogue")
    for status, end in (("O", "csv"), ("F", "dat")):
        at = rows.filter(F.col("l_linestatus") == status).drop("l_linestatus")
        at.write.partitionBy("folder").option("extension", end).csv(f"{root}/{end}")
    files = CAT.scan_folder(t.spark, root)
    counts = read_lines(t.spark, f"{root}/*/*", numbered=False).groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    named = files.withColumn("_f", F.regexp_replace("file", "^file:/+", "/")).join(counts.withColumn("_f", F.regexp_replace("file", "^file:/+", "/")).drop("file"), "_f")
    return named.groupBy("state", "chrom", "kind").agg(F.sum("lines").alias("lines"), F.sum("length").alias("bytes"))


view("v_files", "SELECT concat('b', cast(p_size AS varchar(9))) AS state, concat('dir', cast(p_partkey % 3 AS varchar(3)), '/', replace(p_name, ' ', '_'), '_', cast(p_partkey % 5 AS varchar(3)), '.bed') AS path, p_partkey % 4 AS n, p_partkey, p_partkey % 6 = 0 AS genomic FROM {part}")


@query("best_track", "A14", """WITH s AS (SELECT state, path AS structure, n AS sn, list_distinct(list_filter(string_split_regex(regexp_replace(lower(path), '\\.[^./]*$', ''), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS ts, regexp_extract(path, '^(.*)/[^/]*$', 1) AS sd FROM v_files WHERE p_partkey % 2 = 0),
t AS (SELECT state, path AS track, n AS tn, genomic, list_distinct(list_filter(string_split_regex(regexp_replace(lower(path), '\\.[^./]*$', ''), '[^a-z0-9]+'), lambda x: length(x) > 1)) AS tt, regexp_extract(path, '^(.*)/[^/]*$', 1) AS td FROM v_files WHERE p_partkey % 2 = 1),
j AS (SELECT *, CASE WHEN tn = sn THEN 2 WHEN tn = 3 OR genomic THEN 1 ELSE 0 END AS length_score, CASE WHEN sd = td THEN 1 ELSE 0 END AS same_folder, len(list_intersect(ts, tt)) AS shared FROM s JOIN t USING (state))
SELECT DISTINCT state, structure, track, length_score, same_folder, shared FROM (SELECT *, row_number() OVER (PARTITION BY state, structure ORDER BY length_score DESC, same_folder DESC, shared DESC, track) AS k FROM j WHERE length_score > 0) q WHERE k = 1""")
def _(t):
    f = t("v_files")
    s = f.filter("p_partkey % 2 = 0").select("state", F.col("path").alias("structure"), "n", F.lit(3).alias("n_full"))
    k = f.filter("p_partkey % 2 = 1").select("state", F.col("path").alias("track"), F.col("n").alias("track_n"), "genomic")
    return CAT.best_track(s, k)


@query("state_plan", "A14", """SELECT state, path, kind, row_number() OVER (PARTITION BY state, kind ORDER BY CASE WHEN origin = 'upload' THEN 0 ELSE 1 END, lower(path), path) AS position FROM (
 SELECT state, concat(path, p_partkey) AS path, CASE WHEN n = 1 THEN 'track' ELSE 'structure' END AS kind, CASE WHEN genomic THEN 'upload' ELSE 'folder' END AS origin FROM v_files) t""")
def _(t):
    f = t("v_files").select("state", F.concat("path", F.col("p_partkey").cast("string")).alias("path"), F.when(F.col("n") == 1, "track").otherwise("structure").alias("kind"), F.when(F.col("genomic"), "upload").otherwise("folder").alias("origin"))
    return CAT.state_plan(f).drop("origin")


view("v_names", """SELECT o_orderkey, CASE o_custkey % 9 WHEN 0 THEN cast(o_custkey % 22 + 1 AS varchar(5)) WHEN 1 THEN concat('Chr', cast(o_custkey % 22 + 1 AS varchar(5))) WHEN 2 THEN 'chrMT' WHEN 3 THEN 'x' WHEN 4 THEN 'NC_000009.12' WHEN 5 THEN 'CM000684.2' WHEN 6 THEN 'chrUn_KI270302v1' WHEN 7 THEN ' chry ' ELSE 'scaffold' END AS raw FROM {orders}""")


@query("normalize_chromosomes", "A15", """SELECT o_orderkey, raw, CASE WHEN regexp_matches(raw, '^[0-9]+$') THEN concat('chr', raw) WHEN raw LIKE 'Chr%' THEN concat('chr', substr(raw, 4)) WHEN raw = 'chrMT' THEN 'chrM' WHEN raw = 'x' THEN 'chrX' WHEN raw LIKE 'NC%' THEN 'chr9' WHEN raw LIKE 'CM%' THEN 'chr22'
 WHEN raw LIKE 'chrUn%' THEN raw WHEN raw LIKE '%chry%' THEN 'chrY' END AS chrom_norm FROM v_names""")
def _(t):
    alias = t("region").filter("r_regionkey = 0").select(F.lit("cm000684").alias("alias"), F.lit("chr22").alias("ucsc"))
    return N.normalize(t("v_names"), "raw", alias)


@query("rejected_names", "A15", "SELECT 'scaffold' AS raw, count(*) AS rows FROM v_names WHERE raw = 'scaffold'")
def _(t):
    return N.rejects(N.normalize(t("v_names"), "raw"), "raw").filter("raw = 'scaffold'")


view("v_lengths", """SELECT c_custkey AS file, chrom, CASE WHEN chrom IN ('1', 'chrX') THEN CASE c_nationkey % 5 WHEN 0 THEN CASE WHEN chrom = '1' THEN 248956422 ELSE 156040895 END WHEN 1 THEN CASE WHEN chrom = '1' THEN 195471971 ELSE 171031299 END WHEN 2 THEN CASE WHEN chrom = '1' THEN 248956422 ELSE 5 END WHEN 3 THEN CASE WHEN chrom = '1' THEN 249250621 ELSE 155270560 END ELSE 7 END ELSE 99 END AS length
FROM {customer} CROSS JOIN (SELECT CASE r_regionkey WHEN 0 THEN '1' WHEN 1 THEN 'chrX' ELSE 'chr7' END AS chrom FROM {region} WHERE r_regionkey < 3) r""")


@query("detect_assembly", "A16", "SELECT c_custkey AS file, CASE c_nationkey % 5 WHEN 0 THEN 'hg38' WHEN 1 THEN 'mm10' WHEN 3 THEN 'hg19' END AS assembly FROM customer")
def _(t):
    return N.detect_assembly(t("v_lengths"))


@query("assembly_mismatch", "A16", "SELECT c_custkey AS file, CASE c_nationkey % 5 WHEN 1 THEN 'mm10' ELSE 'hg19' END AS assembly FROM customer WHERE c_nationkey % 5 IN (1, 3)")
def _(t):
    return N.assembly_mismatch(N.detect_assembly(t("v_lengths")), "hg38")


@query("traces_from_rows", "A24", """SELECT dataset, copy, locus FROM (SELECT concat('set', label % 2) AS dataset, concat_ws('|', label, vec_id % 2) AS copy, vec_id // 100 AS locus, embedding[4] > -0.1 AS seen, count(*) FILTER (embedding[4] > -0.1) OVER (PARTITION BY label, vec_id % 2) AS k FROM embeddings) t
JOIN (SELECT concat('set', label % 2) AS ds, count(DISTINCT vec_id // 100) AS n FROM embeddings GROUP BY ALL) q ON q.ds = dataset WHERE k >= 0 AND copy IN (SELECT concat_ws('|', label, vec_id % 2) FROM embeddings WHERE embedding[4] > -0.1 GROUP BY label, vec_id % 2, label % 2
  HAVING count(DISTINCT vec_id // 100) >= 0.5 * (SELECT count(DISTINCT vec_id // 100) FROM embeddings e2 WHERE e2.label % 2 = embeddings.label % 2))""")
def _(t):
    e = F.col("embedding")
    seen = e[3] > -0.1
    rows = t("embeddings").select(F.concat(F.lit("set"), F.col("label") % 2).alias("dataset"), F.col("label").alias("cell"), (F.col("vec_id") % 2).alias("homolog"), F.floor(F.col("vec_id") / 100).alias("locus"),
                                  *[F.when(seen, e[k].cast("double")).otherwise(float("nan")).alias(c) for k, c in enumerate("xyz")])
    return T.traces_from_rows(rows, ["cell", "homolog"]).select("dataset", "copy", "locus")


@query("scale_to_nm", "A24", """WITH d AS (SELECT a.dataset, quantile_cont(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) / 40, 0.5) AS m FROM v_traces a JOIN v_traces b ON a.dataset = b.dataset AND a.copy = b.copy AND b.locus = a.locus + 1 WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL)
SELECT dataset, copy, locus, round(x / 40 * CASE WHEN m <= 20 THEN 1000 ELSE 1 END, 6) AS x FROM v_traces JOIN d USING (dataset)""")
def _(t):
    tr = t("v_traces").withColumns({c: F.col(c) / 40 for c in "xyz"})
    return r(T.scale_to_nm(tr), "x").select("dataset", "copy", "locus", "x")


@query("nearest_kb", "A24", "SELECT o_orderkey, cast(round_even(o_custkey * 137 / 1000.0, 0) AS BIGINT) AS locus_kb FROM orders")
def _(t):
    return T.nearest_kb(t("orders").select("o_orderkey", (F.col("o_custkey") * 137).alias("start"))).select("o_orderkey", "locus_kb")


@query("pathogenic_counts", "A26", "SELECT p_name AS gene, arg_max(CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END, p_partkey) AS alleles FROM part GROUP BY p_name")
def _(t):
    rows = t("part").select("p_name", F.when(F.col("p_size") % 7 == 0, "-").otherwise(F.col("p_size").cast("string")).alias("n"), F.col("p_partkey").alias("line_no"))
    return T.pathogenic_counts(rows, "p_name", "n")


@query("tissue_maximum", "A26", "SELECT p_name AS gene, p_brand AS tissue, max(p_retailprice) AS value FROM part GROUP BY p_name, p_brand")
def _(t):
    return T.tissue_maximum(t("part"), "p_name", "p_brand", "p_retailprice")


@query("symbol_set", "A26", "SELECT DISTINCT p_name AS gene FROM part")
def _(t):
    return T.symbol_set(t("part").withColumn("s", F.concat(F.lit(" "), "p_name")), "s")


@query("mean_over_replicates", "A26", """SELECT gene, round(avg(v), 6) AS tpm FROM (SELECT p_name AS gene, l_linenumber AS rep, sum(l_quantity) AS v FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL) t GROUP BY gene HAVING count(*) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)""")
def _(t):
    reps = t("lineitem").agg(F.countDistinct("l_linenumber")).first()[0]
    rows = t("lineitem").select(F.col("l_linenumber").alias("replicate"), F.concat(F.lit("ENSG"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_suppkey").cast("string")).alias("gene_id"), F.col("l_quantity").alias("tpm"))
    sym = t("part").select(F.concat(F.lit("ENSG"), F.col("p_partkey").cast("string"), F.lit(".1")).alias("gene_id"), F.col("p_name").alias("gene"))
    return r(T.mean_over_replicates(rows, sym, reps), "tpm")


@query("bed_lines", "A27", "SELECT concat_ws('\t', chrom, start, \"end\", name) AS value FROM v_genes")
def _(t):
    return SK.bed_lines(t("v_genes"), "name")


@query("bedgraph_lines", "A27", "SELECT concat_ws('\t', chrom, bin * 20000, (bin + 1) * 20000, printf('%g', cov / 7.0)) AS value FROM v_cover JOIN v_weights USING (sample, chrom, bin) WHERE weight IS NOT NULL")
def _(t):
    d = t("v_cover").join(t("v_weights"), ["sample", "chrom", "bin"]).select("chrom", (F.col("bin") * 20_000).alias("start"), ((F.col("bin") + 1) * 20_000).alias("end"), F.when(F.col("weight").isNotNull(), F.col("cov") / 7).alias("v"))
    return SK.bedgraph_lines(d, "v")


@query("significant_digits", "A27", "SELECT l_orderkey, l_linenumber, printf('%g', l_extendedprice * l_discount * l_tax / 300 * pow(10.0, l_linenumber - 4)) AS text FROM lineitem")
def _(t):
    v = F.col("l_extendedprice") * F.col("l_discount") * F.col("l_tax") / 300 * F.pow(F.lit(10.0), F.col("l_linenumber") - 4)
    return t("lineitem").select("l_orderkey", "l_linenumber", SK.significant(v).alias("text"))


@query("juicer_short_lines", "A27", "SELECT concat_ws(' ', '0', substr(chrom, 4), i * 20000, '0', '0', substr(chrom, 4), j * 20000, '1', printf('%g', cnt)) AS value FROM v_contacts")
def _(t):
    return SK.juicer_short_lines(t("v_contacts"), 20_000)


@query("loop_lines", "A27", "SELECT concat_ws('\t', chrom, a, a + 20000, chrom, b, b + 20000) AS value, concat_ws('\t', substr(chrom, 4), a, a + 20000, substr(chrom, 4), b, b + 20000, '0,255,255', 'loop') AS juicebox FROM v_loops")
def _(t):
    d = t("v_loops").select("sample", F.col("chrom").alias("chrom1"), F.col("a").alias("start1"), (F.col("a") + 20_000).alias("end1"), F.col("chrom").alias("chrom2"), F.col("b").alias("start2"), (F.col("b") + 20_000).alias("end2"))
    a = SK.bedpe_lines(d, ["sample"]).withColumn("k", F.regexp_extract("value", r"^(.*)\t[^\t]*$", 1))
    j = SK.juicebox_lines(d).withColumnRenamed("value", "juicebox").groupBy("juicebox").count()
    k = a.groupBy(F.col("k").alias("value")).count()
    key = lambda c: F.regexp_replace(c, r"chr|\t0,255,255\tloop", "")                # noqa: E731
    return k.withColumn("_k", key("value")).join(j.withColumn("_k", key("juicebox")).drop("count"), "_k").select("value", "juicebox", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_n")).drop("_n")


@query("run_record", "A28")
def _(t):
    files = SK.input_digests(t.spark, [f"{t.folder}/nation.parquet", f"{t.folder}/orders.parquet"])
    rec = SK.run_record(files, "bin_pairs", {"resolution": 20_000, "regions": [1, 2, 3]})
    return rec.select("command", F.col("parameters")["regions"].alias("regions"), F.size("inputs").alias("inputs"), F.length("record_sha256").alias("digest_length"))
