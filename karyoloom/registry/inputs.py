"""Views that give the given tables the shape of genome data. Every view keeps all rows of its table."""

from .base import view

SPAN, RES, N = 2_000_000, 20_000, 100          # bp, bp per bin, bins

# one read pair per line item, four samples for each hundred suppliers, so maps grow in number with the data; short separations are more frequent than long ones, discounted items join five loop anchors
view("v_pairs", """
SELECT concat('s', cast(l_suppkey % 4 + 4 * cast(floor(l_suppkey / 100.0) AS bigint) AS varchar(9))) AS sample, concat('chr', l_returnflag) AS chrom1,
       CASE WHEN l_tax > 0.075 THEN 'chrN' ELSE concat('chr', l_returnflag) END AS chrom2,
       CASE WHEN l_discount > 0.085 THEN 280000 + (l_partkey % 5) * 320000 + l_orderkey * 7919 % 60000 ELSE p END AS pos1,
       CASE WHEN l_discount > 0.085 THEN 580000 + (l_partkey % 5) * 320000 + l_orderkey * 104729 % 60000
            WHEN p + 2 * k * k < 2000000 THEN p + 2 * k * k ELSE abs(p - 2 * k * k) END AS pos2
FROM (SELECT *, (l_partkey * 9973 + l_suppkey * 7919 + l_orderkey * 131) % 2000000 AS p,
             (l_orderkey * 31 + l_linenumber * 17 + l_partkey * 7) % 1000 AS k FROM {lineitem}) t""")
view("v_contacts", """
SELECT sample, chrom1 AS chrom, least(a, b) AS i, greatest(a, b) AS j, cast(count(*) AS double) AS cnt
FROM (SELECT sample, chrom1, cast(floor(pos1 / 20000.0) AS bigint) AS a, cast(floor(pos2 / 20000.0) AS bigint) AS b
      FROM {v_pairs} WHERE chrom1 = chrom2) t GROUP BY sample, chrom1, least(a, b), greatest(a, b)""", stored=True)
view("v_sizes", "SELECT sample, chrom, cast(100 AS bigint) AS n FROM {v_contacts} GROUP BY sample, chrom")
view("v_bins", "SELECT sample, chrom, n, explode(sequence(cast(0 AS bigint), n - 1)) AS bin FROM {v_sizes}",
     "SELECT sample, chrom, n, unnest(generate_series(cast(0 AS bigint), n - 1)) AS bin FROM {v_sizes}")
view("v_cover", """
SELECT b.sample, b.chrom, b.bin, b.n, coalesce(sum(c.cnt), 0) AS cov FROM {v_bins} b LEFT JOIN (
  SELECT sample, chrom, i AS bin, cnt FROM {v_contacts} UNION ALL
  SELECT sample, chrom, j AS bin, cnt FROM {v_contacts} WHERE i <> j) c
  ON b.sample = c.sample AND b.chrom = c.chrom AND b.bin = c.bin GROUP BY b.sample, b.chrom, b.bin, b.n""", stored=True)
# one weight per bin, missing where the bin is thin
view("v_weights", """
SELECT sample, chrom, bin, CASE WHEN cov >= 0.6 * m THEN 1 / sqrt(cov) END AS weight
FROM (SELECT *, avg(cov) OVER (PARTITION BY sample, chrom) AS m FROM {v_cover}) t""", stored=True)
view("v_off", "SELECT * FROM {v_contacts} WHERE i < j")
view("v_pooled", """
SELECT CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END AS sample, chrom, i, j, sum(cnt) AS cnt FROM {v_contacts}
GROUP BY CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END, chrom, i, j""")
view("v_reps", """
SELECT CASE WHEN sample IN ('s0', 's1') THEN 'a' ELSE 'b' END AS condition, sample AS replicate, chrom, i, j, cnt
FROM {v_contacts}""")
view("v_intervals", """
SELECT event_type AS chrom, cast(timestampdiff(SECOND, timestamp '2024-01-01 00:00:00', ts) AS bigint) AS start,
       cast(timestampdiff(SECOND, timestamp '2024-01-01 00:00:00', ts) AS bigint) + 600 + user_id % 7 * 9000 AS end, value, event_id
FROM {events}""", """
SELECT event_type AS chrom, date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) AS start,
       date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts) + 600 + user_id % 7 * 9000 AS end, value, event_id FROM {events}""")
view("v_chroms", "SELECT chrom, max(e) AS size FROM (SELECT chrom, end AS e FROM {v_intervals}) t GROUP BY chrom",
     'SELECT chrom, max("end") AS size FROM {v_intervals} GROUP BY chrom')
view("v_genes", """
SELECT p_name AS name, p_partkey AS gene_id, concat('chr', substr(p_brand, 7, 1)) AS chrom, p_partkey * 1000 AS start,
       p_partkey * 1000 + 500 + p_size * 100 AS end, CASE WHEN p_partkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
       p_type AS biotype,
       CASE WHEN p_partkey % 2 = 0 THEN p_partkey * 1000 ELSE p_partkey * 1000 + 500 + p_size * 100 - 1 END AS tss FROM {part}""")
view("v_expression", "SELECT p_name AS gene, p_retailprice AS value, p_partkey AS row_no FROM {part}")
view("v_blocks", """
SELECT concat('chr', cast(c_nationkey % 5 AS varchar(9))) AS chrom, c_custkey * 100 AS t_start, c_custkey * 100 + 80 AS t_end,
       concat('q', cast(c_nationkey % 5 AS varchar(9))) AS q_chrom, c_custkey * 120 AS q_start,
       CASE WHEN c_nationkey % 2 = 0 THEN '+' ELSE '-' END AS q_strand, cast(100000000 AS bigint) AS q_size FROM {customer}""")
view("v_lift", """
SELECT concat('chr', cast(o_custkey % 5 AS varchar(9))) AS chrom, o_custkey * 100 + o_orderkey % 97 AS start,
       o_custkey * 100 + o_orderkey % 97 + 1 + o_orderkey % 40 AS end, o_orderkey AS id FROM {orders}""")
view("v_beads", """
SELECT concat('m', cast(label AS varchar(9))) AS structure, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bead,
       cast(element_at(embedding, 1) AS double) * 1000 AS x, cast(element_at(embedding, 2) AS double) * 1000 AS y,
       cast(element_at(embedding, 3) AS double) * 1000 AS z, cast(element_at(embedding, 4) AS double) AS signal FROM {embeddings}""", """
SELECT concat('m', label::VARCHAR) AS structure, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS bead,
       embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y, embedding[3]::DOUBLE * 1000 AS z,
       embedding[4]::DOUBLE AS signal FROM {embeddings}""")
