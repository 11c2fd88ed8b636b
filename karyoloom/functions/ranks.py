"""Order statistics that stay distributed when one group holds most of the rows.

A plain window over a group sorts that group in one task. Here the rows are first reduced to distinct values, then dealt by
a range sort into value buckets; totals per bucket give the offset and a window inside the bucket gives the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..core import col, cut

BUCKET_ROWS = 50_000          # distinct values that a window orders
BUCKETS = 4_000               # more values make the buckets larger instead: a window in a bucket sorts on disk


def value_buckets(df: DataFrame, by: list[str], order: str, rows: int | None = None) -> DataFrame:
    """Add `_b`, a bucket of `order` that grows along every group: one bucket when no group has more than `rows` rows, else the
    partitions of one sort of all groups, of about `rows` rows each. Equal values share a bucket."""
    # written once: the scans read it several times and must not repeat the work behind `df`
    made, rows = cut(df), rows or BUCKET_ROWS
    total, largest = made.groupBy(*by).count().agg(F.sum("count"), F.max("count")).first()
    if (largest or 0) <= rows:
        return made.withColumn("_b", F.lit(0))
    parts = min(-(-total // rows), BUCKETS)
    return cut(made.repartitionByRange(parts, *by, order).withColumn("_b", F.spark_partition_id()))


def scan(bucketed: DataFrame, by: list[str], order: str, what: Column, out: str, how: str = "sum",
         reverse: bool = False) -> DataFrame:
    """Running `how` (sum, min or max) of `what` along `order`, ties included; needs `_b` from `value_buckets`."""
    agg = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    join = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + b, "min": F.least, "max": F.greatest}[how]
    direction = (lambda c: F.col(c).desc()) if reverse else (lambda c: F.col(c).asc())
    src = bucketed.withColumn("_scan", what)
    before = W.partitionBy(*by).orderBy(direction("_b")).rowsBetween(W.unboundedPreceding, -1)
    offset = (src.groupBy(*by, "_b").agg(agg("_scan").alias("_t"))
              .withColumn("_o", agg("_t").over(before)).drop("_t"))
    inside = W.partitionBy(*by, "_b").orderBy(direction(order))
    return (src.join(offset, [*by, "_b"])
            .withColumn(out, join(F.col("_o"), agg("_scan").over(inside))).drop("_o", "_scan"))


def value_ranks(df: DataFrame, by: list[str], value: str, weight: str | None = None, out: str = "rank") -> DataFrame:
    """(by, value, ties, out): average rank, from 1, of every distinct non-null value of each group."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("ties"))
    cum = scan(value_buckets(counts, by, value), by, value, F.col("ties"), "_cum")
    return cum.select(*by, value, "ties", (F.col("_cum") - (F.col("ties") - 1) / 2).alias(out))


def average_rank(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """Rows of `df` with the average rank of `value` in their group (NULL values keep a NULL rank)."""
    return df.join(value_ranks(df, by, value, out=out).drop("ties"), [*by, value], "left")


def spearman(df: DataFrame, by: list[str], x: str, y: str, min_n: int = 3, out: str = "rho",
             n_out: str = "n") -> DataFrame:
    """Rank correlation per group over rows where both are present; NULL below `min_n` or without spread."""
    by = list(by)
    rows = df.select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")).dropna(subset=[*by, "_x", "_y"])
    largest = rows.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    if largest <= BUCKET_ROWS:                 # groups that a window orders: dealt once, both ranks in place
        def rank(c: str) -> Column:
            ties = F.count(F.lit(1)).over(W.partitionBy(*by, c))
            return F.rank().over(W.partitionBy(*by).orderBy(c)) + (ties - 1) / 2
        r = rows.select(*by, "_x", "_y", rank("_x").alias("_rx"), rank("_y").alias("_ry"), F.lit(1).alias("_w"))
    else:
        cells = cut(rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_w")))
        rx = value_ranks(cells, by, "_x", "_w", "_rx").drop("ties")
        ry = value_ranks(cells, by, "_y", "_w", "_ry").drop("ties")
        r = cells.join(rx, [*by, "_x"]).join(ry, [*by, "_y"])
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    s = r.groupBy(*by).agg(F.sum(w).alias("_n"), F.sum(w * a).alias("_a"), F.sum(w * b).alias("_b"),
                           F.sum(w * a * a).alias("_aa"), F.sum(w * b * b).alias("_bb"), F.sum(w * a * b).alias("_ab"))
    n = F.col("_n")
    va, vb = n * F.col("_aa") - F.col("_a") ** 2, n * F.col("_bb") - F.col("_b") ** 2
    rho = (n * F.col("_ab") - F.col("_a") * F.col("_b")) / F.sqrt(va * vb)
    return s.select(*by, n.alias(n_out), F.when((n >= min_n) & (va > 0) & (vb > 0), rho).alias(out))


def bh_table(df: DataFrame, by: list[str], p: str = "p", out: str = "q", most: int | None = None) -> DataFrame:
    """(by, p, out): false-discovery q-value of every distinct p of each family. Where the caller knows that no family has more
    than `most` rows, and a window orders as many, nothing is written in between."""
    counts = df.filter(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_c"))
    if most is not None and most <= BUCKET_ROWS:
        w = W.partitionBy(*by)
        up, down = w.orderBy(p).rowsBetween(W.unboundedPreceding, 0), w.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
        cum = counts.dropna(subset=by).withColumns({"_cum": F.sum("_c").over(up), "_m": F.sum("_c").over(w)})
        return cum.select(*by, p, F.least(F.min(F.col(p) * F.col("_m") / F.col("_cum")).over(down), F.lit(1.0)).alias(out))
    b = value_buckets(counts, by, p)
    b = cut(scan(b, by, p, F.col("_c"), "_cum").join(b.groupBy(*by).agg(F.sum("_c").alias("_m")), by))
    q = scan(b, by, p, F.col(p) * F.col("_m") / F.col("_cum"), "_q", "min", reverse=True)
    return q.select(*by, p, F.least(F.col("_q"), F.lit(1.0)).alias(out))


def benjamini_hochberg(df: DataFrame, by: list[str], p: str = "p", out: str = "q") -> DataFrame:
    """Rows with the q-value of `p` inside each family; NULL p-values get NULL."""
    return df.join(bh_table(df, by, p, out), [*by, p], "left")


def share_at_or_below(df: DataFrame, by: list[str], value: str, reference: DataFrame, ref_value: str,
                      out: str = "pct") -> DataFrame:
    """Share of reference values <= each value, by group (merged distinct values, one running count)."""
    mine = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v")).distinct().withColumn("_c", F.lit(0))
    ref = (reference.filter(F.col(ref_value).isNotNull()).groupBy(*by, F.col(ref_value).alias("_v"))
           .agg(F.count(F.lit(1)).alias("_c")))
    merged = mine.unionByName(ref).groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    cum = scan(value_buckets(merged, by, "_v"), by, "_v", F.col("_c"), "_cum")
    total = ref.groupBy(*by).agg(F.sum("_c").alias("_m"))
    pct = cum.join(total, by).select(*by, F.col("_v").alias(value), (F.col("_cum") / F.col("_m")).alias(out))
    return df.join(pct, [*by, value], "left")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """Best `k` rows per group: Spark trims each partition to k before the shuffle (WindowGroupLimit)."""
    return (df.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(col(rank) <= k))


def quantiles(df: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles per group for continuous values of any number: the built-in `percentile` keeps all
    distinct values of a group in one buffer, this keeps them in buckets."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    b = value_buckets(counts, by, value)
    d = scan(b, by, value, F.col("_c"), "_cum").join(b.groupBy(*by).agg(F.sum("_c").alias("_n")), by)
    aggs, outs = [], []
    for name, q in qs.items():
        h = F.round((F.col("_n") - 1) * F.lit(float(q)), 9)
        for side, k in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            # value of 0-based order k: the first value whose running count exceeds k
            aggs.append(F.min(F.when(F.col("_cum") > k, F.col(value))).alias(f"_{name}_{side}"))
        frac = h - F.floor(h)
        outs.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * frac).alias(name))
    return d.groupBy(*by, "_n").agg(*aggs).select(*by, *outs)


def count_below(places: DataFrame, counted: DataFrame, by: list[str], place: str, value: str, out: str) -> DataFrame:
    """(by, place, out): how many rows of `counted` lie strictly below each distinct place."""
    a = places.select(*by, F.col(place).alias("_v")).distinct().withColumn("_c", F.lit(0).cast("long"))
    b = counted.groupBy(*by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    merged = a.unionByName(b).groupBy(*by, "_v").agg(F.sum("_c").alias("_c"))
    cum = scan(value_buckets(merged, by, "_v"), by, "_v", F.col("_c"), "_cum")
    return cum.select(*by, F.col("_v").alias(place), (F.col("_cum") - F.col("_c")).alias(out))
