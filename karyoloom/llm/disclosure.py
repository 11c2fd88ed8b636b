"""Removal of personal data, and of the terms that give it away. DataFrame functions only.

Base spans are email, ip, card and phone by pattern and check. The corpus then tells which other terms disclose a protected
entity (a distinct address or number): of the documents with the term, what share also has the entity next to it, P(e | t),
against the share of all documents, P(e). Next to it are the words that stand wholly within `around` characters before or
behind it, whatever else stands between; a whole document is no window, as any two words of a long text would meet in it. A
term next to an entity discloses it from `min_share` on, if it does so in
`min_docs` documents and tells at least `min_bits` = log2(P(e | t) / P(e)). Disclosing terms become spans of kind `term` wherever
they stand in the corpus; they are removed from `remove_share` on and generalised to [TERM] below it. Base spans always stay
as they are and are replaced by their kind.

Defined cases: a null or empty text has no spans and becomes the empty text; rows with equal ids and equal texts are one
document in all counts and each give a row; a null id is an id like any other; ties in order go by start, then kind, then end;
an empty table gives an empty result; other columns are kept. Texts of any length are read whole: patterns run without
backtracking over long runs of letters or digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import field, rows_of, stored, whole

KINDS = ("email", "ip", "card", "phone", "term")
# patterns of the base kinds; the guards in front only spare starts that can not match, and possessive counts spare retries
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "ip": ".", "phone": "+"}
TERM = r"\p{L}+"
KEY = ["_id", "_tie"]


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """The check sum of card numbers: every second digit from the right doubled, nines cast out."""
    def add(total, k):
        d = F.substring(digits, F.length(digits) - k, F.lit(1)).cast("int")
        twice = F.when(k % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _holds(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")          # noqa: E731
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.lpad(part(p), 3, "0") <= "255"))
    if kind == "card":
        return F.length(_digits(m)).between(12, 19) & _luhn(_digits(m))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _pieces(text: Column, pattern: str, kind: str, around: int) -> Column:
    """An element for each match and one for what follows the last: kind, length of the gap before, the match, whether it
    passes the check of its kind, and what stands within `around` characters before and behind it."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    most = around + 1                       # one character more tells whether a word is cut
    ends = lambda g: F.when(F.length(g) > 2 * most, F.concat(F.substring(g, 1, most), F.substring(g, -most, most))).otherwise(g)
    both = F.arrays_zip(gaps.alias("g"), found.alias("m"))
    laid = F.flatten(F.transform(both, lambda x: F.array(ends(x["g"]), F.coalesce(x["m"], F.lit(""))))) if around else F.array().cast("array<string>")
    whole_words = lambda c, cut: F.when(F.length(c) > around, F.regexp_replace(c, cut, "")).otherwise(c)                            # noqa: E731

    def piece(s, x, k):
        n = F.least(2 * k + 1, F.lit(2 * most + 1))          # gaps and matches that hold `most` characters, as no match is empty
        before = F.substring(F.array_join(F.slice(s["l"], 2 * k + 2 - n, n), ""), -most, most)
        after = F.substring(F.array_join(F.slice(s["l"], 2 * k + 3, F.lit(2 * most + 1)), ""), 1, most)
        holds = F.coalesce(_holds(kind, x["m"]), F.lit(False))
        near = [whole_words(before, r"^(\p{L}+|[^\p{L}])"), whole_words(after, r"(\p{L}+|[^\p{L}])$")] if around else [F.lit(""), F.lit("")]
        return F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), x["m"].alias("match"), holds.alias("holds"),
                        *[F.when(holds, c).alias(name) for c, name in zip(near, ("before", "after"))])

    # one struct, so that the lambda does not split the text anew for each match
    return F.flatten(F.transform(F.array(F.struct(both.alias("z"), laid.alias("l"))), lambda s: F.transform(s["z"], lambda x, k: piece(s, x, k))))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("_id"), whole(text).alias("_text")).withColumn("_tie", F.xxhash64("_text"))


def _placed(pieces: DataFrame, by: list[str]) -> DataFrame:
    """Start and end of each match from the lengths of what comes before it; pieces are ordered within one document."""
    size = F.col("gap") + F.coalesce(F.length("match"), F.lit(0))
    order = W.partitionBy(*by).orderBy("_k")
    return pieces.withColumn("end", F.sum(size).over(order)).filter("match is not null").withColumn(
        "start", F.col("end") - F.length("match"))


def base_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", around: int = 0) -> DataFrame:
    """(_id, _tie, kind, start, end, match, before, after): checked spans of the base kinds, places in characters."""
    rows = _rows(docs, doc_id, text)
    none = F.array().cast("array<struct<kind:string,gap:int,match:string,holds:boolean,before:string,after:string>>")
    has_digit = F.col("_text").rlike("[0-9]")
    each = []
    for kind, pattern in PATTERNS.items():
        hint = F.contains("_text", F.lit(HINT[kind])) if kind in HINT else F.lit(True)
        hint = hint if kind == "email" else has_digit & hint
        each.append(F.when(hint, _pieces(F.col("_text"), pattern, kind, around)).otherwise(none))
    pieces = rows.select(*KEY, F.posexplode(F.concat(*each)).alias("_k", "_p")).select(*KEY, "_k", "_p.*")
    pieces = pieces.dropDuplicates([*KEY, "_k"])
    return _placed(pieces, [*KEY, "kind"]).filter("holds").select(*KEY, "kind", "start", "end", "match", "before", "after")


def _entity(kind: Column, match: Column) -> Column:
    return F.concat_ws(":", kind, F.when(kind.isin("card", "phone"), _digits(match)).otherwise(F.lower(match)))


def disclosing_terms(docs: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_share: float = 0.5,
                     min_bits: float = 4.0, min_chars: int = 4) -> DataFrame:
    """(term, entity, share, bits): terms that stand next to an entity and exceed the thresholds, over all documents."""
    near = spans.withColumn("entity", _entity(F.col("kind"), F.col("match")))
    words = F.array_union(F.regexp_extract_all(F.lower("before"), F.lit(TERM), F.lit(0)),
                          F.regexp_extract_all(F.lower("after"), F.lit(TERM), F.lit(0)))
    seen = near.select(*KEY, "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("e_docs")).filter(F.col("e_docs") >= min_docs)
    pairs = (near.select(*KEY, "entity", F.explode(words).alias("term")).filter(F.length("term") >= min_chars).distinct()
             .groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= min_docs).join(seen, "entity"))
    pairs = stored(pairs)
    # every term is counted before the candidates are looked up: occurrences shrink to one row per term and task
    rows = _rows(docs, doc_id, text)
    keys = stored(rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_times")))
    total = keys.agg(F.count(F.lit(1)).alias("n"))
    again = keys.filter("_times > 1")
    same = (rows["_id"].eqNullSafe(again["_id"])) & (rows["_tie"] == again["_tie"])
    extra = rows.join(again, same).select(rows["_text"], rows["_id"], rows["_tie"], "_times").dropDuplicates(KEY)
    terms = lambda d: d.withColumn("term", F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))))        # noqa: E731
    counts = (terms(rows).select("term", F.lit(1).cast("bigint").alias("k"))
              .unionByName(terms(extra).select("term", (1 - F.col("_times")).alias("k"))).groupBy("term").agg(F.sum("k").alias("t_docs")))
    share = F.col("both") / F.col("t_docs")
    told = pairs.join(counts, "term").join(total, F.lit(True)).select(
        "term", "entity", share.alias("share"), F.log2(share * F.col("n") / F.col("e_docs")).alias("bits"))
    return told.filter((F.col("share") >= min_share) & (F.col("bits") >= min_bits))


def term_spans(docs: DataFrame, terms: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(_id, _tie, kind, start, end, share): every place of the terms in the documents."""
    best = stored(terms.groupBy("term").agg(F.max("share").alias("share")))
    rows = _rows(docs, doc_id, text)
    has = (rows.select(*KEY, F.explode(F.array_distinct(F.split(F.lower("_text"), r"[^\p{L}]+"))).alias("term"))
           .join(best, "term", "left_semi").select(*KEY).distinct())
    inside = rows.join(has, (rows["_id"].eqNullSafe(has["_id"])) & (rows["_tie"] == has["_tie"]), "left_semi").dropDuplicates(KEY)
    pieces = inside.select(*KEY, F.posexplode(_pieces(F.col("_text"), TERM, "term", 0)).alias("_k", "_p")).select(*KEY, "_k", "_p.*")
    return (_placed(pieces, KEY).withColumn("term", F.lower("match")).join(best, "term")
            .select(*KEY, "kind", "start", "end", "share"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 3, min_share: float = 0.5, min_bits: float = 4.0,
             remove_share: float = 0.9, around: int = 60, min_chars: int = 4) -> DataFrame:
    """`docs` with the text sanitised and `spans`: array of (start, order, end, kind, share) sorted, in characters of the old
    text. Terms that touch a base span are left out: the base span covers them."""
    base = stored(base_spans(docs, doc_id, text, around))
    terms = stored(disclosing_terms(docs, base, doc_id, text, min_docs, min_share, min_bits, min_chars))
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    both = base.select(*KEY, "kind", "start", "end", F.lit(None).cast("double").alias("share")).unionByName(
        term_spans(docs, terms, doc_id, text))
    listed = both.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind", "share"))).alias("_all"))
    fixed = F.filter("_all", lambda s: s["kind"] != "term")
    free = F.filter("_all", lambda s: (s["kind"] != "term") | ~F.exists(fixed, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    listed = listed.select(*KEY, F.when(F.exists("_all", lambda s: s["kind"] == "term"), free).otherwise(F.col("_all")).alias("spans"))
    rows = rows_of(docs, _id=F.col(doc_id), _tie=F.xxhash64(whole(text)))
    out = rows.alias("d").join(listed.alias("s"), F.col("d._id").eqNullSafe(F.col("s._id")) & (F.col("d._tie") == F.col("s._tie")), "left")
    spans = F.coalesce(F.col("s.spans"), F.array().cast(listed.schema["spans"].dataType))
    old = whole(field(text))
    shown = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(       # noqa: E731
        s["share"] >= remove_share, "").otherwise("[TERM]")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(a, s):
        gap = F.substring(old, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))
        return F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, shown(s))).alias("out")))

    rest = lambda a: F.array_join(F.concat(a["out"], F.array(F.substring(old, (a["at"] + 1).cast("int"), F.length(old)))), "")
    new = F.when(F.size(spans) == 0, old).otherwise(F.aggregate(spans, start, step, rest))
    same = [(new if c == text else field(c)).alias(c) for c in docs.columns if c != "spans"]
    return out.select(*same, spans.alias("spans"))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
