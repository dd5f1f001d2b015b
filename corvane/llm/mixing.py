"""Mixing sources to target weights by hash-threshold histograms, in built-in expressions only.

A document's place in its source is a 60-bit hash of its id. Every source takes the documents below a hash threshold, so a
larger budget's choice contains a smaller one's. The threshold comes from histograms: words by source and leading hash bits,
the bucket in which the budget ends, then only that bucket by its next bits, until one hash value is left. Nothing is sorted
but the at most 4,096 buckets of a source, and the sources themselves.

Targets: the sources in code point order, null last, weigh 5, 2, 1, 5, ... and share 1.5 times all words; a target stops at
twice its source's words, and the excess is shared again by weight among the others.

Cases: null text has size 0; null source is a source of its own, the last; rows without doc_id are placed by their text;
rows that share a doc_id share a place and are taken together; a source without words has target 0; empty table: empty
result; other columns are ignored by mix() and kept by take().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
LEVEL_BITS = 12
HASH_BITS = 60


def place(doc_id: Column, text: Column) -> Column:
    """60-bit hash as a long."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("?"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """source, source_size, target: one row per source. The level at which uncapped sources fill is the largest that any number of capped ones leaves."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    src = src.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)).withColumn("cap", cap * F.col("source_size"))
    fills = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, everyone = fills.rowsBetween(Window.unboundedPreceding, -1), fills.rowsBetween(0, Window.unboundedFollowing), fills.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (share * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    src = src.withColumn("level", level)
    return src.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(everyone)).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """source, source_size, target, copies (taken by every document), upto: documents with a place below it are taken once more.

    sizes: source, size, h. The rest of a target beyond whole copies ends in some bucket; each round looks only into it.
    """
    whole = (F.col("target") >= F.col("source_size")).cast("int")
    state = goals.select("source", "source_size", "target", whole.alias("copies"), (F.col("target") - whole * F.col("source_size")).alias("rest"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), F.lit(None).cast("long").alias("upto"))
    state = C.cut(state, "mixing")
    for bits in range(LEVEL_BITS, HASH_BITS + 1, LEVEL_BITS):
        shift = HASH_BITS - bits
        open_ = state.where(F.col("upto").isNull()).select(F.col("source").alias("o_source"), "prefix", "below", "rest")
        inside = sizes.where("size > 0").join(open_, F.col("source").eqNullSafe(F.col("o_source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")))
        found = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("below").alias("below"), F.first("rest").alias("rest"))
        run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        found = found.withColumn("from", F.col("below") + F.coalesce(F.sum("words").over(run), F.lit(0)))
        # the bucket in which the budget ends; one hash value ends the search: its documents are taken if that comes nearer
        ends = found.where((F.col("from") <= F.col("rest")) & (F.col("rest") < F.col("from") + F.col("words")))
        nearer = F.col("from") + F.col("words") - F.col("rest") < F.col("rest") - F.col("from")
        ends = ends.select(F.col("source").alias("e_source"), F.col("bucket").alias("e_prefix"), F.col("from").alias("e_below"), F.when(F.col("lo") == F.col("hi"), F.col("lo") + nearer.cast("long")).alias("e_upto"))
        nxt = state.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
        # no bucket: the budget takes all
        upto = F.coalesce("upto", "e_upto", F.when(F.col("e_prefix").isNull(), F.lit(1 << HASH_BITS).cast("long")))
        nxt = nxt.select("source", "source_size", "target", "copies", "rest", F.coalesce("e_prefix", "prefix").alias("prefix"), F.coalesce("e_below", "below").alias("below"), upto.alias("upto"))
        last, state = state, C.cut(nxt, "mixing")
        C.discard(last)
        if state.where(F.col("upto").isNull()).isEmpty():
            break
    return state.select("source", "source_size", "target", "copies", "upto")


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", C.n_words_of(F.col("text")).alias("size"), place(F.col("doc_id"), F.col("text")).alias("h"))


def _with_copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (source, h, ...) with source_size, target and n_copies."""
    found = found.withColumnRenamed("source", "t_source")
    n = F.col("copies") + (F.col("h") < F.col("upto")).cast("int")
    return rows.join(found, F.col("source").eqNullSafe(F.col("t_source"))).withColumn("n_copies", n)


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words the mix takes of the document), n_copies."""
    sizes = C.cut(_sizes(docs), "mixing-sizes")
    found = thresholds(sizes, targets(sizes))
    return _with_copies(sizes, found).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"), "n_copies")


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as many times as the mix takes it, with the columns they came with."""
    sizes = C.cut(_sizes(docs).select("source", "size", "h"), "mixing-sizes")
    found = thresholds(sizes, targets(sizes))
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select("source", place(F.col("doc_id"), F.col("text")).alias("h"), held.alias("held"))
    return _with_copies(rows, found).where("n_copies > 0").select(F.explode(F.array_repeat("held", F.col("n_copies"))).alias("held")).select("held.*")


#: The same rows by sorting: documents in the order of their place, up to the one at which the budget ends.
ORACLE = """
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '?' || coalesce(text, ''))), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM d GROUP BY source),
w AS (SELECT *, CASE turn WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), weight * max(level) OVER ()) AS target FROM l),
b AS (SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS copies FROM t),
c AS (SELECT d.doc_id, d.size, d.h, b.source_size, b.target, b.copies, target - copies * source_size AS rest,
  sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
  sum(d.size) OVER (PARTITION BY d.source, d.h) AS own FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
n AS (SELECT *, copies + CASE WHEN upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own)) THEN 1 ELSE 0 END AS k FROM c)
SELECT doc_id, size, source_size, target, CAST(size * k AS BIGINT) AS taken, CAST(k AS INTEGER) AS n_copies FROM n
"""
