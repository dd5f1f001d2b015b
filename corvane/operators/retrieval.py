"""Exact dense search, BM25, fusion of rankings, relevance by quoted spans, ranking metrics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .duplicates import dot

K1, B = 1.5, 0.75  # BM25's usual constants


def top_k(scored: DataFrame, query: str, item: str, score: str, k: int) -> DataFrame:
    """query, item, score, rank from 1: the k best of each query, equal scores by item. The rank limit is pushed below the sort."""
    w = Window.partitionBy(query).orderBy(F.desc(score), item)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query, item, score, "rank")


#: Queries that go to every task at once.
QUERIES = 4096


def dense_top_k(queries: DataFrame, corpus: DataFrame, query: str, item: str, k: int, digits: int = 9) -> DataFrame:
    """Inner-product search of a stated query set (query, q_vec) against all rows (item, vec): query, item, score, rank.

    The queries go through the corpus in blocks of about QUERIES, each a matrix that every task multiplies its rows with; a task keeps the k
    best of each query, and those are merged by query. Scores are rounded, so that equal vectors tie; ties go to the lesser item.
    """
    asked = queries.where("q_vec is not null").select(query, F.col("q_vec").cast("array<double>").alias("q_vec"))
    blocks = max(1, -(-asked.count() // QUERIES))
    kinds = dict(queries.dtypes)[query], dict(corpus.dtypes)[item]
    rows = corpus.where("vec is not null").select(item, F.col("vec").cast("array<double>").alias("vec"))
    parts = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64(query), F.lit(blocks)) == b).toArrow()
        part = rows.mapInArrow(_best_of(block, query, item, k, digits), f"{query} {kinds[0]}, {item} {kinds[1]}, score double")
        parts = part if parts is None else parts.unionByName(part)
    return top_k(parts, query, item, "score", k)


def _best_of(block: pa.Table, query: str, item: str, k: int, digits: int):
    names = block.column(query).combine_chunks()
    matrix = np.array(block.column("q_vec").to_pylist(), float).reshape(len(names), -1)

    def run(batches):
        items, scores = [None] * len(names), [None] * len(names)  # the best so far of each query
        kind = None
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            kind, own = batch.column(0).type, np.array(batch.column(0).to_pylist())
            found = np.round(np.array(batch.column(1).to_pylist(), float) @ matrix.T, digits)
            for q in range(len(names)):
                s, i = found[:, q], own
                if len(s) > k:  # all that tie with the k-th stay
                    near = s >= np.partition(s, len(s) - k)[len(s) - k]
                    s, i = s[near], i[near]
                if items[q] is not None:
                    s, i = np.concatenate([scores[q], s]), np.concatenate([items[q], i])
                best = np.lexsort((i, -s))[:k]
                scores[q], items[q] = s[best], i[best]
        if kind is not None:
            at = np.repeat(np.arange(len(names)), [len(x) for x in items])
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at)), pa.array(np.concatenate(items).tolist(), kind), pa.array(np.concatenate(scores))], [query, item, "score"])

    return run


def bm25(queries: DataFrame, corpus: DataFrame, query: str, item: str, q_text: str, text: str, stop: list[str] | None = None) -> DataFrame:
    """query, item, score of all items that share a term with the query. Only the postings of query terms are joined."""
    kept = F.filter(X.tokens(text), lambda t: ~t.isin(stop)) if stop else X.tokens(text)
    length = corpus.select(item, F.size(kept).alias("dl")).where("dl > 0")
    size = length.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))
    wanted = queries.select(query, F.explode(F.array_distinct(X.tokens(q_text))).alias("term"))
    posted = corpus.select(item, F.explode(kept).alias("term")).join(wanted.select("term").distinct(), "term", "left_semi")
    df = posted.groupBy(item, "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    posts = df.join(idf, "term").join(length, item).crossJoin(F.broadcast(size))  # size: one row
    idf_value = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf_value * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    posts = posts.select(item, "term", weight.alias("w"))
    return posts.join(wanted, "term").groupBy(query, item).agg(F.sum("w").alias("score"))


def rrf(rankings: list[DataFrame], query: str, item: str, k: int = 60, depth: int = 100) -> DataFrame:
    """query, item, score: sum over rankings of 1 / (k + rank), ranks from 1 and up to depth."""
    parts = [r.where(F.col("rank") <= depth).select(query, item, (1.0 / (k + F.col("rank"))).alias("part")) for r in rankings]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(query, item).agg(F.sum("part").alias("score"))


def metrics(ranked: DataFrame, relevant: DataFrame, queries: DataFrame, query: str, item: str, ks=(1, 5, 10), mrr_at: int = 10, by: list[str] | None = None) -> DataFrame:
    """Share of queries with a relevant item within k, and mean reciprocal rank; queries without any count 0."""
    by = by or []
    hits = ranked.join(relevant.select(query, item).distinct(), [query, item]).groupBy(query).agg(F.min("rank").alias("first"))
    rows = queries.select(query, *by).join(hits, query, "left")
    aggs = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks]
    mrr = F.avg(F.when(F.col("first") <= mrr_at, 1.0 / F.col("first")).otherwise(F.lit(0.0))).alias("mrr")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *aggs, mrr)


def containing(spans: DataFrame, texts: DataFrame, span_key: str, span: str, key: str, text: str, n: int = 4) -> DataFrame:
    """span_key, key where the text contains the span (white space aside): candidates share the span's n-word shingle that fewest texts hold.

    Spans of fewer than n + 2 words share their rarest inner word; spans of one or two words are searched in every text.
    """
    s = spans.select(F.col(span_key).alias("sk"), X.ws(span).alias("s")).where(F.length("s") > 0)
    t = texts.select(F.col(key).alias("k"), X.ws(text).alias("t"))
    # a span's first and last word may be parts of words in the text: only the inner ones make shingles
    grams = lambda w, a, b: F.array_distinct(F.transform(F.sequence(a, b), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, n), " "))))
    of_text = X.let(F.split("t", " "), lambda w: F.when(F.size(w) >= n, grams(w, F.lit(0), F.size(w) - n)))
    of_span = X.let(F.split("s", " "), lambda w: F.when(F.size(w) >= n + 2, grams(w, F.lit(1), F.size(w) - n - 1)))
    words = lambda c: F.split(c, " ")
    postings, asked = t.select("k", F.explode(of_text).alias("h")), s.select("sk", F.explode(of_span).alias("h"))
    held = postings.join(asked.select("h").distinct(), "h", "left_semi")
    often = held.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(often, "h").groupBy("sk").agg(F.min_by("h", F.struct("n", "h")).alias("h"))
    candidates = rarest.join(held, "h").select("sk", "k")
    long_ = candidates.join(s, "sk").join(t, "k").where(F.col("t").contains(F.col("s"))).select("sk", "k")
    # spans of a few words: their inner words are whole words of the text, the rarest of which fetches the candidates
    inner = s.where(F.size(words(F.col("s"))).between(3, n + 1)).select("sk", F.explode(F.array_distinct(F.slice(words(F.col("s")), 2, F.size(words(F.col("s"))) - 2))).alias("w"))
    holding = t.select("k", F.explode(F.array_distinct(words(F.col("t")))).alias("w")).join(inner.select("w").distinct(), "w", "left_semi")
    fewest = inner.join(holding.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "w").groupBy("sk").agg(F.min_by("w", F.struct("n", "w")).alias("w"))
    short = fewest.join(holding, "w").select("sk", "k").join(s, "sk").join(t, "k").where(F.col("t").contains(F.col("s"))).select("sk", "k")
    # one or two words may both be parts of words: nothing to look up, every text is searched
    tiny = s.where(F.size(words(F.col("s"))) < 3).join(t, F.col("t").contains(F.col("s"))).select("sk", "k")
    return long_.unionByName(short).unionByName(tiny).select(F.col("sk").alias(span_key), F.col("k").alias(key))


def embedding_todo(chunks: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Rows whose id and content hash the index does not have: what is to be embedded (again)."""
    return chunks.join(index.select(key, "hash"), [key, "hash"], "left_anti")


def norms(df: DataFrame, vector: str) -> Column:
    return F.sqrt(dot(vector, vector))
