"""Queries of document structure, chunking, duplicates, vectors, retrieval, sampling, splits, sources, logs and model adapters."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as K
from ..operators import duplicates as D
from ..operators import models as M
from ..operators import retrieval as R
from ..operators import sampling as Z
from ..operators import structure as C
from ..sources import files as FS
from ..streaming import logs as T
from .q_tables import SHINGLES
from .registry import query
from .stand_ins import LINES, PAIRS, blocks, lines, pairs, table

ONE = "*"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder: below spark.checkpoint.dir where that is set, else, on a local master only, a temporary one of this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "corvane-scratch")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written and read again."""
    at = scratch(spark, "cut")
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


# ---- structure


def items(spark, d) -> DataFrame:
    """Lines as layout items: every seventh one is a heading, ten lines make a page."""
    label = F.when(F.col("ord") % 7 == 0, "section_header").when(F.col("ord") % 7 == 5, "list_item").otherwise("text")
    ls = lines(spark, d).select("doc_id", F.col("ord").cast("long").alias("ord"), label.alias("label"), "text", (F.expr("ord div 10") + 1).alias("page"))
    pages = ls.groupBy("doc_id").agg(F.max("page").alias("n_pages"))
    return ls.join(pages, "doc_id").withColumn("folder", F.when(F.col("doc_id") % 2 == 0, "book").otherwise("article")).withColumn("chapter_file", F.lit(False))


ITEMS = "items AS (SELECT doc_id, ord, text, CASE WHEN ord % 7 = 0 THEN 'section_header' WHEN ord % 7 = 5 THEN 'list_item' ELSE 'text' END AS label, ord // 10 + 1 AS page FROM lines)"


@query("WITH " + LINES + ", " + ITEMS + r", k AS (SELECT doc_id, lower(trim(regexp_replace(trim(text), '[\d·•|]+', '', 'g'))) AS key, page FROM items WHERE label = 'text' AND len(trim(text)) < 100 AND NOT regexp_matches(trim(text), '[.!?]$')), n AS (SELECT doc_id, max(page) AS n_pages FROM items GROUP BY doc_id) SELECT doc_id, key, CAST(count(DISTINCT page) AS BIGINT) AS pages FROM k JOIN n USING (doc_id) WHERE key <> '' GROUP BY doc_id, key, n_pages HAVING count(DISTINCT page) >= greatest(1, floor(n_pages * 0.05))")
def c01_running_headers(spark, d):
    return C.running_header_keys(items(spark, d), least_pages=1)


@query("WITH " + LINES + " SELECT doc_id, trim(text) AS header, CAST(count(*) AS BIGINT) AS n, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, trim(text)) AS INTEGER) AS place FROM lines GROUP BY doc_id, trim(text) QUALIFY place <= 10")
def c02_header_frequency(spark, d):
    return C.header_frequencies(lines(spark, d))


@query()
def c10_clean_blocks(spark, d):
    return C.clean_blocks(items(spark, d))


@query()
def x08_mended_words(spark, d):
    broken = F.regexp_replace("text", r"\b([a-z]{3})([a-z]{3,})\b", "$1- $2")
    return C.mended(table(spark, d, "documents").select("doc_id", F.lit("text").alias("label"), broken.alias("text"))).select("doc_id", "text")


@query("WITH " + LINES + ", h AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+-[a-z]+') AS w FROM lines) SELECT w, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(w) AS w FROM h) GROUP BY w")
def c19_hyphen_audit(spark, d):
    return lines(spark, d).select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+-[a-z]+"), F.lit(0))).alias("w")).groupBy("w").agg(F.count(ONE).alias("n"))


# ---- chunks


@query("WITH " + LINES + ", b AS (SELECT doc_id, ord, ord // 5 AS sec FROM lines WHERE ord % 9 <> 8), c AS (SELECT *, CASE WHEN lag(sec) OVER (PARTITION BY doc_id ORDER BY ord) IS DISTINCT FROM sec THEN 1 ELSE 0 END AS ch FROM b) SELECT doc_id, ord, CAST(sum(ch) OVER (PARTITION BY doc_id ORDER BY ord) AS INTEGER) AS \"group\" FROM c")
def c11_section_groups(spark, d):
    return K.section_groups(blocks(spark, d)).select("doc_id", "ord", "group")


@query()
def c12_packed_chunks(spark, d):
    return K.build_chunks(blocks(spark, d), K.Sizes(50, 100, 130, 12, 40))


@query("WITH " + LINES + ", b AS (SELECT doc_id, ord // 5 AS sec, ord, text FROM lines WHERE ord % 9 <> 8) SELECT doc_id, sec, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, min(ord // 10 + 1) AS page_start, max(ord // 10 + 1) AS page_end, format('{}:{:04d}', doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY sec) - 1) AS chunk_id FROM b GROUP BY doc_id, sec")
def c16_section_chunks(spark, d):
    b = blocks(spark, d).where("not skip").withColumn("sec", F.expr("ord div 5"))
    g = b.groupBy("doc_id", "sec").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("u"), F.min("page").alias("page_start"), F.max("page_end").alias("page_end"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("sec")) - 1
    return g.select("doc_id", "sec", F.array_join(F.transform("u", lambda x: x["text"]), "\n\n").alias("text"), "page_start", "page_end", F.format_string("%d:%04d", "doc_id", n).alias("chunk_id"))


# ---- duplicates


@query("WITH " + SHINGLES + " SELECT doc_id, CAST(n AS BIGINT) AS n FROM n")
def d01_shingles(spark, d):
    return D.shingle_table(table(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count(ONE).alias("n"))


@query()
def d01_sampled_shingles(spark, d):
    return D.shingle_table(table(spark, d, "documents"), "doc_id", "text", mod=8).groupBy("doc_id").agg(F.count(ONE).alias("n"))


@query("WITH h AS (SELECT doc_id, sha256(text) AS sha256 FROM documents), g AS (SELECT sha256, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_key FROM h GROUP BY sha256 HAVING count(*) > 1) SELECT doc_id, sha256, copies, first_key FROM h JOIN g USING (sha256)")
def d02_exact_duplicates(spark, d):
    return D.exact_groups(table(spark, d, "documents"), "doc_id", "text")


@query("WITH " + SHINGLES + " SELECT a, b, 'content:' || CAST(CAST(floor(100.0 * common / least(na.n, nb.n)) AS INTEGER) AS VARCHAR) || '%' AS reason FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE CAST(common AS DOUBLE) / least(na.n, nb.n) >= 0.6")
def d03_near_duplicates(spark, d):
    p = D.containment_pairs(D.shingle_table(table(spark, d, "documents"), "doc_id", "text"), "doc_id")
    return p.select("a", "b", F.concat(F.lit("content:"), F.floor(100 * F.col("containment")).cast("string"), F.lit("%")).alias("reason"))


@query()
def d04_similar_titles(spark, d):
    t = table(spark, d, "pages").select("page_id", F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1).alias("title"))
    return D.similar_titles(t, "page_id", "title")


@query("SELECT text_hash, n_chars, doc_id FROM (SELECT sha256(text) AS text_hash, n_chars, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY n_chars DESC, doc_id DESC) AS r FROM documents) WHERE r = 1")
def d05_keep_largest(spark, d):
    t = table(spark, d, "documents").select(F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "n_chars", "doc_id")
    return D.largest_of_group(t, "text_hash", "n_chars", "doc_id")


@query(
    "WITH RECURSIVE v AS (SELECT label, vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL), e AS (SELECT b.label, b.id, a.id AS a, list_inner_product(a.e, b.e) AS cos FROM v a JOIN v b ON a.label = b.label AND a.id < b.id WHERE list_inner_product(a.e, b.e) > 0.92), "
    "n AS (SELECT v.label, v.id, row_number() OVER (PARTITION BY v.label ORDER BY v.id) AS rn, coalesce(p.prev, []) AS prev FROM v LEFT JOIN (SELECT label, id, list(a) AS prev FROM e GROUP BY ALL) p ON p.label = v.label AND p.id = v.id), "
    "w AS (SELECT label, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM (SELECT DISTINCT label FROM n) UNION ALL SELECT w.label, n.rn, CASE WHEN list_has_any(kept, prev) THEN kept ELSE list_append(kept, id) END FROM w JOIN n ON n.label = w.label AND n.rn = w.rn + 1), "
    "k AS (SELECT label, arg_max(kept, rn) AS kept FROM w GROUP BY label), d AS (SELECT label, id, arg_max(a, (round(cos, 9), -a)) AS dropped_by, round(max(cos), 6) AS cosine FROM e JOIN k USING (label) WHERE list_contains(kept, a) GROUP BY ALL) "
    "SELECT label, v.id, list_contains(kept, v.id) AS kept, dropped_by, cosine FROM v JOIN k USING (label) LEFT JOIN d USING (label, id)"
)
def d06_ordered_dedup(spark, d):
    v = table(spark, d, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), "embedding", "label")
    edges = D.similar_pairs(v, "id", "embedding", "label", 0.92).withColumn("cosine", F.round("cosine", 9))
    return D.greedy_keep(v.select("label", "id"), edges, "id", "label", lambda t: cut(spark, t)).withColumn("cosine", F.round("cosine", 6))


# ---- vectors and retrieval


@query("WITH q AS (SELECT vec_id AS q, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q, vec_id AS i, round(list_inner_product(q.e, CAST(x.embedding AS DOUBLE[])), 9) AS s FROM q, embeddings x) SELECT q, i, CAST(row_number() OVER (PARTITION BY q ORDER BY s DESC, i) AS INTEGER) AS rank FROM s QUALIFY rank <= 10")
def v02_dense_top_k(spark, d):
    e = table(spark, d, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("q_vec"))  # the stated query set
    return R.dense_top_k(q, e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec")), "q", "i", 10).select("q", "i", "rank")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 3 = 0")
def v03_embedding_todo(spark, d):
    chunks = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    index = chunks.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("hash")).alias("hash"))
    return R.embedding_todo(chunks, index, "doc_id")


@query()
def v01_embed(spark, d):
    e = M.embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return e.select("doc_id", F.size("vec").alias("dim"), F.round(R.norms(None, "vec"), 4).alias("norm"))


@query()
def v05_self_retrieval(spark, d):
    e = M.embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    middle = table(spark, d, "documents").where("doc_id % 100 = 0").select("doc_id", F.expr("substring(text, cast(length(text) / 3 as int), cast(length(text) / 3 as int))").alias("text"))
    q = M.embed(middle, "doc_id", "text").select(F.col("doc_id").alias("q"), F.col("vec").alias("q_vec"))
    top = R.dense_top_k(q, e.select(F.col("doc_id").alias("i"), "vec"), "q", "i", 5)
    return top.groupBy("q").agg(F.bool_or(F.col("q") == F.col("i")).alias("found"))


BM25_SQL = """tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
  dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY doc_id), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  qt AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
  bm AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def bm25(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("q"))
    return R.bm25(b, table(spark, d, "documents"), "item_id", "doc_id", "q", "text").withColumn("score", F.round("score", 6))


@query("WITH " + BM25_SQL + ", k AS (SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm) SELECT item_id, doc_id, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5")
def r01_bm25(spark, d):
    return R.top_k(bm25(spark, d), "item_id", "doc_id", "score", 5).select("item_id", "doc_id", "rank")


@query()
def r03_hybrid(spark, d):
    lexical = R.top_k(bm25(spark, d), "item_id", "doc_id", "score", 100)
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    v = M.embed(docs.select("doc_id", "text"), "doc_id", "text").select("doc_id", "vec")
    q = M.embed(bench.select("item_id", "text"), "item_id", "text").select("item_id", F.col("vec").alias("q_vec"))
    dense = R.dense_top_k(q, v, "item_id", "doc_id", 100)
    both = R.top_k(R.rrf([lexical, dense], "item_id", "doc_id").withColumn("score", F.round("score", 9)), "item_id", "doc_id", "score", 10)
    return both.select("item_id", "doc_id", "rank")


@query()
def r04_rerank(spark, d):
    top = R.top_k(bm25(spark, d), "item_id", "doc_id", "score", 10)
    rows = top.join(table(spark, d, "benchmark").select("item_id", F.col("text").alias("q")), "item_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.top_k(M.rerank(rows, "item_id", "doc_id", "q", "text"), "item_id", "doc_id", "score", 5).select("item_id", "doc_id", "rank")


@query("SELECT item_id, CAST(count(doc_id) AS BIGINT) AS n_relevant FROM benchmark b LEFT JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY item_id")
def r05_relevance_sets(spark, d):
    b = table(spark, d, "benchmark")
    rel = R.containing(b, table(spark, d, "documents"), "item_id", "text", "doc_id", "text").groupBy("item_id").agg(F.count(ONE).alias("n"))
    return b.select("item_id").join(rel, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_relevant"))


@query("WITH " + BM25_SQL + ", k AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 6) DESC, doc_id) AS rank FROM bm), rel AS (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g')))), h AS (SELECT item_id, min(rank) AS first FROM k JOIN rel USING (item_id, doc_id) WHERE rank <= 100 GROUP BY item_id) SELECT b.item_id % 4 AS q_type, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(coalesce(first <= 5, false) AS INT)), 6) AS recall_5 FROM benchmark b LEFT JOIN h USING (item_id) GROUP BY b.item_id % 4")
def r06_recall_by_type(spark, d):
    b = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 4).alias("q_type"), "text")
    rel = R.containing(b, table(spark, d, "documents"), "item_id", "text", "doc_id", "text")
    m = R.metrics(R.top_k(bm25(spark, d), "item_id", "doc_id", "score", 100), rel, b, "item_id", "doc_id", by=["q_type"])
    return m.select("q_type", "n", F.round("recall_5", 6).alias("recall_5"))


# ---- samples and splits

DRAW = "CAST('0x' || substr(md5('{seed}|' || CAST({key} AS VARCHAR)), 1, 15) AS BIGINT)"


@query("WITH c AS (SELECT *, count(*) OVER (PARTITION BY source) AS k FROM documents WHERE n_chars > 500), s AS (SELECT DISTINCT source, lang FROM c WHERE k >= 4 AND lang = 'en'), r AS (SELECT source, row_number() OVER (ORDER BY " + DRAW.format(seed=13, key="source") + ") AS r FROM s) SELECT source, doc_id FROM (SELECT c.source, doc_id, row_number() OVER (PARTITION BY c.source ORDER BY " + DRAW.format(seed=14, key="doc_id") + ") AS n FROM c JOIN r USING (source) WHERE r <= 5) WHERE n <= 4")
def z01_pilot(spark, d):
    c = table(spark, d, "documents").where("n_chars > 500").select("source", "doc_id", "lang")
    ok = c.groupBy("source").agg(F.count(ONE).alias("k"), F.bool_or(F.col("lang") == "en").alias("en")).where("k >= 4 and en")
    chosen = ok.select("source").orderBy(Z.draw(13, "source")).limit(5)
    n = F.row_number().over(Window.partitionBy("source").orderBy(Z.draw(14, "doc_id")))
    return c.join(chosen, "source").withColumn("n", n).where("n <= 4").select("source", "doc_id")


@query("SELECT doc_id FROM documents WHERE n_chars > 800 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def z02_run_selection(spark, d):
    return table(spark, d, "documents").where("n_chars > 800").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("WITH c AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS a FROM documents), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY a, source) AS rn FROM c WHERE a = 1) SELECT lang, source, doc_id FROM o WHERE rn <= 3")
def z03_extra_per_dimension(spark, d):
    best = table(spark, d, "documents").groupBy("source").agg(F.max_by(F.struct("lang", "doc_id"), F.struct("n_chars", -F.col("doc_id"))).alias("b"))
    rn = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    return best.select("source", "b.lang", "b.doc_id").withColumn("rn", rn).where("rn <= 3").select("lang", "source", "doc_id")


@query("WITH t(q_type, w, o, h) AS (VALUES ('factual', 20, 0, 4), ('definition', 20, 1, 3), ('explanation', 20, 2, 2), ('application', 15, 3, 1)), r AS (SELECT *, 100.0 * w / sum(w) OVER () AS raw FROM t), q AS (SELECT *, floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, o) <= 100 - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS n FROM r) SELECT q_type, CAST(n AS INTEGER) AS n, CAST(greatest(0, least(n, 20 - coalesce(sum(n) OVER (ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS INTEGER) AS hard FROM q")
def z04_slots(spark, d):
    s = Z.slots(spark, {"factual": 20, "definition": 20, "explanation": 20, "application": 15}, {"easy": 35, "medium": 45, "hard": 20}, ["application", "explanation", "definition", "factual"], 100)
    return s.groupBy("q_type").agg(F.count(ONE).cast("int").alias("n"), F.count_if(F.col("difficulty") == "hard").cast("int").alias("hard"))


@query("WITH s AS (SELECT source, lang, greatest(1, CAST(round_even(60.0::DOUBLE * count(*) / sum(count(*)) OVER (), 0) AS INTEGER)) AS want FROM documents GROUP BY ALL), p AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY " + DRAW.format(seed=0, key="doc_id") + ", doc_id) AS n FROM documents) SELECT doc_id, source, lang FROM p JOIN s USING (source, lang) WHERE n <= want ORDER BY " + DRAW.format(seed=1, key="doc_id") + ", doc_id LIMIT 60")
def z05_stratified_at_least_one(spark, d):
    return Z.stratified_at_least_one(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 60).select("doc_id", "source", "lang")


STRATA = "s AS (SELECT source, lang, count(*) AS size FROM documents GROUP BY ALL), r AS (SELECT *, 60.0::DOUBLE * size / (SELECT sum(size) FROM s) AS raw FROM s), q AS (SELECT source, lang, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, source, lang) <= 60 - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r), p AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY " + DRAW.format(seed=0, key="doc_id") + ", doc_id) AS place FROM documents)"


@query("WITH " + STRATA + " SELECT doc_id, source, lang FROM p JOIN q USING (source, lang) WHERE place <= quota")
def z06_stratified(spark, d):
    return Z.stratified(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 60).select("doc_id", "source", "lang")


@query("WITH " + STRATA + " SELECT doc_id, CAST(row_number() OVER (ORDER BY place, source, lang) - 1 AS INTEGER) AS pos FROM p JOIN q USING (source, lang) WHERE place <= quota")
def z07_prefix_stratified(spark, d):
    return Z.interleaved(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 60).select("doc_id", "pos")


@query("WITH p AS (SELECT d.doc_id, toxic, source, row_number() OVER (PARTITION BY toxic, source ORDER BY " + DRAW.format(seed=5, key="d.doc_id") + ") AS rn FROM documents d JOIN labels l USING (doc_id)), o AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY rn, source) AS n FROM p) SELECT doc_id, toxic FROM o WHERE n <= CASE WHEN toxic = 1 THEN 10 ELSE 20 END")
def z08_priority_sample(spark, d):
    p = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id")
    p = p.withColumn("rn", F.row_number().over(Window.partitionBy("toxic", "source").orderBy(Z.draw(5, "doc_id"))))
    n = F.row_number().over(Window.partitionBy("toxic").orderBy("rn", "source"))
    return p.withColumn("n", n).where(F.col("n") <= F.when(F.col("toxic") == 1, 10).otherwise(20)).select("doc_id", "toxic")


@query("WITH t AS (SELECT source, doc_id, doc_id % 25 = 0 AS must, row_number() OVER (PARTITION BY source ORDER BY doc_id % 25 = 0 DESC, " + DRAW.format(seed=9, key="doc_id") + ") AS r FROM documents) SELECT source, doc_id, must FROM t WHERE r <= 8")
def z09_must_include_with_cap(spark, d):
    must = F.col("doc_id") % 25 == 0
    r = F.row_number().over(Window.partitionBy("source").orderBy(must.desc(), Z.draw(9, "doc_id")))
    return table(spark, d, "documents").select("source", "doc_id", must.alias("must"), r.alias("r")).where("r <= 8").select("source", "doc_id", "must")


@query("WITH " + PAIRS + ", u AS (SELECT q_type, qa_id, row_number() OVER (PARTITION BY q_type ORDER BY " + DRAW.format(seed=42, key="qa_id") + ") AS r, count(*) OVER (PARTITION BY q_type) AS n FROM pairs) SELECT qa_id, q_type, r <= floor(n * 0.2) AS dev FROM u")
def z10_dev_test_split(spark, d):
    w = Window.partitionBy("q_type")
    p = pairs(spark, d).select("qa_id", "q_type")
    return p.select("qa_id", "q_type", (F.row_number().over(w.orderBy(Z.draw(42, "qa_id"))) <= F.floor(F.count(ONE).over(w) * 0.2)).alias("dev"))


HELD = PAIRS + ", g AS (SELECT doc_group AS g, min(folder) AS f, count(*) AS n, " + DRAW.format(seed=42, key="doc_group") + " AS dr FROM pairs GROUP BY doc_group), t AS (SELECT sum(n) AS total, 0.12::DOUBLE * sum(n) AS target FROM g), e AS (SELECT g.* FROM g, t WHERE n <= greatest(target / 2, 1)), c0 AS (SELECT arg_min(e.g, (e.n, dr)) AS g FROM pairs p JOIN e ON e.g = p.doc_group GROUP BY dimension), c AS (SELECT g, f, n FROM e WHERE g IN (SELECT g FROM c0) ORDER BY n, dr LIMIT 6), room AS (SELECT g.f, any_value(target) * sum(g.n) / any_value(total) - coalesce(any_value(h.n), 0) AS room FROM g LEFT JOIN (SELECT f, sum(n) AS n FROM c GROUP BY f) h USING (f), t GROUP BY g.f), r AS (SELECT g, sum(n) OVER w <= room AS fits, row_number() OVER w AS rn, dr FROM e JOIN room USING (f) WHERE g NOT IN (SELECT g FROM c) WINDOW w AS (PARTITION BY f ORDER BY dr ROWS UNBOUNDED PRECEDING)), k AS (SELECT g, row_number() OVER (ORDER BY fits DESC, rn, dr) AS k FROM r WHERE rn <= 6), held AS (SELECT g FROM c UNION ALL SELECT g FROM k WHERE k <= greatest(2 - (SELECT count(*) FROM c), least((SELECT count(*) FROM r WHERE fits AND rn <= 6), 6 - (SELECT count(*) FROM c))))"


@query("WITH " + HELD + ", u AS (SELECT conv_id, row_number() OVER (ORDER BY " + DRAW.format(seed=42, key="conv_id") + ", conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM pairs WHERE doc_group NOT IN (FROM held))) SELECT qa_id, conv_id, doc_group, CASE WHEN doc_group IN (FROM held) THEN 'test_heldout_docs' WHEN r <= round_even(n * 0.05, 0) THEN 'val' WHEN r <= round_even(n * 0.05, 0) + round_even(n * 0.10, 0) THEN 'test_indomain' ELSE 'train' END AS split FROM pairs LEFT JOIN u USING (conv_id)")
def z11_heldout_splits(spark, d):
    return Z.make_splits(pairs(spark, d), "doc_group", "folder", "conv_id", "dimension", least=2, most=6).select("qa_id", "conv_id", "doc_group", "split")


@query("WITH " + PAIRS + ", u AS (SELECT conv_id, row_number() OVER (ORDER BY " + DRAW.format(seed=42, key="conv_id") + ", conv_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM pairs)) SELECT qa_id, CASE WHEN r <= round_even(n * 0.05, 0) THEN 'val' WHEN r <= round_even(n * 0.05, 0) + round_even(n * 0.10, 0) THEN 'test_indomain' ELSE 'train' END AS split FROM pairs JOIN u USING (conv_id)")
def z12_chunk_split(spark, d):
    return Z.split_rest(pairs(spark, d), "conv_id").select("qa_id", "split")


@query("WITH " + PAIRS + ", s AS (SELECT *, CASE WHEN (doc_group + turn // 4) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM pairs), k AS (SELECT 'doc_group' AS \"check\", doc_group AS key, split FROM s UNION ALL SELECT 'conv_id', conv_id, split FROM s UNION ALL SELECT 'qa_id', qa_id, split FROM s), n AS (SELECT \"check\", key, count(DISTINCT split) AS n FROM k GROUP BY ALL) SELECT \"check\", CAST(count(*) AS BIGINT) AS n_keys, CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_leaking FROM n GROUP BY \"check\"")
def z13_leakage_checks(spark, d):
    s = pairs(spark, d).withColumn("split", F.when((F.col("doc_group") + F.expr("turn div 4")) % 5 == 0, "test").otherwise("train"))
    return Z.split_checks(s, {"doc_group": "doc_group", "conv_id": "conv_id", "qa_id": "qa_id"})


@query()
def z14_covering_splits(spark, d):
    out, seed, missing = Z.covering_splits(pairs(spark, d), "doc_group", "folder", "conv_id", "dimension", least=2, most=6)
    return out.groupBy("split").agg(F.count(ONE).alias("n")).withColumn("seed", F.lit(seed)).withColumn("missing", F.lit(missing))


@query("SELECT doc_id FROM documents ORDER BY " + DRAW.format(seed=3, key="doc_id") + ", doc_id LIMIT 20")
def z15_shuffled_sample(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(Z.draw(3, "doc_id"), "doc_id").limit(20)


@query("WITH b AS (SELECT CAST(floor(sum(n_chars) / 20.0 / 1000) AS BIGINT) AS k FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 50 <> 0, " + DRAW.format(seed=1, key="doc_id") + ", doc_id) AS r FROM documents) SELECT doc_id FROM r, b WHERE r <= k")
def z16_budget_sample(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    k = docs.agg(F.floor(F.sum("n_chars") / 20.0 / 1000)).first()[0]  # one number
    return docs.orderBy(F.col("doc_id") % 50 != 0, Z.draw(1, "doc_id"), "doc_id").limit(int(k)).select("doc_id")


@query("WITH " + STRATA + ", o AS (SELECT doc_id, row_number() OVER (ORDER BY place, source, lang) - 1 AS pos FROM p JOIN q USING (source, lang) WHERE place <= quota) SELECT doc_id FROM o WHERE pos < 25")
def z17_shrunk_prefix(spark, d):
    return Z.interleaved(table(spark, d, "documents").select("doc_id", "source", "lang"), ["source", "lang"], "doc_id", 60).where("pos < 25").select("doc_id")


@query("SELECT event_type AS system, event_id FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY " + DRAW.format(seed=8, key="event_id") + ", event_id) AS r FROM events) WHERE r <= 10")
def z18_human_sheet(spark, d):
    r = F.row_number().over(Window.partitionBy("event_type").orderBy(Z.draw(8, "event_id"), "event_id"))
    return table(spark, d, "events").select(F.col("event_type").alias("system"), "event_id", r.alias("r")).where("r <= 10").select("system", "event_id")


@query("WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS example FROM w JOIN b USING (o_custkey) GROUP BY o_custkey")
def z19_examples(spark, d):
    o = table(spark, d, "orders")
    w = o.where("o_orderstatus = 'F'").join(o.where("o_orderstatus = 'O'").select("o_custkey"), "o_custkey", "left_semi")
    return w.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("example"))


# ---- sources and sinks: written, read back


@query("SELECT doc_id, text, lang FROM documents")
def s05_jsonl(spark, d):
    at = scratch(spark, "jsonl")
    FS.write_jsonl(table(spark, d, "documents").select("doc_id", "text", "lang"), at)
    return FS.read_jsonl(spark, at, "doc_id long, text string, lang string")


@query("SELECT doc_id, lang FROM documents")
def s06_tolerant_jsonl(spark, d):
    at = scratch(spark, "torn")
    good = table(spark, d, "documents").select(F.to_json(F.struct("doc_id", "lang")).alias("value"))
    torn = good.select(F.substring("value", 1, 5).alias("value")).unionByName(spark.createDataFrame([("",), ("not json",)], "value string"))
    good.unionByName(torn).write.text(at)
    return FS.read_jsonl(spark, at, "doc_id long, lang string", tolerant=True)


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def s07_csv_text(spark, d):
    at = scratch(spark, "csv")
    FS.write_csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), at)
    return FS.read_csv_text(spark, at)


@query("WITH " + LINES + " SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS INTEGER) AS ord, text FROM lines")
def s08_document_files(spark, d):
    at = scratch(spark, "docs")
    docs = lines(spark, d).groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.struct(x["text"].alias("text"))).alias("blocks"))
    docs.write.json(at)  # several documents per file
    return FS.read_documents(spark, at, "doc_id long, blocks array<struct<text: string>>", by_line=True).select("doc_id", "ord", "text")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, len(embedding) AS dim FROM embeddings")
def s09_vectors(spark, d):
    at = scratch(spark, "vectors")
    FS.write_vectors(table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec")), at)
    return FS.read_vectors(spark, at).select("id", F.size("vec").cast("long").alias("dim"))


@query("SELECT p_partkey, p_retailprice FROM part")
def s10_csv_typed(spark, d):
    at = scratch(spark, "csv")
    FS.write_csv(table(spark, d, "part").select("p_partkey", "p_retailprice"), at)
    return FS.read_csv_typed(spark, at, "p_partkey long, p_retailprice double")


@query("SELECT p_partkey, 'books' AS folder, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS stem, CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE p_name END AS doc_group FROM part")
def s12_path_fields(spark, d):
    path = F.concat(F.lit("books/"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("bulk-download/"), "p_brand", F.lit("/"))).otherwise(""), "p_name", F.lit(".pdf"))
    return table(spark, d, "part").select("p_partkey", *FS.path_fields(path))


@query("SELECT CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS with_hash")
def s01_file_scan(spark, d):
    return FS.scan_files(spark, f"{d}/region.parquet", ".PARQUET").agg(F.count(ONE).alias("n"), F.count_if(F.length("sha256") == 64).alias("with_hash"))


@query("SELECT page_id, CAST((length(html) - length(replace(html, '<p>', ''))) // 3 AS BIGINT) AS n_paragraph_tags FROM pages")
def s03_layout_items(spark, d):
    it = M.html_items(table(spark, d, "pages"))
    n = it.groupBy("page_id").agg(F.max("n_p").cast("long").alias("n_paragraph_tags"))
    return table(spark, d, "pages").select("page_id").join(n, "page_id", "left").select("page_id", F.coalesce("n_paragraph_tags", F.lit(0).cast("long")).alias("n_paragraph_tags"))


@query("SELECT c_custkey, c_name || '!' AS title, CASE WHEN c_custkey % 4 = 0 THEN 'ok' ELSE '' END AS human_verdict, CASE WHEN c_custkey % 4 = 0 THEN 'n' || CAST(c_custkey AS VARCHAR) ELSE '' END AS human_notes FROM customer WHERE c_custkey % 3 <> 1")
def k05_review_upsert(spark, d):
    c = table(spark, d, "customer")
    old = c.select("c_custkey", F.col("c_name").alias("title"), F.when(F.col("c_custkey") % 4 == 0, "ok").otherwise(" ").alias("human_verdict"), F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("n"), F.col("c_custkey").cast("string"))).otherwise("").alias("human_notes"))
    new = c.where("c_custkey % 3 <> 1").select("c_custkey", F.concat("c_name", F.lit("!")).alias("title"))
    return FS.keep_human_columns(new, old, "c_custkey")


@query("SELECT s_suppkey, 'a\\&b\\_c \\%' || CAST(s_suppkey AS VARCHAR) || ' \\textbackslash{}\\{x\\}' AS tex FROM supplier")
def k09_tex_escape(spark, d):
    raw = F.concat(F.lit("a&b_c %"), F.col("s_suppkey").cast("string"), F.lit(" \\{x}"))
    return table(spark, d, "supplier").select("s_suppkey", X.tex_escape(raw).alias("tex"))


# ---- logs, resumption


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def t01_resume(spark, d):
    docs = table(spark, d, "documents").select("doc_id")
    return T.remaining(docs, docs.where("doc_id % 2 = 0"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1 OR doc_id % 3 = 0")
def t02_cache_by_content(spark, d):
    params = F.lit("v2|n=8")
    now = table(spark, d, "documents").select("doc_id", F.sha2(F.concat(params, "text"), 256).alias("key"))
    old = table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", F.sha2(F.concat(F.when(F.col("doc_id") % 3 == 0, F.lit("v1|n=8")).otherwise(params), "text"), 256).alias("key"))
    return T.remaining(now, old, ["doc_id", "key"]).select("doc_id")


def _usage_files(spark, d) -> str:
    at = scratch(spark, "usage")
    e = table(spark, d, "events")
    e.select(F.unix_timestamp("ts").cast("double").alias("ts"), F.concat("event_type", F.lit(":b")).alias("stage"), F.lit("judge").alias("role"), F.lit("m").alias("model"), F.col("user_id").alias("input"), (F.col("event_id") % 7).alias("output"), F.lit(0.25).alias("cost"), (F.col("event_id") % 5 == 0).alias("cached"), F.lit(None).cast("string").alias("batch")).repartition(4, "event_id").write.json(at)
    return at


@query("SELECT event_type AS stage, 'judge' AS role, FALSE AS batch, CAST(count(*) AS BIGINT) AS calls, CAST(sum(user_id) AS BIGINT) AS input, CAST(sum(event_id % 7) AS BIGINT) AS output, count(*) * 0.25::DOUBLE AS cost FROM events WHERE event_id % 5 <> 0 GROUP BY event_type")
def t03_usage_stream(spark, d):
    name = "usage_" + uuid.uuid4().hex
    q = T.spending(T.usage_stream(spark, _usage_files(spark, d))).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", scratch(spark, "checkpoint")).start()
    q.awaitTermination()
    return spark.table(name)


@query("WITH c AS (SELECT user_id, ts, event_id, value >= 30 AS hi, value < 5 AS lo FROM events), b AS (SELECT *, sum(CASE WHEN hi THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM c), r AS (SELECT *, sum(CASE WHEN hi THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM b), s AS (SELECT user_id, event_id, ts, CASE WHEN hi AND run >= 2 THEN 'PAUSE' WHEN lo THEN 'RESUME' END AS state FROM r), k AS (SELECT *, lag(state, 1, 'RESUME') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM s WHERE state IS NOT NULL) SELECT user_id, event_id, state FROM k WHERE state <> before")
def t04_alarm_hysteresis(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    h = T.alarm_history(e.select("user_id", "at", "value"), "user_id", "at", "value", 30.0, 5.0, 2)
    return h.select("user_id", "at.event_id", "state")


@query("SELECT user_id, max(value) AS top, CAST(count(*) FILTER (value > 100) AS BIGINT) AS n_high FROM events GROUP BY user_id")
def t05_event_log_summary(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.count_if(F.col("value") > 100).alias("n_high"))


@query("SELECT CAST(count(*) AS BIGINT) AS answered, CAST(0 AS BIGINT) AS pending FROM (WITH " + PAIRS + " SELECT DISTINCT question FROM pairs)")
def t07_rounds_to_fixpoint(spark, d):
    requests = M.requests(pairs(spark, d), "question")
    answers = M.resolve(requests, rounds=8)
    left = requests.join(answers, "key", "left_anti")
    return answers.agg(F.count(ONE).alias("answered")).crossJoin(F.broadcast(left.agg(F.count(ONE).alias("pending"))))


@query("SELECT doc_id FROM documents ORDER BY " + DRAW.format(seed=77, key="doc_id") + ", doc_id LIMIT 30")
def t08_truncated_in_random_order(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(Z.draw(77, "doc_id"), "doc_id").limit(30)


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS steps, max(ts) AS last FROM events GROUP BY event_type")
def t09_progress(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count(ONE).alias("steps"), F.max("ts").cast("timestamp").alias("last"))


# ---- model adapters with offline stubs


@query("WITH " + PAIRS + " SELECT CAST(count(*) AS BIGINT) AS n_requests, CAST(count(DISTINCT question) AS BIGINT) AS n_distinct FROM pairs")
def l02_pending_requests(spark, d):
    r = pairs(spark, d).select(M.request_key("question").alias("key"))
    return r.agg(F.count(ONE).alias("n_requests"), F.countDistinct("key").alias("n_distinct"))


@query()
def l01_cached_completion(spark, d):
    r = M.requests(pairs(spark, d), "question")
    cache = M.resolve(r.where(F.col("key") < "8"), rounds=1)
    return M.complete(r, cache).select("key", "answer", "cached")


@query()
def l07_units_per_chunk(spark, d):
    return M.knowledge_units(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query()
def l08_pairs_per_chunk(spark, d):
    return M.question_pairs(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 3)


@query()
def l10_judged_and_repaired(spark, d):
    return M.judge_and_repair(pairs(spark, d)).groupBy("status").agg(F.count(ONE).alias("n"))


@query()
def l11_paraphrases_fixed(spark, d):
    return M.fix_paraphrases(pairs(spark, d)).select("qa_id", "paraphrases", "n_bad", "n_dropped")


@query("WITH " + LINES + ", f AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS k FROM lines), p AS (SELECT doc_id, CAST(k - 1 AS INTEGER) AS k, trim(text) AS fact FROM f WHERE k <= 5) SELECT system, doc_id, k, fact FROM p, (VALUES ('base'), ('ft')) s(system)")
def l23_fact_pairs(spark, d):
    facts = lines(spark, d).groupBy("doc_id").agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: F.trim(x["text"])), 1, 5).alias("facts"))
    systems = spark.createDataFrame([("base",), ("ft",)], "system string")
    return facts.crossJoin(F.broadcast(systems)).select("system", "doc_id", F.posexplode("facts").alias("k", "fact"))


@query("SELECT l_orderkey, l_linenumber, l_tax >= 0.05 AND l_tax > l_discount AS contradicted, l_discount >= 0.05 AND l_discount >= l_tax AS supported FROM lineitem")
def l21_entailment_rules(spark, d):
    e, c = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *M.entailment(e, c, 0.05))


@query("SELECT CASE WHEN count(*) FILTER (l_tax IS NOT NULL) >= 0.9 * count(*) THEN 'first' ELSE 'second' END AS checker FROM lineitem")
def l22_primary_checker(spark, d):
    return table(spark, d, "lineitem").agg(F.when(F.count("l_tax") >= 0.9 * F.count(ONE), "first").otherwise("second").alias("checker"))
