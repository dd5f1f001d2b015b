"""Queries of joins, aggregations, windows, ordering and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import duplicates as D
from .registry import query
from .stand_ins import LINES, PAIRS, SCORES, lines, pairs, scores, table

ONE = "*"


def cents(c):
    return F.round(F.col(c) * 100).cast("long")


CENTS = "CAST(sum(CAST(round({} * 100) AS BIGINT)) AS BIGINT)"


def r6(c):
    return F.round(c, 6)


# ---- joins


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey")
def j01_lookup_join(spark, d):
    # customer grows with the data: Spark broadcasts it only below its size threshold
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT d.doc_id, l.quality, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j02_left_with_default(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left").select("doc_id", "quality", F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(
    "WITH e AS (SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL) SELECT c_custkey, coalesce(v.n, 0) AS views, coalesce(k.n, 0) AS clicks, p.n AS purchases FROM customer LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') v ON v.user_id = c_custkey LEFT JOIN (SELECT * FROM e WHERE event_type = 'click') k ON k.user_id = c_custkey LEFT JOIN (SELECT * FROM e WHERE event_type = 'purchase') p ON p.user_id = c_custkey"
)
def j03_master_table(spark, d):
    # one aggregation pass gives all sides: no chain of joins against the same table
    n = lambda t: F.count_if(F.col("event_type") == t)
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(n("view").alias("views"), n("click").alias("clicks"), n("purchase").alias("p"))
    m = table(spark, d, "customer").select("c_custkey").join(e, "c_custkey", "left")
    return m.select("c_custkey", F.coalesce("views", F.lit(0).cast("long")).alias("views"), F.coalesce("clicks", F.lit(0).cast("long")).alias("clicks"), F.when(F.col("p") > 0, F.col("p")).alias("purchases"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'new' ELSE 'old' END AS src, CASE WHEN o_orderkey % 4 = 0 THEN 'X' ELSE o_orderstatus END AS verdict FROM orders")
def j04_newer_overrides(spark, d):
    o = table(spark, d, "orders")
    old = o.select("o_orderkey", F.lit("old").alias("src"), F.col("o_orderstatus").alias("verdict"), F.lit(0).alias("ord"))
    new = o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("new").alias("src"), F.lit("X").alias("verdict"), F.lit(1).alias("ord"))
    return old.unionByName(new).groupBy("o_orderkey").agg(F.max_by(F.struct("src", "verdict"), "ord").alias("b")).select("o_orderkey", "b.*")


@query("WITH " + SCORES + " SELECT s.system, s.split, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(round((s.score - b.score) * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*), 6) AS diff FROM scores s JOIN scores b ON b.system = 'view' AND b.split = s.split AND b.item = s.item WHERE s.system <> 'view' GROUP BY s.system, s.split")
def j05_paired_with_base(spark, d):
    s = scores(spark, d)
    base = s.where("system = 'view'").select("split", "item", F.col("score").alias("base"))
    both = s.where("system <> 'view'").join(base, ["split", "item"])
    return both.groupBy("system", "split").agg(F.count(ONE).alias("n"), r6(F.sum(F.round((F.col("score") - F.col("base")) * 100).cast("long")) / 100 / F.count(ONE)).alias("diff"))


@query("WITH " + PAIRS + " SELECT a.qa_id AS exact_id, b.qa_id AS paraphrase_id, len(a.answer) - len(b.answer) AS drop_chars FROM pairs a JOIN pairs b ON b.qa_id = a.qa_id + 2")
def j06_link_column(spark, d):
    p = pairs(spark, d)
    a = p.select(F.col("qa_id").alias("exact_id"), (F.col("qa_id") + 2).alias("paraphrase_id"), F.length("answer").alias("x"))
    b = p.select(F.col("qa_id").alias("paraphrase_id"), F.length("answer").alias("y"))
    return a.join(b, "paraphrase_id").select("exact_id", "paraphrase_id", (F.col("x") - F.col("y")).cast("long").alias("drop_chars"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j07_still_to_do(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left_anti")


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j08_semi(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").where("toxic = 1"), "doc_id", "left_semi")


SHINGLES = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 8], ' ') AS h FROM t, LATERAL (SELECT unnest(range(len(w) - 7)) AS i) WHERE len(w) >= 8),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  p AS (SELECT x.doc_id AS a, y.doc_id AS b, CAST(count(*) AS BIGINT) AS common FROM s x JOIN s y ON x.h = y.h AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id)"""


@query("WITH " + SHINGLES + " SELECT a, b, common, CAST(common AS DOUBLE) / least(na.n, nb.n) AS containment FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE CAST(common AS DOUBLE) / least(na.n, nb.n) >= 0.6")
def j09_inverted_index_pairs(spark, d):
    return D.containment_pairs(D.shingle_table(table(spark, d, "documents"), "doc_id", "text"), "doc_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g')))")
def j10_span_in_text(spark, d):
    from ..operators.retrieval import containing

    return containing(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 100)")
def j11_exclude_earlier_runs(spark, d):
    bad = table(spark, d, "events").where("event_type = 'error' and value > 100").select(F.col("user_id").alias("o_custkey"))
    return table(spark, d, "orders").join(bad, "o_custkey", "left_anti").select("o_orderkey")


@query("WITH a AS (SELECT o_custkey, o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY ALL) SELECT c_custkey, c_mktsegment, max(CASE WHEN o_orderstatus = 'F' THEN n END) AS f, max(CASE WHEN o_orderstatus = 'O' THEN n END) AS o, max(CASE WHEN o_orderstatus = 'P' THEN n END) AS p FROM customer LEFT JOIN a ON o_custkey = c_custkey GROUP BY c_custkey, c_mktsegment")
def j12_pivot_joined_back(spark, d):
    wide = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderstatus"))
    return table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(wide, "c_custkey", "left").select("c_custkey", "c_mktsegment", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("SELECT vec_id, embedding_norm FROM (SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS embedding_norm FROM embeddings)")
def v04_norms(spark, d):
    from ..operators.retrieval import norms

    return table(spark, d, "embeddings").select("vec_id", r6(norms(None, "embedding")).alias("embedding_norm"))


@query("SELECT c_custkey, c_nationkey, coalesce(seg, first_value(seg IGNORE NULLS) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS seg FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END AS seg FROM customer)")
def j14_donor_fills(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("seg"))
    donor = c.where("seg is not null").groupBy("c_nationkey").agg(F.min_by("seg", "c_custkey").alias("donor"))  # an aggregate: a large group is never gathered
    return c.join(donor, "c_nationkey", "left").select("c_custkey", "c_nationkey", F.coalesce("seg", "donor").alias("seg"))


# ---- aggregations


@query(f"SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, {CENTS.format('l_extendedprice')} AS price_cents, min(l_quantity) AS min_q, max(l_quantity) AS max_q, round({CENTS.format('l_quantity')} / 100.0 / count(*), 6)::DOUBLE AS mean_q, median(l_quantity) AS median_q FROM lineitem GROUP BY ALL")
def a01_basic(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(ONE).alias("n"), F.sum(cents("l_extendedprice")).alias("price_cents"), F.min("l_quantity").alias("min_q"), F.max("l_quantity").alias("max_q"), r6(F.sum(cents("l_quantity")) / 100 / F.count(ONE)).alias("mean_q"), F.median("l_quantity").alias("median_q"))


@query("SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (n_chars > 1500) AS BIGINT) AS n_long, round(CAST(count(*) FILTER (n_chars > 1500) AS DOUBLE) / count(*), 6) AS share FROM documents GROUP BY source")
def a02_conditional_share(spark, d):
    long_ = F.col("n_chars") > 1500
    return table(spark, d, "documents").groupBy("source").agg(F.count(ONE).alias("n"), F.count_if(long_).alias("n_long"), r6(F.count_if(long_) / F.count(ONE)).alias("share"))


@query("SELECT lang, word, n FROM (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM (SELECT lang, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS word FROM documents) GROUP BY lang, word)) WHERE r <= 10")
def a03_most_common(spark, d):
    n = table(spark, d, "documents").select("lang", F.explode(X.tokens("text")).alias("word")).groupBy("lang", "word").agg(F.count(ONE).alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    return n.withColumn("r", F.row_number().over(w)).where("r <= 10").select("lang", "word", "n")


@query("WITH " + PAIRS + " SELECT q_type, difficulty, CAST(count(*) AS BIGINT) AS generated, CAST(count(*) FILTER (len(answer) > 200) AS BIGINT) AS passed FROM pairs GROUP BY ALL")
def a04_funnel(spark, d):
    return pairs(spark, d).groupBy("q_type", "difficulty").agg(F.count(ONE).alias("generated"), F.count_if(F.length("answer") > 200).alias("passed"))


REASONS = "rr AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'format(3);dup;format(5)' WHEN 'P' THEN 'low_value(2);dup' ELSE '' END AS reasons FROM orders)"


@query("WITH " + REASONS + " SELECT reason, CAST(count(*) AS BIGINT) AS n_rows FROM (SELECT DISTINCT o_orderkey, split_part(x, '(', 1) AS reason FROM (SELECT o_orderkey, unnest(string_split(reasons, ';')) AS x FROM rr WHERE reasons <> '')) GROUP BY reason")
def a05_multi_label(spark, d):
    reasons = F.when(F.col("o_orderstatus") == "F", "format(3);dup;format(5)").when(F.col("o_orderstatus") == "P", "low_value(2);dup").otherwise("")
    names = F.array_distinct(F.transform(F.filter(F.split(reasons, ";"), lambda x: x != ""), lambda x: F.substring_index(x, "(", 1)))
    return table(spark, d, "orders").select(F.explode(names).alias("reason")).groupBy("reason").agg(F.count(ONE).alias("n_rows"))


@query("WITH " + PAIRS + " SELECT doc_group, CAST(count(*) AS BIGINT) AS generated, CAST(count(*) FILTER (len(answer) > 200) AS BIGINT) AS passed, round(CAST(count(*) FILTER (len(answer) > 200) AS DOUBLE) / count(*), 6) AS rate FROM pairs GROUP BY doc_group")
def a06_per_document(spark, d):
    ok = F.count_if(F.length("answer") > 200)
    return pairs(spark, d).groupBy("doc_group").agg(F.count(ONE).alias("generated"), ok.alias("passed"), r6(ok / F.count(ONE)).alias("rate"))


USAGE_SQL = "u AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'judge:v2' ELSE event_type END AS stage, CASE WHEN user_id % 2 = 0 THEN 'judge' ELSE 'generator' END AS role, event_id % 5 = 0 AS cached, user_id % 4 = 0 AS batch, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"


def usage(spark, d):
    c = F.col
    return table(spark, d, "events").select(F.when(c("event_id") % 3 == 0, "judge:v2").otherwise(c("event_type")).alias("stage"), F.when(c("user_id") % 2 == 0, "judge").otherwise("generator").alias("role"), (c("event_id") % 5 == 0).alias("cached"), (c("user_id") % 4 == 0).alias("batch"), cents("value").alias("cents"))


@query("WITH " + USAGE_SQL + " SELECT split_part(stage, ':', 1) AS stage, role, batch, CAST(count(*) AS BIGINT) AS calls, CAST(sum(cents) AS BIGINT) AS cents FROM u WHERE NOT cached GROUP BY ALL")
def a07_spend(spark, d):
    return usage(spark, d).where("not cached").groupBy(F.substring_index("stage", ":", 1).alias("stage"), "role", "batch").agg(F.count(ONE).alias("calls"), F.sum("cents").alias("cents"))


@query("WITH " + USAGE_SQL + " SELECT CAST(sum(cents) AS BIGINT) AS cents, CAST(count(*) AS BIGINT) AS calls, round(CAST(sum(cents) AS DOUBLE) / count(*), 6) AS per_call FROM u WHERE NOT cached AND starts_with(stage, 'judge')")
def a08_stage_cost(spark, d):
    return usage(spark, d).where(~F.col("cached") & F.col("stage").startswith("judge")).agg(F.sum("cents").alias("cents"), F.count(ONE).alias("calls"), r6(F.sum("cents") / F.count(ONE)).alias("per_call"))


@query("WITH " + USAGE_SQL + ", s AS (SELECT stage, role, CAST(sum(cents) AS DOUBLE) / count(*) AS m FROM u WHERE NOT cached AND role = 'judge' GROUP BY ALL), r AS (SELECT role, CAST(sum(cents) AS DOUBLE) / count(*) AS m FROM u WHERE NOT cached AND role = 'judge' GROUP BY role), q AS (SELECT DISTINCT stage, role FROM u) SELECT q.stage, q.role, round(coalesce(s.m, r.m, 5.0), 6) AS estimate FROM q LEFT JOIN s USING (stage, role) LEFT JOIN r USING (role)")
def a09_cost_estimate(spark, d):
    u = usage(spark, d)
    paid = u.where("not cached and role = 'judge'")
    mean = F.sum("cents") / F.count(ONE)
    s, r = paid.groupBy("stage", "role").agg(mean.alias("a")), paid.groupBy("role").agg(mean.alias("b"))
    return u.select("stage", "role").distinct().join(s, ["stage", "role"], "left").join(r, "role", "left").select("stage", "role", r6(F.coalesce("a", "b", F.lit(5.0))).alias("estimate"))


@query("SELECT b, CAST(count(*) AS BIGINT) AS n FROM (SELECT CASE WHEN n_chars < 500 THEN '0-500' WHEN n_chars < 1000 THEN '500-1000' WHEN n_chars < 2000 THEN '1000-2000' ELSE '2000+' END AS b FROM documents) GROUP BY b")
def a10_histogram(spark, d):
    n = F.col("n_chars")
    return table(spark, d, "documents").groupBy(F.when(n < 500, "0-500").when(n < 1000, "500-1000").when(n < 2000, "1000-2000").otherwise("2000+").alias("b")).agg(F.count(ONE).alias("n"))


@query("WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT lang, max(CASE WHEN i = least(n - 1, CAST(floor(0.5 * n) AS BIGINT)) THEN n_chars END) AS p50, max(CASE WHEN i = least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) THEN n_chars END) AS p90 FROM s GROUP BY lang")
def a11_nearest_rank(spark, d):
    return S.nearest_rank(table(spark, d, "documents"), "n_chars", ["lang"], {"p50": 0.5, "p90": 0.9})


@query("SELECT source, quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS q2, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3 FROM documents GROUP BY source")
def a12_quantiles(spark, d):
    p = lambda q: F.percentile("n_chars", F.lit(q))
    return table(spark, d, "documents").groupBy("source").agg(p(0.25).alias("q1"), p(0.5).alias("q2"), p(0.75).alias("q3"))


@query("SELECT source, CAST(count(DISTINCT lang) AS BIGINT) AS langs, CAST(count(DISTINCT text) AS BIGINT) AS texts FROM documents GROUP BY source")
def a13_distinct(spark, d):
    # texts by a 256-bit digest: the shuffle carries 32 bytes a row, not the text
    return table(spark, d, "documents").groupBy("source").agg(F.countDistinct("lang").alias("langs"), F.countDistinct(F.sha2(F.col("text").cast("binary"), 256)).alias("texts"))


DIMS_SQL = "list_filter([CASE WHEN contains(text, 'the') THEN 'a' END, CASE WHEN contains(text, 'de') THEN 'b' END, CASE WHEN contains(text, 'und') THEN 'c' END], lambda x: x IS NOT NULL)"


@query(f"SELECT dim, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT source) AS BIGINT) AS docs FROM (SELECT source, unnest({DIMS_SQL}) AS dim FROM documents) GROUP BY dim")
def a14_dimension_coverage(spark, d):
    dims = F.array_compact(F.array(*[F.when(F.col("text").contains(t), n) for t, n in (("the", "a"), ("de", "b"), ("und", "c"))]))
    return table(spark, d, "documents").select("source", F.explode(dims).alias("dim")).groupBy("dim").agg(F.count(ONE).alias("n"), F.countDistinct("source").alias("docs"))


@query("WITH " + PAIRS + " SELECT q_type, round(CAST(count(*) FILTER (folder = 'book') AS DOUBLE) / count(*), 6) AS book, round(CAST(count(*) FILTER (folder = 'article') AS DOUBLE) / count(*), 6) AS article FROM pairs GROUP BY q_type")
def a15_cross_shares(spark, d):
    n = F.count(ONE)
    return pairs(spark, d).groupBy("q_type").agg(*[r6(F.count_if(F.col("folder") == f) / n).alias(f) for f in ("book", "article")])


@query("WITH " + PAIRS + " SELECT folder, CASE WHEN grouping(q_type) = 0 THEN 'q_type' WHEN grouping(difficulty) = 0 THEN 'difficulty' ELSE 'dimension' END AS group_type, coalesce(q_type, difficulty, CAST(dimension AS VARCHAR)) AS group_value, CAST(count(*) AS BIGINT) AS n, CAST(sum(len(answer)) AS BIGINT) AS chars FROM pairs GROUP BY GROUPING SETS ((folder, q_type), (folder, difficulty), (folder, dimension))")
def a16_grouping_sets(spark, d):
    p = pairs(spark, d)
    g = p.groupingSets([["folder", "q_type"], ["folder", "difficulty"], ["folder", "dimension"]], "folder", "q_type", "difficulty", "dimension")
    g = g.agg(F.grouping("q_type").alias("g1"), F.grouping("difficulty").alias("g2"), F.count(ONE).alias("n"), F.sum(F.length("answer")).alias("chars"))
    kind = F.when(F.col("g1") == 0, "q_type").when(F.col("g2") == 0, "difficulty").otherwise("dimension")
    return g.select("folder", kind.alias("group_type"), F.coalesce("q_type", "difficulty", F.col("dimension").cast("string")).alias("group_value"), "n", "chars")


@query("SELECT o_custkey, o_orderstatus AS modal FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderstatus) AS r FROM (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)) WHERE r = 1")
def a17_modal(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(ONE).alias("n"))
    return n.groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct(-F.col("n"), F.col("o_orderstatus"))).alias("modal"))


@query("SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS BIGINT) AS tp, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS BIGINT) AS fp, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS BIGINT) AS tn FROM labels")
def a18_confusion(spark, d):
    cell = lambda a, b: F.count_if((F.col("quality") == a) & (F.col("toxic") == b))
    return table(spark, d, "labels").agg(cell(1, 1).alias("tp"), cell(1, 0).alias("fn"), cell(0, 1).alias("fp"), cell(0, 0).alias("tn"))


@query("SELECT l_orderkey, max(l_discount) AS p, CAST(count(*) AS BIGINT) = max(CAST(l_linenumber AS BIGINT)) AS complete FROM lineitem GROUP BY l_orderkey")
def a19_max_over_windows(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_discount").alias("p"), (F.count(ONE) == F.max(F.col("l_linenumber").cast("long"))).alias("complete"))


@query("SELECT l_orderkey, CAST(max(l_linenumber) AS BIGINT) AS n_facts, CASE WHEN count(*) >= max(l_linenumber) THEN round(CAST(count(*) FILTER (l_discount >= 0.05) AS DOUBLE) / count(*), 6) END AS recall FROM lineitem GROUP BY l_orderkey")
def a20_recall_if_complete(spark, d):
    n = F.count(ONE)
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").cast("long").alias("n_facts"), F.when(n >= F.max("l_linenumber"), r6(F.count_if(F.col("l_discount") >= 0.05) / n)).alias("recall"))


@query("SELECT l_suppkey, CASE WHEN count(*) > 0 AND count(*) = count(l_tax) THEN round(CAST(count(*) FILTER (l_returnflag = 'R') AS DOUBLE) / count(*), 6) END AS contradicted, CASE WHEN count(*) > 0 AND count(*) = count(l_tax) THEN round(CAST(count(*) FILTER (l_returnflag <> 'A') AS DOUBLE) / count(*), 6) END AS unsupported FROM lineitem GROUP BY l_suppkey")
def a21_claim_rates(spark, d):
    n = F.count(ONE)
    ok = (n > 0) & (n == F.count("l_tax"))
    rate = lambda c: F.when(ok, r6(F.count_if(c) / n))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(rate(F.col("l_returnflag") == "R").alias("contradicted"), rate(F.col("l_returnflag") != "A").alias("unsupported"))


@query("SELECT user_id, arg_max(event_type, event_id) AS status, max(event_id) AS last_event FROM events GROUP BY user_id")
def a22_last_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("status"), F.max("event_id").alias("last_event"))


@query("WITH e AS (SELECT event_type, date_trunc('day', ts) AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY ALL) SELECT event_type, day, n FROM e WHERE event_type IN ('view', 'click')")
def a23_series(spark, d):
    return table(spark, d, "events").where(F.col("event_type").isin("view", "click")).groupBy("event_type", F.date_trunc("day", "ts").alias("day")).agg(F.count(ONE).alias("n"))


@query("WITH q AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS a, quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS b, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS c FROM documents), t AS (SELECT lang, 1 + CAST(n_chars > a AS INT) + CAST(n_chars > b AS INT) + CAST(n_chars > c AS INT) AS quartile, n_chars FROM documents, q) SELECT lang, quartile, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(n_chars) AS DOUBLE) / count(*), 4) AS mean, round(1.96 * stddev_samp(n_chars) / sqrt(count(*)), 4) AS half FROM t GROUP BY ALL HAVING count(*) > 1")
def a24_length_quartiles(spark, d):
    docs = table(spark, d, "documents").select("lang", "n_chars")
    p = lambda q: F.percentile("n_chars", F.lit(q))
    q = docs.agg(p(0.25).alias("a"), p(0.5).alias("b"), p(0.75).alias("c"))  # one row
    over = lambda c: (F.col("n_chars") > F.col(c)).cast("int")
    t = docs.crossJoin(F.broadcast(q)).withColumn("quartile", 1 + over("a") + over("b") + over("c"))
    return t.groupBy("lang", "quartile").agg(F.count(ONE).alias("n"), F.round(F.sum("n_chars") / F.count(ONE), 4).alias("mean"), F.round(1.96 * F.stddev_samp("n_chars") / F.sqrt(F.count(ONE)), 4).alias("half")).where("n > 1")


@query("WITH " + SCORES + ", m AS (SELECT s.split, s.system, CAST(count(*) AS BIGINT) AS n, round(CAST(sum(CAST(round((s.score - b.score) * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*), 6) AS diff FROM scores s JOIN scores b ON b.system = 'view' AND b.item = s.item GROUP BY ALL) SELECT split, max(CASE WHEN system = 'click' THEN diff END) AS click, max(CASE WHEN system = 'error' THEN diff END) AS error, CAST(sum(CASE WHEN system IN ('click', 'error') THEN n END) AS BIGINT) AS n FROM m GROUP BY split")
def a25_delta_pivot(spark, d):
    s = scores(spark, d)
    both = s.where(F.col("system").isin("click", "error")).join(s.where("system = 'view'").select("item", F.col("score").alias("base")), "item")
    diff = lambda name: r6(F.sum(F.when(F.col("system") == name, F.round((F.col("score") - F.col("base")) * 100).cast("long"))) / 100 / F.count_if(F.col("system") == name)).alias(name)
    return both.groupBy("split").agg(diff("click"), diff("error"), F.count(ONE).alias("n"))


@query("WITH " + SCORES + " SELECT system, round(CAST(sum(CASE WHEN split = 's0' THEN CAST(round(score * 100) AS BIGINT) END) AS DOUBLE) / 100 / count(*) FILTER (split = 's0') - CAST(sum(CASE WHEN split <> 's0' THEN CAST(round(score * 100) AS BIGINT) END) AS DOUBLE) / 100 / count(*) FILTER (split <> 's0'), 6) AS gap FROM scores GROUP BY system")
def a26_seen_gap(spark, d):
    mean = lambda c: F.sum(F.when(c, F.round(F.col("score") * 100).cast("long"))) / 100 / F.count_if(c)
    seen = F.col("split") == "s0"
    return scores(spark, d).groupBy("system").agg(r6(mean(seen) - mean(~seen)).alias("gap"))


MEANS = ", m AS (SELECT system, split, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(score * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS mean FROM scores GROUP BY ALL)"


def means(spark, d):
    return scores(spark, d).groupBy("system", "split").agg(F.count(ONE).alias("n"), (F.sum(F.round(F.col("score") * 100).cast("long")) / 100 / F.count(ONE)).alias("mean"))


@query("WITH " + SCORES + MEANS + " SELECT split, arg_max(system, (mean, system)) AS best FROM m GROUP BY split")
def a27_best_variant(spark, d):
    return means(spark, d).groupBy("split").agg(F.max_by("system", F.struct("mean", "system")).alias("best"))


@query("SELECT o_orderstatus, o_orderpriority, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY o_orderstatus), 6) AS share FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)")
def a28_row_shares(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(ONE).alias("n"))
    return n.select("o_orderstatus", "o_orderpriority", r6(F.col("n") / F.sum("n").over(Window.partitionBy("o_orderstatus"))).alias("share"))


@query("WITH " + SCORES + MEANS + " SELECT system, split, abs(mean - max(mean) OVER (PARTITION BY split)) < 1e-8 AS best, abs(mean - min(mean) OVER (PARTITION BY split)) < 1e-8 AS worst FROM m")
def a29_best_marker(spark, d):
    w = Window.partitionBy("split")
    return means(spark, d).select("system", "split", (F.abs(F.col("mean") - F.max("mean").over(w)) < 1e-8).alias("best"), (F.abs(F.col("mean") - F.min("mean").over(w)) < 1e-8).alias("worst"))


@query("WITH " + LINES + ", " + PAIRS + " SELECT 'documents' AS stage, CAST(count(*) AS BIGINT) AS n FROM documents UNION ALL SELECT 'lines', count(*) FROM lines UNION ALL SELECT 'pairs', count(*) FROM pairs UNION ALL SELECT 'labelled', count(*) FROM labels")
def a30_funnel_table(spark, d):
    parts = [("documents", table(spark, d, "documents")), ("lines", lines(spark, d)), ("pairs", pairs(spark, d)), ("labelled", table(spark, d, "labels"))]
    out = None
    for name, df in parts:
        one = df.agg(F.lit(name).alias("stage"), F.count(ONE).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("WITH " + SCORES + MEANS + " SELECT m.system, round(avg(m.mean / b.mean), 6) AS retained FROM m JOIN m b ON b.system = 'view' AND b.split = m.split GROUP BY m.system")
def a31_retained(spark, d):
    m = means(spark, d)
    b = m.where("system = 'view'").select("split", F.col("mean").alias("ref"))
    return m.join(b, "split").groupBy("system").agg(r6(F.avg(F.col("mean") / F.col("ref"))).alias("retained"))


@query("WITH t AS (SELECT event_type, CAST(sum(length(props)) AS BIGINT) AS toks, date_diff('second', min(ts), max(ts)) AS secs FROM events GROUP BY event_type) SELECT event_type, round(CAST(toks AS DOUBLE) / secs, 6) AS rate FROM t")
def a32_throughput(spark, d):
    secs = F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts")))
    return table(spark, d, "events").groupBy("event_type").agg(r6(F.sum(F.length("props")) / secs).alias("rate"))


# ---- windows


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 4) AS ma FROM events")
def w01_moving_average(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 0)
    return table(spark, d, "events").select("event_id", F.round(F.avg("value").over(w), 4).alias("ma"))


@query("WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, event_id, CAST(sum(ch) OVER (PARTITION BY user_id ORDER BY e.ts, c.event_id) AS BIGINT) AS island FROM c JOIN events e USING (user_id, event_id)")
def w02_islands(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("ch", (~F.lag("event_type").over(w).eqNullSafe(F.col("event_type"))).cast("int"))
    return e.select("user_id", "event_id", F.sum("ch").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("island"))


@query("SELECT c_custkey, format('{}:{:04d}', c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) AS id FROM customer")
def w03_dense_position(spark, d):
    n = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    return table(spark, d, "customer").select("c_custkey", F.format_string("%d:%04d", "c_nationkey", n).alias("id"))


@query("SELECT user_id, event_id, first_value(CASE WHEN value > 100 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS donor FROM events")
def w04_first_donor(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "events").select("user_id", "event_id", F.first(F.when(F.col("value") > 100, F.col("event_id")), ignorenulls=True).over(w).alias("donor"))


@query("WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, 77.0 * n / (SELECT sum(n) FROM s) AS raw FROM s) SELECT source, CAST(floor(raw) + CASE WHEN row_number() OVER (ORDER BY round(raw - floor(raw), 9) DESC, source) <= 77 - (SELECT sum(floor(raw)) FROM r) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r")
def w05_largest_remainder(spark, d):
    n = table(spark, d, "documents").groupBy("source").agg(F.count(ONE).alias("n"))
    return S.largest_remainder(n, "n", F.lit(77), ["source"]).select("source", "quota")


@query("SELECT p_partkey, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN p_name || '-' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 6) ELSE p_name END AS id FROM part")
def w06_collision_suffix(spark, d):
    p = table(spark, d, "part")
    often = p.groupBy("p_name").agg((F.count(ONE) > 1).alias("clash"))
    return p.join(often, "p_name").select("p_partkey", F.when(F.col("clash"), F.concat("p_name", F.lit("-"), F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 6))).otherwise(F.col("p_name")).alias("id"))


@query("SELECT c_nationkey, c_custkey, CAST(r AS INTEGER) AS rank FROM (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r <= 3")
def w07_top_k(spark, d):
    from ..operators.retrieval import top_k

    return top_k(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", 3).select("c_nationkey", "c_custkey", "rank")


@query("WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS rn FROM part) SELECT p_partkey, row_number() OVER (ORDER BY rn, p_type) - 1 AS pos FROM r")
def w08_interleave(spark, d):
    from ..operators.sampling import round_robin

    return round_robin(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", "p_partkey").select("p_partkey", "pos")


HOLM_SQL = "t AS (SELECT c_custkey, c_mktsegment, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE (c_custkey % 50) / 1000.0::DOUBLE END AS p FROM customer)"


@query("WITH " + HOLM_SQL + ", k AS (SELECT *, count(p) OVER (PARTITION BY c_mktsegment) AS m, row_number() OVER (PARTITION BY c_mktsegment, p IS NULL ORDER BY p, c_custkey) AS r FROM t) SELECT c_custkey, round(CASE WHEN p IS NOT NULL THEN max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY c_mktsegment, p IS NULL ORDER BY r) END, 9) AS p_holm FROM k")
def w09_holm(spark, d):
    t = table(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 50) / 1000.0).alias("p"))
    return S.holm(t, "p", ["c_mktsegment"], ["c_custkey"]).select("c_custkey", F.round("p_holm", 9).alias("p_holm"))


@query("SELECT s_suppkey, s_acctbal = max(s_acctbal) OVER (PARTITION BY s_nationkey) AS best FROM supplier")
def w10_best_flag(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") == F.max("s_acctbal").over(Window.partitionBy("s_nationkey"))).alias("best"))


@query("SELECT l_suppkey, bool_or(b) AS restarts FROM (SELECT l_suppkey, l_linenumber < lag(l_linenumber) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS b FROM lineitem) GROUP BY l_suppkey")
def w11_restarts(spark, d):
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, d, "lineitem").select("l_suppkey", (F.col("l_linenumber") < F.lag("l_linenumber").over(w)).alias("b")).groupBy("l_suppkey").agg(F.bool_or("b").alias("restarts"))


@query("SELECT user_id, event_id, event_type FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def w12_change_points(spark, d):
    from ..streaming.logs import change_points

    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return change_points(e, "user_id", "at", "event_type").select("user_id", "event_id", "event_type")


# ---- order, limits, sets


@query("SELECT o_orderkey, o_orderpriority FROM orders ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderpriority, o_orderkey")
def o01_category_order(spark, d):
    rank = F.create_map(*[F.lit(x) for kv in (("P", 0), ("O", 1), ("F", 2)) for x in kv])
    return table(spark, d, "orders").orderBy(rank[F.col("o_orderstatus")], "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 50")
def o03_prefix(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy("doc_id").limit(50)


@query("(SELECT doc_id, 'top' AS kind FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5) UNION ALL (SELECT doc_id, 'bottom' FROM documents ORDER BY n_chars, doc_id LIMIT 5)")
def o04_top_bottom(spark, d):
    t = table(spark, d, "documents").select("doc_id", "n_chars")
    return t.orderBy(F.desc("n_chars"), "doc_id").limit(5).select("doc_id", F.lit("top").alias("kind")).unionByName(t.orderBy("n_chars", "doc_id").limit(5).select("doc_id", F.lit("bottom").alias("kind")))


@query("WITH " + LINES + " SELECT doc_id, arg_max(text, (len(text), -ord)) AS longest FROM lines GROUP BY doc_id")
def o05_longest_line(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("longest"))


@query("SELECT doc_id, CAST(len(text) AS INTEGER) AS n FROM documents")
def o06_length_sorted_batches(spark, d):
    import pandas as pd

    def run(batches):
        for pdf in batches:  # the longest first, then the old order again: padding is least inside a model's batches
            order = pdf["text"].str.len().sort_values(ascending=False, kind="stable").index
            sizes = pd.Series({i: len(pdf.at[i, "text"]) for i in order})
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": sizes.loc[pdf.index].astype("int32")})

    return table(spark, d, "documents").select("doc_id", "text").mapInPandas(run, "doc_id long, n int")


@query("WITH s AS (SELECT doc_id, n_chars, (row_number() OVER (ORDER BY CAST('0x' || substr(md5('6|' || CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), doc_id) - 1) // 256 AS block FROM documents) SELECT doc_id, CAST(block AS BIGINT) AS block, CAST(row_number() OVER (PARTITION BY block ORDER BY n_chars, doc_id) - 1 AS INTEGER) AS pos FROM s")
def o07_shuffled_blocks(spark, d):
    from ..operators.sampling import placed_by_draw

    blocks = placed_by_draw(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 6).withColumn("block", F.expr("(place - 1) div 256"))
    pos = F.row_number().over(Window.partitionBy("block").orderBy("n_chars", "doc_id")) - 1
    return blocks.select("doc_id", "block", pos.alias("pos"))


@query("SELECT c_nationkey, arg_max(c_custkey, (c_mktsegment, c_acctbal, c_custkey)) AS best FROM customer GROUP BY c_nationkey")
def o08_argmax_tuple(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_mktsegment", "c_acctbal", "c_custkey")).alias("best"))


@query("SELECT c_custkey AS k, c_name AS name, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def u01_union_by_name(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT o_custkey AS id FROM orders UNION SELECT user_id FROM events")
def u02_set_union(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, d, "events").select("user_id")).distinct()


@query("SELECT o_custkey AS id FROM orders INTERSECT SELECT user_id FROM events")
def u03_intersection(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id")).intersect(table(spark, d, "events").select("user_id"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders")
def u04_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id")).exceptAll(table(spark, d, "orders").select("o_custkey").distinct())


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def u05_keep_last(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"))


@query("SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY user_id, props")
def u06_keep_first(spark, d):
    return D.first_of_key(table(spark, d, "events").select("user_id", "props", "event_id"), ["user_id", "props"], ["event_id"])


@query("WITH " + PAIRS + ", a AS (SELECT qa_id, t, count(*) AS n FROM (SELECT qa_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM pairs) GROUP BY ALL), b AS (SELECT qa_id, t, count(*) AS n FROM (SELECT qa_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS t FROM pairs) GROUP BY ALL) SELECT p.qa_id, CAST(coalesce((SELECT sum(least(a.n, b.n)) FROM a JOIN b USING (qa_id, t) WHERE a.qa_id = p.qa_id), 0) AS BIGINT) AS common FROM pairs p")
def u07_multiset_intersection(spark, d):
    return pairs(spark, d).select("qa_id", S.common_tokens(X.tokens("question"), X.tokens("answer")).cast("long").alias("common"))
