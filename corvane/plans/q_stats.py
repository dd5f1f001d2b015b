"""Queries of statistics: overlap metrics, agreement, tests, correlation, resampling, ranking metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from ..operators import retrieval as R
from ..operators import scoring
from .registry import query
from .stand_ins import PAIRS, SCORES, pairs, scores, table

ONE = "*"


def r6(c):
    return F.round(c, 6)


SIMPLE = {k: v for k, v in scoring.SIGNALS.items() if k not in ("number", "percent_or_stat")}


@query(
    "SELECT doc_id, round(1 - exp(-("
    + " + ".join(f"{w}::DOUBLE * least(len(regexp_extract_all(text, '{rx}')) / (greatest(len(regexp_extract_all(text, '\\S+')), 1) / 100.0::DOUBLE), {float(cap)}::DOUBLE)" for rx, w, cap in SIMPLE.values())
    + ") / 4.0::DOUBLE), 6) AS density FROM documents"
)
def m01_density(spark, d):
    return table(spark, d, "documents").select("doc_id", r6(scoring.density("text", SIMPLE)).alias("density"))


@query(r"SELECT doc_id, round(len(regexp_extract_all(lower(text), '\bthe\b|\bde\b')) / (greatest(len(regexp_extract_all(text, '\S+')), 1) / 100.0::DOUBLE), 6) AS topic_score FROM (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', 'x', 'g') AS text FROM documents)")
def m02_topic_score(spark, d):
    ascii_ = F.regexp_replace("text", r"[^\x00-\x7F]", "x")
    return table(spark, d, "documents").select("doc_id", ascii_.alias("t")).select("doc_id", r6(scoring.term_score("t", ["the", "de"], whole=True)).alias("topic_score"))


@query(
    """WITH s AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS t FROM documents), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id)
    SELECT a.doc_id AS a, b.doc_id AS b, round(CAST(count(x.t) AS DOUBLE) / least(a.n, b.n), 6) AS containment FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 LEFT JOIN (SELECT p.doc_id, p.t FROM s p JOIN s q ON q.doc_id = p.doc_id + 1 AND q.t = p.t) x ON x.doc_id = a.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n"""
)
def m03_containment(spark, d):
    t = table(spark, d, "documents").select("doc_id", F.array_distinct(X.tokens("text")).alias("s")).where(F.size("s") > 0)
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("s2"), F.col("doc_id").alias("b"))
    return t.join(nxt, "doc_id").select(F.col("doc_id").alias("a"), "b", r6(F.size(F.array_intersect("s", "s2")) / F.least(F.size("s"), F.size("s2"))).alias("containment"))


TOKENS_SQL = """ta AS (SELECT qa_id, t, count(*) AS n FROM (SELECT qa_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS t FROM pairs) GROUP BY ALL),
  tb AS (SELECT qa_id, t, count(*) AS n FROM (SELECT qa_id, unnest(regexp_extract_all(lower(answer), '[a-z0-9]+')) AS t FROM pairs) GROUP BY ALL),
  na AS (SELECT qa_id, sum(n) AS n FROM ta GROUP BY qa_id), nb AS (SELECT qa_id, sum(n) AS n FROM tb GROUP BY qa_id), co AS (SELECT qa_id, sum(least(ta.n, tb.n)) AS c FROM ta JOIN tb USING (qa_id, t) GROUP BY qa_id)"""


@query("WITH " + PAIRS + ", " + TOKENS_SQL + " SELECT p.qa_id, round(CASE WHEN coalesce(c, 0) = 0 THEN 0.0::DOUBLE ELSE 2.0 * (CAST(c AS DOUBLE) / na.n) * (CAST(c AS DOUBLE) / nb.n) / (CAST(c AS DOUBLE) / na.n + CAST(c AS DOUBLE) / nb.n) END, 6) AS f1 FROM pairs p LEFT JOIN co USING (qa_id) LEFT JOIN na ON na.qa_id = p.qa_id LEFT JOIN nb ON nb.qa_id = p.qa_id")
def m04_token_f1(spark, d):
    return pairs(spark, d).select("qa_id", r6(S.token_f1("question", "answer")).alias("f1"))


@query()
def m05_rouge_l(spark, d):
    return pairs(spark, d).select("qa_id", S.rouge_l("question", "answer").alias("rouge_l"))


@query()
def m06_exact_reproduction(spark, d):
    near = F.when(F.col("qa_id") % 2 == 0, F.col("answer")).otherwise(F.col("question"))
    return pairs(spark, d).select("qa_id", (S.rouge_l(near, "answer") >= 0.8).alias("reproduced"))


@query()
def m08_bootstrap_ci(spark, d):
    return S.boot_ci(scores(spark, d), "score", ["system", "split"])


@query("WITH " + SCORES + " SELECT system, split, CAST(count(score) AS BIGINT) AS n, round(CAST(sum(CAST(round(score * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*), 6) AS mean FROM scores GROUP BY ALL")
def m07_cell_means(spark, d):
    ci = S.boot_ci(scores(spark, d), "score", ["system", "split"], n_boot=50)
    return ci.select("system", "split", "n", r6("mean").alias("mean"))


def against_base(spark, d):
    s = scores(spark, d)
    base = s.where("system = 'view'").select("split", "item", F.col("score").alias("base"))
    return s.where("system <> 'view'").join(base, ["split", "item"])


@query()
def m09_paired_bootstrap(spark, d):
    return S.paired_boot(against_base(spark, d), "base", "score", ["system", "split"])


@query("WITH " + SCORES + " SELECT s.system, s.split, CAST(count(*) AS BIGINT) AS n, round(avg(s.score - b.score), 6) + 0.0 AS diff, round(avg(s.score - b.score) / stddev_samp(s.score - b.score), 5) + 0.0 AS dz FROM scores s JOIN scores b ON b.system = 'view' AND b.split = s.split AND b.item = s.item WHERE s.system <> 'view' GROUP BY ALL")
def m10_paired_difference(spark, d):
    p = S.paired_boot(against_base(spark, d), "base", "score", ["system", "split"], n_boot=50)
    return p.select("system", "split", "n", (r6("diff") + 0.0).alias("diff"), (F.round("dz", 5) + 0.0).alias("dz"))


CORRECT = "c AS (SELECT s.system, s.item, s.score >= 0.5 AS sys_ok, b.score >= 0.5 AS base_ok FROM scores s JOIN scores b ON b.system = 'view' AND b.split = s.split AND b.item = s.item WHERE s.system <> 'view')"


@query("WITH " + SCORES + ", " + CORRECT + ", n AS (SELECT system, CAST(count(*) FILTER (base_ok AND NOT sys_ok) AS BIGINT) AS b, CAST(count(*) FILTER (sys_ok AND NOT base_ok) AS BIGINT) AS c FROM c GROUP BY system) SELECT system, b, c, CASE WHEN b + c > 0 THEN round(CAST(c AS DOUBLE) / (b + c) - 0.5, 6) ELSE 0.0::DOUBLE END AS cohen_g, round(CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))) FROM range(0, least(b, c) + 1) t(i))) END, 6) AS p FROM n")
def m11_mcnemar(spark, d):
    ok = against_base(spark, d).select("system", (F.col("score") >= 0.5).alias("s"), (F.col("base") >= 0.5).alias("b"))
    n = ok.groupBy("system").agg(F.count_if(F.col("b") & ~F.col("s")).alias("b"), F.count_if(F.col("s") & ~F.col("b")).alias("c"))
    b, c = F.col("b"), F.col("c")
    return n.select("system", "b", "c", F.when(b + c > 0, r6(c / (b + c) - 0.5)).otherwise(F.lit(0.0)).alias("cohen_g"), r6(S.mcnemar_p(b, c)).alias("p"))


@query("WITH " + SCORES + ", " + CORRECT + ", n AS (SELECT system, item % 3 AS split, CAST(count(*) FILTER (base_ok AND NOT sys_ok) AS BIGINT) AS b, CAST(count(*) FILTER (sys_ok AND NOT base_ok) AS BIGINT) AS c FROM c GROUP BY ALL), p AS (SELECT system, split, round(CASE WHEN b + c = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2.0))) FROM range(0, least(b, c) + 1) t(i))) END, 9) AS p FROM n), k AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, system, split) AS r FROM p) SELECT system, split, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY r), 6) AS p_holm FROM k")
def m12_holm(spark, d):
    ok = against_base(spark, d).select("system", (F.col("item") % 3).alias("split"), (F.col("score") >= 0.5).alias("s"), (F.col("base") >= 0.5).alias("b"))
    n = ok.groupBy("system", "split").agg(F.count_if(F.col("b") & ~F.col("s")).alias("b"), F.count_if(F.col("s") & ~F.col("b")).alias("c"))
    p = n.select("system", "split", F.round(S.mcnemar_p(F.col("b"), F.col("c")), 9).alias("p"), F.lit("mcnemar").alias("test"))
    return S.holm(p, "p", ["test"], ["system", "split"]).select("system", "split", r6("p_holm").alias("p_holm"))


@query("WITH n AS (SELECT CAST(count(*) FILTER (quality = 1 AND toxic = 1) AS DOUBLE) AS a, CAST(count(*) FILTER (quality = 1 AND toxic = 0) AS DOUBLE) AS b, CAST(count(*) FILTER (quality = 0 AND toxic = 1) AS DOUBLE) AS c, CAST(count(*) FILTER (quality = 0 AND toxic = 0) AS DOUBLE) AS d FROM labels), e AS (SELECT *, a + b + c + d AS n, ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d)) AS pe FROM n) SELECT round(((a + d) / n - pe) / (1 - pe), 6) AS kappa FROM e")
def m13_kappa(spark, d):
    cell = lambda a, b: F.count_if((F.col("quality") == a) & (F.col("toxic") == b))
    n = table(spark, d, "labels").agg(cell(1, 1).alias("a"), cell(1, 0).alias("b"), cell(0, 1).alias("c"), cell(0, 0).alias("d"))
    return n.select(r6(S.kappa_2x2(*[F.col(x) for x in "abcd"])).alias("kappa"))


VERDICTS = """v AS (SELECT o_custkey % 5 AS g, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS x, CASE WHEN o_orderkey % 3 = 0 THEN (CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) ELSE o_orderkey % 7 % 3 END AS y FROM orders)"""
KAPPA_SQL = """m AS (SELECT {g} AS g, count(*) AS n FROM v GROUP BY {g}), c AS (SELECT {g} AS g, x, y, count(*) AS n FROM v GROUP BY ALL), rx AS (SELECT {g} AS g, x, count(*) AS n FROM v GROUP BY ALL), ry AS (SELECT {g} AS g, y, count(*) AS n FROM v GROUP BY ALL),
  e AS (SELECT rx.g, x, y, CAST(rx.n AS DOUBLE) * ry.n / m.n AS e FROM rx JOIN ry USING (g) JOIN m USING (g)),
  t AS (SELECT e.g, sum(CASE WHEN x <> y THEN coalesce(c.n, 0) ELSE 0 END) AS o1, sum(CASE WHEN x <> y THEN e ELSE 0 END) AS e1, sum((x - y) * (x - y) * coalesce(c.n, 0)) AS o2, sum((x - y) * (x - y) * e) AS e2, sum(CASE WHEN x = y THEN coalesce(c.n, 0) ELSE 0 END) AS agree FROM e LEFT JOIN c USING (g, x, y) GROUP BY e.g)
SELECT {out} CAST(m.n AS BIGINT) AS n, round(CAST(agree AS DOUBLE) / m.n, 6) AS agreement, round(1 - o1 / e1, 6) AS kappa, round(1 - o2 / e2, 6) AS kappa_quadratic FROM t JOIN m USING (g)"""


def verdicts(spark, d):
    own = F.col("o_orderstatus")
    other = F.get(F.array(F.lit("F"), F.lit("O"), F.lit("P")), (F.col("o_orderkey") % 7 % 3).cast("int"))
    return table(spark, d, "orders").select((F.col("o_custkey") % 5).alias("g"), own.alias("a"), F.when(F.col("o_orderkey") % 3 == 0, own).otherwise(other).alias("b"))


@query("WITH " + VERDICTS + ", " + KAPPA_SQL.format(g="1", out=""))
def m14_kappas(spark, d):
    k = S.kappas(verdicts(spark, d), "a", "b", ["F", "O", "P"])
    return k.select("n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"), r6("kappa_quadratic").alias("kappa_quadratic"))


@query("WITH " + VERDICTS + " SELECT CAST(g AS BIGINT) AS g, round(CAST(sum(CASE x WHEN 0 THEN 2 WHEN 2 THEN 1 ELSE 0 END) AS DOUBLE) / 2 / count(*), 6) AS acc FROM v GROUP BY g")
def m15_lenient_accuracy(spark, d):
    half = F.when(F.col("a") == "F", 2).when(F.col("a") == "P", 1).otherwise(0)
    return verdicts(spark, d).groupBy("g").agg(r6(F.sum(half) / 2 / F.count(ONE)).alias("acc"))


@query("WITH t AS (SELECT source, CAST(n_chars AS DOUBLE) AS x, CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS y FROM documents), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY x) + (count(*) OVER (PARTITION BY source, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY source ORDER BY y) + (count(*) OVER (PARTITION BY source, y) - 1) / 2.0 AS ry FROM t) SELECT source, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY source")
def m16_correlations(spark, d):
    t = table(spark, d, "documents").select("source", F.col("n_chars").cast("double").alias("x"), X.n_words("text").cast("double").alias("y"))
    r = t.select("source", "x", "y", S.average_rank("x", ["source"]).alias("rx"), S.average_rank("y", ["source"]).alias("ry"))
    return r.groupBy("source").agg(r6(F.corr("x", "y")).alias("pearson"), r6(F.corr("rx", "ry")).alias("spearman"))


@query("SELECT round(corr(CAST(n_chars AS DOUBLE), CAST(quality AS DOUBLE)), 6) AS r, CAST(count(*) AS BIGINT) AS n FROM documents JOIN labels USING (doc_id)")
def m17_point_biserial(spark, d):
    both = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return both.agg(r6(F.corr(F.col("n_chars").cast("double"), F.col("quality").cast("double"))).alias("r"), F.count(ONE).alias("n"))


@query("WITH t AS (SELECT lang, n_chars AS x, quality AS y FROM documents JOIN labels USING (doc_id)), r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY x) + (count(*) OVER (PARTITION BY lang, x) - 1) / 2.0 AS r FROM t), s AS (SELECT lang, CAST(count(*) AS BIGINT) AS n, sum(y) AS p, sum(CASE WHEN y = 1 THEN r END) AS s FROM r GROUP BY lang) SELECT lang, n, CASE WHEN n >= 10 AND p > 0 AND n > p THEN round(CAST((s - p * (p + 1) / 2.0) / (p * (n - p)) AS DOUBLE), 6) END AS auc FROM s")
def m18_auc(spark, d):
    both = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return S.auc(both, "quality", "n_chars", ["lang"]).select("lang", "n", r6("auc").alias("auc"))


@query("WITH " + SCORES + ", m AS (SELECT system, split, CAST(sum(CAST(round(score * 100) AS BIGINT)) AS DOUBLE) / count(*) AS a, CAST(count(*) FILTER (score >= 0.5) AS DOUBLE) / count(*) AS b FROM scores GROUP BY ALL) SELECT m.system, m.split, (m.a > v.a) = (m.b > v.b) AS sign_match FROM m JOIN m v ON v.system = 'view' AND v.split = m.split WHERE m.system <> 'view'")
def m19_sign_match(spark, d):
    m = scores(spark, d).groupBy("system", "split").agg((F.sum(F.round(F.col("score") * 100).cast("long")) / F.count(ONE)).alias("a"), (F.count_if(F.col("score") >= 0.5) / F.count(ONE)).alias("b"))
    v = m.where("system = 'view'").select("split", F.col("a").alias("va"), F.col("b").alias("vb"))
    return m.where("system <> 'view'").join(v, "split").select("system", "split", ((F.col("a") > F.col("va")) == (F.col("b") > F.col("vb"))).alias("sign_match"))


@query("WITH " + VERDICTS + ", " + KAPPA_SQL.format(g="v.g", out="CAST(t.g AS BIGINT) AS g, "))
def m20_kappa_breakdown(spark, d):
    k = S.kappas(verdicts(spark, d), "a", "b", ["F", "O", "P"], ["g"])
    return k.select("g", "n", r6("agreement").alias("agreement"), r6("kappa").alias("kappa"), r6("kappa_quadratic").alias("kappa_quadratic"))


def two_flags(a: str, b: str) -> str:
    return f"n AS (SELECT CAST(count(*) FILTER ({a} AND {b}) AS DOUBLE) AS a, CAST(count(*) FILTER ({a} AND NOT {b}) AS DOUBLE) AS b, CAST(count(*) FILTER (NOT {a} AND {b}) AS DOUBLE) AS c, CAST(count(*) FILTER (NOT {a} AND NOT {b}) AS DOUBLE) AS d FROM lineitem), e AS (SELECT *, a + b + c + d AS n, ((a + b) * (a + c) + (c + d) * (b + d)) / ((a + b + c + d) * (a + b + c + d)) AS pe FROM n)"


@query("WITH " + two_flags("(l_returnflag = 'R')", "(l_linestatus = 'O')") + " SELECT CAST(n AS BIGINT) AS n, round(((a + d) / n - pe) / (1 - pe), 6) AS kappa FROM e")
def m21_hallucination_check(spark, d):
    a, b = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    n = table(spark, d, "lineitem").agg(F.count_if(a & b).alias("a"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(~a & ~b).alias("d"), F.count(ONE).alias("n"))
    return n.select("n", r6(S.kappa_2x2(*[F.col(x) for x in "abcd"])).alias("kappa"))


@query("WITH " + two_flags("(l_discount >= 0.05)", "(l_tax >= 0.04)") + ", r AS (SELECT corr(l_discount, l_tax) AS r FROM lineitem) SELECT CAST(n AS BIGINT) AS n, round((a + d) / n, 6) AS agreement, round(((a + d) / n - pe) / (1 - pe), 6) AS kappa, round((SELECT r FROM r), 5) AS pearson, round((a + b) / n, 6) AS rate_a, round((a + c) / n, 6) AS rate_b FROM e")
def m22_checker_agreement(spark, d):
    a, b = F.col("l_discount") >= 0.05, F.col("l_tax") >= 0.04
    n = table(spark, d, "lineitem").agg(F.count_if(a & b).alias("a"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"), F.count_if(~a & ~b).alias("d"), F.count(ONE).alias("n"), F.corr("l_discount", "l_tax").alias("r"))
    c = F.col
    return n.select("n", r6((c("a") + c("d")) / c("n")).alias("agreement"), r6(S.kappa_2x2(*[c(x) for x in "abcd"])).alias("kappa"), F.round("r", 5).alias("pearson"), r6((c("a") + c("b")) / c("n")).alias("rate_a"), r6((c("a") + c("c")) / c("n")).alias("rate_b"))


@query("SELECT * FROM (VALUES ('factual', 27), ('definition', 27), ('explanation', 26), ('application', 20)) t(name, quota)")
def m23_type_quotas(spark, d):
    mix = spark.createDataFrame([("factual", 20, 0), ("definition", 20, 1), ("explanation", 20, 2), ("application", 15, 3)], "name string, weight int, ord int")
    return S.largest_remainder(mix, "weight", F.lit(100), ["ord"]).select("name", F.col("quota").cast("int").alias("quota"))


@query("SELECT event_id, round(exp(-value / 100) / (exp(-value / 100) + exp(-1.0)), 6) AS p_yes FROM events")
def m24_yes_probability(spark, d):
    yes, no = F.exp(-F.col("value") / 100), F.exp(F.lit(-1.0))
    return table(spark, d, "events").select("event_id", r6(yes / (yes + no)).alias("p_yes"))


PRICES = [("click", 2.0, 10.0), ("error", 4.0, 20.0), ("view", 1.0, 5.0)]


@query("WITH p AS (SELECT * FROM (VALUES ('click', 2.0::DOUBLE, 10.0::DOUBLE), ('error', 4.0, 20.0), ('view', 1.0, 5.0)) t(model, inp, outp)) SELECT event_id, round((user_id * inp + (event_id % 100) * outp) / 1e6 * CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END, 9) AS cost FROM events JOIN p ON model = event_type")
def m25_prices(spark, d):
    p = spark.createDataFrame(PRICES, "model string, inp double, outp double")
    e = table(spark, d, "events").join(F.broadcast(p), F.col("model") == F.col("event_type"))  # the price list: a row per model
    return e.select("event_id", F.round((F.col("user_id") * F.col("inp") + (F.col("event_id") % 100) * F.col("outp")) / 1e6 * F.when(F.col("event_id") % 2 == 0, 0.5).otherwise(1.0), 9).alias("cost"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS done, round((1.0 - CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM events)) * date_diff('second', min(ts), max(ts)) / 60, 4) AS eta_minutes FROM events GROUP BY event_type")
def m26_eta(spark, d):
    e = table(spark, d, "events")
    total = e.agg(F.count(ONE).alias("total"))
    secs = F.unix_timestamp(F.date_trunc("second", F.max("ts"))) - F.unix_timestamp(F.date_trunc("second", F.min("ts")))
    g = e.groupBy("event_type").agg(F.count(ONE).alias("done"), secs.alias("secs")).crossJoin(F.broadcast(total))
    return g.select("event_type", "done", F.round((1 - F.col("done") / F.col("total")) * F.col("secs") / 60, 4).alias("eta_minutes"))


RANKS = "r AS (SELECT c_nationkey AS q, c_custkey AS i, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY {} ) AS INTEGER) AS rank FROM customer)"


def ranking(spark, d, score):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("i"), score.alias("s"))
    return R.top_k(c, "q", "i", "s", 100)


RRF_SQL = "a AS (SELECT c_nationkey AS q, c_custkey AS i, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), b AS (SELECT c_nationkey AS q, c_custkey AS i, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 97 DESC, c_custkey) AS rank FROM customer), f AS (SELECT q, i, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM a WHERE rank <= 100 UNION ALL SELECT * FROM b WHERE rank <= 100) GROUP BY ALL)"


def fused(spark, d):
    return R.rrf([ranking(spark, d, F.col("c_acctbal")), ranking(spark, d, (F.col("c_custkey") % 97).cast("double"))], "q", "i")


@query("WITH " + RRF_SQL + " SELECT q, i, round(score, 9) AS score FROM f")
def m27_rrf(spark, d):
    return fused(spark, d).select("q", "i", F.round("score", 9).alias("score"))


@query("WITH " + RRF_SQL + ", k AS (SELECT q, i, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, i) AS rank FROM f), h AS (SELECT q, min(rank) AS first FROM k WHERE i % 11 = 0 GROUP BY q) SELECT CAST(count(*) AS BIGINT) AS n, round(avg(CAST(coalesce(first <= 1, false) AS INT)), 6) AS recall_1, round(avg(CAST(coalesce(first <= 5, false) AS INT)), 6) AS recall_5, round(avg(CAST(coalesce(first <= 10, false) AS INT)), 6) AS recall_10, round(avg(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first ELSE 0 END), 6) AS mrr FROM (SELECT DISTINCT c_nationkey AS q FROM customer) LEFT JOIN h USING (q)")
def m28_ranking_metrics(spark, d):
    ranked = R.top_k(fused(spark, d).withColumn("score", F.round("score", 9)), "q", "i", "score", 1000)
    c = table(spark, d, "customer")
    relevant = c.where("c_custkey % 11 = 0").select(F.col("c_nationkey").alias("q"), F.col("c_custkey").alias("i"))
    m = R.metrics(ranked, relevant, c.select(F.col("c_nationkey").alias("q")).distinct(), "q", "i")
    return m.select("n", *[r6(x).alias(x) for x in ("recall_1", "recall_5", "recall_10", "mrr")])


# ---- the flagship: every system against the base


@query("WITH " + SCORES + ", m AS (SELECT s.split, s.system, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(round(s.score * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS mean, CAST(sum(CAST(round((s.score - b.score) * 100) AS BIGINT)) AS DOUBLE) / 100 / count(*) AS diff FROM scores s JOIN scores b ON b.system = 'view' AND b.split = s.split AND b.item = s.item GROUP BY ALL) SELECT system, split, n, round(mean, 6) AS mean, round(diff, 6) AS diff, CAST(rank() OVER (PARTITION BY split ORDER BY round(mean, 6) DESC) AS INTEGER) AS place FROM m")
def flagship_systems(spark, d):
    s = scores(spark, d)
    base = s.where("system = 'view'").select("split", "item", F.col("score").alias("base"))
    hundredths = lambda c: F.sum(F.round(c * 100).cast("long")) / 100 / F.count(ONE)
    m = s.join(base, ["split", "item"]).groupBy("system", "split").agg(F.count(ONE).alias("n"), r6(hundredths(F.col("score"))).alias("mean"), r6(hundredths(F.col("score") - F.col("base"))).alias("diff"))
    return m.withColumn("place", F.rank().over(Window.partitionBy("split").orderBy(F.desc("mean"))))
