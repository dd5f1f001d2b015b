"""Queries of sinks, model grading with offline clients, and what a run writes at its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as K
from ..operators import duplicates as D
from ..operators import grading as G
from ..operators import sampling as Z
from ..sources import files as FS
from ..streaming import logs as T
from .q_docs import DRAW, scratch
from .registry import query
from .stand_ins import PAIRS, SCORES, pairs, scores, table

ONE = "*"
HEX = "CAST('0x' || substr({}, {}, 8) AS BIGINT)"
VERDICT = "(['incorrect', 'partly_correct', 'correct'])[" + HEX.format("g", 1) + " % 3 + 1]"


# ---- sinks


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey % 2 = 0")
def k01_overwrite(spark, d):
    at, c = scratch(spark, "sink"), table(spark, d, "customer").select("c_custkey", "c_name")
    FS.write_jsonl(c, at)
    FS.write_jsonl(c.where("c_custkey % 2 = 0"), at)
    return FS.read_jsonl(spark, at, "c_custkey long, c_name string")


@query("SELECT c_custkey, c_name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0")
def k02_append(spark, d):
    at, c = scratch(spark, "sink"), table(spark, d, "customer").select("c_custkey", "c_name")
    FS.write_jsonl(c, at, append=True)
    FS.write_jsonl(c.where("c_custkey % 3 = 0"), at, append=True)
    return FS.read_jsonl(spark, at, "c_custkey long, c_name string")


@query("SELECT event_id, event_type FROM events")
def k03_buffered_append(spark, d):
    at, out, marks = (scratch(spark, n) for n in ("in", "out", "marks"))
    e = table(spark, d, "events").select("event_id", "event_type")
    stream = lambda: spark.readStream.schema("event_id long, event_type string").parquet(at)
    for part in (0, 1):  # what is there the second time only is appended
        e.where(f"event_id % 2 = {part}").write.mode("append").parquet(at)
        T.append_buffered(stream(), out, marks)
    return spark.read.schema("event_id long, event_type string").json(out)


@query("SELECT 's_suppkey,s_name' AS header, CAST(count(*) AS BIGINT) AS n FROM supplier")
def k04_csv_header(spark, d):
    at = scratch(spark, "csv")
    FS.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name"), at)
    return FS.read_csv_text(spark, at).agg(F.count(ONE).alias("n")).select(F.lit(",".join(FS.read_csv_text(spark, at).columns)).alias("header"), "n")


@query("SELECT unnest(['events', CAST(count(*) AS VARCHAR) || ' rows', CAST(count(DISTINCT event_type) AS VARCHAR) || ' types']) AS value FROM events")
def k07_report(spark, d):
    at, r = scratch(spark, "report"), table(spark, d, "events").agg(F.count(ONE), F.countDistinct("event_type")).first()  # two numbers
    FS.report(spark, ["events", f"{r[0]} rows", f"{r[1]} types"], at)
    return spark.read.text(at)


@query(
    "WITH s AS (SELECT n_regionkey AS region, CAST(count(*) AS BIGINT) AS n FROM nation GROUP BY ALL), r AS (SELECT 2 + row_number() OVER (ORDER BY region) AS i, '| ' || region || ' | ' || CASE WHEN n = (SELECT max(n) FROM s) THEN '**' || n || '**' ELSE CAST(n AS VARCHAR) END || ' |' AS line FROM s) "
    "SELECT CAST(i AS INTEGER) AS i, line FROM (SELECT 1 AS i, '| region | n |' AS line UNION ALL SELECT 2, '|---|---|' UNION ALL SELECT * FROM r UNION ALL SELECT 3 + (SELECT count(*) FROM s), '' UNION ALL SELECT 4 + (SELECT count(*) FROM s), 'most in bold')"
)
def k08_table_text(spark, d):
    s = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(F.count(ONE).alias("n")).orderBy("region")  # a row per region
    md, _ = FS.table_text(s, {"n": True}, note="most in bold")
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(md.rstrip("\n").split("\n"))], "i int, line string")


@query("SELECT s_suppkey, s_nationkey FROM supplier ORDER BY s_nationkey, s_suppkey")
def o02_sorted_output(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", "s_nationkey").orderBy("s_nationkey", "s_suppkey")


# ---- texts


@query()
def x27_title_ratio(spark, d):
    """Each page's title against the next page's."""
    t = table(spark, d, "pages").select("page_id", X.normalize_title(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title", 1)).alias("t"))
    both = t.join(t.select((F.col("page_id") - 1).alias("page_id"), F.col("t").alias("u")), "page_id").where("length(t) >= 12 and length(u) >= 12")
    return both.select("page_id", D.title_ratio("t", "u").alias("ratio"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n_tokens FROM documents")
def x31_token_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", K.WORDS.of(F.col("text")).alias("n_tokens"))


@query("SELECT page_id, CASE WHEN length(html) = 0 THEN 'corrupt' ELSE 'ok' END AS status, length(html) > 2000 AS long FROM pages")
def s02_content_scan(spark, d):
    """Content of raw files: a row per file, whatever it holds."""
    from ..operators.models import content_scan

    return content_scan(table(spark, d, "pages").select("page_id", F.col("html").alias("content")), "page_id").select("page_id", "status", (F.col("n_chars") > 2000).alias("long"))


# ---- grading


@query("WITH " + PAIRS + " SELECT qa_id, md5('second ' || md5('first ' || question)) AS answer FROM pairs")
def l03_two_rounds(spark, d):
    p = pairs(spark, d).select("qa_id", "question")
    return G.asked_in_turn(p, F.concat(F.lit("first "), "question"), lambda a: F.concat(F.lit("second "), a)).select("qa_id", "answer")


@query("WITH " + PAIRS + " SELECT qa_id, CASE WHEN turn % 3 <> 0 THEN CAST(len(question) AS VARCHAR) END AS result, CASE WHEN turn % 3 = 0 THEN 'ValueError: no answer' END AS error FROM pairs")
def l06_errors_per_item(spark, d):
    def work(x: str) -> str:
        if x.startswith("!"):
            raise ValueError("no answer")
        return str(len(x))

    p = pairs(spark, d).select("qa_id", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("!"), "question")).otherwise(F.col("question")).alias("q"))
    return G.each(p, "qa_id", "q", work)


@query("WITH " + PAIRS + ", s AS (SELECT qa_id, question, (qa_id % 100) / 100.0::DOUBLE AS score FROM pairs), a AS (SELECT *, md5('score ' || question) AS g FROM s) SELECT qa_id, CASE WHEN score BETWEEN 0.3 AND 0.4 THEN (" + HEX.format("g", 1) + " % 101) / 100.0::DOUBLE ELSE score END AS score, score BETWEEN 0.3 AND 0.4 AS rescored FROM a")
def l13_borderline_rescore(spark, d):
    s = pairs(spark, d).select("qa_id", "question", ((F.col("qa_id") % 100) / 100.0).alias("score"))
    return G.rescored(s, "score", F.concat(F.lit("score "), "question"), lambda a: G.digit(a, 101) / 100.0, 0.3, 0.4).select("qa_id", "score", "rescored")


@query("WITH " + PAIRS + ", n AS (SELECT qa_id, question, answer, md5('paraphrase ' || question) AS q FROM pairs), g AS (SELECT *, md5(concat_ws(chr(10), 'grade', q, answer, question)) AS g FROM n) SELECT " + VERDICT + " AS verdict, CAST(count(*) AS BIGINT) AS n, CAST(sum(" + HEX.format("g", 9) + " % 4) AS BIGINT) AS unsupported FROM g GROUP BY 1")
def l14_new_paraphrases_graded(spark, d):
    p = pairs(spark, d).select("qa_id", "question", F.col("answer").alias("reference"))
    made = G.asked(p, F.concat(F.lit("paraphrase "), "question")).withColumnRenamed("answer", "q").drop("error")
    g = G.graded(made, "q", "reference", "question")
    return g.groupBy("verdict").agg(F.count(ONE).alias("n"), F.sum("n_unsupported").alias("unsupported"))


@query("WITH " + PAIRS + ", o AS (SELECT q_type, question, answer, md5('closed book' || chr(10) || question) AS own FROM pairs), g AS (SELECT *, md5(concat_ws(chr(10), 'grade', question, answer, own)) AS g FROM o) SELECT q_type, CAST(count(*) AS BIGINT) AS n, round(avg(CASE " + VERDICT + " WHEN 'correct' THEN 1.0 WHEN 'partly_correct' THEN 0.5 ELSE 0.0 END), 6) AS lenient FROM g GROUP BY q_type")
def l15_closed_book(spark, d):
    p = pairs(spark, d).select("qa_id", "q_type", "question", F.col("answer").alias("reference"))
    return G.closed_book(p, "question", "reference", ["q_type"]).select("q_type", "n", F.round("lenient", 6).alias("lenient"))


@query("WITH " + PAIRS + ", m AS (SELECT system, qa_id, md5(concat_ws(chr(10), 'grade', question, answer, system)) AS g FROM pairs, (VALUES ('a'), ('b'), ('c')) s(system)) SELECT system, " + VERDICT + " AS verdict, CAST(count(*) AS BIGINT) AS n FROM m GROUP BY ALL")
def l16_models_graded(spark, d):
    p = pairs(spark, d).select("qa_id", "question", F.col("answer").alias("reference")).withColumn("system", F.explode(F.array(*[F.lit(x) for x in "abc"])))
    return G.graded(p, "question", "reference", "system").groupBy("system", "verdict").agg(F.count(ONE).alias("n"))


def _judged(spark, d):
    p = pairs(spark, d).select("qa_id", "question", (F.col("qa_id") % 3 > 0).alias("human"), (Z.draw(4, "qa_id") % 2 == 0).alias("dev"))
    return G.judged_by_prompts(p, {v: F.concat(F.lit(f"{v} "), "question") for v in ("v0", "v1", "v2")}, G.json_judge)


JUDGED = PAIRS + ", j0 AS (SELECT qa_id, version, qa_id % 3 > 0 AS human, " + DRAW.format(seed=4, key="qa_id") + " % 2 = 0 AS dev, " + HEX.format("md5(version || ' ' || question)", 1) + " AS h FROM pairs, (VALUES ('v0'), ('v1'), ('v2')) v(version)), judged AS (SELECT *, CASE WHEN h % 10 <> 9 THEN h % 2 = 1 END AS passed FROM j0)"


@query("WITH " + JUDGED + " SELECT version, passed, CAST(count(*) AS BIGINT) AS n FROM judged GROUP BY ALL")
def l17_prompt_versions(spark, d):
    return _judged(spark, d).groupBy("version", "passed").agg(F.count(ONE).alias("n"))


@query(
    "WITH " + JUDGED + ", c AS (SELECT version, dev, CAST(count(*) AS DOUBLE) AS n, sum(CAST(passed = human AS INT)) / CAST(count(*) AS DOUBLE) AS po, (sum(CAST(passed AS INT)) * CAST(sum(CAST(human AS INT)) AS DOUBLE) + sum(CAST(NOT passed AS INT)) * CAST(sum(CAST(NOT human AS INT)) AS DOUBLE)) / (CAST(count(*) AS DOUBLE) * count(*)) AS pe FROM judged WHERE passed IS NOT NULL GROUP BY ALL), "
    "k AS (SELECT version, round(any_value((po - pe) / (1 - pe)) FILTER (dev), 6) AS kappa_dev, round(any_value((po - pe) / (1 - pe)) FILTER (NOT dev), 6) AS kappa_test, CAST(any_value(n) FILTER (NOT dev) AS BIGINT) AS n_test FROM c GROUP BY version) SELECT * FROM k ORDER BY kappa_dev DESC, version LIMIT 1"
)
def l18_calibrated_prompt(spark, d):
    k = G.calibrated(_judged(spark, d), "human", "dev")
    return k.select("version", F.round("kappa_dev", 6).alias("kappa_dev"), F.round("kappa_test", 6).alias("kappa_test"), "n_test")


@query(
    "WITH " + PAIRS + ", w AS (SELECT qa_id, question, unnest(['one ' || answer, 'two ' || answer]) AS win FROM pairs), g AS (SELECT qa_id, md5(concat_ws(chr(10), 'Does the text support the claim?', question, win)) AS g FROM w), l AS (SELECT qa_id, -(" + HEX.format("g", 1) + " % 50) / 10.0::DOUBLE AS y, -(" + HEX.format("g", 9) + " % 50) / 10.0::DOUBLE AS n FROM g) SELECT qa_id, round(max(exp(y) / (exp(y) + exp(n))), 6) AS p_support FROM l GROUP BY qa_id"
)
def l20_support(spark, d):
    c = pairs(spark, d).select("qa_id", "question", F.explode(F.array(*[F.concat(F.lit(w), "answer") for w in ("one ", "two ")])).alias("win"))
    logs = lambda a: (-G.digit(a, 50) / 10.0, -G.digit(F.substring(a, 9, 8), 50) / 10.0)
    return G.supported(c, ["qa_id"], "question", "win", logs).select("qa_id", F.round("p_support", 6).alias("p_support"))


@query("WITH " + SCORES + ", c AS (SELECT system, split, CAST(count(*) AS BIGINT) AS n, avg(score) AS mean FROM scores GROUP BY ALL) SELECT c.system, c.split, c.n, round(c.mean, 6) AS mean, round(c.mean - b.mean, 6) + 0.0 AS delta FROM c LEFT JOIN c b ON b.split = c.split AND b.system = (SELECT min(system) FROM c)")
def l27_summary(spark, d):
    s = scores(spark, d)
    base = s.agg(F.min("system")).first()[0]  # one name
    return G.summary(s, "system", base, "score", ["split"]).select("system", "split", "n", F.round("mean", 6).alias("mean"), (F.round("delta", 6) + 0.0).alias("delta"))


# ---- adapters


@query("SELECT page_id, CASE WHEN length(html) % 3 = 0 THEN 'ocr' ELSE 'layout' END AS parser, page_id % 4 = 0 AS cached FROM pages")
def s04_parser_routing(spark, d):
    """A parser by the text layer; what the cache holds under the content's hash is not parsed again."""
    from ..operators.models import parsed

    p = table(spark, d, "pages").select("page_id", F.col("html").alias("content"), F.when(F.length("html") % 3 == 0, "no").otherwise("yes").alias("text_layer"))
    cache = parsed(p.where("page_id % 4 = 0"), None).select("hash", "parser", "text")
    return parsed(p, cache).select("page_id", "parser", "cached")


@query("SELECT unnest(['done', 'cancelled', 'failed']) AS outcome, unnest([3, 10, 4]) AS polls")
def t06_polling(spark, d):
    from ..operators.models import poll

    def job(states):
        left = iter(states)
        return lambda: next(left)

    def broken():
        raise OSError("unreachable")

    runs = [poll(job(["queued", "running", "done"]), most=10), poll(lambda: "running", most=10), poll(broken, most=10, errors=3)]
    return spark.createDataFrame([(r["outcome"], r["polls"]) for r in runs], "outcome string, polls int")
