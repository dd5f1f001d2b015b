"""Queries of general relational features (as-of join, window functions, cubes, sketches, event-time windows) and of what surrounds a run."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import grading as G
from ..operators import running as U
from .q_docs import scratch
from .q_flow import HEX
from .registry import query
from .stand_ins import PAIRS, pairs, table

ONE = "*"


@query("WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY ALL) SELECT a.event_id, b.event_id AS latest FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts")
def j15_asof_join(spark, d):
    """Each event of one type with the user's latest one of another at or before it: a union in order of time, no join of ranges."""
    e = table(spark, d, "events")
    names = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()  # two names
    w = Window.partitionBy("user_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    rows = e.where(F.col("event_type").isin(names.lo, names.hi))
    latest = F.max(F.when(F.col("event_type") == names.hi, F.struct("ts", "event_id"))).over(w)
    return rows.withColumn("l", latest).where(F.col("event_type") == names.lo).select("event_id", F.col("l.event_id").alias("latest"))


@query("SELECT c_custkey, lag(c_acctbal) OVER w AS before, lead(c_acctbal, 2, 0.0) OVER w AS after, ntile(4) OVER w AS quarter, nth_value(c_custkey, 3) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third, round(percent_rank() OVER w, 9) AS rank_share, round(cume_dist() OVER w, 9) AS at_most, CAST(dense_rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS INTEGER) AS segment, CAST(sum(1) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS BIGINT) AS near FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)")
def w14_window_functions(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "customer").select(
        "c_custkey", F.lag("c_acctbal").over(w).alias("before"), F.lead("c_acctbal", 2, 0.0).over(w).alias("after"), F.ntile(4).over(w).cast("long").alias("quarter"), F.nth_value("c_custkey", 3).over(whole).alias("third"),
        F.round(F.percent_rank().over(w), 9).alias("rank_share"), F.round(F.cume_dist().over(w), 9).alias("at_most"), F.dense_rank().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment")).alias("segment"),
        F.sum(F.lit(1)).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal").rangeBetween(-500, 500)).alias("near"),
    )


@query("SELECT event_type, CAST(count(DISTINCT user_id) AS BIGINT) AS exact, TRUE AS near FROM events GROUP BY event_type")
def a33_approximate_distinct(spark, d):
    exact, about = F.countDistinct("user_id"), F.approx_count_distinct("user_id", 0.02)
    return table(spark, d, "events").groupBy("event_type").agg(exact.alias("exact"), (F.abs(about - exact) <= F.greatest(F.lit(2), exact * 0.1)).alias("near"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers, CAST(grouping(o_orderstatus) AS INTEGER) AS all_status FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def a34_cube(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(ONE).alias("n"), F.countDistinct("o_custkey").alias("customers"), F.grouping("o_orderstatus").cast("int").alias("all_status"))


@query("WITH t AS (SELECT user_id, epoch(ts)::DOUBLE AS s FROM events), g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) < 86400 THEN 0 ELSE 1 END AS new FROM t), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, CAST(count(*) AS BIGINT) AS n, min(s) AS first FROM i GROUP BY user_id, k")
def t10_session_windows(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    g = e.groupBy("user_id", F.session_window("at", "1 day")).agg(F.count(ONE).alias("n"), F.min("at").alias("f"))
    return g.select("user_id", "n", F.col("f").cast("double").alias("first"))


@query("SELECT s_suppkey, 'S' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS code, s_acctbal * 2 AS twice FROM supplier")
def l29_registered_functions(spark, d):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION corvane_code(k BIGINT) RETURNS STRING RETURN concat('S', lpad(cast(k AS string), 6, '0'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION corvane_twice(x DOUBLE) RETURNS DOUBLE RETURN x * 2")
    return table(spark, d, "supplier").selectExpr("s_suppkey", "corvane_code(s_suppkey) AS code", "corvane_twice(s_acctbal) AS twice")


@query("SELECT conv_id, CAST(sum(2 + len(regexp_extract_all(text, '\\S+'))) AS INTEGER) AS n_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN 1 + len(regexp_extract_all(text, '\\S+')) ELSE 0 END) AS INTEGER) AS n_learned, string_agg(CASE WHEN role = 'assistant' THEN array_to_string(regexp_extract_all(text, '\\S+') || ['<|end|>'], ' ') END, ' ' ORDER BY turn) AS learned FROM conversations GROUP BY conv_id")
def l25_masked_chats(spark, d):
    c = U.masked_chats(table(spark, d, "conversations"))
    return c.select("conv_id", F.size("tokens").alias("n_tokens"), "n_learned", F.when(F.col("n_learned") > 0, F.array_join(F.array_compact("labels"), " ")).alias("learned"))


def sometimes_json(prompts: list[str]) -> list[str | None]:
    return [f'{{"score": {int(a[:8], 16) % 5}}}' if int(a[:8], 16) % 3 else "not now" for a in G.digests(prompts)]


@query("WITH " + PAIRS + ", p AS (SELECT qa_id, " + HEX.format("md5(question)", 1) + " AS a, " + HEX.format("md5(question || chr(10) || 'Answer 2: JSON with score.')", 1) + " AS b FROM pairs) SELECT qa_id, CASE WHEN a % 3 <> 0 THEN a % 5 WHEN b % 3 <> 0 THEN b % 5 END AS score, CASE WHEN a % 3 <> 0 THEN 1 ELSE 2 END AS asked FROM p")
def l05_asked_until_valid(spark, d):
    p = pairs(spark, d).select("qa_id", "question")
    return U.asked_until_valid(p, F.col("question"), "score: bigint", ["score"], sometimes_json).select("qa_id", F.col("parsed.score").alias("score"), "asked")


@query("SELECT unnest(['scan', 'clean', 'split', 'scan', 'clean', 'split']) AS stage, unnest(['ran', 'failed', 'not reached', 'skipped', 'ran', 'ran']) AS outcome, unnest([1, 1, 1, 2, 2, 2]) AS run")
def l28_stages_with_markers(spark, d):
    markers, works = scratch(spark, "markers"), iter([False, True])

    def clean():
        if not next(works):
            raise OSError("no space")

    stages = [("scan", lambda: None), ("clean", clean), ("split", lambda: None)]
    out = [(n, o, run) for run in (1, 2) for n, o in U.run_stages(spark, stages, markers)]
    return spark.createDataFrame(out, "stage string, outcome string, run int")


@query("SELECT unnest(['chunk.most', 'root of relative', 'absolute']) AS what, unnest(['1000', 'below', '/data/x']) AS value")
def s11_config(spark, d):
    at = scratch(spark, "config")
    spark.createDataFrame([(json.dumps({"chunk": {"most": 1000}}),)], "value string").coalesce(1).write.text(at + "/c.json")
    c = U.load_config(spark, at + "/c.json")
    rows = [("chunk.most", str(c["chunk"]["most"])), ("root of relative", "below" if U.resolve(c, "in/a") == at + "/in/a" else "elsewhere"), ("absolute", U.resolve(c, "/data/x"))]
    return spark.createDataFrame(rows, "what string, value string")
