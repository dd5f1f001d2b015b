"""The driver tables as inputs of the operators, each as a DataFrame and as the SQL that gives the same rows.

Texts of `documents` become blocks line by line; turns of `conversations` become question and answer pairs; `events` become scores
of systems (event types) on items (users); `orders` carry verdicts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qa_id, conv_id, question, answer, q_type, difficulty, dimension, doc_group, folder: a user's turn and the assistant's next."""
    c = table(spark, sf_dir, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    k = F.col("conv_id") * 7 + F.col("turn")
    named = lambda names, by: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(by, F.lit(len(names))) + 1).cast("int"))
    return user.join(reply, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("qa_id"), "conv_id", "turn", "question", "answer",
        named(["factual", "definition", "explanation", "application"], k).alias("q_type"),
        named(["easy", "medium", "hard"], F.col("conv_id") + F.col("turn")).alias("difficulty"),
        F.pmod("conv_id", F.lit(11)).cast("long").alias("dimension"),
        F.pmod("conv_id", F.lit(40)).cast("long").alias("doc_group"),
        F.when(F.pmod("conv_id", F.lit(3)) == 0, "book").otherwise("article").alias("folder"),
    )


PAIRS = """pairs AS (SELECT u.conv_id * 1000 + u.turn AS qa_id, u.conv_id, u.turn, u.text AS question, a.text AS answer,
  (['factual', 'definition', 'explanation', 'application'])[(u.conv_id * 7 + u.turn) % 4 + 1] AS q_type,
  (['easy', 'medium', 'hard'])[(u.conv_id + u.turn) % 3 + 1] AS difficulty, u.conv_id % 11 AS dimension, u.conv_id % 40 AS doc_group,
  CASE WHEN u.conv_id % 3 = 0 THEN 'book' ELSE 'article' END AS folder
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """system, split, item, score (0 to 1 in hundredths): the system's mean value on the item, capped."""
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("system"), F.col("user_id").alias("item")).agg(F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("n"))
    score = F.least(F.lit(100).cast("long"), F.expr("cents div (n * 100)")) / 100.0
    return e.select("system", F.concat(F.lit("s"), F.pmod("item", F.lit(3)).cast("string")).alias("split"), "item", score.alias("score"))


SCORES = """scores AS (SELECT event_type AS system, 's' || CAST(user_id % 3 AS VARCHAR) AS split, user_id AS item,
  least(100, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) // (count(*) * 100)) / 100.0 AS score FROM events GROUP BY event_type, user_id)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, text of every line of every document that is not blank."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text")).where(F.length(F.trim("text")) > 0)


LINES = """lines AS (SELECT * FROM (SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) WHERE length(trim(text)) > 0)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as blocks: a section changes at every fifth line, every ninth block is skipped, lines with '|' are tables."""
    t = F.col("text")
    return lines(spark, sf_dir).select(
        "doc_id", F.col("ord").cast("long").alias("ord"), F.format_string("b%05d", "ord").alias("block_id"), F.when(t.contains("|"), "table").otherwise("paragraph").alias("type"), "text",
        F.array(F.concat(F.lit("section "), F.expr("ord div 5").cast("string"))).alias("section_path"), (F.expr("ord div 10") + 1).alias("page"), (F.expr("ord div 10") + 1).alias("page_end"), (F.col("ord") % 9 == 8).alias("skip"),
    )
