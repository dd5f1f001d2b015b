"""Grading by models: a prompt per row goes out, an answer comes back to its row, and rules make verdicts of answers.

A client is a function from prompts to answers (models.Client); the one used here offline answers with the md5 of the prompt, so that
its answers are known without it. What differs between tasks is the prompt and the rule.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats as S
from ..functions import text as X
from . import models as M

#: Verdicts in rank order (fixed values).
VERDICTS = ["incorrect", "partly_correct", "correct"]


def digests(prompts: list[str]) -> list[str | None]:
    """The offline client: the md5 of each prompt."""
    return [hashlib.md5(p.encode()).hexdigest() for p in prompts]


def digit(answer, n: int) -> Column:
    """The first eight hex digits of an answer modulo n."""
    return (F.conv(F.substring(answer, 1, 8), 16, 10).cast("long") % n).cast("int")


def asked(df: DataFrame, prompt: Column, client: M.Client = digests, role: str = "judge") -> DataFrame:
    """df with answer and error. Equal prompts are asked once; a prompt may be made of the answer to an earlier one."""
    rows = df.withColumn("_prompt", prompt)
    rows = rows.withColumn("_key", M.request_key(F.col("_prompt"), role=role))
    todo = rows.where("_prompt is not null").select(F.col("_key").alias("key"), F.col("_prompt").alias("prompt")).dropDuplicates(["key"])
    got = M.call(todo, client).select(F.col("key").alias("_key"), "answer", "error")
    return rows.join(got, "_key", "left").drop("_key", "_prompt")


def asked_in_turn(df: DataFrame, first: Column, then, client: M.Client = digests) -> DataFrame:
    """df with answer to then(answer to first): two rounds over all rows, not one round trip per row."""
    one = asked(df, first, client).withColumnRenamed("answer", "_first").drop("error")
    return asked(one, then(F.col("_first")), client).drop("_first")


def each(df: DataFrame, key: str, item: str, work) -> DataFrame:
    """key, result, error: work(item) of every row; an exception is that row's error and stops no other."""

    def one(x):
        try:
            return work(x), None
        except Exception as e:  # noqa: BLE001  an item's failure is data
            return None, f"{type(e).__name__}: {e}"

    def run(batches):
        for pdf in batches:
            got = [one(x) for x in pdf[item]]
            yield pd.DataFrame({key: pdf[key], "result": [g[0] for g in got], "error": [g[1] for g in got]})

    return df.select(key, item).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, result string, error string")


def rescored(df: DataFrame, score: str, prompt: Column, value, low: float, high: float, client: M.Client = digests) -> DataFrame:
    """df with the score of rows between low and high replaced by value(answer); where there is no answer it stays. Others are not asked."""
    near = F.col(score).between(low, high)
    got = asked(df, F.when(near, prompt), client)
    return got.withColumn(score, F.coalesce(value(F.col("answer")), F.col(score))).withColumn("rescored", F.col("answer").isNotNull()).drop("answer", "error")


def graded(df: DataFrame, question: str, reference: str, answer: str, prompt_head: str = "grade", client: M.Client = digests) -> DataFrame:
    """df with verdict (of the judge's answer) and n_unsupported (claims that the judge finds no ground for)."""
    prompt = F.concat_ws("\n", F.lit(prompt_head), question, reference, answer)
    got = asked(df, prompt, client).withColumnRenamed("answer", "_verdict")
    out = got.withColumn("verdict", F.get(F.array(*[F.lit(v) for v in VERDICTS]), digit("_verdict", len(VERDICTS))))
    return out.withColumn("n_unsupported", digit(F.substring("_verdict", 9, 8), 4)).drop("_verdict", "error")


def closed_book(df: DataFrame, question: str, reference: str, by: list[str], client: M.Client = digests) -> DataFrame:
    """by, n, token_f1, lenient: a model answers without the text; its answers are held against the reference and graded."""
    answered = asked(df, F.concat(F.lit("closed book\n"), question), client, role="answerer").withColumnRenamed("answer", "own").drop("error")
    rows = graded(answered, question, reference, "own", client=client).withColumn("_f1", S.token_f1("own", reference))
    points = F.when(F.col("verdict") == "correct", 1.0).when(F.col("verdict") == "partly_correct", 0.5).otherwise(0.0)
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("_f1").alias("token_f1"), F.avg(points).alias("lenient"))


def judged_by_prompts(df: DataFrame, prompts: dict[str, Column], client: M.Client = digests) -> DataFrame:
    """A row per row of df and prompt version: version, passed (null where the answer is no JSON with a truth value in `pass`)."""
    parts = None
    for name, prompt in prompts.items():
        got = asked(df, prompt, client)
        found = F.get_json_object(X.lenient_json("answer"), "$.pass")
        part = got.withColumn("version", F.lit(name)).withColumn("passed", F.when(found.isin("true", "false"), found == "true")).drop("answer", "error")
        parts = part if parts is None else parts.unionByName(part)
    return parts


def json_judge(prompts: list[str]) -> list[str | None]:
    """The offline judge: words around a JSON object whose truth value is the parity of the prompt's md5; some answers are no JSON."""
    out = []
    for p in prompts:
        n = int(hashlib.md5(p.encode()).hexdigest()[:8], 16)
        out.append("no idea" if n % 10 == 9 else f'Sure: {{"pass": {"true" if n % 2 else "false"}}} .')
    return out


def calibrated(judged: DataFrame, human: str, dev: str) -> DataFrame:
    """version, kappa_dev, kappa_test, n_test of the prompt version that agrees best with people on the rows where dev is true; equal ones in order of name."""
    known = judged.where(F.col("passed").isNotNull() & F.col(human).isNotNull())
    side = lambda c: [F.count_if(c & F.col("passed") & F.col(human)), F.count_if(c & F.col("passed") & ~F.col(human)), F.count_if(c & ~F.col("passed") & F.col(human)), F.count_if(c & ~F.col("passed") & ~F.col(human))]
    on_dev, on_test = side(F.col(dev)), side(~F.col(dev))
    cells = known.groupBy("version").agg(*[c.alias(f"d{i}") for i, c in enumerate(on_dev)], *[c.alias(f"t{i}") for i, c in enumerate(on_test)])
    rows = cells.select("version", S.kappa_2x2(*[F.col(f"d{i}") for i in range(4)]).alias("kappa_dev"), S.kappa_2x2(*[F.col(f"t{i}") for i in range(4)]).alias("kappa_test"), (F.col("t0") + F.col("t1") + F.col("t2") + F.col("t3")).alias("n_test"))
    return rows.orderBy(F.round("kappa_dev", 9).desc_nulls_last(), "version").limit(1)


def supported(claims: DataFrame, key: list[str], claim: str, window: str, yes_no, client: M.Client = digests) -> DataFrame:
    """key, p_support: of a claim's windows the greatest share of yes in the model's yes and no (yes_no: answer -> two log-probabilities)."""
    got = asked(claims, F.concat_ws("\n", F.lit("Does the text support the claim?"), claim, window), client)
    yes, no = yes_no(F.col("answer"))
    return got.withColumn("_p", F.exp(yes) / (F.exp(yes) + F.exp(no))).groupBy(*key).agg(F.max("_p").alias("p_support"))


def summary(scores: DataFrame, system: str, base: str, metric: str, by: list[str]) -> DataFrame:
    """system, by, n, mean, delta: means per system and cell, and their difference from the base system's in the same cell (null without one)."""
    cells = scores.groupBy(system, *by).agg(F.count(F.lit(1)).alias("n"), F.avg(metric).alias("mean"))
    own = cells.where(F.col(system) == base).select(*by, F.col("mean").alias("_base"))
    return cells.join(own, by, "left").withColumn("delta", F.col("mean") - F.col("_base")).drop("_base")


def environment(spark) -> dict[str, str]:
    """Versions that a report states."""
    import platform

    return {"spark": spark.version, "python": platform.python_version(), "pandas": pd.__version__}
