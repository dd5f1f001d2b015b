"""What surrounds the operators: configuration, stages with markers, answers that must fit a schema, chat examples with masks."""

from __future__ import annotations

import json
import time
import tomllib
from collections.abc import Callable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import grading as G
from . import models as M


def load_config(spark: SparkSession, path: str) -> dict:
    """A TOML or JSON file, wherever Spark can read it; its key `root` is the folder of the file unless it says otherwise."""
    text = spark.read.text(path, wholetext=True).first()[0]
    found = json.loads(text) if path.endswith(".json") else tomllib.loads(text)
    return {"root": path.rpartition("/")[0], **found}


def resolve(config: dict, path: str) -> str:
    """A path of a configuration: absolute ones and URIs as they are, others below its root."""
    if "://" in path or path.startswith("/"):
        return path
    return f"{config['root'].rstrip('/')}/{PurePosixPath(path)}"


def run_stages(spark: SparkSession, stages: list[tuple[str, Callable[[], None]]], markers: str, seconds: float | None = None) -> list[tuple[str, str]]:
    """name and outcome (ran, skipped, failed, not reached) of each stage. A stage that has run leaves a marker and is skipped next time; a failure or the end of the time box stops the rest."""
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out: list[tuple[str, str]] = []
    start, stopped = time.monotonic(), False
    for name, work in stages:
        at = jvm.org.apache.hadoop.fs.Path(f"{markers}/{name}.done")
        fs = at.getFileSystem(conf)
        if fs.exists(at):
            out.append((name, "skipped"))
        elif stopped or (seconds is not None and time.monotonic() - start >= seconds):
            out.append((name, "not reached"))
        else:
            try:
                work()
            except Exception:  # noqa: BLE001  the outcome says so
                out.append((name, "failed"))
                stopped = True
            else:
                fs.create(at, True).close()
                out.append((name, "ran"))
    return out


def asked_until_valid(df: DataFrame, prompt: Column, schema: str, needed: list[str], client: M.Client = G.digests, rounds: int = 2) -> DataFrame:
    """df with parsed (a struct of the schema, null if no answer has all needed fields) and asked (rounds it took): what does not fit is asked again with a note of what is missing."""
    rows = df.withColumns({"parsed": F.lit(None).cast(f"struct<{schema}>"), "asked": F.lit(0)}).withColumn("_p", prompt)
    for k in range(1, rounds + 1):
        again = F.when(F.col("parsed").isNull(), F.col("_p") if k == 1 else F.concat("_p", F.lit(f"\nAnswer {k}: JSON with {', '.join(needed)}.")))
        got = G.asked(rows, again, client)
        found = F.from_json(X.lenient_json("answer"), f"struct<{schema}>")
        whole = found.isNotNull()
        for c in needed:
            whole &= found[c].isNotNull()
        rows = got.withColumn("asked", F.when(F.col("parsed").isNull(), F.lit(k)).otherwise(F.col("asked"))).withColumn("parsed", F.coalesce("parsed", F.when(whole, found))).drop("answer", "error")
    return rows.drop("_p")


def masked_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant", most: int | None = None) -> DataFrame:
    """conv, tokens, labels (the tokens that are learned, null elsewhere), n_learned. A turn is its role's mark, its words and an end mark; only words and end mark of `learned` count. most: conversations are cut to so many tokens."""
    words = F.concat(F.array(F.concat(F.lit("<|"), F.col(role), F.lit("|>"))), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0)), F.array(F.lit("<|end|>")))
    mask = F.transform("w", lambda x, i: F.when((F.col(role) == learned) & (i > 0), x))
    rows = turns.withColumn("w", words).select(conv, turn, "w", mask.alias("m"))
    whole = rows.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(turn, "w", "m"))).alias("u"))
    flat = lambda c: F.flatten(F.transform("u", lambda x: x[c]))
    cut = (lambda c: F.slice(c, 1, most)) if most else (lambda c: c)
    out = whole.select(conv, cut(flat("w")).alias("tokens"), cut(flat("m")).alias("labels"))
    return out.withColumn("n_learned", F.size(F.array_compact("labels")))
