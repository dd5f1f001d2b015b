"""Adapters for language models and parsers: requests and answers are tables, a client is a function, and the stubs here answer offline.

Every call is keyed by a hash of its canonical request. What a cache holds is not asked again; what fails is a row with an error, and is
asked again in the next round. A client gets a batch of prompts and returns as many answers, None where it failed.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import scoring

Client = Callable[[list[str]], list[str | None]]
DIM = 64


# ---- requests and answers


def request_key(prompt, model: str = "stub", role: str = "generator") -> Column:
    return X.content_key(F.lit(model).alias("model"), X.col(prompt).alias("prompt"), F.lit(role).alias("role"))


def requests(df: DataFrame, prompt: str, model: str = "stub", role: str = "generator") -> DataFrame:
    """key, prompt: each request once."""
    return df.select(request_key(prompt, model, role).alias("key"), F.col(prompt).alias("prompt")).dropDuplicates(["key"])


def echo(prompts: list[str]) -> list[str | None]:
    """The offline client: a digest of the prompt stands for the model's words."""
    return [f"answer {hashlib.sha1(p.encode()).hexdigest()[:8]}" for p in prompts]


def call(todo: DataFrame, client: Client = echo) -> DataFrame:
    """key, answer, error for every request: a batch of prompts a call, an exception is the batch's error."""

    def run(batches):
        for pdf in batches:
            try:
                answers, error = client(pdf["prompt"].tolist()), None
            except Exception as e:  # noqa: BLE001  a failed batch is data, to be asked again
                answers, error = [None] * len(pdf), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"key": pdf["key"], "answer": answers, "error": [error if a is None else None for a in answers]})

    return todo.select("key", "prompt").mapInPandas(run, "key string, answer string, error string")


def resolve(todo: DataFrame, client: Client = echo, rounds: int = 8) -> DataFrame:
    """Answers of all requests, asking what failed again for some rounds at most."""
    done = None
    for _ in range(rounds):
        left = todo if done is None else todo.join(done, "key", "left_anti")
        got = call(left, client).where("answer is not null").select("key", "answer")
        done = got if done is None else done.unionByName(got)
        if client is echo or left.join(done, "key", "left_anti").isEmpty():
            break
    return done


def complete(todo: DataFrame, cache: DataFrame, client: Client = echo) -> DataFrame:
    """key, answer, cached, error: from the cache where it has the key, else from the client."""
    hit = todo.join(cache.select("key", "answer"), "key").select("key", "answer", F.lit(True).alias("cached"), F.lit(None).cast("string").alias("error"))
    miss = call(todo.join(cache, "key", "left_anti"), client).select("key", "answer", F.lit(False).alias("cached"), "error")
    return hit.unionByName(miss)


# ---- embeddings and reranking


def _hashed(text: str) -> np.ndarray:
    v = np.zeros(DIM, np.float32)
    for w in re.findall(r"[a-z0-9]+", text.lower()):
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little")
        v[h % DIM] += 1 if h >> 16 & 1 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


def embed(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray] | None = None, prefix: str = "") -> DataFrame:
    """key, vec (unit length). encode gets a batch of texts; the default hashes words to signed coordinates."""
    encode = encode or (lambda ts: np.stack([_hashed(t) for t in ts]) if ts else np.zeros((0, DIM), np.float32))

    def run(batches):
        for pdf in batches:
            order = pdf[text].str.len().sort_values(ascending=False, kind="stable").index  # texts of like length together: least padding
            vecs = encode([prefix + t for t in pdf.loc[order, text]])
            yield pd.DataFrame({key: pdf.loc[order, key], "vec": list(vecs)})

    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, vec array<float>")


def rerank(rows: DataFrame, query: str, item: str, q_text: str, text: str, score: Callable[[str, str], float] | None = None) -> DataFrame:
    """query, item, score of pairs by a model; the default is the share of the query's words that the text holds."""

    def words(t: str) -> set[str]:
        return set(re.findall(r"[a-z0-9]+", t.lower()))

    score = score or (lambda q, t: len(words(q) & words(t)) / max(len(words(q)), 1))
    kinds = dict(rows.dtypes)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({query: pdf[query], item: pdf[item], "score": [float(score(q, t)) for q, t in zip(pdf[q_text], pdf[text], strict=True)]})

    return rows.select(query, item, q_text, text).mapInPandas(run, f"{query} {kinds[query]}, {item} {kinds[item]}, score double")


# ---- several rows per text


def html_items(pages: DataFrame) -> DataFrame:
    """page_id, ord, label, text, n_p (paragraph tags of the page): headings and paragraphs of raw pages, for the layout cleaner."""
    parts = F.regexp_extract_all("html", F.lit(r"(?s)<(?:p|h[1-6]|li)>(?:(?!</?(?:p|h[1-6]|li)>).)*"), F.lit(0))
    n_p = F.regexp_count("html", F.lit("<p>"))
    rows = pages.select("page_id", n_p.alias("n_p"), F.posexplode_outer(parts).alias("ord", "raw"))
    label = F.when(F.col("raw").startswith("<h"), "section_header").when(F.col("raw").startswith("<li"), "list_item").otherwise("text")
    return rows.select("page_id", "ord", label.alias("label"), X.ws(F.regexp_replace("raw", "<[^>]*>", " ")).alias("text"), "n_p")


def knowledge_units(df: DataFrame, key: str, text: str, most: int = 8) -> DataFrame:
    """key, unit_id, unit, type, evidence_valid: up to `most` units of a text (the stub takes its complete sentences)."""
    units = F.slice(F.filter(X.sentences(text), lambda s: (F.length(s) >= 20) & X.is_complete_sentence(s)), 1, most)
    rows = df.select(key, text, F.posexplode(units).alias("n", "unit"))
    kind = F.when(F.col("unit").rlike(r"\d"), "statistic").otherwise("claim")
    return rows.select(key, F.format_string("%s:u%02d", F.col(key).cast("string"), F.col("n") + 1).alias("unit_id"), "unit", kind.alias("type"), X.ws(text).contains(X.ws("unit")).alias("evidence_valid"))


def question_pairs(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """key, qa_id, question, answer: up to k pairs of a text, from its units."""
    u = knowledge_units(df, key, text, k)
    n = F.substring_index("unit_id", ":u", -1).cast("int")
    return u.select(key, F.format_string("%s:q%d", F.col(key).cast("string"), n).alias("qa_id"), F.concat(F.lit("What holds about "), X.short("unit", 6), F.lit("?")).alias("question"), F.col("unit").alias("answer"))


# ---- filtering with one repair


def judged(p: DataFrame) -> DataFrame:
    """The stub judge: scores from lengths."""
    q, a = F.length("question"), F.length("answer")
    return p.withColumns({"grounding": q % 5 + 1, "standalone": a % 3 > 0, "value": a % 5 + 1, "well_formed": q % 11 > 0})


def fails() -> Column:
    return scoring.fail_reasons(not_standalone_prefilter=scoring.banned("question").isNotNull(), grounding=F.col("grounding") < 4, not_standalone=~F.col("standalone"), low_value=F.col("value") < 3, garbled_question=~F.col("well_formed"))


def judge_and_repair(p: DataFrame) -> DataFrame:
    """p with status (passed, repaired, rejected) and reject_reason.

    The cheap pattern check comes first: only what passes it is sent to the judge. What may be repaired is repaired and judged once more.
    """
    first = judged(p.where(scoring.banned("question").isNull())).withColumn("fails", fails())
    blocked = p.where(scoring.banned("question").isNotNull()).withColumn("fails", F.array(F.lit("not_standalone_prefilter")))
    done = first.where(F.size("fails") == 0)
    again = first.where(scoring.repairable(F.col("fails"))).select(*p.columns).withColumn("question", F.concat(F.lit("Repaired: "), "question"))
    second = judged(again).withColumn("fails", fails())
    rejected = first.where((F.size("fails") > 0) & ~scoring.repairable(F.col("fails")))
    out = lambda df, status: df.select(*p.columns, status.alias("status"), F.array_join("fails", ";").alias("reject_reason"))
    return (
        out(done, F.lit("passed")).unionByName(out(second, F.when(F.size("fails") == 0, "repaired").otherwise("rejected")))
        .unionByName(out(rejected, F.lit("rejected"))).unionByName(out(blocked, F.lit("rejected")))
    )


def fix_paraphrases(p: DataFrame) -> DataFrame:
    """p with paraphrases that are equivalent and not banned: bad ones are asked for once more, and dropped if still bad."""
    made = F.array(F.concat(F.lit("In short: "), "question"), F.concat(F.lit("As noted in the text, "), "question"), F.concat(F.lit("Say "), "answer"))
    ok = lambda x: scoring.banned(x).isNull() & x.contains(F.substring("question", 1, 10))
    bad = F.filter(made, lambda x: ~ok(x))
    renewed = F.filter(F.transform(bad, lambda x: F.concat(F.lit("Please tell: "), x)), ok)
    return p.withColumns({"paraphrases": F.concat(F.filter(made, ok), renewed), "n_bad": F.size(bad), "n_dropped": F.size(bad) - F.size(renewed)})


def entailment(p_entail: Column, p_contra: Column, threshold: float = 0.5) -> list[Column]:
    """contradicted and supported: the probability reaches the threshold and the other one does not win (a tie supports)."""
    return [((p_contra >= threshold) & (p_contra > p_entail)).alias("contradicted"), ((p_entail >= threshold) & (p_entail >= p_contra)).alias("supported")]


# ---- files and remote work


def content_scan(files: DataFrame, key: str) -> DataFrame:
    """key, status (ok, corrupt), n_chars, hash of each file's content (text): never fails on one; null or empty content is corrupt."""
    n = F.length(F.coalesce("content", F.lit("")))
    return files.select(key, F.when(n > 0, "ok").otherwise("corrupt").alias("status"), n.alias("n_chars"), F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("hash"))


def parsed(files: DataFrame, cache: DataFrame | None, parsers: dict[str, Callable[[str], str]] | None = None) -> DataFrame:
    """files with hash, parser, text, cached. Files without a text layer go to `ocr`, others to `layout`; what the cache (hash, parser, text) holds is not parsed."""
    parsers = parsers or {"ocr": str.upper, "layout": str.lower}  # stubs
    rows = files.withColumn("parser", F.when(F.col("text_layer") == "no", "ocr").otherwise("layout")).withColumn("hash", F.sha2(F.col("content").cast("binary"), 256))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    hit = rows.limit(0).withColumns({"text": F.lit(""), "cached": F.lit(True)}) if cache is None else rows.join(cache.dropDuplicates(["hash", "parser"]), ["hash", "parser"]).withColumn("cached", F.lit(True))
    miss = rows if cache is None else rows.join(cache, ["hash", "parser"], "left_anti")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[parsers[p](c) for p, c in zip(pdf["parser"], pdf["content"].fillna(""), strict=True)])

    fresh = miss.select(*rows.columns).mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", text string").withColumn("cached", F.lit(False))
    return hit.select(*rows.columns, "text", "cached").unionByName(fresh)


def poll(status: Callable[[], str], most: int, errors: int = 10, wait: Callable[[], None] = lambda: None) -> dict:
    """outcome (done, failed, cancelled) and polls of a remote job: asked until it ends, `most` times, or more than `errors` calls in all fail."""
    failed = 0
    for n in range(1, most + 1):
        try:
            now = status()
        except Exception:  # noqa: BLE001  counted
            failed += 1
            if failed > errors:
                return {"outcome": "failed", "polls": n}
        else:
            if now in ("done", "failed"):
                return {"outcome": now, "polls": n}
        wait()
    return {"outcome": "cancelled", "polls": most}
