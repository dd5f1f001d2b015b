"""Toxicity by a classifier chain: one linear model per category, each fed the probabilities of the categories before it.

The chain is fitted on a bounded sample of labelled documents (SAMPLE, by the order of a hash of doc_id). While fitting, an
earlier category's probability for a row comes from models that have not seen the row (FOLDS folds by hash); for new documents
it comes from the model fitted on the whole sample. Features are the distinct words of the whole text, lower case without outer
punctuation, and the first letters of long ones, which words of one stem share; a model uses those whose document counts tell
the category's rows from the others (a bound on the root of the likelihood ratio), MAX_FEATURES at most.

Categories, in chain order, from `labels`: toxic; toxic_prose (toxic and of quality 1); toxic_spam (toxic and of quality 0). A
document is rejected when any category's probability is THRESHOLD or more.

Cases: null or empty text: no words, probabilities from the intercepts; null labels: the row teaches that category nothing;
several label rows of a doc_id: the greatest toxic, the least quality; several texts of one: the least teaches; no labelled rows, or none of a category: its
probability is the share of its rows (0 without any); rows without doc_id and repeated rows: scored one by one; empty table:
empty result; other columns are ignored by scores() and kept by keep().
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CATEGORIES = ("toxic", "toxic_prose", "toxic_spam")
SAMPLE = 8000
FOLDS = 5
MAX_FEATURES = 20_000
MIN_DOCS = 5
MIN_Z = 4.5
STEM = 5
THRESHOLD = 0.5
PENALTY = 2e-4
MEMO = 100_000
_OUTER = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"


# ---- features


def word_features(word: str) -> tuple[int, ...]:
    w = word.lower().strip(_OUTER)
    if not w:
        return ()
    own = zlib.crc32(w.encode())
    return (own, zlib.crc32(b"\0" + w[:STEM].encode())) if len(w) > STEM else (own,)


class Features:
    """Features of texts; with a choice, only the chosen ones, as their numbers."""

    def __init__(self, choice: dict[int, int] | None = None):
        self.choice, self.memo = choice, {}

    def _of_word(self, w: str) -> tuple[int, ...]:
        found = word_features(w)
        if self.choice is not None:
            found = tuple(self.choice[f] for f in found if f in self.choice)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        self.memo[w] = found
        return found

    def of(self, text: str | None) -> set[int]:
        get, out = self.memo.get, set()
        words = set((text or "").split())
        for w, found in zip(words, map(get, words), strict=True):
            if found is None:
                found = self._of_word(w)
            if found:
                out.update(found)
        return out


# ---- models


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Linear:
    """Logistic regression over chosen features and dense extra columns."""

    def __init__(self, choice: dict[int, int], weights: np.ndarray, extra: np.ndarray, bias: float):
        self.choice, self.weights, self.extra, self.bias = choice, weights, extra, bias

    def prob(self, rows: list[np.ndarray], extra: np.ndarray) -> np.ndarray:
        at, col = _flat([[self.choice[f] for f in r.tolist() if f in self.choice] for r in rows])
        return _sigmoid(np.bincount(at, self.weights[col], len(rows)) + extra @ self.extra + self.bias)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([f for r in rows for f in r], np.int64)


def fit(rows: list[np.ndarray], extra: np.ndarray, y: np.ndarray, steps: int = 300) -> Linear:
    n, pos = len(y), int(y.sum())
    if pos == 0 or pos == n:  # nothing to tell apart
        share = pos / n if n else 0.0
        return Linear({}, np.zeros(0), np.zeros(extra.shape[1]), float(np.log(share + 1e-13) - np.log(1 - share + 1e-13)))
    at, feats = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)])
    names, inverse = np.unique(feats, return_inverse=True)
    total, hits = np.bincount(inverse, minlength=len(names)), np.bincount(inverse, y[at], len(names))
    cells = [(hits, total * pos / n), (total - hits, total * (n - pos) / n), (pos - hits, (n - total) * pos / n), (n - pos - total + hits, (n - total) * (n - pos) / n)]
    z = np.sqrt(np.maximum(0, 2 * sum(o * np.log(np.where(o > 0, o, 1) / np.maximum(e, 1e-12)) for o, e in cells)))  # root of the likelihood ratio
    z[total < MIN_DOCS] = 0
    chosen = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    chosen = chosen[z[chosen] >= MIN_Z]
    number = np.full(len(names), -1)
    number[chosen] = np.arange(len(chosen))
    col = number[inverse]
    at, col = at[col >= 0], col[col >= 0]
    k = len(chosen)
    w = np.zeros(k + extra.shape[1] + 1)
    w[-1] = np.log(pos / (n - pos))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):  # Adam on the whole sample
        p = _sigmoid(np.bincount(at, w[:k][col], n) + extra @ w[k:-1] + w[-1])
        r = (p - y) / n
        g = np.concatenate([np.bincount(col, r[at], k), r @ extra, [r.sum()]]) + PENALTY * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Linear({int(f): i for i, f in enumerate(names[chosen])}, w[:k], w[k:-1], float(w[-1]))


def fit_chain(rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Linear]:
    """labels: a column per category, NaN where unknown; folds: each row's fold. One model per category."""
    extra, chain = np.zeros((len(rows), 0)), []
    for k in range(labels.shape[1]):
        y = labels[:, k]
        known = ~np.isnan(y)
        pick = lambda m: [rows[i] for i in np.flatnonzero(m)]  # noqa: E731, B023
        unseen = np.zeros(len(rows))
        if k + 1 < labels.shape[1]:
            for f in range(FOLDS):
                seen, held = known & (folds != f), folds == f
                if held.any():
                    unseen[held] = fit(pick(seen), extra[seen], y[seen]).prob(pick(held), extra[held])
        chain.append(fit(pick(known), extra[known], y[known]))
        extra = np.column_stack([extra, unseen])
    return chain


class Chain:
    """The fitted chain as one table of weights by feature."""

    def __init__(self, chain: list[Linear]):
        names = sorted({f for m in chain for f in m.choice})
        self.choice = {f: i for i, f in enumerate(names)}
        self.weights = np.zeros((len(names), len(chain)))
        for k, m in enumerate(chain):
            for f, i in m.choice.items():
                self.weights[self.choice[f], k] = m.weights[i]
        self.extra, self.bias = [m.extra for m in chain], [m.bias for m in chain]

    def probs(self, found: list[set[int]]) -> np.ndarray:
        """found: numbers of the chosen features of each text."""
        at, col = _flat([sorted(x) for x in found])
        out = np.zeros((len(found), len(self.bias)))
        for k, bias in enumerate(self.bias):
            out[:, k] = _sigmoid(np.bincount(at, self.weights[col, k], len(found)) + out[:, :k] @ self.extra[k] + bias)
        return out


# ---- tables


def sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """fold, toxic, quality, feats of at most `bound` labelled documents."""
    rows = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("l_toxic"), F.min("quality").alias("l_quality"))
    order = F.xxhash64("l_id", F.lit(11))
    rows = rows.withColumn("order", order).orderBy("order", "l_id").limit(bound)
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(rows), F.col("doc_id") == F.col("l_id"))  # at most `bound` rows
    # of rows that share a doc_id the least text speaks, so that at most `bound` rows go to the driver
    texts = texts.groupBy("doc_id", "l_id", "l_toxic", "l_quality").agg(F.min("text").alias("text"))

    def run(batches):
        feats = Features()
        for batch in batches:
            found = [np.array(sorted(feats.of(x.as_py())), np.uint32).tobytes() for x in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], ["doc_id", "fold", "toxic", "quality", "feats"])

    fold = F.pmod(F.xxhash64("l_id", F.lit(12)), F.lit(FOLDS)).cast("long")
    picked = texts.select("doc_id", fold.alias("fold"), F.col("l_toxic").cast("double").alias("toxic"), F.col("l_quality").cast("double").alias("quality"), "text")
    return picked.mapInArrow(run, "doc_id long, fold long, toxic double, quality double, feats binary")


def categories(toxic: np.ndarray, quality: np.ndarray) -> np.ndarray:
    prose = np.where(toxic == 0, 0.0, np.where(np.isnan(toxic) | np.isnan(quality), np.nan, toxic * (quality == 1)))
    spam = np.where(toxic == 0, 0.0, np.where(np.isnan(toxic) | np.isnan(quality), np.nan, toxic * (quality == 0)))
    return np.column_stack([toxic, prose, spam])


def train(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Chain:
    got = sorted(tuple(r) for r in sample(docs, labels, bound).collect())  # at most `bound` rows
    rows = [np.frombuffer(r[4], np.uint32).astype(np.int64) for r in got]
    column = lambda k: np.array([np.nan if r[k] is None else r[k] for r in got], float)
    return Chain(fit_chain(rows, categories(column(2), column(3)), np.array([r[1] for r in got], int)))


def _features_of(chain: Chain) -> Features:
    """Words met by one task help the next one in the same worker."""
    return C.kept(("toxicity", hash((chain.weights.tobytes(), tuple(chain.choice)))), lambda: Features(chain.choice))


def _scored(chain: Chain, feats: Features, texts: pa.Array) -> np.ndarray:
    return chain.probs([feats.of(x.as_py()) for x in texts])


def scores(docs: DataFrame, chain: Chain) -> DataFrame:
    """doc_id, p_<category>, rejected, kept."""

    def run(batches):
        feats = _features_of(chain)
        for batch in C.portions(batches, 1):
            p = _scored(chain, feats, batch.column(1))
            bad = p.max(axis=1) >= THRESHOLD if len(p) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p[:, k]) for k in range(p.shape[1])], pa.array(bad), pa.array(~bad)], ["doc_id", *[f"p_{c}" for c in CATEGORIES], "rejected", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, " + "".join(f"p_{c} double, " for c in CATEGORIES) + "rejected boolean, kept boolean")


def keep(docs: DataFrame, chain: Chain) -> DataFrame:
    """The documents that the chain does not reject, with the columns they came with."""
    at = docs.columns.index("text")

    def run(batches):
        feats = _features_of(chain)
        for batch in C.portions(batches, at):
            yield batch.filter(pa.array(_scored(chain, feats, batch.column(at)).max(axis=1) < THRESHOLD))

    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # any names pass, dots too
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
