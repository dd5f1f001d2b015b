"""What Python workers hold: of one operator only from task to task, and a portion of a batch at a time."""

import weakref

import numpy as np
import pyarrow as pa

from corvane.llm import common as C
from corvane.llm import jaccard, toxicity, viterbi


class Docs:
    """A table whose mapInArrow() gives the function itself."""

    columns = ["doc_id", "text"]
    schema = None

    def selectExpr(self, *columns):
        return self

    def toDF(self, *columns):
        return self if columns == ("c0", "c1") else self.run

    def mapInArrow(self, run, schema):
        self.run = run
        return self


class Taken(Docs):
    """One whose last step is mapInArrow()."""

    def mapInArrow(self, run, schema):
        return run


CHAIN = toxicity.Chain([toxicity.Linear({f: k for k, f in enumerate(toxicity.word_features("slur"))}, np.full(1, 9.0), np.zeros(j), -3.0) for j in range(3)])
TEXTS = ["word and word " * n for n in (0, 3, 40_000, 1, 100_000, 2, 30_000)] + [None, "a slur here", "the last one of them"]


def batch(*columns):
    return pa.RecordBatch.from_arrays(list(columns), [f"c{k}" for k in range(len(columns))])


def test_a_worker_keeps_the_memory_of_one_operator():
    rows = batch(pa.array([1, 2], pa.int64()), pa.array(["one text", None]))
    viterbi.encoder().encode("some words to remember")
    encoder = weakref.ref(viterbi.encoder())
    assert viterbi.encoder() is encoder()  # kept from task to task
    assert sum(b.num_rows for b in toxicity.keep(Docs(), CHAIN)(iter([rows]))) == 2
    assert encoder() is None
    features = weakref.ref(toxicity._features_of(CHAIN))
    assert toxicity._features_of(CHAIN) is features() and "one" in features().memo
    list(jaccard.marks(Taken())(iter([batch(rows.column(0), rows.column(0), rows.column(1))])))
    assert features() is None


def test_toxicity_and_shingles_work_on_a_bounded_portion_of_a_batch():
    ids, texts = pa.array(range(len(TEXTS)), pa.int64()), pa.array(TEXTS)
    sizes = [len((x or "").encode()) for x in TEXTS]
    small = lambda ks: len(ks) <= 1 or sum(sizes[k] for k in ks) <= C.PORTION_BYTES
    kept = [b.column(0).to_pylist() for b in toxicity.keep(Docs(), CHAIN)(iter([batch(ids, texts)]))]
    assert all(map(small, kept)) and sum(kept, []) == [k for k, x in enumerate(TEXTS) if x != "a slur here"]
    scored = [b.to_pydict() for b in toxicity.scores(Taken(), CHAIN)(iter([batch(ids, texts)]))]
    assert all(small(b["doc_id"]) for b in scored) and [k for b in scored for k, bad in zip(b["doc_id"], b["rejected"], strict=True) if bad] == [TEXTS.index("a slur here")]
    marked = [b.to_pydict() for b in jaccard.marks(Taken())(iter([batch(ids, ids, texts)]))]
    assert all(small(b["doc_id"]) for b in marked)
    assert [(k, n) for b in marked for k, n in zip(b["doc_id"], b["n_shingles"], strict=True)] == [(k, len(jaccard.shingles(x))) for k, x in enumerate(TEXTS)]
