"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns with names the operators use inside."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import html, jaccard, maglev, mixing, neardup, quality, toxicity, viterbi, warc, wavelet

LONG = "lorem ipsum dolor sit amet " * 8000
DOCS = [
    (1, "a plain text of several words that repeats nothing at all here", "en", "s1", 10), (2, None, None, None, None), (3, "", "en", "s1", 0), (4, " \n\t ", "xx", "s2", 4),
    (5, LONG, "en", "s2", len(LONG)), (6, LONG, "en", "s3", len(LONG)), (7, "a plain text of several words that repeats nothing at all here", "de", "s1", 10),
    (7, "a plain text of several words that repeats nothing at all here", "de", "s1", 10), (None, "no id but a text of six words", "fr", "s1", 3), (None, None, None, None, None), (8, "ok", "en", None, 2), (9, "𝄞 ünï ▁ \x00 \x1c\x85 x", "es", "s1", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = {"size": 1, "h": "x", "held": 2, "target": 3, "kept": True, "id": 7, "key": "k", "start": 0, "copies": 9, "r_lang": "zz", "weird name.x": 1}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).withColumns({k: F.lit(v) for k, v in EXTRA.items()})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (5, None, 1), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def ids(df):
    return sorted((r[0] for r in df.select("doc_id").collect()), key=lambda x: (x is not None, x))


ALL = sorted((d[0] for d in DOCS), key=lambda x: (x is not None, x))


def test_wavelet(docs, spark):
    got = wavelet.stored(docs).orderBy("start").collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ALL
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (2, 3, 4))
    assert wavelet.stored(docs.limit(0)).collect() == []


def test_html(spark):
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (None, None, "<p>unclosed <b>bold"), (4, "u", "<article>x" + "<p>word " * 20000), (5, "u", "<script>never ends"), (6, "u", "text only < 3 & more"), (7, "u", "<!-- cut off")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = html.extracted(pages).collect()
    assert len(got) == len(rows) and all(r.text is not None and r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (1, 2, 5, 7)] == [""] * 5
    assert next(r for r in got if r.page_id == 4).text.count("\n") == 20000
    assert html.extracted(pages.limit(0)).collect() == []


def test_maglev(docs):
    got = maglev.place(docs, "doc_id").collect()
    assert ids(maglev.place(docs, "doc_id")) == ALL and len({r.shard for r in got if r.doc_id == 7}) == 1 and len({r.shard for r in got if r.doc_id is None}) == 1
    assert maglev.place(docs.limit(0), "doc_id").collect() == []


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (None, None, None), (2, "http://b/\r\nX: y", ""), (1, "http://a/", "<p>x</p>")], "page_id long, url string, html string").withColumn("path", F.lit("clash"))
    got = warc.derivatives(pages).collect()
    assert len(got) == 8 and all(r.refers_to.startswith("<urn:uuid:") for r in got) and {r.record_type for r in got} == {"metadata", "conversion"}
    assert len({r.record_id for r in got if r.page_id == 1}) == 2
    assert warc.derivatives(pages.limit(0)).collect() == []


def test_quality(docs):
    got = quality.verdicts(docs).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ALL
    assert all(r.base_failed and not r.kept and r.n_words == 0 for r in got if r.doc_id in (2, 3, 4))
    long_ = next(r for r in got if r.doc_id == 5)
    assert (long_.n_words, long_.n_repeat_words, long_.base_failed) == (40000, 40000, True)
    assert quality.verdicts(docs.limit(0)).collect() == [] and quality.keep(docs).columns == docs.columns


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ALL
    assert all(r.size == 0 and r.taken == 0 for r in got if r.doc_id in (2, 3, 4)) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert mixing.mix(docs.limit(0)).collect() == []
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r.n_copies for r in got)


def test_toxicity(docs, labels):
    chain = toxicity.train(docs, labels)
    got = toxicity.scores(docs, chain)
    assert ids(got) == ALL and all(0 <= r.p_toxic <= 1 for r in got.collect())
    none = toxicity.train(docs, labels.limit(0))
    assert all(r.p_toxic < 1e-6 and r.kept for r in toxicity.scores(docs, none).collect())
    assert toxicity.scores(docs.limit(0), chain).collect() == [] and toxicity.keep(docs, none).columns == docs.columns
    assert toxicity.keep(docs, none).count() == len(DOCS)
    assert toxicity.train(docs.limit(0), labels).choice == {}


def test_neardup(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (12, [1e-30, 0.0], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"id": F.lit(1), "dim": F.lit(9), "x": F.lit("y")})
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.duplicates(v).collect()}
    assert got == {(1, 3, 1, True), (2, 3, 1, False), (12, 3, 1, False), (None, 0, None, True), *[(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)]}
    assert neardup.duplicates(v.limit(0)).collect() == []


def test_jaccard(docs):
    got = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.classes(docs).collect()}
    assert {(1, 1, 2), (7, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 5, 1), (6, 5, 1), (8, 8, 0), (None, None, 0)} <= got
    assert jaccard.classes(docs).count() == len(DOCS) and jaccard.classes(docs.limit(0)).collect() == []
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns and ids(left) == [None, None, 1, 2, 3, 4, 5, 8, 9]


def test_viterbi(docs):
    got = viterbi.encoded(docs, with_ids=True)
    assert ids(got) == ALL and all(r.round_trip and len(r.ids) == r.n_ids for r in got.collect())
    assert all(r.n_ids == 0 for r in got.collect() if r.doc_id in (2, 3)) and viterbi.encoded(docs.limit(0)).collect() == []


def test_pipeline_stages_keep_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for empty in (False, True):
        at = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, at, str(tmp_path))
            assert out.columns == docs.columns, name
            path = str(tmp_path / f"{name}-{empty}")
            out.write.parquet(path)
            at = spark.read.schema(docs.schema).parquet(path)
        assert set(corpus_pipeline.STAGES[-1][1](spark, at, str(tmp_path)).columns) >= {"doc_id", "n_ids", "ids"}
