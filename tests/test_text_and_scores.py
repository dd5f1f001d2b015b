import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import scoring


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [("C H A P T E R 1", "CHAPTER1"), ("C ontents", "Contents"), ("2 Fairness", "2 Fairness"), ("a b", "ab"), ("a b!", "a b!"), ("see a b c now", "see abc now"), ("", "")])
def test_unspace(spark, raw, want):
    assert one(spark, raw, X.unspace) == want


def test_number_signal_is_unicode_aware(spark):
    # ten letters and digits of other scripts do not break a number off
    assert one(spark, "p = 3 and 45% in 2021 [12] naïve 3.5 β < 2 é1 .", lambda c: scoring.signal_counts(c)["number"]) == 4


@pytest.mark.parametrize(("t", "n"), [("One fact. Another fact here.", 2), ("A single sentence with 2.5 percent growth.", 1), ("", 0), (None, None)])
def test_sentences(spark, t, n):
    assert one(spark, t, X.n_sentences) in (n, -1 if n is None else n)


def test_evidence_sentences(spark):
    assert one(spark, "First span. Second sentence. … Another span.", X.n_evidence_sentences) == 3
    assert one(spark, "One sentence.", X.n_evidence_sentences) == 1


@pytest.mark.parametrize("q", ["What does the evidence say?", "Why is it so according to the text?", "As noted, what holds?", "Which step is recommended for teachers?", "What does this chapter claim?"])
def test_banned(spark, q):
    assert one(spark, q, scoring.banned)


@pytest.mark.parametrize("q", ["What is bias in AI?", "Who wrote the report of the committee?", "Which step is recommended by UNESCO?"])
def test_not_banned(spark, q):
    assert one(spark, q, scoring.banned) is None


@pytest.mark.parametrize(("t", "hit"), [("See unit [u3] for it.", True), ("The knowledge units say so.", True), ("Unit 3 of the course covers AI ethics.", False)])
def test_meta_text(spark, t, hit):
    assert bool(one(spark, t, scoring.meta_text)) is hit


def test_citations(spark):
    df = spark.createDataFrame([("Book", [96, 95, 95]), ("Book", [12]), ("Book", [])], "t string, p array<int>")
    assert [r.c for r in df.select(X.citation("t", "p").alias("c")).collect()] == ["(Book, pp. 95-96)", "(Book, p. 12)", "(Book)"]


def test_table_share(spark):
    assert one(spark, "| a | b |\n|---|---|\nprose", X.table_char_share) == pytest.approx(5 / (5 + 9 + 5))
    assert one(spark, "", X.table_char_share) == 0


def test_lenient_json(spark):
    assert one(spark, 'Sure: {"k": 1} ok', X.lenient_json) == '{"k": 1}'
    assert one(spark, "no json", X.lenient_json) is None
    assert one(spark, '{"k": 2}', X.lenient_json) == '{"k": 2}'


def test_slug_and_numbering(spark):
    assert one(spark, "!!", X.slug) == "doc"
    assert one(spark, "a" * 30 + " " + "b" * 30, X.slug) == "a" * 30
    assert one(spark, "1.2.3 Title", X.numbering) == [1, 2, 3]
    assert one(spark, "Title", X.numbering) is None


def test_verdict_words(spark):
    assert [one(spark, w, X.verdict_of_text) for w in (" OK ", "drop", "hm", "  ", None)] == ["accept", "reject", "unknown", None, None]


def test_mining_cascade(spark):
    rows = [(True, True, 1, 0.0, 0.0), (False, True, 1, 0.0, 0.0), (False, False, 1, 0.0, 0.0), (False, False, 200, 0.1, 9.0), (False, False, 200, 0.9, 0.1), (False, False, 200, 0.9, 9.0)]
    df = spark.createDataFrame(rows, "e boolean, t boolean, n int, d double, s double")
    got = [r.m for r in df.select(scoring.mining_reason(F.col("e"), F.col("t"), "n", "d", "s").alias("m")).collect()]
    assert got == ["excluded_doc", "appendix_or_table", "too_short", "low_density", "off_topic", ""]


def test_factored_patterns_find_the_same():
    import re

    text = "We found evidence that models must be GDPR ready, i.e., policies should lead to results; 45% mean (p < .05) because it is essential to [see] frameworks."
    for rx, _, _ in scoring.SIGNALS.values():
        assert [m.span() for m in re.finditer(scoring.factored(rx), text)] == [m.span() for m in re.finditer(rx, text)]
    assert scoring.alternatives(r"a(b|c)|[|x]|\|d") == ["a(b|c)", "[|x]", r"\|d"]
