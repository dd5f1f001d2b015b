"""Statistics as expressions over grouped counts, windows, and grouped-map resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .text import let, tokens

N_BOOT = 2000


# ---- overlap of texts


def common_tokens(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda arr, t: F.size(F.filter(arr, lambda x: x == t))
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda s: F.aggregate(F.array_distinct(F.array_intersect(s["a"], s["b"])), F.lit(0), lambda n, t: n + F.least(count(s["a"], t), count(s["b"], t))))


def f1(common: Column, n_a: Column, n_b: Column) -> Column:
    """Harmonic mean of common / n_a and common / n_b; 0 without anything in common."""
    p, r = common / n_a, common / n_b
    return F.when(common > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def token_f1(pred, ref) -> Column:
    a, b = tokens(pred), tokens(ref)
    return f1(common_tokens(a, b), F.size(a), F.size(b))


def lcs_length(a: list, b: list) -> int:
    """Longest common subsequence with bit-parallel rows: one big integer holds a whole row of the table."""
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = 0
    for y in b:
        hit = row | where.get(y, 0)
        row = hit & ~(hit - (row << 1 | 1))
    return row.bit_count()


@F.pandas_udf(IntegerType())
def lcs_tokens(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([lcs_length(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype="int32")


def rouge_l(pred, ref) -> Column:
    a, b = tokens(pred), tokens(ref)
    return f1(lcs_tokens(a, b), F.size(a), F.size(b))


# ---- agreement


def kappa_2x2(both: Column, first: Column, second: Column, neither: Column) -> Column:
    """Cohen's kappa of counts (yes-yes, yes-no, no-yes, no-no): 1 if chance agreement is certain, null without items."""
    n = (both + first + second + neither).cast("double")
    po = (both + neither) / n
    pe = ((both + first) * (both + second) + (second + neither) * (first + neither)) / (n * n)
    return F.when(n > 0, F.when(pe == 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe)))


def kappas(df: DataFrame, a: str, b: str, classes: list[str], by: list[str] | None = None) -> DataFrame:
    """n, agreement, kappa, kappa_quadratic and kappa_<class> (one against the rest) of two columns of classes in rank order."""
    by, k = by or [], len(classes)
    rank = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])
    rows = df.where(F.col(a).isin(classes) & F.col(b).isin(classes)).select(*by, rank[F.col(a)].alias("x"), rank[F.col(b)].alias("y"))
    cells = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.count_if((F.col("x") == i) & (F.col("y") == j)).alias(f"c_{i}_{j}") for i in range(k) for j in range(k)])
    c = lambda i, j: F.col(f"c_{i}_{j}").cast("double")
    n = F.col("n").cast("double")
    total = lambda xs: sum(xs[1:], xs[0])
    row = [total([c(i, j) for j in range(k)]) for i in range(k)]
    column = [total([c(i, j) for i in range(k)]) for j in range(k)]

    def weighted(weight) -> Column:
        seen = total([F.lit(float(weight(i, j))) * c(i, j) for i in range(k) for j in range(k)])
        chance = total([F.lit(float(weight(i, j))) * row[i] * column[j] for i in range(k) for j in range(k)]) / n
        return F.when(chance > 0, 1 - seen / chance)

    def one(i: int) -> Column:
        both = c(i, i)
        return kappa_2x2(both, row[i] - both, column[i] - both, n - row[i] - column[i] + both)

    out = [(total([c(i, i) for i in range(k)]) / n).alias("agreement"), weighted(lambda i, j: i != j).alias("kappa"), weighted(lambda i, j: (i - j) ** 2).alias("kappa_quadratic")]
    return cells.select(*by, "n", *out, *[one(i).alias(f"kappa_{name}") for i, name in enumerate(classes)])


# ---- tests


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided McNemar p: twice the binomial tail up to the smaller of two discordant counts, by log factorials."""
    n, k = b + c, F.least(b, c)
    # the terms grow from one to the next by (n - i) / (i + 1): summed in logs relative to the last
    terms = F.aggregate(
        F.sequence(F.lit(0).cast("long"), k),
        F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct(
            F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(s["log"] + F.log((n - i + 1) / i.cast("double"))).alias("log"),
            (s["sum"] + F.exp(F.when(i == 0, -n * F.log(F.lit(2.0))).otherwise(s["log"] + F.log((n - i + 1) / i.cast("double"))))).alias("sum"),
        ),
        lambda s: s["sum"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * terms))


def holm(df: DataFrame, p: str, by: list[str], order: list[str]) -> DataFrame:
    """df with p_holm: step-down adjusted p within groups; null p stays null and does not count."""
    known = F.col(p).isNotNull()
    w = Window.partitionBy(*by, known)
    ranked = df.withColumn("_m", F.count(F.lit(1)).over(w)).withColumn("_rank", F.row_number().over(w.orderBy(p, *order)))
    step = F.least(F.lit(1.0), (F.col("_m") - F.col("_rank") + 1) * F.col(p))
    run = w.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("p_holm", F.when(known, F.max(step).over(run))).drop("_m", "_rank")


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank from 1 with ties sharing their mean."""
    w = Window.partitionBy(*(by or []))
    return F.rank().over(w.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*(by or []), x)) - 1) / 2


def auc(df: DataFrame, y: str, x: str, by: list[str]) -> DataFrame:
    """by, n, auc: chance that a positive row has the larger x (Mann-Whitney); null under 10 rows or with one class."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_r", average_rank(x, by))
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("_p"), F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("_s"))
    neg = F.col("n") - F.col("_p")
    value = (F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2) / (F.col("_p") * neg)
    return sums.select(*by, "n", F.when((F.col("n") >= 10) & (F.col("_p") > 0) & (neg > 0), value).alias("auc"))


# ---- resampling


def _means(x: np.ndarray, seed: int, n_boot: int) -> np.ndarray:
    """Means of n_boot resamples; drawn in portions so that memory stays bounded."""
    rng, out, step = np.random.default_rng(seed), [], max(1, 4_000_000 // max(len(x), 1))
    for k in range(0, n_boot, step):
        out.append(x[rng.integers(0, len(x), (min(step, n_boot - k), len(x)))].mean(axis=1))
    return np.concatenate(out)


#: Values that one task resamples.
BLOCK = 1 << 16


def _resampled(values: DataFrame, by: list[str], seed: int, n_boot: int) -> DataFrame:
    """by, mean: n_boot rows for each group, the means of resamples as large as the group. values: by, _v (not null).

    A group's values in order are dealt into blocks of BLOCK. How many of a resample's draws fall into each block is drawn first, alike in
    every task; each block then draws its share of its own values. So a group of any size is resampled exactly, one block a task.
    """
    kinds, whole = dict(values.dtypes), Window.partitionBy(*by)
    rows = values.withColumn("_b", F.floor((F.row_number().over(whole.orderBy("_v")) - 1) / BLOCK)).withColumn("_n", F.count(F.lit(1)).over(whole))

    def run(key, pdf):
        x, n, b = np.sort(pdf["_v"].to_numpy(float)), int(pdf["_n"].iloc[0]), int(key[-1])
        if n <= BLOCK:
            sums = _means(x, seed, n_boot) * n
        else:
            sizes = np.diff(np.minimum(np.arange(0, n + BLOCK, BLOCK), n))
            shares, own = np.random.default_rng(seed).multinomial(n, sizes / n, n_boot)[:, b], np.random.default_rng([seed, b])
            sums = np.array([x[own.integers(0, len(x), c)].sum() for c in shares])
        return pd.DataFrame([[*key[:-1], n, list(sums)]], columns=[*by, "_n", "_sums"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", _n long, _sums array<double>"
    sums = rows.groupBy(*by, "_b").applyInPandas(run, schema)
    return sums.select(*by, "_n", F.posexplode("_sums").alias("_r", "_s")).groupBy(*by, "_r").agg((F.sum("_s") / F.first("_n")).alias("mean"))


def boot_ci(df: DataFrame, value: str, by: list[str], seed: int = 0, n_boot: int = N_BOOT) -> DataFrame:
    """by, mean, lo, hi, n: mean with its percentile bootstrap interval; nulls are no values."""
    rows = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("_v"))
    cells = rows.groupBy(*by).agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    means = _resampled(rows.where("_v is not null"), by, seed, n_boot)
    ends = means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))
    return cells.join(ends, by, "left").select(*by, "mean", "lo", "hi", "n")


def paired_boot(df: DataFrame, base: str, system: str, by: list[str], seed: int = 0, n_boot: int = N_BOOT) -> DataFrame:
    """by, diff, lo, hi, p, dz, n of paired values: p counts resampled means as far from the mean as the mean is from 0. Only n for fewer than two pairs."""
    rows = df.select(*by, F.nanvl((F.col(system) - F.col(base)).cast("double"), F.lit(None).cast("double")).alias("_v"))
    cells = rows.groupBy(*by).agg(F.avg("_v").alias("_mean"), F.stddev_samp("_v").alias("_sd"), F.count("_v").alias("n"))
    means = _resampled(rows.where("_v is not null"), by, seed, n_boot).join(cells.select(*by, "_mean"), by)
    far = F.count_if(F.abs(F.col("mean") - F.col("_mean")) >= F.abs("_mean"))
    ends = means.groupBy(*by).agg(F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"), ((far + 1) / (n_boot + 1)).alias("p"))
    some = lambda c: F.when(F.col("n") >= 2, c)
    dz = F.when(F.col("_sd") > 0, F.col("_mean") / F.col("_sd")).otherwise(0.0)
    return cells.join(ends, by, "left").select(*by, some(F.col("_mean")).alias("diff"), some(F.col("lo")).alias("lo"), some(F.col("hi")).alias("hi"), some(F.col("p")).alias("p"), some(dz).alias("dz"), "n")


def nearest_rank(df: DataFrame, value: str, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by and a column per share: the value of a group's sorted values at int(share * n) from 0, not interpolated; 0 without values. Values are sorted, never gathered."""
    rows, kind = df.select(*by, value), dict(df.dtypes)[value]
    w = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_last())
    n = F.count(value).over(Window.partitionBy(*by))
    placed = rows.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", n)
    at = lambda q: F.least(F.col("_n") - 1, F.floor(F.lit(q) * F.col("_n")))
    return placed.groupBy(*by).agg(*[F.coalesce(F.max(F.when(F.col("_i") == at(q), F.col(value))), F.lit(0).cast(kind)).alias(name) for name, q in shares.items()])


# ---- allocation


def largest_remainder(df: DataFrame, weight: str, total: Column, order: list[str], by: list[str] | None = None) -> DataFrame:
    """df with quota: total split by weight, floors first, then one more for the largest remainders (ties in `order`)."""
    w = Window.partitionBy(*(by or []))
    out = df.withColumn("_raw", total * F.col(weight) / F.sum(weight).over(w)).withColumn("_floor", F.floor("_raw"))
    left = total - F.sum("_floor").over(w)
    place = F.row_number().over(w.orderBy(F.round(F.col("_raw") - F.col("_floor"), 9).desc(), *order))
    return out.withColumn("quota", (F.col("_floor") + (place <= left).cast("int")).cast("long")).drop("_raw", "_floor")
