"""Duplicates: equal content, shared shingles, similar titles, and the ordered greedy removal of near-equal vectors."""

from __future__ import annotations

import difflib
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from ..functions import text as X


def shingles(c, n: int = 8) -> Column:
    """Distinct n-word shingles over the metric tokens; none for fewer words."""
    grams = lambda t: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(t) - n), lambda i: F.array_join(F.slice(t, i + 1, n), " ")))
    return X.let(X.tokens(c), lambda t: F.when(F.size(t) >= n, grams(t)).otherwise(F.array().cast("array<string>")))


def shingle_hashes(c, n: int = 8) -> Column:
    """Distinct hashes of the n-word shingles: every word is hashed once, a shingle is the hash of n of those."""
    grams = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)])))
    return X.let(F.transform(X.tokens(c), lambda w: F.xxhash64(w)), lambda w: F.when(F.size(w) >= n, grams(w)).otherwise(F.array().cast("array<bigint>")))


def sampled(hashes: Column, mod: int = 8) -> Column:
    """Consistent sample of hashes: the same ones from any text that holds them."""
    return F.filter(hashes, lambda h: F.pmod(h, F.lit(mod)) == 0)


def shingle_table(df: DataFrame, key: str, text: str, n: int = 8, mod: int = 1) -> DataFrame:
    """key, h: hashes of the text's shingles, all or a consistent sample of 1 / mod. df has a row per key."""
    hashes = shingle_hashes(text, n)
    return df.select(key, F.explode(sampled(hashes, mod) if mod > 1 else hashes).alias("h"))


def containment_pairs(table: DataFrame, key: str, threshold: float = 0.6) -> DataFrame:
    """a < b, common, containment (share of the smaller set): pairs at the threshold or above. table: key, h, distinct rows.

    Of a set of n hashes, any n - ceil(threshold * n) + 1 hold one that it shares with a partner at the threshold; the rarest ones are
    looked up in the sets that are as large or larger. Boilerplate so proposes pairs only for sets that hold little else. Candidates are
    then intersected whole.
    """
    n = F.size("hashes")
    often = table.groupBy("h").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    shared = table.join(often, "h")
    sets = table.groupBy(key).agg(F.collect_list("h").alias("hashes")).withColumn("n", n)
    sized = shared.join(sets.select(key, "n"), key)
    # hashes of one set only come first in its order, so what it shares starts behind them
    rank = F.row_number().over(Window.partitionBy(key).orderBy("f", "h")) + F.col("n") - F.count(F.lit(1)).over(Window.partitionBy(key))
    prefix = sized.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.lit(threshold) * F.col("n") - 1e-9) + 1)
    small = prefix.select(F.col(key).alias("s"), F.col("n").alias("ns"), "h")
    large = sized.select(F.col(key).alias("l"), F.col("n").alias("nl"), "h")
    found = small.join(large, "h").where("nl > ns or (nl = ns and l > s)").select("s", "l").distinct()
    both = found.join(sets.select(F.col(key).alias("s"), F.col("hashes").alias("hs"), F.col("n").alias("ns")), "s").join(sets.select(F.col(key).alias("l"), F.col("hashes").alias("hl")), "l")
    both = both.withColumn("common", F.size(F.array_intersect("hs", "hl")).cast("long")).withColumn("containment", F.col("common") / F.col("ns"))
    return both.where(F.col("containment") >= threshold).select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"), "common", "containment")


def exact_groups(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sha256, copies, first_key: rows that share their content with another."""
    rows = df.select(key, F.sha2(F.col(text).cast("binary"), 256).alias("sha256"))
    groups = rows.groupBy("sha256").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first_key")).where("copies > 1")
    return rows.join(groups, "sha256").select(key, "sha256", "copies", "first_key")


def largest_of_group(df: DataFrame, group: str, size: str, key: str) -> DataFrame:
    """Of each group the row with the greatest (size, key): an aggregate, no self-join."""
    best = df.groupBy(group).agg(F.max(F.struct(size, key)).alias("best"))
    return best.select(group, F.col(f"best.{size}").alias(size), F.col(f"best.{key}").alias(key))


@F.pandas_udf(DoubleType())
def title_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two titles (Ratcliff and Obershelp)."""
    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)])


TITLE_TILE = 4096  # titles of a tile
_BITS = 255  # of a title's bitmap, so that a distance fits a byte


@F.pandas_udf(BinaryType())
def title_bits(titles: pd.Series) -> pd.Series:
    """Bitmap of a title's letter pairs; the first, second ... occurrence of a pair are different members."""
    places: dict[str, int] = {}

    def bits(t: str) -> bytes:
        seen: dict[str, int] = {}
        out = 0
        for k in range(len(t) - 1):
            pair = t[k : k + 2]
            seen[pair] = seen.get(pair, 0) + 1
            token = f"{pair}{seen[pair]}"
            if token not in places:
                places[token] = zlib.crc32(token.encode()) % _BITS
            out |= 1 << places[token]
        return out.to_bytes(32, "little")

    return titles.map(bits)


def title_candidates(titles: DataFrame, threshold: float) -> DataFrame:
    """ta, tb: pairs of the distinct titles t, among them every pair whose ratio is at the threshold or above, in one order or the other.

    Matching blocks are a common subsequence, so a ratio r leaves at most (1 - r)(m + n) letters to insert or delete. One such edit
    changes three letter pairs at most, and each differing bit of two bitmaps stands for a differing pair: no such pair of titles has
    lengths further apart than that, or bitmaps further apart than three times that. Tiles of titles of like length are compared whole.
    """
    spark = titles.sparkSession
    spans: list[list[int]] = []  # least and greatest length, rows
    for n, c in sorted(map(tuple, titles.groupBy(F.length("t")).count().collect())):
        if spans and spans[-1][2] + c <= TITLE_TILE:
            spans[-1][1:] = [n, spans[-1][2] + c]
        else:
            spans.append([n, n, c])
    first, placed = 0, []
    for lo, hi, rows in spans:
        parts = -(-rows // TITLE_TILE)
        placed.append((first, parts, lo, hi))
        first += parts
    spans_df = spark.createDataFrame(placed, "first int, parts int, lo int, hi int")
    tiles = spans_df.select(F.explode(F.expr("sequence(first, first + parts - 1)")).alias("tile"), "lo", "hi")
    near = (F.col("lo_j") - F.col("hi_i")) <= (1 - threshold) * (F.col("lo_j") + F.col("hi_i")) + 1e-6
    pairs = tiles.select(F.col("tile").alias("i"), F.col("hi").alias("hi_i")).join(tiles.select(F.col("tile").alias("j"), F.col("lo").alias("lo_j")), F.expr("i <= j") & near)
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("tile"))
    at = F.col("first") + F.pmod(F.xxhash64("t"), F.col("parts")).cast("int")
    spread = titles.join(spans_df, F.length("t").between(F.col("lo"), F.col("hi"))).select("t", at.alias("tile"), title_bits("t").alias("bits"))

    def compare(key, pdf):
        pdf = pdf.assign(n=pdf["t"].str.len()).sort_values("n", kind="stable")
        l, r = (pdf[pdf["tile"] == k] for k in key)
        words = lambda x: np.frombuffer(b"".join(x["bits"]), np.uint64).reshape(-1, 4)
        lw, rw, ln, rn, lt, rt = words(l), words(r), l["n"].to_numpy(), r["n"].to_numpy(), l["t"].to_numpy(), r["t"].to_numpy()
        left, right = [], []
        for s in range(0, len(lw) if len(rw) else 0, 128):
            apart = np.bitwise_count(lw[s : s + 128, None, 0] ^ rw[None, :, 0])
            for k in (1, 2, 3):
                apart += np.bitwise_count(lw[s : s + 128, None, k] ^ rw[None, :, k])
            edits = (1 - threshold) * (ln[s : s + 128].max() + rn) + 1e-6
            x, y = np.nonzero(apart <= np.minimum(3 * edits, _BITS).astype(np.uint8))
            x += s
            keep = np.abs(ln[x] - rn[y]) <= (1 - threshold) * (ln[x] + rn[y]) + 1e-6
            if key[0] == key[1]:
                keep &= x < y
            left.append(lt[x[keep]])
            right.append(rt[y[keep]])
        return pd.DataFrame({"ta": np.concatenate(left) if left else [], "tb": np.concatenate(right) if right else []}, dtype=object)

    return spread.join(sides, "tile").groupBy("i", "j").applyInPandas(compare, "ta string, tb string")


def similar_titles(df: DataFrame, key: str, title: str, threshold: float = 0.9, least: int = 12) -> DataFrame:
    """a < b, ratio of normalised titles that are alike: all pairs with a ratio at the threshold or above.

    Distinct titles are compared once; lengths, letter pairs and edit distance sort out pairs that cannot reach the threshold before the
    ratio is computed. The ratio depends on the order of the titles, so both are computed.
    """
    t = df.select(F.col(key).alias("k"), X.normalize_title(title).alias("t")).where((F.length("t") >= least) & ~F.col("t").rlike(r"^chapter \d+$")).distinct()
    edits = (1 - threshold) * (F.length("ta") + F.length("tb")) + 1e-6  # a ratio r leaves at most (1 - r)(m + n) letters to edit
    near = title_candidates(t.select("t").distinct(), threshold).where(F.levenshtein("ta", "tb") <= edits)
    spread = near.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but slow to compare
    alike = spread.withColumn("ab", title_ratio("ta", "tb")).withColumn("ba", title_ratio("tb", "ta")).where(F.greatest("ab", "ba") >= threshold)
    l, r = t.select(F.col("k").alias("ka"), F.col("t").alias("ta")), t.select(F.col("k").alias("kb"), F.col("t").alias("tb"))
    keyed = alike.join(l, "ta").join(r, "tb").where("ka <> kb")
    others = keyed.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"), F.when(F.expr("ka < kb"), F.col("ab")).otherwise(F.col("ba")).alias("ratio")).where(F.col("ratio") >= threshold)
    same = l.join(r, F.expr("ta = tb and ka < kb")).select(F.col("ka").alias("a"), F.col("kb").alias("b"), F.lit(1.0).alias("ratio"))
    return same.unionByName(others)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(X.col(a), X.col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


VECTOR_TILE = 1024  # vectors of a tile


def similar_pairs(df: DataFrame, key: str, vector: str, block: str, threshold: float) -> DataFrame:
    """a < b of one block with inner product above the threshold: tiles of a block's vectors meet in pairs, each pair one matrix product."""
    kinds = dict(df.dtypes)
    rows = df.where(F.col(vector).isNotNull()).select(F.col(block).alias("g"), F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    sizes = rows.groupBy("g").agg(F.ceil(F.count(F.lit(1)) / VECTOR_TILE).cast("int").alias("parts"))
    placed = rows.join(sizes, "g").withColumn("tile", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "k", "v")

    def compare(name, pdf):
        x, y = (pdf[pdf["tile"] == t] for t in name[1:])
        cos = np.array(x["v"].tolist()).reshape(len(x), -1) @ np.array(y["v"].tolist()).reshape(len(y), -1).T if len(x) and len(y) else np.zeros((0, 0))
        p, q = np.nonzero(cos > threshold)
        a, b, c = x["k"].to_numpy()[p], y["k"].to_numpy()[q], cos[p, q]
        once = a < b if name[1] == name[2] else a != b
        a, b, c = a[once], b[once], c[once]
        return pd.DataFrame({"g": [name[0]] * len(a), "a": np.minimum(a, b), "b": np.maximum(a, b), "cosine": c})

    found = met.groupBy("g", "i", "j").applyInPandas(compare, f"g {kinds[block]}, a {kinds[key]}, b {kinds[key]}, cosine double")
    return found.withColumnRenamed("g", block)


def greedy_keep(nodes: DataFrame, edges: DataFrame, key: str, block: str, cut: Callable[[DataFrame], DataFrame] = lambda t: t) -> DataFrame:
    """block, key, kept, dropped_by, cosine: in key order a row is dropped if an earlier kept row of its block is linked to it.

    Rounds instead of a walk: rows without an undecided earlier neighbour are kept, what is linked to them is dropped, and links of
    dropped rows count no more. There are as many rounds as decisions that wait for each other. cut ends a table's lineage (it writes and
    rereads it).
    """
    links = cut(edges.select(F.col(block).alias("g"), "a", "b", "cosine"))
    left, dropped = links.select("g", "a", "b"), None
    while not left.isEmpty():
        heads = left.select("g", "a").join(left.select("g", F.col("b").alias("a")).distinct(), ["g", "a"], "left_anti").distinct()
        gone = cut(left.join(heads, ["g", "a"]).select("g", F.col("b").alias("x")).distinct())
        is_gone = lambda c: gone.select("g", F.col("x").alias(c))  # noqa: E731, B023
        left = cut(left.join(heads, ["g", "a"], "left_anti").join(is_gone("a"), ["g", "a"], "left_anti").join(is_gone("b"), ["g", "b"], "left_anti").select("g", "a", "b"))
        dropped = gone if dropped is None else dropped.unionByName(gone)
    if dropped is None:
        dropped = links.select("g", F.col("a").alias("x"))  # no rows
    by = links.join(dropped.select("g", F.col("x").alias("b")), ["g", "b"]).join(dropped.select("g", F.col("x").alias("a")), ["g", "a"], "left_anti")
    best = by.groupBy("g", "b").agg(F.max_by(F.struct("a", "cosine"), F.struct("cosine", -F.col("a"))).alias("w"))
    out = nodes.select(F.col(block).alias("g"), F.col(key).alias("b")).join(best, ["g", "b"], "left")
    return out.select(F.col("g").alias(block), F.col("b").alias(key), F.col("w").isNull().alias("kept"), F.col("w.a").alias("dropped_by"), F.col("w.cosine").alias("cosine"))


def last_of_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Keep-last by key: the row with the greatest order."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_of_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
