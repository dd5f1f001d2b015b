"""Seeded, partition-independent sampling: quotas by largest remainder, ranks by a hash of the key, interleaved prefixes, splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S


def draw(seed: int, *keys: str) -> Column:
    """A hash that orders rows as if shuffled: the first 60 bits of md5 over seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def stratum_sizes(df: DataFrame, strata: list[str]) -> DataFrame:
    return df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))


def stratified(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 0) -> DataFrame:
    """About `total` rows with quotas by largest remainder; within a stratum the first by draw. Adds quota and place."""
    quota = S.largest_remainder(stratum_sizes(df, strata), "size", F.lit(total), strata)
    w = Window.partitionBy(*strata).orderBy("_draw", key)
    rows = df.withColumn("_draw", draw(seed, key)).withColumn("place", F.row_number().over(w)).drop("_draw")
    return rows.join(quota.select(*strata, "quota"), strata).where(F.col("place") <= F.col("quota"))


def stratified_at_least_one(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 0) -> DataFrame:
    """max(1, round(total * share)) rows of each stratum, then the first `total` of all by draw: small strata may be lost again."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    size = stratum_sizes(df, strata)
    size = size.withColumn("want", F.greatest(F.lit(1), F.bround(total * F.col("size") / F.sum("size").over(Window.partitionBy())).cast("int")))
    w = Window.partitionBy(*strata).orderBy("_draw", key)
    rows = df.withColumn("_draw", draw(seed, key)).withColumn("_n", F.row_number().over(w)).join(size.select(*strata, "want"), strata)
    return rows.where(F.col("_n") <= F.col("want")).orderBy(draw(seed + 1, key), key).limit(total).drop("_n", "want", "_draw")


def interleaved(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 0) -> DataFrame:
    """The stratified sample in an order of which every prefix is stratified: the first of each stratum, then the second ... Adds pos."""
    picked = stratified(df, strata, key, total, seed)
    return picked.withColumn("pos", F.row_number().over(Window.orderBy("place", *strata)) - 1)  # `total` rows


#: Ranges of the draw in which positions are counted.
RANGES = 1 << 14


def placed_by_draw(units: DataFrame, unit: str, seed: int) -> DataFrame:
    """units with place: 1, 2, ... in the order of (draw, unit). Rows are numbered within ranges of the draw, and the counts of the ranges before (RANGES rows) are added."""
    rows = units.withColumn("_draw", draw(seed, unit)).withColumn("_range", F.shiftright("_draw", 60 - (RANGES.bit_length() - 1)))
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows at most
    n = F.row_number().over(Window.partitionBy("_range").orderBy("_draw", unit))
    return rows.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range").withColumn("place", F.col("_before") + n).drop("_draw", "_range", "_before")


def split_rest(df: DataFrame, unit: str, val: float = 0.05, test: float = 0.10, seed: int = 42) -> DataFrame:
    """Each row's split by its unit (all rows of a unit together): the first round(n * val) units by draw, then round(n * test), then train."""
    units = df.select(unit).distinct()
    n = units.count()
    n_val, n_test = round(n * val), round(n * test)
    name = F.when(F.col("place") <= n_val, "val").when(F.col("place") <= n_val + n_test, "test_indomain").otherwise("train")
    return df.join(placed_by_draw(units, unit, seed).select(unit, name.alias("split")), unit)


def round_robin(df: DataFrame, stratum: str, key: str) -> DataFrame:
    """df with pos: the first of each stratum, then the second ... A row's position follows from its place in its stratum and the sizes of all strata, so no task numbers all rows; the sizes (a row per stratum) are broadcast as Spark sees fit."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_size"))
    rows = df.withColumn("_place", F.row_number().over(Window.partitionBy(stratum).orderBy(key)))
    places = rows.groupBy("_place").agg(F.count(F.lit(1)).alias("_wide"))  # strata that reach the place
    # rows in earlier turns: a running sum over turns, as many as the largest stratum has rows, in ranges of turns
    turns = places.withColumn("_range", F.shiftright("_place", 12))
    base = turns.groupBy("_range").agg(F.sum("_wide").alias("_sum"))
    base = base.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_range", "_base")
    within = F.coalesce(F.sum("_wide").over(Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    turns = turns.withColumn("_within", within).join(base, "_range").select("_place", (F.col("_base") + F.col("_within")).alias("_before"))
    in_turn = F.row_number().over(Window.partitionBy("_place").orderBy(stratum))
    return rows.withColumn("_in_turn", in_turn).join(turns, "_place").withColumn("pos", F.col("_before") + F.col("_in_turn") - 1).drop("_place", "_in_turn", "_before")


def heldout_groups(pairs: DataFrame, group: str, folder: str, dimension: str, share: float = 0.12, least: int = 10, most: int = 15, seed: int = 42) -> DataFrame:
    """Whole groups to hold out, at most `most` rows: first cover, then fill.

    Cover: for each dimension the smallest eligible group that has it. Fill: of the others, folder by folder in the order of the draw,
    as many as fit into what the cover left of the folder's part of the target (share of all pairs). At least `least` groups where there
    are so many. Groups above half the target are not eligible.
    """
    cells = pairs.groupBy(group, dimension).agg(F.min(folder).alias("_f"), F.count(F.lit(1)).alias("_c")).persist()  # all that follows reads these alone
    groups = cells.groupBy(group).agg(F.min("_f").alias("_folder"), F.sum("_c").alias("_n")).withColumn("_draw", draw(seed, group))
    total = cells.agg(F.sum("_c")).first()[0] or 0
    target = share * total
    fit = groups.where(F.col("_n") <= max(target / 2, 1.0))
    of_dimension = cells.join(fit, group).groupBy(dimension).agg(F.min_by(group, F.struct("_n", "_draw")).alias(group))
    spark, kind = pairs.sparkSession, dict(pairs.dtypes)[group]
    held = lambda rows: spark.createDataFrame([(r[0],) for r in rows], f"`{group}` {kind}")
    cover = fit.join(of_dimension.select(group).distinct(), group, "left_semi").select(group, "_folder", "_n", "_draw").orderBy("_n", "_draw").limit(most).collect()  # at most `most` rows
    taken: dict = {}
    for r in cover:
        taken[r[1]] = taken.get(r[1], 0) + r[2]
    rooms = groups.groupBy("_folder").agg(F.sum("_n").alias("_all"))
    spent = F.coalesce(*[F.when(F.col("_folder").eqNullSafe(F.lit(f)), F.lit(n)) for f, n in taken.items()], F.lit(0))
    rooms = rooms.select(F.col("_folder").alias("_in"), (F.lit(target) * F.col("_all") / max(total, 1) - spent).alias("_room"))
    w = Window.partitionBy("_folder").orderBy("_draw")
    rest = fit.join(F.broadcast(held(cover)), group, "left_anti").withColumn("_rn", F.row_number().over(w)).withColumn("_sum", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rest = rest.where(F.col("_rn") <= most).join(rooms, F.col("_folder").eqNullSafe(F.col("_in"))).withColumn("_fits", F.col("_sum") <= F.col("_room"))
    more = rest.select(group, "_fits").orderBy(F.desc("_fits"), "_rn", "_draw").limit(most).collect()  # at most `most` rows
    n_more = max(least - len(cover), min(sum(r[1] for r in more), most - len(cover)), 0)
    cells.unpersist()
    return held([*cover, *more[:n_more]])


def make_splits(pairs: DataFrame, group: str, folder: str, unit: str, dimension: str, seed: int = 42, **heldout) -> DataFrame:
    """pairs with split: held-out groups, then the rest by unit."""
    held = heldout_groups(pairs, group, folder, dimension, seed=seed, **heldout)
    rest = split_rest(pairs.join(F.broadcast(held), group, "left_anti"), unit, seed=seed)  # held: at most `most` rows
    return rest.unionByName(pairs.join(F.broadcast(held), group, "left_semi").withColumn("split", F.lit("test_heldout_docs")))


def covering_splits(pairs: DataFrame, group: str, folder: str, unit: str, dimension: str, seed: int = 42, tries: int = 5, **heldout) -> tuple[DataFrame, int, int]:
    """Splits of the first seed whose two test splits hold every dimension, else of the one that misses fewest; with the seed and what is missing."""
    best, all_dims = None, pairs.select(F.countDistinct(dimension)).first()[0]
    for s in range(seed, seed + tries):
        out = make_splits(pairs, group, folder, unit, dimension, s, **heldout)
        got = {r[0]: r[1] for r in out.groupBy("split").agg(F.countDistinct(dimension)).collect()}
        missing = sum(all_dims - got.get(t, 0) for t in ("test_indomain", "test_heldout_docs"))
        if best is None or missing < best[2]:
            best = (out, s, missing)
        if not missing:
            break
    return best


def split_checks(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """check, n_keys, n_leaking: for each named column, how many of its values occur in more than one split."""
    parts = None
    for name, column in checks.items():
        keys = df.groupBy(column).agg(F.countDistinct("split").alias("n"))
        one = keys.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_leaking"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def slots(spark: SparkSession, type_mix: dict[str, int], difficulty_mix: dict[str, int], hard_first: list[str], total: int, seed: int = 0) -> DataFrame:
    """slot, q_type, difficulty: `total` slots with quotas by largest remainder; hard ones go to the types in hard_first, easy ones from its end."""

    def quotas(mix):
        df = spark.createDataFrame([(k, w, i) for i, (k, w) in enumerate(mix.items())], "name string, weight int, ord int")
        return S.largest_remainder(df, "weight", F.lit(total), ["ord"]).select("name", "quota")

    n = {r[0]: r[1] for r in quotas(difficulty_mix).collect()}  # one row per difficulty
    rank = F.array_position(F.array(*[F.lit(t) for t in hard_first]), F.col("q_type"))
    rows = quotas(type_mix).select(F.col("name").alias("q_type"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
    rows = rows.withColumn("d", draw(seed, "q_type", "i")).withColumn("r", rank)
    hard = F.row_number().over(Window.orderBy("r", "d"))
    rows = rows.withColumn("hard", hard <= n.get("hard", 0))
    easy = F.row_number().over(Window.partitionBy("hard").orderBy(F.desc("r"), "d"))
    rows = rows.withColumn("difficulty", F.when(F.col("hard"), "hard").when(easy <= n.get("easy", 0), "easy").otherwise("medium"))
    return rows.select((F.row_number().over(Window.orderBy(draw(seed + 1, "q_type", "i"))) - 1).alias("slot"), "q_type", "difficulty")
