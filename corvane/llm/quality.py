"""Quality rules by distribution divergence, in built-in expressions only.

Each document's character-class histogram and common-word histogram are held against those of its language by the
Jensen-Shannon distance (base 2, 0 to 1). The references are the pooled counts of all documents of the language that pass
the base rules. Word lists are a parameter: those of four languages are given, frequent_words() finds others in the data. A distance counts only for texts of a minimum length: short histograms are noise.

Cases: null text counts as empty (no words; base_failed); null lang or one without a word list or a reference: only the base
rules speak; repeated rows: judged one by one, and counted in the references as often as they occur; empty table: empty
result; other columns are ignored by verdicts() and kept by keep().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Most frequent function words by language (fixed values).
COMMON_WORDS = {
    "en": "the of and to in a is that it for on was be with as by".split(),
    "de": "der die und den von zu das mit sich des auf ist im dem nicht ein".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par".split(),
    "es": "de la que el en y a los del se las por un para con no".split(),
}
#: Character classes, each counted in what the classes before it left over; the rest is the last class.
CLASSES = [("lower", r"\p{Ll}+"), ("blank", r"[\x20\x09-\x0D]+"), ("upper", r"\p{Lu}+"), ("stop", r"[.,;:!?'\"()\-]+"), ("digit", r"\p{Nd}+"), ("symbol", r"[#*$%&|<>@\\/\[\]{}=+~^_]+")]
CLASS_NAMES = [n for n, _ in CLASSES] + ["other"]

MIN_WORDS = 50
MIN_CHARS_FOR_CLASSES = 200
MIN_WORDS_FOR_COMMON = 100
MAX_CLASS_DISTANCE = 0.25
MAX_COMMON_DISTANCE = 0.29

Lists = dict[str, list[str]]


def _codes(words: Lists) -> dict[str, str]:
    """One character for each common word."""
    return {w: chr(0x100 + k) for k, w in enumerate(sorted({w for ws in words.values() for w in ws}))}


def frequent_words(docs: DataFrame, k: int = 18, languages: int = 64) -> Lists:
    """Word lists from the data, for languages without one by hand: the k most frequent words (lower case, letters only) of each of the most frequent languages. The driver gets k * languages rows at most."""
    words = docs.where("lang is not null").select("lang", F.explode(F.transform(C.words_of(F.col("text")), F.lower)).alias("word")).where(F.col("word").rlike(r"^\p{L}+$"))
    counts = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    large = counts.groupBy("lang").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "lang").limit(languages)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top = counts.join(F.broadcast(large.select("lang")), "lang").withColumn("place", place).where(F.col("place") <= k)  # large: `languages` rows
    out: Lists = {}
    for r in sorted(top.select("lang", "place", "word").collect()):
        out.setdefault(r.lang, []).append(r.word)
    return out


def _repeat_words(w: Column) -> Column:
    """Words within three-word windows that occur at two places or more; a window is told by its 64-bit hash."""
    windows = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
        return C.let(
            F.sort_array(F.transform(twice, lambda x: x["i"])),
            lambda p: F.aggregate(F.transform(p, lambda v, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - v, F.lit(3)))), F.lit(0), lambda a, x: a + x),
        )

    return F.coalesce(C.let(F.sort_array(windows), covered), F.lit(0)).cast("long")


def features(docs: DataFrame, *carry: str, words: Lists = COMMON_WORDS) -> DataFrame:
    """doc_id, lang, the base figures, c_<class> counts, w_<k>: counts of the k-th common word of the language; and the columns in carry."""
    text, code = F.coalesce("text", F.lit("")), _codes(words)
    codes = F.create_map(*[F.lit(x) for kv in code.items() for x in kv])

    def of_words(w: Column) -> Column:
        met = F.filter(F.transform(w, F.lower), lambda x: x.isin(list(code)))
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"), F.array_join(F.transform(met, lambda x: F.element_at(codes, x)), "").alias("common"))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(C.WORD))
    df = docs.select(
        "doc_id", "lang", *carry, text.alias("text"),
        C.let(C.words_of(F.col("text")), of_words).alias("w"),
        C.let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
    )
    df = df.select(
        "doc_id", "lang", *carry, "w.*", "n_dup_lines",
        F.length(F.translate("text", C.BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.length("text").cast("long").alias("n_chars"),
        C.let(F.regexp_replace("text", CLASSES[0][1], ""), _class_counts).alias("left"),
    )
    # lengths left after each class, from all characters down to none: their differences are the counts
    steps = F.concat(F.array("n_chars"), F.transform("left", lambda x: x.cast("long")), F.array(F.lit(0).cast("long")))
    classes = C.let(steps, lambda x: F.transform(F.sequence(F.lit(0), F.lit(len(CLASSES))), lambda k: F.get(x, k) - F.get(x, k + 1)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lists = F.create_map(*[x for lang, ws in words.items() for x in (F.lit(lang), F.array(*[F.lit(code[w]) for w in ws]))])
    common = C.let(F.col("common"), lambda s: F.transform(F.element_at(lists, F.col("lang")), lambda ch: (F.length(s) - F.length(F.replace(s, ch, F.lit("")))).cast("long")))
    return df.select("doc_id", "lang", *carry, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "n_chars", classes.alias("classes"), common.alias("commons"))


def _class_counts(rest: Column, k: int = 1) -> Column:
    """Lengths of what is left after each class has been taken out, one after the other."""
    here = F.array(F.length(rest))
    return here if k == len(CLASSES) else F.concat(here, C.let(F.regexp_replace(rest, CLASSES[k][1], ""), lambda r: _class_counts(r, k + 1)))


def references(feats: DataFrame, words: Lists = COMMON_WORDS) -> DataFrame:
    """One row per language with a word list: pooled counts over all documents that pass the base rules. At most len(words) rows."""
    pooled = feats.where(F.col("lang").isin(list(words)) & ~F.col("base_failed"))
    sums = lambda c, n: F.array(*[F.coalesce(F.sum(F.get(c, F.lit(k))), F.lit(0)) for k in range(n)])
    return pooled.groupBy(F.col("lang").alias("r_lang")).agg(sums("classes", len(CLASS_NAMES)).alias("r_classes"), sums("commons", max(map(len, words.values()))).alias("r_commons"), F.sum("n_chars").alias("r_chars"), F.sum("n_words").alias("r_words"))


def _js(counts: Column, total: Column, ref_counts: Column, ref_total: Column, rest: bool) -> Column:
    """Distance of two histograms given as counts; with rest, what the counts leave of the total is one more bin."""

    def shares(xs: Column, n: Column) -> Column:
        some = F.greatest(n, F.lit(1)).cast("double")
        full = F.concat(xs, F.array(n - F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x))) if rest else xs
        return F.transform(full, lambda x: x / some)

    term = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    parts = F.zip_with(shares(counts, total), shares(ref_counts, ref_total), lambda a, b: 0.5 * term(a, b) + 0.5 * term(b, a))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance"]


def verdicts(docs: DataFrame, words: Lists = COMMON_WORDS) -> DataFrame:
    """One row per document, with the columns COLUMNS."""
    feats = C.cut(features(docs, words=words), "quality")
    return judged(feats, references(feats, words)).select(*COLUMNS)


def judged(feats: DataFrame, refs: DataFrame) -> DataFrame:
    df = feats.join(F.broadcast(refs), F.col("lang") == F.col("r_lang"), "left")  # refs: a row per listed language
    known, c = F.col("r_lang").isNotNull(), F.col
    df = df.withColumns({
        "class_distance": F.when(known & (c("n_chars") >= MIN_CHARS_FOR_CLASSES), _js(c("classes"), c("n_chars"), c("r_classes"), c("r_chars"), False)),
        "common_distance": F.when(known & (c("n_words") >= MIN_WORDS_FOR_COMMON), _js(c("commons"), c("n_words"), F.slice("r_commons", 1, F.size("commons")), c("r_words"), True)),
    })
    diverges = (F.coalesce("class_distance", F.lit(0.0)) > MAX_CLASS_DISTANCE) | (F.coalesce("common_distance", F.lit(0.0)) > MAX_COMMON_DISTANCE)
    return df.withColumn("kept", ~F.col("base_failed") & ~diverges)


def keep(docs: DataFrame, words: Lists = COMMON_WORDS) -> DataFrame:
    """The documents that the rules keep, with the columns they came with. Figures are made once and stand beside their rows: there is no join on ids."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])  # any names pass, dots too
    at = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
    rows = plain.select(*[F.col(at[c]).alias(c) for c in ("doc_id", "lang", "text")], F.struct(*plain.columns).alias("held"))
    feats = C.cut(features(rows, "held", words=words), "quality")
    return judged(feats, references(feats, words)).where("kept").select("held.*").toDF(*docs.columns)
