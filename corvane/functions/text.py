"""Text expressions: Column in, Column out, nothing but built-in functions. Java patterns carry (?U) where \\s, \\w and \\b must know Unicode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z0-9\"“(])"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once: inside another lambda an expression would be computed for every element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def ws(c) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def slug(c, longest: int = 48) -> Column:
    """Lower-case ASCII words joined by '-', cut at the last '-' within `longest`; 'doc' if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(c)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(s, 1, longest), "-[^-]*$", "")
    s = F.when(F.length(s) > longest, cut).otherwise(s)
    return F.when(F.length(s) == 0, F.lit("doc")).otherwise(s)


def clean_stem(c) -> Column:
    """File stem without journal prefix, download stamp, ISBN and underscores."""
    s = F.regexp_replace(col(c), "^JA_", "")
    s = F.regexp_replace(s, r"(_\d{2}){6}$", "")
    s = F.regexp_replace(s, r"_?97[89][-\d]{10,}", "")
    return ws(F.replace(s, F.lit("_"), F.lit(" ")))


def unspace(c) -> Column:
    """Letter-spaced runs of three characters or more are closed up ('C H A P T E R one' -> 'CHAPTER one'); so is 'C ontents' as a whole.

    A run is a maximal row of single characters with one space between; the words are folded from left to right.
    """
    words = F.split(col(c), " ")
    single = lambda w: w.rlike(r"(?U)^\w$")
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("run"))
    close = lambda s: F.when(F.size(s["run"]) >= 3, F.array(F.array_join(s["run"], ""))).otherwise(s["run"])

    def step(s: Column, w: Column) -> Column:
        return F.when(single(w), F.struct(s["out"].alias("out"), F.concat(s["run"], F.array(w)).alias("run"))).otherwise(
            F.struct(F.concat(s["out"], close(s), F.array(w)).alias("out"), F.array().cast("array<string>").alias("run"))
        )

    closed = F.aggregate(words, start, step, lambda s: F.array_join(F.concat(s["out"], close(s)), " "))
    closed = F.when(col(c).rlike(r"(?U)(?:^| )\w \w \w(?: |$)"), closed).otherwise(col(c))  # few texts need the fold
    return F.regexp_replace(closed, "^([A-Za-z]) ([a-z]+)$", "$1$2")


def normalize_title(c) -> Column:
    t = F.lower(unspace(clean_stem(c)))
    t = F.regexp_replace(t, r"\bchapter\s+\d+\b", "")
    return ws(F.regexp_replace(t, "[^a-z0-9 ]+", " "))


def normalize_heading(c) -> Column:
    """Lower-case words of a heading without its numbering."""
    t = F.lower(unspace(c))
    t = F.regexp_replace(t, r"^((\d+\.)*\d+\.?|[ivxlc]+\.|appendix [a-z0-9]+\.?)\s+", "")
    return ws(F.regexp_replace(t, "[^a-z0-9 ]+", " "))


def strip_control(c) -> Column:
    """Soft hyphens (with the white space after them) go; other control characters become spaces."""
    t = F.regexp_replace(col(c), "­\\s*", "")
    return ws(F.regexp_replace(t, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", " "))


def sentences(c) -> Column:
    """Sentences that are not blank: a break is white space after .!? and before a capital, digit, quote or bracket."""
    return F.filter(F.split(F.trim(col(c)), SENTENCE_END), lambda s: F.length(F.trim(s)) > 0)


def n_sentences(c) -> Column:
    return F.size(sentences(c))


def n_evidence_sentences(c) -> Column:
    """Sentences of evidence given as spans joined by ' … '."""
    return F.aggregate(F.split(col(c), " … "), F.lit(0), lambda n, s: n + n_sentences(s))


def loose_sentences(c) -> Column:
    """Breaks at any white space after .!? and at line ends."""
    return F.filter(F.split(col(c), r"(?<=[.!?])\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)


def is_complete_sentence(c) -> Column:
    """Ends in .!? and perhaps quotes, brackets or reference numbers in brackets."""
    return ws(c).rlike(r"[.!?][\"”’')\]]*(?:\s*\[\d+(?:\s*[,–-]\s*\d+)*\])?$")


def tokens(c) -> Column:
    """Lower-case ASCII letters and digits in runs: the tokens of the overlap metrics."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def n_words(c) -> Column:
    """Words between white space; 0 for blank."""
    return F.when(F.length(ws(c)) == 0, F.lit(0)).otherwise(F.size(F.split(ws(c), " ")))


def short(c, n: int) -> Column:
    """The first n words, with … if there are more."""
    w = F.split(ws(c), " ")
    return F.when(F.size(w) > n, F.concat(F.array_join(F.slice(w, 1, n), " "), F.lit(" …"))).otherwise(ws(c))


def table_char_share(c) -> Column:
    """Share of characters other than spaces in lines that start with '|'; rows of | - : only carry nothing."""
    bare = F.transform(F.split(col(c), "\n"), lambda x: F.struct(F.replace(x, F.lit(" "), F.lit("")).alias("b"), F.ltrim(x).startswith("|").alias("row")))
    sums = F.aggregate(
        bare,
        F.struct(F.lit(0).alias("all"), F.lit(0).alias("rows")),
        lambda s, x: F.struct((s["all"] + F.length(x["b"])).alias("all"), (s["rows"] + F.when(x["row"] & ~x["b"].rlike(r"^[|:\-]*$"), F.length(x["b"])).otherwise(F.lit(0))).alias("rows")),
    )
    return F.when(sums["all"] > 0, sums["rows"] / sums["all"]).otherwise(F.lit(0.0))


def hits(c, pattern: str) -> Column:
    return F.regexp_count(col(c), F.lit(pattern))


def any_of(terms: list[str], flags: str = "(?iU)", whole: bool = True) -> str:
    """Pattern for any of some terms at a word's start (and end), longest first."""
    alternatives = "|".join("".join("\\" + x if x in r"\.[]{}()*+-?^$|&~#" else x for x in t) for t in sorted(set(terms), key=lambda t: (-len(t), t)))
    return rf"{flags}\b(?:{alternatives})" + (r"\b" if whole else "")


def numbering(c) -> Column:
    """[1, 2, 3] of '1.2.3 Title'; null without a number."""
    found = F.regexp_extract(col(c), r"^((?:\d+\.)*\d+)\.?\s+\S", 1)
    return F.when(F.length(found) > 0, F.transform(F.split(found, r"\."), lambda x: x.try_cast("int")))


def number_ratio(c) -> Column:
    """Share of words that are page numbers or ranges of them."""
    w = F.split(ws(c), " ")
    n = F.size(F.filter(w, lambda x: x.rlike(r"^\d{1,4}[,;.]?(?:[-–]\d{1,4}[,;.]?)?$")))
    return n / F.greatest(n_words(c), F.lit(1))


#: Kinds of sections that are skipped, by the pattern of their normalised heading, in this order (fixed values).
SKIP_HEADINGS = [
    ("references", "(references?( list)?|bibliography|works cited|literature cited|further reading|suggested readings?|recommended readings?|sources)"),
    ("index", r"((subject|author|name) )?index( \d+)?"),
    ("toc", "((table of |brief )?contents|list of (figures|tables|abbreviations|illustrations))"),
    ("front_matter", "(copyright( page)?|dedication|also by.*|other books.*|article info|about the (authors?|editors?|contributors?)|(notes on )?contributors|editors? and contributors)"),
    ("back_matter", "(acknowledge?ments?|declaration of competing interests?|(declaration of )?conflicts? of interests?|competing interests?|funding( sources| information| statement)?|credit authorship contribution statement|authors? contributions?|data availability( statement)?|ethic(s|al) (statement|approval).*|declaration of (generative )?ai.*|(appendix [a-z0-9]+ )?supplementary (data|materials?)|(statements and )?declarations|consent.*|informed consent.*)"),
]


def skip_reason(heading) -> Column:
    """Kind of skipped section that a heading opens, or null."""
    return let(normalize_heading(heading), lambda h: F.coalesce(*[F.when(h.rlike(f"^{rx}$"), F.lit(name)) for name, rx in SKIP_HEADINGS]))


def lenient_json(c) -> Column:
    """The text if it is JSON, else what lies between its first { and last } if that is."""
    inner = F.regexp_extract(col(c), r"(?s)\{.*\}", 0)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(col(c)), col(c)).when((F.length(inner) > 0) & valid(inner), inner)


#: LaTeX spellings (fixed values); NUL stands for the backslash of the text.
TEX = {
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}", "\x00": r"\textbackslash{}",
    "≥": r"$\geq$", "≤": r"$\leq$", "κ": r"$\kappa$", "ρ": r"$\rho$", "Δ": r"$\Delta$", "−": "--", "†": r"$^\dagger$", "×": r"$\times$",
}


def tex_escape(c) -> Column:
    """LaTeX specials escaped; typographic dashes and the like spelt out."""
    t = F.replace(col(c), F.lit("\\"), F.lit("\x00"))
    for x in "&%$#_{}":
        t = F.replace(t, F.lit(x), F.lit("\\" + x))
    for x, y in TEX.items():
        t = F.replace(t, F.lit(x), F.lit(y))
    return t


def pages_text(pages) -> Column:
    """', p. 12' or ', pp. 95-96' of an array of pages; empty without any."""
    p = F.array_sort(F.array_distinct(F.filter(pages, lambda x: x.isNotNull() & (x != 0))))
    first, last = F.get(p, F.lit(0)), F.get(p, F.size(p) - 1)
    return F.when(F.size(p) == 0, F.lit("")).when(first == last, F.concat(F.lit(", p. "), first.cast("string"))).otherwise(F.concat(F.lit(", pp. "), first.cast("string"), F.lit("-"), last.cast("string")))


def citation(title, pages) -> Column:
    return F.concat(F.lit("("), col(title), pages_text(col(pages)), F.lit(")"))


def citation_title(c) -> Column:
    return F.replace(ws(c), F.lit("; "), F.lit(": "))


def content_key(*parts) -> Column:
    """sha256 of parts as canonical JSON (a struct with sorted names)."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


#: What reviewers write (fixed values).
ACCEPT = ["accept", "accepted", "yes", "y", "1", "pass", "ok", "good", "keep", "true"]
REJECT = ["reject", "rejected", "no", "n", "0", "fail", "bad", "drop", "false"]


def verdict_of_text(c) -> Column:
    """accept, reject or unknown; null for blank."""
    v = F.lower(F.trim(col(c)))
    return F.when(v == "", F.lit(None)).when(v.isin(ACCEPT), F.lit("accept")).when(v.isin(REJECT), F.lit("reject")).when(v.isNotNull(), F.lit("unknown"))
