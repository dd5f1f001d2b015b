"""Scores of chunks from pattern counts, and the decision whether a chunk is mined."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

#: name: pattern (Unicode classes on), weight, cap of hits per 100 words (fixed values).
SIGNALS = {
    "definition": (r"\b(?:is|are) defined as|\brefers? to\b|\bcan be (?:defined|understood|described) as|\bis known as|\bwe define|\bdefinition of|\bis the (?:process|ability|capacity|extent|degree)|\bencompass(?:es)?\b|\bconsists? of\b|\bi\.e\.,", 3.0, 2),
    "definition_soft": (r"\b(?:is|are) (?:a|an|the) (?:[\w-]+ ){0,3}(?:that|which|where|in which|used to|whereby)\b|\bthe term\b|\bknown as\b|\bcalled\b", 1.0, 2),
    "number": (r"(?<![\w.\[])(?!(?:19|20)\d\d\b)\d+(?:[.,]\d+)?(?![\w.\]])", 0.5, 4),
    "percent_or_stat": (r"\d\s?%|\bpercent\b|\b[pnNrRβ]\s?[=<>]|\bSD\b|\bM\s?=|\bCI\b|\bodds ratio\b|\bcorrelat\w*|\bsignificant(?:ly)?\b|\bmean\b", 1.5, 3),
    "finding": (r"\b(?:we|study|studies|research|survey|analysis|authors?) (?:found|find|show(?:s|ed)?|reveal(?:s|ed)?|indicate[sd]?|suggest(?:s|ed)?|demonstrate[sd]?|report(?:s|ed)?)\b|\bresults? (?:show|indicate|suggest|reveal|demonstrate)\w*|\bfindings?\b|\bevidence\b|\bassociated with\b|\bpredict(?:s|ed|or)\b", 1.5, 3),
    "recommendation": (r"\bshould\b|\bmust\b|\brecommend\w*|\bneed(?:s)? to\b|\bit is (?:essential|important|crucial|critical) (?:to|that)|\bbest practices?\b|\bguidelines?\b|\bpolic(?:y|ies) (?:should|must)", 1.0, 3),
    "framework": (r"\bframeworks?\b|\bmodels?\b|\bprinciples?\b|\bdimensions?\b|\bpillars?\b|\btaxonom\w+|\bmaturity\b|\bTAM\b|\bUTAUT\d?\b|\bTPACK\b|\bADDIE\b|\bNIST\b|\bUNESCO\b|\bOECD\b|\bEDUCAUSE\b|\bAI Act\b|\bGDPR\b|\bFERPA\b|\bISO\b", 1.0, 3),
    "causal": (r"\bbecause\b|\bleads? to\b|\bresults? in\b|\bdue to\b|\btherefore\b|\bconsequently\b|\bimpacts? on\b|\beffects? of\b|\bthus\b", 0.5, 3),
}
SCALE = 4.0

#: Questions that lean on their source (fixed values).
BANNED = [
    "the evidence", "the (?:source )?text", "the passage", "the excerpt", "the (?:above|following)", r"the authors?(?: above)?\b",
    "this (?:chapter|section|study|paper|article|book|review|report|framework|model|source)",
    r"the (?:chapter|section|study|paper|article|book|review|report)\b(?! (?:of|on|by|titled))", "the recommendations say",
    "according to the (?:source|text|passage|evidence|authors?)", "as (?:described|mentioned|stated|discussed) (?:above|earlier|here)", "in this context", "example is given", "described as",
    r"(?:is|are|be) (?:\w+ )?recommended\b(?!\s+by\b)", "the following", r"according to (?:the|this|these|those)\b",
    r"(?:described|discussed|mentioned|outlined|presented|reported|cited|listed|noted|explained|identified|proposed) (?:in|by) (?:the|this|these)\b",
    r"the (?:source|document|material|reading|discussion|analysis)\b(?!\s+of)", r"(?:is|are|was|were) (?:given|offered|provided) (?:as|for)\b", r"as (?:noted|shown|seen|outlined|argued)\b",
]
#: Text about the making of a pair (fixed values).
META = [
    r"\((?:the )?(?:quoted|provided|given|cited) (?:text|evidence|passage|span|source)", r"\bthe (?:quoted|provided|given) (?:text|evidence|passage|units?|spans?)\b", r"\bknowledge units?\b",
    r"\bunits?\s*\[?u\d{1,2}\]?", r"\[u\d+\]", r"\bevidence (?:says|states|shows|indicates|does not)\b", r"\b(?:as|is) (?:stated|quoted) (?:above|here)\b",
]

BANNED_PATTERN = r"(?iU)\b(?:" + "|".join(f"(?:{p})" for p in BANNED) + ")"
META_PATTERN = "(?iU)" + "|".join(f"(?:{p})" for p in META)


def banned(c) -> Column:
    """The banned words that a text holds, or null."""
    found = F.regexp_extract(X.col(c), BANNED_PATTERN, 0)
    return F.when(F.length(found) > 0, found)


def meta_text(c) -> Column:
    found = F.regexp_extract(X.col(c), META_PATTERN, 0)
    return F.when(F.length(found) > 0, found)


def alternatives(rx: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(rx):
        x = rx[i]
        if x == "\\":
            i += 1
        elif in_class:
            in_class = x != "]"
        elif x == "[":
            in_class = True
        elif x in "()":
            depth += 1 if x == "(" else -1
        elif x == "|" and not depth:
            out.append(rx[start:i])
            start = i + 1
        i += 1
    return [*out, rx[start:]]


def factored(rx: str) -> str:
    """The same pattern with a word boundary that starts every alternative tested once: at most positions it fails at once."""
    parts = alternatives(rx)
    if len(parts) > 1 and all(p.startswith(r"\b") for p in parts):
        return r"\b(?:" + "|".join(p[2:] for p in parts) + ")"
    return rx


def first_characters(rx: str) -> set[str] | None:
    """Members of a character class that holds every first character of the pattern's matches; None if that can't be told."""
    out: set[str] = set()
    for p in alternatives(rx):
        p = p.removeprefix(r"\b")
        if p.startswith("(?:"):
            depth, i = 0, 0
            while i < len(p):
                depth += {"(": 1, ")": -1}.get(p[i], 0)
                if not depth:
                    break
                i += 2 if p[i] == "\\" else 1
            inner, end = first_characters(p[3:i]), i + 1
        elif p.startswith("["):
            end = p.find("]") + 1
            inner = set(p[1 : end - 1]) if p[1 : end - 1].isalnum() else None
        elif p.startswith(r"\d"):
            inner, end = {r"\d"}, 2
        else:
            inner, end = ({p[0]} if p[:1].isalnum() else None), 1
        if inner is None or p[end : end + 1] in ("?", "*", "{"):
            return None
        out |= inner
    return out


def hurried(rx: str) -> str:
    """The same pattern behind a look at one character: at most positions it fails there."""
    first = first_characters(rx)
    return f"(?=[{''.join(sorted(first))}])(?:{factored(rx)})" if first else factored(rx)


def signal_counts(c, signals: dict = SIGNALS) -> dict[str, Column]:
    return {k: X.hits(c, "(?U)" + hurried(rx)) for k, (rx, _, _) in signals.items()}


def density(c, signals: dict = SIGNALS, scale: float = SCALE) -> Column:
    """1 - exp(-sum of capped hits per 100 words, weighted, / scale); not rounded."""
    per = F.greatest(X.n_words(c), F.lit(1)) / 100
    parts = [F.lit(float(w)) * F.least(n / per, F.lit(float(cap))) for (_, w, cap), n in zip(signals.values(), signal_counts(c, signals).values(), strict=True)]
    return 1 - F.exp(-reduce(lambda a, b: a + b, parts) / scale)


def term_score(c, terms: list[str], whole: bool) -> Column:
    """Hits of terms per 100 words; not rounded."""
    return X.hits(c, X.any_of(terms, whole=whole)) / (F.greatest(X.n_words(c), F.lit(1)) / 100)


def touched(c, groups: dict[str, list[str]], least: int = 2) -> Column:
    """Names of the term groups of which a text holds at least `least` terms."""
    return F.array_compact(F.array(*[F.when(X.hits(c, X.any_of(ts)) >= least, F.lit(name)) for name, ts in groups.items()]))


def appendix_or_table(chunk_type, section_path, text, share: float = 0.6) -> Column:
    appendix = F.exists(X.col(section_path), lambda s: F.lower(s).contains("appendix"))
    return F.coalesce(appendix, F.lit(False)) | (X.col(chunk_type) == "table") | (X.table_char_share(text) > share)


def mining_reason(excluded: Column, table: Column, n_tokens, density_, topic, least_tokens: int = 150, least_density: float = 0.35, least_topic: float = 2.0) -> Column:
    """Why a chunk is not mined: the first reason that holds; empty if it is."""
    return (
        F.when(excluded, "excluded_doc").when(table, "appendix_or_table").when(X.col(n_tokens) < least_tokens, "too_short")
        .when(X.col(density_) < least_density, "low_density").when(X.col(topic) < least_topic, "off_topic").otherwise("")
    )


def borderline(df: DataFrame, score: str, threshold: float = 0.35, band: float = 0.05) -> DataFrame:
    return df.where(F.abs(F.col(score) - threshold) <= band)


def fail_reasons(**reasons: Column) -> Column:
    """Names of all conditions that hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in reasons.items()]))


def repairable(fails: Column, may: tuple[str, ...] = ("grounding", "not_standalone"), never: tuple[str, ...] = ("low_value",)) -> Column:
    """Some failure may be repaired and none rules it out; failures are told by how they begin."""
    starts = lambda x, ps: reduce(lambda a, b: a | b, [x.startswith(p) for p in ps])
    return F.exists(fails, lambda x: starts(x, may)) & ~F.exists(fails, lambda x: starts(x, never))
