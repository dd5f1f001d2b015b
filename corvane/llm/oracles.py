"""SQL (DuckDB) for the queries of this package that SQL can express. Constants come from the operators' modules."""

from __future__ import annotations

from . import mixing, neardup, quality

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def _quality() -> str:
    classes, left = [], "t"
    for _, rx in quality.CLASSES:
        after = f"regexp_replace({left}, '{rx.replace(chr(39), chr(39) * 2)}', '', 'g')"
        classes.append(after)
        left = after
    steps = ["len(t)", *[f"len({c})" for c in classes], "0"]
    hist = ", ".join(f"{a} - {b}" for a, b in zip(steps, steps[1:], strict=False))
    lists = " ".join(f"WHEN '{lang}' THEN [{', '.join(chr(39) + w + chr(39) for w in ws)}]" for lang, ws in quality.COMMON_WORDS.items())
    n_common = max(map(len, quality.COMMON_WORDS.values()))
    share = lambda xs, n: f"list_transform({xs}, lambda x: CAST(x AS DOUBLE) / greatest({n}, 1))"
    js = lambda p, q: f"sqrt(greatest(0.0::DOUBLE, list_sum(list_transform(range(1, len({p}) + 1), lambda i: CASE WHEN {p}[i] > 0 THEN 0.5::DOUBLE * {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0.0::DOUBLE END + CASE WHEN {q}[i] > 0 THEN 0.5::DOUBLE * {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0.0::DOUBLE END))))"
    sums = lambda c, n: "[" + ", ".join(f"CAST(coalesce(sum({c}[{k + 1}]), 0) AS BIGINT)" for k in range(n)) + "]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT rid, i, w[i] || chr(31) || w[i + 1] || chr(31) || w[i + 2] AS g FROM d, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g),
rep AS (SELECT rid, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM twice, range(3) r(k) WHERE c > 1 GROUP BY rid),
f AS (SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars, CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l, coalesce(rep.n, 0) AS n_repeat_words, [{hist}] AS h, CASE lang {lists} END AS names FROM d LEFT JOIN rep USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  list_transform(names, lambda x: len(list_filter(w, lambda y: lower(y) = x))) AS c FROM f),
r AS (SELECT lang AS r_lang, {sums("h", len(quality.CLASS_NAMES))} AS rh, {sums("c", n_common)} AS rc, sum(len(t)) AS r_chars, sum(n_words) AS r_words FROM b WHERE names IS NOT NULL AND NOT base_failed GROUP BY lang),
s AS (SELECT b.*, r_lang, {share("h", "len(t)")} AS p, {share("rh", "r_chars")} AS q, {share("list_append(c, n_words - list_sum(c))", "n_words")} AS u, {share("list_append(rc[1:len(c)], r_words - list_sum(rc[1:len(c)]))", "r_words")} AS v FROM b LEFT JOIN r ON r_lang = lang),
j AS (SELECT *, CASE WHEN r_lang IS NOT NULL AND len(t) >= {quality.MIN_CHARS_FOR_CLASSES} THEN {js("p", "q")} END AS a, CASE WHEN r_lang IS NOT NULL AND n_words >= {quality.MIN_WORDS_FOR_COMMON} THEN {js("u", "v")} END AS o FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT (coalesce(a, 0) > {quality.MAX_CLASS_DISTANCE} OR coalesce(o, 0) > {quality.MAX_COMMON_DISTANCE}) AS kept,
  round(a, 6) AS class_distance, round(o, 6) AS common_distance FROM j
"""


_REACH = """reach AS (SELECT id, id AS root FROM nodes UNION SELECT links.b, reach.root FROM reach JOIN links ON links.a = reach.id)"""

NEARDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= {neardup.THRESHOLD}),
nodes AS (SELECT vec_id AS id FROM embeddings), {_REACH}, c AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c ON c.id = vec_id LEFT JOIN n ON n.a = vec_id
"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], chr(31)) AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
nodes AS (SELECT doc_id AS id FROM documents), {_REACH}, c AS (SELECT id, min(root) AS class_id FROM reach GROUP BY id), m AS (SELECT a, count(*) AS m FROM links GROUP BY a)
SELECT d.doc_id, class_id, CAST(coalesce(m, 0) AS BIGINT) AS n_links, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.a = d.doc_id
"""

ORACLE_SQL = {
    "op5_distribution_divergence": _quality(),
    "op6_hash_threshold_mixing": mixing.ORACLE,
    "op8_pca_tiles": NEARDUP,
    "op9_chosen_path_join": JACCARD,
}
