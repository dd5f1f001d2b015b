"""Queries of text functions, projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking, scoring
from .registry import query
from .stand_ins import LINES, PAIRS, lines, pairs, table

WS = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("SELECT doc_id, " + WS + " AS ws_text, CAST(len(" + WS + ") AS BIGINT) AS n FROM documents")
def x01_whitespace(spark, d):
    return table(spark, d, "documents").select("doc_id", X.ws("text").alias("ws_text"), F.length(X.ws("text")).cast("long").alias("n"))


@query(
    r"""WITH s AS (SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents),
    c AS (SELECT doc_id, CASE WHEN len(s) > 48 THEN regexp_replace(substr(s, 1, 48), '-[^-]*$', '') ELSE s END AS slug FROM s)
    SELECT doc_id, CASE WHEN slug = '' THEN 'doc' ELSE slug END AS slug FROM c"""
)
def x02_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", X.slug("text").alias("slug"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(t, '^JA_', ''), '(_\d{2}){6}$', ''), '_?97[89][-\d]{10,}', '', 'g'), '_', ' '), '\s+', ' ', 'g')) AS stem
    FROM (SELECT p_partkey, 'JA_' || replace(p_name, ' ', '_') || '_978' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') || '_01_02_03_04_05_06' AS t FROM part)"""
)
def x03_clean_stem(spark, d):
    t = F.concat(F.lit("JA_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_978"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"), F.lit("_01_02_03_04_05_06"))
    return table(spark, d, "part").select("p_partkey", X.clean_stem(t).alias("stem"))


@query(r"SELECT p_partkey, regexp_replace(w, '([a-z])', '\1 ', 'g') || 'and ' || p_name AS spaced, CASE WHEN len(w) >= 3 THEN w || ' ' ELSE regexp_replace(w, '([a-z])', '\1 ', 'g') END || 'and ' || p_name AS closed FROM (SELECT p_partkey, p_name, regexp_extract(p_name, '^[a-z]*') AS w FROM part)")
def x04_unspace(spark, d):
    spaced = F.concat(F.regexp_replace(F.regexp_extract("p_name", "^[a-z]*", 0), "([a-z])", "$1 "), F.lit("and "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", spaced.alias("spaced"), X.unspace(spaced).alias("closed"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\bchapter\s+\d+\b', '', 'g'), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS title
    FROM (SELECT p_partkey, 'Chapter ' || CAST(p_partkey AS VARCHAR) || ': ' || p_name || ' (' || p_brand || ')' AS t FROM part)"""
)
def x05_normalize_title(spark, d):
    t = F.concat(F.lit("Chapter "), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(")"))
    return table(spark, d, "part").select("p_partkey", X.normalize_title(t).alias("title"))


@query(
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '^((\d+\.)*\d+\.?|[ivxlc]+\.|appendix [a-z0-9]+\.?)\s+', ''), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS heading
    FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || '.' || CAST(p_partkey % 7 AS VARCHAR) || ' ' || p_name || '/' || p_type AS t FROM part)"""
)
def x06_normalize_heading(spark, d):
    t = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" "), F.col("p_name"), F.lit("/"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", X.normalize_heading(t).alias("heading"))


@query(
    r"""SELECT doc_id, word, CAST(count(*) AS BIGINT) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(regexp_replace(text, '[\w\x{80}-\x{10FFFF}]+- [\w\x{80}-\x{10FFFF}]+', ' ', 'g')), '[a-z]+')) AS word FROM documents) GROUP BY doc_id, word"""
)
def x07_vocabulary(spark, d):
    words = F.regexp_extract_all(F.lower(F.regexp_replace("text", r"(?U)\w+- \w+", " ")), F.lit("[a-z]+"), F.lit(0))
    return table(spark, d, "documents").select("doc_id", F.explode(words).alias("word")).groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, chr(173) || '\\s*', '', 'g'), '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean FROM (SELECT doc_id, substr(text, 1, 20) || chr(173) || ' ' || chr(7) || text AS t FROM documents)")
def x09_strip_control(spark, d):
    t = F.concat(F.substring("text", 1, 20), F.lit("­ \x07"), F.col("text"))
    return table(spark, d, "documents").select("doc_id", X.strip_control(t).alias("clean"))


# RE2 has no lookaround: a sentence break is where white space after .!? is followed by a capital or digit, marked first and split there
SENTENCES = r"""list_filter(string_split(regexp_replace(trim(text), '([.!?])\s+([A-Z0-9"“(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: length(trim(x)) > 0)"""


@query("SELECT doc_id, CAST(len(" + SENTENCES + ") AS BIGINT) AS n_sentences FROM documents")
def x10_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", X.n_sentences("text").cast("long").alias("n_sentences"))


@query("WITH j AS (SELECT doc_id, replace(text, chr(10), ' … ') AS text FROM documents) SELECT doc_id, CAST(coalesce(list_sum(list_transform(string_split(text, ' … '), lambda s: len(list_filter(string_split(regexp_replace(trim(s), '([.!?])\\s+([A-Z0-9\"“(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: length(trim(x)) > 0)))), 0) AS BIGINT) AS n FROM j")
def x11_evidence_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", X.n_evidence_sentences(F.replace("text", F.lit("\n"), F.lit(" … "))).cast("long").alias("n"))


@query(r"SELECT doc_id, CAST(len(list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)) AS BIGINT) AS n FROM documents")
def x12_loose_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.loose_sentences("text")).cast("long").alias("n"))


@query("WITH " + LINES + r""" SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '[.!?]["”’'')\]]*(?:\s*\[\d+(?:\s*[,–-]\s*\d+)*\])?$')) AS BIGINT) AS n_complete FROM lines GROUP BY doc_id""")
def x13_complete_sentence(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(X.is_complete_sentence("text")).alias("n_complete"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS n_tokens, CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS n_types FROM documents")
def x14_metric_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens("text")).cast("long").alias("n_tokens"), F.size(F.array_distinct(X.tokens("text"))).cast("long").alias("n_types"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_words FROM documents")
def x15_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.n_words("text").cast("long").alias("n_words"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents), b AS (SELECT doc_id, replace(x, ' ', '') AS b, starts_with(ltrim(x), '|') AS r FROM l)
    SELECT doc_id, CASE WHEN sum(length(b)) > 0 THEN CAST(sum(CASE WHEN r AND NOT regexp_full_match(b, '[|:-]*') THEN length(b) ELSE 0 END) AS DOUBLE) / CAST(sum(length(b)) AS DOUBLE) ELSE 0.0 END AS share FROM b GROUP BY doc_id"""
)
def x16_table_char_share(spark, d):
    return table(spark, d, "documents").select("doc_id", X.table_char_share("text").alias("share"))


@query(
    "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{rx}')) AS BIGINT) AS n_{k}" for k, (rx, _, _) in scoring.SIGNALS.items() if k not in ("number", "percent_or_stat")) + " FROM documents"
)
def x17_signal_counts(spark, d):
    counts = scoring.signal_counts("text", {k: v for k, v in scoring.SIGNALS.items() if k not in ("number", "percent_or_stat")})
    return table(spark, d, "documents").select("doc_id", *[c.cast("long").alias(f"n_{k}") for k, c in counts.items()])


@query()
def x17_signals_with_lookaround(spark, d):
    counts = scoring.signal_counts("text", {k: scoring.SIGNALS[k] for k in ("number", "percent_or_stat")})
    return table(spark, d, "documents").select("doc_id", *[c.cast("long").alias(f"n_{k}") for k, c in counts.items()])


TERMS = ["the", "and", "is", "er", "on the", "de la", "der"]


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(lower(' ' || regexp_replace(text, '[^A-Za-z0-9\x{80}-\x{10FFFF}]', '  ', 'g') || ' '), ' (on  the|de  la|the|and|der|er|is) ')) AS BIGINT) AS n_terms FROM documents")
def x18_term_counts(spark, d):
    bare = F.regexp_replace("text", "[^A-Za-z0-9\\x{80}-\\x{10FFFF}]", " ")
    return table(spark, d, "documents").select("doc_id", X.hits(bare, X.any_of(TERMS)).cast("long").alias("n_terms"))


@query()
def x19_banned_phrases(spark, d):
    asked = F.concat(F.lit("What does "), F.when(F.col("qa_id") % 2 == 0, "the evidence").otherwise("a policy"), F.lit(" say on "), F.col("question"))
    p = pairs(spark, d).select("qa_id", asked.alias("q"))
    return p.select("qa_id", scoring.banned("q").alias("banned"), scoring.meta_text("q").alias("meta"))


@query(
    r"""SELECT p_partkey, list_transform(string_split(regexp_extract(t, '^((?:\d+\.)*\d+)\.?\s+\S', 1), '.'), lambda x: CAST(x AS INTEGER)) AS numbers, CAST(len(string_split(regexp_extract(t, '^((?:\d+\.)*\d+)\.?\s+\S', 1), '.')) AS INTEGER) AS depth
    FROM (SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN '.' || CAST(p_partkey % 9 AS VARCHAR) ELSE '' END || ' ' || p_name AS t FROM part)"""
)
def x20_numbering(spark, d):
    t = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("."), (F.col("p_partkey") % 9).cast("string"))).otherwise(""), F.lit(" "), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.numbering(t).alias("numbers"), F.size(X.numbering(t)).alias("depth"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM (SELECT doc_id, text || ' 12 13-15 99,' AS text FROM documents))
    SELECT doc_id, CAST(len(list_filter(w, lambda x: regexp_full_match(x, '\d{1,4}[,;.]?(?:[-–]\d{1,4}[,;.]?)?'))) AS DOUBLE) / CAST(greatest(len(w), 1) AS DOUBLE) AS ratio FROM w"""
)
def x21_number_ratio(spark, d):
    return table(spark, d, "documents").select("doc_id", X.number_ratio(F.concat("text", F.lit(" 12 13-15 99,"))).alias("ratio"))


HEADS = ["References", "Subject Index 2", "Table of Contents", "About the Authors", "Data availability statement", "3. Method", "Acknowledgements", "Appendix A Supplementary materials"]
KINDS_SQL = "['references', 'index', 'toc', 'front_matter', 'back_matter', NULL, 'back_matter', 'back_matter']"


@query(f"SELECT p_partkey, ({KINDS_SQL})[p_partkey % 8 + 1] AS kind FROM part")
def x22_skip_sections(spark, d):
    head = F.get(F.array(*[F.lit(h) for h in HEADS]), (F.col("p_partkey") % 8).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.skip_reason(head).alias("kind"))


@query(
    "WITH " + LINES + r""" SELECT doc_id, CAST(count(*) FILTER (regexp_matches(lower(text), 'all rights reserved|library of congress|\bisbn\b')) AS BIGINT) AS n_copyright,
    CAST(count(*) FILTER (regexp_matches(text, '(\.\s?){4,}\s*\d{1,4}\s*$')) AS BIGINT) AS n_toc, CAST(count(*) FILTER (len(text) < 250 AND regexp_matches(lower(text), '^(received|accepted|revised|available online)|https?://doi\.org|creativecommons')) AS BIGINT) AS n_meta FROM lines GROUP BY doc_id"""
)
def x23_line_kinds(spark, d):
    t = F.col("text")
    return lines(spark, d).groupBy("doc_id").agg(
        F.count_if(F.lower(t).rlike(r"all rights reserved|library of congress|\bisbn\b")).alias("n_copyright"),
        F.count_if(t.rlike(r"(\.\s?){4,}\s*\d{1,4}\s*$")).alias("n_toc"),
        F.count_if((F.length(t) < 250) & F.lower(t).rlike(r"^(received|accepted|revised|available online)|https?://doi\.org|creativecommons")).alias("n_meta"),
    )


@query()
def x24_author_lists(spark, d):
    from ..operators.structure import article_authors_udf, book_authors_udf

    name = F.initcap("p_name")
    a, b = F.concat(name, F.lit(" a,1 , "), F.initcap("p_type"), F.lit(" Smith b,1")), F.concat(name, F.lit(" · Mary Jones, University of X"))
    return table(spark, d, "part").select("p_partkey", article_authors_udf(a).alias("article"), book_authors_udf(b).alias("book"))


@query(r"SELECT doc_id, CASE WHEN len(w) > 12 THEN array_to_string(w[1:12], ' ') || ' …' ELSE array_to_string(w, ' ') END AS head FROM (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents)")
def x25_short_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.short("text", 12).alias("head"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, TRUE AS found FROM events")
def x26_lenient_json(spark, d):
    broken = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure! Here it is: "), "props", F.lit(" Hope it helps"))).otherwise(F.col("props"))
    j = X.lenient_json(broken)
    return table(spark, d, "events").select("event_id", F.get_json_object(j, "$.k").cast("long").alias("k"), j.isNotNull().alias("found"))


@query("SELECT doc_id, sha256(text) AS sha256, substr(sha1(text), 1, 16) AS sha1_16 FROM documents")
def x28_content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.substring(F.sha1(F.col("text").cast("binary")), 1, 16).alias("sha1_16"))


@query("SELECT qa_id, sha256('{\"model\":\"m1\",\"prompt\":\"p' || CAST(qa_id AS VARCHAR) || '\",\"role\":\"judge\"}') AS key FROM (WITH " + PAIRS + " SELECT * FROM pairs)")
def x29_request_key(spark, d):
    parts = (F.lit("m1").alias("model"), F.concat(F.lit("p"), F.col("qa_id").cast("string")).alias("prompt"), F.lit("judge").alias("role"))
    return pairs(spark, d).select("qa_id", X.content_key(*parts).alias("key"))


@query("SELECT event_type, CAST(count(*) FILTER (regexp_matches(lower('Error: ' || event_type || ' credit balance'), 'credit|billing|purchase')) AS BIGINT) AS n FROM events GROUP BY event_type")
def x30_billing_errors(spark, d):
    msg = F.lower(F.concat(F.lit("Error: "), "event_type", F.lit(" credit balance")))
    return table(spark, d, "events").groupBy("event_type").agg(F.count_if(msg.rlike("credit|billing|purchase")).alias("n"))


# ---- projections and predicates


@query(
    r"""WITH p AS (SELECT page_id % 20 AS doc, len(regexp_replace(html, '\s', '', 'g')) >= 2500 AS ok FROM pages), r AS (SELECT doc, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS ratio FROM p GROUP BY doc)
    SELECT doc, ratio, CASE WHEN ratio >= 0.9 THEN 'yes' WHEN ratio <= 0.1 THEN 'no' ELSE 'partial' END AS text_layer FROM r"""
)
def p01_text_layer(spark, d):
    p = table(spark, d, "pages").select(F.pmod("page_id", F.lit(20)).cast("long").alias("doc"), (F.length(F.regexp_replace("html", r"\s", "")) >= 2500).alias("ok"))
    r = p.groupBy("doc").agg((F.count_if("ok") / F.count(F.lit(1))).alias("ratio"))
    return r.withColumn("text_layer", F.when(F.col("ratio") >= 0.9, "yes").when(F.col("ratio") <= 0.1, "no").otherwise("partial"))


@query(
    r"""SELECT page_id, CASE WHEN len(meta) > 4 AND NOT regexp_matches(lower(meta), '^(untitled|microsoft word|document\d*|title|unknown)\b') THEN meta WHEN h1 <> '' THEN h1 ELSE 'page ' || CAST(page_id AS VARCHAR) END AS title,
    CASE WHEN len(meta) > 4 AND NOT regexp_matches(lower(meta), '^(untitled|microsoft word|document\d*|title|unknown)\b') THEN 'metadata' WHEN h1 <> '' THEN 'font' ELSE 'filename' END AS title_source
    FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Untitled' ELSE regexp_extract(html, '<title>([^<]*)', 1) END AS meta, CASE WHEN page_id % 2 = 0 THEN '' ELSE regexp_extract(html, '<h1>([^<]*)', 1) END AS h1 FROM pages)"""
)
def p02_title_priority(spark, d):
    meta = F.when(F.col("page_id") % 3 == 0, "Untitled").otherwise(F.regexp_extract("html", "<title>([^<]*)", 1))
    h1 = F.when(F.col("page_id") % 2 == 0, "").otherwise(F.regexp_extract("html", "<h1>([^<]*)", 1))
    p = table(spark, d, "pages").select("page_id", meta.alias("meta"), h1.alias("h1"))
    ok = (F.length("meta") > 4) & ~F.lower("meta").rlike(r"^(untitled|microsoft word|document\d*|title|unknown)\b")
    return p.select("page_id", F.when(ok, F.col("meta")).when(F.col("h1") != "", F.col("h1")).otherwise(F.concat(F.lit("page "), F.col("page_id").cast("string"))).alias("title"), F.when(ok, "metadata").when(F.col("h1") != "", "font").otherwise("filename").alias("title_source"))


@query(r"SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Name' || CAST(c_custkey AS VARCHAR) ELSE regexp_replace(c_name, '^(edited|ed\.)\s+by\s+', '', 'i') END AS author FROM customer")
def p04_author(spark, d):
    meta = F.when(F.col("c_custkey") % 3 == 0, "admin").otherwise(F.concat(F.lit("Edited by "), F.col("c_name")))
    stem = F.concat(F.lit("Name"), F.col("c_custkey").cast("string"), F.lit("_2021_Title"))
    bad = meta.rlike(r"(?i)^(user|admin|administrator|owner|unknown|author|pc|hp|dell|lenovo)$|\.(indd|indb|doc|docx|tex)$|^\W*$")
    author = F.when(~bad, meta).otherwise(F.regexp_extract(stem, r"^(.+?)_(?:19|20)\d{2}_", 1))
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(author, r"(?i)^(edited|ed\.)\s+by\s+", "").alias("author"))


@query(
    r"""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%Y') AS y, 'Received ' || strftime(o_orderdate, '%Y') || '; accepted ' || CAST(year(o_orderdate) + 1 AS VARCHAR) AS head FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN CAST(y AS INTEGER) ELSE CAST(y AS INTEGER) + 1 END AS year, CASE WHEN o_orderkey % 4 = 0 THEN 'filename' ELSE 'text' END AS year_source FROM t"""
)
def p05_year(spark, d):
    y = F.date_format("o_orderdate", "yyyy")
    stem = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("doc_"), y, F.lit("_x"))).otherwise("doc")
    head = F.concat(F.lit("Received "), y, F.lit("; accepted "), (F.year("o_orderdate") + 1).cast("string"))
    own = F.regexp_extract(stem, r"_((?:19|20)\d{2})_", 1)
    found = F.filter(F.transform(F.regexp_extract_all(head, F.lit(r"(?i)(?:available online|published online|accepted|received)\D{0,25}((?:19|20)\d{2})\b"), F.lit(1)), lambda x: x.cast("int")), lambda x: x.between(1950, 2030))
    return table(spark, d, "orders").select("o_orderkey", F.when(own != "", own.cast("int")).otherwise(F.array_max(found)).alias("year"), F.when(own != "", "filename").when(F.size(found) > 0, "text").otherwise("").alias("year_source"))


@query(
    """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'human' ELSE c_name END AS title, array_to_string(list_filter([CASE WHEN c_acctbal >= 0 AND c_nationkey < 5 THEN 'title_uncertain' END, CASE WHEN c_custkey % 5 = 0 THEN 'year_missing' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'author_missing' END], lambda x: x IS NOT NULL), ';') AS flags FROM customer"""
)
def p06_metadata_merge(spark, d):
    human = F.when(F.col("c_acctbal") < 0, "human")
    flags = scoring.fail_reasons(title_uncertain=F.col("c_nationkey") < 5, year_missing=F.col("c_custkey") % 5 == 0, author_missing=F.col("c_mktsegment") == "MACHINERY")
    cleared = F.when(human.isNotNull(), F.filter(flags, lambda f: ~f.startswith("title"))).otherwise(flags)
    return table(spark, d, "customer").select("c_custkey", F.coalesce(human, "c_name").alias("title"), F.array_join(cleared, ";").alias("flags"))


@query("WITH " + LINES + ", c AS (SELECT doc_id, ord, text, len(text) AS n FROM lines WHERE ord < 5 AND len(text) >= 20) SELECT doc_id, text AS title FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, ord) AS r FROM c) WHERE r = 1")
def p07_first_page_title(spark, d):
    c = lines(spark, d).where((F.col("ord") < 5) & (F.length("text") >= 20))
    return c.groupBy("doc_id").agg(F.max_by("text", F.struct(F.length("text"), -F.col("ord"))).alias("title"))


MINING = """WITH s AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS n_tokens, position('|' IN text) > 0 AS tab,
  CAST(len(regexp_extract_all(text, '[.]')) AS DOUBLE) / greatest(len(regexp_extract_all(text, '\\S+')), 1) AS density, CAST(len(regexp_extract_all(text, 'th')) AS DOUBLE) / (greatest(len(regexp_extract_all(text, '\\S+')), 1) / 100.0) AS topic FROM documents)
"""


@query(MINING + "SELECT doc_id, CASE WHEN source = 'src7' THEN 'excluded_doc' WHEN tab THEN 'appendix_or_table' WHEN n_tokens < 150 THEN 'too_short' WHEN density < 0.05 THEN 'low_density' WHEN topic < 10.0 THEN 'off_topic' ELSE '' END AS mine_reason FROM s")
def p08_mining_decision(spark, d):
    n = X.n_words("text")
    s = table(spark, d, "documents").select("doc_id", "source", n.cast("long").alias("n_tokens"), F.col("text").contains("|").alias("tab"), (F.regexp_count("text", F.lit("[.]")) / F.greatest(n, F.lit(1))).alias("density"), (F.regexp_count("text", F.lit("th")) / (F.greatest(n, F.lit(1)) / 100)).alias("topic"))
    return s.select("doc_id", scoring.mining_reason(F.col("source") == "src7", F.col("tab"), "n_tokens", "density", "topic", least_density=0.05, least_topic=10.0).alias("mine_reason"))


@query(
    r"""WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents), b AS (SELECT doc_id, source, replace(x, ' ', '') AS b, starts_with(ltrim(x), '|') AS r FROM l),
    s AS (SELECT doc_id, source, sum(CASE WHEN r AND NOT regexp_full_match(b, '[|:-]*') THEN length(b) ELSE 0 END) AS t, sum(length(b)) AS n FROM b GROUP BY doc_id, source)
    SELECT doc_id, source = 'src3' OR doc_id % 10 = 0 OR (n > 0 AND CAST(t AS DOUBLE) / n > 0.6) AS hit FROM s"""
)
def p09_appendix_or_table(spark, d):
    path = F.when(F.col("source") == "src3", F.array(F.lit("Appendix A"), F.lit("x"))).otherwise(F.array(F.lit("Body")))
    kind = F.when(F.col("doc_id") % 10 == 0, "table").otherwise("text")
    rows = table(spark, d, "documents").select("doc_id", path.alias("path"), kind.alias("kind"), "text")
    return rows.select("doc_id", scoring.appendix_or_table("kind", "path", "text").alias("hit"))


@query("WITH " + LINES + ", u AS (SELECT doc_id, count(*) FILTER (len(text) >= 200) AS n FROM lines GROUP BY doc_id) SELECT d.doc_id, CAST(coalesce(u.n, 0) AS BIGINT) AS valid_units, coalesce(u.n, 0) >= 3 AS generate FROM documents d LEFT JOIN u USING (doc_id)")
def p10_usable_chunks(spark, d):
    u = lines(spark, d).groupBy("doc_id").agg(F.count_if(F.length("text") >= 200).alias("n"))
    n = F.coalesce("n", F.lit(0))
    return table(spark, d, "documents").select("doc_id").join(u, "doc_id", "left").select("doc_id", n.alias("valid_units"), (n >= 3).alias("generate"))


JUDGED = "j AS (SELECT qa_id, len(question) % 5 + 1 AS grounding, len(answer) % 3 > 0 AS standalone, CASE WHEN len(answer) % 7 = 0 THEN NULL ELSE len(answer) % 5 + 1 END AS value, len(question) % 11 > 0 AS well_formed FROM pairs)"


def judged(spark, d):
    q, a = F.length("question"), F.length("answer")
    return pairs(spark, d).select("qa_id", (q % 5 + 1).alias("grounding"), (a % 3 > 0).alias("standalone"), F.when(a % 7 != 0, a % 5 + 1).alias("value"), (q % 11 > 0).alias("well_formed"))


@query("WITH " + PAIRS + ", " + JUDGED + " SELECT qa_id, grounding >= 4 AND standalone AND coalesce(value, 5) >= 3 AND well_formed AS passed FROM j")
def p11_pass_rule(spark, d):
    return judged(spark, d).select("qa_id", ((F.col("grounding") >= 4) & F.col("standalone") & (F.coalesce("value", F.lit(5)) >= 3) & F.col("well_formed")).alias("passed"))


FAILS_SQL = "array_to_string(list_filter([CASE WHEN grounding < 4 THEN 'grounding' END, CASE WHEN NOT standalone THEN 'not_standalone' END, CASE WHEN coalesce(value, 5) < 3 THEN 'low_value' END, CASE WHEN NOT well_formed THEN 'garbled_question' END], lambda x: x IS NOT NULL), ';')"


def fails():
    return scoring.fail_reasons(grounding=F.col("grounding") < 4, not_standalone=~F.col("standalone"), low_value=F.coalesce("value", F.lit(5)) < 3, garbled_question=~F.col("well_formed"))


@query("WITH " + PAIRS + ", " + JUDGED + f" SELECT qa_id, {FAILS_SQL} AS reject_reason FROM j")
def p12_fail_reasons(spark, d):
    return judged(spark, d).select("qa_id", F.array_join(fails(), ";").alias("reject_reason"))


@query("WITH " + PAIRS + ", " + JUDGED + " SELECT qa_id, (grounding < 4 OR NOT standalone) AND NOT coalesce(value, 5) < 3 AS repairable FROM j")
def p13_repairable(spark, d):
    return judged(spark, d).select("qa_id", scoring.repairable(fails()).alias("repairable"))


@query(MINING + "SELECT doc_id, density FROM s WHERE abs(density - 0.1) <= 0.02")
def p14_borderline_band(spark, d):
    n = F.greatest(X.n_words("text"), F.lit(1))
    s = table(spark, d, "documents").select("doc_id", (F.regexp_count("text", F.lit("[.]")) / n).alias("density"))
    return scoring.borderline(s, "density", 0.1, 0.02)


@query("WITH " + PAIRS + ", " + JUDGED + " SELECT CAST(count(*) FILTER (grounding = 3 OR value IS NULL) AS BIGINT) AS escalated, CAST(count(*) FILTER (NOT (grounding = 3 OR value IS NULL) AND (grounding >= 4) <> standalone) AS BIGINT) AS missed FROM j")
def p15_escalation(spark, d):
    unsure = (F.col("grounding") == 3) | F.col("value").isNull()
    return judged(spark, d).agg(F.count_if(unsure).alias("escalated"), F.count_if(~unsure & ((F.col("grounding") >= 4) != F.col("standalone"))).alias("missed"))


@query("SELECT event_type AS system, CAST(user_id % 3 AS BIGINT) AS split, event_type IN ('signup', 'purchase') OR user_id % 3 = 2 AS is_new FROM events GROUP BY 1, 2, 3")
def p16_new_cells(spark, d):
    split = F.pmod("user_id", F.lit(3)).cast("long")
    return table(spark, d, "events").select(F.col("event_type").alias("system"), split.alias("split"), (F.col("event_type").isin("signup", "purchase") | (split == 2)).alias("is_new")).distinct()


@query("SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' WHEN 2 THEN 'accept' WHEN 3 THEN 'unknown' ELSE NULL END AS verdict FROM customer")
def p17_verdict_words(spark, d):
    word = F.get(F.array(*[F.lit(w) for w in (" Accept ", "NO", "1", "maybe", "  ")]), (F.col("c_custkey") % 5).cast("int"))
    return table(spark, d, "customer").select("c_custkey", X.verdict_of_text(word).alias("verdict"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS first_pass FROM orders")
def p18_first_pass_view(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.col("o_orderpriority").alias("verdict"))).alias("first_pass"), F.col("o_orderstatus").alias("verdict"))
    return o.select("o_orderkey", F.coalesce("first_pass.verdict", "verdict").alias("first_pass"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'P' THEN 0.5::DOUBLE WHEN 'O' THEN 0.0::DOUBLE END AS score FROM orders")
def p19_verdict_score(spark, d):
    score = F.create_map(F.lit("F"), F.lit(1.0), F.lit("P"), F.lit(0.5), F.lit("O"), F.lit(0.0))
    return table(spark, d, "orders").select("o_orderkey", score[F.col("o_orderstatus")].alias("score"))


@query("WITH s AS (SELECT event_type, max(value) AS mx, count(*) AS n, count(*) FILTER (value > 0) AS pos FROM events GROUP BY event_type) SELECT event_type, mx >= 350 AND pos = n AND n >= 0.19 * (SELECT count(*) FROM events) AS passes FROM s")
def p20_gate(spark, d):
    e = table(spark, d, "events")
    total = e.agg(F.count(F.lit(1)).alias("total"))
    s = e.groupBy("event_type").agg(F.max("value").alias("mx"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 0).alias("pos")).crossJoin(F.broadcast(total))
    return s.select("event_type", ((F.col("mx") >= 350) & (F.col("pos") == F.col("n")) & (F.col("n") >= 0.19 * F.col("total"))).alias("passes"))


@query("SELECT event_type AS judge FROM (SELECT event_type, bool_or(value > 300) AS passes, count(*) AS n, max(value) AS kappa FROM events GROUP BY event_type) ORDER BY passes DESC, n > 10 DESC, kappa DESC, event_type LIMIT 1")
def p21_judge_choice(spark, d):
    j = table(spark, d, "events").groupBy("event_type").agg(F.bool_or(F.col("value") > 300).alias("passes"), F.count(F.lit(1)).alias("n"), F.max("value").alias("kappa"))
    return j.orderBy(F.desc("passes"), F.desc(F.col("n") > 10), F.desc("kappa"), "event_type").limit(1).select(F.col("event_type").alias("judge"))


@query(
    """SELECT p_partkey, '(' || p_name || CASE WHEN len(p) = 0 THEN '' WHEN p[1] = p[len(p)] THEN ', p. ' || p[1] ELSE ', pp. ' || p[1] || '-' || p[len(p)] END || ')' AS citation
    FROM (SELECT p_partkey, p_name, list_sort(list_distinct(list_filter([p_size, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 END, p_size], lambda x: x IS NOT NULL))) AS p FROM part)"""
)
def p22_citation(spark, d):
    pages = F.array(F.col("p_size"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1), F.col("p_size"))
    return table(spark, d, "part").select("p_partkey", X.citation("p_name", pages).alias("citation"))


@query("SELECT p_partkey, replace(p_name || '; ' || p_type, '; ', ': ') AS title FROM part")
def p23_subtitle(spark, d):
    return table(spark, d, "part").select("p_partkey", X.citation_title(F.concat("p_name", F.lit(";  "), "p_type")).alias("title"))


@query("WITH " + PAIRS + " SELECT qa_id, CAST(k AS INTEGER) AS k, CASE k WHEN 0 THEN question WHEN 1 THEN 'Please: ' || question ELSE 'Say: ' || question END AS prompt, answer FROM pairs, range(3) t(k)")
def p24_training_examples(spark, d):
    ps = F.array(F.col("question"), F.concat(F.lit("Please: "), "question"), F.concat(F.lit("Say: "), "question"))
    return pairs(spark, d).select("qa_id", F.posexplode(ps).alias("k", "prompt"), "answer")


@query("WITH " + PAIRS + " SELECT qa_id, '[u1] (' || q_type || ') ' || question || chr(10) || '    evidence: \"' || answer || '\"' AS prompt FROM pairs")
def p25_prompt_lines(spark, d):
    return pairs(spark, d).select("qa_id", F.concat(F.lit("[u1] ("), "q_type", F.lit(") "), "question", F.lit('\n    evidence: "'), "answer", F.lit('"')).alias("prompt"))


@query("WITH " + LINES + ", u AS (SELECT doc_id, ord, text FROM lines WHERE ord IN (0, 2, 4)) SELECT doc_id, string_agg(text, ' … ' ORDER BY ord) AS evidence, list_sort(list_distinct(list(CAST(ord // 2 + 1 AS INTEGER)))) AS pages, CAST(count(*) AS BIGINT) AS n_units FROM u GROUP BY doc_id")
def p26_rows_from_units(spark, d):
    units = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(4))).alias("ord"))
    used = units.join(lines(spark, d), ["doc_id", "ord"])
    got = used.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("u"))
    return got.select("doc_id", F.array_join(F.transform("u", lambda x: x["text"]), " … ").alias("evidence"), F.array_sort(F.array_distinct(F.transform("u", lambda x: F.floor(x["ord"] / 2).cast("int") + 1))).alias("pages"), F.size("u").cast("long").alias("n_units"))


@query("WITH " + PAIRS + " SELECT qa_id, CASE WHEN conv_id % 13 = 0 THEN 'error' WHEN len(answer) % 3 = 0 THEN 'not_equivalent' WHEN qa_id % 5 = 0 THEN 'banned_phrase' WHEN conv_id % 7 = 0 THEN 'same_wording' ELSE 'kept' END AS outcome FROM pairs")
def p27_keep_or_drop(spark, d):
    para = F.when(F.col("qa_id") % 5 == 0, F.concat(F.lit("What does the evidence say: "), "question")).when(F.col("conv_id") % 7 == 0, F.concat(F.lit(" "), "question", F.lit(" "))).otherwise(F.concat(F.lit("Tell me: "), "question"))
    p = pairs(spark, d).withColumn("para", para)
    out = F.when(F.col("conv_id") % 13 == 0, "error").when(F.length("answer") % 3 == 0, "not_equivalent").when(scoring.banned("para").isNotNull() & (F.col("qa_id") % 5 == 0), "banned_phrase").when(F.lower(F.trim("para")) == F.lower(F.trim("question")), "same_wording").otherwise("kept")
    return p.select("qa_id", out.alias("outcome"))


@query("WITH " + LINES + r""", e AS (SELECT doc_id, text AS ev FROM lines WHERE ord = 1)
    SELECT e.doc_id, len(w(ev)) >= 20 AND contains(w(d.text), w(ev)) AS valid, regexp_matches(w(ev), '[.!?]["”’'')\]]*(?:\s*\[\d+(?:\s*[,–-]\s*\d+)*\])?$') AS complete FROM e JOIN documents d USING (doc_id)""".replace("w(ev)", r"trim(regexp_replace(ev, '\s+', ' ', 'g'))").replace("w(d.text)", r"trim(regexp_replace(d.text, '\s+', ' ', 'g'))"))
def p28_evidence_rules(spark, d):
    e = lines(spark, d).where("ord = 1").select("doc_id", F.col("text").alias("ev"))
    rows = e.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", ((F.length(X.ws("ev")) >= 20) & X.ws("text").contains(X.ws("ev"))).alias("valid"), X.is_complete_sentence("ev").alias("complete"))


@query("WITH " + LINES + ", e AS (SELECT doc_id, substr(text, 1, 30) AS ev FROM lines WHERE ord = 3) SELECT doc_id, min(CAST(ord // 2 + 1 AS BIGINT)) AS page FROM e JOIN lines l USING (doc_id) WHERE contains(l.text, ev) GROUP BY doc_id")
def p29_page_of_evidence(spark, d):
    ls = lines(spark, d)
    e = ls.where("ord = 3").select("doc_id", F.substring("text", 1, 30).alias("ev"))
    hit = e.join(ls, "doc_id").where(F.col("text").contains(F.col("ev")))
    return hit.groupBy("doc_id").agg(F.min_by(F.floor(F.col("ord") / 2).cast("long") + 1, "ord").alias("page"))


# ---- windows of words and sentences


@query(r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w FROM documents) SELECT doc_id, CAST(i AS INTEGER) AS i, array_to_string(w[i * 350 + 1 : i * 350 + 400], ' ') AS win FROM w, LATERAL (SELECT unnest(range((greatest(len(w), 1) - 1) // 350 + 1)) AS i)")
def c18_word_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.word_windows("text")).alias("i", "win"))


LOOSE = r"""list_filter(string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1)), lambda x: length(trim(x)) > 0)"""
WORDS_OF = "len(regexp_extract_all({}, '\\S+'))"


@query(
    "WITH RECURSIVE s AS (SELECT doc_id, text, " + WORDS_OF.format("text") + " <= 120 AS fits, " + LOOSE + " AS s FROM documents), e AS (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM s WHERE NOT fits), z AS (SELECT *, " + WORDS_OF.format("x") + " AS n, lag(" + WORDS_OF.format("x") + ") OVER (PARTITION BY doc_id ORDER BY i) AS b FROM e), "
    "w AS (SELECT doc_id, i, n AS size, CAST(1 AS BIGINT) AS start, 0 AS win FROM z WHERE i = 1 UNION ALL SELECT z.doc_id, z.i, CASE WHEN size + z.n > 120 THEN z.b + z.n ELSE size + z.n END, CASE WHEN size + z.n > 120 THEN z.i - 1 ELSE start END, win + CASE WHEN size + z.n > 120 THEN 1 ELSE 0 END FROM w JOIN z ON z.doc_id = w.doc_id AND z.i = w.i + 1), "
    "k AS (SELECT doc_id, win, any_value(start) AS a, max(i) AS b FROM w GROUP BY ALL) SELECT doc_id, win AS i, array_to_string(s[a:b], ' ') AS win FROM k JOIN s USING (doc_id) UNION ALL SELECT doc_id, 0, text FROM s WHERE fits"
)
def c17_sentence_windows(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentence_windows("text", 120)).alias("i", "win"))


@query("WITH s AS (SELECT doc_id, " + SENTENCES + " AS s FROM documents), n AS (SELECT doc_id, s, list_reverse(list_transform(s, lambda x: " + WORDS_OF.format("x") + ")) AS n FROM s), k AS (SELECT doc_id, s, len(list_filter(range(1, least(len(n), 41) + 1), lambda i: list_sum(n[1:i]) <= 40)) AS k FROM n) SELECT doc_id, CASE WHEN k > 0 THEN array_to_string(s[len(s) - k + 1:], ' ') ELSE '' END AS tail FROM k")
def c14_tail_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", chunking.tail_sentences("text", 40).alias("tail"))
