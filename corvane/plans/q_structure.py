"""Queries of the single steps of the cleaner and the packer, over an outline made of the documents' lines."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import chunking as K
from ..operators import structure as C
from .q_text import SENTENCES
from .registry import query
from .stand_ins import LINES, lines, table


def outline(spark, d):
    """Lines of documents as layout items: every seventh is a heading (one in six is followed by another), with the numbering style that the document's number tells."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")) - 1
    o = lines(spark, d).select("doc_id", n.cast("long").alias("ord"), F.col("text").alias("t")).withColumn("k", F.expr("ord div 42 + 1")).withColumn("m", F.col("ord") % 42)
    heading = (F.col("ord") % 7 == 0) | (F.col("m") == 1)
    label = F.when(heading, "section_header").when(F.col("ord") % 7 == 5, "list_item").when(F.col("ord") % 14 == 3, "footnote").otherwise("text")
    k, style = F.col("k").cast("string"), F.col("doc_id") % 4
    first = F.when(style == 0, F.concat(F.lit("Chapter "), k)).when(style == 1, F.concat(k, F.lit(" Part"))).when(style == 2, F.lit("Of a part")).otherwise(F.concat((F.col("k") % 2 + 1).cast("string"), F.lit(" Piece")))
    texts: list[tuple[int, Column]] = [
        (0, first), (1, F.lit("Of things")), (7, F.when(style == 3, F.concat((F.col("k") % 2 + 2).cast("string"), F.lit(" Thing"))).otherwise(F.concat(k, F.lit(".1 Piece")))),
        (14, F.concat(k, F.lit(".2.1 Bit"))), (21, F.lit("References")), (28, F.concat(F.lit("Table "), k, F.lit(".2 of it"))), (35, F.lit("(Smith, 2020).")),
    ]
    line = F.when(F.col("ord") % 7 == 1, F.regexp_replace("t", "[.!?:;]+$", "")).when(F.col("ord") % 7 == 2, F.lower("t")).otherwise(F.col("t"))
    text = F.coalesce(*[F.when(F.col("m") == m, c) for m, c in texts], line)
    return o.select("doc_id", "ord", label.alias("label"), text.alias("text"), F.expr("ord div 10 + 1").alias("page"))


OUTLINE = (
    LINES
    + r""", o0 AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS BIGINT) AS ord, text AS t FROM lines), o1 AS (SELECT *, ord // 42 + 1 AS k, ord % 42 AS m FROM o0),
outline AS (SELECT doc_id, ord, CASE WHEN ord % 7 = 0 OR m = 1 THEN 'section_header' WHEN ord % 7 = 5 THEN 'list_item' WHEN ord % 14 = 3 THEN 'footnote' ELSE 'text' END AS label,
  CASE m WHEN 0 THEN CASE doc_id % 4 WHEN 0 THEN 'Chapter ' || k WHEN 1 THEN k || ' Part' WHEN 2 THEN 'Of a part' ELSE (k % 2 + 1) || ' Piece' END WHEN 1 THEN 'Of things' WHEN 7 THEN CASE WHEN doc_id % 4 = 3 THEN (k % 2 + 2) || ' Thing' ELSE k || '.1 Piece' END
    WHEN 14 THEN k || '.2.1 Bit' WHEN 21 THEN 'References' WHEN 28 THEN 'Table ' || k || '.2 of it' WHEN 35 THEN '(Smith, 2020).'
    ELSE CASE ord % 7 WHEN 1 THEN regexp_replace(t, '[.!?:;]+$', '') WHEN 2 THEN lower(t) ELSE t END END AS text, ord // 10 + 1 AS page FROM o1)"""
)
KINDS_OF_OUTLINE = r""", kinds AS (SELECT *, CASE WHEN label = 'list_item' THEN 'list' WHEN label <> 'section_header' THEN 'paragraph' WHEN regexp_matches(text, '^(?i:table|figure|fig\.)\s*(\d+|[A-Z]\d*)(\.\d+)*\b') THEN 'caption'
  WHEN regexp_matches(text, '^\[|^\(.*\d{4}[a-z]?\)\.?$') OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0 THEN 'paragraph' ELSE 'heading' END AS kind FROM outline)"""
SKIPS = "(" + " OR ".join(f"regexp_matches(text, '(?i)^{rx}$')" for _, rx in X.SKIP_HEADINGS) + ")"
NUMBERS = r""", nums AS (SELECT *, CASE WHEN kind = 'heading' THEN nullif(regexp_extract(text, '^((?:\d+\.)*\d+)\.?\s+\S', 1), '') END AS no FROM kinds),
heads AS (SELECT *, len(string_split(no, '.')) AS parts, CAST(split_part(no, '.', 1) AS INTEGER) AS lead, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS place FROM nums)"""
STARTS = (
    NUMBERS
    + rf""", a AS (SELECT *, CASE WHEN parts = 1 THEN lead END AS first, CASE WHEN parts = 2 AND split_part(no, '.', 2) = '1' THEN lead END AS one, CASE WHEN parts > 1 THEN lead END AS deeper FROM heads),
b AS (SELECT *, last_value(first IGNORE NULLS) OVER w AS first_before, last_value(deeper IGNORE NULLS) OVER w AS deeper_before,
  last_value(CASE WHEN kind <> 'heading' THEN NULL WHEN no IS NOT NULL OR {SKIPS} THEN 0 WHEN regexp_matches(text, '(?i)^(abstract|introduction|highlights|contents|preface|keywords)$') THEN NULL ELSE place END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS title
  FROM a WINDOW w AS (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
style AS (SELECT doc_id, coalesce(bool_or(first < first_before), FALSE) AS falls, count(one) AS ones, count(*) FILTER (one = first_before) AS under FROM b GROUP BY doc_id),
c AS (SELECT *, ones > 0 AND 2 * under >= ones AND NOT falls AS titled FROM b JOIN style USING (doc_id)),
opens AS (SELECT DISTINCT doc_id, CASE WHEN coalesce(title, 0) > 0 THEN title ELSE place END AS place FROM c WHERE (falls AND first IS NOT NULL AND (first_before IS NULL OR first < first_before)) OR (NOT titled AND NOT falls AND one IS NOT NULL AND lead IS DISTINCT FROM deeper_before)),
starts AS (SELECT c.*, kind = 'heading' AND (regexp_matches(text, '(?i)^(chapter|part)\s+(\d+|[ivxlc]+)\b\.?') OR (titled AND first IS NOT NULL) OR opens.place IS NOT NULL) AS chapter FROM c LEFT JOIN opens USING (doc_id, place))"""
)


@query("WITH " + OUTLINE + r", n AS (SELECT *, label = 'section_header' AND regexp_matches(trim(text), '(?i)^(chapter|part)\s+(\d+|[ivxlc]+)\b\.?$') AS bare FROM outline), l AS (SELECT *, lead(CASE WHEN label = 'section_header' THEN trim(text) END) OVER w AS title, lag(bare) OVER w AS after FROM n WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, ord, CASE WHEN bare AND title IS NOT NULL THEN trim(text) || ': ' || title ELSE text END AS text FROM l WHERE NOT coalesce(after AND label = 'section_header', FALSE)")
def c03_chapters_with_titles(spark, d):
    return C.chapters_with_titles(outline(spark, d)).select("doc_id", "ord", "text")


@query("WITH " + OUTLINE + KINDS_OF_OUTLINE + " SELECT doc_id, ord, kind FROM kinds")
def c04_kinds(spark, d):
    return kinds(spark, d).select("doc_id", "ord", "kind")


def kinds(spark, d):
    return C.kinds(outline(spark, d).withColumn("folder", F.lit("book")))


BETWEEN = r"(label = 'footnote' OR kind = 'caption' AND label = 'caption' OR (length(text) < 250 AND (regexp_matches(text, '(?i)^(received|accepted|revised|available online|e-?mail|corresponding author)|https?://doi\.org|creativecommons|open access article|peer review under|journal homepage|contents lists available') OR regexp_matches(text, '(?i)all rights reserved|library of congress|\bisbn\b|©.{0,80}(publish|springer|elsevier|routledge|press|wiley|taylor)'))) OR regexp_matches(text, '(?i)^\s*(page\s*)?(\d{1,4}|[ivxlcdm]{1,7})\s*$'))"


@query(
    "WITH " + OUTLINE + KINDS_OF_OUTLINE
    + rf""", f AS (SELECT *, label = 'text' AND regexp_matches(text, '^[a-z]') AS goes_on FROM kinds), g AS (SELECT *, {BETWEEN} AND NOT goes_on AND kind <> 'heading' AS betw FROM f),
h AS (SELECT *, sum(CAST(betw AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM g),
i AS (SELECT *, last_value(CASE WHEN NOT betw THEN {{'open': label = 'text' AND kind = 'paragraph' AND NOT regexp_matches(text, '[.!?:;"”)\]]$'), 'n': n}} END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM h),
j AS (SELECT *, coalesce(goes_on AND s.open AND n - s.n <= 3, FALSE) AS joins FROM i), k AS (SELECT *, CASE WHEN joins THEN last_value(CASE WHEN NOT betw AND NOT joins THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) ELSE ord END AS start FROM j),
l AS (SELECT *, lead(ord) OVER (PARTITION BY doc_id, start ORDER BY ord) IS NULL AS ends FROM k)
SELECT doc_id, start AS ord, string_agg(CASE WHEN ends THEN text WHEN ends_with(text, '-') THEN left(text, -1) ELSE text || ' ' END, '' ORDER BY l.ord) AS text, arg_max(page, l.ord) AS page_end FROM l GROUP BY doc_id, start"""
)
def c05_rejoined(spark, d):
    return C.rejoined(kinds(spark, d)).select("doc_id", "ord", "text", "page_end")


@query("WITH " + OUTLINE + KINDS_OF_OUTLINE + STARTS + " SELECT doc_id, ord, text FROM starts WHERE chapter")
def c06_chapter_starts(spark, d):
    return C.chapter_starts(kinds(spark, d)).where("chapter").select("doc_id", "ord", "text")


UPPER = "(upper(text) = text AND length(regexp_replace(text, '[^A-Za-z]', '', 'g')) >= 4)"
LEVELS = (
    STARTS
    + rf""", lv0 AS (SELECT *, CAST(max(CAST(chapter AS INT)) OVER d AS INT) AS base, max(CAST(no IS NOT NULL AS INT)) OVER d = 1 AS numbered, CAST(max(CAST(kind = 'heading' AND {UPPER} AS INT)) OVER d AS INT) AS capitals, sum(CAST(chapter AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS chapter_no FROM starts WINDOW d AS (PARTITION BY doc_id)),
lv1 AS (SELECT *, coalesce(last_value(CASE WHEN chapter THEN CASE WHEN parts = 1 THEN 0 ELSE base END END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord), base) AS below FROM lv0),
lv2 AS (SELECT *, CASE WHEN NOT chapter AND no IS NOT NULL THEN greatest(below + parts, base + 1) END AS by_number FROM lv1),
levels AS (SELECT *, CASE WHEN kind <> 'heading' THEN 0 WHEN chapter THEN 1 WHEN by_number IS NOT NULL THEN least(by_number, 12) WHEN numbered AND {SKIPS} THEN base + 1
  ELSE coalesce(last_value(by_number IGNORE NULLS) OVER (PARTITION BY doc_id, chapter_no ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, base + 1 + CASE WHEN numbered OR {UPPER} THEN 0 ELSE capitals END) END AS level FROM lv2)"""
)


@query("WITH " + OUTLINE + KINDS_OF_OUTLINE + LEVELS + " SELECT doc_id, ord, CAST(level AS INTEGER) AS level FROM levels WHERE kind = 'heading'")
def c07_heading_levels(spark, d):
    return leveled(spark, d).where("kind = 'heading'").select("doc_id", "ord", "level")


def leveled(spark, d):
    return C.heading_levels(C.chapter_starts(kinds(spark, d)))


@query("WITH " + OUTLINE + KINDS_OF_OUTLINE + LEVELS + ", h AS (SELECT doc_id, ord, text, level, lead(ord) OVER (PARTITION BY doc_id ORDER BY ord) AS nxt FROM levels WHERE level > 0), e AS (SELECT a.doc_id, a.ord, a.text, a.level, coalesce(min(b.ord), 1000000000) AS until FROM h a LEFT JOIN h b ON b.doc_id = a.doc_id AND b.ord > a.ord AND b.level <= a.level GROUP BY ALL) SELECT l.doc_id, l.ord, coalesce(string_agg(e.text, ' > ' ORDER BY e.level), '') AS path FROM levels l LEFT JOIN e ON e.doc_id = l.doc_id AND e.ord <= l.ord AND l.ord < e.until GROUP BY l.doc_id, l.ord")
def c08_section_paths(spark, d):
    return C.section_paths(leveled(spark, d)).select("doc_id", "ord", F.array_join("section_path", " > ").alias("path"))


@query(
    "WITH " + OUTLINE + KINDS_OF_OUTLINE + LEVELS
    + rf""", o AS (SELECT *, kind = 'heading' AND {SKIPS} AS opens FROM levels), r AS (SELECT *, last_value(CASE WHEN opens THEN ord END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS region FROM o),
x AS (SELECT doc_id, region, min(ord) AS until FROM r WHERE region IS NOT NULL AND kind = 'heading' AND NOT opens AND length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) > 1 GROUP BY ALL)
SELECT doc_id, ord, CASE WHEN region IS NOT NULL AND ord < coalesce(until, 1000000000) THEN 'references' WHEN label = 'footnote' THEN 'footnote' ELSE '' END AS skip_reason FROM r LEFT JOIN x USING (doc_id, region)"""
)
def c09_skipped_regions(spark, d):
    """Every region of the outline is one of references; pages are left out, so that no block counts as front matter or index."""
    rows = leveled(spark, d).withColumns({"n_pages": F.lit(1), "page": F.lit(None).cast("long")})
    return C.skipped_regions(rows).select("doc_id", "ord", "skip_reason")


N_WORDS = "len(regexp_extract_all({}, '\\S+'))"


@query("WITH RECURSIVE s AS (SELECT doc_id, " + SENTENCES + " AS s FROM documents WHERE " + N_WORDS.format("text") + " > 130), e AS (SELECT doc_id, unnest(s) AS x, unnest(range(1, len(s) + 1)) AS i FROM s), z AS (SELECT *, " + N_WORDS.format("x") + " AS n FROM e), w AS (SELECT doc_id, i, x, n AS filled, 0 AS part FROM z WHERE i = 1 UNION ALL SELECT z.doc_id, z.i, z.x, CASE WHEN filled > 0 AND filled + z.n > 100 THEN z.n ELSE filled + z.n END, part + CASE WHEN filled > 0 AND filled + z.n > 100 THEN 1 ELSE 0 END FROM w JOIN z ON z.doc_id = w.doc_id AND z.i = w.i + 1) SELECT doc_id, part AS piece, string_agg(x, ' ' ORDER BY i) AS text FROM w GROUP BY doc_id, part")
def c13_split_paragraphs(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.lit("paragraph").alias("type"), "text")
    return K.split_long(rows, K.Sizes(50, 100, 130, 12, 40)).where("split").select("doc_id", "piece", "text")


@query("WITH c AS (SELECT user_id AS doc_id, event_id AS chunk, event_id * 7 % 60 AS size, event_id % 5 = 0 AS alone FROM events), w AS (SELECT *, lead(chunk) OVER o IS NULL AS is_last, lag(chunk) OVER o AS b, lag(size) OVER o AS bs, lag(alone) OVER o AS ba FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY chunk)) SELECT doc_id, chunk, size, CASE WHEN is_last AND NOT alone AND NOT ba AND size < 12.5 AND bs + size <= 55 THEN b ELSE chunk END AS target FROM w")
def c15_folded_tails(spark, d):
    c = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("group"), F.col("event_id").alias("chunk"), (F.col("event_id") * 7 % 60).alias("size"), (F.col("event_id") % 5 == 0).alias("alone"))
    return K.fold_tails(c, K.Sizes(25, 50, 55, 5, 20)).select("doc_id", "chunk", "size", "target")


@query("WITH " + OUTLINE + " SELECT doc_id, ord, (SELECT max(p.ord) FROM outline p WHERE p.doc_id = o.doc_id AND p.ord BETWEEN o.ord - 4 AND o.ord - 1 AND p.label = 'text') AS before FROM outline o WHERE label = 'footnote'")
def w13_bounded_look_back(spark, d):
    back = F.last(F.when(F.col("label") == "text", F.col("ord")), ignorenulls=True).over(C.in_order(-4, -1))
    return outline(spark, d).withColumn("before", back).where("label = 'footnote'").select("doc_id", "ord", "before")
