"""All queries of the core and their SQL. Tables are read as distinct rows: deliveries may be repeated."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import text as X
from lexloom.operators import blocks as B
from lexloom.operators import images as I
from lexloom.operators import localize as L
from lexloom.operators import progress as P
from lexloom.operators import quality as Q
from lexloom.operators import rasters as R
from lexloom.operators import shapes as S
from lexloom.operators import words as W
from lexloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The glossary of the queries: source terms and their preferred translations.
GLOSSARY = [
    ("pilot phase", "Pilotphase"), ("night shift", "Nachtschicht"), ("data model", "Datenmodell"), ("Kühlanlage", "cooling system"), ("Recyclingquote", "recycling quota"),
    ("annual budget", "Jahresbudget"), ("phase", "Abschnitt"), ("web portal", "Webportal"),
]
BATCH = 16
_NOT_BLANK = r"'[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]'"
_TERMS = ", ".join(f"('{t}', '{p}')" for t, p in GLOSSARY)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, name: str, *columns: Any) -> DataFrame:
    """The distinct rows of the named columns, which hold the table's key; only they are read and shuffled."""
    return table(spark, sf_dir, name).select(*columns).distinct()


def layout(*fields: str) -> Column:
    """The block's layout with these fields only, so that no others are read."""
    return F.when(F.col("layout").isNotNull(), F.struct(*(F.col(f"layout.{f}").alias(f) for f in fields))).alias("layout")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# Blocks


@query(f"SELECT DISTINCT doc_id, ord, id, type, source_text FROM blocks WHERE translatable AND regexp_matches(source_text, {_NOT_BLANK})")
def translatable_blocks(spark, d):
    return B.translatable(rows(spark, d, "blocks", "doc_id", "ord", "id", "type", "source_text", "translatable")).drop("translatable")


@query("""
WITH b AS (SELECT DISTINCT doc_id, ord, id, coalesce(layout.slide_index, 0) AS slide, semantic_role,
             coalesce(type <> 'image' AND layout IS NOT NULL AND semantic_role IS NULL AND layout.position.y < 914400, false) AS zone FROM blocks),
e AS (SELECT *, coalesce(sum((zone OR coalesce(semantic_role = 'title', false))::INT) OVER (PARTITION BY doc_id, slide ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
SELECT doc_id, id, slide, CASE WHEN zone AND before = 0 THEN 'title' ELSE semantic_role END AS role FROM e""")
def block_roles(spark, d):
    b = rows(spark, d, "blocks", "doc_id", "ord", "id", "type", "semantic_role", layout("slide_index", "position"))
    return B.with_roles(b).select("doc_id", "id", "slide", "role")


@query(f"""
WITH b AS (SELECT DISTINCT doc_id, coalesce(layout.slide_index, 0) AS slide, ord, source_text FROM blocks WHERE translatable AND regexp_matches(source_text, {_NOT_BLANK}))
SELECT doc_id, slide, left(string_agg(source_text, ' / ' ORDER BY ord), 1200) AS context FROM b GROUP BY ALL""")
def slide_context(spark, d):
    return B.slide_context(rows(spark, d, "blocks", "doc_id", "ord", "translatable", "source_text", layout("slide_index")))


@query(f"""
SELECT DISTINCT doc_id, id, term, preferred, (instr(lower(source_text), lower(term)) - 1)::INT AS start, (instr(lower(source_text), lower(term)) - 1 + length(term))::INT AS "end"
FROM blocks, (VALUES {_TERMS}) g(term, preferred) WHERE instr(lower(source_text), lower(term)) > 0""")
def glossary_hits(spark, d):
    return B.glossary_hits(rows(spark, d, "blocks", "doc_id", "id", "source_text"), GLOSSARY)


@query(f"""
WITH b AS (SELECT DISTINCT doc_id, coalesce(layout.slide_index, 0) AS slide, source_text FROM blocks WHERE translatable AND regexp_matches(source_text, {_NOT_BLANK})),
h AS (SELECT DISTINCT doc_id, slide, term FROM b, (VALUES {_TERMS}) g(term, preferred) WHERE instr(lower(source_text), lower(term)) > 0)
SELECT doc_id, slide, string_agg(term, '|' ORDER BY term) AS terms FROM h GROUP BY ALL""")
def slide_glossary(spark, d):
    return B.slide_glossary(rows(spark, d, "blocks", "doc_id", "id", "translatable", "source_text", layout("slide_index")), GLOSSARY)


def _replaced(c: str) -> str:
    for t, p in GLOSSARY:
        c = f"replace({c}, '{t}', '{p}')"
    return c


@query(f"SELECT DISTINCT b.doc_id, b.id, '[' || target_lang || '] ' || {_replaced('source_text')} AS target FROM blocks b JOIN doc_meta USING (doc_id)")
def pseudo_translations(spark, d):
    b = rows(spark, d, "blocks", "doc_id", "id", "source_text").join(table(spark, d, "doc_meta").select("doc_id", "target_lang"), "doc_id")
    return b.select("doc_id", "id", X.pseudo_translation(F.col("source_text"), F.col("target_lang"), GLOSSARY).alias("target"))


@query("""
WITH b AS (SELECT DISTINCT doc_id, id, layout.position AS p, coalesce(nullif(runs[1].font.size, 0), nullif(layout.base_font.size, 0), 18.0) AS size FROM blocks)
SELECT doc_id, id, CASE WHEN p IS NOT NULL AND size > 0 THEN greatest(1, floor(p.w / 12700 / (size * 0.55))::BIGINT) * greatest(1, floor(p.h / 12700 / (size * 1.2))::BIGINT) END AS chars FROM b""")
def layout_limits(spark, d):
    return rows(spark, d, "blocks", "doc_id", "id", B.max_chars().alias("chars"))


@query(f"""
WITH b AS (SELECT DISTINCT doc_id, id, ord FROM blocks WHERE translatable AND regexp_matches(source_text, {_NOT_BLANK}))
SELECT doc_id, id, ord, ((row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1) // {BATCH})::BIGINT AS batch FROM b""")
def engine_batches(spark, d):
    return B.batches(rows(spark, d, "blocks", "doc_id", "id", "ord", "translatable", "source_text"), BATCH)


@query("SELECT DISTINCT doc_id, id FROM blocks WHERE target_text IS NULL OR target_text = source_text")
def unchanged_blocks(spark, d):
    return table(spark, d, "blocks").where("target_text is null or target_text = source_text").select("doc_id", "id").distinct()


@query("SELECT doc_id, count(DISTINCT id) AS blocks, count(DISTINCT CASE WHEN target_text IS NOT NULL THEN id END) AS translated, count(DISTINCT CASE WHEN type = 'image' THEN id END) AS pictures FROM blocks GROUP BY doc_id")
def block_counts(spark, d):
    b = rows(spark, d, "blocks", "doc_id", "id", "target_text", "type")
    return b.groupBy("doc_id").agg(
        F.count_distinct("id").alias("blocks"), F.count_distinct(F.when(F.col("target_text").isNotNull(), F.col("id"))).alias("translated"), F.count_distinct(F.when(F.col("type") == "image", F.col("id"))).alias("pictures")
    )


@query("SELECT DISTINCT doc_id, id, sha256(source_text) AS hash FROM blocks")
def text_hashes(spark, d):
    return rows(spark, d, "blocks", "doc_id", "id", F.sha2("source_text", 256).alias("hash"))


@query()
def normal_forms(spark, d):
    """Block texts in compatibility form, case-folded, letters and digits only."""
    return rows(spark, d, "blocks", "doc_id", "id", "source_text").select("doc_id", "id", X.norm_text("source_text").alias("form"))


_FITS = """CASE {1} WHEN 'zh' THEN regexp_matches({0}, '[\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]')
  WHEN 'en' THEN regexp_matches({0}, '[A-Za-z]') WHEN 'de' THEN regexp_matches({0}, '[A-Za-z]') ELSE regexp_matches({0}, """ + _NOT_BLANK.replace("{", "{{").replace("}", "}}") + ") END"


@query(f"""
WITH b AS (SELECT DISTINCT b.doc_id, coalesce(layout.slide_index, 0) AS slide, id, source_text AS s, layout.position AS p, source_lang, target_lang,
  lower(regexp_replace(target_text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS tk, lower(regexp_replace(source_text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS sk FROM blocks b JOIN doc_meta USING (doc_id) WHERE layout.position IS NOT NULL),
j AS (SELECT l.doc_id, l.id, r.id AS other_id, greatest(0, least(l.p.x + l.p.w, r.p.x + r.p.w) - greatest(l.p.x, r.p.x)) AS ox, greatest(0, greatest(l.p.x, r.p.x) - least(l.p.x + l.p.w, r.p.x + r.p.w)) AS gx,
  greatest(0, least(l.p.y + l.p.h, r.p.y + r.p.h) - greatest(l.p.y, r.p.y)) AS oy, greatest(0, greatest(l.p.y, r.p.y) - least(l.p.y + l.p.h, r.p.y + r.p.h)) AS gy, l.p AS a, r.p AS b
  FROM b l JOIN b r ON l.doc_id = r.doc_id AND l.slide = r.slide AND l.tk = r.sk AND l.id <> r.id WHERE l.tk <> '' AND l.tk <> l.sk AND {_FITS.format("l.s", "l.source_lang")} AND {_FITS.format("r.s", "r.target_lang")})
SELECT DISTINCT doc_id, id, other_id FROM j WHERE (oy >= 0.5 * least(a.h, b.h) AND gx <= 0.5 * greatest(a.w, b.w)) OR (ox >= 0.5 * least(a.w, b.w) AND gy <= 0.5 * greatest(a.h, b.h))""")
def bilingual_pairs(spark, d):
    """Blocks whose translation already stands beside them."""
    return B.bilingual_pairs(rows(spark, d, "blocks", "doc_id", "ord", "id", "source_text", "target_text", layout("slide_index", "position")), table(spark, d, "doc_meta"))


@query()
def bilingual_suppression(spark, d):
    """Targets after the bilingual pass in the languages of each document, slide by slide."""
    languages = table(spark, d, "doc_meta").select("doc_id", "source_lang", "target_lang")
    return B.suppress_bilingual(rows(spark, d, "blocks", "doc_id", "ord", "id", "source_text", "target_text", "source_ref", layout("slide_index", "position")).join(languages, "doc_id", "left"), F.col("source_lang"), F.col("target_lang"))


@query("""
SELECT DISTINCT b.doc_id, b.id, CASE source_lang WHEN 'zh' THEN regexp_matches(source_text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]')
  WHEN 'en' THEN regexp_matches(source_text, '[A-Za-z]') WHEN 'de' THEN regexp_matches(source_text, '[A-Za-z]') ELSE regexp_matches(source_text, """ + _NOT_BLANK + """) END AS fits
FROM blocks b JOIN doc_meta USING (doc_id)""")
def script_fits(spark, d):
    b = rows(spark, d, "blocks", "doc_id", "id", "source_text").join(table(spark, d, "doc_meta").select("doc_id", "source_lang"), "doc_id")
    return b.select("doc_id", "id", X.looks_like(F.col("source_text"), F.col("source_lang")).alias("fits"))


@query("""
SELECT DISTINCT doc_id, b.id, r.i - 1 AS run_idx, runs[r.i].text AS text, runs[r.i].font.size AS size, coalesce(runs[r.i].font.bold, false) AS bold
FROM (SELECT DISTINCT doc_id, id, runs FROM blocks) b, LATERAL (SELECT unnest(range(1, len(runs) + 1)) AS i) r""")
def runs(spark, d):
    r = rows(spark, d, "blocks", "doc_id", "id", "runs").select("doc_id", "id", F.posexplode("runs").alias("run_idx", "r"))
    return r.select("doc_id", "id", F.col("run_idx").cast("long"), F.col("r.text").alias("text"), F.col("r.font.size").alias("size"), F.coalesce("r.font.bold", F.lit(False)).alias("bold")).distinct()


# Images and regions


@query("""
WITH b AS (SELECT doc_id, id, min_by(layout.position, ord) AS p FROM (SELECT DISTINCT doc_id, id, ord, layout FROM blocks) GROUP BY ALL),
i AS (SELECT DISTINCT doc_id, id FROM images),
r AS (SELECT i.doc_id, i.id, p.w::DOUBLE * p.h / (nullif(slide_width, 0)::DOUBLE * nullif(slide_height, 0)) AS ratio FROM i LEFT JOIN b USING (doc_id, id) LEFT JOIN doc_meta USING (doc_id))
SELECT doc_id, id, floor(ratio * 1000000 + 0.5) / 1000000.0 AS ratio FROM r""")
def display_ratios(spark, d):
    return I.display_ratio(rows(spark, d, "images", "doc_id", "id"), rows(spark, d, "blocks", "doc_id", "id", "ord", layout("position")), table(spark, d, "doc_meta"))


_ORDERED = """
WITH s AS (SELECT DISTINCT s.*, i.ord, i.width::BIGINT AS width, i.height::BIGINT AS height FROM (SELECT DISTINCT * FROM selections) s
  JOIN (SELECT DISTINCT doc_id, id AS image_id, ord, width, height FROM images) i USING (doc_id, image_id))"""


@query(_ORDERED + """,
n AS (SELECT doc_id, image_id, first_value(image_id) OVER w AS first_id, row_number() OVER w AS n FROM s WHERE content_hash IS NOT NULL WINDOW w AS (PARTITION BY doc_id, content_hash ORDER BY ord, image_id))
SELECT doc_id, image_id, first_id FROM n WHERE n > 1""")
def exact_duplicates(spark, d):
    return I.exact_duplicates(rows(spark, d, "selections", "doc_id", "image_id", "content_hash"), rows(spark, d, "images", "doc_id", "id", "ord"))


_ROUTES = _ORDERED + """,
m AS (SELECT *, content_hash IS NOT NULL AND row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY ord, image_id) > 1 AS repeated FROM s),
k AS (SELECT doc_id, image_id, CASE WHEN repeated THEN 0 WHEN width < 120 OR height < 60 OR width * height < 20000 THEN 1
  WHEN text_chars IS NULL OR alpha_chars IS NULL OR word_count IS NULL OR meaningful_word_count IS NULL OR lexical_word_ratio IS NULL OR line_count IS NULL OR mean_confidence IS NULL THEN 11
  WHEN text_chars < 6 OR alpha_chars < 6 THEN 2
  WHEN mean_confidence < 45 THEN 3 WHEN word_count >= 10 AND lexical_word_ratio < 0.26 THEN 4 WHEN display_area_ratio < 0.025 AND text_chars <= 24 THEN 5 WHEN display_area_ratio < 0.025 THEN 6
  WHEN mean_confidence < 60 AND word_count >= 3 THEN 7 WHEN display_area_ratio IS NOT NULL AND meaningful_word_count <= 2 AND text_chars <= 24 THEN 8
  WHEN alpha_chars >= 30 AND meaningful_word_count >= 8 AND line_count >= 2 AND lexical_word_ratio >= 0.30 AND (display_area_ratio IS NULL OR display_area_ratio >= 0.05) THEN 9 ELSE 10 END AS k FROM m),
routed AS (SELECT doc_id, image_id, (['reuse','skip','skip','review','review','skip','review','review','review','whole_image','region','review'])[k + 1] AS route,
  (['exact_duplicate','too_small','no_meaningful_text','low_ocr_confidence','ocr_noise','likely_logo_or_icon','small_text_dense_asset','borderline_ocr_confidence','ambiguous_short_text','text_rich_graphic','simple_text_regions','local_ocr_unavailable'])[k + 1] AS reason FROM k)
"""


@query(_ROUTES + "SELECT doc_id, image_id, route, reason FROM routed")
def image_routes(spark, d):
    return I.routes(
        rows(spark, d, "selections", "doc_id", "image_id", "content_hash", "display_area_ratio", "text_chars", "alpha_chars", "word_count", "meaningful_word_count", "lexical_word_ratio", "line_count", "mean_confidence"),
        rows(spark, d, "images", "doc_id", "id", "ord", "width", "height"),
    )


@query(_ROUTES + "SELECT route, reason, count(*) AS images FROM routed GROUP BY ALL")
def route_counts(spark, d):
    return image_routes(spark, d).groupBy("route", "reason").agg(F.count("*").alias("images"))


@query("""
SELECT s.doc_id, s.image_id, i.localized_data_ref FROM (SELECT DISTINCT doc_id, image_id, duplicate_of FROM selections WHERE duplicate_of IS NOT NULL) s
LEFT JOIN (SELECT DISTINCT doc_id, id, localized_data_ref FROM images) i ON i.doc_id = s.doc_id AND i.id = s.duplicate_of""")
def reuse_propagation(spark, d):
    return I.reuse(rows(spark, d, "selections", "doc_id", "image_id", "duplicate_of"), rows(spark, d, "images", "doc_id", "id", "localized_data_ref"))


@query("""
SELECT DISTINCT i.doc_id, i.id FROM images i LEFT JOIN selections s ON s.doc_id = i.doc_id AND s.image_id = i.id
WHERE i.localized_data_ref IS NULL AND (s.route IS NULL OR s.route = 'region') AND EXISTS (FROM regions r WHERE r.doc_id = i.doc_id AND r.image_id = i.id)""")
def localizable_images(spark, d):
    return I.localizable(rows(spark, d, "images", "doc_id", "id", "localized_data_ref"), table(spark, d, "regions"), rows(spark, d, "selections", "doc_id", "image_id", "route"))


@query("""
WITH j AS (SELECT DISTINCT i.doc_id, coalesce(b.layout.slide_index, 0) AS slide, i.id, i.ord, i.width::BIGINT * i.height AS area FROM images i JOIN blocks b ON b.doc_id = i.doc_id AND b.id = i.id)
SELECT doc_id, slide, arg_max(id, area * 1000000 - ord) AS id FROM j GROUP BY ALL""")
def largest_image_per_slide(spark, d):
    return I.largest_per_slide(rows(spark, d, "images", "doc_id", "id", "ord", "width", "height"), rows(spark, d, "blocks", "doc_id", "id", layout("slide_index")))


@query("""
SELECT DISTINCT i.doc_id, i.id, try_cast(nullif(regexp_extract(i.id, '^s(\\d+)-', 1), '') AS INT) + 1 AS slide, lower(regexp_extract(data_ref, '\\.([^.]+)$', 1)) AS format, media_type, route, reason
FROM images i LEFT JOIN (SELECT DISTINCT doc_id, image_id, route, reason FROM selections) s ON s.doc_id = i.doc_id AND s.image_id = i.id""")
def image_plan(spark, d):
    s = rows(spark, d, "selections", "doc_id", F.col("image_id").alias("id"), "route", "reason")
    i = rows(spark, d, "images", "doc_id", "id", I.slide_number(F.col("id")).alias("slide"), X.format_of(F.col("data_ref")).alias("format"), "media_type")
    return i.distinct().join(s, ["doc_id", "id"], "left")


@query(f"SELECT DISTINCT doc_id, image_id, id, source_text FROM regions WHERE translatable AND regexp_matches(source_text, {_NOT_BLANK})")
def translatable_regions(spark, d):
    return I.translatable_regions(rows(spark, d, "regions", "doc_id", "image_id", "id", "source_text", "translatable")).drop("translatable")


@query("SELECT doc_id, image_id, id, row_number() OVER (PARTITION BY doc_id, image_id ORDER BY bbox.y, bbox.x, ord)::INT AS place FROM (SELECT DISTINCT doc_id, image_id, id, ord, bbox FROM regions)")
def reading_order(spark, d):
    return W.reading_order(rows(spark, d, "regions", "doc_id", "image_id", "id", "ord", "bbox"))


_CLUSTERS = """
WITH r AS (SELECT DISTINCT doc_id, image_id, id, bbox.x AS x, bbox.y AS y, bbox.w AS w, bbox.h AS h, bbox.y // 40 AS line FROM regions),
g AS (SELECT *, x - lag(x + w) OVER (PARTITION BY doc_id, image_id, line ORDER BY x, id) AS gap, median(h) OVER (PARTITION BY doc_id, image_id, line) AS mid FROM r),
c AS (SELECT *, sum(coalesce(gap > greatest(30.0, 1.5 * mid), false)::INT) OVER (PARTITION BY doc_id, image_id, line ORDER BY x, id ROWS UNBOUNDED PRECEDING)::BIGINT AS cluster FROM g)
"""


def _clusters(spark, d):
    r = rows(spark, d, "regions", "doc_id", "image_id", "id", "bbox.*").withColumn("line", F.floor(F.col("y") / 40).cast("long"))
    return W.clusters(r, "doc_id", "image_id", "line")


@query(_CLUSTERS + "SELECT doc_id, image_id, id, line, cluster FROM c")
def word_clusters(spark, d):
    return _clusters(spark, d).select("doc_id", "image_id", "id", "line", "cluster")


@query(_CLUSTERS + 'SELECT doc_id, image_id, line, cluster, min(x) AS "left", min(y) AS top, max(x + w) AS "right", max(y + h) AS bottom, count(*) AS words FROM c GROUP BY ALL')
def line_boxes(spark, d):
    return W.line_boxes(_clusters(spark, d), "doc_id", "image_id", "line")


@query()
def paragraphs(spark, d):
    """Regions of an image as lines, wrapped lines joined to paragraphs."""
    b = F.col("bbox")
    r = rows(spark, d, "regions", "doc_id", "image_id", b["x"].alias("left"), b["y"].alias("top"), (b["x"] + b["w"]).alias("right"), (b["y"] + b["h"]).alias("bottom"), F.col("source_text").alias("text"))
    return W.paragraphs(r)


@query("""
SELECT doc_id, image_id, min(bbox.x) AS "left", min(bbox.y) AS top, max(bbox.x + bbox.w) AS "right", max(bbox.y + bbox.h) AS bottom, string_agg(source_text, chr(10) ORDER BY ord) AS text
FROM (SELECT DISTINCT doc_id, image_id, ord, bbox, source_text FROM regions) GROUP BY doc_id, image_id""")
def image_texts(spark, d):
    return W.image_text(rows(spark, d, "regions", "doc_id", "image_id", "ord", "bbox", "source_text"))


@query("""
WITH r AS (SELECT doc_id, image_id, sum(length(regexp_replace(coalesce(source_text, ''), '[^\\p{L}\\p{N}]', '', 'g')))::BIGINT AS signs FROM (SELECT DISTINCT doc_id, image_id, id, source_text FROM regions) GROUP BY ALL),
i AS (SELECT DISTINCT doc_id, id, width::DOUBLE / height AS ratio FROM images)
SELECT r.doc_id, r.image_id, signs, signs >= 40 AS canvas, CASE WHEN ratio >= 4 AND signs >= 200 THEN 3 WHEN ratio >= 1.8 AND signs >= 100 THEN 2 ELSE 1 END AS columns
FROM r JOIN i ON i.doc_id = r.doc_id AND i.id = r.image_id""")
def text_canvases(spark, d):
    r = rows(spark, d, "regions", "doc_id", "image_id", "id", "source_text")
    r = r.groupBy("doc_id", "image_id").agg(F.sum(X.alnum_count(F.coalesce("source_text", F.lit("")))).alias("signs"))
    i = rows(spark, d, "images", "doc_id", F.col("id").alias("image_id"), (F.col("width").cast("double") / F.col("height")).alias("ratio"))
    return r.join(i, ["doc_id", "image_id"]).select("doc_id", "image_id", "signs", (F.col("signs") >= 40).alias("canvas"), W.canvas_columns(F.col("ratio"), F.col("signs")).alias("columns"))


@query("""
WITH r AS (SELECT DISTINCT r.doc_id, r.image_id, r.id, bbox, i.width, i.height FROM regions r JOIN images i ON i.doc_id = r.doc_id AND i.id = r.image_id),
c AS (SELECT *, greatest(0, least(bbox.x, width - 1)) AS x, greatest(0, least(bbox.y, height - 1)) AS y FROM r)
SELECT doc_id, image_id, id, x, y, greatest(1, least(bbox.w, width - x)) AS w, greatest(1, least(bbox.h, height - y)) AS h FROM c""")
def clamped_boxes(spark, d):
    i = rows(spark, d, "images", "doc_id", F.col("id").alias("image_id"), "width", "height")
    r = rows(spark, d, "regions", "doc_id", "image_id", "id", "bbox").join(i, ["doc_id", "image_id"])
    return r.select("doc_id", "image_id", "id", W.clamped(F.col("bbox"), F.col("width"), F.col("height")).alias("c")).select("doc_id", "image_id", "id", "c.*")


@query("""
WITH u AS (SELECT DISTINCT doc_id, image_id, bbox.x AS x, bbox.y AS y, source_text AS text, 0 AS run FROM regions WHERE source_text IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, image_id, bbox.x, bbox.y, target_text, 1 FROM regions WHERE target_text IS NOT NULL),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, image_id, x, y, lower(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) ORDER BY run, text) AS n FROM u)
SELECT doc_id, image_id, x, y, text, run FROM n WHERE n = 1""")
def line_union(spark, d):
    r = rows(spark, d, "regions", "doc_id", "image_id", F.col("bbox.x").alias("x"), F.col("bbox.y").alias("y"), "source_text", "target_text")
    one, two = (r.where(F.col(c).isNotNull()).select("doc_id", "image_id", "x", "y", F.col(c).alias("text")).distinct() for c in ("source_text", "target_text"))
    return W.union_distinct(one, two)


@query("""
SELECT DISTINCT doc_id, image_id, id, font_estimate.color AS color, CASE WHEN regexp_matches(font_estimate.color, '^#[0-9A-Fa-f]{6}$') THEN ('0x' || substr(font_estimate.color, 2, 2))::INT ELSE 24 END AS red,
  CASE WHEN regexp_matches(font_estimate.color, '^#[0-9A-Fa-f]{6}$') THEN ('0x' || substr(font_estimate.color, 4, 2))::INT ELSE 24 END AS green,
  CASE WHEN regexp_matches(font_estimate.color, '^#[0-9A-Fa-f]{6}$') THEN ('0x' || substr(font_estimate.color, 6, 2))::INT ELSE 24 END AS blue FROM regions""")
def region_colours(spark, d):
    c = F.col("color")
    r = rows(spark, d, "regions", "doc_id", "image_id", "id", F.col("font_estimate.color").alias("color"))
    return r.select("*", X.colour(c, 0).alias("red"), X.colour(c, 1).alias("green"), X.colour(c, 2).alias("blue"))


@query("""
WITH r AS (SELECT DISTINCT doc_id, image_id, id, source_text AS t, regexp_replace(source_text, '[^A-Za-z]', '', 'g') AS l FROM regions WHERE source_text IS NOT NULL)
SELECT doc_id, image_id, id, length(l) > 0 AND upper(l) = l AND length(l) <= 16 AND len(regexp_extract_all(t, '[A-Za-z0-9]+')) <= 3 AS mark FROM r""")
def protected_marks(spark, d):
    r = rows(spark, d, "regions", "doc_id", "image_id", "id", "source_text").where("source_text is not null")
    return r.select("doc_id", "image_id", "id", X.protected_mark(F.col("source_text")).alias("mark"))


@query("""
WITH r AS (SELECT DISTINCT doc_id, image_id, id, source_text AS s, target_text AS t, regexp_replace(source_text, '[^A-Za-z]', '', 'g') AS l FROM regions WHERE translatable AND regexp_matches(source_text, """ + _NOT_BLANK + """)),
g AS (SELECT doc_id, image_id, bool_or(NOT coalesce(regexp_matches(t, """ + _NOT_BLANK + """), false)) AS b,
  bool_or(coalesce(lower(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) = lower(regexp_replace(s, '[^\\p{L}\\p{N}]', '', 'g')), false) AND NOT (length(l) > 0 AND upper(l) = l AND length(l) <= 16 AND len(regexp_extract_all(s, '[A-Za-z0-9]+')) <= 3)) AS s FROM r GROUP BY ALL)
SELECT i.doc_id, i.id AS image_id, CASE WHEN b IS NULL THEN 'pre_generation_ocr_empty' WHEN b THEN 'translation_mapping_incomplete' WHEN s THEN 'translation_mapping_unchanged' END AS reason
FROM (SELECT DISTINCT doc_id, id FROM images) i LEFT JOIN g ON g.doc_id = i.doc_id AND g.image_id = i.id""")
def mapping_gate(spark, d):
    return Q.mapping_gate(rows(spark, d, "regions", "doc_id", "image_id", "id", "translatable", "source_text", "target_text"), rows(spark, d, "images", "doc_id", "id"))


@query()
def region_font_sizes(spark, d):
    """The size at which each region's text fits its box."""
    return R.fitted_sizes(rows(spark, d, "regions", "doc_id", "image_id", "id", "bbox", "source_text", "target_text"))


# Recognised text


_WORDS = """
WITH s AS (SELECT DISTINCT doc_id, image_id, detected_text FROM selections WHERE detected_text IS NOT NULL),
l AS (SELECT doc_id, image_id, i - 1 AS line, string_split(detected_text, chr(10))[i] AS t FROM s, LATERAL (SELECT unnest(range(1, len(string_split(detected_text, chr(10))) + 1)) AS i)),
w AS (SELECT doc_id, image_id, line, j - 1 AS place, regexp_split_to_array(t, '[ \\t\\r]+')[j] AS word FROM l, LATERAL (SELECT unnest(range(1, len(regexp_split_to_array(t, '[ \\t\\r]+')) + 1)) AS j)),
p AS (SELECT *, 30 + (length(word) * 7 + place * 13 + line * 5) % 66 - 5 AS confidence FROM w WHERE word <> ''),
f AS (SELECT *, regexp_replace(word, '[^\\p{L}]', '', 'g') AS letters FROM p WHERE confidence >= 30 AND regexp_matches(word, """ + _NOT_BLANK + """) AND length(word) <= 80 AND NOT contains(word, '\\t'))
"""


def _words(spark, d):
    s = rows(spark, d, "selections", "doc_id", "image_id", F.col("detected_text").alias("text")).where("text is not null")
    w = W.split_words(s, "doc_id", "image_id")
    # Confidences are made up from the word, as the tables have none per word.
    return W.probe_words(w.withColumn("confidence", 30 + (F.length("word") * 7 + F.col("place") * 13 + F.col("line") * 5) % 66 - 5))


@query(_WORDS + """
SELECT doc_id, image_id, count(*) AS words, sum((CASE WHEN regexp_matches(letters, '[\\x{3400}-\\x{9FFF}]') THEN length(letters) >= 2
  ELSE length(letters) >= 3 OR upper(letters) IN ('AI','BI','IT','IP','KM','RND','SAP','BOM','CAD','ERP','LLM') END)::INT)::BIGINT AS meaningful,
  sum(length(regexp_replace(word, '[^\\p{L}\\p{N}]', '', 'g')))::BIGINT AS signs, sum(length(letters))::BIGINT AS letters, count(DISTINCT line) AS lines,
  sum((CASE WHEN regexp_matches(letters, '[\\x{3400}-\\x{9FFF}]') THEN length(letters) >= 2 ELSE length(letters) >= 3 OR upper(letters) IN ('AI','BI','IT','IP','KM','RND','SAP','BOM','CAD','ERP','LLM') END)::INT)::DOUBLE / count(*) AS share
FROM f GROUP BY doc_id, image_id""")
def ocr_measures(spark, d):
    return W.word_measures(_words(spark, d), "doc_id", "image_id")


_HAN = "[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"


@query(f"""
WITH t AS (SELECT DISTINCT doc_id, image_id, trim(regexp_replace(detected_text, '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM selections WHERE detected_text IS NOT NULL),
-- A sign between two blanks stands in both places, so the rule is applied twice.
h AS (SELECT doc_id, image_id, regexp_replace(regexp_replace(t, '({_HAN}) ({_HAN})', '\\1\\2', 'g'), '({_HAN}) ({_HAN})', '\\1\\2', 'g') AS t FROM t)
SELECT DISTINCT doc_id, image_id, regexp_replace(regexp_replace(t, ' ([,.;:!?%)\\]}}，。；：！？）】》])', '\\1', 'g'), '([(\\[{{（【《]) ', '\\1', 'g') AS text FROM h""")
def ocr_clean_texts(spark, d):
    """Recognised texts with white space put right, Chinese included."""
    return rows(spark, d, "selections", "doc_id", "image_id", "detected_text").where("detected_text is not null").select("doc_id", "image_id", X.ocr_clean(F.col("detected_text")).alias("text")).distinct()


# Slides


_SHAPES = """
WITH b AS (SELECT DISTINCT doc_id, coalesce(layout.slide_index, 0) AS slide, ord AS z, id, type, layout.position AS p FROM blocks WHERE layout.position IS NOT NULL),
t AS (SELECT *, p.x AS l, p.y AS t, p.x + p.w AS r, p.y + p.h AS b, p.w AS w, p.h AS h FROM b WHERE type IN ('title', 'body', 'shape_text')),
f AS (SELECT *, p.x AS l, p.y AS t, p.x + p.w AS r, p.y + p.h AS b, p.h AS h FROM b WHERE type = '{0}')
"""


def _shapes(spark, d, kind: str):
    b = rows(spark, d, "blocks", "doc_id", B.slide_of().alias("slide"), F.col("ord").alias("z"), "id", "type", F.col("layout.position").alias("box")).where("box is not null")
    return b.where(F.col("type").isin("title", "body", "shape_text")).drop("type"), b.where(F.col("type") == kind).drop("type")


@query(_SHAPES.format("image") + """,
j AS (SELECT t.doc_id, t.id, any_value(t.l) AS l, any_value(t.w) AS w, min(CASE WHEN f.z > t.z AND greatest(0, least(t.b, f.b) - greatest(t.t, f.t)) >= least(t.h, f.h) * 0.25 AND f.l > t.l AND f.l < t.r THEN f.l END) AS e
  FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.slide = t.slide GROUP BY t.doc_id, t.id)
SELECT doc_id, id, CASE WHEN coalesce(e, l + w) - l >= w * 0.25 THEN coalesce(e, l + w) - l ELSE w END AS width FROM j""")
def visible_widths(spark, d):
    return S.visible_width(*_shapes(spark, d, "image"))


@query(_SHAPES.format("smartart") + """,
j AS (SELECT t.doc_id, t.id, any_value(t.w) AS w, arg_max(f.r - (t.l - f.l) - t.l, f.z) FILTER (f.z < t.z AND f.l <= t.l AND f.t <= t.t AND f.b >= t.b AND f.r > t.l AND f.r < t.r AND f.r - (t.l - f.l) - t.l >= t.w * 0.25) AS inner_w
  FROM t LEFT JOIN f ON f.doc_id = t.doc_id AND f.slide = t.slide GROUP BY t.doc_id, t.id)
SELECT doc_id, id, coalesce(inner_w, w) AS width FROM j""")
def container_widths(spark, d):
    return S.container_width(*_shapes(spark, d, "smartart"))


# Validations


@query("""
SELECT DISTINCT doc_id, image_id, i - 1 AS pos, expected_texts[i] AS source, expected_translations[i] AS target
FROM (SELECT DISTINCT doc_id, image_id, expected_texts, expected_translations FROM validations), LATERAL (SELECT unnest(range(1, greatest(len(expected_texts), len(expected_translations)) + 1)) AS i)""")
def expected_pairs(spark, d):
    v = rows(spark, d, "validations", "doc_id", "image_id", "expected_texts", "expected_translations").select("doc_id", "image_id", F.posexplode(F.arrays_zip("expected_texts", "expected_translations")).alias("pos", "p"))
    return v.select("doc_id", "image_id", F.col("pos").cast("long"), F.col("p.expected_texts").alias("source"), F.col("p.expected_translations").alias("target")).distinct()


@query("""
WITH v AS (SELECT DISTINCT doc_id, image_id, coalesce(expected_texts, []) AS e, coalesce(expected_translations, []) AS t, list_transform(coalesce(output_texts, []), lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))) AS o FROM validations),
h AS (SELECT doc_id, image_id, coalesce(list_aggregate(o, 'string_agg', ''), '') AS hay, list_transform(e, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))) AS e, list_transform(t, lambda x: lower(regexp_replace(x, '[^\\p{L}\\p{N}]', '', 'g'))) AS t FROM v)
SELECT doc_id, image_id, len(list_filter(e, lambda x: length(x) >= 4 AND contains(hay, x)))::INT AS residual, len(list_filter(t, lambda x: length(x) >= 4 AND NOT contains(hay, x)))::INT AS missing FROM h""")
def quality_exact(spark, d):
    return Q.exact_gate(rows(spark, d, "validations", "doc_id", "image_id", "expected_texts", "expected_translations", "output_texts"))


_KEY = "lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]', '', 'g'))"


@query(f"""
WITH v AS (SELECT DISTINCT doc_id, image_id, coalesce(expected_texts, []) AS e, coalesce(expected_translations, []) AS t, output_texts FROM validations),
p AS (SELECT *, list_filter(list_transform(range(1, least(len(e), len(t)) + 1), lambda i: {{'s': e[i], 't': t[i]}}), lambda x: x.s IS NOT NULL AND x.t IS NOT NULL) AS pairs, list_filter(output_texts, lambda x: coalesce(regexp_matches(x, {_NOT_BLANK}), false)) AS o FROM v),
h AS (SELECT *, coalesce(list_aggregate(list_transform(o, lambda x: {_KEY.format("x")}), 'string_agg', ''), '') AS hay, list_filter(pairs, lambda x: NOT ({_KEY.format("x.s")} = {_KEY.format("x.t")} AND length(regexp_replace(x.s, '[^A-Za-z]', '', 'g')) BETWEEN 1 AND 16
  AND upper(regexp_replace(x.s, '[^A-Za-z]', '', 'g')) = regexp_replace(x.s, '[^A-Za-z]', '', 'g') AND len(regexp_extract_all(x.s, '[A-Za-z0-9]+')) <= 3)) AS asked FROM p),
c AS (SELECT doc_id, image_id, len(pairs) AS n, o, len(list_filter(asked, lambda x: length({_KEY.format("x.s")}) >= 4 AND {_KEY.format("x.s")} <> {_KEY.format("x.t")} AND contains(hay, {_KEY.format("x.s")}))) AS residual,
  len(list_filter(asked, lambda x: length({_KEY.format("x.t")}) >= 4 AND NOT contains(hay, {_KEY.format("x.t")}))) AS missing FROM h),
r AS (SELECT doc_id, image_id, n > 0 AND len(o) > 0 AS readable, residual, missing, CASE WHEN n = 0 THEN 'translation_mapping_missing' WHEN o IS NULL THEN 'post_generation_ocr_failed' WHEN len(o) = 0 THEN 'post_generation_ocr_empty'
  WHEN residual > 0 THEN 'residual_source_text' WHEN missing > 0 THEN 'missing_target_text' END AS reason FROM c)
SELECT doc_id, image_id, CASE WHEN reason IS NULL THEN 'passed' ELSE 'failed' END AS status, reason, CASE WHEN readable THEN residual ELSE 0 END::INT AS residual, CASE WHEN readable THEN missing ELSE 0 END::INT AS missing FROM r""")
def quality_status(spark, d):
    """The verdict on every localized image, by exact comparison."""
    v = Q.output_gate(rows(spark, d, "validations", "doc_id", "image_id", "expected_texts", "expected_translations", "output_texts"), fuzzy=False)
    return v.select("doc_id", "image_id", "status", "reason", F.size("residual").alias("residual"), F.size("missing").alias("missing"))


@query()
def quality_fuzzy(spark, d):
    """The verdict with residual and missing texts, by fuzzy comparison."""
    return Q.output_gate(rows(spark, d, "validations", "doc_id", "image_id", "expected_texts", "expected_translations", "output_texts"))


@query("""
WITH u AS (SELECT DISTINCT doc_id, image_id, output_texts FROM validations)
SELECT doc_id, image_id, len(list_distinct(output_texts))::INT AS outputs FROM u WHERE output_texts IS NOT NULL""")
def distinct_outputs(spark, d):
    v = rows(spark, d, "validations", "doc_id", "image_id", "output_texts").where("output_texts is not null")
    return v.select("doc_id", "image_id", F.size(F.array_distinct("output_texts")).alias("outputs"))


@query("""
WITH v AS (SELECT DISTINCT doc_id, image_id, coalesce(output_texts, []) AS o, coalesce(expected_texts, []) AS e FROM validations)
SELECT doc_id, image_id, array_to_string(list_slice(list_concat(o, list_slice(e, len(o) + 1, len(e))), 1, len(e)), chr(10)) AS texts FROM v""")
def fitted_outputs(spark, d):
    none = F.array().cast("array<string>")
    v = rows(spark, d, "validations", "doc_id", "image_id", F.coalesce("output_texts", none).alias("o"), F.coalesce("expected_texts", none).alias("e"))
    return v.select("doc_id", "image_id", F.array_join(X.fit_length(F.col("o"), F.col("e")), "\n").alias("texts"))


# Documents and jobs


_ALIAS = ", ".join(f"('{a}', '{c}')" for a, c in X.ALIASES.items())


_ATTRIBUTES = ", ".join(str((a, c, *X.LANGUAGES[c])) for a, c in X.ALIASES.items())


@query(f"""
SELECT doc_id, source_lang, s.code AS source_code, s.name AS source_name, s.tag AS source_tag, s.tesseract AS source_tesseract, s.paddle AS source_paddle, t.code AS target_code FROM doc_meta
LEFT JOIN (VALUES {_ATTRIBUTES}) s(a, code, name, tag, tesseract, paddle) ON s.a = lower(trim(source_lang)) LEFT JOIN (VALUES {_ALIAS}) t(a, code) ON t.a = lower(trim(target_lang))""")
def document_languages(spark, d):
    own = X.language(F.col("source_lang"))
    return table(spark, d, "doc_meta").select("doc_id", "source_lang", *(own[k].alias(f"source_{k}") for k in ("code", *X.LANGUAGE_FIELDS)), X.supported_language(F.col("target_lang")).alias("target_code"))


@query(f"SELECT doc_id, source_lang FROM doc_meta WHERE lower(trim(source_lang)) NOT IN (SELECT a FROM (VALUES {_ALIAS}) s(a, code))")
def unsupported_documents(spark, d):
    return table(spark, d, "doc_meta").where(F.col("source_lang").isNotNull() & X.supported_language(F.col("source_lang")).isNull()).select("doc_id", "source_lang")


@query("SELECT doc_type, lower(regexp_extract(path, '\\.([^.]+)$', 1)) AS format, count(*) AS documents, count(title) AS titled FROM doc_meta GROUP BY ALL")
def document_formats(spark, d):
    return table(spark, d, "doc_meta").groupBy("doc_type", X.format_of(F.col("path")).alias("format")).agg(F.count("*").alias("documents"), F.count("title").alias("titled"))


@query("""
WITH e AS (SELECT DISTINCT * FROM job_events), n AS (SELECT *, row_number() OVER (PARTITION BY job_id, phase ORDER BY ts DESC, arrived_at DESC, coalesce(completed, -1) DESC, coalesce(total, -1) DESC) AS n FROM e)
SELECT job_id, phase, completed, total FROM n WHERE n = 1""")
def progress_latest(spark, d):
    return P.latest(table(spark, d, "job_events"))


@query("""
SELECT job_id, phase, epoch_us(ts) AS ts_us, epoch_us(arrived_at) AS arrived_us, max(completed) OVER (PARTITION BY job_id, phase ORDER BY ts, arrived_at ROWS UNBOUNDED PRECEDING) AS so_far FROM (SELECT DISTINCT * FROM job_events)""")
def progress_running(spark, d):
    return P.running_totals(table(spark, d, "job_events"))


@query("SELECT phase, count(*) AS events, sum((epoch_us(arrived_at) - epoch_us(ts) > 3600000000)::INT)::BIGINT AS late FROM (SELECT DISTINCT * FROM job_events) GROUP BY phase")
def late_events(spark, d):
    return P.lateness(table(spark, d, "job_events"))


@query("""
SELECT m.doc_id, j.translation_engine AS engine, j.ocr_engine, j.state FROM doc_meta m JOIN (SELECT DISTINCT input_path, translation_engine, ocr_engine, state FROM jobs WHERE state = 'done') j ON j.input_path = m.path""")
def finished_documents(spark, d):
    j = table(spark, d, "jobs").where("state = 'done'").select(F.col("input_path").alias("path"), F.col("translation_engine").alias("engine"), "ocr_engine", "state").distinct()
    return table(spark, d, "doc_meta").select("doc_id", "path").join(j, "path").drop("path")


@query()
def document_json(spark, d):
    """Each document with its blocks, nested and in order."""
    from lexloom.sources.documents import as_json

    b = rows(spark, d, "blocks", "doc_id", "ord", "id", "type", "semantic_role", "source_text", "target_text", "source_ref")
    return as_json(table(spark, d, "doc_meta"), b)


@query("""
WITH r AS (SELECT DISTINCT r.doc_id, r.image_id, r.id, bbox, i.width::BIGINT AS width, i.height::BIGINT AS height, CASE WHEN greatest(i.width, i.height) < 1200 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM regions r JOIN images i ON i.doc_id = r.doc_id AND i.id = r.image_id),
a AS (SELECT *, round_even(bbox.x::DOUBLE / s, 0)::BIGINT AS x, round_even(bbox.y::DOUBLE / s, 0)::BIGINT AS y, round_even((bbox.x + bbox.w)::DOUBLE / s, 0)::BIGINT AS r, round_even((bbox.y + bbox.h)::DOUBLE / s, 0)::BIGINT AS b FROM r),
p AS (SELECT *, greatest(2, round_even(greatest(1, b - y) * 0.16::DOUBLE, 0)::BIGINT) AS px, greatest(1, round_even(greatest(1, b - y) * 0.12::DOUBLE, 0)::BIGINT) AS py FROM a)
SELECT doc_id, image_id, id, greatest(0, x - px) AS x, greatest(0, y - py) AS y, greatest(1, least(width, r + px) - greatest(0, x - px)) AS w, greatest(1, least(height, b + py) - greatest(0, y - py)) AS h FROM p""")
def padded_boxes(spark, d):
    i = rows(spark, d, "images", "doc_id", F.col("id").alias("image_id"), F.col("width").cast("long"), F.col("height").cast("long"))
    r = rows(spark, d, "regions", "doc_id", "image_id", "id", "bbox").join(i, ["doc_id", "image_id"])
    box = W.padded(F.col("bbox"), W.scale_of(F.col("width"), F.col("height")), F.col("width"), F.col("height"))
    return r.select("doc_id", "image_id", "id", box.alias("b")).select("doc_id", "image_id", "id", "b.*")


@query("SELECT DISTINCT doc_id, image_id, id, CASE WHEN align IN ('left', 'center', 'right') THEN align ELSE 'left' END AS align FROM regions WHERE length(regexp_replace(source_text, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 AND bbox.w > 0 AND bbox.h > 0")
def valid_regions(spark, d):
    return W.valid_regions(rows(spark, d, "regions", "doc_id", "image_id", "id", "source_text", "bbox", "align")).select("doc_id", "image_id", "id", "align")


@query("SELECT DISTINCT doc_id, image_id, sha256(coalesce(content_hash, '') || chr(31) || coalesce(route, '') || chr(31) || 'v1') AS key FROM selections")
def cache_keys(spark, d):
    s = rows(spark, d, "selections", "doc_id", "image_id", "content_hash", "route")
    return s.select("doc_id", "image_id", L.cache_key(F.col("content_hash"), F.col("route"), F.lit("v1")).alias("key"))


def _requests(spark, d):
    b = rows(spark, d, "blocks", "doc_id", "ord", "id", "translatable", "source_text", "runs", layout("slide_index", "position", "base_font"))
    return L.requests(b, table(spark, d, "doc_meta"), GLOSSARY)


@query()
def slide_prompts(spark, d):
    """The engine request of every slide as a prompt."""
    return _requests(spark, d).select("doc_id", "slide", "part", L.prompt().alias("prompt"))


@query(f"""
WITH b AS (SELECT DISTINCT doc_id, id, source_text FROM blocks WHERE translatable AND regexp_matches(source_text, {_NOT_BLANK}))
SELECT doc_id, id, '[' || target_lang || '] ' || {_replaced('source_text')} AS target_text FROM b JOIN doc_meta USING (doc_id)""")
def localized_blocks(spark, d):
    """The whole text path with the dry-run engine: requests per slide, answers as JSON, targets by block."""
    engine = lambda texts, lang: F.transform(texts, lambda t: X.pseudo_translation(t, lang, GLOSSARY))
    b = rows(spark, d, "blocks", "doc_id", "ord", "id", "translatable", "source_text", "runs", layout("slide_index", "position", "base_font"))
    return L.localized(b, table(spark, d, "doc_meta"), GLOSSARY, engine)
