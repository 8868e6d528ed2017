"""Blocks: selection, roles, slide context, glossary, limits, batches, bilingual slides."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import looks_like, norm_text, not_blank

#: Height of the title zone in EMU: one inch.
TITLE_ZONE = 914400
EMU_PER_POINT = 12700


def slide_of() -> Column:
    """A block's slide; blocks without layout lie on the first."""
    return F.coalesce(F.col("layout.slide_index"), F.lit(0))


def translatable(blocks: DataFrame) -> DataFrame:
    """Blocks to translate: marked so and not blank. A null mark or text counts as no."""
    return blocks.where(F.col("translatable") & not_blank(F.col("source_text")))


def with_roles(blocks: DataFrame) -> DataFrame:
    """`semantic_role` with titles filled in: a block without role in the title zone is its slide's title unless an earlier block was one."""
    w = Window.partitionBy("doc_id", "slide").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    zone = (F.col("type") != "image") & F.col("layout").isNotNull() & F.col("semantic_role").isNull() & (F.col("layout.position.y") < TITLE_ZONE)
    b = blocks.withColumn("slide", slide_of()).withColumn("_zone", F.coalesce(zone, F.lit(False)))
    event = (F.col("_zone") | F.col("semantic_role").eqNullSafe("title")).cast("int")
    first = F.coalesce(F.sum(event).over(w), F.lit(0)) == 0
    return b.withColumn("role", F.when(F.col("_zone") & first, "title").otherwise(F.col("semantic_role"))).drop("_zone")


def slide_context(blocks: DataFrame, limit: int = 1200) -> DataFrame:
    """(doc_id, slide, context): the texts of a slide in order, joined by ' / ', at most `limit` characters.

    A text with its separator takes four characters at least, so a quarter of `limit` texts are enough; the others are dropped before the shuffle.
    """
    b = translatable(blocks).select("doc_id", slide_of().alias("slide"), "ord", "source_text")
    first = F.row_number().over(Window.partitionBy("doc_id", "slide").orderBy("ord"))
    b = b.withColumn("_n", first).where(F.col("_n") <= limit // 4 + 1).drop("_n")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "source_text"))), lambda x: x["source_text"]), " / ")
    return b.groupBy("doc_id", "slide").agg(F.substring(joined, 1, limit).alias("context"))


def glossary_hits(blocks: DataFrame, glossary: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, id, term, preferred, start, end): the first place of every glossary term in every block, without case.

    The glossary is an argument list, so its size is bounded by the caller; each block is scanned once for all terms.
    """
    terms = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("preferred"), (F.instr(F.lower("source_text"), t.lower()) - 1).alias("start")) for t, p in glossary))
    hit = blocks.select("doc_id", "id", F.explode(F.filter(terms, lambda x: x["start"] >= 0)).alias("h"))
    return hit.select("doc_id", "id", "h.term", "h.preferred", "h.start", (F.col("h.start") + F.length("h.term")).alias("end"))


def slide_glossary(blocks: DataFrame, glossary: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, slide, terms): the distinct terms of a slide's blocks, sorted."""
    hits = glossary_hits(translatable(blocks), glossary).select("doc_id", "id", "term")
    slides = blocks.select("doc_id", "id", slide_of().alias("slide")).distinct()
    return hits.join(slides, ["doc_id", "id"]).groupBy("doc_id", "slide").agg(F.array_join(F.array_sort(F.collect_set("term")), "|").alias("terms"))


def max_chars() -> Column:
    """Characters that fit a block's box at its font size; null without a position or a usable size."""
    size = F.coalesce(F.nullif(F.try_element_at(F.col("runs"), F.lit(1))["font"]["size"], F.lit(0.0)), F.nullif(F.col("layout.base_font.size"), F.lit(0.0)), F.lit(18.0))
    per_line = F.greatest(F.lit(1), F.floor(F.col("layout.position.w") / EMU_PER_POINT / (size * 0.55)).cast("long"))
    lines = F.greatest(F.lit(1), F.floor(F.col("layout.position.h") / EMU_PER_POINT / (size * 1.2)).cast("long"))
    return F.when(F.col("layout.position").isNotNull() & (size > 0), per_line * lines)


def with_terms(blocks: DataFrame, glossary: list[tuple[str, str]] = ()) -> DataFrame:
    """`term_hits` of each block: the first place of every glossary term, in the order of the glossary, which the caller bounds."""
    found = F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("preferred"), (F.instr(F.lower("source_text"), t.lower()) - 1).cast("int").alias("start")) for t, p in glossary))
    hits = F.transform(F.filter(found, lambda x: x["start"] >= 0), lambda x: F.struct(x["term"].alias("term"), x["preferred"].alias("preferred"), x["start"].alias("start"), (x["start"] + F.length(x["term"])).alias("end")))
    return blocks.withColumn("term_hits", F.coalesce(hits, F.array()) if glossary else F.array().cast("array<struct<term:string,preferred:string,start:int,end:int>>"))


def with_limits(blocks: DataFrame) -> DataFrame:
    """`constraints` of each block with `max_chars` worked out from its box, where that is known; other limits stay, or are those of a block without any."""
    have = dict(blocks.dtypes).get("constraints", "")
    old = lambda k, v: F.coalesce(F.col(f"constraints.{k}"), F.lit(v)) if f"{k}:" in have else F.lit(v)
    own = F.struct(F.coalesce(max_chars().cast("int"), old("max_chars", None).cast("int")).alias("max_chars"), old("can_shrink_font", True).alias("can_shrink_font"), old("min_font_size", 8.0).alias("min_font_size"), old("max_lines", None).cast("int").alias("max_lines"))
    return blocks.withColumn("constraints", own)


def enriched(blocks: DataFrame, glossary: list[tuple[str, str]] = ()) -> DataFrame:
    """Roles, glossary hits and limits filled in, in this order and one pass."""
    b = with_roles(blocks).withColumn("semantic_role", F.col("role")).drop("role", "slide")
    return b.transform(with_terms, glossary).transform(with_limits)


def batches(blocks: DataFrame, size: int) -> DataFrame:
    """(doc_id, id, ord, batch): translatable blocks of a document in runs of `size`."""
    if size <= 0:
        raise ValueError("size must be positive")
    w = Window.partitionBy("doc_id").orderBy("ord")
    return translatable(blocks).select("doc_id", "id", "ord", F.floor((F.row_number().over(w) - 1) / size).cast("long").alias("batch"))


def parallel(a: str, b: str) -> Column:
    """Whether two boxes stand side by side or one above the other: half overlap on one axis, a gap of at most half a box on the other."""

    def ends(p: str, at: str, size: str) -> tuple[Column, Column]:
        return F.col(f"{p}.{at}"), F.col(f"{p}.{at}") + F.col(f"{p}.{size}")

    def axis(at: str, size: str) -> tuple[Column, Column]:
        (s1, s2), (t1, t2) = ends(a, at, size), ends(b, at, size)
        return F.greatest(F.lit(0), F.least(s2, t2) - F.greatest(s1, t1)), F.greatest(F.lit(0), F.greatest(s1, t1) - F.least(s2, t2))

    small, large = (lambda s: F.least(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) * 0.5), (lambda s: F.greatest(F.col(f"{a}.{s}"), F.col(f"{b}.{s}")) * 0.5)
    (ox, gx), (oy, gy) = axis("x", "w"), axis("y", "h")
    return ((oy >= small("h")) & (gx <= large("w"))) | ((ox >= small("w")) & (gy <= large("h")))


def bilingual_pairs(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, id, other_id): blocks whose translation already stands beside them on the slide, by text key and position.

    An equi-join on document, slide and text key; only its few hits meet the test of position.
    """
    b = blocks.select("doc_id", slide_of().alias("slide"), "id", "ord", "source_text", "target_text", F.col("layout.position").alias("box"))
    b = b.where("box is not null").join(documents.select("doc_id", "source_lang", "target_lang"), "doc_id")
    left = b.where("target_text is not null").withColumn("key", norm_text("target_text")).where((F.col("key") != "") & (F.col("key") != norm_text("source_text")))
    left = left.where(looks_like(F.col("source_text"), F.col("source_lang"))).select("doc_id", "slide", "key", "id", F.col("box").alias("a"))
    right = b.where(looks_like(F.col("source_text"), F.col("target_lang"))).withColumn("key", norm_text("source_text")).where("key != ''")
    right = right.select("doc_id", "slide", "key", F.col("id").alias("other_id"), F.col("box").alias("b"))
    return left.join(right, ["doc_id", "slide", "key"]).where((F.col("id") != F.col("other_id")) & parallel("a", "b")).select("doc_id", "id", "other_id").distinct()


def suppress_bilingual(blocks: DataFrame, source_lang: str | Column, target_lang: str | Column) -> DataFrame:
    """(doc_id, id, target_text): a block whose translation already stands beside it is blanked, and that text kept as it is.

    An equi-join on document, slide and text key finds the blocks with a shape of that text beside them. Earlier changes are seen by later blocks, so the pairs of
    a slide are worked through in order, which needs their ids only. Blocks without a position can neither blank nor be blanked. The languages are codes
    for all blocks, or columns of `blocks` that are the same throughout a document; where one is null nothing changes.
    """
    languages = [(F.lit(c) if isinstance(c, str) else c).alias(n) for c, n in ((source_lang, "source"), (target_lang, "target"))]
    ref = F.col("source_ref")
    shape = F.concat_ws("/", ref["kind"], *(F.coalesce(ref[k].cast("string"), F.lit("-")) for k in ("shape_id", "row", "col")))
    b = blocks.select("doc_id", slide_of().alias("slide"), "ord", "id", "source_text", "target_text", shape.alias("shape"), F.col("layout.position").alias("box"), *languages)
    placed = b.where("box is not null and source is not null and target is not null")
    own = F.array_sort(F.collect_list(F.struct("ord", "id", F.coalesce("source_text", F.lit("")).alias("text"), "box")))
    shapes = placed.groupBy("doc_id", "slide", "shape", "target").agg(own.alias("own"))
    shapes = shapes.withColumn("whole", F.array_join(F.transform("own", lambda x: x["text"]), "")).where(looks_like(F.col("whole"), F.col("target"))).withColumn("key", norm_text("whole"))
    shapes = shapes.where("key != ''").select("doc_id", "slide", "key", F.col("shape").alias("other"), F.col("own")[0]["ord"].alias("first"), F.col("own")[0]["box"].alias("b"), F.transform("own", lambda x: x["id"]).alias("kept"))
    asked = placed.where("target_text is not null").withColumn("key", norm_text("target_text")).where((F.col("key") != "") & (F.col("key") != norm_text("source_text")))
    asked = asked.where(looks_like(F.coalesce("source_text", F.lit("")), F.col("source"))).select("doc_id", "slide", "key", "ord", "id", "shape", F.col("box").alias("a"))
    pairs = asked.join(shapes, ["doc_id", "slide", "key"]).where((F.col("shape") != F.col("other")) & parallel("a", "b")).select("doc_id", "slide", "ord", "id", "first", "kept")

    def work(slide: pd.DataFrame) -> pd.DataFrame:
        state: dict[str, str] = {}
        for r in slide.sort_values(["ord", "first"], kind="stable").itertuples():
            # Each block takes the first shape only, and one that is kept or blank by now takes none.
            if r.id not in state:
                state |= {r.id: "blank"} | dict.fromkeys(r.kept, "kept")
        return pd.DataFrame({"doc_id": slide.doc_id.iloc[0], "slide": slide.slide.iloc[0], "id": list(state), "state": list(state.values())})

    state = pairs.groupBy("doc_id", "slide").applyInPandas(work, "doc_id string, slide int, id string, state string")
    target = F.when(F.col("box").isNull() | F.col("state").isNull(), F.col("target_text")).when(F.col("state") == "blank", "").otherwise(F.col("source_text"))
    return b.join(state, ["doc_id", "slide", "id"], "left").select("doc_id", "id", target.alias("target_text"))
