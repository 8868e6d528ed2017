"""Images: duplicates, routes, display share, reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import not_blank

# Thresholds of the image router.
MIN_WIDTH, MIN_HEIGHT, MIN_AREA, MIN_SIGNS = 120, 60, 20000, 6

#: What a recognition of an image's text yields.
MEASURES = ("text_chars", "alpha_chars", "word_count", "meaningful_word_count", "lexical_word_ratio", "line_count", "mean_confidence")


def display_ratio(images: DataFrame, blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """(doc_id, id, ratio): the share of the slide that the image's block covers, to six places; null without position or slide size."""
    box = blocks.select("doc_id", "id", "ord", F.col("layout.position").alias("box")).groupBy("doc_id", "id").agg(F.min_by("box", "ord").alias("box"))
    slide = documents.select("doc_id", (F.nullif(F.col("slide_width"), F.lit(0)).cast("double") * F.nullif(F.col("slide_height"), F.lit(0))).alias("area"))
    ratio = F.col("box.w").cast("double") * F.col("box.h") / F.col("area")
    j = images.select("doc_id", "id").join(box, ["doc_id", "id"], "left").join(slide, "doc_id", "left")
    return j.select("doc_id", "id", (F.floor(ratio * 1000000 + 0.5) / 1000000.0).alias("ratio"))


def exact_duplicates(selections: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, image_id, first_id): images whose content hash an earlier image of the document has."""
    order = images.select("doc_id", F.col("id").alias("image_id"), "ord")
    s = selections.where("content_hash is not null").select("doc_id", "image_id", "content_hash").join(order, ["doc_id", "image_id"])
    w = Window.partitionBy("doc_id", "content_hash").orderBy("ord", "image_id")
    s = s.select("doc_id", "image_id", F.first("image_id").over(w).alias("first_id"), F.row_number().over(w).alias("n"))
    return s.where("n > 1").drop("n")


def _ladder() -> list[tuple[Column, str, str]]:
    c = F.col
    small = c("display_area_ratio") < 0.025
    few = c("text_chars") <= 24
    return [
        (c("repeated"), "reuse", "exact_duplicate"),
        ((c("width") < MIN_WIDTH) | (c("height") < MIN_HEIGHT) | (c("width") * c("height") < MIN_AREA), "skip", "too_small"),
        (c("probed").isNull(), "review", "local_ocr_unavailable"),
        ((c("text_chars") < MIN_SIGNS) | (c("alpha_chars") < MIN_SIGNS), "skip", "no_meaningful_text"),
        (c("mean_confidence") < 45, "review", "low_ocr_confidence"),
        ((c("word_count") >= 10) & (c("lexical_word_ratio") < 0.26), "review", "ocr_noise"),
        (small & few, "skip", "likely_logo_or_icon"),
        (small, "review", "small_text_dense_asset"),
        ((c("mean_confidence") < 60) & (c("word_count") >= 3), "review", "borderline_ocr_confidence"),
        (c("display_area_ratio").isNotNull() & (c("meaningful_word_count") <= 2) & few, "review", "ambiguous_short_text"),
        (
            (c("alpha_chars") >= 30) & (c("meaningful_word_count") >= 8) & (c("line_count") >= 2) & (c("lexical_word_ratio") >= 0.30)
            & (c("display_area_ratio").isNull() | (c("display_area_ratio") >= 0.05)),
            "whole_image", "text_rich_graphic",
        ),
    ]


def routes(selections: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, image_id, route, reason) from the measured text of each image: the first rule that holds.

    An image whose recognition failed, so that a measure of its text is null, goes to review; a null display ratio only fails the rules on it.
    """
    size = images.select("doc_id", F.col("id").alias("image_id"), F.col("width").cast("long"), F.col("height").cast("long"), "ord")
    w = Window.partitionBy("doc_id", "content_hash").orderBy("ord", "image_id")
    s = selections.join(size, ["doc_id", "image_id"]).withColumn("repeated", F.col("content_hash").isNotNull() & (F.row_number().over(w) > 1))
    # Null if any measure is.
    s = s.withColumn("probed", sum((F.col(c) for c in MEASURES), F.lit(0)))
    route = reason = None
    for rule, to, why in _ladder():
        route = (route.when if route is not None else F.when)(rule, to)
        reason = (reason.when if reason is not None else F.when)(rule, why)
    return s.select("doc_id", "image_id", route.otherwise("region").alias("route"), reason.otherwise("simple_text_regions").alias("reason"))


def reuse(selections: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, image_id, localized_data_ref): duplicates with the localized file of their original, null where it has none."""
    ref = images.select("doc_id", F.col("id").alias("duplicate_of"), "localized_data_ref")
    return selections.where("duplicate_of is not null").select("doc_id", "image_id", "duplicate_of").join(ref, ["doc_id", "duplicate_of"], "left").drop("duplicate_of")


def localizable(images: DataFrame, regions: DataFrame, selections: DataFrame) -> DataFrame:
    """(doc_id, id): images with regions and no localized file whose route, if they have one, is `region`."""
    some = regions.select("doc_id", F.col("image_id").alias("id")).distinct()
    route = selections.select("doc_id", F.col("image_id").alias("id"), F.col("route"))
    j = images.where("localized_data_ref is null").select("doc_id", "id").join(some, ["doc_id", "id"], "left_semi").join(route, ["doc_id", "id"], "left")
    return j.where(F.col("route").isNull() | (F.col("route") == "region")).select("doc_id", "id")


def largest_per_slide(images: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, slide, id): the image with the most pixels on each slide, the first one on a tie."""
    slide = F.coalesce(F.col("layout.slide_index"), F.lit(0)).alias("slide")
    j = images.select("doc_id", "id", "ord", (F.col("width").cast("long") * F.col("height")).alias("area")).join(blocks.select("doc_id", "id", slide), ["doc_id", "id"])
    return j.groupBy("doc_id", "slide").agg(F.max_by("id", F.struct("area", -F.col("ord"))).alias("id"))


def slide_number(c: Column) -> Column:
    """The one-based slide of an image id as s0-sh2-img, or null."""
    return F.nullif(F.regexp_extract(c, r"^s(\d+)-", 1), F.lit("")).try_cast("int") + 1


def translatable_regions(regions: DataFrame) -> DataFrame:
    return regions.where(F.col("translatable") & not_blank(F.col("source_text")))


def of_slides(images: DataFrame, slides: list[int]) -> DataFrame:
    """Images whose id names one of these slides, counted from one; all where the list is empty."""
    return images.where(slide_number(F.col("id")).isin(slides)) if slides else images
