"""Checks of localized images: leftover source texts, missing translations, fuzzy presence."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import norm_text, normal_form, not_blank, protected_mark

#: Texts with fewer letters and digits aren't checked; similarity from which a text counts as present.
LEAST, SIMILAR = 4, 0.88


def text_present(needle: str | None, outputs: list[str] | None) -> bool:
    """Whether a text is in the outputs: inside their joined form or close to one of them."""
    key = normal_form(needle)
    if len(key) < LEAST:
        return True
    keys = [normal_form(o) for o in (outputs if outputs is not None else [])]
    if key in "".join(keys):
        return True
    for k in keys:
        if len(k) >= LEAST:
            m = SequenceMatcher(None, key, k)
            if m.real_quick_ratio() >= SIMILAR and m.quick_ratio() >= SIMILAR and m.ratio() >= SIMILAR:
                return True
    return False


def output_gate(validations: DataFrame, fuzzy: bool = True) -> DataFrame:
    """(doc_id, image_id, status, reason, residual, missing) of localized images from what was expected of them and read in them (expected_texts,
    expected_translations, output_texts).

    `residual`: source texts still there, `missing`: translations not there; texts under LEAST letters and digits aren't looked for, nor source texts that their
    translation equals, nor protected marks that stay. Texts are found inside the joined outputs and, if `fuzzy`, close to one of them. An image without an
    expected pair fails, and so does one whose output could not be read (null) or holds no text; leftover sources come before missing translations.
    """
    none, key = F.array().cast("array<string>"), lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    pair = F.arrays_zip(F.coalesce("expected_texts", none).alias("source"), F.coalesce("expected_translations", none).alias("target"))
    v = validations.withColumn("pairs", F.filter(pair, lambda x: x["source"].isNotNull() & x["target"].isNotNull()))
    v = v.withColumn("outputs", F.filter("output_texts", lambda x: F.coalesce(not_blank(x), F.lit(False))))
    v = v.withColumn("asked", F.filter("pairs", lambda x: ~(protected_mark(x["source"]) & (key(x["source"]) == key(x["target"])))))
    if fuzzy:
        there = F.pandas_udf(lambda needles, outputs: pd.Series([[text_present(t, o) for t in x] for x, o in zip(needles, outputs, strict=True)]), "array<boolean>")
        v = v.withColumn("seen", there(F.transform("asked", lambda x: x["source"]), F.col("outputs"))).withColumn("got", there(F.transform("asked", lambda x: x["target"]), F.col("outputs")))
    else:
        v = v.withColumn("hay", F.coalesce(F.array_join(F.transform("outputs", key), ""), F.lit("")))
        v = v.withColumn("seen", F.transform("asked", lambda x: F.col("hay").contains(key(x["source"])))).withColumn("got", F.transform("asked", lambda x: F.col("hay").contains(key(x["target"]))))
    v = v.withColumn("checked", F.arrays_zip("asked", "seen", "got"))
    long, pick = lambda c: F.length(key(c)) >= LEAST, lambda rule, side: F.transform(F.filter("checked", rule), lambda x: x["asked"][side])
    residual = pick(lambda x: x["seen"] & long(x["asked"]["source"]) & (key(x["asked"]["source"]) != key(x["asked"]["target"])), "source")
    missing = pick(lambda x: ~x["got"] & long(x["asked"]["target"]), "target")
    reason = (
        F.when(F.size("pairs") == 0, "translation_mapping_missing").when(F.col("outputs").isNull(), "post_generation_ocr_failed").when(F.size("outputs") == 0, "post_generation_ocr_empty")
        .when(F.size("residual") > 0, "residual_source_text").when(F.size("missing") > 0, "missing_target_text")
    )
    unread = (F.size("pairs") == 0) | F.coalesce(F.size("outputs") <= 0, F.lit(True)) | F.col("outputs").isNull()
    v = v.withColumn("residual", F.when(unread, none).otherwise(residual)).withColumn("missing", F.when(unread, none).otherwise(missing)).withColumn("reason", reason)
    return v.select("doc_id", "image_id", F.when(F.col("reason").isNull(), "passed").otherwise("failed").alias("status"), "reason", "residual", "missing")


def exact_gate(validations: DataFrame) -> DataFrame:
    """As `output_gate` with the exact arm only, on letters and digits in lower case: numbers of residual and missing texts."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    hay = F.array_join(F.transform("output_texts", key), "")
    v = validations.withColumn("hay", F.coalesce(hay, F.lit("")))
    checked = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.length(key(x)) >= LEAST)
    found = F.size(F.filter(checked(F.col("expected_texts")), lambda x: F.col("hay").contains(key(x))))
    lost = F.size(F.filter(checked(F.col("expected_translations")), lambda x: ~F.col("hay").contains(key(x))))
    return v.select("doc_id", "image_id", found.alias("residual"), lost.alias("missing"))


def mapping_gate(regions: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, image_id, reason): images with a translatable region that lacks a translation or, unless it is a protected mark, has it unchanged; null where all is well.

    With `images` (doc_id, id), also those in which no translatable text was found.
    """
    r = regions.where(F.col("translatable") & not_blank(F.col("source_text")))
    blank = ~F.coalesce(not_blank(F.col("target_text")), F.lit(False))
    same = F.coalesce(norm_text("target_text") == norm_text("source_text"), F.lit(False)) & ~protected_mark(F.col("source_text"))
    r = r.select("doc_id", "image_id", blank.cast("int").alias("blank"), same.cast("int").alias("same"))
    g = r.groupBy("doc_id", "image_id").agg(F.max("blank").alias("b"), F.max("same").alias("s"))
    if images is not None:
        g = images.select("doc_id", F.col("id").alias("image_id")).join(g, ["doc_id", "image_id"], "left")
    reason = F.when(F.col("b").isNull(), "pre_generation_ocr_empty").when(F.col("b") == 1, "translation_mapping_incomplete").when(F.col("s") == 1, "translation_mapping_unchanged")
    return g.select("doc_id", "image_id", reason.alias("reason"))
