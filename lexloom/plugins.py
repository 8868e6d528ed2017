"""Registry of engines: parsers, renderers, enrichers, translation, recognition, inpainting, image localization."""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.functions.text import pseudo_translation
from lexloom.operators import blocks, rasters
from lexloom.sources.documents import PARSERS, RENDERERS

KINDS = ("parser", "renderer", "enricher", "translation", "ocr", "inpaint", "image")
GROUP = "lexloom.engines"
_ENGINES: dict[str, dict[str, Callable]] = {k: {} for k in KINDS}
_found = False


def register(kind: str, name: str, engine: Callable) -> None:
    """Add or replace an engine; an unknown kind raises KeyError."""
    _ENGINES[kind][name] = engine


def available(kind: str) -> list[str]:
    discover()
    return sorted(_ENGINES[kind])


def get(kind: str, name: str) -> Callable:
    discover()
    if name not in _ENGINES[kind]:
        raise KeyError(f"no {kind} engine {name!r}; there are: {', '.join(sorted(_ENGINES[kind]))}")
    return _ENGINES[kind][name]


def discover() -> None:
    """Load the engines of installed packages, once. Entry points are named kind.name."""
    global _found
    if not _found:
        _found = True
        for e in entry_points(group=GROUP):
            kind, _, name = e.name.partition(".")
            register(kind, name, e.load())


def unavailable(what: str) -> Callable:
    """An engine that a missing library or service stands behind: it returns its input and an error column."""

    def run(df: DataFrame, **_) -> DataFrame:
        return df.withColumn("error", F.lit(f"{what} is not available"))

    return run


def dry_run(df: DataFrame, lang: str, glossary: list[tuple[str, str]] = ()) -> DataFrame:
    """`df` (source_text) with target_text marked by the language and the glossary applied."""
    return df.withColumn("target_text", pseudo_translation(F.col("source_text"), F.lit(lang), list(glossary)))


def sample_regions(df: DataFrame, **_) -> DataFrame:
    """One made-up region per image (doc_id, id, data_ref, width, height): a third by a quarter of it, holding the file's name."""
    name = F.regexp_extract("data_ref", r"([^/]+?)(?:\.[^./]*)?$", 1)
    w, h = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    box = F.struct(F.floor(w / 20).alias("x"), F.floor(h / 20).alias("y"), F.floor(w / 3).alias("w"), F.floor(h / 4).alias("h"))
    return df.select("doc_id", F.col("id").alias("image_id"), F.lit("reg1").alias("id"), box.alias("bbox"), F.when(name == "", "Sample").otherwise(name).alias("source_text"))


def surrounding_fill(df: DataFrame, regions: DataFrame, **_) -> DataFrame:
    """Images of Spark's image source (doc_id, image_id, image) with the erase boxes of `regions` filled by the colour around them."""
    return rasters.erased_images(df, regions)


for _k, _v in PARSERS.items():
    register("parser", _k, _v)
for _k, _v in RENDERERS.items():
    register("renderer", _k, _v)
register("translation", "mock", dry_run)
register("ocr", "mock", sample_regions)
register("inpaint", "pillow", surrounding_fill)
register("enricher", "roles", blocks.with_roles)
register("enricher", "glossary", blocks.with_terms)
register("enricher", "constraints", blocks.with_limits)
for _k, _n in (("translation", "openai"), ("translation", "deepl"), ("ocr", "tesseract"), ("ocr", "paddle"), ("ocr", "cloud_vision"), ("inpaint", "opencv"), ("inpaint", "lama"), ("image", "gemini")):
    register(_k, _n, unavailable(_n))
