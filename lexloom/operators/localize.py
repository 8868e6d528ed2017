"""The text path from blocks to targets: context, glossary, limits, engine requests, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.functions.text import fit_length, json_array
from lexloom.operators import blocks as B

#: Texts of one engine request at most.
REQUEST = 100


def requests(blocks: DataFrame, documents: DataFrame, glossary: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, slide, part, source_lang, target_lang, ids, texts, limits, context, terms): engine requests of up to REQUEST texts of a slide, in block order."""
    b = B.translatable(blocks).select("doc_id", B.slide_of().alias("slide"), "ord", "id", "source_text", B.max_chars().alias("limit"))
    place = F.row_number().over(Window.partitionBy("doc_id", "slide").orderBy("ord")) - 1
    b = b.withColumn("part", F.floor(place / REQUEST).cast("int"))
    items = F.array_sort(F.collect_list(F.struct("ord", "id", "source_text", "limit")))
    r = b.groupBy("doc_id", "slide", "part").agg(items.alias("items"))
    part = lambda k: F.transform("items", lambda x: x[k])
    r = r.select("doc_id", "slide", "part", part("id").alias("ids"), part("source_text").alias("texts"), part("limit").alias("limits"))
    r = r.join(B.slide_context(blocks), ["doc_id", "slide"])
    held = F.filter(F.array(*(F.struct(F.lit(t).alias("term"), F.lit(p).alias("preferred")) for t, p in glossary)), lambda g: F.exists("texts", lambda t: F.lower(t).contains(F.lower(g["term"]))))
    return r.withColumn("terms", held).join(documents.select("doc_id", "source_lang", "target_lang"), "doc_id")


def prompt() -> Column:
    """The request as text for a language model: task, context, terms, lengths to aim at, texts as JSON."""
    limits = F.filter(F.transform("limits", lambda x, i: F.struct(i.alias("index"), x.alias("max_chars"))), lambda x: x["max_chars"].isNotNull())
    return F.concat_ws(
        "\n\n",
        F.format_string("Translate each string of the JSON array below from %s into %s. Answer with a JSON array of as many strings in the same order and nothing else.", "source_lang", "target_lang"),
        F.concat(F.lit("Context: "), F.col("context")),
        F.when(F.size("terms") > 0, F.concat(F.lit("Use these terms: "), F.to_json("terms"))),
        F.when(F.size(limits) > 0, F.concat(F.lit("Lengths to aim at, never at the cost of words or meaning: "), F.to_json(limits))),
        F.to_json("texts"),
    )


def answered(requests: DataFrame, answer: Column) -> DataFrame:
    """(doc_id, id, target_text) from the answer column of requests: its JSON array fitted to the texts, which stand in for what is missing."""
    texts = fit_length(F.coalesce(json_array(answer), F.array().cast("array<string>")), F.col("texts"))
    pair = F.explode(F.arrays_zip(F.col("ids").alias("id"), texts.alias("target_text")))
    return requests.select("doc_id", pair.alias("p")).select("doc_id", "p.*")


def localized(blocks: DataFrame, documents: DataFrame, glossary: list[tuple[str, str]], engine: Callable[[Column, Column], Column]) -> DataFrame:
    """(doc_id, id, target_text) of all translatable blocks, by an engine that maps (texts, target language) columns to an array column."""
    r = requests(blocks, documents, glossary)
    return answered(r, F.to_json(engine(F.col("texts"), F.col("target_lang"))))


def cache_key(*parts: Column) -> Column:
    """SHA-256 over the parts with a separator that no part holds; null parts count as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
