"""Documents of several formats as tables, and tables back to documents."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lexloom.functions.text import language
from lexloom.sources import office, webpages
from lexloom.sources.schemas import BLOCKS, DOCUMENTS, IMAGES, VERSION

PARSERS: dict[str, Callable] = {"docx": office.parse_docx, "pptx": office.parse_pptx, "html": webpages.parse, "htm": webpages.parse}
RENDERERS: dict[str, Callable] = {"docx": office.render_docx, "pptx": office.render_pptx, "html": webpages.render, "htm": webpages.render}


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, doc_type, content) of the files under a path or glob; the id is a hash of the path."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select(F.substring(F.sha2("path", 256), 1, 12).alias("doc_id"), "path", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)).alias("doc_type"), "content")


def _parsed(files: DataFrame, ddl: str, pick: Callable) -> DataFrame:
    schema: StructType = _parse_datatype_string(ddl)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for d in b.to_pylist():
                try:
                    parts, error = PARSERS[d["doc_type"]](d["content"]), None
                except KeyError:
                    parts, error = ({}, [], []), f"no parser for {d['doc_type']!r}; there are {', '.join(sorted(PARSERS))}"
                except Exception as e:
                    parts, error = ({}, [], []), f"{type(e).__name__}: {e}"
                out += pick(d, *parts, error)
            yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in arrow.names} for r in out], schema=arrow)

    return files.mapInArrow(run, schema)


def documents_of(files: DataFrame) -> DataFrame:
    """A row for each file; a file that can't be read has an `error` and no blocks."""
    return _parsed(files, DOCUMENTS, lambda d, fields, blocks, images, error: [{k: d[k] for k in ("doc_id", "path", "doc_type")} | fields | {"schema_version": VERSION, "error": error}])


def blocks_of(files: DataFrame) -> DataFrame:
    return _parsed(files, BLOCKS, lambda d, fields, blocks, images, error: [b | {"doc_id": d["doc_id"], "ord": i} for i, b in enumerate(blocks)])


def images_of(files: DataFrame) -> DataFrame:
    return _parsed(files, IMAGES, lambda d, fields, blocks, images, error: [x | {"doc_id": d["doc_id"], "ord": i} for i, x in enumerate(images)])


def rendered(files: DataFrame, blocks: DataFrame, images: DataFrame | None = None, languages: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, doc_type, content, error): every file with the targets of its blocks put in; null targets leave the text.

    `images` (doc_id, id, content) replaces pictures, null contents none; `languages` (doc_id, target_lang) marks the new texts as of a language. Blocks with
    `constraints` say which texts may shrink, and how far. What belongs to one document travels together with its bytes; documents are independent.
    """
    limits = F.col("constraints") if "constraints" in blocks.columns else F.lit(None)
    todo = blocks.where("target_text is not null").select("doc_id", "id", "target_text", F.to_json(limits).alias("limits") if "constraints" in blocks.columns else F.lit(None).cast("string").alias("limits"))
    j = files.select("doc_id", "path", "doc_type", "content").join(todo.groupBy("doc_id").agg(F.collect_list(F.struct("id", "target_text", "limits")).alias("todo")), "doc_id", "left")
    none = {"pictures": "array<struct<id:string,content:binary>>", "tag": "string"}
    if images is not None:
        j = j.join(images.where("content is not null").groupBy("doc_id").agg(F.collect_list(F.struct("id", "content")).alias("pictures")), "doc_id", "left")
    if languages is not None:
        j = j.join(languages.select("doc_id", F.coalesce(language(F.col("target_lang"))["tag"], F.col("target_lang")).alias("tag")), "doc_id", "left")
    j = j.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in j.columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, error = [], []
            for d in b.to_pylist():
                try:
                    todo = d["todo"] or []
                    args = {x["id"]: x["target_text"] for x in todo}, {x["id"]: x["content"] for x in d["pictures"] or []}
                    content.append(RENDERERS[d["doc_type"]](d["content"], *args, d["tag"], {x["id"]: json.loads(x["limits"]) for x in todo if x["limits"]}))
                    error.append(None)
                except Exception as e:
                    content.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            cols = [b.column(k) for k in ("doc_id", "path", "doc_type")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(content, pa.binary()), pa.array(error, pa.string())], ["doc_id", "path", "doc_type", "content", "error"])

    return j.mapInArrow(run, "doc_id string, path string, doc_type string, content binary, error string")


def download_name() -> Column:
    """`localized-{source}-to-{target}.{type}` for columns source_lang, target_lang and doc_type."""
    return F.format_string("localized-%s-to-%s.%s", "source_lang", "target_lang", "doc_type")


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """(term, preferred) of a glossary in CSV: rows with two columns and a term, trimmed; of equal terms the last row counts, of several files the last in the order of their names."""
    lines = spark.read.schema("term string, preferred string").option("mode", "PERMISSIVE").csv(path).withColumn("n", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k")))
    kept = lines.where("trim(term) != '' and preferred is not null").select(F.trim("term").alias("term"), F.trim("preferred").alias("preferred"), "n")
    return kept.groupBy("term").agg(F.max_by("preferred", "n").alias("preferred"))


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a recogniser's TSV; rows without text or with a number that can't be read are dropped, a missing confidence is -1."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    number = [F.expr(f"try_cast(`{c}` as int)").alias(c) for c in ("block_num", "par_num", "line_num", "left", "top", "width", "height")]
    words = raw.where("trim(text) != ''").select(*number, F.coalesce(F.expr("try_cast(conf as double)"), F.lit(-1.0)).alias("confidence"), F.col("text").alias("word"))
    return words.dropna()


def as_json(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """(doc_id, json): each document with its blocks in order, nested."""
    b = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", *(c for c in blocks.columns if c not in ("doc_id", "ord"))))).alias("blocks"))
    j = documents.join(b, "doc_id", "left")
    return j.select("doc_id", F.to_json(F.struct(*documents.columns, "blocks")).alias("json"))
