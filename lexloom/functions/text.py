"""Text expressions of the localization model, as Spark columns; only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A character that is not white space, in any script.
NOT_BLANK = r"[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Capitals that count as words though they have two or three letters.
ACRONYMS = ("AI", "BI", "IT", "IP", "KM", "RND", "SAP", "BOM", "CAD", "ERP", "LLM")
HAN = r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
# The three languages with an OCR profile (name, language tag of presentations, codes of two recognisers), and their aliases.
LANGUAGES = {
    "en": ("English", "en-US", "eng", "en"),
    "de": ("German (de-DE)", "de-DE", "deu+eng", "german"),
    "zh": ("Simplified Chinese (zh-CN)", "zh-CN", "chi_sim+eng", "ch"),
}
LANGUAGE_FIELDS = ("name", "tag", "tesseract", "paddle")
ALIASES = {"en": "en", "de": "de", "zh": "zh", "en-us": "en", "en-gb": "en", "de-de": "de", "zh-cn": "zh", "zh-hans": "zh", "zh_hans": "zh"}
#: Weight from which a letter counts as bold.
BOLD = 700
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}


def not_blank(c: Column) -> Column:
    return c.rlike(NOT_BLANK)


def alnum_count(c: Column) -> Column:
    """Letters and digits."""
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def alpha_count(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}]", ""))


def looks_like(c: Column, lang: Column) -> Column:
    """Whether a text is in the script of a language; any text with a sign fits languages without a rule."""
    return F.when(lang == "zh", c.rlike(HAN)).when(lang.isin("en", "de"), c.rlike("[A-Za-z]")).otherwise(not_blank(c))


def meaningful_word(c: Column) -> Column:
    """At least three letters, two with Chinese ones, or a known acronym."""
    letters = F.regexp_replace(c, r"[^\p{L}]", "")
    return F.when(letters.rlike(r"[\x{3400}-\x{9FFF}]"), F.length(letters) >= 2).otherwise((F.length(letters) >= 3) | F.upper(letters).isin(*ACRONYMS))


def protected_mark(c: Column) -> Column:
    """An all-capitals mark of up to sixteen ASCII letters in up to three tokens: it may stay as it is."""
    letters = F.regexp_replace(c, "[^A-Za-z]", "")
    return (F.length(letters) > 0) & (F.upper(letters) == letters) & (F.length(letters) <= 16) & (F.regexp_count(c, F.lit("[A-Za-z0-9]+")) <= 3)


def ocr_clean(c: Column) -> Column:
    """White space made single, none between Chinese signs, before closing or after opening punctuation."""
    c = F.trim(F.regexp_replace(c, r"\s+", " "))
    c = F.regexp_replace(c, rf"(?<={HAN}) (?={HAN})", "")
    return F.regexp_replace(F.regexp_replace(c, r" ([,.;:!?%)\]}，。；：！？）】》])", "$1"), r"([(\[{（【《]) ", "$1")


def apply_terms(c: Column, terms: list[tuple[str, str]]) -> Column:
    """Replace each term by its preferred form, case-sensitively, one after the other."""
    for term, preferred in terms:
        c = F.replace(c, F.lit(term), F.lit(preferred))
    return c


def pseudo_translation(c: Column, lang: Column, terms: list[tuple[str, str]]) -> Column:
    """`[lang] text` with the glossary applied: the engine for dry runs."""
    return F.concat(F.lit("["), lang, F.lit("] "), apply_terms(c, terms))


def supported_language(c: Column) -> Column:
    """The code behind an alias, or null."""
    table = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return F.element_at(table, F.lower(F.trim(c)))


def language(c: Column) -> Column:
    """code and LANGUAGE_FIELDS of a language named by code or alias as a struct, or null."""
    rows = F.create_map(*(x for k, v in LANGUAGES.items() for x in (F.lit(k), F.struct(*(F.lit(a).alias(n) for n, a in zip(("code", *LANGUAGE_FIELDS), (k, *v), strict=True))))))
    return F.element_at(rows, supported_language(c))


def mime_of(path: Column) -> Column:
    """MIME type by suffix; anything unknown counts as PNG."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair)), suffix), F.lit("image/png"))


def format_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^.]+)$", 1))


def colour(c: Column, part: int) -> Column:
    """Red, green or blue (0 to 2) of #RRGGBB or #RGB; 24 for anything else."""
    long = F.conv(F.substring(c, 2 + 2 * part, 2), 16, 10).cast("int")
    short = F.conv(F.repeat(F.substring(c, 2 + part, 1), 2), 16, 10).cast("int")
    return F.when(c.rlike("^#[0-9A-Fa-f]{6}$"), long).when(c.rlike("^#[0-9A-Fa-f]{3}$"), short).otherwise(24)


def style_font(style: Column) -> Column:
    """name, size, color, bold, italic of an inline CSS style, read declaration by declaration."""
    parts = F.transform(F.split(style, ";"), lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("key"), F.trim(F.substr(d, F.instr(d, ":") + 1)).alias("value")))
    of = lambda *keys: F.try_element_at(F.filter(parts, lambda d: d["key"].isin(*keys)), F.lit(-1))["value"]
    weight, colour_ = F.lower(of("font-weight")), F.upper(of("color"))
    return F.struct(
        F.nullif(F.trim(F.translate(F.substring_index(of("font-family"), ",", 1), "\"'", "")), F.lit("")).alias("name"),
        F.nullif(F.regexp_extract(of("font-size"), r"^([0-9]*[.]?[0-9]+)", 1), F.lit("")).cast("double").alias("size"),
        F.when(colour_.rlike("^#([0-9A-F]{3}|[0-9A-F]{6})$"), colour_).alias("color"),
        F.coalesce(weight.isin("bold", "bolder") | (weight.try_cast("int") >= BOLD), F.lit(False)).alias("bold"),
        F.coalesce(F.lower(of("font-style")) == "italic", F.lit(False)).alias("italic"),
    )


def json_objects(c: Column) -> Column:
    """The regions in a recogniser's JSON answer, as an array of JSON strings: an array, the array `regions` of an object, in a fence or not; empty if unreadable."""
    fenced = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")), c)
    inside = F.regexp_extract(fenced, r"(?s)(\[.*\])", 1)
    read = [F.from_json(x, "array<string>") for x in (F.get_json_object(fenced, "$.regions"), fenced, inside)]
    return F.coalesce(*(F.when(F.size(F.filter(r, lambda x: x.isNotNull())) == F.size(r), r) for r in read), F.array().cast("array<string>"))


def lines_or(c: Column, fallback: Column) -> Column:
    """The lines of an answer without marks around them, where there are as many as in `fallback`; else `fallback`."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.btrim(x, F.lit(" -\t\r\n\"'"))), lambda x: x != "")
    return F.when(F.size(lines) == F.size(fallback), lines).otherwise(fallback)


def json_array(c: Column) -> Column:
    """The string array in a model's answer: plain, in a code fence, or within other text; null if there is none."""
    inner = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.coalesce(*(F.from_json(x, "array<string>") for x in (c, fenced, inner)))


def fit_length(values: Column, fallback: Column) -> Column:
    """`values` cut or padded from `fallback` to its length."""
    return F.slice(F.concat(values, F.slice(fallback, F.size(values) + 1, F.greatest(F.size(fallback) - F.size(values), F.lit(0)))), 1, F.size(fallback))


def normal_form(text: str | None) -> str:
    """Compatibility form, case-folded, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", text or "").casefold() if c.isalnum())


@F.pandas_udf(StringType())
def norm_text(s: pd.Series) -> pd.Series:
    return s.map(normal_form)
