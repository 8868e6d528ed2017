"""Problem 1: one consistent text for texts that look the same.

`consistent_texts` rewrites every text in two steps: an appearance-keeping compatibility normalisation that deletes
ignorable signs (`charfold.look`), then a search of each text's look-alike lattice. Every token of Latin, Cyrillic or
Greek letters has one reading per script; a reading's score is the character bigram likelihood of its letters in that
script, and a Viterbi pass over the tokens of the text chooses the readings with a cost for each change of script.
The lattice is built from the class of each letter, never from the letter as written, so texts that look the same
always get the same result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.llm.charfold import CYRILLIC, GREEK, LATIN, PLAIN_TEXT, TO_LATIN, look, script_of
from lexloom.llm.refs import texts
from lexloom.llm.streams import bounded
from lexloom.operators.lineage import cut_table

#: Letters of the bigram model: code points below 0x530 and the extended Latin ones, lower case.
LETTERS = [c for c in map(chr, [*range(0x61, 0x7B), *range(0xDF, 0x180), *range(0x3AC, 0x3CF), *range(0x430, 0x530)]) if script_of(c) and c.lower() == c]
INDEX = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 1
#: Tasks that the records of one class are spread over.
SALT = 16
#: Nats: a change of script between neighbouring tokens, and a letter that the script of a reading lacks.
SWITCH, LACKING = 4.0, 20.0
TOKEN = re.compile(r"[^\W\d_]+(?:[̀-ͯ]+[^\W\d_]*)*")
SCRIPTS = (LATIN, CYRILLIC, GREEK)

#: Letter -> the forms of its class by script.
FORMS: dict[str, dict[str, str]] = {}
for _other, _latin in TO_LATIN.items():
    FORMS.setdefault(_latin, {LATIN: _latin}).setdefault(script_of(_other), _other)
for _other, _latin in TO_LATIN.items():
    FORMS[_other] = FORMS[_latin]


def bigram_counts(rows: DataFrame) -> DataFrame:
    """(pair INT, n LONG) over the whole text column: letter bigrams within a script, with word starts and ends.

    The table is bounded by the alphabet (SIZE squared), whatever the input.
    """
    lut = np.zeros(0x10001, np.int64)
    kind = np.zeros(SIZE, np.int8)
    for cp in range(0x530):
        c = chr(cp).lower()
        if len(c) == 1 and c in INDEX:
            lut[cp] = INDEX[c]
            kind[INDEX[c]] = 1 + SCRIPTS.index(script_of(c))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE * SIZE, np.int64)
        for b in bounded(batches, "text"):
            cps = np.frombuffer((" " + " ".join(b.column(0).to_pylist()) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
            i = lut[np.minimum(cps, 0x10000)]
            a, z = i[:-1], i[1:]
            same = (kind[a] == kind[z]) | (a == 0) | (z == 0)
            total += np.bincount((a * SIZE + z)[same], minlength=SIZE * SIZE)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["pair", "n"])

    return rows.select("text").mapInArrow(count, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


class Readings:
    """Viterbi over the script readings of the tokens of one text."""

    def __init__(self, counts: dict[int, int]) -> None:
        n = np.full((SIZE, SIZE), 0.0)
        for pair, k in counts.items():
            n[pair // SIZE, pair % SIZE] = k
        self.logp: dict[str, np.ndarray] = {}
        script = np.array([""] + [script_of(c) for c in LETTERS])
        for s in SCRIPTS:
            own = script == s
            own[0] = True
            m = np.where(own[:, None] & own[None, :], n + 0.5, 0.0)
            m[0, 0] = 0
            with np.errstate(divide="ignore", invalid="ignore"):
                self.logp[s] = np.log(np.maximum(m / np.maximum(m.sum(1, keepdims=True), 1e-9), 1e-7))
        self.memo: dict[str, tuple] = {}

    def token(self, tok: str) -> tuple:
        """(reading, score) per script, in the order of SCRIPTS; None for a script with no letter of the token."""
        if (r := self.memo.get(tok)) is not None:
            return r
        out = []
        for s in SCRIPTS:
            score, last, text, own, logp = 0.0, 0, [], 0, self.logp[s]
            for c in tok:
                f = FORMS.get(c)
                w = f.get(s) if f else c if script_of(c) == s else None
                if w is None:
                    score -= LACKING
                    w = f[LATIN] if f else c
                    last = 0
                else:
                    own += 1
                    i = INDEX.get(w.lower(), 0)
                    score += logp[last, i] if i else -8.0
                    last = i
                text.append(w)
            score += logp[last, 0]
            out.append(("".join(text), score) if own else None)
        if len(self.memo) > 200_000:
            self.memo.clear()
        self.memo[tok] = r = tuple(out)
        return r

    def best(self, text: str) -> str:
        spans = [(m.start(), m.end(), self.token(m.group())) for m in TOKEN.finditer(text)]
        spans = [s for s in spans if any(s[2])]
        if not spans:
            return text
        score, back = [0.0, 0.0, 0.0], []
        for _, _, readings in spans:
            top = max(range(3), key=score.__getitem__)
            now, how = [], []
            for k in range(3):
                stay, move = score[k], score[top] - SWITCH
                frm = k if stay >= move else top
                r = readings[k]
                now.append(max(stay, move) + (r[1] if r else -LACKING * 4))
                how.append(frm)
            score = now
            back.append(how)
        k = max(range(3), key=score.__getitem__)
        chosen = []
        for (_, _, readings), how in zip(reversed(spans), reversed(back), strict=True):
            chosen.append(readings[k][0] if readings[k] else next(r for r in readings if r)[0])
            k = how[k]
        out, at = [], 0
        for (a, z, _), w in zip(spans, reversed(chosen), strict=True):
            out += [text[at:a], w]
            at = z
        return "".join([*out, text[at:]])


def _needs_search(t: str) -> bool:
    """Whether the text has letters of Cyrillic or Greek that look Latin, or the reverse beside such script."""
    return not t.isascii() and bool(_OTHER.search(t))


_OTHER = re.compile("[Ͱ-ԯ]")


def consistent_texts(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`rows` (with a string column `text`) plus `consistent`, the one form of all texts that look the same.

    Null gives null, an empty text an empty one. Texts of any length are handled whole. Extra columns are kept; a column
    named `consistent` is replaced. Only texts that PLAIN_TEXT does not match leave the JVM.
    """
    cols = [c for c in (keep or rows.columns) if c != "consistent"]
    counts = {r.pair: r.n for r in bigram_counts(rows.where(F.col("text").isNotNull())).collect()}
    readings = rows.sparkSession.sparkContext.broadcast(counts)
    plain = F.col("text").isNull() | F.col("text").rlike(PLAIN_TEXT)
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*cols).dtypes) + ", consistent string"

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Readings(readings.value)
        for b in bounded(batches, "text"):
            done = [model.best(v) if _needs_search(v := look(t)) else v for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(done, pa.string())], [*b.schema.names, "consistent"])

    rows = rows.select(*cols)
    return rows.where(plain).withColumn("consistent", F.col("text")).unionByName(rows.where(~plain).mapInArrow(rewrite, schema))


def letters_and_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))


def _forms(rows: DataFrame, least: int) -> DataFrame:
    """(ref, raw, form, rewritten): digests of the text and of its consistent form, of records with enough letters and digits."""
    form = consistent_texts(rows.where(F.col("text").isNotNull()).select("ref", "text"))
    form = form.where(letters_and_digits(F.col("consistent")) >= least).select(
        "ref", F.xxhash64("text").alias("raw"), F.unhex(F.md5("consistent")).alias("form"), (F.col("text") != F.col("consistent")).alias("rewritten")
    )
    return cut_table(form)


def same_look_pairs(rows: DataFrame, least: int = 20) -> DataFrame:
    """(ref_a, ref_b): records of `rows` (ref, text) whose texts look the same and differ in characters.

    Of two such texts at least one differs from the consistent form, so the (few) rewritten records are joined with all
    records on a digest of that form; no pair within a group of equal texts is ever made. Null texts and texts with fewer than
    `least` letters and digits give nothing; repeated records count once.
    """
    form = _forms(rows, least)
    odd = form.where("rewritten").select(F.col("ref").alias("ref_1"), F.col("raw").alias("raw_1"), "form").distinct()
    pairs = odd.join(form, "form").where((F.col("raw") != F.col("raw_1")) & (F.col("ref") != F.col("ref_1")))
    return pairs.select(F.least("ref", "ref_1").alias("ref_a"), F.greatest("ref", "ref_1").alias("ref_b")).distinct()


def same_look_classes(rows: DataFrame, least: int = 20) -> DataFrame:
    """(ref, ref_first, text_no, links): each record whose text looks like a different one, with its class's smallest reference, the number of its own
    spelling within the class, and how many records it is linked to: those of the class with other spellings.

    As many rows as records, whatever the size of a class: classes and spellings are counted before they are joined back, and the records of one class are
    spread over SALT tasks. Cases as for `same_look_pairs`.
    """
    form = _forms(rows, least).select("ref", "raw", "form").distinct()
    spellings = form.groupBy("form", "raw").agg(F.min("ref").alias("own_first"), F.count("*").alias("own"))
    classes = spellings.groupBy("form").agg(F.min("own_first").alias("ref_first"), F.sum("own").alias("all"), F.count("*").alias("spellings")).where("spellings > 1")
    # A class has few spellings, but each may have many records.
    numbered = spellings.join(classes, "form").withColumn("text_no", F.row_number().over(Window.partitionBy("form").orderBy("own_first")))
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long")))
    few = numbered.select("form", "raw", "ref_first", "text_no", (F.col("all") - F.col("own")).alias("links"), salts.alias("salt"))
    return form.withColumn("salt", F.pmod(F.xxhash64("ref"), F.lit(SALT))).join(few, ["form", "raw", "salt"]).select("ref", "ref_first", "text_no", "links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return same_look_pairs(texts(spark, sf_dir, block="source_text", region="source_text"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of `p1_found` as classes: a row for each record that has one, with its class and its number of links."""
    return same_look_classes(texts(spark, sf_dir, block="source_text", region="source_text"))


def p1_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every block and region with its consistent text."""
    return consistent_texts(texts(spark, sf_dir, block="source_text", region="source_text")).distinct()
