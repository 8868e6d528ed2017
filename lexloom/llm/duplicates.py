"""Problem 5: records that are equal but for formatting.

`fold_hashes` streams the characters of a whole Arrow batch through the skip-and-fold table of `charfold` into four
rolling polynomial hashes per row, without ever building a canonical string. Rows whose hashes agree are compared by
`same_content`, which walks both texts with one pointer each and skips what does not count.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.charfold import fold_table
from lexloom.llm.refs import texts
from lexloom.llm.streams import bounded
from lexloom.operators.lineage import cut_table

PRIMES = tuple(np.uint64(p) for p in (2147483647, 2147483629, 2147483587, 2147483579))
BASES = tuple(np.uint64(b) for b in (1000003, 1048583, 1299709, 1500007))

#: A field's key: at the start or after a separator, at most four words, a colon, and no colon before it in the field.
_W = r"\w'­̀-ͯ​-‏⁠-⁤︀-️﻿-"
KEY = re.compile(rf"(?:^|[;,/|\n；，、])[^\w;,/|\n；，、]*(\w[{_W}]*(?:\s+[{_W}]+){{0,3}})\s*[:：]")
_WORD = re.compile(r"\w")
DIGIT, ALPHA, IGNORED, BREAK, OTHER = 1, 2, 3, 4, 0


@lru_cache(1)
def kind_table() -> np.ndarray:
    """Of each character: its role beside a sign or a decimal mark."""
    out = np.zeros(0x10001, np.int8)
    for cp in range(0x10000):
        c = ud.category(chr(cp))
        out[cp] = DIGIT if c == "Nd" else ALPHA if c[0] in "LMN" else IGNORED if c == "Cf" or 0xFE00 <= cp <= 0xFE0F else BREAK if cp in (10, 13) else OTHER
    out[0x10000] = ALPHA
    return out


@lru_cache(1)
def _single() -> np.ndarray:
    """Of each character, the symbol it folds to if that is one of - . , > and else 0."""
    first, count, symbols = fold_table()
    out = np.zeros(0x10001, np.uint32)
    for cp in range(0x10000):
        if count[cp] == 1 and chr(symbols[first[cp]]) in "-.,>":
            out[cp] = symbols[first[cp]]
    return out


def starts_of_fields(text: str) -> list[int]:
    """Where the `key: value` fields of a text start; empty unless there are two or more with different keys, the first at the start."""
    found = [(m.start(), m.group(1)) for m in KEY.finditer(text)] if text.count(":") + text.count("：") > 1 else []
    if len(found) < 2 or _WORD.search(text, 0, found[0][0]) or len({k.casefold() for _, k in found}) < len(found):
        return []
    return [s for s, _ in found]


def _powers(base: np.uint64, prime: np.uint64, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        k = min(done, n - done)
        out[done : done + k] = out[:k] * (out[done - 1] * base % prime) % prime
        done += k
    return out


def fold_stream(rows: list[str], signs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, place of each in the joined rows): what counts of the characters, in order.

    With `signs`, a minus before a number and a point or comma within one count; else no punctuation does.
    """
    cps = np.frombuffer(("\n".join(rows) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.minimum(cps, 0x10000)
    kind = kind_table()[low]
    at = np.flatnonzero(kind != IGNORED)
    low, kind, cps = low[at], kind[at], cps[at]
    first, count, symbols = fold_table()
    n = count[low].astype(np.int64)
    mark = _single()[low]
    i = np.flatnonzero(mark)
    if len(i):
        before, after = np.where(i > 0, kind[i - 1], BREAK), kind[np.minimum(i + 1, len(kind) - 1)]
        m = mark[i]
        place = np.arange(len(kind))
        word, line = (np.maximum.accumulate(np.where(x, place, -1)) for x in ((kind == DIGIT) | (kind == ALPHA), kind == BREAK))
        keep = np.where(m == ord("-"), (after == DIGIT) & (before != DIGIT) & (before != ALPHA), np.where(m == ord(">"), word[i] > line[i], (before == DIGIT) & (after == DIGIT)))
        n[i] = keep & signs
    far = low == 0x10000
    n[far] = 1
    total = int(n.sum())
    ends = np.cumsum(n)
    src = np.repeat(first[low].astype(np.int64), n) + np.arange(total) - np.repeat(ends - n, n)
    out = symbols[np.minimum(src, len(symbols) - 1)]
    if far.any():
        out[np.repeat(far, n)] = cps[far]
    return out, np.repeat(at, n)


@lru_cache(1)
def _counts() -> np.ndarray:
    out = np.zeros(0x10001, bool)
    for cp in range(0x10000):
        out[cp] = ud.category(chr(cp))[0] in "LN"
    out[0x10000] = True
    return out


def fold_hashes(rows: list[str], signs: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, size): two 62-bit hashes of what counts in each row and its number of letters and digits.

    Rows of `key: value` fields give the sum of their fields' hashes, whatever the order of the fields.
    """
    n = len(rows)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.zeros(n + 1, np.int64)
    np.cumsum([len(r) + 1 for r in rows], out=starts[1:])
    segment = [starts[:-1]]
    if signs:
        for k, r in enumerate(rows):
            if (f := starts_of_fields(r)):
                segment.append(np.array(f[1:], np.int64) + starts[k])
    segment = np.sort(np.concatenate(segment))
    symbols, place = fold_stream(rows, signs)
    cut = np.searchsorted(place, segment)
    ends = np.append(cut[1:], len(place))
    owner = np.searchsorted(starts, segment, "right") - 1
    pos = np.arange(len(place)) - np.repeat(cut, ends - cut)
    s = symbols.astype(np.uint64) + np.uint64(1)
    parts = []
    longest = int((ends - cut).max(initial=1)) + 1
    for base, prime in zip(BASES, PRIMES, strict=True):
        total = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(s * _powers(base, prime, longest)[pos] % prime, out=total[1:])
        parts.append((total[ends] - total[cut]) % prime)
    mixed = []
    for a, b in (parts[:2], parts[2:]):
        h = (a << np.uint64(31)) ^ b
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        row = np.zeros(n, np.uint64)
        np.add.at(row, owner, np.where(ends > cut, h, np.uint64(0)))
        mixed.append(row.view(np.int64))
    sizes = np.zeros(len(s) + 1, np.int64)
    np.cumsum(_counts()[np.minimum(symbols, 0x10000)], out=sizes[1:])
    edge = np.searchsorted(place, starts)
    return mixed[0], mixed[1], sizes[edge[1:]] - sizes[edge[:-1]]


def _walk(text: str, signs: bool) -> Iterator[int]:
    """The symbols that count, one after the other."""
    first, count, symbols = fold_table()
    kind, single = kind_table(), _single()
    before, n, begun = BREAK, len(text), False
    for i, ch in enumerate(text):
        cp = min(ord(ch), 0x10000)
        k = kind[cp]
        if k == IGNORED:
            continue
        if cp == 0x10000:
            yield ord(ch)
        elif m := single[cp]:
            j = i + 1
            while j < n and kind[min(ord(text[j]), 0x10000)] == IGNORED:
                j += 1
            after = kind[min(ord(text[j]), 0x10000)] if j < n else BREAK
            if signs and (after == DIGIT and before not in (DIGIT, ALPHA) if m == 45 else begun if m == 62 else before == DIGIT and after == DIGIT):
                yield int(m)
        else:
            yield from symbols[first[cp] : first[cp] + count[cp]].tolist()
        before = k
        begun = k != BREAK and (begun or k in (DIGIT, ALPHA))


def same_content(a: str, b: str, signs: bool = True) -> bool:
    """Whether two texts are equal but for formatting, by one walk over both."""
    fa, fb = (starts_of_fields(a), starts_of_fields(b)) if signs else ([], [])
    if fa or fb:
        cut = lambda t, f: sorted(tuple(_walk(t[x:y], signs)) for x, y in zip([0, *f[1:]], [*f[1:], len(t)], strict=True))
        return cut(a, fa or [0]) == cut(b, fb or [0])
    return all(x == y for x, y in zip_longest(_walk(a, signs), _walk(b, signs)))


def formatting_classes(rows: DataFrame, least: int = 20, signs: bool = True, single: bool = False) -> DataFrame:
    """(ref, ref_first, copies) of every record of `rows` (ref, text) that has an equal one, with `single` of the others too (copies 1);
    ref_first is the class's smallest.

    Equal is: the same but for blanks, case, punctuation, order of `key: value` fields, and look-alike characters.
    Null texts and texts with fewer than `least` letters and digits have no class; if `least` is 0, texts of nothing but formatting are one class. Records repeated as a whole count
    once per `ref`. Whatever the size of a class, no task sees more of it than its share: classes are aggregated
    before the shuffle and joined back by hash, where adaptive execution splits a hot one.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            t = b.column("text").to_pylist()
            high, low, size = fold_hashes(t, signs)
            out = pa.RecordBatch.from_arrays([b.column("ref"), b.column("text"), b.column("raw"), pa.array(high), pa.array(low), pa.array(size)], ["ref", "text", "raw", "h1", "h2", "size"])
            yield out.filter(pc.greater_equal(out.column("size"), least))

    all_rows = cut_table(rows.where(F.col("text").isNotNull()).select("ref", "text", F.xxhash64("text").alias("raw")).mapInArrow(hashed, "ref string, text string, raw long, h1 long, h2 long, size long").drop("size"))
    groups = all_rows.groupBy("h1", "h2").agg(F.min("ref").alias("ref_first"), F.count("*").alias("n"), F.min("raw").alias("a"), F.max("raw").alias("z"))
    alone = groups.where("n = 1").select(F.col("ref_first").alias("ref"), "ref_first", F.lit(1).cast("long").alias("copies"))
    groups = groups.where("n > 1").select("h1", "h2", "ref_first", (F.col("a") != F.col("z")).alias("mixed"))
    members = all_rows.join(groups, ["h1", "h2"])
    plain = members.where("not mixed").select("h1", "h2", "ref", "ref_first", F.lit(None).cast("string").alias("other"))
    leaders = members.where("mixed and ref = ref_first").select("h1", "h2", F.col("text").alias("text_first")).distinct()

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            other = []
            for x, y in zip(b.column("text").to_pylist(), b.column("text_first").to_pylist(), strict=True):
                other.append(None if x == y or same_content(x, y, signs) else ",".join(map(str, _walk(x, signs))))
            yield pa.RecordBatch.from_arrays([b.column("h1"), b.column("h2"), b.column("ref"), b.column("ref_first"), pa.array(other, pa.string())], ["h1", "h2", "ref", "ref_first", "other"])

    checked = members.where("mixed").join(leaders, ["h1", "h2"]).select("h1", "h2", "ref", "ref_first", "text", "text_first")
    checked = checked.mapInArrow(verified, "h1 long, h2 long, ref string, ref_first string, other string")
    both = cut_table(plain.unionByName(checked).distinct())
    # A collision leaves its class; records that collide with each other still form one.
    own = both.where("other is not null").groupBy("h1", "h2", "other").agg(F.min("ref").alias("own_first"))
    both = both.join(own, ["h1", "h2", "other"], "left").select("ref", F.coalesce("own_first", "ref_first").alias("ref_first"))
    sizes = both.groupBy("ref_first").agg(F.count("*").alias("copies"))
    members = both.join(sizes if single else sizes.where("copies > 1"), "ref_first").select("ref", "ref_first", "copies")
    return members.unionByName(alone) if single else members


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_first, copies): one record per distinct content, whatever its length, with its number of records."""
    blocks = formatting_classes(texts(spark, sf_dir, block="source_text"), 0, single=True)
    hashes = formatting_classes(texts(spark, sf_dir, selection="content_hash"), 0, False, single=True)
    return blocks.unionByName(hashes).select("ref_first", "copies").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = formatting_classes(texts(spark, sf_dir, block="source_text"))
    hashes = formatting_classes(texts(spark, sf_dir, selection="content_hash"), 1, False)
    both = blocks.unionByName(hashes).where("ref != ref_first")
    return both.select("ref_first", F.col("ref").alias("ref_copy"))
