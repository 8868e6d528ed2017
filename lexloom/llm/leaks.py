"""Problem 8: held-out test items inside a training corpus.

Spaced seeds: fixed masks over twelve neighbouring words, some places of which do not count. The seeds of corpus
texts are joined with those of the items; around every hit the two texts are compared word by word along its diagonal.
A run of LEAST equal words holds a hit of every mask, so no exact overlap is missed; an overlap with single words replaced
is hit where the replaced word falls on an open place. Texts become word hashes a whole batch at a time. The corpus is read
once; only texts that may hold a seed of an item, as a filter of bounded size tells, are written and shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.streams import bounded, gram_hashes, mixed, windows, word_hashes
from lexloom.operators.lineage import cut_table
from lexloom.sources.tables import table

WORD = re.compile(r"[^\W_]+")
#: Fixed masks of twelve places, "1" for one that counts.
MASKS = ("111011010111", "110101111011", "101111011101")
PLACES = [[i for i, c in enumerate(m) if c == "1"] for m in MASKS]
SPAN = len(MASKS[0])
#: Words of one exact run that make a leak.
LEAST = 12
#: Bits of the filter for each item seed, and the most bits it has (32 MB); at that size it lets more through to the join.
FILTER_BITS, FILTER_MOST = 64, 1 << 28
#: Tasks that the documents with one seed are spread over.
SALT = 16
#: Pairs of places with a common seed that are listed one by one; where there are more, every diagonal is looked at.
LISTED = 4_000_000


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    return WORD.findall(text.casefold())


def word_ids(ws: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in ws), np.uint64, len(ws))


def batch_seeds(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a row of 64-bit seeds per mask and a column per place where a mask fits, the text of each place), of texts given one after the other."""
    at, text = windows(first, SPAN)
    out = np.zeros((len(MASKS), len(at)), np.uint64)
    for k, places in enumerate(PLACES):
        h = np.full(len(at), 0x9E3779B97F4A7C15 * (k + 1) & (1 << 64) - 1, np.uint64)
        for i in places:
            h = (h ^ (ids[at + i] + np.uint64(i))) * np.uint64(0xFF51AFD7ED558CCD)
            h ^= h >> np.uint64(29)
        out[k] = h
    return out, text


def seeds(ids: np.ndarray) -> np.ndarray:
    """Those of one text."""
    return batch_seeds(ids, np.array([0, len(ids)]))[0]


def dense(same: np.ndarray) -> tuple[int, int, int] | None:
    """(start, places, true ones) of the stretch with the most true ones that make up three quarters of it, the first of equals."""
    at = np.flatnonzero(same)
    if not len(at):
        return None
    # The stretch from the i-th to the j-th true one is dense if g[j] + 1 >= g[i].
    g = 4 * np.arange(len(at)) - 3 * at
    most = np.maximum.accumulate(g[::-1])[::-1]
    last = len(g) - 1 - np.searchsorted(most[::-1], g - 1)
    i = int(np.argmax(last - np.arange(len(g))))
    j = int(last[i])
    return int(at[i]), int(at[j] - at[i] + 1), j - i + 1


def diagonals(doc: np.ndarray, item: np.ndarray) -> list[int]:
    """The diagonals (place in doc less place in item) with a common seed; in texts that repeat themselves a lot, all there are."""
    shift = item.shape[1] - 1
    hit = np.zeros(max(doc.shape[1] + shift, 0), bool)
    listed = 0
    for mx, my in zip(doc, item, strict=True):
        order = np.argsort(mx, kind="stable")
        a, z = np.searchsorted(mx[order], my), np.searchsorted(mx[order], my, "right")
        listed += int((z - a).sum())
        if listed > LISTED:
            return list(range(-shift, doc.shape[1]))
        for j in np.flatnonzero(z > a).tolist():
            hit[order[a[j] : z[j]] - j + shift] = True
    return (np.flatnonzero(hit) - shift).tolist()


def stretches(same: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """Dense stretches with `least` true ones: the one with the most, then those before and after it in the same way."""
    out, todo = [], [(0, len(same))]
    while todo:
        a, z = todo.pop()
        if z - a >= least and (found := dense(same[a:z])) and found[2] >= least:
            start, n, equal = found
            out.append((a + start, n, equal))
            todo += [(a, a + start), (a + start + n, z)]
    return out


def passages(doc: np.ndarray, item: np.ndarray, ks: list[int]) -> list[tuple[int, int, int, int]]:
    """(start in doc, words, equal words, longest run of equal words) of the passages of `doc` that are in `item` too, on the diagonals `ks`.

    A passage has LEAST equal words that make up three quarters of it. Of passages that meet in the document the one with the most equal words
    stands, the first of equals.
    """
    found = []
    for k in ks:
        a, z = max(0, k), min(len(doc), len(item) + k)
        same = doc[a:z] == item[a - k : z - k]
        if np.count_nonzero(same) >= LEAST:
            for start, n, equal in stretches(same):
                edge = np.flatnonzero(np.diff(np.concatenate([[False], same[start : start + n], [False]]).view(np.int8)))
                found.append((-equal, a + start, n, int((edge[1::2] - edge[::2]).max())))
    taken, out = [], []
    for equal, start, n, run in sorted(found):
        i = bisect(taken, (start, 0))
        if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= start + n):
            taken.insert(i, (start, start + n))
            out.append((start, n, -equal, run))
    return sorted(out)


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all rows, where each row's start, and the end) of a column of packed hashes, without a copy where possible."""
    parts = [np.frombuffer(v.as_buffer(), np.uint64) for v in column]
    return np.concatenate([np.zeros(0, np.uint64), *parts]), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _packed(ids: np.ndarray, first: np.ndarray, rows: np.ndarray) -> pa.Array:
    return pa.array([ids[first[r] : first[r + 1]].tobytes() for r in rows.tolist()], pa.binary())


#: The places of a seed in the filter, each a different part of its bits or of their mix.
PROBES = (lambda h: h, lambda h: h >> np.uint64(32), mixed, lambda h: mixed(h) >> np.uint64(32))


def seed_filter(of_items: DataFrame, bits: int) -> np.ndarray:
    """The filter of the seeds of `of_items` (seed) as bytes; parts of it are made where the seeds are, and joined by OR."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seed = b.column("seed").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate([probe(seed) & np.uint64(bits - 1) for probe in PROBES]))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(value.view(np.int64))], ["word", "value"])

    found = of_items.select("seed").mapInArrow(mark, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    out = np.zeros(bits >> 6, np.uint64)
    out[found.word.to_numpy()] = found.value.to_numpy().view(np.uint64)
    return out.view(np.uint8)


def _hits(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents (doc_id, ids) that may hold a seed of an item, items (item_id, item_ids), pairs (doc_id, item_id) with a common seed)."""

    def read_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            ids, first = word_hashes([t.casefold() for t in b.column("text").to_pylist()])
            s, text = batch_seeds(ids, first)
            per = [np.unique(s[:, text == k]).view(np.int64) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), _packed(ids, first, np.arange(b.num_rows)), pa.array(per, pa.list_(pa.int64()))], ["item_id", "item_ids", "seeds"])

    known = cut_table(items.mapInArrow(read_items, "item_id long, item_ids binary, seeds array<long>").where("size(seeds) > 0"))
    of_items = known.select("item_id", F.explode("seeds").alias("seed"))
    total = known.agg(F.sum(F.size("seeds"))).first()[0] or 0
    bits = min(FILTER_MOST, 1 << max(12, (FILTER_BITS * total - 1).bit_length()))
    sieve = docs.sparkSession.sparkContext.broadcast(seed_filter(of_items, bits))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = sieve.value
        for b in bounded(batches, "text"):
            ids, first = word_hashes([t.casefold() for t in b.column("text").to_pylist()])
            found, owner = [], []
            s, text = batch_seeds(ids, first)
            for row in s:
                mine, where = row, text
                for probe in PROBES:
                    at = probe(mine) & np.uint64(bits - 1)
                    ok = (have[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    mine, where = mine[ok], where[ok]
                found.append(mine)
                owner.append(where)
            found, owner = np.concatenate(found), np.concatenate(owner)
            order = np.lexsort((found, owner))
            found, owner = found[order], owner[order]
            new = np.ones(len(found), bool)
            new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
            found, owner = found[new].view(np.int64), owner[new]
            rows, at = np.unique(owner, return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(found)), pa.int32()), pa.array(found))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(rows)), _packed(ids, first, rows), lists], ["doc_id", "ids", "seeds"])

    near = cut_table(docs.mapInArrow(look_up, "doc_id long, ids binary, seeds array<long>"))
    # A seed that many documents share is spread over SALT tasks; the items' side is small and repeated for each.
    left = near.select("doc_id", F.explode("seeds").alias("seed")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)))
    right = of_items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))).withColumn("salt", F.col("salt").cast("long"))
    return near.select("doc_id", "ids"), known.select("item_id", "item_ids"), left.join(right, ["seed", "salt"]).select("doc_id", "item_id").distinct()


def _compared(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, ids, item_ids) of the documents and items with a common seed."""
    docs = docs.where("text is not null and doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    items = items.where("text is not null and item_id is not null").select(F.col("item_id").cast("long"), "text").distinct()
    near, known, pairs = _hits(docs, items)
    return pairs.join(near, "doc_id").join(known, "item_id").select("doc_id", "item_id", "ids", "item_ids")


def leaked_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of the documents that hold LEAST consecutive words of an item: candidates by spaced seeds, then an exact test.

    docs: (doc_id LONG, text), items: (item_id LONG, text); other columns are ignored. Null texts and texts with fewer than twelve words have none. A
    passage shared by several items counts for each of them; repeated rows count once.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = []
            for c in ("ids", "item_ids"):
                ids, first = _words_of(b.column(c))
                at, pair = windows(first, LEAST)
                # The number of the pair goes into the hash, so that a run counts within its own pair only.
                both.append((gram_hashes(ids, at, LEAST) ^ mixed(pair.astype(np.uint64) + np.uint64(1)), pair))
            (x, _), (y, pair) = both
            yield b.select(["doc_id", "item_id"]).take(pa.array(np.unique(pair[np.isin(y, x)])))

    return _compared(docs, items).mapInArrow(verify, "doc_id long, item_id long").distinct()


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, words, equal, run): of each document and item with a common seed, all passages that both hold, single words replaced or not.

    Inputs and hard cases as for `leaked_items`. A passage has LEAST equal words that make up three quarters of it. `start` is the word of the document where
    it starts, `equal` its equal words and `run` its longest run of them. Where passages of one item meet in the document, the one with the
    most equal words stands.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            (xs, x_at), (ys, y_at) = _words_of(b.column("ids")), _words_of(b.column("item_ids"))
            for k, (d, i) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("item_id").to_pylist(), strict=True)):
                x, y = xs[x_at[k] : x_at[k + 1]], ys[y_at[k] : y_at[k + 1]]
                rows += [(d, i, *p) for p in passages(x, y, diagonals(seeds(x), seeds(y)))]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64()] + [pa.int32()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "start", "words", "equal", "run"])

    return _compared(docs, items).mapInArrow(verify, "doc_id long, item_id long, start int, words int, equal int, run int").distinct()


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_items").select("item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaked_items(*_inputs(spark, sf_dir))


def p8_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All leaked passages, single words replaced or not: at least twelve equal words, three quarters of those in between."""
    return leaks(*_inputs(spark, sf_dir))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each leaked item with the number of documents that hold a passage of it."""
    return p8_found(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"))
