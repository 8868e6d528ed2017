"""Problem 7: filling containers of fixed capacity with documents, similar ones together.

Documents are spread over shards of bounded size, those of one source side by side. Each shard has its own BM25 inverted index: the largest unused
document seeds a container, the index returns its unused neighbours, and these fill the window in the order of their scores as far as they fit; what
space is left takes the largest unused documents that still fit. Only a document longer than a container is split.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.streams import bounded, owners, word_hashes
from lexloom.operators.lineage import cut_table
from lexloom.sources.tables import table

CAPACITY = 2048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Documents of a shard, the most one task holds; neighbours are looked for inside a shard.
SHARD = 4000
#: Telling terms of a seed that are looked up, and BM25's two constants.
TERMS, K1, B = 24, 1.2, 0.75
#: Buckets of the terms.
TERM_BITS = 18
# Fixed value: how a byte-level tokenizer parts a text before its merges, none of which crosses a part.
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters that libraries don't agree to call blank.
_ODD = regex.compile("[\x1c-\x1f\x85\u180e\u200b]")


@lru_cache(2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


@lru_cache(2)
def _byte_level(path: str) -> bool:
    """Whether the tokenizer parts texts by PARTS and does nothing else before its merges."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    return t.get("normalizer") is None and t.get("pre_tokenizer") == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


@lru_cache(2)
def _sizes(path: str) -> dict[str, int]:
    """Tokens of the parts seen so far, of at most 300,000 of them."""
    return {}


def token_counts(texts: list[str], path: str = TOKENIZER) -> list[int]:
    """Tokens of each text. Texts repeat their parts, so each different part is tokenized once; other tokenizers read the texts whole."""
    encode = lambda ts: [len(e.ids) for e in _tokenizer(path).encode_batch(ts, add_special_tokens=False)]
    if not _byte_level(path):
        return encode(texts)
    parts = [[] if _ODD.search(t) else PARTS.findall(t) for t in texts]
    size = _sizes(path)
    new = list(set(chain.from_iterable(parts)).difference(size))
    now = size
    if len(size) + len(new) > 300_000:
        size.clear()
        new = list(set(chain.from_iterable(parts)))
        now = size if len(new) < 300_000 else {}
    now.update(zip(new, encode(new), strict=True))
    out = [sum(map(now.__getitem__, p)) for p in parts]
    odd = [i for i, (t, p) in enumerate(zip(texts, parts, strict=True)) if t and not p]
    for i, n in zip(odd, encode([texts[i] for i in odd]), strict=True):
        out[i] = n
    return out


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms of all texts, the different ones of each in order, their counts, where each text's start, and the end)."""
    ids, first = word_hashes([t.lower() for t in texts])
    key, n = np.unique((owners(first) << TERM_BITS) | (ids >> np.uint64(64 - TERM_BITS)).astype(np.int64), return_counts=True)
    return key & ((1 << TERM_BITS) - 1), n, np.searchsorted(key >> TERM_BITS, np.arange(len(texts) + 1))


class Index:
    """BM25 over the documents of one shard, as postings sorted by term."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, first: np.ndarray) -> None:
        """Terms and counts of the documents one after the other; where each document's start, and the end."""
        n_docs, doc = len(first) - 1, owners(first)
        self.first, self.terms = first, terms
        self.length = np.bincount(doc, counts, n_docs)
        n = counts.astype(float)
        order = np.argsort(self.terms, kind="stable")
        self.sorted, self.doc = self.terms[order], doc[order]
        df = np.bincount(self.terms, minlength=1 << TERM_BITS)[self.terms]
        self.idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * self.length / max(1.0, self.length.mean() if n_docs else 1.0))
        self.weight = (self.idf * n * (K1 + 1) / (n + norm[doc]))[order]

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents with a telling term of the seed, the best first."""
        a, z = self.first[seed], self.first[seed + 1]
        mine = a + np.argsort(-self.idf[a:z], kind="stable")[:TERMS]
        score = np.zeros(len(unused))
        ts = self.terms[mine]
        for x, y in zip(np.searchsorted(self.sorted, ts).tolist(), np.searchsorted(self.sorted, ts, "right").tolist(), strict=True):
            score[self.doc[x:y]] += self.weight[x:y]
        score[~unused] = 0
        found = np.flatnonzero(score)
        return found[np.argsort(-score[found], kind="stable")]


def pack(index: Index, sizes: list[int], capacity: int = CAPACITY) -> list[int]:
    """The container of each item of the index, none larger than the capacity (items must not be either)."""
    unused = np.ones(len(sizes), bool)
    left = sorted((s, -i) for i, s in enumerate(sizes))
    out = [0] * len(sizes)
    container = -1

    def take(i: int) -> None:
        unused[i] = False
        left.pop(bisect_right(left, (sizes[i], -i)) - 1)
        out[i] = container

    while left:
        container += 1
        seed = -left[-1][1]
        room = capacity - sizes[seed]
        take(seed)
        if left and room >= left[0][0]:
            for j in index.neighbours(seed, unused).tolist():
                if room < left[0][0]:
                    break
                if sizes[j] <= room:
                    room -= sizes[j]
                    take(j)
                    if not left:
                        break
        while left and left[0][0] <= room:
            i = -left[bisect_right(left, (room, 1)) - 1][1]
            room -= sizes[i]
            take(i)
    return out


def items(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, piece, start, tokens, terms, counts): every document, cut only where it is longer than the capacity.

    The terms and counts are packed 32-bit numbers. Only the last piece of a cut document carries them, for its neighbours.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            rows = []
            texts = [t or "" for t in b.column("text").to_pylist()]
            terms, counts, first = terms_of(texts)
            terms, counts, first = terms.astype(np.int32), counts.astype(np.int32), first.tolist()
            for i, (d, s, n) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("source").to_pylist(), token_counts(texts, tokenizer), strict=True)):
                for k in range(max(1, -(-n // capacity))):
                    size = min(capacity, n - k * capacity)
                    mine = slice(first[i], first[i + 1]) if (k + 1) * capacity >= n else slice(0)
                    rows.append((d, s, k, k * capacity, size, terms[mine].tobytes(), counts[mine].tobytes()))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "source", "piece", "start", "tokens", "terms", "counts"])

    schema = "doc_id long, source string, piece int, start int, tokens int, terms binary, counts binary"
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text").mapInArrow(cut, schema)


def containers(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, tokens, container) for `docs` (doc_id LONG unique, source, text).

    `container` is a number of its own for each container; `start` and `tokens` are the part of the document in tokens. Null and empty
    texts have no token and lie in a container too. Shards hold at most about SHARD items; a source with more items has several shards, sources
    with fewer share one.
    """
    every = cut_table(items(docs, capacity, tokenizer).withColumn("source", F.coalesce("source", F.lit(""))))
    full, rest = every.where(F.col("tokens") == capacity), every.where(F.col("tokens") < capacity)
    sources = rest.groupBy("source").agg(F.count("*").alias("n"))
    total = rest.count()
    # Large sources get shards of their own, small ones share: both bounded, by hash.
    shared = max(1, -(-2 * total // SHARD))
    sources = sources.withColumn("own", F.ceil(2 * F.col("n") / SHARD).cast("long"))
    spread = rest.join(sources, "source")
    spread = spread.withColumn(
        "shard",
        F.when(F.col("n") * 4 >= SHARD, F.concat_ws("/", F.lit("own"), F.col("source"), F.pmod(F.xxhash64("doc_id", "piece"), F.col("own")).cast("string"))).otherwise(
            F.concat_ws("/", F.lit("shared"), F.pmod(F.xxhash64("source"), F.lit(shared)).cast("string"))
        ),
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "piece"], kind="stable")
        terms, counts = ([np.frombuffer(v, np.int32) for v in group[c]] for c in ("terms", "counts"))
        first = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
        at = pack(Index(np.concatenate(terms).astype(np.int64), np.concatenate(counts), first), group.tokens.tolist(), capacity)
        return group.assign(at=at)[["doc_id", "piece", "start", "tokens", "shard", "at"]]

    packed = spread.select("doc_id", "piece", "start", "tokens", "terms", "counts", "shard").groupBy("shard").applyInPandas(fill, "doc_id long, piece int, start int, tokens int, shard string, at int")
    packed = packed.select("doc_id", "piece", "start", "tokens", F.xxhash64("shard", "at").alias("container"))
    alone = full.select("doc_id", "piece", "start", "tokens", F.xxhash64(F.lit("full"), "doc_id", "piece").alias("container"))
    return packed.unionByName(alone)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source", "text")


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containers(_docs(spark, sf_dir))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(containers, tokens, share): how full the containers are."""
    by = containers(_docs(spark, sf_dir)).groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return by.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens")).withColumn("share", F.col("tokens") / (F.col("containers") * CAPACITY))
