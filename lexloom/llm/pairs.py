"""Problem 3: defective prompt and response pairs.

Each pair gets one defect or none: empty, refusal, copy, wrong_language or truncated, in this order. The languages of prompt and response are compared
by the posteriors of a character n-gram naive Bayes, with what the labels say as the prior; refusals are told by the same kind of model, copies by a
comparison that skips formatting, and truncation by the likelihood that a text ends where it does, given its last characters, together with the closing
features of `truncation`. The n-grams of a whole batch of pairs are looked up at once. All of it is counted over, or learned from, all pairs.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.charfold import look
from lexloom.llm.duplicates import fold_stream
from lexloom.llm.languages import LANGUAGES, language_of_label
from lexloom.llm.learn import TAUGHT, HashedLogistic, mixed_parts, part_of
from lexloom.llm.refs import ref_of
from lexloom.llm.refusals import Refusals, fit_refusals
from lexloom.llm.streams import bounded, code_points, gram_hashes, windows
from lexloom.llm.truncation import (
    BITS, FIT, FIT_CHARS, TOKEN, Names, Truncation, closed_endings, core_of, cut_one, features, of_source, parted, shown, tokens, translated_words, whole_one,
)
from lexloom.operators.lineage import cut_table
from lexloom.sources.tables import table

#: Buckets of the language n-grams, their lengths, and the lengths of the contexts at a text's end.
GRAM_BITS = 15
GRAMS, CONTEXTS = (2, 3, 4), (2, 4, 6, 9)
#: From how many other places on a context tells how likely a text ends there.
SEEN = 3
#: Pairs, and characters, that a part should have. The pairs of a part are judged together, with the counts of the contexts at their ends.
PART, PART_CHARS = 4000, 8_000_000
#: Log odds per n-gram by which another language must lead all languages that a response may be in.
LEAD = 0.15
#: Without a label for the response, it may be in the languages that have this share of the labelled responses to prompts in its language.
USUAL = 0.01
#: Score from which a response counts as truncated.
CUT = 0.3
#: Letters from which a text has a language.
LEAST = 8
_FOREIGN, _OTHER, _COUNTED, _REST = re.compile("[Ѐ-ԯ㐀-鿿]"), re.compile("[Ͱ-ԯ]"), re.compile(r"[^\W_]"), re.compile(r"[\d\W_]+")


def _grams(texts: list[str], n: int, codes: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of all texts, the text of each). `codes`, where given, are those of the texts."""
    codes, starts = codes or code_points(texts)
    at, row = windows(starts, n + 1)  # the line feed behind each text is in none
    return gram_hashes(codes, at, n), row


def _padded(text: str) -> str:
    return f" {look(text).casefold().strip()} "


def _buckets(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)


def _even(h: np.ndarray) -> np.ndarray:
    return h & np.uint64((1 << 64) - 2)


def _before_end(text: str) -> str:
    """The text up to its last letter or digit, with a blank before it."""
    return _padded(core_of(text))[:-1]


def language_counts(pairs: DataFrame) -> DataFrame:
    """(lang INT, bucket INT, n LONG): the n-grams of all texts that documents say are in a language. Bounded by the buckets."""
    size = 1 << GRAM_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(LANGUAGES) * size, np.int64)
        for b in bounded(bounded(batches, "source"), "target"):
            rows = [(t, LANGUAGES.index(x)) for c, l in (("source", "source_lang"), ("target", "target_lang")) for t, x in zip(b.column(c).to_pylist(), map(language_of_label, b.column(l).to_pylist()), strict=True) if t and x]
            lang = np.array([x for _, x in rows], np.int64)
            codes = code_points([_padded(t) for t, _ in rows])
            for n in GRAMS:
                h, row = _grams([], n, codes)
                total += np.bincount(lang[row] * size + _buckets(h), minlength=len(total)) if len(h) else 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array((at // size).astype(np.int32)), pa.array((at % size).astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])

    some = pairs.select("source", "target", "source_lang", "target_lang")
    return some.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def context_counts(pairs: DataFrame) -> DataFrame:
    """(hash LONG, n LONG, ends LONG): how often each run of CONTEXTS characters occurs in the targets, and how often a target ends with it. Counts are exact; the
    rows of a batch are counted before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "target"):
            codes = code_points([_before_end(t) for t in b.column("target").to_pylist()])
            found = []
            for n in CONTEXTS:
                h, row = _grams([], n, codes)
                # The lowest bit tells whether the target ends here, so that one sort brings equal contexts together.
                found.append(_even(h) | np.append(row[1:] != row[:-1], True)[: len(row)].astype(np.uint64))
            h = np.concatenate(found)
            h.sort()
            last, h = (h & np.uint64(1)).astype(np.int64), _even(h)
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.diff(np.append(first, len(h)))
            ends = np.add.reduceat(last, first) if len(h) else n
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n), pa.array(ends)], ["hash", "n", "ends"])

    return pairs.select("target").mapInArrow(count, "hash long, n long, ends long").groupBy("hash").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))


#: Hashes of contexts in order, occurrences, ends.
Contexts = tuple[np.ndarray, np.ndarray, np.ndarray]


def end_contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the contexts that each text ends with, a column for each length; whether the text is long enough to have it)."""
    codes, starts = code_points([_before_end(t)[-max(CONTEXTS) :] for t in texts])
    out, has = np.zeros((len(texts), len(CONTEXTS)), np.uint64), np.zeros((len(texts), len(CONTEXTS)), bool)
    for k, size in enumerate(CONTEXTS):
        row = np.flatnonzero(np.diff(starts) > size)
        out[row, k], has[row, k] = _even(gram_hashes(codes, starts[1:][row] - 1 - size, size)), True
    return out, has


def contexts_of(found: pa.Table) -> Contexts:
    """The rows (hash, n, ends), in any order, to be looked up."""
    h, n, ends = (found.column(c).to_numpy() for c in ("hash", "n", "ends"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    return h[order], n[order], ends[order]


def part_contexts(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(part, hash, n, ends): the counts of the contexts that the targets of each part of `pairs` (part, target) end with, but for those hardly seen. A part may have a
    row more than once."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "target"):
            h, has = end_contexts(b.column("target").to_pylist())
            part, h = np.repeat(b.column("part").to_numpy(), has.sum(1)), h[has]
            order = np.lexsort((h, part))
            part, h = part[order], h[order]
            new = np.append(True, (h[1:] != h[:-1]) | (part[1:] != part[:-1]))[: len(h)]
            yield pa.RecordBatch.from_arrays([pa.array(part[new]), pa.array(h[new].view(np.int64))], ["part", "hash"])

    return pairs.select("part", "target").mapInArrow(ask, "part long, hash long").join(contexts.where(F.col("n") > SEEN), "hash").select("part", "hash", "n", "ends")


class Defects:
    """Everything needed to judge a pair, but for the contexts at its end. Pickled, the language counts take a megabyte."""

    def __init__(self, counts: np.ndarray, base: float, usual: np.ndarray, names: Names, refusals: Refusals) -> None:
        """counts: (language, bucket); base: the share of characters that end a target; usual: labelled pairs by language of prompt and response. Nothing counts as
        truncated before a `model` is set."""
        n = counts.astype(float)
        # A gram that another language has far more often stems from wrong labels there.
        rate = (n + 0.05) / (n.sum(1, keepdims=True) + 0.05 * n.shape[1])
        rate = np.where(rate < 0.12 * rate.max(0), 0.2 * rate, rate)
        self.logp = np.ascontiguousarray(np.log(rate).astype(np.float32).T)
        self.seen = n.sum(1) > 0
        self.base, self.names, self.refusals = base, names, refusals
        self.usual = usual >= np.maximum(1, USUAL * usual.sum(1, keepdims=True))
        self.model = HashedLogistic(BITS)
        self.model.bias = -9.0

    def part(self, made: list[tuple[str, str, bool, int]], contexts: Contexts) -> pa.Table:
        """What the examples of a part teach, see `learn.TAUGHT`."""
        y = np.array([cut for _, _, cut, _ in made], bool)
        # The end of a text as it is has been counted, that of an artificial cut has not.
        return part_of(HashedLogistic(BITS, epochs=6), *self._features([m[:2] for m in made], ~y, contexts), y.astype(float), np.array([m[3] for m in made], float))

    def end_likelihoods(self, texts: list[str], counted: np.ndarray, contexts: Contexts) -> np.ndarray:
        """Log likelihood that each text ends after its last characters, a column for each length of context; NaN for a context hardly seen.

        The text's own place is left out of the counts, and so is its end if that was `counted`, or every odd end would speak for itself.
        """
        known, n, end = contexts
        hashes, has = end_contexts(texts)
        out = np.full((len(texts), len(CONTEXTS)), np.nan)
        for k in range(len(CONTEXTS)):
            row = np.flatnonzero(has[:, k])
            h = hashes[row, k]
            at = np.minimum(np.searchsorted(known, h), max(0, len(known) - 1))
            ok = known[at] == h if len(known) else np.zeros(len(h), bool)
            at, row = at[ok], row[ok]
            seen = n[at] - 1
            out[row, k] = np.where(seen >= SEEN, np.log((np.maximum(0, end[at] - counted[row]) + 2 * self.base) / (np.maximum(seen, 0) + 2)), np.nan)
        return out

    def _features(self, rows: list[tuple[str, str]], counted: np.ndarray, contexts: Contexts) -> tuple[np.ndarray, np.ndarray]:
        """(hashed features of all pairs, where each pair's start, and the end)."""
        out, size = array("q"), np.zeros(len(rows) + 1, np.int64)
        for i, ((s, t), ends) in enumerate(zip(rows, self.end_likelihoods([t for _, t in rows], counted, contexts).tolist(), strict=True)):
            best = next((e for e in reversed(ends) if e == e), -9.0)
            more = [f"E{k}{'x' if e != e else round(e)}" for k, e in enumerate(ends)] + [f"B{round(2 * best)}"]
            x = features(s, t, None, self.names, tuple(more))
            out.extend(x)
            size[i + 1] = len(x)
        return np.array(out, np.int64), np.cumsum(size)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """Log posterior of each language for each text under equal priors, per n-gram, as the n-grams of a text depend on each other."""
        total, size = np.zeros((len(texts), len(LANGUAGES))), np.zeros(len(texts))
        codes = code_points([_padded(_REST.sub(" ", t)) for t in texts])
        for n in GRAMS:
            h, row = _grams([], n, codes)
            if len(h):
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                total[row[first]] += np.add.reduceat(self.logp[_buckets(h)], first, dtype=np.float64)
                size += np.bincount(row, minlength=len(texts))
        mean = np.where(self.seen, total / np.maximum(size, 1)[:, None], -99.0)
        return mean - np.log(np.exp(mean - mean.max(1, keepdims=True)).sum(1, keepdims=True)) - mean.max(1, keepdims=True) if len(texts) else mean

    def _plain(self, words: list[str], source: set[str], text: str) -> str:
        """The words that tell a language: no names copied from the source, no Latin words between Cyrillic or Chinese ones."""
        ws = [w for w in words if w in self.names.words or not w.isascii() or w not in source]
        other = [w for w in ws if _FOREIGN.search(w)]
        return " ".join(other if sum(map(len, other)) >= 3 else ws) or text

    def _names_only(self, ws: list[str]) -> bool:
        """Whether a text of these words holds nothing to translate: coined names, codes and numbers."""
        return len(ws) <= 4 and not any(w in self.names.words or not w.isascii() for w in ws)

    def defects(self, rows: list[tuple[str, str, str | None, str | None]], contexts: Contexts) -> list[str | None]:
        """The defect of each (source, target, source language, target language), or None. `contexts`: those at the ends of the targets."""
        n = len(rows)
        out: list[str | None] = [None] * n
        if not n:
            return out
        sources, targets = [r[0] for r in rows], [r[1] for r in rows]
        looks = [look(t) for t in targets]
        refused = self.refusals.are_refusals(targets)
        words = [of_source(s)[3] for s in sources]
        named = [self._names_only(w) for w in words]
        folded = [self._folded(x) for x in (sources, targets)]
        asked = []
        for i, (_, t, sl, tl) in enumerate(rows):
            a, b = folded[0][i], folded[1][i]
            if not _COUNTED.search(looks[i]):
                out[i] = "empty"
            elif refused[i]:
                out[i] = "refusal"
            elif a and not named[i] and (sl is None or sl != tl) and (len(a) >= 80 or 2 * len(a) >= len(b)) and _inside(a, b):
                out[i] = "copy"
            else:
                ts = tokens(t)
                if sum(map(len, ts)) >= LEAST and not self._names_only(ts):
                    asked.append((i, self._plain(TOKEN.findall(looks[i].casefold()) if _OTHER.search(looks[i]) else ts, set(words[i]), t)))
        self._compare(rows, asked, words, out)
        left = [i for i in range(n) if out[i] is None and not named[i]]
        score = self.model.score(*self._features([rows[i][:2] for i in left], np.ones(len(left), bool), contexts)) if left else []
        for i, p in zip(left, score, strict=True):
            if p >= CUT:
                out[i] = "truncated"
        return out

    def _compare(self, rows: list[tuple], asked: list[tuple[int, str]], words: list[list[str]], out: list[str | None]) -> None:
        """Mark the responses whose posterior leads in a language that they may not be in.

        They may be in the two languages of the document. For a missing label of the source stands the language that leads the prompt's posterior; for one of
        the target the languages of labelled responses to such prompts, and without such there is no verdict.
        """
        answer = self.posteriors([t for _, t in asked])
        unsure = [k for k, (i, _) in enumerate(asked) if None in rows[i][2:]]
        prompt = dict(zip(unsure, self.posteriors([" ".join(words[asked[k][0]]) or rows[asked[k][0]][0] for k in unsure]).argmax(1).tolist(), strict=True)) if unsure else {}
        for k, (i, _) in enumerate(asked):
            sl, tl = rows[i][2:]
            allowed = {LANGUAGES.index(x) for x in (sl, tl) if x}
            if k in prompt:
                own = LANGUAGES.index(sl) if sl else prompt[k]
                allowed.add(own)
                if tl is None:
                    if not self.usual[own].any():
                        continue
                    allowed |= set(np.flatnonzero(self.usual[own]).tolist())
            p = answer[k]
            best = int(p.argmax())
            if best not in allowed and self.seen[best] and p[best] - max(p[j] for j in allowed) >= LEAD:
                out[i] = "wrong_language"

    @staticmethod
    def _folded(texts: list[str]) -> list[bytes]:
        """What counts of each text, four bytes a character."""
        symbols, place = fold_stream(texts, False)
        at = np.searchsorted(place, np.cumsum([0, *(len(t) + 1 for t in texts)])) * 4
        whole = symbols.tobytes()
        return [whole[a:z] for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _inside(a: bytes, b: bytes) -> bool:
    """Whether the characters a are in b, four bytes each."""
    at = b.find(a)
    while at > 0 and at % 4:
        at = b.find(a, at + 1)
    return at >= 0


def examples(pairs: list[tuple[str, str]], part: int = 0, parts: int = 1, seed: int = 7) -> list[tuple[str, str, bool, int]]:
    """(source, target, whether it is cut, weight) made from the pairs of a part, the same in every run."""
    rng = np.random.default_rng((seed, part))
    pairs, out = sorted(pairs), []
    for (s, t), times in shown(pairs, parts):
        for cut in (False, True):
            v = cut_one(t, rng) if cut else whole_one(t, rng)
            if not cut and rng.random() > 0.93:
                v = pairs[rng.integers(len(pairs))][1]
            if rng.random() < 0.08:
                s = f"{s} {('№ {}', '(AB-{})', '#{}', '[{}]')[rng.integers(4)].format(rng.integers(1, 999))}"
            if core_of(v):
                out.append((s, v, cut, times))
    return out


def learned_pairs(pairs: DataFrame, refusals: Refusals) -> DataFrame:
    """The rows of `pairs` that examples are made from: intact ones, no refusals."""
    shared = pairs.sparkSession.sparkContext.broadcast(refusals)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(bounded(batches, "source"), "target"):
            sources, targets = b.column("source").to_pylist(), b.column("target").to_pylist()
            intact = np.array([Truncation._intact(s, t) for s, t in zip(sources, targets, strict=True)], bool)
            yield b.filter(pa.array(intact & ~shared.value.are_refusals(targets)))

    rows = pairs.select("ref", "pos", "source", "target")
    return cut_table(rows.mapInArrow(good, rows.schema))


def fit_defects(pairs: DataFrame, contexts: DataFrame) -> Defects:
    """Counts over all pairs, those of `contexts` among them; names and the cut model from all pairs that are intact."""
    counts = np.zeros((len(LANGUAGES), 1 << GRAM_BITS), np.int64)
    found = language_counts(pairs).toPandas()
    counts[found.lang, found.bucket] = found.n
    usual = np.zeros((len(LANGUAGES), len(LANGUAGES)))
    for r in pairs.where("source_lang is not null and target_lang is not null").groupBy("source_lang", "target_lang").count().collect():
        if (a := language_of_label(r.source_lang)) and (b := language_of_label(r.target_lang)):
            usual[LANGUAGES.index(a), LANGUAGES.index(b)] += r["count"]
    r = contexts.agg(F.sum("n").alias("n"), F.sum("ends").alias("ends")).first()
    base = max(1, r.ends or 0) / max(1, r.n or 0)
    refusals = fit_refusals(pairs)
    good = learned_pairs(pairs, refusals)
    out = Defects(counts, base, usual, Names(translated_words(good), closed_endings(pairs)), refusals)
    shared = pairs.sparkSession.sparkContext.broadcast(out)
    rows, parts = parted(good, FIT, FIT_CHARS)
    rows = rows.select("part", "source", "target")

    def made(rows: pa.Table) -> list[tuple[str, str, bool, int]]:
        return examples(list(zip(rows.column("source").to_pylist(), rows.column("target").to_pylist(), strict=True)), rows.column("part")[0].as_py(), parts)

    def ends(rows: pa.Table) -> pa.Table:
        h, has = end_contexts([v for _, v, _, _ in made(rows)])
        h = np.unique(h[has])
        return pa.table({"part": pa.array(np.repeat(rows.column("part")[0].as_py(), len(h)), pa.int64()), "hash": pa.array(h.view(np.int64))})

    asked = rows.groupBy("part").applyInArrow(ends, "part long, hash long")
    asked = asked.join(contexts.where(F.col("n") > SEEN), "hash").select("part", "hash", "n", "ends")
    taught = rows.groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(lambda rows, found: shared.value.part(made(rows), contexts_of(found)), TAUGHT)
    out.model = mixed_parts(taught, BITS) or out.model
    return out


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """(ref, pos, defect) of the defective ones of `pairs` (ref, pos, source, target, source_lang, target_lang).

    A null source or target is no pair; languages may be null or unknown, see `Defects._compare`. Repeated pairs count once.
    """
    pairs = pairs.where("source is not null and target is not null").select("ref", F.col("pos").cast("int"), "source", "target", "source_lang", "target_lang").distinct()
    pairs = cut_table(pairs.withColumn("part", F.xxhash64(*pairs.columns)))
    contexts = cut_table(context_counts(pairs))
    model = pairs.sparkSession.sparkContext.broadcast(fit_defects(pairs, contexts))
    size = pairs.agg(F.count("*").alias("n"), F.sum(F.length("source") + F.length("target")).alias("chars")).first()
    pairs = pairs.withColumn("part", F.pmod("part", F.lit(max(size.n // PART, (size.chars or 0) // PART_CHARS) + 1)))

    def judge(rows: pa.Table, found: pa.Table) -> pa.Table:
        contexts, out = contexts_of(found), []
        for b in bounded(bounded(iter(rows.to_batches()), "source"), "target"):
            langs = ([language_of_label(x) for x in b.column(c).to_pylist()] for c in ("source_lang", "target_lang"))
            some = list(zip(b.column("source").to_pylist(), b.column("target").to_pylist(), *langs, strict=True))
            r = pa.RecordBatch.from_arrays([b.column("ref"), b.column("pos"), pa.array(model.value.defects(some, contexts), pa.string())], ["ref", "pos", "defect"])
            out.append(r.filter(r.column("defect").is_valid()))
        return pa.Table.from_batches(out, pa.schema([("ref", pa.string()), ("pos", pa.int32()), ("defect", pa.string())]))

    return pairs.groupBy("part").cogroup(part_contexts(pairs, contexts).groupBy("part")).applyInArrow(judge, "ref string, pos int, defect string")


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of the regions, and those of the validations whose source or translation is listed as still found or as missing."""
    regions = table(spark, sf_dir, "regions").select(ref_of("region").alias("ref"), "doc_id", F.lit(0).alias("pos"), F.col("source_text").alias("source"), F.col("target_text").alias("target"))
    v = table(spark, sf_dir, "validations")
    v = v.select(ref_of("validation").alias("ref"), "doc_id", "residual_source_texts", "missing_target_texts", F.posexplode(F.arrays_zip("expected_texts", "expected_translations")).alias("pos", "p"))
    v = v.select("ref", "doc_id", "pos", F.col("p.expected_texts").alias("source"), F.col("p.expected_translations").alias("target"), "residual_source_texts", "missing_target_texts")
    listed = F.coalesce(F.array_contains("residual_source_texts", F.col("source")), F.lit(False)) | F.coalesce(F.array_contains("missing_target_texts", F.col("target")), F.lit(False))
    every = regions.unionByName(v.where(listed).drop("residual_source_texts", "missing_target_texts"))
    return every.join(table(spark, sf_dir, "doc_meta").select("doc_id", "source_lang", "target_lang"), "doc_id", "left").drop("doc_id")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defective_pairs(all_pairs(spark, sf_dir))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs have each defect."""
    return p3_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("pairs"))
