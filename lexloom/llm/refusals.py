"""Telling refusals from answers, in any of several languages, by character n-gram naive Bayes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.charfold import look
from lexloom.llm.streams import LAST, bounded, code_points, running_hashes
from lexloom.operators.lineage import cut_table

# How assistants refuse, by language.
PHRASES = """
I'm sorry, but I can't help with that. I'm sorry, I cannot translate this text. I cannot assist with this request.
I am unable to provide a translation. I can't fulfil that request. I won't be able to help with this. As an AI language model, I cannot do that.
Unfortunately, I am not able to answer this. This request violates my guidelines, so no answer can be given. Sorry, this content cannot be translated.
I must decline to translate this. I apologize, but I'm not able to process this request. I do not have permission to translate this content.
My guidelines do not allow me to comply with this request. It is not possible for me to help with this question. I refuse to answer.
Es tut mir leid, aber dabei kann ich nicht helfen. Ich kann diesen Text leider nicht übersetzen. Leider kann ich diese Anfrage nicht bearbeiten.
Als Sprachmodell bin ich nicht in der Lage, diese Anfrage zu beantworten. Das verstößt gegen meine Richtlinien. Ich darf diesen Inhalt nicht übersetzen.
Entschuldigung, ich kann Ihnen hier nicht weiterhelfen. Bei dieser Anfrage kann ich nicht behilflich sein. Eine Übersetzung ist mir nicht möglich.
Je suis désolé, mais je ne peux pas vous aider. Désolé, je ne peux pas traduire ce texte. Je ne suis pas en mesure de traduire ce contenu.
En tant que modèle de langage, je ne peux pas répondre à cette demande. Cette demande va à l'encontre de mes règles. Il m'est impossible de répondre.
Malheureusement, je ne peux pas donner suite à cette demande. Je regrette, je ne peux pas fournir de traduction.
Lo siento, pero no puedo ayudar con eso. Lo siento, no puedo traducir este texto. No me es posible responder a esta solicitud.
Como modelo de lenguaje, no puedo realizar esta tarea. Esta solicitud infringe mis directrices. Lamentablemente no puedo ofrecer una traducción.
No estoy en condiciones de atender esta petición. Perdón, no puedo procesar este contenido.
Извините, но я не могу помочь с этим. К сожалению, я не могу перевести этот текст. Я не могу ответить на этот запрос.
Как языковая модель, я не могу выполнить эту просьбу. Этот запрос нарушает мои правила. Простите, я не в состоянии перевести этот текст.
Мне жаль, но перевод этого содержания невозможен.
抱歉，我无法翻译此内容。 很抱歉，我不能帮助您完成这个请求。 对不起，我不能翻译这段文字。 作为语言模型，我无法回答这个问题。
很遗憾，我不能处理这个请求。 该请求违反了我的准则，无法提供翻译。 我没有办法回答这个请求。 不好意思，我无法协助处理该内容。
Mi dispiace, ma non posso tradurre questo testo. Non sono in grado di aiutarti con questa richiesta. Purtroppo non posso rispondere.
Desculpe, mas não posso traduzir este texto. Não consigo ajudar com este pedido. Infelizmente não posso responder.
Het spijt me, maar ik kan deze tekst niet vertalen. Ik kan je hier niet mee helpen.
Przepraszam, ale nie mogę przetłumaczyć tego tekstu. Nie mogę pomóc w tej sprawie.
申し訳ありませんが、このテキストを翻訳できません。 そのご要望にはお応えできません。
"""
BITS = 16
#: What a refusal may carry after it: the text refused, in brackets or quotes.
_REST = re.compile(r"(?<=[.!。！])\s*[(（\[«„“\"].*$", re.S)
_OPENING = re.compile("[(（\\[«„“\"]")
#: Share of answers that surely aren't refusals, and what a refusal must score above the best of them.
ORDINARY, ABOVE = 0.95, 0.4
#: Least score of a refusal.
LEAST = 0.9
#: Score from which a repeated answer may be a refusal, and how often one is repeated.
ALIKE, OFTEN = 0.2, 3


#: Enough letters or ideographs to be a sentence, and enough before a quotation to do without it.
_WORDED, _WORDED_HAN, _HEADED = re.compile(r"(?:[\W\d_]*+[^\W\d_]){12}"), re.compile("(?:[^㐀-鿿]*+[㐀-鿿]){7}"), re.compile(r"(?:[\W\d_]*+[^\W\d_]){5}")
#: Characters of a step of array operations, so that it stays in the cache.
STEP = 1 << 14
_WORD, _BETWEEN, _DIGIT = range(3)


@lru_cache(1)
def _char_kinds() -> np.ndarray:
    """Of each character: digit, other part of a word, or what stands between words."""
    word, digit = re.compile(r"[\w'-]"), re.compile(r"\d")
    return np.fromiter((_DIGIT if digit.match(c) else _WORD if word.match(c) else _BETWEEN for c in map(chr, range(LAST + 1))), np.uint8, LAST + 1)


def _steps(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about STEP characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= STEP:
            yield texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield texts[at:]


def _plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of the words of each text, a blank before, between and behind them and a line feed at the end; where each text starts, and the end).

    Each run of digits, and each of other characters between words, is one blank, so there may be several between two words.
    """
    codes, starts = code_points([look(t).casefold() for t in texts])
    kind = _char_kinds()[np.minimum(codes, LAST)]
    word = np.flatnonzero(kind == _WORD)
    keep = np.empty(len(codes), bool)
    keep[:1], keep[1:] = True, kind[1:] != kind[:-1]
    keep[starts[:-1]] = True
    keep[word] = True
    # Only what stands between the first and the last letter of a text.
    first, past = np.searchsorted(word, starts[:-1]), np.searchsorted(word, starts[1:])
    some = past > first
    edge = np.zeros(len(codes) + 1, np.int8)
    edge[word[first[some]]] = 1
    edge[word[past[some] - 1] + 1] -= 1
    keep &= np.cumsum(edge[:-1], dtype=np.int8).view(bool)
    total = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(keep, out=total[1:])
    size = np.diff(total[starts])
    to = np.zeros(len(starts), np.int64)
    np.cumsum(size + 3, out=to[1:])
    out = np.full(to[-1], 32, np.uint32)
    out[np.arange(total[-1]) + np.repeat(to[:-1] + 1 - total[starts[:-1]], size)] = np.where(kind == _WORD, codes, 32)[keep]
    out[to[1:] - 1] = 10
    return out, to


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the n-grams of all texts, the text of each): one to three characters in mostly Chinese texts, else three to five."""
    codes, starts = _plain(texts)
    han = np.zeros(len(codes) + 1, np.int64)
    np.cumsum((codes >= 0x3400) & (codes <= 0x9FFF), out=han[1:])
    size = np.diff(starts)
    short = 3 * np.diff(han[starts]) > size - 1
    bucket, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for rows, sizes in ((np.flatnonzero(short), (1, 2, 3)), (np.flatnonzero(~short), (3, 4, 5))):
        if not len(rows):
            continue
        c = codes if len(rows) == len(texts) else codes[np.repeat(short if sizes[0] == 1 else ~short, size)]
        # How many characters there are from each place to the line feed behind its text, which belongs to no n-gram.
        left = np.repeat(np.cumsum(size[rows]), size[rows]) - np.arange(1, len(c) + 1)
        row = np.repeat(rows, size[rows])
        for n in sizes:
            at = np.flatnonzero(left >= n)
            bucket.append((running_hashes(c, n)[at] >> np.uint64(64 - BITS)).astype(np.int64))
            owner.append(row[at])
    return np.concatenate(bucket), np.concatenate(owner)


def _counts(texts: list[str]) -> np.ndarray:
    total = np.zeros(1 << BITS, np.int64)
    for step in _steps(texts):
        total += np.bincount(_grams(step)[0], minlength=1 << BITS)
    return total


def _ratio(other: np.ndarray) -> np.ndarray:
    """Log ratio of each bucket between refusals and ordinary answers, whose n-grams are counted in `other`."""
    own = _counts([p for p in re.split(r"(?<=[.。])\s+", PHRASES.strip()) if p])
    return (np.log((own + 0.2) / (own.sum() + 0.2 * len(own))) - np.log((other + 0.2) / (other.sum() + 0.2 * len(other)))).astype(np.float32)


def _scores(texts: list[str], *ratios: np.ndarray) -> list[np.ndarray]:
    """Mean log ratio of the n-grams of what stands before a quoted text, of each text, by each of `ratios`."""
    heads = [_head(t.strip()) for t in texts]
    out = [[np.zeros(0)] for _ in ratios]
    for step in _steps([h if _HEADED.match(h) else t for h, t in zip(heads, texts, strict=True)]):
        bucket, owner = _grams(step)
        n = np.bincount(owner, minlength=len(step))
        for x, r in zip(out, ratios, strict=True):
            x.append(np.where(n > 0, np.bincount(owner, r[bucket], len(step)) / np.maximum(n, 1), -9.0))
    return [np.concatenate(x) for x in out]


class Refusals:
    """Fitted against ordinary answers: those given, or all of a table, see `fit_refusals`."""

    def __init__(self, answers: list[str]) -> None:
        plain = answers or ["-"]
        for _ in range(2):
            self.ratio = _ratio(_counts(plain))
            scores = self.scores(plain)
            # What looks like a refusal and is repeated isn't held against refusals in the second round.
            often = Counter(_head(a) for a in plain)
            plain = [a for a, x in zip(plain, scores, strict=True) if x < ALIKE or often[_head(a)] < OFTEN] or ["-"]
        known = np.sort(self.scores([a for a in plain if _worded(a)] or ["-"]))
        self.least = max(LEAST, float(known[int(ORDINARY * (len(known) - 1))]) + ABOVE)

    @classmethod
    def of(cls, ratio: np.ndarray, ordinary: float) -> Refusals:
        """`ordinary`: the score that ORDINARY of the answers don't exceed."""
        self = cls.__new__(cls)
        self.ratio, self.least = ratio, max(LEAST, ordinary + ABOVE)
        return self

    def scores(self, texts: list[str]) -> np.ndarray:
        return _scores(texts, self.ratio)[0]

    def are_refusals(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), bool)
        worded = [i for i, t in enumerate(texts) if _worded(t)]
        out[worded] = self.scores([texts[i] for i in worded]) >= self.least
        return out

    def is_refusal(self, text: str) -> bool:
        return bool(self.are_refusals([text])[0])


def _head(text: str) -> str:
    """What stands before the text refused."""
    return _REST.sub("", text) if _OPENING.search(text) else text


def _worded(text: str) -> bool:
    return bool(_WORDED.match(text) or _WORDED_HAN.match(text))


def _counted(answers: DataFrame) -> np.ndarray:
    """The n-grams of all answers by bucket, counted in each partition before they travel."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for b in bounded(batches, "target"):
            total += _counts(b.column("target").to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(1 << BITS, np.int64)
    found = answers.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return out


def _scored(answers: DataFrame, *ratios: np.ndarray) -> DataFrame:
    """(head LONG, worded, x0, x1...: the scores by each of `ratios`, target of those that may be refusals by the last one, else null). `head` is the hash of what is repeated."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "target"):
            texts = b.column("target").to_pylist()
            x = _scores(texts, *ratios)
            some = [t if y >= ALIKE else None for t, y in zip(texts, x[-1].tolist(), strict=True)]
            out = [pa.array([_head(t) for t in texts], pa.string()), pa.array([_worded(t) for t in texts], pa.bool_()), *map(pa.array, x), pa.array(some, pa.string())]
            yield pa.RecordBatch.from_arrays(out, ["head", "worded", *names, "target"])

    names = [f"x{k}" for k in range(len(ratios))]
    rows = answers.mapInArrow(score, f"head string, worded boolean, {', '.join(f'{x} double' for x in names)}, target string")
    return cut_table(rows.withColumn("head", F.xxhash64("head")))


def _repeated(rows: DataFrame, score: str) -> DataFrame:
    """The heads that OFTEN rows or more have, one at least of which may be a refusal."""
    by = rows.groupBy("head").agg(F.count("*").alias("n"), F.max(score).alias("most"))
    return by.where((F.col("n") >= OFTEN) & (F.col("most") >= ALIKE)).select("head")


def _ranked(rows: DataFrame, score: str, share: float) -> float | None:
    """The score that stands at `share` of all in order, exactly; only those of one narrow bin travel."""
    bins = rows.groupBy(F.floor(F.col(score) * 4096).alias("bin")).agg(F.count("*").alias("n")).orderBy("bin").collect()
    at = int(share * (sum(r.n for r in bins) - 1))
    for r in bins:
        if at < r.n:
            for x in rows.where(F.floor(F.col(score) * 4096) == r.bin).groupBy(score).agg(F.count("*").alias("n")).orderBy(score).collect():
                if at < x.n:
                    return x[score]
                at -= x.n
        at -= r.n
    return None


def fit_refusals(answers: DataFrame) -> Refusals:
    """`Refusals` of all `answers` (target, never null), as if they were one list: counts, what is repeated, and the threshold are exact."""
    answers = answers.select("target")
    other = _counted(answers)
    first = _ratio(other)
    rows = _scored(answers, first)
    gone = _repeated(rows, "x0")
    second = _ratio(other - _counted(rows.where(F.col("x0") >= ALIKE).join(gone, "head", "left_semi").select("target")))
    rows = _scored(answers, first, second)
    # As in the first round: what looks like a refusal and is repeated isn't ordinary.
    rows = rows.join(gone.withColumn("gone", F.lit(True)), "head", "left").where((F.col("x0") < ALIKE) | F.col("gone").isNull())
    rows = rows.join(_repeated(rows, "x1").withColumn("again", F.lit(True)), "head", "left").where(((F.col("x1") < ALIKE) | F.col("again").isNull()) & F.col("worded"))
    known = _ranked(rows, "x1", ORDINARY)
    return Refusals.of(second, -9.0 if known is None else known)
