"""Problem 9: abusive, hateful and sexual content, by a convolutional text classifier trained in numpy.

Words are brought to one spelling (look-alikes, figures for letters, stretched, spaced and masked words), hashed to embeddings, and read
by filters of several widths with max pooling over the whole text. Thresholds are set by language on held-out folds.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.charfold import TO_LATIN, look
from lexloom.llm.learn import bounded_sample
from lexloom.llm.streams import bounded, code_points
from lexloom.sources.tables import table

CATEGORIES = ("abusive", "hateful", "sexual")
#: Bound on the rated documents that the classifier is fitted on, the first by hash.
SAMPLE = 20000
BUCKETS, DIM, WIDTHS, FILTERS, FOLDS = 1 << 14, 24, (1, 2, 3, 5), 24, 3
#: Bound on the unrated documents that stand for ordinary text, and their weight.
UNRATED, WEAK = 9000, 0.15
BREAK = 0
#: Words of a text that one training step reads: from a text longer than that, a window for each step.
WINDOW = 1500

_LATIN = str.maketrans({k: v for k, v in TO_LATIN.items()})
_LEET = str.maketrans("013457@$", "oieastas")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_] ){2,}[^\W\d_](?![^\W_])")
_WORD = re.compile(r"[^\W_][\w@$]*(?:(?:[*#%]+|-{2,}|_{2,})[^\W_]*)*(?:['’][^\W_]+)?|[.!?\n]+")
_MASK = re.compile(r"[*#%]|-{2,}|_{2,}")
_STRETCH = re.compile(r"(.)\1+")
_OTHER = re.compile("[Ͱ-ԯ]")


def spelling(word: str) -> str:
    """One spelling for a word: figures that stand for letters as letters, l and i as one, repeated letters once."""
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(_LEET)
    return _STRETCH.sub(r"\1", word.replace("l", "i"))


def words(text: str) -> list[str]:
    """The words of a text in lower case, masked words with their masks, and "." for each end of a sentence."""
    return ["." if w[0] in ".!?\n" else w for w in _words(text)]


def _words(text: str) -> list[str]:
    """As `words`, but with the marks that end sentences as written."""
    return _split(look(text))


def _split(t: str, spaced: bool = True) -> list[str]:
    if _OTHER.search(t):
        # Look-alikes are read as Latin in words with Latin letters.
        t = re.sub(r"\w+", lambda m: m.group().translate(_LATIN) if re.search("[a-zA-Z]", m.group()) else m.group(), t)
    t = t.casefold()
    return _WORD.findall(_SPACED.sub(lambda m: m.group().replace(" ", ""), t) if spaced else t)


def _words_of(texts: list[str]) -> Iterator[list[str]]:
    """`_words` of each text; which have single letters between blanks is looked up for all at once."""
    seen = [look(t) for t in texts]
    cps, starts = code_points(seen)
    kind = _letter_or_blank()[np.minimum(cps, 0x10000)]
    n = max(0, len(kind) - 4)
    at = np.flatnonzero((kind[:n] & kind[2 : n + 2] & kind[4 : n + 4] & 1) & (kind[1 : n + 1] >> 1) & (kind[3 : n + 3] >> 1))
    spaced = np.zeros(len(texts), bool)
    spaced[np.searchsorted(starts, at, "right") - 1] = True
    return map(_split, seen, spaced.tolist())


@lru_cache(1)
def _letter_or_blank() -> np.ndarray:
    """1 for a letter, 2 for a blank; characters beyond the basic plane count as letters."""
    out = np.fromiter((chr(c).isalpha() for c in range(0x10001)), np.int8, 0x10001)
    out[0x10000], out[32] = 1, 2
    return out


class Known(dict):
    """Ids by word, found with `of` when first asked for; of more than 300,000 words only the first are kept."""

    def __init__(self, of: Callable[[str], int]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> int:
        i = self.of(word)
        if len(self) < 300_000:
            self[word] = i
        return i


class Speller:
    """Ids of words. Masked words are read as the word of the rated texts that fits, the most telling one first."""

    def __init__(self, texts: list[list[str]], bad: np.ndarray) -> None:
        seen, toxic = Counter(), Counter()
        for ws, b in zip(texts, bad, strict=True):
            for w in set(ws):
                if w.isalpha():
                    seen[w] += 1
                    toxic[w] += b
        rate = (sum(bad) + 1) / (len(bad) + 2)
        self.telling: dict[tuple[str, str, int], list[str]] = defaultdict(list)
        for w in sorted(seen, key=lambda w: -(toxic[w] + rate) / (seen[w] + 1)):
            if len(w) > 2:
                self.telling[w[0], w[-1], len(w)].append(w)
        self.known = Known(self.id_of)

    def id_of(self, word: str) -> int:
        if word[0] in ".!?\n":
            return BREAK
        plain = word
        if _MASK.search(word):
            shape = re.compile("".join("." if c in "*#%-_" else re.escape(c) for c in word))
            fits = [w for w in self.telling.get((word[0], word[-1], len(word)), []) if shape.fullmatch(w)]
            if not fits:
                # The last letters may be masked too.
                fits = [w for (a, _, n), ws in self.telling.items() if a == word[0] and n == len(word) for w in ws if shape.fullmatch(w)]
            plain = fits[0] if fits else "<masked>"
        return 1 + crc32(spelling(plain).encode("utf-8", "surrogatepass")) % (BUCKETS - 1)

    def ids(self, ws: list[str]) -> np.ndarray:
        pad = max(WIDTHS) - 1
        out = np.full(len(ws) + 2 * pad, BREAK, np.int32)
        out[pad : pad + len(ws)] = list(map(self.known.__getitem__, ws))
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = Known(self.id_of)


class Convolution:
    """Embeddings, filters and one logistic output per category; Adam, dropout on the pooled features."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        n = FILTERS * len(WIDTHS)
        self.p = {"e": rng.normal(0, 0.3, (BUCKETS, DIM)), "o": rng.normal(0, 0.1, (n, len(CATEGORIES))), "c": np.full(len(CATEGORIES), -2.0)}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * DIM), (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def fit(self, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int, batch: int = 48, rate: float = 4e-3) -> Convolution:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        epochs, step = int(np.clip(36000 // max(1, len(docs)), 4, 30)), 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for k in range(0, len(docs), batch):
                some = order[k : k + batch]
                parts = []
                for i in some:
                    d = docs[i]
                    at = int(rng.integers(0, len(d) - WINDOW + 1)) if len(d) > WINDOW else 0
                    parts.append(d[at : at + WINDOW])
                touched, grads = self._grads(parts, y[some], weight[some], rng)
                step += 1
                fade = 1 - 0.9**step, 1 - 0.99**step
                for name, g in grads.items():
                    # Of the embeddings only those of words in this step are moved.
                    rows = touched if name == "e" else slice(None)
                    a, b = 0.9 * m[name][rows] + 0.1 * g, 0.99 * v[name][rows] + 0.01 * g * g
                    m[name][rows], v[name][rows] = a, b
                    self.p[name][rows] -= rate / fade[0] * a / (np.sqrt(b / fade[1]) + 1e-6)
        return self

    def _grads(self, parts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(words with a gradient, gradients by name; those of the embeddings in the order of the words)."""
        x = np.concatenate(parts)
        starts = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        # The filters read each different word of the step once; what a filter sees at its j-th place is moved by j.
        different, which = np.unique(x, return_inverse=True)
        e = self.p["e"][different]
        pooled, where = [], []
        for w in WIDTHS:
            out = (e @ self.p[f"w{w}"][0] + self.p[f"b{w}"]).take(which, axis=0)
            for j in range(1, w):
                out[:-j] += (e @ self.p[f"w{w}"][j]).take(which[j:], axis=0)
            for s in starts[1:]:
                out[max(0, s - w + 1) : s] = -1e9
            arg = np.stack([s + out[s:z].argmax(0) for s, z in zip(starts[:-1], starts[1:], strict=True)])
            where.append(arg)
            pooled.append(np.maximum(out[arg, np.arange(FILTERS)], 0))
        h = np.concatenate(pooled, 1)
        keep = ((rng.random(h.shape) > 0.3) / np.float32(0.7)).astype(np.float32)
        z = (h * keep) @ self.p["o"] + self.p["c"]
        d = ((1 / (1 + np.exp(-z)) - y) * weight / len(parts)).astype(np.float32)
        g = {"o": (h * keep).T @ d + 1e-4 * self.p["o"], "c": d.sum(0)}
        back = (d @ self.p["o"].T) * keep * (h > 0)
        rows, flows = [], []
        for k, w in enumerate(WIDTHS):
            b, arg = back[:, k * FILTERS : (k + 1) * FILTERS], where[k]
            gw = np.zeros_like(self.p[f"w{w}"])
            used = np.nonzero(b)
            value, place = b[used], arg[used]
            for j in range(w):
                gw[j] = np.einsum("bfd,bf->df", e[which[arg + j]], b)
                rows.append(x[place + j])
                flows.append(value[:, None] * self.p[f"w{w}"][j].T[used[1]])
            g[f"w{w}"], g[f"b{w}"] = gw, b.sum(0)
        touched, g["e"] = _summed(np.concatenate(rows), np.concatenate(flows))
        return touched, {k: a.astype(np.float32) for k, a in g.items()}

    def tables(self) -> tuple[float, dict[int, list[np.ndarray]]]:
        """(unit, per filter width the contribution of every word at every place): the filters as look-ups of 16-bit numbers of that unit."""
        exact = {w: [self.p["e"] @ self.p[f"w{w}"][j] for j in range(w)] for w in WIDTHS}
        most = max(sum(float(np.abs(t).max()) for t in ts) for ts in exact.values())
        unit = max(most, 1e-6) / 32000
        return unit, {w: [np.round(t / unit).astype(np.int16) for t in ts] for w, ts in exact.items()}

    def score(self, docs: list[np.ndarray], tables: tuple[float, dict[int, list[np.ndarray]]]) -> np.ndarray:
        """Probabilities (document, category); every word of every document is read, some thousand words at a time."""
        unit, by_width = tables
        out = np.zeros((len(docs), FILTERS * len(WIDTHS)), np.float32)
        k = 0
        while k < len(docs):
            n, size = k, 0
            while n < len(docs) and (n == k or size + len(docs[n]) < 3000):
                size += len(docs[n])
                n += 1
            x = np.concatenate(docs[k:n])
            starts = np.concatenate([[0], np.cumsum([len(d) for d in docs[k:n]])])[:-1]
            for f, w in enumerate(WIDTHS):
                c = by_width[w][0].take(x, axis=0, mode="clip")
                for j in range(1, w):
                    c[:-j] += by_width[w][j].take(x[j:], axis=0, mode="clip")
                # The padding between documents is as wide as the widest filter, so none reads across them but for breaks.
                out[k:n, f * FILTERS : (f + 1) * FILTERS] = np.maximum.reduceat(c[: len(x) - w + 1], starts) * np.float32(unit) + self.p[f"b{w}"]
            k = n
        return 1 / (1 + np.exp(-(np.maximum(out, 0) @ self.p["o"] + self.p["c"])))


def _summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the different rows, the sum of the values of each)."""
    if not len(rows):
        return rows, values
    order = np.argsort(rows, kind="stable")
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    return rows[first], np.add.reduceat(values[order], first)


class Classifier:
    """FOLDS convolutions, each fitted without one fold; thresholds by language from the held-out scores."""

    def __init__(self, texts: list[str], langs: list[str], y: np.ndarray, weight: np.ndarray, rated: np.ndarray | None = None, seed: int = 7, each: Callable = map) -> None:
        """y, weight: a column per category. Documents that are not `rated` are learned from, but set no threshold. `each` maps over the folds."""
        rated = np.ones(len(texts), bool) if rated is None else rated
        ws = [words(t) for t in texts]
        self.speller = Speller([w for w, r in zip(ws, rated, strict=True) if r], y[rated].max(1) >= 0.5 if rated.any() else np.zeros(0))
        docs = [self.speller.ids(w) for w in ws]
        fold = np.array([crc32(t.encode("utf-8", "surrogatepass")) % FOLDS for t in texts], int)

        def fit(k: int) -> tuple[Convolution, np.ndarray]:
            mine, other = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            model = Convolution(seed + k)
            if len(mine):
                model.fit([docs[i] for i in mine], y[mine], weight[mine], seed + k)
            return model, model.score([docs[i] for i in other], model.tables())

        held = np.zeros_like(y)
        self.models = []
        for k, (model, scores) in enumerate(each(fit, range(FOLDS))):
            self.models.append(model)
            held[fold == k] = scores
        self.thresholds = self._calibrate(held[rated], y[rated], np.array(langs, object)[rated])

    @staticmethod
    def _calibrate(held: np.ndarray, y: np.ndarray, langs: np.ndarray) -> dict[str, list[float]]:
        """Per language and category the threshold with the best F1; languages with few cases lean on the others."""
        grid = np.round(np.arange(0.2, 0.81, 0.05), 2)
        out = {}
        for lang in [*sorted({x for x in langs if x}), ""]:
            own = np.where(langs == lang, 1.0, 0.1) if lang else np.ones(len(y))
            row = []
            for c in range(len(CATEGORIES)):
                real = y[:, c] >= 0.5
                f1 = []
                for t in grid:
                    hit = held[:, c] >= t
                    tp, fp, fn = (own[hit & real].sum(), own[hit & ~real].sum(), own[~hit & real].sum())
                    f1.append(2 * tp / max(1e-9, 2 * tp + fp + fn))
                best = np.flatnonzero(np.array(f1) >= max(f1, default=0) - 1e-9) if f1 else [len(grid) // 2]
                row.append(float(np.median(grid[best])) if sum(real) else 0.5)
            out[lang] = row
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        docs = [self.speller.ids(w) for w in _words_of(texts)]
        if not hasattr(self, "looked"):
            self.looked = [m.tables() for m in self.models]
        return np.mean([m.score(docs, t) for m, t in zip(self.models, self.looked, strict=True)], 0) if docs else np.zeros((0, len(CATEGORIES)))

    def threshold(self, lang: str | None) -> list[float]:
        return self.thresholds.get(lang or "", self.thresholds[""])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "looked"}


def fit_toxicity(docs: DataFrame, ratings: DataFrame) -> Classifier:
    """From rated documents, and a sample of the others as weak examples of ordinary text; the folds are fitted on the executors.

    A document that most raters call toxic counts for every category that one of them names; lone and split votes weigh less.
    """
    votes = ratings.where("doc_id is not null and toxic is not null").distinct().groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("toxic").alias("toxic"), *(F.sum((F.col("category") == c).cast("int") * F.col("toxic")).alias(c) for c in CATEGORIES)
    )
    every = docs.select("doc_id", "text", "lang").where("text is not null")
    rows = bounded_sample(every.join(votes, "doc_id"), SAMPLE, "doc_id").collect()
    others = bounded_sample(every.join(votes, "doc_id", "left_anti"), min(UNRATED, 3 * len(rows)), "doc_id").collect() if rows else []
    y, weight = np.zeros((len(rows) + len(others), len(CATEGORIES)), np.float32), np.full((len(rows) + len(others), len(CATEGORIES)), WEAK, np.float32)
    for i, r in enumerate(rows):
        named = np.array([r[c] or 0 for c in CATEGORIES], float)
        share = r.toxic / r.n
        if share > 0.5:
            y[i], weight[i] = named > 0, (1.0 if r.n > 1 else 0.8) if named.any() else 0.0
        else:
            weight[i] = 0.3 if share else 1.0 if r.n > 1 else 0.8
    weight[y > 0] *= 3
    rated = np.arange(len(y)) < len(rows)

    def each(fit: Callable, folds: range) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for k in b.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(fit(k))], pa.binary())], ["id", "fitted"])

        done = docs.sparkSession.range(0, len(folds), 1, len(folds)).mapInArrow(run, "id long, fitted binary").collect()
        return [pickle.loads(r.fitted) for r in sorted(done, key=lambda r: r.id)]

    texts = [*rows, *others]
    return Classifier([r.text for r in texts], [r.lang for r in texts], y, weight, rated, each=each)


def score_toxicity(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, lang, source; others kept) with abusive, hateful, sexual (scores) and categories (those over the thresholds of the language).

    Null and empty texts score as a text without words; texts of any length are read whole. Without ratings every score is the same and low.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_toxicity(docs, ratings))
    kept = [c for c in docs.columns if c not in (*CATEGORIES, "categories")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            p = model.value.score([t or "" for t in b.column("text").to_pylist()])
            over = [[c for c, x, t in zip(CATEGORIES, row, model.value.threshold(lang), strict=True) if x >= t] for row, lang in zip(p, b.column("lang").to_pylist(), strict=True)]
            cols = [*b.columns, *(pa.array(p[:, i].astype(float)) for i in range(len(CATEGORIES))), pa.array(over, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, *CATEGORIES, "categories"])

    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, schema + "".join(f", {c} double" for c in CATEGORIES) + ", categories array<string>")


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), table(spark, sf_dir, "toxic_labels"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("doc_id", F.explode("categories").alias("category")).distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, documents, flagged, rate, mean score) of each source."""
    s = _scored(spark, sf_dir).select("source", (F.size("categories") > 0).cast("long").alias("flagged"), F.greatest(*CATEGORIES).alias("score"))
    by = s.groupBy("source").agg(F.count("*").alias("documents"), F.sum("flagged").alias("flagged"), F.avg("score").alias("mean_score"))
    return by.withColumn("rate", F.col("flagged") / F.col("documents"))
