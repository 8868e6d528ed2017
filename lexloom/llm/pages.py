"""Problem 2: page noise in texts taken from scanned pages.

Three kinds of noise are found and repaired. `misread`: every token that the corpus hardly knows retrieves the corpus
words that share character q-grams with it by an inverted join; boosted trees, trained on corrupted corpus words,
rank the candidates and decide whether the best one replaces the token. `hyphen` and `running`: boosted trees over
pairs of neighbouring lines (or of places where a line break may have become a blank) decide whether the pair joins to one
word and whether a line is page furniture. All statistics cover the whole corpus.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.learn import Boosted, bounded_sample
from lexloom.llm.refs import texts
from lexloom.llm.streams import bounded, code_points, gram_hashes, windows
from lexloom.operators.lineage import cut_table
from lexloom.sources.tables import table

# Glyph confusions of scanners, "true seen".
CONFUSIONS = (
    "m rn,rn m,d cl,cl d,e c,c e,i l,l i,i 1,l 1,i |,l |,o 0,s 5,b 6,g 9,q 9,a @,h b,b h,n ri,u ii,w vv,t f,f t,b 8,z 2,u v,v u,"
    "n u,u n,li h,h li,in m,ni m,é e,á a,ó o,a o,o c,y v,g q,t l,l t,ü ii,u n,s $,t 7,z 7,e o,ö o,ä a,a 4,e 3,ri n,ii u,vv w,h n,r n"
).split(",")
COST = {tuple(c.split()): 0.25 for c in CONFUSIONS}
LONG = max(len(x) for pair in COST for x in pair)

MARK = "\x01"
HYPHENS = "-‐‑¬\xad"
#: A hyphen, a line break or the blank it became, and a letter after it.
BROKEN = regex.compile(r"(?<=\p{L})([-‐‑¬\xAD])(?:[ \t]*\n[ \t]*| )(?=\p{L})")
IGNORABLE = re.compile("[\u200b-\u200f\u2060\ufeff\ufe00-\ufe0f]")
EDGES = regex.compile(r"^[\p{P}\p{S}--[|@$]]+|[\p{P}\p{S}--[|@$]]+$", regex.V1)
LETTER = regex.compile(r"\p{L}")
#: Runs of Latin letters: a name in a Chinese text has no blanks around it.
LATIN = regex.compile(r"\p{IsLatin}[\p{IsLatin}\p{Nd}’'-]*")
#: Ratio by which a word must outnumber a token to count as its true form, and the least count of such a word.
RATIO, WORD = 60, 6
#: The same ratio for tokens with a digit or sign among their letters, which hardly are words of their own.
ODD_RATIO = 15
RATIO_LEAST = min(RATIO, ODD_RATIO)
#: Bound on the corpus words that the rankers are trained on (the most frequent ones) and on the training pairs.
TRAIN_WORDS, TRAIN_PAIRS = 4000, 20000
CUT = 0.7
#: A generalised furniture line counts as such from this number of records and of different words in its open place.
FURNITURE = 3
#: Bound on the clean texts that the line classifier is trained on.
TRAIN_TEXTS = 3000


Token = tuple[str, str | None, str | None, str | None]


class Tokens(dict):
    """The token of each run of characters without a blank, None where it has no letter; worked out once for each different run."""

    def __missing__(self, raw: str) -> Token | None:
        t = EDGES.sub("", raw).lower()
        out: Token | None = None
        if LETTER.search(t):
            part = t.split(MARK)
            if len(part) == 1:
                out = (t, None, None, None)
            else:
                out = (re.sub(MARK + ".", "", t), EDGES.sub("", part[0]), EDGES.sub("", part[1][1:]), part[1][:1])
        if len(self) < 500_000:
            self[raw] = out
        return out

    def of(self, text: str) -> list[Token]:
        """The tokens of a text, lower case, without edge punctuation, as (token, a, b, hyphen).

        A word that may be broken has its parts in a and b, its hyphen in `hyphen` and its joined form in token; else these are None.
        """
        if IGNORABLE.search(text):
            text = IGNORABLE.sub("", text)
        if any(h in text for h in HYPHENS):
            text = re.sub("(?<!\x01)\xad", "", BROKEN.sub(MARK + r"\1", text))
        return [t for t in map(self.__getitem__, text.split()) if t]


def name_counts(pairs: DataFrame) -> DataFrame:
    """(token, shown, copied): of the different `pairs` (text, target) with the token in the text how many there are, and how many have it in the target too
    (names and codes do). Counted in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in bounded(bounded(batches, "text"), "target"):
            shown, copied = Counter(), Counter()
            for s, t in zip(b.column("text").to_pylist(), b.column("target").to_pylist(), strict=True):
                own = {x[0] for x in known.of(s) if x[1] is None}
                shown.update(own)
                copied.update(own.intersection([*(x[0] for x in known.of(t)), *LATIN.findall(t.lower())]))
            yield pa.RecordBatch.from_arrays([pa.array(list(shown), pa.string()), pa.array(list(shown.values()), pa.int64()), pa.array([copied[w] for w in shown], pa.int64())], ["token", "shown", "copied"])

    both = pairs.where("text is not null and target is not null").select("text", "target").distinct()
    return both.mapInArrow(count, "token string, shown long, copied long").groupBy("token").agg(F.sum("shown").alias("shown"), F.sum("copied").alias("copied"))


def _word(c: str = "token") -> Column:
    return F.col(c).rlike(r"^[\p{L}]+(['’-][\p{L}]+)*$")


def _name() -> Column:
    """Copied into half of the targets: a coined name or a code."""
    return (F.col("shown") >= 2) & (F.col("copied") >= 0.5 * F.col("shown"))


GRAM_BITS = 18


def _gram_stream(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different q-grams of each word, the word of each): two characters for words of up to seven, three for those of four or more; ends count."""
    framed = [f"^{w}$" for w in words]
    size = np.fromiter(map(len, words), np.int64, len(words))
    codes, starts = code_points(framed)
    found, owner = [], []
    for q, ok in ((2, size <= 7), (3, size >= 4)):
        at, row = windows(starts, q + 1)
        keep = ok[row]
        found.append(gram_hashes(codes, at[keep], q))
        owner.append(row[keep])
    h, row = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


def _kept(size: np.ndarray) -> np.ndarray:
    """Of so many q-grams of a token, those that a candidate shares at least: two confusions change up to fourteen, but two must stay."""
    return np.maximum(2, size - 14)


def gram_counts(words: DataFrame, column: str) -> np.ndarray:
    """How many words have a q-gram, by bucket of its hash; the table has 2 ** GRAM_BITS places whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << GRAM_BITS, np.int64)
        for b in bounded(batches, column):
            total += np.bincount((_gram_stream(b.column(column).to_pylist())[0] >> np.uint64(64 - GRAM_BITS)).astype(np.int64), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(1 << GRAM_BITS, np.int64)
    found = words.select(column).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[found.bucket] = found.n
    return out


def candidates(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """(token, cand, n_cand): words within three edits of a token (token, n) that share two q-grams with it, or one if it has up to four letters, and
    outnumber it by RATIO.

    One inverted join on gram and length class. Of its q-grams each side sends the rarest ones only, so many that two words with enough in common meet in
    one of them; the grams of endings, which most words have, are hardly ever among them.
    """
    often = words.sparkSession.sparkContext.broadcast(gram_counts(words, "cand"))

    def side(df: DataFrame, name: str, count: str, spread: tuple[int, ...]) -> DataFrame:
        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in bounded(batches, name):
                ws = b.column(name).to_pylist()
                h, row = _gram_stream(ws)
                size = np.bincount(row, minlength=len(ws))
                order = np.lexsort((h, often.value[(h >> np.uint64(64 - GRAM_BITS)).astype(np.int64)], row))
                h, row = h[order], row[order]
                rank = np.arange(len(row)) - (np.cumsum(size) - size)[row]
                length = np.fromiter(map(len, ws), np.int64, len(ws))
                # One gram in common is enough for the shortest.
                keep = rank < np.where(length <= 4, size, size - _kept(size) + 1)[row]
                h, row = h[keep], row[keep]
                key = np.concatenate([(h + np.uint64(0x9E3779B97F4A7C15) * (length[row] // 3 + k).astype(np.uint64)).view(np.int64) for k in spread])
                row = pa.array(np.tile(row, len(spread)))
                yield pa.RecordBatch.from_arrays([b.column(name).take(row), b.column(count).take(row), pa.array(key)], [name, count, "key"])

        return df.select(name, count).mapInArrow(send, f"{name} string, {count} long, key long")

    hits = side(unknown, "token", "n", (-1, 0, 1)).join(side(words, "cand", "n_cand", (0,)), "key")
    ratio = F.when(F.col("token").rlike(r"[^\p{L}'’-]"), ODD_RATIO).otherwise(RATIO)
    hits = hits.where((F.col("n_cand") >= RATIO_LEAST * F.col("n")) & (F.abs(F.length("token") - F.length("cand")) <= 3) & (F.col("token") != F.col("cand")))
    hits = hits.where((F.levenshtein("token", "cand", 3) >= 0) & (F.col("n_cand") >= ratio * F.col("n")))
    return hits.select("token", "cand", "n_cand").distinct()


def _framed(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, a row for each word, zero behind its end; lengths)."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    out = np.zeros((len(words), int(size.max(initial=0)) + 1), np.uint32)
    out[np.arange(out.shape[1])[None, :] < size[:, None]] = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, size


@lru_cache(1)
def _confusions() -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int], dict[tuple[int, int], np.ndarray]]:
    """(number of each glyph group that is misread, of each that is read, by their lengths the costs of reading one as the other)."""
    groups = [{g: i + 1 for i, g in enumerate(sorted({pair[side] for pair in COST}))} for side in (0, 1)]
    costs = {(x, y): np.full((len(groups[0]) + 1, len(groups[1]) + 1), np.inf, np.float32) for x in range(1, LONG + 1) for y in range(1, LONG + 1)}
    for (a, b), c in COST.items():
        costs[len(a), len(b)][groups[0][a], groups[1][b]] = c
    return groups[0], groups[1], costs


def _groups(codes: np.ndarray, groups: dict[str, int], n: int) -> np.ndarray:
    """The number of the glyph group of n characters that starts at each place, 0 where there is none."""
    out = np.zeros(codes.shape, np.int64)
    for g, i in groups.items():
        if len(g) == n:
            same = codes == ord(g[0])
            if n == 2:
                same[:, :-1] &= codes[:, 1:] == ord(g[1])
                same[:, -1] = False
            out[same] = i
    return out


def distances(true: list[str], seen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(glyph distances, edit distances) from words to what was read, all pairs at once, a cell of the table at a time.

    In the glyph distance confusions of glyphs cost a quarter of an edit.
    """
    glyph, edits = np.zeros(len(true)), np.zeros(len(true), np.int64)
    order = sorted(range(len(true)), key=lambda i: (len(true[i]), len(seen[i])))
    at = 0
    while at < len(order):
        to, wide = at, 0
        while to < len(order) and ((to - at + 1) * (len(true[order[to]]) + 1) * (max(wide, len(seen[order[to]])) + 1) <= 4_000_000 or to == at):
            wide = max(wide, len(seen[order[to]]))
            to += 1
        rows = order[at:to]
        glyph[rows], edits[rows] = _distances([true[i] for i in rows], [seen[i] for i in rows])
        at = to
    return glyph, edits


def _distances(true: list[str], seen: list[str]) -> tuple[np.ndarray, np.ndarray]:
    (t, n), (s, m) = _framed(true), _framed(seen)
    misread, read, costs = _confusions()
    kinds = {(x, y): costs[x, y][_groups(t, misread, x)[:, :, None], _groups(s, read, y)[:, None, :]].transpose(1, 2, 0) for x, y in costs}
    other = (t[:, :, None] != s[:, None, :]).transpose(1, 2, 0).astype(np.float32)
    shape = (t.shape[1], s.shape[1], len(true))
    g, e = np.empty(shape, np.float32), np.empty(shape, np.float32)
    for i in range(shape[0]):
        for j in range(shape[1]):
            ways = [(g[i - 1, j] + 1, e[i - 1, j] + 1)] * (i > 0) + [(g[i, j - 1] + 1, e[i, j - 1] + 1)] * (j > 0)
            if i and j:
                ways.append((g[i - 1, j - 1] + other[i - 1, j - 1], e[i - 1, j - 1] + other[i - 1, j - 1]))
            a = b = np.zeros(shape[2], np.float32)
            if ways:
                a, b = ways[0][0], ways[0][1]
                for x, y in ways[1:]:
                    a, b = np.minimum(a, x), np.minimum(b, y)
            for (x, y), k in kinds.items():
                if i >= x and j >= y:
                    a = np.minimum(a, g[i - x, j - y] + k[i - x, j - y])
            g[i, j], e[i, j] = a, b
    row = np.arange(len(true))
    return g[n, m, row], e[n, m, row]


def glyph_distance(true: str, seen: str) -> float:
    return float(distances([true], [seen])[0][0])


def edit_distance(a: str, b: str) -> int:
    return int(distances([a], [b])[1][0])


def features(tokens: list[str], cands: list[str], n_cand: list[int]) -> np.ndarray:
    """A row for each token and candidate."""
    glyph, edits = distances(cands, tokens)
    odd, prefix = np.zeros(len(tokens)), np.zeros(len(tokens))
    for i, (t, c) in enumerate(zip(tokens, cands, strict=True)):
        odd[i] = sum(not x.isalpha() for x in t) - sum(not x.isalpha() for x in c)
        prefix[i] = next((j for j, (x, y) in enumerate(zip(t, c, strict=False)) if x != y), min(len(t), len(c)))
    size, seen = (np.fromiter(map(len, x), float, len(tokens)) for x in (cands, tokens))
    return np.stack([glyph, edits, glyph / size, edits / size, odd, size, seen - size, np.log1p(np.array(n_cand, float)), prefix, glyph / np.maximum(edits, 1)], 1) if tokens else np.zeros((0, 10))


def corrupted(word: str, rng: np.random.Generator) -> str:
    """The word with one or two glyphs read wrong."""
    for _ in range(1 + (rng.random() < 0.25)):
        spots = [(i, a, b) for a, b in COST for i in range(len(word) - len(a) + 1) if word.startswith(a, i)]
        if spots:
            i, a, b = spots[rng.integers(len(spots))]
            word = word[:i] + b + word[i + len(a) :]
    return word


def unmistaken(words: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """The words without those that one glyph confusion makes of a word RATIO times as frequent: in a large corpus misreadings are frequent too."""
    known, bad = dict(words), set()
    for w, n in words:
        for (a, b), i in ((pair, i) for pair in COST for i in range(len(w) - len(pair[0]) + 1)):
            if w.startswith(a, i) and RATIO * known.get(seen := w[:i] + b + w[i + len(a) :], n) <= n:
                bad.add(seen)
    return [w for w in words if w[0] not in bad]


def train_ranker(words: list[tuple[str, int]], seed: int = 7) -> Boosted:
    """From the most frequent corpus words: corrupted words with their true form are right; with another near word, and
    words with a letter changed at random (as other words and names are), are wrong."""
    rng = np.random.default_rng(seed)
    rows: list[tuple[str, str, int, int]] = []
    words = [w for w in unmistaken(words) if len(w[0]) >= 3][:TRAIN_WORDS]
    by_size: dict[int, list[tuple[str, int]]] = {}
    for w in words:
        by_size.setdefault(len(w[0]), []).append(w)
    letters = "abcdefghijklmnopqrstuvwxyzäöüéáíóèñа"
    each = max(1, TRAIN_PAIRS // max(1, 3 * len(words)))
    near: list[tuple[str, list[tuple[str, int]], int]] = []
    for w, n in words:
        for _ in range(each):
            bad = corrupted(w, rng)
            if bad != w:
                rows.append((bad, w, n, 1))
                near.append((bad, [v for v in (by_size.get(len(bad), []) + by_size.get(len(w), []))[:40] if v[0] != w], 3))
            # A word of its own beside a more frequent one.
            near.append((w, [v for v in by_size.get(len(w) + int(rng.integers(-1, 2)), [])[:60] if v[0] != w and v[1] > n], 2))
            i = rng.integers(len(w))
            c = letters[rng.integers(len(letters))]
            other = (w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w[:i] + w[i + 1 :])[rng.integers(3)]
            if other not in (w, "") and (w[i : i + 1], c) not in COST:
                rows.append((other, w, n, 0))
    # Of the other words near a form, the first within so many edits.
    asked = [(bad, v, k, most, i) for i, (bad, vs, most) in enumerate(near) for v, k in vs]
    edits = distances([a[1] for a in asked], [a[0] for a in asked])[1]
    done: set[int] = set()
    for (bad, v, k, most, i), d in zip(asked, edits.tolist(), strict=True):
        if d <= most and i not in done:
            done.add(i)
            rows.append((bad, v, k, 0))
    x, y = features([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]), np.array([r[3] for r in rows])
    if len(set(y.tolist())) < 2:
        x, y = np.array([[0.25, 1, 0.05, 0.2, 0, 5, 0, 3, 2, 0.25], [2, 2, 0.4, 0.4, 0, 5, 0, 3, 2, 1]] * 20), np.array([1, 0] * 20)
    return Boosted(40, 3).fit(x, y)


def misreadings(lex: DataFrame) -> DataFrame:
    """(token, word, n_word, p): tokens of the lexicon that are misread, each with its true form and how often that occurs."""
    words = lex.where(_word() & ~_name() & (F.col("n") >= WORD) & (F.length("token") >= 2))
    top = words.orderBy(F.desc("n"), "token").select("token", "n").limit(2 * TRAIN_WORDS).collect()
    model = lex.sparkSession.sparkContext.broadcast(train_ranker([(r.token, r.n) for r in top]))
    # Tokens of one script, and no code of capitals and digits: at least half letters.
    unknown = lex.where(~_name() & (F.length("token") >= 2) & ~F.col("token").rlike(r"[\x{FF00}-\x{FFEF}\p{M}\x{FB00}-\x{FB06}]"))
    mixed = F.col("token").rlike(r"[a-zß-ÿ]") & F.col("token").rlike(r"[\x{370}-\x{52F}]")
    unknown = unknown.where(~mixed & (2 * F.length(F.regexp_replace("token", r"[^\p{L}]", "")) >= F.length("token"))).select("token", "n")
    found = candidates(unknown, words.select(F.col("token").alias("cand"), F.col("n").alias("n_cand")))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = model.value.score(features(*(b.column(c).to_pylist() for c in ("token", "cand", "n_cand"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], ["token", "cand", "n_cand", "p"])

    ranked = found.mapInArrow(rank, "token string, cand string, n_cand long, p double").where(F.col("p") >= CUT)
    best = ranked.groupBy("token").agg(F.max(F.struct("p", "n_cand", "cand")).alias("best"))
    return best.select("token", F.col("best.cand").alias("word"), F.col("best.n_cand").alias("n_word"), F.col("best.p").alias("p"))


def train_joiner(counts: dict[str, int], seed: int = 7) -> Boosted:
    """From the lexicon's most frequent entries: words cut at a random place join; compounds cut at their hyphen, and neighbouring
    words, do not."""
    rng = np.random.default_rng(seed)
    words = [w for w in counts if w.isalpha() and len(w) >= 4][:TRAIN_WORDS]
    compounds = [w for w in counts if w.count("-") == 1 and re.fullmatch(r"[^\W\d]+-[^\W\d]+", w)]
    x, y = [], []

    def add(a: str, b: str, joined: int, compound: int, good: int) -> None:
        x.append(join_features(a, b, HYPHENS[rng.integers(len(HYPHENS))], joined, compound, counts.get(a, 0), counts.get(b, 0)))
        y.append(good)

    for w in words:
        i = int(rng.integers(2, len(w) - 1))
        add(w[:i], w[i:], counts[w], 0, 1)
        v = words[rng.integers(len(words))]
        add(w, v, counts.get(w + v, 0), 0, 0)
        i = int(rng.integers(2, len(w) - 1))
        add(w[:i], w[i:] + "x", 0, 0, int(rng.random() < 0.5))
    for c in compounds * max(1, len(words) // max(1, 2 * len(compounds))):
        a, b = c.split("-")
        add(a, b, counts.get(a + b, 0), counts[c], 0)
    if len(set(y)) < 2:
        x, y = [join_features("ab", "cd", "-", 9, 0, 0, 0), join_features("ab", "cd", "-", 0, 9, 9, 9)] * 20, [1, 0] * 20
    return Boosted(30, 3).fit(np.array(x), np.array(y))


def join_features(a: str, b: str, hyphen: str, joined: int, compound: int, n_a: int, n_b: int) -> list[float]:
    return [math.log1p(joined), math.log1p(compound), math.log1p(joined) - math.log1p(compound), math.log1p(n_a), math.log1p(n_b), len(a), len(b), hyphen in "¬\xad"]


def joins(toks: DataFrame, lex: DataFrame, wrong: DataFrame) -> DataFrame:
    """(a, b, hyphen): broken words that are written without the hyphen when joined, of the distinct ones in `toks`."""
    some = toks.where("a is not null").select("a", "b", "hyphen", F.col("token").alias("joined")).distinct()
    # One look-up of all four forms; a misread joined form counts as often as its true form.
    keys = ("joined", F.col("joined")), ("compound", F.concat_ws("-", "a", "b")), ("a", F.col("a")), ("b", F.col("b"))
    asked = some.select("a", "b", "hyphen", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("token")) for k, c in keys))).alias("key")).select("a", "b", "hyphen", "key.*")
    known = lex.select("token", "n", F.lit(False).alias("right")).unionByName(wrong.select("token", F.col("n_word").alias("n"), F.lit(True).alias("right")))
    n = asked.join(known, "token", "left").where("coalesce(not right, true) or kind = 'joined'")
    # Without a match the row stays, so that every form comes out.
    some = n.groupBy("a", "b", "hyphen").agg(*(F.coalesce(F.max(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, _ in keys))
    top = lex.where((F.col("n") >= 3) & F.col("token").rlike(r"^\p{L}+(-\p{L}+)?$")).orderBy(F.desc("n"), "token").select("token", "n").limit(2 * TRAIN_WORDS).collect()
    model = lex.sparkSession.sparkContext.broadcast(train_joiner({r.token: r.n for r in top}))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([join_features(*r) for r in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True)]).reshape(-1, 8)
            yield b.select(["a", "b", "hyphen"]).filter(pa.array(model.value.score(x) >= 0.5))

    return some.mapInArrow(judge, "a string, b string, hyphen string")


NUMBER_LINE = re.compile(r"\W*(?:(?:p|pp|page|seite|s|pág|página|стр)\W{0,2})?\d{1,4}(?:\s*(?:/|of|von|de|из)\s*\d{1,4})?\W*", re.IGNORECASE)
SMALL = {"of", "the", "and", "for", "in", "de", "del", "des", "du", "der", "die", "das", "und", "für", "la", "le", "les", "el", "y", "et", "von", "и", "&"}


def line_features(lines: list[str], i: int, width: int) -> list[float]:
    """Of the pairs that line i forms with its neighbours; width is that of the longest line."""
    line = lines[i].strip()
    prev, nxt = (lines[i - 1].strip() if i else ""), (lines[i + 1].strip() if i + 1 < len(lines) else "")
    words = re.findall(r"[^\W\d_]+", line)
    big = [w for w in words if w.lower() not in SMALL]
    capital = sum(w[0].isupper() for w in big) / len(big) if big else -1
    upper = sum(w.isupper() and len(w) > 1 for w in words) / len(words) if words else -1
    ends = lambda t: bool(re.search(r"[.!?…:;。！？][\"'»”“)\]]*$", t))
    opens = lambda t: 0 if not t else 1 if t[0].isupper() else -1 if t[0].islower() else 0
    return [
        bool(NUMBER_LINE.fullmatch(line)), len(words), len(line) / max(width, 1), capital, upper, sum(c.isdigit() for c in line) / max(len(line), 1),
        ends(line), line.endswith(","), ends(prev) if prev else 2, opens(nxt), opens(line), i == 0, i == len(lines) - 1, len(lines),
        bool(re.search(r"\s[—|/·•–]\s", line)), bool(re.match(r"\W*\d+\b", line)), bool(re.search(r"\b\d+\W*$", line)), len(prev) / max(width, 1),
        sum(w.lower() in SMALL for w in words), prev.endswith(("-", "¬", "\xad", "‐")), bool(re.search(r"   +|\t", line)),
    ]


def train_lines(clean: list[str], seed: int = 7) -> Boosted:
    """From clean texts set in lines of random width, with made-up page numbers and running titles put between them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[rng.integers(len(xs))]
    long, short = [t for t in clean if len(t) > 60] or ["Some words stand here."], [t for t in clean if 8 < len(t) <= 60]
    words = sorted({w for t in long for w in re.findall(r"[^\W\d_]{3,}", t)}) or ["Some"]
    x, y = [], []
    for _ in range(1500):
        text = " ".join(pick(long) for _ in range(rng.integers(1, 7)))
        width, lines, now = int(rng.integers(30, 70)), [], ""
        for w in text.split():
            if now and len(now) + 1 + len(w) > width:
                lines.append(now)
                now = w
            else:
                now = f"{now} {w}".strip()
        page = [(t, 0) for t in [*lines, now]]
        if short and rng.random() < 0.2:
            page.insert(0, (pick(short), 0))

        def furniture() -> str:
            n = str(rng.integers(1, 400))
            if rng.random() < 0.5:
                return pick([f"— {n} —", f"- {n} -", f"– {n} –", n, f"[{n}]", f"p. {n}", f"({n})", f"Page {n}", f"{n} / 400", f"{n}."[: len(n) + 0]])
            ws = [pick(words) for _ in range(rng.integers(2, 5))]
            ws = [w[0].upper() + w[1:] for w in ws]
            if len(ws) > 2 and rng.random() < 0.4:
                ws[-2] = pick(["of", "of", "the", "de", "der", "und"])
            if rng.random() < 0.5:
                ws.insert(int(rng.integers(1, len(ws))), pick(["—", "/", "|", "·", "-"]))
            t = " ".join(ws)
            t = t.upper() if rng.random() < 0.3 else t
            return t if rng.random() < 0.6 else pick([f"{n} | {t}", f"{t}   {n}", f"{t} | {n}", f"{n} {t}"])

        torn = rng.random() < 0.25
        if torn:
            # No page at all, but a text with one line break somewhere.
            ws = pick(long + short).split(" ")
            cut = int(rng.integers(1, max(2, len(ws) // pick([1, 4]))))
            page = [(" ".join(ws[:cut]), 0), (" ".join(ws[cut:]), 0)]
            page = [p for p in page if p[0]]
        for _ in range(0 if torn else rng.integers(0, 3)):
            at = pick([0, len(page), int(rng.integers(0, len(page) + 1))])
            for _ in range(rng.integers(1, 3)):
                page.insert(at, (furniture(), 1))
        if len(page) > 1:
            ts = [t for t, _ in page]
            for i, (_, k) in enumerate(page):
                if k or rng.random() < 0.5:
                    x.append(line_features(ts, i, max(map(len, ts))))
                    y.append(k)
    return Boosted(60, 3).fit(np.array(x, float), np.array(y))


def furniture_lines(texts: list[str], model: Boosted) -> list[list[int]]:
    """Per text the numbers of the lines that are running headers, footers or page numbers; all texts are scored at once."""
    x, where = [], []
    for k, text in enumerate(texts):
        if "\n" not in text.strip():
            continue
        lines = text.split("\n")
        at = [i for i, t in enumerate(lines) if t.strip()]
        kept = [lines[i] for i in at]
        width = max(map(len, kept))
        x += [line_features(kept, i, width) for i in range(len(kept))]
        where += [(k, i) for i in at]
    out: list[list[int]] = [[] for _ in texts]
    if x:
        for j in np.flatnonzero(model.score(np.array(x, float)) >= 0.5):
            out[where[j][0]].append(where[j][1])
    return out


INLINE = re.compile(
    r"(?:^|(?<=[^\W_] )|(?<=[.!?…»”\")¬‐\xad-] ))(?:[—–-] \d{1,4} [—–-]|\[\d{1,4}\]|(?:p\.|[Pp]age|[Ss]eite|[Pp]ág\.|[Pp]ágina|[Сс]тр\.) ?\d{1,4}(?: (?:of|sur|von|de|из|/) \d{1,4})?)(?= |$)"
)
TITLE_WORD = re.compile(r"[^\w]*[^\W\d_a-zà-ÿа-яё][^\s]*|[—|/·–]|\d{1,4}|of|the|and|de|der|des|und|del|la")


def line_keys(line: str) -> list[str]:
    """A furniture line without digits and marks, once as it is and once for each word left open."""
    ws = re.findall(r"[^\W\d_]+", line.lower())
    return [" ".join(ws)] + [" ".join([*ws[:i], "*", *ws[i + 1 :]]) for i in range(len(ws))] if 2 <= len(ws) <= 6 else []


def title_grams(text: str) -> Iterator[str]:
    """Runs of two to six capitalised words of a text of one line."""
    run: list[str] = []
    for w in [*text.split(" "), ""]:
        if TITLE_WORD.fullmatch(w):
            run.append(w)
            continue
        run_words = [x for x in run if re.search(r"[^\W\d_]", x)]
        for n in range(2, min(6, len(run_words)) + 1):
            for i in range(len(run_words) - n + 1):
                yield " ".join(run_words[i : i + n])
        run = []


READ = "ref string, kind string, token string, a string, b string, hyphen string, n int"


def read(rows: DataFrame, model) -> DataFrame:
    """Everything that one reading of `rows` (ref, text) gives, as rows (ref, kind, token, a, b, hyphen, n).

    `model` is a broadcast line classifier: lines are judged by their neighbours, and those that are furniture do not count as text. Kinds: `token`, a
    token of the record and how often it occurs; `furniture`, a record with such lines; `key`, a key of one of them and in `a` the word left open; `number`,
    a page number inside a line; `title`, a key of a phrase of capitals inside a line and in `a` the phrase.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Tokens()
        for b in bounded(batches, "text"):
            texts_ = b.column("text").to_pylist()
            words, places, counts, broken = [], [], [], []
            lines, keys, numbers, titles = [], [], [], []
            for i, (t, found) in enumerate(zip(texts_, furniture_lines(texts_, model.value), strict=True)):
                if found:
                    drop, ls = set(found), t.split("\n")
                    lines.append(i)
                    for j in found:
                        ks, ws = line_keys(ls[j]), re.findall(r"[^\W\d_]+", ls[j].lower())
                        keys += [(i, k, f) for k, f in zip(ks, ["", *ws], strict=False)]
                    t = "\n".join(x for j, x in enumerate(ls) if j not in drop)
                own = Counter(known.of(t))
                for token, n in own.items():
                    if token[1] is None:
                        words.append(token[0])
                        places.append(i)
                        counts.append(n)
                    else:
                        broken.append((i, *token, n))
                numbers += [(i, x) for x in inline_numbers(t)]
                if "\n" not in t.strip():
                    titles += [(i, k, g) for g in set(title_grams(t.strip())) for k in line_keys(g)]
            refs = b.column("ref")
            for kind, cols in (("token", [places, words, None, None, None, counts]), ("token", list(zip(*broken, strict=True))), ("furniture", [lines]), ("key", list(zip(*keys, strict=True))), ("number", list(zip(*numbers, strict=True))), ("title", list(zip(*titles, strict=True)))):
                if cols and cols[0]:
                    size, types = len(cols[0]), [pa.string()] * 4 + [pa.int32()]
                    more = [pa.nulls(size, t) if c is None else pa.array(c, t) for c, t in zip([*cols[1:], *[None] * (6 - len(cols))], types, strict=True)]
                    kinds = pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int8)), pa.array([kind])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([refs.take(pa.array(cols[0], pa.int64())), kinds, *more], ["ref", "kind", "token", "a", "b", "hyphen", "n"])

    return rows.select("ref", "text").mapInArrow(run, READ)


def inline_numbers(text: str) -> list[str]:
    """Page numbers inside the lines of a text, where a line break was lost; a line that is nothing but one is none."""
    out = []
    for line in text.split("\n"):
        line = line.strip()
        out += [m.group().strip() for m in INLINE.finditer(line) if _rest_of(line, m.group())]
    return out


def _rest_of(line: str, part: str) -> bool:
    """Whether the line holds a sentence besides the part: five words, or four Chinese characters."""
    rest = line.replace(part, " ", 1)
    return len(re.findall(r"[^\W\d_]+", rest)) >= 5 or len(re.findall("[㐀-鿿]", rest)) >= 4


def running(seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ref) of the records with furniture lines, and (ref, title) of those with a page number or a known furniture line inside a line.

    `seen`: what `read` gives. Where line breaks were lost, titles are found as phrases that are furniture lines of other records.
    """
    known = seen.where("kind = 'key'").groupBy(F.col("token").alias("key")).agg(F.count_distinct("a").alias("fillers"), F.count_distinct("ref").alias("refs"))
    known = known.where((F.col("refs") >= FURNITURE) & ((F.instr("key", "*") == 0) | (F.col("fillers") >= FURNITURE))).select(F.col("key").alias("token"))
    titles = seen.where("kind = 'title'").join(known, "token", "left_semi").select("ref", F.col("a").alias("title"))
    return seen.where("kind = 'furniture'").select("ref"), seen.where("kind = 'number'").select("ref", F.col("token").alias("title")).unionByName(titles).distinct()


def page_noise(rows: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, object]:
    """(found, changes, titles, line model) for `rows` (ref, text) with corpus statistics from them and from `pairs` (text, target).

    found: (ref, noise), one row per record and kind. changes: (ref, token, word, a, b, hyphen), what to put right where. titles: see `running`.
    Null and empty texts have no noise; repeated records count once; a text of any length is read whole.
    """
    rows = rows.where("text is not null").select("ref", "text").distinct()
    clean = bounded_sample(rows.select("text").where(~F.col("text").contains("\n") & (F.length("text") < 400)), TRAIN_TEXTS, "text").collect()
    model = rows.sparkSession.sparkContext.broadcast(train_lines([r.text for r in clean]))
    seen = cut_table(read(rows, model))
    lines, titles = running(seen)
    titles = cut_table(titles)
    toks = seen.where("kind = 'token'").select("ref", "token", "a", "b", "hyphen", "n")
    n = toks.where("a is null").groupBy("token").agg(F.sum("n").alias("n"))
    lex = cut_table(n.join(name_counts(pairs), "token", "left").select("token", "n", F.coalesce("shown", F.lit(0)).alias("shown"), F.coalesce("copied", F.lit(0)).alias("copied")))
    toks = toks.drop("n")
    wrong = cut_table(misreadings(lex))
    broken = cut_table(joins(toks, lex, wrong))
    misread = toks.join(wrong.select("token", "word"), "token").select("ref", "token", "word", "a", "b", "hyphen")
    split = toks.where("a is not null").join(broken, ["a", "b", "hyphen"]).select("ref", "token", F.lit(None).cast("string").alias("word"), "a", "b", "hyphen")
    # A broken compound is no misread word.
    misread = misread.where("a is null").unionByName(misread.where("a is not null").join(broken, ["a", "b", "hyphen"], "left_semi").select(*misread.columns))
    changes = cut_table(misread.unionByName(split))
    found = changes.select("ref", F.when(F.col("word").isNull(), "hyphen").otherwise("misread").alias("noise"))
    found = found.unionByName(lines.unionByName(titles.select("ref")).withColumn("noise", F.lit("running")))
    return found.distinct(), changes, titles, model


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pairs = table(spark, sf_dir, "regions").select(F.col("source_text").alias("text"), F.col("target_text").alias("target"))
    return texts(spark, sf_dir, region="source_text", selection="detected_text"), pairs


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_noise(*_inputs(spark, sf_dir))[0]


def repair(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """(ref, repaired, kinds) for every record of `rows` (ref, text): continuous paragraphs and the sorted kinds of noise that were in it.

    Furniture is taken out, broken words are joined, misread words replaced (in the case of the token), and lines joined by blanks;
    empty lines go on parting paragraphs. Null texts are left out.
    """
    rows = rows.where("text is not null").select("ref", "text").distinct()
    found, changes, titles, model = page_noise(rows, pairs)
    todo = changes.groupBy("ref").agg(F.collect_set(F.struct("token", "word", "a", "b", "hyphen")).alias("todo"))
    out = titles.groupBy("ref").agg(F.collect_set("title").alias("titles"))
    kinds = found.groupBy("ref").agg(F.sort_array(F.collect_set("noise")).alias("kinds"))
    every = rows.join(todo, "ref", "left").join(out, "ref", "left").join(kinds, "ref", "left")

    def fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "text"):
            d = b.to_pydict()
            drop = furniture_lines(d["text"], model.value)
            done = [repaired(t, x or [], y or [], z) if k else t for t, x, y, z, k in zip(d["text"], d["todo"], d["titles"], drop, d["kinds"], strict=True)]
            kinds = pa.array([k or [] for k in d["kinds"]], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column("ref"), pa.array(done, pa.string()), kinds], ["ref", "repaired", "kinds"])

    return every.mapInArrow(fix, "ref string, repaired string, kinds array<string>")


def repaired(text: str, changes: list[dict], titles: list[str], drop: list[int]) -> str:
    """The text with the given changes made and without the given lines."""
    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in drop)
    for t in sorted(titles, key=len, reverse=True):
        text = text.replace(t + " ", "", 1) if t + " " in text else text.replace(t, "", 1)
    for c in changes:
        if c["a"] is not None:
            text = re.sub(rf"({re.escape(c['a'])}){re.escape(c['hyphen'])}\s+({re.escape(c['b'])})", r"\1\2", text, flags=re.IGNORECASE)
    for c in changes:
        if c["word"] is not None:
            text = re.sub(rf"(?<!\w){re.escape(c['token'])}(?!\w)", lambda m, w=c["word"]: _cased(w, m.group()), text, flags=re.IGNORECASE)
    return re.sub(r"[ \t]*\n[ \t]*(?!\n)", " ", re.sub(r"\n\s*\n+", "\n\n", text)).strip() if "\n\n" not in text else re.sub(r"(?<!\n)\n(?!\n)", " ", text)


def _cased(word: str, like: str) -> str:
    letters = [c for c in like if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return word.upper()
    return word[0].upper() + word[1:] if letters and like[0].isupper() or like[:1] in "0568" and letters and letters[0].isupper() else word


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*_inputs(spark, sf_dir))
