"""Problem 4: the languages of text runs, by cross-parsing.

For each language a suffix automaton is built over labelled text. A segment is parsed with the automaton of every language into
the fewest phrases that occur in the labelled text (greedy longest matches); the language that needs the fewest phrases per
letter wins. All segments of a batch go through the automata in lockstep as table look-ups.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.charfold import CYRILLIC, TO_LATIN, look, script_of
from lexloom.llm.learn import bounded_sample
from lexloom.llm.streams import bounded
from lexloom.sources.tables import table

LANGUAGES = ("en", "de", "fr", "es", "ru", "zh")
# The ISO codes of three letters and usual names of the languages.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles английский 英语 英文",
    "de": "de deu ger german deutsch allemand alemán aleman немецкий 德语 德文",
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances французский 法语 法文",
    "es": "es spa spanish spanisch espagnol español espanol castellano castilian испанский 西班牙语 西班牙文",
    "ru": "ru rus russian russisch russe ruso русский 俄语 俄文",
    "zh": "zh zho chi cmn chinese chinesisch chinois chino mandarin китайский 中文 汉语 漢語 普通话",
}
BY_NAME = {n: code for code, names in NAMES.items() for n in names.split()}

#: Bounds on the labelled text that the automata are built over: runs taken, and characters per language.
SAMPLE_RUNS, SAMPLE_CHARS = 12000, 40000
#: Runs with fewer letters are left out; a segment of another language than its run's needs this many letters (a third of it in Chinese).
LEAST, OWN = 12, 12
#: Confidence from which a labelled text is taken into an automaton.
SURE = 0.15
#: Phrases that a change of language between neighbouring segments costs.
SWITCH = 3.0
SENTENCE = re.compile(r"(?<=[.!?…])[\"'»”“)\]]*\s+(?=\S)|(?<=[。！？；])|(?<=[^\W\d])\s+[|/—–-]\s+|[()（）«»“”„\"]\s*|(?<=[:;])\s+")
#: Characters that one automaton run reads at most.
LONGEST = 400
BREAK, DIGIT, HAN, FIRST = 1, 2, 3, 40


@lru_cache(4096)
def language_of_label(label: str | None) -> str | None:
    """The language that a label names, with or without a region; None for a blank or unknown one."""
    parts = re.split(r"[\s_\-.;,(@/]+", (label or "").strip().casefold())
    return BY_NAME.get(parts[0])


@lru_cache(1)
def _codes() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code read as Latin, code read as Cyrillic, script evidence, letter) of each character: letters keep a code of their own
    from FIRST on, lower case; Han characters share HAN to FIRST - 1; digits and all else have one code each."""
    latin, cyrillic = np.full(0x10001, BREAK, np.int32), np.full(0x10001, BREAK, np.int32)
    evidence, letter = np.zeros(0x10001, np.int8), np.zeros(0x10001, np.int8)
    to_cyrillic = {l: o for o, l in reversed(TO_LATIN.items()) if script_of(o) == CYRILLIC and ord(o) in (*range(0x410, 0x450), 0x451, 0x401)}
    index: dict[str, int] = {}
    for cp in range(0x3000):
        c = chr(cp)
        if c.isdigit():
            latin[cp] = cyrillic[cp] = DIGIT
        elif c.isalpha():
            letter[cp] = 1
            code = lambda x: index.setdefault(x.lower()[:1], FIRST + len(index))
            latin[cp], cyrillic[cp] = code(TO_LATIN.get(c, c)), code(to_cyrillic.get(c, c))
            if c not in TO_LATIN and c not in to_cyrillic and c.upper() not in to_cyrillic:
                evidence[cp] = 1 if script_of(c) == "L" else -1 if script_of(c) == CYRILLIC else 0
    for cp in range(0x3000, 0x10000):
        if ud.category(chr(cp)) == "Lo":
            latin[cp] = cyrillic[cp] = HAN + cp % (FIRST - HAN)
            letter[cp] = 2
    return latin, cyrillic, evidence, letter


def encode(segments: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all segments one after the other, their offsets, per segment the letters: alphabetic, Han).

    Look-alike letters are read in the script that the other letters of the word, or else of the segment, are in; runs of breaks count as one.
    """
    n = len(segments)
    size = np.fromiter((len(s) for s in segments), np.int64, n)
    cps = np.minimum(np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.uint32), 0x10000)
    owner = np.repeat(np.arange(n), size)
    latin, cyrillic, evidence, letter = _codes()
    kinds = letter[cps]
    begins = kinds == 1
    begins[1:] &= (kinds[:-1] != 1) | (owner[1:] != owner[:-1])
    word = np.cumsum(begins)
    of_word, of_all = np.bincount(word, evidence[cps])[word] if len(word) else word, np.bincount(owner, evidence[cps], n)[owner]
    codes = np.where(np.where(of_word != 0, of_word, of_all) >= 0, latin[cps], cyrillic[cps])
    letters = np.stack([np.bincount(owner, kinds == 1, n), np.bincount(owner, kinds == 2, n)], 1).astype(np.int64)
    keep = np.ones(len(codes), bool)
    if len(codes):
        keep[1:] = (codes[1:] != BREAK) | (codes[:-1] != BREAK) | (owner[1:] != owner[:-1])
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner[keep], minlength=n), out=offsets[1:])
    return codes[keep], offsets, letters


class Automaton:
    """Suffix automaton of a code sequence, as a dense table over its own alphabet. State 0 is the root, -1 no match."""

    def __init__(self, codes: np.ndarray) -> None:
        used = np.unique(codes)
        self.local = {int(c): i + 1 for i, c in enumerate(used)}
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in (self.local[int(c)] for c in codes):
            now = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = now
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[now] = q
                else:
                    copy = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = copy
                        p = link[p]
                    link[q] = link[now] = copy
            last = now
        edges = [(s, c, t) for s, e in enumerate(nxt) for c, t in e.items()]
        self.states, self.edges = len(nxt), np.array(edges, np.int32).reshape(-1, 3)

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """(local code of each code, transitions); the first column stands for codes that the automaton has never seen."""
        local = np.zeros(FIRST + 4096, np.int32)
        for c, i in self.local.items():
            local[c] = i
        t = np.full((self.states, len(self.local) + 1), -1, np.int32)
        t[self.edges[:, 0], self.edges[:, 1]] = self.edges[:, 2]
        return local, t


def phrases(codes: np.ndarray, offsets: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Phrases that each segment needs in each language: greedy longest matches, all segments one character at a time."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    start, size = offsets[:-1][order], size[order]
    live = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")
    out = np.zeros((n, len(tables)), np.int32)
    for k, (local, table_) in enumerate(tables):
        width, flat, mine = table_.shape[1], table_.ravel(), local[codes]
        state, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
        root = table_[0].astype(np.int64)
        for i, m in enumerate(live):
            c = mine[start[:m] + i]
            s = flat[state[:m] * width + c].astype(np.int64)
            fail = np.flatnonzero(s < 0)
            count[fail] += 1
            s[fail] = np.maximum(root[c[fail]], 0)
            state[:m] = s
        out[order, k] = count + 1
    return out


def segments_of(text: str) -> list[tuple[int, int]]:
    """Spans of sentences and set-off phrases; those with too little to tell a language join the one before."""
    cuts = [0, *(m.end() for m in SENTENCE.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    for a, z in zip(cuts, cuts[1:], strict=False):
        if a == z:
            continue
        while z - a > LONGEST:
            # Very long stretches are parsed in parts, cut at a blank where there is one.
            at = text.rfind(" ", a + LONGEST // 2, a + LONGEST) + 1 or a + LONGEST
            out.append((a, at))
            a = at
        if out and (_small(text[a:z]) or _small(text[slice(*out[-1])])):
            out[-1] = (out[-1][0], z)
        else:
            out.append((a, z))
    return out or [(0, len(text))]


def _small(piece: str) -> bool:
    return sum(c.isalpha() for c in piece) < OWN and 3 * len(_HAN.findall(piece)) < OWN


_HAN = re.compile("[\u3400-\u9fff]")


class Parser:
    """Cross-parsing with one automaton per language."""

    def __init__(self, automata: dict[str, Automaton]) -> None:
        self.languages = list(automata)
        self.tables = [a.dense() for a in automata.values()]

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases per text and language, letters per text)."""
        codes, offsets, letters = encode(texts)
        return phrases(codes, offsets, self.tables), letters

    def label(self, texts: list[str]) -> list[list[tuple[int, int, str, float, int]]]:
        """Per text its stretches (start, end, language, confidence, letters), neighbours of one language joined.

        A Viterbi pass over the segments of a text charges SWITCH phrases for a change of language. Confidence is one
        minus the ratio of the phrases of the best language to those of the next best. Texts without letters have no stretch.
        """
        if not self.languages:
            return [[] for _ in texts]
        seen = [look(t) for t in texts]
        spans = [segments_of(t) for t in seen]
        cost, letters = self.costs([t[a:z] for t, s in zip(seen, spans, strict=True) for a, z in s])
        out, at = [], 0
        for s in spans:
            c, l = cost[at : at + len(s)].astype(float), letters[at : at + len(s)].sum(1)
            at += len(s)
            if len(s) == 1:
                way = [int(c[0].argmin())]
            else:
                total, back = c[0], []
                for row in c[1:]:
                    top = int(total.argmin())
                    move = total[top] + SWITCH < total
                    back.append(np.where(move, top, np.arange(len(total))))
                    total = np.where(move, total[top] + SWITCH, total) + row
                way = [int(total.argmin())]
                for b in reversed(back):
                    way.append(int(b[way[-1]]))
                way.reverse()
            found: list[list] = []
            for (a, z), k, row, n in zip(s, way, c, l, strict=True):
                if found and found[-1][2] == k:
                    found[-1][1] = z
                    found[-1][3] += row
                    found[-1][4] += n
                else:
                    found.append([a, z, k, row.copy(), n])
            stretches = []
            for a, z, k, row, n in found:
                if n:
                    others = np.delete(row, k)
                    stretches.append((a, z, self.languages[k], round(max(0.0, float(1 - row[k] / others.min())), 4) if len(others) else 1.0, int(n)))
            out.append(stretches)
        return out


def build_automata(sample: list[tuple[str, str]]) -> dict[str, Automaton]:
    """One automaton per language over labelled (language, text) pairs.

    Labels are partly wrong: in each of three rounds, each half of the sample is checked with automata over what the round before kept of the
    other half, and texts that another language parses about as well, or that change language inside, are left out.
    """

    def over(rows: list[tuple[str, str]]) -> dict[str, Automaton]:
        out = {}
        for lang in LANGUAGES:
            joined = " . ".join(t for l, t in rows if l == lang)
            if joined.strip():
                # Texts of one language share a script, so look-alikes in them are read in it.
                out[lang] = Automaton(encode([joined[:SAMPLE_CHARS]])[0])
        return out

    rows = sorted({(l, look(t)) for l, t in sample if l in LANGUAGES}, key=lambda r: hash_text(r[1]))
    halves = [rows[::2], rows[1::2]]
    kept = halves
    for _ in range(3):
        now = []
        for mine, other in ((halves[0], kept[1]), (halves[1], kept[0])):
            parser = Parser(over(other))
            if len(parser.languages) < 2:
                now.append(mine)
                continue
            labels = parser.label([t for _, t in mine])
            now.append([r for r, found in zip(mine, labels, strict=True) if {f[2] for f in found} == {r[0]} and min(f[3] for f in found) >= SURE])
        kept = now
    return over(sorted(kept[0] + kept[1], key=lambda r: hash_text(r[1])))


def hash_text(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def letters_of(c):
    return F.length(F.regexp_replace(c, r"[^\p{L}]+", ""))


def fit_languages(labelled: DataFrame, documents: DataFrame | None = None) -> dict[str, Automaton]:
    """Automata from `labelled` (doc_id, lang, text): SAMPLE_RUNS labelled texts, the first by hash, read by the driver.

    With `documents` (doc_id, source_lang), only texts whose label agrees with their document's are taken.
    """
    some = labelled.where("trim(lang) != '' and text is not null").where(letters_of(F.col("text")) >= LEAST).select("doc_id", "lang", "text")
    some = bounded_sample(some, SAMPLE_RUNS, "text", "lang", "doc_id")
    if documents is not None:
        some = documents.select("doc_id", "source_lang").join(F.broadcast(some), "doc_id").select("lang", "text", "source_lang")
        rows = [r for r in some.collect() if language_of_label(r.lang) == language_of_label(r.source_lang)]
    else:
        rows = some.collect()
    return build_automata([(language_of_label(r.lang), r.text) for r in rows if language_of_label(r.lang)])


def label_segments(rows: DataFrame, automata: dict[str, Automaton]) -> DataFrame:
    """`rows` (string `text`, others kept) with `segments`: array of (start, end, lang, confidence, letters); null text gives null.

    A long text is read whole. Offsets count characters of the text in its look-alike form without ignorable signs.
    """
    model = rows.sparkSession.sparkContext.broadcast(automata)
    kept = [c for c in rows.columns if c != "segments"]
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("letters", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(model)
        for b in bounded(batches, "text"):
            t = b.column("text").to_pylist()
            found = iter(parser.label([x for x in t if x is not None]))
            cells = [None if x is None else [dict(zip(("start", "end", "lang", "confidence", "letters"), s, strict=True)) for s in next(found)] for x in t]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells, pa.list_(item))], [*b.schema.names, "segments"])

    schema = ", ".join(f"`{n}` {t}" for n, t in rows.select(*kept).dtypes)
    return rows.select(*kept).mapInArrow(run, schema + ", segments array<struct<start:int,end:int,lang:string,confidence:double,letters:int>>")


_PARSERS: dict[int, Parser] = {}


def _parser(model) -> Parser:
    """The parser of a broadcast, built once in each worker process."""
    automata = model.value
    if id(automata) not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[id(automata)] = Parser(automata)
    return _PARSERS[id(automata)]


def runs_of(blocks: DataFrame) -> DataFrame:
    """(doc_id, id, run_idx, label, text) of the runs of blocks; a null run has a null label and text."""
    one = blocks.select("doc_id", "id", F.posexplode("runs").alias("run_idx", "run"))
    return one.select("doc_id", "id", "run_idx", F.col("run.lang").alias("label"), F.col("run.text").alias("text"))


def labelled_runs(blocks: DataFrame, documents: DataFrame | None = None, least: int = 0) -> DataFrame:
    """(doc_id, id, run_idx, label, text, segments) of all runs, or of those with at least `least` letters.

    The automata are built over runs with at least LEAST letters, whatever `least` is.
    """
    runs = runs_of(blocks)
    automata = fit_languages(runs.select("doc_id", F.col("label").alias("lang"), "text"), documents)
    return label_segments(runs.where(letters_of(F.col("text")) >= least) if least else runs, automata)


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run, and each segment of a mixed one, with its language and confidence.

    Confidence falls with the share of LEAST letters that a shorter run lacks (a Chinese character counts three); a run without letters has
    one row with a null language.
    """
    runs = labelled_runs(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "doc_meta"))
    runs = runs.withColumn("all", F.aggregate("segments", F.lit(0), lambda n, s: n + F.when(s["lang"] == "zh", 3).otherwise(1) * s["letters"])).withColumn("s", F.explode_outer("segments"))
    short = letters_of(F.col("text")) < LEAST
    sure = F.when(short, F.round(F.col("s.confidence") * F.least(F.lit(1.0), F.col("all") / LEAST), 4)).otherwise(F.col("s.confidence"))
    return runs.select("doc_id", "id", "run_idx", "label", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), sure.alias("confidence"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = labelled_runs(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "doc_meta"), LEAST).withColumn("s", F.explode("segments"))
    labels = F.split(F.lower(F.trim("label")), r"[\s_\-.;,(@/]+")[0]
    of = F.create_map(*(F.lit(x) for pair in BY_NAME.items() for x in pair))
    own = (F.col("s.letters") >= OWN) | ((F.col("s.lang") == "zh") & (F.col("s.letters") * 3 >= OWN)) | (F.size("segments") == 1)
    found = runs.where(own).where(~F.col("s.lang").eqNullSafe(F.element_at(of, labels)))
    return found.select("doc_id", "id", "run_idx", F.col("s.lang").alias("lang")).distinct()
