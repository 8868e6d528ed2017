"""Problem 6: translations cut off by a limit or in transfer.

Intact targets are cut artificially; a hashed logistic regression learns cut from whole by closing characters, punctuation, length
against the source and against the limit, and what of the source (numbers, names, sentences) is not there yet. It then scores every record.
It learns from all intact targets, in parts whose weights are mixed; names, refusals and endings are counted over all pairs.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm.charfold import TO_LATIN, look
from lexloom.llm.learn import TAUGHT, HashedLogistic, mixed_parts, part_of
from lexloom.llm.refs import ref_of
from lexloom.llm.refusals import Refusals, fit_refusals
from lexloom.llm.streams import bounded
from lexloom.sources.tables import table

#: Pairs, and characters, that a part of the fit should have.
FIT, FIT_CHARS = 20_000, 20_000_000
#: An ending is that of closed targets if this share of the targets that end in it, one more and one of the closed ones less, have a final mark behind it.
CLOSED_SHARE = 0.3
#: Score from which a target counts as cut.
CUT = 0.45
BITS = 18
MASK = (1 << BITS) - 1
FINAL = ".!?。！？"
CLOSING = tuple(FINAL + ")）")
_FINAL = frozenset(FINAL)
NUMBER, TOKEN = re.compile(r"\d+"), re.compile("[㐀-鿿豈-﫿]+|[^\\W\\d_㐀-鿿豈-﫿]+")
#: An escape that breaks off: an entity, a code point, a byte or a tag.
BROKEN = re.compile(r"(?:&(?:#x?[0-9a-fA-F]{0,4}|[a-z]{1,5})|\\u?[0-9a-fA-F]{0,3}|(?<=[^\W\d])%[0-9A-F]{0,1}|</?[a-z]{0,6})$")
HAN, CYRILLIC, ASCII = re.compile("[㐀-鿿]+"), re.compile("[Ѐ-ԯ]+"), re.compile("[A-Za-z]+")
_OTHER, _FOREIGN, _FAR = re.compile("[Ͱ-ԯ]"), re.compile("[㐀-鿿Ѐ-ԯ]"), re.compile("[^\0-ԯ\u2000-\u214f]")
STOP, STOP_HAN = re.compile(r"[.!?](?=\s)"), re.compile("[。！？](?=.)")
_LATIN = str.maketrans(TO_LATIN)
#: What may stand after a cut, and after a whole text.
CUT_MARKS = ("", "", "", "", "…", "...", " …", " ...", "-", "�", " […]", " [...]", ".", "\"", "”", "—", "(...)", " (…)", "..", ",", "�", "&#82", "&am", "&quo", "&#", "&l", "\\u00", "\\u", "%C", "<b", "</")
WHOLE_MARKS = ("...", " ...", "…", " …", "", "", "", "»", "”", "!", "..")


def core_of(text: str) -> str:
    """The text up to its last letter or digit."""
    i = len(text)
    while i and not text[i - 1].isalnum():
        i -= 1
    return text[:i]


def script(text: str) -> str:
    """h, c or l: mostly Chinese, Cyrillic or Latin."""
    if text.isascii() or not _FOREIGN.search(text):
        return "l"
    han, cyrillic = len("".join(HAN.findall(text))), len("".join(CYRILLIC.findall(text)))
    latin = len("".join(ASCII.findall(text)))
    return "h" if 2 * han >= max(latin, cyrillic) and han else "c" if cyrillic > latin // 2 and cyrillic > 2 else "l"


def count_words(pairs: Iterable[tuple[str, str]]) -> tuple[Counter, Counter]:
    """In how many sources each word is, and in how many of their targets it is too."""
    shown, copied = Counter(), Counter()
    for s, t in pairs:
        words = set(tokens(s))
        shown.update(words)
        copied.update(words.intersection(tokens(t)))
    return shown, copied


def translated_words(pairs: DataFrame) -> set[str]:
    """The words of all sources that most of their targets don't have, counted in each batch before the shuffle. All of them travel to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(bounded(batches, "source"), "target"):
            shown, copied = count_words(zip(b.column("source").to_pylist(), b.column("target").to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(list(shown), pa.string()), pa.array(list(shown.values()), pa.int64()), pa.array([copied[w] for w in shown], pa.int64())], ["word", "shown", "copied"])

    by = pairs.select("source", "target").mapInArrow(count, "word string, shown long, copied long").groupBy("word").agg(F.sum("shown").alias("shown"), F.sum("copied").alias("copied"))
    return set(by.where(F.col("copied") < 0.5 * F.col("shown")).select("word").toArrow().column("word").to_pylist())


class Names:
    """Which words are copied into translations (all but `words`), and which end closed targets: `finals`."""

    def __init__(self, words: set[str], finals: set[str]) -> None:
        self.words, self.finals = words, finals

    def of(self, ws: Iterable[str]) -> set[str]:
        return {w for w in set(ws) - self.words if len(w) >= 4 and w.isascii()}


def count_endings(targets: Iterable[str]) -> tuple[Counter, Counter]:
    """How many targets end in each ending, and how many of them with a final mark or bracket behind it."""
    ends, closed = Counter(), Counter()
    for t in map(look, targets):
        w = ending(t)
        ends[w] += 1
        closed[w] += t.rstrip()[-1:] in CLOSING
    return ends, closed


def ending_counts(pairs: DataFrame) -> DataFrame:
    """(ending, ends LONG, closed LONG) over all targets, counted in each batch before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, "target"):
            ends, closed = count_endings(b.column("target").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(list(ends), pa.string()), pa.array(list(ends.values()), pa.int64()), pa.array([closed[w] for w in ends], pa.int64())], ["ending", "ends", "closed"])

    return pairs.select("target").mapInArrow(count, "ending string, ends long, closed long").groupBy("ending").agg(F.sum("ends").alias("ends"), F.sum("closed").alias("closed"))


def closed_endings(pairs: DataFrame) -> set[str]:
    """The endings of closed targets, from all pairs. All of them travel to the driver: words that end two closed targets at least."""
    some = ending_counts(pairs).where(F.col("closed") - 1 >= CLOSED_SHARE * (F.col("ends") + 1))
    return set(some.select("ending").toArrow().column("ending").to_pylist())


def ending(text: str) -> str:
    """The last word, or in Chinese the last two characters."""
    return _ending(core_of(text[-120:]).casefold())


def _ending(core: str) -> str:
    if "㐀" <= core[-1:] <= "鿿":
        return core[-2:]
    i = len(core)
    while i and core[i - 1].isalnum():
        i -= 1
    return core[i:]


def tokens(text: str) -> list[str]:
    return _tokens(look(text))


@lru_cache(1)
def _letters() -> dict[int, str]:
    """str.translate table of all characters that are not _FAR: letters as they are compared, all else is blank."""
    fold = lambda c: TO_LATIN.get(c, c).casefold()
    return {c: "".join(x if TOKEN.match(x) else " " for x in fold(chr(c))) for c in (*range(0x530), *range(0x2000, 0x2150))}


@lru_cache(1)
def _western() -> bytes:
    """The same as a table of bytes in cp1252, for texts without ß and µ, whose folded forms have other sizes or no place there."""
    return bytes([_letters()[ord(c)].encode("cp1252", "replace")[0] if (c := bytes([b]).decode("cp1252", "ignore")) and ord(c) in _letters() else 32 for b in range(256)])


def _spaced(plain: str) -> str:
    """The tokens of a text, with blanks before, between and behind them."""
    if plain.isascii():
        return f" {plain.translate(_letters())} "
    if not _FOREIGN.search(plain) and "µ" not in plain:
        try:
            return f" {plain.replace('ß', 'ss').encode('cp1252').translate(_western()).decode('cp1252')} "
        except UnicodeEncodeError:
            pass
    if not _FAR.search(plain):
        return f" {plain.translate(_letters())} "
    return f" {' '.join(TOKEN.findall((plain.translate(_LATIN) if _OTHER.search(plain) else plain).casefold()))} "


def _tokens(plain: str) -> list[str]:
    return _spaced(plain).split()


def _begun(spaced: str, last: str) -> bool:
    """Whether a token of more than three characters begins so."""
    at = spaced.find(f" {last}")
    while at >= 0 and len(last) <= 3 and spaced.find(" ", at + 1) - at <= 4:
        at = spaced.find(f" {last}", at + 1)
    return at >= 0


def _has_number(text: str, number: str) -> bool:
    """Whether a run of digits is one of those of a text."""
    at, size = text.find(number), len(number)
    while at >= 0:
        if not text[at - 1 : at].isdecimal() and not text[at + size : at + size + 1].isdecimal():
            return True
        at = text.find(number, at + 1)
    return False


def _stops(core: str) -> int:
    """Ends of sentences inside."""
    latin = len(STOP.findall(core)) if "." in core or "?" in core or "!" in core else 0
    return latin if core.isascii() else latin + len(STOP_HAN.findall(core))


@lru_cache(20_000)
def of_source(source: str) -> tuple:
    """(core, whether a final mark ends it, script, words, numbers, stops inside, words with blanks) of a source; training asks for each several times, and so does a batch."""
    s = look(source).strip()
    core, spaced = core_of(s), _spaced(s)
    return core, not _FINAL.isdisjoint(s[len(core) :]), script(s), spaced.split(), NUMBER.findall(s), _stops(core), spaced


@lru_cache(16)
def _named(source: str, names: Names) -> set[str]:
    """The names of a source; training asks for them twice in a row."""
    return names.of(of_source(source)[3])


def _hash(feature: str) -> int:
    return crc32(feature.encode("utf-8", "surrogatepass")) & MASK


#: Hashes of features that are often the same.
_known_hash = lru_cache(1 << 16)(_hash)


@lru_cache(1 << 16)
def _closing(known: int, ends: bool, s_ends: bool, dots: bool, lost: bool, missing: bool, blank: bool, near: str, behind: int) -> tuple[int, ...]:
    """Hashes of how the target closes: T, k (3), l (2), b (2)."""
    state = f"{ends}{s_ends}{dots}"
    return tuple(map(_hash, (f"T{state}{lost}{missing}", f"k{known}", f"k{known}{state}", f"k{known}{blank}{dots}", f"l{near}", f"l{near}{state}", f"b{behind}", f"b{behind}{state}")))


@lru_cache(1 << 16)
def _content(inside: bool, half: str | bool, all_gone: bool, none_there: bool, ends: bool, lost: int, last_lost: bool, missing: int) -> tuple[int, ...]:
    """Hashes of what of the source is there: i, h, a, n, N, m."""
    return tuple(map(_hash, (f"i{inside}{half}", f"h{half}", f"a{all_gone}{none_there}{ends}", f"n{lost}", f"N{last_lost}", f"m{missing}")))


@lru_cache(1 << 16)
def _size(kinds: str, ratio: int, near: str) -> tuple[int, ...]:
    """Hashes of the length against the source's: r, R."""
    return _hash(f"r{kinds}{ratio}"), _hash(f"R{kinds}{ratio // 3}{near}")


@lru_cache(1 << 16)
def _form(same: bool, begins: bool, broken: bool, quoted: bool, letter: bool, digit: bool, blank: bool, blank_too: bool) -> tuple[int, ...]:
    """Hashes of the form of the target: z, x, q, c."""
    return tuple(map(_hash, (f"z{same}{begins}", f"x{broken}", f"q{quoted}", f"c{letter}{digit}{blank}{blank_too}")))


def features(source: str, target: str, limit: float | None, names: Names, more: tuple[str, ...] = ()) -> list[int]:
    """Hashed features of one pair."""
    t = look(target).rstrip()
    end = t[-12:]
    broken = BROKEN.search(end) if "&" in end or "\\" in end or "%" in end or "<" in end else None
    if broken:
        t = t[: len(t) - len(broken.group())].rstrip()
    core = core_of(t)
    tail, low = t[len(core) :], core.casefold()
    s_core, s_ends, s_script, ws, numbers, s_stops, s_spaced = of_source(source)
    named, spaced = _named(source, names), _spaced(t)
    ends = not _FINAL.isdisjoint(tail) and not tail.endswith(("..", "…"))
    dots = "…" in tail or ".." in tail
    last = spaced.rsplit(None, 1)[-1] if core and core[-1].isalpha() else ""
    missing = [w for w in named if f" {w} " not in spaced]
    lost = [n for n in numbers if not _has_number(t, n)]
    ratio = round(8 * math.log((len(core) + 1) / (len(s_core) + 1))) if s_core else 99
    near = "none" if limit is None or limit != limit else "at" if len(target) == limit else "over" if len(target) > limit else "close" if len(target) >= limit - 3 else "under"
    behind = max(-2, min(3, s_stops - _stops(core)))
    inside = bool(last) and f" {last} " in s_spaced
    half = last and not inside and _begun(s_spaced, last)
    known = 2 if last and inside and last not in names.words else int(_ending(core[max(0, len(t) - 120) :].casefold() if len(t) > 120 else low) in names.finals)
    h_t, k, k_state, k_blank, l, l_state, b, b_state = _closing(known, ends, s_ends, dots, bool(lost), bool(missing), tail[:1].isspace(), near, behind)
    i, h, a, n, n_last, m = _content(inside, half, bool(ws) and bool(missing) and len(missing) == len(named), bool(numbers) and len(lost) == len(numbers), ends, min(len(lost), 3), bool(numbers) and numbers[-1] in lost, min(len(missing), 2))
    z, x, q, c = _form(core == s_core, s_core.startswith(core), bool(broken), not core.isascii() and core.count("“") + core.count("„") + core.count("«") > core.count("”") + core.count("“") * ("„" in core) + core.count("»"), core[-1:].isalpha(), core[-1:].isdigit(), t[-1:].isspace(), target[-1:].isspace())
    open_ones = core.count("(") - core.count(")") + core.count("（") - core.count("）")
    return [
        z, x, _known_hash(f"t{tail[:4]}"), h_t, _known_hash(f"e{low[-2:]}"), _known_hash(f"e{low[-3:]}"), _hash(f"e{low[-5:]}"), _hash(f"w{last or low[-2:]}"), _hash(f"v{' '.join(low.rsplit(None, 2)[-2:])[-24:]}"),
        k, k_state, k_blank, i, h, *_size(s_script + script(t), ratio, near), l, l_state, b, b_state, a, n, n_last, m, _known_hash(f"p{open_ones}{')' in tail or '）' in tail}"), q, c, *map(_hash, more),
    ]


def cut_one(target: str, rng: np.random.Generator) -> str:
    """A beginning of the target that lacks at least one letter or digit of it, with or without a mark at the cut."""
    size = len(core_of(target))
    at = int(rng.integers(max(1, size // 8), size)) if size > 2 else 1
    way = rng.random()
    if way < 0.2 and " " in target[:at].strip():
        at = target.rindex(" ", 0, at) + int(rng.random() < 0.5)
    elif way < 0.3:
        stops = [m.end() for m in re.finditer(r"[.!?](?=\s)|[。！？]", target[: size - 1])]
        at = stops[rng.integers(len(stops))] if stops else at
    return target[: max(at, 1)] + CUT_MARKS[rng.integers(len(CUT_MARKS))]


def whole_one(target: str, rng: np.random.Generator) -> str:
    """The whole target, at times without its final mark, in quotes, or with dots after it."""
    way = rng.random()
    if way < 0.45:
        return target
    core = target.rstrip(FINAL + " ")
    if way < 0.8:
        return core + WHOLE_MARKS[rng.integers(len(WHOLE_MARKS))]
    a, z = ("“”", "«»", "„“", '""', "()", "''")[rng.integers(6)]
    return a + target + z


def shown(pairs: list[tuple], parts: int) -> Iterator[tuple]:
    """(pair, weight) as often as a fit takes them. Small tables and rare scripts are shown more often; in tables of several parts, rare scripts count as often."""
    often = int(np.clip(30000 // max(1, len(pairs)), 1, 4)) if parts == 1 else 1
    for p in pairs:
        rare = 1 if script(p[1]) == "l" else 3
        for _ in range(often * rare if parts == 1 else 1):
            yield p, 1 if parts == 1 else rare


class Truncation:
    """The fitted model: names, refusals and weights."""

    def __init__(self, names: Names, refusals: Refusals, model: HashedLogistic | None) -> None:
        self.names, self.refusals, self.model = names, refusals, model
        if model is None:
            self.model = HashedLogistic(BITS)
            self.model.bias = -9.0  # with nothing to learn from, nothing counts as cut

    @classmethod
    def part(cls, pairs: list[tuple[str, str, float | None]], names: Names, part: int = 0, parts: int = 1, seed: int = 7) -> pa.Table:
        """What a part of the pairs teaches, see `learn.TAUGHT`."""
        rng = np.random.default_rng((seed, part))
        x, rows, y, weight = array("q"), array("q", [0]), [], []
        pairs = sorted((p for p in pairs if cls._intact(*p[:2])), key=lambda p: (p[1], p[0], p[2] is None, p[2]))
        for (s, t, limit), times in shown(pairs, parts):
            for cut in (False, True):
                v = cut_one(t, rng) if cut else whole_one(t, rng)
                way = rng.random()
                if not cut and way > 0.93:
                    # Another text altogether, as a refusal is, isn't cut.
                    v = pairs[rng.integers(len(pairs))][1]
                if rng.random() < 0.08:
                    s = f"{s} {('№ {}', '(AB-{})', '#{}', '[{}]')[rng.integers(4)].format(rng.integers(1, 999))}"
                if core_of(v) or not cut:
                    x.extend(features(s, v, len(v) if way < 0.35 else None if way < 0.6 else limit, names))
                    rows.append(len(x))
                    y.append(cut)
                    weight.append(times)
        return part_of(HashedLogistic(BITS, epochs=6), np.array(x, np.int64), np.array(rows, np.int64), np.array(y, float), np.array(weight, float))

    @staticmethod
    def _intact(source: str, target: str) -> bool:
        """Fit to learn from: as closed as its source, not dotted, of two letters at least."""
        s, t = look(source).rstrip(), look(target).rstrip()
        if not TOKEN.search(t) or t.endswith(("..", "…")):
            return False
        closed = FINAL + ")）"
        return (t[-1:] in closed) == (s[-1:] in closed)

    def score(self, rows: list[tuple[str, str, float | None]]) -> np.ndarray:
        x, at = array("q"), array("q", [0])
        for s, t, limit in rows:
            x.extend(features(s, t, limit, self.names))
            at.append(len(x))
        score = self.model.score(np.array(x, np.int64), np.array(at, np.int64))
        cut = np.flatnonzero(score >= CUT)
        score[cut[self.refusals.are_refusals([rows[i][1] for i in cut])]] = 0.0  # no beginning of a translation
        return score


def parted(pairs: DataFrame, rows: int, chars: int) -> tuple[DataFrame, int]:
    """(`pairs` with a column `part` by hash of the whole row, the number of parts): of at most about `rows` rows and `chars` characters of source and target each."""
    size = pairs.agg(F.count("*").alias("n"), F.sum(F.length("source") + F.length("target")).alias("chars")).first()
    parts = max(1, -(-size.n // rows), -(-(size.chars or 0) // chars))
    return pairs.withColumn("part", F.pmod(F.xxhash64(*pairs.columns), F.lit(parts))), parts


def fit_truncation(pairs: DataFrame) -> Truncation:
    """From all of `pairs` (source, target, limit): endings, names and refusals counted, the weights learned part by part."""
    finals = closed_endings(pairs.where("target is not null"))
    some = pairs.where("source is not null and target is not null").where(F.length(F.trim("target")) > 1).withColumn("limit", F.col("limit").cast("double"))
    names = Names(translated_words(some), finals)
    shared = pairs.sparkSession.sparkContext.broadcast(names)
    rows, parts = parted(some, FIT, FIT_CHARS)

    def learn(rows: pa.Table) -> pa.Table:
        return Truncation.part(list(zip(*(rows.column(c).to_pylist() for c in ("source", "target", "limit")), strict=True)), shared.value, rows.column("part")[0].as_py(), parts)

    model = mixed_parts(rows.select("part", "source", "target", "limit").groupBy("part").applyInArrow(learn, TAUGHT), BITS)
    return Truncation(names, fit_refusals(some), model)


def score_truncation(pairs: DataFrame, model: Truncation | None = None) -> DataFrame:
    """(ref, cut) for `pairs` (ref, source, target, limit): the probability that the target is cut.

    Pairs without a letter or digit in the target have none; null sources count as empty, null targets are left out. Texts are read whole.
    """
    pairs = pairs.where("target is not null").select("ref", F.coalesce("source", F.lit("")).alias("source"), "target", F.col("limit").cast("double").alias("limit"))
    shared = pairs.sparkSession.sparkContext.broadcast(model or fit_truncation(pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(bounded(batches, "source"), "target"):
            rows = list(zip(*(b.column(c).to_pylist() for c in ("source", "target", "limit")), strict=True))
            yield pa.RecordBatch.from_arrays([b.column("ref"), pa.array(shared.value.score(rows) if rows else [], pa.float64())], ["ref", "cut"])

    return pairs.where(F.col("target").rlike(r"[\p{L}\p{N}]")).mapInArrow(run, "ref string, cut double")


def target_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, doc_id, source, target, limit) of blocks and regions with a target."""
    columns = ("doc_id", F.col("source_text").alias("source"), F.col("target_text").alias("target"))
    blocks = table(spark, sf_dir, "blocks").select(ref_of("block").alias("ref"), *columns, F.col("constraints.max_chars").alias("limit"))
    regions = table(spark, sf_dir, "regions").select(ref_of("region").alias("ref"), *columns, F.lit(None).cast("int").alias("limit"))
    return blocks.unionByName(regions).where("target is not null and target != ''")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_truncation(target_pairs(spark, sf_dir)).where(F.col("cut") >= CUT).select("ref").distinct()


def p6_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(engine, targets, cut, share): the share of cut targets per translation engine of the document's finished job."""
    scored = score_truncation(target_pairs(spark, sf_dir)).select("ref", (F.col("cut") >= CUT).alias("cut")).distinct()
    scored = scored.withColumn("doc_id", F.split("ref", ":")[1])
    done = table(spark, sf_dir, "jobs").where("state = 'done'").select(F.col("input_path").alias("path"), F.col("translation_engine").alias("engine")).distinct()
    engines = table(spark, sf_dir, "doc_meta").select("doc_id", "path").join(done, "path").select("doc_id", "engine")
    by = scored.join(engines, "doc_id", "left").groupBy("engine").agg(F.count("*").alias("targets"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return by.withColumn("share", F.col("cut") / F.col("targets"))
