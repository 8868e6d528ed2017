"""What characters look like: ignorable signs, blanks, width forms, look-alike letters of three scripts."""

from __future__ import annotations

import re
import unicodedata as ud
from functools import lru_cache

import numpy as np

# Letters of other scripts that print like a Latin letter, as pairs "other Latin".
LOOK_ALIKES = (
    "аa еe оo рp сc уy хx іi ѕs јj ԁd һh ԛq ԝw ѵv ӏl ёë їï ӓä ӧö ӱÿ "
    "АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԌG ԚQ ԜW ЁË ЇÏ ӒÄ ӦÖ "
    "οo νv ϳj όó ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX"
).split()
# Dashes that print like the hyphen of the keyboard.
HYPHENS = "‐‑"

LATIN, CYRILLIC, GREEK = "L", "C", "G"
TO_LATIN = {p[0]: p[1] for p in LOOK_ALIKES}


def script_of(ch: str) -> str:
    """L, C or G for a letter of those scripts, else an empty string."""
    cp = ord(ch)
    if cp < 0x250:
        return LATIN if ch.isalpha() and ch not in "ªºµ" else ""
    if 0x1E00 <= cp < 0x1F00:
        return LATIN
    if 0x400 <= cp < 0x530:
        return CYRILLIC
    if 0x370 <= cp < 0x400 and ch.isalpha():
        return GREEK
    return ""


def _ignorable(ch: str) -> bool:
    return ud.category(ch) == "Cf" or ch in "͏ᅟᅠ឴឵ㅤﾠ" or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


def appearance(ch: str) -> str:
    """The plain characters that look like `ch`; empty for an ignorable one, itself if nothing is plainer.

    Width forms, ligatures, compatibility ideographs, Roman numerals and singletons (as the Kelvin sign) are
    taken apart. Signs that look different stay: raised and lowered digits, circled, squared and stylised signs, fractions, №.
    """
    if _ignorable(ch):
        return ""
    if ch == "\t" or (ud.category(ch) == "Zs"):
        return " "
    if ch in HYPHENS:
        return "-"
    d = ud.decomposition(ch)
    cp = ord(ch)
    if d.startswith(("<wide>", "<narrow>")) or 0xFB00 <= cp <= 0xFB06 or 0x2160 <= cp <= 0x217F or cp in (0x132, 0x133, 0x1C7, 0x1C8, 0x1C9, 0x1CA, 0x1CB, 0x1CC):
        return ud.normalize("NFKC", ch)
    return ud.normalize("NFC", ch)


#: Width forms that are the ordinary punctuation of Chinese text; they are taken apart in other text only.
CJK_MARKS = "，：；？！（）"
_MARKS = {ord(c): ud.normalize("NFKC", c) for c in CJK_MARKS}
_CJK_MARKS, _CJK = re.compile(f"[{CJK_MARKS}]"), re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


#: Ordinary characters of Latin and Chinese text, which look like nothing plainer, as the inside of a character class.
PLAIN = "\n -~¡-¬®-ıĴ-ľŀ-ňŊ-ſ–—‘-•…№、-】一-\u9fff"
_ODD = re.compile(f"[^{PLAIN}Ѐ-ӿ]")
#: Texts that are their own consistent form; the marks of Chinese text are ordinary beside an ideograph only.
PLAIN_TEXT = f"(?s)^(?:[{PLAIN}]*|(?=.*[一-\u9fff])[{PLAIN}{CJK_MARKS}]*)$"


@lru_cache(1)
def appearance_table() -> dict[int, str | None]:
    """str.translate table of every character of the basic plane and the tag plane that `appearance` changes."""
    out: dict[int, str | None] = {}
    for cp in [*range(0xD800), *range(0xE000, 0x10000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0)]:
        if chr(cp) not in CJK_MARKS and (a := appearance(chr(cp))) != chr(cp):
            out[cp] = a or None
    return out


def look(text: str) -> str:
    """Compatibility normalisation of the appearance-keeping kind, with ignorable signs deleted and accents composed."""
    if not _ODD.search(text):
        return text
    t = text.translate(appearance_table())
    if _CJK_MARKS.search(t) and not _CJK.search(t):
        t = t.translate(_MARKS)
    return t if ud.is_normalized("NFC", t) else ud.normalize("NFC", t)


@lru_cache(1)
def fold_table() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, symbols): the symbols that each character of the basic plane folds to.

    Folding: appearance, canonical decomposition, full case folding, then one symbol per class of letters joined by
    look-alikes or case. Blanks and punctuation fold to nothing, but for - . , whose place decides (see `duplicates`)
    the > that quotes a line, and the per cent sign. Characters beyond the basic plane stand for themselves.
    """
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.get(x, x) != x:
            x = root[x]
        return x

    for other, latin in TO_LATIN.items():
        for x in (other, other.upper(), other.lower()):
            for y in (latin, latin.upper(), latin.lower()):
                if len(x) == 1 and len(y) == 1 and ((x == other and y == latin) or x.casefold() == other.casefold() and y.casefold() == latin.casefold()):
                    xs, ys = ud.normalize("NFD", x.casefold()), ud.normalize("NFD", y.casefold())
                    for a, b in zip(xs, ys, strict=False):
                        a, b = sorted((find(a), find(b)))
                        root[b] = a
    first, count, symbols = np.zeros(0x10001, np.int32), np.zeros(0x10001, np.int8), []
    for cp in range(0x10000):
        first[cp] = len(symbols)
        if 0xD800 <= cp < 0xE000:
            continue
        # Ideographs fold to themselves.
        out = [cp] if 0x3400 <= cp < 0xA000 else [ord(find(x)) for x in _fold_one(chr(cp))]
        count[cp] = len(out)
        symbols += out
    first[0x10000] = len(symbols)
    return first, count, np.array(symbols, np.uint32)


def _fold_one(ch: str) -> list[str]:
    out = []
    for x in ud.normalize("NFD", "".join(appearance(y) for y in ud.normalize("NFD", appearance(ch).casefold()))):
        c = ud.category(x)
        if (c[0] in "ZCP" and x not in "-.,%") or (c == "Sk" and x != "^") or x in "|▪■●◦¬":
            continue
        out.append(x)
    return out
