"""The operators for training text: brute force, held-out accuracy, and hard rows."""

import itertools
import random
import re
import time
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import charfold, duplicates, languages, leaks, learn, lookalike, packing, pages, pairs, queries, refs, refusals, streams, toxicity, truncation

LONG = ("word and number 12, " * 20000).strip()
HARD = ["", " ", "\n", "​", None, "a", "🙂" * 30, "." * 5000, "a b " * 3000, LONG, "x" * 20000, "퟿ odd", "key: v; key: w", "a\tb", "١٢٣"]


def texts(spark, rows, extra=True):
    d = spark.createDataFrame([(f"block:d:{i}", t) for i, t in enumerate(rows)], "ref string, text string")
    return d.withColumn("consistent", F.lit(1)).withColumn("h1", F.lit("x")).withColumn("segments", F.lit(2)) if extra else d


def test_queries_have_names():
    assert {f"p{n}_" for n in range(1, 10)} == {re.match(r"p\d_", q).group() for q in queries.queries()}


# 1


def naive_look(t):
    t = "".join(c for c in unicodedata.normalize("NFC", t) if unicodedata.category(c) != "Cf" and not 0xFE00 <= ord(c) <= 0xFE0F)
    t = "".join(unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c).startswith(("<wide", "<noBreak>", "<compat> 0066")) else " " if unicodedata.category(c) == "Zs" else c for c in t)
    return "".join(charfold.TO_LATIN.get(c, c) for c in unicodedata.normalize("NFC", t))


def disguised(t, rng):
    other = {v: k for k, v in charfold.TO_LATIN.items()}
    way = rng.randrange(5)
    if way == 0:
        return "".join(other.get(c, c) if rng.random() < 0.5 else c for c in t)
    if way == 1:
        return "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() else c for c in t)
    if way == 2:
        return unicodedata.normalize("NFD", t)
    if way == 3:
        return t.replace(" ", " ")
    return "".join(c + ("​" if rng.random() < 0.2 else "") for c in t)


def test_pairs_by_brute_force(spark):
    rng = random.Random(3)
    base = ["The delivery schedule for the northern site is late", "Für die Räume brauchen wir 62 m² Fläche und Möbel", "For the rooms we need 62 m2 of floor space", "Все вопросы направляйте в офис до полудня пожалуйста", "Руководство благодарит всех, кто был на площадке Lalbolan"]
    rows = base + [disguised(b, rng) for b in base for _ in range(4)] + base[:2] + ["the delivery schedule for the northern site is late"]
    got = {tuple(r) for r in lookalike.same_look_pairs(texts(spark, rows)).collect()}
    want = {tuple(sorted((f"block:d:{i}", f"block:d:{j}"))) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i] != rows[j] and naive_look(rows[i]) == naive_look(rows[j])}
    assert got == want
    # The classes hold the same links: a record is linked to those of its class with another spelling.
    classes = lookalike.same_look_classes(texts(spark, rows)).collect()
    assert len({r.ref for r in classes}) == len(classes) == len({x for p in want for x in p})
    assert {tuple(sorted((a.ref, b.ref))) for a, b in itertools.combinations(classes, 2) if a.ref_first == b.ref_first and a.text_no != b.text_no} == want
    assert all(r.links == sum(r.ref in p for p in want) for r in classes)


def test_consistent_text_depends_on_looks_only(spark):
    t = ["Two of our partners", "Тwо оf оur раrtnеrs", "Никто не знал", "Hиктo нe знaл", "№ 5 m²", "Ａ１ ﬁ K"]
    out = {r.text: r.consistent for r in lookalike.consistent_texts(texts(spark, t)).collect()}
    assert out[t[1]] == t[0] and out[t[3]] == t[2] and out[t[4]] == t[4] and out[t[5]] == "A1 fi K"


def test_plain_texts_are_their_own_form(spark):
    """Whatever skips the search looks like nothing plainer: every character alone and beside a Latin and a Chinese one, and random texts."""
    rng = random.Random(7)
    every = [chr(c) for c in range(1, 0xFFFE) if not 0xD800 <= c < 0xE000]
    odd = "，（！ĲĳŉKﬁé…№一а"
    rows = [t for c in every for t in (c, f"a{c}b", f"一{c}")] + ["".join(rng.choice("ab 一，！é" + odd) for _ in range(8)) for _ in range(2000)]
    plain = spark.createDataFrame([(r,) for r in rows], "text string").where(F.col("text").rlike(charfold.PLAIN_TEXT)).collect()
    assert len(plain) > 60000 and all(charfold.look(r.text) == r.text for r in plain)
    t = ["Hello， world this is a long text", "Hello， world this is a long text​", "Hello, world this is a long text"]
    assert {r.consistent for r in lookalike.consistent_texts(texts(spark, t)).collect()} == {t[2]}


# 5


def test_formatting_copies(spark):
    a = "The service desk changed by +12.6 % against the plan"
    same = [a, "THE  SERVICE DESK\tchanged by +12.6 % against the plan!", "> * the service-desk, changed by +12.6 % (against the plan)", "Тhе service desk changed by +12.6 % against thе plan", a]
    other = ["The service desk changed by -12.6 % against the plan", "The service desk changed by +126 % against the plan"]
    kv = ["Owner: Gilriber; Status: in progress; Due: 2036-11-08", "due: 2036-11-08 | owner: gilriber | status: In Progress", "Owner: Gilriber; Status: in progress; Due: 2036-11-09"]
    rows = same + other + kv + ["STRASSE nach Osten und nach Westen", "Straße nach Osten, und nach Westen"]
    got = {r.ref: (r.ref_first, r.copies) for r in duplicates.formatting_classes(texts(spark, rows)).collect()}
    want = {f"block:d:{i}": ("block:d:0", 5) for i in range(5)} | {f"block:d:{i}": ("block:d:7", 2) for i in (7, 8)} | {f"block:d:{i}": ("block:d:10", 2) for i in (10, 11)}
    assert got == want


def test_classes_hold_every_content(spark, tmp_path):
    rows = ["One long text that stands alone here.", "Yes", "yes!", "No", "Twice here, a text of some length", "TWICE here: a text of some length.", "", " - ", None]
    spark.createDataFrame([("d", str(i), t) for i, t in enumerate(rows)] + [("d", "3", "No")], "doc_id string, id string, source_text string").write.parquet(str(tmp_path / "blocks.parquet"))
    spark.createDataFrame([("d", "i", "AB cd"), ("d", "j", "abcd"), ("d", "k", "ef"), ("d", "l", None)], "doc_id string, image_id string, content_hash string").write.parquet(str(tmp_path / "selections.parquet"))
    got = {r.ref_first: r.copies for r in duplicates.p5_classes(spark, str(tmp_path)).collect()}
    assert got == {"block:d:0": 1, "block:d:1": 2, "block:d:3": 1, "block:d:4": 2, "block:d:6": 2, "selection:d:i": 2, "selection:d:k": 1}
    assert [tuple(r) for r in duplicates.p5_found(spark, str(tmp_path)).where("ref_first like 'block%'").collect()] == [("block:d:4", "block:d:5")]


def test_length_counts_in_folded_form(spark):
    """Ligatures and Roman numerals fold to several letters, so fewer characters than the least may be enough."""
    rows = ["ﬃ" * 7, "ffi" * 7, "FFI-" * 7, "ﬃ" * 6, "ffi" * 6]
    assert {r.ref: r.copies for r in duplicates.formatting_classes(texts(spark, rows)).collect()} == {f"block:d:{i}": 3 for i in range(3)}


def test_hash_agrees_with_walk():
    rng = random.Random(5)
    letters = "aBß é-+.,1२ \n>:;​ＡﬁжЖ²%"
    rows = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(1500)]
    h1, h2, size = duplicates.fold_hashes(rows)
    by = {}
    for r, a, b, n in zip(rows, h1.tolist(), h2.tolist(), size.tolist(), strict=True):
        key = tuple(duplicates._walk(r, True))
        assert n == sum(charfold.ud.category(chr(c))[0] in "LN" for c in key)
        if not duplicates.starts_of_fields(r):
            assert by.setdefault((a, b), key) == key
    assert len(by) == len({tuple(duplicates._walk(r, True)) for r in rows if not duplicates.starts_of_fields(r)})


def test_same_content():
    assert duplicates.same_content("A b.", "a B") and not duplicates.same_content("+5", "-5") and duplicates.same_content("5.5", "-55", signs=False)


# 2


def test_page_noise(spark):
    rng = random.Random(2)
    vocabulary = "the service desk changed because every customer survey needs another training schedule before this delivery window closes again".split()
    clean = [" ".join(rng.choice(vocabulary) for _ in range(14)).capitalize() + ". A long-term plan helps." for _ in range(400)]
    noisy = ["The cust-\nomer survey needs another training schedule.", "The c1osing serv|ce desk changed because every customer survey.", "The service desk changed because every\n— 12 —\ncustomer survey needs another plan.", "The service desk needs a long-\nterm plan because every survey changed."]
    rows = texts(spark, clean + noisy)
    pairs_ = spark.createDataFrame([(c, "andere Worte") for c in clean], "text string, target string")
    found = {(int(r.ref.split(":")[2]) - 400, r.noise) for r in pages.page_noise(rows, pairs_)[0].collect() if int(r.ref.split(":")[2]) >= 400}
    assert found == {(0, "hyphen"), (1, "misread"), (2, "running")}
    out = {r.ref: r.repaired for r in pages.repair(rows, pairs_).collect()}
    assert out["block:d:400"] == "The customer survey needs another training schedule." and "12" not in out["block:d:402"] and "service desk" in out["block:d:401"]


def test_glyph_distance():
    assert pages.glyph_distance("modern", "rnodem") == 0.5 and pages.glyph_distance("word", "word") == 0 and pages.glyph_distance("abc", "xyz") == 3


# 4


SENTENCES = {
    "en": ["The board of {} thanks everyone who kept the schedule running.", "Nobody at {} knew that the survey depends on the night shift.", "Please send all questions about the web portal to {}."],
    "de": ["Die Leitung von {} dankt allen, die den Plan eingehalten haben.", "Niemand bei {} wusste, dass die Umfrage von der Nachtschicht abhängt.", "Bitte richten Sie alle Fragen über das Webportal an {}."],
    "fr": ["La direction de {} remercie tous ceux qui ont tenu le calendrier.", "Personne chez {} ne savait que l'enquête dépendait de l'équipe de nuit.", "Veuillez adresser toutes vos questions sur le portail à {}."],
    "ru": ["Руководство {} благодарит всех, кто соблюдал график.", "Никто в {} не знал, что опрос зависит от ночной смены.", "Все вопросы про портал направляйте в {}."],
    "zh": ["{}管理层感谢所有遵守计划的人。", "{}没有人知道调查取决于夜班。", "有关门户网站的所有问题，请发送到{}办公室。"],
}


def test_languages(spark):
    rng = random.Random(1)
    name = lambda: "".join(rng.choice("BGKLMT") + rng.choice("aeiou") for _ in range(3)).capitalize()
    rows, labels = [], []
    for i in range(500):
        lang = rng.choice(list(SENTENCES))
        rows.append(("d", rng.choice(list(SENTENCES)) if i % 12 == 0 else lang, rng.choice(SENTENCES[lang]).format(name())))
        labels.append(lang)
    automata = languages.fit_languages(spark.createDataFrame(rows, "doc_id string, lang string, text string"))
    fresh = [(lang, s.format(name())) for lang in SENTENCES for s in SENTENCES[lang]]
    mixed = SENTENCES["en"][0].format("Bako") + " " + SENTENCES["ru"][1].format("Bako")
    out = [r.segments for r in languages.label_segments(texts(spark, [t for _, t in fresh] + [mixed] + HARD), automata).orderBy(F.expr("cast(split(ref,':')[2] as int)")).collect()]
    assert [{s["lang"] for s in o} for o in out[: len(fresh)]] == [{lang} for lang, _ in fresh]
    assert [s["lang"] for s in out[len(fresh)]] == ["en", "ru"] and all(0 <= s["confidence"] <= 1 for s in out[len(fresh)])
    assert out[len(fresh) + 1 + 4] is None and out[len(fresh) + 1] == []
    assert languages.language_of_label("pt-BR") is None and languages.language_of_label(" de_AT ") == "de" and languages.language_of_label("中文") == "zh" and languages.language_of_label("und") is None


def test_every_run_has_a_row(spark, tmp_path):
    words = {"en": "the house stands near old river with many people", "de": "das Haus steht neben dem alten Fluss mit vielen Leuten"}
    rng = random.Random(4)
    runs = [(" ".join(rng.choices(words[x].split(), k=12)) + ".", x) for x in ("en", "de") for _ in range(60)]
    runs += [("Leuten", "de"), ("12 / 7", None), ("", "en"), (None, None), ("\u6cb3", "zh")]
    run = "array<struct<text:string,lang:string>>"
    spark.createDataFrame([("d", "b", [(t, x) for t, x in runs]), ("e", "b", None)], f"doc_id string, id string, runs {run}").write.parquet(str(tmp_path / "blocks.parquet"))
    spark.createDataFrame([("d", "en"), ("e", "en")], "doc_id string, source_lang string").write.parquet(str(tmp_path / "doc_meta.parquet"))
    got = {r.run_idx: r for r in languages.p4_segments(spark, str(tmp_path)).collect()}
    assert set(got) == set(range(len(runs)))
    assert all(got[i].lang is None and got[i].confidence is None for i in (121, 122, 123))
    assert got[120].lang is not None and got[124].lang is not None and max(got[120].confidence, got[124].confidence) <= 0.5
    assert {r.run_idx for r in languages.p4_found(spark, str(tmp_path)).collect()}.isdisjoint(range(120, 125))


def test_phrases_by_brute_force():
    rng = random.Random(4)
    seq = "".join(rng.choice("ab c") for _ in range(300))
    codes = languages.encode([seq])[0]
    table = languages.Automaton(codes).dense()
    texts_ = ["".join(rng.choice("abc d") for _ in range(rng.randrange(1, 30))) for _ in range(200)]
    c, o, _ = languages.encode(texts_)
    got = languages.phrases(c, o, [table])[:, 0]
    whole = codes.tolist()
    inside = lambda p: any(whole[i : i + len(p)] == p for i in range(len(whole) - len(p) + 1))
    for k in range(len(texts_)):
        t, n, start = c[o[k] : o[k + 1]].tolist(), 1, 0
        for i in range(len(t)):
            if not inside(t[start : i + 1]):
                n, start = n + 1, i
                if not inside([t[i]]):
                    start = i + 1
        assert got[k] == n


# 3 and 6


def made_pairs(rng, n):
    name = lambda: "".join(rng.choice("BGKLMT") + rng.choice("aeiou") for _ in range(3)).capitalize()
    out = []
    for _ in range(n):
        i, x, y = rng.randrange(3), name(), rng.randrange(2, 99)
        out.append((SENTENCES["en"][i].format(x)[:-1] + f" {y} times.", SENTENCES["de"][i].format(x)[:-1] + f" {y} Mal."))
    return out


def test_truncation_held_out(spark):
    rng = random.Random(6)
    train, fresh = made_pairs(rng, 1500), made_pairs(rng, 150)
    rows = [(f"r{i}", s, t, 40) for i, (s, t) in enumerate(train)]
    # Numbers and codes stay as they are: a target that is the whole source is no beginning of it.
    rows += [(f"code{i}", c, c, None) for i in range(100) for c in (f"{rng.randrange(1000, 9999)}", f"KX-{rng.randrange(100, 999)}")]
    cut = [(f"c{i}", s, t[: rng.randrange(10, len(t) - 3)] + rng.choice(["", "…", "..."]), None) for i, (s, t) in enumerate(fresh)]
    whole = [(f"w{i}", s, rng.choice([t, t[:-1], f"„{t}“", t[:-1] + " …"]), len(t)) for i, (s, t) in enumerate(fresh)]
    df = spark.createDataFrame(rows + cut + whole + [("n", "x", None, 1), ("e", None, "", None), ("p", "x", "...", None)], "ref string, source string, target string, limit int")
    p = {r.ref: r.cut for r in truncation.score_truncation(df.withColumn("cut", F.lit("clash"))).collect()}
    hit, false = (sum(p[f"{k}{i}"] >= truncation.CUT for i in range(150)) for k in "cw")
    assert all(x < truncation.CUT for k, x in p.items() if k.startswith("code"))
    assert hit >= 143 and false <= 7 and not {"n", "e", "p"} & set(p)


def test_defects(spark):
    rng = random.Random(7)
    good = made_pairs(rng, 1200)
    rows = [(f"g{i}", 0, s, t, "en", "de") for i, (s, t) in enumerate(good)]
    rows += [(f"f{i}", 0, t, SENTENCES["fr"][i % 3].format("Kilota"), "de", "fr") for i, (_, t) in enumerate(good[:300])]
    rows += [("ru", i, "x", SENTENCES["ru"][i % 3].format("K" + "aeiou"[i % 5]), "en", "ru") for i in range(60)]
    s, t = made_pairs(rng, 1)[0]
    bad = {
        "empty": ["", "—", "​", "[]"], "refusal": ["I'm sorry, but I can't translate this text.", "Ich kann diese Anfrage leider nicht beantworten. (The board)"],
        "copy": [s, s.upper(), f"→ {s}", s[:-1]], "wrong_language": [SENTENCES["fr"][0].format("Bako")], "truncated": [t[:40], t[:30] + "…"],
    }
    rows += [(k, i, s, v, "en", "de") for k, vs in bad.items() for i, v in enumerate(vs)] + [("null", 0, s, None, "en", "de"), ("name", 0, "Bakota 12", "Bakota 12", "en", "de"), ("nolang", 0, s, t, None, "xx"), ("nolang_fr", 0, s, SENTENCES["ru"][0].format("Bako"), None, None), ("only_target", 0, s, SENTENCES["fr"][0].format("Bako"), None, "de")]
    df = spark.createDataFrame(rows, "ref string, pos int, source string, target string, source_lang string, target_lang string")
    out = pairs.defective_pairs(df.unionByName(df.limit(5)).withColumn("defect", F.lit(1))).collect()
    got = {(r.ref, r.pos): r.defect for r in out}
    assert len(got) == len(out) and {k: v for k, v in got.items() if k[0] in bad} == {(k, i): k for k, vs in bad.items() for i in range(len(vs))}
    # The labelled pairs never answer English in French; Russian answers to it are usual.
    assert got.pop(("only_target", 0)) == "wrong_language" and ("nolang_fr", 0) not in got
    assert sum(k[0][0] in "gf" for k in got) <= 15 and not {("null", 0), ("name", 0), ("nolang", 0)} & set(got)


def test_every_end_context_is_counted(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab ") for _ in range(rng.randrange(30))) + rng.choice(["", ".", " …"]) for _ in range(300)]
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "part long, target string")
    shown, ends = Counter(), Counter()
    for t in map(pairs._before_end, texts):
        for n in pairs.CONTEXTS:
            shown.update(t[i : i + n] for i in range(len(t) - n + 1))
            ends.update([t[-n:]] if len(t) >= n else [])
    found = {}
    for r in pairs.part_contexts(df, pairs.context_counts(df)).collect():
        found[r.part, r.hash] = (r.n, r.ends)
    hashes, has = pairs.end_contexts(texts)
    for i, t in enumerate(map(pairs._before_end, texts)):
        for k, n in enumerate(pairs.CONTEXTS):
            assert has[i, k] == (len(t) >= n)
            want = (shown[t[-n:]], ends[t[-n:]]) if has[i, k] and shown[t[-n:]] > pairs.SEEN else None
            assert found.get((i % 7, int(hashes[i, k].astype(np.int64)))) == want or not has[i, k]


def test_fits_take_all_rows(spark, monkeypatch):
    rng = random.Random(9)
    made = made_pairs(rng, 300) + [(s, "I cannot translate this text.") for s, _ in made_pairs(rng, 20)] + [(t, t) for t in ("Nora", "Ilse")]
    df = spark.createDataFrame([(i, s, t, None) for i, (s, t) in enumerate(made)], "ref int, source string, target string, limit double").repartition(5)
    want, got = refusals.Refusals([t for _, t in made]), refusals.fit_refusals(df)
    assert np.allclose(want.ratio, got.ratio) and np.isclose(want.least, got.least)
    shown, copied = truncation.count_words(made)
    monkeypatch.setattr(truncation, "FIT", 50)
    for bound in ("SAMPLE", "MOST_ENDINGS"):
        monkeypatch.setattr(truncation, bound, 50, raising=False)
    fitted = truncation.fit_truncation(df)
    assert fitted.names.words == {w for w, n in shown.items() if copied[w] < 0.5 * n}
    # Every word that ends a pair is in a weight; parts are mixed, whatever the layout.
    last = [truncation.crc32(f"w{truncation.tokens(t)[-1]}".encode()) & truncation.MASK for _, t in made if truncation.Truncation._intact(_, t)]
    assert sum(fitted.model.w[i] != 0 for i in last) > 0.9 * len(last)
    again = truncation.fit_truncation(df.repartition(2))
    assert np.allclose(fitted.model.w, again.model.w, atol=1e-6) and np.isclose(fitted.model.bias, again.model.bias)


def plain_grams(texts):
    """The n-grams of refusals, text by text."""
    out = []
    for i, t in enumerate(texts):
        p = " " + re.sub(r"[^\w'-]+|\d+", " ", charfold.look(t).casefold()).strip() + " "
        codes, _ = streams.code_points([p])
        for n in (1, 2, 3) if 3 * len(re.findall("[㐀-鿿]", p)) > len(p) else (3, 4, 5):
            h = streams.gram_hashes(codes, np.arange(max(0, len(p) - n + 1)), n) >> np.uint64(64 - refusals.BITS)
            out += [(i, int(x)) for x in h]
    return out


def plain_fit(index, rows, y, weight, size, epochs, rate=0.15, decay=1e-6, batch=256):
    rng, w, seen, bias, seen_b = np.random.default_rng(7), np.zeros(size), np.full(size, 1e-2), 0.0, 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), batch):
            r = order[k : k + batch]
            i = np.concatenate([index[rows[j] : rows[j + 1]] for j in r])
            who = np.repeat(np.arange(len(r)), np.diff(rows)[r])
            d = (1 / (1 + np.exp(-np.bincount(who, w[i], len(r)) - bias)) - y[r]) * weight[r]
            used, back = np.unique(i, return_inverse=True)
            g = np.bincount(back, d[who]) / len(r) + decay * w[used]
            seen[used] += g * g
            w[used] -= rate * g / np.sqrt(seen[used])
            seen_b += d.mean() ** 2
            bias -= rate * d.mean() / np.sqrt(seen_b)
    return w, bias


def test_quick_ways_equal_plain_ones():
    # Words: each character alone, inside a word and beside other scripts.
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x12000), *range(0x1F600, 0x1F650), 0x20000)):
        for t in (c, f"ab{c}ä", f"Б{c}Cß 12{c}3", f"中{c}文x", f"{c}µ"):
            assert truncation._tokens(t) == truncation.TOKEN.findall((t.translate(truncation._LATIN) if truncation._OTHER.search(t) else t).casefold())
    rng = random.Random(5)
    texts = [t for t in HARD if t is not None] + ["".join(rng.choice("ab 1,'-_ßЖ中文\n\0²") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in texts:
        core = truncation.core_of(t[-120:]).casefold()
        assert truncation.ending(t) == (core[-2:] if re.match("[㐀-鿿]", core[-1:]) else re.split(r"[\W_]", core)[-1])
        assert refusals._worded(t) == (len(re.findall("[㐀-鿿]", t)) >= 7 or len(re.findall(r"[^\W\d_]", t)) >= 12)
        for x in ("1", "12"):
            assert truncation._has_number(t, x) == (x in re.findall(r"\d+", t))
        words = truncation._tokens(t)
        for x in ("a", "ab", "文", "aab", "ж"):
            assert truncation._begun(truncation._spaced(t), x) == any(w.startswith(x) for w in words if len(w) > 3)
    bucket, owner = refusals._grams(texts)
    assert Counter(zip(owner.tolist(), bucket.tolist(), strict=True)) == Counter(plain_grams(texts))
    # The fit, also of rows of several sizes.
    draw = np.random.default_rng(3)
    rows = np.append(0, np.cumsum(draw.integers(0, 9, 700)))
    index, y, weight = draw.integers(0, 400, rows[-1]), (draw.random(700) < 0.4).astype(float), draw.integers(1, 4, 700).astype(float)
    got = learn.HashedLogistic(12, epochs=3).fit(index, rows, y, weight=weight)
    w, bias = plain_fit(index, rows, y, weight, 1 << 12, 3)
    assert np.array_equal(got.w, w.astype(np.float32)) and got.bias == bias


def test_refusals_cost_less_than_text_by_text():
    """Counting the n-grams of a table takes much less time than folding each text and hashing windows gathered one by one."""
    texts = [f"{s} {i}, {t}" for i, (s, t) in enumerate(made_pairs(random.Random(4), 3000))]
    between = re.compile(r"[^\w'-]+|\d+")

    def gathered():
        codes, starts = streams.code_points([f" {between.sub(' ', charfold.look(t).casefold()).strip()} " for t in texts])
        total = np.zeros(1 << refusals.BITS, np.int64)
        for n in (3, 4, 5):
            at, _ = streams.windows(starts, n + 1)
            total += np.bincount((streams.gram_hashes(codes, at, n) >> np.uint64(64 - refusals.BITS)).astype(np.int64), minlength=len(total))
        return total

    def seconds(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    assert np.array_equal(gathered(), refusals._counts(texts))
    took = [(seconds(lambda: refusals._counts(texts)), seconds(gathered)) for _ in range(7)]
    assert min(a for a, _ in took) < 0.8 * min(b for _, b in took)


def test_refusals():
    r = refusals.Refusals([t for _, t in made_pairs(random.Random(1), 500)])
    assert r.is_refusal("Unfortunately I cannot help with this request.") and r.is_refusal("抱歉，我不能翻译这个内容。") and not r.is_refusal("Die Leitung von Bako dankt allen.") and not r.is_refusal("")


# 7


def test_packing(spark):
    rng = random.Random(8)
    words_ = ["alpha", "beta", "gamma", "delta", "router", "oven"]
    rows = [(i, f"s{i % 3}", " ".join(rng.choice(words_) for _ in range(rng.choice([1, 5, 60, 200])))) for i in range(300)] + [(900, None, LONG[:60000]), (901, "s1", None), (902, "s1", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("tokens", F.lit(1)).withColumn("shard", F.lit(1))
    out = packing.containers(df, 512).collect()
    room, size = {}, {}
    for r in out:
        room[r.container] = room.get(r.container, 0) + r.tokens
        size[r.doc_id] = size.get(r.doc_id, 0) + r.tokens
    want = dict(zip([r[0] for r in rows], packing.token_counts([r[2] or "" for r in rows]), strict=True))
    assert size == want and max(room.values()) <= 512 and sum(room.values()) / len(room) / 512 > 0.9
    assert {d for d in size if sum(r.doc_id == d for r in out) > 1} == {d for d, n in want.items() if n > 512}


def test_token_counts_by_the_tokenizer_itself():
    rng = random.Random(6)
    pieces = ["the", " cat", "'s", "'ll", "  ", "\n", "\t ", "12", "²", "é", "e\u0301", "中文", "Жук", "!?", "_", "-", "\x85", "\x1c", "\u3000", "\u2028", "🙂", "<|endoftext|>", "'", "\u200b", "\ufeff", "Ⅻ", "\u00ad"]
    rows = ["".join(rng.choice(pieces) for _ in range(rng.randrange(20))) for _ in range(4000)] + ["".join(chr(rng.randrange(1, 0xD7FF)) for _ in range(30)) for _ in range(2000)]
    want = [len(e.ids) for e in packing._tokenizer(packing.TOKENIZER).encode_batch(rows, add_special_tokens=False)]
    assert packing.token_counts(rows) == want
    other = packing.TOKENIZER.replace("byte_bpe_50k", "word_bpe_49k")
    assert packing.token_counts(rows, other) == [len(e.ids) for e in packing._tokenizer(other).encode_batch(rows, add_special_tokens=False)]


# 8


@pytest.mark.parametrize("most", [leaks.FILTER_MOST, 64])
def test_leaks_by_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "FILTER_MOST", most)
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(5, 40)))) for i in range(30)] + [(99, None), (3, "short")]
    docs = []
    for d in range(200):
        ws = [f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 80))]
        src = (items[rng.randrange(30)][1]).split()
        a, n = rng.randrange(len(src)), rng.randrange(5, 30)
        at = rng.randrange(len(ws) + 1)
        docs.append((d, " ".join(ws[:at]) + ",  " + "; ".join(w.upper() for w in src[a : a + n]) + "\n" + " ".join(ws[at:])))
    docs += [(300, None), (301, ""), (5, docs[5][1]), (302, LONG)]
    df = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit("clash"))
    out = leaks.leaked_items(df, it)
    want = set()
    for d, t in docs:
        w = leaks.words(t or "")
        grams = {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
        want |= {(d, i) for i, u in items if u and any(tuple(x[k : k + 12]) in grams for x in [leaks.words(u)] for k in range(len(x) - 11))}
    assert want and sorted(tuple(r) for r in out.collect()) == sorted(want)


def test_overlap_tolerates_replaced_words():
    a = leaks.word_ids([f"a{i}" for i in range(40)])
    b = a.copy()
    b[20] = 7
    assert leaks.passages(b, a, [0]) == [(0, 40, 39, 20)]


def test_passages_by_brute_force():
    """Every passage is dense and apart from the others, and every dense stretch on any diagonal meets one with as many equal words."""
    rng = random.Random(4)
    for _ in range(150):
        item = [rng.randrange(9) for _ in range(rng.randrange(8, 40))]
        doc = [x if rng.random() < 0.8 else rng.randrange(9) for x in item] + [rng.randrange(9) for _ in range(rng.randrange(20))] + item[: rng.randrange(20)]
        x, y = leaks.np.array(doc, leaks.np.uint64), leaks.np.array(item, leaks.np.uint64)
        got = leaks.passages(x, y, list(range(-len(item) + 1, len(doc))))
        assert all(a + n <= b for (a, n, *_), (b, *_) in itertools.pairwise(got))
        best = set()
        for k in range(-len(item) + 1, len(doc)):
            same = [0 <= i - k < len(item) and doc[i] == item[i - k] for i in range(len(doc))]
            for a in range(len(doc)):
                for z in range(a + 12, len(doc) + 1):
                    if same[a] and same[z - 1] and 0 <= a - k and z - k <= len(item) and sum(same[a:z]) >= 12 and 4 * sum(same[a:z]) >= 3 * (z - a):
                        best.add((a, z - a, sum(same[a:z])))
        assert {(a, n, e) for a, n, e, _ in got} <= best
        assert all(any(p[0] < a + n and a < p[0] + p[1] and p[2] >= e for p in got) for a, n, e in best)


def test_word_hashes_tell_words_apart():
    rng = random.Random(2)
    rows = ["".join(rng.choice("abé жЖ१_-一🙂𝐀") for _ in range(rng.randrange(30))) for _ in range(400)] + ["", "x" * 300_000 + " y"]
    ids, first = streams.word_hashes(rows)
    ws = [re.findall(r"[^\W_]+", r) for r in rows]
    assert leaks.np.diff(first).tolist() == [len(w) for w in ws]
    by = {}
    assert all(by.setdefault(w, i) == i for w, i in zip((w for x in ws for w in x), ids.tolist(), strict=True)) and len(set(by.values())) == len(by)
    assert (streams.word_hashes(rows[:50], 16)[0] == ids[: first[50]]).all()


def test_dense_overlap_beside_a_looser_one(spark):
    item = [f"a{i}" for i in range(80)]
    loose = [w if i % 3 else f"x{i}" for i, w in enumerate(item[:60])]
    text = " ".join(loose[:59] + [f"y{i}" for i in range(9)] + item[60:73] + [f"z{i}" for i in range(9)])
    alone = " ".join(item[20:32] + [x for w in item[32:60:3] for x in (w, "q", "r")])
    # A hundred diagonals with more hits than the one that holds the tolerant overlap.
    part = [f"b{i}" for i in range(13)]
    far = [f"c{i}" for i in range(8)] + ["q"] + [f"c{i}" for i in range(9, 17)]
    many = " ".join([w for i in range(100) for w in (*part, *["s"] * (i + 1))] + [f"c{i}" for i in range(17)])
    docs = spark.createDataFrame([(1, text), (2, alone), (3, many)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (3, " ".join([*part, *far]))], "item_id long, text string")
    got = leaks.leaks(docs, items).collect()
    by = lambda d: [r for r in got if r.doc_id == d]
    assert {(r.doc_id, r.item_id) for r in got} == {(1, 1), (2, 1), (3, 3)} and all(r.equal >= 12 and 4 * r.equal >= 3 * r.words for r in got)
    assert max(r.run for r in by(1)) >= 12 and max(r.run for r in by(2)) >= 12
    assert len(by(3)) == 101 and sorted(r.equal for r in by(3))[-2:] == [13, 16]


def test_dense_by_brute_force():
    rng = random.Random(8)
    for _ in range(300):
        same = [rng.random() < 0.6 for _ in range(rng.randrange(1, 40))]
        ways = [(sum(same[a:z]), -a) for a in range(len(same)) for z in range(a + 1, len(same) + 1) if same[a] and same[z - 1] and 4 * sum(same[a:z]) >= 3 * (z - a)]
        got = leaks.dense(leaks.np.array(same))
        assert (got is None) == (not ways) and (not ways or (got[2], -got[0]) == max(ways))


# 9


def test_toxicity(spark):
    rng = random.Random(10)
    plain = ["Clean the contacts and restart it.", "Kill the child process before the parent hangs.", "The cable was loose.", "I felt like an idiot myself.", "Update the router first."]
    bad = {"abusive": ["You are a worthless idiot and everybody knows it.", "Shut up, you stupid clown."], "hateful": ["All Keshi are vermin and should be driven out."], "sexual": ["Hot girls want sex tonight."]}
    rows, ratings = [], []
    for i in range(600):
        parts, cat = [rng.choice(plain) for _ in range(3)], None
        if i % 4 == 0:
            cat = rng.choice(list(bad))
            parts[rng.randrange(3)] = rng.choice(bad[cat])
        rows.append((i, "en", "s", " ".join(parts)))
        ratings += [(i, k, int(cat is not None) if rng.random() > 0.05 else 1, cat) for k in range(rng.randrange(1, 4))]
    odd = {1000: "You are a w0rthless 1d10t and everybody knows it.", 1001: "Hot girls want s e x tonight.", 1002: "All Kеshi are ver​min and should be driven out.", 1003: "I felt like an idiot myself. Kill the child process.", 1004: None, 1005: ""}
    rows += [(i, None, None, t) for i, t in odd.items()]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").withColumn("abusive", F.lit("clash"))
    r = spark.createDataFrame(ratings + [(None, 1, 1, None), (2, 1, None, None)], "doc_id long, rater_id int, toxic int, category string")
    out = {x.doc_id: x.categories for x in toxicity.score_toxicity(docs, r).collect()}
    assert [out[i] for i in odd] == [["abusive"], ["sexual"], ["hateful"], [], [], []]
    assert sum(bool(out[i]) == (i % 4 == 0) for i in range(600)) >= 585
    assert toxicity.spelling("s3xxx") == toxicity.spelling("sex") and toxicity.words("m 0 r") == ["m", "0", "r"]


def test_words_of_a_batch():
    rng = random.Random(3)
    rows = ["".join(rng.choice("aeiouſßfu c k  *.!'@1жо") for _ in range(rng.randrange(25))) for _ in range(2000)] + ["s e x", "", "you are a d o g"]
    assert [[("." if w[0] in ".!?\n" else w) for w in ws] for ws in toxicity._words_of(rows)] == [toxicity.words(t) for t in rows]


# Hard rows through every operator


def test_hard_and_empty_tables(spark):
    for rows in (HARD + HARD, []):
        d = texts(spark, rows)
        assert lookalike.same_look_pairs(d).count() == 0
        assert lookalike.consistent_texts(d).count() == len(rows)
        c = duplicates.formatting_classes(d).collect()
        assert all(r.copies == 2 for r in c)
        p = spark.createDataFrame([(t, t) for t in rows], "text string, target string")
        found, *_ = pages.page_noise(d, p)
        found.count()
        assert pages.repair(d, p).count() == len([t for t in rows if t is not None])
        automata = languages.fit_languages(spark.createDataFrame([("d", "en", t) for t in rows], "doc_id string, lang string, text string"))
        assert languages.label_segments(d, automata).count() == len(rows)
        q = spark.createDataFrame([(f"r{i}", 0, t, u, "en", None) for i, (t, u) in enumerate(zip(rows, rows[::-1], strict=True))], "ref string, pos int, source string, target string, source_lang string, target_lang string")
        pairs.defective_pairs(q).count()
        truncation.score_truncation(q.withColumn("limit", F.lit(None).cast("int"))).count()
        docs = spark.createDataFrame([(i, None, None, t) for i, t in enumerate(rows)], "doc_id long, source string, lang string, text string")
        assert packing.containers(docs).select("doc_id").distinct().count() == len(rows)
        assert leaks.leaks(docs, spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "item_id long, text string")).count() >= 0
        none = spark.createDataFrame([], "doc_id long, rater_id int, toxic int, category string")
        assert {tuple(r.categories) for r in toxicity.score_toxicity(docs, none).collect()} <= {()}


def test_references(spark, data):
    r = refs.texts(spark, data, block="source_text", region="source_text").select("ref").collect()
    assert all(x.ref.split(":")[0] in ("block", "region") for x in r)
