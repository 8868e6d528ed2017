"""Operators on small rows made here."""

import random

import pytest
from pyspark.sql import functions as F

from lexloom.functions import fonts, raster
from lexloom.functions import text as X
from lexloom.operators import blocks as B
from lexloom.operators import progress as P
from lexloom.operators import shapes as S
from lexloom.operators import words as W
from lexloom.operators.quality import text_present

BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
LAYOUT = f"struct<slide_index:int,position:{BOX},base_font:struct<size:double>>"


def blocks(spark, rows):
    cols = "doc_id string, ord bigint, id string, type string, semantic_role string, source_text string, target_text string, translatable boolean"
    full = f"{cols}, layout {LAYOUT}, source_ref struct<kind:string,shape_id:bigint,row:int,col:int>, runs array<struct<font:struct<size:double>>>"
    return spark.createDataFrame(rows, full)


def row(ord_, text, target=None, type_="body", role=None, box=(0, 2_000_000, 100, 100), slide=0, shape=None):
    return ("d", ord_, f"b{ord_}", type_, role, text, target, True, (slide, box, (None,)), ("shape_text", shape or ord_, None, None), [])


def test_second_title_of_a_slide_stays_without_role(spark):
    b = blocks(spark, [row(1, "a", box=(0, 10, 9, 9)), row(2, "b", box=(0, 20, 9, 9)), row(3, "c", role="title"), row(4, "d", box=(0, 5, 9, 9), slide=1)])
    assert {r.id: r.role for r in B.with_roles(b).collect()} == {"b1": "title", "b2": None, "b3": "title", "b4": "title"}


def test_limits(spark):
    b = blocks(spark, [row(1, "a", box=(0, 0, 1270000, 1270000)), row(2, "b", box=None)])
    assert [r.c for r in b.select(B.max_chars().alias("c")).collect()] == [40, None]


def test_glossary_first_place_without_case(spark):
    b = blocks(spark, [row(1, "A Pilot and a pilot"), row(2, "nothing"), row(3, None)])
    assert [(r.id, r.start, r.end) for r in B.glossary_hits(b, [("pilot", "x")]).collect()] == [("b1", 2, 7)]


def test_batches_need_a_size(spark):
    with pytest.raises(ValueError, match="positive"):
        B.batches(blocks(spark, [row(1, "a")]), 0)


def test_bilingual_slide(spark):
    rows = [row(1, "Hello", "你好", box=(0, 0, 100, 40)), row(2, "你好", "x", box=(110, 0, 100, 40)), row(3, "Hello", "再见", box=(0, 500, 10, 10))]
    out = {r.id: r.target_text for r in B.suppress_bilingual(blocks(spark, rows), "en", "zh").collect()}
    assert out == {"b1": "", "b2": "你好", "b3": "再见"}
    meta = spark.createDataFrame([("d", "en", "zh")], "doc_id string, source_lang string, target_lang string")
    assert [tuple(r) for r in B.bilingual_pairs(blocks(spark, rows), meta).collect()] == [("d", "b1", "b2")]


def test_bilingual_slides_of_all_languages(spark):
    slides = {"d": ("Hello", "你好", "en", "zh"), "e": ("Hallo", "Bonjour", "de", "fr"), "f": ("Hello", "Hallo", None, None)}
    b = None
    for k, (source, target, *_) in slides.items():
        one = blocks(spark, [row(1, source, target, box=(0, 0, 100, 40)), row(2, target, "x", box=(110, 0, 100, 40))]).withColumn("doc_id", F.lit(k))
        b = one if b is None else b.unionByName(one)
    b = b.join(spark.createDataFrame([(k, s, t) for k, (_, _, s, t) in slides.items()], "doc_id string, source_lang string, target_lang string"), "doc_id")
    out = {(r.doc_id, r.id): r.target_text for r in B.suppress_bilingual(b, F.col("source_lang"), F.col("target_lang")).collect()}
    assert out == {("d", "b1"): "", ("d", "b2"): "你好", ("e", "b1"): "", ("e", "b2"): "Bonjour", ("f", "b1"): "Hallo", ("f", "b2"): "x"}


def test_bilingual_query_covers_every_block(spark, data):
    from lexloom.plans import catalogue

    got = catalogue.bilingual_suppression(spark, data).select("doc_id", "id").distinct()
    assert got.count() == spark.read.parquet(f"{data}/blocks.parquet").select("doc_id", "id").distinct().count()


def test_clusters_like_a_loop(spark):
    rng = random.Random(1)
    rows = [(f"l{i % 9}", i, rng.randrange(900), rng.randrange(5, 60), rng.randrange(5, 40)) for i in range(90)]
    got = {r.id: r.cluster for r in W.clusters(spark.createDataFrame(rows, "line string, id int, x int, w int, h int"), "line").collect()}
    want = {}
    for line in {r[0] for r in rows}:
        ws = sorted((r for r in rows if r[0] == line), key=lambda r: (r[2], r[1]))
        hs = sorted(r[4] for r in ws)
        mid = (hs[len(hs) // 2] + hs[(len(hs) - 1) // 2]) / 2
        k = 0
        for i, r in enumerate(ws):
            k += i > 0 and r[2] - (ws[i - 1][2] + ws[i - 1][3]) > max(30, 1.5 * mid)
            want[r[1]] = k
    assert got == want


def test_paragraphs_join_wrapped_lines_and_keep_columns(spark):
    lines = [("d", "i", 0, 0, 100, 10, "one"), ("d", "i", 0, 12, 90, 22, "two"), ("d", "i", 300, 1, 400, 11, "other"), ("d", "i", 0, 200, 50, 210, "far")]
    out = W.paragraphs(spark.createDataFrame(lines, "doc_id string, image_id string, left long, top long, right long, bottom long, text string")).collect()
    assert [r.text for r in sorted(out, key=lambda r: r.place)] == ["one\ntwo", "other", "far"]


def test_widths(spark):
    schema = f"doc_id string, slide int, z int, id string, box {BOX}"
    t = spark.createDataFrame([("d", 0, 1, "t", (0, 0, 100, 10)), ("d", 0, 2, "u", (0, 50, 100, 10))], schema)
    p = spark.createDataFrame([("d", 0, 3, "p", (60, 0, 100, 10)), ("d", 0, 0, "q", (10, 50, 100, 10)), ("d", 0, 4, "r", (10, 50, 100, 10))], schema)
    assert {r.id: r.width for r in S.visible_width(t, p).collect()} == {"t": 60, "u": 100}
    f = spark.createDataFrame([("d", 0, 0, "f", (-5, -5, 80, 30))], schema)
    assert {r.id: r.width for r in S.container_width(t, f).collect()} == {"t": 70, "u": 100}


def test_latest_report(spark):
    e = spark.sql("select * from values ('j','p',1,9,timestamp'2030-01-01 00:00:00',timestamp'2030-01-03 00:00:00'),('j','p',5,9,timestamp'2030-01-02 00:00:00',timestamp'2030-01-02 00:00:00'),('j','p',5,9,timestamp'2030-01-02 00:00:00',timestamp'2030-01-02 00:00:00') t(job_id,phase,completed,total,ts,arrived_at)")
    assert [tuple(r) for r in P.latest(e).collect()] == [("j", "p", 5, 9)]


def test_text_functions(spark):
    d = spark.createDataFrame([('x ["a", "b"] y', "SAP R3", "#FFF", " zh-CN "), ("no", "Plain text", "#102030", "xx")], "j string, m string, c string, l string")
    r = d.select(X.json_array(F.col("j")), X.protected_mark(F.col("m")), X.colour(F.col("c"), 1), X.supported_language(F.col("l"))).collect()
    assert [tuple(x) for x in r] == [(["a", "b"], True, 255, "zh"), (None, False, 32, None)]
    assert X.normal_form("Ｈé-ﬁ ²") == "héfi2"
    clean = spark.createDataFrame([("中 文 ( a ) , b",)], "t string").select(X.ocr_clean(F.col("t"))).first()[0]
    assert clean == "中文 (a), b"
    style = spark.createDataFrame([("font-size: 12px; color:#AABBCC;font-weight:bold",)], "s string").select(X.style_font(F.col("s")).alias("f")).select("f.*").first()
    assert (style.size, style.color, style.bold, style.italic) == (12.0, "#AABBCC", True, False)
    n = spark.createDataFrame([(["a"], ["x", "y"]), (["a", "b", "c"], ["x"])], "v array<string>, f array<string>").select(X.fit_length(F.col("v"), F.col("f"))).collect()
    assert [r[0] for r in n] == [["a", "y"], ["a"]]


def test_languages_have_five_attributes(spark):
    d = spark.createDataFrame([("en-US",), ("DE-de",), ("zh-Hans",), (" zh_hans ",), ("fr",), ("english",), (None,)], "l string").select(X.language(F.col("l")).alias("x"))
    got = [r.x and tuple(r.x) for r in d.collect()]
    zh = ("zh", "Simplified Chinese (zh-CN)", "zh-CN", "chi_sim+eng", "ch")
    assert got == [("en", "English", "en-US", "eng", "en"), ("de", "German (de-DE)", "de-DE", "deu+eng", "german"), zh, zh, None, None, None]


def test_answers_of_recognisers_and_engines(spark):
    rows = [('```json\n[{"text": "a"}]\n```',), ('{"regions": [{"text": "b"}, {"text": "c"}]}',), ("so: [1, 2] is it",), ("nothing",), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, "c string").select(X.json_objects(F.col("c"))).collect()] == [['{"text":"a"}'], ['{"text":"b"}', '{"text":"c"}'], ["1", "2"], [], []]
    lines = spark.createDataFrame([("- one\n\n- 'two'", ["x", "y"]), ("one", ["x", "y"])], "c string, f array<string>").select(X.lines_or(F.col("c"), F.col("f"))).collect()
    assert [r[0] for r in lines] == [["one", "two"], ["x", "y"]]


def test_failed_recognition_goes_to_review(spark):
    from lexloom.operators import images as I

    s = "doc_id string, image_id string, content_hash string, display_area_ratio double, text_chars int, alpha_chars int, word_count int, meaningful_word_count int, lexical_word_ratio double, line_count int, mean_confidence double"
    rows = [("d", "a", None, None, None, None, None, None, None, None, None), ("d", "b", None, None, 40, 40, 9, 9, 0.9, 3, None), ("d", "tiny", None, None, None, None, None, None, None, None, None), ("d", "rich", None, None, 90, 80, 12, 10, 0.8, 4, 90.0)]
    i = spark.createDataFrame([("d", x, k, *((30, 30) if x == "tiny" else (800, 600))) for k, x in enumerate(("a", "b", "tiny", "rich"))], "doc_id string, id string, ord long, width int, height int")
    got = {r.image_id: (r.route, r.reason) for r in I.routes(spark.createDataFrame(rows, s), i).collect()}
    assert got == {"a": ("review", "local_ocr_unavailable"), "b": ("review", "local_ocr_unavailable"), "tiny": ("skip", "too_small"), "rich": ("whole_image", "text_rich_graphic")}


def test_output_gate(spark):
    from lexloom.operators import quality as Q

    s = "doc_id string, image_id string, expected_texts array<string>, expected_translations array<string>, output_texts array<string>"
    e, t = ["Die Falle", "Hohe Fehlerquote", "SAP"], ["The Trap", "High Error Rate", "SAP"]
    rows = [("d", "both", e, t, ["Die Falle", "High Error Rate"]), ("d", "fine", e, t, ["The Trap", "High Error Rate"]), ("d", "gone", e, t, ["The Trap"]), ("d", "none", [], t, ["x"]), ("d", "failed", e, t, None), ("d", "blank", e, t, [" "]), ("d", "near", e, t, ["The Trap", "High Errar Rate"])]
    df = spark.createDataFrame(rows, s)
    want = {"both": ("residual_source_text", ["Die Falle"], ["The Trap"]), "fine": (None, [], []), "gone": ("missing_target_text", [], ["High Error Rate"]), "none": ("translation_mapping_missing", [], []), "failed": ("post_generation_ocr_failed", [], []), "blank": ("post_generation_ocr_empty", [], [])}
    for fuzzy in (True, False):
        got = {r.image_id: (r.reason, r.residual, r.missing) for r in Q.output_gate(df, fuzzy).collect()}
        assert got.pop("near") == ((None, [], []) if fuzzy else ("missing_target_text", [], ["High Error Rate"])) and got == want


def test_enrichers_and_fills_are_registered(spark):
    from lexloom import plugins

    assert {"roles", "glossary", "constraints"} <= set(plugins.available("enricher")) and "pillow" in plugins.available("inpaint")
    b = B.enriched(blocks(spark, [row(1, "The data model", "x", box=(0, 0, 9144000, 500000))]), [("Data Model", "Datenmodell"), ("absent", "-")]).first()
    assert b.semantic_role == "title" and [tuple(h) for h in b.term_hits] == [("Data Model", "Datenmodell", 4, 14)] and b.constraints.max_chars > 0 and b.constraints.can_shrink_font


def test_styles_read_alike(spark):
    from lexloom.sources.webpages import style_font

    css = ["font-size: 12.5px; color:#abc;font-weight:700; FONT-STYLE: Italic; font-family: 'Noto Sans', serif", "background-color:#112233;font-weight:600", "", "color: red; font-weight: bolder; color:#A1B2C3"]
    got = [r.f.asDict() for r in spark.createDataFrame([(c,) for c in css], "s string").select(X.style_font(F.col("s")).alias("f")).collect()]
    assert got == [{k: style_font(c)[k] for k in ("name", "size", "color", "bold", "italic")} for c in css]


def test_duplicates_and_reuse(spark):
    from lexloom.operators import images as I

    s = spark.createDataFrame([("d", "a", "h", None), ("d", "b", "h", "a"), ("d", "c", None, None), ("e", "a", "h", None)], "doc_id string, image_id string, content_hash string, duplicate_of string")
    i = spark.createDataFrame([("d", "a", 0, "a-de.png"), ("d", "b", 1, None), ("d", "c", 2, None), ("e", "a", 0, None)], "doc_id string, id string, ord long, localized_data_ref string")
    assert [tuple(r) for r in I.exact_duplicates(s, i).collect()] == [("d", "b", "a")] and [tuple(r) for r in I.reuse(s, i).collect()] == [("d", "b", "a-de.png")]
    assert {r.id for r in I.of_slides(spark.createDataFrame([("s0-sh1",), ("s1-sh1",), ("x",)], "id string"), [2]).collect()} == {"s1-sh1"}


def test_fuzzy_presence():
    assert text_present("Quarterly results", ["Quarterly resuIts"])
    assert text_present("ab", []) and not text_present("Quarterly", ["something else"])


def test_raster():
    np = pytest.importorskip("numpy")
    img = np.full((60, 80, 3), 240, np.uint8)
    img[20:30, 20:40] = (10, 20, 30)
    box = {"x": 18, "y": 18, "w": 24, "h": 14}
    assert raster.background_kind(img, box) == "solid" and raster.text_colour(img, box) == "#101020"
    assert (raster.erased(img, [box]) == 240).all() and raster.mask(80, 60, [box]).sum() == 255 * 24 * 14


def test_fonts():
    assert fonts.fits("short", 200, 40, 20) and not fonts.fits("a much longer text than this box can hold", 60, 20, 20)
    sizes = [fonts.fitted_size("some words to set", w, 60, 72) for w in (40, 100, 300)]
    assert sizes == sorted(sizes) and sizes[0] >= 5
    assert fonts.wrapped("中文中文", 2) == ["中文", "中文"]


def test_png():
    np = pytest.importorskip("numpy")
    from lexloom.functions import png

    img = np.random.default_rng(1).integers(0, 255, (7, 5, 3)).astype(np.uint8)
    assert (png.decode(png.encode(img)) == img).all() and (png.decode(png.encode(img[:, :, 0]))[:, :, 1] == img[:, :, 0]).all()
    assert png.visible_part(img, 0.2, 0, 0.2, 0.5).shape == (4, 3, 3) and png.visible_part(img, 1, 1, 1, 1).shape == (1, 1, 3)
    assert png.visual_hash(img) == png.visual_hash(png.decode(png.encode(img)))
    with pytest.raises(ValueError, match="PNG"):
        png.decode(b"GIF89a")


def test_answers_fall_back_to_the_source(spark):
    from lexloom.operators import localize as L

    r = spark.createDataFrame([("d", ["a", "b"], ["one", "two"], 'here: ["eins"]'), ("e", ["c"], ["three"], "no array")], "doc_id string, ids array<string>, texts array<string>, answer string")
    assert {x.id: x.target_text for x in L.answered(r, F.col("answer")).collect()} == {"a": "eins", "b": "two", "c": "three"}
