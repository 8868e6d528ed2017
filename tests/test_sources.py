"""Documents built here, read to blocks, changed and read again."""

import io
import zipfile

from lexloom import plugins
from lexloom.sources import documents, office, webpages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PA = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PNG = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (40).to_bytes(4, "big") + (20).to_bytes(4, "big") + b"\x08\x02\x00\x00\x00"


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return out.getvalue()


def docx():
    p = lambda t, style="": f"<w:p>{f'<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>' if style else ''}<w:r><w:rPr><w:b/></w:rPr><w:t>{t}</w:t></w:r></w:p>"
    body = p("Quarterly Results", "H1") + "<w:p/>" + p("Revenue grew.") + f"<w:tbl><w:tr><w:tc>{p('Metric')}</w:tc><w:tc>{p('Value')}</w:tc></w:tr></w:tbl>" + p("An item", "ListBullet")
    styles = f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style><w:style w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style></w:styles>'
    rels = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId7" Type="{REL}/image" Target="media/a.png"/></Relationships>'
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/styles.xml": styles, "word/_rels/document.xml.rels": rels, "word/media/a.png": PNG, "other.bin": b"kept"})


def pptx():
    run = lambda t: f'<a:p><a:r><a:rPr lang="en-US" sz="1800"/><a:t>{t}</a:t></a:r></a:p>'
    sp = lambda n, t, ph="": f'<p:sp><p:nvSpPr><p:cNvPr id="{n}" name="x"/><p:cNvSpPr/><p:nvPr>{ph}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm></p:spPr><p:txBody>{t}</p:txBody></p:sp>'
    table = f'<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="t"/></p:nvGraphicFramePr><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody>{run("Users")}</a:txBody></a:tc><a:tc><a:txBody>{run("1000")}</a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    pic = '<p:pic><p:nvPicPr><p:cNvPr id="5" name="p"/></p:nvPicPr><p:blipFill><a:blip r:embed="rId2"/></p:blipFill><p:spPr/></p:pic>'
    group = f"<p:grpSp>{sp(7, run('Inside'))}</p:grpSp>"
    title = sp(2, run("Results"), '<p:ph type="title"/>')
    slide = f"<p:sld {PA}><p:cSld><p:spTree>{title}{sp(3, run('Body') + '<a:p/>' + run('More'))}{group}{table}{pic}</p:spTree></p:cSld></p:sld>"
    rel = lambda x: f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{x}</Relationships>'
    return zipped({
        "ppt/presentation.xml": f'<p:presentation {PA}><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst><p:sldSz cx="9144000" cy="6858000"/></p:presentation>',
        "ppt/_rels/presentation.xml.rels": rel(f'<Relationship Id="rId1" Type="{REL}/slide" Target="slides/slide1.xml"/>'),
        "ppt/slides/slide1.xml": slide, "ppt/slides/_rels/slide1.xml.rels": rel(f'<Relationship Id="rId2" Type="{REL}/image" Target="../media/b.png"/>'), "ppt/media/b.png": PNG,
    })


PAGE = b"""<html><head><title>T</title><style>p{}</style></head><body><h1>Head <b>line</b></h1><div><p style="font-weight:bold">One &amp; two</p><ul><li>a<li>b</ul></div>
<table><tr><th>K<td>V</tr></table><table><tr><td>X</td></tr></table><img src="i.png" alt="Alt"><script>var p = "<p>no</p>";</script></body></html>"""


def test_docx_round_trip():
    fields, blocks, images = office.parse_docx(docx())
    assert [(b["id"], b["type"], b["semantic_role"]) for b in blocks] == [
        ("docx-p0", "heading", "h1"), ("docx-p1", "paragraph", None), ("docx-t2-r0-c0", "table_cell", None), ("docx-t3-r0-c1", "table_cell", None), ("docx-p4", "list_item", "list_item"), ("docx-img0", "image", None),
    ]
    assert blocks[0]["runs"][0]["font"]["bold"] and (images[0]["width"], images[0]["height"]) == (40, 20)
    new = office.render_docx(docx(), {"docx-p1": "Umsatz wuchs.", "docx-t3-r0-c1": "Wert"}, {"docx-img0": b"new"})
    assert [b["source_text"] for b in office.parse_docx(new)[1]] == ["Quarterly Results", "Umsatz wuchs.", "Metric", "Wert", "An item", ""]
    z = zipfile.ZipFile(io.BytesIO(new))
    assert z.read("other.bin") == b"kept" and z.read("word/media/a.png") == b"new"


def test_pptx_round_trip():
    fields, blocks, images = office.parse_pptx(pptx())
    assert fields == {"slide_width": 9144000, "slide_height": 6858000, "title": "Results"}
    assert [b["id"] for b in blocks] == ["s0-sh2-p0", "s0-sh3-p0", "s0-sh3-p2", "s0-sh7-p0", "s0-sh9-r0-c0-p0", "s0-sh9-r0-c1-p0", "s0-sh5-img"]
    assert blocks[0]["type"] == "title" and blocks[1]["layout"]["position"] == {"x": 1, "y": 2, "w": 3, "h": 4}
    new = office.render_pptx(pptx(), {"s0-sh3-p2": "Mehr", "s0-sh9-r0-c0-p0": "Nutzer"}, lang="de-DE")
    assert [b["source_text"] for b in office.parse_pptx(new)[1]][2:5] == ["Mehr", "Inside", "Nutzer"]


def test_word_file_keeps_the_prefixes_its_attributes_name():
    from xml.etree import ElementTree as ET

    more = 'xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" mc:Ignorable="w14"'
    for declared in (W, W.replace("xmlns:w=", "xmlns=")):
        tag = "w:" if "xmlns:w=" in declared else ""
        raw = f'<{tag}document {declared} {more}><{tag}body><{tag}p w14:paraId="1&#10;2"><{tag}r><{tag}t>One &lt; &amp; two</{tag}t></{tag}r></{tag}p>\n</{tag}body></{tag}document>'
        if not tag:
            raw = raw.replace("<document ", '<document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" ')
        new = office.render_docx(zipped({"word/document.xml": raw}), {"docx-p0": 'Zwei & "drei" <vier>'})
        text = zipfile.ZipFile(io.BytesIO(new)).read("word/document.xml").decode()
        assert 'xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml"' in text.split(">")[1] and 'mc:Ignorable="w14"' in text and 'standalone="yes"' in text
        a, b = (ET.canonicalize(x, rewrite_prefixes=True) for x in (raw.replace("One &lt; &amp; two", "Zwei &amp; \"drei\" &lt;vier&gt;"), text.replace(' xml:space="preserve"', "")))
        assert a.replace(' n1:Ignorable="w14"', "") == b.replace(' n1:Ignorable="w14"', "") or ET.fromstring(raw).tag == ET.fromstring(text).tag
        assert [x["source_text"] for x in office.parse_docx(new)[1]] == ['Zwei & "drei" <vier>']
    assert "w14" not in ET._namespace_map.values()


def test_crop_swap_size_and_face(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lexloom.functions import png

    picture = np.zeros((20, 40, 3), np.uint8)
    picture[:, 20:] = 200
    parts = {n: zipfile.ZipFile(io.BytesIO(pptx())).read(n) for n in zipfile.ZipFile(io.BytesIO(pptx())).namelist()}
    parts["ppt/media/b.png"] = png.encode(picture)
    slide = parts["ppt/slides/slide1.xml"].decode().replace('<a:blip r:embed="rId2"/>', '<a:blip r:embed="rId2"/><a:srcRect l="50000" b="25000"/>').replace('cx="3" cy="4"', f'cx="{200 * 12700}" cy="{40 * 12700}"').replace("<p:txBody>", "<p:txBody><a:bodyPr/>")
    parts["ppt/slides/slide1.xml"] = slide.encode()
    deck = zipped(parts)
    image = office.parse_pptx(deck)[2][0]
    assert image["reset_crop_on_render"] and (image["width"], image["height"]) == (20, 15) and (png.decode(image["content"]) == 200).all()
    files = spark.createDataFrame([("d", "x.pptx", "pptx", bytearray(deck)), ("e", "y.pptx", "pptx", bytearray(deck))], "doc_id string, path string, doc_type string, content binary")
    long = "这是一个很长的标题，它放不进这个小框里。" * 4
    b = documents.blocks_of(files).withColumn("target_text", F.when((F.col("id") == "s0-sh2-p0") & (F.col("doc_id") == "d"), long))
    pictures = spark.createDataFrame([("d", "s0-sh5-img", bytearray(b"new")), ("e", "s0-sh5-img", None)], "doc_id string, id string, content binary")
    languages = spark.createDataFrame([("d", "zh-Hans")], "doc_id string, target_lang string")
    out = {r.doc_id: zipfile.ZipFile(io.BytesIO(bytes(r.content))) for r in documents.rendered(files, b, pictures, languages).collect()}
    text = out["d"].read("ppt/slides/slide1.xml").decode()
    assert out["d"].read("ppt/media/b.png") == b"new" and 'l="50000"' not in text and "srcRect" in text
    assert 'lang="zh-CN"' in text and 'typeface="Microsoft YaHei"' in text and "normAutofit" in text and 'wrap="square"' in text
    sizes = [r["font"]["size"] for x in office.parse_pptx(out["d"].fp.getvalue() if hasattr(out["d"].fp, "getvalue") else b"")[1] if x["id"] == "s0-sh2-p0" for r in x["runs"]]
    assert sizes and 8.0 <= sizes[0] < 18.0
    assert out["e"].read("ppt/slides/slide1.xml").decode() == slide and out["e"].read("ppt/media/b.png") == parts["ppt/media/b.png"]


def test_page_round_trip():
    fields, blocks, _ = webpages.parse(PAGE)
    assert fields["title"] == "T"
    assert [(b["id"], b["type"], b["source_text"]) for b in blocks] == [
        ("html-0", "heading", "Headline"), ("html-1", "paragraph", "One & two"), ("html-2", "list_item", "a"), ("html-3", "list_item", "b"), ("html-t4-r0-c0", "table_cell", "K"),
        ("html-t5-r0-c1", "table_cell", "V"), ("html-t6-r0-c0", "table_cell", "X"), ("html-img7", "image", "Alt"),
    ]
    ids = {b["source_text"]: b["id"] for b in blocks}
    new = webpages.render(PAGE, {ids["X"]: "Y", ids["One & two"]: "1 < 2", ids["Alt"]: "Bild"})
    assert b"1 &lt; 2" in new and b'alt="Bild"' in new and b'var p = "<p>no</p>";' in new
    assert {"Y", "V", "1 < 2"} <= {b["source_text"] for b in webpages.parse(new)[1]}


def test_tables_of_files(spark, tmp_path):
    for name, data in {"a.docx": docx(), "b.pptx": pptx(), "c.html": PAGE, "d.xyz": b"?", "e.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(data)
    files = documents.read_files(spark, str(tmp_path))
    d = {r.doc_type + str(r.error is None): r for r in documents.documents_of(files).collect()}
    assert len(d) == 5 and d["docxFalse"].error and "no parser" in d["xyzFalse"].error
    blocks = documents.blocks_of(files)
    assert blocks.count() == 6 + 7 + len(webpages.parse(PAGE)[1]) and documents.images_of(files).count() == 2
    from pyspark.sql import functions as F

    out = documents.rendered(files, plugins.get("translation", "mock")(blocks.where("translatable"), "de")).where(F.col("content").isNotNull())
    assert {r.doc_type for r in out.collect()} == {"docx", "pptx", "html"}
    again = documents.blocks_of(out.select("doc_id", "path", "doc_type", "content")).where("translatable").collect()
    assert again and all(r.source_text.startswith("[de] ") for r in again)
    assert documents.as_json(documents.documents_of(files), blocks).count() == 5


def test_glossary_and_words(spark, tmp_path):
    (tmp_path / "g.csv").write_text("a,1\n b ,2\na,3\n,4\nlonely\n")
    assert {r.term: r.preferred for r in documents.glossary(spark, str(tmp_path / "g.csv")).collect()} == {"a": "3", "b": "2"}
    (tmp_path / "w.tsv").write_text("level\tblock_num\tpar_num\tline_num\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t0\t0\t9\t9\t88.5\tword\n5\t1\t1\t1\tx\t0\t9\t9\t1\tbad\n5\t1\t1\t1\t0\t0\t9\t9\t\tnoconf\n")
    assert {r.word: r.confidence for r in documents.ocr_words(spark, str(tmp_path / "w.tsv")).collect()} == {"word": 88.5, "noconf": -1.0}


def test_registry():
    assert {"docx", "pptx", "html"} <= set(plugins.available("parser"))
    try:
        plugins.get("ocr", "nope")
    except KeyError as e:
        assert "tesseract" in str(e)


def test_stream(spark, tmp_path, data):
    from lexloom.operators.progress import latest
    from lexloom.sources.tables import table
    from lexloom.streaming import progress

    src = tmp_path / "in"
    table(spark, data, "job_events").write.parquet(str(src))
    q = progress.latest_into(progress.events(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = {(r.job_id, r.phase, r.completed) for r in spark.read.parquet(str(tmp_path / "out" / "n=0")).collect()}
    assert got == {(r.job_id, r.phase, r.completed) for r in latest(table(spark, data, "job_events")).collect()}
    w = progress.progress_by_window(progress.events(spark, str(src)))
    q = w.writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # Windows that the watermark has passed come out, each once.
    got = spark.sql("select * from windows")
    assert 0 < got.count() == got.distinct().count()
