"""Word documents and presentations to blocks and back. Only the parts that change are rewritten; every other entry is copied."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from lexloom.functions import png
from lexloom.functions.fonts import fitted_size
from lexloom.sources.schemas import block, font

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
D = "{http://schemas.openxmlformats.org/drawingml/2006/diagram}"
XML = "{http://www.w3.org/XML/1998/namespace}"
MEDIA = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "emf": "image/emf", "wmf": "image/wmf"}


# EMU of a point, margins of a text frame that states none, sizes in points where a text or its limits state none, and the face of Chinese text.
EMU_PER_POINT, MARGINS = 12700, {"lIns": 91440, "rIns": 91440, "tIns": 45720, "bIns": 45720}
USUAL_SIZE, LEAST_SIZE, LEAST_PIXELS, EAST_ASIAN = 32.0, 8.0, 4, "Microsoft YaHei"
#: Parts of a side, in hundred-thousandths, from which a picture counts as cropped.
CROPPED = 1


def as_xml(root: ET.Element, declared: list[tuple[str, str]]) -> bytes:
    """The tree as a file. All namespaces that the file `declared` are declared at its root under their own prefixes, used or not, as attributes like mc:Ignorable
    name prefixes in their values."""
    uri_of: dict[str, str] = {"xml": XML[1:-1]}
    for prefix, uri in declared:
        uri_of.setdefault(prefix, uri)
    names = {uri: prefix for prefix, uri in reversed(uri_of.items())}
    for e in root.iter():
        for tag in (e.tag, *e.attrib):
            uri, _, _ = tag[1:].partition("}") if tag[0] == "{" else ("", "", "")
            if uri and (uri not in names or (not names[uri] and tag != e.tag)):
                names[uri] = next(f"x{i}" for i in range(len(uri_of) + 1) if f"x{i}" not in uri_of)
                uri_of[names[uri]] = uri
    short = lambda tag: ":".join(x for x in (names[tag[1:].partition("}")[0]], tag.partition("}")[2]) if x) if tag[0] == "{" else tag
    # Line ends and tabs in attributes would come back as blanks.
    value = lambda v: quoteattr(v, {"\n": "&#10;", "\r": "&#13;", "\t": "&#9;"})
    out = ['<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n']
    todo: list[ET.Element | str] = [root]
    while todo:
        e = todo.pop()
        if isinstance(e, str):
            out.append(e)
            continue
        own = "".join(f" xmlns{':' * bool(p)}{p}={value(u)}" for p, u in uri_of.items() if p != "xml") if e is root else ""
        out.append(f"<{short(e.tag)}{own}{''.join(f' {short(k)}={value(v)}' for k, v in e.attrib.items())}")
        todo.append(escape(e.tail or "", {"\r": "&#13;"}) if e is not root else "")
        if len(e) or e.text:
            out.append(f">{escape(e.text or '', {chr(13): '&#13;'})}")
            todo.append(f"</{short(e.tag)}>")
            todo += reversed(e)
        else:
            out.append("/>")
    return "".join(out).encode()


class Package:
    """A zip of XML parts with relations; changed parts are kept until `saved`."""

    def __init__(self, content: bytes) -> None:
        self.zip = zipfile.ZipFile(io.BytesIO(content))
        self.names = set(self.zip.namelist())
        self.trees: dict[str, ET.Element] = {}
        self.declared: dict[str, list[tuple[str, str]]] = {}
        self.changed: dict[str, bytes | None] = {}

    def root(self, part: str) -> ET.Element:
        if part not in self.trees:
            raw = self.zip.read(part)
            self.declared[part] = [ns for _, ns in ET.iterparse(io.BytesIO(raw), ("start-ns",))]
            self.trees[part] = ET.fromstring(raw)
        return self.trees[part]

    def relations(self, part: str) -> dict[str, tuple[str, str]]:
        """Relation id to (type, target part)."""
        folder, name = posixpath.split(part)
        rels = f"{folder}/_rels/{name}.rels"
        if rels not in self.names:
            return {}
        out = {}
        for x in ET.fromstring(self.zip.read(rels)):
            target = x.get("Target", "")
            if x.get("TargetMode") != "External":
                target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[x.get("Id")] = (x.get("Type", ""), target)
        return out

    def saved(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i in self.zip.infolist():
                new = self.changed.get(i.filename, b"")
                data = self.zip.read(i.filename) if i.filename not in self.changed else new if new is not None else as_xml(self.trees[i.filename], self.declared[i.filename])
                z.writestr(i, data, compress_type=i.compress_type)
        return out.getvalue()


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG, GIF, BMP or JPEG; zeros for anything else."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24])
    if data[:3] == b"GIF":
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(data):
            if data[i] != 0xFF:
                i += 1
            elif 0xC0 <= data[i + 1] <= 0xCF and data[i + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                return w, h
            else:
                i += 2 + struct.unpack(">H", data[i + 2 : i + 4])[0]
    return 0, 0


# Word documents


def _w_text(run: ET.Element) -> str:
    return "".join(x.text or "" if x.tag == W + "t" else "\t" if x.tag == W + "tab" else "\n" if x.tag in (W + "br", W + "cr") else "" for x in run)


def _w_font(run: ET.Element) -> dict:
    p = run.find(W + "rPr")
    if p is None:
        return font()
    on = lambda tag: (x := p.find(W + tag)) is not None and x.get(W + "val", "true") not in ("0", "false", "none")
    value = lambda tag, key="val": x.get(W + key) if (x := p.find(W + tag)) is not None else None
    colour = value("color")
    return font(value("rFonts", "ascii"), float(s) / 2 if (s := value("sz")) else None, f"#{colour.upper()}" if colour and re.fullmatch("[0-9A-Fa-f]{6}", colour) else None, on("b"), on("i"), on("u"))


def _w_paragraphs(body: ET.Element) -> Iterator[tuple[int, ET.Element, int | None, int | None, int | None]]:
    """(ordinal, paragraph, ordinal of its table, row, column) of all paragraphs of the body, blank ones too."""
    n = 0
    for e in body:
        if e.tag == W + "p":
            yield n, e, None, None, None
            n += 1
        elif e.tag == W + "tbl":
            first = n
            for r, row in enumerate(e.findall(W + "tr")):
                for c, cell in enumerate(row.findall(W + "tc")):
                    for p in cell.findall(W + "p"):
                        yield n, p, first, r, c
                        n += 1


def _styles(package: Package) -> dict[str, str]:
    if "word/styles.xml" not in package.names:
        return {}
    return {s.get(W + "styleId"): s.find(W + "name").get(W + "val", "") for s in package.root("word/styles.xml").findall(W + "style") if s.find(W + "name") is not None}


def parse_docx(content: bytes) -> tuple[dict, list[dict], list[dict]]:
    """(document fields, blocks, images). `paragraph_index` is the ordinal among all paragraphs, so blank ones never shift an address."""
    package = Package(content)
    body, styles = package.root("word/document.xml").find(W + "body"), _styles(package)
    out, images, shown = [], [], 0
    for n, p, table, row, col in _w_paragraphs(body):
        runs = [{"text": t, "font": _w_font(r), "lang": None} for r in p.iter(W + "r") if (t := _w_text(r))]
        text = "".join(r["text"] for r in runs).strip()
        if not text:
            continue
        pr = p.find(W + "pPr")
        style = pr.find(W + "pStyle") if pr is not None else None
        name = styles.get(style.get(W + "val"), style.get(W + "val")) if style is not None else ""
        level = re.fullmatch(r"heading\s*(\d+)", name, re.IGNORECASE)
        listed = "list" in name.lower() or (pr is not None and pr.find(W + "numPr") is not None)
        if table is not None:
            id_, type_, role = f"docx-t{shown}-r{row}-c{col}", "table_cell", None
        else:
            id_ = f"docx-p{shown}"
            type_, role = ("heading", f"h{level[1]}") if level else ("list_item", "list_item") if listed else ("paragraph", None)
        out.append(block(id_, type_, text, runs, role, layout={"element_id": id_}, paragraph_index=n, row=row, col=col))
        shown += 1
    k = 0
    for rel, (kind, part) in package.relations("word/document.xml").items():
        if "image" in kind and part in package.names:
            data, id_ = package.zip.read(part), f"docx-img{k}"
            w, h = image_size(data)
            images.append({"id": id_, "media_type": MEDIA.get(part.rsplit(".", 1)[-1].lower(), "image/png"), "width": w, "height": h, "content": data})
            out.append(block(id_, "image", "", [], translatable=False, layout={"element_id": id_}, kind="image_region", image_id=id_, region_id=rel))
            k += 1
    title = package.root("docProps/core.xml").findtext("{http://purl.org/dc/elements/1.1/}title") if "docProps/core.xml" in package.names else None
    return {"title": title or None}, out, images


def render_docx(content: bytes, targets: dict[str, str], images: dict[str, bytes] | None = None, lang: str | None = None, limits: dict[str, dict] | None = None) -> bytes:
    """The document with new texts and image contents by block id; the first run of a paragraph takes the text, the others are emptied."""
    package = Package(content)
    _, blocks, _ = parse_docx(content)
    at = {b["source_ref"]["paragraph_index"]: targets[b["id"]] for b in blocks if b["type"] != "image" and b["id"] in targets}
    for n, p, *_ in _w_paragraphs(package.root("word/document.xml").find(W + "body")):
        if n in at:
            runs = list(p.iter(W + "r")) or [ET.SubElement(p, W + "r")]
            for i, r in enumerate(runs):
                for x in [x for x in r if x.tag in (W + "t", W + "tab", W + "br", W + "cr")]:
                    r.remove(x)
                if i == 0:
                    t = ET.SubElement(r, W + "t")
                    t.text = at[n]
                    t.set(XML + "space", "preserve")
            package.changed["word/document.xml"] = None
    rels = package.relations("word/document.xml")
    for b in blocks:
        if b["type"] == "image" and b["id"] in (images or {}):
            package.changed[rels[b["source_ref"]["region_id"]][1]] = images[b["id"]]
    return package.saved()


# Presentations


def _a_font(run: ET.Element) -> dict:
    p = run.find(A + "rPr")
    if p is None:
        return font()
    face, rgb = p.find(A + "latin"), p.find(f"{A}solidFill/{A}srgbClr")
    yes = lambda k: p.get(k) in ("1", "true")
    return font(face.get("typeface") if face is not None else None, int(s) / 100 if (s := p.get("sz")) else None, f"#{rgb.get('val').upper()}" if rgb is not None else None, yes("b"), yes("i"), p.get("u", "none") != "none")


def _a_runs(p: ET.Element) -> list[dict]:
    return [{"text": r.findtext(A + "t") or "", "font": _a_font(r), "lang": x.get("lang") if (x := r.find(A + "rPr")) is not None else None} for r in p.findall(A + "r")]


def _position(shape: ET.Element) -> dict | None:
    for x in (shape.find(f"{P}spPr/{A}xfrm"), shape.find(P + "xfrm")):
        if x is not None and x.find(A + "off") is not None and x.find(A + "ext") is not None:
            o, e = x.find(A + "off"), x.find(A + "ext")
            return {"x": int(o.get("x")), "y": int(o.get("y")), "w": int(e.get("cx")), "h": int(e.get("cy"))}
    return None


def _shapes(parent: ET.Element) -> Iterator[ET.Element]:
    for x in parent:
        if x.tag == P + "grpSp":
            yield from _shapes(x)
        elif x.tag in (P + "sp", P + "pic", P + "graphicFrame"):
            yield x


def _slides(package: Package) -> list[str]:
    rels = package.relations("ppt/presentation.xml")
    ids = package.root("ppt/presentation.xml").find(P + "sldIdLst")
    return [rels[i.get(R + "id")][1] for i in (ids if ids is not None else []) if i.get(R + "id") in rels]


def _role(shape: ET.Element) -> str | None:
    ph = shape.find(f"{P}nvSpPr/{P}nvPr/{P}ph")
    return {"title": "title", "ctrTitle": "title", "subTitle": "subtitle", "body": "body"}.get(ph.get("type", "")) if ph is not None else None


def _crop(picture: ET.Element) -> ET.Element | None:
    """What crops a picture, if anything does."""
    rect = next(picture.iter(A + "srcRect"), None)
    return rect if rect is not None and any(abs(int(v)) > CROPPED for k, v in rect.attrib.items() if k in "ltrb") else None


def _texts(package: Package) -> Iterator[tuple[dict, list[ET.Element], str, ET.Element]]:
    """(block, its paragraphs, their part, its shape) of every block of a presentation; a picture has no paragraph."""
    for s, part in enumerate(_slides(package)):
        rels = package.relations(part)
        for shape in _shapes(package.root(part).find(f"{P}cSld/{P}spTree")):
            number = int(next(x.get("id") for x in shape.iter(P + "cNvPr")))
            where = {"slide_index": s, "shape_id": number}
            place = {"position": _position(shape)}
            if shape.tag == P + "pic":
                blip = next(shape.iter(A + "blip"), None)
                rel = blip.get(R + "embed") if blip is not None else None
                if rel in rels and rels[rel][1] in package.names:
                    id_ = f"s{s}-sh{number}-img"
                    yield block(id_, "image", "", [], translatable=False, layout=place, kind="image_region", image_id=id_, region_id=rels[rel][1], **where), [], part, shape
                continue
            table = next(shape.iter(A + "tbl"), None)
            if table is not None:
                for r, row in enumerate(table.findall(A + "tr")):
                    for c, cell in enumerate(row.findall(A + "tc")):
                        for i, p in enumerate(cell.findall(f"{A}txBody/{A}p")):
                            runs = _a_runs(p)
                            if (text := "".join(x["text"] for x in runs)).strip():
                                yield block(f"s{s}-sh{number}-r{r}-c{c}-p{i}", "table_cell", text, runs, layout=place, paragraph_index=i, row=r, col=c, **where), [p], part, shape
                continue
            link = next(shape.iter(D + "relIds"), None)
            if link is not None and link.get(R + "dm") in rels and rels[link.get(R + "dm")][1] in package.names:
                data = rels[link.get(R + "dm")][1]
                for i, point in enumerate(package.root(data).iter(D + "pt")):
                    text = "".join(t.text or "" for t in point.iter(A + "t"))
                    if text.strip():
                        key = point.get("modelId") or f"pt{i}"
                        runs = [x for p in point.iter(A + "p") for x in _a_runs(p)]
                        yield block(f"s{s}-sh{number}-sa{key}", "smartart", text, runs, layout=place, region_id=key, **where), list(point.iter(A + "p")), data, shape
                continue
            body = shape.find(P + "txBody")
            if body is not None:
                role, ps = _role(shape), body.findall(A + "p")
                base = next((x["font"] for p in ps for x in _a_runs(p)), font())
                for i, p in enumerate(ps):
                    runs = _a_runs(p)
                    if (text := "".join(x["text"] for x in runs)).strip():
                        yield block(f"s{s}-sh{number}-p{i}", role or "shape_text", text, runs, role, layout=place | {"base_font": base}, kind="shape_text", paragraph_index=i, **where), [p], part, shape


def parse_pptx(content: bytes) -> tuple[dict, list[dict], list[dict]]:
    """(document fields, blocks, images) in slide and drawing order: text frames, table cells, pictures, diagram points, groups opened."""
    package = Package(content)
    size = package.root("ppt/presentation.xml").find(P + "sldSz")
    out, images = [], []
    for b, _, _, shape in _texts(package):
        out.append(b)
        if b["type"] == "image":
            part = b["source_ref"]["region_id"]
            data, crop = package.zip.read(part), _crop(shape)
            shown = visible(data, {k: int(crop.get(k, 0)) / 100_000 for k in "ltrb"}) if crop is not None else None
            w, h = image_size(shown or data)
            images.append({"id": b["id"], "media_type": MEDIA.get(part.rsplit(".", 1)[-1].lower(), "image/png"), "width": w, "height": h, "content": shown or data, "reset_crop_on_render": shown is not None})
    fields = {"slide_width": int(size.get("cx")), "slide_height": int(size.get("cy"))} if size is not None else {}
    return fields | {"title": next((b["source_text"] for b in out if b["type"] == "title"), None)}, out, images


def visible(data: bytes, crop: dict[str, float]) -> bytes | None:
    """A PNG without what is cropped (shares of the left, top, right and bottom side); None for another file or a crop that adds margins."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or min(crop.values()) < 0:
        return None
    try:
        return png.encode(png.visible_part(png.decode(data), crop["l"], crop["t"], crop["r"], crop["b"]))
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):
        return None


def _properties(run: ET.Element) -> ET.Element:
    pr = run.find(A + "rPr")
    if pr is None:
        pr = ET.Element(A + "rPr")
        run.insert(0, pr)
    return pr


def _tagged(run: ET.Element, lang: str) -> None:
    """The run marked as of a language, Chinese with a face of its own."""
    pr = _properties(run)
    pr.set("lang", lang)
    if lang.startswith("zh") and pr.find(A + "ea") is None:
        # The schema wants the faces in this order behind fill and line.
        before = [i for i, x in enumerate(pr) if x.tag in (A + "cs", A + "sym", A + "hlinkClick", A + "hlinkMouseOver", A + "rtl", A + "extLst")]
        pr.insert(before[0] if before else len(pr), ET.Element(A + "ea", {"typeface": EAST_ASIAN}))


def _fitted(shape: ET.Element, b: dict, limits: dict) -> None:
    """The text of a shape made as large as fits its box, up to the size it had."""
    body, box = shape.find(P + "txBody"), b["layout"]["position"]
    frame = body.find(A + "bodyPr")
    if frame is None:
        frame = ET.Element(A + "bodyPr")
        body.insert(0, frame)
    frame.set("wrap", "square")
    for x in [x for x in frame if x.tag in (A + "noAutofit", A + "normAutofit", A + "spAutoFit")]:
        frame.remove(x)
    frame.insert(1 if len(frame) and frame[0].tag == A + "prstTxWarp" else 0, ET.Element(A + "normAutofit"))
    text = "\n".join("".join(t.text or "" for t in p.iter(A + "t")) for p in body.findall(A + "p"))
    if box is None or not text.strip():
        return
    margin = {k: int(frame.get(k, v)) for k, v in MARGINS.items()}
    pixels = lambda emu: max(1, round(emu / EMU_PER_POINT * 96 / 72))
    size = next((r["font"]["size"] for r in b["runs"] if r["font"]["size"]), None) or b["layout"]["base_font"]["size"] or USUAL_SIZE
    most = max(1, round(size * 96 / 72))
    least = min(most, max(LEAST_PIXELS, round((limits.get("min_font_size") or LEAST_SIZE) * 96 / 72)))
    best = fitted_size(text, pixels(box["w"] - margin["lIns"] - margin["rIns"]), pixels(box["h"] - margin["tIns"] - margin["bIns"]), most, least)
    for r in body.iter(A + "r"):
        if r.findtext(A + "t"):
            _properties(r).set("sz", str(round(best * 72 / 96 * 100)))


def render_pptx(content: bytes, targets: dict[str, str], images: dict[str, bytes] | None = None, lang: str | None = None, limits: dict[str, dict] | None = None) -> bytes:
    """The presentation with new texts and picture contents by block id.

    Targets equal to their source are left alone; a diagram point gets a paragraph for each line. Runs are marked as of `lang`. The text of a shape is fitted to its
    box, unless its block's `limits` say that it can't shrink. A picture whose content was cut to its visible part loses its crop with its content.
    """
    package, changed = Package(content), {}
    for b, ps, part, shape in _texts(package):
        if b["type"] == "image":
            if b["id"] in (images or {}):
                package.changed[b["source_ref"]["region_id"]] = images[b["id"]]
                if (crop := _crop(shape)) is not None and visible(package.zip.read(b["source_ref"]["region_id"]), {k: int(crop.get(k, 0)) / 100_000 for k in "ltrb"}) is not None:
                    for k in [k for k in crop.attrib if k in "ltrb"]:
                        del crop.attrib[k]
                    package.changed[part] = None
            continue
        if b["id"] not in targets or targets[b["id"]] == b["source_text"]:
            continue
        lines = targets[b["id"]].split("\n") if b["type"] == "smartart" else [targets[b["id"]]]
        for k, p in enumerate(ps):
            runs = p.findall(A + "r") or [ET.SubElement(p, A + "r")]
            for i, r in enumerate(runs):
                t = r.find(A + "t")
                t = ET.SubElement(r, A + "t") if t is None else t
                t.text = ("\n".join(lines[k:]) if k == len(ps) - 1 else lines[k] if k < len(lines) else "") if i == 0 else ""
                if lang:
                    _tagged(r, lang)
        package.changed[part] = None
        if b["source_ref"]["kind"] == "shape_text" and (limits or {}).get(b["id"], {}).get("can_shrink_font", True):
            changed.setdefault(id(shape), (shape, b, (limits or {}).get(b["id"], {})))
    for shape, b, own in changed.values():
        _fitted(shape, b, own)
    return package.saved()
