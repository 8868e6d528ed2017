"""Schemas of the localization tables, as DDL."""

from __future__ import annotations

VERSION = "0.1.0"
FONT = "struct<name:string,size:double,color:string,bold:boolean,italic:boolean,underline:boolean>"
BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
RUNS = f"array<struct<text:string,font:{FONT},lang:string>>"
LAYOUT = f"struct<slide_index:int,shape_id:bigint,page_index:int,element_id:string,position:{BOX},base_font:{FONT},wrap:boolean,autofit:string>"
REF = "struct<kind:string,slide_index:int,shape_id:bigint,paragraph_index:int,run_index:int,row:int,col:int,image_id:string,region_id:string>"
BLOCKS = f"doc_id string, ord bigint, id string, type string, semantic_role string, runs {RUNS}, source_text string, target_text string, translatable boolean, layout {LAYOUT}, source_ref {REF}"
IMAGES = "doc_id string, ord bigint, id string, media_type string, width int, height int, reset_crop_on_render boolean, content binary"
DOCUMENTS = "doc_id string, path string, doc_type string, title string, slide_width bigint, slide_height bigint, schema_version string, error string"
BLOCK_TYPES = ("title", "subtitle", "body", "shape_text", "table_cell", "heading", "paragraph", "list_item", "smartart", "image")
ROUTES = ("whole_image", "region", "skip", "reuse", "review")


def font(name=None, size=None, color=None, bold=False, italic=False, underline=False) -> dict:
    return {"name": name, "size": size, "color": color, "bold": bool(bold), "italic": bool(italic), "underline": bool(underline)}


def block(id: str, type: str, text: str, runs: list[dict], role: str | None = None, translatable: bool = True, layout: dict | None = None, **ref) -> dict:
    """A block record without its document and order."""
    where = {"kind": type, "slide_index": 0, "shape_id": 0, "paragraph_index": None, "run_index": None, "row": None, "col": None, "image_id": None, "region_id": None} | ref
    place = {"slide_index": where["slide_index"], "shape_id": where["shape_id"], "page_index": 0, "element_id": None, "position": None, "base_font": runs[0]["font"] if runs else font(), "wrap": True, "autofit": "none"}
    return {"id": id, "type": type, "semantic_role": role, "runs": runs, "source_text": text, "target_text": None, "translatable": translatable, "layout": place | (layout or {}), "source_ref": where}
