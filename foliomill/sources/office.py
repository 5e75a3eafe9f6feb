"""Text of office files from their zip members, with the standard library alone. Each parser takes bytes."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree as ET

from ..operators.tables import markdown_table


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _attr(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _texts(e: ET.Element, leaf: str = "t", glue: str = "") -> str:
    return glue.join(x.text or "" for x in e.iter() if _tag(x) == leaf)


def _number(name: str) -> int:
    m = re.search(r"(\d+)\.xml$", name)
    return int(m.group(1)) if m else 0


def _grid(table: ET.Element) -> tuple[list[list[str]], bool]:
    """Rows of a word table, and whether its first row has a spanning cell. A cell over several columns is followed by blanks, one
    over several rows shows its text in each."""
    rows: list[list[str]] = []
    spans = False
    for tr in (x for x in table if _tag(x) == "tr"):
        row: list[str] = []
        for tc in (x for x in tr if _tag(x) == "tc"):
            marks = {_tag(x): _attr(x, "val") for x in tc.iter() if _tag(x) in ("gridSpan", "vMerge")}
            span = int(marks.get("gridSpan") or 1)
            text = " ".join(filter(None, (_texts(p).strip() for p in tc if _tag(p) == "p")))
            if "vMerge" in marks and marks["vMerge"] != "restart" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            spans |= not rows and span > 1
            row += [text, *[""] * (span - 1)]
        rows.append(row)
    wide = max((len(r) for r in rows), default=0)
    return [r + [""] * (wide - len(r)) for r in rows], spans


def header_label(header: list[str]) -> str:
    """A table's columns in short: the first five that aren't empty, 20 characters of each."""
    return " | ".join([c.replace("\n", " ")[:20] for c in header if c][:5])


def docx(content: bytes) -> dict:
    """Paragraphs and tables in body order, joined by empty lines; tables as markdown. A first row with spanning cells or one
    distinct text over several columns is the table's title. table_headers has each table's label."""
    root = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    parts, labels = [], []
    body = next(e for e in root.iter() if _tag(e) == "body")
    for e in body:
        if _tag(e) == "p" and (t := _texts(e).strip()):
            parts.append(t)
        elif _tag(e) == "tbl":
            rows, spans = _grid(e)
            if rows and rows[0]:
                texts = [c for c in dict.fromkeys(rows[0]) if c]
                if len(rows) > 1 and texts and (spans or (len(texts) == 1 and len(rows[0]) > 1)):
                    parts.append(" ".join(texts))
                    rows = rows[1:]
                labels.append(header_label(rows[0]))
                parts.append(markdown_table(rows[0], rows[1:]))
    return {"text": "\n\n".join(parts), "type": "word", "table_count": len(labels), "table_headers": labels}


def xlsx(content: bytes, most_rows: int = 500) -> dict:
    """All sheets as markdown tables under their names; empty sheets are left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    names = set(z.namelist())
    shared = [_texts(si) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
    titles = [_attr(e, "name") or "" for e in ET.fromstring(z.read("xl/workbook.xml")).iter() if _tag(e) == "sheet"]
    parts = []
    for k, member in enumerate(sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=_number)):
        rows = []
        for r in (e for e in ET.fromstring(z.read(member)).iter() if _tag(e) == "row"):
            row: dict[int, str] = {}
            for c in (e for e in r if _tag(e) == "c"):
                at = 0
                for ch in re.match(r"[A-Z]*", _attr(c, "r") or "").group():
                    at = at * 26 + ord(ch) - 64
                v = next((e.text or "" for e in c if _tag(e) == "v"), "")
                kind = _attr(c, "t")
                row[at or len(row) + 1] = shared[int(v)] if kind == "s" and v else _texts(c) if kind == "inlineStr" else v
            rows.append([row.get(i, "") for i in range(1, max(row, default=0) + 1)])
        rows = [r for r in rows if any(r)][: most_rows + 1]
        if rows:
            wide = max(map(len, rows))
            rows = [r + [""] * (wide - len(r)) for r in rows]
            parts.append(f"## {titles[k] if k < len(titles) else member}\n\n{markdown_table(rows[0], rows[1:])}")
    return {"text": "\n\n".join(parts), "type": "excel", "table_count": len(parts)}


def pptx(content: bytes) -> dict:
    """Slides in order: a paragraph's runs without separator, table cells parted by bars; slides with a title alone are left out."""
    z = zipfile.ZipFile(io.BytesIO(content))
    parts = []
    for k, member in enumerate(sorted((n for n in z.namelist() if re.match(r"ppt/slides/slide\d+\.xml$", n)), key=_number), 1):
        root = ET.fromstring(z.read(member))
        lines = []
        for shape in (e for e in root.iter() if _tag(e) in ("sp", "graphicFrame")):
            for tr in (e for e in shape.iter() if _tag(e) == "tr"):
                lines.append(" | ".join(_texts(tc).strip() for tc in tr if _tag(tc) == "tc"))
            if _tag(shape) == "sp":
                lines += [t for p in shape.iter() if _tag(p) == "p" and (t := _texts(p).strip())]
        if len(lines) > 1:
            parts.append(f"## Slide {k}\n" + "\n".join(lines))
    return {"text": "\n\n".join(parts), "type": "ppt", "table_count": 0}


def xmind(content: bytes) -> dict:
    """The topic tree as headings, at most six levels deep; both the JSON and the XML form."""
    z = zipfile.ZipFile(io.BytesIO(content))
    lines: list[str] = []

    def walk(topic: dict, depth: int) -> None:
        if topic.get("title"):
            lines.append("#" * min(depth + 1, 6) + " " + topic["title"])
        for group in (topic.get("children") or {}).values():
            for child in group:
                walk(child, depth + 1)

    def walk_xml(e: ET.Element, depth: int) -> None:
        title = next((x.text for x in e if _tag(x) == "title"), None)
        if title:
            lines.append("#" * min(depth + 1, 6) + " " + title)
        for c in (x for x in e if _tag(x) == "children"):
            for t in (x for x in c.iter() if _tag(x) == "topics"):
                for child in (x for x in t if _tag(x) == "topic"):
                    walk_xml(child, depth + 1)

    if "content.json" in z.namelist():
        for sheet in json.loads(z.read("content.json")):
            walk(sheet.get("rootTopic") or {}, 0)
    else:
        for sheet in (e for e in ET.fromstring(z.read("content.xml")) if _tag(e) == "sheet"):
            for t in (x for x in sheet if _tag(x) == "topic"):
                walk_xml(t, 0)
    return {"text": "\n".join(lines), "type": "xmind", "table_count": 0}


def vsdx(content: bytes) -> dict:
    """Texts of the pages' shapes, a line each."""
    z = zipfile.ZipFile(io.BytesIO(content))
    lines = []
    for member in sorted((n for n in z.namelist() if re.search(r"(?:^|/)(?:document|page\d+)\.xml$", n)), key=_number):
        for e in ET.fromstring(z.read(member)).iter():
            if _tag(e) in ("Text", "t") and (t := "".join(e.itertext()).strip()):
                lines.append(t)
    return {"text": "\n".join(lines), "type": "vsdx", "table_count": 0}


def docx_images(content: bytes) -> list[tuple[str, bytes]]:
    """(member, bytes) of the images a document refers to."""
    z = zipfile.ZipFile(io.BytesIO(content))
    return [(n, z.read(n)) for n in sorted(z.namelist()) if n.startswith("word/media/")]


def image_block(descriptions: list[str]) -> str:
    """What follows a text that has images: a numbered line each."""
    return "\n\n---\n图片内容:\n" + "\n\n".join(f"[图片{k}: {d}]" for k, d in enumerate(descriptions, 1)) if descriptions else ""


def upload_name(name: str) -> str:
    """A safe file name: one with Han characters keeps its letters, of any other only ASCII word characters, dots and dashes stay."""
    base = re.split(r"[\\/]", name)[-1]
    if re.search("[\u4e00-\u9fff]", base):
        return base
    return re.sub(r"[^A-Za-z0-9_.-]+", "_", base).strip("._") or "file"


PARSERS = {".docx": docx, ".xlsx": xlsx, ".pptx": pptx, ".xmind": xmind, ".vsdx": vsdx}
