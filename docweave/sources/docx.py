"""Word documents as units: body blocks in their order, tables with rows and cells, headers and footers, footnotes, media."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree.ElementTree import Element

from docweave.functions import formulas as fx
from docweave.sources.archive import attribute, local, open_archive, xml

# Signs of a formula line, the longest one, words of style names.
_SIGNS = re.compile(r"(^|\s)[A-Za-zА-Яа-я][\wА-Яа-я]*\s*=|[=∑√≤≥±×÷≈]|\b(sum|sqrt|frac)\b", re.I)
FORMULA_CHARS = 180
_STYLES = (("section", ("heading", "заголов")), ("caption", ("caption", "подпись")))


def looks_like_formula(text: str) -> bool:
    return len(text.strip()) <= FORMULA_CHARS and bool(_SIGNS.search(text))


def _children(e: Element, name: str) -> Iterator[Element]:
    return (c for c in e if local(c.tag) == name)


def _first(e: Element | None, *names: str) -> Element | None:
    for name in names:
        e = None if e is None else next(_children(e, name), None)
    return e


def run_text(run: Element) -> str:
    """The run's text with tabs and line breaks; lower and upper parts in brackets with their sign."""
    text = "".join({"t": c.text or "", "tab": "\t", "br": "\n"}.get(local(c.tag), "") for c in run)
    place = _first(run, "rPr", "vertAlign")
    sign = {"subscript": "_", "superscript": "^"}.get(attribute(place, "val") or "") if place is not None else None
    return f"{sign}({text})" if sign and text else text


def paragraph_text(p: Element) -> str:
    """Runs, also those inside links, in order; mathematics by its letters."""
    parts = []
    for c in p:
        kind = local(c.tag)
        if kind == "r":
            parts.append(run_text(c))
        elif kind in ("hyperlink", "ins", "smartTag"):
            parts += [run_text(r) for r in c.iter() if local(r.tag) == "r"]
        elif kind in ("oMath", "oMathPara"):
            parts += [t.text or "" for t in c.iter() if local(t.tag) == "t"]
    return "".join(parts).strip()


def paragraph_type(p: Element, text: str) -> str:
    """A formula by its mathematics or signs, else what the style says, else a list item by its numbering."""
    if any(local(e.tag) in ("oMath", "oMathPara") for e in p.iter()) or looks_like_formula(text):
        return "formula"
    style = _first(p, "pPr", "pStyle")
    name = (attribute(style, "val") or "").strip().lower() if style is not None else ""
    for kind, marks in _STYLES:
        if any(m in name for m in marks):
            return kind
    return "list_item" if _first(p, "pPr", "numPr") is not None or name.startswith("list") else "paragraph"


def _flags(kind: str) -> list[str]:
    return [] if kind == "paragraph" else ["semantic_structure_inferred"] if kind == "formula" else ["semantic_style_inferred"]


class _Units:
    """Units with running numbers and ids."""

    def __init__(self) -> None:
        self.rows: list[dict] = []

    def add(self, kind: str, parent: str | None, text: str | None = None, location: str = "", flags: list[str] | None = None, **more) -> str:
        uid = f"u_{len(self.rows):06d}"
        self.rows.append({"unit_id": uid, "parent_id": parent, "type": kind, "unit_order": len(self.rows), "text": text, "location": location, "flags": flags or [], **more})
        return uid


def _formula(text: str) -> str | None:
    said = fx.calculation(text)
    return said[0] if said else None


def _table(e: Element, out: _Units, root: str, place: str) -> None:
    table = out.add("table", root, location=place)
    for i, row in enumerate(_children(e, "tr"), 1):
        cells = ["\n".join(filter(None, (paragraph_text(p) for p in cell.iter() if local(p.tag) == "p"))) for cell in _children(row, "tc")]
        rid = out.add("table_row", table, " | ".join(c.replace("\n", " ") for c in cells), f"{place}/tr[{i}]")
        for j, text in enumerate(cells, 1):
            stated = next((line for line in map(str.strip, text.split("\n")) if line and looks_like_formula(line)), None)
            out.add("table_cell", rid, text, f"{place}/tr[{i}]/tc[{j}]", formula=stated and _formula(stated))


def units(content: bytes) -> list[dict]:
    """All units of a document; paragraphs and tables are numbered apart, equal headers and footers count once."""
    z = open_archive(content)
    body = _first(xml(z, "word/document.xml"), "body")
    if body is None:
        raise ValueError("no document body")
    out = _Units()
    root = out.add("document", None)
    paragraphs = tables = 0
    for block in body:
        if local(block.tag) == "p":
            paragraphs += 1
            text = paragraph_text(block)
            if text:
                kind = paragraph_type(block, text)
                out.add(kind, root, text, f"/word/document.xml/body/p[{paragraphs}]", _flags(kind), formula=_formula(text) if kind == "formula" else None)
        elif local(block.tag) == "tbl":
            tables += 1
            _table(block, out, root, f"/word/document.xml/body/tbl[{tables}]")
    seen = set()
    for name in sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n)):
        kind, part = "header" if "header" in name else "footer", xml(z, name)
        for p in part.iter() if part is not None else ():
            text = paragraph_text(p) if local(p.tag) == "p" else ""
            if text and (kind, text) not in seen:
                seen.add((kind, text))
                out.add(kind, root, text, f"/{name}")
    notes = xml(z, "word/footnotes.xml")
    for note in _children(notes, "footnote") if notes is not None else ():
        if attribute(note, "type") is None and attribute(note, "id") not in (None, "", "-1", "0"):
            text = " ".join(filter(None, (run_text(r).strip() for r in note.iter() if local(r.tag) == "r")))
            if text:
                out.add("footnote", root, text, f"/word/footnotes.xml/footnote[{attribute(note, 'id')}]")
    for i, name in enumerate(sorted(n for n in z.namelist() if n.startswith("word/media/") and not n.endswith("/")), 1):
        suffix = name.rpartition(".")[2].lower()
        kind = "formula_image" if suffix in ("wmf", "emf") else "figure"
        out.add(kind, root, None, f"/{name}", _flags(kind), asset_ref=f"assets/figure_{i:06d}.{suffix}")
    return out.rows
