"""Workbooks as units: a section and a table per sheet, rows, and cells that hold anything."""

from __future__ import annotations

import posixpath

from docweave.sources.archive import attribute, local, open_archive, xml
from docweave.sources.docx import _Units


def _shared(z) -> list[str]:
    part = xml(z, "xl/sharedStrings.xml")
    return ["".join(t.text or "" for t in item.iter() if local(t.tag) == "t") for item in part if local(item.tag) == "si"] if part is not None else []


def _sheets(z) -> list[tuple[str, str, bool]]:
    """Name, part and whether it is hidden, of each sheet in order."""
    book, links = xml(z, "xl/workbook.xml"), xml(z, "xl/_rels/workbook.xml.rels")
    if book is None:
        raise ValueError("no workbook")
    targets = {attribute(r, "Id"): attribute(r, "Target") or "" for r in links} if links is not None else {}
    out = []
    for s in (e for e in book.iter() if local(e.tag) == "sheet"):
        own = next((v for k, v in s.attrib.items() if k.endswith("}id")), None)
        target = targets.get(own, "")
        out.append((s.get("name") or "", target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target)), s.get("state") in ("hidden", "veryHidden")))
    return out


def cell_value(cell, shared: list[str]) -> tuple[str | None, str | None]:
    """Value as text and formula of a cell; booleans are TRUE and FALSE."""
    kind = cell.get("t")
    raw = next((c.text for c in cell if local(c.tag) == "v"), None)
    formula = next((c.text for c in cell if local(c.tag) == "f"), None)
    if kind == "inlineStr":
        raw = "".join(t.text or "" for t in cell.iter() if local(t.tag) == "t")
    elif kind == "s" and raw is not None:
        raw = shared[int(raw)]
    elif kind == "b" and raw is not None:
        raw = "TRUE" if raw.strip() == "1" else "FALSE"
    return raw, formula


def search_text(address: str, value: str | None, formula: str | None) -> str:
    shown = f"={formula.lstrip('=')} -> {value or ''}" if formula else value or ""
    return f"{address}: {shown}"


def units(content: bytes) -> list[dict]:
    """All units of a workbook; a formula without a cached value keeps its cell, with a flag."""
    z = open_archive(content)
    shared = _shared(z)
    out = _Units()
    root = out.add("document", None)
    for name, part, hidden in _sheets(z):
        section = out.add("section", root, name, f"/{part}", ["sheet_hidden"] if hidden else [])
        sheet = xml(z, part)
        rows = [r for r in sheet.iter() if local(r.tag) == "row"] if sheet is not None else []
        table = None
        for row in rows:
            cells = [(c.get("r") or "", *cell_value(c, shared)) for c in row if local(c.tag) == "c"]
            cells = [c for c in cells if c[1] not in (None, "") or c[2]]
            if not cells:
                continue
            table = table or out.add("table", section, None, f"/{part}/sheetData", ["spreadsheet_table_inferred"])
            rid = out.add("table_row", table, " | ".join(c[1] or "" for c in cells), f"/{part}/row[{row.get('r')}]")
            for address, value, formula in cells:
                out.add("table_cell", rid, search_text(address, value, formula), f"/{part}/{address}", ["formula_cached_value_missing"] if formula and value in (None, "") else [], address=address, formula=formula and "=" + formula.lstrip("="))
    return out.rows
