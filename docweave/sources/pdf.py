"""Text of PDF pages as units. Needs the optional package pypdf; without it the files of this route fail with a clear error."""

from __future__ import annotations

import io
import re

from docweave.sources.docx import _Units, looks_like_formula

_NUMBERED = re.compile(r"^\d+(\.\d+)*[.)]?\s+\S")
_CAPTION = re.compile(r"^(рис\.|рисунок|figure)\s", re.I)


def pages(content: bytes) -> list[str]:
    try:
        import pypdf
    except ImportError as x:
        raise RuntimeError("pdf_reader_unavailable") from x
    reader = pypdf.PdfReader(io.BytesIO(content))
    return [p.extract_text() or "" for p in reader.pages]


def paragraphs(text: str) -> list[str]:
    """Lines joined to paragraphs: a blank line or a numbered beginning starts a new one."""
    out: list[list[str]] = [[]]
    for line in map(str.strip, text.split("\n")):
        if not line or (_NUMBERED.match(line) and out[-1]):
            out.append([])
        if line:
            out[-1].append(line)
    return [" ".join(p) for p in out if p]


def page_units(texts: list[str]) -> list[dict]:
    """Pages as units. The first or last paragraph of a page that stands so on two pages or more is a header or footer."""
    parts = [paragraphs(t) for t in texts]
    firsts, lasts = [p[0] for p in parts if p], [p[-1] for p in parts if p]
    heads, feet = ({t for t in edge if edge.count(t) > 1} for edge in (firsts, lasts))
    out = _Units()
    root = out.add("document", None)
    for number, own in enumerate(parts, 1):
        page = out.add("page", root, None, page=number)
        for i, text in enumerate(own):
            if i == 0 and text in heads:
                kind, flags = "header", ["repeated_edge_block"]
            elif i == len(own) - 1 and text in feet:
                kind, flags = "footer", ["repeated_edge_block"]
            elif _CAPTION.match(text):
                kind, flags = "figure", ["semantic_structure_inferred"]
            elif looks_like_formula(text):
                kind, flags = "formula", ["semantic_structure_inferred"]
            else:
                kind, flags = "paragraph", []
            out.add(kind, page, text, flags=flags, page=number)
    return out.rows


def units(content: bytes) -> list[dict]:
    return page_units(pages(content))
