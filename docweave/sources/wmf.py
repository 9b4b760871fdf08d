"""Text drawn in Windows metafiles: a walk over the records, with the fonts that are selected as text is put out."""

from __future__ import annotations

import struct

# Fixed values (the public metafile format): magic of a placeable file, functions of records, flags that bring a rectangle.
PLACEABLE = 0x9AC6CDD7
FONT, SELECT, DELETE, TEXT, EXTENDED_TEXT = 0x02FB, 0x012D, 0x01F0, 0x0521, 0x0A32
OTHER_OBJECTS = frozenset((0x02FA, 0x02FC, 0x00F7, 0x01F9, 0x06FF, 0x0142))
RECTANGLE = 0x0006
#: Most bytes of a file, and most records that are walked.
MAX_BYTES, MAX_RECORDS = 8 << 20, 20_000
#: Signs of the symbol font by their bytes.
SYMBOLS = {0xB4: "×", 0xB8: "÷", 0xB1: "±", 0xA3: "≤", 0xB3: "≥", 0xB9: "≠", 0xBB: "≈", 0xE5: "∑", 0xD5: "∏", 0xD6: "√", 0xF2: "∫", 0xD7: "·", 0xA5: "∞", 0x2D: "−", 0x53: "Σ", 0x44: "Δ", 0x61: "α", 0x62: "β", 0x67: "γ", 0x6C: "λ", 0x6D: "μ", 0x70: "π", 0x73: "σ"}
SYMBOL_CHARSET, RUSSIAN_CHARSET = 2, 204


def decode(raw: bytes, charset: int, face: str) -> str:
    """Bytes of drawn text by their font: the symbol font, the Russian code page, else Latin."""
    if charset == SYMBOL_CHARSET or face.strip().lower() == "symbol":
        return "".join(SYMBOLS.get(b, chr(b)) for b in raw)
    return raw.decode("cp1251" if charset == RUSSIAN_CHARSET else "latin-1", "replace")


def _text(function: int, body: bytes) -> bytes:
    if function == TEXT:
        n = struct.unpack_from("<H", body)[0]
        return body[2 : 2 + n]
    n, options = struct.unpack_from("<HH", body, 4)
    at = 8 + (8 if options & RECTANGLE else 0)
    return body[at : at + n]


def chunks(content: bytes) -> list[dict]:
    """chunk_order, text, face, charset and height of every text that is put out, in order; empty for what is no metafile."""
    if not 18 <= len(content) <= MAX_BYTES:
        return []
    at = 22 if struct.unpack_from("<I", content)[0] == PLACEABLE else 0
    if len(content) < at + 18:
        return []
    at += 2 * struct.unpack_from("<H", content, at + 2)[0]
    objects: list[tuple[str, int, int] | str | None] = []
    font, out = ("", 1, 0), []
    for _ in range(MAX_RECORDS):
        if at + 6 > len(content):
            break
        size, function = struct.unpack_from("<IH", content, at)
        if function == 0 or size < 3 or at + 2 * size > len(content):
            break
        body = content[at + 6 : at + 2 * size]
        at += 2 * size
        if function == FONT or function in OTHER_OBJECTS:
            made: tuple[str, int, int] | str = "other"
            if function == FONT and len(body) >= 18:
                made = (body[18:].split(b"\0")[0].decode("latin-1"), body[13], struct.unpack_from("<h", body)[0])
            free = next((i for i, o in enumerate(objects) if o is None), None)
            if free is None:
                objects.append(made)
            else:
                objects[free] = made
        elif function in (SELECT, DELETE) and len(body) >= 2:
            which = struct.unpack_from("<H", body)[0]
            if which < len(objects):
                if function == DELETE:
                    objects[which] = None
                elif isinstance(objects[which], tuple):
                    font = objects[which]
        elif function in (TEXT, EXTENDED_TEXT) and len(body) >= (2 if function == TEXT else 8):
            text = decode(_text(function, body), font[1], font[0])
            if text:
                out.append({"chunk_order": len(out), "text": text, "face": font[0], "charset": font[1], "height": font[2]})
    return out


def is_formula(name: str, content: bytes) -> bool:
    """Only metafiles by name that an equation editor marked."""
    return name.lower().endswith(".wmf") and b"MathType" in content
