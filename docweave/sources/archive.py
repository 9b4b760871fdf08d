"""Admission of zip archives before anything of them is read."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

#: Most entries of an archive, and most bytes they may unpack to.
MAX_ENTRIES, MAX_BYTES = 4096, 128 << 20


class Rejected(ValueError):
    """The archive isn't safe to read."""


def open_archive(content: bytes) -> zipfile.ZipFile:
    """The archive, if its entries are few and small enough and all stay inside it."""
    z = zipfile.ZipFile(io.BytesIO(content))
    entries = z.infolist()
    if len(entries) > MAX_ENTRIES or sum(e.file_size for e in entries) > MAX_BYTES:
        raise Rejected("archive_too_large")
    for e in entries:
        name = e.orig_filename
        if name.startswith("/") or "\\" in name or re.match("[A-Za-z]:", name) or ".." in name.split("/"):
            raise Rejected("unsafe_entry")
    return z


def xml(z: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    """The parsed part, or None where the archive has none. Parts that declare entities are refused."""
    if name not in z.namelist():
        return None
    raw = z.read(name)
    if b"<!DOCTYPE" in raw or b"<!ENTITY" in raw:
        raise Rejected("xml_with_entities")
    return ElementTree.fromstring(raw)


def local(tag: str) -> str:
    """A tag without its namespace."""
    return tag.rpartition("}")[2]


def attribute(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if local(k) == name), None)
