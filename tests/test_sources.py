"""Readers, sinks, folder runs and streams on small files made here."""

import io
import json
import os
import zipfile

import pytest

from docweave import run as folder_run
from docweave import sinks
from docweave.plans.prose import redacted_frame
from docweave.sources import docx, folder, pdf, xlsx
from docweave.sources.archive import Rejected, open_archive
from docweave.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def p(text, style="", extra=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/>{extra}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def word():
    body = (
        p("Раздел один", "Heading1") + p("Просто текст") + p("пункт", "", "<w:numPr/>") + p("подпись", "Подпись")
        + '<w:p><w:r><w:t>K</w:t></w:r><w:r><w:rPr><w:vertAlign w:val="subscript"/></w:rPr><w:t>ср</w:t></w:r><w:r><w:t> = A x B, где:</w:t></w:r></w:p>'
        + "<w:tbl><w:tr><w:tc>" + p("один") + p("два") + "</w:tc><w:tc>" + p("S = a ÷ 2") + "</w:tc></w:tr></w:tbl>" + p("") + p("после")
    )
    notes = '<w:footnote w:type="separator" w:id="5"><w:p><w:r><w:t>x</w:t></w:r></w:p></w:footnote><w:footnote w:id="0"><w:p/></w:footnote><w:footnote w:id="2"><w:p><w:r><w:t>note</w:t></w:r><w:r><w:t>two</w:t></w:r></w:p></w:footnote>'
    return archive({
        "word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/header1.xml": f"<w:hdr {W}>{p('колонтитул')}</w:hdr>", "word/header2.xml": f"<w:hdr {W}>{p('колонтитул')}</w:hdr>",
        "word/footnotes.xml": f"<w:footnotes {W}>{notes}</w:footnotes>", "word/media/image2.png": "x", "word/media/image1.wmf": "y",
    })


def book():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return archive({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="Лист" r:id="a"/><sheet name="Тайный" state="hidden" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="/xl/worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>имя</t></si></sst>",
        "xl/worksheets/s1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><f>1+1</f><v>2</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="A3" t="b"><v>1</v></c><c r="B3"><f>A1</f></c></row></sheetData></worksheet>',
        "xl/worksheets/s2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    })


def test_docx():
    rows = docx.units(word())
    told = [(r["type"], r["text"]) for r in rows]
    assert told[:6] == [("document", None), ("section", "Раздел один"), ("paragraph", "Просто текст"), ("list_item", "пункт"), ("caption", "подпись"), ("formula", "K_(ср) = A x B, где:")]
    assert [t for t in told if t[0].startswith("table")] == [("table", None), ("table_row", "один два | S = a ÷ 2"), ("table_cell", "один\nдва"), ("table_cell", "S = a ÷ 2")]
    assert [t for t in told if t[0] in ("header", "footnote")] == [("header", "колонтитул"), ("footnote", "note two")]
    assert [(r["type"], r["asset_ref"]) for r in rows if r.get("asset_ref")] == [("formula_image", "assets/figure_000001.wmf"), ("figure", "assets/figure_000002.png")]
    assert next(r for r in rows if r["text"] == "S = a ÷ 2")["formula"] == "S = a / 2"
    assert [r["unit_order"] for r in rows] == list(range(len(rows))) and rows[-3]["location"]
    last = [r for r in rows if r["text"] == "после"][0]
    assert last["location"].endswith("p[7]")


def test_xlsx():
    rows = xlsx.units(book())
    assert [(r["type"], r["text"], tuple(r["flags"])) for r in rows if r["type"] == "section"] == [("section", "Лист", ()), ("section", "Тайный", ("sheet_hidden",))]
    assert [(r["text"], r["formula"], tuple(r["flags"])) for r in rows if r["type"] == "table_cell"] == [("A1: имя", None, ()), ("B1: =1+1 -> 2", "=1+1", ()), ("A3: TRUE", None, ()), ("B3: =A1 -> ", "=A1", ("formula_cached_value_missing",))]
    assert sum(r["type"] == "table_row" for r in rows) == 2


def test_pdf_pages():
    rows = pdf.page_units(["Шапка\n\nтекст\nдальше\n\n1. Пункт\n\nниз", "Шапка\n\nS = a × b\n\nРис. 1 Схема\n\nниз", ""])
    assert [(r["type"], r["text"]) for r in rows if r["text"]] == [("header", "Шапка"), ("paragraph", "текст дальше"), ("paragraph", "1. Пункт"), ("footer", "низ"), ("header", "Шапка"), ("formula", "S = a × b"), ("figure", "Рис. 1 Схема"), ("footer", "низ")]


@pytest.mark.parametrize("name", ["/abs", "a\\b", "C:x", "a/../../b"])
def test_unsafe_archives(name):
    with pytest.raises(Rejected):
        open_archive(archive({name: "x"}))


def test_entities_are_refused():
    with pytest.raises(Rejected):
        docx.units(archive({"word/document.xml": f'<!DOCTYPE x [<!ENTITY a "b">]><w:document {W}><w:body/></w:document>'}))


@pytest.fixture
def files(tmp_path):
    source = tmp_path / "in"
    (source / "Приказы").mkdir(parents=True)
    (source / "a.docx").write_bytes(word())
    (source / "Приказы" / "A.DOCX").write_bytes(word())
    (source / "b.xlsx").write_bytes(book())
    (source / "bad.docx").write_bytes(b"no archive")
    (source / "note.txt").write_text("x")
    (source / "~$a.docx").write_text("lock")
    return source


def test_folder_run(spark, files, tmp_path):
    manifest, units = folder_run.convert(spark, str(files))
    got = {r.relative_path: r for r in manifest.collect()}
    assert {k: r.status for k, r in got.items()} == {"a.docx": "success", "Приказы/A.DOCX": "skipped_duplicate", "b.xlsx": "success", "bad.docx": "failed", "note.txt": "skipped_unsupported"}
    assert got["Приказы/A.DOCX"].duplicate_of == "a.docx" and "BadZipFile" in got["bad.docx"].error and got["note.txt"].error == "unsupported_suffix"
    assert {r.path for r in units.select("path").distinct().collect()} == {"a.docx", "b.xlsx"}
    out = tmp_path / "out"
    out.mkdir()
    target = folder_run.allocate(str(out))
    summary = folder_run.write(manifest, units, target, {"MY_TOKEN": "Просто"})
    assert summary["status"] == "partial_success" and summary["counts"]["failed"] == 1
    texts = [r.text for r in spark.read.json(f"{target}/units").collect()]
    assert "[REDACTED_ENV:MY_TOKEN] текст" in texts and spark.read.json(f"{target}/chunks").count() > 1
    again, more = folder_run.convert(spark, str(files), manifest)
    assert {r.relative_path for r in again.where("resumed").collect()} == {"a.docx", "b.xlsx"} and more.count() == 0


def test_run_folders_and_command_line(tmp_path, capsys):
    from datetime import UTC, datetime

    now = datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC)
    assert [os.path.basename(folder_run.allocate(str(tmp_path), now)) for _ in range(3)] == ["20260102T030405Z", "20260102T030405Z-001", "20260102T030405Z-002"]
    with pytest.raises(ValueError):
        folder_run.safe_folders(str(tmp_path), str(tmp_path / "x"))
    assert folder_run.main(["evaluate-formula", "y = a / b + 2 ** 3", "a=1,5", "b=3"]) == 0
    assert json.loads(capsys.readouterr().out)["data"] == {"target": "y", "value": 8.5}
    assert folder_run.main(["evaluate-formula", "y = a / b", "a=1"]) == 1 and json.loads(capsys.readouterr().out)["data"] == {"missing": ["b"]}
    assert folder_run.main(["evaluate-formula", "y = a / b", "a=1", "b=0"]) == 1
    assert folder_run.main(["evaluate-formula", "__import__('os')"]) == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", None), (2, None, "x")], "n int, t string, u string")
    sinks.json_lines(df, str(tmp_path / "j"), {"n": "n > 0"})
    lines = sorted(line for f in os.listdir(tmp_path / "j") if f.endswith(".json") for line in (tmp_path / "j" / f).read_text().splitlines())
    assert lines == ['{"n":1,"t":"a","u":null}', '{"n":2,"t":null,"u":"x"}']
    with pytest.raises(Exception, match="contract broken: n"):
        sinks.json_lines(df, str(tmp_path / "k"), {"n": "n > 1"})
    with pytest.raises(ValueError):
        sinks.catalog(df, str(tmp_path / "c"), ("json", "none"))
    with pytest.raises(ValueError):
        sinks.register_writer("json", lambda d, p: None)


def test_redaction_at_any_depth(spark):
    df = spark.createDataFrame([({"k": "secret-one"}, [("long secret-one", None)], None, 5)], "m map<string,string>, a array<struct<x:string,y:string>>, s struct<z:string>, n int")
    r = redacted_frame(df, {"A_TOKEN": "secret-one", "B_SECRET": "long secret-one", "C_TOKEN": "abc", "NAME": "k"}).first()
    assert r.m == {"k": "[REDACTED_ENV:A_TOKEN]"} and r.a[0].x == "[REDACTED_ENV:B_SECRET]" and r.a[0].y is None and r.s is None and r.n == 5


def test_files_are_taken_in_once(spark, tmp_path):
    at = str(tmp_path)
    schema = "sha256 string, relative_path string"
    for i, rows in enumerate(([("1", "a"), ("1", "a"), ("2", "b")], [("1", "a"), ("1", "c")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/in/{i}")
        stream = events.read(spark, f"{at}/in/*", spark.createDataFrame([], schema).schema)
        events.take_in(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    assert sorted((r.sha256, r.relative_path) for r in spark.read.parquet(f"{at}/table").collect()) == [("1", "a"), ("1", "c"), ("2", "b")]
