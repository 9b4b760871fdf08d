"""Queries do the whole job: rows that a filter, a prefix or a projection used to lose."""

import pytest

import __spark_entry__ as entry

UNITS = "document_id string, unit_id string, type string, unit_order int, text string, source_ref struct<page:int>"


@pytest.fixture
def run(spark, tmp_path):
    def rows(name, table, data, schema):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / f"{table}.parquet"))
        return [r.asDict() for r in entry.queries()[name](spark, str(tmp_path)).collect()]

    return rows


def test_search_text_keeps_units_without_page(run):
    data = [
        ("docx", "u1", "paragraph", 1, "b", None), ("docx", "u0", "paragraph", 0, "a", None), ("docx", "u0", "paragraph", 0, "a", None),
        ("docx", "u9", "paragraph", 5000, "c", (None,)), ("docx", "h", "header", 2, "head", None), ("docx", "n", "paragraph", None, "first", None), ("docx", "e", "paragraph", 3, "", None),
        ("pdf", "v0", "paragraph", 4095, "p", (1,)), ("pdf", "v1", "paragraph", 4096, "q", (1,)), ("pdf", "v2", "paragraph", 4097, "r", (2,)), ("pdf", "v3", "paragraph", 4098, "s", None),
    ]
    got = {(r["document_id"], r["page"], r["stretch"]): r["search_text"] for r in run("search_text", "document_units", data, UNITS)}
    assert got == {("docx", None, 0): "first\n\na\n\nb", ("docx", None, 1): "c", ("pdf", 1, 0): "p\n\nq", ("pdf", 2, 0): "r", ("pdf", None, 1): "s"}


def test_block_ordinals_run_through_the_document(run, monkeypatch):
    monkeypatch.setattr("docweave.operators.ordered.STRETCH", 2)
    units = [("p0", "paragraph", 0, None), ("t0", "table", 1, (1,)), ("p1", "paragraph", 2, (1,)), ("s", "section", 3, (1,)), ("p2", "paragraph", 4, (2,)), ("t1", "table_cell", 5, None), ("p3", "paragraph", 6, None)]
    data = [(doc, u, t, o, "x", p) for doc in ("a", "b") for u, t, o, p in [*units, units[0]]]
    got = {(r["document_id"], r["unit_id"]): (r["kind"], r["ordinal"]) for r in run("block_ordinals", "document_units", data, UNITS)}
    numbered = {"p0": ("paragraph", 1), "p1": ("paragraph", 2), "p2": ("paragraph", 3), "p3": ("paragraph", 4), "t0": ("table", 1), "t1": ("table", 2)}
    assert got == {(doc, u): n for doc in ("a", "b") for u, n in numbered.items()}


def test_ordered_distinct_reads_the_whole_text(run):
    texts = ["a b a  c", "", " ".join(f"w{i % 300}" for i in range(900)), "x" * 199 + "yz tail", None]
    got = {r["doc_id"]: r["words"] for r in run("ordered_distinct", "documents", list(enumerate(texts)), "doc_id long, text string")}
    assert got == {i: " ".join(dict.fromkeys(t.split(" "))) for i, t in enumerate(texts) if t is not None}


def test_provenance_and_warnings_of_formulas_are_kept(run):
    schema = """document_id string, units array<struct<unit_id:string, formula:struct<linear_text:string,
    provenance:struct<parser_path:string, normalization:string, confidence_basis:string>, warnings:array<string>>>>"""
    units = [("u1", (None, ("omml", None, None), None)), ("u2", ("x", None, ["w", None, "w"])), None, ("u3", ("y", (None, None, None), [])), ("u4", None), ("u5", (None, (None, "", "rule"), ["v"]))]
    data = [("a", units), ("b", None), ("c", units[:1])]
    rows = sorted(tuple(r.values()) for r in run("p1_provenance", "packages", data, schema))
    assert [r[:2] for r in rows] == [("a", "u1"), ("a", "u5"), ("c", "u1")] and rows[0][2:] == ("omml", None, None) and rows[1][2:] == (None, "", "rule")


def test_warnings_of_formulas_are_rows(run):
    schema = "document_id string, units array<struct<unit_id:string, formula:struct<linear_text:string, warnings:array<string>>>>"
    data = [("a", [("u0", None), ("u1", ("x", ["w", None, "w"])), ("u2", ("y", []))]), ("b", [None, ("u1", (None, ["v"]))])]
    got = {(r["document_id"], r["unit_id"], r["position"]): r["warning"] for r in run("p1_warnings", "packages", data, schema)}
    assert got == {("a", "u1", 0): "w", ("a", "u1", 1): None, ("a", "u1", 2): "w", ("b", "u1", 0): "v"}


def test_types_and_dates_are_sought_in_lines(run):
    far = "x" * 90
    texts = [f"{far}\nФЕДЕРАЛЬНЫЙ   ЗАКОН\nо связи", f"{far}\nметодика\nПисьмо № 5 от 01.02.2013", "Министерство\nСП 5", "Спор\nуказы", "\n".join([f"{far}{i}" for i in range(31)] + ["Приказ 03.04.2015"]), f"{far}\nOrder 7 of 05.06.2014", "утро\n1. приказ", ""]
    got = {r["doc_id"]: (r["kind"], r["label"]) for r in run("document_type", "documents", list(enumerate(texts)), "doc_id long, text string")}
    assert got == {
        0: ("unknown", "федеральный закон"), 1: ("method", "методика"), 2: ("unknown", "свод правил"), 3: ("unknown", "unknown"), 4: ("unknown", "unknown"), 5: ("order", "unknown"),
        6: ("order", "приказ"), 7: ("unknown", "unknown"),
    }


def test_dates_are_sought_in_lines(run):
    far = "x" * 90
    texts = [f"{far}\nПисьмо № 5 от 01.02.2013", "\n".join([f"{far}{i}" for i in range(31)] + ["Приказ 03.04.2015"]), f"05.06.2014\n{far}\nnote\nOrder 01.01.2001"]
    got = {r["doc_id"]: (r["number"], r["dated"] and str(r["dated"])) for r in run("header_type", "documents", list(enumerate(texts)), "doc_id long, text string")}
    assert got == {0: ("5", "2013-02-01"), 1: (None, None), 2: (None, "2014-06-05")}


def test_every_addressed_cell_has_an_outcome(run):
    values = ["5%", "1e5", "12 м", "??????", "1,5", "\t7\u00a0", "1d", "0x1p3", "1_000", "-inf", ".5", "5.", "1__0", "\n", "", None, "1 000", "TRUE", "Óñò"]
    schema = "document_id string, unit_id string, cell struct<address:string, value:string>"
    got = {int(r["unit_id"]): (r["number"], r["outcome"]) for r in run("numeric_coerce", "document_units", [("d", str(i), ("A1", v)) for i, v in enumerate(values)] + [("d", "99", (None, "1"))], schema)}

    def want(v):
        if v is None or not v.strip():
            return None, "empty"
        try:
            return float(v.strip().replace(",", ".")), "ok"
        except ValueError:
            return None, "not_a_number"

    assert got == {i: want(v) for i, v in enumerate(values)}


def test_chunks_follow_sections_and_size(run):
    long, schema = "x" * 1190, "document_id string, unit_id string, type string, unit_order int, text string, asset_ref string, source_ref struct<page:int>"
    units = [
        ("a", "u0", "paragraph", 0, " before ", None, (2,)), ("a", "u1", "section", 1, " S1 ", None, (1,)), ("a", "u2", "paragraph", 2, long, "img", (3,)), ("a", "u3", "header", 3, "123456", "img", (1,)), ("a", "u4", "footnote", 4, "no", None, None),
        ("a", "u5", "paragraph", 5, "y" * 2000, None, None), ("a", "u6", "paragraph", 6, "  ", None, None), ("a", "u7", "section", 7, " ", None, None), ("a", "u8", "figure", 8, "fig", None, None), (None, "n", "paragraph", 1, "z", None, None), ("b", "u", "paragraph", None, "one", None, None),
    ]
    got = {(r["document_id"], r["chunk_id"]): (r["unit_refs"], r["section_path"], len(r["text"]), r["pages"], r["asset_refs"]) for r in run("chunks", "document_units", units + units[:2], schema)}
    assert got == {
        ("a", "c_000001"): ("u0", "", 6, "2", ""), ("a", "c_000002"): ("u1 u2", "S1", 1194, "1 3", "img"), ("a", "c_000003"): ("u3", "S1", 6, "1", "img"), ("a", "c_000004"): ("u5", "S1", 2000, "", ""),
        ("a", "c_000005"): ("u8", "S1", 3, "", ""), ("b", "c_000001"): ("u", "", 3, "", ""),
    }


def test_tables_are_read_from_text(run):
    text = "Name  Sum  Note\none  1\ntail\ntwo  2  a  b\nsix  7  8\n\n"
    rows = [("d", "t", "table", 1, text, None), ("d", "p", "paragraph", 2, "plain text", None), ("d", "l", "paragraph", 3, "1.  a first item of some length\n2.  another item of some length", None), ("d", "e", "table", 4, None, None)]
    got = {r["unit_id"]: (r["width"], r["rows_"], r["structure_warning"], r["grid"]) for r in run("table_parse", "document_units", rows, UNITS)}
    assert got["t"] == (3, 4, True, "Name | Sum | Note\none | 1 | \ntail\ntwo | 2 | a b\nsix | 7 | 8") and set(got) == {"t", "l"}
