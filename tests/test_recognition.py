import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave import recognition as rc
from docweave.sources import records, wmf


def test_chain_and_modes():
    ps = [rc.Provider("m", "llm", None), rc.Provider("o", "ocr", None), rc.LOCAL]
    assert [p.name for p in rc.chain(ps)] == ["text", "o", "m"] and [p.name for p in rc.chain(ps, "LLM-first")] == ["text", "m", "o"] and rc.chain(ps, "off") == []
    assert rc.mode_of(" Mathpix-First ") == "mathpix_first" and rc.mode_of(None) == rc.mode_of("x") == "fallback"


def test_recognise(spark):
    asked = []

    def ocr(inputs):
        asked.append(inputs)
        return [{"display_latex": "x", "confidence": "low"} if asset == "p" else None for _, asset, _ in inputs]

    def llm(inputs):
        return [{"linear_text": f"k = {hint}", "confidence": "high", "calc_expr": "k = 1"} if hint else None for _, _, hint in inputs]

    def broken(inputs):
        raise OSError

    got = rc.ask([("K = a × 2", None), (None, "p"), (None, "q"), ("слова", None)], [rc.LOCAL, rc.Provider("bad", "ocr", broken), rc.Provider("o", "ocr", ocr), rc.Provider("m", "llm", llm)])
    assert [g["provider"] for g in got] == ["text", "o", None, None] and got[0]["calc_expr"] == "K = a * 2" and got[0]["calls"] == 1
    assert got[1]["linear_text"] == "x" and "bad_failed:OSError" in got[1]["warnings"] and got[1]["warnings"][-1] == "formula_recognition_low_confidence"
    assert got[2]["warnings"][-1] == "formula_recognition_unresolved" and len(asked[0]) == 3
    rows = [("d", "a", "K = a × 2", None), ("d", "b", "K = a × 2", None), ("e", "c", None, "p"), (None, "n", None, None)]
    df = spark.createDataFrame(rows, "document_id string, unit_id string, text string, asset string")
    out = {r.unit_id: r for r in rc.recognise(df, [rc.LOCAL]).collect()}
    assert out["a"].calc_expr == out["b"].calc_expr == "K = a * 2" and out["a"].cache_key == out["b"].cache_key and out["c"].provider is None and out["c"].review_required
    assert all(r.calc_expr is None for r in rc.recognise(df, [rc.LOCAL], "off").collect()) and rc.recognise(df.limit(0), [rc.LOCAL]).count() == 0
    assert [r[0] for r in spark.createDataFrame([("LLM-First",), (None,)], "m string").select(rc.mode_column(F.col("m"))).collect()] == ["llm_first", "fallback"]


def record(function, body):
    body += b"\0" * (len(body) % 2)
    return struct.pack("<IH", 3 + len(body) // 2, function) + body


def font(height, charset, face):
    return record(wmf.FONT, struct.pack("<hhhhh", height, 0, 0, 0, 400) + bytes([0, 0, 0, charset, 0, 0, 0, 0]) + face.encode() + b"\0")


def select(i):
    return record(wmf.SELECT, struct.pack("<H", i))


def text(raw):
    return record(wmf.TEXT, struct.pack("<H", len(raw)) + raw + b"\0" * (len(raw) % 2) + struct.pack("<hh", 0, 0))


def test_metafile_records():
    rectangle = record(wmf.EXTENDED_TEXT, struct.pack("<hhHH", 0, 0, 2, 2) + b"\0" * 8 + b"ab")
    body = record(0x02FA, b"\0" * 10) + font(-20, 204, "Arial") + font(-12, 2, "Symbol") + select(1) + text("К".encode("cp1251")) + select(2) + text(b"\xb4=") + select(1) + rectangle
    body += record(wmf.DELETE, struct.pack("<H", 0)) + font(-9, 0, "Times") + select(0) + text(b"\xe4") + record(0, b"")
    head = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 3, 0, 0)
    got = [(c["text"], c["face"], c["charset"], c["height"]) for c in wmf.chunks(head + body)]
    assert got == [("К", "Arial", 204, -20), ("×=", "Symbol", 2, -12), ("ab", "Arial", 204, -20), ("ä", "Times", 0, -9)]
    assert wmf.chunks(struct.pack("<I", wmf.PLACEABLE) + b"\0" * 18 + head + body)[0]["text"] == "К"
    assert wmf.chunks(b"") == wmf.chunks(b"x" * 40) == [] and wmf.chunks(head + body[:30]) == []
    assert wmf.is_formula("A.WMF", b"..MathType..") and not wmf.is_formula("a.png", b"MathType")


def test_json_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('﻿{"n": 1, "t": "я"}\n\n   \nnot json\n{"n": 2}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("t", T.StringType())])
    assert sorted(records.json_lines(spark, str(tmp_path / "a.jsonl"), schema).collect(), key=str) == sorted([(1, "я", None), (None, None, "not json"), (2, None, None)], key=lambda r: str(T.Row("n", "t", "_broken")(*r)))
    for i in (1, 2):
        (tmp_path / f"p{i}").mkdir()
        (tmp_path / f"p{i}" / "document.json").write_text(f'{{\n"n": {i},\n"t": null}}')
    assert sorted(r.n for r in records.documents(spark, str(tmp_path), schema).collect()) == [1, 2]
    assert records.fingerprint(schema) == records.fingerprint(T.StructType(schema.fields)) != records.fingerprint(T.StructType(schema.fields[:1]))
