from docweave.operators import nested

SCHEMA = """document_id string, extra int, units array<struct<unit_id:string, parent_id:string, type:string, unit_order:int, text:string, asset_ref:string,
formula:struct<linear_text:string, variables:map<string,string>, provenance:struct<parser_path:string>, warnings:array<string>>,
cell:struct<address:string, value:string>, source_ref:struct<document_id:string, page:int, bbox:array<double>>, quality:struct<flags:array<string>>>>"""


def unit(unit_id, formula=None, cell=None, ref=None):
    return (unit_id, None, "paragraph", 1, "t", None, formula, cell, ref, None)


def frame(spark):
    return spark.createDataFrame(
        [
            ("a", 1, [unit("u1", (None, {"x": None, "y": "1"}, None, None)), None, unit("u2", (None, {}, (None,), []), (None, None), (None, None, []))]),
            ("b", 2, []),
            ("c", 3, None),
            (None, 4, [unit("u3", None, ("A1", ""), (None, 0, None))]),
        ],
        SCHEMA,
    )


def test_child_keys(spark):
    got = {tuple(r) for r in nested.child_keys(frame(spark)).collect()}
    assert got == {("a", "u1", "formula", ""), ("a", "u1", "variable", "x"), ("a", "u1", "variable", "y"), (None, "u3", "cell", ""), (None, "u3", "source_ref", "")}


def test_tables(spark):
    df = frame(spark)
    assert [r.unit_id for r in nested.units_table(df).orderBy("unit_id").collect()] == ["u1", "u2", "u3"]
    assert [(r.variable, r.value) for r in nested.variables_table(df).orderBy("variable").collect()] == [("x", None), ("y", "1")]
    cell = nested.child_table(df, "cell").collect()
    assert len(cell) == 1 and cell[0].address == "A1" and cell[0].value == ""
    assert nested.child_table(df, "source_ref").columns == ["document_id", "unit_id", "source_ref_document_id", "page", "bbox"]
    assert nested.child_keys(df.limit(0)).count() == 0


def test_quality_and_assets(spark):
    schema = "document_id string, units array<struct<unit_id:string, quality:struct<flags:array<string>, warnings:array<string>>>>, assets array<struct<document_id:string, path:string>>"
    data = [("a", [("u", (["f", None], ["w"])), None, ("v", None), ("x", (None, []))], [("other", "p"), None]), ("b", None, None), (None, [("u", ([], ["z"]))], [])]
    df = spark.createDataFrame(data, schema)
    assert sorted(map(tuple, nested.quality_table(df).collect()), key=str) == sorted([("a", "u", "flag", 0, "f"), ("a", "u", "flag", 1, None), ("a", "u", "warning", 0, "w"), (None, "u", "warning", 0, "z")], key=str)
    assert [tuple(r) for r in nested.assets_table(df).collect()] == [("a", "other", "p")]
    assert nested.quality_table(df.limit(0)).count() == nested.assets_table(df.limit(0)).count() == 0
