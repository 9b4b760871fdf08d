"""Nested document records to related flat tables.

The nested column crosses into Python once as Arrow buffers. Child rows are made by list offsets and parent
indices (``take`` on the key columns); no row is ever turned into Python objects.

Defined results
* a null or empty ``units`` list gives no child rows, a null element of it none either;
* an optional object gives a child row only if some field in it, at any depth, is neither null nor an empty
  list or map; an empty string counts as a value;
* every map entry gives a row, also with a null value;
* keys are copied as they are, so null keys stay null; repeated deliveries give repeated rows unless the caller
  asks for distinct ones;
* extra columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Objects of a unit that become tables of their own.
CHILD_OBJECTS = ("source_ref", "formula", "cell")


def _plain(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    return array.combine_chunks() if isinstance(array, pa.ChunkedArray) else array


def _lengths(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Start in the child buffer and length of each list or map; nulls have length 0."""
    offsets = array.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    valid = np.asarray(array.is_valid())
    return offsets[:-1], np.where(valid, np.diff(offsets), 0)


def _explode(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index into the child buffer and index of the parent row, for each element."""
    starts, lengths = _lengths(array)
    parents = np.repeat(np.arange(len(lengths)), lengths)
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before, lengths) + np.repeat(starts, lengths), parents


def holds_value(array: pa.Array) -> np.ndarray:
    """For each row: is some field in it, at any depth, neither null nor an empty list or map?"""
    kind = array.type
    if pa.types.is_struct(kind):
        found = np.zeros(len(array), dtype=bool)
        for field in array.flatten():
            found |= holds_value(field)
        return found
    if pa.types.is_map(kind) or pa.types.is_list(kind):
        return _lengths(array)[1] > 0
    return np.asarray(array.is_valid())


def _child_values(array: pa.Array) -> pa.Array:
    # .values ignores the slice, as the offsets do
    return array.values


def _units(batch: pa.RecordBatch) -> tuple[pa.Array, pa.StructArray]:
    """Document ids and unit structs, one per non-null element of ``units``."""
    units = _plain(batch.column("units"))
    index, parents = _explode(units)
    structs = _child_values(units).take(pa.array(index))
    keep = np.flatnonzero(np.asarray(structs.is_valid()))
    return _plain(batch.column("document_id")).take(pa.array(parents[keep])), structs.take(pa.array(keep))


def _fields(structs: pa.StructArray) -> dict[str, pa.Array]:
    return dict(zip([f.name for f in structs.type], structs.flatten(), strict=True))


def _cast(array: pa.Array, to: pa.DataType) -> pa.Array:
    return array if array.type == to else array.cast(to)


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _unit_struct(df: DataFrame) -> T.StructType:
    return df.schema["units"].dataType.elementType


def _pruned(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """document_id and units with these fields alone, so the scan reads no others and no others cross into Python."""
    known = [f for f in fields if f in _unit_struct(df).names]
    return df.select("document_id", F.transform("units", lambda u: F.when(u.isNotNull(), F.struct(*[u[f].alias(f) for f in known]))).alias("units"))


def _flatten(df: DataFrame, schema: T.StructType, make, fields: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = schema.names
        for batch in batches:
            if batch.num_rows:
                columns = make(batch)
                arrow = _arrow_schema(schema)
                yield pa.RecordBatch.from_arrays([_cast(columns[n], arrow.field(n).type) for n in names], schema=arrow)

    return _pruned(df, fields).mapInArrow(run, schema)


def units_table(df: DataFrame) -> DataFrame:
    """One row per unit: its keys and scalar fields."""
    scalars = [f for f in _unit_struct(df).fields if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    schema = T.StructType([T.StructField("document_id", T.StringType()), *[T.StructField(f.name, f.dataType) for f in scalars if f.name != "document_id"]])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        return _fields(structs) | {"document_id": ids}

    return _flatten(df, schema, make, tuple(f.name for f in scalars))


def child_table(df: DataFrame, name: str) -> DataFrame:
    """One row per unit whose object ``name`` holds a value: document_id, unit_id, then the object's fields without maps.

    A field of the object with the name of a key is given the object's name as a prefix.
    """
    fields = [f for f in _unit_struct(df)[name].dataType.fields if not isinstance(f.dataType, T.MapType)]
    label = {f.name: f"{name}_{f.name}" if f.name in ("document_id", "unit_id") else f.name for f in fields}
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("unit_id", T.StringType()), *[T.StructField(label[f.name], f.dataType) for f in fields]])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        parts = _fields(structs)
        keep = pa.array(np.flatnonzero(holds_value(parts[name])))
        return {label.get(k, k): v for k, v in _fields(parts[name].take(keep)).items()} | {"document_id": ids.take(keep), "unit_id": parts["unit_id"].take(keep)}

    return _flatten(df, schema, make, ("unit_id", name))


def _map_entries(array: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Parent index, key and value of each map entry."""
    index, parents = _explode(array)
    entries = pa.array(index)
    return parents, array.keys.take(entries), array.items.take(entries)


def variables_table(df: DataFrame) -> DataFrame:
    """One row per entry of formula.variables: document_id, unit_id, variable, value."""
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("document_id", "unit_id", "variable", "value")])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        parts = _fields(structs)
        parents, keys, values = _map_entries(_fields(parts["formula"])["variables"])
        of = pa.array(parents)
        return {"document_id": ids.take(of), "unit_id": parts["unit_id"].take(of), "variable": keys, "value": values}

    return _flatten(df, schema, make, ("unit_id", "formula"))


def provenance_table(df: DataFrame) -> DataFrame:
    """One row per unit whose formula.provenance holds a value: document_id, unit_id, then its fields."""
    fields = _unit_struct(df)["formula"].dataType["provenance"].dataType.fields
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in ("document_id", "unit_id")], *[T.StructField(f.name, f.dataType) for f in fields]])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        parts = _fields(structs)
        provenance = _fields(parts["formula"])["provenance"]
        keep = pa.array(np.flatnonzero(holds_value(provenance)))
        return _fields(provenance.take(keep)) | {"document_id": ids.take(keep), "unit_id": parts["unit_id"].take(keep)}

    return _flatten(df, schema, make, ("unit_id", "formula"))


def warnings_table(df: DataFrame) -> DataFrame:
    """One row per element of formula.warnings, also a null one: document_id, unit_id, position (from 0), warning."""
    schema = T.StructType([T.StructField("document_id", T.StringType()), T.StructField("unit_id", T.StringType()), T.StructField("position", T.IntegerType()), T.StructField("warning", T.StringType())])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        parts = _fields(structs)
        warnings = _fields(parts["formula"])["warnings"]
        index, parents = _explode(warnings)
        of = pa.array(parents)
        position = index - _lengths(warnings)[0][parents]
        return {"document_id": ids.take(of), "unit_id": parts["unit_id"].take(of), "position": pa.array(position), "warning": _child_values(warnings).take(pa.array(index))}

    return _flatten(df, schema, make, ("unit_id", "formula"))


def child_keys(df: DataFrame) -> DataFrame:
    """Which child rows each unit has: document_id, unit_id, child_table, child_key ('' but for variables).

    Units of equal keys in several deliveries give repeated rows; the caller decides whether they count once.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("document_id", "unit_id", "child_table", "child_key")])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        parts = _fields(structs)
        which, tables, keys = [], [], []
        for name in CHILD_OBJECTS:
            rows = np.flatnonzero(holds_value(parts[name]))
            which.append(rows)
            tables.append(pa.array([name] * len(rows), pa.string()))
            keys.append(pa.array([""] * len(rows), pa.string()))
        parents, names, _ = _map_entries(_fields(parts["formula"])["variables"])
        which.append(parents)
        tables.append(pa.array(["variable"] * len(parents), pa.string()))
        keys.append(_cast(names, pa.string()))
        of = pa.array(np.concatenate(which))
        return {"document_id": ids.take(of), "unit_id": parts["unit_id"].take(of), "child_table": pa.concat_arrays(tables), "child_key": pa.concat_arrays(keys)}

    return _flatten(df, schema, make, ("unit_id", *CHILD_OBJECTS))


def quality_table(df: DataFrame) -> DataFrame:
    """One row per flag or warning of a unit's quality, also a null one: document_id, unit_id, kind ('flag' or 'warning'),
    position (from 0), value."""
    schema = T.StructType([*[T.StructField(n, T.StringType()) for n in ("document_id", "unit_id", "kind")], T.StructField("position", T.IntegerType()), T.StructField("value", T.StringType())])

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        ids, structs = _units(batch)
        parts = _fields(structs)
        lists = _fields(parts["quality"])
        of, places, values, kinds = [], [], [], []
        for name, kind in (("flags", "flag"), ("warnings", "warning")):
            index, parents = _explode(lists[name])
            of.append(parents)
            places.append(index - _lengths(lists[name])[0][parents])
            values.append(_child_values(lists[name]).take(pa.array(index)))
            kinds.append(pa.array([kind] * len(parents), pa.string()))
        at = pa.array(np.concatenate(of))
        return {"document_id": ids.take(at), "unit_id": parts["unit_id"].take(at), "kind": pa.concat_arrays(kinds), "position": pa.array(np.concatenate(places)), "value": pa.concat_arrays([_cast(v, pa.string()) for v in values])}

    return _flatten(df, schema, make, ("unit_id", "quality"))


def assets_table(df: DataFrame) -> DataFrame:
    """One row per asset that isn't null: document_id, then its fields; an asset's own document_id gets a prefix."""
    fields = df.schema["assets"].dataType.elementType.fields
    label = {f.name: f"asset_{f.name}" if f.name == "document_id" else f.name for f in fields}
    schema = T.StructType([T.StructField("document_id", T.StringType()), *[T.StructField(label[f.name], f.dataType) for f in fields]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow_schema(schema)
        for batch in batches:
            if batch.num_rows:
                assets = _plain(batch.column("assets"))
                index, parents = _explode(assets)
                structs = _child_values(assets).take(pa.array(index))
                keep = np.flatnonzero(np.asarray(structs.is_valid()))
                columns = {label[k]: v for k, v in _fields(structs.take(pa.array(keep))).items()} | {"document_id": _plain(batch.column("document_id")).take(pa.array(parents[keep]))}
                yield pa.RecordBatch.from_arrays([_cast(columns[n], arrow.field(n).type) for n in schema.names], schema=arrow)

    return df.select("document_id", "assets").mapInArrow(run, schema)


def documents_table(df: DataFrame) -> DataFrame:
    """One row per delivery: the scalar and object fields without the nested lists (built-in projection)."""
    return df.select(
        "schema_version", "document_id", F.col("source.*"), F.col("processing.route").alias("route"), F.col("processing.status").alias("status"),
        F.col("processing.ocr_applied").alias("ocr_applied"), F.col("metadata.title").alias("title"), F.col("metadata.document_type").alias("document_type"),
        F.size(F.coalesce("units", F.array())).alias("n_units"), F.size(F.coalesce("assets", F.array())).alias("n_assets"), "run_id", "received_at",
    )


def document_warnings(df: DataFrame) -> DataFrame:
    """One row per warning of a delivery's processing: document_id, run_id, position (from 0), warning (built-in projection)."""
    return df.select("document_id", "run_id", F.posexplode("processing.warnings").alias("position", "warning"))


__all__ = ["CHILD_OBJECTS", "assets_table", "child_keys", "child_table", "document_warnings", "documents_table", "holds_value", "provenance_table", "quality_table", "units_table", "variables_table", "warnings_table"]
