"""JSON documents and lines: with a schema, tolerant of byte order marks and blank lines; and pinned schemas."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per line that isn't blank; a line that doesn't parse keeps its text in _broken and nulls elsewhere."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where(F.trim("line") != "")
    parsed = T.StructType([*schema.fields, T.StructField("_broken", T.StringType())])
    return lines.select(F.from_json("line", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}).alias("r")).select("r.*")


def documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One row per JSON file below path; a folder may hold many packages with a document each."""
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)


def fingerprint(schema: T.StructType) -> str:
    """A schema's hash, to see that it didn't change."""
    return hashlib.sha256(schema.json().encode()).hexdigest()
