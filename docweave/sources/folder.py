"""Folders of files: scan, content hash, route, duplicates; and what reads a file of each route.

Files come through the binaryFile source, so listing and reading are spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.sources import docx, pdf, xlsx

#: Columns of what every reader gives.
UNITS = "path string, unit_id string, parent_id string, type string, unit_order int, text string, page int, location string, asset_ref string, formula string, address string, flags array<string>, error string"
#: Readers by route: from the bytes of a file to its units.
READERS: dict[str, Callable[[bytes], list[dict]]] = {"docx_native": docx.units, "xlsx_native": xlsx.units, "pdf_text": pdf.units}


def scan(spark: SparkSession, folder: str, content: bool = False) -> DataFrame:
    """path, relative_path, filename, size_bytes, sha256 and route of every file below the folder, but for office lock files.

    Routes: by suffix; a PDF whose bytes show a text layer is pdf_text, any other pdf_scan; the rest isn't classified.
    Order by (lower(relative_path), relative_path) where it matters; a DataFrame keeps none.
    """
    root = folder.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    has_text = F.locate("/Font", F.decode(F.substring("content", 1, 1 << 22), "ISO-8859-1")) > 0
    route = F.when(suffix == "docx", "docx_native").when(suffix == "xlsx", "xlsx_native").when((suffix == "pdf") & has_text, "pdf_text").when(suffix == "pdf", "pdf_scan").otherwise("not_classified")
    out = files.select("path", F.expr(f"substring(path, locate('{root.removeprefix('file://')}', path) + {len(root.removeprefix('file://'))})").alias("relative_path"), name.alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), route.alias("route"), *(["content"] if content else []))
    return out.where(~F.col("filename").startswith("~$"))


def inventory(files: DataFrame) -> DataFrame:
    """files with supported, warning, duplicate_group_id and duplicate_of; the first path of equal contents is their primary."""
    first = files.where("route <> 'not_classified'").groupBy("sha256").agg(F.min(F.struct(F.lower("relative_path").alias("k"), "relative_path")).alias("p"), F.count("*").alias("n")).where("n > 1")
    joined = files.join(first, "sha256", "left").withColumn("supported", F.col("route") != "not_classified")
    group = F.when(F.col("supported") & F.col("n").isNotNull(), F.concat(F.lit("sha256:"), "sha256"))
    primary = F.col("p.relative_path")
    return joined.select("relative_path", "filename", "size_bytes", "sha256", "route", "supported", F.when(~F.col("supported"), "unsupported_suffix").alias("warning"), group.alias("duplicate_group_id"), F.when(group.isNotNull() & (primary != F.col("relative_path")), primary).alias("duplicate_of"))


def read_units(files: DataFrame, readers: dict[str, Callable[[bytes], list[dict]]] | None = None) -> DataFrame:
    """Units of every file with a reader; a file that can't be read gives one row with its error and fails no other.

    files: relative_path, route, content. Further readers may be given by route.
    """
    known = {**READERS, **(readers or {})}
    names = [c.strip().split(" ")[0] for c in UNITS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, route, content in zip(batch["relative_path"], batch["route"], batch["content"], strict=True):
                try:
                    made = known[route](bytes(content))
                    out += [{"path": path, **u} for u in made] or [{"path": path, "error": "empty_text"}]
                except Exception as x:  # one document's failure is its own
                    out.append({"path": path, "error": f"{type(x).__name__}: {x}"[:500]})
            frame = pd.DataFrame(out, columns=names).astype(object)
            yield frame.where(frame.notna(), None)

    wanted = files.where(F.col("route").isin(*known)).select("relative_path", "route", "content")
    return wanted.mapInPandas(run, UNITS)
