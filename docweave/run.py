"""A folder run: inventory, units of every file, manifest, chunks; and its command line.

python -m docweave.run convert-folder IN OUT | dry-run IN | evaluate-formula EXPRESSION NAME=VALUE…
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import sinks
from docweave.functions import formulas as fx
from docweave.plans.units import chunked
from docweave.session import build_session, cut_lineage
from docweave.sources import folder


def allocate(base: str, now: datetime | None = None) -> str:
    """A new run folder named by the time in UTC, with a number behind it where that is taken."""
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%SZ")
    for name in (stamp, *(f"{stamp}-{i:03d}" for i in range(1, 1000))):
        path = os.path.join(base, name)
        if not os.path.exists(path):
            os.makedirs(path)
            return path
    raise RuntimeError("no free name for the run folder")


def safe_folders(source: str, target: str) -> None:
    """Input and output must not lie in each other, and the input must be a real folder."""
    a, b = os.path.realpath(source), os.path.realpath(target)
    if os.path.islink(source) or not os.path.isdir(a):
        raise ValueError("the input is no folder")
    if os.path.commonpath([a, b]) in (a, b):
        raise ValueError("input and output overlap")


def convert(spark: SparkSession, source: str, earlier: DataFrame | None = None, readers: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Manifest and units of a folder. One file's failure is its own row. Duplicates are skipped.

    earlier: manifest rows (sha256, relative_path, status) of runs before; content converted at the same path isn't read again.
    """
    files = cut_lineage(folder.inventory(folder.scan(spark, source)))
    known = earlier.where(F.col("status").isin("success", "partial_success")).groupBy("sha256", "relative_path").agg(F.max("status").alias("before")) if earlier is not None else files.select("sha256", "relative_path", F.lit(None).cast("string").alias("before")).limit(0)
    todo = files.where("supported and duplicate_of is null").join(known, ["sha256", "relative_path"], "left_anti").select("relative_path")
    units = cut_lineage(folder.read_units(folder.scan(spark, source, content=True).join(todo, "relative_path", "left_semi"), readers))
    told = units.groupBy(F.col("path").alias("relative_path")).agg(F.max("error").alias("error"), F.count("unit_id").alias("units_count"), F.max(F.col("page")).alias("pages"), F.sum(F.when(F.col("type").isin("header", "footer"), 0).otherwise(F.length(F.coalesce("text", F.lit(""))))).alias("search_text_chars"))
    m = files.join(told, "relative_path", "left").join(known, ["sha256", "relative_path"], "left")
    status = (
        F.when(~F.col("supported"), "skipped_unsupported").when(F.col("duplicate_of").isNotNull(), "skipped_duplicate").when(F.col("before").isNotNull(), F.col("before"))
        .when(F.col("error").isNotNull() & (F.col("error") != "empty_text"), "failed").when(F.col("units_count").isNull(), "failed").when(F.coalesce("search_text_chars", F.lit(0)) == 0, "partial_success").otherwise("success")
    )
    manifest = m.select("relative_path", "filename", "size_bytes", "sha256", "route", status.alias("status"), "duplicate_group_id", "duplicate_of", F.col("before").isNotNull().alias("resumed"), F.coalesce("error", "warning").alias("error"), "units_count", "pages", "search_text_chars")
    return manifest, units.where("unit_id is not null")


def write(manifest: DataFrame, units: DataFrame, target: str, secrets: dict[str, str] | None = None) -> dict:
    """The run's tables below target, and its summary."""
    manifest = cut_lineage(manifest)
    sinks.json_lines(manifest, f"{target}/manifest", {"sha256": "sha256 rlike '^[0-9a-f]{64}$'", "status": "status is not null"}, secrets)
    ids = manifest.select(F.col("relative_path").alias("path"), F.concat(F.lit("sha256:"), "sha256").alias("document_id"))
    own = units.join(ids, "path")
    sinks.json_lines(own, f"{target}/units", {"unit_id": "unit_id rlike '^u_[0-9]{6,}$'"}, secrets)
    sinks.json_lines(chunked(own.select("document_id", "unit_id", "type", "unit_order", "text", "page", "asset_ref").distinct()), f"{target}/chunks", {}, secrets)
    sinks.catalog(manifest.select("relative_path", "status", "route", "error"), f"{target}/catalog", ("json", "csv"))
    counts = {r["status"]: r["count"] for r in manifest.groupBy("status").count().collect()}  # one row per status
    failed, fine = counts.get("failed", 0), counts.get("success", 0) + counts.get("skipped_duplicate", 0)
    partial = counts.get("partial_success", 0)
    return {"status": "failed" if failed and not fine and not partial else "partial_success" if failed or partial else "success", "counts": counts}


def _emit(command: str, status: str, data: object) -> int:
    print(json.dumps({"command": command, "status": status, "data": data}, ensure_ascii=False, sort_keys=True, default=str))
    return 1 if status == "error" else 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docweave")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("convert-folder", "dry-run"):
        commands.add_parser(name).add_argument("source")
    commands.choices["convert-folder"].add_argument("target")
    evaluate = commands.add_parser("evaluate-formula")
    evaluate.add_argument("expression")
    evaluate.add_argument("values", nargs="*")
    args = parser.parse_args(argv)
    if args.command == "evaluate-formula":
        parsed = fx.parse(args.expression)
        if parsed is None:
            return _emit(args.command, "error", "not a formula")
        try:
            values = {k: float(v.replace(",", ".")) for k, _, v in (x.partition("=") for x in args.values)}
        except ValueError as x:
            return _emit(args.command, "error", str(x))
        missing = [n for n in parsed[2] if n not in values]
        if missing:
            return _emit(args.command, "error", {"missing": missing})
        try:
            return _emit(args.command, "ok", {"target": parsed[0], "value": fx.evaluate(parsed[1], values)})
        except (ZeroDivisionError, OverflowError, TypeError) as x:
            return _emit(args.command, "error", type(x).__name__)
    spark = build_session("docweave-run")
    if args.command == "dry-run":
        rows = folder.inventory(folder.scan(spark, args.source)).groupBy("route", "warning").count().collect()  # one row per route
        return _emit(args.command, "ok", [r.asDict() for r in rows])
    safe_folders(args.source, args.target)
    summary = write(*convert(spark, args.source), allocate(args.target))
    return _emit(args.command, {"failed": "error", "partial_success": "warning"}.get(summary["status"], "ok"), summary)


if __name__ == "__main__":
    sys.exit(main())
