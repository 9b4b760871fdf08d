"""Sinks: JSON lines that are redacted and checked, catalogs by a registered writer, chunks and search text of a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.plans.prose import redacted_frame


def check(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """df, which stops with the rule's name at the first row that breaks one. rules: SQL conditions by name."""
    broken = F.coalesce(*[F.when(~F.coalesce(F.expr(c), F.lit(False)), F.lit(n)) for n, c in rules.items()], F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    return df.withColumn("_broken", broken).where(F.when(F.col("_broken").isNotNull(), F.raise_error(F.concat(F.lit("contract broken: "), "_broken"))).otherwise(F.lit(True))).drop("_broken")


def json_lines(df: DataFrame, path: str, rules: dict[str, str] | None = None, secrets: dict[str, str] | None = None, mode: str = "append") -> None:
    """Rows as JSON lines, nulls kept, every string free of secrets, each row checked before it is written."""
    redacted_frame(check(df, rules or {}), secrets or {}).write.mode(mode).option("ignoreNullFields", "false").json(path)


WRITERS: dict[str, Callable[[DataFrame, str], None]] = {}


def register_writer(name: str, write: Callable[[DataFrame, str], None]) -> None:
    if name in WRITERS:
        raise ValueError(f"writer {name} is registered already")
    WRITERS[name] = write


register_writer("json", lambda df, path: df.write.mode("overwrite").json(path))
register_writer("csv", lambda df, path: df.select(*[F.col(f.name).cast("string") for f in df.schema.fields]).write.mode("overwrite").option("header", True).csv(path))
register_writer("parquet", lambda df, path: df.write.mode("overwrite").parquet(path))


def catalog(df: DataFrame, path: str, writers: tuple[str, ...] = ("json",)) -> None:
    """The catalog by each writer, in a folder of the writer's name. All writers are known before any writes."""
    unknown = [w for w in writers if w not in WRITERS]
    if unknown or len(set(writers)) < len(writers):
        raise ValueError(f"unknown or repeated writers: {unknown or list(writers)}")
    for w in writers:
        WRITERS[w](df, f"{path}/{w}")
