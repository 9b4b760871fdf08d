"""Streams run over what is there, as queries."""

from __future__ import annotations

import uuid


from docweave.plans.register import Registry
from docweave.session import shared_folder
from docweave.sources.tables import table
from docweave.streaming import events

_R = Registry()
QUERIES, SQL, query = _R.queries, _R.sql, _R.add


def _place(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/docweave-{spark.sparkContext.applicationId}/stream-{uuid.uuid4().hex}"


@query("SELECT logged_at, nullif(trim(run_id, ' '), '') AS run_id, nullif(trim(event, ' '), '') AS event, CASE WHEN event LIKE '%failed%' THEN 'error' WHEN event LIKE '%partial%' OR event LIKE '%cancel%' THEN 'warning' ELSE 'info' END AS level, nullif(trim(status, ' '), '') AS status, nullif(trim(relative_path, ' '), '') AS relative_path, size_bytes, nullif(trim(run_id, ' '), '') IS NOT NULL AND nullif(trim(event, ' '), '') IS NOT NULL AS valid FROM run_log")
def event_stream(spark, d):
    """Log records as a stream appended to a table."""
    at = _place(spark)
    stream = events.normalized(events.read(spark, f"{d}/run_log.parquet", table(spark, d, "run_log").schema))
    events.append(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


@query("SELECT date_trunc('day', logged_at)::TIMESTAMP AS day, event, count(*) AS n FROM run_log WHERE logged_at IS NOT NULL GROUP BY 1, 2")
def event_counts(spark, d):
    """Events by day, counted by a stream with state."""
    at = _place(spark)
    stream = events.counts(events.read(spark, f"{d}/run_log.parquet", table(spark, d, "run_log").schema))
    events.keep_counts(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/table")


@query("SELECT DISTINCT sha256, relative_path FROM manifest WHERE sha256 IS NOT NULL AND relative_path IS NOT NULL AND status IN ('success', 'partial_success')")
def incremental_ingest(spark, d):
    """Files of all runs taken in once by content and path, in a stream."""
    at = _place(spark)
    stream = events.read(spark, f"{d}/manifest.parquet", table(spark, d, "manifest").schema).where("sha256 is not null and relative_path is not null and status in ('success', 'partial_success')").select("sha256", "relative_path")
    events.take_in(stream, f"{at}/table", f"{at}/checkpoint").awaitTermination()
    return spark.read.schema("sha256 string, relative_path string, batch int").parquet(f"{at}/table").select("sha256", "relative_path")


