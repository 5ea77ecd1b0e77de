"""Heartbeats of running streams, as a table for :func:`tierspark.operators.status.job_status`."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener

REPORT_SCHEMA = T.StructType(
    [
        T.StructField("job", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("kind", T.StringType()),
        T.StructField("phase", T.StringType()),
        T.StructField("lag", T.LongType()),
        T.StructField("watermark", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("fatal", T.BooleanType()),
    ]
)

RUNNING = "running"


class ProgressReports(StreamingQueryListener):
    """Appends one report per progress event to a parquet folder.

    A named query is reported under its name. An idle query beats too; a query that ends with an
    error leaves a fatal error report. ``watermark`` gives the text to report for a query, such as
    the last change version; by default it is empty. The lag is reported as 0.
    """

    def __init__(self, spark: SparkSession, path: str, watermark: Callable[[str], str] | None = None):
        self._spark, self._path, self._watermark = spark, path, watermark
        self._names: dict[str, str] = {}

    def _report(self, run: object, kind: str, phase: str | None, message: str | None = None) -> None:
        job = self._names.get(str(run), str(run))
        watermark = self._watermark(job) if self._watermark and kind == "beat" else ""
        row = (job, datetime.now(timezone.utc), kind, phase, 0, watermark, message, kind == "error")
        self._spark.createDataFrame([row], REPORT_SCHEMA).coalesce(1).write.mode("append").parquet(self._path)

    def onQueryStarted(self, event) -> None:
        self._names[str(event.runId)] = event.name or str(event.id)

    def onQueryProgress(self, event) -> None:
        self._report(event.progress.runId, "beat", RUNNING)

    def onQueryIdle(self, event) -> None:
        self._report(event.runId, "beat", RUNNING)

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._report(event.runId, "error", None, event.exception)
        self._names.pop(str(event.runId), None)
