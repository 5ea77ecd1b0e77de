"""State of the jobs, from their heartbeats and error reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.functions.times import instant_literal, time_type

# Fixed value: a job is alive if it reported within this many seconds (three intervals of ten).
ALIVE_SECONDS = 30
MISSING = "Missing"
# The phase of a job that has only reported errors that did not end it.
UNKNOWN = ""


def observed_state(reports: DataFrame) -> DataFrame:
    """One row per job from its reports ``(job, at, kind, phase, lag, watermark, message, fatal)``.

    ``kind`` is ``beat`` or ``error``. Beats overwrite each other; an error text outlives later beats;
    a fatal error sets the phase until the next beat. Everything is one grouping by job whose tasks
    first keep one row per job, so a job that reports far more than others is no hot spot.
    """
    beat = F.col("kind") == "beat"
    error = F.col("kind") == "error"
    return (
        reports.groupBy("job")
        .agg(
            F.max_by(F.struct("at", "lag", "watermark"), F.when(beat, F.col("at"))).alias("_beat"),
            F.max_by(F.col("message"), F.when(error, F.col("at"))).alias("last_error"),
            F.max_by(
                F.when(beat, F.col("phase")).otherwise(F.lit("error")),
                F.when(beat | F.col("fatal"), F.col("at")),
            ).alias("phase"),
        )
        .select(
            "job",
            "phase",
            F.col("_beat.at").alias("last_beat_at"),
            F.col("_beat.lag").alias("lag"),
            F.col("_beat.watermark").alias("watermark"),
            "last_error",
        )
    )


def job_status(jobs: DataFrame, reports: DataFrame, now: datetime) -> DataFrame:
    """Every wanted job with its observed state; a job that never reported is ``Missing``.

    One that has reported nothing but passing errors is there, in a phase nobody knows: the empty text.
    """
    instant = instant_literal(now, time_type(reports, "at"))
    age_limit = F.expr(f"interval {ALIVE_SECONDS} seconds")
    return (
        jobs.select("job")
        .join(observed_state(reports).withColumn("_seen", F.lit(True)), "job", "left")
        .select(
            "job",
            F.coalesce("phase", F.when(F.col("_seen"), F.lit(UNKNOWN)), F.lit(MISSING)).alias("phase"),
            F.date_trunc("second", "last_beat_at").cast(reports.schema["at"].dataType).alias("last_beat_at"),
            "lag",
            "watermark",
            "last_error",
            F.coalesce(F.col("last_beat_at") > instant - age_limit, F.lit(False)).alias("alive"),
        )
    )
