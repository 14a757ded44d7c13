"""Zero-filled time series in local time."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators.base import at, scan_events, scan_sessions, with_visitors
from wayfarer.plans.filters import event_filters
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.windows import LADDER, MAX_BUCKETS, ORIGIN, TimeWindow, bucket_interval

METRICS = ("visitors", "pageviews", "revenue", "sessions", "engaged")


def to_local(moment: Column, timezone: str) -> Column:
    """Local time (without zone) of a timestamp; the session's zone is UTC."""
    return F.from_utc_timestamp(moment.cast("timestamp"), timezone).cast("timestamp_ntz")


def to_utc(local: Column, timezone: str) -> Column:
    """The timestamp of a local time: in a spring gap shifted forward, of two in autumn the second."""
    first = F.to_utc_timestamp(local.cast("timestamp"), timezone)
    found = first
    for minutes in (30, 60):
        later = first + F.expr(f"interval {minutes} minutes")
        found = F.when(F.from_utc_timestamp(later, timezone) == local.cast("timestamp"), later).otherwise(found)
    return found


def local_bucket(moment: Column, label: str, timezone: str) -> Column:
    """Start, in local time, of the bucket that holds moment; buckets count from ORIGIN."""
    step = LADDER[label]
    origin = F.lit(ORIGIN.isoformat(sep=" ")).cast("timestamp_ntz").cast("timestamp")
    seconds = F.floor((F.unix_micros(to_local(moment, timezone).cast("timestamp")) - F.unix_micros(origin)) / (step * 1_000_000))
    return F.timestamp_micros(F.unix_micros(origin) + seconds * (step * 1_000_000)).cast("timestamp_ntz")


def buckets(spark: SparkSession, window: TimeWindow, label: str, timezone: str) -> DataFrame:
    """local_start of each bucket that the window touches."""
    first = local_bucket(at(window.start_at), label, timezone)
    last = local_bucket(at(window.end_at - timedelta(microseconds=1)), label, timezone)
    every = F.explode(F.sequence(first, last, F.expr(f"interval {LADDER[label]} seconds")))
    return spark.range(1).select(every.alias("local_start"))


def timeseries(
    events: DataFrame,
    visitors: DataFrame,
    sessions: DataFrame | None,
    metric: str,
    window: TimeWindow,
    workspace: str = DEFAULT_WORKSPACE,
    timezone: str = "Etc/UTC",
    interval: str | None = None,
    filters: Iterable[tuple] = (),
) -> DataFrame:
    """bucket_start, bucket_end (UTC), interval and value of every bucket, in order; 0 where nothing happened.

    Of sessions and engaged, filters of events don't apply. A bucket in a spring gap has no length.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    label = interval or bucket_interval(window)
    if label not in LADDER:
        raise ValueError(f"unknown interval {label!r}")
    if window.seconds / LADDER[label] > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    spark = events.sparkSession
    if metric in ("sessions", "engaged"):
        rows, moment = scan_sessions(sessions, window, workspace), F.col("started_at")
        made = F.count("*") if metric == "sessions" else F.count_if("is_engaged")
    else:
        rows, moment = scan_events(events, window, workspace).where(event_filters(filters)), F.col("inserted_at")
        if metric == "visitors":
            rows, made = with_visitors(rows, visitors), F.count_distinct("canonical_id")
        elif metric == "pageviews":
            rows, made = rows.where(F.col("event_type") == "pageview"), F.count("*")
        else:
            rows, made = rows.where(F.col("event_type") == "sale"), F.sum(F.coalesce("amount_cents", F.lit(0)))
    values = rows.groupBy(local_bucket(moment, label, timezone).alias("local_start")).agg(made.alias("value"))
    filled = buckets(spark, window, label, timezone).join(values, "local_start", "left")
    end = F.col("local_start") + F.expr(f"interval {LADDER[label]} seconds")
    return filled.select(to_utc(F.col("local_start"), timezone).alias("bucket_start"), to_utc(end, timezone).alias("bucket_end"), F.lit(label).alias("interval"), F.coalesce("value", F.lit(0)).cast("long").alias("value")).orderBy("local_start")
