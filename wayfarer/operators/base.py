"""Scans and joins that the other operators start from."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.plans.schemas import DEFAULT_WORKSPACE, NOT_SET
from wayfarer.plans.windows import TimeWindow


def at(moment: datetime) -> Column:
    return F.lit(moment).cast("timestamp")


def within(column: str, window: TimeWindow, closed: bool = False) -> Column:
    """column in window; closed windows include their end (funnels and the events list)."""
    upper = F.col(column) <= at(window.end_at) if closed else F.col(column) < at(window.end_at)
    return (F.col(column) >= at(window.start_at)) & upper


def months(window: TimeWindow) -> list[str]:
    """The event_month values (UTC) that a window touches."""
    found, day = [], window.start_at.replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    while day <= window.end_at:
        found.append(day.strftime("%Y-%m"))
        day = (day + timedelta(days=32)).replace(day=1)
    return found


def scan_events(events: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, closed: bool = False) -> DataFrame:
    """Events of a workspace in a window; a table partitioned by event_month is read only where the window is."""
    found = events.where(F.col("workspace_id") == workspace).where(within("inserted_at", window, closed))
    if "event_month" in events.columns:
        found = found.where(F.col("event_month").isin(months(window)))
    return found


def scan_sessions(sessions: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    return sessions.where(F.col("workspace_id") == workspace).where(within("started_at", window))


def canonical(visitors: DataFrame, *columns: str) -> DataFrame:
    """visitor_id, workspace_id and canonical_id of each visitor (a merged one stands for its survivor), and columns."""
    return visitors.select(F.col("id").alias("visitor_id"), "workspace_id", F.coalesce("merged_into_id", "id").alias("canonical_id"), *columns)


def with_visitors(events: DataFrame, visitors: DataFrame, *columns: str) -> DataFrame:
    """events joined to their visitors; events without one are left out."""
    return events.join(canonical(visitors, *columns), ["visitor_id", "workspace_id"])


def labelled(column: Column) -> Column:
    return F.coalesce(column.cast("string"), F.lit(NOT_SET))


def newest_first(df: DataFrame, by: str = "inserted_at", limit: int = 50, offset: int = 0, tie: str = "id") -> DataFrame:
    ordered = df.orderBy(F.col(by).desc(), F.col(tie).desc())
    return (ordered.offset(offset) if offset else ordered).limit(limit)
