"""Lists, lookups and counts of events."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.values import UUID
from wayfarer.operators.base import newest_first, scan_events, at
from wayfarer.plans.filters import list_filters
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.windows import TimeWindow

DEFAULT_DAYS, OPTION_DAYS = 7, 90


def _listed(events: DataFrame, now: datetime, window: TimeWindow | None, workspace: str, chosen: dict) -> DataFrame:
    window = window or TimeWindow(now - timedelta(days=DEFAULT_DAYS), now)
    return scan_events(events, window, workspace, closed=True).where(list_filters(**chosen))


def list_events(events: DataFrame, now: datetime, window: TimeWindow | None = None, workspace: str = DEFAULT_WORKSPACE, limit: int = 50, offset: int = 0, **chosen: object) -> DataFrame:
    """A page of events, newest first; the window (default: the last week) includes its end."""
    return newest_first(_listed(events, now, window, workspace, chosen), limit=limit, offset=offset)


def count_events(events: DataFrame, now: datetime, window: TimeWindow | None = None, workspace: str = DEFAULT_WORKSPACE, **chosen: object) -> DataFrame:
    return _listed(events, now, window, workspace, chosen).agg(F.count("*").alias("events"))


def filter_options(events: DataFrame, now: datetime, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """(option, value): the event types and source platforms of the last 90 days, in order."""
    recent = events.where((F.col("workspace_id") == workspace) & (F.col("inserted_at") >= at(now - timedelta(days=OPTION_DAYS))))
    pairs = F.array(*[F.struct(F.lit(c).alias("option"), F.col(c).alias("value")) for c in ("event_type", "source_platform")])
    return recent.select(F.inline(pairs)).where(F.col("value").isNotNull()).distinct().orderBy("option", "value")


def source_breakdown(events: DataFrame, now: datetime, window: TimeWindow | None = None, workspace: str = DEFAULT_WORKSPACE, limit: int = 10) -> DataFrame:
    """The most frequent (source_platform, source_medium) of events with a platform; the window includes its end."""
    rows = _listed(events, now, window, workspace, {}).where(F.col("source_platform").isNotNull())
    found = rows.groupBy("source_platform", "source_medium").agg(F.count("*").alias("count"))
    return found.orderBy(F.col("count").desc(), "source_platform", "source_medium").limit(limit)


def get_event(events: DataFrame, event_id: object, workspace: str | None = DEFAULT_WORKSPACE, uuids: bool = False) -> DataFrame:
    """The event of an id, in a workspace or (None) in any; no row for an id that is no UUID where ids are."""
    if uuids and not re.match(UUID, str(event_id)):
        return events.where(F.lit(False))
    found = events.where(F.col("id") == event_id)
    return (found if workspace is None else found.where(F.col("workspace_id") == workspace)).limit(1)


def by_idempotency_key(events: DataFrame, key: str, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    return events.where((F.col("workspace_id") == workspace) & (F.col("properties")["_idempotency_key"] == key)).limit(1)


def last_event(events: DataFrame, visitor_id: object, event_type: str) -> DataFrame:
    return newest_first(events.where((F.col("visitor_id") == visitor_id) & (F.col("event_type") == event_type)), limit=1)


def last_events(events: DataFrame, event_type: str) -> DataFrame:
    """(visitor_id, id, inserted_at) of every visitor's last event of a type: one aggregate, no sort."""
    newest = F.max(F.struct("inserted_at", "id")).alias("m")
    return events.where(F.col("event_type") == event_type).groupBy("visitor_id").agg(newest).select("visitor_id", "m.id", "m.inserted_at")


def timeline(events: DataFrame, visitor_id: object) -> DataFrame:
    return events.where(F.col("visitor_id") == visitor_id).orderBy(F.col("inserted_at").desc(), F.col("id").desc())
