"""Headline numbers, session metrics and conversion breakdowns."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.operators.audience import COLUMN_DIMENSIONS
from wayfarer.operators.base import labelled, scan_events, scan_sessions, with_visitors, within
from wayfarer.plans.filters import event_filters, session_filters
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.windows import TimeWindow

#: Names that can be asked for; only those of CONVERSION_DIMENSIONS are made.
BREAKDOWN_DIMENSIONS = ("channel", "source_platform", "source_medium", "source_campaign", "url", "click_id_param", "device_type", "browser", "os", "country", "city", "short_link")
CONVERSION_DIMENSIONS = COLUMN_DIMENSIONS


def _sales() -> Column:
    return F.coalesce(F.sum(F.when(F.col("event_type") == "sale", F.coalesce("amount_cents", F.lit(0)))), F.lit(0))


def active_metrics(events: DataFrame, visitors: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = ()) -> DataFrame:
    """visitors, new_visitors, identified_visitors, pageviews and revenue of the events that have a visitor: one row, one scan."""
    rows = with_visitors(scan_events(events, window, workspace).where(event_filters(filters)), visitors, "identified_at", "first_seen_at")
    # One row for each visitor first: no event is expanded for the distinct counts.
    each = rows.groupBy("canonical_id").agg(
        F.coalesce(F.max(within("first_seen_at", window)), F.lit(False)).alias("new"),
        F.max(F.col("identified_at").isNotNull()).alias("identified"),
        F.count_if(F.col("event_type") == "pageview").alias("views"),
        _sales().alias("cents"),
    )
    return each.agg(
        F.count("*").alias("visitors"),
        F.count_if("new").alias("new_visitors"),
        F.count_if("identified").alias("identified_visitors"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("pageviews"),
        F.coalesce(F.sum("cents"), F.lit(0)).alias("revenue"),
    )


def new_visitors(events: DataFrame, visitors: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = ()) -> DataFrame:
    """Canonical visitors first seen in the window that have an event in it."""
    rows = with_visitors(scan_events(events, window, workspace).where(event_filters(filters)), visitors, "first_seen_at")
    return rows.where(within("first_seen_at", window)).agg(F.count_distinct("canonical_id").alias("new_visitors"))


def session_headline(sessions: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = ()) -> DataFrame:
    """sessions, bounce_rate, avg_duration and engaged_rate: one row; 0.0 over no sessions."""
    rows = scan_sessions(sessions, window, workspace).where(session_filters(filters))
    rate = lambda c: F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0))
    return rows.agg(F.count("*").alias("sessions"), rate("is_bounce").alias("bounce_rate"), F.coalesce(F.avg("duration_seconds"), F.lit(0.0)).alias("avg_duration"), rate("is_engaged").alias("engaged_rate"))


def kpis(events: DataFrame, visitors: DataFrame, sessions: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = ()) -> DataFrame:
    """The nine headline numbers: one row, two one-row aggregates laid over one another."""
    active = active_metrics(events, visitors, window, workspace, filters)
    headline = session_headline(sessions, window, workspace, filters)
    both = active.unionByName(headline, allowMissingColumns=True)
    rate = F.when(F.col("visitors") > 0, F.col("identified_visitors") / F.col("visitors")).otherwise(0.0)
    found = both.agg(*[F.max(c).alias(c) for c in both.columns]).withColumn("identification_rate", rate)
    return found.select("visitors", "new_visitors", "pageviews", "revenue", "identification_rate", "sessions", "bounce_rate", "avg_duration", "engaged_rate")


def page_tallies(sessions: DataFrame, column: str, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = ()) -> DataFrame:
    """(page, sessions) by entry_page or exit_page; sessions without one are left out."""
    if column not in ("entry_page", "exit_page"):
        raise ValueError(f"no tallies of {column!r}")
    rows = scan_sessions(sessions, window, workspace).where(session_filters(filters)).where(F.col(column).isNotNull())
    return rows.groupBy(F.col(column).alias("page")).agg(F.count("*").alias("sessions"))


def session_metrics(sessions: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = (), page_counts: bool = True) -> dict[str, DataFrame]:
    """headline and, unless page_counts is off, entry_pages and exit_pages."""
    found = {"headline": session_headline(sessions, window, workspace, filters)}
    if page_counts:
        found |= {f"{c}s": page_tallies(sessions, c, window, workspace, filters) for c in ("entry_page", "exit_page")}
    return found


def pageviews(events: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """Pageviews of all events, with a visitor or not."""
    return scan_events(events, window, workspace).agg(F.count_if(F.col("event_type") == "pageview").alias("pageviews"))


def revenue(events: DataFrame, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """Cents of all sales, with a visitor or not."""
    return scan_events(events, window, workspace).where(F.col("event_type") == "sale").agg(F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("revenue"))


def conversion_breakdown(events: DataFrame, visitors: DataFrame, dimension: str, window: TimeWindow, workspace: str = DEFAULT_WORKSPACE, filters: Iterable[tuple] = ()) -> DataFrame:
    """value, sales, visitors, revenue_cents, percentage (of all revenue) and conversion_rate (sales per converting visitor)."""
    if dimension not in CONVERSION_DIMENSIONS:
        known = "isn't supported" if dimension in BREAKDOWN_DIMENSIONS else "is unknown"
        raise ValueError(f"dimension {dimension!r} {known}")
    rows = with_visitors(scan_events(events, window, workspace).where(F.col("event_type") == "sale").where(event_filters(filters)), visitors)
    found = rows.groupBy(labelled(F.col(dimension)).alias("value")).agg(F.count("*").alias("sales"), F.count_distinct("canonical_id").alias("visitors"), F.coalesce(F.sum("amount_cents"), F.lit(0)).alias("revenue_cents"))
    total = F.sum("revenue_cents").over(Window.partitionBy())  # over the values, not the events
    percentage = F.when(total > 0, F.round(F.col("revenue_cents") / total * 100, 2)).otherwise(0.0)
    rate = F.when(F.col("visitors") > 0, F.col("sales") / F.col("visitors")).otherwise(0.0)
    return found.withColumns({"percentage": percentage, "conversion_rate": rate})
