"""Breakdowns of an audience by one dimension, event grain and session grain side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.operators.base import labelled, scan_events, scan_sessions, with_visitors
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.windows import TimeWindow

COLUMN_DIMENSIONS = ("device_type", "browser", "os", "source_platform", "source_medium", "source_campaign")
DIMENSIONS = (*COLUMN_DIMENSIONS, "country")
EVENT_METRICS = ("events", "pageviews", "users")
SESSION_METRICS = ("sessions", "bounce_rate", "avg_duration", "engaged_rate")


def _country() -> Column:
    return F.col("geo")["country_code"]


def _event_side(metrics: Sequence[str]) -> list[Column]:
    made = {"events": F.count("*"), "pageviews": F.count_if(F.col("event_type") == "pageview"), "users": F.count_distinct("canonical_id")}
    return [made[m].alias(m) for m in metrics]


def session_rates(metrics: Sequence[str] = SESSION_METRICS) -> list[Column]:
    made = {"sessions": F.count("*"), "bounce_rate": F.avg(F.col("is_bounce").cast("int")), "avg_duration": F.avg("duration_seconds"), "engaged_rate": F.avg(F.col("is_engaged").cast("int"))}
    return [made[m].alias(m) for m in metrics]


def _value(dimension: str) -> Column:
    return _country() if dimension == "country" else F.col(dimension)


def breakdown(
    events: DataFrame,
    visitors: DataFrame,
    sessions: DataFrame | None,
    dimension: str,
    metrics: Sequence[str],
    window: TimeWindow,
    workspace: str = DEFAULT_WORKSPACE,
    filter_by: tuple[str, str] | None = None,
    order_by: tuple[str, str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """value and metrics, by the first metric from high to low unless order_by = (metric, "asc" | "desc") says otherwise.

    users are distinct canonical visitors, so rows don't add up. A value that only one grain has gets 0 for event metrics and
    null for session metrics. Ties are in order of the value.
    """
    if dimension not in DIMENSIONS:
        raise ValueError(f"unknown dimension {dimension!r}")
    if not metrics or any(m not in EVENT_METRICS + SESSION_METRICS for m in metrics):
        raise ValueError(f"unknown metrics {metrics!r}")
    of_events, of_sessions = [m for m in metrics if m in EVENT_METRICS], [m for m in metrics if m in SESSION_METRICS]
    by_country = "country" in (dimension, filter_by and filter_by[0])
    if of_sessions and by_country:
        raise ValueError("sessions have no country")
    if filter_by and filter_by[0] not in DIMENSIONS:
        raise ValueError(f"unknown filter {filter_by[0]!r}")
    metric, direction = order_by or (metrics[0], "desc")
    if metric not in metrics or direction not in ("asc", "desc"):
        raise ValueError(f"can't order by {order_by!r}")
    chosen = (lambda df: df.where(_value(filter_by[0]) == filter_by[1])) if filter_by else (lambda df: df)
    sides = []
    if of_events:
        rows = chosen(with_visitors(scan_events(events, window, workspace), visitors, *(["geo"] if by_country else [])))
        sides.append(rows.groupBy(labelled(_value(dimension)).alias("value")).agg(*_event_side(of_events)))
    if of_sessions:
        rows = chosen(scan_sessions(sessions, window, workspace))
        sides.append(rows.groupBy(labelled(F.col(dimension)).alias("value")).agg(*session_rates(of_sessions)))
    found = sides[0]
    if len(sides) == 2:
        found = sides[0].join(sides[1], "value", "full")
        found = found.select("value", *[F.coalesce(m, F.lit(0)).alias(m) if m in EVENT_METRICS else F.col(m) for m in metrics])
    key = F.coalesce(F.col(metric), F.lit(0))
    found = found.orderBy(key.asc() if direction == "asc" else key.desc(), "value")
    return found.limit(limit) if limit else found
