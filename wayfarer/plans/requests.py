"""Text parameters of analytics requests: checked and turned into calls."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from wayfarer.operators import audience, timeseries
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.windows import LADDER, MAX_BUCKETS, TimeWindow, bucket_interval

DEFAULT_LIMIT, MAX_LIMIT = 50, 200


def _window(params: Mapping[str, str]) -> TimeWindow:
    start, end = (datetime.fromisoformat(params[k]) for k in ("from", "to"))
    if start >= end:
        raise ValueError("`from` must be before `to`")
    return TimeWindow(start, end)


def _limit(params: Mapping[str, str]) -> int:
    limit = int(params.get("limit", DEFAULT_LIMIT))
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be from 1 to {MAX_LIMIT}")
    return limit


@dataclass(frozen=True)
class BreakdownRequest:
    """dimension, metrics (comma-separated), filter (dimension:value), order, limit, from, to."""

    dimension: str
    metrics: tuple[str, ...]
    filter_by: tuple[str, str] | None
    order: str
    limit: int
    window: TimeWindow

    @classmethod
    def parse(cls, params: Mapping[str, str]) -> BreakdownRequest:
        metrics = tuple(m.strip() for m in params.get("metrics", "events").split(",") if m)
        if not metrics or any(m not in audience.EVENT_METRICS + audience.SESSION_METRICS for m in metrics):
            raise ValueError(f"unknown metric in: {params.get('metrics')}")
        chosen = None
        if raw := params.get("filter"):
            name, _, value = raw.partition(":")
            if not value:
                raise ValueError(f"invalid filter (expected 'dimension:value'): {raw}")
            if name not in audience.DIMENSIONS:
                raise ValueError(f"unknown filter dimension: {name}")
            chosen = (name, value)
        if params["dimension"] not in audience.DIMENSIONS:
            raise ValueError(f"unknown dimension: {params['dimension']}")
        return cls(params["dimension"], metrics, chosen, "asc" if params.get("order") == "asc" else "desc", _limit(params), _window(params))

    def run(self, events: DataFrame, visitors: DataFrame, sessions: DataFrame, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
        return audience.breakdown(events, visitors, sessions, self.dimension, self.metrics, self.window, workspace, self.filter_by, (self.metrics[0], self.order), self.limit)


@dataclass(frozen=True)
class SeriesRequest:
    """metric, interval (an unknown one falls back to the window's own), timezone, from, to."""

    metric: str
    interval: str
    timezone: str
    window: TimeWindow

    @classmethod
    def parse(cls, params: Mapping[str, str]) -> SeriesRequest:
        window = _window(params)
        interval = params.get("interval")
        interval = interval if interval in LADDER else bucket_interval(window)
        if window.seconds // LADDER[interval] > MAX_BUCKETS:
            raise ValueError(f"interval too small for the requested window (would exceed {MAX_BUCKETS} buckets)")
        if params["metric"] not in timeseries.METRICS:
            raise ValueError(f"unknown metric: {params['metric']}")
        return cls(params["metric"], interval, params.get("timezone", "Etc/UTC"), window)

    def run(self, events: DataFrame, visitors: DataFrame, sessions: DataFrame, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
        found = timeseries.timeseries(events, visitors, sessions, self.metric, self.window, workspace, self.timezone, self.interval)
        return found.drop("interval")
