"""Filters as data, compiled to Columns.

A filter is (field, value) or (field, operator, value) with operators eq, neq, in, not_in and ilike. Values that
can't be used (empty text, empty list, unknown operator) and fields outside the allowed list are left out.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfarer.functions.urls import event_host, event_path, normalized_url
from wayfarer.plans.schemas import EVENT_TYPES

EVENT_FIELDS = ("event_type", "source_platform", "source_medium", "source_campaign", "url", "click_id", "link_id")
SESSION_FIELDS = ("source_platform", "source_medium", "source_campaign", "click_id", "device_type", "browser", "os", "entry_url", "entry_page", "exit_page")
MAX_SEARCH = 200


def escape_like(term: str) -> str:
    return re.sub(r"([\\%_])", r"\\\1", term)


def ilike(column: Column, term: str) -> Column:
    """Case-insensitive containment of term, taken literally."""
    return F.ilike(column, F.lit(f"%{escape_like(term)}%"), F.lit("\\"))


def every(conditions: Iterable[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def _condition(column: Column, operator: str, value: object) -> Column | None:
    text = column.cast("string")
    if isinstance(value, str) and value:
        match operator:
            case "eq":
                return text == value
            case "neq":
                return text != value
            case "ilike":
                return ilike(text, value)
    if isinstance(value, list | tuple) and value:
        values = [str(x) for x in value]
        match operator:
            case "in":
                return text.isin(values)
            case "not_in":
                return ~text.isin(values)
    return None


def _compile(filters: Iterable[tuple], allowed: tuple[str, ...]) -> Column:
    found = []
    for item in filters:
        name, operator, value = item if len(item) == 3 else (item[0], "eq", item[1])
        if name in allowed and (condition := _condition(F.col(name), operator, value)) is not None:
            found.append(condition)
    return every(found)


def event_filters(filters: Iterable[tuple] = ()) -> Column:
    return _compile(filters, EVENT_FIELDS)


def session_filters(filters: Iterable[tuple] = ()) -> Column:
    return _compile(filters, SESSION_FIELDS)


def list_filters(visitor_id: object = None, search: str | None = None, **chosen: tuple[str, list]) -> Column:
    """Filters of the events list: ("in" | "not_in", values) for five fields, one visitor, a search term."""
    columns: dict[str, Callable[[], Column]] = {
        "event_type": lambda: F.col("event_type"),
        "source_platform": lambda: F.col("source_platform"),
        "source_campaign": lambda: F.col("source_campaign"),
        "url": lambda: normalized_url(F.col("url")),
        "click_id": lambda: F.col("click_id"),
    }
    found = []
    for name, (operator, values) in chosen.items():
        if name in columns and isinstance(values, list | tuple) and operator in ("in", "not_in"):
            inside = columns[name]().isin(list(values))
            found.append(inside if operator == "in" else ~inside)
    if visitor_id not in (None, ""):
        found.append(F.col("visitor_id") == visitor_id)
    if search:
        term = search[:MAX_SEARCH]
        found.append(ilike(F.col("event_name"), term) | ilike(F.col("url"), term))
    return every(found)


@dataclass(frozen=True)
class SourceFilter:
    """All of the given source fields must match."""

    platform: str | None = None
    medium: str | None = None
    campaign: str | None = None

    @property
    def blank(self) -> bool:
        return not (self.platform or self.medium or self.campaign)

    def column(self) -> Column:
        given = (("source_platform", self.platform), ("source_medium", self.medium), ("source_campaign", self.campaign))
        return every(F.col(c) == v for c, v in given if v)


@dataclass(frozen=True)
class StepFilter:
    """One condition of a funnel step; type is event, url, property or source."""

    type: str
    event_type: str | None = None
    event_name: str | None = None
    scope: str = "path"
    match: str | None = None
    value: str | None = None
    key: str | None = None
    op: str | None = None
    values: tuple[str, ...] | None = None
    platform: str | None = None
    medium: str | None = None
    campaign: str | None = None

    def __post_init__(self) -> None:
        check = getattr(self, f"_check_{self.type}", None)
        if check is None:
            raise ValueError(f"unknown filter type {self.type!r}")
        if self.scope not in ("path", "host", "full_url"):
            raise ValueError(f"unknown url scope {self.scope!r}")
        if problem := check():
            raise ValueError(problem)

    def _check_event(self) -> str | None:
        return None if self.event_type in EVENT_TYPES else "an event filter needs a known event type"

    def _check_url(self) -> str | None:
        if self.match == "in":
            if not isinstance(self.values, list | tuple) or not self.values:
                return "a url filter 'in' needs values"
            if any(not x or len(x) > 2000 for x in self.values) or len(self.values) > 50:
                return "a url filter takes 50 values of 1 to 2000 characters at most"
            return "value and values exclude each other" if self.value else None
        if self.match not in ("equals", "starts_with", "regex"):
            return f"unknown url match {self.match!r}"
        if not self.value or len(self.value) > 2000:
            return "a url filter needs a value of 2000 characters at most"
        if self.match == "regex":
            if len(self.value) > 200:
                return "a pattern has 200 characters at most"
            try:
                re.compile(self.value)
            except re.error as x:
                return f"invalid pattern: {x}"
        return None

    def _check_property(self) -> str | None:
        if not self.key or len(self.key) > 255:
            return "a property filter needs a key of 255 characters at most"
        if self.op == "eq":
            return None if self.value and len(self.value) <= 1000 else "a property filter 'eq' needs a value of 1000 characters at most"
        if self.op == "in":
            fits = self.values and len(self.values) <= 100 and all(len(x) <= 1000 for x in self.values)
            return None if fits else "a property filter 'in' needs 1 to 100 values of 1000 characters at most"
        return f"unknown property operator {self.op!r}"

    def _check_source(self) -> str | None:
        return "a source filter needs a platform, medium or campaign" if SourceFilter(self.platform, self.medium, self.campaign).blank else None

    def column(self) -> Column:
        match self.type:
            case "event":
                named = [F.col("event_name") == self.event_name] if self.event_name else []
                return every([F.col("event_type") == self.event_type, *named])
            case "url":
                return self._url()
            case "property":
                held = F.col("properties")[self.key]
                return held == self.value if self.op == "eq" else held.isin(list(self.values))
        return SourceFilter(self.platform, self.medium, self.campaign).column()

    def _url(self) -> Column:
        target = {"path": event_path, "host": event_host, "full_url": lambda: F.col("url")}[self.scope]()
        match self.match:
            case "equals":
                return target == self.value
            case "starts_with":  # wildcards in the value stay wildcards
                return target.like(f"{self.value}%")
            case "regex":
                return target.rlike(self.value)
        return target.isin(list(self.values))


@dataclass(frozen=True)
class Step:
    kind: str
    filters: tuple[StepFilter, ...]
    label: str = "Step"
    combine: str = "all"

    def __post_init__(self) -> None:
        object.__setattr__(self, "filters", tuple(self.filters))
        if self.kind not in ("event", "url", "property", "source"):
            raise ValueError(f"unknown step kind {self.kind!r}")
        if self.combine not in ("all", "any"):
            raise ValueError(f"unknown combination {self.combine!r}")
        if not 1 <= len(self.filters) <= 10:
            raise ValueError("a step has 1 to 10 filters")
        if any(f.type != self.kind for f in self.filters):
            raise ValueError("a step's filters are of its kind")
        if not self.label:
            raise ValueError("a step has a label")

    def column(self) -> Column:
        return reduce(and_ if self.combine == "all" else or_, [f.column() for f in self.filters])


@dataclass(frozen=True)
class Funnel:
    name: str
    steps: tuple[Step, ...]
    window_days: int = 30
    cohort: SourceFilter = field(default_factory=SourceFilter)

    def __post_init__(self) -> None:
        object.__setattr__(self, "steps", tuple(self.steps))
        if not 2 <= len(self.steps) <= 8:
            raise ValueError("a funnel has 2 to 8 steps")
        if not 1 <= self.window_days <= 90:
            raise ValueError("a funnel's window is 1 to 90 days")

    def to_json(self) -> str:
        """The definition as it is kept in the table of funnels."""
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Funnel:
        """The funnel of a kept definition; a malformed one raises a ValueError like one made by hand."""
        given = json.loads(text)
        filters = lambda s: tuple(StepFilter(**f | {"values": tuple(f["values"]) if f.get("values") else None}) for f in s["filters"])
        steps = tuple(Step(**s | {"filters": filters(s)}) for s in given["steps"])
        return cls(given["name"], steps, given["window_days"], SourceFilter(**given["cohort"]))

    def step_columns(self) -> list[Column]:
        """A condition for each step; the cohort narrows the first."""
        found = [s.column() for s in self.steps]
        if not self.cohort.blank:
            found[0] = found[0] & self.cohort.column()
        return found
