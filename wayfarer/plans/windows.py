"""Time windows and the ladder of bucket intervals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

#: Label and seconds of each bucket interval.
LADDER = {
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "30m": 1800,
    "1h": 3600,
    "2h": 7200,
    "3h": 10800,
    "6h": 21600,
    "12h": 43200,
    "1d": 86400,
    "2d": 172800,
    "1w": 604800,
    "2w": 1209600,
    "1mo": 2592000,
}
#: Buckets are counted from this Monday, local time.
ORIGIN = datetime(2000, 1, 3)
MAX_BUCKETS = 1500
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def as_utc(value: datetime) -> datetime:
    return value.replace(tzinfo=UTC) if value.tzinfo is None else value.astimezone(UTC)


@dataclass(frozen=True)
class TimeWindow:
    """Half-open: start_at <= t < end_at. Naive times are UTC."""

    start_at: datetime
    end_at: datetime

    def __post_init__(self) -> None:
        if not isinstance(self.start_at, datetime) or not isinstance(self.end_at, datetime):
            raise ValueError("a window needs start_at and end_at")
        object.__setattr__(self, "start_at", as_utc(self.start_at))
        object.__setattr__(self, "end_at", as_utc(self.end_at))
        if self.start_at >= self.end_at:
            raise ValueError("a window ends after its start")

    @classmethod
    def trailing(cls, now: datetime, amount: int, unit: str = "day") -> TimeWindow:
        return cls(as_utc(now) - timedelta(seconds=amount * UNITS[unit]), now)

    @property
    def seconds(self) -> int:
        return int((self.end_at - self.start_at).total_seconds())

    def previous(self) -> TimeWindow:
        """The window of the same length just before."""
        return TimeWindow(self.start_at - (self.end_at - self.start_at), self.start_at)

    def contains(self, at: datetime) -> bool:
        return self.start_at <= as_utc(at) < self.end_at


def bucket_interval(window: TimeWindow) -> str:
    """Label of the first interval that cuts the window into no more than 60 buckets (24 for over one to 24 hours)."""
    seconds = max(window.seconds, 60)
    aim = 24 if 3600 < seconds <= 86400 else 60
    return next((label for label, step in LADDER.items() if seconds / step <= aim), list(LADDER)[-1])
