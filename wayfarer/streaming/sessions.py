"""Sessions, unique clicks and time series on streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from wayfarer.operators import replay
from wayfarer.operators.sessions import ENGAGED_PAGEVIEWS, ENGAGED_SECONDS, GAP_SECONDS, HOP_SECONDS, TUPLE, acquisition, page_path
from wayfarer.plans.schemas import CONVERSION_TYPES, INTERACTIVE_TYPES
from wayfarer.sources.batches import Batches

SESSION = "workspace_id string, visitor_id string, first_event_id string, started_at timestamp, last_event_at timestamp, entry_page string, exit_page string, pageviews long, events long, duration_seconds long, engaged_seconds long, is_bounce boolean, is_engaged boolean, acquisition string"
STATE = "first_event_id string, started long, last long, entry_page string, exit_page string, pageviews long, events long, duration long, engaged long, acted boolean, sold boolean, acquisition string"
FIELDS = [x.split()[0] for x in STATE.split(", ")]
WAITING = "id string, event_type string, us long, page string, acq string, engaged long"


def prepared(events: DataFrame) -> DataFrame:
    """The columns that the session state needs; id and visitor_id as text."""
    have = events.columns
    engaged = F.floor(F.coalesce("engaged_ms", F.lit(0)) / 1000).cast("long") if "engaged_ms" in have else F.lit(0).cast("long")
    rows = events.withColumns({c: F.lit(None).cast("string") for c in ("path", "url", *TUPLE) if c not in have})
    return rows.select(F.coalesce("workspace_id", F.lit("")).alias("workspace_id"), F.col("visitor_id").cast("string").alias("visitor_id"), F.col("id").cast("string").alias("id"), "event_type", "inserted_at", F.unix_micros("inserted_at").alias("us"), page_path().alias("page"), acquisition().alias("acq"), engaged.alias("engaged"))


class _Fold:
    """The session rules, row by row, for rows of one visitor in order of time."""

    def __init__(self, gap_seconds: int):
        self.gap, self.most = gap_seconds * 1_000_000, max(HOP_SECONDS, gap_seconds)

    def row(self, key: tuple, s: dict) -> dict:
        at = lambda us: pd.Timestamp(us, unit="us")
        engaged = s["pageviews"] >= ENGAGED_PAGEVIEWS or s["sold"] or s["engaged"] >= ENGAGED_SECONDS
        return {"workspace_id": key[0], "visitor_id": key[1], "first_event_id": s["first_event_id"], "started_at": at(s["started"]), "last_event_at": at(s["last"]), "entry_page": s["entry_page"], "exit_page": s["exit_page"], "pageviews": s["pageviews"], "events": s["events"], "duration_seconds": s["duration"], "engaged_seconds": s["engaged"], "is_bounce": not s["acted"] and s["pageviews"] < 2, "is_engaged": bool(engaged), "acquisition": s["acquisition"]}

    def add(self, s: dict | None, event: tuple) -> tuple[dict | None, dict | None]:
        """(session that ended, live session) after event: id, event_type, us, page, acq, engaged."""
        number, kind, us, page, acq, engaged = event
        live = s is not None and us - s["last"] <= self.gap
        ended = None if live or s is None else s
        hop = min(max((us - s["last"]) // 1_000_000, 0), self.most) if live else 0
        if kind == "engagement":
            return ended, s | {"last": us, "duration": s["duration"] + hop, "engaged": s["engaged"] + engaged} if live else None
        if live and acq and s["acquisition"] and acq != s["acquisition"]:
            ended, live = s, False
        view, acts, sells = kind == "pageview", kind in INTERACTIVE_TYPES, kind in CONVERSION_TYPES
        if not live:
            return ended, {"first_event_id": number, "started": us, "last": us, "entry_page": page, "exit_page": page, "pageviews": int(view), "events": 1, "duration": 0, "engaged": 0, "acted": acts, "sold": sells, "acquisition": acq}
        return ended, s | {"last": us, "exit_page": page if view and page else s["exit_page"], "pageviews": s["pageviews"] + view, "events": s["events"] + 1, "duration": s["duration"] + hop, "acted": s["acted"] or acts, "sold": s["sold"] or sells, "acquisition": s["acquisition"] or acq}


class _Sessions(StatefulProcessor):
    """Keeps a visitor's rows until the watermark has passed them, folds them in order, and ends sessions whose gap it has passed."""

    def __init__(self, gap_seconds: int):
        self.fold = _Fold(gap_seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.live = handle.getValueState("live", STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        text = lambda v: v if isinstance(v, str) else None
        given = [(text(e.id), text(e.event_type), int(e.us), text(e.page), text(e.acq), int(e.engaged)) for frame in rows for e in frame.itertuples()]
        self.waiting.appendList(given)
        self._wake(min(e[2] for e in given))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000  # no row up to then will come
        waiting = [tuple(e) for e in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = [e for e in waiting if e[2] <= passed], [e for e in waiting if e[2] > passed]
        live = dict(zip(FIELDS, self.live.get(), strict=True)) if self.live.exists() else None
        out = []
        for event in sorted(ready, key=lambda e: (e[2], e[0] or "")):
            ended, live = self.fold.add(live, event)
            out += [self.fold.row(key, ended)] if ended else []
        if live and live["last"] + self.fold.gap < passed:
            out.append(self.fold.row(key, live))
            live = None
        if rest:
            self.waiting.put(rest)
            self._wake(min(e[2] for e in rest))
        else:
            self.waiting.clear()
        if live:
            self.live.update(tuple(live[f] for f in FIELDS))
            self._wake(live["last"] + self.fold.gap + 1000)
        else:
            self.live.clear()
        if out:
            yield pd.DataFrame(out)

    def _wake(self, us: int) -> None:
        """Come again once the watermark has passed us."""
        self.handle.registerTimer(us // 1000 + 1)

    def close(self) -> None:
        pass


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that sessionize needs: lists and timers by key."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def sessionize(events: DataFrame, gap_seconds: int = GAP_SECONDS, watermark: str = "30 minutes") -> DataFrame:
    """A row for each session when it ends: by a gap that the watermark has passed, or by a new source.

    The same rows as in batch, by visitor, in whatever order events come within the watermark; what comes later is dropped. The state of a visitor is one session and the
    events the watermark hasn't passed. Call use_keyed_state first.
    """
    rows = prepared(events.withWatermark("inserted_at", watermark))
    return rows.groupBy("workspace_id", "visitor_id").transformWithStateInPandas(_Sessions(gap_seconds), SESSION, "append", "EventTime")


def unique_clicks(clicks: DataFrame, ttl_seconds: int = 3600, watermark: str = "1 hour") -> DataFrame:
    """Clicks that count: of one address on one link the first, and then the first after ttl_seconds."""
    ttl = ttl_seconds * 1_000_000

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for e in pd.concat(list(frames)).sort_values(["us", "id"], kind="stable").itertuples():
            if last is None or e.us - last >= ttl:
                last = int(e.us)
                out.append({"ip_address": key[0], "link_id": key[1], "id": e.id, "inserted_at": pd.Timestamp(e.us, unit="us")})
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + ttl) // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out)

    rows = clicks.withWatermark("inserted_at", watermark).select(F.col("ip_address").cast("string"), F.col("link_id").cast("string"), F.col("id").cast("string").alias("id"), F.unix_micros("inserted_at").alias("us"), "inserted_at")
    return rows.groupBy("ip_address", "link_id").applyInPandasWithState(fold, "ip_address string, link_id string, id string, inserted_at timestamp", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def counts(events: DataFrame, every: str = "1 hour", slide: str | None = None, watermark: str = "30 minutes") -> DataFrame:
    """Events and pageviews by tumbling (or sliding) windows."""
    windowed = events.withWatermark("inserted_at", watermark).groupBy(F.window("inserted_at", every, slide) if slide else F.window("inserted_at", every))
    found = windowed.agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "pageview").alias("pageviews"))
    return found.select(F.col("window.start").alias("bucket_start"), F.col("window.end").alias("bucket_end"), "events", "pageviews")


def drop_repeated(events: DataFrame, watermark: str = "1 day") -> DataFrame:
    """Events once for each idempotency key within the watermark."""
    keyed = events.withColumn("idempotency_key", F.coalesce(F.col("properties")["_idempotency_key"], F.concat(F.lit("id:"), F.col("id").cast("string"))))
    return keyed.withWatermark("inserted_at", watermark).dropDuplicatesWithinWatermark(["workspace_id", "idempotency_key"])


def deliver(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, hooks: tuple[Callable[[int], None], ...] = ()):
    """A query that gives each batch to handler (append, plan dispatches, ...), then its number to hooks."""

    def each(batch: DataFrame, number: int) -> None:
        handler(batch, number)
        for hook in hooks:
            hook(number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)


def fan_out(stream: DataFrame, feed: Batches, checkpoint: str):
    """A query that hands a stream of events on to feed, each event once, in files of one workspace; subscribers read theirs."""
    return deliver(stream, lambda batch, number: feed.append(batch.repartition("workspace_id").sortWithinPartitions("workspace_id", "inserted_at").drop("event_month"), number), checkpoint)


def subscription(spark: SparkSession, feed: Batches, workspace: str, after: int = -1) -> DataFrame:
    """A workspace's events of the batches after one that it knows, with batch."""
    return feed.read(spark).where((F.col("workspace_id") == workspace) & (F.col("batch") > after))


def resolve_identities(requests: DataFrame, path: str, checkpoint: str, query: str = "identity"):
    """A query that resolves a stream of requests (request_id, workspace_id, at, signals): each batch in order of time against what the batches before left.

    The state is a table of changes: a batch appends the visitors that it made or changed, and what became of its requests; identities and actions read them. A batch that comes
    again finds the same state, as its own changes are committed last and once.
    """
    changes, actions = identity_tables(path, query)

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if changes.has(spark, number):
            return
        made, changed = replay.replay(batch, identities(spark, path, query, before=number))
        actions.append(made, number)
        changes.append(changed, number)

    return deliver(requests, each, checkpoint)


def identity_tables(path: str, query: str = "identity") -> tuple[Batches, Batches]:
    """(changes of visitors, actions of requests) that resolve_identities appends."""
    return Batches(path, "identities", replay.IDENTITIES, query), Batches(path, "identity_actions", "request_id string, action string, visitor_id string, merged_ids array<string>", query)


def _snapshots(path: str, query: str) -> Batches:
    return Batches(path, "identity_snapshots", replay.IDENTITIES, query)


def identities(spark: SparkSession, path: str, query: str = "identity", before: int | None = None) -> DataFrame:
    """The visitors as the committed batches (those before a number) have left them: the last snapshot and the changes since."""
    held, snapshots = identity_tables(path, query)[0].read(spark).where(F.col("query") == query), _snapshots(path, query)
    held = held if before is None else held.where(F.col("batch") < before)
    if (since := snapshots.last(spark, before)) is not None:
        kept = snapshots.read(spark).where((F.col("query") == query) & (F.col("batch") == since))
        held = held.where(F.col("batch") > since).unionByName(kept)
    return replay.latest(held)


def snapshot_identities(spark: SparkSession, path: str, query: str = "identity") -> int | None:
    """Write the visitors as they are now, so that later reads need no older changes (whose folders may then go); the number of the batch it is of."""
    last = identity_tables(path, query)[0].last(spark)
    if last is not None:
        _snapshots(path, query).append(identities(spark, path, query, before=last + 1), last)
    return last
