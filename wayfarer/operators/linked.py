"""Sessions by two keys: a visitor's event may go on with a session that is live under the event's anonymous id alone.

An event looks for a live session of its visitor first, then for one of its anonymous id, each time the one with the latest event. The session takes over the event's visitor and
its anonymous id, where the event has them. So which events meet depends on their order, and the link between two visitors lasts only while a session is live.

Most visitors share no anonymous id with others: their sessions are the closed form of sessions.stamp. The others are brought together as components of the graph of
visitors and anonymous ids, an upper bound of who can meet; each component is walked through once in order of time. Partitions are read as streams of rows: what a task holds are the
sessions that are live at one moment, however large a component is.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfarer.operators import graph, sessions

#: Live sessions after which those that ended are put away.
SWEEP = 4096


class _Session:
    __slots__ = ("acq", "anonymous", "id", "last", "owner", "real")

    def __init__(self, number: str, owner: str, real: bool, anonymous: str | None, at: int, acq: str | None):
        self.id, self.owner, self.real, self.anonymous, self.last, self.acq = number, owner, real, anonymous, at, acq


class Walk:
    """The sessions of one component that are live, by visitor and by anonymous id."""

    def __init__(self, gap_seconds: int):
        self.gap, self.most = gap_seconds * 1_000_000, max(sessions.HOP_SECONDS, gap_seconds)
        self.restart()

    def restart(self) -> None:
        self.by_owner: dict[str, list[_Session]] = defaultdict(list)
        self.by_anonymous: dict[str, list[_Session]] = defaultdict(list)
        self.held, self.sweep = 0, SWEEP

    def _find(self, held: dict[str, list[_Session]], field: str, key: str | None, at: int) -> _Session | None:
        if key is None or key not in held:
            return None
        # Sessions that ended or went to another key are put away.
        live = held[key] = [s for s in held[key] if at - s.last <= self.gap and getattr(s, field) == key]
        return max(live, key=lambda s: s.last, default=None)

    def _keep(self, session: _Session, at: int) -> None:
        for held, key in ((self.by_owner, session.owner), (self.by_anonymous, session.anonymous)):
            if key is not None and session not in held[key]:
                held[key].append(session)
        self.held += 1
        if self.held > self.sweep:
            for held in (self.by_owner, self.by_anonymous):
                for key in list(held):
                    held[key] = [s for s in held[key] if at - s.last <= self.gap]
                    if not held[key]:
                        del held[key]
            self.held = len(self.by_owner)
            self.sweep = 2 * self.held + SWEEP

    def add(self, workspace: str, event: str, owner: str, real: bool, anonymous: str | None, at: int, acq: str | None, beacon: bool) -> tuple[str, bool, int] | None:
        """(session id, whether the event starts it, seconds since the event before); None for a beacon without a live session."""
        live = self._find(self.by_owner, "owner", owner, at) or self._find(self.by_anonymous, "anonymous", anonymous, at)
        if beacon:
            if live is None:
                return None
            hop, live.last = min(max((at - live.last) // 1_000_000, 0), self.most), max(live.last, at)
            return live.id, False, hop
        if live is None or (acq and live.acq and acq != live.acq):
            number = hashlib.sha256(f"{workspace}:{owner}:{event}".encode()).hexdigest()[:32]
            self._keep(_Session(number, owner, real, anonymous, at, acq), at)
            return number, True, 0
        hop, live.last, live.acq = min(max((at - live.last) // 1_000_000, 0), self.most), max(live.last, at), live.acq or acq
        moved = (real and live.owner != owner) or (anonymous is not None and live.anonymous != anonymous)
        if real:
            live.owner, live.real = owner, True
        if anonymous is not None:
            live.anonymous = anonymous
        if moved:
            self._keep(live, at)
        return live.id, False, hop


def groups(rows: DataFrame) -> DataFrame:
    """(__key, __group): the component of each visitor (or stand-in) that shares an anonymous id with another one."""
    pairs = rows.where(F.col("anonymous_id").isNotNull()).select("__key", F.concat_ws(sessions.BETWEEN, F.coalesce("workspace_id", F.lit("")), F.col("anonymous_id").cast("string")).alias("hub")).distinct()
    shared = pairs.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    found = graph.components(pairs.join(shared, "hub").select(F.col("__key").alias("member"), "hub"))
    return found.select(F.col("member").alias("__key"), F.col("root").alias("__group"))


def stamp(events: DataFrame, gap_seconds: int = sessions.GAP_SECONDS) -> DataFrame:
    """sessions.stamp, online, with the fall-back to anonymous ids. Runs jobs: components are found in rounds."""
    rows = sessions._with_missing(events)
    owner = F.coalesce(F.col("visitor_id").cast("string"), sessions.stand_in())
    rows = rows.withColumns({"__owner": owner, "__key": F.concat_ws(sessions.BETWEEN, F.coalesce("workspace_id", F.lit("")), owner)})
    tied = groups(rows)
    rows = rows.join(tied, "__key", "left")
    plain = sessions.stamp(rows.where(F.col("__group").isNull()).drop("__owner", "__key", "__group"), gap_seconds)
    return plain.unionByName(walked(rows.where(F.col("__group").isNotNull()), gap_seconds).select(*plain.columns))


def walked(rows: DataFrame, gap_seconds: int) -> DataFrame:
    """rows of components, stamped in order of time."""
    beacon = F.coalesce(F.col("event_type") == "engagement", F.lit(False))
    rows = rows.withColumns({"__us": F.unix_micros("inserted_at"), "__beacon": beacon, "__acq": F.when(~beacon, sessions.acquisition()), "__real": F.col("visitor_id").isNotNull()})
    rows = rows.withColumns({"__event": F.col("id").cast("string"), "__anonymous": F.col("anonymous_id").cast("string"), "__space": F.coalesce("workspace_id", F.lit(""))})
    ordered = rows.drop("session_id").repartition("__group").sortWithinPartitions("__group", "__us", "id")
    schema = T.StructType([*ordered.schema.fields, T.StructField("session_id", T.StringType()), T.StructField("starts", T.BooleanType()), T.StructField("hop", T.LongType())])
    names = ("__space", "__event", "__owner", "__real", "__anonymous", "__us", "__acq", "__beacon")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, group = Walk(gap_seconds), None
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in names]
            kept, found = [], []
            for i, (of, *row) in enumerate(zip(batch.column("__group").to_pylist(), *columns, strict=True)):
                if of != group:
                    state.restart()
                    group = of
                made = state.add(*row)
                if made is not None:
                    kept.append(i)
                    found.append(made)
            rest = batch.take(pa.array(kept, pa.int64()))
            more = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.bool_(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*rest.columns, *more], [*rest.schema.names, "session_id", "starts", "hop"])

    return ordered.mapInArrow(walk, schema).drop("__group", "__key", "__real", "__event", "__anonymous", "__space")
