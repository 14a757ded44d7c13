"""Identity request by request: what online resolution does, for any number of requests in order of time.

A request looks for unmerged visitors by each of its signals. None: a visitor is created; one: it takes the request's signals; several: they are merged into the oldest, if the
request may merge, else the oldest takes the signals. So a later request finds what earlier ones left, and order decides; a merged visitor's own ga_id, e-mail and external id are not found any more.

Requests and visitors that share signals, directly or through others, form components, an upper bound of what can meet: only signals that a request has link. Each component is walked through once, its
visitors first, then its requests by time. Partitions are read as streams of rows; a task holds one component's visitors and signals, which are what its result
has too, and not its requests.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.operators import graph
from wayfarer.operators.identity import HELD_IN, STRONG, WEAK, _asked, _keys
from wayfarer.plans.scratch import written

ONE = ("person_external_id", "ga_id", "person_email")
MANY = {"fingerprint": "fingerprints", "anonymous_id": "anonymous_ids", "click_id": "click_ids"}
#: The columns of a visitor that resolution reads and writes.
IDENTITIES = "id string, workspace_id string, person_external_id string, ga_id string, person_email string, fingerprints array<string>, anonymous_ids array<string>, click_ids array<string>, first_seen_at timestamp, last_seen_at timestamp, status string, merged_into_id string"
MADE = "row string, request_id string, action string, visitor_id string, merged_ids array<string>, workspace_id string, person_external_id string, ga_id string, person_email string, fingerprints array<string>, anonymous_ids array<string>, click_ids array<string>, first_us long, last_us long, status string, merged_into_id string"
NAMES = [x.split()[0] for x in MADE.split(", ")]


class _Values:
    """A list of different values: added ones go to the front, those of a merged list to the end. Values know their place, so that nothing is moved."""

    __slots__ = ("first", "last", "place")

    def __init__(self, values: list[str] | None):
        self.place = {v: i for i, v in enumerate(dict.fromkeys(values or []))}
        self.first, self.last = 0, len(self.place)

    def add(self, value: str) -> None:
        self.first -= 1
        self.place[value] = self.first

    def join(self, other: _Values) -> None:
        for value in other.listed():
            if value not in self.place:
                self.place[value] = self.last
                self.last += 1

    def listed(self) -> list[str]:
        return sorted(self.place, key=self.place.__getitem__)


class _Visitor:
    __slots__ = ("changed", "first", "id", "last", "lists", "merged_into", "status", "values", "workspace")

    def __init__(self, number: str, workspace: str, values: dict[str, str | None], lists: dict[str, list[str] | None], first: int, last: int | None, status: str | None):
        self.id, self.workspace, self.values, self.first, self.last, self.status = number, workspace, values, first, last, status
        self.lists, self.merged_into, self.changed = {k: _Values(v) for k, v in lists.items()}, None, False


class Component:
    """The visitors of one component, and which of them has a signal."""

    def __init__(self) -> None:
        self.visitors: list[_Visitor] = []
        self.holding: dict[tuple[str, str, str], dict[str, _Visitor]] = defaultdict(dict)

    def _signals(self, v: _Visitor) -> Iterator[tuple[str, str, str]]:
        yield from ((v.workspace, k, x) for k, x in v.values.items() if x is not None)
        yield from ((v.workspace, k, x) for k, held in v.lists.items() for x in held.place)

    def put(self, v: _Visitor) -> None:
        self.visitors.append(v)
        for signal in self._signals(v):
            self.holding[signal][v.id] = v

    def resolve(self, request: str, workspace: str, signals: dict[str, str], at: int) -> tuple[str, str, list[str]]:
        """(action, visitor, merged visitors) of a request."""
        found = {n: v for k, x in signals.items() for n, v in self.holding.get((workspace, k, x), {}).items()}
        if not found:
            v = _Visitor(created_id(request), workspace, {k: signals.get(k) if k == "ga_id" else None for k in ONE}, {k: [signals[k]] if k in signals else [] for k in MANY}, at, at, "anonymous")
            v.changed = True
            self.put(v)
            return "create", v.id, []
        first, *rest = sorted(found.values(), key=lambda v: (v.first, v.id))
        may = any(k in signals for k in STRONG) or sum(k in signals for k in WEAK) > 1
        merged = rest if may else []
        for v in merged:
            for signal in self._signals(v):
                del self.holding[signal][v.id]
            for k, held in v.lists.items():
                first.lists[k].join(held)
                for x in held.place:
                    self.holding[workspace, k, x][first.id] = first
            v.status, v.merged_into, v.changed = "merged", first.id, True
        self._update(first, signals, at)
        return "merge" if merged else "update", first.id, [v.id for v in merged]

    def _update(self, v: _Visitor, signals: dict[str, str], at: int) -> None:
        for k in MANY:
            if k in signals:
                v.lists[k].add(signals[k])
                self.holding[v.workspace, k, signals[k]][v.id] = v
        if "ga_id" in signals and signals["ga_id"] != v.values["ga_id"]:
            self.holding[v.workspace, "ga_id", v.values["ga_id"]].pop(v.id, None)
            v.values["ga_id"] = signals["ga_id"]
            self.holding[v.workspace, "ga_id", signals["ga_id"]][v.id] = v
        v.last, v.changed = at, True


def created_id(request: str) -> str:
    """The id of the visitor that a request creates: the same whenever it is replayed."""
    h = hashlib.sha256(f"visitor:{request}".encode()).hexdigest()
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:32]}"


def _rows(requests: DataFrame, visitors: DataFrame) -> DataFrame:
    """Visitors and requests of each component (grp), in one form."""
    value = lambda df, c, kind="string": (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
    hub = F.sha2(F.to_json(F.struct("workspace_id", "kind", "key")), 256).alias("hub")
    asked = _asked(requests).select(F.concat(F.lit("r:"), F.col("request_id").cast("string")).alias("member"), hub)
    known = _keys(visitors).select(F.concat(F.lit("v:"), F.col("visitor_id").cast("string")).alias("member"), hub)
    links = asked.unionByName(known.join(asked.select("hub").distinct(), "hub", "left_semi"))
    roots = graph.components(links)
    live = visitors.where(F.coalesce(F.col("status"), F.lit("")) != "merged")
    seen = F.coalesce(F.unix_micros("first_seen_at"), F.lit((1 << 62)))
    old = live.select(F.concat(F.lit("v:"), F.col("id").cast("string")).alias("member"), F.lit(0).alias("kind"), seen.alias("us"), F.col("id").cast("string").alias("id"), "workspace_id", *[value(live, c) for c in ONE], *[value(live, c, "array<string>") for c in MANY.values()], F.unix_micros(value(live, "last_seen_at", "timestamp")).alias("last"), value(live, "status"))
    listed = lambda k, c: (F.when(F.col(k).isNotNull(), F.array(F.col(k).cast("string"))) if k in requests.columns else F.lit(None).cast("array<string>")).alias(c)
    new = requests.select(F.concat(F.lit("r:"), F.col("request_id").cast("string")).alias("member"), F.lit(1).alias("kind"), F.unix_micros("at").alias("us"), F.col("request_id").cast("string").alias("id"), "workspace_id", *[value(requests, c) for c in ONE], *[listed(k, c) for k, c in MANY.items()], F.lit(None).cast("long").alias("last"), F.lit(None).cast("string").alias("status"))
    # A request without signals meets nobody: it is a component of its own.
    tied = new.join(roots, "member", "left").withColumn("grp", F.coalesce("root", "member"))
    return tied.unionByName(old.join(roots, "member").withColumnRenamed("root", "grp").withColumn("root", F.col("grp"))).drop("member", "root")


def replay(requests: DataFrame, visitors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, identities) of requests (request_id, workspace_id, at, signals) in order of time, ties by id, against visitors.

    actions: request_id, action (create, update, merge), visitor_id, merged_ids, as identity.resolve has them for one request. identities: the visitors that are new, have changed or were merged, with the columns of
    IDENTITIES. Runs jobs; the result is written to the shared folder.
    """
    ordered = _rows(requests, visitors).repartition("grp").sortWithinPartitions("grp", "kind", "us", "id")

    def final(component: Component) -> list[tuple]:
        out = []
        for v in component.visitors:
            if v.changed:
                out.append(("visitor", None, None, v.id, None, v.workspace, *[v.values[k] for k in ONE], *[v.lists[k].listed() for k in MANY], v.first, v.last, v.status, v.merged_into))
        return out

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, group, schema = Component(), None, None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["grp"] != group:
                    out += final(component)
                    component, group = Component(), row["grp"]
                if row["kind"] == 0:
                    component.put(_Visitor(row["id"], row["workspace_id"], {k: row[k] for k in ONE}, {k: row[c] for k, c in MANY.items()}, row["us"], row["last"], row["status"]))
                    continue
                signals = {k: row[k] for k in ONE if row[k] is not None} | {k: row[c][0] for k, c in MANY.items() if row[c]}
                action, visitor, merged = component.resolve(row["id"], row["workspace_id"], signals, row["us"])
                out.append(("request", row["id"], action, visitor, merged, *[None] * (len(NAMES) - 5)))
            yield table(out)
        yield table(final(component))

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = {"merged_ids": pa.list_(pa.string()), **{c: pa.list_(pa.string()) for c in MANY.values()}, "first_us": pa.int64(), "last_us": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(NAMES)], NAMES)

    found = written(ordered.mapInArrow(walk, MADE), "replayed")
    of = requests.schema["request_id"].dataType
    actions = found.where("row = 'request'").select(F.col("request_id").cast(of).alias("request_id"), "action", "visitor_id", "merged_ids")
    time = lambda c: F.when(F.col(c) < (1 << 62), F.timestamp_micros(c))
    new: dict[str, Column] = {"id": F.col("visitor_id"), "first_seen_at": time("first_us"), "last_seen_at": time("last_us")}
    identities = found.where("row = 'visitor'").select(*[new.get(n, F.col(n)).alias(n) for n in (x.split()[0] for x in IDENTITIES.split(", "))])
    return actions, identities


def latest(changes: DataFrame) -> DataFrame:
    """The last state of each visitor in rows of IDENTITIES with batch, the number of the batch that left it so."""
    columns = [x.split()[0] for x in IDENTITIES.split(", ")]
    return changes.groupBy("id").agg(F.max_by(F.struct(*columns), "batch").alias("v")).select("v.*")


assert set(ONE) | set(MANY) == set(HELD_IN)
