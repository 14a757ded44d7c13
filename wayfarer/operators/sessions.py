"""Sessions in batch: 30-minute gaps, and a new session where the traffic source changes.

A closed form over windows of one visitor, no Python: gaps make islands; within an island an event whose
source differs from the last known one starts a session. A session's source is its first one that isn't direct.
Sessions get an id made of the visitor and the session's first event, so that reruns stamp the same ids.

Events with anonymous ids may go on with a session of another visitor that is live under the same anonymous id (linked.py). Sessions that exist already are
rows of the same sweep: backfill goes on with those that are live, attach finds the one that is live at a beacon's time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.urls import path as url_path
from wayfarer.functions.values import source_text
from wayfarer.plans.schemas import CONVERSION_TYPES, INTERACTIVE_TYPES

GAP_SECONDS, HOP_SECONDS, ENGAGED_SECONDS, ENGAGED_PAGEVIEWS = 1800, 1800, 10, 2
TUPLE = ("source_platform", "source_medium", "source_campaign", "click_id")
KEYS = ("workspace_id", "visitor_id")
#: Unit separator: joins the parts of a source, which are trimmed and have none.
BETWEEN = "\x1f"


def normalized(name: str) -> Column:
    """A source field without blanks around it; empty, and "direct" as platform or medium, is null."""
    text = F.nullif(F.trim(F.col(name).cast("string")), F.lit(""))
    return F.when(F.lower(text) != "direct", text) if name in TUPLE[:2] else text


def acquisition() -> Column:
    """The source of an event as one text, null if it is direct."""
    parts = [normalized(c) for c in TUPLE]
    return F.when(F.coalesce(*parts).isNotNull(), F.concat_ws(BETWEEN, *[F.coalesce(p, F.lit("")) for p in parts]))


def page_path() -> Column:
    """The column path or, where empty, that of the url; null without both."""
    of_url = F.when(F.nullif(F.col("url"), F.lit("")).isNotNull(), url_path(F.col("url")))
    return F.coalesce(F.nullif(F.col("path"), F.lit("")), of_url)


def stand_in() -> Column:
    """What stands for a missing visitor: the event's anonymous id or, without one, the event itself."""
    named = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return F.when(F.col("visitor_id").isNull(), F.coalesce(named("a:", "anonymous_id"), named("e:", "id")))


def _with_missing(events: DataFrame) -> DataFrame:
    kinds = {"path": "string", "url": "string", "click_id": "string", "anonymous_id": "string", "engaged_ms": "long", "workspace_id": "string", "device_type": "string", "browser": "string", "os": "string"}
    return events.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in events.columns})


def stamp(events: DataFrame, gap_seconds: int = GAP_SECONDS, online: bool = True) -> DataFrame:
    """events with starts (a session's first event), hop (whole seconds since the event before, 0 at a start) and session_id.

    online: engagement beacons join a live session and are dropped where there is none; otherwise (backfill) they
    are events like any other. A gap of exactly gap_seconds doesn't end a session. Events without a visitor form sessions by their
    anonymous_id; those without both are sessions of their own, so that they never meet in one task.
    """
    by = [*[F.col(k) for k in KEYS], F.col("__owner")]
    order = [F.col("inserted_at"), F.col("id")]
    rows = _with_missing(events).withColumns({"__us": F.unix_micros("inserted_at"), "__owner": stand_in()})
    visitor = Window.partitionBy(*by).orderBy(*order)
    gap = F.col("__us") - F.lag("__us").over(visitor)
    rows = rows.withColumn("__new", F.coalesce(gap > gap_seconds * 1_000_000, F.lit(True)))
    rows = rows.withColumn("__island", F.sum(F.col("__new").cast("int")).over(visitor.rowsBetween(Window.unboundedPreceding, 0)))
    # Beacons have no source; partitions by visitor and island follow from those by visitor: no other shuffle.
    beacon = (F.col("event_type") == "engagement") & F.lit(online)
    rows = rows.withColumns({"__beacon": F.coalesce(beacon, F.lit(False)), "__acq": F.when(F.coalesce(beacon, F.lit(False)), None).otherwise(acquisition())})
    island = Window.partitionBy(*by, "__island").orderBy(*order)
    if online:
        rows = rows.withColumn("__seen", F.max((~F.col("__beacon")).cast("int")).over(island.rowsBetween(Window.unboundedPreceding, 0))).where("__seen = 1")
        rows = rows.withColumn("__new", F.row_number().over(island) == 1)
    before = F.last("__acq", ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, -1))
    changed = F.coalesce(F.col("__acq") != before, F.lit(False))
    rows = rows.withColumn("starts", F.col("__new") | changed)
    since = F.floor((F.col("__us") - F.lag("__us").over(island)) / 1_000_000)
    hop = F.when(F.col("starts"), 0).otherwise(F.least(F.greatest(since, F.lit(0)), F.lit(max(HOP_SECONDS, gap_seconds))))
    rows = rows.withColumn("hop", F.coalesce(hop, F.lit(0)).cast("long"))
    first = F.last(F.when(F.col("starts"), F.col("id")), ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, 0))
    key = F.concat_ws(":", F.coalesce(F.col("workspace_id"), F.lit("")), F.coalesce(F.col("visitor_id").cast("string"), F.col("__owner")), first.cast("string"))
    rows = rows.withColumn("session_id", F.substring(F.sha2(key, 256), 1, 32))
    return rows.drop(*[c for c in rows.columns if c.startswith("__") and c not in ("__acq", "__us", "__beacon", "__owner")])


def stamped(events: DataFrame, gap_seconds: int = GAP_SECONDS, online: bool = True) -> DataFrame:
    """stamp, by visitor and by anonymous id where events have one."""
    if online and "anonymous_id" in events.columns:
        from wayfarer.operators import linked

        return linked.stamp(events, gap_seconds)
    return stamp(events, gap_seconds, online)


def _summed(rows: DataFrame) -> DataFrame:
    """A row for each session_id of stamped rows."""
    kind, real = F.col("event_type"), ~F.col("__beacon")
    shown = (kind == "pageview") & page_path().isNotNull()
    order = F.struct("__us", "id")
    seconds = F.floor(F.coalesce("engaged_ms", F.lit(0)) / 1000)
    first = lambda c: F.min_by(c, F.when(F.col("starts"), order))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull() & real, order))
    return rows.groupBy("session_id", "workspace_id").agg(
        last("visitor_id").alias("visitor_id"),
        last("anonymous_id").alias("anonymous_id"),
        F.min("inserted_at").alias("started_at"),
        F.max("inserted_at").alias("last_event_at"),
        first("url").alias("entry_url"),
        first(page_path()).alias("entry_page"),
        F.max_by(page_path(), F.when(shown | F.col("starts"), order)).alias("exit_page"),
        F.count_if(kind == "pageview").alias("pageviews"),
        F.count_if(real).alias("events"),
        F.sum("hop").alias("duration_seconds"),
        F.sum(F.when(F.col("__beacon"), seconds).otherwise(0)).cast("long").alias("engaged_seconds"),
        F.count_if(kind.isin(*INTERACTIVE_TYPES)).alias("__acts"),
        F.count_if(kind.isin(*CONVERSION_TYPES)).alias("__sales"),
        *[F.min_by(source_text(normalized(c)), F.when(F.col("__acq").isNotNull(), order)).alias(c) for c in TUPLE],
        *[first(c).alias(c) for c in ("device_type", "browser", "os")],
    )


def _judged(found: DataFrame) -> DataFrame:
    bounce = (F.col("__acts") == 0) & (F.col("pageviews") < 2)
    engaged = (F.col("pageviews") >= ENGAGED_PAGEVIEWS) | (F.col("__sales") > 0) | (F.col("engaged_seconds") >= ENGAGED_SECONDS)
    return found.withColumns({"is_bounce": bounce, "is_engaged": engaged}).drop("__acts", "__sales").withColumnRenamed("session_id", "id")


def sessions(events: DataFrame, gap_seconds: int = GAP_SECONDS, online: bool = True) -> DataFrame:
    """A row for each session; started_at, last_event_at, pages, counts, bounce, engagement, source and device.

    The visitor and the anonymous id are the last known ones of its events.
    """
    return _judged(_summed(stamped(events, gap_seconds, online)))


def by_gap(events: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Sessions by gaps alone, through the built-in session window (same boundary; no split by source)."""
    window = F.session_window("inserted_at", f"{gap_seconds} seconds 1 microsecond")
    found = events.groupBy(window, *[k for k in KEYS if k in events.columns]).agg(F.count("*").alias("events"), F.max("inserted_at").alias("last_event_at"))
    return found.withColumn("started_at", F.col("session_window.start")).drop("session_window")


def _swept(missing: DataFrame, held: DataFrame | None, gap_seconds: int) -> DataFrame:
    """missing (events without a session) stamped in one sweep with the sessions of held; __grown says that the session is one of those.

    A session is a row at the time of its last event, before events of that time; it starts an island, as a pause does. So the last row before an event is in the session
    with the latest event up to then: the one the event goes on with, if that is no more than gap_seconds ago and the source is no other.
    """
    rows = _with_missing(missing).withColumns({"__us": F.unix_micros("inserted_at"), "__owner": stand_in(), "__acq": acquisition(), "__held": F.lit(None).cast("string")})
    if held is not None:
        known = _with_missing(held).where(F.col("visitor_id").isNotNull() | F.col("anonymous_id").isNotNull())
        owner = F.when(F.col("visitor_id").isNull(), F.concat(F.lit("a:"), F.col("anonymous_id").cast("string")))
        visitor = F.col("visitor_id").cast(missing.schema["visitor_id"].dataType).alias("visitor_id")
        points = known.select("workspace_id", visitor, owner.alias("__owner"), F.unix_micros("last_event_at").alias("__us"), acquisition().alias("__acq"), F.col("id").cast("string").alias("__held"))
        rows = rows.unionByName(points, allowMissingColumns=True)
    by, order, point = [*KEYS, "__owner"], ["__us", F.col("__held").isNull(), "__held", "id"], F.col("__held").isNotNull()
    visitor = Window.partitionBy(*by).orderBy(*order)
    pause = F.coalesce(F.col("__us") - F.lag("__us").over(visitor) > gap_seconds * 1_000_000, F.lit(True))
    rows = rows.withColumn("__new", point | pause)
    rows = rows.withColumn("__island", F.sum(F.col("__new").cast("int")).over(visitor.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*by, "__island").orderBy(*order)
    before = F.last("__acq", ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("starts", F.col("__new") | F.coalesce(F.col("__acq") != before, F.lit(False)))
    since = F.floor((F.col("__us") - F.lag("__us").over(island)) / 1_000_000)
    hop = F.when(F.col("starts"), 0).otherwise(F.least(F.greatest(since, F.lit(0)), F.lit(max(HOP_SECONDS, gap_seconds))))
    rows = rows.withColumn("hop", F.coalesce(hop, F.lit(0)).cast("long"))
    begun = F.last(F.when(F.col("starts"), F.struct("__held", F.col("id").cast("string").alias("first"))), ignorenulls=True).over(island.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__begun", begun).where(~point)
    key = F.concat_ws(":", F.coalesce(F.col("workspace_id"), F.lit("")), F.coalesce(F.col("visitor_id").cast("string"), F.col("__owner")), F.col("__begun.first"))
    session = F.coalesce(F.col("__begun.__held"), F.substring(F.sha2(key, 256), 1, 32))
    return rows.withColumns({"session_id": session, "__grown": F.col("__begun.__held").isNotNull(), "__beacon": F.lit(False)})


def backfill(events: DataFrame, held: DataFrame | None = None, gap_seconds: int = GAP_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(events that had no session, stamped with one; the sessions that are new or have changed). Of stamped events a rerun makes nothing.

    held are the sessions that exist: an event goes on with the one that is live at its time, as it would online. Events of any type count alike. replaced puts
    the changed sessions in the place of the old ones.
    """
    missing = events.where(F.col("session_id").isNull()) if "session_id" in events.columns else events
    swept = _swept(missing, held, gap_seconds)
    kept = [c for c in swept.columns if not c.startswith("__")]
    added = _summed(swept.where(~F.col("__grown")))
    if held is None:
        return swept.select(*kept), _judged(added)
    more = _summed(swept.where("__grown")).select("session_id", *[F.col(c).alias(f"m_{c}") for c in ("last_event_at", "exit_page", "pageviews", "events", "duration_seconds", "__acts", "__sales", *TUPLE)])
    grown = _with_missing(held).join(more, held["id"].cast("string") == more["session_id"])
    total = lambda c: F.coalesce(F.col(c), F.lit(0)) + F.col(f"m_{c}")
    direct = acquisition().isNull()
    new = {
        "last_event_at": F.col("m_last_event_at"),
        "exit_page": F.coalesce("m_exit_page", "exit_page"),
        **{c: total(c) for c in ("pageviews", "events", "duration_seconds")},
        "is_bounce": F.coalesce("is_bounce", F.lit(False)) & (F.col("m___acts") == 0) & ~((F.col("m_pageviews") > 0) & (total("pageviews") >= 2)),
        "is_engaged": F.coalesce("is_engaged", F.lit(False)) | (total("pageviews") >= ENGAGED_PAGEVIEWS) | (F.col("m___sales") > 0) | (F.coalesce("engaged_seconds", F.lit(0)) >= ENGAGED_SECONDS),
        **{c: F.when(direct, F.col(f"m_{c}")).otherwise(F.col(c)) for c in TUPLE if c in held.columns},
    }
    types = {f.name: f.dataType for f in held.schema}
    changed = grown.select(*[new.get(c, F.col(c)).cast(kind).alias(c) for c, kind in types.items()])
    made = _judged(added)
    fresh = made.select(*[(F.col(c) if c in made.columns else F.lit(None)).cast(kind).alias(c) for c, kind in types.items()])
    return swept.select(*kept), changed.unionByName(fresh)


def replaced(held: DataFrame, changed: DataFrame) -> DataFrame:
    """held with changed rows in the place of those of the same id, and new ones added."""
    return held.join(changed.select("id"), "id", "left_anti").unionByName(changed)


def attach(beacons: DataFrame, held: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """Engagement beacons with the session that is live at their time; those without one are left out.

    One sweep by visitor: each beacon looks back at the sessions that began before it and takes the one with the latest event. A beacon keeps the session live for the next one.
    """
    own = [c for c in beacons.columns if c != "session_id"]
    rows = beacons.select(*own, F.unix_micros("inserted_at").alias("__us"), F.lit(None).cast("struct<last:bigint,id:string>").alias("__s"))
    session = F.struct(F.unix_micros("last_event_at").alias("last"), F.col("id").cast("string").alias("id"))
    points = held.select("workspace_id", F.col("visitor_id").cast(beacons.schema["visitor_id"].dataType).alias("visitor_id"), F.unix_micros("started_at").alias("__us"), session.alias("__s"))
    both = rows.where(F.col("visitor_id").isNotNull()).unionByName(points.where(F.col("visitor_id").isNotNull()), allowMissingColumns=True)
    both = both.withColumn("__beacon", F.col("__s").isNull())
    before = Window.partitionBy(*KEYS).orderBy("__us", "__beacon").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__s", F.max("__s").over(before)).where("__beacon AND __s IS NOT NULL")
    same = Window.partitionBy(*KEYS, "__s.id").orderBy("__us", "id")
    late = F.col("__us") - F.greatest(F.col("__s.last"), F.coalesce(F.lag("__us").over(same), F.col("__s.last"))) > gap_seconds * 1_000_000
    both = both.withColumn("__late", late)
    both = both.withColumn("__dead", F.max("__late").over(same.rowsBetween(Window.unboundedPreceding, 0))).where(~F.col("__dead"))
    return both.select(*own, F.col("__s.id").alias("session_id"))


def with_engagement(held: DataFrame, attached: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """The sessions of held that beacons are attached to, changed: seconds, duration, last event and whether they are engaged. Pages and bounce stay."""
    beacons = attached.select(F.col("session_id").alias("b_id"), F.unix_micros("inserted_at").alias("us"), F.floor(F.greatest(F.coalesce("engaged_ms", F.lit(0)), F.lit(0)) / 1000).cast("long").alias("seconds"))
    joined = beacons.join(held.select(F.col("id").cast("string").alias("b_id"), F.unix_micros("last_event_at").alias("last")), "b_id")
    by = Window.partitionBy("b_id").orderBy("us")
    since = F.floor((F.col("us") - F.greatest("last", F.coalesce(F.lag("us").over(by), F.col("last")))) / 1_000_000)
    hops = joined.withColumn("hop", F.least(F.greatest(since, F.lit(0)), F.lit(max(HOP_SECONDS, gap_seconds))))
    more = hops.groupBy("b_id").agg(F.sum("hop").cast("long").alias("b_hop"), F.sum("seconds").alias("b_seconds"), F.max("us").alias("b_us"))
    found = held.join(more, held["id"].cast("string") == more["b_id"])
    seconds = F.coalesce("engaged_seconds", F.lit(0)) + F.col("b_seconds")
    new = {
        "engaged_seconds": seconds,
        "duration_seconds": F.coalesce("duration_seconds", F.lit(0)) + F.col("b_hop"),
        "last_event_at": F.greatest("last_event_at", F.timestamp_micros("b_us")),
        "is_engaged": F.coalesce("is_engaged", F.lit(False)) | (seconds >= ENGAGED_SECONDS) | (F.coalesce("pageviews", F.lit(0)) >= ENGAGED_PAGEVIEWS),
    }
    return found.select(*[new.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in held.schema])
