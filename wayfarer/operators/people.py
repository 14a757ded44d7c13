"""Visitors, links and partners: lookups, first-write-wins fields, rollups, soft deletes, forgetting."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.values import empty_map, scroll_guard
from wayfarer.operators.base import newest_first
from wayfarer.plans.schemas import DEFAULT_WORKSPACE


def list_visitors(visitors: DataFrame, workspace: str = DEFAULT_WORKSPACE, limit: int = 20, offset: int = 0) -> DataFrame:
    """Visitors that aren't merged, last seen first."""
    live = visitors.where((F.col("workspace_id") == workspace) & (F.coalesce(F.col("status"), F.lit("")) != "merged"))
    return newest_first(live, "last_seen_at", limit, offset)


def get_visitor(visitors: DataFrame, visitor_id: object, workspace: str | None = None) -> DataFrame:
    found = visitors.where(F.col("id") == visitor_id)
    return found if workspace is None else found.where(F.col("workspace_id") == workspace)


def by_external_id(visitors: DataFrame, external_id: str, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    return visitors.where((F.col("workspace_id") == workspace) & (F.col("person_external_id") == external_id) & (F.coalesce(F.col("status"), F.lit("")) != "merged")).limit(1)


def get_link(links: DataFrame, key: str, domain: str | None = None, workspace: str | None = None) -> DataFrame:
    """Live links of a key: the one of a domain, or all that have it."""
    found = links.where((F.col("key") == key) & F.col("archived_at").isNull())
    found = found if domain is None else found.where(F.col("domain") == domain)
    return found if workspace is None else found.where(F.col("workspace_id") == workspace)


def resolve_live_link(links: DataFrame, key: str, now: datetime, domain: str | None = None) -> DataFrame:
    """A link that is neither archived nor expired; none where a key alone is ambiguous."""
    found = get_link(links, key, domain).where(F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now)))
    return found.withColumn("__n", F.count("*").over(Window.partitionBy("key"))).where("__n = 1").drop("__n")


def list_live(rows: DataFrame, workspace: str = DEFAULT_WORKSPACE, limit: int = 50, offset: int = 0) -> DataFrame:
    """Links, partners or funnels that aren't archived, newest first."""
    return newest_first(rows.where((F.col("workspace_id") == workspace) & F.col("archived_at").isNull()), limit=limit, offset=offset)


def link_clicks(events: DataFrame, link_id: object, limit: int = 50, offset: int = 0) -> DataFrame:
    return newest_first(events.where((F.col("link_id") == link_id) & (F.col("event_type") == "link_click")), limit=limit, offset=offset)


def active_partners(partners: DataFrame, workspace: str = DEFAULT_WORKSPACE, key: str | None = None) -> DataFrame:
    live = partners.where((F.col("workspace_id") == workspace) & (F.col("status") == "active") & F.col("archived_at").isNull())
    return live if key is None else live.where(F.col("key") == key)


def archive(rows: DataFrame, ids: list, now: datetime) -> DataFrame:
    """rows with archived_at set for ids that aren't archived yet."""
    hit = F.col("id").isin(list(ids)) & F.col("archived_at").isNull()
    return rows.withColumn("archived_at", F.when(hit, F.lit(now)).otherwise(F.col("archived_at")))


def first_values(events: DataFrame, column: str) -> DataFrame:
    """(visitor_id, column): the earliest non-empty map of each visitor's events."""
    order = F.when(~empty_map(F.col(column)), F.struct("inserted_at", "id"))
    return events.groupBy("visitor_id").agg(F.min_by(column, order).alias(column)).where(F.col(column).isNotNull())


def set_if_empty(visitors: DataFrame, values: DataFrame, column: str) -> DataFrame:
    """visitors whose empty geo or device takes that of values (visitor_id, column)."""
    given = values.select(F.col("visitor_id").alias("v_id"), F.col(column).alias("v_new"))
    found = visitors.join(given, visitors["id"] == given["v_id"], "left")
    return found.withColumn(column, F.when(empty_map(F.col(column)), F.coalesce("v_new", column)).otherwise(F.col(column))).drop("v_id", "v_new")


def partner_touches(events: DataFrame) -> DataFrame:
    """visitor_id with first_partner_id and last_partner_id of its referred events."""
    order = F.when(F.col("partner_id").isNotNull(), F.struct("inserted_at", "id"))
    found = events.groupBy("visitor_id").agg(F.min_by("partner_id", order).alias("first_partner_id"), F.max_by("partner_id", order).alias("last_partner_id"))
    return found.where(F.col("first_partner_id").isNotNull())


def set_partners(visitors: DataFrame, touches: DataFrame) -> DataFrame:
    """visitors after touches: the last partner always changes, the first only where there was none."""
    given = touches.select(F.col("visitor_id").alias("t_id"), F.col("first_partner_id").alias("t_first"), F.col("last_partner_id").alias("t_last"))
    found = visitors.join(given, visitors["id"] == given["t_id"], "left")
    return found.withColumns({"first_partner_id": F.coalesce("first_partner_id", "t_first"), "last_partner_id": F.coalesce("t_last", "last_partner_id")}).drop("t_id", "t_first", "t_last")


def partner_snapshot(token_partner: Column, visitor_partner: Column) -> Column:
    """The partner an event is credited to: the referral token's, else the visitor's last."""
    return F.coalesce(token_partner, visitor_partner)


def backfill_fingerprints(events: DataFrame, found: DataFrame) -> DataFrame:
    """events whose link clicks without fingerprint take that of found (click_id, fingerprint)."""
    given = found.groupBy("click_id").agg(F.min("fingerprint").alias("f_new"))
    joined = events.join(given, "click_id", "left")
    empty = (F.col("event_type") == "link_click") & F.col("fingerprint").isNull()
    return joined.withColumn("fingerprint", F.when(empty, F.col("f_new")).otherwise(F.col("fingerprint"))).select(*events.columns)


def visitor_rollups(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """An extension: visitor_id with total_events, total_pageviews, ltv_cents, total_sessions, total_time_seconds."""
    sale = F.when(F.col("event_type") == "sale", F.coalesce("amount_cents", F.lit(0)))
    made = events.groupBy("visitor_id").agg(F.count("*").alias("total_events"), F.count_if(F.col("event_type") == "pageview").alias("total_pageviews"), F.coalesce(F.sum(sale), F.lit(0)).alias("ltv_cents"))
    held = sessions.groupBy("visitor_id").agg(F.count("*").alias("total_sessions"), F.sum("duration_seconds").alias("total_time_seconds"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return made.join(held, "visitor_id", "left").select("visitor_id", "total_events", "total_pageviews", "ltv_cents", zero("total_sessions"), zero("total_time_seconds"))


def visitor_engagement(events: DataFrame, top: int = 5) -> DataFrame:
    """An extension: visitor_id, avg_scroll_depth (of valid scroll_depth properties) and top_pages, the paths with most pageviews, ties by path.

    Views are counted by visitor and path first, so a list holds top entries at most.
    """
    depth = scroll_guard(F.try_element_at("properties", F.lit("scroll_depth")).try_cast("double"))
    scrolled = events.groupBy("visitor_id").agg(F.avg(depth).alias("avg_scroll_depth"))
    views = events.where((F.col("event_type") == "pageview") & F.col("path").isNotNull()).groupBy("visitor_id", "path").agg(F.count("*").alias("pageviews"))
    ranked = views.withColumn("n", F.row_number().over(Window.partitionBy("visitor_id").orderBy(F.desc("pageviews"), "path"))).where(F.col("n") <= top)
    listed = ranked.groupBy(F.col("visitor_id").alias("t_id")).agg(F.array_sort(F.collect_list(F.struct("n", "path", "pageviews"))).alias("found"))
    pages = listed.select("t_id", F.transform("found", lambda x: F.create_map(F.lit("path"), x["path"], F.lit("pageviews"), x["pageviews"].cast("string"))).alias("top_pages"))
    none = F.array().cast("array<map<string,string>>")
    joined = scrolled.join(pages, scrolled["visitor_id"].eqNullSafe(pages["t_id"]), "left")
    return joined.select("visitor_id", "avg_scroll_depth", F.coalesce("top_pages", none).alias("top_pages"))


def session_paths(stamped: DataFrame) -> DataFrame:
    """An extension: session_id and the paths of its pageviews, leads and sales in order."""
    shown = stamped.where(F.col("event_type").isin("pageview", "lead", "sale"))
    steps = F.array_sort(F.collect_list(F.struct("inserted_at", "id", "path")))
    return shown.groupBy("session_id").agg(F.transform(steps, lambda x: x["path"]).alias("paths"))


def forget(visitors: DataFrame, events: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visitors, events) after ids (visitor_id) are forgotten: events go, the row stays without what identifies it."""
    epoch = F.lit(datetime(1970, 1, 1, tzinfo=UTC)).cast("timestamp")
    wanted = ids.select(F.col("visitor_id").alias("f_id")).distinct()
    marked = visitors.join(wanted, visitors["id"] == wanted["f_id"], "left")
    blank = {c: "array" for c in ("fingerprints", "anonymous_ids", "click_ids", "attribution_path")} | {c: "map" for c in ("person_metadata", "click_id_params", "geo", "device")}
    blank |= {c: "null" for c in ("ga_id", "person_external_id", "person_email", "person_name", "first_source", "last_source", "identified_at", "converted_at")}
    kinds = dict(visitors.dtypes)
    new = {}
    for c, kind in blank.items():
        if c in kinds:
            value = {"array": F.array(), "map": F.create_map(), "null": F.lit(None)}[kind].cast(kinds[c])
            new[c] = F.when(F.col("f_id").isNotNull(), value).otherwise(F.col(c))
    new |= {c: F.when(F.col("f_id").isNotNull(), epoch).otherwise(F.col(c)) for c in ("first_seen_at", "last_seen_at") if c in kinds}
    new["status"] = F.when(F.col("f_id").isNotNull(), "anonymous").otherwise(F.col("status"))
    kept = events.join(wanted, events["visitor_id"] == wanted["f_id"], "left_anti")
    return marked.withColumns(new).select(*visitors.columns), kept
