"""Further registered queries: lookups, writes, ingest steps, functions, dispatches and streams over the test tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import urls, values
from wayfarer.operators import connectors, events, identity, people
from wayfarer.plans.adapter import GAP_SECONDS, Tables
from wayfarer.plans.schemas import DEFAULT_WORKSPACE
from wayfarer.plans.scratch import scratch_path
from wayfarer.queries import NOW, QUERIES, SESSION_COLUMNS, _counted_clicks, query
from wayfarer.sources import records, tables
from wayfarer.sources.batches import Batches
from wayfarer.streaming import sessions as streams

AGENT = "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 Version/17.2 Mobile/15E148 Safari/604.1"


def text(c: str) -> Column:
    return F.col(c).cast("string")


# Lookups.


@query("event_by_idempotency_key", "SELECT id, event_type FROM a_events WHERE id = 123")
def _(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("properties", F.create_map(F.lit("_idempotency_key"), F.concat(F.lit("k"), text("id"))))
    return events.by_idempotency_key(keyed, "k123").select("id", "event_type")


@query("visitor_by_id", "SELECT id, status, last_seen_at FROM a_visitors WHERE id = 17")
def _(t: Tables) -> DataFrame:
    return people.get_visitor(t.visitors, 17, DEFAULT_WORKSPACE).select("id", "status", "last_seen_at")


@query("visitor_by_external_id", "SELECT id, person_external_id FROM a_visitors WHERE status <> 'merged' AND person_external_id = 'x44' AND id = 44")
def _(t: Tables) -> DataFrame:
    return people.by_external_id(t.visitors.where("id <> 45"), "x44").select("id", "person_external_id")


def links(t: Tables) -> DataFrame:
    """Parts as links: two domains share each key; some are archived, some have expired."""
    at = lambda day: F.lit(datetime(2024, 1, day, tzinfo=UTC)).cast("timestamp")
    return t.raw("part").select(
        F.col("p_partkey").alias("id"),
        F.lit(DEFAULT_WORKSPACE).alias("workspace_id"),
        F.concat(F.lit("d"), (F.col("p_partkey") % 2).cast("string")).alias("domain"),
        F.concat(F.lit("k"), F.floor(F.col("p_partkey") / 2).cast("string")).alias("key"),
        F.when(F.col("p_partkey") % 7 == 0, at(2)).alias("archived_at"),
        F.when(F.col("p_partkey") % 5 == 0, at(3)).alias("expires_at"),
        (at(1) + F.make_dt_interval(secs=F.col("p_partkey") % 1000)).alias("inserted_at"),
    )


@query("links_live", "SELECT p_partkey AS id FROM part WHERE p_partkey % 7 <> 0 ORDER BY p_partkey % 1000 DESC, p_partkey DESC LIMIT 50 OFFSET 5")
def _(t: Tables) -> DataFrame:
    return people.list_live(links(t), offset=5).select("id")


@query("links_of_a_key", "SELECT p_partkey AS id FROM part WHERE p_partkey // 2 = 30 AND p_partkey % 7 <> 0")
def _(t: Tables) -> DataFrame:
    return people.get_link(links(t), "k30").select("id")


@query("link_to_follow", "SELECT p_partkey AS id FROM part WHERE p_partkey = 62")
def _(t: Tables) -> DataFrame:
    """Neither archived nor expired; a key of two domains names its domain."""
    return people.resolve_live_link(links(t), "k31", NOW, "d0").select("id")


@query("links_archived", "SELECT count(*) AS links, count(*) FILTER (WHERE p_partkey % 7 = 0 OR p_partkey < 40) AS archived, count(*) FILTER (WHERE p_partkey < 40 AND p_partkey % 7 <> 0) AS archived_now FROM part")
def _(t: Tables) -> DataFrame:
    now = people.archive(links(t), list(range(40)), NOW)
    return now.agg(F.count("*").alias("links"), F.count("archived_at").alias("archived"), F.count_if(F.col("archived_at") == F.lit(NOW)).alias("archived_now"))


@query("partners_active", "SELECT s_suppkey AS id FROM supplier WHERE s_suppkey % 3 <> 0 AND s_suppkey % 4 <> 0")
def _(t: Tables) -> DataFrame:
    rows = t.raw("supplier").select(F.col("s_suppkey").alias("id"), F.lit(DEFAULT_WORKSPACE).alias("workspace_id"), text("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 3 == 0, "disabled").otherwise("active").alias("status"), F.when(F.col("s_suppkey") % 4 == 0, F.current_timestamp()).alias("archived_at"))
    return people.active_partners(rows).select("id")


# Writes.


@query(
    "links_created",
    """SELECT outcome, count(*) AS links FROM (SELECT coalesce(CASE WHEN p_partkey % 11 = 0 THEN 'url must be a valid HTTP or HTTPS URL' WHEN p_partkey % 13 = 0 THEN 'link_type is unknown' WHEN p_partkey % 17 = 0 THEN 'partner_id is required for referral links'
      WHEN row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey::VARCHAR) > 1 THEN 'key is taken' END, 'ok') AS outcome FROM part) x GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    n = F.col("p_partkey")
    rows = t.raw("part").select(text("p_partkey").alias("id"), F.lit(DEFAULT_WORKSPACE).alias("workspace_id"), F.lit("d").alias("domain"), F.concat(F.lit("k"), F.floor(n / 2).cast("string")).alias("key"), F.when(n % 11 == 0, "ftp://x").otherwise("https://x.org/").alias("url"), *[F.lit(None).cast("string").alias(c) for c in ("ios_url", "android_url", "partner_id")], F.lit(None).cast("map<string,string>").alias("geo_targeting"), F.when(n % 13 == 0, "odd").when(n % 17 == 0, "referral").otherwise("short").alias("link_type"), F.lit(NOW).cast("timestamp").alias("inserted_at"))
    good, bad = records.create_links(rows)
    return good.select(F.lit("ok").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("links"))


@query("fingerprints_backfilled", "SELECT id, CASE WHEN event_type = 'link_click' AND id % 2 = 0 AND click_id IS NOT NULL THEN 'f' || click_id WHEN id % 2 = 1 THEN 'own' END AS fingerprint FROM a_events")
def _(t: Tables) -> DataFrame:
    held = t.events.withColumn("fingerprint", F.when(F.col("id") % 2 == 1, "own"))
    found = t.events.where("click_id IS NOT NULL").select("click_id", F.concat(F.lit("f"), F.col("click_id")).alias("fingerprint"))
    return people.backfill_fingerprints(held, found).select("id", "fingerprint")


@query("geo_first_wins", "SELECT v.id, coalesce(v.country_code, f.code) AS country_code FROM a_visitors v LEFT JOIN (SELECT visitor_id, arg_min('C' || id % 9, (inserted_at, id)) AS code FROM a_events WHERE id % 3 = 0 GROUP BY 1) f ON f.visitor_id = v.id")
def _(t: Tables) -> DataFrame:
    seen = t.events.withColumn("geo", F.when(F.col("id") % 3 == 0, F.create_map(F.lit("country_code"), F.concat(F.lit("C"), (F.col("id") % 9).cast("string")))).otherwise(F.create_map().cast("map<string,string>")))
    found = people.set_if_empty(t.visitors, people.first_values(seen, "geo"), "geo")
    return found.select("id", F.try_element_at("geo", F.lit("country_code")).alias("country_code"))


@query("partners_set", "SELECT v.id, coalesce(CASE WHEN v.id % 2 = 0 THEN 99 END, f.a) AS first_partner_id, coalesce(f.b, CASE WHEN v.id % 2 = 0 THEN 99 END) AS last_partner_id FROM a_visitors v LEFT JOIN (SELECT visitor_id, arg_min(partner_id, (inserted_at, id)) AS a, arg_max(partner_id, (inserted_at, id)) AS b FROM a_events WHERE partner_id IS NOT NULL GROUP BY 1) f ON f.visitor_id = v.id")
def _(t: Tables) -> DataFrame:
    even = F.when(F.col("id") % 2 == 0, 99)
    held = t.visitors.withColumns({"first_partner_id": even, "last_partner_id": even})
    return people.set_partners(held, people.partner_touches(t.events)).select("id", F.col("first_partner_id").cast("long"), F.col("last_partner_id").cast("long"))


@query("devices_backfilled", "SELECT id, CASE WHEN device_type IS NOT NULL THEN device_type WHEN id % 2 = 1 THEN 'smartphone' WHEN id % 4 = 0 THEN 'unknown' END AS device_type FROM a_events")
def _(t: Tables) -> DataFrame:
    agent = F.when(F.col("id") % 2 == 1, AGENT).when(F.col("id") % 4 == 0, "odd")
    return tables.backfill_devices(t.events.withColumn("user_agent", agent)).select("id", "device_type")


@query("setting_read", "SELECT arg_max(event_id, (ts, event_id))::VARCHAR AS value FROM events WHERE user_id % 20 = 7")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.lit("w").alias("workspace_id"), (F.col("user_id") % 20).cast("string").alias("key"), text("event_id").alias("value"), F.col("ts").cast("timestamp").alias("updated_at"))
    return tables.setting(tables.upsert_settings(rows.limit(0), rows), "w", "7")


# Ingest.


@query("visitor_precedence", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN (SELECT max(v.id) FROM a_visitors v WHERE v.id = o_custkey % 100) WHEN 1 THEN (SELECT min(v.id) FROM a_visitors v WHERE v.status <> 'merged' AND v.person_external_id = 'x' || (o_custkey % 60)) WHEN 2 THEN 5 END AS resolved_id, CASE WHEN o_orderkey % 4 = 3 THEN '422' END AS refused FROM orders WHERE o_orderkey % 4 > 1 OR true")
def _(t: Tables) -> DataFrame:
    which = F.col("o_orderkey") % 4
    asked = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.lit(DEFAULT_WORKSPACE).alias("workspace_id"), F.when(which == 0, F.col("o_custkey") % 100).alias("visitor_id"), F.when(which == 1, F.format_string("x%d", F.col("o_custkey") % 60)).alias("external_id"), F.when(which == 2, 5).cast("long").alias("signal_visitor_id"))
    found = tables.resolve_visitors(asked, t.visitors)
    return found.select("id", F.col("resolved_id").cast("long").alias("resolved_id"), F.when(F.col("error").startswith("422"), "422").alias("refused"))


@query("partner_fields_trusted", "SELECT id, CASE WHEN id % 2 = 0 THEN partner_id END AS partner_id FROM a_events")
def _(t: Tables) -> DataFrame:
    return tables.trusted_fields(t.events.withColumn("trusted", F.col("id") % 2 == 0)).select("id", "partner_id")


@query("partner_snapshots", "SELECT id, coalesce(partner_id, visitor_id % 5) AS partner_id FROM a_events")
def _(t: Tables) -> DataFrame:
    return t.events.select("id", people.partner_snapshot(F.col("partner_id").cast("long"), F.col("visitor_id") % 5).alias("partner_id"))


@query("api_requests", "SELECT page_id, 'api_request' AS event_type, upper(CASE page_id % 2 WHEN 0 THEN 'get' ELSE 'post' END) || ' /v1/' || page_id % 9 AS event_name, (200 + page_id % 4)::VARCHAR AS status FROM pages")
def _(t: Tables) -> DataFrame:
    n = F.col("page_id")
    made = tables.request_events(t.raw("pages").select("page_id", F.when(n % 2 == 0, "get").otherwise("post").alias("method"), F.concat(F.lit("/v1/"), (n % 9).cast("string")).alias("path"), (200 + n % 4).alias("status")))
    return made.select("page_id", "event_type", "event_name", F.col("properties")["status"].alias("status"))


@query("property_guards", "SELECT id, CASE WHEN id % 300 BETWEEN 0 AND 100 THEN id % 300 END AS scroll, CASE WHEN id * 1000 BETWEEN 0 AND 1800000 THEN id * 1000 END AS engaged, CASE WHEN id % 200 BETWEEN 1 AND 100 THEN (id % 200) END AS name_bytes, least(id % 70, 50) AS properties, left(repeat('s', (id % 300)::INT), 255) AS source, CASE WHEN url <> '' AND length(url || repeat('x', (id % 2100)::INT)) <= 2083 THEN id % 2100 END AS url_chars FROM a_events")
def _(t: Tables) -> DataFrame:
    n = F.col("id")
    many = F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.format_string("k%02d", i)), F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: F.when(i <= n % 70, "v")))
    url = F.concat("url", F.repeat(F.lit("x"), (n % 2100).cast("int")))
    return t.events.select(
        "id",
        values.scroll_guard(n % 300).alias("scroll"),
        values.engaged_ms_guard(n * 1000).alias("engaged"),
        F.octet_length(values.event_name_guard(F.repeat(F.lit("n"), (n % 200).cast("int")))).cast("long").alias("name_bytes"),
        F.size(values.sanitized_properties(many)).cast("long").alias("properties"),
        values.source_text(F.repeat(F.lit("s"), (n % 300).cast("int"))).alias("source"),
        F.when(values.url_guard(url).isNotNull(), n % 2100).alias("url_chars"),
    )


# Functions.


@query("url_fallbacks", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'own' ELSE lower(split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1)) END AS host, CASE WHEN page_id % 3 = 0 THEN '/own' ELSE coalesce(nullif(split_part(split_part(regexp_replace(url, '^https?://[^/]+', ''), '?', 1), '#', 1), ''), '/') END AS path FROM pages")
def _(t: Tables) -> DataFrame:
    rows = t.raw("pages").select("page_id", "url", F.when(F.col("page_id") % 2 == 0, "own").alias("host"), F.when(F.col("page_id") % 3 == 0, "/own").alias("path"))
    return rows.select("page_id", urls.event_host().alias("host"), urls.event_path().alias("path"))


@query("url_parameters", "SELECT event_id AS id, event_id % 7 AS a, 'x y' AS b, 60 + event_id % 20 AS parameters FROM events")
def _(t: Tables) -> DataFrame:
    """Some addresses have more than a hundred parameters, each of them twice."""
    n = F.col("event_id")
    twice = F.array_join(F.transform(F.sequence(F.lit(1), 58 + n % 20), lambda i: F.concat(F.lit("p"), i.cast("string"), F.lit("=old&p"), i.cast("string"), F.lit("=new"))), "&")
    url = F.concat(F.lit("https://x.org/?a=0&"), twice, F.lit("&b=x+y&a="), (n % 7).cast("string"), F.lit("#a=9"))
    ids = t.raw("events").select("event_id").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "event_id")  # little to read, much to compute
    found = ids.select(n.alias("id"), urls.query_params(url).alias("q"))
    return found.select("id", F.col("q")["a"].cast("long").alias("a"), F.col("q")["b"].alias("b"), F.size(F.map_filter("q", lambda k, v: (v == "new") | k.isin("a", "b"))).cast("long").alias("parameters"))


@query("redirects", "SELECT page_id, 'https://d.org/x?a=' || page_id % 3 || '&ga_id=c' || page_id || '&utm_source=link&z=ok' AS url FROM pages")
def _(t: Tables) -> DataFrame:
    n = text("page_id")
    base = F.lit("https://d.org/x?a=9&utm_source=own")
    given = F.create_map(F.lit("a"), (F.col("page_id") % 3).cast("string"), F.lit("via"), F.lit("no"), F.lit("z"), F.lit("ok"))
    params = urls.redirect_params(urls.query_params(base), F.create_map(F.lit("utm_source"), F.lit("link")), given, F.concat(F.lit("c"), n))
    return t.raw("pages").select("page_id", urls.redirect_url(base, params).alias("url"))


@query("destinations", "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'https://de.org/' WHEN page_id % 3 = 0 THEN 'ios' WHEN page_id % 3 = 1 THEN 'android' ELSE url END AS url FROM pages")
def _(t: Tables) -> DataFrame:
    n = F.col("page_id")
    agent = F.when(n % 3 == 0, "x iPhone y").when(n % 3 == 1, "Android").otherwise("other")
    found = urls.destination(agent, F.col("url"), F.lit("ios"), F.lit("android"), F.create_map(F.lit("DE"), F.lit("https://de.org/"), F.lit("FR"), F.lit("odd")), F.when(n % 5 == 0, "de").when(n % 5 == 1, "fr"))
    return t.raw("pages").select("page_id", found.alias("url"))


@query("uuids_checked", "SELECT id, CASE WHEN id % 3 <> 0 THEN lpad(id::VARCHAR, 8, '0') || '-0000-0000-0000-000000000abc' END AS uuid FROM a_events")
def _(t: Tables) -> DataFrame:
    given = F.concat(F.lpad(text("id"), 8, "0"), F.when(F.col("id") % 3 == 0, "-0000").when(F.col("id") % 3 == 1, "-0000-0000-0000-000000000ABC").otherwise("000000000000000000000abc"))
    return t.events.select("id", values.uuid_or_null(given).alias("uuid"))


@query("lists_and_maps", "SELECT id, 'v' || id % 4 || CASE WHEN id % 4 = 0 THEN ',v1,v2' WHEN id % 4 = 1 THEN ',v2' WHEN id % 4 = 2 THEN ',v1' ELSE ',v1,v2' END AS added, (id % 4 IN (1, 2)) AS held, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS merged, least(60, 50) AS touchpoints FROM a_events")
def _(t: Tables) -> DataFrame:
    n = F.col("id")
    value, pair = F.concat(F.lit("v"), (n % 4).cast("string")), F.array(F.lit("v1"), F.lit("v2"))
    merged = values.merge_maps(F.create_map(F.lit("a"), F.lit("old")), F.when(n % 2 == 0, F.create_map(F.lit("a"), F.lit("new"))))
    return t.events.select("id", F.array_join(values.add_unique(pair, value), ",").alias("added"), F.array_contains(pair, value).alias("held"), merged["a"].alias("merged"), F.size(values.last_touchpoints(F.sequence(F.lit(1), F.lit(60)))).alias("touchpoints"))


# Dispatches.


def dispatches(t: Tables) -> DataFrame:
    """Sales as dispatches in all states."""
    n = F.col("id")
    status = F.element_at(F.array(*[F.lit(x) for x in ("pending", "failed", "rate_limited", "delivered", "permanently_failed", "credential_error")]), (n % 6 + 1).cast("int"))
    retry = F.when(n % 4 != 0, F.lit(NOW).cast("timestamp") + F.make_dt_interval(secs=n % 200 - 100))
    return t.events.where("event_type = 'sale'").select(text("id").alias("id"), "workspace_id", F.lit("meta").alias("connector_type"), text("id").alias("event_id"), status.alias("status"), (n % 7).cast("int").alias("attempts"), F.lit(5).alias("max_attempts"), retry.alias("next_retry_at"), "inserted_at")


@query("dispatch_queue", "SELECT id::VARCHAR AS id FROM a_events WHERE event_type = 'sale' AND id % 6 < 3 AND id % 7 < 5 AND (id % 4 = 0 OR id % 200 <= 100) ORDER BY CASE WHEN id % 4 <> 0 THEN id % 200 END NULLS LAST, inserted_at, id::VARCHAR LIMIT 100")
def _(t: Tables) -> DataFrame:
    return connectors.list_pending(dispatches(t), NOW).select("id")


@query("dispatches_of_a_workspace", "SELECT id::VARCHAR AS id FROM a_events WHERE event_type = 'sale' AND id % 6 IN (1, 4) ORDER BY inserted_at DESC, id::VARCHAR DESC LIMIT 50")
def _(t: Tables) -> DataFrame:
    return connectors.list_by_workspace(dispatches(t), DEFAULT_WORKSPACE, "meta", ("failed", "permanently_failed")).select("id")


@query("dispatches_replayed", "SELECT id::VARCHAR AS replayed_from_id, 'pending' AS status, 0 AS attempts FROM a_events WHERE event_type = 'sale' AND id % 6 IN (1, 4) ORDER BY inserted_at DESC, id::VARCHAR DESC LIMIT 1000")
def _(t: Tables) -> DataFrame:
    return connectors.replay(dispatches(t), F.lit(NOW).cast("timestamp"), "meta").select("replayed_from_id", "status", "attempts")


@query("credential_errors", "SELECT true AS has_errors FROM a_events WHERE event_type = 'sale' AND id % 6 = 5 LIMIT 1")
def _(t: Tables) -> DataFrame:
    return connectors.credential_errors(dispatches(t), "meta", DEFAULT_WORKSPACE)


@query("source_contexts", "SELECT id, 'g' || id AS gclid, strftime(inserted_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS captured_at, amount_cents FROM a_events WHERE event_type = 'sale'")
def _(t: Tables) -> DataFrame:
    signals = F.create_map(F.lit("gclid"), F.concat(F.lit("g"), text("id")))
    context = connectors.source_context(signals, {"amount_cents": F.col("amount_cents")}, F.col("inserted_at"))
    found = t.events.where("event_type = 'sale'").select("id", context.alias("c"))
    return found.select("id", connectors.context_signals(F.col("c"))["gclid"].alias("gclid"), values.json_text(F.col("c"), "captured_at").alias("captured_at"), values.json_text(F.col("c"), "amount_cents").cast("long").alias("amount_cents"))


# Identity.


def signals(t: Tables) -> DataFrame:
    return t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.lit(DEFAULT_WORKSPACE).alias("workspace_id"), F.concat(F.lit("f"), (F.col("o_orderkey") % 50).cast("string")).alias("fingerprint"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("c"), text("o_orderkey"))).alias("click_id"))


@query("visitors_created", "SELECT 'v' || o_orderkey AS id, 'f' || o_orderkey % 50 AS fingerprint, CASE WHEN o_orderkey % 2 = 0 THEN 'c' || o_orderkey END AS click_id, 'anonymous' AS status FROM orders")
def _(t: Tables) -> DataFrame:
    made = identity.create_visitors(signals(t), F.concat(F.lit("v"), text("request_id")), F.lit(NOW).cast("timestamp"))
    return made.select("id", F.get("fingerprints", F.lit(0)).alias("fingerprint"), F.get("click_ids", F.lit(0)).alias("click_id"), "status")


@query("visitors_updated", "SELECT v.id, 'f' || r.o % 50 || ',old' AS fingerprints, coalesce(CASE WHEN r.o % 2 = 0 THEN 'c' || r.o END, 'none') AS last_click_id FROM a_visitors v JOIN (SELECT o_custkey AS id, max(o_orderkey) AS o FROM orders GROUP BY 1) r USING (id) UNION ALL SELECT id, 'old', 'none' FROM a_visitors WHERE id NOT IN (SELECT o_custkey FROM orders)")
def _(t: Tables) -> DataFrame:
    latest = t.raw("orders").groupBy(F.col("o_custkey").alias("visitor_id")).agg(F.max("o_orderkey").alias("request_id"))
    held = t.visitors.withColumns({"fingerprints": F.array(F.lit("old")), "last_click_id": F.lit("none")})
    found = identity.update_visitors(held, signals(t).join(latest, "request_id"), F.lit(NOW).cast("timestamp"))
    return found.select("id", F.array_join("fingerprints", ",").alias("fingerprints"), "last_click_id")


@query("visitors_merged", "SELECT id - id % 10 AS id, string_agg('f' || id % 7, ',' ORDER BY first_seen_at, id) AS every, count(*) AS members, max(last_seen_at) AS last_seen_at FROM a_visitors WHERE id // 10 * 10 IN (SELECT id FROM a_visitors) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    """Visitors of one ten are merged into its first; values of their own (no two alike) show the order."""
    held = t.visitors.where("status IS NOT NULL").withColumns({"fingerprints": F.array(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit("#"), text("id"))), "status": F.lit("anonymous"), "merged_into_id": F.lit(None).cast("long")})
    firsts = held.select(F.col("id").alias("first")).where("first % 10 = 0")
    groups = held.select(F.col("id").alias("visitor_id"), (F.col("id") - F.col("id") % 10).alias("survivor_id")).join(firsts, F.col("survivor_id") == F.col("first"), "left_semi")
    merged = identity.merge(held, groups)
    sizes = groups.groupBy(F.col("survivor_id").alias("id")).agg(F.count("*").alias("members"))
    return merged.join(sizes, "id").select("id", F.array_join(F.transform("fingerprints", lambda x: F.split_part(x, F.lit("#"), F.lit(1))), ",").alias("every"), "members", "last_seen_at")


@query("events_repointed", "SELECT visitor_id - visitor_id % 10 AS visitor_id, count(*) AS events FROM a_events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    groups = t.visitors.select(F.col("id").alias("visitor_id"), (F.col("id") - F.col("id") % 10).alias("survivor_id"))
    return identity.repoint(t.events, groups).groupBy("visitor_id").agg(F.count("*").alias("events"))


@query("visitors_identified", "SELECT count(*) FILTER (WHERE id % 10 < 5) AS identified, count(*) FILTER (WHERE id % 10 >= 5) AS anonymous FROM a_visitors")
def _(t: Tables) -> DataFrame:
    """Half of the visitors become persons, each with an e-mail of its own."""
    held = t.visitors.withColumns({"status": F.lit("anonymous"), "merged_into_id": F.lit(None).cast("long"), "person_email": F.lit(None).cast("string"), "person_external_id": F.lit(None).cast("string"), "identified_at": F.lit(None).cast("timestamp")})
    persons = held.where("id % 10 < 5").select(F.col("id").alias("visitor_id"), F.concat(text("id"), F.lit("@x.org")).alias("person_email"))
    after, _groups = identity.identify(held, persons, F.lit(NOW).cast("timestamp"))
    return after.agg(F.count_if(F.col("status") == "identified").alias("identified"), F.count_if(F.col("status") == "anonymous").alias("anonymous"))


# Streams: the table is read as one, to its end.


def streamed(t: Tables, rows: DataFrame, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream over rows has put out when all is read: a late event lets the watermark pass everything."""
    path = scratch_path(t.spark, "stream")
    rows.write.parquet(f"{path}/in")
    last = rows.where("id = 1").withColumns({"id": F.lit(-1).cast("long"), "visitor_id": F.lit(-1).cast("long"), "inserted_at": F.lit(datetime(2030, 1, 1, tzinfo=UTC)).cast("timestamp")})
    last.write.mode("append").parquet(f"{path}/in")
    stream = made(t.spark.readStream.schema(rows.schema).parquet(f"{path}/in"))
    out = Batches(path, "out", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema))
    streams.deliver(stream, lambda batch, number: out.append(batch, number), f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return out.read(t.spark).drop("query", "batch")


STREAMED = tuple(c for c in SESSION_COLUMNS if c not in ("source_platform", "source_medium", "device_type", "browser"))


@query("streamed_sessions", f"SELECT {', '.join(STREAMED)} FROM a_sessions")
def _(t: Tables) -> DataFrame:
    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    streams.use_keyed_state(t.spark)
    try:
        found = streamed(t, t.events.drop("engaged_ms", "host", "props"), lambda s: streams.sessionize(s, GAP_SECONDS))
    finally:
        t.spark.conf.set(name, before)
    return found.where("visitor_id <> '-1'").withColumn("visitor_id", F.col("visitor_id").cast("long")).select(*STREAMED)


@query("streamed_counts", "SELECT time_bucket(INTERVAL '6 hours', inserted_at) AS bucket_start, count(*) AS events, count(*) FILTER (WHERE event_type = 'pageview') AS pageviews FROM a_events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    found = streamed(t, t.events.select("id", "visitor_id", "event_type", "inserted_at"), lambda s: streams.counts(s, "6 hours"))
    return found.where(F.year("bucket_start") < 2030).select("bucket_start", "events", "pageviews")


@query("streamed_clicks", f"{_counted_clicks('id')} SELECT id FROM w WHERE is_unique")
def _(t: Tables) -> DataFrame:
    rows = t.events.select("id", "visitor_id", "ip_address", "link_id", "event_type", "inserted_at")
    found = streamed(t, rows, lambda s: streams.unique_clicks(s.where("event_type = 'link_click'")))
    return found.select(F.col("id").cast("long").alias("id")).where("id > 0")
