"""The registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions import devices, traffic, urls, values
from wayfarer.operators import audience, clicks, connectors, events, funnels, identity, kpis, people, replay, sessions, timeseries
from wayfarer.operators.base import scan_events, with_visitors
from wayfarer.plans import adapter
from wayfarer.plans.adapter import GAP_SECONDS, Tables
from wayfarer.plans.filters import Funnel, SourceFilter, Step, StepFilter
from wayfarer.plans.schemas import DEFAULT_WORKSPACE, DISPATCHES
from wayfarer.plans.scratch import scratch_path, written
from wayfarer.plans.windows import TimeWindow
from wayfarer.sources import tables
from wayfarer.sources.batches import Batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WINDOW = TimeWindow(datetime(2024, 1, 8, tzinfo=UTC), datetime(2024, 1, 22, tzinfo=UTC))
WHOLE = TimeWindow(datetime(2020, 1, 1, tzinfo=UTC), datetime(2030, 1, 1, tzinfo=UTC))
NOW = datetime(2024, 1, 29, tzinfo=UTC)

# What oracles build on.
_EV = adapter.EVENTS.format(events="events", pages="pages")
_VI = adapter.VISITORS.format(events="events")
IN = "e.inserted_at >= TIMESTAMP '2024-01-08' AND e.inserted_at < TIMESTAMP '2024-01-22'"
SES_IN = "started_at >= TIMESTAMP '2024-01-08' AND started_at < TIMESTAMP '2024-01-22'"


def stamp_sql(gap: int, rows: str = "a_events", tag: str = "") -> str:
    """The tables that lead from events (rows) to sessions, with a gap of so many seconds; tag comes before their names."""
    return f"""
{tag}s1 AS (SELECT *, epoch_us(inserted_at) AS us, lag(epoch_us(inserted_at)) OVER (PARTITION BY visitor_id ORDER BY inserted_at, id) AS prev,
  CASE WHEN coalesce(nullif(nullif(source_platform, ''), 'direct'), nullif(nullif(source_medium, ''), 'direct'), source_campaign, click_id) IS NOT NULL
    THEN concat_ws('|', coalesce(nullif(source_platform, 'direct'), ''), coalesce(nullif(source_medium, 'direct'), ''), coalesce(source_campaign, ''), coalesce(click_id, '')) END AS acq FROM {rows}),
{tag}s2 AS (SELECT *, CASE WHEN prev IS NULL OR us - prev > {gap}000000 THEN 1 ELSE 0 END AS fresh FROM {tag}s1),
{tag}s3 AS (SELECT *, sum(fresh) OVER (PARTITION BY visitor_id ORDER BY inserted_at, id ROWS UNBOUNDED PRECEDING) AS island FROM {tag}s2),
{tag}s4 AS (SELECT *, last_value(acq IGNORE NULLS) OVER (PARTITION BY visitor_id, island ORDER BY inserted_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM {tag}s3),
{tag}s5 AS (SELECT *, CASE WHEN fresh = 1 OR (acq IS NOT NULL AND was IS NOT NULL AND acq <> was) THEN 1 ELSE 0 END AS starts FROM {tag}s4),
{tag}stamped AS (SELECT *, sum(starts) OVER (PARTITION BY visitor_id ORDER BY inserted_at, id ROWS UNBOUNDED PRECEDING) AS n,
  CASE WHEN starts = 1 THEN 0 ELSE least((us - prev) // 1000000, {gap}) END AS hop FROM {tag}s5),
{tag}a_sessions AS (SELECT visitor_id, min(inserted_at) AS started_at, max(inserted_at) AS last_event_at, min_by(path, (us, id)) AS entry_page,
  max_by(path, (us, id)) FILTER (WHERE event_type = 'pageview' OR starts = 1) AS exit_page,
  count(*) FILTER (WHERE event_type = 'pageview') AS pageviews, count(*) AS events, sum(hop)::BIGINT AS duration_seconds,
  (count(*) FILTER (WHERE event_type <> 'pageview') = 0 AND count(*) FILTER (WHERE event_type = 'pageview') < 2) AS is_bounce,
  (count(*) FILTER (WHERE event_type = 'pageview') >= 2 OR count(*) FILTER (WHERE event_type IN ('lead', 'sale')) > 0) AS is_engaged,
  arg_min_null(nullif(source_platform, 'direct'), (us, id)) FILTER (WHERE acq IS NOT NULL) AS source_platform,
  arg_min_null(nullif(source_medium, 'direct'), (us, id)) FILTER (WHERE acq IS NOT NULL) AS source_medium,
  arg_min_null(source_campaign, (us, id)) FILTER (WHERE acq IS NOT NULL) AS source_campaign, arg_min_null(click_id, (us, id)) FILTER (WHERE acq IS NOT NULL) AS click_id,
  arg_min_null(device_type, (us, id)) AS device_type, arg_min_null(browser, (us, id)) AS browser
FROM {tag}stamped GROUP BY visitor_id, n)"""


STAMP = stamp_sql(GAP_SECONDS)
ACTIVE = "v AS (SELECT id AS visitor_id, coalesce(merged_into_id, id) AS c, identified_at, first_seen_at, country_code, status FROM a_visitors), j AS (SELECT e.*, v.c, v.identified_at, v.first_seen_at, v.country_code FROM a_events e JOIN v USING (visitor_id))"


def oracle(sql: str, stamp: str = STAMP) -> str:
    """sql with the logical tables before it, as far as it names them: a_events, a_visitors, a_sessions and what leads to them (s3, stamped), visitors' events (j)."""
    parts = [f"a_events AS ({_EV})", f"a_visitors AS ({_VI})"]
    if "a_sessions" in sql or "stamped" in sql or "FROM s3" in sql:
        parts.append(stamp.strip())
    if " j " in f"{sql} " or " v " in f"{sql} ":
        parts.append(ACTIVE)
    kind = "RECURSIVE " if sql.startswith("WITH RECURSIVE ") else ""
    if sql.startswith("WITH "):
        sql = ", " + sql.removeprefix("WITH ").removeprefix("RECURSIVE ")
    return f"WITH {kind}{', '.join(parts)} {sql}"


def query(name: str, sql: str, stamp: str = STAMP) -> Callable:
    """Registers a function of the tables under a name, with the SQL that gives the same rows."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        ORACLES[name] = oracle(sql, stamp)
        return f

    return add


# Audience.

EVENT_SIDE = "count(*) AS events, count(*) FILTER (WHERE event_type = 'pageview') AS pageviews, count(DISTINCT c) AS users"
SESSION_SIDE = "count(*) AS sessions, avg(is_bounce::INT) AS bounce_rate, avg(duration_seconds) AS avg_duration, avg(is_engaged::INT) AS engaged_rate"

for _dimension in audience.DIMENSIONS:
    _column = "country_code" if _dimension == "country" else _dimension
    query(f"audience_{_dimension}_events_users", f"SELECT coalesce({_column}, '(not set)') AS value, {EVENT_SIDE} FROM j e WHERE {IN} GROUP BY 1")(lambda t, d=_dimension: audience.breakdown(t.events, t.visitors, None, d, ("events", "pageviews", "users"), WINDOW))
for _dimension in ("device_type", "browser", "source_platform", "source_medium"):
    query(f"audience_{_dimension}_sessions", f"SELECT coalesce({_dimension}, '(not set)') AS value, {SESSION_SIDE} FROM a_sessions WHERE {SES_IN} GROUP BY 1")(lambda t, d=_dimension: audience.breakdown(t.events, t.visitors, t.sessions, d, audience.SESSION_METRICS, WINDOW))


@query(
    "audience_mixed",
    f"""WITH a AS (SELECT coalesce(source_platform, '(not set)') AS value, count(*) AS events, count(DISTINCT c) AS users FROM j e WHERE {IN} GROUP BY 1),
    b AS (SELECT coalesce(source_platform, '(not set)') AS value, {SESSION_SIDE} FROM a_sessions WHERE {SES_IN} GROUP BY 1)
    SELECT coalesce(a.value, b.value) AS value, coalesce(events, 0) AS events, coalesce(users, 0) AS users, sessions, bounce_rate, avg_duration FROM a FULL JOIN b ON a.value = b.value""",
)
def _(t: Tables) -> DataFrame:
    return audience.breakdown(t.events, t.visitors, t.sessions, "source_platform", ("events", "users", "sessions", "bounce_rate", "avg_duration"), WINDOW)


@query("audience_filtered_top", f"SELECT coalesce(browser, '(not set)') AS value, count(DISTINCT c) AS users, count(*) AS events FROM j e WHERE {IN} AND device_type = 'desktop' GROUP BY 1 ORDER BY users, value LIMIT 2")
def _(t: Tables) -> DataFrame:
    return audience.breakdown(t.events, t.visitors, None, "browser", ("users", "events"), WINDOW, filter_by=("device_type", "desktop"), order_by=("users", "asc"), limit=2)


# Headline numbers.

KPI = """SELECT a.visitors, a.new_visitors, a.pageviews, a.revenue, CASE WHEN a.visitors > 0 THEN a.identified / a.visitors ELSE 0 END AS identification_rate, s.* FROM
(SELECT count(DISTINCT c) AS visitors, count(DISTINCT CASE WHEN first_seen_at >= TIMESTAMP '2024-01-08' AND first_seen_at < TIMESTAMP '2024-01-22' THEN c END) AS new_visitors,
  count(DISTINCT CASE WHEN identified_at IS NOT NULL THEN c END) AS identified, count(*) FILTER (WHERE event_type = 'pageview') AS pageviews,
  coalesce(sum(CASE WHEN event_type = 'sale' THEN coalesce(amount_cents, 0) END), 0)::BIGINT AS revenue FROM j e WHERE {in_events}) a,
(SELECT count(*) AS sessions, coalesce(avg(is_bounce::INT), 0) AS bounce_rate, coalesce(avg(duration_seconds), 0) AS avg_duration, coalesce(avg(is_engaged::INT), 0) AS engaged_rate FROM a_sessions WHERE {in_sessions}) s"""


@query("kpis", KPI.format(in_events=IN, in_sessions=SES_IN))
def _(t: Tables) -> DataFrame:
    return kpis.kpis(t.events, t.visitors, t.sessions, WINDOW)


FILTERS = [("source_platform", "in", ["google", "facebook"]), ("source_campaign", "ilike", "50%OFF"), ("event_type", "neq", "custom"), ("nonsense", "x"), ("url", "eq", "")]


CHOSEN = "source_platform IN ('google', 'facebook') AND source_campaign ILIKE '%50$%off%' ESCAPE '$'"


@query("kpis_filtered", KPI.format(in_events=f"{IN} AND {CHOSEN} AND event_type <> 'custom'", in_sessions=f"{SES_IN} AND {CHOSEN}"))
def _(t: Tables) -> DataFrame:
    return kpis.kpis(t.events, t.visitors, t.sessions, WINDOW, filters=FILTERS)


@query("new_visitors", f"SELECT count(DISTINCT c) AS new_visitors FROM j e WHERE {IN} AND first_seen_at >= TIMESTAMP '2024-01-08' AND first_seen_at < TIMESTAMP '2024-01-22'")
def _(t: Tables) -> DataFrame:
    return kpis.new_visitors(t.events, t.visitors, WINDOW)


@query("session_metrics", f"SELECT {SESSION_SIDE} FROM a_sessions WHERE {SES_IN} AND source_platform = 'google'")
def _(t: Tables) -> DataFrame:
    return kpis.session_metrics(t.sessions, WINDOW, filters=[("source_platform", "google"), ("url", "ignored")])["headline"]


for _page in ("entry_page", "exit_page"):
    query(f"{_page}s", f"SELECT {_page} AS page, count(*) AS sessions FROM a_sessions WHERE {SES_IN} AND {_page} IS NOT NULL GROUP BY 1")(lambda t, c=_page: kpis.page_tallies(t.sessions, c, WINDOW))


@query("pageviews", f"SELECT count(*) FILTER (WHERE event_type = 'pageview') AS pageviews FROM a_events e WHERE {IN}")
def _(t: Tables) -> DataFrame:
    return kpis.pageviews(t.events, WINDOW)


@query("revenue", f"SELECT coalesce(sum(amount_cents), 0)::BIGINT AS revenue FROM a_events e WHERE {IN} AND event_type = 'sale'")
def _(t: Tables) -> DataFrame:
    return kpis.revenue(t.events, WINDOW)


for _dimension in kpis.CONVERSION_DIMENSIONS:
    query(
        f"conversion_{_dimension}",
        f"""SELECT *, round(revenue_cents / sum(revenue_cents) OVER () * 100, 2) AS percentage, sales / visitors AS conversion_rate FROM
        (SELECT coalesce({_dimension}, '(not set)') AS value, count(*) AS sales, count(DISTINCT c) AS visitors, coalesce(sum(amount_cents), 0)::BIGINT AS revenue_cents FROM j e WHERE {IN} AND event_type = 'sale' AND NOT coalesce(source_medium = 'social', true) GROUP BY 1) x""",
    )(lambda t, d=_dimension: kpis.conversion_breakdown(t.events, t.visitors, d, WINDOW, filters=[("source_medium", "not_in", ["social"]), ("inserted_at", "eq", "x")]))


# Time series.

BUCKETS = """WITH b AS (SELECT unnest(generate_series(time_bucket(INTERVAL '{step}', TIMESTAMP '{lo}', TIMESTAMP '2000-01-03'), time_bucket(INTERVAL '{step}', TIMESTAMP '{hi}', TIMESTAMP '2000-01-03'), INTERVAL '{step}')) AS l),
x AS (SELECT time_bucket(INTERVAL '{step}', {local}, TIMESTAMP '2000-01-03') AS l, {made} AS value FROM {rows} GROUP BY 1)
SELECT {start} AS bucket_start, {end} AS bucket_end, '{label}' AS "interval", coalesce(x.value, 0)::BIGINT AS value FROM b LEFT JOIN x ON b.l = x.l"""
MADE = {"visitors": ("count(DISTINCT c)", "j e WHERE {w}"), "pageviews": ("count(*)", "a_events e WHERE {w} AND event_type = 'pageview'"), "revenue": ("sum(coalesce(amount_cents, 0))", "a_events e WHERE {w} AND event_type = 'sale'"), "sessions": ("count(*)", "a_sessions e WHERE {s}"), "engaged": ("count(*) FILTER (WHERE is_engaged)", "a_sessions e WHERE {s}")}


def _series(metric: str, label: str, step: str) -> None:
    made, rows = MADE[metric]
    moment = "started_at" if metric in ("sessions", "engaged") else "inserted_at"
    sql = BUCKETS.format(step=step, lo="2024-01-08", hi="2024-01-21 23:59:59.999999", local=moment, made=made, rows=rows.format(w=IN, s=SES_IN), start="b.l", end=f"b.l + INTERVAL '{step}'", label=label)
    query(f"timeseries_{metric}_{label}", sql)(lambda t: timeseries.timeseries(t.events, t.visitors, t.sessions, metric, WINDOW, interval=label))


for _metric in timeseries.METRICS:
    _series(_metric, "1d", "1 day")
_series("visitors", "2d", "2 days")
_series("pageviews", "1w", "7 days")
_series("revenue", "6h", "6 hours")
_series("pageviews", "1mo", "30 days")


@query(
    "timeseries_zone",
    BUCKETS.format(
        step="12 hours",
        lo="2024-01-07 18:00:00",
        hi="2024-01-21 17:59:59.999999",
        local="timezone('America/Chicago', inserted_at AT TIME ZONE 'UTC')",
        made="count(*)",
        rows=f"a_events e WHERE {IN} AND event_type = 'pageview' AND source_platform = 'google'",
        start="timezone('UTC', timezone('America/Chicago', b.l))",
        end="timezone('UTC', timezone('America/Chicago', b.l + INTERVAL '12 hours'))",
        label="12h",
    ),
)
def _(t: Tables) -> DataFrame:
    return timeseries.timeseries(t.events, t.visitors, None, "pageviews", WINDOW, timezone="America/Chicago", interval="12h", filters=[("source_platform", "google")])


@query(
    "timeseries_dst",
    BUCKETS.format(
        step="6 hours",
        lo="2024-03-07 18:00:00",
        hi="2024-03-14 18:59:59.999999",
        local="timezone('America/Chicago', (inserted_at + INTERVAL '60 days') AT TIME ZONE 'UTC')",
        made="count(*)",
        rows="a_events e WHERE inserted_at + INTERVAL '60 days' >= TIMESTAMP '2024-03-08' AND inserted_at + INTERVAL '60 days' < TIMESTAMP '2024-03-15' AND event_type = 'pageview'",
        start="timezone('UTC', timezone('America/Chicago', b.l))",
        end="timezone('UTC', timezone('America/Chicago', b.l + INTERVAL '6 hours'))",
        label="6h",
    ),
)
def _(t: Tables) -> DataFrame:
    later = t.events.withColumn("inserted_at", F.col("inserted_at") + F.expr("INTERVAL 60 DAYS"))  # the week in which clocks go forward
    window = TimeWindow(datetime(2024, 3, 8, tzinfo=UTC), datetime(2024, 3, 15, tzinfo=UTC))
    return timeseries.timeseries(later, t.visitors, None, "pageviews", window, timezone="America/Chicago", interval="6h")


# Lists.


@query("source_breakdown", "SELECT source_platform, source_medium, count(*) AS count FROM a_events WHERE inserted_at BETWEEN TIMESTAMP '2024-01-22' AND TIMESTAMP '2024-01-29' AND source_platform IS NOT NULL GROUP BY 1, 2 ORDER BY count DESC, 1, 2 LIMIT 10")
def _(t: Tables) -> DataFrame:
    return events.source_breakdown(t.events, NOW)


@query("events_list", "SELECT id, event_type, source_platform, inserted_at FROM a_events WHERE inserted_at BETWEEN TIMESTAMP '2024-01-22' AND TIMESTAMP '2024-01-29' AND event_type IN ('sale', 'lead') AND source_platform NOT IN ('direct') ORDER BY inserted_at DESC, id DESC LIMIT 50 OFFSET 10")
def _(t: Tables) -> DataFrame:
    return events.list_events(t.events, NOW, offset=10, event_type=("in", ["sale", "lead"]), source_platform=("not_in", ["direct"])).select("id", "event_type", "source_platform", "inserted_at")


NORMALIZED = "coalesce(nullif(regexp_replace(regexp_replace(split_part(coalesce(url, '/'), '?', 1), '([^:])/+', '\\1/', 'g'), '/$', ''), ''), '/')"


#: The filter's values: normalized addresses, one of a trailing slash, one with a fragment.
WANTED = ["https://thther.example.org/en/685", "http://therha.example.com/en/676", "https://blog.tiontion.example.com/en/853", "https://therin.example.net/en/770#top"]


@query("events_count", f"SELECT count(*) AS events FROM a_events WHERE inserted_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND {NORMALIZED} IN ({', '.join(f"'{x}'" for x in WANTED)})")
def _(t: Tables) -> DataFrame:
    return events.count_events(t.events, NOW, WINDOW, url=("in", WANTED))


@query("event_search", "SELECT id, event_name FROM a_events WHERE inserted_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND (event_name ILIKE '%FORM$_2%' ESCAPE '$' OR url ILIKE '%FORM$_2%' ESCAPE '$') ORDER BY inserted_at DESC, id DESC LIMIT 200")
def _(t: Tables) -> DataFrame:
    return events.list_events(t.events, NOW, WINDOW, limit=200, search="FORM_2").select("id", "event_name")


@query("filter_options", "SELECT DISTINCT 'event_type' AS option, event_type AS value FROM a_events WHERE inserted_at >= TIMESTAMP '2023-10-31' UNION SELECT DISTINCT 'source_platform', source_platform FROM a_events WHERE inserted_at >= TIMESTAMP '2023-10-31' AND source_platform IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return events.filter_options(t.events, NOW)


@query("last_event", "SELECT visitor_id, arg_max(id, (inserted_at, id)) AS id, max(inserted_at) AS inserted_at FROM a_events WHERE event_type = 'sale' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return events.last_events(t.events, "sale")


@query("timeline", "SELECT id, event_type, inserted_at FROM a_events WHERE visitor_id = 7")
def _(t: Tables) -> DataFrame:
    return events.timeline(t.events, 7).select("id", "event_type", "inserted_at")


@query("event_by_id", "SELECT id, event_type, visitor_id FROM a_events WHERE id = 77")
def _(t: Tables) -> DataFrame:
    return events.get_event(t.events, 77).select("id", "event_type", "visitor_id")


@query("event_property", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS events FROM a_events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.events.groupBy(values.json_text(F.col("props"), "k").alias("k")).agg(F.count("*").alias("events"))


@query("visitors_list", "SELECT id, last_seen_at FROM a_visitors WHERE status <> 'merged' ORDER BY last_seen_at DESC, id DESC LIMIT 20 OFFSET 5")
def _(t: Tables) -> DataFrame:
    return people.list_visitors(t.visitors, offset=5).select("id", "last_seen_at")


@query("link_clicks", "SELECT id, inserted_at FROM a_events WHERE event_type = 'link_click' AND link_id = 3 ORDER BY inserted_at DESC, id DESC LIMIT 50")
def _(t: Tables) -> DataFrame:
    return people.link_clicks(t.events, 3).select("id", "inserted_at")


# Funnels.


def _event(label: str, *types: str, combine: str = "any") -> Step:
    return Step("event", tuple(StepFilter("event", event_type=x) for x in types), label, combine)


FUNNELS = {
    "funnel_2step": (Funnel("two", (_event("view", "pageview"), _event("buy", "sale")), 7), ["event_type = 'pageview'", "event_type = 'sale'"]),
    "funnel_3step": (Funnel("three", (_event("view", "pageview"), _event("lead", "lead"), _event("buy", "sale")), 3), ["event_type = 'pageview'", "event_type = 'lead'", "event_type = 'sale'"]),
    "funnel_3step_any": (Funnel("any", (Step("url", (StepFilter("url", match="starts_with", value="/en/"), StepFilter("url", match="regex", value="^/fr/[0-9]+$")), "site", "any"), _event("act", "lead", "link_click"), _event("buy", "sale")), 2), ["(path LIKE '/en/%' OR regexp_matches(path, '^/fr/[0-9]+$'))", "event_type IN ('lead', 'link_click')", "event_type = 'sale'"]),
    "funnel_cohort": (Funnel("cohort", (_event("view", "pageview"), Step("property", (StepFilter("property", key="k", op="in", values=("1", "2", "3")),), "k"), _event("buy", "sale")), 5, SourceFilter("google", "organic")), ["event_type = 'pageview' AND source_platform = 'google' AND source_medium = 'organic'", "json_extract_string(props, '$.k') IN ('1', '2', '3')", "event_type = 'sale'"]),
}


def _funnel_sql(steps: list[str], days: int) -> str:
    found = [f"t1 AS (SELECT c, min(inserted_at) AS t FROM j e WHERE inserted_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND {steps[0]} GROUP BY c)"]
    for i, s in enumerate(steps[1:], 2):
        found.append(f"t{i} AS (SELECT e.c, min(e.inserted_at) AS t FROM t{i - 1} p JOIN t1 ON t1.c = p.c JOIN j e ON e.c = p.c AND e.inserted_at > p.t AND e.inserted_at <= t1.t + INTERVAL '{days} days' WHERE e.inserted_at BETWEEN TIMESTAMP '2024-01-08' AND TIMESTAMP '2024-01-22' AND {s} GROUP BY e.c)")
    n = len(steps)
    rows = [f"SELECT {i} AS step_index, count(*) AS visitor_count, NULL::DOUBLE AS median_time FROM t{i}" for i in range(1, n)]
    rows.append(f"SELECT {n}, count(*), quantile_cont((epoch_us(t{n}.t) - epoch_us(t1.t)) / 1e6, 0.5) FROM t{n} JOIN t1 USING (c)")
    return f"WITH {', '.join(found)} {' UNION ALL '.join(rows)}"


for _name, (_funnel, _steps) in FUNNELS.items():
    query(_name, _funnel_sql(_steps, _funnel.window_days))(lambda t, f=_funnel: funnels.summary(t.events, t.visitors, f, WINDOW))
query("funnel_by_joins", _funnel_sql(FUNNELS["funnel_3step"][1], 3))(lambda t: funnels.summary(t.events, t.visitors, FUNNELS["funnel_3step"][0], WINDOW, form="joins"))


@query(
    "funnel_analysis",
    f"""WITH rows_of AS ({_funnel_sql(FUNNELS["funnel_3step"][1], 3)})
    SELECT step_index, visitor_count AS count, visitor_count / first_value(visitor_count) OVER o AS conversion_to_step_1, visitor_count / lag(visitor_count, 1, visitor_count) OVER o AS conversion_to_prev,
      lag(visitor_count, 1, visitor_count) OVER o - visitor_count AS drop_off FROM rows_of WINDOW o AS (ORDER BY step_index)""",
)
def _(t: Tables) -> DataFrame:
    return funnels.analyze(t.events, t.visitors, FUNNELS["funnel_3step"][0], WINDOW).drop("label", "overall_conversion", "median_time_seconds")


# Sessions.

SESSION_COLUMNS = ("visitor_id", "started_at", "last_event_at", "entry_page", "exit_page", "pageviews", "events", "duration_seconds", "is_bounce", "is_engaged", "source_platform", "source_medium", "device_type", "browser")


@query("sessions", f"SELECT {', '.join(SESSION_COLUMNS)} FROM a_sessions")
def _(t: Tables) -> DataFrame:
    return t.sessions.select(*SESSION_COLUMNS)


SESSION_IDS = "SELECT id, first_value(id) OVER (PARTITION BY visitor_id, n ORDER BY inserted_at, id) AS session_start, starts = 1 AS starts, hop FROM stamped"


@query("session_ids", SESSION_IDS)
def _(t: Tables) -> DataFrame:
    rows = sessions.stamp(t.events, GAP_SECONDS)
    first = F.first("id").over(Window.partitionBy("session_id").orderBy("inserted_at", "id"))
    return rows.select("id", first.alias("session_start"), "starts", "hop")


#: The rules' own gap, at which most sessions of the test tables are short.
HALF_HOUR = stamp_sql(sessions.GAP_SECONDS)


@query("sessions_30min", f"SELECT {', '.join(SESSION_COLUMNS)} FROM a_sessions", HALF_HOUR)
def _(t: Tables) -> DataFrame:
    return sessions.sessions(t.events).select(*SESSION_COLUMNS)


@query("session_ids_30min", SESSION_IDS, HALF_HOUR)
def _(t: Tables) -> DataFrame:
    rows = sessions.stamp(t.events)
    return rows.select("id", F.first("id").over(Window.partitionBy("session_id").orderBy("inserted_at", "id")).alias("session_start"), "starts", "hop")


@query("sessions_of_nobody", "SELECT count(*) AS sessions, count(DISTINCT id) AS events FROM a_events WHERE visitor_id % 4 = 1")
def _(t: Tables) -> DataFrame:
    nobody = t.events.where("visitor_id % 4 = 1").withColumn("visitor_id", F.lit(None).cast("long"))
    return sessions.sessions(nobody).agg(F.count("*").alias("sessions"), F.sum("events").alias("events"))


@query("sessions_by_gap", "SELECT visitor_id, min(inserted_at) AS started_at, max(inserted_at) AS last_event_at, count(*) AS events FROM s3 GROUP BY visitor_id, island")
def _(t: Tables) -> DataFrame:
    return sessions.by_gap(t.events, GAP_SECONDS).select("visitor_id", "started_at", "last_event_at", "events")


@query("sessions_backfill", f"SELECT {', '.join(SESSION_COLUMNS)} FROM a_sessions")
def _(t: Tables) -> DataFrame:
    """Events up to a moment have sessions, the others are backfilled: the same as in one pass."""
    early = F.col("inserted_at") < F.lit(datetime(2024, 1, 15, 12, tzinfo=UTC))
    held = written(sessions.sessions(t.events.where(early), GAP_SECONDS, online=False), "sessions")
    _, changed = sessions.backfill(t.events.where(~early), held, GAP_SECONDS)
    return sessions.replaced(held, written(changed, "changed")).select(*SESSION_COLUMNS)


SESSION_SOURCE = "CASE WHEN coalesce(source_platform, source_medium, source_campaign, click_id) IS NOT NULL THEN concat_ws('|', coalesce(source_platform, ''), coalesce(source_medium, ''), coalesce(source_campaign, ''), coalesce(click_id, '')) END"


@query(
    "backfill_events",
    f"""WITH h_events AS (SELECT * FROM a_events WHERE id % 3 <> 0), {stamp_sql(GAP_SECONDS, 'h_events', 'h_').strip()},
    m AS (SELECT visitor_id, epoch_us(inserted_at) AS us, 1 AS kind, id, acq FROM s1 WHERE id % 3 = 0 UNION ALL SELECT visitor_id, epoch_us(last_event_at), 0, NULL, {SESSION_SOURCE} FROM h_a_sessions),
    m1 AS (SELECT *, lag(us) OVER (PARTITION BY visitor_id ORDER BY us, kind, id) AS prev FROM m),
    m2 AS (SELECT *, kind = 0 OR prev IS NULL OR us - prev > {GAP_SECONDS}000000 AS fresh FROM m1),
    m3 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY visitor_id ORDER BY us, kind, id ROWS UNBOUNDED PRECEDING) AS island FROM m2),
    m4 AS (SELECT *, last_value(acq IGNORE NULLS) OVER (PARTITION BY visitor_id, island ORDER BY us, kind, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM m3),
    m5 AS (SELECT *, fresh OR coalesce(acq <> was, false) AS starts FROM m4)
    SELECT id, starts, CASE WHEN starts THEN 0 ELSE least((us - prev) // 1000000, {GAP_SECONDS}) END AS hop, grown FROM
      (SELECT *, last_value(CASE WHEN starts THEN kind END IGNORE NULLS) OVER (PARTITION BY visitor_id ORDER BY us, kind, id ROWS UNBOUNDED PRECEDING) = 0 AS grown FROM m5) x WHERE kind = 1 /* a_sessions */""",
)
def _(t: Tables) -> DataFrame:
    """Two thirds of the events have sessions, the others lie between them: which of those go on with one."""
    old = F.col("id") % 3 != 0
    held = written(sessions.sessions(t.events.where(old), GAP_SECONDS, online=False), "sessions")
    stamped, _ = sessions.backfill(t.events.where(~old), held, GAP_SECONDS)
    known = held.select(F.col("id").alias("session_id"), F.lit(True).alias("held"))
    return stamped.join(known, "session_id", "left").select("id", "starts", "hop", F.coalesce("held", F.lit(False)).alias("grown"))


@query(
    "engagement_attached",
    f"""WITH p AS (SELECT visitor_id, epoch_us(started_at) AS us, epoch_us(last_event_at) AS last, NULL AS id FROM a_sessions UNION ALL SELECT visitor_id, epoch_us(inserted_at + INTERVAL '4 hours'), NULL, id FROM a_events WHERE event_type = 'custom'),
    q AS (SELECT *, max(CASE WHEN last IS NOT NULL THEN [last, us] END) OVER (PARTITION BY visitor_id ORDER BY us, id IS NOT NULL ROWS UNBOUNDED PRECEDING) AS s FROM p),
    r AS (SELECT *, us - greatest(s[1], coalesce(lag(us) OVER (PARTITION BY visitor_id, s ORDER BY us, id), s[1])) > {GAP_SECONDS}000000 AS late FROM q WHERE id IS NOT NULL AND s IS NOT NULL)
    SELECT id, make_timestamp(s[2]) AS started_at FROM (SELECT *, bool_or(late) OVER (PARTITION BY visitor_id, s ORDER BY us, id ROWS UNBOUNDED PRECEDING) AS dead FROM r) x WHERE NOT dead""",
)
def _(t: Tables) -> DataFrame:
    beacons = t.events.where("event_type = 'custom'").select("id", "workspace_id", "visitor_id", (F.col("inserted_at") + F.expr("INTERVAL 4 HOURS")).alias("inserted_at"), "engaged_ms")
    attached = sessions.attach(beacons, t.sessions, GAP_SECONDS)
    return attached.join(t.sessions.select(F.col("id").alias("session_id"), "started_at"), "session_id").select("id", "started_at")


@query("sessions_linked", "SELECT 'n' || visitor_id AS anonymous_id, max(visitor_id) FILTER (WHERE id % 2 = 1) AS visitor_id, min(inserted_at) AS started_at, max(inserted_at) AS last_event_at, count(*) AS events, count(*) FILTER (WHERE event_type = 'pageview') AS pageviews FROM s3 GROUP BY s3.visitor_id, island")
def _(t: Tables) -> DataFrame:
    """Every other event has its visitor's anonymous id alone, and no event a source: visitors' sessions all the same."""
    anonymous = F.concat(F.lit("n"), F.col("visitor_id").cast("string"))
    found = t.events.select("id", "workspace_id", "inserted_at", "event_type", anonymous.alias("anonymous_id"), F.when(F.col("id") % 2 == 1, F.col("visitor_id")).alias("visitor_id"), *[F.lit(None).cast("string").alias(c) for c in sessions.TUPLE])
    return sessions.sessions(found, GAP_SECONDS).select("anonymous_id", "visitor_id", "started_at", "last_event_at", "events", "pageviews")


@query("month_folders", "SELECT event_type, strftime(moved, '%Y-%m') AS event_month, count(*) AS events FROM (SELECT *, inserted_at + to_days((id % 5)::INT * 29) AS moved FROM a_events) x WHERE moved >= TIMESTAMP '2024-01-31 22:00:00' AND moved < TIMESTAMP '2024-04-01 04:00:00' GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """Events spread over months, written to their folders and read for a window over two edges of months."""
    moved = t.events.select("id", "workspace_id", "visitor_id", "event_type", F.timestamp_micros(F.unix_micros("inserted_at") + F.col("id") % 5 * 29 * 86_400_000_000).alias("inserted_at"))
    path = scratch_path(t.spark, "months")
    tables.write_events(moved, path)
    back = t.spark.read.schema(moved.withColumn("event_month", F.lit("")).schema).parquet(f"{path}/events")
    window = TimeWindow(datetime(2024, 1, 31, 22, tzinfo=UTC), datetime(2024, 4, 1, 4, tzinfo=UTC))
    return scan_events(back, window).groupBy("event_type", "event_month").agg(F.count("*").alias("events"))


@query("visitor_rollups", "SELECT e.visitor_id, total_events, total_pageviews, ltv_cents, total_sessions, total_time_seconds FROM (SELECT visitor_id, count(*) AS total_events, count(*) FILTER (WHERE event_type = 'pageview') AS total_pageviews, coalesce(sum(amount_cents) FILTER (WHERE event_type = 'sale'), 0)::BIGINT AS ltv_cents FROM a_events GROUP BY 1) e JOIN (SELECT visitor_id, count(*) AS total_sessions, sum(duration_seconds)::BIGINT AS total_time_seconds FROM a_sessions GROUP BY 1) s USING (visitor_id)")
def _(t: Tables) -> DataFrame:
    return people.visitor_rollups(t.events, t.sessions)


DEPTH = "CAST(regexp_extract(props, '([0-9]+)', 1) AS bigint) * 2"  # beyond 100 for some


@query("visitor_engagement", f"SELECT visitor_id, avg_scroll_depth, coalesce(top_pages, '') AS top_pages FROM (SELECT visitor_id, avg({DEPTH}) FILTER ({DEPTH} <= 100) AS avg_scroll_depth FROM a_events GROUP BY 1) d LEFT JOIN (SELECT visitor_id, string_agg(path || ' ' || views, ', ' ORDER BY n) AS top_pages FROM (SELECT visitor_id, path, count(*) AS views, row_number() OVER (PARTITION BY visitor_id ORDER BY count(*) DESC, path) AS n FROM a_events WHERE event_type = 'pageview' AND path IS NOT NULL GROUP BY 1, 2) p WHERE n <= 3 GROUP BY 1) t USING (visitor_id)")
def _(t: Tables) -> DataFrame:
    scrolled = t.events.withColumn("properties", F.create_map(F.lit("scroll_depth"), F.expr(DEPTH).cast("string")))
    found = people.visitor_engagement(scrolled, top=3)
    return found.withColumn("top_pages", F.array_join(F.transform("top_pages", lambda x: F.concat_ws(" ", x["path"], x["pageviews"])), ", "))


@query("session_paths", "SELECT array_to_string(list(path ORDER BY inserted_at, id), ' ') AS paths, count(*) AS steps FROM stamped WHERE event_type IN ('pageview', 'lead', 'sale') GROUP BY visitor_id, n")
def _(t: Tables) -> DataFrame:
    found = people.session_paths(sessions.stamp(t.events, GAP_SECONDS))
    return found.select(F.array_join("paths", " ").alias("paths"), F.size("paths").cast("long").alias("steps"))


# URLs and traffic.

HOST = r"lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]+)', 1))"
PATH = r"CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+', '/', 'g'), '/$', '') END"


@query("url_host", f"SELECT page_id, nullif({HOST}, '') AS host FROM pages")
def _(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.host(F.col("url")).alias("host"))


@query("url_path", f"SELECT page_id, {PATH} AS path FROM pages")
def _(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.path(F.col("url")).alias("path"))


@query("url_normalized", f"SELECT page_id, {NORMALIZED} AS url FROM pages")
def _(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.normalized_url(F.col("url")).alias("url"))


@query("url_grouping", f"SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || {HOST} || {PATH} AS key FROM pages")
def _(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", urls.path_for_grouping(F.col("url")).alias("key"))


REFERRER = "CASE page_id % 7 WHEN 0 THEN 'https://www.google.com/search?q=x' WHEN 1 THEN 'https://t.co/abc' WHEN 2 THEN 'https://blog.example.net/post' WHEN 3 THEN '' WHEN 4 THEN 'https://chatgpt.com/c/1' WHEN 5 THEN 'https://mail.google.com/mail' END"
EXTRA = "CASE page_id % 5 WHEN 0 THEN 'gclid=g1' WHEN 1 THEN 'via=ann' WHEN 2 THEN 'utm_source=WWW.Claude.ai&utm_campaign=spring%20sale' WHEN 3 THEN 'utm_medium=cpc' END"


@query(
    "classify_source",
    f"""WITH q AS (SELECT page_id, {REFERRER} AS r, page_id % 5 AS k, page_id % 7 AS m FROM pages)
    SELECT page_id,
      CASE k WHEN 0 THEN 'google_ads' WHEN 2 THEN 'claude' WHEN 3 THEN NULL ELSE CASE m WHEN 0 THEN 'google' WHEN 1 THEN 'twitter' WHEN 2 THEN 'referral' WHEN 4 THEN 'chatgpt' WHEN 5 THEN 'gmail' ELSE 'direct' END END AS platform,
      CASE k WHEN 0 THEN 'paid' WHEN 1 THEN 'referral' WHEN 2 THEN 'ai' WHEN 3 THEN 'paid' ELSE CASE m WHEN 0 THEN 'organic' WHEN 1 THEN 'social' WHEN 2 THEN 'referral' WHEN 4 THEN 'ai' WHEN 5 THEN 'email' ELSE 'direct' END END AS medium,
      CASE WHEN k = 2 THEN 'spring sale' END AS campaign, CASE WHEN k = 1 THEN 'ann' END AS partner_code
    FROM q""",
)
def _(t: Tables) -> DataFrame:
    rows = t.raw("pages").select("page_id", F.expr(REFERRER).alias("referrer"), F.concat(F.lit("https://shop.example.org/?"), F.coalesce(F.expr(EXTRA), F.lit(""))).alias("url"))
    return tables.classify_visits(rows).select("page_id", *[F.col("classified")[c].alias(c) for c in ("platform", "medium", "campaign", "partner_code")])


# Clicks, links, partners.


def _counted_clicks(ids: str) -> str:
    """Clicks of a_events in order, and (w) whether each counts; ids is an expression for a click's id."""
    return f"""WITH RECURSIVE k AS (SELECT id, ip_address, link_id, inserted_at, row_number() OVER (PARTITION BY ip_address, link_id ORDER BY inserted_at, id) AS n FROM (SELECT * REPLACE ({ids} AS id) FROM a_events) WHERE event_type = 'link_click'),
    w AS (SELECT id, ip_address, link_id, n, inserted_at AS counted, true AS is_unique FROM k WHERE n = 1 UNION ALL
      SELECT k.id, k.ip_address, k.link_id, k.n, CASE WHEN k.inserted_at >= w.counted + INTERVAL '1 hour' THEN k.inserted_at ELSE w.counted END, k.inserted_at >= w.counted + INTERVAL '1 hour' FROM w JOIN k ON k.ip_address = w.ip_address AND k.link_id = w.link_id AND k.n = w.n + 1)"""


@query("click_dedup", f"{_counted_clicks('id')} SELECT id, is_unique FROM w")
def _(t: Tables) -> DataFrame:
    return clicks.mark_unique(t.events.where("event_type = 'link_click'").select("id", "ip_address", "link_id", "inserted_at")).select("id", "is_unique")


@query("click_dedup_text_ids", f"""{_counted_clicks("'c-' || id")} SELECT w.id, w.ip_address, w.link_id, k.inserted_at, w.is_unique FROM w JOIN k USING (id)""")
def _(t: Tables) -> DataFrame:
    rows = t.events.where("event_type = 'link_click'").select(F.concat(F.lit("c-"), F.col("id").cast("string")).alias("id"), "ip_address", "link_id", "inserted_at")
    return clicks.mark_unique(rows)


@query("link_stats", f"{_counted_clicks('id')} SELECT link_id, count(*) AS total_clicks, count(*) FILTER (WHERE is_unique) AS unique_clicks FROM w GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return clicks.link_stats(t.events.where("event_type = 'link_click'").select("id", "ip_address", "link_id", "inserted_at"))


@query(
    "link_conversions",
    f"""{_counted_clicks('id')}, l AS (SELECT DISTINCT user_id % 40 AS link_id FROM events),
    x AS (SELECT link_id, count(*) AS total_clicks, count(*) FILTER (WHERE is_unique) AS unique_clicks FROM w GROUP BY 1),
    y AS (SELECT id % 30 AS link_id, count(*) FILTER (WHERE event_type = 'lead') AS total_leads, count(*) FILTER (WHERE event_type = 'sale') AS total_sales, sum(amount_cents)::BIGINT AS total_revenue_cents FROM a_events WHERE event_type IN ('lead', 'sale') GROUP BY 1)
    SELECT link_id, coalesce(total_clicks, 0) AS total_clicks, coalesce(unique_clicks, 0) AS unique_clicks, coalesce(total_leads, 0) AS total_leads, coalesce(total_sales, 0) AS total_sales, coalesce(total_revenue_cents, 0)::BIGINT AS total_revenue_cents
    FROM l FULL JOIN x USING (link_id) FULL JOIN y USING (link_id)""",
)
def _(t: Tables) -> DataFrame:
    """Clicks are of links 0 to 19, leads and sales of 0 to 29, and there are links up to 39."""
    sold = t.events.where("event_type IN ('lead', 'sale')").withColumn("link_id", F.col("id") % 30)
    links = t.raw("events").select((F.col("user_id") % 40).alias("id")).distinct()
    return clicks.link_stats(t.events.where("event_type = 'link_click'").select("id", "ip_address", "link_id", "inserted_at"), sold, links)


@query("first_last_partner", "SELECT visitor_id, arg_min(partner_id, (inserted_at, id)) AS first_partner_id, arg_max(partner_id, (inserted_at, id)) AS last_partner_id FROM a_events WHERE partner_id IS NOT NULL GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return people.partner_touches(t.events)


@query("attribution_path", "SELECT visitor_id, array_to_string(list(source_platform || '/' || source_medium ORDER BY inserted_at, id), ' ') AS touchpoints FROM (SELECT *, row_number() OVER (PARTITION BY visitor_id ORDER BY inserted_at DESC, id DESC) AS n FROM a_events WHERE source_platform IS NOT NULL) x WHERE n <= 50 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return identity.attribution_paths(t.events).select("visitor_id", F.array_join("touchpoints", " ").alias("touchpoints"))


# Connectors.


@query("missing_dispatches", "SELECT id FROM a_events e WHERE event_type = 'sale' AND NOT EXISTS (SELECT 1 FROM a_events d WHERE d.id = e.id AND d.event_type = 'sale' AND d.id % 3 = 0)")
def _(t: Tables) -> DataFrame:
    return connectors.missing_dispatches(t.events, t.dispatches, "meta", datetime(2020, 1, 1, tzinfo=UTC), ("sale",)).select("id")


@query("connector_event_id", "SELECT id, 'meta_' || substr(sha256(id || ':' || strftime(inserted_at, '%Y-%m-%dT%H:%M:%S.%fZ') || ':meta'), 1, 32) AS connector_event_id FROM a_events WHERE event_type = 'sale'")
def _(t: Tables) -> DataFrame:
    return t.events.where("event_type = 'sale'").select("id", values.connector_event_id(F.col("id"), F.col("inserted_at"), F.lit("meta")).alias("connector_event_id"))


def _signalled(t: Tables) -> DataFrame:
    given = F.create_map(F.lit("gclid"), F.when(F.col("id") % 2 == 0, "g.1"), F.lit("_fbp"), F.when(F.col("id") % 3 == 0, "fb.1"), F.lit("li_fat_id"), F.when(F.col("id") % 5 == 0, "not valid!"))
    return t.events.withColumn("signals", connectors.valid_signals(given)).withColumn("consent", F.when(F.col("id") % 4 == 3, "denied").otherwise("consented"))


REASONS = "CASE WHEN c = 'tiktok' THEN 'not_enabled' WHEN event_type NOT IN ('lead', 'sale') THEN 'unsupported_event_type' WHEN NOT ((c = 'google' AND id % 2 = 0) OR (c = 'meta' AND id % 3 = 0)) THEN 'missing_signals' WHEN id % 4 = 3 THEN 'no_consent' END"


@query("planner_eligible", f"SELECT c AS connector_type, {REASONS} AS skip_reason, count(*) AS events FROM a_events, (SELECT unnest(['meta', 'google', 'linkedin', 'tiktok']) AS c) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    planned = connectors.plan(_signalled(t), ("meta", "google", "linkedin"))
    return planned.groupBy("connector_type", "skip_reason").agg(F.count("*").alias("events"))


@query("connector_payloads", "SELECT id, 'google' AS connector_type, amount_cents / 100 AS amount FROM a_events WHERE event_type = 'sale' AND id % 2 = 0 AND id % 4 <> 3")
def _(t: Tables) -> DataFrame:
    made = connectors.payloads(connectors.plan(_signalled(t), ("google",)), {"google": {"customer_id": "1", "conversion_action_id": "2"}}).where("event_type = 'sale'")
    return made.select("id", "connector_type", F.get_json_object("payload", "$.conversions[0].conversionValue").cast("double").alias("amount"))


FIELDS = {  # connector: name, time, signal and amount in its payload
    "meta": ("$.data[0].event_name", "$.data[0].event_time", "$.data[0].user_data.fbp", "$.data[0].custom_data.value"),
    "google": ("$.conversions[0].conversionAction", "$.conversions[0].conversionDateTime", "$.conversions[0].gclid", "$.conversions[0].conversionValue"),
    "linkedin": ("$.elements[0].conversion", "$.elements[0].conversionHappenedAt", "$.elements[0].user.userIds[0].idValue", "$.elements[0].conversionValue.amount"),
    "tiktok": ("$.data[0].event", "$.data[0].event_time", "$.data[0].user.ttclid", "$.data[0].properties.value"),
}


@query(
    "connector_payload_fields",
    """SELECT id, c AS connector_type,
    CASE c WHEN 'meta' THEN CASE event_type WHEN 'lead' THEN 'Lead' ELSE 'Purchase' END WHEN 'google' THEN 'customers/1/conversionActions/2' WHEN 'linkedin' THEN 'urn:lla:llaPartnerConversion:3' ELSE CASE event_type WHEN 'lead' THEN 'SubmitForm' ELSE 'CompletePayment' END END AS name,
    CASE c WHEN 'google' THEN strftime(inserted_at, '%Y-%m-%d %H:%M:%S+00:00') WHEN 'linkedin' THEN (epoch_us(inserted_at) // 1000)::VARCHAR ELSE floor(epoch(inserted_at))::BIGINT::VARCHAR END AS at,
    CASE c WHEN 'meta' THEN 'f.' WHEN 'google' THEN 'g.' WHEN 'linkedin' THEN 'l.' ELSE 't.' END || id AS signal,
    amount_cents / CASE c WHEN 'linkedin' THEN 1.0 ELSE 100.0 END AS amount
    FROM a_events, (SELECT unnest(['meta', 'google', 'linkedin', 'tiktok']) AS c) WHERE event_type IN ('lead', 'sale')""",
)
def _(t: Tables) -> DataFrame:
    signals = F.create_map(*[x for k, p in (("_fbp", "f."), ("gclid", "g."), ("li_fat_id", "l."), ("ttclid", "t.")) for x in (F.lit(k), F.concat(F.lit(p), F.col("id").cast("string")))])
    planned = connectors.plan(t.events.withColumn("signals", connectors.valid_signals(signals)).withColumn("consent", F.lit("consented")), tuple(FIELDS))
    made = connectors.payloads(planned, {"google": {"customer_id": "1", "conversion_action_id": "2"}, "linkedin": {"conversion_rule_id": "3"}})
    fields = F.lit(None)
    for c, paths in FIELDS.items():
        fields = F.when(F.col("connector_type") == c, F.struct(*[F.get_json_object("payload", p).alias(n) for n, p in zip(("name", "at", "signal", "amount"), paths, strict=True)])).otherwise(fields)
    found = made.withColumn("f", fields)
    return found.select("id", "connector_type", "f.name", "f.at", "f.signal", F.col("f.amount").cast("double").alias("amount"))


@query("delivery_states", "SELECT id, CASE id % 5 WHEN 0 THEN 'delivered' WHEN 1 THEN 'rate_limited' WHEN 2 THEN 'credential_error' WHEN 3 THEN 'permanently_failed' ELSE 'failed' END AS status, (id % 4 + 1)::INTEGER AS attempts, CASE id % 5 WHEN 1 THEN least(60 * power(2, id % 4), 3600) WHEN 4 THEN least(5 * power(2, id % 4), 3600) END::BIGINT AS wait FROM a_events WHERE event_type = 'sale'")
def _(t: Tables) -> DataFrame:
    now = F.lit(NOW).cast("timestamp")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 429, 401, 404, 500)]), (F.col("id") % 5 + 1).cast("int"))
    tried = t.events.where("event_type = 'sale'").select("id", status.alias("response_status"), (F.col("id") % 4).cast("int").alias("attempts"))
    done = connectors.after_delivery(tried, now)
    return done.select("id", "status", "attempts", (F.unix_seconds("next_retry_at") - F.unix_seconds(now)).alias("wait"))


@query("reconciliation", "SELECT id AS event_id, c AS connector_type FROM a_events e, (SELECT unnest(['meta', 'google']) AS c) WHERE event_type IN ('lead', 'sale') AND inserted_at >= TIMESTAMP '2024-01-15' AND ((c = 'meta' AND id % 3 = 0 AND event_type <> 'sale') OR (c = 'google' AND id % 2 = 0))")
def _(t: Tables) -> DataFrame:
    return connectors.reconcile(_signalled(t), t.dispatches, ("meta", "google"), datetime(2024, 1, 15, tzinfo=UTC)).select("event_id", "connector_type")


@query("dispatch_batches", f"SELECT id AS event_id, c AS connector_type, count(*) AS dispatches FROM a_events, (SELECT unnest(['meta', 'google', 'linkedin']) AS c) WHERE {REASONS} IS NULL GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    """A batch of the early events, the same batch again, and one of all events: each event is dispatched once to each connector."""
    sink = Batches(scratch_path(t.spark, "sink"), "dispatches", DISPATCHES)
    handler = connectors.after_commit(("meta", "google", "linkedin"), sink)
    early = _signalled(t).where(F.col("inserted_at") < F.lit(datetime(2024, 1, 15, tzinfo=UTC)))
    for number, batch in ((0, early), (0, early), (1, _signalled(t))):
        handler(batch, number)
    return sink.read(t.spark).groupBy(F.col("event_id").cast("long").alias("event_id"), "connector_type").agg(F.count("*").alias("dispatches"))


# Identity.


@query(
    "identity_merge",
    """WITH RECURSIVE k AS (SELECT id, first_seen_at, 'e' || person_email AS k FROM a_visitors WHERE status <> 'merged' AND person_email IS NOT NULL UNION ALL SELECT id, first_seen_at, 'x' || person_external_id FROM a_visitors WHERE status <> 'merged' AND person_external_id IS NOT NULL),
    r AS (SELECT id AS a, id AS b FROM a_visitors WHERE status <> 'merged' UNION SELECT r.a, y.id FROM r JOIN k x ON x.id = r.b JOIN k y ON y.k = x.k)
    SELECT a AS visitor_id, arg_min(b, (m.first_seen_at, b)) AS survivor_id FROM r JOIN a_visitors m ON m.id = r.b GROUP BY 1""",
)
def _(t: Tables) -> DataFrame:
    return identity.components(t.visitors)


@query("identity_candidates", "SELECT o.order_id AS request_id, array_to_string(list(x.id ORDER BY x.first_seen_at, x.id), ' ') AS candidates FROM (SELECT o_orderkey AS order_id, o_custkey FROM orders) o JOIN a_visitors x ON x.status <> 'merged' AND (x.person_email = 'u' || (o.o_custkey % 150) || '@example.org' OR x.person_external_id = 'x' || (o.o_custkey % 90)) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    zero = F.lit("00000000-0000-0000-0000-000000000000").alias("workspace_id")
    asked = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), zero, F.format_string("u%d@example.org", F.col("o_custkey") % 150).alias("person_email"), F.format_string("x%d", F.col("o_custkey") % 90).alias("person_external_id"))
    found = identity.resolve(asked, t.visitors).where("visitor_id IS NOT NULL")
    return found.select("request_id", F.array_join(F.concat(F.array("visitor_id"), "merged_ids"), " ").alias("candidates"))


@query(
    "identity_replay",
    """WITH r AS (SELECT id, visitor_id, inserted_at, event_type = 'sale' OR id % 2 = 0 AS p, event_type = 'sale' OR id % 2 = 1 AS q FROM a_events),
    s AS (SELECT *, coalesce(bool_or(p) OVER w, false) AS had_p, coalesce(bool_or(q) OVER w, false) AS had_q, coalesce(bool_or(p AND q) OVER w, false) AS tied FROM r
      WINDOW w AS (PARTITION BY visitor_id ORDER BY inserted_at, id::VARCHAR ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT id AS request_id, CASE WHEN NOT ((p AND had_p) OR (q AND had_q)) THEN 'create' WHEN p AND q AND had_p AND had_q AND NOT tied THEN 'merge' ELSE 'update' END AS action FROM s""",
)
def _(t: Tables) -> DataFrame:
    """Events as requests: a fingerprint or an anonymous id of the visitor, sales with both, which ties them together."""
    signal = lambda k, n: F.when((F.col("event_type") == "sale") | (F.col("id") % 2 == n), F.concat(F.lit(k), F.col("visitor_id").cast("string")))
    asked = t.events.select(F.col("id").alias("request_id"), "workspace_id", F.col("inserted_at").alias("at"), signal("f", 0).alias("fingerprint"), signal("n", 1).alias("anonymous_id"))
    actions, _changed = replay.replay(asked, t.visitors.limit(0))
    return actions.select("request_id", "action")


@query("canonical_visitors", "SELECT c AS canonical_id, count(*) AS events FROM j e GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return with_visitors(t.events, t.visitors).groupBy("canonical_id").agg(F.count("*").alias("events"))


@query("forget_visitors", "SELECT event_type, count(*) AS events FROM a_events WHERE visitor_id % 5 <> 0 GROUP BY 1")
def _(t: Tables) -> DataFrame:
    gone = t.visitors.where("id % 5 = 0").select(F.col("id").alias("visitor_id"))
    _visitors, kept = people.forget(t.visitors, t.events, gone)
    return kept.groupBy("event_type").agg(F.count("*").alias("events"))


@query("forgotten_visitors", "SELECT id, CASE WHEN id % 5 = 0 THEN 'anonymous' ELSE status END AS status, CASE WHEN id % 5 <> 0 THEN person_email END AS person_email, CASE WHEN id % 5 <> 0 THEN identified_at END AS identified_at, CASE WHEN id % 5 = 0 THEN TIMESTAMP '1970-01-01' ELSE last_seen_at END AS last_seen_at FROM a_visitors")
def _(t: Tables) -> DataFrame:
    gone = t.visitors.where("id % 5 = 0").select(F.col("id").alias("visitor_id"))
    left, _events = people.forget(t.visitors, t.events, gone)
    return left.select("id", "status", "person_email", "identified_at", "last_seen_at")


@query("identity_actions", "SELECT request_id, CASE WHEN n = 0 THEN 'create' WHEN n > 1 AND strong THEN 'merge' ELSE 'update' END AS action, visitor_id FROM (SELECT o_orderkey AS request_id, count(DISTINCT x.id) AS n, any_value(o_orderkey % 3 = 0) AS strong, arg_min(x.id, (x.first_seen_at, x.id)) AS visitor_id FROM orders LEFT JOIN a_visitors x ON x.status <> 'merged' AND ((o_orderkey % 3 <> 0 AND x.id % 7 = o_custkey % 9) OR (o_orderkey % 3 = 0 AND x.person_email = 'u' || (o_custkey % 150) || '@example.org')) GROUP BY 1) y")
def _(t: Tables) -> DataFrame:
    """A seventh of the visitors shares each of seven fingerprints; a third of the requests has an e-mail instead and may merge."""
    held = t.visitors.withColumn("fingerprints", F.array(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"))))
    email = F.when(F.col("o_orderkey") % 3 == 0, F.format_string("u%d@example.org", F.col("o_custkey") % 150))
    asked = t.raw("orders").select(F.col("o_orderkey").alias("request_id"), F.lit(DEFAULT_WORKSPACE).alias("workspace_id"), F.when(email.isNull(), F.concat(F.lit("f"), (F.col("o_custkey") % 9).cast("string"))).alias("fingerprint"), email.alias("person_email"))
    return identity.resolve(asked, held).select("request_id", "action", F.col("visitor_id").cast("long").alias("visitor_id"))


# Ingest.


@query("ingest_rejects", "SELECT coalesce(CASE WHEN user_id % 11 = 0 THEN 'visitor_id is missing' WHEN event_type = 'error' THEN 'event_type is unknown' END, 'ok') AS outcome, count(*) AS events FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    raw = t.events.withColumns({"visitor_id": F.when(F.col("visitor_id") % 11 != 0, F.col("visitor_id")), "event_type": F.when(F.col("event_type") == "custom", "mystery").otherwise(F.col("event_type"))})
    good, bad = tables.ingest(raw)
    return good.select(F.lit("ok").alias("outcome")).unionByName(bad.select(F.col("error").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("events"))


@query("recorded_clicks", "SELECT event_id AS id, 'link_click' AS event_type, user_id AS link, CASE WHEN event_id % 3 = 0 THEN 'true' END AS qr FROM events WHERE event_type <> 'error'")
def _(t: Tables) -> DataFrame:
    raw = t.events.where("event_type <> 'custom'").withColumns({"link_id": F.col("visitor_id"), "qr": F.col("id") % 3 == 0})
    good, _ = tables.record_clicks(raw)
    return good.select("id", "event_type", F.col("link_id").alias("link"), F.try_element_at("properties", F.lit("qr")).alias("qr"))


@query("idempotent_events", "SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY id % 700 ORDER BY inserted_at, id) AS n FROM a_events) x WHERE n = 1")
def _(t: Tables) -> DataFrame:
    keyed = t.events.withColumn("properties", F.create_map(F.lit("_idempotency_key"), (F.col("id") % 700).cast("string")))
    return tables.drop_repeated(keyed).select("id")


AGENTS = ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36", "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 Version/17.2 Mobile/15E148 Safari/604.1", "Mozilla/5.0 (compatible; Examplebot/2.1)", "")


@query("device_labels", "SELECT CASE event_id % 4 WHEN 0 THEN 'Desktop · Windows 10.0 · Chrome 120.0' WHEN 1 THEN 'Mobile · iOS 17.2 · Safari 17.2' WHEN 2 THEN 'Bot · Examplebot' ELSE 'Unknown' END AS label, count(*) AS events FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    agent = F.element_at(F.array(*[F.lit(x) for x in AGENTS]), (F.col("event_id") % 4 + 1).cast("int"))
    parsed = t.raw("events").select(devices.parse(agent).alias("d"))
    return parsed.groupBy(devices.label(F.col("d")).alias("label")).agg(F.count("*").alias("events"))


@query("settings_upsert", "SELECT user_id % 20 AS key, arg_max(event_id, (ts, event_id)) AS value FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.raw("events").select(F.lit("w").alias("workspace_id"), (F.col("user_id") % 20).cast("string").alias("key"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("value"), F.col("ts").cast("timestamp").alias("updated_at"))
    found = tables.upsert_settings(rows.limit(0), rows)
    return found.select(F.col("key").cast("long").alias("key"), F.regexp_extract("value", r"(\d+)\}$", 1).cast("long").alias("value"))


@query("referrers", "SELECT CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END AS captured, count(*) AS pages FROM pages GROUP BY 1")
def _(t: Tables) -> DataFrame:
    params = urls.query_params(F.concat(F.lit("https://x.org/?"), F.coalesce(F.expr(EXTRA), F.lit(""))))
    return t.raw("pages").select(F.size(traffic.captured_click_ids(params)).alias("captured")).groupBy("captured").agg(F.count("*").alias("pages"))


@query("geo_ranges", "SELECT o_orderkey AS id, c_nationkey::VARCHAR AS country_code FROM orders LEFT JOIN customer ON c_custkey = o_orderkey // 64 AND o_orderkey % 64 < 32")
def _(t: Tables) -> DataFrame:
    """Orders as addresses, customers as ranges of 32 of 64 addresses."""
    address = lambda n: F.concat_ws(".", *[F.shiftright(n, k).bitwiseAND(F.lit(255)).cast("string") for k in (24, 16, 8, 0)])
    low = F.col("c_custkey") * 64
    ranges = t.raw("customer").select(devices.address_key(address(low)).alias("low"), devices.address_key(address(low + 31)).alias("high"), F.create_map(F.lit("country_code"), F.col("c_nationkey").cast("string")).alias("geo"))
    asked = t.raw("orders").select(F.col("o_orderkey").alias("id"), address(F.col("o_orderkey")).alias("ip_address"))
    return tables.enrich_geo(asked, ranges).select("id", F.col("geo")["country_code"].alias("country_code"))
