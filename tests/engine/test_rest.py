"""URLs, traffic, sessions, clicks, identity, ingest, connectors and streams."""

import random
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from wayfarer import more_queries
from wayfarer.functions import devices, traffic, urls, values
from wayfarer.operators import clicks, connectors, identity, people, sessions
from wayfarer.operators.base import scan_events
from wayfarer.plans.filters import Funnel, SourceFilter, Step, StepFilter
from wayfarer.plans.schemas import CONVERSION_TYPES, DEFAULT_WORKSPACE, DISPATCHES, INTERACTIVE_TYPES
from wayfarer.plans.windows import TimeWindow
from wayfarer.sources import records, tables
from wayfarer.sources.batches import Batches
from wayfarer.streaming import sessions as streams

from .conftest import T0
from .test_analytics import event, rows, visitor


def each(spark, made, *given):
    """made applied to every value of a one-column table, in order."""
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string").orderBy("i")
    return [r.y for r in df.select("i", made(F.col("x")).alias("y")).orderBy("i").collect()]


def test_hosts_and_paths(spark):
    given = ["https://App.Acme.COM/pricing?utm=x#hero", "http://acme.com:80/x", "https://acme.com:8443/x", "/just/a/path", "not-a-url", None, "", "ftp://h/x", "https://u:p@h.de/"]
    assert each(spark, urls.host, *given) == ["app.acme.com", "acme.com", "acme.com:8443", None, None, None, None, "h:21", "h.de"]
    given = ["https://acme.com//docs///guide", "https://acme.com/pricing/", "#/dashboard", "not-a-url", None, "", "https://a.b"]
    assert each(spark, urls.path, *given) == ["/docs/guide", "/pricing", "/", "/not-a-url", "/", "/", "/"]
    given = ["https://example.com///", "https://Example.com/pricing?fbclid=abc#hero", "/x//y/"]
    assert each(spark, urls.path_for_grouping, *given) == ["https://example.com/", "https://example.com/pricing", "/x/y"]
    given = ["https://a.b//x//y/?q=1", "/", None, "?q", "https://a.b/x#y"]
    assert each(spark, urls.normalized_url, *given) == ["https://a.b/x/y", "/", "/", "/", "https://a.b/x#y"]


def test_query_parameters(spark):
    assert each(spark, urls.query_params, "https://a.b/?a=1&b=x%20y+z&a=2&c&d==#a=9", "/x", None) == [{"a": "2", "b": "x y z", "c": "", "d": "="}, {}, {}]


def test_query_parameters_are_cut_and_sorted_once(spark, tmp_path):
    many = "https://a.b/?" + "&".join(f"k{i % 70}={i}" for i in range(200))
    assert each(spark, urls.query_params, many, "https://a.b/?é=ü&%C3%A9=%zz&+=1=2&?a") == [{f"k{i % 70}": str(i) for i in range(200)}, {"é": "%zz", " ": "1=2", "?a": ""}]
    plan = spark.createDataFrame([(many,)], "u string").select(urls.query_params(F.col("u")).alias("q"))._jdf.queryExecution().analyzed().toString()
    assert (plan.count("split("), plan.count("array_sort(") + plan.count("sort_array("), plan.count("aggregate(")) == (1, 1, 0)
    spark.range(9).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    assert more_queries.QUERIES["url_parameters"](spark, str(tmp_path)).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def classified(spark, query, referer=None):
    df = spark.createDataFrame([(f"https://shop/?{query}", referer)], "u string, r string")
    return df.select(traffic.classify(urls.query_params(F.col("u")), F.col("r")).alias("c")).first().c


@pytest.mark.parametrize(
    ("query", "referer", "platform", "medium"),
    [
        ("gclid=1", None, "google_ads", "paid"),
        ("fbclid=1", None, "meta", "social"),
        ("msclkid=1&fbclid=2", None, "meta", "social"),
        ("", "https://www.google.com/search", "google", "organic"),
        ("", "https://t.co/x", "twitter", "social"),
        ("", "https://blog.example.org/x", "referral", "referral"),
        ("", None, "direct", "direct"),
        ("", "", "direct", "direct"),
        ("utm_source=news&utm_medium=ppc", "https://t.co/x", "news", "paid"),
        ("utm_source=WWW.ChatGPT.com", None, "chatgpt", "ai"),
        ("utm_campaign=c", "https://t.co/x", None, "unknown"),
        ("via=ann", "https://t.co/x", "twitter", "referral"),
        ("ref=bob&utm_source=news", None, "news", "referral"),
        ("", "https://mail.google.com/", "gmail", "email"),
        ("", "https://perplexity.ai/", "perplexity", "ai"),
    ],
)
def test_traffic_sources(spark, query, referer, platform, medium):
    found = classified(spark, query, referer)
    assert (found.platform, found.medium) == (platform, medium)


def test_traffic_details_and_overrides(spark):
    found = classified(spark, "gclid=1&fbclid=2&utm_campaign=c&via=ann")
    assert found.captured_click_ids == {"gclid": "1", "fbclid": "2"} and found.campaign == "c" and found.partner_code == "ann" and found.confidence == "high"
    df = spark.createDataFrame([("zid=7", "https://my.org/")], "q string, r string")
    made = traffic.classify(F.str_to_map("q", F.lit("&"), F.lit("=")), F.col("r"), {"zid": ("z", "paid")}, {"my.org": ("mine", "own")})
    assert df.select(made["platform"]).first()[0] == "z"
    assert len(traffic.CLICK_IDS) == 12 and len(traffic.REFERER_HOSTS) == 115


def test_redirects_and_shares(spark):
    df = spark.createDataFrame([("https://d.org/x?a=1&utm_source=own", {"a": "9", "via": "no", "z": "ok", "k" * 65: "no"})], "u string, q map<string,string>")
    params = urls.redirect_params(urls.query_params(F.col("u")), F.create_map(F.lit("utm_source"), F.lit("link"), F.lit("utm_term"), F.lit(None)), F.col("q"), F.lit("c1"))
    assert df.select(urls.redirect_url(F.col("u"), params)).first()[0] == "https://d.org/x?a=9&ga_id=c1&utm_source=link&z=ok"
    agent = lambda ua: spark.range(1).select(urls.destination(F.lit(ua), F.lit("web"), F.lit("ios"), F.lit(None).cast("string"), F.create_map(F.lit("DE"), F.lit("https://de.x/")), F.lit("de" if ua == "de" else "fr"))).first()[0]
    assert (agent("iPhone"), agent("Android"), agent("de")) == ("ios", "web", "https://de.x/")
    shared = urls.share_urls("https://s.l/x", text="Look here")
    assert shared["twitter"] == "https://twitter.com/intent/tweet?url=https%3A%2F%2Fs.l%2Fx&text=Look+here" and shared["copy"] == "https://s.l/x" and len(shared) == 8


def test_collections(spark):
    df = spark.createDataFrame([(["a", "b"], {"x": "1", "y": "2"}, {"y": "3"})], "l array<string>, m map<string,string>, n map<string,string>")
    got = df.select(values.add_unique(F.col("l"), F.lit("b")), values.concat_unique(F.col("l"), F.array(F.lit("c"), F.lit("a"))), values.merge_maps(F.col("m"), F.col("n")), values.empty_map(F.create_map()), values.contains(F.col("l"), "a")).first()
    assert tuple(got) == (["b", "a"], ["a", "b", "c"], {"x": "1", "y": "3"}, True, True)
    points = lambda *at: [{"p": str(t), "timestamp": t} for t in at]
    df = spark.createDataFrame([(points("2026-01-02T00:00:00Z", "bad"), points("2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z"))], "a array<map<string,string>>, b array<map<string,string>>")
    merged = df.select(values.merge_touchpoints(F.col("a"), F.col("b"))).first()[0]
    assert [p["timestamp"] for p in merged] == ["2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "bad"]
    many = spark.range(1).select(values.last_touchpoints(F.sequence(F.lit(1), F.lit(70)))).first()[0]
    assert many == list(range(21, 71))


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    at = F.lit(T0).cast("timestamp")
    assert one(values.uuid_or_null(F.lit("ABCDEF00-0000-0000-0000-000000000001"))) == "abcdef00-0000-0000-0000-000000000001" and one(values.uuid_or_null(F.lit("x"))) is None
    v7 = one(values.uuid_v7(at, F.lit("seed")))
    assert values.re.match(values.UUID, v7) and v7[14] == "7" and v7[19] in "89ab"
    assert one(values.hop_seconds(at, at + F.expr("interval 59 minutes"))) == 1800 and one(values.hop_seconds(F.lit(None).cast("timestamp"), at)) == 0
    assert [one(values.backoff_seconds(F.lit(n))) for n in (1, 2, 30)] == [5, 10, 3600]
    assert [one(values.error_class(F.lit(s))) for s in (429, 401, 404, 500)] == ["rate_limited", "credential", "permanent", "transient"]
    assert one(values.json_text(F.lit('{"a.b":true,"c":null}'), "a.b")) == "true"
    assert one(values.url_guard(F.lit("x" * 2084))) is None and one(values.scroll_guard(F.lit(101))) is None and one(values.engaged_ms_guard(F.lit(5))) == 5
    slug = values.new_slug(7, random.Random(1))
    assert values.valid_slug(slug) and not values.valid_slug("a b") and not set(slug) & set("0OlI1")


AGENTS = {
    "Mozilla/5.0 (iPhone; CPU iPhone OS 17_2 like Mac OS X) AppleWebKit/605.1.15 Version/17.2 Mobile/15E148 Safari/604.1": "Mobile · iOS 17.2 · Safari 17.2",
    "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/120.0.0.0 Safari/537.36 Edg/120.0.1": "Desktop · Windows 10.0 · Edge 120.0",
    "Mozilla/5.0 (Linux; Android 13; SM-X200) AppleWebKit/537.36 Chrome/119.0 Safari/537.36": "Tablet · Android 13 · Chrome 119.0",
    "Mozilla/5.0 (compatible; Googlebot/2.1)": "Bot · Googlebot",
    "": "Unknown",
}


def test_devices(spark):
    assert each(spark, lambda x: devices.label(devices.parse(x)), *AGENTS) == list(AGENTS.values())
    assert each(spark, devices.humanize_type, "phablet", "smart display", None) == ["Mobile", "Smart display", "Unknown"]
    keys = each(spark, devices.address_key, "10.0.0.1", "10.0.0.2", "::1", "x", "1" * 46)
    assert keys[0] < keys[1] and keys[2] == "0" * 31 + "1" and keys[3:] == [None, None]


def fold(events, gap=1800):
    """Sessions row by row, as they would be made online."""
    done, live = [], {}
    for e in sorted(events, key=lambda e: (e["visitor_id"], e["inserted_at"], int(e["id"]))):
        s = live.get(e["visitor_id"])
        at, kind = e["inserted_at"], e["event_type"]
        parts = [None if (v := (e.get(c) or "").strip() or None) and i < 2 and v.lower() == "direct" else v for i, c in enumerate(sessions.TUPLE)]
        acq = tuple(parts) if any(parts) else None
        on = s is not None and at - s["last"] <= timedelta(seconds=gap)
        if kind == "engagement":
            if on:
                s["duration"] += min((at - s["last"]) // timedelta(seconds=1), 1800)
                s["engaged"] += (e.get("engaged_ms") or 0) // 1000
                s["last"] = at
            continue
        if on and acq and s["acq"] and acq != s["acq"]:
            on = False
        page = e.get("path") or None
        if not on:
            s = {"visitor": e["visitor_id"], "start": at, "last": at, "entry": page, "exit": page, "views": 0, "events": 0, "duration": 0, "engaged": 0, "acted": False, "sold": False, "acq": acq}
            live[e["visitor_id"]] = s
            done.append(s)
        else:
            s["duration"] += min((at - s["last"]) // timedelta(seconds=1), 1800)
            if kind == "pageview" and page:
                s["exit"] = page
        s["last"] = at
        s["views"] += kind == "pageview"
        s["events"] += 1
        s["acted"] |= kind in INTERACTIVE_TYPES
        s["sold"] |= kind in CONVERSION_TYPES
        s["acq"] = s["acq"] or acq
    return sorted((s["visitor"], s["start"], s["last"], s["entry"], s["exit"], s["views"], s["events"], s["duration"], s["engaged"], not s["acted"] and s["views"] < 2, s["views"] >= 2 or s["sold"] or s["engaged"] >= 10, (s["acq"] or (None,))[0]) for s in done)


def random_events(seed, n=25):
    rng, found = random.Random(seed), []
    for v in range(n):
        at = T0
        for _ in range(rng.randint(1, 25)):
            at += rng.choice([timedelta(seconds=1800), timedelta(seconds=1800, microseconds=1), timedelta(seconds=rng.randint(1, 4000)), timedelta(microseconds=rng.randint(1, 10**9))])
            kind = rng.choice(["pageview", "pageview", "link_click", "lead", "sale", "session_start", "engagement"])
            source = {} if kind == "engagement" else {"source_platform": rng.choice([None, "google", " google", "Direct", "bing", ""]), "source_medium": rng.choice([None, "direct", "cpc"]), "click_id": rng.choice([None, None, "c1"])}
            found.append({"id": str(len(found)), "visitor_id": f"v{v:03}", "event_type": kind, "inserted_at": at, "path": f"/{rng.randint(0, 3)}", "engaged_ms": rng.choice([None, 900, 12_000]), **source})
    return found


def plain(r):
    utc = lambda x: x.replace(tzinfo=UTC) if x.tzinfo is None else x.astimezone(UTC)
    return (r.visitor_id, utc(r.started_at), utc(r.last_event_at), r.entry_page, r.exit_page, r.pageviews, r.events, r.duration_seconds, r.engaged_seconds, r.is_bounce, r.is_engaged)


@pytest.mark.parametrize("seed", [1, 2])
def test_sessions_equal_the_fold(make, seed):
    given = random_events(seed)
    found = sessions.sessions(make("events", [e | {"id": e["id"].zfill(6)} for e in given])).collect()
    assert sorted((*plain(r), r.source_platform) for r in found) == fold(given)


@pytest.mark.parametrize(
    ("gaps", "sources", "count"),
    [([20], ["google", "google"], 1), ([31], ["google", "google"], 2), ([1], ["google", "bing"], 2), ([1], ["direct", "google"], 1), ([1], ["google", "direct"], 1), ([30], [None, None], 1)],
)
def test_session_rules(make, gaps, sources, count):
    e, at = [], 0
    for i, s in enumerate(sources):
        e.append(event(i, "x", at=at, source_platform=s, path=f"/{i}"))
        at += gaps[0]
    found = sessions.sessions(make("events", e)).collect()
    assert len(found) == count
    if count == 1:
        assert found[0].exit_page == "/1" and not found[0].is_bounce and found[0].source_platform == next((s for s in sources if s not in (None, "direct")), None)


def test_backfill_is_idempotent(make):
    e = make("events", [event(i, "x", at=at) for i, at in enumerate([0, 10, 60])])
    stamped, made = sessions.backfill(e)
    assert made.count() == 2 and stamped.select("session_id").distinct().count() == 2
    again, none = sessions.backfill(stamped)
    assert again.count() == 0 and none.count() == 0


def test_unique_clicks(spark):
    rng = random.Random(4)
    given = [(i, f"ip{rng.randint(0, 2)}", rng.randint(0, 2), T0 + timedelta(seconds=rng.randint(0, 40_000))) for i in range(300)]
    given += [(1000, "a", 9, T0), (1001, "a", 9, T0 + timedelta(hours=1)), (1002, "a", 9, T0 + timedelta(minutes=119))]
    want, last = {}, {}
    for i, ip, link, at in sorted(given, key=lambda x: (x[3], x[0])):
        want[i] = (ip, link) not in last or at - last[ip, link] >= timedelta(hours=1)
        if want[i]:
            last[ip, link] = at
    df = spark.createDataFrame(given, "id long, ip_address string, link_id long, inserted_at timestamp")
    assert {r.id: r.is_unique for r in clicks.mark_unique(df).collect()} == want
    stats = {r.link_id: (r.total_clicks, r.unique_clicks) for r in clicks.link_stats(df).collect()}
    assert stats[9] == (3, 2)


def test_merges(make):
    v = make(
        "visitors",
        [
            visitor("a", first_seen_at=0, last_seen_at=9, person_email="m", geo={}, fingerprints=["f1"], last_partner_id="p1"),
            visitor("b", first_seen_at=1, last_seen_at=2, person_email="m", ga_id="g", geo={"country_code": "GB"}, fingerprints=["f2", "f1"], first_partner_id="p2"),
            visitor("c", first_seen_at=2, last_seen_at=3, ga_id="g", geo={"country_code": "US"}, first_partner_id="p3", last_partner_id="p3"),
            visitor("d", first_seen_at=3, fingerprints=["f1"]),
        ],
    )
    groups = identity.components(v)
    assert {r.visitor_id: r.survivor_id for r in groups.collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}  # a fingerprint merges nobody
    after = {r.id: r for r in identity.merge(v, groups).collect()}
    assert after["a"].fingerprints == ["f1", "f2"] and after["a"].geo == {"country_code": "GB"} and after["a"].first_partner_id == "p2" and after["a"].last_partner_id == "p1"
    assert after["b"].status == after["c"].status == "merged" and after["c"].merged_into_id == "a" and after["d"].status == "anonymous"
    e = make("events", [event(1, "c"), event(2, "d")])
    assert sorted(r.visitor_id for r in identity.repoint(e, groups).collect()) == ["a", "d"]


def test_resolving(spark, make):
    v = make("visitors", [visitor("a", first_seen_at=0, fingerprints=["f"], person_email="m"), visitor("b", first_seen_at=1, fingerprints=["f"], anonymous_ids=["n"]), visitor("z", status="merged", fingerprints=["f"])])
    w = v.first().workspace_id
    asked = [("1", w, "f", None, None), ("2", w, "f", "n", None), ("3", w, None, None, "m"), ("4", w, "new", None, None), ("5", w, "f", None, "other")]
    signals = spark.createDataFrame(asked, "request_id string, workspace_id string, fingerprint string, anonymous_id string, person_email string")
    got = {r.request_id: (r.action, r.visitor_id, r.merged_ids) for r in identity.resolve(signals, v).collect()}
    assert got == {"1": ("update", "a", []), "2": ("merge", "a", ["b"]), "3": ("update", "a", []), "4": ("create", None, []), "5": ("merge", "a", ["b"])}
    made = identity.create_visitors(signals, F.concat(F.lit("v"), "request_id"), F.lit(T0)).collect()
    assert made[0].fingerprints == ["f"] and made[0].status == "anonymous"
    changed = identity.update_visitors(v, signals.where("request_id = '2'").withColumn("visitor_id", F.lit("a")), F.lit(T0 + timedelta(days=1)))
    assert {r.id: (r.fingerprints, r.anonymous_ids) for r in changed.collect()}["a"] == (["f"], ["n"])


def test_identify_merges_into_the_older(spark, make):
    v = make("visitors", [visitor("a", first_seen_at=0, person_external_id="x"), visitor("b", first_seen_at=5), visitor("c", first_seen_at=6)])
    persons = spark.createDataFrame([("b", "x", "Bo")], "visitor_id string, person_external_id string, person_name string")
    after, groups = identity.identify(v, persons, F.lit(T0).cast("timestamp"))
    by_id = {r.id: r for r in after.collect()}
    assert by_id["b"].status == "merged" and by_id["b"].merged_into_id == "a" and by_id["a"].person_name == "Bo" and by_id["a"].status == "identified" and by_id["c"].status == "anonymous"


def test_people(spark, make):
    v = make("visitors", [visitor("a", geo={}), visitor("b", geo={"country_code": "FR"}, person_email="m", first_partner_id="p")])
    new = spark.createDataFrame([("a", {"country_code": "US"}), ("b", {"country_code": "US"})], "visitor_id string, geo map<string,string>")
    assert {r.id: r.geo["country_code"] for r in people.set_if_empty(v, new, "geo").collect()} == {"a": "US", "b": "FR"}
    touched = people.set_partners(v, spark.createDataFrame([("a", "q", "r"), ("b", "q", "r")], "visitor_id string, first_partner_id string, last_partner_id string"))
    assert {r.id: (r.first_partner_id, r.last_partner_id) for r in touched.collect()} == {"a": ("q", "r"), "b": ("p", "r")}
    e = make("events", [event(1, "a"), event(2, "b")])
    after, kept = people.forget(v, e, spark.createDataFrame([("b",)], "visitor_id string"))
    b = {r.id: r for r in after.collect()}["b"]
    assert b.person_email is None and b.geo == {} and b.first_seen_at.year == 1970 and [r.visitor_id for r in kept.collect()] == ["a"]
    links = make("links", [{"id": "1", "domain": "d", "key": "k"}, {"id": "2", "domain": "e", "key": "k"}, {"id": "3", "domain": "d", "key": "old", "archived_at": 1}, {"id": "4", "domain": "d", "key": "over", "expires_at": -1}])
    assert people.resolve_live_link(links, "k", T0).count() == 0 and people.resolve_live_link(links, "k", T0, "d").count() == 1
    assert people.resolve_live_link(links, "old", T0).count() == 0 and people.resolve_live_link(links, "over", T0).count() == 0
    assert people.archive(links, ["1"], T0).where("archived_at IS NULL").count() == 2


def test_ingest(make):
    raw = make("events", [event(1, "a", url="https://A.b//x/", user_agent=list(AGENTS)[0], source={"platform": "p" * 300}, properties={"_idempotency_key": "k"}), event(2, "a", at=1, properties={"_idempotency_key": "k"}), event(3, None), event(4, "a", "api_request"), event(5, "a", url="u" * 2084), event(6, "a")])
    good, bad = tables.ingest(raw)
    first = {r.id: r for r in good.collect()}
    assert set(first) == {"1", "6"} and first["1"].host == "a.b" and first["1"].path == "/x" and len(first["1"].source_platform) == 255 and first["1"].device_type == "smartphone"
    assert {r.id: r.error for r in bad.collect()} == {"3": "visitor_id is missing", "4": "event_type is unknown", "5": "url is too long"}
    again, _ = tables.ingest(raw, history=good)
    assert {r.id for r in again.collect()} == {"6"}
    filled = tables.backfill_devices(make("events", [event(1, "a", user_agent="odd"), event(2, "a")]))
    assert {r.id: r.device_type for r in filled.collect()} == {"1": "unknown", "2": None}


def test_typed_recorders(make):
    raw = make("events", [event(1, "a", None, link_id="l", properties={"qr": "old", "x": "1"}), event(2, "a", None, link_id="l"), event(3, None, None)])
    clicks, bad = tables.record_clicks(raw.withColumn("qr", F.col("id") == "1"))
    found = {r.id: r for r in clicks.collect()}
    assert {r.event_type for r in found.values()} == {"link_click"} and found["1"].properties == {"qr": "true", "x": "1"} and not found["2"].properties
    assert "qr" not in clicks.columns and [r.id for r in bad.collect()] == ["3"]
    named, _ = tables.record_custom(raw, "signup_step")
    assert {(r.event_type, r.event_name) for r in named.collect()} == {("custom", "signup_step")}
    assert {r.event_type for r in tables.record(raw, "sale")[0].collect()} == {"sale"}


def test_visitor_engagement(make):
    views = [event(i, "a", path=p, properties={"scroll_depth": d}) for i, (p, d) in enumerate([("/x", "50"), ("/x", "101"), ("/y", "70"), ("/b", "odd"), (None, None)])]
    found = {r.visitor_id: r for r in people.visitor_engagement(make("events", [*views, event(9, "b", "lead", path="/z"), event(10, None, path="/n")]), top=2).collect()}
    assert found["a"].avg_scroll_depth == 60 and found["a"].top_pages == [{"path": "/x", "pageviews": "2"}, {"path": "/b", "pageviews": "1"}]
    assert found["b"].avg_scroll_depth is None and found["b"].top_pages == [] and found[None].top_pages == [{"path": "/n", "pageviews": "1"}]


def test_event_files_are_pruned_by_month(spark, make, tmp_path):
    tables.write_events(make("events", [event(1, "a"), event(2, "a", at=60 * 24 * 40)]), str(tmp_path))
    back = tables.read(spark, str(tmp_path), "events")
    found = scan_events(back, TimeWindow(T0, T0 + timedelta(days=2)))
    assert [r.id for r in found.collect()] == ["1"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*event_month#\d+ (IN|=)", plan)


def test_engagement_settings_and_geo(spark, make):
    s = make("sessions", [{"id": "s1", "visitor_id": "a", "started_at": 0, "last_event_at": 10}])
    e = make("events", [event(1, "a", "engagement", at=41), event(2, "a", "engagement", at=42), event(3, "b", "engagement", at=5), event(4, "a", "engagement", at=40 + 1 / 60 / 1e6)])
    assert rows(tables.attach_engagement(e, s), "id", "session_id") == []
    e = make("events", [event(1, "a", "engagement", at=40), event(2, "a", "engagement", at=41), event(3, "b", "engagement", at=5), event(4, "a", "engagement", at=72), event(5, "a", "engagement", at=80), event(6, "a", "engagement", at=-1), event(7, "a", "engagement", at=40)])
    assert sorted(rows(tables.attach_engagement(e, s), "id", "session_id")) == [("1", "s1"), ("2", "s1"), ("7", "s1")]  # a beacon keeps the session live
    change = spark.createDataFrame([("w", "k", "1", T0), ("w", "k", "2", T0 + timedelta(1)), ("w", "j", '{"a":1}', T0)], "workspace_id string, key string, value string, updated_at timestamp")
    held = tables.upsert_settings(change.limit(0), change)
    assert tables.setting(held, "w", "k").first().value == "2" and tables.setting(held, "w", "j").first().value == '{"a":1}'
    ranges = spark.createDataFrame([("10.0.0.0", "10.0.3.255", {"country_code": "US"}), ("10.9.0.0", "10.12.255.255", {"country_code": "FR"}), ("2001:db8::", "2001:db8:ffff::", {"country_code": "DE"})], "a string, b string, geo map<string,string>")
    ranges = ranges.select(devices.address_key("a").alias("low"), devices.address_key("b").alias("high"), "geo")
    hosts = spark.createDataFrame([(1, "10.0.2.7"), (2, "10.0.4.1"), (3, "10.11.1.1"), (4, "2001:db8:5::1"), (5, None)], "id int, ip_address string")
    assert {r.id: r.geo and r.geo["country_code"] for r in tables.enrich_geo(hosts, ranges).collect()} == {1: "US", 2: None, 3: "FR", 4: "DE", 5: None}


def test_visitor_precedence(spark, make):
    v = make("visitors", [visitor("a", person_external_id="x"), visitor("b")])
    w = v.first().workspace_id
    asked = spark.createDataFrame([(1, w, "b", "x", None), (2, w, None, "x", "b"), (3, w, None, None, "b"), (4, w, "no", "x", "b"), (5, w, None, None, None)], "i int, workspace_id string, visitor_id string, external_id string, signal_visitor_id string")
    got = {r.i: (r.resolved_id, r.error and r.error[:3]) for r in tables.resolve_visitors(asked, v).collect()}
    assert got == {1: ("b", None), 2: ("a", None), 3: ("b", None), 4: (None, "404"), 5: (None, "422")}


def test_connectors(spark, make):
    e = make("events", [event(1, "a", "sale", amount_cents=1234, url="https://x/y?z"), event(2, "a", "lead"), event(3, "a")])
    signals = F.create_map(F.lit("_fbp"), F.lit("fb.1"), F.lit("gclid"), F.when(F.col("id") == "1", "g"), F.lit("li_fat_id"), F.lit("bad value"), F.lit("ttclid"), F.lit("t"))
    e = e.withColumns({"signals": connectors.valid_signals(signals), "consent": F.lit("consented")})
    planned = connectors.plan(e, ("meta", "google", "linkedin"))
    got = {(r.id, r.connector_type): r.skip_reason for r in planned.collect()}
    assert got["1", "meta"] is None and got["2", "google"] == "missing_signals" and got["1", "linkedin"] == "missing_signals" and got["1", "tiktok"] == "not_enabled" and got["3", "meta"] == "unsupported_event_type"
    assert connectors.plan(e, ("meta",), switched_on=False).count() == 0
    assert {r.skip_reason for r in connectors.plan(e.withColumn("consent", F.lit("denied")), ("meta",)).where("id = '1' AND connector_type = 'meta'").collect()} == {"no_consent"}
    sent = connectors.payloads(connectors.plan(e, ("meta", "google", "tiktok")), {"tiktok": {"pixel_code": "px"}})
    by = {(r.id, r.connector_type): r.payload for r in sent.collect()}
    assert '"event_name":"Purchase"' in by["1", "meta"] and '"value":12.34' in by["1", "meta"] and "custom_data" not in by["2", "meta"]
    assert '"gclid":"g"' in by["1", "google"] and '"url":"https://x/y"' in by["1", "tiktok"] and '"pixel_code":"px"' in by["1", "tiktok"]
    d = make("dispatches", [{"id": "1", "status": "failed", "attempts": 1, "max_attempts": 5, "next_retry_at": -1}, {"id": "2", "status": "pending", "attempts": 0, "max_attempts": 5}, {"id": "3", "status": "failed", "attempts": 5, "max_attempts": 5}, {"id": "4", "status": "rate_limited", "attempts": 1, "max_attempts": 5, "next_retry_at": 9}])
    assert [r.id for r in connectors.list_pending(d, T0).collect()] == ["1", "2"]
    assert {r.replayed_from_id for r in connectors.replay(d, F.lit(T0)).collect()} == {"1", "3"}


def stream_of(spark, df, path):
    df.write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def run(query_source, path, mode="append"):
    name = f"out_{abs(hash(str(path)))}"
    q = query_source.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination()
    return query_source.sparkSession.table(name).collect()


def test_streamed_sessions_equal_batch(spark, make, tmp_path, keyed_state):
    given = random_events(3, 8)
    end = max(e["inserted_at"] for e in given) + timedelta(days=1)
    df = make("events", [e | {"id": e["id"].zfill(6)} for e in given] + [{"id": "z1", "visitor_id": "late", "event_type": "pageview", "inserted_at": end}]).coalesce(1)
    found = run(streams.sessionize(stream_of(spark, df, tmp_path / "in")), tmp_path / "ck")
    want = [x[:11] for x in fold(given)]
    assert sorted(plain(r) for r in found if r.visitor_id != "late") == sorted(want)


def test_streamed_clicks_counts_and_keys(spark, make, tmp_path):
    df = make("events", [event(i, "x", "link_click", at=m, ip_address="1", link_id="l", properties={"_idempotency_key": str(m // 50)}) for i, m in enumerate([0, 10, 59, 60, 119, 121])]).coalesce(1)
    source = stream_of(spark, df, tmp_path / "in")
    assert sorted(r.id for r in run(streams.unique_clicks(source), tmp_path / "a")) == ["0", "3", "5"]
    assert sorted((r.bucket_start.hour, r.events) for r in run(streams.counts(source), tmp_path / "b", "complete")) == [(9, 3), (10, 2), (11, 1)]
    assert len(run(streams.drop_repeated(source), tmp_path / "c")) == 3
    seen = []
    q = streams.deliver(source, lambda batch, n: seen.append(batch.count()), str(tmp_path / "d"), (seen.append,)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [6, 0]


def test_funnel_definitions_are_kept(spark, tmp_path):
    one = Funnel("one", (Step("event", (StepFilter("event", event_type="pageview"),)), Step("property", (StepFilter("property", key="k", op="in", values=("1", "2")),), "k", "any")), 7, SourceFilter("google"))
    other = Funnel("other", one.steps[::-1])
    tables.write(records.funnel_rows(spark, [one, other], T0), str(tmp_path), "funnels")
    held = tables.read(spark, str(tmp_path), "funnels")
    ids = {r.name: r.id for r in records.list_funnels(held).collect()}
    assert records.get_funnel(held, ids["one"]) == one and records.get_funnel(held, ids["other"], DEFAULT_WORKSPACE) == other
    with pytest.raises(LookupError):
        records.get_funnel(held, ids["one"], "w2")
    rest = people.archive(held, [ids["one"]], T0)
    assert [r.name for r in records.list_funnels(rest).collect()] == ["other"] and records.list_funnels(rest, include_archived=True).count() == 2
    with pytest.raises(ValueError):
        Funnel.from_json(one.to_json().replace('"pageview"', '"nothing"'))


def test_recorded_clicks_say_qr(make):
    df = make("events", [event(i, "v", link_id="l", properties=p) for i, p in enumerate([None, {"a": "b"}, {"qr": "x"}, None])]).withColumn("qr", F.col("id") != "3")
    clicks_ = records.recorded(df, "link_click")
    assert {r.id: r.properties for r in clicks_.collect()} == {"0": {"qr": "true"}, "1": {"a": "b", "qr": "true"}, "2": {"qr": "true"}, "3": {}}
    assert {(r.event_type, r.event_name) for r in records.recorded(df.withColumn("event_name", F.lit("n")), "custom").collect()} == {("custom", "n")}
    with pytest.raises(ValueError):
        records.recorded(df, "nothing")


def test_sessions_move_with_their_counts(make):
    v = make("visitors", [visitor("a", total_sessions=1), visitor("b", total_sessions=2), visitor("c", total_sessions=None), visitor("d", total_sessions=4)])
    s = make("sessions", [{"id": str(i), "visitor_id": x} for i, x in enumerate("abbcd")])
    groups = v.select(F.col("id").alias("visitor_id"), F.when(F.col("id") == "d", "d").otherwise("a").alias("survivor_id"))
    counted, moved = identity.move_sessions(v, s, groups)
    assert dict(rows(counted, "id", "total_sessions")) == {"a": 4, "b": 0, "c": -1, "d": 4}
    assert sorted(rows(moved, "id", "visitor_id")) == [("0", "a"), ("1", "a"), ("2", "a"), ("3", "a"), ("4", "d")]


def test_dispatches_are_appended_after_commit(spark, make, tmp_path):
    out = str(tmp_path / "data")
    sink = Batches(out, "dispatches", DISPATCHES)
    each_batch = connectors.after_commit(("google",), sink)
    e = make("events", [event(1, "v", "sale"), event(2, "v", "pageview"), event(3, "v", "lead"), event(4, "v", "lead")])
    e = e.withColumns({"signals": F.when(F.col("id") != "4", F.create_map(F.lit("gclid"), F.lit("g"))), "consent": F.lit("consented")})
    source = stream_of(spark, e, tmp_path / "in")
    streams.deliver(source, each_batch, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    held = sink.read(spark)
    assert sorted(rows(held, "event_id", "connector_type", "status", "attempts", "max_attempts")) == [("1", "google", "pending", 0, 5), ("3", "google", "pending", 0, 5)]
    assert len(rows(connectors.list_by_event(held, "1"), "id")) == 1
    assert len(rows(connectors.list_by_workspace(held, DEFAULT_WORKSPACE, "google", ("pending",)), "id")) == 2
    assert not rows(connectors.list_by_workspace(held, DEFAULT_WORKSPACE, "google", ("failed",)), "id")


def test_times_in_payloads_are_utc(spark, make):
    e = make("events", [event(1, "v", "sale", at=150 * 24 * 60)]).withColumn("signals", F.create_map(F.lit("gclid"), F.lit("g")))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        planned = connectors.plan(e.withColumn("consent", F.lit("consented")), ("google",))
        made = connectors.payloads(planned, {}).first().payload
        context = e.select(connectors.source_context(F.col("signals"), {}, F.col("inserted_at")).alias("c")).first().c
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert '"conversionDateTime":"2026-06-04 09:00:00+00:00"' in made and '"captured_at":"2026-06-04T09:00:00.000000Z"' in context
