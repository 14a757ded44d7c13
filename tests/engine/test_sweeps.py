"""Sessions next to sessions that exist, by two keys and in any order; sinks that take a batch twice; ranks, ranges and hot signals."""

import random
from datetime import UTC, datetime, timedelta
from statistics import median

import pytest
from pyspark.sql import functions as F

from wayfarer.functions import devices
from wayfarer.operators import clicks, connectors, funnels, identity, linked, selection, sessions
from wayfarer.operators.base import months, scan_events
from wayfarer.plans.filters import Funnel, Step, StepFilter
from wayfarer.plans.schemas import CONVERSION_TYPES, DISPATCHES, EVENTS, INTERACTIVE_TYPES
from wayfarer.plans.windows import TimeWindow
from wayfarer.sources import tables
from wayfarer.sources.batches import Batches
from wayfarer.streaming import sessions as streams

from .conftest import T0
from .test_analytics import event, rows, visitor
from .test_rest import fold, plain, random_events, run

GAP = timedelta(minutes=30)
SESSION_FIELDS = ("visitor_id", "started_at", "last_event_at", "entry_page", "exit_page", "pageviews", "events", "duration_seconds", "is_bounce", "is_engaged", "source_platform", "source_medium", "click_id")


def acquired(e):
    parts = [(e.get(c) or "").strip() or None for c in sessions.TUPLE]
    parts = [None if i < 2 and p and p.lower() == "direct" else p for i, p in enumerate(parts)]
    return tuple(parts) if any(parts) else None


def online(events, held=(), anonymous=False):
    """Sessions one event at a time: the latest live one of the visitor that began before, else (anonymous) that of the anonymous id."""
    done = [dict(s) for s in held]
    for e in sorted(events, key=lambda e: (e["inserted_at"], e["id"])) if anonymous else sorted(events, key=lambda e: (e["visitor_id"], e["inserted_at"], e["id"])):
        at, acq, kind, page = e["inserted_at"], acquired(e), e["event_type"], e.get("path") or None
        owner, anon = e.get("visitor_id"), e.get("anonymous_id")
        live = [s for s in done if s["visitor_id"] == (owner or f"a:{anon}") and s["last"] <= at <= s["last"] + GAP]
        if not live and anonymous and anon:
            live = [s for s in done if s["anonymous"] == anon and s["last"] <= at <= s["last"] + GAP]
        s = max(live, key=lambda s: s["last"], default=None)
        if kind == "engagement" and anonymous:
            if s:
                s["duration"] += min((at - s["last"]) // timedelta(seconds=1), 1800)
                s["last"] = at
            continue
        if s is None or (acq and s["acq"] and acq != s["acq"]):
            s = {"visitor_id": owner or f"a:{anon}", "anonymous": anon, "start": at, "last": at, "entry": page, "exit": page, "views": 0, "events": 0, "duration": 0, "bounce": True, "engaged": False, "acq": acq}
            done.append(s)
        else:
            s["duration"] += min((at - s["last"]) // timedelta(seconds=1), 1800)
            if kind == "pageview" and page:
                s["exit"] = page
        s["last"], s["acq"] = at, s["acq"] or acq
        s["visitor_id"], s["anonymous"] = owner or s["visitor_id"], anon or s["anonymous"]
        s["views"] += kind == "pageview"
        s["events"] += 1
        s["bounce"] &= not (kind in INTERACTIVE_TYPES or (kind == "pageview" and s["views"] >= 2))
        s["engaged"] |= s["views"] >= 2 or kind in CONVERSION_TYPES
    return done


def shown(s):
    acq = s["acq"] or (None,) * 4
    return (s["visitor_id"], s["start"], s["last"], s["entry"], s["exit"], s["views"], s["events"], s["duration"], s["bounce"], s["engaged"], acq[0], acq[1], acq[3])


def found_rows(df):
    utc = lambda v: v.replace(tzinfo=UTC) if isinstance(v, datetime) and v.tzinfo is None else v
    return sorted((tuple(utc(r[c]) for c in SESSION_FIELDS) for r in df.collect()), key=repr)


def padded(events):
    return [e | {"id": e["id"].zfill(6)} for e in events if e["event_type"] != "engagement"]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_backfill_goes_on_with_sessions_that_exist(make, seed):
    given = padded(random_events(seed, 12))
    rng = random.Random(seed)
    early = [e for e in given if rng.random() < 0.5]
    late = [e for e in given if e not in early]
    held = sessions.sessions(make("events", early), online=False)
    stamped, changed = sessions.backfill(make("events", late), held)
    want = sorted((shown(s) for s in online(late, online(early))), key=repr)
    after = sessions.replaced(held, changed)
    assert found_rows(after) == want
    # Each event has the id of a session, and each session that took events counts them.
    assert stamped.count() == len(late) and stamped.join(after.withColumnRenamed("id", "session_id"), "session_id", "left_semi").count() == len(late)
    again, none = sessions.backfill(stamped, after)
    assert again.count() == 0 and none.count() == 0


def test_backfill_by_parts_equals_one_pass(make):
    given = padded(random_events(11, 10))
    cut = sorted(e["inserted_at"] for e in given)[len(given) // 2]
    held = sessions.sessions(make("events", [e for e in given if e["inserted_at"] < cut]), online=False)
    _, changed = sessions.backfill(make("events", [e for e in given if e["inserted_at"] >= cut]), held)
    whole = sessions.sessions(make("events", given), online=False)
    after = sessions.replaced(held, changed)
    assert found_rows(after) == found_rows(whole)
    assert sorted(r.id for r in after.collect()) == sorted(r.id for r in whole.collect())


def test_backfill_takes_the_live_session_of_the_table(make):
    held = make("sessions", [{"id": "s1", "visitor_id": "x", "started_at": 0, "last_event_at": 10, "pageviews": 1, "events": 1, "duration_seconds": 0, "is_bounce": True, "is_engaged": False, "exit_page": "/a"}, {"id": "s2", "visitor_id": "y", "started_at": 0, "last_event_at": 10}])
    e = make("events", [event(1, "x", at=15, path="/b", source_platform="google"), event(2, "y", at=41), event(3, "x", at=5)])
    stamped, changed = sessions.backfill(e, held)
    ids = dict(rows(stamped, "id", "session_id"))
    assert ids["1"] == "s1" and ids["2"] != "s2" and ids["3"] != "s1"  # five minutes after, thirty-one minutes after, before the last event
    one = {r.id: r for r in changed.collect()}["s1"]
    assert (one.pageviews, one.events, one.duration_seconds, one.exit_page, one.is_bounce, one.is_engaged, one.source_platform) == (2, 2, 300, "/b", False, True, "google")
    assert set(changed.columns) == set(held.columns) and changed.count() == 3


def test_beacons_change_their_session(make):
    held = make("sessions", [{"id": "s1", "visitor_id": "a", "started_at": 0, "last_event_at": 10, "pageviews": 1, "duration_seconds": 600, "engaged_seconds": 3, "is_engaged": False, "is_bounce": True}, {"id": "s2", "visitor_id": "a", "started_at": 11, "last_event_at": 12, "engaged_seconds": 0, "is_engaged": False}])
    beacons = make("events", [event(1, "a", "engagement", at=9, engaged_ms=4999), event(2, "a", "engagement", at=20, engaged_ms=7000), event(3, "a", "engagement", at=45, engaged_ms=3000), event(4, "a", "engagement", at=45, engaged_ms=None)])
    attached = sessions.attach(beacons, held)
    assert sorted(rows(attached, "id", "session_id")) == [("1", "s1"), ("2", "s2"), ("3", "s2"), ("4", "s2")]
    changed = {r.id: r for r in sessions.with_engagement(held, attached).collect()}
    assert (changed["s1"].engaged_seconds, changed["s1"].duration_seconds, changed["s1"].is_engaged) == (7, 600, False)
    assert (changed["s2"].engaged_seconds, changed["s2"].duration_seconds, changed["s2"].is_engaged) == (10, 33 * 60, True)
    assert changed["s2"].last_event_at.minute == 45 and changed["s1"].is_bounce


def with_anonymous(make, given):
    df = make("events", [{k: v for k, v in e.items() if k != "anonymous_id"} for e in given])
    names = df.sparkSession.createDataFrame([(e["id"], e.get("anonymous_id")) for e in given], "id string, anonymous_id string")
    return df.join(names, "id")


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_sessions_by_two_keys_equal_the_fold(make, seed):
    rng, given, at = random.Random(seed), [], T0
    for i in range(160):
        at += timedelta(seconds=rng.choice([1, 40, 300, 900, 1800]) + rng.random())
        who, anon = rng.choice([None, "v1", "v2", "v3", "v4"]), rng.choice([None, "a1", "a2", "a3"])
        if who is None and anon is None:
            who = "v9"
        kind = rng.choice(["pageview", "pageview", "lead", "link_click", "engagement"])
        given.append({"id": f"{i:05}", "visitor_id": who, "anonymous_id": anon, "event_type": kind, "inserted_at": at, "path": f"/{rng.randint(0, 3)}", **({} if kind == "engagement" else {"source_platform": rng.choice([None, None, "google", "bing"])})})
    want = [(s["start"], s["last"], s["events"], s["views"], s["duration"], None if s["visitor_id"].startswith("a:") else s["visitor_id"], s["anonymous"]) for s in online(given, anonymous=True)]
    df = with_anonymous(make, given)
    found = sessions.sessions(df)
    utc = lambda t: t.replace(tzinfo=UTC)
    got = [(utc(r.started_at), utc(r.last_event_at), r.events, r.pageviews, r.duration_seconds, r.visitor_id, r.anonymous_id) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert linked.groups(sessions._with_missing(df).withColumn("__key", F.coalesce("visitor_id", sessions.stand_in()))).select("__group").distinct().count() >= 1


def test_a_known_visitor_goes_on_with_an_anonymous_session(make):
    def made(*given):
        found = sessions.sessions(with_anonymous(make, [event(i, v, at=m) | {"anonymous_id": a} for i, (v, a, m) in enumerate(given)]))
        return sorted(((r.events, r.visitor_id, r.anonymous_id) for r in found.collect()), key=repr)

    assert made((None, "n", 0), ("v", "n", 30), (None, "n", 59)) == [(3, "v", "n")]
    assert made((None, "n", 0), ("v", "n", 31)) == [(1, "v", "n"), (1, None, "n")]
    assert made(("v", "n", 0), ("w", "n", 20), ("v", None, 25)) == [(1, "v", None), (2, "w", "n")]  # the session went to w
    assert made(("v", "n", 0), ("v", None, 25), ("w", "n", 50)) == [(3, "w", "n")]  # the anonymous id lasts as long as the session
    assert made(("v", None, 0), (None, None, 1), (None, None, 2)) == [(1, "v", None), (1, None, None), (1, None, None)]


def test_streamed_sessions_take_late_rows_in_order(spark, make, tmp_path, keyed_state):
    given = random_events(9, 6)
    end = max(e["inserted_at"] for e in given) + timedelta(days=1)
    late = sorted(given, key=lambda e: (e["inserted_at"] + timedelta(minutes=random.Random(e["id"]).randint(0, 19))))
    ordered = [e | {"id": e["id"].zfill(6)} for e in late]
    parts = [ordered[i : i + 40] for i in range(0, len(ordered), 40)] + [[{"id": "z1", "visitor_id": "late", "event_type": "pageview", "inserted_at": end}]]
    for i, part in enumerate(parts):
        make("events", part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if i == 0:
            schema = make("events", part).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    found = run(streams.sessionize(source, watermark="20 minutes"), tmp_path / "ck")
    assert sorted(plain(r) for r in found if r.visitor_id != "late") == sorted(x[:11] for x in fold(given))


def test_months_of_windows_over_edges(spark, make, tmp_path):
    utc = lambda *x: datetime(*x, tzinfo=UTC)
    assert months(TimeWindow(utc(2024, 1, 31, 22), utc(2024, 2, 1, 4))) == ["2024-01", "2024-02"]
    assert months(TimeWindow(utc(2023, 11, 30, 23, 59), utc(2024, 2, 29, 0, 1))) == ["2023-11", "2023-12", "2024-01", "2024-02"]
    edges = [utc(2024, m, 1) + timedelta(hours=h) for m in range(1, 7) for h in (-3, -1, 0, 1, 3)]
    e = make("events", [event(i, "a") | {"inserted_at": t} for i, t in enumerate(edges)])
    zone = spark.conf.get("spark.sql.session.timeZone")
    for name in ("UTC", "America/Los_Angeles", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            tables.write_events(e, str(tmp_path / name), "overwrite")
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        back = tables.read(spark, str(tmp_path / name), "events")
        for start in edges[:-1]:
            window = TimeWindow(start, start + timedelta(hours=5, minutes=1))
            assert scan_events(back, window).count() == sum(window.contains(t) for t in edges), (name, start)


def test_a_batch_that_comes_twice_is_there_once(spark, make, tmp_path):
    sink = Batches(str(tmp_path), "dispatches", DISPATCHES)
    handler = connectors.after_commit(("google",), sink)
    signals = {"signals": F.create_map(F.lit("gclid"), F.lit("g")), "consent": F.lit("consented")}
    batch = lambda *ids: make("events", [event(i, "v", "sale", at=int(i)) for i in ids]).withColumns(signals)
    handler(batch("1", "2", "2"), 0)
    ids = sorted(rows(sink.read(spark), "event_id", "id"))
    handler(batch("1", "2"), 0)
    assert sorted(rows(sink.read(spark), "event_id", "id")) == ids and [x[0] for x in ids] == ["1", "2"]
    handler(batch("2", "3"), 1)  # an event that another batch had
    assert sorted(rows(sink.read(spark), "event_id", "batch")) == [("1", 0), ("2", 0), ("3", 1)]
    # A batch cut off before its commit is not read, and is written anew.
    planned = connectors.plan(batch("4", "5"), ("google",))
    connectors.dispatch_rows(planned, F.current_timestamp()).where("event_id = '4'").write.parquet(f"{tmp_path}/dispatches/query=main/batch=2")
    assert sink.read(spark).count() == 3 and not sink.has(spark, 2)
    handler(batch("4", "5"), 2)
    assert sorted(r.event_id for r in sink.read(spark).collect()) == ["1", "2", "3", "4", "5"]


def test_changes_are_fanned_out_once(spark, make, tmp_path):
    out, ck = str(tmp_path / "data"), str(tmp_path / "ck")
    feed = Batches(str(tmp_path / "feed"), "events", EVENTS)
    rows_of = lambda *x: make("events", [event(i, "a", at=m) | {"workspace_id": w} for i, w, m in x])
    for part in (rows_of((1, "w1", 0), (2, "w2", 1)), rows_of((3, "w1", 60 * 24 * 40), (4, "w1", 2))):  # two appends, the query starts anew after each
        tables.write_events(part, out)
        streams.fan_out(tables.changes(spark, out), feed, ck).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in streams.subscription(spark, feed, "w1").collect()) == ["1", "3", "4"]
    assert [r.id for r in streams.subscription(spark, feed, "w2").collect()] == ["2"]
    first = min(r.batch for r in feed.read(spark).collect())
    assert sorted(r.id for r in streams.subscription(spark, feed, "w1", after=first).collect()) == ["3", "4"]


@pytest.mark.parametrize("values", [[], [5], [0, 0, 0], [1, 2], [7, 1, 3, 9, 2**43], [2**40, 2**40 + 1, 3, 3]])
def test_middle_of_values(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x long").groupBy("x").agg(F.count("*").alias("n"))
    found = selection.middle(df, "x", "n", 44).first()
    assert found == selection.middle(df, "x", "n", 44, rows=df.count()).first() == selection.middle(df, "x", "n", 44, step=5).first()
    assert (found.lower is None) if not values else ((found.lower + found.upper) / 2 == median(values))


def test_middle_of_many(spark):
    df = spark.range(20_001).select((F.xxhash64("id") % 10**9).alias("x")).where("x >= 0")
    counts = df.groupBy("x").agg(F.count("*").alias("n"))
    values = sorted(r.x for r in df.collect())
    found = selection.middle(counts, "x", "n").first()
    assert (found.lower, found.upper) == (values[(len(values) - 1) // 2], values[len(values) // 2])


def test_funnel_forms_agree_on_random_events(make):
    rng = random.Random(3)
    e = [event(i, f"v{rng.randint(0, 20)}", rng.choice(["pageview", "lead", "sale", "share"]), at=rng.randint(0, 900) / 2) for i in range(600)]
    of = lambda *types: Step("event", tuple(StepFilter("event", event_type=t) for t in types), types[0], "any")
    day = TimeWindow(T0, T0 + timedelta(days=1))
    for steps in ((of("pageview"), of("lead"), of("sale")), (of("pageview", "lead"), of("pageview"), of("lead"), of("sale", "share"))):
        made = [sorted(rows(funnels.summary(make("events", e), make("visitors", [visitor(f"v{i}") for i in range(21)]), Funnel("f", steps, 1), day, form=form), "step_index", "visitor_count", "median_time")) for form in funnels.FORMS]
        assert made[0] == made[1] == made[2] and made[0][-1][1] > 0


def test_ranges_of_any_width(spark):
    blocks = [("0.0.0.0", "15.255.255.255", "A"), ("16.0.0.0", "16.0.0.0", "B"), ("64.0.0.0", "127.255.255.255", "C"), ("2000::", "2fff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "D"), ("3000::", "3000::1", "E")]
    ranges = spark.createDataFrame([(a, b, {"country_code": c}) for a, b, c in blocks], "a string, b string, geo map<string,string>")
    ranges = ranges.select(devices.address_key("a").alias("low"), devices.address_key("b").alias("high"), "geo")
    rng = random.Random(1)
    asked = ["0.0.0.0", "15.255.255.255", "16.0.0.0", "16.0.0.1", "63.9.9.9", "64.0.0.0", "127.255.255.255", "128.0.0.1", "2abc::7", "3000::1", "3000::2", "x", None] + [f"{rng.randint(0, 140)}.{rng.randint(0, 255)}.{rng.randint(0, 255)}.1" for _ in range(400)]
    asked += ["9.9.9.9"] * 50

    def want(a):
        if a is None or a == "x":
            return None
        if ":" in a:
            return "D" if a.startswith("2") else "E" if a == "3000::1" else None
        first = int(a.split(".")[0])
        return "A" if first < 16 else "B" if a == "16.0.0.0" else "C" if 64 <= first < 128 else None

    hosts = spark.createDataFrame(list(enumerate(asked)), "id int, ip_address string")
    found = {r.id: r.geo and r.geo["country_code"] for r in tables.enrich_geo(hosts, ranges).collect()}
    assert found == {i: want(a) for i, a in enumerate(asked)}
    assert {r.geo for r in tables.enrich_geo(hosts, ranges.limit(0)).collect()} == {None}


def test_a_signal_of_very_many_visitors(spark, make):
    many = spark.range(20_000).select(F.concat(F.lit("v"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("id"), F.lit("w").alias("workspace_id"), F.timestamp_seconds(20_000 - F.col("id")).alias("first_seen_at"), F.lit("anonymous").alias("status"), F.array(F.lit("hot")).alias("fingerprints"), F.when(F.col("id") < 2, F.lit("m")).alias("person_email"))
    asked = spark.createDataFrame([("1", "w", "hot", None), ("2", "w", "cold", None), ("3", "w", None, "m"), ("4", "other", "hot", None)], "request_id string, workspace_id string, fingerprint string, person_email string")
    got = {r.request_id: (r.action, r.visitor_id, r.merged_ids) for r in identity.resolve(asked, many).collect()}
    assert got == {"1": ("update", "v019999", []), "2": ("create", None, []), "3": ("merge", "v000001", ["v000000"]), "4": ("create", None, [])}


def test_links_without_clicks_have_their_sales(make):
    e = make("events", [event(1, "x", "sale", link_id="l2", amount_cents=500), event(2, "x", "lead", link_id="l1"), event(3, "x", "link_click", link_id="l1", ip_address="1")])
    stats = clicks.link_stats(e.where("event_type = 'link_click'"), e, make("links", [{"id": "l1"}, {"id": "l3"}]))
    assert {r.link_id: tuple(r)[1:] for r in stats.collect()} == {"l1": (1, 1, 1, 0, 0), "l2": (0, 0, 0, 1, 500), "l3": (0, 0, 0, 0, 0)}
