"""Audience, headline numbers, conversions, time series and funnels on hand-made tables."""

from datetime import UTC, datetime, timedelta

import pytest

from wayfarer.operators import audience, events, funnels, kpis, timeseries
from wayfarer.plans.filters import Funnel, SourceFilter, Step, StepFilter, escape_like
from wayfarer.plans.windows import TimeWindow, bucket_interval

from .conftest import T0

DAY = TimeWindow(T0 - timedelta(hours=9), T0 + timedelta(hours=15))


def event(i, visitor, kind="pageview", at=0, **more):
    return {"id": str(i), "visitor_id": visitor, "event_type": kind, "inserted_at": at, **more}


def visitor(i, **more):
    return {"id": i, "first_seen_at": 0, "last_seen_at": 0, "status": "anonymous", **more}


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_breakdown_counts_values_and_missing_ones(make):
    e = make("events", [event(1, "x", device_type="desktop"), event(2, "x", device_type="desktop"), event(3, "y", device_type="mobile"), event(4, "y"), event(5, "gone", device_type="desktop"), event(6, "x", at=24 * 60, device_type="desktop")])
    v = make("visitors", [visitor("x"), visitor("y")])
    found = audience.breakdown(e, v, None, "device_type", ["events"], DAY)
    assert rows(found, "value", "events") == [("desktop", 2), ("(not set)", 1), ("mobile", 1)]


def test_users_do_not_add_up_and_merged_ones_are_one(make):
    e = make("events", [event(1, "x", device_type="desktop"), event(2, "x", device_type="mobile"), event(3, "y", device_type="desktop"), event(4, "z", device_type="mobile")])
    v = make("visitors", [visitor("x"), visitor("y"), visitor("z", merged_into_id="x", status="merged")])
    found = audience.breakdown(e, v, None, "device_type", ["users"], DAY)
    assert rows(found, "value", "users") == [("desktop", 2), ("mobile", 1)]


def test_country(make):
    e = make("events", [event(1, "a"), event(2, "a"), event(3, "b"), event(4, "c")])
    v = make("visitors", [visitor("a", geo={"country_code": "US"}), visitor("b", geo={"country_code": "FR"}), visitor("c", geo={})])
    found = audience.breakdown(e, v, None, "country", ["events", "users"], DAY)
    assert rows(found, "value", "events", "users") == [("US", 2, 1), ("(not set)", 1, 1), ("FR", 1, 1)]
    with pytest.raises(ValueError, match="country"):
        audience.breakdown(e, v, None, "country", ["sessions"], DAY)


SESSIONS = [
    {"id": "1", "visitor_id": "x", "started_at": 0, "device_type": "desktop", "is_bounce": True, "is_engaged": False, "duration_seconds": 0},
    {"id": "2", "visitor_id": "x", "started_at": 9, "device_type": "desktop", "is_bounce": False, "is_engaged": True, "duration_seconds": 30},
    {"id": "3", "visitor_id": "y", "started_at": 9, "device_type": "tablet", "is_bounce": True, "is_engaged": False, "duration_seconds": 0},
]


def test_both_grains(make):
    e = make("events", [event(1, "x", device_type="mobile")])
    found = audience.breakdown(e, make("visitors", [visitor("x")]), make("sessions", SESSIONS), "device_type", ["sessions", "events", "bounce_rate", "avg_duration", "engaged_rate"], DAY)
    assert rows(found, "value", "sessions", "events", "bounce_rate", "avg_duration", "engaged_rate") == [("desktop", 2, 0, 0.5, 15.0, 0.5), ("tablet", 1, 0, 1.0, 0.0, 0.0), ("mobile", None, 1, None, None, None)]


@pytest.mark.parametrize(("dimension", "metrics", "more"), [("nope", ["events"], {}), ("os", [], {}), ("os", ["nope"], {}), ("os", ["events"], {"order_by": ("users", "asc")}), ("os", ["events"], {"filter_by": ("nope", "x")})])
def test_bad_requests_raise(make, dimension, metrics, more):
    with pytest.raises(ValueError):
        audience.breakdown(make("events", []), make("visitors", []), None, dimension, metrics, DAY, **more)


def test_kpis(make):
    e = make("events", [event(1, "n"), event(2, "n"), event(3, "o"), event(4, "o", "sale", amount_cents=5000), event(5, "o", "lead", amount_cents=7)])
    v = make("visitors", [visitor("n", identified_at=1), visitor("o", first_seen_at=-5000)])
    found = kpis.kpis(e, v, make("sessions", SESSIONS[:2]), DAY).first().asDict()
    assert found == {"visitors": 2, "new_visitors": 1, "pageviews": 3, "revenue": 5000, "identification_rate": 0.5, "sessions": 2, "bounce_rate": 0.5, "avg_duration": 15.0, "engaged_rate": 0.5}
    empty = kpis.kpis(e, v, make("sessions", []), TimeWindow(T0 + timedelta(days=9), T0 + timedelta(days=10))).first().asDict()
    assert set(empty.values()) == {0}


def test_counters_keep_events_without_visitor(make):
    e = make("events", [event(1, "gone"), event(2, "gone", "sale", amount_cents=3)])
    assert kpis.pageviews(e, DAY).first()[0] == 1 and kpis.revenue(e, DAY).first()[0] == 3


def test_conversions(make):
    e = make("events", [event(1, "b", "sale", device_type="desktop", amount_cents=3000), event(2, "b", "sale", device_type="desktop", amount_cents=1000), event(3, "c", "sale", device_type="mobile", amount_cents=2000), event(4, "c", device_type="mobile")])
    found = kpis.conversion_breakdown(e, make("visitors", [visitor("b"), visitor("c")]), "device_type", DAY)
    assert sorted(rows(found, "value", "sales", "visitors", "revenue_cents", "percentage", "conversion_rate")) == [("desktop", 2, 1, 4000, 66.67, 2.0), ("mobile", 1, 1, 2000, 33.33, 1.0)]
    for bad in ("channel", "nope"):
        with pytest.raises(ValueError):
            kpis.conversion_breakdown(e, e, bad, DAY)


def test_page_tallies(make):
    s = make("sessions", [{"id": str(i), "started_at": 0, "entry_page": p} for i, p in enumerate(["/a", "/a", "/b", None])])
    assert sorted(rows(kpis.page_tallies(s, "entry_page", DAY), "page", "sessions")) == [("/a", 2), ("/b", 1)]
    assert set(kpis.session_metrics(s, DAY)) == {"headline", "entry_pages", "exit_pages"}


def test_series_is_zero_filled(make):
    e = make("events", [event(1, "x", at=15), event(2, "x", at=45)])
    window = TimeWindow(T0, T0 + timedelta(hours=2))
    found = timeseries.timeseries(e, make("visitors", [visitor("x")]), None, "pageviews", window, interval="1h")
    assert rows(found, "value") == [(2,), (0,)]
    assert found.first().interval == "1h"


def test_search_term_is_literal(make):
    e = make("events", [event(1, "x", source_campaign="50%off"), event(2, "x", source_campaign="50-summer-off")])
    found = timeseries.timeseries(e, make("visitors", []), None, "pageviews", DAY, interval="1d", filters=[("source_campaign", "ilike", "50%OFF")])
    assert rows(found, "value") == [(1,)]
    assert escape_like(r"a%b_c\d") == r"a\%b\_c\\d"


def test_spring_gap_has_an_empty_bucket(make):
    at = lambda h, m=0: datetime(2026, 3, 8, h, m, tzinfo=UTC)
    e = make("events", [event(1, "x", inserted=1) | {"inserted_at": at(7, 30)}, event(2, "x") | {"inserted_at": at(8, 30)}])
    found = timeseries.timeseries(e, make("visitors", []), None, "pageviews", TimeWindow(at(7), at(9)), timezone="America/Chicago", interval="1h")
    got = [(r.bucket_start.hour, r.bucket_end.hour, r.value) for r in found.collect()]
    assert got == [(7, 8, 1), (8, 8, 0), (8, 9, 1)]


def test_autumn_hour_is_the_second(spark):
    from pyspark.sql import functions as F

    local = F.lit("2026-11-01 01:00:00").cast("timestamp_ntz")
    assert spark.range(1).select(timeseries.to_utc(local, "America/Chicago")).first()[0].hour == 7


@pytest.mark.parametrize(("minutes", "label"), [(60, "1m"), (61, "5m"), (24 * 60, "1h"), (25 * 60, "30m"), (6 * 365 * 24 * 60, "1mo"), (0.5, "1m")])
def test_intervals(minutes, label):
    assert bucket_interval(TimeWindow(T0, T0 + timedelta(minutes=minutes))) == label


def test_windows():
    w = TimeWindow.trailing(T0, 7)
    assert w.contains(w.start_at) and not w.contains(w.end_at) and w.previous().end_at == w.start_at
    with pytest.raises(ValueError):
        TimeWindow(T0, T0)


def url(value, match="equals", **more):
    return StepFilter("url", match=match, value=value, **more)


SALE = Step("event", (StepFilter("event", event_type="sale"),), "buy")


def total(make, steps, e, v=("x", "y"), days=30, **more):
    table = make("events", e), make("visitors", [visitor(i) for i in v])
    funnel = Funnel("f", steps, days, **more)
    windows, fold, joins = (sorted(rows(funnels.summary(*table, funnel, DAY, form=form), "step_index", "visitor_count", "median_time")) for form in ("windows", "fold", "joins"))
    assert windows == fold == joins
    return [c for _, c, _ in windows]


def test_funnel_of_a_page_and_a_sale(make):
    e = [event(1, "x", path="/pricing", url="https://a.b/pricing?utm=x"), event(2, "x", "sale", at=5)]
    assert total(make, (Step("url", (url("/pricing"),), "page"), SALE), e) == [1, 1]
    e[0]["path"] = None
    assert total(make, (Step("url", (url("/pricing"),), "page"), SALE), e) == [1, 1]


def test_any_and_all(make):
    e = [event(1, "x", path="/plans"), event(2, "y", path="/buy"), event(3, "y", "sale", at=3)]
    any_of = Step("url", (url("/pricing"), url("/plans"), url("/buy")), "page", "any")
    assert total(make, (any_of, SALE), e) == [2, 1]
    e = [event(1, "x", path="/pricing"), event(2, "y", path="/prices")]
    assert total(make, (Step("url", (url("/pricing"), url("/pric", "starts_with")), "page", "all"), SALE), e) == [1, 0]


def test_steps_in_order_within_days_of_the_first(make):
    e = [event(1, "x", at=0), event(2, "x", "sale", at=0), event(3, "y", at=0), event(4, "y", "sale", at=700)]
    assert total(make, (Step("event", (StepFilter("event", event_type="pageview"),), "view"), SALE), e) == [2, 1]
    e = [event(1, "x", at=-500), event(2, "x", at=100), event(3, "x", "sale", at=101)]
    assert total(make, (Step("event", (StepFilter("event", event_type="pageview"),), "view"), SALE), e, days=1) == [1, 1]


def test_cohort_properties_and_hosts(make):
    e = [event(1, "x", source_platform="google", properties={"k": "1"}, host="a.b"), event(2, "y", properties={"k": "1"}, host="a.b"), event(3, "x", "sale", at=1), event(4, "y", "sale", at=1)]
    step = Step("property", (StepFilter("property", key="k", op="eq", value="1"),), "k")
    assert total(make, (step, SALE), e, cohort=SourceFilter("google")) == [1, 1]
    assert total(make, (Step("url", (url("a.b", scope="host"),), "h"), SALE), e) == [2, 2]
    wild = Step("url", (url("/p_", "starts_with"), StepFilter("url", match="in", values=("/x",)), url("^/r[0-9]$", "regex")), "w", "any")
    assert total(make, (wild, SALE), [event(1, "x", path="/pq1"), event(2, "y", path="/r7")]) == [2, 0]


def test_analysis(make):
    e = [event(i, v, k, at=a) for i, (v, k, a) in enumerate([("x", "pageview", 0), ("y", "pageview", 0), ("x", "sale", 4), ("y", "lead", 2)])]
    funnel = Funnel("f", (Step("event", (StepFilter("event", event_type="pageview"),), "view"), SALE))
    found = funnels.analyze(make("events", e), make("visitors", [visitor("x"), visitor("y")]), funnel, DAY)
    assert rows(found, "label", "count", "conversion_to_step_1", "conversion_to_prev", "drop_off", "overall_conversion", "median_time_seconds") == [("view", 2, 1.0, 1.0, 0, 0.5, 240.0), ("buy", 1, 0.5, 0.5, 1, 0.5, 240.0)]
    nobody = funnels.analyze(make("events", []), make("visitors", []), funnel, DAY).first()
    assert nobody.overall_conversion is None and nobody.conversion_to_prev == 0.0


@pytest.mark.parametrize(
    "bad",
    [
        lambda: StepFilter("nope"),
        lambda: StepFilter("event", event_type="nope"),
        lambda: url(""),
        lambda: url("(", "regex"),
        lambda: url("x" * 201, "regex"),
        lambda: url("x", "in", values=("a",)),
        lambda: StepFilter("url", match="in", values=()),
        lambda: StepFilter("url", match="in", values=("a",) * 51),
        lambda: StepFilter("property", key="k", op="in", values=("a",) * 101),
        lambda: StepFilter("property", key="k", op="eq"),
        lambda: StepFilter("source"),
        lambda: Step("event", (), "x"),
        lambda: Step("event", (url("/"),), "x"),
        lambda: Funnel("f", (SALE,)),
        lambda: Funnel("f", (SALE,) * 9),
        lambda: Funnel("f", (SALE, SALE), 91),
    ],
)
def test_bad_funnels_raise(bad):
    with pytest.raises(ValueError):
        bad()


def test_event_lists(make):
    e = make("events", [event(i, "xy"[i % 2], at=i, url=f"https://a.b//p/{i % 3}/?q={i}", event_name=f"n_{i}") for i in range(30)])
    window = TimeWindow(T0, T0 + timedelta(minutes=10))
    assert rows(events.list_events(e, T0, window, limit=3, offset=1), "id") == [("9",), ("8",), ("7",)]  # the end is inside
    assert events.count_events(e, T0, window, url=("in", ["https://a.b/p/0"])).first()[0] == 4
    assert events.count_events(e, T0, window, visitor_id="x", search="N_1").first()[0] == 1
    assert events.count_events(e, T0, window, event_type=("not_in", ["pageview"]), nonsense=("in", ["x"])).first()[0] == 0
    assert events.get_event(e, "3", uuids=True).count() == 0 and events.get_event(e, "3").count() == 1
    assert events.last_event(e, "x", "pageview").first().id == "28"
    assert [r.value for r in events.filter_options(e, T0 + timedelta(days=1)).collect()] == ["pageview"]
