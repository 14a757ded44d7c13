"""Request parameters, new links and partners."""

import pytest

from wayfarer.plans.requests import BreakdownRequest, SeriesRequest
from wayfarer.sources import records

from .test_analytics import event, rows, visitor

SPAN = {"from": "2026-01-05T00:00:00+00:00", "to": "2026-01-06T00:00:00+00:00"}


def test_breakdown_request(make):
    asked = BreakdownRequest.parse(SPAN | {"dimension": "os", "metrics": "users, events", "filter": "browser:Chrome", "order": "asc"})
    assert asked.metrics == ("users", "events") and asked.limit == 50 and asked.filter_by == ("browser", "Chrome")
    e = make("events", [event(1, "x", os="mac", browser="Chrome"), event(2, "x", os="win", browser="Edge")])
    assert rows(asked.run(e, make("visitors", [visitor("x")]), None), "value", "users") == [("mac", 1)]
    assert BreakdownRequest.parse(SPAN | {"dimension": "country"}).metrics == ("events",)


@pytest.mark.parametrize("bad", [{"dimension": "x"}, {"metrics": "nope"}, {"metrics": ","}, {"filter": "browser"}, {"filter": "x:y"}, {"limit": "201"}, {"to": SPAN["from"]}])
def test_bad_breakdown_requests(bad):
    with pytest.raises(ValueError):
        BreakdownRequest.parse(SPAN | {"dimension": "os"} | bad)


def test_series_request(make):
    asked = SeriesRequest.parse(SPAN | {"metric": "pageviews", "interval": "6h"})
    found = asked.run(make("events", [event(1, "x")]), make("visitors", []), None)
    assert found.columns == ["bucket_start", "bucket_end", "value"] and rows(found, "value") == [(0,), (1,), (0,), (0,)]
    assert SeriesRequest.parse(SPAN | {"metric": "pageviews", "interval": "odd"}).interval == "1h"
    with pytest.raises(ValueError, match="buckets"):
        SeriesRequest.parse({"from": "2026-01-01", "to": "2026-02-01", "metric": "pageviews", "interval": "1m"})


def test_links(make):
    link = lambda i, **x: {"id": i, "domain": "d", "key": f"k{i}", "url": "https://a.b/", "link_type": "short", "inserted_at": int(i), **x}
    held = make("links", [link("90", key="old"), link("91", key="gone", archived_at=1)])
    new = make(
        "links",
        [link("1", geo_targeting={"de": "https://de.b/"}), link("2", url="ftp://x/"), link("3", key="a b"), link("4", key="k1"), link("5", link_type="referral"), link("6", partner_id="p"), link("7", key="old"), link("8", key="gone"), link("9", geo_targeting={"fr": "x"}), link("10", domain=None)],
    )
    good, bad = records.create_links(new, held)
    assert {r.id for r in good.collect()} == {"1", "8"} and good.where("id = '1'").first().geo_targeting == {"DE": "https://de.b/"}
    assert {r.id: r.error for r in bad.collect()} == {
        "2": "url must be a valid HTTP or HTTPS URL",
        "3": "key is malformed",
        "4": "key is taken",
        "5": "partner_id is required for referral links",
        "6": "partner_id can only be set on referral links",
        "7": "key is taken",
        "9": "geo_targeting values must be valid HTTP or HTTPS URLs",
        "10": "domain is missing",
    }
    changed = records.update(good, make("links", [{"id": "1", "url": "https://new/"}]), ("url", "utm_source"))
    assert changed.where("id = '1'").first().url == "https://new/"


def test_partners(make):
    p = lambda i, **x: {"id": i, "key": f"p{i}", "name": "n", "status": "active", "inserted_at": int(i), **x}
    good, bad = records.create_partners(make("partners", [p("1"), p("2", key="p1"), p("3", key="x y"), p("4", name="n" * 256), p("5", status="odd"), p("6", name=None)]))
    assert {r.id for r in good.collect()} == {"1"}
    assert {r.id: r.error for r in bad.collect()} == {"2": "key is taken", "3": "key must contain only letters, numbers, hyphens, and underscores", "4": "name is too long", "5": "status is unknown", "6": "name is missing"}
