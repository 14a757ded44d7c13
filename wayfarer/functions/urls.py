"""URL columns: host, path, grouping keys, query parameters, redirects and share addresses."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlencode

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ports that schemes have when an address names none.
DEFAULT_PORTS = {"ftp": "21", "http": "80", "https": "443", "ldap": "389", "sftp": "22", "tftp": "69", "ws": "80", "wss": "443"}
#: Parameters that a redirect doesn't pass on.
NOT_PASSED = ("ga_id", "via", "ref", "qr", "s", "gclid", "gbraid", "wbraid", "msclkid", "fbclid", "ttclid", "twclid", "li_fat_id", "sccid", "dclid", "epik", "irclickid")
MAX_PASSED, MAX_KEY, MAX_VALUE = 10, 64, 512
MAX_URL = 2083

SCHEME = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?"
AUTHORITY = SCHEME + r"//(?:[^/?#]*@)?(\[[0-9A-Fa-f:.]*\]|[^/?#:@]*)(?::(\d+))?"
PATH = SCHEME + r"(?://[^/?#]*)?([^?#]*)"


def _blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def host(url: Column) -> Column:
    """Host in lower case, with its port unless that is the default of http or https; null if there is none."""
    scheme = F.lower(F.regexp_extract(url, SCHEME, 1))
    name = _blank_to_null(F.lower(F.regexp_extract(url, AUTHORITY, 2)))
    given = _blank_to_null(F.regexp_extract(url, AUTHORITY, 3))
    default = F.lit(None).cast("string")
    for s, p in DEFAULT_PORTS.items():
        default = F.when(scheme == s, p).otherwise(default)
    port = F.coalesce(given.cast("int").cast("string"), default)
    web = scheme.isin("http", "https") & (port == default)
    return F.concat(name, F.when(port.isNull() | web, "").otherwise(F.concat(F.lit(":"), port)))


def path(url: Column) -> Column:
    """Path with single slashes, a leading and no trailing one; "/" if there is none."""
    found = F.regexp_replace(F.regexp_extract(url, PATH, 2), "/+", "/")
    led = F.when(found.startswith("/"), found).otherwise(F.concat(F.lit("/"), found))
    return F.when(F.coalesce(led, F.lit("/")) == "/", "/").otherwise(F.regexp_replace(led, "/$", ""))


def path_for_grouping(url: Column) -> Column:
    """scheme://host/path of an address with scheme and host, else the path."""
    scheme = _blank_to_null(F.lower(F.regexp_extract(url, SCHEME, 1)))
    return F.coalesce(F.concat(scheme, F.lit("://"), host(url), path(url)), path(url))


def normalized_url(url: Column) -> Column:
    """url up to "?", slashes single but after ":", without a trailing one."""
    cut = F.split_part(F.coalesce(url, F.lit("/")), F.lit("?"), F.lit(1))
    return F.coalesce(_blank_to_null(F.regexp_replace(F.regexp_replace(cut, "([^:])/+", "$1/"), "/$", "")), F.lit("/"))


def _part(text: Column, mark: str, n: int = 1) -> Column:
    return F.split_part(text, F.lit(mark), F.lit(n))


def event_host() -> Column:
    """The column host, or what the raw url shows for rows from before that column."""
    return F.coalesce(F.col("host"), F.lower(_part(_part(_part(_part(F.col("url"), "://", 2), "/"), "?"), "#")))


def event_path() -> Column:
    """The column path, or what the raw url shows."""
    rest = F.regexp_replace(F.col("url"), "^https?://[^/]+", "")
    return F.coalesce(F.col("path"), _blank_to_null(_part(_part(rest, "?"), "#")), F.lit("/"))


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: Spark computes an expression anew wherever a function of arrays names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def query_params(url: Column) -> Column:
    """Decoded query parameters as a map; the last of equal names wins."""
    query = _blank_to_null(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1))
    pairs = F.filter(F.split(query, "&"), lambda x: x != "")
    decode = lambda x: F.when(x.contains("%") | x.contains("+"), F.coalesce(F.try_url_decode(x), x)).otherwise(x)
    entry = lambda x, name, i: F.struct(decode(name).alias("k"), i.alias("i"), decode(F.substring(x, F.length(name) + 2, F.length(x))).alias("v"))
    placed = F.sort_array(F.transform(pairs, lambda x, i: _bound(F.substring_index(x, "=", 1), lambda name: entry(x, name, i))))
    # Entries by name, then place: the last of a name is the one before another name.
    last = _bound(placed, lambda held: F.filter(held, lambda x, i: ~F.get(held, i + 1)["k"].eqNullSafe(x["k"])))
    return F.coalesce(F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"], x["v"]))), F.create_map().cast("map<string,string>"))


def valid_http_url(url: Column) -> Column:
    return F.coalesce(url.rlike("^(?i:https?)://[^/?#]+"), F.lit(False))


def destination(user_agent: Column, link_url: Column, ios_url: Column, android_url: Column, geo_targeting: Column | None = None, country: Column | None = None) -> Column:
    """A link's address for a device; the address for its country, if valid, comes before."""
    agent = F.coalesce(user_agent, F.lit(""))
    ios = ios_url.isNotNull() & (agent.contains("iPhone") | agent.contains("iPad"))
    by_device = F.when(ios, ios_url).when(android_url.isNotNull() & agent.contains("Android"), android_url).otherwise(link_url)
    if geo_targeting is None or country is None:
        return by_device
    target = geo_targeting[F.upper(country)]
    return F.when(valid_http_url(target), target).otherwise(by_device)


def redirect_params(existing: Column, link_utms: Column, request: Column, click_id: Column) -> Column:
    """Query parameters of a redirect: the address' own, the link's UTMs, the request's, ga_id; later ones win."""
    allowed = F.map_filter(request, lambda k, v: ~k.isin(*NOT_PASSED) & v.isNotNull() & (F.length(k) <= MAX_KEY) & (F.length(v) <= MAX_VALUE))
    passed = F.slice(F.array_sort(F.map_entries(allowed)), 1, MAX_PASSED)
    layers = [F.map_entries(existing), F.map_entries(F.map_filter(link_utms, lambda k, v: v.isNotNull())), passed, F.array(F.struct(F.lit("ga_id").alias("key"), click_id.alias("value")))]
    return merge_entries(F.concat(*layers))


def merge_entries(entries: Column) -> Column:
    """A map of (key, value) entries, the last of equal keys."""
    last = F.filter(entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def redirect_url(base: Column, params: Column) -> Column:
    """base with params (sorted by name) for a query."""
    pairs = F.transform(F.array_sort(F.map_entries(params)), lambda x: F.concat(F.url_encode(x["key"]), F.lit("="), F.url_encode(x["value"])))
    bare = F.regexp_extract(base, r"^([^?#]*)", 1)
    return F.concat(bare, F.lit("?"), F.array_join(pairs, "&"), F.regexp_extract(base, r"(#.*)?$", 1))


def share_urls(link: str, text: str | None = None, via: str | None = None, hashtags: str | None = None, title: str | None = None, subject: str | None = None, body: str | None = None) -> dict[str, str]:
    """Addresses that share a short link on each network."""

    def address(base: str, **params: str | None) -> str:
        return f"{base}?{urlencode({k: v for k, v in params.items() if v is not None})}"

    return {
        "twitter": address("https://twitter.com/intent/tweet", url=link, text=text, via=via, hashtags=hashtags),
        "facebook": address("https://www.facebook.com/sharer/sharer.php", u=link),
        "linkedin": address("https://www.linkedin.com/sharing/share-offsite/", url=link),
        "whatsapp": address("https://api.whatsapp.com/send", text=f"{text} {link}" if text else link),
        "telegram": address("https://t.me/share/url", url=link, text=text),
        "reddit": address("https://reddit.com/submit", url=link, title=title or text),
        "email": address("mailto:", subject=subject or text or "Check this out", body=body or link),
        "copy": link,
    }
