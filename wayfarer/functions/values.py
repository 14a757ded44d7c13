"""Scalar and collection functions: JSON, arrays, maps, guards, identifiers, time, retry rules."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayfarer.functions.urls import MAX_URL, merge_entries
from wayfarer.plans.schemas import MAX_SOURCE_CHARS

MAX_TOUCHPOINTS = 50
MAX_PROPERTIES, MAX_EVENT_NAME, MAX_ID, MAX_ENGAGED_MS = 50, 100, 128, 30 * 60 * 1000
UUID = r"^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$"
#: Letters and digits that can't be taken for one another.
SLUG_CHARS = "".join(c for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" if c not in "0OlI1")
MAX_BACKOFF = 3600


def json_text(json: Column, key: str) -> Column:
    """Text of a key of a JSON object, as it stands (no path syntax in key)."""
    return F.get_json_object(json, f"$['{key}']")


def empty_map(column: Column) -> Column:
    return F.coalesce(F.size(column) <= 0, F.lit(True))


def contains(array: Column, value: object) -> Column:
    return F.coalesce(F.array_contains(array, value), F.lit(False))


def add_unique(array: Column, value: Column) -> Column:
    """array with value in front, unless that is null; each value once."""
    return F.when(value.isNull(), array).otherwise(F.array_distinct(F.concat(F.array(value), F.coalesce(array, F.array().cast("array<string>")))))


def concat_unique(*arrays: Column) -> Column:
    return F.array_distinct(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays]))


def merge_maps(*maps: Column) -> Column:
    """One map; of equal keys the last map's value stays."""
    empty = F.create_map().cast("map<string,string>")
    return merge_entries(F.concat(*[F.map_entries(F.coalesce(m, empty)) for m in maps]))


def last_touchpoints(path: Column, most: int = MAX_TOUCHPOINTS) -> Column:
    return F.slice(path, F.greatest(F.size(path) - most + 1, F.lit(1)), most)


def append_touchpoint(path: Column, touchpoint: Column) -> Column:
    return F.when(touchpoint.isNull(), path).otherwise(last_touchpoints(F.concat(path, F.array(touchpoint))))


def merge_touchpoints(*paths: Column) -> Column:
    """Touchpoints (maps with a timestamp) of all paths by time, unreadable times last, each once, the last fifty."""
    entry = lambda x, i: F.struct(F.try_to_timestamp(x["timestamp"]).isNull().alias("no"), F.try_to_timestamp(x["timestamp"]).alias("at"), i.alias("i"), F.to_json(x).alias("j"), x.alias("x"))
    timed = F.transform(F.concat(*paths), entry)
    keys = F.array_sort(F.transform(timed, lambda e: F.struct(e["no"], e["at"], e["i"], e["j"])))
    whole = F.concat(*paths)
    first = F.filter(keys, lambda k, n: ~F.exists(F.slice(keys, 1, n), lambda y: y["j"] == k["j"]))
    return last_touchpoints(F.transform(first, lambda k: F.element_at(whole, k["i"] + 1)))


def sanitized_properties(properties: Column, most: int = MAX_PROPERTIES) -> Column:
    """At most fifty properties with values, in order of their names."""
    held = F.array_sort(F.map_entries(F.map_filter(properties, lambda k, v: v.isNotNull())))
    return F.map_from_entries(F.slice(held, 1, most))


def url_guard(url: Column) -> Column:
    return F.when((F.length(url) <= MAX_URL) & (url != ""), url)


def id_guard(value: Column, most: int = MAX_ID) -> Column:
    return F.when((F.octet_length(value) <= most) & (value != ""), value)


def event_name_guard(name: Column) -> Column:
    return id_guard(name, MAX_EVENT_NAME)


def engaged_ms_guard(ms: Column) -> Column:
    return F.when(ms.between(0, MAX_ENGAGED_MS), ms)


def scroll_guard(depth: Column) -> Column:
    return F.when(depth.between(0, 100), depth)


def source_text(value: Column) -> Column:
    return F.substring(value, 1, MAX_SOURCE_CHARS)


def uuid_or_null(value: Column) -> Column:
    """A UUID in lower case with dashes, or null."""
    bare = F.lower(F.replace(value, F.lit("-"), F.lit("")))
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(value.rlike(UUID), dashed)


def iso_utc(at: Column) -> Column:
    """ISO 8601 text of a UTC timestamp with microseconds."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def connector_event_id(event_id: Column, inserted_at: Column, connector: Column) -> Column:
    """The id under which a connector gets an event: the same for every try."""
    digest = F.sha2(F.concat_ws(":", event_id.cast("string"), iso_utc(inserted_at), connector), 256)
    return F.concat(connector, F.lit("_"), F.substring(digest, 1, 32))


def uuid_v7(at: Column, seed: Column) -> Column:
    """A time-ordered UUID: 48 bits of milliseconds, the rest from a hash of seed."""
    ms = F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0")
    rest = F.sha2(seed.cast("string"), 256)
    variant = F.element_at(F.array(*[F.lit(x) for x in "89ab"]), F.pmod(F.conv(F.substring(rest, 4, 1), 16, 10).cast("int"), F.lit(4)) + 1)
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(rest, 1, 3)), F.concat(variant, F.substring(rest, 5, 3)), F.substring(rest, 8, 12))


def new_slug(length: int = 7, rng: random.Random | None = None) -> str:
    rng = rng or random.SystemRandom()
    return "".join(rng.choice(SLUG_CHARS) for _ in range(length))


def valid_slug(key: object) -> bool:
    return isinstance(key, str) and re.fullmatch(r"[a-zA-Z0-9_-]{1,255}", key) is not None


def hop_seconds(before: Column, at: Column, most: int = 1800) -> Column:
    """Whole seconds between two timestamps, from 0 to most; 0 without the first."""
    seconds = F.floor((F.unix_micros(at) - F.unix_micros(before)) / 1_000_000)
    return F.coalesce(F.least(F.greatest(seconds, F.lit(0)), F.lit(most)), F.lit(0)).cast("int")


def elapsed_seconds(before: Column, at: Column) -> Column:
    return (F.unix_micros(at) - F.unix_micros(before)) / 1e6


def backoff_seconds(attempt: Column, base: int = 5, jitter: Column | int = 0, most: int = MAX_BACKOFF) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt - 1) + jitter, F.lit(float(most))).cast("long")


def error_class(status: Column) -> Column:
    """What a response status means for the next try."""
    return F.when(status == 429, "rate_limited").when(status.isin(401, 403), "credential").when((status >= 400) & (status < 500), "permanent").otherwise("transient")
