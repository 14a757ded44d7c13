"""User agents and addresses: device fields, labels, network numbers.

Devices come from a small rule set; a full agent database would give finer values.
"""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOT = r"(?i)([a-z0-9.\- ]*(?:bot|crawler|spider|slurp)\b)|\b(facebookexternalhit|curl|wget|python-requests|headlesschrome)\b"
UNKNOWN_TYPE = "unknown"
#: First match decides.
BROWSERS = (("Edge", r"Edg(?:e|A|iOS)?/([\d.]+)"), ("Opera", r"(?:OPR|Opera)/([\d.]+)"), ("Samsung Browser", r"SamsungBrowser/([\d.]+)"), ("Firefox", r"(?:Firefox|FxiOS)/([\d.]+)"), ("Chrome Mobile iOS", r"CriOS/([\d.]+)"), ("Chrome", r"Chrome/([\d.]+)"), ("Safari", r"Version/([\d.]+).*Safari"), ("Internet Explorer", r"(?:MSIE |rv:)([\d.]+)"))
SYSTEMS = (("Windows", r"Windows NT ([\d.]+)"), ("iOS", r"(?:iPhone OS|CPU OS) ([\d_]+)"), ("Android", r"Android ([\d.]+)"), ("Mac", r"Mac OS X ([\d_.]+)"), ("Chrome OS", r"CrOS \S+ ([\d.]+)"), ("GNU/Linux", r"(Linux)"))
#: Labels of device types.
TYPE_LABELS = {"desktop": "Desktop", "smartphone": "Mobile", "phablet": "Mobile", "tablet": "Tablet", "tv": "TV", "console": "Console", "car browser": "Car", "portable media player": "Media Player", "wearable": "Wearable", "bot": "Bot"}


def _first(agent: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    name = version = F.lit(None).cast("string")
    for label, pattern in reversed(rules):
        found = agent.rlike(pattern)
        name = F.when(found, label).otherwise(name)
        version = F.when(found, F.regexp_extract(agent, pattern, 1)).otherwise(version)
    clean = F.replace(version, F.lit("_"), F.lit("."))
    return name, F.when(clean.rlike(r"^\d"), clean)


def parse(user_agent: Column) -> Column:
    """Struct of type, brand, model, os, os_version, browser, browser_version and name (of bots); nulls where unknown."""
    agent = F.nullif(user_agent, F.lit(""))
    is_bot = F.coalesce(agent.rlike(BOT), F.lit(False))
    browser, browser_version = _first(agent, BROWSERS)
    system, system_version = _first(agent, SYSTEMS)
    tablet = agent.rlike("iPad|Tablet|PlayBook|Silk") | (agent.contains("Android") & ~agent.contains("Mobile"))
    kind = F.when(agent.rlike("(?i)smart-?tv|appletv|googletv|hbbtv"), "tv").when(agent.rlike("(?i)playstation|xbox|nintendo"), "console").when(tablet, "tablet").when(agent.rlike("Mobile|iPhone|Android"), "smartphone").when(system.isNotNull(), "desktop")
    brand = F.when(agent.rlike("iPhone|iPad|Macintosh"), "Apple").when(agent.rlike("SM-|Samsung"), "Samsung").when(agent.rlike("Pixel"), "Google")
    model = F.when(agent.contains("iPhone"), "iPhone").when(agent.contains("iPad"), "iPad").otherwise(F.nullif(F.regexp_extract(agent, r"\b(SM-[A-Z0-9]+|Pixel[ \w]*?)(?: Build|[;)])", 1), F.lit("")))
    bot = F.trim(F.regexp_extract(agent, BOT, 0))
    person = lambda c: F.when(~is_bot, c)
    return F.struct(
        F.when(is_bot, "bot").otherwise(kind).alias("type"),
        person(brand).alias("brand"),
        person(model).alias("model"),
        person(system).alias("os"),
        person(system_version).alias("os_version"),
        person(browser).alias("browser"),
        person(browser_version).alias("browser_version"),
        F.when(is_bot, bot).alias("name"),
    )


def event_columns(device: Column) -> dict[str, Column]:
    """Event columns of a parsed agent."""
    return {"device_type": device["type"], "browser": device["browser"], "os": device["os"], "browser_version": device["browser_version"], "os_version": device["os_version"], "device_brand": device["brand"], "device_model": device["model"], "bot_name": device["name"]}


def humanize_type(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPE_LABELS.items() for x in pair])
    first = F.concat(F.upper(F.substring(kind, 1, 1)), F.lower(F.substring(kind, 2, 1 << 30)))
    return F.when(kind.isNull() | (kind == ""), "Unknown").otherwise(F.coalesce(known[kind], first))


def _with_version(name: Column, version: Column) -> Column:
    short = F.regexp_extract(version, r"^([^.]*(?:\.[^.]*)?)", 1)
    return F.when(F.nullif(version, F.lit("")).isNull(), F.nullif(name, F.lit(""))).otherwise(F.concat_ws(" ", F.nullif(name, F.lit("")), F.when(F.nullif(name, F.lit("")).isNotNull(), short)))


def label(device: Column) -> Column:
    """A short text such as "Desktop · Mac 14.2 · Chrome 120.0"."""
    kind = F.when(F.nullif(device["type"], F.lit("")).isNotNull(), humanize_type(device["type"]))
    parts = F.array_compact(F.array(kind, F.nullif(_with_version(device["os"], device["os_version"]), F.lit("")), F.nullif(_with_version(device["browser"], device["browser_version"]), F.lit(""))))
    joined = F.array_join(parts, " · ")
    bot = F.when(device["name"].isNotNull(), F.concat(F.lit("Bot · "), device["name"])).otherwise("Bot")
    return F.when(device["type"] == "bot", bot).when(F.coalesce(joined, F.lit("")) == "", "Unknown").otherwise(joined)


@F.pandas_udf(T.StringType())
def address_key(addresses: pd.Series) -> pd.Series:
    """32 hex digits that order IPv4 (mapped) and IPv6 addresses; null for anything else or over 45 bytes."""

    def key(x: str | None) -> str | None:
        if not x or len(x.encode()) > 45:
            return None
        try:
            found = ipaddress.ip_address(x)
        except ValueError:
            return None
        return f"{int(found) + (0xFFFF << 32 if found.version == 4 else 0):032x}"

    return addresses.map(key)
