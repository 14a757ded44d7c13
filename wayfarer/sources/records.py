"""Links and partners: what is wrong with new rows, and which are taken. Funnel definitions; events by kind."""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions.urls import valid_http_url
from wayfarer.plans.filters import Funnel
from wayfarer.plans.schemas import DEFAULT_WORKSPACE, EVENT_TYPES, FUNNELS

KEY = r"^[a-zA-Z0-9_-]{1,255}$"
#: Fixed values.
LINK_TYPES = ("short", "referral", "campaign")
PARTNER_STATUSES = ("active", "disabled", "archived")


def _missing(*columns: str) -> Column:
    found = F.lit(None).cast("string")
    for c in reversed(columns):
        found = F.when(F.nullif(F.col(c), F.lit("")).isNull(), f"{c} is missing").otherwise(found)
    return found


def _taken(rows: DataFrame, held: DataFrame | None, keys: tuple[str, ...]) -> DataFrame:
    """rows with taken: an earlier row or one of held (live ones) has the same keys."""
    first = Window.partitionBy(*keys).orderBy("inserted_at", "id")
    rows = rows.withColumn("taken", F.row_number().over(first) > 1)
    if held is None:
        return rows
    seen = held.where(F.col("archived_at").isNull()).select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct().withColumn("__seen", F.lit(True))
    joined = rows.join(seen, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    return joined.withColumn("taken", F.col("taken") | F.coalesce("__seen", F.lit(False))).select(*rows.columns)


def _split(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    marked = rows.withColumn("error", problem).drop("taken")
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())


def create_links(rows: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new links, rejected rows with error). Country codes become upper case; a key is taken once in a domain."""
    targets = F.map_from_entries(F.transform(F.map_entries("geo_targeting"), lambda x: F.struct(F.upper(x["key"]), x["value"])))
    rows = rows.withColumn("geo_targeting", F.when(F.col("geo_targeting").isNotNull(), targets))
    rows = _taken(rows, held, ("domain", "key"))
    problem = F.coalesce(_missing("workspace_id", "domain", "key", "url"), F.when(~F.col("key").rlike(KEY), "key is malformed"))
    for c in ("url", "ios_url", "android_url"):
        problem = F.coalesce(problem, F.when(F.col(c).isNotNull() & ~valid_http_url(F.col(c)), f"{c} must be a valid HTTP or HTTPS URL"))
    bad_target = F.exists(F.map_values("geo_targeting"), lambda u: ~valid_http_url(u)) | F.array_contains(F.map_keys("geo_targeting"), "")
    referral = F.coalesce(F.col("link_type") == "referral", F.lit(False))
    problem = F.coalesce(
        problem,
        F.when(F.coalesce(bad_target, F.lit(False)), "geo_targeting values must be valid HTTP or HTTPS URLs"),
        F.when(F.col("link_type").isNotNull() & ~F.col("link_type").isin(*LINK_TYPES), "link_type is unknown"),
        F.when(referral & F.col("partner_id").isNull(), "partner_id is required for referral links"),
        F.when(~referral & F.col("partner_id").isNotNull(), "partner_id can only be set on referral links"),
        F.when(F.col("taken"), "key is taken"),
    )
    return _split(rows, problem)


def create_partners(rows: DataFrame, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new partners, rejected rows with error); a key is taken once in a workspace."""
    rows = _taken(rows, held, ("workspace_id", "key"))
    problem = F.coalesce(
        _missing("workspace_id", "key", "name"),
        F.when(~F.col("key").rlike(KEY), "key must contain only letters, numbers, hyphens, and underscores"),
        F.when(F.length("name") > 255, "name is too long"),
        F.when(F.col("status").isNotNull() & ~F.col("status").isin(*PARTNER_STATUSES), "status is unknown"),
        F.when(F.col("taken"), "key is taken"),
    )
    return _split(rows, problem)


def update(rows: DataFrame, changes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows with the given columns of changes (id, columns) where those aren't null."""
    given = changes.select(F.col("id").alias("__id"), *[F.col(c).alias(f"__{c}") for c in columns])
    found = rows.join(given, rows["id"] == given["__id"], "left")
    return found.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).select(*rows.columns)


def funnel_rows(spark: SparkSession, funnels: Iterable[Funnel], now: datetime, workspace: str = DEFAULT_WORKSPACE) -> DataFrame:
    """New rows of the table of funnels; archive and update take them like links."""
    return spark.createDataFrame([(str(uuid.uuid4()), workspace, f.name, f.to_json(), None, now, now) for f in funnels], FUNNELS)


def list_funnels(rows: DataFrame, workspace: str = DEFAULT_WORKSPACE, include_archived: bool = False) -> DataFrame:
    """A workspace's funnels, newest first."""
    found = rows.where(F.col("workspace_id") == workspace)
    found = found if include_archived else found.where(F.col("archived_at").isNull())
    return found.orderBy(F.col("inserted_at").desc(), F.col("id").desc())


def get_funnel(rows: DataFrame, funnel_id: str, workspace: str | None = None) -> Funnel:
    """The funnel of an id, archived ones too; LookupError if there is none (in the workspace)."""
    found = rows.where(F.col("id") == funnel_id)
    found = (found if workspace is None else found.where(F.col("workspace_id") == workspace)).select("definition").head(1)
    if not found:
        raise LookupError(f"no funnel {funnel_id!r}")
    return Funnel.from_json(found[0]["definition"])


def recorded(rows: DataFrame, event_type: str) -> DataFrame:
    """rows as events of one type; clicks that came by a QR code (qr, boolean) get the property qr, other types lose that column.

    Custom events bring event_name. ingest validates, normalizes and deduplicates what comes out.
    """
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type {event_type!r}")
    made = rows.withColumn("event_type", F.lit(event_type))
    if "qr" not in rows.columns:
        return made
    if event_type == "link_click":
        none = F.create_map().cast("map<string,string>")
        held = F.coalesce("properties", none) if "properties" in rows.columns else none
        others = F.map_filter(held, lambda k, v: k != "qr")
        made = made.withColumn("properties", F.when(F.coalesce("qr", F.lit(False)), F.map_concat(others, F.create_map(F.lit("qr"), F.lit("true")))).otherwise(held))
    return made.drop("qr")
