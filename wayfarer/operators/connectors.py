"""Conversion dispatches: signals, planning, payloads, delivery states, reconciliation, replay."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions.values import backoff_seconds, connector_event_id, error_class, json_text
from wayfarer.operators.base import at, newest_first
from wayfarer.plans.schemas import DISPATCHES
from wayfarer.sources.batches import Batches

MAX_SIGNAL, MAX_PAYLOAD, REPLAY_LIMIT = 512, 1_000_000, 1000
#: Signal keys.
SIGNALS = ("fbclid", "gclid", "gbraid", "wbraid", "li_fat_id", "ttclid", "_fbp", "_fbc")
SIGNAL_VALUE = r"^[a-zA-Z0-9._\-]+$"
FAILED = ("failed", "permanently_failed")
DUE = ("pending", "failed", "rate_limited")


class Delivery(Protocol):
    """Sends one payload; returns a status. What a host plugs in to reach a network."""

    def __call__(self, payload: str, credentials: Mapping[str, str]) -> int: ...


@dataclass(frozen=True)
class Connector:
    """A destination of conversions; signals is an "all of any of" list of keys."""

    type: str
    signals: tuple[tuple[str, ...], ...]
    credentials: tuple[str, ...]
    payload: Callable[[Mapping[str, str]], Column]
    event_types: tuple[str, ...] = ("lead", "sale")


def _signal(key: str) -> Column:
    return F.col("signals")[key]


def _struct(**fields: Column | None) -> Column:
    return F.struct(*[c.alias(k) for k, c in fields.items() if c is not None])


def _utc(column: Column, between: str = " ") -> Column:
    """Date and time of day in UTC, whatever the session's time zone."""
    seconds = F.unix_seconds(column)
    rest = F.pmod(seconds, F.lit(86_400))
    clock = F.format_string("%02d:%02d:%02d", F.floor(rest / 3600), F.floor(rest / 60) % 60, rest % 60)
    return F.concat(F.date_from_unix_date(F.floor(seconds / 86_400).cast("int")).cast("string"), F.lit(between), clock)


def _value() -> Column:
    return F.col("amount_cents") / 100


def _currency() -> Column:
    return F.coalesce("currency", F.lit("USD"))


def _with_amount(column: Column) -> Column:
    return F.when(F.col("amount_cents").isNotNull(), column)


def _named(lead: str, sale: str) -> Column:
    kind = F.col("event_type")
    return F.when(kind == "lead", lead).when(kind == "sale", sale).otherwise(kind)


def _meta(credentials: Mapping[str, str]) -> Column:
    user = _struct(fbp=_signal("_fbp"), fbc=_signal("_fbc"), fbclid=_signal("fbclid"))
    event = _struct(event_name=_named("Lead", "Purchase"), event_time=F.unix_seconds("captured_at"), event_id=F.col("connector_event_id"), action_source=F.lit("website"), user_data=user, custom_data=_with_amount(_struct(value=_value(), currency=_currency())))
    return F.to_json(_struct(data=F.array(event)))


def _google(credentials: Mapping[str, str]) -> Column:
    action = f"customers/{credentials.get('customer_id', '')}/conversionActions/{credentials.get('conversion_action_id', '')}"
    conversion = _struct(conversionAction=F.lit(action), conversionDateTime=F.concat(_utc(F.col("captured_at")), F.lit("+00:00")), orderId=F.col("connector_event_id"), gclid=_signal("gclid"), gbraid=_signal("gbraid"), wbraid=_signal("wbraid"), conversionValue=_with_amount(_value()), currencyCode=_with_amount(_currency()))
    return F.to_json(_struct(conversions=F.array(conversion), partialFailure=F.lit(True)))


def _linkedin(credentials: Mapping[str, str]) -> Column:
    user = _struct(userIds=F.array(_struct(idType=F.lit("LINKEDIN_FIRST_PARTY_ADS_TRACKING_UUID"), idValue=_signal("li_fat_id"))))
    amount = _with_amount(_struct(currencyCode=_currency(), amount=F.col("amount_cents").cast("string")))
    conversion = _struct(conversion=F.lit(f"urn:lla:llaPartnerConversion:{credentials.get('conversion_rule_id', '')}"), conversionHappenedAt=F.unix_millis("captured_at"), eventId=F.col("connector_event_id"), user=user, conversionValue=amount)
    return F.to_json(_struct(elements=F.array(conversion)))


def _tiktok(credentials: Mapping[str, str]) -> Column:
    code = F.lit(credentials.get("pixel_code", ""))
    page = _struct(url=F.regexp_extract(F.coalesce("url", F.lit("")), r"^([^?#]*)", 1))
    properties = _with_amount(_struct(value=_value(), currency=_currency(), contents=F.array().cast("array<string>")))
    event = _struct(event=_named("SubmitForm", "CompletePayment"), event_id=F.col("connector_event_id"), event_time=F.unix_seconds("captured_at"), user=_struct(ttclid=_signal("ttclid")), page=page, properties=properties)
    return F.to_json(_struct(pixel_code=code, event_source=F.lit("web"), event_source_id=code, data=F.array(event)))


CONNECTORS = (
    Connector("meta", (("_fbp", "_fbc", "fbclid"),), ("access_token", "pixel_id"), _meta),
    Connector("google", (("gclid", "gbraid", "wbraid"),), ("customer_id", "conversion_action_id", "access_token", "developer_token"), _google),
    Connector("linkedin", (("li_fat_id",),), ("access_token", "conversion_rule_id", "ad_account_id"), _linkedin),
    Connector("tiktok", (("ttclid",),), ("access_token", "pixel_code"), _tiktok),
)


def valid_signals(params: Column) -> Column:
    """The entries of a map that are signals with a well-formed value."""
    return F.map_filter(params, lambda k, v: k.isin(*SIGNALS) & (F.octet_length(v) <= MAX_SIGNAL) & v.rlike(SIGNAL_VALUE))


def has_signals(signals: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    """At least one signal of every group."""
    found = F.lit(True)
    for group in groups:
        found = found & F.coalesce(*[F.nullif(signals[k], F.lit("")) for k in group]).isNotNull()
    return F.coalesce(found, F.lit(False))


def source_context(signals: Column, event: Mapping[str, Column], captured_at: Column) -> Column:
    """JSON that a payload can be made from again; nulls are left out."""
    return F.to_json(F.struct(signals.alias("signals"), *[c.alias(k) for k, c in event.items()], F.concat(_utc(captured_at, "T"), F.lit("."), F.lpad(F.pmod(F.unix_micros(captured_at), F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("Z")).alias("captured_at")))


def plan(events: DataFrame, enabled: Mapping[str, tuple[str, ...]] | tuple[str, ...], connectors: tuple[Connector, ...] = CONNECTORS, switched_on: bool = True, policy: Callable[[str], Column] | None = None) -> DataFrame:
    """A row for each event (with signals, a map, and consent) and connector: connector_event_id and skip_reason, null if it may go.

    enabled names connectors, for all workspaces or by workspace. Without a policy, events lacking consent are skipped; policy(type) is
    a condition that decides instead. Nothing is planned when switched off.
    """
    if not switched_on:
        return events.limit(0).select("id", F.lit("").alias("connector_type"), F.lit("").alias("connector_event_id"), F.lit("").alias("skip_reason"))
    rows = []
    for c in connectors:
        if isinstance(enabled, Mapping):
            on = F.col("workspace_id").isin(*[w for w, types in enabled.items() if c.type in types] or [""])
        else:
            on = F.lit(c.type in enabled)
        reason = F.when(~on, "not_enabled").when(~F.col("event_type").isin(*c.event_types), "unsupported_event_type").when(~has_signals(F.col("signals"), c.signals), "missing_signals")
        reason = reason.when(F.coalesce(F.col("consent") != "consented", F.lit(False)), "no_consent") if policy is None else reason.when(~F.coalesce(policy(c.type), F.lit(False)), "policy_rejected")
        rows.append(F.struct(F.lit(c.type).alias("connector_type"), reason.alias("skip_reason")))
    spread = events.withColumn("__c", F.explode(F.array(*rows)))  # as many rows as there are connectors, one pass
    made = connector_event_id(F.col("id"), F.col("inserted_at"), F.col("__c.connector_type"))
    return spread.select(*events.columns, F.col("__c.connector_type").alias("connector_type"), made.alias("connector_event_id"), F.col("__c.skip_reason").alias("skip_reason"))


def payloads(planned: DataFrame, credentials: Mapping[str, Mapping[str, str]], connectors: tuple[Connector, ...] = CONNECTORS) -> DataFrame:
    """Eligible rows of planned with payload (JSON) and too_large."""
    rows = planned.where(F.col("skip_reason").isNull())
    rows = rows if "captured_at" in rows.columns else rows.withColumn("captured_at", F.col("inserted_at"))
    rows = rows if "currency" in rows.columns else rows.withColumn("currency", F.lit(None).cast("string"))
    made = F.lit(None).cast("string")
    for c in connectors:
        made = F.when(F.col("connector_type") == c.type, c.payload(credentials.get(c.type, {}))).otherwise(made)
    return rows.withColumn("payload", made).withColumn("too_large", F.octet_length("payload") > MAX_PAYLOAD)


def missing_dispatches(events: DataFrame, dispatches: DataFrame, connector: str, since: datetime, event_types: tuple[str, ...] = ("lead", "sale")) -> DataFrame:
    """Events since a time of these types that have no dispatch for connector."""
    rows = events.where((F.col("inserted_at") >= at(since)) & F.col("event_type").isin(*event_types))
    sent = dispatches.where(F.col("connector_type") == connector).select(F.col("event_id").alias("d_id"), *([F.col("event_inserted_at").alias("d_at")] if "event_inserted_at" in dispatches.columns else []))
    on = rows["id"] == sent["d_id"]
    if "d_at" in sent.columns:
        on = on & (rows["inserted_at"] == sent["d_at"])
    return rows.join(sent, on, "left_anti")


def reconcile(events: DataFrame, dispatches: DataFrame, enabled: tuple[str, ...], since: datetime, connectors: tuple[Connector, ...] = CONNECTORS) -> DataFrame:
    """New dispatch rows for events (with signals) that should have one: (event_id, connector_type, connector_event_id, status)."""
    found = None
    for c in connectors:
        if c.type in enabled:
            rows = missing_dispatches(events, dispatches, c.type, since, c.event_types).where(has_signals(F.col("signals"), c.signals))
            rows = rows.select(F.col("id").alias("event_id"), F.col("inserted_at").alias("event_inserted_at"), F.lit(c.type).alias("connector_type"), connector_event_id(F.col("id"), F.col("inserted_at"), F.lit(c.type)).alias("connector_event_id"), F.lit("pending").alias("status"))
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        raise ValueError("no connector is enabled")
    return found


def after_delivery(dispatches: DataFrame, now: Column) -> DataFrame:
    """dispatches after a try that had response_status (null: not reached) and enabled: status, attempts and next_retry_at.

    Jitter is a column, jitter, or 0.
    """
    jitter = F.col("jitter") if "jitter" in dispatches.columns else F.lit(0)
    kind = error_class(F.col("response_status"))
    ok = F.col("response_status").between(200, 299)
    attempts = F.col("attempts") + 1
    enabled = F.col("enabled") if "enabled" in dispatches.columns else F.lit(True)
    status = F.when(~enabled, "skipped_disabled").when(ok, "delivered").when(kind == "permanent", "permanently_failed").when(kind == "credential", "credential_error").when(kind == "rate_limited", "rate_limited").otherwise("failed")
    wait = F.when(status == "failed", backoff_seconds(attempts, 5, jitter)).when(status == "rate_limited", backoff_seconds(attempts, 60, jitter))
    return dispatches.withColumns({"status": status, "attempts": F.when(enabled, attempts).otherwise(F.col("attempts")), "error_type": F.when(enabled & ~F.coalesce(ok, F.lit(False)), kind), "last_attempted_at": now, "next_retry_at": F.when(wait.isNotNull(), F.timestamp_micros(F.unix_micros(now) + wait * 1_000_000))})


def dispatch_rows(planned: DataFrame, now: Column, max_attempts: int = 5) -> DataFrame:
    """Rows of the table of dispatches for what plan lets go: pending, not tried yet. Ids follow from connector_event_id: planned again they are the same."""
    held = planned.columns
    value = lambda c, kind="string": F.col(c).cast(kind) if c in held else F.lit(None).cast(kind)
    fresh = {"id": F.regexp_replace(F.substring(F.sha2("connector_event_id", 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), "event_id": F.col("id").cast("string"), "event_inserted_at": F.col("inserted_at"), "payload_snapshot": value("payload"), "source_context": value("connector_source_context"), "status": F.lit("pending"), "attempts": F.lit(0), "max_attempts": F.lit(max_attempts), "inserted_at": now, "updated_at": now}
    columns = [x.split() for x in DISPATCHES.split(", ")]
    kept = ("workspace_id", "connector_type", "connector_event_id", "visitor_id")
    rows = planned.where(F.col("skip_reason").isNull())
    return rows.select(*[(fresh[c] if c in fresh else value(c) if c in kept else F.lit(None)).cast(kind).alias(c) for c, kind in columns])


def after_commit(enabled: Mapping[str, tuple[str, ...]] | tuple[str, ...], sink: Batches, connectors: tuple[Connector, ...] = CONNECTORS) -> Callable[[DataFrame, int], None]:
    """A handler for streaming.deliver: plans each committed batch's events of types that connectors take, and appends their dispatches to sink.

    A connector_event_id is there once for each connector, whether its event comes again in the same batch, in a batch that is given again, or in another one.
    """
    types = sorted({t for c in connectors for t in c.event_types})

    def each(batch: DataFrame, number: int) -> None:
        planned = plan(batch.where(F.col("event_type").isin(*types)), enabled, connectors)
        sink.append(dispatch_rows(planned, F.current_timestamp()), number, unique=("connector_type", "connector_event_id"), near="event_inserted_at")

    return each


def list_by_event(dispatches: DataFrame, event_id: object) -> DataFrame:
    """An event's dispatches, oldest first."""
    return dispatches.where(F.col("event_id") == event_id).orderBy("inserted_at", "id")


def list_by_workspace(dispatches: DataFrame, workspace: str, connector: str, statuses: tuple[str, ...] | None = None, limit: int = 50) -> DataFrame:
    """A workspace's dispatches of a connector, newest first."""
    found = dispatches.where((F.col("workspace_id") == workspace) & (F.col("connector_type") == connector))
    return newest_first(found if statuses is None else found.where(F.col("status").isin(*statuses)), limit=limit)


def list_pending(dispatches: DataFrame, now: datetime, limit: int = 100) -> DataFrame:
    """What is due: tries left and no later retry time; without one last."""
    due = F.col("status").isin(*DUE) & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= at(now))) & (F.col("attempts") < F.col("max_attempts"))
    return dispatches.where(due).orderBy(F.col("next_retry_at").asc_nulls_last(), "inserted_at", "id").limit(limit)


def replay(dispatches: DataFrame, now: Column, connector: str | None = None, workspace: str | None = None, limit: int = REPLAY_LIMIT) -> DataFrame:
    """New pending rows for failed dispatches, linked to what they replay."""
    rows = dispatches.where(F.col("status").isin(*FAILED))
    rows = rows if connector is None else rows.where(F.col("connector_type") == connector)
    rows = rows if workspace is None else rows.where(F.col("workspace_id") == workspace)
    rows = rows.orderBy(F.col("inserted_at").desc(), F.col("id").desc()).limit(limit)
    fresh = F.concat(F.col("connector_type"), F.lit("_replay_"), F.substring(F.sha2(F.concat_ws(":", F.col("id").cast("string"), now.cast("string")), 256), 1, 32))
    return rows.withColumns({"replayed_from_id": F.col("id"), "replayed_at": now, "connector_event_id": fresh, "status": F.lit("pending"), "attempts": F.lit(0)})


def credential_errors(dispatches: DataFrame, connector: str, workspace: str) -> DataFrame:
    """One row if there is a dispatch with a credential error, none otherwise."""
    hit = (F.col("connector_type") == connector) & (F.col("workspace_id") == workspace) & (F.col("status") == "credential_error")
    return dispatches.where(hit).select(F.lit(True).alias("has_errors")).limit(1)


def context_signals(context: Column) -> Column:
    """The signals of a stored source context."""
    return F.from_json(json_text(context, "signals"), "map<string,string>")
