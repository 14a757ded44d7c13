"""Reading and writing the logical tables; ingest of raw events."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions import devices, traffic, urls
from wayfarer.functions.values import event_name_guard, id_guard, sanitized_properties, source_text, url_guard
from wayfarer.operators.sessions import attach as attach_engagement
from wayfarer.plans import schemas
from wayfarer.plans.schemas import EVENT_TYPES, INGEST_TYPES
from wayfarer.plans.scratch import written

MAX_BATCH = 100
#: Tables in a data folder, and their columns.
LOGICAL = {"events": schemas.EVENTS, "visitors": schemas.VISITORS, "sessions": schemas.SESSIONS, "links": schemas.LINKS, "partners": schemas.PARTNERS, "dispatches": schemas.DISPATCHES, "settings": schemas.SETTINGS, "funnels": schemas.FUNNELS}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A logical table (Parquet) with its declared columns: nothing is inferred; events come with event_month."""
    ddl = LOGICAL[name] + (", event_month string" if name == "events" else "")
    return spark.read.schema(ddl).parquet(f"{path}/{name}")


def changes(spark: SparkSession, path: str, files_a_batch: int | None = None) -> DataFrame:
    """The events table as a stream: what write_events has appended and will append, folder by folder, with the declared columns."""
    reader = spark.readStream.schema(f"{LOGICAL['events']}, event_month string")
    reader = reader if files_a_batch is None else reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.parquet(f"{path}/events")


def event_month(at: Column) -> Column:
    """The month of a time in UTC, as base.months names it."""
    return F.substring(F.date_from_unix_date(F.floor(F.unix_micros(at) / 86_400_000_000).cast("int")).cast("string"), 1, 7)


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events, one folder for each month (event_month, in UTC whatever the session's zone), rows in order of workspace and time in each file.

    Statistics of row groups then prune by time. A month's rows are spread over as many tasks as its size needs:
    rebalancing splits large months.
    """
    rows = events.withColumn("event_month", event_month(F.col("inserted_at")))
    rows = rows.hint("rebalance", "event_month").sortWithinPartitions("event_month", "workspace_id", "inserted_at")
    rows.write.mode(mode).partitionBy("event_month").parquet(f"{path}/events")


def write(df: DataFrame, path: str, name: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(f"{path}/{name}")


def normalize_events(raw: DataFrame, user_agents: bool = True) -> DataFrame:
    """raw with the columns that are made from others: source fields from a source map, host and path from url, device fields.

    Columns that are there already stay as they are; sources are cut to 255 characters.
    """
    held = set(raw.columns)
    new: dict[str, Column] = {}
    for column, key in (("source_platform", "platform"), ("source_medium", "medium"), ("source_campaign", "campaign")):
        of_map = F.col("source")[key] if "source" in held else F.lit(None).cast("string")
        new[column] = source_text(F.coalesce(F.col(column), of_map) if column in held else of_map)
    if "url" in held:
        has = F.nullif(F.col("url"), F.lit("")).isNotNull()
        for column, made in (("host", urls.host), ("path", urls.path)):
            derived = F.when(has, made(F.col("url")))
            new[column] = F.coalesce(F.col(column), derived) if column in held else derived
    out = raw.withColumns(new)
    if user_agents and "user_agent" in held:
        parsed = out.withColumn("__device", devices.parse(F.col("user_agent")))
        fields = {c: (F.coalesce(F.col(c), v) if c in held else v) for c, v in devices.event_columns(F.col("__device")).items()}
        out = parsed.withColumns(fields).drop("__device")
    return out


def backfill_devices(events: DataFrame) -> DataFrame:
    """events whose device_type is missing though they have a user agent, filled; unknown agents get the type unknown."""
    missing = F.col("device_type").isNull() & F.col("user_agent").isNotNull()
    parsed = events.withColumn("__device", devices.parse(F.col("user_agent")))
    fields = {c: F.when(missing, v).otherwise(F.col(c)) for c, v in devices.event_columns(F.col("__device")).items() if c in events.columns}
    fields["device_type"] = F.when(missing, F.coalesce(F.col("__device.type"), F.lit(devices.UNKNOWN_TYPE))).otherwise(F.col("device_type"))
    return parsed.withColumns(fields).select(*events.columns)


def classify_visits(raw: DataFrame) -> DataFrame:
    """raw (url, referrer) with the fields of its traffic source.

    Parameters, referring domain and platforms are made once each: a generator over one element keeps the optimizer from copying them into every use.
    """
    once = raw.select("*", F.explode(F.array(F.struct(urls.query_params(F.col("url")).alias("params"), traffic.referer_domain(F.col("referrer")).alias("domain")))).alias("__visit"))
    source = traffic.classify(F.col("__visit.params"), F.col("referrer"), domain=F.col("__visit.domain"))
    return once.withColumn("classified", source).drop("__visit")


def problem(rows: DataFrame, types: Iterable[str] = EVENT_TYPES) -> Column:
    """What is wrong with an event, or null."""
    missing = lambda c: F.col(c).isNull() if c in rows.columns else F.lit(True)
    found = F.when(missing("workspace_id"), "workspace_id is missing").when(missing("visitor_id"), "visitor_id is missing").when(missing("event_type"), "event_type is missing").when(~F.col("event_type").isin(*types), "event_type is unknown")
    for column, guard in (("url", url_guard), ("event_name", event_name_guard), ("fingerprint", id_guard)):
        if column in rows.columns:
            found = found.when(F.nullif(F.col(column), F.lit("")).isNotNull() & guard(F.col(column)).isNull(), f"{column} is too long")
    return found


def validate_events(rows: DataFrame, types: Iterable[str] = INGEST_TYPES) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected rows have error."""
    marked = rows.withColumn("error", problem(rows, tuple(types)))
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())


def ingest(raw: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events to append, rejected rows) of raw events.

    Valid rows are normalized; of rows with one idempotency key (properties) in a workspace the earliest stays, and none
    if history has the key.
    """
    valid, rejected = validate_events(raw)
    rows = normalize_events(valid)
    if "properties" in rows.columns:
        rows = rows.withColumn("properties", sanitized_properties(F.col("properties")))
        rows = drop_repeated(rows, history)
    return rows, rejected


def drop_repeated(rows: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """rows less those whose idempotency key came before; rows without one all stay."""
    key = F.col("properties")["_idempotency_key"]
    marked = rows.withColumn("__key", key)
    first = Window.partitionBy("workspace_id", "__key").orderBy("inserted_at", "id")
    keyed = marked.where(F.col("__key").isNotNull()).withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    if history is not None:
        seen = history.select(F.col("workspace_id"), key.alias("__key")).where(F.col("__key").isNotNull())
        keyed = keyed.join(seen, ["workspace_id", "__key"], "left_anti")
    return marked.where(F.col("__key").isNull()).unionByName(keyed).drop("__key")


def record(raw: DataFrame, event_type: str, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """ingest of rows that are all events of one type: pageview, lead, sale."""
    return ingest(raw.withColumn("event_type", F.lit(event_type)), history)


def record_clicks(raw: DataFrame, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Link clicks, their link in link_id; where the column qr (boolean) is true it becomes a property, and goes itself."""
    rows = raw
    if "qr" in raw.columns:
        none = F.create_map().cast("map<string,string>")
        held = F.coalesce(F.col("properties"), none) if "properties" in raw.columns else none
        others = F.map_filter(held, lambda k, _: k != "qr")
        rows = raw.withColumn("properties", F.when(F.col("qr"), F.map_concat(others, F.create_map(F.lit("qr"), F.lit("true")))).otherwise(held)).drop("qr")
    return record(rows, "link_click", history)


def record_custom(raw: DataFrame, event_name: str | Column, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Custom events of this name."""
    return record(raw.withColumn("event_name", F.lit(event_name) if isinstance(event_name, str) else event_name), "custom", history)


def ingest_batch(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """ingest for one request of MAX_BATCH events at most."""
    if len(raw.head(MAX_BATCH + 1)) > MAX_BATCH:
        raise ValueError(f"a batch has {MAX_BATCH} events at most")
    return ingest(raw)


def resolve_visitors(requests: DataFrame, visitors: DataFrame) -> DataFrame:
    """requests (visitor_id, external_id, signal_visitor_id) with resolved_id, or error: an id comes before an external id, that before signals."""
    known = visitors.select(F.col("workspace_id").alias("k_ws"), F.col("id").alias("k_id"))
    live = visitors.where(F.col("person_external_id").isNotNull() & (F.coalesce(F.col("status"), F.lit("")) != "merged"))
    person = live.groupBy(F.col("workspace_id").alias("p_ws"), F.col("person_external_id").alias("p_external")).agg(F.min("id").alias("p_id"))
    found = requests.join(known, (F.col("workspace_id") == F.col("k_ws")) & (F.col("visitor_id") == F.col("k_id")), "left")
    found = found.join(person, (F.col("workspace_id") == F.col("p_ws")) & (F.col("external_id") == F.col("p_external")), "left")
    named, external = F.col("visitor_id").isNotNull(), F.col("external_id").isNotNull()
    resolved = F.when(named, F.col("k_id")).when(external, F.col("p_id")).otherwise(F.col("signal_visitor_id"))
    error = F.when(resolved.isNull() & (named | external), "404 visitor not found").when(resolved.isNull(), "422 no visitor given")
    return found.withColumns({"resolved_id": resolved, "error": error}).select(*requests.columns, "resolved_id", "error")


def request_events(requests: DataFrame) -> DataFrame:
    """API requests (method, path, status) as events of type api_request."""
    return requests.withColumns({"event_type": F.lit("api_request"), "event_name": F.concat_ws(" ", F.upper("method"), "path"), "properties": F.create_map(F.lit("status"), F.col("status").cast("string"))}).drop("method", "status")


def trusted_fields(rows: DataFrame, columns: tuple[str, ...] = ("partner_id", "referral_link_id", "referral_click_id")) -> DataFrame:
    """rows whose partner fields are blanked unless their key is trusted."""
    return rows.withColumns({c: F.when(F.col("trusted"), F.col(c)) for c in columns if c in rows.columns})


def upsert_settings(settings: DataFrame, changes: DataFrame) -> DataFrame:
    """settings after changes: the newest row of each (workspace_id, key); scalars are wrapped as {"_v": ...}."""
    wrap = F.when(F.col("value").rlike(r"^\s*[\[{]"), F.col("value")).otherwise(F.concat(F.lit('{"_v":'), F.col("value"), F.lit("}")))
    both = settings.unionByName(changes.withColumn("value", wrap))
    newest = F.max_by(F.struct(*settings.columns), F.struct("updated_at", "value")).alias("s")
    return both.groupBy("workspace_id", "key").agg(newest).select("s.*")


def setting(settings: DataFrame, workspace: str, key: str) -> DataFrame:
    """One row, value: the setting unwrapped."""
    found = settings.where((F.col("workspace_id") == workspace) & (F.col("key") == key))
    return found.select(F.coalesce(F.get_json_object("value", "$._v"), F.col("value")).alias("value"))


def enrich_geo(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (id, ip_address) with geo, the map of the range that holds the address.

    ranges (low, high: 32 hex digits as of devices.address_key; geo) don't overlap and may be of any width. An as-of sweep: different addresses and the starts of ranges are
    dealt out by ranges of keys and written; within a partition an address takes the last start before it, and where there is none the last start of the
    partitions before, which is one row a partition.
    """
    starts = ranges.select(F.col("low").alias("key"), F.lit(0).alias("kind"), F.struct("high", "geo").alias("range"))
    asked = rows.select("ip_address").distinct().withColumn("key", devices.address_key("ip_address")).where(F.col("key").isNotNull())
    both = starts.unionByName(asked.select("key", F.lit(1).alias("kind"), "ip_address"), allowMissingColumns=True)
    both = written(both.repartitionByRange("key", "kind").withColumn("part", F.spark_partition_id()), "addresses")
    lasts = both.groupBy("part").agg(F.max_by("range", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    carried = lasts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    before = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("held", F.last("range", ignorenulls=True).over(before)).where("kind = 1").join(carried, "part").withColumn("held", F.coalesce("held", "carried"))
    found = found.select("ip_address", F.when(F.col("key") <= F.col("held.high"), F.col("held.geo")).alias("geo"))
    return rows.drop("geo").join(found, "ip_address", "left")
