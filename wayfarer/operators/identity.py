"""Identity: candidates for signals, merges, people with one external id or e-mail, attribution.

Online, each request merges what it matches. In batch, visitors that share a strong key (external id, ga_id, e-mail)
in a workspace form components; each collapses into its oldest member. Where the order of requests with weak signals decides, replay.replay
gives what the online form does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.values import MAX_TOUCHPOINTS, add_unique, append_touchpoint, concat_unique, empty_map, last_touchpoints, merge_maps
from wayfarer.operators import graph

STRONG, WEAK = ("person_external_id", "ga_id", "person_email"), ("fingerprint", "anonymous_id")
#: Signal: visitor column it is looked for in, and whether that is a list.
HELD_IN = {"person_external_id": ("person_external_id", False), "ga_id": ("ga_id", False), "person_email": ("person_email", False), "fingerprint": ("fingerprints", True), "anonymous_id": ("anonymous_ids", True), "click_id": ("click_ids", True)}


def _keys(visitors: DataFrame) -> DataFrame:
    """(workspace_id, kind, key, visitor_id, first_seen_at): each identifying value of unmerged visitors."""
    one = lambda kind, values: F.transform(values, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("key")))
    lists = [one(kind, F.coalesce(F.col(c) if many else F.array(F.col(c)), F.array().cast("array<string>"))) for kind, (c, many) in HELD_IN.items() if c in visitors.columns]
    pairs = F.filter(F.concat(*lists), lambda x: x["key"].isNotNull())
    live = visitors.where(F.coalesce(F.col("status"), F.lit("")) != "merged")
    return live.select("workspace_id", F.col("id").alias("visitor_id"), "first_seen_at", F.explode(F.array_distinct(pairs)).alias("p")).select("workspace_id", "p.kind", "p.key", "visitor_id", "first_seen_at")


def _asked(signals: DataFrame) -> DataFrame:
    """request_id, workspace_id, kind, key: a row for each signal of a request."""
    given = [k for k in HELD_IN if k in signals.columns]
    asked = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in given]), lambda x: x["key"].isNotNull())
    return signals.select("request_id", "workspace_id", F.explode(asked).alias("p")).select("request_id", "workspace_id", "p.kind", "p.key")


def candidate_rows(signals: DataFrame, visitors: DataFrame) -> DataFrame:
    """request_id, visitor_id, first_seen_at: a row for each visitor that a request's signals match, by one equi-join on (kind, value)."""
    return _asked(signals).join(_keys(visitors), ["workspace_id", "kind", "key"]).select("request_id", "visitor_id", "first_seen_at").distinct()


def candidates(signals: DataFrame, visitors: DataFrame) -> DataFrame:
    """request_id and candidates (visitor ids, oldest first) of each row of signals. For signals that very many visitors share, take oldest or candidate_rows."""
    listed = candidate_rows(signals, visitors).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("first_seen_at", "visitor_id"))).alias("c"))
    return signals.select("request_id").join(listed, "request_id", "left").select("request_id", F.coalesce(F.transform("c", lambda x: x["visitor_id"].cast("string")), F.array().cast("array<string>")).alias("candidates"))


def oldest(signals: DataFrame, visitors: DataFrame) -> DataFrame:
    """request_id and visitor_id, the oldest candidate, of requests that have one.

    Visitors of one signal are reduced to the oldest by partial aggregation before requests meet them, so that a signal that any number of visitors share is one row.
    """
    first = _keys(visitors).groupBy("workspace_id", "kind", "key").agg(F.min(F.struct("first_seen_at", "visitor_id")).alias("first"))
    found = _asked(signals).join(first, ["workspace_id", "kind", "key"]).groupBy("request_id").agg(F.min("first").alias("first"))
    return found.select("request_id", F.col("first.visitor_id").alias("visitor_id"))


def merge_allowed(columns: list[str]) -> Column:
    """A strong signal, or two weak ones, in the request."""
    given = lambda names: sum((F.col(c).isNotNull().cast("int") for c in names if c in columns), F.lit(0))
    return (given(STRONG) >= 1) | (given(WEAK) >= 2)


def resolve(signals: DataFrame, visitors: DataFrame) -> DataFrame:
    """request_id, action (create, update, merge), visitor_id (the oldest candidate) and merged_ids of each request.

    Candidates are listed only for requests that may merge them.
    """
    may = signals.where(merge_allowed(signals.columns))
    rest = candidate_rows(may, visitors).join(oldest(may, visitors).withColumnRenamed("visitor_id", "first_id"), "request_id").where("visitor_id != first_id")
    merged = rest.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("first_seen_at", "visitor_id"))).alias("c"))
    found = signals.select("request_id").join(oldest(signals, visitors), "request_id", "left").join(merged, "request_id", "left")
    action = F.when(F.col("visitor_id").isNull(), "create").when(F.col("c").isNotNull(), "merge").otherwise("update")
    ids = F.coalesce(F.transform("c", lambda x: x["visitor_id"].cast("string")), F.array().cast("array<string>"))
    return found.select("request_id", action.alias("action"), F.col("visitor_id").cast("string").alias("visitor_id"), ids.alias("merged_ids"))


def create_visitors(signals: DataFrame, ids: Column, now: Column) -> DataFrame:
    """Rows for requests that match nobody; what is known of persons is not taken over."""
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col(c))).otherwise(F.array().cast("array<string>")) if c in signals.columns else F.array().cast("array<string>")
    value = lambda c, kind="string": F.col(c) if c in signals.columns else F.lit(None).cast(kind)
    source = value("source", "map<string,string>")
    return signals.select(
        ids.alias("id"),
        "workspace_id",
        listed("fingerprint").alias("fingerprints"),
        listed("anonymous_id").alias("anonymous_ids"),
        listed("click_id").alias("click_ids"),
        value("ga_id").alias("ga_id"),
        source.alias("first_source"),
        source.alias("last_source"),
        value("click_id").alias("first_click_id"),
        value("click_id").alias("last_click_id"),
        now.alias("first_seen_at"),
        now.alias("last_seen_at"),
        F.when(source.isNotNull(), F.array(source)).otherwise(F.array().cast("array<map<string,string>>")).alias("attribution_path"),
        F.lit("anonymous").alias("status"),
    )


def update_visitors(visitors: DataFrame, signals: DataFrame, now: Column) -> DataFrame:
    """visitors with the signals of at most one request each (signals has visitor_id)."""
    given = signals.select(F.col("visitor_id").alias("id"), *[F.col(c).alias(f"s_{c}") for c in signals.columns if c != "visitor_id"])
    joined = visitors.join(given, "id", "left")
    held = set(given.columns)
    new = {"last_seen_at": F.when(F.col("s_request_id").isNotNull(), now).otherwise(F.col("last_seen_at"))}
    for signal, column in (("source", "last_source"), ("click_id", "last_click_id"), ("ga_id", "ga_id")):
        if f"s_{signal}" in held and column in visitors.columns:
            new[column] = F.coalesce(F.col(f"s_{signal}"), F.col(column))
    for signal, column in (("fingerprint", "fingerprints"), ("anonymous_id", "anonymous_ids"), ("click_id", "click_ids")):
        if f"s_{signal}" in held and column in visitors.columns:
            new[column] = add_unique(F.col(column), F.col(f"s_{signal}"))
    if "s_click_id_params" in held:
        new["click_id_params"] = merge_maps(F.col("click_id_params"), F.col("s_click_id_params"))
    if "s_source" in held and "attribution_path" in visitors.columns:
        new["attribution_path"] = append_touchpoint(F.col("attribution_path"), F.col("s_source"))
    if "s_geo" in held:
        new["geo"] = F.when(empty_map(F.col("geo")), F.coalesce(F.col("s_geo"), F.col("geo"))).otherwise(F.col("geo"))
    return joined.withColumns(new).select(*visitors.columns)


def components(visitors: DataFrame, kinds: tuple[str, ...] = STRONG) -> DataFrame:
    """(visitor_id, survivor_id): visitors that share keys of these kinds, directly or through others; the oldest survives.

    Components come from graph.components by way of the keys: a group of any size meets in partial aggregates only. Who shares no key is a group alone.
    """
    live = visitors.where(F.coalesce(F.col("status"), F.lit("")) != "merged")
    order = F.struct(F.coalesce("first_seen_at", F.lit("9999-12-31").cast("timestamp")).alias("at"), F.col("id").alias("id"))
    keys = _keys(visitors).where(F.col("kind").isin(*kinds))
    seen = F.struct(F.coalesce("first_seen_at", F.lit("9999-12-31").cast("timestamp")).alias("at"), F.col("visitor_id").alias("id"))
    roots = graph.components(keys.select(seen.alias("member"), F.struct("workspace_id", "kind", "key").alias("hub")))
    named = roots.select(F.col("member.id").alias("visitor_id"), F.col("root.id").alias("root_id"))
    found = live.select(F.col("id").alias("visitor_id"), order.alias("own")).join(named, "visitor_id", "left")
    return found.select("visitor_id", F.coalesce("root_id", "own.id").alias("survivor_id"))


LISTS = ("fingerprints", "anonymous_ids", "click_ids")


def _united_lists(members: DataFrame, columns: list[str]) -> DataFrame:
    """survivor_id and m_ columns: the different values of the members' lists, those of older members first.

    A value that many members share is one row before lists are made.
    """

    def values(c: str) -> Column:
        return F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(c).alias("c"), i.alias("i"), x.alias("x")))

    each = members.select("survivor_id", "first_seen_at", "id", F.explode(F.concat(*[values(c) for c in columns])).alias("v"))
    once = each.groupBy("survivor_id", "v.c", "v.x").agg(F.min(F.struct("first_seen_at", "id", "v.i")).alias("o"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("c") == c, F.struct("o", "x")))), lambda y: y["x"]).alias(f"m_{c}")
    return once.groupBy("survivor_id").agg(*[listed(c) for c in columns])


def _united_paths(members: DataFrame, most: int = MAX_TOUCHPOINTS) -> DataFrame:
    """survivor_id and m_attribution_path: the members' different touchpoints by time, unreadable times last, the last fifty."""
    each = members.select("survivor_id", "first_seen_at", "id", F.posexplode("attribution_path").alias("i", "x"))
    at = F.try_to_timestamp(F.col("x")["timestamp"])
    once = each.groupBy("survivor_id", F.to_json("x").alias("j")).agg(F.min_by(F.struct(at.isNull().alias("no"), at.alias("at"), "first_seen_at", "id", "i", "x"), F.struct(at.isNull().alias("no"), at.alias("at"), "first_seen_at", "id", "i")).alias("p"))
    newest = Window.partitionBy("survivor_id").orderBy(*[F.col(f"p.{c}").desc_nulls_last() for c in ("no", "at", "first_seen_at", "id", "i")])
    last = once.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= most)
    return last.groupBy("survivor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "p.x")), lambda x, y: y["n"] - x["n"]), lambda y: y["x"]).alias("m_attribution_path"))


def merge(visitors: DataFrame, groups: DataFrame) -> DataFrame:
    """visitors after merging groups (visitor_id, survivor_id): survivors with all signals, the others marked merged.

    Lists are joined oldest first; geo is the earliest that isn't empty; the first partner is that of the
    earliest and the last partner that of the latest visitor who has one; touchpoints go by time, the last fifty stay.
    """
    rows = visitors.join(groups.select(F.col("visitor_id").alias("id"), "survivor_id"), "id", "left").withColumn("survivor_id", F.coalesce("survivor_id", "id"))
    moved = rows.where(F.col("survivor_id") != F.col("id"))
    touched = moved.select("survivor_id").distinct()
    members = rows.join(touched, "survivor_id", "left_semi")
    order = F.struct("first_seen_at", "id")
    columns = set(visitors.columns)
    made: list[Column] = []
    if "geo" in columns:
        made.append(F.min_by("geo", F.when(~empty_map(F.col("geo")), order)).alias("m_geo"))
    partner = {"first": ("first_partner_id", "first_referral_link_id", "first_referral_click_id"), "last": ("last_partner_id", "last_referral_link_id", "last_referral_click_id")}
    for which, names in partner.items():
        if names[0] in columns:
            has = F.col(names[0]).isNotNull()
            pick = (lambda c, has=has: F.min_by(c, F.when(has, order))) if which == "first" else (lambda c, has=has: F.max_by(c, F.when(has, F.struct("last_seen_at", "id"))))
            made += [pick(c).alias(f"m_{c}") for c in names if c in columns]
    made.append(F.max("last_seen_at").alias("m_last_seen_at"))
    united = members.groupBy("survivor_id").agg(*made)
    if lists := [c for c in LISTS if c in columns]:
        united = united.join(_united_lists(members, lists), "survivor_id", "left")
    if "attribution_path" in columns:
        united = united.join(_united_paths(members), "survivor_id", "left")
    out = rows.join(united.withColumnRenamed("survivor_id", "u_id"), F.col("id") == F.col("u_id"), "left")
    new = {c: F.when(F.col("u_id").isNotNull(), F.coalesce(f"m_{c}", c)).otherwise(F.col(c)) for c in (x.removeprefix("m_") for x in united.columns if x.startswith("m_"))}
    gone = F.col("survivor_id") != F.col("id")
    new |= {"status": F.when(gone, "merged").otherwise(F.col("status")), "merged_into_id": F.when(gone, F.col("survivor_id")).otherwise(F.col("merged_into_id"))}
    return out.withColumns(new).select(*visitors.columns)


def repoint(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Events or sessions with their visitor replaced by its survivor."""
    moved = groups.where(F.col("visitor_id") != F.col("survivor_id"))
    found = rows.join(moved, "visitor_id", "left")
    return found.withColumn("visitor_id", F.coalesce("survivor_id", "visitor_id")).select(*rows.columns)


def move_sessions(visitors: DataFrame, sessions: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visitors, sessions) after sessions went to the survivors: total_sessions goes down where they were and up where they are now."""
    moved = groups.where(F.col("visitor_id") != F.col("survivor_id"))
    counts = sessions.groupBy("visitor_id").agg(F.count("*").alias("n")).join(moved, "visitor_id")
    change = counts.select(F.explode(F.array(F.struct(F.col("visitor_id").alias("d_id"), (-F.col("n")).alias("n")), F.struct(F.col("survivor_id").alias("d_id"), "n"))).alias("d"))
    change = change.groupBy("d.d_id").agg(F.sum("d.n").alias("d_n"))
    joined = visitors.join(change, visitors["id"] == change["d_id"], "left")
    total = (F.coalesce("total_sessions", F.lit(0)) + F.col("d_n")).cast(visitors.schema["total_sessions"].dataType)
    counted = joined.withColumn("total_sessions", F.when(F.col("d_n").isNotNull(), total).otherwise(F.col("total_sessions")))
    return counted.select(*visitors.columns), repoint(sessions, groups)


def identify(visitors: DataFrame, persons: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(visitors, groups) after persons (visitor_id and person_* columns) became known.

    Whoever already has the external id or the e-mail is merged with the visitor, into the older of the two; the survivor gets
    the attributes and the status identified.
    """
    given = [c for c in persons.columns if c.startswith("person_")]
    joined = visitors.join(persons.select(F.col("visitor_id").alias("id"), *[F.col(c).alias(f"p_{c}") for c in given]), "id", "left")
    known = F.coalesce(*[F.col(f"p_{c}").cast("string") for c in given]).isNotNull()
    new = {c: F.coalesce(F.col(f"p_{c}"), F.col(c)) for c in given if c in visitors.columns}
    named = joined.withColumns(new | {"identified_at": F.when(known, now).otherwise(F.col("identified_at")), "status": F.when(known, "identified").otherwise(F.col("status"))}).select(*visitors.columns)
    groups = components(named, ("person_external_id", "person_email"))
    merged = merge(named, groups)
    # The attributes of the newest given person go to the survivor.
    last = Window.partitionBy("survivor_id").orderBy(F.col("first_seen_at").desc(), F.col("id").desc())
    mine = named.join(persons.select(F.col("visitor_id").alias("id")), "id", "left_semi").join(groups.withColumnRenamed("visitor_id", "id"), "id")
    top = mine.withColumn("rn", F.row_number().over(last)).where("rn = 1").select(F.col("survivor_id").alias("t_id"), *[F.col(c).alias(f"t_{c}") for c in given if c in visitors.columns])
    out = merged.join(top, F.col("id") == F.col("t_id"), "left").withColumns({c: F.coalesce(F.col(f"t_{c}"), F.col(c)) for c in given if c in visitors.columns} | {"identified_at": F.when(F.col("t_id").isNotNull(), F.coalesce("identified_at", now)).otherwise(F.col("identified_at")), "status": F.when(F.col("t_id").isNotNull(), "identified").otherwise(F.col("status"))})
    return out.select(*visitors.columns), groups


def attribution_paths(events: DataFrame, most: int = 50) -> DataFrame:
    """(visitor_id, touchpoints): the last fifty sources of each visitor's events, in order of time."""
    newest = Window.partitionBy("visitor_id").orderBy(F.col("inserted_at").desc(), F.col("id").desc())
    rows = events.where(F.col("source_platform").isNotNull()).withColumn("rn", F.row_number().over(newest)).where(F.col("rn") <= most)
    point = F.struct("inserted_at", "id", F.concat_ws("/", "source_platform", "source_medium").alias("source"))
    return rows.groupBy("visitor_id").agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["source"]).alias("touchpoints"))


def cap_path(path: Column) -> Column:
    return last_touchpoints(path)


def union_signals(*lists: Column) -> Column:
    return concat_unique(*lists)
