"""Unique clicks: of one address on one link, one counts each hour, from the click that counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS = 3600


def mark_unique(clicks: DataFrame, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """clicks (id, ip_address, link_id, inserted_at) with is_unique.

    A click after a pause of ttl_seconds always counts, so pauses cut a pair's clicks into runs that don't affect one another; each
    run is folded in order of time, the array of a run being all that is held at once.
    """
    pair = ("ip_address", "link_id")
    us = F.unix_micros("inserted_at")
    ordered = Window.partitionBy(*pair).orderBy("us", "id")
    rows = clicks.withColumn("us", us).withColumn("pause", F.col("us") - F.lag("us").over(ordered))
    rows = rows.withColumn("run", F.sum(F.coalesce(F.col("pause") >= ttl_seconds * 1_000_000, F.lit(True)).cast("int")).over(ordered))
    rows = rows.withColumns({"n": F.count("*").over(Window.partitionBy(*pair, "run")), "place": F.row_number().over(Window.partitionBy(*pair, "run").orderBy("us", "id"))})
    runs = rows.where("n > 1").groupBy(*pair, "run").agg(F.array_sort(F.collect_list(F.struct("place", "us"))).alias("c"))
    # The fold counts places in the run's order, so that ids may be of any type; the runs' rows know their place by the same order.
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast("array<int>").alias("places"))

    def step(state, click):
        counts = F.coalesce(click["us"] - state["last"] >= ttl_seconds * 1_000_000, F.lit(True))
        return F.struct(F.when(counts, click["us"]).otherwise(state["last"]).alias("last"), F.when(counts, F.array_append(state["places"], click["place"])).otherwise(state["places"]).alias("places"))

    counted = runs.select(*pair, "run", F.explode(F.aggregate("c", start, step)["places"]).alias("place")).select(*[F.col(c).alias(f"c_{c}") for c in (*pair, "run", "place")])
    same = [rows[c].eqNullSafe(counted[f"c_{c}"]) for c in (*pair, "run", "place")]
    found = rows.join(counted, same, "left")
    return found.withColumn("is_unique", (F.col("n") == 1) | F.col("c_place").isNotNull()).select(*clicks.columns, "is_unique")


def link_stats(clicks: DataFrame, events: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """link_id with total_clicks, unique_clicks and, with events, total_leads, total_sales, total_revenue_cents of the link.

    A link has a row if it has clicks, leads or sales, or is one of links (id). Counts of each kind are made by themselves and added up.
    """
    parts = [mark_unique(clicks).groupBy("link_id").agg(F.count("*").alias("total_clicks"), F.count_if("is_unique").alias("unique_clicks"))]
    columns = ["total_clicks", "unique_clicks"]
    if events is not None:
        sale, lead = F.col("event_type") == "sale", F.col("event_type") == "lead"
        made = events.where(F.col("link_id").isNotNull() & (sale | lead)).groupBy("link_id")
        parts.append(made.agg(F.count_if(lead).alias("total_leads"), F.count_if(sale).alias("total_sales"), F.coalesce(F.sum(F.when(sale, F.col("amount_cents"))), F.lit(0)).alias("total_revenue_cents")))
        columns += ["total_leads", "total_sales", "total_revenue_cents"]
    if links is not None:
        parts.append(links.select(F.col("id").alias("link_id")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return both.groupBy("link_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])
