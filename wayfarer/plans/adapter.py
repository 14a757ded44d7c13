"""The logical tables made from the test tables (events, pages): fixed arithmetic gives events what those lack.

The SQL runs on Spark and on the oracle alike. Events deal themselves over all pages, whose ids run from 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.operators import sessions as session_rules
from wayfarer.plans.schemas import DEFAULT_WORKSPACE

GAP_SECONDS = 21_600

EVENTS = f"""
SELECT e.event_id AS id, '{DEFAULT_WORKSPACE}' AS workspace_id, CAST(e.ts AS timestamp) AS inserted_at, e.user_id AS visitor_id,
  CASE e.event_type WHEN 'view' THEN 'pageview' WHEN 'click' THEN 'link_click' WHEN 'signup' THEN 'lead' WHEN 'purchase' THEN 'sale' ELSE 'custom' END AS event_type,
  CASE WHEN e.event_type IN ('signup', 'purchase') THEN concat('form_', CAST(e.event_id % 3 AS varchar(20))) END AS event_name,
  CASE WHEN e.event_type = 'purchase' THEN CAST(round(e.value * 100) AS bigint) END AS amount_cents,
  CASE e.event_id % 5 WHEN 0 THEN 'desktop' WHEN 1 THEN 'smartphone' WHEN 2 THEN 'tablet' WHEN 3 THEN 'desktop' END AS device_type,
  CASE e.event_id % 3 WHEN 0 THEN 'Chrome' WHEN 1 THEN 'Safari' END AS browser,
  CASE e.event_id % 4 WHEN 0 THEN 'Windows' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Android' END AS os,
  CASE e.event_id % 8 WHEN 0 THEN 'google' WHEN 1 THEN 'facebook' WHEN 2 THEN 'direct' END AS source_platform,
  CASE e.event_id % 8 WHEN 0 THEN 'organic' WHEN 1 THEN 'social' WHEN 2 THEN 'direct' END AS source_medium,
  CASE e.event_id % 11 WHEN 0 THEN '50%off' WHEN 1 THEN '50-summer-off' END AS source_campaign,
  CASE WHEN e.event_type = 'click' THEN e.event_id % 20 END AS link_id,
  CASE WHEN e.event_type = 'click' AND e.event_id % 3 = 0 THEN concat('c', CAST(e.event_id AS varchar(20))) END AS click_id,
  CASE WHEN e.event_id % 13 = 0 THEN e.event_id % 4 END AS partner_id,
  concat('10.0.', CAST(e.user_id % 7 AS varchar(20)), '.1') AS ip_address,
  CASE WHEN e.event_type = 'error' THEN e.event_id % 25000 END AS engaged_ms,
  p.url AS url, regexp_extract(p.url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path, e.props AS props
FROM (SELECT *, event_id % greatest((SELECT count(*) FROM {{pages}}), 1) AS page FROM {{events}}) e LEFT JOIN {{pages}} p ON p.page_id = e.page
"""

#: Every tenth user is merged into the one before it.
VISITORS = f"""
SELECT user_id AS id, '{DEFAULT_WORKSPACE}' AS workspace_id, CASE WHEN user_id % 10 = 9 THEN user_id - 1 END AS merged_into_id,
  CASE WHEN user_id % 10 = 9 THEN 'merged' ELSE 'anonymous' END AS status,
  min(CAST(ts AS timestamp)) AS first_seen_at, max(CAST(ts AS timestamp)) AS last_seen_at,
  CASE WHEN user_id % 4 = 0 THEN min(CAST(ts AS timestamp)) END AS identified_at,
  CASE user_id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'FR' END AS country_code,
  CASE WHEN user_id % 5 < 3 THEN concat('u', CAST(user_id - user_id % 3 AS varchar(20)), '@example.org') END AS person_email,
  CASE WHEN user_id % 7 < 4 THEN concat('x', CAST(user_id - user_id % 2 AS varchar(20))) END AS person_external_id
FROM {{events}} GROUP BY user_id
"""

DISPATCHES = "SELECT id AS event_id, 'meta' AS connector_type FROM {a_events} WHERE event_type = 'sale' AND id % 3 = 0"


@dataclass(frozen=True)
class Tables:
    """The logical tables of a data folder."""

    spark: SparkSession
    sf_dir: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        found = self.spark.sql(EVENTS, events=self.raw("events"), pages=self.raw("pages").select("page_id", "url"))
        return found.withColumn("properties", F.from_json("props", "map<string,string>")).withColumn("host", F.lit(None).cast("string"))

    @cached_property
    def visitors(self) -> DataFrame:
        found = self.spark.sql(VISITORS, events=self.raw("events"))
        geo = F.when(F.col("country_code").isNotNull(), F.create_map(F.lit("country_code"), F.col("country_code"))).otherwise(F.create_map().cast("map<string,string>"))
        return found.withColumn("geo", geo)

    @cached_property
    def dispatches(self) -> DataFrame:
        return self.spark.sql(DISPATCHES, a_events=self.events)

    @cached_property
    def sessions(self) -> DataFrame:
        return session_rules.sessions(self.events, GAP_SECONDS)
