"""Streaming queries run to completion over the given files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidepanel.operators import rollup
from tidepanel.plans.registry import query
from tidepanel.schema import SERIES, WEEK_KEYS
from tidepanel.session import cut_lineage, shared_folder
from tidepanel.sources import tables
from tidepanel.streaming import recency, rollup as stream_rollup
from tidepanel.streaming.sink import run_to_table


@query("stream_weekly_rollup", """
SELECT event_type, CAST(date_trunc('week', ts) AS DATE) AS week, sum(value) AS units_sold, count(*) AS n_rows FROM events
GROUP BY ALL HAVING CAST(date_trunc('week', min(ts)) AS TIMESTAMP) + INTERVAL 7 DAY <= (SELECT max(ts) - INTERVAL 7 DAY FROM events)""",
       "event_type:s week:d units_sold:f n_rows:i")
def stream_weekly_rollup(spark, sf):
    return stream_rollup.run_weekly_totals(spark, sf, ["event_type"], "value")


@query("stream_scorable_origins", """
SELECT event_type, CAST(date_trunc('week', ts) AS DATE) - 7 AS week, sum(value) AS label FROM events
GROUP BY event_type, date_trunc('week', ts) HAVING CAST(date_trunc('week', min(ts)) AS TIMESTAMP) + INTERVAL 7 DAY <= (SELECT max(ts) FROM events)""",
       "event_type:s week:d label:f")
def stream_scorable_origins(spark, sf):
    return stream_rollup.run_scorable_origins(spark, sf, ["event_type"], "value")


@query("stream_dedup", "SELECT event_id, event_type, value FROM events", "event_id:i event_type:s value:f")
def stream_dedup(spark, sf):
    """Every event delivered twice; one survives."""
    events = stream_rollup.read_events(spark, sf)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_to_table(stream_rollup.deduplicated(twice, ["event_id"]), "dedup").select("event_id", "event_type", "value")


@query("stream_promo_recency", """
SELECT sku, channel, region, week, date_diff('day', max(CASE WHEN promotion_flag = 1 THEN week END) OVER
  (PARTITION BY sku, channel, region ORDER BY week), week) / 7 AS promo_recency FROM weekly""",
       "sku:s channel:s region:s week:d promo_recency:f")
def stream_promo_recency(spark, sf):
    """The weekly panel arriving in two deliveries; the second run resumes the state of the first."""
    folder = f"{shared_folder(spark)}/stream-recency-{uuid.uuid4().hex}"
    weekly = cut_lineage(rollup.weekly_rollup(tables.sales_daily(spark, sf)).select(*WEEK_KEYS, "promotion_flag"))
    out = None
    early = F.col("week") < F.lit("1998-06-01").cast("date")
    for i, part in enumerate([weekly.filter(early), weekly.filter(~early)]):
        part.write.mode("overwrite").parquet(f"{folder}/in/delivery={i}")
        stream = spark.readStream.schema(part.schema).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = run_to_table(recency.promo_recency_stream(stream), "recency", f"{folder}/out")
    return out
