"""Events and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.streaming.events import event_level_filter, flatten_events
from stagewise.streaming.merge import merge_fragments_stream, read_merged
from workload.base import query, scratch, table
from workload.merging import ORDER_MERGE_SQL, order_fragments


def progress_events(events):
    """Progress events derived from the event table."""
    return events.select(
        F.col("event_id").alias("id"),
        F.expr("CASE event_type WHEN 'view' THEN 'debug' WHEN 'error' THEN 'err' ELSE 'info' END").alias("level"),
        F.lit("runner").alias("component"),
        F.expr("CASE event_type WHEN 'error' THEN 'error' ELSE 'generic' END").alias("type"),
        F.lit("note").alias("message"),
        F.concat(F.lit("stage_"), F.pmod("user_id", F.lit(5))).alias("session"),
        F.expr("IF(event_type = 'click', cast(user_id AS int), NULL)").alias("iteration"),
        F.expr("IF(event_type = 'error', props, NULL)").alias("err"),
        F.create_map(F.lit("k"), F.get_json_object("props", "$.k")).alias("args"),
    )


@query(
    "event_level_filter",
    """
    SELECT event_id AS id, CASE event_type WHEN 'error' THEN 'err' ELSE 'info' END AS level
    FROM events WHERE event_type <> 'view'
    """,
)
def event_level_filter_query(spark, sf_dir):
    return event_level_filter(progress_events(table(spark, sf_dir, "events")), "info").select("id", "level")


_FLAT = """
    WITH f AS (
      SELECT event_id AS id, 0 AS place, 'component' AS name, 'runner' AS value FROM events
      UNION ALL SELECT event_id, 1, 'type', CASE event_type WHEN 'error' THEN 'error' ELSE 'generic' END FROM events
      UNION ALL SELECT event_id, 2, 'session', 'stage_' || (user_id % 5) FROM events
      UNION ALL SELECT event_id, 3, 'iteration', CAST(user_id AS VARCHAR) FROM events WHERE event_type = 'click'
      UNION ALL SELECT event_id, 4, 'err', props FROM events WHERE event_type = 'error'
      UNION ALL SELECT event_id, 5, 'k', json_extract_string(props, '$.k') FROM events)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY place) - 1 AS INTEGER) AS pos, name, value FROM f
    """


@query("flatten_events", _FLAT)
def flatten_events_query(spark, sf_dir):
    return flatten_events(progress_events(table(spark, sf_dir, "events")))


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("flatten_events_stream", _FLAT)
def flatten_events_stream_query(spark, sf_dir):
    out = scratch(spark, "flat-events")
    flat = flatten_events(event_level_filter(progress_events(_stream(spark, sf_dir, "events")), "debug"))
    running = (
        flat.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("merge_fragments_stream", ORDER_MERGE_SQL)
def merge_fragments_stream_query(spark, sf_dir):
    out = scratch(spark, "merge-stream")
    fragments = order_fragments(_stream(spark, sf_dir, "orders"))
    running = merge_fragments_stream(
        fragments, "o_custkey", "o_orderkey", "fragment", f"{out}/tables", f"{out}/state", {"availableNow": True}
    )
    running.awaitTermination()
    return read_merged(spark, "o_custkey", f"{out}/tables")
