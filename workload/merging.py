"""Merging, overlaying, inference and roll-ups."""

from __future__ import annotations


from pyspark.sql import functions as F

from stagewise.operators.infer import infer_schema, schema_paths
from stagewise.operators.merge import merge_fragments, merge_records, overlay_fragments
from stagewise.operators.rollup import collect_text, resources_to_vars, run_status
from workload.base import query, table


ORDER_COLUMNS = ["o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority"]


def order_fragments(orders):
    """One partial record per order: a plain value, a list and an object."""
    fragment = F.to_json(
        F.struct(
            F.col("o_orderstatus").alias("status"),
            F.array("o_orderkey").alias("orders"),
            F.struct(F.col("o_orderpriority").alias("prio")).alias("last"),
        )
    )
    return orders.select("o_custkey", "o_orderkey", fragment.alias("fragment"))


ORDER_MERGE_SQL = """
    WITH last AS (
      SELECT o_custkey, max(o_orderkey) AS hi, min(o_orderkey) AS lo, arg_max(o_orderstatus, o_orderkey) AS status,
             arg_max(o_orderpriority, o_orderkey) AS prio
      FROM orders GROUP BY o_custkey)
    SELECT o_custkey, 'status' AS field, 'scalar' AS kind, hi AS seq, 0 AS pos, CAST(NULL AS VARCHAR) AS name,
           '"' || status || '"' AS value FROM last
    UNION ALL SELECT o_custkey, 'last', 'object', hi, -1, NULL, NULL FROM last
    UNION ALL SELECT o_custkey, 'last', 'object', hi, 0, 'prio', '"' || prio || '"' FROM last
    UNION ALL SELECT o_custkey, 'orders', 'list', lo, -1, NULL, NULL FROM last
    UNION ALL SELECT o_custkey, 'orders', 'list', o_orderkey, 0, NULL, CAST(o_orderkey AS VARCHAR) FROM orders
    """


@query("merge_fragments", ORDER_MERGE_SQL)
def merge_fragments_query(spark, sf_dir):
    return merge_fragments(order_fragments(table(spark, sf_dir, "orders", *ORDER_COLUMNS)), "o_custkey", "o_orderkey", "fragment")


@query(
    "merge_mixed_fragments",
    """
    WITH e AS (
      SELECT user_id, event_id AS seq, event_type AS t,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, user_id % 4 = 0 AS lists
      FROM events),
    kinds AS (
      SELECT *, CASE t WHEN 'view' THEN 'scalar' WHEN 'click' THEN 'object' WHEN 'signup' THEN 'object'
                       WHEN 'error' THEN 'null' WHEN 'purchase' THEN CASE WHEN lists THEN 'list' ELSE 'scalar' END END AS kind
      FROM e),
    marks AS (
      SELECT user_id, min(seq) FILTER (kind = 'list') AS l, max(seq) FILTER (kind = 'scalar') AS s,
             max(seq) FILTER (kind = 'object') AS o, max(seq) FILTER (kind = 'null') AS z FROM kinds GROUP BY user_id),
    final AS (
      SELECT *, CASE WHEN l IS NOT NULL THEN 'list'
                     WHEN o IS NOT NULL AND (s IS NULL OR o > s) THEN 'object'
                     WHEN s IS NOT NULL AND (z IS NULL OR z < s) THEN 'scalar' END AS kind FROM marks),
    members AS (
      SELECT user_id, seq, 'k' AS name, CAST(k AS VARCHAR) AS value FROM kinds WHERE t = 'click'
      UNION ALL SELECT user_id, seq, 't', '"' || t || '"' FROM kinds WHERE t IN ('click', 'signup'))
    SELECT f.user_id, 'f' AS field, f.kind, CASE f.kind WHEN 'list' THEN l WHEN 'object' THEN o ELSE s END AS seq,
           CASE f.kind WHEN 'scalar' THEN 0 ELSE -1 END AS pos, CAST(NULL AS VARCHAR) AS name,
           CASE f.kind WHEN 'scalar' THEN CASE c.t WHEN 'view' THEN CAST(c.k AS VARCHAR) ELSE '"bought"' END END AS value
    FROM final f LEFT JOIN kinds c ON f.user_id = c.user_id AND f.s = c.seq WHERE f.kind IS NOT NULL
    UNION ALL
    SELECT f.user_id, 'f', 'object', max(m.seq), 0, m.name, arg_max(m.value, m.seq)
    FROM final f JOIN members m ON f.user_id = m.user_id
    WHERE f.kind = 'object' AND (f.s IS NULL OR m.seq > f.s) GROUP BY f.user_id, m.name
    UNION ALL
    SELECT f.user_id, 'f', 'list', c.seq, p.pos, NULL,
           CASE c.t WHEN 'view' THEN CAST(c.k AS VARCHAR) WHEN 'click' THEN '{"k":' || c.k || ',"t":"click"}'
                    WHEN 'signup' THEN '{"t":"signup"}' ELSE CASE p.pos WHEN 0 THEN CAST(c.k AS VARCHAR) ELSE '"p"' END END
    FROM final f JOIN kinds c ON f.user_id = c.user_id AND c.seq >= f.l, (VALUES (0), (1)) AS p(pos)
    WHERE f.kind = 'list' AND c.kind <> 'null' AND (p.pos = 0 OR c.kind = 'list')
    """,
)
def merge_mixed_fragments_query(spark, sf_dir):
    value = F.expr(
        """CASE event_type WHEN 'view' THEN get_json_object(props, '$.k')
           WHEN 'click' THEN concat('{"t": "click", "k": ', get_json_object(props, '$.k'), '}')
           WHEN 'signup' THEN '{"t": "signup"}' WHEN 'error' THEN 'null'
           ELSE IF(user_id % 4 = 0, concat('[', get_json_object(props, '$.k'), ', "p"]'), '"bought"') END"""
    )
    fragments = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "props").select(
        "user_id", "event_id", F.concat(F.lit('{"f": '), value, F.lit("}")).alias("fragment")
    )
    return merge_fragments(fragments, "user_id", "event_id", "fragment")


@query(
    "assemble_records",
    """
    SELECT o_custkey,
           '{"last":{"prio":"' || arg_max(o_orderpriority, o_orderkey) || '"},"orders":['
             || string_agg(o_orderkey, ',' ORDER BY o_orderkey) || '],"status":"' || arg_max(o_orderstatus, o_orderkey) || '"}'
             AS record
    FROM orders GROUP BY o_custkey
    """,
)
def assemble_records_query(spark, sf_dir):
    fragments = order_fragments(table(spark, sf_dir, "orders", *ORDER_COLUMNS))
    return merge_records(fragments, "o_custkey", "o_orderkey", "fragment")


@query(
    "overlay_fragments",
    """
    WITH f AS (
      SELECT user_id, event_id, event_type AS field, replace(props, ' ', '') AS value FROM events
      UNION ALL SELECT user_id, event_id, 'latest', CAST(event_id AS VARCHAR) FROM events)
    SELECT user_id, field, arg_max(value, event_id) AS value FROM f GROUP BY user_id, field
    """,
)
def overlay_fragments_query(spark, sf_dir):
    fragment = F.concat(F.lit('{"'), "event_type", F.lit('": '), "props", F.lit(', "latest": '), "event_id", F.lit("}"))
    fragments = table(spark, sf_dir, "events", "user_id", "event_id", "event_type", "props").select("user_id", "event_id", fragment.alias("fragment"))
    return overlay_fragments(fragments, "user_id", "event_id", "fragment")


def nested_json(spark, sf_dir):
    """Events with a text of varying shape, three levels deep."""
    text = F.expr(
        """CASE event_id % 4
             WHEN 0 THEN concat('{"id": ', event_id, ', "tags": ["', event_type, '", null], "in": ', props, '}')
             WHEN 1 THEN concat('{"id": "', event_id, '", "tags": [], "in": null}')
             WHEN 2 THEN concat('{"id": ', user_id, '.5, "in": {"k": true}}')
             ELSE concat('{"id": ', event_id) END"""
    )
    events = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "props")
    return events.select(text.alias("body"))


@query(
    "schema_paths",
    """
    WITH n AS (
      SELECT count(*) FILTER (event_id % 4 = 0) AS a, count(*) FILTER (event_id % 4 = 1) AS b,
             count(*) FILTER (event_id % 4 = 2) AS c FROM events)
    SELECT '$' AS path, 'object' AS kind, a + b + c AS n FROM n
    UNION ALL SELECT '$."id"', 'integer', a FROM n
    UNION ALL SELECT '$."id"', 'string', b FROM n
    UNION ALL SELECT '$."id"', 'number', c FROM n
    UNION ALL SELECT '$."tags"', 'array', a + b FROM n
    UNION ALL SELECT '$."tags"[]', 'string', a FROM n
    UNION ALL SELECT '$."tags"[]', 'null', a FROM n
    UNION ALL SELECT '$."in"', 'object', a + c FROM n
    UNION ALL SELECT '$."in"', 'null', b FROM n
    UNION ALL SELECT '$."in"."k"', 'integer', a FROM n
    UNION ALL SELECT '$."in"."k"', 'boolean', c FROM n
    """,
)
def schema_paths_query(spark, sf_dir):
    return schema_paths(nested_json(spark, sf_dir), "body")


@query(
    "infer_schema",
    """
    SELECT '{"type": "object", "properties": {'
      || '"id": {"oneOf": [{"type": "integer"}, {"type": "number"}, {"type": "string"}]}, '
      || '"in": {"type": "object", "properties": {"k": {"oneOf": [{"type": "boolean"}, {"type": "integer"}]}}, '
      || '"required": ["k"], "nullable": true}, '
      || '"tags": {"type": "array", "items": {"type": "string", "nullable": true}}}, '
      || '"required": ["id", "in"]}' AS schema
    """,
)
def infer_schema_query(spark, sf_dir):
    return infer_schema(nested_json(spark, sf_dir), "body")


@query(
    "run_status",
    """
    SELECT user_id, bool_and(event_type <> 'view') AS complete,
           coalesce(string_agg(DISTINCT stage, ',' ORDER BY stage) FILTER (event_type = 'error'), '') AS failed
    FROM (SELECT user_id, event_type, 'stage_' || (event_id % 3) AS stage FROM events)
    GROUP BY user_id
    """,
)
def run_status_query(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(
        "user_id",
        F.concat(F.lit("stage_"), F.pmod("event_id", F.lit(3))).alias("stage"),
        F.expr("CASE event_type WHEN 'view' THEN 'queued' WHEN 'error' THEN 'failed' ELSE 'finished' END").alias("status"),
    )
    return run_status(runs, "user_id").withColumn("failed", F.array_join("failed", ","))


@query(
    "collect_text",
    """
    SELECT conv_id, role AS field,
           '[' || string_agg(CAST(to_json(text) AS VARCHAR), ',' ORDER BY turn) || ']' AS value
    FROM conversations GROUP BY conv_id, role
    """,
)
def collect_text_query(spark, sf_dir):
    return collect_text(table(spark, sf_dir, "conversations"), "conv_id", "role", "turn", "text")


@query(
    "resources_to_vars",
    """
    WITH v AS (
      SELECT page_id % 7 AS run, page_id,
             CASE WHEN page_id % 3 = 0 THEN 'latest' ELSE regexp_replace(url, '[^a-zA-Z0-9_]', '_', 'g') END AS name,
             CASE WHEN page_id % 2 = 0 THEN '{"page":' || page_id || '}' ELSE html END AS value
      FROM pages)
    SELECT run, name, arg_max(value, page_id) AS value FROM v GROUP BY run, name
    """,
)
def resources_to_vars_query(spark, sf_dir):
    loaded = table(spark, sf_dir, "pages").select(
        F.pmod("page_id", F.lit(7)).alias("run"),
        "page_id",
        F.col("url").alias("identifier"),
        F.expr("IF(page_id % 3 = 0, 'latest', NULL)").alias("var"),
        F.expr("""IF(page_id % 2 = 0, concat('{"page":', page_id, '}'), NULL)""").alias("structured"),
        F.col("html").alias("content"),
    )
    return resources_to_vars(loaded, "run", "page_id")
