"""Parsing jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.operators.merge import fragment_rejects
from stagewise.operators.parse import (
    normalize_calls,
    normalize_content,
    parse_csv_table,
    parse_json_table,
    parse_kv_table,
    tag_csv,
)
from workload.base import query, table


def mixed_json(spark, sf_dir):
    """Events with a text that is an object, a list, a number, broken, null, or followed by stray text."""
    text = F.expr(
        """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat('[', user_id, ', "', event_type, '"]')
           WHEN 2 THEN cast(event_id AS string) WHEN 3 THEN concat(props, ' x') WHEN 4 THEN 'null'
           ELSE concat('{"a": ', user_id) END"""
    )
    return table(spark, sf_dir, "events").select("event_id", text.alias("body"))


@query(
    "parse_json_table",
    """
    SELECT event_id,
           CASE event_id % 6 WHEN 0 THEN 'object' WHEN 1 THEN 'array' WHEN 4 THEN 'object' END AS kind,
           CASE event_id % 6 WHEN 0 THEN replace(props, ' ', '')
                             WHEN 1 THEN '[' || user_id || ',"' || event_type || '"]' WHEN 4 THEN '{}' END AS json,
           CASE WHEN event_id % 6 IN (2, 3, 5) THEN 'cannot JSON-parse the input' END AS reason
    FROM events
    """,
)
def parse_json_table_query(spark, sf_dir):
    return parse_json_table(mixed_json(spark, sf_dir), "event_id", "body").tagged


@query(
    "parse_csv_table",
    """
    SELECT o_orderkey, CAST(r.row AS INTEGER) AS row,
           CASE r.row WHEN 0 THEN 'key|status|priority' ELSE o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority END
             AS cells, CAST(NULL AS VARCHAR) AS reason
    FROM orders, (VALUES (0), (1)) AS r(row) WHERE o_orderkey % 10 <> 0
    UNION ALL
    SELECT o_orderkey, NULL, NULL, 'wrong number of fields' FROM orders WHERE o_orderkey % 10 = 0
    """,
)
def parse_csv_table_query(spark, sf_dir):
    text = F.expr(
        """concat('key,status,priority\n', o_orderkey, ',', o_orderstatus, ',', o_orderpriority,
           CASE WHEN o_orderkey % 10 = 0 THEN ',extra\n' ELSE '\r\n\n' END)"""
    )
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    docs = orders.select("o_orderkey", text.alias("body"))
    return parse_csv_table(docs, "o_orderkey", "body").tagged.withColumn("cells", F.array_join("cells", "|"))


@query(
    "parse_csv_documents",
    r"""
    WITH masked AS (
      SELECT doc_id,
             regexp_full_match(text, '(?s)(?:"[^"]*(?:""[^"]*)*"|[^",\n]*)(?:[,\n](?:"[^"]*(?:""[^"]*)*"|[^",\n]*))*') AS ok,
             regexp_replace(text, '"[^"]*(?:""[^"]*)*"', 'q', 'g') AS body
      FROM documents),
    lines AS (
      SELECT doc_id, ok, list_filter(string_split(body, chr(10)), lambda x: x <> '') AS rows FROM masked),
    widths AS (
      SELECT doc_id, ok, list_transform(rows, lambda x: len(string_split(x, ','))) AS w FROM lines)
    SELECT doc_id,
           CASE WHEN ok THEN CAST(len(w) AS INTEGER) END AS n_rows,
           CASE WHEN ok THEN CAST(list_sum(w) AS INTEGER) END AS n_cells,
           CASE WHEN NOT ok THEN 'wrong quoting in CSV'
                WHEN len(list_filter(w, lambda x: x <> w[1])) > 0 THEN 'wrong number of fields' END AS error
    FROM widths
    """,
)
def parse_csv_documents_query(spark, sf_dir):
    tagged = tag_csv(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")
    return tagged.select(
        "doc_id",
        F.when(F.col("rows").isNotNull(), F.size("rows")).alias("n_rows"),
        F.when(F.col("rows").isNotNull(), F.size(F.flatten("rows"))).alias("n_cells"),
        F.col("_error").alias("error"),
    )


@query(
    "normalize_content",
    """
    WITH items AS (
      SELECT conv_id, turn,
             CASE role WHEN 'system' THEN '{"role":"system"}' WHEN 'assistant' THEN '[1,"two"]'
                       ELSE CAST(to_json(text) AS VARCHAR) END AS item
      FROM conversations)
    SELECT conv_id,
           CASE WHEN count(*) = 1 AND left(min(item), 1) = '{' THEN min(item)
                WHEN count(*) = 1 THEN '{"result":' || min(item) || '}'
                ELSE '{"result":[' || string_agg(item, ',' ORDER BY turn) || ']}' END AS value
    FROM items GROUP BY conv_id
    """,
)
def normalize_content_query(spark, sf_dir):
    text = F.expr("""CASE role WHEN 'system' THEN '{"role": "system"}' WHEN 'assistant' THEN '[1, "two"]' ELSE text END""")
    items = table(spark, sf_dir, "conversations").withColumn("text", text)
    return normalize_content(items, "conv_id", "turn", "text", wrap=True)


@query(
    "normalize_calls",
    """
    SELECT event_id, 'k' AS arg, replace(json_extract_string(props, '$.k'), ' ', '') AS value
    FROM events WHERE event_id % 3 <> 2
    """,
)
def normalize_calls_query(spark, sf_dir):
    args = F.expr(
        """CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN to_json(cast(props AS variant))
           ELSE concat(props, ',') END"""
    )
    messages = table(spark, sf_dir, "events").select("event_id", args.alias("arguments"))
    return normalize_calls(messages, "event_id", "arguments")


@query(
    "parse_kv_table",
    r"""
    WITH lines AS (
      SELECT doc_id, line, pos
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)),
    tagged AS (SELECT *, regexp_full_match(line, '(?s)[^=]+=[^=]+') AS ok FROM lines)
    SELECT doc_id, split_part(line, '=', 1) AS k, arg_max(split_part(line, '=', 2), pos) AS v, CAST(NULL AS VARCHAR) AS reason
    FROM tagged WHERE ok GROUP BY doc_id, split_part(line, '=', 1)
    UNION ALL
    SELECT doc_id, NULL, NULL, 'invalid parameter format: ' || line FROM tagged WHERE NOT ok
    """,
)
def parse_kv_table_query(spark, sf_dir):
    return parse_kv_table(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text").tagged


@query(
    "fragment_rejects",
    """
    SELECT event_id,
           CASE event_id % 6 WHEN 1 THEN '[' || user_id || ', "' || event_type || '"]' WHEN 2 THEN event_id::VARCHAR
                             WHEN 3 THEN props || ' x' WHEN 4 THEN 'null' ELSE '{"a": ' || user_id END AS body,
           'fragment is not a JSON object' AS error
    FROM events WHERE event_id % 6 <> 0
    """,
)
def fragment_rejects_query(spark, sf_dir):
    """What the merge leaves out of the same texts: everything that is not one whole object."""
    return fragment_rejects(mixed_json(spark, sf_dir), "body").withColumnRenamed("_error", "error")
