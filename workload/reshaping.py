"""Projection, filtering, expansion and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.functions.templates import render_column, render_templates, scope_map
from stagewise.operators.parse import parse_csv_table
from stagewise.operators.reshape import (
    Rule,
    apply_transformers,
    cells_to_records,
    chunk_array,
    chunk_rows,
    gate,
    iterate,
    overlay_vars,
    reshape,
    reshape_list,
    slice_rows,
    unique_rows,
)
from workload.base import query, table


@query(
    "reshape",
    """
    SELECT c_custkey, split_part(c_name, '#', 1) AS first_name, c_mktsegment || '/' || c_nationkey AS address,
           c_acctbal > 0 AS solvent
    FROM customer
    """,
)
def reshape_query(spark, sf_dir):
    fields = {
        "first_name": "split_part(c_name, '#', 1)",
        "address": "concat(c_mktsegment, '/', c_nationkey)",
        "solvent": "c_acctbal > 0",
    }
    return reshape(table(spark, sf_dir, "customer"), fields, keep="c_custkey")


@query(
    "reshape_list",
    """
    SELECT o_orderkey, '[{"status":"' || o_orderstatus || '","twice":' || (2 * o_custkey) || '}]' AS parts FROM orders
    """,
)
def reshape_list_query(spark, sf_dir):
    entry = F.struct("o_orderstatus", "o_custkey", "o_totalprice")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.array(entry).alias("parts"))
    shaped = reshape_list(rows, "parts", {"status": "item.o_orderstatus", "twice": "2 * item.o_custkey"})
    return shaped.withColumn("parts", F.to_json("parts"))


@query(
    "slice_rows",
    """
    SELECT l_orderkey, l_linenumber, l_quantity FROM (
      SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
    WHERE l_linenumber - 1 BETWEEN 1 AND n - 2
    """,
)
def slice_rows_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    sliced = slice_rows(lines.withColumn("pos", F.col("l_linenumber") - 1), "l_orderkey", "pos", 1, -1)
    return sliced.drop("pos")


@query(
    "cells_to_records",
    """
    SELECT CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS customer,
           CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment, CAST(NULL AS VARCHAR) AS note,
           CASE WHEN c_custkey % 9 = 0 THEN c_custkey END AS rejected, CASE WHEN c_custkey % 9 = 0 THEN 'wrong number of fields' END AS reason
    FROM customer
    """,
)
def cells_to_records_query(spark, sf_dir):
    more = F.when(F.col("c_custkey") % 9 == 0, ",more").otherwise("")
    text = F.concat(F.lit("id,segment\n"), "c_custkey", F.lit(","), "c_mktsegment", more)
    docs = table(spark, sf_dir, "customer").select("c_custkey", text.alias("body"))
    good, rejects = parse_csv_table(docs, "c_custkey", "body")
    records = cells_to_records(slice_rows(good, "c_custkey", "row", start=1), ["customer", "segment", "note"])
    return records.unionByName(rejects.withColumnRenamed("c_custkey", "rejected"), allowMissingColumns=True)


@query(
    "apply_transformers",
    """
    SELECT event_id,
           CASE event_type WHEN 'click' THEN '{"double":' || 2 * CAST(json_extract_string(props, '$.k') AS INTEGER) || '}'
                           WHEN 'view' THEN '[{"type":"view","user":"' || user_id || '"}]'
                           WHEN 'error' THEN 'ERROR ' || event_id
                           ELSE props END AS content,
           event_type IN ('click', 'view') AS structured
    FROM events
    """,
)
def apply_transformers_query(spark, sf_dir):
    content = F.expr(
        """CASE event_type WHEN 'view' THEN concat(event_type, ',', user_id)
           WHEN 'error' THEN concat('error ', event_id) ELSE props END"""
    )
    events = table(spark, sf_dir, "events", "event_id", "event_type", "user_id", "props")
    docs = events.select("event_id", "event_type", content.alias("content"))
    rules = [
        Rule("pick", on_resource="click", parser="json", path="variant_get(args, '$.k', 'int')"),
        Rule("wrap", on_resource="click", expr="named_struct('double', 2 * args)"),
        Rule(
            "rows",
            on_resource="view",
            parser="csv",
            expr="transform(args, r -> named_struct('type', r[0], 'user', r[1]))",
        ),
        Rule("shout", on_resource="error", callback=F.upper),
    ]
    return apply_transformers(docs, rules, "event_type", "content").select("event_id", "content", "structured")


@query(
    "gate",
    """
    SELECT doc_id, lang FROM documents WHERE len(string_split(text, ' ')) > 100 AND lang IN ('en', 'fr')
    """,
)
def gate_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = gate(docs, "size(split(text, ' ', -1)) > 100 AND array_contains(array('en', 'fr'), lang)")
    return held.select("doc_id", "lang")


@query(
    "iterate",
    """
    SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS it_pos, CAST(unnest(embedding) AS DOUBLE) AS it
    FROM embeddings
    """,
)
def iterate_query(spark, sf_dir):
    items = iterate(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding")
    return items.select("vec_id", "it_pos", F.col("it").cast("double").alias("it"))


@query(
    "render_templates",
    """
    SELECT doc_id,
           'Document ' || doc_id || ' (' || lang || ') of ' || source || ', first word '
             || string_split(text, ' ')[1] || ', label ' || coalesce(CAST(quality AS VARCHAR), '<no value>')
             || ', meta {' || chr(10) || ' "lang": "' || lang || '",' || chr(10) || ' "n": ' || n_chars || chr(10) || '}: ' || text
             AS rendered
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def render_templates_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    scoped = docs.select(
        "doc_id",
        F.struct("lang", "source", "text", F.struct("lang", F.col("n_chars").alias("n")).alias("meta")).alias("it"),
        F.struct(F.split("text", " ").alias("words"), "quality").alias("vars"),
    )
    template = (
        "Document {{ .doc_id }} ({{.it.lang}}) of {{ .it.source }}, first word {{ index .vars.words 0 }},"
        " label {{ .vars.quality }}, meta {{ .it.meta | json }}: {{ .it.text }}"
    )
    return render_templates(scoped, template).select("doc_id", "rendered")


@query(
    "render_data_templates",
    """
    SELECT o_orderkey,
           CASE WHEN o_orderkey % 2 = 0 THEN 'order ' || o_orderkey || ' is <' || o_orderstatus || '> ' || '<no value>'
                ELSE 'plain ' || o_orderpriority END AS rendered
    FROM orders
    """,
)
def render_data_templates_query(spark, sf_dir):
    template = F.expr(
        """CASE WHEN o_orderkey % 2 = 0 THEN 'order {{ .o_orderkey }} is {{ .mark }} {{ .absent }}'
           ELSE 'plain {{.o_orderpriority}}' END"""
    )
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").withColumn("mark", F.lit("<{{ .o_orderstatus }}>"))
    scope = scope_map(orders.schema, ["o_orderkey", "mark", "o_orderstatus", "o_orderpriority"])
    return orders.select("o_orderkey", render_column(template, scope).alias("rendered"))


@query(
    "unique_rows",
    """
    SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderpriority
    """,
)
def unique_rows_query(spark, sf_dir):
    return unique_rows(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


@query(
    "chunk_rows",
    """
    SELECT l_suppkey, line, CAST((rn - 1) // 7 AS BIGINT) AS chunk, CAST((rn - 1) % 7 AS BIGINT) AS chunk_pos FROM (
      SELECT l_suppkey, l_orderkey * 16 + l_linenumber AS line,
             row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 16 + l_linenumber) AS rn
      FROM lineitem)
    """,
)
def chunk_rows_query(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", (F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("line")
    )
    return chunk_rows(lines, "l_suppkey", "line", 7)


@query(
    "chunk_array",
    """
    SELECT vec_id, CAST(c AS INTEGER) AS chunk,
           array_to_string(list_transform(embedding[c * 10 + 1:c * 10 + 10], lambda x: floor(x::DOUBLE * 16777216)::BIGINT), ',') AS part
    FROM embeddings, (SELECT unnest(range(7)) AS c)
    """,
)
def chunk_array_query(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    chunks = vectors.select("vec_id", F.posexplode(chunk_array(F.col("embedding"), 10)).alias("chunk", "part"))
    whole = F.transform("part", lambda x: F.floor(x.cast("double") * 16777216).cast("string"))
    return chunks.select("vec_id", "chunk", F.array_join(whole, ",").alias("part"))


@query(
    "overlay_vars",
    """
    SELECT c.c_custkey, v.name,
           CASE v.name WHEN 'greeting' THEN coalesce('dear ' || o.prio, 'hello') WHEN 'segment' THEN c.c_mktsegment
                       ELSE o.prio END AS value
    FROM customer c LEFT JOIN (SELECT o_custkey, max(o_orderpriority) AS prio FROM orders GROUP BY 1) o
      ON c.c_custkey = o.o_custkey, (VALUES ('greeting'), ('segment'), ('priority')) AS v(name)
    WHERE v.name <> 'priority' OR o.prio IS NOT NULL
    """,
)
def overlay_vars_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max("o_orderpriority").alias("prio")
    )

    def level(df, entries):
        pairs = [F.struct(F.lit(name).alias("name"), F.expr(sql).alias("value")) for name, sql in entries.items()]
        return df.select("c_custkey", F.inline(F.array(*pairs)))

    levels = [
        level(customers, {"greeting": "'hello'", "segment": "'none'"}),
        level(customers, {"segment": "c_mktsegment"}),
        level(orders, {"greeting": "concat('dear ', prio)", "priority": "prio"}),
    ]
    return overlay_vars(levels, "c_custkey")
