"""Joins and lookups by name."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.functions.registry import FunctionRegistry
from stagewise.functions.templates import scope_map
from stagewise.operators.lookup import (
    attach_resources,
    expand_groups,
    in_group,
    missing_required,
    route_resources,
    upsert_by_key,
)
from stagewise.operators.reshape import Rule
from stagewise.plans.calls import Call, call_functions
from stagewise.sources.documents import resources_from_table
from workload.base import query, table

_ATTACHED = """
    WITH asked AS (
      SELECT o_orderkey, 0 AS req_pos, 'doc-' || (o_orderkey % 1200) AS identifier, 'ai' AS dest, o_orderstatus FROM orders
      UNION ALL
      SELECT o_orderkey, 1, 'doc-' || o_custkey,
             CASE o_orderkey % 3 WHEN 0 THEN 'vars' WHEN 1 THEN 'prePrompt' ELSE 'prompt' END, o_orderstatus FROM orders)
    """


def _attached(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), "text")
    requests = F.expr(
        """array(
             named_struct('identifier', 'doc-{{ .pick }}', 'dest', cast(null AS string), 'var', cast(null AS string)),
             named_struct('identifier', 'doc-{{ .o_custkey }}', 'dest',
               CASE o_orderkey % 3 WHEN 0 THEN 'vars' WHEN 1 THEN 'prePrompt' ELSE 'prompt' END, 'var', 'doc'))"""
    )
    stages = orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.pmod("o_orderkey", F.lit(1200)).alias("pick"), requests.alias("requests")
    )
    scope = scope_map(stages.schema, ["pick", "o_custkey"])
    return attach_resources(stages, resources_from_table(docs, "name", "text"), scope=scope)


@query(
    "attach_resources",
    _ATTACHED
    + """
    SELECT a.o_orderkey, CAST(a.req_pos AS INTEGER) AS req_pos, a.identifier, a.dest,
           md5(d.text) AS digest,
           CASE WHEN d.doc_id IS NULL THEN 'resource not found: ' || a.identifier END AS error
    FROM asked a LEFT JOIN documents d ON a.identifier = 'doc-' || d.doc_id
    """,
)
def attach_resources_query(spark, sf_dir):
    return _attached(spark, sf_dir).select(
        "o_orderkey", "req_pos", "identifier", "dest", F.md5("content").alias("digest"), F.col("_error").alias("error")
    )


@query(
    "route_resources",
    _ATTACHED
    + """
    SELECT o_orderkey, CAST(req_pos AS INTEGER) AS req_pos,
           CASE WHEN dest <> 'ai' THEN dest WHEN o_orderstatus = 'O' THEN 'prePrompt' ELSE 'prompt' END AS target
    FROM asked
    """,
)
def route_resources_query(spark, sf_dir):
    attached = _attached(spark, sf_dir).withColumn("has_pre", F.col("o_orderstatus") == "O")
    return route_resources(attached, "has_pre").select("o_orderkey", "req_pos", "target")


@query(
    "missing_required",
    """
    SELECT DISTINCT c.c_name AS name, c.c_mktsegment AS type FROM customer c
    WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')
    """,
)
def missing_required_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    required = customers.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"))
    pending = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    available = customers.join(pending, "c_custkey", "left_semi").select(
        F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type")
    )
    return missing_required(required, available)


def _catalog(spark, sf_dir):
    """Suppliers as functions, their nation as the collection."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, "s_nationkey")
        .select(
            F.col("s_name").alias("name"),
            F.col("n_name").alias("collection"),
            F.concat(F.lit("balance "), F.floor("s_acctbal")).alias("description"),
            F.lit("{}").alias("schema"),
        )
    )


_CATALOG = """
    WITH catalog AS (
      SELECT s_name AS name, n_name AS collection, 'balance ' || CAST(floor(s_acctbal) AS BIGINT) AS description,
             '{}' AS schema
      FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    """


@query(
    "expand_groups",
    _CATALOG
    + """
    SELECT n_nationkey AS req_id, c.name, c.description, c.schema
    FROM nation JOIN catalog c ON c.collection = n_name
    WHERE n_nationkey % 2 = 0 OR c.name IN ('Supplier#000000001', 'Supplier#000000003')
    UNION ALL
    SELECT 1000 + s_suppkey, c.name, CASE WHEN s_suppkey % 2 = 0 THEN 'own' ELSE c.description END,
           CASE WHEN s_suppkey % 2 = 0 THEN '[]' ELSE c.schema END
    FROM supplier JOIN catalog c ON c.name = s_name
    """,
)
def expand_groups_query(spark, sf_dir):
    groups = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("req_id"),
        F.lit("collection").alias("kind"),
        F.col("n_name").alias("name"),
        F.lit(None).cast("string").alias("description"),
        F.lit(None).cast("string").alias("schema"),
        F.expr("IF(n_nationkey % 2 = 0, NULL, array('Supplier#000000001', 'Supplier#000000003'))").alias("allowlist"),
    )
    single = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + 1000).alias("req_id"),
        F.lit("function").alias("kind"),
        F.col("s_name").alias("name"),
        F.expr("IF(s_suppkey % 2 = 0, 'own', '')").alias("description"),
        F.expr("IF(s_suppkey % 2 = 0, '[]', NULL)").alias("schema"),
        F.lit(None).cast("array<string>").alias("allowlist"),
    )
    return expand_groups(groups.unionByName(single), _catalog(spark, sf_dir))


@query(
    "upsert_by_key",
    _CATALOG
    + """
    , merged AS (
      SELECT c.name, c.collection, CASE WHEN s_acctbal < 0 THEN 'overdrawn' ELSE c.description END AS description, c.schema
      FROM catalog c JOIN supplier ON s_name = c.name
      UNION ALL
      SELECT 'extra-' || n_nationkey, n_name, 'added', '{}' FROM nation)
    SELECT * FROM merged
    """,
)
def upsert_by_key_query(spark, sf_dir):
    base = _catalog(spark, sf_dir)
    nations = table(spark, sf_dir, "nation")
    changed = base.join(
        table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_name").alias("name")), "name", "left_semi"
    ).withColumn("description", F.lit("overdrawn"))
    added = nations.select(
        F.concat(F.lit("extra-"), "n_nationkey").alias("name"),
        F.col("n_name").alias("collection"),
        F.lit("added").alias("description"),
        F.lit("{}").alias("schema"),
    )
    return upsert_by_key(base, changed.unionByName(added), "name")


@query(
    "call_functions",
    """
    SELECT o_orderkey, c_name AS customer, 'order ' || o_orderkey || ' of ' || c_name AS title,
           '{"segment":"' || c_mktsegment || '"}' AS prompt_result, o_totalprice * 2 AS doubled
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    """,
)
def call_functions_query(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    functions = FunctionRegistry()
    functions.register_table("customer_name", customers, "c_custkey", "c_name")
    functions.register_table("customer_segment", customers, "c_name", "c_mktsegment")
    functions.register_columns("title", lambda text: text, ["text"], "string")
    functions.register_columns("times", lambda price, by: price * by, ["price", "by"], "double")
    calls = [
        Call("customer_name", "customer", {"id": "$(o_custkey)"}, into="vars"),
        Call("title", "title", {"text": "order {{ .o_orderkey }} of {{ .vars.customer }}"}, into="vars"),
        Call("customer_segment", "segment", {"c_name": "$(vars.customer)"}),
        Call("times", "doubled", {"price": "$((o_totalprice))", "by": 2}, into="context"),
    ]
    rules = [
        Rule("rename", on_input="customer_name", expr="named_struct('c_custkey', args.id)"),
        Rule("wrap", on_output="customer_segment", expr="named_struct('segment', args)"),
    ]
    done, outputs = call_functions(table(spark, sf_dir, "orders"), calls, functions, rules)
    return done.select(
        "o_orderkey",
        F.col("vars.customer").alias("customer"),
        F.col("vars.title").alias("title"),
        outputs[0].result.alias("prompt_result"),
        F.col("context.doubled").alias("doubled"),
    )
