"""Validation rules, one query per rule, and the cast and parameter jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.operators.validate import rule_summary, soft_cast, validate, validate_params
from workload.base import query, table


def _object(**fields):
    return {"type": "object", "properties": fields}


@query(
    "not_null",
    """
    SELECT event_id, 'v' AS path, 'not_null' AS rule, 'value is null but schema is not nullable' AS message
    FROM events WHERE event_id % 5 = 0
    """,
)
def not_null_query(spark, sf_dir):
    value = F.expr("IF(event_id % 5 = 0, NULL, value)")
    other = F.expr("IF(event_id % 7 = 0, NULL, user_id)")
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(value.alias("v"), other.alias("w")).alias("rec"))
    schema = _object(v={"type": "number"}, w={"type": "integer", "nullable": True})
    return validate(rows, "event_id", "rec", schema)


def _shapes(spark, sf_dir):
    text = F.expr(
        """CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('["', event_type, '"]')
           WHEN 2 THEN cast(value AS string) WHEN 3 THEN concat('"', event_type, '"') ELSE 'true' END"""
    )
    events = table(spark, sf_dir, "events", "event_id", "event_type", "value", "props")
    return events.select("event_id", text.alias("body"))


@query(
    "any_of",
    """
    SELECT event_id, '' AS path, 'any_of' AS rule, 'value does not match any of the schemas in anyOf' AS message
    FROM events
    WHERE event_id % 5 IN (0, 1) OR (event_id % 5 = 2 AND value > 50)
    """,
)
def any_of_query(spark, sf_dir):
    schema = {"anyOf": [{"type": "number", "maximum": 50}, {"type": "string"}, {"type": "boolean"}]}
    return validate(_shapes(spark, sf_dir), "event_id", "body", schema)


@query(
    "type_is",
    """
    SELECT event_id, '' AS path, 'type_is' AS rule,
           'expected number, got ' || CASE event_id % 5 WHEN 0 THEN 'map' WHEN 1 THEN 'slice' WHEN 3 THEN 'string'
                                                        ELSE 'bool' END AS message
    FROM events WHERE event_id % 5 <> 2
    """,
)
def type_is_query(spark, sf_dir):
    return validate(_shapes(spark, sf_dir), "event_id", "body", {"type": "number"})


@query(
    "required",
    """
    SELECT event_id, '' AS path, 'required' AS rule, 'missing required property: k' AS message
    FROM events WHERE event_id % 3 = 1
    """,
)
def required_query(spark, sf_dir):
    text = F.expr("""CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"x": 1}' ELSE '{"k": null}' END""")
    rows = table(spark, sf_dir, "events").select("event_id", text.alias("body"))
    return validate(rows, "event_id", "body", {"type": "object", "required": ["k"]})


@query(
    "property_count",
    """
    SELECT o_orderkey, '' AS path, 'property_count' AS rule,
           CASE WHEN o_custkey % 5 < 1 THEN 'object has 0 properties, minimum is 1'
                ELSE 'object has ' || (o_custkey % 5) || ' properties, maximum is 3' END AS message
    FROM orders WHERE o_custkey % 5 < 1 OR o_custkey % 5 > 3
    """,
)
def property_count_query(spark, sf_dir):
    entries = F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(4)), lambda i: i < F.pmod("o_custkey", F.lit(5))),
        lambda i: F.concat(F.lit('"p'), i, F.lit('": '), i),
    )
    body = F.concat(F.lit("{"), F.array_join(entries, ", "), F.lit("}"))
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", body.alias("body"))
    return validate(rows, "o_orderkey", "body", {"type": "object", "minProperties": 1, "maxProperties": 3})


@query(
    "properties",
    """
    SELECT o_orderkey, 'order.price' AS path, 'number_range' AS rule,
           'value ' || CASE WHEN floor(o_totalprice) = o_totalprice THEN CAST(CAST(o_totalprice AS BIGINT) AS VARCHAR)
                            ELSE CAST(o_totalprice AS VARCHAR) END || ' is greater than maximum 200000' AS message
    FROM orders WHERE o_totalprice > 200000
    UNION ALL
    SELECT o_orderkey, 'order.status', 'enum', 'value must be one of: [O P]' FROM orders WHERE o_orderstatus = 'F'
    """,
)
def properties_query(spark, sf_dir):
    inner = F.struct(F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.lit(1).alias("extra"))
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus").select("o_orderkey", F.struct(inner.alias("order")).alias("rec"))
    schema = _object(
        order=_object(price={"type": "number", "maximum": 200000}, status={"type": "string", "enum": ["O", "P"]})
    )
    return validate(rows, "o_orderkey", "rec", schema)


@query(
    "item_count",
    """
    SELECT event_id, 'tags' AS path, 'item_count' AS rule,
           'array has ' || (event_id % 6) || ' items, '
             || CASE WHEN event_id % 6 < 2 THEN 'minimum is 2' ELSE 'maximum is 4' END AS message
    FROM events WHERE event_id % 6 < 2 OR event_id % 6 > 4
    """,
)
def item_count_query(spark, sf_dir):
    tags = F.expr("filter(sequence(0, 5), i -> i < event_id % 6)")
    rows = table(spark, sf_dir, "events").select("event_id", F.struct(tags.alias("tags")).alias("rec"))
    return validate(rows, "event_id", "rec", _object(tags={"type": "array", "minItems": 2, "maxItems": 4}))


@query(
    "items",
    """
    SELECT vec_id, 'embedding[' || i || ']' AS path, 'number_range' AS rule,
           'value ' || CAST(x AS DOUBLE)::VARCHAR || ' is greater than maximum 0.1' AS message FROM (
      SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
    WHERE CAST(x AS DOUBLE) > 0.1
    """,
)
def items_query(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.struct("embedding").alias("rec"))
    schema = _object(embedding={"type": "array", "items": {"type": "number", "maximum": 0.1}})
    return validate(rows, "vec_id", "rec", schema)


_DOCUMENTS = {
    "string_length": {"text": {"type": "string", "minLength": 200, "maxLength": 5000}},
    "pattern": {"text": {"type": "string", "pattern": "[0-9]{3}"}},
    "enum": {"lang": {"type": "string", "enum": ["en", "fr"]}, "n_chars": {"type": "integer", "enum": ["x"]}},
}


def _documents(spark, sf_dir, rule):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.struct("text", "lang", "n_chars").alias("rec"))
    return validate(docs, "doc_id", "rec", _object(**_DOCUMENTS[rule]))


@query(
    "string_length",
    """
    SELECT doc_id, 'text' AS path, 'string_length' AS rule,
           'string length is ' || n || CASE WHEN n < 200 THEN ', minimum is 200' ELSE ', maximum is 5000' END AS message
    FROM (SELECT doc_id, octet_length(encode(text)) AS n FROM documents) WHERE n < 200 OR n > 5000
    """,
)
def string_length_query(spark, sf_dir):
    return _documents(spark, sf_dir, "string_length")


@query(
    "pattern",
    """
    SELECT doc_id, 'text' AS path, 'pattern' AS rule, 'string does not match pattern: [0-9]{3}' AS message
    FROM documents WHERE NOT regexp_matches(text, '[0-9]{3}')
    """,
)
def pattern_query(spark, sf_dir):
    return _documents(spark, sf_dir, "pattern")


@query(
    "enum",
    """
    SELECT doc_id, 'lang' AS path, 'enum' AS rule, 'value must be one of: [en fr]' AS message
    FROM documents WHERE lang NOT IN ('en', 'fr')
    """,
)
def enum_query(spark, sf_dir):
    return _documents(spark, sf_dir, "enum")


@query(
    "number_range",
    """
    SELECT p_partkey, 'size' AS path, 'number_range' AS rule,
           'value ' || p_size || CASE WHEN p_size < 10 THEN ' is less than minimum 10' ELSE ' is greater than maximum 40' END
             AS message
    FROM part WHERE p_size < 10 OR p_size > 40
    """,
)
def number_range_query(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_size").alias("size")).alias("rec"))
    return validate(rows, "p_partkey", "rec", _object(size={"type": "number", "minimum": 10, "maximum": 40}))


@query(
    "is_integer",
    """
    SELECT p_partkey, 'price' AS path, 'is_integer' AS rule, 'expected integer, got float' AS message
    FROM part WHERE p_retailprice <> floor(p_retailprice)
    """,
)
def is_integer_query(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.struct(F.col("p_retailprice").alias("price")).alias("rec"))
    return validate(rows, "p_partkey", "rec", _object(price={"type": "integer"}))


_LOOSE = """CASE event_id % 5 WHEN 0 THEN concat('{"n": "', value, '", "b": "T"}')
    WHEN 1 THEN concat('{"n": " ', user_id, '", "b": "yes"}') WHEN 2 THEN concat('{"n": ', value, ', "b": true}')
    WHEN 3 THEN '{"n": "12d", "b": "False"}' ELSE '{"n": "1e2", "b": 0}' END"""
_LOOSE_SCHEMA = _object(n={"type": "number", "maximum": 50}, b={"type": "boolean"})


def _loose(spark, sf_dir):
    events = table(spark, sf_dir, "events", "event_id", "user_id", "value")
    return events.select("event_id", F.expr(_LOOSE).alias("body"))


@query(
    "boolean_and_soft_mode",
    """
    SELECT event_id, 'n' AS path, 'number_range' AS rule, 'value ' || CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ' is greater than maximum 50' AS message
    FROM events WHERE event_id % 5 IN (0, 2) AND value > 50
    UNION ALL SELECT event_id, 'n', 'number_range', 'value 100 is greater than maximum 50' FROM events WHERE event_id % 5 = 4
    UNION ALL SELECT event_id, 'n', 'type_is', 'expected number, got string' FROM events WHERE event_id % 5 IN (1, 3)
    UNION ALL SELECT event_id, 'b', 'type_is', 'expected boolean, got ' || CASE event_id % 5 WHEN 1 THEN 'string' ELSE 'float64' END
    FROM events WHERE event_id % 5 IN (1, 4)
    """,
)
def boolean_and_soft_mode_query(spark, sf_dir):
    rows = _loose(spark, sf_dir)
    return validate(rows, "event_id", "body", _LOOSE_SCHEMA, soft=True)


@query(
    "violation_summary",
    """
    SELECT 'number_range' AS rule, count(*) AS n FROM events WHERE event_id % 5 = 2 AND value > 50
    UNION ALL SELECT 'type_is', sum(CASE event_id % 5 WHEN 2 THEN 0 ELSE 2 END)::BIGINT FROM events
    """,
)
def violation_summary_query(spark, sf_dir):
    rows = _loose(spark, sf_dir)
    return rule_summary(validate(rows, "event_id", "body", _LOOSE_SCHEMA))


@query(
    "first_violation",
    """
    SELECT event_id, CASE WHEN event_id % 5 = 2 THEN 'n' ELSE 'b' END AS path,
           CASE WHEN event_id % 5 = 2 THEN 'number_range' ELSE 'type_is' END AS rule,
           CASE event_id % 5 WHEN 2 THEN 'value ' || CASE WHEN value = floor(value) THEN value::BIGINT::VARCHAR ELSE value::VARCHAR END || ' is greater than maximum 50'
                             WHEN 4 THEN 'expected boolean, got float64' ELSE 'expected boolean, got string' END AS message
    FROM events WHERE event_id % 5 <> 2 OR value > 50
    """,
)
def first_violation_query(spark, sf_dir):
    rows = _loose(spark, sf_dir)
    return validate(rows, "event_id", "body", _LOOSE_SCHEMA, first_only=True)


_CELLS = {
    "amount": "CASE event_id % 4 WHEN 0 THEN cast(value AS string) WHEN 1 THEN concat(' ', user_id) "
    "WHEN 2 THEN '.5' ELSE '+7' END",
    "count": "CASE event_id % 3 WHEN 0 THEN cast(user_id AS string) WHEN 1 THEN '3.0' ELSE '3.5' END",
    "flag": "CASE event_id % 3 WHEN 0 THEN 'TRUE' WHEN 1 THEN 'f' ELSE 'no' END",
}
_CELL_SCHEMA = _object(amount={"type": "number"}, count={"type": "integer"}, flag={"type": "boolean"})


def _text_cells(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", *[F.expr(sql).alias(name) for name, sql in _CELLS.items()])


@query(
    "soft_cast",
    """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 2 THEN 0.5 WHEN 3 THEN 7.0 END AS amount,
           CAST(CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN 3 END AS BIGINT) AS count,
           CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS flag
    FROM events
    """,
)
def soft_cast_query(spark, sf_dir):
    return soft_cast(_text_cells(spark, sf_dir), "event_id", _CELL_SCHEMA)[0]


@query(
    "soft_cast_rejects",
    """
    SELECT event_id, 'amount' AS field, ' ' || user_id AS text FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT event_id, 'count', '3.5' FROM events WHERE event_id % 3 = 2
    UNION ALL SELECT event_id, 'flag', 'no' FROM events WHERE event_id % 3 = 2
    """,
)
def soft_cast_rejects_query(spark, sf_dir):
    return soft_cast(_text_cells(spark, sf_dir), "event_id", _CELL_SCHEMA)[1]


@query(
    "validate_params",
    """
    SELECT c_custkey, 'balance' AS path, 'number_range' AS rule, 'value ' || CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT::VARCHAR ELSE c_acctbal::VARCHAR END || ' is less than minimum 0' AS message
    FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT c_custkey, '', 'required', 'missing required property: nation' FROM customer WHERE c_nationkey % 4 = 0
    UNION ALL SELECT c_custkey, 'segment', 'enum', 'value must be one of: [AUTOMOBILE BUILDING FURNITURE HOUSEHOLD]'
    FROM customer WHERE c_mktsegment = 'MACHINERY'
    """,
)
def validate_params_query(spark, sf_dir):
    params = F.map_filter(
        F.create_map(
            F.lit("balance"),
            F.col("c_acctbal").cast("string"),
            F.lit("segment"),
            F.col("c_mktsegment"),
            F.lit("nation"),
            F.expr("IF(c_nationkey % 4 = 0, NULL, cast(c_nationkey AS string))"),
        ),
        lambda _, value: value.isNotNull(),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", params.alias("params"))
    declared = {
        "balance": {"type": "number", "minimum": 0},
        "segment": {"type": "string", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD"]},
        "nation": {"type": "integer"},
    }
    return validate_params(rows, "c_custkey", "params", declared)


@query(
    "validate_recursive",
    """
    WITH t AS (SELECT p_partkey, p_size % 13 AS depth, p_retailprice AS price FROM part)
    SELECT p_partkey, repeat('parts[1].', depth::INTEGER) || 'price' AS path, 'number_range' AS rule,
           'value ' || CASE WHEN price = floor(price) THEN price::BIGINT::VARCHAR ELSE price::VARCHAR END || ' is greater than maximum 1200' AS message
    FROM t WHERE price > 1200
    UNION ALL
    SELECT p_partkey, repeat('parts[1].', depth::INTEGER - 1) || 'parts[0]', 'required', 'missing required property: price' FROM t WHERE depth > 0
    """,
)
def validate_recursive_query(spark, sf_dir):
    """Parts within parts, up to twelve levels deep, by a schema that refers to itself."""
    parts = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice")
    depth = F.pmod("p_size", F.lit(13))
    inner = F.concat(F.lit('{"price": '), "p_retailprice", F.lit("}"))
    last = F.when(depth > 0, F.concat(F.lit('{"price": 1, "parts": [{}, '), inner, F.lit("]}"))).otherwise(inner)
    outer = F.repeat(F.lit('{"price": 1, "parts": [{"price": 2}, '), F.greatest(depth - 1, F.lit(0)).cast("int"))
    text = F.concat(outer, last, F.repeat(F.lit("]}"), F.greatest(depth - 1, F.lit(0)).cast("int")))
    tree = {"type": "object", "required": ["price"], "properties": {"price": {"type": "number", "maximum": 1200}, "parts": {"type": "array", "items": {"$ref": "#/components/schemas/piece"}}}}
    return validate(parts.select("p_partkey", text.alias("body")), "p_partkey", "body", {"$ref": "#/components/schemas/piece"}, components={"piece": tree})
