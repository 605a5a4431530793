"""Staged extraction and user functions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.functions.registry import FunctionRegistry, call_table_function, map_batches
from stagewise.functions.templates import render_templates
from stagewise.operators.extract import ask_question, extract
from stagewise.operators.merge import merge_fragments
from stagewise.operators.parse import parse_csv_table
from stagewise.operators.prompts import build_prompts
from stagewise.operators.reshape import Rule, cells_to_records, slice_rows
from stagewise.operators.validate import with_violations
from stagewise.plans.calls import Call
from stagewise.plans.schema import load_schema
from stagewise.plans.stages import Dependency, Resource, Stage, gate_stage, iterate_stage, run_stages, split_record
from stagewise.sources.documents import resources_from_table
from workload.base import query, table

# --- flagship -------------------------------------------------------------------------------------------------------

_CARD_SCHEMA = load_schema(
    {
        "type": "object",
        "required": ["title", "note", "author"],
        "properties": {
            "title": {"type": "string", "maxLength": 2000},
            "note": {"type": "string", "minLength": 10},
        },
    }
)


def document_cards(spark, sf_dir):
    """Documents to prompts, echoed into two fields, merged per source, then validated."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "text")
    named = docs.withColumn("identifier", F.concat(F.lit("doc-"), "doc_id"))
    loaded = resources_from_table(named, "identifier", "text", keep=["doc_id", "source", "lang"])
    scoped = loaded.withColumn("body", F.decode("content", "utf-8"))
    rendered = render_templates(scoped, "Describe this {{ .lang }} text: {{ .body }}")
    asked = extract(build_prompts(rendered, "rendered"), "prompt_text", _CARD_SCHEMA)
    merged = merge_fragments(asked.select("source", "doc_id", "answer"), "source", "doc_id", "answer")
    record = F.concat(F.lit('{"'), "field", F.lit('":'), "value", F.lit("}"))
    checked = with_violations(merged.withColumn("record", record), "record", _CARD_SCHEMA, rules=["string_length", "required"])
    return checked.select(
        "source",
        "field",
        F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v").alias("value"),
        F.size("violations").cast("bigint").alias("n_violations"),
    )


@query(
    "document_cards",
    """
    WITH last AS (SELECT source, arg_max(text, doc_id) AS text, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source),
    answers AS (
      SELECT source, f.field, '<Prompt description="The task to execute"><![CDATA[ Describe this ' || lang || ' text: '
             || replace(text, ']]>', ']]]]><![CDATA[>') || ' ]]></Prompt>' AS value
      FROM last, (VALUES ('title'), ('note')) AS f(field))
    SELECT source, field, value,
           CAST(2 + CASE WHEN field = 'title' AND octet_length(encode(value)) > 2000 THEN 1 ELSE 0 END AS BIGINT) AS n_violations
    FROM answers
    """,
)
def document_cards_query(spark, sf_dir):
    return document_cards(spark, sf_dir)


@query(
    "csv_to_answers",
    """
    WITH rows AS (
      SELECT o_orderkey, 1 AS row, o_orderstatus AS word FROM orders
      UNION ALL SELECT o_orderkey, 2, o_orderpriority FROM orders),
    answers AS (
      SELECT o_orderkey, row, '"<Prompt description=\\"The task to execute\\"><![CDATA[ who is ' || word || ' of ' || o_orderkey
             || ' ]]></Prompt>"' AS value FROM rows)
    SELECT o_orderkey, 'answer' AS field, 'scalar' AS kind, row AS seq, 0 AS pos, CAST(NULL AS VARCHAR) AS name, value
    FROM answers WHERE row = 2
    """,
)
def csv_to_answers_query(spark, sf_dir):
    """CSV documents, header dropped, cells named, one question per row, answers merged per document."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    text = F.concat(
        F.lit("word,of\n"), "o_orderstatus", F.lit(","), "o_orderkey", F.lit("\n"), "o_orderpriority", F.lit(","), "o_orderkey"
    )
    rows, _ = parse_csv_table(orders.select("o_orderkey", text.alias("body")), "o_orderkey", "body")
    people = cells_to_records(slice_rows(rows, "o_orderkey", "row", start=1), ["word", "of"], keep=["o_orderkey", "row"])
    asked = render_templates(people, "who is {{ .word }} of {{ .of }}")
    schema = {"type": "object", "properties": {"answer": {"type": "string"}}}
    answered = extract(build_prompts(asked, "rendered"), "prompt_text", schema)
    return merge_fragments(answered, "o_orderkey", "row", "answer")


# --- gates and stages -----------------------------------------------------------------------------------------------


@query(
    "gate_stage",
    """
    SELECT doc_id,
           CASE WHEN quality IS NULL THEN 'failed' WHEN quality = 0 THEN 'unsolvable'
                WHEN n_chars > 1000 AND toxic = 0 THEN 'passed' ELSE 'unsolvable' END AS gate
    FROM documents LEFT JOIN labels USING (doc_id)
    """,
)
def gate_stage_query(spark, sf_dir):
    status = F.expr("CASE WHEN quality IS NULL THEN 'queued' WHEN quality = 0 THEN 'noop' ELSE 'finished' END")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ready = docs.withColumn("status_first", status)
    gated = gate_stage(ready, [Dependency(stage="first", expression="n_chars > 1000"), Dependency(expression="toxic = 0")])
    return gated.select("doc_id", "gate")


_RECORD_SCHEMA = load_schema(
    {
        "type": "object",
        "required": ["kind", "summary", "nothing"],
        "properties": {
            "kind": {"type": "string", "x-session": "classify"},
            "size": {"type": "string", "x-session": "measure"},
            "summary": {"type": "string", "x-session": "summarize"},
            "nothing": {"type": "string", "x-session": "never"},
            "after": {"type": "string", "x-session": "after_never"},
        },
    }
)

_STAGES = [
    Stage("after_never", "unreachable", depends_on=(Dependency(stage="never"),)),
    Stage("summarize", "sum up {{ .params.lang }}: {{ .vars.tone }}", context="kind was {{ .context.kind }}",
          depends_on=(Dependency(stage="classify", expression="length(context.kind) > 0"), Dependency(stage="measure")),
          variables={"tone": "short"}),
    Stage("classify", "classify {{ .doc_id }} from {{ .params.source }}"),
    Stage("measure", "measure {{ .params.text }}", depends_on=(Dependency(expression="quality = 1"),),
          calls=(Call("label_text", "label", {"quality": "$(quality)"}, description="known label"),)),
    Stage("never", "nothing", depends_on=(Dependency(stage="classify", expression="context.missing_yet IS NOT NULL"),)),
]


@query(
    "run_stages",
    """
    WITH base AS (
      SELECT doc_id, lang, source, text, quality,
             '<Prompt description="The task to execute"><![CDATA[ ' AS head, ' ]]></Prompt>' AS tail
      FROM documents LEFT JOIN labels USING (doc_id)),
    step AS (
      SELECT *, head || 'classify ' || doc_id || ' from ' || source || tail AS kind,
             CASE WHEN quality = 1 THEN '<Scope>' || chr(10) || ' <Calls>' || chr(10)
               || '  <CallResult name="label_text" description="known label" contentType="application/json"><![CDATA[ "good" ]]></CallResult>'
               || chr(10) || ' </Calls>' || chr(10) || '</Scope>' || chr(10)
               || head || 'measure ' || replace(text, ']]>', ']]]]><![CDATA[>') || tail END AS size
      FROM base)
    SELECT doc_id, kind, size,
           CASE WHEN size IS NOT NULL THEN '<Scope>' || chr(10) || ' <Context><![CDATA[ kind was '
             || replace(kind, ']]>', ']]]]><![CDATA[>') || ' ]]></Context>' || chr(10) || '</Scope>' || chr(10)
             || head || 'sum up ' || lang || ': short' || tail END AS summary,
           'finished' AS status_classify, CASE WHEN size IS NULL THEN 'noop' ELSE 'finished' END AS status_measure,
           CASE WHEN size IS NULL THEN 'noop' ELSE 'finished' END AS status_summarize,
           'noop' AS status_never, 'noop' AS status_after_never
    FROM step
    """,
)
def run_stages_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    scoped = docs.select("doc_id", "quality", F.struct("lang", "source", "text").alias("params"))
    functions = FunctionRegistry()
    functions.register_columns(
        "label_text", lambda quality: F.when(quality == 1, "good").otherwise("poor"), ["quality"], "string"
    )
    schema = load_schema({**_RECORD_SCHEMA, "properties": {**_RECORD_SCHEMA["properties"], "missing_yet": {"type": "string"}}})
    done = run_stages(scoped, _STAGES, schema, functions=functions)
    statuses = [f"status_{stage.name}" for stage in _STAGES]
    return done.select("doc_id", "context.kind", "context.size", "context.summary", *statuses)


@query(
    "iterate_stage",
    """
    WITH words AS (
      SELECT o_orderkey, 0 AS it_pos, o_orderstatus AS it FROM orders
      UNION ALL SELECT o_orderkey, 1, o_orderpriority FROM orders),
    answers AS (
      SELECT o_orderkey, it_pos, '"<Prompt description=\\"The task to execute\\"><![CDATA[ about ' || it || ' ]]></Prompt>"' AS value
      FROM words)
    SELECT o_orderkey, 'about' AS field, 'scalar' AS kind, 1 AS seq, 0 AS pos, CAST(NULL AS VARCHAR) AS name, value
    FROM answers WHERE it_pos = 1
    """,
)
def iterate_stage_query(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority").withColumn("items", F.array("o_orderstatus", "o_orderpriority"))
    stage = Stage("about", "about {{ .it }}")
    schema = {"type": "object", "properties": {"about": {"type": "string"}}}
    return iterate_stage(orders, "o_orderkey", stage, "items", schema)


def listing_backend():
    """A backend that answers with a list, made once per task."""

    def ask(prompt, _schema):
        return json.dumps({"parts": [prompt.split("CDATA[ ")[1].split(" ]]>")[0]]})

    return ask


@query(
    "iterate_stage_lists",
    """
    SELECT o_orderkey, 'parts' AS field, 'list' AS kind, s.seq, s.pos, CAST(NULL AS VARCHAR) AS name,
           CASE WHEN s.pos >= 0 THEN CASE s.seq WHEN 0 THEN '"item O' || o_orderkey || '"' ELSE '"item P' || o_custkey || '"' END
           END AS value
    FROM orders, (VALUES (0, -1), (0, 0), (1, 0)) AS s(seq, pos)
    """,
)
def iterate_stage_lists_query(spark, sf_dir):
    items = F.array(F.concat(F.lit("O"), "o_orderkey"), F.concat(F.lit("P"), "o_custkey"))
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", items.alias("items"))
    schema = {"type": "object", "properties": {"parts": {"type": "array", "items": {"type": "string"}}}}
    return iterate_stage(orders, "o_orderkey", Stage("parts", "item {{ .it }}"), "items", schema, listing_backend)


@query(
    "extract_echo",
    """
    SELECT doc_id, text AS first, text AS second FROM documents
    """,
)
def extract_echo_query(spark, sf_dir):
    schema = {"type": "object", "properties": {"first": {"type": "string"}, "second": {"type": "string"}}}
    answered = extract(table(spark, sf_dir, "documents"), "text", schema)
    record = F.from_json("answer", "first string, second string")
    return answered.select("doc_id", record["first"].alias("first"), record["second"].alias("second"))


def flaky_backend(most=50_000):
    """A backend that fails on the first question of a prompt and always on French ones.

    Prompts are told apart by their hash. Those to be asked again are kept, which are those of a batch at most; of those answered, the last
    ``most`` at least, and an older one counts as new.
    """
    waiting: set[int] = set()
    answered: list[set[int]] = [set(), set()]

    def ask(prompt, _schema):
        if prompt.startswith("fr"):
            raise TimeoutError("timeout")
        key = hash(prompt)
        if not any(key in known for known in (waiting, *answered)):
            waiting.add(key)
            raise ConnectionError("503")
        waiting.discard(key)
        answered[0].add(key)
        if len(answered[0]) >= most:
            answered[:] = [set(), answered[0]]
        return json.dumps({"words": len(prompt.split(" "))})

    return ask


@query(
    "extract_backend",
    """
    SELECT doc_id, CASE WHEN lang <> 'fr' THEN len(string_split(lang || ' ' || text, ' ')) END AS words,
           CASE WHEN lang = 'fr' THEN 'TimeoutError: timeout' END AS error
    FROM documents
    """,
)
def extract_backend_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("prompt", F.concat("lang", F.lit(" "), "text"))
    schema = {"type": "object", "properties": {"words": {"type": "integer"}}}
    answered = extract(docs.select("doc_id", "prompt"), "prompt", schema, flaky_backend, attempts=3, partitions=8)
    words = F.get_json_object("answer", "$.words").cast("bigint")
    return answered.select("doc_id", words.alias("words"), F.col("_error").alias("error"))


@query("ask_question", "SELECT conv_id, turn, text AS answer FROM conversations")
def ask_question_query(spark, sf_dir):
    return ask_question(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn", "answer")


@query(
    "split_record",
    """
    SELECT 'a' AS stage, c_custkey, c_name AS first, c_mktsegment AS second FROM customer
    UNION ALL SELECT 'b', c_custkey, CAST(c_nationkey AS VARCHAR), NULL FROM customer
    """,
)
def split_record_query(spark, sf_dir):
    schema = load_schema(
        {
            "type": "object",
            "required": ["c_name", "c_nationkey"],
            "properties": {
                "c_name": {"type": "string", "x-session": "a"},
                "c_mktsegment": {"type": "string", "x-session": "a"},
                "c_nationkey": {"type": "integer", "x-session": "b"},
                "c_acctbal": {"type": "number"},
            },
        }
    )
    parts = split_record(table(spark, sf_dir, "customer"), "c_custkey", schema)
    a = parts["a"].select(F.lit("a").alias("stage"), "c_custkey", F.col("c_name").alias("first"), F.col("c_mktsegment").alias("second"))
    b = parts["b"].select(F.lit("b").alias("stage"), "c_custkey", F.col("c_nationkey").cast("string").alias("first"))
    return a.unionByName(b, allowMissingColumns=True)


# --- user functions -------------------------------------------------------------------------------------------------


def vowel_count(texts: pd.Series) -> pd.Series:
    """Vowels per text."""
    return texts.str.count("[aeiou]").astype("int64")


@query(
    "register_function",
    """
    SELECT conv_id, turn, CAST(len(regexp_replace(text, '[^aeiou]', '', 'g')) AS BIGINT) AS vowels,
           CAST(len(regexp_replace(role, '[^aeiou]', '', 'g')) AS BIGINT) AS role_vowels FROM conversations
    """,
)
def register_function_query(spark, sf_dir):
    functions = FunctionRegistry()
    entry = functions.register_function(spark, "vowel_count", vowel_count, {"text": "string"}, "bigint", group="text")
    messages = table(spark, sf_dir, "conversations")
    return messages.select(
        "conv_id", "turn", entry.apply(F.col("text")).alias("vowels"), F.expr("vowel_count(role)").alias("role_vowels")
    )


def _flag_batch(batch: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"page_id": batch["page_id"], "secure": batch["url"].str.startswith("https://")})


@query("map_batches", "SELECT page_id, starts_with(url, 'https://') AS secure FROM pages")
def map_batches_query(spark, sf_dir):
    return map_batches(table(spark, sf_dir, "pages").select("page_id", "url"), _flag_batch, "page_id bigint, secure boolean")


@F.udtf(returnType=T.StructType().add("part_pos", "integer").add("part", "string"))
class UrlParts:
    """Path parts of an address, one row each."""

    def eval(self, url: str):
        for i, part in enumerate(url.split("/")):
            yield i, part


@query(
    "table_function",
    """
    SELECT page_id, CAST(generate_subscripts(string_split(url, '/'), 1) - 1 AS INTEGER) AS part_pos,
           unnest(string_split(url, '/')) AS part FROM pages
    """,
)
def table_function_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return call_table_function(pages, UrlParts, F.col("url")).select("page_id", "part_pos", "part")


# --- plans with iteration and resources -----------------------------------------------------------------------------


def repeating_backend():
    """A backend that fills every field with the task it is given, lists with one item; without a schema it repeats the task."""

    def ask(prompt, schema):
        task = prompt.rsplit("CDATA[ ", 1)[1].split(" ]]>")[0]
        if schema is None:
            return task
        return json.dumps({name: [task] if field["type"] == "array" else task for name, field in schema["properties"].items()})

    return ask


@query(
    "run_plan_iterated",
    """
    WITH base AS (
      SELECT o_orderkey, o_orderstatus AS status, 'first ' || o_orderkey AS a, 'item ' || o_orderstatus || ' at 0' AS b,
             'item ' || o_orderpriority || ' at 1' AS c, o_orderstatus <> 'F' AS goes FROM orders),
    merged AS (SELECT *, CASE WHEN goes THEN a || '|' || b || '|' || c ELSE a END AS parts, CASE WHEN goes THEN c END AS last FROM base)
    SELECT o_orderkey, parts, last,
           CASE WHEN goes THEN last || ' in [' || a || ' ' || b || ' ' || c || ']' END AS report,
           CASE WHEN goes THEN 'finished' ELSE 'noop' END AS status_items,
           CASE WHEN goes THEN 'finished' ELSE 'noop' END AS status_report,
           CASE WHEN goes THEN 3 ELSE 0 END AS n_echoes
    FROM merged
    """,
)
def run_plan_iterated_query(spark, sf_dir):
    """A stage per item in the middle of a plan: its answers append to a list that the first stage began, and feed a later stage."""
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    schema = load_schema(
        {
            "properties": {
                "parts": {"type": "array", "items": {"type": "string"}, "x-session": ["start", "items"]},
                "last": {"type": "string", "x-session": "items"},
                "report": {"type": "string", "x-session": "report"},
            }
        }
    )
    stages = [
        Stage("report", "{{ .context.last }} in {{ .context.parts }}", depends_on=(Dependency("items"),)),
        Stage("echo", "{{ .it }}", depends_on=(Dependency("report"),), iterate_on="context.parts"),
        Stage("items", "item {{ .it }} at {{ .it_pos }}", depends_on=(Dependency("start", "o_orderstatus <> 'F'"),),
              iterate_on="array(o_orderstatus, o_orderpriority)"),
        Stage("start", "first {{ .o_orderkey }}"),
    ]
    done = run_stages(orders, stages, schema, repeating_backend, keys="o_orderkey", in_flight=4)
    return done.select(
        "o_orderkey",
        F.array_join("context.parts", "|").alias("parts"),
        "context.last",
        "context.report",
        "status_items",
        "status_report",
        F.coalesce(F.size("context.echo"), F.lit(0)).alias("n_echoes"),
    )


@query(
    "run_plan_resources",
    """
    WITH lists AS (SELECT n_regionkey, string_agg(n_name, '+' ORDER BY n_nationkey) AS members FROM nation GROUP BY n_regionkey),
    base AS (
      SELECT c_custkey, n_regionkey, c_custkey % 50 = 0 AS lost, 'nation-' || CASE WHEN c_custkey % 50 = 0 THEN 'none' ELSE n_nationkey::VARCHAR END AS id,
             n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, 'of ' || members AS region,
           CASE WHEN NOT lost THEN '=== ' || id || ' ===' || chr(10) || n_name || chr(10) || '===' || chr(10)
             || '<Prompt description="The task to execute"><![CDATA[ tell ' || c_custkey || ' ]]></Prompt>' END AS tale,
           CASE WHEN lost THEN 'failed' ELSE 'finished' END AS status_tale,
           CASE WHEN lost THEN 'resource not found: ' || id END AS error_tale
    FROM base JOIN lists USING (n_regionkey)
    """,
)
def run_plan_resources_query(spark, sf_dir):
    """Two stages with resources: a CSV text that a rule turns into a variable, and a text in front of the prompt, some of them missing."""
    nation = table(spark, sf_dir, "nation")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = customers.select("c_custkey", "n_regionkey", F.when(F.col("c_custkey") % 50 == 0, "none").otherwise(F.col("n_nationkey").cast("string")).alias("place"))
    line = F.concat_ws(",", "n_nationkey", "n_name")
    lists = nation.groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("line")))), lambda r: r["line"]), "\n").alias("text"))
    files = lists.select(F.concat(F.lit("region-"), "n_regionkey", F.lit(".csv")).alias("id"), "text")
    files = files.union(nation.select(F.concat(F.lit("nation-"), "n_nationkey"), "n_name"))
    schema = load_schema({"properties": {"region": {"type": "string", "x-session": "region"}, "tale": {"type": "string", "x-session": "tale"}}})
    stages = [
        Stage("region", "of {{ .vars.members }}", resources=(Resource("region-{{ .n_regionkey }}.csv", "vars", "members"),)),
        Stage("tale", "tell {{ .c_custkey }}", resources=(Resource("nation-{{ .place }}"),)),
    ]
    rules = [Rule("members", on_resource=stages[0].resources[0].identifier, parser="csv", expr="array_join(transform(args, r -> r[1]), '+')")]
    done = run_stages(rows, stages, schema, rules=rules, keys="c_custkey", catalog=resources_from_table(files, "id", "text"))
    region = F.regexp_extract("context.region", r"CDATA\[ (.*) \]\]>", 1)
    return done.select("c_custkey", region.alias("region"), "context.tale", "status_tale", "error_tale")
