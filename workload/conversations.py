"""Conversations and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.operators.conversation import (
    assemble_history,
    attach_once,
    classify_answers,
    has_tool_calls,
    history_lists,
    join_parts,
    last_message,
    loop_guard,
    tool_calls,
)
from stagewise.operators.prompts import CallOutput, build_prompts, document_blocks, expand_preprompts, wrap_documents
from workload.base import query, table

_SYSTEM = "Answer in JSON."


@query(
    "assemble_history",
    """
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'system', 'Answer in JSON.' FROM conversations
    """,
)
def assemble_history_query(spark, sf_dir):
    return assemble_history(table(spark, sf_dir, "conversations"), "conv_id", system=_SYSTEM)


@query(
    "history_lists",
    """
    WITH h AS (
      SELECT conv_id, turn, role, text FROM conversations
      UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT), 'system', 'Answer in JSON.' FROM conversations)
    SELECT conv_id,
           '[' || string_agg('{"role":"' || role || '","text":' || CAST(to_json(text) AS VARCHAR) || '}', ',' ORDER BY turn)
             || ']' AS messages
    FROM h GROUP BY conv_id
    """,
)
def history_lists_query(spark, sf_dir):
    history = assemble_history(table(spark, sf_dir, "conversations"), "conv_id", system=_SYSTEM)
    return history_lists(history, "conv_id")


@query("last_message", "SELECT conv_id, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id")
def last_message_query(spark, sf_dir):
    return last_message(table(spark, sf_dir, "conversations"), "conv_id")


@query(
    "join_parts",
    """
    SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id
    """,
)
def join_parts_query(spark, sf_dir):
    return join_parts(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("tool_calls", "SELECT conv_id, turn, text FROM conversations WHERE role = 'system'")
def tool_calls_query(spark, sf_dir):
    return tool_calls(table(spark, sf_dir, "conversations"), "system").select("conv_id", "turn", "text")


@query("has_tool_calls", "SELECT conv_id, bool_or(role = 'system') AS has_calls FROM conversations GROUP BY conv_id")
def has_tool_calls_query(spark, sf_dir):
    return has_tool_calls(table(spark, sf_dir, "conversations"), "conv_id", "system")


@query(
    "loop_guard",
    """
    SELECT conv_id, count(*) FILTER (role = 'assistant') AS model_turns,
           count(*) FILTER (role = 'assistant') >= 3 AS looping
    FROM conversations GROUP BY conv_id
    """,
)
def loop_guard_query(spark, sf_dir):
    return loop_guard(table(spark, sf_dir, "conversations"), "conv_id", limit=3)


@query(
    "attach_once",
    """
    SELECT conv_id, turn, turn = min(turn) OVER (PARTITION BY conv_id) AS with_documents
    FROM conversations
    """,
)
def attach_once_query(spark, sf_dir):
    return attach_once(table(spark, sf_dir, "conversations"), "conv_id").select("conv_id", "turn", "with_documents")


@query(
    "build_prompts",
    """
    SELECT doc_id,
           '<Scope>' || chr(10) || ' <Context contentType="application/json"><![CDATA[ {"lang":"' || lang || '"} ]]></Context>'
             || chr(10) || ' <Calls>' || chr(10)
             || '  <CallResult name="size &lt;of&gt; ' || source || '" description="chars &amp; more" contentType="application/json">'
             || '<![CDATA[ ' || n_chars || ' ]]></CallResult>' || chr(10) || ' </Calls>' || chr(10) || '</Scope>' || chr(10)
             || '<Prompt description="The task to execute"><![CDATA[ ' || replace(text, ']]>', ']]]]><![CDATA[>')
             || ' ]]></Prompt>' AS prompt_text
    FROM documents
    """,
)
def build_prompts_query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("context", F.to_json(F.struct("lang")))
    call = CallOutput(F.concat(F.lit("size <of> "), "source"), F.col("n_chars").cast("string"), "chars & more")
    return build_prompts(docs, "text", "context", calls=[call]).select("doc_id", "prompt_text")


_BANNER = "'=== ' || lang || '/' || doc_id || ' ===' || chr(10) || text || chr(10) || '===' || chr(10)"
_ELEMENT = """'<Document name="' || lang || '/' || doc_id || '"><![CDATA[ ' || replace(text, ']]>', ']]]]><![CDATA[>') || ' ]]></Document>' || chr(10)"""


def _named(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("name", F.concat("lang", F.lit("/"), "doc_id"))


@query(
    "document_blocks",
    f"""
    WITH b AS (SELECT source, doc_id, {_BANNER} AS text FROM documents)
    SELECT source, row_number() OVER w - 1 AS block, (coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", text
    FROM b WINDOW w AS (PARTITION BY source ORDER BY doc_id)
    """,
)
def document_blocks_query(spark, sf_dir):
    """All documents of a source, which may be most of the table, as blocks with their places."""
    return document_blocks(_named(spark, sf_dir), "source", "doc_id", "name", "text", "banner")


def _wrapped(spark, sf_dir, style):
    """Documents that a turn of a conversation refers to: a few, by conversation and turn."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    asked = _named(spark, sf_dir).join(turns, F.col("doc_id") == F.col("conv_id") + F.col("turn"))
    return wrap_documents(asked, "conv_id", "doc_id", "name", "text", style)


_WRAPPED = """
    SELECT conv_id, string_agg({block}, '' ORDER BY doc_id) AS text
    FROM documents JOIN conversations ON doc_id = conv_id + turn GROUP BY conv_id
    """


@query("wrap_documents_banner", _WRAPPED.format(block=_BANNER.replace("text", "documents.text")))
def wrap_documents_banner_query(spark, sf_dir):
    return _wrapped(spark, sf_dir, "banner")


@query("wrap_documents_element", _WRAPPED.format(block=_ELEMENT.replace("(text", "(documents.text")))
def wrap_documents_element_query(spark, sf_dir):
    return _wrapped(spark, sf_dir, "element")


@query(
    "expand_preprompts",
    """
    SELECT conv_id, turn, CAST(0 AS INTEGER) AS pp_pos,
           '<Scope>' || chr(10) || ' <Context contentType="application/json"><![CDATA[ {"role":"' || role || '"} ]]></Context>'
             || chr(10) || '</Scope>' || chr(10) || '<Prompt description="The task to execute"><![CDATA[ Read turn ' || turn
             || ': ' || text || ' ]]></Prompt>' AS preprompt FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'Now as ' || role FROM conversations
    """,
)
def expand_preprompts_query(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").withColumn("context", F.to_json(F.struct("role")))
    expanded = expand_preprompts(messages, ["Read turn {{ .turn }}: {{ .text }}", "Now as {{ .role }}"], "context")
    return expanded.select("conv_id", "turn", "pp_pos", "preprompt")


@query(
    "classify_answers",
    """
    WITH a AS (
      SELECT event_type AS stage,
             CASE event_id % 4 WHEN 0 THEN 'retryable' WHEN 1 THEN 'fatal' WHEN 2 THEN 'fatal' ELSE 'ok' END AS class
      FROM events)
    SELECT stage, class, count(*) AS n FROM a GROUP BY stage, class
    """,
)
def classify_answers_query(spark, sf_dir):
    answers = table(spark, sf_dir, "events").select(
        "event_type",
        F.expr("CASE event_id % 4 WHEN 1 THEN concat('[FATAL] ', props) WHEN 3 THEN props END").alias("answer"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'status 503' WHEN 2 THEN 'bad request' END").alias("error"),
    )
    return classify_answers(answers, "event_type", "answer", "error")
