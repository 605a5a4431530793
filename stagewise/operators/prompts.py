"""Prompt texts: envelopes, attached documents and pre-prompts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.columns import Keys, names, ref
from stagewise.functions.envelope import Node, cdata
from stagewise.functions.templates import compile_template
from stagewise.operators.conversation import join_parts
from stagewise.operators.reshape import prefix_sums

# Descriptions and content types inside the envelope.
PROMPT_DESCRIPTION = "The task to execute"
JSON_TYPE = "application/json"


@dataclass(frozen=True)
class CallOutput:
    """Result of one call, as JSON text, for the prompt."""

    name: str
    result: Column
    description: str = ""


def prompt_envelope(
    prompt: Column,
    context: Column | None = None,
    context_is_json: bool = True,
    calls: Sequence[CallOutput] | None = None,
) -> Column:
    """Optional ``Scope`` (context, call results), then the ``Prompt``, trimmed.

    ``calls=None`` means that no calls ran; an empty sequence leaves an empty ``Calls`` element.
    """
    children: list[Node] = []
    if context is not None:
        children.append(Node("Context", content=context, content_type=JSON_TYPE if context_is_json else None))
    if calls is not None:
        results = tuple(
            Node("CallResult", content=call.result, name=call.name, description=call.description, content_type=JSON_TYPE)
            for call in calls
        )
        children.append(Node("Calls", children=results))
    task = Node("Prompt", content=prompt, description=PROMPT_DESCRIPTION).to_column()
    if not children:
        return task
    return F.concat(Node("Scope", children=tuple(children)).to_column(), F.lit("\n"), task)


def build_prompts(
    df: DataFrame,
    prompt: str,
    context: str | None = None,
    context_is_json: bool = True,
    calls: Sequence[CallOutput] | None = None,
    out: str = "prompt_text",
) -> DataFrame:
    """Add the enveloped prompt, from column names."""
    body = ref(context) if context is not None else None
    return df.withColumn(out, prompt_envelope(ref(prompt), body, context_is_json, calls))


def document_block(identifier: Column, text: Column, style: str) -> Column:
    """One document as a marked block (``banner``) or as an element (``element``)."""
    if style == "banner":
        return F.concat(F.lit("=== "), identifier, F.lit(" ===\n"), text, F.lit("\n===\n"))
    if style == "element":
        return F.concat(F.lit('<Document name="'), identifier, F.lit('">'), cdata(text), F.lit("</Document>\n"))
    raise ValueError(f"unknown style: {style}")


def document_blocks(df: DataFrame, keys: Keys, pos: str, identifier: str, text: str, style: str = "banner") -> DataFrame:
    """``(keys, block, offset, text)``: the documents of a group as numbered blocks, each with the bytes of the blocks before it.

    The blocks in order are the text of the group, however large it is; a writer can put each at its offset by itself.
    """
    blocks = df.select(*[ref(name) for name in names(keys)], ref(pos).alias("_at"), document_block(ref(identifier), ref(text), style).alias("_block"))
    placed = prefix_sums(blocks, keys, "_at", {"block": F.lit(1), "offset": F.octet_length("_block")})
    return placed.select(*[ref(name) for name in names(keys)], "block", "offset", F.col("_block").alias("text"))


def wrap_documents(
    df: DataFrame, keys: Keys, pos: str, identifier: str, text: str, style: str = "banner"
) -> DataFrame:
    """``(keys, text)``: the documents of a group as blocks, joined in the order of ``pos``. For groups that fit a cell; others: ``document_blocks``."""
    blocks = df.select(*names(keys), ref(pos).alias("_at"), document_block(ref(identifier), ref(text), style).alias("_block"))
    return join_parts(blocks, keys, "_at", "_block")


def expand_preprompts(
    df: DataFrame,
    preprompts: str | Sequence[str],
    context: str | None = None,
    calls: Sequence[CallOutput] | None = None,
    nested: list[str] | None = None,
) -> DataFrame:
    """One row per pre-prompt as ``(pp_pos, preprompt)``; only number 0 carries the envelope with context and calls."""
    texts = [preprompts] if isinstance(preprompts, str) else list(preprompts)
    if not texts:
        raise ValueError("at least one pre-prompt is needed")
    rendered = [compile_template(text, df.schema, nested) for text in texts]
    body = ref(context) if context is not None else None
    rendered[0] = prompt_envelope(rendered[0], body, True, calls)
    return df.select("*", F.posexplode(F.array(*rendered)).alias("pp_pos", "preprompt"))
