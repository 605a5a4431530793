"""The JSON-schema dialect of plans, as plain dictionaries on the driver."""

from __future__ import annotations

import json
from copy import deepcopy
from typing import Any

from pyspark.sql import types as T

# Dialect keywords with a meaning of their own.
REF_PREFIX = "#/components/schemas/"
OWNER = "x-session"
UI_PREFIX = "x-ui-"

Schema = dict[str, Any]

_SCALARS: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "number": T.DoubleType(),
    "boolean": T.BooleanType(),
}


def _children(schema: Schema):
    """(holder, key) of every direct sub-schema."""
    for name in schema.get("properties") or {}:
        yield schema["properties"], name
    if isinstance(schema.get("items"), dict):
        yield schema, "items"
    for word in ("anyOf", "oneOf"):
        for i in range(len(schema.get(word) or [])):
            yield schema[word], i


def _normalize(schema: Schema) -> Schema:
    kind = schema.get("type")
    if isinstance(kind, list):
        if "null" in kind:
            schema["nullable"] = True
        schema["type"] = next((name for name in kind if name != "null"), "")
    if schema.get("type") == "array" and not schema.get("items"):
        schema["items"] = {"type": "string"}
    for holder, key in _children(schema):
        holder[key] = _normalize(holder[key])
    return schema


def load_schema(source: Schema | str) -> Schema:
    """Schema from a dictionary or JSON text: type lists are folded, a list without items holds strings."""
    return _normalize(deepcopy(source) if isinstance(source, dict) else json.loads(source))


def resolve_refs(schema: Schema, components: dict[str, Schema]) -> Schema:
    """Copy with component references replaced.

    A reference keeps the stage tag of the field that holds it. A reference back to a component that is being expanded
    stays as it is. An unknown name is an error.
    """

    def expand(node: Schema, open_refs: frozenset[str]) -> Schema:
        target = node.get("$ref")
        if isinstance(target, str) and target.startswith(REF_PREFIX):
            if target in open_refs:
                return node
            name = target[len(REF_PREFIX) :]
            if name not in components:
                raise KeyError(f"schema not found: {target}")
            owner = node.get(OWNER)
            node = deepcopy(components[name])
            node.pop(OWNER, None)
            if owner is not None:
                node[OWNER] = owner
            return expand(node, open_refs | {target})
        for holder, key in _children(node):
            holder[key] = expand(holder[key], open_refs)
        return node

    return expand(deepcopy(schema), frozenset())


def owners_of(field: Schema) -> list[str]:
    """Stages that fill a field: none, one by name, or several as a list."""
    owner = field.get(OWNER)
    return [] if owner is None else [owner] if isinstance(owner, str) else list(owner)


def stage_names(schema: Schema) -> list[str]:
    """Stages that own a field, each once."""
    return list(dict.fromkeys(owner for field in (schema.get("properties") or {}).values() for owner in owners_of(field)))


def stage_schema(schema: Schema, stage: str) -> Schema:
    """The part of a schema one stage fills, with ``required`` cut to its fields."""
    if stage not in stage_names(schema):
        raise KeyError(f"no field belongs to stage {stage}")
    fields = {name: field for name, field in schema["properties"].items() if stage in owners_of(field)}
    return {**schema, "properties": fields, "required": [name for name in schema.get("required") or [] if name in fields]}


def to_spark(schema: Schema) -> T.DataType:
    """Spark type of a schema; tags travel in the field metadata."""
    kind = schema.get("type") or ""
    if schema.get("anyOf") or schema.get("oneOf") or schema.get("$ref"):
        return T.VariantType()
    if kind in _SCALARS:
        return _SCALARS[kind]
    if kind == "array":
        return T.ArrayType(to_spark(schema.get("items") or {"type": "string"}), True)
    fields = schema.get("properties")
    if fields:
        return T.StructType([_field(name, field) for name, field in fields.items()])
    if kind == "object":
        return T.MapType(T.StringType(), T.VariantType(), True)
    return T.VariantType()


def _field(name: str, schema: Schema) -> T.StructField:
    metadata = {key: value for key, value in schema.items() if key == OWNER or key.startswith(UI_PREFIX)}
    return T.StructField(name, to_spark(schema), True, metadata)


def from_spark(kind: T.DataType, nullable: bool = False) -> Schema:
    """Schema of a Spark type: every field is required, a nullable column is a nullable value."""
    schema: Schema
    if isinstance(kind, T.StructType):
        fields = {field.name: {**from_spark(field.dataType, field.nullable), **field.metadata} for field in kind.fields}
        schema = {"type": "object", "properties": fields, "required": list(kind.names)}
    elif isinstance(kind, T.ArrayType):
        schema = {"type": "array", "items": from_spark(kind.elementType)}
    elif isinstance(kind, T.BooleanType):
        schema = {"type": "boolean"}
    elif isinstance(kind, T.IntegralType):
        schema = {"type": "integer"}
    elif isinstance(kind, T.NumericType):
        schema = {"type": "number"}
    elif isinstance(kind, (T.MapType, T.VariantType)):
        schema = {"type": "object"}
    else:
        schema = {"type": "string"}
    return {**schema, "nullable": True} if nullable else schema
