"""Lookups by name: resources, catalogs and patches.

All joins are equi-joins with the catalog unique per key, and no side is forced to be broadcast: Spark broadcasts what
its size statistics allow, and AQE splits the request side when one key dominates it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions.columns import Keys, join_on, names, ref
from stagewise.functions.templates import render_column
from stagewise.sources.documents import NOT_FOUND

# Resource destinations.
TO_AI = "ai"
TO_VARS = "vars"
TO_PRE_PROMPT = "prePrompt"
TO_PROMPT = "prompt"


def attach_resources(
    stages: DataFrame, resources: DataFrame, requests: str = "requests", scope: Column | None = None
) -> DataFrame:
    """One row per requested resource with its content.

    ``requests`` is a list of (identifier, dest, var); identifiers may be templates over the ``scope`` map. A miss leaves
    ``_error``. The destination defaults to the model.
    """
    asked = stages.select("*", F.posexplode(ref(requests)).alias("req_pos", "_req")).drop(requests)
    identifier = F.col("_req.identifier")
    if scope is not None:
        identifier = render_column(identifier, scope)
    asked = (
        asked.withColumn("identifier", identifier)
        .withColumn("dest", F.coalesce(F.col("_req.dest"), F.lit(TO_AI)))
        .withColumn("var", F.col("_req.var"))
        .drop("_req")
    )
    catalog = resources.select(F.col("identifier").alias("_id"), "media_type", "content")
    joined = asked.join(catalog, F.col("identifier") == F.col("_id"), "left")
    error = F.when(F.col("_id").isNull(), F.concat(F.lit(NOT_FOUND), F.col("identifier")))
    return joined.withColumn("_error", error).drop("_id")


def route_resources(df: DataFrame, has_pre_prompt: str, dest: str = "dest") -> DataFrame:
    """Add ``target``: where a resource goes. Those for the model go to whichever prompt comes first."""
    first_prompt = F.when(ref(has_pre_prompt), TO_PRE_PROMPT).otherwise(TO_PROMPT)
    return df.withColumn("target", F.when(ref(dest) == TO_AI, first_prompt).otherwise(ref(dest)))


def missing_required(required: DataFrame, available: DataFrame | None, on: Keys = ("name", "type")) -> DataFrame:
    """Required pairs that the catalog lacks; without a catalog the check is off."""
    if available is None:
        return required.limit(0)
    return required.join(available.select(*names(on)), names(on), "left_anti")


def expand_groups(requests: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested functions as ``(req_id, name, description, schema)``.

    ``requests``: (req_id, kind, name, description, schema, allowlist) with kind ``function`` or ``collection``.
    ``catalog``: (name, collection, description, schema). A collection request yields its members, restricted by the
    allowlist if there is one. A function request may override description and schema. Unknown names yield nothing.
    """
    entries = catalog.select(
        F.col("name").alias("_name"),
        F.col("collection").alias("_collection"),
        F.col("description").alias("_description"),
        F.col("schema").alias("_schema"),
    )
    single = requests.filter(F.col("kind") == "function").join(entries, F.col("name") == F.col("_name"))
    single = single.select(
        "req_id",
        "name",
        F.coalesce(F.nullif("description", F.lit("")), F.col("_description")).alias("description"),
        F.coalesce("schema", "_schema").alias("schema"),
    )
    allowed = F.col("allowlist").isNull() | F.array_contains("allowlist", F.col("_name"))
    grouped = requests.filter(F.col("kind").isin("collection", "mcp")).join(
        entries, (F.col("name") == F.col("_collection")) & allowed
    )
    grouped = grouped.select(
        "req_id",
        F.col("_name").alias("name"),
        F.col("_description").alias("description"),
        F.col("_schema").alias("schema"),
    )
    return single.unionByName(grouped)


def upsert_by_key(base: DataFrame, patch: DataFrame, keys: Keys) -> DataFrame:
    """Patch rows replace base rows of the same key, null keys included; others of both sides stay."""
    cols = names(keys)
    return join_on(base, patch.select(*[ref(name) for name in cols]), cols, "left_anti").unionByName(patch)


def in_group(catalog: DataFrame, group: str, col: str = "collection") -> DataFrame:
    """Members of one collection."""
    return catalog.filter(ref(col) == group)
