"""Document sources: files, tables and several loaders side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.functions.columns import Keys, names, ref

# Media types by file extension; every other extension counts as plain text.
MEDIA_TYPES = {".pdf": "application/pdf"}
DEFAULT_MEDIA_TYPE = "text/plain"

# Load failures.
NO_SELECTOR = "no loader selector provided"
UNKNOWN_LOADER = "no loader found for resource"
NOT_FOUND = "resource not found: "
REPEATED = "identifier is not unique: "


def media_type(identifier: Column) -> Column:
    """Media type from the lower-cased extension of a file name."""
    extension = F.lower(F.regexp_extract(identifier, r"(\.[^./]*)$", 1))
    found: Column = F.lit(DEFAULT_MEDIA_TYPE)
    for suffix, kind in MEDIA_TYPES.items():
        found = F.when(extension == suffix, kind).otherwise(found)
    return found


def read_resources(spark: SparkSession, path: str, exts: list[str] | None = None) -> DataFrame:
    """Files below ``path`` as ``(identifier, media_type, content)``; a missing path is an error when the plan is built."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if exts:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(exts) + "}")
    files = reader.load(path)
    root = path.rstrip("/") + "/"
    return files.select(
        F.split_part(F.col("path"), F.lit(root), F.lit(-1)).alias("identifier"),
        media_type(F.col("path")).alias("media_type"),
        F.col("content"),
    )


def resources_from_table(
    df: DataFrame, identifier: str, content: str, seq: str | None = None, base64: bool = False, keep: Keys = ()
) -> DataFrame:
    """Table rows as documents, one per identifier, with further columns to keep.

    With ``seq``, the last row per identifier wins. Without it identifiers have to be unique: a repeated one stops the job that reads it.
    """
    extra = names(keep)
    body = F.unbase64(ref(content)) if base64 else ref(content).cast("binary")
    if seq is None:
        only = [F.any_value(ref(name)).alias(name) for name in (content, *extra)]
        docs = df.groupBy(ref(identifier).alias("_id")).agg(F.count(F.lit(1)).alias("_n"), *only)
        twice = F.raise_error(F.concat(F.lit(REPEATED), F.coalesce("_id", F.lit("null"))))
        found = F.when(F.col("_n") == 1, F.col("_id")).otherwise(twice.cast("string"))
        docs = docs.select(found.alias("identifier"), body.alias("content"), *extra)
    else:
        latest = [F.max_by(ref(name), ref(seq)).alias(name) for name in (content, *extra)]
        docs = df.groupBy(ref(identifier).alias("_id")).agg(*latest)
        docs = docs.select(F.col("_id").alias("identifier"), body.alias("content"), *extra)
    return docs.select("identifier", media_type(F.col("identifier")).alias("media_type"), "content", *extra)


def resolve_resources(
    requests: DataFrame, loaders: dict[str, DataFrame], identifier: str = "identifier", params: str = "params"
) -> DataFrame:
    """Load each request from the loader named by ``params.loader``.

    Adds ``media_type``, ``content`` and ``_error``. All loaders are joined at once on (loader, identifier).
    """
    catalog: DataFrame | None = None
    for name, source in loaders.items():
        tagged = source.select(F.lit(name).alias("_loader"), F.col("identifier").alias("_id"), "media_type", "content")
        catalog = tagged if catalog is None else catalog.unionByName(tagged)
    if catalog is None:
        raise ValueError("at least one loader is needed")
    asked = requests.withColumn("_wanted", F.try_element_at(ref(params), F.lit("loader")))
    joined = asked.join(
        catalog, (F.col("_wanted") == F.col("_loader")) & (ref(identifier) == F.col("_id")), "left"
    )
    error = (
        F.when(F.col("_wanted").isNull(), NO_SELECTOR)
        .when(~F.col("_wanted").isin(list(loaders)), UNKNOWN_LOADER)
        .when(F.col("_id").isNull(), F.concat(F.lit(NOT_FOUND), ref(identifier)))
    )
    return joined.withColumn("_error", error).drop("_wanted", "_loader", "_id")
