"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from stagewise.sources.documents import read_resources, resolve_resources, resources_from_table
from stagewise.sources.sinks import publish_table, write_records
from workload.base import query, scratch, table


@query(
    "read_resources",
    """
    SELECT 'kind=' || (page_id % 3) AS folder, 'text/plain' AS media_type,
           url || ' ' || replace(replace(html, chr(10), ' '), chr(13), ' ') AS line
    FROM pages
    """,
)
def read_resources_query(spark, sf_dir):
    path = scratch(spark, "pages")
    html = F.translate("html", "\n\r", "  ")
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 3).alias("kind"), F.concat("url", F.lit(" "), html).alias("value"))
    pages.write.partitionBy("kind").text(path)
    files = read_resources(spark, path, [".txt"])
    lines = F.explode(F.split(F.decode("content", "UTF-8"), "\n"))
    return files.select(F.split_part("identifier", F.lit("/"), F.lit(1)).alias("folder"), "media_type", lines.alias("line")).filter("line <> ''")


def _named_documents(spark, sf_dir):
    suffix = F.when(F.col("lang") == "fr", "PDF").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select(
        F.concat("source", F.lit("."), suffix).alias("file"), "text", "doc_id"
    )


_LAST_PER_FILE = """
    SELECT source || '.' || CASE lang WHEN 'fr' THEN 'PDF' ELSE lang END AS identifier,
           CASE lang WHEN 'fr' THEN 'application/pdf' ELSE 'text/plain' END AS media_type,
           md5(arg_max(text, doc_id)) AS digest
    FROM documents GROUP BY source, lang
    """


@query("resources_from_table", _LAST_PER_FILE)
def resources_from_table_query(spark, sf_dir):
    docs = resources_from_table(_named_documents(spark, sf_dir), "file", "text", seq="doc_id")
    return docs.select("identifier", "media_type", F.md5("content").alias("digest"))


@query("resources_from_base64", _LAST_PER_FILE)
def resources_from_base64_query(spark, sf_dir):
    coded = _named_documents(spark, sf_dir).withColumn("text", F.base64(F.encode("text", "utf-8")))
    docs = resources_from_table(coded, "file", "text", seq="doc_id", base64=True)
    return docs.select("identifier", "media_type", F.md5("content").alias("digest"))


@query(
    "resolve_resources",
    """
    WITH asked AS (
      SELECT page_id AS req_id,
             CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'archive' WHEN 2 THEN 'docs' ELSE 'pages' END AS loader,
             CASE page_id % 5 WHEN 2 THEN 'doc-' || page_id WHEN 3 THEN url || '#gone' ELSE url END AS identifier
      FROM pages),
    catalog AS (
      SELECT 'pages' AS loader, url AS identifier, md5(arg_max(html, page_id)) AS digest
      FROM pages GROUP BY url
      UNION ALL
      SELECT 'docs', 'doc-' || doc_id, md5(text) FROM documents)
    SELECT a.req_id, a.identifier, c.digest,
           CASE WHEN a.loader IS NULL THEN 'no loader selector provided'
                WHEN a.loader NOT IN ('docs', 'pages') THEN 'no loader found for resource'
                WHEN c.identifier IS NULL THEN 'resource not found: ' || a.identifier END AS error
    FROM asked a LEFT JOIN catalog c ON a.loader = c.loader AND a.identifier = c.identifier
    """,
)
def resolve_resources_query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("name"), "text")
    case = F.pmod("page_id", F.lit(5))
    loader = F.when(case == 1, "archive").when(case == 2, "docs").when(case > 2, "pages")
    name = F.when(case == 2, F.concat(F.lit("doc-"), "page_id")).when(case == 3, F.concat("url", F.lit("#gone")))
    requests = pages.select(
        F.col("page_id").alias("req_id"),
        F.coalesce(name, "url").alias("identifier"),
        F.when(loader.isNotNull(), F.create_map(F.lit("loader"), loader))
        .otherwise(F.create_map().cast("map<string,string>"))
        .alias("params"),
    )
    loaders = {
        "pages": resources_from_table(pages, "url", "html", seq="page_id"),
        "docs": resources_from_table(docs, "name", "text"),
    }
    loaded = resolve_resources(requests, loaders)
    return loaded.select("req_id", "identifier", F.md5("content").alias("digest"), F.col("_error").alias("error"))


@query("write_records", "SELECT doc_id, lang, n_chars, text FROM documents")
def write_records_query(spark, sf_dir):
    path = scratch(spark, "records")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "text")
    write_records(docs, path, "json")
    return spark.read.schema(docs.schema).json(path)


@query("write_report", "SELECT o_orderkey || ': ' || o_orderpriority || ' for ' || o_custkey AS value FROM orders")
def write_report_query(spark, sf_dir):
    path = scratch(spark, "report")
    orders = table(spark, sf_dir, "orders")
    write_records(orders, path, "template", "{{ .o_orderkey }}: {{ .o_orderpriority }} for {{ .o_custkey }}")
    return spark.read.text(path)


@query(
    "publish_table",
    """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer
    """,
)
def publish_table_query(spark, sf_dir):
    publish_table("published_customers", table(spark, sf_dir, "customer"))
    return spark.sql("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM published_customers")
