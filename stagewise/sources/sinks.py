"""Record sinks: JSON, rendered text and named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from stagewise.functions.templates import compile_template


def write_records(df: DataFrame, path: str, fmt: str = "json", template: str | None = None, mode: str = "errorifexists") -> None:
    """Write one JSON object per row, or one rendered text per row.

    Texts that span lines are kept whole; rows are written by the tasks that hold them.
    """
    if fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", "false").json(path)
    elif fmt == "template":
        if template is None:
            raise ValueError("the template format needs a template")
        df.select(compile_template(template, df.schema).alias("value")).write.mode(mode).text(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def publish_table(name: str, df: DataFrame, saved: bool = False) -> None:
    """Make rows available to later expressions and SQL by name, as a view or appended to a saved table."""
    if saved:
        df.write.mode("append").saveAsTable(name)
    else:
        df.createOrReplaceTempView(name)
