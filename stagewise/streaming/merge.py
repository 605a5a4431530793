"""Progressive merge of record fragments that arrive on a stream.

What a merged field becomes is decided by minima and maxima of the order column (see ``operators.merge``), so the states of two sets of fragments
add up to that of both. Each micro-batch writes its own state rows and list items as a level 0 part, and then one small version file that names
all parts that belong together. The version file is the commit: a reader takes the newest one and sees state and items up to
the same batch, whole, while the stream goes on. The result does not depend on how the fragments are cut into micro-batches.

``FAN`` parts of a level are merged into one of the next, so a row is rewritten once a level and the number of parts grows with the
logarithm of the number of batches. Parts that the last ``KEPT`` versions do not name are deleted.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stagewise.functions.columns import Keys, names, ref
from stagewise.operators.merge import field_state, fragment_fields, list_items, resolve_merge

STATE, ITEMS, VERSIONS = "state", "items", "versions"
#: Parts of a level that become one of the next, and versions whose parts stay for readers that began with them.
FAN, KEPT = 8, 3


class _Folder:
    """Files below ``out`` by the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, out: str):
        self.spark, self.out = spark, out
        self.jvm = spark._jvm.org.apache.hadoop.fs
        self.files = self.jvm.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str) -> str:
        """Path below the folder."""
        return "/".join((self.out, *parts))

    def listed(self, *parts: str) -> list[str]:
        """Names in a folder, none if it does not exist."""
        place = self.jvm.Path(self.path(*parts))
        return sorted(x.getPath().getName() for x in self.files.listStatus(place)) if self.files.exists(place) else []

    def delete(self, *parts: str) -> None:
        """Remove a file or folder."""
        self.files.delete(self.jvm.Path(self.path(*parts)), True)

    def versions(self) -> list[int]:
        """Committed versions, oldest first."""
        return sorted(int(name[: -len(".json")]) for name in self.listed(VERSIONS) if name.endswith(".json"))

    def parts(self, version: int) -> list[dict[str, Any]]:
        """Parts that a version names: ``level`` and ``name``."""
        return json.loads(self.spark.read.text(self.path(VERSIONS, f"{version}.json"), wholetext=True).first()[0])

    def commit(self, version: int, parts: list[dict[str, Any]]) -> None:
        """Write a version file under another name and move it to its place."""
        draft, place = self.jvm.Path(self.path(VERSIONS, f"{version}.draft")), self.jvm.Path(self.path(VERSIONS, f"{version}.json"))
        sink = self.files.create(draft, True)
        sink.write(bytearray(json.dumps(parts).encode()))
        sink.close()
        if not self.files.rename(draft, place):
            raise OSError(f"cannot commit version {version} in {self.out}")

    def tidy(self) -> None:
        """Delete old version files, and the parts that the others do not name."""
        kept = self.versions()[-KEPT:]
        named = {part["name"] for version in kept for part in self.parts(version)}
        for name in self.listed(VERSIONS):
            if name.split(".")[0] not in map(str, kept):
                self.delete(VERSIONS, name)
        for kind in (STATE, ITEMS):
            for name in self.listed(kind):
                if name not in named:
                    self.delete(kind, name)


def add_states(states: DataFrame, keys: Keys) -> DataFrame:
    """States of several sets of fragments as one (see ``field_state``)."""
    group = [*[ref(name) for name in names(keys)], "field", "name"]
    return states.groupBy(*group).agg(
        F.min("list_from").alias("list_from"),
        F.max("object_at").alias("object_at"),
        F.max("null_at").alias("null_at"),
        F.max("at").alias("at"),
        F.max_by("value", "at").alias("value"),
        F.bool_and("is_mark").alias("is_mark"),
    )


def _compacted(folder: _Folder, parts: list[dict[str, Any]], keys: Keys, version: int) -> list[dict[str, Any]]:
    """Parts with full levels merged into the next."""
    level = 0
    while any(part["level"] >= level for part in parts):
        full = [part["name"] for part in parts if part["level"] == level]
        if len(full) >= FAN:
            name = f"{version}-{level + 1}"
            read = lambda kind: folder.spark.read.parquet(*[folder.path(kind, part) for part in full])  # noqa: B023, E731
            add_states(read(STATE), keys).write.mode("overwrite").parquet(folder.path(STATE, name))
            read(ITEMS).write.mode("overwrite").parquet(folder.path(ITEMS, name))
            parts = [part for part in parts if part["level"] != level] + [{"level": level + 1, "name": name}]
        level += 1
    return parts


def merge_fragments_stream(
    stream: DataFrame, keys: Keys, seq: str, fragment: str, out: str, checkpoint: str, trigger: dict[str, Any]
) -> StreamingQuery:
    """Start the merge of a stream into the tables below ``out``; ``trigger`` is passed on to Spark.

    A batch that is run again after a failure replaces its own part; one whose version is committed is not run again.
    """

    def write_version(batch: DataFrame, batch_id: int) -> None:
        folder = _Folder(batch.sparkSession, out)
        known = folder.versions()
        if known and known[-1] >= batch_id:
            return
        fields = fragment_fields(batch, keys, seq, fragment).persist()
        name = f"{batch_id}-0"
        field_state(fields, keys).write.mode("overwrite").parquet(folder.path(STATE, name))
        list_items(fields, keys).write.mode("overwrite").parquet(folder.path(ITEMS, name))
        fields.unpersist()
        parts = [*(folder.parts(known[-1]) if known else []), {"level": 0, "name": name}]
        folder.commit(batch_id, _compacted(folder, parts, keys, batch_id))
        folder.tidy()

    writer = stream.writeStream.foreachBatch(write_version).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_merged(spark: SparkSession, keys: Keys, out: str, version: int | None = None) -> DataFrame:
    """Merge result rows, as the batch form gives them, up to the newest version or one of the last ``KEPT``."""
    folder = _Folder(spark, out)
    if version is None:
        known = folder.versions()
        if not known:
            raise ValueError(f"nothing is committed in {out}")
        version = known[-1]
    parts = [part["name"] for part in folder.parts(version)]
    states = spark.read.parquet(*[folder.path(STATE, name) for name in parts])
    return resolve_merge(add_states(states, keys), spark.read.parquet(*[folder.path(ITEMS, name) for name in parts]), keys)
