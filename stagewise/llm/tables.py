"""Small helpers the operators share: stored intermediate tables, folds, grouping of links."""

from __future__ import annotations

import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagewise.session import shared_dir


def shared_path(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors can all reach."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


class Scratch:
    """Folders of the tables stored within a ``scratch()`` block."""

    def __init__(self) -> None:
        self.folders: dict[str, bool] = {}
        self.spark: SparkSession | None = None

    def keep(self, table: DataFrame) -> DataFrame:
        """Leave a stored table to the block around this one, or for good if there is none."""
        self.folders[_folders[id(table)]] = True
        return table


_scopes: ContextVar[tuple[Scratch, ...]] = ContextVar("scopes", default=())
#: Folders of stored tables by the frame that ``stored`` returned, as long as it lives.
_folders: dict[int, str] = {}


@contextmanager
def scratch() -> Iterator[Scratch]:
    """Tables stored within are deleted at its end, but for those handed to ``keep``. For steps whose result is stored as a whole."""
    own = Scratch()
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield own
    finally:
        _scopes.reset(token)
    for folder, kept in own.folders.items():
        if not kept:
            _delete(own.spark, folder)
        elif _scopes.get():
            _noted(own.spark, folder)


def _noted(spark: SparkSession, folder: str) -> None:
    """Tell the innermost block of a folder."""
    _scopes.get()[-1].spark = spark
    _scopes.get()[-1].folders[folder] = False


def _delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder of the shared store."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write rows once as Parquet into the shared folder and read them back, so that lost executors cost no recomputation."""
    path = shared_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _folders[id(out)] = path
    weakref.finalize(out, _folders.pop, id(out), None)
    if _scopes.get():
        _noted(df.sparkSession, path)
    return out


def dropped(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    _delete(table.sparkSession, _folders[id(table)])


@contextmanager
def batches_of(spark: SparkSession, most: int) -> Iterator[None]:
    """Within, what runs sends Python batches of about ``most`` bytes (or a single longer row); the session's setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


#: Up to so many rows of a few numbers each a stored table is sent to all tasks; beyond, the join shuffles.
SMALL_ROWS = 1_000_000


def if_small(table: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """A stored table of narrow rows, marked for broadcast if its row count is below the bound. The result of a join is the same."""
    return F.broadcast(table) if table.count() <= most else table


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; null ids fold like the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id that each id of an undirected graph can reach.

    ``links`` has the long columns ``a`` and ``b``. Alternating large-star and small-star steps (each node hangs its larger,
    then its smaller neighbours on the least node it knows) shrink the graph to stars in a logarithmic number of rounds; each
    round is stored in the shared folder. Nothing is gathered per node but minima, which are pre-aggregated. Returns ``id``
    and ``component_id`` for every id that has a link to another id; a link of an id to itself or to null says nothing.
    """
    edges = stored(
        links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    state = _state_of(edges)
    for _ in range(rounds):
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = stored(small.filter("a <> b").distinct(), "links")
        before, state = state, _state_of(edges)
        if state == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
                edges.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct()
            )
    raise RuntimeError("links did not settle")


def _state_of(edges: DataFrame) -> tuple:
    """Count and checksum of a set of edges, for telling when it no longer changes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
