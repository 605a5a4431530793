"""Mixing sources to target weights by the cube method.

Each source has a target number of words. A document of a source with target / size ``r`` is taken ``floor(r)`` times, and once
more with the fractional inclusion probability ``r - floor(r)``. The flight phase turns those probabilities into 0 or 1: three
undecided documents of a source at a time move along the direction that keeps both their number and their words in balance,
until one of them reaches 0 or 1. Only two documents or fewer remain; they are decided in the landing phase.

Flights run in buckets of a source, so that one source may hold most of the rows; what they leave undecided (two rows each) flies again in
buckets of buckets, up to one per source. A task streams over its rows and holds three of them. Buckets and random numbers depend on the
ids alone, so reruns agree however the rows are partitioned.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.tables import if_small, scratch, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BUCKET_ROWS, FAN_IN = 2048, 512
#: Up to so many sources are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
CLOSE = 1e-9


def source_targets(docs: DataFrame) -> DataFrame:
    """One row per source of ``docs`` (``source``, ``size``): ``n``, ``source_size``, ``target``.

    A source stops at ``MOST`` times its size. With the sources in order of size by weight, one stops if the level that all from it
    on would share reaches its limit; the rest share what is left by weight.
    """
    sums = docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weights = F.element_at(F.array(*map(F.lit, WEIGHTS)), (place % len(WEIGHTS) + 1).cast("int"))
    sums = sums.withColumn("weight", weights)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source"))
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    left = SHARE * F.sum("source_size").over(whole) - MOST * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    full = F.col("weight") * left / F.sum("weight").over(after) >= MOST * F.col("source_size")
    sums = sums.withColumn("full", full)
    spent = MOST * F.coalesce(F.sum(F.when(F.col("full"), F.col("source_size"))).over(whole), F.lit(0))
    rest = SHARE * F.sum("source_size").over(whole) - spent
    sharing = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), MOST * F.col("source_size")).otherwise(F.col("weight") * rest / sharing)
    return sums.select("source", "n", "source_size", target.cast("double").alias("target"))


class Flight:
    """Undecided units of one bucket: probability, size and a handle of each."""

    def __init__(self, seed: str):
        self.units: list[list] = []
        self.chance = random.Random(seed)

    def add(self, part: float, size: int, handle) -> list[tuple[float, object]]:
        """Take one more unit in; returns the units decided by that, as (0.0 or 1.0, handle)."""
        self.units.append([part, size, handle])
        out: list[tuple[float, object]] = []
        while True:
            out += [(float(u[0] > 0.5), u[2]) for u in self.units if not CLOSE < u[0] < 1 - CLOSE]
            self.units = [u for u in self.units if CLOSE < u[0] < 1 - CLOSE]
            if len(self.units) < 3:
                return out
            self._move()

    def _move(self) -> None:
        """Move three units within the null space of (number, words) until one reaches 0 or 1."""
        a, b, c = (u[1] for u in self.units)
        way = (b - c, c - a, a - b)
        if not any(way):
            way = (1, -1, 0)
        scale = max(map(abs, way))
        way = [w / scale for w in way]
        up = min(((1 - u[0]) if w > 0 else u[0]) / abs(w) for u, w in zip(self.units, way, strict=True) if w)
        down = min((u[0] if w > 0 else (1 - u[0])) / abs(w) for u, w in zip(self.units, way, strict=True) if w)
        step = up if self.chance.random() * (up + down) < down else -down
        for u, w in zip(self.units, way, strict=True):
            u[0] = min(1.0, max(0.0, u[0] + step * w))

    def land(self) -> list[tuple[float, object]]:
        """Decide what is left: the rounding that changes words least, then number, then the first of equals."""
        best = min(
            product((0.0, 1.0), repeat=len(self.units)),
            key=lambda ends: (
                abs(sum((e - u[0]) * u[1] for e, u in zip(ends, self.units, strict=True))),
                abs(sum(e - u[0] for e, u in zip(ends, self.units, strict=True))),
                ends,
            ),
        )
        out = [(e, u[2]) for e, u in zip(best, self.units, strict=True)]
        self.units = []
        return out


def _fly(rows: DataFrame, level: int, last: bool) -> DataFrame:
    """One round of flights over the buckets in ``rows``: ``part`` becomes 0.0 or 1.0, or stays between them for leftovers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flight, now = None, None
        kept: dict[int, pa.RecordBatch] = {}  # rows of earlier batches that are still undecided
        done: list[tuple[float, pa.RecordBatch]] = []
        serial = 0

        def close() -> list[tuple[float, object]]:
            if flight is None:
                return []
            return flight.land() if last else [(u[0], u[2]) for u in flight.units]

        def settle(found, parts) -> None:
            for part, (kind, handle) in found:
                if kind == "here":
                    parts[handle] = part
                else:
                    done.append((part, kept.pop(handle)))

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source", "bucket", "size", "part")]
            parts = np.full(batch.num_rows, np.nan)
            for i, (source, bucket, size, part) in enumerate(zip(*columns, strict=True)):
                if flight is None or now != (source, bucket):
                    settle(close(), parts)
                    now, flight = (source, bucket), Flight(f"{level}/{source!r}/{bucket}")
                settle(flight.add(part, size, ("here", i)), parts)
            for unit in flight.units if flight else []:
                kind, handle = unit[2]
                if kind == "here":
                    serial += 1
                    kept[serial] = batch.slice(handle, 1)
                    unit[2] = ("kept", serial)
            yield _with_part(batch.filter(pa.array(~np.isnan(parts))), parts[~np.isnan(parts)])
            yield from (_with_part(row, [part]) for part, row in done)
            done.clear()
        settle(close(), None)
        yield from (_with_part(row, [part]) for part, row in done)

    keys = ["source", "bucket"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "order", "doc_id", "size", "tie")
    return rows.mapInArrow(run, rows.schema)


def _with_part(batch: pa.RecordBatch, parts) -> pa.RecordBatch:
    """Batch with new values of ``part``."""
    at = batch.schema.get_field_index("part")
    return batch.set_column(at, batch.schema.field(at), pa.array(np.asarray(parts, float), pa.float64()))


def mix(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Decide how often each row of ``docs`` (``doc_id``, ``source``, ``text``) is taken.

    Returns ``row`` (the columns in ``keep``, all if not given, as a struct), ``size``, ``source_size``, ``target``, ``copies``, ``taken``. Null texts and those
    without a word have size 0 and are never more than their probability says. Null is a source of its own, the last. Repeated rows are
    decided each for itself; rows of one source, id and size go by the hash of their text. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    whole = F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row")
    sized = docs.select("doc_id", "source", size.alias("size"), F.xxhash64(text).alias("tie"), whole)
    targets = stored(source_targets(sized.select("source", "size")), "targets")
    n_sources, most = targets.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    side = F.broadcast(targets) if n_sources <= BROADCAST_SOURCES else targets
    names = side.withColumnRenamed("source", "source_name")
    rows = sized.join(names, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = F.xxhash64("doc_id", "size")
    rows = rows.withColumns({"base": F.floor(ratio), "part": ratio - F.floor(ratio), "order": order})
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("order"), F.ceil(F.col("n") / BUCKET_ROWS))).drop("n")
    buckets, level, settled = max(1, -(-most // BUCKET_ROWS)), 0, []
    while True:
        last = buckets == 1
        flown = stored(_fly(rows, level, last), "flown")
        whole_parts = F.col("part").isin(0.0, 1.0)
        settled.append(flown.filter(whole_parts))
        if last:
            break
        rows = flown.filter(~whole_parts).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        buckets, level = -(-buckets // FAN_IN), level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.union(more)
    copies = F.col("base") + F.col("part").cast("long")
    return out.select("row", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def decisions(docs: DataFrame, key: str) -> DataFrame:
    """Stored ``doc_id``, ``key``, ``rows`` (how many rows of ``docs`` share them), ``copies`` (of all of them), where that is not 0."""
    with scratch() as own:
        taken = mix(docs, ["doc_id", key]).select("row.*", "copies")
        sums = taken.groupBy("doc_id", key).agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
        return own.keep(stored(sums.filter("copies > 0"), "decided"))


def mixed(docs: DataFrame) -> DataFrame:
    """Rows of ``docs``, with all their columns, each as often as it is taken.

    Only ids, sizes and hashes of rows take part in the mix; what it decides is joined back to the rows by id and hash. Rows that are
    equal in all columns are decided together.
    """
    key, columns = "_row_key", [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(*columns).alias("row")
    keyed = docs.select("doc_id", "source", "text", F.xxhash64(*columns).alias(key), row)
    decided = decisions(keyed.drop("row"), key)
    names = if_small(decided).toDF("_id", "_key", "_rows", "_copies")
    rows = keyed.select("doc_id", key, "row").join(names, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(key) == F.col("_key")))
    single = rows.filter("_rows = 1").select("row", "_copies")
    if not decided.filter("rows > 1").isEmpty():
        alike = rows.filter("_rows > 1").groupBy("_id", key).agg(F.any_value("row").alias("row"), F.any_value("_copies").alias("_copies"))
        single = single.unionByName(alike.select("row", "_copies"))
    return single.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select("row.*")
