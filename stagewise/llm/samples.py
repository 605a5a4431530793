"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_share(value: Column, most: int, of: int) -> Column:
    """Rows whose hash falls into a share that leaves about one and a half times ``most`` of ``of`` rows, or all of a few.

    Put before an ordered limit, so that no task and no driver is sent more than that however many partitions there are.
    """
    place = F.shiftrightunsigned(F.xxhash64(value), 11) / F.lit(float(1 << 53))
    return place < min(1.0, (1.5 * most + 100) / max(1, of))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, most: dict[int, int]) -> DataFrame:
    """``text`` and ``label`` of at most ``most[c]`` ids of each class ``c``, one row each: those whose id has the smallest hash.

    ``train`` is a condition on ``doc_id``. Rows without id or label do not count; of several labels of an id the greatest holds, of several texts the
    least. The ids are few by the bounds given, so they are broadcast and only texts of the sample are shuffled.
    """
    known = labels.filter(train & F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label)).cast("int").alias("label"))
    ranked = known.withColumn("h", F.xxhash64("doc_id"))
    sizes = {row.label: row.n for row in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    picked = None
    for value, n in most.items():
        some = ranked.filter((F.col("label") == value) & in_share(F.col("doc_id"), n, sizes.get(value, 0)))
        some = some.orderBy("h", "doc_id").limit(n).select("doc_id", "label")
        picked = some if picked is None else picked.union(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return found.select("text", "label")
