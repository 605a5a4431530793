"""Texts packed into blocks, and the exchange of fingerprints between blocks.

Operators that look for repeats need every position of every text, but rows per position would outgrow the texts many times. So
texts are packed once into blocks of about ``BLOCK_BYTES`` (a longer text is a block of its own), stored in the shared folder, and what
blocks tell each other are sorted arrays of numbers, dealt out by hash to buckets. A number that a block holds often is sent once,
marked as held more than once; so a passage that all texts share costs one number per block. How many buckets there are follows the number of
words or bytes, so that a bucket stays of one size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.tables import stored

BLOCK_BYTES = 2_000_000
BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, ids binary, nulls binary, sizes binary, data binary"
LOW = np.uint64(0xFFFFFFFF)
HALF = np.uint64(32)


@dataclass
class Block:
    """Documents of a block in ascending order of id, then text: ids, marks of null ids, bytes of all, where each starts."""

    block: int
    ids: np.ndarray
    nulls: np.ndarray
    starts: np.ndarray
    data: bytes

    @classmethod
    def of(cls, row) -> Block:
        """Unpack a row of the stored table."""
        sizes = np.frombuffer(row.sizes, "<i8")
        starts = np.concatenate([[0], np.cumsum(sizes)])
        data = zstandard.ZstdDecompressor().decompress(row.data) if row.n_bytes else b""
        return cls(int(row.block), np.frombuffer(row.ids, "<i8"), np.frombuffer(row.nulls, "u1"), starts, data)

    def texts(self) -> Iterator[bytes]:
        """Texts one after another."""
        for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            yield self.data[a:b]

    def keys(self) -> pd.array:
        """Ids with nulls."""
        out = pd.array(self.ids, dtype="Int64")
        out[self.nulls > 0] = pd.NA
        return out


def pack(docs: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``doc_id`` and ``text``, stored. Null texts count as empty; null ids come before all others."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for frame in frames:
            for is_null, doc_id, text in zip(frame["no_id"], frame["doc_id"], frame["text"], strict=True):
                text = text.encode("utf-8", "surrogatepass") if text else b""
                if held and size + len(text) > most:
                    yield _packed((part << 32) + n, held)
                    n, held, size = n + 1, [], 0
                held.append((not is_null, int(doc_id), text))
                size += len(text)
        if held:
            yield _packed((part << 32) + n, held)

    return stored(ids_without_nulls(docs).mapInPandas(run, BLOCK_SCHEMA), "blocks")


def ids_without_nulls(docs: DataFrame) -> DataFrame:
    """``doc_id`` (0 for null), ``no_id`` and ``text``: pandas would turn ids beside nulls into inexact numbers."""
    key = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(key, F.lit(0)).alias("doc_id"), key.isNull().alias("no_id"), "text")


def _packed(block: int, held: list[tuple[bool, int, bytes]]) -> pd.DataFrame:
    held.sort()
    data = b"".join(x[2] for x in held)
    row = {
        "block": block,
        "n_docs": len(held),
        "n_bytes": len(data),
        "ids": np.array([x[1] for x in held], "<i8").tobytes(),
        "nulls": np.array([not x[0] for x in held], "u1").tobytes(),
        "sizes": np.array([len(x[2]) for x in held], "<i8").tobytes(),
        "data": zstandard.ZstdCompressor(level=3).compress(data),
    }
    return pd.DataFrame([row])


def pressed(values: np.ndarray) -> bytes:
    """Sorted unsigned numbers as differences, byte planes apart, compressed."""
    if not len(values):
        return b""
    steps = np.diff(values, prepend=values.dtype.type(0))
    planes = steps.view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def opened(raw: bytes, kind: type) -> np.ndarray:
    """Numbers back from ``pressed``."""
    if not raw:
        return np.empty(0, kind)
    planes = zstandard.ZstdDecompressor().decompress(raw)
    width = np.dtype(kind).itemsize
    steps = np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(steps, dtype=kind)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers in any order, byte planes apart, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unsqueezed(raw: bytes, kind: str) -> np.ndarray:
    """Numbers back from ``squeezed``."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def by_bucket(hashes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each bucket that gets any of the hashes: its number, and the places of those hashes."""
    bucket = (hashes & LOW) % np.uint64(n)
    order = np.argsort(bucket.astype(np.uint16 if n < 65536 else np.uint32), kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(n + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield b, order[ends[b] : ends[b + 1]]


def once_and_more(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted values that occur once, and those that occur more often."""
    found, counts = np.unique(values, return_counts=True)
    return found[counts == 1], found[counts > 1]


def repeated_hashes(blocks: DataFrame, hashes: Callable[[Block], tuple[np.ndarray, np.ndarray]], n: int) -> DataFrame:
    """Which of their hashes the blocks share with other places.

    ``hashes`` gives the 64-bit hashes of all probes of a block, and which of them are indexed (places, or None for all). A hash counts if it is
    indexed somewhere and probed at two places at least, in one block or in several. Compared are 32 bits within a bucket, so a
    few more may come back; none is missed. Returns ``block``, ``bucket``, ``hits``.
    """

    def send(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples():
                block = Block.of(row)
                probes, indexed = hashes(block)
                out = []
                for bucket, at in by_bucket(probes, n):
                    rest = (probes[at] >> HALF).astype(np.uint32)
                    once, more = once_and_more(rest)
                    index = b"" if indexed is None else pressed(np.unique(rest[indexed[at]]))
                    out.append((bucket, block.block, pressed(once), pressed(more), index))
                yield pd.DataFrame(out, columns=["bucket", "block", "once", "more", "indexed"])

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        once = [opened(x, np.uint32) for x in frame["once"]]
        more = [opened(x, np.uint32) for x in frame["more"]]
        found, counts = np.unique(np.concatenate(once), return_counts=True)
        shared = np.union1d(found[counts > 1], np.concatenate(more))
        # a hash that one block holds once and another more often is among the latter
        if any(frame["indexed"]):
            shared = np.intersect1d(shared, np.concatenate([opened(x, np.uint32) for x in frame["indexed"]]))
        out = []
        for block, a, b in zip(frame["block"], once, more, strict=True):
            own = np.concatenate([a[np.isin(a, shared, assume_unique=True)], b[np.isin(b, shared, assume_unique=True)]])
            if len(own):
                out.append((block, int(frame["bucket"].iloc[0]), pressed(np.sort(own))))
        return pd.DataFrame(out, columns=["block", "bucket", "hits"])

    sent = blocks.mapInPandas(send, "bucket int, block long, once binary, more binary, indexed binary")
    return sent.groupBy("bucket").applyInPandas(meet, "block long, bucket int, hits binary")


class Hits:
    """The answers a block got from the buckets."""

    def __init__(self, frame: pd.DataFrame, n: int):
        self.n = n
        self.of = {int(b): opened(x, np.uint32) for b, x in zip(frame["bucket"], frame["hits"], strict=True)}

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Mask of the hashes that were answered."""
        out = np.zeros(len(hashes), bool)
        if self.of:
            for bucket, at in by_bucket(hashes, self.n):
                if bucket in self.of:
                    out[at] = np.isin((hashes[at] >> HALF).astype(np.uint32), self.of[bucket])
        return out


def with_answers(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Bring each block together with the rows of ``answers`` for it (none for some) and apply ``fn``."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fn(Block.of(row), right) for row in left.itertuples()])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(run, schema)
