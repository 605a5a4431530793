"""Embedding near-dedup by product quantisation.

Vectors are scaled to length one and assigned to the nearest of some coarse centroids (inverted lists). What is left of a vector after its
centroid is cut into subspaces and written as one byte each: the nearest codeword of that subspace. A query looks up its products with
all codewords once, and sums them by the codes of the members of each list it probes. The error of
each member's code is known, so no member of a probed list within reach is ruled out; those left are compared exactly, in double precision.

Lists to probe: a list is left out only if its cell (all that is nearer to its centroid than to the query's own) begins farther from the
query than two linked vectors can be apart, so no link is lost however the vectors are spread. Centroids and codewords are fitted on a
bounded sample; every vector is indexed, and every vector is a query.

Vectors lie in packs of bounded size in the order of their lists, and pairs of packs are joined by pack numbers, so a list that holds a
third of all vectors becomes many tasks. Linked pairs are folded a batch at a time into counts and a spanning forest, and only
those leave a task. Vectors with equal components become one class first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.tables import components, stored

LEAST_COSINE = 0.9
#: Bounds of the fitting sample and of the number of lists.
SAMPLE, MOST_LISTS = 20_000, 1_024
PARTS, CODEWORDS = 8, 256
PACK = 4_096
#: Looked-up pairs, and components of exactly compared vectors, that a task holds at a time.
TILE, AT_ONCE = 128 * PACK, 4_000_000
#: Columns of a stored pack.
PACKED = ["rows", "copies", "raw", "own", "codes", "errors", "held", "probed"]
ROUNDS = 10


def near_mean(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Centroids by k-means from a fixed seed; empty ones stay where they are."""
    k = max(1, min(k, len(x)))
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(x, centres)
        counts = np.bincount(own, minlength=k)
        sums = np.stack([np.bincount(own, x[:, j], k) for j in range(x.shape[1])], axis=1)
        full = counts > 0
        centres[full] = sums[full] / counts[full, None]
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, never below zero."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1), 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each row."""
    return np.concatenate([squared(x[i : i + 4096], centres).argmin(axis=1) for i in range(0, len(x), 4096)])


@dataclass
class Quantiser:
    """Coarse centroids and the codewords of each subspace."""

    centres: np.ndarray
    words: list[np.ndarray]
    cuts: list[tuple[int, int]]
    least: float

    @classmethod
    def fit(cls, x: np.ndarray, n_lists: int, least: float) -> Quantiser:
        """Fit on rows of length one."""
        centres = near_mean(x, n_lists, 1)
        rest = x - centres[nearest(x, centres)]
        edges = np.linspace(0, x.shape[1], min(PARTS, x.shape[1]) + 1).astype(int).tolist()
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        return cls(centres, [near_mean(rest[:, a:b], CODEWORDS, 2) for a, b in cuts], cuts, least)

    @property
    def reach(self) -> float:
        """Distance of two rows of length one at the least cosine."""
        return math.sqrt(2 - 2 * self.least)

    def within(self, x: np.ndarray, own: np.ndarray, lists: np.ndarray) -> np.ndarray:
        """Mask of those of some lists that may hold a row within reach of each row, given the list each row is in."""
        d = squared(x, self.centres[lists])
        mine = ((x - self.centres[own]) ** 2).sum(axis=1)
        gaps = np.sqrt(squared(self.centres, self.centres[lists]))[own]
        with np.errstate(divide="ignore", invalid="ignore"):
            away = (d - mine[:, None]) / (2 * gaps)
        return ~(away > self.reach + 1e-6) | (own[:, None] == lists)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each row, and a mask of the lists it probes."""
        own = nearest(x, self.centres)
        return own, self.within(x, own, np.arange(len(self.centres)))

    def codes(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows of given lists, and the distance of each row from what its code stands for."""
        rest = x - self.centres[own]
        codes = np.stack([nearest(rest[:, a:b], w) for (a, b), w in zip(self.cuts, self.words, strict=True)], axis=1)
        close = np.concatenate([w[c] for w, c in zip(self.words, codes.T, strict=True)], axis=1)
        return codes.astype(np.uint8), np.sqrt(((rest - close) ** 2).sum(axis=1))

    def stand_ins(self, codes: np.ndarray, own: np.ndarray) -> np.ndarray:
        """What the codes of rows of given lists stand for."""
        return self.centres[own] + np.concatenate([w[c] for w, c in zip(self.words, codes.T, strict=True)], axis=1)

    def tables(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each subspace, the products of each query with the codewords; they serve all lists."""
        return [(queries[:, a:b] @ w.T).astype(np.float32) for (a, b), w in zip(self.cuts, self.words, strict=True)]


@dataclass
class Pack:
    """Vectors of length one in ascending order of their list, with row numbers, copies, codes and the least products that don't rule them out."""

    rows: np.ndarray
    copies: np.ndarray
    x: np.ndarray
    own: np.ndarray
    codes: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, known: Quantiser, kind: str, rows: bytes, copies: bytes, raw: bytes, own: bytes, codes: bytes, errors: bytes) -> Pack:
        """Unpack a stored pack."""
        numbers, lists = np.frombuffer(rows, "<i8"), np.frombuffer(own, "<i4")
        width = len(raw) // len(numbers)
        x = unit_rows([raw[i : i + width] for i in range(0, len(raw), width)], kind)
        code = np.frombuffer(codes, np.uint8).reshape(len(numbers), -1)
        close = known.stand_ins(code, lists)
        apart = known.reach + np.frombuffer(errors, "<f8") + 1e-4
        floor = (1 + (close * close).sum(axis=1) - apart**2) / 2 - 1e-5
        return cls(numbers, np.frombuffer(copies, "<i8"), x, lists, code, floor.astype(np.float32))


def pairs_of(known: Quantiser, queries: Pack, members: Pack) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (query, member) of linked pairs of two packs, at most ``AT_ONCE`` components' worth at a time."""
    tables = known.tables(queries.x)
    lists, starts = np.unique(members.own, return_index=True)
    near = known.within(queries.x, queries.own, lists)
    for j, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(members.own)], strict=True)):
        asking = np.flatnonzero(near[:, j])
        step = max(1, TILE // (b - a))
        for start in range(0, len(asking), step):
            some = asking[start : start + step]
            total = np.repeat((queries.x[some] @ known.centres[lists[j]]).astype(np.float32)[:, None], b - a, axis=1)
            for table, code in zip(tables, members.codes[a:b].T, strict=True):
                total += table[some][:, code]
            q, m = np.nonzero(total >= members.floor[a:b])
            few = max(1, AT_ONCE // queries.x.shape[1])
            for i in range(0, len(q), few):
                left, right = some[q[i : i + few]], m[i : i + few] + a
                same = np.einsum("ij,ij->i", queries.x[left], members.x[right]) >= known.least
                if same.any():
                    yield left[same], right[same]


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least place of each component) after links between the places ``a`` and ``b``."""
    while True:
        left, right = label[a], label[b]
        open_ = left != right
        if not open_.any():
            return label
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        np.minimum.at(label, np.maximum(left, right), np.minimum(left, right))
        while True:
            upper = label[label]
            if (upper == label).all():
                break
            label = upper


def links_between(known: Quantiser, queries: Pack, members: Pack, same: bool) -> pd.DataFrame:
    """Counts and a spanning forest of the links of two packs, or of one with itself. Each batch of pairs is folded in and dropped."""
    n_q, n_m = len(queries.rows), len(members.rows)
    shift = 0 if same else n_q
    rows = queries.rows if same else np.concatenate([queries.rows, members.rows])
    n, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for q, m in pairs_of(known, queries, members):
        if same:
            q, m = q[q < m], m[q < m]
        n[:n_q] += np.bincount(q, members.copies[m], n_q).astype(np.int64)
        n[shift:] += np.bincount(m, queries.copies[q], n_m).astype(np.int64)
        label = joined(label, q, m + shift)
    some, tied = np.flatnonzero(n), np.flatnonzero(label != np.arange(len(rows)))
    return pd.DataFrame(
        {
            "a": np.concatenate([rows[some], rows[tied]]),
            "b": pd.array([*[None] * len(some), *rows[label[tied]].tolist()], dtype="Int64"),
            "n": np.concatenate([n[some], np.zeros(len(tied), np.int64)]),
        }
    )


def unit_rows(raw: list[bytes], kind: str) -> np.ndarray:
    """Vectors of equal length in double precision, scaled to length one."""
    x = np.frombuffer(b"".join(raw), kind).astype(np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def numbered(vectors: DataFrame, kind: str) -> DataFrame:
    """Stored ``row``, ``vec_id``, ``width``, ``raw`` (components, null for vectors that can't link) and ``print`` (equal for equal ones)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for frame in frames:
            raws: list[bytes | None] = []
            for value in frame["embedding"]:
                x = None if value is None else np.array([np.nan if v is None else v for v in value], kind)
                good = x is not None and len(x) > 0 and np.isfinite(x).all() and x.any()
                raws.append((x + x.dtype.type(0)).tobytes() if good else None)
            keys = pd.array(frame["vec_id"], dtype="Int64")
            keys[frame["no_id"].to_numpy(bool)] = pd.NA
            out = pd.DataFrame({"row": np.arange(row, row + len(frame)), "vec_id": keys})
            out["width"] = [len(x) // np.dtype(kind).itemsize if x else 0 for x in raws]
            out["raw"], out["print"] = raws, [xxhash.xxh3_128_digest(x) if x else None for x in raws]
            row += len(frame)
            yield out

    key = F.col("vec_id").cast("long")
    rows = vectors.select(F.coalesce(key, F.lit(0)).alias("vec_id"), key.isNull().alias("no_id"), "embedding")
    return stored(rows.mapInPandas(run, "row long, vec_id long, width int, raw binary, print binary"), "vectors")


def packs_of(classes: DataFrame, quantiser: Quantiser, kind: str) -> DataFrame:
    """Stored packs of at most ``PACK`` vectors of neighbouring lists: ``pack`` and the fields of ``Pack``, marks of the lists held and probed."""
    known = classes.sparkSession.sparkContext.broadcast(quantiser)
    most = PACK

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), most):
                part = frame.iloc[start : start + most]
                yield part.assign(list=nearest(unit_rows(list(part["raw"]), kind), known.value.centres))

    def packed(pack: int, part: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(list(part["raw"]), kind)
        own = part["list"].to_numpy("<i4")
        near = known.value.within(x, own, np.arange(len(known.value.centres)))
        codes, errors = known.value.codes(x, own)
        held = np.zeros(near.shape[1], bool)
        held[own] = True
        fields = [part["row"].to_numpy("<i8"), part["copies"].to_numpy("<i8"), own, codes, errors, np.packbits(held), np.packbits(near.any(axis=0))]
        values = [x.tobytes() for x in fields]
        return pd.DataFrame([(pack, *values[:2], b"".join(part["raw"]), *values[2:])], columns=["pack", *PACKED])

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        pack, held = TaskContext.get().partitionId() << 33, None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame])
            while len(held) >= most:
                yield packed(pack, held.iloc[:most])
                pack, held = pack + 1, held.iloc[most:]
        if held is not None and len(held):
            yield packed(pack, held)

    dealt = classes.select("row", "copies", "raw").mapInPandas(deal, "row long, copies long, raw binary, list int")
    dealt = stored(dealt, "vector-lists").repartitionByRange("list", "row").sortWithinPartitions("list", "row")
    return stored(dealt.mapInPandas(gather, "pack long, " + ", ".join(f"{x} binary" for x in PACKED)), "packs")


def pack_pairs(packs: DataFrame) -> DataFrame:
    """``pack`` and ``other``: once each, pairs of packs of which one probes lists of the other; a pack takes either side about equally often."""
    heads = sorted((r.pack, bytes(r.held), bytes(r.probed)) for r in packs.select("pack", "held", "probed").collect())
    numbers = np.array([x[0] for x in heads])
    held, probed = (np.frombuffer(b"".join(x[i] for x in heads), np.uint8).reshape(len(heads), -1) for i in (1, 2))
    known = packs.sparkSession.sparkContext.broadcast((numbers, held, probed))

    def pair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, held, probed = known.value
        every = np.arange(len(numbers))
        for frame in frames:
            for i in np.searchsorted(numbers, frame["pack"].to_numpy()).tolist():
                mine = np.where(every > i, (every + i) % 2 == 1, (every + i) % 2 == 0)
                others = numbers[mine & (held & probed[i]).any(axis=1)]
                yield pd.DataFrame({"pack": numbers[i], "other": others})

    return packs.select("pack").mapInPandas(pair, "pack long, other long")


def links_of(packs: DataFrame, quantiser: Quantiser, kind: str) -> DataFrame:
    """Stored rows of two kinds: ``a`` with ``n`` other vectors linked to it, or ``a`` and ``b`` in one component."""
    known = packs.sparkSession.sparkContext.broadcast(quantiser)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for item in frame.itertuples(index=False):
                queries = Pack.of(known.value, kind, *(getattr(item, x) for x in PACKED[:6]))
                members = queries if item.pack == item.other else Pack.of(known.value, kind, *(getattr(item, f"other_{x}") for x in PACKED[:6]))
                yield links_between(known.value, queries, members, item.pack == item.other)

    fields = packs.drop("held", "probed")
    others = fields.select(*(F.col(x).alias("other" if x == "pack" else f"other_{x}") for x in fields.columns))
    pairs = pack_pairs(packs).join(fields, "pack").join(others, "other")
    return stored(pairs.mapInPandas(run, "a long, b long, n long"), "vector-links")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors`` (``vec_id``, ``embedding``).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing; nor do vectors of different lengths
    (each length has an index of its own). Repeated rows link with each other. Null ids are greater than all others. An empty table gives no rows.
    """
    kind = "<f4" if dict(vectors.dtypes)["embedding"] == "array<float>" else "<f8"
    rows = numbered(vectors, kind)
    valid = rows.filter("raw is not null")
    classes = valid.groupBy("print").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    classes = stored(classes.join(rows.select("row", "raw", "width"), "row"), "vector-classes")
    found = None
    for width, n in sorted((r.width, r.n) for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()):
        some = classes.filter(F.col("width") == width)
        spread = F.shiftrightunsigned(F.xxhash64("print"), 11) / F.lit(float(1 << 53))
        sample = some.filter(spread < min(1.0, 1.5 * SAMPLE / n)).orderBy("print").limit(SAMPLE).select("raw")
        x = unit_rows([bytes(r.raw) for r in sample.collect()] or [bytes(some.first().raw)], kind)
        quantiser = Quantiser.fit(x, min(MOST_LISTS, max(1, math.isqrt(n))), least)
        links = links_of(packs_of(some, quantiser, kind), quantiser, kind)
        found = links if found is None else found.union(links)
    if found is None:
        alone = F.lit(0).cast("long").alias("n_links")
        return rows.select("vec_id", alone, F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    named = valid.select(F.col("row").alias("member"), "print").join(classes.select("print", "row", "copies"), "print")
    named = stored(named.select("member", "row", "copies"), "vector-names")
    copies = named.filter("member <> row").select(F.col("member").alias("a"), F.col("row").alias("b"))
    labels = components(found.filter("b is not null").select("a", "b").union(copies))
    owners = labels.withColumnRenamed("id", "row").join(rows.select("row", "vec_id"), "row")
    order = F.struct(F.col("vec_id").isNull(), "vec_id")
    least_ids = owners.groupBy("component_id").agg(F.min(order).alias("least")).select("component_id", F.col("least.vec_id").alias("least_id"))
    owners = owners.join(least_ids, "component_id").select("row", "least_id", F.lit(True).alias("linked"))
    links = named.join(counts.withColumnRenamed("a", "row"), "row", "left")
    links = links.select(F.col("member").alias("row"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.select("row", "vec_id").join(links, "row", "left").join(owners, "row", "left")
    component = F.when(F.col("linked"), F.col("least_id")).otherwise(F.col("vec_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
