"""Vector code compression: vectors cut into parts, each part a one-byte index into a codebook fitted by integer k-means.

Assignments use adaptive distance bounds. Of each part of each vector are kept: its own entry with an upper bound of the distance, its ``b``
next closest entries with lower bounds in ascending order, and one outer bound. The lower bound at a place of the list holds for every entry from
that place on and for all entries beyond the list, the outer bound for those beyond it. When entries move, bounds loosen by how
far they moved. A part whose upper bound lies below its first lower bound keeps its entry unseen; any other is decided by
exact integer distances: to its own entry, then to the places the bounds leave open, then, if the outer bound fails too, to the whole
codebook. ``b`` starts at a quarter of the codebook and shrinks, per batch, to what was needed, down to an eighth.

Bounds are rounded outwards and only save work; every decision that they leave open, ties included, is made on integers.

Spark deals the rows. A state is written once to the shared folder and its predecessor dropped; sums of members are
added up per task and then by part and entry, so what reaches the driver are the codebooks: at most 16 x 64 rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.tables import dropped, if_small, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Greatest integer component and part length for which squared distances stay below 2^62.
MOST_COMPONENT, MOST_LENGTH = 1 << 24, 1 << 12
STATE = "ints binary, own binary, upper binary, near binary, lower binary, outer binary"


def rounded_up(values: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not below."""
    return np.nextafter(values.astype("f4"), np.float32(np.inf))


def rounded_down(values: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are not above."""
    return np.nextafter(values.astype("f4"), np.float32(-np.inf))


def squared(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of ``parts`` (n, length) to ``entries`` (k, length) or (n, k, length)."""
    out = np.zeros((len(parts), entries.shape[-2]), "i8")
    for j in range(parts.shape[1]):
        gap = parts[:, j, None] - entries[..., j]
        out += gap * gap
    return out


class Bounds:
    """State of one part position for a batch of vectors."""

    def __init__(self, own: np.ndarray, upper: np.ndarray, near: np.ndarray, lower: np.ndarray, outer: np.ndarray):
        self.own, self.upper, self.near, self.lower, self.outer = own, upper, near, lower, outer

    @classmethod
    def fresh(cls, parts: np.ndarray, book: np.ndarray, b: int) -> Bounds:
        """By distances to all entries."""
        found = cls(*(np.empty(0) for _ in range(5)))
        found.own, found.upper, found.near, found.lower, found.outer = cls.ranked(parts, book, b)
        return found

    @staticmethod
    def ranked(parts: np.ndarray, book: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
        """Own entry (ties to the lower index), upper bound, the next ``b`` entries with their bounds, outer bound."""
        far = squared(parts, book)
        order = np.argsort(far, axis=1, kind="stable")
        steps = np.sqrt(np.take_along_axis(far, order, 1).astype("f8"))
        beyond = steps[:, b + 1] if len(book) > b + 1 else np.full(len(parts), np.inf)
        lower = rounded_down(steps[:, 1 : b + 1])
        return order[:, 0].astype("u1"), rounded_up(steps[:, 0]), order[:, 1 : b + 1].astype("u1"), lower, rounded_down(beyond)

    def moved(self, parts: np.ndarray, book: np.ndarray, before: np.ndarray) -> int:
        """Assign anew after the entries moved from ``before`` to ``book``; returns how many places of a list were needed at most."""
        b = self.near.shape[1]
        shift = np.sqrt(((book - before).astype("f8") ** 2).sum(1)) * (1 + 1e-12)
        self.upper = rounded_up(self.upper.astype("f8") + shift[self.own])
        self.outer = rounded_down(self.outer.astype("f8") - shift.max())
        lower = self.lower.astype("f8") - shift[self.near]
        lower = np.minimum.accumulate(np.concatenate([lower, self.outer[:, None].astype("f8")], 1)[:, ::-1], 1)[:, ::-1]
        self.lower = rounded_down(lower[:, :b])
        first = self.lower[:, 0] if b else self.outer
        rows = np.flatnonzero(self.upper >= first)
        if not len(rows):
            return 0
        mine = squared(parts[rows], book[self.own[rows]][:, None, :])[:, 0]
        self.upper[rows] = rounded_up(np.sqrt(mine.astype("f8")))
        open_places = (self.lower[rows] <= self.upper[rows, None]).sum(1)
        whole = self.outer[rows] <= self.upper[rows]
        for z in np.unique(open_places[~whole & (open_places > 0)]).tolist():
            at = (open_places == z) & ~whole
            self._settled(rows[at], z, mine[at], parts, book)
        if whole.any():
            at = rows[whole]
            found = self.ranked(parts[at], book, b)
            self.own[at], self.upper[at], self.near[at], self.lower[at], self.outer[at] = found
        return int(open_places.max())

    def _settled(self, rows: np.ndarray, z: int, mine: np.ndarray, parts: np.ndarray, book: np.ndarray) -> None:
        """Put the own entry and the first ``z`` of the list in order of exact distance, ties to the lower index."""
        names = np.concatenate([self.own[rows, None], self.near[rows, :z]], 1)
        far = np.concatenate([mine[:, None], squared(parts[rows], book[self.near[rows, :z]])], 1)
        order = np.lexsort((names, far), axis=1)
        names, steps = np.take_along_axis(names, order, 1), np.sqrt(np.take_along_axis(far, order, 1).astype("f8"))
        rest = self.lower[rows, z] if z < self.near.shape[1] else self.outer[rows]
        self.own[rows], self.upper[rows] = names[:, 0], rounded_up(steps[:, 0])
        self.near[rows, :z] = names[:, 1:]
        self.lower[rows, :z] = np.minimum(rounded_down(steps[:, 1:]), rest[:, None])

    def narrowed(self, b: int) -> None:
        """Keep ``b`` places of the lists; the bound of the first one given up becomes the outer bound."""
        if b < self.near.shape[1]:
            self.outer = np.minimum(self.outer, self.lower[:, b])
            self.near, self.lower = self.near[:, :b], self.lower[:, :b]


def state_of(bounds: list[Bounds], n: int) -> list[pa.Array]:
    """Binary columns of a batch, one value per vector. Lists of all parts have one length in a batch."""
    return [
        _binary(np.stack([getattr(x, name) for x in bounds], 1).astype(kind, copy=False), n)
        for name, kind in (("own", "u1"), ("upper", "f4"), ("near", "u1"), ("lower", "f4"), ("outer", "f4"))
    ]


def bounds_of(columns: dict[str, pa.Array], n: int) -> list[Bounds]:
    """The reverse of ``state_of`` for rows whose lists have one length."""
    raw = {
        name: _array(columns[name], n, kind)
        for name, kind in (("own", "u1"), ("upper", "f4"), ("near", "u1"), ("lower", "f4"), ("outer", "f4"))
    }
    lists = {name: raw[name].reshape(n, PARTS, raw[name].shape[1] // PARTS) for name in ("near", "lower")}
    return [
        Bounds(*(raw[k][:, p].copy() for k in ("own", "upper")), *(lists[k][:, p].copy() for k in ("near", "lower")), raw["outer"][:, p].copy())
        for p in range(PARTS)
    ]


def _binary(values: np.ndarray, n: int) -> pa.Array:
    """Rows of an array as binary values."""
    data = np.ascontiguousarray(values)
    offsets = np.arange(n + 1, dtype="i8") * (data.nbytes // n)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _array(column: pa.Array, n: int, kind: str) -> np.ndarray:
    """Binary values of one length as rows of an array."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(n, len(values[0]) // np.dtype(kind).itemsize)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id``, ``label``, ``embedding`` of the rows whose vector is there and holds finite numbers only."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", "label", "embedding")


def first_books(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """(parts, entries, length) integers of the first vectors by id, nulls last; None without a vector that can be cut."""
    cut = rows.filter((F.size("embedding") > 0) & (F.size("embedding") % parts == 0)).select("vec_id", "embedding")
    order = [F.col("vec_id").asc_nulls_last(), F.col("embedding")]
    width = cut.orderBy(*order).select(F.size("embedding").alias("n")).first()
    if width is None or width.n // parts > MOST_LENGTH:
        return None
    alike = cut.filter((F.size("embedding") == width.n) & _in_range())
    found = alike.orderBy(*order).limit(entries).collect()
    if not found:
        return None
    ints = np.floor(np.array([row.embedding for row in found], "f8") * SCALE).astype("i8")
    return np.ascontiguousarray(ints.reshape(len(found), parts, -1).transpose(1, 0, 2))


def _in_range():
    """Whether all components stay within the exact range."""
    return F.forall("embedding", lambda x: F.abs(x) < MOST_COMPONENT / SCALE)


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` for every usable row of ``vec_id``, ``embedding``, ``label``.

    Rows without a vector, or whose vector holds a null or non-finite component, are left out. Repeated rows count as often
    as they occur; null ids come after all others; the ties of a repeated id go by the vector. Fewer than 64 vectors make smaller codebooks.
    A vector whose length differs from that of the first one that can be cut into 16 parts, or with a component of 65,536 or more, takes no part: its
    code and error are null. Other columns are ignored. An empty table gives an empty result.
    """
    rows = usable(vectors)
    books = first_books(rows, PARTS, ENTRIES)
    if books is None:
        books = np.empty((PARTS, 0, 0), "i8")
        coded = rows.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
        return _with_label_error(coded, books)
    fits = (F.size("embedding") == books.shape[0] * books.shape[2]) & _in_range()
    state = stored(_started(rows.filter(fits), books), "codes")
    for step in range(rounds):
        before, books = books, moved_books(state, books)
        last = step == rounds - 1
        after = stored(_coded(state, before, books) if last else _reassigned(state, before, books), "codes")
        dropped(state)
        state = after
    if not rounds:
        after = stored(_coded(state, books, books), "codes")
    odd = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return _with_label_error(after.unionByName(odd), books)


def _with_label_error(coded: DataFrame, books: np.ndarray) -> DataFrame:
    """Add the errors summed over equal labels, nulls together, and the hash of the codebooks."""
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "errors")
    joined = coded.join(if_small(sums), F.col("label").eqNullSafe(F.col("_label")), "left")
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _schema_of(frame: DataFrame, columns: str) -> str:
    """``vec_id`` and ``label`` as they are, and more columns."""
    kinds = dict(frame.dtypes)
    return f"vec_id {kinds['vec_id']}, label {kinds['label']}, {columns}"


def _started(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """First state, by distances to all entries."""
    shape, kinds = books.shape, _schema_of(rows, STATE)
    b = min(max(1, shape[1] // 4), shape[1] - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, labels, vectors = batch.columns
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
            ints = np.floor(flat * SCALE).astype("i8").reshape(len(ids), shape[0], shape[2])
            bounds = [Bounds.fresh(ints[:, p], books[p], b) for p in range(shape[0])]
            yield _batch([ids, labels, _binary(ints.astype("<i4"), len(ids)), *state_of(bounds, len(ids))], STATE)

    return rows.mapInArrow(run, kinds)


def _batch(columns: list[pa.Array], names: str) -> pa.RecordBatch:
    """A batch of ``vec_id``, ``label`` and the named columns."""
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", *(x.split()[0] for x in names.split(", "))])


def _by_list_length(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split batches where the length of the lists changes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array([len(x) for x in batch.column("near").to_pylist()])
        edges = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), len(sizes)]
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, z - a)


def _moved(batch: pa.RecordBatch, before: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, list[Bounds], int]:
    """Integers, new bounds and the most places of a list that were needed."""
    n = batch.num_rows
    ints = _array(batch.column("ints"), n, "<i4").astype("i8").reshape(n, books.shape[0], books.shape[2])
    bounds = bounds_of({name: batch.column(name) for name in batch.schema.names}, n)
    needed = max(bounds[p].moved(ints[:, p], books[p], before[p]) for p in range(len(bounds)))
    return ints, bounds, needed


def _reassigned(state: DataFrame, before: np.ndarray, books: np.ndarray) -> DataFrame:
    """Next state, with lists as long as this one needed, an eighth of the codebook at least."""
    least = max(1, books.shape[1] // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_list_length(batches):
            _, bounds, needed = _moved(batch, before, books)
            for part in bounds:
                part.narrowed(max(least, needed))
            yield _batch([*batch.columns[:3], *state_of(bounds, batch.num_rows)], STATE)

    return state.mapInArrow(run, _schema_of(state, STATE))


def _coded(state: DataFrame, before: np.ndarray, books: np.ndarray) -> DataFrame:
    """Codes as hex digits and exact errors after the last move."""
    columns = "code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_list_length(batches):
            ints, bounds, _ = _moved(batch, before, books)
            own = np.stack([x.own for x in bounds], 1)
            error = np.zeros(len(own), "i8")
            for p in range(own.shape[1]):
                gap = ints[:, p] - books[p][own[:, p]]
                error += (gap * gap).sum(1)
            codes = pa.array([row.tobytes().hex() for row in own], pa.string())
            yield _batch([*batch.columns[:2], codes, pa.array(error)], columns)

    return state.mapInArrow(run, _schema_of(state, columns))


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of the mean of its members; an entry without members stays."""
    parts, entries, length = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(parts * entries, "i8"), np.zeros((parts * entries, length), "i8")
        for batch in batches:
            n = batch.num_rows
            if n:
                ints = _array(batch.column("ints"), n, "<i4").astype("i8").reshape(n * parts, length)
                at = (_array(batch.column("own"), n, "u1").astype("i8") + np.arange(parts) * entries).reshape(-1)
                count += np.bincount(at, minlength=len(count))
                np.add.at(total, at, ints)
        used = np.flatnonzero(count)
        sums = pa.array(list(total[used]), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(count[used]), sums], ["entry", "n", "sums"])

    partial = state.select("ints", "own").mapInArrow(run, "entry long, n long, sums array<long>")
    exact = "decimal(38,0)"
    sums = [F.sum(F.col("sums")[j].cast(exact)).alias(f"s{j}") for j in range(length)]
    out = books.copy().reshape(-1, length)
    for row in partial.groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[row.entry] = [int(row[f"s{j}"]) // int(row.n) for j in range(length)]
    return out.reshape(books.shape)
