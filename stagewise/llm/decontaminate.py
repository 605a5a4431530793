"""Benchmark decontamination by the q-gram lemma.

An item of ``m`` characters that occurs in a document with at most ``k`` edits shares at least ``m + 1 - q (k + 1)`` of its q-grams
with that place, and all of them lie on ``k + 1`` neighbouring diagonals (place in the document minus place in the item). So the
q-grams a document shares with an item are counted in bands of ``2 (k + 1)`` diagonals that overlap by half; bands that reach
the bound are kept, and only those are aligned, within the band. Texts are lower-cased and runs of white space count as one blank.

``q`` is 8, or less for items under 40 characters, the most that leaves the bound at one: so every item has its full budget, and one under ten
characters is searched for as it is. A text is worked through in overlapping stretches, and what an item shares with a stretch is written out
a bounded number of pairs at a time. Where an item and a stretch share one q-gram at so many places that the counts say nothing (rulers, tables,
blank forms), the item is aligned with the whole stretch instead.

Documents are never shuffled. The index of the items goes to every task: items are taken in blocks of bounded size, one pass over the
documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Longest q-gram.
Q = 8
#: Edits allowed per character of an item.
EDIT_RATE = 0.1
#: Characters of items that one pass searches for.
BLOCK_CHARS = 4_000_000
TABLE_BITS = 22
#: Characters of a text searched at a time, shared q-grams (pairs of places) of an item beyond which it is aligned without them, and pairs
#: written out at a time.
STRETCH, MOST_PAIRS, PAIRS_AT_ONCE = 65_536, 262_144, 2_000_000
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def normal(text: str) -> str:
    """Lower case, with single blanks."""
    return " ".join(text.lower().split())


def codes_of(text: str) -> np.ndarray:
    """One byte per character: itself below 256, else folded. Equal characters have equal bytes."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(points < 256, points, (points * 40503 >> 8) & 255).astype(np.uint8)


def grams_of(codes: np.ndarray, q: int = Q) -> np.ndarray:
    """The q-gram at each place, as one number."""
    if len(codes) < q:
        return np.empty(0, np.uint64)
    whole = np.ndarray(len(codes) - q + 1, "<u8", codes.tobytes() + bytes(Q - q), strides=(1,))
    return whole & np.uint64((1 << 8 * q) - 1)


def budget_of(length: int) -> int:
    """Edits allowed in an item."""
    return int(EDIT_RATE * length + 1e-9)


def gram_length(length: int) -> int:
    """Longest q up to ``Q`` for which an item with all its edits still shares a q-gram."""
    return min(Q, length // (budget_of(length) + 1))


@dataclass
class GramIndex:
    """q-grams of the items that have the same ``q``."""

    q: int
    texts: list[str]
    ids: np.ndarray
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    table: np.ndarray
    stretch: int
    overlap: int

    @classmethod
    def of(cls, q: int, pairs: list[tuple[int, str]]) -> GramIndex:
        """Index of (id, normalised text) pairs."""
        per = [grams_of(codes_of(t), q) for _, t in pairs]
        every = np.concatenate([np.empty(0, np.uint64), *per])
        item = np.repeat(np.arange(len(per)), [len(g) for g in per])
        place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in per]]).astype(np.int64)
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        length = np.array([len(t) for _, t in pairs], np.int64)
        budget = np.array([budget_of(n) for n in length.tolist()], np.int64)
        table = np.zeros(1 << TABLE_BITS, bool)
        table[slots_of(grams)] = True
        overlap = int((length + budget).max(initial=0))
        return cls(
            q,
            [t for _, t in pairs],
            np.array([i for i, _ in pairs], np.int64),
            budget,
            length + 1 - q * (budget + 1),
            grams,
            np.append(first, len(every)),
            item[order],
            place[order],
            table,
            max(STRETCH, 4 * overlap),
            overlap,
        )

    def leaks(self, text: str, codes: np.ndarray) -> dict[int, tuple[int, int, int]]:
        """(start, end, edits) of the best occurrence of each item in a normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        for start in range(0, max(1, len(text) - self.overlap), self.stretch):
            stop = start + self.stretch + self.overlap
            part = text if start == 0 and stop >= len(text) else text[start:stop]
            for i, (low, high, edits) in self._within(part, codes[start:stop], best).items():
                if i not in best or edits < best[i][2]:
                    best[i] = (low + start, high + start, edits)
        return best

    def _within(self, text: str, codes: np.ndarray, known: dict[int, tuple[int, int, int]]) -> dict[int, tuple[int, int, int]]:
        """The best occurrences in a stretch, of items that are not known to occur without edits."""
        grams = grams_of(codes, self.q)
        at = np.flatnonzero(self.table[slots_of(grams)])
        if len(at) < self.bound.min(initial=1):
            return {}
        found = np.searchsorted(self.grams, grams[at])
        same = self.grams[np.minimum(found, len(self.grams) - 1)] == grams[at]
        at, found = at[same], found[same]
        different, times = np.unique(found, return_counts=True)
        entry = self._entries(different)
        pairs = np.bincount(self.item[entry], np.repeat(times, self.first[different + 1] - self.first[different]), len(self.texts))
        pairs[[i for i, hit in known.items() if hit[2] == 0]] = 0
        out: dict[int, tuple[int, int, int]] = {}
        many = pairs > MOST_PAIRS
        for i in np.flatnonzero(many).tolist():
            if hit := anywhere(self.texts[i], text, int(self.budget[i])):
                out[i] = hit
        few = np.flatnonzero((pairs >= self.bound) & ~many)
        for group in np.split(few, np.flatnonzero(np.diff(np.cumsum(pairs[few]) // PAIRS_AT_ONCE)) + 1):
            if len(group):
                self._banded(text, at, found, group, out)
        return out

    def _entries(self, found: np.ndarray) -> np.ndarray:
        """Places in the index of the entries of some q-grams, one q-gram after another."""
        counts = self.first[found + 1] - self.first[found]
        return np.repeat(self.first[found] - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))

    def _banded(self, text: str, at: np.ndarray, found: np.ndarray, items: np.ndarray, out: dict[int, tuple[int, int, int]]) -> None:
        """Count shared q-grams of some items by band, and align where a band reaches the bound."""
        wanted = np.zeros(len(self.texts), bool)
        wanted[items] = True
        different, own = np.unique(found, return_inverse=True)
        entry = self._entries(different)
        whose = np.repeat(np.arange(len(different)), self.first[different + 1] - self.first[different])
        keep = wanted[self.item[entry]]
        entry, whose = entry[keep], whose[keep]
        counts = np.bincount(whose, minlength=len(different))
        first = np.cumsum(counts) - counts
        each = counts[own]
        pick = np.repeat(first[own] - np.cumsum(each) + each, each) + np.arange(int(each.sum()))
        entry = entry[pick]
        item = self.item[entry]
        diagonal = np.repeat(at, each) - self.place[entry]
        band = diagonal // (self.budget[item] + 1)
        shift = np.int64(1 << 32)
        key = item * (shift << 1) + band + shift // 2
        keys, shared = np.unique(np.concatenate([key, key - 1]), return_counts=True)
        item = keys // (shift << 1)
        kept = shared >= self.bound[item]
        for i, b in zip(item[kept].tolist(), (keys[kept] % (shift << 1) - shift // 2).tolist(), strict=True):
            if i in out and out[i][2] == 0:
                continue
            budget = int(self.budget[i])
            low = b * (budget + 1)
            hit = aligned(self.texts[i], text, low, low + 2 * (budget + 1) - 1, budget)
            if hit and (i not in out or hit[2] < out[i][2]):
                out[i] = hit


@dataclass
class ItemIndex:
    """A block of items, by the length of their q-grams."""

    parts: list[GramIndex]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> ItemIndex:
        """Index of (id, text) pairs; those without id or text, or of nothing but white space, are left out."""
        by_length: dict[int, list[tuple[int, str]]] = {}
        for i, text in items:
            if i is not None and text and (text := normal(text)):
                by_length.setdefault(gram_length(len(text)), []).append((i, text))
        return cls([GramIndex.of(q, pairs) for q, pairs in sorted(by_length.items())])

    def leaks(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the best occurrence of each item in a text; places in the normalised text."""
        text = normal(text)
        codes = codes_of(text)
        return sorted((int(part.ids[i]), *hit) for part in self.parts for i, hit in part.leaks(text, codes).items())


def slots_of(grams: np.ndarray) -> np.ndarray:
    """Places of q-grams in the table that tells at once which cannot be in an item."""
    with np.errstate(over="ignore"):
        return (grams * SPREAD) >> np.uint64(64 - TABLE_BITS)


def aligned(item: str, text: str, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item within the diagonals ``low`` to ``high`` of a text, widened by the budget.

    Returns (start, end, edits) or None where more than ``budget`` edits are needed. Row ``i`` of the table holds, for each diagonal,
    the edits of the first ``i`` characters ending there; deletions move one diagonal down, insertions one up.
    """
    low, high = low - budget, high + budget
    exact = text.find(item, max(0, low), max(0, high) + len(item))
    if exact >= 0:
        return exact, exact + len(item), 0
    if budget == 0:
        return None
    far = budget + 1
    width = high - low + 1
    base = np.arange(width)
    ends = base + low
    cost = np.where((ends >= 0) & (ends <= len(text)), 0, far)
    a = np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4")
    around = np.zeros(max(0, high + len(a) + 1) + max(0, -low) + 1, np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    pad = max(0, -low)
    usable = points[: max(0, len(around) - pad)]
    around[pad : pad + len(usable)] = usable + 1
    for i, letter in enumerate(a.tolist(), 1):
        before = around[pad + low + i - 1 : pad + low + i - 1 + width]
        step = cost + (before != letter + 1)
        step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
        step = np.minimum.accumulate(step - base) + base
        ends = base + low + i
        cost = np.where((ends >= 0) & (ends <= len(text)), step, far)
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    stop = end + low + len(a)
    return max(0, stop - len(a)), stop, int(cost[end])


def anywhere(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """Best alignment of the whole item with any part of a text: (start, end, edits), or None beyond ``budget`` edits."""
    exact = text.find(item)
    if exact >= 0:
        return exact, exact + len(item), 0
    if budget == 0:
        return None
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    base = np.arange(len(points) + 1, dtype="i4")
    cost = np.zeros(len(points) + 1, "i4")
    for letter in np.frombuffer(item.encode("utf-32-le", "surrogatepass"), "<u4"):
        step = cost + 1
        np.minimum(step[1:], cost[:-1] + (points != letter), out=step[1:])
        step -= base
        np.minimum.accumulate(step, out=step)
        step += base
        cost = step
        if cost.min() > budget:
            return None
    stop = int(cost.argmin())
    return max(0, stop - len(item)), stop, int(cost[stop])


def item_blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[ItemIndex]:
    """Indexes of the items, a bounded block at a time. Rows without text or id do not count; copies count once."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    items = items.filter("item_id is not null and text is not null").distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-chars // most)
    for block in range(n):
        rows = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == block)
        yield ItemIndex.of([(row.item_id, row.text) for row in rows.orderBy("item_id", "text").collect()])


def leaks_in(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document row and item that occurs in it: ``doc_id``, ``item_id``, ``start``, ``end``, ``edits``.

    The best occurrence is told, the first of equals, in the normalised text. An item occurs where at most a tenth of its
    characters differ, rounded down; one under ten characters wherever it stands as it is, so items that tell nothing by themselves should not be in
    the benchmark. Null and empty texts hold nothing; null ids are kept; an empty table or benchmark gives no rows; repeated rows repeat their findings.
    """
    schema = "item_id long, start long, end long, edits long"
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {schema}")
    for index in item_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf(f"array<struct<{schema.replace(' long', ':long')}>>")
        def search(texts: pd.Series) -> pd.Series:
            names = ("item_id", "start", "end", "edits")
            return pd.Series([[dict(zip(names, x, strict=True)) for x in known.value.leaks(text)] if text else [] for text in texts])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(search("text")).alias("leak"))
        out = out.union(found.select("doc_id", "leak.*"))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows, with all their columns, that hold no item; rows without text hold none."""
    for index in item_blocks(benchmark):
        known = docs.sparkSession.sparkContext.broadcast(index)

        @F.pandas_udf("boolean")
        def clean(texts: pd.Series) -> pd.Series:
            return pd.Series([not text or not known.value.leaks(text) for text in texts], dtype=bool)

        docs = docs.filter(clean("text"))
    return docs
