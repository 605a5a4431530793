"""Substring dedup on bytes: a suffix array by two-stage sorting over the places where long strings can repeat.

A string of ``LENGTH`` bytes is owned by one of its ``GRAM``-byte parts, the one with the least hash (the first of equals). Equal strings own
equal parts, so a string can repeat only if its part does. Parts are exchanged first; around each shared one the block cuts out a
*segment*: the bytes of all strings it owns, which start one after another. Segments go to the bucket of their part, equal ones once, so all equal strings meet
in one bucket. There a suffix array over the segments tells which strings share ``LENGTH`` bytes with a neighbour.

Two-stage sorting: a suffix whose first byte is greater than its second is of type A, all others are of type B. Only type B
suffixes are sorted directly (to ``LENGTH`` bytes). Type A suffixes are induced: going through the buckets of first bytes in
ascending order, each suffix puts the one that starts a byte before it, if that is of type A, at the next free place at the front of
its bucket; that bucket is always a later one. Adjacent common prefixes come last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.blocks import LOW, Block, Hits, pack, repeated_hashes, with_answers
from stagewise.llm.tables import stored
from stagewise.llm.words import mixed, runs_of

LENGTH, GRAM = 200, 40
SPAN = LENGTH - GRAM + 1
SLICE = 1_000_000
#: Up to so many strings are sorted on a copy of their bytes, more by their starts; the order is the same.
COPIED = 500_000
#: Bytes of text for each bucket of hashes, and of segments.
HASH_BYTES, SEGMENT_BYTES = 24_000_000, 2_000_000
BYTE_NUMBERS = mixed(np.arange(1, 257, dtype=np.uint64))
OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def owners(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owning parts of the strings of one run of bytes: place, hash, first and last start of the strings owned.

    Works through slices, so that memory does not follow the length of the text.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for start in range(0, max(0, len(text) - LENGTH + 1), SLICE):
        piece = text[start : start + SLICE + LENGTH - 1]
        hashes = runs_of(BYTE_NUMBERS[piece], GRAM)
        keys = (hashes & ~LOW) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while width * 2 <= SPAN:
            keys = np.minimum(keys[:-width], keys[width:])
            width *= 2
        n = len(piece) - LENGTH + 1
        keys = np.minimum(keys[:n], keys[SPAN - width : SPAN - width + n])
        place = (keys & LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        found.append((place[first] + start, hashes[place[first]], first + start, last + start))
    if not found:
        none = np.empty(0, np.int64)
        return none, none.astype(np.uint64), none, none
    place, hashes, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.diff(place, prepend=-1) != 0  # a part may own strings on both sides of a slice's end
    ends = np.append(np.flatnonzero(new)[1:], len(place)) - 1
    return place[new], hashes[new], first[new], last[ends] if len(place) else last


def block_owners(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owning parts of all documents of a block, places within the block; strings never cross documents."""
    text = np.frombuffer(block.data, np.uint8)
    parts = [owners(text[a:b]) for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True) if b - a >= LENGTH]
    starts = block.starts[:-1][np.diff(block.starts) >= LENGTH].tolist()
    if not parts:
        return owners(text[:0])
    place, hashes, first, last = zip(*parts, strict=True)
    moved = [np.concatenate([x + a for x, a in zip(part, starts, strict=True)]) for part in (place, first, last)]
    return moved[0], np.concatenate(hashes), moved[1], moved[2]


def in_order(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of the next ``LENGTH`` bytes, equal strings as they came."""
    if len(starts) <= COPIED:
        rows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)[starts]
        return starts[np.argsort(rows.view(f"S{LENGTH}").ravel(), kind="stable")]
    words = np.ndarray(len(text) - 7, ">u8", np.ascontiguousarray(text), strides=(1,))
    out, place, group = starts.copy(), np.arange(len(starts)), np.zeros(len(starts), np.int32)
    for at in range(0, LENGTH, 8):  # only strings that are equal so far go on
        keys = words[out[place] + at].astype(np.uint64)
        order = np.lexsort((keys, group))
        out[place], keys = out[place[order]], keys[order]
        new = np.append(True, (group[1:] != group[:-1]) | (keys[1:] != keys[:-1]))
        tied = ~(new & np.append(new[1:], True))
        place, group = place[tied], np.cumsum(new, dtype=np.int32)[tied]
        if not len(place):
            break
    return out


def suffix_order(text: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Starts in ``wanted`` (a mask over ``text``) in the order of the next ``LENGTH`` bytes; ``text`` ends in ``LENGTH`` bytes of padding."""
    n = len(text) - LENGTH
    falls = text[:n] > text[1 : n + 1]
    needed = wanted.copy()
    front = np.flatnonzero(needed & falls)
    while len(front):  # what a type A suffix is induced from
        front = front[front + 1 < n] + 1
        front = front[~needed[front]]
        needed[front] = True
        front = front[falls[front]]
    direct = np.flatnonzero(needed & ~falls)
    direct = in_order(text, direct)
    ends = np.searchsorted(text[direct], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    edge = np.flatnonzero(needed[n - 1 : n] & falls[n - 1 : n]) + n - 1  # induced by the padding
    for start in edge.tolist():
        induced[text[start]].append(np.array([start]))
    out = []
    for byte in range(256):
        here = np.concatenate([*induced[byte], direct[ends[byte] : ends[byte + 1]]])
        if not len(here):
            continue
        out.append(here)
        before = here[here > 0].astype(np.int64) - 1
        before = before[needed[before] & falls[before]]
        first = text[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        cuts = np.flatnonzero(np.diff(first)) + 1
        if len(before):
            for part in np.split(before, cuts):
                induced[text[part[0]]].append(part)
    order = np.concatenate(out) if out else np.empty(0, np.int64)
    return order[wanted[order]]


def common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to ``LENGTH``; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
    for a in range(1, len(order), 20_000):
        b = min(len(order), a + 20_000)
        differ = windows[order[a - 1 : b - 1]] != windows[order[a:b]]
        out[a:b] = np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)
    return out


def repeated_starts(segments: list[bytes]) -> list[np.ndarray]:
    """For each of some distinct segments, a mask of the strings in it that also stand elsewhere in them."""
    sizes = np.array([len(x) for x in segments])
    text = np.frombuffer(b"".join(segments) + bytes(LENGTH), np.uint8)
    ends = np.cumsum(sizes)
    marks = np.zeros(len(text) - LENGTH + 1, np.int8)
    marks[ends - sizes] += 1
    marks[ends - LENGTH + 1] -= 1
    order = suffix_order(text, np.cumsum(marks)[:-1] > 0)
    same = common_prefixes(text, order) >= LENGTH
    twice = np.zeros(len(text), bool)
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    return [twice[e - s : e - LENGTH + 1] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def _segments(block: Block, first: np.ndarray, last: np.ndarray) -> list[bytes]:
    return [block.data[a : b + LENGTH] for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove every byte covered by a ``LENGTH``-byte string that also starts anywhere else.

    Strings are judged on the input and never cross documents; both of two equal strings go. Null texts are empty. Returns for every row ``doc_id``, ``n_bytes``,
    ``n_removed``, ``n_spans`` (maximal removed runs), ``kept_sha256``. Repeated rows are repeats of each other. An empty table gives no rows.
    """
    blocks = pack(docs)
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n, n_sorts = (max(1, -(-n_bytes // x)) for x in (HASH_BYTES, SEGMENT_BYTES))
    hits = repeated_hashes(blocks, lambda block: (block_owners(block)[1], None), n)

    def cut_out(block: Block, answers: pd.DataFrame) -> pd.DataFrame:
        _, hashes, first, last = block_owners(block)
        hit = Hits(answers, n).among(hashes)
        bucket = (hashes[hit] % np.uint64(n_sorts)).astype(np.int64).tolist()
        counts: dict[tuple[int, bytes], int] = {}
        for key in zip(bucket, _segments(block, first[hit], last[hit]), strict=True):
            counts[key] = counts.get(key, 0) + 1
        by: dict[int, list[tuple[bytes, int]]] = {}
        for (b, segment), count in counts.items():
            by.setdefault(b, []).append((segment, count))
        out = [
            (
                b,
                block.block,
                b"".join(x for x, _ in found),
                np.array([len(x) for x, _ in found], "<i8").tobytes(),
                np.array([c > 1 for _, c in found], "u1").tobytes(),
            )
            for b, found in by.items()
        ]
        return pd.DataFrame(out, columns=["bucket", "block", "data", "sizes", "more"])

    def sort(frame: pd.DataFrame) -> pd.DataFrame:
        names: dict[bytes, int] = {}
        held: list[tuple[int, np.ndarray]] = []
        often: set[int] = set()
        for block, data, sizes, more in zip(frame["block"], frame["data"], frame["sizes"], frame["more"], strict=True):
            at, own = 0, []
            for size, many in zip(np.frombuffer(sizes, "<i8").tolist(), more, strict=True):
                segment = data[at : at + size]
                at += size
                n_known = len(names)
                name = names.setdefault(segment, n_known)
                if many or name < n_known:
                    often.add(name)
                own.append(name)
            held.append((block, np.array(own)))
        segments = list(names)
        masks = repeated_starts(segments)
        for name in often:
            masks[name][:] = True
        prints = np.array([xxhash.xxh3_64_intdigest(x) for x in segments], np.uint64)
        some = np.array([mask.any() for mask in masks], bool)
        out = []
        for block, own in held:
            own = own[some[own]]
            if len(own):
                packed = [np.packbits(masks[i]).tobytes() for i in own.tolist()]
                sizes = np.array([len(x) for x in packed], "<i4").tobytes()
                out.append((block, prints[own].tobytes(), sizes, b"".join(packed)))
        return pd.DataFrame(out, columns=["block", "prints", "sizes", "masks"])

    def cut(block: Block, answers: pd.DataFrame) -> pd.DataFrame:
        _, _, first, last = block_owners(block)
        told: dict[int, bytes] = {}
        for prints, sizes, masks in zip(answers["prints"], answers["sizes"], answers["masks"], strict=True):
            at = 0
            for key, size in zip(np.frombuffer(prints, "<u8").tolist(), np.frombuffer(sizes, "<i4").tolist(), strict=True):
                told[key] = masks[at : at + size]
                at += size
        marks = np.zeros(len(block.data) + 1, np.int32)
        if told:
            for segment, a, b in zip(_segments(block, first, last), first.tolist(), last.tolist(), strict=True):
                mask = told.get(xxhash.xxh3_64_intdigest(segment))
                if mask is not None:
                    twice = np.unpackbits(np.frombuffer(mask, np.uint8), count=b - a + 1)
                    edges = np.diff(twice.astype(np.int8), prepend=0, append=0)
                    marks[a + np.flatnonzero(edges > 0)] += 1
                    marks[a + np.flatnonzero(edges < 0) + LENGTH - 1] -= 1
        gone = np.cumsum(marks)[:-1] > 0
        data = np.frombuffer(block.data, np.uint8)
        rows = []
        for a, b in zip(block.starts[:-1].tolist(), block.starts[1:].tolist(), strict=True):
            lost = gone[a:b]
            n_lost = int(lost.sum())
            left = data[a:b][~lost] if n_lost else data[a:b]
            spans = int((np.diff(lost.astype(np.int8), prepend=0) > 0).sum()) if n_lost else 0
            rows.append((b - a, n_lost, spans, hashlib.sha256(left).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
        out.insert(0, "doc_id", block.keys())
        return out

    segments = with_answers(blocks, hits, cut_out, "bucket int, block long, data binary, sizes binary, more binary")
    masks = segments.groupBy("bucket").applyInPandas(sort, "block long, prints binary, sizes binary, masks binary")
    return with_answers(blocks, stored(masks, "masks"), cut, OUT)
