"""Substring dedup on words: fixed-block anchors, and windows around the hits.

Every document is cut into non-overlapping reference blocks of ``ANCHOR`` words, which are indexed; every rolling window of as many words of
every document probes the index. A window of ``WINDOW`` words holds a whole reference block wherever it starts, so a repeated
window has a reference block that was probed from elsewhere. Around such hits, and only there, the windows of full length are compared by
hash: the one that starts first stays, all others mark their words; overlapping marks make up the maximal repeats.

Hashes of a full window have 64 bits and those of the bucket they go to.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.blocks import Block, Hits, by_bucket, opened, pack, pressed, repeated_hashes, squeezed, unsqueezed, with_answers
from stagewise.llm.tables import stored
from stagewise.llm.words import numbers_of, runs_of

WINDOW, ANCHOR = 20, 10
#: Bytes of text for each bucket of hashes.
BUCKET_BYTES = 12_000_000
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class BlockWords:
    """Words of a block, one document after another."""

    def __init__(self, block: Block):
        self.words = [text.split() for text in block.texts()]
        self.sizes = np.array([len(x) for x in self.words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.numbers = np.concatenate([np.empty(0, np.uint64), *[numbers_of(x) for x in self.words]])
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.place = np.arange(len(self.numbers)) - self.starts[self.doc]

    def whole(self, size: int) -> np.ndarray:
        """Where runs of ``size`` words start that stay within a document."""
        return np.flatnonzero(self.place + size <= self.sizes[self.doc])

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of those runs."""
        at = self.whole(size)
        hashes = runs_of(self.numbers, size)
        return at, hashes[at] if len(at) else np.empty(0, np.uint64)


def anchors(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Probes of a block, and which of them are reference blocks."""
    words = BlockWords(block)
    at, hashes = words.runs(ANCHOR)
    return hashes, words.place[at] % ANCHOR == 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Remove the words of every 20-word window whose words also start earlier.

    Earlier is a smaller ``doc_id``, or the same document and an earlier start; windows are judged on the input. Null ids come first; rows with the same
    id are ordered by text within a block, else by block. Null texts have no words. Returns for every row ``doc_id``, ``n_words``,
    ``n_removed``, ``kept_sha256`` (of the kept words joined by one blank). An empty table gives no rows.
    """
    blocks = pack(docs)
    n_bytes = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    n = max(1, -(-n_bytes // BUCKET_BYTES))
    hits = repeated_hashes(blocks, anchors, n)

    def extend(block: Block, answers: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "block", "keys", "docs"]
        words = BlockWords(block)
        at, hashes = words.runs(ANCHOR)
        known = Hits(answers, n)
        hit = np.zeros(len(words.numbers) + 1, np.int64)
        fixed = words.place[at] % ANCHOR == 0
        hit[at[fixed][known.among(hashes[fixed])]] = 1
        sums = np.concatenate([[0], np.cumsum(hit)])
        starts, full = words.runs(WINDOW)
        near = sums[starts + WINDOW - ANCHOR + 1] > sums[starts]
        starts, full = starts[near], full[near]
        out = []
        for bucket, of in by_bucket(full, n):
            keys, first = np.unique(full[of], return_index=True)
            doc = words.doc[starts[of[first]]]
            order = np.where(block.nulls[doc] > 0, np.iinfo(np.int64).min, block.ids[doc])
            out.append((bucket, block.block, pressed(keys), squeezed(order.astype("<i8"))))
        return pd.DataFrame(out, columns=columns)

    def judge(frame: pd.DataFrame) -> pd.DataFrame:
        keys = [opened(x, np.uint64) for x in frame["keys"]]
        sizes = [len(x) for x in keys]
        every = np.concatenate(keys)
        first = np.concatenate([unsqueezed(x, "<i8") for x in frame["docs"]])
        block = np.repeat(frame["block"].to_numpy(np.int64), sizes)
        order = np.lexsort((block, first, every))
        later = np.zeros(len(every), bool)
        later[order[1:]] = every[order[1:]] == every[order[:-1]]
        ends = np.cumsum(sizes)
        out = [(b, int(frame["bucket"].iloc[0]), pressed(every[e - s : e][later[e - s : e]])) for b, s, e in zip(frame["block"], sizes, ends, strict=True)]
        return pd.DataFrame([x for x in out if x[2]], columns=["block", "bucket", "later"])

    def cut(block: Block, answers: pd.DataFrame) -> pd.DataFrame:
        words = BlockWords(block)
        at, full = words.runs(WINDOW)
        drop = np.zeros(len(full), bool)
        later = {int(b): opened(x, np.uint64) for b, x in zip(answers["bucket"], answers["later"], strict=True)}
        for bucket, of in by_bucket(full, n):
            own = full[of]
            _, first = np.unique(own, return_index=True)
            here = np.ones(len(own), bool)
            here[first] = False
            if bucket in later:
                here |= np.isin(own, later[bucket])
            drop[of] = here
        marks = np.zeros(len(words.numbers) + 1, np.int64)
        np.add.at(marks, at[drop], 1)
        np.add.at(marks, at[drop] + WINDOW, -1)
        gone = np.cumsum(marks)[:-1] > 0
        rows = []
        for start, kept in zip(words.starts.tolist(), words.words, strict=True):
            lost = gone[start : start + len(kept)]
            if lost.any():
                kept = [w for w, x in zip(kept, lost.tolist(), strict=True) if not x]
            rows.append((len(lost), int(lost.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
        out.insert(0, "doc_id", block.keys())
        return out

    windows = with_answers(blocks, hits, extend, "bucket int, block long, keys binary, docs binary")
    later = windows.groupBy("bucket").applyInPandas(judge, "block long, bucket int, later binary")
    return with_answers(blocks, stored(later, "later"), cut, OUT)
