"""Quality by positive-unlabelled learning: minimise the non-negative unbiased risk.

Trusted positives are training rows labelled as good; unlabelled rows are texts of the training part whatever their labels. With the class
prior ``p`` of good texts among the unlabelled, the risk of a scorer ``f`` under the loss ``l`` is

    p * E_pos[l(f)] + max(0, E_unl[l(-f)] - p * E_pos[l(-f)])

where the second part, the risk on the negatives nobody has labelled, is kept from falling below zero. The prior is estimated
first: a plain scorer of positives against unlabelled rows ranks both, and the prior is the least ratio of the unlabelled to the
positive share over all sets of top scores that hold enough positives. The scorer is a small network on dense features, fitted in
numpy on a bounded sample; features and scores of all texts are computed by Spark.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stagewise.llm.samples import labelled_sample
from stagewise.llm.tables import fold_of

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
#: Bounds of the two samples.
POSITIVES, UNLABELLED = 12_000, 16_000
HIDDEN, STEPS, BATCH, RATE = 24, 1_500, 1_024, 0.01
SIGNS = re.compile(r"[^\w\s.,;:!?'\"()-]")
SENTENCE_ENDS = (".", "!", "?")


def features_of(text: str | None) -> list[float]:
    """Dense features of a text; an empty one has zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * 20
    n, size = len(words), len(text)
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    data = text.encode("utf-8", "ignore")
    signs = len(SIGNS.findall(text))
    signed = sum(c for w, c in counts.items() if not w[-1].isalnum() and w[-1] not in ".,;:!?'\")")
    upper = sum(c for w, c in counts.items() if len(w) > 1 and w.isupper())
    ends = sum(c for w, c in counts.items() if w.endswith(SENTENCE_ENDS))
    digits = sum(c for w, c in counts.items() if any(map(str.isdigit, w)))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    doubled = sum(c for w, c in counts.items() if w.endswith(("!!", "??", "..")))
    short = sum(c for w, c in counts.items() if len(w) <= 3)
    return [
        math.log1p(n),
        size / n,
        len(counts) / n,
        len(counts) / math.sqrt(n),
        same / n,
        counts.most_common(1)[0][1] / n,
        upper / n,
        sum(c for w, c in counts.items() if w[0].isupper()) / n,
        digits / n,
        signs / size,
        signed / n,
        doubled / n,
        text.count("!") / size,
        text.count("|") / size,
        ends / n,
        short / n,
        len(set(lines)) / len(lines),
        math.log1p(n / len(lines)),
        len(zlib.compress(data, 1)) / len(data),
        max(map(len, counts)) / 20,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _features(texts: pd.Series) -> pd.Series:
    return pd.Series([np.array(features_of(text)) for text in texts])


class Scorer:
    """One hidden layer over standardised features."""

    def __init__(self, width: int, seed: int = 5):
        chance = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width), np.ones(width)
        self.weights = [chance.normal(0, 0.3, (width, HIDDEN)), np.zeros(HIDDEN), chance.normal(0, 0.3, HIDDEN), np.zeros(1)]
        self.chance = chance

    def inner(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[0] + self.weights[1])

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Score before the logistic function."""
        return self.inner(x) @ self.weights[2] + self.weights[3]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None) -> Scorer:
        """Minimise the non-negative risk, or, without a prior, tell positives from unlabelled rows. Adam on small batches."""
        both = np.concatenate([positive, unlabelled])
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-6
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        for step in range(1, STEPS + 1):
            pos = positive[self.chance.integers(0, len(positive), BATCH)]
            unl = unlabelled[self.chance.integers(0, len(unlabelled), BATCH)]
            x = np.concatenate([pos, unl])
            h = self.inner(x)
            f = h @ self.weights[2] + self.weights[3]
            good = 1 / (1 + np.exp(-np.clip(f, -30, 30)))  # slope of the loss of -f; that of f is good - 1
            slope = np.empty_like(f)
            if prior is None:
                slope[:BATCH], slope[BATCH:] = (good[:BATCH] - 1) / BATCH, good[BATCH:] / BATCH
            else:
                loss = np.logaddexp(0, f)
                rest = loss[BATCH:].mean() - prior * loss[:BATCH].mean()
                if rest >= 0:
                    slope[:BATCH] = prior * (good[:BATCH] - 1 - good[:BATCH]) / BATCH
                    slope[BATCH:] = good[BATCH:] / BATCH
                else:  # the negative part is overfitted: take it back
                    slope[:BATCH] = prior * good[:BATCH] / BATCH
                    slope[BATCH:] = -good[BATCH:] / BATCH
            back = slope[:, None] * self.weights[2] * (1 - h * h)
            z = np.clip((x - self.mean) / self.scale, -8, 8)
            grads = [z.T @ back, back.sum(axis=0), h.T @ slope, slope.sum(keepdims=True)]
            rate = RATE * (1 - step / (STEPS + 1))
            for w, g, a, b in zip(self.weights, grads, first, second, strict=True):
                g = g + 1e-5 * w
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
        return self


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled: the least ratio of upper tails, with a margin for their sampling error."""
    plain = Scorer(positive.shape[1]).fit(positive[::2], unlabelled[::2], None)
    p, u = np.sort(plain.margins(positive[1::2])), np.sort(plain.margins(unlabelled[1::2]))
    if not len(p) or not len(u):
        return 0.5
    cuts = p[: max(1, int(0.9 * len(p)))]
    share_p = 1 - np.searchsorted(p, cuts) / len(p)
    share_u = 1 - np.searchsorted(u, cuts) / len(u)
    error = np.sqrt(math.log(100) / (2 * len(p))) + np.sqrt(math.log(100) / (2 * len(u)))
    best = int(np.argmin((share_u + error) / share_p))
    return float(min(0.99, max(0.01, share_u[best] / share_p[best])))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row, repeated ones too; learned from rows that are not held out.

    Null and empty texts have zero features and get the score of those. Without any positive or any unlabelled row all scores are 0.5.
    """
    fold = fold_of(F.col("doc_id"), FOLDS)
    train = fold != HELD_OUT
    good = labelled_sample(docs, labels, "quality", train, {1: POSITIVES}).select(_features("text").alias("x"))
    n = docs.filter(train).count()
    share = min(1.0, 2.0 * UNLABELLED / max(1, n))
    spread = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("unlabelled")), 11) / F.lit(float(1 << 53))
    some = docs.filter(train & (spread < share)).select(_features("text").alias("x"), spread.alias("spread"))
    other = some.orderBy("spread", "x").limit(UNLABELLED)
    positive, unlabelled = (np.array([row.x for row in x.collect()], float) for x in (good, other))
    keys = [F.col("doc_id"), (fold == HELD_OUT).alias("held_out")]
    if len(positive) < 2 or len(unlabelled) < 2:
        scored = docs.select(*keys, F.lit(0.5).alias("score"))
    else:
        scorer = Scorer(positive.shape[1]).fit(positive, unlabelled, estimated_prior(positive, unlabelled))

        @F.pandas_udf("double")
        def score(texts: pd.Series) -> pd.Series:
            if not len(texts):
                return pd.Series([], dtype=float)
            margins = scorer.margins(np.array([features_of(text) for text in texts]))
            return pd.Series(1 / (1 + np.exp(-np.clip(margins, -30, 30))))

        scored = docs.select(*keys, score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
