"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned first: words, and first letters of words, that are much more frequent in toxic training texts than in others, with
their log odds. Features of a text are the density and weight of lexicon words, how many stand near a second-person word, and the
rates of capitals, punctuation and disguised spelling. The trees and the calibration come from Spark ML. Lexicon,
trees and calibration are fitted on three separate parts of a bounded sample of labelled rows; the calibration weighs classes as they
are in all training labels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.samples import labelled_sample
from stagewise.llm.tables import fold_of, stored

FOLDS, HELD_OUT, THRESHOLD = 4, 2, 0.3
#: Bounds of the sample by class, and of the lexicon.
SAMPLE = {1: 6_000, 0: 9_000}
LEXICON_TERMS, LEAST_TEXTS, LEAST_ODDS = 4_000, 4, 2.0
PARTS = 10  # of the sample: 4 for the lexicon, 4 for the trees, 2 for the calibration
NEAR_WORDS = 3
TREES, DEPTH = 20, 4
STRIP = ".,;:!?\"'()[]{}<>|#%&*-_/\\~`"
#: Words that speak to the reader, and signs that stand for letters.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre tú ti tus usted ustedes vosotros".split())
DISGUISE = str.maketrans({"@": "a", "0": "o", "1": "i", "3": "e", "$": "s", "5": "s", "7": "t", "*": None, "'": None, "’": None})


def words_in(text: str) -> list[str]:
    """Lower-cased words without signs at their ends, disguised letters put back."""
    out = []
    for word in text.lower().split():
        if not word.isalpha():
            word = word.strip(STRIP)
            if not word.isalpha():
                word = word.translate(DISGUISE)
        if word:
            out.append(word)
    return out


def terms_of(word: str) -> tuple[str, ...]:
    """The word, and what begins longer words like it."""
    return (word, word[:5] + "~", word[:4] + "~") if len(word) > 5 else (word, word[:4] + "~") if len(word) > 4 else (word,)


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Log odds of the terms that tell toxic texts (``text``, ``label``) best, at most ``LEXICON_TERMS``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            seen = {0: Counter(), 1: Counter()}
            for text, label in zip(frame["text"], frame["label"], strict=True):
                seen[int(label)].update({t for w in set(words_in(text or "")) for t in terms_of(w)})
            terms = list(seen[0] | seen[1])
            yield pd.DataFrame({"term": terms, "bad": [seen[1][t] for t in terms], "good": [seen[0][t] for t in terms]})

    n_good, n_bad = (texts.filter(F.col("label") == x).count() for x in (0, 1))
    sums = texts.mapInPandas(count, "term string, bad long, good long").groupBy("term")
    sums = sums.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).filter(F.col("bad") >= LEAST_TEXTS)
    odds = F.log((F.col("bad") + 0.5) / (n_bad - F.col("bad") + 0.5)) - F.log(
        (F.col("good") + 0.5) / (n_good - F.col("good") + 0.5)
    )
    sure = odds / F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    best = sums.withColumns({"odds": odds, "sure": sure}).filter(F.col("odds") >= LEAST_ODDS)
    best = best.orderBy(F.desc("sure"), "term").limit(LEXICON_TERMS)
    return {row.term: float(row.odds) for row in best.collect()}


def features_of(text: str | None, lexicon: dict[str, float]) -> list[float]:
    """Dense features of a text; an empty one has zeros."""
    words = words_in(text or "")
    if not words:
        return [0.0] * 13
    n, raw = len(words), text.split()
    weights = {w: max((lexicon[t] for t in terms_of(w) if t in lexicon), default=0.0) for w in set(words)}
    bad = {w for w, x in weights.items() if x > 0}
    places = [i for i, w in enumerate(words) if w in bad] if bad else []
    found = [weights[words[i]] for i in places]
    found_sorted = sorted((weights[w] for w in bad), reverse=True)
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR_WORDS) : i + NEAR_WORDS + 1]) for i in places)
    letters = max(1, sum(map(str.isalpha, text)))
    mixed = sum(1 for w in raw if not w.isalpha() and w[:1].isalpha() and w[-1:].isalpha() and "-" not in w)
    return [
        len(found) / n,
        sum(found) / n,
        math.log1p(len(found)),
        found_sorted[0] if found_sorted else 0.0,
        sum(found_sorted[:3]),
        math.log1p(len(bad)),
        near / n,
        math.log1p(near),
        sum(1 for w in raw if w.isupper() and len(w) > 1) / n,
        text.count("!") / letters,
        sum(map(text.count, ".,;:?")) / letters,
        mixed / n,
        math.log1p(n),
    ]


def feature_column(lexicon: dict[str, float]):
    """Pandas UDF from text to its features."""

    @F.pandas_udf("array<double>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(features_of(text, lexicon)) for text in texts])

    return features


def _spans(sizes: dict[tuple[int, int], int]) -> tuple[list[int], list[int], list[int]]:
    """Parts of the sample for the lexicon, the trees and the calibration, each with rows of both classes."""
    lexicon, fitted, level = list(range(4)), list(range(4, 8)), list(range(8, PARTS))
    both = lambda parts: all(any(sizes.get((c, p)) for p in parts) for c in (0, 1))
    if not both(lexicon) or not both(fitted):
        lexicon = fitted = level = list(range(PARTS))
    elif not both(level):
        level = fitted
    return lexicon, fitted, level


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` for every row, repeated ones too; learned from labels of rows that are not held out.

    Null and empty texts have zero features and get the score of those. Lexicon, trees and calibration learn from parts of the sample of their own; where
    the part for calibration lacks a class, it shares the trees' part, and where that or the lexicon's lacks one, all three learn from the whole
    sample. Only where the whole sample lacks a class, all scores are the share of toxic rows in it (0 if there are none).
    """
    fold = fold_of(F.col("doc_id"), FOLDS)
    sample = labelled_sample(docs, labels, "toxic", fold != HELD_OUT, SAMPLE)
    sample = stored(sample.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(PARTS))), "toxic-sample")
    keys = [F.col("doc_id"), (fold == HELD_OUT).alias("held_out")]
    sizes = {(row.label, row.part): row.n for row in sample.groupBy("label", "part").agg(F.count("*").alias("n")).collect()}
    total = {c: sum(n for (label, _), n in sizes.items() if label == c) for c in (0, 1)}
    score = F.lit(total[1] / max(1, sum(total.values())))
    scored = docs.select(*keys, score.alias("score"))
    if total[0] and total[1]:
        lexicon, fitted, level = _spans(sizes)
        features = feature_column(learn_lexicon(sample.filter(F.col("part").isin(lexicon))))
        vector = array_to_vector(features("text")).alias("features")
        rows = stored(sample.filter(F.col("part").isin([*fitted, *level])).select(features("text").alias("x"), F.col("label").cast("double").alias("label"), "part"), "toxic-features")
        rows = rows.withColumn("features", array_to_vector("x"))
        trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=64)
        model = trees.fit(rows.filter(F.col("part").isin(fitted)).select("features", "label"))
        margin = vector_to_array("rawPrediction")[1].alias("margin")
        known = labels.filter((fold != HELD_OUT) & F.col("doc_id").isNotNull()).groupBy("toxic").agg(F.count("*").alias("n"))
        known = {row.toxic: row.n for row in known.collect()}
        weight = F.when(F.col("label") == 1, known.get(1, 0) / total[1]).otherwise(known.get(0, 0) / total[0])
        held = model.transform(rows.filter(F.col("part").isin(level))).select(margin, "label", weight.alias("weight"))
        calibrated = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight", predictionCol="score").fit(held)
        found = model.transform(docs.select(*keys, vector)).select("doc_id", "held_out", margin)
        scored = calibrated.transform(found)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), "score"))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"))
