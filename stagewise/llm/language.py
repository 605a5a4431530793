"""Language identification by compression: the language whose dictionary shortens a text most.

For each language a zstandard raw-content dictionary is filled with passages of training texts. Of a text only the letters count, in
lower case, with one blank for whatever stands between them. It is cut into pieces of equal length, so that a dictionary counts as much at the
end of a long text as at its start; the pieces are compressed under every dictionary, and the language with the smallest sum wins. The margin is ``1 - smallest / second smallest``. Where it is
below ``MIN_MARGIN`` the text is rejected: it fits two languages almost equally well.
"""

from __future__ import annotations

import re

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from stagewise.llm.tables import fold_of, if_small, stored

#: Bounds of the training sample: languages (the most frequent ones), passages of a language, characters of a passage. All passages are used; they stay
#: below 64 KiB in Latin letters, from where on zstandard takes slower parameters.
LANGUAGES, PASSAGES, PASSAGE_CHARS = 256, 148, 400
PIECE_BYTES = 2048
LEVEL = 12
MIN_MARGIN = 0.002
BETWEEN = re.compile(r"[\W\d_]+")
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
RESULT = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


def learn_dictionaries(train: DataFrame, sample: int = PASSAGES) -> dict[str, bytes]:
    """Dictionary bytes of each language, most frequent first, from one passage each of at most ``sample`` texts: those whose hash is smallest.

    The hash of a text also says where its passage begins, so any part of a long text may be taken. ``train`` has ``text`` and ``lang``; rows where
    either is null do not count. Copies of a text count once. A first pass over ``lang`` alone counts rows; the second looks only at texts
    whose hash falls into a share that leaves about four times the sample, so no language is ever gathered whole.
    """
    rows = train.filter("lang is not null and text is not null").select("lang", "text")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = stored(counts, "languages")
    share = F.least(F.lit(1.0), F.lit(4.0 * sample) / F.col("n"))
    parts = rows.join(if_small(counts), "lang").withColumn("h", F.xxhash64("text"))
    few = parts.filter((F.shiftrightunsigned("h", 11) / F.lit(float(1 << 53))) < share)
    passage = F.expr(f"substring(text, cast(1 + pmod(h, greatest(1, length(text) - {PASSAGE_CHARS - 1})) as int), {PASSAGE_CHARS})")
    few = few.groupBy("lang", "h").agg(F.min(passage).alias("text"))
    order = Window.partitionBy("lang").orderBy("h", "text")
    rows = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= sample).orderBy("lang", "r").collect()
    texts: dict[str, list[str]] = {}
    for row in rows:
        texts.setdefault(row.lang, []).append(row.text)
    order = [row.lang for row in counts.orderBy(F.desc("n"), "lang").collect() if row.lang in texts]
    return {lang: letters_of("\n".join(texts[lang])) for lang in order}


def letters_of(text: str) -> bytes:
    """Lower-cased letters of a text, with blanks between words."""
    return BETWEEN.sub(" ", text.lower()).encode("utf-8", "ignore")


def language_of(dictionaries: dict[str, bytes]):
    """Pandas UDF from text to ``lang_pred``, ``score`` and ``accepted``.

    Null texts, texts without a letter, and all texts when no language was learned give ``und``, 0.0 and false. Languages with
    equal sums: the more frequent in training, with score 0.0. If only one language was learned it is always taken, with score 1.0.
    """
    names = list(dictionaries)

    @F.pandas_udf(RESULT)
    def predict(texts: pd.Series) -> pd.DataFrame:
        press = _compressors(dictionaries)
        out = []
        for text in texts:
            if not text or not names or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0, False))
                continue
            data = letters_of(text)
            pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
            sums = [sum(len(p.compress(piece)) for piece in pieces) for p in press]
            ranked = sorted(zip(sums, range(len(sums)), strict=True))
            score = 1.0 - ranked[0][0] / ranked[1][0] if len(ranked) > 1 else 1.0
            out.append((names[ranked[0][1]], score, score >= MIN_MARGIN))
        return pd.DataFrame(out, columns=["lang_pred", "score", "accepted"])

    return predict


_ready: dict[int, tuple[dict[str, bytes], list[zstandard.ZstdCompressor]]] = {}


def _compressors(dictionaries: dict[str, bytes]) -> list[zstandard.ZstdCompressor]:
    """Compressors in the order of the languages, made once for each Python worker and set of dictionaries."""
    key = hash(tuple(dictionaries.items()))
    if key not in _ready or _ready[key][0] != dictionaries:
        _ready.clear()
        made = []
        for name in dictionaries:
            known = zstandard.ZstdCompressionDict(dictionaries[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False))
        _ready[key] = dictionaries, made
    return _ready[key][1]


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score``, ``accepted`` for every row, learned from rows that are not held out.

    Repeated rows stay repeated; other columns are not looked at.
    """
    fold = fold_of(F.col("doc_id"), FOLDS)
    predict = language_of(learn_dictionaries(docs.filter(fold != HELD_OUT).select("text", "lang")))
    found = docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), predict("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.accepted")


def known_language(docs: DataFrame) -> DataFrame:
    """Rows, with all their columns, whose language is told clearly enough."""
    fold = fold_of(F.col("doc_id"), FOLDS)
    predict = language_of(learn_dictionaries(docs.filter(fold != HELD_OUT).select("text", "lang")))
    return docs.filter(predict("text")["accepted"])
