"""Language identification by rank-order n-gram profiles.

A language's profile is the list of its `PROFILE` most frequent letter n-grams (1 to 3 letters, words
bounded by a blank) in rank order, counted over all its training texts. A text's own most frequent n-grams
are compared to each profile by out-of-place distance: the sum over the text's n-grams of how far the ranks are apart, or
`PROFILE` where the language's profile lacks it. The nearest language wins, the first by name on a tie; the score is one
less the distance's share of the greatest possible.

Counting is one pass with sums merged in every task, then by shuffle; the first `PROFILE` n-grams of a language
come from two ranking steps, over 64 slices of its n-grams and over the slices' firsts. What is broadcast is
`PROFILE` rows per language, for at most `MAX_LANGUAGES` languages (more are refused): under 25 MB.

Edge cases: a null text, or one without a letter, is `und` with score 0; without any learned language every text
is `und`; a null language is not learned from; repeated rows count as often as they occur; an empty table gives
an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
MAX_LANGUAGES = 2000
SLICES = 64
UNKNOWN = "und"
_BLANK, _SHIFT = 32, np.int64(21)
_HOLD = 1 << 21  # n-grams held for one language before they are counted


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or a blank."""
    out = np.full(0x110000, _BLANK, np.int32)
    for point in itertools.chain(range(0xD800), range(0xE000, 0x110000)):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def ngrams(text: str | None) -> np.ndarray:
    """Codes of all letter n-grams of the text, 21 bits a letter; empty if it has no letter."""
    if not text:
        return np.empty(0, np.int64)
    line = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    blank = line == _BLANK
    line = line[~(blank & np.concatenate([[True], blank[:-1]]))].astype(np.int64)
    if not len(line):
        return line
    line = np.concatenate([[_BLANK], line, [_BLANK] if line[-1] != _BLANK else []]).astype(np.int64)
    one = line[line != _BLANK]
    two = line[:-1] << _SHIFT | line[1:]
    three = (line[:-2] << (2 * _SHIFT) | line[1:-1] << _SHIFT | line[2:])[line[1:-1] != _BLANK]
    return np.concatenate([one, two, three])


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in rising order and their counts."""
    if not len(codes):
        return codes, codes
    codes = np.sort(codes)
    at = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[at], np.diff(np.append(at, len(codes)))


def ranked(codes: np.ndarray, size: int) -> np.ndarray:
    """The most frequent codes first, the smaller code first on a tie, at most ``size``."""
    distinct, counts = counted(codes)
    return distinct[np.argsort(-counts, kind="stable")[:size]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}

    def flush(lang):
        codes, counts = counted(np.concatenate(held.pop(lang)))
        sizes.pop(lang)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts.astype(np.int64))],
                                          names=["lang", "gram", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1)):
            codes = ngrams(text.as_py())
            if len(codes):
                lang = lang.as_py()
                held.setdefault(lang, []).append(codes)
                sizes[lang] = sizes.get(lang, 0) + len(codes)
                if sum(sizes.values()) >= _HOLD:
                    yield flush(max(sizes, key=sizes.get))
    for lang in list(held):
        yield flush(lang)


def profiles(training: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank from 0) from the columns lang and text."""
    counts = (training.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), "text")
              .mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    first = (F.col("n").desc(), F.col("gram"))
    sliced = Window.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(SLICES))).orderBy(*first)
    whole = Window.partitionBy("lang").orderBy(*first)
    return (counts.withColumn("r", F.row_number().over(sliced)).where(F.col("r") <= size)
            .withColumn("rank", F.row_number().over(whole) - 1).where(F.col("rank") < size).select("lang", "gram", "rank"))


class Model:
    """Profiles as a table of ranks by n-gram and language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int = PROFILE):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)  # the last row: in no profile
        column = {lang: i for i, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), column[lang]] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        top = ranked(ngrams(text), self.size) if self.langs else []
        if not len(top):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == top, at, len(self.grams))]
        apart = np.where(ranks >= 0, np.abs(ranks - np.arange(len(top))[:, None]), self.size)
        distance = apart.sum(axis=0)
        best = int(distance.argmin())
        return self.langs[best], 1.0 - float(distance[best]) / (len(top) * self.size)


def fit(training: DataFrame, size: int = PROFILE) -> Model:
    rows = [tuple(r) for r in profiles(training, size).limit(MAX_LANGUAGES * size + 1).collect()]
    if len(rows) > MAX_LANGUAGES * size:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    return Model(rows, size)


def predictor(model: Model, spark) -> Column:
    """An Arrow UDF text -> struct<lang_pred: string, score: double>."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = [shared.value.predict(t.as_py()) for t in texts]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                             names=["lang_pred", "score"])
    return predict


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of every text; nothing else of a document is read."""
    predict = predictor(model, docs.sparkSession)
    return docs.select("doc_id", predict("text").alias("p")).select("doc_id", "p.*")


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those rejected: texts without a letter, or sharing no n-gram with any learned language."""
    predict = predictor(model, docs.sparkSession)
    judged = docs.select(F.struct(*docs.columns).alias("row"), predict("text").alias("p"))
    return judged.where((F.col("p.lang_pred") != UNKNOWN) & (F.col("p.score") > 0)).select("row.*")
