"""Language detection by ranked profiles: a text's commonest trigrams, by rank, against those of each language; the language with the least out-of-place distance wins.

Profiles are learned from texts of known language: each batch of texts is counted in numpy, the counts are added up by a group-by, with a rank for each language, and are small: ``SIZE`` trigrams a language. Detection is a
column, a function of the text alone that holds the profiles, so a text is judged where it is read, in time n log n, with no join or shuffle. A detector plugs into the quality report.

Trigrams are of lower-cased words with a blank before and after; all but letters parts words. Ranks go by count, ties by the trigram in code-point order. Null texts, texts without a letter, and texts none of whose trigrams is in a
profile are ``unknown``; of languages at the same distance the first by name wins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.language import UNKNOWN
from tablewright.sources.shipping import shipped

#: Trigrams of a profile, and of a text, that are ranked.
SIZE = 300
#: Languages at most, so that what every task holds stays below some MB.
MOST_LANGUAGES = 500
#: Characters of texts that are counted at once, about; a longer text goes alone.
AT_ONCE = 1 << 20
#: Bits of a code point.
BITS = 21


def words_of(text: Column) -> Column:
    """A text's lower-cased words with one blank between; null gives none."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))


def code_points(words: str) -> np.ndarray:
    """Code points of words with a blank before and after."""
    return np.frombuffer(f" {words} ".encode("utf-32-le"), np.uint32).astype(np.int64)


def at_once(texts: Iterator[str], most: int = AT_ONCE) -> Iterator[list[str]]:
    """``texts`` in lists of about ``most`` characters."""
    now, n = [], 0
    for t in texts:
        now.append(t)
        n += len(t)
        if n >= most:
            yield now
            now, n = [], 0
    if now:
        yield now


def spelled(keys: np.ndarray, length: int) -> list[str]:
    """Strings of ``length`` code points each, from whole numbers of ``BITS`` bits for each, the first highest."""
    parts = np.stack([keys >> BITS * k & (1 << BITS) - 1 for k in range(length - 1, -1, -1)], 1).astype("<u4")
    joined = parts.tobytes().decode("utf-32-le")
    return [joined[k : k + length] for k in range(0, len(joined), length)]


def _keys(words: str) -> np.ndarray:
    """All trigrams of words in order, as whole numbers that sort as the trigrams do. Texts with a blank between have the trigrams that each has."""
    c = code_points(words)
    return (c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])[c[1:-1] != 32]


def _commonest(words: str, size: int) -> np.ndarray:
    keys, n = np.unique(_keys(words), return_counts=True)
    return keys[np.argsort(-n, kind="stable")[:size]]


def trigrams(text: Column) -> Column:
    """All trigrams of a text in order, repeats included; null and letterless texts have none."""

    @F.pandas_udf("array<string>")
    def made(words: pd.Series) -> pd.Series:
        return pd.Series([spelled(_keys(w), 3) for w in words], dtype=object)

    return made(words_of(text))


def ranked(text: Column, size: int = SIZE) -> Column:
    """The ``size`` commonest trigrams of a text, commonest first."""

    @F.pandas_udf("array<string>")
    def made(words: pd.Series) -> pd.Series:
        return pd.Series([spelled(_commonest(w, size), 3) for w in words], dtype=object)

    return made(words_of(text))


def learned(df: DataFrame, text: str, lang: str, size: int = SIZE) -> DataFrame:
    """(lang, gram, rank): the ``size`` commonest trigrams of the texts of each language, ranks from 1. Rows without a language teach nothing."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pandas()
            for name, words in rows.groupby("lang", sort=False)["words"]:
                for some in at_once(words):
                    keys, n = np.unique(_keys(" ".join(some)), return_counts=True)
                    lang = pa.array([name], batch.schema.field("lang").type).take(pa.array(np.zeros(len(keys), np.int32)))
                    yield pa.RecordBatch.from_arrays([lang, pa.array(spelled(keys, 3), pa.string()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    each = shipped(df).filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), words_of(F.col(text)).alias("words"))
    counts = each.mapInArrow(counted, f"lang {df.schema[lang].dataType.simpleString()}, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= size).select("lang", "gram", "rank")


def detector(profiles: DataFrame, size: int = SIZE) -> Callable[[Column], Column]:
    """A detector by ``profiles`` (lang, gram, rank), which are brought to the driver: ``size`` rows for each of at most ``MOST_LANGUAGES`` languages."""
    names = sorted(r[0] for r in shipped(profiles).select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"profiles of more than {MOST_LANGUAGES} languages")
    if not names:
        return lambda text: F.lit(UNKNOWN)
    at = {name: k for k, name in enumerate(names)}
    rows = [(g, at[x], r) for x, g, r in profiles.select("lang", "gram", "rank").collect() if len(g) == 3]
    rows = sorted((ord(g[0]) << 2 * BITS | ord(g[1]) << BITS | ord(g[2]), k, r) for g, k, r in rows)
    keys, langs, ranks = np.array(rows, np.int64).reshape(-1, 3).T.copy()

    def best(words: str) -> str:
        """By how much less out of place than a missing trigram those are that a profile holds, summed up by language."""
        own = _commonest(words, size)
        first = np.searchsorted(keys, own)
        n = np.searchsorted(keys, own, "right") - first
        place = np.repeat(np.arange(len(own)), n)
        met = np.arange(len(place)) + np.repeat(first - (np.cumsum(n) - n), n)
        sums = np.bincount(langs[met], size - np.abs(ranks[met] - 1 - place), len(names))
        k = int(sums.argmax())
        return names[k] if sums[k] > 0 else UNKNOWN

    @F.pandas_udf("string")
    def found(words: pd.Series) -> pd.Series:
        return words.map(best)

    return lambda text: found(words_of(text))
