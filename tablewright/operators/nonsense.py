"""Finding nonsense: how surprising a text's letters are, each given the one before, to a Markov model of a corpus.

The model is learned by a group-by of letter pairs, which are counted in numpy within each batch of texts: after a letter of the ``ALPHABET`` commonest, p(next) = (pairs + 1) / (pairs with that first letter + V + 1) with V letters in the alphabet, so a pair never seen
has a small share; after another letter 1 / (V + 1). It has at most ALPHABET x (ALPHABET + 1) rows, is brought to the driver and goes with the tasks as a table of
letters by letters, so scoring is a column. A text's perplexity is the inverse of the geometric mean of
its probabilities: near the alphabet's size for random letters, much less for words of the corpus's languages.

Texts are lower-cased, with a blank for anything between words, before the first and after the last; whole texts count. Null texts and those without a letter have no perplexity and teach nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.profiles import BITS, at_once, code_points, spelled, words_of
from tablewright.sources.scratch import cut
from tablewright.sources.shipping import shipped

ALPHABET = 256


def _pair_counts(df: DataFrame, text: str) -> DataFrame:
    """(pair, n) of the pairs of neighbouring characters of all texts' words and the blanks around them."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Texts with a blank between have the pairs that each has.
            for some in at_once(batch.column(0).to_pylist()):
                c = code_points(" ".join(some))
                keys, n = np.unique(c[:-1] << BITS | c[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(spelled(keys, 2), pa.string()), pa.array(n, pa.int64())], ["pair", "n"])

    words = shipped(df).select(words_of(F.col(text)).alias("words")).filter("words <> ''")
    return words.mapInArrow(counted, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def transitions(df: DataFrame, text: str, alphabet: int = ALPHABET) -> DataFrame:
    """(pair, log_p) of the model: every pair seen, both of its letters in the alphabet; a letter alone stands for its unseen pairs, the empty text for all after other letters."""
    seen = cut(_pair_counts(df, text)).select("pair", F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b"), "n")
    letters = F.broadcast(seen.groupBy("a").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "a").limit(alphabet))  # ``alphabet`` rows
    size = letters.agg(F.count(F.lit(1)).alias("v"))
    kept = seen.join(letters.select("a"), "a", "left_semi").join(letters.select(F.col("a").alias("b")), "b", "left_semi")
    counts = kept.groupBy("a").agg(F.sum("n").alias("all"), F.collect_list(F.struct("pair", "n")).alias("of"))  # as many as the alphabet
    known = letters.select("a").join(counts, "a", "left").crossJoin(F.broadcast(size))  # one row
    total = F.coalesce("all", F.lit(0)) + F.col("v") + 1
    missing = F.struct(F.col("a").alias("pair"), F.lit(0).cast("long").alias("n"))
    rows = known.select(total.alias("total"), F.inline(F.concat(F.coalesce("of", F.array().cast("array<struct<pair:string,n:bigint>>")), F.array(missing))))
    other = size.select(F.lit("").alias("pair"), (-F.log(F.col("v") + 1)).alias("log_p"))
    return rows.select("pair", F.log((F.col("n") + 1) / F.col("total")).alias("log_p")).unionByName(other)


def perplexity(model: DataFrame):
    """A function from texts to their perplexity under ``model``; null for texts without a letter."""
    of = {r[0]: r[1] for r in shipped(model).select("pair", "log_p").collect()}
    letters = sorted({c for pair in of for c in pair})
    at = {c: k for k, c in enumerate(letters)}
    # A row and a column more for all other letters.
    logs = np.full((len(letters) + 1, len(letters) + 1), of[""])
    for pair, p in sorted(of.items(), key=lambda x: len(x[0])):  # a letter alone fills its row before its pairs
        if pair:
            logs[(at[pair[0]], at[pair[1]]) if len(pair) == 2 else at[pair]] = p
    known = np.array([ord(c) for c in letters], np.int64)

    def mean(words: str, places: np.ndarray) -> float | None:
        k = places[code_points(words)]
        return float(np.exp(-logs[k[:-1], k[1:]].mean())) if words else None

    @F.pandas_udf("double")
    def found(words: pd.Series) -> pd.Series:
        places = np.full(1 << BITS, len(known), np.int64)
        places[known] = np.arange(len(known))
        return pd.Series([mean(w, places) for w in words], dtype="float64")

    return lambda text: found(words_of(text))
