"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams on the executors over a bounded sample (at most ``rows_per_language`` rows of each language, the
same rows each time); the driver turns the counts into one matrix of log probabilities, languages by 2**bits buckets, which
is broadcast. Scoring takes a batch of whole texts as one array of code points: the n-grams' buckets pick numbers out of each language's line, and one
segmented sum adds them up by text. A text counts as written in its language if its log-likelihood per n-gram isn't far below the mean over
that language's training texts.

The score is the posterior probability of the language found, for a text as likely by n-gram as this one, but of ``SHOWN`` n-grams at most: the n-grams
of a text are far from independent, and by all of them every longer text would score 1.

Defined cases: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; with nothing to learn from, every text is ``und``;
a null language teaches nothing; repeated rows are scored alike; ties go to the language first in order; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import unicodedata
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.llm.chargrams import buckets, codes
from tablewright.llm.common import private, shipped, text_blocks, text_parts

UNKNOWN = "und"
ORDERS = (1, 2, 3)
#: Most n-grams that a text's score goes by.
SHOWN = 200
#: Most numbers in a model's matrix (64 MB): 256 languages at 16 bits, fewer bits with more languages.
MATRIX = 1 << 24
#: A text is foreign to its best language below the usual log-likelihood per n-gram by more than FAR + FAR_SHORT / sqrt(n-grams).
FAR, FAR_SHORT = 2.0, 16.0
_SPACE, _END = 32, 0
_OTHER, _MARK, _LETTER = 0, 1, 2


@functools.cache
def _kinds() -> np.ndarray:
    """For each code point whether it is a letter, a mark that goes with letters, or something else."""
    kind = {"L": _LETTER, "M": _MARK}
    return np.fromiter((kind.get(unicodedata.category(chr(k))[0], _OTHER) for k in range(0x110000)), np.uint8, 0x110000)


class Batch:
    """Texts as one array of code points: lower-cased, runs of anything but letters and their marks as one space, a space at both ends of each text."""

    def __init__(self, texts: list[str | None]):
        whole = codes("".join(map(_framed, texts))).copy()
        kinds = _kinds()[whole]
        end = whole == _END
        whole[(kinds == _OTHER) & ~end] = _SPACE
        space = whole == _SPACE
        kept = ~space
        kept[1:] |= ~space[:-1]
        kept[:1] = True
        owner = np.cumsum(end) - end
        self.texts = len(texts)
        self.letters = np.bincount(owner[kinds == _LETTER], minlength=len(texts)) > 0
        self.points, self.owner = whole[kept], owner[kept]

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams that lie in one text, and the number of that text for each."""
        made = buckets(self.points, n, bits)
        inside = self.owner[: len(made)] == self.owner[n - 1 : n - 1 + len(made)]
        inside &= self.points[n - 1 : n - 1 + len(made)] != _END
        return made[inside], self.owner[: len(made)][inside]


def _framed(text: str | None) -> str:
    return f" {text.lower().replace(chr(0), ' ')} \0" if text else "\0"


def features(text: str, bits: int) -> list[np.ndarray]:
    """Buckets of a text's n-grams of each order."""
    batch = Batch([text])
    return [batch.grams(n, bits)[0] for n in ORDERS]


class Model:
    """``log_p`` (languages, buckets) and what is usual of each language, the mean of log_p over its training n-grams."""

    def __init__(self, languages: list[str], log_p: np.ndarray, bits: int, usual: np.ndarray):
        self.languages, self.log_p, self.bits, self.usual = languages, log_p, bits, usual

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.judge([text])[0][:2]

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) log-likelihoods, the number of n-grams and whether there is a letter, of texts held in memory at once."""
        batch, total, number = Batch(texts), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=np.int64)
        for n in ORDERS:
            bucket, owner = batch.grams(n, self.bits)
            if not len(bucket):
                continue
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            number += np.bincount(owner, minlength=len(texts))
            for k, line in enumerate(self.log_p):
                total[owner[starts], k] += np.add.reduceat(line[bucket], starts, dtype=np.float64)
        return total, number, batch.letters

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, bool, int]]:
        """Language, score, whether the text is likely enough to be in that language, and the number of n-grams that tell, for each text."""
        out: list[tuple[str, float, bool, int]] = []
        for first, last in text_blocks(texts):
            # A text longer than a block is cut between words; each n-gram within a word is in one part.
            parts = [(k, t[lo:hi]) for k, t in enumerate(texts[first:last]) for lo, hi in (text_parts(t) if t else ())]
            total, number, letters = np.zeros((last - first, len(self.languages))), np.zeros(last - first, np.int64), np.zeros(last - first, bool)
            if self.languages:
                for few in [parts] if last - first > 1 else [[p] for p in parts]:
                    owners = np.array([k for k, _ in few], dtype=np.int64)
                    for whole, added in zip((total, number, letters), self.sums([t for _, t in few]), strict=True):
                        if whole is letters:
                            whole[owners[added]] = True
                        else:
                            np.add.at(whole, owners, added)
            out += [self._choice(*row) for row in zip(total, number.tolist(), letters.tolist(), strict=True)]
        return out

    def _choice(self, total: np.ndarray, n: int, letters: bool) -> tuple[str, float, bool, int]:
        if not self.languages or not letters:
            return UNKNOWN, 0.0, False, 0
        shown = total / n * min(n, SHOWN)
        odds = np.exp(shown - shown.max())
        best = int(total.argmax())
        learned = self.usual[best] - total[best] / n <= FAR + FAR_SHORT / n**0.5
        return self.languages[best], float(odds[best] / odds.sum()), bool(learned), n


def train(labelled: DataFrame, bits: int = 16, rows_per_language: int = 1500) -> Model:
    """A model from the rows (doc_id, text, lang) of ``labelled`` that have both text and language.

    With so many languages that the matrix would exceed ``MATRIX``, ``bits`` shrinks.
    """
    rows = shipped(labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")))
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    while bits > 1 and len(languages) << bits > MATRIX:
        bits -= 1
    if not languages:
        return Model([], np.zeros((0, 1 << bits)), bits, np.zeros(0))
    place = (F.pmod(F.xxhash64(F.lit("lang"), "doc_id", "text"), F.lit(1_000_000)) / 1_000_000).cast("double")
    # Only languages with more rows than that are thinned out, so they alone are looked up.
    most = {k: (rows_per_language + 10 * rows_per_language**0.5 + 10) / n for k, n in sizes.items() if n > rows_per_language}
    lang, share = private("lang"), private("share")
    thinned = labelled.sparkSession.createDataFrame(list(most.items()), f"{lang} string, {share} double")
    joined = rows.join(F.broadcast(thinned), F.col("lang") == F.col(lang), "left")
    few = joined.filter(F.coalesce(place <= F.col(share), F.lit(True))).select("text", "lang", place.alias(share))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(share, F.xxhash64("text")))  # little more than the rows that stay
    chosen = few.withColumn(lang, rank).filter(F.col(lang) <= rows_per_language).select("text", "lang").repartition(8)

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for frame in batches:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                for lo, hi in text_parts(text):
                    batch = Batch([text[lo:hi]])
                    if not batch.letters[0]:
                        continue
                    total = held.setdefault(lang, np.zeros(1 << bits, np.uint32))
                    for n in ORDERS:
                        total += np.bincount(batch.grams(n, bits)[0], minlength=1 << bits).astype(np.uint32)
        if held:
            yield pd.DataFrame({"lang": list(held), "counts": [zlib.compress(x.tobytes(), 1) for x in held.values()]})

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint32).astype(np.uint32) for x in frame["counts"])
        return pd.DataFrame({"lang": frame["lang"].iloc[:1], "counts": [zlib.compress(total.tobytes(), 1)]})

    kind = "lang string, counts binary"
    totals, number = np.zeros((len(languages), 1 << bits)), {k: i for i, k in enumerate(languages)}
    for r in chosen.mapInPandas(count, kind).groupBy("lang").applyInPandas(merge, kind).collect():  # one row a language
        totals[number[r["lang"]]] = np.frombuffer(zlib.decompress(r["counts"]), np.uint32)
    taught = totals.sum(axis=1) > 0
    languages, totals = [k for k, t in zip(languages, taught, strict=True) if t], totals[taught]
    smooth = totals + 0.5
    log_p = np.log(smooth / smooth.sum(axis=1, keepdims=True))
    usual = np.einsum("ij,ij->i", totals, log_p) / totals.sum(axis=1)
    # Single precision where the matrix is large; sums are made in double precision.
    return Model(languages, np.ascontiguousarray(log_p.astype(np.float32)), bits, usual)


def predicted(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A struct column (lang_pred, score, learned, n_grams) for ``docs``; texts unlike all learned languages have learned false."""
    sent = shipped(docs).sparkSession.sparkContext.broadcast((model.languages, model.log_p, model.bits, model.usual))

    @F.pandas_udf("lang_pred string, score double, learned boolean, n_grams long")
    def run(texts: pd.Series) -> pd.DataFrame:
        own = Model(*sent.value)
        return pd.DataFrame(own.judge([t if isinstance(t, str) else None for t in texts]), columns=["lang_pred", "score", "learned", "n_grams"])

    return run(F.col(text).cast("string"))


#: A stated language is held to be wrong if another is found with this score, by so many n-grams (some 200 letters).
SURE, SURE_GRAMS = 0.99, 600


def accepted(found: Column, stated: Column, model: Model, languages: tuple[str, ...] | None = None) -> Column:
    """Whether a document stays: in a learned language, one of ``languages`` (any, if None), and not surely in another than is stated.

    ``found`` is what ``predicted`` gives. A stated language that wasn't learned, or none, is not held against a text.
    """
    other = stated.cast("string").isin(model.languages) & (found["lang_pred"] != stated) & (found["score"] >= SURE) & (found["n_grams"] >= SURE_GRAMS)
    fine = found["learned"] & ~F.coalesce(other, F.lit(False))
    return fine if languages is None else fine & found["lang_pred"].isin(*languages)
