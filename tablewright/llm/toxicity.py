"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character n-grams and its own, so an unseen misspelling shares most of its vector with the
word it disguises. A window of ``WINDOW`` words is the mean of its words, classified by a linear softmax; vectors and softmax
learn together, by Adagrad. Labels are given for documents, so each toxic document teaches by its most telling window, and
each clean one by its most misleading window and a few others; a document's score is that of its strongest window, calibrated on
training documents kept apart. For scoring, embeddings and softmax fold into one number per bucket, which is broadcast. A long text is scored
part by part, cut between words, and its windows run over all parts; a worker holds one part's n-grams at a time.

Long labelled documents teach too: a first, short training on the others finds the stretch of each that is most telling.

Defined cases: a run of more than ``BLOCK_CHARS`` characters without white space counts as several words; a null, empty or wordless text scores 0; several labels of one document count as the highest; of several texts with one
id the first in order teaches; labelled texts without a word teach nothing; if the labels show one class only, every text with words gets the score 1 or 0 of that class; without labels, 0; repeated rows are scored alike; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.chargrams import WordGrams, words_only
from tablewright.llm.common import cut, least_ids, shipped, text_blocks, text_parts

ORDERS = (3, 4, 5)
WINDOW = 8
#: Zero vectors that each word's mean takes in, so that words of few n-grams speak less loudly. It and the rate of ``fit`` were chosen by cross-validation
#: over labelled documents whose crc32(doc_id as text) mod 4 is 0, 1 or 3, by log loss.
PRIOR = 40


def window_means(values: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Means over each full window, or over all of a shorter text."""
    if len(values) <= window:
        return values.mean(axis=0, keepdims=True)
    total = np.cumsum(np.concatenate((np.zeros((1, *values.shape[1:])), values)), axis=0)
    return (total[window:] - total[:-window]) / window


class Model:
    """``gain``: the softmax's log odds for each bucket; ``scale``, ``shift``: calibration of the strongest window."""

    def __init__(self, gain: np.ndarray, bias: float, scale: float, shift: float, bits: int):
        self.gain, self.bias, self.scale, self.shift, self.bits = gain, bias, scale, shift, bits

    def strongest(self, texts: list[str | None]) -> np.ndarray:
        """Log odds of each text's strongest window; minus infinity where there is no word."""
        out = np.full(len(texts), -np.inf)
        for first, last in text_blocks(texts):
            if last == first + 1:
                odds = self.word_odds(texts[first] or "")
                if len(odds):
                    out[first] = window_means(odds).max() + self.bias
                continue
            points = [words_only(t or "") for t in texts[first:last]]
            ends = np.cumsum([len(p) for p in points])
            grams = WordGrams(np.concatenate(points), ORDERS, self.bits)
            if not grams.words:
                continue
            odds = grams.means(self.gain, PRIOR)
            edges = np.searchsorted(grams.at, np.concatenate(([0], ends)))
            for k in range(last - first):
                if edges[k + 1] > edges[k]:
                    out[first + k] = window_means(odds[edges[k] : edges[k + 1]]).max() + self.bias
        return out

    def word_odds(self, text: str) -> np.ndarray:
        """Log odds of each word, without the bias, made part by part."""
        parts = [np.empty(0)]
        for lo, hi in text_parts(text):
            grams = WordGrams(words_only(text[lo:hi]), ORDERS, self.bits)
            if grams.words:
                parts.append(grams.means(self.gain, PRIOR))
        return np.concatenate(parts)

    def stretch(self, text: str, most_chars: int) -> str:
        """About ``most_chars`` characters around the strongest window, cut between words."""
        pieces = [p for lo, hi in text_parts(text, max(1, most_chars // 8)) if (p := text[lo:hi])]
        best = int(self.strongest(pieces).argmax()) if self.gain.any() else len(pieces) // 2
        lo = max(0, min(best - 4, len(pieces) - 8))
        return "".join(pieces[lo : lo + 8])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        top = self.strongest(texts)
        has_words = np.isfinite(top)
        if np.isinf(self.shift):  # one class is all that the labels showed
            return has_words * float(self.shift > 0)
        return np.where(has_words, _sigmoid(self.scale * np.where(has_words, top, 0.0) + self.shift), 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def _platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic calibration by Newton steps, with smoothed targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    spread = x.std() or 1.0
    z, w = np.stack([(x - x.mean()) / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(30):
        p = _sigmoid(z @ w)
        w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (p - target) + 1e-3 * w)
    return float(w[0] / spread), float(w[1] - w[0] * x.mean() / spread)


class _Bag:
    """Training texts as n-gram buckets by word."""

    def __init__(self, texts: list[str], bits: int):
        self.bits = bits
        self.first, self.last, self.bucket, self.word_at = [], [], [], [0]
        words = 0
        grams_before = 0
        cut = [0]
        for text in texts:
            grams = WordGrams(words_only(text), ORDERS, bits)
            order = np.argsort(grams.word, kind="stable")
            self.bucket.append(grams.bucket[order])
            cut.append(np.cumsum(np.bincount(grams.word, minlength=grams.words)) + grams_before)
            self.first.append(words)
            words += grams.words
            self.last.append(words)
            grams_before += len(grams.bucket)
        self.bucket = np.concatenate(self.bucket) if texts else np.empty(0, np.uint32)
        self.cut = np.concatenate([np.atleast_1d(c) for c in cut]).astype(np.int64)

    def grams_of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the given words, and for each bucket the index of its word among them."""
        n = self.cut[words + 1] - self.cut[words]
        index = np.repeat(np.arange(len(words)), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.bucket[self.cut[words][index] + place], index

    def summed(self, value: np.ndarray) -> np.ndarray:
        """For each word, the sum of ``value`` over its buckets, made in parts that keep memory small."""
        parts, words = [np.empty(0, value.dtype)], len(self.cut) - 1
        for lo in range(0, words, 200_000):
            cut = self.cut[lo : min(lo + 200_000, words) + 1]
            parts.append(np.add.reduceat(value[self.bucket[cut[0] : cut[-1]]], cut[:-1] - cut[0]))
        return np.concatenate(parts)

    def telling(self, labels: np.ndarray) -> np.ndarray:
        """Each word's log ratio of document frequencies (toxic to clean), by a hash of its n-grams."""
        mixed = np.random.default_rng(0).integers(0, 1 << 63, 1 << self.bits, dtype=np.uint64)
        total = self.summed(mixed)
        _, kind = np.unique(total, return_inverse=True)
        doc = np.repeat(np.arange(len(labels)), np.array(self.last) - np.array(self.first))
        pair = np.unique(kind.astype(np.int64) * len(labels) + doc)
        kinds, toxic = pair // len(labels), labels[pair % len(labels)]
        yes = np.bincount(kinds, toxic, kind.max(initial=0) + 1)
        no = np.bincount(kinds, 1 - toxic, kind.max(initial=0) + 1)
        return (np.log((yes + 0.1) / (labels.sum() + 1)) - np.log((no + 0.1) / ((1 - labels).sum() + 1)))[kind]


def fit(texts: list[str], labels: np.ndarray, prior: float | None = None, bits: int = 18, size: int = 8, epochs: int = 48, rate: float = 1.0, floor: float = 2e-2, seed: int = 7) -> Model:
    """Train on whole texts with labels 0 and 1; ``prior`` is the toxic share where the texts come from, if they were chosen by label."""
    labels = np.asarray(labels, dtype=np.int64)
    worded = np.array([bool((words_only(t) != 32).any()) for t in texts], dtype=bool)
    texts, labels = [t for t, w in zip(texts, worded, strict=True) if w], labels[worded]
    if len(set(labels.tolist())) < 2:
        only = float(labels[0]) if len(labels) else 0.0
        return Model(np.zeros(1 << bits, np.float32), 0.0, 0.0, np.inf if only else -np.inf, bits)
    rng = np.random.default_rng(seed)
    apart = rng.random(len(texts)) < 0.3
    if any(len(set(labels[side].tolist())) < 2 for side in (apart, ~apart)):
        apart[:] = False
    taught = np.flatnonzero(~apart)
    bag = _Bag([texts[k] for k in taught], bits)
    y = labels[taught]
    first, last = np.array(bag.first, dtype=np.int64), np.array(bag.last, dtype=np.int64)
    use = np.flatnonzero(last > first)
    embed = (rng.random((1 << bits, size), dtype=np.float32) - 0.5) / size
    soft = np.zeros((size, 2), np.float32)
    bias = np.zeros(2, np.float32)
    sums = [np.full_like(embed, floor), np.full_like(soft, 1e-4), np.full_like(bias, 1e-4)]
    telling = bag.telling(y)
    grams = np.diff(bag.cut)
    counts = grams + PRIOR

    for epoch in range(epochs):
        if epoch % 2 == 0:
            if epoch:
                gain = embed @ (soft[:, 1] - soft[:, 0])
                word_odds = bag.summed(gain) / counts
            else:
                word_odds = telling
            starts, owner = [], []
            for d in use:
                lo, n = first[d], last[d] - first[d]
                means = window_means(word_odds[lo : last[d]])
                most = int(means.argmax())
                picks = [most]
                if not y[d]:
                    means[max(0, most - WINDOW) : most + WINDOW] = -np.inf
                    picks += [int(means.argmax()), *rng.integers(0, max(1, n - WINDOW + 1), 2).tolist()]
                starts += [lo + p for p in picks]
                owner += [d] * len(picks)
            starts, owner = np.array(starts), np.array(owner)
        n_words = np.minimum(WINDOW, last[owner] - starts)
        window_of = np.repeat(np.arange(len(starts)), n_words)
        words = np.repeat(starts, n_words) + np.arange(n_words.sum()) - np.repeat(np.cumsum(n_words) - n_words, n_words)
        bucket, word_index = bag.grams_of(words)
        share = (1 / counts[words] / n_words[window_of])[word_index].astype(np.float32)
        to = window_of[word_index]
        mean = np.stack([np.bincount(to, embed[bucket, k] * share, len(starts)) for k in range(size)], 1).astype(np.float32)
        logits = mean @ soft + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        target = np.stack([1 - y[owner], y[owner]], 1)
        weight = np.where(y[owner] == 1, 0.5 / max(1, (y[owner] == 1).sum()), 0.5 / max(1, (y[owner] == 0).sum()))
        error = ((p - target) * weight[:, None]).astype(np.float32) * 100
        back = error @ soft.T
        touched, at = np.unique(bucket, return_inverse=True)
        grad = np.stack([np.bincount(at, back[to, k] * share, len(touched)) for k in range(size)], 1).astype(np.float32)
        sums[0][touched] += grad**2
        embed[touched] -= rate * grad / np.sqrt(sums[0][touched])
        for value, g, total in ((soft, mean.T @ error, sums[1]), (bias, error.sum(axis=0), sums[2])):
            total += g**2
            value -= rate * g / np.sqrt(total)
        if epoch == 0 and not soft.any():
            soft[:, 1] = 0.5
    made = Model((embed @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), 1.0, 0.0, bits)
    checked = np.flatnonzero(apart) if apart.any() else taught
    top = made.strongest([texts[k] for k in checked])
    fine = np.isfinite(top)
    made.scale, made.shift = _platt(top[fine], labels[checked][fine])
    if prior is not None and 0 < prior < 1:
        shown = labels[checked][fine].mean()
        made.shift += float(np.log(prior / (1 - prior)) - np.log(shown / (1 - shown)))
    return made


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, clean_rows: int = 3000, most_chars: int = 8000) -> Model:
    """A model from labelled documents: at most so many of each class, by a hash of their ids.

    ``docs`` (doc_id, text) holds the documents that may teach, ``labels`` (doc_id, toxic) their labels. Of a text longer than ``most_chars`` the
    driver gets the stretch of about that length around its strongest window by a model of the shorter ones (around its middle, where these show no or one class).
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = cut(docs.filter(F.length("text") > 0).select("doc_id").distinct().join(known, "doc_id"))
    prior = ids.agg(F.avg((F.col("toxic") > 0).cast("double"))).first()[0]
    chosen = least_ids(ids.filter("toxic > 0"), toxic_rows).unionByName(least_ids(ids.filter("toxic <= 0"), clean_rows))
    # At most toxic_rows + clean_rows ids.
    rows = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))
    short = rows.filter(F.length("text") <= most_chars).collect()
    if rows.filter(F.length("text") > most_chars).isEmpty():
        return fit(*_taught(short), prior)
    first = fit(*_taught(short), prior, epochs=8)
    sent = shipped(docs).sparkSession.sparkContext.broadcast((first.gain, first.bias, first.scale, first.shift, first.bits))

    @F.pandas_udf("string")
    def stretch(texts: pd.Series) -> pd.Series:
        own = Model(*sent.value)
        return pd.Series([own.stretch(t, most_chars) for t in texts])

    long = rows.filter(F.length("text") > most_chars).select("doc_id", "toxic", stretch("text").alias("text")).collect()
    return fit(*_taught(short + long), prior)


def _taught(rows: list) -> tuple[list[str], np.ndarray]:
    """Texts and labels in the order of ids."""
    rows = sorted(rows, key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], np.array([int(r["toxic"] > 0) for r in rows], dtype=np.int64)


def score(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """A double column for ``docs``: 0 to 1, higher where toxicity is likelier."""
    sent = shipped(docs).sparkSession.sparkContext.broadcast((model.gain, model.bias, model.scale, model.shift, model.bits))

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(Model(*sent.value).scores([t if isinstance(t, str) else None for t in texts]))

    return run(F.col(text).cast("string"))
