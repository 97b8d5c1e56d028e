"""Quality classifier by co-training of two views.

One view sees the text's content (shares of punctuation, capitals, digits and marks, word repetition, lengths), the other the
page's metadata (source, language, stated length). Each is a logistic regression. They start from a bounded sample of labelled
documents; for several rounds each names the unlabelled sample documents it is surest of, in proportion to the classes, and
these teach the other view. How far down its ranking a view is listened to is measured on labelled documents, so one that tells nothing teaches nothing. Then both are calibrated on labelled documents kept apart and a logistic regression over the calibrated log odds
combines them, so a view that tells nothing weighs nothing. Models are small arrays, sent with the scoring function.

Defined cases: null text counts as empty, null metadata as a value of its own; several labels of one document count as the
lowest; of several rows with one id the first in order (of text, then the rest) teaches; a stated length that is no finite number counts as none;
labels of one class only give that class to all; without labels everything scores 1; repeated rows are scored alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.llm.common import crc_of_id, cut, least_ids, shipped

METADATA_BUCKETS = 256
#: Documents are rejected below this score: well under the middle, as a good document lost is worse than a bad one kept.
KEEP_AT = 0.25


def content_features(text: str | None) -> list[float]:
    """Numbers about a whole text's form."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    words = raw.split()
    count = max(1, len(words))
    kinds = Counter(words)
    top = max(kinds.values(), default=0)
    same = sum(a == b for a, b in zip(words, words[1:]))
    lines = raw.split(b"\n")
    upper, lower = int(seen[65:91].sum()), int(seen[97:123].sum())
    marks = int(seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum())
    usual = int(seen[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum())
    return [
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(raw) / count / 10,
        upper / max(1, upper + lower),
        marks / n,
        (marks - usual) / n,
        int(seen[33]) / count,
        int(seen[[46, 44]].sum()) / count,
        int(seen[48:58].sum()) / n,
        int(seen[128:].sum()) / n,
        int(seen[10]) / n,
        len(kinds) / count,
        len(kinds) / count**0.7,
        top / count,
        same / count,
        (len(lines) - len(set(lines))) / max(1, len(lines)),
        sum(len(w) == 1 for w in words) / count,
        max(map(len, words), default=0) / 50,
        1.0 if not words else 0.0,
    ]


def metadata_features(source: str | None, lang: str | None, n_chars: float | None) -> list[int]:
    """Buckets of the values that come with a page."""
    size = "none" if n_chars is None or not np.isfinite(n_chars) else str(int(np.log2(max(1.0, float(n_chars)))))
    pairs = (("source", source), ("lang", lang), ("size", size), ("both", f"{source}/{lang}"))
    return [zlib.crc32(f"{k}={v}".encode("utf-8", "surrogatepass")) % METADATA_BUCKETS for k, v in pairs]


def _metadata_matrix(frame: pd.DataFrame) -> np.ndarray:
    out = np.zeros((len(frame), METADATA_BUCKETS))
    clean = frame[["source", "lang", "n_chars"]].astype(object).where(frame[["source", "lang", "n_chars"]].notna(), None)
    for k, values in enumerate(clean.itertuples(index=False, name=None)):
        out[k, metadata_features(*values)] = 1.0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Logistic:
    """Ridge logistic regression over standardised columns, classes weighted alike unless told otherwise, by Newton steps."""

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, balanced: bool = True) -> Logistic:
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = np.column_stack([(x - self.middle) / self.spread, np.ones(len(x))])
        weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean())) if balanced else np.ones(len(y))
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(25):
            p = _sigmoid(z @ self.w)
            slope = z.T @ (weight * (p - y)) + penalty * self.w
            bend = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(bend, slope)
            self.w -= step / max(1.0, np.abs(step).max() / 2)
            if np.abs(step).max() < 1e-6:
                break
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.middle) / self.spread, np.ones(len(x))]) @ self.w


class Model:
    def __init__(self, views: tuple[Logistic, Logistic] | None, calibration: tuple[Logistic, Logistic] | None, blend: Logistic | None, constant: float = 1.0):
        self.views, self.calibration, self.blend, self.constant = views, calibration, blend, constant

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> np.ndarray:
        """Columns: content view, metadata view, both combined; each 0 to 1."""
        if self.views is None:
            return np.full((len(content), 3), self.constant)
        odds = [c.odds(v.odds(x)[:, None]) for v, c, x in zip(self.views, self.calibration, (content, metadata), strict=True)]
        return np.column_stack([_sigmoid(odds[0]), _sigmoid(odds[1]), _sigmoid(self.blend.odds(np.column_stack(odds)))])


#: A view's labels are taken where its ranking of labelled rows, each ranked by a model that hasn't seen it, is right so often, over so many rows at least.
TRUSTED, TRUSTED_ROWS = 0.98, 10


def trusted(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The shares of rows, from the lowest and from the highest score on, whose labels a classifier over ``x`` may be trusted to give."""
    half = np.arange(len(y)) % 2 == 0
    if any(len(set(y[side])) < 2 for side in (half, ~half)):
        return 0.0, 0.0
    place = np.empty(len(y))
    for side in (half, ~half):
        odds = Logistic().fit(x[~side], y[~side]).odds(x[side])
        place[side] = np.argsort(np.argsort(odds, kind="stable")) / len(odds)
    found = []
    for ordered in (1 - y[np.argsort(place, kind="stable")], y[np.argsort(-place, kind="stable")]):
        right = np.flatnonzero(np.cumsum(ordered) >= TRUSTED * np.arange(1, len(y) + 1)) + 1
        found.append(float(right[-1]) / len(y) if len(right) and right[-1] >= TRUSTED_ROWS else 0.0)
    return found[0], found[1]


def cotrain(views: list[np.ndarray], y: np.ndarray, free: list[np.ndarray], rounds: int = 5, share: float = 0.05) -> tuple[Logistic, Logistic]:
    """Two classifiers, each taught by the labels and by what the other was surest of, and can be trusted in, among the unlabelled rows."""
    given = [(np.empty(0, np.int64), np.empty(0)), (np.empty(0, np.int64), np.empty(0))]
    made = [Logistic().fit(x, y) for x in views]
    reach = [trusted(x, y) for x in views]
    for _ in range(rounds):
        fresh = []
        for k in (0, 1):
            odds = made[k].odds(free[k])
            order = np.argsort(odds, kind="stable")
            lows, highs = order[: int(reach[k][0] * len(odds))], order[len(odds) - int(reach[k][1] * len(odds)) :][::-1]
            n = int(share * len(odds))
            n_low = max(1, round(n * (1 - y.mean()))) if n else 0
            known = given[1 - k][0]
            low, high = lows[~np.isin(lows, known)][:n_low], highs[~np.isin(highs, known) & ~np.isin(highs, lows)][: n - n_low]
            fresh.append((np.concatenate([low, high]), np.concatenate([np.zeros(len(low)), np.ones(len(high))])))
        for k in (0, 1):
            given[1 - k] = tuple(np.concatenate(x) for x in zip(given[1 - k], fresh[k], strict=True))
        made = [
            Logistic().fit(np.vstack([views[k], free[k][given[k][0]]]), np.concatenate([y, given[k][1]])) for k in (0, 1)
        ]
    return made[0], made[1]


def fit(taught: pd.DataFrame, kept_apart: pd.DataFrame, free: pd.DataFrame) -> Model:
    """A model from frames of content (lists), source, lang, n_chars and, but for ``free``, quality."""
    if not len(taught) or taught["quality"].nunique() < 2:
        return Model(None, None, None, float(taught["quality"].iloc[0]) if len(taught) else 1.0)
    if not len(kept_apart) or kept_apart["quality"].nunique() < 2:
        kept_apart = taught
    both = [(_content_matrix(f["content"]), _metadata_matrix(f)) for f in (taught, kept_apart, free)]
    y, y_apart = (f["quality"].to_numpy(dtype=float) for f in (taught, kept_apart))
    spare = list(both[2]) if len(free) else [x[:0] for x in both[0]]
    views = cotrain(list(both[0]), y, spare)
    calibration, odds = [], []
    for view, x in zip(views, both[1], strict=True):
        raw = view.odds(x)[:, None]
        calibration.append(Logistic().fit(raw, y_apart, balanced=False))
        odds.append(calibration[-1].odds(raw))
    return Model(views, tuple(calibration), Logistic().fit(np.column_stack(odds), y_apart, balanced=False))


def _content(texts: pd.Series) -> pd.Series:
    return pd.Series([content_features(t if isinstance(t, str) else None) for t in texts])


def _content_matrix(lists: pd.Series) -> np.ndarray:
    return np.array(lists.tolist(), dtype=float).reshape(len(lists), len(content_features(None)))


def _sources(docs: DataFrame) -> DataFrame:
    """The columns that the views read, with nulls for those that ``docs`` lacks."""
    kinds = {"doc_id": "long", "text": "string", "source": "string", "lang": "string", "n_chars": "double"}
    return docs.select(*[(F.col(k) if k in docs.columns else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = 6000, free_rows: int = 6000) -> Model:
    """A model from at most so many labelled and unlabelled documents; a fifth of the labelled ones are kept apart for calibration."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = _sources(shipped(docs))
    ids = cut(rows.select("doc_id").filter(F.col("doc_id").isNotNull()).distinct().join(known, "doc_id", "left"))
    chosen = least_ids(ids.filter("quality is not null"), labelled_rows).unionByName(least_ids(ids.filter("quality is null"), free_rows))
    # At most labelled_rows + free_rows ids.
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct("text", "source", "lang", "n_chars")).alias("r"))
    content = F.pandas_udf(_content, "array<double>")
    found = found.select("doc_id", "quality", content("r.text").alias("content"), "r.source", "r.lang", "r.n_chars", (crc_of_id() % 5 == 0).alias("apart"))
    frame = found.toPandas().sort_values("doc_id", ignore_index=True)
    taught = frame[frame["quality"].notna()]
    taught = taught.assign(quality=(taught["quality"] > 0).astype(float))
    return fit(taught[~taught["apart"]], taught[taught["apart"]], frame[frame["quality"].isna()])


def scored(docs: DataFrame, model: Model, into: str = "quality_scores") -> DataFrame:
    """``docs`` with a struct column: content, metadata and score, each 0 to 1, higher where quality is likelier good."""
    sent = shipped(docs).sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("content double, metadata double, score double")
    def run(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        frame = pd.DataFrame({"source": source, "lang": lang, "n_chars": n_chars})
        made = sent.value.scores(_content_matrix(_content(text)), _metadata_matrix(frame))
        return pd.DataFrame(made, columns=["content", "metadata", "score"])

    def own(name, kind):
        return (F.col(name) if name in docs.columns else F.lit(None)).cast(kind)

    return docs.withColumn(into, run(own("text", "string"), own("source", "string"), own("lang", "string"), own("n_chars", "double")))
