"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

The classifier learns from a small labelled URL table (the file ``LABELLED``, or one of the caller's, of which ``most_urls`` rows at most, by a hash of
the url), and its weights, 2**bits numbers, are broadcast. Host and path have n-grams of their own, so the same letters in both count apart.

Host and path: the host runs from after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path from
there up to ``?``, ``#`` or the end. A rule is host and path; it fits its host and all subdomains, where the url's path starts with the
rule's; the longest rule that fits wins, of equally long ones that with the longer host.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged by the method; an
empty path fits only a rule without a path; repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import csv
from importlib import resources

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tablewright.llm.chargrams import buckets, codes
from tablewright.llm.common import least_ids, shipped

#: (host and path, verdict) of the production rules.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))

#: The labelled URL table that comes with the package: url, verdict.
LABELLED = "url_labels.csv"


def labelled_urls() -> list[tuple[str, str]]:
    """The rows of the table that comes with the package."""
    with resources.files(__package__).joinpath(LABELLED).open(newline="", encoding="utf-8") as lines:
        return [(r["url"], r["verdict"]) for r in csv.DictReader(lines)]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) of a url column."""
    rest = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; both null where none does."""
    if any(verdict not in ("allow", "block") for _, verdict in rules):
        raise ValueError("a rule allows or blocks")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]))):
        own_host, slash, rest = text.partition("/")
        fits = ((host == own_host) | host.endswith("." + own_host)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


class Model:
    def __init__(self, weights: np.ndarray, bias: float, bits: int, orders: tuple[int, ...]):
        self.weights, self.bias, self.bits, self.orders = weights, bias, bits, orders

    @staticmethod
    def features(host: str, path: str, bits: int, orders: tuple[int, ...]) -> np.ndarray:
        """Buckets of the n-grams of both parts; those of a host lie in the lower half."""
        half = 1 << (bits - 1)
        parts = [(codes(f"^{host}$"), 0), (codes(f"^{path}$"), half)]
        return np.concatenate([buckets(p, n, bits - 1).astype(np.int64) + base for p, base in parts for n in orders])

    def blocked(self, host: str, path: str) -> float:
        """The probability that a url is to be blocked."""
        found = self.features(host, path, self.bits, self.orders)
        return float(1 / (1 + np.exp(-(self.weights[found].sum() / max(1.0, np.sqrt(len(found))) + self.bias))))


def fit(rows: list[tuple[str, str, str]], bits: int = 15, orders: tuple[int, ...] = (3, 4, 5), ridge: float = 0.01, steps: int = 1200, rate: float = 16.0) -> Model:
    """A model from (host, path, verdict) rows, by gradient descent with a ridge penalty."""
    rows = [r for r in rows if r[2] in ("allow", "block")]
    weights, bias = np.zeros(1 << bits), 0.0
    if rows:
        made = [Model.features(h, p, bits, orders) for h, p, _ in rows]
        index = np.repeat(np.arange(len(rows)), [len(m) for m in made])
        flat, scale = np.concatenate(made), np.array([1 / max(1.0, np.sqrt(len(m))) for m in made])
        y = np.array([r[2] == "block" for r in rows], dtype=float)
        for _ in range(steps):
            odds = np.bincount(index, weights[flat], len(rows)) * scale + bias
            error = (1 / (1 + np.exp(-odds)) - y) / len(rows)
            weights -= rate * (np.bincount(flat, (error * scale)[index], 1 << bits) + ridge / len(rows) * weights)
            bias -= rate * error.sum()
    return Model(weights, float(bias), bits, orders)


def train(labelled: DataFrame, most_urls: int = 10_000) -> Model:
    """A model from a labelled table (url, verdict), by at most ``most_urls`` of its different rows."""
    rows = labelled.select(F.col("url").cast("string").alias("url"), "verdict").distinct()
    rows = rows.select("url", "verdict", F.xxhash64("url", "verdict").alias("id"))
    host, path = split_url(F.col("url"))
    return fit([tuple(r) for r in least_ids(rows, most_urls, "id").select(host, path, "verdict").collect()])


def judged(pages: DataFrame, rules=RULES, model: Model | None = None, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``pages`` with columns host, path, rule, verdict and probability (of a block, by the method) in place of any so named."""
    spark = shipped(pages).sparkSession
    model = model or train(spark.createDataFrame(labelled_urls(), "url string, verdict string"))
    sent = spark.sparkContext.broadcast((model.weights.astype(np.float32), model.bias, model.bits, model.orders))

    @F.pandas_udf("double")
    def run(hosts: pd.Series, paths: pd.Series) -> pd.Series:
        own = Model(*sent.value)
        return pd.Series([own.blocked(h, p) for h, p in zip(hosts, paths, strict=True)])

    host, path = split_url(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "probability": run("host", "path"), "verdict": said})
    own = F.when(F.col("probability") >= threshold, "block").otherwise("allow")
    return rows.withColumn("verdict", F.coalesce("verdict", own))
