import random
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from tablewright.functions import profiles
from tablewright.operators import quality


def plain_trigrams(text):
    words = " " + regex.sub(r"[^\p{L}]+", " ", (text or "").lower()).strip(" ") + " "
    return [words[k : k + 3] for k in range(len(words) - 2) if words[k + 1] != " "]


def plain_ranked(grams, size=300):
    return [g for g, _ in sorted(Counter(grams).items(), key=lambda x: (-x[1], x[0]))[:size]]


def plain_detected(text, learned, size=300):
    score = Counter()
    for k, g in enumerate(plain_ranked(plain_trigrams(text), size)):
        for lang, ranks in learned.items():
            if g in ranks:
                score[lang] += size - abs(ranks[g] - k)
    best = min(score, key=lambda x: (-score[x], x), default=None)
    return best if best and score[best] > 0 else "unknown"


def plain_learned(rows, size=300):
    grams = {}
    for lang, text in rows:
        if lang is not None:
            grams.setdefault(lang, []).extend(plain_trigrams(text))
    return {lang: {x: k for k, x in enumerate(plain_ranked(g, size))} for lang, g in grams.items() if g}


def test_equals_plain_python(spark):
    texts = [None, "", " 12 .!", "a", "I", "été", "Привет, мир! Привет", "日本語のテキスト", "x1y2z3", "AÉÎ ÕÜ ß", "straße STRASSE", "𝒂𝒃𝒄 𝒅", "hello world " * 500, "ab" * 100_000]
    rng = random.Random(1)
    texts += ["".join(rng.choice("abc é-1") for _ in range(rng.randrange(80))) for _ in range(100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in df.select(profiles.trigrams(F.col("text"))).collect()] == [plain_trigrams(t) for t in texts]
    for size in (5, 300):
        assert [r[0] for r in df.select(profiles.ranked(F.col("text"), size)).collect()] == [plain_ranked(plain_trigrams(t), size) for t in texts]


@pytest.mark.parametrize("size", [20, 300])
def test_detection_equals_plain_python(spark, size):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text")
    other = [(-1, "ru", "Съешь ещё этих мягких французских булок, да выпей чаю"), (-2, None, "no language is stated"), (-3, "ja", "色は匂へど散りぬるを"), (-4, "xx", None), (-5, "en", "..."), (-6, "zz", "the the the and and of")]
    docs = docs.unionByName(spark.createDataFrame(other, docs.schema))
    rows = docs.collect()
    learned = profiles.learned(docs.filter("doc_id % 2 = 0 or doc_id < 0"), "text", "lang", size)
    want = plain_learned([(r.lang, r.text) for r in rows if r.doc_id % 2 == 0 or r.doc_id < 0], size)
    assert {(r.lang, r.gram, r["rank"] - 1) for r in learned.collect()} == {(lang, g, k) for lang, x in want.items() for g, k in x.items()}
    found = dict(docs.select("doc_id", profiles.detector(learned, size)(F.col("text"))).collect())
    assert found == {r.doc_id: plain_detected(r.text, want, size) for r in rows}
    assert found[-1] == "ru" and found[-3] == "ja" and found[-4] == found[-5] == "unknown"


def test_accuracy_on_rows_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text").repartition(4)
    found = profiles.detector(profiles.learned(docs.filter("doc_id % 3 <> 1"), "text", "lang"))
    shares = docs.filter("doc_id % 3 = 1").groupBy("lang").agg(F.avg((found(F.col("text")) == F.col("lang")).cast("int"))).collect()
    assert len(shares) == 4 and min(share for _, share in shares) >= 0.95


def test_profiles_are_folded_into_a_literal_and_plug_into_the_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = profiles.detector(profiles.learned(docs, "text", "lang"))
    assert "from_json" not in docs.select(found(F.col("text")).alias("lang"))._jdf.queryExecution().optimizedPlan().toString()
    counts = quality.language_counts(docs, detector=found).collect()
    assert sum(r.n for r in counts) == docs.count() and {r.lang for r in counts} >= {"en", "fr", "de", "es"}


def test_nothing_learned_and_too_many_languages(spark, monkeypatch):
    df = spark.createDataFrame([(None, "a text"), ("en", None), ("fr", "1")], "lang string, text string")
    assert [r[0] for r in df.select(profiles.detector(profiles.learned(df, "text", "lang"))(F.col("text"))).collect()] == ["unknown"] * 3
    monkeypatch.setattr(profiles, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError):
        profiles.detector(spark.createDataFrame([("a", " a ", 1), ("b", " a ", 1)], "lang string, gram string, rank int"))


def test_texts_are_judged_without_lambdas_over_characters(spark):
    """Lambdas over a text's characters, which Spark interprets, took most of the time."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learned = profiles.learned(docs, "text", "lang")
    for df in (learned, docs.select(profiles.detector(learned)(F.col("text")))):
        assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
