import random

import numpy as np

from tablewright.llm import langid, quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, content string"
WORDS = {
    "en": "the and that with from this have were would there their which".split(),
    "fr": "les des une dans pour avec mais nous vous être cette leurs".split(),
}


def sentences(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def language_docs(n=200):
    rng = random.Random(0)
    return [(k, sentences(("en", "fr")[k % 2], rng.choice([5, 40]), rng), ("en", "fr")[k % 2], "s", 1, None, None) for k in range(n)]


def test_language_of_held_out_and_odd_texts(spark):
    rows = language_docs()
    df = spark.createDataFrame(rows, DOCS)
    model = langid.train(df.filter("doc_id < 150"))
    odd = [(900, None, "en", None, None, None, None), (901, "", None, None, None, None, None), (902, "123 !? _", "fr", None, None, None, None), (903, "the and " * 50_000, None, None, None, None, None)]
    every = spark.createDataFrame(rows + odd + rows[:2], DOCS)
    got = every.select("doc_id", "lang", langid.predicted(every, model).alias("p")).collect()
    assert len(got) == len(rows) + len(odd) + 2
    held = [r.p.lang_pred == r.lang for r in got if 150 <= r.doc_id < 900]
    assert np.mean(held) > 0.95
    by = {r.doc_id: r.p for r in got}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (900, 901, 902))
    assert by[903].lang_pred == "en" and all(0 <= r.p.score <= 1 for r in got)


def test_language_counts_equal_brute_force(spark):
    rows = language_docs(40)
    model = langid.train(spark.createDataFrame(rows, DOCS), bits=10)
    want = {}
    for _, text, lang, *_ in rows:
        for made in langid.features(text, 10):
            for b in made.tolist():
                want.setdefault(lang, np.full(1 << 10, 0.5))[b] += 1
    for k, lang in enumerate(model.languages):
        assert np.allclose(model.log_p[k], np.log(want[lang] / want[lang].sum()), atol=1e-5)


def test_more_languages_than_the_matrix_holds_at_full_bits(spark):
    rows = language_docs(200)
    dirty = [(1000 + k, sentences("en", 5, random.Random(k)), f"en-x{k}", None, None, None, None) for k in range(600)]
    df = spark.createDataFrame(rows + dirty, DOCS)
    model = langid.train(df)
    assert len(model.languages) == 602 and model.log_p.size <= langid.MATRIX and model.bits == 14
    assert np.mean([model.predict(r[1])[0].startswith(r[2]) for r in rows]) > 0.95
    few = langid.train(df.filter("lang in ('en', 'fr')"), rows_per_language=20)
    assert few.bits == 16 and few.languages == ["en", "fr"]


def test_only_letters_count_as_letters(spark):
    rows = language_docs(40)
    model = langid.train(spark.createDataFrame(rows, DOCS))
    got = model.judge(["½ ²", "٣", "Ⅷ", "x", None, "", "\0", "ª"])
    assert [g[0] == "und" for g in got] == [True, True, True, False, True, True, True, False]


def test_language_scores_equal_brute_force(spark, monkeypatch):
    rows = language_docs(60)
    model = langid.train(spark.createDataFrame(rows, DOCS), bits=10)
    texts = ["the which", "une vous être!!", "a", None, "?", "x" * 300, " the\n\nTHE 12 là  ", *[r[1] for r in rows[:30]]]

    def plain(text):
        import unicodedata

        if not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            return "und", 0.0
        kept = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in f" {text.lower()} ")
        kept = " ".join(["", *kept.split(), ""])
        found = [int(langid.buckets(langid.codes(kept[k : k + n]), n, 10)[0]) for n in (1, 2, 3) for k in range(len(kept) - n + 1)]
        total = [sum(float(line[b]) for b in found) for line in model.log_p]
        shown = [t / len(found) * min(len(found), 200) for t in total]
        best = max(range(len(total)), key=lambda k: (total[k], -k))
        return model.languages[best], 1 / sum(np.exp(s - shown[best]) for s in shown)

    want = [plain(t) for t in texts]
    for _ in range(2):
        got = model.judge(texts)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], rtol=1e-5)
        monkeypatch.setattr(langid, "text_blocks", lambda t: ((k, k + 1) for k in range(len(t))))


def test_language_without_anything_to_learn(spark):
    df = spark.createDataFrame([], DOCS)
    assert langid.train(df).predict("some text") == ("und", 0.0)
    assert df.select(langid.predicted(df, langid.train(df)).alias("p")).collect() == []


def plain_toxicity(model, text):
    """The score of a text, from the model's numbers alone, in plain Python."""
    words = [w for w in "".join(c if c.isalnum() or c in "*@$_" else " " for c in (text or "").lower()).split(" ") if w]
    if not words:
        return 0.0
    odds = []
    for w in words:
        points = np.array([32, *map(ord, w), 32], dtype=np.uint32)
        found = []
        for n in toxicity.ORDERS:
            found += [int(toxicity_bucket(points[k : k + n], model.bits)) for k in range(len(points) - n + 1)]
        found.append(whole_bucket(w, model.bits))
        odds.append(sum(float(model.gain[b]) for b in found) / (len(found) + toxicity.PRIOR))
    size = min(toxicity.WINDOW, len(odds))
    top = max(sum(odds[k : k + size]) / size for k in range(len(odds) - size + 1)) + model.bias
    return 1 / (1 + np.exp(-(model.scale * top + model.shift)))


def toxicity_bucket(points, bits):
    made = (0x9E3779B9 * len(points)) & 0xFFFFFFFF
    for p in points.tolist():
        made = (made ^ p) * 0x85EBCA6B & 0xFFFFFFFF
        made ^= made >> 15
    return made >> (32 - bits)


def whole_bucket(word, bits):
    total = 0
    for k, c in enumerate(word):
        mixed = (ord(c) + (k << 21) + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        total = (total + (mixed ^ (mixed >> 31))) & (1 << 64) - 1
    return (total * 0xD6E8FEB86659FD93 & (1 << 64) - 1) >> (64 - bits)


def test_toxicity_scores_equal_brute_force():
    rng = random.Random(6)
    taught = toxic_texts(120, rng)
    model = toxicity.fit([t for t, _ in taught], np.array([y for _, y in taught]), epochs=8)
    texts = [t for t, _ in taught[:40]] + ["idiot", "You, IDIOT!", "m0r*n é1 x_y", "", " ?", None, "a " * 30]
    assert np.allclose(model.scores(texts), [plain_toxicity(model, t) for t in texts], atol=1e-5)


def test_toxicity_of_labels_without_words_and_long_texts(spark):
    for y in ([0, 1, 0, 1], [1, 1, 0, 1]):
        assert toxicity.fit(["", "!?", " ", "..."], np.array(y)).scores(["a word", None]).tolist() == [0.0, 0.0]
    assert toxicity.fit(["fine words", "", ""], np.array([0, 1, 1])).scores(["a word"]).tolist() == [0.0]
    rng = random.Random(7)
    clean = [sentences("en", 4000, rng) for _ in range(30)]
    toxic = [t[:9000] + " idiot moron worthless idiot " + t[9000:] for t in clean]
    rows = [(k, t, "en", None, None, None, None) for k, t in enumerate(clean + toxic)] + [(0, "idiot " * 9, "en", None, None, None, None)]
    rows += [(100 + k, t, "en", None, None, None, None) for k, (t, _) in enumerate(toxic_texts(80, rng))]
    labels = [(k, int(k >= 30)) for k in range(60)] + [(100 + k, int(k % 4 == 0)) for k in range(80)]
    model = toxicity.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.scores(toxic).min() > model.scores(clean).max()
    whole = model.scores(toxic[:3])
    only_long = toxicity.train(spark.createDataFrame(rows[:60], DOCS), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert 0 <= only_long.scores(["idiot"])[0] <= 1
    import tablewright.llm.common as common

    assert np.allclose([scores_in_parts(model, t, common) for t in toxic[:3]], whole)


def scores_in_parts(model, text, common):
    """The score of a text that is cut into many parts."""
    toxicity.text_parts = lambda t: common.text_parts(t, 500)
    try:
        return model.scores([text])[0]
    finally:
        toxicity.text_parts = common.text_parts


def toxic_texts(n, rng, words=("idiot", "moron", "worthless")):
    made = []
    for k in range(n):
        w = [rng.choice(WORDS["en"]) for _ in range(rng.choice([6, 30, 300]))]
        if k % 4 == 0:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(words)
        made.append((" ".join(w), int(k % 4 == 0)))
    return made


def test_toxicity_finds_held_out_and_misspelt_words():
    rng = random.Random(1)
    taught = toxic_texts(400, rng)
    model = toxicity.fit([t for t, _ in taught], np.array([y for _, y in taught]), epochs=24)
    for words in (("idiot", "moron", "worthless"), ("idiott", "mooron", "wothless")):
        held = toxic_texts(200, rng, words)
        scores, y = model.scores([t for t, _ in held]), np.array([y for _, y in held])
        assert ((scores >= 0.3) == y).mean() > 0.95
    assert model.scores([None, "", " !? "]).tolist() == [0, 0, 0]
    again = toxicity.fit([t for t, _ in taught], np.array([y for _, y in taught]), epochs=24)
    assert np.array_equal(model.gain, again.gain)


def test_toxicity_scores_do_not_depend_on_blocks(monkeypatch):
    rng = random.Random(2)
    taught = toxic_texts(120, rng)
    model = toxicity.fit([t for t, _ in taught], np.array([y for _, y in taught]), epochs=8)
    texts = [t for t, _ in taught] + [None, "", "idiot"]
    one_by_one = np.array([model.scores([t])[0] for t in texts])
    assert np.allclose(model.scores(texts), one_by_one)


def test_toxicity_in_spark_and_single_classes(spark):
    rng = random.Random(3)
    rows = [(k, t, "en", None, None, None, None) for k, (t, _) in enumerate(toxic_texts(200, rng))]
    labels = spark.createDataFrame([(k, int(k % 4 == 0), "x") for k in range(200)] + [(0, 0, "y"), (None, 1, None), (5, None, None)], "doc_id long, toxic int, text string")
    df = spark.createDataFrame(rows + [(500, None, None, None, None, None, None), rows[0]], DOCS)
    model = toxicity.train(df, labels)
    got = df.select("doc_id", toxicity.score(df, model).alias("s")).collect()
    assert len(got) == 202 and all(0 <= r.s <= 1 for r in got)
    assert np.mean([(r.s >= 0.3) == (r.doc_id % 4 == 0) for r in got if r.doc_id < 200]) > 0.95
    none = toxicity.train(df, labels.limit(0))
    assert none.scores(["a text", None]).tolist() == [0.0, 0.0]
    all_ = toxicity.fit(["a", "b"], np.array([1, 1]))
    assert all_.scores(["word", ""]).tolist() == [1.0, 0.0]
    empty = spark.createDataFrame([], DOCS)
    assert empty.select(toxicity.score(empty, model).alias("s")).collect() == []


def quality_docs(n=600):
    rng = random.Random(4)
    rows = []
    for k in range(n):
        text = sentences("en", rng.choice([20, 100]), rng)
        if k % 5 == 0:
            text = "!! ".join(text.upper().split()) if k % 2 else "again " * 60
        rows.append((k, text, "en", f"s{k % 5 + rng.choice([0, 0, 0, 1])}", len(text), None, None))
    return rows


def test_quality_of_held_out_documents(spark):
    rows = quality_docs()
    labels = spark.createDataFrame([(k, int(k % 5 != 0), "c") for k in range(300)] + [(1, None, None), (None, 0, None)], "doc_id long, quality int, text string")
    odd = [(900, None, None, None, None, None, None), (901, "", None, None, None, 1.0, "x"), (902, "word " * 100_000, "en", "s1", 500_000, None, None)]
    df = spark.createDataFrame(rows + odd + rows[:1], DOCS)
    model = quality.train(df, labels)
    made = quality.scored(df, model, "q")
    assert made.columns == [*df.columns, "q"]
    got = made.select("doc_id", "q.*").collect()
    assert len(got) == 604
    held = [(r[3] >= 0.5) == (r[0] % 5 != 0) for r in got if 300 <= r[0] < 600]
    assert np.mean(held) > 0.95
    assert all(0 <= x <= 1 for r in got for x in r[1:])
    assert quality.scored(spark.createDataFrame([], DOCS), model).collect() == []
    assert {r[0] for r in quality.scored(df, quality.train(df, labels.limit(0)), "q").select("q.score").collect()} == {1.0}


def plain_content(text):
    """The content features, by plain loops."""
    raw = (text or "").encode()
    words, n = raw.split(), max(1, len(raw))
    count = max(1, len(words))
    upper, lower = sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
    marks = [b for b in raw if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]
    usual = [b for b in marks if chr(b) in "!\"',-.:;?"]
    lines = raw.split(b"\n")
    return [
        np.log(1 + len(raw)), np.log(1 + len(words)), len(raw) / count / 10, upper / max(1, upper + lower), len(marks) / n, (len(marks) - len(usual)) / n,
        raw.count(b"!") / count, (raw.count(b".") + raw.count(b",")) / count, sum(48 <= b <= 57 for b in raw) / n, sum(b > 127 for b in raw) / n,
        raw.count(b"\n") / n, len(set(words)) / count, len(set(words)) / count**0.7, max((words.count(w) for w in set(words)), default=0) / count,
        sum(a == b for a, b in zip(words, words[1:])) / count, (len(lines) - len(set(lines))) / len(lines), sum(len(w) == 1 for w in words) / count,
        max((len(w) for w in words), default=0) / 50, float(not words),
    ]


def test_quality_scores_equal_brute_force(spark):
    rows = [r[:1] + (r[1],) + r[2:] for r in quality_docs(300)] + [(900, None, None, None, None, None, None), (901, "é! \n\n é!", None, "s1", 5, None, None)]
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(200)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, DOCS)
    model = quality.train(df, labels)

    def odds(view, x):
        return sum(w * (v - m) / s for w, v, m, s in zip(view.w, x, view.middle, view.spread)) + view.w[-1]

    for r in quality.scored(df, model, "q").collect():
        metadata = [0.0] * quality.METADATA_BUCKETS
        for k in quality.metadata_features(r.source, r.lang, r.n_chars):
            metadata[k] = 1.0
        each = [odds(c, [odds(v, x)]) for v, c, x in zip(model.views, model.calibration, (plain_content(r.text), metadata))]
        want = [1 / (1 + np.exp(-x)) for x in (*each, odds(model.blend, each))]
        assert np.allclose([r.q.content, r.q.metadata, r.q.score], want, atol=1e-9)


def test_odd_metadata_and_repeated_ids():
    assert quality.metadata_features("s", "en", float("inf")) == quality.metadata_features("s", "en", None) == quality.metadata_features("s", "en", float("nan"))
    assert quality.metadata_features("s", "en", -5.0) == quality.metadata_features("s", "en", 1)


def test_repeated_ids_teach_by_one_text(spark):
    rows = quality_docs(200)
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(200)], "doc_id long, quality int")
    twice = rows + [(k, "zzz later in order", "en", None, None, None, None) for k in range(0, 200, 3) if (rows[k][1] or "") < "zzz"]
    one, two = (quality.train(spark.createDataFrame(r, DOCS).repartition(n), labels) for r, n in ((rows, 2), (twice, 5)))
    assert np.allclose(one.views[0].w, two.views[0].w)


def test_views_teach_each_other():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 40).astype(float)
    hidden = rng.integers(0, 2, 2000).astype(float)

    def view(labels, noise):
        return np.column_stack([labels * 2 - 1 + noise * rng.standard_normal(len(labels)), rng.standard_normal((len(labels), 15))])

    views, free = [view(y, 0.5), view(y, 1.5)], [view(hidden, 0.5), view(hidden, 1.5)]
    alone = quality.Logistic().fit(views[1], y)
    _, taught = quality.cotrain(views, y, free, rounds=8)
    test = rng.integers(0, 2, 2000).astype(float)
    x = view(test, 1.5)
    assert ((taught.odds(x) > 0) == test).mean() > ((alone.odds(x) > 0) == test).mean()


def test_a_view_that_tells_nothing_teaches_nothing():
    rng = np.random.default_rng(1)
    y = (rng.random(400) < 0.85).astype(float)
    told, noise = np.column_stack([y * 2 - 1 + 0.5 * rng.standard_normal(400)]), rng.standard_normal((400, 3))
    assert quality.trusted(noise, y)[0] == 0 and quality.trusted(noise, y)[1] < 0.2
    low, high = quality.trusted(told, y)
    assert low > 0.02 and high > 0.5
    free = rng.standard_normal((3000, 3))
    hidden = (rng.random(3000) < 0.85).astype(float)
    content = np.column_stack([hidden * 2 - 1 + 0.5 * rng.standard_normal(3000)])
    taught, _ = quality.cotrain([told, noise], y, [content, free])
    alone = quality.Logistic().fit(told, y)
    assert ((taught.odds(content) > 0) == hidden).mean() >= ((alone.odds(content) > 0) == hidden).mean() - 0.005


def test_metadata_alone_does_not_need_columns(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.scored(df, quality.train(df, labels), "q").select("q.score").first()[0] == 1.0
