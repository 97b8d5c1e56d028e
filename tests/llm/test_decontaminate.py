import hashlib
import random
import re

from tablewright.llm import decontaminate as D

DOCS = "doc_id long, text string, n_words string, place int, items string"
ITEMS = "item_id long, text string, size int"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for item_id, t, *_ in items:
            own = words(t)
            n = min(10, len(own))
            grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    found |= {str(item_id)} if item_id is not None else set()
        named = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((str(doc_id), len(w), len(hit), len(found), named, bool(hit)))
    return sorted(out)


def report(spark, docs, items, **more):
    made = D.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in made.collect())


def case():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(30)] + ["Éa", "éa", "ΣΑΣ", "don't", "x1", "İ", "K"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "  ", " - "]) for _ in range(n))

    items = [(k, text(rng.choice([1, 2, 3, 5, 8, 9, 10, 11, 12, 25, 40])), 1) for k in range(25) if k not in (3,)]
    items = [i for i in items if len(words(i[1])) > 2 or i[0] % 5 == 0]
    items += [(900, None, None), (901, "", None), (902, " ?! ", None), (None, text(15), None), items[0], (903, items[0][1], None)]
    docs = []
    for k in range(80):
        body = text(rng.choice([0, 1, 4, 9, 10, 11, 30, 200]))
        if k % 2:
            taken = rng.choice(items)[1] or ""
            w = taken.split(" ")
            body += " ".join(w[rng.randrange(0, 4) :]).upper() + text(rng.choice([0, 7]))
        docs.append((k, body, None, None, None))
    docs += [(500, None, "x", 1, "y"), (501, "", None, None, None), docs[1], docs[1], (1, docs[3][1], None, None, None), (None, docs[1][1], None, None, None)]
    docs.append((600, text(20_000), None, None, None))
    return docs, items


def test_report_equals_brute_force(spark):
    docs, items = case()
    assert report(spark, docs, items) == brute(docs, items)


def test_long_windows_alone(spark):
    docs, items = case()
    items = [i for i in items if len(words(i[1])) >= 10]
    want = brute(docs, items)
    assert report(spark, docs, items) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_in_slices_and_empty_tables(spark):
    docs, items = case()
    made = D.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_bytes=12_000)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in made.collect()) == [r[:3] for r in brute(docs, items)]
    assert report(spark, [], items) == []
    assert report(spark, docs, []) == brute(docs, [])


def test_clean_keeps_rows_as_they_are(spark):
    docs, items = case()
    df = spark.createDataFrame(docs, DOCS)
    kept = D.clean(df, spark.createDataFrame(items, ITEMS))
    assert kept.columns == df.columns
    flags = {(str(d[0]), d[1]): bool(words(d[1])) and brute([d], items)[0][5] for d in docs}
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted((str(d[0]), d[1] or "") for d in docs if not flags[(str(d[0]), d[1])])


def test_plan_is_native(spark):
    docs, items = case()
    df = D.report(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)


def test_spans_are_cut_out(spark):
    docs, items = case()
    df = spark.createDataFrame([d[:4] + (d[4],) for d in docs], DOCS)
    made = D.without_spans(df, spark.createDataFrame(items, ITEMS))
    assert made.columns == df.columns and made.count() == len(docs)
    grams = set()
    for _, t, *_ in items:
        own = words(t)
        n = min(10, len(own))
        grams |= {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()

    def plain(text):
        if text is None:
            return None
        parts = re.findall(r"[^0-9A-Za-z\x80-\U0010ffff]*[0-9A-Za-z\x80-\U0010ffff]+", text)
        w, hit = words(text), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
        return "".join(p for k, p in enumerate(parts) if k not in hit) + text[len("".join(parts)) :]

    want = sorted((str(d[0]), plain(d[1]) or "") for d in docs)
    assert sorted((str(r.doc_id), r.text or "") for r in made.collect()) == want
    assert any(p != (d[1] or "") for d, (_, p) in zip(sorted(docs, key=lambda d: str(d[0])), want))


def test_one_opening_in_a_thousand_items(spark):
    opening = " ".join(f"o{k}" for k in range(12))
    items = [(k, f"{opening} ending {k} " + " ".join(f"i{k}x{j}" for j in range(9)), 1) for k in range(1000)]
    docs = [(k, f"some words {opening} and more", None, None, None) for k in range(40)] + [(k, "", None, None, None) for k in range(100, 300)]
    docs += [(400, items[7][1], None, None, None)]
    found, of = D.windows(spark.createDataFrame(items, ITEMS), 10)
    assert found.filter(found.words[0] == "o0").count() == 1 and of.count() == 1000 * 14
    got = {r.doc_id: (r.n_hit, len(r.items)) for r in D.judged(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()}
    assert got == {**{k: (12, 1000) for k in range(40)}, **{k: (0, 0) for k in range(100, 300)}, 400: (23, 1000)}
