import collections
import random
import re
import zlib

from pyspark.sql import functions as F

from tablewright.llm import queries, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    counts = collections.Counter()
    for id_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if id_ is None else id_}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    letters, form, near = {c for w in known for c in w}, {}, {}
    for w in known:
        others = {w[:k] + w[k + 1 :] for k in range(len(w))}
        others |= {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        others = [x for x in others - {w} if x in known]
        best = min(others, key=lambda x: (-known[x], x), default=None)
        near[w], form[w] = len(others), best if best and known[best] >= 2 * known[w] else None
    out = []
    for w in known:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, known[w], near[w], known.get(form[w])))
    return sorted(out)


def found(spark, tmp_path, rows, schema="doc_id long, text string, word string, n long, best string"):
    spark.createDataFrame([(*r, None, 1, "x") for r in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted(tuple(r) for r in queries.op13_spelling(spark, str(tmp_path)).collect())


def test_equals_brute_force(spark, tmp_path):
    rng = random.Random(2)
    stems = ["anna", "hello", "aaaaa", "aaaaaa", "grüßen", "Straße", "straſse", "colour", "color", "ÀÉÎÕÜ", "naïve", "x×y÷z", "bcdef"]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.randrange(60)):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["", "a", "e", "É", "ÿ"])
                w = w or ["a"]
            words.append("".join(w))
        rows.append((rng.choice([k, 7, None]), rng.choice([" ", "-", "1", "\n"]).join(words)))
    rows += [(1, None), (2, ""), (3, "a" * 300), (4, "a" * 300), (5, "hello " * 50_000), (6, "𝒂hello𝒃 hello")]
    want = plain(rows)
    assert found(spark, tmp_path, rows) == want and len(want) > 100 and any(r[1] != r[2] and r[1] for r in want) and max(r[4] for r in want) > 5


def test_long_ways_and_ties(spark, tmp_path):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    rows = [(k, f"{w} " * (3 * 2**k)) for k, w in enumerate(words)] + [(9, "ccccc " * 3 + "cccca ccccb " * 6)]
    want = plain(rows)
    assert found(spark, tmp_path, rows) == want
    by_word = {r[0]: r for r in want}
    assert by_word["aaaaa"][2] == "bbbbb" and by_word["ccccc"][1] == "cccca"


def test_equals_brute_force_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert sorted(tuple(r) for r in queries.op13_spelling(spark, "/root/testdata/sf0.001").collect()) == plain(docs)


def test_no_words(spark, tmp_path):
    assert found(spark, tmp_path, [(1, "one two"), (2, None)]) == []
    assert found(spark, tmp_path / "none", []) == []


def test_groups_and_deletions_make_no_pairs(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = spark.createDataFrame([("word" + c, k + 3) for k, c in enumerate(letters)], "word string, n long")
    assert spelling.by_replacement(words).count() == len(letters)
    assert spelling.by_replacement(words).filter(F.col("near") == len(letters) - 1).count() == len(letters)
    assert {r["best"]["word"] for r in spelling.by_replacement(words).collect()} == {"wordz", "wordy"}
