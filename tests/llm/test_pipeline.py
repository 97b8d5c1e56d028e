import zlib

import corpus_pipeline
import pytest
from corpus_pipeline import STAGES, language_stage, run
from pyspark.sql import functions as F
from test_decontaminate import brute as leaks
from test_packing import plain_ids
from test_simhash import plain_components, plain_fingerprint

from tablewright.llm import langid, queries

SMALL = "/root/testdata/sf0.001"


def plainly_accepted(model, rows):
    """Which rows the language stage keeps, by the model's findings one by one."""
    for r in rows:
        lang, score, learned, n = model.judge([r.text])[0]
        wrong = r.lang in model.languages and r.lang != lang and score >= 0.99 and n >= 600
        yield learned and not wrong


def test_stages_do_what_they_say(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    for name, stage in STAGES:
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        before, made = docs.collect(), spark.read.parquet(str(tmp_path / name))
        after = made.collect()
        if name == "packing":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert sum(r.length for r in after) == sum(len(plain_ids(r.text)) + 1 for r in before)
            continue
        assert made.columns == columns and set(after) <= set(before)
        kept = {r.doc_id for r in after}
        if name == "quality":
            good = [k for k, q in labels.items() if q == 1]
            assert sum(k in kept for k in good) >= 0.97 * len(good)
        if name == "language":
            assert kept == {r.doc_id for r, fine in zip(before, plainly_accepted(langid.train(docs), before)) if fine}
        if name == "near_copies":
            root = plain_components([plain_fingerprint(r.text) for r in before])
            least = {}
            for r in before:
                f = root[plain_fingerprint(r.text)]
                least[f] = min(r.doc_id, least.get(f, r.doc_id))
            assert sorted(kept) == sorted(least.values())
        if name == "leaks":
            flagged = {int(r[0]) for r in leaks([(r.doc_id, r.text) for r in before], items) if r[5]}
            assert kept == {r.doc_id for r in before} - flagged
        docs = made


def test_run_and_odd_rows(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, __null string"
    rows = [(1, "Some fine words here. " * 30, "en", "s", 1, None), (2, None, None, None, None, None), (1, "Some fine words here. " * 30, "en", "s", 1, None), (None, "123", None, None, None, "x"), (4, "", "en", None, 0, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this is in it at all, I dare say"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = run(spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.piece) for r in got] == [(1, 0)]
    spark.createDataFrame([], kind).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert run(spark, str(tmp_path)).collect() == []


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries() if k.startswith("op")) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_held_out_rows_follow_the_hash(spark):
    got = queries.op7_language(spark, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.held_out for r in got) > 20
    toxic = queries.op2_toxicity(spark, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in toxic)


def test_language_stage_rejects_by_the_model(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    texts = {
        -1: "Съешь же ещё этих мягких французских булок, да выпей чаю. " * 5,
        -2: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. " * 3,
        -3: "xq zjwkv bnmtrq fghjkl wqxz pppp zzzz qqqqxx vbkj hgfd " * 5,
        -4: "The and that with this.",
    }
    odd = spark.createDataFrame([(k, t, None) for k, t in texts.items()], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in language_stage(spark, docs.unionByName(odd), SMALL).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")} | {-4}


def test_language_stage_rejects_wrongly_stated_languages(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    long = docs.filter("length(text) > 1000")
    french, english = (long.filter(f"lang = '{k}'").select((-10 - F.col("doc_id")).alias("doc_id"), "text").limit(5) for k in ("fr", "en"))
    wrong = french.withColumn("lang", F.lit("en")).unionByName(english.withColumn("lang", F.lit("de")))
    unsaid = french.select((F.col("doc_id") - 100_000).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang"))
    strange = english.select((F.col("doc_id") - 200_000).alias("doc_id"), "text", F.lit("xx").alias("lang")).limit(1)
    every = docs.unionByName(wrong).unionByName(unsaid)
    kept = {r.doc_id for r in language_stage(spark, every, SMALL).collect()}
    assert not kept & {r.doc_id for r in wrong.collect()} and kept >= {r.doc_id for r in unsaid.collect()}
    assert kept >= {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    model = langid.train(docs)
    found = strange.withColumn("f", langid.predicted(strange, model))
    assert found.filter(langid.accepted(F.col("f"), F.col("lang"), model)).count() == 1
    monkeypatch.setattr(corpus_pipeline, "LANGUAGES", ("fr",))
    only = language_stage(spark, docs, SMALL)
    assert {r.lang for r in only.collect()} == {"fr"}


def test_a_named_run_goes_on_and_leaves_nothing_but_its_result(spark, tmp_path, monkeypatch):
    from pathlib import Path

    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    calls, stages = [], corpus_pipeline.STAGES

    def counted(name, stage):
        def called(*args):
            calls.append(name)
            if name == "leaks" and calls.count("leaks") == 1:
                raise RuntimeError("an executor too many was lost")
            return stage(*args)

        return name, called

    monkeypatch.setattr(corpus_pipeline, "STAGES", [counted(*s) for s in stages])
    with pytest.raises(RuntimeError):
        run(spark, SMALL, "one")
    assert sorted(p.name for p in (Path(tmp_path) / "pipeline-one").iterdir()) == ["2-near_copies"]
    got = run(spark, SMALL, "one")
    assert calls == [*(n for n, _ in stages[:4]), "leaks", "packing"]
    assert sorted(p.name for p in (Path(tmp_path) / "pipeline-one").iterdir()) == ["4-packing"]
    again = run(spark, SMALL, "one")
    assert len(calls) == 6 and again.count() == got.count() > 0


def test_a_name_belongs_to_its_input_and_stages(spark, tmp_path, monkeypatch):
    """Another folder, a changed file or other stages under the same name start anew."""
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path / "shared"))
    keep = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", keep), ("last", keep)])
    kind = "doc_id long, text string, lang string, source string, n_chars long"

    def tables(name, n):
        spark.createDataFrame([(k, "x", "en", "s", 1) for k in range(n)], kind).write.mode("overwrite").parquet(f"{tmp_path}/{name}/documents.parquet")
        for other in ("labels", "benchmark"):
            spark.range(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}/{other}.parquet")
        return f"{tmp_path}/{name}"

    one, two = tables("a", 3), tables("b", 5)
    assert [run(spark, d, "n").count() for d in (one, two, two, one)] == [3, 5, 5, 3]
    tables("a", 4)
    assert run(spark, one, "n").count() == 4
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", keep), ("other", lambda spark, docs, sf_dir: docs.limit(1))])
    assert run(spark, one, "n").count() == 1


def test_an_unnamed_run_is_forgotten_in_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("only", lambda spark, docs, sf_dir: docs)])
    ends = []
    monkeypatch.setattr(corpus_pipeline.atexit, "register", lambda f, *args: ends.append((f, args)))
    assert run(spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count() and len(list(tmp_path.iterdir())) == 2
    for f, args in ends:
        f(*args)
    assert list(tmp_path.iterdir()) == []


def test_stages_with_ids_of_several_texts(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    one, two = ("Some fine words here, and more of the same sort. " * 20, "Quite another text that stands beside it, though with no other id. " * 20)
    rows = [(1, one, "en", "s", 900), (1, two, "en", "s", 900), (1, one, "en", "t", None), (2, one, "en", "s", 900), (None, two + " x", "en", None, None), (None, two + " x", "en", None, None)]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "not in any of them, as far as these words go")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = run(spark, str(tmp_path)).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    root = plain_components([plain_fingerprint(r[1]) for r in rows])
    assert sum(r.piece == 0 for r in got) == len(set(root.values()))
