import os
import shutil

import pytest
from pyspark.sql import functions as F

from tablewright.operators import quality, states
from tablewright.plans.errors import BadRequest
from tablewright.sources.adapters import corpus
from tablewright.streaming import watch

ESTIMATED = ("duplicate_ids", "duplicate_texts")


@pytest.fixture
def parts(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    extra = spark.createDataFrame([(5, "héllo � <b>x</b>", "en", "s", 1), (None, None, None, None, None), (6, "", None, None, 0), (7, "again again again again again again", "en", "s", 1)] * 2, docs.schema)
    paths = []
    for k, df in enumerate([docs.filter("doc_id % 3 = 0"), docs.filter("doc_id % 3 = 1"), docs.filter("doc_id % 3 = 2").unionAll(extra)]):
        folder = str(tmp_path / f"in{k}")
        df.coalesce(1).write.parquet(folder)
        paths += [f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet")]
    return paths


def adapt(df):
    return corpus(df, "doc_id", "text", "source")


def plain(spark, paths):
    return quality.report(adapt(spark.read.parquet(*paths)), sample_rows=None).first().asDict(True)


def n(spark, paths):
    return spark.read.parquet(*paths).count()


def total(report):
    return report.select("total_rows").first()[0]


def same(report, want):
    found = report.first().asDict(True)
    assert found.keys() == want.keys()
    for k in want:
        assert found[k] == (pytest.approx(want[k], rel=1e-12) if isinstance(want[k], float) else want[k]), k


def test_merged_reports_equal_whole_ones(spark, tmp_path, parts):
    store = states.Store(spark, str(tmp_path / "states"), adapt)
    assert store.add(parts[:1]) == parts[:1] and store.add(parts[:1]) == []
    same(store.report(), plain(spark, parts[:1]))
    assert store.add(parts) == parts[1:]
    same(store.report(), plain(spark, parts))
    assert total(store.report(parts[1:])) == n(spark, parts[1:])
    with pytest.raises(BadRequest):
        store.report([str(tmp_path / "none")])


def test_sketches_estimate_duplicates_only(spark, tmp_path, parts):
    store = states.Store(spark, str(tmp_path / "states"), adapt, exact=False)
    store.add(parts)
    found, want = store.report().first().asDict(True), plain(spark, parts)
    for k in ESTIMATED:
        assert abs(found[k] - want[k]) <= 4 * 0.008 * want["total_rows"]
    for k in ("total_rows", "missing", "lang_dist", "p99_tokens", "above_p99", "html_like", "too_short", "repetition"):
        assert found[k] == want[k]


def test_an_addition_and_a_report_read_no_other_file(spark, tmp_path, parts):
    store = states.Store(spark, str(tmp_path / "states"), adapt)
    store.add(parts[:1])
    want, stamps = n(spark, parts[:2]), {p: store._stamp(p) for p in parts}
    os.remove(parts[0])
    assert store.add([*parts[:1], parts[1]]) == [parts[1]]
    os.remove(parts[1])
    with pytest.raises(BadRequest):
        store.report()
    store._stamp = stamps.get
    assert total(store.report()) == want


def test_a_changed_file_counts_as_it_is_now(spark, tmp_path, parts):
    store = states.Store(spark, str(tmp_path / "states"), adapt)
    store.add(parts[:2])
    shutil.copy(parts[2], parts[0])
    os.remove(os.path.join(os.path.dirname(parts[0]), f".{os.path.basename(parts[0])}.crc"))
    os.utime(parts[0], (1, 1))
    assert total(store.report()) == n(spark, parts[1:2])
    assert store.add(parts[:2]) == parts[:1]
    assert total(store.report()) == n(spark, parts[1:])


def test_an_addition_that_broke_off_does_not_count(spark, tmp_path, parts):
    store = states.Store(spark, str(tmp_path / "states"), adapt)
    store.add(parts[:1])
    shutil.copytree(tmp_path / "states" / "files", tmp_path / "kept")
    store.add(parts[1:])
    shutil.rmtree(tmp_path / "states" / "files")
    shutil.copytree(tmp_path / "kept", tmp_path / "states" / "files")
    store.add(parts[1:2])
    assert total(store.report()) == n(spark, parts[:2])


def test_files_with_other_columns_are_refused(spark, tmp_path, parts):
    store = states.Store(spark, str(tmp_path / "states"), lambda df: df.withColumn("token_count", F.lit(1)), id_="doc_id")
    store.add(parts[:1])
    spark.read.parquet(parts[1]).withColumn("more", F.lit(1)).coalesce(1).write.parquet(str(tmp_path / "more"))
    with pytest.raises(BadRequest):
        store.add([str(tmp_path / "more")])


def test_states_on_arrival(spark, tmp_path, parts):
    folder = tmp_path / "arriving"
    folder.mkdir()
    store = states.Store(spark, str(tmp_path / "states"), adapt)
    stream = watch.arrivals(spark, str(folder), spark.read.parquet(parts[0]).schema)
    for k, path in enumerate(parts):
        shutil.copy(path, folder / f"{k}.parquet")
        watch.on_arrival(stream, store.add, str(tmp_path / "mark")).awaitTermination()
        assert total(store.report()) == n(spark, parts[: k + 1])
    assert len({batch for batch, _ in store.files().values()}) == len(parts)


def test_rows_at_the_quantile_in_several_languages_are_not_above_it(spark):
    """Rows 986 to 1,000 are of equal length, in five languages; the quantile is row 990."""
    rows = [(k, "aa x" if k < 986 else f"{'abcde'[k % 5] * 2} x y z") for k in range(1001)]
    docs = corpus(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    found = lambda text: F.substring(text, 1, 2)
    whole = quality.report(docs, sample_rows=None, detector=found)
    of_states = states.report(states.counts(docs, F.col("source"), detector=found), states.keys(docs, F.col("source"), ["id", "text"]), docs.columns)
    for made in (whole, of_states):
        assert made.select("p99_tokens", "above_p99").first()[:] == (4, 0)
