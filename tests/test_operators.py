import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.operators import histogram, profile, quality, sampling, tokens
from tablewright.plans.errors import BadRequest
from tablewright.sources import sinks

OPS = ("sum", "mean", "min", "max", "distinct_count")


def every(df, ops=OPS):
    return profile.run_operations(df, [{"op": "row_count"}] + [{"op": o, "column": "x"} for o in ops])


@pytest.mark.parametrize(
    "kind,values,want",
    [
        ("int", [1, None, 3], (3, 4, 2.0, 1, 3, 3)),
        ("int", [None, None], (2, 0, None, None, None, 1)),
        ("int", [], (0, 0, None, None, None, 0)),
        ("boolean", [True, False, None], (3, 1, 0.5, False, True, 3)),
        ("double", [1.0, 2.0], (2, 3.0, 1.5, 1.0, 2.0, 2)),
    ],
)
def test_aggregates(spark, kind, values, want):
    got = every(spark.createDataFrame([(v,) for v in values], f"x {kind}"))
    assert (got["_row_count"]["sum"], *(got["x"][o] for o in OPS)) == want


def test_aggregates_of_nan_and_text(spark):
    got = every(spark.createDataFrame([(1.0,), (math.nan,), (2.0,)], "x double"))["x"]
    assert math.isnan(got["sum"]) and math.isnan(got["mean"]) and (got["min"], got["max"], got["distinct_count"]) == (1.0, 2.0, 3)
    text = spark.createDataFrame([("1",), ("x",), (None,)], "x string")
    assert every(text, ("min", "max", "distinct_count"))["x"] == {"min": "1", "max": "x", "distinct_count": 3}
    for op in ("sum", "mean"):
        with pytest.raises(BadRequest):
            every(text, (op,))


@pytest.mark.parametrize("operation", [{"op": "median", "column": "x"}, {"op": "sum"}, {"op": "sum", "column": "nope"}, {"column": "x"}])
def test_bad_requests(spark, operation):
    with pytest.raises(BadRequest):
        profile.run_operations(spark.createDataFrame([(1,)], "x int"), [operation])
    with pytest.raises(BadRequest):
        profile.aggregate(spark.createDataFrame([(1,)], "x int"), [])


def test_one_job_for_a_request(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = profile.aggregate(df, [{"op": "sum", "column": "l_quantity"}, {"op": "max", "column": "l_tax"}])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "ReadSchema: struct<l_quantity:double,l_tax:double>" in plan


def test_profiles(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, "a")], "x int, y string")
    assert {r["column"]: r.nulls for r in profile.null_counts(df).collect()} == {"x": 0, "y": 1}
    assert {r["column"]: (r.distinct_count, r.rows) for r in profile.unique_counts(df).collect()} == {"x": (2, 3), "y": (2, 3)}
    assert profile.duplicates(df, "y").first()[0] == 1 and profile.duplicates(df, "z").first()[0] == 0


@pytest.mark.parametrize("n,p99,above", [(1, 0, 0), (2, 1, 0), (51, 50, 0), (52, 50, 1), (100, 98, 1), (101, 99, 1), (152, 149, 2)])
def test_nearest_p99(spark, n, p99, above):
    assert tokens.nearest_quantile(spark.range(n).withColumnRenamed("id", "token_count")).first()[:] == (p99, above)


def test_token_outliers_of_nothing(spark):
    for rows in ([], [(None,)]):
        row = tokens.outliers(spark.createDataFrame(rows, "token_count long")).first()
        assert row.asDict() == dict.fromkeys(("min_tokens", "max_tokens", "too_short", "too_long", "p99_tokens", "above_p99"), 0)
    df = spark.createDataFrame([(4,), (5,), (10_000,), (10_001,)], "token_count long")
    assert tokens.outliers(df).first().too_short == 1 and tokens.outliers(df).first().too_long == 1
    assert [r.token_count for r in tokens.outlier_rows(spark.range(101).select(F.col("id").alias("token_count"))).collect()] == [100]


def test_samples(spark):
    df = spark.range(1000).withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    one, two = (sorted(r.id for r in sampling.exact_sample(df, 50, seed).collect()) for seed in (1, 2))
    assert len(set(one)) == 50 and one != two
    assert one == sorted(r.id for r in sampling.exact_sample(df.repartition(7), 50, 1).collect())
    assert sampling.exact_sample(df, 5000).count() == 1000


def test_samples_of_many_equal_rows(spark):
    few = spark.range(30, 40, 1, 1).withColumn("t", F.lit("x"))
    alike = spark.range(0, 6000, 1, 16).select(F.lit(7).cast("long").alias("id"), F.lit("y").alias("t"))
    for df in (alike, alike.unionByName(few), alike.unionByName(spark.range(100, 9000).withColumn("t", F.lit("z")))):
        for seed in range(6):
            got = sampling.exact_sample(df, 500, seed).collect()
            assert len(got) == 500 and sum(r.id != 7 for r in got) == len({r.id for r in got} - {7})


def test_sample_sends_few_rows_whatever_the_partitions(spark):
    df = spark.range(0, 200_000, 1, 200).withColumn("text", F.repeat(F.lit("word "), 3))
    filtered = sampling.exact_sample(df, 100, 3)
    plan = filtered._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan and filtered.count() == 100
    edge = sampling._edges(100, 200_000)[0]
    assert df.select(F.xxhash64(F.lit(3), "id", "text").alias("h")).filter(F.col("h") <= edge).count() < 400


def test_histogram_edges_against_numpy_at_the_edges(spark):
    for n in (2, 5, 50):
        edges = histogram.log_edges(0.37, 91234.5, n)
        values = sorted({v for e in edges for v in (e, np.nextafter(e, 0), np.nextafter(e, 1e9))} | {0.37, 91234.5, 1e-3, 1e6})
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        got = [r[0] for r in df.select(histogram._edges_below(F.col("x"), edges)).collect()]
        assert got == np.searchsorted(edges, values, side="left").tolist()


def test_quantiles_take_one_scan_a_pass(spark):
    df = spark.range(100_000).select((F.col("id") * 7919 % 100_003).cast("double").alias("x"))
    ordered = sorted(k * 7919 % 100_003 for k in range(100_000))
    got = histogram.order_statistics(df, "x", [0, 25_000, 50_000, 99_999])
    assert got == {k: ordered[k] for k in (0, 25_000, 50_000, 99_999)}


def test_preview(spark):
    kind = "id long, source string, added string, created struct<start:string,end:string>, text string, token_count int, metadata struct<a:int,b:string>"
    rows = [(k, "s", "2024", ("x", "y" if k % 2 else None), "t", 3, (1, None) if k else None) for k in range(8)]
    got = sampling.preview(spark.createDataFrame(rows, kind)).collect()
    assert len(got) == 5 and {r.created for r in got} <= {"x, y", "x, None"}
    assert {r.metadata for r in got} <= {'{"a":1,"b":null}', "null"} and all(isinstance(r.id, str) for r in got)
    assert len(sampling.preview(spark.createDataFrame(rows[:2], kind).drop("metadata").withColumn("created", F.lit("now"))).collect()) == 2
    with pytest.raises(BadRequest):
        sampling.preview(spark.range(3))


def test_log_histogram_equals_numpy(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.integers(1, 6000, 500), [1, 5184, 5999]])
    df = spark.createDataFrame([(int(v),) for v in values] + [(None,)], "token_count long")
    edges = histogram.log_edges(values.min(), values.max())
    want = np.bincount(np.searchsorted(edges, values, side="left"))
    got = histogram.log2_histogram(df).collect()
    assert {r.bin: r["count"] for r in got} == {k: n for k, n in enumerate(want) if n}
    assert got[0].bin_left == 1.0 and all(r.bin_left <= r.bin_center <= r.bin_right for r in got)
    beyond = histogram.log2_histogram(df, bounds=[1.0, 10.0, 100.0]).collect()[-1]
    assert beyond.bin == 3 and beyond.bin_width == 90 and beyond.bin_right == 190


def test_histogram_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(7,), (7,)], "token_count long")
    assert [(r.bin, r["count"]) for r in histogram.log2_histogram(df).collect()] == [(0, 2)]
    assert [(r.bin, r["count"]) for r in histogram.linear_histogram(df, "token_count").collect()] == [(0, 2)]
    for bad in (spark.createDataFrame([(None,)], "token_count long"), spark.createDataFrame([(0,), (3,)], "token_count long")):
        with pytest.raises(BadRequest):
            histogram.log2_histogram(bad)
    with pytest.raises(BadRequest):
        histogram.extent(spark.createDataFrame([("a",)], "token_count string"), "token_count")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.floats(-1e300, 1e300) | st.sampled_from([0.0, 1.0, 1e-300, 5.0]), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double")
    got = histogram.quantiles(df, "x", [0.0, 0.25, 0.5, 0.75, 1.0])
    ordered = np.sort(values)
    for q, v in zip((0.0, 0.25, 0.5, 0.75, 1.0), got):
        p = (len(values) - 1) * q
        a, b = ordered[math.floor(p)], ordered[math.ceil(p)]
        assert v == a + (b - a) * (p - math.floor(p))


def test_box(spark):
    df = spark.createDataFrame([(float(v),) for v in (*range(1, 12), 100)], "x double")
    row = histogram.box_stats(df, "x").first()
    assert (row.min, row.low_whisker, row.median, row.high_whisker, row.max, row["count"]) == (1, 1, 6.5, 11, 100, 12)


def test_report_of_odd_tables(spark):
    kind = "id string, text string, token_count long, `odd.name` map<string,int>"
    empty = quality.report(spark.createDataFrame([], kind)).first()
    assert (empty.total_rows, empty.score, empty.grade, empty.duplicate_texts) == (0, 0.0, "Needs Attention", 0)
    rows = [("1", "a fine text with the words", 6, None), ("1", None, None, None), (None, "", 0, {"a": 1})]
    row = quality.report(spark.createDataFrame(rows, kind)).first()
    assert row.missing == {"id": 1, "text": 1, "token_count": 1, "odd.name": 2}
    assert (row.duplicate_ids, row.duplicate_texts, row.too_short) == (1, 0, 1)
    assert 0 <= row.score <= 100 and sum(row.lang_dist.values()) == 3
    with pytest.raises(BadRequest):
        quality.report(spark.range(3))


def test_extremes(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("c", 5), ("d", 5)], "id string, token_count long")
    assert [r.id for r in sampling.extremes(df, 3).collect()] == ["c", "d", "a"]
    assert [r.id for r in sampling.extremes(df, 4, longest=False).collect()] == ["a", "c", "d", "b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2])], "a int, b string, c array<int>")
    for kind in ("parquet", "json", "orc", "csv"):
        sinks.write(df, str(tmp_path / kind), kind)
        assert spark.read.format(kind).option("header", "true").load(str(tmp_path / kind)).count() == 1
    assert sinks.as_json(df).first()[0] == '{"a":1,"b":null,"c":[1,2]}'
    with pytest.raises(BadRequest):
        sinks.write(df, str(tmp_path / "x"), "xml")
    sent = []
    sinks.submit(sinks.JobRequest("in", "out", "bad", "text", "id"), sent.append)
    assert sent == ['{"excluded_file": "bad", "id_column": "id", "input_file": "in", "output_file": "out", "text_column": "text"}']


def test_registered_reports_judge_every_document(spark, tmp_path):
    from tablewright.plans.queries import queries

    n = sampling.SAMPLE_ROWS + 2501
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("the "), F.repeat(F.lit("word "), 6), F.col("id"))).otherwise(F.concat(F.lit("the fine text "), F.col("id")))
    rare = F.create_map(*[F.lit(x) for pair in ((1, "der und die"), (2, "el los las"), (4, "le et les"), (5, "zzz")) for x in pair])
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.coalesce(F.element_at(rare, F.col("id").cast("int")), text).alias("text"), F.lit("s").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    row = queries()["quality_report"](spark, str(tmp_path)).first()
    assert (row.row_count, row.repetition, row.langs) == (n, len(range(0, n, 3)), 5)
    whole = quality.measures(docs.select(F.col("doc_id").alias("id"), "text", F.lit(3).alias("token_count")), sample_rows=None).first()
    assert sum(whole.lang_dist.values()) == n and whole.repetition_estimate.sample_n == n
