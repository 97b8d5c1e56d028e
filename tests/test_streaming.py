import pytest

from tablewright.plans.errors import BadRequest
from tablewright.streaming import watch


def test_arrivals_and_running_totals(spark, tmp_path):
    folder = tmp_path / "in"
    spark.range(10).coalesce(1).write.parquet(str(folder / "v1"))
    stream = watch.arrivals(spark, str(folder), "id long")
    seen = []
    for _ in range(2):
        watch.on_arrival(stream, seen.append, str(tmp_path / "mark")).awaitTermination()
    assert len(seen) == 1 and len(seen[0]) == 1
    spark.range(5).coalesce(1).write.parquet(str(folder / "v2"))
    watch.on_arrival(stream, seen.append, str(tmp_path / "mark")).awaitTermination()
    assert len(seen) == 2
    query = watch.running(stream, [{"op": "row_count"}, {"op": "sum", "column": "id"}]).writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("totals").first()[:] == (15, 55)
    with pytest.raises(BadRequest):
        watch.running(stream, [{"op": "distinct_count", "column": "id"}])


def test_trend_of_a_stream_equals_that_of_a_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = str(tmp_path / "events")
    events.write.parquet(folder)
    stream = spark.readStream.schema(events.schema).parquet(folder)
    watch.trend(stream, late="10 days").writeStream.outputMode("complete").format("memory").queryName("trend").trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.start, r.rows) for r in spark.table("trend").collect()) == sorted((r.start, r.rows) for r in watch.trend(events).collect())
