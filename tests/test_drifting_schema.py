import pytest

from tablewright.plans.engine import Engine
from tablewright.plans.errors import BadRequest


def test_a_version_that_departs_from_the_one_before_is_refused(spark, tmp_path):
    for version, columns in {"v1.9.0": ["id", "id as k"], "v1.10.0": ["id as k", "id"], "v1.11.0": ["id", "cast(id as string) as k", "1 as more"], "v2.0.0": ["id", "cast(id as string) as k", "1 as more"]}.items():
        folder = tmp_path / "a" / "original" / version
        folder.mkdir(parents=True)
        spark.range(3).selectExpr(*columns).coalesce(1).write.parquet(str(folder / "a.parquet"))
    engine, free = Engine(spark, str(tmp_path), same_schema=True), Engine(spark, str(tmp_path))
    count = [{"op": "row_count"}]
    for version in ("v1.9.0", "v1.10.0", "v2.0.0"):
        assert engine.analyse("a", version, count)["columns"]["_row_count"]["sum"] == 3
    for ask in (lambda: engine.analyse("a", "v1.11.0", count), lambda: engine.preview("a", "v1.11.0"), lambda: engine.quality("a", "v1.11.0")):
        with pytest.raises(BadRequest, match=r"departs from v1.10.0: k \(bigint before, string now\), more \(missing before, int now\)"):
            ask()
    assert free.analyse("a", "v1.11.0", count)["columns"]["_row_count"]["sum"] == 3


def test_more_than_one_file_is_refused_where_asked(spark, tmp_path):
    folder = tmp_path / "a" / "original" / "v1"
    folder.mkdir(parents=True)
    for name in ("a", "b"):
        spark.range(3).coalesce(1).write.parquet(str(folder / f"{name}.parquet"))
    assert Engine(spark, str(tmp_path)).analyse("a", "v1", [{"op": "row_count"}])["columns"]["_row_count"]["sum"] == 3
    with pytest.raises(BadRequest):
        Engine(spark, str(tmp_path), strict=True).datasets()
