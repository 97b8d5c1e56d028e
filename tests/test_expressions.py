import pytest

from tablewright.operators import expressions as E, profile
from tablewright.plans.engine import Engine
from tablewright.plans.errors import BadRequest


def c(name):
    return {"column": name}


def v(value):
    return {"value": value}


def op(name, *args):
    return {"op": name, "args": list(args)}


@pytest.fixture
def df(spark):
    rows = [(1, 2.0, "abc", True, "2024-01-02"), (2, None, "b`c", False, "2024-02-01"), (3, -1.5, None, None, None), (None, 0.0, "ABC", True, "2023-12-31")]
    return spark.createDataFrame(rows, "`a` int, `x y` double, t string, f boolean, d string").selectExpr("a", "`x y`", "t", "f", "cast(d as timestamp_ntz) as d")


@pytest.mark.parametrize(
    "condition, want",
    [
        (op("=", c("a"), v(2)), [2]),
        (op(">=", c("x y"), v(0)), [1, None]),
        (op("!=", c("a"), v(None)), []),
        (op("in", c("a"), v(1), v(3), v(9)), [1, 3]),
        (op("and", c("f"), op("<", c("a"), v(5))), [1]),
        (op("or", op("is_null", c("t")), op("not", c("f"))), [2, 3]),
        (op("contains", c("t"), v("`")), [2]),
        (op("starts_with", c("t"), v("a")), [1]),
        (op("ends_with", c("t"), v("C")), [None]),
        (op(">", op("length", c("t")), v(2)), [1, 2, None]),
        (op("<", c("d"), v("2024-01-15")), [1, None]),
        (op("=", c("d"), v("no time")), []),
        (op(">", op("/", v(1), c("x y")), v(0.1)), [1]),
        (op(">", op("+", c("a"), op("*", v(2), op("-", c("a"), v(1)))), v(3)), [2, 3]),
        (v(True), [1, 2, 3, None]),
        (op("and", v(None), v(True)), []),
    ],
)
def test_conditions(df, condition, want):
    assert sorted((r.a for r in E.where(df, condition).collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(
    "condition",
    [
        None, "a = 1", {}, {"column": "nope"}, {"column": "a", "value": 1}, c("a"), op("=", c("a"), v("1")), op("=", c("a")), op("and"), op("and", c("a")), op("+", c("a"), v(1)), op("contains", c("a"), v("x")),
        op("exec", c("a")), op("=", c("a"), v([1])), op("=", c("a"), v(2**70)), op("<", c("f"), v(1)), {"op": "and", "args": "ab"}, op(["="], c("a"), v(1)), op("in", c("a")), v(None),
    ],
)
def test_what_is_refused(df, condition):
    with pytest.raises(BadRequest):
        E.where(df, condition)


def test_trees_are_bounded(df):
    deep = v(True)
    for _ in range(E.MOST_DEPTH + 1):
        deep = op("not", deep)
    for tree in (deep, op("and", *[v(True)] * E.MOST_PARTS)):
        with pytest.raises(BadRequest):
            E.where(df, tree)


def test_derived_columns(df):
    made = E.derived(df, [{"name": "b", "expression": op("+", c("a"), v(1))}, {"name": "half", "expression": op("/", c("b"), v(2))}])
    assert [(r.b, r.half) for r in made.orderBy("a").collect()] == [(None, None), (2, 1.0), (3, 1.5), (4, 2.0)]
    for bad in ([{"name": "a", "expression": v(1)}], [{"name": "", "expression": v(1)}], [{"name": "z"}], ["z"]):
        with pytest.raises(BadRequest):
            E.derived(df, bad)


def test_conditions_reach_the_scan_and_results_are_kept_apart(spark, tmp_path):
    folder = tmp_path / "a" / "original" / "v1"
    folder.mkdir(parents=True)
    spark.range(100).selectExpr("id", "id % 3 as k").coalesce(1).write.parquet(str(folder / "a.parquet"))
    engine = Engine(spark, str(tmp_path))
    condition = op("and", op(">=", c("id"), v(90)), op("=", c("k"), v(0)))
    ops = [{"op": "row_count"}, {"op": "sum", "column": "twice"}]
    twice = [{"name": "twice", "expression": op("*", c("id"), v(2))}]
    got = engine.analyse("a", "v1", ops, where=condition, derived=twice)
    assert got["columns"] == {"_row_count": {"sum": 4}, "twice": {"sum": 2 * (90 + 93 + 96 + 99)}}
    assert engine.analyse("a", "v1", ops[:1])["columns"]["_row_count"]["sum"] == 100
    plan = E.where(engine.read("a", "v1"), condition)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,90)" in plan and "EqualTo(k,0)" in plan


def test_metrics_come_with_the_requests_own_job(spark, tmp_path):
    folder = tmp_path / "a" / "original" / "v1"
    folder.mkdir(parents=True)
    spark.range(100).selectExpr("id", "case when id % 4 = 0 then id end as k").coalesce(1).write.parquet(str(folder / "a.parquet"))
    engine, ops = Engine(spark, str(tmp_path)), [{"op": "sum", "column": "k"}, {"op": "max", "column": "id"}]
    df, tracker = engine.read("a", "v1"), spark.sparkContext.statusTracker()
    jobs = []
    for name, run in (("plain", lambda: profile.run_operations(df, ops)), ("metered", lambda: engine.analyse("a", "v1", ops, where=op("<", c("id"), v(50))))):
        spark.sparkContext.setJobGroup(name, name)
        got = run()
        jobs.append(len(tracker.getJobIdsForGroup(name)))
    spark.sparkContext.setJobGroup("", "")
    metrics = got["metrics"]
    assert metrics["rows"] == 50 and metrics["nulls"] == {"k": 37, "id": 0} and metrics["file_bytes"] > 0 and metrics["seconds"] > 0
    assert jobs[1] - jobs[0] <= 1  # the footer of the file, which the plain run has read before
