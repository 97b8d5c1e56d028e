import json
import threading
import urllib.error
import urllib.request

import pytest

from tablewright.plans.engine import Engine
from tablewright.plans.http import answer, server
from tablewright.plans.settings import Settings


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("served")
    folder = top / "a/original/v1"
    folder.mkdir(parents=True)
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("cast(event_id as string) id", "event_type text", "cast(user_id as int) token_count", "ts", "value")
    events.repartition(3).write.parquet(str(folder / "a.parquet"))
    return Engine(spark, str(top))


def test_routes(engine, spark, tmp_path):
    assert answer(engine, "GET", "/healthz")[0] == answer(engine, "GET", "/readyz")[0] == 200
    assert answer(Engine(spark, str(tmp_path / "none")), "GET", "/readyz")[0] == 503
    assert [d["slug"] for d in answer(engine, "GET", "/api/v1/datasets")[1]] == ["a"]
    assert answer(engine, "GET", "/api/v1/datasets/a/original/v1")[1]["row_count"] == 1000
    status, made = answer(engine, "POST", "/api/v1/analysis/run", {"dataset": "a", "version": "v1", "operations": [{"op": "row_count"}]})
    assert status == 200 and made["columns"] == {"_row_count": {"sum": 1000}}
    assert answer(engine, "GET", f"/api/v1/analysis/cache/{made['key']}") == (200, made)
    assert answer(engine, "POST", "/api/v1/quality/basic", {"dataset": "a", "variant": "original", "version": "v1"})[1]["row_count"] == 1000
    plot = {"dataset": "a", "version": "v1", "operations": [{"op": "line", "column": "value", "time": "ts"}]}
    line = answer(engine, "POST", "/api/v1/plots", plot)[1]
    assert line["mark"]["type"] == "line" and sum(r["rows"] for r in line["data"]["values"]) == 1000
    for method, path, body, want in (
        ("GET", "/api/v1/datasets/z", None, 404),
        ("GET", "/api/v1/analysis/cache/z", None, 404),
        ("GET", "/nothing", None, 404),
        ("POST", "/api/v1/analysis/run", {"dataset": "a", "version": "v9", "operations": []}, 404),
        ("POST", "/api/v1/analysis/run", {"dataset": "a", "version": "v1", "operations": [{"op": "mode"}]}, 400),
        ("POST", "/api/v1/plots", {"dataset": "a", "version": "v1"}, 400),
        ("POST", "/api/v1/plots", {"dataset": "a", "version": "v1", "operations": [{"op": "line", "column": "value"}]}, 400),
        ("POST", "/api/v1/analysis/preview", {"dataset": "a", "version": "v1"}, 400),
        ("POST", "/api/v1/plots", {"dataset": "a", "version": "v1", "operations": 5}, 500),
    ):
        assert answer(engine, method, path, body)[0] == want


def test_server(engine):
    served = server(engine, port=0, sweep_seconds=0.05)
    thread = threading.Thread(target=served.serve_forever, daemon=True)
    thread.start()
    url = f"http://127.0.0.1:{served.server_address[1]}"
    try:
        with urllib.request.urlopen(f"{url}/healthz", timeout=30) as r:
            assert json.load(r) == {"status": "ok"}
        request = urllib.request.Request(f"{url}/api/v1/analysis/run", b"no json", method="POST")
        with pytest.raises(urllib.error.HTTPError) as failed:
            urllib.request.urlopen(request, timeout=30)
        assert failed.value.code == 400
    finally:
        served.shutdown()
        served.server_close()
        thread.join(10)


def test_settings():
    assert Settings.of({}) == Settings()
    own = Settings.of({"TABLEWRIGHT_ROOT": "/x", "TABLEWRIGHT_PORT": "99", "OTHER": "1"})
    assert (own.root, own.port, own.cache_seconds) == ("/x", 99, 600)
