"""``python -m tablewright``: serve the datasets under the root that the environment names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tablewright.plans.engine import Engine
from tablewright.plans.http import server
from tablewright.plans.settings import Settings


def main() -> None:
    own = Settings.of()
    engine = Engine(SparkSession.builder.appName("tablewright").getOrCreate(), own.root, own.cache_seconds, own.sample_rows)
    served = server(engine, own.host, own.port, own.sweep_seconds)
    try:
        served.serve_forever()
    finally:
        served.server_close()


if __name__ == "__main__":
    main()
