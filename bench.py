"""Times the table build, the headline analyses and some others outside the total; prints one JSON line.

Each analysis is written to the ``noop`` sink: one warm-up, then the median of three.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from shelfsight.sources.orderlines import staging_from_orderlines
from shelfsight.sources.parquet_tables import persist_star_schema
from shelfsight.suite import CATALOGUE, DASHBOARD, EXPLORATORY, PRODUCTION
from shelfsight.workspace import local_session, new_folder

RUNS = 3
BESIDE = ("p6_histogram", "p7_mean_median", "v1_fact_key_unique", "v3_foreign_keys")


def seconds(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")

    built = []

    def build() -> None:
        staging = staging_from_orderlines(spark, sf_dir)
        built.append(persist_star_schema(staging, new_folder(spark, "bench")))

    times = {"build_first": seconds(build), "build": seconds(build)}
    tables = built[-1]
    tables.as_of  # noqa: B018 - read once, before the clock starts

    headline = {**PRODUCTION, **EXPLORATORY, **DASHBOARD}
    for name, analysis in {**headline, **{name: CATALOGUE[name] for name in BESIDE}}.items():

        def run(analysis=analysis) -> None:
            analysis(tables).write.format("noop").mode("overwrite").save()

        run()
        times[name] = statistics.median(seconds(run) for _ in range(RUNS))

    rows = tables.fact.count()
    print(
        json.dumps(
            {
                "metric": "total seconds of headline analyses",
                "value": round(sum(times[name] for name in headline), 3),
                "unit": "sec",
                "queries": {name: round(t, 3) for name, t in times.items()},
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "fact_rows": rows,
                "cores": cores,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
