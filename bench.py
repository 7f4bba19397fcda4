"""Time every registered query and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores, ``BENCH_RUNS`` the
timed runs of each query, after one untimed run of all of them. The value is the
sum of the median seconds. With ``BENCH_DUCKDB=1`` the same SQL is timed in DuckDB on as many threads.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from collections.abc import Callable

from cohortsift.catalogue import ORACLES, QUERIES
from cohortsift.session import local_session


def timed(jobs: dict[str, Callable[[], object]], runs: int) -> dict[str, float]:
    for job in jobs.values():
        job()
    medians = {}
    for name, job in jobs.items():
        seconds = []
        for _ in range(runs):
            begin = time.perf_counter()
            job()
            seconds.append(time.perf_counter() - begin)
        medians[name] = round(statistics.median(seconds), 4)
    return medians


def spark_times(folder: str, cpus: str, runs: int, names: list[str]) -> dict[str, float]:
    spark = local_session(cpus, app="bench")

    def job(name: str) -> Callable[[], None]:
        return lambda: QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    try:
        return timed({name: job(name) for name in names}, runs)
    finally:
        spark.stop()


def duckdb_times(folder: str, cpus: str, runs: int, names: list[str]) -> dict[str, float]:
    import duckdb

    con = duckdb.connect(config={"threads": int(cpus)})
    for file in sorted(os.listdir(folder)):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from read_parquet('{folder}/{file}')")
    return timed({name: lambda s=ORACLES[name]: con.execute(s).to_arrow_table() for name in names}, runs)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(QUERIES)
    times = spark_times(folder, cpus, runs, names)
    result = {
        "metric": "sum of median query seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": cpus,
        "runs": runs,
    }
    if os.environ.get("BENCH_DUCKDB"):
        result["duckdb"] = duckdb_times(folder, cpus, runs, names)
    print(json.dumps(result))


if __name__ == "__main__":
    main()
