"""Headline timings: dump parsing, inference and loading at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Dumps are written before the clock starts. The load is timed twice, each into a new target: the first run still
compiles its generated code, which a load of minutes (as in the baseline) does not notice. Prints one JSON line; ``throughput`` gives MB/s and rows/s of the
parsing and loading entries, the units the baseline is stated in.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from sluice.operators.export import export_dump
from sluice.operators.profile import infer_schema
from sluice.operators.values import good_rows, typed_rows
from sluice.plans.migrate import migrate, plan_migration
from sluice.plans.queries import QUERIES
from sluice.session import local_session, scratch
from sluice.sources.dumps import read_statements
from sluice.sources.ranges import list_files

SPLIT_BYTES = 8 * 1024 * 1024
OTHERS = ("progress_running", "task_latest", "metrics_rollup", "chunk_bytes", "column_profile", "stream_status")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    os.environ.setdefault("SLUICE_DRIVER_MEMORY", "16g")
    spark = local_session("bench", cpus)
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rows = lineitem.count()
    dump = export_dump(lineitem.repartition(int(cpus)), "lineitem", scratch(spark, "bench"))
    size = list_files(spark, dump).agg(F.sum("file_size")).first()[0]

    def statements():
        return read_statements(spark, dump, chunk_bytes=SPLIT_BYTES)

    def noop(df):
        df.write.format("noop").mode("overwrite").save()

    def load_lineitem():
        migrate(spark, dump, scratch(spark, "bench-load"), "lineitem", lineitem.schema, chunk_bytes=SPLIT_BYTES).collect()

    jobs = {
        "statement_scan": lambda: noop(statements()),
        "roundtrip_lineitem": lambda: noop(good_rows(typed_rows(statements(), lineitem.schema))),
        "infer_lineitem": lambda: infer_schema(statements()).collect(),
        "load_lineitem_first": load_lineitem,
        "load_lineitem": load_lineitem,
        "plan_lineitem": lambda: plan_migration(spark, dump, allowed_extensions=[".txt"]).collect(),
    }
    for name in OTHERS:
        jobs[name] = lambda q=QUERIES[name]: noop(q(spark, sf_dir))
    noop(good_rows(typed_rows(statements(), lineitem.schema)))  # one untimed run, so that the JVM is warm
    times = {}
    for name, job in jobs.items():
        begun = time.time()
        job()
        times[name] = round(time.time() - begun, 3)
    throughput = {
        name: {"mb_per_s": round(size / 1e6 / times[name], 1), "rows_per_s": round(rows / times[name])}
        for name in ("statement_scan", "roundtrip_lineitem", "infer_lineitem", "load_lineitem_first", "load_lineitem")
    }
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "dump_mb": round(size / 1e6, 1), "rows": rows,
        "throughput": throughput,
    }))


if __name__ == "__main__":
    main()
