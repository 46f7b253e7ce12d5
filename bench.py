"""Times the headline queries; prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS set data, cores and timed runs."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quillframe import workload

HEADLINES = (
    "agg_group", "agg_global", "agg_count_distinct", "agg_of_expr", "filter_between", "filter_like", "filter_text_nocase", "filter_and_or",
    "join_inner", "join_left_gap", "join_chain", "join_compound", "topk", "sort_multi", "distinct", "subq_scalar", "subq_in", "subq_not_in", "subq_in_or",
    "fn_round", "fn_substring", "report_revenue", "report_customers", "csv_roundtrip", "update_expr",
)
#: Those of them whose SQL is plain Spark SQL, too, and is timed beside them.
COMPARED = ("agg_group", "filter_between", "filter_like", "filter_text_nocase", "join_inner", "join_chain", "join_compound", "topk", "distinct", "subq_in", "subq_scalar", "report_revenue", "report_customers")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, oracle, took, plain = workload.queries(), workload.oracle_sql(), {}, {}

    def timed(make) -> float:
        began = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    def in_plain_sql(name: str):
        """The query's SQL; like the engine's run, it finds its tables anew."""
        for table in workload.used(oracle[name]):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        return spark.sql(oracle[name])

    for name in HEADLINES:
        times, plain_times = [], []
        for _ in range(runs + 1):  # the first warms up; the two sides take turns
            times.append(timed(lambda: found[name](spark, sf_dir)))
            if name in COMPARED:
                plain_times.append(timed(lambda: in_plain_sql(name)))
        took[name] = round(statistics.median(times[1:]), 4)
        if name in COMPARED:
            plain[name] = round(statistics.median(plain_times[1:]), 4)
    print(json.dumps({"metric": "total of median query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "plain_spark_sql": plain, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
