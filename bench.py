"""One JSON line: median wall seconds of the headline queries at $BENCH_SF_DIR."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
NAMES = "where_exists count_items agg_folds aggregate_fold subsetting set_functions sort_keys select_body arithmetic strings_basic strings_regex math_functions conversions date_components date_filter three_valued props_variant vector_ops narrative resolve_join env_join project_rows constraints".split()


def main() -> None:
    from pyspark.sql import SparkSession

    from pathloom import queries as q
    from pathloom.sources import star

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds, planning, shuffles = {}, {}, {}
    for name in NAMES:
        began = time.perf_counter()
        df = q.QUERIES[name](spark, SF)
        shuffles[name] = df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
        planning[name] = round(time.perf_counter() - began, 3)
        took = []
        for i in range(RUNS + 1):
            began = time.perf_counter()
            q.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            if i:
                took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took), 3)
    # expressions of one resource over resources held in memory, as an interpreter would have them
    customers = star.resource(spark, SF, "Customer").repartition(int(CPUS)).cache()
    customers.count()
    expressions = ["name.upper()", "balance > 1000", "name.replaceMatches('0+', '-')", "iif(balance < 0, 'debt', segment)", "name.substring(2, 4) & segment", "balance.abs().sqrt().round(6)"]
    big = spark.range(100).withColumnRenamed("id", "copy").crossJoin(customers).repartition(int(CPUS)).cache()
    n = big.count()
    rate = {}
    for e in expressions:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            q.ENGINE.project(big, {"v": e}, kind="Customer").write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        rate[e] = round(n / statistics.median(took))
    print(json.dumps({"metric": "total of median seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": SF, "first_planning_sec": planning, "shuffles": shuffles, "resources_per_sec": rate}))
    sys.stdout.flush()
    os._exit(0)


if __name__ == "__main__":
    main()
