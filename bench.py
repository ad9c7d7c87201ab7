"""Headline queries, timed: prints one JSON line. The median of three runs, fewer for a query that takes long."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
ENOUGH = 20  # seconds after which a query is not run again
QUERIES = ["j1_clean", "j2_engineer", "p4_describe", "x1_repeated_folds", "f7_anova_f", "e_all_metrics", "n1_knn_join",
           "n1_knn_self_join", "r3_smote", "r13_under05_smoteenn_txn", "r7_tomek_txn", "d7_knorau", "d_all_selectors"]


def main():
    from pyspark.sql import SparkSession

    from raresift import queries

    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "12g")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF}/lineitem.parquet").count()
    took = {}
    for name in QUERIES:
        runs = []
        while len(runs) < RUNS and sum(runs) < ENOUGH:
            start = time.time()
            queries.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs), 3)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(SF.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
