"""Benchmark: run the registered queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row computed,
nothing collected).  Prints ONE JSON line.  Set BENCH_MODELS=1 to include the
model-fitting queries (boosted trees, stacked training).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tessera-bench")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "16g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")

    from tessera.plans.catalog import QUERIES
    qs = {"quality_profile": QUERIES["quality_profile"], **QUERIES}      # the flagship first
    if os.environ.get("BENCH_MODELS") == "1":
        from tessera.plans.models import MODEL_QUERIES
        qs.update(MODEL_QUERIES)

    # warm-up: JVM class loading, first code generation and the Python worker
    # start are one-time costs, not query time.  Generic operations on the two
    # tiny tables no query reads (region, nation).
    from pyspark.sql import Window
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    j.groupBy("r_name").agg(F.count(F.lit(1)), F.percentile_approx("n_nationkey", [0.25, 0.75], 100),
                            F.approx_count_distinct("n_name"), F.count_if(F.col("n_nationkey") > 3)).collect()
    j.withColumn("rn", F.row_number().over(Window.partitionBy("r_name").orderBy("n_nationkey"))) \
        .where("rn <= 2").select(F.md5(F.col("n_name"))).collect()
    n.mapInPandas(lambda it: (p[["n_nationkey"]] for p in it), "n_nationkey INT").collect()

    times: dict[str, float] = {}
    for name, fn in qs.items():
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").split("sf")[-1]
    try:
        sf = float(sf)
    except ValueError:
        pass
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
