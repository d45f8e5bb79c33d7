"""Headline timings: prints one JSON line. Reads $BENCH_SF_DIR on local[$BENCH_CPUS]."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumora.catalogue import QUERIES
from lumora.operators import bivariate as B
from lumora.operators import models as M
from lumora.operators import timeseries as T
from lumora.operators import univariate as U
from lumora.operators.quality import profile_columns

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    lines = spark.read.parquet(f"{SF_DIR}/lineitem.parquet")

    def daily() -> DataFrame:
        orders = spark.read.parquet(f"{SF_DIR}/orders.parquet")
        day = F.col("o_orderdate").cast("date").cast("timestamp_ntz").alias("ts")
        return orders.groupBy(day).agg(F.sum("o_totalprice").alias("value"))

    def daily_trend() -> None:
        run(T.moving_average(T.prepare_series(daily(), "ts", ["value"]), "ts", "value", 30))
        run(T.trend(daily(), "ts", "value"))

    def crosstab_chi_square() -> None:
        run(B.crosstab(lines, "l_returnflag", "l_linestatus"))
        run(B.chi_square(lines, "l_returnflag", "l_linestatus"))

    work = {
        "copy_table": lambda: run(lines),
        "q1_profile_columns": lambda: run(profile_columns(lines)),
        "b4_corr_matrix": lambda: run(B.corr_matrix(lines, NUMBERS)),
        "d24_outlier_report": lambda: run(U.outlier_report(lines, NUMBERS)),
        "t4_t14_daily_trend": daily_trend,
        "b12_b14_crosstab_chi_square": crosstab_chi_square,
        "m3_kmeans": lambda: run(M.kmeans_summary(lines, ["l_quantity", "l_extendedprice", "l_discount"])),
    }
    for name in ("d2_extended_stats", "d11_outliers_iqr", "b2_spearman", "b3_kendall", "b11_anova_oneway", "q6_quality_score", "n22_scale_robust",
                 "t10_acf", "t20_anomalies_dbscan", "m8_isolation_forest", "m10_linear_model", "m19_auc", "l3_log_summary", "p13_split_chronological"):
        work[name] = lambda fn=QUERIES[name]: run(fn(spark, SF_DIR))

    lines.limit(10).collect()  # start-up of the session is not timed
    run(lines.groupBy("l_returnflag").count())
    seconds = {}
    for name, job in work.items():
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
