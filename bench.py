"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON.

Tables are built before anything is timed. Each query runs once to warm up, then RUNS times; its figure is
without the table layer, so that the layer's cost and gain show.
"""

from __future__ import annotations

import json
import os
import sys
import time
from datetime import datetime
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake import fixtures as X
from ledgerlake import queries as Q
from ledgerlake.operators import changes
from ledgerlake.plans import predicate as P
from ledgerlake.plans import stats

RUNS = 5


def headline(spark: SparkSession, sf_dir: str) -> dict:
    """name: function that gives a DataFrame."""
    line, orders = X.source(spark, sf_dir, "lineitem"), X.source(spark, sf_dir, "orders")
    parted, deleted, versions, keyed = X.lineitem_partitioned(spark, sf_dir), X.lineitem_deletes(spark, sf_dir), X.orders_versions(spark, sf_dir), X.orders_keyed(spark, sf_dir)
    year = P.Between("l_shipdate", datetime(1996, 1, 1), datetime(1996, 12, 31, 23, 59, 59))

    def grouped(df: DataFrame) -> DataFrame:
        return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity"), F.sum("l_extendedprice"), F.avg("l_discount"), F.count("*"))

    def joined(o: DataFrame, l: DataFrame) -> DataFrame:  # noqa: E741
        return o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderpriority").count()

    def total(df: DataFrame) -> DataFrame:
        return df.agg(F.count("*"), F.sum("l_extendedprice"))

    return {
        "group_plain": lambda: grouped(line),
        "group_snapshot": lambda: grouped(parted.df()),
        "join_plain": lambda: joined(orders, line),
        "join_snapshot": lambda: joined(versions.df(), parted.df()),
        "year_all_files": lambda: total(parted.df().where(year.to_column())),
        "year_pruned": lambda: total(parted.df(year)),
        "delete_plain_filter": lambda: total(line.where("(l_quantity > 45) is not true and (l_discount > 0.05) is not true")),
        "delete_snapshot": lambda: total(deleted.df()),
        "stats_by_file": lambda: stats.file_stats(spark.read.parquet(*[f.path for f in parted.read().files])).select("file_path", "l_extendedprice|min", "l_extendedprice|max"),
        "time_travel": lambda: versions.snapshot(4).df().groupBy("o_orderstatus").count(),
        "changes": lambda: changes.read_changes(keyed).groupBy("_txn_seq", "_op").count(),
        "updates_by_key": lambda: changes.read_changes(keyed, 4, keys=("o_orderkey",)).groupBy("_op").count(),
        "flagship": lambda: Q.entry(spark, sf_dir),
    }


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, make in headline(spark, sf_dir).items():
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            make().collect()
            took.append(time.perf_counter() - began)
        times[name] = round(median(took[1:]), 4)
    spark.stop()
    json.dump({"metric": "sum of median seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}, sys.stdout)
    print()


if __name__ == "__main__":
    main()
