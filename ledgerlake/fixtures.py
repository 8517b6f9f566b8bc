"""Versioned tables built from the plain ones, shared by the queries of a session."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.catalog import Catalog
from ledgerlake.functions.transforms import PartitionSpec
from ledgerlake.model import SchemaSpec
from ledgerlake.operators import deletes
from ledgerlake.plans import predicate as P
from ledgerlake.table import Table

YEARS = range(1995, 2002)
SMALL_COMMITS = 8

_built: dict[tuple, Table] = {}
_catalogs: dict[str, Catalog] = {}


def source(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that executors see too: in the shared one if the session names it, else a temporary one."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="tables-")


def catalog(spark: SparkSession) -> Catalog:
    app = spark.sparkContext.applicationId
    if app not in _catalogs:
        _catalogs.clear()
        _built.clear()
        _catalogs[app] = Catalog.in_memory(spark)
    return _catalogs[app]


def fresh(spark: SparkSession, df: DataFrame, partitioned_by: PartitionSpec | None = None, name: str = "t") -> Table:
    """A new empty table with df's columns, all nullable."""
    place = folder(spark)
    schema = SchemaSpec.from_spark(df.schema)
    return catalog(spark).create_table(f"scratch.{name}_{uuid.uuid4().hex[:8]}", place, schema, partitioned_by=partitioned_by.dump() if partitioned_by else ())


def _once(build: Callable[[SparkSession, str], Table]) -> Callable[[SparkSession, str], Table]:
    def get(spark: SparkSession, sf_dir: str) -> Table:
        catalog(spark)
        key = (build.__name__, sf_dir)
        if key not in _built:
            _built[key] = build(spark, sf_dir)
        return _built[key]

    return get


@_once
def orders_versions(spark: SparkSession, sf_dir: str) -> Table:
    """Orders of a year a commit: sequence 2 is 1995, 8 is 2001."""
    df = source(spark, sf_dir, "orders")
    table = fresh(spark, df, name="orders")
    for year in YEARS:
        table.append(df.where(F.year("o_orderdate") == year).coalesce(1))
    return table


@_once
def orders_keyed(spark: SparkSession, sf_dir: str) -> Table:
    """2: all orders; 3: those of status F deleted; 4: some of these again, dearer; 5: more upserted."""
    df = source(spark, sf_dir, "orders")
    table = fresh(spark, df, name="keyed")
    table.append(df.coalesce(2))
    deletes.delete_where(table, P.Eq("o_orderstatus", "F"))
    table.append(df.where("o_orderstatus = 'F' and o_orderkey % 10 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1).coalesce(1))
    deletes.upsert(table, df.where("o_orderstatus = 'O' and o_orderkey % 7 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 2).coalesce(1), ["o_orderkey"])
    return table


@_once
def lineitem_partitioned(spark: SparkSession, sf_dir: str) -> Table:
    """By year of l_shipdate (2: up to 1998), then also by bucket of l_partkey (4: the rest)."""
    df = source(spark, sf_dir, "lineitem")
    table = fresh(spark, df, PartitionSpec.by(("l_shipdate", "year")), "parted")
    table.append(df.where("year(l_shipdate) <= 1998"))
    table.set_partitioning(table.snapshot().spec().adding("l_partkey", "bucket", 4))
    table.append(df.where("year(l_shipdate) > 1998"))
    return table


@_once
def lineitem_deletes(spark: SparkSession, sf_dir: str) -> Table:
    """2: all; 3: l_quantity > 45 deleted; 4: l_discount > 0.05 deleted."""
    df = source(spark, sf_dir, "lineitem")
    table = fresh(spark, df, name="deletes")
    table.append(df.repartitionByRange(4, "l_shipdate"))
    deletes.delete_where(table, P.Gt("l_quantity", 45.0))
    deletes.delete_where(table, P.Gt("l_discount", 0.05))
    return table


@_once
def events_small(spark: SparkSession, sf_dir: str) -> Table:
    """Events in small commits."""
    df = source(spark, sf_dir, "events")
    table = fresh(spark, df, name="events")
    for k in range(SMALL_COMMITS):
        table.append(df.where(F.col("event_id") % SMALL_COMMITS == k).coalesce(1))
    return table


@_once
def customers(spark: SparkSession, sf_dir: str) -> Table:
    df = source(spark, sf_dir, "customer")
    table = fresh(spark, df, name="customers")
    table.append(df.coalesce(2))
    return table


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
