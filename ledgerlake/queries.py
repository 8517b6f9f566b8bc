"""One query for each operator and capability, and SQL that gives the same rows from the plain tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake import fixtures as X
from ledgerlake import limits as L
from ledgerlake import relations as R
from ledgerlake.catalog import Catalog, MutationBuilder
from ledgerlake.functions.masks import Mask
from ledgerlake.functions.transforms import PartitionField, PartitionSpec
from ledgerlake.functions.zorder import interleaved, zorder_key
from ledgerlake.model import AppendFiles, ColumnSpec, DataFile, FileSpec, Mutation, SchemaSpec
from ledgerlake.operators import changes, compaction, deletes, maintenance, partitions, security
from ledgerlake.plans import stats
from ledgerlake.plans import predicate as P
from ledgerlake.plans.scan import Plan, ScanRequest
from ledgerlake.sources.formats import LanceRead, ParquetRead, Reader, files_of, limited
from ledgerlake.streaming import changelog, ingest
from ledgerlake.table import Table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = " ".join(sql.split())
        return f

    return add


def _money(c: str) -> Column:
    """An exact sum of amounts, whatever the order of rows."""
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


_MONEY = "cast(sum(cast({} as decimal(18,2))) as double)"

# Scans


@query("select r_regionkey, r_name from region")
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reader.new(spark, "Parquet").read(f"{sf_dir}/region.parquet")


@query("select o_orderkey, o_totalprice from orders where o_totalprice > 200000")
def scan_projected_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Reader.new(spark, "parquet").read(f"{sf_dir}/orders.parquet", options=ParquetRead(columns=("o_orderkey", "o_totalprice"), where="o_totalprice > 200000"))


@query("select c_custkey, c_name from customer order by c_custkey limit 50 offset 20")
def scan_limit_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = LanceRead(limit=50, offset=20)
    return limited(X.source(spark, sf_dir, "customer").select("c_custkey", "c_name").orderBy("c_custkey"), own.limit, own.offset)


@query("select count(*) as record_count from lineitem")
def scan_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of(X.source(spark, sf_dir, "lineitem")).agg(F.sum("record_count").alias("record_count"))


@query("select o_orderkey, o_orderstatus from orders where o_custkey < 500 order by o_totalprice desc, o_orderkey limit 25")
def scan_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan().filter(P.Lt("o_custkey", 500)).sort(("o_totalprice", False), ("o_orderkey",)).limit(25).project("o_orderkey", "o_orderstatus")
    return X.orders_versions(spark, sf_dir).snapshot().scan(plan.build())


@query("select o_orderkey, o_custkey from orders where year(o_orderdate) in (1996, 1999)")
def scan_chosen_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshot = X.orders_versions(spark, sf_dir).snapshot()
    files = tuple(f.uuid for f in snapshot.view.files if f.added in (3, 6))
    return snapshot.scan(ScanRequest(files=files, columns=("o_orderkey", "o_custkey")))


@query("select column_name, data_type from (values ('r_regionkey', 'int'), ('r_name', 'string')) t(column_name, data_type)")
def scan_schema_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Reader.new(spark, "parquet").read(f"{sf_dir}/region.parquet").schema
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in schema], "column_name string, data_type string")


# Snapshots and time travel


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def snapshot_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_versions(spark, sf_dir).df(columns=("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))


def _time_travel(sequence: int) -> None:
    year = 1993 + sequence

    @query(f"select o_orderstatus, count(*) as n, {_MONEY.format('o_totalprice')} as total from orders where year(o_orderdate) <= {year} group by all", f"time_travel_v{sequence}")
    def travel(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.orders_versions(spark, sf_dir).snapshot(sequence).df().groupBy("o_orderstatus").agg(F.count("*").alias("n"), _money("o_totalprice").alias("total"))


for _n in (2, 4, 6, 8):
    _time_travel(_n)


@query("select year(o_orderdate)::integer as y, count(*) as n from orders where year(o_orderdate) <> 1997 group by all")
def append_then_delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that shares the files of orders_versions, without those of 1997."""
    old = X.orders_versions(spark, sf_dir).read()
    table = X.fresh(spark, X.source(spark, sf_dir, "orders"), name="dropped")
    own = [_spec(f) for f in old.files]
    table.write().append_files(own).commit()
    table.write().delete_files([f.uuid for f in table.read().files if f.path == own[2].path]).commit()
    return table.df().groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


def _spec(f: DataFile) -> FileSpec:
    return FileSpec(f.path, f.record_count, f.size_bytes, f.format, partition_values=f.partition_values, column_stats=f.column_stats)


@query("select 7::bigint as files, count(*) as records from orders")
def snapshot_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.totals(X.catalog(spark), str(X.orders_versions(spark, sf_dir).ident), 8).select("files", "records")


@query("select year(o_orderdate)::bigint - 1993 as txn_sequence, count(*) as rows from orders group by all")
def read_at_every_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_versions(spark, sf_dir)
    return spark.createDataFrame([(e.sequence, sum(c.file.record_count for c in e.file_changes)) for e in table.events(after=1)], "txn_sequence long, rows long")


# Schema evolution


@query("select c_custkey, c_nationkey::bigint as c_nationkey, null::varchar as email from customer where c_custkey <= 100 union all select c_custkey, c_nationkey::bigint, 'x@' || c_custkey from customer where c_custkey > 100")
def schema_evolution_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widened and added columns: files written before are read in the new schema."""
    df = X.source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    table = X.fresh(spark, df, name="evolved")
    table.append(df.where("c_custkey <= 100").coalesce(1))
    table.evolve(SchemaSpec.of(("c_custkey", pa.int64(), True), ("c_nationkey", pa.int64(), True), ("email", pa.string(), True)))
    table.append(df.where("c_custkey > 100").withColumns({"c_nationkey": F.col("c_nationkey").cast("long"), "email": F.concat(F.lit("x@"), "c_custkey")}).coalesce(1))
    return table.df()


@query("select c_custkey, c_nationkey from customer where c_custkey <= 100")
def schema_of_old_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.source(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    table = X.fresh(spark, df, name="old")
    table.append(df.where("c_custkey <= 100").coalesce(1))
    table.evolve(SchemaSpec.of(("c_nationkey", pa.int64(), True), ("c_custkey", pa.int64(), True), ("email", pa.string(), True)))
    return table.snapshot(2).df()


@query("select * from (values (1, 1, 'r_regionkey'), (1, 2, 'r_name'), (2, 1, 'r_name'), (2, 2, 'r_regionkey'), (2, 3, 'note')) t(schema_version, position, column_name)")
def schema_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.fresh(spark, X.source(spark, sf_dir, "region"), name="history")
    table.evolve(SchemaSpec((ColumnSpec("r_name", pa.string(), True), ColumnSpec("r_regionkey", pa.int32(), True), ColumnSpec("note", pa.string(), True))))
    rows = R.schema_columns(X.catalog(spark), str(table.ident))
    return rows.select("schema_version", F.posexplode("columns").alias("p", "column_name")).select("schema_version", (F.col("p") + 1).alias("position"), "column_name")


@query("select * from (values (2::bigint, 'type_changed', 'r_regionkey'), (2::bigint, 'added', 'note')) t(sequence, change, column_name)")
def schema_change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.fresh(spark, X.source(spark, sf_dir, "region"), name="changed")
    table.evolve(SchemaSpec.of(("r_regionkey", pa.int64(), True), ("r_name", pa.string(), True), ("note", pa.string(), True)))
    return spark.createDataFrame([(c["sequence"], c["change"], c["column"]) for c in changes.schema_changes(table, 1)], "sequence long, change string, column_name string")


# The log


@query("select year(o_orderdate)::bigint - 1993 as txn_sequence, 1::bigint as added, 0::bigint as removed from orders group by all union all select 1, 0, 0")
def event_log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.event_counts(X.catalog(spark), str(X.orders_versions(spark, sf_dir).ident))


@query("select o_orderkey, o_custkey from orders where year(o_orderdate) between 1997 and 1999")
def net_delta_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_versions(spark, sf_dir)
    added = tuple(f.uuid for f in table.diff(3, 6).added_files)
    return table.snapshot(6).scan(ScanRequest(files=added, columns=("o_orderkey", "o_custkey")))


def _churned(spark: SparkSession, sf_dir: str) -> Table:
    """2: region; 3: nation's first file kept in place of it."""
    df = X.source(spark, sf_dir, "region")
    table = X.fresh(spark, df, name="churn")
    table.append(df.where("r_regionkey < 2").coalesce(1))
    table.append(df.where("r_regionkey >= 2").coalesce(1))
    table.write().delete_files([f.uuid for f in table.read().files if f.added == 3]).commit()
    table.append(df.where("r_regionkey = 4").coalesce(1))
    return table


@query("select * from (values ('added', 1::bigint)) t(change, n)")
def net_changes_by_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file added and removed in the range is in neither list."""
    return R.net_changes(X.catalog(spark), str(_churned(spark, sf_dir).ident), 2, 5).groupBy("change").agg(F.count("*").alias("n"))


@query("select * from (values ('added', 1::bigint)) t(change, n)")
def net_changes_by_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.delta_by_anti_join(X.catalog(spark), str(_churned(spark, sf_dir).ident), 2, 5).groupBy("change").agg(F.count("*").alias("n"))


@query("select 0::bigint as chain_gaps, 0::bigint as schema_gaps")
def log_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident, catalog = str(X.orders_versions(spark, sf_dir).ident), X.catalog(spark)
    return R.chain_gaps(catalog, ident).agg(F.count("*").alias("chain_gaps")).crossJoin(R.schema_gaps(catalog, ident).agg(F.count("*").alias("schema_gaps")))


@query("select count(*) as files, (select count(*) from orders) as records from range(7)")
def metadata_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_versions(spark, sf_dir)
    R.register_views(X.catalog(spark))
    return spark.sql("""select count(*) as files, sum(f.record_count) as records from meta_files f join meta_tables t using (table_uuid)
        where t.table_name = :name and f.removed_in_sequence is null""", {"name": table.ident.name})


@query("select * from (values ('visible', 2::bigint), ('deleted', 1::bigint)) t(state, n)")
def file_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lifecycle(X.catalog(spark), str(_churned(spark, sf_dir).ident), 2).groupBy("state").agg(F.count("*").alias("n"))


# Predicates: each on the versioned orders, with pruning

_PREDICATES = {
    "eq": (P.Eq("o_orderstatus", "F"), "o_orderstatus = 'F'"),
    "ne": (P.Ne("o_orderstatus", "F"), "o_orderstatus <> 'F'"),
    "lt": (P.Lt("o_totalprice", 50000.0), "o_totalprice < 50000"),
    "le": (P.Le("o_custkey", 40), "o_custkey <= 40"),
    "gt": (P.Gt("o_orderdate", datetime(2000, 3, 1)), "o_orderdate > timestamp '2000-03-01'"),
    "ge": (P.Ge("o_orderkey", 9000), "o_orderkey >= 9000"),
    "between": (P.Between("o_orderdate", datetime(1996, 2, 1), datetime(1997, 2, 1)), "o_orderdate between timestamp '1996-02-01' and timestamp '1997-02-01'"),
    "in": (P.In("o_custkey", (1, 5, 9, 13)), "o_custkey in (1, 5, 9, 13)"),
    "not_in": (P.NotIn("o_orderpriority", ("1-URGENT", "5-LOW")), "o_orderpriority not in ('1-URGENT', '5-LOW')"),
    "is_null": (P.IsNull("o_orderstatus"), "o_orderstatus is null"),
    "is_not_null": (P.IsNotNull("o_orderstatus"), "o_orderstatus is not null"),
    "like": (P.Like("o_orderpriority", "%-H%"), "o_orderpriority like '%-H%'"),
    "starts_with": (P.StartsWith("o_orderpriority", "2-"), "starts_with(o_orderpriority, '2-')"),
    "and": (P.Eq("o_orderstatus", "O") & P.Lt("o_custkey", 100), "o_orderstatus = 'O' and o_custkey < 100"),
    "or": (P.Lt("o_custkey", 20) | P.Gt("o_orderkey", 14000), "o_custkey < 20 or o_orderkey > 14000"),
    "not": (~P.Between("o_totalprice", 1000.0, 400000.0), "not (o_totalprice between 1000 and 400000)"),
    "always": (P.Always(), "true"),
}


def _predicate(key: str, predicate: P.Predicate, where: str) -> None:
    @query(f"select o_orderkey, o_custkey from orders where {where}", f"pred_{key}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return X.orders_versions(spark, sf_dir).df(predicate, ("o_orderkey", "o_custkey"))


for _key, (_p, _where) in _PREDICATES.items():
    _predicate(_key, _p, _where)


@query("select year(o_orderdate)::integer as y, count(*) as n from orders where o_orderdate >= timestamp '1999-06-01' and o_orderdate < timestamp '2000-06-01' group by all")
def prune_stats_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.Ge("o_orderdate", datetime(1999, 6, 1)) & P.Lt("o_orderdate", datetime(2000, 6, 1))
    return X.orders_versions(spark, sf_dir).df(p).groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))


@query("select l_returnflag, count(*) as n, {} as quantity from lineitem where l_shipdate >= timestamp '1997-01-01' and l_shipdate <= timestamp '1997-12-31' group by all".format(_MONEY.format("l_quantity")))
def prune_partition_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.Between("l_shipdate", datetime(1997, 1, 1), datetime(1997, 12, 31))
    return X.lineitem_partitioned(spark, sf_dir).df(p).groupBy("l_returnflag").agg(F.count("*").alias("n"), _money("l_quantity").alias("quantity"))


@query("select l_orderkey, l_linenumber from lineitem where l_partkey = 77")
def prune_partition_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old files lack the bucket: for them it is unknown, and they are read."""
    return X.lineitem_partitioned(spark, sf_dir).df(P.Eq("l_partkey", 77), ("l_orderkey", "l_linenumber"))


@query("select 7::bigint as files_total, 1::bigint as files_read, count(*) as rows_read from orders where year(o_orderdate) = 1998")
def plan_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = X.orders_versions(spark, sf_dir).snapshot().cost(P.Eq("o_orderdate", datetime(1998, 5, 1)))
    return spark.createDataFrame([(c.files_total, c.files_read, c.rows_read)], "files_total long, files_read long, rows_read long")


@query("select * from (values ('eq', 0.1), ('range', 0.33), ('between', 0.25), ('and', 0.033), ('not', 0.9)) t(k, s)".replace("0.1)", "0.1::double)"))
def selectivity_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, r = P.Eq("a", 1), P.Lt("a", 1)
    rows = {"eq": e, "range": r, "between": P.Between("a", 1, 2), "and": e & r, "not": ~e}
    return spark.createDataFrame([(k, round(p.selectivity(), 6)) for k, p in rows.items()], "k string, s double")


# Statistics

_LOWS = "min(o_totalprice) as low, max(o_totalprice) as high, count(*) - count(o_orderstatus) as nulls, count(*) as n"


@query(f"select year(o_orderdate)::integer as y, {_LOWS} from orders group by all")
def file_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = X.orders_versions(spark, sf_dir).read().files
    rows = [(1993 + f.added, f.column_stats["o_totalprice"]["min"], f.column_stats["o_totalprice"]["max"], f.column_stats["o_orderstatus"]["nulls"], f.record_count) for f in files]
    return spark.createDataFrame(rows, "y int, low double, high double, nulls long, n long")


@query(f"select {_LOWS} from orders")
def table_column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_versions(spark, sf_dir)
    m, kept = maintenance.column_statistics(table), maintenance.refresh_table_stats(table)
    return spark.createDataFrame([(m["o_totalprice"]["min"], m["o_totalprice"]["max"], m["o_orderstatus"]["nulls"], kept["record_count"])], "low double, high double, nulls long, n long")


@query("select min(l_extendedprice) as low, max(l_extendedprice) as high, count(*) as n from lineitem")
def scan_file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured from a scan rather than kept, by file, then over files."""
    by_file = stats.file_stats(X.source(spark, sf_dir, "lineitem"))
    return by_file.agg(F.min("l_extendedprice|min").alias("low"), F.max("l_extendedprice|max").alias("high"), F.sum("record_count").alias("n"))


@query()
def distinct_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate: sketches of each year's orders, united."""
    table = X.orders_versions(spark, sf_dir)
    return stats.distinct_estimate(X.union([stats.sketch(table.snapshot(s).df(), "o_custkey") for s in (3, 8)]), "o_custkey")


@query("select count(distinct o_custkey) as distinct_customers, count(distinct o_orderpriority) as distinct_priorities from orders")
def distinct_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_versions(spark, sf_dir).df().agg(F.count_distinct("o_custkey").alias("distinct_customers"), F.count_distinct("o_orderpriority").alias("distinct_priorities"))


@query("select bin, count(*) as n from (select case when l_quantity < 0 then 0 when l_quantity >= 50 then 11 else floor(l_quantity / 5)::bigint + 1 end as bin from lineitem) group by all")
def histogram_equi_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.equi_width(X.source(spark, sf_dir, "lineitem"), "l_quantity", 0, 50, 10)


@query("select o_orderpriority as value, count(*) as n from orders group by all")
def histogram_singleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.singleton(X.orders_versions(spark, sf_dir).df(), "o_orderpriority")


@query()
def histogram_equi_height(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.equi_height(X.orders_versions(spark, sf_dir).df(), "o_totalprice", 10)


@query("select avg(l_linenumber) as average from lineitem")
def column_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.average(X.source(spark, sf_dir, "lineitem"), "l_linenumber")


# Transforms


def _transform(key: str, table: str, field: PartitionField, id_column: str, sql: str) -> None:
    @query(f"select {id_column}, {sql} as p from {table}", f"transform_{key}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = X.source(spark, sf_dir, table)
        return df.select(id_column, field.column(df.schema[field.source].dataType).alias("p"))


def _mul(x: str, factor: int) -> str:
    return f"((({x}) * {factor}) & 4294967295)"


def _rot(x: str, n: int) -> str:
    return f"(((({x}) << {n}) | (({x}) >> {32 - n})) & 4294967295)"


def _bucket_sql(value: str, buckets: int) -> str:
    """Murmur3 of a long's 8 bytes in SQL over unsigned numbers, step by step in nested selects."""
    steps = [
        f"select cast(({value}) & 4294967295 as ubigint) as a, cast((({value}) >> 32) & 4294967295 as ubigint) as b",
        f"select {_mul(_rot(_mul('a', 3432918353), 15), 461845907)} as a, {_mul(_rot(_mul('b', 3432918353), 15), 461845907)} as b",
        f"select ({_rot('a', 13)} * 5 + 3864292196) & 4294967295 as h, b",
        "select xor(h, b) as h",
        f"select ({_rot('h', 13)} * 5 + 3864292196) & 4294967295 as h",
        "select xor(h, 8::ubigint) as h",
        f"select {_mul('xor(h, h >> 16)', 2246822507)} as h",
        f"select {_mul('xor(h, h >> 13)', 3266489909)} as h",
        "select xor(h, h >> 16) as h",
        f"select ((h & 2147483647) % {buckets})::integer as h",
    ]
    out = steps[0]
    for step in steps[1:]:
        out = f"{step} from ({out})"
    return f"({out})"


for _args in (
    ("identity", "orders", PartitionField(1, "o_orderstatus", "identity"), "o_orderkey", "o_orderstatus"),
    ("year", "orders", PartitionField(1, "o_orderdate", "year"), "o_orderkey", "year(o_orderdate)::integer"),
    ("month", "orders", PartitionField(1, "o_orderdate", "month"), "o_orderkey", "(year(o_orderdate) * 12 + month(o_orderdate) - 1)::integer"),
    ("day", "orders", PartitionField(1, "o_orderdate", "day"), "o_orderkey", "date_diff('day', date '1970-01-01', o_orderdate::date)::integer"),
    ("hour", "events", PartitionField(1, "ts", "hour"), "event_id", "floor(epoch_us(ts) / 3600000000)::bigint"),
    ("bucket", "part", PartitionField(1, "p_partkey", "bucket", 16), "p_partkey", _bucket_sql("p_partkey", 16)),
    ("truncate_int", "part", PartitionField(1, "p_size", "truncate", 7), "p_partkey", "(p_size - p_size % 7)::integer"),
    ("truncate_text", "part", PartitionField(1, "p_name", "truncate", 3), "p_partkey", "left(p_name, 3)"),
    ("void", "part", PartitionField(1, "p_name", "void"), "p_partkey", "null::varchar"),
):
    _transform(*_args)


@query()
def transform_bucket_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.source(spark, sf_dir, "part")
    return df.select("p_partkey", PartitionField(1, "p_name", "bucket", 16).column(df.schema["p_name"].dataType).alias("p"))


# Partitions


@query("select year(l_shipdate)::varchar as l_shipdate_year, count(*) as records from lineitem group by all")
def partition_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.lineitem_partitioned(spark, sf_dir)
    return R.partition_stats(X.catalog(spark), str(table.ident), table.read().sequence, "l_shipdate_year").select("l_shipdate_year", "records")


@query("select year(l_shipdate)::integer as y, count(*) as n from lineitem where year(l_shipdate) <> 1996 group by all")
def partition_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.lineitem_partitioned(spark, sf_dir).read()
    table = X.fresh(spark, X.source(spark, sf_dir, "lineitem"), PartitionSpec.by(("l_shipdate", "year")), "part_drop")
    table.write().append_files([_spec(f) for f in old.files]).commit()
    partitions.drop_partition(table, {"l_shipdate_year": 1996})
    return table.df().groupBy(F.year("l_shipdate").alias("y")).agg(F.count("*").alias("n"))


@query("select l_returnflag, count(*) as n from lineitem group by all")
def partition_evolution_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lineitem_partitioned(spark, sf_dir).df().groupBy("l_returnflag").agg(F.count("*").alias("n"))


# Deletes

_LEFT = "(l_quantity > 45) is not true and (l_discount > 0.05) is not true"
_ROW = "l_orderkey, l_linenumber, l_quantity, l_discount"


@query(f"select {_ROW} from lineitem where {_LEFT}")
def dv_delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lineitem_deletes(spark, sf_dir).df().select(*_ROW.split(", "))


@query("select count(*) as n, count(distinct l_orderkey) as orders from lineitem where (l_quantity > 45) is not true")
def dv_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.lineitem_deletes(spark, sf_dir).snapshot(3).df().agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query(f"select count(*) as record_count, count(*) filter (where not ({_LEFT})) as deleted, count(*) filter (where {_LEFT}) as live from lineitem")
def dv_effective_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.lineitem_deletes(spark, sf_dir)
    rows = R.effective_counts(X.catalog(spark), str(table.ident), table.read().sequence)
    return rows.agg(*[F.sum(c).alias(c) for c in ("record_count", "deleted", "live")])


@query(f"select count(*) as deleted from lineitem where not ({_LEFT})")
def dv_cardinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deletes.vector_summary(X.lineitem_deletes(spark, sf_dir)).agg(F.sum("deleted").alias("deleted"))


@query("select n_nationkey, n_name from nation where n_nationkey not in (0, 3, 7)")
def dv_delete_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.source(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    table = X.fresh(spark, df, name="positions")
    table.append(df.coalesce(1).sortWithinPartitions("n_nationkey"))
    uuid_ = table.read().files[0].uuid
    deletes.delete_rows(table, {uuid_: [0, 3]})
    deletes.delete_rows(table, {uuid_: [3, 7]})
    return table.df()


_KEYED = """select o_orderkey, case when o_orderstatus = 'F' then o_totalprice + 1 when o_orderstatus = 'O' and o_orderkey % 7 = 0 then o_totalprice + 2 else o_totalprice end as o_totalprice
    from orders where o_orderstatus <> 'F' or o_orderkey % 10 = 0"""


@query(_KEYED)
def upsert_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_keyed(spark, sf_dir).df(columns=("o_orderkey", "o_totalprice"))


# Row changes


@query("select o_orderkey, 2::bigint as _txn_seq from orders union all select o_orderkey, 4 from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0")
def cdc_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_changes(X.orders_keyed(spark, sf_dir), to=4, ops=("insert",)).select("o_orderkey", "_txn_seq")


@query("select o_orderkey, o_totalprice, 3::bigint as _txn_seq from orders where o_orderstatus = 'F'")
def cdc_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_changes(X.orders_keyed(spark, sf_dir), 2, 4, ops=("delete",)).select("o_orderkey", "o_totalprice", "_txn_seq")


@query("select o_orderkey, o_totalprice as old_price, o_totalprice + 2 as new_price from orders where o_orderstatus = 'O' and o_orderkey % 7 = 0")
def cdc_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = changes.read_changes(X.orders_keyed(spark, sf_dir), 4, keys=("o_orderkey",), previous=True, ops=("update",))
    return df.select("o_orderkey", F.col("_prev.o_totalprice").alias("old_price"), F.col("o_totalprice").alias("new_price"))


@query("""select 2::bigint as s, 'insert' as op, count(*) as n from orders union all select 3, 'delete', count(*) from orders where o_orderstatus = 'F'
    union all select 4, 'insert', count(*) from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0
    union all select 5, op, n from (select unnest(['insert', 'delete']) as op, n from (select count(*) as n from orders where o_orderstatus = 'O' and o_orderkey % 7 = 0))""")
def cdc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_changes(X.orders_keyed(spark, sf_dir)).groupBy(F.col("_txn_seq").alias("s"), F.col("_op").alias("op")).agg(F.count("*").alias("n"))


@query("select o_orderkey from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0")
def cdc_since_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_keyed(spark, sf_dir)
    saved = changes.Checkpoint.loads(changes.Checkpoint(str(table.ident), 3).dumps())
    df, _ = changes.read_changes_since(table, saved, columns=("o_orderkey",), ops=("insert",))
    return df.where("_txn_seq = 4").select("o_orderkey")


@query("select 15::bigint as n")
def cdc_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.read_changes(X.orders_keyed(spark, sf_dir), 2, limit=15).agg(F.count("*").alias("n"))


@query("select op, count(*) as n from (select unnest(['c', 'd']) as op from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0) group by all having op = 'c' union all select 'u', count(*) from orders where o_orderstatus = 'O' and o_orderkey % 7 = 0")
def cdc_debezium(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_keyed(spark, sf_dir)
    df = changes.read_changes(table, 3, keys=("o_orderkey",), previous=True)
    out = changes.debezium(df, table.read().schema.spec.to_spark().names, str(table.ident))
    return out.groupBy(F.get_json_object("value", "$.op").alias("op")).agg(F.count("*").alias("n"))


@query("select 'insert' as op, count(*) as n from region")
def cdc_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.source(spark, sf_dir, "region")
    table = X.fresh(spark, df, name="buffered")
    return changes.read_changes(table, 0, buffered=df).where("_txn_seq is null").groupBy(F.col("_op").alias("op")).agg(F.count("*").alias("n"))


@query("select o_orderkey, 1 as _schema_version from orders where o_orderstatus = 'F' and o_orderkey % 10 = 0")
def cdc_with_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_keyed(spark, sf_dir)
    return changes.with_schema(table, changes.read_changes(table, 3, 4)).select("o_orderkey", "_schema_version")


# Compaction

_EVENT = "event_id, user_id, event_type"


def _copy(spark: SparkSession, sf_dir: str, name: str) -> Table:
    """A table of its own with the files of events_small, a commit each."""
    table = X.fresh(spark, X.source(spark, sf_dir, "events"), name=name)
    for f in X.events_small(spark, sf_dir).read().files:
        table.write().append_file(_spec(f)).commit()
    return table


@query(f"select {_EVENT} from events")
def compact_bin_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _copy(spark, sf_dir, "packed")
    compaction.compact(table, compaction.Config(fewest_files=2))
    return table.df(columns=_EVENT.split(", "))


@query(f"select {_EVENT} from events")
def compact_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _copy(spark, sf_dir, "sorted")
    compaction.sort_compact(table, [("user_id", False, True), ("event_id",)])
    return table.df(columns=_EVENT.split(", "))


@query(f"select {_EVENT} from events")
def compact_zorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _copy(spark, sf_dir, "zordered")
    compaction.zorder_compact(table, ["user_id", "event_type"])
    return table.df(columns=_EVENT.split(", "))


@query(f"select {_ROW} from lineitem where {_LEFT}")
def compact_materialized_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = X.lineitem_deletes(spark, sf_dir).read()
    table = X.fresh(spark, X.source(spark, sf_dir, "lineitem"), name="materialized")
    table.write().append_files([_spec(f) for f in old.files]).commit()
    builder = table.write()
    for f, o in zip(table.read().files, old.files, strict=True):
        builder = builder.set_deletion_vector(f.uuid, o.dv_path, o.dv_cardinality)
    builder.commit()
    compaction.materialize_deletes(table)
    return table.df(columns=_ROW.split(", "))


@query("select 'insert' as op, count(*) as n from events")
def compact_silent_for_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _copy(spark, sf_dir, "silent")
    compaction.compact(table, compaction.Config(fewest_files=2))
    return changes.read_changes(table).groupBy(F.col("_op").alias("op")).agg(F.count("*").alias("n"))


@query(f"select {X.SMALL_COMMITS}::bigint as files, {X.SMALL_COMMITS}::bigint as small_files, true as needed")
def compact_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = compaction.needs_compaction(X.events_small(spark, sf_dir).read())
    return spark.createDataFrame([(m["files"], m["small_files"], m["needed"])], "files long, small_files long, needed boolean")


@query("select 0::bigint as bin, count(*) as n from range({})".format(X.SMALL_COMMITS))
def compact_running_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.events_small(spark, sf_dir)
    files = R.visible(R.relation(X.catalog(spark), "files", str(table.ident)), table.read().sequence)
    return compaction.running_bins(files, 256 << 20).groupBy(F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n"))


_KEY_BITS = 31


@query("select p_partkey, (" + " + ".join(f"((p_partkey >> {k}) & 1) * {1 << 2 * k + 1} + ((p_size >> {k}) & 1) * {1 << 2 * k}" for k in range(_KEY_BITS)) + ")::bigint as z from part")
def zorder_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole width of both keys."""
    return X.source(spark, sf_dir, "part").select("p_partkey", interleaved([F.col("p_partkey"), F.col("p_size")], _KEY_BITS).alias("z"))


_SCALED = ("o_custkey::double", "epoch_us(o_orderdate)::double", "cast('0x' || rpad(left(hex(o_orderpriority), 12), 12, '0') as bigint)::double")
_BITS = " + ".join(f"((s{i} >> {b}) & 1) * {1 << 3 * b + 2 - i}" for i in range(3) for b in range(8))


@query(f"""with n as (select o_orderkey, {", ".join(f"{x} as x{i}" for i, x in enumerate(_SCALED))} from orders),
    b as (select {", ".join(f"min(x{i}) as low{i}, max(x{i}) as high{i}" for i in range(3))} from n),
    s as (select o_orderkey, {", ".join(f"coalesce(greatest(0, least(255, floor((x{i} - low{i}) / nullif(high{i} - low{i}, 0) * 256))), 0)::bigint as s{i}" for i in range(3))} from n cross join b)
    select o_orderkey, ({_BITS})::bigint as z from s""")
def zorder_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.source(spark, sf_dir, "orders")
    return df.select("o_orderkey", zorder_key(df, ["o_custkey", "o_orderdate", "o_orderpriority"]).alias("z"))


@query("select o_orderstatus, 'delete' as op, count(*) as n from orders where o_totalprice > 100000 group by all")
def cdc_after_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of files whose own transactions have expired."""
    df = X.source(spark, sf_dir, "orders")
    table = X.fresh(spark, df, name="expired")
    for rest in range(3):
        table.append(df.where(f"o_orderkey % 3 = {rest}"))
    maintenance.expire(table, keep=1)
    deletes.delete_where(table, P.Gt("o_totalprice", 100000.0))
    return changes.read_changes(table).groupBy("o_orderstatus", F.col("_op").alias("op")).agg(F.count("*").alias("n"))


@query("select o_orderstatus, count(*) as n, {} as total from orders group by all".format(_MONEY.format("o_totalprice")))
def cdc_long_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit's changes, read as it is made; over time the table adds more files than one scan of its log may hold."""
    df = X.source(spark, sf_dir, "orders")
    catalog = Catalog.in_memory(spark, limits=replace(L.DEFAULT, files_per_query=4))
    table = catalog.create_table("scratch.long", X.folder(spark), SchemaSpec.from_spark(df.schema))
    seen, point = [], changes.initial_checkpoint(table)
    for rest in range(8):
        table.append(df.where(f"o_orderkey % 8 = {rest}").coalesce(1))
        new, point = changes.read_changes_since(table, point)
        seen.append(new.select("o_orderstatus", "o_totalprice"))
        if rest % 3 == 2:
            compaction.compact(table, compaction.Config(fewest_files=2))
    return X.union(seen).groupBy("o_orderstatus").agg(F.count("*").alias("n"), _money("o_totalprice").alias("total"))


# Streams


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by all")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file stream into a table; its first batch is then run once more, and adds nothing."""
    df, place, name = X.source(spark, sf_dir, "events"), X.folder(spark), f"q{uuid.uuid4().hex[:8]}"
    df.repartition(3).write.parquet(f"{place}/in")
    table = X.fresh(spark, df, name="stream")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    ingest.ingest(stream, table, name, f"{place}/checkpoint").awaitTermination()
    ingest.replay(table, [(0, df)], name)
    return table.df().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("select event_type, count(*) as n from events group by all")
def stream_include_buffered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events: those with an even id are flushed, the others wait."""
    df = X.source(spark, sf_dir, "events")
    buffer = ingest.Buffer(X.fresh(spark, df, name="waiting"), "buffer", flush_rows=10)
    buffer.add(df.where("event_id % 2 = 0"), 10)
    buffer.add(df.where("event_id % 2 <> 0"), 1)
    return buffer.read(include_buffered=True).groupBy("event_type").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n, count(distinct event_id) as ids from events group by all")
def buffer_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events through two buffers of one query, the second one made after a restart; a flush that is called again adds nothing."""
    df = X.source(spark, sf_dir, "events")
    table = X.fresh(spark, df, name="restarted")
    for rest in (0, 1):
        buffer = ingest.Buffer(table, "buffer")
        buffer.add(df.where(f"event_id % 2 = {rest}"), 1)
        buffer.flush()
        buffer.flush()
    return table.df().groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


@query("select 1::bigint as txn_sequence, 'schema' as change, 1::bigint as record_count union all select 2, 'added', count(*) from region")
def stream_change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of a table whose metadata lies in a file, as a stream."""
    place, name = X.folder(spark), f"log{uuid.uuid4().hex[:8]}"
    path = f"{tempfile.mkdtemp()}/metadata.db"
    df = X.source(spark, sf_dir, "region")
    table = Catalog.open(spark, path).create_table("s.region", f"{place}/region", SchemaSpec.from_spark(df.schema))
    table.append(df.coalesce(1))
    changelog.read_log(spark, path, "s.region").writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("txn_sequence", "change", "record_count")


# Commits


@query("select 'orders' as t, count(*) as n from orders union all select 'customer', count(*) from customer")
def multi_table_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {k: X.source(spark, sf_dir, k) for k in ("orders", "customer")}
    tables = {k: X.fresh(spark, df, name=f"multi_{k}") for k, df in parts.items()}
    X.catalog(spark).commit_many([(t.ident, t.current_transaction_id(), Mutation((AppendFiles(tuple(t.stage(parts[k]))),))) for k, t in tables.items()])
    return X.union([t.df().agg(F.count("*").alias("n")).select(F.lit(k).alias("t"), "n") for k, t in tables.items()])


@query("select * from (values ('owner', 'a'), ('tier', 'gold')) t(k, v)")
def properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.fresh(spark, X.source(spark, sf_dir, "region"), name="props")
    table.write().set_properties({"owner": "a", "tier": "gold", "old": "x"}).remove_properties("old", "never").commit()
    return spark.createDataFrame(sorted(table.read().properties.items()), "k string, v string")


@query("select count(*) as n from region")
def commit_with_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit on a stale base conflicts; the retry reads the head again."""
    df = X.source(spark, sf_dir, "region")
    table = X.fresh(spark, df, name="retry")
    files, bases = table.stage(df.coalesce(1)), [table.current_transaction_id()]
    table.write().set_properties({"a": "b"}).commit()

    def attempt():
        return MutationBuilder(table.catalog, table.ident, bases.pop() if bases else table.current_transaction_id()).append_files(files).commit()

    table.catalog.commit_with_retry(attempt, wait=0.0)
    return table.df().agg(F.count("*").alias("n"))


@query("select 3::bigint as kept, (select count(*) from region) as n")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = X.source(spark, sf_dir, "region")
    table = X.fresh(spark, df, name="retained")
    for k in range(5):
        table.append(df.where(f"r_regionkey = {k}").coalesce(1))
    maintenance.expire(table, keep=3)
    return table.df().agg(F.count("*").alias("n")).select(F.lit(R.relation(X.catalog(spark), "transactions", str(table.ident)).count()).cast("long").alias("kept"), "n")


@query("select 2::bigint as n")
def expirable_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.expirable(X.catalog(spark), str(X.orders_versions(spark, sf_dir).ident), 6).agg(F.count("*").alias("n"))


@query("select 1::bigint as n")
def orphan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged but never committed."""
    df = X.source(spark, sf_dir, "region")
    table = X.fresh(spark, df, name="orphans")
    table.append(df.coalesce(1))
    table.stage(df.coalesce(1))
    return maintenance.orphans(table, timedelta(seconds=-5)).agg(F.count("*").alias("n"))


# Security


def _who(**attributes: object) -> security.Principal:
    return security.Principal("ada", frozenset({"analyst"}), attributes)


def _secured(spark: SparkSession, sf_dir: str, who: security.Principal, filters: tuple = (), rules: tuple = ()) -> DataFrame:
    table = X.customers(spark, sf_dir)
    own = security.Security({"analyst": (security.Permission("read", "scratch.*"),)}, [], {str(table.ident): list(filters)}, {str(table.ident): list(rules)})
    return own.read(who, table)


@query("select c_custkey, c_nationkey from customer where (c_nationkey = 3 or c_mktsegment = 'BUILDING') and c_acctbal > 0")
def security_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = (security.RowFilter("c_nationkey = :nation"), security.RowFilter("c_mktsegment = :segment"), security.RowFilter("c_acctbal > 0", restrictive=True))
    return _secured(spark, sf_dir, _who(nation=3, segment="BUILDING"), filters).select("c_custkey", "c_nationkey")


@query("select c_custkey, left(c_name, 2) || repeat('*', length(c_name) - 5) || right(c_name, 3) as c_name, null::double as c_acctbal, sha256(c_mktsegment) as c_mktsegment from customer")
def security_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (security.ColumnRule("c_name", Mask("partial", first=2, last=3)), security.ColumnRule("c_acctbal", Mask("null")), security.ColumnRule("c_mktsegment", Mask("sha256")), security.ColumnRule("c_nationkey"))
    return _secured(spark, sf_dir, _who(), rules=rules)


@query("select c_custkey, 0::integer as c_nationkey, 'tok_' || left(sha256('salt' || chr(0) || c_name), 16) as c_name, upper(left(c_mktsegment, 1)) as c_mktsegment from customer")
def security_masks_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (security.ColumnRule("c_name", Mask("tokenize", "salt")), security.ColumnRule("c_nationkey", Mask("default", 0)), security.ColumnRule("c_mktsegment", Mask("custom", "upper(left(c_mktsegment, 1))")), security.ColumnRule("c_acctbal"))
    return _secured(spark, sf_dir, _who(), rules=rules)


@query("select c_mktsegment, count(*) as n from customer where c_nationkey = 5 group by all")
def security_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.customers(spark, sf_dir)
    own = security.Security({"analyst": (security.Permission("read"),)}, [], {str(table.ident): [security.RowFilter("c_nationkey = :nation")]}, {str(table.ident): [security.ColumnRule("c_name")]})
    own.create_view(_who(nation=5), table, "customers_seen")
    return spark.sql("select c_mktsegment, count(*) as n from customers_seen group by c_mktsegment")


@query("select * from (values ('read', true), ('write', false)) t(action, allowed)")
def security_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = security.Security({"analyst": (security.Permission("all"),)}, [security.Policy("deny", (("region", "!=", "eu"),), "write")])
    for action in ("read", "write"):
        own.allowed(_who(region="us"), action, "scratch.t")
    return own.audit(spark).select("action", "allowed")


# Whatever Spark does, on snapshots


@query(f"""select o_orderpriority, count(*) as n, {_MONEY.format("l_extendedprice")} as revenue from orders join (select * from lineitem where {_LEFT}) l on l_orderkey = o_orderkey
    where year(o_orderdate) <= 1998 group by all""")
def snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as of 1998 with line items after deletes."""
    o, line = X.orders_versions(spark, sf_dir).snapshot(5).df(), X.lineitem_deletes(spark, sf_dir).df()
    return o.join(line, o.o_orderkey == line.l_orderkey).groupBy("o_orderpriority").agg(F.count("*").alias("n"), _money("l_extendedprice").alias("revenue"))


@query("select o_orderkey from orders where year(o_orderdate) between 1998 and 2001")
def snapshot_join_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_versions(spark, sf_dir)
    return table.df().join(table.snapshot(4).df(), "o_orderkey", "left_anti").select("o_orderkey")


@query("select o_custkey, o_orderkey, n from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::integer as n from orders) where n <= 2")
def snapshot_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return X.orders_versions(spark, sf_dir).df().select("o_custkey", "o_orderkey", F.row_number().over(w).alias("n")).where("n <= 2")


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by rollup (o_orderstatus, o_orderpriority)")
def snapshot_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_versions(spark, sf_dir).df().rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def snapshot_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_versions(spark, sf_dir).df().cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""select o_custkey from orders where year(o_orderdate) <= 1996 intersect select o_custkey from orders where year(o_orderdate) = 2000
    except select o_custkey from orders where o_orderstatus = 'P'""")
def snapshot_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = X.orders_versions(spark, sf_dir)
    at = lambda s: table.snapshot(s).df().select("o_custkey")
    return at(3).intersect(table.df().where(F.year("o_orderdate") == 2000).select("o_custkey")).subtract(table.df().where("o_orderstatus = 'P'").select("o_custkey"))


@query("""select c_custkey, o_orderkey from (select c_custkey, o_orderkey, row_number() over (partition by c_custkey order by o_orderdate desc, o_orderkey desc) as n
    from customer join orders on o_custkey = c_custkey and o_orderdate <= timestamp '1999-01-01') where n = 1""")
def snapshot_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last order of each customer before a moment: a maximum by time, so no window over all of a customer's orders."""
    o = X.orders_versions(spark, sf_dir).df(P.Le("o_orderdate", datetime(1999, 1, 1)))
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))
    return X.customers(spark, sf_dir).df(columns=("c_custkey",)).join(last, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def snapshot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_versions(spark, sf_dir).df(columns=("o_orderkey", "o_totalprice")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as f, count(*) filter (where o_orderstatus = 'O') as o, count(*) filter (where o_orderstatus = 'P') as p from orders group by all")
def snapshot_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.orders_versions(spark, sf_dir).df().groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0).toDF("o_orderpriority", "f", "o", "p")


@query("select date_trunc('day', ts)::date as d, event_type, count(*) as n from events group by all")
def snapshot_tumbling_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), "1 day")
    return X.events_small(spark, sf_dir).df().groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("w.start").alias("d"), "event_type", "n")


@query("select c_mktsegment, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey) group by all")
def snapshot_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL text over views of snapshots, with a subquery."""
    X.orders_versions(spark, sf_dir).snapshot().create_view("orders_now")
    X.customers(spark, sf_dir).snapshot().create_view("customers_now")
    return spark.sql("select c_mktsegment, count(*) as n from customers_now where exists (select 1 from orders_now where o_custkey = c_custkey) group by c_mktsegment")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by priority: a snapshot of orders joined with line items after row deletes."""
    return snapshot_join(spark, sf_dir)
