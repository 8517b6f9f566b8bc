"""Upkeep: statistics, retention of commits, files that nothing refers to. Plain functions, to be called on a schedule."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake import relations
from ledgerlake.catalog import Catalog
from ledgerlake.errors import InvalidArgument
from ledgerlake.plans import stats
from ledgerlake.table import Table

GRACE = timedelta(hours=24)


def refresh_table_stats(table: Table) -> dict:
    """Writes the head's totals to table_stats and returns them."""
    view = table.read()
    row = {"table_uuid": view.table_uuid, "transaction_id": view.transaction_id, "record_count": sum(f.live_rows for f in view.files), "file_size_bytes": sum(f.size_bytes for f in view.files), "file_count": len(view.files), "last_updated": datetime.now(timezone.utc).isoformat()}
    with table.catalog.store.write() as w:
        w.run("delete from table_stats where table_uuid = ?", (view.table_uuid,))
        w.insert("table_stats", row)
    table.catalog._views.clear()
    return row


def column_statistics(table: Table) -> dict[str, dict]:
    """Statistics of the head's columns from those of its files."""
    return stats.merged([f.column_stats for f in table.read().files])


def collect_file_stats(table: Table) -> int:
    """Measures the files that were registered without statistics; how many."""
    view = table.read()
    bare = [f for f in view.files if f.column_stats is None and f.format == "parquet"]
    if not bare:
        return 0
    schema = view.schema.spec.to_spark()
    by = {f.path: f.uuid for f in bare}
    rows = stats.file_stats(table.catalog.spark.read.schema(schema).parquet(*by)).collect()
    named = {p.rpartition(":")[2].replace("//", "/"): u for p, u in by.items()}
    with table.catalog.store.write() as w:
        for r in rows:
            uuid = by.get(r["file_path"]) or named[r["file_path"].rpartition(":")[2].replace("//", "/")]
            for name, s in stats.as_stats(r, T.StructType(list(schema))).items():
                w.insert("file_column_stats", {"file_uuid": uuid, "column_name": name, "null_count": s.get("nulls"), "nan_count": s.get("nans"), "min_value": json.dumps(s.get("min")), "max_value": json.dumps(s.get("max")), "distinct_count": None})
    table.catalog._views.clear()
    return len(rows)


def tag(table: Table, name: str, at: str | int | None = None) -> None:
    """Keeps a commit from expiring under a name."""
    view = table.catalog.read_table(table.ident, at)
    with table.catalog.store.write() as w:
        w.run("delete from tags where table_uuid = ? and tag = ?", (view.table_uuid, name))
        w.insert("tags", {"table_uuid": view.table_uuid, "tag": name, "transaction_id": view.transaction_id})


def expirable(catalog: Catalog, ident: str, keep: int) -> DataFrame:
    """(txn_sequence) of the transactions beyond the last ``keep``."""
    newest = Window.orderBy(F.desc("txn_sequence"))
    return relations.relation(catalog, "transactions", ident).withColumn("n", F.row_number().over(newest)).where(F.col("n") > keep).select("txn_sequence")


def expire(table: Table, keep: int | None = None, older_than: timedelta | None = None) -> int:
    """Forgets old transactions: all before the last ``keep``, or older than an age, up to the first tagged one.

    Only files that were removed before the oldest kept transaction are forgotten; live files stay. How many
    transactions went.
    """
    view, store = table.read(), table.catalog.store
    if keep is not None and keep < 1:
        raise InvalidArgument("at least one transaction must be kept")
    floor = view.sequence if keep is None else max(1, view.sequence - keep + 1)
    if older_than is not None:
        limit = (datetime.now(timezone.utc) - older_than).isoformat()
        young = store.row("select min(txn_sequence) as n from transactions where table_uuid = ? and transaction_timestamp >= ?", (view.table_uuid, limit))["n"]
        floor = min(floor, young if young is not None else view.sequence)
    tagged = store.row("select min(t.txn_sequence) as n from transactions t join tags using (transaction_id) where t.table_uuid = ?", (view.table_uuid,))["n"]
    floor = min(floor, tagged) if tagged is not None else floor
    with store.write() as w:
        gone = (view.table_uuid, floor)
        w.run("delete from file_column_stats where file_uuid in (select file_uuid from files where table_uuid = ? and removed_in_sequence <= ?)", gone)
        w.run("delete from deletion_vectors where table_uuid = ? and (removed_in_sequence <= ? or file_uuid in (select file_uuid from files where table_uuid = ? and removed_in_sequence <= ?))", (*gone, *gone))
        w.run("delete from files where table_uuid = ? and removed_in_sequence <= ?", gone)
        w.run("delete from columns where schema_uuid in (select schema_uuid from schemas where table_uuid = ? and valid_to_sequence <= ?)", gone)
        w.run("delete from schemas where table_uuid = ? and valid_to_sequence <= ?", gone)
        n = w.run("delete from transactions where table_uuid = ? and txn_sequence < ?", gone)
    table.catalog._views.clear()
    return n


def orphans(table: Table, grace: timedelta = GRACE) -> DataFrame:
    """(path, length, modified) of files under the table's folder that no row of the catalog names and that are older than the grace period.

    Files of every retained commit count as named, not only the head's; young ones may belong to a commit in progress.
    """
    spark, view = table.catalog.spark, table.read()
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(view.location).select("path", "length", F.col("modificationTime").alias("modified"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    named = relations.relation(table.catalog, "files", str(table.ident)).select(plain(F.col("file_path")).alias("p"))
    folders = relations.relation(table.catalog, "deletion_vectors", str(table.ident)).select(plain(F.col("dv_path")).alias("folder")).distinct()
    there = there.withColumn("p", plain(F.col("path"))).withColumn("folder", F.regexp_replace("p", "/[^/]*$", ""))
    old = F.col("modified") < F.lit(datetime.now(timezone.utc) - grace)
    return there.where(old).join(named, "p", "left_anti").join(folders, "folder", "left_anti").select("path", "length", "modified")


def remove_orphans(table: Table, grace: timedelta = GRACE) -> int:
    """Deletes them; how many. Paths come to the driver in parts."""
    jvm, conf, n = table.catalog.spark._jvm, table.catalog.spark._jsc.hadoopConfiguration(), 0
    for r in orphans(table, grace).select("path").toLocalIterator():
        path = jvm.org.apache.hadoop.fs.Path(r.path)
        n += bool(path.getFileSystem(conf).delete(path, False))
    return n
