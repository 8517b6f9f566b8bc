"""Metadata as DataFrames: the public relations of the catalog, and questions over them.

Rows come from the metadata database by way of the driver; every relation is bounded by the catalog's limits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake import types
from ledgerlake.catalog import Catalog
from ledgerlake.errors import LimitExceeded

_SCHEMAS = {
    "tables": "table_uuid string, namespace string, table_name string, location string, current_schema_uuid string, current_transaction_id string, current_transaction_sequence long, created_at string, properties string, min_reader_version int, min_writer_version int",
    "transactions": "transaction_id string, table_uuid string, txn_sequence long, transaction_timestamp string, parent_transaction_id string, kind string",
    "schemas": "schema_uuid string, table_uuid string, schema_version int, valid_from_transaction_id string, valid_from_sequence long, valid_to_transaction_id string, valid_to_sequence long, created_at string",
    "columns": "column_uuid string, schema_uuid string, column_name string, column_type string, ordinal_position int, is_nullable boolean",
    "files": "file_uuid string, table_uuid string, file_format string, file_path string, record_count long, file_size_bytes long, added_in_transaction_id string, added_in_sequence long, removed_in_transaction_id string, removed_in_sequence long, partition_values string, format_options string, spec_id int",
    "file_column_stats": "file_uuid string, column_name string, null_count long, nan_count long, min_value string, max_value string, distinct_count long",
    "table_stats": "table_uuid string, transaction_id string, record_count long, file_size_bytes long, file_count long, last_updated string",
    "deletion_vectors": "dv_uuid string, file_uuid string, table_uuid string, dv_path string, cardinality long, added_in_sequence long, removed_in_sequence long",
}


def relation(catalog: Catalog, name: str, ident: str | None = None) -> DataFrame:
    """All rows of a relation, or those of one table."""
    schema = _SCHEMAS[name]
    names = [c.split(" ")[0] for c in schema.split(", ")]
    where, values = "", ()
    if ident is not None:
        table = catalog.read_table(ident).table_uuid
        of = {"columns": "schema_uuid in (select schema_uuid from schemas where table_uuid = ?)", "file_column_stats": "file_uuid in (select file_uuid from files where table_uuid = ?)"}
        where, values = f" where {of.get(name, 'table_uuid = ?')}", (table,)
    rows = [dict(r) for r in catalog.store.rows(f"select * from {name}{where}", values)]
    for r in rows:
        if name == "columns":
            r["column_type"], r["is_nullable"] = str(types.decode(r["column_type"])), bool(r["is_nullable"])
    return catalog.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def register_views(catalog: Catalog, prefix: str = "meta_") -> None:
    for name in _SCHEMAS:
        relation(catalog, name).createOrReplaceTempView(prefix + name)


def bounded(df: DataFrame, most: int) -> list:
    """All rows of df, or LimitExceeded if there are more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise LimitExceeded(f"result exceeds limit of {most}")
    return rows


def visible(files: DataFrame, sequence: int) -> DataFrame:
    """The files of a snapshot: one predicate, wherever visibility is asked for."""
    return files.where((F.col("added_in_sequence") <= sequence) & (F.col("removed_in_sequence").isNull() | (F.col("removed_in_sequence") > sequence)))


def file_events(catalog: Catalog, ident: str, after: int = 0, to: int | None = None) -> DataFrame:
    """(txn_sequence, kind, file_uuid, record_count) of every added and removed file, transactions without any included."""
    txns, files = relation(catalog, "transactions", ident), relation(catalog, "files", ident)
    changes = [files.where(f"{k}_in_sequence is not null").select(F.col(f"{k}_in_sequence").alias("txn_sequence"), F.lit(k).alias("kind"), "file_uuid", "record_count") for k in ("added", "removed")]
    span = txns.where((F.col("txn_sequence") > after) & (F.col("txn_sequence") <= to if to is not None else F.lit(True)))
    return span.select("txn_sequence").join(changes[0].union(changes[1]), "txn_sequence", "left")


def event_counts(catalog: Catalog, ident: str) -> DataFrame:
    """(txn_sequence, added, removed)."""
    return file_events(catalog, ident).groupBy("txn_sequence").agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))


def net_changes(catalog: Catalog, ident: str, after: int, to: int) -> DataFrame:
    """(file_uuid, change): each file's last event in the range, unless the range also holds the opposite one."""
    events = file_events(catalog, ident, after, to).where("file_uuid is not null")
    last = Window.partitionBy("file_uuid").orderBy(F.desc("txn_sequence"), F.col("kind").desc())
    every = events.withColumn("n", F.row_number().over(last)).withColumn("kinds", F.size(F.collect_set("kind").over(Window.partitionBy("file_uuid"))))
    return every.where("n = 1 and kinds = 1").select("file_uuid", F.col("kind").alias("change"))


def delta_by_anti_join(catalog: Catalog, ident: str, after: int, to: int) -> DataFrame:
    """The same by two anti-joins between what is visible at either end."""
    files = relation(catalog, "files", ident)
    old, new = visible(files, after).select("file_uuid"), visible(files, to).select("file_uuid")
    return new.join(old, "file_uuid", "left_anti").withColumn("change", F.lit("added")).union(old.join(new, "file_uuid", "left_anti").withColumn("change", F.lit("removed")))


def schema_columns(catalog: Catalog, ident: str) -> DataFrame:
    """(schema_version, columns): names in order."""
    both = relation(catalog, "schemas", ident).join(relation(catalog, "columns", ident), "schema_uuid")
    listed = both.groupBy("schema_version").agg(F.sort_array(F.collect_list(F.struct("ordinal_position", "column_name"))).alias("c"))
    return listed.select("schema_version", F.col("c.column_name").alias("columns"))


def schema_gaps(catalog: Catalog, ident: str) -> DataFrame:
    """Schema versions whose validity does not end where the next one's begins; none in a sound catalog."""
    after = F.lead("valid_from_sequence").over(Window.orderBy("schema_version"))
    return relation(catalog, "schemas", ident).withColumn("next", after).where(~F.col("valid_to_sequence").eqNullSafe(F.col("next")))


def chain_gaps(catalog: Catalog, ident: str) -> DataFrame:
    """Transactions whose parent or sequence does not follow the one before; none in a sound catalog."""
    w = Window.orderBy("txn_sequence")
    rows = relation(catalog, "transactions", ident).withColumns({"before": F.lag("transaction_id").over(w), "gap": F.col("txn_sequence") - F.lag("txn_sequence", 1, 0).over(w)})
    return rows.where((F.col("gap") != 1) | ~F.col("parent_transaction_id").eqNullSafe(F.col("before")))


def totals(catalog: Catalog, ident: str, sequence: int) -> DataFrame:
    """(files, records, bytes) of a snapshot, from metadata."""
    return visible(relation(catalog, "files", ident), sequence).agg(F.count("*").alias("files"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("records"), F.coalesce(F.sum("file_size_bytes"), F.lit(0)).alias("bytes"))


def effective_counts(catalog: Catalog, ident: str, sequence: int) -> DataFrame:
    """(file_uuid, record_count, deleted, live) by the deletion vectors active at the sequence."""
    dvs = visible(relation(catalog, "deletion_vectors", ident), sequence).groupBy("file_uuid").agg(F.sum("cardinality").alias("deleted"))
    both = visible(relation(catalog, "files", ident), sequence).join(dvs, "file_uuid", "left").withColumn("deleted", F.coalesce("deleted", F.lit(0)))
    return both.select("file_uuid", "record_count", "deleted", (F.col("record_count") - F.col("deleted")).alias("live"))


def partition_values(catalog: Catalog, ident: str, sequence: int, *names: str) -> DataFrame:
    """Files of a snapshot with their partition values as columns."""
    return visible(relation(catalog, "files", ident), sequence).select("file_uuid", "record_count", "file_size_bytes", *[F.get_json_object("partition_values", f"$.{n}").alias(n) for n in names])


def partition_stats(catalog: Catalog, ident: str, sequence: int, *names: str) -> DataFrame:
    """(names..., files, records, bytes)."""
    return partition_values(catalog, ident, sequence, *names).groupBy(*names).agg(F.count("*").alias("files"), F.sum("record_count").alias("records"), F.sum("file_size_bytes").alias("bytes"))


def lifecycle(catalog: Catalog, ident: str, oldest: int) -> DataFrame:
    """(file_uuid, state): visible, deleted (an older snapshot still shows it) or expired, given the oldest kept sequence."""
    state = F.when(F.col("removed_in_sequence").isNull(), "visible").when(F.col("removed_in_sequence") > oldest, "deleted").otherwise("expired")
    return relation(catalog, "files", ident).select("file_uuid", state.alias("state"))
