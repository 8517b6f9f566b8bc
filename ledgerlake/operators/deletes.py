"""Deleting rows by position: deletion vectors, kept as Parquet of (file path, row position)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.errors import Conflict, InvalidArgument
from ledgerlake.ids import new_uuid
from ledgerlake.model import CommitResult, DataFile
from ledgerlake.plans import scan
from ledgerlake.plans.predicate import Predicate
from ledgerlake.plans.scan import PATH, POSITION
from ledgerlake.table import Table


def delete_where(table: Table, predicate: Predicate) -> CommitResult | None:
    """Deletes the rows for which the predicate is true; where it is null, they stay. None if no row matches.

    Only files that may hold a match are read, and only the columns of the predicate.
    """
    now = table.snapshot()
    files = now.files(predicate)
    if not files:
        return None
    kinds = now.view.schema.spec.to_spark()
    narrow = type(kinds)([f for f in kinds if f.name in predicate.columns()]) if predicate.columns() else kinds
    hits = scan.read_files(table.catalog.spark, files, narrow, located=True).where(predicate.to_column()).select(PATH, POSITION)
    return _commit(table, now.view.transaction_id, files, hits, now.view.location)


def delete_rows(table: Table, positions: dict[str, list[int]]) -> CommitResult | None:
    """Deletes rows by file uuid and 0-based position in the file; positions deleted before stay deleted."""
    view = table.read()
    by = {f.uuid: f for f in view.files}
    if unknown := set(positions) - set(by):
        raise Conflict(f"files are gone: {', '.join(sorted(unknown))}")
    for uuid, own in positions.items():
        if own and not 0 <= min(own) <= max(own) < by[uuid].record_count:
            raise InvalidArgument(f"position outside file {uuid}")
    rows = [(by[u].path, int(p)) for u, own in positions.items() for p in own]
    hits = table.catalog.spark.createDataFrame(rows, f"{PATH} string, {POSITION} long")
    return _commit(table, view.transaction_id, [by[u] for u in positions], hits, view.location)


def _commit(table: Table, base: str, files: list[DataFile], hits: DataFrame, location: str) -> CommitResult | None:
    """Vectors are cumulative: the new one of a file holds its old positions too. One Parquet folder serves all files of the commit."""
    spark = table.catalog.spark
    path = f"{location.rstrip('/')}/deletes/{new_uuid()}"
    touched = hits.select(PATH).distinct()
    before = [f for f in files if f.dv_path]
    if before:
        hits = hits.unionByName(scan.deleted_positions(spark, before).join(touched, PATH, "left_semi"))
    hits.distinct().repartition(PATH).sortWithinPartitions(PATH, POSITION).write.parquet(path)
    counts = {r[PATH]: r["count"] for r in spark.read.schema(f"{PATH} string, {POSITION} long").parquet(path).groupBy(PATH).count().collect()}
    changed = [f for f in files if counts.get(f.path, 0) > f.dv_cardinality]
    if not changed:
        return None
    builder = table.write(base).of_kind("delete")
    for f in changed:
        builder = builder.set_deletion_vector(f.uuid, path, counts[f.path])
    return builder.commit()


def delete_where_with_retry(table: Table, predicate: Predicate, attempts: int = 3) -> CommitResult | None:
    """After a conflict the predicate is evaluated on the new head: rows moved by a compaction are found there,
    and vectors that others wrote are united with ours."""
    return table.catalog.commit_with_retry(lambda: delete_where(table, predicate), attempts)


def upsert(table: Table, rows: DataFrame, keys: list[str]) -> CommitResult:
    """Replaces rows with equal keys and adds the others, in one commit: positions of the old rows, files of the new.

    Rows must have unique keys; files staged for rows that don't are orphans, for upkeep to remove. The input is
    evaluated once, when it is staged, and its keys are read from the new files. The key columns of the table are
    read; Spark picks the join.
    """
    spark = table.catalog.spark
    new = table.stage(rows)
    kinds = table.snapshot().view.schema.spec.to_spark()
    narrow = type(kinds)([f for f in kinds if f.name in keys])
    given = spark.read.schema(narrow).parquet(*[f.path for f in new]) if new else spark.createDataFrame([], narrow)
    if not given.groupBy(*keys).count().where("count > 1").isEmpty():
        raise InvalidArgument("rows to upsert repeat a key")

    def attempt() -> CommitResult:
        now = table.snapshot()
        files = now.files()
        builder = table.write(now.view.transaction_id)
        if files:
            hits = scan.read_files(spark, files, narrow, located=True).join(given, keys, "left_semi").select(PATH, POSITION)
            path = f"{now.view.location.rstrip('/')}/deletes/{new_uuid()}"
            before = [f for f in files if f.dv_path]
            if before:
                hits = hits.unionByName(scan.deleted_positions(spark, before).join(hits.select(PATH).distinct(), PATH, "left_semi"))
            hits.distinct().repartition(PATH).sortWithinPartitions(PATH, POSITION).write.parquet(path)
            counts = {r[PATH]: r["count"] for r in spark.read.schema(f"{PATH} string, {POSITION} long").parquet(path).groupBy(PATH).count().collect()}
            for f in files:
                if counts.get(f.path, 0) > f.dv_cardinality:
                    builder = builder.set_deletion_vector(f.uuid, path, counts[f.path])
        return builder.append_files(new).commit()

    return table.catalog.commit_with_retry(attempt)


def stats_after_delete(file: DataFile) -> dict:
    """Counts as they are now; bounds hold still, but may no longer be reached, so for reports they are left out."""
    return {"record_count": file.live_rows, "size_bytes": file.effective_bytes, "column_stats": {k: {"min": None, "max": None} for k in file.column_stats or {}} if file.dv_cardinality else file.column_stats}


def vector_summary(table: Table) -> DataFrame:
    """(file_path, deleted) by the vectors active at the head."""
    files = [f for f in table.read().files if f.dv_path]
    rows = scan.deleted_positions(table.catalog.spark, files) if files else table.catalog.spark.createDataFrame([], f"{PATH} string, {POSITION} long")
    return rows.groupBy(F.col(PATH).alias("file_path")).agg(F.count("*").alias("deleted"))
