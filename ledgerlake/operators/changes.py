"""Row-level changes between commits: inserts of added files, deletes of vectors and removed files, updates by key.

A transaction that only rewrites (a compaction) changes no row, so neither its additions nor its removals count.
What a range did is read from the log: snapshots are not listed, so a table may have more files than one may hold.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.errors import InvalidArgument
from ledgerlake.model import DataFile
from ledgerlake.plans import scan
from ledgerlake.plans.scan import PATH, POSITION
from ledgerlake.table import Table

#: What describes a change; deletes come before inserts within a transaction.
META = ("_op", "_txn_seq", "_txn_id", "_file", "_pos")


@dataclass(frozen=True)
class Checkpoint:
    """How far a reader has come."""

    table: str
    sequence: int

    def dumps(self) -> str:
        return json.dumps({"table": self.table, "sequence": self.sequence})

    @classmethod
    def loads(cls, text: str) -> Checkpoint:
        return cls(**json.loads(text))


def earliest(table: Table) -> int:
    """The first retained sequence."""
    head = table.catalog.describe(table.ident)
    return table.catalog.store.row("select min(txn_sequence) as n from transactions where table_uuid = ?", (head.table_uuid,))["n"]


def latest(table: Table) -> int:
    return table.catalog.describe(table.ident).sequence


def _start(table: Table) -> int:
    """The sequence after which all changes are known: 0, or the first retained one once earlier ones have expired,
    as what that one removed is forgotten with them."""
    first = earliest(table)
    return 0 if first == 1 else first


def initial_checkpoint(table: Table) -> Checkpoint:
    return Checkpoint(str(table.ident), _start(table))


def read_changes(
    table: Table, after: int = 0, to: int | None = None, *, ops: tuple[str, ...] | None = None, columns: tuple[str, ...] | None = None, limit: int | None = None, keys: tuple[str, ...] = (), previous: bool = False, buffered: DataFrame | None = None,
) -> DataFrame:
    """Changed rows in (after, to], with META columns.

    keys: a delete and an insert of one key in a transaction become an update; previous adds the old row as
    the struct _prev. buffered: rows not committed yet, as inserts without transaction. limit takes the first
    changes in order. after 0: from the first change that is known; another that has expired is refused.
    """
    to, start = latest(table) if to is None else to, _start(table)
    if 0 < after < start:
        raise InvalidArgument(f"changes up to transaction sequence {start} have expired")
    after = max(after, start)
    if after > to:
        raise InvalidArgument("from transaction is not an ancestor of to transaction")
    schema = table.catalog.describe(table.ident, to or None).schema.spec.to_spark()
    df = _raw(table, after, to, schema)
    if keys or previous:
        df = detect_updates(df, keys or tuple(_cdc_keys(table)), schema.names, previous)
    if buffered is not None:
        blank = [F.lit("insert").alias("_op"), F.lit(None).cast("long").alias("_txn_seq"), F.lit(None).cast("string").alias("_txn_id"), F.lit(None).cast("string").alias("_file"), F.lit(None).cast("long").alias("_pos")]
        df = df.unionByName(buffered.select(*schema.names, *blank), allowMissingColumns=True)
    if ops:
        df = df.where(F.col("_op").isin(list(ops)))
    if limit is not None:
        df = in_order(df).limit(limit)
    return df.select(*columns, *META, *(["_prev"] if previous else [])) if columns else df


def _cdc_keys(table: Table) -> list[str]:
    keys = table.catalog.describe(table.ident).properties.get("cdc.key_columns") or []
    if not keys:
        raise InvalidArgument("update detection needs key columns: pass keys or set the property cdc.key_columns")
    return keys


def in_order(changes: DataFrame) -> DataFrame:
    rank = F.when(F.col("_op") == "delete", 0).when(F.col("_op") == "update", 1).otherwise(2)
    return changes.orderBy(F.col("_txn_seq").asc_nulls_last(), rank, "_file", "_pos")


def _raw(table: Table, after: int, to: int, schema: T.StructType) -> DataFrame:
    catalog, spark = table.catalog, table.catalog.spark
    events = [e for e in catalog.events(table.ident, after or None, to or None) if e.kind != "compaction"] if to else []
    ids = {e.sequence: e.transaction_id for e in events}
    added = [(c.file, e.sequence) for e in events for c in e.file_changes if c.kind == "added"]
    removed = _as_of(table, [(c.file, e.sequence) for e in events for c in e.file_changes if c.kind == "removed"])
    parts = []
    if added:
        parts.append(_tagged(scan.read_files(spark, [f for f, _ in added], schema, located=True), added, ids, "insert", spark))
    if removed:
        parts.append(_tagged(scan.read_files(spark, [f for f, _ in removed], schema, located=True), removed, ids, "delete", spark))
    vectors = _new_positions(table, after, to, ids)
    if vectors is not None:
        files, positions = vectors
        rows = scan.read_files(spark, files, schema, located=True).join(positions, [PATH, POSITION])
        parts.append(rows.select(*schema.names, F.lit("delete").alias("_op"), "_txn_seq", "_txn_id", F.col(PATH).alias("_file"), F.col(POSITION).alias("_pos")))
    if not parts:
        return spark.createDataFrame([], T.StructType([*schema.fields, *T._parse_datatype_string("_op string, _txn_seq long, _txn_id string, _file string, _pos long")]))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _tagged(rows: DataFrame, files: list[tuple[DataFile, int]], ids: dict[int, str], op: str, spark) -> DataFrame:
    """rows with the transaction of their file: a join with the files, which the catalog bounds. Their list is the side to
    broadcast: Spark does not know its size, and may take the rows for smaller, by what their files measure compressed."""
    of = spark.createDataFrame([(f.path, s, ids[s]) for f, s in files], f"{PATH} string, _txn_seq long, _txn_id string")
    names = [c for c in rows.columns if c not in (PATH, POSITION)]
    return rows.join(F.broadcast(of), PATH).select(*[F.col(f"`{n}`") for n in names], F.lit(op).alias("_op"), "_txn_seq", "_txn_id", F.col(PATH).alias("_file"), F.col(POSITION).alias("_pos"))


def _as_of(table: Table, removed: list[tuple[DataFile, int]]) -> list[tuple[DataFile, int]]:
    """The files with the vectors that were active before their removal: what they held then is what it deletes."""
    held: dict[str, list] = {}
    uuids = [f.uuid for f, _ in removed]
    for k in range(0, len(uuids), 500):
        some = tuple(uuids[k : k + 500])
        for r in table.catalog.store.rows(f"select * from deletion_vectors where file_uuid in ({', '.join('?' * len(some))})", some):
            held.setdefault(r["file_uuid"], []).append(r)
    out = []
    for file, sequence in removed:
        own = [r for r in held.get(file.uuid, ()) if r["added_in_sequence"] < sequence and (r["removed_in_sequence"] is None or r["removed_in_sequence"] >= sequence)]
        out.append((replace(file, dv_path=own[0]["dv_path"], dv_cardinality=own[0]["cardinality"]) if own else file, sequence))
    return out


def _new_positions(table: Table, after: int, to: int, ids: dict[int, str]) -> tuple[list[DataFile], DataFrame] | None:
    """Positions that vectors of the range add to the vectors before them. Each vector holds its predecessor's, so
    a position counts at its first appearance."""
    spark, store, uuid = table.catalog.spark, table.catalog.store, table.catalog.describe(table.ident).table_uuid
    rows = store.rows(
        "select d.*, f.file_path, d2.dv_path as old_path from deletion_vectors d join files f using (file_uuid) left join deletion_vectors d2 on d2.file_uuid = d.file_uuid and d2.removed_in_sequence = d.added_in_sequence"
        " where d.table_uuid = ? and d.added_in_sequence > ? and d.added_in_sequence <= ?", (uuid, after, to),
    )
    rows = [r for r in rows if r["added_in_sequence"] in ids]
    if not rows:
        return None
    files = {f.uuid: f for f in table.catalog.files(table.ident, list(dict.fromkeys(r["file_uuid"] for r in rows)), to)}
    schema = f"{PATH} string, {POSITION} long"
    parts = []
    for seq in sorted({r["added_in_sequence"] for r in rows}):
        own = [r for r in rows if r["added_in_sequence"] == seq]
        paths = [r["file_path"] for r in own]
        new = spark.read.schema(schema).parquet(*dict.fromkeys(r["dv_path"] for r in own)).where(F.col(PATH).isin(paths))
        if old := list(dict.fromkeys(r["old_path"] for r in own if r["old_path"])):
            new = new.join(spark.read.schema(schema).parquet(*old), [PATH, POSITION], "left_anti")
        parts.append(new.select(PATH, POSITION, F.lit(seq).cast("long").alias("_txn_seq"), F.lit(ids[seq]).alias("_txn_id")))
    return [files[r] for r in dict.fromkeys(r["file_uuid"] for r in rows)], reduce(lambda a, b: a.unionByName(b), parts)


def detect_updates(changes: DataFrame, keys: tuple[str, ...], names: list[str], previous: bool = False) -> DataFrame:
    """Pairs deletes and inserts of a transaction by key. A key with several deletes or inserts in one transaction stays
    as these, and so does one with a null.

    One aggregation finds the pairs, combined before its shuffle, so that a key with many changes is no burden;
    what is not paired is the rest of an anti-join, which splits such a key.
    """
    by = ["_txn_seq", *keys]
    quoted = [F.col(f"`{n}`") for n in names]
    is_old, is_new = F.col("_op") == "delete", F.col("_op") == "insert"
    known = reduce(lambda a, k: a & F.col(f"`{k}`").isNotNull(), keys, F.lit(True))
    pairs = (
        changes.where(known).groupBy(*[F.col(f"`{k}`") for k in by])
        .agg(
            F.count_if(is_old).alias("_d"), F.count_if(is_new).alias("_i"), F.first(F.when(is_old, F.struct(*quoted)), ignorenulls=True).alias("_prev"),
            F.first(F.when(is_new, F.struct(*quoted, *[F.col(m) for m in META])), ignorenulls=True).alias("_new"),
        )
        .where("_d = 1 and _i = 1")
    )
    updates = pairs.select(*[F.col(f"_new.`{n}`").alias(n) for n in names], F.lit("update").alias("_op"), *[F.col(f"_new.{m}").alias(m) for m in META[1:]], "_prev")
    kind = updates.schema["_prev"].dataType
    rest = changes.join(pairs.select(*[F.col(f"`{k}`") for k in by]), by, "left_anti").select(*quoted, *META, F.lit(None).cast(kind).alias("_prev"))
    out = updates.unionByName(rest)
    return out if previous else out.drop("_prev")


def read_changes_since(table: Table, checkpoint: Checkpoint | None, **options: object) -> tuple[DataFrame, Checkpoint]:
    """The changes after a checkpoint, and the checkpoint at the head."""
    start = checkpoint or initial_checkpoint(table)
    head = latest(table)
    return read_changes(table, start.sequence, head, **options), Checkpoint(str(table.ident), head)


def schema_changes(table: Table, after: int = 0) -> list[dict]:
    """created, added, type_changed and nullability_changed, by schema version; columns can't be dropped or renamed."""
    out, last = [], None
    for version in table.catalog.schema_history(table.ident):
        had = {c.name: c for c in last.spec.columns} if last else {}
        if version.valid_from > after:
            if last is None:
                out.append({"sequence": version.valid_from, "change": "created", "column": None, "was": None, "now": None})
            for c in version.spec.columns if last else ():
                if c.name not in had:
                    out.append({"sequence": version.valid_from, "change": "added", "column": c.name, "was": None, "now": str(c.type)})
                elif c.type != had[c.name].type:
                    out.append({"sequence": version.valid_from, "change": "type_changed", "column": c.name, "was": str(had[c.name].type), "now": str(c.type)})
                elif c.nullable != had[c.name].nullable:
                    out.append({"sequence": version.valid_from, "change": "nullability_changed", "column": c.name, "was": str(had[c.name].nullable), "now": str(c.nullable)})
        last = version
    return out


def with_schema(table: Table, changes: DataFrame) -> DataFrame:
    """changes with _schema_version, that of the transaction."""
    spans = [(v.version, v.valid_from, v.valid_to) for v in table.catalog.schema_history(table.ident)]
    of = table.catalog.spark.createDataFrame(spans, "_schema_version int, _from long, _until long")
    met = (F.col("_txn_seq") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("_txn_seq") < F.col("_until")))
    return changes.join(F.broadcast(of), met, "left").drop("_from", "_until")


def debezium(changes: DataFrame, names: list[str], source: str) -> DataFrame:
    """(key, value): one JSON envelope a change, with before, after, source and op (c, u, d). Takes changes with _prev."""
    row, gone = F.struct(*names), F.col("_op") == "delete"
    before = F.when(gone, row).when(F.col("_op") == "update", F.struct(*[F.col(f"_prev.{n}").alias(n) for n in names]))
    envelope = F.struct(
        before.alias("before"), F.when(~gone, row).alias("after"),
        F.struct(F.lit(source).alias("table"), F.col("_txn_id").alias("txId"), F.col("_txn_seq").alias("sequence")).alias("source"),
        F.when(gone, "d").when(F.col("_op") == "update", "u").otherwise("c").alias("op"),
    )
    return changes.select(F.concat_ws(":", F.lit(source), F.col("_txn_seq"), "_file", "_pos").alias("key"), F.to_json(envelope, {"ignoreNullFields": "false"}).alias("value"))


def publish(table: Table, checkpoint: Checkpoint | None, send, **options: object) -> Checkpoint:
    """Hands the new changes to ``send`` (a DataFrame sink, such as a Kafka writer) and returns the checkpoint to save once it is done."""
    changes, after = read_changes_since(table, checkpoint, **options)
    send(changes)
    return after
