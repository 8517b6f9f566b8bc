"""What tables, commits and files are declared with, and what the catalog gives back."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import types as T

from ledgerlake import limits as L
from ledgerlake import types
from ledgerlake.errors import InvalidArgument, LimitExceeded, StorageError
from ledgerlake.sources import formats


@dataclass(frozen=True)
class TableIdent:
    namespace: str
    name: str

    @classmethod
    def parse(cls, text: str) -> TableIdent:
        namespace, _, name = text.rpartition(".")
        return cls(namespace or "default", name)

    def __str__(self) -> str:
        return f"{self.namespace}.{self.name}"


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: pa.DataType
    nullable: bool = False


@dataclass(frozen=True)
class SchemaSpec:
    columns: tuple[ColumnSpec, ...]

    @classmethod
    def of(cls, *columns: tuple) -> SchemaSpec:
        """From (name, Arrow type) or (name, Arrow type, nullable)."""
        return cls(tuple(ColumnSpec(*c) for c in columns))

    @classmethod
    def from_spark(cls, schema: T.StructType) -> SchemaSpec:
        return cls(tuple(ColumnSpec(f.name, types.from_spark(f.dataType), f.nullable) for f in schema))

    def to_spark(self) -> T.StructType:
        """Nullable throughout: older files may lack a column, and file sources don't promise values."""
        return T.StructType([T.StructField(c.name, types.to_spark(c.type), True) for c in self.columns])

    def validate(self, limits: L.Limits = L.DEFAULT) -> None:
        if not self.columns:
            raise InvalidArgument("schema must include at least one column")
        if len(self.columns) > limits.columns_per_schema:
            raise LimitExceeded(f"schema has {len(self.columns)} columns, exceeds limit of {limits.columns_per_schema}")
        names = [c.name for c in self.columns]
        if not all(n.strip() for n in names):
            raise InvalidArgument("column name cannot be empty")
        if again := next((n for i, n in enumerate(names) if n in names[:i]), None):
            raise InvalidArgument(f"duplicate column name: '{again}'")


def as_json(value: Any, limits: L.Limits = L.DEFAULT) -> str | None:
    if value is None:
        return None
    text = json.dumps(value, separators=(",", ":"), sort_keys=True)
    if len(text.encode()) > limits.json_bytes:
        raise LimitExceeded(f"JSON size {len(text.encode())} bytes exceeds limit of {limits.json_bytes} bytes")
    return text


def checked_properties(properties: dict | None) -> dict:
    if properties is None:
        return {}
    if not isinstance(properties, dict):
        raise InvalidArgument("table properties must be a JSON object")
    for key in properties:
        checked_key(key)
    return properties


def checked_key(key: str) -> str:
    if not key.strip():
        raise InvalidArgument("property key cannot be empty")
    return key


@dataclass(frozen=True)
class FileSpec:
    """A data file to be registered. column_stats: by column {nulls, nans, min, max, distinct}, values as in plans.stats."""

    path: str
    record_count: int
    size_bytes: int
    format: str = "parquet"
    uuid: str | None = None
    partition_values: dict | None = None
    format_options: dict | None = None
    spec_id: int = 0
    column_stats: dict | None = None

    def validate(self) -> None:
        if not self.path.strip():
            raise InvalidArgument("file path cannot be empty")
        if self.record_count < 0:
            raise InvalidArgument("record_count cannot be negative")
        if self.size_bytes < 0:
            raise InvalidArgument("file_size_bytes cannot be negative")
        for name, value in (("partition_values", self.partition_values), ("format_options", self.format_options)):
            if value is not None and not isinstance(value, dict):
                raise InvalidArgument(f"{name} must be a JSON object")
        try:
            formats.write_options(self.format, self.format_options)
        except StorageError as error:
            raise InvalidArgument(str(error)) from error


@dataclass(frozen=True)
class DataFile:
    """A registered file with the sequences between which it is visible."""

    uuid: str
    format: str
    path: str
    record_count: int
    size_bytes: int
    added_txn: str
    added: int
    removed_txn: str | None
    removed: int | None
    partition_values: dict | None
    format_options: dict | None
    spec_id: int
    column_stats: dict | None = None
    dv_path: str | None = None
    dv_cardinality: int = 0
    #: Columns that Spark's reader can't widen by itself, with the type that they were written in.
    written_as: tuple[tuple[str, pa.DataType], ...] = ()

    @property
    def live_rows(self) -> int:
        return self.record_count - self.dv_cardinality

    @property
    def deleted_share(self) -> float:
        return self.dv_cardinality / self.record_count if self.record_count else 0.0

    @property
    def effective_bytes(self) -> int:
        return int(self.size_bytes * (1 - self.deleted_share))


@dataclass(frozen=True)
class SchemaVersion:
    uuid: str
    version: int
    valid_from_txn: str
    valid_from: int
    valid_to_txn: str | None
    valid_to: int | None
    spec: SchemaSpec


# The operations of a commit, applied in order.


@dataclass(frozen=True)
class AppendFiles:
    files: tuple[FileSpec, ...]


@dataclass(frozen=True)
class DeleteFiles:
    uuids: tuple[str, ...]


@dataclass(frozen=True)
class UpdateSchema:
    schema: SchemaSpec


@dataclass(frozen=True)
class SetProperties:
    properties: dict


@dataclass(frozen=True)
class RemoveProperties:
    keys: tuple[str, ...]


@dataclass(frozen=True)
class SetDeletionVector:
    """From this commit on, the rows of a file at the positions in dv_path are deleted; replaces the file's earlier vector."""

    file_uuid: str
    dv_path: str
    cardinality: int


@dataclass(frozen=True)
class SetPartitionSpec:
    """The spec of files that are written from now on, as JSON of functions.transforms.PartitionSpec."""

    fields: tuple[dict, ...]


Op = AppendFiles | DeleteFiles | UpdateSchema | SetProperties | RemoveProperties | SetDeletionVector | SetPartitionSpec


@dataclass(frozen=True)
class Mutation:
    """operations, and notes kept with the transaction: kind (write, delete, compaction), and the batch it stands for."""

    operations: tuple[Op, ...] = ()
    kind: str = "write"
    batch: tuple[str, int] | None = None

    def plus(self, op: Op) -> Mutation:
        return replace(self, operations=(*self.operations, op))

    def validate(self, limits: L.Limits = L.DEFAULT) -> None:
        if not self.operations:
            raise InvalidArgument("mutation has no operations")
        if len(self.operations) > limits.operations_per_mutation:
            raise LimitExceeded(f"mutation has {len(self.operations)} operations, exceeds limit of {limits.operations_per_mutation}")
        for kind in (UpdateSchema, SetProperties, SetPartitionSpec):
            if sum(isinstance(op, kind) for op in self.operations) > 1:
                raise InvalidArgument(f"mutation can include at most one {kind.__name__} operation")
        for op in self.operations:
            if isinstance(op, DeleteFiles):
                _no_repeats(op.uuids, "file UUID in DeleteFiles")
            elif isinstance(op, RemoveProperties):
                for key in op.keys:
                    checked_key(key)
                _no_repeats(op.keys, "property key in RemoveProperties")
            elif isinstance(op, SetProperties):
                checked_properties(op.properties)


def _no_repeats(values: tuple[str, ...], what: str) -> None:
    if again := next((v for i, v in enumerate(values) if v in values[:i]), None):
        raise InvalidArgument(f"duplicate {what}: {again}")


@dataclass(frozen=True)
class CommitResult:
    transaction_id: str
    sequence: int
    removed_files: int = 0
    table_view: None = None


@dataclass(frozen=True)
class FileChange:
    transaction_id: str
    kind: str  # added or removed
    file: DataFile


@dataclass(frozen=True)
class Event:
    transaction_id: str
    sequence: int
    kind: str
    file_changes: tuple[FileChange, ...] = ()
    schema_change: SchemaVersion | None = None


@dataclass(frozen=True)
class Delta:
    """Net change between two transactions."""

    from_transaction_id: str
    to_transaction_id: str
    added_files: tuple[DataFile, ...] = ()
    removed_files: tuple[DataFile, ...] = ()
    new_schema: SchemaVersion | None = None
    new_properties: dict | None = None


@dataclass(frozen=True)
class View:
    """A table as of a transaction: everything needed to read it."""

    ident: TableIdent
    table_uuid: str
    location: str
    transaction_id: str
    sequence: int
    schema: SchemaVersion
    files: tuple[DataFile, ...]
    properties: dict
    specs: dict[int, tuple[dict, ...]] = field(default_factory=dict)
    spec_id: int = 0
    stats: dict | None = None
