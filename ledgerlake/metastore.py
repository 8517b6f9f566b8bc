"""The control plane: tables, transactions, schemas and files in a relational database that only the driver talks to.

A commit is one database transaction that starts by taking the write lock, so that reading the head,
comparing it with the base and advancing it can't interleave with another commit.
"""

from __future__ import annotations

import re
import sqlite3
import threading
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any, Protocol

#: Public relations, in the order in which a table's rows can be deleted.
RELATIONS = ("file_column_stats", "deletion_vectors", "files", "columns", "schemas", "partition_specs", "table_stats", "batches", "tags", "transactions", "tables")

_DDL = """
create table if not exists tables (
    table_uuid text primary key, namespace text not null, table_name text not null, location text not null,
    current_schema_uuid text, current_transaction_id text, current_transaction_sequence integer not null, current_spec_id integer not null default 0,
    created_at text not null, properties text not null, min_reader_version integer not null, min_writer_version integer not null,
    unique (namespace, table_name));
create table if not exists transactions (
    transaction_id text primary key, table_uuid text not null references tables, txn_sequence integer not null,
    transaction_timestamp text not null, parent_transaction_id text, kind text not null default 'write',
    unique (table_uuid, txn_sequence));
create table if not exists schemas (
    schema_uuid text primary key, table_uuid text not null references tables, schema_version integer not null,
    valid_from_transaction_id text not null, valid_from_sequence integer not null,
    valid_to_transaction_id text, valid_to_sequence integer, created_at text not null,
    unique (table_uuid, schema_version));
create index if not exists schemas_validity on schemas (table_uuid, valid_from_sequence, valid_to_sequence);
create table if not exists columns (
    column_uuid text primary key, schema_uuid text not null references schemas, column_name text not null,
    column_type blob not null, ordinal_position integer not null, is_nullable integer not null,
    unique (schema_uuid, column_name));
create table if not exists files (
    file_uuid text primary key, table_uuid text not null references tables, file_format text not null, file_path text not null,
    record_count integer not null, file_size_bytes integer not null,
    added_in_transaction_id text not null, added_in_sequence integer not null,
    removed_in_transaction_id text, removed_in_sequence integer,
    partition_values text, format_options text, spec_id integer not null default 0);
create index if not exists files_visibility on files (table_uuid, added_in_sequence, removed_in_sequence);
create index if not exists files_removed on files (table_uuid, removed_in_sequence);
create table if not exists file_column_stats (
    file_uuid text not null references files, column_name text not null, null_count integer, nan_count integer,
    min_value text, max_value text, distinct_count integer, primary key (file_uuid, column_name));
create table if not exists table_stats (
    table_uuid text primary key references tables, transaction_id text not null, record_count integer not null,
    file_size_bytes integer not null, file_count integer not null, last_updated text not null);
create table if not exists deletion_vectors (
    dv_uuid text primary key, file_uuid text not null references files, table_uuid text not null references tables,
    dv_path text not null, cardinality integer not null, added_in_sequence integer not null, removed_in_sequence integer);
create index if not exists deletion_vectors_file on deletion_vectors (table_uuid, file_uuid, added_in_sequence);
create table if not exists partition_specs (
    table_uuid text not null references tables, spec_id integer not null, fields text not null, added_in_sequence integer not null,
    primary key (table_uuid, spec_id));
create table if not exists batches (
    table_uuid text not null references tables, query_id text not null, batch_id integer not null, transaction_id text not null,
    primary key (table_uuid, query_id, batch_id));
create table if not exists tags (
    table_uuid text not null references tables, tag text not null, transaction_id text not null, primary key (table_uuid, tag));
"""


class Dialect(Protocol):
    """What differs between databases."""

    begin: str
    lock: str

    def sql(self, text: str) -> str: ...


class Sqlite:
    begin, lock = "begin immediate", ""

    @staticmethod
    def sql(text: str) -> str:
        return text


class Postgres:
    """Statements are rewritten and heads are locked by row; no driver comes with this package."""

    begin, lock = "begin", " for update"

    @staticmethod
    def sql(text: str) -> str:
        numbers = iter(range(1, 10_000))
        return re.sub(r"\?", lambda _: f"${next(numbers)}", text)


class MetaStore:
    """SQLite, in a file (a connection a thread, write-ahead log) or in memory (one connection, shared under a lock)."""

    def __init__(self, path: str = ":memory:", timeout: float = 30.0) -> None:
        self.path, self.timeout = path, timeout
        self._memory = path == ":memory:"
        self._lock = threading.RLock()
        self._local = threading.local()
        self._shared = self._connect() if self._memory else None
        connection = self._connection()
        connection.executescript(_DDL)

    def _connect(self) -> sqlite3.Connection:
        connection = sqlite3.connect(self.path, timeout=self.timeout, isolation_level=None, check_same_thread=False)
        connection.row_factory = sqlite3.Row
        connection.execute("pragma foreign_keys = on")
        if not self._memory:
            connection.execute("pragma journal_mode = wal")
        return connection

    def _connection(self) -> sqlite3.Connection:
        if self._shared is not None:
            return self._shared
        if not hasattr(self._local, "connection"):
            self._local.connection = self._connect()
        return self._local.connection

    def rows(self, sql: str, values: Iterable[Any] = ()) -> list[sqlite3.Row]:
        with self._lock if self._memory else _nothing():
            return self._connection().execute(Sqlite.sql(sql), tuple(values)).fetchall()

    def row(self, sql: str, values: Iterable[Any] = ()) -> sqlite3.Row | None:
        return next(iter(self.rows(sql, values)), None)

    @contextmanager
    def write(self) -> Iterator[Writer]:
        """A write transaction: all of it, or nothing if the block raises."""
        with self._lock if self._memory else _nothing():
            connection = self._connection()
            connection.execute(Sqlite.begin)
            try:
                yield Writer(connection)
            except BaseException:
                connection.execute("rollback")
                raise
            connection.execute("commit")


@contextmanager
def _nothing() -> Iterator[None]:
    yield


class Writer:
    """Statements of one write transaction."""

    def __init__(self, connection: sqlite3.Connection) -> None:
        self._connection = connection

    def rows(self, sql: str, values: Iterable[Any] = ()) -> list[sqlite3.Row]:
        return self._connection.execute(sql, tuple(values)).fetchall()

    def row(self, sql: str, values: Iterable[Any] = ()) -> sqlite3.Row | None:
        return next(iter(self.rows(sql, values)), None)

    def run(self, sql: str, values: Iterable[Any] = ()) -> int:
        """How many rows the statement changed."""
        return self._connection.execute(sql, tuple(values)).rowcount

    def insert(self, relation: str, *rows: dict[str, Any]) -> None:
        for chunk in (rows[i : i + 500] for i in range(0, len(rows), 500)):
            names = list(chunk[0])
            self._connection.executemany(f"insert into {relation} ({', '.join(names)}) values ({', '.join('?' * len(names))})", [tuple(r[n] for n in names) for r in chunk])
