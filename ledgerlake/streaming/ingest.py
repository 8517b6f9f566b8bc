"""Streams into tables: micro-batches as commits, each at most once."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from time import monotonic

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ledgerlake.errors import Conflict
from ledgerlake.ids import new_uuid
from ledgerlake.sources.formats import WriteOptions
from ledgerlake.table import Table

FLUSH_BYTES, FLUSH_SECONDS, FLUSH_ROWS = 128 << 20, 300, 1_000_000


def commit_batch(table: Table, df: DataFrame, query_id: str, batch_id: int, options: WriteOptions | None = None) -> bool:
    """Appends a micro-batch unless it is in the table already; whether it was appended.

    The batch's number is recorded in the transaction of the append, so a batch that is run again after a
    failure, at whatever point, adds nothing.
    """
    if table.catalog.has_batch(table.ident, query_id, batch_id) or df.isEmpty():
        return False
    try:
        table.append(df, options, lambda b: b.for_batch(query_id, batch_id))
    except Conflict:
        if table.catalog.has_batch(table.ident, query_id, batch_id):
            return False
        raise
    return True


def ingest(stream: DataFrame, table: Table, query_id: str, checkpoint: str, *, every: str | None = None, options: WriteOptions | None = None) -> StreamingQuery:
    """Starts a query that commits each micro-batch. every: the interval between batches; None: all that is there, then stop."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).queryName(query_id.replace("-", "_")).foreachBatch(lambda df, n: commit_batch(table, df, query_id, n, options) and None)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@dataclass
class Buffer:
    """Rows on their way into a table, for writers that have no stream: flushed by size, rows, age or call.

    Rows wait in the source's own log; the buffer holds DataFrames, not data. Unflushed rows are seen only by
    reads that ask for them. Every buffer numbers its batches under an id of its own, so that one made after a
    restart, or beside another of the same query_id, is never taken for a batch that is in the table already;
    a flush that is called again after it failed at whatever point adds nothing twice.
    """

    table: Table
    query_id: str
    flush_rows: int = FLUSH_ROWS
    flush_bytes: int = FLUSH_BYTES
    flush_seconds: float = FLUSH_SECONDS
    pending: list[DataFrame] = field(default_factory=list)
    rows: int = 0
    size: int = 0
    since: float | None = None
    batch: int = 0
    own_id: str = field(default_factory=new_uuid)

    def add(self, df: DataFrame, rows: int, size: int = 0) -> bool:
        """Whether the buffer was flushed. size: bytes of the rows, as far as known."""
        self.pending.append(df)
        self.rows += rows
        self.size += size
        self.since = self.since if self.since is not None else monotonic()
        return self.flush() if self.due() else False

    def due(self) -> bool:
        """Whether rows, bytes or the age of the first waiting rows ask for a flush."""
        return bool(self.pending) and (self.rows >= self.flush_rows or self.size >= self.flush_bytes or monotonic() - self.since >= self.flush_seconds)

    def flush(self) -> bool:
        """Commits what waits, and lets go of it once it is in the table; whether this call appended rows."""
        if not self.pending:
            return False
        done = commit_batch(self.table, self.buffered(), f"{self.query_id}:{self.own_id}", self.batch)
        self.pending, self.rows, self.size, self.since, self.batch = [], 0, 0, None, self.batch + 1
        return done

    def buffered(self) -> DataFrame | None:
        if not self.pending:
            return None
        out = self.pending[0]
        for df in self.pending[1:]:
            out = out.unionByName(df, allowMissingColumns=True)
        return out

    def read(self, include_buffered: bool = False) -> DataFrame:
        """Committed rows, and on request those still in the buffer."""
        df = self.table.df()
        waiting = self.buffered() if include_buffered else None
        return df if waiting is None else df.unionByName(waiting, allowMissingColumns=True).select(*df.columns)


def replay(table: Table, batches: Iterable[tuple[int, DataFrame]], query_id: str) -> int:
    """Commits logged batches again after a failure; how many were new."""
    return sum(commit_batch(table, df, query_id, n) for n, df in batches)
