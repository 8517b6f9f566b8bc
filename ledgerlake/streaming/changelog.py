"""The commit log of a table as a stream: offsets are sequences, rows are file and schema events."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "ledgerlake_log"
_SCHEMA = "txn_sequence long, transaction_id string, kind string, change string, file_uuid string, file_path string, record_count long"
_EVENTS = """
select t.txn_sequence, t.transaction_id, t.kind, c.change, c.file_uuid, c.file_path, c.record_count
from transactions t left join (
    select added_in_sequence as s, 'added' as change, file_uuid, file_path, record_count, table_uuid from files
    union all select removed_in_sequence, 'removed', file_uuid, file_path, record_count, table_uuid from files where removed_in_sequence is not null
    union all select valid_from_sequence, 'schema', schema_uuid, null, schema_version, table_uuid from schemas
) c on c.s = t.txn_sequence and c.table_uuid = t.table_uuid
where t.table_uuid = ? and t.txn_sequence > ? and t.txn_sequence <= ? order by t.txn_sequence, c.change, c.file_path
"""


class LogRange(InputPartition):
    """Rows of a range of sequences, read by the driver: only it reaches the metadata."""

    def __init__(self, rows: list[tuple]) -> None:
        super().__init__(0)
        self.rows = rows


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, namespace: str, name: str, start: int) -> None:
        self.path, self.namespace, self.name, self.start = path, namespace, name, start

    def _rows(self, sql: str, *values: object) -> list[tuple]:
        connection = sqlite3.connect(self.path, timeout=30)
        try:
            return connection.execute(sql, values).fetchall()
        finally:
            connection.close()

    def initialOffset(self) -> dict:
        return {"sequence": self.start}

    def latestOffset(self) -> dict:
        found = self._rows("select current_transaction_sequence from tables where namespace = ? and table_name = ?", self.namespace, self.name)
        return {"sequence": found[0][0] if found else self.start}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        table = self._rows("select table_uuid from tables where namespace = ? and table_name = ?", self.namespace, self.name)[0][0]
        return [LogRange(self._rows(_EVENTS, table, start["sequence"], end["sequence"]))]

    def read(self, partition: LogRange) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        """Nothing to do: the log is kept by the catalog."""


class LogSource(DataSource):
    """Options: metadata (path of the database), table (namespace.name), after (sequence)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return _SCHEMA

    def streamReader(self, schema: object) -> LogReader:
        namespace, _, name = self.options["table"].rpartition(".")
        return LogReader(self.options["metadata"], namespace, name, int(self.options.get("after", 0)))


def read_log(spark: SparkSession, metadata: str, table: str, after: int = 0) -> DataFrame:
    """A streaming DataFrame of the table's events after a sequence. The metadata must be in a file."""
    spark.dataSource.register(LogSource)
    return spark.readStream.format(FORMAT).options(metadata=metadata, table=table, after=str(after)).load()
