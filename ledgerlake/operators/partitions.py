"""Operators on the partitions of a table."""

from __future__ import annotations

from typing import Any

from ledgerlake.functions.transforms import PartitionSpec, plain
from ledgerlake.model import CommitResult, DataFile
from ledgerlake.table import Table


def files_in(table: Table, values: dict[str, Any]) -> list[DataFile]:
    """Files of the head whose partition has these values, by name of the field in the file's own spec."""
    wanted = {k: plain(v) for k, v in values.items()}
    return [f for f in table.read().files if f.partition_values and all(k in f.partition_values and f.partition_values[k] == v for k, v in wanted.items())]


def drop_partition(table: Table, values: dict[str, Any]) -> CommitResult | None:
    """Removes the files of a partition; no data is read."""
    base = table.current_transaction_id()
    files = files_in(table, values)
    return table.write(base).delete_files([f.uuid for f in files]).commit() if files else None


def partitions(table: Table) -> dict[tuple, list[DataFile]]:
    """Files by partition values, in terms of the current spec; fields that a file's spec lacks are null."""
    view = table.read()
    specs = {i: PartitionSpec.load(i, fields) for i, fields in view.specs.items()}
    out: dict[tuple, list[DataFile]] = {}
    for f in view.files:
        values = specs[f.spec_id].normalized(f.partition_values, specs[view.spec_id])
        out.setdefault(tuple(sorted(values.items())), []).append(f)
    return out
