"""Upper bounds of every catalog operation. Tests pass smaller ones."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    files_per_query: int = 10_000
    columns_per_schema: int = 1_000
    tables_per_list: int = 10_000
    transactions_per_scan: int = 50_000
    schema_changes_per_scan: int = 10_000
    operations_per_mutation: int = 1_000
    files_per_append: int = 1_000
    files_per_delete: int = 1_000
    property_keys_to_remove: int = 100
    json_bytes: int = 1_048_576
    insert_chunk: int = 100
    delete_chunk: int = 500


DEFAULT = Limits()

#: Bind parameters that a statement may have, by database.
BIND_PARAMETERS = {"sqlite": 32_766, "postgres": 65_535}
