"""Errors of the catalog and of storage."""

from __future__ import annotations


class CatalogError(Exception):
    """Base of what catalog operations raise."""

    says = "{}"

    def __init__(self, detail: str) -> None:
        super().__init__(self.says.format(detail))
        self.detail = detail


class NotFound(CatalogError):
    says = "table not found: {}"


class Conflict(CatalogError):
    says = "conflict on table: {}"


class LimitExceeded(CatalogError):
    says = "limit exceeded: {}"


class InvalidArgument(CatalogError):
    says = "invalid argument: {}"


class PermissionDenied(CatalogError):
    says = "permission denied: {}"


class ProtocolVersionIncompatible(CatalogError):
    """The table asks for a newer reader or writer than this client is."""

    def __init__(self, operation: str, table: str, client: int, required: int) -> None:
        super().__init__(f"incompatible {operation} protocol for table {table}: client={client}, required_min={required}")
        self.operation, self.table, self.client, self.required = operation, table, client, required


class StorageError(Exception):
    """Base of what readers and writers raise."""


class Unsupported(StorageError):
    """A format, option or type that can't be served."""


class InvalidInput(StorageError):
    """Data that can't be written, such as an empty stream."""
